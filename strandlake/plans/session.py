"""Session helpers: input paths, shared scratch space, code shipping."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named parquet table below ``sf_dir``; any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application.

    Needed where workers do not share the driver's PYTHONPATH. The driver serves
    the zip to executors, so no shared folder is assumed.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = Path(__file__).resolve().parents[1]
    if not root.is_dir():
        return
    tmp = tempfile.mkdtemp(prefix="strandlake-src-")
    atexit.register(shutil.rmtree, tmp, ignore_errors=True)
    target = os.path.join(os.path.abspath(tmp), f"{root.name}_src.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(target)


def tasks_for(df: DataFrame, each: int) -> int:
    """Tasks for a shuffle of what is made from ``df``: one for each so many bytes of the tables it reads, the session's number at least.

    Sizes are those that Spark plans with, so nothing is read for them; sources of unknown size do not count.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    total = sum(x for x in sizes if x < 1 << 60)
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(20_000, -(-total // each)))


def scratch_dir(spark: SparkSession) -> str:
    """Shared scratch folder from ``spark.checkpoint.dir``.

    A folder of this process' own is set only where the session has none, as in tests,
    and only in local mode: executors elsewhere could not read it.
    """
    sc = spark.sparkContext
    conf = sc.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf
    own = sc._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get()
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="strandlake-checkpoint-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    sc.setCheckpointDir(made)
    return made


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` in the shared folder."""
    scratch_dir(df.sparkSession)
    return df.checkpoint()


class Workspace:
    """Tables of one run in the shared folder, below a name of its own.

    ``drop`` removes tables once nothing reads them any more; what is left, because a
    result still reads it, goes when the process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_dir(spark).rstrip('/')}/strandlake/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        atexit.register(self._remove, self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}-{len(self.paths)}-{uuid.uuid4().hex[:8]}"

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as parquet and read it back."""
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        self.__dict__.setdefault("held", []).append(out)  # so that ids stay theirs
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            path = self.paths.pop(id(t), None)
            if path is not None:
                self._remove(path)

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsparkSession.sparkContext().hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM has ended: nothing can be removed, and nothing depends on it
            pass


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back; it goes when the process ends."""
    return Workspace(df.sparkSession, name).written(df, name)


# --- joins on keys that may be hot ------------------------------------------------

#: A key with more than one in SHARE rows of a join is dealt to several tasks.
SHARE = 1000


def hot_keys(counted: DataFrame, key: str, n: str, total: int, least: int = 64) -> DataFrame | None:
    """Keys with more than one in SHARE of ``total`` rows, so SHARE keys at most, with the ``parts`` to deal each to."""
    spark = counted.sparkSession
    hot = counted.where((F.col(n) * SHARE > total) & (F.col(n) >= least))
    hot = hot.select(F.col(key).alias("__hot"), F.ceil(F.col(n) * SHARE / F.lit(total)).cast("int").alias("__parts"))
    rows = hot.collect()
    return spark.createDataFrame(rows, hot.schema) if rows else None


def dealt_join(many: DataFrame, once: DataFrame, key: str, hot: DataFrame | None, by: str, how: str = "inner") -> DataFrame:
    """``many`` joined with ``once``, which holds each key once; rows of hot keys are dealt by a hash of ``by``.

    No part of a hot key holds more than about one in SHARE rows, and ``once`` grows by
    twice SHARE rows at most.
    """
    if hot is None:
        return many.join(once, key, how)
    parts = F.broadcast(hot)
    m = many.join(parts, F.col(key) == F.col("__hot"), "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("__parts")), F.lit(0)).cast("int")).drop("__hot", "__parts")
    o = once.join(parts, F.col(key) == F.col("__hot"), "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__parts"), F.lit(1)) - 1))).drop("__hot", "__parts")
    return m.join(o, [key, "__salt"], how).drop("__salt")
