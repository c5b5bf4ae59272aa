"""Relational operators of dataflow scripts, by the names that scripts use.

Each is a thin composition of DataFrame operations, so Catalyst plans the whole query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flatten_bag(df: DataFrame, bag: str, name: str) -> DataFrame:
    """One row per element; a row with an empty or null bag is dropped."""
    return df.select(*[c for c in df.columns if c != bag], F.explode(bag).alias(name))


def flatten_bags(df: DataFrame, *bags: str) -> DataFrame:
    """The cross product of the elements of several bags of each row."""
    for b in bags:
        df = df.withColumn(b, F.explode(b))
    return df


def flatten_tuple(df: DataFrame, struct: str) -> DataFrame:
    return df.select(*[c for c in df.columns if c != struct], f"{struct}.*")


def project_bag(df: DataFrame, bag: str, field: str, name: str) -> DataFrame:
    """One field of each element."""
    return df.withColumn(name, F.transform(bag, lambda x: x[field]))


def matches(c: str | Column, pattern: str) -> Column:
    """True where the pattern matches the whole string."""
    return (F.col(c) if isinstance(c, str) else c).rlike(f"^(?:{pattern})$")


def group(df: DataFrame, keys: list[str], name: str = "bag") -> DataFrame:
    """One row per key with a bag of the group's rows; a constant key is an empty list."""
    rows = F.collect_list(F.struct(*df.columns)).alias(name)
    return df.groupBy(*keys).agg(rows) if keys else df.agg(rows)


def count_rows(df: DataFrame, keys: list[str], first: str, name: str = "n") -> DataFrame:
    """Rows of each group whose first field is not null."""
    return df.groupBy(*keys).agg(F.count(first).alias(name))


def having(df: DataFrame, keys: list[str], condition: str, **aggregates: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()]).where(condition)


def cogroup(left: DataFrame, right: DataFrame, key: str, inner: bool = True) -> DataFrame:
    """key, left_bag, right_bag; ``inner`` keeps keys that both sides have."""
    a, b = group(left, [key], "left_bag"), group(right, [key], "right_bag")
    j = a.join(b, key, "inner" if inner else "full")
    if inner:
        return j
    return j.select(key, *[F.coalesce(c, F.array().cast(j.schema[c].dataType)).alias(c) for c in ("left_bag", "right_bag")])


def cross(left: DataFrame, right: DataFrame) -> DataFrame:
    """All pairs of rows; columns are told apart by suffixes 1 and 2."""
    return left.select([F.col(c).alias(f"{c}1") for c in left.columns]).crossJoin(right.select([F.col(c).alias(f"{c}2") for c in right.columns]))


def parallel(df: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """``df`` dealt to so many tasks, by a hash of ``keys`` where there are any."""
    return df.repartition(tasks, *keys)


def join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys: inner, left, right, full, semi or anti. A null key matches none."""
    return left.join(right, keys, {"full": "full", "semi": "left_semi", "anti": "left_anti"}.get(how, how))


def skewed_join(left: DataFrame, right: DataFrame, key: str, salts: int = 16, share: float = 0.001) -> DataFrame:
    """Inner join in which rows of hot keys are dealt to several tasks.

    Keys with more than ``share`` of the left side's rows are counted (1 / ``share`` keys
    at most); their left rows get a salt and their right rows come once for each salt.
    """
    total = left.count()
    hot = left.groupBy(key).count().where((F.col("count") > share * total) & F.col(key).isNotNull())
    hot = F.broadcast(left.sparkSession.createDataFrame(hot.select(F.col(key).alias("__hot")).collect(), T.StructType([T.StructField("__hot", left.schema[key].dataType)])))
    a = left.join(hot, F.col(key) == F.col("__hot"), "left")
    a = a.withColumn("__salt", F.when(F.col("__hot").isNotNull(), F.floor(F.rand(1) * salts)).otherwise(0).cast("int")).drop("__hot")
    b = right.join(hot, F.col(key) == F.col("__hot"), "left")
    b = b.withColumn("__salt", F.explode(F.when(F.col("__hot").isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("__hot")
    return a.join(b, [key, "__salt"]).drop("__salt")


def merge_join(left: DataFrame, right: DataFrame, key: str, parallel: int | None = None) -> DataFrame:
    """Inner join by sorting both sides; ``parallel``: so many tasks."""
    if parallel is not None:
        left, right = left.repartition(parallel, key), right.repartition(parallel, key)
    return left.hint("merge").join(right.hint("merge"), key)


def union(*relations: DataFrame) -> DataFrame:
    """All rows, repeats kept, columns matched by name; columns that a relation lacks are null."""
    out = relations[0]
    for r in relations[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out


def intersect(left: DataFrame, right: DataFrame, all: bool = False) -> DataFrame:
    return left.intersectAll(right) if all else left.intersect(right)


def difference(left: DataFrame, right: DataFrame, all: bool = False) -> DataFrame:
    return left.exceptAll(right) if all else left.subtract(right)


def split(df: DataFrame, **conditions: str) -> dict[str, DataFrame]:
    """A relation for each condition; a row may be in several or none."""
    return {n: df.where(c) for n, c in conditions.items()}


def sample(df: DataFrame, fraction: float, seed: int = 0, by: str | None = None) -> DataFrame:
    """Rows kept with that probability; ``by``: decided by a hash of a column, so that reruns and other tables agree."""
    if by is None:
        return df.sample(fraction=fraction, seed=seed)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(by).cast("string")), 256)
    return df.where(F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") < fraction * float(1 << 32))


def rank(df: DataFrame, by: list[Column], dense: bool = False, within: list[str] | None = None, name: str = "rank") -> DataFrame:
    w = Window.partitionBy(*(within or [])).orderBy(*by)
    return df.withColumn(name, F.dense_rank().over(w) if dense else F.rank().over(w))


def cube(df: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    return df.cube(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])


def rollup(df: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    return df.rollup(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])


def top(df: DataFrame, by: list[Column], n: int) -> DataFrame:
    return df.orderBy(*by).limit(n)


def tokenize(df: DataFrame, column: str, name: str = "token") -> DataFrame:
    """One row per word; separators are white space, quotes, commas, parentheses and asterisks."""
    words = F.filter(F.split(F.col(column), '[ \\t\\n\\r\\f",()*]+'), lambda w: w != "")
    return df.select(*[c for c in df.columns if c != column], F.explode(words).alias(name))
