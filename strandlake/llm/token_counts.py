"""Token counts that follow edits.

A document is kept as a segment tree over runs of whole pre-tokens. Runs end where the
pre-token pattern of byte-level BPE parts whatever stands further away, so the counts of
runs add up to the count of the text: before a single space between two characters that
are not white space, and between ASCII letters, digits and other signs (but not between
an apostrophe and a letter, which may be one contraction). An edit re-encodes the runs it
touches, with a neighbour where the character beside a seam changes, and updates sums
along the paths to the root. Nothing else is encoded again, and runs that an edit has
made long are split. The runs' sizes and counts are a column, so that trees outlive the
job that has built them.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.textnum import slices
from strandlake.plans.session import ship_package

#: Fixed value: white space other than the space itself that str.isspace does not know or that patterns may differ on.
_ODD = "\x1c\x1d\x1e\x1f\x85\u180e\u200b\ufeff"
_SOLID = rf"[^\s{_ODD}]"
_LETTER, _DIGIT = "[A-Za-z]", "[0-9]"
_SIGN, _PLAIN_SIGN = r"[!-/:-@\[-`{-~]", r"[!-&(-/:-@\[-`{-~]"
_AT_SPACE = rf"(?<={_SOLID})(?= {_SOLID})"
_AT_CLASS = rf"(?<={_LETTER})(?={_DIGIT}|{_SIGN})|(?<={_DIGIT})(?={_LETTER}|{_SIGN})|(?<={_PLAIN_SIGN})(?={_LETTER})|(?<={_SIGN})(?={_DIGIT})"
#: Fixed value: the pattern under which changes of class part pre-tokens.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SAFE = re.compile(f"{_AT_SPACE}|{_AT_CLASS}")
SAFE_AT_SPACES = re.compile(_AT_SPACE)


def cuts(text: str, least: int, safe: re.Pattern = SAFE) -> list[int]:
    """Offsets where runs begin, 0 first; each run but the last has ``least`` characters or more."""
    out = [0]
    m = safe.search(text, max(1, least))
    while m is not None:
        out.append(m.start())
        m = safe.search(text, m.start() + max(1, least))
    return out


class SegmentTree:
    """Sums of characters and tokens over the runs of one document.

    ``count``: tokens of each of a list of texts. ``known``: (characters, tokens) of the
    runs as :meth:`leaves` gave them, so that nothing is encoded. ``encoded`` adds up the
    characters that edits have had encoded.
    """

    def __init__(self, text: str, count: Callable[[list[str]], list[int]], least: int = 512, known: list[tuple[int, int]] | None = None, safe: re.Pattern = SAFE):
        self.count, self.least, self.safe = count, least, safe
        if known:
            at = np.append(0, np.cumsum([c for c, _ in known])).tolist()
            if at[-1] != len(text):
                raise ValueError("the runs are not those of the text")
        else:
            at = [*cuts(text, least, safe), len(text)]
        self.runs = [text[i:j] for i, j in zip(at, at[1:], strict=False)]
        self._build(count(self.runs) if not known else [t for _, t in known])
        self.encoded = 0

    def _build(self, tokens: list[int]) -> None:
        n = len(self.runs)
        self.size = 1 << max(0, (n - 1).bit_length())
        self.chars, self.tokens = np.zeros(2 * self.size, np.int64), np.zeros(2 * self.size, np.int64)
        self.chars[self.size : self.size + n] = [len(r) for r in self.runs]
        self.tokens[self.size : self.size + n] = tokens
        for a in (self.chars, self.tokens):
            level = self.size
            while level > 1:
                a[level // 2 : level] = a[level : 2 * level].reshape(-1, 2).sum(1)
                level //= 2
        self.empty = sum(not r for r in self.runs)

    def __len__(self) -> int:
        return int(self.chars[1])

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def text(self) -> str:
        return "".join(self.runs)

    def leaves(self) -> list[tuple[int, int]]:
        """(characters, tokens) of each run that has any."""
        n = len(self.runs)
        both = zip(self.chars[self.size : self.size + n].tolist(), self.tokens[self.size : self.size + n].tolist(), strict=True)
        return [(c, t) for c, t in both if c]

    def find(self, offset: int) -> tuple[int, int]:
        """(run, offset in it) of a character, by descent; the end of the text is in its last run that has characters."""
        offset = min(max(offset, 0), len(self))
        at = 1
        while at < self.size:
            at *= 2
            if offset > self.chars[at] or (offset == self.chars[at] and self.chars[at + 1]):
                offset -= int(self.chars[at])
                at += 1
        return at - self.size, offset

    def _put(self, run: int, text: str, tokens: int) -> None:
        self.empty += (not text) - (not self.runs[run])
        self.runs[run] = text
        at = self.size + run
        self.chars[at], self.tokens[at] = len(text), tokens
        while at > 1:
            at //= 2
            self.chars[at] = self.chars[2 * at] + self.chars[2 * at + 1]
            self.tokens[at] = self.tokens[2 * at] + self.tokens[2 * at + 1]

    def _near(self, run: int, step: int) -> int | None:
        run += step
        while 0 <= run < len(self.runs):
            if self.runs[run]:
                return run
            run += step
        return None

    def _seam(self, left: str, right: str) -> bool:
        """Whether pre-tokens part between the two whatever stands further away."""
        return self.safe.match(left[-1:] + right[:2], 1) is not None

    def replace(self, start: int, end: int, new: str) -> None:
        """Put ``new`` for the characters from ``start`` to ``end``."""
        start = min(max(start, 0), len(self))
        end = min(max(end, start), len(self))
        (i, a), (j, b) = self.find(start), self.find(end)
        text = self.runs[i][:a] + new + self.runs[j][b:]
        while (left := self._near(i, -1)) is not None and not (text and self._seam(self.runs[left], text)):
            text, i = self.runs[left] + text, left
        while (right := self._near(j, 1)) is not None and not (text and self._seam(text, self.runs[right])):
            text, j = text + self.runs[right], right
        at = [*cuts(text, self.least, self.safe), len(text)]
        parts = [text[x:y] for x, y in zip(at, at[1:], strict=False)]
        counts = self.count(parts)
        self.encoded += len(text)
        free = j - i + 1
        if len(parts) <= free:
            for k in range(free):
                self._put(i + k, parts[k] if k < len(parts) else "", counts[k] if k < len(parts) else 0)
            if self.empty <= 8 + len(self.runs) // 2:
                return
            i, j, parts, counts = 0, -1, [], []
        # More runs than before, or mostly empty ones: the tree gets a new shape from the counts it has.
        n = len(self.runs)
        old = self.tokens[self.size : self.size + n].tolist()
        both = list(zip(self.runs[:i] + parts + self.runs[j + 1 :], old[:i] + counts + old[j + 1 :], strict=True))
        both = [x for x in both if x[0]] or [("", 0)]
        self.runs = [r for r, _ in both]
        self._build([t for _, t in both])


class Counter:
    """Tokens of texts by a tiktoken vocabulary of ranks; special tokens' strings are ordinary text."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, texts: list[str]) -> list[int]:
        encode = self.encoding.encode_ordinary
        return [len(encode(t)) for t in texts]


_counters: dict[tuple[str, str], Counter] = {}


def counter(path: str, pattern: str) -> Counter:
    if (path, pattern) not in _counters:
        _counters[path, pattern] = Counter(path, pattern)
    return _counters[path, pattern]


#: Fixed value: e-mail addresses, which the scrubbing edits replace.
MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")


def mail_edits(text: str | None, new: str = "<email>") -> list[tuple[int, int, str]]:
    """(start, end, replacement) for each e-mail address of a text, last first."""
    if not text or "@" not in text:
        return []
    return [(m.start(), m.end(), new) for m in _mails(text)][::-1]


def _mails(text: str) -> Iterator[re.Match]:
    """Matches of MAIL, looked for only around each @ of the text."""
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and (text[start - 1].isascii() and text[start - 1].isalnum() or text[start - 1] in "._%+-"):
            start -= 1
        m = MAIL.match(text, start)
        if m and m.end() > at:
            yield m
            end = m.end()
        at = text.find("@", max(at + 1, end))


_COUNTS = "n_tokens long, n_edits long, n_tokens_edited long, n_runs long, n_chars long, n_chars_edited long, chars_encoded_again long"
_SCHEMA = f"id long, {_COUNTS}"
_RUN = pa.list_(pa.struct([("chars", pa.int64()), ("tokens", pa.int64())]))
_TREES = f"id long, text string, runs array<struct<chars:long,tokens:long>>, {_COUNTS}"


def _safe(pattern: str) -> re.Pattern:
    return SAFE if pattern == BYTE_LEVEL else SAFE_AT_SPACES


def _counted(path: str, pattern: str, least: int, edits_of: Callable | None, trees: bool):
    """``trees``: the edited text and its runs are returned too. Columns: id, text[, runs][, edits]."""
    names = [x.split()[0] for x in (_TREES if trees else _SCHEMA).split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, safe = counter(path, pattern), _safe(pattern)
        for b in slices(batches, 1):
            rows, texts, leaves = [], [], []
            cols = {n: b.column(n).to_pylist() if n in b.schema.names else [None] * b.num_rows for n in ("id", "text", "runs", "edits")}
            for i, t, r, e in zip(*cols.values(), strict=True):
                tree = SegmentTree(t or "", count, least, [(x["chars"], x["tokens"]) for x in r] if r else None, safe)
                n, chars = tree.total, len(tree)
                todo = edits_of(t) if edits_of else [(x["start"], x["end"], x["text"] or "") for x in (e or [])]
                for start, end, new in todo:
                    tree.replace(start, end, new)
                rows.append((n, len(todo), tree.total, len(tree.leaves()), chars, len(tree), tree.encoded))
                if trees:
                    texts.append(tree.text())
                    leaves.append([{"chars": c, "tokens": k} for c, k in tree.leaves()])
            first = [b.column(0), *((pa.array(texts, pa.string()), pa.array(leaves, _RUN)) if trees else ())]
            yield pa.RecordBatch.from_arrays([*first, *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))], names=names)

    return run


def vocabulary(path: str | None = None, pattern: str | None = None) -> tuple[str, str]:
    """The given file of ranks and pre-token pattern, or the public 50k byte-level ones."""
    if path is None or pattern is None:
        import public_tokenizers as p

        path, pattern = path or p.path("byte_bpe_50k.tiktoken"), pattern or p.PATTERN
    return str(path), pattern


def _with_edits(d: DataFrame, edits: DataFrame, id_col: str) -> DataFrame:
    at = F.struct(*[F.col(c) for c in ("seq", "start", "end", "text")])
    e = edits.groupBy(F.col(f"`{id_col}`").cast("long").alias("eid")).agg(F.array_sort(F.collect_list(at)).alias("edits"))
    one = lambda x: F.struct(x["start"].cast("long").alias("start"), x["end"].cast("long").alias("end"), x["text"].alias("text"))
    return d.join(e, F.col("id") == F.col("eid"), "left").select(*[d[c] for c in d.columns], F.transform("edits", one).alias("edits"))


def build_trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 512, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """id, text, runs and counts per row; ``runs`` holds the characters and tokens of each run.

    Written to a table, it is what :func:`edit_trees` goes on from. Null texts are empty
    and have no runs; rows that repeat have a tree each; an empty table gives an empty
    result. A text of any length is one tree; a run longer than ``least`` comes only from
    text without a safe place to cut, as one very long word.
    """
    ship_package(docs.sparkSession)
    path, pattern = vocabulary(path, pattern)
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return d.mapInArrow(_counted(path, pattern, least, None, True), _TREES)


def edit_trees(trees: DataFrame, edits: DataFrame, least: int = 512, id_col: str = "doc_id", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Trees after edits (id, seq, start, end, text), as :func:`build_trees` gives them.

    Counts of runs that no edit touches are taken from the column; ``chars_encoded_again``
    tells what was encoded. Edits are as in :func:`count_with_edits`.
    """
    ship_package(trees.sparkSession)
    path, pattern = vocabulary(path, pattern)
    d = _with_edits(trees.select("id", "text", "runs"), edits, id_col)
    return d.mapInArrow(_counted(path, pattern, least, None, True), _TREES)


def count_with_edits(docs: DataFrame, edits: DataFrame | Callable | None = None, id_col: str = "doc_id", text_col: str = "text", least: int = 512, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """id, n_tokens, n_edits, n_tokens_edited, n_runs, n_chars, n_chars_edited, chars_encoded_again per row.

    ``edits``: a function from a text to (start, end, replacement) tuples, or a table
    (id, seq, start, end, text) whose rows are applied to the document of that id in the
    order of seq, each to the text that the one before has left; offsets are code points
    and are cut to the text. Without edits the two counts agree. Null texts are empty,
    null replacements too; documents without edits stay; edits of unknown ids are dropped;
    rows that repeat are edited each. Very long texts are one tree each; text without
    spaces is cut where letters, digits and signs meet, and one word of letters is encoded
    whole. An empty table gives an empty result.
    """
    ship_package(docs.sparkSession)
    path, pattern = vocabulary(path, pattern)
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    if isinstance(edits, DataFrame):
        d, edits = _with_edits(d, edits, id_col), None
    return d.mapInArrow(_counted(path, pattern, least, edits, False), _SCHEMA)
