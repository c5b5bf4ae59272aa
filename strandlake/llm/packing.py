"""Packing token sequences by Karmarkar-Karp multiway differencing.

Documents are tokenised and cut once, where they are read; only small piece rows go on.
Pieces that fill a window are windows. The others are gathered, in the task that read
them, into batches of bounded size; in each batch the differencing method merges partial
partitions with opposing imbalances until one is left, which gives near-equal windows.
Where a window would exceed the capacity the number of windows rises and the batch is
partitioned anew. Nothing is shuffled, so no key can be hot.
"""

from __future__ import annotations

import heapq
import json
import os
import zlib
from bisect import insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.textnum import SPACE, Texts, slices, trimmed
from strandlake.plans.session import ship_package

_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]


def multiway_difference(sizes: list[int] | np.ndarray, k: int) -> tuple[np.ndarray, int]:
    """(part of each item, largest sum) of a division of ``sizes`` into ``k`` parts.

    Each item starts as a partial partition with one filled part. The two partial
    partitions with the largest spread are merged, the fullest part of one with the
    emptiest of the other, and only differences to the emptiest part are kept for the
    next choice. Only filled parts are stored, as an ascending list of sums, each with its
    tree of items in one number, so that merges of small partitions cost little.
    """
    n = len(sizes)
    part = np.zeros(n, np.int64)
    if k <= 1 or n == 0:
        return part, int(np.sum(sizes))
    left, right = [], []
    bits = (2 * n).bit_length()  # a number holds a sum and, below it, a tree
    low = (1 << bits) - 1
    heap = [(-int(s), i, [int(s) << bits | i]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    count = made = n
    while len(heap) > 1:
        a = heapq.heappop(heap)[2]
        b = heap[0][2]
        if len(a) < len(b):
            a, b = b, a
        over = len(a) + len(b) - k
        if over <= 0:  # each part of one meets an empty part of the other
            if len(b) == 1:
                insort(a, b[0])
            else:
                a += b
                a.sort()
        else:  # the emptiest filled parts of one meet those of the other in opposite order
            x, y = a[:over], b[over - 1 :: -1]
            left += [v & low for v in x]
            right += [v & low for v in y]
            a = a[over:] + b[over:]
            a += [(v >> bits) + (w >> bits) << bits | t for t, (v, w) in enumerate(zip(x, y, strict=True), made)]
            a.sort()
            made += over
        if len(a) == k and (least := a[0] >> bits << bits):
            a = [v - least for v in a]
        heapq.heapreplace(heap, (-(a[-1] >> bits), count, a))
        count += 1
    for p, root in enumerate(heap[0][2]):
        stack = [root & low]
        while stack:
            x = stack.pop()
            if x < n:
                part[x] = p
            else:
                stack += (left[x - n], right[x - n])
    return part, int(np.bincount(part, weights=sizes, minlength=k).max())


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each item; every window holds ``capacity`` at most, which no item exceeds.

    The first attempt has as few windows as the sum allows, with one in 512 to spare in
    large batches; while the fullest window exceeds the capacity the number rises.
    """
    total = int(np.sum(sizes))
    k = max(1, -(-total // capacity))
    k += k // 512 + (k >= 128)
    while True:
        part, most = multiway_difference(sizes, k)
        if most <= capacity:
            return part
        k += max(1, int(k * (most / capacity - 1) * 0.25))


class WordBpe:
    """Byte-pair merges of many words at once.

    All words are one array of symbols; in each round every unfinished word merges its
    pair of lowest rank, the leftmost of equal ones, and only the two pairs beside the
    merge are looked up again.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list, suffix: str):
        chars = self._alphabet()
        self.inner = np.array([vocabulary.get(chars[i], -1) for i in range(256)], np.int64)
        self.last = np.array([vocabulary.get(chars[i] + suffix, -1) for i in range(256)], np.int64)
        self.base = max(vocabulary.values()) + 2
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in merges]
        keys = np.array([vocabulary[a] * self.base + vocabulary[b] for a, b in pairs], np.int64)
        self.made = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        self.shift = np.uint64(64 - (4 * len(keys)).bit_length())
        slots = (1 << 64 - int(self.shift)) + len(keys)
        self.keys, self.rank = np.full(slots, -1, np.int64), np.full(slots, 1 << 40, np.int64)
        last = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        key, rank = np.array(list(last), np.int64), np.array(list(last.values()), np.int64)
        at = self._slot(key)
        while len(key):  # a key whose slot is taken tries the next one
            free = self.keys[at] < 0
            self.keys[at[free]] = key[free]
            got = self.keys[at] == key
            self.rank[at[got]] = rank[got]
            key, rank, at = key[~got], rank[~got], at[~got] + 1
        if (self.inner < 0).any() or (self.last < 0).any():
            raise ValueError("a byte has no symbol")

    @staticmethod
    def _alphabet() -> list[str]:
        """The printable character that stands for each byte in byte-level vocabularies."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spare = iter(range(256, 512))
        return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.base + b
        at = self._slot(key)
        there = self.keys[at]
        rank = np.where(there == key, self.rank[at], 1 << 40)
        left = np.flatnonzero((there != key) & (there >= 0))
        at = at[left]
        while len(left):  # the slot has another key
            at = at + 1
            there = self.keys[at]
            hit = there == key[left]
            rank[left[hit]] = self.rank[at[hit]]
            more = ~hit & (there >= 0)
            left, at = left[more], at[more]
        return rank

    def encode(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word) of words that lie one after another in ``raw``; none is empty."""
        end = np.cumsum(size) - 1
        sym = self.inner[raw]
        sym[end] = self.last[raw[end]]
        n = len(sym)
        word = np.repeat(np.arange(len(size)), size)
        nxt = np.arange(1, n + 2)
        nxt[end] = n  # n: no symbol
        prev = np.arange(-1, n)
        prev[end - size + 1] = n
        nxt[n] = prev[n] = n
        none, bits = 1 << 40, n.bit_length()
        rank = np.full(n + 1, none, np.int64)
        inside = np.flatnonzero(nxt[:n] < n)
        rank[inside] = self._ranks(sym[inside], sym[inside + 1])
        alive = np.ones(n, bool)
        live = np.flatnonzero(rank < none)
        while len(live):
            w = word[live]  # sorted, since places are
            first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
            at = np.minimum.reduceat((rank[live] << bits) | live, first) & ((1 << bits) - 1)
            right = nxt[at]
            sym[at] = self.made[rank[at]]
            alive[right] = False
            rank[right] = none
            after, before = nxt[right], prev[at]
            nxt[at] = after
            has = after < n
            prev[after[has]] = at[has]
            rank[at] = none
            rank[at[has]] = self._ranks(sym[at[has]], sym[after[has]])
            has = before < n
            rank[before[has]] = self._ranks(sym[before[has]], sym[at[has]])
            live = np.concatenate([live, at, before[has]])  # a merge may give its neighbours a pair that had none
            live = live[rank[live] < none]
            live.sort()
            live = live[np.append(True, live[1:] != live[:-1])] if len(live) else live
        return sym[alive], np.bincount(word[alive], minlength=len(size))


def _strings(data: np.ndarray, size: np.ndarray) -> pa.LargeBinaryArray:
    """Byte strings that lie one after another in ``data``."""
    upto = np.append(0, np.cumsum(size)).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(upto), pa.py_buffer(np.ascontiguousarray(data))])


def _bytes_of(strings: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """(data, size of each) of byte strings, as :func:`_strings` takes them."""
    at = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    return np.frombuffer(strings.buffers()[2], np.uint8)[at[0] : at[-1]], np.diff(at)


def _gather(flat: np.ndarray, size: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs ``which`` of ``flat``, one after another; ``size``: of each run there."""
    count = size[which]
    first = (np.cumsum(size) - size)[which]
    upto = np.cumsum(count)
    return flat[np.repeat(first - (upto - count), count) + np.arange(upto[-1] if len(upto) else 0)]


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes.

    The tokenizer parts words at white space before anything else, so ids of the words
    between ASCII white space join to the ids of the text. Each distinct word of a batch
    is looked at once. Words of Latin letters are folded and parted into pieces here; every
    other word is one piece, as is a word above ``LONGEST`` bytes. Distinct pieces that are
    not known are merged here, many at a time, if they are Latin, else by the tokenizer
    (where merges of long words take a heap and not a round each); ids are the same. A
    call takes words of ``CALL`` bytes (or one longer word). Words and pieces are compared
    by their bytes. About ``remember`` pieces are known at most: above that, those stay
    which have been met again since the last time.
    """

    #: Fixed value: how the tokenizer parts a word.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    CALL, LONGEST = 2 << 20, 256

    def __init__(self, path: str, remember: int = 100_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.remember = remember
        self.forget()
        self.bpe = None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [x.get("type") for x in spec["normalizer"].get("normalizers", [])]
        first = spec["pre_tokenizer"].get("pretokenizers", [{}])[0]
        if steps == ["NFC", "Replace", "Lowercase"] and first.get("pattern", {}).get("Regex") == self.PATTERN and spec["model"].get("end_of_word_suffix"):
            self.bpe = WordBpe(spec["model"]["vocab"], spec["model"]["merges"], spec["model"]["end_of_word_suffix"])

    #: Bytes of words that fold and part alike here and there: ASCII but for apostrophe and less-than sign, and Latin letters of two bytes.
    _EASY = np.zeros(256, bool)
    _EASY[33:127] = _EASY[0x80:0xC0] = _EASY[0xC3] = True
    _EASY[[0x27, 0x3C]] = False
    #: Letters, digits (which stand alone) and other characters.
    _KIND = np.full(256, 3, np.uint8)
    _KIND[97:123] = _KIND[0x80:0xC0] = _KIND[0xC3] = 1
    _KIND[48:58] = 2

    def forget(self) -> None:
        """No piece is known any more."""
        self.known = _strings(np.zeros(0, np.uint8), np.zeros(0, np.int64))
        self.known_ids, self.known_count, self.met = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, bool)

    def _parted(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, first byte of each piece, whether it is merged here) of words that lie one after another in ``raw``."""
        begin = np.cumsum(size) - size
        low = np.frombuffer(raw.tobytes().lower(), np.uint8).copy()
        second = np.append(False, low[:-1] == 0xC3)
        high = (low >= 0x80) & (low < 0xC0)
        hard = ~self._EASY[low] | (second & ((low == 0x97) | (low == 0xB7))) | (high & ~second)
        low[second & high & (low <= 0x9E)] += 0x20
        easy = ~np.logical_or.reduceat(hard, begin) & (size <= self.LONGEST) if self.bpe is not None else np.zeros(len(size), bool)
        inside = np.repeat(easy, size)
        kind = self._KIND[low]
        starts = np.append(True, kind[1:] != kind[:-1]) | (kind == 2)
        starts &= inside
        starts[begin] = True
        at = np.flatnonzero(starts)
        return np.where(inside, low, raw), at, inside[at]

    def _learn(self, pieces: pa.LargeBinaryArray, easy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each piece); ``easy``: whether it is merged here."""
        count = np.zeros(len(pieces), np.int64)
        mine, theirs = np.zeros(0, np.int64), []
        if easy.any():
            mine, count[easy] = self.bpe.encode(*_bytes_of(pieces.filter(pa.array(easy))))
        rest = [x.decode() for x in pieces.filter(pa.array(~easy)).to_pylist()]
        for i in range(0, len(rest), 4096):
            theirs += [e.ids for e in self.tokenizer.encode_batch(rest[i : i + 4096], add_special_tokens=False)]
        count[~easy] = np.fromiter(map(len, theirs), np.int64, len(theirs))
        here = np.repeat(easy, count)
        ids = np.empty(len(here), "<u4")
        ids[here] = mine
        ids[~here] = np.fromiter(chain.from_iterable(theirs), "<u4", len(here) - len(mine))
        return ids, count

    def _keep(self, pieces: pa.LargeBinaryArray, ids: np.ndarray, count: np.ndarray) -> None:
        if len(self.known) > self.remember:
            if self.met.sum() > self.remember:
                self.forget()
            self.known_ids, self.known_count = self.known_ids[np.repeat(self.met, self.known_count)], self.known_count[self.met]
            self.known = self.known.filter(pa.array(self.met))
            self.met = np.zeros(len(self.known), bool)
        short = pa.compute.binary_length(pieces).to_numpy(zero_copy_only=False) <= 64
        self.known = pa.concat_arrays([self.known, pieces.filter(pa.array(short))])
        self.known_ids = np.append(self.known_ids, ids[np.repeat(short, count)])
        self.known_count = np.append(self.known_count, count[short])
        self.met = np.append(self.met, np.zeros(int(short.sum()), bool))

    def _words(self, words: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word)."""
        raw, size = _bytes_of(words)
        data, at, here = self._parted(raw, size)
        coded = _strings(data, np.diff(np.append(at, len(data)))).dictionary_encode()
        pieces, which = coded.dictionary, coded.indices.to_numpy()
        easy = np.zeros(len(pieces), bool)
        easy[which] = here
        place = pa.compute.index_in(pieces, value_set=self.known).fill_null(-1).to_numpy().astype(np.int64)
        new = place < 0
        self.met[place[~new]] = True
        missing = pieces.filter(pa.array(new))
        ids, count = self._learn(missing, easy[new])
        place[new] = len(self.known_count) + np.arange(len(missing))
        flat, sizes = np.append(self.known_ids, ids), np.append(self.known_count, count)
        self._keep(missing, ids, count)
        place = place[which]
        word = np.searchsorted(np.cumsum(size), at, "right")
        return _gather(flat, sizes, place), np.bincount(word, weights=sizes[place], minlength=len(size)).astype(np.int64)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        t = Texts(texts)
        t.words()
        if not len(t.word_start):
            return [b""] * t.n
        coded = _strings(np.frombuffer(t.data.translate(None, SPACE), np.uint8), t.word_end - t.word_start).dictionary_encode()
        words, which = coded.dictionary, coded.indices.to_numpy()
        upto = np.cumsum(pa.compute.binary_length(words).to_numpy())
        got, i = [], 0
        while i < len(words):
            j = int(np.searchsorted(upto, (upto[i - 1] if i else 0) + self.CALL, "right"))
            j = max(i + 1, min(j, i + 100_000))
            got.append(self._words(words[i:j]))
            i = j
        size = np.concatenate([c for _, c in got])
        ids = _gather(np.concatenate([x for x, _ in got]), size, which)
        edge = np.append(0, np.cumsum(size[which]))[t.words_from].tolist()
        return [ids[a:b].tobytes() for a, b in zip(edge, edge[1:], strict=False)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces_of(ids: bytes, capacity: int, longest: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, crc32) of a document's pieces: full windows first, then what is left, in pieces of ``longest`` at most."""
    n, at = len(ids) // 4, 0
    while n - at >= capacity:
        yield at, capacity, zlib.crc32(ids[4 * at : 4 * (at + capacity)])
        at += capacity
    while at < n:
        size = min(n - at, longest)
        yield at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])
        at += size


def _packer(path: str, end_id: int, capacity: int, longest: int, batch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end = np.array([end_id], "<u4").tobytes()
        base, window = TaskContext.get().partitionId() << 36, 0
        held: list[tuple] = []
        done: list[tuple] = []

        def close() -> None:
            nonlocal window
            if not held:
                return
            part = pack(np.array([p[2] for p in held], np.int64), capacity)
            used = np.zeros(int(part.max()) + 1, np.int64)
            for p, w in zip(held, part.tolist(), strict=True):
                done.append((*p, base + window + w, int(used[w])))
                used[w] += p[2]
            window += len(used)
            held.clear()

        def out() -> pa.RecordBatch:
            cols = list(zip(*done, strict=True)) or [()] * len(_NAMES)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=_NAMES)

        for b in slices(batches, 1, 1 << 20):
            ids = b.column(0).to_pylist()
            for doc, raw in zip(ids, enc.encode(b.column(1).to_pylist()), strict=True):
                raw += end
                n = len(raw) // 4
                for start, length, crc in pieces_of(raw, capacity, longest):
                    if length == capacity:
                        done.append((doc, start, length, crc, n, base + window, 0))
                        window += 1
                    else:
                        held.append((doc, start, length, crc, n))
                if len(held) >= batch:
                    close()
            if len(done) >= 4096:
                yield out()
        close()
        yield out()
        enc.forget()

    return trimmed(run)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, capacity: int = 4096, longest: int = 1024, batch: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer``: path of a tokenizers file whose pre-tokenizer parts words at white
    space (by default the public 49k word vocabulary). ``longest``: what is left of a
    document after its full windows is cut into pieces of so many tokens at most.
    ``batch``: so many pieces are partitioned together, which bounds the memory of a task.
    Whole texts are encoded, in time that grows as n log n with a word's length at most; a
    task holds the ids of about a megabyte of texts, or of one longer text.
    A null text is empty and gives one piece with the end id alone. Rows that repeat are
    packed again each; a null id stays null. An empty table gives an empty result.
    Sequence ids hold the partition's number in their upper bits.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    ship_package(docs.sparkSession)
    run = _packer(str(tokenizer), end_id, capacity, min(longest, capacity), batch)
    return docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")).mapInArrow(run, _SCHEMA)
