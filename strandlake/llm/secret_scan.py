"""Secret scans: a linear-chain conditional random field.

Tokens are runs of the characters that keys are made of, so every word of a text is a
position of the chain. The field tags each as begin (B), inside (I) or outside (O) of a
secret from its shape, the words and characters beside it and features of the whole
file; Viterbi gives the best sequence. All scores are computed for every token, as array
operations. A token whose O beats its other labels by more than any transition could make
up for is O in every best sequence, so the chain falls apart there and only what lies
between such tokens is decoded, with the result of the whole chain. Fixed patterns give
base spans, which always stay.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.textnum import Texts, slices
from strandlake.plans.session import ship_package

#: The base patterns, the strings they can start with and the least lengths.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
ASSIGN_STARTS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "crf")
#: Words that stand before keys, words that stand before other codes, and how usual keys begin.
KEY_WORDS = "password passwd pwd pass passphrase secret token key apikey api_key access_key secret_key client_secret auth_token access_token auth authorization bearer credential credentials private signature session cookie jwt".split()
CODE_WORDS = "commit revision version build isbn uuid id phone tel fax order invoice date page http https www mail doi sha checksum serial".split()
LINK_WORDS = "is was set to be are the my your new".split()
PREFIXES = ("ghp_", "gho_", "github_pat_", "xoxb-", "xoxp-", "sk_live_", "sk-", "pk_live_", "eyJ", "AIza", "ASIA", "glpat-", "npm_", "SG.", "ya29.")


def _no_overlap(pattern: re.Pattern, data: bytes, at: list[int]) -> Iterator[re.Match]:
    """Leftmost non-overlapping matches, given all positions where one can start."""
    end = 0
    for p in at:
        if p >= end and (m := pattern.match(data, p)):
            end = m.end()
            yield m


def _find(data: bytes, what: bytes) -> list[int]:
    out, p = [], data.find(what)
    while p >= 0:
        out.append(p)
        p = data.find(what, p + 1)
    return out


_LOWER, _UPPER, _DIGIT, _BEYOND_HEX, _PLUS, _SLASH, _DOT, _DASH = (1 << i for i in range(8))
_CLASS = np.zeros(256, np.uint8)
for _chars, _bit in ((b"abcdefghijklmnopqrstuvwxyz", _LOWER), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER), (b"0123456789", _DIGIT), (b"ghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ", _BEYOND_HEX), (b"+_", _PLUS), (b"/", _SLASH), (b".", _DOT), (b"-", _DASH)):
    _CLASS[list(_chars)] |= _bit
_ALNUM = (_CLASS & (_LOWER | _UPPER | _DIGIT)) > 0
_VOWEL = np.zeros(256, bool)
_VOWEL[list(b"aeiouyAEIOUY")] = True


def tokens_of(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (start, end) of all tokens; a dot belongs to one only between letters or digits."""
    inside = np.zeros(len(t.buf) + 1, bool)
    inside[1:] = _CLASS[t.buf] > 0
    dots = np.flatnonzero(t.buf == 46)
    near = _ALNUM[t.buf]
    inside[dots + 1] = near[np.maximum(dots - 1, 0)] & near[np.minimum(dots + 1, len(t.buf) - 1)]
    step = np.flatnonzero(inside[1:] != inside[:-1])
    return step[0::2], step[1::2]


def base_spans(t: Texts, tokens: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of the batch, sorted."""
    low = t.data.lower()
    at = sorted({p for s in ASSIGN_STARTS for p in _find(low, s)})
    found = [(m.start(), 0, m.end()) for m in _no_overlap(ASSIGN, t.data, at) if len(m.group(2)) >= ASSIGN_LEAST]
    found += [(m.start(), 1, m.end()) for m in _no_overlap(ACCESS, t.data, _find(t.data, b"AKIA")) if m.end() - m.start() >= ACCESS_LEAST]
    wide = tokens[1] - tokens[0] >= HEX_LEAST  # such a run of hex digits lies in one token
    for s, e in zip(tokens[0][wide].tolist(), tokens[1][wide].tolist(), strict=True):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(t.data, s, e) if m.end() - m.start() >= HEX_LEAST]
    return sorted(found)


# --- the field --------------------------------------------------------------------

LABELS = ("O", "B", "I")
#: Least lengths, least changes between lower case, upper case, digits and signs, and the bits of each code.
_LENGTHS, _CHANGES = (0, 4, 6, 8, 12, 16, 20, 32), (0, 1, 2, 4)
_SHAPE = ("lower", "upper", "digit", "beyond_hex", "plus", "slash", "dot", "dash")
_FORM = ("title", "few_vowels", "prefix", "uuid")
_AROUND = ("prev_key", "prev_code", "prev2_key", "prev_link", "after_eq", "after_colon", "quoted", "after_at", "before_at", "line_start", "line_end", "close", "wide")
_FILE = ("file_keys", "file_code", "file_pem", "file_dense")


def _feature_names() -> list[str]:
    """Every feature that some code can have."""
    shape = [f"len{k}" for k in _LENGTHS] + [f"changes{k}" for k in _CHANGES]
    pairs = [f"long_{x}" for x in ("digit", "mixed", "changes")] + ["digits_only", "word", "upper_word", "alnum_mix", "hex", "short_changes"]
    keyed = ["key_changes", "key_digit", "key_word", "link_changes", "link_digit"]
    return ["bias", *shape, *_SHAPE, *pairs, *_FORM, *_AROUND, "marked", *keyed, *_FILE]


FEATURES = {n: i for i, n in enumerate(_feature_names())}


def _shape_features(code: int) -> list[str]:
    """Of class bits (8), length class (3) and change class (2)."""
    bits, size, changes = code & 255, _LENGTHS[code >> 8 & 7], _CHANGES[code >> 11]
    out = ["bias", f"len{size}", f"changes{changes}", *(n for i, n in enumerate(_SHAPE) if bits >> i & 1)]
    letters, digit = bits & (_LOWER | _UPPER), bits & _DIGIT
    out += ["digits_only"] * (bits == _DIGIT) + ["word"] * (bits in (_LOWER, _LOWER | _BEYOND_HEX)) + ["upper_word"] * (bits in (_UPPER, _UPPER | _BEYOND_HEX))
    out += ["alnum_mix"] * bool(letters and digit) + ["hex"] * bool(digit and not bits & ~(_DIGIT | _LOWER) and not bits & _BEYOND_HEX)
    if size >= 16:
        out += ["long_digit"] * bool(digit) + ["long_mixed"] * (letters == _LOWER | _UPPER) + ["long_changes"] * (changes >= 4)
    return out + ["short_changes"] * (size < 8 and changes >= 2)


def _around_features(code: int) -> list[str]:
    """Of the signs beside a token (13) with its changes (1) and digits (1), as both matter together."""
    out = [n for i, n in enumerate(_AROUND) if code >> i & 1]
    changes, digit = code >> 13 & 1, code >> 14 & 1
    marked = any(x in out for x in ("after_eq", "after_colon", "quoted"))
    out += ["marked"] * marked
    if "prev_key" in out or "prev2_key" in out and marked:
        out += ["key_changes"] * changes + ["key_digit"] * digit + ["key_word"] * (not changes and not digit)
    if "prev2_key" in out and "prev_link" in out:
        out += ["link_changes"] * changes + ["link_digit"] * digit
    return out


def _bits(code: int, names: tuple[str, ...]) -> list[str]:
    return [n for i, n in enumerate(names) if code >> i & 1]


def _matrix(rows: list[list[str]]) -> np.ndarray:
    m = np.zeros((len(rows), len(FEATURES)), np.float32)
    for i, r in enumerate(rows):
        m[i, [FEATURES[f] for f in r]] = 1
    return m


@lru_cache(maxsize=1)
def code_tables() -> list[np.ndarray]:
    """For each of the four codes of a token, the features of each of its values."""
    return [
        _matrix([_shape_features(c) for c in range(1 << 13)]),
        _matrix([_around_features(c) for c in range(1 << 15)]),
        _matrix([_bits(c, _FORM) for c in range(1 << len(_FORM))]),
        _matrix([_bits(c, _FILE) for c in range(1 << len(_FILE))]),
    ]


def _hashes(words: list[str]) -> np.ndarray:
    t = Texts(words)
    t.words()
    return np.sort(t.word_hashes(fold=True))


@lru_cache(maxsize=1)
def _word_sets() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _hashes(KEY_WORDS), _hashes(CODE_WORDS), _hashes(LINK_WORDS)


def _among(h: np.ndarray, of: np.ndarray) -> np.ndarray:
    return of[np.minimum(np.searchsorted(of, h), len(of) - 1)] == h


def codes(t: Texts, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text of each token, its four codes), computed for all tokens of all texts at once."""
    n = len(start)
    doc = np.searchsorted(t.ends, start, "left")
    out = np.zeros((4, n), np.int64)
    if not n:
        return doc, out
    buf, size = t.buf, end - start
    cls = _CLASS[buf]
    kind = cls & ~np.uint8(_BEYOND_HEX)
    pairs = np.column_stack([start, end]).reshape(-1)
    bits = np.bitwise_or.reduceat(cls, pairs)[::2].astype(np.int64)
    run = np.zeros(len(buf) + 1, np.int32)
    upto = lambda x: np.cumsum(x, out=run[1:], dtype=np.int32)
    upto(np.append(False, kind[1:] != kind[:-1]))
    changes = run[end] - run[start + 1]
    upto(kind == _UPPER)
    uppers = run[end] - run[start]
    title = (uppers == 1) & (kind[start] == _UPPER)
    changes = changes - title  # a capital first letter is no change of its own
    upto(_VOWEL[buf])
    vowels = run[end] - run[start]
    lengths, steps = np.searchsorted(_LENGTHS, size, "right") - 1, np.searchsorted(_CHANGES, np.maximum(changes, 0), "right") - 1
    out[0] = bits | (lengths << 8) | (steps << 11)

    t.word_start, t.word_end = start, end
    h = t.word_hashes(fold=True)
    key, code, link = (_among(h, s) for s in _word_sets())
    key |= _ends_in_key(t, start, end, size)
    first = np.append(True, doc[1:] != doc[:-1])
    back = lambda x, k=1: np.append(np.zeros(min(k, n), bool), x[:-k]) if k <= n else np.zeros(n, bool)
    prev = ~first
    prev2 = prev & back(prev)
    begin, stop = t.starts[doc], t.ends[doc]
    at = lambda p: np.where(p >= begin, buf[np.maximum(p, 0)], 10)
    b1, b2, b3 = at(start - 1), at(start - 2), at(start - 3)
    after = np.where(end < stop, buf[end], 10)
    mark = np.isin(b1, (32, 9, 34, 39, 96))
    bare = np.where(mark, b2, b1)
    mark = mark & np.isin(b2, (32, 9, 34, 39, 96))
    bare = np.where(mark, b3, bare)
    gap = start - np.append(0, end[:-1])
    quote = np.isin(b1, (34, 39, 96))
    signs = [prev & back(key), prev & back(code), prev2 & back(key, 2), prev & back(link), bare == 61, bare == 58, quote & (after == b1), b1 == 64, after == 64, b1 == 10, after == 10, prev & (gap <= 2), (b1 >= 128) | (after >= 128)]
    digit = (bits & _DIGIT) > 0
    out[1] = sum((x.astype(np.int64) << i for i, x in enumerate([*signs, changes >= 2, digit])), np.zeros(n, np.int64))

    head = np.zeros(n, np.int64)
    for k in range(3):
        head = head * 256 + np.where(start + k < end, buf[np.minimum(start + k, len(buf) - 1)], 0)
    prefix = np.isin(head, [int.from_bytes(p[:3].encode(), "big") for p in PREFIXES]) & (size >= 12)
    uuid = (size == 36) & ((bits & _DASH) > 0) & ((bits & _BEYOND_HEX) == 0)
    few = (vowels * 5 < size) & ((bits & (_LOWER | _UPPER)) > 0)
    out[2] = sum((x.astype(np.int64) << i for i, x in enumerate([title, few, prefix, uuid])), np.zeros(n, np.int64))

    per = lambda x: np.bincount(doc[x], minlength=t.n)
    signs_at = np.flatnonzero((buf == 61) | (buf == 123) | (buf == 59))
    in_code = np.bincount(np.searchsorted(t.ends, signs_at, "left"), minlength=t.n)
    pem = np.bincount(np.searchsorted(t.ends, _find(t.data, b"-----BEGIN"), "left").astype(np.int64), minlength=t.n)[: t.n]
    length = t.ends - t.starts
    file = (per(key) > 0) | ((in_code * 100 > length).astype(np.int64) << 1) | ((pem > 0).astype(np.int64) << 2) | ((per((size >= 16) & digit) * 60 > length).astype(np.int64) << 3)
    out[3] = file[doc]
    return doc, out


def _ends_in_key(t: Texts, start: np.ndarray, end: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Tokens of several words, the last of which stands before keys, as ``db_password``."""
    out = np.zeros(len(start), bool)
    for w in (b"password", b"_token", b"_secret", b"_key"):
        some = np.flatnonzero(size > len(w))
        for k, c in enumerate(w):
            some = some[(t.buf[end[some] - len(w) + k] | 32 if c != 95 else t.buf[end[some] - len(w) + k]) == c]
        out[some] = True
    return out


class Field:
    """Weights (features by labels) and transitions (labels by labels); O stands before and after a text."""

    def __init__(self, w: np.ndarray, trans: np.ndarray):
        self.w, self.trans = w, trans
        self.tables = None

    def emissions(self, found: np.ndarray) -> np.ndarray:
        """Scores (tokens by labels) of the codes of tokens."""
        if self.tables is None:
            self.tables = [m @ self.w for m in code_tables()]
        return sum(t[c] for t, c in zip(self.tables, found, strict=True))

    def viterbi(self, e: np.ndarray) -> list[int]:
        v = self.trans[0] + e[0]
        back = []
        for x in e[1:]:
            m = v[:, None] + self.trans
            back.append(m.argmax(0))
            v = m.max(0) + x
        y = [int((v + self.trans[:, 0]).argmax())]
        for b in reversed(back):
            y.append(int(b[y[-1]]))
        return y[::-1]

    def most_gain(self) -> float:
        """The most that transitions can win when a token is B or I and not O.

        The token's label y becomes O; an I after it, which O may not precede, becomes B.
        """
        t, best = self.trans, 0.0
        for a, y, c, d in product(range(3), (1, 2), range(3), range(3)):
            if a == 0 and y == 2 or c == 0 and d == 2:
                continue
            old, new = t[a, y] + t[y, c], t[a, 0] + t[0, min(c, 1)]
            if c == 2:
                old, new = old + t[2, d], new + t[1, d]
            best = max(best, old - new)
        return best

    def labels(self, doc: np.ndarray, e: np.ndarray) -> np.ndarray:
        """The best label of every token of every text.

        With m the margin of a token's O and d what the next token would lose as B and not
        I, a token with m + min(0, d) above :meth:`most_gain` is O in any best sequence:
        changing it, and an I after it, would win.
        """
        n = len(e)
        out = np.zeros(n, np.int64)
        if not n:
            return out
        lose = np.append(e[1:, 1] - e[1:, 2], 0.0)
        lose[np.append(doc[1:] != doc[:-1], True)] = 0
        sure = e[:, 0] - e[:, 1:].max(1) + np.minimum(0, lose) > self.most_gain() + 1e-9
        open_ = np.flatnonzero(~sure)
        if not len(open_):
            return out
        new = np.append(True, (np.diff(open_) > 1) | (doc[open_[1:]] != doc[open_[:-1]]))
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(open_)))
        one = open_[begin[size == 1]]
        out[one] = (e[one] + self.trans[0] + self.trans[:, 0]).argmax(1)
        for b, k in zip(begin[size > 1].tolist(), size[size > 1].tolist(), strict=True):
            some = open_[b : b + k]
            out[some] = self.viterbi(e[some])
        return out


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)


class _Batch:
    """Chains of like length, padded at the end."""

    def __init__(self, chains: list[tuple[np.ndarray, np.ndarray]]):
        tables, k = code_tables(), len(FEATURES)
        size, longest = len(chains), max(len(y) for _, y in chains)
        self.shape = (size, longest, 3)
        feats = np.zeros((size, longest, k), np.float32)
        self.gold, self.mask = np.zeros((size, longest), np.int64), np.zeros((size, longest), bool)
        for i, (found, y) in enumerate(chains):
            feats[i, : len(y)] = sum(m[c] for m, c in zip(tables, found, strict=True))
            self.gold[i, : len(y)], self.mask[i, : len(y)] = y, True
        self.flat, self.rows, self.lasts = feats.reshape(-1, k), np.arange(size), self.mask.sum(1) - 1
        both = self.mask[:, 1:]
        self.counts = np.zeros((3, 3))
        np.add.at(self.counts, (self.gold[:, :-1][both], self.gold[:, 1:][both]), 1)
        np.add.at(self.counts, (np.zeros(size, int), self.gold[:, 0]), 1)
        np.add.at(self.counts, (self.gold[self.rows, self.lasts], np.zeros(size, int)), 1)

    def gradients(self, w: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Observed less expected counts of features and transitions, by forward-backward."""
        _, longest, _ = self.shape
        mask = self.mask
        e = (self.flat @ w.astype(np.float32)).reshape(self.shape).astype(float)
        a, b = np.zeros_like(e), np.zeros_like(e)
        a[:, 0] = t[0] + e[:, 0]
        for i in range(1, longest):
            go = _log_sum(a[:, i - 1, :, None] + t, 1) + e[:, i]
            a[:, i] = np.where(mask[:, i, None], go, a[:, i - 1])
        z = _log_sum(a[:, -1] + t[:, 0], 1)
        b[:, -1] = t[:, 0]
        for i in range(longest - 2, -1, -1):
            go = _log_sum(t + (e[:, i + 1] + b[:, i + 1])[:, None, :], 2)
            b[:, i] = np.where(mask[:, i + 1, None], go, t[:, 0])
        p = np.exp(a + b - z[:, None, None]) * mask[..., None]
        pair = np.exp(a[:, :-1, :, None] + t + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
        dt = self.counts - pair.sum((0, 1))
        dt[0] -= p[:, 0].sum(0)
        dt[:, 0] -= p[self.rows, self.lasts].sum(0)
        return self.flat.T @ (np.eye(3)[self.gold] * mask[..., None] - p).reshape(-1, 3).astype(np.float32), dt


def fit(chains: list[tuple[np.ndarray, np.ndarray]], rounds: int = 80, rate: float = 0.3, decay: float = 2e-3) -> Field:
    """Maximum likelihood by forward-backward and AdaGrad over (codes, labels) of texts; I after O is not admitted."""
    order = sorted((c for c in chains if len(c[1])), key=lambda c: len(c[1]))
    step = -(-len(order) // 8)
    batches = [_Batch(order[i : i + step]) for i in range(0, len(order), step)]
    w, t = np.zeros((len(FEATURES), 3)), np.zeros((3, 3))
    t[0, 2] = -1e4
    gw, gt = np.full_like(w, 1e-3), np.full_like(t, 1e-3)
    for _ in range(rounds):
        found = [b.gradients(w, t) for b in batches]
        dw, dt = sum(x for x, _ in found) - decay * w * len(order) / 10, sum(x for _, x in found)
        gw += dw**2
        gt += dt**2
        w, t = w + rate * dw / np.sqrt(gw), t + rate * dt / np.sqrt(gt)
        t[0, 2] = -1e4
    return Field(w, t)


def _synthetic(n: int, seed: int) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Texts with the spans of the secrets in them, made from a seed."""
    rng = np.random.default_rng(seed)
    alpha = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    pick = lambda s, k: "".join(s[i] for i in rng.integers(0, len(s), k))
    num = lambda a, b: int(rng.integers(a, b))
    one = lambda s: s[num(0, len(s))]
    low, hexa, b64, vowels, rest = alpha[26:], "0123456789abcdef", alpha + "0123456789+/", "aeiou", "bcdfghklmnprstvw"

    def word() -> str:
        return "".join(one(rest) + one(vowels) + (one(rest) if num(0, 3) == 0 else "") for _ in range(num(1, 5)))

    def prose() -> str:
        w = word()
        w = w.title() if num(0, 8) == 0 else w.upper() if num(0, 30) == 0 else w
        w += "-" + word() if num(0, 40) == 0 else "'s" if num(0, 40) == 0 else ""
        return w + one(["", "", "", "", "", ",", ".", ":", ";", "!"])

    def camel() -> str:
        return "".join(word().title() for _ in range(num(2, 5)))

    def spoilt() -> str:
        """A word with capitals, digits or signs in it, as people make up passwords."""
        w = word() + word()
        w = w[0].upper() + w[1:] if num(0, 2) else w
        w = w.replace(one(vowels), one("0134"), 1) if num(0, 2) else w
        return w + (pick("0123456789", num(1, 5)) if num(0, 5) else "X" + pick("0123456789", 2))

    filler = lambda: " ".join(prose() for _ in range(num(1, 14)))
    key = lambda: pick(alpha + "0123456789", num(20, 44)) + pick("0123456789", 2)
    names = ["password", "token", "secret", "api_key", "auth", "bearer", "client_secret", "key", "credential", "passwd", "pwd", "db_password", "access_token"]
    good = [
        lambda: (f'{one(names)} {one("=:")} "', key(), '"'),
        lambda: ("Authorization: Bearer ", "eyJ" + pick(b64, 30) + "." + pick(b64, 40) + "." + pick(b64, 30), ""),
        lambda: ("", one(PREFIXES[:6]) + key(), " "),
        lambda: (f"{one(names)}=", pick(b64, 40) + one(["", "=", "=="]), " "),
        lambda: (f"use {one(names)} ", pick(low, 4).title() + pick("0123456789", 4) + pick(alpha, 6), " "),
        lambda: ("AWS ", pick(alpha[:26] + "0123456789", 18) + "7Q", " "),
        lambda: ("", "sk_live_" + key(), ""),
        lambda: ('"', pick(b64, 44), '"'),
        lambda: (f"{one(names[:1] + names[9:12])} ", spoilt(), " "),
        lambda: (f"{one(names[:1] + names[9:12])} {one(LINK_WORDS[:3])} ", one([spoilt, camel])(), " "),
        lambda: (f"{one(names)}{one([': ', '=', ' = '])}", one([spoilt, camel])(), " "),
        lambda: (f"{one(names)} {one(LINK_WORDS[:3])} ", key(), " "),
    ]
    bad = [
        lambda: pick("0123456789", num(1, 20)),
        lambda: f"{num(1900, 2030)}-{num(10, 13)}-{num(10, 29)}",
        lambda: f"+{num(1, 99)}-{num(100, 999)}-{num(1000, 9999)}",
        lambda: f"{word()}.{num(1, 99)}@{word()}{num(1, 9)}.example.com",
        lambda: f"https://{word()}.example.org/{word()}/{word()}-{num(1, 9999)}?page={num(1, 9)}",
        lambda: f"{num(1, 255)}.{num(1, 255)}.{num(1, 255)}.{num(1, 255)}",
        lambda: f"version {num(1, 20)}.{num(0, 20)}.{num(0, 2000)}-beta{num(1, 9)}",
        lambda: f"uuid {pick(hexa, 8)}-{pick(hexa, 4)}-{pick(hexa, 4)}-{pick(hexa, 4)}-{pick(hexa, 12)}",
        lambda: f"commit {pick(hexa, num(8, 20))}1",
        lambda: "".join(word() for _ in range(6)),
        lambda: "-".join(word() for _ in range(num(4, 7))),
        lambda: f"{word()}/{word()}/{word()}/{word()}_{num(1, 99)}.txt",
        lambda: f"ISBN {num(900, 999)}-{num(0, 9)}-{num(100, 999)}-{num(10000, 99999)}-{num(0, 9)}",
        lambda: f"{word()}{num(1, 999)}{word()}",
        lambda: f"{word()}{num(1, 99)}",
        lambda: pick("*=-_.", 1) * num(3, 60),
        lambda: f"{num(1000, 9999)}-{num(1000, 9999)}-{num(1000, 9999)}-{num(1000, 9999)}",
        lambda: f"{pick(alpha[:26], 2)}{pick('0123456789', num(14, 22))}",
        lambda: f"{one(names)} {one(LINK_WORDS)} {word()} {word()}",
        lambda: f"{one(names)} {word()} {word()}",
        lambda: f"{one(names)}s, {word()}, {one(names)}. {word().title()} {word()}",
        lambda: f"{one(names)}: {word()} {word()}",
        lambda: f"{one(names)} {num(1, 99)}",
        camel,
        lambda: f"{camel()}.{word()}({word()}_{word()}, {num(0, 99)});",
        lambda: f"{num(1, 99)}.{num(1, 99)} {word()} {num(1, 9999)}",
        lambda: "".join(rng.choice(list("éèüßñçåø"), 1)) + word(),
    ]
    for _ in range(n):
        text, spans = filler() + " ", []
        for _ in range(num(1, 5)):
            kind = num(0, 10)
            if kind < 4:
                a, s, z = one(good)()
                spans.append((len(text) + len(a), len(text) + len(a) + len(s)))
                text += a + s + z + " "
            elif kind == 4:
                text += "-----BEGIN PRIVATE KEY-----\n"
                for _ in range(num(2, 6)):
                    s = pick(b64, 62) + "9x"
                    spans.append((len(text), len(text) + len(s)))
                    text += s + "\n"
            else:
                text += one(bad)() + " "
            text += filler() + (" " if num(0, 4) else "\n")
        yield text, spans


@lru_cache(maxsize=2)
def trained(n: int = 500, seed: int = 2) -> Field:
    """The field fitted on ``n`` synthetic texts; a secret is B, and lines of a key block that follow one another are I."""
    chains = []
    for text, spans in _synthetic(n, seed):
        t = Texts([text])
        start, end = tokens_of(t)
        _, found = codes(t, start, end)
        place = np.append(0, np.cumsum([len(c.encode()) for c in text]))  # byte offsets of characters
        y, last = [], None
        for s, e in zip(start.tolist(), end.tolist(), strict=True):
            hit = next((i for i, (a, b) in enumerate(spans) if place[a] < e and s < place[b]), None)
            y.append(0 if hit is None else 2 if last is not None and (hit == last or hit == last + 1 and spans[last][1] + 1 == spans[hit][0]) else 1)
            last = hit
        chains.append((found, np.array(y)))
    return fit(chains)


def groups_of(label: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) token of each secret that the field tags: a B and the I that follow it."""
    out: list[tuple[int, int]] = []
    some = np.flatnonzero(label)
    for i, y in zip(some.tolist(), label[some].tolist(), strict=True):
        if y == 2 and out and out[-1][1] == i - 1:
            out[-1] = (out[-1][0], i)
        else:
            out.append((i, i))
    return out


def apart(group: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Spans of the tokens of a group that touch no base span; tokens that follow one another are one span."""
    start = end = None
    for s, e in group:
        if any(a < e and s < b for a, _, b in base):
            if start is not None:
                yield start, end
            start = None
        else:
            start, end = s if start is None else start, e
    if start is not None:
        yield start, end


def scan(texts: list[str | None], field: Field) -> tuple[list[list[tuple[int, int, int]]], list[list[tuple[int, int]]]]:
    """(spans, tags) of each text in code points: spans (start, kind, end), kinds number KINDS; tags (start, end).

    Tags are all that the field finds. Those of its tokens that touch no base span are
    spans of their own kind; the others are covered by that base span already.
    """
    t = Texts(texts)
    start, end = tokens_of(t)
    base = base_spans(t, (start, end))
    doc, found = codes(t, start, end)
    label = field.labels(doc, field.emissions(found))
    spans: list[list] = [[] for _ in range(t.n)]
    tags: list[list] = [[] for _ in range(t.n)]
    of = lambda places: np.searchsorted(t.ends, places, "left").tolist() if places else []
    for (s, k, e), d in zip(base, of([s for s, _, _ in base]), strict=True):
        spans[d].append((s, k, e))
    fixed = [list(x) for x in spans]
    groups = groups_of(label)
    for (i, j), d in zip(groups, of([int(start[i]) for i, _ in groups]), strict=True):
        group = list(zip(start[i : j + 1].tolist(), end[i : j + 1].tolist(), strict=True))
        tags[d].append((group[0][0], group[-1][1]))
        near = _near(fixed[d], group[0][0], group[-1][1])
        spans[d] += [(s, 3, e) for s, e in apart(group, near)]
    for d in range(t.n):
        if not spans[d] and not tags[d]:
            continue
        first = int(t.starts[d])
        place = lambda p: p - first  # noqa: B023, E731
        raw = t.data[first : int(t.ends[d])]
        if not raw.isascii():
            ahead = np.zeros(len(raw) + 1, np.int64)
            np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, out=ahead[1:])
            place = lambda p: int(ahead[p - first])  # noqa: B023, E731
        spans[d] = sorted((place(s), k, place(e)) for s, k, e in spans[d])
        tags[d] = [(place(s), place(e)) for s, e in tags[d]]
    return spans, tags


def _near(base: list[tuple[int, int, int]], start: int, end: int) -> list[tuple[int, int, int]]:
    """The base spans of a sorted list that can touch a stretch; each kind's do not overlap, so few begin before it."""
    lo = bisect_left(base, (start, -1, -1))
    back = lo
    kinds = {0, 1, 2}
    while back and kinds:
        back -= 1
        kinds.discard(base[back][1])
    return base[back : bisect_left(base, (end, -1, -1))]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_SCHEMA = "id long, spans array<struct<kind:string,start:long,end:long>>, n_assign long, n_access long, n_hex long, n_crf long, base_sha256 string, span_list string, n_tagged long, tag_list string"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """id, spans, n_assign, n_access, n_hex, n_crf, base_sha256, span_list, n_tagged, tag_list for each row.

    Offsets are code points, ends exclusive; ``span_list`` is kind:start:end by start,
    then kind, joined by commas. ``tag_list`` holds what the field alone tags, whether a
    base span covers it or not. Null texts are empty; rows that repeat are scanned each; a
    null id stays null; other columns are not read. Texts are scanned whole, however long:
    a task holds about a hundred bytes for each of a text. An empty table gives an empty
    result.
    """
    ship_package(docs.sparkSession)
    field = field or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            found, tags = scan(b.column(1).to_pylist(), field)
            n = [[sum(k == i for _, k, _ in f) for f in found] for i in range(4)]
            base = [hashlib.sha256(joined([x for x in f if x[1] < 3]).encode()).hexdigest() for f in found]
            rows = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in f] for f in found]
            cols = [pa.array(rows, _SPAN), *(pa.array(x, pa.int64()) for x in n), pa.array(base, pa.string()), pa.array([joined(f) for f in found], pa.string()), pa.array([len(x) for x in tags], pa.int64()), pa.array([joined([(s, 3, e) for s, e in x]) for x in tags], pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["id", "spans", "n_assign", "n_access", "n_hex", "n_crf", "base_sha256", "span_list", "n_tagged", "tag_list"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, _SCHEMA)
