"""Packed forms of sequences, in numpy over Arrow batches.

``pack`` keeps three bases a byte: 32 + 25 i + 5 j + k, with 224 + 5 i + j or 160 + i for
what is left at the end. ``pack7`` is a bit stream: two bits with the number of filling
bases, then seven bits for each group of three, holding its number plus one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from strandlake.functions.sequences import ALPHABET

_DIGIT = np.full(256, len(ALPHABET) - 1, np.uint8)  # any other character counts as n
_DIGIT[list(ALPHABET.encode())] = range(len(ALPHABET))
_LETTER = np.frombuffer(ALPHABET.encode(), np.uint8)


def _digits(seq: str) -> np.ndarray:
    return _DIGIT[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)]


def _text(digits: np.ndarray) -> str:
    return _LETTER[digits].tobytes().decode()


def _three(d: np.ndarray) -> np.ndarray:
    return d.reshape(-1, 3) @ np.array([25, 5, 1], np.uint8)


def _from_three(v: np.ndarray) -> np.ndarray:
    return np.column_stack([v // 25, v // 5 % 5, v % 5]).reshape(-1)


def pack_bytes(seq: str) -> bytes:
    d = _digits(seq)
    whole = len(d) // 3 * 3
    tail = d[whole:].tolist()
    end = [[], [160 + tail[0]] if tail else [], [224 + 5 * tail[0] + tail[1]] if len(tail) == 2 else []][len(tail)]
    return (_three(d[:whole]) + np.uint8(32)).astype(np.uint8).tobytes() + bytes(end)


def unpack_bytes(packed: bytes) -> str:
    v = np.frombuffer(packed, np.uint8)
    if (v < 160).all():
        return _text(_from_three(v - np.uint8(32)))
    parts, at = [], 0
    for i in [*np.flatnonzero(v >= 160).tolist(), len(v)]:
        parts.append(_text(_from_three(v[at:i] - np.uint8(32))))
        if i < len(v):
            x = int(v[i])
            parts.append(_text(np.array([(x - 224) // 5, (x - 224) % 5] if x >= 224 else [x - 160])))
        at = i + 1
    return "".join(parts)


def pack7_bytes(seq: str) -> bytes:
    d = _digits(seq)
    fill = -len(d) % 3
    codes = _three(np.append(d, np.full(fill, len(ALPHABET) - 1, np.uint8))) + np.uint8(1)
    bits = np.unpackbits(codes.astype(np.uint8)[:, None], axis=1)[:, 1:].reshape(-1)
    return np.packbits(np.concatenate([np.array([fill >> 1, fill & 1], np.uint8), bits])).tobytes()


def unpack7_bytes(packed: bytes) -> str:
    bits = np.unpackbits(np.frombuffer(packed, np.uint8))
    if len(bits) < 2:
        return ""
    fill = 2 * int(bits[0]) + int(bits[1])
    n = (len(bits) - 2) // 7
    codes = bits[2 : 2 + 7 * n].reshape(n, 7) @ (1 << np.arange(6, -1, -1, dtype=np.uint8))
    d = _from_three(codes[codes > 0] - 1)
    return _text(d[: len(d) - fill] if fill else d)


def arrow_function(work: Callable, kind: str) -> Callable[[Column], Column]:
    """A function of one value as a function of a column; null gives null."""

    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else work(x))

    return run


def pack(seq: Column) -> Column:
    """Binary; upper case is not folded, so it packs as n."""
    return arrow_function(pack_bytes, "binary")(seq)


def unpack(packed: Column) -> Column:
    return arrow_function(unpack_bytes, "string")(packed)


def packed_size(seq: Column) -> Column:
    """Bytes of the packed form."""
    return F.ceil(F.length(seq) / 3)


def pack7(seq: Column) -> Column:
    return arrow_function(pack7_bytes, "binary")(seq)


def unpack7(packed: Column) -> Column:
    return arrow_function(unpack7_bytes, "string")(packed)
