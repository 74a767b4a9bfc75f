"""Word shingles of texts as sorted 64-bit hashes, a block of texts at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from maskwright.llm.common import mix64, string_bytes

WORDS = 5
_ODD = int(0x9E3779B97F4A7C15)
_tables: dict[str, np.ndarray] = {}


def _table(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Random numbers for bytes, A-Z as a-z; which bytes end words; powers of an odd number and of its inverse."""
    if "byte" not in _tables:
        lower = np.arange(256)
        lower[65:91] += 32
        _tables["byte"] = mix64(np.arange(1, 257, dtype=np.uint64))[lower]
        space = np.zeros(256, bool)
        space[[32, 9, 10, 11, 12, 13]] = True
        _tables["space"] = space
    if "up" not in _tables or len(_tables["up"]) < n:
        size = max(n, 1 << 19)
        for name, base in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
            _tables[name] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)]))
    return _tables["byte"], _tables["space"], _tables["up"], _tables["down"]


def shingle_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first hash of each text and one more): the distinct shingles of each text in rising order.

    A word is a run of bytes other than blank and tab to carriage return,
    with A-Z in lower case. A text of fewer words than ``words``, but of one
    at least, has its whole word sequence as its only shingle.
    """
    raw, at = string_bytes(texts)
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    byte, space, up, down = _table(n)
    inside = ~space[raw]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    start = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1] | edge[1:-1]]))
    end = np.flatnonzero(inside & np.concatenate([~inside[1:] | edge[1:-1], [True]])) + 1
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(byte[raw] * up[:n])])
        word = mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
        first = np.searchsorted(start, at)  # first word of each text
        count = np.diff(first)
        long = len(word) - words + 1
        text_of = np.repeat(np.arange(len(texts)), count)
        if long > 0:
            whole = np.zeros(long, np.uint64)
            for k in range(words):
                whole += word[k : k + long] * np.uint64(pow(_ODD, k + 2, 1 << 64))
            here = text_of[:long] == text_of[words - 1 :]
            value, owner = mix64(whole[here]), text_of[:long][here]
        else:
            value, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        short = np.flatnonzero((count > 0) & (count < words))
        if len(short):
            few = np.zeros(len(short), np.uint64)
            for k in range(words - 1):
                has = count[short] > k
                few[has] += word[first[short[has]] + k] * np.uint64(pow(_ODD, k + 2, 1 << 64))
            value = np.concatenate([value, mix64(few + count[short].astype(np.uint64))])
            owner = np.concatenate([owner, short])
    order = np.argsort(value)
    owner = owner[order]
    again = np.argsort(owner.astype(np.uint16) if len(texts) < 1 << 16 else owner, kind="stable")
    value, owner = value[order][again], owner[again]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(len(texts) + 1))
