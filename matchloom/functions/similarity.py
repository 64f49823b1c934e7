"""String similarities, written from their definitions; pandas UDFs work over distinct argument pairs once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jaro_winkler_of(a, b) -> float:
    """Jaro-Winkler of two sequences (bytes or text), prefix weight 0.1 over four; 0 where either is empty."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, mine = bytearray(len(b)), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = 1
                mine.append(x)
                break
    m = len(mine)
    if not m:
        return 0.0
    theirs = [y for y, u in zip(b, used, strict=True) if u]
    swaps = sum(x != y for x, y in zip(mine, theirs, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


@lru_cache(maxsize=200_000)
def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, a row of bits a character."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


#: Pairs that are compared at a time, and the longest shorter side that fits the word of bits.
AT_ONCE, WORD = 4096, 64


def lcs_lengths(pairs: list[tuple[str, str]]) -> np.ndarray:
    """:func:`lcs_length` of many pairs: one row of bits a pair, one step a character, for all pairs of a block at once."""
    out = np.zeros(len(pairs), np.int64)
    sides = [(a, b) if len(a) <= len(b) else (b, a) for a, b in pairs]
    short = [i for i, (a, b) in enumerate(sides) if len(a) <= WORD and len(b) <= 1 << 12]
    for i in set(range(len(pairs))) - set(short):
        out[i] = lcs_length(*sides[i])
    short.sort(key=lambda i: len(sides[i][1]))

    def codes(texts: list[str], width: int, pad: int) -> np.ndarray:
        table = np.full((len(texts), max(1, width)), pad, np.uint32)
        for row, t in enumerate(texts):
            table[row, : len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        return table

    for at in range(0, len(short), AT_ONCE):
        block = short[at : at + AT_ONCE]
        left, right = codes([sides[i][0] for i in block], WORD, 1 << 30), codes([sides[i][1] for i in block], max(len(sides[i][1]) for i in block), 1 << 31)
        row = np.full(len(block), np.iinfo(np.uint64).max)
        for j in range(right.shape[1]):
            hit = row & np.packbits(left == right[:, j : j + 1], axis=1, bitorder="little").view(np.uint64).ravel()
            row = (row + hit) | (row - hit)
        out[block] = np.bitwise_count(~row)
    return out


class Ratios:
    """Ratios asked for one by one and worked out together; what is asked for twice is worked out once.

    Each question gives the slots of its value; slots 0 and 1 hold the values 0 and 100. A set ratio
    is the greatest of three slots.
    """

    def __init__(self):
        self.known: dict[tuple[str, str], int] = {}

    def ratio(self, a: str, b: str) -> int:
        return 1 if a == b else self.known.setdefault((a, b), len(self.known) + 2)

    def sort(self, a: str, b: str) -> int:
        return self.ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))

    def set(self, a: str, b: str) -> tuple[int, int, int]:
        x, y = set(a.split()), set(b.split())
        if not x or not y:
            return 0, 0, 0
        both, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
        if both and (not left or not right):
            return 1, 0, 0
        one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
        return (self.ratio(one, two), self.ratio(both, one), self.ratio(both, two)) if both else (self.ratio(one, two), 0, 0)

    def values(self) -> np.ndarray:
        pairs = list(self.known)
        total = np.array([len(a) + len(b) for a, b in pairs], np.float64)
        return np.concatenate([[0.0, 100.0], 200.0 * lcs_lengths(pairs) / total])


def ratio_of(a: str, b: str) -> float:
    """100 times twice the common subsequence over both lengths."""
    return 100.0 if a == b else 200.0 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_sort_of(a: str, b: str) -> float:
    return ratio_of(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_of(a: str, b: str) -> float:
    """Best ratio among the common words, and these with the rest of either side."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left, right = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 100.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    found = [ratio_of(one, two)]
    if both:
        found += [ratio_of(both, one), ratio_of(both, two)]
    return max(found)


def partial_of(a: str, b: str) -> float:
    """Best ratio of the shorter text against the equally long parts of the longer, ends cut off included."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    n = len(short)
    if len(long) == n and short == long:
        return 100.0
    return max(ratio_of(short, long[max(0, i) : i + n]) for i in range(1 - n, len(long)))


#: Windows of texts that are compared at a time.
WINDOWS = 1 << 15


def partials(pairs: list[tuple[str, str]]) -> np.ndarray:
    """:func:`partial_of` of many pairs: all windows of all pairs of a block at once, a row of bits a window."""
    out = np.zeros(len(pairs))
    by: dict[int, list[tuple[int, str, str]]] = {}
    for i, (a, b) in enumerate(pairs):
        short, long = sorted((a, b), key=len)
        if not short or a == b or len(short) > WORD or len(long) > 4 * WORD:
            out[i] = partial_of(a, b)
        else:
            by.setdefault(len(short), []).append((i, short, long))
    for n, found in by.items():
        found.sort(key=lambda x: len(x[2]))
        step = max(1, WINDOWS // (len(found[-1][2]) + n))
        for at in range(0, len(found), step):
            block = found[at : at + step]
            held = np.array([len(x) for _, _, x in block])
            width = held.max()
            points = lambda texts, size: np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(texts), size)
            left, right = points([x for _, x, _ in block], n), points([x.ljust(width, "\0") for _, _, x in block], width)
            hits = np.zeros((len(block), width, WORD), bool)
            hits[:, :, :n] = left[:, None] == right[:, :, None]
            hits &= (np.arange(width) < held[:, None])[:, :, None]
            masks = np.zeros((len(block), width + 2 * (n - 1)), np.uint64)
            masks[:, n - 1 : n - 1 + width] = np.packbits(hits, axis=2, bitorder="little").view(np.uint64)[:, :, 0]
            windows = width + n - 1
            row = np.full((len(block), windows), np.iinfo(np.uint64).max)
            for k in range(n):
                hit = row & masks[:, k : k + windows]
                row = (row + hit) | (row - hit)
            start = np.arange(1 - n, width)[None]
            size = np.maximum(0, np.minimum(start + n, held[:, None]) - np.maximum(start, 0))
            out[[i for i, _, _ in block]] = (200.0 * np.bitwise_count(~row) / (n + size)).max(1)
    return out


def _pairwise(f):
    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], float] = {}
        out = []
        for pair in zip(a.fillna(""), b.fillna(""), strict=True):
            if pair not in known:
                known[pair] = f(*pair)
            out.append(known[pair])
        return pd.Series(out, dtype="float64")

    return run


jaro_winkler = _pairwise(jaro_winkler_of)
jaro_winkler_bytes = _pairwise(lambda a, b: jaro_winkler_of(a.encode(), b.encode()))
partial_ratio = _pairwise(partial_of)


def _together(ask):
    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        ratios = Ratios()
        slots = [ask(ratios, *pair) for pair in zip(a.fillna(""), b.fillna(""), strict=True)]
        return pd.Series(ratios.values()[np.array(slots, np.int64).reshape(len(slots), -1)].max(1) if slots else [], dtype="float64")

    return run


ratio, token_sort_ratio, token_set_ratio = (_together(f) for f in (Ratios.ratio, Ratios.sort, Ratios.set))


def containment(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.least(F.size(a), F.size(b)))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def f05(tp: Column, fp: Column, fn: Column) -> Column:
    """F0.5 of one query; with nothing to find, 1 if nothing was claimed."""
    return F.when(tp + fn == 0, F.when(fp == 0, 1.0).otherwise(0.0)).otherwise(1.25 * tp / F.greatest(F.lit(1e-12), 1.25 * tp + fp + 0.25 * fn))
