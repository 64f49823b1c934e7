"""Similarities of all texts of one list with all of another, as tables: rows of bits for whole tables at once.

Each gives the very values of its namesake in ``similarity``; equal texts are worked out once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from matchloom.functions import similarity as S

WORD = S.WORD
#: Cells of a table that are worked out together.
AT_ONCE = 1 << 16
_LOW = np.array([(1 << i) - 1 for i in range(WORD + 1)], np.uint64)


def _codes(texts: list, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Characters (or bytes) as numbers, a text a row; and lengths."""
    held = np.array([len(t) for t in texts], np.int64)
    table = np.full((len(texts), max(1, held.max(initial=0))), pad, np.int64)
    for row, t in enumerate(texts):
        table[row, : len(t)] = np.frombuffer(t, np.uint8) if isinstance(t, bytes) else np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    return table, held


def _masks(left: list, right: list) -> tuple[np.ndarray, np.ndarray]:
    """(letters x left: places of a letter in a text as bits, right x places: numbers of letters); left texts fit a word."""
    a, _ = _codes(left, -1)
    b, _ = _codes(right, -2)
    known, at = np.unique(b, return_inverse=True)
    at = at.reshape(b.shape)
    masks = np.zeros((len(known), len(left)), np.uint64)
    place = np.minimum(np.searchsorted(known, a), len(known) - 1)
    row, col = np.nonzero(known[place] == a)
    np.bitwise_or.at(masks, (place[row, col], row), np.uint64(1) << col.astype(np.uint64))
    return masks, at


def _distinct(texts: Sequence) -> tuple[list, np.ndarray]:
    seen: dict = {}
    return (at := [seen.setdefault(t, len(seen)) for t in texts]) and list(seen), np.array(at, np.int64)


def _by_distinct(f):
    """A table over distinct texts, spread to all."""

    def run(left: Sequence, right: Sequence) -> np.ndarray:
        (a, i), (b, j) = _distinct(left), _distinct(right)
        if not len(a) or not len(b):
            return np.zeros((len(left), len(right)))
        made = f(a, b)
        return made if len(a) == len(left) and len(b) == len(right) else made[i][:, j]

    return run


def _lcs(left: list[str], right: list[str]) -> np.ndarray:
    """Lengths of longest common subsequences; longer texts than a word on both sides go one by one."""
    out = np.zeros((len(left), len(right)), np.int64)
    short, long = ([i for i, t in enumerate(left) if (len(t) <= WORD) == fits] for fits in (True, False))
    if long:
        fits = [j for j, t in enumerate(right) if len(t) <= WORD]
        if fits:
            out[np.ix_(long, fits)] = _lcs([right[j] for j in fits], [left[i] for i in long]).T
        for j in set(range(len(right))) - set(fits):
            out[long, j] = [S.lcs_length(right[j], left[i]) for i in long]
    if not short:
        return out
    order = sorted(range(len(right)), key=lambda j: len(right[j]))
    step = max(1, AT_ONCE // len(short))
    for at in range(0, len(order), step):
        cols = order[at : at + step]
        masks, letters = _masks([left[i] for i in short], [right[j] for j in cols])
        row = np.full((len(cols), len(short)), np.iinfo(np.uint64).max)
        for k in range(letters.shape[1]):
            hit = masks[letters[:, k]]
            hit &= row
            row = (row + hit) | (row - hit)
        out[np.ix_(short, cols)] = np.bitwise_count(~row).T
    return out


def _ratios(left: list[str], right: list[str]) -> np.ndarray:
    total = np.array([len(t) for t in left])[:, None] + np.array([len(t) for t in right])[None]
    return np.where(total > 0, 200.0 * _lcs(left, right) / np.maximum(total, 1), 100.0)


def _token_sets(left: list[str], right: list[str]) -> np.ndarray:
    """Common words are a prefix of what is compared, so only the rest of either side is worked out."""
    a, b = [frozenset(t.split()) for t in left], [frozenset(t.split()) for t in right]
    joined = lambda words: " ".join(sorted(words))
    out = _by_distinct(_ratios)([joined(x) for x in a], [joined(y) for y in b])
    out[[not x for x in a]] = 0.0
    out[:, [not y for y in b]] = 0.0
    holders: dict[str, list[int]] = {}
    for j, y in enumerate(b):
        for w in y:
            holders.setdefault(w, []).append(j)
    rests: dict[frozenset, str] = {}
    rest = lambda words: rests[words] if words in rests else rests.setdefault(words, joined(words))
    at, asked, both = [], [], []
    for i, x in enumerate(a):
        for j in {j for w in x for j in holders.get(w, ())}:
            y = b[j]
            common = x & y
            if len(common) == len(x) or len(common) == len(y):
                out[i, j] = 100.0
            else:
                at.append((i, j))
                asked.append((rest(x - common), rest(y - common)))
                both.append(len(rest(common)))
    if at:
        n, u, w = np.array(both), np.array([len(x) for x, _ in asked]), np.array([len(y) for _, y in asked])
        known: dict[tuple[str, str], int] = {}
        place = [known.setdefault(p, len(known)) for p in asked]
        lcs = S.lcs_lengths(list(known))[place]
        row, col = np.array(at).T
        out[row, col] = np.maximum(200.0 * (n + 1 + lcs) / (2 * n + 2 + u + w), np.maximum(200.0 * n / (2 * n + 1 + u), 200.0 * n / (2 * n + 1 + w)))
    return out


def _jaro_winkler(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Greedy matches by bits of the right side's free places; longer right sides go one by one."""
    out = np.zeros((len(left), len(right)))
    fits = [j for j, t in enumerate(right) if len(t) <= WORD]
    for j in set(range(len(right))) - set(fits):
        out[:, j] = [S.jaro_winkler_of(t, right[j]) for t in left]
    order = sorted(range(len(left)), key=lambda i: len(left[i]))
    step = max(1, AT_ONCE // max(1, len(fits)))
    for at in range(0, len(order) if fits else 0, step):
        rows = order[at : at + step]
        mine, theirs = [left[i] for i in rows], [right[j] for j in fits]
        masks, letters = _masks(theirs, mine)
        la, lb = np.array([len(t) for t in mine])[:, None], np.array([len(t) for t in theirs])[None]
        reach = np.maximum(0, np.maximum(la, lb) // 2 - 1)
        reaches = np.arange(reach.max(initial=0) + 1)
        used, flags = np.zeros(reach.shape, np.uint64), []
        for i in range(letters.shape[1]):
            window = _LOW[np.minimum(WORD, i + reaches + 1)] & ~_LOW[np.clip(i - reaches, 0, WORD)]
            free = masks[letters[:, i]] & window[reach] & ~used
            bit = free & (~free + np.uint64(1))
            used |= bit
            flags.append(bit != 0)
        m, swaps = np.bitwise_count(used).astype(np.int64), np.zeros(reach.shape, np.int64)
        for i, flag in enumerate(flags):
            bit = used & (~used + np.uint64(1))
            swaps += flag & ((masks[letters[:, i]] & bit) == 0)
            used ^= np.where(flag, bit, np.uint64(0))
        swaps //= 2
        some = m > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            jaro = np.where(some, (m / la + m / lb + (m - swaps) / m) / 3, 0.0)
        a, b = _codes([t[:4] for t in mine], -1)[0], _codes([t[:4] for t in theirs], -2)[0]
        same, prefix = np.ones(reach.shape, bool), np.zeros(reach.shape, np.int64)
        for k in range(min(a.shape[1], b.shape[1])):
            same &= a[:, k : k + 1] == b[None, :, k]
            prefix += same
        out[np.ix_(rows, fits)] = np.where(jaro > 0.7, jaro + prefix * 0.1 * (1 - jaro), jaro)
    there = {t: j for j, t in enumerate(right)}
    for i, t in enumerate(left):
        if t and t in there:
            out[i, there[t]] = 1.0
    return out


ratio, token_set, _bytes = (_by_distinct(f) for f in (_ratios, _token_sets, _jaro_winkler))


def jaro_winkler(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """Of UTF-8 bytes."""
    return _bytes([t.encode() for t in left], [t.encode() for t in right])


def equal(left: Sequence, right: Sequence) -> np.ndarray:
    seen: dict = {}
    a, b = (np.array([seen.setdefault(t, len(seen)) for t in side], np.int64) for side in (left, right))
    return (a[:, None] == b[None]).astype(np.float64)
