"""Recompression of word sequences: consistent names for runs and pairs, and the symbol that stands for each window."""

from __future__ import annotations

import numpy as np
import xxhash

#: The round whose symbols, of four or five words, stand for windows: nearly as telling as whole windows, and few.
TOP = 7


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit names of the words, which ASCII spaces separate."""
    ws = (text or "").encode("utf-8", "surrogatepass").split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))


def word_names(text: str | None) -> np.ndarray:
    """words x 2: two independent 64-bit hashes of each word, the halves of a 128-bit one."""
    ws = (text or "").encode("utf-8", "surrogatepass").split()
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, ws)), np.uint64).reshape(len(ws), 2)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Names:
    """The symbols of one round: name, and the stretch of words [lo, hi) that settles it.

    Wherever the words of that stretch recur, the same symbol arises at the same place in it. What
    a document's edge settled has a stretch that goes one past the edge, so that no window holds it.
    """

    def __init__(self, name, lo, hi, doc, edges):
        self.name, self.lo, self.hi, self.doc, self.edges = name, lo, hi, doc, edges

    def neighbours(self):
        """Stretch starts of left neighbours and ends of right ones; one past a document's edge where there are none."""
        left, right = self.edges[0][self.doc] - 1, self.edges[1][self.doc] + 1
        same = self.doc[1:] == self.doc[:-1]
        left[1:][same] = self.lo[:-1][same]
        right[:-1][same] = self.hi[1:][same]
        return left, right, same

    def runs(self):
        """Runs of one name become one symbol; both neighbours settle where a run ends."""
        left, right, same = self.neighbours()
        first = np.ones(len(self.name), bool)
        first[1:] = ~(same & (self.name[1:] == self.name[:-1]))
        at = np.flatnonzero(first)
        size = np.diff(np.append(at, len(self.name)))
        name = self.name[at]
        long = size > 1
        name[long] = mix(name[long] + mix(size[long].astype(np.uint64)))
        return Names(name, left[at], right[at + size - 1], self.doc[at], self.edges)

    def pairs(self, turn: int):
        """A coin for each name splits the names in two; adjacent (heads, tails) become one symbol.

        The two names settle a pair. A symbol without partner is settled by the neighbour that might have been it.
        """
        left, right, same = self.neighbours()
        coin = (mix(self.name + np.uint64(0x9E3779B97F4A7C15 * (turn + 1) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(17)) & np.uint64(1) == 1
        join = np.zeros(len(self.name), bool)
        join[:-1] = same & coin[:-1] & ~coin[1:]
        joined = np.zeros(len(self.name), bool)
        joined[1:] = join[:-1]
        keep = ~joined
        nxt = np.minimum(np.arange(len(self.name)) + 1, len(self.name) - 1)
        name = np.where(join, mix(self.name * np.uint64(3) + mix(self.name[nxt] + np.uint64(turn))), self.name)
        lo = np.where(coin | join, self.lo, left)
        hi = np.where(join, self.hi[nxt], np.where(coin, right, self.hi))
        return Names(name[keep], lo[keep], hi[keep], self.doc[keep], self.edges)


def _least(order: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Index of the leftmost least value of each range [a, b), none empty, from a table over powers of two."""
    best = [np.arange(len(order))]
    size = b - a
    depth = np.frexp(size.astype(np.float64))[1] - 1
    for k in range(int(depth.max(initial=0))):
        left, right = best[-1][: -(1 << k)], best[-1][1 << k :]
        best.append(np.where(order[right] < order[left], right, left))
    out = np.zeros(len(a), np.int64)
    for k, table in enumerate(best):
        w = np.flatnonzero(depth == k)
        left, right = table[a[w]], table[b[w] - (1 << k)]
        out[w] = np.where(order[right] < order[left], right, left)
    return out


def blocks(words: np.ndarray, doc: np.ndarray, width: int, top: int = TOP):
    """(name, first window, windows) of each stretch of windows that one symbol stands for.

    A window of ``width`` words is stood for by one of the symbols that its own words settle: of
    the highest round up to ``top`` that has any, the one whose name mixes to the least value, the
    leftmost of equals. So equal windows have equal names, wherever they are.
    """
    n = len(words)
    starts = np.flatnonzero(doc[: n - width + 1] == doc[width - 1 :]) if n >= width else np.zeros(0, np.int64)
    at = np.arange(n, dtype=np.int64)
    sizes = np.bincount(doc) if n else np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    rounds = [Names(words, at, at + 1, doc, (ends - sizes, ends))]
    if len(starts):
        rounds.append(rounds[0].runs())
        for turn in range(top - 1):
            rounds.append(rounds[-1].pairs(turn))
    name, who = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.int64)
    todo = np.arange(len(starts))
    for level in range(len(rounds) - 1, -1, -1):
        r, p = rounds[level], starts[todo]
        # starts and ends of stretches rise with their symbols, so the symbols a window settles are a range
        a = np.cumsum(np.bincount(r.lo + 1, minlength=n + 2))[p]
        b = np.cumsum(np.bincount(r.hi, minlength=n + 2))[p + width]
        good = a < b
        w = todo[good]
        s = _least(mix(r.name), a[good], b[good]) if len(w) else w
        name[w] = mix(r.name[s] + np.uint64(level))
        who[w] = (np.int64(level) << 40) + s
        todo = todo[~good]
        if not len(todo):
            break
    new = np.ones(len(starts), bool)
    new[1:] = (who[1:] != who[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    return name[first], starts[first], np.diff(np.append(first, len(starts)))


class Stretches:
    """Hashes of word stretches in constant time each, from polynomial prefix sums over mixed words."""

    BASE = 0xD6E8FEB86659FD93

    def __init__(self, words: np.ndarray):
        n = len(words)
        with np.errstate(over="ignore"):
            self.power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, self.BASE, np.uint64)]))
            inverse = np.uint64(pow(self.BASE, -1, 1 << 64))
            self.inverse = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, inverse, np.uint64)]))
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(words + np.uint64(0x632BE59BD9B4E019)) * self.power[:n], dtype=np.uint64)])

    def hash(self, start: np.ndarray, size) -> np.ndarray:
        return mix((self.sums[start + size] - self.sums[start]) * self.inverse[start] + np.uint64(1) * np.asarray(size, np.uint64))
