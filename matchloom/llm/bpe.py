"""Byte-pair encoding by dynamic programming over prefixes, and decoding."""

from __future__ import annotations

import functools
import hashlib
import json
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import text_of

#: Fixed value: how the byte-level pre-tokenizer cuts text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of a worker's cache of pieces (at most twice as many are held), and the longest piece kept there.
CACHED, CACHED_LENGTH = 200_000, 64


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file, as letter -> byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PrefixBPE:
    """Exact byte-pair encoding of pieces.

    The encoding of a prefix ends in one token only: the token t, ending there, whose predecessor
    is the last token of the prefix without t, such that encoding the two tokens' bytes gives the
    two tokens again. An automaton over the vocabulary lists the tokens that end at each place;
    following the stored last tokens back gives the ids.
    """

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError(f"{path}: a plain byte-level BPE is expected")
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.ids = {raw(s): i for s, i in model["vocab"].items()}
        self.bytes = {i: b for b, i in self.ids.items()}
        self.rank = {}
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank[raw(a), raw(b)] = r
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes |= {i: s.encode() for s, i in self.added.items()}
        self.automaton = ahocorasick.Automaton()
        for b, i in self.ids.items():
            self.automaton.add_word(b.decode("latin-1"), (len(b), i))
        self.automaton.make_automaton()
        self.pieces = regex.compile(PIECES)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.fits: dict[tuple[int, int], bool] = {}
        self.young: dict[str, tuple[int, str, bytes]] = {}
        self.old: dict[str, tuple[int, str, bytes]] = {}

    def _by_merges(self, data: bytes) -> list[bytes]:
        """The definition, for the few bytes of one or two tokens: merge the best-ranked pair until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranks = [self.rank.get(p, 1 << 60) for p in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == 1 << 60:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _fit(self, before: int, token: int) -> bool:
        pair = (before, token)
        known = self.fits.get(pair)
        if known is None:
            b = self.bytes[token]
            known = self._by_merges(b) == [b] if before < 0 else self._by_merges(self.bytes[before] + b) == [self.bytes[before], b]
            if len(self.fits) >= 1_000_000:
                self.fits.clear()
            self.fits[pair] = known
        return known

    def encode_piece(self, data: bytes) -> list[int]:
        last, size, get = [-1] * (len(data) + 1), [0] * (len(data) + 1), self.fits.get
        for end, (n, token) in self.automaton.iter(data.decode("latin-1")):
            end += 1
            if size[end]:
                continue
            start = end - n
            if start and not size[start]:
                continue
            pair = (last[start], token)
            fit = get(pair)
            if self._fit(*pair) if fit is None else fit:
                last[end], size[end] = token, n
        out, at = [], len(data)
        while at:
            if not size[at]:
                raise ValueError("the vocabulary lacks a byte")
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def _entry(self, ids: list[int]) -> tuple[int, str, bytes]:
        return len(ids), ",".join(map(str, ids)), b"".join([self.bytes[i] for i in ids])

    def _piece(self, piece: str) -> tuple[int, str, bytes]:
        """(number of ids, the ids as text, what they decode to) of one piece, cached in two generations."""
        found = self.old.get(piece)
        if found is None:
            found = self._entry(self.encode_piece(piece.encode()))
        if len(piece) <= CACHED_LENGTH:
            if len(self.young) >= CACHED:
                self.old, self.young = self.young, {}
            self.young[piece] = found
        return found

    def stream(self, text: str, step: int = 1 << 16):
        """Lists of entries, in order; memory is bounded by ``step`` pieces, or by one piece."""
        for i, part in enumerate(self.specials.split(text) if self.specials else [text]):
            if i % 2:
                yield [self._entry([self.added[part]])]
                continue
            if len(part) <= 4 * step:
                found, more = self.pieces.findall(part), None
            else:
                more = self.pieces.finditer(part)
                found = [m[0] for m in islice(more, step)]
            while found:
                get, make = self.young.get, self._piece
                yield [get(p) or make(p) for p in found]
                found = [m[0] for m in islice(more, step)] if more else None

    def encode(self, text: str) -> list[int]:
        return [int(x) for part in self.stream(text) for e in part for x in e[1].split(",")]

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.bytes[i] for i in ids]).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def load_bpe(path: str) -> PrefixBPE:
    return PrefixBPE(path)


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    The ids are those of the tokenizers library without added begin or end tokens; special strings
    in texts become their ids. The decoded text is put together from the ids' bytes. A null text is
    empty: no tokens and the digests of nothing. Texts are handled as streams of pieces. Repeated
    rows are handled alike; ids may be of any type; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("__text"))

    def run(batches):
        bpe = load_bpe(path)
        for batch in batches:
            counts, ids, texts = [], [], []
            for text in batch.column("__text").to_pylist():
                n, sha, first, decoded = 0, hashlib.sha256(), True, []
                for part in bpe.stream(text):
                    counted, shown, raw = zip(*part, strict=True)
                    n += sum(counted)
                    sha.update(("" if first else ",").encode() + ",".join(shown).encode())
                    decoded.append(b"".join(raw))
                    first = False
                counts.append(n)
                ids.append(sha.hexdigest())
                texts.append(hashlib.sha256(b"".join(decoded).decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
