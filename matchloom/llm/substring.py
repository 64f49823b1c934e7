"""Substring deduplication by recompression: shared symbols reveal repeated word windows, hashes of whole stretches verify them."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import fresh, packed, text_key
from matchloom.llm.recompress import Stretches, blocks, mix, word_names

#: A place is (first window << 10) | windows, so windows of up to 1023 words are possible.
COUNT_BITS = 10
#: Names at least this frequent in a 64th of the documents, at most so many, are each dealt to this many parts.
HOT_IN_SAMPLE, MOST_HOT, SALTS = 32, 1024, 64
#: Words, or single windows, whose rows are settled together, where that many are there.
KERNEL_WORDS = 400_000
#: Words that are recompressed at a time, but for a longer text: that takes many times their memory, and texts don't depend on each other.
PIECE_WORDS = 1 << 15


def _place(first, count):
    return (first << COUNT_BITS) | count


def _settled(name: np.ndarray, content: np.ndarray, doc: np.ndarray, key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """One row for each (name, content) with its count, and each further occurrence under a name of its own.

    What recurs within the rows at hand is known to be repeated, so only one of it has to meet the
    rest of the corpus: however often a passage occurs, its key gets at most one row from each call.
    A further occurrence counts as two, which marks it, and its own name spreads it evenly.
    """
    order = np.lexsort((content, name))
    new = np.ones(len(order), bool)
    new[1:] = (name[order][1:] != name[order][:-1]) | (content[order][1:] != content[order][:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(order)))
    count = np.full(len(order), 2, np.int64)
    count[order[at]] = size
    extra = np.ones(len(order), bool)
    extra[order[at]] = False
    own = mix(place.astype(np.uint64) + mix(doc.astype(np.uint64) + mix(key.view(np.uint64))))
    return np.where(extra, own, name), content, count, doc, key, place


def _rows(name, content, count, doc, key, place):
    return pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(content.view(np.int64)), pa.array(count), pa.array(doc), pa.array(key), pa.array(place)], names=["name", "content", "n", "doc_id", "key", "place"])


PLACES = "name long, content long, n long, doc_id long, key long, place long"


def _found(texts: list[tuple], width: int) -> tuple[np.ndarray, ...]:
    """Name, content, row and place of the blocks of some texts, which come as (doc_id, key, names of the words)."""
    size = np.array([len(w) for _, _, w in texts], np.int64)
    words, row = np.concatenate([w for _, _, w in texts]), np.repeat(np.arange(len(texts)), size)
    name, first, count = blocks(np.ascontiguousarray(words[:, 0]), row, width)
    content = Stretches(words[:, 1]).hash(first, count + width - 1)
    at, offset = row[first], np.cumsum(size) - size
    ids, keys = (np.array([t[i] for t in texts], np.int64) for i in range(2))
    return name, content, ids[at], keys[at], _place(first - offset[at], count)


def _blocks(docs: DataFrame, width: int) -> DataFrame:
    """A row for each block: windows in a row that one symbol stands for, and the hash of all their words."""

    def run(batches):
        piece, words, found, total = [], 0, [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "__key", "__text")), strict=True):
                piece.append((*row[:2], word_names(row[2])))
                words += len(piece[-1][2])
                if words >= PIECE_WORDS:
                    found.append(_found(piece, width))
                    total += words
                    piece, words = [], 0
                if total >= KERNEL_WORDS:
                    yield _rows(*_settled(*map(np.concatenate, zip(*found, strict=True))))
                    found, total = [], 0
        if piece:
            found.append(_found(piece, width))
        if found:
            yield _rows(*_settled(*map(np.concatenate, zip(*found, strict=True))))

    return docs.select("doc_id", "__key", "__text").mapInArrow(run, PLACES)


def _windows(found: DataFrame, text: str, width: int) -> DataFrame:
    """The windows of each row's listed blocks: a list for each block, or a row each under a frequent name."""

    names = ["name", "salt", "contents", "n", "doc_id", "key", "place"]

    def settled(hot):
        name, content, *rest = _settled(*map(np.concatenate, zip(*hot, strict=True)))
        single = pa.ListArray.from_arrays(pa.array(np.arange(len(content) + 1, dtype=np.int32)), pa.array(content.view(np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array((content % np.uint64(SALTS)).astype(np.int32)), single, *map(pa.array, rest)], names=names)

    def run(batches):
        hot: list[tuple] = []
        windows = 0
        for batch in batches:
            name, content, doc, keys, place = [], [], [], [], []
            texts = pa.compute.struct_field(batch.column("__row"), text).to_pylist()
            for whole, doc_id, key, listed in zip(texts, *(batch.column(c).to_pylist() for c in ("__id", "__key", "listed")), strict=True):
                hashes = Stretches(word_names(whole)[:, 1])
                for x in listed:
                    count, first = x["place"] & ((1 << COUNT_BITS) - 1), x["place"] >> COUNT_BITS
                    at = first + np.arange(count)
                    here = hashes.hash(at, width)
                    if x["hot"]:
                        hot.append((np.full(count, x["name"], np.int64).view(np.uint64), here, np.full(count, doc_id, np.int64), np.full(count, key, np.int64), _place(at, 1)))
                        windows += count
                    else:
                        name.append(x["name"]), content.append(here.view(np.int64)), doc.append(doc_id), keys.append(key), place.append(x["place"])
                if windows >= KERNEL_WORDS:
                    yield settled(hot)
                    hot, windows = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(name, pa.int64()), pa.array(np.zeros(len(name), np.int32)), pa.array(content, pa.list_(pa.int64())), pa.array(np.ones(len(name), np.int64)), pa.array(doc, pa.int64()), pa.array(keys, pa.int64()), pa.array(place, pa.int64())], names=names)
        if hot:
            yield settled(hot)

    return found.mapInArrow(run, "name long, salt int, contents array<long>, n long, doc_id long, key long, place long")


def _frequent(plain: DataFrame, width: int) -> list[int]:
    """Names of blocks that are frequent in a 64th of the documents: they are dealt out by content as well.

    Which names these are only decides where rows go, never what comes out.
    """
    part = _blocks(plain.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(64)) == 0), width).where("name is not null")
    top = part.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where(f"n >= {HOT_IN_SAMPLE}").orderBy(F.desc("n"), "name").limit(MOST_HOT)
    return [r["name"] for r in top.collect()]


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 35) -> DataFrame:
    """``docs`` with the words of repeated ``width``-word windows removed; adds ``__n_words``, ``__n_removed`` and ``__kept``.

    Words are runs of characters other than ASCII spaces, unchanged. A word goes if some window of
    its row that covers it starts anywhere else too, in the same row or another; windows are judged
    on the input. ``__kept`` has the words that stay, joined by one space; ``text_col`` is replaced
    by it where words went and otherwise unchanged (null stays null). Texts under ``width`` words
    have no window. Rows repeated under one id, null ids included, each are documents of their own;
    ids may be of any type. All columns are kept whatever their names, and an added column called
    like one of them gets an underscore more; an empty table gives no rows. Rows are told apart by
    64-bit hashes of id and of text: rows that agree in both have the same text, so the same words go.

    Each document is recompressed on its own, as names are hashes of what they stand for and so
    hold globally: token runs, then pairs round by round. Every window is stood for by one of the
    symbols that its words settle, and the windows in a row with one symbol are a block. Blocks of
    equal symbol and equal words are repeated as a whole. Where one symbol stands for different
    blocks, as at the ends of a shared passage, their single windows are compared instead. What a
    symbol proposes is verified over all words of the stretch by a second hash: symbols are made of
    one half of each word's 128-bit hash, the stretch's hash of the other half, so both are
    independent.
    """
    if not 2 <= width < 1 << COUNT_BITS:
        raise ValueError(f"width must be from 2 to {(1 << COUNT_BITS) - 1}")
    row, doc, key = packed(docs), F.xxhash64(F.col(id_col)), text_key(text_col)
    text = f"c{docs.columns.index(text_col)}"
    # rows travel whole, as one column, so that both joins below read one and the same exchange
    keyed = docs.select(row.alias("__row"), doc.alias("__id"), key.alias("__key"))
    plain = docs.select(doc.alias("doc_id"), key.alias("__key"), F.col(text_col).alias("__text"))
    which = F.xxhash64("doc_id", "key", "place")  # equal in two blocks only lists one block more

    hot = _frequent(plain, width)
    is_hot = F.col("name").isin(hot) if hot else F.lit(False)
    found = _blocks(plain, width).where("name is not null").withColumn("salt", F.when(is_hot, F.pmod("content", F.lit(SALTS))).otherwise(0).cast("int")).repartition("name", "salt")
    of_name, of_block = Window.partitionBy("name", "salt"), Window.partitionBy("name", "salt", "content")
    found = found.withColumn("all", F.sum("n").over(of_block)).withColumn("least", F.min(which).over(of_block)).withColumn("a", F.min("content").over(of_name)).withColumn("b", F.max("content").over(of_name))
    # one of each block whose name other blocks have too; all > 0 reads what the marks read, so both share one exchange
    unsure = found.where((F.col("least") == which) & (F.col("all") > 0) & ((F.col("a") != F.col("b")) | is_hot))
    listed = unsure.groupBy(F.col("doc_id").alias("d"), F.col("key").alias("k")).agg(F.collect_list(F.struct("name", "place", is_hot.alias("hot"))).alias("listed"))
    unsure = keyed.join(listed, (keyed["__id"] == listed["d"]) & (keyed["__key"] == listed["k"])).select("__row", "__id", "__key", "listed")
    lists = _windows(unsure, text, width).repartition("name", "salt")
    single = lists.select("name", "salt", "n", "doc_id", "key", "place", F.posexplode("contents").alias("i", "content")).withColumn("all", F.sum("n").over(of_block)).where("all > 1")
    one = F.col("place") - F.col("place").bitwiseAND((1 << COUNT_BITS) - 1) + F.col("i").cast("long") * (1 << COUNT_BITS) + 1
    marks = found.where("all > 1").select("doc_id", "key", "place").unionByName(single.select("doc_id", "key", one.alias("place")))
    marked = marks.groupBy(F.col("doc_id").alias("d"), F.col("key").alias("k")).agg(F.collect_list("place").alias("places"))
    joined = keyed.join(marked, (keyed["__id"] == marked["d"]) & (keyed["__key"] == marked["k"]), "left")

    def apply(batches):
        for batch in batches:
            sizes, removed, kept = [], [], []
            for whole, places in zip(batch.column(text).to_pylist(), batch.column("places"), strict=True):
                words = (whole or "").encode().split()
                gone = 0
                if places.is_valid:
                    place = places.values.to_numpy()
                    first = place >> COUNT_BITS
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, first, 1)
                    np.add.at(edge, first + (place & ((1 << COUNT_BITS) - 1)) + width - 1, -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    gone = int(len(words) - stay.sum())
                    words, n = [w for w, s in zip(words, stay.tolist(), strict=True) if s], len(words)
                else:
                    n = len(words)
                sizes.append(n), removed.append(gone), kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in carried] + [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=[*carried, "__n_words", "__n_removed", "__kept"])

    carried = [f"c{i}" for i in range(len(docs.columns))]
    kinds = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(carried, docs.schema.fields, strict=True))
    out = joined.select("__row.*", "places").mapInArrow(apply, f"{kinds}, __n_words long, __n_removed long, __kept string")
    new = F.when(F.col("__n_removed") > 0, F.col("__kept"))
    return out.select(*[(F.coalesce(new, F.col(k)) if c == text_col else F.col(k)).alias(c) for k, c in zip(carried, docs.columns, strict=True)], *[F.col(c).alias(fresh(docs, c)) for c in ("__n_words", "__n_removed", "__kept")])


def substring_report(docs: DataFrame, width: int = 35) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of :func:`substring_dedup`."""
    out = substring_dedup(docs.select("doc_id", "text"), width=width)
    return out.select("doc_id", F.col("__n_words").alias("n_words"), F.col("__n_removed").alias("n_removed"), F.sha2("__kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple], width: int = 35) -> list[tuple]:
    """The same report for (doc_id, text) pairs, straight from the definition; for tests."""
    seen: dict[tuple, int] = {}
    cut = [(d, (t or "").encode().split()) for d, t in rows]
    for _, w in cut:
        for i in range(len(w) - width + 1):
            seen[tuple(w[i : i + width])] = seen.get(tuple(w[i : i + width]), 0) + 1
    out = []
    for d, w in cut:
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out
