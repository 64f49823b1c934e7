"""Best-fit packing of token pieces into sequences, certified by dual-feasible lower bounds."""

from __future__ import annotations

import functools
import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import cut, text_of
from matchloom.llm.tokens import id_encoder, same_by_rank

#: Pieces that one task packs at a time.
GROUP = 1 << 14


def token_pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids, then ``end_id``, cut into pieces of ``capacity`` where longer; the first piece takes what is over.

    A null or empty text is one piece, its end id; repeated rows give their pieces each; ids may be
    of any type; other columns are ignored; an empty table gives no rows.
    """
    rows, by_rank = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("__text")), same_by_rank(path)

    def run(batches):
        encode = id_encoder(path, by_rank)
        for batch in batches:
            docs_, piece, start, length, crc = [], [], [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("__text").to_pylist(), strict=True):
                ids = np.append(np.asarray(encode(text), "<u4"), np.array([end_id], "<u4"))
                edges = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    docs_.append(doc), piece.append(k), start.append(a), length.append(b - a), crc.append(zlib.crc32(ids[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(docs_, batch.column("doc_id").type), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that any packing of ``counts[s]`` pieces of each size s needs at least.

    A dual-feasible function keeps every set of sizes that fits within the capacity within it, so
    the sum of its values over the pieces bounds the number of bins. Tried are the identity, the
    threshold functions (large sizes count whole, sizes under k not at all) and the rounding functions.
    """
    sizes = np.arange(len(counts), dtype=np.int64)
    best = -(-int((counts * sizes).sum()) // capacity)
    for k in range(1, capacity // 2 + 1):
        value = np.where(sizes > capacity - k, capacity, np.where(sizes < k, 0, sizes))
        best = max(best, -(-int((counts * value).sum()) // capacity))
    for k in range(1, 101):
        scaled = (k + 1) * sizes
        whole = scaled % capacity == 0
        value = np.where(whole, sizes * k, (scaled // capacity) * capacity)
        best = max(best, -(-int((counts * value).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each piece and the fill of each bin; bins are found by their free space in constant time."""
    bins, offsets, fill = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = 0  # bit f is set if some open bin has f tokens left
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fits = free >> s
        if fits:
            f = s + (fits & -fits).bit_length() - 1
            b = by_free[f].pop()
            if not by_free[f]:
                free ^= 1 << f
        else:
            f, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += s
        if f > s:
            by_free[f - s].append(b)
            free |= 1 << (f - s)
    return bins, offsets, np.array(fill, np.int64)


def pack(pieces: DataFrame, capacity: int = 1024, group: int = GROUP, rounds: int = 8) -> DataFrame:
    """``pieces`` (with ``length`` from 1 to ``capacity``) with ``sequence_id`` and gapless ``offset`` added.

    Full pieces are sequences of their own. The others are dealt to groups by hash and packed by
    best fit, decreasing. A group whose bins exceed its lower bound gives up every bin that isn't
    full; a certified group gives up only those with a sixteenth or more free. What is given up is
    dealt anew to fewer groups and packed again, until the total meets the lower bound of all
    pieces, one group has held all that was left, or ``rounds`` are over. Columns named
    ``sequence_id`` or ``offset`` in ``pieces`` are replaced; rows that repeat are pieces each; an
    empty table gives no rows.
    """
    pieces = pieces.drop("sequence_id", "offset")
    columns = [f.name for f in pieces.schema.fields]
    items = cut(pieces).withColumn("__uid", F.monotonically_increasing_id())  # what is numbered is stored, so the numbers are stable
    whole = items.where(F.col("length") == capacity).select(*columns, (-1 - F.col("__uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    pool = items.where(F.col("length") < capacity)
    sizes = {r["length"]: r["n"] for r in pool.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = np.zeros(capacity + 1, np.int64)
    for s, n in sizes.items():
        counts[s] = n
    need, left, settled, done = lower_bound(counts, capacity), int(counts.sum()), 0, [whole]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)
    schema = f"{fields}, sequence_id long, offset long, __open boolean, __first boolean"

    for turn in range(rounds):
        groups = max(1, math.ceil(left / group))

        def fill(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["length", "__uid"], ascending=[False, True], kind="stable", ignore_index=True)
            lengths, g = pdf["length"].to_numpy(), int(pdf["__group"].iat[0])
            bins, offsets, filled = best_fit_decreasing(lengths, capacity)
            bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
            loose = filled < (capacity if len(filled) > bound else capacity - capacity // 16)
            return pdf.drop(columns="__group").assign(sequence_id=(turn << 58) + (g << 24) + bins, offset=offsets, __open=loose[bins], __first=offsets == 0)

        dealt = pool.select(*columns, "__uid", F.pmod(F.xxhash64("__uid", F.lit(turn)), F.lit(groups)).alias("__group"))
        packed = cut(dealt.groupBy("__group").applyInPandas(fill, schema))
        seen = packed.agg(F.count_if(F.col("__first")).alias("bins"), F.count_if(F.col("__first") & ~F.col("__open")).alias("shut"), F.count_if("__open").alias("open")).first()
        place = lambda df: df.select(*columns, "sequence_id", "offset")
        if settled + seen["bins"] <= need or groups == 1 or not seen["open"] or turn == rounds - 1:
            done.append(place(packed))
            break
        done.append(place(packed.where(~F.col("__open"))))
        settled += seen["shut"]
        left, pool = seen["open"], packed.where("__open").select(*columns, "__uid")
    return functools.reduce(DataFrame.unionByName, done)


def packed_sequences(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A null text is empty and packs as its end id alone; special strings become their ids; repeated
    rows are packed each by itself; other columns are ignored; an empty table gives no rows.
    """
    return pack(token_pieces(docs, path, capacity, end_id, id_col, text_col), capacity, group)
