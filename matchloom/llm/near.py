"""N-gram Jaccard join: MinHash bands propose pairs of texts, full n-gram sets verify them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import cut, join_counted, packed, text_key
from matchloom.llm.recompress import mix, word_hashes

#: Members and n-grams of a block of a large bucket; at most two blocks meet in one task.
BLOCK, BLOCK_GRAMS = 1024, 2_000_000


def bands_for(threshold: float, recall: float, most: int = 160) -> tuple[int, int]:
    """(bands, rows): the most selective rows whose bands, within ``most`` hashes, find a pair at the threshold with probability ``recall``."""
    for rows in range(16, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold < 1 else 1
        if bands * rows <= most:
            return bands, rows
    raise ValueError("no bands reach this recall; allow more hashes")


def gram_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct names of the word ``n``-grams; a shorter text is one gram, an empty one none."""
    if not len(words):
        return words
    size = min(n, len(words))
    names = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        names = mix(names * np.uint64(31) + words[k : len(words) - size + 1 + k])
    return np.unique(names)


def _signatures(bands: int, rows: int):
    count = bands * rows
    rng = np.random.default_rng(20240607)
    a, b = rng.integers(1, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, count, dtype=np.uint64)

    def of(grams: np.ndarray) -> np.ndarray:
        least = np.full(count, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(grams), 512):
            part = grams[at : at + 512, None] * a
            part += b
            np.minimum(least, part.min(0), out=least)
        names = np.zeros(bands, np.uint64)
        for r in range(rows):
            names = mix(names * np.uint64(31) + mix(least.reshape(bands, rows)[:, r]))
        return mix(names + np.arange(bands, dtype=np.uint64))

    return of


def _signed(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """Per row: its gram set's 128-bit name, its size, and the names of its bands (none for an empty set)."""

    def run(batches):
        sign = _signatures(bands, rows)
        for batch in batches:
            high, low, size, names = [], [], [], []
            for text in batch.column("__text").to_pylist():
                grams = gram_set(word_hashes(text), n)
                high.append(mix(grams).sum(dtype=np.uint64)), low.append(mix(grams * np.uint64(5) + np.uint64(1)).sum(dtype=np.uint64)), size.append(len(grams))
                names.append(sign(grams).view(np.int64) if len(grams) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("__key"), pa.array(np.array(high, np.uint64).view(np.int64)), pa.array(np.array(low, np.uint64).view(np.int64)), pa.array(size, pa.int64()), pa.array(names, pa.list_(pa.int64()))], names=["doc_id", "__key", "a", "b", "grams", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "__key", "__text").mapInArrow(run, f"doc_id {kind}, __key long, a long, b long, grams long, bands array<long>")


def _gram_sets(wanted: DataFrame, n: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            sets = [gram_set(word_hashes(t), n).view(np.int64) for t in batch.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "copies", "bands")), pa.array(sets, pa.list_(pa.int64()))], names=["a", "b", "copies", "bands", "set"])

    return wanted.select("a", "b", "copies", "bands", "__text").mapInArrow(run, "a long, b long, copies long, bands array<long>, set array<long>")


def _linked(sets: list[np.ndarray], pairs: np.ndarray, threshold: float) -> np.ndarray:
    """The pairs (i, j) of a boolean matrix whose sets have a Jaccard similarity of ``threshold`` or more."""
    out = np.zeros_like(pairs)
    size = np.array([len(s) for s in sets])
    low, high = np.minimum.outer(size, size), np.maximum.outer(size, size)
    pairs = pairs & (low >= threshold * high)
    left = np.flatnonzero(pairs.any(1))
    if not len(left):
        return out
    if pairs.sum() <= 4 * len(left) or len(left) < 16:
        for i, j in np.argwhere(pairs):
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            out[i, j] = both >= threshold * (size[i] + size[j] - both) - 1e-9
        return out
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    both = np.zeros(pairs.shape, np.float32)
    width = max(1, 16_000_000 // len(sets))  # columns at a time, so that memory is bounded
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [at, at + width])
        part = np.zeros((len(sets), width), np.float32)
        part[owner[a:b], column[a:b] - at] = 1
        both += part @ part.T
    both = np.rint(both).astype(np.float64)
    return pairs & (both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9)


def _verify(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links of one bucket, or of two blocks of one: a pair counts in the first band that its texts share, and not where one core holds both."""
        empty = pd.DataFrame({"a": [], "b": [], "links": [], "ra": [], "rb": []}).astype("int64")
        if len(pdf) < 2:
            return empty
        bands, band = np.array(pdf["bands"].tolist(), np.int64), int(pdf["band"].iat[0])
        sets = [np.asarray(s, np.int64) for s in pdf["set"]]
        k = len(pdf)
        pairs = np.triu(np.ones((k, k), bool), 1)
        if pdf["across"].iat[0]:
            side = pdf["side"].to_numpy()
            pairs &= side[:, None] != side[None, :]
        held, ca, cb = (pdf[c].to_numpy() for c in ("held", "ca", "cb"))
        pairs &= ~(held[:, None] & held[None, :] & (ca[:, None] == ca[None, :]) & (cb[:, None] == cb[None, :]))
        for j in range(band):
            if not pairs.any():
                return empty
            pairs &= bands[:, None, j] != bands[None, :, j]
        linked = _linked(sets, pairs, threshold)
        if not linked.any():
            return empty
        weight = pdf["copies"].to_numpy()
        both = linked | linked.T
        links = both @ weight
        root = np.arange(k)
        while True:  # least index of each connected part
            least = np.where(both, root[None, :], k).min(1)
            new = np.minimum(root, least)
            new = new[new]
            if (new == root).all():
                break
            root = new
        a, b = pdf["a"].to_numpy(), pdf["b"].to_numpy()
        some = links > 0
        return pd.DataFrame({"a": a[some], "b": b[some], "links": links[some], "ra": a[root[some]], "rb": b[root[some]]})

    return run


def _cores(large: DataFrame, texts: DataFrame, n: int, threshold: float) -> DataFrame:
    """(a, b) -> core ``ca, cb``: classes of large buckets so near to one representative that all of them are linked.

    Jaccard distance is a metric, so two sets within half of the greatest distance of a third are
    linked. ``large`` has the memberships in large buckets; each class goes by its least one, whose
    least class is the representative, and meets nothing but that.
    """
    home = large.groupBy("a", "b").agg(F.min(F.struct("band", "bucket")).alias("h"), F.max("blocks").alias("blocks"))
    head = home.groupBy("h").agg(F.min(F.struct("a", "b")).alias("head"), F.count(F.lit(1)).alias("n"), F.max("blocks").alias("parts"))
    homed = cut(home.select("a", "b", "h"))
    known = join_counted(homed, cut(head), ["h"], "n", homed.count()).select("a", "b", "h", "head", "parts")
    sets = _gram_sets(texts.join(known.select("a", "b"), ["a", "b"], "left_semi"), n).select("a", "b", "set")
    rows = known.join(sets, ["a", "b"])
    member = rows.select("h", F.pmod(F.xxhash64("b", "a"), F.col("parts")).cast("int").alias("part"), "a", "b", "set", F.lit(False).alias("is_head"))
    heads = rows.where((F.col("a") == F.col("head.a")) & (F.col("b") == F.col("head.b"))).select("h", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "a", "b", "set", F.lit(True).alias("is_head"))

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        at = np.flatnonzero(pdf["is_head"].to_numpy())[0]
        first, rest = np.asarray(pdf["set"].iat[at], np.int64), pdf[~pdf["is_head"]]
        both = np.array([np.isin(np.asarray(s, np.int64), first, assume_unique=True, kind="sort").sum() for s in rest["set"]], np.int64)
        size = np.array([len(s) for s in rest["set"]], np.int64)
        good = both >= (1 - (1 - threshold) / 2) * (len(first) + size - both) - 1e-9
        return pd.DataFrame({"a": rest["a"][good], "b": rest["b"][good], "ca": pdf["a"].iat[at], "cb": pdf["b"].iat[at]})

    return cut(member.unionByName(heads).groupBy("h", "part").applyInPandas(near, "a long, b long, ca long, cb long"))


def _dealt(chosen: DataFrame, cores: DataFrame | None) -> DataFrame:
    """Memberships dealt to tasks: ``bucket, band, kind, lo, hi, side, across, a, b, held, ca, cb``.

    A large bucket's members of its main core, whose links are known, meet the other members block
    by block; the other members meet each other block by block.
    """
    core = [F.lit(False).alias("held"), F.lit(0).cast("long").alias("ca"), F.lit(0).cast("long").alias("cb")]
    if cores is None:
        known = chosen.select("*", *core)
    else:
        known = cut(chosen.join(cores, ["a", "b"], "left").withColumn("held", F.col("ca").isNotNull()).fillna(0, ["ca", "cb"]))
    one = lambda df, kind, lo, hi, side, across: df.select("bucket", "band", F.lit(kind).alias("kind"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), side.cast("int").alias("side"), across.alias("across"), "a", "b", "held", "ca", "cb")
    zero = F.lit(0)
    small = one(known.where("blocks = 1"), 1, zero, zero, zero, F.lit(False))
    if cores is None:
        return small
    large = known.where("blocks > 1")
    per = large.groupBy("bucket", "band", "blocks", "held", "ca", "cb").agg(F.count(F.lit(1)).alias("m"))
    core_size = F.when(F.col("held"), F.col("m")).otherwise(0)
    info = per.groupBy("bucket", "band").agg(F.max("blocks").alias("nb"), F.sum("m").alias("n"), F.max(F.struct(core_size.alias("m"), "ca", "cb")).alias("main"))
    part = lambda m: F.greatest(F.lit(1), F.ceil(F.col("nb") * m / F.col("n"))).cast("int")
    info = cut(info.select("bucket", "band", "n", "main", part(F.col("main.m")).alias("mb"), part(F.col("n") - F.col("main.m")).alias("ob")))
    rows = join_counted(large, info, ["bucket", "band"], "n", large.count())
    inside = F.col("held") & (F.col("main.m") > 0) & (F.col("ca") == F.col("main.ca")) & (F.col("cb") == F.col("main.cb"))
    rows = rows.withColumn("inside", inside).withColumn("mine", F.pmod(F.xxhash64("b", "a"), F.when(inside, F.col("mb")).otherwise(F.col("ob"))).cast("int"))
    each = lambda df, n: df.withColumn("other", F.explode(F.sequence(zero, F.col(n) - 1)))
    cross = one(each(rows.where("inside"), "ob"), 0, F.col("mine"), F.col("other"), zero, F.lit(True)).unionByName(one(each(rows.where("not inside and main.m > 0"), "mb"), 0, F.col("other"), F.col("mine"), F.lit(1), F.lit(True)))
    rest = each(rows.where("not inside"), "ob")
    return small.unionByName(cross).unionByName(one(rest, 1, F.least("mine", "other"), F.greatest("mine", "other"), F.col("mine"), F.col("mine") != F.col("other")))


def _components(edges: DataFrame) -> DataFrame:
    """(a, b) -> root, the least (a, b) of its connected part, by alternating large and small stars.

    Roots themselves have no row. A hot centre is only aggregated and joined, and its edges stay
    where they are; it is never collected.
    """
    e = cut(edges.where("a <> ra or b <> rb").select(F.struct("a", "b").alias("u"), F.struct(F.col("ra").alias("a"), F.col("rb").alias("b")).alias("v")).distinct())
    mark = lambda df: df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
    before, size = None, e.count()
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
        large = join_counted(both, least, ["u"], "n", 2 * size).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        near = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(near, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(near.select("u", F.col("m").alias("v"))).distinct())
        now = mark(e)
        size = now[0]
        if now == before:
            return e.select("u.a", "u.b", F.col("v").alias("root"))
        before = now


def _joined(docs: DataFrame, id_col: str, text_col: str, n: int, threshold: float, recall: float) -> DataFrame:
    bands, rows = bands_for(threshold, recall)
    base = docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("__key"), F.col(text_col).alias("__text"))
    signed = cut(_signed(base, n, bands, rows))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__key")).alias("one")
    classes = cut(signed.where("grams > 0").groupBy("a", "b").agg(first, F.count(F.lit(1)).alias("copies"), F.first("grams").alias("grams"), F.first("bands").alias("bands")))
    member = classes.select("a", "b", "grams", F.posexplode("bands").alias("band", "bucket"))
    mark = F.xxhash64("a", "b")
    bucket = member.groupBy("bucket", "band").agg(F.count(F.lit(1)).alias("n"), F.sum("grams").alias("total"), F.bit_xor(mark).alias("x"), F.sum(F.shiftright(mark, 24)).alias("y")).where("n > 1")
    # of buckets with the same members the first band is kept: it is where all their pairs count
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("total") / BLOCK_GRAMS)).cast("int")
    kept = bucket.groupBy("n", "total", "x", "y").agg(F.min(F.struct("band", "bucket")).alias("k")).select("k.band", "k.bucket", blocks.alias("blocks"))
    chosen = cut(member.select("a", "b", "band", "bucket").join(kept, ["bucket", "band"]))
    wanted = chosen.select("a", "b").distinct().join(classes, ["a", "b"]).select("a", "b", "copies", "bands", F.col("one.doc_id").alias("d"), F.col("one.__key").alias("k"))
    # sets are worked out anew, from one text of each class that has a bucket in common with another
    texts = base.join(wanted, base["doc_id"].eqNullSafe(wanted["d"]) & (base["__key"] == wanted["k"])).select("a", "b", "__text", "copies", "bands").dropDuplicates(["a", "b"])
    large = chosen.where("blocks > 1")
    cores = None if large.isEmpty() else _cores(large, texts, n, threshold)
    dealt = _dealt(chosen, cores).join(_gram_sets(texts, n), ["a", "b"])
    found = cut(dealt.groupBy("bucket", "band", "kind", "lo", "hi").applyInPandas(_verify(threshold), "a long, b long, links long, ra long, rb long"))
    if cores is not None:
        sized = cores.join(classes.select("a", "b", "copies"), ["a", "b"])
        whole = sized.groupBy("ca", "cb").agg(F.sum("copies").alias("all"), F.count(F.lit(1)).alias("n"))
        inside = join_counted(cut(sized), cut(whole), ["ca", "cb"], "n", cores.count()).select("a", "b", (F.col("all") - F.col("copies")).alias("links"), F.col("ca").alias("ra"), F.col("cb").alias("rb"))
        found = found.unionByName(inside)
    parts = _components(found.select("a", "b", "ra", "rb"))
    linked = found.groupBy("a", "b").agg(F.sum("links").alias("links")).join(parts, ["a", "b"], "left").withColumn("root", F.coalesce("root", F.struct("a", "b")))
    info = classes.select("a", "b", "one", "copies").join(linked, ["a", "b"], "left")
    heads = info.where("root is not null").groupBy("root").agg(F.min("one").alias("head")).select(F.col("root").alias("r"), "head")
    info = info.join(heads, F.col("root") == F.col("r"), "left").select(F.col("a").alias("ka"), F.col("b").alias("kb"), "one", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("head", "one").alias("head"))
    return signed.select("doc_id", "__key", "grams", "a", "b").join(info, (F.col("a") == F.col("ka")) & (F.col("b") == F.col("kb")) & (F.col("grams") > 0), "left")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """One row per input row: ``doc_id, class_id, n_class, n_links, group_id``.

    Texts are compared as sets of word ``n``-grams (words between ASCII spaces, unchanged; a text
    of fewer words is one gram). Rows of equal sets are one class, named by its least id. Classes
    are linked if the sets' Jaccard similarity is ``threshold`` or more; ``n_links`` counts the
    other rows that a row is linked to, those of its own class included, and ``group_id`` is the
    least id of all that chains of links reach. Texts without words, and null texts, have no grams
    and no links: each is a class and a group of its own. Rows repeated under one id count as rows.
    A class of null ids only has a null class id. Other columns are ignored; an empty table gives no rows.

    The signature has as many bands as a pair at the threshold needs to be proposed with probability
    ``recall``; what is proposed is verified on the full sets. Only representatives of classes are
    banded. Buckets of the same members in several bands are kept once. Members of a large bucket
    that are near enough to a representative to be linked with each other are counted by membership
    alone; the others meet all, block by block. A task counts its links and returns, for each
    member, the count and one member of its connected part, never the pairs themselves. Ids may be
    of any type that has an order.
    """
    j = _joined(docs, id_col, text_col, n, threshold, recall)
    alone = F.col("ka").isNull()
    return j.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("one.doc_id")).alias("class_id"), F.coalesce("copies", F.lit(1)).cast("long").alias("n_class"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("group_id"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """``docs`` with one document of each group of :func:`jaccard_join`: that of the least id.

    Rows repeated under one id and text are one document: of those of a group's head, the row of
    the least hash stays. Texts without words all stay. All columns are kept.
    """
    j = _joined(docs, id_col, text_col, n, threshold, recall).where("ka is not null")
    same = F.expr("doc_id <=> head.doc_id and __key = head.__key")
    name = [F.col("doc_id").alias("__doc"), F.col("__key").alias("__gone")]
    again = cut(j.where(same).groupBy(*name).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    gone = j.where(~same).select(*name).distinct().unionByName(again)
    keyed = docs.select(packed(docs).alias("__row"), F.col(id_col).alias("__id"), text_key(text_col).alias("__key"))
    of = lambda names: keyed["__id"].eqNullSafe(names["__doc"]) & (keyed["__key"] == names["__gone"])
    one = keyed.join(again, of(again)).groupBy("__id", "__key").agg(F.min_by("__row", F.xxhash64("__row")).alias("__row"))
    whole = [F.col("__row")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)]
    return keyed.join(gone, of(gone), "left_anti").select(*whole).unionByName(one.select(*whole))


def brute_force(rows: list[tuple], n: int = 5, threshold: float = 0.8) -> list[tuple]:
    """(doc_id, number of links, least id of the group) straight from the definition; for tests."""
    sets = []
    for d, t in rows:
        w = (t or "").encode().split()
        k = min(n, len(w))
        sets.append((d, {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()))
    links, head = [0] * len(sets), list(range(len(sets)))

    def top(i):
        while head[i] != i:
            i = head[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and min(len(a), len(b)) >= threshold * max(len(a), len(b)) and len(a & b) >= threshold * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                x, y = top(i), top(j)
                head[max(x, y)] = min(x, y)
    least: dict[int, int] = {}
    for i in range(len(sets)):
        least[top(i)] = min(least.get(top(i), sets[i][0]), sets[i][0])
    return [(sets[i][0], links[i], least[top(i)]) for i in range(len(sets))]
