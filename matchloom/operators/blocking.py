"""Blocking routes: each returns pairs ``s1_id, target_id``; routes combine by set union, never by OR."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions import similarity, text

#: Pairs of a key whose queries get a list of its targets together.
PART = 1 << 16


def postings(rows: DataFrame, id_col: str, field: Column, least: int = 4) -> DataFrame:
    """(id, country, tok), distinct within a record before it is exploded."""
    return rows.select(id_col, "country", F.explode(text.tokens(field, least)).alias("tok"))


def frequencies(posted: DataFrame) -> DataFrame:
    return posted.groupBy("country", "tok").agg(F.count(F.lit(1)).alias("df"))


def rare_postings(posted: DataFrame, cap: int) -> DataFrame:
    """Postings with their document frequency, of tokens that at most ``cap`` records hold."""
    return posted.join(frequencies(posted).where(F.col("df") <= cap), ["country", "tok"])


def rarest(query_tokens: DataFrame, df: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` rarest tokens of each query, ties by token."""
    at = Window.partitionBy("s1_id").orderBy("df", "tok")
    return query_tokens.join(df, ["country", "tok"]).withColumn("rk", F.row_number().over(at)).where(F.col("rk") <= k)


def _shared(mine: DataFrame, posted: DataFrame, cap: int, k: int) -> DataFrame:
    """Targets that hold one of a query's ``k`` rarest tokens; the frequency cap bounds what a token joins."""
    chosen = rarest(mine, frequencies(posted).where(F.col("df") <= cap), k)
    return chosen.select("s1_id", "country", "tok").join(posted, ["country", "tok"]).select("s1_id", "target_id").distinct()


def token_route(queries: DataFrame, targets: DataFrame, column: str, cap: int, k: int = 3) -> DataFrame:
    """Targets that share one of a query's rarest tokens."""
    mine = postings(queries.withColumnRenamed("entity_id", "s1_id"), "s1_id", F.col(column))
    return _shared(mine, postings(targets, "target_id", F.col(column)), cap, k)


def key_route(queries: DataFrame, targets: DataFrame, query_key: Column, target_key: Column) -> DataFrame:
    """Equi-join on two key expressions within a country; empty keys join nothing."""
    a = queries.select(F.col("entity_id").alias("s1_id"), "country", query_key.alias("key")).where("key <> ''")
    b = targets.select("target_id", "country", target_key.alias("key")).where("key <> ''")
    return a.join(b, ["country", "key"]).select("s1_id", "target_id").distinct()


def number_route(queries: DataFrame, targets: DataFrame, cap: int, k: int = 2) -> DataFrame:
    explode = lambda rows, i: rows.select(F.col(i), "country", F.explode(text.address_numbers(F.col("business_address"))).alias("tok"))
    return _shared(explode(queries.withColumnRenamed("entity_id", "s1_id"), "s1_id"), explode(targets, "target_id"), cap, k)


def union_routes(*routes: DataFrame) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, routes).distinct()


def route_gain(routes: dict[str, DataFrame]) -> DataFrame:
    """Per route in order: its pairs, and those no earlier route has."""
    marked = functools.reduce(DataFrame.unionByName, [r.select("s1_id", "target_id").withColumn("route", F.lit(i)) for i, r in enumerate(routes.values())])
    first = marked.groupBy("s1_id", "target_id").agg(F.min("route").alias("first"), F.collect_set("route").alias("all"))
    names = F.create_map(*[F.lit(x) for i, k in enumerate(routes) for x in (i, k)])
    return first.select("first", F.explode("all").alias("route")).groupBy("route").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("first") == F.col("route")).alias("gain")).select(names[F.col("route")].alias("route"), "pairs", "gain")


def hydrate(pairs: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    q = queries.select(F.col("entity_id").alias("s1_id"), F.col("business_name").alias("q_name"), F.col("business_address").alias("q_address"), "country")
    t = targets.select("target_id", F.col("business_name").alias("t_name"), F.col("business_address").alias("t_address"), F.col("source").alias("target_source"))
    return pairs.join(q, "s1_id").join(t, "target_id")


def unmatched(pairs: DataFrame, targets: DataFrame) -> DataFrame:
    """Pairs whose target isn't there: empty where hydration is complete."""
    return pairs.join(targets, "target_id", "left_anti")


def rank(pairs: DataFrame, order: list[Column], name: str = "rn", by: str = "s1_id") -> DataFrame:
    return pairs.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long"))


def best(pairs: DataFrame, score: str, k: int, by: str = "s1_id", tie: str = "target_id") -> DataFrame:
    return rank(pairs, [F.desc(score), F.asc(tie)], "rn", by).where(F.col("rn") <= k)


def two_rank_pool(scored: DataFrame, k: int = 100) -> DataFrame:
    """Pairs among the best ``k`` by name or by address: a union of two limits, each of which is pushed below its window."""
    top = lambda c: best(scored, c, k).select("s1_id", "target_id")
    return top("ns").unionByName(top("ads")).distinct()


def field_scores(hydrated: DataFrame) -> DataFrame:
    low = lambda c: F.lower(c)
    return hydrated.withColumn("ns", similarity.jaro_winkler_bytes(low("q_name"), low("t_name"))).withColumn("ads", similarity.jaro_winkler_bytes(low("q_address"), low("t_address")))


def overlap_route(queries: DataFrame, targets: DataFrame, ads: DataFrame, cap: int, k: int = 50) -> DataFrame:
    """Address token overlap; ``n >= 2`` is asked for after ranking."""
    q = queries.select(F.col("entity_id").alias("s1_id"), "country", text.tokens(F.col("business_address"), 2).alias("qa"))
    t = targets.select("target_id", "country", text.tokens(F.col("business_address"), 2).alias("ta"))
    a, b = q.select("s1_id", "country", F.size("qa").alias("ql"), F.explode("qa").alias("tok")), t.select("target_id", "country", F.size("ta").alias("tl"), F.explode("ta").alias("tok"))
    posted = rare_postings(b, cap)
    n = a.join(posted, ["country", "tok"]).groupBy("s1_id", "target_id").agg(F.count(F.lit(1)).alias("n"), F.max("ql").alias("ql"), F.max("tl").alias("tl"))
    scored = n.join(ads, ["s1_id", "target_id"], "left").withColumn("share", F.col("n") / F.greatest(F.lit(1), F.least("ql", "tl")))
    return rank(scored, [F.desc("share"), F.desc("n"), F.desc_nulls_last("ads"), F.asc("target_id")]).where((F.col("rn") <= k) & (F.col("n") >= 2))


def composed_route(queries: DataFrame, targets: DataFrame, overlap_country: str, cap: int = 3000, k: int = 3, top: int = 100, overlap_top: int = 50) -> DataFrame:
    """All candidates of each query: the whole retrieval in one plan.

    Rare tokens of names and of addresses propose a pool, of which the ``top`` best by name or by
    address stay; equal core keys and accent keys are added, and for one country those of the pool
    that share most address tokens.
    """
    high = union_routes(token_route(queries, targets, "business_name", cap, k), token_route(queries, targets, "business_address", cap, k))
    full = field_scores(hydrate(high, queries, targets)).withColumn("ns", F.round("ns", 9)).withColumn("ads", F.round("ads", 9))
    name = F.col("business_name")
    keys = [key_route(queries, targets, key, key) for key in (text.core_key(name), text.accent_key(text.core_key(name)))]
    words = full.where(F.col("country") == overlap_country).select("s1_id", "target_id", "ads", text.tokens(F.col("q_address"), 2).alias("q"), text.tokens(F.col("t_address"), 2).alias("t"))
    counted = words.withColumn("n", F.size(F.array_intersect("q", "t"))).withColumn("share", F.col("n") / F.greatest(F.lit(1), F.least(F.size("q"), F.size("t"))))
    near = rank(counted, [F.desc("share"), F.desc("n"), F.desc("ads"), F.asc("target_id")]).where((F.col("rn") <= overlap_top) & (F.col("n") >= 2))
    return union_routes(two_rank_pool(full, top), *keys, near.select("s1_id", "target_id"))


def reciprocal_rank_fusion(routes: list[DataFrame], c: int = 10, k: int = 20) -> DataFrame:
    """Routes with ``rn`` fused by the sum of 1 / (c + rank)."""
    fused = functools.reduce(DataFrame.unionByName, [r.select("s1_id", "target_id", "rn") for r in routes]).groupBy("s1_id", "target_id").agg(F.sum(1.0 / (c + F.col("rn"))).alias("score"))
    return best(fused.withColumn("score", F.round("score", 9)), "score", k)


def quota_merge(routes: list[tuple[DataFrame, int]]) -> DataFrame:
    return union_routes(*[r.where(F.col("rn") <= q).select("s1_id", "target_id") for r, q in routes])


def siblings(candidates: DataFrame, anchors: DataFrame) -> DataFrame:
    """Candidates beside the other accepted targets of their query."""
    return candidates.alias("c").join(anchors.select("s1_id", F.col("target_id").alias("anchor_id")).alias("a"), "s1_id").where("c.target_id <> a.anchor_id")


def siblings_by_key(queries: DataFrame, targets: DataFrame, by: list[str], accepted: Callable[[Column, Column], Column]) -> DataFrame:
    """:func:`siblings` where all queries and targets that are equal in ``by`` are pairs, without a row for a pair.

    ``queries`` have s1_id, ``targets`` target_id, both the columns ``by`` and a number ``n`` that goes with the id;
    a null in ``by`` joins nothing. ``accepted`` judges a pair by the numbers of both; the candidates are the other
    pairs, so none is beside itself. A target counts as often as its id stands in ``targets``, by whatever key; a
    query's pairs are distinct. Targets travel as one list for each part of a key's queries, and only the result
    expands them. There each row counts: none is compared or judged, and the plan knows that no id is null.
    """
    keyed = F.when(functools.reduce(Column.__and__, [F.col(c).isNotNull() for c in by]), F.struct(*by))
    held = lambda key: F.coalesce(key, F.lit("")).alias(key)  # noqa: E731  changes no id: it tells the plan that none is null
    keys = lambda df, key: df.where(F.col(key).isNotNull()).groupBy(key, "n").agg(F.collect_set(keyed).alias("of"), F.count(F.lit(1)).alias("copies")).select("*", F.size("of").alias("of_keys"), F.inline("of")).drop("of")
    mine = keys(queries, "s1_id").drop("copies")
    listed = keys(targets, "target_id").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).groupBy(*by).agg(F.collect_list(F.struct(held("target_id"), "n", "copy")).alias("targets"))
    parts = mine.groupBy(*by).count().join(listed.select(*by, F.size("targets").alias("size")), by).select(*by, F.ceil(F.col("count") * F.col("size") / PART).alias("parts"))
    many = 4 * int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    here = mine.join(parts, by).withColumn("part", F.pmod(F.xxhash64("s1_id"), "parts")).drop("parts").repartition(many, *by, "part")
    there = listed.join(parts, by).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts").repartition(many, *by, "part")
    met = here.join(there, [*by, "part"]).select(held("s1_id"), "n", "of_keys", "targets")
    one = met.where("of_keys = 1").drop("of_keys")
    several = met.where("of_keys > 1").select("s1_id", "n", F.explode("targets").alias("target")).distinct().groupBy("s1_id", "n").agg(F.collect_list("target").alias("targets")).repartition(many, "s1_id")
    ids = lambda judge: F.transform(F.filter("targets", lambda t: judge(F.col("n"), t["n"])), lambda t: t["target_id"])
    lists = one.unionByName(several).select("s1_id", "n", "targets", ids(accepted).alias("anchors"))
    # A function with a lambda stands outside compiled code, so rows of the first explode pass one by one; both in one loop would hold all rows of a query at once.
    turned_down = ids(lambda n, m: ~accepted(n, m))
    return lists.select("s1_id", "anchors", F.explode(turned_down).alias("target_id")).select("s1_id", "target_id", F.explode("anchors").alias("anchor_id"))


def one_hop(anchors: DataFrame, targets: DataFrame, column: str, cap: int, k: int = 3) -> DataFrame:
    """Accepted targets asked again as queries; what they find is brought back to the owner, with its best anchor by rank."""
    as_query = targets.join(anchors.select("target_id").distinct(), "target_id", "left_semi").withColumnRenamed("target_id", "entity_id")
    found = token_route(as_query, targets, column, cap, k).withColumnRenamed("s1_id", "anchor_id").where("anchor_id <> target_id")
    return anchors.select("s1_id", F.col("target_id").alias("anchor_id"), F.col("prob").alias("anchor_probability")).join(found, "anchor_id").groupBy("s1_id", "target_id").agg(F.max_by("anchor_id", F.struct("anchor_probability", "anchor_id")).alias("anchor_id"), F.max("anchor_probability").alias("anchor_probability"))
