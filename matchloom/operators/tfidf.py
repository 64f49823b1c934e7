"""Sparse TF-IDF retrieval: weights in long form (key, term, weight), products of whole rows block by block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions import text
from matchloom.operators.blocks import FEW, LONG, QUERIES, ROWS, best_rows, blocks, sparse_pairs, sparse_products


def digest(field: str) -> Column:
    return F.md5(F.col(field).cast("binary"))


def dictionary(rows: DataFrame, field: str) -> DataFrame:
    """Distinct raw strings and how many rows bear them; a key is its string's 128-bit digest."""
    return rows.groupBy(field).agg(F.count(F.lit(1)).alias("n_ids")).select(digest(field).alias("key"), F.col(field).alias("raw"), "n_ids")


def members(rows: DataFrame, field: str, id_col: str) -> DataFrame:
    """(key, id), one row each: a string that many rows bear is never one long list."""
    return rows.select(digest(field).alias("key"), id_col)


def word_terms(c: Column) -> Column:
    """Words and pairs of neighbours."""
    words = F.filter(F.split(text.norm(c), " "), lambda t: t != "")
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, F.filter(pairs, lambda p: p.contains(" ")))


def char_terms(c: Column, low: int = 3, high: int = 4) -> Column:
    return F.concat(*[text.char_grams(c, n) for n in range(low, high + 1)])


def term_counts(keys: DataFrame, terms: Column) -> DataFrame:
    return keys.select("key", F.explode(terms).alias("term")).groupBy("key", "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(counts: DataFrame, n: DataFrame, min_df: int = 2, max_df: float = 0.8, most: int = 200_000) -> DataFrame:
    """Terms within the frequency limits, the ``most`` commonest by count, numbered in this order, with smooth idf; ``n`` is a one-row count of keys."""
    seen = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")).join(F.broadcast(n.select("n")), F.col("df") <= F.col("n"))
    seen = seen.where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n"))).orderBy(F.desc("cf"), "term").limit(most)
    seen = seen.withColumn("id", F.row_number().over(Window.orderBy(F.desc("cf"), "term")))  # over ``most`` rows at most
    return seen.select("term", "id", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1).alias("idf"))


def weights(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """Sublinear tf times idf, each key's row of length one."""
    raw = counts.join(vocab, "term").select("key", "term", "id", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("key")))  # over a string's own terms
    return raw.select("key", "term", "id", (F.col("w") / norm).alias("w"))


def strongest(w: DataFrame, k: int) -> DataFrame:
    at = Window.partitionBy("key").orderBy(F.desc(F.round("w", 9)), "term")
    return w.withColumn("rk", F.row_number().over(at)).where(F.col("rk") <= k).drop("rk")


def sparse_rows(w: DataFrame, name: str) -> DataFrame:
    """A key's whole vector in one row: its term numbers and weights."""
    pairs = w.groupBy("key").agg(F.collect_list(F.struct("id", "w")).alias("p"))
    return pairs.select(F.col("key").alias(name), F.col("p.id").alias("ids"), F.col("p.w").alias("ws"))


def top_products(q: DataFrame, t: DataFrame, k: int, n_queries: int, n_targets: int) -> DataFrame:
    """(q_key, t_key, cosine, rk): the ``k`` keys of greatest product among those that share a term; ties by key.

    ``q`` and ``t`` are weights; the counts of keys set the number of blocks. No pair is ever a row
    unless it is among its block's best, however common a term is.
    """
    found = best_rows(sparse_rows(q, "q_key"), sparse_rows(t, "t_key"), sparse_products, k, n_queries, n_targets, floor=-1)
    return found.withColumnRenamed("score", "cosine")


def shortlist(q: DataFrame, t: DataFrame, n_queries: int = 1, n_targets: int = 1, terms: int = 16, most: int = 300, k: int = 100) -> DataFrame:
    """Keys shortlisted by a query's strongest terms, then ranked by their full vectors.

    Where a block of keys proposes its best, it scores them in full as well, so no pair meets its terms again.
    Inside, keys are bytes, which have the order of their digits.
    """
    at = Window.partitionBy("key").orderBy(F.desc(F.round("w", 9)), "term")
    bits = F.struct("id", "w")
    mine = q.withColumn("rk", F.row_number().over(at)).groupBy("key").agg(F.collect_list(bits).alias("p"), F.collect_list(F.when(F.col("rk") <= terms, bits)).alias("s"))
    mine = mine.select(F.unhex("key").alias("q_key"), F.col("s.id").alias("ids"), F.col("s.w").alias("ws"), F.col("p.id").alias("all_ids"), F.col("p.w").alias("all_ws"))
    theirs = sparse_rows(t, "t_key").withColumn("t_key", F.unhex("t_key"))
    short = best_rows(mine, theirs, sparse_products, most, n_queries, n_targets, floor=-1, exact=sparse_pairs).drop("rk", "score")
    at = Window.partitionBy("q_key").orderBy(F.desc("exact"), "t_key")
    found = short.withColumn("rk", F.row_number().over(at)).where(F.col("rk") <= k)
    digits = lambda c: F.lower(F.hex(c)).alias(c)
    return found.select(digits("q_key"), digits("t_key"), F.col("exact").alias("cosine"), "rk")


def expand(found: DataFrame, queries: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """Keys back to ids, a key's ids in order, until ``k`` of a query. ``queries`` and ``targets`` are members."""
    first = Window.partitionBy("key").orderBy("target_id")
    t = targets.withColumn("pos", F.row_number().over(first)).where(F.col("pos") <= k).withColumnRenamed("key", "t_key")  # no query takes more of a key
    at = Window.partitionBy("s1_id").orderBy("rk", "pos")
    return found.join(t, "t_key").join(queries.withColumnRenamed("key", "q_key"), "q_key").withColumn("rn", F.row_number().over(at).cast("long")).where(F.col("rn") <= k).select("s1_id", "target_id", "cosine", "rn")


def retrieve(queries: DataFrame, targets: DataFrame, field: str, terms, k: int, shortlisted: tuple[int, int, int] | None = None, **limits) -> DataFrame:
    """Fit on targets, transform queries, rank by exact cosine. ``queries`` and ``targets`` have s1_id and target_id.

    ``shortlisted``: strongest terms, keys of the shortlist and keys kept, where not all keys are compared in full.
    """
    tk, qk = dictionary(targets, field), dictionary(queries, field)
    tc, qc = term_counts(tk, terms(F.col("raw"))), term_counts(qk, terms(F.col("raw")))
    vocab = vocabulary(tc, tk.agg(F.count(F.lit(1)).alias("n")), **limits)
    sizes = blocks(queries, FEW if shortlisted else QUERIES), blocks(targets, LONG if shortlisted else ROWS)  # rows bound keys
    q, t = weights(qc, vocab), weights(tc, vocab)
    found = shortlist(q, t, *sizes, *shortlisted) if shortlisted else top_products(q, t, k, *sizes)
    found = found.where(F.col("rk") <= k)  # each key has an id at least, so later keys add none
    return expand(found, members(queries, field, "s1_id"), members(targets, field, "target_id"), k)
