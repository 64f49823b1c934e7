"""URL filter: a blocked Bloom filter passes possible hits to an exact hash join."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import cut

#: Bits of a block are the 64 bits of a long; this many are set for each key.
PROBES = 4
#: Words of a filter that may be broadcast, 16 bytes each in a hashed relation; a larger filter is shuffled.
MOST_BROADCAST = 1 << 21
#: Parts that the urls of one host are dealt to where they meet the list.
SALTS = 32


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and where no ``://`` stands."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _mask(key: Column) -> Column:
    h = F.xxhash64(F.lit(1), key)
    return F.aggregate(F.transform(F.array(*[F.lit(6 * i) for i in range(PROBES)]), lambda s: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.call_function("shiftright", h, s), F.lit(64)).cast("int"))), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


class Bloom:
    """A blocked Bloom filter of ``keys`` (distinct strings): one 64-bit word a block, four keys a word.

    The filter grows with its keys. Up to ``MOST_BROADCAST`` words it is broadcast, and probing is a
    map-side join on the block number; beyond, words and probes meet in a shuffle.
    """

    def __init__(self, keys: DataFrame, count: int):
        self.blocks = max(64, 1 << math.ceil(math.log2(count / 4 + 1)))
        words = keys.select(_block(F.col("key"), self.blocks).alias("__block"), _mask(F.col("key")).alias("__m")).groupBy("__block").agg(F.bit_or("__m").alias("__word"))
        self.words = F.broadcast(words) if self.blocks <= MOST_BROADCAST else words

    def possible(self, probes: DataFrame) -> DataFrame:
        """The rows whose ``key`` may be one of the keys."""
        marked = probes.withColumn("__block", _block(F.col("key"), self.blocks)).withColumn("__mask", _mask(F.col("key")))
        return marked.join(self.words, "__block").where(F.col("__word").bitwiseAND(F.col("__mask")) == F.col("__mask")).select(*probes.columns)


def filter_urls(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per input row: ``page_id, host, path, rule, verdict``.

    ``listed`` holds canonical entries ``host, path, verdict``; an entry fits its host and all
    subdomains where the url's path starts with the entry's. The entry with the longest host, then
    the longest path, wins; of entries listed twice, block wins. A url that no listed entry fits gets ``default``
    and a null rule. Null urls and those without ``://`` have empty host and path. Entries with a
    null or empty host fit nothing. An empty list gives every url the default; empty ``pages`` give
    no rows; repeated rows are judged alike; ids may be of any type; other columns are ignored.

    Hosts come first: each distinct host's suffixes probe the filter of listed hosts, and an exact
    hash join with these leaves the listed hosts that fit. Only urls of such hosts go on, with one
    key for each path length that one of their own listed hosts has. These keys probe the filter of
    listed urls, and what passes meets the list in an exact hash join, which removes false positives.
    """
    entries = listed.where("host <> ''").select("host", F.coalesce("path", F.lit("")).alias("path"), "verdict").groupBy("host", "path").agg(F.max("verdict").alias("listed"))
    entries = cut(entries.withColumn("key", F.concat_ws("\t", "host", "path")))
    hosts = cut(entries.groupBy(F.col("host").alias("key")).agg(F.sort_array(F.collect_set(F.length("path"))).alias("lengths")))

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("__url"))
    host, path = url_parts(F.col("__url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    urls = rows.where("host <> ''").select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = urls.select("host").distinct().select("host", F.explode(suffixes).alias("key"))
    fitting = Bloom(hosts, hosts.count()).possible(asked).join(hosts, "key").groupBy("host").agg(F.collect_list(F.struct("key", "lengths")).alias("fits"))
    # a host's urls are dealt out by their paths, as one host may have very many
    salted = fitting.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = urls.withColumn("__salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int")).join(salted, ["host", "__salt"])
    heads = lambda f: F.transform(F.filter(f["lengths"], lambda n: n <= F.length("path")), lambda n: F.concat_ws("\t", f["key"], F.substring("path", F.lit(1), n)))
    probes = met.select(F.col("host").alias("h"), F.col("path").alias("p"), F.explode(F.flatten(F.transform("fits", heads))).alias("key"))
    possible = Bloom(entries, entries.count()).possible(probes)
    hits = possible.join(entries.select("key", F.col("host").alias("eh"), F.col("path").alias("ep"), "listed"), "key")
    best = hits.groupBy("h", "p").agg(F.max(F.struct(F.length("eh").alias("a"), F.length("ep").alias("b"), F.concat("eh", "ep").alias("rule"), "listed")).alias("best"))
    out = rows.join(best, (rows["host"] == best["h"]) & (rows["path"] == best["p"]), "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.listed", F.lit(default)).alias("verdict"))


#: The listed entries that the query applies (host, path, verdict).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def query(spark, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), listed)


ORACLE_SQL = r"""
with r(h, p, v) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
q as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') as path from u),
m as (select q.page_id, arg_max(r.h || r.p, length(r.h) * 1000 + length(r.p)) as rule, arg_max(r.v, length(r.h) * 1000 + length(r.p)) as v
      from q join r on (q.host = r.h or ends_with(q.host, '.' || r.h)) and starts_with(q.path, r.p) group by q.page_id)
select q.page_id, q.host, q.path, m.rule, coalesce(m.v, 'allow') as verdict from q left join m using (page_id)
"""
