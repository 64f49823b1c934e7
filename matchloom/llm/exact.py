"""Exact deduplication: frequent digests are settled map-side, the rest by an ordinary shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import SPACE, cut, text_of


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tracked: int = 4096) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical once each run of ASCII spaces is one space; a null text is the
    empty text, and all empty texts form one group. The smallest id of a group stays; rows repeated
    under that id are one document and all stay. A null id never wins over another id, and a group
    of null ids only keeps all of its rows. Other columns are ignored; an empty table gives no rows.

    Misra-Gries counters, merged over map tasks, find every digest that holds more than about
    2/``tracked`` of the rows. All of these, at most ``tracked``, are counted exactly and the
    verified ones broadcast, so their rows never shuffle; what remains holds at most that part of
    the rows in one group.
    """
    sha = F.unhex(F.sha2(F.regexp_replace(text_of(text_col), SPACE, " "), 256))
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), sha.alias("sha"))).withColumn("mark", F.xxhash64("sha"))
    found = rows.agg(F.expr(f"approx_top_k(mark, {tracked}, {tracked})").alias("top")).first()["top"] or []
    suspects = [r["item"] for r in found if r["count"] > 1]

    def finish(df: DataFrame) -> DataFrame:
        return df.select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))

    group = Window.partitionBy("sha")
    shuffled = lambda df: df.select("doc_id", "sha", F.min("doc_id").over(group).alias("keep_id"), F.count(F.lit(1)).over(group).alias("group_size"))
    if not suspects:
        return finish(shuffled(rows))
    winners = cut(rows.where(F.col("mark").isin(suspects)).groupBy("sha").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1"))
    is_heavy = F.col("mark").isin(suspects)
    light = rows.where(~is_heavy)
    settled = rows.where(is_heavy).join(F.broadcast(winners), "sha", "left").select("doc_id", "sha", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"))
    return finish(shuffled(light).unionByName(settled))


ORACLE_SQL = r"""
with t as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents),
g as (select text_sha256, min(doc_id) as keep_id, count(*) as group_size from t group by text_sha256)
select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, t.text_sha256 from t join g using (text_sha256)
"""
