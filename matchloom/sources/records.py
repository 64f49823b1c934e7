"""Record tables: TSV and Parquet sources, id-list files, stage ledger, adapters onto the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """TSV with header and pinned types; empty fields become empty strings on every side."""
    return spark.read.csv(path, sep="\t", header=True, schema=RECORD, quote="").fillna("", ["business_name", "business_address"])


def read_columns(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def targets(second: DataFrame, third: DataFrame) -> DataFrame:
    """Both noisy tables as one, with their source."""
    both = second.withColumn("source", F.lit("S2")).unionByName(third.withColumn("source", F.lit("S3")))
    return both.withColumnRenamed("entity_id", "target_id")


def wanted_slice(records: DataFrame, wanted: DataFrame | None = None, skip: int = 0, maximum: int | None = None) -> DataFrame:
    """Rows of the wanted ids, in order of id, after ``skip``; ``maximum`` counts the skipped rows too."""
    rows = records if wanted is None else records.join(wanted, "entity_id", "left_semi")
    rows = rows.orderBy("entity_id")
    if maximum is not None:
        rows = rows.limit(maximum)
    return rows.offset(skip) if skip else rows


def encode_list(ids: Column) -> Column:
    return F.array_join(F.array_sort(ids), ",")


def decode_list(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(text, ","))


def list_length(text: Column) -> Column:
    """How many ids a list holds, by its commas."""
    ids = F.coalesce(text, F.lit(""))
    return F.when(ids == "", 0).otherwise(F.length(ids) - F.length(F.replace(ids, F.lit(","), F.lit(""))) + 1)


def list_rows(records: DataFrame, pairs: DataFrame, name: str = "candidate_entity_ids") -> DataFrame:
    """One row per record: its partners' ids, sorted and joined by commas; empty where it has none."""
    lists = pairs.groupBy(F.col("s1_id").alias("entity_id")).agg(encode_list(F.collect_set("target_id")).alias(name))
    return records.select("entity_id").join(lists, "entity_id", "left").select(F.col("entity_id").alias("source1_entity_id"), F.coalesce(name, F.lit("")).alias(name))


def list_pairs(lists: DataFrame, name: str = "candidate_entity_ids") -> DataFrame:
    return lists.select(F.col("source1_entity_id").alias("s1_id"), F.explode(decode_list(F.col(name))).alias("target_id"))


def write_list(lists: DataFrame, path: str) -> None:
    """List file in record order: sorted by range partitions, never in one task."""
    lists.orderBy("source1_entity_id").write.mode("overwrite").csv(path, sep="\t", header=True, emptyValue="", quote="")


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def stage(spark: SparkSession, path: str, build: Callable[[], DataFrame], partition_by: tuple[str, ...] = ()) -> DataFrame:
    """A stage's table: read where it was completed before, else built and written once. Overwrites are whole, so reruns are idempotent."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(conf).exists(done):
        build().write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return spark.read.parquet(path)


def lockstep(left: DataFrame, right: DataFrame, key: str = "source1_entity_id") -> DataFrame:
    """Ids that stand in one of two list files only; empty where they are in step."""
    a, b = left.select(key).withColumn("l", F.lit(1)), right.select(key).withColumn("r", F.lit(1))
    return a.join(b, key, "full_outer").where("l is null or r is null").select(key, F.col("l").isNotNull().alias("in_left"))


def merge_sparse(base: DataFrame, extra: DataFrame, name: str = "candidate_entity_ids") -> tuple[DataFrame, DataFrame]:
    """Base lists with those of a sparse file added, and the extra rows that no base row takes (an error if any)."""
    more = extra.select("source1_entity_id", decode_list(F.col(name)).alias("more"))
    merged = base.join(more, "source1_entity_id", "left").select("source1_entity_id", encode_list(F.array_union(decode_list(F.col(name)), F.coalesce("more", F.array().cast("array<string>")))).alias(name))
    return merged, extra.join(base, "source1_entity_id", "left_anti")


def resume(records: DataFrame, results: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records that a broken-off run still has to do, and ids that only one of its two outputs has (an error if any)."""
    done = results.select("source1_entity_id").union(candidates.select("source1_entity_id")).distinct()
    left = records.withColumnRenamed("entity_id", "source1_entity_id").join(done, "source1_entity_id", "left_anti")
    return left, lockstep(results, candidates)


def hash_order(*columns: str) -> list[Column]:
    return [F.xxhash64(*columns), *[F.col(c) for c in columns]]


def sample_rows(rows: DataFrame, key: str, count: int) -> DataFrame:
    """``count`` rows in order of a hash of their key: the same rows whatever the partitioning."""
    return rows.orderBy(*hash_order(key)).limit(count)


def sample_strata(rows: DataFrame, strata: list[str], key: str, count: int) -> DataFrame:
    """At most ``count`` rows of each stratum, in order of a hash of their key."""
    at = Window.partitionBy(*strata).orderBy(*hash_order(key))
    return rows.withColumn("__at", F.row_number().over(at)).where(F.col("__at") <= count).drop("__at")


def systematic(rows: DataFrame, order: str, step: int) -> DataFrame:
    """Every ``step``-th row in order: place within its range partition plus the rows of the partitions before.

    The second level is a window over one row for each partition; no task sees all rows.
    """
    dealt = rows.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("__part", F.spark_partition_id())
    dealt = dealt.persist(StorageLevel.DISK_ONLY)  # both levels must read one and the same ranges
    counts = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offset = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    at = F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1
    return dealt.withColumn("__at", at).join(F.broadcast(offset), "__part").where((F.col("__before") + F.col("__at")) % step == 0).drop("__part", "__at", "__before")


def shard_check(shards: list[DataFrame], whole: DataFrame, key: str = "source1_entity_id") -> DataFrame:
    """Rows by which shards and whole differ: missing, unknown or repeated ids."""
    parts = shards[0]
    for s in shards[1:]:
        parts = parts.unionByName(s)
    counted = parts.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return whole.select(key).withColumn("there", F.lit(1)).join(counted, key, "full_outer").where("n is null or there is null or n > 1").select(key, "n")


def _roles(rows: DataFrame, key: str) -> DataFrame:
    """Three roles by id: a third each of the whole table."""
    role = F.concat(F.lit("S"), (F.col(key) % 3 + 1).cast("string"))
    return rows.withColumn("source", role).withColumn("entity_id", F.concat_ws("-", role, F.col(key).cast("string")))


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: first line the name, the whole rest the address, language the country."""
    text = F.coalesce("text", F.lit(""))
    rows = _roles(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"), "doc_id")
    at = F.instr(text, "\n")
    return rows.select("entity_id", F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text).alias("business_name"), F.when(at > 0, F.substring(text, at + 1, F.length(text))).otherwise("").alias("business_address"), F.coalesce("lang", F.lit("")).alias("country"), "source")


def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as records: title the name, url the address, the page's language the country."""
    rows = _roles(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id")
    html = F.coalesce("html", F.lit(""))
    return rows.select("entity_id", F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1).alias("business_name"), F.coalesce("url", F.lit("")).alias("business_address"), F.regexp_extract(html, r'<html lang="([a-z]*)"', 1).alias("country"), "source")


def split_roles(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query records, target records)."""
    queries = records.where("source = 'S1'").drop("source")
    return queries, records.where("source <> 'S1'").withColumnRenamed("entity_id", "target_id")
