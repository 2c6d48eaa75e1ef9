"""Parsed-file facts kept by content, so that a tree is parsed again only where its texts are new."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import paths as P
from ..plans.durable import keep
from . import parsers

#: Folders of the cache; a content's hash says which one is its.
BUCKETS = 64
#: Facts of a parsed file, beside what hangs on its path.
FACTS = ["package_name", "imports", "defined_classes", "defined_functions", "framework_signals", "package_deps", "exports", "db_tables", "parse_status", "api_routes", "class_symbols", "function_symbols"]
#: Languages whose facts are not kept: their texts are not parsed.
PLAIN = ["text", "generic"]


def _stored(spark: SparkSession, folder: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.parquet(folder)


def _keyed(files: DataFrame) -> DataFrame:
    return files.withColumns({
        "file_hash": F.sha2(F.coalesce("text", F.lit("")), 256), "fl_language": parsers.language(F.col("path")), "fl_suffix": P.suffix(F.lower("path")),
    }).where("fl_language IS NOT NULL")


def parse(files: DataFrame, folder: str) -> DataFrame:
    """parsers.parse(files), with the facts of texts that the cache in `folder` has, and those it hasn't put into it.

    A text is looked up by its hash and its file's suffix, is parsed once however many files have it, and new facts are appended to
    the folders of their hashes. Files of languages without a parser are not looked up.
    """
    keyed, key = _keyed(files), ["file_hash", "fl_suffix"]
    own = [c for c in files.columns if c != "text"]
    stored = _stored(files.sparkSession, folder)
    plain = parsers.parse(keyed.where(F.col("fl_language").isin(PLAIN)).select(*files.columns))
    asked = keyed.where(~F.col("fl_language").isin(PLAIN))
    texts = asked.groupBy(*key).agg(F.min("path").alias("path"))
    hits = None if stored is None else keep(stored.drop("bucket").withColumnRenamed("suffix", "fl_suffix").join(texts.select(*key), key, "left_semi").dropDuplicates(key))
    new = texts if hits is None else texts.join(hits.select(*key), key, "left_anti")
    wanted = asked.join(new, [*key, "path"], "left_semi").dropDuplicates(key).select(*key, "path", "text")
    fresh = keep(parsers.parse(wanted).select(*key, "language", *FACTS))
    if not fresh.isEmpty():
        bucket = F.pmod(F.xxhash64("file_hash"), F.lit(BUCKETS)).alias("bucket")
        fresh.withColumnRenamed("fl_suffix", "suffix").select("*", bucket).repartition(BUCKETS, "bucket").write.mode("append").partitionBy("bucket").parquet(folder)
    facts = fresh if hits is None else hits.select(*fresh.columns).union(fresh)
    hit = asked.select(*own, *key).join(facts, key)
    return hit.select(*own, "language", *FACTS).unionByName(plain.select(*own, "language", *FACTS))


def misses(files: DataFrame, folder: str) -> int:
    """How many different texts of files the cache lacks."""
    keyed, stored = _keyed(files).where(~F.col("fl_language").isin(PLAIN)), _stored(files.sparkSession, folder)
    texts = keyed.select("file_hash", F.col("fl_suffix").alias("suffix")).distinct()
    return texts.count() if stored is None else texts.join(stored, ["file_hash", "suffix"], "left_anti").count()


def compact(spark: SparkSession, folder: str) -> None:
    """The cache with one file a bucket and one row a text: written beside the old one, then put in its place."""
    stored = _stored(spark, folder)
    if stored is None:
        return
    beside = f"{folder.rstrip('/')}-{uuid.uuid4().hex}"
    stored.dropDuplicates(["file_hash", "suffix"]).repartition(BUCKETS, "bucket").write.partitionBy("bucket").parquet(beside)
    path = spark._jvm.org.apache.hadoop.fs.Path
    old, new = path(folder), path(beside)
    system = old.getFileSystem(spark._jsc.hadoopConfiguration())
    spent = path(f"{beside}-old")
    if system.rename(old, spent) and system.rename(new, old):
        system.delete(spent, True)
