"""Change sets and event logs as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import risk

CHANGED = "analysis_id long, ord long, path string, arrived timestamp"


def changed_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Rows of changed files from parquet files that land in a folder."""
    return spark.readStream.schema(CHANGED).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def score_stream(changed: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Rule evidence of each micro-batch, appended to a folder; a batch that runs twice overwrites its own part."""
    rules = risk.builtin_rules(changed.sparkSession)

    def batch(df: DataFrame, n: int) -> None:
        hits = risk.rule_hits(df.select("analysis_id", "ord", "path"), rules)
        risk.rule_evidence(hits).withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/batch={n}")

    writer = changed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def hits_by_window(changed: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Matches of each rule in windows of arrival time; rows later than the watermark drop out."""
    rules = risk.builtin_rules(changed.sparkSession)
    hits = risk.rule_hits(changed.withWatermark("arrived", late), rules)
    return hits.groupBy(F.window("arrived", length), "signal").agg(F.count("*").alias("n"))
