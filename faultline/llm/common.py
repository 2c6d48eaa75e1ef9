"""Shared plumbing of the corpus operators: durable intermediates, sorted-stream grouping, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session, else, in one process only, a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            return found.get()
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="faultline-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def schema_with(schema: StructType, more: str) -> StructType:
    """The schema with the fields of a DDL string behind its own."""
    return StructType([*schema.fields, *StructType.fromDDL(more).fields])


def carried(docs: DataFrame, *needed: str) -> DataFrame:
    """The needed columns beside fl_all, a struct of all columns, so that no other name of the table can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("fl_all"), *needed)


class Scratch:
    """Parquet tables in the shared folder that cut lineage and survive the loss of executors.

    A table stays until drop(); what a returned DataFrame still reads must not be dropped.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/t{self.n:03d}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.n += 1
        out._faultline_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_faultline_path", None)
        if path:
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


#: Bits of the map of wanted values in maybe_wanted for each of them, and of the smallest and the largest map (16 MB), in rows of WORDS_A_ROW longs.
BITS_A_VALUE, LEAST_BITS, MOST_BITS, WORDS_A_ROW = 64, 1 << 20, 1 << 27, 512


def maybe_wanted(rows: DataFrame, column: str, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows whose `column` is among the values of the same column of wanted, and few others: a bitmap over hashes is broadcast, so
    rows that can't match go before they are shuffled. An exact join has to settle the rest. The map grows with the
    wanted values up to MOST_BITS; where that is under 4 bits a value it would let most rows through, and all rows are returned.
    """
    n = wanted.count()
    if n * 4 > MOST_BITS:
        return rows
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (n * BITS_A_VALUE).bit_length()))
    place = lambda: F.pmod(F.xxhash64(column), F.lit(bits))
    bit, word = F.col("fl_map_place").bitwiseAND(F.lit(63)).cast("int"), F.shiftright("fl_map_place", 6)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    words = wanted.select(place().alias("fl_map_place")).groupBy(word.alias("word")).agg(F.bit_or(one).alias("bits"))
    entries = F.map_from_entries(F.collect_list(F.struct((F.col("word") % WORDS_A_ROW).cast("int").alias("k"), "bits")))
    table = words.groupBy(F.floor(F.col("word") / WORDS_A_ROW).alias("fl_map_row")).agg(entries.alias("m"))
    table = table.select("fl_map_row", F.transform(F.sequence(F.lit(0), F.lit(WORDS_A_ROW - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0).cast("long"))).alias("fl_map_bits"))
    table = F.broadcast(scratch.keep(table))
    met = rows.withColumn("fl_map_place", place()).join(table, F.floor(F.shiftright("fl_map_place", 6) / WORDS_A_ROW) == F.col("fl_map_row"))
    return met.where(F.getbit(F.get("fl_map_bits", (word % WORDS_A_ROW).cast("int")), bit) == 1).select(*[F.col(f"`{c}`") for c in rows.columns])


def runs(batches: Iterator[pd.DataFrame], keys: list[str], limit: int) -> Iterator[tuple[pd.DataFrame, bool]]:
    """Groups of equal keys with two rows or more, from frames sorted by keys; rows alone are skipped.

    A group of more than `limit` rows comes out in parts, each marked True, so at most `limit` rows and one batch are held.
    """
    held: list[pd.DataFrame] = []
    size, big, key = 0, False, None

    def part() -> pd.DataFrame:
        return pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]

    for frame in batches:
        if not len(frame):
            continue
        values = [frame[k].to_numpy() for k in keys]
        same = np.ones(len(frame) - 1, bool)
        for v in values:
            same &= v[1:] == v[:-1]
        cuts = np.concatenate(([0], np.flatnonzero(~same) + 1, [len(frame)]))
        first = 0
        if key == tuple(v[0] for v in values):
            held.append(frame.iloc[: cuts[1]])
            size += cuts[1]
            first = 1
        if first == 0 or len(cuts) > 2 or size > limit:
            if size > 1 or big and size:
                yield part(), big or size > limit
            big = size > limit or big
            held, size = [], 0
        if first and len(cuts) == 2:
            continue
        lengths = np.diff(cuts)
        for i in np.flatnonzero(lengths[first:-1] > 1) + first:
            yield frame.iloc[cuts[i] : cuts[i + 1]], bool(lengths[i] > limit)
        held, size, big, key = [frame.iloc[cuts[-2] :]], int(lengths[-1]), False, tuple(v[-1] for v in values)
        if size > limit:
            yield part(), True
            held, size, big = [], 0, True
    if size > 1 or big and size:
        yield part(), big


def array_runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """The columns of each group of equal keys with two rows or more, whole, from frames sorted by keys."""
    parts: list[dict[str, np.ndarray]] = []
    key = None

    def whole() -> dict[str, np.ndarray]:
        return parts[0] if len(parts) == 1 else {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}

    for frame in batches:
        if not len(frame):
            continue
        columns = {c: frame[c].to_numpy() for c in frame.columns}
        same = np.ones(len(frame) - 1, bool)
        for k in keys:
            same &= columns[k][1:] == columns[k][:-1]
        cuts = np.concatenate(([0], np.flatnonzero(~same) + 1, [len(frame)]))
        part = lambda i: {c: v[cuts[i] : cuts[i + 1]] for c, v in columns.items()}  # noqa: B023, E731
        goes_on = bool(parts) and key == tuple(columns[k][0] for k in keys)
        if goes_on:
            parts.append(part(0))
        if parts and (not goes_on or len(cuts) > 2):
            group = whole()
            parts = []
            if len(group[keys[0]]) > 1:
                yield group
        for i in np.flatnonzero(np.diff(cuts[:-1]) > 1).tolist():
            if i or not goes_on:
                yield part(i)
        if not parts:
            parts = [part(len(cuts) - 2)]
        key = tuple(columns[k][-1] for k in keys)
    if parts and len((group := whole())[keys[0]]) > 1:
        yield group


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every node on an edge (a, b); root is the smallest node reachable.

    Alternating large-star and small-star rounds, each a pre-aggregated minimum and one join, written to the
    shared folder; O(log n) rounds in practice, no node's neighbours ever meet in one task's memory.
    """
    e = scratch.keep(edges.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct())
    seen = None
    while True:
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(e.select("lo", "lo")).distinct() if mark[0] else e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        seen = mark
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(least, "hi")
            .select(F.explode(F.array(F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("hi").alias("hi"), F.col("m").alias("lo")))).alias("x"))
            .select("x.*").where("hi <> lo").distinct()
        )
        new = scratch.keep(small.select("lo", "hi"))
        scratch.drop(e)
        e = new
