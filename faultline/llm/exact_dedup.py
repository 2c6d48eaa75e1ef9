"""Exact dedup by deterministic block naming in DataFrame functions: sorted blocks get integer names, pairs of names new ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, carried, partitions

#: Bytes of a block.
BLOCK = 2_048


def numbered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """fl_rid, doc_id, fl_bytes (the text in UTF-8; null text is empty), fl_sha (its SHA-256) of every row, written, so that row
    numbers hold whenever it is read again.
    """
    return scratch.keep(_readied(docs.select(F.monotonically_increasing_id().alias("fl_rid"), "doc_id", "text")))


def _readied(rows: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return rows.select("fl_rid", "doc_id", text.cast("binary").alias("fl_bytes"), F.sha2(text, 256).alias("fl_sha"))


def blocks(rows: DataFrame, size: int, hashed: Callable[[Column], Column]) -> DataFrame:
    """fl_rid, place, h (a hash of the block), block of every block of `size` bytes; an empty text has one empty block."""
    last = F.floor(F.greatest(F.length("fl_bytes") - 1, F.lit(0)) / size).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col("fl_bytes"), i * size + 1, F.lit(size)))
    d = rows.select("fl_rid", F.posexplode(cut).alias("place", "block"))
    return d.select("fl_rid", "place", hashed(F.col("block")).alias("h"), "block")


def in_order(distinct: DataFrame, *keys: str) -> DataFrame:
    """distinct with `name`: integers that grow with the keys. Rows are range-sorted and numbered within their range."""
    return distinct.repartitionByRange(partitions(distinct.sparkSession), *keys).sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def block_names(cut: DataFrame, scratch: Scratch) -> DataFrame:
    """fl_rid, place, name of blocks(): equal names for equal blocks and no others. Blocks are sorted by hash, then bytes.

    Only distinct blocks are shuffled, once: those of a hash meet as a set, which has one block unless hashes collide, and what is
    sorted and joined is the hash alone. Blocks of colliding hashes, if there are any, are joined by their bytes.
    """
    sets = cut.groupBy("h").agg(F.sort_array(F.collect_set("block")).alias("same"))
    kept = sets.select("h", F.size("same").alias("n"), F.when(F.size("same") > 1, F.col("same")).alias("same"))
    kept = scratch.keep(in_order(kept, "h"))
    names = scratch.keep(kept.where("n = 1").select("h", "name"))
    out = cut.select("fl_rid", "place", "h").join(names, "h").select("fl_rid", "place", "name")
    if not kept.where("n > 1").isEmpty():
        # the other names are 0 or more
        rest = kept.where("n > 1").select("h", F.posexplode("same").alias("k", "block"))
        rest = scratch.keep(in_order(rest, "h", "k").select("h", "block", (-1 - F.col("name")).alias("name")))
        out = out.union(cut.join(rest, ["h", "block"]).select("fl_rid", "place", "name"))
    return out


def identities(rows: DataFrame, scratch: Scratch, size: int = BLOCK, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """fl_rid, level, name of numbered() rows: equal for equal texts and no others.

    A text's blocks have names; each level names the pairs of neighbours, a last one without a neighbour pairs with none, and a
    document is done when one name is left. Texts of one level have names of one table, and a name stands for one pair, so level
    and name stand for one text.
    """
    now = scratch.keep(block_names(blocks(rows, size, hashed), scratch))
    done, level = None, 0
    while True:
        # the documents with a second name go on
        more = now.where("place = 1").select("fl_rid")
        whole = now.where("place = 0").join(more, "fl_rid", "left_anti").select("fl_rid", F.lit(level).alias("level"), "name")
        done = whole if done is None else done.union(whole)
        going = now.join(more, "fl_rid", "left_semi")
        at = lambda k: F.max(F.when(F.col("place") % 2 == k, F.col("name")))
        pairs = going.groupBy("fl_rid", F.floor(F.col("place") / 2).cast("int").alias("up")).agg(at(0).alias("one"), at(1).alias("two"))
        pairs = scratch.keep(pairs.withColumnRenamed("up", "place"))
        if pairs.isEmpty():
            return done
        names = scratch.keep(in_order(pairs.select("one", "two").distinct(), "one", "two"))
        same = pairs.join(names.select(F.col("one").alias("fl_one"), F.col("two").alias("fl_two"), F.col("name").alias("named")), (F.col("one") == F.col("fl_one")) & F.col("two").eqNullSafe(F.col("fl_two")))
        now, level = scratch.keep(same.select("fl_rid", "place", F.col("named").alias("name"))), level + 1


def _members(rows: DataFrame, scratch: Scratch) -> DataFrame:
    named = scratch.keep(identities(rows, scratch).join(rows.select("fl_rid", "doc_id", "fl_sha"), "fl_rid"))
    groups = named.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    d = named.join(groups, ["level", "name"])
    # equal rows can share the largest doc_id: the one with the smallest number stays
    last = d.where("doc_id <=> keep_id").groupBy("level", "name").agg(F.min("fl_rid").alias("fl_stays"))
    return d.join(last, ["level", "name"]).withColumn("kept", F.col("fl_rid") == F.col("fl_stays"))


def grouped(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of docs.

    Rows whose texts are the same code points are a group; null text is empty text. Of a group the row with the largest doc_id is kept
    (null is the smallest; of rows with one doc_id, one). Long texts are as many blocks as they need, ties and repeated rows are
    members like any other, other columns don't matter. No rows: no rows.
    """
    d = _members(numbered(docs, scratch), scratch)
    return d.select("doc_id", "keep_id", "group_size", "kept", F.col("fl_sha").alias("text_sha256"))


def deduplicated(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs without the rows that grouped() doesn't keep, with all their columns."""
    rows = scratch.keep(carried(docs).withColumn("fl_rid", F.monotonically_increasing_id()))
    kept = _members(_readied(rows.select("fl_rid", "fl_all.doc_id", "fl_all.text")), scratch).where("kept")
    return rows.join(kept.select("fl_rid"), "fl_rid", "left_semi").select("fl_all.*")
