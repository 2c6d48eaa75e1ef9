"""SimHash near-dedup by covering locality-sensitive hashing."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, carried, connected_components, partitions, runs, schema_with

BITS = 64
#: A bucket of more distinct fingerprints than this is split by a second covering family over its free bits.
SPLIT_ABOVE = 1 << 13


def covering_masks(radius: int, bits: list[int], seed: int) -> list[int]:
    """2 ** (radius + 1) - 1 masks over `bits` such that any two numbers that differ in at most `radius` of these bits
    agree under some mask: each bit gets a nonzero vector over GF(2), dealt out evenly, and mask v keeps the bits whose
    vectors have an odd inner product with v. The vectors of `radius` differing bits leave a nonzero v orthogonal to all.
    """
    rng = random.Random(seed)
    vectors = list(range(1, 1 << (radius + 1)))
    dealt: list[int] = []
    while len(dealt) < len(bits):
        rng.shuffle(vectors)
        dealt += vectors
    return [sum(1 << b for b, m in zip(bits, dealt) if (m & v).bit_count() & 1) for v in range(1, 1 << (radius + 1))]


def simhash(text: str | None, words: int = 3) -> int:
    """64-bit SimHash of the text's word shingles, repeats included; 0 without words."""
    if not text:
        return 0
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    h = xxhash.xxh64_intdigest
    if len(w) <= words:
        return h(b" ".join(w), 42)
    line = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(w) - words + 1
    hashes = np.fromiter((h(line[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[words - 1 :].tolist())), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):  # whole texts of any length in bounded memory
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, text_hash, fp (the SimHash as a signed long) of every row; null text counts as empty."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            fp = np.fromiter((simhash(t, words) for t in f["text"]), np.uint64, len(f))
            yield pd.DataFrame({"doc_id": f["doc_id"], "text_hash": f["text_hash"], "fp": fp.view(np.int64)})

    own = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return own.mapInPandas(each, schema_with(own.drop("text").schema, "fp long"))


def _star(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each fingerprint to the first one of its connected part, for parts of two or more."""
    n, label = len(fps), np.arange(len(fps))
    bits = fps.view(np.uint64)
    for i in range(n - 1):
        near = np.flatnonzero(np.bitwise_count(bits[i + 1 :] ^ bits[i]) <= radius) + i + 1
        if len(near):
            old = np.unique(label[near])
            low = min(old[0], label[i])
            if len(old) > 1 or old[0] != label[i]:
                label[np.isin(label, np.append(old, label[i]))] = low
    other = np.flatnonzero(label != np.arange(n))
    return fps[label[other]], fps[other]


def _linked(buckets: DataFrame, keys: list[str], radius: int, limit: int, n: int) -> DataFrame:
    """(a, b, rest) from (keys, fp): spanning edges within each bucket; of buckets above limit, the rows (fp, fp, keys)."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g, big in runs(frames, keys, limit):
            if big:
                yield pd.DataFrame({"a": g["fp"], "b": g["fp"], "t": g[keys[0]].astype("int32"), "key": g[keys[-1]]})
            else:
                a, b = _star(g["fp"].to_numpy(), radius)
                if len(a):
                    yield pd.DataFrame({"a": a, "b": b, "t": np.int32(-1), "key": 0})

    return buckets.repartition(n, *keys).sortWithinPartitions(*keys, "fp").mapInPandas(each, "a long, b long, t int, key long")


def near_links(fps: DataFrame, scratch: Scratch, radius: int = 3, seed: int = 4, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """(a, b): edges that connect exactly the distinct fingerprints (fp) that differ in at most `radius` bits.

    Each covering mask makes a table of buckets; within a bucket the links are reduced to stars, so a group of copies
    gives as many edges as it has members. A bucket above `split_above` leaves its task and is split by a second
    covering family over the bits its mask leaves free; what still agrees differs in at most 64 - 34 - 16 = 14 bits or so,
    which bounds the bucket at about 2 ** 14 fingerprints, whatever the input.
    """
    n = partitions(fps.sparkSession)
    masks = covering_masks(radius, list(range(BITS)), seed)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    table = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("t", "key")
    out = scratch.keep(_linked(fps.select("fp", table), ["t", "key"], radius, split_above, n))
    edges = out.where("t < 0").select("a", "b")
    rest = out.where("t >= 0")
    if not rest.isEmpty():
        second = []
        for m in masks:
            free = [i for i in range(BITS) if not m >> i & 1]
            both = [m | x for x in covering_masks(radius, free, seed + 1)]
            second.append([x - (1 << 64) if x >> 63 else x for x in both])
        inner = F.array(*[F.array(*[F.lit(x) for x in row]) for row in second])
        again = rest.select(F.col("a").alias("fp"), "t", F.posexplode(F.element_at(inner, F.col("t") + 1)).alias("t2", "mask"))
        again = again.select("fp", (F.col("t") * 64 + F.col("t2")).cast("int").alias("t"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
        edges = edges.union(scratch.keep(_linked(again, ["t", "key"], radius, 1 << 62, n).select("a", "b")))
    return edges


def _roots(marked: DataFrame, scratch: Scratch, radius: int) -> DataFrame:
    """(fp, root) of every distinct fingerprint; root is the smallest fingerprint reachable."""
    each = scratch.keep(marked.select("fp").distinct())
    roots = connected_components(near_links(each, scratch, radius), scratch)
    return scratch.keep(each.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")))


def near_components(docs: DataFrame, scratch: Scratch, radius: int = 3, words: int = 3) -> DataFrame:
    """doc_id, fp, component_id of every row of docs (doc_id, text).

    Documents link where their fingerprints differ in at most `radius` bits; component_id is the smallest doc_id
    reachable. Empty and null texts have fingerprint 0 and link like any other; a row without doc_id belongs to its
    fingerprint's component (which is null if no row there has an id); repeated rows come out repeated.
    No rows: no rows.
    """
    marked = scratch.keep(fingerprints(docs, words))
    roots = _roots(marked, scratch, radius)
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("least")).join(roots, "fp")
    smallest = least.groupBy("root").agg(F.min("least").alias("component_id"))
    of = scratch.keep(roots.join(smallest, "root").select("fp", "component_id"))
    return marked.join(of, "fp").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def deduplicated(docs: DataFrame, scratch: Scratch, radius: int = 3, words: int = 3) -> DataFrame:
    """One row of each group of near copies, columns as in docs: the one with the smallest doc_id, rows without one
    last, then the smallest text hash; of rows equal in both (ties, repeated rows), any one. Null and empty texts are a group of their
    own, texts count whole whatever their length, other columns are carried under no name of ours. No rows: no rows.
    """
    marked = scratch.keep(fingerprints(docs, words))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("x")
    least = marked.groupBy("fp").agg(first).join(_roots(marked, scratch, radius), "fp")
    keep = least.groupBy("root").agg(F.min("x").alias("x")).select(F.col("x.doc_id").alias("fl_id"), F.col("x.text_hash").alias("fl_hash"))
    keep = scratch.keep(keep.distinct())
    rows = carried(docs, "doc_id", "text").withColumn("fl_text", F.xxhash64("text")).drop("text")
    kept = rows.join(keep, (rows["fl_text"] == keep["fl_hash"]) & rows["doc_id"].eqNullSafe(keep["fl_id"]))
    one = F.row_number().over(Window.partitionBy("fl_text", "fl_id").orderBy("fl_text"))
    return kept.withColumn("fl_row", one).where("fl_row = 1").select("fl_all.*")
