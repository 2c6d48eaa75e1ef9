"""Document fingerprints: context-triggered piecewise hashing, compared by edit distance at compatible block sizes."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, schema_with

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
WINDOW, SMALLEST, AIM = 7, 3, 64
#: Weight of the byte j places back in the rolling hash: its sum, its place in the window and its shifted value.
TAPS = [np.uint32((1 + WINDOW - j + (1 << 5 * j)) & 0xFFFFFFFF) for j in range(WINDOW)]
#: Bytes of text whose rolling hashes are held at once.
SLICE = 1 << 20


def _cuts(data: bytes, block: int) -> np.ndarray:
    """Where chunks end (exclusive) and the rolling hash + 1 there, for triggers at `block`."""
    raw = np.frombuffer(data, np.uint8)
    found, values = [], []
    for at in range(0, len(raw), SLICE):
        part = raw[max(0, at - WINDOW + 1) : at + SLICE].astype(np.uint32)
        n, lead = min(SLICE, len(raw) - at), min(at, WINDOW - 1)
        r = np.ones(n, np.uint32)
        for j, tap in enumerate(TAPS):
            if lead >= j:
                r += part[lead - j : lead - j + n] * tap
            elif n > j - lead:
                r[j - lead :] += part[: n - j + lead] * tap
        hit = np.flatnonzero(r % np.uint32(block) == 0)
        found.append(hit + at + 1)
        values.append(r[hit])
    return np.stack([np.concatenate(found), np.concatenate(values).astype(np.int64)]) if found else np.zeros((2, 0), np.int64)


def _signature(data: bytes, cuts: list[int]) -> str:
    """A letter for each chunk; of more than three equal letters in a row three stay."""
    out: list[str] = []
    for a, b in zip([0, *cuts], [*cuts, len(data)]):
        if a < b:
            c = LETTERS[zlib.crc32(data[a:b]) & 63]
            if out[-3:] != [c] * 3:
                out.append(c)
    return "".join(out)


def fingerprint(text: str | None) -> str:
    """block:signature:signature at twice the block. Triggers depend on seven bytes only, so an edit moves the letters
    of the chunks it touches and no other; the block grows with the text, so that about AIM letters come out.
    """
    data = (text or "").encode("utf-8", "surrogatepass")
    block = SMALLEST
    while block * AIM < len(data):
        block *= 2
    while True:
        cuts, value = _cuts(data, block)
        if len(cuts) >= AIM // 2 or block == SMALLEST:
            break
        block //= 2
    one, two = _signature(data, cuts.tolist()), _signature(data, cuts[value % (2 * block) == 0].tolist())
    while len(one) > 2 * AIM and block < len(data):  # far more triggers than chance gives
        block *= 2
        keep = value % block == 0
        cuts, value = cuts[keep], value[keep]
        one, two = two, _signature(data, cuts[value % (2 * block) == 0].tolist())
    return f"{block}:{one}:{two}"


def likeness(a: str, b: str) -> Column:
    """0 to 1 for two fingerprint columns: the best edit similarity of signatures of one block size; 0 if none is shared."""
    x, y = F.split(a, ":"), F.split(b, ":")
    block = lambda p: p[0].cast("long")

    def same(p: Column, q: Column) -> Column:
        longer = F.greatest(F.length(p), F.length(q))
        return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(p, q) / longer)

    equal = F.greatest(same(x[1], y[1]), F.when(F.length(x[2]) + F.length(y[2]) >= AIM // 2, same(x[2], y[2])).otherwise(0.0))
    return (
        F.when(F.col(a) == F.col(b), 1.0).when(block(x) == block(y), equal)
        .when(block(x) == 2 * block(y), same(x[1], y[2])).when(2 * block(x) == block(y), same(x[2], y[1])).otherwise(0.0)
    )


def with_next(docs: DataFrame, each, schema) -> DataFrame:
    """mapInPandas over rows beside the row that follows in descending doc_id (none last, then by text hash), the first
    after the last. Texts are shuffled once: rows go to ranges of doc_id, and the first row of a range also to the range
    before it. each(doc_id, text, next_text, memo) gives an output row.
    """
    spark = docs.sparkSession
    n = 4 * partitions(spark)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    splits = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100_000)).first()[0] or []
    splits = sorted(set(splits))
    bounds = F.array(*[F.lit(s) for s in splits]).cast("array<bigint>")
    to = F.when(F.col("doc_id").isNull(), len(splits) + 1).otherwise(F.size(F.filter(bounds, lambda s: s > F.col("doc_id"))))
    rows = rows.withColumn("to", to.cast("int"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), (-F.col("doc_id")).alias("down"), "h", "doc_id")
    firsts = sorted((r["to"], r["x"]["doc_id"], r["x"]["h"]) for r in rows.groupBy("to").agg(F.min(order).alias("x")).collect())  # one row a range
    ghosts = [(doc, h, firsts[k - 1][0]) for k, (_, doc, h) in enumerate(firsts)]
    more = spark.createDataFrame(ghosts, "g_id long, g_h long, before int")
    both = rows.join(F.broadcast(more), rows["doc_id"].eqNullSafe(F.col("g_id")) & (F.col("h") == F.col("g_h")), "left")
    sends = F.when(F.col("before").isNull(), F.array(F.struct(F.col("to"), F.lit(0).alias("ghost")))).otherwise(F.array(F.struct(F.col("to"), F.lit(0).alias("ghost")), F.struct(F.col("before").alias("to"), F.lit(1).alias("ghost"))))
    sent = both.select("doc_id", "text", "h", F.explode(sends).alias("s")).select("doc_id", "text", "h", "s.to", "s.ghost")
    sent = sent.repartition(partitions(spark), "to").sortWithinPartitions("to", "ghost", F.desc_nulls_last("doc_id"), "h")

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pending, out = None, []
        for f in frames:
            ids = f["doc_id"].astype(object).where(f["doc_id"].notna(), None)
            for doc, text, at, ghost in zip(ids, f["text"], f["to"], f["ghost"]):
                memo: dict = {}
                if pending is not None and pending[2] == at:
                    out.append(each(pending[0], pending[1], text, pending[3], memo))
                pending = None if ghost else (doc, text, at, memo)
                if ghost:
                    continue
            if out:
                yield pd.DataFrame(out, columns=schema.fieldNames()).astype({"doc_id": "Int64"})
                out = []

    return sent.mapInPandas(walk, schema)


def edited(text: str, following: str) -> str:
    """The text with its last floor(n / 2) code points replaced by the first as many (or all) of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of docs
    (doc_id, text). Null text is empty; a null doc_id stands last in descending order; rows of one doc_id follow each
    other by text hash; a single row follows itself. No rows: no rows.
    """
    schema = schema_with(docs.select("doc_id").schema, "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string")

    def each(doc, text, following, memo, next_memo) -> tuple:
        text, following = text or "", following or ""
        change = edited(text, following)
        next_memo["fp"] = fingerprint(following)
        mine = memo.get("fp") or fingerprint(text)
        other = mine if change == text else fingerprint(change)
        return doc, len(text), hashlib.sha256(change.encode("utf-8", "surrogatepass")).hexdigest(), mine, other, next_memo["fp"]

    got = with_next(docs, each, schema)
    return got.withColumn("near_edited", likeness("fingerprint", "edited_fingerprint")).withColumn("near_next", likeness("fingerprint", "next_fingerprint")).drop("next_fingerprint")
