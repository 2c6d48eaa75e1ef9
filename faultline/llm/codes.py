"""Vector compression by product codes in whole numbers: each part of a vector is named by its codebook's nearest entry."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, schema_with

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Distances (part, entry) that one pass of the search holds.
AT_ONCE = 1 << 20


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(finite(x.cast("double")), F.lit(False)))


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    """floor(256 x) of every component. Beyond a bound that keeps every distance of two vectors in a long (740,000 x 256 for
    64 components) a component is held at the bound.
    """
    most = math.isqrt((1 << 61) // max(1, vectors.shape[1]))
    return np.clip(np.floor(vectors.astype(np.float64) * SCALE), -most, most).astype(np.int64)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return whole_numbers(np.asarray(column.flatten()).reshape(-1, size))


def _segments(size: int) -> list[list[tuple[int, int]]]:
    """From the whole part to its halves, quarters and so on, down to two components a segment."""
    levels, cuts = [], [(0, size)]
    while cuts and max(b - a for a, b in cuts) > 1:
        levels.append(cuts)
        cuts = [c for a, b in cuts for c in ((a, (a + b) // 2), ((a + b) // 2, b)) if c[1] > c[0]]
    return levels


def _means(x: np.ndarray, segments: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Mean of each segment of each row, times the root of its length, and the norm of what is left of the segment."""
    mean = np.stack([x[:, a:b].mean(1) for a, b in segments], 1)
    rest = np.stack([np.sqrt(((x[:, a:b] - mean[:, k : k + 1]) ** 2).sum(1)) for k, (a, b) in enumerate(segments)], 1)
    return mean * np.sqrt([b - a for a, b in segments]), rest


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of x the nearest entry (ties to the lower index), its squared distance, and how many distances that took.

    The squared distance of two segments is at least the square of what their means differ by, times their length, and of what the
    norms of their residuals differ by. The first level's bound points at one entry, whose distance is a row's mark;
    level by level, entries whose bound is above the mark go. Exact distances of those that are left decide. Bounds
    are lowered by more than floats can err, so no entry that could win goes.
    """
    n = len(x)
    best, least, counted = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    step = max(1, AT_ONCE // len(book))
    exact = lambda rows, entries: ((x[rows] - book[entries]) ** 2).sum(1)
    floats = x.astype(np.float64), book.astype(np.float64)
    levels = [(_means(floats[0], s), _means(floats[1], s)) for s in _segments(x.shape[1])]
    slack = 1e-9 * (np.abs(floats[0]).max(1, initial=0) + np.abs(floats[1]).max(initial=0) + 1) ** 2 * x.shape[1]
    for at in range(0, n, step):
        rows = np.arange(at, min(n, at + step))
        row, entry = np.repeat(rows, len(book)), np.tile(np.arange(len(book)), len(rows))
        mark = None
        for (mean, rest), (mean_b, rest_b) in levels:
            bound = sum((mean[row, k] - mean_b[entry, k]) ** 2 + (rest[row, k] - rest_b[entry, k]) ** 2 for k in range(mean.shape[1]))
            if mark is None:
                mark = exact(rows, bound.reshape(len(rows), -1).argmin(1)) + slack[rows]
                counted += len(rows)
            left = bound <= mark[row - at]
            row, entry = row[left], entry[left]
        d = exact(row, entry)
        counted += len(row)
        # rows are in order and so are their entries: the first of the smallest wins
        order = np.lexsort((entry, d, row))
        first = order[np.concatenate(([True], row[order][1:] != row[order][:-1]))]
        best[rows], least[rows] = entry[first], d[first]
    return best, least, counted


def _assigned(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each part (columns) of each vector."""
    size = books.shape[2]
    found = [nearest(x[:, p * size : (p + 1) * size], books[p])[:2] for p in range(PARTS)]
    return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def _sums(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    """part, entry, n and the sums of the components of the parts assigned to the entry, a task's in one batch."""
    _, entries, size = books.shape
    total, n = np.zeros((PARTS, entries, size), object), np.zeros((PARTS, entries), np.int64)
    for batch in batches:
        x = _matrix(batch.column(0), PARTS * size)
        code, _ = _assigned(x, books)
        for p in range(PARTS):
            more = np.zeros((entries, size), np.int64)
            np.add.at(more, code[:, p], x[:, p * size : (p + 1) * size])
            total[p] += more
            n[p] += np.bincount(code[:, p], minlength=entries)
    p, e = np.nonzero(n)
    yield pa.RecordBatch.from_pydict({"part": pa.array(p, pa.int32()), "entry": pa.array(e, pa.int32()), "n": pa.array(n[p, e]), "sums": pa.array([[str(v) for v in total[i, j]] for i, j in zip(p, e)], pa.list_(pa.string()))})


def _coded(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        code, distance = _assigned(_matrix(batch.column("fl_vector"), PARTS * books.shape[2]), books)
        text = [bytes(row).hex() for row in code.astype(np.uint8)]
        rest = [c for c in batch.schema.names if c != "fl_vector"]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in rest] + [pa.array(text, pa.string()), pa.array(distance.sum(1), pa.int64())], names=[*rest, "code", "error"])


def kept(vectors: DataFrame) -> DataFrame:
    """vec_id, label, fl_vector of the rows of vectors (vec_id, embedding, label) that have a code.

    Rows whose vector is null or has null or non-finite components go. So do those that can't be cut or compared: vectors whose length is
    no multiple of 16 above 0 or another than the most frequent such length (of equally frequent ones, the smaller).
    """
    d = vectors.select("vec_id", "label", F.col("embedding").alias("fl_vector")).where(usable(F.col("embedding")))
    lengths = d.groupBy(F.size("fl_vector").alias("n")).count().where(f"n > 0 AND n % {PARTS} = 0").orderBy(F.desc("count"), "n").first()
    return d.where(F.size("fl_vector") == (lengths.n if lengths else -1))


def first_books(d: DataFrame) -> np.ndarray:
    """(part, entry, component): the parts of the vectors of the 64 smallest vec_ids, ascending; null ids don't count, and of rows
    with one vec_id the least vector does.
    """
    ids = d.where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min("fl_vector").alias("fl_vector"))
    rows = ids.orderBy("vec_id").limit(ENTRIES).collect()
    x = whole_numbers(np.array([r.fl_vector for r in rows], np.float64))
    return np.ascontiguousarray(x.reshape(len(rows), PARTS, -1).transpose(1, 0, 2))


def fit(d: DataFrame) -> np.ndarray:
    """The codebooks of kept() rows after ROUNDS rounds. A book has at most 64 entries whatever the input, so books are broadcast;
    each task adds up its own rows before sums are shuffled.
    """
    books = first_books(d)
    for _ in range(ROUNDS):
        sums = d.select("fl_vector").mapInArrow(partial(_sums, books=books), "part int, entry int, n long, sums array<string>")
        spread = sums.select("part", "entry", "n", F.posexplode("sums").alias("k", "s"))
        found = spread.groupBy("part", "entry", "k").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
        books = books.copy()
        for r in found:
            books[r.part, r.entry, r.k] = int(r.s) // r.n
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(v) for v in books.ravel().tolist()).encode()).hexdigest()


def compressed(vectors: DataFrame, scratch: Scratch) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every kept() row of vectors (vec_id, embedding, label).

    Codebooks start as the parts of the 64 smallest vec_ids (fewer vectors: fewer entries) and are moved to the floor of
    their parts' means twice; unused entries stay. code has two hex digits a part, error adds up squared distances, label_error those of a
    label (nulls are one label). Repeated rows count as often as they come; components of vast size are held at a bound
    (whole_numbers); where all vec_ids are null there are no codebooks and so no rows; other columns don't matter. No rows: no rows.
    """
    d = kept(vectors)
    if d.where("vec_id IS NOT NULL").isEmpty():
        return d.limit(0).selectExpr("vec_id", "'' AS code", "0L AS error", "0L AS label_error", "'' AS codebooks_sha256")
    books = fit(d)
    rows = scratch.keep(d.mapInArrow(partial(_coded, books=books), schema_with(d.select("vec_id", "label").schema, "code string, error long")))
    totals = rows.groupBy(F.col("label").alias("fl_label")).agg(F.sum("error").alias("label_error"))
    return rows.join(totals, F.col("label").eqNullSafe(F.col("fl_label"))).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def restored(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, vector: what the codes of compressed() stand for, as doubles."""
    table = [[[(v + 0.5) / SCALE for v in entry] for entry in part] for part in books.tolist()]
    part = lambda p: F.get(F.lit(table[p]), F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int"))
    return coded.select("vec_id", F.flatten(F.array(*[part(p) for p in range(PARTS)])).alias("vector"))
