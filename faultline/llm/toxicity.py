"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text, compared window by window."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of the dictionary that a pair has in common and of what each of the two has behind it, of the segments that zstandard's trainer
#: puts together, and pairs of dictionaries.
DICTIONARY_BYTES, OWN_BYTES, SEGMENT, PAIRS = 98_304, 32_768, 16, 5
#: What a trained dictionary begins with, and bytes in which its tables end at the latest.
MAGIC, TABLES = bytes.fromhex("37a430ec"), 256
WINDOW, STRIDE = 12, 12
#: Labelled documents of each kind that training reads at most, and the characters of the longest of them: 64 MB at most.
SAMPLE, LONGEST = 4_000, 8_192
#: Shares of ordinary windows below the levels that a text's windows are counted above, and bytes beyond the highest of them.
SHARES, BEYOND = (0.5, 0.75, 0.9, 0.95, 0.98, 0.99, 0.995, 0.998, 0.999, 0.9995), (2, 4, 7)


@dataclass(frozen=True)
class Model:
    """Pairs of dictionaries (ordinary, toxic) and the calibration of what their windows say about a text."""

    pairs: tuple[tuple[bytes, bytes], ...]
    levels: tuple[int, ...]
    rates: tuple[float, ...]
    weights: tuple[float, ...]
    window: int = WINDOW
    stride: int = STRIDE

    def margins(self, text: str | None) -> np.ndarray:
        """Bytes that the toxic dictionaries save over the ordinary ones, for each window of the text."""
        parts = windows(text, self.window, self.stride)
        out = np.zeros(len(parts), np.int64)
        for ordinary, toxic in _compressors(self):
            out += np.fromiter((len(ordinary.compress(p)) - len(toxic.compress(p)) for p in parts), np.int64, len(parts))
        return out

    def features(self, margins: np.ndarray) -> list[float]:
        """How far the windows above each level exceed the share they have in ordinary text, in standard deviations."""
        n, rate = len(margins), np.array(self.rates)
        over = (margins[:, None] >= np.array(self.levels)).sum(0)
        z = (over - n * rate) / np.sqrt(n * rate * (1 - rate) + 1)
        return [1.0, *np.log1p(np.maximum(z, 0)).tolist(), *np.minimum(z, 0).tolist()]

    def score(self, text: str | None) -> float:
        z = sum(w * x for w, x in zip(self.weights, self.features(self.margins(text))))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def windows(text: str | None, window: int = WINDOW, stride: int = STRIDE) -> list[bytes]:
    """The overlapping windows of a text, each with a space on both sides; none without words."""
    w = words_of(text)
    return [b" " + b" ".join(w[i : i + window]) + b" " for i in range(0, max(1, len(w) - window + stride), stride)] if w else []


_MADE: dict[int, list] = {}


def _compressors(m: Model) -> list:
    key = hash(m.pairs)
    if key not in _MADE:
        bare = zstandard.ZstdCompressionParameters.from_level(3, window_log=17, write_content_size=False, write_checksum=False, write_dict_id=False)
        make = lambda d: zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), compression_params=bare)
        _MADE[key] = [(make(o), make(t)) for o, t in m.pairs]
    return _MADE[key]


def trained(samples: list[bytes], size: int, segment: int = SEGMENT) -> bytes:
    """A dictionary of at most `size` bytes, with entropy tables, that zstandard trains on the samples; what there is of them,
    as plain content, if it can't.
    """
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=6).as_bytes()
    except zstandard.ZstdError:  # too few or too short
        return b"".join(samples)[:size]


def content(dictionary: bytes) -> bytes:
    """The strings of a dictionary without its tables."""
    return dictionary[TABLES:] if dictionary[:4] == MAGIC else dictionary


def _balanced(z: np.ndarray, ys: np.ndarray) -> float:
    """The cut of z with the best share of label 1 above it less the share of label 0 above it, the latter counted threefold."""
    cuts = np.unique(z)
    gain = [(z[ys == 1] >= c).mean() - 3 * (z[ys == 0] >= c).mean() for c in cuts]
    k = int(np.argmax(gain))
    return float((cuts[k] + cuts[k - 1]) / 2 if k else cuts[k])


def train(texts: list[str], labels: list[int], size: int = DICTIONARY_BYTES, pairs: int = PAIRS, window: int = WINDOW, stride: int = STRIDE, own: int = OWN_BYTES) -> Model:
    """Dictionaries that zstandard trains on all windows of ordinary and on all windows of toxic documents.

    Which of the strings that both kinds share get into a dictionary is chance, and that would be most of what a pair says about a
    window; so both of a pair begin with one dictionary of ordinary text and its tables, and only the strings behind it are of their
    kind. There are several pairs, each without another part of the documents, and what they save is added up. Levels, how often
    ordinary windows reach them, the weights of a logistic regression and its cut at score 0.5 are calibrated on every fourth
    document, which the dictionaries don't see. Without documents of both kinds in both parts every score is 0.
    """
    halves: tuple[list, list] = ([], [])
    for k, (t, y) in enumerate(zip(texts, labels)):
        halves[k % 4 == 3].append((t or "", int(y)))
    n_levels = len(SHARES) + len(BEYOND)
    none = Model((), (1,) * n_levels, (0.0,) * n_levels, (-30.0, *(0.0,) * (2 * n_levels)), window, stride)
    if not {0, 1} <= {y for _, y in halves[0]} or not {0, 1} <= {y for _, y in halves[1]}:
        return none
    cut = [[windows(t, window, window) for t, y in halves[0] if y == kind] for kind in (0, 1)]
    left_out = lambda parts, i: [x for k, p in enumerate(parts) if k % pairs != i or len(parts) == 1 for x in p]
    base = [trained(left_out(cut[0], i), size) for i in range(pairs)]
    made = tuple(tuple(base[i] + content(trained(left_out(parts, i), own)) for parts in cut) for i in range(pairs))
    model = replace(none, pairs=made)
    margins = [(model.margins(t), y) for t, y in halves[1]]
    plain = np.concatenate([m for m, y in margins if y == 0])
    if not len(plain):
        return none
    levels = np.quantile(plain, SHARES).astype(int).tolist()
    levels = tuple(levels + [levels[-1] + x for x in BEYOND])
    rates = tuple(float((plain >= c).mean()) + 1e-4 for c in levels)
    model = replace(model, levels=levels, rates=rates)
    x, ys = np.array([model.features(m) for m, _ in margins]), np.array([y for _, y in margins])
    scale = np.maximum(np.abs(x).max(0), 1e-9)
    z, w = x / scale, np.zeros(x.shape[1])
    for _ in range(50):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-z @ w))
        h = (z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(len(w))
        step = np.linalg.solve(h, z.T @ (ys - p) - 0.1 * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    w = w / scale
    w[0] -= _balanced(x @ w, ys)
    return replace(model, weights=tuple(float(v) for v in w))


def training_rows(docs: DataFrame, labels: DataFrame, keep, sample: int = SAMPLE, longest: int = LONGEST) -> tuple[list[str], list[int]]:
    """Texts and labels of at most `sample` documents of each kind for which keep(doc_id) holds, chosen by hash.

    Labels are bounded by two top-k selections before texts are joined, and of the texts those of more than `longest` characters
    don't count here. A doc_id with contrary labels counts as toxic; of several texts of one, the first by hash counts.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(keep(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit(7))
    picked = known.where("toxic = 1").orderBy(order).limit(sample).union(known.where("toxic = 0").orderBy(order).limit(sample))
    ids = {r["doc_id"]: int(r["toxic"]) for r in picked.collect()}
    found = docs.select("doc_id", "text").join(F.broadcast(picked.select("doc_id")), "doc_id", "left_semi")  # at most 2 x sample ids
    found = found.where(F.coalesce(F.length("text"), F.lit(0)) <= longest)
    first = found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x")).select("doc_id", "x.text")
    got = sorted((r["doc_id"], r["text"] or "") for r in first.toLocalIterator())
    got.sort(key=lambda r: hash((r[0] * 2654435761) % 1000003))
    return [t for _, t in got], [ids[d] for d, _ in got]


def fit(docs: DataFrame, labels: DataFrame, keep, sample: int = SAMPLE) -> Model:
    return train(*training_rows(docs, labels, keep, sample))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted of every row of docs (doc_id, text), over whole texts.

    Null and empty texts have no window and the score of that; equal texts score alike, so repeated rows and ties need no rule; rows without
    doc_id score as well; other columns don't matter. No rows: no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # ten dictionaries of 128 KB, whatever the input

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for f in frames:
            score = np.fromiter((m.score(t) for t in f["text"]), np.float64, len(f))
            yield pd.DataFrame({"doc_id": f["doc_id"], "score": score, "predicted": (score >= 0.5).astype(np.int32)})

    from .common import schema_with

    return docs.select("doc_id", "text").mapInPandas(each, schema_with(docs.select("doc_id").schema, "score double, predicted int"))
