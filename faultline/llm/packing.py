"""Best-fit packing of tokenised documents into sequences of bounded length."""

from __future__ import annotations

import base64
import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, partitions, schema_with

_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """A function from text to token ids by the byte-level BPE file at `path`, ids as the tokenizers library gives them.

    The same vocabulary as tiktoken ranks, beside it, is faster and gives equal ids; texts that hold a special token's
    string go through tokenizers.
    """
    if path not in _ENCODERS:
        import os

        import tiktoken
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(path)
        special = [t.content for t in slow.get_added_tokens_decoder().values()]
        ranks_at = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks_at):
            import public_tokenizers

            with open(ranks_at, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

            def encode(text: str) -> list[int]:
                return slow.encode(text, add_special_tokens=False).ids if any(s in text for s in special) else fast.encode_ordinary(text)
        else:

            def encode(text: str) -> list[int]:
                return slow.encode(text, add_special_tokens=False).ids

        _ENCODERS[path] = encode
    return _ENCODERS[path]


def piece_starts(n: int, limit: int) -> list[int]:
    """Where the pieces of n tokens start: whole ones of `limit`, a shorter one first."""
    return [0, *range((n - 1) % limit + 1, n, limit)]


def tokenized_pieces(docs: DataFrame, tokenizer: str, limit: int = 1024, end: int = 2, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of each piece of docs (doc_id, text); null text is empty."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer)
        for f in frames:
            out: dict[str, list] = defaultdict(list)
            for doc, text in zip(f["doc_id"], f["text"]):
                ids = np.array([*encode(text or ""), end], "<u4")
                starts = piece_starts(len(ids), limit)
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                    out["doc_id"].append(doc)
                    out["piece"].append(k)
                    out["start"].append(a)
                    out["length"].append(b - a)
                    out["ids_crc32"].append(zlib.crc32(ids[a:b].tobytes()))
                    if with_ids:
                        out["ids"].append(ids[a:b].astype(np.int64))
            if out:
                frame = pd.DataFrame(out)
                yield frame.astype({"doc_id": "Int64"}) if f["doc_id"].isna().any() else frame

    schema = schema_with(docs.select("doc_id").schema, "piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)
    return docs.select("doc_id", "text").mapInPandas(each, schema)


class Gaps:
    """Open sequences by the room they have left, as runs (first sequence, how many), newest last."""

    def __init__(self) -> None:
        self.runs: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def put(self, room: int, first: int, n: int) -> None:
        if room > 0 and n > 0:
            self.runs[room].append((first, n))

    def rooms(self) -> list[int]:
        return sorted(room for room, runs in self.runs.items() if runs)

    def take(self, room: int, n: int) -> list[tuple[int, int]]:
        """Runs of at most n sequences in all."""
        out, runs = [], self.runs[room]
        while n and runs:
            first, size = runs.pop()
            if size > n:
                runs.append((first + n, size - n))
                size = n
            out.append((first, size))
            n -= size
        return out


def best_fit(counts: dict[int, int], limit: int) -> tuple[dict[int, list[tuple[int, int, int]]], int, int]:
    """Best-fit in bulk-synchronous supersteps: for each length the places (rank from, first sequence, offset), in rank order, the
    number of sequences and the number of supersteps.

    Lengths and rooms are whole numbers up to `limit`, so documents and gaps are held sorted, as runs of equals. A superstep
    is one successor sweep: every length looks up the smallest room that holds it, longer documents go first where several
    lengths meet at one room, each gap takes as many of a length as it holds, and only then do gaps get their new
    rooms. What is longer than every room opens the sequences it needs. The state has at most 2 x limit classes, whatever
    the input. The rank from of the next place ends a place.
    """
    gaps, opened, steps = Gaps(), 0, 0
    left, done, out = dict(counts), dict.fromkeys(counts, 0), defaultdict(list)
    while left:
        steps += 1
        rooms, moved, outside = gaps.rooms(), [], []
        for size in sorted(left, reverse=True):
            k = bisect.bisect_left(rooms, size)
            if k == len(rooms):
                outside.append(size)
                continue
            room, each = rooms[k], rooms[k] // size
            for first, n in gaps.take(room, -(-left[size] // each)):
                full, rest = divmod(min(left[size], n * each), each)
                for j in range(each if full else 0):
                    out[size].append((done[size], first, limit - room + j * size))
                    done[size] += full
                for j in range(rest):
                    out[size].append((done[size], first + full, limit - room + j * size))
                    done[size] += 1
                left[size] -= full * each + rest
                moved += [(room - each * size, first, full), (room - rest * size, first + full, 1 if rest else 0)]
                if not left[size]:
                    del left[size]
                    break
        for room, first, n in moved:
            gaps.put(room, first, n)
        if outside and outside[0] == max(left):
            for k, size in enumerate(outside):
                if k == 0 or 2 * size > limit:  # two of more than half a sequence never share one
                    n = -(-left[size] // (limit // size))
                    gaps.put(limit, opened, n)
                    opened += n
    return dict(out), opened - sum(n for _, n in gaps.runs[limit]), steps


def pack(pieces: DataFrame, scratch: Scratch, limit: int = 1024) -> DataFrame:
    """pieces (length and any other columns) with sequence_id and offset; no sequence is longer than `limit`.

    The pieces are sorted by length into ranges once; a rank within a length is a partition's offset plus the place in
    it. Only counts by (range, length) come to the driver, at most partitions + limit rows. No rows: no rows.
    """
    spark, schema = pieces.sparkSession, pieces.schema

    def ranked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, seen = TaskContext.get().partitionId(), defaultdict(int)
        for f in frames:
            place = f.groupby("length").cumcount() + f["length"].map(lambda x: seen[x])
            for x, k in f["length"].value_counts().items():
                seen[x] += k
            yield f.assign(fl_range=np.int32(at), fl_rank=place.astype("int64"))

    by = [F.col(c) for c in ("length", "doc_id", "piece") if c in pieces.columns]
    rows = pieces.repartitionByRange(partitions(spark), *by).sortWithinPartitions(*by)
    rows = scratch.keep(rows.mapInPandas(ranked, schema_with(schema, "fl_range int, fl_rank long")))
    counts = sorted((r["length"], r["fl_range"], r["count"]) for r in rows.groupBy("length", "fl_range").count().collect())
    base, total = {}, defaultdict(int)
    for size, at, n in counts:
        base[at, size] = total[size]
        total[size] += n
    places, _, _ = best_fit(dict(total), limit)
    table = {s: tuple(np.array(x, np.int64) for x in zip(*p)) for s, p in places.items()}
    shared = spark.sparkContext.broadcast((base, table))  # at most partitions + limit ranks; places are bounded by limit

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, table = shared.value
        for f in frames:
            sequence, offset = np.empty(len(f), np.int64), np.empty(len(f), np.int64)
            for (at, size), rows in f.groupby(["fl_range", "length"]).indices.items():
                rank = f["fl_rank"].to_numpy()[rows] + base[at, size]
                ranks, firsts, offsets = table[size]
                k = np.searchsorted(ranks, rank, "right") - 1
                sequence[rows], offset[rows] = firsts[k] + rank - ranks[k], offsets[k]
            yield f.drop(columns=["fl_range", "fl_rank"]).assign(sequence_id=sequence, offset=offset)

    return rows.mapInPandas(placed, schema_with(schema, "sequence_id long, offset long"))


def packed(docs: DataFrame, scratch: Scratch, tokenizer: str, limit: int = 1024, end: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: where each piece of each row of docs goes.

    Null and empty texts are the end token alone; repeated rows are packed each; a null doc_id stays null.
    """
    # the sort samples its input first, so the pieces are written before; texts are tokenised once
    return pack(scratch.keep(tokenized_pieces(docs, tokenizer, limit, end)), scratch, limit)


def sequences(docs: DataFrame, placed: DataFrame, tokenizer: str, limit: int = 1024, end: int = 2) -> DataFrame:
    """(sequence_id, ids): the packed token sequences themselves, each at most `limit` ids, for placed pieces of docs."""
    pieces = tokenized_pieces(docs, tokenizer, limit, end, with_ids=True).select("doc_id", "piece", "ids_crc32", "ids").dropDuplicates(["doc_id", "piece", "ids_crc32"])
    rows = placed.join(pieces, ["doc_id", "piece", "ids_crc32"])
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return rows.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
