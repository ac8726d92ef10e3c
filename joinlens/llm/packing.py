"""Packing documents into training sequences by best-fit decreasing.

Every document is tokenised whole and closed by an end id. An overlong document is first cut into full
windows; what is left, and every shorter document, goes by best-fit decreasing into the open window with
the tightest room. The placement of a piece depends on its length alone, so the driver packs the
histogram of lengths (at most ``window`` numbers, whatever the input's size) with a segment tree over
remaining room, and the executors hand out the places by each piece's rank among its length.

Cases: null text is an empty document: one piece with the end id alone. An empty table gives no rows.
Repeated rows are packed as often as they occur. Null ids are kept. Other columns are ignored.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from functools import partial
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from joinlens.llm.common import saved, steps, table

WINDOW = 2048
END_ID = 1
_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """The byte-level BPE of a vocabulary file, as a fast encoder. Ranks and the added tokens of the JSON form beside it give the ids that the JSON form gives (tested)."""
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        added = json.loads(Path(path).with_suffix(".json").read_text(encoding="utf-8"))["added_tokens"]
        _ENCODERS[path] = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in added})
    return _ENCODERS[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut(docs: DataFrame, window: int = WINDOW, vocabulary: str | None = None) -> DataFrame:
    """A row for each piece: full windows first, then the rest."""
    path = vocabulary or default_vocabulary()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = partial(encoder(path).encode_to_numpy, allowed_special="all")
        for batch in steps(batches, "text"):
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or ""), END_ID).astype("<u4")
                n, raw = len(ids), memoryview(ids.tobytes())
                out += [(doc_id, a, min(window, n - a), zlib.crc32(raw[4 * a : 4 * (a + window)]), n) for a in range(0, n, window)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, PIECES)


class RoomTree:
    """Segment tree over remaining room 0..window: how many runs of open windows have that room; finds the least room of at least n."""

    def __init__(self, window: int) -> None:
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, n: int) -> None:
        at = room + self.size
        while at:
            self.count[at] += n
            at >>= 1

    def tightest(self, least: int) -> int | None:
        at = least + self.size
        if self.count[at]:
            return least
        while at > 1:
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def place(histogram: dict[int, int], window: int = WINDOW) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing over a histogram of lengths.

    Returns (length, first rank, how many, first sequence, offset) for runs of pieces of one length, and
    the number of sequences. Windows with the same room are interchangeable, so runs are placed at once.
    """
    tree, open_runs, out, used = RoomTree(window), {}, [], 0

    def reopen(room: int, first: int, n: int) -> None:
        if room and n:
            open_runs.setdefault(room, []).append((first, n))
            tree.add(room, 1)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first = window, used
                n = -(-left // (window // length))
                used += n
            else:
                first, n = open_runs[room].pop()
                tree.add(room, -1)
            # The tightest window stays the tightest until no further piece of this length fits into it.
            each = room // length
            full = min(n, left // each)
            more = min(left - full * each, each - 1) if full < n else 0
            for slot in range(each):
                count = full + (slot < more)
                if count:
                    out.append((length, rank, count, first, window - room + slot * length))
                    rank += count
            left -= full * each + more
            reopen(room - each * length, first, full)
            if more:
                reopen(room - more * length, first + full, 1)
            reopen(room, first + full + (more > 0), n - full - (more > 0))
    return out, used


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: str | None = None) -> DataFrame:
    """Pieces with their sequence_id and offset."""
    spark = docs.sparkSession
    pieces = saved(cut(docs, window, vocabulary).withColumn("part", F.spark_partition_id()), "pieces")
    counts = pieces.groupBy("part", "length").count()
    counts = saved(counts, "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    runs, _ = place(histogram, window)
    # Ranks go on from task to task: a length's pieces of all earlier tasks come first. One row for each task and length, never a piece.
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("part", "length", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("base"))
    by_length: dict[int, list[tuple]] = {}
    for run in runs:
        by_length.setdefault(run[0], []).append(run[1:])
    tables = {k: np.array(v, np.int64) for k, v in by_length.items()}
    kept = spark.sparkContext.broadcast(tables)  # at most a few runs for each of the window's lengths and rooms

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            get = lambda name, b=batch: np.asarray(b.column(b.schema.get_field_index(name)))
            length, part, base = get("length"), get("part"), get("base")
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.lexsort((part, length))
            cuts = np.flatnonzero((np.diff(length[order]) != 0) | (np.diff(part[order]) != 0)) + 1
            for rows in np.split(order, cuts):
                key = (int(length[rows[0]]), int(part[rows[0]]))
                at = base[rows[0]] + seen.get(key, 0) + np.arange(len(rows))
                seen[key] = seen.get(key, 0) + len(rows)
                t = kept.value[key[0]]
                run = np.searchsorted(t[:, 0], at, side="right") - 1
                sequence[rows], offset[rows] = t[run, 2] + at - t[run, 0], t[run, 3]
            keep = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    # All pieces of one task's part meet in one task again, so that ranks inside it are handed out once.
    joined = pieces.join(first.hint("merge"), ["part", "length"]).select("part", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "base")
    return joined.repartition("part").mapInArrow(assign, f"{PIECES}, sequence_id long, offset long")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).select(*[f.split()[0] for f in PIECES.split(", ")], "sequence_id", "offset")
