"""Benchmark decontamination by the q-gram lemma.

A passage of m characters that occurs in a document with at most k edits shares at least
m - q + 1 - k q of its q-grams with the region it occurs in. Shared q-grams are counted in diagonal bands
of width 2k that overlap by k; bands with enough of them are verified by banded alignment.

Documents and benchmark are compared as lower-case text with each run of white space as one space, as
UTF-8 bytes. The edit budget is EDITS of a passage's length, less where the lemma would then ask for no shared q-gram;
passages shorter than q are only found exactly.

Cases: null text is empty; empty benchmark texts, and those without a word, match nothing. Repeated items
or rows each give their rows, rows with a null id too. A passage is reported once for each document: its best region, the first of
equal ones. Empty tables give no rows. Other columns are ignored (``cleaned`` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinlens.llm.common import saved, steps, table, text_of

Q = 8
EDITS = 0.08
#: Bytes of benchmark that one pass over the documents compares; a larger benchmark takes more passes.
BLOCK_BYTES = 2_000_000
#: Shared q-grams that are counted at once; bounds the memory that a repetitive text takes.
COUNTED = 500_000
_BITS = 24
_MULTIPLIER = 0x9E3779B97F4A7C15

HITS = "doc_id long, item_id long, start long, length long, edits long"


def normalised(text: str) -> bytes:
    return " ".join(text.lower().split()).encode()


def _grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit value of each q-gram: q bytes, five bits and more of each, mixed."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(Q):
            out *= np.uint64(0x100000001B3)
            out += data[i : i + n]
        out *= np.uint64(_MULTIPLIER)
        out ^= out >> np.uint64(29)
    return out


@dataclass(frozen=True)
class Index:
    ids: list
    texts: list[bytes]
    budget: np.ndarray
    needed: np.ndarray
    keys: np.ndarray  # sorted values of all q-grams
    item: np.ndarray
    place: np.ndarray
    present: np.ndarray  # a bit for each value's top bits


def build(items: list[tuple], edits: float = EDITS) -> Index:
    pairs = [(i, t) for i, t in ((i, normalised(t or "")) for i, t in items) if t]
    m = np.array([len(t) for _, t in pairs], np.int64)
    budget = np.maximum(0, np.minimum((edits * m).astype(np.int64), (m - Q) // Q))
    grams = [_grams(np.frombuffer(t, np.uint8)) for _, t in pairs]
    keys = np.concatenate([np.zeros(0, np.uint64), *grams])
    item = np.repeat(np.arange(len(pairs)), [len(g) for g in grams])
    place = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(g)) for g in grams]])
    order = np.argsort(keys, kind="stable")
    present = np.zeros(1 << (_BITS - 3), np.uint8)
    top = (keys >> np.uint64(64 - _BITS)).astype(np.int64)
    np.bitwise_or.at(present, top >> 3, (1 << (top & 7)).astype(np.uint8))
    return Index([i for i, _ in pairs], [t for _, t in pairs], budget, np.maximum(1, m - Q + 1 - budget * Q), keys[order], item[order].astype(np.int32), place[order].astype(np.int32), present)


def align(pattern: bytes, text: bytes, low: int, high: int, k: int) -> tuple[int, int, int] | None:
    """The pattern's best occurrence with at most k edits that begins on diagonals low..high of the text: (edits, start, end)."""
    p, t = np.frombuffer(pattern, np.uint8), np.frombuffer(text, np.uint8)
    lo, hi = low - k, high + k
    width = hi - lo + 1
    big = len(p) + len(t) + 1
    column = np.arange(width)
    # cell (i, d): prefix of length i against text up to i + lo + d
    at = lo + column
    cost = np.where((at >= 0) & (at <= len(t)), 0, big)
    start = np.maximum(at, 0)
    for i in range(1, len(p) + 1):
        at = i + lo + column
        inside = (at >= 1) & (at <= len(t))
        same = np.zeros(width, bool)
        same[inside] = t[at[inside] - 1] == p[i - 1]
        diagonal = np.where(inside, cost + ~same, big)
        above = np.append(cost[1:], big) + 1  # a pattern byte without a text byte
        above[(at < 0) | (at > len(t))] = big
        take = above < diagonal
        new, begun = np.where(take, above, diagonal), np.where(take, np.append(start[1:], 0), start)
        # A text byte without a pattern byte: from the left, one each.
        lift = new - column
        least = np.minimum.accumulate(lift)
        origin = np.maximum.accumulate(np.where(lift == least, column, 0))
        cost, start = np.minimum(least + column, big), begun[origin]
        cost[(at < 0) | (at > len(t))] = big
    best = int(cost.argmin())
    return (int(cost[best]), int(start[best]), len(p) + lo + best) if cost[best] <= k else None


def occurrences(text: bytes, index: Index) -> list[tuple[int, int, int, int]]:
    """(item, start, length, edits) of each item that occurs."""
    found: dict[int, tuple[int, int, int]] = {}
    for j in np.flatnonzero([len(t) < Q for t in index.texts]) if len(text) else []:
        at = text.find(index.texts[j])
        if at >= 0:
            found[int(j)] = (0, at, len(index.texts[j]))
    grams = _grams(np.frombuffer(text, np.uint8))
    top = (grams >> np.uint64(64 - _BITS)).astype(np.int64)
    at = np.flatnonzero(index.present[top >> 3] >> (top & 7).astype(np.uint8) & 1)
    if len(at) and len(index.keys):
        left, right = np.searchsorted(index.keys, grams[at]), np.searchsorted(index.keys, grams[at], side="right")
        n = right - left
        at, left, n = at[n > 0], left[n > 0], n[n > 0]
        if len(at):
            for j, low, high in _bands(at, left, n, index):
                pattern, k = index.texts[j], int(index.budget[j])
                if j in found and found[j][0] == 0:
                    continue
                a, b = max(0, low - k), min(len(text), high + k + len(pattern) + k)
                exact = text.find(pattern, a, b)
                hit = (0, exact, exact + len(pattern)) if exact >= 0 else align(pattern, text[a:b], low - a, high - a, k)
                if hit and exact < 0:
                    hit = (hit[0], hit[1] + a, hit[2] + a)
                if hit and (j not in found or (hit[0], hit[1]) < found[j][:2]):
                    found[j] = (hit[0], hit[1], hit[2] - hit[1])
    return [(j, s, n, e) for j, (e, s, n) in sorted(found.items())]


def _bands(at: np.ndarray, left: np.ndarray, n: np.ndarray, index: Index) -> Iterator[tuple[int, int, int]]:
    """(item, lowest and highest diagonal) of the bands with enough shared q-grams; each diagonal is in two bands."""
    ends = n.cumsum()
    keys, counts, begin = [], [], 0
    while begin < len(n):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + COUNTED, side="right")))
        size = n[begin:end]
        entry = np.repeat(left[begin:end] - np.concatenate([[0], size.cumsum()[:-1]]), size) + np.arange(size.sum())
        item = index.item[entry].astype(np.int64)
        band = (np.repeat(at[begin:end], size) - index.place[entry]) // np.maximum(index.budget[item], 1)
        key, count = np.unique(np.concatenate([(item << 36) + band + (1 << 35), (item << 36) + band + (1 << 35) - 1]), return_counts=True)
        keys.append(key)
        counts.append(count)
        begin = end
    key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    count = np.bincount(inverse, weights=np.concatenate(counts)).astype(np.int64)
    for k in key[count >= index.needed[key >> 36]]:
        j = int(k >> 36)
        band, h = int(k & ((1 << 36) - 1)) - (1 << 35), max(int(index.budget[j]), 1)
        yield j, band * h, band * h + 2 * h - 1


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple]]:
    """The stated query set, blocks of about BLOCK_BYTES; the driver holds one at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_of(benchmark).alias("text"))
    block: list[tuple] = []
    size = 0
    for r in items.toLocalIterator():
        block.append((r["item_id"], r["text"]))
        size += len(r["text"]) + 1
        if size > BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """doc_id, item_id, start, length, edits (in normalised bytes) for every document and benchmark passage in it.

    One pass over the documents for each block, each saved before the next; only one block's index is broadcast at a time.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    out = None
    for block in _blocks(benchmark):
        index = spark.sparkContext.broadcast(build(block, edits))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            own = index.value
            for batch in steps(batches, "text"):
                got = [(d, own.ids[j], s, n, e) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for j, s, n, e in occurrences(normalised(t), own)]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got, strict=True)], [f.split()[0] for f in HITS.split(", ")])

        found = saved(rows.mapInArrow(run, HITS), "hits")
        index.destroy()
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], HITS) if out is None else out


def cleaned(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """The rows and columns of the documents without those whose text has a benchmark passage; each row is judged by its own text, whatever its id.

    A pass over what the blocks before left, for each block; only one block's index is broadcast at a time.
    """
    spark = docs.sparkSession
    place = docs.columns.index("text")
    if docs.schema[place].dataType.typeName() != "string":
        docs = docs.withColumn("text", F.col("text").cast("string"))
    for block in _blocks(benchmark):
        index = spark.sparkContext.broadcast(build(block, edits))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in steps(batches, "text"):
                keep = [not t or not occurrences(normalised(t), index.value) for t in batch.column(place).to_pylist()]
                if any(keep):
                    yield batch.filter(pa.array(keep, pa.bool_()))

        docs = saved(docs.mapInArrow(run, docs.schema), "clean")
        index.destroy()
    return docs


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
