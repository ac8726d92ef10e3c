"""Language identification by nearest centroid.

Texts become normalised TF-IDF vectors of hashed byte trigrams of the lower-cased text. Each language
gets several centroids (spherical k-means), and a text takes the language of the centroid with the
largest cosine. A text that is too far from that centroid is rejected. How far is too far is fitted and goes by
the text's length: any text's cosine grows with its length, so the limit lies between what a text of that length
gets by chance (its counts spread over random bins) and what texts of the language get that weren't fitted on.

Centroids and limits are fitted by a task for each language; the driver gets these (80 KB a language), never texts. All values of
lang are learned, however many.

Cases: null text or a text without a letter gives ``und``, score 0, rejected. With no usable training
row every text is ``und``. Null languages are never learned. Repeated rows each give a row. Rows with a
null ``doc_id`` are predicted but never learned from. Other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinlens.llm.common import joined_bytes, saved, steps, table

BINS = 4096
#: Bound of the sample that the centroids are fitted on, in documents of each language.
MAX_PER_LANGUAGE = 600
CENTROIDS = 4
#: Where the rejection limit lies between chance (0) and the lower end of the language's own texts (1), in ratios.
STRICTNESS = 0.6
#: The lower end of a language's texts: this share of them is below.
LOWER_END = 0.05
#: Own texts are also thinned to so many trigrams, or put together by so many, to have all lengths.
THINNED = (4, 16, 64, 256, 1024)
POOLED = (4, 16, 64)

_ASCII_LETTER = re.compile("[A-Za-z]")
_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    lower: np.ndarray  # a row for each language: log of the lower end's cosine over chance, by the text's log2 size


SIZES = int(np.log2(BINS)) + 1


def has_letter(text: str | None) -> bool:
    return bool(text) and (_ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def trigram_counts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Counts of hashed trigrams, a row for each text of the joined bytes."""
    n, folded = len(starts) - 1, _FOLD[data]
    if len(folded) < 3:
        return np.zeros((n, BINS), np.float32)
    code = folded[:-2].astype(np.uint32)
    code <<= np.uint32(8)
    code |= folded[1:-1]
    code <<= np.uint32(8)
    code |= folded[2:]
    blank = code == 0x202020
    code *= np.uint32(2654435761)
    code >>= np.uint32(20)
    out = np.zeros((n, BINS), np.float32)
    for i in range(n):
        a, b = starts[i], starts[i + 1] - 2
        if b > a:
            out[i] = np.bincount(code[a:b], weights=None if not blank[a:b].any() else ~blank[a:b], minlength=BINS)
    return out


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = np.sqrt(counts) * idf
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def _size(counts: np.ndarray) -> np.ndarray:
    """How many bins a text's counts fill in effect."""
    return np.sqrt(counts).sum(1) ** 2 / np.maximum(counts.sum(1), 1e-9)


def _chance(size: np.ndarray, idf: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The cosine with a centroid (one for each text) that a text of that size gets if its counts fall into random bins."""
    return np.sqrt(size / BINS) * (centroids @ idf) / np.linalg.norm(idf)


def _lower_end(counts: np.ndarray, idf: np.ndarray, centroids: int) -> np.ndarray:
    """For each log2 size: log of the cosine over chance at the lower end of a language's texts, with centroids fitted on the other half of them."""
    counts = np.unique(counts, axis=0)
    rng, seen = np.random.default_rng(0), [[] for _ in range(SIZES)]
    counts = counts[rng.permutation(len(counts))]
    for half in (0, 1):
        own, other = counts[half::2], counts[1 - half :: 2]
        if not len(own) or not len(other):
            continue
        centre = _cluster(_vectors(other, idf), centroids)
        total = own.sum(1, keepdims=True)
        texts = [own, *(rng.binomial(own.astype(np.int64), np.minimum(n / np.maximum(total, 1), 1)) for n in THINNED)]
        texts += [own[: len(own) // n * n].reshape(-1, n, BINS).sum(1) for n in POOLED]
        for c in texts:
            size = _size(c)
            c, size = c[size > 0], size[size > 0]
            cosine = _vectors(c, idf) @ centre.T
            best = cosine.argmax(1)
            ratio = np.maximum(cosine.max(1), 1e-9) / np.maximum(_chance(size, idf, centre[best]), 1e-9)
            for k, r in zip(np.rint(np.log2(size)).astype(int), np.log(ratio), strict=True):
                seen[k].append(r)
    have = [k for k in range(SIZES) if seen[k]]
    if not have:
        return np.zeros(SIZES)  # one text tells no spread: chance is the limit
    return np.interp(np.arange(SIZES), have, [np.quantile(seen[k], LOWER_END) for k in have])


def _near(counts: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's best centroid, its cosine, and whether that is near enough."""
    cosine = _vectors(counts, model.idf) @ model.centroids.T
    best = cosine.argmax(1)
    top, size = cosine[np.arange(len(best)), best], np.maximum(_size(counts), 1)
    at = np.log2(size)
    k = np.minimum(at.astype(int), SIZES - 2)
    low = model.lower[model.owner[best]]
    row = np.arange(len(best))
    lower = low[row, k] + (low[row, k + 1] - low[row, k]) * (at - k)
    return best, top, (top > 0) & (top >= _chance(size, model.idf, model.centroids[best]) * np.exp(STRICTNESS * lower))


def _lowered(batch: pa.RecordBatch) -> tuple[list[str | None], np.ndarray, np.ndarray]:
    texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
    low = pa.RecordBatch.from_arrays([pa.array([" " + t.lower() + " " if t else "" for t in texts], pa.large_string())], ["text"])
    return texts, *joined_bytes(low, "text")


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, "text"):
        _, data, starts = _lowered(batch)
        counts = trigram_counts(data, starts)
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("lang")), pa.array([row.tobytes() for row in counts], pa.binary())], ["lang", "counts"])


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def _cluster(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; starts from the mean's farthest rows, so it is the same each time."""
    mean = x.mean(0)
    seeds = [int(np.argmax(x @ mean))]
    near = x @ x[seeds[0]]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[seeds[-1]])
    centre = x[seeds].copy()
    for _ in range(rounds):
        own = np.argmax(x @ centre.T, axis=1)
        for j in range(len(centre)):
            if (own == j).any():
                centre[j] = x[own == j].mean(0)
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-9)
    return np.vstack([centre, mean / max(np.linalg.norm(mean), 1e-9)])


def _bins_with(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many rows fill each bin, and how many rows there are (bin -1)."""
    seen, n = np.zeros(BINS, np.int64), 0
    for batch in batches:
        for c in batch.column(0).to_pylist():
            seen += np.frombuffer(c, np.float32) > 0
            n += 1
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, BINS, dtype=np.int32)), pa.array(np.append(n, seen))], ["bin", "n"])


def fit(docs: DataFrame, per_language: int = MAX_PER_LANGUAGE, centroids: int = CENTROIDS) -> Model:
    """Learn from rows with a language and an id, ``per_language`` of each language or about as many."""
    rows = docs.select(F.col("doc_id"), F.col("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null and doc_id is not null")
    sizes = saved(rows.groupBy("lang").count(), "languages")
    share = F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("count")) * 1_000_003
    sample = rows.join(sizes, "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share)
    counted = saved(sample.select("lang", "text").mapInArrow(_count_rows, "lang string, counts binary"), "trigrams")
    filled = {r["bin"]: r["n"] for r in counted.select("counts").mapInArrow(_bins_with, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()}
    if not filled.get(-1):
        return Model((), np.ones(BINS, np.float32), np.zeros((0, BINS), np.float32), np.zeros(0, np.int64), np.zeros((0, SIZES)))
    idf = (np.log((1 + filled[-1]) / (1 + np.array([filled[i] for i in range(BINS)]))) + 1).astype(np.float32)

    def fitted(key: tuple, group: pa.Table) -> pa.Table:
        counts = np.stack([np.frombuffer(c, np.float32) for c in sorted(group["counts"].to_pylist())])
        centre = _cluster(_vectors(counts, idf), centroids).astype(np.float32)
        return pa.table({"lang": [key[0].as_py()], "centroids": [centre.tobytes()], "lower": [_lower_end(counts, idf, centroids).tobytes()]})

    parts = counted.groupBy("lang").applyInArrow(fitted, "lang string, centroids binary, lower binary").orderBy("lang").collect()
    centres = [np.frombuffer(r["centroids"], np.float32).reshape(-1, BINS) for r in parts]
    owner = np.repeat(np.arange(len(parts)), [len(c) for c in centres])
    return Model(tuple(r["lang"] for r in parts), idf, np.vstack(centres), owner, np.array([np.frombuffer(r["lower"], float) for r in parts]).reshape(-1, SIZES))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Adds nothing to the rows but: doc_id, lang_pred, score, rejected."""
    kept = docs.sparkSession.sparkContext.broadcast(model)  # 80 KB a language

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = kept.value
        for batch in steps(batches, "text"):
            texts, data, starts = _lowered(batch)
            known = np.array([has_letter(t) for t in texts]) & bool(model.languages)
            if model.languages:
                best, score, near = _near(trigram_counts(data, starts), model)
            else:
                best, score, near = np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts), bool)
            score = np.where(known, np.clip(score, 0, 1), 0.0)
            lang = [model.languages[model.owner[b]] if k else "und" for b, k in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(lang, pa.string()), pa.array(score.astype(float)), pa.array(~known | ~near)], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, "doc_id long, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The same rows and columns without those that are rejected. Without a model (nothing to learn from) only texts without a letter go."""
    place = docs.columns.index("text")
    kept = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = kept.value
        for batch in steps(batches, "text"):
            texts, data, starts = _lowered(batch)
            keep = np.array([has_letter(t) for t in texts])
            if model.languages:
                keep &= _near(trigram_counts(data, starts), model)[2]
            yield batch.filter(pa.array(keep))

    if docs.schema[place].dataType.typeName() != "string":
        docs = docs.withColumn("text", F.col("text").cast("string"))
    return docs.mapInArrow(rows, docs.schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
