"""Document quality by hierarchical empirical Bayes.

A linear classifier on words and simple shape features gives each document's evidence for two targets
(quality and toxic). Evidence is averaged for each host and for each path under it by grouped
aggregation; a path's mean is shrunk towards its host's posterior and a host's towards the global
prior, by strengths estimated from the spread of the group means. A document's posterior is its evidence
plus its path's shift of the prior, in log-odds.

``documents`` has no URL: its source is the host, and its language within the source the path.

Cases: null text is empty; null host or path is a group of its own. Without labels of both classes the
evidence is 0 and every document is kept. Labels that are null or repeated: nulls are left out, the
largest of repeated ones counts. Repeated rows each give a row. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from joinlens.llm.common import saved, steps, table, text_of

#: Bound of the labelled sample that the classifier is fitted on, in documents (about).
MAX_LABELLED = 4000
#: Words that the classifier uses at most for each target.
MAX_WORDS = 150
MIN_WORD_DOCS = 4
#: How many standard errors a word's label rate must be off the mean.
MIN_Z = 4.0
TARGETS = ("quality", "toxic")
#: Toxicity is a matter of words, hardly of shape.
SHAPE_PENALTY = {"quality": 0.02, "toxic": 50.0}

_WORD = re.compile(r"[^\W\d_]+")
SHAPES = 9


def shape(text: str, words: list[str]) -> list[float]:
    n, w = max(1, len(text)), max(1, len(words))
    letters = sum(map(len, words))
    upper = sum(x.isupper() and len(x) > 1 for x in words) / w
    counts = Counter(x.lower() for x in words)
    top = max(counts.values(), default=0) / w
    common = sum(text.count(c) for c in "!$%&*#|") / w
    return [1.0, letters / n, upper, len(counts) / w if w < 2000 else min(1.0, len(counts) / 1000), top * min(1.0, w / 20), min(3.0, common), sum(text.count(c) for c in "0123456789") / n * 10, np.log1p(w) / 10, min(3.0, letters / w / 10)]


def _words(text: str) -> tuple[list[str], set[str]]:
    words = _WORD.findall(text)
    return words, {w.lower() for w in words}


@dataclass(frozen=True)
class Model:
    words: dict[str, int]
    weights: np.ndarray  # targets x (shapes + words)

    def evidence(self, text: str | None) -> np.ndarray:
        words, distinct = _words(text or "")
        out = self.weights[:, :SHAPES] @ np.array(shape(text or "", words))
        hit = [self.words[w] + SHAPES for w in distinct & self.words.keys()]
        return out + self.weights[:, hit].sum(1) if hit else out


def _logistic(x: np.ndarray, y: np.ndarray, shapes: float, penalty: float = 0.02, rounds: int = 25) -> np.ndarray:
    """Newton steps with ridge penalties for words and for shapes (not on the constant)."""
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    ridge[:SHAPES] = shapes
    ridge[0] = 1e-6

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * ridge @ (w * w))

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > now:  # a full step can overshoot where classes are apart
            size /= 2
        w, before, now = w + size * step, now, loss(w + size * step)
        if before - now < 1e-7 * abs(before):
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> Model:
    """Learn from a hash sample of about ``limit`` labelled documents at most."""
    known = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.max(t).alias(t) for t in TARGETS])
    total = known.count()
    if total > limit:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.lit(int(1_000_003 * limit / total)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text")).join(F.broadcast(known), "doc_id")  # bounded by limit

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            got = []
            for doc_id, text, q, t in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                words, distinct = _words(text)
                got.append((doc_id, shape(text, words), sorted(distinct), q, t))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got, strict=True), (pa.int64(), pa.list_(pa.float64()), pa.list_(pa.string()), pa.int32(), pa.int32()), strict=True)], ["doc_id", "shape", "words", "quality", "toxic"])

    schema = "doc_id long, shape array<double>, words array<string>, quality int, toxic int"
    seen = saved(rows.select("doc_id", "text", F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")).mapInArrow(features, schema), "labelled")
    base = seen.select("doc_id", "shape", *TARGETS).toPandas().sort_values("doc_id", kind="stable")
    x = np.array(base["shape"].to_list(), float).reshape(-1, SHAPES)
    n, own = len(base), {t: [] for t in TARGETS}
    counts = seen.select(F.explode("words").alias("word"), *TARGETS).groupBy("word").agg(F.count("*").alias("n"), *[F.sum(t).alias(t) for t in TARGETS]).where(f"n >= {MIN_WORD_DOCS}")
    for t in TARGETS:
        p = float(base[t].mean()) if n else 0.0
        if 0 < p < 1:
            z = (F.col(t) - F.col("n") * p) / F.sqrt(F.col("n") * (p * (1 - p)) + 1)
            z = z if t == "toxic" else F.abs(z)  # only presence of a word makes a text toxic
            own[t] = [r["word"] for r in counts.where(z >= MIN_Z).orderBy(F.desc(z), "word").limit(MAX_WORDS).select("word").collect()]
    words = {w: i for i, w in enumerate(dict.fromkeys(w for t in TARGETS for w in own[t]))}
    weights = np.zeros((len(TARGETS), SHAPES + len(words)))
    if words:
        which = seen.select("doc_id", F.array_intersect("words", F.array(*map(F.lit, words))).alias("words")).toPandas().sort_values("doc_id", kind="stable")
        hits = np.zeros((n, len(words)))
        for i, found in enumerate(which["words"]):
            hits[i, [words[w] for w in found]] = 1
        x = np.hstack([x, hits])
    for k, t in enumerate(TARGETS):
        y = base[t].to_numpy(float)
        if 0 < y.mean() < 1 if n else False:
            used = [*range(SHAPES), *(SHAPES + words[w] for w in own[t])]
            weights[k, used] = _logistic(x[:, used], y, SHAPE_PENALTY[t])
        elif t == "quality":
            weights[k, 0] = 30.0
        else:
            weights[k, 0] = -30.0
    return Model(words, weights)


def scores(docs: DataFrame, model: Model, host: Column, path: Column) -> DataFrame:
    """doc_id, host, path and the evidence for each target, in log-odds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            e = np.array([model.evidence(t) for t in batch.column(3).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *(pa.array(np.clip(e[:, k], -30, 30)) for k in range(len(TARGETS)))], ["doc_id", "host", "path", *TARGETS])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), text_of(docs).alias("text"))
    return rows.mapInArrow(run, "doc_id long, host string, path string, quality double, toxic double")


def _p(logit: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def _logit(p: Column) -> Column:
    return F.log(p / (F.lit(1.0) - p))


def _strength(groups: DataFrame, t: str, above: Column) -> float:
    """Prior strength in documents from the spread of group means around the level above (method of moments)."""
    size, spread, level = groups.agg(F.sum("n"), F.sum(F.col("n") * F.pow(F.col(f"sum_{t}") / F.col("n") - above, 2)), F.avg(above)).first()
    k = groups.count()
    if not size or k < 2:
        return 1e6
    noise = level * (1 - level)
    between = max(0.0, (spread - k * noise) / size)
    return float(np.clip(noise / between - 1, 1.0, 1e6)) if between > 0 else 1e6


def posteriors(scored: DataFrame) -> DataFrame:
    """Each document's posterior for each target: doc_id, p_quality, p_toxic."""
    sums = [F.sum(_p(F.col(t))).alias(f"sum_{t}") for t in TARGETS]
    paths = saved(scored.groupBy("host", "path").agg(F.count("*").alias("n"), *sums), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), *[F.sum(f"sum_{t}").alias(f"sum_{t}") for t in TARGETS])
    whole = hosts.agg(F.sum("n").alias("n"), *[F.sum(f"sum_{t}").alias(f"sum_{t}") for t in TARGETS]).first()
    prior = {t: min(1 - 1e-6, max(1e-6, (whole[f"sum_{t}"] or 0.0) / (whole["n"] or 1))) for t in TARGETS}
    a = {t: _strength(hosts, t, F.lit(prior[t])) for t in TARGETS}
    at_host = hosts.select("host", *[((F.col(f"sum_{t}") + a[t] * prior[t]) / (F.col("n") + a[t])).alias(f"host_{t}") for t in TARGETS])
    both = paths.alias("p").join(at_host.alias("h"), F.col("p.host").eqNullSafe(F.col("h.host"))).select("p.*", *[f"h.host_{t}" for t in TARGETS])
    both = saved(both, "path-priors")
    b = {t: _strength(both, t, F.col(f"host_{t}")) for t in TARGETS}
    shift = both.select("host", "path", *[(_logit((F.col(f"sum_{t}") + b[t] * F.col(f"host_{t}")) / (F.col("n") + b[t])) - float(np.log(prior[t] / (1 - prior[t])))).alias(f"shift_{t}") for t in TARGETS])
    joined = scored.alias("s").join(shift.alias("g"), F.col("s.host").eqNullSafe(F.col("g.host")) & F.col("s.path").eqNullSafe(F.col("g.path")))
    return joined.select("s.doc_id", *[_p(F.col(f"s.{t}") + F.coalesce(F.col(f"g.shift_{t}"), F.lit(0.0))).alias(f"p_{t}") for t in TARGETS])


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, p_quality, p_toxic, toxic, and kept: good and not toxic."""
    scored = saved(scores(docs, fit(docs, labels), docs["source"], docs["lang"]), "evidence")
    return posteriors(scored).select("doc_id", "p_quality", "p_toxic", (F.col("p_toxic") >= 0.5).alias("toxic"), ((F.col("p_quality") >= 0.5) & (F.col("p_toxic") < 0.5)).alias("kept"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
