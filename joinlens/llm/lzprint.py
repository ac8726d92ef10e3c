"""Lempel-Ziv phrase fingerprints.

A text is parsed into dictionary phrases (each the longest phrase seen so far plus one code point); the
phrases are hashed, and the smallest hash values of the set are the fingerprint. Two fingerprints'
likeness is the share of common values among the smallest values of both: an estimate of the Jaccard
similarity of the phrase sets, which acts like a compression distance.

Cases: null text is empty; an empty text has no phrases, and two empty fingerprints have likeness 1, an
empty and a filled one 0. Repeated rows each give a row. Ties of doc_id are ordered by the text's hash;
rows with a null id come first. One document alone is its own successor. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinlens.llm.common import table, text_of

SIZE = 128
_M = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2**64
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        n = max(n, 2 * len(_POWERS[0]), 1 << 16)
        with np.errstate(over="ignore"):
            for k, m in enumerate((_M, pow(_M, -1, 1 << 64))):
                p = np.full(n, m, np.uint64)
                p[0] = 1
                _POWERS[k] = np.cumprod(p)
    return _POWERS[0], _POWERS[1]


_CHILD = 1 << 21  # a node's number times this, plus a code point, is the key of its child


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def parse(text: str, trie: dict[int, int] | None = None, node: int = 0, base: int = 0) -> tuple[list[int], dict[int, int], int]:
    """Ends of the phrases in the text (plus ``base``), the trie of phrases, and the node of the open phrase at the end (0: none).

    A step for each code point, however long the phrases. Can go on from an earlier state.
    """
    trie = {} if trie is None else trie
    ends: list[int] = []
    end, get, new = ends.append, trie.get, len(trie) * _CHILD
    for i, c in enumerate(_codes(text).tolist(), base + 1):
        key = node + c
        node = get(key)
        if node is None:
            new += _CHILD
            trie[key] = new
            end(i)
            node = 0
    return ends, trie, node


def smallest(text: str, ends: list[int], size: int = SIZE) -> np.ndarray:
    """The smallest hash values of the phrases that end there; the last open phrase is left out unless it is the only one."""
    if not text:
        return np.zeros(0, np.uint32)
    up, down = _powers(len(text) + 1)
    with np.errstate(over="ignore"):
        codes = _codes(text).astype(np.uint64) + np.uint64(1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * up[: len(codes)])])
        stops = np.array(ends or [len(text)], np.int64)
        begins = np.concatenate([np.zeros(1, np.int64), stops[:-1]])
        h = (total[stops] - total[begins]) * down[begins]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(29)
        h *= np.uint64(_M)
    return np.unique((h >> np.uint64(32)).astype(np.uint32))[:size]


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)[:size]
    return float(np.isin(both, a, assume_unique=True)[np.isin(both, b, assume_unique=True)].sum() / len(both))


def written(values: np.ndarray) -> str:
    return base64.b64encode(values.astype("<u4").tobytes()).decode()


def fingerprint(text: str | None, size: int = SIZE) -> np.ndarray:
    return smallest(text or "", parse(text or "")[0], size)


def edited_pair(text: str, after: str, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, str]:
    """Fingerprints of a text and of its edited text, and that text. Both share the parse of the part before the edit."""
    q = len(text) // 4
    keep = text[: len(text) - q]
    edited = keep + after[:q]
    ends, known, node = parse(keep)
    if not q:
        values = smallest(text, ends, size)
        return values, values, edited
    more, _, _ = parse(text[len(keep) :], dict(known), node, len(keep))
    others, _, _ = parse(edited[len(keep) :], known, node, len(keep))
    return smallest(text, ends + more, size), smallest(edited, ends + others, size), edited


FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_next(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Every document against its edited text and the next document, in ascending doc_id.

    The rows are dealt into ranges with about equal numbers of rows, each sorted: ranges of doc_id, and for rows without an id ranges of
    their texts' hashes. A range also gets the first document of the one after it, as that document is the successor of its last.
    """
    spark = docs.sparkSession
    text = text_of(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    # Rows of one id are in the order of h; that of rows without an id begins with the number n.
    rows = rows.select("*", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k"), F.when(F.col("doc_id").isNull(), F.conv(F.substring(F.sha2("text", 256), 1, 15), 16, 10).cast("long")).otherwise(-1).alias("n"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    share = rows.agg(F.count("*").alias("all"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    first_parts = -(-parts * share["nulls"] // share["all"]) if share["nulls"] else 0  # ranges without an id
    cuts = {}
    for column, ranges, which in (("n", first_parts, "doc_id is null"), ("k", max(1, parts - first_parts), "doc_id is not null")):
        found = rows.where(which).approxQuantile(column, [i / ranges for i in range(1, ranges)], 1 / (20 * ranges)) if ranges > 1 else []
        cuts[column] = sorted({int(c) for c in found})
    above = lambda c: F.size(F.filter(F.array(*map(F.lit, cuts[c])), lambda x: F.col(c) > x)) if cuts[c] else F.lit(0)
    dealt = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), above("n")).otherwise(above("k") + (len(cuts["n"]) + 1)))
    # A row for each range: the driver links every range to the one before it.
    firsts = dealt.groupBy("bucket").agg(F.min(F.struct("k", F.sha2("text", 256).alias("h"))).alias("f")).orderBy("bucket").collect()
    if not firsts:
        return spark.createDataFrame([], FIELDS)
    order = [r["bucket"] for r in firsts]
    before = {b: order[i - 1] for i, b in enumerate(order)}
    is_first = [(r["bucket"], r["f"]["k"], r["f"]["h"], before[r["bucket"]]) for r in firsts]
    marks = F.broadcast(spark.createDataFrame(is_first, "bucket int, k long, h string, before int"))
    heads = dealt.join(marks, ["bucket", "k"]).where(F.sha2("text", 256) == F.col("h")).dropDuplicates(["bucket"])
    heads = heads.select("k", "doc_id", "text", F.col("before").alias("bucket"), F.lit(1).alias("extra"))
    both = dealt.select("k", "doc_id", "text", "bucket", F.lit(0).alias("extra")).unionByName(heads)
    ordered = both.repartitionById(parts, F.col("bucket") % parts).withColumn("h", F.sha2("text", 256)).sortWithinPartitions("bucket", "extra", "k", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # (bucket, doc_id, text) of the row before
        waiting: tuple | None = None  # its output without near_next
        out: list[tuple] = []
        for batch in batches:
            for bucket, doc_id, text, extra in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if held is not None and held[0] == bucket:
                    own, other, edited = edited_pair(held[2], text, size)
                    if waiting is not None:
                        out.append((*waiting[:-1], likeness(waiting[-1], own, size)))
                    waiting = (held[1], len(held[2]), hashlib.sha256(edited.encode()).hexdigest(), written(own), written(other), likeness(own, other, size), own)
                if extra and waiting is not None:
                    out.append((*waiting[:-1], likeness(waiting[-1], fingerprint(text, size), size)))
                    waiting = None
                held = None if extra else (bucket, doc_id, text)
                if len(out) >= 500:
                    yield _batch(out)
                    out = []
        if out:
            yield _batch(out)

    return ordered.select("bucket", "doc_id", "text", "extra").mapInArrow(run, FIELDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], NAMES)


NAMES = [f.split()[0] for f in FIELDS.split(", ")]
TYPES = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[f.split()[1]] for f in FIELDS.split(", ")]


def op2_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))


def lz_edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op2: the lengths and the edited texts."""
    return op2_lz_fingerprint(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


EDITED_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS following FROM d)
SELECT doc_id, n AS n_chars, sha256(substring(t, 1, n - n // 4) || substring(following, 1, n // 4)) AS edited_sha256 FROM n
"""
