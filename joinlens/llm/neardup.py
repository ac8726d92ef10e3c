"""Near-duplicates by an LSH forest over MinHash signatures.

A document is its set of distinct five-word shingles. Documents with equal sets are one class. Each class
has a signature of minimum hashes, cut into TREES keys of DEPTH values. Sorting the keys of a tree brings
the longest common prefixes together; the classes next to each other with a prefix of at least LEAST_DEPTH
values are candidates, so the depth at which a region is compared follows how dense it is. Candidates
are screened by their whole signatures and confirmed on full shingle sets; links give components.

Three rounds, each only with pairs that no links join so far: close neighbours in a few trees (this joins large groups of
copies with few comparisons), wider neighbourhoods in all trees, and last an exact join of the classes in full-depth
buckets that still span several components. A pair at the threshold shares none of the 28 full-depth buckets
with probability (1 - 0.85**5)**28, 1.5e-7 at 0.85, and (1 - 0.8**5)**28, 1.5e-5 at 0.8; screening by the whole signature, at five standard
errors below the threshold, loses one in three million. ``exact=True`` puts the exact join over all classes in place of the last round's
buckets and screening, and loses nothing.

A shingle of very many classes is dealt to as many tasks as its rows ask for: of two classes in different components one is outside of the
shingle's largest component, so only those go to all of its tasks.

Cases: null or wordless text has the empty set and is linked with nothing. Rows with equal doc_id count as one
document: its sets share their links. Rows with a null doc_id are linked with nothing, have a null component and are
kept. An empty table gives no rows. Other columns are ignored (``deduplicated`` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from joinlens.llm.common import joined_bytes, release, saved, steps, table, text_of
from joinlens.llm.graph import components

WORDS = 5
TREES = 28
DEPTH = 5
LEAST_DEPTH = 4
#: Trees and neighbours of the first round, neighbours of the second.
FIRST_TREES, FIRST_NEAR, NEAR = 2, 2, 6
#: Least similarity in hundredths, unless a caller says otherwise.
PERCENT = 80
STEP = 1_000_000
#: Rows of one shingle that one task takes in the last round.
TASK_ROWS = 1000

_A = np.random.default_rng(7).integers(0, 1 << 32, (2, TREES * DEPTH), np.uint64).astype(np.uint32)
_A[0] |= 1
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_M, _MIX1, _MIX2 = 0xD6E8FEB86659FD93, np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        n = max(n, STEP + STEP // 4)
        for k, m in enumerate((_M, pow(_M, -1, 1 << 64))):
            p = np.full(n, m, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p)
    return _POWERS[0], _POWERS[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= _MIX1
    h ^= h >> np.uint64(29)
    h *= _MIX2
    return h ^ (h >> np.uint64(31))


def shingle_sets(data: np.ndarray, starts: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """The sorted 64-bit values of each text's distinct shingles."""
    n = len(starts) - 1
    empty = np.zeros(0, np.uint64)
    if not len(data):
        return [empty] * n
    low = _LOWER[data]
    inside = ~_SPACE[low]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts[:-1]] = True  # a word ends with its text
    edge[len(data)] = True
    begin = inside & (edge[:-1] | np.concatenate([[True], ~inside[:-1]]))
    last = inside & (edge[1:] | np.concatenate([~inside[1:], [True]]))
    b, e = np.flatnonzero(begin), np.flatnonzero(last) + 1
    if not len(b):
        return [empty] * n
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    word = _mixed((total[e] - total[b]) * down[b] + (e - b).astype(np.uint64))
    first = np.searchsorted(b, starts)
    out = []
    full = len(word) - words + 1
    if full > 0:
        run = np.zeros(full, np.uint64)
        for i in range(words):
            run *= np.uint64(_M)
            run += word[i : i + full]
        run = _mixed(run)
    for i in range(n):
        p, q = first[i], first[i + 1]
        if q - p >= words:
            out.append(np.unique(run[p : q - words + 1]))
        elif q > p:
            h = np.uint64(q - p)
            for w in word[p:q]:
                h = h * np.uint64(_M) + w
            out.append(_mixed(np.array([h], np.uint64)))
        else:
            out.append(empty)
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """TREES * DEPTH minimum hashes."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(TREES * DEPTH, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 4096):
        part = np.multiply.outer(_A[0], x[i : i + 4096])
        part ^= part >> np.uint32(15)
        part *= np.uint32(0x2C1B3C6D)
        part += _A[1][:, None]
        np.minimum(out, part.min(1), out=out)
    return out


def _sets(batches: Iterator[pa.RecordBatch], row) -> Iterator[list]:
    for batch in steps(batches, "text", STEP):
        with np.errstate(over="ignore"):
            data, starts = joined_bytes(batch, "text")
            yield [row(i, s) for i, s in zip(batch.column(0).to_pylist(), shingle_sets(data, starts), strict=True)]


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def row(i: int | None, s: np.ndarray) -> tuple:
        return i, len(s), int(s.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(_mixed(s)).view(np.int64)) if len(s) else 0, signature(s).astype(">u4").tobytes() if len(s) else b""

    for rows in _sets(batches, row):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "n", "h1", "h2", "sig"])


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _sets(batches, lambda i, s: (i, s.tobytes())):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.binary()), strict=True)], ["node", "shingles"])


def _single_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _sets(batches, lambda i, s: (i, s)):
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([i for i, _ in rows], np.int64), [len(s) for _, s in rows])), pa.array(np.concatenate([s for _, s in rows]).view(np.int64))], ["node", "shingle"])


def _neighbours(keys: DataFrame, near: int) -> DataFrame:
    """u, v: classes of different components that are at most ``near`` places apart in a tree's order and share LEAST_DEPTH values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, node, component = (np.asarray(batch.column(i)) for i in (0, 1, 2))
            key = np.frombuffer(b"".join(batch.column(3).to_pylist()), ">u4").reshape(-1, DEPTH)[:, :LEAST_DEPTH].astype(np.uint32)
            fresh = 0
            if held is not None:
                fresh = len(held[0])
                tree, node, component, key = (np.concatenate([a, b]) for a, b in zip(held, (tree, node, component, key), strict=True))
            out_u, out_v = [], []
            for lag in range(1, near + 1):
                a, b = slice(max(0, fresh - lag), max(0, len(tree) - lag)), slice(max(0, fresh - lag) + lag, None)
                hit = (tree[a] == tree[b]) & (component[a] != component[b]) & (key[a] == key[b]).all(1)
                out_u.append(np.maximum(node[a][hit], node[b][hit]))
                out_v.append(np.minimum(node[a][hit], node[b][hit]))
            held = tuple(x[-near:] for x in (tree, node, component, key))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_u)), pa.array(np.concatenate(out_v))], ["u", "v"])

    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keys.repartitionByRange(parts, "tree", "key", "node").sortWithinPartitions("tree", "key", "node")
    return ordered.select("tree", "node", "component", "key").mapInArrow(run, "u long, v long").distinct()


def _keys(nodes: DataFrame, trees: int) -> DataFrame:
    size = 4 * DEPTH
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), F.substring("sig", 1 + t * size, size).alias("key")) for t in range(trees)])).alias("k")
    return nodes.select("node", "component", each).select("node", "component", "k.tree", "k.key")


def _screened(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose signatures agree enough, within five standard errors, and whose sizes allow it; the smaller set first."""
    least = percent / 100 - 5 * (percent / 100 * (1 - percent / 100) / (TREES * DEPTH)) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, TREES * DEPTH) for i in (2, 3))
                keep = pa.array((a == b).mean(1) >= least)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["u", "v"])

    own = nodes.select("node", "sig", "n")
    both = pairs.join(own.withColumnsRenamed({"node": "u", "sig": "a", "n": "nu"}), "u").join(own.withColumnsRenamed({"node": "v", "sig": "b", "n": "nv"}), "v")
    near = both.where(f"100 * least(nu, nv) >= {percent} * greatest(nu, nv)")
    first = F.col("nu") <= F.col("nv")
    return near.select(F.when(first, F.col("u")).otherwise(F.col("v")).alias("u"), F.when(first, F.col("v")).otherwise(F.col("u")).alias("v"), "a", "b").mapInArrow(run, "u long, v long")


def _confirmed(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["u", "v"])

    # Only the representatives of classes that are in a pair are read in full again. Of a pair, the smaller set travels twice.
    wanted = saved(pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct(), "wanted")
    texts = docs.join(wanted, "doc_id", "left_semi")
    sets = saved(texts.select("doc_id", "text").mapInArrow(_full_sets, "node long, shingles binary"), "shingles")
    both = pairs.join(sets.withColumnsRenamed({"node": "u", "shingles": "a"}), "u").join(sets.withColumnsRenamed({"node": "v", "shingles": "b"}), "v")
    return saved(both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long"), "confirmed")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept. Linked are sets with 100 * common >= percent * all shingles."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    signed = saved(rows.mapInArrow(_signatures, "doc_id long, n long, h1 long, h2 long, sig binary"), "signatures")
    # Copies of one set, however many, become one row before anything is shuffled by it.
    classes = signed.where("n > 0 and doc_id is not null").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("node"), F.first("sig").alias("sig"))
    nodes = saved(classes, "classes").withColumn("component", F.col("node"))
    links = None
    for trees, near in ((FIRST_TREES, FIRST_NEAR), (TREES, NEAR), (TREES, 0)):
        if links is not None:
            found = components(links)
            nodes = saved(nodes.drop("component").join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "classes")
        keys = _keys(nodes, trees)
        last = not near
        pairs = _unjoined(None if exact else keys, rows, nodes, percent) if last else _neighbours(keys, near)
        pairs = saved(_ordered(pairs, nodes) if last and exact else _screened(pairs, nodes, percent), "candidates")
        new = _confirmed(pairs, rows, percent)
        release(spark)
        links = new if links is None else links.unionByName(new)
    found = saved(components(links), "components")
    of_class = nodes.select("n", "h1", "h2", "node").join(found, "node", "left").select("n", "h1", "h2", F.coalesce("component", "node").alias("component"))
    out = signed.drop("sig").join(of_class, ["n", "h1", "h2"], "left")
    # Rows that share a doc_id are one document.
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id").isNull() | (component == F.col("doc_id"))).alias("kept"))


def _ordered(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs with the smaller set first."""
    own = nodes.select("node", "n")
    both = pairs.join(own.withColumnsRenamed({"node": "u", "n": "nu"}), "u").join(own.withColumnsRenamed({"node": "v", "n": "nv"}), "v")
    first = F.col("nu") <= F.col("nv")
    return both.select(F.when(first, F.col("u")).otherwise(F.col("v")).alias("u"), F.when(first, F.col("v")).otherwise(F.col("u")).alias("v"))


def _unjoined(keys: DataFrame | None, docs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """All pairs of different components that could still be near, by exact prefix filtering.

    Taken are the classes in a full-depth bucket that spans several components (all classes without ``keys``). Two sets at the threshold share one
    of the rarest n - ceil(threshold * n) + 1 shingles of each, whatever the order; rarest first, a
    shingle that all of a crowd has is hardly ever among them, so the crowd's size doesn't multiply.
    """
    if keys is None:
        own = nodes.select("node")
    else:
        keys = keys.withColumn("bucket", F.xxhash64("tree", "key"))
        mixed = keys.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("bucket")
        own = saved(keys.join(mixed, "bucket").select("node").distinct(), "mixed")
    texts = docs.join(own.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    tokens = texts.select("doc_id", "text").mapInArrow(_single_shingles, "node long, shingle long").distinct()
    # Counted apart and saved: the table of counts is joined by its measured size, and a shingle of very many classes needn't meet in one task.
    twice = saved(tokens.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1"), "frequencies")
    often = tokens.join(twice, "shingle", "left").withColumn("df", F.coalesce("df", F.lit(1)))
    rare = Window.partitionBy("node").orderBy("df", "shingle")
    ranked = often.withColumn("rank", F.row_number().over(rare)).withColumn("n", F.count("*").over(Window.partitionBy("node")))
    front = ranked.where(f"df > 1 and rank <= n - ceil(n * {percent} / 100) + 1").join(nodes.select("node", "component"), "node")
    front = saved(front.select("shingle", "node", "component", "n", "rank"), "front")
    sizes = front.groupBy("shingle", "component").agg(F.count("*").alias("size")).groupBy("shingle")
    most = sizes.agg(F.sum("size").alias("rows"), F.count("*").alias("parts"), F.max(F.struct("size", "component")).alias("most")).where("parts > 1")
    shared = saved(most.select("shingle", F.col("most.component").alias("main"), F.ceil(F.col("rows") / TASK_ROWS).cast("int").alias("tasks")), "shared")
    rows = front.join(shared, "shingle")
    a = rows.withColumn("task", F.pmod(F.xxhash64("node"), "tasks").cast("int")).alias("a")
    b = rows.where("component <> main").withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).alias("b")
    once = F.expr("a.component <> b.component and (a.component = a.main or a.node > b.node)")
    # A common shingle at some rank leaves no more than the ranks from there on to share.
    room = F.expr(f"(100 + {percent}) * (least(a.n - a.rank, b.n - b.rank) + 1) >= {percent} * (a.n + b.n)")
    near = (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.task") == F.col("b.task")) & once & room & F.expr(f"100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)")
    return a.join(b, near).select(F.greatest("a.node", "b.node").alias("u"), F.least("a.node", "b.node").alias("v")).distinct()


def deduplicated(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of the documents that are kept: the smallest doc_id of each component."""
    gone = saved(near_duplicates(docs, percent).where("not kept").select(F.col("doc_id").alias("gone")).distinct(), "duplicates")
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 85)


OP4_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
sets AS (SELECT s.doc_id, n, md5(string_agg(s, chr(10) ORDER BY s)) AS h FROM shingles s JOIN sizes USING (doc_id) GROUP BY s.doc_id, n),
classes AS (SELECT h, n, min(doc_id) AS node FROM sets GROUP BY h, n),
own AS (SELECT s.s, c.node, c.n, row_number() OVER (PARTITION BY c.node ORDER BY f.df, s.s) AS rare
  FROM shingles s JOIN classes c ON s.doc_id = c.node
  JOIN (SELECT s, count(*) AS df FROM shingles JOIN classes ON doc_id = node GROUP BY s) f ON f.s = s.s),
front AS (SELECT * FROM own WHERE rare <= n - ceil(n * 0.85) + 1),
pairs AS (SELECT DISTINCT a.node AS u, b.node AS v, a.n AS nu, b.n AS nv FROM front a JOIN front b ON a.s = b.s AND a.node < b.node
  WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
links AS (SELECT u, v FROM pairs p JOIN own a ON a.node = u JOIN own b ON b.node = v AND b.s = a.s
  GROUP BY u, v, nu, nv HAVING 100 * count(*) >= 85 * (nu + nv - count(*))),
edges AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach AS (SELECT node AS a, node AS b FROM classes UNION SELECT r.a, e.v FROM reach r JOIN edges e ON e.u = r.b),
comp AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, coalesce(c.component, d.doc_id) AS component_id,
  coalesce(c.component, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sets s ON s.doc_id = d.doc_id LEFT JOIN classes k ON k.h = s.h AND k.n = s.n LEFT JOIN comp c ON c.node = k.node
"""
