"""Removal of repeated byte strings with a distributed, common-prefix-aware sort of suffixes.

A byte goes if a string of WINDOW bytes that covers it also starts earlier: in a smaller document, or
earlier in the same one.

Sorting every suffix would move the text many times over. Here a sparse set of suffixes is sorted that
still finds every repeat: each window of WINDOW bytes owns an anchor, the leftmost of its smallest hashed
KMER-byte strings. Equal windows own equal anchors at equal offsets, so

1. anchors whose KMER bytes occur once are dropped (sorted by hash, streamed);
2. every task sorts the suffixes at its other anchors into runs, collapses those with equal contexts to their earliest, and sends the runs front-coded
   (length of the common prefix with the suffix before, then the rest);
3. each bucket's runs are merged by a loser tree that carries common prefix lengths and only compares bytes
   beyond them; the lengths that it puts out say which suffixes share how many bytes;
4. for each offset, suffixes that share the bytes right of the anchor, and whose bytes left of it are
   equal, own equal windows: all but the earliest are repeats.

A KMER-byte string that is very common, in different surroundings, is split: its suffixes are sent once for each of PARTS ranges of offsets,
and dealt by the bytes that all windows of these offsets share (83 of 100), so equal windows still meet. How often a string occurs is added up
while it streams by.

Cases: null text is empty. Rows that repeat both doc_id and text are one document: each gives the same
row. Rows with one doc_id and different texts count as different documents, in the order of a hash of their texts; null
ids come first. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinlens.llm.common import joined_bytes, release, saved, steps, table, text_of

WINDOW = 100
KMER = 32
REACH = WINDOW - KMER  # the largest offset of an anchor in its window
#: Suffixes of a task's run, and of a bucket.
RUN = 200_000
BUCKET = 150_000
#: A KMER-byte string that occurs more often is split, and at most this many strings are (then only the more common ones).
COMMON = 20_000
MAX_COMMON = 1_000_000
PARTS = 4
CHUNK = 8_000_000  # positions take 24 bits beside 40 of hash

_M = 0xD6E8FEB86659FD93
_UP: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_UP[0]) < n:
        n = max(n, 2_200_000)
        for k, m in enumerate((_M, pow(_M, -1, 1 << 64))):
            p = np.full(n, m, np.uint64)
            p[0] = 1
            _UP[k] = np.cumprod(p)
    return _UP[0], _UP[1]


def _kmers(data: np.ndarray) -> np.ndarray:
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    h = (total[KMER:] - total[:-KMER]) * down[: len(data) - KMER + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9FB21C651E98DF25)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(31)
    return h


def anchors(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """The anchors of all windows: text number, position in it, least and largest offset in the windows that own it, hash of its KMER bytes."""
    if len(data) > CHUNK:  # one very long text
        parts = [anchors_of(data[c : c + CHUNK + WINDOW - 1], np.array([0, min(CHUNK + WINDOW - 1, len(data) - c)])) for c in range(0, len(data), CHUNK)]
        for i, c in enumerate(range(0, len(data), CHUNK)):
            parts[i] = (parts[i][0], parts[i][1] + c, *parts[i][2:])
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    return anchors_of(data, starts)


def anchors_of(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    if len(data) < WINDOW:
        return none
    with np.errstate(over="ignore"):
        h = _kmers(data)
    key = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= REACH + 1:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    key = np.minimum(key[: len(key) - (REACH + 1 - width)], key[REACH + 1 - width :])  # a value for each window start
    at = (key & np.uint64((1 << 24) - 1)).astype(np.int64)
    size = np.diff(starts)
    text = np.repeat(np.arange(len(size)), size)[: len(at)]
    inside = np.arange(len(at)) + WINDOW <= starts[1:][text]
    first = np.flatnonzero(inside & np.concatenate([[True], (at[1:] != at[:-1]) | ~inside[:-1] | (text[1:] != text[:-1])]))
    if not len(first):
        return none
    last = np.flatnonzero(inside & np.concatenate([(at[1:] != at[:-1]) | ~inside[1:] | (text[1:] != text[:-1]), [True]]))
    a = at[first]
    return text[first], a - starts[text[first]], a - last, a - first, h[a]


#: where: position, least and largest offset, and two flags in one number, as many anchors are moved.
#: Above them, how often the step has the kmer (MOST at most). A row with a negative place tells a common kmer and, as doc_id, how often it occurs.
ANCHOR = "kmer long, doc_id long, tie int, where long"
SAME, MOST = 47, 65_535
KNOWN, ANYWHERE = 2, 1


def pack(pos: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return pos << 16 | low << 9 | high << 2


def unpack(where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return where >> 16 & (1 << SAME - 16) - 1, where >> 9 & 127, where >> 2 & 127


def _flags(kmer: np.ndarray) -> np.ndarray:
    """Flags, and how often the step has the kmer. KNOWN: the anchor repeats, as its step has the kmer twice. The first of a step goes to its kmer's task,
    where it meets those of other steps; the others, whose fate is known, go ANYWHERE. So a very common kmer
    sends one row for each step to its task."""
    _, first, inverse, count = np.unique(kmer, return_index=True, return_inverse=True, return_counts=True)
    out = np.where(count[inverse] > 1, KNOWN | ANYWHERE, 0)
    out[first] &= ~ANYWHERE
    return out | np.minimum(count[inverse], MOST) << SAME


NAMES = [f.split()[0] for f in ANCHOR.split(", ")]


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, "text"):
        data, starts = joined_bytes(batch, "text")
        text, pos, low, high, kmer = anchors(data, starts)
        rows = pa.array(text)
        yield pa.RecordBatch.from_arrays([pa.array(kmer.view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(pack(pos, low, high) | _flags(kmer))], NAMES)


def _repeated(above: int):
    """Of rows sorted by kmer, those whose kmer occurs twice at least or is known to, and a row for each kmer that occurs more than ``above`` times. Holds one row back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        linked = False  # the held row's kmer equals the one before it
        open_kmer, open_n = 0, 0  # of the kmer that the last batch ended with

        def common(kmers: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            big = n > above
            return pa.RecordBatch.from_arrays([pa.array(kmers[big]), pa.array(n[big]), pa.array(np.zeros(big.sum(), np.int32)), pa.array(np.full(big.sum(), -1))], NAMES)

        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.asarray(batch.column(0))
            edge = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            where = np.asarray(batch.column(3))
            n = np.add.reduceat(np.where(where & ANYWHERE, 0, where >> SAME), edge)
            if open_n and k[0] == open_kmer:
                n[0] += open_n
            elif open_n > above:
                yield common(np.array([open_kmer]), np.array([open_n]))
            if (n[:-1] > above).any():
                yield common(k[edge[:-1]], n[:-1])
            open_kmer, open_n = int(k[-1]), int(n[-1])
            same = k[1:] == k[:-1]
            if held is not None:
                meets = held.column(0)[0].as_py() == int(k[0])
                if linked or meets or held.column(3)[0].as_py() & KNOWN:
                    yield held
            else:
                meets = False
            keep = np.concatenate([[meets], same]) | np.concatenate([same, [False]]) | (np.asarray(batch.column(3)) & KNOWN != 0)
            linked = bool(meets) if len(k) == 1 else bool(same[-1])
            held = batch.slice(len(k) - 1, 1)
            keep[-1] = False
            if keep.any():
                yield batch.filter(pa.array(keep))
        if held is not None and (linked or held.column(3)[0].as_py() & KNOWN):
            yield held
        if open_n > above:
            yield common(np.array([open_kmer]), np.array([open_n]))

    return run


def encode_run(right: np.ndarray, left: np.ndarray, doc: np.ndarray, tie: np.ndarray, pos: np.ndarray, low: np.ndarray, high: np.ndarray) -> bytes:
    """A sorted run, front-coded: the common prefix with the suffix before and the rest; bytes that no window uses are not sent."""
    n = len(doc)
    common = np.zeros(n, np.uint8)
    if n > 1:
        differ = right[1:] != right[:-1]
        common[1:] = np.where(differ.any(1), differ.argmax(1), WINDOW)
    column = np.arange(WINDOW)
    rest = right[(column >= common[:, None]) & (column < WINDOW - low[:, None])]
    lefts = left[np.arange(REACH) < high[:, None]]
    head = np.array([n, len(rest), len(lefts)], np.int64)
    return zlib.compress(b"".join(x.tobytes() for x in (head, common, low.astype(np.uint8), high.astype(np.uint8), doc.astype(np.int64), tie.astype(np.int32), pos.astype(np.int32), rest, lefts)), 1)


class Run:
    """A front-coded run, read from its first suffix to its last."""

    def __init__(self, blob: bytes) -> None:
        raw = zlib.decompress(blob)
        n, rests, lefts = np.frombuffer(raw, np.int64, 3)
        at, out = 24, []
        for kind, size in ((np.uint8, n), (np.uint8, n), (np.uint8, n), (np.int64, n), (np.int32, n), (np.int32, n)):
            out.append(np.frombuffer(raw, kind, size, at))
            at += out[-1].nbytes
        self.n = int(n)
        common, self.low, self.high, self.doc, self.tie, self.pos = out
        self.common = common.tolist()
        self.need = (WINDOW - self.low).tolist()
        self.rest, self.rest_at = raw[at : at + int(rests)], 0
        self.left = np.zeros((self.n, REACH), np.uint8)
        self.left[np.arange(REACH) < self.high[:, None]] = np.frombuffer(raw, np.uint8, int(lefts), at + int(rests))
        self.at, self.suffix = -1, b""

    def step(self) -> int:
        """Go to the next suffix; the length of its common prefix with the one before, or -1 at the end."""
        self.at += 1
        if self.at >= self.n:
            return -1
        common, need = self.common[self.at], self.need[self.at]
        more = max(0, need - common)
        suffix = self.suffix[:common] + self.rest[self.rest_at : self.rest_at + more]
        self.suffix = suffix + bytes(WINDOW - len(suffix))  # what no window uses is zero
        self.rest_at += more
        return common


def merged(runs: list[Run]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Run and place of all suffixes in order, and each one's common prefix with the one before.

    A loser tree whose nodes hold their loser's common prefix with the winner above. Of two that share different lengths with
    the last output the longer is smaller, without a look at its bytes; equal lengths are compared from there on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    common = [runs[i].step() if i < len(runs) else -1 for i in range(k)]  # -1: at its end
    losers = [0] * k

    def beats(a: int, b: int) -> bool:
        """Whether a comes before b; sets the loser's common prefix."""
        x, y = common[a], common[b]
        if x != y:
            return x > y
        if x < 0:
            return True
        s, t = runs[a].suffix, runs[b].suffix
        rest = int.from_bytes(s[x:], "big") ^ int.from_bytes(t[x:], "big")
        if not rest:
            if a < b:
                common[b] = WINDOW
            else:
                common[a] = WINDOW
            return a < b
        same = WINDOW - (rest.bit_length() + 7) // 8
        if s[same] < t[same]:
            common[b] = same
            return True
        common[a] = same
        return False

    level = list(range(k))
    at = k
    while len(level) > 1:
        at //= 2
        up = []
        for i in range(0, len(level), 2):
            a, b = level[i], level[i + 1]
            if not beats(a, b):
                a, b = b, a
            up.append(a)
            losers[at + i // 2] = b
        level = up
    winner = level[0]
    out_run, out_at, out_common = [], [], []
    while common[winner] >= 0:
        run = runs[winner]
        out_run.append(winner)
        out_at.append(run.at)
        out_common.append(common[winner])
        common[winner] = run.step()
        node = (winner + k) >> 1
        while node:
            other = losers[node]
            if not beats(winner, other):
                losers[node], winner = winner, other
            node >>= 1
    return np.array(out_run, np.int64), np.array(out_at, np.int64), np.array(out_common, np.int64)


def repeats(runs: list[Run]) -> tuple[np.ndarray, ...]:
    """doc_id, tie, start and end of what must go, for every suffix whose windows start earlier elsewhere."""
    run, at, common = merged(runs)
    base = np.concatenate([[0], np.cumsum([r.n for r in runs])[:-1]])
    order = base[run] + at
    take = lambda name: np.concatenate([getattr(r, name) for r in runs])[order]
    doc, tie, pos, low, high, left = (take(x) for x in ("doc", "tie", "pos", "low", "high", "left"))
    n = len(doc)
    by_place = np.lexsort((pos, tie, doc))
    new = np.concatenate([[False], (np.diff(doc[by_place]) != 0) | (np.diff(tie[by_place]) != 0) | (np.diff(pos[by_place]) != 0)])
    rank = np.empty(n, np.int64)
    rank[by_place] = np.cumsum(new)  # rows of one place are equal
    gone = np.zeros((n, REACH + 2), bool)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for offset in range(REACH + 1):
            if offset:
                h = (h + left[:, offset - 1] + np.uint64(1)) * np.uint64(_M)
                h ^= h >> np.uint64(29)
            own = np.flatnonzero((low <= offset) & (offset <= high))
            if len(own) < 2:
                continue
            group = np.cumsum(common < WINDOW - offset)[own].astype(np.uint64)
            key = (group * np.uint64(0x9FB21C651E98DF25)) ^ h[own]
            s = np.argsort(key, kind="stable")
            edge = np.flatnonzero(np.concatenate([[True], np.diff(key[s]) != 0]))
            least = np.repeat(np.minimum.reduceat(rank[own[s]], edge), np.diff(np.append(edge, len(s))))
            gone[own[s], offset] = rank[own[s]] > least
    return _spans(gone, doc, tie, pos)


def _spans(gone: np.ndarray, doc: np.ndarray, tie: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, ...]:
    begin = gone & ~np.hstack([np.zeros((len(gone), 1), bool), gone[:, :-1]])
    end = gone & ~np.hstack([gone[:, 1:], np.zeros((len(gone), 1), bool)])
    i, low = np.nonzero(begin)
    _, high = np.nonzero(end)
    return doc[i], tie[i], pos[i] - high, pos[i] - low + WINDOW


SPAN = "bucket int, run binary, doc_id long, tie int, start int, end int"


def _span_batch(found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    doc, tie, start, end = found
    n = len(doc)
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(doc.astype(np.int64)), *(pa.array(x.astype(np.int32)) for x in (tie, start, end))], [f.split()[0] for f in SPAN.split(", ")])


def dealt(held: tuple[np.ndarray, ...], buckets: int, often: np.ndarray) -> tuple[np.ndarray, ...]:
    """Buckets and suffixes; those of common kmers once for each range of offsets, cut to what its windows use."""
    kmer, right, left, doc, tie, pos, low, high = held
    hot = often[np.minimum(np.searchsorted(often, kmer), len(often) - 1)] == kmer if len(often) else np.zeros(len(kmer), bool)
    bucket = (kmer.view(np.uint64) >> np.uint64(16)) % np.uint64(buckets)
    if not hot.any():
        return bucket, *held[1:]
    out = [tuple(x[~hot] for x in (bucket, *held[1:]))]
    cuts = np.linspace(0, REACH + 1, PARTS + 1).astype(int)
    for first, last in zip(cuts, cuts[1:] - 1, strict=False):
        own = hot & (low <= last) & (high >= first)
        a, b = np.maximum(low[own], first), np.minimum(high[own], last)
        r, x = right[own].copy(), left[own].copy()
        r[np.arange(WINDOW) >= WINDOW - a[:, None]] = 0
        x[np.arange(REACH) >= b[:, None]] = 0
        h = kmer[own].view(np.uint64) + np.uint64(first)
        for column in [*r[:, KMER : WINDOW - last].T, *x[:, :first].T]:  # what all windows of these offsets share
            h = (h + column + np.uint64(1)) * np.uint64(_M)
            h ^= h >> np.uint64(29)
        out.append(((h >> np.uint64(16)) % np.uint64(buckets), r, x, doc[own], tie[own], pos[own], a, b))
    return tuple(np.concatenate(parts) for parts in zip(*out, strict=True))


def _make_runs(buckets: int, often: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            with np.errstate(over="ignore"):
                bucket, right, left, doc, tie, pos, low, high = dealt(tuple(np.concatenate(x) for x in zip(*held, strict=True)), buckets, often)
            whole = np.ascontiguousarray(np.hstack([bucket.astype(">u4").view(np.uint8).reshape(-1, 4), right, left, low[:, None].astype(np.uint8), high[:, None].astype(np.uint8)]))
            words = whole.view(f"S{whole.shape[1]}").ravel()
            order = np.lexsort((pos, tie, doc, words))
            # Of suffixes with equal bytes and offsets on both sides the earliest stays; the others' windows all go.
            same = np.concatenate([[False], (whole[order][1:] == whole[order][:-1]).all(1)])
            place = np.stack([doc[order], tie[order].astype(np.int64), pos[order].astype(np.int64)], 1)
            first = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
            later = same & (place != place[first]).any(1)
            x = order[later]
            if len(x):
                yield _span_batch((doc[x], tie[x], pos[x] - high[x], pos[x] - low[x] + WINDOW))
            keep = order[~same]
            edge = np.flatnonzero(np.concatenate([[True], np.diff(bucket[keep].astype(np.int64)) != 0]))
            rows = [(int(bucket[g[0]]), encode_run(right[g], left[g], doc[g], tie[g], pos[g], low[g], high[g])) for g in np.split(keep, edge[1:])]
            n = len(rows)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.nulls(n, pa.int64()), *(pa.nulls(n, pa.int32()) for _ in range(3))], [f.split()[0] for f in SPAN.split(", ")])

        for batch in steps(batches, "text"):
            data, starts = joined_bytes(batch, "text")
            lists = batch.column(3)
            sizes = np.asarray(pc.list_value_length(lists))
            flat = lists.flatten()
            kmer = np.asarray(flat.field(0))
            pos, low, high = unpack(np.asarray(flat.field(1)))
            doc, tie = (np.repeat(np.asarray(batch.column(i)), sizes) for i in (0, 1))
            text = np.repeat(np.arange(len(sizes)), sizes)
            padded = np.concatenate([np.zeros(REACH, np.uint8), data, np.zeros(WINDOW, np.uint8)])
            for i in range(0, len(pos), RUN):
                part = slice(i, i + RUN)
                at = (starts[text[part]] + pos[part] + REACH)[:, None]
                right = padded[at + np.arange(WINDOW)]
                right[np.arange(WINDOW) >= WINDOW - low[part][:, None]] = 0
                left = padded[at - 1 - np.arange(REACH)]
                left[np.arange(REACH) >= high[part][:, None]] = 0
                held.append((kmer[part], right, left, doc[part], tie[part], pos[part], low[part], high[part]))
                count += len(right)
                if count >= RUN:
                    yield from flush()
                    held.clear()
                    count = 0
        if count:
            yield from flush()

    return run


def _merge_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bucket, runs = None, []
    for batch in batches:
        for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if b != bucket and runs:
                yield _span_batch(repeats(runs))
                runs = []
            bucket = b
            runs.append(Run(blob))
    if runs:
        yield _span_batch(repeats(runs))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, "text"):
        out = []
        for doc_id, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            raw = text.encode()
            kept, at, n = [], 0, 0
            reach = -1
            for start, end in sorted((s["start"], s["end"]) for s in spans or ()):
                if start > reach:  # a new maximal run; one that only touches the last goes on with it
                    n += 1
                    kept.append(raw[at:start])
                reach = max(reach, end)
                at = reach
            kept.append(raw[at:])
            left = b"".join(kept)
            out.append((doc_id, len(raw), len(raw) - len(left), n, hashlib.sha256(left).hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, tie, start, end (bytes) of strings that must go; they may overlap. Null ids are the least number."""
    spark = docs.sparkSession
    rows = _rows(docs)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = rows.select("doc_id", "tie", "text").mapInArrow(_find_anchors, ANCHOR)
    place = F.when(F.col("where").bitwiseAND(ANYWHERE) != 0, F.xxhash64("doc_id", "where")).otherwise(F.col("kmer"))
    twice = saved(found.repartition(parts, place).sortWithinPartitions("kmer").mapInArrow(_repeated(COMMON), ANCHOR), "anchors")
    release(spark)
    anchors_of_all, often = twice.where("where >= 0"), _common(twice)
    buckets = max(parts, -(-(anchors_of_all.count() + (PARTS - 1) * sum(n for _, n in often)) // BUCKET))
    of_doc = anchors_of_all.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("kmer", "where")).alias("anchors"))
    texts = rows.select("doc_id", "tie", "text").join(of_doc, ["doc_id", "tie"])
    made = saved(texts.select("doc_id", "tie", "text", "anchors").mapInArrow(_make_runs(buckets, np.array(sorted(k for k, _ in often), np.int64)), SPAN), "runs")
    release(spark)
    sent = made.where("bucket is not null").select("bucket", "run").repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket")
    spans = sent.mapInArrow(_merge_buckets, SPAN).unionByName(made.where("bucket is null"))
    return saved(spans.select("doc_id", "tie", "start", "end"), "spans")


def _common(twice: DataFrame) -> list[tuple[int, int]]:
    """The common kmers and how often each occurs: MAX_COMMON at most, the most common first."""
    told = twice.where("where < 0").select("kmer", F.col("doc_id").alias("n")).orderBy(F.desc("n"), "kmer").limit(MAX_COMMON)
    return list(zip(*(c.to_pylist() for c in told.toArrow().columns), strict=True))


def _rows(docs: DataFrame) -> DataFrame:
    text = text_of(docs)
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.hash(text).alias("tie"), text.alias("text"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    spans = repeated_spans(docs)
    release(docs.sparkSession)
    of_doc = spans.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    out = _rows(docs).join(of_doc, ["doc_id", "tie"], "left").select("doc_id", "text", "spans").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(-(1 << 63))))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))
