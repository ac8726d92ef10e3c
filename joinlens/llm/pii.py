"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans (email, ip, card, phone). The field's nodes are the tokens that could be
personal data: base spans, other number-like tokens, and words that equal an email's local part. Neighbours
in the text share chain potentials; equal or similar tokens anywhere in the document share skip potentials;
loopy sum-product passes messages until labels agree. A token that is not a base span but ends up with a
label becomes an added span, so that a number written once with and once without its prefix is found twice.

The potentials are learned from the base spans of a bounded sample of documents: for each form of a number (how many digits, how
they are parted, whether they pass Luhn) how much more often it is a span of a kind than a number outside of spans; how much more often
equal tokens, and neighbours, have one kind than two. Words and forms that were never in a span lean to no label. The field runs in every
document with a candidate, whether or not it has a base span.

Cases: null text is empty and has no spans. Repeated rows each give a row. A sample without spans gives the potentials of ``Weights()``. The field works on the tokens
of one document; equal tokens are linked in a ring with their first one, so a token that is repeated any
number of times needs two links each. All steps take time linear in the text and its tokens. Other columns are ignored (``redact`` keeps them).
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinlens.llm.common import steps, table, text_of

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+){3,}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"(?<![A-Za-z0-9])\(?[0-9][\x20().0-9-]{5,}[0-9](?![A-Za-z0-9])")
_WORDLIKE = re.compile(r"[\w.%+-]+")
_ANY = re.compile(r"[0-9@]")

Span = tuple[str, int, int]

#: Bound of the sample that potentials are learned from, in documents (about).
SAMPLE = 20_000
#: A base span's own potential: it stays what the pattern says.
CERTAIN = 12.0
#: Limits of learned potentials.
FORM_LIMIT, SKIP_LIMITS, CHAIN_LIMITS = 4.0, (2.0, 6.0), (0.0, 1.0)
#: What a word, or a form that the sample doesn't have, is worth as a span.
UNSEEN = -2.0


@dataclass(frozen=True)
class Weights:
    """Potentials of the field: of a form's kinds, and of agreement along skip and chain links."""

    forms: dict[str, dict[str, float]] = field(default_factory=dict)
    skip: float = 4.0
    chain: float = 0.3


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches around each @, in linear time."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield "email", start, end
        at = text.find("@", max(at + 1, end))


def _ips(text: str) -> Iterator[Span]:
    """A run of dotted numbers gives a match for every four of them."""
    for run in _DOTTED.finditer(text):
        at, parts = run.start(), run.group().split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in four):
                yield "ip", at, at + size
            at += size + 1


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def base_spans(text: str) -> list[Span]:
    """By start, then kind as listed."""
    if not _ANY.search(text):
        return []
    out = list(_emails(text))
    out += _ips(text)
    out += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if 14 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
    out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def form(token: str) -> str:
    """A number's form: how many digits, in how many parts, parted by what, and whether they could be a card or an address. A leading plus sign, which only base spans have, doesn't count."""
    parts = re.findall("[0-9]+", token)
    digits = "".join(parts)
    parted = "." if "." in token else " " if len(parts) > 1 else ""
    valid = "L" if len(digits) >= 14 and luhn(digits) else "A" if parted and len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in parts) else ""
    return f"{min(len(digits), 20)}{parted}{min(len(parts), 9)}{valid}"


def _nodes(text: str, base: list[Span]) -> list[Span]:
    """Base spans and the other tokens that could be personal data, by start; kind is '' for these."""
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    tops = list(accumulate((b for _, b in taken), max))

    def free(a: int, b: int) -> bool:
        i = bisect_left(starts, b)
        return not i or tops[i - 1] <= a

    out = list(base)
    for m in _NUMBER.finditer(text):
        # More digits than any kind has: the parts may be tokens of their own.
        found = [(m.start(), m.end())] if len(_digits(m.group())) < 20 else [(m.start() + p.start(), m.start() + p.end()) for p in re.finditer("[0-9]+", m.group())]
        out += [("", a, b) for a, b in found if 7 <= len(_digits(text[a:b])) and free(a, b)]
    names = {name for k, a, b in base if k == "email" and len(name := text[a:b].partition("@")[0].strip(".%+-")) >= 5 and not name.isalpha()}
    for m in _WORDLIKE.finditer(text) if names else ():
        name = m.group().strip(".%+-")
        if name in names and text[m.end() : m.end() + 1] != "@":
            a = m.start() + m.group().index(name)
            if free(a, a + len(name)):
                out.append(("", a, a + len(name)))
    return sorted(set(out), key=lambda s: (s[1], s[2], s[0]))


def _forms(kind: str, token: str) -> list[str]:
    """Keys under which tokens count as repeated (first) or similar (the others)."""
    if kind == "email" or (not kind and not token[:1].isdigit() and "(" not in token[:1]):
        return [token, token.partition("@")[0].strip(".%+-").lower()]
    d = _digits(token)
    return [d, d[-10:]] if len(d) >= 10 else [d]


def _links(text: str, nodes: list[Span]) -> tuple[set[tuple[int, int]], set[tuple[int, int]]]:
    """Chain links and skip links, each as pairs of nodes."""
    chain = {(i, i + 1) for i in range(len(nodes) - 1) if nodes[i + 1][1] - nodes[i][2] <= 2}
    groups: dict[str, list[int]] = defaultdict(list)
    for i, (kind, a, b) in enumerate(nodes):
        for key in dict.fromkeys(_forms(kind, text[a:b])):
            groups[key].append(i)
    skip = set()
    for members in groups.values():
        known = next((i for i in members if nodes[i][0]), members[0])
        skip |= {(i, j) for i, j in zip(members, members[1:], strict=False)} | {(min(known, j), max(known, j)) for j in members if j != known}
    return chain - skip, skip


def beliefs(text: str, nodes: list[Span], weights: Weights, rounds: int = 60) -> np.ndarray:
    """Loopy sum-product over the skip-chain field: a row of log potentials for each node, exact where the links form a tree."""
    n, k = len(nodes), len(LABELS)
    unary = np.zeros((n, k))
    for i, (kind, a, b) in enumerate(nodes):
        if kind:
            unary[i, LABELS.index(kind)] = CERTAIN
            continue
        known = weights.forms.get(form(text[a:b]), {}) if text[a : a + 2].lstrip("(")[:1].isdigit() else {}
        unary[i, 1:] = [known.get(label, UNSEEN) for label in KINDS]
    chain, skip = _links(text, nodes)
    pairs = np.array([*sorted(skip), *sorted(chain)], int).reshape(-1, 2)
    if len(pairs):
        agree = np.exp(np.r_[np.full(len(skip), weights.skip), np.full(len(chain), weights.chain)])[:, None]
        ends = np.vstack([pairs, pairs[:, ::-1]])  # directed
        agree = np.vstack([agree, agree])
        back = np.r_[len(pairs) : 2 * len(pairs), 0 : len(pairs)]
        messages = np.zeros((len(ends), k))
        for _ in range(rounds):
            belief = unary.copy()
            np.add.at(belief, ends[:, 1], messages)
            out = belief[ends[:, 0]] - messages[back]
            p = np.exp(out - out.max(1, keepdims=True))
            new = np.log(p.sum(1, keepdims=True) + (agree - 1) * p)  # a potts potential
            new -= new.max(1, keepdims=True)
            moved = np.abs(new - messages).max()
            messages = 0.5 * messages + 0.5 * new
            if moved < 1e-6:
                break
        np.add.at(unary, ends[:, 1], messages)
    return unary


def label_nodes(text: str, nodes: list[Span], weights: Weights) -> list[str]:
    """A label for each node; of equally likely ones the first, none."""
    return [LABELS[i] for i in beliefs(text, nodes, weights).argmax(1)] if nodes else []


def find(text: str | None, weights: Weights = Weights()) -> tuple[list[Span], list[Span]]:  # noqa: B008  immutable
    """Base spans, and all spans with the added ones, both by start, then kind."""
    text = text or ""
    base = base_spans(text)
    if not _ANY.search(text):
        return base, base
    nodes = _nodes(text, base)
    spans = list(base)
    if len(nodes) > len(base):
        for (kind, a, b), label in zip(nodes, label_nodes(text, nodes, weights), strict=True):
            if not kind and label != "none":
                spans.append((label, a, b))
    return base, sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def evidence(text: str) -> Counter:
    """Counts that potentials are learned from: numbers of each form and kind, and links between base spans of one kind or two."""
    out: Counter = Counter()
    if not _ANY.search(text):
        return out
    nodes = _nodes(text, base_spans(text))
    for kind, a, b in nodes:
        if kind != "email" and not (not kind and not text[a : a + 2].lstrip("(")[:1].isdigit()):
            out["form", form(text[a:b]), kind] += 1
    for name, links in zip(("chain", "skip"), _links(text, nodes), strict=True):
        for i, j in links:
            if nodes[i][0] and nodes[j][0]:
                out[name, "same" if nodes[i][0] == nodes[j][0] else "other", ""] += 1
    return out


def weigh(counts: dict[tuple[str, str, str], int]) -> Weights:
    """Potentials from counts: log-odds with half a count added to each side."""
    odds = lambda a, b: float(np.log((a + 0.5) / (b + 0.5)))
    forms: dict[str, dict[str, float]] = {}
    for what, name, kind in counts:
        if what == "form" and kind:
            forms.setdefault(name, {})[kind] = min(FORM_LIMIT, odds(counts[what, name, kind], sum(n for (w, f, k), n in counts.items() if w == what and f == name and k != kind)))
    limits = {"skip": SKIP_LIMITS, "chain": CHAIN_LIMITS}
    links = {w: float(np.clip(odds(counts.get((w, "same", ""), 0), counts.get((w, "other", ""), 0)), *limits[w])) for w in limits if (w, "same", "") in counts or (w, "other", "") in counts}
    return Weights(forms, **links)


def learn(docs: DataFrame, limit: int = SAMPLE) -> Weights:
    """Potentials from a hash sample of about ``limit`` documents at most; the driver gets one row for each form and kind."""
    total = docs.count()
    own = docs.select(text_of(docs).alias("text"))
    if total > limit:
        own = own.where(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < int(1_000_003 * limit / total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(evidence(text))
        if counts:
            keys = zip(*counts, strict=True)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in keys), pa.array(list(counts.values()), pa.int64())], ["what", "name", "kind", "n"])

    rows = own.mapInArrow(run, "what string, name string, kind string, n long").groupBy("what", "name", "kind").agg(F.sum("n").alias("n")).collect()
    return weigh({(r["what"], r["name"], r["kind"]): r["n"] for r in rows})


def _written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


FIELDS = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]


def detect(docs: DataFrame, weights: Weights | None = None) -> DataFrame:
    """Counts, base hash and all spans of every row, with potentials learned from the same rows unless they are given."""
    weights = weights or learn(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base, spans = find(text, weights)
                counts = [sum(s[0] == k for s in base) for k in KINDS]
                out.append((doc_id, *counts, hashlib.sha256(_written(base).encode()).hexdigest(), _written(spans), len(spans) - len(base)))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], FIELDS)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redacted(text: str, weights: Weights) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans are replaced as one."""
    _, spans = find(text, weights)
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:] if spans else text


def redact(docs: DataFrame, weights: Weights | None = None) -> DataFrame:
    """The same rows and columns, the text without personal data; n_chars follows the text. Null texts stay null."""
    place = docs.columns.index("text")
    weights = weights or learn(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            new = pa.array([None if t is None else redacted(t, weights) for t in batch.column(place).to_pylist()], pa.string())
            yield batch.set_column(place, batch.schema.field(place).with_type(pa.string()), new)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))) if "n_chars" in docs.columns else out


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"))


def pii_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op3: the base spans of each kind, counted."""
    return op3_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


BASE_SQL = r"""
WITH m AS (SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS email, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ip,
  list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS card,
  list_transform(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS phone FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))
SELECT doc_id, CAST(len(email) AS BIGINT) AS n_email,
  CAST(len(list_filter(ip, lambda x: len(list_filter(string_split(x, '.'), lambda p: coalesce(try_cast(p AS HUGEINT), 256) > 255)) = 0)) AS BIGINT) AS n_ip,
  CAST(len(list_filter(card, lambda d: length(d) BETWEEN 14 AND 19 AND list_sum(list_transform(range(0, length(d)), lambda i: CASE WHEN i % 2 = 0 THEN CAST(d[length(d) - i] AS INT)
    ELSE CASE WHEN CAST(d[length(d) - i] AS INT) > 4 THEN 2 * CAST(d[length(d) - i] AS INT) - 9 ELSE 2 * CAST(d[length(d) - i] AS INT) END END)) % 10 = 0)) AS BIGINT) AS n_card,
  CAST(len(list_filter(phone, lambda d: length(d) BETWEEN 10 AND 15)) AS BIGINT) AS n_phone FROM m
"""
