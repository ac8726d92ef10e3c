"""Stored models of tables, and estimates from them without a look at the tables.

For each table the catalog keeps, as arrays on the driver,

* factors of its join keys (one by one, in pairs, all): masses and modes by bins, null keys in a cell of their own;
* a tree network over its attributes and key bins, as counts: attributes of many numbers as intervals of equal
  mass, others as their common values and packs of the rest.

A filter becomes weights on states; the network gives the filtered masses by the keys' bins, the factors the modes. Tables
whose filter can't be put that way are scanned. The bounds of all sub-plans are built from smaller ones, each once. Sizes go by bins and states,
which are parameters, never by rows; everything is learned by aggregation, in one pass for the factors and one for the network of a table.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from joinlens.operators import bayes, predicates
from joinlens.operators.binning import modulo_bin
from joinlens.operators.cells import MAX_CELLS, NULL, Cells, coarse, join, summed
from joinlens.plans.parser import Query, QueryError, parse
from joinlens.schema import SchemaGraph
from joinlens.sources.tables import load_model, save_model

COMMON, PACKS, INTERVALS = 30, 60, 120
#: Cells of a table's factor that a query's joins start from.
FACTOR_CELLS = 40_000
#: Bound of the rows (a hash sample) that a tree's shape is learned from. Its counts are those of all rows.
STRUCTURE_ROWS = 200_000


@dataclass(frozen=True)
class States:
    """How a column is coded. The last state is null."""

    edges: tuple[float, ...] | None = None  # of a column in intervals
    values: dict = field(default_factory=dict)  # value -> (code, share of its code's rows)
    count: int = 0  # states without null
    texts: dict = field(default_factory=dict)  # value -> as a cast to text writes it

    def read(self, c: Column) -> Column:
        """The column as ``code`` takes it."""
        return c.cast("double" if self.edges is not None else "string")

    def code(self, values: pa.Array) -> np.ndarray:
        """States of a batch. A value that came later counts with the last pack, a number outside with the nearest interval."""
        null = np.asarray(values.is_null())
        if self.edges is not None:
            numbers = np.nan_to_num(np.asarray(pc.fill_null(values, 0.0)), nan=0.0)
            out = np.minimum(np.searchsorted(self.edges[1:-1], numbers, side="right"), max(0, self.count - 1))
        else:
            place = pc.index_in(values, value_set=pa.array(list(self.texts.values()), pa.string()))
            codes = np.array([code for code, _ in self.values.values()] or [0], np.int64)
            out = np.where(np.asarray(place.is_null()), max(0, self.count - 1), codes[np.asarray(pc.fill_null(place, 0))])
        return np.where(null, self.count, out)

    def weights(self, condition: predicates.Condition) -> np.ndarray:
        out = np.zeros(self.count + 1)
        out[-1] = float(condition.accepts(None))
        if self.edges is not None:
            for state, w in predicates.weights(condition, list(range(self.count)), list(self.edges)):
                out[state] = w
        else:
            for value, (code, share) in self.values.items():
                out[code] += share * condition.accepts(value)
        return out


@dataclass(frozen=True)
class TableModel:
    rows: int
    factors: dict[tuple[str, ...], Cells]  # groups are places in the key tuple
    states: dict[str, States]
    tree: dict[str, str | None]  # child -> parent
    counts: dict[str, np.ndarray]  # parent's states x states; one row for the root

    def masses(self, keys: tuple[str, ...], weights: dict[str, np.ndarray]) -> np.ndarray:
        """Rows by the bins of the keys (null last) that pass, by the network: messages from the leaves, keys left open."""
        children: dict[str, list[str]] = {c: [] for c in self.tree}
        for c, p in self.tree.items():
            if p is not None:
                children[p].append(c)
        letters = {c: chr(97 + i) if i < 26 else chr(39 + i) for i, c in enumerate(self.tree)}
        done: dict[str, tuple[np.ndarray, str]] = {}
        order, stack = [], [c for c, p in self.tree.items() if p is None]
        while stack:
            c = stack.pop()
            order.append(c)
            stack += children[c]
        for c in reversed(order):
            own, up = letters[c], letters[self.tree[c]] if self.tree[c] is not None else ""
            table = self.counts[c] / np.maximum(self.counts[c].sum(1, keepdims=True), 1e-300) if up else self.counts[c][0] / max(1, self.rows)
            operands, scripts, opened = [table], [up + own], own if c in keys else ""
            if c in weights:
                operands.append(weights[c])
                scripts.append(own)
            for child in children[c]:
                message, names = done.pop(child)
                operands.append(message)
                scripts.append(names)
                opened += names.replace(own, "")
            names = up + opened
            done[c] = np.einsum(",".join(scripts) + "->" + names, *operands, optimize=len(operands) > 2), names
        (value, names) = done[order[0]]
        return self.rows * np.einsum(names + "->" + "".join(letters[k] for k in keys), value)

    def sampled_probability(self, weights: dict[str, np.ndarray], draws: int = 2000, seed: int = 0) -> float:
        """The share of rows that pass, by progressive sampling: down the tree each draw takes a state among those that pass and is worth their probability. Unbiased."""
        rng = np.random.default_rng(seed)
        worth, state, stack = np.ones(draws), {}, [c for c, p in self.tree.items() if p is None]
        while stack:
            c = stack.pop()
            stack += [x for x, p in self.tree.items() if p == c]
            table = self.counts[c] / np.maximum(self.counts[c].sum(1, keepdims=True), 1e-300)
            p = table[state[self.tree[c]] if self.tree[c] is not None else np.zeros(draws, int)] * weights.get(c, 1.0)
            total = p.sum(1)
            worth *= total
            at = (p / np.maximum(total, 1e-300)[:, None]).cumsum(1)
            state[c] = np.minimum((at < rng.random(draws)[:, None]).sum(1), p.shape[1] - 1)
        return float(worth.mean())

    def cells(self, keys: tuple[str, ...], filters: list[str]) -> Cells | None:
        """The factor of some keys under a filter; None if the filter or the keys aren't modelled."""
        stored = self.factors.get(keys)
        if stored is None:
            wider = [k for k in self.factors if set(keys) <= set(k)]
            if not wider:
                return None
            best = min(wider, key=lambda k: (len(k), k))
            stored = summed(self.factors[best], tuple(best.index(k) for k in keys)).renamed(tuple(range(len(keys))))
        if not filters:
            return stored
        try:
            conditions = {c.split(".")[-1]: v for c, v in predicates.merge(filters).items()}
        except QueryError:
            return None
        if not set(conditions) <= set(self.states) or not all(k in self.tree for k in keys) or len(self.tree) > 52:
            return None
        weights = {c: self.states[c].weights(v) for c, v in conditions.items()}
        sizes = [self.counts[k].shape[1] for k in keys]
        if int(np.prod(sizes, dtype=np.int64)) > MAX_CELLS:
            return None
        mass = self.masses(keys, weights)
        at = tuple(np.where(stored.bins[:, i] == NULL, sizes[i] - 1, stored.bins[:, i]) for i in range(len(keys)))
        own = np.minimum(mass[at] if keys else np.array([float(mass)]), stored.mass)
        keep = own > 0
        return Cells(stored.groups, stored.bins[keep], own[keep], np.minimum(stored.modes[keep], own[keep, None]))


@dataclass(frozen=True)
class Catalog:
    bins: int
    tables: dict[str, TableModel]

    def base(self, query: Query, tables: Callable[[str], DataFrame] | None = None) -> dict[str, Cells]:
        """Each alias's factor over its groups; those that the models can't give are scanned, all in one job."""
        groups, out, scans = query.key_groups(), {}, {}
        for alias, name in sorted(query.aliases.items()):
            own = {g: [c for a, c in members if a == alias] for g, members in enumerate(groups)}
            own = {g: c for g, c in own.items() if c}
            model = self.tables.get(name)
            found = None
            if model is not None and all(len(c) == 1 for c in own.values()):
                keys = tuple(sorted(c[0] for c in own.values()))
                found = model.cells(keys, query.filters(alias))
                place = {c[0]: g for g, c in own.items()}
                out[alias] = found.renamed(tuple(place[k] for k in keys)) if found is not None else None
            if found is None:
                if tables is None:
                    raise QueryError(f"no model for {alias} and no table to scan")
                df = reduce(lambda d, p: d.where(F.expr(p)), query.filters(alias), tables(name).alias(alias))
                scans[alias] = scan(df, own, [tuple(sorted(own))], self.bins)
        for alias, found in collected(scans).items():
            (out[alias],) = found.values()
        return self._coarsened(out)

    def _coarsened(self, base: dict[str, Cells]) -> dict[str, Cells]:
        """Where a table joins on so many groups that its factor has over FACTOR_CELLS cells, half the bins of these groups, in all tables, until it hasn't."""
        bins: dict[int, int] = {}
        for alias in sorted(base):
            f = base[alias]
            while len(f.mass) > FACTOR_CELLS and all(bins.get(g, self.bins) % 2 == 0 for g in f.groups):
                bins |= {g: bins.get(g, self.bins) // 2 for g in f.groups}
                f = coarse(f, bins)
        return {a: coarse(f, bins) for a, f in base.items()} if bins else base

    def subplans(self, query: Query | str, tables: Callable[[str], DataFrame] | None = None) -> dict[frozenset[str], float]:
        """An estimate for every connected set of aliases, each from one smaller by a table (the smallest such), all from the same base factors."""
        from joinlens.plans.planner import connected_subsets

        query = parse(query) if isinstance(query, str) else query
        base = self.base(query, tables)
        groups = [{a for a, _ in g} for g in query.key_groups()]
        known: dict[frozenset[str], Cells] = {}
        for subset in connected_subsets(query):
            if len(subset) == 1:
                (alias,) = subset
                known[subset] = base[alias]
                continue
            keep = tuple(g for g, members in enumerate(groups) if members - subset)
            last = min((a for a in subset if subset - {a} in known), key=lambda a: (known[subset - {a}].total, a))
            known[subset] = join(known[subset - {last}], base[last], keep)
        return {s: c.total for s, c in known.items()}

    def estimate(self, query: Query | str, tables: Callable[[str], DataFrame] | None = None) -> float:
        """The whole query: connected parts by a left-deep order that starts small; parts without a common key multiply."""
        query = parse(query) if isinstance(query, str) else query
        base = self.base(query, tables)
        groups = [{a for a, _ in g} for g in query.key_groups()]
        left, out = set(base), 1.0
        while left:
            start = min(left, key=lambda a: (base[a].total, a))
            done, now = {start}, base[start]
            while True:
                near = {a for a in left - done if any(a in g and g & done for g in groups)}
                if not near:
                    break
                a = min(near, key=lambda a: (base[a].total, a))
                done.add(a)
                now = join(now, base[a], tuple(g for g, members in enumerate(groups) if members - done))
            out *= now.total
            left -= done
        return out

    def updated(self, table: str, new: DataFrame, schema: SchemaGraph) -> Catalog:
        """The catalog with the new rows of a table: masses and network counts add up exactly (values and numbers that the states
        don't have go to the last pack and the outer intervals); modes add up too, which keeps them bounds."""
        old = self.tables[table]
        fresh = table_model(table, new, schema, self.bins, states=old.states, tree=old.tree)
        factors = {k: added(old.factors[k], fresh.factors[k]) for k in old.factors}
        return replace(self, tables={**self.tables, table: TableModel(old.rows + fresh.rows, factors, old.states, old.tree, {c: old.counts[c] + fresh.counts[c] for c in old.counts})})

    def save(self, spark: SparkSession, folder: str) -> None:
        cells, counts, meta = [], [], {"bins": self.bins, "models": {}}
        for t, m in self.tables.items():
            for keys, f in m.factors.items():
                n, k = f.bins.shape
                lists = lambda x, k=k, n=n: pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), k).cast(pa.list_(pa.from_numpy_dtype(x.dtype))) if k else pa.array([[]] * n, pa.list_(pa.from_numpy_dtype(x.dtype)))
                cells.append(pa.table({"tbl": [t] * n, "keys": ["__".join(keys)] * n, "bins": lists(f.bins), "mass": f.mass, "modes": lists(f.modes)}))
            for c, n in m.counts.items():
                x, y = np.nonzero(n)
                counts.append(pa.table({"tbl": [t] * len(x), "child": [c] * len(x), "x": x, "y": y, "n": n[x, y]}))
            states = {c: {"edges": s.edges, "values": [[v, *cs, s.texts[v]] for v, cs in s.values.items()], "count": s.count} for c, s in m.states.items()}
            meta["models"][t] = {"rows": m.rows, "tree": m.tree, "states": states, "keys": ["__".join(k) for k in m.factors], "shapes": {c: n.shape for c, n in m.counts.items()}}
        save_model({"cells": spark.createDataFrame(pa.concat_tables(cells)), "counts": spark.createDataFrame(pa.concat_tables(counts))}, meta, folder, spark)


def load(spark: SparkSession, folder: str) -> Catalog:
    tables, meta = load_model(spark, folder)
    cells, counts, out = tables["cells"].toArrow().to_pandas(), tables["counts"].toArrow().to_pandas(), {}  # sizes by bins and states
    parts, links = dict(list(cells.groupby(["tbl", "keys"]))), dict(list(counts.groupby(["tbl", "child"])))
    for t, m in meta["models"].items():
        factors = {}
        for name in m["keys"]:
            keys, own = tuple(name.split("__")), parts.get((t, name), cells[:0])
            bins, modes = (np.concatenate([np.zeros(0), *own[c]]).reshape(len(own), len(keys)) for c in ("bins", "modes"))
            order = np.lexsort(bins.T[::-1])
            factors[keys] = Cells(tuple(range(len(keys))), bins[order].astype(np.int64), own["mass"].to_numpy(float)[order], modes[order])
        n = {c: np.zeros(shape) for c, shape in m["shapes"].items()}
        for c in n:
            if (t, c) in links:
                n[c][links[t, c]["x"], links[t, c]["y"]] = links[t, c]["n"]
        states = {c: States(tuple(s["edges"]) if s["edges"] is not None else None, {v: (code, share) for v, code, share, _ in s["values"]}, s["count"], {v: text for v, _, _, text in s["values"]}) for c, s in m["states"].items()}
        out[t] = TableModel(m["rows"], factors, states, m["tree"], n)
    return Catalog(meta["bins"], out)


def added(a: Cells, b: Cells) -> Cells:
    """Both factors' rows in one."""
    both = Cells(a.groups, np.vstack([a.bins, b.bins]), np.concatenate([a.mass, b.mass]), np.vstack([a.modes, b.modes]))
    return summed(both, a.groups)


KeySets = list[tuple[int, ...]]


def scan(df: DataFrame, keys: dict[int, list[str]], sets: KeySets, bins: int) -> tuple[KeySets, DataFrame]:
    """The factors of a table over sets of its groups, as rows (at, bins, mass, mode): at numbers a set and a group of it.

    Counts of key combinations once, then one roll-up for all sets. Columns of one group must be equal.
    """
    for columns in keys.values():
        for c in columns[1:]:
            df = df.where(F.col(c) == F.col(columns[0]))
    groups = tuple(sorted(keys))
    if not groups:
        return sets, df.agg(F.count("*").cast("double").alias("mass")).select(F.lit(0).alias("at"), F.array().cast("array<int>").alias("bins"), "mass", F.lit(0.0).alias("mode"))
    bin_of = lambda g: F.coalesce(modulo_bin(F.col(keys[g][0]), bins), F.lit(NULL)).alias(f"bin_{g}")
    names = [f"{p}_{g}" for g in groups for p in ("bin", "key")]
    counts = df.select(*[F.col(keys[g][0]).alias(f"key_{g}") for g in groups], *[bin_of(g) for g in groups]).groupBy(*names).agg(F.count("*").alias("n"))
    wanted = [(s, g) for s in sets for g in s]
    full = (1 << len(names)) - 1
    ids = [full & ~sum(1 << (len(names) - 1 - names.index(c)) for c in [*(f"bin_{x}" for x in s), f"key_{g}"]) for s, g in wanted]
    rolled = counts.groupingSets([[F.col(c) for c in [*(f"bin_{x}" for x in s), f"key_{g}"]] for s, g in wanted], *map(F.col, names)).agg(F.sum("n").alias("n"), F.grouping_id().alias("id"))
    which = F.element_at(F.create_map(*[F.lit(x) for i, d in enumerate(ids) for x in (d, i)]), F.col("id").cast("int"))
    cells = rolled.groupBy("id", *[f"bin_{g}" for g in groups]).agg(F.sum("n").cast("double").alias("mass"), F.max("n").cast("double").alias("mode"))
    return sets, cells.select(which.alias("at"), F.array_compact(F.array(*[f"bin_{g}" for g in groups])).alias("bins"), "mass", "mode")


def collected(scans: dict) -> dict[object, dict[tuple[int, ...], Cells]]:
    """The scans' factors by name and set, all in one job; occupied cells only."""
    if not scans:
        return {}
    union = reduce(DataFrame.unionByName, [df.withColumn("i", F.lit(i)) for i, (_, df) in enumerate(scans.values())])
    got = union.select("i", "at", "mass", "mode", "bins").toArrow()
    i, at, mass, mode = (got.column(k).to_numpy() for k in range(4))
    flat = got.column(4).combine_chunks()
    start, values = flat.offsets.to_numpy(), flat.values.to_numpy() if len(flat) else np.zeros(0, np.int64)
    out: dict[object, dict[tuple[int, ...], Cells]] = {}
    for number, (name, (sets, _)) in enumerate(scans.items()):
        out[name], k = {}, 0
        for s in sets:
            parts = []
            for _ in s or (None,):
                rows = np.flatnonzero((i == number) & (at == k))
                bins = values[start[rows][:, None] + np.arange(len(s))].reshape(len(rows), len(s)).astype(np.int64)
                order = np.lexsort(bins.T[::-1]) if len(s) else np.arange(len(rows))
                parts.append((bins[order], mass[rows][order], mode[rows][order]))
                k += 1
            bins = parts[0][0]  # every group's roll-up has the same cells
            modes = np.stack([np.where(bins[:, x] == NULL, 0.0, p[2]) for x, p in enumerate(parts)], 1) if s else np.zeros((len(bins), 0))
            out[name][s] = Cells(s, bins, parts[0][1], modes)
    return out


def numbered(df: DataFrame) -> DataFrame:
    """Times as seconds since 1970 by the clock that they show, as literals are read."""
    times = [f.name for f in df.schema.fields if f.dataType.typeName() in ("timestamp", "timestamp_ntz", "date")]
    since = lambda c: F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(`{c}` AS TIMESTAMP_NTZ))") / 1e6
    return df.withColumns({c: since(c) for c in times}) if times else df


def column_states(df: DataFrame, columns: list[str]) -> dict[str, States]:
    """How attributes are coded: three passes for all of them. Text of over bayes.CONTINUOUS_ABOVE values is left out: a filter on it is scanned."""
    types = {c: df.schema[c].dataType.typeName() for c in columns}
    columns = [c for c in columns if types[c] in (*NUMBERS, "string", "boolean")]
    if not columns:
        return {}
    distinct = df.agg(*[F.approx_count_distinct(c, 0.02).alias(c) for c in columns]).first()
    many = [c for c in columns if distinct[c] > bayes.CONTINUOUS_ABOVE]
    spread, few = [c for c in many if types[c] in NUMBERS], [c for c in columns if c not in many]
    out: dict[str, States] = {}
    if spread:
        at = [i / INTERVALS for i in range(INTERVALS + 1)]
        for c, found in zip(spread, df.select(*[F.col(c).cast("double").alias(c) for c in spread]).approxQuantile(spread, at, 1 / (4 * INTERVALS)), strict=True):
            edges = sorted(set(found))
            out[c] = States(tuple(edges), {}, max(1, len(edges) - 1))
    if few:
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in few])).alias("x")
        counts: dict[str, list] = {c: [] for c in few}
        for r in df.select(each).where("x.v is not null").groupBy("x.c", "x.v").count().collect():  # about CONTINUOUS_ABOVE a column
            counts[r["c"]].append((READ[types[r["c"]]](r["v"]) if types[r["c"]] in READ else int(r["v"]), r["v"], r["count"]))
        for c in few:
            out[c] = packed(counts[c])
    return {c: out[c] for c in columns if c in out}


NUMBERS = ("byte", "short", "integer", "long", "float", "double")
READ = {"string": str, "boolean": lambda v: v == "true", "float": float, "double": float}


def packed(counts: list[tuple], common: int = COMMON, packs: int = PACKS) -> States:
    """The common values with codes of their own, the others in value order in packs of about equal mass (as bayes.common_value_codes)."""
    ranked = sorted(counts, key=lambda x: (-x[2], x[0]))
    codes = {v: i for i, (v, _, _) in enumerate(ranked[:common])}
    rest, before = sorted(ranked[common:]), 0
    whole = sum(n for _, _, n in rest)
    for v, _, n in rest:
        codes[v] = common + before * packs // whole
        before += n
    dense = {code: i for i, code in enumerate(sorted(set(codes.values())))}
    mass: dict[int, int] = {}
    for v, _, n in counts:
        mass[dense[codes[v]]] = mass.get(dense[codes[v]], 0) + n
    return States(None, {v: (dense[codes[v]], n / mass[dense[codes[v]]]) for v, _, n in sorted(counts)}, len(dense), {v: text for v, text, _ in counts})


def table_model(name: str, df: DataFrame, schema: SchemaGraph, bins: int, states: dict[str, States] | None = None, tree: dict[str, str | None] | None = None) -> TableModel:
    """A table's model; with given states and tree only their counts are taken."""
    keys = tuple(sorted({k for e in schema.edges for n, k in ((e.left, e.left_key), (e.right, e.right_key)) if n == name}))
    sets = dict.fromkeys([*((k,) for k in keys), *combinations(keys, 2), keys])
    at = {k: i for i, k in enumerate(keys)}
    found = collected({name: scan(df, {i: [k] for k, i in at.items()}, [tuple(at[k] for k in own) for own in sets], bins)})[name]
    factors = {tuple(keys[i] for i in s): replace(f, groups=tuple(range(len(s)))) for s, f in found.items()}
    df = numbered(df)
    attributes = [c for c in schema.tables[name].relevant if c in df.columns and c not in keys]
    states = column_states(df, attributes) if states is None else states
    columns = [*keys, *states]
    sizes = {**{k: bins + 1 for k in keys}, **{c: s.count + 1 for c, s in states.items()}}
    rows = int(factors[next(iter(sets))].total)
    read = df.select(*[F.coalesce(modulo_bin(F.col(k), bins), F.lit(bins)).cast("int").alias(k) for k in keys], *[s.read(F.col(c)).alias(c) for c, s in states.items()])
    if not columns:
        return TableModel(rows, factors, states, {}, {})
    if tree is None:
        pairs = list(combinations(columns, 2))
        share = F.pmod(F.xxhash64(*columns), F.lit(1_000_003)) < int(1_000_003 * min(1.0, STRUCTURE_ROWS / max(1, rows)))
        found = pair_tables(read.where(share) if rows > STRUCTURE_ROWS else read, states, pairs, sizes)
        tree = bayes.chow_liu([(a, b, information(n)) for (a, b), n in zip(pairs, found, strict=True)], columns[0])
    edges = [(p or c, c) for c, p in tree.items()]  # the root with itself
    counts = {c: n if p != c else n.diagonal()[None, :].copy() for (p, c), n in zip(edges, pair_tables(read, states, edges, sizes), strict=True)}
    return TableModel(rows, factors, states, tree, counts)


def pair_tables(read: DataFrame, states: dict[str, States], pairs: list[tuple[str, str]], sizes: dict[str, int]) -> list[np.ndarray]:
    """The joint counts of pairs of coded columns, all in one pass; tasks and the driver hold at most the product of two columns' states for each pair."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.zeros(sizes[a] * sizes[b], np.int64) for a, b in pairs]
        for batch in batches:
            codes = {c: states[c].code(x) if c in states else np.asarray(x, np.int64) for c, x in zip(batch.schema.names, batch.columns, strict=True)}
            for t, (a, b) in zip(tables, pairs, strict=True):
                t += np.bincount(codes[a] * sizes[b] + codes[b], minlength=len(t))
        for i, t in enumerate(tables):
            cell = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), i, np.int32)), pa.array(cell), pa.array(t[cell])], ["pair", "cell", "n"])

    if not pairs:
        return []
    got = read.mapInArrow(count, "pair int, cell long, n long").groupBy("pair", "cell").agg(F.sum("n").alias("n")).toArrow()
    pair, cell, n = (got.column(i).to_numpy() for i in range(3))
    out = []
    for i, (a, b) in enumerate(pairs):
        table = np.zeros(sizes[a] * sizes[b])
        table[cell[pair == i]] = n[pair == i]
        out.append(table.reshape(sizes[a], sizes[b]))
    return out


def information(counts: np.ndarray) -> float:
    """Mutual information of a table of counts, in nats."""
    total = counts.sum()
    if not total:
        return 0.0
    by_chance = counts.sum(1, keepdims=True) * counts.sum(0, keepdims=True) / total
    seen = counts > 0
    return float((counts[seen] / total * np.log(counts[seen] / by_chance[seen])).sum())


def build(schema: SchemaGraph, tables: Callable[[str], DataFrame], bins: int = 64, names: list[str] | None = None) -> Catalog:
    """Models of the tables that have a join key."""
    joined = {n for e in schema.edges for n in (e.left, e.right)}
    return Catalog(bins, {t: table_model(t, tables(t), schema, bins) for t in sorted(names or schema.tables) if t in joined})


def as_rows(spark: SparkSession, estimates: dict[frozenset[str], float]) -> DataFrame:
    """aliases, estimate."""
    return spark.createDataFrame([(" ".join(sorted(s)), e) for s, e in estimates.items()], "aliases string, estimate double")


def meta(catalog: Catalog) -> str:
    """What the catalog holds, as a line of JSON."""
    return json.dumps({t: {"rows": m.rows, "keys": len(m.factors), "cells": sum(len(f.mass) for f in m.factors.values()), "tree": m.tree} for t, m in catalog.tables.items()})
