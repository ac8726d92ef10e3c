"""How good estimates are, and workloads to find out with."""

from __future__ import annotations

import random
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from joinlens.operators.bound import estimate, true_count
from joinlens.operators.catalog import Catalog, TableModel
from joinlens.plans.parser import parse
from joinlens.schema import SchemaGraph

PERCENTS = (0.5, 0.9, 0.95, 0.99, 1.0)


def q_error(estimated: Column, truth: Column) -> Column:
    """max(t/e, e/t), both at least 1."""
    e, t = F.greatest(estimated.cast("double"), F.lit(1.0)), F.greatest(truth.cast("double"), F.lit(1.0))
    return F.greatest(e / t, t / e)


def q_error_percentiles(rows: DataFrame, estimated: str = "estimate", truth: str = "truth") -> DataFrame:
    """A column for each percentile, linearly interpolated."""
    q = rows.select(q_error(F.col(estimated), F.col(truth)).alias("q"))
    one = q.agg(F.percentile("q", F.array(*map(F.lit, PERCENTS))).alias("p"))
    return one.select(*[F.col("p")[i].alias(f"p{round(100 * x)}") for i, x in enumerate(PERCENTS)])


def run_workload(spark: SparkSession, queries: list[str], bins: int = 64, tables: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """query, estimate, truth and seconds of each: a row for each query that is asked for."""
    out = []
    for sql in queries:
        began = time.perf_counter()
        e = estimate(spark, sql, tables, bins=bins).first()[0]
        took = time.perf_counter() - began
        out.append((sql, float(e or 0.0), int(true_count(spark, sql).first()[0]), took))
    return spark.createDataFrame(out, "query string, estimate double, truth long, seconds double")


def write_estimates(rows: DataFrame, order: str, path: str) -> None:
    """An estimate a line, in order."""
    rows.orderBy(order).select(F.col("estimate").cast("string").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def random_filters(df: DataFrame, columns: list[str], count: int, seed: int = 0, rows: int = 200) -> list[str]:
    """Conjunctions of one to three comparisons with values that occur (from a bounded sample of rows)."""
    rng = random.Random(seed)
    seen = df.select(*columns).where(" and ".join(f"{c} is not null" for c in columns)).orderBy(F.xxhash64(*columns), *columns).limit(rows).collect()
    if not seen:
        return []
    out = []
    for _ in range(count):
        parts = []
        for c in rng.sample(columns, rng.randint(1, min(3, len(columns)))):
            value = rng.choice(seen)[c]
            literal = str(value) if isinstance(value, int | float) else "'" + str(value).replace("'", "''") + "'"
            parts.append(f"{c} {rng.choice(['=', '<=', '>=']) if isinstance(value, int | float) else '='} {literal}")
        out.append(" AND ".join(parts))
    return out


def at_least_one(c: Column) -> Column:
    """Counts and estimates below one as one, null too."""
    return F.greatest(F.coalesce(c.cast("double"), F.lit(1.0)), F.lit(1.0))


def random_joins(schema: SchemaGraph, tables: Callable[[str], DataFrame], columns: dict[str, list[str]], count: int, most: int = 4, seed: int = 0) -> list[str]:
    """Counting queries over random connected tables of the schema, with filters of values that occur on the given columns."""
    rng = random.Random(seed)
    edges = [e for e in schema.edges if e.left in columns and e.right in columns]
    filters = {t: random_filters(tables(t), c, 4 * count, seed) for t, c in sorted(columns.items()) if c}
    out = []
    for _ in range(count if edges else 0):
        names, joins = {rng.choice(edges).left}, []
        for _ in range(rng.randint(1, most - 1)):
            near = [e for e in edges if (e.left in names) != (e.right in names)]
            if not near:
                break
            e = rng.choice(near)
            names |= {e.left, e.right}
            joins.append(str(e))
        where = [f"({x})" if " OR " in x else x for t in sorted(names) if filters.get(t) and rng.random() < 0.7 for x in [rng.choice(filters[t])]]
        out.append(f"SELECT COUNT(*) FROM {', '.join(sorted(names))} WHERE {' AND '.join([*joins, *where])}")
    return out


def run_subplans(spark: SparkSession, queries: list[str], models: Catalog, schema: SchemaGraph | None = None, tables: Callable[[str], DataFrame] | None = None, truth: bool = True) -> DataFrame:
    """query, aliases, estimate, truth (null unless asked for) and seconds of the whole query's estimates, for every sub-plan of two tables or more."""
    out = []
    for sql in queries:
        q = parse(sql, schema)
        began = time.perf_counter()
        found = models.subplans(q, tables)
        took = time.perf_counter() - began
        for s, e in found.items():
            if len(s) > 1:
                true = int(spark.sql(q.sql("COUNT(*)", set(s))).first()[0]) if truth else None
                out.append((sql, " ".join(sorted(s)), float(e), true, took))
    return spark.createDataFrame(out, "query string, aliases string, estimate double, truth long, seconds double")


def timed_execution(queries: list[str], tables: Callable[[str], DataFrame], models: Catalog, schema: SchemaGraph | None = None) -> list[tuple[str, list[str], float, float, int]]:
    """For each query: the join order that the estimates advise, seconds to plan it, seconds to run it, and its count."""
    from joinlens.plans import planner

    out = []
    for sql in queries:
        q = parse(sql, schema)
        began = time.perf_counter()
        sizes = models.subplans(q, tables)
        names, _ = planner.best_order(q, sizes.__getitem__)
        planned = time.perf_counter()
        n = planner.ordered_join(q, tables, names).count()
        out.append((sql, names, planned - began, time.perf_counter() - planned, n))
    return out


def accepted(df: DataFrame, model: TableModel, filters: list[str], least: float = 1.5) -> list[tuple[str, float, int, bool]]:
    """(filter, modelled rows, rows, whether their q-error is at most ``least``) of one table."""
    out = []
    for text in filters:
        cells = model.cells(next(iter(model.factors)), text.split(" AND "))
        guess, true = max(1.0, cells.total), max(1, df.where(text).count())
        out.append((text, guess, true, max(guess / true, true / guess) <= least))
    return out
