"""Aggregate queries and what-if statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinlens.plans.parser import Query, QueryError, WhatIf, parse, tokens
from joinlens.schema import SchemaGraph


def kind(query: Query) -> str:
    """'cardinality' for COUNT(*) alone, else 'aggregate'."""
    return "cardinality" if query.select.replace(" ", "").upper() == "COUNT(*)" and not query.group_by else "aggregate"


def aggregate_terms(select: str) -> list[tuple[int, str]]:
    """(sign, aggregate) of a sum or difference of COUNT, SUM, AVG, MIN and MAX terms."""
    out, sign, depth, begin = [], 1, 0, None
    parts = tokens(select)
    for i, t in enumerate(parts):
        if depth == 0 and t.text in "+-" and begin is not None:
            out.append((sign, select[parts[begin].start : parts[i - 1].end].strip()))
            sign, begin = (1 if t.text == "+" else -1), None
            continue
        if begin is None:
            begin = i
            if not t.is_word("COUNT", "SUM", "AVG", "MIN", "MAX"):
                raise QueryError(f"{t.text!r} is not an aggregate")
        depth += (t.text == "(") - (t.text == ")")
    if begin is None:
        raise QueryError("no aggregate")
    out.append((sign, select[parts[begin].start :].strip()))
    return out


def run(spark: SparkSession, sql: str, schema: SchemaGraph | None = None, name: str = "result") -> DataFrame:
    """The query's groups and its value. One aggregate expression, at most one group column."""
    query = parse(sql, schema)
    if len(query.group_by) > 1:
        raise QueryError("more than one group column")
    select = query.select
    for g in query.group_by:
        for form in (g, g.split(".")[-1]):
            if select.startswith(form):
                select = select.removeprefix(form).lstrip(" ,")
    terms = aggregate_terms(select)
    expression = " ".join(("-" if s < 0 else "+") + f" {t}" for s, t in terms).removeprefix("+ ")
    return spark.sql(query.sql(", ".join([*query.group_by, f"{expression} AS {name}"])))


def what_if(df: DataFrame, statement: WhatIf, value: str, name: str = "scaled") -> DataFrame:
    """The sum of a column if the rows that meet the condition changed by the factor."""
    factor = F.when(F.expr(statement.condition), F.lit(statement.factor)).otherwise(F.lit(1.0))
    return df.agg(F.sum(factor * F.col(value)).alias(name))
