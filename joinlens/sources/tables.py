"""Readers and writers of tables, statistics and workloads."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinlens.plans.parser import JoinCondition, Predicate, Query
from joinlens.schema import TableDef

#: Dialects of CSV exports.
DIALECTS = {
    "header": {"header": True, "sep": ",", "quote": '"', "escape": '"'},
    "pipe": {"header": False, "sep": "|", "encoding": "ISO-8859-1"},
    "escaped": {"header": False, "sep": ",", "quote": '"', "escape": "\\", "encoding": "UTF-8"},
}


def read_csv(spark: SparkSession, path: str, table: TableDef, schema: str, dialect: str = "header") -> DataFrame:
    """The table's relevant columns; the schema is given, never inferred."""
    df = spark.read.schema(schema).options(**{k: str(v) for k, v in DIALECTS[dialect].items()}).csv(path)
    return df.select(*[c for c in df.columns if c in table.relevant])


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A database table in ranges of a numeric column."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts), **options).load()


def read_workload(spark: SparkSession, path: str) -> DataFrame:
    """truth, query from lines 'count||SQL' or 'SQL||count'; lines of neither form are left out."""
    parts = F.split(F.col("value"), r"\|\|")
    first, second = F.trim(parts[0]), F.trim(F.get(parts, F.lit(1)))
    rows = spark.read.text(path).where(F.size(parts) == 2)
    number = first.rlike(r"^\d+$")
    return rows.select(F.when(number, first).otherwise(second).try_cast("bigint").alias("truth"), F.when(number, second).otherwise(first).alias("query")).where("truth is not null")


def save_model(tables: dict[str, DataFrame], meta: dict, folder: str, spark: SparkSession) -> None:
    """A folder with a Parquet table for each statistic and a line of JSON."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    spark.createDataFrame([(json.dumps({"tables": sorted(tables), **meta}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/meta")


def load_model(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], dict]:
    meta = json.loads(spark.read.text(f"{folder}/meta").first()["value"])
    return {name: spark.read.parquet(f"{folder}/{name}") for name in meta.pop("tables")}, meta


def query_to_json(query: Query) -> str:
    """A query's join graph: nodes with their tables and filters, edges as key groups."""
    return json.dumps({"nodes": {a: {"table": t, "filters": query.filters(a)} for a, t in query.aliases.items()}, "edges": query.key_groups(), "select": query.select})


def read_query_json(text: str) -> Query:
    """What ``query_to_json`` wrote."""
    d = json.loads(text)
    joins = tuple(JoinCondition(tuple(a), tuple(b)) for g in d["edges"] for a, b in zip(g, g[1:], strict=False))
    predicates = tuple(Predicate(p, frozenset({a})) for a, n in d["nodes"].items() for p in n["filters"])
    return Query(d["select"], {a: n["table"] for a, n in d["nodes"].items()}, joins, predicates)


def write_csv(df: DataFrame, path: str, dialect: str = "header") -> None:
    """A folder of CSV files that ``read_csv`` reads with the same dialect."""
    df.write.mode("overwrite").options(**{k: str(v) for k, v in DIALECTS[dialect].items()}).csv(path)


def save_bins(maps: dict[str, DataFrame], path: str) -> None:
    """Bin maps (value, bin) of key groups, one table partitioned by group."""
    for group, m in sorted(maps.items()):
        m.select("value", "bin").write.mode("overwrite").parquet(f"{path}/grp={group}")


def load_bins(spark: SparkSession, path: str, group: str) -> DataFrame:
    return spark.read.parquet(f"{path}/grp={group}").select("value", "bin")
