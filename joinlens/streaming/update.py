"""Statistics that follow arriving rows.

The exact form keeps counts for each key value, so a merge is an addition and a re-aggregation; the
approximate form merges bin modes alone. ``follow`` applies either to a stream, batch by batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from joinlens.operators import catalog
from joinlens.schema import SchemaGraph


def split_by_time(df: DataFrame, column: str, at: str) -> tuple[DataFrame, DataFrame]:
    """Rows before a time and the others; rows without a time are new."""
    moment = F.lit(at).cast("timestamp")
    return df.where(F.col(column) < moment), df.where((F.col(column) >= moment) | F.col(column).isNull())


def merge_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    """value, n of both."""
    return old.unionByName(new).groupBy("value").agg(F.sum("n").alias("n"))


def merge_modes(old: DataFrame, new: DataFrame, small: int = 10, share: float = 0.5) -> DataFrame:
    """bin, mfv: the larger one where the old mode is small, else the old one and a share of the new."""
    o, n = old.select("bin", F.col("mfv").alias("o")), new.select("bin", F.col("mfv").alias("n"))
    both = o.join(n, "bin", "full")
    a, b = F.coalesce("o", F.lit(0)), F.coalesce("n", F.lit(0))
    return both.select("bin", F.when(a <= small, F.greatest(a, b).cast("double")).otherwise(a + share * b).alias("mfv"))


def merge_cell_modes(old: DataFrame, new: DataFrame, keys: list[str], small: int = 5, share: float = 0.5) -> DataFrame:
    """Cells of several keys (bin_<key>, mass, mfv_<key>) of both: masses add up, modes by the rule of ``merge_modes`` with its limit for cells."""
    names = [f"bin_{k}" for k in keys]
    both = old.select(*names, F.col("mass").alias("__m"), *[F.col(f"mfv_{k}").alias(f"__{k}") for k in keys]).join(new.select(*names, "mass", *[f"mfv_{k}" for k in keys]), names, "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rule = lambda a, b: F.when(a <= small, F.greatest(a, b).cast("double")).otherwise(a + share * b)
    return both.select(*names, (zero("__m") + zero("mass")).alias("mass"), *[rule(zero(f"__{k}"), zero(f"mfv_{k}")).alias(f"mfv_{k}") for k in keys])


def merge_cpd_counts(old: DataFrame, new: DataFrame, states: list[str]) -> DataFrame:
    """Counts of a distribution's cells, added: the distribution of both tables together, exactly."""
    return old.unionByName(new).groupBy(*states).agg(F.sum("value").alias("value"))


def follow(stream: DataFrame, key: str, table: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keep value counts of a stream's key under a folder, one version for each batch.

    A batch writes version N from version N - 1 and its own counts, so a batch that is run again after a
    failure writes the same version again. Two versions stay.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        new = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("value")).agg(F.count("*").alias("n"))
        out = merge_counts(read_version(spark, table, number - 1), new) if number else new
        out.write.mode("overwrite").parquet(f"{table}/v{number % 2}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_version(spark, table: str, number: int) -> DataFrame:
    return spark.read.schema("value long, n long").parquet(f"{table}/v{number % 2}")


# Catalogs (all stored models of a schema's tables)


def train_and_update(schema: SchemaGraph, tables: Callable[[str], DataFrame], times: dict[str, str], at: str, bins: int = 64, names: list[str] | None = None) -> catalog.Catalog:
    """Models of the rows before a time, then updated with the others. times: the time column of each table that has one."""
    parts = {t: split_by_time(tables(t), c, at) for t, c in times.items()}
    out = catalog.build(schema, lambda t: parts[t][0] if t in parts else tables(t), bins, names)
    for t, (_, new) in sorted(parts.items()):
        out = out.updated(t, new, schema)
    return out


def follow_catalog(stream: DataFrame, table: str, schema: SchemaGraph, folder: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Add a stream's rows to a table's models, a version of the catalog for each batch; ``folder/v0`` is the start.

    Batch N writes version N + 1 from version N, whatever was there, so a batch that runs again writes the same.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        rows = rows.persist()
        catalog.load(spark, f"{folder}/v{number}").updated(table, rows, schema).save(spark, f"{folder}/v{number + 1}")
        spark.createDataFrame([(number + 1,)], "version long").coalesce(1).write.mode("overwrite").json(f"{folder}/latest-{number + 1}")
        rows.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest_catalog(spark: SparkSession, folder: str) -> tuple[str, int]:
    """Path and number of the newest version that is whole."""
    number = spark.read.schema("version long").json(f"{folder}/latest-*").agg(F.max("version")).first()[0] or 0
    return f"{folder}/v{number}", number
