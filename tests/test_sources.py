import json

import pytest
from pyspark.sql import functions as F

from joinlens.operators import evaluate, predicates, sampling
from joinlens.plans.parser import QueryError, parse
from joinlens.schema import TableDef
from joinlens.sources import tables
from joinlens.streaming import update


def test_csv_dialects(spark, tmp_path):
    t = TableDef("t", ("a", "b", "c"), irrelevant=("c",))
    (tmp_path / "h.csv").write_text('a,b,c\n1,"x, ""y""",2\n,z,3\n')
    (tmp_path / "p.csv").write_bytes("1|é|2\n".encode("latin-1"))
    (tmp_path / "e.csv").write_text('1,"x \\"y\\"",2\n')
    read = lambda f, d: [tuple(r) for r in tables.read_csv(spark, str(tmp_path / f), t, "a int, b string, c int", d).collect()]
    assert read("h.csv", "header") == [(1, 'x, "y"'), (None, "z")]
    assert read("p.csv", "pipe") == [(1, "é")]
    assert read("e.csv", "escaped") == [(1, 'x "y"')]


def test_workload_and_model(spark, tmp_path):
    (tmp_path / "w.sql").write_text("7||SELECT 1\nSELECT 2||8\nnothing\n")
    assert sorted(map(tuple, tables.read_workload(spark, str(tmp_path / "w.sql")).collect())) == [(7, "SELECT 1"), (8, "SELECT 2")]
    tables.save_model({"bins": spark.range(3)}, {"n": 5}, str(tmp_path / "m"), spark)
    frames, meta = tables.load_model(spark, str(tmp_path / "m"))
    assert frames["bins"].count() == 3 and meta == {"n": 5}
    q = parse("SELECT COUNT(*) FROM a x, b WHERE x.k = b.k AND x.v > 1")
    assert json.loads(tables.query_to_json(q))["nodes"]["x"] == {"table": "a", "filters": ["x.v > 1"]}


def test_stream_of_counts_equals_a_batch(spark, tmp_path):
    source, state = tmp_path / "in", str(tmp_path / "state")
    spark.range(100).select((F.col("id") % 7).alias("k")).write.parquet(str(source))
    for _ in range(2):
        stream = spark.readStream.schema("k long").option("maxFilesPerTrigger", 1).parquet(str(source))
        q = update.follow(stream, "k", state, str(tmp_path / "check"))
        q.awaitTermination(120)
        last = q.lastProgress["batchId"] if q.lastProgress else last  # noqa: F821
        spark.range(50).select((F.col("id") % 3).alias("k")).write.mode("append").parquet(str(source))
    number = max(int(p.name) for p in (tmp_path / "check" / "commits").iterdir() if p.name.isdigit())
    got = {r["value"]: r["n"] for r in update.read_version(spark, state, number).collect()}
    expected = {}
    for i in range(100):
        expected[i % 7] = expected.get(i % 7, 0) + 1
    for i in range(50):
        expected[i % 3] = expected.get(i % 3, 0) + 1
    assert got == expected


def test_conditions_merge():
    c = predicates.merge(["a >= 2", "a < 9", "a != 5", "b IN ('x', 'y')", "b = 'y'", "c IS NULL", "d > -3"])
    assert [x for x in range(12) if c["a"].accepts(x)] == [2, 3, 4, 6, 7, 8]
    assert c["b"].allowed == {"y"} and c["c"].accepts(None) and not c["a"].accepts(None)
    assert c["d"].accepts(-2) and not c["d"].accepts(-3)
    assert predicates.merge(["a = 1", "a = 2"])["a"].contradictory
    assert predicates.weights(c["a"], [0, 1], [0.0, 4.0, 8.0]) == [(0, 0.5), (1, 1.0)]
    with pytest.raises(QueryError):
        predicates.merge(["a LIKE 'x%'"])


def test_samples(spark):
    df = spark.range(5000).select("id", (F.col("id") % 10).alias("k"))
    assert sampling.hash_sample(df, "id", 10.0, rows=500).rate == 1.0
    s = sampling.hash_sample(df, "id", 10.0)
    assert 350 < s.df.count() < 650 and s.df.exceptAll(sampling.hash_sample(df.repartition(7), "id", 10.0).df).count() == 0
    empty = sampling.binned_counts(df, "k > 100", {"k": F.col("k")})
    spread = sampling.scaled_factor(empty, 0.1, 5000, df.groupBy(F.col("k").cast("int").alias("bin")).agg(F.count("*").alias("n")))
    assert spread.agg(F.sum("mass")).first()[0] == pytest.approx(1.0)


def test_random_workload(spark):
    df = spark.range(100).select((F.col("id") % 9).alias("a"), F.concat(F.lit("it's "), F.col("id") % 3).alias("b"))
    filters = evaluate.random_filters(df, ["a", "b"], 10, seed=4)
    assert len(filters) == 10 == len([f for f in filters if df.where(f).count() >= 0])
    assert filters == evaluate.random_filters(df.repartition(5), ["a", "b"], 10, seed=4)


def test_plans_and_literals(spark):
    from joinlens.operators import binning, factors
    from joinlens.plans import planner

    a, b = spark.range(5).withColumnRenamed("id", "a"), spark.range(5).withColumnRenamed("id", "b")
    joined = a.join(b, F.col("a") == F.col("b"))
    assert len(planner.join_order(joined)) == 1 and planner.plan_nodes(joined)
    queries = [f"SELECT COUNT(*) FROM t, u WHERE t.k = u.k AND t.v = {i}" for i in range(50)]
    parts = planner.split_workload(queries)
    assert sorted(q for p in parts for q in p) == sorted(queries) and all(parts)
    assert sorted(map(len, planner.split_workload(queries, by_template=True))) == [0, 0, 50]
    code = {"c": lambda v: str(ord(v[0]) - 65)}
    assert planner.rewrite_literals("SELECT COUNT(*) FROM t WHERE t.c = 'B' AND t.d = 'B'", code) == "SELECT COUNT(*) FROM t WHERE t.c = 1 AND t.d = 'B'"
    assert binning.workload_budget({"x": 3, "y": 1, "z": 0}, 40) == {"x": 30, "y": 10, "z": 1}
    rows = spark.createDataFrame([(x, y, x) for x in (0, 1) for y in (0, 1)], "x int, y int, z int")
    assert factors.minimal_map(factors.counts(rows, ["x", "y", "z"]), ["x", "y", "z"]) == [("x", "z")]
