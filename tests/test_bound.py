"""The bound kernel, elimination and their guarantees."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from joinlens.operators import binning, bound
from joinlens.plans.parser import QueryError, parse, parse_what_if, parse_workload_line
from joinlens.plans import planner
from joinlens.schema import JoinEdge, SchemaGraph, TableDef, driver_schema, movies_schema, stats_schema


def tables(spark, **rows):
    frames = {name: spark.createDataFrame(data, schema) for name, (data, schema) in rows.items()}
    return frames.__getitem__


def test_fan_out_is_scaled(spark):
    t = tables(spark, a=([(1,)] * 10, "k1 int"), b=([(1, 1)], "k1 int, k2 int"), c=([(1,)] * 10, "k2 int"))
    sql = "SELECT COUNT(*) FROM a, b, c WHERE a.k1 = b.k1 AND b.k2 = c.k2"
    assert bound.estimate(spark, sql, t, bins=1).first()[0] == 100
    assert bound.estimate(spark, sql, t, bins=1, rule="unscaled").first()[0] == 10


def test_one_value_per_bin_is_exact(spark):
    t = tables(spark, a=([(1,), (1,), (2,), (None,)], "k int"), b=([(1,), (2,), (2,), (3,)], "k int"))
    assert bound.estimate(spark, "SELECT COUNT(*) FROM a, b WHERE a.k = b.k", t, bins=1000).first()[0] == 4


def test_disjoint_and_empty_inputs_are_zero(spark):
    t = tables(spark, a=([(1,)], "k int"), b=([(2,)], "k int"), c=([], "k int"))
    assert bound.estimate(spark, "SELECT COUNT(*) FROM a, b WHERE a.k = b.k", t, bins=1000).first()[0] == 0
    assert bound.estimate(spark, "SELECT COUNT(*) FROM a, c WHERE a.k = c.k", t).first()[0] == 0


def test_tables_without_a_join_multiply(spark):
    t = tables(spark, a=([(1,)] * 3, "k int"), b=([(2,)] * 4, "k int"))
    assert bound.estimate(spark, "SELECT COUNT(*) FROM a, b", t).first()[0] == 12


values = st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4)), min_size=0, max_size=12)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(values, values, values)
def test_estimate_is_never_below_the_truth(spark, a, b, c):
    """Over a cycle of three tables."""
    t = tables(spark, a=(a, "x int, y int"), b=(b, "y int, z int"), c=(c, "z int, x int"))
    for name in "abc":
        t(name).createOrReplaceTempView(name)
    sql = "SELECT COUNT(*) FROM a, b, c WHERE a.y = b.y AND b.z = c.z AND c.x = a.x"
    truth = sum(p[1] == q[0] and q[1] == r[0] and r[1] == p[0] for p in a for q in b for r in c)
    assert bound.true_count(spark, sql).first()[0] == truth
    assert bound.estimate(spark, sql, t, bins=2).first()[0] >= truth


def test_filters_stay_with_their_alias():
    q = parse("SELECT COUNT(*) FROM t AS t1, t t2 WHERE t1.id = t2.parent AND t1.n BETWEEN 1 AND 3 AND (t2.s LIKE 'a%' OR t2.s IS NULL) AND t1.d >= '2010-07-19 00:00:00'::timestamp;")
    assert q.aliases == {"t1": "t", "t2": "t"}
    assert q.filters("t1") == ["t1.n BETWEEN 1 AND 3", "t1.d >= CAST('2010-07-19 00:00:00' AS TIMESTAMP)"]
    assert q.filters("t2") == ["t2.s LIKE 'a%' OR t2.s IS NULL"]
    assert q.key_groups() == [[("t1", "id"), ("t2", "parent")]]


OR_CONDITIONS = [
    ("(a.v = 1 OR a.w = 2) AND a.k = b.k AND b.v BETWEEN 1 AND 2", 1),
    ("a.k = b.k AND (a.v BETWEEN 1 AND 2 OR b.w IS NULL) AND a.w <> 3", 1),
    ("(a.v BETWEEN 1 AND 2 OR a.w = 1) AND a.k = b.k", 1),
    ("(a.k = b.k AND (a.v = 1 OR a.w = 2))", 1),
    ("a.v = 1 AND a.k = b.k OR b.w = 2 AND a.k = 0", 0),
    ("CASE WHEN a.v = 1 AND b.w = 2 OR a.w = 0 THEN 1 ELSE 0 END = 1 AND a.k = b.k", 1),
]


@pytest.mark.parametrize(("where", "joins"), OR_CONDITIONS)
def test_text_of_a_query_keeps_what_an_or_holds_together(spark, where, joins):
    rows = [(k, v, w) for k in range(3) for v in (1, 2, 3) for w in (0, 1, 2, 3, None)]
    for name in "ab":
        spark.createDataFrame(rows, "k int, v int, w int").createOrReplaceTempView(name)
    sql = f"SELECT COUNT(*) FROM a, b WHERE {where}"
    q = parse(sql)
    assert len(q.joins) == joins
    assert spark.sql(q.sql()).first() == spark.sql(sql).first()


@pytest.mark.parametrize("text", ["CASE WHEN a.x = 1 THEN 1", "a.x = 1 AND CASE WHEN a.x = 1 THEN 1", "a.x = 1 END AND a.y = 1"])
def test_unbalanced_cases_are_refused(text):
    with pytest.raises(QueryError):
        parse(f"SELECT COUNT(*) FROM a WHERE {text}")


@pytest.mark.parametrize("text", ["", "SELECT COUNT(*) FROM", "SELECT 1 FROM a WHERE", "SELECT COUNT(*) FROM a, a", "SELECT COUNT(*) FROM a LEFT JOIN b ON a.x = b.x", "SELECT COUNT(*) FROM a WHERE (a.x = 1", "SELECT COUNT(*) FROM a WHERE b.x = 1"])
def test_other_shapes_are_refused(text):
    with pytest.raises(QueryError):
        parse(text)


def test_join_syntax_and_resolution():
    q = parse("SELECT COUNT(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 1.5", driver_schema())
    assert q.key_groups() == [[("customer", "c_custkey"), ("orders", "o_custkey")]]
    assert q.filters("customer") == ["customer.c_acctbal > 1.5"]


def test_what_if_and_workload_lines():
    s = parse_what_if("WHAT IF a = 1 AND b IN (1, 2) DECREASE BY 25%")
    assert (s.condition, s.factor) == ("a = 1 AND b IN (1, 2)", 0.75)
    assert parse_workload_line("12||SELECT 1") == parse_workload_line("SELECT 1||12") == (12, "SELECT 1")


def test_key_groups_ignore_the_order_of_edges():
    t = {n: TableDef(n, ("k",)) for n in "abcd"}
    edges = [JoinEdge("a", "k", "b", "k"), JoinEdge("c", "k", "d", "k"), JoinEdge("b", "k", "c", "k")]
    for order in (edges, edges[::-1]):
        assert len(SchemaGraph(t, tuple(order)).key_groups()) == 1
    assert [len(g) for g in stats_schema().key_groups()] in ([7, 6], [6, 7])
    assert [len(g) for g in movies_schema().key_groups()] == [6]


def test_connected_subsets_and_covers():
    q = parse("SELECT COUNT(*) FROM a, b, c WHERE a.x = b.x AND b.y = c.y")
    subsets = planner.connected_subsets(q)
    assert [sorted(s) for s in subsets] == [["a"], ["b"], ["c"], ["a", "b"], ["b", "c"], ["a", "b", "c"]]
    for cover in (planner.path_cover(subsets), planner.greedy_cover(subsets)):
        assert sorted(map(sorted, (s for chain in cover for s in chain))) == sorted(map(sorted, subsets))
    assert len(planner.path_cover(subsets)) == 3
    size = {frozenset("ab"): 100.0, frozenset("bc"): 1.0, frozenset("abc"): 5.0}
    names, cost = planner.best_order(q, size.__getitem__)
    assert set(names[:2]) == {"b", "c"} and cost == 6


def test_jenks_splits_where_values_jump():
    assert binning.jenks(np.array([1.0, 2, 3, 50, 51, 99]), np.ones(6), 3) == [0, 3, 5]


def test_nearest_bin_is_the_nearest(spark):
    start = spark.createDataFrame([(1, 1), (2, 10)], "value int, n long")
    m = spark.createDataFrame([(1, 0), (2, 1)], "value int, bin int")
    new = spark.createDataFrame([(3, 9), (4, 2)], "value int, n long")
    assert {r["value"]: r["bin"] for r in binning.add_unseen(m, new, start).collect()} == {1: 0, 2: 1, 3: 1, 4: 0}


def test_every_value_is_in_one_bin(spark):
    a = spark.range(50).select(F.col("id").alias("value"), (F.col("id") % 7 + 1).alias("n"))
    b = spark.range(20, 90).select(F.col("id").alias("value"), (F.col("id") % 5 + 1).alias("n"))
    m = binning.greedy_bins([a, b], 12)
    assert m.count() == m.select("value").distinct().count() == 90
    name, best = binning.best_start_bins({"a": a, "b": b}, 6)
    assert best.count() == 90 and name in "ab"


def test_stored_statistics_give_the_scans_bounds(spark, tmp_path):
    from joinlens.operators import statistics

    rows = spark.range(200).select((F.col("id") % 17).alias("x"), (F.col("id") % 11).alias("y"))
    t = {"a": rows, "b": rows.select(F.col("x").alias("u")), "c": rows.select(F.col("y").alias("v"))}.__getitem__
    schema = SchemaGraph({"a": TableDef("a", ("x", "y")), "b": TableDef("b", ("u",)), "c": TableDef("c", ("v",))}, (JoinEdge("a", "x", "b", "u"), JoinEdge("a", "y", "c", "v")))
    s = statistics.build(schema, t, bins=4)
    s.save(spark, str(tmp_path / "s"))
    s = statistics.load(spark, str(tmp_path / "s"))
    for sql in ("SELECT COUNT(*) FROM a, b WHERE a.x = b.u", "SELECT COUNT(*) FROM a, b, c WHERE a.x = b.u AND a.y = c.v", "SELECT COUNT(*) FROM a, b, c WHERE a.x = b.u AND a.y = c.v AND c.v < 5"):
        assert statistics.estimate(sql, s, t).first()[0] == bound.estimate(spark, sql, t, bins=4).first()[0]


def test_network_masses_are_close(spark):
    """Continuous attributes become intervals; a range is covered in part."""
    from joinlens.operators import estimators

    rows = spark.range(6000).select((F.col("id") % 40).alias("k"), (F.col("id") * 7919 % 6000).cast("double").alias("v"), (F.col("id") % 3).alias("w"))
    net = estimators.learn(rows, ["k"], ["v", "w"], bins=8)
    assert set(net.edges) == {"v"}
    f = estimators.network_factor(net, "t", {0: "k"}, ["t.v <= 2999", "t.w IN (0, 1)"])
    truth = rows.where("v <= 2999 and w in (0, 1)").count()
    assert f.df.agg(F.sum("mass")).first()[0] == pytest.approx(truth, rel=0.1)
