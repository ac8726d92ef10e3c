"""Plans, workloads, sinks, densities and sampling."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from joinlens.models import density
from joinlens.models.gaussian import Gaussian
from joinlens.operators import binning, catalog, evaluate
from joinlens.plans import planner
from joinlens.plans.parser import parse
from joinlens.schema import TableDef, driver_schema, load, register
from joinlens.sources import tables
from joinlens.streaming import update

SF = "/root/testdata/sf0.001"


def test_densities_equal_gaussians():
    g = Gaussian(("x", "y"), np.array([1.0, -1.0]), np.array([[2.0, 0.6], [0.6, 1.0]]))
    d = density.as_density(g)
    assert d.total() == pytest.approx(1, abs=1e-6) and d.pdf([0.5, 0.0]) == pytest.approx(g.pdf([0.5, 0.0]))
    assert d.marginal(["y"]).pdf([0.3]) == pytest.approx(g.marginal(["y"]).pdf([0.3]), rel=1e-6)
    given = d.given({"x": 2.0}).normalized()
    assert given.pdf([-0.4]) == pytest.approx(g.given({"x": 2.0}).pdf([-0.4]), rel=1e-4)
    h = density.as_density(Gaussian(("y", "z"), np.array([0.0, 0.0]), np.eye(2)))
    assert (d * h).pdf([1.0, 0.2, 0.1]) == pytest.approx(d.pdf([1.0, 0.2]) * h.pdf([0.2, 0.1])) and (d * h / h).pdf([1.0, 0.2, 0.1]) == pytest.approx(d.pdf([1.0, 0.2]))
    uniform = density.Density(("u",), lambda u: np.where((u >= 0) & (u <= 2), 1.5, 0.0), (0.0,), (2.0,))
    assert uniform.normalized().pdf([1.0]) == pytest.approx(0.5)
    with pytest.raises(ValueError):
        density.Density(tuple("abcdef"), lambda *x: x[0], (0.0,) * 6, (1.0,) * 6).total()


def test_one_face_for_continuous_factors():
    g = Gaussian(("x",), np.array([0.0]), np.array([[1.0]]))
    a, b = density.Continuous(g), density.Continuous(density.as_density(g))
    assert sum(a.discretised(-3, 3, 6)) == pytest.approx(_cdf(2.5) - _cdf(-3), abs=1e-9)
    assert np.allclose(b.discretised(-3, 3, 6), np.diff([_cdf(x) for x in np.linspace(-3, 3, 7)]), atol=1e-9)
    assert (a * a).pdf([0.5]) == pytest.approx(Gaussian(("x",), np.zeros(1), np.eye(1)).pdf([0.5]) ** 2)
    assert (b * b).pdf([0.5]) == pytest.approx((a * a).pdf([0.5])) and a.marginal(["x"]).names == ("x",)
    with pytest.raises(TypeError):
        a * b


def _cdf(x):
    import math

    return 0.5 * (1 + math.erf(x / 2**0.5))


def test_csv_and_bins_come_back(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c'), (2, None), (3, "ü|")], "a int, b string")
    t = TableDef("t", ("a", "b"))
    for dialect in ("header", "escaped"):
        tables.write_csv(df, str(tmp_path / dialect), dialect)
        assert sorted(map(tuple, tables.read_csv(spark, str(tmp_path / dialect), t, "a int, b string", dialect).collect())) == sorted(map(tuple, df.collect()))
    counts = binning.key_counts(spark.range(40).select((F.col("id") % 9).alias("k")), "k")
    m = binning.equal_frequency_map(counts, 4)
    tables.save_bins({"g": m, "h": m.withColumn("bin", F.lit(0))}, str(tmp_path / "bins"))
    assert sorted(map(tuple, tables.load_bins(spark, str(tmp_path / "bins"), "g").collect())) == sorted(map(tuple, m.collect()))


def test_a_query_comes_back_from_json():
    q = parse("SELECT COUNT(*) FROM a x, b, c WHERE x.k = b.k AND b.k = c.j AND x.v > 1 AND b.s LIKE 'q%'")
    back = tables.read_query_json(tables.query_to_json(q))
    assert back.aliases == q.aliases and back.key_groups() == q.key_groups() and back.filters("x") == q.filters("x") and back.sql() == q.sql()


def test_plans_have_sizes(spark):
    register(spark, SF, ["orders", "customer"])
    nodes = planner.plan_graph(spark.sql("SELECT COUNT(*) FROM orders, customer WHERE o_custkey = c_custkey AND c_acctbal > 0"))
    names = [n.operator for n in nodes]
    assert names[0] == "Aggregate" and "Join" in names and names.count("Relation") == 2 and all(n.size_bytes for n in nodes)
    join = nodes[names.index("Join")]
    assert len(join.children) == 2 and sorted(c for n in nodes for c in n.children) == list(range(1, len(nodes)))


def test_workloads(spark):
    queries = ["SELECT COUNT(*) FROM a, b WHERE a.x = b.x", "SELECT COUNT(*) FROM a, b", "nonsense", "SELECT COUNT(*) FROM a, b, c WHERE a.x = b.x AND b.y = c.y"]
    assert planner.usable(queries) == [queries[0], queries[3]] and planner.usable(queries, tables=(3, 9)) == [queries[3]]
    parts = planner.split_workload([f"SELECT COUNT(*) FROM a WHERE a.x = {i}" for i in range(300)], by=lambda sql: str(len(sql)))
    assert sum(map(len, parts)) == 300 and all(len({len(q) for q in p} & {len(q) for o in parts if o is not p for q in o}) == 0 for p in parts)
    out = spark.sql("SELECT * FROM VALUES (0.0D), (NULL), (2.5D) t(x)").select(evaluate.at_least_one(F.col("x")).alias("y"))
    assert [r["y"] for r in out.collect()] == [1.0, 1.0, 2.5]


def test_random_joins_run_with_their_truth(spark):
    names = ["orders", "customer", "nation"]
    register(spark, SF, names)
    frames = {n: load(spark, SF, n) for n in names}
    queries = evaluate.random_joins(driver_schema(), frames.__getitem__, {"orders": ["o_orderstatus", "o_totalprice"], "customer": ["c_acctbal", "c_mktsegment"], "nation": []}, 4, seed=3)
    assert len(queries) == 4 and queries == evaluate.random_joins(driver_schema(), frames.__getitem__, {"orders": ["o_orderstatus", "o_totalprice"], "customer": ["c_acctbal", "c_mktsegment"], "nation": []}, 4, seed=3)
    models = catalog.build(driver_schema(), frames.__getitem__, 32, names)
    rows = evaluate.run_subplans(spark, queries, models, driver_schema(), frames.__getitem__).collect()
    assert {r["query"] for r in rows} == set(queries) and all(r["truth"] is not None and r["estimate"] >= 0 for r in rows)
    for sql, order, planned, ran, n in evaluate.timed_execution(queries[:2], frames.__getitem__, models, driver_schema()):
        assert n == spark.sql(sql).first()[0] and len(order) >= 2 and planned >= 0 and ran > 0
    checks = evaluate.accepted(frames["orders"], models.tables["orders"], ["o_orderstatus = 'F'", "o_totalprice <= 200000 AND o_orderstatus = 'O'"])
    assert all(ok for *_, ok in checks)


def test_progressive_sampling_is_unbiased():
    rng = np.random.default_rng(3)
    sizes, tree = {"k": 4, "m": 3, "p": 5}, {"k": None, "m": "k", "p": "m"}
    counts = {c: rng.integers(1, 9, (1 if p is None else sizes[p], sizes[c])).astype(float) for c, p in tree.items()}
    model = catalog.TableModel(int(counts["k"].sum()), {}, {}, tree, counts)
    w = {"m": np.array([1.0, 0, 1]), "p": np.array([0, 1.0, 0, 0.5, 0])}
    exact = float(model.masses((), w)) / model.rows
    assert model.sampled_probability(w, 20_000) == pytest.approx(exact, rel=0.05)


def test_cell_modes_merge(spark):
    df = spark.range(600).select((F.col("id") * 7 % 30).alias("x"), (F.col("id") * 11 % 13).alias("y"), "id")
    bins = {"x": binning.modulo_bin(F.col("x"), 3), "y": binning.modulo_bin(F.col("y"), 2)}
    old, new = (binning.cell_modes(d, bins) for d in (df.where("id < 400"), df.where("id >= 400")))
    got = {(r["bin_x"], r["bin_y"]): r for r in update.merge_cell_modes(old, new, ["x", "y"]).collect()}
    o, n, whole = ({(r["bin_x"], r["bin_y"]): r for r in d.collect()} for d in (old, new, binning.cell_modes(df, bins)))
    for cell in itertools.product(range(3), range(2)):
        a, b = o[cell]["mfv_x"], n[cell]["mfv_x"]
        assert got[cell]["mfv_x"] == (max(a, b) if a <= 5 else a + 0.5 * b) and got[cell]["mass"] == whole[cell]["mass"]
