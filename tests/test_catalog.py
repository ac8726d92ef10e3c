"""Stored models and driver-side bounds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from joinlens.operators import bound, catalog, cells, statistics
from joinlens.plans.parser import QueryError, parse
from joinlens.schema import JoinEdge, SchemaGraph, TableDef

SCHEMA = SchemaGraph(
    {"a": TableDef("a", ("x", "y", "v")), "b": TableDef("b", ("x", "z", "w")), "c": TableDef("c", ("y", "z"))},
    (JoinEdge("a", "x", "b", "x"), JoinEdge("a", "y", "c", "y"), JoinEdge("b", "z", "c", "z")),
)
QUERIES = [
    "SELECT COUNT(*) FROM a, b WHERE a.x = b.x",
    "SELECT COUNT(*) FROM a, c WHERE a.y = c.y",
    "SELECT COUNT(*) FROM a, b, c WHERE a.x = b.x AND b.z = c.z",
    "SELECT COUNT(*) FROM a, b, c WHERE a.x = b.x AND b.z = c.z AND a.y = c.y",
    "SELECT COUNT(*) FROM a a1, a a2, b WHERE a1.x = a2.x AND a2.x = b.x",
]


def random_tables(spark, seed, rows=40):
    rng = random.Random(seed)
    key = lambda: rng.choice([None, *range(7)])
    data = {"a": ([(key(), key(), rng.randrange(5)) for _ in range(rows)], "x long, y long, v int"), "b": ([(key(), key(), rng.choice(["p", "q", None])) for _ in range(rows)], "x long, z long, w string"), "c": ([(key(), key()) for _ in range(rows)], "y long, z long")}
    frames = {n: spark.createDataFrame(*d).cache() for n, d in data.items()}
    for n, f in frames.items():
        f.createOrReplaceTempView(n)
    return frames


@pytest.mark.parametrize("seed", range(2))
def test_stored_bounds_hold_with_null_keys(spark, seed, tmp_path):
    frames = random_tables(spark, seed)
    c = catalog.build(SCHEMA, frames.__getitem__, bins=3)
    c.save(spark, str(tmp_path / "c"))
    c = catalog.load(spark, str(tmp_path / "c"))
    s = statistics.build(SCHEMA, frames.__getitem__, bins=3)
    for sql in QUERIES:
        truth = bound.true_count(spark, sql).first()[0]
        assert c.estimate(sql) >= truth
        assert statistics.estimate(sql, s, frames.__getitem__).first()[0] >= truth
        query = parse(sql)
        for subset, e in c.subplans(query).items():
            assert e >= spark.sql(query.sql("COUNT(*)", set(subset))).first()[0] - 1e-9
        assert c.subplans(query)[frozenset(query.aliases)] >= truth
    two = QUERIES[0]
    assert c.estimate(two) == bound.estimate(spark, two, frames.__getitem__, bins=3).first()[0]


def test_coarser_bins_stay_bounds(spark, monkeypatch):
    frames = random_tables(spark, 4, 120)
    c = catalog.build(SCHEMA, frames.__getitem__, bins=8)
    fine = [c.estimate(sql) for sql in QUERIES]
    monkeypatch.setattr(catalog, "FACTOR_CELLS", 12)
    for sql, e in zip(QUERIES, fine, strict=True):
        assert max(len(f.mass) for f in c.base(parse(sql)).values()) <= 12
        assert c.estimate(sql) >= e - 1e-9 >= bound.true_count(spark, sql).first()[0] - 1e-6


def test_null_keys_in_other_groups_count(spark):
    """Half the rows have no order: they still join on part and supplier."""
    rows = spark.createDataFrame([(None if i % 2 else i, i % 3, i % 2) for i in range(60)], "o long, p long, s long")
    schema = SchemaGraph({"l": TableDef("l", ("o", "p", "s")), "t": TableDef("t", ("o",)), "u": TableDef("u", ("p",)), "w": TableDef("w", ("s",))}, (JoinEdge("l", "o", "t", "o"), JoinEdge("l", "p", "u", "p"), JoinEdge("l", "s", "w", "s")))
    frames = {"l": rows, "t": rows.select("o").distinct(), "u": rows.select("p").distinct(), "w": rows.select("s").distinct()}
    sql = "SELECT COUNT(*) FROM l, u, w WHERE l.p = u.p AND l.s = w.s"
    assert statistics.estimate(sql, statistics.build(schema, frames.__getitem__, 8), frames.__getitem__).first()[0] == 60
    assert catalog.build(schema, frames.__getitem__, 8).estimate(sql) == 60


def test_filters_by_the_network_and_by_scan(spark):
    frames = random_tables(spark, 7, 400)
    c = catalog.build(SCHEMA, frames.__getitem__, bins=16)
    # One key, one attribute of the tree beside it: masses are those of the rows.
    sql = "SELECT COUNT(*) FROM a, b WHERE a.x = b.x AND b.w = 'p'"
    own = c.base(parse(sql))["b"]
    assert own.total == pytest.approx(frames["b"].where("w = 'p'").count(), rel=0.15)
    assert c.estimate(sql) > 0 and c.estimate(sql.replace("'p'", "'none'")) == 0
    odd = "SELECT COUNT(*) FROM a, b WHERE a.x = b.x AND b.w LIKE 'p%'"
    with pytest.raises(QueryError):
        c.estimate(odd)
    assert c.base(parse(odd), frames.__getitem__)["b"].total == frames["b"].where("w like 'p%'").count()
    assert c.estimate(odd, frames.__getitem__) >= bound.true_count(spark, odd).first()[0]
    nulls = c.base(parse("SELECT COUNT(*) FROM a, b WHERE a.x = b.x AND b.w IS NULL"))["b"]
    assert nulls.total == pytest.approx(frames["b"].where("w is null").count(), rel=0.15)


def test_chain_network_equals_brute_force(spark):
    """The messages against the sum over the whole joint distribution of the tree."""
    rng = np.random.default_rng(1)
    sizes = {"k": 4, "m": 3, "p": 2, "q": 5}
    tree = {"k": None, "m": "k", "p": "m", "q": "k"}
    counts = {c: rng.integers(1, 9, (1 if p is None else sizes[p], sizes[c])).astype(float) for c, p in tree.items()}
    model = catalog.TableModel(int(counts["k"].sum()), {}, {}, tree, counts)
    p = {c: n / n.sum(1, keepdims=True) for c, n in counts.items()}
    joint = np.einsum("k,km,mp,kq->kmpq", p["k"][0], p["m"], p["p"], p["q"]) * model.rows
    w = {"p": np.array([0.0, 1.0]), "q": np.array([1, 0.5, 0, 0, 1.0])}
    weighted = joint * w["p"][None, None, :, None] * w["q"][None, None, None, :]
    assert np.allclose(model.masses(("k",), w), weighted.sum((1, 2, 3)))
    assert np.allclose(model.masses(("m", "k"), w), weighted.sum((2, 3)).T)
    assert np.allclose(model.masses((), w), weighted.sum())


def test_new_rows_add_up(spark):
    frames = random_tables(spark, 3, 300)
    a = frames["a"].withColumn("old", F.col("v") < 3)
    old, new = a.where("old").drop("old"), a.where("not old").drop("old")
    c = catalog.Catalog(4, {"a": catalog.table_model("a", old, SCHEMA, 4)})
    up = c.updated("a", new, SCHEMA).tables["a"]
    whole = catalog.table_model("a", frames["a"], SCHEMA, 4, up.states, up.tree)
    assert up.rows == whole.rows == 300
    for keys, f in whole.factors.items():
        assert np.array_equal(up.factors[keys].bins, f.bins) and np.allclose(up.factors[keys].mass, f.mass)
        assert (up.factors[keys].modes >= f.modes).all()
    assert all(np.array_equal(up.counts[k], whole.counts[k]) for k in whole.counts)


def test_a_stream_updates_the_catalog(spark, tmp_path):
    frames = random_tables(spark, 5, 200)
    frames["a"].limit(120).coalesce(1).write.parquet(str(tmp_path / "in"))
    from joinlens.streaming import update

    start = catalog.Catalog(4, {"a": catalog.table_model("a", frames["a"], SCHEMA, 4)})
    start.save(spark, str(tmp_path / "cat" / "v0"))
    stream = spark.readStream.schema(frames["a"].schema).parquet(str(tmp_path / "in"))
    update.follow_catalog(stream, "a", SCHEMA, str(tmp_path / "cat"), str(tmp_path / "check")).awaitTermination()
    folder, _ = update.latest_catalog(spark, str(tmp_path / "cat"))
    assert catalog.load(spark, folder).tables["a"].rows == 320


def test_cells_refuse_to_grow(monkeypatch):
    f = cells.Cells((0,), np.arange(50)[:, None], np.ones(50), np.ones((50, 1)))
    g = cells.Cells((1,), np.arange(50)[:, None], np.ones(50), np.ones((50, 1)))
    assert cells.join(f, g, ()).total == 2500
    monkeypatch.setattr(cells, "MAX_CELLS", 1000)
    with pytest.raises(cells.TooManyCells):
        cells.join(f, g, ())


def test_end_to_end_update(spark, tmp_path):
    """Models of the rows before a date, then the others added: as good as models of all."""
    from joinlens.streaming import update

    sf = "/root/testdata/sf0.001"
    from joinlens.schema import driver_schema, load

    tables = {n: load(spark, sf, n) for n in ("orders", "customer")}
    c = update.train_and_update(driver_schema(), tables.__getitem__, {"orders": "o_orderdate"}, "1998-01-01", bins=16, names=["orders", "customer"])
    whole = catalog.build(driver_schema(), tables.__getitem__, 16, ["orders", "customer"])
    sql = "SELECT COUNT(*) FROM orders o, customer c WHERE o.o_custkey = c.c_custkey"
    assert c.tables["orders"].rows == 1500 and c.estimate(sql) >= whole.estimate(sql) >= 1500
