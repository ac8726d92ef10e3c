import numpy as np
import pytest
from pyspark.sql import functions as F

from joinlens.models import causal, chains, formats, gaussian
from joinlens.models.dag import Dag, Graph, elimination_order, junction_tree, triangulated
from joinlens.models.network import Network, Table, fit, predict, sample


def wet_grass() -> Network:
    net = Network(Dag([("rain", "sprinkler"), ("rain", "wet"), ("sprinkler", "wet")]), {n: ["no", "yes"] for n in ("rain", "sprinkler", "wet")})
    net.tables = {
        "rain": Table("rain", (), np.array([0.8, 0.2])),
        "sprinkler": Table("sprinkler", ("rain",), np.array([[0.6, 0.99], [0.4, 0.01]])),
        "wet": Table("wet", ("sprinkler", "rain"), np.array([[[1.0, 0.2], [0.1, 0.01]], [[0.0, 0.8], [0.9, 0.99]]])),
    }
    net.check()
    return net


def test_query_by_elimination():
    net = wet_grass()
    p = net.query(["rain"], {"wet": "yes"})
    truth = (0.2 * (0.99 * 0.8 + 0.01 * 0.99)) / (0.2 * (0.99 * 0.8 + 0.01 * 0.99) + 0.8 * 0.4 * 0.9)
    assert p[1] == pytest.approx(truth)
    assert net.probability({"rain": "yes", "wet": "yes"}) == pytest.approx(0.2 * (0.99 * 0.8 + 0.01 * 0.99))


@pytest.mark.parametrize("write, read", [(formats.write_bif, formats.read_bif), (formats.write_xmlbif, formats.read_xmlbif), (formats.write_xbn, formats.read_xbn)])
def test_formats_round_trip(write, read):
    net = wet_grass()
    again = read(write(net))
    assert again.graph.edges == net.graph.edges and again.states == net.states
    for n in net.graph.nodes:
        assert again.tables[n].parents == net.tables[n].parents
        assert np.array_equal(again.tables[n].values, net.tables[n].values)


def test_uai_round_trip():
    net = wet_grass()
    again = formats.uai_network(formats.write_uai(net))
    assert again.graph.edges == [("var_0", "var_1"), ("var_0", "var_2"), ("var_1", "var_2")]
    assert np.array_equal(again.tables["var_2"].values, net.tables["wet"].values)


def test_separation_and_blanket():
    g = Dag([("a", "c"), ("b", "c"), ("c", "d")])
    assert g.separated("a", "b") and not g.separated("a", "b", ["d"]) and g.separated("a", "d", ["c"])
    assert g.blanket("a") == {"b", "c"} and g.immoralities() == {(frozenset("ab"), "c")}
    assert ("a", "b") in g.moral().edges and g.do("c").edges == [("c", "d")]
    assert Dag([("a", "b")]).equivalent(Dag([("b", "a")])) and not g.equivalent(Dag([("c", "a"), ("c", "b"), ("c", "d")]))
    with pytest.raises(ValueError):
        g.add_edge("d", "a")


def test_triangulation():
    square = Graph([("a", "b"), ("b", "c"), ("c", "d"), ("d", "a")])
    states = {n: 2 for n in "abcd"}
    chordal, cliques = triangulated(square, states)
    assert not square.is_chordal() and chordal.is_chordal() and sorted(map(len, cliques)) == [3, 3]
    _, tree = junction_tree(square, states)
    assert len(tree) == 1
    for cost in ("min_fill", "min_neighbors", "min_weight", "weighted_min_fill"):
        assert sorted(elimination_order(square, states, cost)) == list("abcd")


def test_adjustment_sets():
    g = Dag([("z", "x"), ("z", "y"), ("x", "y")])
    assert causal.backdoor_sets(g, "x", "y") == [frozenset("z")]
    front = Dag([("u", "x"), ("u", "y"), ("x", "m"), ("m", "y")])
    assert causal.frontdoor_sets(front, "x", "y") == [frozenset("m")]
    assert causal.factorisation(g) == "P(z)P(x|z)P(y|x,z)"


def test_average_effect(spark):
    df = spark.range(400).select(F.randn(1).alias("z"), F.randn(2).alias("e"), F.randn(3).alias("n")).select("z", (F.col("z") + F.col("e")).alias("x"), "n").withColumn("y", 2 * F.col("x") + 5 * F.col("z") + 0.01 * F.col("n"))
    assert causal.average_effect(df, Dag([("z", "x"), ("z", "y"), ("x", "y")]), "x", "y") == pytest.approx(2, abs=0.01)


def test_semigraphoid_closure():
    i = causal.Independence.of
    known = [i("a", "b", "cd"), i("a", "d", "c")]
    assert causal.entails(known, i("a", "bd", "c")) and causal.entails([i("a", "bc")], i("a", "b", "c"))
    assert not causal.entails([i("a", "b")], i("a", "b", "c")) and causal.equivalent([i("a", "b")], [i("b", "a")])


def test_gaussian_forms_agree():
    g = gaussian.Gaussian(("a", "b", "c"), np.array([1.0, 2, 3]), np.array([[2.0, 0.5, 0.2], [0.5, 1, 0.3], [0.2, 0.3, 1.5]]))
    c = g.canonical()
    assert c.pdf([0, 1, 2]) == pytest.approx(g.pdf([0, 1, 2]))
    assert c.marginal(["a", "b"]).pdf([0, 1]) == pytest.approx(g.marginal(["a", "b"]).pdf([0, 1]))
    assert np.allclose(c.given({"c": 1.0}).moments().mean, g.given({"c": 1.0}).mean)
    assert c.given({"c": 1.0}).pdf([0, 1]) == pytest.approx(g.pdf([0, 1, 1]))
    assert sum(gaussian.discretised(0, 1, -5, 5, 50)) == pytest.approx(1, abs=1e-3)
    assert sum(gaussian.discretised_unbiased(0, 1, -5, 5, 50)) == pytest.approx(1, abs=1e-3)


def test_linear_gaussian_network(spark):
    df = spark.range(500).select(F.randn(5).alias("x"), F.randn(6).alias("e")).select("x", (3 + 2 * F.col("x") + F.col("e")).alias("y"))
    g = gaussian.joint(gaussian.fit_network(df, Dag([("x", "y")])))
    t = gaussian.from_table(df, ["x", "y"])
    assert np.allclose(g.mean, t.mean) and np.allclose(g.cov, t.cov)


@pytest.mark.parametrize("method", ["hmc", "hmc_da", "nuts", "nuts_da"])
def test_chains_find_the_moments(method):
    g = gaussian.Gaussian(("a", "b"), np.array([1.0, -1.0]), np.array([[1.0, 0.6], [0.6, 2.0]]))
    out = np.array(list(chains.chain(g, 3000, 3, method)))
    assert np.allclose(out.mean(0), g.mean, atol=0.2) and np.allclose(np.cov(out.T), g.cov, atol=0.4)


def test_sampling_and_prediction(spark):
    net = wet_grass()
    rows = sample(spark, net, 4000, seed=1)
    share = rows.where("rain = 'yes'").count() / 4000
    assert share == pytest.approx(0.2, abs=0.03)
    weighted = sample(spark, net, 4000, seed=2, evidence={"wet": "yes"}, weighted=True)
    r = weighted.agg(F.sum(F.when(F.col("rain") == "yes", F.col("weight"))).alias("a"), F.sum("weight").alias("b")).first()
    assert r["a"] / r["b"] == pytest.approx(net.query(["rain"], {"wet": "yes"})[1], abs=0.04)
    again = fit(rows, net.graph)
    assert again.tables["sprinkler"].values[1, 0] == pytest.approx(0.4, abs=0.04)
    out = predict(rows.select("rain", "sprinkler"), net, "wet", ["rain", "sprinkler"])
    assert out.where("rain = 'yes' and predicted_wet = 'no'").count() == 0
    one = chains.sample(spark, gaussian.Gaussian(("a",), np.zeros(1), np.eye(1)), 10, chains=2, method="hmc")
    assert one.count() == 20


def test_decision_process_round_trip():
    from joinlens.models import pomdp

    model = {
        "description": "door",
        "discount": 0.95,
        "variables": [{"kind": "StateVar", "vnamePrev": "d0", "vnameCurr": "d1", "fullyObs": "false", "values": ["left", "right"]}, {"kind": "ActionVar", "vname": "a", "values": ["listen", "open"]}, {"kind": "RewardVar", "vname": "r", "values": []}],
        "functions": {
            "InitialStateBelief": [{"var": "d0", "parents": ["null"], "type": "TBL", "table": [(["-"], ["0.5", "0.5"])]}],
            "StateTransitionFunction": [{"var": "d1", "parents": ["a", "d0"], "type": "DD", "diagram": ("a", {"listen": ("d0", {"left": 1.0, "right": 0.0}), "open": 0.5})}],
            "ObsFunction": [],
            "RewardFunction": [{"var": "r", "parents": ["a"], "type": "TBL", "table": [(["listen"], ["-1"])]}],
        },
    }
    assert pomdp.read(pomdp.write(model)) == model
