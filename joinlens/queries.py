"""The queries of the estimation engine and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from joinlens.functions import encode
from joinlens.operators import aggregates, bayes, binning, bound, catalog, estimators, evaluate, factors, independence, predicates, sampling, statistics
from joinlens.plans.parser import parse, parse_what_if
from joinlens.schema import driver_schema, load, register
from joinlens.streaming import update

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, and its SQL."""

    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in columns})


def _tables(spark: SparkSession, sf: str):
    return lambda name: load(spark, sf, name)


TWO_WAY = "SELECT COUNT(*) FROM lineitem l, orders o WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity <= 20 AND o.o_orderdate >= TIMESTAMP '1997-01-01 00:00:00'"


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    register(spark, sf, ["lineitem", "orders"])
    return bound.flagship_row(spark, TWO_WAY, bins=50)


# Binning and bin statistics

_COUNTS = "SELECT l_orderkey AS value, COUNT(*) AS n FROM lineitem WHERE l_orderkey IS NOT NULL GROUP BY 1"
_HIST = f"SELECT n, COUNT(*) AS v FROM ({_COUNTS}) GROUP BY 1"


@query(f"SELECT n, v AS values_with_n FROM ({_HIST})")
def key_frequency_hist(spark, sf):
    return binning.frequency_histogram(binning.key_counts(load(spark, sf, "lineitem"), "l_orderkey")).withColumnRenamed("values", "values_with_n")


@query(f"""WITH h AS ({_HIST}), w AS (SELECT n, v, SUM(n * v) OVER () AS total,
  COALESCE(SUM(n * v) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h)
SELECT CAST(FLOOR(before * 8 / total) AS INT) AS bin, CAST(SUM(v) AS BIGINT) AS width, CAST(SUM(n * v) AS BIGINT) AS mass, MAX(n) AS mfv FROM w GROUP BY 1""")
def equal_freq_bins(spark, sf):
    h = binning.frequency_histogram(binning.key_counts(load(spark, sf, "lineitem"), "l_orderkey"))
    return binning.equal_frequency_share(h, 8).groupBy("bin").agg(F.sum("values").alias("width"), F.sum(F.col("n") * F.col("values")).alias("mass"), F.max("n").alias("mfv"))


@query("SELECT CAST(LEAST(FLOOR(o_custkey * 16.0 / (SELECT MAX(o_custkey) FROM orders)), 15) AS INT) AS bin, COUNT(*) AS mass FROM orders GROUP BY 1")
def equal_width_bins(spark, sf):
    o = load(spark, sf, "orders")
    high = o.agg(F.max("o_custkey")).first()[0]
    return o.groupBy(binning.equal_width_bin(F.col("o_custkey"), 0, float(high), 16).alias("bin")).agg(F.count("*").alias("mass"))


@query(f"SELECT CAST(value % 32 AS INT) AS bin, CAST(SUM(n) AS BIGINT) AS mass, MAX(n) AS mfv FROM ({_COUNTS}) GROUP BY 1")
def bin_mfv_1d(spark, sf):
    c = binning.key_counts(load(spark, sf, "lineitem"), "l_orderkey")
    return binning.bin_statistics(c, binning.modulo_bin(F.col("value"), 32)).select("bin", "mass", "mfv")


@query(f"SELECT CAST(value % 32 AS INT) AS bin, ROUND(AVG(n), 6) AS mean, ROUND(VAR_POP(n), 6) AS var, COUNT(*) AS width FROM ({_COUNTS}) GROUP BY 1")
def bin_mean_variance(spark, sf):
    c = binning.key_counts(load(spark, sf, "lineitem"), "l_orderkey")
    return _rounded(binning.bin_statistics(c, binning.modulo_bin(F.col("value"), 32)).select("bin", "mean", "var", "width"), "mean", "var")


@query("""WITH r AS (SELECT l_partkey % 8 AS b1, l_suppkey % 4 AS b2, l_partkey AS k1, l_suppkey AS k2 FROM lineitem WHERE l_partkey IS NOT NULL AND l_suppkey IS NOT NULL),
m AS (SELECT b1, b2, COUNT(*) AS mass FROM r GROUP BY 1, 2),
a AS (SELECT b1, b2, MAX(n) AS v FROM (SELECT b1, b2, k1, COUNT(*) AS n FROM r GROUP BY 1, 2, 3) GROUP BY 1, 2),
b AS (SELECT b1, b2, MAX(n) AS v FROM (SELECT b1, b2, k2, COUNT(*) AS n FROM r GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT CAST(b1 AS INT) AS bin_l_partkey, CAST(b2 AS INT) AS bin_l_suppkey, mass, a.v AS mfv_l_partkey, b.v AS mfv_l_suppkey FROM m JOIN a USING (b1, b2) JOIN b USING (b1, b2)""")
def bin_mfv_2d(spark, sf):
    return binning.cell_modes(load(spark, sf, "lineitem"), {"l_partkey": binning.modulo_bin(F.col("l_partkey"), 8), "l_suppkey": binning.modulo_bin(F.col("l_suppkey"), 4)})


@query("""WITH l AS (SELECT k % 16 AS b, AVG(n) AS m, VAR_POP(n) AS v FROM (SELECT l_orderkey AS k, COUNT(*) AS n FROM lineitem GROUP BY 1) GROUP BY 1),
o AS (SELECT k % 16 AS b, AVG(n) AS m, VAR_POP(n) AS v FROM (SELECT o_orderkey AS k, COUNT(*) AS n FROM orders GROUP BY 1) GROUP BY 1)
SELECT ROUND(SUM((l.v + l.m * l.m) * (o.v + o.m * o.m) - l.m * l.m * o.m * o.m), 4) AS score FROM l JOIN o USING (b)""")
def variance_product_score(spark, sf):
    def side(table, key, name):
        c = binning.key_counts(load(spark, sf, table), key)
        return binning.bin_statistics(c, binning.modulo_bin(F.col("value"), 16)).select("bin", F.col("mean").alias(f"mean_{name}"), F.col("var").alias(f"var_{name}"))

    both = side("lineitem", "l_orderkey", "l").join(side("orders", "o_orderkey", "o"), "bin")
    return binning.variance_product(both, ["l", "o"]).withColumn("score", F.round("score", 4))


@query("""SELECT CAST(CASE WHEN o_custkey % 16 < 10 THEN o_custkey % 16 ELSE 10 END AS INT) AS bin, COUNT(*) AS n FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1""")
def bin_assignment_with_unseen(spark, sf):
    o = load(spark, sf, "orders")
    m = load(spark, sf, "customer").select(F.col("c_custkey").alias("value")).union(o.select("o_custkey")).distinct().where("value % 16 < 10").withColumn("bin", binning.modulo_bin(F.col("value"), 16))
    return binning.assign(o, "o_custkey", m, "bin", unseen=10).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))


def _greedy_sql(table: str, key: str, bins: int) -> str:
    """The engine's own equal-frequency bins (CTEs k, g, m): values in ascending order of their counts; a bin closes when its rows exceed an equal share."""
    return f"""RECURSIVE k AS (SELECT {key} AS value, COUNT(*) AS n FROM {table} WHERE {key} IS NOT NULL GROUP BY 1),
h AS (SELECT n, COUNT(*) AS v, row_number() OVER (ORDER BY n) AS r, SUM(n * COUNT(*)) OVER () / {bins}.0 AS share FROM k GROUP BY n),
g AS (SELECT r, n, 0 AS bin, CASE WHEN n * v > share AND 0 < {bins - 1} THEN 1 ELSE 0 END AS following, CASE WHEN n * v > share AND 0 < {bins - 1} THEN 0 ELSE n * v END AS held FROM h WHERE r = 1
  UNION ALL SELECT h.r, h.n, g.following, CASE WHEN g.held + h.n * h.v > h.share AND g.following < {bins - 1} THEN g.following + 1 ELSE g.following END,
    CASE WHEN g.held + h.n * h.v > h.share AND g.following < {bins - 1} THEN 0 ELSE g.held + h.n * h.v END FROM g JOIN h ON h.r = g.r + 1),
m AS (SELECT k.value, g.bin FROM k JOIN g USING (n)), means AS (SELECT bin, AVG(n) AS mean FROM m JOIN k USING (value) GROUP BY 1)"""


def _joined_bins_sql(start: tuple[str, str], other: tuple[str, str], bins: int) -> str:
    """CTEs as above, and every value of both keys in its bin (all2): unseen values go to the nearest mean."""
    return _greedy_sql(*start, bins) + f""", k2 AS (SELECT {other[1]} AS value, COUNT(*) AS n FROM {other[0]} WHERE {other[1]} IS NOT NULL GROUP BY 1),
fresh AS (SELECT value, n FROM k2 WHERE value NOT IN (SELECT value FROM m)),
nearest AS (SELECT n, bin, row_number() OVER (PARTITION BY n ORDER BY ABS(mean - n), mean, bin) AS r FROM (SELECT DISTINCT n FROM fresh) CROSS JOIN means),
all2 AS (SELECT * FROM m UNION ALL SELECT value, bin FROM fresh JOIN nearest USING (n) WHERE r = 1)"""


@query("WITH " + _greedy_sql("lineitem", "l_orderkey", 8) + " SELECT CAST(bin AS INT) AS bin, COUNT(*) AS width, CAST(SUM(n) AS BIGINT) AS mass, MAX(n) AS mfv FROM m JOIN k USING (value) GROUP BY 1")
def greedy_frequency_bins(spark, sf):
    """Equal-frequency bins as the engine cuts them."""
    counts = binning.key_counts(load(spark, sf, "lineitem"), "l_orderkey")
    return binning.equal_frequency_map(counts, 8).join(counts, "value").groupBy("bin").agg(F.count("*").alias("width"), F.sum("n").alias("mass"), F.max("n").alias("mfv"))


@query("WITH " + _joined_bins_sql(("lineitem", "l_orderkey"), ("orders", "o_orderkey"), 16) + """ SELECT CAST(bin AS INT) AS bin, CAST(COALESCE(SUM(k.n), 0) AS BIGINT) AS mass_l, CAST(COALESCE(MAX(k.n), 0) AS BIGINT) AS mfv_l,
  CAST(COALESCE(SUM(k2.n), 0) AS BIGINT) AS mass_o, CAST(COALESCE(MAX(k2.n), 0) AS BIGINT) AS mfv_o FROM all2 LEFT JOIN k USING (value) LEFT JOIN k2 USING (value) GROUP BY 1""")
def greedy_joint_bins(spark, sf):
    """Joint bins of the order key group, and what each key has in them."""
    keys = [binning.key_counts(load(spark, sf, t), k) for t, k in (("lineitem", "l_orderkey"), ("orders", "o_orderkey"))]
    m = binning.greedy_bins(keys, 32)
    l, o = (m.join(k, "value", "left").groupBy("bin").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("mass"), F.coalesce(F.max("n"), F.lit(0)).alias("mfv")) for k in keys)
    return l.alias("l").join(o.alias("o"), "bin").select("bin", F.col("l.mass").alias("mass_l"), F.col("l.mfv").alias("mfv_l"), F.col("o.mass").alias("mass_o"), F.col("o.mfv").alias("mfv_o"))


@query("""SELECT CAST(o_custkey % 20 AS INT) AS bin, ROUND(COUNT(*) * 1.0 / (SELECT COUNT(o_custkey) FROM orders), 6) AS probability, (SELECT COUNT(*) FROM orders) AS table_rows,
  ROUND((SELECT COUNT(o_custkey) * 1.0 / COUNT(*) FROM orders), 6) AS non_null_frac FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1""")
def unfiltered_factor(spark, sf):
    return _rounded(sampling.unfiltered_factor(load(spark, sf, "orders"), "o_custkey", binning.modulo_bin(F.col("o_custkey"), 20)), "probability", "non_null_frac")


@query("""SELECT 'l_partkey' AS key, CAST(l_partkey % 10 AS INT) AS bin, COUNT(*) AS n FROM lineitem WHERE l_discount >= 0.05 GROUP BY 2
UNION ALL SELECT 'l_suppkey', CAST(l_suppkey % 10 AS INT), COUNT(*) FROM lineitem WHERE l_discount >= 0.05 GROUP BY 2""")
def filtered_factor(spark, sf):
    return sampling.binned_counts(load(spark, sf, "lineitem"), "l_discount >= 0.05", {k: binning.modulo_bin(F.col(k), 10) for k in ("l_partkey", "l_suppkey")})


@query("""SELECT 'o_orderkey' AS key, COUNT(o_orderkey) AS n_rows, COUNT(DISTINCT o_orderkey) AS n_distinct, COUNT(DISTINCT o_orderkey) >= 0.99 * COUNT(o_orderkey) AS is_key FROM orders
UNION ALL SELECT 'o_custkey', COUNT(o_custkey), COUNT(DISTINCT o_custkey), COUNT(DISTINCT o_custkey) >= 0.99 * COUNT(o_custkey) FROM orders""")
def pk_detection(spark, sf):
    o = load(spark, sf, "orders")
    one, two = (binning.is_primary_key(o, k).select(F.lit(k).alias("key"), "n_rows", "n_distinct", "is_key") for k in ("o_orderkey", "o_custkey"))
    return one.unionByName(two)


@query("SELECT l_partkey AS value, COUNT(*) AS n, CAST(COUNT(*) * 10.0 AS DOUBLE) AS scaled FROM lineitem WHERE l_orderkey % 10 = 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def sample_top_values(spark, sf):
    s = sampling.modulo_sample(load(spark, sf, "lineitem"), "l_orderkey", 10)
    return s.df.groupBy(F.col("l_partkey").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(10).withColumn("scaled", F.col("n") / s.rate)


# Bounds of join sizes


def _two_way_sql(lf: str, of: str, bins: int) -> str:
    return f"""WITH l AS (SELECT l_orderkey AS k, COUNT(*) AS c FROM lineitem WHERE {lf} GROUP BY 1), o AS (SELECT o_orderkey AS k, COUNT(*) AS c FROM orders WHERE {of} GROUP BY 1),
lb AS (SELECT k % {bins} AS b, SUM(c) AS p, MAX(c) AS v FROM l GROUP BY 1), ob AS (SELECT k % {bins} AS b, SUM(c) AS p, MAX(c) AS v FROM o GROUP BY 1)
SELECT CAST(COALESCE(SUM(LEAST(lb.p * ob.v, ob.p * lb.v)), 0) AS DOUBLE) AS bound FROM lb JOIN ob USING (b)"""


@query(_two_way_sql("l_quantity <= 20", "o_orderdate >= TIMESTAMP '1997-01-01'", 50))
def bound_two_way(spark, sf):
    return bound.estimate(spark, TWO_WAY, _tables(spark, sf), driver_schema(), bins=50)


@query(_two_way_sql("true", "true", 64))
def bound_unfiltered(spark, sf):
    return bound.estimate(spark, "SELECT COUNT(*) FROM lineitem l, orders o WHERE l.l_orderkey = o.o_orderkey", _tables(spark, sf), bins=64)


@query(_two_way_sql("l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-06-30' AND (l_returnflag = 'R' OR l_linestatus = 'O')", "o_orderpriority LIKE '1%' AND o_orderstatus IN ('F', 'O')", 64))
def bound_filtered(spark, sf):
    text = """SELECT COUNT(*) FROM lineitem l, orders o WHERE l.l_orderkey = o.o_orderkey AND l.l_shipdate BETWEEN '1996-01-01'::timestamp AND '1997-06-30'::timestamp
      AND (l.l_returnflag = 'R' OR l.l_linestatus = 'O') AND o.o_orderpriority LIKE '1%' AND o.o_orderstatus IN ('F', 'O')"""
    return bound.estimate(spark, text, _tables(spark, sf), driver_schema(), bins=64)


@query(_two_way_sql("true", "o_orderstatus = 'F'", 64))
def bound_from_statistics(spark, sf):
    """lineitem from its stored factor, orders from a filtered scan."""
    s = statistics.build(driver_schema(), _tables(spark, sf), 64, ["lineitem", "orders"])
    return statistics.estimate("SELECT COUNT(*) FROM lineitem l, orders o WHERE l.l_orderkey = o.o_orderkey AND o.o_orderstatus = 'F'", s, _tables(spark, sf))


NARY = "SELECT COUNT(*) FROM customer c, supplier s, nation n WHERE c.c_nationkey = n.n_nationkey AND s.s_nationkey = n.n_nationkey AND c.c_acctbal > 0"


@query("""WITH c AS (SELECT k % 8 AS b, SUM(n) AS p, MAX(n) AS v FROM (SELECT c_nationkey AS k, COUNT(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1) GROUP BY 1),
s AS (SELECT k % 8 AS b, SUM(n) AS p, MAX(n) AS v FROM (SELECT s_nationkey AS k, COUNT(*) AS n FROM supplier GROUP BY 1) GROUP BY 1),
t AS (SELECT k % 8 AS b, SUM(n) AS p, MAX(n) AS v FROM (SELECT n_nationkey AS k, COUNT(*) AS n FROM nation GROUP BY 1) GROUP BY 1)
SELECT CAST(SUM(LEAST(c.p * s.v * t.v, s.p * c.v * t.v, t.p * c.v * s.v)) AS DOUBLE) AS bound FROM c JOIN s USING (b) JOIN t USING (b)""")
def bound_nary_group(spark, sf):
    return bound.estimate(spark, NARY, _tables(spark, sf), driver_schema(), bins=8)


CHAIN = "SELECT COUNT(*) FROM lineitem l, orders o, customer c WHERE l.l_orderkey = o.o_orderkey AND o.o_custkey = c.c_custkey AND c.c_mktsegment = 'BUILDING'"


def _chain_sql(scaled: bool) -> str:
    """The customer group goes first, then the order group."""
    fan = "LEAST(c.p, c.v)" if scaled else "1"
    agg = "SUM" if scaled else "MAX"
    return f"""WITH r AS (SELECT o_custkey AS k0, o_orderkey AS k1, o_custkey % 16 AS b0, o_orderkey % 16 AS b1 FROM orders WHERE o_custkey IS NOT NULL AND o_orderkey IS NOT NULL),
o AS (SELECT * FROM (SELECT b0, b1, COUNT(*) AS p FROM r GROUP BY 1, 2) JOIN (SELECT b0, b1, MAX(n) AS v0 FROM (SELECT b0, b1, k0, COUNT(*) AS n FROM r GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (b0, b1)
  JOIN (SELECT b0, b1, MAX(n) AS v1 FROM (SELECT b0, b1, k1, COUNT(*) AS n FROM r GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (b0, b1)),
c AS (SELECT k % 16 AS b0, SUM(n) AS p, MAX(n) AS v FROM (SELECT c_custkey AS k, COUNT(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1) GROUP BY 1),
x AS (SELECT b1, SUM(LEAST(o.p * LEAST(c.p, c.v), c.p * LEAST(o.p, o.v0))) AS p, {agg}(o.v1 * {fan}) AS m FROM o JOIN c USING (b0) GROUP BY 1),
l AS (SELECT k % 16 AS b1, SUM(n) AS p, MAX(n) AS v FROM (SELECT l_orderkey AS k, COUNT(*) AS n FROM lineitem GROUP BY 1) GROUP BY 1)
SELECT CAST(SUM(LEAST(x.p * l.v, l.p * LEAST(x.p, x.m))) AS DOUBLE) AS bound FROM x JOIN l USING (b1)"""


@query(_chain_sql(True))
def bound_chain(spark, sf):
    return bound.estimate(spark, CHAIN, _tables(spark, sf), driver_schema(), bins=16)


@query(_chain_sql(False))
def bound_chain_unscaled(spark, sf):
    return bound.estimate(spark, CHAIN, _tables(spark, sf), driver_schema(), bins=16, rule="unscaled")


STAR = "SELECT COUNT(*) FROM lineitem l, part p, supplier s WHERE l.l_partkey = p.p_partkey AND l.l_suppkey = s.s_suppkey AND p.p_size <= 25"


def _cells_sql(table: str, k0: str, k1: str, bins: int, where: str = "true") -> str:
    """Cells of a table over two keys: b0, b1, p, v0, v1."""
    rows = f"(SELECT {k0} AS k0, {k1} AS k1, {k0} % {bins} AS b0, {k1} % {bins} AS b1 FROM {table} WHERE {k0} IS NOT NULL AND {k1} IS NOT NULL AND {where})"
    mode = lambda k: f"(SELECT b0, b1, MAX(n) AS v{k} FROM (SELECT b0, b1, k{k}, COUNT(*) AS n FROM {rows} GROUP BY 1, 2, 3) GROUP BY 1, 2)"
    return f"(SELECT * FROM (SELECT b0, b1, COUNT(*) AS p FROM {rows} GROUP BY 1, 2) JOIN {mode(0)} USING (b0, b1) JOIN {mode(1)} USING (b0, b1))"


def _side_sql(table: str, key: str, bins: int, where: str = "true") -> str:
    """Cells of a table over one key: b, p, v."""
    return f"(SELECT k % {bins} AS b, SUM(n) AS p, MAX(n) AS v FROM (SELECT {key} AS k, COUNT(*) AS n FROM {table} WHERE {key} IS NOT NULL AND {where} GROUP BY 1) GROUP BY 1)"


def _star_sql(bins: int, centre: str = "true", first: str = "true") -> str:
    """The part group goes first, then the supplier group."""
    return f"""WITH o AS {_cells_sql("lineitem", "l_partkey", "l_suppkey", bins, centre)}, c AS {_side_sql("part", "p_partkey", bins, first)}, l AS {_side_sql("supplier", "s_suppkey", bins)},
x AS (SELECT b1, SUM(LEAST(o.p * LEAST(c.p, c.v), c.p * LEAST(o.p, o.v0))) AS p, SUM(o.v1 * LEAST(c.p, c.v)) AS m FROM o JOIN c ON o.b0 = c.b GROUP BY 1)
SELECT CAST(COALESCE(SUM(LEAST(x.p * LEAST(l.p, l.v), l.p * LEAST(x.p, x.m))), 0) AS DOUBLE) AS bound FROM x JOIN l ON x.b1 = l.b"""


@query(_star_sql(16, first="p_size <= 25"))
def bound_star(spark, sf):
    return bound.estimate(spark, STAR, _tables(spark, sf), driver_schema(), bins=16)


@query(_star_sql(16, centre="l_orderkey % 2 = 0"))
def bound_from_statistics_nulls(spark, sf):
    """Half of lineitem has no order: from its stored factor of part and supplier alone."""
    def tables(name):
        df = load(spark, sf, name)
        return df.where("l_orderkey % 2 = 0").withColumn("l_orderkey", F.when(F.col("l_orderkey") % 4 == 0, F.col("l_orderkey"))) if name == "lineitem" else df

    s = statistics.build(driver_schema(), tables, 16, ["lineitem", "part", "supplier"])
    return statistics.estimate("SELECT COUNT(*) FROM lineitem l, part p, supplier s WHERE l.l_partkey = p.p_partkey AND l.l_suppkey = s.s_suppkey", s, tables)


CYCLE = """SELECT COUNT(*) FROM lineitem l, orders o, customer c, supplier s WHERE l.l_orderkey = o.o_orderkey AND o.o_custkey = c.c_custkey
  AND l.l_suppkey = s.s_suppkey AND c.c_nationkey = s.s_nationkey"""


def _cycle_sql(bins: int) -> str:
    """Groups in the order customer key, nation, order key, supplier key."""
    return f"""WITH c AS {_cells_sql("customer", "c_custkey", "c_nationkey", bins)}, o AS {_cells_sql("orders", "o_custkey", "o_orderkey", bins)},
s AS {_cells_sql("supplier", "s_nationkey", "s_suppkey", bins)}, l AS {_cells_sql("lineitem", "l_orderkey", "l_suppkey", bins)},
x0 AS (SELECT c.b1 AS g1, o.b1 AS g2, SUM(LEAST(c.p * LEAST(o.p, o.v0), o.p * LEAST(c.p, c.v0))) AS p, SUM(c.v1 * LEAST(o.p, o.v0)) AS m1, SUM(o.v1 * LEAST(c.p, c.v0)) AS m2 FROM c JOIN o USING (b0) GROUP BY 1, 2),
x AS (SELECT g1, g2, p, LEAST(p, m1) AS m1, LEAST(p, m2) AS m2 FROM x0),
y0 AS (SELECT g2, s.b1 AS g3, SUM(LEAST(x.p * LEAST(s.p, s.v0), s.p * LEAST(x.p, x.m1))) AS p, SUM(x.m2 * LEAST(s.p, s.v0)) AS m2 FROM x JOIN s ON x.g1 = s.b0 GROUP BY 1, 2),
y AS (SELECT g2, g3, p, LEAST(p, m2) AS m2 FROM y0)
SELECT CAST(SUM(LEAST(y.p * LEAST(l.p, l.v0), l.p * LEAST(y.p, y.m2))) AS DOUBLE) AS bound FROM y JOIN l ON y.g2 = l.b0 AND y.g3 = l.b1"""


@query(_cycle_sql(16))
def bound_cyclic(spark, sf):
    return bound.estimate(spark, CYCLE, _tables(spark, sf), driver_schema(), bins=16)


@query("""WITH o AS (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY 1), a AS (SELECT k % 16 AS b, SUM(n) AS p, MAX(n) AS v FROM o GROUP BY 1)
SELECT CAST(SUM(p * v) AS DOUBLE) AS bound FROM a""")
def bound_self_join(spark, sf):
    return bound.estimate(spark, "SELECT COUNT(*) FROM orders a, orders b WHERE a.o_custkey = b.o_custkey", _tables(spark, sf), driver_schema(), bins=16)


@query("""WITH c AS (SELECT k % 8 AS b, SUM(n) AS p, MAX(n) AS v FROM (SELECT c_nationkey AS k, COUNT(*) AS n FROM customer GROUP BY 1) GROUP BY 1),
s AS (SELECT k % 8 AS b, SUM(n) AS p, MAX(n) AS v FROM (SELECT s_nationkey AS k, COUNT(*) AS n FROM supplier GROUP BY 1) GROUP BY 1),
t AS (SELECT k % 8 AS b, SUM(n) AS p, MAX(n) AS v FROM (SELECT n_nationkey AS k, COUNT(*) AS n FROM nation GROUP BY 1) GROUP BY 1)
SELECT 'c n' AS aliases, CAST(SUM(LEAST(c.p * t.v, t.p * c.v)) AS DOUBLE) AS bound FROM c JOIN t USING (b)
UNION ALL SELECT 'n s', CAST(SUM(LEAST(s.p * t.v, t.p * s.v)) AS DOUBLE) FROM s JOIN t USING (b)
UNION ALL SELECT 'c s', CAST(SUM(LEAST(s.p * c.v, c.p * s.v)) AS DOUBLE) FROM s JOIN c USING (b)
UNION ALL SELECT 'c n s', CAST(SUM(LEAST(c.p * s.v * t.v, s.p * c.v * t.v, t.p * c.v * s.v)) AS DOUBLE) FROM c JOIN s USING (b) JOIN t USING (b)""")
def subplan_bounds(spark, sf):
    text = "SELECT COUNT(*) FROM customer c, supplier s, nation n WHERE c.c_nationkey = n.n_nationkey AND s.s_nationkey = n.n_nationkey"
    return bound.subplan_bounds(spark, text, _tables(spark, sf), bins=8)


@query("SELECT COUNT(*) AS true_count FROM lineitem, orders, customer WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_mktsegment = 'BUILDING'")
def true_cardinality_chain(spark, sf):
    register(spark, sf, ["lineitem", "orders", "customer"])
    return bound.true_count(spark, CHAIN)


@query("SELECT COUNT(*) AS n FROM lineitem, orders, customer WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_mktsegment = 'BUILDING'")
def advised_join_order(spark, sf):
    """The chain query in the order that the bounds advise."""
    from joinlens.plans import planner

    q = parse(CHAIN, driver_schema())
    tables = _tables(spark, sf)
    rows = {frozenset(r["aliases"].split()): r["bound"] for r in bound.subplan_bounds(spark, CHAIN, tables, bins=32).collect()}
    names, _ = planner.best_order(q, lambda s: rows.get(s, 0.0))
    return planner.ordered_join(q, tables, names).agg(F.count("*").alias("n"))


@query(f"""SELECT CAST(l.b AS INT) AS bin, CAST(LEAST(l.p * LEAST(o.p, o.v), o.p * LEAST(l.p, l.v)) AS BIGINT) AS out FROM {_side_sql("lineitem", "l_suppkey", 20)} l JOIN {_side_sql("supplier", "s_suppkey", 20)} o USING (b)""")
def bound_kernel(spark, sf):
    """The bound of each bin of the supplier group."""
    def side(table, key, n):
        c = binning.key_counts(load(spark, sf, table), key)
        return binning.bin_statistics(c, binning.modulo_bin(F.col("value"), 20)).select("bin", F.col("mass").alias(f"p{n}"), F.col("mfv").alias(f"v{n}"))

    both = side("lineitem", "l_suppkey", 1).join(side("supplier", "s_suppkey", 2), "bin")
    return both.select("bin", bound.kernel([F.col("p1"), F.col("p2")], [F.col("v1"), F.col("v2")]).cast("bigint").alias("out"))


# Evaluation


@query("""WITH e AS (SELECT c_custkey, COUNT(o_orderkey) AS truth, (SELECT COUNT(*) * 1.0 / (SELECT COUNT(*) FROM customer) FROM orders) AS estimate FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1),
q AS (SELECT GREATEST(GREATEST(estimate, 1) / GREATEST(truth, 1), GREATEST(truth, 1) / GREATEST(estimate, 1)) AS q FROM e)
SELECT ROUND(quantile_cont(q, 0.5), 6) AS p50, ROUND(quantile_cont(q, 0.9), 6) AS p90, ROUND(quantile_cont(q, 0.95), 6) AS p95, ROUND(quantile_cont(q, 0.99), 6) AS p99, ROUND(MAX(q), 6) AS p100 FROM q""")
def qerror_percentiles(spark, sf):
    c, o = load(spark, sf, "customer"), load(spark, sf, "orders")
    guess = o.count() / max(1, c.count())
    rows = c.join(o, c.c_custkey == o.o_custkey, "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("truth")).withColumn("estimate", F.lit(guess))
    return _rounded(evaluate.q_error_percentiles(rows), "p50", "p90", "p95", "p99", "p100")


# Networks and factors


@query("""SELECT 'l_quantity' AS column_name, COUNT(DISTINCT l_quantity) AS n_distinct, 'categorical' AS kind FROM lineitem
UNION ALL SELECT 'l_linestatus', COUNT(DISTINCT l_linestatus), CASE WHEN COUNT(DISTINCT l_linestatus) = 2 THEN 'boolean' ELSE 'categorical' END FROM lineitem
UNION ALL SELECT 'l_shipdate', COUNT(DISTINCT l_shipdate), CASE WHEN COUNT(DISTINCT l_shipdate) > 1000 THEN 'continuous' ELSE 'categorical' END FROM lineitem
UNION ALL SELECT 'l_orderkey', COUNT(DISTINCT l_orderkey), 'categorical' FROM lineitem""")
def attr_types(spark, sf):
    return bayes.attribute_types(load(spark, sf, "lineitem"), ["l_quantity", "l_linestatus", "l_shipdate", "l_orderkey"], keys=["l_orderkey"])


@query("""WITH n AS (SELECT p_brand AS value, COUNT(*) AS n FROM part GROUP BY 1), t AS (SELECT value, n, row_number() OVER (ORDER BY n DESC, value) - 1 AS code FROM n QUALIFY code < 5),
r AS (SELECT * FROM n WHERE value NOT IN (SELECT value FROM t)),
p AS (SELECT value, n, 5 + FLOOR(COALESCE(SUM(n) OVER (ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 4 / SUM(n) OVER ()) AS code FROM r),
a AS (SELECT value, n, CAST(code AS INT) AS code FROM t UNION ALL SELECT value, n, CAST(code AS INT) FROM p)
SELECT value, n, code, ROUND(n * 1.0 / SUM(n) OVER (PARTITION BY code), 6) AS share FROM a""")
def mcv_encoding(spark, sf):
    return _rounded(bayes.common_value_codes(load(spark, sf, "part"), "p_brand", common=5, bins=4), "share")


@query("""WITH e AS (SELECT quantile_cont(o_totalprice, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q FROM orders)
SELECT CAST(len(list_filter(q[2:10], lambda x: x <= o_totalprice)) AS INT) AS bin, COUNT(*) AS n FROM orders, e GROUP BY 1""")
def quantile_bins(spark, sf):
    o = load(spark, sf, "orders")
    return o.groupBy(bayes.interval_bin(F.col("o_totalprice"), bayes.quantile_edges(o, "o_totalprice", 10)).alias("bin")).agg(F.count("*").alias("n"))


@query("""SELECT p_brand, ROUND(CASE WHEN b = a THEN CASE WHEN a BETWEEN 1000 AND 1500 THEN 1.0 ELSE 0.0 END ELSE GREATEST(0, LEAST(1500, b) - GREATEST(1000, a)) / (b - a) END, 6) AS coverage
FROM (SELECT p_brand, MIN(p_retailprice) AS a, MAX(p_retailprice) AS b FROM part GROUP BY 1)""")
def range_coverage(spark, sf):
    """What a price range covers of each brand's prices, spread evenly."""
    rows = load(spark, sf, "part").groupBy("p_brand").agg(F.min("p_retailprice").alias("a"), F.max("p_retailprice").alias("b"))
    return rows.select("p_brand", F.round(bayes.interval_coverage(F.lit(1000.0), F.lit(1500.0), F.col("a"), F.col("b")), 6).alias("coverage"))


def _mi_sql(a: str, b: str) -> str:
    return f"""SELECT '{a}' AS a, '{b}' AS b, ROUND(SUM(n * 1.0 / t * LN(n * 1.0 * t / (nx * ny))), 6) AS mi FROM (
  SELECT n, SUM(n) OVER () AS t, SUM(n) OVER (PARTITION BY x) AS nx, SUM(n) OVER (PARTITION BY y) AS ny FROM (SELECT {a} AS x, {b} AS y, COUNT(*) AS n FROM lineitem GROUP BY 1, 2))"""


_MI = ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity"]


@query(" UNION ALL ".join(_mi_sql(a, b) for i, a in enumerate(_MI) for b in _MI[i + 1 :]))
def pairwise_mi(spark, sf):
    return _rounded(bayes.mutual_information(bayes.pair_counts(load(spark, sf, "lineitem"), _MI)), "mi")


@query("WITH RECURSIVE mi AS (" + " UNION ALL ".join(_mi_sql(a, b) for i, a in enumerate(_MI) for b in _MI[i + 1 :]) + """), e AS (SELECT a AS p, b AS c, mi FROM mi UNION ALL SELECT b, a, mi FROM mi),
t AS (SELECT 0 AS k, ['l_returnflag'] AS seen, 'l_returnflag' AS child, CAST(NULL AS VARCHAR) AS parent
  UNION ALL SELECT k + 1, list_append(seen, c), c, p FROM (SELECT k, seen, c, p, row_number() OVER (ORDER BY mi DESC, c, p) AS r FROM t JOIN e ON list_contains(seen, p) AND NOT list_contains(seen, c)) WHERE r = 1)
SELECT child, parent FROM t""")
def chow_liu_tree(spark, sf):
    tree = bayes.structure(load(spark, sf, "lineitem"), _MI)
    return spark.createDataFrame(sorted((c, p) for c, p in tree.items()), "child string, parent string")


_CELLS = "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY 1, 2"
_GRID = f"SELECT a.l_returnflag, b.l_linestatus, COALESCE(n, 0) AS n FROM (SELECT DISTINCT l_returnflag FROM lineitem) a CROSS JOIN (SELECT DISTINCT l_linestatus FROM lineitem) b LEFT JOIN ({_CELLS}) c ON c.l_returnflag = a.l_returnflag AND c.l_linestatus = b.l_linestatus"


@query(f"SELECT l_returnflag, l_linestatus, ROUND(n * 1.0 / SUM(n) OVER (PARTITION BY l_returnflag), 6) AS value FROM ({_CELLS})")
def cpd_mle(spark, sf):
    return _rounded(bayes.cpd(load(spark, sf, "lineitem"), "l_linestatus", "l_returnflag"), "value")


@query(f"SELECT l_returnflag, l_linestatus, ROUND((n + 1.0) / SUM(n + 1) OVER (PARTITION BY l_returnflag), 6) AS value FROM ({_GRID})")
def cpd_k2(spark, sf):
    return _rounded(bayes.cpd(load(spark, sf, "lineitem"), "l_linestatus", "l_returnflag", alpha=1.0), "value")


@query(f"WITH g AS (SELECT *, 5.0 / COUNT(*) OVER () AS a FROM ({_GRID})) SELECT l_returnflag, l_linestatus, ROUND((n + a) / SUM(n + a) OVER (PARTITION BY l_returnflag), 6) AS value FROM g")
def cpd_bdeu(spark, sf):
    return _rounded(bayes.cpd_bdeu(load(spark, sf, "lineitem"), "l_linestatus", "l_returnflag"), "value")


@query("""WITH f AS (SELECT l_returnflag, COUNT(*) AS n FROM lineitem GROUP BY 1), c AS (SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT ROUND(SUM(f.n * 1.0 / (SELECT COUNT(*) FROM lineitem) * c.n / f.n), 6) AS probability FROM c JOIN f USING (l_returnflag) WHERE l_linestatus = 'O' AND l_returnflag IN ('A', 'R')""")
def network_probability(spark, sf):
    df = load(spark, sf, "lineitem")
    tree = {"l_returnflag": None, "l_linestatus": "l_returnflag", "l_linenumber": "l_returnflag"}
    w = {"l_linestatus": spark.sql("SELECT 'O' AS state, 1.0D AS weight"), "l_returnflag": spark.sql("SELECT * FROM VALUES ('A', 1.0D), ('R', 1.0D) AS t(state, weight)")}
    return _rounded(bayes.tree_probability(df, tree, w), "probability")


def _two_factors(spark, sf) -> tuple[DataFrame, DataFrame]:
    df = load(spark, sf, "lineitem")
    return factors.counts(df, ["l_returnflag", "l_linestatus"]), factors.counts(df, ["l_linestatus", "l_linenumber"])


_A = "SELECT l_returnflag, l_linestatus, COUNT(*) * 1.0 AS v FROM lineitem GROUP BY 1, 2"
_B = "SELECT l_linestatus, l_linenumber, COUNT(*) * 1.0 AS w FROM lineitem GROUP BY 1, 2"


@query(f"SELECT l_returnflag, l_linestatus, l_linenumber, CAST(v * w AS DOUBLE) AS value FROM ({_A}) JOIN ({_B}) USING (l_linestatus)")
def factor_product(spark, sf):
    return factors.product(*_two_factors(spark, sf))


@query(f"SELECT l_returnflag, l_linestatus, l_linenumber, CAST(v + w AS DOUBLE) AS value FROM ({_A}) JOIN ({_B}) USING (l_linestatus)")
def factor_sum(spark, sf):
    return factors.total(*_two_factors(spark, sf))


@query(f"SELECT l_returnflag, l_linestatus, l_linenumber, ROUND(CAST(v AS DOUBLE) / w, 6) AS value FROM ({_A}) JOIN ({_B}) USING (l_linestatus)")
def factor_divide(spark, sf):
    return _rounded(factors.divide(*_two_factors(spark, sf)), "value")


@query(f"SELECT l_linestatus, CAST(SUM(v) AS DOUBLE) AS value FROM ({_A}) GROUP BY 1")
def factor_marginalize(spark, sf):
    return factors.marginalize(_two_factors(spark, sf)[0], ["l_returnflag"])


@query(f"SELECT l_linestatus, CAST(MAX(v) AS DOUBLE) AS value FROM ({_A}) GROUP BY 1")
def factor_maximize(spark, sf):
    return factors.maximize(_two_factors(spark, sf)[0], ["l_returnflag"])


@query(f"SELECT l_returnflag, CAST(v AS DOUBLE) AS value FROM ({_A}) WHERE l_linestatus = 'O'")
def factor_reduce(spark, sf):
    return factors.reduce(_two_factors(spark, sf)[0], {"l_linestatus": "O"})


@query(f"SELECT l_returnflag, l_linestatus, ROUND(CAST(v AS DOUBLE) / SUM(v) OVER (), 6) AS value FROM ({_A})")
def factor_normalize(spark, sf):
    return _rounded(factors.normalize(_two_factors(spark, sf)[0]), "value")


@query(f"SELECT CAST(SUM(v * w) AS DOUBLE) AS partition FROM ({_A}) JOIN ({_B}) USING (l_linestatus)")
def partition_function(spark, sf):
    return factors.partition_function(list(_two_factors(spark, sf)))


@query("""WITH j AS (SELECT l_returnflag AS x, l_linestatus AS y, COUNT(*) * 1.0 / (SELECT COUNT(*) FROM lineitem) AS p FROM lineitem GROUP BY 1, 2),
a AS (SELECT x, SUM(p) AS px FROM j GROUP BY 1), b AS (SELECT y, SUM(p) AS py FROM j GROUP BY 1)
SELECT ROUND(MAX(ABS(COALESCE(p, 0) - px * py)), 6) AS gap FROM a CROSS JOIN b LEFT JOIN j ON j.x = a.x AND j.y = b.y""")
def independence_check(spark, sf):
    joint = factors.counts(load(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"])
    return _rounded(factors.independence_gap(joint, "l_returnflag", "l_linestatus"), "gap")


_CHI = """WITH c AS (SELECT {z} AS z, l_returnflag AS x, l_linestatus AS y, COUNT(*) AS n FROM lineitem GROUP BY 1, 2, 3),
x AS (SELECT z, x, SUM(n) AS nx FROM c GROUP BY 1, 2), y AS (SELECT z, y, SUM(n) AS ny FROM c GROUP BY 1, 2), t AS (SELECT z, SUM(n) AS t, COUNT(DISTINCT x) AS kx, COUNT(DISTINCT y) AS ky FROM c GROUP BY 1)
SELECT ROUND(SUM((COALESCE(n, 0) - nx * 1.0 * ny / t) ** 2 / (nx * 1.0 * ny / t)), 4) AS statistic, (SELECT CAST(SUM((kx - 1) * (ky - 1)) AS BIGINT) FROM t) AS dof
FROM x JOIN y USING (z) JOIN t USING (z) LEFT JOIN c USING (z, x, y)"""


@query(_CHI.format(z="0"))
def chi_square_stat(spark, sf):
    return independence.chi_square(load(spark, sf, "lineitem"), "l_returnflag", "l_linestatus").withColumn("statistic", F.round("statistic", 4))


@query(_CHI.format(z="l_linenumber"))
def ci_chi_square(spark, sf):
    return independence.chi_square(load(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", ["l_linenumber"]).withColumn("statistic", F.round("statistic", 4))


@query("SELECT ROUND(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem")
def pearson_r(spark, sf):
    return _rounded(independence.partial_correlation(load(spark, sf, "lineitem"), "l_quantity", "l_extendedprice"), "r")


@query("""WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS xy, corr(l_quantity, l_discount) AS xz, corr(l_extendedprice, l_discount) AS yz FROM lineitem)
SELECT ROUND((xy - xz * yz) / SQRT((1 - xz * xz) * (1 - yz * yz)), 6) AS r FROM c""")
def partial_correlation(spark, sf):
    return _rounded(independence.partial_correlation(load(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", "l_discount"), "r")


_COV = ["l_quantity", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, ROUND(covar_samp({a}, {b}), 6) AS covariance FROM lineitem" for i, a in enumerate(_COV) for b in _COV[i:]))
def cov_matrix(spark, sf):
    return _rounded(independence.covariance_matrix(load(spark, sf, "lineitem"), _COV), "covariance")


@query("SELECT ROUND(regr_slope(l_extendedprice, l_quantity), 4) AS slope, ROUND(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem")
def linear_gaussian_fit(spark, sf):
    df = independence.linear_fit(load(spark, sf, "lineitem"), "l_extendedprice", "l_quantity")
    return df.select(F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"))


_KEYBINS = """SELECT CAST(l_suppkey % 8 AS INT) AS supp, ROUND(COUNT(*) * 1.0 / (SELECT COUNT(*) FROM lineitem), 6) AS value FROM lineitem WHERE l_linenumber IN (1, 2) GROUP BY 1"""


@query(_KEYBINS)
def network_key_bins(spark, sf):
    """A key's bins together with a filter on its parent: a tree says this exactly."""
    df = load(spark, sf, "lineitem").select(binning.modulo_bin(F.col("l_suppkey"), 8).alias("supp"), "l_linenumber", "l_returnflag")
    c = predicates.merge(["l_linenumber IN (1, 2, 9)", "l_linenumber <= 2"])["l_linenumber"]
    w = spark.createDataFrame(predicates.weights(c, list(range(10))), "state int, weight double")
    tree = {"l_linenumber": None, "supp": "l_linenumber", "l_returnflag": "l_linenumber"}
    return _rounded(bayes.key_distribution(df, tree, {"l_linenumber": w}, ["supp"]), "value")


@query("""WITH l AS (SELECT k % 16 AS b, SUM(n) * 10.0 AS p, MAX(CASE WHEN n > 1 THEN n * 10.0 ELSE n END) AS v FROM (SELECT o_custkey AS k, COUNT(*) AS n FROM orders WHERE o_orderkey % 10 = 0 GROUP BY 1) GROUP BY 1),
c AS (SELECT k % 16 AS b, SUM(n) AS p, MAX(n) AS v FROM (SELECT c_custkey AS k, COUNT(*) AS n FROM customer GROUP BY 1) GROUP BY 1)
SELECT CAST(SUM(LEAST(l.p * LEAST(c.p, c.v), c.p * LEAST(l.p, l.v))) AS DOUBLE) AS bound FROM l JOIN c USING (b)""")
def sampled_estimate(spark, sf):
    q = parse("SELECT COUNT(*) FROM orders o, customer c WHERE o.o_custkey = c.c_custkey", driver_schema())
    o = sampling.modulo_sample(load(spark, sf, "orders"), "o_orderkey", 10)
    return bound.estimate_from_samples(q, {"orders": (o.df, o.rate), "customer": (load(spark, sf, "customer"), 1.0)}, bins=16)


@query("""WITH o AS (SELECT o_custkey % 16 AS b, COUNT(*) AS p FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1), m AS (SELECT k % 16 AS b, MAX(n) AS v FROM (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY 1) GROUP BY 1),
c AS (SELECT k % 16 AS b, SUM(n) AS p, MAX(n) AS v FROM (SELECT c_custkey AS k, COUNT(*) AS n FROM customer GROUP BY 1) GROUP BY 1)
SELECT ROUND(CAST(SUM(LEAST(o.p * LEAST(c.p, c.v), c.p * LEAST(o.p, m.v))) AS DOUBLE), 3) AS bound FROM o JOIN m USING (b) JOIN c USING (b)""")
def network_estimate(spark, sf):
    """Masses from the tables' networks; with one attribute the tree is exact."""
    o, c = load(spark, sf, "orders"), load(spark, sf, "customer")
    nets = {"orders": estimators.learn(o, ["o_custkey"], ["o_orderstatus"], 16), "customer": estimators.learn(c, ["c_custkey"], ["c_mktsegment"], 16)}
    q = parse("SELECT COUNT(*) FROM orders o, customer c WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus IN ('F', 'O')", driver_schema())
    return estimators.estimate_from_networks(q, nets).select(F.round("bound", 3).alias("bound"))


@query("""SELECT 'o_custkey' AS column_name, COUNT(*) AS n FROM orders WHERE o_custkey >= 10 AND o_custkey < 77 AND o_custkey BETWEEN 3 AND 30 AND o_custkey <> 12
UNION ALL SELECT 'o_totalprice', COUNT(*) FROM orders WHERE o_totalprice > 100 AND o_totalprice <= 50
UNION ALL SELECT 'o_orderstatus', COUNT(*) FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderstatus <> 'O'""")
def predicate_merge(spark, sf):
    """Rows that pass conjunctions, each merged into one condition of a column."""
    merged = predicates.merge(["o_custkey >= 10", "o_custkey < 77", "o_custkey BETWEEN 3 AND 30", "o_custkey != 12", "o_totalprice > 100", "o_totalprice <= 50", "o_orderstatus IN ('F', 'O')", "o_orderstatus <> 'O'"])
    o = load(spark, sf, "orders")
    passes = [F.count_if(predicates.as_column(c, F.col(name))).alias(name) for name, c in merged.items()]
    return o.agg(*passes).unpivot([], list(merged), "column_name", "n")


@query("""SELECT 'c n' AS aliases, COUNT(*) AS n FROM customer, nation WHERE c_nationkey = n_nationkey AND c_acctbal > 0
UNION ALL SELECT 'c s', COUNT(*) FROM customer, supplier WHERE c_nationkey = s_nationkey AND c_acctbal > 0 UNION ALL SELECT 'n s', COUNT(*) FROM nation, supplier WHERE n_nationkey = s_nationkey""")
def subplan_sql(spark, sf):
    """The texts of the sub-plans of two tables, run; one of their joins only holds through the third table."""
    from joinlens.plans.planner import connected_subsets

    register(spark, sf, ["customer", "supplier", "nation"])
    q = parse(NARY, driver_schema())
    out = None
    for s in (s for s in connected_subsets(q) if len(s) == 2):
        row = spark.sql(q.sql("COUNT(*) AS n", set(s))).select(F.lit(" ".join(sorted(s))).alias("aliases"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT ROUND(AVG(CASE WHEN c_acctbal > 5000 THEN COALESCE(n, 0) ELSE 0 END), 6) AS expectation FROM customer LEFT JOIN (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def fanout_expectation(spark, sf):
    n = load(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = load(spark, sf, "customer")
    both = c.join(n, c.c_custkey == n.o_custkey, "left")
    return _rounded(bayes.expectation(both, F.col("c_acctbal") > 5000, F.coalesce("n", F.lit(0)).cast("double")), "expectation")


@query("""WITH n AS (SELECT p_brand AS value, COUNT(*) AS n FROM part WHERE p_size <= 25 AND p_brand <> 'Brand#11' GROUP BY 1), t AS (SELECT value, row_number() OVER (ORDER BY n DESC, value) - 1 AS code FROM n QUALIFY code < 5),
r AS (SELECT * FROM n WHERE value NOT IN (SELECT value FROM t)),
old AS (SELECT value, code FROM t UNION ALL SELECT value, 5 + FLOOR(COALESCE(SUM(n) OVER (ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 4 / SUM(n) OVER ()) FROM r),
a AS (SELECT p_brand AS value, COUNT(*) AS n FROM part WHERE p_size > 25 OR p_brand <> 'Brand#11' GROUP BY 1)
SELECT a.value, a.n, CAST(CASE WHEN old.value IS NULL THEN (SELECT MAX(code) + 1 FROM old) ELSE code END AS INT) AS code FROM a LEFT JOIN old USING (value)""")
def update_categories(spark, sf):
    """Codes of old values stay, a new value gets one behind them."""
    p = load(spark, sf, "part")
    old = bayes.common_value_codes(p.where("p_size <= 25 and p_brand <> 'Brand#11'"), "p_brand", common=5, bins=4)
    return bayes.extend_codes(old, p.where("p_size > 25"), "p_brand", groups=1).select("value", "n", "code")


@query("SELECT l_orderkey % 100 AS part, CAST(SUM(epoch(l_shipdate) - epoch(TIMESTAMP '2010-07-19 00:00:00')) AS BIGINT) AS seconds FROM lineitem GROUP BY 1")
def dates_to_seconds(spark, sf):
    df = encode.dates_to_seconds(load(spark, sf, "lineitem"))
    return df.groupBy((F.col("l_orderkey") % 100).alias("part")).agg(F.sum("l_shipdate").alias("seconds"))


@query("WITH " + _joined_bins_sql(("orders", "o_custkey"), ("customer", "c_custkey"), 16) + """ SELECT CAST(bin AS INT) AS bin, COUNT(*) AS width, CAST(SUM(k2.n) AS BIGINT) AS mass_customer, CAST(SUM(k.n) AS BIGINT) AS mass_orders
FROM all2 LEFT JOIN k USING (value) LEFT JOIN k2 USING (value) GROUP BY 1""")
def fixed_start_bins(spark, sf):
    """Bins of the customer key group from its start key; masses of each key."""
    keys = {"orders": binning.key_counts(load(spark, sf, "orders"), "o_custkey"), "customer": binning.key_counts(load(spark, sf, "customer"), "c_custkey")}
    _, m = binning.fixed_start_bins(keys, 16)
    out = m.groupBy("bin").agg(F.count("*").alias("width"))
    for name, k in keys.items():
        out = out.join(m.join(k, "value").groupBy("bin").agg(F.sum("n").alias(f"mass_{name}")), "bin", "left")
    return out


@query("SELECT CAST(SUM(n * n) AS BIGINT) AS n FROM (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY 1)")
def true_cardinality_self_join(spark, sf):
    register(spark, sf, ["orders"])
    return bound.true_count(spark, "SELECT COUNT(*) FROM orders a, orders b WHERE a.o_custkey = b.o_custkey").withColumnRenamed("true_count", "n")


# Samples and updates


@query("SELECT CAST(o_custkey % 10 AS INT) AS bin, CAST(COUNT(*) * 10.0 AS DOUBLE) AS mass FROM orders WHERE o_orderkey % 10 = 0 AND o_orderstatus = 'F' GROUP BY 1")
def sample_factor_scaled(spark, sf):
    o = load(spark, sf, "orders")
    s = sampling.modulo_sample(o, "o_orderkey", 10, rows=o.count())
    counts = sampling.binned_counts(s.df, "o_orderstatus = 'F'", {"o_custkey": binning.modulo_bin(F.col("o_custkey"), 10)})
    return _rounded(sampling.scaled_factor(counts, s.rate, o.count()), "mass")


@query("SELECT part, COUNT(*) AS n, MIN(o_orderdate) AS first_date FROM (SELECT CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'before' ELSE 'after' END AS part, o_orderdate FROM orders) GROUP BY 1")
def split_by_date(spark, sf):
    before, after = update.split_by_time(load(spark, sf, "orders"), "o_orderdate", "1998-01-01")
    return before.withColumn("part", F.lit("before")).unionByName(after.withColumn("part", F.lit("after"))).groupBy("part").agg(F.count("*").alias("n"), F.min("o_orderdate").alias("first_date"))


_MODE = "SELECT k % 12 AS bin, MAX(n) AS v FROM (SELECT o_custkey AS k, COUNT(*) AS n FROM orders WHERE {w} GROUP BY 1) GROUP BY 1"


@query(f"""WITH o AS ({_MODE.format(w="o_orderdate < TIMESTAMP '1998-01-01'")}), n AS ({_MODE.format(w="o_orderdate >= TIMESTAMP '1998-01-01'")})
SELECT CAST(bin AS INT) AS bin, CAST(CASE WHEN COALESCE(o.v, 0) <= 10 THEN GREATEST(COALESCE(o.v, 0), COALESCE(n.v, 0)) ELSE o.v + 0.5 * COALESCE(n.v, 0) END AS DOUBLE) AS mfv FROM o FULL JOIN n USING (bin)""")
def update_mode_merge(spark, sf):
    old, new = update.split_by_time(load(spark, sf, "orders"), "o_orderdate", "1998-01-01")
    stats = [binning.bin_statistics(binning.key_counts(d, "o_custkey"), binning.modulo_bin(F.col("value"), 12)) for d in (old, new)]
    return update.merge_modes(*stats)


@query("SELECT CAST(k % 12 AS INT) AS bin, MAX(n) AS mfv FROM (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY 1) GROUP BY 1")
def update_mode_exact(spark, sf):
    old, new = update.split_by_time(load(spark, sf, "orders"), "o_orderdate", "1998-01-01")
    counts = update.merge_counts(*(binning.key_counts(d, "o_custkey") for d in (old, new)))
    return binning.bin_statistics(counts, binning.modulo_bin(F.col("value"), 12)).select("bin", "mfv")


@query("SELECT o_orderstatus, o_orderpriority, ROUND(COUNT(*) * 1.0 / SUM(COUNT(*)) OVER (PARTITION BY o_orderstatus), 6) AS value FROM orders GROUP BY 1, 2")
def update_cpd_counts(spark, sf):
    names = ["o_orderstatus", "o_orderpriority"]
    old, new = update.split_by_time(load(spark, sf, "orders"), "o_orderdate", "1998-01-01")
    merged = update.merge_cpd_counts(factors.counts(old, names), factors.counts(new, names), names)
    return _rounded(factors.conditional(merged, ["o_orderstatus"]), "value")


# Aggregate queries


@query("SELECT ROUND(SUM(l_extendedprice * l_discount), 2) AS result FROM lineitem WHERE l_quantity < 24 AND l_discount BETWEEN 0.03 AND 0.07")
def aqp_sum_product(spark, sf):
    register(spark, sf, ["lineitem"])
    return aggregates.run(spark, "SELECT SUM(l_extendedprice * l_discount) FROM lineitem WHERE l_quantity < 24 AND l_discount BETWEEN 0.03 AND 0.07", driver_schema()).select(F.round("result", 2).alias("result"))


@query("SELECT o_orderpriority, ROUND(AVG(o_totalprice), 2) AS result FROM orders, customer WHERE o_custkey = c_custkey AND c_mktsegment = 'MACHINERY' GROUP BY 1")
def aqp_group_by(spark, sf):
    register(spark, sf, ["orders", "customer"])
    out = aggregates.run(spark, "SELECT o_orderpriority, AVG(o_totalprice) FROM orders o, customer AS c WHERE o.o_custkey = c.c_custkey AND c_mktsegment = 'MACHINERY' GROUP BY o_orderpriority", driver_schema())
    return out.withColumn("result", F.round("result", 2))


@query("SELECT ROUND(SUM(l_extendedprice) - SUM(l_tax), 2) AS result FROM lineitem")
def aqp_difference(spark, sf):
    register(spark, sf, ["lineitem"])
    return aggregates.run(spark, "SELECT SUM(l_extendedprice) - SUM(l_tax) FROM lineitem", driver_schema()).select(F.round("result", 2).alias("result"))


@query("SELECT ROUND(SUM(CASE WHEN l_returnflag = 'R' AND l_linestatus IN ('F', 'O') THEN 1.1 ELSE 1 END * l_extendedprice), 2) AS scaled FROM lineitem")
def what_if_scale(spark, sf):
    s = parse_what_if("WHAT IF l_returnflag = 'R' AND l_linestatus IN ('F', 'O') INCREASE BY 10%")
    return aggregates.what_if(load(spark, sf, "lineitem"), s, "l_extendedprice").select(F.round("scaled", 2).alias("scaled"))


@query("""SELECT MIN(p_name) AS first_name, MIN(l_extendedprice) AS least_price FROM lineitem, part, supplier WHERE l_partkey = p_partkey AND l_suppkey = s_suppkey AND (p_type LIKE '%STEEL%' OR p_brand IN ('Brand#12', 'Brand#23'))
AND p_name NOT LIKE 'z%' AND l_quantity BETWEEN 5 AND 30 AND s_acctbal IS NOT NULL AND l_linenumber <> 3""")
def jobstyle_min_like_in_between(spark, sf):
    register(spark, sf, ["lineitem", "part", "supplier"])
    q = parse("""SELECT MIN(p.p_name), MIN(l.l_extendedprice) FROM lineitem AS l, part AS p, supplier AS s WHERE l.l_partkey = p.p_partkey AND l.l_suppkey = s.s_suppkey
      AND (p.p_type LIKE '%STEEL%' OR p.p_brand IN ('Brand#12', 'Brand#23')) AND p.p_name NOT LIKE 'z%' AND l.l_quantity BETWEEN 5 AND 30 AND s.s_acctbal IS NOT NULL AND l.l_linenumber != 3""", driver_schema())
    return spark.sql(q.sql("MIN(p.p_name) AS first_name, MIN(l.l_extendedprice) AS least_price"))


@query("SELECT c_nationkey, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 3")
def top_values_per_group(spark, sf):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return load(spark, sf, "customer").withColumn("r", F.row_number().over(w)).where("r <= 3").select("c_nationkey", "c_custkey", "c_acctbal")


# Encodings


@query("SELECT o_orderkey, CAST(epoch(o_orderdate) - epoch(TIMESTAMP '2010-07-19 00:00:00') AS BIGINT) AS seconds FROM orders")
def epoch_seconds(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", encode.epoch_seconds(F.col("o_orderdate")).alias("seconds"))


@query("SELECT p_partkey, CAST(p_size AS INT) AS number FROM part")
def roman_to_int(spark, sf):
    """Sizes written as roman numerals and read again."""
    tens, ones = F.array(*map(F.lit, ["", "X", "XX", "XXX", "XL", "L"])), F.array(*map(F.lit, ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]))
    size = F.col("p_size").cast("int")
    text = F.concat(F.get(tens, F.floor(size / 10).cast("int")), F.get(ones, size % 10))
    return load(spark, sf, "part").select("p_partkey", encode.roman_to_int(text).alias("number"))


@query("SELECT p_partkey, CAST(CAST(p_partkey % 26 AS VARCHAR) || CAST(p_size AS VARCHAR) AS INT) AS number FROM part")
def phonetic_to_int(spark, sf):
    text = F.concat(F.char((F.col("p_partkey") % 26 + 65).cast("int")), F.col("p_size").cast("int").cast("string"))
    return load(spark, sf, "part").select("p_partkey", encode.phonetic_to_int(text).cast("int").alias("number"))


@query("""SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 = 1 THEN 1000 ELSE year(o_orderdate) END * 10000 + CASE WHEN o_orderkey % 5 = 2 THEN 9999 ELSE year(o_orderdate) + o_orderkey % 7 END AS INT) AS number FROM orders""")
def series_years_to_int(spark, sf):
    """Spans of years, open at either end for some."""
    first = F.when(F.col("o_orderkey") % 3 == 1, "????").otherwise(F.year("o_orderdate").cast("string"))
    last = F.when(F.col("o_orderkey") % 5 == 2, "????").otherwise((F.year("o_orderdate") + F.col("o_orderkey") % 7).cast("string"))
    return load(spark, sf, "orders").select("o_orderkey", encode.series_years_to_int(F.concat(first, F.lit("-"), last)).cast("int").alias("number"))


#: Ten tables, among them one twice and two that occur twice.
WIDE = """SELECT COUNT(*) FROM lineitem l, orders o, customer c, supplier s, nation n1, nation n2, region r1, region r2, part p, lineitem l2 WHERE l.l_orderkey = o.o_orderkey AND o.o_custkey = c.c_custkey
  AND l.l_suppkey = s.s_suppkey AND c.c_nationkey = n1.n_nationkey AND s.s_nationkey = n2.n_nationkey AND n1.n_regionkey = r1.r_regionkey AND n2.n_regionkey = r2.r_regionkey
  AND l.l_partkey = p.p_partkey AND l2.l_partkey = p.p_partkey AND p.p_size <= 25"""

WORKLOAD = [TWO_WAY, NARY, CHAIN, STAR]


@query("""WITH u AS (SELECT * FROM (VALUES ('customer.c_custkey', 1), ('lineitem.l_orderkey', 2), ('lineitem.l_partkey', 1), ('lineitem.l_suppkey', 1), ('customer.c_nationkey', 1)) t(key_group, n))
SELECT key_group, CAST(ROUND(120.0 * n / SUM(n) OVER ()) AS INT) AS bins FROM u""")
def workload_key_budget(spark, sf):
    """Bins for each key group by how many queries of the workload join in it; the group is named by its smallest key."""
    groups = {m: g[0] for g in driver_schema().key_groups() for m in g}
    uses: dict[str, int] = {}
    for text in WORKLOAD:
        q = parse(text, driver_schema())
        for name in {".".join(groups[(q.aliases[a], c)]) for g in q.key_groups() for a, c in g}:
            uses[name] = uses.get(name, 0) + 1
    return spark.createDataFrame(list(binning.workload_budget(uses, 120).items()), "key_group string, bins int")


# Stored models


def _catalog(spark, sf, names: list[str], bins: int) -> catalog.Catalog:
    return catalog.build(driver_schema(), _tables(spark, sf), bins, names)


@query(_two_way_sql("true", "true", 32))
def catalog_two_way(spark, sf):
    """From stored models alone."""
    c = _catalog(spark, sf, ["lineitem", "orders"], 32)
    return spark.createDataFrame([(c.estimate("SELECT COUNT(*) FROM lineitem l, orders o WHERE l.l_orderkey = o.o_orderkey"),)], "bound double")


_PLAIN_CHAIN = "SELECT COUNT(*) FROM lineitem l, orders o, customer c WHERE l.l_orderkey = o.o_orderkey AND o.o_custkey = c.c_custkey"


@query(f"""WITH o AS {_cells_sql("orders", "o_custkey", "o_orderkey", 16)}, c AS {_side_sql("customer", "c_custkey", 16)}, l AS {_side_sql("lineitem", "l_orderkey", 16)},
co AS (SELECT b1, SUM(LEAST(o.p * LEAST(c.p, c.v), c.p * LEAST(o.p, o.v0))) AS p, SUM(LEAST(LEAST(o.p * LEAST(c.p, c.v), c.p * LEAST(o.p, o.v0)), LEAST(o.p, o.v1) * LEAST(c.p, c.v))) AS m FROM o JOIN c ON o.b0 = c.b GROUP BY 1),
lo AS (SELECT SUM(LEAST(o.p * LEAST(l.p, l.v), l.p * LEAST(o.p, o.v1))) AS p FROM o JOIN l ON o.b1 = l.b)
SELECT 'c' AS aliases, CAST((SELECT COUNT(*) FROM customer) AS DOUBLE) AS estimate UNION ALL SELECT 'o', (SELECT COUNT(*) FROM orders) UNION ALL SELECT 'l', (SELECT COUNT(*) FROM lineitem)
UNION ALL SELECT 'c o', (SELECT SUM(p) FROM co) UNION ALL SELECT 'l o', (SELECT p FROM lo)
UNION ALL SELECT 'c l o', (SELECT SUM(LEAST(co.p * LEAST(l.p, l.v), l.p * LEAST(co.p, co.m))) FROM co JOIN l ON co.b1 = l.b)""")
def catalog_subplans(spark, sf):
    """All sub-plans of the chain, each from one that is smaller by a table."""
    return catalog.as_rows(spark, _catalog(spark, sf, ["lineitem", "orders", "customer"], 16).subplans(_PLAIN_CHAIN))


@query("""WITH o AS (SELECT o_custkey % 16 AS b, COUNT(*) AS p FROM orders GROUP BY 1) SELECT CAST(b AS INT) AS bin, CAST(p AS DOUBLE) AS mass FROM o""")
def catalog_update_masses(spark, sf):
    """Models of the rows before a date, then the others added: masses as if all had been there."""
    c = update.train_and_update(driver_schema(), _tables(spark, sf), {"orders": "o_orderdate"}, "1998-01-01", 16, ["orders"])
    f = c.tables["orders"].factors[("o_custkey",)]
    return spark.createDataFrame([(int(b), float(p)) for (b,), p in zip(f.bins, f.mass, strict=True)], "bin int, mass double")


@query("SELECT ROUND(AVG(l_extendedprice) + covar_samp(l_extendedprice, l_quantity) / var_samp(l_quantity) * (10 - AVG(l_quantity)), 4) AS mean, ROUND((var_pop(l_extendedprice) - covar_pop(l_extendedprice, l_quantity) ** 2 / var_pop(l_quantity)) / 1e6, 3) AS variance FROM lineitem")
def gaussian_given(spark, sf):
    """Prices at a quantity of 10, by the tables' joint Gaussian."""
    from joinlens.models import gaussian

    g = gaussian.from_table(load(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity"]).given({"l_quantity": 10.0})
    return spark.createDataFrame([(round(float(g.mean[0]), 4), round(float(g.cov[0, 0]) / 1e6, 3))], "mean double, variance double")


@query("""WITH n AS (SELECT l_returnflag AS a, l_linestatus AS b, COUNT(*) AS n FROM lineitem GROUP BY 1, 2) SELECT b AS state, ROUND(SUM(n) * 1.0 / (SELECT SUM(n) FROM n WHERE a IN ('A', 'R')), 6) AS probability FROM n WHERE a IN ('A', 'R') GROUP BY 1""")
def network_posterior(spark, sf):
    """A variable given a set of another's states, from the fitted network of both."""
    df = load(spark, sf, "lineitem")
    joint = factors.product(bayes.cpd(df, "l_returnflag"), bayes.cpd(df, "l_linestatus", "l_returnflag"))
    out = factors.normalize(factors.marginalize(factors.reduce(joint, {"l_returnflag": ["A", "R"]}), ["l_returnflag"]))
    return _rounded(out.select(F.col("l_linestatus").alias("state"), F.col("value").alias("probability")), "probability")
