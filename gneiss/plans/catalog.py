"""Queries over the harness tables, each with the DuckDB SQL that must give the same rows. Floats are rounded in both."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions import exprs as E
from gneiss.operators import estimators, layout, linalg, ml, ordering, stats
from gneiss.sources import arrays
from gneiss.streaming.moments import windowed_moments

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        name = f.__name__.rstrip("_")
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r(c, digits: int = 6):
    """Rounded, without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


NANS = "CASE WHEN event_id % 97 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END"


def events(spark, sf):
    return t(spark, sf, "events").select("event_id", "event_type", F.col("value").alias("v"), F.expr(NANS).alias("x"))



@query("""WITH b AS (SELECT l_returnflag, l_linestatus, l_extendedprice AS x, avg(l_extendedprice) OVER (PARTITION BY l_returnflag, l_linestatus) AS m FROM lineitem)
SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(x),6) AS mean, round(var_pop(x),6) AS var0, round(var_samp(x),6) AS var1,
 round(avg(power(x-m,3))/power(var_pop(x),1.5),6) AS skew, round(avg(power(x-m,4))/power(var_pop(x),2)-3,6) AS kurt, round(quantile_cont(x,0.5),6) AS median, round(quantile_cont(x,0.9),6) AS q90
FROM b GROUP BY 1,2""")
def stats_by_flag(spark, sf):
    return stats.describe(t(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag", "l_linestatus"])


@query("""SELECT p_partkey, CAST(((p_size*3+100+128)%256+256)%256-128 AS TINYINT) AS add8, CAST((((p_size*p_size*7)+128)%256+256)%256-128 AS TINYINT) AS mul8, CAST(((p_size-120+128)%256+256)%256-128 AS TINYINT) AS sub8 FROM part""")
def ew_wrap(spark, sf):
    p = F.col("p_size").cast("bigint")
    return t(spark, sf, "part").select("p_partkey", E.add(p * 3, F.lit(100), 8).alias("add8"), E.multiply(p * p, F.lit(7), 8).alias("mul8"), E.subtract(p, F.lit(120), 8).alias("sub8"))


@query("""SELECT o_orderkey, CAST(((CAST(o_orderkey AS HUGEINT)*9223372036854775807 + 9223372036854775808) & 18446744073709551615) - 9223372036854775808 AS BIGINT) AS m FROM orders""")
def ew_wrap64(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", E.multiply(F.col("o_orderkey"), F.lit(9223372036854775807), 64).alias("m"))


@query("""SELECT event_id, CASE WHEN isnan(q) THEN 'nan' WHEN isinf(q) THEN CASE WHEN q>0 THEN 'inf' ELSE '-inf' END ELSE 'finite' END AS kind, CASE WHEN isnan(q) OR isinf(q) THEN 0 ELSE round(q,6) END AS q
FROM (SELECT event_id, CASE WHEN event_id%3<>0 THEN d/(event_id%3) WHEN d=0 THEN CAST('NaN' AS DOUBLE) WHEN d>0 THEN CAST('Infinity' AS DOUBLE) ELSE CAST('-Infinity' AS DOUBLE) END AS q FROM (SELECT event_id, CASE WHEN event_id%5=0 THEN 0.0 WHEN event_id%2=0 THEN -value ELSE value END AS d FROM events))""")
def ew_divide(spark, sf):
    d = F.when(F.col("event_id") % 5 == 0, 0.0).when(F.col("event_id") % 2 == 0, -F.col("v")).otherwise(F.col("v"))
    q = E.divide(d, (F.col("event_id") % 3).cast("double"))
    kind = F.when(F.isnan(q), "nan").when(E.is_inf(q), F.when(q > 0, "inf").otherwise("-inf")).otherwise("finite")
    return events(spark, sf).select("event_id", kind.alias("kind"), F.when(E.is_finite(q), r(q)).otherwise(F.lit(0.0)).alias("q"))


@query("""SELECT c_custkey, CAST(trunc((c_nationkey-12)/7.0) AS INTEGER) AS q, CAST((c_nationkey-12)%7 AS INTEGER) AS m FROM customer""")
def ew_intdiv(spark, sf):
    n = F.col("c_nationkey") - 12
    return t(spark, sf, "customer").select("c_custkey", E.int_divide(n, F.lit(7), 32).alias("q"), (n % 7).cast("int").alias("m"))


@query(f"""SELECT event_id, (NOT isnan(x) AND x = value) AS eq, (isnan(x) OR x <> value) AS ne, (NOT isnan(x) AND x < 100) AS lt, (NOT isnan(x) AND x >= 100) AS ge FROM (SELECT event_id, value, {NANS} AS x FROM events)""")
def ew_compare(spark, sf):
    x, v, c = F.col("x"), F.col("v"), F.lit(100.0)
    return events(spark, sf).select("event_id", E.compare("==", x, v).alias("eq"), E.compare("!=", x, v).alias("ne"), E.compare("<", x, c).alias("lt"), E.compare(">=", x, c).alias("ge"))


@query("""SELECT s_suppkey, least(greatest(s_acctbal,0.0),5000.0) AS clipped, CASE WHEN s_acctbal>=0 THEN 1.0 ELSE -1.0 END AS sgn, abs(s_acctbal) AS a, -s_acctbal AS ng, (CASE WHEN s_acctbal<0 THEN -1 ELSE 1 END)*floor(abs(s_acctbal)+0.5) AS rounded FROM supplier""")
def ew_unary(spark, sf):
    x = F.col("s_acctbal")
    return t(spark, sf, "supplier").select("s_suppkey", E.clip(x, 0.0, 5000.0).alias("clipped"), E.sign(x).alias("sgn"), F.abs(x).alias("a"), (-x).alias("ng"), E.round_half_away(x).alias("rounded"))


@query("SELECT p_partkey, p_size & 12 AS a, p_size | 12 AS o, xor(p_size, 12) AS x, ~p_size AS n FROM part")
def ew_bitwise(spark, sf):
    p = F.col("p_size")
    return t(spark, sf, "part").select("p_partkey", p.bitwiseAND(12).alias("a"), p.bitwiseOR(12).alias("o"), p.bitwiseXOR(12).alias("x"), F.bitwise_not(p).alias("n"))


@query("""SELECT event_id, CASE WHEN event_id%2=0 THEN value ELSE -1.0 END AS w, CASE event_id%3 WHEN 0 THEN value WHEN 1 THEN 2*value ELSE 0.0 END AS c, CASE WHEN value>200 THEN 0.0 ELSE value END AS f FROM events""")
def ew_where(spark, sf):
    i, v = F.col("event_id"), F.col("v")
    return events(spark, sf).select("event_id", F.when(i % 2 == 0, v).otherwise(-1.0).alias("w"), E.choose(i % 3, [v, 2 * v, F.lit(0.0)]).alias("c"), F.when(v > 200, 0.0).otherwise(v).alias("f"))


@query("SELECT count(*) AS n, bool_and(abs(value - (value + 1e-9)) <= 1e-8 + 1e-5*abs(value + 1e-9)) AS near, bool_and(abs(value - value*1.1) <= 1e-8 + 1e-5*abs(value*1.1)) AS far FROM events")
def allclose(spark, sf):
    v = F.col("v")
    return events(spark, sf).agg(F.count(v).alias("n"), F.bool_and(E.close(v, v + 1e-9)).alias("near"), F.bool_and(E.close(v, v * 1.1)).alias("far"))


@query("""SELECT event_type, round(sum(value),4) AS s, round(avg(value),6) AS m, min(value) AS lo, max(value) AS hi, bool_and(value>0) AS every, bool_or(value>480) AS some, CAST(count_if(value>100) AS BIGINT) AS n, CAST(((sum(event_id)+128)%256+256)%256-128 AS TINYINT) AS wrapped FROM events GROUP BY 1""")
def red_basic(spark, sf):
    v = F.col("v")
    return events(spark, sf).groupBy("event_type").agg(r(F.sum(v), 4).alias("s"), r(F.avg(v)).alias("m"), E.nan_min(v).alias("lo"), E.nan_max(v).alias("hi"), F.bool_and(v > 0).alias("every"), F.bool_or(v > 480).alias("some"), F.count_if(v > 100).alias("n"), E.wrap(F.sum(F.col("event_id")), 8).alias("wrapped"))


@query(f"""SELECT event_type, bool_or(isnan(x)) AS has_nan, min(x) FILTER (NOT isnan(x)) AS lo, max(x) FILTER (NOT isnan(x)) AS hi, round(avg(x) FILTER (NOT isnan(x)),6) AS m, round(stddev_pop(x) FILTER (NOT isnan(x)),6) AS s FROM (SELECT event_type, {NANS} AS x FROM events) GROUP BY 1""")
def nan_moments(spark, sf):
    x = F.col("x")
    y = F.when(~F.isnan(x), x)
    return events(spark, sf).groupBy("event_type").agg(F.isnan(E.nan_min(x)).alias("has_nan"), F.min(y).alias("lo"), F.max(y).alias("hi"), r(F.avg(y)).alias("m"), r(F.stddev_pop(y)).alias("s"))


@query(f"""WITH e AS (SELECT event_type, event_id, value, {NANS} AS x FROM events) SELECT event_type, (SELECT min(event_id) FROM e b WHERE b.event_type=a.event_type AND b.value=min(a.value)) AS lo, (SELECT min(event_id) FROM e b WHERE b.event_type=a.event_type AND b.value=max(a.value)) AS hi, min(event_id) FILTER (isnan(x)) AS first_nan FROM e a GROUP BY 1""")
def argmin_argmax(spark, sf):
    return events(spark, sf).groupBy("event_type").agg(E.arg_extreme(F.col("v"), F.col("event_id")).alias("lo"), E.arg_extreme(F.col("v"), F.col("event_id"), True).alias("hi"), E.arg_extreme(F.col("x"), F.col("event_id")).alias("first_nan"))


@query("SELECT event_id, round(sum(value) OVER (ORDER BY event_id), 3) AS running FROM events")
def cumsum(spark, sf):
    return ordering.cumulative(events(spark, sf), "event_id", "v", "running", block=4096).select("event_id", r(F.col("running"), 3).alias("running"))


@query("SELECT event_id, round(exp(sum(ln(1+value*1e-6)) OVER (ORDER BY event_id)), 6) AS running FROM events")
def cumprod(spark, sf):
    d = events(spark, sf).withColumn("f", 1 + F.col("v") * 1e-6)
    return ordering.cumulative(d, "event_id", "f", "running", product=True, block=4096).select("event_id", r(F.col("running")).alias("running"))


@query("SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS rank FROM events")
def argsort(spark, sf):
    return ordering.argsort(events(spark, sf), ["event_type"], "event_id", "v").select("event_type", "event_id", F.col("rank").cast("bigint").alias("rank"))


@query("SELECT event_type, rank, value AS v FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS rank FROM events) WHERE rank < 10")
def partition_k(spark, sf):
    return ordering.smallest(events(spark, sf), ["event_type"], "event_id", "v", 10).select("event_type", F.col("rank").cast("bigint").alias("rank"), "v")


@query("SELECT n_nationkey, (SELECT count(*) FROM part WHERE p_size < n_nationkey*2) AS lo, (SELECT count(*) FROM part WHERE p_size <= n_nationkey*2) AS hi FROM nation")
def searchsorted(spark, sf):
    needles, hay = t(spark, sf, "nation").select("n_nationkey", (F.col("n_nationkey") * 2).alias("k")), t(spark, sf, "part")
    left = ordering.searchsorted(hay, "p_size", needles, "k").select("n_nationkey", F.col("position").alias("lo"))
    return left.join(ordering.searchsorted(hay, "p_size", needles, "k", "right").select("n_nationkey", F.col("position").alias("hi")), "n_nationkey")


@query("SELECT p_size AS value, count(*) AS n, min(p_partkey) AS first_index FROM part GROUP BY 1")
def unique_full(spark, sf):
    return ordering.unique(t(spark, sf, "part"), "p_partkey", "p_size")


@query("SELECT event_id, coalesce((SELECT max(n_nationkey) FROM nation WHERE n_nationkey % 10 = event_id), value) AS v FROM events")
def put_last(spark, sf):
    w = t(spark, sf, "nation").select((F.col("n_nationkey") % 10).cast("bigint").alias("at"), F.col("n_nationkey").alias("pos"), F.col("n_nationkey").cast("double").alias("new"))
    return ordering.put(events(spark, sf).select("event_id", "v"), "event_id", "v", w)


def table_matrix(spark, sf):
    """All events as a matrix of 40 columns, and its shape; 0.0 fills a last short row."""
    e = t(spark, sf, "events").select("event_id", F.col("value").alias("v"))
    n = length(e)
    shape = (-(-n // 40), 40)
    e = e.unionByName(spark.range(n, shape[0] * 40).select(F.col("id").alias("event_id"), F.lit(0.0).alias("v")))
    return e.select(F.floor(F.col("event_id") / 40).alias("i0"), (F.col("event_id") % 40).alias("i1"), "v"), shape


def length(e: DataFrame) -> int:
    last = e.agg(F.max("event_id")).first()[0]
    return 0 if last is None else last + 1


def weights(m: DataFrame) -> DataFrame:
    return arrays.full(m.sparkSession, (40, 3), (F.col("i0") + F.col("i1")) / 100.0)


W = "(SELECT e // 40 AS i0, e % 40 AS i1, e, v FROM (SELECT event_id AS e, value AS v FROM events UNION ALL SELECT m + k, 0.0 FROM (SELECT max(event_id) AS m FROM events), range(1, 40) x(k) WHERE (m + k) // 40 = m // 40))"
ROWS = "(SELECT max(event_id) // 40 + 1 FROM events)"
#: Layout and products over the whole table.
WHOLE = {
    "reshape": (lambda m, s: layout.reshape(m, s, (40, -1)), f"SELECT e//{ROWS} AS i0, e%{ROWS} AS i1, v FROM {W}"),
    "transpose": (lambda m, s: layout.transpose(m, 2), f"SELECT i1 AS i0, i0 AS i1, v FROM {W}"),
    "ravel": (lambda m, s: layout.ravel(m, s), f"SELECT e AS i0, v FROM {W}"),
    "expand_squeeze": (lambda m, s: layout.squeeze(layout.expand_dims(m, 2, 1), (s[0], 1, 40)), f"SELECT i0, i1, v FROM {W}"),
    "slice_step": (lambda m, s: layout.take_slice(m, 1, 3, 30, 4), f"SELECT i0, (i1-3)//4 AS i1, v FROM {W} WHERE i1>=3 AND i1<30 AND (i1-3)%4=0"),
    "concat": (lambda m, s: layout.concatenate([(m, s), (m, s)], 0), f"SELECT i0, i1, v FROM {W} UNION ALL SELECT i0+{ROWS}, i1, v FROM {W}"),
    "stack": (lambda m, s: layout.stack([m, m], 2), f"SELECT CAST(0 AS BIGINT) AS i0, i0 AS i1, i1 AS i2, v FROM {W} UNION ALL SELECT 1, i0, i1, v FROM {W}"),
    "split": (lambda m, s: layout.split(m, 40, 4, 1), f"SELECT i0, i1%10 AS i1, v, i1//10 AS part FROM {W}"),
    "repeat": (lambda m, s: layout.repeat(m, 2, 1), f"SELECT i0, i1*2+k AS i1, v FROM {W}, (VALUES (0),(1)) x(k)"),
    "tile": (lambda m, s: layout.tile(m, s[0], 3, 0), f"SELECT i0+{ROWS}*k AS i0, i1, v FROM {W}, (VALUES (0),(1),(2)) x(k)"),
    "flip": (lambda m, s: layout.flip(m, 40, 1), f"SELECT i0, 39-i1 AS i1, v FROM {W}"),
    "roll": (lambda m, s: layout.roll(m, s[0], -7, 0), f"SELECT ((i0-7)%{ROWS}+{ROWS})%{ROWS} AS i0, i1, v FROM {W}"),
    "pad": (lambda m, s: layout.pad(m, s, [(1, 0), (2, 1)], 9.0), f"SELECT i0+1 AS i0, i1+2 AS i1, v FROM {W} UNION ALL SELECT a, b, 9.0 FROM (SELECT unnest(range({ROWS}+1)) AS a), range(43) y(b) WHERE a<1 OR b<2 OR b>=42"),
    "diagonal": (lambda m, s: layout.diagonal(m, 2), f"SELECT i0, v FROM {W} WHERE i1-i0=2"),
    "trace": (lambda m, s: linalg.trace(m).select(r(F.col("trace")).alias("trace")), f"SELECT round(sum(v),6) AS trace FROM {W} WHERE i0=i1"),
    "matmul": (lambda m, s: linalg.matmul(layout.transpose(m, 2), m).select("i0", "i1", r(F.col("v"), 3).alias("v")), f"SELECT a.i1 AS i0, b.i1, round(sum(a.v*b.v),3) AS v FROM {W} a JOIN {W} b ON a.i0=b.i0 GROUP BY 1,2"),
    "affine": (lambda m, s: linalg.affine(m, weights(m), arrays.full(m.sparkSession, (3,), F.col("i0") * 1.0)).select("i0", "i1", r(F.col("v"), 4).alias("v")), f"SELECT i0, j AS i1, round(sum(v*(i1+j)/100)+j,4) AS v FROM {W}, range(3) x(j) GROUP BY 1,2"),
    "split_at": (lambda m, s: layout.split_at(m, 40, [5, -10], 1), f"SELECT i0, CASE WHEN i1<5 THEN i1 WHEN i1<30 THEN i1-5 ELSE i1-30 END AS i1, v, CAST(CASE WHEN i1<5 THEN 0 WHEN i1<30 THEN 1 ELSE 2 END AS BIGINT) AS part FROM {W}"),
    "array_split": (lambda m, s: layout.array_split(m, 40, 3, 1), f"SELECT i0, CASE WHEN i1<14 THEN i1 WHEN i1<27 THEN i1-14 ELSE i1-27 END AS i1, v, CAST(CASE WHEN i1<14 THEN 0 WHEN i1<27 THEN 1 ELSE 2 END AS BIGINT) AS part FROM {W}"),
    "swap_move_axes": (lambda m, s: layout.moveaxis(layout.swapaxes(layout.expand_dims(m, 2, 0), 3, 0, 2), 3, 0, 1), f"SELECT i0, i1, CAST(0 AS BIGINT) AS i2, v FROM {W}"),
    "broadcast_to": (lambda m, s: layout.broadcast_to(layout.ravel(m.filter("i0 = 0"), (1, 40)), (40,), (3, 40)), f"SELECT k AS i0, i1, v FROM {W}, range(3) x(k) WHERE i0 = 0"),
    "flip_all": (lambda m, s: layout.flip_all(m, s), f"SELECT {ROWS}-1-i0 AS i0, 39-i1 AS i1, v FROM {W}"),
    "roll_all": (lambda m, s: layout.roll_all(m, s, 17), f"SELECT ((e+17)%({ROWS}*40))//40 AS i0, ((e+17)%({ROWS}*40))%40 AS i1, v FROM {W}"),
    "sum_keepdims": (lambda m, s: m.groupBy("i0").agg(r(F.sum("v"), 4).alias("v")).select("i0", F.lit(0).cast("bigint").alias("i1"), "v"), f"SELECT i0, CAST(0 AS BIGINT) AS i1, round(sum(v),4) AS v FROM {W} GROUP BY 1"),
    "cumsum_axis": (lambda m, s: ordering.cumulative(m, "i0", "v", "run", block=64, lane=["i1"]).select("i0", "i1", r(F.col("run"), 3).alias("v")), f"SELECT i0, i1, round(sum(v) OVER (PARTITION BY i1 ORDER BY i0),3) AS v FROM {W}"),
    "sort_axis": (lambda m, s: ordering.sort(m, ["i1"], "i0", "v"), f"SELECT row_number() OVER (PARTITION BY i1 ORDER BY v)-1 AS i0, i1, v FROM {W}"),
    "norms": (lambda m, s: linalg.norms(m).select(*[r(F.col(c), 4).alias(c) for c in ("fro", "l1", "inf")]), f"SELECT round(sqrt(sum(v*v)),4) AS fro, (SELECT round(max(s),4) FROM (SELECT sum(abs(v)) s FROM {W} GROUP BY i1)) AS l1, (SELECT round(max(s),4) FROM (SELECT sum(abs(v)) s FROM {W} GROUP BY i0)) AS inf FROM {W}"),
    "atleast_3d": (lambda m, s: layout.atleast(m, 2, 3), f"SELECT i0, i1, CAST(0 AS BIGINT) AS i2, v FROM {W}"),
    "copyto_where": (lambda m, s: layout.copy_where(m, arrays.full(m.sparkSession, (40,), F.col("i0") * 1.0), (40,), s, layout.map_cells(m, lambda v: v > 100)), f"SELECT i0, i1, CASE WHEN v > 100 THEN i1 * 1.0 ELSE v END AS v FROM {W}"),
    "map_indexed": (lambda m, s: layout.map_indexed(layout.map_cells(m, lambda v: v * 2), 2, lambda i, j, v: r(v - i + j)), f"SELECT i0, i1, round(v * 2 - i0 + i1, 6) AS v FROM {W}"),
    "zip_map": (lambda m, s: layout.zip_map(arrays.full(m.sparkSession, (s[0], 1), F.col("i0") * 1.0), (s[0], 1), m, s, lambda x, y: r(x - y)), f"SELECT i0, i1, round(i0 - v, 6) AS v FROM {W}"),
    "select_nonzero": (lambda m, s: layout.reshape(m, s, (s[0], -1)).filter("v <> 0 and v > 250"), f"SELECT i0, i1, v FROM {W} WHERE v <> 0 AND v > 250"),
}
for _name, (_f, _sql) in WHOLE.items():
    QUERIES[_name] = lambda spark, sf, f=_f: f(*table_matrix(spark, sf))
    ORACLE[_name] = _sql


@query("WITH n AS (SELECT max(event_id)+1 AS n FROM events) SELECT n_nationkey, event_id, value AS v FROM nation, n JOIN events ON event_id = (((n_nationkey*37-50) % n)+n)%n")
def take_wrap(spark, sf):
    e = events(spark, sf)
    p = t(spark, sf, "nation").select("n_nationkey", (F.col("n_nationkey") * 37 - 50).alias("p"))
    return ordering.take(e, "event_id", p, "p", length(e), "wrap").select("n_nationkey", "event_id", "v")


@query("SELECT i AS i0, 5+3*i AS v FROM range(10) x(i)")
def arange(spark, sf):
    return arrays.arange(spark, 5, 33, 3)


@query("SELECT i AS i0, round(i*0.25,6) AS v FROM range(9) x(i)")
def linspace(spark, sf):
    return arrays.linspace(spark, 0.0, 2.0, 9).select("i0", r(F.col("v")).alias("v"))


@query("SELECT a AS i0, b AS i1, CASE WHEN a=b THEN 1.0 ELSE 0.0 END::DOUBLE AS v FROM range(4) x(a), range(6) y(b)")
def eye(spark, sf):
    return arrays.eye(spark, 4, 6)


@query("""WITH s AS (SELECT l_returnflag, l_quantity AS x, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity)-1 AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem),
g AS (SELECT l_returnflag, max(CASE WHEN k=floor(0.37*(n-1)) THEN x END) AS lower, max(CASE WHEN k=ceil(0.37*(n-1)) THEN x END) AS higher, max(CASE WHEN k=floor(0.37*(n-1)+0.5) THEN x END) AS nearest, max(0.37*(n-1)-floor(0.37*(n-1))) AS f FROM s GROUP BY 1)
SELECT l_returnflag, lower, higher, nearest, round(lower+(higher-lower)*f,6) AS linear, (lower+higher)/2 AS midpoint FROM g""")
def quantile_modes(spark, sf):
    return stats.quantiles(t(spark, sf, "lineitem"), "l_quantity", ["l_returnflag"], 0.37).withColumn("linear", r(F.col("linear")))


@query("""WITH m AS (SELECT l_returnflag, sum(l_quantity*l_extendedprice)/sum(l_quantity) AS wm FROM lineitem GROUP BY 1) SELECT l_returnflag, round(max(wm),4) AS wmean, round(sum(l_quantity*power(l_extendedprice-wm,2))/sum(l_quantity),1) AS wvar FROM lineitem JOIN m USING (l_returnflag) GROUP BY 1""")
def weighted_mean_var(spark, sf):
    return stats.weighted(t(spark, sf, "lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag"]).select("l_returnflag", r(F.col("wmean"), 4).alias("wmean"), r(F.col("wvar"), 1).alias("wvar"))


COLS = ["l_quantity", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(covar_samp({a},{b}),6)+0.0 AS v FROM lineitem" for a in COLS for b in COLS))
def cov_matrix(spark, sf):
    return stats.covariance_matrix(t(spark, sf, "lineitem"), COLS, 1).select("a", "b", r(F.col("v")).alias("v"))


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a},{b}),6)+0.0 AS v FROM lineitem" for a in COLS for b in COLS))
def corr_matrix(spark, sf):
    return stats.covariance_matrix(t(spark, sf, "lineitem"), COLS, correlation=True).select("a", "b", r(F.col("v")).alias("v"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE*x::DOUBLE))),6) AS norm FROM embeddings")
def vector_norm(spark, sf):
    return t(spark, sf, "embeddings").select("vec_id", r(F.sqrt(linalg.vector_dot("embedding", "embedding"))).alias("norm"))


@query("""SELECT c_custkey, round((c_acctbal-(SELECT avg(c_acctbal) FROM customer))/(SELECT stddev_pop(c_acctbal) FROM customer),6)+0.0 AS z FROM customer""")
def standard_scale(spark, sf):
    return ml.standard_scale(t(spark, sf, "customer"), ["c_acctbal"]).select("c_custkey", r(F.col("c_acctbal_scaled")).alias("z"))


@query("""SELECT c_custkey, round((c_acctbal-(SELECT min(c_acctbal) FROM customer))/(SELECT max(c_acctbal)-min(c_acctbal) FROM customer),6) AS z FROM customer""")
def minmax_scale(spark, sf):
    return ml.min_max_scale(t(spark, sf, "customer"), ["c_acctbal"]).select("c_custkey", r(F.col("c_acctbal_scaled")).alias("z"))


@query("SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment)-1 AS code FROM customer")
def label_encode(spark, sf):
    return ml.label_encode(t(spark, sf, "customer"), "c_mktsegment").select("c_custkey", "code")


@query("""SELECT n, accuracy, CASE WHEN tp+fp=0 THEN 0 ELSE round(tp/(tp+fp),6) END AS prec, round(tp/(tp+fn),6) AS recall, round(2*tp/(2*tp+fp+fn),6) AS f1 FROM (SELECT count(*) AS n, round(avg((quality=toxic)::INT),6) AS accuracy, sum(quality*toxic)::DOUBLE AS tp, sum((1-quality)*toxic)::DOUBLE AS fp, sum(quality*(1-toxic))::DOUBLE AS fn FROM labels)""")
def clf_report(spark, sf):
    d = ml.classification_report(t(spark, sf, "labels"), "quality", "toxic")
    return d.select("n", *[r(F.col(c)).alias(c) for c in ("accuracy", "prec", "recall", "f1")])


@query("SELECT a, p, count(doc_id) AS n FROM (VALUES (0),(1)) x(a) CROSS JOIN (VALUES (0),(1)) y(p) LEFT JOIN labels ON quality=a AND toxic=p GROUP BY 1,2")
def confusion(spark, sf):
    return ml.confusion_matrix(t(spark, sf, "labels"), "quality", "toxic")


@query("SELECT round(avg(-ln(CASE WHEN quality=1 THEN p ELSE 1-p END)),6) AS log_loss FROM (SELECT quality, 0.1+0.8*toxic AS p FROM labels)")
def log_loss(spark, sf):
    return ml.log_loss(t(spark, sf, "labels").withColumn("p", 0.1 + 0.8 * F.col("toxic")), "quality", "p").select(r(F.col("log_loss")).alias("log_loss"))


@query("SELECT round(avg(abs(d)),4) AS mae, round(avg(d*d),3) AS mse, round(1-avg(d*d)/var_pop(l_extendedprice),6) AS r2 FROM (SELECT l_extendedprice, l_extendedprice-1500*l_quantity AS d FROM lineitem)")
def regression_metrics(spark, sf):
    d = t(spark, sf, "lineitem").withColumn("p", 1500 * F.col("l_quantity"))
    return ml.regression_metrics(d, "l_extendedprice", "p").select(r(F.col("mae"), 4).alias("mae"), r(F.col("mse"), 3).alias("mse"), r(F.col("r2")).alias("r2"))


@query("""WITH c AS (SELECT count_if(value<=100)::DOUBLE AS l, count_if(value>100)::DOUBLE AS rr, count_if(value<=100 AND event_id%2=1)::DOUBLE AS l1, count_if(value>100 AND event_id%2=1)::DOUBLE AS r1 FROM events) SELECT round((l*(1-(l1/l)*(l1/l)-((l-l1)/l)*((l-l1)/l))+rr*(1-(r1/rr)*(r1/rr)-((rr-r1)/rr)*((rr-r1)/rr)))/(l+rr),6) AS gini FROM c""")
def gini_split(spark, sf):
    return ml.gini_split(events(spark, sf).withColumn("y", F.col("event_id") % 2), "v", "y", 100.0).select(r(F.col("gini")).alias("gini"))


@query("SELECT '(intercept)' AS term, round(regr_intercept(l_extendedprice,l_quantity),3) AS coefficient FROM lineitem UNION ALL SELECT 'l_quantity', round(regr_slope(l_extendedprice,l_quantity),3) FROM lineitem")
def linreg(spark, sf):
    return ml.linear_regression(t(spark, sf, "lineitem"), ["l_quantity"], "l_extendedprice").select("term", r(F.col("coefficient"), 3).alias("coefficient"))


@query("""WITH c AS (SELECT covar_pop(l_extendedprice,l_quantity)*count(*)/(var_pop(l_quantity)*count(*)+1000) AS w, avg(l_extendedprice) AS y, avg(l_quantity) AS x FROM lineitem) SELECT '(intercept)' AS term, round(y-w*x,3) AS coefficient FROM c UNION ALL SELECT 'l_quantity', round(w,3) FROM c""")
def ridge(spark, sf):
    return ml.linear_regression(t(spark, sf, "lineitem"), ["l_quantity"], "l_extendedprice", 1000.0).select("term", r(F.col("coefficient"), 3).alias("coefficient"))


@query("""WITH m AS (SELECT sum(w*x)/sum(w) AS mx, sum(w*y)/sum(w) AS my FROM (SELECT l_linenumber AS w, CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem)),
c AS (SELECT sum(l_linenumber*(l_quantity-mx)*(l_extendedprice-my))/(sum(l_linenumber*(l_quantity-mx)*(l_quantity-mx))+1000) AS b, any_value(mx) AS mx, any_value(my) AS my FROM lineitem, m)
SELECT '(intercept)' AS term, round(my-b*mx,3) AS coefficient FROM c UNION ALL SELECT 'l_quantity', round(b,3) FROM c""")
def ridge_weighted(spark, sf):
    model = estimators.RidgeRegression("l_orderkey", ["l_quantity"], "l_extendedprice", l2_regularization=1000.0).fit_weighted(t(spark, sf, "lineitem"), "l_linenumber").model
    return model.select("term", r(F.col("coefficient"), 3).alias("coefficient"))


DIST = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE-z[2]::DOUBLE)*(z[1]::DOUBLE-z[2]::DOUBLE)))"


@query(f"SELECT q, idx, rank, round(d,6) AS d FROM (SELECT a.vec_id AS q, b.vec_id AS idx, {DIST} AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY {DIST}, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0) WHERE rank <= 5")
def knn_search(spark, sf):
    e = t(spark, sf, "embeddings")
    return ml.knn_search(e, e.filter("vec_id % 100 = 0"), "vec_id", "embedding", 5).select("q", "idx", F.col("rank").cast("bigint").alias("rank"), r(F.col("d")).alias("d"))


@query("""WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding,1) AS k FROM embeddings), c AS (SELECT label, k, avg(v) AS m FROM x GROUP BY 1,2), d AS (SELECT x.vec_id, c.label, sum((x.v-c.m)*(x.v-c.m)) AS d FROM x JOIN c USING (k) GROUP BY 1,2) SELECT vec_id, arg_min(label, d) AS predicted FROM d GROUP BY 1""")
def centroid(spark, sf):
    e = t(spark, sf, "embeddings")
    return ml.nearest_centroid(e, "vec_id", "embedding", ml.centroids(e, "label", "embedding"))


@query("""WITH m AS (SELECT l_linestatus AS label, count(*)/(SELECT count(*) FROM lineitem) AS prior, avg(l_quantity) AS mq, var_pop(l_quantity)+1e-9 AS vq, avg(l_discount) AS md, var_pop(l_discount)+1e-9 AS vd FROM lineitem GROUP BY 1) SELECT label, round(prior,6) AS prior, round(mq,6) AS m_l_quantity, round(vq,6) AS v_l_quantity, round(md,6) AS m_l_discount, round(vd,6) AS v_l_discount FROM m""")
def gnb_fit(spark, sf):
    m = ml.gaussian_bayes(t(spark, sf, "lineitem"), "l_linestatus", ["l_quantity", "l_discount"])
    return m.select("label", *[r(F.col(c)).alias(c) for c in m.columns[1:]])


@query("""WITH c AS (SELECT p_size AS x, count_if(p_partkey%3=0) AS p, count_if(p_partkey%3<>0) AS n FROM part GROUP BY 1), w AS (SELECT x, lead(x) OVER (ORDER BY x) AS nx, sum(p) OVER (ORDER BY x) AS lp, sum(n) OVER (ORDER BY x) AS ln, sum(p) OVER () AS tp, sum(n) OVER () AS tn FROM c) SELECT 0.5*x+0.5*nx AS threshold, CAST(least(lp,ln)+least(tp-lp,tn-ln) AS BIGINT) AS errors FROM w WHERE nx IS NOT NULL ORDER BY errors, threshold LIMIT 1""")
def stump(spark, sf):
    return ml.decision_stump(t(spark, sf, "part").withColumn("y", (F.col("p_partkey") % 3 == 0).cast("int")), "p_size", "y").select("threshold", "errors")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(avg(value),6) AS mean, round(var_pop(value)+1e-7,3) AS var0 FROM events GROUP BY 1,2")
def windowed(spark, sf):
    return windowed_moments(t(spark, sf, "events"), "ts", "value", ["event_type"]).select("window_start", "event_type", "n", r(F.col("mean")).alias("mean"), r(F.col("var0") + 1e-7, 3).alias("var0"))


@query("SELECT count(*) AS n, count(*) AS keys, true AS in_range, 0.5 AS u, 0.0 AS z, 1.0 AS z2, 0.3 AS b, 4.5 AS i, 0.17 AS c0, 0.5 AS c1 FROM events")
def random_draws(spark, sf):
    """Draws of every event, as counts, ranges and moments; moments to within five standard errors of what they should be."""
    k = F.col("event_id")
    d = events(spark, sf).select(k, E.uniform(7, k).alias("u"), E.normal(7, k).alias("z"), E.randint(7, k, 0, 10).alias("i"), E.bernoulli(7, k, 0.3).cast("double").alias("b"), E.categorical(7, k, [1.0, 3.0, 2.0]).alias("c"))
    root = F.sqrt(F.count(F.lit(1)))
    near = lambda x, want, sd: F.when(F.abs(F.avg(x) - want) * root <= 5 * sd, want).otherwise(F.avg(x))
    share = lambda j: (F.col("c") == j).cast("double")
    ok = (F.col("u") >= 0) & (F.col("u") < 1) & F.col("i").between(0, 9) & F.col("c").between(0, 2)
    c0 = F.when(F.abs(F.avg(share(0)) - 1 / 6) * root <= 2, 0.17).otherwise(F.avg(share(0)))
    return d.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("u").alias("keys"), F.bool_and(ok).alias("in_range"), near("u", 0.5, 0.29).alias("u"), near("z", 0.0, 1.0).alias("z"), near(F.col("z") ** 2, 1.0, 1.5).alias("z2"), near("b", 0.3, 0.46).alias("b"), near("i", 4.5, 2.9).alias("i"), c0.alias("c0"), near(share(1), 0.5, 0.5).alias("c1"))


@query("WITH c AS (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1) SELECT c_mktsegment, CAST(k AS INTEGER) AS fold, n//5 + CASE WHEN k < n%5 THEN 1 ELSE 0 END AS rows FROM c, range(5) x(k)")
def stratified_folds(spark, sf):
    """Rows of each class in each fold."""
    return ml.fold(t(spark, sf, "customer"), "c_custkey", 5, strata=["c_mktsegment"]).groupBy("c_mktsegment", "fold").agg(F.count_distinct("c_custkey").alias("rows"))


KNN = f"SELECT q, idx, d, rank, y FROM (SELECT a.vec_id AS q, b.vec_id AS idx, b.label AS y, {DIST} AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY {DIST}, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0) WHERE rank <= 7"


@query(f"WITH n AS ({KNN}), v AS (SELECT q, y, count(*) AS w, sum(d) AS d FROM n GROUP BY 1,2), o AS (SELECT q, y, row_number() OVER (PARTITION BY q ORDER BY w DESC, d, y) AS p FROM v) SELECT q, y AS predicted FROM o WHERE p = 1")
def knn_classify(spark, sf):
    e = t(spark, sf, "embeddings")
    return ml.knn_classify(e, e.filter("vec_id % 100 = 0"), "vec_id", "embedding", "label", 7)


@query(f"WITH n AS ({KNN}), x AS (SELECT q, y, CASE WHEN min(d) OVER (PARTITION BY q) = 0 THEN (CASE WHEN d = 0 THEN 1.0 ELSE 0 END) ELSE 1/sqrt(d) END AS w FROM n) SELECT q, round(sum(w*y)/sum(w),6) AS predicted FROM x GROUP BY 1")
def knn_regress(spark, sf):
    e = t(spark, sf, "embeddings")
    return ml.knn_regress(e, e.filter("vec_id % 100 = 0"), "vec_id", "embedding", "label", 7, "distance").select("q", r(F.col("predicted")).alias("predicted"))


@query("""WITH RECURSIVE d AS (SELECT value/100 AS s, CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END AS y FROM events), w(k, a, b) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL SELECT k+1, a-0.5*ga, b-0.5*gb FROM (SELECT k, any_value(a) AS a, any_value(b) AS b, avg(1/(1+exp(-(a+b*s)))-y) AS ga, avg((1/(1+exp(-(a+b*s)))-y)*s) AS gb FROM w, d WHERE k < 25 GROUP BY k))
SELECT '(intercept)' AS term, round(a,6) AS coefficient, 25 AS iterations, false AS converged FROM w WHERE k = 25 UNION ALL SELECT 's', round(b,6), 25, false FROM w WHERE k = 25""")
def logistic(spark, sf):
    """Gradient descent of 25 steps; the result says that it has not converged."""
    d = events(spark, sf).select((F.col("v") / 100).alias("s"), (F.col("v") > 50).cast("int").alias("y"))
    model, steps, done = ml.logistic_regression(d, ["s"], "y", rate=0.5, iterations=25)
    return model.select("term", r(F.col("coefficient")).alias("coefficient"), F.lit(steps).alias("iterations"), F.lit(done).alias("converged"))


@query()
def perceptron(spark, sf):
    d = t(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") / 1000).alias("s"), (F.col("c_acctbal") > 4000).cast("int").alias("y"))
    return ml.perceptron(d, "c_custkey", ["s"], "y", iterations=50)


@query("SELECT 'l_quantity' AS term, round(sum(l_quantity*l_extendedprice)/sum(l_quantity*l_quantity),3) AS coefficient FROM lineitem")
def least_squares(spark, sf):
    x = linalg.least_squares(t(spark, sf, "lineitem"), ["l_quantity"], "l_extendedprice")
    return spark.createDataFrame([("l_quantity", round(float(x[0]), 3))], "term string, coefficient double")


@query("SELECT l_returnflag, round(covar_samp(l_quantity,l_extendedprice),4) AS cov FROM lineitem GROUP BY 1")
def covariance_lanes(spark, sf):
    return stats.covariance(t(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"], 1).select("l_returnflag", r(F.col("cov"), 4).alias("cov"))


@query("""WITH b AS (SELECT l_returnflag, l_quantity AS w, l_extendedprice AS x, l_discount AS y, sum(l_quantity*l_extendedprice) OVER p/sum(l_quantity) OVER p AS mx, sum(l_quantity*l_discount) OVER p/sum(l_quantity) OVER p AS my FROM lineitem WINDOW p AS (PARTITION BY l_returnflag))
SELECT l_returnflag, round(sum(w*(x-mx)*(y-my))/sum(w),4) AS wcov, round(sum(w*(x-mx)*(y-my))/sqrt(sum(w*(x-mx)*(x-mx))*sum(w*(y-my)*(y-my))),6) AS wcorr FROM b GROUP BY 1""")
def weighted_cov(spark, sf):
    d = stats.weighted_covariance(t(spark, sf, "lineitem"), "l_extendedprice", "l_discount", "l_quantity", ["l_returnflag"])
    return d.select("l_returnflag", r(F.col("wcov"), 4).alias("wcov"), r(F.col("wcorr")).alias("wcorr"))


@query("SELECT min(value) AS nanmin, max(value) AS nanmax FROM events WHERE event_id % 97 <> 0")
def nan_extremes(spark, sf):
    return stats.nan_extremes(events(spark, sf), "x")


@query("SELECT count(*) AS n, count(*) AS places, CAST(0 AS BIGINT) AS first, count(*)-1 AS last, true AS moved FROM events")
def permutation(spark, sf):
    p = ordering.shuffled_rank(events(spark, sf).select("event_id"), "event_id", 7, "position")
    return p.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("position").alias("places"), F.min("position").alias("first"), F.max("position").alias("last"), F.bool_or(F.col("position") != F.col("event_id")).alias("moved"))


@query("SELECT CAST(100 AS BIGINT) AS n, CAST(100 AS BIGINT) AS ids, CAST(100 AS BIGINT) AS known")
def choice(spark, sf):
    e = events(spark, sf).select("event_id")
    c = ordering.choice(e, "event_id", 100, 7).withColumn("_c", F.col("event_id"))
    return c.join(e, "event_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("_c").alias("ids"), F.count("event_id").alias("known"))


@query("SELECT count(*)*2 AS n, true AS again, true AS in_range FROM nation")
def choice_replaced(spark, sf):
    """Twice as many draws as rows: some row comes again."""
    e = t(spark, sf, "nation").select("n_nationkey")
    n = e.count()
    c = ordering.choice_with_replacement(e, "n_nationkey", 2 * n, 3)
    return c.agg(F.count_distinct("draw").alias("n"), (F.count_distinct("n_nationkey") < F.count(F.lit(1))).alias("again"), F.bool_and(F.col("n_nationkey").between(0, n - 1)).alias("in_range"))


@query("WITH c AS (SELECT count(*) AS n FROM customer) SELECT CAST(k AS INTEGER) AS fold, n//7 + CASE WHEN k < n%7 THEN 1 ELSE 0 END AS rows FROM c, range(7) x(k)")
def k_folds(spark, sf):
    return ml.k_fold(t(spark, sf, "customer").select("c_custkey"), "c_custkey", 7, 3).groupBy("fold").agg(F.count_distinct("c_custkey").alias("rows"))


@query("SELECT is_test, CASE WHEN is_test THEN CAST(floor(n*0.25+0.5) AS BIGINT) ELSE n-CAST(floor(n*0.25+0.5) AS BIGINT) END AS rows FROM (SELECT count(*) AS n FROM customer), (VALUES (true),(false)) x(is_test)")
def train_test(spark, sf):
    return ml.train_test_split(t(spark, sf, "customer").select("c_custkey"), "c_custkey", 0.25, 3).groupBy("is_test").agg(F.count_distinct("c_custkey").alias("rows"))


@query("SELECT c_mktsegment, is_test, CASE WHEN is_test THEN CAST(floor(n*0.25+0.5) AS BIGINT) ELSE n-CAST(floor(n*0.25+0.5) AS BIGINT) END AS rows FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1), (VALUES (true),(false)) x(is_test)")
def stratified_split(spark, sf):
    return ml.stratified_split(t(spark, sf, "customer"), "c_custkey", ["c_mktsegment"], 0.25, 3).groupBy("c_mktsegment", "is_test").agg(F.count_distinct("c_custkey").alias("rows"))


@query("SELECT p_partkey, CAST((p_size*9+200)%256 AS SMALLINT) AS add8, CAST(((p_size-40)%256+256)%256 AS SMALLINT) AS sub8, CAST((p_size*p_size*977)%65536 AS INTEGER) AS mul16, CAST((CAST(p_size-60 AS HUGEINT)+18446744073709551616)%18446744073709551616 AS VARCHAR) AS sub64 FROM part")
def ew_unsigned(spark, sf):
    p = F.col("p_size").cast("bigint")
    return t(spark, sf, "part").select("p_partkey", E.unsigned("+", p * 9, F.lit(200), 8).alias("add8"), E.unsigned("-", p, F.lit(40), 8).alias("sub8"), E.unsigned("*", p * p, F.lit(977), 16).alias("mul16"), E.unsigned("-", p, F.lit(60), 64).cast("string").alias("sub64"))


@query("SELECT p_partkey, (p_size % 2 <> 0) <> (p_size % 3 <> 0) AS x, p_size % 2 <> 0 AND p_size % 3 <> 0 AS a, p_size % 2 <> 0 OR p_size % 3 <> 0 AS o, p_size % 2 = 0 AS n, CAST(p_size AS DOUBLE) AS f, CAST(p_size AS VARCHAR) AS s, CASE WHEN p_size > 25 THEN -1 ELSE p_size END AS filled FROM part")
def ew_logic_cast(spark, sf):
    p = F.col("p_size")
    a, b = (p % 2).cast("double"), (p % 3).cast("double")
    return t(spark, sf, "part").select("p_partkey", E.logical_xor(a, b).alias("x"), (E.truth(a) & E.truth(b)).alias("a"), (E.truth(a) | E.truth(b)).alias("o"), (~E.truth(a)).alias("n"), p.cast("double").alias("f"), p.cast("string").alias("s"), F.when(p > 25, F.lit(-1)).otherwise(p).alias("filled"))


@query("SELECT event_type, round(exp(sum(ln(1+value*1e-6))),6) AS p FROM events GROUP BY 1")
def red_prod(spark, sf):
    return events(spark, sf).groupBy("event_type").agg(r(E.product(1 + F.col("v") * 1e-6)).alias("p"))


@query("SELECT event_type, event_id, CAST(CASE WHEN k < 5 THEN 0 WHEN k < 50 THEN 1 ELSE 2 END AS INTEGER) AS part FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS k FROM events)")
def argpartition(spark, sf):
    return ordering.argpartition(events(spark, sf), ["event_type"], "event_id", "v", [50, 5])


@query("SELECT p_partkey, dense_rank() OVER (ORDER BY p_size) - 1 AS inverse FROM part")
def unique_inverse(spark, sf):
    return ordering.unique_inverse(t(spark, sf, "part"), "p_partkey", "p_size")


@query("WITH m AS (SELECT regr_slope(l_extendedprice,l_quantity) AS w, regr_intercept(l_extendedprice,l_quantity) AS b FROM lineitem) SELECT l_orderkey, l_linenumber, round(b+w*l_quantity,3) AS predicted FROM lineitem, m")
def linreg_predict(spark, sf):
    d = t(spark, sf, "lineitem").withColumn("_id", F.struct("l_orderkey", "l_linenumber"))
    return ml.linear_predict(d, "_id", ["l_quantity"], ml.linear_regression(d, ["l_quantity"], "l_extendedprice")).select("_id.l_orderkey", "_id.l_linenumber", r(F.col("predicted"), 3).alias("predicted"))


@query("SELECT c_custkey, c_acctbal FROM customer")
def scaler_inverse(spark, sf):
    d = t(spark, sf, "customer").select("c_custkey", "c_acctbal")
    s, m = ml.Scaler.standard(d, ["c_acctbal"]), ml.Scaler.min_max(d, ["c_acctbal"])
    return m.inverse(m.transform(s.inverse(s.transform(d)))).select("c_custkey", r(F.col("c_acctbal"), 2).alias("c_acctbal"))


@query("SELECT c_custkey, c_mktsegment AS value FROM customer")
def label_round_trip(spark, sf):
    d = t(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return ml.label_decode(ml.label_encode(d, "c_mktsegment"), "code", ml.label_codes(d, "c_mktsegment")).select("c_custkey", "value")


BAYES = "log(prior) - 0.5*ln(2*pi()*vq) - (l_quantity-mq)*(l_quantity-mq)/(2*vq) - 0.5*ln(2*pi()*vd) - (l_discount-md)*(l_discount-md)/(2*vd)".replace("log(prior)", "ln(prior)")


@query(f"""WITH m AS (SELECT l_linestatus AS label, count(*)/(SELECT count(*) FROM lineitem) AS prior, avg(l_quantity) AS mq, var_pop(l_quantity)+1e-9 AS vq, avg(l_discount) AS md, var_pop(l_discount)+1e-9 AS vd FROM lineitem GROUP BY 1),
s AS (SELECT l_orderkey, l_linenumber, label, {BAYES} AS s FROM lineitem, m) SELECT l_orderkey, l_linenumber, arg_max(label, s) AS predicted FROM s GROUP BY 1,2""")
def gnb_predict(spark, sf):
    d, f = t(spark, sf, "lineitem").withColumn("_id", F.struct("l_orderkey", "l_linenumber")), ["l_quantity", "l_discount"]
    return ml.bayes_predict(d, "_id", f, ml.gaussian_bayes(d, "l_linestatus", f)).select("_id.l_orderkey", "_id.l_linenumber", "predicted")


# ---- batches of small matrices: a 4 x 4 matrix per part; factors are multiplied together again, solutions put back


def batch_of_matrices(spark, sf):
    """A diagonally dominant symmetric 4 x 4 matrix per part (i, j from the part's attributes)."""
    p = t(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice").crossJoin(arrays.grid(spark, (4, 4)))  # 16 cells for each
    v = F.when(F.col("i0") == F.col("i1"), F.col("p_retailprice") + F.col("i0")).otherwise(F.col("p_size") / (1.0 + F.col("i0") + F.col("i1")))
    return p.select(F.col("p_partkey").alias("batch"), "i0", "i1", v.alias("v"))


def right_sides(spark, sf):
    p = t(spark, sf, "part").select("p_partkey", "p_size").crossJoin(arrays.grid(spark, (4, 1)))  # 4 cells for each
    return p.select(F.col("p_partkey").alias("batch"), "i0", "i1", (F.col("p_size") + F.col("i0")).cast("double").alias("v"))


def low_rank(spark, sf):
    """Every third part's matrix is an outer product."""
    return batch_of_matrices(spark, sf).withColumn("v", F.when(F.col("batch") % 3 == 0, ((F.col("i0") + 1) * (F.col("i1") + 1)).cast("double")).otherwise(F.col("v")))


def cells(d: DataFrame, digits: int = 6) -> DataFrame:
    return d.select("batch", "i0", "i1", r(F.col("v"), digits).alias("v"))


A = "(SELECT p_partkey AS batch, i AS i0, j AS i1, CASE WHEN i=j THEN p_retailprice+i ELSE p_size/(1.0+i+j) END AS v FROM part, range(4) a(i), range(4) b(j))"
B = "(SELECT p_partkey AS batch, i AS i0, CAST(0 AS BIGINT) AS i1, CAST(p_size+i AS DOUBLE) AS v FROM part, range(4) a(i))"
A_CELLS, B_CELLS = (f"SELECT batch, i0, i1, round(v,6) AS v FROM {x}" for x in (A, B))
UNIT = f"SELECT batch, i0, i1, CASE WHEN i0=i1 THEN 1.0 ELSE 0.0 END AS v FROM {A}"
WIDE = "SELECT batch, " + ", ".join(f"max(v) FILTER (i0={i} AND i1={j}) AS a{i}{j}" for i in range(4) for j in range(4)) + f" FROM {A} GROUP BY 1"


def _leibniz() -> str:
    """The 4 x 4 determinant as a sum over permutations."""
    terms = []
    for p in itertools.permutations(range(4)):
        odd = sum(p[i] > p[j] for i in range(4) for j in range(i + 1, 4)) % 2
        terms.append(("-" if odd else "+") + "*".join(f"a{i}{p[i]}" for i in range(4)))
    return "".join(terms)


mul, tr, run_kernel = linalg.batched_matmul, linalg.batched_transpose, linalg.batched
lower_part = lambda m: m.filter("i1 <= i0")
#: name: (query of the matrices m and right sides b, SQL)
BATCHED = {
    "matmul": (lambda m, b: cells(mul(m, m), 3), f"SELECT a.batch, a.i0, b.i1, round(sum(a.v*b.v),3) AS v FROM {A} a JOIN {A} b ON a.batch=b.batch AND a.i1=b.i0 GROUP BY 1,2,3"),
    "transpose": (lambda m, b: tr(b), f"SELECT batch, i1 AS i0, i0 AS i1, v FROM {B}"),
    "dot": (lambda m, b: linalg.batched_dot(b, b), f"SELECT batch, sum(v*v) AS v FROM {B} GROUP BY 1"),
    "diag": (lambda m, b: linalg.batched_diag(b), f"SELECT batch, i AS i0, j AS i1, CASE WHEN i=j THEN CAST(p_size+i AS DOUBLE) ELSE 0.0 END AS v FROM (SELECT p_partkey AS batch, p_size FROM part), range(4) a(i), range(4) b(j)"),
    "solve": (lambda m, b: cells(mul(m, run_kernel(m, "solve", b))), B_CELLS),
    "solve_transpose": (lambda m, b: cells(mul(tr(m), run_kernel(m, "solve_transpose", b))), B_CELLS),
    "solve_spd": (lambda m, b: cells(mul(m, run_kernel(m, "solve_spd", b))), B_CELLS),
    "conjugate_gradient": (lambda m, b: cells(mul(m, run_kernel(m, "conjugate_gradient", b))), B_CELLS),
    "lower_solve": (lambda m, b: cells(mul(lower_part(m), run_kernel(lower_part(m), "lower_solve", b))), B_CELLS),
    "upper_solve": (lambda m, b: cells(mul(tr(lower_part(m)), run_kernel(tr(lower_part(m)), "upper_solve", b))), B_CELLS),
    "inverse": (lambda m, b: cells(mul(m, run_kernel(m, "inverse"))), UNIT),
    "lu": (lambda m, b: cells(mul(tr(run_kernel(m, "lu_p")), mul(run_kernel(m, "lu_l"), run_kernel(m, "lu_u")))), A_CELLS),
    "cholesky": (lambda m, b: cells(mul(run_kernel(m, "cholesky"), tr(run_kernel(m, "cholesky")))), A_CELLS),
    "qr": (lambda m, b: cells(mul(run_kernel(m, "qr_q"), run_kernel(m, "qr_r"))), A_CELLS),
    "qr_orthogonal": (lambda m, b: cells(mul(tr(run_kernel(m, "qr_q")), run_kernel(m, "qr_q"))), UNIT),
    "eigen": (lambda m, b: cells(mul(mul(run_kernel(m, "eigenvectors"), linalg.batched_diag(run_kernel(m, "eigenvalues").drop("i1"))), tr(run_kernel(m, "eigenvectors")))), A_CELLS),
    "eigenvalues": (lambda m, b: run_kernel(m, "eigenvalues").groupBy("batch").agg(r(F.sum("v"), 4).alias("total"), r(F.sum(F.col("v") ** 2), 2).alias("squares")), f"SELECT batch, round(sum(v) FILTER (i0=i1),4) AS total, round(sum(v*v),2) AS squares FROM {A} GROUP BY 1"),
    "det": (lambda m, b: run_kernel(m, "det").select("batch", r(F.col("v") / 1e9).alias("det")), f"SELECT batch, round(({_leibniz()})/1e9,6) AS det FROM ({WIDE})"),
    "slogdet": (lambda m, b: run_kernel(m, "slogdet").groupBy("batch").agg(r(F.max(F.when(F.col("i1") == 0, F.col("v")))).alias("sign"), r(F.max(F.when(F.col("i1") == 1, F.col("v")))).alias("log")), f"SELECT batch, 1.0 AS sign, round(ln({_leibniz()}),6) AS log FROM ({WIDE})"),
    "condition": (lambda m, b: run_kernel(m.filter("i0 < 2 and i1 < 2"), "condition_number").select("batch", r(F.col("v")).alias("c")), f"SELECT batch, round(((a00+a11)/2+d)/((a00+a11)/2-d),6) AS c FROM (SELECT *, sqrt((a00-a11)*(a00-a11)/4+a01*a01) AS d FROM ({WIDE}))"),
}
for _k, (_f, _sql) in BATCHED.items():
    QUERIES[f"batched_{_k}"] = lambda spark, sf, f=_f: f(batch_of_matrices(spark, sf), right_sides(spark, sf))
    ORACLE[f"batched_{_k}"] = _sql


@query("SELECT p_partkey AS batch, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 4 END AS rank FROM part")
def batched_rank(spark, sf):
    return linalg.batched(low_rank(spark, sf), "matrix_rank").select("batch", F.col("v").cast("int").alias("rank"))
