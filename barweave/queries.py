"""One query for each transform, target and helper, with its DuckDB SQL.

The series are `events` by user in the order of time, with nulls, non-positive values and constant stretches
put in by rule on both sides; bars are `events` by type and half-hour. Doubles are rounded on both sides.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import diagnostics, is_inf, is_none, is_valid, linear_slope, pairwise, rolling, shift, std_dev
from .operators import *  # noqa: F403
from .plans import FeaturePipeline, TargetPipeline
from .plans.pipeline import window_order
from .sources import bars_from_ticks, stream_series
from .streaming import drain

KEY, ORDER = ["user_id"], ["ts", "event_id"]
SERIES = """
    event_id, user_id, event_type, ts,
    CASE WHEN event_id % 97 = 0 THEN NULL ELSE value END AS x,
    CASE WHEN event_id % 89 = 0 THEN NULL ELSE CAST(event_id * 37 % 101 AS DOUBLE) END AS y,
    CASE WHEN event_id % 2000 < 900 THEN 5.0 WHEN event_id % 83 = 0 THEN NULL ELSE CAST(event_id * 53 % 7 AS DOUBLE) END AS z,
    CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN 0.0 WHEN event_id % 17 = 0 THEN -value ELSE value / 500 END AS u
"""
BARS_SQL = """
    SELECT event_type, time_bucket(INTERVAL 30 MINUTE, ts) AS time, arg_min(value, (ts, event_id)) AS open, max(value) AS high,
        min(value) AS low, arg_max(value, (ts, event_id)) AS close, CAST(count(value) AS DOUBLE) AS volume
    FROM events WHERE value IS NOT NULL GROUP BY ALL
"""
#: Bars with some that are no valid bar: high below low, or a null.
SPOILT = """
    event_type, time, volume, low, close,
    CASE WHEN minute(time) = 0 AND hour(time) % 7 = 3 THEN low - 1 ELSE high END AS high,
    CASE WHEN minute(time) = 30 AND hour(time) % 11 = 5 THEN NULL ELSE open END AS open
"""
ROWS = "(PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {} AND {})"
DIGITS = 6


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*[c.strip() for c in _split(SERIES)])


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = bars_from_ticks(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", "ts", "value", "30 minutes", "event_id")
    return made.selectExpr(*[c.strip() for c in _split(SPOILT)])


def _split(columns: str) -> list[str]:
    out, depth, part = [], 0, ""
    for ch in columns:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += ch
    return [*out, part]


def rounded(df: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
    return df.select(*keep, *[(F.round(n, DIGITS) + F.lit(0.0)).alias(n) for n in names])


def rounded_sql(names: list[str], keep: list[str], source: str) -> str:
    return f"SELECT {', '.join(keep)}, {', '.join(f'round({n}, {DIGITS}) + 0.0 AS {n}' for n in names)} FROM ({source})"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def feature(name: str, specs, columns: list[str], sql: str, target: bool = False) -> None:
    """Register a pipeline over the user series; sql: output name to expression, or a whole query over s."""
    specs = specs if isinstance(specs, list) else [specs]
    pipeline = (TargetPipeline if target else FeaturePipeline)(specs, columns)
    outputs = pipeline.output_names()

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = pipeline.transform(series(spark, sf_dir), KEY, ORDER)
        return rounded(made, outputs, ["event_id", "user_id"])

    QUERIES[name] = run
    body = sql if sql.lstrip().upper().startswith(("SELECT", "WITH")) else f"SELECT event_id, user_id, {sql} FROM s"
    ORACLE_SQL[name] = f"WITH RECURSIVE s AS (SELECT {SERIES} FROM events), out AS ({body}) " + rounded_sql(outputs, ["event_id", "user_id"], "SELECT * FROM out")


def over(w: int, first: str | None = None, last: str = "CURRENT ROW") -> str:
    return ROWS.format(first or f"{w - 1} PRECEDING", last)


def whole(cond: str, w: int, value: str, frame: str | None = None) -> str:
    frame = frame or over(w)
    return f"CASE WHEN count(CASE WHEN {cond} THEN 1 END) OVER {frame} = {w} THEN {value} END"


def lagged(col: str, n: int) -> str:
    return f"lag({col}, {n}) OVER (PARTITION BY user_id ORDER BY ts, event_id)"


W = 5
feature("sma", Sma("x", W, ["o"]), ["x"], whole("x IS NOT NULL", W, f"avg(x) OVER {over(W)}") + " AS o")
feature("mma", Mma("x", 6, ["o"]), ["x"], whole("x IS NOT NULL", 6, f"median(x) OVER {over(6)}") + " AS o")
feature("simple_return", SimpleReturn("u", 2, ["o"]), ["u"], f"SELECT event_id, user_id, CASE WHEN p > 0 THEN (u - p) / p END AS o FROM (SELECT *, {lagged('u', 2)} AS p FROM s)")
feature("log_return", LogReturn("u", 2, ["o"]), ["u"], f"SELECT event_id, user_id, CASE WHEN p > 0 AND u > 0 THEN ln(u / p) END AS o FROM (SELECT *, {lagged('u', 2)} AS p FROM s)")
EMA_SQL = f"""
    SELECT event_id, user_id, o FROM (
    WITH RECURSIVE a AS (SELECT *, count(*) FILTER (x IS NULL) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seg FROM s),
    b AS (SELECT *, CASE WHEN x IS NOT NULL THEN count(x) OVER (PARTITION BY user_id, seg ORDER BY ts, event_id) END AS n,
        avg(x) OVER (PARTITION BY user_id, seg ORDER BY ts, event_id ROWS BETWEEN {W - 1} PRECEDING AND CURRENT ROW) AS m FROM a),
    r AS (SELECT event_id, user_id, seg, n, m AS o FROM b WHERE n = {W}
        UNION ALL SELECT b.event_id, b.user_id, b.seg, b.n, r.o + 2.0::DOUBLE / {W + 1} * (b.x - r.o) FROM r JOIN b ON b.user_id = r.user_id AND b.seg = r.seg AND b.n = r.n + 1)
    SELECT s.event_id, s.user_id, r.o FROM s LEFT JOIN r USING (event_id))
"""
feature("ema", Ema("x", W, ["o"]), ["x"], EMA_SQL)
KAMA_SQL = f"""
    SELECT event_id, user_id, o FROM (
    WITH RECURSIVE a AS (SELECT *, {lagged('x', 1)} AS p, {lagged('x', W)} AS f, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM s),
    b AS (SELECT *, CASE WHEN count(x) OVER {over(W + 1)} = {W + 1} THEN sum(abs(x - p)) OVER {over(W)} END AS path FROM a),
    c AS (SELECT *, CASE WHEN path IS NOT NULL THEN power((CASE WHEN path = 0 THEN 0 ELSE abs(x - f) / path END) * (2.0::DOUBLE / 3 - 2.0::DOUBLE / 31) + 2.0::DOUBLE / 31, 2) END AS sc FROM b),
    d AS (SELECT *, lag(sc) OVER (PARTITION BY user_id ORDER BY rn) IS NULL AS fresh FROM c),
    r AS (SELECT event_id, user_id, rn, p + sc * (x - p) AS o FROM d WHERE sc IS NOT NULL AND fresh
        UNION ALL SELECT d.event_id, d.user_id, d.rn, r.o + d.sc * (d.x - r.o) FROM r JOIN d ON d.user_id = r.user_id AND d.rn = r.rn + 1 AND d.sc IS NOT NULL)
    SELECT s.event_id, s.user_id, r.o FROM s LEFT JOIN r USING (event_id))
"""
feature("kama", Kama("x", W, ["o"]), ["x"], KAMA_SQL)


def regression_sql(a: str, b: str, w: int, frame: str, slope: str, fit: str) -> str:
    have = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END"
    sums = [f"regr_{k}({b}, {a}) OVER {frame} AS {k}" for k in ("sxx", "syy", "sxy")]
    return (
        f"SELECT event_id, user_id, CASE WHEN n = {w} AND sxx > 1e-9 THEN sxy / sxx END AS {slope}, CASE WHEN n = {w} AND sxx > 1e-9 AND syy > 1e-9 THEN sxy * sxy / (sxx * syy) END AS {fit}"
        f" FROM (SELECT *, count({have}) OVER {frame} AS n, {', '.join(sums)} FROM s)"
    )


feature("linear_slope", LinearSlope(["y", "z"], W, ["slope", "fit"]), ["y", "z"], regression_sql("y", "z", W, over(W), "slope", "fit"))
for moment, w in (("skewness", 6), ("kurtosis", 7)):
    spec = (Skewness if moment == "skewness" else Kurtosis)("z", w, ["o"])
    feature(moment, spec, ["z"], f"CASE WHEN count(z) OVER {over(w)} = {w} AND max(z) OVER {over(w)} > min(z) OVER {over(w)} THEN {moment}(z) OVER {over(w)} END AS o")


def pearson_sql(a: str, b: str, w: int, source: str = "s") -> str:
    sums = [f"regr_{k}({b}, {a}) OVER {over(w)} AS {k}" for k in ("sxx", "syy", "sxy")]
    return f"SELECT event_id, user_id, CASE WHEN n = {w} AND sxx > 1e-9 AND syy > 1e-9 THEN sxy / sqrt(sxx * syy) END AS o FROM (SELECT *, count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END) OVER {over(w)} AS n, {', '.join(sums)} FROM {source})"


FRAMES = """WITH t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM {source}),
    f AS (SELECT a.event_id, b.{a} AS a, b.{b} AS b, b.rn FROM t a JOIN t b ON a.user_id = b.user_id AND b.rn BETWEEN a.rn - {w} + 1 AND a.rn WHERE b.{a} IS NOT NULL AND b.{b} IS NOT NULL),
    g AS (SELECT event_id FROM f GROUP BY 1 HAVING count(*) = {w})"""


def spearman_sql(a: str, b: str, w: int) -> str:
    ranks = ", ".join(f"rank() OVER (PARTITION BY event_id ORDER BY {c}) + (count(*) OVER (PARTITION BY event_id, {c}) - 1) / 2.0::DOUBLE AS r{c}" for c in "ab")
    return f"""SELECT event_id, user_id, o FROM ({FRAMES.format(a=a, b=b, w=w, source='s')},
        h AS (SELECT event_id, {ranks} FROM f SEMI JOIN g USING (event_id)),
        v AS (SELECT event_id, CASE WHEN regr_sxx(rb, ra) > 1e-9 AND regr_syy(rb, ra) > 1e-9 THEN regr_sxy(rb, ra) / sqrt(regr_sxx(rb, ra) * regr_syy(rb, ra)) END AS o FROM h GROUP BY 1)
        SELECT s.event_id, s.user_id, o FROM s LEFT JOIN v USING (event_id))"""


def kendall_sql(a: str, b: str, w: int) -> str:
    return f"""SELECT event_id, user_id, o FROM ({FRAMES.format(a=a, b=b, w=w, source='s')},
        h AS (SELECT p.event_id, sign(q.a - p.a) AS i, sign(q.b - p.b) AS j FROM f p JOIN f q ON p.event_id = q.event_id AND p.rn < q.rn SEMI JOIN g ON p.event_id = g.event_id),
        v AS (SELECT event_id, CASE WHEN sum(i * i) > 0 AND sum(j * j) > 0 THEN sum(i * j) / sqrt((sum(i * i) * sum(j * j))::DOUBLE) END AS o FROM h GROUP BY 1)
        SELECT s.event_id, s.user_id, o FROM s LEFT JOIN v USING (event_id))"""


feature("correlation_pearson", Correlation(["y", "z"], 8, ["o"]), ["y", "z"], pearson_sql("y", "z", 8))
feature("correlation_spearman", Correlation(["y", "z"], 8, ["o"], "spearman"), ["y", "z"], spearman_sql("y", "z", 8))
feature("correlation_kendall", Correlation(["y", "z"], 8, ["o"], "kendall"), ["y", "z"], kendall_sql("y", "z", 8))
LATE = f"(SELECT *, {lagged('z', 2)} AS l FROM s)"
feature("autocorrelation", AutoCorrelation("z", 8, ["o"], lag=2), ["z"], pearson_sql("z", "l", 8, LATE))
ENTROPY_SQL = f"""
    SELECT event_id, user_id, o FROM ({FRAMES.format(a='z', b='z', w=10, source='s')},
        h AS (SELECT f.event_id, a, min(a) OVER (PARTITION BY event_id) AS lo, max(a) OVER (PARTITION BY event_id) AS hi FROM f SEMI JOIN g USING (event_id)),
        k AS (SELECT event_id, CASE WHEN hi = lo THEN 0 ELSE least(floor((a - lo) / (hi - lo) * 4), 3) END AS bin, count(*) / 10.0::DOUBLE AS p FROM h GROUP BY 1, 2),
        v AS (SELECT event_id, -sum(p * ln(p)) / ln(4.0) AS o FROM k GROUP BY 1)
        SELECT s.event_id, s.user_id, o FROM s LEFT JOIN v USING (event_id))
"""
feature("shannon_entropy", ShannonEntropy("z", 10, ["o"], bins=4), ["z"], ENTROPY_SQL)


def table_sql(regression: str) -> str:
    from .operators.stationarity import P_VALUES

    return "[" + ", ".join(f"{p!r}::DOUBLE" for p in P_VALUES[regression]) + "]"


ADF_SQL = f"""
    SELECT event_id, user_id, stat, p FROM (
    WITH a AS (SELECT *, {lagged('x', 1)} AS l, x - {lagged('x', 1)} AS d FROM s),
    b AS (SELECT *, count(x) OVER {over(20)} AS n, regr_sxx(d, l) OVER {over(19)} AS sxx, regr_syy(d, l) OVER {over(19)} AS syy, regr_sxy(d, l) OVER {over(19)} AS sxy FROM a),
    c AS (SELECT event_id, user_id, CASE WHEN n = 20 AND sxx > 1e-9 AND syy - sxy * sxy / sxx > 0 THEN sxy / sxx / sqrt((syy - sxy * sxy / sxx) / 17 / sxx) END AS stat FROM b),
    e AS (SELECT *, {table_sql('c')} AS t, least(43, greatest(0, floor((stat + 6) / 0.2::DOUBLE)))::BIGINT AS i FROM c)
    SELECT event_id, user_id, stat, CASE WHEN stat <= -6 THEN t[1] WHEN stat >= 2.8 THEN t[45] ELSE t[i + 1] + (stat - (-6 + 0.2::DOUBLE * i)) / 0.2::DOUBLE * (t[i + 2] - t[i + 1]) END AS p FROM e)
"""
feature("adf", Adf("x", 20, ["stat", "p"], lags=0), ["x"], ADF_SQL)
for op, spec, sql in (
    ("add", Add(["x", "y"], ["o"]), "x + y"),
    ("subtract", Subtract(["x", "y"], ["o"]), "x - y"),
    ("multiply", Multiply(["x", "y"], ["o"]), "x * y"),
    ("divide", Divide(["x", "u"], ["o"]), "CASE WHEN u <> 0 THEN x / u END"),
    ("reciprocal", Reciprocal("u", ["o"]), "CASE WHEN u <> 0 THEN 1 / u END"),
    ("log", Log("u", ["o"]), "CASE WHEN u > 0 THEN ln(u) END"),
    ("neg_log", NegLog("u", ["o"]), "CASE WHEN u > 0 THEN -ln(u) END"),
    ("logit", Logit("u", ["o"]), "CASE WHEN u > 0 AND u < 1 THEN ln(u / (1 - u)) END"),
    ("fixed_zscore", FixedZScore("x", ["o"], mean=3.0, std=2.0), "(x - 3) / 2"),
):
    feature(op, spec, spec.input_names(), sql + " AS o")
feature("rolling_zscore", RollingZScore("z", W, ["o"]), ["z"], f"CASE WHEN count(z) OVER {over(W)} = {W} AND max(z) OVER {over(W)} > min(z) OVER {over(W)} THEN (z - avg(z) OVER {over(W)}) / stddev_samp(z) OVER {over(W)} END AS o")
feature("future_return", FutureReturn("u", 3, ["o"]), ["u"], "SELECT event_id, user_id, CASE WHEN u > 0 THEN (f - u) / u END AS o FROM (SELECT *, lead(u, 3) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f FROM s)", True)
AHEAD = over(4, "1 FOLLOWING", "4 FOLLOWING")
feature("future_ctc_volatility", FutureCTCVolatility("u", 4), ["u"], f"SELECT event_id, user_id, CASE WHEN count(r) OVER {AHEAD} = 4 THEN stddev_samp(r) OVER {AHEAD} END AS u_future_ctc_vol_4 FROM (SELECT *, CASE WHEN u > 0 AND p > 0 THEN ln(u / p) END AS r FROM (SELECT *, {lagged('u', 1)} AS p FROM s))", True)
feature("future_linear_slope", FutureLinearSlope(["y", "z"], 4, ["slope", "fit"]), ["y", "z"], regression_sql("y", "z", 4, over(4, "CURRENT ROW", "3 FOLLOWING"), "slope", "fit"), True)
CHAIN = [Sma("x", 3, ["m"]), LogReturn("m", 1, ["r"]), RollingZScore("r", 4, ["zr"]), Subtract(["x", "m"], ["gap"])]
feature(
    "feature_pipeline", CHAIN, ["x"],
    f"SELECT event_id, user_id, m, gap, r, CASE WHEN count(r) OVER {over(4)} = 4 AND max(r) OVER {over(4)} > min(r) OVER {over(4)} THEN (r - avg(r) OVER {over(4)}) / stddev_samp(r) OVER {over(4)} END AS zr"
    f" FROM (SELECT *, x - m AS gap, CASE WHEN m > 0 AND {lagged('m', 1)} > 0 THEN ln(m / {lagged('m', 1)}) END AS r FROM (SELECT *, {whole('x IS NOT NULL', 3, f'avg(x) OVER {over(3)}')} AS m FROM s))",
)
feature(
    "target_pipeline", [FutureReturn("x", 1, ["f1"]), FutureReturn("x", 2, ["f2"])], ["x"],
    "SELECT event_id, user_id, CASE WHEN x > 0 THEN (a - x) / x END AS f1, CASE WHEN x > 0 THEN (b - x) / x END AS f2 FROM (SELECT *, lead(x, 1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, lead(x, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM s)", True,
)


#: Series by event type, long enough for windows of 200, with few nulls.
LONG = """
    event_id, event_type, ts,
    CASE WHEN event_id % 1499 = 0 THEN NULL ELSE value END AS x,
    CASE WHEN event_id % 1999 = 0 THEN NULL ELSE CAST(event_id * 37 % 101 AS DOUBLE) END AS y,
    CASE WHEN event_id % 4000 < 900 THEN 5.0 ELSE CAST(event_id * 53 % 7 AS DOUBLE) END AS z,
    CASE WHEN event_id % 1733 = 0 THEN 0.0 ELSE value / 500 END AS u
"""


def long_feature(name: str, spec, sql: str, target: bool = False) -> None:
    """Register a transform over the long series; sql as for `feature`."""
    columns = spec.input_names()
    pipeline = (TargetPipeline if target else FeaturePipeline)([spec], columns)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*[c.strip() for c in _split(LONG)])
        return rounded(pipeline.transform(rows, "event_type", ORDER), pipeline.output_names(), ["event_id", "event_type"])

    QUERIES[name] = run
    body = (sql if sql.lstrip().upper().startswith(("SELECT", "WITH")) else f"SELECT event_id, user_id, {sql} FROM s").replace("user_id", "event_type")
    ORACLE_SQL[name] = f"WITH s AS (SELECT {LONG} FROM events), out AS ({body}) " + rounded_sql(pipeline.output_names(), ["event_id", "event_type"], "SELECT * FROM out")


def moment_sql(moment: str, w: int) -> str:
    return f"CASE WHEN count(z) OVER {over(w)} = {w} AND max(z) OVER {over(w)} > min(z) OVER {over(w)} THEN {moment}(z) OVER {over(w)} END AS o"


def adf_trend_sql(w: int) -> str:
    """Level and difference without their trends, then one regressor; the degrees of freedom count all three."""
    f = over(w - 1)
    parts = ", ".join(f"regr_{k}({b}, {a}) OVER {f} AS {n}" for n, k, b, a in (("ll", "sxx", "d", "l"), ("dd", "syy", "d", "l"), ("ld", "sxy", "d", "l"), ("tt", "sxx", "d", "rn"), ("td", "sxy", "d", "rn"), ("tl", "sxy", "l", "rn")))
    return f"""
        SELECT event_id, user_id, stat, p FROM (
        WITH a AS (SELECT *, {lagged('x', 1)} AS l, x - {lagged('x', 1)} AS d, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::DOUBLE AS rn FROM s),
        b AS (SELECT *, count(x) OVER {over(w)} AS n, {parts} FROM a),
        c AS (SELECT *, ll - tl * tl / tt AS xx, dd - td * td / tt AS yy, ld - tl * td / tt AS xy FROM b),
        e AS (SELECT event_id, user_id, CASE WHEN n = {w} AND xx > 1e-9 AND yy - xy * xy / xx > 1e-9 THEN xy / xx / sqrt((yy - xy * xy / xx) / {w - 4} / xx) END AS stat FROM c),
        g AS (SELECT *, {table_sql('ct')} AS t, least(43, greatest(0, floor((stat + 6) / 0.2::DOUBLE)))::BIGINT AS i FROM e)
        SELECT event_id, user_id, stat, CASE WHEN stat <= -6 THEN t[1] WHEN stat >= 2.8 THEN t[45] ELSE t[i + 1] + (stat - (-6 + 0.2::DOUBLE * i)) / 0.2::DOUBLE * (t[i + 2] - t[i + 1]) END AS p FROM g)
    """


def entropy_sql(w: int, bins: int, scale: str) -> str:
    return f"""
        SELECT event_id, user_id, o FROM ({FRAMES.format(a='z', b='z', w=w, source='s')},
        h AS (SELECT f.event_id, a, min(a) OVER (PARTITION BY event_id) AS lo, max(a) OVER (PARTITION BY event_id) AS hi FROM f SEMI JOIN g USING (event_id)),
        k AS (SELECT event_id, CASE WHEN hi = lo THEN 0 ELSE least(floor((a - lo) / (hi - lo) * {bins}), {bins - 1}) END AS bin, count(*) / {w}.0::DOUBLE AS p FROM h GROUP BY 1, 2),
        v AS (SELECT event_id, -sum(p * ln(p)) / {scale} AS o FROM k GROUP BY 1)
        SELECT s.event_id, s.user_id, o FROM s LEFT JOIN v USING (event_id))
    """


long_feature("sma_200", Sma("x", 200, ["o"]), whole("x IS NOT NULL", 200, f"avg(x) OVER {over(200)}") + " AS o")
long_feature("mma_200", Mma("x", 200, ["o"]), whole("x IS NOT NULL", 200, f"median(x) OVER {over(200)}") + " AS o")
long_feature("linear_slope_200", LinearSlope(["y", "z"], 200, ["slope", "fit"]), regression_sql("y", "z", 200, over(200), "slope", "fit"))
long_feature("skewness_200", Skewness("z", 200, ["o"]), moment_sql("skewness", 200))
long_feature("kurtosis_200", Kurtosis("z", 200, ["o"]), moment_sql("kurtosis", 200))
long_feature("rolling_zscore_200", RollingZScore("z", 200, ["o"]), f"CASE WHEN count(z) OVER {over(200)} = 200 AND max(z) OVER {over(200)} > min(z) OVER {over(200)} THEN (z - avg(z) OVER {over(200)}) / stddev_samp(z) OVER {over(200)} END AS o")
long_feature("correlation_pearson_200", Correlation(["y", "z"], 200, ["o"]), pearson_sql("y", "z", 200))
long_feature("correlation_spearman_60", Correlation(["y", "z"], 60, ["o"], "spearman"), spearman_sql("y", "z", 60))
long_feature("correlation_kendall_30", Correlation(["y", "z"], 30, ["o"], "kendall"), kendall_sql("y", "z", 30))
long_feature("autocorrelation_200", AutoCorrelation("z", 200, ["o"]), pearson_sql("z", "l", 200, f"(SELECT *, {lagged('z', 1)} AS l FROM s)"))
LATE_CTE = f"SELECT * FROM (WITH s0 AS (SELECT * FROM s), s AS (SELECT *, {lagged('z', 2)} AS l FROM s0) "
long_feature("autocorrelation_spearman", AutoCorrelation("z", 20, ["o"], lag=2, method="spearman"), LATE_CTE + spearman_sql("z", "l", 20) + ")")
long_feature("autocorrelation_kendall", AutoCorrelation("z", 20, ["o"], lag=2, method="kendall"), LATE_CTE + kendall_sql("z", "l", 20) + ")")
long_feature("shannon_entropy_default", ShannonEntropy("z", 60, ["o"]), entropy_sql(60, 7, "ln(7.0)"))
long_feature("shannon_entropy_plain", ShannonEntropy("z", 60, ["o"], bins=5, normalize=False), entropy_sql(60, 5, "1"))
long_feature("adf_trend_200", Adf("x", 200, ["stat", "p"], lags=0, regression="ct"), adf_trend_sql(200))
long_feature("future_linear_slope_200", FutureLinearSlope(["y", "z"], 200, ["slope", "fit"]), regression_sql("y", "z", 200, over(200, "CURRENT ROW", "199 FOLLOWING"), "slope", "fit"), True)
FAR = over(200, "1 FOLLOWING", "200 FOLLOWING")
long_feature("future_ctc_volatility_200", FutureCTCVolatility("u", 200), f"SELECT event_id, user_id, CASE WHEN count(r) OVER {FAR} = 200 THEN stddev_samp(r) OVER {FAR} END AS u_future_ctc_vol_200 FROM (SELECT *, CASE WHEN u > 0 AND p > 0 THEN ln(u / p) END AS r FROM (SELECT *, {lagged('u', 1)} AS p FROM s))", True)


def volatility(name: str, spec, term: str, scale: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = FeaturePipeline([spec], ["high", "low", "open", "close"]).transform(bars(spark, sf_dir), "event_type", "time")
        return rounded(made, ["o"], ["event_type", "time"])

    QUERIES[name] = run
    frame = "(PARTITION BY event_type ORDER BY time ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
    ORACLE_SQL[name] = rounded_sql(["o"], ["event_type", "time"], f"SELECT event_type, time, CASE WHEN n = 5 AND m >= 0 THEN sqrt(m / {scale}) END AS o FROM (SELECT *, count(t) OVER {frame} AS n, avg(t) OVER {frame} AS m FROM (SELECT *, {term} AS t FROM (SELECT {SPOILT} FROM ({BARS_SQL}))))")


volatility("parkinson_volatility", ParkinsonVolatility(["high", "low"], 5, ["o"]), "CASE WHEN high > 0 AND low > 0 AND high >= low THEN power(ln(high / low), 2) END", "(4 * ln(2.0))")
volatility("rogers_satchell_volatility", RogersSatchellVolatility(["high", "low", "open", "close"], 5, ["o"]), "CASE WHEN high > 0 AND low > 0 AND open > 0 AND close > 0 AND high >= low THEN ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) END", "1")


def query_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = bars_from_ticks(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", "ts", "value", "30 minutes", "event_id")
    return rounded(made, ["open", "high", "low", "close", "volume"], ["event_type", "time"])


def query_scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fit_standard_scaler(series(spark, sf_dir), "x", KEY), ["mean", "std"], KEY)


def query_scaler_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fit_standard_scaler(series(spark, sf_dir), "x")
    return rounded(spark.createDataFrame([tuple(found)], "mean double, std double"), ["mean", "std"], [])


DIRTY = "CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN CAST('inf' AS DOUBLE) WHEN event_id % 1009 = 8 THEN CAST('nan' AS DOUBLE) ELSE value END"


def query_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id", f"{DIRTY} AS v")
    return rounded(diagnostics(df, ["v"], KEY), ["v_null_rate", "v_valid_rate"], [*KEY, "v_has_inf", "v_has_nan"])


def query_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", f"{DIRTY} AS v")
    v = F.col("v")
    return df.select("event_id", is_none(v).alias("missing"), is_inf(v).alias("infinite"), is_valid(v).alias("valid"))


def query_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shift both ways, a pairwise expression and a rolling aggregate of one's own."""
    w = window_order(KEY, ORDER)
    x, y = F.col("x"), F.col("y")
    made = series(spark, sf_dir).select(
        "event_id", shift(x, 2, w).alias("before"), shift(x, -2, w).alias("after"), pairwise(x, y, lambda a, b: a * b - a).alias("pair"),
        rolling(lambda f: F.max(x).over(f) - F.min(x).over(f), x, w, -3, 0).alias("spread"),
    )
    return rounded(made, ["before", "after", "pair", "spread"], ["event_id"])


def query_std_dev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series(spark, sf_dir).groupBy("user_id").agg(std_dev(F.col("u")).alias("u_std"), std_dev(F.col("event_id").cast("double")).alias("id_std")), ["u_std", "id_std"], KEY)


def query_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slope kernel over a running frame."""
    frame = window_order(KEY, ORDER).rowsBetween(-9, 0)
    slope, _ = linear_slope(F.col("event_id").cast("double"), F.coalesce("z", F.lit(0.0)))
    return rounded(series(spark, sf_dir).select("event_id", slope(frame).alias("slope")), ["slope"], ["event_id"])


def query_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chained pipeline with rows dealt by range."""
    p = FeaturePipeline(CHAIN, ["x"])
    return rounded(p.transform_spread(series(spark, sf_dir), KEY, ORDER), p.output_names(), ["event_id", "user_id"])


MIXED = [Ema("x", 5, ["e"]), Subtract(["x", "e"], ["gap"]), Sma("x", 5, ["m"])]


def query_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window plans and the Arrow pass in one pipeline."""
    return rounded(FeaturePipeline(MIXED, ["x"]).transform(series(spark, sf_dir), KEY, ORDER), ["m", "e", "gap"], ["event_id", "user_id"])


def query_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same features on a stream of the table's files."""
    path = f"{sf_dir}/events.parquet"
    source = stream_series(spark, f"{path}*", spark.read.parquet(path).schema).selectExpr(*[c.strip() for c in _split(SERIES)])
    made = FeaturePipeline(MIXED, ["x"]).transform_stream(source, KEY, ORDER)
    folder = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="barweave-")
    return rounded(drain(made, f"{folder}/stream-{uuid.uuid4().hex}"), ["m", "e", "gap"], ["event_id", "user_id"])


MIXED_SQL = f"WITH RECURSIVE s AS (SELECT {SERIES} FROM events), e AS ({EMA_SQL}), m AS (SELECT event_id, x, {whole('x IS NOT NULL', 5, f'avg(x) OVER {over(5)}')} AS m FROM s) SELECT event_id, user_id, round(m, 6) + 0.0 AS m, round(o, 6) + 0.0 AS e, round(x - o, 6) + 0.0 AS gap FROM e JOIN m USING (event_id)"
QUERIES |= {"tools": query_tools, "std_dev": query_std_dev, "slope": query_slope, "mixed_pipeline": query_mixed, "stream_pipeline": query_stream, "spread_pipeline": query_spread}
ORACLE_SQL |= {
    "tools": f"WITH s AS (SELECT {SERIES} FROM events) " + rounded_sql(["before", "after", "pair", "spread"], ["event_id"], f"SELECT event_id, {lagged('x', 2)} AS before, lead(x, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after, x * y - x AS pair, {whole('x IS NOT NULL', 4, f'max(x) OVER {over(4)} - min(x) OVER {over(4)}')} AS spread FROM s"),
    "std_dev": rounded_sql(["u_std", "id_std"], KEY, f"SELECT user_id, CASE WHEN count(u) = count(*) AND count(u) > 1 THEN stddev_samp(u) END AS u_std, CASE WHEN count(*) > 1 THEN stddev_samp(event_id::DOUBLE) END AS id_std FROM (SELECT {SERIES} FROM events) GROUP BY 1"),
    "slope": rounded_sql(["slope"], ["event_id"], f"SELECT event_id, CASE WHEN regr_sxx(coalesce(z, 0), event_id) OVER {over(10)} > 0 THEN regr_sxy(coalesce(z, 0), event_id) OVER {over(10)} / regr_sxx(coalesce(z, 0), event_id) OVER {over(10)} END AS slope FROM (SELECT {SERIES} FROM events)"),
    "mixed_pipeline": MIXED_SQL,
    "stream_pipeline": MIXED_SQL,
    "spread_pipeline": ORACLE_SQL["feature_pipeline"],
}
QUERIES |= {"bars": query_bars, "fit_standard_scaler": query_scaler, "fit_standard_scaler_whole": query_scaler_whole, "diagnostics": query_diagnostics, "checks": query_checks}
FIT = "SELECT {} CASE WHEN count(x) >= 2 AND stddev_samp(x) > 0 THEN avg(x) END AS mean, CASE WHEN count(x) >= 2 AND stddev_samp(x) > 0 THEN stddev_samp(x) END AS std FROM (SELECT " + SERIES + " FROM events) {}"
ORACLE_SQL |= {
    "bars": rounded_sql(["open", "high", "low", "close", "volume"], ["event_type", "time"], BARS_SQL),
    "fit_standard_scaler": rounded_sql(["mean", "std"], KEY, FIT.format("user_id,", "GROUP BY user_id")),
    "fit_standard_scaler_whole": "SELECT round(mean, 6) + 0.0 AS mean, round(std, 6) + 0.0 AS std FROM (" + FIT.format("", "") + ")",
    "diagnostics": rounded_sql(["v_null_rate", "v_valid_rate"], [*KEY, "v_has_inf", "v_has_nan"], f"SELECT user_id, avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0 END) AS v_null_rate, avg(CASE WHEN v IS NOT NULL AND isfinite(v) THEN 1.0 ELSE 0 END) AS v_valid_rate, coalesce(bool_or(isinf(v)), false) AS v_has_inf, coalesce(bool_or(isnan(v)), false) AS v_has_nan FROM (SELECT user_id, {DIRTY} AS v FROM events) GROUP BY 1"),
    "checks": f"SELECT event_id, v IS NULL AS missing, coalesce(isinf(v), false) AS infinite, coalesce(isfinite(v), false) AS valid FROM (SELECT event_id, {DIRTY} AS v FROM events)",
}
