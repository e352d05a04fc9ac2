"""A query for each operator over the driver's tables, and the same in SQL where SQL can express it.

How the tables host the data: an embedding is a trace (shot = label, rcv = vec_id) or a column of a grid (ix = vec_id,
iz = place in it); even vec_ids are observed, the next odd one is the synthetic. Doubles are rounded to six places, as
engines add in different orders.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelake.functions import carried, rock, spectrum, timefreq, trace
from wavelake.operators import adjoint, generate, grid, imaging, metrics, misfit, model, optimise, spline
from wavelake.sources import gathers
from wavelake.sources.store import children, fresh_path
from wavelake.sources.views import acquisition, grid_cells, moment_tensors, pair_rows, samples, source_wavelets, survey_summary, table, trace_rows, unmatched
from wavelake.streaming import chunks
from wavelake.streaming.shots import windowed_energy

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def add(name: str, build: Query, sql: str | None = None, keys: str = "", doubles: str = "", digits: int = DIGITS) -> None:
    """Register a query; the SQL's doubles are rounded as the query's are."""
    QUERIES[name] = lambda spark, d: rounded(build(spark, d), digits)
    if sql:
        columns = [*keys.split(), *(f"round({c}, {digits}) + 0.0 AS {c}" for c in doubles.split())]
        ORACLE_SQL[name] = f"SELECT {', '.join(columns)} FROM ({sql}) AS q_"


# ---------------------------------------------------------------- views

TRACES = "(SELECT CAST(label AS BIGINT) AS shot, vec_id AS rcv, CAST(i - 1 AS BIGINT) AS it, CAST(embedding[i] AS DOUBLE) AS amp FROM embeddings, range(1, 65) AS r(i))"
PAIRS = "(SELECT CAST(o.label AS BIGINT) AS shot, o.vec_id AS rcv, CAST(i - 1 AS BIGINT) AS it, CAST(o.embedding[i] AS DOUBLE) AS obs, CAST(s.embedding[i] AS DOUBLE) AS syn FROM embeddings o JOIN embeddings s ON s.vec_id = o.vec_id + 1, range(1, 65) AS r(i) WHERE o.vec_id % 2 = 0)"
CELLS = "(SELECT CAST(i - 1 AS BIGINT) AS iz, vec_id AS ix, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) AS r(i))"
BY_TRACE = "PARTITION BY shot, rcv"
ALONG = "PARTITION BY shot, rcv ORDER BY it"
X, Z = "(PARTITION BY iz ORDER BY ix)", "(PARTITION BY ix ORDER BY iz)"


def own_traces(spark: SparkSession, d: str) -> DataFrame:
    return trace_rows(table(spark, d, "embeddings"))


def own_samples(spark: SparkSession, d: str) -> DataFrame:
    return samples(own_traces(spark, d), "amp")


def own_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pair_rows(own_traces(spark, d))


def pair_samples(spark: SparkSession, d: str) -> DataFrame:
    return samples(own_pairs(spark, d), "obs", "syn")


def own_cells(spark: SparkSession, d: str) -> DataFrame:
    return grid_cells(table(spark, d, "embeddings"))


def on_pairs(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(pair_samples(spark, d))


def on_rows(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(own_pairs(spark, d))


def on_samples(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(own_samples(spark, d))


def on_cells(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(own_cells(spark, d))


# ---------------------------------------------------------------- misfits

SMOOTH = "CASE WHEN abs(obs - syn) < 1 THEN (obs - syn) * (obs - syn) / 2 ELSE abs(obs - syn) - 0.5 END"
L1 = f"SELECT shot, sum(abs(obs - syn)) AS misfit FROM {PAIRS} GROUP BY shot"
L2 = f"SELECT shot, sum(r) AS misfit FROM (SELECT shot, rcv, sqrt(sum((obs - syn) * (obs - syn))) AS r FROM {PAIRS} GROUP BY shot, rcv) GROUP BY shot"
add("misfit_panel", on_pairs(misfit.panel), f"""
    SELECT shot, sum(a) AS l1, sum(sqrt(q)) AS l2, sum(s) AS smooth_l1, sum(t) AS student_t, count(*) AS n_traces FROM (
        SELECT shot, rcv, sum(abs(obs - syn)) AS a, sum((obs - syn) * (obs - syn)) AS q, sum({SMOOTH}) AS s, sum(ln(1 + (obs - syn) * (obs - syn))) AS t
        FROM {PAIRS} GROUP BY shot, rcv) GROUP BY shot""", "shot n_traces", "l1 l2 smooth_l1 student_t")  # fmt: skip
add("misfit_l1", on_pairs(misfit.l1), L1, "shot", "misfit")
add("misfit_l2", on_pairs(misfit.l2), L2, "shot", "misfit")
add("misfit_smooth_l1", on_pairs(misfit.smooth_l1), f"SELECT shot, sum({SMOOTH}) AS misfit FROM {PAIRS} GROUP BY shot", "shot", "misfit")
add("misfit_student_t", on_pairs(lambda p: misfit.student_t(p, 2.0, 0.5, 0.01)), f"SELECT shot, sum(1.5 * ln(1 + (obs - syn) * (obs - syn) / 0.5) * 0.01) AS misfit FROM {PAIRS} GROUP BY shot", "shot", "misfit")
add("misfit_weighted_l1_l2", on_pairs(lambda p: misfit.weighted(misfit.l2(p), misfit.l1(p), 3, 10)), f"""
    SELECT a.shot, a.misfit / (1 + exp(2.0)) + b.misfit * (1 - 1 / (1 + exp(2.0))) AS misfit FROM ({L2}) a JOIN ({L1}) b USING (shot)""", "shot", "misfit")  # fmt: skip
UNIT = f"(SELECT shot, rcv, obs / nullif(sqrt(sum(obs * obs) OVER ({BY_TRACE})), 0) AS a, syn / nullif(sqrt(sum(syn * syn) OVER ({BY_TRACE})), 0) AS b FROM {PAIRS})"
add("misfit_global_correlation", on_pairs(misfit.global_correlation), f"""
    SELECT shot, sum(coalesce(c, 0)) AS misfit FROM (SELECT shot, rcv, -avg(a * b) / (sqrt(var_samp(a) * var_samp(b)) + 1e-8) AS c FROM {UNIT} GROUP BY shot, rcv) GROUP BY shot""", "shot", "misfit", 5)  # fmt: skip
SHAPES = {"linear": "{x} - least({x}_least, 0)", "abs": "abs({x})", "square": "{x} * {x}", "exp": "exp({x})", "softplus": "ln(1 + exp({x}))"}


def integral_sql(kind: str, p: int) -> str:
    shape = lambda x: (SHAPES[kind].replace("{x}_least", "least_").replace("{x}", x)) + " + 1e-18"
    return f"""
        WITH p AS (SELECT *, (SELECT min(least(obs, syn)) FROM {PAIRS}) AS least_ FROM {PAIRS}),
        s AS (SELECT shot, rcv, it, {shape("obs")} AS o, {shape("syn")} AS s FROM p),
        n AS (SELECT shot, rcv, it, o / (sum(o) OVER ({BY_TRACE}) + 1e-18) AS o, s / (sum(s) OVER ({BY_TRACE}) + 1e-18) AS s FROM s),
        c AS (SELECT shot, sum(o) OVER ({ALONG}) - sum(s) OVER ({ALONG}) AS d FROM n)
        SELECT shot, sum(pow(abs(d), {p})) AS misfit FROM c GROUP BY shot"""


for kind_ in SHAPES:
    add(f"misfit_integral_{kind_}", on_pairs(lambda p, k=kind_: misfit.integral(p, 2, k)), integral_sql(kind_, 2), "shot", "misfit")
add("misfit_wasserstein1_running_sums", on_pairs(lambda p: misfit.integral(p, 1, "square")), integral_sql("square", 1), "shot", "misfit")
LAGS = f"""(
    SELECT shot, rcv, CAST(min(lag) AS DOUBLE) AS lag FROM (
        SELECT *, max(c) OVER ({BY_TRACE}) AS top FROM (
            SELECT o.shot, o.rcv, s.it - o.it AS lag, abs(sum(o.obs * s.syn)) AS c FROM {PAIRS} o JOIN {PAIRS} s ON o.rcv = s.rcv GROUP BY o.shot, o.rcv, s.it - o.it))
    WHERE c >= top - 1e-12 GROUP BY shot, rcv)"""
add("travel_time_lags", on_rows(misfit.travel_times), f"SELECT * FROM {LAGS}", "shot rcv", "lag")
add("misfit_travel_time", on_rows(misfit.travel_time), f"SELECT shot, sum(lag * lag / 2) AS misfit FROM {LAGS} GROUP BY shot", "shot", "misfit")
add("adjoint_travel_time", lambda s, d: misfit.adjoint_travel_time(pair_samples(s, d), misfit.travel_times(own_pairs(s, d))), f"""
    WITH g AS (SELECT shot, rcv, it, coalesce((lead(syn) OVER ({ALONG}) - lag(syn) OVER ({ALONG})) / 2, 0) AS d FROM {PAIRS}),
    n AS (SELECT *, sum(d * d) OVER ({BY_TRACE}) AS power FROM g)
    SELECT n.shot, n.rcv, n.it, d / CASE WHEN power = 0 THEN 1 ELSE power END * lag AS adjoint FROM n JOIN {LAGS} l ON n.rcv = l.rcv""", "shot rcv it", "adjoint")  # fmt: skip
# a low-pass is a convolution with its impulse response around the padded trace: 64 + 512 samples, cut at 6 of 100 Hz, order 3
RESPONSE = "(SELECT d, sum(cos(2 * pi() * m * d / 576) * CASE WHEN m = 288 THEN 0 ELSE 1 / (1 + pow(tan(pi() * m / 576) / tan(pi() * 6 / 100), 6)) END) / 576 AS k FROM range(-63, 64) AS a(d), range(0, 576) AS b(m) GROUP BY d)"
PASSED = f"(SELECT x.shot, x.rcv, y.it, sum(x.{{v}} * k) AS {{v}} FROM {{rows}} x, (SELECT CAST(i AS BIGINT) AS it FROM range(0, 64) AS t(i)) y, {RESPONSE} r WHERE r.d = y.it - x.it GROUP BY x.shot, x.rcv, y.it)"
add("trace_low_pass", lambda s, d: samples(spectrum.low_pass(own_traces(s, d), 6, 100), "amp"), PASSED.format(v="amp", rows=TRACES), "shot rcv it", "amp")
add("misfit_l2_low_pass", lambda s, d: misfit.l2(samples(spectrum.low_pass(own_pairs(s, d), 6, 100, columns=("obs", "syn")), "obs", "syn")), f"""
    SELECT shot, sum(r) AS misfit FROM (SELECT o.shot, o.rcv, sqrt(sum((obs - syn) * (obs - syn))) AS r FROM {PASSED.format(v="obs", rows=PAIRS)} o
        JOIN {PASSED.format(v="syn", rows=PAIRS)} s USING (rcv, it) GROUP BY o.shot, o.rcv) GROUP BY shot""", "shot", "misfit")  # fmt: skip
add("elastic_pressure", on_pairs(lambda p: p.select("shot", "rcv", "it", rock.pressure("obs", "syn").alias("p"))), f"SELECT shot, rcv, it, -(obs + syn) AS p FROM {PAIRS}", "shot rcv it", "p")
# the imaginary part of an analytic signal is a convolution with the sines of all positive frequencies of length 127
HILBERT = "(SELECT d, sum(2.0 / 127 * sin(2 * pi() * k * d / 127)) AS h FROM range(-63, 64) AS a(d), range(1, 64) AS b(k) GROUP BY d)"
ANALYTIC = f"(SELECT p.shot, p.rcv, p.it, p.{{v}} AS re, sum(q.{{v}} * h) AS im FROM {PAIRS} p JOIN {PAIRS} q ON p.rcv = q.rcv JOIN {HILBERT} ON d = p.it - q.it GROUP BY p.shot, p.rcv, p.it, p.{{v}})"
ENVELOPE = f"""
    SELECT o.shot, sum(0.5 * pow(pow(s.re * s.re + s.im * s.im, 0.75) - pow(o.re * o.re + o.im * o.im, 0.75), 2)) AS misfit FROM {ANALYTIC.format(v="obs")} o JOIN {ANALYTIC.format(v="syn")} s USING (rcv, it) GROUP BY o.shot"""
UNWRAPPED = f"""(SELECT shot, rcv, it, phase + sum(CASE WHEN abs(d) < pi() THEN 0 ELSE d + pi() - floor((d + pi()) / (2 * pi())) * 2 * pi() - pi() - d END) OVER ({ALONG}) AS phase
    FROM (SELECT *, coalesce(phase - lag(phase) OVER ({ALONG}), 0) AS d FROM (SELECT shot, rcv, it, atan2(im, re) AS phase FROM {ANALYTIC})))"""
BLENDED = "SELECT a.shot, a.misfit / (1 + exp(2.0)) + b.misfit * (1 - 1 / (1 + exp(2.0))) AS misfit FROM ({a}) a JOIN ({b}) b USING (shot)"
CORRELATION = f"SELECT shot, sum(coalesce(c, 0)) AS misfit FROM (SELECT shot, rcv, -avg(a * b) / (sqrt(var_samp(a) * var_samp(b)) + 1e-8) AS c FROM {UNIT} GROUP BY shot, rcv) GROUP BY shot"
# soft warping by anti-diagonals: a row is a place (i, k - i) of a pair of traces, with its value and that of the same i one diagonal before
SOFT_DTW = f"""
    WITH RECURSIVE x AS (SELECT shot, rcv, 0 AS kind, it + 1 AS i, obs AS a, syn AS b FROM {PAIRS} UNION ALL SELECT shot, rcv, 1, it + 1, obs, obs FROM {PAIRS} UNION ALL SELECT shot, rcv, 2, it + 1, syn, syn FROM {PAIRS}),
    m AS (SELECT x.rcv, x.kind, x.i, y.i AS j, pow(x.a - y.b, 2) AS cost FROM x JOIN x y ON x.rcv = y.rcv AND x.kind = y.kind),
    d AS (SELECT rcv, kind, CAST(1 AS BIGINT) AS k, CAST(i AS BIGINT) AS i, CAST('Infinity' AS DOUBLE) AS now, CASE WHEN i = 0 THEN 0.0 ELSE CAST('Infinity' AS DOUBLE) END AS before FROM (SELECT DISTINCT rcv, kind FROM x), range(65) AS r(i)
        UNION ALL
        SELECT rcv, kind, k, i, CASE WHEN least_ = CAST('Infinity' AS DOUBLE) OR cost IS NULL THEN CAST('Infinity' AS DOUBLE) ELSE cost + least_ - ln(exp(least_ - u) + exp(least_ - v) + exp(least_ - w)) END, v
        FROM (SELECT *, least(u, v, w) AS least_ FROM (
            SELECT d.rcv, d.kind, d.k + 1 AS k, d.i, m.cost, d.now AS v, coalesce(lag(d.now) OVER q, CAST('Infinity' AS DOUBLE)) AS w, coalesce(lag(d.before) OVER q, CAST('Infinity' AS DOUBLE)) AS u
            FROM d LEFT JOIN m ON m.rcv = d.rcv AND m.kind = d.kind AND m.i = d.i AND m.j = d.k + 1 - d.i WHERE d.k < 128 WINDOW q AS (PARTITION BY d.rcv, d.kind ORDER BY d.i)))),
    e AS (SELECT rcv, sum(CASE kind WHEN 0 THEN now ELSE -now / 2 END) AS v FROM d WHERE k = 128 AND i = 64 GROUP BY rcv)
    SELECT shot, sum(v) AS misfit FROM e JOIN (SELECT DISTINCT shot, rcv FROM x) USING (rcv) GROUP BY shot"""
add("misfit_envelope", on_rows(misfit.envelope), ENVELOPE, "shot", "misfit")
add("misfit_phase", on_rows(lambda p: misfit.envelope(p, phase=True)), f"SELECT o.shot, sum(0.5 * pow(s.phase - o.phase, 2)) AS misfit FROM {UNWRAPPED.format(v='obs')} o JOIN {UNWRAPPED.format(v='syn')} s USING (rcv, it) GROUP BY o.shot", "shot", "misfit")
add("misfit_envelope_correlation", lambda s, d: misfit.weighted(misfit.global_correlation(pair_samples(s, d)), misfit.envelope(own_pairs(s, d)), 3, 10), BLENDED.format(a=CORRELATION, b=ENVELOPE), "shot", "misfit", 5)
add("misfit_soft_dtw", on_rows(misfit.soft_dtw), SOFT_DTW, "shot", "misfit")
add("misfit_soft_dtw_correlation", lambda s, d: misfit.weighted(misfit.global_correlation(pair_samples(s, d)), misfit.soft_dtw(own_pairs(s, d)), 3, 10), BLENDED.format(a=CORRELATION, b=SOFT_DTW), "shot", "misfit", 5)
add("misfit_sinkhorn", on_rows(misfit.sinkhorn))
add("misfit_wasserstein2", on_rows(misfit.wasserstein), f"""
    WITH c AS (SELECT shot, rcv, it, sum(obs * obs + 1e-18) OVER ({ALONG}) / sum(obs * obs + 1e-18) OVER ({BY_TRACE}) AS o, sum(syn * syn + 1e-18) OVER ({ALONG}) / sum(syn * syn + 1e-18) OVER ({BY_TRACE}) AS s FROM {PAIRS}),
    u AS (SELECT shot, rcv, o AS q, 1 AS a, 0 AS b FROM c UNION ALL SELECT shot, rcv, s, 0, 1 FROM c),
    w AS (SELECT *, coalesce(q - lag(q) OVER z, q) AS width, sum(a) OVER z - a AS i, sum(b) OVER z - b AS j FROM u WINDOW z AS (PARTITION BY rcv ORDER BY q, b ROWS UNBOUNDED PRECEDING))
    SELECT shot, sum(width * pow(least(i, 63) - least(j, 63), 2)) AS misfit FROM w GROUP BY shot""", "shot", "misfit")  # fmt: skip
# p = 1 on unit times is the sum of the running sums' differences
add("misfit_wasserstein1", on_rows(lambda p: misfit.wasserstein(p, 1)), integral_sql("square", 1), "shot", "misfit")
SHIFTS = "(SELECT vec_id AS shot, CAST(vec_id * 37 % 201 - 100 AS BIGINT) AS shift FROM embeddings)"
shifts_ = lambda s, d: own_traces(s, d).select(F.col("rcv").alias("shot"), (F.col("rcv") * 37 % 201 - 100).alias("shift"))
add("ricker_shift_sweep", lambda s, d: misfit.panel(generate.shift_sweep(shifts_(s, d))).drop("n_traces"), f"""
    WITH t AS (SELECT shot, ((i - 330) % 1000 + 1000) % 1000 * 0.003 - 0.5 AS a, ((i - 330 - shift) % 1000 + 1000) % 1000 * 0.003 - 0.5 AS b FROM {SHIFTS}, range(1000) AS r(i)),
    w AS (SELECT shot, CAST(pow(pi() * 6, 2) AS DOUBLE) AS tau, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b FROM t),
    p AS (SELECT shot, 0 AS rcv, (1 - 2 * tau * a * a) * exp(-tau * a * a) AS obs, (1 - 2 * tau * b * b) * exp(-tau * b * b) AS syn FROM w)
    SELECT shot, sum(abs(obs - syn)) AS l1, sqrt(sum((obs - syn) * (obs - syn))) AS l2, sum({SMOOTH}) AS smooth_l1, sum(ln(1 + (obs - syn) * (obs - syn))) AS student_t FROM p GROUP BY shot""", "shot", "l1 l2 smooth_l1 student_t")  # fmt: skip
add("unmatched_traces", lambda s, d: unmatched(own_traces(s, d).where("rcv % 3 > 0"), own_traces(s, d).where("rcv % 5 > 0")), """
    SELECT CAST(label AS BIGINT) AS shot, vec_id AS rcv, CASE WHEN vec_id % 3 = 0 THEN 'observed' ELSE 'synthetic' END AS missing FROM embeddings WHERE (vec_id % 3 = 0) <> (vec_id % 5 = 0)""", "shot rcv missing")  # fmt: skip

# ---------------------------------------------------------------- traces

W = trace
for name_, build_, sql_ in (
    ("peak_normalised", lambda: W.over_peak("amp"), f"coalesce(amp / nullif(max(abs(amp)) OVER ({BY_TRACE}), 0), 0)"),
    ("peak_normalised_guarded", lambda: W.over_peak("amp", 1e-20), f"amp / (max(abs(amp)) OVER ({BY_TRACE}) + 1e-20)"),
    ("sum_normalised", lambda: W.over_sum(F.col("amp") * F.col("amp")), f"amp * amp / (sum(amp * amp) OVER ({BY_TRACE}) + 1e-18)"),
    ("running_integral", lambda: W.running_sum("amp"), f"sum(amp) OVER ({ALONG} ROWS UNBOUNDED PRECEDING)"),
    ("first_difference", lambda: W.difference("amp"), f"amp - lag(amp) OVER ({ALONG})"),
    ("centred_difference", lambda: W.centred_difference("amp"), f"coalesce((lead(amp) OVER ({ALONG}) - lag(amp) OVER ({ALONG})) / 2, 0)"),
):
    add(f"trace_{name_}", on_samples(lambda t, b=build_: t.select("shot", "rcv", "it", b().alias("value"))), f"SELECT shot, rcv, it, {sql_} AS value FROM {TRACES}", "shot rcv it", "value")
add("trace_unwrapped_phase", on_samples(lambda t: W.with_unwrapped(t.withColumn("phase", F.col("amp") * 20), "phase").select("shot", "rcv", "it", "unwrapped")), f"""
    WITH d AS (SELECT shot, rcv, it, amp * 20 AS phase, coalesce(amp * 20 - lag(amp * 20) OVER ({ALONG}), 0) AS d FROM {TRACES}),
    w AS (SELECT *, d + pi() - floor((d + pi()) / (2 * pi())) * 2 * pi() - pi() AS w FROM d)
    SELECT shot, rcv, it, phase + sum(CASE WHEN abs(d) < pi() THEN 0 ELSE CASE WHEN w = -pi() AND d > 0 THEN pi() ELSE w END - d END) OVER ({ALONG}) AS unwrapped FROM w""", "shot rcv it", "unwrapped")  # fmt: skip
add("trace_rolled", on_samples(lambda t: W.rolled(t, 20, 64)), f"SELECT shot, rcv, (it + 20) % 64 AS it, amp FROM {TRACES}", "shot rcv it", "amp")
add("trace_zero_crossings", on_samples(W.zero_crossings), f"""
    WITH n AS (SELECT shot, rcv, CAST(it AS DOUBLE) AS t, amp AS v, lead(amp) OVER ({ALONG}) AS n FROM {TRACES})
    SELECT shot, rcv, t, v FROM n UNION ALL SELECT shot, rcv, t - v / (n - v) AS t, 0 AS v FROM n WHERE (v < 0) <> (n < 0)""", "shot rcv", "t v")  # fmt: skip
add("trace_scaled_by_deviation", on_samples(lambda t: W.std_scaled(t, spacing=2.0)), f"""
    WITH s AS (SELECT shot, max(s) AS s FROM (SELECT shot, rcv, stddev_pop(amp) AS s FROM {TRACES} GROUP BY shot, rcv) GROUP BY shot)
    SELECT t.shot, rcv, it, amp / nullif(s, 0) * 2 AS amp FROM {TRACES} t JOIN s ON t.shot = s.shot""", "shot rcv it", "amp")  # fmt: skip
add("trace_clipped", on_samples(lambda t: W.clipped(t, share=0.9)), f"""
    WITH l AS (SELECT shot, quantile_cont(abs(amp), 0.9) AS l FROM {TRACES} GROUP BY shot)
    SELECT t.shot, rcv, it, l AS most, greatest(least(amp, l), -l) AS amp FROM {TRACES} t JOIN l ON t.shot = l.shot""", "shot rcv it", "most amp")  # fmt: skip
add("trace_decimated", on_samples(lambda t: t.where("it % 4 = 0 AND shot BETWEEN 2 AND 5")), f"SELECT * FROM {TRACES} WHERE it % 4 = 0 AND shot BETWEEN 2 AND 5", "shot rcv it", "amp")
add("noisy_trace_shift", on_samples(lambda t: generate.noisy(t, 0.0, 0.1)), f"SELECT shot, rcv, it, amp + avg(amp) OVER ({BY_TRACE}) * 0.1 AS amp FROM {TRACES}", "shot rcv it", "amp")

# ---------------------------------------------------------------- grids

FIRST = {"x": f"coalesce(v - lead(v) OVER {X}, 0)", "z": f"coalesce(v - lead(v) OVER {Z}, 0)"}
SECOND = {a: f"coalesce(lag(v) OVER {w} - 2 * v + lead(v) OVER {w}, 0)" for a, w in (("x", X), ("z", Z))}
for order_, diff_ in ((1, FIRST), (2, SECOND)):
    inner_ = f"SELECT {diff_['x']} / 0.04 AS x, {diff_['z']} / 0.02 AS z FROM {CELLS}"
    add(f"penalty_tikhonov{order_}", on_cells(lambda g, o=order_: grid.tikhonov(g, o, 0.5, 2.0, 0.04, 0.02)), f"SELECT sqrt(sum(0.5 * x * x + 2 * z * z)) AS penalty FROM ({inner_})", "", "penalty", 5)
    add(f"penalty_total_variation{order_}", on_cells(lambda g, o=order_: grid.total_variation(g, o, 0.5, 2.0, 0.04, 0.02)), f"SELECT sum(0.5 * abs(x) + 2 * abs(z)) AS penalty FROM ({inner_})", "", "penalty", 4)


def stencil_sql(axis: str, forward: bool, order: int) -> str:
    window = X if axis == "x" else Z
    at = lambda k: "v" if k == 0 else f"lead(v, {k}) OVER {window}" if k > 0 else f"lag(v, {-k}) OVER {window}"
    terms = [f"{c!r} * ({at(k if forward else k - 1)} - {at(1 - k if forward else -k)})" for k, c in enumerate(grid.fd_coefficients(order // 2), 1)]
    return " + ".join(terms)


STENCILS = [(a, f, o) for o in (4, 6, 8, 10) for a in "xz" for f in (True, False)]
stencil_name = lambda a, f, o: f"d{a}{'f' if f else 'b'}{o}"
add("fd_stencils", on_cells(lambda g: grid.local(g, 5, lambda t: t.select("iz", "ix", "tz_", "tx_", *(grid.staggered_difference("v", *s).alias(stencil_name(*s)) for s in STENCILS)))),
    f"SELECT iz, ix, {', '.join(f'{stencil_sql(*s)} AS {stencil_name(*s)}' for s in STENCILS)} FROM {CELLS}", "iz ix", " ".join(stencil_name(*s) for s in STENCILS))


def smooth_sql(source: str, span: int, v: str = "v", rest: str = "") -> str:
    """Two passes of weighted neighbours, as self-joins."""
    w = f"exp(-0.5 * pow(2.0 * (b.{{a}} - a.{{a}}) / {span}, 2))"
    one = lambda s, a, o: f"(SELECT a.iz, a.ix, sum({w.format(a=a)} * b.{v}) / sum({w.format(a=a)}) AS {v} FROM {s} a JOIN {s} b ON a.{o} = b.{o} AND abs(a.{a} - b.{a}) <= {span} GROUP BY a.iz, a.ix)"
    return one(one(source, "iz", "ix"), "ix", "iz")


add("grid_smoothed", on_cells(lambda g: grid.smooth(g, 5)), f"SELECT * FROM {smooth_sql(CELLS, 5)}", "iz ix", "v")


def size(d: str, spark: SparkSession) -> int:
    return table(spark, d, "embeddings").count()


def mirror_sql(source: str, axis: str, other: str, n: str, sigma: float) -> str:
    r = int(4 * sigma + 0.5)
    total = sum(math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1))
    m = f"(a.{axis} + k)"
    place = f"CASE WHEN {m} < 0 THEN -{m} - 1 WHEN {m} >= {n} THEN 2 * {n} - 1 - {m} ELSE {m} END"
    return f"(SELECT a.iz, a.ix, sum(exp(-0.5 * pow(k / {sigma}, 2)) / {total!r} * b.v) AS v FROM {source} a, range({-r}, {r + 1}) AS k_(k), {source} b WHERE b.{other} = a.{other} AND b.{axis} = {place} GROUP BY a.iz, a.ix)"


add("grid_gaussian_filtered", lambda s, d: grid.gaussian_filter(own_cells(s, d), 2.0, 64, size(d, s)),
    f"SELECT * FROM {mirror_sql(mirror_sql(CELLS, 'iz', 'ix', '64', 2.0), 'ix', 'iz', '(SELECT count(*) FROM embeddings)', 2.0)}", "iz ix", "v")
PADDED = "SELECT CAST(z AS BIGINT) AS iz, CAST(x AS BIGINT) AS ix, v FROM range({h}) AS a(z), range((SELECT count(*) FROM embeddings) + 20) AS b(x), {cells} c WHERE c.iz = greatest(0, least(63, z - {top})) AND c.ix = greatest(0, least((SELECT count(*) FROM embeddings) - 1, x - 10))"
add("grid_padded", lambda s, d: grid.padded(own_cells(s, d), 10, 64, size(d, s)), PADDED.format(h=84, top=10, cells=CELLS), "iz ix", "v")
add("grid_padded_free_surface", lambda s, d: grid.padded(own_cells(s, d), 10, 64, size(d, s), True), PADDED.format(h=74, top=0, cells=CELLS), "iz ix", "v")
add("grid_staggered_means", on_cells(lambda g: grid.staggered_means(g.select("iz", "ix", (F.col("v") + 2).alias("b"), (F.col("v") * 3).alias("mu"))).select("iz", "ix", "bx", "bz", "mu_xz")), f"""
    WITH d AS (SELECT *, lead(v) OVER {Z} AS down FROM {CELLS})
    SELECT iz, ix, (v + 2 + lead(v + 2) OVER {X}) / 2 AS bx, (v + 2 + lead(v + 2) OVER {Z}) / 2 AS bz, 0.2 * 3 * (2 * v + lead(v) OVER {X} + down + lead(down) OVER {X}) AS mu_xz FROM d""", "iz ix", "bx bz mu_xz")  # fmt: skip
add("grid_summary", on_cells(grid.summary), f"SELECT count(*) AS cells, min(v) AS least, max(v) AS most, avg(v) AS mean FROM {CELLS}", "cells", "least most mean")
add("grid_problems", on_cells(lambda g: grid.problems(g, -0.2, 0.2)), f"SELECT count(*) FILTER (isnan(v)) AS nan, count(*) FILTER (isinf(v)) AS infinite, count(*) FILTER (v < 0) AS negative, count(*) FILTER (v < -0.2 OR v > 0.2) AS outside FROM {CELLS}", "nan infinite negative outside")
add("grid_complete", lambda s, d: grid.complete(own_cells(s, d), 64, size(d, s)), f"SELECT count(*) = 64 * (SELECT count(*) FROM embeddings) AS complete FROM {CELLS}", "complete")
add("grid_roughness", on_cells(metrics.roughness), f"SELECT avg(abs(lag(v) OVER {X} + lead(v) OVER {X} + lag(v) OVER {Z} + lead(v) OVER {Z} - 4 * v)) AS roughness FROM {CELLS}".replace("SELECT avg(", "SELECT avg(l) AS roughness FROM (SELECT (").replace(") AS roughness FROM (SELECT CAST", ") AS l FROM (SELECT CAST") + ")", "", "roughness")
GRADS = f"(SELECT iz, ix, v AS grad, v * v AS forw FROM {CELLS})"
add("gradient_conditioned", lambda s, d: grid.conditioned(own_cells(s, d).select("iz", "ix", F.col("v").alias("grad"), (F.col("v") * F.col("v")).alias("forw")), 3000.0, 64, 64, mute=10, smoothing=0).select("iz", "ix", "grad"), f"""
    WITH f AS (SELECT * FROM {smooth_sql(GRADS, 40, 'forw')}),
    g AS (SELECT g.iz, g.ix, CASE WHEN g.iz < 10 THEN 0 ELSE g.grad END / pow(greatest(f.forw / (SELECT max(forw + 1e-5) FROM f), 1e-4), 2) AS grad FROM {GRADS} g JOIN f ON g.iz = f.iz AND g.ix = f.ix)
    SELECT iz, ix, 3000 * grad / (SELECT max(abs(grad)) FROM g) AS grad FROM g""", "iz ix", "grad", 4)  # fmt: skip
HAMMING = f"(SELECT iz, ix, v, CASE WHEN ix < 8 THEN 0.54 - 0.46 * cos(2 * pi() * (ix + 8) / 15) ELSE 0.0 END AS t FROM {CELLS})"
add("gradient_tapered_land", on_cells(lambda g: grid.tapered(g.withColumnRenamed("v", "grad"), 8, "land")), f"""
    WITH t AS (SELECT * FROM {smooth_sql(HAMMING, 4, 't')})
    SELECT h.iz, h.ix, v * pow(1 - 0.999 * t.t / (SELECT max(t) FROM t), 2) AS grad FROM {HAMMING} h JOIN t ON h.iz = t.iz AND h.ix = t.ix""", "iz ix", "grad")  # fmt: skip
add("illumination_energy", lambda s, d: grid.illumination(own_samples(s, d).select("shot", F.col("rcv").alias("at"), F.col("it").alias("iz"), F.col("shot").alias("ix"), F.col("amp").alias("p"))), f"SELECT it AS iz, shot AS ix, sum(amp * amp) AS energy FROM {TRACES} GROUP BY it, shot", "iz ix", "energy")

# ---------------------------------------------------------------- rock physics

ROCK = f"(SELECT iz, ix, 1500 + 2000 * abs(v) AS vp, 800 + 900 * abs(v) AS vs, 2000 + 100 * v AS rho, v / 5 AS eps, v / 8 AS delta, v / 10 AS gamma FROM {CELLS})"


def rocks(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("v")
    return own_cells(spark, d).select("iz", "ix", (1500 + 2000 * F.abs(v)).alias("vp"), (800 + 900 * F.abs(v)).alias("vs"), (2000 + 100 * v).alias("rho"), (v / 5).alias("eps"), (v / 8).alias("delta"), (v / 10).alias("gamma"))


def on_rocks(columns: Callable[[], dict]) -> Query:
    return lambda s, d: rocks(s, d).select("iz", "ix", *(c.alias(n) for n, c in columns().items()))


THOMSEN = ("vp", "vs", "rho", "eps", "delta", "gamma")
scaled = lambda columns: {n: c / 1e9 for n, c in columns.items()}
add("rock_lame", on_rocks(lambda: scaled({k: v for k, v in rock.lame("vp", "vs", "rho").items() if k != "b"}) | {"b": 1e3 / F.col("rho")}), f"SELECT iz, ix, vs * vs * rho / 1e9 AS mu, (vp * vp - 2 * vs * vs) * rho / 1e9 AS lam, vp * vp * rho / 1e9 AS lam2mu, 1000 / rho AS b FROM {ROCK}", "iz ix", "mu lam lam2mu b")
MODULI = f"(SELECT *, c33 * (1 + 2 * eps) AS c11, sqrt(2 * c33 * (c33 - c44) * delta + pow(c33 - c44, 2)) - c44 AS c13, c44 * (1 + 2 * gamma) AS c66 FROM (SELECT *, rho * vp * vp AS c33, rho * vs * vs AS c44 FROM {ROCK}))"
add("rock_moduli", on_rocks(lambda: scaled(rock.thomsen_to_moduli(*THOMSEN))), f"SELECT iz, ix, c11 / 1e9 AS c11, c13 / 1e9 AS c13, c33 / 1e9 AS c33, c44 / 1e9 AS c44, c66 / 1e9 AS c66 FROM {MODULI}", "iz ix", "c11 c13 c33 c44 c66")
add("rock_moduli_round_trip", on_rocks(lambda: rock.moduli_to_thomsen(*rock.thomsen_to_moduli(*THOMSEN).values(), "rho")), f"SELECT iz, ix, vp, vs, eps, delta, gamma FROM {ROCK}", "iz ix", "vp vs eps delta gamma")
add("rock_transverse_hti", on_rocks(lambda: scaled(rock.transverse(*rock.thomsen_to_moduli(*THOMSEN).values(), "hti"))), f"SELECT iz, ix, c33 / 1e9 AS c11, c13 / 1e9 AS c13, c11 / 1e9 AS c33, c44 / 1e9 AS c55 FROM {MODULI}", "iz ix", "c11 c13 c33 c55")
add("rock_density_and_bounds", on_rocks(lambda: {"rho": rock.gardner("vp"), "vp": rock.vp_from_vs("vs"), "vs": rock.constrained("vs", 850.0, 1000.0), "mapped": rock.range_map("eps", 1.5, 4.5)}),
    f"SELECT iz, ix, 310 * pow(vp, 0.25) AS rho, sqrt(3) * vs AS vp, least(greatest(vs, 850), 1000) AS vs, (3 * tanh(eps) + 6) / 2 * 1000 AS mapped FROM {ROCK}", "iz ix", "rho vp vs mapped")
add("rock_bounds_summary", lambda s, d: rocks(s, d).agg(*(f(c).alias(f"{c}_{n}") for c in ("vp", "vs", "rho") for n, f in (("min", F.min), ("max", F.max)))), f"SELECT min(vp) AS vp_min, max(vp) AS vp_max, min(vs) AS vs_min, max(vs) AS vs_max, min(rho) AS rho_min, max(rho) AS rho_max FROM {ROCK}", "", "vp_min vp_max vs_min vs_max rho_min rho_max")

# ---------------------------------------------------------------- models and history


def stack(spark: SparkSession, d: str) -> DataFrame:
    """Five models that approach the grid."""
    off = 0.01 * (5 - F.col("iter")) * (F.pmod(F.col("ix") * 7 + F.col("iz") * 3, F.lit(11)) - 5)
    return own_cells(spark, d).withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(4)))).select(F.col("iter").cast("long").alias("iter"), "iz", "ix", (F.col("v") + 1 + off).alias("v"))


BOTH = f"(SELECT CAST(n AS BIGINT) AS iter, iz, ix, v + 1 AS t, v + 1 + 0.01 * (5 - n) * ((ix * 7 + iz * 3) % 11 - 5) AS v FROM {CELLS}, range(5) AS r(n))"
both_ = lambda s, d: metrics.compared(own_cells(s, d).withColumn("v", F.col("v") + 1), stack(s, d))
add("metric_errors", lambda s, d: metrics.errors(both_(s, d)), f"SELECT iter, avg(pow(v - t, 2)) AS mse, 100 * avg(abs(v - t) / t) AS mape, 10 * log10(sum(t * t) / sum(pow(v - t, 2))) AS snr FROM {BOTH} GROUP BY iter", "iter", "mse mape snr")
add("metric_ssim", lambda s, d: metrics.ssim(both_(s, d)), f"""
    WITH b AS (SELECT * FROM {BOTH}), r AS (SELECT iter, greatest(max(t), max(v)) - least(min(t), min(v)) AS r, max(iz) AS z1, max(ix) AS x1 FROM b GROUP BY iter),
    m AS (SELECT a.iter, a.iz, a.ix, avg(n.t) AS t, avg(n.v) AS v, var_samp(n.t) AS tt, var_samp(n.v) AS vv, covar_samp(n.t, n.v) AS tv FROM b a JOIN b n ON a.iter = n.iter AND n.iz BETWEEN a.iz - 1 AND a.iz + 1 AND n.ix BETWEEN a.ix - 1 AND a.ix + 1 GROUP BY a.iter, a.iz, a.ix HAVING count(*) = 9)
    SELECT m.iter, avg((2 * t * v + pow(0.01 * r, 2)) * (2 * tv + pow(0.03 * r, 2)) / ((t * t + v * v + pow(0.01 * r, 2)) * (tt + vv + pow(0.03 * r, 2)))) AS ssim FROM m JOIN r ON m.iter = r.iter GROUP BY m.iter""", "iter", "ssim")  # fmt: skip
add("ensemble_uncertainty", lambda s, d: metrics.uncertainty(own_samples(s, d).select(F.col("rcv").alias("draw"), F.col("it").alias("iz"), F.col("shot").alias("ix"), F.col("amp").alias("v"))), f"""
    SELECT iz, ix, any_value(mean) AS mean, avg(abs(v - mean)) AS spread FROM (SELECT it AS iz, shot AS ix, amp AS v, avg(amp) OVER (PARTITION BY it, shot) AS mean FROM {TRACES}) GROUP BY iz, ix""", "iz ix", "mean spread")  # fmt: skip
add("loss_curve_scaled", lambda s, d: metrics.scaled_curve(table(s, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("iter"), F.col("value").alias("loss"))), """
    SELECT user_id AS run, event_id AS iter, (value - min(value) OVER (PARTITION BY user_id)) / nullif(max(value) OVER (PARTITION BY user_id) - min(value) OVER (PARTITION BY user_id), 0) AS loss FROM events""", "run iter", "loss")  # fmt: skip
add("history_thinned", lambda s, d: stack(s, d).where("iter % 3 = 0").groupBy("iter", "iz").agg(F.avg("v").alias("v")), f"SELECT iter, iz, avg(v) AS v FROM {BOTH} WHERE iter % 3 = 0 GROUP BY iter, iz", "iter iz", "v")
add("windowed_event_energy", lambda s, d: windowed_energy(table(s, d, "events").select("ts", F.col("user_id").alias("trace"), "value"), "1 day").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "trace", "n", "energy"), """
    SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, user_id AS trace, count(*) AS n, sum(value * value) AS energy FROM events GROUP BY ALL""", "day trace n", "energy", 4)  # fmt: skip

# ---------------------------------------------------------------- generators, for the shots and cells of a table

WAVES = "(SELECT vec_id AS shot, 4.0 + label % 5 AS f0, CASE WHEN vec_id % 3 = 0 THEN 1.2 / (4.0 + label % 5) ELSE 0.5 END AS t0, 1.0 + vec_id % 2 AS a FROM embeddings)"
TIMES = f"(SELECT shot, f0, t0, a, CAST(i AS BIGINT) AS it, CAST(i AS DOUBLE) * 0.003 AS t FROM {WAVES}, range(300) AS r(i))"
RICKER = "a * (1 - 2 * pow(pi() * f0, 2) * pow(t - t0, 2)) * exp(-pow(pi() * f0, 2) * pow(t - t0, 2))"


def wavelet_shots(spark: SparkSession, d: str) -> DataFrame:
    """Frequency by label; every third shot's delay is the usual one."""
    shot = own_traces(spark, d)
    return shot.select(F.col("rcv").alias("shot"), (4.0 + F.col("shot") % 5).alias("f0"), F.when(F.col("rcv") % 3 != 0, 0.5).alias("t0"), (1.0 + F.col("rcv") % 2).alias("a"))


add("wavelet_ricker", lambda s, d: generate.wavelets(wavelet_shots(s, d), 300, 0.003), f"SELECT shot, it, t, {RICKER} AS amp FROM {TIMES}", "shot it", "t amp")
add("wavelet_gaussian", lambda s, d: generate.wavelets(wavelet_shots(s, d), 300, 0.003, "gaussian"), f"SELECT shot, it, t, sum(a) OVER (PARTITION BY shot ORDER BY it) AS amp FROM (SELECT shot, it, t, sum({RICKER}) OVER (PARTITION BY shot ORDER BY it) AS a FROM {TIMES})", "shot it", "t amp")
add("wavelet_ramp", lambda s, d: generate.wavelets(wavelet_shots(s, d), 300, 0.003, "ramp"), f"SELECT shot, it, t, a * 0.5 * (1 + tanh(t / t0)) AS amp FROM {TIMES}", "shot it", "t amp")
COLUMNS = "(SELECT count(*) FROM embeddings)"
FRAME = "(SELECT iz, ix, greatest(0, 10 - ix, ix - {nx} - 9) AS dx, greatest(0, {top}, iz - {far}) AS dz FROM (" + PADDED + "))"
OPEN_FRAME, FREE_FRAME = FRAME.replace("{top}", "10 - iz", 1).format(far=73, nx=COLUMNS, top=10, h=84, cells=CELLS), FRAME.replace("{top}", "0", 1).format(far=63, nx=COLUMNS, top=0, h=74, cells=CELLS)
KAPPA = "(-3 * 4000 * ln(1e-6) / (2 * 9 * 40.0))"
FILLED = {"c11": "c11", "c12": "c11 - 2 * c66", "c13": "c13", "c22": "c11", "c23": "c13", "c33": "c33", "c44": "c44", "c55": "c44", "c66": "c66"}
add("rock_isotropic_stiffness", on_rocks(lambda: scaled(rock.isotropic_stiffness(*rock.thomsen_to_moduli(*THOMSEN).values()))), f"SELECT iz, ix, {', '.join(f'({FILLED.get(c, 0.0)}) / 1e9 AS {c}' for c in rock.STIFFNESS)} FROM {MODULI}", "iz ix", " ".join(rock.STIFFNESS))
add("rock_slowness_to_velocity", on_cells(lambda c: c.select("iz", "ix", rock.slowness_to_velocity(0.05 + F.col("v") * F.col("v")).alias("vp"))), f"SELECT iz, ix, sqrt(1 / (0.05 + v * v)) * 1000 AS vp FROM {CELLS}", "iz ix", "vp")
LIMITS = {"vp": (1600.0, 1900.0), "vs": (850.0, 1000.0), "rho": (1990.0, 2010.0)}


def refresh_sql(vp: str, eps: str, delta: str) -> str:
    hold = lambda c, v: f"least(greatest({v}, {LIMITS[c][0]}), {LIMITS[c][1]}) AS {c}"
    return f"""
        WITH r AS (SELECT iz, ix, {hold("vp", vp)}, {hold("vs", "vs")}, {hold("rho", "310 * pow(vp, 0.25)")}, {eps} AS eps, {delta} AS delta FROM {ROCK}),
        m AS (SELECT *, rho * vp * vp AS c33, rho * vs * vs AS c55 FROM r)
        SELECT iz, ix, vp, vs, rho, c55 / 1e9 AS mu, (c33 - 2 * c55) / 1e9 AS lam, c33 * (1 + 2 * eps) / 1e9 AS c11,
               (sqrt(2 * c33 * (c33 - c55) * delta + pow(c33 - c55, 2)) - c55) / 1e9 AS c13, c33 / 1e9 AS c33, c55 / 1e9 AS c55 FROM m"""


def refresh(spark: SparkSession, d: str, **how) -> DataFrame:
    made = model.refreshed(rocks(spark, d), LIMITS, **how)
    return made.select("iz", "ix", "vp", "vs", "rho", *((F.col(c) / 1e9).alias(c) for c in ("mu", "lam", "c11", "c13", "c33", "c55")))


add("model_refreshed_isotropic", lambda s, d: refresh(s, d, vp_from_vs=True), refresh_sql("sqrt(3) * vs", "0.0", "0.0"), "iz ix", "vp vs rho mu lam c11 c13 c33 c55")
add("model_refreshed_vti", lambda s, d: refresh(s, d, axis="vti"), refresh_sql("vp", "eps", "delta"), "iz ix", "vp vs rho mu lam c11 c13 c33 c55")
add("model_cropped", on_cells(lambda c: model.cropped(c, (8, 50), (20, 90), 2)), f"SELECT (iz - 8) // 2 AS iz, (ix - 20) // 2 AS ix, v FROM {CELLS} WHERE iz >= 8 AND iz < 50 AND ix >= 20 AND ix < 90 AND iz % 2 = 0 AND ix % 2 = 0", "iz ix", "v")
add("model_resampled", lambda s, d: model.resampled(own_cells(s, d), ["v"], (0.75, 1.5), (85, 1 << 40)), f"""
    SELECT k AS iz, j AS ix, sum(w * v) AS v FROM (
        SELECT k, j, CAST(floor(k * 0.75) + a AS BIGINT) AS iz, CAST(floor(j * 1.5) + b AS BIGINT) AS ix, (1 - abs(a - k * 0.75 + floor(k * 0.75))) * (1 - abs(b - j * 1.5 + floor(j * 1.5))) AS w
        FROM range(85) AS p(k), (SELECT unnest(range(1 + CAST(floor(max(vec_id) / 1.5) AS BIGINT))) AS j FROM embeddings), range(2) AS r(a), range(2) AS q(b)) JOIN {CELLS} USING (iz, ix)
    WHERE w > 0 GROUP BY k, j HAVING sum(w) > 1 - 1e-9""", "iz ix", "v")  # fmt: skip
add("model_gradient_or_zero", on_cells(lambda c: model.gradient_or_zero(c, c.where("v > 0").withColumnRenamed("v", "grad"))), f"SELECT iz, ix, greatest(v, 0) AS grad FROM {CELLS}", "iz ix", "grad")
for free_, frame_ in ((True, FREE_FRAME), (False, OPEN_FRAME)):
    end_ = "_free_surface" if free_ else ""
    area_ = lambda s, d, f=free_: (grid.padded(own_cells(s, d), 10, 64, size(d, s), f), 64, size(d, s))
    add(f"boundary_pml{end_}", lambda s, d, f=free_, a=area_: generate.pml_damping(*a(s, d), 40.0, 10, 4000.0, f), f"SELECT iz, ix, {KAPPA} * pow(greatest(greatest(dx, dz) - 1, 0) / 9.0, 2) AS damp FROM {frame_}", "iz ix", "damp")
    add(f"boundary_sponge{end_}", lambda s, d, f=free_, a=area_: generate.sponge(*a(s, d), 10, 0.03, f), f"SELECT iz, ix, exp(-pow(0.03 * greatest(greatest(dx, dz) - 1, 0), 2)) AS damp FROM {frame_}", "iz ix", "damp")
    add(f"boundary_split_pml{end_}", lambda s, d, f=free_, a=area_: generate.split_pml(*a(s, d), 40.0, 20.0, 10, 4000.0, f), f"SELECT iz, ix, dx * dx * (-ln(1e-6) * 3 * 4000 / 2000) / 40 AS bcx, dz * dz * (-ln(1e-6) * 3 * 4000 / 2000) / 20 AS bcz FROM {frame_}", "iz ix", "bcx bcz")
    sides_ = ["ix", f"{COLUMNS} + 19 - ix", f"{73 if free_ else 83} - iz", *([] if free_ else ["iz"])]
    add(f"boundary_sine{end_}", lambda s, d, f=free_, a=area_: generate.sine_taper(*a(s, d), 10, f), f"SELECT iz, ix, {' * '.join(f'CASE WHEN {i} < 10 THEN pow(sin(pi() / 2 * ({i}) / 10), 2) ELSE 1 END' for i in sides_)} AS damp FROM {frame_}", "iz ix", "damp")


def layered_sql(step: int, gap: int) -> str:
    """The staircase with a knot each step and one gap below it, linear between knots, for the grid's cells; depths up to 63."""
    upper = f"SELECT CAST(i AS DOUBLE) * {step} AS y0 FROM range({64 // step + 2}) AS r(i)"
    return f"""
    WITH k AS (SELECT y0 AS y, y0 FROM ({upper}) UNION ALL SELECT y0 + {gap} AS y, y0 FROM ({upper})), s AS (SELECT y, y0, lead(y) OVER (ORDER BY y) AS y1, lead(y0) OVER (ORDER BY y) AS n0 FROM k)
    SELECT iz, ix, e / 63 * 1.5 + 3 AS vp, e / 63 * 1.02 + 2.46 AS vs, e / 63 * 0.6 + 2.72 AS rho FROM (SELECT iz, ix, y0 + (n0 - y0) * (iz - y) / (y1 - y) AS e FROM {CELLS} JOIN s ON iz >= y AND iz < y1)"""


LAYERED = layered_sql(5, 4)
layers = lambda s, d, step=5.0, anomaly=False: generate.layered(own_cells(s, d).select("iz", "ix"), F.col("iz"), 63.0, step, anomaly)
add("model_layered", lambda s, d: layers(s, d), LAYERED, "iz ix", "vp vs rho")
add("model_layered_anomaly", lambda s, d: layers(s, d, 4.0, True), layered_sql(4, 3), "iz ix", "vp vs rho")
add("model_profile", lambda s, d: generate.profile(own_traces(s, d).select(F.col("rcv").alias("k")), F.lit(5000.0), 5.0), """
    SELECT y, 5.0 * vec_id / 5000 * 1.5 + 3 AS vp, 5.0 * vec_id / 5000 * 1.02 + 2.46 AS vs, 5.0 * vec_id / 5000 * 0.6 + 2.72 AS rho FROM (SELECT vec_id, 5.0 * vec_id + unnest([0, 4]) AS y FROM embeddings)""", "", "y vp vs rho")  # fmt: skip
WIDE = f"({COLUMNS} - 1.0)"
INSIDE = f"(pow((ix - {WIDE} * {{fx}} / 3) / ({WIDE} / 6), 2) + pow((iz - 63.0 * {{fz}} / 3) / 6.3, 2) < 1)"
ONE, TWO = INSIDE.format(fx=2, fz=1), INSIDE.format(fx=1, fz=2)
add("model_two_ellipses", lambda s, d: generate.with_ellipses(layers(s, d), 64, size(d, s), 1.0, 1.0), f"""
    WITH m AS ({LAYERED}) SELECT iz, ix, {', '.join(f"CASE WHEN {ONE} THEN 1.1 * (SELECT avg({c}) FROM m WHERE {ONE}) WHEN {TWO} THEN (SELECT avg({c}) FROM m WHERE {TWO}) / 1.1 ELSE {c} END AS {c}" for c in ('vp', 'vs', 'rho'))} FROM m""", "iz ix", "vp vs rho")  # fmt: skip
add("model_linear_start", lambda s, d: generate.linear_start(layers(s, d), 64).select("iz", "ix", "vp"), f"""
    WITH m AS ({LAYERED}), e AS (SELECT min(vp) AS lo, max(vp) AS hi FROM m WHERE iz >= 10) SELECT iz, ix, CASE WHEN iz < 10 THEN vp ELSE lo + (hi - lo) * (iz - 10) / 53.0 END AS vp FROM m, e""", "iz ix", "vp")  # fmt: skip
add("model_gaussian_bump", lambda s, d: generate.gauss2(own_cells(s, d), (20.0, 15.0), (5.0, 4.0)), f"SELECT iz, ix, exp(-(pow((ix - 20) / 5.0, 2) + pow((iz - 15) / 4.0, 2)) / 2) / (2 * pi() * 20) AS v FROM {CELLS}", "iz ix", "v", 8)
SHOTS = "(SELECT s_suppkey AS shot, CAST(s_suppkey * 7 + 2 AS BIGINT) AS sx, CAST(1 AS BIGINT) AS sz, CASE WHEN s_nationkey % 2 = 0 THEN 'mt' ELSE 'ex' END AS type FROM supplier)"


def supplier_shots(spark: SparkSession, d: str) -> DataFrame:
    """A shot for each supplier, seven cells apart."""
    made = table(spark, d, "supplier")
    return made.select(F.col("s_suppkey").cast("long").alias("shot"), (F.col("s_suppkey") * 7 + 2).cast("long").alias("sx"), F.lit(1).cast("long").alias("sz"), F.when(F.col("s_nationkey") % 2 == 0, "mt").otherwise("ex").alias("type"))


add("survey_geometry", lambda s, d: acquisition(supplier_shots(s, d), own_traces(s, d).select("rcv", (2 * F.col("rcv") + 3).alias("rx"), F.lit(1).cast("long").alias("rz")), 100), f"""
    SELECT CAST(shot AS BIGINT) AS shot, sx, sz, type, vec_id AS rcv, 2 * vec_id + 3 AS rx, CAST(1 AS BIGINT) AS rz, abs(2 * vec_id + 3 - sx) AS "offset" FROM {SHOTS}, embeddings WHERE abs(2 * vec_id + 3 - sx) <= 100""", 'shot sx sz type rcv rx rz "offset"')  # fmt: skip
add("survey_summary", lambda s, d: survey_summary(supplier_shots(s, d)), f"SELECT count(*) AS n, min(sx) AS x_min, max(sx) AS x_max, min(sz) AS z_min, max(sz) AS z_max, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM {SHOTS}", "n x_min x_max z_min z_max types")
RECEIVERS = "(SELECT vec_id AS rcv, 2 * vec_id + 3 AS rx, CAST(label % 4 AS BIGINT) AS rz, CASE WHEN label % 2 = 0 THEN 'pr' ELSE 'vz' END AS type FROM embeddings)"
add("survey_receivers_summary", lambda s, d: survey_summary(own_traces(s, d).select((2 * F.col("rcv") + 3).alias("rx"), (F.col("shot") % 4).alias("rz"), F.when(F.col("shot") % 2 == 0, "pr").otherwise("vz").alias("type")), "rx", "rz"), f"SELECT count(*) AS n, min(rx) AS x_min, max(rx) AS x_max, min(rz) AS z_min, max(rz) AS z_max, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM {RECEIVERS}", "n x_min x_max z_min z_max types")
add("survey_wavelets", lambda s, d: source_wavelets(own_traces(s, d).select(F.col("rcv").alias("shot"), F.col("amp").alias("wavelet"))), f"SELECT rcv AS shot, it, amp FROM {TRACES}", "shot it", "amp")
add("survey_moment_tensors", lambda s, d: moment_tensors(own_traces(s, d).select(F.col("rcv").alias("shot"), F.array(*(F.slice("amp", 3 * k + 1, 3) for k in range(3))).alias("mt"))), f"SELECT rcv AS shot, it // 3 AS i, it % 3 AS j, amp AS m FROM {TRACES} WHERE it < 9", "shot i j", "m")

# ---------------------------------------------------------------- optimiser steps (the third, at a rate of 0.1)

STATE = f"(SELECT iz, ix, v, v * v - 0.01 AS grad, 0.1 * v AS m, abs(v) AS s FROM {CELLS})"


def states(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("v")
    return own_cells(spark, d).select("iz", "ix", "v", (v * v - 0.01).alias("grad"), (0.1 * v).alias("m"), F.abs(v).alias("s"))


AVERAGED = f"(SELECT iz, ix, v, grad, 0.9 * m + 0.1 * grad AS m, 0.999 * s + 0.001 * grad * grad AS s FROM {STATE})"
HAT, ROOT = "(m / (1 - pow(0.9, 3)))", "(sqrt(s / (1 - pow(0.999, 3))) + 1e-8)"
MU = {i: 0.9 * (1 - 0.5 * 0.96 ** (i * 4e-3)) for i in range(1, 5)}
MU3, MU4 = MU[1] * MU[2] * MU[3], MU[1] * MU[2] * MU[3] * MU[4]
STEPS = {
    "sgd": ({"momentum": 0.9}, f"SELECT iz, ix, m, s, v - 0.1 * m AS v FROM (SELECT iz, ix, v, 0.9 * m + grad AS m, s FROM {STATE})"),
    "adagrad": ({}, f"SELECT iz, ix, m, s, v - 0.1 * grad / (sqrt(s) + 1e-10) AS v FROM (SELECT iz, ix, v, grad, m, s + grad * grad AS s FROM {STATE})"),
    "rmsprop": ({}, f"SELECT iz, ix, m, s, v - 0.1 * grad / (sqrt(s) + 1e-8) AS v FROM (SELECT iz, ix, v, grad, m, 0.99 * s + 0.01 * grad * grad AS s FROM {STATE})"),
    "adam": ({}, f"SELECT iz, ix, m, s, v - 0.1 * {HAT} / {ROOT} AS v FROM {AVERAGED}"),
    "adamw": ({}, f"SELECT iz, ix, m, s, v * 0.999 - 0.1 * {HAT} / {ROOT} AS v FROM {AVERAGED}"),
    "adamax": ({}, f"SELECT iz, ix, m, s, v - 0.1 * {HAT} / s AS v FROM (SELECT iz, ix, v, 0.9 * m + 0.1 * grad AS m, greatest(0.999 * s, abs(grad) + 1e-8) AS s FROM {STATE})"),
    "nadam": ({}, f"SELECT iz, ix, m, s, v - 0.1 * {(1 - MU[3]) / (1 - MU3)!r} * grad / {ROOT} - 0.1 * {MU[4] / (1 - MU4)!r} * m / {ROOT} AS v FROM {AVERAGED}"),
    "radam": ({}, f"SELECT iz, ix, m, s, v - 0.1 * {HAT} AS v FROM {AVERAGED}"),
    "adadelta": ({}, f"SELECT iz, ix, 0.9 * m + 0.1 * d * d AS m, s, v - 0.1 * d AS v FROM (SELECT *, sqrt(m + 1e-6) / sqrt(s + 1e-6) * grad AS d FROM (SELECT iz, ix, v, grad, abs(m) AS m, 0.9 * s + 0.1 * grad * grad AS s FROM {STATE}))"),
    "asgd": ({}, f"SELECT iz, ix, v * (1 - 1e-5) - 0.1 * grad AS m, s, v * (1 - 1e-5) - 0.1 * grad AS v FROM {STATE}"),
    "rprop": ({}, f"SELECT iz, ix, m, s, v - sign(m) * s AS v FROM (SELECT iz, ix, v, CASE WHEN grad * m < 0 THEN 0 ELSE grad END AS m, least(greatest(s * CASE WHEN grad * m > 0 THEN 1.2 WHEN grad * m < 0 THEN 0.5 ELSE 1 END, 1e-6), 50) AS s FROM {STATE})"),
}
for rule_, (options_, sql_) in STEPS.items():
    prepared_ = (lambda t: t.withColumn("m", F.abs("m"))) if rule_ == "adadelta" else (lambda t: t)
    add(f"step_{rule_}", lambda s, d, r=rule_, o=options_, f=prepared_: optimise.step(f(states(s, d)), r, 0.1, 3, **o).drop("grad"), sql_, "iz ix", "v m s")
LATE = 2 / (1 - 0.999) - 1
LATER = LATE - 2 * 20 * 0.999**20 / (1 - 0.999**20)
RECTIFIED = math.sqrt((LATER - 4) * (LATER - 2) * LATE / ((LATE - 4) * (LATE - 2) * LATER))
add("step_radam_late", lambda s, d: optimise.step(states(s, d), "radam", 0.1, 20).drop("grad"), f"SELECT iz, ix, m, s, v - 0.1 * {RECTIFIED!r} * m / (1 - pow(0.9, 20)) * sqrt(1 - pow(0.999, 20)) / (sqrt(s) + 1e-8) AS v FROM {AVERAGED}", "iz ix", "v m s")
add("step_projected", lambda s, d: optimise.projected(states(s, d).select("iz", "ix", "v"), -0.1, 0.1, 0.01), f"SELECT iz, ix, CASE WHEN v > 0.1 THEN 0.09 WHEN v < -0.1 THEN -0.09 ELSE v END AS v FROM {CELLS}", "iz ix", "v")
add("direction_conjugate", lambda s, d: optimise.polak_ribiere(states(s, d).select("iz", "ix", "grad", F.col("m").alias("before"), F.col("grad").alias("pgrad"), F.col("v").alias("direction"))).select("iz", "ix", "direction"), f"""
    WITH b AS (SELECT sum((grad - m) * grad) / sum(m * m) AS beta FROM {STATE}) SELECT iz, ix, -grad + CASE WHEN beta BETWEEN 0 AND 2 THEN beta ELSE 0 END * v AS direction FROM {STATE}, b""", "iz ix", "direction")  # fmt: skip

# ---------------------------------------------------------------- adjoint sources

PEAKS = f"(SELECT *, max(abs(syn)) OVER ({BY_TRACE}) AS top_, syn / max(abs(syn)) OVER ({BY_TRACE}) - obs / max(abs(obs)) OVER ({BY_TRACE}) AS r FROM {PAIRS})"
GAIN = "sum(r * r) OVER (PARTITION BY shot, rcv)"
for name_, build_, sql_ in (
    ("l1", adjoint.l1, f"SELECT shot, rcv, it, CAST(sign(syn - obs) AS DOUBLE) AS adjoint FROM {PAIRS}"),
    ("l2", adjoint.l2, f"SELECT shot, rcv, it, (syn - obs) / sqrt(sum((syn - obs) * (syn - obs)) OVER ({BY_TRACE})) AS adjoint FROM {PAIRS}"),
    ("smooth_l1", adjoint.smooth_l1, f"SELECT shot, rcv, it, greatest(least(syn - obs, 1), -1) AS adjoint FROM {PAIRS}"),
    ("student_t", adjoint.student_t, f"SELECT shot, rcv, it, 2 * (syn - obs) / (1 + (syn - obs) * (syn - obs)) AS adjoint FROM {PAIRS}"),
    ("l2_of_peaks", lambda p: adjoint.of_peaks(p, adjoint.l2), f"""
        WITH g AS (SELECT *, r / sqrt({GAIN}) AS g FROM {PEAKS}),
        f AS (SELECT *, min(it) FILTER (abs(syn) = top_) OVER ({BY_TRACE}) AS first_, sum(g * syn) OVER ({BY_TRACE}) AS pull FROM g)
        SELECT shot, rcv, it, g / top_ - CASE WHEN it = first_ THEN pull * sign(syn) / (top_ * top_) ELSE 0 END AS adjoint FROM f"""),
):
    add(f"adjoint_{name_}", on_pairs(lambda p, b=build_: b(p).select("shot", "rcv", "it", "adjoint")), sql_, "shot rcv it", "adjoint")

# ---------------------------------------------------------------- streams with carried state

EVENTS = "(SELECT user_id AS trace, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS it, value FROM events)"


def streamed(spark: SparkSession, d: str, kernel: carried.Kernel) -> DataFrame:
    """The events of each user as a trace, cut into chunks of 16, which a stream takes up in four batches of files, at least
    as many in all as four times the cluster's cores."""
    events = table(spark, d, "events").select(F.col("user_id").alias("trace"), "ts", "event_id", "value")
    cut = chunks.chunked(events, ["trace"], ["ts", "event_id"], "value", "ts", 16)
    place = fresh_path(spark, "chunks")
    cut.repartitionByRange(4 * max(1, spark.sparkContext.defaultParallelism), "first", "trace").write.parquet(f"{place}/in")
    files = sum(name.endswith(".parquet") for name in children(spark, f"{place}/in"))
    stream = chunks.chunk_stream(spark, f"{place}/in", cut.schema, max(1, math.ceil(files / 4)))
    chunks.written(chunks.carried(stream, kernel, ["trace"], "36500 days"), f"{place}/out", f"{place}/checkpoint").awaitTermination()
    made = spark.read.parquet(f"{place}/out").select("trace", "first", F.posexplode("amp").alias("k", "value"))
    return made.select("trace", (F.col("first") + F.col("k")).alias("it"), "value")


LOW_PASS = carried.LowPass(6, 100)
(B0_, B1_, B2_), (_, A1_, A2_) = LOW_PASS.coefficients
add("stream_running_integral", lambda s, d: streamed(s, d, carried.RunningSum(0.5)), f"SELECT trace, it, 0.5 * sum(value) OVER (PARTITION BY trace ORDER BY it) AS value FROM {EVENTS}", "trace it", "value")
add("stream_unwrapped_phase", lambda s, d: streamed(s, d, carried.Unwrap()), f"""
    WITH d AS (SELECT trace, it, value, coalesce(value - lag(value) OVER t, 0) AS d FROM {EVENTS} WINDOW t AS (PARTITION BY trace ORDER BY it)),
    w AS (SELECT *, d + pi() - floor((d + pi()) / (2 * pi())) * 2 * pi() - pi() AS w FROM d)
    SELECT trace, it, value + sum(CASE WHEN abs(d) < pi() THEN 0 ELSE CASE WHEN w = -pi() AND d > 0 THEN pi() ELSE w END - d END) OVER (PARTITION BY trace ORDER BY it) AS value FROM w""", "trace it", "value")  # fmt: skip
FILTERED = f"""
    WITH RECURSIVE e AS (SELECT * FROM {EVENTS}),
    f AS (SELECT trace, it, {B0_!r} * value AS y, CAST(0 AS DOUBLE) AS y1, value AS x1, CAST(0 AS DOUBLE) AS x2 FROM e WHERE it = 0
          UNION ALL SELECT e.trace, e.it, {B0_!r} * e.value + {B1_!r} * f.x1 + {B2_!r} * f.x2 - {A1_!r} * f.y - {A2_!r} * f.y1, f.y, e.value, f.x1 FROM f JOIN e ON e.trace = f.trace AND e.it = f.it + 1)
    SELECT trace, it, y AS value FROM f"""
add("stream_low_pass", lambda s, d: streamed(s, d, LOW_PASS), FILTERED, "trace it", "value")
ROWS = "(SELECT vec_id AS trace, CAST(i - 1 AS BIGINT) AS it, CAST(embedding[i] AS DOUBLE) AS value FROM embeddings, range(1, 65) AS r(i))"
add("trace_causal_low_pass", lambda s, d: samples(carried.applied(own_traces(s, d).select(F.col("rcv").alias("trace"), F.col("amp").alias("value")), LOW_PASS, "value"), "value"), FILTERED.replace(EVENTS, ROWS), "trace it", "value")

# ---------------------------------------------------------------- files of gathers


def through_files(spark: SparkSession, d: str, kind: str = "f8") -> DataFrame:
    """All traces, written as gathers and read back."""
    gathers.register(spark)
    place = fresh_path(spark, "gathers")
    own_traces(spark, d).repartitionByRange(8, "shot", "rcv").write.format("gathers").mode("append").option("kind", kind).save(place)
    return spark.read.format("gathers").load(place)


add("gathers_round_trip", lambda s, d: samples(through_files(s, d).drop("component"), "amp"), TRACES, "shot rcv it", "amp")
add("gathers_shots", lambda s, d: through_files(s, d, "f4").where("shot BETWEEN 2 AND 5").groupBy("shot").agg(F.count("*").alias("traces"), F.sum(F.aggregate("amp", F.lit(0.0), lambda u, v: u + v * v)).alias("energy")), f"SELECT shot, count(DISTINCT rcv) AS traces, sum(amp * amp) AS energy FROM {TRACES} WHERE shot BETWEEN 2 AND 5 GROUP BY shot", "shot traces", "energy")

# ---------------------------------------------------------------- cubic splines


def spline_sql(label: str, source: str, line: str, at: str, n: str, points: str) -> str:
    """CTEs up to `label`: (line, at, v) of the source -> (line, k, v) at the points (k, x). Second derivatives by a sweep down each line and one up."""
    return f"""
    {label}_v AS (SELECT {line} AS line, {at} AS i, v, lag(v) OVER w - 2 * v + lead(v) OVER w AS d FROM {source} WINDOW w AS (PARTITION BY {line} ORDER BY {at})),
    {label}_f AS (SELECT line, CAST(1 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS c, d AS e FROM {label}_v WHERE i = 1
        UNION ALL SELECT v.line, v.i, CASE WHEN v.i = {n} - 2 THEN 0 ELSE 1 / (4 - f.c) END, CASE WHEN v.i = {n} - 2 THEN v.d ELSE (6 * v.d - f.e) / (4 - f.c) END
        FROM {label}_f f JOIN {label}_v v ON v.line = f.line AND v.i = f.i + 1 WHERE v.i <= {n} - 2),
    {label}_b AS (SELECT line, i, e AS m FROM {label}_f WHERE i = {n} - 2
        UNION ALL SELECT f.line, f.i, f.e - f.c * b.m FROM {label}_b b JOIN {label}_f f ON f.line = b.line AND f.i = b.i - 1),
    {label}_m AS (SELECT * FROM {label}_b UNION ALL SELECT line, 0, sum(CASE i WHEN 1 THEN 2 * m ELSE -m END) FROM {label}_b WHERE i IN (1, 2) GROUP BY line
        UNION ALL SELECT line, {n} - 1, sum(CASE i WHEN {n} - 2 THEN 2 * m ELSE -m END) FROM {label}_b WHERE i IN ({n} - 2, {n} - 3) GROUP BY line),
    {label}_g AS (SELECT v.line, v.i, v, m FROM {label}_v v JOIN {label}_m m ON v.line = m.line AND v.i = m.i),
    {label} AS (SELECT a.line, k, (1 - t) * a.v + t * b.v + ((pow(1 - t, 3) - (1 - t)) * a.m + (pow(t, 3) - t) * b.m) / 6 AS v
        FROM (SELECT k, least(floor(x), {n} - 2) AS at, x - least(floor(x), {n} - 2) AS t FROM {points}) p JOIN {label}_g a ON a.i = p.at JOIN {label}_g b ON b.line = a.line AND b.i = a.i + 1)"""


add("model_spline_resampled", lambda s, d: spline.spline_resampled(own_cells(s, d), ["v"], (0.75, 1.5), (85, 1 << 40)), f"""
    WITH RECURSIVE {spline_sql("tall", CELLS, "ix", "iz", "64", "(SELECT CAST(i AS BIGINT) AS k, i * 0.75 AS x FROM range(85) AS r(i) WHERE i * 0.75 <= 63)")},
    {spline_sql("wide", "tall", "k", "line", COLUMNS, f"(SELECT i AS k, i * 1.5 AS x FROM (SELECT unnest(range(1 + CAST(floor(({COLUMNS} - 1) / 1.5) AS BIGINT))) AS i))")}
    SELECT line AS iz, k AS ix, v FROM wide""", "iz ix", "v")  # fmt: skip

# ---------------------------------------------------------------- time and frequency

GAUSS = "(SELECT exp(-0.5 * pow((n - 8) / (16 / 6.0), 2)) AS w, CAST(n AS BIGINT) AS n FROM range(16) AS r(n))"
SPECTRA = f"""(SELECT x.shot, x.rcv, frame, freq, sum({{v}} * w * cos(2 * pi() * freq * n / 16)) / (SELECT sum(w) FROM {GAUSS}) AS re, -sum({{v}} * w * sin(2 * pi() * freq * n / 16)) / (SELECT sum(w) FROM {GAUSS}) AS im
    FROM {{rows}} x, (SELECT CAST(i AS BIGINT) AS frame FROM range(9) AS a(i)) f, (SELECT CAST(i AS BIGINT) AS freq FROM range(9) AS b(i)) k, {GAUSS} g WHERE x.it + 8 = frame * 8 + n GROUP BY ALL)"""
add("trace_spectra", lambda s, d: timefreq.spectra(own_traces(s, d), 16).select("shot", "rcv", "frame", F.posexplode(F.arrays_zip("re", "im")).alias("freq", "z")).select("shot", "rcv", "frame", F.col("freq").cast("long").alias("freq"), "z.re", "z.im"), f"SELECT shot, rcv, frame, freq, re, im FROM {SPECTRA.format(v='amp', rows=TRACES)}", "shot rcv frame freq", "re im")
add("trace_spectra_restored", lambda s, d: samples(timefreq.restored(timefreq.spectra(own_traces(s, d).withColumn("n", F.size("amp")), 16), 16, "n", ["shot", "rcv"]), "amp"), TRACES, "shot rcv it", "amp")
add("misfit_phase_correlation", on_rows(lambda p: timefreq.phase_correlation(p, 16)), f"""
    SELECT o.shot, -sum(o.re * s.re + o.im * s.im) AS misfit FROM {SPECTRA.format(v="obs", rows=PAIRS)} o JOIN {SPECTRA.format(v="syn", rows=PAIRS)} s USING (rcv, frame, freq) GROUP BY o.shot""", "shot", "misfit")  # fmt: skip

# ---------------------------------------------------------------- imaging of stored fields

FIELDS = "(SELECT shot, it, rcv // 2 // 16 AS iz, rcv // 2 % 16 AS ix, obs AS p, syn AS a FROM " + PAIRS + ")"


def stored_fields(spark: SparkSession, d: str) -> tuple[SparkSession, str, str]:
    """Observed traces as the forward field, synthetic ones as the adjoint one, at cells numbered by pair."""
    cell = F.floor(F.col("rcv") / 2)
    made = pair_samples(spark, d).select("shot", "it", F.floor(cell / 16).alias("iz"), (cell % 16).alias("ix"), "obs", "syn")
    return spark, imaging.store_field(made.withColumnRenamed("obs", "p"), 8), imaging.store_field(made.withColumnRenamed("syn", "p"), 8)


add("image_cross_correlation", lambda s, d: imaging.cross_correlation(*stored_fields(s, d), 0.5), f"SELECT iz, ix, 0.5 * sum(p * a) AS image FROM {FIELDS} GROUP BY iz, ix", "iz ix", "image")
add("image_illuminated", lambda s, d: imaging.illuminated(*stored_fields(s, d), 0.5), f"SELECT iz, ix, image / greatest(energy, 0.5 * max(energy) OVER ()) AS image FROM (SELECT iz, ix, sum(p * a) AS image, sum(p * p) AS energy FROM {FIELDS} GROUP BY iz, ix)", "iz ix", "image")
