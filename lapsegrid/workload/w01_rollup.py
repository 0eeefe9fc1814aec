"""Roll-ups, windows, distributions and unit ledgers."""

from pyspark.sql import functions as F

from lapsegrid.operators import rollup as R
from lapsegrid.sources.canonical import DAILY_SQL, TRACES_SQL, clock_sql
from lapsegrid.workload.registry import query

WINDOWS = [
    R.DeclaredWindow("first_third", 0, 240),
    R.DeclaredWindow("middle_third", 240, 480, baseline="first_third"),
    R.DeclaredWindow("last_third", 20, 30, unit="frames", baseline="first_third"),
    R.DeclaredWindow("whole", 0, 720),
]
METRICS = ["signal", "activity"]

_STATS = """count(*) AS observed_frames, min(frame_index) AS first_frame_index, max(frame_index) AS last_frame_index,
 min(hours) AS first_hour, max(hours) AS last_hour, avg(signal) AS signal_mean, stddev_samp(signal) AS signal_sd,
 avg(activity) AS activity_mean, stddev_samp(activity) AS activity_sd,
 quantile_cont(signal, 0.5) AS signal_median, quantile_cont(signal, 0.75)-quantile_cont(signal, 0.25) AS signal_iqr,
 quantile_cont(activity, 0.5) AS activity_median, quantile_cont(activity, 0.75)-quantile_cont(activity, 0.25) AS activity_iqr,
 CAST(max(frame_index)-min(frame_index)+1 AS BIGINT) AS span_frames,
 CAST(max(frame_index)-min(frame_index)+1-count(*) AS BIGINT) AS gap_frames,
 count(*)/(max(frame_index)-min(frame_index)+1) AS coverage"""
_DOUBLES = "first_hour last_hour signal_mean signal_sd activity_mean activity_sd signal_median signal_iqr activity_median activity_iqr coverage"
ENT = f"ent AS (SELECT stem, identity, {_STATS} FROM obs GROUP BY 1,2)"
WIN = f"""win AS (SELECT stem, identity, w.name AS "window", {_STATS}, w.hi - w.lo AS window_hours,
 CAST(ceil((w.hi-w.lo)/24.0) AS BIGINT) AS window_frames, count(*)/ceil((w.hi-w.lo)/24.0) AS window_coverage
 FROM obs JOIN (VALUES ('first_third',0.0,240.0),('middle_third',240.0,480.0),('last_third',480.0,720.0),('whole',0.0,720.0)) w(name,lo,hi)
 ON hours >= w.lo AND hours < w.hi GROUP BY stem, identity, w.name, w.lo, w.hi)"""


def _entities(i):
    return R.entity_rollup(i.daily(), METRICS)


def _frames(i):
    return i.recordings().select("stem", F.explode(F.sequence(F.lit(0), F.col("n_frames") - 1)).alias("frame_index"))


@query("entity_rollup", f"WITH {DAILY_SQL}, {ENT} SELECT * FROM ent", _DOUBLES)
def _(i):
    return _entities(i)


@query(
    "frame_rollup",
    f"""WITH {DAILY_SQL} SELECT c.stem, c.frame_index, coalesce(n, 0) AS entities, signal_mean, activity_mean, signal_median, activity_median
 FROM (SELECT stem, CAST(unnest(range(n_frames)) AS INTEGER) AS frame_index FROM {clock_sql('obs')}) c
 LEFT JOIN (SELECT stem, frame_index, count(*) AS n, avg(signal) AS signal_mean, avg(activity) AS activity_mean,
 quantile_cont(signal, 0.5) AS signal_median, quantile_cont(activity, 0.5) AS activity_median FROM obs GROUP BY 1,2) o
 ON c.stem=o.stem AND c.frame_index=o.frame_index""",
    "signal_mean activity_mean signal_median activity_median",
)
def _(i):
    return R.frame_rollup(i.daily(), _frames(i), METRICS)


@query(
    "recording_rollup",
    f"""WITH {DAILY_SQL}, {ENT}, pf AS (SELECT stem, frame_index, count(*) AS present FROM obs GROUP BY 1,2),
 f AS (SELECT stem, count(*) AS frames_with_data, max(present) AS most_present, quantile_cont(CAST(present AS DOUBLE), 0.5) AS median_present FROM pf GROUP BY 1),
 e AS (SELECT stem, count(*) AS entities, CAST(sum(observed_frames) AS BIGINT) AS observations, CAST(sum(gap_frames) AS BIGINT) AS gap_frames,
 count(*) FILTER (WHERE observed_frames = n_frames) AS present_every_frame, min(first_frame_index) AS first_frame_index, max(last_frame_index) AS last_frame_index FROM ent JOIN {clock_sql('obs')} USING (stem) GROUP BY 1)
 SELECT * FROM e JOIN f USING (stem)""",
    "median_present",
)
def _(i):
    obs = i.daily()
    entities = obs.groupBy(*R.ENTITY).agg(
        F.count(F.lit(1)).alias("observed_frames"),
        F.min("frame_index").alias("first_frame_index"),
        F.max("frame_index").alias("last_frame_index"),
        (F.max("frame_index") - F.min("frame_index") + 1 - F.count(F.lit(1))).alias("gap_frames"),
    )
    return R.recording_rollup(entities, obs, i.recordings())


@query("windowed_rollup", f"WITH {DAILY_SQL}, {WIN} SELECT * FROM win", _DOUBLES + " window_hours window_coverage")
def _(i):
    return R.windowed_rollup(i.daily(), WINDOWS, METRICS, 24.0)


_STATISTICS = ["signal_median", "signal_mean", "activity_mean", "activity_sd"]
CHANGES = f"""lng AS (UNPIVOT (SELECT stem, identity, "window", window_coverage, signal_median, signal_mean, activity_mean, activity_sd FROM win)
 ON signal_median, signal_mean, activity_mean, activity_sd INTO NAME statistic VALUE value),
 chg AS (SELECT a.stem, a.identity, a."window", a.statistic, a.value, 'first_third' AS baseline_window, b.value AS baseline,
 a.value-b.value AS difference, CASE WHEN b.value <> 0 THEN a.value/b.value END AS ratio, a.window_coverage
 FROM lng a JOIN lng b ON a.stem=b.stem AND a.identity=b.identity AND a.statistic=b.statistic AND b."window"='first_third'
 WHERE a."window" IN ('middle_third','last_third'))"""


def _changes(i):
    rolled = R.windowed_rollup(i.daily(), WINDOWS, METRICS, 24.0)
    return rolled, R.window_changes(rolled, WINDOWS, _STATISTICS)


@query("window_changes", f"WITH {DAILY_SQL}, {WIN}, {CHANGES} SELECT * EXCLUDE (window_coverage) FROM chg", "value baseline difference ratio")
def _(i):
    return _changes(i)[1]


@query(
    "scaled_window_changes",
    f"""WITH {DAILY_SQL}, {WIN}, {CHANGES}, b AS (SELECT stem, statistic, value FROM lng WHERE "window"='first_third'),
 p AS (SELECT stem, statistic, quantile_cont(value, 0.5) AS population_median, quantile_cont(value, 0.25) AS population_q25 FROM b GROUP BY 1,2)
 SELECT chg.*, population_median, population_q25, difference/population_median AS scaled_change FROM chg JOIN p USING (stem, statistic)
 WHERE population_median > 0 AND population_q25 > 0 AND window_coverage >= 0.3""",
    "value baseline difference ratio window_coverage population_median population_q25 scaled_change",
)
def _(i):
    rolled, changes = _changes(i)
    covered = changes.join(rolled.select(*R.ENTITY, "window", "window_coverage"), [*R.ENTITY, "window"])
    baselines = rolled.where(F.col("window") == "first_third").select("stem", *_STATISTICS).unpivot(
        ["stem"], _STATISTICS, "statistic", "baseline"
    )
    return R.scaled_changes(covered, baselines, 0.3)


@query(
    "trait_ratio",
    f"""WITH {DAILY_SQL}, {ENT}, q AS (SELECT stem, count(signal_median) AS entities, quantile_cont(signal_iqr, 0.5) AS within_iqr,
 quantile_cont(signal_median, 0.75)-quantile_cont(signal_median, 0.25) AS between_iqr FROM ent GROUP BY 1)
 SELECT *, within_iqr/nullif(between_iqr,0) AS ratio, CASE WHEN nullif(between_iqr,0) IS NULL OR within_iqr IS NULL THEN 'undefined'
 WHEN within_iqr/between_iqr < 0.5 THEN 'trait-like' WHEN within_iqr/between_iqr <= 1.0 THEN 'mixed' ELSE 'state-like' END AS trait_class FROM q""",
    "within_iqr between_iqr ratio",
)
def _(i):
    return R.trait_ratio(_entities(i), ["stem"], "signal")


@query(
    "declared_histogram",
    f"""WITH {DAILY_SQL}, e(bin, lo, hi) AS (VALUES (0,0.0,10.0),(1,10.0,20.0),(2,20.0,50.0),(3,50.0,100.0),(4,100.0,500.0))
 SELECT s.stem, e.bin, CAST(e.lo AS DOUBLE) AS lo, CAST(e.hi AS DOUBLE) AS hi, count(o.signal) AS n FROM (SELECT DISTINCT stem FROM obs) s CROSS JOIN e
 LEFT JOIN obs o ON o.stem=s.stem AND o.signal>=e.lo AND (o.signal<e.hi OR (e.bin=4 AND o.signal<=e.hi)) GROUP BY 1,2,3,4""",
    "lo hi",
)
def _(i):
    return R.histogram(i.daily(), ["stem"], "signal", [0, 10, 20, 50, 100, 500])


_EVEN = """s AS (SELECT stem, min({v}) AS lo0, max({v}) AS hi0 FROM {t} GROUP BY 1),
 h AS (SELECT o.stem, CAST(least(floor(({v}-lo0)/((hi0-lo0)/10.0)), 9) AS INTEGER) AS bin, count(*) AS n FROM {t} o JOIN s USING (stem) GROUP BY 1,2)
 SELECT g.stem, g.bin, {f}(lo0+g.bin*((hi0-lo0)/10.0)) AS lo, {f}(lo0+(g.bin+1)*((hi0-lo0)/10.0)) AS hi, coalesce(n,0) AS n
 FROM (SELECT *, CAST(unnest(range(10)) AS INTEGER) AS bin FROM s) g LEFT JOIN h USING (stem, bin)"""


@query("linear_histogram", f"WITH {DAILY_SQL}, " + _EVEN.format(v="signal", f="", t="obs"), "lo hi")
def _(i):
    return R.even_histogram(i.daily(), ["stem"], "signal", 10)


@query("log_histogram", f"WITH {DAILY_SQL}, " + _EVEN.format(v="ln(signal)", f="exp", t="(SELECT * FROM obs WHERE signal > 0)"), "lo hi")
def _(i):
    return R.even_histogram(i.daily(), ["stem"], "signal", 10, log=True)


_UNITS = """SELECT r.r_name AS region, c.c_mktsegment AS segment, n.n_name AS nation, {agg} AS unit_value, count(c.c_acctbal) AS "rows"
 FROM customer c JOIN nation n ON c.c_nationkey=n.n_nationkey JOIN region r ON n.n_regionkey=r.r_regionkey GROUP BY 1,2,3"""


def customers(i):
    """Customers with their nation and region. Both dimensions are fixed small tables of the schema, and the
    adaptive planner broadcasts them only after seeing their size."""
    nation = i.table("nation").join(i.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return i.table("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.col("c_mktsegment").alias("segment"),
        F.col("c_custkey").alias("unit"), F.col("c_acctbal").alias("value"),
    )


@query("unit_ledger_mean", _UNITS.format(agg="avg(c.c_acctbal)"), "unit_value")
def _(i):
    return R.unit_ledger(customers(i), ["region", "segment"], ["nation"], "value", "mean")


@query("unit_ledger_median", _UNITS.format(agg="quantile_cont(c.c_acctbal, 0.5)"), "unit_value")
def _(i):
    return R.unit_ledger(customers(i), ["region", "segment"], ["nation"], "value", "median")


@query(
    "two_stage_mean",
    """WITH u AS (SELECT r.r_name AS region, n.n_name AS nation, avg(c_acctbal) AS m, count(c_acctbal) AS n, count(*) AS k FROM customer c
 JOIN nation n ON c.c_nationkey=n.n_nationkey JOIN region r ON n.n_regionkey=r.r_regionkey GROUP BY 1,2)
 SELECT region, avg(CASE WHEN n >= 50 THEN m END) AS value, count(*) FILTER (WHERE n >= 50) AS eligible_units, count(*) AS units, CAST(sum(k) AS BIGINT) AS "rows" FROM u GROUP BY 1""",
    "value",

)
def _(i):
    return R.two_stage_mean(customers(i), ["nation"], ["region"], "value", minimum=50)


for _band, _expr in {
    "sd": "avg(signal)-stddev_samp(signal) AS low, avg(signal)+stddev_samp(signal) AS high, avg(signal) AS centre",
    "sem": "avg(signal)-stddev_samp(signal)/sqrt(count(signal)) AS low, avg(signal)+stddev_samp(signal)/sqrt(count(signal)) AS high, avg(signal) AS centre",
    "iqr": "quantile_cont(signal,0.25) AS low, quantile_cont(signal,0.75) AS high, quantile_cont(signal,0.5) AS centre",
}.items():
    query(
        f"group_timecourse_{_band}",
        f"WITH {DAILY_SQL} SELECT stem, frame_index, count(signal) AS n, {_expr} FROM obs GROUP BY 1,2",
        "low high centre",
    )(lambda i, band=_band: R.group_timecourse(i.daily(), ["stem"], "frame_index", "signal", band))
