"""Rhythm screens, phases, profiles and method audits."""

from pyspark.sql import functions as F

from lapsegrid.operators import pairs as Q
from lapsegrid.operators import rhythm as Y
from lapsegrid.operators import stats as S
from lapsegrid.operators import tracks as K
from lapsegrid.sources.canonical import EVENTS_SQL, TRACES_SQL
from lapsegrid.workload.registry import query

PERIODS = Y.frequency_grid(14.0, 96.0, 24)
E2 = ["stem", "identity"]
METRICS = ["signal", "activity"]
_GRID = "pg(period_index, period) AS (VALUES " + ", ".join(f"({k}, {p!r}::DOUBLE)" for k, p in enumerate(PERIODS)) + ")"


def spectrum_sql(rows: str, keys: str) -> str:
    """Power per key and period over ``rows(keys, hours, value)``."""
    return f"""sts AS (SELECT {keys}, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM {rows} WHERE value IS NOT NULL GROUP BY ALL),
 sms AS (SELECT {keys}, period_index, period, any_value(n) AS n, any_value(v) AS v, sum((value-m)*cos(2*pi()*hours/period)) AS c, sum((value-m)*sin(2*pi()*hours/period)) AS s, sum(cos(4*pi()*hours/period)) AS c2, sum(sin(4*pi()*hours/period)) AS s2
 FROM {rows} JOIN sts USING ({keys}) CROSS JOIN pg WHERE value IS NOT NULL GROUP BY {keys}, period_index, period),
 rot AS (SELECT *, c*cos(atan2(s2,c2)/2)+s*sin(atan2(s2,c2)/2) AS yc, s*cos(atan2(s2,c2)/2)-c*sin(atan2(s2,c2)/2) AS ys, n/2.0+sqrt(c2*c2+s2*s2)/2 AS cc FROM sms),
 spc AS (SELECT {keys}, period_index, period, n, CASE WHEN v>1e-12 THEN (yc*yc/cc+CASE WHEN n-cc>1e-9 THEN ys*ys/(n-cc) ELSE 0.0 END)/(2*v) END AS power FROM rot)"""


def screen_sql(rows: str, keys: str, family: str, minimum: int = 10) -> str:
    return f"""{spectrum_sql(rows, keys)},
 bst AS (SELECT {keys}, first(period_index ORDER BY round(power,9) DESC, period_index) AS pi_, first(period ORDER BY round(power,9) DESC, period_index) AS per, first(power ORDER BY round(power,9) DESC, period_index) AS pow FROM spc WHERE power IS NOT NULL GROUP BY {keys}),
 prs AS (SELECT {keys}, count(value) AS observations, max(hours)-min(hours) AS span_hours FROM {rows} GROUP BY ALL),
 sc0 AS (SELECT {keys}, observations, span_hours, pi_, per, pow, CASE WHEN observations<{minimum} THEN 'insufficient' WHEN pow IS NULL THEN 'constant' ELSE 'tested' END AS status FROM prs LEFT JOIN bst USING ({keys})),
 sc1 AS (SELECT {keys}, observations, span_hours, status, CASE WHEN status='tested' THEN per END AS period, CASE WHEN status='tested' THEN pow END AS power, CASE WHEN status='tested' THEN pi_ IN (0,23) END AS search_edge, CASE WHEN status='tested' THEN 1-(1-exp(-pow))**24 END AS p_value FROM sc0),
 sc2 AS (SELECT *, coalesce(p_value,1.0) AS pp, count(*) OVER (PARTITION BY {family}) AS fs, count(*) OVER (PARTITION BY {family} ORDER BY coalesce(p_value,1.0)) AS rr FROM sc1),
 sc3 AS (SELECT *, CASE WHEN p_value IS NOT NULL THEN least(min(pp*fs/rr) OVER (PARTITION BY {family} ORDER BY pp DESC RANGE UNBOUNDED PRECEDING),1.0) END AS q_value FROM sc2),
 scr AS (SELECT {keys}, observations, span_hours, status, period, power, search_edge, p_value, q_value, CASE WHEN period<20 THEN 'ultradian' WHEN period<=28 THEN 'circadian' WHEN period IS NOT NULL THEN 'infradian' END AS period_class,
 span_hours/period AS cycles_covered, span_hours/period<2 AS underdetermined, coalesce(q_value<=0.05 AND NOT search_edge AND span_hours/period>=2, false) AS supported, CASE WHEN status<>'tested' THEN 'not_tested' WHEN q_value<=0.05 THEN 'significant' ELSE 'exploratory' END AS display FROM sc3)"""


SCREEN_D = "span_hours period power p_value q_value cycles_covered"
LONG = f"{TRACES_SQL}, {_GRID}, lg AS (SELECT stem, identity, hours, unnest(['signal','activity']) AS metric, unnest([signal, activity]) AS value FROM tr)"


def long_traces(i):
    return i.traces().select(*E2, "hours", *METRICS).unpivot([*E2, "hours"], METRICS, "metric", "value")


def screened(i):
    return Y.screen(long_traces(i), [*E2, "metric"], ["stem", "metric"], "value", PERIODS, 10)


@query("periodogram", f"WITH {LONG}, {spectrum_sql('lg', 'stem, identity, metric')} SELECT * FROM spc", "period power", digits=6)
def _(i):
    return Y.periodogram(long_traces(i), [*E2, "metric"], "value", PERIODS)


@query("rhythm_screen", f"WITH {LONG}, {screen_sql('lg', 'stem, identity, metric', 'stem, metric')} SELECT * FROM scr", SCREEN_D, digits=6)
def _(i):
    return screened(i)


_COS = """cs0 AS (SELECT stem, identity, count(*) AS n, avg(signal) AS y, avg(cos(2*pi()/24*hours)) AS c, avg(sin(2*pi()/24*hours)) AS s, var_pop(signal) AS vy, var_pop(cos(2*pi()/24*hours)) AS vc, var_pop(sin(2*pi()/24*hours)) AS vs,
 covar_pop(cos(2*pi()/24*hours), sin(2*pi()/24*hours)) AS cs, covar_pop(signal, cos(2*pi()/24*hours)) AS yc, covar_pop(signal, sin(2*pi()/24*hours)) AS ys FROM ev2 GROUP BY 1,2),
 cs1 AS (SELECT *, CASE WHEN n>3 AND vc*vs-cs*cs>1e-9 THEN (yc*vs-ys*cs)/(vc*vs-cs*cs) END AS a, CASE WHEN n>3 AND vc*vs-cs*cs>1e-9 THEN (ys*vc-yc*cs)/(vc*vs-cs*cs) END AS b FROM cs0),
 cs2 AS (SELECT *, y-a*c-b*s AS mesor, sqrt(a*a+b*b) AS amplitude, ((atan2(b,a)/(2*pi()))%1.0+1.0)%1.0 AS phase, CASE WHEN vy>1e-12 AND a IS NOT NULL THEN least(greatest((a*yc+b*ys)/vy,0.0),1.0) END AS r_squared FROM cs1),
 csn AS (SELECT stem, identity, n, mesor, amplitude, CASE WHEN abs(mesor)>1e-12 THEN amplitude/abs(mesor) END AS relative_amplitude, phase, phase*24 AS peak_hour, r_squared, (1-r_squared)**((n-3)/2) AS p_value FROM cs2)"""
EVV = f"{EVENTS_SQL}, ev2 AS (SELECT stem, identity, hours, cents/100.0::DOUBLE AS signal FROM ev)"


def raw(i):
    return i.events().select(*E2, "hours", (F.col("cents") / 100.0).alias("signal"))


@query("cosinor_fit", f"WITH {EVV}, {_COS} SELECT * FROM csn", "mesor amplitude relative_amplitude phase peak_hour r_squared p_value", digits=5)
def _(i):
    return Y.cosinor(raw(i), E2, "signal", 24.0)


@query(
    "population_phase",
    f"""WITH {EVV}, {_COS}, u AS (SELECT stem, 'all' AS subset, phase FROM csn WHERE phase IS NOT NULL UNION ALL SELECT stem, 'rhythmic', phase FROM csn WHERE phase IS NOT NULL AND p_value<=0.2),
 v AS (SELECT stem, subset, count(*) AS n, sqrt(avg(cos(2*pi()*phase))**2+avg(sin(2*pi()*phase))**2) AS vector_length, atan2(avg(sin(2*pi()*phase)),avg(cos(2*pi()*phase)))/(2*pi()) AS m FROM u GROUP BY 1,2)
 SELECT stem, subset, n, vector_length, (m%1.0+1.0)%1.0 AS mean_phase, least(exp(sqrt(1+4*n+4*(n*n-(n*vector_length)**2))-(1+2*n)),1.0) AS rayleigh_p FROM v""",
    "vector_length mean_phase rayleigh_p",
    digits=6,
)
def _(i):
    fits = Y.cosinor(raw(i), E2, "signal", 24.0)
    subsets = fits.withColumn("subset", F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("p_value") <= 0.2, F.lit("rhythmic"))))))
    return Y.population_phase(subsets, ["stem", "subset"])


@query(
    "null_false_positive_rates",
    f"""WITH {LONG}, s0 AS (SELECT stem, identity, metric, hours, value, unnest(range(1,4)) AS replicate FROM lg),
 s1 AS (SELECT *, row_number() OVER (PARTITION BY stem, identity, metric, replicate ORDER BY hours) AS p, row_number() OVER (PARTITION BY stem, identity, metric, replicate ORDER BY md5(concat_ws('|','23',replicate,stem,identity,metric,CAST(hours AS INTEGER))), hours) AS h FROM s0),
 both_ AS (SELECT stem, identity, metric, 0 AS replicate, hours, value FROM lg UNION ALL SELECT a.stem, a.identity, a.metric, a.replicate, a.hours, b.value FROM s1 a JOIN s1 b ON a.stem=b.stem AND a.identity=b.identity AND a.metric=b.metric AND a.replicate=b.replicate AND a.p=b.h),
 {screen_sql('both_', 'stem, identity, metric, replicate', 'stem, metric, replicate')}
 SELECT o.stem, o.metric, observed_rate, observed_rate_tests, null_rate, null_rate_tests, observed_rate-null_rate AS excess FROM (SELECT stem, metric, avg(CAST(p_value<=0.05 AS INTEGER)) AS observed_rate, count(*) AS observed_rate_tests FROM scr WHERE replicate=0 AND p_value IS NOT NULL GROUP BY 1,2) o
 JOIN (SELECT stem, metric, avg(CAST(p_value<=0.05 AS INTEGER)) AS null_rate, count(*) AS null_rate_tests FROM scr WHERE replicate>0 AND p_value IS NOT NULL GROUP BY 1,2) n USING (stem, metric)""",
    "observed_rate null_rate excess",
)
def _(i):
    from lapsegrid.plans.durable import cut
    from lapsegrid.plans.scan import redealt

    rows = long_traces(i)
    keys = [*E2, "metric", "replicate"]
    text = F.concat_ws("|", F.lit("23"), "replicate", *E2, "metric", F.col("hours").cast("int"))
    null = redealt(rows, [*E2, "metric"], ["hours"], text, 3, ["value"])
    # the screen reads its rows several times, and both rates read the screen
    both = cut(rows.withColumn("replicate", F.lit(0)).unionByName(null))
    out = cut(Y.screen(both, keys, ["stem", "metric", "replicate"], "value", PERIODS, 10).select("stem", "metric", "replicate", "p_value"))
    return Y.null_rates(out.where(F.col("replicate") == 0), out.where(F.col("replicate") > 0), ["stem", "metric"], 0.05)


_PROF = "pf AS (SELECT stem, identity, CAST(floor((hours%24)/1.0) AS INTEGER) AS bin, avg(signal) AS mean, count(*) AS n FROM (SELECT 'all' AS stem, identity, hours, signal FROM ev2) GROUP BY 1,2,3)"
_ROLL = "SELECT stem, identity, start, avg(mean) AS m, count(*) AS k FROM (SELECT *, unnest([(bin-k+24)%24 for k in range({w})]) AS start FROM pf) GROUP BY 1,2,3 HAVING count(*)={w}"


@query("day_profile", f"WITH {EVV}, {_PROF} SELECT * FROM pf", "mean")
def _(i):
    return Y.day_profile(raw(i).withColumn("stem", F.lit("all")), E2, "signal", 24)


@query(
    "nonparametric_day",
    f"""WITH {EVV}, {_PROF}, h AS (SELECT stem, identity, max(m) AS m10 FROM ({_ROLL.format(w=10)}) GROUP BY 1,2), l AS (SELECT stem, identity, min(m) AS l5 FROM ({_ROLL.format(w=5)}) GROUP BY 1,2),
 s AS (SELECT 'all' AS stem, identity, var_pop(signal) AS v, avg(signal) AS m, count(*) AS n FROM ev2 GROUP BY 2), b AS (SELECT stem, identity, sum((mean-m)**2)/count(*) AS b, count(*) AS bins FROM pf JOIN s USING (stem, identity) GROUP BY 1,2)
 SELECT s.stem, s.identity, s.n, bins, m10, l5, (m10-l5)/nullif(m10+l5,0) AS relative_amplitude, CASE WHEN v>1e-12 THEN b/v END AS interdaily_stability FROM s JOIN b USING (stem, identity) LEFT JOIN h USING (stem, identity) LEFT JOIN l USING (stem, identity)""",
    "m10 l5 relative_amplitude interdaily_stability",
    digits=7,
)
def _(i):
    return Y.nonparametric(raw(i).withColumn("stem", F.lit("all")), E2, "signal")


@query(
    "active_spans",
    f"""WITH {EVV}, {_PROF}, t AS (SELECT stem, identity, sum(mean) AS t FROM pf GROUP BY 1,2 HAVING count(*)=24), s AS (SELECT r.*, m-(t-m*8)/16.0 AS score FROM ({_ROLL.format(w=8)}) r JOIN t USING (stem, identity)),
 b AS (SELECT stem, identity, CAST(first(start ORDER BY round(score,9) DESC, start) AS INTEGER) AS o, first(score ORDER BY round(score,9) DESC, start) AS score FROM s GROUP BY 1,2)
 SELECT stem, identity, o AS onset_bin, CAST((o+8)%24 AS INTEGER) AS offset_bin, score, o AS from_bin, CAST(least(o+8,24) AS INTEGER) AS to_bin FROM b UNION ALL SELECT stem, identity, o, CAST((o+8)%24 AS INTEGER), score, 0, CAST(o+8-24 AS INTEGER) FROM b WHERE o+8>24""",
    "score",
    digits=10,
)
def _(i):
    return Y.active_spans(Y.day_profile(raw(i).withColumn("stem", F.lit("all")), E2, "signal", 24), E2, 24, 8)


SIG = f"{TRACES_SQL}, {_GRID}, sg AS (SELECT stem, identity, hours, signal AS value FROM tr)"


@query(
    "cycle_repeatability",
    f"""WITH {SIG}, {screen_sql('sg', 'stem, identity', 'stem')}, r AS (SELECT sg.*, (hours-min(hours) OVER (PARTITION BY stem, identity))/period AS t FROM sg JOIN scr USING (stem, identity) WHERE period IS NOT NULL),
 p AS (SELECT stem, identity, floor(t+1e-9) AS cyc, least(floor((t-floor(t+1e-9))*6+1e-9),5) AS bin, value FROM r WHERE floor(t+1e-9)<=1), b AS (SELECT stem, identity, bin, avg(value) FILTER (WHERE cyc=0) AS a, avg(value) FILTER (WHERE cyc=1) AS b FROM p GROUP BY 1,2,3)
 SELECT stem, identity, count(*) AS shared_bins, CASE WHEN count(*)>=4 AND stddev_pop(a)>1e-9*max(abs(a)) AND stddev_pop(b)>1e-9*max(abs(b)) THEN corr(a,b) END AS repeatability, avg(b)-avg(a) AS level_change FROM b WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1,2""",
    "repeatability level_change",
    digits=6,
)
def _(i):
    tr = i.traces().select(*E2, "hours", F.col("signal").alias("value"))
    fits = Y.screen(tr, E2, ["stem"], "value", PERIODS, 10)
    return Y.cycle_repeatability(tr, fits, E2, "value", 6, 4)


@query(
    "peak_aligned_composite",
    f"""WITH {EVV}, {_COS}, r AS (SELECT e.stem, CAST(floor((((hours-round(peak_hour,6))%24)+24)%24/3.0) AS INTEGER) AS bin, signal FROM ev2 e JOIN csn USING (stem, identity) WHERE peak_hour IS NOT NULL)
 SELECT stem, bin, avg(signal) AS mean, count(*) AS n, quantile_cont(signal,0.25) AS q25, quantile_cont(signal,0.75) AS q75 FROM r GROUP BY 1,2""",
    "mean q25 q75",
    digits=6,
)
def _(i):
    fits = Y.cosinor(raw(i), E2, "signal", 24.0)
    return Y.aligned_composite(raw(i), fits, E2, ["stem"], "signal", 24.0, 8)


@query("omitted_intervals", f"WITH {TRACES_SQL} SELECT stem, identity, hours, CASE WHEN NOT (hours BETWEEN 100 AND 150 OR hours BETWEEN 300 AND 312) THEN signal END AS signal, (hours BETWEEN 100 AND 150 OR hours BETWEEN 300 AND 312) AS omitted FROM tr", "hours signal")
def _(i):
    return Y.masked_intervals(i.traces().select(*E2, "hours", "signal"), "signal", [(100.0, 150.0), (300.0, 312.0)])


_AUDIT = f"""{TRACES_SQL}, {_GRID}, l AS (SELECT stem, identity, coalesce(regr_slope(signal, hours),0) AS b, avg(hours) AS t, avg(signal) AS m FROM tr GROUP BY 1,2),
 w AS (SELECT *, avg(signal) OVER (PARTITION BY stem, identity ORDER BY frame_index RANGE BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS rm, frame_index-lag(frame_index) OVER (PARTITION BY stem, identity ORDER BY frame_index) AS g, signal-lag(signal) OVER (PARTITION BY stem, identity ORDER BY frame_index) AS d FROM tr),
 ma AS (SELECT stem, identity, 'none' AS detrend, hours, signal AS value FROM tr UNION ALL SELECT stem, identity, 'linear', hours, signal-(m+b*(hours-t)) FROM tr JOIN l USING (stem, identity)
 UNION ALL SELECT stem, identity, 'running_mean', hours, signal-rm FROM w UNION ALL SELECT stem, identity, 'first_difference', hours, CASE WHEN g=1 THEN d END FROM w)"""


def detrended(i):
    tr = i.traces().select(*E2, "frame_index", "hours", "signal")
    part = lambda df, name, c: df.select(*E2, F.lit(name).alias("detrend"), "hours", F.col(c).alias("value"))
    out = part(tr, "none", "signal")
    out = out.unionByName(part(K.linear_detrend(tr, "signal"), "linear", "residual"))
    out = out.unionByName(part(K.running_baseline(tr, "signal", 8), "running_mean", "residual"))
    return out.unionByName(part(K.first_difference(tr, "signal"), "first_difference", "difference"))


@query("method_audit_grid", f"WITH {_AUDIT}, {screen_sql('ma', 'stem, identity, detrend', 'stem, detrend')} SELECT * FROM scr", SCREEN_D, digits=5)
def _(i):
    return Y.screen(detrended(i), [*E2, "detrend"], ["stem", "detrend"], "value", PERIODS, 10)


@query(
    "detection_agreement",
    f"""WITH {LONG}, {screen_sql('lg', 'stem, identity, metric', 'stem, metric')}, b AS (SELECT stem, identity, max(CAST(supported AS INTEGER)) FILTER (WHERE metric='signal' AND status='tested') AS a, max(CAST(supported AS INTEGER)) FILTER (WHERE metric='activity' AND status='tested') AS b FROM scr GROUP BY 1,2)
 SELECT stem, CASE WHEN a IS NULL AND b IS NULL THEN 'both_missing' WHEN a IS NULL THEN 'first_missing' WHEN b IS NULL THEN 'second_missing' WHEN a=1 AND b=1 THEN 'both' WHEN a=1 THEN 'first_only' WHEN b=1 THEN 'second_only' ELSE 'neither' END AS category, count(*) AS entities FROM b GROUP BY 1,2""",
)
def _(i):
    return Y.detection_agreement(screened(i), ("signal", "activity"), E2)


@query(
    "rhythm_membership",
    f"""WITH {LONG}, {screen_sql('lg', 'stem, identity, metric', 'stem, metric')} SELECT stem, identity, count(*) FILTER (WHERE status='tested') AS tests, CASE WHEN bool_or(supported) THEN 'any_significant' WHEN count(*) FILTER (WHERE status='tested')=2 THEN 'none_significant' ELSE 'untestable' END AS membership FROM scr GROUP BY 1,2""",
)
def _(i):
    return Y.any_significant(screened(i), E2, 2)


@query(
    "screen_overview",
    f"""WITH {LONG}, {screen_sql('lg', 'stem, identity, metric', 'stem, metric')} SELECT stem, metric, count(*) AS tests, count(*) FILTER (WHERE status='tested') AS valid_tests, count(*) FILTER (WHERE q_value<=0.9)/nullif(count(*) FILTER (WHERE status='tested'),0) AS detected_fraction, quantile_cont(period,0.5) FILTER (WHERE q_value<=0.9) AS median_period FROM scr GROUP BY 1,2""",
    "detected_fraction median_period",
)
def _(i):
    from lapsegrid.functions.numeric import ratio
    from lapsegrid.plans.ranks import quantiles

    s = screened(i)
    hit = F.col("q_value") <= 0.9
    base = s.groupBy("stem", "metric").agg(
        F.count(F.lit(1)).alias("tests"), F.sum((F.col("status") == "tested").cast("long")).alias("valid_tests"), F.sum(F.coalesce(hit.cast("long"), F.lit(0))).alias("h")
    )
    med = quantiles(s.where(hit), ["stem", "metric"], "period", {"median_period": 0.5}).drop("total")
    return base.join(med, ["stem", "metric"], "left").withColumn("detected_fraction", ratio("h", "valid_tests")).drop("h")


# --- scoring of screens against declared truth -------------------------------------------------------------

_CASES = f"""cases AS (SELECT CAST(identity AS VARCHAR) AS case_id, identity % 7 AS family, CASE WHEN identity % 3 = 0 THEN NULL WHEN identity % 3 = 1 THEN 24.0 ELSE 48.0 END AS true_period FROM (SELECT DISTINCT identity FROM lg)),
 prd AS (SELECT CAST(identity AS VARCHAR) AS case_id, period, p_value<=0.9 AS detected FROM scr WHERE metric='signal' AND status='tested'),
 scd AS (SELECT cases.*, period, detected, CASE WHEN detected IS NULL THEN 'unavailable' WHEN true_period IS NULL AND detected THEN 'false_alarm' WHEN true_period IS NULL THEN 'true_negative' WHEN NOT detected THEN 'missed' WHEN abs(period-true_period)<=0.2*true_period THEN 'recovered'
 WHEN abs(period-true_period/2)<=0.2*true_period/2 OR abs(period-true_period*2)<=0.2*true_period*2 THEN 'alias' ELSE 'wrong_period' END AS score FROM cases LEFT JOIN prd USING (case_id))"""


def scored(i):
    ids = i.traces().select("identity").distinct()
    kind = F.col("identity") % 3
    cases = ids.select(F.col("identity").cast("string").alias("case_id"), (F.col("identity") % 7).alias("family"), F.when(kind == 1, F.lit(24.0)).when(kind == 2, F.lit(48.0)).alias("true_period"))
    said = screened(i).where((F.col("metric") == "signal") & (F.col("status") == "tested")).select(
        F.col("identity").cast("string").alias("case_id"), "period", (F.col("p_value") <= 0.9).alias("detected")
    )
    return S.score_cases(cases, said, 0.2)


@query("scored_cases", f"WITH {LONG}, {screen_sql('lg', 'stem, identity, metric', 'stem, metric')}, {_CASES} SELECT * FROM scd", "true_period period")
def _(i):
    return scored(i)


@query("weighted_recovery_rate", f"WITH {LONG}, {screen_sql('lg', 'stem, identity, metric', 'stem, metric')}, {_CASES} SELECT true_period, avg(r) AS rate, count(*) AS blocks, CAST(sum(n) AS BIGINT) AS cases FROM (SELECT true_period, family, avg(CASE WHEN score='recovered' THEN 1.0 ELSE 0.0 END) AS r, count(*) AS n FROM scd GROUP BY 1,2) GROUP BY 1", "true_period rate")
def _(i):
    return S.weighted_rate(scored(i), ["true_period"], F.col("score") == "recovered", "family")


@query(
    "altered_input_sensitivity",
    f"""WITH {TRACES_SQL}, {_GRID}, r AS (SELECT *, (hours-min(hours) OVER (PARTITION BY stem, identity))/nullif(max(hours) OVER (PARTITION BY stem, identity)-min(hours) OVER (PARTITION BY stem, identity),0) AS f FROM tr),
 bt AS (SELECT stem, identity, 'original' AS variant, hours, signal AS value FROM r UNION ALL SELECT stem, identity, 'altered', hours, signal FROM r WHERE NOT coalesce(f>=0.4 AND f<0.6, false)), {screen_sql('bt', 'stem, identity, variant', 'stem, variant')}
 SELECT o.stem, o.identity, o.period AS original_period, a.period AS altered_period, o.p_value<=0.9 AS original_call, a.p_value<=0.9 AS altered_call, (o.p_value<=0.9)=(a.p_value<=0.9) AS same_call, abs(o.period-a.period) AS period_shift FROM scr o JOIN scr a ON a.stem=o.stem AND a.identity=o.identity AND o.variant='original' AND a.variant='altered'""",
    "original_period altered_period period_shift",
)
def _(i):
    tr = i.traces().select(*E2, "hours", F.col("signal").alias("value"))
    span = tr.groupBy(*E2).agg(F.min("hours").alias("a"), F.max("hours").alias("b"))
    f = F.try_divide(F.col("hours") - F.col("a"), F.col("b") - F.col("a"))
    cut = tr.join(span, E2).where(~F.coalesce((f >= 0.4) & (f < 0.6), F.lit(False))).drop("a", "b")
    both = tr.withColumn("variant", F.lit("original")).unionByName(cut.withColumn("variant", F.lit("altered")))
    s = Y.screen(both, [*E2, "variant"], ["stem", "variant"], "value", PERIODS, 10)
    side = lambda v: s.where(F.col("variant") == v).select(*E2, F.col("period").alias(f"{v}_period"), (F.col("p_value") <= 0.9).alias(f"{v}_call"))
    return side("original").join(side("altered"), E2).withColumn("same_call", F.col("original_call") == F.col("altered_call")).withColumn(
        "period_shift", F.abs(F.col("original_period") - F.col("altered_period"))
    )


_RCP = f"""rc0 AS (SELECT detrend AS recipe, CASE WHEN identity % 2 = 0 THEN 'even' ELSE 'odd' END AS scope, CAST(count(*) AS BIGINT) AS cases, avg(CAST(status='tested' AS INTEGER)) AS support, avg(CASE WHEN cycles_covered>=5 THEN 1.0 ELSE 0.0 END) AS coverage, avg(CASE WHEN p_value<=0.05 THEN 1.0 ELSE 0.0 END) AS false_alarm, avg(CASE WHEN p_value<=0.5 THEN 1.0 ELSE 0.0 END) AS recovery FROM scr GROUP BY 1,2),
 rc AS (SELECT recipe, scope, cases, round(support,9) AS support, round(coverage,9) AS coverage, round(false_alarm,9) AS false_alarm, round(recovery,9) AS recovery FROM rc0),
 gt AS (SELECT *, CASE WHEN cases<10 THEN 'insufficient' WHEN support>=0.9 THEN 'pass' ELSE 'fail' END AS support_gate, CASE WHEN cases<10 THEN 'insufficient' WHEN coverage>=0.5 THEN 'pass' ELSE 'fail' END AS coverage_gate, CASE WHEN cases<10 THEN 'insufficient' WHEN false_alarm<=0.2 THEN 'pass' ELSE 'fail' END AS false_alarm_gate FROM rc),
 ad AS (SELECT *, support_gate='pass' AND coverage_gate='pass' AND false_alarm_gate='pass' AS admissible FROM gt),
 ud AS (SELECT a.*, a.admissible AND NOT EXISTS (SELECT 1 FROM ad b WHERE b.scope=a.scope AND b.admissible AND b.recovery>=a.recovery AND b.false_alarm<=a.false_alarm AND (b.recovery>a.recovery OR b.false_alarm<a.false_alarm)) AS undominated FROM ad a)"""


@query(
    "recipe_selection",
    f"""WITH {_AUDIT}, {screen_sql('ma', 'stem, identity, detrend', 'stem, detrend')}, {_RCP}, k AS (SELECT scope, count(*) FILTER (WHERE undominated) AS k, bool_or(support_gate='insufficient') AS i FROM ud GROUP BY 1)
 SELECT ud.*, CASE WHEN k=1 THEN 'provisional_choice' WHEN k>1 THEN 'tie' WHEN i THEN 'insufficient' ELSE 'none_acceptable' END AS outcome FROM ud JOIN k USING (scope)""",
    "support coverage false_alarm recovery",
)
def _(i):
    s = Y.screen(detrended(i), [*E2, "detrend"], ["stem", "detrend"], "value", PERIODS, 10)
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 9)
    summary = s.groupBy(F.col("detrend").alias("recipe"), F.when(F.col("identity") % 2 == 0, "even").otherwise("odd").alias("scope")).agg(
        F.count(F.lit(1)).alias("cases"), share(F.col("status") == "tested").alias("support"), share(F.col("cycles_covered") >= 5).alias("coverage"),
        share(F.col("p_value") <= 0.05).alias("false_alarm"), share(F.col("p_value") <= 0.5).alias("recovery"),
    )
    return S.select_recipes(summary, 0.9, 0.5, 0.2, 10)
