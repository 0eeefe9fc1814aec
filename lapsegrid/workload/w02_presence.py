"""Presence, gaps, bouts, episodes and exposures."""

from pyspark.sql import functions as F

from lapsegrid.operators import presence as P
from lapsegrid.sources.canonical import DAILY_SQL, EVENTS_SQL, TRACES_SQL, clock_sql
from lapsegrid.workload.registry import query

LIFE = "life AS (SELECT stem, identity, min(frame_index) AS f0, max(frame_index) AS f1, count(*) AS observed FROM obs GROUP BY 1,2), rec AS " + clock_sql("obs")
CALLS = f"""{LIFE}, calls AS (SELECT g.stem, g.identity, g.frame_index, CASE WHEN o.stem IS NOT NULL THEN 'named'
 WHEN g.frame_index BETWEEN f0 AND f1 THEN 'unclaimed' ELSE 'outside_lifespan' END AS state, f0 AS first_frame_index, f1 AS last_frame_index
 FROM (SELECT life.*, CAST(unnest(range(n_frames)) AS INTEGER) AS frame_index FROM life JOIN rec USING (stem)) g LEFT JOIN obs o USING (stem, identity, frame_index))"""
GAPS = """stp AS (SELECT *, lead(frame_index) OVER (PARTITION BY stem, identity ORDER BY frame_index) AS nf FROM obs),
 gaps AS (SELECT stem, identity, CAST(frame_index+1 AS INTEGER) AS gap_start, CAST(nf-1 AS INTEGER) AS gap_end, CAST(nf-frame_index-1 AS BIGINT) AS gap_frames FROM stp WHERE nf-frame_index>1)"""
AUDIT = f"""{LIFE}, {GAPS}, audit AS (SELECT l.stem, l.identity, observed, n_frames-observed AS missing, (n_frames-observed)/CAST(n_frames AS DOUBLE) AS missing_fraction,
 coalesce(lg,0) AS longest_gap, coalesce(ng,0) AS gaps, coalesce(im,0) AS internal_missing, CAST(f0 AS BIGINT) AS leading_missing, CAST(n_frames-1-f1 AS BIGINT) AS trailing_missing
 FROM life l JOIN rec USING (stem) LEFT JOIN (SELECT stem, identity, max(gap_frames) AS lg, count(*) AS ng, CAST(sum(gap_frames) AS BIGINT) AS im FROM gaps GROUP BY 1,2) g USING (stem, identity)),
 elig AS (SELECT *, concat_ws(';', CASE WHEN longest_gap > 8 THEN 'gap_frames' END, CASE WHEN longest_gap*24.0 > 168 THEN 'gap_hours' END,
 CASE WHEN missing > 22 THEN 'missing_frames' END, CASE WHEN missing_fraction >= 0.6 THEN 'missing_fraction' END) AS reasons FROM audit)"""


@query("presence_roll_call", f"WITH {DAILY_SQL}, {CALLS} SELECT * FROM calls")
def _(i):
    return P.roll_call(i.daily(), i.recordings())


@query(
    "presence_by_frame",
    f"""WITH {DAILY_SQL}, {CALLS} SELECT stem, frame_index, count(*) FILTER (WHERE state='named') AS identities_named,
 count(*) FILTER (WHERE state='unclaimed') AS identities_unclaimed, count(*) FILTER (WHERE state<>'outside_lifespan') AS identities_expected, count(*) AS identities_total FROM calls GROUP BY 1,2""",
)
def _(i):
    return P.roll_call_by_frame(P.roll_call(i.daily(), i.recordings()))


@query("presence_audit", f"WITH {DAILY_SQL}, {AUDIT} SELECT * FROM audit", "missing_fraction")
def _(i):
    return P.presence_audit(i.daily(), i.recordings())


def eligible(i):
    return P.eligibility(P.presence_audit(i.daily(), i.recordings()), 24.0, 168, 8, 22, 0.6)


@query("eligibility_audit", f"WITH {DAILY_SQL}, {AUDIT} SELECT *, reasons = '' AS eligible FROM elig", "missing_fraction")
def _(i):
    return eligible(i)


@query(
    "eligible_rows_only",
    f"WITH {DAILY_SQL}, {AUDIT} SELECT obs.* FROM obs JOIN elig USING (stem, identity) WHERE reasons = ''",
    "hours signal activity",
)
def _(i):
    return P.without_ineligible(i.daily(), eligible(i))


@query(
    "observed_frame_runs",
    f"""WITH {DAILY_SQL}, r AS (SELECT stem, identity, frame_index, frame_index - row_number() OVER (PARTITION BY stem, identity ORDER BY frame_index) AS g FROM obs),
 q AS (SELECT stem, identity, g, min(frame_index) AS start_frame, max(frame_index) AS end_frame, count(*) AS frames FROM r GROUP BY 1,2,3)
 SELECT stem, identity, row_number() OVER (PARTITION BY stem, identity ORDER BY start_frame) AS run, start_frame, end_frame, frames FROM q""",
)
def _(i):
    return P.frame_runs(i.daily())


@query(
    "longest_observed_run",
    f"""WITH {DAILY_SQL}, r AS (SELECT stem, identity, frame_index - row_number() OVER (PARTITION BY stem, identity ORDER BY frame_index) AS g FROM obs),
 q AS (SELECT stem, identity, g, count(*) AS n FROM r GROUP BY 1,2,3) SELECT stem, identity, max(n) AS longest_run, count(*) AS runs FROM q GROUP BY 1,2""",
)
def _(i):
    return P.longest_run(i.daily())


EXPL = """gf AS (SELECT stem, identity, gap_start, gap_end, CAST(unnest(range(gap_start, gap_end+1)) AS INTEGER) AS frame_index FROM gaps),
 expl AS (SELECT a.stem, a.identity, a.frame_index, min(b.stem) AS mechanism FROM gf a JOIN obs b ON a.identity=b.identity AND a.frame_index=b.frame_index AND a.stem<>b.stem GROUP BY 1,2,3)"""


def _explanations(i, gaps):
    """What else the entity was seen doing on each missing day (the first other kind by name)."""
    other = i.daily().select(F.col("stem").alias("other"), "identity", "frame_index")
    return (
        P.gap_frames(gaps).join(other, ["identity", "frame_index"]).where(F.col("other") != F.col("stem"))
        .groupBy("stem", "identity", "frame_index").agg(F.min("other").alias("mechanism"))
    )


@query("gap_frames_explained", f"WITH {DAILY_SQL}, {GAPS}, {EXPL} SELECT gf.*, coalesce(mechanism, 'unexplained') AS mechanism FROM gf LEFT JOIN expl USING (stem, identity, frame_index)")
def _(i):
    gaps = P.gap_intervals(i.daily())
    return (
        P.gap_frames(gaps).drop("gap_frames").join(_explanations(i, gaps), ["stem", "identity", "frame_index"], "left")
        .withColumn("mechanism", F.coalesce("mechanism", F.lit("unexplained")))
    )


@query(
    "persistence_events",
    f"""WITH {DAILY_SQL}, {LIFE}, {GAPS}, {EXPL}, v AS (SELECT stem, identity, gap_start, gap_end, mechanism, count(*) AS n FROM gf LEFT JOIN expl USING (stem, identity, frame_index) GROUP BY 1,2,3,4,5),
 b AS (SELECT stem, identity, gap_start, gap_end, first(mechanism ORDER BY n DESC, mechanism) FILTER (WHERE mechanism IS NOT NULL) AS m FROM v GROUP BY 1,2,3,4)
 SELECT stem, identity, 'temporary_absence' AS event, gap_start AS frame_index, gap_end, coalesce(m, 'unexplained') AS explanation FROM b
 UNION ALL SELECT l.stem, l.identity, 'silent_ending', l.f1, NULL, coalesce(e.m, 'unexplained') FROM life l
 LEFT JOIN (SELECT a.stem, a.identity, min(b.stem) AS m FROM life a JOIN obs b ON a.identity=b.identity AND b.frame_index=a.f1+1 AND a.stem<>b.stem GROUP BY 1,2) e USING (stem, identity)""",
)
def _(i):
    obs = i.daily()
    gaps, spans = P.gap_intervals(obs), P.lifespans(obs)
    after = obs.select(F.col("stem").alias("other"), "identity", (F.col("frame_index") - 1).alias("last_frame_index"))
    endings = (
        spans.join(after, ["identity", "last_frame_index"]).where(F.col("other") != F.col("stem"))
        .groupBy("stem", "identity").agg(F.min("other").alias("mechanism"))
    )
    return P.persistence_events(gaps, _explanations(i, gaps), spans, endings)


@query(
    "adjacent_edges",
    f"""WITH {EVENTS_SQL}, s AS (SELECT *, lead(hours) OVER (PARTITION BY stem, identity ORDER BY hours) AS to_hours FROM ev),
 t AS (SELECT stem, identity, hours, to_hours, to_hours-hours AS step_hours FROM s WHERE to_hours IS NOT NULL),
 m AS (SELECT stem, identity, quantile_cont(step_hours, 0.5) AS median_step FROM t GROUP BY 1,2)
 SELECT * FROM t JOIN m USING (stem, identity) WHERE step_hours <= median_step*1.5""",
    "hours to_hours step_hours median_step",
    digits=4,
)
def _(i):
    return P.adjacent_edges(i.events().select("stem", "identity", "hours"))


@query(
    "contiguous_sequences",
    f"""WITH {EVENTS_SQL}, s AS (SELECT *, cents >= 100 AS ok, lag(hours) OVER w AS p, lag(cents >= 100) OVER w AS po FROM ev WINDOW w AS (PARTITION BY stem, identity ORDER BY hours)),
 g AS (SELECT *, sum(CASE WHEN p IS NULL OR hours-p > 48 OR NOT po THEN 1 ELSE 0 END) OVER (PARTITION BY stem, identity ORDER BY hours) AS r FROM s),
 q AS (SELECT stem, identity, r, count(*) AS "rows", min(hours) AS "start", max(hours) AS "end" FROM g WHERE ok GROUP BY 1,2,3)
 SELECT stem, identity, row_number() OVER (PARTITION BY stem, identity ORDER BY "start") AS sequence, "rows", "start", "end" FROM q""",
    '"start" "end"',
    digits=4,
)
def _(i):
    return P.sequences(i.events(), "hours", 48.0, F.col("cents") >= 100)


@query(
    "support_intervals",
    f"""WITH {TRACES_SQL}, s AS (SELECT stem, identity, hours AS to_hours, frame_index, lag(hours) OVER w AS from_hours, lag(frame_index) OVER w AS ff FROM tr WINDOW w AS (PARTITION BY stem, identity ORDER BY frame_index)),
 r AS (SELECT *, CASE WHEN from_hours < 200 OR to_hours >= 500 THEN 'crosses_window' WHEN frame_index-ff > 1 THEN 'missing_frame' WHEN to_hours-from_hours > 9 THEN 'gap_too_long' END AS reason FROM s WHERE to_hours > 200 AND from_hours < 500)
 SELECT stem, identity, from_hours, to_hours, reason IS NULL AS supported, reason FROM r""",
    "from_hours to_hours",
)
def _(i):
    return P.support_intervals(i.traces(), 200.0, 500.0, 9.0)


_EPISODES = """n AS (SELECT *, lag(hours) OVER w AS p, lag(mark) OVER w AS pm FROM m WINDOW w AS (PARTITION BY stem, identity ORDER BY hours)),
 g AS (SELECT *, sum(CASE WHEN p IS NULL OR hours-p > {step} OR mark<>pm THEN 1 ELSE 0 END) OVER (PARTITION BY stem, identity ORDER BY hours) AS run FROM n),
 b AS (SELECT stem, identity, run, any_value(mark) AS mark, min(hours) AS "start", max(hours) AS "end", count(*) AS "rows",
 max(CASE WHEN hours-p <= {step} AND (pm<>mark) THEN p END) AS onset_lower FROM g GROUP BY 1,2,3),
 q AS (SELECT g.stem, g.identity, g.run, min(g.hours) AS qualified_at FROM g JOIN b USING (stem, identity, run) WHERE g.hours-b."start" >= {hold} GROUP BY 1,2,3),
 ep AS (SELECT b.stem, b.identity, mark, "start", "end", "rows", onset_lower, onset_lower IS NULL AS left_unresolved, qualified_at FROM b LEFT JOIN q USING (stem, identity, run))"""


@query(
    "threshold_episodes",
    f"""WITH {TRACES_SQL}, m AS (SELECT stem, identity, hours, signal > 40 AS mark FROM tr), {_EPISODES.format(step=6, hold=12)} SELECT * FROM ep""",
    '"start" "end" onset_lower qualified_at',
)
def _(i):
    return P.episodes(i.traces(), F.col("signal") > 40, 6.0, 12.0)


@query(
    "response_timing",
    f"""WITH {TRACES_SQL}, base AS (SELECT stem, identity, avg(signal) AS baseline, stddev_samp(signal) AS baseline_sd FROM tr WHERE hours < 240 GROUP BY 1,2),
 m AS (SELECT stem, identity, hours, coalesce(signal > baseline + 0.1*baseline_sd, false) AS mark FROM tr JOIN base USING (stem, identity) WHERE hours >= 240),
 {_EPISODES.format(step=12, hold=12)}, qe AS (SELECT * FROM ep WHERE qualified_at IS NOT NULL),
 f AS (SELECT stem, identity, first("start" ORDER BY "start") AS response_start, first(onset_lower ORDER BY "start") AS ol FROM qe WHERE mark GROUP BY 1,2),
 k AS (SELECT stem, identity, min(qe."start") AS recovery_start FROM qe JOIN f USING (stem, identity) WHERE NOT mark AND qe."start" > response_start GROUP BY 1,2),
 e AS (SELECT stem, identity, max(hours) AS last_hour FROM m GROUP BY 1,2),
 z AS (SELECT base.stem, base.identity, baseline, baseline_sd, last_hour, response_start, response_start-240 AS delay_upper, ol-240 AS delay_lower, recovery_start, recovery_start-response_start AS recovery_hours,
 CASE WHEN baseline_sd IS NULL THEN 'no_baseline' WHEN response_start IS NULL THEN 'no_response' WHEN recovery_start IS NULL THEN 'responded_censored' ELSE 'recovered' END AS status
 FROM base JOIN e USING (stem, identity) LEFT JOIN f USING (stem, identity) LEFT JOIN k USING (stem, identity))
 SELECT *, CASE WHEN status IN ('no_response','responded_censored') THEN last_hour END AS censored_at FROM z""",
    "baseline baseline_sd last_hour response_start delay_upper delay_lower recovery_start recovery_hours censored_at",
)
def _(i):
    return P.response_timing(i.traces(), 240.0, 0.1, 12.0, 12.0)


STATE_SQL = "CASE WHEN signal > 60 THEN 'high' WHEN signal > 25 THEN 'middle' WHEN signal > 2 THEN 'low' END"


@query(
    "state_bouts",
    f"""WITH {TRACES_SQL}, s AS (SELECT stem, identity, frame_index, hours, {STATE_SQL} AS state FROM tr),
 n AS (SELECT *, lag(frame_index) OVER w AS pf, lag(hours) OVER w AS ph, lag(state) OVER w AS ps, lead(frame_index) OVER w AS nf, lead(hours) OVER w AS nh FROM s WINDOW w AS (PARTITION BY stem, identity ORDER BY frame_index)),
 g AS (SELECT *, CAST(sum(CASE WHEN pf IS NULL OR frame_index-pf<>1 OR state IS DISTINCT FROM ps THEN 1 ELSE 0 END) OVER (PARTITION BY stem, identity ORDER BY frame_index) AS BIGINT) AS bout FROM n),
 b AS (SELECT stem, identity, bout, state, min(hours) AS start_hour, max(hours) AS end_hour, count(*) AS frames,
 first(CASE WHEN frame_index-pf=1 THEN ph END ORDER BY frame_index) AS l, first(CASE WHEN nf-frame_index=1 THEN nh END ORDER BY frame_index DESC) AS r FROM g GROUP BY 1,2,3,4)
 SELECT * EXCLUDE (l, r), l IS NULL AS left_censored, r IS NULL AS right_censored, end_hour-start_hour AS duration_lower, r-l AS duration_upper FROM b""",
    "start_hour end_hour duration_lower duration_upper",
)
def _(i):
    return P.state_bouts(i.traces().withColumn("state", F.expr(STATE_SQL)), "state")


_PIECES = f"""s AS (SELECT stem, identity, hours, coalesce({STATE_SQL}, 'unknown') AS state FROM tr),
 n AS (SELECT *, lead(hours) OVER w AS nh, lead(state) OVER w AS ns FROM s WINDOW w AS (PARTITION BY stem, identity ORDER BY hours)),
 pc AS (SELECT stem, identity, hours AS lo, (hours+nh)/2 AS hi, state AS exposure FROM n WHERE nh-hours <= 12
 UNION ALL SELECT stem, identity, (hours+nh)/2, nh, ns FROM n WHERE nh-hours <= 12
 UNION ALL SELECT stem, identity, hours, nh, 'unobserved' FROM n WHERE nh-hours > 12)"""
_BOUTS = f"""{_PIECES}, pn AS (SELECT *, lag(exposure) OVER w AS pe, lag(hi) OVER w AS ph FROM pc WINDOW w AS (PARTITION BY stem, identity ORDER BY lo)),
 pg AS (SELECT *, CAST(sum(CASE WHEN pe IS NULL OR pe<>exposure OR ph<>lo THEN 1 ELSE 0 END) OVER (PARTITION BY stem, identity ORDER BY lo) AS BIGINT) AS bout FROM pn),
 bt AS (SELECT stem, identity, bout, exposure, min(lo) AS start_hour, max(hi) AS end_hour, sum(hi-lo) AS hours FROM pg GROUP BY 1,2,3,4)"""


def _pieces(i):
    return P.exposures(i.traces().withColumn("state", F.expr(STATE_SQL)), "state", 12.0)


@query("exposure_pieces", f"WITH {TRACES_SQL}, {_PIECES} SELECT * FROM pc", "lo hi")
def _(i):
    return _pieces(i)


@query("exposure_bouts", f"WITH {TRACES_SQL}, {_BOUTS} SELECT * FROM bt", "start_hour end_hour hours")
def _(i):
    return P.exposure_bouts(_pieces(i))


@query(
    "exposure_summary",
    f"""WITH {TRACES_SQL}, {_BOUTS}, bn AS (SELECT *, lag(exposure) OVER w AS pe, lag(end_hour) OVER w AS ph FROM bt WINDOW w AS (PARTITION BY stem, identity ORDER BY start_hour)),
 t AS (SELECT stem, identity, coalesce(sum(hours) FILTER (WHERE exposure NOT IN ('unknown','unobserved')),0) AS assigned_hours, coalesce(sum(hours) FILTER (WHERE exposure='unknown'),0) AS unknown_hours,
 coalesce(sum(hours) FILTER (WHERE exposure='unobserved'),0) AS unobserved_hours,
 count(*) FILTER (WHERE exposure NOT IN ('unknown','unobserved') AND pe NOT IN ('unknown','unobserved') AND ph=start_hour) AS switches FROM bn GROUP BY 1,2)
 SELECT *, switches/nullif(assigned_hours,0) AS switch_rate FROM t""",
    "assigned_hours unknown_hours unobserved_hours switch_rate",
)
def _(i):
    return P.exposure_summary(P.exposure_bouts(_pieces(i)))


@query(
    "display_breaks",
    f"""WITH {TRACES_SQL}, s AS (SELECT *, lag(hours) OVER (PARTITION BY stem, identity ORDER BY hours) AS ph FROM tr)
 SELECT stem, identity, hours, signal AS value FROM s UNION ALL SELECT stem, identity, (ph+hours)/2, NULL FROM s WHERE hours-ph > 9""",
    "hours value",
)
def _(i):
    return P.display_breaks(i.traces(), "signal", 9.0)


@query("identity_numbers", "SELECT stem, identity, row_number() OVER (PARTITION BY stem ORDER BY identity) AS cell_number FROM (SELECT DISTINCT event_type AS stem, user_id AS identity FROM events)")
def _(i):
    return P.identity_numbers(i.events())


@query(
    "frame_clock",
    """WITH s AS (SELECT event_type AS stem, CAST(unnest(range(n)) AS INTEGER) AS frame_index FROM (SELECT event_type, max((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01'))//86400000000) + 1 AS n FROM events GROUP BY 1)),
 a AS (SELECT event_type AS stem, CAST((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01'))//86400000000 AS INTEGER) AS frame_index, min(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01'))/3.6e9 AS acquired FROM events GROUP BY 1,2)
 SELECT stem, frame_index, frame_index+1 AS frame_label, frame_index+100 AS source_frame_index, coalesce(acquired, frame_index*24.0) AS hours FROM s LEFT JOIN a USING (stem, frame_index)""",
    "hours",
)
def _(i):
    from lapsegrid.sources.tables import frame_clock

    actual = i.events().groupBy("stem", F.floor(F.col("micros") / 86_400_000_000).cast("int").alias("frame_index")).agg(
        F.min("hours").alias("acquired_hours")
    )
    return frame_clock(i.recordings().withColumn("source_frame_offset", F.lit(100)), actual)
