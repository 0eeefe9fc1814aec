"""Classes, transitions, event tables and alignment."""

from pyspark.sql import functions as F

from lapsegrid.operators import regimes as G
from lapsegrid.operators import tracks as K
from lapsegrid.sources.canonical import DAILY_SQL, EVENTS_SQL, TRACES_SQL, TRACKS_SQL
from lapsegrid.workload.registry import query
from lapsegrid.workload.w02_presence import GAPS, LIFE
from lapsegrid.workload.w03_tracks import STEPS

_P = "(rank() OVER (PARTITION BY stem ORDER BY {c}) - 1 + (count(*) OVER (PARTITION BY stem, {c}) - 1)/2.0)/greatest(count(*) OVER (PARTITION BY stem)-1,1)"
_LV = "CASE WHEN {c} < 1.0/3 THEN 0 WHEN {c} < 2.0/3 THEN 1 ELSE 2 END"
CLASSED = f"""k0 AS (SELECT stem, identity, frame_index, hours, area_px, step_px_gapless FROM st JOIN (SELECT stem, identity, frame_index, area_px FROM tk) USING (stem, identity, frame_index) WHERE step_px_gapless IS NOT NULL),
 k1 AS (SELECT *, {_P.format(c='area_px')} AS size_position, {_P.format(c='round(step_px_gapless, 9)')} AS movement_position FROM k0),
 k2 AS (SELECT *, CAST(({_LV.format(c='size_position')})*3 + ({_LV.format(c='movement_position')}) AS INTEGER) AS regime FROM k1),
 ctr AS (SELECT s*3+m AS r, (2*s+1)/6.0 AS cs, (2*m+1)/6.0 AS cm FROM range(3) a(s), range(3) b(m)),
 kd AS (SELECT k2.*, r, round(sqrt((size_position-cs)**2+(movement_position-cm)**2),9) AS d FROM k2, ctr),
 cl AS (SELECT stem, identity, frame_index, any_value(hours) AS hours, any_value(area_px) AS area_px, any_value(step_px_gapless) AS step_px_gapless, any_value(size_position) AS size_position, any_value(movement_position) AS movement_position,
 any_value(regime) AS regime, min(d) FILTER (WHERE r=regime) AS centre_distance, CAST(first(r ORDER BY d, r) FILTER (WHERE r<>regime) AS INTEGER) AS runner_up,
 min(d) FILTER (WHERE r<>regime) - min(d) FILTER (WHERE r=regime) AS margin FROM kd GROUP BY 1,2,3)"""
BASE = f"WITH {TRACKS_SQL}, {STEPS}, {CLASSED}"
MOVES = """w0 AS (SELECT *, lag(frame_index) OVER w AS pf, lag(regime) OVER w AS pr, lead(frame_index) OVER w AS to_frame_index, lead(regime) OVER w AS to_regime FROM cl WINDOW w AS (PARTITION BY stem, identity ORDER BY frame_index)),
 w1 AS (SELECT *, CAST(sum(CASE WHEN pf IS NULL OR frame_index-pf<>1 OR regime<>pr THEN 1 ELSE 0 END) OVER (PARTITION BY stem, identity ORDER BY frame_index) AS BIGINT) AS dwell_id FROM w0),
 mv AS (SELECT stem, identity, frame_index AS from_frame_index, to_frame_index, hours, regime AS from_regime, to_regime, dwell_id, dwell_frames FROM w1
 JOIN (SELECT stem, identity, dwell_id, count(*) AS dwell_frames FROM w1 GROUP BY 1,2,3) USING (stem, identity, dwell_id) WHERE to_frame_index-frame_index=1)"""


def classed(i):
    tracks = i.tracks()
    joined = K.steps(tracks).select("stem", "identity", "frame_index", "hours", "step_px_gapless").join(
        tracks.select("stem", "identity", "frame_index", "area_px"), ["stem", "identity", "frame_index"]
    )
    return G.classify(joined, ["stem"], "area_px", "step_px_gapless")


@query(
    "percentile_positions",
    f"WITH {DAILY_SQL} SELECT stem, identity, frame_index, CASE WHEN count(*) OVER (PARTITION BY stem)=1 THEN 0.5 ELSE {_P.format(c='signal')} END AS position FROM obs",
    "position",
)
def _(i):
    return G.percentile_position(i.daily().select("stem", "identity", "frame_index", "signal"), ["stem"], "signal", "position").drop("signal")


@query("regime_classes", f"{BASE} SELECT * FROM cl", "hours area_px step_px_gapless size_position movement_position centre_distance margin", digits=9)
def _(i):
    return classed(i)


@query("regime_transitions", f"{BASE}, {MOVES} SELECT * FROM mv", "hours")
def _(i):
    return G.transitions(classed(i))


for _how, _share in {"row": "from_regime", "column": "to_regime", "none": None}.items():
    query(
        f"transition_matrix_{_how}",
        f"""{BASE}, {MOVES}, g AS (SELECT s.stem, CAST(a AS INTEGER) AS from_regime, CAST(b AS INTEGER) AS to_regime FROM (SELECT DISTINCT stem FROM mv) s, range(9) x(a), range(9) y(b)),
 c AS (SELECT g.*, coalesce(n,0) AS n FROM g LEFT JOIN (SELECT stem, from_regime, to_regime, count(*) AS n FROM mv GROUP BY 1,2,3) USING (stem, from_regime, to_regime))
 SELECT *, {'n/nullif(sum(n) OVER (PARTITION BY stem, ' + _share + '),0)' if _share else 'CAST(n AS DOUBLE)'} AS share FROM c""",
        "share",
    )(lambda i, how=_how: G.transition_matrix(G.transitions(classed(i)), ["stem"], 9, how))


@query(
    "dwell_histogram",
    f"{BASE}, {MOVES} SELECT stem, from_regime, CAST((dwell_frames-1)//2 AS INTEGER) AS length_bucket, count(*) AS dwells FROM (SELECT DISTINCT stem, identity, dwell_id, from_regime, dwell_frames FROM mv) GROUP BY 1,2,3",
)
def _(i):
    return G.dwell_histogram(G.transitions(classed(i)), ["stem"], 2)


@query(
    "regime_profiles",
    f"""{BASE}, e AS (SELECT stem, quantile_cont(area_px,0.5) AS a, quantile_cont(step_px_gapless,0.5) AS b FROM cl GROUP BY 1), g AS (SELECT e.*, CAST(unnest(range(9)) AS INTEGER) AS regime FROM e)
 SELECT stem, regime, coalesce(n,0) AS observations, coalesce(oa,a) AS area_px, coalesce(ob,b) AS step_px_gapless FROM g
 LEFT JOIN (SELECT stem, regime, count(*) AS n, quantile_cont(area_px,0.5) AS oa, quantile_cont(step_px_gapless,0.5) AS ob FROM cl GROUP BY 1,2) USING (stem, regime)""",
    "area_px step_px_gapless",
)
def _(i):
    return G.state_profile(classed(i), ["stem"], ["area_px", "step_px_gapless"], 9)


@query("regime_occupancy_by_time", f"{BASE} SELECT stem, hours, regime, count(*) AS n, count(*)/sum(count(*)) OVER (PARTITION BY stem, hours) AS fraction FROM cl GROUP BY 1,2,3", "hours fraction")
def _(i):
    return G.occupancy_by_time(classed(i))


@query(
    "inside_outside_contrast",
    f"""{BASE}, z AS (SELECT stem, identity, avg(area_px) FILTER (WHERE regime%3=2) AS inside_mean, avg(area_px) FILTER (WHERE regime%3<>2) AS outside_mean,
 count(area_px) FILTER (WHERE regime%3=2) AS inside_n, count(area_px) FILTER (WHERE regime%3<>2) AS outside_n FROM cl GROUP BY 1,2) SELECT *, inside_mean-outside_mean AS contrast FROM z WHERE inside_n>0 AND outside_n>0""",
    "inside_mean outside_mean contrast",
)
def _(i):
    return G.inside_outside(classed(i), F.col("regime") % 3 == 2, "area_px")


# --- events ------------------------------------------------------------------------------------------

EVT = f"""{DAILY_SQL}, {LIFE}, {GAPS}, evt AS (
 SELECT stem, identity, 'start' AS event, f0 AS frame_index, CASE WHEN f0=0 THEN 'censored' ELSE 'observed' END AS status FROM life
 UNION ALL SELECT stem, identity, 'end', f1, CASE WHEN f1=n_frames-1 THEN 'censored' ELSE 'observed' END FROM life JOIN rec USING (stem)
 UNION ALL SELECT stem, identity, 'gap', gap_start, 'observed' FROM gaps), evh AS (SELECT *, frame_index*24.0::DOUBLE AS hours FROM evt)"""


def life_events(i):
    from lapsegrid.operators import presence as P

    obs = i.daily()
    spans, gaps = P.lifespans(obs), P.gap_intervals(obs)
    status = lambda c: F.when(c, F.lit("censored")).otherwise(F.lit("observed")).alias("status")
    first, last = F.col("first_frame_index"), F.col("last_frame_index")
    starts = spans.select("stem", "identity", F.lit("start").alias("event"), first.alias("frame_index"), status(first == 0))
    timed = spans.join(i.recordings().select("stem", "n_frames"), "stem")
    ends = timed.select("stem", "identity", F.lit("end").alias("event"), last.alias("frame_index"), status(last == F.col("n_frames") - 1))
    lost = gaps.select("stem", "identity", F.lit("gap").alias("event"), F.col("gap_start").alias("frame_index"), F.lit("observed").alias("status"))
    return starts.unionByName(ends).unionByName(lost).withColumn("hours", F.col("frame_index") * F.lit(24.0))


@query("event_ledger", f"WITH {EVT} SELECT event, status, count(*) AS n FROM evh GROUP BY 1,2")
def _(i):
    return G.event_ledger(life_events(i))


@query("event_ledger_uncensored", f"WITH {EVT} SELECT event, status, count(*) AS n FROM evh WHERE status<>'censored' GROUP BY 1,2")
def _(i):
    return G.event_ledger(life_events(i), censored=False)


@query(
    "event_clock",
    f"""WITH {EVT}, g AS (SELECT DISTINCT event, CAST(unnest(range((SELECT CAST(floor(max(hours)/72) AS INTEGER) + 1 FROM evh))) AS INTEGER) AS bin FROM evh) SELECT event, bin, bin*72.0 AS from_hours, coalesce(n,0) AS n
 FROM g LEFT JOIN (SELECT event, CAST(floor(hours/72) AS INTEGER) AS bin, count(*) AS n FROM evh GROUP BY 1,2) USING (event, bin)""",
    "from_hours",
)
def _(i):
    return G.event_clock(life_events(i), 72.0)


@query("event_accumulation", f"WITH {EVT}, a AS (SELECT event, hours, count(*) AS here FROM evh GROUP BY 1,2) SELECT *, CAST(sum(here) OVER (PARTITION BY event ORDER BY hours) AS BIGINT) AS accumulated FROM a", "hours")
def _(i):
    return G.event_accumulation(life_events(i), 4096.0)


@query(
    "fate_flow",
    f"""WITH {DAILY_SQL}, {LIFE} SELECT CASE WHEN f0=0 THEN 'present' WHEN f0<5 THEN 'entered' ELSE 'appeared' END AS start_event, CASE WHEN f1=n_frames-1 THEN 'present' WHEN f1>n_frames-6 THEN 'left' ELSE 'lost' END AS end_event, count(*) AS entities FROM life JOIN rec USING (stem) GROUP BY 1,2 HAVING count(*)>=3""",
)
def _(i):
    from lapsegrid.operators import presence as P

    f0, f1 = F.col("first_frame_index"), F.col("last_frame_index")
    n = F.col("n_frames")
    fates = P.lifespans(i.daily()).join(i.recordings().select("stem", "n_frames"), "stem").select(
        F.when(f0 == 0, "present").when(f0 < 5, "entered").otherwise("appeared").alias("start_event"),
        F.when(f1 == n - 1, "present").when(f1 > n - 6, "left").otherwise("lost").alias("end_event"),
    )
    return G.fate_flow(fates, 3)


_DEV = "q AS (SELECT stem, identity, quantile_cont(signal,0.25) AS q1, quantile_cont(signal,0.5) AS m, quantile_cont(signal,0.75) AS q3 FROM tr GROUP BY 1,2),"
for _dir, _pre, _from, _score in (
    ("high", "", "tr", "signal"),
    ("low", "", "tr", "-signal"),
    ("deviation", _DEV, "tr JOIN q USING (stem, identity)", "abs((signal-m)/nullif(q3-q1,0))"),
):
    query(
        f"ranked_events_{_dir}",
        f"""WITH {TRACES_SQL}, {_pre} s AS (SELECT stem, identity, frame_index, signal, {_score} AS score FROM {_from}),
 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY stem, identity ORDER BY score DESC, frame_index) AS INTEGER) AS event_rank FROM s WHERE score IS NOT NULL) SELECT * FROM r WHERE event_rank BETWEEN 2 AND 4""",
        "signal score",
    )(lambda i, d=_dir: G.ranked_events(i.traces().select("stem", "identity", "frame_index", "signal"), "signal", d, 3, 2))

_TOP = """top AS (SELECT * FROM (SELECT stem, identity, frame_index, row_number() OVER (PARTITION BY stem, identity ORDER BY signal DESC, frame_index) AS r FROM tr) WHERE r<=2)"""
_STD = "zs AS (SELECT tr.*, (signal-avg(signal) OVER w)/CASE WHEN stddev_pop(signal) OVER w < 1e-9 THEN 1.0 ELSE stddev_pop(signal) OVER w END AS z FROM tr WINDOW w AS (PARTITION BY stem, identity))"


@query("standardised_responses", f"WITH {TRACES_SQL}, {_STD} SELECT stem, identity, frame_index, signal, z FROM zs", "signal z", digits=7)
def _(i):
    return G.standardise(i.traces().select("stem", "identity", "frame_index", "signal"), "signal")


@query(
    "event_aligned_rows",
    f"""WITH {TRACES_SQL}, {_TOP} SELECT top.stem, top.identity, top.frame_index AS event_frame, tr.frame_index-top.frame_index AS "offset", signal FROM top JOIN tr ON tr.stem=top.stem AND tr.identity=top.identity AND tr.frame_index BETWEEN top.frame_index-4 AND top.frame_index+4""",
    "signal",
)
def _(i):
    tr = i.traces()
    return G.align(tr, G.ranked_events(tr, "signal", "high", 2), "signal", 4, 4)


@query(
    "event_aligned_curve",
    f"""WITH {TRACES_SQL}, {_TOP}, {_STD} SELECT tr.stem, tr.frame_index-top.frame_index AS "offset", avg(z) AS mean, count(z) AS events, quantile_cont(z,0.25) AS q25, quantile_cont(z,0.5) AS q50, quantile_cont(z,0.75) AS q75
 FROM top JOIN zs tr ON tr.stem=top.stem AND tr.identity=top.identity AND tr.frame_index BETWEEN top.frame_index-4 AND top.frame_index+4 GROUP BY 1,2""",
    "mean q25 q50 q75",
)
def _(i):
    tr = G.standardise(i.traces(), "signal")
    return G.aligned_curve(G.align(tr, G.ranked_events(tr, "signal", "high", 2), "z", 4, 4), "z", ["stem"])


@query(
    "transition_triggered_curves",
    f"""{BASE}, p AS (SELECT stem, identity, regime, area_px, row_number() OVER w AS position, lag(regime) OVER w AS pr, count(*) OVER (PARTITION BY stem, identity) AS n FROM cl WINDOW w AS (PARTITION BY stem, identity ORDER BY frame_index)),
 e AS (SELECT stem, identity, position AS event_position FROM p WHERE regime<>pr AND position-3>=1 AND position+3<=n),
 r AS (SELECT e.*, position-event_position AS "offset", area_px FROM e JOIN p ON e.stem=p.stem AND e.identity=p.identity AND p.position BETWEEN event_position-3 AND event_position+3)
 SELECT stem, identity, event_position, CAST("offset" AS INTEGER) AS "offset", CASE WHEN stddev_pop(area_px) OVER w > 1e-9 THEN (area_px-avg(area_px) OVER w)/stddev_pop(area_px) OVER w END AS z FROM r WINDOW w AS (PARTITION BY stem, identity, event_position)""",
    "z",
)
def _(i):
    return G.transition_curves(classed(i), "area_px", 3)


_LOW = "c AS (SELECT quantile_cont(signal, 0.1) AS cut FROM obs), le AS (SELECT * FROM obs, c WHERE signal <= cut)"


@query("low_quantile_events", f"WITH {DAILY_SQL}, {_LOW} SELECT stem, identity, frame_index, signal, cut FROM le", "signal cut")
def _(i):
    return G.low_events(i.daily(), "signal", 0.1)[0].select("stem", "identity", "frame_index", "signal", "cut")


@query(
    "event_rates",
    f"""WITH {DAILY_SQL}, {_LOW}, n AS (SELECT stem, identity, count(*) AS observed FROM obs GROUP BY 1,2), e AS (SELECT stem, identity, count(*) AS events FROM le GROUP BY 1,2),
 r AS (SELECT n.*, coalesce(events,0) AS events, coalesce(events,0)/observed AS rate FROM n LEFT JOIN e USING (stem, identity)) SELECT *, row_number() OVER (ORDER BY rate DESC, events DESC, stem, identity) AS rate_rank FROM r""",
    "rate",
)
def _(i):
    return G.low_events(i.daily(), "signal", 0.1)[1]


@query(
    "strongest_examples",
    f"WITH {DAILY_SQL}, {_LOW} SELECT stem, identity, min(signal) AS signal, first(frame_index ORDER BY signal, frame_index) AS frame_index FROM le GROUP BY 1,2 ORDER BY 3,1,2 LIMIT 10",
    "signal",
)
def _(i):
    return G.strongest_examples(G.low_events(i.daily(), "signal", 0.1)[0], "signal", 10)


@query("requested_identities", f"WITH {DAILY_SQL} SELECT stem, identity, frame_index, CASE identity WHEN 17 THEN 1 WHEN 3 THEN 2 ELSE 3 END AS request_order FROM obs WHERE identity IN (17,3,99)")
def _(i):
    return G.in_requested_order(i.daily().select("stem", "identity", "frame_index"), "identity", [17, 3, 99]).withColumn("request_order", F.col("request_order").cast("int"))


@query("result_pages", f"WITH {DAILY_SQL} SELECT stem, identity, frame_index, (row_number() OVER (PARTITION BY stem ORDER BY frame_index, identity)-1)//40 AS page FROM obs")
def _(i):
    return G.pages(i.daily().select("stem", "identity", "frame_index"), ["stem"], ["frame_index", "identity"], F.col("frame_index").cast("long"), 40)


@query("distinct_event_rows", f"WITH {EVT} SELECT DISTINCT stem, identity, event FROM evh")
def _(i):
    return life_events(i).dropDuplicates(["stem", "identity", "event"]).select("stem", "identity", "event")
