"""Filters, design, joins and set operations."""

from pyspark.sql import functions as F

from lapsegrid.operators import filters as L
from lapsegrid.operators import joins as J
from lapsegrid.operators import presence as P
from lapsegrid.operators import tracks as K
from lapsegrid.sources import tables as S
from lapsegrid.sources.canonical import DAILY_SQL, EVENTS_SQL, TRACES_SQL, clock_of, clock_sql
from lapsegrid.workload.registry import query
from lapsegrid.workload.w02_presence import GAPS, LIFE, STATE_SQL

KEYS = ["identity"]
HOUR = 3_600_000_000


def facts(i):
    """Per-entity facts: presence, metric summaries, events; the signal floor of quiet entities is unknown."""
    tr = i.traces()
    # the mean in whole billionths: sums of whole numbers do not depend on the order of the rows
    mean = F.expr("(2 * sum(CAST(round(signal * 1e9D) AS BIGINT)) + count(signal)) div (2 * count(signal))") / F.lit(1e9)
    base = tr.join(clock_of(tr), "stem").groupBy("stem", "identity").agg(
        F.count(F.lit(1)).alias("observed"),
        ((F.max("n_frames") - F.count(F.lit(1))) / F.max("n_frames").cast("double")).alias("missing_share"),
        mean.alias("signal_mean"),
        F.max("signal").alias("signal_max"),
        F.when(F.min("signal") < 1, F.min("signal")).alias("signal_floor"),
    )
    hot = i.events().where((F.col("stem") == "error") & (F.col("cents") > 20000)).select("identity")
    with_event = L.event_fact(base, ["identity"], hot, "had_large_error")
    return L.event_fact(with_event, ["identity"], None, "had_fusion")


FACTS = f"""{TRACES_SQL}, facts AS (SELECT stem, identity, count(*) AS observed, (max(n_frames)-count(*))/CAST(max(n_frames) AS DOUBLE) AS missing_share, ((2*CAST(sum(CAST(round(signal*1e9) AS BIGINT)) AS BIGINT)+count(signal))//(2*count(signal)))/1e9 AS signal_mean, max(signal) AS signal_max,
 CASE WHEN min(signal) < 1 THEN min(signal) END AS signal_floor,
 identity IN (SELECT identity FROM ev WHERE stem='error' AND cents > 20000) AS had_large_error, CAST(NULL AS BOOLEAN) AS had_fusion FROM tr JOIN {clock_sql('tr')} USING (stem) GROUP BY 1,2)"""

RULE = {"op": "or", "args": [
    {"op": "and", "args": [{"field": "missing_share", "cmp": "lt", "value": 0.6}, {"op": "not", "args": [{"field": "signal_floor", "cmp": "between", "value": (0.2, 0.8)}]}]},
    {"op": "xor", "args": [{"field": "had_large_error", "cmp": "eq", "value": True}, {"field": "signal_mean", "cmp": "gte", "value": 50.0}]},
    {"op": "and", "args": [{"field": "had_fusion", "cmp": "eq", "value": True}, {"field": "signal_max", "cmp": "not_between", "value": (0, 100)}]},
]}
_LEAVES = ["missing_share < 0.6", "signal_floor BETWEEN 0.2 AND 0.8", "had_large_error = true", "signal_mean >= 50.0", "had_fusion = true", "NOT (signal_max BETWEEN 0 AND 100)"]
_MATCH = f"(({_LEAVES[0]}) AND NOT ({_LEAVES[1]})) OR (({_LEAVES[2]}) <> ({_LEAVES[3]})) OR (({_LEAVES[4]}) AND ({_LEAVES[5]}))"
_EVID = ", ".join(f"({r}) AS rule_{n}" for n, r in enumerate(_LEAVES, 1))


@query("cohort_facts", f"WITH {FACTS} SELECT * FROM facts", "missing_share signal_mean signal_max signal_floor", digits=9)
def _(i):
    return facts(i)


for _mode in ("keep", "exclude"):
    for _unknown in ("keep", "exclude"):
        _dec = f"({_MATCH})" if _mode == "keep" else f"NOT ({_MATCH})"
        query(
            f"cohort_filter_{_mode}_unknown_{_unknown}",
            f"WITH {FACTS} SELECT *, {_EVID}, ({_MATCH}) AS matched, coalesce({_dec}, {'true' if _unknown == 'keep' else 'false'}) AS kept FROM facts",
            "missing_share signal_mean signal_max signal_floor",
            digits=9,
        )(lambda i, m=_mode, u=_unknown: L.cohort(facts(i), RULE, m, u))

FACTORS = {
    "size": {"small": "^small", "large": "^large", "tiny": "^tiny"},
    "colour": {"red": "red", "blue": "blue", "green": "green"},
    "shape": {"ring": "ring$", "round": "r.ng|widget", "other": "bolt$"},
}
CONTROLS = {"size": "small", "colour": "black", "shape": "other"}
_ASSIGN = "asg AS (" + " UNION ALL ".join(
    f"SELECT p_partkey, '{f}' AS factor, [x FOR x IN [{', '.join(f"CASE WHEN regexp_matches(p_name, '{p}') THEN '{lv}' END" for lv, p in pats.items())}] IF x IS NOT NULL] AS h FROM part"
    for f, pats in FACTORS.items()
) + """), lev AS (SELECT a.p_partkey, a.factor, coalesce(d.level, CASE WHEN len(h)=1 THEN h[1] END) AS level,
 CASE WHEN d.level IS NOT NULL THEN 'declared' WHEN len(h)=1 THEN 'derived' WHEN len(h)=0 THEN 'unassigned' ELSE 'ambiguous' END AS status, len(h) AS hits
 FROM asg a LEFT JOIN (SELECT p_partkey, 'size' AS factor, 'large' AS level FROM part WHERE p_size > 45) d ON a.p_partkey=d.p_partkey AND a.factor=d.factor)"""


def levels(i):
    part = i.table("part")
    declared = part.where(F.col("p_size") > 45).select("p_partkey", F.lit("size").alias("factor"), F.lit("large").alias("level"))
    return L.assign_levels(part, "p_partkey", "p_name", FACTORS, declared)


@query("condition_assignment", f"WITH {_ASSIGN} SELECT * FROM lev")
def _(i):
    return levels(i)


_DECL = ", ".join(f"('{f}','{lv}','{CONTROLS[f]}')" for f, lvs in FACTORS.items() for lv in lvs)


@query(
    "design_audit",
    f"""WITH {_ASSIGN}, d(factor, level, control) AS (VALUES {_DECL}), c AS (SELECT d.*, count(lev.level) AS n FROM d LEFT JOIN lev ON d.factor=lev.factor AND d.level=lev.level GROUP BY 1,2,3),
 f AS (SELECT factor, count(*) FILTER (WHERE n>0) AS g, max(CASE WHEN level=control AND n>0 THEN 1 ELSE 0 END) AS hc FROM c GROUP BY 1)
 SELECT factor, level, 'unused_pattern' AS finding FROM c WHERE n=0 UNION ALL SELECT factor, level, 'single_recording' FROM c WHERE n=1
 UNION ALL SELECT factor, NULL, 'single_group' FROM f WHERE g=1 UNION ALL SELECT factor, NULL, 'no_control' FROM f WHERE hc=0""",
)
def _(i):
    return L.design_audit(levels(i), FACTORS, CONTROLS)


@query(
    "cell_condition_override",
    f"""WITH {DAILY_SQL} SELECT o.*, coalesce(CASE WHEN identity IN (SELECT identity FROM ev WHERE stem='error' AND cents>20000) THEN 'outlier' END, CASE stem WHEN 'view' THEN 'passive' WHEN 'click' THEN 'active' END) AS condition FROM obs o""",
    "hours signal activity",
)
def _(i):
    obs = i.daily()
    outliers = i.events().where((F.col("stem") == "error") & (F.col("cents") > 20000)).select("identity").distinct()
    cells = obs.select("stem", "identity").distinct().join(outliers, "identity", "left_semi").withColumn("level", F.lit("outlier"))
    recs = i.recordings().select("stem", F.when(F.col("stem") == "view", "passive").when(F.col("stem") == "click", "active").alias("level"))
    return L.cell_over_recording(obs, cells, recs)


@query(
    "parse_identity_lists",
    """WITH t AS (SELECT c_custkey, CAST(c_nationkey AS VARCHAR) || ', ' || CAST(c_nationkey AS VARCHAR) || '-' || CAST(c_nationkey + c_custkey % 5 AS VARCHAR) || ', x7, 30-20' AS txt FROM customer)
 SELECT DISTINCT * FROM (SELECT c_custkey, CAST(unnest(range(c_nationkey, c_nationkey + c_custkey % 5 + 1)) AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS refused FROM customer WHERE c_nationkey >= 1
  UNION ALL SELECT c_custkey, NULL, unnest(['x7', '30-20']) FROM customer UNION ALL SELECT c_custkey, NULL, unnest([CAST(c_nationkey AS VARCHAR), CAST(c_nationkey AS VARCHAR) || '-' || CAST(c_nationkey + c_custkey % 5 AS VARCHAR)]) FROM customer WHERE c_nationkey < 1)""",
)
def _(i):
    nation = F.col("c_nationkey").cast("string")
    text = F.concat(nation, F.lit(", "), nation, F.lit("-"), (F.col("c_nationkey") + F.col("c_custkey") % 5).cast("string"), F.lit(", x7, 30-20"))
    return L.parse_id_list(i.table("customer").withColumn("txt", text), "c_custkey", "txt")


def by_stem(i, stem, source=None):
    return (source or i.daily()).where(F.col("stem") == stem)


@query(
    "module_full_join",
    f"""WITH {DAILY_SQL} SELECT coalesce(a.identity,b.identity) AS identity, coalesce(a.frame_index,b.frame_index) AS frame_index, a.hours, a.signal AS view_signal, b.signal AS click_signal, c.n AS frame_entities
 FROM (SELECT * FROM obs WHERE stem='view') a FULL JOIN (SELECT * FROM obs WHERE stem='click') b ON a.identity=b.identity AND a.frame_index=b.frame_index
 LEFT JOIN (SELECT frame_index, count(*) AS n FROM obs GROUP BY 1) c ON c.frame_index=coalesce(a.frame_index,b.frame_index)""",
    "hours view_signal click_signal",
)
def _(i):
    obs = i.daily()
    view = by_stem(i, "view").select("identity", "frame_index", "hours", F.col("signal").alias("view_signal"))
    click = by_stem(i, "click").select("identity", "frame_index", "hours", F.col("signal").alias("click_signal"))
    clock = obs.groupBy("frame_index").agg(F.count(F.lit(1)).alias("frame_entities"))
    return J.join_modules([view, click], ["identity", "frame_index"], clock)


@query(
    "fold_derived",
    f"WITH {DAILY_SQL} SELECT o.*, r.n AS observed FROM obs o LEFT JOIN (SELECT stem, identity, count(*) AS n FROM obs GROUP BY 1,2) r USING (stem, identity)",
    "hours signal activity",
)
def _(i):
    obs = i.daily()
    derived = obs.groupBy("stem", "identity").agg(F.count(F.lit(1)).alias("observed"), F.avg("signal").alias("signal"))
    return J.fold(obs, derived, ["stem", "identity"])


@query(
    "side_table_join",
    f"""WITH {DAILY_SQL}, s AS (SELECT c_custkey AS identity, c_mktsegment AS design_c_mktsegment, c_acctbal AS design_c_acctbal FROM customer)
 SELECT o.*, design_c_mktsegment, design_c_acctbal FROM obs o LEFT JOIN s USING (identity)""",
    "hours signal activity design_c_acctbal",
)
def _(i):
    obs = i.daily()
    raw = i.table("customer").select(F.col("c_custkey").cast("string").alias("identity"), "c_mktsegment", "c_acctbal")
    side, _audit = S.side_table(raw, "design", "identity", obs, obs.columns)
    return obs.join(side, "identity", "left")


@query(
    "side_table_audit",
    """SELECT count(*) AS "rows", count(*) FILTER (WHERE c_custkey % 7 = 0) AS unusable_keys, count(*) FILTER (WHERE c_custkey % 7 <> 0 AND c_custkey IN (SELECT user_id FROM events)) AS matched_keys,
 count(*) FILTER (WHERE c_custkey % 7 <> 0 AND c_custkey NOT IN (SELECT user_id FROM events)) AS unmatched_keys FROM customer""",
)
def _(i):
    text = F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("n/a "), F.col("c_custkey"))).otherwise(F.col("c_custkey").cast("string"))
    raw = i.table("customer").select(text.alias("identity"), "c_mktsegment")
    return S.side_table(raw, "design", "identity", i.events(), [])[1]


# --- clocks ------------------------------------------------------------------------------------------

NEAREST = f"""a AS (SELECT identity, micros AS r FROM ev WHERE stem='view'), b AS (SELECT identity, micros AS t FROM ev WHERE stem='click'),
 c AS (SELECT identity, r, t, abs(t-(r+{{lag}})) AS d FROM a JOIN b USING (identity) WHERE abs(t-(r+{{lag}})) <= {{tol}}),
 m AS (SELECT identity, r, min(d) AS d FROM c GROUP BY 1,2),
 k AS (SELECT identity, r, any_value(t) AS t, count(*) AS n, any_value(d) AS d FROM c JOIN m USING (identity, r, d) GROUP BY 1,2),
 w AS (SELECT identity, t, count(*) AS wanted FROM k WHERE n=1 GROUP BY 1,2),
 nu AS (SELECT a.identity, a.r AS reference_at, CASE WHEN n=1 AND wanted=1 THEN k.t END AS target_at, CASE WHEN n=1 AND wanted=1 THEN k.d END AS distance,
 CASE WHEN k.n > 1 THEN 'equidistant' WHEN k.n IS NULL THEN 'none' WHEN wanted > 1 THEN 'collision' ELSE 'matched' END AS match_status
 FROM a LEFT JOIN k ON a.identity=k.identity AND a.r=k.r LEFT JOIN w ON k.identity=w.identity AND k.t=w.t)"""


def nearest(i, lag, tolerance):
    ev = i.events().select("stem", "identity", "micros")
    return J.nearest_unique(by_stem(i, "view", ev), by_stem(i, "click", ev), KEYS, "micros", lag, tolerance, 4096 * HOUR)


for _name, _lag, _tol in (("nearest_unique_match", 0, 24 * HOUR), ("nearest_unique_match_lagged", -12 * HOUR, 36 * HOUR)):
    query(_name, f"WITH {EVENTS_SQL}, {NEAREST.format(lag=_lag, tol=_tol)} SELECT * FROM nu")(
        lambda i, lag=_lag, tol=_tol: nearest(i, lag, tol)
    )


@query(
    "nearest_unique_daily_ties",
    f"""WITH {DAILY_SQL}, a AS (SELECT identity, frame_index AS r FROM obs WHERE stem='view'), b AS (SELECT identity, frame_index AS t FROM obs WHERE stem='click'),
 c AS (SELECT identity, r, t, abs(t-r) AS d FROM a JOIN b USING (identity) WHERE abs(t-r) <= 2), m AS (SELECT identity, r, min(d) AS d FROM c GROUP BY 1,2),
 k AS (SELECT identity, r, any_value(t) AS t, count(*) AS n, any_value(d) AS d FROM c JOIN m USING (identity, r, d) GROUP BY 1,2), w AS (SELECT identity, t, count(*) AS wanted FROM k WHERE n=1 GROUP BY 1,2)
 SELECT a.identity, a.r AS reference_at, CASE WHEN n=1 AND wanted=1 THEN k.t END AS target_at, CASE WHEN n=1 AND wanted=1 THEN k.d END AS distance,
 CASE WHEN k.n > 1 THEN 'equidistant' WHEN k.n IS NULL THEN 'none' WHEN wanted > 1 THEN 'collision' ELSE 'matched' END AS match_status
 FROM a LEFT JOIN k ON a.identity=k.identity AND a.r=k.r LEFT JOIN w ON k.identity=w.identity AND k.t=w.t""",
)
def _(i):
    obs = i.daily().select("stem", "identity", "frame_index")
    return J.nearest_unique(by_stem(i, "view", obs), by_stem(i, "click", obs), KEYS, "frame_index", 0, 2, 4096)


@query(
    "match_support",
    f"""WITH {EVENTS_SQL}, {NEAREST.format(lag=0, tol=24 * HOUR)}, h AS (SELECT identity, reference_at, reference_at - lag(reference_at) OVER (PARTITION BY identity ORDER BY reference_at) AS g FROM nu WHERE match_status='matched'),
 g AS (SELECT identity, count(*) AS n, max(reference_at)-min(reference_at) AS span, count(*) FILTER (WHERE g > {72 * HOUR}) AS gaps, max(g) AS largest_gap FROM h GROUP BY 1),
 rf AS (SELECT identity, count(*) AS "references", count(*) FILTER (WHERE match_status IN ('equidistant','collision')) AS ambiguous FROM nu GROUP BY 1)
 SELECT rf.*, coalesce(n,0) AS n, span, gaps, largest_gap, CASE WHEN coalesce(n,0) >= 5 THEN 'eligible' ELSE 'insufficient' END AS status FROM rf LEFT JOIN g USING (identity)""",
)
def _(i):
    return J.match_support(nearest(i, 0, 24 * HOUR), KEYS, 72 * HOUR, 5, 4096 * HOUR)


@query(
    "event_coincidence",
    f"""WITH {EVENTS_SQL}, {NEAREST.format(lag=0, tol=6 * HOUR)}, l AS (SELECT identity, count(*) AS left_events, count(*) FILTER (WHERE match_status='matched') AS matched, count(*) FILTER (WHERE match_status IN ('equidistant','collision')) AS ambiguous FROM nu GROUP BY 1),
 q AS (SELECT identity, count(*) AS right_events FROM b GROUP BY 1)
 SELECT coalesce(l.identity, q.identity) AS identity, coalesce(left_events,0) AS left_events, coalesce(matched,0) AS matched, coalesce(ambiguous,0) AS ambiguous, coalesce(right_events,0) AS right_events,
 matched/nullif(left_events,0) AS left_fraction, coalesce(matched,0)/nullif(right_events,0) AS right_fraction FROM l FULL JOIN q ON l.identity=q.identity""",
    "left_fraction right_fraction",
)
def _(i):
    ev = i.events().select("stem", "identity", "micros")
    return J.event_coincidence(by_stem(i, "view", ev), by_stem(i, "click", ev), KEYS, "micros", 6 * HOUR, 4096 * HOUR)


# --- intervals ---------------------------------------------------------------------------------------

_INT = """iv AS (SELECT stem, identity, hours AS a, lead(hours) OVER w AS b, {st} AS state, lead({st}) OVER w AS next_state FROM obs WINDOW w AS (PARTITION BY stem, identity ORDER BY hours)),
 lv AS (SELECT * FROM iv WHERE stem='view' AND b-a<=72), rv AS (SELECT * FROM iv WHERE stem='click' AND b-a<=72)""".format(st=STATE_SQL)
_JOINT = """pc AS (SELECT l.identity, greatest(l.a,r.a) AS lo, least(l.b,r.b) AS hi FROM lv l JOIN rv r ON l.identity=r.identity AND l.a<r.b AND r.a<l.b)"""


def intervals(i, stem, carry=None):
    rows = by_stem(i, stem).withColumn("state", F.expr(STATE_SQL)).select("identity", "hours", "state")
    return J.adjacent_intervals(rows, KEYS, "hours", 72.0, 4096.0, carry)


@query(
    "joint_intervals",
    f"""WITH {DAILY_SQL}, {_INT}, {_JOINT}, d AS (SELECT identity, greatest(a0,b0) AS d0, least(a1,b1) AS d1 FROM (SELECT identity, min(a) AS a0, max(b) AS a1 FROM lv GROUP BY 1) JOIN (SELECT identity, min(a) AS b0, max(b) AS b1 FROM rv GROUP BY 1) USING (identity)),
 ln AS (SELECT * FROM pc UNION SELECT identity, d0, d0 FROM d WHERE d0<d1 UNION SELECT identity, d1, d1 FROM d WHERE d0<d1),
 g AS (SELECT identity, hi AS lo, lead(lo) OVER (PARTITION BY identity ORDER BY lo, hi) AS nx FROM ln)
 SELECT identity, lo, hi, true AS supported FROM pc UNION ALL SELECT identity, lo, nx, false FROM g WHERE nx>lo""",
    "lo hi",
)
def _(i):
    return J.joint_intervals(intervals(i, "view"), intervals(i, "click"), KEYS, 72.0)


_EXPO = f"""s AS (SELECT stem, identity, hours AS a, coalesce({STATE_SQL}, 'unknown') AS s, lead(hours) OVER w AS b, lead(coalesce({STATE_SQL}, 'unknown')) OVER w AS ns FROM obs WINDOW w AS (PARTITION BY stem, identity ORDER BY hours)),
 pc AS (SELECT stem, identity, a AS lo, (a+b)/2 AS hi, s AS exposure FROM s WHERE b-a<=72 UNION ALL SELECT stem, identity, (a+b)/2, b, ns FROM s WHERE b-a<=72 UNION ALL SELECT stem, identity, a, b, 'unobserved' FROM s WHERE b-a>72)"""


@query(
    "joint_state_exposure",
    f"""WITH {DAILY_SQL}, {_EXPO}, j AS (SELECT l.identity, greatest(l.lo,r.lo) AS lo, least(l.hi,r.hi) AS hi, l.exposure AS left_state, r.exposure AS right_state,
 CASE WHEN 'unobserved' IN (l.exposure, r.exposure) THEN 'unobserved' WHEN 'unknown' IN (l.exposure, r.exposure) THEN 'unknown' ELSE 'assigned' END AS support
 FROM pc l JOIN pc r ON l.identity=r.identity AND l.lo<r.hi AND r.lo<l.hi AND l.stem='view' AND r.stem='click') SELECT *, CASE WHEN support='assigned' THEN left_state=right_state END AS same_state FROM j""",
    "lo hi",
)
def _(i):
    pieces = P.exposures(i.daily().withColumn("state", F.expr(STATE_SQL)), "state", 72.0)
    return J.joint_exposure(by_stem(i, "view", pieces), by_stem(i, "click", pieces), KEYS, 72.0)


@query(
    "transition_opportunities",
    f"""WITH {DAILY_SQL}, {_INT} SELECT l.identity, greatest(l.a,r.a) AS lo, least(l.b,r.b) AS hi, l.state<>l.next_state AS left_changed, r.state<>r.next_state AS right_changed
 FROM lv l JOIN rv r ON l.identity=r.identity AND l.a<r.b AND r.a<l.b WHERE l.state IS NOT NULL AND l.next_state IS NOT NULL AND r.state IS NOT NULL AND r.next_state IS NOT NULL""",
    "lo hi",
)
def _(i):
    c = {"state": "state"}
    return J.transition_support(intervals(i, "view", c), intervals(i, "click", c), KEYS, 72.0)


@query(
    "switch_events_joint_support",
    f"""WITH {DAILY_SQL}, {_INT}, {_JOINT}, m AS (SELECT * FROM lv WHERE state<>next_state),
 c AS (SELECT m.identity, m.a, sum(least(m.b,pc.hi)-greatest(m.a,pc.lo)) AS cv FROM m JOIN pc ON m.identity=pc.identity AND m.a<pc.hi AND pc.lo<m.b GROUP BY 1,2)
 SELECT m.identity, m.a AS from_hours, m.b AS to_hours, state, next_state, coalesce(cv,0.0) AS covered_hours, coalesce(cv,0.0) >= m.b-m.a-1e-9 AS complete, (m.a+m.b)/2 AS at_hours FROM m LEFT JOIN c ON m.identity=c.identity AND m.a=c.a""",
    "from_hours to_hours covered_hours at_hours",
)
def _(i):
    left, right = intervals(i, "view", {"state": "state"}), intervals(i, "click")
    joint = J.joint_intervals(left, right, KEYS, 72.0).where("supported")
    return J.switch_events(left, joint, KEYS, 72.0)


# --- sets and audits -----------------------------------------------------------------------------------


@query(
    "key_audit",
    """SELECT count(*) FILTER (WHERE k IS NOT NULL AND r IS NOT NULL) AS shared, count(*) FILTER (WHERE r IS NULL) AS missing, count(*) FILTER (WHERE k IS NULL) AS spurious,
 count(*) FILTER (WHERE r IS NULL OR k IS NULL) = 0 AS passed FROM (SELECT DISTINCT c_custkey AS k FROM customer) FULL JOIN (SELECT DISTINCT user_id AS r FROM events) ON k=r""",
)
def _(i):
    return J.key_audit(i.table("customer").select(F.col("c_custkey").alias("k")), i.events().select(F.col("identity").alias("k")), ["k"])


@query(
    "lifespan_endings",
    f"""WITH {DAILY_SQL}, {LIFE} SELECT l.stem, l.identity, l.f1 AS last_frame_index, f1=n_frames-1 AS reaches_end, e.m AS mechanism FROM life l JOIN rec USING (stem) LEFT JOIN
 (SELECT a.stem, a.identity, min(b.stem) AS m FROM life a JOIN obs b ON a.identity=b.identity AND b.frame_index=a.f1+1 AND a.stem<>b.stem GROUP BY 1,2) e USING (stem, identity)""",
)
def _(i):
    obs = i.daily()
    spans = P.lifespans(obs).select("stem", "identity", "last_frame_index")
    after = obs.select(F.col("stem").alias("other"), "identity", (F.col("frame_index") - 1).alias("last_frame_index"))
    endings = spans.join(after, ["identity", "last_frame_index"]).where(F.col("other") != F.col("stem")).groupBy("stem", "identity").agg(F.min("other").alias("mechanism"))
    ended = spans.join(i.recordings().select("stem", "n_frames"), "stem").withColumn("reaches_end", F.col("last_frame_index") == F.col("n_frames") - 1).drop("n_frames")
    return ended.join(endings, ["stem", "identity"], "left")


@query(
    "accepted_signal_trace",
    f"""WITH {DAILY_SQL}, v AS (SELECT * FROM obs WHERE stem='view'), ad AS (SELECT identity, frame_index, max(signal) AS signal FROM obs WHERE stem IN ('click','purchase') AND identity IN (SELECT identity FROM v) GROUP BY 1,2),
 u AS (SELECT identity, frame_index, signal, 'observed' AS provenance FROM v UNION ALL SELECT identity, frame_index, signal, 'added' FROM ad WHERE (identity, frame_index) NOT IN (SELECT (identity, frame_index) FROM v))
 SELECT *, CASE WHEN count(signal) OVER w=3 THEN avg(signal) OVER w END AS mean_3 FROM u WINDOW w AS (PARTITION BY identity ORDER BY frame_index RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)""",
    "signal mean_3",
)
def _(i):
    obs = i.daily()
    additions = obs.where(F.col("stem").isin("click", "purchase")).groupBy("identity", "frame_index").agg(F.max("signal").alias("signal"))
    accepted = J.accepted_trace(by_stem(i, "view", obs), additions, KEYS, "signal")
    return K.centred_mean(accepted, "signal", 3, "mean_3", KEYS)


@query(
    "refused_additions",
    f"""WITH {DAILY_SQL}, v AS (SELECT * FROM obs WHERE stem='view'), ad AS (SELECT identity, frame_index, max(signal) AS signal FROM obs WHERE stem IN ('click','purchase') GROUP BY 1,2)
 SELECT ad.*, CASE WHEN identity NOT IN (SELECT identity FROM v) THEN 'unmeasured_identity' ELSE 'observed_frame' END AS reason FROM ad WHERE identity NOT IN (SELECT identity FROM v) OR (identity, frame_index) IN (SELECT (identity, frame_index) FROM v)""",
    "signal",
)
def _(i):
    obs = i.daily()
    additions = obs.where(F.col("stem").isin("click", "purchase")).groupBy("identity", "frame_index").agg(F.max("signal").alias("signal"))
    return J.refused_additions(by_stem(i, "view", obs), additions, KEYS)


@query(
    "residency_mapping",
    f"""WITH {DAILY_SQL} SELECT o.stem, o.identity, o.frame_index+100 AS source_frame, o.frame_index, o.signal FROM obs o WHERE o.frame_index < 25""",
    "signal",
)
def _(i):
    source = i.daily().select("stem", "identity", (F.col("frame_index") + 100).alias("source_frame"), "signal")
    clock = S.frame_clock(i.recordings().withColumn("n_frames", F.lit(25)).withColumn("source_frame_offset", F.lit(100)))
    return source.join(clock.select("stem", "frame_index", F.col("source_frame_index").alias("source_frame")), ["stem", "source_frame"])


def parts(i):
    obs = i.daily()
    return {
        "click": obs.where(F.col("stem") == "click").select("stem", "identity", "frame_index", "signal"),
        "view": obs.where(F.col("stem") == "view").select("stem", "identity", "frame_index", "activity"),
        "error": obs.where(F.col("stem") == "error").select("stem", "identity", "frame_index", "signal", "activity"),
    }


@query(
    "pool_recordings",
    f"WITH {DAILY_SQL} SELECT stem, identity, frame_index, CASE WHEN stem<>'view' THEN signal END AS signal, CASE WHEN stem<>'click' THEN activity END AS activity FROM obs WHERE stem IN ('click','view','error')",
    "signal activity",
)
def _(i):
    return J.pool(parts(i))


@query(
    "pool_ledger",
    f"""WITH {DAILY_SQL} SELECT stem AS part, count(*) AS "rows", CASE stem WHEN 'click' THEN 'activity' WHEN 'view' THEN 'signal' ELSE '' END AS missing_columns FROM obs WHERE stem IN ('click','view','error') GROUP BY 1""",
)
def _(i):
    return J.pool_ledger(parts(i))


@query("table_availability", f"""WITH {DAILY_SQL} SELECT 'frames' AS "table", stem, count(DISTINCT frame_index) AS "rows" FROM obs GROUP BY 2 UNION ALL SELECT 'observations', stem, count(*) FROM obs GROUP BY 2""")
def _(i):
    obs = i.daily()
    return S.table_availability({"observations": obs, "frames": obs.select("stem", "frame_index").distinct()})


@query(
    "add_runs",
    f"WITH {DAILY_SQL} SELECT DISTINCT stem, identity, CASE WHEN frame_index<15 THEN 1 ELSE 2 END AS batch FROM (SELECT stem, identity, min(frame_index) AS frame_index FROM obs GROUP BY 1,2)",
)
def _(i):
    obs = i.daily()
    keys = ["stem", "identity"]
    early = obs.where(F.col("frame_index") < 15).select(*keys).distinct().withColumn("batch", F.lit(1))
    late = obs.where(F.col("frame_index") >= 15).select(*keys).distinct().withColumn("batch", F.lit(2))
    return J.add_runs(early, late, keys)


@query(
    "merge_index_rows",
    f"WITH {DAILY_SQL} SELECT stem, max(frame_index) AS last_frame, CASE WHEN stem IN ('view','click') THEN 'replaced' ELSE 'kept' END AS origin FROM obs WHERE stem<>'signup' OR true GROUP BY 1",
)
def _(i):
    index = i.daily().groupBy("stem").agg(F.max("frame_index").alias("last_frame")).withColumn("origin", F.lit("kept"))
    fresh = index.where(F.col("stem").isin("view", "click")).withColumn("origin", F.lit("replaced"))
    return S.merge_index(index, fresh, ["stem"])


@query("both_windows_entities", f"WITH {DAILY_SQL} SELECT stem, identity FROM obs WHERE frame_index<10 INTERSECT SELECT stem, identity FROM obs WHERE frame_index>=20")
def _(i):
    obs = i.daily()
    side = lambda c: obs.where(c).select("stem", "identity")
    return side(F.col("frame_index") < 10).intersect(side(F.col("frame_index") >= 20))


@query("quicklook_preview", f"""WITH {EVENTS_SQL}, e AS (SELECT stem, identity, count(*) AS n FROM ev GROUP BY 1,2 ORDER BY 1,2 LIMIT 32),
 r AS (SELECT ev.stem, ev.identity, micros, CAST(pow(2, greatest(0, ceil(log2(n/8.0)))) AS BIGINT) AS stride, row_number() OVER (PARTITION BY ev.stem, ev.identity ORDER BY micros) AS rn FROM ev JOIN e USING (stem, identity))
 SELECT stem, identity, micros, stride FROM r WHERE (rn-1) % stride = 0""")
def _(i):
    return S.preview(i.events().select("stem", "identity", "micros"), ["stem", "identity"], "micros", 32, 8)


@query(
    "nested_membership",
    f"""WITH {DAILY_SQL} SELECT stem, frame_index, count(*) AS members FROM obs GROUP BY 1,2""",
)
def _(i):
    listed = i.daily().groupBy("stem", "frame_index").agg(F.count(F.lit(1)).alias("members"), F.struct(F.min("identity").alias("lo"), F.max("identity").alias("hi")).alias("span"))
    kind = listed.schema["span"].dataType
    back = S.text_as_nested(S.nested_as_text(listed), {"span": kind})
    return back.where(F.col("span.lo") <= F.col("span.hi")).drop("span")
