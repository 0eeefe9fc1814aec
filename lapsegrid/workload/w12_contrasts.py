"""Contrasts, state dynamics, trajectories, moving neighbours and streams."""

from pyspark.sql import functions as F

from lapsegrid.functions.numeric import NORMAL_UPPER_SQL
from lapsegrid.operators import contrasts as C
from lapsegrid.operators import pairs as Q
from lapsegrid.sources.canonical import DAILY_SQL, EVENTS_SQL, TRACES_SQL, TRACKS_SQL
from lapsegrid.streaming import streams
from lapsegrid.workload.registry import query
from lapsegrid.workload.w01_rollup import customers
from lapsegrid.workload.w02_presence import STATE_SQL
from lapsegrid.workload.w07_pairs import _CORR
from lapsegrid.workload.w08_stats import CU

E2 = ["stem", "identity"]
_P2 = "least(2.0*" + NORMAL_UPPER_SQL + ", 1.0)"

_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_PAIR = ("HOUSEHOLD", "MACHINERY")


def contrast(name, test, groups=_PAIR, metrics=("value",), aggregate="mean", minimum=4):
    return dict(name=name, metrics=list(metrics), test=test, family="region", group="segment", groups=groups, unit=["nation"], aggregate=aggregate, minimum=minimum)


_L = f"""{CU}, l AS (SELECT region, segment, nation, avg(value) AS v FROM cu GROUP BY 1,2,3), f AS (SELECT * FROM l WHERE segment IN {_PAIR}),
 pr AS (SELECT region, nation, max(v) FILTER (WHERE segment='{_PAIR[0]}') AS a, max(v) FILTER (WHERE segment='{_PAIR[1]}') AS b FROM f GROUP BY 1,2), hs AS (SELECT region, nation, v AS a, CAST(NULL AS DOUBLE) AS b, v AS d FROM l WHERE segment='{_PAIR[0]}')"""
_AVR = "(rank() OVER (PARTITION BY region ORDER BY {v}) + (count(*) OVER (PARTITION BY region, {v}) - 1)/2.0)"
_TIES = "(SELECT region, sum(k**3-k) AS t3 FROM (SELECT region, {v}, CAST(count(*) AS DOUBLE) AS k FROM {t} GROUP BY 1,2) GROUP BY 1)"
_F = "(sum(n*m*m)-sum(n*m)*sum(n*m)/sum(n))/(count(*)-1)/(sum(n*s)/(sum(n)-count(*)))"


def _wilcoxon(source):
    return f"""SELECT region, n_a, n_b, w AS statistic, md AS effect, {_P2.format(z='(abs(w-n*(n+1)/4.0)/sqrt(n*(n+1)*(2*n+1)/24.0-t3/48.0))')} AS p_value FROM (
 SELECT region, sum(CASE WHEN d>0 THEN r ELSE 0 END) AS w, count(*) AS n FROM (SELECT *, {_AVR.format(v='ab')} AS r FROM (SELECT *, round(abs(d),12) AS ab FROM {source} WHERE d IS NOT NULL AND d<>0)) GROUP BY 1)
 JOIN {_TIES.format(v='round(abs(d),12)', t=f'(SELECT * FROM {source} WHERE d IS NOT NULL AND d<>0)')} USING (region) JOIN (SELECT region, count(a) AS n_a, {'count(b)' if source != 'hs' else 'CAST(NULL AS BIGINT)'} AS n_b, quantile_cont(d,0.5) AS md FROM {source} GROUP BY 1) USING (region)"""


#: The tested part of each SQL answer: (region, n_a, n_b, statistic, effect, p_value).
_TESTED = {
    "mannwhitney": f"""SELECT region, n_a, n_b, u AS statistic, ma-mb AS effect, {_P2.format(z='(greatest(abs(u-n_a*n_b/2.0)-0.5,0)/sqrt(s2))')} AS p_value FROM (SELECT *, ra-n_a*(n_a+1)/2.0 AS u, n_a*n_b/12.0*((n_a+n_b+1)-t3/((n_a+n_b)*(n_a+n_b-1.0))) AS s2 FROM (
 SELECT region, sum(r) FILTER (WHERE segment='{_PAIR[0]}') AS ra, count(*) FILTER (WHERE segment='{_PAIR[0]}') AS n_a, count(*) FILTER (WHERE segment='{_PAIR[1]}') AS n_b, quantile_cont(v,0.5) FILTER (WHERE segment='{_PAIR[0]}') AS ma, quantile_cont(v,0.5) FILTER (WHERE segment='{_PAIR[1]}') AS mb
 FROM (SELECT *, {_AVR.format(v='v')} AS r FROM f) GROUP BY 1) JOIN {_TIES.format(v='v', t='f')} USING (region))""",
    "kruskal": f"""SELECT region, n AS n_a, CAST(NULL AS BIGINT) AS n_b, h AS statistic, h/((n*n-1.0)/(n+1)) AS effect, exp(-h/2)*(1+h/2) AS p_value FROM (SELECT region, n, (12.0/(n*(n+1))*q-3*(n+1))/(1-t3/(n*n*n*1.0-n)) AS h FROM (
 SELECT region, sum(s*s/k) AS q, CAST(sum(k) AS BIGINT) AS n FROM (SELECT region, segment, sum(r) AS s, count(*) AS k FROM (SELECT *, {_AVR.format(v='v')} AS r FROM l) GROUP BY 1,2) GROUP BY 1) JOIN {_TIES.format(v='v', t='l')} USING (region))""",
    "welch_t": f"""SELECT region, n_a, n_b, (ma-mb)/sqrt(va/n_a+vb/n_b) AS statistic, (ma-mb)/sqrt(((n_a-1)*va+(n_b-1)*vb)/(n_a+n_b-2))*(1-3.0/(4*(n_a+n_b)-9)) AS effect, p_value FROM ob JOIN
 (SELECT region, (1+count(*) FILTER (WHERE round(abs(d),9)>=round(abs(o),9)))/(count(*)+1) AS p_value FROM (SELECT region, replicate, avg(v) FILTER (WHERE pos<=n_a)-avg(v) FILTER (WHERE pos>n_a) AS d, any_value(ma-mb) AS o FROM dl JOIN ob USING (region) GROUP BY 1,2) GROUP BY 1) USING (region)""",
    "anova": f"""SELECT region, n_a, CAST(NULL AS BIGINT) AS n_b, statistic, effect, p_value FROM ov JOIN (SELECT region, (1+count(*) FILTER (WHERE round(fs,9)>=round(statistic,9)))/(count(*)+1) AS p_value FROM (
 SELECT region, replicate, {_F} AS fs FROM (SELECT region, replicate, label, count(*) AS n, avg(v) AS m, var_pop(v) AS s FROM (SELECT dn.*, (SELECT min(b.segment) FROM bd b WHERE b.region=dn.region AND b.upto>=dn.pos) AS label FROM dn) GROUP BY 1,2,3) GROUP BY 1,2) JOIN ov USING (region) GROUP BY 1) USING (region)""",
    "wilcoxon": _wilcoxon("(SELECT *, a-b AS d FROM pr)"),
    "paired_t": f"""SELECT region, n_a, n_b, m/(sd/sqrt(n)) AS statistic, m/sd*(1-3.0/(4*(n-1)-1)) AS effect, p_value FROM (SELECT region, count(a) AS n_a, count(b) AS n_b, count(a-b) AS n, avg(a-b) AS m, stddev_samp(a-b) AS sd FROM pr GROUP BY 1) JOIN
 (SELECT region, (1+count(*) FILTER (WHERE round(abs(x),9)>=round(abs(o),9)))/(count(*)+1) AS p_value FROM (SELECT region, replicate, avg(CASE WHEN {{draw}}<0.5 THEN a-b ELSE b-a END) AS x FROM (SELECT *, unnest(range(1,200)) AS replicate FROM pr WHERE a-b IS NOT NULL) GROUP BY 1,2) JOIN (SELECT region, avg(a-b) AS o FROM pr GROUP BY 1) USING (region) GROUP BY 1) USING (region)""",
    "signed_rank": _wilcoxon("hs"),
}
_MORE = {
    "welch_t": f""", ob AS (SELECT region, count(*) FILTER (WHERE segment='{_PAIR[0]}') AS n_a, count(*) FILTER (WHERE segment='{_PAIR[1]}') AS n_b, avg(v) FILTER (WHERE segment='{_PAIR[0]}') AS ma, avg(v) FILTER (WHERE segment='{_PAIR[1]}') AS mb, var_samp(v) FILTER (WHERE segment='{_PAIR[0]}') AS va, var_samp(v) FILTER (WHERE segment='{_PAIR[1]}') AS vb FROM f GROUP BY 1),
 dl AS (SELECT *, row_number() OVER (PARTITION BY region, replicate ORDER BY md5(concat_ws('|','7',replicate,region,segment||'|'||nation)), segment||'|'||nation) AS pos FROM (SELECT *, unnest(range(1,200)) AS replicate FROM f))""",
    "anova": f""", dn AS (SELECT *, row_number() OVER (PARTITION BY region, replicate ORDER BY md5(concat_ws('|','7',replicate,region,segment||'|'||nation)), segment||'|'||nation) AS pos FROM (SELECT *, unnest(range(1,200)) AS replicate FROM l)),
 bd AS (SELECT region, segment, sum(n) OVER (PARTITION BY region ORDER BY segment) AS upto FROM (SELECT region, segment, count(*) AS n FROM l GROUP BY 1,2)), ov AS (SELECT region, CAST(sum(n) AS BIGINT) AS n_a, {_F} AS statistic, (sum(n*m*m)-sum(n*m)*sum(n*m)/sum(n))/((sum(n*m*m)-sum(n*m)*sum(n*m)/sum(n))+sum(n*s)) AS effect FROM (SELECT region, segment, count(*) AS n, avg(v) AS m, var_pop(v) AS s FROM l GROUP BY 1,2) GROUP BY 1)""",
}
_SIGN = "(('0x' || substr(md5(concat_ws('|','7',replicate,region,nation)), 1, 12))::BIGINT + 0.5) / 281474976710656.0"


def _contrast_sql(test, refused=()):
    """The answer for one contrast named after its test, with rows for refused metrics or tests."""
    rows = "".join(f" UNION ALL SELECT '{n}', '{m}', '{t}', NULL, NULL, NULL, NULL, {k}, NULL, '{note}', NULL" for n, m, t, k, note in refused)
    return f"""WITH {_L}{_MORE.get(test, '')}, t AS (SELECT 'c' AS contrast, 'value' AS metric, '{test}' AS test, region AS family, n_a, n_b, statistic, '{C.TESTS[test][2]}' AS effect_kind, effect,
 CASE WHEN least(n_a,n_b)<4 THEN 'too few units' END AS note, CASE WHEN least(n_a,n_b)>=4 THEN p_value END AS p_value FROM ({_TESTED[test].format(draw=_SIGN) if test == 'paired_t' else _TESTED[test]}){rows}),
 s AS (SELECT *, coalesce(p_value,1.0) AS p, count(*) OVER (PARTITION BY contrast) AS m, count(*) OVER (PARTITION BY contrast ORDER BY coalesce(p_value,1.0)) AS r FROM t)
 SELECT contrast, metric, test, family, n_a, n_b, statistic, effect_kind, effect, note, p_value, CASE WHEN p_value IS NOT NULL THEN least(min(p*m/r) OVER (PARTITION BY contrast ORDER BY p DESC RANGE UNBOUNDED PRECEDING),1.0) END AS q_value FROM s"""


_GROUPS = {"kruskal": _SEGMENTS, "anova": _SEGMENTS, "signed_rank": _PAIR[:1]}

for _t in C.TESTS:
    query(f"contrast_{_t}", _contrast_sql(_t), "statistic effect p_value q_value", digits=6)(lambda i, t=_t: C.declared_contrasts(customers(i), [contrast("c", t, _GROUPS.get(t, _PAIR))]))


@query(
    "declared_contrasts",
    _contrast_sql("mannwhitney", [("c", "weight", "mannwhitney", "'median_difference'", "no such metric"), ("d", "value", "no_such_test", "NULL", "unknown test no_such_test"), ("e", "value", "welch_t", "'hedges_g'", "welch_t does not take 5 groups")]),
    "statistic effect p_value q_value",
    digits=6,
)
def _(i):
    return C.declared_contrasts(customers(i), [contrast("c", "mannwhitney", metrics=("value", "weight")), contrast("d", "no_such_test"), contrast("e", "welch_t", _SEGMENTS)])


def changes(i):
    """Change of each customer's nation-level balance, two arms of segments, two metrics."""
    base = customers(i).where(F.col("segment").isin("HOUSEHOLD", "MACHINERY")).select(
        "nation", "region", F.when(F.col("segment") == "HOUSEHOLD", "treated").otherwise("control").alias("arm"), "value", "unit"
    )
    a = base.select("nation", "region", "arm", F.lit("balance").alias("metric"), (F.col("value") - 4000).alias("change"), F.lit("d1").alias("definition"))
    b = base.select("nation", "region", "arm", F.lit("sign").alias("metric"), F.when(F.col("value") > 4000, 1.0).otherwise(0.0).alias("change"), F.when(F.col("unit") % 2 == 0, "d1").otherwise("d2").alias("definition"))
    return a.unionByName(b)


_CH = """bs AS (SELECT nation, region, CASE WHEN segment='HOUSEHOLD' THEN 'treated' ELSE 'control' END AS arm, value, unit FROM cu WHERE segment IN ('HOUSEHOLD','MACHINERY')),
 per AS (SELECT metric, arm, nation, any_value(region) AS region, avg(change) AS v, count(DISTINCT d) AS d FROM (SELECT nation, region, arm, 'balance' AS metric, value-4000 AS change, 'd1' AS d FROM bs UNION ALL SELECT nation, region, arm, 'sign', CASE WHEN value>4000 THEN 1.0 ELSE 0.0 END, CASE WHEN unit%2=0 THEN 'd1' ELSE 'd2' END FROM bs) GROUP BY 1,2,3),
 mx AS (SELECT metric, max(d) AS d FROM per GROUP BY 1)"""


_Q = """g AS (SELECT metric, n_a, n_b, CASE WHEN d<=1 THEN e END AS estimate, CASE WHEN d<=1 THEN st END AS statistic, CASE WHEN d<=1 THEN ef END AS effect, CASE WHEN d<=1 THEN p END AS p_value, CASE WHEN d>1 THEN 'mixed definitions' ELSE '' END AS reasons FROM s JOIN mx USING (metric) LEFT JOIN pv USING (metric)),
 k AS (SELECT *, coalesce(p_value,1.0) AS p1, count(*) OVER () AS m, count(*) OVER (ORDER BY coalesce(p_value,1.0)) AS r FROM g)
 SELECT metric, n_a, n_b, estimate, statistic, effect, p_value, CASE WHEN p_value IS NOT NULL THEN least(min(p1*m/r) OVER (ORDER BY p1 DESC RANGE UNBOUNDED PRECEDING),1.0) END AS q_value, reasons FROM k"""
_FLIP = "(('0x' || substr(md5(concat_ws('|','7',replicate,metric,nation)), 1, 12))::BIGINT + 0.5) / 281474976710656.0"


@query(
    "treatment_vs_control_matched",
    f"""WITH {CU}, {_CH}, b AS (SELECT coalesce(t.metric,c.metric) AS metric, coalesce(t.nation,c.nation) AS nation, t.v AS t, c.v AS c FROM (SELECT * FROM per WHERE arm='treated') t FULL JOIN (SELECT * FROM per WHERE arm='control') c ON t.metric=c.metric AND t.nation=c.nation),
 s AS (SELECT metric, count(t) AS n_a, count(c) AS n_b, avg(t-c) AS e, avg(t-c)/(stddev_samp(t-c)/sqrt(count(t-c))) AS st, avg(t-c)/stddev_samp(t-c) AS ef FROM b GROUP BY 1),
 pv AS (SELECT metric, (1+count(*) FILTER (WHERE round(abs(x),9)>=round(abs(e),9)))/(count(*)+1) AS p FROM (SELECT metric, replicate, avg(CASE WHEN {_FLIP}<0.5 THEN t-c ELSE c-t END) AS x FROM (SELECT *, unnest(range(1,200)) AS replicate FROM b WHERE t-c IS NOT NULL) GROUP BY 1,2) JOIN s USING (metric) GROUP BY 1), {_Q}""",
    "estimate statistic effect p_value q_value",
    digits=6,
)
def _(i):
    return C.treatment_vs_control(changes(i), ["nation"], "arm", "nation", 5)


@query(
    "treatment_vs_control_independent",
    f"""WITH {CU}, {_CH}, s AS (SELECT *, ma-mb AS e, (ma-mb)/sqrt(va/n_a+vb/n_b) AS st, (ma-mb)/sqrt(((n_a-1)*va+(n_b-1)*vb)/(n_a+n_b-2))*(1-3.0/(4*(n_a+n_b)-9)) AS ef FROM (
 SELECT metric, count(v) FILTER (WHERE arm='treated') AS n_a, count(v) FILTER (WHERE arm='control') AS n_b, avg(v) FILTER (WHERE arm='treated') AS ma, avg(v) FILTER (WHERE arm='control') AS mb, var_samp(v) FILTER (WHERE arm='treated') AS va, var_samp(v) FILTER (WHERE arm='control') AS vb FROM per GROUP BY 1)),
 dl AS (SELECT *, row_number() OVER (PARTITION BY metric, replicate ORDER BY md5(concat_ws('|','7',replicate,metric,arm||'|'||nation)), arm||'|'||nation) AS pos FROM (SELECT *, unnest(range(1,200)) AS replicate FROM per WHERE v IS NOT NULL)),
 pv AS (SELECT metric, (1+count(*) FILTER (WHERE round(abs(x),9)>=round(abs(o),9)))/(count(*)+1) AS p FROM (SELECT metric, replicate, avg(v) FILTER (WHERE pos<=n_a)-avg(v) FILTER (WHERE pos>n_a) AS x, any_value(e) AS o FROM dl JOIN s USING (metric) GROUP BY 1,2) GROUP BY 1), {_Q}""",
    "estimate statistic effect p_value q_value",
    digits=6,
)
def _(i):
    return C.treatment_vs_control(changes(i), ["nation"], "arm", None, 5)


_DYN = f"""sr AS (SELECT stem, identity, hours, coalesce({STATE_SQL},'none') AS s FROM tr), ld AS (SELECT *, lead(hours) OVER w AS h2, lead(s) OVER w AS s2 FROM sr WINDOW w AS (PARTITION BY stem, identity ORDER BY hours)), md AS (SELECT stem, identity, quantile_cont(h2-hours,0.5) AS m FROM ld WHERE h2 IS NOT NULL GROUP BY 1,2),
 mo AS (SELECT ld.stem, ld.identity, hours, h2, s, s2, h2-hours AS g FROM ld JOIN md USING (stem, identity) WHERE h2-hours<=1.5*m), tt AS (SELECT stem, identity, sum(g) AS observed_hours, count(*) AS steps, count(*) FILTER (WHERE s<>s2) AS changes FROM mo GROUP BY 1,2)"""


def dynamics(i):
    return C.state_dynamics(i.traces().withColumn("state", F.coalesce(F.expr(STATE_SQL), F.lit("none"))), "state")


@query("state_occupancy", f"WITH {TRACES_SQL}, {_DYN}, o AS (SELECT stem, identity, s AS state, sum(g/2) AS hours FROM (SELECT stem, identity, s, g FROM mo UNION ALL SELECT stem, identity, s2, g FROM mo) GROUP BY 1,2,3) SELECT o.*, observed_hours, hours/observed_hours AS fraction FROM o JOIN tt USING (stem, identity)", "hours observed_hours fraction")
def _(i):
    return dynamics(i)[0]


@query("state_transitions", f"WITH {TRACES_SQL}, {_DYN} SELECT stem, identity, s AS from_state, s2 AS to_state, count(*) AS n FROM mo GROUP BY 1,2,3,4")
def _(i):
    return dynamics(i)[1]


@query("state_change_rates", f"WITH {TRACES_SQL}, {_DYN} SELECT *, changes/observed_hours AS change_rate FROM tt", "observed_hours change_rate")
def _(i):
    return dynamics(i)[2]


@query(
    "persistence_caveat",
    f"""WITH {TRACES_SQL}, {_DYN} SELECT stem, identity, 24.0*(identity%3+1) AS period, changes/observed_hours AS change_rate, CASE WHEN observed_hours IS NULL THEN 'no_dynamics' WHEN changes/observed_hours*24.0*(identity%3+1)<2.0 THEN 'persistent_state' ELSE 'none' END AS caveat FROM (SELECT DISTINCT stem, identity FROM tr) LEFT JOIN tt USING (stem, identity)""",
    "period change_rate",
)
def _(i):
    declared = i.traces().select(*E2).distinct().withColumn("period", F.lit(24.0) * (F.col("identity") % 3 + 1))
    return C.persistence_caveat(declared, dynamics(i)[2], 2.0)


_DRAW = "((('0x' || substr(md5({t}), 1, 12))::BIGINT + 0.5) / 281474976710656.0)"
_RUN = "row_number() OVER w AS p, coalesce(frame_index - lag(frame_index) OVER w = 1, false) AS near"
_AR1 = _DRAW.format(t="concat_ws('|','41',replicate,stem,identity,frame_index)")
_AR2 = _DRAW.format(t="concat_ws('|','b','41',replicate,stem,identity,frame_index)")


@query(
    "autoregressive_surrogates",
    f"""WITH RECURSIVE {TRACES_SQL}, o AS (SELECT stem, identity, frame_index, signal AS v, lag(signal) OVER w AS pv, {_RUN} FROM tr WHERE signal IS NOT NULL WINDOW w AS (PARTITION BY stem, identity ORDER BY frame_index)),
 f AS (SELECT stem, identity, avg(v) AS m, stddev_pop(v) AS sd, greatest(least(coalesce({_CORR.format(a='a', b='b')}, 0.0), 1-1e-6), -(1-1e-6)) AS phi FROM (SELECT *, CASE WHEN near THEN v END AS a, CASE WHEN near THEN pv END AS b FROM o) GROUP BY 1,2),
 e AS (SELECT stem, identity, replicate, frame_index, p, near, sqrt(-2*ln({_AR1}))*cos(2*pi()*{_AR2}) AS e FROM (SELECT *, unnest([1,2]) AS replicate FROM o)),
 x AS (SELECT stem, identity, replicate, p, frame_index, e AS x FROM e WHERE p=1
  UNION ALL SELECT e.stem, e.identity, e.replicate, e.p, e.frame_index, CASE WHEN e.near THEN phi*x.x + sqrt(1-phi*phi)*e.e ELSE e.e END FROM x JOIN e ON e.stem=x.stem AND e.identity=x.identity AND e.replicate=x.replicate AND e.p=x.p+1 JOIN f ON f.stem=x.stem AND f.identity=x.identity)
 SELECT stem, identity, CAST(replicate AS INTEGER) AS replicate, frame_index, m + sd*x AS signal FROM x JOIN f USING (stem, identity)""",
    "signal",
    digits=6,
)
def _(i):
    return C.autoregressive_surrogates(i.traces(), "signal", 2, 41)


_PU = _DRAW.format(t="concat_ws('|','43',stem,identity,frame_index)")


@query(
    "persistence_resample",
    f"""WITH RECURSIVE {TRACES_SQL}, o AS (SELECT *, lag(s) OVER w AS ps, {_RUN}, {_PU} AS u FROM (SELECT stem, identity, frame_index, coalesce({STATE_SQL},'none') AS s FROM tr) WINDOW w AS (PARTITION BY stem, identity ORDER BY frame_index)),
 mv AS (SELECT stem, identity, ps, s, count(*) AS n FROM o WHERE near GROUP BY 1,2,3,4), sh AS (SELECT stem, identity, s, count(*) AS n FROM o GROUP BY 1,2,3),
 cm AS (SELECT stem, identity, ps, s, sum(n) OVER (PARTITION BY stem, identity, ps ORDER BY s)/CAST(sum(n) OVER (PARTITION BY stem, identity, ps) AS DOUBLE) AS upto FROM mv),
 cs AS (SELECT stem, identity, s, sum(n) OVER (PARTITION BY stem, identity ORDER BY s)/CAST(sum(n) OVER (PARTITION BY stem, identity) AS DOUBLE) AS upto FROM sh),
 st AS (SELECT o.stem, o.identity, o.p, min(cs.s) AS fresh FROM o JOIN cs ON cs.stem=o.stem AND cs.identity=o.identity AND cs.upto>=o.u WHERE NOT near GROUP BY 1,2,3),
 nx AS (SELECT o.stem, o.identity, o.p, cm.ps, min(cm.s) AS target FROM o JOIN cm ON cm.stem=o.stem AND cm.identity=o.identity AND cm.upto>=o.u WHERE near GROUP BY 1,2,3,4),
 w AS (SELECT stem, identity, p, fresh AS state FROM st WHERE p=1
  UNION ALL SELECT o.stem, o.identity, o.p, CASE WHEN NOT o.near THEN st.fresh ELSE coalesce(nx.target, w.state) END FROM w JOIN o ON o.stem=w.stem AND o.identity=w.identity AND o.p=w.p+1
  LEFT JOIN st ON st.stem=o.stem AND st.identity=o.identity AND st.p=o.p LEFT JOIN nx ON nx.stem=o.stem AND nx.identity=o.identity AND nx.p=o.p AND nx.ps=w.state)
 SELECT stem, identity, frame_index, state FROM w JOIN (SELECT stem, identity, p, frame_index FROM o) USING (stem, identity, p)""",
)
def _(i):
    rows = i.traces().withColumn("state", F.coalesce(F.expr(STATE_SQL), F.lit("none")))
    return C.persistence_resample(rows, "state", ["high", "low", "middle", "none"], 43)


@query(
    "moving_neighbours",
    f"""WITH {TRACKS_SQL}, r AS (SELECT a.stem, a.frame_index, a.identity, b.identity AS o, sqrt((a.y-b.y)**2+(a.x-b.x)**2) AS d, row_number() OVER (PARTITION BY a.stem, a.frame_index, a.identity ORDER BY round(sqrt((a.y-b.y)**2+(a.x-b.x)**2),9), b.identity) AS k FROM tk a JOIN tk b ON a.stem=b.stem AND a.frame_index=b.frame_index AND a.identity<>b.identity)
 SELECT stem, frame_index, least(identity,o) AS identity_a, greatest(identity,o) AS identity_b, min(d) AS distance FROM r WHERE k<=2 GROUP BY 1,2,3,4""",
    "distance",
)
def _(i):
    return C.moving_neighbours(i.tracks(), 2, 4.0)


# --- streams ---------------------------------------------------------------------------------------------


def arriving(i):
    schema = i.table("events").schema
    raw = streams.file_stream(i.spark, f"{i.folder}/event[s].parquet", schema)
    return raw.select(F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("event_type").alias("stem"), F.col("user_id").alias("identity"), F.round(F.col("value") * 100).cast("long").alias("cents"))


def _hours(column):
    return (F.unix_micros(column) - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / F.lit(3.6e9)


@query("stream_pooled_ingest", f"WITH {EVENTS_SQL} SELECT event_id, stem, identity, cents FROM ev")
def _(i):
    twice = arriving(i).unionByName(arriving(i))
    pooled = streams.pooled_ingest(twice, ["event_id"], "ts", "2 days")
    return streams.run_available(pooled, "pooled").select("event_id", "stem", "identity", "cents")


@query(
    "stream_window_rollup",
    f"""WITH {EVENTS_SQL} SELECT stem, CAST(micros//86400000000*24 AS DOUBLE) AS from_hours, count(*) AS observations, CAST(sum(cents) AS BIGINT) AS total, min(cents) AS least, max(cents) AS greatest FROM ev
 GROUP BY 1,2 HAVING (micros//86400000000*24)*3600000000+86400000000 <= (SELECT max(micros) FROM ev)-600000000""".replace("HAVING (micros//86400000000*24)*3600000000", "HAVING from_hours*3600000000"),
    "from_hours",
)
def _(i):
    rolled = streams.window_rollup(arriving(i), ["stem"], "ts", "cents", "1 day", "10 minutes")
    return streams.run_available(rolled, "rollup").select("stem", _hours(F.col("w.start")).alias("from_hours"), "observations", "total", "least", "greatest")


@query(
    "stream_presence_sessions",
    f"""WITH {EVENTS_SQL}, g AS (SELECT identity, micros, sum(CASE WHEN p IS NULL OR micros-p >= 43200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY identity ORDER BY micros) AS s FROM (SELECT *, lag(micros) OVER (PARTITION BY identity ORDER BY micros) AS p FROM ev)),
 z AS (SELECT identity, s, count(*) AS observations, min(micros) AS a, max(micros) AS b FROM g GROUP BY 1,2) SELECT identity, observations, a/3.6e9 AS first_hours, b/3.6e9 AS last_hours FROM z WHERE b+43200000000 <= (SELECT max(micros) FROM ev)-600000000""",
    "first_hours last_hours",
    digits=4,
)
def _(i):
    s = streams.presence_sessions(arriving(i), ["identity"], "ts", "12 hours", "10 minutes")
    return streams.run_available(s, "sessions").select("identity", "observations", _hours(F.col("first_at")).alias("first_hours"), _hours(F.col("last_at")).alias("last_hours"))
