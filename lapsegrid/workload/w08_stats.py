"""Tests, corrections, permutation nulls, associations, anchored windows and scoring."""

from pyspark.sql import functions as F

from lapsegrid.functions.numeric import NORMAL_UPPER_SQL, ratio
from lapsegrid.operators import pairs as Q
from lapsegrid.operators import pixels as X
from lapsegrid.operators import regimes as G
from lapsegrid.operators import stats as S
from lapsegrid.sources.canonical import DAILY_SQL, EVENTS_SQL, PIXELS_SQL, TRACES_SQL, TRACKS_SQL
from lapsegrid.workload.registry import query
from lapsegrid.workload.w01_rollup import customers
from lapsegrid.workload.w04_joins import HOUR, NEAREST, by_stem, nearest
from lapsegrid.workload.w05_regimes import BASE, MOVES, classed
from lapsegrid.workload.w06_pixels import CONTACTS
from lapsegrid.workload.w07_pairs import MED, PAIRCORR

CU = "cu AS (SELECT r_name AS region, n_name AS nation, c_mktsegment AS segment, c_custkey AS unit, c_acctbal AS value FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey)"
PAIR = ("HOUSEHOLD", "MACHINERY")
_P2 = "least(2.0*" + NORMAL_UPPER_SQL + ", 1.0)"


def _rank(by, of):
    return f"(rank() OVER (PARTITION BY {by} ORDER BY {of}) + (count(*) OVER (PARTITION BY {by}, {of}) - 1)/2.0)"


@query(
    "mann_whitney",
    f"""WITH {CU}, f AS (SELECT * FROM cu WHERE segment IN ('HOUSEHOLD','MACHINERY')), r AS (SELECT *, {_rank('region', 'value')} AS rk FROM f), t AS (SELECT region, sum(k**3-k) AS t3, sum(k) AS n FROM (SELECT region, value, CAST(count(*) AS DOUBLE) AS k FROM f GROUP BY 1,2) GROUP BY 1),
 s AS (SELECT region, sum(rk) FILTER (WHERE segment='HOUSEHOLD') AS ra, count(*) FILTER (WHERE segment='HOUSEHOLD') AS n_a, count(*) FILTER (WHERE segment='MACHINERY') AS n_b FROM r GROUP BY 1),
 u AS (SELECT s.*, t3, n, ra-n_a*(n_a+1)/2.0 AS u_statistic, n_a*n_b/12.0*((n+1)-t3/(n*(n-1))) AS s2 FROM s JOIN t USING (region)), z AS (SELECT *, greatest(abs(u_statistic-n_a*n_b/2.0)-0.5,0)/sqrt(s2) AS z FROM u)
 SELECT region, n_a, n_b, u_statistic, {_P2.format(z='z')} AS p_value, 2.0*u_statistic/(n_a*n_b)-1 AS effect FROM z""",
    "u_statistic p_value effect",
)
def _(i):
    return S.mann_whitney(customers(i), ["region"], "segment", PAIR, "value")


@query(
    "kruskal_wallis",
    f"""WITH {CU}, r AS (SELECT *, {_rank('segment', 'value')} AS rk FROM cu), t AS (SELECT segment, sum(k**3-k) AS t3, sum(k) AS n FROM (SELECT segment, value, CAST(count(*) AS DOUBLE) AS k FROM cu GROUP BY 1,2) GROUP BY 1),
 g AS (SELECT segment, sum(s*s/k) AS q, count(*) AS groups FROM (SELECT segment, region, sum(rk) AS s, count(*) AS k FROM r GROUP BY 1,2) GROUP BY 1), h AS (SELECT segment, groups, n, (12.0/(n*(n+1))*q-3*(n+1))/(1-t3/(n**3-n)) AS h FROM g JOIN t USING (segment))
 SELECT segment, groups, CAST(n AS BIGINT) AS n, h AS h_statistic, exp(-h/2)*(1+h/2) AS p_value, h/((n*n-1)/(n+1)) AS epsilon_squared FROM h WHERE groups=5""",
    "h_statistic p_value epsilon_squared",
    digits=7,
)
def _(i):
    return S.kruskal_wallis(customers(i), ["segment"], "region", 5, "value")


_HALF = "hv AS (SELECT stem, identity, avg(signal) FILTER (WHERE frame_index<15) AS a, avg(signal) FILTER (WHERE frame_index>=15) AS b FROM obs GROUP BY 1,2), df AS (SELECT *, b-a AS d FROM hv)"


def halves(i):
    early = F.col("frame_index") < 15
    return i.daily().groupBy("stem", "identity").agg(F.avg(F.when(early, F.col("signal"))).alias("a"), F.avg(F.when(~early, F.col("signal"))).alias("b")).withColumn(
        "d", F.col("b") - F.col("a")
    )


@query(
    "signed_rank",
    f"""WITH {DAILY_SQL}, {_HALF}, f AS (SELECT *, round(abs(d),12) AS ab FROM df WHERE d IS NOT NULL AND d<>0), r AS (SELECT *, {_rank('stem', 'ab')} AS rk FROM f), t AS (SELECT stem, sum(k**3-k) AS t3 FROM (SELECT stem, ab, CAST(count(*) AS DOUBLE) AS k FROM f GROUP BY 1,2) GROUP BY 1),
 s AS (SELECT stem, count(*) AS n, sum(CASE WHEN d>0 THEN rk ELSE 0 END) AS w_plus FROM r GROUP BY 1), z AS (SELECT s.*, abs(w_plus-n*(n+1)/4.0)/sqrt(n*(n+1)*(2*n+1)/24.0-t3/48.0) AS z FROM s JOIN t USING (stem))
 SELECT stem, n, w_plus, {_P2.format(z='z')} AS p_value, 2*w_plus/(n*(n+1)/2.0)-1 AS effect FROM z""",
    "w_plus p_value effect",
)
def _(i):
    return S.signed_rank(halves(i), ["stem"], "d")


@query(
    "welch_test",
    f"""WITH {CU}, s AS (SELECT region, count(value) FILTER (WHERE segment='HOUSEHOLD') AS n_a, count(value) FILTER (WHERE segment='MACHINERY') AS n_b, avg(value) FILTER (WHERE segment='HOUSEHOLD') AS mean_a, avg(value) FILTER (WHERE segment='MACHINERY') AS mean_b,
 var_samp(value) FILTER (WHERE segment='HOUSEHOLD') AS va, var_samp(value) FILTER (WHERE segment='MACHINERY') AS vb FROM cu GROUP BY 1)
 SELECT region, n_a, n_b, mean_a, mean_b, mean_a-mean_b AS difference, (mean_a-mean_b)/sqrt(va/n_a+vb/n_b) AS t_statistic, (va/n_a+vb/n_b)**2/((va/n_a)**2/(n_a-1)+(vb/n_b)**2/(n_b-1)) AS degrees_of_freedom,
 (mean_a-mean_b)/sqrt(((n_a-1)*va+(n_b-1)*vb)/(n_a+n_b-2))*(1-3.0/(4*(n_a+n_b)-9)) AS hedges_g FROM s""",
    "mean_a mean_b difference t_statistic degrees_of_freedom hedges_g",
    digits=6,
)
def _(i):
    return S.welch(customers(i), ["region"], "segment", PAIR, "value")


@query(
    "one_way_anova",
    f"""WITH {CU}, g AS (SELECT segment, region, count(value) AS n, avg(value) AS m, var_pop(value) AS v FROM cu GROUP BY 1,2), s AS (SELECT segment, sum(n) AS n, count(*) AS groups, sum(n*v) AS w, sum(n*m*m)-sum(n*m)*sum(n*m)/sum(n) AS b FROM g GROUP BY 1)
 SELECT segment, CAST(n AS BIGINT) AS n, groups, (b/(groups-1))/(w/(n-groups)) AS f_statistic, b/(b+w) AS eta_squared FROM s""",
    "f_statistic eta_squared",
    digits=7,
)
def _(i):
    return S.anova(customers(i), ["segment"], "region", "value")


@query("paired_t", f"WITH {DAILY_SQL}, {_HALF} SELECT stem, count(d) AS n, avg(d) AS mean_difference, stddev_samp(d) AS sd, avg(d)/(stddev_samp(d)/sqrt(count(d))) AS t_statistic, avg(d)/stddev_samp(d) AS effect FROM df GROUP BY 1", "mean_difference sd t_statistic effect", digits=7)
def _(i):
    return S.paired_t(halves(i), ["stem"], "d")


@query(
    "permutation_test",
    f"""WITH {CU}, f AS (SELECT * FROM cu WHERE segment IN ('HOUSEHOLD','MACHINERY')), o AS (SELECT region, count(*) FILTER (WHERE segment='HOUSEHOLD') AS n_a, avg(value) FILTER (WHERE segment='HOUSEHOLD')-avg(value) FILTER (WHERE segment='MACHINERY') AS observed FROM f GROUP BY 1),
 r AS (SELECT *, unnest(range(1,20)) AS replicate FROM f), p AS (SELECT *, row_number() OVER (PARTITION BY region, replicate ORDER BY md5(concat_ws('|','3',replicate,region,unit)), unit) AS pos FROM r),
 d AS (SELECT region, replicate, avg(value) FILTER (WHERE pos<=n_a)-avg(value) FILTER (WHERE pos>n_a) AS d, any_value(observed) AS observed FROM p JOIN o USING (region) GROUP BY 1,2)
 SELECT region, max(observed) AS observed, avg(d) AS null_mean, count(*) AS replicates, (1+count(*) FILTER (WHERE round(abs(d),9)>=round(abs(observed),9)))/(count(*)+1) AS p_value FROM d GROUP BY 1""",
    "observed null_mean p_value",
    digits=6,
)
def _(i):
    return S.permuted_difference(customers(i), ["region"], "segment", PAIR, "unit", "value", 19, 3)


_TESTS = f"""ts AS (SELECT stem, identity, avg(signal) AS m, CASE WHEN count(*)>=8 THEN abs(avg(signal)-40)/(stddev_samp(signal)/sqrt(count(*))) END AS z FROM obs GROUP BY 1,2), pv AS (SELECT stem, identity, CASE WHEN z IS NOT NULL THEN {_P2.format(z='z')} END AS p_value FROM ts)"""


def tests(i):
    t = i.daily().groupBy("stem", "identity").agg(F.count(F.lit(1)).alias("n"), F.avg("signal").alias("m"), F.stddev_samp("signal").alias("s"))
    z = F.when(F.col("n") >= 8, F.abs(F.col("m") - 40) / (F.col("s") / F.sqrt("n")))
    return t.withColumn("z", z).select("stem", "identity", F.when(F.col("z").isNotNull(), S.two_sided(F.col("z"))).alias("p_value"))


@query(
    "corrected_families",
    f"""WITH {DAILY_SQL}, {_TESTS}, s AS (SELECT *, coalesce(p_value,1.0) AS p, count(*) OVER (PARTITION BY stem) AS family_size, count(*) OVER (PARTITION BY stem ORDER BY coalesce(p_value,1.0)) AS r FROM pv),
 q AS (SELECT *, min(p*family_size/r) OVER (PARTITION BY stem ORDER BY p DESC RANGE UNBOUNDED PRECEDING) AS q FROM s)
 SELECT stem, identity, p_value, family_size, CASE WHEN p_value IS NOT NULL THEN least(q,1.0) END AS q_bh, CASE WHEN p_value IS NOT NULL THEN least(p_value*family_size,1.0) END AS p_bonferroni, CASE WHEN p_value IS NOT NULL THEN 1-(1-p_value)**family_size END AS p_sidak FROM q""",
    "p_value q_bh p_bonferroni p_sidak",
)
def _(i):
    return S.corrected(tests(i), ["stem"], "p_value")


_AL = """top AS (SELECT * FROM (SELECT stem, identity, frame_index, row_number() OVER (PARTITION BY stem, identity ORDER BY signal DESC, frame_index) AS r FROM tr) WHERE r<=1),
 al AS (SELECT top.stem, top.identity, top.frame_index AS event_frame, tr.frame_index-top.frame_index AS "offset", signal FROM top JOIN tr ON tr.stem=top.stem AND tr.identity=top.identity AND tr.frame_index BETWEEN top.frame_index-3 AND top.frame_index+3)"""


@query(
    "bootstrap_event_band",
    f"""WITH {TRACES_SQL}, {_AL}, ev2 AS (SELECT stem, identity, event_frame, row_number() OVER (PARTITION BY stem ORDER BY md5(concat_ws('|',identity,event_frame)), identity, event_frame) AS pos, count(*) OVER (PARTITION BY stem) AS n FROM (SELECT DISTINCT stem, identity, event_frame FROM al)),
 dw AS (SELECT stem, n, pos, unnest(range(1,20)) AS replicate FROM ev2), pk AS (SELECT stem, replicate, CAST('0x' || substr(md5(concat_ws('|','9',replicate,pos)),1,12) AS BIGINT) % n + 1 AS pos, count(*) AS w FROM dw GROUP BY ALL),
 cv AS (SELECT pk.stem, replicate, "offset", sum(w*signal)/sum(w) AS m FROM pk JOIN ev2 USING (stem, pos) JOIN al USING (stem, identity, event_frame) GROUP BY ALL)
 SELECT a.stem, a."offset", a.mean, a.events, b.low, b.high FROM (SELECT stem, "offset", avg(signal) AS mean, count(signal) AS events FROM al GROUP BY 1,2) a LEFT JOIN (SELECT stem, "offset", quantile_cont(m,0.025) AS low, quantile_cont(m,0.975) AS high FROM cv GROUP BY 1,2) b USING (stem, "offset")""",
    "mean low high",
    digits=7,
)
def _(i):
    tr = i.traces()
    al = G.align(tr, G.ranked_events(tr, "signal", "high", 1), "signal", 3, 3)
    return S.bootstrap_band(al, "signal", ["stem"], ["identity", "event_frame"], 19, 9)


@query(
    "coverage_order_test",
    f"""WITH {PIXELS_SQL}, fr AS (SELECT DISTINCT stem, identity, frame_index FROM mk), rp AS (SELECT *, unnest(range(10)) AS replicate FROM fr),
 od AS (SELECT *, row_number() OVER (PARTITION BY stem, identity, replicate ORDER BY CASE WHEN replicate=0 THEN '' ELSE md5(concat_ws('|','13',replicate,stem,identity,frame_index)) END, frame_index) AS slot FROM rp),
 n AS (SELECT stem, identity, count(DISTINCT frame_index) AS n, count(DISTINCT (y,x)) AS u FROM mk GROUP BY 1,2), f AS (SELECT stem, identity, replicate, y, x, min(slot) AS s FROM mk JOIN od USING (stem, identity, frame_index) GROUP BY ALL),
 a AS (SELECT stem, identity, replicate, sum(n-s+1)/max(n*u) AS auc FROM f JOIN n USING (stem, identity) GROUP BY 1,2,3), o AS (SELECT stem, identity, auc AS observed FROM a WHERE replicate=0), m AS (SELECT stem, identity, avg(auc) AS null_mean FROM a WHERE replicate>0 GROUP BY 1,2)
 SELECT stem, identity, max(observed) AS observed, max(null_mean) AS null_mean, (1+count(*) FILTER (WHERE round(abs(auc-null_mean),12)>=round(abs(observed-null_mean),12)))/(count(*)+1) AS p_value FROM a JOIN o USING (stem, identity) JOIN m USING (stem, identity) WHERE replicate>0 GROUP BY 1,2""",
    "observed null_mean p_value",
)
def _(i):
    return S.coverage_order_test(i.masks(), 9, 13)


@query(
    "transition_null_band",
    f"""{BASE}, {MOVES}, ob AS (SELECT stem, from_regime, to_regime, count(*) AS n FROM mv GROUP BY 1,2,3), rp AS (SELECT stem, identity, from_frame_index, from_regime, to_regime, unnest(range(1,10)) AS replicate FROM mv),
 pl AS (SELECT *, row_number() OVER (PARTITION BY stem, replicate ORDER BY from_frame_index, identity) AS p, row_number() OVER (PARTITION BY stem, replicate ORDER BY md5(concat_ws('|','21',replicate,stem,identity,from_frame_index)), from_frame_index, identity) AS h FROM rp),
 ct AS (SELECT a.stem, a.replicate, a.from_regime, b.to_regime, count(*) AS k FROM pl a JOIN pl b ON a.stem=b.stem AND a.replicate=b.replicate AND a.p=b.h GROUP BY ALL),
 fl AS (SELECT ob.stem, ob.from_regime, ob.to_regime, ob.n, coalesce(k,0) AS k FROM ob CROSS JOIN range(1,10) r(replicate) LEFT JOIN ct ON ct.stem=ob.stem AND ct.replicate=r.replicate AND ct.from_regime=ob.from_regime AND ct.to_regime=ob.to_regime)
 SELECT stem, from_regime, to_regime, any_value(n) AS n, quantile_cont(CAST(k AS DOUBLE),0.025) AS null_low, quantile_cont(CAST(k AS DOUBLE),0.5) AS null_mid, quantile_cont(CAST(k AS DOUBLE),0.975) AS null_high FROM fl GROUP BY 1,2,3""",
    "null_low null_mid null_high",
)
def _(i):
    return S.transition_null_band(G.transitions(classed(i)), ["stem"], 9, 21)


@query(
    "shuffled_surrogates",
    f"""WITH {TRACES_SQL}, rp AS (SELECT stem, identity, frame_index, signal, unnest(range(1,4)) AS replicate FROM tr),
 p AS (SELECT *, row_number() OVER (PARTITION BY stem, identity, replicate ORDER BY frame_index) AS p, row_number() OVER (PARTITION BY stem, identity, replicate ORDER BY md5(concat_ws('|','5',replicate,stem,identity,frame_index)), frame_index) AS h FROM rp)
 SELECT a.stem, a.identity, a.replicate, a.frame_index, b.signal FROM p a JOIN p b ON a.stem=b.stem AND a.identity=b.identity AND a.replicate=b.replicate AND a.p=b.h""",
    "signal",
)
def _(i):
    return Q.shuffled(i.traces(), ["signal"], 3, 5)


# --- associations ----------------------------------------------------------------------------------------

_MV = f"{NEAREST.format(lag=0, tol=24 * HOUR)}, mvv AS (SELECT nu.identity, CAST(l.cents AS DOUBLE) AS va, CAST(r.cents AS DOUBLE) AS vb FROM nu JOIN ev l ON l.stem='view' AND l.identity=nu.identity AND l.micros=reference_at JOIN ev r ON r.stem='click' AND r.identity=nu.identity AND r.micros=target_at WHERE match_status='matched')"
_OKC = "CASE WHEN stddev_pop({a})>1e-9*max(abs({a})) AND stddev_pop({b})>1e-9*max(abs({b})) THEN corr({a},{b}) END"


def matched_values(i):
    ev = i.events().select("stem", "identity", "micros", F.col("cents").cast("double").alias("cents"))
    m = nearest(i, 0, 24 * HOUR).where(F.col("match_status") == "matched")
    return m.join(by_stem(i, "view", ev).select("identity", F.col("micros").alias("reference_at"), F.col("cents").alias("va")), ["identity", "reference_at"]).join(
        by_stem(i, "click", ev).select("identity", F.col("micros").alias("target_at"), F.col("cents").alias("vb")), ["identity", "target_at"]
    )


@query(
    "matched_association",
    f"""WITH {EVENTS_SQL}, {_MV}, r AS (SELECT *, {_rank('identity', 'va')} AS ra, {_rank('identity', 'vb')} AS rb FROM mvv), s AS (SELECT identity, count(*) AS n, {_OKC.format(a='va', b='vb')} AS p, {_OKC.format(a='ra', b='rb')} AS s FROM r GROUP BY 1)
 SELECT identity, n, CASE WHEN n>=4 THEN p END AS pearson, CASE WHEN n>=4 THEN s END AS spearman, CASE WHEN n<4 THEN 'insufficient' WHEN p IS NULL THEN 'constant' ELSE 'estimated' END AS status FROM s""",
    "pearson spearman",
    digits=7,
)
def _(i):
    return S.association(matched_values(i), ["identity"], "va", "vb", 4)


@query(
    "between_entity_association",
    f"""WITH {DAILY_SQL}, sc AS (SELECT stem, identity, avg(signal) AS va, avg(activity) AS vb FROM obs GROUP BY 1,2), r AS (SELECT *, {_rank('stem', 'va')} AS ra, {_rank('stem', 'vb')} AS rb FROM sc), s AS (SELECT stem, count(*) AS n, {_OKC.format(a='va', b='vb')} AS p, {_OKC.format(a='ra', b='rb')} AS s FROM r GROUP BY 1)
 SELECT stem, n, CASE WHEN n>=4 THEN p END AS pearson, CASE WHEN n>=4 THEN s END AS spearman, CASE WHEN n<4 THEN 'insufficient' WHEN p IS NULL THEN 'constant' ELSE 'estimated' END AS status FROM s""",
    "pearson spearman",
    digits=4,
)
def _(i):
    scalars = i.daily().groupBy("stem", "identity").agg(F.avg("signal").alias("va"), F.avg("activity").alias("vb"))
    return S.association(scalars, ["stem"], "va", "vb", 4)


_SIGNS = """e AS (SELECT c.segment, c.nation, avg(value)-4500 AS v, avg(value)-4500-2*stddev_samp(value)/sqrt(count(*)) AS lo, avg(value)-4500+2*stddev_samp(value)/sqrt(count(*)) AS hi FROM cu c GROUP BY 1,2)"""


@query(
    "direction_counts",
    f"""WITH {CU}, {_SIGNS}, s AS (SELECT segment, count(*) FILTER (WHERE v>0) AS positive, count(*) FILTER (WHERE v<0) AS negative, count(*) FILTER (WHERE v=0) AS zero, count(*) AS estimates, max(lo) AS l, min(hi) AS h FROM e GROUP BY 1)
 SELECT segment, positive, negative, zero, estimates, CASE WHEN positive=estimates THEN 'positive' WHEN negative=estimates THEN 'negative' WHEN zero=estimates THEN 'zero' ELSE 'mixed' END AS direction,
 CASE WHEN (positive=estimates OR negative=estimates) AND l<=h THEN l END AS shared_low, CASE WHEN (positive=estimates OR negative=estimates) AND l<=h THEN h END AS shared_high FROM s""",
    "shared_low shared_high",
)
def _(i):
    half = 2 * F.stddev_samp("value") / F.sqrt(F.count(F.lit(1)))
    est = customers(i).groupBy("segment", "nation").agg((F.avg("value") - 4500).alias("v"), (F.avg("value") - 4500 - half).alias("lo"), (F.avg("value") - 4500 + half).alias("hi"))
    return S.direction_counts(est, ["segment"], "v", "lo", "hi")


_CP = f"""{CONTACTS}, lv AS (SELECT stem, identity, avg(raw) AS m FROM mk GROUP BY 1,2), cpr AS (SELECT stem, identity_a, identity_b, max(CASE WHEN dilation_px=1 AND boundary_a_px>=4 THEN 1 ELSE 0 END) AS c FROM ctc GROUP BY 1,2,3),
 dp AS (SELECT p.stem, identity_a, identity_b, c, abs(a.m-b.m) AS d FROM cpr p JOIN lv a ON a.stem=p.stem AND a.identity=identity_a JOIN lv b ON b.stem=p.stem AND b.identity=identity_b)"""


@query(
    "contact_similarity",
    f"""WITH {PIXELS_SQL}, {_CP}, o AS (SELECT stem, count(*) FILTER (WHERE c=1) AS n_a, avg(d) FILTER (WHERE c=1)-avg(d) FILTER (WHERE c=0) AS observed FROM dp GROUP BY 1), r AS (SELECT *, concat_ws('-',identity_a,identity_b) AS id, unnest(range(1,20)) AS replicate FROM dp),
 p AS (SELECT *, row_number() OVER (PARTITION BY stem, replicate ORDER BY md5(concat_ws('|','17',replicate,stem,id)), id) AS pos FROM r), z AS (SELECT stem, replicate, avg(d) FILTER (WHERE pos<=n_a)-avg(d) FILTER (WHERE pos>n_a) AS d, any_value(observed) AS observed FROM p JOIN o USING (stem) GROUP BY 1,2)
 SELECT stem, max(observed) AS observed, avg(d) AS null_mean, count(*) AS replicates, (1+count(*) FILTER (WHERE round(abs(d),9)>=round(abs(observed),9)))/(count(*)+1) AS p_value FROM z WHERE d IS NOT NULL AND observed IS NOT NULL GROUP BY 1""",
    "observed null_mean p_value",
)
def _(i):
    m = i.kept("masks", i.masks)
    touching = X.contacts(m, [1, 2]).groupBy("stem", "identity_a", "identity_b").agg(
        (F.max(((F.col("dilation_px") == 1) & (F.coalesce(F.col("boundary_a_px"), F.lit(0)) >= 4)).cast("int")) == 1).alias("contact")
    )
    level = m.groupBy("stem", "identity").agg(F.avg("raw").alias("m"))
    rows = touching
    for s in ("a", "b"):
        rows = rows.join(level.select("stem", F.col("identity").alias(f"identity_{s}"), F.col("m").alias(f"m{s}")), ["stem", f"identity_{s}"])
    return S.contact_similarity(rows.withColumn("d", F.abs(F.col("ma") - F.col("mb"))), "contact", "d", 19, 17)


# --- windows around an anchor ------------------------------------------------------------------------------

_AW = f"""wd AS (SELECT * FROM (VALUES ('before',-120.0,0.0),('early',0.0,120.0),('late',240.0,420.0)) v(w,a,b)), en AS (SELECT s.stem, s.identity, w AS "window", 360+a AS w0, 360+b AS w1, unnest(['signal','activity']) AS metric FROM (SELECT DISTINCT stem, identity FROM tr) s, wd),
 lo AS (SELECT stem, identity, hours, unnest(['signal','activity']) AS metric, unnest([signal, activity]) AS value FROM tr), ins AS (SELECT lo.*, w AS "window", hours-lag(hours) OVER (PARTITION BY stem, identity, metric, w ORDER BY hours) AS g FROM lo JOIN wd ON hours>=360+a AND hours<360+b),
 stt AS (SELECT stem, identity, "window", metric, count(value) AS observations, avg(value) AS mean, min(value) AS minimum, max(value) AS maximum, quantile_cont(value,0.5) AS median, min(hours) AS first_hour, max(hours) AS last_hour, coalesce(sum(g) FILTER (WHERE g<=9),0) AS cov FROM ins GROUP BY 1,2,3,4),
 aw AS (SELECT en.stem, en.identity, en."window", en.metric, coalesce(observations,0) AS observations, mean, minimum, maximum, first_hour, last_hour, median, coalesce(observations,0)/greatest(round((w1-w0)/6),1.0) AS valid_fraction, coalesce(cov,0)/(w1-w0) AS interval_coverage,
 greatest(least(w1,720.0)-greatest(w0,0.0),0.0)/(w1-w0) AS recording_coverage, (w0<0 OR w1>720) AS truncated, first_hour-360 AS first_from_anchor, last_hour-360 AS last_from_anchor FROM en LEFT JOIN stt USING (stem, identity, "window", metric)),
 ass AS (SELECT *, concat_ws('; ', CASE WHEN observations<5 THEN 'too few observations' END, CASE WHEN valid_fraction<0.3 THEN 'too little valid' END, CASE WHEN interval_coverage<0.2 THEN 'too little covered' END, CASE WHEN truncated THEN 'truncated by the recording' END) AS reasons FROM aw)"""
_AWD = "mean minimum maximum first_hour last_hour median valid_fraction interval_coverage recording_coverage first_from_anchor last_from_anchor"


def assessed(i):
    w = S.anchored_windows(i.traces(), ["signal", "activity"], 360.0, [("before", -120.0, 0.0), ("early", 0.0, 120.0), ("late", 240.0, 420.0)], 6.0, 0.0, 720.0)
    return S.assess_windows(w, 5, 0.3, 0.2)


@query("anchored_windows", f"WITH {TRACES_SQL}, {_AW} SELECT *, reasons='' AS eligible FROM ass", _AWD)
def _(i):
    return assessed(i)


_WC = """wc AS (SELECT a.stem, a.identity, a.metric, a."window", a.mean, b.mean AS baseline, a.mean-b.mean AS change, CASE WHEN b.mean IS NULL THEN 'missing_baseline' WHEN abs(b.mean)<1e-6 THEN 'near_zero_baseline' WHEN b.mean<=0 THEN 'nonpositive_baseline' END AS relative_refused,
 a.reasons='' AND b.reasons='' AS ok FROM ass a JOIN ass b ON a.stem=b.stem AND a.identity=b.identity AND a.metric=b.metric AND b."window"='before' WHERE a."window"<>'before'),
 wo AS (SELECT * EXCLUDE (ok), CASE WHEN relative_refused IS NULL THEN change/baseline END AS relative_change, CASE WHEN NOT (ok AND relative_refused IS NULL AND change IS NOT NULL) THEN 'inconclusive' WHEN change/baseline>=0.1 THEN 'increase' WHEN change/baseline<=-0.1 THEN 'decrease' WHEN change<>0 THEN 'below_threshold' ELSE 'no_change' END AS outcome FROM wc)"""


@query("within_entity_changes", f"WITH {TRACES_SQL}, {_AW}, {_WC} SELECT * FROM wo", "mean baseline change relative_change")
def _(i):
    return S.within_changes(assessed(i), "before", 1e-6, 0.1)


_SIZES, _ALPHA = {"signal": 10.0, "activity": 0.3}, 0.4
_EK = 'stem, identity, metric, "window"'
_EV = f"""ei AS (SELECT i.stem, i.identity, i.metric, t.w AS "window", i.value, i."window"<>'before' AS target FROM ins i JOIN (VALUES ('early'),('late')) t(w) ON i."window"=t.w OR i."window"='before' WHERE i.value IS NOT NULL),
 er AS (SELECT *, {_rank(_EK, 'value')} AS rk FROM ei), et AS (SELECT {_EK}, sum(k**3-k) AS t3, sum(k) AS n FROM (SELECT {_EK}, value, CAST(count(*) AS DOUBLE) AS k FROM ei GROUP BY ALL) GROUP BY ALL),
 es AS (SELECT {_EK}, sum(rk) FILTER (WHERE target) AS ra, count(*) FILTER (WHERE target) AS na, count(*) FILTER (WHERE NOT target) AS nb, avg(value) FILTER (WHERE target)-avg(value) FILTER (WHERE NOT target) AS est, var_samp(value) FILTER (WHERE target) AS va, var_samp(value) FILTER (WHERE NOT target) AS vb FROM er GROUP BY ALL),
 eu AS (SELECT es.*, ra-na*(na+1)/2.0 AS u, na*nb/12.0*((n+1)-t3/nullif(n*(n-1),0)) AS s2 FROM es JOIN et USING ({_EK})), ez AS (SELECT *, CASE WHEN na>0 AND nb>0 AND s2>0 THEN greatest(abs(u-na*nb/2.0)-0.5,0)/sqrt(s2) END AS z FROM eu),
 eq AS (SELECT a.stem, a.identity, a.metric, a."window", a.reasons='' AND b.reasons='' AS eligible FROM ass a JOIN ass b ON a.stem=b.stem AND a.identity=b.identity AND a.metric=b.metric AND b."window"='before' WHERE a."window"<>'before'),
 ep AS (SELECT eq.*, coalesce(nb,0) AS baseline_observations, coalesce(na,0) AS target_observations, CASE WHEN eligible THEN est END AS estimate, CASE WHEN eligible THEN est END-1.959963984540054*sqrt(va/na+vb/nb) AS interval_low, CASE WHEN eligible THEN est END+1.959963984540054*sqrt(va/na+vb/nb) AS interval_high,
  CASE WHEN eligible THEN 2.0*u/(na*nb)-1 END AS effect, CASE WHEN eligible AND z IS NOT NULL THEN {_P2.format(z='z')} END AS p_value FROM eq LEFT JOIN ez USING ({_EK})),
 ec AS (SELECT *, count(*) OVER (PARTITION BY metric) AS family_requested, coalesce(p_value,1.0)*count(*) OVER (PARTITION BY metric)/count(*) OVER (PARTITION BY metric ORDER BY coalesce(p_value,1.0)) AS raw FROM ep),
 ed AS (SELECT * EXCLUDE (raw), CASE WHEN p_value IS NOT NULL THEN least(min(raw) OVER (PARTITION BY metric ORDER BY coalesce(p_value,1.0) DESC),1.0) END AS q_value, CASE metric WHEN 'signal' THEN 10.0 ELSE 0.3 END AS meaningful_size FROM ec),
 ef AS (SELECT *, CASE WHEN q_value<={_ALPHA} AND abs(estimate)>=meaningful_size AND estimate<>0 THEN CASE WHEN estimate>0 THEN 'increase' ELSE 'decrease' END WHEN q_value<={_ALPHA} THEN 'detected_below_meaningful_threshold' WHEN p_value IS NOT NULL THEN 'no_detected_change' ELSE 'inconclusive' END AS outcome FROM ed)"""


def _evidence(i):
    windows = [("before", -120.0, 0.0), ("early", 0.0, 120.0), ("late", 240.0, 420.0)]
    return S.change_evidence(i.traces(), assessed(i), _SIZES, 360.0, windows, "before", _ALPHA)


@query("change_evidence", f"WITH {TRACES_SQL}, {_AW}, {_EV} SELECT * FROM ef", "estimate interval_low interval_high effect p_value q_value meaningful_size")
def _(i):
    return _evidence(i)


@query(
    "evidence_decisions",
    f"""WITH {TRACES_SQL}, {_AW}, {_EV} SELECT stem, identity, count(*) AS requested_comparisons, count(p_value) AS tested_comparisons, count(*) FILTER (WHERE outcome IN ('increase','decrease')) AS responding_comparisons,
 CASE WHEN count(*) FILTER (WHERE outcome IN ('increase','decrease'))>0 THEN 'responding' WHEN count(p_value)>0 THEN 'no_detected_response' ELSE 'inconclusive' END AS decision FROM ef GROUP BY 1,2""",
)
def _(i):
    return S.evidence_decision(_evidence(i))


@query(
    "entity_decisions",
    f"""WITH {TRACES_SQL}, {_AW}, {_WC} SELECT stem, identity, CASE WHEN bool_or(outcome='increase') AND bool_or(outcome='decrease') THEN 'mixed' WHEN bool_or(outcome='increase') THEN 'increase' WHEN bool_or(outcome='decrease') THEN 'decrease' WHEN bool_or(outcome IN ('below_threshold','no_change')) THEN 'no_detected_change' ELSE 'inconclusive' END AS decision, count(*) AS tests FROM wo GROUP BY 1,2""",
)
def _(i):
    return S.entity_decision(S.within_changes(assessed(i), "before", 1e-6, 0.1))


@query(
    "change_pattern_counts",
    f"""WITH {TRACES_SQL}, {_AW}, {_WC}, p AS (SELECT stem, identity, "window", max(outcome) FILTER (WHERE metric='signal') AS s, max(outcome) FILTER (WHERE metric='activity') AS a FROM wo GROUP BY 1,2,3),
 c AS (SELECT stem, "window", CASE WHEN 'inconclusive' IN (s,a) THEN 'inconclusive' WHEN s IN ('increase','decrease') AND a IN ('increase','decrease') THEN CASE WHEN s=a THEN 'same_direction' ELSE 'opposite_direction' END WHEN s IN ('increase','decrease') THEN 'signal_only' WHEN a IN ('increase','decrease') THEN 'activity_only' ELSE 'neither' END AS pattern FROM p)
 SELECT stem, "window", pattern, count(*) AS entities FROM c GROUP BY 1,2,3""",
)
def _(i):
    o = S.within_changes(assessed(i), "before", 1e-6, 0.1)
    pick = lambda m: F.max(F.when(F.col("metric") == m, F.col("outcome"))).alias(m)
    p = o.groupBy("stem", "identity", "window").agg(pick("signal"), pick("activity"))
    moved = lambda c: F.col(c).isin("increase", "decrease")
    pattern = (
        F.when((F.col("signal") == "inconclusive") | (F.col("activity") == "inconclusive"), "inconclusive")
        .when(moved("signal") & moved("activity"), F.when(F.col("signal") == F.col("activity"), "same_direction").otherwise("opposite_direction"))
        .when(moved("signal"), "signal_only").when(moved("activity"), "activity_only").otherwise("neither")
    )
    return p.groupBy("stem", "window", pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("entities"))


@query(
    "characteristic_distance_relation",
    f"""WITH {TRACKS_SQL}, {MED}, c AS (SELECT stem, identity, avg(area_px) AS c FROM tk GROUP BY 1,2), p AS (SELECT a.stem, abs(a.c-b.c) AS d, sqrt((ma.y-mb.y)**2+(ma.x-mb.x)**2) AS g FROM c a JOIN c b ON a.stem=b.stem AND a.identity<b.identity JOIN md ma ON ma.stem=a.stem AND ma.identity=a.identity JOIN md mb ON mb.stem=b.stem AND mb.identity=b.identity),
 r AS (SELECT stem, {_rank('stem', 'round(d,9)')} AS rd, {_rank('stem', 'round(g,9)')} AS rg FROM p) SELECT stem, count(*) AS pairs, {_OKC.format(a='rd', b='rg')} AS spearman FROM r GROUP BY 1""",
    "spearman",
    digits=7,
)
def _(i):
    tk = i.tracks()
    level = tk.groupBy("stem", "identity").agg(F.avg("area_px").alias("c"))
    pairs = Q.with_distance(Q.recording_pairs(level), Q.median_positions(tk))
    for s in ("a", "b"):
        pairs = pairs.join(level.select("stem", F.col("identity").alias(f"identity_{s}"), F.col("c").alias(f"c{s}")), ["stem", f"identity_{s}"])
    rows = pairs.select("stem", F.round(F.abs(F.col("ca") - F.col("cb")), 9).alias("d"), F.round("distance", 9).alias("g"))
    return S.association(rows, ["stem"], "d", "g", 3).select("stem", F.col("n").alias("pairs"), "spearman")


@query(
    "state_phi",
    f"""WITH {DAILY_SQL}, p AS (SELECT a.identity, CAST(a.signal>40 AS INTEGER) AS va, CAST(b.signal>40 AS INTEGER) AS vb FROM obs a JOIN obs b ON a.identity=b.identity AND a.frame_index=b.frame_index WHERE a.stem='view' AND b.stem='click')
 SELECT identity, count(*) AS n, CASE WHEN count(*)>=4 AND stddev_pop(va)>0 AND stddev_pop(vb)>0 THEN corr(va,vb) END AS phi FROM p GROUP BY 1""",
    "phi",
)
def _(i):
    from lapsegrid.functions.numeric import safe_corr

    obs = i.daily()
    side = lambda s, n: by_stem(i, s, obs).select("identity", "frame_index", (F.col("signal") > 40).cast("double").alias(n))
    both = side("view", "va").join(side("click", "vb"), ["identity", "frame_index"])
    return both.groupBy("identity").agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= 4, safe_corr("va", "vb")).alias("phi"))


# --- ledgers ---------------------------------------------------------------------------------------------


@query(
    "paired_unit_ledger",
    f"""WITH {CU}, a AS (SELECT nation, avg(value) AS a FROM cu WHERE segment='HOUSEHOLD' AND value>0 GROUP BY 1), b AS (SELECT nation, avg(value) AS b FROM cu WHERE segment='MACHINERY' AND value>9000 GROUP BY 1)
 SELECT coalesce(a.nation,b.nation) AS nation, a, b, b-a AS difference, CASE WHEN a IS NULL THEN 'second_only' WHEN b IS NULL THEN 'first_only' ELSE 'paired' END AS support FROM a FULL JOIN b ON a.nation=b.nation""",
    "a b difference",
    digits=6,
)
def _(i):
    cu = customers(i)
    a = cu.where((F.col("segment") == "HOUSEHOLD") & (F.col("value") > 0)).groupBy("nation").agg(F.avg("value").alias("a"))
    b = cu.where((F.col("segment") == "MACHINERY") & (F.col("value") > 9000)).groupBy("nation").agg(F.avg("value").alias("b"))
    support = F.when(F.col("a").isNull(), "second_only").when(F.col("b").isNull(), "first_only").otherwise("paired")
    return a.join(b, "nation", "full_outer").withColumn("difference", F.col("b") - F.col("a")).withColumn("support", support)


@query(
    "group_description",
    f"""WITH {CU} SELECT segment, count(*) AS "rows", count(value) FILTER (WHERE value>0) AS positive, count(DISTINCT nation) AS nations, avg(value) FILTER (WHERE region='ASIA') AS asia, avg(value) FILTER (WHERE region<>'ASIA') AS elsewhere,
 avg(value) FILTER (WHERE region='ASIA')-avg(value) FILTER (WHERE region<>'ASIA') AS difference FROM cu GROUP BY 1""",
    "asia elsewhere difference",
    digits=6,
)
def _(i):
    asia = F.col("region") == "ASIA"
    return customers(i).groupBy("segment").agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("value") > 0, F.lit(1))).alias("positive"), F.count_distinct("nation").alias("nations"),
        F.avg(F.when(asia, F.col("value"))).alias("asia"), F.avg(F.when(~asia, F.col("value"))).alias("elsewhere"),
    ).withColumn("difference", F.col("asia") - F.col("elsewhere"))


for _name, _expr in (("mean_of_ratios", "avg(d/n)"), ("ratio_of_sums", "sum(d)/sum(n)")):
    query(
        f"sample_{_name}",
        f"""WITH {DAILY_SQL}, c AS (SELECT stem, identity, CAST(sum(CASE WHEN signal>40 THEN 1 ELSE 0 END) AS DOUBLE) AS d, CAST(count(*) AS DOUBLE) AS n FROM obs GROUP BY 1,2) SELECT stem, {_expr} AS value, count(*) AS members FROM c GROUP BY 1""",
        "value",
    )(
        lambda i, how=_name: i.daily().groupBy("stem", "identity").agg(
            F.sum((F.col("signal") > 40).cast("int")).cast("double").alias("d"), F.count(F.lit(1)).cast("double").alias("n")
        ).groupBy("stem").agg(
            (F.avg(F.col("d") / F.col("n")) if how == "mean_of_ratios" else ratio(F.sum("d"), F.sum("n"))).alias("value"), F.count(F.lit(1)).alias("members")
        )
    )


@query(
    "scalar_inventory",
    f"""WITH {DAILY_SQL}, inv AS (SELECT DISTINCT c_custkey AS identity, unnest(['view','click']) AS measurement FROM customer), s AS (SELECT identity, stem AS measurement, avg(signal) AS value, count(*) AS n FROM obs GROUP BY 1,2)
 SELECT inv.identity, inv.measurement, value, CASE WHEN n IS NULL THEN 'unavailable' WHEN n<5 THEN 'insufficient' ELSE 'available' END AS status FROM inv LEFT JOIN s USING (identity, measurement)""",
    "value",
)
def _(i):
    inv = i.table("customer").select(F.col("c_custkey").alias("identity")).distinct().withColumn("measurement", F.explode(F.array(F.lit("view"), F.lit("click"))))
    s = i.daily().groupBy("identity", F.col("stem").alias("measurement")).agg(F.avg("signal").alias("value"), F.count(F.lit(1)).alias("n"))
    status = F.when(F.col("n").isNull(), "unavailable").when(F.col("n") < 5, "insufficient").otherwise("available")
    return inv.join(s, ["identity", "measurement"], "left").withColumn("status", status).drop("n")


@query(
    "stability_by_two_groupings",
    f"""WITH {CU} SELECT segment, region, count(*) AS pairs, avg(value) AS stability, CASE WHEN region IS NULL THEN 'segment' WHEN segment IS NULL THEN 'region' END AS level FROM cu GROUP BY GROUPING SETS ((segment),(region))""",
    "stability",
    digits=6,
)
def _(i):
    g = customers(i).groupingSets([[F.col("segment")], [F.col("region")]], F.col("segment"), F.col("region"))
    return g.agg(F.count(F.lit(1)).alias("pairs"), F.avg("value").alias("stability")).withColumn(
        "level", F.when(F.col("region").isNull(), "segment").when(F.col("segment").isNull(), "region")
    )
