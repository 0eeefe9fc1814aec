"""Neighbours, pairs, lags, recurrence, trends and sequences."""

from pyspark.sql import functions as F

from lapsegrid.functions.numeric import rank_p_value_sql
from lapsegrid.operators import joins as J
from lapsegrid.operators import pairs as Q
from lapsegrid.operators import regimes as G
from lapsegrid.sources.canonical import DAILY_SQL, EVENTS_SQL, TRACES_SQL, TRACKS_SQL, clock_of, clock_sql
from lapsegrid.workload.registry import query
from lapsegrid.workload.w04_joins import HOUR, by_stem
from lapsegrid.workload.w05_regimes import BASE, MOVES, classed

TK = f"WITH {TRACKS_SQL}"
NBR = """pd AS (SELECT a.stem, a.frame_index, a.identity, b.identity AS o, sqrt((a.y-b.y)**2+(a.x-b.x)**2) AS d FROM tk a JOIN tk b ON a.stem=b.stem AND a.frame_index=b.frame_index AND a.identity<>b.identity),
 rk AS (SELECT *, row_number() OVER (PARTITION BY stem, frame_index, identity ORDER BY round(d,9), o) AS r FROM pd),
 nb AS (SELECT stem, frame_index, identity, min(d) AS nearest_px, first(o ORDER BY r) AS nearest_identity, avg(d) FILTER (WHERE r<=3) AS mean_k_px, count(*) FILTER (WHERE round(d,9)<=4.0) AS within_radius FROM rk GROUP BY 1,2,3)"""


def neighbours(i):
    return Q.frame_neighbours(i.tracks(), 3, 4.0, 4.0)


@query("frame_neighbours", f"{TK}, {NBR} SELECT * FROM nb", "nearest_px mean_k_px")
def _(i):
    return neighbours(i)


@query(
    "clustering_index",
    f"{TK}, {NBR}, m AS (SELECT stem, frame_index, avg(nearest_px) AS observed_px, count(nearest_px) AS entities FROM nb GROUP BY 1,2) SELECT *, 0.5/sqrt(entities/300.0) AS expected_px, observed_px/(0.5/sqrt(entities/300.0)) AS index FROM m",
    "observed_px expected_px index",
)
def _(i):
    return Q.clustering_index(neighbours(i), 300)


@query(
    "local_density",
    f"""{TK}, {NBR}, cen AS (SELECT stem, identity, frame_index, CAST(floor(y+0.5) AS INTEGER) AS y, CAST(floor(x+0.5) AS INTEGER) AS x FROM tk),
 g AS (SELECT cen.stem, cen.identity, cen.frame_index, count(*) AS ground_px FROM cen JOIN mk m ON m.stem=cen.stem AND m.frame_index=cen.frame_index AND (m.y-cen.y)**2+(m.x-cen.x)**2<=16 GROUP BY 1,2,3)
 SELECT nb.stem, nb.frame_index, nb.identity, within_radius, coalesce(ground_px,0) AS ground_px, 1000.0*within_radius/nullif(ground_px,0) AS local_density FROM nb LEFT JOIN g USING (stem, identity, frame_index)""",
    "local_density",
)
def _(i):
    from lapsegrid.functions.numeric import ratio
    from lapsegrid.operators import pixels as X

    cover = X.ground_cover(i.tracks(), i.masks(), 4.0, 15, 20).select("stem", "identity", "frame_index", "ground_px")
    joined = neighbours(i).join(cover, ["stem", "identity", "frame_index"], "left")
    return joined.select("stem", "frame_index", "identity", "within_radius", F.coalesce("ground_px", F.lit(0)).alias("ground_px"), (1000.0 * ratio("within_radius", "ground_px")).alias("local_density"))


@query(
    "closest_approach",
    f"{TK}, {NBR} SELECT stem, identity, count(nearest_px) AS measured_frames, CASE WHEN count(nearest_px)=max(n_frames) THEN min(nearest_px) END AS closest_px FROM nb JOIN {clock_sql('tk')} USING (stem) GROUP BY 1,2",
    "closest_px",
)
def _(i):
    return Q.closest_approach(neighbours(i), clock_of(i.tracks()))


PAIRCORR = """pcr AS (SELECT a.stem, a.identity AS identity_a, b.identity AS identity_b, count(*) AS overlap_frames, CASE WHEN count(*)>=8 AND stddev_pop(a.{v})>1e-6 AND stddev_pop(b.{v})>1e-6 THEN corr(a.{v}, b.{v}) END AS correlation
 FROM {t} a JOIN {t} b ON a.stem=b.stem AND a.frame_index=b.frame_index AND a.identity<b.identity GROUP BY 1,2,3)"""


@query("pair_correlations", f"WITH {DAILY_SQL}, {PAIRCORR.format(v='signal', t='obs')} SELECT * FROM pcr", "correlation", digits=6)
def _(i):
    return Q.pair_correlations(i.daily(), "signal", 8)


MED = "md AS (SELECT stem, identity, quantile_cont(y,0.5) AS y, quantile_cont(x,0.5) AS x FROM tk GROUP BY 1,2)"


@query("median_positions", f"{TK}, {MED} SELECT * FROM md", "y x")
def _(i):
    return Q.median_positions(i.tracks())


@query(
    "coupling",
    f"{TK}, {MED}, {PAIRCORR.format(v='mean_raw', t='tk')} SELECT p.*, sqrt((a.y-b.y)**2+(a.x-b.x)**2) AS distance FROM pcr p JOIN md a ON a.stem=p.stem AND a.identity=identity_a JOIN md b ON b.stem=p.stem AND b.identity=identity_b",
    "correlation distance",
    digits=6,
)
def _(i):
    tk = i.tracks()
    return Q.with_distance(Q.pair_correlations(tk, "mean_raw", 8), Q.median_positions(tk))


_GRAPH = """gr AS (SELECT DISTINCT stem, least(identity,o) AS identity_a, greatest(identity,o) AS identity_b FROM (SELECT a.stem, a.identity, b.identity AS o, row_number() OVER (PARTITION BY a.stem, a.identity ORDER BY round(sqrt((a.y-b.y)**2+(a.x-b.x)**2),9), b.identity) AS r
 FROM md a JOIN md b ON a.stem=b.stem AND a.identity<>b.identity) WHERE r<=2)"""


@query("neighbour_graph", f"{TK}, {MED}, {_GRAPH} SELECT * FROM gr")
def _(i):
    return Q.neighbour_graph(Q.median_positions(i.tracks()), 2, 2.0)


@query(
    "coordination_contrast",
    f"""{TK}, {MED}, {_GRAPH}, {PAIRCORR.format(v='mean_raw', t='tk')}, v AS (SELECT * FROM pcr WHERE correlation IS NOT NULL), st AS (SELECT stem, identity, CAST(least(floor(count(*)/CAST(max(n_frames) AS DOUBLE)*4),3) AS INTEGER) AS stratum FROM tk JOIN {clock_sql('tk')} USING (stem) GROUP BY 1,2),
 rp AS (SELECT *, unnest(range(20)) AS replicate FROM st), pl AS (SELECT *, row_number() OVER (PARTITION BY stem, stratum, replicate ORDER BY identity) AS p FROM rp),
 dr AS (SELECT *, row_number() OVER (PARTITION BY stem, stratum, replicate ORDER BY md5(concat_ws('|','11',replicate,stem,identity)), identity) AS p FROM rp),
 mp AS (SELECT pl.stem, pl.replicate, pl.identity, CASE WHEN pl.replicate=0 THEN pl.identity ELSE dr.identity END AS image FROM pl JOIN dr USING (stem, stratum, replicate, p)),
 ed AS (SELECT gr.stem, a.replicate, least(a.image,b.image) AS identity_a, greatest(a.image,b.image) AS identity_b FROM gr JOIN mp a ON a.stem=gr.stem AND a.identity=gr.identity_a JOIN mp b ON b.stem=gr.stem AND b.identity=gr.identity_b AND a.replicate=b.replicate),
 tt AS (SELECT stem, sum(correlation) AS t, count(*) AS n FROM v GROUP BY 1), nr AS (SELECT ed.stem, replicate, sum(correlation) AS s, count(*) AS n FROM ed JOIN v USING (stem, identity_a, identity_b) GROUP BY 1,2),
 sc AS (SELECT nr.stem, replicate, nr.n, s/nr.n-(t-s)/nullif(tt.n-nr.n,0) AS c FROM nr JOIN tt USING (stem)), ob AS (SELECT stem, c AS estimate, n AS neighbour_pairs FROM sc WHERE replicate=0)
 SELECT stem, max(estimate) AS estimate, max(neighbour_pairs) AS neighbour_pairs, count(*) AS replicates, avg(c) AS null_mean, (1+count(*) FILTER (WHERE round(abs(c),12)>=round(abs(estimate),12)))/(count(*)+1) AS p_value FROM sc JOIN ob USING (stem) WHERE replicate>0 AND c IS NOT NULL GROUP BY 1""",
    "estimate null_mean p_value",
    digits=6,
)
def _(i):
    tk = i.tracks()
    coverage = tk.join(clock_of(tk), "stem").groupBy("stem", "identity").agg((F.count(F.lit(1)) / F.max("n_frames").cast("double")).alias("coverage"))
    graph = Q.neighbour_graph(Q.median_positions(tk), 2, 2.0)
    return Q.coordination_contrast(Q.pair_correlations(tk, "mean_raw", 8), graph, coverage, 19, 11)


# --- lags ----------------------------------------------------------------------------------------------

_CORR = "CASE WHEN stddev_pop({a})>1e-9*max(abs({a})) AND stddev_pop({b})>1e-9*max(abs({b})) THEN corr({a},{b}) END"
LAGP = f"""lp AS (SELECT a.stem, a.identity, b.frame_index-a.frame_index AS lag_frames, {_CORR.format(a='a.signal', b='b.activity')} AS correlation, count(*) AS pairs
 FROM tr a JOIN tr b ON a.stem=b.stem AND a.identity=b.identity AND b.frame_index-a.frame_index BETWEEN -4 AND 4 GROUP BY 1,2,3 HAVING count(*)>=5)"""


@query("lag_profile", f"WITH {TRACES_SQL}, {LAGP} SELECT * FROM lp", "correlation", digits=7)
def _(i):
    return Q.lag_profile(i.traces(), "signal", "activity", 4, 5)


@query(
    "lag_profile_null_band",
    f"""WITH {TRACES_SQL}, {LAGP}, rp AS (SELECT stem, identity, frame_index, activity, unnest(range(1,10)) AS replicate FROM tr),
 pl AS (SELECT stem, identity, replicate, frame_index, row_number() OVER (PARTITION BY stem, identity, replicate ORDER BY frame_index) AS p FROM rp),
 dl AS (SELECT stem, identity, replicate, activity, row_number() OVER (PARTITION BY stem, identity, replicate ORDER BY md5(concat_ws('|','5',replicate,stem,identity,frame_index)), frame_index) AS p FROM rp),
 sh AS (SELECT pl.stem, pl.identity, replicate, pl.frame_index, dl.activity FROM pl JOIN dl USING (stem, identity, replicate, p)),
 nl AS (SELECT a.stem, a.identity, replicate, b.frame_index-a.frame_index AS lag_frames, {_CORR.format(a='a.signal', b='b.activity')} AS c FROM tr a JOIN sh b ON a.stem=b.stem AND a.identity=b.identity AND b.frame_index-a.frame_index BETWEEN -4 AND 4 GROUP BY 1,2,3,4 HAVING count(*)>=5)
 SELECT lp.*, surrogate_mean, surrogate_lo, surrogate_hi FROM lp LEFT JOIN (SELECT stem, identity, lag_frames, avg(c) AS surrogate_mean, quantile_cont(c,0.025) AS surrogate_lo, quantile_cont(c,0.975) AS surrogate_hi FROM nl WHERE c IS NOT NULL GROUP BY 1,2,3) USING (stem, identity, lag_frames)""",
    "correlation surrogate_mean surrogate_lo surrogate_hi",
    digits=6,
)
def _(i):
    return Q.lag_null_band(i.traces(), "signal", "activity", 4, 5, 9, 5)


@query(
    "population_lag_profile",
    f"WITH {TRACES_SQL}, {LAGP} SELECT stem, lag_frames, avg(correlation) AS mean, count(correlation) AS entities, quantile_cont(correlation,0.25) AS q25, quantile_cont(correlation,0.75) AS q75 FROM lp WHERE correlation IS NOT NULL GROUP BY 1,2",
    "mean q25 q75",
    digits=7,
)
def _(i):
    return Q.population_lags(Q.lag_profile(i.traces(), "signal", "activity", 4, 5))


@query(
    "peak_lag",
    f"WITH {TRACES_SQL}, {LAGP} SELECT stem, identity, first(lag_frames ORDER BY round(abs(correlation),9) DESC, lag_frames) AS peak_lag, first(correlation ORDER BY round(abs(correlation),9) DESC, lag_frames) AS peak_correlation FROM lp WHERE correlation IS NOT NULL GROUP BY 1,2",
    "peak_correlation",
    digits=7,
)
def _(i):
    return Q.peak_lag(Q.lag_profile(i.traces(), "signal", "activity", 4, 5))


_LAGS = (-48, -24, 0, 24, 48)


@query(
    "cross_entity_lag_profile",
    f"""WITH {EVENTS_SQL}, lg AS (SELECT unnest([{', '.join(str(v * HOUR) for v in _LAGS)}]) AS lag), a AS (SELECT identity, micros AS r, cents AS va, lag FROM ev, lg WHERE stem='view'), b AS (SELECT identity, micros AS t, cents AS vb FROM ev WHERE stem='click'),
 c AS (SELECT a.*, t, vb, abs(t-(r+lag)) AS d FROM a JOIN b USING (identity) WHERE abs(t-(r+lag)) <= {36 * HOUR}), m AS (SELECT identity, lag, r, min(d) AS d FROM c GROUP BY 1,2,3),
 k AS (SELECT c.identity, c.lag, c.r, any_value(va) AS va, any_value(t) AS t, any_value(vb) AS vb, count(*) AS n FROM c JOIN m USING (identity, lag, r, d) GROUP BY 1,2,3), w AS (SELECT identity, lag, t, count(*) AS wanted FROM k WHERE n=1 GROUP BY 1,2,3)
 SELECT identity, CAST(lag/{HOUR} AS INTEGER) AS lag_hours, count(*) AS n, CASE WHEN count(*)>=5 AND stddev_pop(va)>0 AND stddev_pop(vb)>0 THEN corr(va,vb) END AS correlation FROM k JOIN w USING (identity, lag, t) WHERE n=1 AND wanted=1 GROUP BY 1,2""",
    "correlation",
    digits=7,
)
def _(i):
    from lapsegrid.functions.numeric import safe_corr

    ev = i.events().select("stem", "identity", "micros", "cents")
    left, right = by_stem(i, "view", ev), by_stem(i, "click", ev)
    out = None
    for lag in _LAGS:
        m = J.nearest_unique(left, right, ["identity"], "micros", lag * HOUR, 36 * HOUR, 4096 * HOUR).where(F.col("match_status") == "matched")
        part = m.withColumn("lag_hours", F.lit(lag))
        out = part if out is None else out.unionByName(part)
    values = out.join(left.select("identity", F.col("micros").alias("reference_at"), F.col("cents").alias("va")), ["identity", "reference_at"]).join(
        right.select("identity", F.col("micros").alias("target_at"), F.col("cents").alias("vb")), ["identity", "target_at"]
    )
    return values.groupBy("identity", "lag_hours").agg(
        F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= 5, safe_corr(F.col("va").cast("double"), F.col("vb").cast("double"))).alias("correlation")
    )


@query(
    "frame_aligned_pairs",
    f"WITH {DAILY_SQL} SELECT a.identity, a.frame_index, a.signal AS view_signal, b.signal AS click_signal FROM obs a JOIN obs b ON a.identity=b.identity AND a.frame_index=b.frame_index WHERE a.stem='view' AND b.stem='click'",
    "view_signal click_signal",
)
def _(i):
    obs = i.daily()
    side = lambda s: by_stem(i, s, obs).select("identity", "frame_index", F.col("signal").alias(f"{s}_signal"))
    return side("view").join(side("click"), ["identity", "frame_index"])


@query("lagged_pairs", f"WITH {DAILY_SQL} SELECT a.stem, a.identity, b.frame_index, b.frame_index-a.frame_index AS lag_frames, a.signal AS va, b.activity AS vb FROM obs a JOIN obs b ON a.stem=b.stem AND a.identity=b.identity AND b.frame_index-a.frame_index BETWEEN -2 AND 2", "va vb")
def _(i):
    return Q.lagged_pairs(i.daily(), "signal", "activity", 2)


# --- trends, recurrence, sequences -----------------------------------------------------------------------

_AR = "((rank() OVER (PARTITION BY stem, identity ORDER BY {c}) + (count(*) OVER (PARTITION BY stem, identity, {c}) - 1)/2.0))"


@query(
    "robust_trend",
    f"""WITH {TRACES_SQL}, sl AS (SELECT a.stem, a.identity, list_sort(list((b.signal-a.signal)/(b.hours-a.hours))) AS s FROM tr a JOIN tr b ON a.stem=b.stem AND a.identity=b.identity AND a.hours<b.hours GROUP BY 1,2),
 ti AS (SELECT stem, identity, sum(k) AS n, sum(k*(k-1)*(2*k+5)) AS t FROM (SELECT stem, identity, signal, count(*) AS k FROM tr GROUP BY 1,2,3) GROUP BY 1,2),
 sg AS (SELECT ti.*, s, len(s) AS np, sqrt((n*(n-1)*(2*n+5)-t)/18.0) AS sigma FROM ti JOIN sl USING (stem, identity) WHERE n>=5),
 q AS (SELECT stem, identity, (s[(np-1)//2+1]+s[np//2+1])/2 AS slope_per_hour, s[greatest(CAST(round_even((np-1.959963984540054*sigma)/2,0) AS BIGINT)-1,0)+1] AS slope_low, s[least(CAST(round_even((np+1.959963984540054*sigma)/2,0) AS BIGINT),np-1)+1] AS slope_high FROM sg),
 r AS (SELECT stem, identity, hours, signal, {_AR.format(c='hours')} AS rt, {_AR.format(c='signal')} AS rv FROM tr)
 SELECT *, {rank_p_value_sql('monotone_rho', 'observations')} AS monotone_p_value FROM (SELECT stem, identity, count(*) AS observations, max(hours)-min(hours) AS span_hours, median(signal) AS level_median, regr_slope(signal,hours) AS slope_least_squares, {_CORR.format(a='rt', b='rv')} AS monotone_rho, any_value(slope_per_hour) AS slope_per_hour, any_value(slope_low) AS slope_low, any_value(slope_high) AS slope_high, any_value(slope_per_hour)*(max(hours)-min(hours)) AS change_over_recording
 FROM r JOIN q USING (stem, identity) GROUP BY 1,2)""",
    "span_hours level_median monotone_p_value slope_least_squares monotone_rho slope_per_hour slope_low slope_high change_over_recording",
    digits=9,
)
def _(i):
    return Q.robust_trend(i.traces(), "signal")


_Z = "CASE WHEN stddev_pop({c}) OVER w > 1e-9 THEN ({c}-avg({c}) OVER w)/stddev_pop({c}) OVER w ELSE 0.0 END"
_RQA = f"""sv AS (SELECT stem, identity, row_number() OVER (PARTITION BY stem, identity ORDER BY frame_index) AS p, count(*) OVER w AS n, {_Z.format(c='area_px')} AS z1, {_Z.format(c='mean_raw')} AS z2 FROM tk WINDOW w AS (PARTITION BY stem, identity)),
 ds AS (SELECT a.stem, a.identity, a.n, a.p AS i, b.p AS j, round(sqrt((a.z1-b.z1)**2+(a.z2-b.z2)**2),9) AS d FROM sv a JOIN sv b ON a.stem=b.stem AND a.identity=b.identity AND a.p<>b.p WHERE a.n>=8),
 cu AS (SELECT stem, identity, quantile_cont(d,0.1) AS cutoff FROM ds WHERE i<j GROUP BY 1,2), ht AS (SELECT ds.*, cutoff, d<=cutoff AS h FROM ds JOIN cu USING (stem, identity))"""


def _vectors(i):
    return Q.state_vectors(i.tracks(), ["area_px", "mean_raw"], 8)


@query("recurrence_by_lag", f"{TK}, {_RQA} SELECT stem, identity, CAST(j-i AS INTEGER) AS lag_frames, count(*) FILTER (WHERE h)/any_value(n-(j-i)) AS recurrence_rate, any_value(n-(j-i)) AS recurrence_pairs FROM ht WHERE i<j AND j-i<=8 GROUP BY 1,2,3", "recurrence_rate")
def _(i):
    return Q.recurrence(_vectors(i), 0.1, 8)[0]


@query(
    "recurrence_quantification",
    f"""{TK}, {_RQA}, pt AS (SELECT * FROM ht WHERE h), mk2 AS (SELECT p.stem, p.identity, p.i, p.j, max(CASE WHEN q.i=p.i+1 AND q.j=p.j+1 OR q.i=p.i-1 AND q.j=p.j-1 THEN 1 ELSE 0 END) AS dg, max(CASE WHEN q.j=p.j AND abs(q.i-p.i)=1 THEN 1 ELSE 0 END) AS vt
 FROM pt p LEFT JOIN pt q ON q.stem=p.stem AND q.identity=p.identity AND abs(q.i-p.i)<=1 AND abs(q.j-p.j)<=1 GROUP BY 1,2,3,4)
 SELECT cu.stem, cu.identity, cutoff, coalesce(avg(dg),0) AS determinism, coalesce(avg(vt),0) AS laminarity FROM cu LEFT JOIN mk2 USING (stem, identity) GROUP BY 1,2,3""",
    "cutoff determinism laminarity",
    digits=7,
)
def _(i):
    return Q.recurrence(_vectors(i), 0.1, 8)[1]


_REPLICATES, _SEED = 9, 51
_LINE = "{c}-(coalesce(regr_intercept({c},hours) OVER w,0)+coalesce(regr_slope({c},hours) OVER w,0)*hours)"
_DEAL = "row_number() OVER (PARTITION BY stem, identity, replicate ORDER BY md5(concat_ws('|','" + str(_SEED) + "',replicate,stem,identity,{d},p)), p)"
_BANDS = f"""dt AS (SELECT stem, identity, frame_index, {_LINE.format(c='area_px')} AS d1, {_LINE.format(c='mean_raw')} AS d2 FROM tk WINDOW w AS (PARTITION BY stem, identity)),
 sv AS (SELECT stem, identity, row_number() OVER (PARTITION BY stem, identity ORDER BY frame_index) AS p, count(*) OVER w AS n, {_Z.format(c='d1')} AS z1, {_Z.format(c='d2')} AS z2 FROM dt WINDOW w AS (PARTITION BY stem, identity)),
 rp AS (SELECT sv.*, {_DEAL.format(d=0)} AS q1, {_DEAL.format(d=1)} AS q2 FROM (SELECT *, unnest(range(1,{_REPLICATES + 1})) AS replicate FROM sv WHERE n>=8) sv),
 su AS (SELECT stem, identity, 0 AS replicate, p, n, z1, z2 FROM sv WHERE n>=8 UNION ALL SELECT a.stem, a.identity, a.replicate, a.q1, a.n, a.z1, b.z2 FROM rp a JOIN rp b ON a.stem=b.stem AND a.identity=b.identity AND a.replicate=b.replicate AND a.q1=b.q2),
 ds AS (SELECT a.stem, a.identity, a.replicate, a.n, a.p AS i, b.p AS j, round(sqrt((a.z1-b.z1)**2+(a.z2-b.z2)**2),9) AS d FROM su a JOIN su b ON a.stem=b.stem AND a.identity=b.identity AND a.replicate=b.replicate AND a.p<>b.p),
 cu AS (SELECT stem, identity, quantile_cont(d,0.1) AS cutoff FROM ds WHERE i<j AND replicate=0 GROUP BY 1,2), ht AS (SELECT ds.*, cutoff, d<=cutoff AS h FROM ds JOIN cu USING (stem, identity))"""


def _detrended_vectors(i):
    return Q.state_vectors(Q.detrended(i.tracks(), ["area_px", "mean_raw"]), ["area_px", "mean_raw"], 8)


@query(
    "recurrence_bands",
    f"""{TK}, {_BANDS}, r AS (SELECT stem, identity, replicate, CAST(j-i AS INTEGER) AS lag_frames, count(*) FILTER (WHERE h)/any_value(n-(j-i)) AS rate, any_value(n-(j-i)) AS recurrence_pairs FROM ht WHERE i<j AND j-i<=8 GROUP BY 1,2,3,4)
 SELECT o.stem, o.identity, o.lag_frames, o.rate AS recurrence_rate, o.recurrence_pairs, avg(s.rate) AS surrogate_mean, quantile_cont(s.rate,0.025) AS surrogate_low, quantile_cont(s.rate,0.975) AS surrogate_high FROM r o JOIN r s USING (stem, identity, lag_frames) WHERE o.replicate=0 AND s.replicate>0 GROUP BY ALL""",
    "recurrence_rate surrogate_mean surrogate_low surrogate_high",
)
def _(i):
    return Q.recurrence_bands(_detrended_vectors(i), 0.1, 8, _REPLICATES, _SEED)[0]


@query(
    "recurrence_quantification_bands",
    f"""{TK}, {_BANDS}, pt AS (SELECT * FROM ht WHERE h), mk2 AS (SELECT p.stem, p.identity, p.replicate, p.i, p.j, max(CASE WHEN q.i=p.i+1 AND q.j=p.j+1 OR q.i=p.i-1 AND q.j=p.j-1 THEN 1 ELSE 0 END) AS dg, max(CASE WHEN q.j=p.j AND abs(q.i-p.i)=1 THEN 1 ELSE 0 END) AS vt
 FROM pt p LEFT JOIN pt q ON q.stem=p.stem AND q.identity=p.identity AND q.replicate=p.replicate AND abs(q.i-p.i)<=1 AND abs(q.j-p.j)<=1 GROUP BY 1,2,3,4,5),
 sh AS (SELECT g.stem, g.identity, g.replicate, coalesce(avg(dg),0) AS dt, coalesce(avg(vt),0) AS lm FROM (SELECT DISTINCT stem, identity, replicate FROM su) g LEFT JOIN mk2 USING (stem, identity, replicate) GROUP BY 1,2,3)
 SELECT cu.stem, cu.identity, cutoff, any_value(dt) FILTER (WHERE replicate=0) AS determinism, any_value(lm) FILTER (WHERE replicate=0) AS laminarity, avg(dt) FILTER (WHERE replicate>0) AS determinism_surrogate, avg(lm) FILTER (WHERE replicate>0) AS laminarity_surrogate FROM cu JOIN sh USING (stem, identity) GROUP BY 1,2,3""",
    "cutoff determinism laminarity determinism_surrogate laminarity_surrogate",
    digits=7,
)
def _(i):
    return Q.recurrence_bands(_detrended_vectors(i), 0.1, 8, _REPLICATES, _SEED)[1]


@query("symbol_sequences", f"{BASE}, g AS (SELECT stem, identity, CAST(unnest(range(n_frames)) AS INTEGER) AS frame_index FROM (SELECT DISTINCT stem, identity FROM cl) JOIN {clock_sql('tk')} USING (stem)) SELECT g.*, coalesce(regime,-1) AS symbol FROM g LEFT JOIN (SELECT stem, identity, frame_index, regime FROM cl) USING (stem, identity, frame_index)")
def _(i):
    return Q.symbol_sequences(classed(i), clock_of(i.tracks()))


_RULE = """nx AS (SELECT stem, from_regime, to_regime, count(*) AS n FROM mv GROUP BY 1,2,3), rl AS (SELECT stem, from_regime, first(to_regime ORDER BY n DESC, to_regime) AS expected, CAST(sum(n) AS BIGINT) AS seen FROM nx GROUP BY 1,2),
 mm AS (SELECT stem, CAST(floor((hours%4)/0.5) AS INTEGER) AS bin, avg(CASE WHEN to_regime<>expected THEN 1.0 ELSE 0.0 END) AS mismatch, count(*) AS n FROM mv JOIN rl USING (stem, from_regime) GROUP BY 1,2)"""


@query("next_state_rule", f"{BASE}, {MOVES}, {_RULE} SELECT * FROM rl")
def _(i):
    return Q.next_state_rule(G.transitions(classed(i)), ["stem"])


@query("rule_mismatch_by_cycle", f"{BASE}, {MOVES}, {_RULE} SELECT * FROM mm", "mismatch")
def _(i):
    moves = G.transitions(classed(i))
    return Q.mismatch_by_cycle(moves, Q.next_state_rule(moves, ["stem"]), ["stem"], 4.0, 8)


@query(
    "cycle_vector",
    f"""{BASE}, {MOVES}, {_RULE}, s AS (SELECT stem, round(sum(mismatch*cos((bin+0.5)*2*pi()/8))/nullif(sum(mismatch),0),9)+0.0 AS c, round(sum(mismatch*sin((bin+0.5)*2*pi()/8))/nullif(sum(mismatch),0),9)+0.0 AS s FROM mm GROUP BY 1)
 SELECT stem, sqrt(c*c+s*s) AS vector_length, CASE WHEN c<>0 OR s<>0 THEN round(((atan2(s,c)/(2*pi()))%1.0+1.0)%1.0,9)%1.0 END AS mean_direction_cycles FROM s""",
    "vector_length mean_direction_cycles",
    digits=6,
)
def _(i):
    moves = G.transitions(classed(i))
    return Q.cycle_vector(Q.mismatch_by_cycle(moves, Q.next_state_rule(moves, ["stem"]), ["stem"], 4.0, 8), ["stem"], "mismatch", 8)
