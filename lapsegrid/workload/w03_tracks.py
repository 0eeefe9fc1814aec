"""Steps, walks, smoothing, displacement and detrending."""

from pyspark.sql import functions as F

from lapsegrid.operators import tracks as K
from lapsegrid.sources.canonical import TRACES_SQL, TRACKS_SQL
from lapsegrid.workload.registry import query

W = "WINDOW w AS (PARTITION BY stem, identity ORDER BY frame_index)"
STEPS = f"""l AS (SELECT stem, identity, frame_index, hours, y, x, lag(y) OVER w AS py, lag(x) OVER w AS px, lag(frame_index) OVER w AS pf, lag(hours) OVER w AS ph,
 first_value(y) OVER w AS y0, first_value(x) OVER w AS x0 FROM tk {W}),
 st0 AS (SELECT *, CAST(frame_index-pf AS BIGINT) AS frame_gap, sqrt((y-py)**2+(x-px)**2) AS step_px FROM l),
 st AS (SELECT stem, identity, frame_index, hours, y, x, py, px, pf, frame_gap, step_px, CASE WHEN frame_gap=1 THEN step_px END AS step_px_gapless,
 step_px/frame_gap AS step_per_frame, step_px/(hours-ph) AS speed_px_per_hour,
 sum(coalesce(step_px,0.0)) OVER (PARTITION BY stem, identity ORDER BY frame_index) AS path_px, sqrt((y-y0)**2+(x-x0)**2) AS displacement_px FROM st0)"""
TURNS = f"""hd AS (SELECT stem, identity, frame_index, frame_gap, step_px, CASE WHEN frame_gap=1 AND step_px>=0.5 THEN atan2(y-py, x-px) END AS heading FROM st),
 tn AS (SELECT *, CASE WHEN frame_gap=1 THEN atan2(sin(heading-p), cos(heading-p)) END AS turn FROM (SELECT *, lag(heading) OVER w AS p FROM hd {W}))"""


@query("steps", f"WITH {TRACKS_SQL}, {STEPS} SELECT * FROM st", "hours y x py px step_px step_px_gapless step_per_frame speed_px_per_hour path_px displacement_px")
def _(i):
    return K.steps(i.tracks())


@query("path_segments", f"WITH {TRACKS_SQL}, {STEPS} SELECT stem, identity, frame_index, px AS x1, py AS y1, x AS x2, y AS y2 FROM st WHERE frame_gap=1", "x1 y1 x2 y2")
def _(i):
    return K.segments(K.steps(i.tracks()))


@query("turns", f"WITH {TRACKS_SQL}, {STEPS}, {TURNS} SELECT stem, identity, frame_index, frame_gap, step_px, heading, turn, cos(turn) AS cos_turn FROM tn", "step_px heading turn cos_turn")
def _(i):
    return K.turns(K.steps(i.tracks()), 0.5)


@query(
    "turn_runs",
    f"""WITH {TRACKS_SQL}, {STEPS}, {TURNS}, e AS (SELECT *, CASE WHEN turn IS NULL OR abs(turn) > 1.0 THEN 1 ELSE 0 END AS e, CASE WHEN turn IS NULL THEN 1 ELSE 0 END AS u FROM tn),
 g AS (SELECT *, sum(pe) OVER {'(PARTITION BY stem, identity ORDER BY frame_index)'} AS run FROM (SELECT *, coalesce(lag(e) OVER w, 1) AS pe FROM e {W})),
 r AS (SELECT stem, identity, run, sum(1-u) AS steps, max(u) AS ab FROM g GROUP BY 1,2,3)
 SELECT stem, identity, count(*) AS runs, avg(steps) AS mean_run, CAST(max(steps) AS BIGINT) AS longest_run, CAST(sum(ab) AS BIGINT) AS aborted_runs FROM r WHERE steps>0 GROUP BY 1,2""",
    "mean_run",
)
def _(i):
    return K.turn_runs(K.turns(K.steps(i.tracks()), 0.5), 1.0)


@query(
    "strict_centred_mean",
    f"""WITH {TRACES_SQL} SELECT stem, identity, frame_index, signal, CASE WHEN count(signal) OVER w = 3 THEN avg(signal) OVER w END AS smooth FROM tr
 WINDOW w AS (PARTITION BY stem, identity ORDER BY frame_index RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)""",
    "signal smooth",
)
def _(i):
    return K.centred_mean(i.traces().select("stem", "identity", "frame_index", "signal"), "signal", 3, "smooth")


@query(
    "median_then_mean",
    f"""WITH {TRACES_SQL}, m AS (SELECT stem, identity, frame_index, signal, CASE WHEN count(signal) OVER w = 3 THEN median(signal) OVER w END AS smooth_median FROM tr
 WINDOW w AS (PARTITION BY stem, identity ORDER BY frame_index RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING))
 SELECT *, CASE WHEN count(smooth_median) OVER w = 3 THEN avg(smooth_median) OVER w END AS smooth FROM m
 WINDOW w AS (PARTITION BY stem, identity ORDER BY frame_index RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)""",
    "signal smooth smooth_median",
)
def _(i):
    return K.median_then_mean(i.traces().select("stem", "identity", "frame_index", "signal"), "signal", "smooth")


@query(
    "running_baseline",
    f"""WITH {TRACES_SQL} SELECT stem, identity, frame_index, signal, avg(signal) OVER w AS baseline, signal - avg(signal) OVER w AS residual,
 frame_index-8 < min(frame_index) OVER (PARTITION BY stem, identity) OR frame_index+8 > max(frame_index) OVER (PARTITION BY stem, identity) AS edge FROM tr
 WINDOW w AS (PARTITION BY stem, identity ORDER BY frame_index RANGE BETWEEN 8 PRECEDING AND 8 FOLLOWING)""",
    "signal baseline residual",
)
def _(i):
    return K.running_baseline(i.traces().select("stem", "identity", "frame_index", "signal"), "signal", 8)


@query(
    "running_median_baseline",
    f"""WITH {TRACES_SQL} SELECT stem, identity, frame_index, signal, median(signal) OVER w AS baseline, signal - median(signal) OVER w AS residual,
 frame_index-8 < min(frame_index) OVER (PARTITION BY stem, identity) OR frame_index+8 > max(frame_index) OVER (PARTITION BY stem, identity) AS edge FROM tr
 WINDOW w AS (PARTITION BY stem, identity ORDER BY frame_index RANGE BETWEEN 8 PRECEDING AND 8 FOLLOWING)""",
    "signal baseline residual",
)
def _(i):
    return K.running_baseline(i.traces().select("stem", "identity", "frame_index", "signal"), "signal", 8, statistic="median")


@query(
    "linear_detrend",
    f"""WITH {TRACES_SQL}, l AS (SELECT stem, identity, coalesce(regr_slope(signal, hours),0) AS b, avg(hours) AS t, avg(signal) AS m FROM tr GROUP BY 1,2)
 SELECT stem, identity, hours, signal, m+b*(hours-t) AS baseline, signal-(m+b*(hours-t)) AS residual FROM tr JOIN l USING (stem, identity)""",
    "hours signal baseline residual",
)
def _(i):
    return K.linear_detrend(i.traces().select("stem", "identity", "hours", "signal"), "signal")


@query(
    "polynomial_detrend",
    f"""WITH {TRACES_SQL}, c AS (SELECT stem, identity, avg(hours) AS c, greatest(max(hours)-min(hours),1e-12) AS w FROM tr GROUP BY 1,2),
 a AS (SELECT tr.stem, tr.identity, hours, signal, (hours-c)/w AS t FROM tr JOIN c USING (stem, identity)),
 s AS (SELECT stem, identity, count(*)::DOUBLE AS n, sum(t*t) AS s2, sum(t*t*t) AS s3, sum(t*t*t*t) AS s4, sum(signal) AS y0, sum(signal*t) AS y1, sum(signal*t*t) AS y2 FROM a GROUP BY 1,2),
 d AS (SELECT *, n*(s2*s4-s3*s3)-s2*s2*s2 AS det FROM s),
 f AS (SELECT stem, identity, CASE WHEN abs(det)>1e-12 THEN (y0*(s2*s4-s3*s3)+s2*(y1*s3-s2*y2))/det END AS a0,
 CASE WHEN abs(det)>1e-12 THEN (n*(y1*s4-s3*y2)+s2*(y0*s3-s2*y1))/det END AS a1, CASE WHEN abs(det)>1e-12 THEN (n*(s2*y2-s3*y1)-s2*s2*y0)/det END AS a2 FROM d)
 SELECT a.stem, a.identity, hours, signal, a0+a1*t+a2*t*t AS baseline, signal-(a0+a1*t+a2*t*t) AS residual FROM a JOIN f USING (stem, identity)""",
    "hours signal baseline residual",
    digits=5,
)
def _(i):
    return K.polynomial_detrend(i.traces().select("stem", "identity", "hours", "signal"), "signal")


@query(
    "first_difference",
    f"WITH {TRACES_SQL} SELECT stem, identity, frame_index, signal, CASE WHEN frame_index - lag(frame_index) OVER w = 1 THEN signal - lag(signal) OVER w END AS difference FROM tr {W}",
    "signal difference",
)
def _(i):
    return K.first_difference(i.traces().select("stem", "identity", "frame_index", "signal"), "signal")


_FILLED = f"""a AS (SELECT stem, identity, frame_index, signal AS v, lead(frame_index) OVER w AS nf, lead(signal) OVER w AS nv FROM tr {W}),
 fl AS (SELECT stem, identity, CAST(f AS INTEGER) AS frame_index, CASE WHEN f=frame_index THEN v ELSE v+(nv-v)*(f-frame_index)/(nf-frame_index) END AS filled
 FROM (SELECT *, unnest(range(frame_index, coalesce(nf, frame_index+1))) AS f FROM a)),
 sm AS (SELECT *, avg(filled) OVER (PARTITION BY stem, identity ORDER BY frame_index RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS smooth FROM fl)"""


@query("interpolated_smooth", f"WITH {TRACES_SQL}, {_FILLED} SELECT * FROM sm", "filled smooth")
def _(i):
    return K.interpolated_smooth(i.traces(), "signal", 2)


@query(
    "sustained_onsets",
    f"""WITH {TRACES_SQL}, {_FILLED}, c AS (SELECT stem, identity, frame_index, smooth-40 AS v FROM sm),
 q AS (SELECT *, lag(v) OVER w AS pv, lag(frame_index) OVER w AS pf, min(v) OVER (PARTITION BY stem, identity ORDER BY frame_index ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS lo,
 count(*) OVER (PARTITION BY stem, identity ORDER BY frame_index ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS n FROM c {W})
 SELECT stem, identity, min(frame_index) AS onset_frame, count(*) AS crossings FROM q WHERE pv<=0 AND v>0 AND frame_index-pf=1 AND lo>0 AND n=3 GROUP BY 1,2""",
)
def _(i):
    smooth = K.interpolated_smooth(i.traces(), "signal", 2).withColumn("v", F.col("smooth") - 40)
    return K.sustained_onsets(smooth.select("stem", "identity", "frame_index", "v"), "v", 3)


@query(
    "track_summary",
    f"""WITH {TRACKS_SQL}, {STEPS} SELECT stem, identity, count(*) AS frames, sum(step_px) AS path_px, last(displacement_px ORDER BY frame_index) AS net_px, count(step_px_gapless) AS consecutive_steps,
 max(step_px_gapless) AS max_step, avg(speed_px_per_hour) AS mean_speed, CAST(max(frame_index)-min(frame_index)+1 AS BIGINT) AS span_frames,
 quantile_cont(step_px_gapless, 0.5) AS median_step, quantile_cont(step_px_gapless, 0.95) AS p95_step,
 last(displacement_px ORDER BY frame_index)/nullif(sum(step_px),0) AS straightness, CAST(max(frame_index)-min(frame_index)+1-count(*) AS BIGINT) AS gap_frames FROM st GROUP BY 1,2 HAVING count(*)>=5""",
    "path_px net_px max_step mean_speed median_step p95_step straightness",
)
def _(i):
    return K.track_summary(K.steps(i.tracks()))


@query(
    "walk_summary",
    f"""WITH {TRACKS_SQL}, {STEPS}, {TURNS}, a AS (SELECT stem, identity, count(turn) AS turns, avg(cos(turn)) AS mean_cos_turn, sqrt(avg(cos(heading))**2+avg(sin(heading))**2) AS r,
 avg(CASE WHEN frame_gap=1 THEN CAST(step_px<0.5 AS DOUBLE) END) AS stationary_fraction FROM tn GROUP BY 1,2),
 s AS (SELECT stem, identity, (var_samp(x)+var_samp(y))/2 AS h, sqrt(((var_samp(x)-var_samp(y))/2)**2+covar_samp(x,y)**2) AS q,
 atan2(last(y ORDER BY frame_index)-first(y ORDER BY frame_index), last(x ORDER BY frame_index)-first(x ORDER BY frame_index)) AS net_angle FROM st GROUP BY 1,2)
 SELECT stem, identity, turns, mean_cos_turn, stationary_fraction, CASE WHEN r>0 AND r<=1 THEN sqrt(-2*ln(r)) END AS circular_dispersion, net_angle,
 CASE WHEN h+q>1e-12 THEN greatest(h-q,0.0)/(h+q) END AS path_asymmetry FROM a JOIN s USING (stem, identity)""",
    "mean_cos_turn stationary_fraction circular_dispersion net_angle path_asymmetry",
)
def _(i):
    return K.walk_summary(K.steps(i.tracks()), 0.5)


@query(
    "frame_heading_resultant",
    f"WITH {TRACKS_SQL}, {STEPS}, {TURNS} SELECT stem, frame_index, count(heading) AS entities, sqrt(avg(cos(heading))**2+avg(sin(heading))**2) AS resultant FROM tn GROUP BY 1,2 HAVING count(heading)>0",
    "resultant",
)
def _(i):
    return K.frame_resultant(K.turns(K.steps(i.tracks()), 0.5))


MSD = """msd AS (SELECT a.stem, a.identity, b.frame_index-a.frame_index AS lag_frames, avg((b.y-a.y)**2+(b.x-a.x)**2) AS msd_px2, count(*) AS pairs FROM tk a JOIN tk b
 ON a.stem=b.stem AND a.identity=b.identity AND b.frame_index-a.frame_index BETWEEN 1 AND 8 GROUP BY 1,2,3 HAVING count(*)>=3)"""


@query("mean_squared_displacement", f"WITH {TRACKS_SQL}, {MSD} SELECT * FROM msd", "msd_px2")
def _(i):
    return K.displacement_by_lag(i.tracks(), 8)


@query(
    "displacement_growth",
    f"WITH {TRACKS_SQL}, {MSD} SELECT stem, identity, count(*) AS lags, regr_slope(ln(msd_px2), ln(CAST(lag_frames AS DOUBLE))) AS exponent FROM msd WHERE msd_px2>0 GROUP BY 1,2 HAVING count(*)>=3",
    "exponent",
)
def _(i):
    return K.growth_exponent(K.displacement_by_lag(i.tracks(), 8))


@query(
    "direction_halflife",
    f"""WITH {TRACKS_SQL}, {STEPS}, {TURNS}, h AS (SELECT * FROM tn WHERE heading IS NOT NULL),
 m AS (SELECT a.stem, a.identity, b.frame_index-a.frame_index AS lag, avg(cos(b.heading-a.heading)) AS c FROM h a JOIN h b ON a.stem=b.stem AND a.identity=b.identity AND b.frame_index-a.frame_index BETWEEN 1 AND 6 GROUP BY 1,2,3
 UNION ALL SELECT DISTINCT stem, identity, 0, 1.0 FROM h),
 q AS (SELECT *, lag(c) OVER (PARTITION BY stem, identity ORDER BY lag) AS pc, lag(lag) OVER (PARTITION BY stem, identity ORDER BY lag) AS pl FROM m)
 SELECT stem, identity, first(pl+(pc-0.5)/(pc-c)*(lag-pl) ORDER BY lag) AS halflife_frames FROM q WHERE c<0.5 AND pc>=0.5 GROUP BY 1,2""",
    "halflife_frames",
)
def _(i):
    return K.direction_halflife(K.turns(K.steps(i.tracks()), 0.5), 6)
