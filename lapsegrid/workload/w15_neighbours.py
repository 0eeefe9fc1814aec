"""Statistics of two entities, over a pair table: each entity with its nearest ones by median position."""

from pyspark.sql import functions as F

from lapsegrid.operators import pairs as Q
from lapsegrid.operators import regimes as G
from lapsegrid.operators import rhythm as Y
from lapsegrid.operators import stats as S
from lapsegrid.sources.canonical import TRACKS_SQL
from lapsegrid.workload.registry import query
from lapsegrid.workload.w05_regimes import BASE, MOVES, classed
from lapsegrid.workload.w07_pairs import _CORR, _GRAPH, MED
from lapsegrid.workload.w09_rhythm import _COS

PERIOD = 7
TK = f"WITH {TRACKS_SQL}, {MED}, {_GRAPH}"


def pair_table(i):
    return Q.neighbour_graph(Q.median_positions(i.tracks()), 2, 2.0)


_FITS = _COS.replace("pi()/24*", f"pi()/{PERIOD}*").replace("phase*24", f"phase*{PERIOD}").replace("signal", "mean_raw").replace("FROM ev2", "FROM tk")


@query(
    "phase_differences",
    f"""{TK}, {_FITS} SELECT gr.stem, identity_a, identity_b, a.phase AS phase_a, b.phase AS phase_b, ((a.phase-b.phase+0.5)%1.0+1.0)%1.0-0.5 AS phase_difference, (((a.phase-b.phase+0.5)%1.0+1.0)%1.0-0.5)*{PERIOD} AS difference_hours
 FROM gr JOIN csn a ON a.stem=gr.stem AND a.identity=gr.identity_a JOIN csn b ON b.stem=gr.stem AND b.identity=gr.identity_b""",
    "phase_a phase_b phase_difference difference_hours",
    digits=5,
)
def _(i):
    return Q.phase_difference(Y.cosinor(i.tracks(), ["stem", "identity"], "mean_raw", float(PERIOD)), float(PERIOD), pair_table(i))


@query(
    "sliding_pair_windows",
    f"""{TK}, p AS (SELECT gr.stem, identity_a, identity_b, a.hours, sqrt((a.y-b.y)**2+(a.x-b.x)**2) AS distance, a.mean_raw AS va, b.mean_raw AS vb FROM gr JOIN tk a ON a.stem=gr.stem AND a.identity=identity_a JOIN tk b ON b.stem=gr.stem AND b.identity=identity_b AND a.frame_index=b.frame_index),
 w AS (SELECT *, unnest(range(CAST(greatest(ceil((hours-4+1e-9)/2),0) AS BIGINT), CAST(floor(hours/2) AS BIGINT)+1)) AS win FROM p),
 s AS (SELECT stem, identity_a, identity_b, win AS "window", count(*) AS n, avg(distance) AS mean_distance, min(distance) AS min_distance, max(distance) AS max_distance, CASE WHEN count(*)>=5 THEN {_CORR.format(a='va', b='vb')} END AS coordination FROM w WHERE hours>=win*2 AND hours<win*2+4 GROUP BY 1,2,3,4)
 SELECT *, CASE WHEN n<5 THEN 'insufficient' WHEN coordination IS NULL THEN 'constant' ELSE 'estimated' END AS status FROM s""",
    "mean_distance min_distance max_distance coordination",
)
def _(i):
    both = Q.paired_rows(pair_table(i), i.tracks(), ["frame_index", "hours"], {"y": "y", "x": "x", "mean_raw": "v"})
    both = both.withColumn("distance", F.hypot(F.col("y_a") - F.col("y_b"), F.col("x_a") - F.col("x_b"))).withColumnsRenamed({"v_a": "va", "v_b": "vb"})
    return S.sliding_pair_windows(both, ["stem", "identity_a", "identity_b"], "hours", 4.0, 2.0, 5)


_K = "stem, identity_a, identity_b"


@query(
    "switching_association",
    f"""{BASE}, {MOVES}, {MED}, {_GRAPH}, sp AS (SELECT stem, identity, to_frame_index AS f, hours, CAST(from_regime<>to_regime AS INTEGER) AS ch FROM mv),
 j AS (SELECT gr.*, a.f, a.hours, a.ch AS ca, b.ch AS cb FROM gr JOIN sp a ON a.stem=gr.stem AND a.identity=identity_a JOIN sp b ON b.stem=gr.stem AND b.identity=identity_b AND b.f=a.f),
 c AS (SELECT {_K}, x.f AS r, y.f AS t, abs(y.f-x.f) AS d FROM (SELECT * FROM j WHERE ca=1) x JOIN (SELECT * FROM j WHERE cb=1) y USING ({_K}) WHERE abs(y.f-x.f)<=2),
 k AS (SELECT {_K}, r, any_value(t) AS t, count(*) AS n FROM (SELECT *, min(d) OVER (PARTITION BY {_K}, r) AS m FROM c) WHERE d=m GROUP BY {_K}, r), w AS (SELECT {_K}, t, count(*) AS wanted FROM k WHERE n=1 GROUP BY ALL),
 mt AS (SELECT {_K}, count(*) FILTER (WHERE n=1 AND wanted=1) AS matched, count(*) FILTER (WHERE n>1 OR wanted>1) AS ambiguous FROM (SELECT k.*, CASE WHEN k.n=1 THEN wanted END AS wanted FROM k LEFT JOIN w USING ({_K}, t)) GROUP BY ALL),
 sm AS (SELECT {_K}, count(*) AS n, max(hours)-min(hours) AS span_hours, sum(ca) AS sa, sum(cb) AS sb, {_CORR.format(a='ca', b='cb')} AS p FROM j GROUP BY ALL),
 o AS (SELECT gr.*, coalesce(n,0) AS joint_intervals, coalesce(n,0)*0.5 AS joint_hours, span_hours, CAST(coalesce(sa,0) AS BIGINT) AS changes_a, CAST(coalesce(sb,0) AS BIGINT) AS changes_b, coalesce(matched,0) AS matched, coalesce(ambiguous,0) AS ambiguous, p,
  CASE WHEN coalesce(n,0)<8 OR n*0.5<4 OR span_hours<5 THEN 'insufficient' WHEN p IS NULL THEN 'constant' ELSE 'descriptive' END AS status FROM gr LEFT JOIN sm USING ({_K}) LEFT JOIN mt USING ({_K}))
 SELECT {_K}, joint_intervals, joint_hours, span_hours, changes_a, changes_b, matched, ambiguous, matched/nullif(changes_a,0) AS matched_share_a, matched/nullif(changes_b,0) AS matched_share_b, CASE WHEN status='descriptive' THEN p END AS phi, status FROM o""",
    "joint_hours span_hours matched_share_a matched_share_b phi",
)
def _(i):
    moves = i.kept("moves", lambda: G.transitions(classed(i)))
    return Q.switching_association(moves, pair_table(i), 0.5, 8, 4.0, 5.0, 2)
