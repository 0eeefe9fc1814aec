"""Warped alignment of sequences, each recording on its own clock."""

from pyspark.sql import functions as F

from lapsegrid.functions.numeric import ratio
from lapsegrid.operators import pairs as Q
from lapsegrid.sources.canonical import DAILY_SQL, TRACKS_SQL, clock_of
from lapsegrid.workload.registry import query
from lapsegrid.workload.w05_regimes import BASE, classed

_LISTS = ("cost", "steps", "shift", "met")


def banded_sql(source: str, band: int, differ: str, both: str) -> str:
    """Relations after `source` (stem, identity_a, identity_b, n, a, b): dw holds the end cell of each pair. One recursion step fills one cell of the band."""
    width, inf = 2 * band + 1, "CAST('inf' AS DOUBLE)"
    zero = ", ".join(["0.0"] * width)
    corner = ", ".join([inf] * band + ["0.0"] + [inf] * band)
    start = ", ".join(f"CAST([{corner if s == 'cost' else zero}] AS DOUBLE[]) AS p_{s}, CAST([] AS DOUBLE[]) AS c_{s}" for s in _LISTS)
    add = {"cost": f"({differ})", "steps": "1.0", "shift": f"({both})*(j-i)", "met": f"({both})"}
    value = {
        s: f"CASE WHEN NOT inside THEN {inf if s == 'cost' else '0.0'} ELSE (CASE ch WHEN 0 THEN {'u' if s == 'cost' else f'coalesce(p_{s}[k+2],0.0)'} WHEN 1 THEN {'l' if s == 'cost' else f'coalesce(c_{s}[k],0.0)'} ELSE {'d' if s == 'cost' else f'p_{s}[k+1]'} END) + {add[s]} END"
        for s in _LISTS
    }
    moved = ", ".join(
        f"CASE WHEN k={width - 1} THEN list_append(c_{s}, v_{s}) ELSE p_{s} END AS p_{s}, CASE WHEN k={width - 1} THEN CAST([] AS DOUBLE[]) ELSE list_append(c_{s}, v_{s}) END AS c_{s}" for s in _LISTS
    )
    return f"""
dp AS (
  SELECT stem, identity_a, identity_b, n, a, b, 0 AS t, {start} FROM {source}
  UNION ALL
  SELECT stem, identity_a, identity_b, n, a, b, t + 1, {moved} FROM (
    SELECT *, {", ".join(f"CAST({value[s]} AS DOUBLE) AS v_{s}" for s in _LISTS)} FROM (
      SELECT *, j >= 0 AND j < n AS inside, CASE WHEN u <= l AND u <= d THEN 0 WHEN l <= d THEN 1 ELSE 2 END AS ch FROM (
        SELECT *, CASE WHEN k + 1 < {width} AND i > 0 THEN p_cost[k+2] ELSE {inf} END AS u, CASE WHEN k > 0 AND j > 0 THEN c_cost[k] ELSE {inf} END AS l,
          CASE WHEN (i > 0 AND j > 0) OR (i = 0 AND j = 0) THEN p_cost[k+1] ELSE {inf} END AS d
        FROM (SELECT *, t // {width} AS i, t % {width} AS k, t // {width} + t % {width} - {band} AS j FROM dp WHERE t < n * {width})
      )
    )
  )
),
dw AS (SELECT stem, identity_a, identity_b, n, {", ".join(f"p_{s}[{band + 1}] AS {s}" for s in _LISTS)} FROM dp WHERE t = n * {width})"""


_PAIRED = "pr AS (SELECT x.stem, x.identity AS identity_a, y.identity AS identity_b, x.n, x.v AS a, y.v AS b FROM sv x JOIN sv y ON x.stem=y.stem AND x.identity<y.identity)"

_SYMBOLS = f"""{BASE.replace("WITH ", "WITH RECURSIVE ", 1)}, ck AS (SELECT stem, max(frame_index)+1 AS n FROM cl GROUP BY 1),
gr AS (SELECT stem, identity, n, CAST(unnest(range(n)) AS INTEGER) AS frame_index FROM (SELECT DISTINCT stem, identity FROM cl) JOIN ck USING (stem)),
sv AS (SELECT stem, identity, any_value(n) AS n, list(coalesce(regime,-1) ORDER BY frame_index) AS v FROM gr LEFT JOIN (SELECT stem, identity, frame_index, regime FROM cl) USING (stem, identity, frame_index) GROUP BY 1,2), {_PAIRED},
{banded_sql("pr", 4, "CASE WHEN a[i+1] <> b[j+1] THEN 1.0 ELSE 0.0 END", "CASE WHEN a[i+1] >= 0 AND b[j+1] >= 0 THEN 1.0 ELSE 0.0 END")}"""
_ALIGNED = "SELECT stem, identity_a, identity_b, CASE WHEN cost < 'inf' THEN cost/steps END AS dtw_distance, shift/nullif(met,0) AS alignment_offset_frames, CAST(met AS BIGINT) AS alignment_overlap_steps FROM dw"


def _symbols(i):
    return classed(i).select("stem", "identity", "frame_index", F.col("regime").alias("symbol"))


def _aligned(i, min_overlap):
    symbols = i.kept("symbols", lambda: _symbols(i))
    return Q.aligned_sequences(symbols, Q.recording_pairs(symbols.select("stem", "identity").distinct()), clock_of(symbols), 4, min_overlap=min_overlap)


@query("sequence_alignment", f"{_SYMBOLS} {_ALIGNED}", "dtw_distance alignment_offset_frames")
def _(i):
    return _aligned(i, 0)


@query("sequence_alignment_overlapping", f"{_SYMBOLS} {_ALIGNED} WHERE met >= 20", "dtw_distance alignment_offset_frames")
def _(i):
    return _aligned(i, 20)


#: Frames of a segment at least, and entities of a common window.
DAYS, TRACKS = (2, 4), (8, 5)


def _window_sql(source, rows, minimum, entities):
    return f"""WITH RECURSIVE {source},
ru AS (SELECT stem, identity, min(frame_index) AS f, max(frame_index) AS l FROM (SELECT *, frame_index - row_number() OVER (PARTITION BY stem, identity ORDER BY frame_index) AS g FROM {rows}) GROUP BY stem, identity, g),
sg AS (SELECT * FROM ru WHERE l-f+1 >= {minimum}),
ca AS (SELECT a.stem, a.f AS wf, b.l AS wl, count(*) AS we FROM (SELECT DISTINCT stem, f FROM sg) a JOIN (SELECT DISTINCT stem, l FROM sg) b USING (stem) JOIN sg s ON s.stem=a.stem AND s.f<=a.f AND s.l>=b.l WHERE b.l-a.f+1 >= {minimum} GROUP BY 1,2,3 HAVING count(*) >= {entities}),
wi AS (SELECT stem, wf, wl, we FROM ca QUALIFY row_number() OVER (PARTITION BY stem ORDER BY wl-wf DESC, we DESC, wf) = 1),
en AS (SELECT stem, identity, wf AS window_first, wl AS window_last, we AS window_entities, coalesce(m,0) AS longest_segment,
  CASE WHEN m IS NULL THEN 'too_few_consecutive_frames' WHEN wf IS NULL THEN 'no_common_window' WHEN NOT EXISTS (SELECT 1 FROM sg WHERE sg.stem=e.stem AND sg.identity=e.identity AND f<=wf AND l>=wl) THEN 'insufficient_common_window_coverage' ELSE 'available' END AS status
  FROM (SELECT DISTINCT stem, identity FROM {rows}) e LEFT JOIN wi USING (stem) LEFT JOIN (SELECT stem, identity, CAST(max(l-f+1) AS INTEGER) AS m FROM sg GROUP BY 1,2) USING (stem, identity))"""


def _distance_sql(source, rows, a, b, minimum, entities):
    return f"""{_window_sql(source, rows, minimum, entities)}, sc AS (SELECT stem, avg({a}) AS m, stddev_pop({a}) AS s FROM {rows} GROUP BY 1),
sv AS (SELECT stem, identity, any_value(window_last-window_first+1) AS n, list([({a}-m)/nullif(s,0), {b}] ORDER BY frame_index) AS v FROM {rows} JOIN en USING (stem, identity) JOIN sc USING (stem) WHERE status='available' AND frame_index BETWEEN window_first AND window_last GROUP BY 1,2),
{_PAIRED}, {banded_sql("pr", 3, "(a[i+1][1]-b[j+1][1])**2 + (a[i+1][2]-b[j+1][2])**2", "1.0")} SELECT stem, identity_a, identity_b, sqrt(cost/n) AS trajectory_distance FROM dw"""


def _distances(rows, a, b, minimum, entities):
    scale = rows.groupBy("stem").agg(F.avg(a).alias("m"), F.stddev_pop(a).alias("s"))
    return Q.trajectory_distances(rows.join(scale, "stem"), F.array(ratio(F.col(a) - F.col("m"), "s"), b), 2, 3, minimum, entities)


@query("trajectory_window", f"{_window_sql(DAILY_SQL, 'obs', *DAYS)} SELECT * FROM en")
def _(i):
    return Q.trajectory_window(i.daily(), *DAYS)


@query("trajectory_distance_days", _distance_sql(DAILY_SQL, "obs", "signal", "activity/2.0", *DAYS), "trajectory_distance")
def _(i):
    return _distances(i.kept("daily", i.daily), "signal", F.col("activity") / 2.0, *DAYS)


@query("trajectory_distance", _distance_sql(TRACKS_SQL, "tk", "area_px", "mean_raw/50.0", *TRACKS), "trajectory_distance")
def _(i):
    return _distances(i.tracks(), "area_px", F.col("mean_raw") / 50.0, *TRACKS)
