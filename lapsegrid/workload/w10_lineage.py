"""Life histories, families and gap additions."""

from pyspark.sql import functions as F

from lapsegrid.operators import lineage as N
from lapsegrid.sources.canonical import FIELD_HEIGHT as H, clock_of, clock_sql
from lapsegrid.sources.canonical import FIELD_WIDTH as W
from lapsegrid.sources.canonical import PIXELS_SQL
from lapsegrid.workload.registry import query

# Names change every seven frames, at a time of their own, so that lives begin and end inside the recording.
# Places are moved in by one from the upper and left border, so that only some masks touch a border.
RENAMED = f"{PIXELS_SQL}, ln AS (SELECT stem, frame_index, y+1 AS y, x+1 AS x, CASE WHEN identity IS NOT NULL THEN identity + 100*((frame_index+identity)//7) END AS identity, raw, unclaimed FROM px), lm AS (SELECT * FROM ln WHERE identity IS NOT NULL)"


def named(i):
    return i.kept("named", lambda: _named(i))


def _named(i):
    px = i.pixels()
    era = F.floor((F.col("frame_index") + F.col("identity")) / 7)
    return px.select("stem", "frame_index", (F.col("y") + 1).alias("y"), (F.col("x") + 1).alias("x"), (F.col("identity") + 100 * era).cast("long").alias("identity"), "raw", "unclaimed")


LIVES = f"""{RENAMED}, sp AS (SELECT stem, identity, min(frame_index) AS first_frame, max(frame_index) AS last_frame, count(DISTINCT frame_index) AS frames_named FROM lm GROUP BY 1,2),
 ar AS (SELECT stem, identity, frame_index, count(*) AS area_px, bool_or(y=0 OR x=0 OR y={H} OR x={W}) AS tb FROM lm GROUP BY 1,2,3),
 fs AS (SELECT ar.*, last_frame FROM sp JOIN ar ON ar.stem=sp.stem AND ar.identity=sp.identity AND ar.frame_index=first_frame), ls AS (SELECT ar.* FROM sp JOIN ar ON ar.stem=sp.stem AND ar.identity=sp.identity AND ar.frame_index=last_frame),
 ed AS (SELECT m.stem, m.identity, m.frame_index, m.y, m.x FROM lm m LEFT JOIN lm o ON o.stem=m.stem AND o.frame_index=m.frame_index AND o.identity=m.identity AND abs(o.y-m.y)<=1 AND abs(o.x-m.x)<=1 AND NOT (o.y=m.y AND o.x=m.x) GROUP BY ALL HAVING count(o.y)<8),
 tc AS (SELECT DISTINCT e.stem, e.frame_index, e.identity, o.identity AS partner FROM ed e JOIN lm o ON o.stem=e.stem AND o.frame_index=e.frame_index AND o.identity<>e.identity AND abs(o.y-e.y)<=1 AND abs(o.x-e.x)<=1),
 tb2 AS (SELECT * FROM tc UNION SELECT stem, frame_index, partner, identity FROM tc),
 ca AS (SELECT f.stem, f.identity, t.partner, a.area_px AS pa, b.area_px AS pb, round((f.area_px+a.area_px)/b.area_px,12) AS cons, least(f.last_frame, p.last_frame)-f.frame_index+1 AS tog FROM fs f JOIN tb2 t ON t.stem=f.stem AND t.identity=f.identity AND t.frame_index=f.frame_index
 JOIN ar a ON a.stem=f.stem AND a.identity=t.partner AND a.frame_index=f.frame_index JOIN ar b ON b.stem=f.stem AND b.identity=t.partner AND b.frame_index=f.frame_index-1 JOIN sp p ON p.stem=f.stem AND p.identity=t.partner WHERE f.frame_index>0 AND NOT f.tb),
 pa AS (SELECT stem, identity, first(partner ORDER BY round(abs(cons-1),12), partner) AS partner, first(pa ORDER BY round(abs(cons-1),12), partner) AS pa, first(cons ORDER BY round(abs(cons-1),12), partner) AS cons FROM ca WHERE abs(cons-1)<=0.3 AND tog>=2 GROUP BY 1,2),
 ss AS (SELECT f.stem, f.identity, f.frame_index, CASE WHEN f.frame_index=0 THEN 'present_at_start' WHEN tb THEN 'entered_field' WHEN partner IS NOT NULL THEN 'born' ELSE 'appeared' END AS event, CASE WHEN f.frame_index=0 THEN 'censored' WHEN tb THEN 'observed' WHEN partner IS NOT NULL THEN 'candidate' ELSE 'unproven' END AS event_status,
 area_px, partner AS partner_identity, pa AS partner_area_px, cons AS area_conservation, CAST(NULL AS DOUBLE) AS residual_fraction FROM fs f LEFT JOIN pa USING (stem, identity)),
 dv AS (SELECT stem, partner_identity AS identity, frame_index, 'divided' AS event, event_status, partner_area_px AS area_px, identity AS partner_identity, area_px AS partner_area_px, area_conservation, residual_fraction FROM ss WHERE event='born'),
 gr AS (SELECT l.stem, l.identity, n.identity AS taker, n.unclaimed FROM ls l JOIN lm m ON m.stem=l.stem AND m.identity=l.identity AND m.frame_index=l.frame_index JOIN ln n ON n.stem=l.stem AND n.frame_index=l.frame_index+1 AND n.y=m.y AND n.x=m.x),
 tk2 AS (SELECT stem, identity, max(n) AS n, first(taker ORDER BY n DESC, taker) AS taker FROM (SELECT stem, identity, taker, count(*) AS n FROM gr WHERE taker IS NOT NULL GROUP BY 1,2,3) GROUP BY 1,2), rs AS (SELECT stem, identity, count(*) FILTER (WHERE taker IS NOT NULL OR unclaimed) AS r FROM gr GROUP BY 1,2),
 cl AS (SELECT l.*, n_frames-1 AS ef, t.n, taker, coalesce(r,0) AS r FROM ls l JOIN {clock_sql('ln')} USING (stem) LEFT JOIN tk2 t USING (stem, identity) LEFT JOIN rs USING (stem, identity)),
 es AS (SELECT stem, identity, frame_index, CASE WHEN frame_index=ef THEN 'present_at_end' WHEN tb THEN 'left_field' WHEN n>=area_px*0.7 THEN 'absorbed' WHEN r<=area_px*0.3 THEN 'died' ELSE 'lost' END AS event,
 CASE WHEN frame_index=ef THEN 'censored' WHEN tb THEN 'observed' WHEN n>=area_px*0.7 OR r<=area_px*0.3 THEN 'candidate' ELSE 'unproven' END AS event_status, area_px, CASE WHEN frame_index<ef AND NOT tb AND n>=area_px*0.7 THEN taker END AS partner_identity, CAST(NULL AS BIGINT) AS partner_area_px, CAST(NULL AS DOUBLE) AS area_conservation,
 CASE WHEN frame_index<ef AND NOT tb AND NOT coalesce(n>=area_px*0.7,false) THEN r/area_px END AS residual_fraction FROM cl),
 le AS (SELECT * FROM ss UNION ALL SELECT * FROM dv UNION ALL SELECT * FROM es)"""
LROWS = """lr AS (SELECT le.stem, le.identity, max(event) FILTER (WHERE event IN ('present_at_start','entered_field','born','appeared')) AS start_event, max(event_status) FILTER (WHERE event IN ('present_at_start','entered_field','born','appeared')) AS start_status,
 max(event) FILTER (WHERE event NOT IN ('present_at_start','entered_field','born','appeared','divided')) AS end_event, max(event_status) FILTER (WHERE event NOT IN ('present_at_start','entered_field','born','appeared','divided')) AS end_status, any_value(first_frame) AS first_frame, any_value(last_frame) AS last_frame,
 max(partner_identity) FILTER (WHERE event='born') AS parent_identity, max(partner_identity) FILTER (WHERE event='absorbed') AS absorbed_into_identity, count(*) FILTER (WHERE event='divided') AS children, min(frame_index) FILTER (WHERE event='divided') AS first_division_frame,
 any_value(frames_named) AS frames_named, any_value(last_frame-first_frame+1-frames_named) AS gap_frames FROM le JOIN sp ON sp.stem=le.stem AND sp.identity=le.identity GROUP BY 1,2)"""


def events(i):
    return N.life_events(named(i), clock_of(named(i)), H + 1, W + 1, 1, 0.3, 2, 0.3)


def rows(i):
    px = named(i)
    return N.life_rows(events(i), N.life_spans(px.where(F.col("identity").isNotNull())))


@query("lifecycle_events", f"WITH {LIVES} SELECT * FROM le", "area_conservation residual_fraction")
def _(i):
    return events(i)


@query("lifecycle_rows", f"WITH {LIVES}, {LROWS} SELECT * FROM lr")
def _(i):
    return rows(i)


@query(
    "lifecycle_families",
    f"""WITH RECURSIVE {LIVES}, {LROWS}, lk AS (SELECT stem, identity AS u, parent_identity AS v FROM lr WHERE parent_identity IS NOT NULL UNION SELECT stem, identity, absorbed_into_identity FROM lr WHERE absorbed_into_identity IS NOT NULL),
 bo AS (SELECT stem, u, v FROM lk UNION SELECT stem, v, u FROM lk), reach(stem, u, v) AS (SELECT stem, identity, identity FROM lr UNION SELECT r.stem, r.u, b.v FROM reach r JOIN bo b ON b.stem=r.stem AND b.u=r.v),
 fm AS (SELECT stem, u AS identity, min(v) AS family FROM reach GROUP BY 1,2), sz AS (SELECT stem, family, count(*) AS members, min(first_frame) AS earliest_start FROM fm JOIN lr USING (stem, identity) GROUP BY 1,2)
 SELECT fm.stem, fm.family, fm.identity, members, earliest_start, family_rank FROM fm JOIN (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY earliest_start, family) AS family_rank FROM sz) USING (stem, family)""",
)
def _(i):
    return N.families(rows(i))


# Every third identity is tracked, the rest is background; the tracked ones blink out on some frames.
_BLINK = f"{PIXELS_SQL}, bk AS (SELECT * EXCLUDE (identity), CASE WHEN identity % 3 = 0 AND NOT ((frame_index + identity) % 5 = 2) AND NOT (identity = 6 AND frame_index BETWEEN 10 AND 16) THEN identity END AS identity FROM px), bm AS (SELECT * FROM bk WHERE identity IS NOT NULL)"
_GAPS = f"""{_BLINK}, fr AS (SELECT *, lead(frame_index) OVER (PARTITION BY stem, identity ORDER BY frame_index) AS nf FROM (SELECT DISTINCT stem, identity, frame_index FROM bm)),
 gp AS (SELECT stem, identity, frame_index AS left_frame, nf AS right_frame, CAST(frame_index+1 AS INTEGER) AS gap_start, CAST(nf-1 AS INTEGER) AS gap_end, CAST(nf-frame_index-1 AS BIGINT) AS gap_frames FROM fr WHERE nf-frame_index>1),
 l AS (SELECT gp.stem, gp.identity, gap_start, y, x FROM gp JOIN bm ON bm.stem=gp.stem AND bm.identity=gp.identity AND bm.frame_index=left_frame), r AS (SELECT gp.stem, gp.identity, gap_start, y, x FROM gp JOIN bm ON bm.stem=gp.stem AND bm.identity=gp.identity AND bm.frame_index=right_frame),
 mg AS (SELECT coalesce(l.stem,r.stem) AS stem, coalesce(l.identity,r.identity) AS identity, coalesce(l.gap_start,r.gap_start) AS gap_start, coalesce(l.y,r.y) AS y, coalesce(l.x,r.x) AS x, l.y IS NOT NULL AS il, r.y IS NOT NULL AS ir FROM l FULL JOIN r ON l.stem=r.stem AND l.identity=r.identity AND l.gap_start=r.gap_start AND l.y=r.y AND l.x=r.x),
 en AS (SELECT stem, identity, gap_start, count(*) FILTER (WHERE il AND ir)/count(*) AS endpoint_iou, count(*) FILTER (WHERE il) AS left_area_px, count(*) FILTER (WHERE ir) AS right_area_px, sqrt((avg(y) FILTER (WHERE il)-avg(y) FILTER (WHERE ir))**2+(avg(x) FILTER (WHERE il)-avg(x) FILTER (WHERE ir))**2) AS centroid_shift_px FROM mg GROUP BY 1,2,3),
 gf AS (SELECT stem, identity, gap_start, CAST(unnest(range(gap_start, gap_end+1)) AS INTEGER) AS f FROM gp WHERE gap_frames<=4),
 fo AS (SELECT DISTINCT mg.stem, mg.identity, mg.gap_start FROM mg JOIN gf USING (stem, identity, gap_start) JOIN bm ON bm.stem=mg.stem AND bm.frame_index=f AND abs(bm.y-mg.y)<=0 AND abs(bm.x-mg.x)<=0),
 au AS (SELECT gp.stem, gp.identity, gp.gap_start, gap_end, gap_frames, left_frame, right_frame, endpoint_iou, centroid_shift_px, left_area_px, right_area_px, CASE WHEN gp.identity=9 THEN 'merged_identity' WHEN gap_frames>4 THEN 'gap_too_long'
 WHEN endpoint_iou<0.0 OR centroid_shift_px>3.0 OR greatest(left_area_px,right_area_px)/greatest(least(left_area_px,right_area_px),1)>2.0 THEN 'unstable_endpoints' WHEN fo.stem IS NOT NULL THEN 'native_component_in_corridor' ELSE 'eligible' END AS reason
 FROM gp JOIN en USING (stem, identity, gap_start) LEFT JOIN fo ON fo.stem=gp.stem AND fo.identity=gp.identity AND fo.gap_start=gp.gap_start)"""


def _gap_audit(i):
    px = i.kept("blinking", lambda: _blinking(i))
    blocked = px.where(F.col("identity") == 9).select("stem", "identity").distinct()
    return N.gap_additions(px, blocked, 4, 0.0, 3.0, 2.0, 0, 1.0, 3.0)


def _blinking(i):
    fr, e = F.col("frame_index"), F.col("identity")
    gone = (e % 3 != 0) | ((fr + e) % 5 == 2) | ((e == 6) & fr.between(10, 16))
    return i.pixels().withColumn("identity", F.when(~gone, e))


@query("gap_audit", f"WITH {_GAPS} SELECT * FROM au", "endpoint_iou centroid_shift_px")
def _(i):
    return _gap_audit(i)[0]


@query(
    "gap_measurement_additions",
    f"""WITH {_GAPS}, w AS (SELECT *, CAST(unnest(range(gap_start, gap_end+1)) AS INTEGER) AS frame_index FROM au WHERE reason='eligible'), s AS (SELECT w.stem, w.identity, w.frame_index, m.y, m.x FROM w JOIN bm m ON m.stem=w.stem AND m.identity=w.identity AND m.frame_index=CASE WHEN 2*(w.frame_index-left_frame)<=right_frame-left_frame THEN left_frame ELSE right_frame END),
 v AS (SELECT s.stem, s.identity, s.frame_index, avg(raw) AS signal_mean, count(*) AS area_px FROM s JOIN bk USING (stem, frame_index, y, x) GROUP BY 1,2,3),
 f AS (SELECT s.stem, s.identity, s.frame_index, b.y, b.x, any_value(b.raw) AS raw, min((b.y-s.y)**2+(b.x-s.x)**2) AS d2 FROM s JOIN bk b ON b.stem=s.stem AND b.frame_index=s.frame_index AND b.identity IS NULL AND (b.y-s.y)**2+(b.x-s.x)**2<=9 GROUP BY 1,2,3,4,5), g AS (SELECT stem, identity, frame_index, median(raw) AS background_median FROM f WHERE d2>1 GROUP BY 1,2,3)
 SELECT v.*, background_median, signal_mean-background_median AS corrected_mean FROM v JOIN g USING (stem, identity, frame_index)""",
    "signal_mean background_median corrected_mean",
)
def _(i):
    return _gap_audit(i)[1]
