"""Readers and writers over the given tables: written to the shared folder by Spark and read back."""

import uuid

from pyspark.sql import functions as F

from lapsegrid.operators import extension
from lapsegrid.operators import features as V
from lapsegrid.operators import joins as J
from lapsegrid.plans.durable import shared_folder
from lapsegrid.sources import tables as T
from lapsegrid.sources.canonical import DAILY_SQL
from lapsegrid.workload.registry import query

STEMS = ["click", "error", "purchase", "signup", "view"]
_CONDITION = "CASE WHEN stem IN ('view','click') THEN 'busy' ELSE 'rare' END"


def place(i, name):
    return f"{shared_folder(i.spark)}/{name}-{uuid.uuid4().hex}"


def design(i):
    return i.recordings().select("stem", F.expr(_CONDITION).alias("condition"), F.upper("stem").alias("subject"))


@query("stamped_table_round_trip", f"WITH {DAILY_SQL} SELECT stem, {_CONDITION} AS condition, upper(stem) AS subject, identity, frame_index, hours, signal, activity FROM obs", "hours signal activity")
def _(i):
    path = place(i, "stamped")
    T.write_stamped(i.daily(), design(i), path)
    return T.read_table(i.spark, path)


@query(
    "trace_files",
    f"""WITH {DAILY_SQL}, m AS (SELECT hours, stem, avg(signal) AS s, avg(activity) AS a FROM obs GROUP BY 1,2), g AS (SELECT hours, stem FROM (SELECT DISTINCT hours FROM obs), (SELECT unnest({STEMS}) AS stem)), r AS (SELECT g.*, s, a FROM g LEFT JOIN m USING (hours, stem))
 SELECT hours+1.5 AS hours, stem AS panel, s AS value, 'signal' AS source FROM r UNION ALL SELECT hours+1.5, stem, a, 'activity' FROM r""",
    "hours value",
)
def _(i):
    entries = []
    for name in ("signal", "activity"):
        path = place(i, name)
        i.daily().groupBy("hours").pivot("stem", STEMS).agg(F.avg(name)).write.csv(path, header=True)
        entries.append(f"{name}={path}")
    return T.load_sources(i.spark, entries, offset_h=1.5)


@query("trace_panels_by_pattern", f"WITH {DAILY_SQL}, m AS (SELECT hours, stem, avg(signal) AS s FROM obs GROUP BY 1,2) SELECT g.hours, g.stem AS panel, s AS value FROM (SELECT hours, stem FROM (SELECT DISTINCT hours FROM obs), (SELECT unnest(['click','signup']) AS stem)) g LEFT JOIN m USING (hours, stem)", "hours value")
def _(i):
    path = place(i, "wide")
    i.daily().groupBy("hours").pivot("stem", STEMS).agg(F.avg("signal")).write.csv(path, header=True)
    return T.trace_panels(T.read_trace_csv(i.spark, path), "[cs]*[kp]")


@query("recording_conditions", f"WITH {DAILY_SQL}, s AS (SELECT DISTINCT stem FROM obs) SELECT stem, 'drug' AS factor, {_CONDITION} AS level FROM s UNION ALL SELECT stem, 'letters', CAST(len(stem) AS VARCHAR) FROM s")
def _(i):
    path = place(i, "conditions")
    i.recordings().select(F.concat("stem", F.lit(".tif")).alias("recording"), F.expr(_CONDITION).alias("drug"), F.length("stem").alias("letters")).write.csv(path, header=True)
    return T.read_conditions(i.spark, path)


@query("batch_of_recordings", f"WITH {DAILY_SQL} SELECT stem, identity, frame_index, signal, {_CONDITION} AS condition FROM obs", "signal")
def _(i):
    base, rows = place(i, "batch"), i.daily()
    for stem in STEMS:
        rows.where(F.col("stem") == stem).select("identity", "frame_index", "signal").write.parquet(f"{base}/{stem}")
    return T.read_batch(i.spark, [f"{base}/{s}" for s in STEMS], design(i).drop("subject"))


@query("decision_tables", "SELECT 'ids' AS name, 'read' AS status, (SELECT count(DISTINCT user_id) FROM events) AS \"rows\" UNION ALL SELECT 'gone', 'absent', NULL")
def _(i):
    path = place(i, "ids")
    i.events().select("identity").distinct().write.csv(path, header=True)
    found, record = T.read_decision_tables(i.spark, {"ids": path, "gone": path + "-not"})
    rows = [(name, status, found[name].count() if name in found else None) for name, status in record]  # a record per named file
    return i.spark.createDataFrame(rows, "name string, status string, rows long")


@query("column_groups", f"WITH {DAILY_SQL} SELECT stem, identity, frame_index, signal, activity FROM obs", "signal activity")
def _(i):
    rows = i.daily()
    return rows.select(*V.columns_for({"key": ["stem", "identity", "frame_index"], "metric": ["signal", "activity"]}, ["@key", "signal", "@metric"], rows.columns))


@query("granted_side_columns", f"WITH {DAILY_SQL} SELECT stem, identity, frame_index, hours, signal, activity, c_mktsegment AS side_segment FROM obs LEFT JOIN customer ON identity=c_custkey", "hours signal activity")
def _(i):
    side = i.table("customer").select(F.col("c_custkey").alias("identity"), F.col("c_mktsegment").alias("side_segment"), F.col("c_acctbal").alias("side_balance"))
    joined = J.fold(i.daily(), side, ["identity"])
    return J.granted(joined, ["side_segment", "side_balance"], ["side_segment"])


def _derivations():
    grain = ("stem", "identity", "frame_index")
    if "scaled_signal" not in extension.registered():
        extension.register(extension.Derivation(
            "scaled_signal", lambda df, p: {"scaled": df.select(*grain, (F.col("signal") * p["by"]).alias("scaled"))}, (T.TableSpec("scaled", grain, fold=True),), ("signal",), {"by": 2.0}))
        extension.register(extension.Derivation(
            "above_mean", lambda df, p: {"above": df.select(*grain, (F.col("scaled") > p["level"]).alias("above"))}, (T.TableSpec("above", grain, fold=True),), ("scaled",), {"level": 100.0}))
        extension.register(extension.Derivation("absent_input", lambda df, p: {}, (), ("no_such_column",)))


@query("registered_derivations", f"WITH {DAILY_SQL} SELECT *, signal*3.0 AS scaled, signal*3.0>100.0 AS above FROM obs", "hours signal activity scaled")
def _(i):
    _derivations()
    base, _tables, skipped = extension.derive(i.daily(), ["scaled_signal", "above_mean", "absent_input"], {"scaled_signal": {"by": 3.0}})
    assert skipped == {"absent_input": "needs no_such_column"}
    return base
