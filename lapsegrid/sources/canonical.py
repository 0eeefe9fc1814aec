"""Canonical inputs derived from the shared tables.

Every derivation is a Spark plan over the whole table it starts from; the SQL twins below are used only
as the reference answers of the correctness check. Values are summed in integer cents so both engines
get the same double bit for bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lapsegrid.plans.durable import cut

ORIGIN = "2024-01-01 00:00:00"
FIELD_HEIGHT, FIELD_WIDTH = 15, 20


def clock_of(rows: DataFrame) -> DataFrame:
    """(stem, n_frames): each recording's clock runs from frame 0 to the last frame in the data."""
    return rows.groupBy("stem").agg((F.max("frame_index") + 1).cast("int").alias("n_frames"))


class Inputs:
    """Lazy access to the tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._kept: dict[str, DataFrame] = {}

    def kept(self, name: str, build) -> DataFrame:
        """A derived table that several branches of one query read: written once to the shared folder."""
        if name not in self._kept:
            self._kept[name] = cut(build())
        return self._kept[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def events(self) -> DataFrame:
        """Raw observations on irregular clocks: hours since the origin, value in cents."""
        micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit(ORIGIN).cast("timestamp"))
        return self.table("events").select(
            F.col("event_type").alias("stem"),
            F.col("user_id").alias("identity"),
            F.col("event_id"),
            micros.alias("micros"),
            (micros / F.lit(3.6e9)).alias("hours"),
            F.round(F.col("value") * 100).cast("long").alias("cents"),
            F.col("value"),
        )

    def _observations(self, stem, hours_per_frame: int) -> DataFrame:
        frame = F.floor(F.col("micros") / F.lit(hours_per_frame * 3_600_000_000)).cast("int")
        return (
            self.events()
            .groupBy(stem.alias("stem"), "identity", frame.alias("frame_index"))
            .agg(F.sum("cents").alias("__cents"), F.count(F.lit(1)).alias("__n"))
            .select(
                "stem",
                "identity",
                "frame_index",
                (F.col("frame_index") * F.lit(float(hours_per_frame))).alias("hours"),
                (F.col("__cents").cast("double") / (F.col("__n") * 100)).alias("signal"),
                F.col("__n").cast("double").alias("activity"),
            )
        )

    def daily(self) -> DataFrame:
        """Entity x day, one recording per event type; most entities have real gaps."""
        return self._observations(F.col("stem"), 24)

    def traces(self) -> DataFrame:
        """Entity x six-hour frame over all event types, one recording."""
        return self._observations(F.lit("all"), 6)

    def recordings(self) -> DataFrame:
        """One row per recording; its clock ends with the last day that holds an event."""
        return clock_of(self.daily()).withColumn("minutes_per_frame", F.lit(1440.0))

    def pixels(self) -> DataFrame:
        """Occupancy rows: parts are places (300 to a field), quarters are frames, the first line item of a
        place and frame decides its owner. Background places have no identity."""
        place = F.col("l_partkey") % 300
        frame = (F.year("l_shipdate") - 1995) * 4 + F.quarter("l_shipdate") - 1
        first = F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
        row = F.struct("l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
        owner = F.col("r.l_returnflag") != "N"
        return (
            self.table("lineitem")
            .groupBy(
                F.concat(F.lit("F"), F.floor(F.col("l_partkey") / 300).cast("string")).alias("stem"),
                frame.cast("int").alias("frame_index"),
                F.floor(place / FIELD_WIDTH).cast("int").alias("y"),
                (place % FIELD_WIDTH).cast("int").alias("x"),
            )
            .agg(F.min_by(row, first).alias("r"))
            .select(
                "stem",
                "frame_index",
                "y",
                "x",
                F.when(owner, F.col("r.l_suppkey") % 12 + 1).alias("identity"),
                F.col("r.l_quantity").alias("raw"),
                (~owner & (F.col("r.l_linestatus") == "O")).alias("unclaimed"),
                (F.col("r.l_discount") > 0.08).alias("inferred"),
                (F.col("r.l_tax") > 0.07).alias("unresolved"),
                (F.col("r.l_returnflag") == "R").alias("added"),
            )
        )

    def masks(self) -> DataFrame:
        """Pixels that belong to an entity."""
        return self.pixels().where(F.col("identity").isNotNull())

    def tracks(self) -> DataFrame:
        return self.kept("tracks", self._tracks)

    def _tracks(self) -> DataFrame:
        """Entity x frame positions: mask centroid and area."""
        return (
            self.masks()
            .groupBy("stem", "identity", "frame_index")
            .agg(
                (F.sum("y").cast("double") / F.count(F.lit(1))).alias("y"),
                (F.sum("x").cast("double") / F.count(F.lit(1))).alias("x"),
                F.count(F.lit(1)).cast("double").alias("area_px"),
                (F.sum("raw") / F.count(F.lit(1))).alias("mean_raw"),
            )
            .withColumn("hours", F.col("frame_index") * F.lit(0.5))
        )


# --- SQL twins -------------------------------------------------------------------------------------


def clock_sql(rows: str) -> str:
    return f"(SELECT stem, CAST(max(frame_index) + 1 AS INTEGER) AS n_frames FROM {rows} GROUP BY 1)"


EVENTS_SQL = """ev AS (SELECT event_type AS stem, user_id AS identity, event_id,
  epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00') AS micros,
  (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00'))/3.6e9::DOUBLE AS hours,
  CAST(round(value*100) AS BIGINT) AS cents, value FROM events)"""


def _obs_sql(name: str, stem: str, hours: int) -> str:
    return f"""{name} AS (SELECT stem, identity, frame_index, frame_index*{hours}.0::DOUBLE AS hours,
  CAST(c AS DOUBLE)/(n*100) AS signal, CAST(n AS DOUBLE) AS activity FROM (
  SELECT {stem} AS stem, identity, CAST(micros // {hours * 3_600_000_000} AS INTEGER) AS frame_index,
  CAST(sum(cents) AS BIGINT) AS c, count(*) AS n FROM ev GROUP BY 1,2,3))"""


DAILY_SQL = EVENTS_SQL + ",\n" + _obs_sql("obs", "stem", 24)
TRACES_SQL = EVENTS_SQL + ",\n" + _obs_sql("tr", "'all'", 6)
PIXELS_SQL = """px AS (SELECT stem, frame_index, y, x,
  CASE WHEN r.l_returnflag <> 'N' THEN r.l_suppkey % 12 + 1 END AS identity, r.l_quantity AS raw,
  (r.l_returnflag = 'N' AND r.l_linestatus = 'O') AS unclaimed, r.l_discount > 0.08 AS inferred,
  r.l_tax > 0.07 AS unresolved, r.l_returnflag = 'R' AS added FROM (
  SELECT 'F' || CAST(l_partkey // 300 AS VARCHAR) AS stem,
  CAST((year(l_shipdate)-1995)*4 + quarter(l_shipdate) - 1 AS INTEGER) AS frame_index,
  CAST((l_partkey % 300) // 20 AS INTEGER) AS y, CAST((l_partkey % 300) % 20 AS INTEGER) AS x,
  first({'l_suppkey': l_suppkey, 'l_quantity': l_quantity, 'l_discount': l_discount, 'l_tax': l_tax,
  'l_returnflag': l_returnflag, 'l_linestatus': l_linestatus}
  ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS r
  FROM lineitem GROUP BY 1,2,3,4)),
mk AS (SELECT * FROM px WHERE identity IS NOT NULL)"""
TRACKS_SQL = PIXELS_SQL + """,
tk AS (SELECT stem, identity, frame_index, CAST(sum(y) AS DOUBLE)/count(*) AS y, CAST(sum(x) AS DOUBLE)/count(*) AS x,
  CAST(count(*) AS DOUBLE) AS area_px, sum(raw)/count(*) AS mean_raw, frame_index*0.5::DOUBLE AS hours
  FROM mk GROUP BY 1,2,3)"""
