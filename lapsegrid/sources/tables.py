"""Readers and writers of observation tables."""

from __future__ import annotations

import fnmatch
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from lapsegrid.functions.numeric import clean_doubles

STAMP = ["stem", "condition", "subject"]


@dataclass(frozen=True)
class TableSpec:
    """What a row of a table is, and which columns it must carry."""

    name: str
    grain: tuple[str, ...]
    schema: T.StructType | None = None
    fold: bool = False
    roles: dict[str, tuple[str, ...]] = field(default_factory=dict)


class GrainError(ValueError):
    """A key is missing or repeated."""


def grain_violations(df: DataFrame, grain: Sequence[str]) -> DataFrame:
    """Keys that are null or repeated, with how often they occur."""
    bad = F.greatest(*[F.col(k).isNull().cast("int") for k in grain], F.lit(0)) == 1
    return df.groupBy(*grain).agg(F.count(F.lit(1)).alias("rows")).where((F.col("rows") > 1) | bad)


def check_grain(df: DataFrame, grain: Sequence[str]) -> DataFrame:
    """Refuse a table whose keys are null or repeated."""
    first = grain_violations(df, grain).first()
    if first is not None:
        raise GrainError(f"grain {tuple(grain)} violated, e.g. {first.asDict()}")
    return df


def read_table(spark: SparkSession, path: str, spec: TableSpec | None = None) -> DataFrame:
    """A saved measurement table, Parquet or CSV by its extension, NaN and infinities as NULL."""
    reader = spark.read if spec is None or spec.schema is None else spark.read.schema(spec.schema)
    df = reader.csv(path, header=True, inferSchema=spec is None or spec.schema is None) if path.endswith(".csv") else reader.parquet(path)
    return clean_doubles(df)


def read_trace_csv(spark: SparkSession, path: str, time_column: str = "hours", offset_h: float = 0.0) -> DataFrame:
    """Wide trace file: one time column and one column per trace, ``#`` lines skipped."""
    raw = spark.read.csv(path, header=True, comment="#", encoding="UTF-8")
    names = [c.lstrip("\ufeff").strip() for c in raw.columns]
    numbers = raw.toDF(*names).select(*[F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in names])
    return clean_doubles(numbers.withColumn(time_column, F.col(time_column) + F.lit(offset_h)))


def trace_panels(df: DataFrame, pattern: str = "*", time_column: str = "hours") -> DataFrame:
    """Columns matching a glob, one panel each, in long form."""
    chosen = [c for c in df.columns if c != time_column and fnmatch.fnmatch(c, pattern)]
    if not chosen:
        raise ValueError(f"no column matches {pattern!r}")
    slim = df.select(time_column, *[F.col(c).cast("double").alias(c) for c in chosen])
    return slim.unpivot([time_column], chosen, "panel", "value")


def load_sources(spark: SparkSession, entries: Sequence[str], time_column: str = "hours", offset_h: float = 0.0) -> DataFrame:
    """Several ``NAME=path`` trace files as one long table with a source column."""
    out = None
    for entry in entries:
        name, _, path = entry.partition("=")
        if not path:
            raise ValueError(f"expected NAME=path, got {entry!r}")
        part = trace_panels(read_trace_csv(spark, path, time_column, offset_h), "*", time_column).withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no source named")
    return out


def side_table(raw: DataFrame, name: str, key: str, known: DataFrame, taken: Sequence[str], frame_offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """User table keyed on one number: unusable keys dropped, columns prefixed, repeated keys and name clashes
    refused. The second result counts matched, unmatched and dropped keys."""
    number = F.expr(f"try_cast(`{key}` AS double)")
    whole = number.isNotNull() & (number == F.floor(number))
    keyed = raw.withColumn("__key", F.when(whole, number.cast("long") - F.lit(frame_offset)))
    usable = keyed.where(F.col("__key").isNotNull())
    renamed = usable.select(F.col("__key").alias(key), *[F.col(c).alias(f"{name}_{c}") for c in raw.columns if c != key])
    clash = sorted((set(renamed.columns) - {key}) & set(taken))
    if clash:
        raise ValueError(f"side table {name} would overwrite {clash}")
    check_grain(renamed, [key])
    marked = keyed.select("__key").join(
        known.select(F.col(key).cast("long").alias("__key"), F.lit(True).alias("__known")).distinct(), "__key", "left"
    )
    audit = marked.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col("__key").isNull().cast("long")).alias("unusable_keys"),
        F.sum(F.coalesce(F.col("__known"), F.lit(False)).cast("long")).alias("matched_keys"),
        F.sum((F.col("__key").isNotNull() & F.col("__known").isNull()).cast("long")).alias("unmatched_keys"),
    )
    return renamed, audit


def read_conditions(spark: SparkSession, path: str, key: str = "recording") -> DataFrame:
    """Recording conditions: one row per recording, every other column a factor; file extensions ignored."""
    df = spark.read.csv(path, header=True)
    factors = [c for c in df.columns if c != key]
    long = df.unpivot([key], factors, "factor", "level")
    out = long.select(F.regexp_replace(F.col(key), r"\.[A-Za-z0-9]{1,5}$", "").alias("stem"), "factor", "level")
    check_grain(out, ["stem", "factor"])
    return out


def read_batch(spark: SparkSession, paths: Sequence[str], design: DataFrame | None = None) -> DataFrame:
    """Many recordings as one table; the recording is the folder a file came from."""
    df = spark.read.parquet(*paths).withColumn("stem", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))
    return df if design is None else df.join(design, "stem", "left")


def table_availability(tables: dict[str, DataFrame]) -> DataFrame:
    """Which table holds how many rows of which recording."""
    out = None
    for name, df in sorted(tables.items()):
        part = df.groupBy("stem").agg(F.count(F.lit(1)).alias("rows")).withColumn("table", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def read_decision_tables(spark: SparkSession, paths: dict[str, str]) -> tuple[dict[str, DataFrame], list[tuple[str, str]]]:
    """Pass named CSV tables through, with a record of which could be read."""
    found, record = {}, []
    for name, path in sorted(paths.items()):
        try:
            found[name] = spark.read.csv(path, header=True, inferSchema=True)
            record.append((name, "read"))
        except AnalysisException as error:  # absence is a result here, other faults are not
            record.append((name, "absent" if error.getCondition() == "PATH_NOT_FOUND" else "unreadable"))
    return found, record


def frame_clock(recordings: DataFrame, acquired: DataFrame | None = None) -> DataFrame:
    """Every frame of a recording: index, 1-based label, source index, hours by cadence or by acquisition."""
    grid = recordings.withColumn("frame_index", F.explode(F.sequence(F.lit(0), F.col("n_frames") - 1)))
    by_cadence = F.col("frame_index") * F.col("minutes_per_frame") / 60.0
    if acquired is not None:
        grid = grid.join(acquired, ["stem", "frame_index"], "left")
    hours = F.coalesce(F.col("acquired_hours"), by_cadence) if acquired is not None else by_cadence
    return grid.select(
        "stem", "frame_index", (F.col("frame_index") + 1).alias("frame_label"),
        (F.col("frame_index") + F.col("source_frame_offset")).alias("source_frame_index"), hours.alias("hours"),
    )


def preview(rows: DataFrame, entity: Sequence[str], time: str, entities: int = 32, points: int = 450) -> DataFrame:
    """Bounded look at a recording: the first entities, each thinned by the smallest power-of-two stride that
    leaves at most ``points`` rows. Thinning is what this operator is for."""
    from lapsegrid.plans.scan import frame_bucket, numbered

    chosen = rows.groupBy(*entity).agg(F.count(F.lit(1)).alias("__n")).orderBy(*entity).limit(entities)
    stride = F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.ceil(F.log2(F.col("__n") / F.lit(float(points)))))).cast("long")
    kept = numbered(rows.join(chosen, list(entity)), entity, [time], frame_bucket(time), "__rn")
    return kept.withColumn("stride", stride).where(F.pmod(F.col("__rn") - 1, F.col("stride")) == 0).drop("__rn", "__n")


def stamped(df: DataFrame, recordings: DataFrame) -> DataFrame:
    """Put recording, condition and subject in front of a table."""
    rest = [c for c in df.columns if c not in STAMP]
    return df.drop("condition", "subject").join(recordings.select(*STAMP), "stem", "left").select(*STAMP, *rest)


def write_stamped(df: DataFrame, recordings: DataFrame, path: str) -> None:
    stamped(df, recordings).write.mode("errorifexists").partitionBy("stem").parquet(path)


def nested_as_text(df: DataFrame) -> DataFrame:
    """Nested columns as JSON, for a CSV sink; Parquet keeps them typed."""
    return df.select(
        *[
            F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def text_as_nested(df: DataFrame, types: dict[str, T.DataType]) -> DataFrame:
    return df.select(*[F.from_json(c, types[c]).alias(c) if c in types else F.col(c) for c in df.columns])


def merge_index(index: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Append summary rows, replacing those with the same key."""
    return index.join(rows.select(*key), list(key), "left_anti").unionByName(rows, allowMissingColumns=True)


def scale_length(value: Column, um_per_px: Column) -> Column:
    """Pixels to microns where the recording is calibrated."""
    return F.when(um_per_px > 0, value * um_per_px).otherwise(value)


def scale_area(value: Column, um_per_px: Column) -> Column:
    return F.when(um_per_px > 0, value * um_per_px * um_per_px).otherwise(value)


def scale_speed(px_per_frame: Column, um_per_px: Column, minutes_per_frame: Column) -> Column:
    per_hour = F.lit(60.0) / minutes_per_frame
    return F.when(minutes_per_frame > 0, scale_length(px_per_frame, um_per_px) * per_hour)
