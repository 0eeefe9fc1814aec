"""Three-valued cohort filters, experimental design assignment and audits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

COMPARATORS = ("lt", "lte", "eq", "neq", "gte", "gt", "between", "not_between")


def compare(actual: Column, how: str, target) -> Column:
    """Comparison of a fact with a target; a NULL fact is unknown, never false."""
    if how == "between":
        return actual.between(*[F.lit(t) for t in target])
    if how == "not_between":
        return ~actual.between(*[F.lit(t) for t in target])
    other = F.lit(target)
    table = {
        "lt": actual < other, "lte": actual <= other, "eq": actual == other,
        "neq": actual != other, "gte": actual >= other, "gt": actual > other,
    }
    if how not in table:
        raise ValueError(f"unknown comparator {how}")
    return table[how]


def compile_rule(rule: dict) -> Column:
    """A nested rule as one boolean column. SQL's AND, OR and NOT already follow Kleene's tables; XOR of any
    unknown is unknown."""
    op = rule.get("op")
    if op is None:
        return compare(F.col(rule["field"]), rule["cmp"], rule.get("value"))
    parts = [compile_rule(r) for r in rule["args"]]
    if op == "not":
        if len(parts) != 1:
            raise ValueError("not takes one rule")
        return ~parts[0]
    if not parts:
        raise ValueError(f"{op} needs at least one rule")
    if op == "and":
        return reduce(lambda a, b: a & b, parts)
    if op == "or":
        return reduce(lambda a, b: a | b, parts)
    if op == "xor":
        return F.pmod(reduce(lambda a, b: a + b, [p.cast("int") for p in parts]), F.lit(2)) == 1
    raise ValueError(f"unknown operator {op}")


def leaves(rule: dict) -> list[dict]:
    return [rule] if "op" not in rule else [leaf for r in rule["args"] for leaf in leaves(r)]


def cohort(facts: DataFrame, rule: dict, mode: str = "keep", unknown: str = "exclude") -> DataFrame:
    """Every entity with its truth value, the evidence of each leaf rule, and whether it stays.

    ``mode`` keeps or excludes what the rule matches; ``unknown`` says what an undecided entity does:
    ``keep``, ``exclude`` or ``error``.
    """
    if mode not in ("keep", "exclude") or unknown not in ("keep", "exclude", "error"):
        raise ValueError("bad mode or unknown policy")
    missing = sorted({leaf["field"] for leaf in leaves(rule)} - set(facts.columns))
    if missing:
        raise ValueError(f"unknown facts {missing}")
    truth = compile_rule(rule)
    decided = truth if mode == "keep" else ~truth
    if unknown == "error":
        kept = F.when(truth.isNull(), F.raise_error(F.lit("undecided entity"))).otherwise(decided)
    else:
        kept = F.coalesce(decided, F.lit(unknown == "keep"))
    evidence = {f"rule_{n}": compile_rule(leaf) for n, leaf in enumerate(leaves(rule), 1)}
    return facts.withColumns(evidence).withColumn("matched", truth).withColumn("kept", kept)


def event_fact(entities: DataFrame, keys: Sequence[str], events: DataFrame | None, alias: str) -> DataFrame:
    """Whether an entity has an event. Without a saved event table the answer is unknown, not false."""
    if events is None:
        return entities.withColumn(alias, F.lit(None).cast("boolean"))
    hit = events.select(*keys).distinct().withColumn("__hit", F.lit(True))
    return entities.join(hit, list(keys), "left").withColumn(alias, F.coalesce("__hit", F.lit(False))).drop("__hit")


def assign_levels(texts: DataFrame, key: str, text: str, factors: dict[str, dict[str, str]], declared: DataFrame | None = None) -> DataFrame:
    """Factor level of each text by pattern: one hit derives, none is unassigned, more is ambiguous; a declared
    level wins. Patterns are a short declared list, so they are expressions on the row."""
    long = []
    for factor, patterns in factors.items():
        hits = F.array_compact(F.array(*[F.when(F.col(text).rlike(p), F.lit(level)) for level, p in patterns.items()]))
        long.append(F.struct(F.lit(factor).alias("factor"), hits.alias("hits")))
    rows = texts.select(key, F.inline(F.array(*long)))
    if declared is not None:
        rows = rows.join(declared.select(key, "factor", F.col("level").alias("__declared")), [key, "factor"], "left")
    else:
        rows = rows.withColumn("__declared", F.lit(None).cast("string"))
    n = F.size("hits")
    return rows.select(
        key, "factor",
        F.coalesce("__declared", F.when(n == 1, F.col("hits")[0])).alias("level"),
        F.when(F.col("__declared").isNotNull(), F.lit("declared")).when(n == 1, F.lit("derived"))
        .when(n == 0, F.lit("unassigned")).otherwise(F.lit("ambiguous")).alias("status"),
        n.cast("long").alias("hits"),
    )


def design_audit(assigned: DataFrame, factors: dict[str, dict[str, str]], controls: dict[str, str]) -> DataFrame:
    """Findings on a design: patterns no recording uses, groups of one, factors with a single group, and factors
    without their control."""
    spark = assigned.sparkSession
    declared = spark.createDataFrame(
        [(f, level, controls.get(f)) for f, levels in factors.items() for level in levels], "factor string, level string, control string"
    )
    counts = assigned.where(F.col("level").isNotNull()).groupBy("factor", "level").agg(F.count(F.lit(1)).alias("recordings"))
    both = declared.join(counts, ["factor", "level"], "left").withColumn("recordings", F.coalesce("recordings", F.lit(0).cast("long")))
    per_factor = both.groupBy("factor").agg(
        F.sum((F.col("recordings") > 0).cast("long")).alias("groups"),
        F.max(((F.col("level") == F.col("control")) & (F.col("recordings") > 0)).cast("int")).alias("has_control"),
    )
    unused = both.where(F.col("recordings") == 0).select("factor", "level", F.lit("unused_pattern").alias("finding"))
    single = both.where(F.col("recordings") == 1).select("factor", "level", F.lit("single_recording").alias("finding"))
    nolevel = F.lit(None).cast("string").alias("level")
    one = per_factor.where(F.col("groups") == 1).select("factor", nolevel, F.lit("single_group").alias("finding"))
    uncontrolled = per_factor.where(F.coalesce(F.col("has_control"), F.lit(0)) == 0).select("factor", nolevel, F.lit("no_control").alias("finding"))
    return unused.unionByName(single).unionByName(one).unionByName(uncontrolled)


def cell_over_recording(rows: DataFrame, cell_levels: DataFrame, recording_levels: DataFrame) -> DataFrame:
    """Condition of an entity: its own where declared, else its recording's."""
    return (
        rows.join(cell_levels.select("stem", "identity", F.col("level").alias("__c")), ["stem", "identity"], "left")
        .join(recording_levels.select("stem", F.col("level").alias("__r")), "stem", "left")
        .withColumn("condition", F.coalesce("__c", "__r")).drop("__c", "__r")
    )


def parse_id_list(df: DataFrame, key: str, text: str, maximum: int = 2**53 - 1, most: int = 100_000) -> DataFrame:
    """``1, 5; 10-20`` as one row per id. What is not a positive id or a rising range within the bounds is a row
    with a NULL id and the refused part; nothing is dropped.

    Commas, semicolons and blanks part the list. ``most`` bounds the ids of one range, as a longer one is refused.
    """
    part = F.col("part")
    lo = F.expr("try_cast(regexp_extract(part, '^([0-9]+)', 1) AS bigint)")
    hi = F.expr("try_cast(regexp_extract(part, '([0-9]+)$', 1) AS bigint)")
    parts = df.select(key, F.explode(F.split(F.col(text), r"[,;\s]+")).alias("part")).where("part <> ''").distinct()
    good = part.rlike("^[0-9]+([-–][0-9]+)?$") & lo.isNotNull() & hi.isNotNull() & (lo >= 1) & (hi >= lo) & (hi <= maximum) & (hi - lo < most)
    judged = parts.withColumn("ok", F.coalesce(good, F.lit(False)))
    named = judged.where("ok").select(key, F.explode(F.sequence(lo, hi)).alias("id"), F.lit(None).cast("string").alias("refused"))
    return named.distinct().unionByName(judged.where("NOT ok").select(key, F.lit(None).cast("long").alias("id"), part.alias("refused")))


def supported_profile(rings: DataFrame, keys: Sequence[str], n_rings: int, support: float) -> DataFrame:
    """Mean occupancy where every ring is present and the share of usable rings is enough, else NULL."""
    agg = rings.groupBy(*keys).agg(
        F.count_distinct("ring").alias("rings"), F.avg("usable").alias("support"), F.avg("occupancy").alias("__m")
    )
    good = (F.col("rings") == n_rings) & (F.col("support") >= support)
    return agg.withColumn("occupancy", F.when(good, F.col("__m"))).drop("__m")
