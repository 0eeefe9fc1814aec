"""Operator 6, URL filter: rules by host and path, then a blocked Bloom filter with an exact join behind it.

A listed URL blocks every page with the same canonical URL: scheme, fragment, `www.` and `m.`, tracking parameters, the
last slash and `.html` do not count. A blocked Bloom filter over the list, of fixed size whatever the list's, passes
possible hits; only those are joined with the list itself, by the canonical text, which removes false positives. A
filter too full to help passes more pages to the join and changes no verdict.

Rules come first: a rule fits its host and subdomains if the path starts with the rule's path; the longest wins (of two
as long, the one given first).

Null URLs and those without `://` have an empty host and path and are allowed. Repeated rows are judged alike. Empty
lists block nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsegrid.llm.common import blocked_bloom, bloom_hits

Rule = tuple[str, str, str]  # verdict, host, path
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host and path without what does not change the page, and the query without tracking parameters."""
    host = F.regexp_replace(host_of(url), r"^(?:www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"(?:/|\.html)$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: ~p.rlike("^(?:utm_|ref=)") & (p != "")), "&")
    return F.coalesce(F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The number of the longest rule that fits, or null."""
    found = F.lit(None).cast("int")
    for i in sorted(range(len(rules)), key=lambda i: (len(rules[i][1] + rules[i][2]), -i)):
        _, h, p = rules[i]
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.lit(i)).otherwise(found)
    return found


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[Rule], id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """page_id, host, path, rule and verdict for every row of pages. listed: one string column of canonical URLs."""
    spark = pages.sparkSession
    listed = listed.select(F.col(listed.columns[0]).alias("c")).where("c <> ''").where(~F.col("c").startswith("\n")).distinct()
    shipped = spark.sparkContext.broadcast(blocked_bloom(listed.select(F.xxhash64("c"))))

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = bloom_hits(shipped.value, batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(hit)], names=[*batch.schema.names[:-1], "possible"])

    url = F.col("url")
    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"))
    rows = rows.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("c"))
    rows = rows.withColumn("rule_no", rule_of(F.col("host"), F.col("path"), rules)).withColumn("hash", F.xxhash64("c"))
    kind = dict(rows.dtypes)
    rows = rows.mapInArrow(possible, f"page_id {kind['page_id']}, host string, path string, c string, rule_no int, possible boolean")
    # only a possible hit that no rule decides looks for its URL; the others get keys that find nothing and spread over tasks
    nothing = F.concat(F.lit("\n"), F.xxhash64("page_id", "host", "path").cast("string"))
    wanted = F.when(F.col("possible") & F.col("rule_no").isNull(), F.col("c")).otherwise(nothing)
    joined = rows.withColumn("wanted", wanted).join(listed.select(F.col("c").alias("listed")), F.col("wanted") == F.col("listed"), "left")
    names = F.array(*[F.lit(h + p) for _, h, p in rules])
    verdicts = F.array(*[F.lit(v) for v, _, _ in rules])
    at = F.col("rule_no") + 1
    rule = F.when(F.col("rule_no").isNotNull(), F.element_at(names, at)) if rules else F.lit(None).cast("string")
    by_rule = F.when(F.col("rule_no").isNotNull(), F.element_at(verdicts, at)) if rules else F.lit(None).cast("string")
    verdict = F.coalesce(by_rule, F.when(F.col("listed").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return joined.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


#: Host labels that put a page's URL on the list.
FLAGGED = ("adult", "ads", "track", "casino", "spam", "malware", "phish")


def flagged_urls(pages: DataFrame, url_column: str = "url") -> DataFrame:
    """Canonical URLs of pages whose host has a flagged word among its labels: a list that Spark derives from a crawl."""
    url = F.col(url_column)
    return pages.where(host_of(url).rlike(rf"(?:^|[.-])(?:{'|'.join(FLAGGED)})(?:[.-]|$)")).select(canonical(url).alias("c")).distinct()
