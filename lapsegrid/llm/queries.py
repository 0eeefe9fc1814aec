"""The registered queries of the training-data operators: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsegrid.llm import ann, decontaminate, filter_audit, id_files, packing, pii, prefix_trie, quality, sharding, simhash, suffix_dedup, url_filter
from lapsegrid.llm import pieces as piece_models
from lapsegrid.llm.common import map_texts, slices, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = id_files.write_ids(table(spark, sf_dir, "documents"))
    return id_files.read_documents(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


TREE = sharding.cluster(16)
LARGER = sharding.grown(TREE, 16)


def op2_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard_documents(table(spark, sf_dir, "documents"), TREE, LARGER)
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_repetition_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repetition_quality(table(spark, sf_dir, "documents")).drop("repeat_spans", "longest_repeat")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.personal_data(docs, pii.fit_on(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


RULES: list[url_filter.Rule] = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.filter_urls(pages, url_filter.flagged_urls(pages), RULES)


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def work(texts: list) -> list[pa.Array]:
        model = piece_models.pieces("piece_bpe_32k.model")
        ids = model.encode(texts)
        written = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in ids]
        decoded = [hashlib.sha256(t.encode()).hexdigest() for t in model.decode(ids)]
        return [pa.array([len(x) for x in ids], pa.int64()), pa.array(written, pa.string()), pa.array(decoded, pa.string())]

    docs = table(spark, sf_dir, "documents")
    return map_texts(docs, [F.col("doc_id").cast("long"), F.col("text")], work, schema)


def op8_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = suffix_dedup.with_spans(docs)
    marked = marked.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("b"), "__spans")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            made = []
            for data, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                gone, kept, done = suffix_dedup.united(spans), [], 0
                for lo, hi in gone:
                    kept.append(data[done:lo])
                    done = hi
                left = b"".join([*kept, data[done:]])
                # the digest is that of the bytes; in the text, what is left of a character cut in part goes
                made.append((len(data), sum(hi - lo for lo, hi in gone), len(gone), hashlib.sha256(left).hexdigest(), left.decode(errors="ignore")))
            cols = list(zip(*made, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], names=[f.split()[0] for f in schema.split(", ")])

    return marked.mapInArrow(run, schema)


def op9_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", listed, (F.col("n_hit") > 0).alias("contaminated"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations")).drop("key")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_id_files, op2_hash_tree, op3_packing, op4_repetition_quality, op5_personal_data, op6_url_filter, op7_pieces, op8_simhash_components,
        op9_forest, op10_suffix_dedup, op11_decontamination, op12_filter_audit, op13_prefix_trie,
    )
}


def _windows(name: str, size: int) -> str:
    """Positions of words in windows of `size` words that the document holds at least twice."""
    return f"""
{name}_all AS (SELECT doc_id, i, n, string_agg(x, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {size - 1} FOLLOWING) AS s FROM words),
{name}_seen AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM {name}_all WHERE i <= n - {size - 1}),
{name} AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {size})) AS p FROM {name}_seen WHERE n > 1) GROUP BY doc_id)"""


_RULES = quality.RepetitionRules()
_HOST = r"translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
_QUERY = r"regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1)"
_FLAGS = "|".join(url_filter.FLAGGED)


def _rule_sql(value: int) -> str:
    """The rule that fits (or its verdict), longest first."""
    found = "NULL"
    for verdict, host, path in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        result = (verdict, host + path)[value]
        found = f"CASE WHEN (host = '{host}' OR host LIKE '%.{host}') AND starts_with(path, '{path}') THEN '{result}' ELSE {found} END"
    return found


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_KEY = "coalesce(CAST(doc_id AS VARCHAR), 'null')"

#: Where SQL can say the whole answer. Tokenizers, XXH64 fingerprints, boosted trees and packing
#: have none, and windows of 400 bytes are too slow in SQL on whole tables: those queries are tested against brute force.
SQL: dict[str, str] = {
    "op2_hash_tree": f"""
WITH RECURSIVE step AS (
  SELECT i, 0 AS k, i AS c FROM (SELECT unnest(range(256)) AS i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8
),
crc AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, {sharding.descend_sql(_KEY, TREE)} AS shard, {sharding.descend_sql(_KEY, LARGER)} AS grown_shard FROM documents),
b AS (SELECT *, len(h) // 2 + 1 AS size, list_transform(range(len(h) // 2), lambda i: CAST('0x' || h[2 * i + 1:2 * i + 2] AS BIGINT)) AS bytes FROM d),
c AS (SELECT b.*, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) AS text_crc32 FROM b, crc)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS LAST, size, text_crc32) - 1 AS slot, grown_shard FROM c
""",
    "op4_repetition_quality": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id
),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i, len(w) AS n FROM d),{_windows("eight", 8)},{_windows("least", _RULES.min_words)},{_windows("longer", _RULES.most_longest + 1)},
f AS (
  SELECT d.doc_id, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars, len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(lines.n, 0) AS n_dup_lines, coalesce(eight.n, 0) AS n_repeat_words, coalesce(least.n, 0) AS covered_words, longer.n IS NOT NULL AS too_long
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN eight USING (doc_id) LEFT JOIN least USING (doc_id) LEFT JOIN longer USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND covered_words <= {_RULES.most_covered} * n_words AND NOT too_long AS kept
FROM f
""",
    "op6_url_filter": f"""
WITH u AS (SELECT page_id, url, coalesce({_HOST}, '') AS host, coalesce({_PATH}, '') AS path FROM pages),
c AS (
  SELECT *, regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '(/|\\.html)$', '') AS place,
    array_to_string(list_filter(string_split({_QUERY}, '&'), lambda p: NOT regexp_matches(p, '^(utm_|ref=)') AND p <> ''), '&') AS q FROM u
),
k AS (SELECT *, coalesce(place || CASE WHEN q <> '' THEN '?' || q ELSE '' END, '') AS canonical FROM c),
l AS (SELECT DISTINCT canonical FROM k WHERE regexp_matches(host, '(^|[.-])({_FLAGS})([.-]|$)') AND canonical <> '')
SELECT page_id, host, path, {_rule_sql(1)} AS rule, coalesce({_rule_sql(0)}, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM k LEFT JOIN l USING (canonical)
""",
    "op11_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM benchmark),
s AS (SELECT item, w, least(len(w), 10) AS size FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM s)),
x AS (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM g) WHERE len(w) >= size),
h AS (SELECT r, item, i, size FROM (SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS gram FROM x) JOIN g USING (size, gram)),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM h) GROUP BY r),
m AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r)
""",
    "op12_filter_audit": """
WITH RECURSIVE t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM t),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, good, toxic, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * len(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS mask
  FROM w LEFT JOIN l USING (doc_id)
),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY ALL),
o AS (SELECT '' AS o, 0 AS k UNION ALL SELECT o || x, k + 1 FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE k < 5 AND NOT contains(o, x)),
s AS (SELECT o AS filter_order, step, o[step] AS x FROM o, (SELECT unnest(range(1, 6)) AS step) WHERE k = 5),
a AS (
  SELECT part, filter_order, step, x,
    sum(CASE WHEN translate(filter_order[1:step], mask, '') = filter_order[1:step] THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN contains(mask, x) AND translate(filter_order[1:step - 1], mask, '') = filter_order[1:step - 1] THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN contains(mask, x) AND translate(filter_order[1:step - 1], mask, '') <> filter_order[1:step - 1] THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = x THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN contains(mask, x) AND translate(filter_order[1:step - 1], mask, '') = filter_order[1:step - 1] THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN contains(mask, x) AND translate(filter_order[1:step - 1], mask, '') = filter_order[1:step - 1] THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM a
""",
    "op13_prefix_trie": """
WITH RECURSIVE step AS (
  SELECT i, 0 AS k, i AS c FROM (SELECT unnest(range(256)) AS i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8
),
crc AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, sha256(len(role) || ':' || role || text) AS x, len(text) AS size FROM r),
c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
    xor(list_reduce(list_prepend(4294967295, list_transform(range(len(CAST(conv_id AS VARCHAR))), lambda j: CAST(ascii(CAST(conv_id AS VARCHAR)[j + 1:j + 1]) AS BIGINT))),
      lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM o), crc
),
p AS (SELECT c.conv_id, o.i, o.x, o.size FROM c JOIN o ON o.conv_id = c.base AND o.i <= h UNION ALL SELECT c.conv_id, o.i, o.x, o.size FROM c JOIN o ON o.conv_id = c.conv_id AND o.i > h),
q AS (SELECT c.conv_id, coalesce(list(x ORDER BY i) FILTER (WHERE x IS NOT NULL), []) AS path, coalesce(list(size ORDER BY i) FILTER (WHERE x IS NOT NULL), []) AS sizes FROM c LEFT JOIN p USING (conv_id) GROUP BY c.conv_id),
e AS (SELECT conv_id, unnest(range(len(path) + 1)) AS d, path, sizes FROM q),
n AS (
  SELECT path[1:d] AS pre, d, min(conv_id) AS conv_id, count(*) AS n_convs, CASE WHEN d > 0 THEN any_value(sizes[d]) ELSE 0 END AS size,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(path) = d), '')) AS ends_sha256
  FROM e GROUP BY pre, d
),
k AS (SELECT pre[1:d - 1] AS pre, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (pre)),
u AS (SELECT pre[1:j] AS pre, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * size) AS saved FROM (SELECT *, unnest(range(d + 1)) AS j FROM v) GROUP BY ALL)
SELECT v.conv_id, v.d AS depth, above.conv_id AS parent_conv_id, v.n_convs, v.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, v.ends_sha256
FROM v JOIN u USING (pre) LEFT JOIN v AS above ON v.d > 0 AND above.pre = v.pre[1:v.d - 1]
""",
}
