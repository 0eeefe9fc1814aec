"""Operator 13, conversation prefix trie by truncation peeling.

Conversations become sequences of turns; equal sequences are one row with a count. From the greatest depth upwards, the
surviving nodes and the sequences that newly end there are merged, the last turn is stripped, and what has become equal
is regrouped; a node's aggregates are complete the moment it is found, so nodes are written as they appear.

Between two depths at which no node of the table forks or ends above another, every chain just loses turns. Such chains
are stripped at once: a round goes from one depth with a fork or an inner end to the next, and a conversation of
thousands of turns of its own costs no round for them. Rounds: the number of such depths. Each round's nodes and
survivors are written to the shared folder.

A turn travels as a digest and its number of code points; a prefix is known by the chained 128-bit digest of its turns,
made along the conversation in one pass. The row of a conversation holds one digest a turn, and is one row in one task.
A popular beginning is merged by partial aggregation; its many children meet their parent by a broadcast of the popular
parents alone, of which there is at most one in `crowd` rows. The ids that end at one node are sorted over the whole cluster
by ranges, joined into pieces, and hashed piece by piece, so they are never held together.

Null role or text is empty; a null turn comes first; equal turns of one conversation are ordered by role and text digest,
and rows that repeat are turns that repeat. Rows with a null conv_id belong to no conversation. A conversation that is
left without turns ends at the root. An empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsegrid.llm.common import saved

PATH = "array<struct<key:string,size:bigint>>"
#: Ids of one piece of an end list.
PIECE = 50_000
#: Children beyond which a parent is popular.
CROWD = 20_000


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, size) of every turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    return conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.length(text).cast("long").alias("size"))


def in_order(turns: DataFrame) -> DataFrame:
    """(conv_id, path): the turns of each conversation in order."""
    key = F.struct(F.col("turn").isNotNull().alias("given"), "turn", "digest", "size")
    path = F.transform(F.sort_array(F.collect_list(key)), lambda t: F.struct(t["digest"].alias("key"), t["size"].alias("size")))
    return turns.groupBy("conv_id").agg(path.alias("path"))


def rebuilt(conversations: DataFrame, base: Column, held: Column, most: int) -> DataFrame:
    """(conv_id, path): the first `held` turns of conversation `base`, then the own turns behind the first `held`. held is at most `most`."""
    own = in_order(turns_of(conversations)).withColumn("base", base).withColumn("held", held)
    own = own.select("conv_id", "base", "held", "path")
    first = own.where(F.col("conv_id") == F.col("base")).select(F.col("conv_id").alias("base"), F.slice("path", 1, most).alias("lead"))
    lead = F.coalesce(F.slice("lead", F.lit(1), F.col("held")), F.array().cast(PATH))
    rest = F.slice("path", F.col("held") + 1, F.greatest(F.size("path") - F.col("held"), F.lit(0)))
    return own.join(first, "base", "left").select("conv_id", F.concat(lead, rest).alias("path"))


def _chained(paths: DataFrame) -> DataFrame:
    """The same with the root in front, keys that name whole prefixes, and sizes summed from the root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path in batch.column(1).to_pylist():
                key, size, row = "", 0, [{"key": "", "size": 0}]
                for turn in path:
                    key = hashlib.blake2b((key + turn["key"]).encode(), digest_size=16).hexdigest()
                    size += turn["size"]
                    row.append({"key": key, "size": size})
                out.append(row)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.struct([("key", pa.string()), ("size", pa.int64())])))], names=["conv_id", "path"])

    return paths.mapInArrow(run, f"conv_id long, path {PATH}")


def _ends(members: DataFrame, piece: int) -> DataFrame:
    """(key, ends_sha256): the digest of the ascending ids of each key. members: (key, conv_id)."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([held[0]], pa.int64()), pa.array([",".join(map(str, held))])], names=["key", "first", "ids"])

        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (k != key or len(held) == piece):
                    yield row()
                    held = []
                key = k
                held.append(c)
        if held:
            yield row()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            keys, out = [], []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k == key:
                    digest.update(b"," + ids.encode())
                    continue
                if digest:
                    keys.append(key)
                    out.append(digest.hexdigest())
                key, digest = k, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(out, pa.string())], names=["key", "ends_sha256"])
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], names=["key", "ends_sha256"])

    ranged = members.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    pieces = saved(ranged.mapInArrow(joined, "key string, first long, ids string"), "pieces")
    return pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(hashed, "key string, ends_sha256 string")


def _stops(sequences: DataFrame) -> list[int]:
    """The depths, greatest first, at which some node forks or some sequence ends above another; always with the root's."""
    steps = sequences.select(F.posexplode(F.transform("path", lambda p, i: F.struct(p["key"].alias("key"), F.get("path", i + 1)["key"].alias("next")))).alias("depth", "e"))
    nodes = steps.select("depth", "e.key", "e.next").groupBy("depth", "key")
    nodes = nodes.agg(F.min("next").alias("a"), F.max("next").alias("b"), F.max(F.col("next").isNull()).alias("end"))
    found = nodes.where((F.col("a") != F.col("b")) | (F.col("end") & F.col("a").isNotNull())).select("depth").distinct()
    return sorted({0, *(r["depth"] for r in found.collect())}, reverse=True)  # whole numbers below the longest conversation's length


def trie(paths: DataFrame, piece: int = PIECE, crowd: int = CROWD) -> DataFrame:
    """The nodes of the prefix trie of (conv_id, path): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, key."""
    members = saved(_chained(paths), "chained")
    keyed = members.select("conv_id", "path", F.element_at("path", -1)["key"].alias("key"))
    sequences = keyed.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("path").alias("path"))
    zero = F.lit(0).cast("long")
    sequences = saved(sequences.select("path", "conv_id", "n_convs", zero.alias("children"), zero.alias("leaves"), zero.alias("below"), (F.size("path") - 1).alias("depth")), "sequences")
    nodes: list[DataFrame] = []
    stops, alive, above = _stops(sequences), None, None
    last = lambda at: F.get("path", at)
    for stop in stops:
        # alive: nodes at the stop before; those and the sequences that end on the way are chains down to this stop
        ended = sequences.where((F.col("depth") > stop) & (F.lit(True) if above is None else F.col("depth") < above))
        ended = ended.withColumn("leaves", F.lit(1).cast("long")).withColumn("below", F.col("n_convs") - 1).withColumn("below", F.col("below") * (last(F.col("depth"))["size"] - last(F.col("depth") - 1)["size"]))
        chains = ended if alive is None else ended.unionByName(alive)
        chains = saved(chains, "chains")
        # a chain's node at depth j: its subtree is what hangs below the chain's end and the turns between
        gain = F.col("below") + (F.col("n_convs") - 1) * (last(F.col("depth") - 1)["size"] - last(F.col("j") - 1)["size"])
        nodes.append(
            chains.withColumn("j", F.explode(F.sequence(F.col("depth"), F.lit(stop + 1)))).select(
                last(F.col("j"))["key"].alias("key"), last(F.col("j") - 1)["key"].alias("parent"), F.col("j").alias("depth"), "conv_id", "n_convs",
                F.when(F.col("j") == F.col("depth"), F.col("children")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), gain.alias("saved_tokens"),
                (F.col("j") == stop + 1).alias("top"),
            )
        )
        inner = last(F.lit(stop))["size"]
        stripped = chains.select(
            F.slice("path", 1, stop + 1).alias("path"), "conv_id", "n_convs", F.lit(1).cast("long").alias("children"), "leaves",
            (F.col("below") + (F.col("n_convs") - 1) * (last(F.col("depth") - 1)["size"] - inner)).alias("below"),
        )
        here = sequences.where(F.col("depth") == stop).drop("depth")
        merged = stripped.unionByName(here).withColumn("key", last(F.lit(stop))["key"]).groupBy("key").agg(
            F.first("path").alias("path"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "children", "leaves", "below")]
        )
        own = (F.col("n_convs") - 1) * (inner - last(F.lit(stop - 1))["size"] if stop else zero)
        alive = merged.select("path", "conv_id", "n_convs", "children", F.when(F.col("children") == 0, 1).otherwise(F.col("leaves")).cast("long").alias("leaves"), (F.col("below") + own).alias("below"), F.lit(stop).alias("depth"))
        alive, above = saved(alive, "alive"), stop
    root = alive.select(
        F.lit("").alias("key"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), "conv_id", "n_convs", F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("below").alias("saved_tokens"), F.lit(False).alias("top"),
    )
    every = root
    for part in nodes:
        every = every.unionByName(part)
    every = saved(every, "nodes")

    # inside a chain the parent's smallest member is the chain's; the top of a chain has a forking parent
    inside = every.where(~F.col("top")).withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id")))
    tops = every.where("top")
    parents = every.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    popular = F.broadcast(parents.where(F.col("n_children") > crowd).drop("n_children"))
    common = parents.where((F.col("n_children") > 0) & (F.col("n_children") <= crowd)).drop("n_children")
    placed = inside.unionByName(tops.join(popular, "parent")).unionByName(tops.join(popular, "parent", "left_anti").join(common, "parent"))
    ends = _ends(keyed.select("key", "conv_id"), piece)
    empty = hashlib.sha256(b"").hexdigest()
    out = placed.join(ends, "key", "left")
    return out.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"), "key")


def prefix_trie(conversations: DataFrame, family: int = 100, leads: int = 6) -> DataFrame:
    """The trie of conversations rebuilt on the beginnings of the first of each family: conversation c starts with h = crc32(c) mod `leads` turns of c - c % family."""
    c = F.col("conv_id")
    held = (F.crc32(c.cast("string")) % leads).cast("int")
    return trie(rebuilt(conversations, c - c % family, held, leads - 1))
