"""Conversation prefix trie as a z-fast trie.

A conversation is a string of turns. The trie of all of them is kept compacted: a node stands for a whole
edge, from below its parent's depth to its own, and holds the hashes of the prefixes along it. Nodes are rows
of a table that is looked up by hash: by handle, the prefix at the edge's two-fattest depth (the depth
with the most trailing zero bits), and by name, the prefix at the edge's first depth.

Where a conversation leaves the trie is found by fat binary search: it probes the handle at the two-fattest
depth of the interval that is left, so that the search takes as many joins as the longest conversation's
length has bits. Conversations are inserted in batches: all those that still lack a leaf search at the same time,
each edge is cut wherever one of them leaves it, and of those that leave at one place by one turn, one gets its
leaf; the others go on from there in the next batch. Which one is by hash, so that a subtree's conversations
fall by a constant part in each batch on average. At last, sums over subtrees go up the trie by
pointer doubling, and edges are expanded into a node for each depth.

A prefix's hash is the exclusive or of 128-bit hashes of (depth, turn). A conversation's hashes, 16 bytes a turn,
are one row; texts are hashed where they are read and never shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, mix64, read_table, release_memory, sent_if_small, stored

#: Conversation 5k lends its beginning to 5k + 1 to 5k + 4; how many turns is by the id's hash, below PARTS.
FAMILY, PARTS = 5, 9
ROOT = b"\0" * 16
#: Bytes of nodes that are sent to all tasks; more are joined by a shuffle.
SENT_BYTES = 32 << 20
#: Ids, as a power of two, that are joined into one text before a node's texts are hashed in order.
PIECE_BITS = 9


def _root() -> Column:
    return F.lit(ROOT)


def two_fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] with the most trailing zero bits."""
    bits = F.length(F.bin(low.bitwiseXOR(high))) - 1
    return high.bitwiseAND(F.call_function("shiftleft", F.lit(-1), bits))


def _at(array: str, depth: Column) -> Column:
    """The hash of the prefix of this depth; depth 0 is the root."""
    return F.when(depth == 0, _root()).otherwise(F.try_element_at(array, depth.cast("int")))


def rebuilt(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns): each conversation's own turns after its first h behind the first h of its family's
    first conversation, as (turn, hash of role and text, bytes of the text)."""
    role, text = F.coalesce(role_col, F.lit("")), F.coalesce(text_col, F.lit(""))
    what = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    turns = conversations.select(F.col(id_col).cast("long").alias("conv_id"), F.struct(F.col(turn_col).cast("long").alias("turn"), what.alias("hash"), F.octet_length(text).alias("bytes")).alias("t"))
    own = turns.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))
    own = own.withColumns({"h": (F.crc32(F.col("conv_id").cast("string")) % PARTS).cast("int"), "base": F.col("conv_id") - F.col("conv_id") % FAMILY})
    heads = own.where(F.col("conv_id") == F.col("base")).select(F.col("conv_id").alias("head_id"), F.slice("own", 1, PARTS - 1).alias("head"))
    lent = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("own", F.lit(1), F.lit(0)))
    rest = F.slice("own", F.col("h") + 1, F.greatest(F.size("own"), F.lit(1)))
    return own.join(heads, F.col("base") == F.col("head_id"), "left").select("conv_id", F.concat(lent, rest).alias("turns"))


def with_prefixes(conversations: DataFrame) -> DataFrame:
    """conversations: (conv_id, turns). Returns (conv_id, sid, n, prefixes, totals): the hash of the whole, the
    number of turns, the hashes of all prefixes, and the bytes of their texts."""

    def run(batches):
        for batch in batches:
            turns = batch.column("turns")
            offsets, flat = turns.offsets.to_numpy().astype(np.int64), turns.flatten()
            offsets = offsets - offsets[0]
            sizes, n = np.diff(offsets), len(flat)
            raw = flat.field("hash")
            places = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + n + 1]
            words = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[places[0] : places[-1]].view(np.uint64).reshape(n, 2) if n else np.zeros((0, 2), np.uint64)
            depth = (np.arange(n) - np.repeat(offsets[:-1], sizes)).astype(np.uint64)
            mixed = np.zeros((n + 1, 2), np.uint64)
            for k in (0, 1):  # both halves of the turn's hash go into either half
                mixed[1:, k] = mix64(words[:, k] ^ mix64(words[:, 1 - k] + mix64(depth * np.uint64(2) + np.uint64(k + 1))))
            all_before = np.bitwise_xor.accumulate(mixed, axis=0)
            prefix = np.ascontiguousarray(all_before[1:] ^ np.repeat(all_before[offsets[:-1]], sizes, axis=0))
            whole = np.ascontiguousarray(all_before[offsets[1:]] ^ all_before[offsets[:-1]])
            of = lambda m: pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer((np.arange(len(m) + 1) * 16).astype(np.int32)), pa.py_buffer(m)])
            lists = pa.array(offsets.astype(np.int32))
            so_far = np.concatenate([[0], np.cumsum(flat.field("bytes").to_numpy(zero_copy_only=False).astype(np.int64))])
            totals = pa.array(so_far[1:] - np.repeat(so_far[offsets[:-1]], sizes), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), of(whole), pa.array(sizes.astype(np.int32)), pa.ListArray.from_arrays(lists, of(prefix)), pa.ListArray.from_arrays(lists, totals)],
                names=["conv_id", "sid", "n", "prefixes", "totals"],
            )
        release_memory()

    return bounded_batches(conversations.select("conv_id", "turns")).mapInArrow(run, "conv_id long, sid binary, n int, prefixes array<binary>, totals array<long>")


#: A node: its edge's depths are p + 1 to e; name, handle and key are its prefixes at the first, the
#: two-fattest and the last of them, up is its parent's key; totals are the bytes of all turns down to each
#: depth of the edge, above those down to p.
NODE = "name binary, handle binary, key binary, up binary, p int, e int, edge array<binary>, totals array<long>, above long"


def _node(edge: Column, totals: Column, p: Column, e: Column, up: Column, above: Column) -> list[Column]:
    at = lambda d: F.try_element_at(edge, (d - p).cast("int"))
    return [at(p + 1).alias("name"), at(two_fattest(p, e)).alias("handle"), at(e).alias("key"), up.alias("up"), p.cast("int").alias("p"), e.cast("int").alias("e"), edge.alias("edge"), totals.alias("totals"), above.alias("above")]


def _last(array: str) -> Column:
    return F.coalesce(F.try_element_at(array, F.lit(-1)), F.lit(0).cast("long"))


def exits(strings: DataFrame, nodes: DataFrame, longest: int) -> DataFrame:
    """strings with x, the depth at which each leaves the trie, and cut, the name of the edge that must be
    cut there (null if a node ends there). strings has a: a depth at which it is known to be at a node."""
    handles = sent_if_small(nodes.select(F.col("handle").alias("h_handle"), F.col("key").alias("h_key"), F.col("p").alias("h_p"), F.col("e").alias("h_e")), SENT_BYTES)
    found = strings.withColumn("b", F.col("n"))
    for _ in range(int(longest).bit_length() + 1):
        searching = F.col("a") < F.col("b")
        # Those that are done probe for something that isn't there, each for something else.
        found = found.withColumn("f", two_fattest(F.col("a"), F.col("b"))).withColumn("probe", F.when(searching, _at("prefixes", F.col("f"))).otherwise(F.unhex(F.md5("sid"))))
        found = found.join(handles, F.col("probe") == F.col("h_handle"), "left")
        met = searching & F.col("h_e").isNotNull()
        inside = met & (F.col("h_e") <= F.col("n")) & F.coalesce(_at("prefixes", F.col("h_e")) == F.col("h_key"), F.lit(False))
        a = F.when(inside, F.col("h_e")).when(met, F.col("h_p")).otherwise(F.col("a"))
        b = F.when(inside, F.col("b")).when(met, F.col("h_p")).when(searching, F.col("f") - 1).otherwise(F.col("b"))
        found = found.select("sid", "n", "prefixes", "totals", a.alias("a"), b.alias("b"))
    edges = sent_if_small(nodes.select(F.col("name").alias("c_name"), F.col("e").alias("c_e"), "edge"), SENT_BYTES)
    found = found.withColumn("probe", F.when(F.col("a") < F.col("n"), _at("prefixes", F.col("a") + 1)).otherwise(F.unhex(F.md5("sid"))))
    found = found.join(edges, F.col("probe") == F.col("c_name"), "left")
    own = F.slice("prefixes", F.col("a") + 1, F.greatest(F.size("edge"), F.lit(1)))
    shared = F.size(F.filter(F.zip_with("edge", own, lambda u, v: F.coalesce(u == v, F.lit(False))), lambda same: same))
    x = F.when(F.col("c_e").isNull(), F.col("a")).otherwise(F.col("a") + shared)
    return found.withColumn("x", x).select("sid", "n", "prefixes", "totals", "x", F.when(F.col("x") < F.col("c_e"), F.col("c_name")).alias("cut"))


def cut_edges(nodes: DataFrame, cuts: DataFrame) -> DataFrame:
    """nodes, with each edge cut at all depths x that cuts: (cut, x) names for it."""
    places = sent_if_small(stored(cuts.groupBy(F.col("cut").alias("c_name")).agg(F.sort_array(F.collect_set("x")).alias("places")), "trie-cuts"), SENT_BYTES)
    bounds = F.when(F.col("places").isNull(), F.array("p", "e")).otherwise(F.concat(F.array("p"), "places", F.array("e")))
    pieces = nodes.join(places, F.col("name") == F.col("c_name"), "left").withColumn("bounds", bounds)
    pieces = pieces.select("*", F.posexplode(F.slice("bounds", F.lit(1), F.size("bounds") - 1)).alias("i", "from")).withColumn("to", F.element_at("bounds", F.col("i") + 2))
    part = lambda c: F.slice(c, F.col("from") - F.col("p") + 1, F.col("to") - F.col("from"))
    at_cut = lambda c, first: F.when(F.col("i") == 0, F.col(first)).otherwise(F.try_element_at(c, F.greatest(F.col("from") - F.col("p"), F.lit(1))))
    pieces = pieces.select("from", "to", part("edge").alias("_edge"), part("totals").alias("_totals"), at_cut("edge", "up").alias("_up"), at_cut("totals", "above").alias("_above"))
    return pieces.select(*_node(F.col("_edge"), F.col("_totals"), F.col("from"), F.col("to"), F.col("_up"), F.col("_above")))


def compacted(strings: DataFrame) -> DataFrame:
    """The nodes of the compacted trie of all strings: (sid, n, prefixes, totals), each once."""
    spark = strings.sparkSession
    nodes = spark.createDataFrame([], NODE)
    waiting = strings.where("n > 0").select("sid", "n", "prefixes", "totals", F.lit(0).alias("a"))
    longest = waiting.agg(F.max("n")).first()[0] or 0
    left, first = bool(longest), True
    while left:
        if first:
            out = waiting.select("sid", "n", "prefixes", "totals", F.lit(0).alias("x"), F.lit(None).cast("binary").alias("cut"))
        else:
            out = stored(exits(waiting, nodes, longest), "trie-exits")
            nodes = cut_edges(nodes, out.where("cut IS NOT NULL").select("cut", "x"))
        beyond = out.where("n > x").withColumn("next", _at("prefixes", F.col("x") + 1))
        chosen = stored(beyond.groupBy("next").agg(F.min("sid").alias("c_sid")).select("c_sid"), "trie-leaves")
        sent = sent_if_small(chosen, SENT_BYTES)
        leaf = beyond.join(sent, F.col("sid") == F.col("c_sid"), "left_semi")
        rest = lambda c: F.slice(c, F.col("x") + 1, F.col("n") - F.col("x"))
        leaves = leaf.select("n", "x", rest("prefixes").alias("_edge"), rest("totals").alias("_totals"), _at("prefixes", F.col("x")).alias("_up"), F.when(F.col("x") == 0, F.lit(0).cast("long")).otherwise(F.try_element_at("totals", F.col("x"))).alias("_above"))
        leaves = leaves.select(*_node(F.col("_edge"), F.col("_totals"), F.col("x"), F.col("n"), F.col("_up"), F.col("_above")))
        nodes = stored(leaves if first else nodes.unionByName(leaves), "trie-nodes")
        waiting = stored(beyond.join(sent, F.col("sid") == F.col("c_sid"), "left_anti").select("sid", "n", "prefixes", "totals", F.col("x").alias("a")), "trie-waiting")
        left, first = not waiting.isEmpty(), False
    return nodes


def with_subtrees(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """nodes with children, and over each node's subtree: convs (members), least (the smallest), leaves, weight
    (bytes of all its edges) and reach (the bytes of whole conversations, summed over members).

    ends: (sid, n_ends, least). Values go up the trie by doubling: what a node has gathered of the descendants
    nearer than 2 ** k goes to its ancestor at that distance."""
    children = nodes.groupBy(F.col("up").alias("c_up")).agg(F.count("*").alias("children"))
    start = nodes.join(children, F.col("key") == F.col("c_up"), "left").join(ends, F.col("key") == F.col("sid"), "left")
    start = start.withColumns({"children": F.coalesce("children", F.lit(0).cast("long")), "convs": F.coalesce("n_ends", F.lit(0).cast("long")), "total": _last("totals")})
    start = stored(start.withColumns({"leaves": (F.col("children") == 0).cast("long"), "reach": F.col("convs") * F.col("total"), "weight": F.col("total") - F.col("above")}).drop("c_up", "sid", "n_ends"), "trie-start")
    sums = ["convs", "leaves", "weight", "reach"]
    now = start.select("key", F.when(F.col("up") != _root(), F.col("up")).alias("jump"), *sums, "least")
    while not now.where("jump IS NOT NULL").isEmpty():
        given = now.where("jump IS NOT NULL").groupBy(F.col("jump").alias("g_key")).agg(*(F.sum(c).alias(f"g_{c}") for c in sums), F.min("least").alias("g_least"))
        farther = sent_if_small(now.where("jump IS NOT NULL").select(F.col("key").alias("j_key"), F.col("jump").alias("farther")), SENT_BYTES)
        apart = F.coalesce("jump", F.unhex(F.md5("key")))
        now = now.join(given, F.col("key") == F.col("g_key"), "left").withColumn("apart", apart).join(farther, F.col("apart") == F.col("j_key"), "left")
        added = [(F.col(c) + F.coalesce(f"g_{c}", F.lit(0))).alias(c) for c in sums]
        now = stored(now.select("key", F.when(F.col("jump").isNotNull(), F.col("farther")).alias("jump"), *added, F.least("least", "g_least").alias("least")), "trie-sums")
    return start.drop(*sums, "least").join(now.drop("jump").withColumnRenamed("key", "n_key"), F.col("key") == F.col("n_key")).drop("n_key")


def ends_hashes(members: DataFrame) -> DataFrame:
    """members: (sid, conv_id). (e_sid, sha): SHA-256 of each sid's ids, ascending, comma-joined. Ids are joined
    in pieces of at most 2 ** PIECE_BITS; pieces are hashed in order as they come, never gathered."""
    pieces = members.groupBy("sid", F.shiftright("conv_id", PIECE_BITS).alias("piece")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",").alias("ids"))

    def run(batches):
        now, state = None, None
        done: list[tuple[bytes, str]] = []
        for batch in batches:
            for sid, ids in zip(batch.column("sid").to_pylist(), batch.column("ids").to_pylist()):
                if sid != now:
                    if state:
                        done.append((now, state.hexdigest()))
                    now, state = sid, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in done], pa.binary()), pa.array([h for _, h in done], pa.string())], names=["e_sid", "sha"])
                done = []
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["e_sid", "sha"])

    return pieces.repartition("sid").sortWithinPartitions("sid", "piece").select("sid", "ids").mapInArrow(run, "e_sid binary, sha string")


OUT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def prefix_trie(conversations: DataFrame, **columns: str) -> DataFrame:
    """A row for each node of the trie of all rebuilt conversations: conv_id (the smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    Turns are ordered by turn (null first), those of one turn by a hash of role and text; repeated rows
    are repeated turns. Null roles and texts are empty. Rows without an id are left out; ids are whole numbers,
    and a negative one's family begins at the multiple of five next to zero. Conversations without turns end
    at the root. An empty table has no node, not even the root. Very long conversations are one row of 16 bytes
    a turn. Other columns are left out.
    """
    spark = conversations.sparkSession
    rows = stored(with_prefixes(rebuilt(conversations, **columns)), "trie-strings")
    strings = stored(rows.groupBy("sid").agg(F.first("n").alias("n"), F.first("prefixes").alias("prefixes"), F.first("totals").alias("totals"), F.count("*").alias("n_ends"), F.min("conv_id").alias("least")), "trie-distinct")
    total = strings.agg(F.sum("n_ends").alias("n"), F.min("least").alias("least"), F.sum(F.col("n_ends") * _last("totals")).alias("reach")).first()
    if total["least"] is None:
        return spark.createDataFrame([], OUT)
    nodes = stored(with_subtrees(compacted(strings), strings.select("sid", "n_ends", "least")), "trie-subtrees")
    shas = stored(ends_hashes(rows.select("sid", "conv_id")), "trie-ends")
    at_root = nodes.agg(F.count_if(F.col("p") == 0).alias("children"), F.count_if(F.col("children") == 0).alias("leaves"), F.coalesce(F.sum(F.when(F.col("p") == 0, F.col("weight"))), F.lit(0)).alias("weight")).first()
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    root = shas.where(F.col("e_sid") == _root()).agg(F.max("sha").alias("sha")).select(
        F.lit(total["least"]).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(total["n"]).cast("long").alias("n_convs"),
        F.lit(at_root["children"]).cast("long").alias("n_children"), F.lit(max(1, at_root["leaves"])).cast("long").alias("n_leaves"),
        F.lit(total["reach"] - at_root["weight"]).cast("long").alias("saved_tokens"), F.coalesce("sha", nothing).alias("ends_sha256"),
    )
    parents = sent_if_small(nodes.where("children > 0").select(F.col("key").alias("u_key"), F.col("least").alias("u_least")), SENT_BYTES)
    full = nodes.join(parents, F.col("up") == F.col("u_key"), "left").join(shas, F.col("key") == F.col("e_sid"), "left")
    each = full.select("*", F.posexplode("totals").alias("i", "here"))
    last = F.col("i") == F.size("totals") - 1
    before = F.when(F.col("i") == 0, F.col("above")).otherwise(F.get("totals", F.col("i") - 1))  # down to the depth above
    # Each member saves a depth's bytes once for each other one: bytes times members, less the bytes themselves.
    saved = F.col("reach") - F.col("convs") * before - (F.col("weight") - (before - F.col("above")))
    out = each.select(
        F.col("least").alias("conv_id"), (F.col("p") + 1 + F.col("i")).cast("long").alias("depth"),
        F.when(F.col("i") > 0, F.col("least")).otherwise(F.coalesce("u_least", F.lit(total["least"]))).cast("long").alias("parent_conv_id"),
        F.col("convs").alias("n_convs"), F.when(last, F.col("children")).otherwise(F.lit(1).cast("long")).alias("n_children"), F.col("leaves").alias("n_leaves"),
        saved.alias("saved_tokens"), F.when(last, F.coalesce("sha", nothing)).otherwise(nothing).alias("ends_sha256"),
    )
    return root.unionByName(out)


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read_table(spark, sf_dir, "conversations"))


QUERIES = {"op12_conversation_prefix_trie": op12_conversation_prefix_trie}
# CRC-32 of the decimal id, a bit at a time; 3988292384 is its polynomial (a fixed value).
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
  lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""
ORACLES = {
    "op12_conversation_prefix_trie": f"""
WITH k AS (
  SELECT conv_id, turn, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS what, strlen(coalesce(text, '')) AS bytes
  FROM conversations WHERE conv_id IS NOT NULL
),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, what) AS place FROM k),
ids AS (SELECT conv_id AS c, conv_id - conv_id % 5 AS base, {_CRC} % 9 AS h FROM t WHERE place = 1),
lent AS (SELECT c, place AS d, what, bytes FROM ids JOIN t ON t.conv_id = base AND place <= h),
r AS (
  SELECT * FROM lent
  UNION ALL SELECT ids.c, place - h + coalesce(l.n, 0), what, bytes FROM ids JOIN t ON t.conv_id = ids.c AND place > h LEFT JOIN (SELECT c, count(*) AS n FROM lent GROUP BY c) l ON l.c = ids.c
),
p AS (SELECT c, d, bytes, md5(string_agg(what, '/') OVER (PARTITION BY c ORDER BY d)) AS node FROM r UNION ALL SELECT c, 0, 0, 'root' FROM ids),
q AS (SELECT *, lag(node) OVER (PARTITION BY c ORDER BY d) AS parent, lead(node) OVER (PARTITION BY c ORDER BY d) IS NULL AS ends FROM p),
n AS (
  SELECT node, min(d) AS d, min(c) AS conv_id, count(*) AS n_convs, min(bytes) AS bytes, min(parent) AS parent,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
  FROM q GROUP BY node
),
children AS (SELECT parent, count(*) AS n FROM n WHERE parent IS NOT NULL GROUP BY parent),
sums AS (
  SELECT q.node, count(*) FILTER (WHERE x.n IS NULL) AS n_leaves, sum((u.n_convs - 1) * u.bytes) AS saved_tokens
  FROM n u LEFT JOIN children x ON x.parent = u.node JOIN q ON q.c = u.conv_id AND q.d <= u.d GROUP BY q.node
)
SELECT n.conv_id, n.d::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(x.n, 0) AS n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN sums s USING (node) LEFT JOIN n up ON up.node = n.parent LEFT JOIN children x ON x.parent = n.node
"""
}
