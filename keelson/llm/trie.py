"""Prefix tries of conversations, encoded by preorder intervals.

A node is a sequence of first turns that some conversation begins with. Nodes are never walked: each distinct whole
conversation gets its rank in lexicographic order, a node then covers a stretch of ranks, and its place in preorder is the
number of nodes that earlier ranks bring in plus its depth among those of its own first rank. A subtree ends where the
nodes of its last rank end, so whatever is summed over a subtree is a difference of two prefix sums over all nodes.

A turn is known by 128 bits of the SHA-256 of its role and text, and a prefix by two 64-bit combinations of its turns' places
and contents (unequal prefixes agree with probability 2**-128); texts themselves are never moved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.archive import with_ids
from .crc import CRC_TABLE, crc32
from .scratch import materialize
from .words import tidy

BLOCK = 512  #: turns of a conversation that are compared, or combined, in one row
PIECE = 4096  #: ids that are joined into one text
CELL = 1 << 16  #: nodes that are summed in one window


def turns(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The turns of every conversation in order: ``conv_id``, ``depth`` (from 1), ``turn_key``, ``n_bytes`` (of the text).

    Null turns come first; equal turns are ordered by the SHA-256 of role and text, and repeated rows stay. Null roles and
    texts are empty. Rows with a null conversation are left out. Turns are numbered in sorted ranges that are written, so
    a conversation of any length is spread over tasks.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    # The role's length keeps ("a", "bc") and ("ab", "c") apart.
    sha = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = messages.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.unhex(F.substring(sha, 1, 32)).alias("turn_key"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )
    rows = with_ids(rows, ["conv_id", "turn", "turn_key"])
    first = rows.groupBy("conv_id").agg(F.min("id").alias("first"))
    return rows.join(first, "conv_id").select("conv_id", (F.col("id") - F.col("first") + 1).alias("depth"), "turn_key", "n_bytes")


def _combined(depth: Column, key: Column) -> dict[str, Column]:
    return {f"p{i}": F.bit_xor(F.xxhash64(F.lit(i), depth, key)) for i in (1, 2)}


def prefixes(rows: DataFrame) -> DataFrame:
    """Adds ``p1``, ``p2``, which stand for the prefix that ends in each turn, to turns of ``conv_id``, ``depth``,
    ``turn_key``, ``n_bytes``; written. Other columns are left out."""
    return materialize(_prefixes(rows.select("conv_id", "depth", "turn_key", "n_bytes")), "trie-turns")


def _prefixes(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("block", F.floor((F.col("depth") - 1) / BLOCK).cast("long"))
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({k: c.over(inside) for k, c in _combined(F.col("depth"), F.col("turn_key")).items()})
    if not rows.where("block > 0").limit(1).count():
        return out.drop("block")
    # What the blocks before a block combine to is one row per block.
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("conv_id", "block").agg(*[c.alias(k) for k, c in _combined(F.col("depth"), F.col("turn_key")).items()])
    carried = ends.select("conv_id", "block", *[F.coalesce(F.bit_xor(k).over(before), F.lit(0)).alias(f"b{k}") for k in ("p1", "p2")])
    out = out.join(carried, ["conv_id", "block"])
    return out.withColumns({k: F.col(k).bitwiseXOR(F.col(f"b{k}")) for k in ("p1", "p2")}).drop("block", "bp1", "bp2")


def _ranked(rows: DataFrame, longest: int) -> DataFrame:
    """``conv_id`` and ``rank`` (from 1) in the lexicographic order of turn keys, a prefix before what it begins.

    A conversation is an array of its turns. Longer ones than ``BLOCK`` turns become sequences of blocks, each named by
    its rank among all different blocks, until one array holds them.
    """
    level, name = rows.select("conv_id", (F.col("depth") - 1).alias("at"), F.col("turn_key").alias("key")), "trie-blocks"
    while True:
        arrays = level.groupBy("conv_id", F.floor(F.col("at") / BLOCK).cast("long").alias("block")).agg(
            F.transform(F.sort_array(F.collect_list(F.struct("at", "key"))), lambda x: x["key"]).alias("keys")
        )
        longest = -(-longest // BLOCK)
        if longest <= 1:
            return with_ids(arrays.select("conv_id", "keys"), ["keys"]).select("conv_id", F.col("id").alias("rank"))
        arrays = materialize(arrays, name)
        names = with_ids(arrays.select("keys").distinct(), ["keys"]).select("keys", F.col("id").alias("key"))
        level = arrays.join(names, "keys").select("conv_id", F.col("block").alias("at"), "key")


def prefix_sums(rows: DataFrame, place: str, sums: list[str]) -> DataFrame:
    """Adds ``upto_<c>``: the sum of ``c`` over all rows up to this one in the order of ``place``, which numbers rows 0, 1, ...

    Stretches of ``CELL`` places are summed on their own; only one row per stretch meets in a window.
    """
    rows = rows.withColumn("_cell", F.floor(F.col(place) / CELL).cast("long"))
    ends = rows.groupBy("_cell").agg(*[F.sum(c).alias(f"_end_{c}") for c in sums])
    before = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("_cell", *[F.coalesce(F.sum(f"_end_{c}").over(before), F.lit(0)).alias(f"_start_{c}") for c in sums])
    inside = Window.partitionBy("_cell").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({f"_in_{c}": F.sum(c).over(inside) for c in sums}).join(starts, "_cell")
    out = out.withColumns({f"upto_{c}": F.col(f"_in_{c}") + F.col(f"_start_{c}") for c in sums})
    return out.drop("_cell", *[f"_{k}_{c}" for k in ("in", "start") for c in sums])


def prefix_trie(rows: DataFrame, members: DataFrame) -> DataFrame:
    """The trie of conversations whose turns are ``rows`` (as of ``prefixes``); ``members`` has every ``conv_id`` and its
    number of turns, ``n_turns``, which may be 0.

    One row per node: ``place`` (in preorder, the root's is 0), ``last`` (the place at which its subtree ends), ``conv_id``
    (of its smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``,
    and ``p1``, ``p2`` as in ``ends``. Conversations that are equal are counted first and then go on as one, however many
    there are. Without members there is no node. Other columns are ignored.
    """
    whole = materialize(ends(rows, members).withColumnRenamed("depth", "n_turns"), "trie-whole")
    # Equal conversations: the smallest stands for all.
    alike = whole.where("n_turns > 0").groupBy("p1", "p2", "n_turns").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    alike = materialize(alike.select("conv_id", "n_convs", "n_turns"), "trie-alike")
    size = whole.agg(F.count("*").alias("n"), F.min("conv_id").alias("first"), F.max("n_turns").alias("longest")).first()
    mine = rows.join(alike.select("conv_id", "n_convs"), "conv_id")
    ranks = _ranked(mine, size["longest"] or 0)
    mine = mine.join(ranks, "conv_id")
    # The prefix without its last turn.
    up = {f"q{i}": F.col(f"p{i}").bitwiseXOR(F.xxhash64(F.lit(i), "depth", "turn_key")) for i in (1, 2)}
    nodes = mine.withColumns(up).groupBy("depth", "p1", "p2").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.min("rank").alias("low"), F.max("rank").alias("high"),
        F.max("n_bytes").alias("n_bytes"), F.first("q1").alias("q1"), F.first("q2").alias("q2"),
    )
    nodes = materialize(nodes, "trie-nodes")
    # Each rank brings in the nodes from some depth on.
    brought = nodes.groupBy("low").agg(F.count("*").alias("new"), F.min("depth").alias("top"))
    brought = materialize(prefix_sums(brought.withColumn("at", F.col("low") - 1), "at", ["new"]), "trie-ranks")
    starts = brought.select("low", (F.col("upto_new") - F.col("new") + 1 - F.col("top")).alias("shift"))
    stops = brought.select(F.col("low").alias("high"), F.col("upto_new").alias("last"))
    nodes = nodes.join(starts, "low").join(stops, "high").withColumn("place", F.col("shift") + F.col("depth"))
    root = rows.sparkSession.range(1 if size["n"] else 0).select(
        F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("p1"), F.lit(0).cast("long").alias("p2"),
        F.lit(size["first"]).cast(rows.schema["conv_id"].dataType).alias("conv_id"), F.lit(size["n"]).alias("n_convs"), F.lit(0).cast("long").alias("n_bytes"),
        F.lit(None).cast("long").alias("q1"), F.lit(None).cast("long").alias("q2"), F.lit(0).cast("long").alias("place"),
    )
    columns = ["place", "last", "conv_id", "depth", "n_convs", "n_bytes", "p1", "p2", "q1", "q2"]
    # The root ends where the last node does.
    most = brought.agg(F.max("upto_new")).first()[0] or 0
    nodes = nodes.select(columns).unionByName(root.withColumn("last", F.lit(most).cast("long")).select(columns))
    nodes = nodes.withColumns({"leaf": (F.col("last") == F.col("place")).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("n_bytes")})
    nodes = materialize(prefix_sums(nodes, "place", ["leaf", "saved"]), "trie-preorder")
    upto = nodes.select(F.col("place").alias("last"), F.col("upto_leaf").alias("end_leaf"), F.col("upto_saved").alias("end_saved"))
    above = nodes.where("leaf = 0").select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    children = nodes.where("depth > 0").groupBy(F.col("depth") - 1, "q1", "q2").agg(F.count("*").alias("n_children"))
    children = children.toDF("depth", "p1", "p2", "n_children")
    out = nodes.join(upto, "last").join(children, ["depth", "p1", "p2"], "left").join(above, ["depth", "q1", "q2"], "left")
    return out.select(
        "place", "last", "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        (F.col("end_leaf") - F.col("upto_leaf") + F.col("leaf")).alias("n_leaves"),
        (F.col("end_saved") - F.col("upto_saved") + F.col("saved")).alias("saved_tokens"), "p1", "p2",
    )


def ends(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Which conversation ends at which node: ``conv_id``, ``depth``, ``p1``, ``p2`` (0, 0 and 0 for one without turns)."""
    last = rows.select("conv_id", "depth", "p1", "p2")
    out = members.select("conv_id", F.col("n_turns").alias("depth")).join(last, ["conv_id", "depth"], "left")
    return out.withColumns({k: F.coalesce(k, F.lit(0).cast("long")) for k in ("p1", "p2")})


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each group's pieces, which stand in order; only one piece at a time is held."""
    key, running = None, None
    for batch in batches:
        out = []
        for *now, text in zip(*(batch.column(c).to_pylist() for c in ("depth", "p1", "p2", "text")), strict=True):
            if now != key:
                if key:
                    out.append((*key, running.hexdigest()))
                key, running = now, hashlib.sha256()
            else:
                running.update(b",")
            running.update(text.encode())
        yield _digests(out)
    if key:
        yield _digests([(*key, running.hexdigest())])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["depth", "p1", "p2", "ends_sha256"])


def ends_digest(ended: DataFrame, piece: int = PIECE) -> DataFrame:
    """For each node of ``ends``, the SHA-256 of its ids as decimal numbers in ascending order, joined by commas.

    The ids of a node with more than ``piece`` of them are numbered in sorted ranges and joined in pieces, wherever they
    lie; the pieces are then streamed through one running digest, which is all that a digest of one text allows.
    """
    key = ["depth", "p1", "p2"]
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("text")
    ended = ended.select(*key, "conv_id")
    counted = materialize(ended.join(ended.groupBy(*key).agg(F.count("*").alias("n")), key), "trie-ends")
    few = counted.where(F.col("n") <= piece).groupBy(*key).agg(ids).select(*key, F.sha2("text", 256).alias("ends_sha256"))
    many = counted.where(F.col("n") > piece)
    if not many.limit(1).count():
        return few
    many = with_ids(many.drop("n"), [*key, "conv_id"])
    first = many.groupBy(*key).agg(F.min("id").alias("first"))
    many = many.join(first, key).withColumn("piece", F.floor((F.col("id") - F.col("first")) / piece).cast("long"))
    # Written, so that the ids of one node are joined in many tasks before their pieces meet in one.
    pieces = materialize(many.groupBy(*key, "piece").agg(ids), "trie-pieces")
    pieces = pieces.repartition(*key).sortWithinPartitions(*key, "piece").select(*key, "text")
    return few.unionByName(pieces.mapInArrow(tidy(_digest), "depth long, p1 long, p2 long, ends_sha256 string"))


SQL = f"""
WITH c AS ({CRC_TABLE}), m AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
    sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS i,
    coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), v AS (SELECT c, count(*) AS n FROM m GROUP BY c),
h AS (SELECT v.c, v.c - v.c % 5 AS b, {crc32("CAST(v.c AS VARCHAR)")} % 9 AS h FROM v, c),
k AS (SELECT h.*, least(h.h, coalesce(v.n, 0)) AS nb FROM h LEFT JOIN v ON v.c = h.b),
r AS (
  SELECT k.c, m.i + 1 AS d, role, text FROM k JOIN m ON m.c = k.b AND m.i < k.h
  UNION ALL SELECT k.c, m.i - k.h + k.nb + 1, role, text FROM k JOIN m ON m.c = k.c AND m.i >= k.h
), l AS (SELECT k.c, count(r.d) AS n FROM k LEFT JOIN r ON r.c = k.c GROUP BY k.c),
t AS (SELECT r.c, d, strlen(text) AS bytes, sha256(string_agg(sha256(strlen(role) || ':' || role || text), '') OVER (PARTITION BY r.c ORDER BY d)) AS p FROM r),
path AS (SELECT c, d, bytes, p, coalesce(lag(p) OVER (PARTITION BY c ORDER BY d), '') AS q FROM t UNION ALL SELECT c, 0, 0, '', NULL FROM l),
node AS (SELECT d, p, min(q) AS q, min(c) AS conv_id, count(*) AS n, max(bytes) AS bytes FROM path GROUP BY d, p),
kids AS (SELECT q AS p, count(*) AS n FROM node WHERE d > 0 GROUP BY q),
sub AS (
  SELECT DISTINCT a.p AS top, b.p, b.d FROM path a JOIN path b ON a.c = b.c AND b.d >= a.d
), total AS (
  SELECT top, count(*) FILTER (WHERE kids.n IS NULL) AS leaves, sum((node.n - 1) * node.bytes) AS saved
  FROM sub JOIN node ON node.p = sub.p AND node.d = sub.d LEFT JOIN kids ON kids.p = sub.p GROUP BY top
), fin AS (
  SELECT path.p, string_agg(CAST(path.c AS VARCHAR), ',' ORDER BY path.c) AS ids FROM path JOIN l ON l.c = path.c AND l.n = path.d GROUP BY path.p
)
SELECT node.conv_id, node.d AS depth, up.conv_id AS parent_conv_id, node.n AS n_convs, coalesce(kids.n, 0) AS n_children,
  leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM node JOIN total ON total.top = node.p LEFT JOIN kids ON kids.p = node.p LEFT JOIN node up ON up.p = node.q LEFT JOIN fin ON fin.p = node.p
"""
