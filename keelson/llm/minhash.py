"""Near-duplicate texts by SetSketch registers.

A text's set of word shingles is sketched as ``M`` registers. Register *i* holds ``floor(1 - log_b min x)`` over the
set, truncated to 16 bits, where the *x* of an element and register are exponential variates fixed by the element's
fingerprint. Equal sets give equal registers, the registers of a union are the maxima of both, and with a base near
1 two registers agree with a probability close to the Jaccard similarity.

1. sketch every text (one pass, Arrow batches);
2. collapse equal sets to their smallest id, so copies cost one row however many there are;
3. band the registers; texts whose bands fall into common buckets get a common region;
4. pack a region's registers and full shingle sets into blocks of bounded size and compare each pair of blocks in a task
   of its own: pairs that share a band and for which the joint likelihood of both sketches leaves the wanted similarity
   tenable are confirmed on the sets, unless links already connect them. Only a spanning forest leaves the task;
5. contract the links to components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import components
from .scratch import materialize
from .words import Words, chunks, mix, tidy

M = 128  #: registers
ROWS = 4  #: registers in a band: 32 bands, so a pair at similarity 0.8 is missed with probability 5e-8
BASE = 1.001
RATE = 20.0
TOP = 65535
DOUBT = 12.0  #: log-likelihood by which the wanted similarity may fall short of the best one
BLOCK_BYTES = 1 << 20  #: shingles and registers in a block of the last comparison
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACES = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle fingerprints of each text, end to end, and the offsets of the texts in them."""
    w = Words(data, offsets)
    h = w.hashes(lower=True)
    n = w.count
    full = np.maximum(n - k + 1, 0)
    size = np.where(full > 0, full, (n > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(at[-1], dtype=np.uint64)
    if len(h) >= k:
        runs = np.zeros(len(h) - k + 1, dtype=np.uint64)
        for j in range(k):
            runs += h[j : len(h) - k + 1 + j] * _PLACES[j]
        runs = mix(runs)
        long = np.flatnonzero(full)
        pos = np.repeat(w.first[:-1][long] - (np.cumsum(full[long]) - full[long]), full[long]) + np.arange(full.sum())
        where = np.repeat(at[:-1][long] - (np.cumsum(full[long]) - full[long]), full[long]) + np.arange(full.sum())
        out[where] = runs[pos]
    for i in np.flatnonzero((n > 0) & (full == 0)):
        part = h[w.first[i] : w.first[i + 1]]
        out[at[i]] = mix(np.atleast_1d((part * _PLACES[: len(part)]).sum(dtype=np.uint64) + np.uint64(len(part))))[0]
    for a, b in zip(at[:-1], at[1:], strict=True):
        out[a:b].sort()
    fresh = np.ones(len(out), dtype=bool)
    if len(out):
        fresh[1:] = out[1:] != out[:-1]
        fresh[at[:-1][size > 0]] = True
    kept = np.concatenate([[0], np.cumsum(fresh)])
    return out[fresh], kept[at]


def registers(elements: np.ndarray, at: np.ndarray) -> np.ndarray:
    """SetSketch registers (uint16, texts x M) of the sets ``elements[at[i]:at[i + 1]]``; zeros for empty sets.

    An element's points form a Poisson process over all registers, generated in ascending order and only up to the
    value above which no register of that set's size can still change. Sets with an unfilled register are redone with
    a larger bound, so the bound never shows in the result.
    """
    count = np.diff(at)
    least = np.full((len(count), M), np.inf)
    bound = (math.log(M) + 3.0) / np.maximum(count, 1)
    todo = count > 0
    owner = np.repeat(np.arange(len(count)), count)
    while todo.any():
        mine = todo[owner]
        seed, doc = elements[mine], owner[mine]
        x, most = np.zeros(len(seed)), bound[doc]
        flat = least.reshape(-1)
        while len(seed):
            seed = seed + _STEP
            z = mix(seed)
            x = x - np.log(((z >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / M
            live = x < most
            seed, x, doc, most, z = seed[live], x[live], doc[live], most[live], z[live]
            np.minimum.at(flat, doc * M + (z & np.uint64(M - 1)).astype(np.int64), x)
        todo &= ~np.isfinite(least).all(axis=1)
        bound[todo] *= 2
    out = np.zeros((len(count), M), dtype=np.uint16)
    some = count > 0
    out[some] = np.clip(np.floor(1 - np.log(least[some] / RATE) / math.log(BASE)), 0, TOP)
    return out


def plausible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float) -> np.ndarray:
    """Whether similarity ``least`` or more is tenable, judged by the sizes and the joint likelihood of all registers.

    The size test is made on whole numbers, so that a set of exactly the wanted share of another isn't lost to rounding;
    the ratio in floating point only bounds the similarities whose likelihoods are compared.
    """
    fits = 100 * np.minimum(na, nb) >= round(100 * least, 6) * np.maximum(na, nb)
    above, below = (a > b).sum(axis=1), (a < b).sum(axis=1)
    na, nb = na.astype(np.float64), nb.astype(np.float64)
    u, v = na / (na + nb), nb / (na + nb)
    most = np.minimum(u / v, v / u)
    grid = np.concatenate([np.linspace(0, least, 33)[:-1], np.linspace(least, 1, 24)])
    j = np.minimum(grid[None, :], most[:, None])

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-x * (BASE - 1) / BASE) / math.log(BASE)

    up = np.clip(p(u[:, None] - v[:, None] * j), 1e-12, 1)
    down = np.clip(p(v[:, None] - u[:, None] * j), 1e-12, 1)
    same = np.clip(1 - up - down, 1e-12, 1)
    ll = above[:, None] * np.log(up) + below[:, None] * np.log(down) + (M - above - below)[:, None] * np.log(same)
    high = np.where(grid[None, :] >= least, ll, -np.inf).max(axis=1)
    return fits & (high >= ll.max(axis=1) - DOUBT)


def _sketch_batches(k: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for a, b, data, offsets in chunks(batch.column(1)):
                elements, at = shingles(data, offsets, k)
                n = np.diff(at)
                # The sums of two remixes of a set's elements name the set: 128 bits, whatever the order.
                name = np.zeros((2, b - a), dtype=np.uint64)
                if len(elements):
                    for i, salt in enumerate((_PLACES[10], _PLACES[11])):
                        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(elements ^ salt), dtype=np.uint64)])
                        name[i] = total[at[1:]] - total[at[:-1]]
                sketch = registers(elements, at)
                yield pa.record_batch(
                    [
                        ids.slice(a, b - a),
                        pa.array(n, pa.int64()),
                        pa.array(name[0].view(np.int64)),
                        pa.array(name[1].view(np.int64)),
                        pa.array([row.tobytes() for row in sketch], pa.binary()),
                    ],
                    names=["id", "n", "lo", "hi", "sketch"],
                )

    return run


def _band_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bands = M // ROWS
    for batch in batches:
        if not batch.num_rows:
            continue
        reg = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint64).reshape(-1, bands)
        key = mix(reg + np.arange(1, bands + 1, dtype=np.uint64) * _PLACES[20])
        ids = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), bands)))
        yield pa.record_batch([pa.array(key.reshape(-1).view(np.int64)), ids], names=["key", "id"])


def _set_batches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(1)):
                elements, at = shingles(data, offsets, k)
                sets = [elements[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(sets, pa.binary())], names=["id", "elements"])

    return run


def _pack(table: pa.Table) -> pa.Table:
    """One row of a block's members."""
    sets = table.column("elements").to_pylist()
    return pa.table(
        {
            "area": table.column("area").slice(0, 1),
            "blocks": table.column("blocks").slice(0, 1),
            "block": table.column("block").slice(0, 1),
            "ids": pa.array([table.column("id").to_pylist()], pa.list_(table.schema.field("id").type)),
            "sketches": pa.array([b"".join(table.column("sketch").to_pylist())], pa.binary()),
            "ends": pa.array([np.cumsum([len(x) // 8 for x in sets]).astype(np.int64).tobytes()], pa.binary()),
            "elements": pa.array([b"".join(sets)], pa.binary()),
        }
    )


class _Block:
    def __init__(self, row: dict):
        self.ids = row["ids"]
        self.reg = np.frombuffer(row["sketches"], dtype=np.uint16).reshape(-1, M)
        self.bands = self.reg.view(np.uint64)
        self.end = np.frombuffer(row["ends"], dtype=np.int64)
        self.n = np.diff(self.end, prepend=0)
        self.elements = np.frombuffer(row["elements"], dtype=np.uint64)

    def set_of(self, i: int) -> np.ndarray:
        return self.elements[self.end[i] - self.n[i] : self.end[i]]


def _similar(small: np.ndarray, large: np.ndarray, percent: int) -> bool:
    """The exact test on two sorted sets."""
    if len(small) > len(large):
        small, large = large, small
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(small) + len(large) - both)


def _links(a: _Block, b: _Block, percent: int) -> Iterator[tuple[int, int]]:
    """Links between two blocks, or within one, between texts that nothing connects yet: a spanning forest of them.

    A text meets the texts that share a band, the most similar ones first; those of its own component are left out, so in a
    tight group a text is tested about once.
    """
    number: dict = {}
    mine = np.array([number.setdefault(x, len(number)) for x in a.ids], dtype=np.int64)
    other = mine if a is b else np.array([number.setdefault(x, len(number)) for x in b.ids], dtype=np.int64)
    for u in range(len(a.ids)):
        end = u if a is b else len(b.ids)
        near = np.flatnonzero((b.bands[:end] == a.bands[u]).any(axis=1) & (other[:end] != mine[u]))
        near = near[np.argsort(-(b.reg[near] == a.reg[u]).sum(axis=1), kind="stable")]
        width = 16
        while len(near):
            part, near = near[:width], near[width:]
            size = np.full(len(part), a.n[u])
            ok = plausible(np.broadcast_to(a.reg[u], (len(part), M)), b.reg[part], size, b.n[part], percent / 100)
            for v in part[ok].tolist():
                if other[v] != mine[u] and _similar(a.set_of(u), b.set_of(v), percent):
                    old, new = other[v], mine[u]
                    mine[mine == old] = new
                    if other is not mine:
                        other[other == old] = new
                    yield u, v
            near = near[other[near] != mine[u]]
            width = 1024


def _compare(percent: int):
    """Links of each row's block with itself, or of its two blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field(0).type.field("ids").type.value_type
            for row in zip(*batch.columns, strict=True):
                blocks = [_Block(x.as_py()) for x in row]
                a, b = blocks[0], blocks[-1]
                found = [(a.ids[u], b.ids[v]) for u, v in _links(a, b, percent)]
                yield pa.record_batch([pa.array([f[i] for f in found], kind) for i in (0, 1)], names=["a", "b"])

    return run


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80
) -> DataFrame:
    """Group texts whose sets of distinct ``k``-word shingles have a Jaccard similarity of ``percent`` % or more.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a text of fewer than ``k`` words counts as one shingle.
    Returns one row per input row: ``id_col``, ``n_shingles``, ``component_id`` (smallest id reachable over links,
    itself included) and ``kept``. Other columns of ``docs`` are ignored, whatever their names.

    Null and empty texts have no shingles and link with nothing. Rows that share an id count as one document that links
    through any of its texts. Rows with a null id link with nothing, have a null component and are kept. An empty table
    gives an empty result.
    """
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType(
        [
            T.StructField("id", kind),
            T.StructField("n", T.LongType()),
            T.StructField("lo", T.LongType()),
            T.StructField("hi", T.LongType()),
            T.StructField("sketch", T.BinaryType()),
        ]
    )
    sketches = materialize(rows.mapInArrow(tidy(_sketch_batches(k, kind)), schema), "sketches")
    live = sketches.where("n > 0 and id is not null")
    classes = live.groupBy("lo", "hi").agg(F.min("id").alias("id"))
    firsts = materialize(
        live.join(classes, ["lo", "hi", "id"], "left_semi").dropDuplicates(["id", "lo", "hi"]).select("id", "n", "sketch"),
        "classes",
    )
    bands = firsts.select("id", "sketch").mapInArrow(
        tidy(_band_batches), T.StructType([T.StructField("key", T.LongType()), T.StructField("id", kind)])
    )
    bands = materialize(bands, "bands")
    shared = bands.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high")
    buckets = materialize(bands.join(shared.select("key", "low"), "key"), "buckets")

    # Buckets that hang together get one region: the smallest id two steps away. Texts that share a bucket share its region.
    near = buckets.groupBy("id").agg(F.min("low").alias("low"))
    region = buckets.select("key", "id").join(near, "id").groupBy("key").agg(F.min("low").alias("region"))
    members = buckets.select("key", "id").join(region, "key").select("id", "region").distinct()
    members = materialize(members.join(firsts, "id"), "members")
    cost = 8 * F.col("n") + 2 * M
    regions = members.groupBy("region").agg(F.sum(cost).alias("bytes"))
    regions = materialize(regions.withColumn("blocks", F.ceil(F.col("bytes") / BLOCK_BYTES).cast("int")), "region-sizes")
    small = regions.where("blocks = 1").agg(F.sum("bytes")).first()[0] or 0
    pools = max(1, math.ceil(small / BLOCK_BYTES))
    # Small regions are pooled, large ones cut into blocks.
    pool = F.concat(F.lit("pool "), F.pmod(F.xxhash64("region"), F.lit(pools)).cast("string"))
    place = regions.select(
        "region", "blocks", F.when(F.col("blocks") == 1, pool).otherwise(F.col("region").cast("string")).alias("area")
    )
    place = materialize(place, "regions")
    members = members.join(place, "region").select(
        "id", "area", "sketch", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block")
    )
    sets = T.StructType([T.StructField("id", kind), T.StructField("elements", T.BinaryType())])
    texts = rows.where("text is not null").join(members.select("id").distinct(), "id", "left_semi").distinct()
    packed = members.join(texts.mapInArrow(tidy(_set_batches(k)), sets), "id")
    row = T.StructType(
        [
            T.StructField("area", T.StringType()),
            T.StructField("blocks", T.IntegerType()),
            T.StructField("block", T.IntegerType()),
            T.StructField("ids", T.ArrayType(kind)),
            T.StructField("sketches", T.BinaryType()),
            T.StructField("ends", T.BinaryType()),
            T.StructField("elements", T.BinaryType()),
        ]
    )
    packed = materialize(packed.groupBy("area", "block").applyInArrow(_pack, row), "blocks")
    body = F.struct("ids", "sketches", "ends", "elements")
    large = packed.where("blocks > 1")
    one = large.select(
        "area", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"), body.alias("one")
    ).where("i < j")
    two = large.select(
        "area", F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"), body.alias("two")
    ).where("i < j")
    meetings = one.join(two, ["area", "i", "j"]).select("one", "two")
    pair = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    links = packed.select(body.alias("one")).mapInArrow(tidy(_compare(percent)), pair)
    links = links.unionByName(meetings.mapInArrow(tidy(_compare(percent)), pair))
    groups = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))

    named = classes.join(groups.withColumnRenamed("node", "id"), "id", "left").select(
        "lo", "hi", F.coalesce("component", "id").alias("component")
    )
    whole = sketches.join(named, ["lo", "hi"], "left")
    component = F.when(F.col("id").isNull() | (F.col("n") == 0), F.col("id")).otherwise(F.col("component"))
    return whole.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        (F.col("id").isNull() | (F.col("id") == component)).alias("kept"),
    )


SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i : i + 3], ' ')) END) AS shingle FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)
), e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.v, r.root FROM r JOIN e ON r.node = e.u),
g AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN g ON node = d.doc_id
"""
