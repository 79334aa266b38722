"""Near-duplicate embeddings by an exact metric range join.

Unit vectors at cosine c are sqrt(2 - 2c) apart, so similar pairs are a range join in a metric space. Each vector lies in
the cell of its nearest pivot. By the triangle inequality a vector within *r* of one that belongs to pivot *p* is at most
its own pivot distance plus 2 *r* away from *p*; only to the cells for which that holds need it go. Cells are cut into
units of bounded size, and a unit is one row of a table that is written once: a product of that table with itself meets
each pair of units that may hold a link in one of two tasks. Tasks read the units where they lie, so what is shuffled and
written grows with the vectors, however many units a vector has to meet. Links are counted, not listed; a task reports
sums and a spanning forest.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import components
from .scratch import materialize

UNIT = 2048  #: vectors that a unit owns, about
UNIT_BYTES = 4 << 20  #: of them, about; longer vectors have smaller units
FILE = 4  #: units of a file, about: a task of the product reads some files of either side
PIVOTS = 1024  #: at most; more cells than that are units of the same pivot
MEETINGS = 1 << 20  #: pairs of vectors, or of a vector and a pivot, that are looked at at once
SLACK = 1e-7  #: of distances
BITS = 32  #: of a node's place in its unit


def _units(x: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled by the largest component first, so that no square over- or underflows."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return x


def _binary(rows: list[np.ndarray] | np.ndarray) -> pa.Array:
    """A binary value for each array, or for each row of a matrix."""
    ends = np.cumsum([0, *(r.nbytes for r in rows)]).astype(np.int32)
    data = rows.tobytes() if isinstance(rows, np.ndarray) else b"".join(r.tobytes() for r in rows)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])


def _normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids, vectors as bytes and 128 bits of a hash of their direction; nulls where a vector is null, zero, empty or not
    finite."""
    for batch in batches:
        ids, column = batch.columns
        begin, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
        size = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(begin), 0)
        dead = [np.flatnonzero(size == 0)]
        for length in np.unique(size[size > 0]).tolist():
            rows = np.flatnonzero(size == length)
            x = values[begin[:-1][rows][:, None] + np.arange(length)]  # null components have become NaN
            ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            dead.append(rows[~ok])
            rows, x = rows[ok], x[ok]
            if len(rows):
                key = np.frombuffer(b"".join(hashlib.blake2b(u.tobytes(), digest_size=16).digest() for u in _units(x)), np.int64).reshape(-1, 2)
                yield pa.record_batch([ids.take(pa.array(rows)), pa.array(key[:, 0]), pa.array(key[:, 1]), _binary(x)], names=["id", "hi", "lo", "v"])
        rows = np.concatenate(dead)
        if len(rows):
            none = [pa.nulls(len(rows), t) for t in (pa.int64(), pa.int64(), pa.binary())]
            yield pa.record_batch([ids.take(pa.array(rows)), *none], names=["id", "hi", "lo", "v"])


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Vectors of one length."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), -1)


def _by_length(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of each length of vector."""
    lengths = np.diff(np.frombuffer(batch.column("v").buffers()[1], dtype=np.int32)[batch.column("v").offset :][: batch.num_rows + 1]) // width
    for length in np.unique(lengths).tolist():
        yield length, batch.take(pa.array(np.flatnonzero(lengths == length)))


def _assigned(batches: Iterator[pa.RecordBatch], pivots, kind: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of one length with the cells of their nearest pivots."""
    for batch in batches:
        for length, part in _by_length(batch, np.dtype(kind).itemsize):
            first, p = pivots.value[length]
            yield part, first + (_units(_matrix(part.column("v"), kind)) @ p.T).argmax(axis=1)


def _assign(pivots, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, cell in _assigned(batches, pivots, kind):
            yield pa.record_batch([part.column("hi"), part.column("lo"), pa.array(cell, pa.int32())], names=["hi", "lo", "cell"])

    return run


def _deal(pivots, units, kind: str):
    """Vectors with their units; what a batch has several times goes once, with its number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, parts = units.value
        for part, cell in _assigned(batches, pivots, kind):
            hi, lo = part.column("hi").to_numpy(), part.column("lo").to_numpy()
            order = np.lexsort((lo, hi))
            new = np.append(True, (np.diff(hi[order]) != 0) | (np.diff(lo[order]) != 0))
            at, n = order[new], np.diff(np.append(np.flatnonzero(new), len(order)))
            unit = first[cell[at]] + (hi[at].view(np.uint64) >> np.uint64(7)).astype(np.int64) % parts[cell[at]]
            some = part.select(["hi", "lo", "v"]).take(pa.array(at))
            cols = [pa.array(unit, pa.int32()), pa.array(cell[at], pa.int32()), *some.columns, pa.array(n, pa.int64())]
            yield pa.record_batch(cols, names=["unit", "cell", "hi", "lo", "v", "n"])

    return run


_UNITS = "unit int, cell int, first int, length int, hi binary, lo binary, n binary, v binary, near array<boolean>"
_MET = ("unit", "cell", "first", "length", "n", "v", "near")


def _pack(pivots, kind: str, reach: float, meetings: int):
    """A row for each unit, of rows that are sorted by unit and direction, with the cells (of its length, from ``first``)
    that one of its vectors has to meet."""

    def packed(unit: int, cell: int, parts: list[tuple]) -> pa.RecordBatch:
        hi, lo, n = (np.concatenate([p[k] for p in parts]) for k in range(3))
        new = np.flatnonzero(np.append(True, (np.diff(hi) != 0) | (np.diff(lo) != 0)))
        v = np.concatenate([p[3] for p in parts])[new]
        first, p = pivots.value[v.shape[1]]
        near, step = np.zeros(len(p), dtype=bool), max(1, meetings // len(p))
        for a in range(0, len(v), step):
            d = np.sqrt(np.maximum(2 - 2 * (_units(v[a : a + step]) @ p.T), 0))
            near |= (d <= d[:, cell - first][:, None] + 2 * reach + SLACK).any(axis=0)
        numbers = [pa.array([x], pa.int32()) for x in (unit, cell, first, v.shape[1])]
        data = [_binary([x]) for x in (hi[new], lo[new], np.add.reduceat(n, new), v)]
        return pa.record_batch([*numbers, *data, pa.array([near.tolist()])], names=[f.split()[0] for f in _UNITS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            # A cell's vectors have one length, and a unit lies in one cell.
            key = np.stack([batch.column("unit").to_numpy(), batch.column("cell").to_numpy()], axis=1)
            edge = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *edge], [*edge, batch.num_rows], strict=True):
                if a == b:
                    continue
                if tuple(key[a]) != now:
                    if parts:
                        yield packed(*now, parts)
                    now, parts = tuple(key[a].tolist()), []
                part = batch.slice(a, b - a)
                parts.append((*(part.column(c).to_numpy() for c in ("hi", "lo", "n")), _matrix(part.column("v"), kind)))
        if parts:
            yield packed(*now, parts)

    return run


def _similar(a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
    """Pairs at ``cosine`` or more; what rounding in the product could decide is summed again exactly."""
    return _decided(a @ b.T, lambda i, j: (a[i], b[j]), cosine)


def _decided(s: np.ndarray, pair, cosine: float) -> np.ndarray:
    hit = s >= cosine
    for at in zip(*np.nonzero(np.abs(s - cosine) < 1e-12), strict=True):
        x, y = pair(*at)
        hit[at] = math.fsum((x * y).tolist()) >= cosine
    return hit


class _Side:
    """A unit's unit vectors and how often each occurs. Single precision tells which pairs are worth a second look."""

    def __init__(self, unit: int, n: bytes, v: bytes, length: int, kind: str):
        self.unit, self.n = unit, np.frombuffer(n, dtype=np.int64)
        self.v = _units(np.frombuffer(v, dtype=kind).reshape(-1, length))
        self.single = self.v.astype(np.float32)

    def near(self, own: np.ndarray, other: np.ndarray, reach: float) -> np.ndarray:
        """Those that may have links among vectors of another pivot."""
        d, e = (np.sqrt(np.maximum(2 - 2 * (self.v @ p), 0)) for p in (own, other))
        return np.flatnonzero(e <= d + 2 * reach + SLACK)


def _pairs(a: _Side, b: _Side, ia: np.ndarray, ib: np.ndarray, cosine: float, meetings: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of the vectors ``ia`` of one unit and ``ib`` of another; of the same unit each pair once."""
    length = a.v.shape[1]
    low = np.float32(cosine - (length + 8) * 2.0**-23)  # a sum of so many products of single precision is nearer than that
    left, right = a.single[ia], b.single[ib]
    step = max(1, meetings // len(ib))
    for at in range(0, len(ia), step):
        maybe = left[at : at + step] @ right.T >= low
        n = np.count_nonzero(maybe)
        if n * 64 > maybe.size:
            i, j = np.nonzero(_similar(a.v[ia[at : at + step]], b.v[ib], cosine))
            i, j = ia[at + i], ib[j]
        elif n:
            i, j = np.nonzero(maybe)
            i, j = ia[at + i], ib[j]
            x, y = a.v[i], b.v[j]
            hit = _decided(np.einsum("ij,ij->i", x, y), lambda k, x=x, y=y: (x[k], y[k]), cosine)
            i, j = i[hit], j[hit]
        else:
            continue
        if a.unit == b.unit:
            i, j = i[i < j], j[i < j]
        if len(i):
            yield i, j


class _Forest:
    """Links of the units that a task has met: their sums, and a forest over all of them."""

    def __init__(self):
        self.begin: dict[int, int] = {}
        self.node, self.up, self.links = (np.zeros(0, dtype=np.int64) for _ in range(3))

    def place(self, side: _Side) -> int:
        if side.unit not in self.begin:
            at, k = np.arange(len(side.n)), len(self.node)
            self.begin[side.unit] = k
            self.node = np.append(self.node, (side.unit << BITS) + at)
            self.up, self.links = np.append(self.up, k + at), np.append(self.links, np.zeros(len(at), dtype=np.int64))
        return self.begin[side.unit]

    def find(self, x: int) -> int:
        up = self.up
        while (y := int(up[x])) != x:
            up[x] = up[y]
            x = int(up[x])
        return x

    def join(self, p: np.ndarray, q: np.ndarray) -> Iterator[tuple[int, int]]:
        """The links that join two trees."""
        for x, y in zip(p.tolist(), q.tolist(), strict=True):
            if (x := self.find(x)) != (y := self.find(y)):
                self.up[x] = y
                yield int(self.node[x]), int(self.node[y])

    def meet(self, a: _Side, b: _Side, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[int, int]]:
        p, q = self.place(a), self.place(b)
        for at, other, n in ((p + i, j, b.n), (q + j, i, a.n)):
            np.add.at(self.links, at, n[other])
        p, q = p + i, q + j
        if len(p) > 2 * (len(a.n) + len(b.n)):
            # A link of each vector joins most of them; of the rest, those that lie in different trees are seen at once.
            for side in (p, q):
                some = np.unique(side, return_index=True)[1]
                yield from self.join(p[some], q[some])
            while (self.up != (up := self.up[self.up])).any():
                self.up = up
            p, q = self.up[p], self.up[q]
            p, q = np.unique(np.stack([p, q])[:, p != q], axis=1)
        yield from self.join(p, q)


def _meet(pivots, kind: str, cosine: float, reach: float, meetings: int):
    """Links of each pair of units: (node, links, other node or null)."""

    def rows(node, links, other) -> pa.RecordBatch:
        return pa.record_batch([pa.array(x, pa.int64()) for x in (node, links, other)], names=["node", "links", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, a, out = _Forest(), None, []
        for batch in batches:
            for r in range(batch.num_rows):
                x = {c: batch.column(c)[r] for c in batch.schema.names}
                length, units = x["length_a"].as_py(), [x[f"unit_{c}"].as_py() for c in "ab"]
                if a is None or a.unit != units[0]:
                    a = _Side(units[0], x["n_a"].as_py(), x["v_a"].as_py(), length, kind)
                b = a if units[1] == a.unit else _Side(units[1], x["n_b"].as_py(), x["v_b"].as_py(), length, kind)
                ia, ib = np.arange(len(a.n)), np.arange(len(b.n))
                if (cells := [x[f"cell_{c}"].as_py() for c in "ab"])[0] != cells[1]:
                    first, p = pivots.value[length]
                    own, other = p[cells[0] - first], p[cells[1] - first]
                    ia, ib = a.near(own, other, reach), b.near(other, own, reach)
                    if not (len(ia) and len(ib)):
                        continue
                for i, j in _pairs(a, b, ia, ib, cosine, meetings):
                    out.extend(forest.meet(a, b, i, j))
                if len(out) > 50_000:
                    yield rows([u for u, _ in out], [0] * len(out), [v for _, v in out])
                    out.clear()
        yield rows([u for u, _ in out], [0] * len(out), [v for _, v in out])
        some = np.flatnonzero(forest.links)
        for at in range(0, len(some), 100_000):
            part = some[at : at + 100_000]
            yield rows(forest.node[part], forest.links[part], pa.nulls(len(part), pa.int64()))

    return run


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The directions of units, one by one."""
    for batch in batches:
        for unit, *data in zip(*(batch.column(c).to_pylist() for c in ("unit", "hi", "lo", "n")), strict=True):
            cols = [np.frombuffer(x, dtype=np.int64) for x in data]
            yield pa.record_batch([pa.array((unit << BITS) + np.arange(len(cols[0]))), *map(pa.array, cols)], names=["node", "hi", "lo", "n"])


def _within(share: dict[int, float], length: Column, turn: Column) -> Column:
    """Whether ``turn``, even between 0 and 1, is within its length's share."""
    if not share:
        return F.lit(False)
    return turn <= F.create_map(*[F.lit(x) for pair in share.items() for x in pair])[length]


def _choose_pivots(live: DataFrame, length: Column, kind: str, seed: int) -> dict[int, tuple[int, np.ndarray]]:
    """Pivots of each length in proportion to its directions, with the number of the first; a length of one cell has any."""
    sizes = dict(live.select("hi", "lo", length.alias("length")).distinct().groupBy("length").count().collect())
    total = sum(sizes.values())
    cells = {k: max(1, min(PIVOTS * n // total, math.ceil(n / _unit_size(k, kind)))) for k, n in sorted(sizes.items())}
    # By a hash, some more than are wanted; copies of one are seen once.
    share = {k: min(1.0, (n + 4 * math.sqrt(n) + 32) / sizes[k]) for k, n in cells.items() if n > 1}
    turn = F.pmod(F.xxhash64(F.lit(seed), "hi", "lo"), F.lit(1 << 40)) / float(1 << 40)
    some = live.where(_within(share, length, turn)).groupBy("hi", "lo").agg(F.min("v").alias("v"), F.min(turn).alias("turn"))
    picked: dict[int, list] = {}
    for r in sorted(some.collect(), key=lambda r: (r.turn, r.hi, r.lo)) if share else ():
        picked.setdefault(len(r.v) // np.dtype(kind).itemsize, []).append(bytes(r.v))
    table, first = {}, 0
    for k, n in cells.items():
        v = picked.get(k, [])[:n]
        table[k] = (first, _units(np.frombuffer(b"".join(v), dtype=kind).reshape(-1, k)) if v else np.eye(1, k))
        first += len(table[k][1])
    return table


def _unit_size(length: int, kind: str) -> int:
    return max(1, min(UNIT, UNIT_BYTES // (length * np.dtype(kind).itemsize)))


def similar_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, seed: int = 3
) -> DataFrame:
    """One row per input row: ``id_col``, ``n_links`` (other rows at ``cosine`` or more), ``component_id`` (smallest id
    reachable over links, itself included) and ``kept``.

    Rows of one direction are collapsed first, so copies cost one vector however many there are. Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing; others only with vectors of their own length,
    which have pivots and cells of their own (at least one for each length that occurs). Rows with a null id count as neighbours but have a null component and are kept. Rows of the same id are separate rows of one
    node. An empty table gives an empty result. Other columns are ignored.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema[id_col].dataType
    # Vectors keep the precision that they come in; all sums are of doubles.
    single = vectors.schema[vector_col].dataType == T.ArrayType(T.FloatType(), vectors.schema[vector_col].dataType.containsNull)
    kind, embedding = ("<f4", F.col(vector_col)) if single else ("<f8", F.col(vector_col).cast("array<double>"))
    fields = [T.StructField("id", id_type), T.StructField("hi", T.LongType()), T.StructField("lo", T.LongType()), T.StructField("v", T.BinaryType())]
    rows = vectors.select(F.col(id_col).alias("id"), embedding.alias("embedding")).mapInArrow(_normal, T.StructType(fields))
    rows = materialize(rows, "vector-rows")
    live, length = rows.where("v is not null"), (F.octet_length("v") / np.dtype(kind).itemsize).cast("int")
    table = _choose_pivots(live, length, kind, seed)
    pivots = spark.sparkContext.broadcast(table)
    vectors_of = live.select("hi", "lo", "v")
    counts = vectors_of.mapInArrow(_assign(pivots, kind), "hi long, lo long, cell int").distinct()
    counts = dict(counts.groupBy("cell").count().collect())  # a row for each cell
    sizes = [_unit_size(k, kind) for k, (_, p) in table.items() for _ in p]
    parts = np.array([max(1, math.ceil(counts.get(c, 0) / s)) for c, s in enumerate(sizes)], dtype=np.int64)
    units = spark.sparkContext.broadcast((np.cumsum(parts) - parts, parts))
    dealt = vectors_of.mapInArrow(_deal(pivots, units, kind), "unit int, cell int, hi long, lo long, v binary, n long")
    dealt = dealt.repartition(max(1, math.ceil(int(parts.sum()) / FILE)), "unit").sortWithinPartitions("unit", "cell", "hi", "lo")
    reach = math.sqrt(2 - 2 * cosine)
    packed = materialize(dealt.mapInArrow(_pack(pivots, kind, reach, MEETINGS), _UNITS), "vector-units")
    a, b = (packed.select(*_MET).toDF(*[f"{c}_{side}" for c in _MET]) for side in "ab")
    may = F.get("near_a", F.col("cell_b") - F.col("first_b")) & F.get("near_b", F.col("cell_a") - F.col("first_a"))
    # Of two units either is the left one, by turns; the product reads both sides where they lie.
    turns = (F.col("unit_a") < F.col("unit_b")) == ((F.col("unit_a") + F.col("unit_b")) % 2 == 0)
    meets = (F.col("first_a") == F.col("first_b")) & may & ((F.col("unit_a") == F.col("unit_b")) | turns)
    met = a.hint("shuffle_replicate_nl").join(b, meets)
    found = materialize(met.mapInArrow(_meet(pivots, kind, cosine, reach, MEETINGS), "node long, links long, other long"), "vector-links")
    counted = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.where("other is not null").select(F.col("node").alias("u"), F.col("other").alias("v")))
    nodes = packed.select("unit", "hi", "lo", "n").mapInArrow(_members, "node long, hi long, lo long, n long")
    known = nodes.join(counted, "node", "left").join(groups, "node", "left")
    n_links, component = F.coalesce("links", F.lit(0)) + F.col("n") - 1, F.coalesce("component", "node")
    # Copies that rounding has put into two cells are two nodes, linked, with the same neighbours: either tells all.
    known = known.groupBy("hi", "lo").agg(F.max(n_links).alias("n_links"), F.min(component).alias("component"))
    known = known.join(live.groupBy("hi", "lo").agg(F.min("id").alias("first")), ["hi", "lo"])
    least = known.groupBy("component").agg(F.min("first").alias("component_id"))
    known = known.join(least, "component").select("hi", "lo", "n_links", "component_id")
    out = live.select("id", "hi", "lo").join(known, ["hi", "lo"]).select("id", "n_links", "component_id")
    out = out.unionByName(rows.where("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    component = F.when(F.col("id").isNotNull(), F.col("component_id"))
    return out.select(
        F.col("id").alias(id_col),
        F.col("n_links").cast("long").alias("n_links"),
        component.cast(id_type).alias("component_id"),
        (F.col("id").isNull() | (F.col("id") == component)).alias("kept"),
    )


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), r AS (
  SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT l.v, r.root FROM r JOIN l ON r.node = l.u
), c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT e.vec_id, CAST((SELECT count(*) FROM l WHERE l.u = e.vec_id) AS BIGINT) AS n_links, component_id,
  e.vec_id = component_id AS kept
FROM embeddings e JOIN c ON node = e.vec_id
"""
