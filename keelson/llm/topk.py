"""Exact top-k inner products on a bit-sliced index.

Rows are packed into blocks. A block keeps, for every dimension, the quantised values as bitmaps over its rows, one for
each binary digit (offset to be non-negative). A query's scores are summed by bitmap arithmetic: the slices of dimension
*j*, shifted by the digits of the query's weight, go through carry-save adders into slices of the sum. The highest rows
are found from the most significant slice downward; ties at the border are resolved exactly by id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .scratch import materialize

BLOCK = 16384  #: rows in a block
QUERIES = 4096  #: queries in a block
LIMIT = 1 << 62  #: quantised components stop there


def slices(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps (dimensions x digits x words) of integer rows, and what was subtracted from each dimension."""
    low = values.min(axis=0)
    shifted = values.astype(np.uint64) - low.astype(np.uint64)  # modulo 2**64, where every difference fits
    digits = max(1, int(shifted.max()).bit_length())
    words = -(-len(values) // 64)
    bits = np.zeros((values.shape[1], digits, words * 64), dtype=np.uint8)
    for d in range(digits):
        bits[:, d, : len(values)] = ((shifted >> np.uint64(d)) & np.uint64(1)).T
    return np.packbits(bits, axis=2, bitorder="little").view(np.uint64), low


def _add(level: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
    """Sum bitmaps of equal and different weights: the slices of the result, least significant first."""
    out, w = [], 0
    while level:
        have = level.pop(w, [])
        stack = np.concatenate(have) if have else None
        while stack is not None and len(stack) > 1:
            third = len(stack) // 3
            if third:
                a, b, c = stack[:third], stack[third : 2 * third], stack[2 * third : 3 * third]
                ab = a ^ b
                level.setdefault(w + 1, []).append((a & b) | (ab & c))
                stack = np.concatenate([ab ^ c, stack[3 * third :]])
            else:
                level.setdefault(w + 1, []).append(stack[:1] & stack[1:])
                stack = stack[:1] ^ stack[1:]
        out.append(stack[0] if stack is not None else None)
        w += 1
    return out


def _signed_digits(x: int) -> list[tuple[int, int]]:
    """(position, sign) of the non-adjacent form: the fewest additions of shifted slices."""
    out, p = [], 0
    while x:
        if x & 1:
            s = 2 - (x & 3)
            out.append((p, s))
            x -= s
        x >>= 1
        p += 1
    return out


def score_slices(bits: np.ndarray, weights: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Slices of the weighted sum of all dimensions for every row, and the constant to subtract from it.

    A negative digit adds the complement of its slice, which is the same sum shifted by a constant.
    """
    digits, words = bits.shape[1], bits.shape[2]
    level: dict[int, list[np.ndarray]] = {}
    offset = 0
    plus: dict[int, list[int]] = {}
    minus: dict[int, list[int]] = {}
    for j, x in enumerate(weights.tolist()):
        for p, s in _signed_digits(int(x)):
            (plus if s > 0 else minus).setdefault(p, []).append(j)
    for p, dims in plus.items():
        for d in range(digits):
            level.setdefault(p + d, []).append(bits[dims, d])
    for p, dims in minus.items():
        for d in range(digits):
            level.setdefault(p + d, []).append(~bits[dims, d])
        offset += len(dims) * ((1 << digits) - 1) << p
    zero = np.zeros(words, dtype=np.uint64)
    return [zero if s is None else s for s in _add(level)] or [zero], offset


def _count(x: np.ndarray) -> int:
    return int(np.bitwise_count(x).sum())


def highest(sums: list[np.ndarray], rows: np.ndarray, k: int) -> np.ndarray:
    """Bitmap of the rows with the ``k`` highest sums and of all that tie with the last of them."""
    sure, open_ = np.zeros_like(rows), rows.copy()
    for s in reversed(sums):
        high = open_ & s
        if (n := _count(sure) + _count(high)) > k:
            open_ = high
        else:
            sure |= high
            if n == k:
                return sure
            open_ &= ~s
    return sure | open_


def _positions(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def block_top(bits: np.ndarray, low: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of a block's ``k`` best rows for a query, without rows of the query's own id."""
    sums, offset = score_slices(bits, query)
    n = len(ids)
    rows = np.packbits(np.arange(bits.shape[2] * 64) < n, bitorder="little").view(np.uint64)
    if len(mine := np.flatnonzero(ids == own)):
        mask = np.zeros(bits.shape[2] * 64, dtype=np.uint8)
        mask[mine] = 1
        rows &= ~np.packbits(mask, bitorder="little").view(np.uint64)
    found = _positions(highest(sums, rows, k))
    score = np.zeros(len(found), dtype=np.int64 if len(sums) < 62 else object)
    for i, s in enumerate(sums):
        score += ((s[found >> 6] >> (found & 63).astype(np.uint64)) & np.uint64(1)).astype(score.dtype) << i
    # Whole numbers of any length until the scores are known; a score beyond 64 bits stops there.
    base = sum(a * b for a, b in zip(query.tolist(), low.tolist(), strict=True)) - offset
    best = sorted(zip((-(int(s) + base) for s in score), ids[found].tolist(), strict=True))[:k]
    top = np.iinfo(np.int64).max
    return np.array([i for _, i in best], dtype=np.int64), np.array([max(-top - 1, min(top, -s)) for s, _ in best], dtype=np.int64)


def _values(table: pa.Table) -> np.ndarray:
    return np.stack([np.frombuffer(x, dtype=np.int64) for x in table.column("values").to_pylist()])


def _pack_index(table: pa.Table) -> pa.Table:
    """A block of rows as its stored index: slices, lows and ids."""
    bits, low = slices(_values(table))
    return pa.table(
        {
            "dim": table.column("dim").slice(0, 1),
            "block": table.column("block").slice(0, 1),
            "ids": pa.array([table.column("id").to_numpy().astype(np.int64).tobytes()], pa.binary()),
            "bits": pa.array([bits.tobytes()], pa.binary()),
            "low": pa.array([low.tobytes()], pa.binary()),
            "digits": pa.array([bits.shape[1]], pa.int32()),
        }
    )


def _pack_queries(table: pa.Table) -> pa.Table:
    return pa.table(
        {
            "dim": table.column("dim").slice(0, 1),
            "block": table.column("block").slice(0, 1),
            "ids": pa.array([table.column("id").to_numpy().astype(np.int64).tobytes()], pa.binary()),
            "rows": pa.array([_values(table).tobytes()], pa.binary()),
        }
    )


def _quantise(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(1):
                v = np.array(x.as_py(), dtype=np.float64) if x.is_valid and x.values.null_count == 0 else np.array([np.nan])
                ok = len(v) and np.isfinite(v).all()
                out.append(np.clip(np.floor(scale * v), -LIMIT, LIMIT).astype(np.int64).tobytes() if ok else None)
            ids = batch.column(0)
            yield pa.record_batch([ids, pa.array(out, pa.binary())], names=["id", "values"])

    return run


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                asked, queries, ids, bits, low, digits = (x.as_py() for x in row)
                asked, ids, low = (np.frombuffer(x, dtype=np.int64) for x in (asked, ids, low))
                queries = np.frombuffer(queries, dtype=np.int64).reshape(len(asked), -1)
                bits = np.frombuffer(bits, dtype=np.uint64).reshape(len(low), digits, -1)
                q, v, s = [], [], []
                for a, w in zip(asked, queries, strict=True):
                    best, score = block_top(bits, low, ids, w, a, k)
                    q.append(np.full(len(best), a))
                    v.append(best)
                    s.append(score)
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in (q, v, s)], names=["query_id", "vec_id", "score"])

    return run


def top_inner_products(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    every: int = 50,
    k: int = 5,
    scale: float = 256.0,
) -> DataFrame:
    """The ``k`` rows of highest inner product of ``floor(scale * x)`` for each query: ``query_id``, ``rank``, ``vec_id``,
    ``score``; ties go to the smaller id. Queries are the rows whose id is divisible by ``every``; candidates are all
    rows of another id.

    Rows are dealt into blocks of about ``BLOCK`` rows by their place in the scan, so no key can make one large. A block's
    slices are made once and stored; they are smaller than the rows. Every block of queries meets every block of rows in
    a task of its own, and only ``k`` rows of each meeting move on. Null
    ids, null or empty vectors and vectors with null or non-finite components take no part; a query is compared with
    the rows of its own length. Components stop at 2**62 and scores at the range of a long. Rows that share an id and are queries are asked once (the smaller vector); as candidates they count as
    rows. No valid query gives an empty result. Other columns are ignored.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("values", T.BinaryType())])
    rows = materialize(rows.mapInArrow(_quantise(scale), schema).where("values is not null"), "quantised")
    queries = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("values").alias("values"))
    total, asked = rows.count(), queries.count()

    def blocks(df: DataFrame, n: int, pack, more: str) -> DataFrame:
        dim = (F.octet_length("values") / 8).cast("int")
        dealt = df.select("id", "values", dim.alias("dim"), F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int").alias("block"))
        return dealt.groupBy("dim", "block").applyInArrow(pack, f"dim int, block int, ids binary, {more}")

    nr, nq = max(1, math.ceil(total / BLOCK)), max(1, math.ceil(asked / QUERIES))
    # A block of rows for each block of queries and the other way round: an equi-join, one pair to a row.
    index = materialize(blocks(rows, nr, _pack_index, "bits binary, low binary, digits int"), "bit-slices")
    right = index.select(
        "dim", F.col("block").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("q"), "ids", "bits", "low", "digits"
    )
    left = blocks(queries, nq, _pack_queries, "rows binary").select(
        "dim",
        F.col("block").alias("q"),
        F.explode(F.sequence(F.lit(0), F.lit(nr - 1))).alias("r"),
        F.col("ids").alias("asked"),
        F.col("rows").alias("queries"),
    )
    pairs = left.join(right, ["dim", "q", "r"]).select("asked", "queries", "ids", "bits", "low", "digits")
    best = pairs.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
