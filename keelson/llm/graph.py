"""Connected components by contraction inside partitions, each round written to the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(pmod(xxhash64(v, u), 1000003))")
    ).first()
    return tuple(row)


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hang every node of the partition's links under the smallest node that they connect it with."""
    root: dict = {}

    def find(x):
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = root[x]
        return x

    kind = None
    for batch in batches:
        kind = batch.column(0).type
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if (p := find(u)) != (q := find(v)):
                root[max(p, q)] = min(p, q)
    if kind is not None:
        moved = [(x, r) for x in list(root) if (r := find(x)) != x]
        for i in range(0, len(moved), 100_000):
            part = moved[i : i + 100_000]
            yield pa.record_batch([pa.array([m[j] for m in part], kind) for j in (0, 1)], names=["u", "v"])


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Components of an undirected graph given as ``u``, ``v``; returns ``node``, ``component`` (the smallest node).

    Each round brings a node's links together in one partition (those to larger nodes only if it has a smaller one, so
    a finished star never meets in one task), contracts whatever the partition connects and hangs all of it under the
    smallest node; stars remain after about log(diameter) rounds, and each round is written to the
    shared folder. Before the first round every input partition is contracted where it lies, which bounds the links by
    the nodes. Nulls, loops and repeated links are ignored; no links give no rows.
    """
    edges = links.where("u is not null and v is not null and u <> v").select("u", "v")
    # Written before they are contracted: whatever finds the links then shares no stage, and no workers, with what follows.
    edges = materialize(edges, "links")
    edges = materialize(edges.mapInArrow(_contract, edges.schema), "links")
    mark = None
    for _ in range(rounds):
        # A node without a smaller neighbour has nothing to tell its larger ones: they stay where they are, however many.
        inner = edges.select(F.col("u").alias("_u"))
        back = edges.join(inner, F.col("v") == F.col("_u"), "left_semi").select(F.col("v").alias("u"), F.col("u").alias("v"))
        met = edges.unionByName(back).repartition("u").mapInArrow(_contract, edges.schema)
        edges = materialize(met.distinct(), "stars")
        mark, last = _mark(edges), mark
        if mark == last or not mark[0]:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    down = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return down.unionByName(roots)
