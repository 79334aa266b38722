"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target in words. A document's expected copies rise with the square root of its size, so that targets
are met with fewer, longer texts, and stop at ``cap``. Their whole part is certain; the fraction is an inclusion
probability. Documents are ranked by random odds divided by inclusion odds and taken in that order until the source's
target is met, which fixes the sample's size in words.

Ranks are never sorted as a whole: two rounds of per-source histograms of the rank variate narrow the cut down to a cell
of 2**-24 of its range, and only that cell's rows are ordered. What remains is one number per source, so the documents
themselves are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.metrics import running_sums
from ..sources.archive import with_ids
from .names import every, fresh
from .scratch import materialize

CELLS = 4096
GROWTH, STEPS, FINE = 1.5, 28, 32


def words(text: Column) -> Column:
    """The number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _uniform(seed: int, *cols: Column) -> Column:
    return (F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 52)) + F.lit(0.5)) / float(1 << 52)


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Targets of sources (``source``, ``source_size``): ``share`` of all words dealt by weight, none above ``cap`` times
    its source, the excess dealt again by weight among the others.

    Sources come in code point order, null last, and take the weights in turn. Sorted by how soon they are full, the
    first source that its deal does not fill tells what one unit of weight gets. Both orders are numbered and summed in
    sorted ranges, so any number of sources is spread over tasks. No sources give no targets.
    """
    n = len(weights)
    rows = with_ids(sizes.select("source", "source_size", F.col("source").isNull().alias("_none")), ["_none", "source"])
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("id") - 1) % n + 1).cast("int"))
    rows = rows.select("source", "source_size", "id", w.alias("w"), (cap * F.col("source_size")).alias("full"))
    rows = running_sums(rows.withColumn("level", F.col("full") / F.col("w")), [], [F.col("level"), F.col("id")], ["full", "w"])
    total = rows.agg(F.sum("source_size").alias("words"), F.sum("w").alias("w")).first()
    unit = (share * (total.words or 0) - (F.col("_sum_full") - F.col("full"))) / (F.lit(total.w or 0.0) - (F.col("_sum_w") - F.col("w")))
    deal = rows.withColumn("unit", unit).where("unit <= level").agg(F.min(F.struct("level", "id", "unit")).alias("d")).first().d
    dealt = F.col("full") if deal is None else F.least(F.col("full"), F.lit(deal.unit) * F.col("w"))
    return rows.select("source", "source_size", dealt.alias("target"))


def _by_source(left: DataFrame, right: DataFrame) -> DataFrame:
    right = right.withColumnRenamed("source", "_source")
    return left.join(right, left["source"].eqNullSafe(right["_source"]), "left").drop("_source")


def _expected(c: Column, weight: Column, cap: float) -> Column:
    return F.least(F.lit(cap), c * weight)


def plan(rows: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """What each source takes, from rows of ``source``, ``size``, ``weight``, ``u``: target, coefficient and rank cut."""
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("weight")).alias("mass"))
    goal = targets(sums.select("source", "source_size"), weights, share, cap)
    goal = _by_source(goal, sums.select("source", "mass"))
    # Tables of one row per source are written first: Spark then knows their size and broadcasts them if it is small.
    goal = materialize(goal.withColumn("c", F.col("target") / F.greatest("mass", F.lit(1e-9))), "mix-targets")
    # The largest coefficient on a geometric, then on a linear grid, that stays within the target.
    for ratio in ([GROWTH**i for i in range(STEPS)], [1 + (GROWTH - 1) * i / FINE for i in range(FINE)]):
        tried = _by_source(rows, goal.select("source", "c"))
        sums = tried.groupBy("source").agg(
            *[F.sum(_expected(F.col("c") * r, F.col("weight"), cap) * F.col("size")).alias(f"f{i}") for i, r in enumerate(ratio)]
        )
        goal = _by_source(goal, sums)
        best = F.greatest(*[F.when(F.col(f"f{i}") <= F.col("target") * (1 + 1e-12), F.lit(r)).otherwise(F.lit(1.0)) for i, r in enumerate(ratio)])
        goal = materialize(goal.withColumn("c", F.col("c") * best).drop(*[f"f{i}" for i in range(len(ratio))]), "mix-goal")

    ranked = with_rank(_by_source(rows, goal.select("source", "c")), cap)
    certain = ranked.groupBy("source").agg(F.sum(F.col("certain") * F.col("size")).alias("sure"))
    goal = _by_source(goal, certain).withColumn("open", F.col("target") - F.coalesce("sure", F.lit(0.0)))
    cells = ranked.where(F.col("certain") < cap).select(
        "source",
        "size",
        "rank",
        F.floor(F.col("rank") * CELLS).alias("cell"),
        F.floor(F.col("rank") * CELLS * CELLS).alias("fine"),
    )
    goal = goal.withColumn("before", F.lit(0.0))
    for level in ("cell", "fine"):
        sums = cells.groupBy("source", level).agg(F.sum("size").alias("sum"))
        upto = Window.partitionBy("source").orderBy(level)
        sums = _by_source(sums.withColumn("cum", F.sum("sum").over(upto)), goal.select("source", "open", "before"))
        # The first cell that the open words do not cover.
        cut = sums.where(F.col("before") + F.col("cum") > F.col("open")).groupBy("source").agg(
            F.min(F.struct(level, (F.col("before") + F.col("cum") - F.col("sum")).cast("double").alias("at"))).alias("cut")
        )
        goal = _by_source(goal.drop("before"), cut.select("source", F.col(f"cut.{level}").alias(level), F.col("cut.at").alias("before")))
        goal = materialize(goal.withColumn("before", F.coalesce("before", F.lit(0.0))), "mix-cut")
        near = goal.where(F.col(level).isNotNull()).select(F.col("source").alias("_s"), F.col(level).alias("_c"))
        cells = cells.join(near, cells["source"].eqNullSafe(near["_s"]) & (cells[level] == near["_c"])).drop("_s", "_c")
    # Rows of one rank count as a group, however many they are; the first group that isn't taken whole is cut inside.
    last = cells.groupBy("source", "rank", "size").agg(F.count("*").alias("n"))
    last = _by_source(last, goal.select("source", "open", "before"))
    upto = Window.partitionBy("source").orderBy("rank", "size").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("cum", F.col("before") + F.coalesce(F.sum(F.col("n") * F.col("size")).over(upto), F.lit(0)))
    fits = F.floor((F.col("open") - F.col("cum")) / F.col("size") + 0.5)
    last = last.withColumn("take", F.greatest(F.least(fits, F.col("n")), F.lit(0))).where(F.col("take") < F.col("n"))
    last = last.groupBy("source").agg(F.min(F.struct("rank", "size", "take", "n")).alias("cut"))
    goal = _by_source(goal, last)
    # Ranks lie in [0, 1]: without a cut, every document is in.
    below = F.when(F.col("cell").isNull(), F.lit(2.0)).otherwise((F.col("fine") + 1) / float(CELLS * CELLS))
    return goal.select("source", "source_size", "target", "c", F.coalesce(below, F.lit(2.0)).alias("below"), "cut")


def with_rank(rows: DataFrame, cap: float) -> DataFrame:
    """Adds ``certain`` (whole copies) and ``rank``: random odds over inclusion odds, mapped from [0, inf] to [0, 1]."""
    e = _expected(F.col("c"), F.col("weight"), cap)
    p = e - F.floor(e)
    # odds / (1 + odds) of odds = u/(1-u) * (1-p)/p
    a = F.col("u") * (1 - p)
    return rows.withColumn("certain", F.floor(e)).withColumn("rank", F.when(p > 0, a / (a + (1 - F.col("u")) * p)).otherwise(F.lit(1.0)))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    cap: int = 2,
    tilt: float = 0.5,
    seed: int = 20,
    name: str = "mix",
) -> DataFrame:
    """``docs`` with ``copies`` (0 to ``cap``), ``size``, ``source_size`` and ``target`` added in a last column, a struct ``name``.

    A source's taken words differ from its target by half a document at most. Draws depend on the seed, the id and the
    text only, so reruns and other layouts of the table agree; where the cut falls among equal rows, as many of them are
    taken as fit. Null sources form one source, the last one. Null and empty texts have size 0 and no copies. An empty
    table gives an empty result. The columns of ``docs`` are kept as they are; where one is called ``name`` already, the
    struct's name gets underscores in front.
    """
    size, source = words(F.col(text_col)), F.col(source_col)
    u = _uniform(seed, F.col(id_col).cast("string"), F.col(text_col))
    narrow = docs.select(source.alias("source"), size.alias("size"), u.alias("u"))
    narrow = narrow.where("size > 0").withColumn("weight", F.pow("size", F.lit(tilt)))
    empty = docs.select(source.alias("source")).distinct().select("source", F.lit(0).cast("long").alias("size"), F.lit(0.5).alias("u"), F.lit(0.0).alias("weight"))
    narrow = materialize(narrow.unionByName(empty), "mix-sizes")
    table = materialize(plan(narrow, weights, share, float(cap)), "mix-plan")
    split = table.where("cut.take > 0").limit(1).count() > 0
    rows = docs.select(F.struct(*every(docs)).alias("_doc"), source.alias("source"), size.alias("size"), u.alias("u"))
    rows = rows.join(table.select(F.struct("*").alias("_mix")), F.col("source").eqNullSafe(F.col("_mix.source")), "left")
    rows = rows.withColumn("weight", F.pow("size", F.lit(tilt))).withColumn("c", F.col("_mix.c"))
    rows = with_rank(rows, float(cap))
    here, cut = F.struct("rank", "size"), F.struct("_mix.cut.rank", "_mix.cut.size")
    inside = (F.col("rank") < F.col("_mix.below")) & (F.col("_mix.cut").isNull() | (here < cut))
    if split:
        # Few rows stand at a cut that falls among equal rows: they are numbered, partition by partition.
        at_cut = F.coalesce((here == cut) & (F.col("_mix.cut.take") > 0) & (F.col("certain") < cap) & (F.col("size") > 0), F.lit(False))
        equal = materialize(rows.where(at_cut).withColumn("_part", F.spark_partition_id()), "mix-equal")
        parts = equal.groupBy("source", "_part").count()
        before = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.select(
            F.col("source").alias("_s"), F.col("_part").alias("_p"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before")
        )
        equal = equal.join(parts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p")))
        place = F.col("_before") + F.row_number().over(Window.partitionBy("source", "_part").orderBy(F.lit(0)))
        equal = equal.withColumn("_in", place <= F.col("_mix.cut.take")).select(*rows.columns, "_in")
        rows = rows.where(~at_cut).withColumn("_in", inside).unionByName(equal)
    else:
        rows = rows.withColumn("_in", inside)
    extra = (F.col("certain") < cap) & F.col("_in")
    copies = F.when(F.col("size") > 0, F.col("certain") + extra.cast("int")).otherwise(F.lit(0)).cast("int")
    mix = F.struct(copies.alias("copies"), "size", F.col("_mix.source_size").alias("source_size"), F.col("_mix.target").alias("target"))
    return rows.select(*[F.col("_doc")[c].alias(c) for c in docs.columns], mix.alias(fresh(docs, name)))
