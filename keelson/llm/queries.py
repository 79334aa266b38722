"""The numbered queries over the driver's tables: each applies one operator, with production parameters, to all rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, language, licences, minhash, repeats, runs, topk, toxicity, trie, vectors, warc
from .minhash import near_duplicates
from .mixing import mix_sources
from .scratch import materialize

VOCABULARY = "byte_bpe_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of ``documents`` on four-word shingles at similarity 0.8."""
    return near_duplicates(_table(spark, sf_dir, "documents"), k=4, percent=80)


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest integer inner products of every fiftieth vector with all others."""
    return topk.top_inner_products(_table(spark, sf_dir, "embeddings"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of 150 % of all words takes from each document, sources weighing 5, 2, 1 in turn."""
    mix = mix_sources(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, cap=2)
    return mix.select(
        "doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.col("mix.copies")).alias("taken")
    )


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of every conversation, rendered in each speaker's perspective with its loss mask."""
    return chat.rotate(_table(spark, sf_dir, "conversations"))


def chat_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as training text, once per speaker, with the spans that are trained on."""
    rows = chat.dialogues(chat.rotate(_table(spark, sf_dir, "conversations")))
    spans = F.transform("mask", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string")))
    return rows.withColumn("mask", F.array_join(spans, ","))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives of ``pages`` hold, read back from the compressed archives."""
    records = warc.read(warc.archive(_table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes for every document."""
    path = public_tokenizers.path(VOCABULARY)
    return bpe.round_trip(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op7_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link counts and components of all embeddings at cosine 0.9."""
    return vectors.similar_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.9)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a model learnt from labelled rows that aren't held out."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without passages of 50 words that an earlier one has."""
    return repeats.removed_words(_table(spark, sf_dir, "documents")).drop("kept_text", "text_hash")


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence sentences and licences of every document."""
    return licences.scan(_table(spark, sf_dir, "documents"))


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document by a model learnt from rows that aren't held out."""
    docs = _table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


def shared_beginnings(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (as of ``trie.turns``) of conversations that begin like others: the first h of the conversation c - c % 5,
    then their own turns after the first h, h being crc32(c) % 9. Also every conversation with its number of turns.
    """
    c = F.col("conv_id")
    size = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    size = materialize(size.select("conv_id", "n", (c - c % 5).alias("base"), F.pmod(F.crc32(c.cast("string")), F.lit(9)).alias("h")), "trie-sizes")
    bases = size.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    size = size.join(bases, "base", "left").withColumn("head", F.least("h", F.coalesce("base_n", F.lit(0))))
    own = turns.join(size, "conv_id").where("depth > h")
    own = own.select("conv_id", (F.col("depth") - F.col("h") + F.col("head")).alias("depth"), "turn_key", "n_bytes")
    # At most eight turns of a conversation go to at most five others.
    first = turns.where("depth <= 8").withColumnRenamed("conv_id", "base")
    taken = first.join(size.select("conv_id", "base", "h"), "base").where("depth <= h").select("conv_id", "depth", "turn_key", "n_bytes")
    n_turns = F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return own.unionByName(taken), size.select("conv_id", n_turns.alias("n_turns"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, some of which begin alike, with the ids that end at each node."""
    rows, members = shared_beginnings(materialize(trie.turns(_table(spark, sf_dir, "conversations")), "trie-own"))
    rows, members = trie.prefixes(rows), materialize(members, "trie-members")
    nodes = trie.prefix_trie(rows, members)
    digests = trie.ends_digest(trie.ends(rows, members))
    out = nodes.join(digests, ["depth", "p1", "p2"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def with_periods(docs: DataFrame) -> DataFrame:
    """``documents`` of which a tenth, by a hash of their ids, repeat a stretch of their words to the end.

    Null ids and texts, and texts without words, are left alone.
    """
    h = F.crc32(F.col("doc_id").cast("string"))

    def rewritten(words: Column) -> Column:
        n, g = F.size(words).cast("long"), F.floor(h / 10).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        at = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p))
        return F.when(n > 0, F.array_join(F.transform(at, lambda i: F.get(words, i.cast("int"))), " ")).otherwise(F.lit(""))

    # In an array of one element, as a lambda's variable is computed once.
    words = F.array(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    text = F.when((h % 10 == 0) & F.col("text").isNotNull(), F.transform(words, rewritten)[0]).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, a tenth of which end in a repeated stretch, and what is left without repeats."""
    found = runs.periodic_runs(with_periods(_table(spark, sf_dir, "documents")))
    more = lambda x, best: x["length"] * best["period"] > best["length"] * x["period"]
    # Runs stand by start, then period: of equal exponents the first stays.
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda b, x: F.when(more(x, b), x).otherwise(b))
    lines = F.transform("runs", lambda x: F.concat_ws(",", x["start"], x["length"], x["period"]))
    text = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_minhash, op2_topk, op3_mixing, op4_chat, op5_warc, op6_bpe, op7_vectors, op8_toxicity,
            op9_repeats, op10_licences, op11_language, op12_trie, op13_runs, chat_dialogues,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash": minhash.SQL,
        "op2_topk": topk.SQL,
        "op4_chat": chat.SQL,
        "chat_dialogues": chat.DIALOGUES_SQL,
        "op5_warc": warc.SQL,
        "op7_vectors": vectors.SQL,
        "op9_repeats": repeats.SQL,
        "op10_licences": licences.SQL,
        "op12_trie": trie.SQL,
        "op13_runs": runs.SQL,
    }
