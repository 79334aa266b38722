"""The corpus pipeline: toxic documents go, near copies go, repeated passages go, sources are mixed, texts become tokens."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm import bpe, minhash, mixing, repeats, toxicity
from keelson.llm.names import every, fresh
from keelson.llm.scratch import materialize, workspace

VOCABULARY = "byte_bpe_50k.tiktoken"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 by a model learnt from the labelled rows among them. Rows are never moved.

    Null and empty texts get the model's bias alone, repeated rows equal scores, so equal rows stay or go together; rows
    with a null id are scored but not learnt from. An empty table stays empty. All columns are kept as they are.
    """
    scored = toxicity.with_score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.where(F.col(scored.columns[-1]) < 0.5).select(every(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of smallest id.

    Rows with a null id, and null and empty texts, link with nothing and stay. Rows that share an id are one document and
    stay or go together. An empty table stays empty. All columns are kept as they are.
    """
    gone = minhash.near_duplicates(docs, k=5, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(every(docs))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words that an earlier document has; others are unchanged, none is dropped.

    A document that loses all words stays with an empty text. Null texts and rows with a null id are unchanged. Rows that
    share an id are one document, each cut by its own text; repeated rows are cut alike. An empty table stays empty. All
    columns are kept, ``n_chars`` follows the text.
    """
    found = repeats.removed_words(docs).where("n_removed > 0").select("doc_id", "text_hash", "kept_text")
    found = found.dropDuplicates(["doc_id", "text_hash"])
    found = found.select(*[F.col(c).alias(fresh(docs, f"_{c}")) for c in found.columns])
    key, text_hash, kept = found.columns
    rows = docs.join(found, (F.col("doc_id") == F.col(key)) & (F.xxhash64("text") == F.col(text_hash)), "left")
    changed = {"text": F.coalesce(kept, "text"), "n_chars": F.coalesce(F.length(kept).cast("long"), "n_chars")}
    return rows.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix of sources by weight (5, 2, 1) takes.

    Null and empty texts have no words and are taken by no mix. A null source is a source, the last one. Of equal rows at
    the cut as many are taken as fit. An empty table stays empty. All columns are kept as they are.
    """
    mixed = mixing.mix_sources(docs, weights=(5, 2, 1), share=1.5, cap=2)
    copies = F.col(mixed.columns[-1])["copies"]
    taken = mixed.where(copies > 0)
    return taken.withColumn(fresh(taken, "_copy"), F.explode(F.sequence(F.lit(1), copies))).select(every(docs))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document, decoded again: ``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``, ``tokens``.

    One row per input row. Null and empty texts have no tokens; null ids stay null; repeated rows give equal rows. An
    empty table stays empty. Other columns go.
    """
    path = public_tokenizers.path(VOCABULARY)
    return bpe.round_trip(docs, path, public_tokenizers.PATTERN, keep_tokens=True, keep_machine=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("repeated passages", drop_repeats),
    ("mixing", mix),
    ("tokens", tokenize),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        # What a stage wrote on its way goes when its result is written.
        with workspace(spark):
            out = stage(spark, docs, sf_dir)
            docs = materialize(out, f"stage-{name.replace(' ', '-')}", owned=False)
    return docs
