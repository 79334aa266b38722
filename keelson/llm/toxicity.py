"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the average of the embeddings of its character n-grams (3 to 5 bytes, with marks at the word's ends), hashed
into a fixed number of rows, so a misspelling shares most of its vectors with the word it hides. The words of a passage
of ``SPAN`` words are averaged and a linear softmax gives the passage's log-odds; a text's log-odds are the soft maximum
of its passages, so that one insult in a long text isn't averaged away. Embeddings and softmax are trained jointly with
Adam in numpy on a bounded sample of labelled rows; scoring needs one number per n-gram row and runs over all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .names import fresh
from .words import _LOWER, Words, _Powers, chunks, tidy

GRAMS = (3, 4, 5)
BITS = 17  #: 2**17 embedding rows
WIDTH = 8
SPAN, STRIDE = 2, 1
SHARP = 4.0  #: of the soft maximum
MAX_DOCS = 4000  #: labelled rows that are learnt from at most (by a hash of their id)
MAX_BYTES = 16 << 20  #: and the bytes of their texts, half of them for each class
TEXT_BYTES = 2 << 20  #: longer labelled texts aren't learnt from
BLOCK_WORDS = 1 << 17  #: words of the documents that a training step takes at once
EPOCHS = 30
DECAY = 1e-4
_GRAM = _Powers(0x8CB92BA72F3D8DD7)


@dataclass
class Model:
    """``gram``: each n-gram row's contribution to the log-odds; ``bias`` is added once for a text."""

    gram: np.ndarray
    bias: float


def _padded(data: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words joined by single marks, with each word's first mark and the end of its last one."""
    length = w.end - w.start
    begin = np.concatenate([[0], np.cumsum(length + 1)])
    out = np.full(begin[-1] + 1, 0x20, dtype=np.uint8)
    size = int(length.sum())
    shift = np.repeat(begin[:-1] + 1 - (np.cumsum(length) - length), length)
    source = np.repeat(w.start - (np.cumsum(length) - length), length) + np.arange(size)
    out[np.arange(size) + shift] = _LOWER[data[source]]
    return out, begin[:-1], begin[1:] + 1


def _rows(text: np.ndarray, n: int) -> np.ndarray:
    """The embedding row of the n-gram at each position."""
    if len(text) < n:
        return np.zeros(0, dtype=np.int64)
    up, down = _GRAM.upto(len(text) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)])
    h = (total[n:] - total[:-n]) * down[: len(text) - n + 1] + np.uint64(n)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x9FB21C651E98DF25)
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def _spans(count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passages of texts with ``count`` words: text, first word and end word; every word is in at least one."""
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    n = np.where(count > 0, np.maximum(-(-(count - SPAN) // STRIDE), 0) + 1, 0)
    text = np.repeat(np.arange(len(count)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    a = first[text] + k * STRIDE
    return text, a, np.minimum(a + SPAN, first[text] + count[text])


def _pool(z: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Soft maximum of passages' log-odds for each text (0 without passages), and each passage's share in it."""
    top = np.full(n, -np.inf)
    np.maximum.at(top, text, z)
    top[~np.isfinite(top)] = 0
    e = np.exp(SHARP * (z - top[text]))
    total = np.bincount(text, e, n)
    return np.where(total > 0, top + np.log(np.maximum(total, 1e-300)) / SHARP, 0.0), e / np.maximum(total[text], 1e-300)


def _vocabulary(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts as numbers, the number of words of each text, and the bytes and ends of each different word.

    Texts are read in chunks, so that only the words' numbers and the different words are held as a whole.
    """
    local, names, lengths, spelled, count = [], [], [], [], []
    for _, _, data, offsets in chunks(pa.array(texts, pa.large_string())):
        w = Words(data, offsets)
        name, one, number = np.unique(w.hashes(lower=True), return_index=True, return_inverse=True)
        length = w.end[one] - w.start[one]
        spelled.append(data[np.repeat(w.start[one] - (np.cumsum(length) - length), length) + np.arange(length.sum())])
        local.append(number.astype(np.int32))
        names.append(name)
        lengths.append(length)
        count.append(w.count)
    _, one, number = np.unique(np.concatenate(names), return_index=True, return_inverse=True)
    word, at = [], 0
    for part, name in zip(local, names, strict=True):
        word.append(number[at : at + len(name)].astype(np.int32)[part])
        at += len(name)
    lengths = np.concatenate(lengths)
    begin, length = (np.cumsum(lengths) - lengths)[one], lengths[one]
    letters = np.concatenate(spelled)[np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(length.sum())]
    return np.concatenate(word), np.concatenate(count), letters, np.concatenate([[0], np.cumsum(length)])


def _gram_rows(letters: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of the n-grams of different words, word by word, and the number of each word's."""
    text, begin, end = _padded(letters, Words(letters, ends))
    many = [np.maximum(end - begin - k + 1, 0) for k in GRAMS]
    total = sum(many)
    row, at = np.empty(int(total.sum()), dtype=np.int32), np.cumsum(total) - total
    for k, m in zip(GRAMS, many, strict=True):
        step = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        row[np.repeat(at, m) + step] = _rows(text, k)[np.repeat(begin, m) + step]
        at = at + m
    return row, total


def train(texts: list[str], toxic: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Fit embeddings and softmax together. With no rows or a single class the scores are that class's smoothed rate.

    Besides the texts, memory holds one number for each word, and one for each n-gram of a different word.
    """
    n, y = len(texts), np.asarray(toxic, dtype=np.float64)
    prior = (y.sum() + 0.5) / (n + 1)
    bias = float(np.log(prior / (1 - prior)))
    if not n or y.min() == y.max():
        return Model(np.zeros(1 << BITS), bias)
    word, count, letters, ends = _vocabulary(texts)
    row, grams = _gram_rows(letters, ends)
    del letters
    used = np.flatnonzero(np.bincount(row, minlength=1 << BITS))
    number = np.zeros(1 << BITS, dtype=np.int32)
    number[used] = np.arange(len(used))
    row = number[row]
    at, share = np.cumsum(grams) - grams, (1.0 / grams).astype(np.float32)
    # Documents in blocks: [first document, end document) and where their words begin.
    first = np.concatenate([[0], np.cumsum(count)])
    blocks, i = [], 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(first, first[i] + BLOCK_WORDS, side="right")) - 1)
        blocks.append((i, j))
        i = j

    rng = np.random.default_rng(seed)
    p = {
        "E": rng.normal(0, 0.05, (len(used), WIDTH)).astype(np.float32),
        "W": rng.normal(0, 0.5, (WIDTH, 2)).astype(np.float32),
        "c": np.array([bias], dtype=np.float32),
    }
    mean, var = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / n
    for epoch in range(1, epochs + 1):
        # One dimension at a time, so that the largest temporary array has one number for an n-gram of a word.
        word_vec = np.stack([np.add.reduceat(p["E"][:, k][row], at) * share for k in range(WIDTH)], axis=1)
        direction = p["W"][:, 1] - p["W"][:, 0]
        score = np.einsum("ij,j->i", word_vec, direction)
        at_word, pull = np.zeros(len(grams)), 0.0
        for i, j in blocks:
            mine, words_of = word[first[i] : first[j]], count[i:j]
            doc, a, b = _spans(words_of)
            total = np.concatenate([[0.0], np.cumsum(score[mine], dtype=np.float64)])
            z, part = _pool((total[b] - total[a]) / (b - a), doc, j - i)
            g = (1 / (1 + np.exp(-(z + p["c"][0]))) - y[i:j]) * balance[i:j]
            pull += g.sum()
            at_span = g[doc] * part / (b - a)
            ramp = np.bincount(a, at_span, len(mine) + 1) - np.bincount(b, at_span, len(mine) + 1)
            at_word += np.bincount(mine, np.cumsum(ramp)[: len(mine)], len(grams))
        at_word = at_word.astype(np.float32)
        slope = np.bincount(row, np.repeat(at_word * share, grams), len(used)).astype(np.float32)
        grad = {
            "E": slope[:, None] * direction[None, :] + DECAY * p["E"],
            "W": np.outer(np.einsum("ij,i->j", word_vec, at_word), [-1, 1]).astype(np.float32),
            "c": np.array([pull], dtype=np.float32),
        }
        rate = 0.08 * min(1.0, 4 * (1 - (epoch - 1) / epochs))
        for k, x in p.items():
            mean[k] += 0.1 * (grad[k] - mean[k])
            var[k] += 0.01 * (grad[k] ** 2 - var[k])
            x -= rate * (mean[k] / (1 - 0.9**epoch)) / (np.sqrt(var[k] / (1 - 0.99**epoch)) + 1e-8)
    gram = np.zeros(1 << BITS)
    gram[used] = np.einsum("ij,j->i", p["E"].astype(np.float64), (p["W"][:, 1] - p["W"][:, 0]).astype(np.float64))
    return Model(gram, float(p["c"][0]))


def log_odds(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The log-odds of each text of a chunk."""
    w = Words(data, offsets)
    out = np.full(len(w.count), model.bias)
    if not len(w.start):
        return out
    text, begin, end = _padded(data, w)
    total, grams = np.zeros(len(begin)), np.zeros(len(begin))
    for k in GRAMS:
        run = np.concatenate([[0.0], np.cumsum(model.gram[_rows(text, k)])])
        m = np.maximum(end - begin - k + 1, 0)
        some = m > 0
        total[some] += run[begin[some] + m[some]] - run[begin[some]]
        grams += m
    run = np.concatenate([[0.0], np.cumsum(total / np.maximum(grams, 1))])
    doc, a, b = _spans(w.count)
    z, _ = _pool((run[b] - run[a]) / (b - a), doc, len(w.count))
    return out + z


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_docs: int = MAX_DOCS,
    max_bytes: int = MAX_BYTES,
    max_text_bytes: int = TEXT_BYTES,
) -> Model:
    """Learn from a bounded sample of labelled rows: at most ``max_docs`` of them, none longer than ``max_text_bytes``, and
    of each class whole texts of at most ``max_bytes / 2`` bytes together. All bounds hold for learning only; scoring
    covers every text, whatever its length.

    Rows count only if crc32(id as text) mod 5 isn't 0; the others are held out. A null label, id or text isn't used; of
    several labels for an id the largest counts; rows that share an id are separate texts. The sample is fixed by a hash
    of the id, so reruns agree, and the bounds hold before it comes together in one task, from which only the model,
    2**BITS numbers, goes on. Without usable rows (an empty table, or no labels) every score is 0.5.
    """
    ids = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y"))
        .where("id is not null and y is not null and pmod(crc32(cast(id as string)), 5) <> 0")
        .groupBy("id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(max_docs)
    )
    rows = (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .where("id is not null")
        .join(F.broadcast(ids), "id")
        .where(F.octet_length("text") <= max_text_bytes)
        .orderBy(F.xxhash64("id"), "id", "text")
        .limit(max_docs)
        .select("text", "y")
    )
    r = rows.mapInArrow(tidy(_train_batches(max_bytes)), "gram binary, bias double").first()
    return Model(np.frombuffer(bytes(r.gram), dtype=np.float64), r.bias) if r else train([], np.zeros(0))


def _train_batches(max_bytes: int):
    """Trains on the rows of the one partition that a limit leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y, size = [], [], [0, 0]
        for batch in batches:
            for text, label in zip(*batch.columns, strict=True):
                toxic, text = label.as_py() > 0, text.as_py()
                more = len(text.encode())
                if size[toxic] + more <= max_bytes // 2:
                    size[toxic] += more
                    texts.append(text)
                    y.append(toxic)
        if texts:
            m = train(texts, np.array(y))
            yield pa.record_batch([pa.array([m.gram.tobytes()], pa.binary()), pa.array([m.bias])], names=["gram", "bias"])

    return run


def _scorer(model, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(at)):
                score = 1 / (1 + np.exp(-np.clip(log_odds(m, data, offsets), -700, 700)))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], names=[*batch.schema.names, "score"])

    return run


def with_score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "_score") -> DataFrame:
    """``docs`` with the score of each whole text in a further, last column; rows never move.

    Null and empty texts get the score of the bias. Where ``docs`` has a column ``score_col`` already, the new one's name
    gets underscores in front.
    """
    score_col = fresh(docs, score_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # Numbered on the way, as names may hold characters that an Arrow function can't take.
    rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(tidy(_scorer(shared, docs.columns.index(text_col))), schema).toDF(*docs.columns, score_col)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text: ``id_col``, ``held_out``, ``score`` (0 to 1) and ``predicted`` (score >= 0.5).

    Only the text is scored. Null and empty texts get the score of the bias. Null ids are kept (not held out); repeated
    rows get equal scores; other columns are ignored; an empty table gives no rows. The model (2**BITS numbers) is
    broadcast; rows are independent and nothing is shuffled.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    held = F.coalesce(F.pmod(F.crc32(F.col("id").cast("string")), F.lit(5)) == 0, F.lit(False))
    return with_score(rows, model).select(
        F.col("id").alias(id_col),
        held.alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"),
    )
