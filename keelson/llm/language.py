"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

A text is lower-cased, everything that is neither letter nor mark becomes one blank, and n-grams of 1 to 3 characters of
what is left are hashed into a fixed number of rows. A row's value is its share of the text's n-grams times its inverse
document frequency, which is counted over all texts that may be learnt from. Weights come from follow-the-regularised-
leader with elastic-net penalties, text by text, on a bounded sample, so most of them are exactly 0; the softmax's
temperature is then fitted to texts of the sample that the weights haven't seen. Scoring covers every whole text: the
share is the only thing that depends on the text, so a class's logit is a sum of one number for each n-gram.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .names import fresh
from .words import chunks, tidy

GRAMS = (1, 2, 3)
BITS = 16  #: 2**16 rows of n-grams
UNKNOWN = "und"
MAX_DOCS = 3000  #: labelled rows that are learnt from at most
MAX_PER_LANGUAGE = 1000  #: and of one language
TEXT_BYTES = 1 << 16  #: longer labelled texts aren't learnt from
MAX_BYTES = 24 << 20  #: and the bytes of all that are
EPOCHS = 3
ALPHA, BETA = 1.0, 0.02  #: of the learning rate
L1, L2 = 1e-3, 1e-4
HELD = 5  #: each fifth sampled text fits the temperature only
MISS = 1 << BITS  #: the row of n-grams that reach over a text's end


@dataclass
class Model:
    """``weight``: what each used row of ``rows`` adds to each language's logit, inverse document frequency and temperature
    included; ``bias`` is added once."""

    languages: list[str]
    rows: np.ndarray
    weight: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0


@cache
def _is_letter() -> np.ndarray:
    """1 for letters, 2 for marks, 0 for all other code points (also beyond the last)."""
    import unicodedata

    first = {"L": 1, "M": 2}
    return np.array([first.get(unicodedata.category(chr(c))[0], 0) for c in range(sys.maxunicode + 1)], dtype=np.uint8)


def _points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of lower-cased texts with one blank for all else between, before and behind words; where each text
    ends, and whether it has a letter. A text without letters is a single blank."""
    texts = pc.utf8_lower(texts)
    n = len(texts)
    at = np.frombuffer(texts.buffers()[1], dtype=np.int32 if pa.types.is_string(texts.type) else np.int64)
    at = at[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[at[0] : at[-1]] if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    at = at - at[0]
    begin = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[at]
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    kind = _is_letter()[points]
    ink = kind > 0
    # A blank in front of each text, and in place of the first of all others behind a word.
    keep = ink.copy()
    keep[1:] |= ink[:-1]
    last = np.zeros(len(ink) + 1, dtype=bool)
    last[begin[1:]] = True
    # What follows a text's last word is the next text's: that text's own blank is put in front instead.
    first = np.zeros(len(ink) + 1, dtype=bool)
    first[begin[:-1]] = True
    keep &= ink | ~first[:-1]
    total = np.concatenate([[0], np.cumsum(keep)])
    # An own blank at the end too, where a text ends in a word.
    ends_in_word = np.zeros(n, dtype=bool)
    some = begin[1:] > begin[:-1]
    ends_in_word[some] = ink[begin[1:][some] - 1]
    size = total[begin[1:]] - total[begin[:-1]] + 1 + ends_in_word
    ends = np.cumsum(size)
    out = np.full(int(ends[-1]) if n else 0, 0x20, dtype=np.uint64)
    chosen = np.flatnonzero(keep)
    number = np.searchsorted(begin, chosen, side="right") - 1
    place = np.arange(len(chosen)) - total[begin[:-1]][number] + (ends - size)[number] + 1
    out[place] = np.where(ink[chosen], points[chosen], 0x20)
    letters = np.concatenate([[0], np.cumsum(kind == 1)])
    return out, ends, letters[begin[1:]] > letters[begin[:-1]]


def _rows(points: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """The row of the n-gram that begins at each place; ``MISS`` where it would reach over the text's end."""
    code = points + np.uint64(1)
    for k in range(1, n):
        code[: len(code) - k] = code[: len(code) - k] * np.uint64(0x110001) + points[k:] + np.uint64(1)
    code += np.uint64(n)
    code *= np.uint64(0x9E3779B97F4A7C15)
    code ^= code >> np.uint64(32)
    code *= np.uint64(0xD6E8FEB86659FD93)
    out = (code >> np.uint64(64 - BITS)).astype(np.int32)
    for k in range(1, n):
        out[np.maximum(ends - k, 0)] = MISS
    return out


def _grams(size: np.ndarray) -> np.ndarray:
    """How many n-grams a text of so many code points has, at least 1."""
    return np.maximum(sum(np.maximum(size - n + 1, 0) for n in GRAMS), 1)


def _text_rows(points: np.ndarray) -> np.ndarray:
    """All n-gram rows of one text."""
    end = np.array([len(points)])
    all_ = np.concatenate([_rows(points, end, n) for n in GRAMS])
    return all_[all_ != MISS]


def _pieces(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """``_points`` of runs of about a megabyte of texts, with the first row and the end row of each."""
    for a, b, _, _ in chunks(texts):
        yield (a, b, *_points(texts.slice(a, b - a).fill_null("")))


def _frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many of the partition's texts each row occurs; row ``MISS`` counts the texts."""
    count = np.zeros(MISS + 1, dtype=np.int64)
    mark = np.zeros(MISS, dtype=np.int64)
    for batch in batches:
        for _, _, points, ends, _ in _pieces(batch.column(0)):
            text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
            seen, of = [], []
            for n in GRAMS:
                row = _rows(points, ends, n)
                inside = row != MISS
                seen.append(row[inside])
                of.append(text[inside])
            row, text = np.concatenate(seen), np.concatenate(of)
            # Text by text, the last of a row's places stands for all.
            by = np.argsort(text, kind="stable")
            row, first = row[by], np.searchsorted(text[by], np.arange(len(ends) + 1))
            for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                mine, place = row[i:j], np.arange(j - i)
                mark[mine] = place
                count[mine[mark[mine] == place]] += 1
            count[MISS] += len(ends)
    some = np.flatnonzero(count)
    yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(count[some])], names=["row", "n"])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def follow(texts: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, classes: int, epochs: int = EPOCHS, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by follow-the-regularised-leader: each step takes one text (its rows and their values).

    A weight is 0 until its summed gradient exceeds ``L1``; beyond that ``L2`` and the sum of squared gradients hold it
    back. The bias, the last row, isn't penalised.
    """
    z, squares = np.zeros((MISS + 1, classes)), np.zeros((MISS + 1, classes))
    rng = np.random.default_rng(seed)
    penalty = np.full(MISS + 1, L1)
    penalty[MISS] = 0.0

    def weights(rows: np.ndarray) -> np.ndarray:
        pull = z[rows]
        size = np.maximum(np.abs(pull) - penalty[rows, None], 0)
        return -np.sign(pull) * size / ((BETA + np.sqrt(squares[rows])) / ALPHA + L2)

    for _ in range(epochs):
        for i in rng.permutation(len(texts)).tolist():
            rows, value = texts[i]
            rows, value = np.append(rows, MISS), np.append(value, 1.0)
            w = weights(rows)
            p = _softmax(value @ w)
            p[label[i]] -= 1
            g = value[:, None] * p
            more = squares[rows] + g * g
            z[rows] += g - (np.sqrt(more) - np.sqrt(squares[rows])) * ALPHA**-1 * w
            squares[rows] = more
    w = weights(np.arange(MISS + 1))
    return w[:MISS], w[MISS]


def calibrate(logits: np.ndarray, label: np.ndarray) -> float:
    """The temperature, from 1/20 to 20, of lowest log loss (by a golden section of its logarithm); 1 for no rows."""
    if not len(label):
        return 1.0

    def loss(t: float) -> float:
        p = _softmax(logits / np.exp(t))[np.arange(len(label)), label]
        return float(-np.log(np.maximum(p, 1e-300)).mean())

    a, b, part = -np.log(20.0), np.log(20.0), (np.sqrt(5.0) - 1) / 2
    for _ in range(50):
        x, y = b - part * (b - a), a + part * (b - a)
        a, b = (a, y) if loss(x) <= loss(y) else (x, b)
    return float(np.exp((a + b) / 2))


def train(texts: list[str], languages: list[str], frequency: np.ndarray, total: int) -> Model:
    """Learn from labelled texts. ``frequency`` has the texts of each row among ``total``. Texts without letters are left
    out; without any other text no language is known."""
    values, label, names = [], [], sorted(set(languages))
    inverse = np.log((1 + total) / (1 + frequency)) + 1
    for text, language in zip(texts, languages, strict=True):
        points, _, letters = _points(pa.array([text]))
        if letters[0]:
            rows, many = np.unique(_text_rows(points), return_counts=True)
            values.append((rows, many / many.sum() * inverse[rows]))
            label.append(names.index(language))
    label = np.array(label, dtype=np.int64)
    kept = np.unique(label)
    names, label = [names[k] for k in kept], np.searchsorted(kept, label)
    if not names:
        return Model([], np.zeros(0, dtype=np.int64), np.zeros((0, 0)), np.zeros(0))
    held = np.arange(len(values)) % HELD == HELD - 1
    w, bias = follow([v for v, h in zip(values, held, strict=True) if not h], label[~held], len(names))
    test = [v for v, h in zip(values, held, strict=True) if h]
    logits = np.array([value @ w[rows] + bias for rows, value in test]).reshape(len(test), len(names))
    temperature = calibrate(logits, label[held])
    used = np.flatnonzero(np.any(w != 0, axis=1))
    return Model(names, used, w[used] * inverse[used, None] / temperature, bias / temperature, temperature)


def logits(model: Model, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The calibrated logits of each text of a run."""
    number = np.full(MISS + 1, len(model.rows), dtype=np.int32)
    number[model.rows] = np.arange(len(model.rows))
    begin = np.concatenate([[0], ends[:-1]])
    out = np.zeros((len(ends), len(model.languages)))
    for n in GRAMS:
        row = number[_rows(points, ends, n)]
        for k in range(len(model.languages)):
            out[:, k] += np.add.reduceat(np.append(model.weight[:, k], 0.0)[row], begin)
    return out / _grams(ends - begin)[:, None] + model.bias


def learnable(id_: Column) -> Column:
    """Whether a row may be learnt from: crc32 of the id as text mod 3 isn't 1."""
    return F.coalesce(F.pmod(F.crc32(id_.cast("string")), F.lit(3)) != 1, F.lit(False))


def fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    max_docs: int = MAX_DOCS,
    max_per_language: int = MAX_PER_LANGUAGE,
    max_text_bytes: int = TEXT_BYTES,
    max_bytes: int = MAX_BYTES,
) -> Model:
    """Learn from rows with a text and a language whose crc32(id as text) mod 3 isn't 1.

    Document frequencies are counted over all of these rows, as partial sums of 2**BITS numbers. Weights are learnt in
    one task from a bounded sample: at most ``max_docs`` rows, ``max_per_language`` of one language, none longer than
    ``max_text_bytes``, ``max_bytes`` together. Rows are taken in turn from each language, by a hash of the id, so a rare
    language is not crowded out, and reruns agree. Of more than ``max_docs`` languages the most common are learnt. With no
    rows at all no language is known. Only the text is learnt from; null ids are neither learnt from nor held out.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(learnable(F.col("id")) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    short = F.octet_length("text") <= max_text_bytes
    sums = rows.select("text").mapInArrow(tidy(_frequency), "row int, n long").groupBy("row").agg(F.sum("n").alias("n"))
    found = {r.row: r.n for r in sums.collect()}
    frequency = np.zeros(MISS + 1, dtype=np.int64)
    frequency[list(found)] = list(found.values())
    # A draw of about four times what is needed, by rates of each language, so that no language's rows meet in one task.
    many = {r.lang: r.n for r in rows.where(short).groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(max_docs).collect()}
    if not many:
        return train([], [], frequency[:MISS], 0)
    rate = F.try_element_at(F.create_map(*[F.lit(x) for l, n in many.items() for x in (l, min(1.0, 4.0 * max_per_language / n))]), F.col("lang"))
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / float(1 << 40)
    drawn = rows.where(short & (draw < rate)).select("text", "lang", F.xxhash64("id").alias("at"), F.md5("text").alias("same"))
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("at", "same"))
    sample = drawn.withColumn("turn", turn).where(F.col("turn") <= max_per_language)
    sample = sample.orderBy("turn", "lang").limit(max_docs).select("text", "lang")
    shared = docs.sparkSession.sparkContext.broadcast((frequency, max_bytes))
    r = sample.mapInArrow(tidy(_train_batches(shared)), "model binary").first()
    return _unpacked(bytes(r.model)) if r else train([], [], frequency[:MISS], 0)


def _packed(m: Model) -> bytes:
    parts = [m.rows, m.weight.ravel(), m.bias, np.array([m.temperature])]
    table = pa.table({"name": [*map(str, range(4)), "languages"], "numbers": [*[p.astype(np.float64).tolist() for p in parts], []], "texts": [[]] * 4 + [m.languages]})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> Model:
    with pa.ipc.open_stream(data) as r:
        table = r.read_all().to_pydict()
    rows, weight, bias, temperature = (np.array(x) for x in table["numbers"][:4])
    languages = table["texts"][4]
    return Model(languages, rows.astype(np.int64), weight.reshape(len(rows), len(languages)), bias, float(temperature[0]))


def _train_batches(shared):
    """Trains on the rows of the one partition that a limit leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency, left = shared.value
        texts, languages = [], []
        for batch in batches:
            for text, language in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                size = len(text.encode())
                if size <= left:
                    left -= size
                    texts.append(text)
                    languages.append(language)
        if texts:
            m = train(texts, languages, frequency[:MISS], int(frequency[MISS]))
            yield pa.record_batch([pa.array([_packed(m)], pa.binary())], names=["model"])

    return run


def _scorer(shared, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, UNKNOWN], dtype=object)
        for batch in batches:
            for a, b, points, ends, letters in _pieces(batch.column(at)):
                best, score = np.full(b - a, len(m.languages)), np.zeros(b - a)
                if m.languages:
                    p = _softmax(logits(m, points, ends))
                    best = np.where(letters, p.argmax(axis=1), best)
                    score = np.where(letters, p.max(axis=1), 0.0)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(names[best].tolist(), pa.string()), pa.array(score)], names=[*batch.schema.names, "lang_pred", "score"]
                )

    return run


def with_language(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "_lang", score_col: str = "_score") -> DataFrame:
    """``docs`` with the language of each whole text and its calibrated probability in two further, last columns.

    Null texts, and texts without a letter, are ``und`` with 0, as all are where no language is known. Of equal logits the
    language that comes first by name wins. Rows never move; names that ``docs`` has already get underscores in front.
    """
    lang_col = fresh(docs, lang_col)
    score_col = fresh(docs, score_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(tidy(_scorer(shared, docs.columns.index(text_col))), schema).toDF(*docs.columns, lang_col, score_col)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The language of every whole text: ``id_col``, ``held_out``, ``lang_pred``, ``score`` (0 to 1).

    Only the text is looked at. Null ids are kept (not held out), repeated rows get equal results, other columns are ignored,
    an empty table gives no rows; the rest as in ``with_language``. The model is broadcast (2**BITS numbers for each
    language at most); nothing is shuffled.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    held = F.coalesce(F.pmod(F.crc32(F.col("id").cast("string")), F.lit(3)) == 1, F.lit(False))
    return with_language(rows, model).select(F.col("id").alias(id_col), held.alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))
