"""Removing passages that an earlier document already has, by repeated-phrase automata.

A passage is a window of ``WINDOW`` consecutive words. Every window holds one phrase of ``PHRASE`` words that its content
alone selects (the one of smallest fingerprint), so documents that share a window share that phrase.

1. one pass names each text's word sequence and gathers the phrases its windows select; equal sequences become one;
2. phrases of several documents recur; the first document that has one is its owner and gives the phrase's words;
3. phrases are dealt to shards by themselves, and each shard's phrases are compiled into an Aho-Corasick automaton;
4. every text is streamed once more and cut into the pieces whose windows select recurring phrases (no other window can
   recur); a piece goes to the shard of its phrases, whose automaton confirms them on their words and gives all places;
5. the windows that a place vouches for are compared word by word: all documents of a window meet in one shard. A shard
   with much text is split over tasks, which exchange each window's first document, by SHA-256, in between.

So a shard is bounded in phrases and a task in text, however long a document and however often it recurs, and of a text
that recurs whole only the overlaps of its pieces are shipped more than once.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import materialize
from .words import Words, chunks, mix, tidy, windows

WINDOW, PHRASE = 50, 16
SHARD_PHRASES = 2048
SHARD_BYTES = 6 << 20
HIT_BYTES = 400
#: Windows of a piece. Longer stretches are cut, so that one long document is spread over tasks.
PIECE_WINDOWS = 1 << 16
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SALT = np.uint64(0xA24BAED4963EE407)


def _selected(h: np.ndarray) -> np.ndarray:
    """Per window, the smallest fingerprint of its phrases."""
    g = windows(h, PHRASE)
    width = WINDOW - PHRASE + 1
    step = 1
    while step * 2 <= width:
        g = np.minimum(g[:-step], g[step:])
        step *= 2
    return np.minimum(g[: len(g) - (width - step)], g[width - step :]) if width > step else g


def _joined(data: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Each text's words joined by one space, end to end, and the texts' offsets in them."""
    length = w.end - w.start
    last = np.zeros(len(length), dtype=bool)
    last[w.first[1:][w.count > 0] - 1] = True
    size = length + ~last
    keep = np.zeros(len(data) + 1, dtype=bool)
    ramp = np.zeros(len(data) + 2, dtype=np.int8)
    ramp[w.start] += 1
    np.add.at(ramp, w.end, np.int8(-1))
    keep[: len(data)] = np.cumsum(ramp[: len(data)], dtype=np.int8) > 0
    out = data.copy()
    gaps = w.end[~last]
    keep[gaps] = True
    out[gaps] = 0x20
    total = np.concatenate([[0], np.cumsum(size)])
    return out[keep[: len(data)]], total[w.first]


def _names(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Two fingerprints of each text's word sequence."""
    out = np.zeros((2, len(first) - 1), dtype=np.uint64)
    place = np.arange(len(h), dtype=np.uint64) - np.repeat(first[:-1], np.diff(first)).astype(np.uint64)
    for i, salt in enumerate((np.uint64(1), _SALT)):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix((h ^ salt) + mix(place + salt)), dtype=np.uint64)])
        out[i] = mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64))
    return out.view(np.int64)


def _base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in chunks(batch.column(1)):
            w = Words(data, offsets)
            h = w.hashes()
            lo, hi = _names(h, w.first)
            text, at = _joined(data, w)
            raw = text.tobytes()
            sha = [hashlib.sha256(raw[i:j]).hexdigest() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            best = _selected(h) if len(h) >= WINDOW else np.zeros(0, dtype=np.uint64)
            prints = []
            for i, n in zip(w.first[:-1].tolist(), w.count.tolist(), strict=True):
                prints.append(np.unique(best[i : i + n - WINDOW + 1]).view(np.int64) if n >= WINDOW else None)
            counts = np.concatenate([[0], np.cumsum([0 if p is None else len(p) for p in prints])]).astype(np.int32)
            flat = np.concatenate([p for p in prints if p is not None] or [np.zeros(0, dtype=np.int64)])
            yield pa.record_batch(
                [
                    batch.column(0).slice(a, b - a),
                    pa.array(w.count, pa.int64()),
                    pa.array(lo),
                    pa.array(hi),
                    pa.array(sha, pa.string()),
                    pa.ListArray.from_arrays(pa.array(counts), pa.array(flat)),
                    batch.column(2).slice(a, b - a),
                ],
                names=["id", "n", "lo", "hi", "sha", "prints", "text_hash"],
            )


def _shard(prints: np.ndarray, shards: int) -> np.ndarray:
    """The shards of phrases. Selected fingerprints are small, hence the mixing."""
    return (mix(prints ^ _SALT) % np.uint64(shards)).astype(np.int64)


_KINDS = [
    ("id", None), ("lo", pa.int64()), ("hi", pa.int64()), ("text", pa.string()), ("shard", pa.int32()), ("at", pa.int64()),
    ("words", pa.string()), ("phrase", pa.string()),
]


def _candidates(shards: int):
    """Rows of three kinds: named candidate texts, their pieces, and the words of the phrases that they own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.column("id").type
            for a, b, data, offsets in chunks(batch.column("text")):
                w = Words(data, offsets)
                h = w.hashes()
                lo, hi = _names(h, w.first)
                part = batch.slice(a, b - a)
                rows: list[tuple] = []
                columns = part.column("id").to_pylist(), part.column("text").to_pylist(), part.column("wanted"), part.column("own")
                for i, (key, text, wanted, own) in enumerate(zip(*columns, strict=True)):
                    first, n, name = int(w.first[i]), int(w.count[i]), int(lo[i])
                    rows.append((key, name, int(hi[i]), text, None, None, None, None))
                    if n < WINDOW:
                        continue
                    start, end = w.start[first : first + n], w.end[first : first + n]

                    def cut(x: int, y: int, start: np.ndarray = start, end: np.ndarray = end, data: np.ndarray = data) -> str:
                        return data[start[x] : end[y - 1]].tobytes().decode()

                    best = _selected(h[first : first + n])
                    at = np.flatnonzero(np.isin(best, wanted.values.to_numpy().view(np.uint64)))
                    shard = _shard(best[at], shards)
                    order = np.lexsort((at, shard))
                    at, shard = at[order], shard[order]
                    # Windows of one shard that overlap make one piece.
                    new = (np.diff(shard) > 0) | (np.diff(at) >= WINDOW) | (np.diff(at // PIECE_WINDOWS) > 0)
                    edge = np.concatenate([[0], np.flatnonzero(new) + 1, [len(at)]]) if len(at) else np.zeros(1, dtype=np.int64)
                    for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                        p, q = int(at[x]), int(at[y - 1]) + WINDOW
                        rows.append((key, name, None, None, int(shard[x]), p, cut(p, q), None))
                    g = windows(h[first : first + n], PHRASE)
                    place = np.flatnonzero(np.isin(g, own.values.to_numpy().view(np.uint64)))
                    place = place[np.unique(g[place], return_index=True)[1]]
                    for p, k in zip(place.tolist(), _shard(g[place], shards).tolist(), strict=True):
                        phrase = " ".join(_WORD.findall(cut(p, p + PHRASE)))
                        rows.append((None, None, None, None, k, None, None, phrase))
                for x in range(0, len(rows), 1 << 14):
                    columns = zip(*rows[x : x + (1 << 14)], strict=True)
                    yield pa.record_batch(
                        [pa.array(c, t or kind) for c, (_, t) in zip(columns, _KINDS, strict=True)], names=[c for c, _ in _KINDS]
                    )

    return run


def _spans(mask: np.ndarray) -> np.ndarray:
    """Runs of true words as (first, end) pairs."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edge.astype(np.int64)


def _same(codes: np.ndarray, size: int) -> np.ndarray:
    """For each run of ``WINDOW`` codes its first one's number among equal runs, told apart by the codes themselves: runs
    of 1, 2, 4, ... codes are numbered by the pairs of their halves."""
    length = 1
    while length < WINDOW:
        step = min(length, WINDOW - length)
        pairs = codes[:-step] * size + codes[step:]
        uniq, codes = np.unique(pairs, return_inverse=True)
        size, length = len(uniq), length + step
    return codes


def _locate(id_type: pa.DataType):
    def run(key: tuple, docs: pa.Table, other: pa.Table) -> pa.Table:
        """Covered words of a shard's pieces, or each window's first document where the shard is split and not yet known."""
        out: dict[str, list] = {c: [] for c in ("id", "lo", "spans", "shard", "salt", "hash", "first")}

        def put(**row: object) -> None:
            for c in out:
                out[c].append(row.get(c))

        automaton = ahocorasick.Automaton()
        for p in other.column("phrase").drop_null().to_pylist():
            automaton.add_word(f" {p} ", len(p) + 2)
        if docs.num_rows and len(automaton):
            automaton.make_automaton()
            known = {x: y for x, y in zip(other.column("hash").to_pylist(), other.column("first").to_pylist(), strict=True) if x is not None}
            split = docs.column("salts")[0].as_py() > 1
            ids = docs.column("id").to_pylist()
            values = sorted(set(ids))
            number = {v: i for i, v in enumerate(values)}
            vocabulary: dict[str, int] = {}
            texts, codes, begins, piece, bounds = [], [], [], [], [0]
            for d, text in enumerate(docs.column("words").to_pylist()):
                ws = _WORD.findall(text)
                starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in ws])])
                line = f" {' '.join(ws)} "
                # A phrase that ends at character e begins with the blank before its first word.
                p = np.searchsorted(starts, np.array([e - size + 1 for e, size in automaton.iter(line)], dtype=np.int64))
                ramp = np.zeros(len(ws) + 1, dtype=np.int64)
                np.add.at(ramp, np.maximum(p + PHRASE - WINDOW, 0), 1)
                np.add.at(ramp, np.minimum(p, len(ws) - WINDOW) + 1, -1)
                begin = np.flatnonzero(np.cumsum(ramp)[: len(ws) - WINDOW + 1] > 0)
                texts.append((line, starts) if split else None)
                codes.append(np.array([vocabulary.setdefault(x, len(vocabulary)) for x in ws], dtype=np.int64))
                begins.append(begin)
                piece.append(np.full(len(begin), d))
                bounds.append(bounds[-1] + len(ws))
            at, d = np.concatenate(begins), np.concatenate(piece)
            same = _same(np.concatenate(codes), len(vocabulary))[at + np.array(bounds)[d]]
            code = np.array([number[x] for x in ids])[d]
            uniq, sample, inverse = np.unique(same, return_index=True, return_inverse=True)
            least = np.full(len(uniq), len(values))
            np.minimum.at(least, inverse, code)
            digests = []
            if split:
                for i in sample.tolist():
                    line, starts = texts[d[i]]
                    digests.append(hashlib.sha256(line[starts[at[i]] + 1 : starts[at[i] + WINDOW]].encode()).digest())
            if split and not known:
                for x, i in zip(digests, least.tolist(), strict=True):
                    put(shard=key[0].as_py(), salt=key[1].as_py(), hash=x, first=values[i])
            else:
                if split:
                    # The first of this task's ids that are above the window's first document.
                    least = np.array([bisect.bisect_right(values, known[x]) for x in digests], dtype=np.int64) - 1
                earlier = least[inverse] < code
                names, offset = docs.column("lo").to_pylist(), docs.column("at").to_pylist()
                for x in np.unique(d[earlier]).tolist():
                    here = slice(*np.searchsorted(d, [x, x + 1]))  # windows stand in the order of their pieces
                    begin = at[here][earlier[here]]
                    ramp = np.zeros(len(codes[x]) + 1, dtype=np.int64)
                    np.add.at(ramp, begin, 1)
                    np.add.at(ramp, begin + WINDOW, -1)
                    put(id=ids[x], lo=names[x], spans=(_spans(np.cumsum(ramp)[:-1] > 0) + offset[x]).tobytes())
        return pa.table(
            {
                "id": pa.array(out["id"], id_type),
                "lo": pa.array(out["lo"], pa.int64()),
                "spans": pa.array(out["spans"], pa.binary()),
                "shard": pa.array(out["shard"], pa.int32()),
                "salt": pa.array(out["salt"], pa.int32()),
                "hash": pa.array(out["hash"], pa.binary()),
                "first": pa.array(out["first"], id_type),
            }
        )

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves out the covered words."""
    for batch in batches:
        out: list[tuple] = []
        size = 0

        def flush(rows: list[tuple], batch: pa.RecordBatch = batch) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            kinds = [batch.schema.field("id").type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["id", "lo", "hi", "n_removed", "sha", "text"])

        for row in batch.to_pylist():
            ws = _WORD.findall(row["text"])
            ramp = np.zeros(len(ws) + 1, dtype=np.int64)
            for spans in row["spans"]:
                edge = np.frombuffer(spans, dtype=np.int64)
                np.add.at(ramp, edge[::2], 1)
                np.add.at(ramp, edge[1::2], -1)
            gone = np.cumsum(ramp)[: len(ws)] > 0
            kept = " ".join(w for w, g in zip(ws, gone.tolist(), strict=True) if not g)
            out.append((row["id"], row["lo"], row["hi"], int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest(), kept))
            size += len(kept)
            if size > 1 << 22:
                yield flush(out)
                out, size = [], 0
        if out:
            yield flush(out)


def _analyse(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per row ``id, n, lo, hi, sha``; per sequence its ``first`` id; and per changed first text its new text."""
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    field = T.StructField
    schema = T.StructType(
        [
            field("id", kind), field("n", T.LongType()), field("lo", T.LongType()), field("hi", T.LongType()),
            field("sha", T.StringType()), field("prints", T.ArrayType(T.LongType())), field("text_hash", T.LongType()),
        ]
    )
    base = materialize(rows.withColumn("text_hash", F.xxhash64("text")).mapInArrow(tidy(_base), schema), "sequences")
    live = base.where(F.col("id").isNotNull() & (F.col("n") >= WINDOW))
    classes = live.groupBy("lo", "hi").agg(F.min("id").alias("first"))
    firsts = live.join(classes.select("lo", "hi", F.col("first").alias("id")), ["lo", "hi", "id"], "left_semi")
    prints = materialize(firsts.select("id", F.explode("prints").alias("print")).distinct(), "prints")
    recurring = prints.groupBy("print").agg(F.min("id").alias("owner"), F.max("id").alias("last"), F.count("*").alias("docs"))
    recurring = materialize(recurring.where("owner <> last").select("print", "owner", "docs"), "recurring")
    n_phrases, n_hits = recurring.agg(F.count("*"), F.coalesce(F.sum("docs"), F.lit(0))).first()
    # A hit ships the windows around it, some hundreds of bytes.
    shards = max(1, math.ceil(n_phrases / SHARD_PHRASES), math.ceil(n_hits * HIT_BYTES / SHARD_BYTES))
    hits = prints.join(recurring.select("print", "owner"), "print").groupBy("id").agg(
        F.collect_list("print").alias("wanted"), F.collect_list(F.when(F.col("owner") == F.col("id"), F.col("print"))).alias("own")
    )
    schema = T.StructType(
        [
            field("id", kind), field("lo", T.LongType()), field("hi", T.LongType()), field("text", T.StringType()),
            field("shard", T.IntegerType()), field("at", T.LongType()), field("words", T.StringType()), field("phrase", T.StringType()),
        ]
    )
    held = rows.where("text is not null and id is not null").join(hits, "id").select("id", "text", "wanted", "own")
    held = materialize(held.mapInArrow(tidy(_candidates(shards)), schema), "candidates")
    texts, pieces = held.where("text is not null"), held.where("words is not null").select("id", "lo", "shard", "at", "words")
    salts = (
        pieces.groupBy("shard").agg(F.sum(F.octet_length("words")).alias("b"))
        .select("shard", F.ceil(F.col("b") / (2 * SHARD_BYTES)).cast("int").alias("salts"))
    )
    salts = materialize(salts, "shards")
    routed = pieces.join(salts, "shard").select(
        "id", "lo", "at", "words", "shard", "salts", F.pmod(F.xxhash64("id", "lo", "at"), F.col("salts")).cast("int").alias("salt")
    )
    # Columns of their own, as both sides of the grouping below come from one table.
    phrases = held.where("phrase is not null").select(F.col("shard").alias("shard"), F.col("phrase").alias("phrase")).distinct()
    phrases = phrases.join(salts.select(F.col("shard").alias("shard"), F.col("salts").alias("salts")), "shard").select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "phrase"
    )
    nothing = [F.lit(None).cast("binary").alias("hash"), F.lit(None).cast(kind).alias("first")]
    schema = T.StructType(
        [
            field("id", kind), field("lo", T.LongType()), field("spans", T.BinaryType()), field("shard", T.IntegerType()),
            field("salt", T.IntegerType()), field("hash", T.BinaryType()), field("first", kind),
        ]
    )

    def located(docs_: DataFrame, other: DataFrame) -> DataFrame:
        left, right = docs_.groupBy("shard", "salt"), other.groupBy("shard", "salt")
        return left.cogroup(right).applyInArrow(_locate(_arrow(kind)), schema)

    found = materialize(located(routed, phrases.select("shard", "salt", "phrase", *nothing)), "found")
    spans = found.where("spans is not null").select("id", "lo", "spans")
    if salts.where("salts > 1").limit(1).count():
        seen = found.where("hash is not null").select("shard", "salt", "hash", "first")
        least = seen.groupBy("shard", "hash").agg(F.min("first").alias("first"))
        known = seen.drop("first").join(least, ["shard", "hash"]).select("shard", "salt", F.lit(None).cast("string").alias("phrase"), "hash", "first")
        again = phrases.join(salts.where("salts > 1").select("shard"), "shard", "left_semi")
        again = again.select("shard", "salt", "phrase", *nothing).unionByName(known)
        more = materialize(located(routed.where("salts > 1"), again), "found-again")
        spans = spans.unionByName(more.where("spans is not null").select("id", "lo", "spans"))
    spans = spans.groupBy("id", "lo").agg(F.collect_list("spans").alias("spans"))
    schema = T.StructType(
        [
            field("id", kind), field("lo", T.LongType()), field("hi", T.LongType()), field("n_removed", T.LongType()),
            field("sha", T.StringType()), field("text", T.StringType()),
        ]
    )
    changed = texts.select("id", "lo", "hi", "text").join(spans, ["id", "lo"]).select("id", "lo", "hi", "text", "spans")
    changed = materialize(changed.mapInArrow(tidy(_cut), schema), "changed")
    return base.select("id", "n", "lo", "hi", "sha", "text_hash"), classes, changed


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


_EMPTY = hashlib.sha256(b"").hexdigest()


def removed_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, ``n_words``, ``n_removed``, ``kept_sha256``, ``kept_text`` (null where nothing
    is removed) and ``text_hash`` (Spark's ``xxhash64`` of the text, to join rows with their texts where ids repeat).

    A word is removed if a window of 50 words that covers it also starts in a document of smaller id; windows are judged
    on the input. Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Null and empty texts have no words. Rows with a null id
    are compared with nothing and stay whole. Copies of a word sequence lose all words but for the smallest id (every row
    of that id keeps them); texts below 50 words stay whole. An empty table gives an empty result; other columns are
    ignored.
    """
    base, classes, changed = _analyse(docs, id_col, text_col)
    changed = changed.select("lo", "hi", F.col("n_removed").alias("r"), F.col("sha").alias("s"), F.col("text").alias("t")).dropDuplicates(["lo", "hi"])
    # Written first, so that the join below shuffles both sides for itself and a sequence with many copies can be split.
    known = materialize(classes.join(changed, ["lo", "hi"], "left"), "sequences-known")
    rows = base.join(known, ["lo", "hi"], "left")
    copy = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    mine = F.col("r").isNotNull() & F.col("id").isNotNull()
    return rows.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_words"),
        F.when(copy, F.col("n")).when(mine, F.col("r")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(copy, F.lit(_EMPTY)).when(mine, F.col("s")).otherwise(F.col("sha")).alias("kept_sha256"),
        F.when(copy, F.lit("")).when(mine, F.col("t")).alias("kept_text"),
        "text_hash",
    )


SQL = f"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, unnest(range(1, len(ws) - {WINDOW - 2})) AS i, ws FROM w WHERE len(ws) >= {WINDOW}
), h AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + {WINDOW - 1}], ' ')) AS k FROM win),
f AS (SELECT k, min(doc_id) AS first FROM h GROUP BY k),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM h JOIN f USING (k) WHERE first < doc_id),
g AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE
    list_filter(ws, lambda x, j: NOT list_contains(gone, j)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN g ON g.doc_id = w.doc_id
"""
