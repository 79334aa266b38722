"""Periodic runs of words by branching tandem repeats in suffix trees.

Each document's suffix tree is the tree of intervals of its suffix array: an interval of suffixes that share ``depth``
words is a node, its suffixes are the node's leaf list. All documents of a chunk are worked on at once; a document's words
are symbols of its own, so the trees hang side by side and meet nowhere.

1. words become numbers (exactly, by their bytes), suffixes are sorted by doubling, common prefixes follow from the
   irreducible ones;
2. at each node of depth D the leaves outside the largest child (so a leaf is looked at about log n times) are tested for
   a leaf D words before or behind: the two are a tandem repeat of period D, and it is branching where the word behind
   it breaks the period. Each run ends in exactly one of these;
3. a branching repeat is rotated to the left as far as its words agree, which gives the whole run; repeats of a multiple
   of a run's period at the same end lie in that run and are merged into it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .crc import CRC_TABLE, crc32
from .words import _SPACE, Words, chunks, tidy

LEAST, TIMES = 6, 4  #: a run has at least ``LEAST`` words and ``TIMES`` periods
LEAVES = 1 << 20  #: leaves that are tested at once
STEPS = 32  #: rounds that are taken for all at once, before what is left is done one by one


def _numbers(data: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Each word's number, equal for equal words only, and the words' bytes end to end."""
    letters = np.ascontiguousarray(data[~_SPACE[data]])
    ends = np.concatenate([[0], np.cumsum(w.end - w.start)]).astype(np.int64)
    kept = pa.Array.from_buffers(pa.large_binary(), len(w.start), [None, pa.py_buffer(ends), pa.py_buffer(letters)])
    return kept.dictionary_encode().indices.to_numpy().astype(np.int64), letters


def _with_ends(number: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Symbols of all documents, each followed by an end of its own that is smaller than its words; no two documents
    share a symbol."""
    docs = len(count)
    place = np.arange(len(number)) + np.repeat(np.arange(docs), count)
    size = int(number.max(initial=0)) + 2
    out = np.repeat(np.arange(docs) * size, count + 1)
    out[place] += number + 1
    return out


def suffix_array(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order and each suffix's place. Every document ends in a symbol that occurs once.

    The order by the first word, then by two, four, ... words; only suffixes that still agree with others are sorted on.
    """
    n = len(s)
    order = np.argsort(s, kind="stable")
    new = np.ones(n, dtype=bool)
    new[1:] = s[order[1:]] != s[order[:-1]]
    slot, width = np.arange(n), 1
    rank = np.empty(n, dtype=np.int64)
    moved = order
    while True:
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(slot)))
        rank[moved] = np.repeat(slot[begin], size)
        open_ = np.repeat(size > 1, size)
        slot = slot[open_]
        if not len(slot):
            return order, rank
        moved = order[slot]
        # A suffix that agrees with another in ``width`` words has no end among them.
        key = rank[moved] * n + rank[moved + width]
        by = np.argsort(key)
        moved, key = moved[by], key[by]
        order[slot] = moved
        new = np.ones(len(slot), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        width *= 2


def _agree(s: np.ndarray, i: int, j: int, step: int = 1) -> int:
    """How many words agree from ``i`` and ``j`` on, in the direction of ``step``; looked up in growing blocks."""
    n, size, done = len(s), 64, 0
    most = n - max(i, j) if step > 0 else min(i, j) + 1
    while done < most:
        m = min(size, most - done)
        if step > 0:
            same = s[i + done : i + done + m] == s[j + done : j + done + m]
        else:
            a, b = i - done - m + 1, j - done - m + 1
            same = (s[a : a + m] == s[b : b + m])[::-1]
        bad = int(np.argmin(same))
        if not same[bad]:
            return done + bad
        done, size = done + m, size * 2
    return done


def common_prefixes(s: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Words that each suffix shares with the one before it in order (0 for the first).

    A pair whose words in front agree as well shares one word less than that longer pair. Only the others are compared;
    together they have at most 2 n log n words.
    """
    n = len(s)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    i = np.arange(n)
    own = (before <= 0) | (i == 0)
    rest = np.flatnonzero(~own)
    own[rest] = s[rest - 1] != s[before[rest] - 1]
    shared = np.zeros(n, dtype=np.int64)
    active = np.flatnonzero(own & (before >= 0))
    for width in range(STEPS):
        active = active[s[active + width] == s[before[active] + width]]
        shared[active] = width + 1
        if not len(active):
            break
    for x in active.tolist():
        shared[x] += _agree(s, x + STEPS, int(before[x]) + STEPS)
    last = np.maximum.accumulate(np.where(own, i, -1))
    return (shared[last] - (i - last))[order]


def _next_smaller(v: np.ndarray) -> np.ndarray:
    """For each positive value the place of the next smaller one (``v`` ends in a value below all)."""
    n = len(v)
    to = np.minimum(np.arange(1, n + 1), n - 1)
    active = np.flatnonzero(v > 0)
    active = active[v[to[active]] >= v[active]]
    for _ in range(STEPS):
        if not len(active):
            return to
        # What lies between a place and its target is not smaller, and so on behind the target.
        to[active] = to[to[active]]
        active = active[v[to[active]] >= v[active]]
    # Long stairs: one by one from the right, within the stretches of positive values that hold them.
    zero = np.flatnonzero(v <= 0)
    for stretch in np.unique(np.searchsorted(zero, active)).tolist():
        a, b = int(zero[stretch - 1]) + 1 if stretch else 0, int(zero[stretch])
        values, stack = v[a : b + 1].tolist(), [b - a]
        for k in range(b - a - 1, -1, -1):
            while values[stack[-1]] >= values[k]:
                stack.pop()
            to[a + k] = a + stack[-1]
            stack.append(k)
    return to


def _nodes(shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Children of the tree's nodes without each node's largest: first leaf, end leaf, and for each the node's number
    among the last result's rows (first leaf, last leaf, depth)."""
    gaps = np.append(shared, -1)
    gaps[0] = -1
    right = _next_smaller(gaps)
    left = len(gaps) - 1 - _next_smaller(gaps[::-1])[::-1]
    k = np.flatnonzero(gaps > 0)
    if not len(k):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, np.zeros((0, 3), dtype=np.int64)
    low, high = left[k], right[k] - 1
    # Gaps of one node stand together and in order.
    by = np.argsort(low * len(gaps) + high, kind="stable")
    k, low, high = k[by], low[by], high[by]
    new = np.ones(len(k), dtype=bool)
    new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    head = np.flatnonzero(new)
    node = np.cumsum(new) - 1
    many = np.diff(np.append(head, len(k)))
    # One child in front of each gap, and one behind the last.
    at = np.arange(len(k)) + node
    begin, end = np.empty(len(k) + len(head), dtype=np.int64), np.empty(len(k) + len(head), dtype=np.int64)
    end[at], begin[at + 1] = k, k
    first = head + np.arange(len(head))
    begin[first], end[first + many] = low[head], high[head] + 1
    child = np.repeat(np.arange(len(head)), many + 1)
    size = end - begin
    largest = np.flatnonzero(size == np.maximum.reduceat(size, first)[child])
    small = np.ones(len(size), dtype=bool)
    small[largest[np.unique(child[largest], return_index=True)[1]]] = False
    return begin[small], end[small], child[small], np.stack([low[head], high[head], gaps[k[head]]], axis=1)


def _repeats(s: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Start and period of the branching tandem repeats that at least ``TIMES`` - 2 further periods precede."""
    begin, end, child, nodes = _nodes(common_prefixes(s, order))
    upto = np.cumsum(end - begin)
    found, a = [np.zeros((0, 2), dtype=np.int64)], 0
    while a < len(begin):
        done = upto[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(upto, done + LEAVES, side="right")))
        size = end[a:b] - begin[a:b]
        leaf = np.repeat(begin[a:b] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        low, high, depth = nodes[np.repeat(child[a:b], size)].T
        i = order[leaf]

        def test(i, low, high, depth):
            # All TIMES copies of the repeated words are leaves of the node, the last of them at i + depth.
            keep = i >= (TIMES - 2) * depth
            for back in (-1, *range(1, TIMES - 1), 0):
                i, low, high, depth = i[keep], low[keep], high[keep], depth[keep]
                at = rank[i - back * depth] if back else None
                keep = (at >= low) & (at <= high) if back else s[i + depth] != s[i + 2 * depth]
            return np.stack([i[keep], depth[keep]], axis=1)

        found.append(test(i, low, high, depth))
        # The leaf may be the second copy as well; the first, in front of it, is then a leaf too.
        earlier = i >= depth
        i, low, high, depth = i[earlier] - depth[earlier], low[earlier], high[earlier], depth[earlier]
        same = (rank[i] >= low) & (rank[i] <= high)
        found.append(test(i[same], low[same], high[same], depth[same]))
        a = b
    return np.unique(np.concatenate(found), axis=0)


def find_runs(number: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Maximal runs in texts of ``count`` words with the numbers ``number``: rows of text, start, length, period."""
    if not len(number):
        return np.zeros((0, 4), dtype=np.int64)
    s = _with_ends(number, count)
    order, rank = suffix_array(s)
    starts, periods = _repeats(s, order, rank).T
    by = np.lexsort((periods, starts + 2 * periods))
    out, last, runs = [], -1, []
    for i, p in zip(starts[by].tolist(), periods[by].tolist(), strict=True):
        end = i + 2 * p
        if end != last:
            last, runs = end, []
        # A repeat within a run of a smaller period that ends here repeats a multiple of that period.
        if any(i >= begin for begin in runs):
            continue
        begin = i - _agree(s, i - 1, i + p - 1, -1)
        runs.append(begin)
        if end - begin >= max(LEAST, TIMES * p):
            out.append((begin, end - begin, p))
    if not out:
        return np.zeros((0, 4), dtype=np.int64)
    rows = np.array(sorted(out), dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(count + 1)])
    text = np.searchsorted(first, rows[:, 0], side="right") - 1
    rows = np.column_stack([text, rows[:, 0] - first[text], rows[:, 1], rows[:, 2]])
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _collapsed(letters: np.ndarray, w: Words, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's words joined by one blank, without those that a run repeats, and the texts' offsets."""
    n = len(w.start)
    ramp = np.zeros(n + 1, dtype=np.int64)
    text, start, length, period = runs.T
    np.add.at(ramp, w.first[text] + start + period, 1)
    np.add.at(ramp, w.first[text] + start + length, -1)
    kept = np.flatnonzero(np.cumsum(ramp[:n]) == 0)
    size = w.end - w.start
    at = (np.cumsum(size) - size)[kept]
    size = size[kept]
    first = np.searchsorted(kept, w.first)
    last = np.zeros(len(kept), dtype=bool)
    last[first[1:][np.diff(first) > 0] - 1] = True
    ends = np.concatenate([[0], np.cumsum(size + ~last)])
    out = np.full(ends[-1], 0x20, dtype=np.uint8)
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(ends[:-1], size) + inside] = letters[np.repeat(at, size) + inside]
    return out, ends[first]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in chunks(batch.column(1)):
            w = Words(data, offsets)
            number, letters = _numbers(data, w)
            runs = find_runs(number, w.count)
            upto = np.searchsorted(runs[:, 0], np.arange(b - a + 1)).astype(np.int32)
            spans = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in (1, 2, 3)], fields=list(_RUN))
            text, at = _collapsed(letters, w, runs)
            kept = pa.Array.from_buffers(pa.large_string(), b - a, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(text)])
            yield pa.record_batch(
                [batch.column(0).slice(a, b - a), pa.array(w.count, pa.int64()), pa.ListArray.from_arrays(pa.array(upto), spans), kept.cast(pa.string())],
                names=["id", "n_words", "runs", "collapsed"],
            )


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every maximal run of at least ``TIMES`` periods and ``LEAST`` words in each whole text.

    Returns ``id_col``, ``n_words``, ``runs`` (an array of start, length and smallest period in words, by start, then
    period) and ``collapsed`` (the words joined by one blank, without those that a run contains after its first period).

    Texts are independent: nothing is shuffled, and memory grows with a chunk of texts or the longest single one. Null and
    empty texts have no words, no runs and an empty ``collapsed``. Null ids stay null, repeated rows give equal rows, other
    columns are ignored, an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return rows.mapInArrow(tidy(_batches), schema).withColumnRenamed("id", id_col)


SQL = f"""
WITH c AS ({CRC_TABLE}), a AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws, {crc32("CAST(doc_id AS VARCHAR)")} AS h FROM documents, c
), b AS (SELECT *, len(ws) AS n, h // 10 AS g FROM a),
d AS (SELECT *, g % greatest(n, 1) AS a, 1 + (n - g % greatest(n, 1)) // (3 + g % 8) AS p FROM b),
r AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN
    list_transform(range(n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE ws END AS ws
  FROM d
), w AS (SELECT doc_id, n, unnest(ws) AS w, unnest(range(n)) AS i FROM r),
e AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND {TIMES} * (y.i - x.i) <= x.n
), k AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e),
m AS (
  SELECT doc_id, q, min(i) AS s, count(*) + q AS l FROM k GROUP BY doc_id, q, island HAVING count(*) + q >= greatest({LEAST}, {TIMES} * q)
), u AS (SELECT doc_id, s, l, min(q) AS q FROM m GROUP BY doc_id, s, l),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM u),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS t FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
best AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS t,
    first(struct_pack(s, l, q) ORDER BY CAST(l AS DOUBLE) / q DESC, s, q) AS b
  FROM u GROUP BY doc_id
)
SELECT r.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(b.s AS BIGINT) AS start, CAST(b.l AS BIGINT) AS length,
  CAST(b.q AS BIGINT) AS period, CAST(1000 * b.l // b.q AS BIGINT) AS exponent_milli,
  sha256(coalesce(best.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM r LEFT JOIN best ON best.doc_id = r.doc_id LEFT JOIN kept ON kept.doc_id = r.doc_id
"""
