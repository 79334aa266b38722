"""Byte-level BPE as a lazily determinised finite-state transducer, and its streaming inverse.

The tokens of a text's prefixes determine each other: the prefix that ends at byte *i* ends with the one token *t* that
may follow the last token of the prefix ending at *i* - \\|t\\|. The machine reads bytes left to right. Its states are sets
of places in the vocabulary's trie, one for every start from which an entry may still be growing; they are determinised
on first sight and their moves kept, which makes later reading a table walk. A move tells which entries end at the byte,
and what the last tokens within reach of the longest entry were tells which of them is the token there. Tokens are certain
where the chains of last tokens of all starts meet, which is never further back than the longest entries reach, so long
pieces are emitted as they are read.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import KEPT, tidy

FOREVER = 1 << 40
RANK_BITS = 20
START = (1 << RANK_BITS) - 1  #: stands before the first token of a piece
EMIT_BYTES = 4096  #: read before certain tokens are emitted
MOVES = 300_000  #: moves, and pairs of neighbours, kept before the machine forgets and starts anew
PIECES = 150_000  #: pieces of text in a generation of those whose tokens a worker remembers
ROWS_BYTES = 1 << 22  #: token bytes in an output batch


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The entries of a rank file: a base64 entry and its rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class Transducer:
    """Encodes one piece of text (bytes) at a time into ranks.

    Its tables hold small numbers and few tuples, so they stay small and the garbage collector has little to visit.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.entry = {r: e for e, r in ranks.items()}
        self.child: dict[int, int] = {}  # place << 8 | byte to place << 8
        self.rank_at, self.depth = array("i", [-1]), array("i", [0])
        for e, r in ranks.items():
            node = 0
            for b in e:
                if (to := self.child.get(node | b)) is None:
                    to = self.child[node | b] = len(self.rank_at) << 8
                    self.rank_at.append(-1)
                    self.depth.append(self.depth[node >> 8] + 1)
                node = to
            self.rank_at[node >> 8] = r
        self.size = {r: len(e) for e, r in ranks.items()}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.edges: dict[int, list[tuple[bytes, int]]] = {}
        self.pairs: dict[int, bool] = {}
        self.forget()

    def forget(self) -> None:
        self.moves: dict[int, tuple[int, tuple]] = {}  # state << 8 | byte to (next state << 8, tokens that may end here)
        self.states, self.number = [(0,)], {(0,): 0}

    def split(self, rank: int) -> tuple[int, int] | None:
        """The two entries whose merge makes this one; None for a single byte."""
        if rank not in self.halves:
            parts = [bytes([b]) for b in self.entry[rank]]
            while len(parts) > 2:
                best = min((self.ranks.get(parts[i] + parts[i + 1], FOREVER), i) for i in range(len(parts) - 1))
                if best[0] >= rank:
                    break
                parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
            self.halves[rank] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[rank]

    def edge(self, rank: int, right: bool) -> list[tuple[bytes, int]]:
        """What stands at an entry's right or left edge while it is merged: (entry, rank of the merge that ends it)."""
        if (key := rank << 1 | right) not in self.edges:
            out, until, now = [], FOREVER, rank
            while True:
                out.append((self.entry[now], until))
                if (parts := self.split(now)) is None:
                    break
                until, now = now, parts[right]
            self.edges[key] = out
        return self.edges[key]

    def follows(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both leaves exactly these two entries.

        It doesn't if two entries that meet at the border at some time merge before either is merged elsewhere; of two
        equal merges the left one comes first.
        """
        if left == START:
            return True
        find, edge = self.ranks.get, self.edge(right, False)
        for start, until in self.edge(left, True):
            for b, ends in edge:
                if (r := find(start + b)) is not None and r < until and r <= ends:
                    return False
        return True

    def pair(self, key: int) -> bool:
        """``follows`` of a pair of tokens, kept."""
        if len(self.pairs) > MOVES:
            self.pairs.clear()
        out = self.pairs[key] = self.follows(key >> RANK_BITS, key & START)
        return out

    def move(self, key: int) -> tuple[int, tuple]:
        """Determinise one move: the next state, and (token, length) of all entries that end here, longest first."""
        byte, ends, state = key & 255, [], []
        for place in self.states[key >> 8]:
            if (to := self.child.get(place | byte)) is not None:
                state.append(to)
                if (r := self.rank_at[to >> 8]) >= 0:
                    ends.append((r, self.size[r]))
        if not ends:
            raise ValueError(f"no entry of the vocabulary ends with byte {byte}")
        state = (*state, 0)
        if (number := self.number.get(state)) is None:
            number = self.number[state] = len(self.states)
            self.states.append(state)
        out = self.moves[key] = number << 8, tuple(ends)
        return out

    def encode(self, piece: bytes) -> list[int]:
        if len(self.moves) > MOVES:
            self.forget()
        move, pair, state, last, out, size = self.moves.get, self.pairs.get, 0, [START], [], self.size
        for a in range(0, len(piece), EMIT_BYTES):
            if a:
                out += self.certain(state >> 8, last)
            for b in piece[a : a + EMIT_BYTES]:
                state, ends = move(state | b) or self.move(state | b)
                i = len(last)
                for token, length in ends:
                    key = last[i - length] << RANK_BITS | token
                    if (ok := pair(key)) or (ok is None and self.pair(key)):
                        break
                else:
                    raise ValueError("the vocabulary can't be merged to this text")
                last.append(token)
        back, i = [], len(last) - 1
        while i:
            t = last[i]
            back.append(t)
            i -= size[t]
        back.reverse()
        return out + back if out else back

    def certain(self, state: int, last: list[int]) -> list[int]:
        """Takes the tokens off the front of ``last`` on which all starts of a state agree."""
        size, n = self.size, len(last) - 1
        ends = {n - self.depth[place >> 8] for place in self.states[state]}
        while len(ends) > 1:
            far = max(ends)
            ends.remove(far)
            ends.add(far - size[last[far]])
        (meet,) = ends
        out, i = [], meet
        while i:
            t = last[i]
            out.append(t)
            i -= size[t]
        out.reverse()
        del last[:meet]
        return out


def _packed(tokens: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    out = array("I", tokens)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class _Memory(dict):
    """Pieces of text to the little-endian bytes of their tokens.

    There are two generations: when the younger one is full it becomes the older one, from which pieces that are seen
    again return. What is used often is therefore never forgotten, and memory stays bounded.
    """

    def __init__(self, machine: Transducer):
        self.machine, self.older = machine, {}

    def __missing__(self, piece: str) -> bytes:
        if (out := self.older.get(piece)) is None:
            out = _packed(self.machine.encode(piece.encode("utf-8", "surrogatepass")))
            if len(piece) > 48:
                return out
        if len(self) >= PIECES:
            self.older = dict(self)
            self.clear()
        self[piece] = out
        return out


def _machine(data: bytes) -> _Memory:
    """The machine of a vocabulary, kept by the worker process: later tasks go on with the moves that are known."""
    key = hashlib.sha256(data).digest()
    if key not in KEPT:
        KEPT.clear()
        KEPT[key] = _Memory(Transducer(read_ranks(data)))
    return KEPT[key]


class Utf8Stream:
    """Incremental UTF-8: takes bytes as they come and gives the text that is certain so far.

    Between calls the state is the unfinished character at the end, three bytes at most. Bytes that can't be part of a
    character become U+FFFD.
    """

    def __init__(self):
        self.open = b""

    @staticmethod
    def unfinished(data: bytes) -> int:
        """How many bytes at the end begin a character that isn't complete."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead < 0x80 or lead >= 0xF5:
                return 0
            if lead >= 0xC0:
                need = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                return back if lead >= 0xC2 and back < need else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.open + data
        k = self.unfinished(data)
        self.open = data[len(data) - k :]
        return data[: len(data) - k].decode("utf-8", "replace")

    def close(self) -> str:
        out, self.open = self.open.decode("utf-8", "replace"), b""
        return out


def _encoder(ranks, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _machine(ranks.value)
        look, find = regex.compile(pattern).findall, memory.__getitem__

        def flush(ids: pa.Array, tokens: list[bytes]) -> pa.RecordBatch:
            values = pa.array(np.frombuffer(b"".join(tokens), dtype="<i4"))
            at = np.concatenate([[0], np.cumsum([len(t) // 4 for t in tokens])]).astype(np.int32)
            return pa.record_batch([ids, pa.ListArray.from_arrays(pa.array(at), values)], names=["id", "tokens"])

        for batch in batches:
            done, first, size = [], 0, 0
            for i, text in enumerate(batch.column(1)):
                done.append(b"".join(map(find, look(text.as_py() or ""))))
                size += len(done[-1])
                if size >= ROWS_BYTES:
                    yield flush(batch.column(0).slice(first, len(done)), done)
                    done, first, size = [], i + 1, 0
            if done:
                yield flush(batch.column(0).slice(first, len(done)), done)

    return run


def encode(
    docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Token ids (``tokens``, array of int) of every whole text, keyed by ``id_col``, one row per input row.

    ``vocabulary`` is the path of a rank file, read on the driver and broadcast (a vocabulary has a fixed size);
    ``pattern`` cuts texts into pieces that are encoded separately. There are no special tokens. Null and empty texts
    give an empty array. Other columns are ignored, whatever their names; an empty table gives no rows. Rows are
    independent: no shuffle, and a lost task is redone alone.
    """
    with open(vocabulary, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = T.StructType(
        [T.StructField("id", docs.schema[id_col].dataType), T.StructField("tokens", T.ArrayType(T.IntegerType()))]
    )
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(_encoder(ranks, pattern), keeps=True), schema).withColumnRenamed("id", id_col)


def _decoder(ranks, step: int, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _machine(ranks.value).machine.entry
        for batch in batches:
            first, size, texts, digests = 0, 0, [], []
            column = batch.column(1)
            for i in range(batch.num_rows):
                ids = column[i].values.to_numpy() if column[i].is_valid else np.zeros(0, dtype=np.int32)
                stream, parts = Utf8Stream(), []
                for a in range(0, len(ids), step):
                    parts.append(stream.feed(b"".join(map(table.__getitem__, ids[a : a + step].tolist()))))
                parts.append(stream.close())
                texts.append("".join(parts))
                digests.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                size += len(texts[-1])
                if size >= ROWS_BYTES or i + 1 == batch.num_rows:
                    ids_of = batch.column(0).slice(first, len(texts))
                    counts = pa.compute.fill_null(pa.compute.list_value_length(column.slice(first, len(texts))), 0)
                    out = [ids_of, counts.cast(pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())]
                    names = ["id", "n_tokens", "ids_sha256", "text"]
                    if keep:
                        out, names = [*out, column.slice(first, len(texts))], [*names, "tokens"]
                    yield pa.RecordBatch.from_arrays(out, names=names)
                    first, size, texts, digests = i + 1, 0, [], []

    return run


def decode(
    tokens: DataFrame, vocabulary: str, id_col: str = "doc_id", step: int = 4096, keep_tokens: bool = False
) -> DataFrame:
    """The inverse of ``encode``: ``id_col``, ``n_tokens``, ``ids_sha256`` (of the ids as unsigned 32-bit little-endian
    integers) and ``text``; ``keep_tokens`` passes ``tokens`` on.

    Tokens are turned into text ``step`` at a time; characters cut by a token or a step border are completed by the next
    one. Bytes that form no character (possible only for ids that no text encodes to) become U+FFFD; an id outside the
    vocabulary fails. A null array decodes to an empty text.
    """
    with open(vocabulary, "rb") as f:
        ranks = tokens.sparkSession.sparkContext.broadcast(f.read())
    schema = T.StructType(
        [
            T.StructField("id", tokens.schema[id_col].dataType),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("text", T.StringType()),
            *([T.StructField("tokens", T.ArrayType(T.IntegerType()))] if keep_tokens else []),
        ]
    )
    rows = tokens.select(F.col(id_col).alias("id"), "tokens")
    return rows.mapInArrow(tidy(_decoder(ranks, step, keep_tokens), keeps=True), schema).withColumnRenamed("id", id_col)


def _both_ways(ranks, pattern: str, step: int, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _machine(ranks.value)
        look, find, table = regex.compile(pattern).findall, memory.__getitem__, memory.machine.entry.__getitem__

        def flush(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
            n, sha, back, tokens = zip(*rows, strict=True)
            out = [ids, pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep:
                at = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                values = pa.array(np.frombuffer(b"".join(tokens), dtype="<i4"))
                out, names = [*out, pa.ListArray.from_arrays(at, values)], [*names, "tokens"]
            return pa.record_batch(out, names=names)

        for batch in batches:
            rows, first, size = [], 0, 0
            for i, text in enumerate(batch.column(1)):
                raw = b"".join(map(find, look(text.as_py() or "")))
                ids, stream, digest = np.frombuffer(raw, dtype="<u4"), Utf8Stream(), hashlib.sha256()
                for a in range(0, len(ids), step):
                    digest.update(stream.feed(b"".join(map(table, ids[a : a + step].tolist()))).encode())
                digest.update(stream.close().encode())
                rows.append((len(ids), hashlib.sha256(raw).hexdigest(), digest.hexdigest(), raw if keep else b""))
                size += len(raw) if keep else 256
                if size >= ROWS_BYTES:
                    yield flush(batch.column(0).slice(first, len(rows)), rows)
                    rows, first, size = [], i + 1, 0
            if rows:
                yield flush(batch.column(0).slice(first, len(rows)), rows)

    return run


def round_trip(
    docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", step: int = 4096,
    keep_tokens: bool = False, keep_machine: bool = True,
) -> DataFrame:
    """``encode`` and ``decode`` in one pass over the texts: ``id_col``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` (of
    the decoded text's bytes) and, if asked for, ``tokens``.

    The ids are decoded as soon as a text is encoded, by the same streaming decoder, and never travel between two
    workers. Rows are as in ``encode``. Without ``keep_machine`` a task's machine goes with the task: later tasks begin
    anew, and workers that wait beside other stages hold no memory for it.
    """
    with open(vocabulary, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    text = T.StringType()
    fields = [
        T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", text), T.StructField("decoded_sha256", text),
    ]
    if keep_tokens:
        fields.append(T.StructField("tokens", T.ArrayType(T.IntegerType())))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    run = tidy(_both_ways(ranks, pattern, step, keep_tokens), keeps=keep_machine)
    return rows.mapInArrow(run, T.StructType(fields)).withColumnRenamed("id", id_col)
