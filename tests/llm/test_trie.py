import hashlib
import random
import zlib

from keelson.llm import queries, trie

SCHEMA = "conv_id long, turn int, role string, text string, depth string, p1 string, id int, n int, block string"


def key(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def in_order(rows):
    """Turns of each conversation: null turns first, equal ones by their digests."""
    out = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            out.setdefault(c, []).append((turn is not None, turn or 0, key(role or "", text or ""), role or "", text or ""))
    return {c: [t[3:] for t in sorted(x)] for c, x in out.items()}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def brute(convs):
    """Every prefix of every conversation with its members; subtrees by looking at all nodes."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = []
    for p, m in members.items():
        below, todo = [], [p]
        while todo:
            below.append(todo.pop())
            todo += kids.get(below[-1], [])
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        end = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), sum(x not in kids for x in below), saved, hashlib.sha256(end.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, again=lambda t: t, piece=trie.PIECE):
    own = trie.turns(spark.createDataFrame(rows, SCHEMA))
    members = own.groupBy("conv_id").count().withColumnRenamed("count", "n_turns")
    prefixed = trie.prefixes(own)
    nodes = trie.prefix_trie(prefixed, members)
    digests = {(r.depth, r.p1, r.p2): r.ends_sha256 for r in trie.ends_digest(trie.ends(prefixed, members), piece).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    nodes = nodes.collect()
    assert sorted(r.place for r in nodes) == list(range(len(nodes)))
    return nodes, sorted(
        ((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, digests.get((r.depth, r.p1, r.p2), nothing)) for r in nodes), key=repr
    )


def make(seed, n=60, long=0):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(1000), n):
        for turn in range(rng.choice([1, 2, 3, 6])):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["", "a", "ä", None, "bc"]), "x", "y", 1, 2, "z"))
    for c in range(2000, 2000 + long):
        rows += [(c, turn, "user", f"t{turn % 7}" if turn < 40 - c % 3 else f"u{c % 2}", "x", "y", 1, 2, "z") for turn in range(45)]
    rng.shuffle(rows)
    return rows


def test_equals_brute_force(spark, monkeypatch):
    """With conversations of many blocks, several levels of names, ids in several pieces and several cells."""
    monkeypatch.setattr(trie, "BLOCK", 4)
    monkeypatch.setattr(trie, "CELL", 16)
    rows = make(4, long=5)
    rows += [(7, None, "user", "first", *rows[0][4:]), (7, 3, "b", "c", *rows[0][4:]), (7, 3, "b", "a", *rows[0][4:]), (7, 3, "b", "a", *rows[0][4:])]
    rows += [(None, 1, "user", "no conversation", *rows[0][4:])]
    nodes, got = found(spark, rows, piece=3)
    assert got == brute(in_order(rows))
    # A subtree is the stretch of places from its top to its last one.
    depth = {r.place: r.depth for r in nodes}
    for r in nodes:
        assert r.last == next((k - 1 for k in range(r.place + 1, len(nodes)) if depth[k] <= r.depth), len(nodes) - 1)


def test_roles_and_texts_are_kept_apart(spark):
    rows = [(c, 0, r, t, "x", "y", 1, 2, "z") for c, (r, t) in enumerate([("a", "bc"), ("ab", "c"), ("", "abc"), ("1:a", "")])]
    assert found(spark, rows)[1] == brute(in_order(rows))


def test_no_rows(spark):
    assert found(spark, [])[1] == []
    assert found(spark, [(None, 1, "user", "x", "x", "y", 1, 2, "z")])[1] == []


def test_hot_conversation_and_hot_beginning(spark):
    """A third of all conversations equal, another third with one first turn, and one very long conversation."""
    rows = [(c, t, "user", f"same {t}", "x", "y", 1, 2, "z") for c in range(300) for t in range(3)]
    rows += [(c, t, "user", "same 0" if t == 0 else f"own {c}", "x", "y", 1, 2, "z") for c in range(300, 600) for t in range(2)]
    rows += [(600, t, "user", f"long {t}", "x", "y", 1, 2, "z") for t in range(1500)]
    assert found(spark, rows, piece=64)[1] == brute(in_order(rows))


def test_query_equals_brute_force_on_rebuilt_conversations(spark):
    d = "/root/testdata/sf0.001"
    own = in_order([tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])
    got = sorted(map(tuple, queries.op12_trie(spark, d).collect()), key=repr)
    assert got == brute(rebuilt(own))
