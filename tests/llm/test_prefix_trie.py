"""The prefix trie against a plain one: forks, ties, nulls, long conversations, equal ones."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from veilframe.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, k1 string"


def conversations():
    rows = [(c, t, "user" if t % 2 else None, f"t{t}" if c % 3 else f"u{t % 4}", "x", "y") for c in range(37) for t in range(c * 7 % 12)]
    rows += [(40, None, "a", "first", "x", None), (40, 5, None, None, "x", None), (40, 5, "b", "tie", "x", None), (40, 5, "b", "eit", "x", None)]
    rows += [(41, 1, "r", "same", None, None)] * 3  # repeated rows are turns of their own
    rows += [(None, 1, "r", "nobody", None, None), (-7, 0, "r", "naïve €", None, None), (45, 1, "", "", None, None)]
    rows += [(50, t, "r", f"deep {t}", None, None) for t in range(70)]
    rows += [(100 + i, t, "r", f"shared {t}", None, None) for i in range(60) for t in range(12)]
    return rows


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def plain_trie(rows, every, most):
    """Nodes by brute force, as tuples in the order of the result's columns."""
    turns = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", md5(text or ""), text or ""))
    own = {c: [(r, x) for *_, r, _, x in sorted(ts)] for c, ts in turns.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % most
        base = c - (abs(c) % every) * (1 if c >= 0 else -1)
        rebuilt[c] = own.get(base, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out, totals = [], {}
    for node in sorted(members, key=len, reverse=True):
        saved = (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        below = [totals[k] for k in children[node]]
        totals[node] = (max(1, sum(b[0] for b in below)) if not below else sum(b[0] for b in below), saved + sum(b[1] for b in below))
        ends = ",".join(str(c) for c in sorted(members[node]) if len(rebuilt[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(members[node]), len(node), parent, len(members[node]), len(children[node]), *totals[node], digest))
    return sorted(out, key=str)


@pytest.mark.parametrize("band", [1, 4, None])
def test_trie(spark, monkeypatch, band):
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA)
    if band == 1:  # as many rounds as depths
        rows = [r for r in rows if r[0] != 50 or r[1] < 12]
        df = spark.createDataFrame(rows, SCHEMA)
    convs, turns = prefix_trie.forked(prefix_trie.turn_table(df), 5, 9)
    got = prefix_trie.prefix_trie(convs, turns, band)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", *prefix_trie.TOTALS, "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_trie(rows, 5, 9)


def test_long_conversation_is_split(spark):
    """The windows and groups over turns hold one band of one conversation at most."""
    convs, turns = prefix_trie.forked(prefix_trie.turn_table(spark.createDataFrame(conversations(), SCHEMA)), 5, 9)
    rows = prefix_trie.node_rows(turns, 8)
    assert rows.agg(F.max(F.size("chain"))).first()[0] == 8
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(conv" in plan and plan.count("Window") >= 2


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    convs, turns = prefix_trie.forked(prefix_trie.turn_table(none), 5, 9)
    assert prefix_trie.prefix_trie(convs, turns).count() == 0


def test_turnless_conversation(spark):
    """Conversation 1 gives all its turns up, and there is no conversation 0."""
    assert zlib.crc32(b"1") % 9 > 1
    convs, turns = prefix_trie.forked(prefix_trie.turn_table(spark.createDataFrame([(1, 0, "r", "x", "", "")], SCHEMA)), 5, 9)
    want = hashlib.sha256(b"1").hexdigest()
    assert list(map(tuple, prefix_trie.prefix_trie(convs, turns).collect())) == [(1, 0, None, 1, 0, 1, 0, want)]
