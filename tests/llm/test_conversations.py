"""Prefix trie and structure repair against brute force: nulls, ties, repeated rows, long and hot conversations."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonagrid.llm import conversation_queries, conversation_repair, prefix_trie, scans
from tests.compare import assert_same, connection
from tests.conftest import SMALL

TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("name", sorted(conversation_queries.oracle_sql()))
def test_sql(spark, name):
    assert_same(conversation_queries.queries()[name](spark, SMALL), connection(SMALL), conversation_queries.oracle_sql()[name])


def conversations(seed: int, n: int = 40) -> list[tuple]:
    """Few roles and texts, so that prefixes, duplicates and ties are common; nulls everywhere; gaps in the turns."""
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.choice([1, 2, 3, 5, 9])):
            turn = r.choice([t, t, t, t + 1, None])
            rows.append((r.choice([c, c, c, -c]), turn, r.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), r.choice(["Yes.", "No", "Yes. ", "", " \n", "Ü?", None])))
    return rows + rows[:7] + [(None, 1, "user", "x"), (None, None, None, None)]


def digest(role: str, text: str) -> bytes:
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def ordered(rows: list[tuple], null: str) -> dict:
    out: dict = {}
    for c, t, role, text in rows:
        role, text = null if role is None else role, null if text is None else text
        out.setdefault(c, []).append((t is not None, t or 0, role, digest(role, text), text, t))
    return {c: [(x[5], x[2], x[4]) for x in sorted(v, key=lambda x: x[:4])] for c, v in out.items()}


# --- scans ---


def test_scans_over_runs_of_any_length(spark):
    r = random.Random(5)
    rows = [(k, i, r.randrange(-9, 9), r.random() < 0.3) for k, n in ((None, 5), (1, 700), (2, 1), (3, 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, i int, v long, m boolean").repartition(7)
    sums = {(x.k, x.i): (x.place, x.sum_v) for x in scans.scan(df, ["k"], [F.col("i")], scans.sums("v"), "t").collect()}
    marks = {(x.k, x.i): (x.marked, x.last_v) for x in scans.scan(df, ["k"], [F.col("i")], scans.last_marked("m", "v"), "t").collect()}
    prints = {(x.k, x.i): x.print for x in scans.scan(df, ["k"], [F.col("i")], scans.prefix_fingerprints("v"), "t").collect()}
    total, last, poly, run = 0, (0, 0), 0, ()
    for k, i, v, m in rows:
        if run != (k,):
            total, last, poly, run = 0, (0, 0), 0, (k,)
        total, last, poly = total + v, (1, v) if m else last, (poly * 0x9E3779B97F4A7C15 + v) % 2**64
        assert sums[k, i] == (i + 1, total) and marks[k, i] == last and prints[k, i] % 2**64 == poly
    assert scans.scan(df.filter("false"), ["k"], [F.col("i")], scans.place(), "t").count() == 0


def test_scan_deals_equal_rows(spark):
    """One key with equal rows only is dealt over several tasks and still numbered without a gap."""
    df = spark.range(4000).select(F.lit(1).alias("k"), F.lit(2).alias("i"))
    found = scans.scan(df, ["k"], [F.col("i")], scans.place(), "t")
    assert sorted(x.place for x in found.collect()) == list(range(1, 4001))


# --- repair ---


def repaired(rows: list[tuple]) -> tuple:
    """By all ways through the states, the audit carried along."""
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append(1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0)
        seen.add((role, text))
    steps = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    names = {"u": "user", "a": "assistant"}

    def insert(ways):
        ways = dict(ways)
        for _ in range(3):
            for (s, c), z in steps.items():
                if c != "s" and s in ways:
                    cost, audit, text = ways[s]
                    ways[z] = min(ways.get(z, (10**9,)), (cost + 3, audit + "I", (*text, f"{names[c]}:")))
        return ways

    ways = insert({0: (0, "", ())})
    for (_, role, text), fault in zip(rows, faults, strict=True):
        after: dict = {}
        for s, (cost, audit, done) in ways.items():
            options = [(s, 4, "D", ())]
            if fault not in (1, 2):
                more = 3 * (fault == 3)
                for (q, c), z in steps.items():
                    if q == s and role[:1] == c:
                        options.append((z, more, "K", (f"{role}:{text}",)))
                    if q == s and c != "s":
                        options.append((z, 3 + more, "R", (f"{names[c]}:{text}",)))
            for z, price, edit, written in options:
                after[z] = min(after.get(z, (10**9,)), (cost + price, audit + edit, done + written))
        ways = insert(after)
    cost, audit, done = min(ways[s] for s in (0, 3) if s in ways)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, hashlib.sha256("\n".join(done).encode()).hexdigest())


def test_repair_is_the_cheapest(spark):
    rows = conversations(1)
    df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit(1) for c in ("place", "seq", "fault", "_chance", "kind", "audit", "digest")})
    want = {c: repaired(v) for c, v in ordered(rows, " ").items()}
    for segment_rows in (4096, 2, 1):  # whole, and multiplied on by segments
        got = {x[0]: tuple(x[1:]) for x in conversation_repair.repair(df, segment_rows).collect()}
        assert got == want
    assert conversation_repair.repair(df.filter("false")).count() == 0


def test_long_conversation_over_all_partitions(spark):
    """A third of all rows and more are one conversation; one text is longer than a segment."""
    r = random.Random(2)
    rows = [(1, i, r.choice(["user", "assistant"]), r.choice(["A.", "B", ""]) + str(i)) for i in range(3000)] + [(2, 0, "user", "x" * 5_000_000 + "."), (3, 0, "user", "?")]
    got = {x[0]: tuple(x[1:]) for x in conversation_repair.repair(spark.createDataFrame(rows, TURNS).repartition(8), 100).collect()}
    assert got == {c: repaired(v) for c, v in ordered(rows, " ").items()}


def test_product_is_associative():
    r = random.Random(4)
    turns = list(conversation_repair.TURNS.values())
    for _ in range(50):
        a, b, c = r.choices(turns, k=3)
        product = conversation_repair.product
        assert product(product(a, b), c) == product(a, product(b, c))


def test_damage_report_has_every_conversation(spark):
    rows = conversations(3)
    want = {}
    kept: dict = {c: [] for c, *_ in rows}
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        if kind:
            kept[c] += [(c, t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for c, left in kept.items():
        want[c] = repaired(ordered(left, " ")[c]) if left else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert {x[0]: tuple(x[1:]) for x in conversation_repair.damage_report(spark.createDataFrame(rows, TURNS)).collect()} == want


# --- prefix trie ---


def trie(sequences: dict[int, list]) -> set[tuple]:
    nodes: dict = {}
    for c, seq in sequences.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    out = set()
    for path, members in nodes.items():
        children = [p for p in nodes if len(p) == len(path) + 1 and p[:-1] == path]
        below = [p for p in nodes if p[: len(path)] == path]
        leaves = sum(not any(len(q) == len(p) + 1 and q[:-1] == p for q in nodes) for p in below)
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in below if p)
        ends = sorted(c for c in members if len(sequences[c]) == len(path))
        parent = min(nodes[path[:-1]]) if path else None
        out.add((min(members), len(path), parent, len(members), len(children), leaves, saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


def rebuilt(rows: list[tuple]) -> dict[int, list]:
    own = {c: [(role, text) for _, role, text in v] for c, v in ordered([x for x in rows if x[0] is not None], "").items()}
    out = {}
    for c, seq in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        out[c] = own.get(base, [])[:h] + seq[h:]
    return out


def nodes_of(df) -> set[tuple]:
    rows = [tuple(x) for x in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("bits", [64, 2])
def test_trie_of_rebuilt_conversations(spark, bits):
    """With hashes of two bits most groups hold different sequences, and are split."""
    rows = conversations(6, 120)
    df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit(1) for c in ("place", "own", "depth", "print", "hash", "before", "light")})
    ids, turns = prefix_trie.rebuilt(df)
    assert nodes_of(prefix_trie.prefix_trie(ids, turns, ["own", "place"], bits)) == trie(rebuilt(rows))


def test_snapshots_of_a_growing_conversation(spark):
    """Conversation c holds the first c turns of one: the deepest nesting there is; and a third share one first turn."""
    sequences = {c: [("user", str(i)) for i in range(c)] for c in range(60)} | {100 + c: [("user", "hello"), ("assistant", f"n{c % 7}")] for c in range(60)}
    turns = spark.createDataFrame([(c, i, *x) for c, s in sequences.items() for i, x in enumerate(s)], "conv_id long, i long, role string, text string")
    ids = spark.createDataFrame([(c,) for c in sequences], "conv_id long")
    assert nodes_of(prefix_trie.prefix_trie(ids, turns, ["i"])) == trie(sequences)


def test_empty_trie(spark):
    ids, turns = prefix_trie.rebuilt(spark.createDataFrame([], TURNS))
    assert prefix_trie.prefix_trie(ids, turns, ["own", "place"]).count() == 0
