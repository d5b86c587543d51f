"""The prefix trie against one built from whole rebuilt conversations, and its parts."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int"


def head_of(c):
    return zlib.crc32(str(c).encode()) % 9


def by_hand(rows):
    """Nodes as the contract has them, from lists of texts."""
    own = defaultdict(list)
    for c, turn, role, text, _ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in own.items()}
    rebuilt = {}
    for c, ts in turns.items():
        base = int(np.fix(c / 5)) * 5
        rebuilt[c] = tuple(turns.get(base, [])[: head_of(c)] + ts[head_of(c) :])
    members = defaultdict(list)
    for c, seq in sorted(rebuilt.items()):
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = defaultdict(list)
    for seq in members:
        if seq:
            children[seq[:-1]].append(seq)
    leaves, saved = {}, {}
    for seq in sorted(members, key=len, reverse=True):
        leaves[seq] = sum(leaves[x] for x in children[seq]) or 1
        own_saved = (len(members[seq]) - 1) * len(seq[-1][1].encode()) if seq else 0
        saved[seq] = own_saved + sum(saved[x] for x in children[seq])
    ends = lambda seq: ",".join(str(c) for c in members[seq] if rebuilt[c] == seq)
    nodes = [
        (members[s][0], len(s), members[s[:-1]][0] if s else None, len(members[s]), len(children[s]), leaves[s], saved[s], hashlib.sha256(ends(s).encode()).hexdigest())
        for s in members
    ]
    return sorted(nodes, key=repr)


def found(spark, rows, parts=5):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    nodes = trie.prefix_trie(frame, base=lambda c: c - c % 5, head=lambda c: F.crc32(c.cast("string")) % 9, longest=8)
    assert nodes.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in nodes.collect()), key=repr)


def made():
    """Copies, long and hot conversations, null turns, roles, texts and ids, absent bases and turnless ones."""
    rng = random.Random(11)
    rows = [(None, 0, "user", "nobody's", 1), (3, None, None, None, 1), (3, 1, "user", "é", 1), (3, 1, "user", "é", 1), (-7, 0, "u", "below", 1), (-5, 0, "u", "base", 1), (-5, 1, "u", "é" * 9, 1)]
    script = [("user" if i % 2 else "bot", f"line {i} " * rng.randint(0, 3)) for i in range(60)]
    for c in range(40, 140):
        turns = script[: rng.choice([0, 1, 2, 9, 10, 40])] + [("user", rng.choice("xy")) for _ in range(rng.randint(0, 4))]
        rows += [(c, i, r, t, 1) for i, (r, t) in enumerate(turns)]
    rows += [(c, i, "user", "again", 1) for c in range(200, 240) for i in range(12)]
    rows += [(500, i, "user", str(i % 7), 1) for i in range(900)] + [(504, i, "user", str(i % 7), 1) for i in range(900)]
    rng.shuffle(rows)
    return rows


def test_trie_is_that_of_rebuilt_lists(spark):
    rows = made()
    assert found(spark, rows) == by_hand(rows)


@pytest.mark.parametrize("rows", [[], [(None, 1, "a", "b", 1)], [(7, None, None, None, 1)], [(5, 0, "a", "", 1), (5, 0, "a", "", 1), (6, 0, "a", "", 1)]])
def test_small_tables(spark, rows):
    assert found(spark, rows, 2) == by_hand(rows)


def test_products_compose():
    """Head of the base, inverse of the own head, own prefix: equal to the product of the rebuilt turns."""
    products = trie.Products(4)
    rng = np.random.default_rng(0)
    base, own = (rng.integers(0, 1 << 62, (n, 4)) for n in (6, 9))

    def product(turns):
        value = np.zeros((1, 4), np.uint64)
        for i, turn in enumerate(turns):
            value = products.then(np.array([i]), value, trie.turn_value(turn[None]) * products.base % trie.PRIMES)
        return value

    for h in range(7):
        suffix = products.without(np.array([h]), product(own[:h]), product(own))
        rebuilt = products.then(np.array([h]), product(base[:h]), suffix)
        assert (rebuilt == product(np.concatenate((base[:h], own[h:])))).all()
    lanes = product(base)
    assert (trie.unpack(*trie.pack(lanes)) == lanes).all()


def test_equal_fingerprints_of_different_turns_are_told_apart(spark, monkeypatch):
    """With fingerprints that all collide the first tries are given up; the result is right or there is none."""
    rows = [(c, i, "user", f"{c % 3}-{i}", 1) for c in range(10, 30) for i in range(9)]
    right = trie.turn_value
    tried = []
    original = trie._members

    def members(turns, base, head, longest, seed):
        tried.append(seed)
        monkeypatch.setattr(trie, "turn_value", (lambda refs: right(refs) * np.uint64(0)) if seed < 2 else right)
        return original(turns, base, head, longest, seed)

    monkeypatch.setattr(trie, "_members", members)
    assert found(spark, rows) == by_hand(rows)
    assert tried == [0, 1, 2]


@pytest.fixture
def uncoalesced(spark):
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    yield
    spark.conf.unset(setting)


def test_long_conversation_is_cut_over_tasks(spark, uncoalesced):
    rows = [(9, i, "user", str(i % 5), 1) for i in range(3000)] + [(8, 0, "user", "0", 1)]
    turns = trie._turns(spark.createDataFrame(rows, SCHEMA).repartition(6))
    local = trie._products_in_tasks(turns, 0)
    assert local.where("conv = 9").select("part").distinct().count() > 1
    places = [r.place for r in trie.prefixes(turns, 0).where("conv = 9").orderBy("place").collect()]
    assert places == list(range(1, 3001))


def test_trie_of_conversations_over_many_tasks(spark, uncoalesced):
    rows = [r for r in made() if (r[0] or 0) >= 40]
    assert found(spark, rows) == by_hand(rows)
