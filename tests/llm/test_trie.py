"""The conversation trie against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from retenta.llm import trie

TURNS = "conv_id bigint, turn bigint, role string, text string"


def sequences_of(rows, block=None, heads=4):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn), role, digest, text))
    own = {c: [(role, text) for _, role, _, text in sorted(ts)] for c, ts in own.items()}
    if block is None:
        return own
    rebuilt = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % heads, c - int(np.fmod(c, block))
        rebuilt[c] = own.get(base, [])[:h] + turns[h:]
    return rebuilt


def expected(sequences):
    members, children = defaultdict(list), defaultdict(set)
    for c in sorted(sequences):
        turns = tuple(sequences[c])
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
            if d:
                children[turns[: d - 1]].add(turns[:d])
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = children[node]
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[n] for n in own) if own else 1
        saved[node] = (len(members[node]) - 1) * words + sum(saved[n] for n in own)
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in convs if len(sequences[c]) == len(node))
        parent = members[node[:-1]][0] if node else None
        out.append((convs[0], len(node), parent, len(convs), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def turn_rows(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-45, 6 * n), n):
        for t in range(rng.choice([1, 1, 2, 3, 5, 8])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a b", "a  b c", "", None, "x\n\ty"])))
    long = [(7000, t, "user", "on and on") for t in range(90)]
    rows += long + [(7001, t, "user", "on and on") for t in range(70)] + [(7020 + c, 0, "user", "hot") for c in range(150)]
    rows += [(-20, None, "user", "null turn"), (-20, None, "user", "null turn"), (-20, 3, "b", "tie"), (-20, 3, "a", "tie")]
    return rows + [(None, 0, "user", "no id"), (8000, 1, None, None), *[(8001, 5, "user", "same row")] * 30]


@pytest.mark.parametrize("bound", [4, trie.BOUND])
def test_nodes_of_conversations(spark, bound):
    rows = turn_rows(1, 60)
    df = spark.createDataFrame(rows, TURNS).repartition(4).withColumns({n: F.lit(1) for n in ("node", "depth", "comp", "pos")})
    assert found(trie.conversation_trie(df, bound)) == expected(sequences_of(rows))


def test_nodes_of_rebuilt_conversations(spark):
    rows = turn_rows(2, 90)
    df = spark.createDataFrame(rows, TURNS).repartition(3)
    assert found(trie.shared_head_trie(df)) == expected(sequences_of(rows, 20))


def test_turnless_and_empty(spark):
    # Of conversation 9 only one turn is there, which three turns of the absent conversation 0 replace.
    lone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    df = spark.createDataFrame([(lone, 0, "user", "hello")], TURNS)
    none = hashlib.sha256(str(lone).encode()).hexdigest()
    assert found(trie.shared_head_trie(df)) == [(lone, 0, None, 1, 0, 1, 0, none)]
    assert found(trie.shared_head_trie(df.filter("conv_id is null"))) == []


@pytest.mark.parametrize("shape", ["chain", "star", "random", "broom"])
def test_components_are_split_at_centroids(shape):
    rng, n = random.Random(shape), 300
    parent = {
        "chain": lambda v: v - 1,
        "star": lambda v: 0,
        "random": lambda v: rng.randrange(v),
        "broom": lambda v: v - 1 if v < n // 2 else n // 2 - 1,
    }[shape]
    parents = [-1, *(parent(v) for v in range(1, n))]
    values = np.array([[1, rng.randrange(100)] for _ in range(n)])
    want = values.copy()
    for v in range(n - 1, 0, -1):
        want[parents[v]] += want[v]
    assert (trie.split_component(parents, want[:, 0].tolist(), values) == want).all()


def test_digest_of_many_ids_goes_over_several_rows(spark, monkeypatch):
    monkeypatch.setattr(trie, "IDS_PER_ROW", 10)
    ends = spark.range(-500, 700, numPartitions=5).select(
        F.when(F.col("id") % 3 == 0, F.lit(b"hot")).otherwise(F.col("id").cast("string").cast("binary")).alias("node"),
        F.col("id").alias("conv_id"),
    )
    got = {bytes(r.node): r.ends_sha256 for r in trie.id_digests(ends).collect()}
    assert got[b"hot"] == hashlib.sha256(",".join(str(i) for i in range(-500, 700) if i % 3 == 0).encode()).hexdigest()
    assert got[b"1"] == hashlib.sha256(b"1").hexdigest() and len(got) == 801
