"""Near duplicates and repeated passages against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from retenta.llm import graph, neardup, substring
from tests.llm import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def near_rows() -> list[tuple]:
    rng = random.Random(7)
    rows, n = cases.odd_rows(), 100
    for copies, edits in ((1, 0), (3, 0), (30, 1), (25, 4), (6, 12)):
        base = cases.words(rng, 120)
        for _ in range(copies):
            own = list(base)
            for _ in range(edits):
                own[rng.randrange(len(own))] = "".join(cases.words(rng, 2))
            rows.append((n, " ".join(own), "en", "s", 0))
            n += 1
    shared = cases.words(rng, 80)
    for _ in range(12):  # half of the words in common is not enough
        rows.append((n, " ".join(shared + cases.words(rng, 60)), "en", "s", 0))
        n += 1
    return rows


def shingle_set(text: str | None) -> frozenset:
    w = WORD.findall(text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_groups(rows: list[tuple]) -> list[set[int]]:
    sets, root = [shingle_set(r[1]) for r in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    found = defaultdict(set)
    for i in range(len(rows)):
        found[find(i)].add(i)
    return list(found.values())


def test_groups_are_those_of_brute_force(spark):
    rows = near_rows()
    have = Counter((r.doc_id, r.group_id, r.group_size) for r in neardup.groups(cases.with_clashes(cases.frame(spark, rows))).collect())
    want = Counter()
    for group in brute_groups(rows):
        ids = [rows[i][0] for i in group]
        least = min(ids, key=lambda i: (i is None, i or 0))
        want.update((i, least, len(ids)) for i in ids)
    assert have == want


def test_one_of_each_group_stays_with_its_columns(spark):
    rows = near_rows()
    docs = cases.with_clashes(cases.frame(spark, rows))
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert len({r.doc_id for r in kept.collect()} - {None}) <= kept.count() == len(brute_groups(rows))
    assert all(r.node == "own node" for r in kept.collect())
    assert neardup.keep_one(docs.limit(0)).count() == neardup.groups(docs.limit(0)).count() == 0


def test_buckets_of_many_components_go_on(spark):
    """Members that fail with the first representatives are compared with further ones until none is left."""
    members = [(1, bytes([i]) * 16, bytes([i]) * 16, 9, 9) for i in range(1, 40)]
    frame = spark.createDataFrame(members, "key bigint, node binary, comp binary, size bigint, common bigint")
    met, n = set(), 1
    while not frame.isEmpty():
        pairs, frame = neardup._compared(frame, n)
        met |= {(bytes(p.a), bytes(p.b)) for p in pairs.collect()}
        n *= 4
    assert len(met) == 39 * 38 // 2


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(2)
    grams = rng.integers(0, 2**63, 90, dtype=np.uint64)
    weights = rng.integers(1, 6, (2, 90)).astype(float)
    weights[0, :20], weights[1, -15:] = 0, 0
    own = [np.flatnonzero(w) for w in weights]
    # 1 over the sum of the greatest ratios, by definition.
    both = [d for d in range(90) if weights[0, d] and weights[1, d]]
    true = sum(1 / np.maximum(weights[0] / weights[0, d], weights[1] / weights[1, d]).sum() for d in both)
    flat = np.concatenate([grams[i] for i in own])
    row, weight = np.repeat([0, 1], [len(i) for i in own]), np.concatenate([weights[k, i] for k, i in enumerate(own)])
    signed = neardup.signatures(flat, row, weight, 3, 4000)
    assert abs((signed[0] == signed[1]).mean() - true) < 4 * (true * (1 - true) / 4000) ** 0.5
    assert not signed[2].any()
    # Early termination changes no register: a text alone has the same signature.
    alone = neardup.signatures(grams[own[1]], np.zeros(len(own[1]), int), weights[1, own[1]], 1, 4000)
    assert (alone[0] == signed[1]).all()


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    names = [bytes([rng.randrange(256) for _ in range(16)]) for _ in range(300)]
    edges = [(names[i], names[i + 1]) for i in range(0, 120)] + [(names[150], names[k]) for k in range(151, 250)]
    edges += [(names[260], names[260]), (names[270], names[271]), (names[271], names[270])]
    found = {bytes(r.node): bytes(r.comp) for r in graph.components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    for own in (names[:121], names[150:250], names[270:272]):
        assert {found[n] for n in own} == {min(own)}
    assert len(found) == 121 + 100 + 2


def passage_rows() -> list[tuple]:
    rng = random.Random(11)
    rows, passages = cases.odd_rows(), [cases.words(rng, n) for n in (34, 35, 36, 60, 200)]
    for n in range(100, 160):
        own = cases.words(rng, rng.randrange(5, 150))
        for p in rng.sample(passages, rng.randrange(3)):
            at = rng.randrange(len(own) + 1)
            own[at:at] = p if rng.random() < 0.7 else p[rng.randrange(10) : len(p) - rng.randrange(10)]
        rows.append((n, "  ".join(own) + "\n", "en", "s", 0))
    twice = cases.words(rng, 50)
    rows += [(200, " ".join(twice + twice), "en", "s", 0), (201, " ".join(["a", "b"] * 60), "en", "s", 0), (202, " ".join(["z"] * 36), "en", "s", 0)]
    return rows + [(300, rows[-1][1], "en", "s", 0), (300, rows[-1][1], "en", "s", 0), (301, rows[40][1], "en", "s", 0)]


def brute_passages(rows: list[tuple], size: int = 35) -> Counter:
    docs = [WORD.findall(r[1] or "") for r in rows]
    seen = Counter(tuple(w[i : i + size]) for w in docs for i in range(len(w) - size + 1))
    out = Counter()
    for r, w in zip(rows, docs):
        gone = {i + k for i in range(len(w) - size + 1) if seen[tuple(w[i : i + size])] > 1 for k in range(size)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("rounds", [0, 2, 4, 7])
def test_repeats_are_those_of_brute_force(spark, rounds):
    rows = passage_rows()
    docs = cases.with_clashes(cases.frame(spark, rows))
    out = substring.digests(substring.cleaned(docs, rounds=rounds))
    assert Counter(tuple(r) for r in out.collect()) == brute_passages(rows)
    assert substring.cleaned(docs.limit(0)).count() == 0


def test_core_symbols_do_not_depend_on_what_surrounds_a_window():
    rng = np.random.default_rng(4)
    window = rng.integers(0, 6, 35).astype(np.uint64)
    seen = set()
    for _ in range(200):
        left, right = rng.integers(0, 6, rng.integers(0, 30)), rng.integers(0, 6, rng.integers(0, 30))
        text = np.concatenate([left.astype(np.uint64), window, right.astype(np.uint64)])
        s = substring.parse(text, np.array([0, len(text)]), 4)
        inside = (s.low >= len(left)) & (s.high <= len(left) + 35)
        seen.add(tuple((int(n), int(a) - len(left)) for n, a in zip(s.name[inside], s.start[inside])))
    assert len(seen) == 1


def template_rows(members: int = 40) -> list[tuple]:
    """Two families of one template: similar within, about 0.7 across, no shingle in few texts but a text's own."""
    rng = random.Random(31)
    base = cases.words(rng, 200)
    rows = []
    for family in range(2):
        own = list(base)
        if family:
            for at in range(10, 200, 29):
                own[at] = "".join(cases.words(rng, 3))
        for n in range(members):
            text = list(own)
            text[197] = f"x{family}n{n}"
            rows.append((1000 * family + n, " ".join(text), "en", "s", 0))
    return rows


def test_families_of_one_template_are_not_compared_text_by_text(spark, monkeypatch):
    rows = template_rows()
    across = [len(a & b) / len(a | b) for a, b in [(shingle_set(rows[0][1]), shingle_set(rows[-1][1]))]][0]
    assert 0.6 < across < 0.8
    seen = []
    verified = neardup._verified
    monkeypatch.setattr(neardup, "_verified", lambda pairs, texts: (seen.append(pairs.count()), verified(pairs, texts))[1])
    # One band of one row, so that both families meet.
    _, _, comps = neardup.link(cases.frame(spark, rows), bands=8, band_rows=1)
    assert comps.select("comp").distinct().count() == 2 and comps.count() == len(rows)
    assert sum(seen) < 10 * len(rows) < 40 * 40


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_prefixes_find_every_similar_pair(spark, seed):
    rng = random.Random(seed)
    rows, n = [], 0
    for _ in range(12):
        base = cases.words(rng, rng.randrange(5, 90))
        for _ in range(8):
            own = list(base)
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(own))
                own[at : at + rng.randrange(2)] = cases.words(rng, rng.randrange(3))
            rows.append((n, " ".join(own)))
            n += 1
    sets = [shingle_set(r[1]) for r in rows]
    pairs = {(j, i) for i in range(n) for j in range(i) if sets[i] != sets[j]}
    want = {p for p in pairs if len(sets[p[0]] & sets[p[1]]) >= 0.8 * len(sets[p[0]] | sets[p[1]])}
    texts = spark.createDataFrame([(i.to_bytes(16), i.to_bytes(16), t) for i, t in rows], "node binary, comp binary, text string")
    keyed = neardup._mixed(neardup._prefixes(texts.repartition(3)))
    found = {tuple(sorted((int.from_bytes(p.a), int.from_bytes(p.b)))) for p in neardup._across(keyed).collect()}
    assert len(want) > 30 and want <= found and len(found) < len(pairs) / 4


def test_sketches_leave_out_pairs_that_have_too_much_apart(spark, monkeypatch):
    """Texts with three changes each to one base share nearly all they have, yet no two are similar."""
    rng = random.Random(17)
    base, rows = cases.words(rng, 150), []
    for n in range(70):
        text = list(base)
        for at in rng.sample(range(5, 145, 5), 3):
            text[at] = "".join(cases.words(rng, 3))
        rows.append((n, " ".join(text), "en", "s", 0))
    sets = [shingle_set(r[1]) for r in rows]
    links = [(i, j) for i, j in itertools.combinations(range(70), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert 0 < len(links) < 100
    seen = []
    verified = neardup._verified
    monkeypatch.setattr(neardup, "_verified", lambda pairs, texts: (seen.append(pairs.count()), verified(pairs, texts))[1])
    # One band of one row, so that nearly all of them meet.
    _, _, comps = neardup.link(cases.frame(spark, rows), bands=8, band_rows=1)
    assert comps.groupBy("comp").count().agg(F.max("count")).first()[0] == max(map(len, brute_groups(rows)))
    assert sum(seen) < 10 * len(rows) < 70 * 69 // 2


@pytest.mark.parametrize("seed", [1, 2])
def test_sketches_lose_no_similar_pair(spark, seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(10):
        base = cases.words(rng, rng.choice([3, 30, 90, 3000]))
        for _ in range(8):
            own = list(base)
            for _ in range(rng.randrange(5)):
                own[rng.randrange(len(own))] = cases.words(rng, 1)[0]
            texts.append(" ".join(own))
    sets = [shingle_set(t) for t in texts]
    want = {(j, i) for i in range(len(sets)) for j in range(i) if sets[i] != sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    # Components of several texts each, too: no pair within one is asked for.
    rows = [(i.to_bytes(16), (i if seed == 1 else i // 2).to_bytes(16), t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "node binary, comp binary, text string").repartition(3)
    keyed = neardup._mixed(neardup._prefixes(frame))
    found = {tuple(sorted((int.from_bytes(p.a), int.from_bytes(p.b)))) for p in neardup._across(keyed, neardup._sketches(frame)).collect()}
    across = {p for p in want if seed == 1 or p[0] // 2 != p[1] // 2}
    assert len(across) > 30 and across <= found
    assert found <= {tuple(sorted((int.from_bytes(p.a), int.from_bytes(p.b)))) for p in neardup._across(keyed).collect()}


def test_near_copies_with_a_repeated_passage_are_candidates(spark):
    rng = random.Random(41)
    rows = []
    for n in range(20):
        base = cases.words(rng, 114)
        rows += [(2 * n, " ".join(base), "en", "s", 0), (2 * n + 1, " ".join(base + base[100:] * 40), "en", "s", 0)]
        a, b = shingle_set(rows[-2][1]), shingle_set(rows[-1][1])
        assert len(a & b) >= 0.8 * len(a | b)
    found = {r.doc_id: (r.group_id, r.group_size) for r in neardup.groups(cases.frame(spark, rows)).collect()}
    assert found == {i: (i - i % 2, 2) for i in range(40)}


def test_repeated_rows_bring_their_spans_once(spark):
    keys = spark.range(40).selectExpr("id AS doc", "CAST(IF(id < 30, NULL, id) AS BIGINT) AS id", "IF(id < 30, 7L, id) AS digest")
    spans = keys.select("doc", F.lit(3).alias("at"), F.lit(35).alias("n"))
    found = substring._once(spans, keys).groupBy("id", "digest").count().collect()
    assert len(found) == 11 and {r["count"] for r in found} == {1}
    text = " ".join(cases.words(random.Random(3), 80))
    rows = [(None, text, "en", "s", 0)] * 30 + [(1, text, "en", "s", 0)]
    spans = substring.repeats(cases.frame(spark, rows)).collect()
    assert len(spans) == 2 and all(len(r.spans) == len(set(r.spans)) for r in spans)
