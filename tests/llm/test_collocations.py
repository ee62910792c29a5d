"""Collocations against brute force, and the sort by itself."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from retenta.llm import collocations as C
from tests.llm import cases


def phrases(rows, least, top):
    counts: dict[str, list[Counter]] = {}
    for _, text, lang, *_ in rows:
        one = counts.setdefault(lang or "und", [Counter(), Counter(), Counter()])
        lower = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(3):
                one[k].update(zip(*(words[j:] for j in range(k + 1))))
    out = []
    for lang, f in counts.items():
        found, n = [], sum(f[0].values())
        frequent = [t for t in f[2] if f[2][t] >= least]
        for size in (2, 3):
            for phrase, a in f[size - 1].items():
                if a < least:
                    continue
                if size == 3 or not any(2 * f[2][t] >= a and phrase in (t[:2], t[1:]) for t in frequent):
                    cuts = [(f[k - 1][phrase[:k]], f[size - k - 1][phrase[k:]]) for k in range(1, size)]
                    score, _, l, r = min((1_000_000 * a * a // (l * r), k, l, r) for k, (l, r) in enumerate(cuts))
                    found.append((-score, -a, " ".join(phrase).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(out)


def rows() -> list[tuple]:
    rng = random.Random(23)
    texts = []
    for i in range(150):
        words = [rng.choice("the of A b c D e f g h New York City".split()) for _ in range(rng.randrange(60))]
        for at in range(rng.randrange(6)):
            words.insert(rng.randrange(len(words) + 1), rng.choice(["San Diego Zoo", "hot pair", "Été été", "y" * 80 + " z"]))
        texts.append((100 + i, "".join(w + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ", ", " "]) for w in words), rng.choice(["en", "de", None, "und"]), "s", 1))
    texts += [(400 + i, f"hot pair number {i}", "en", "s", 1) for i in range(300)]
    texts += [(800 + i, "all the same words here", "en", "s", 1) for i in range(100)]
    return cases.odd_rows() + texts


@pytest.mark.parametrize("head_bytes", [C.HEAD_BYTES, 200, 0])
def test_phrases_are_those_of_brute_force(spark, head_bytes, monkeypatch):
    monkeypatch.setattr(C, "ROWS_PER_BLOCK", 500)
    docs = cases.with_clashes(cases.frame(spark, rows()))
    found = C.collocations(docs, least=4, top=40, head_bytes=head_bytes)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in found.collect()) == phrases(rows(), 4, 40)


def test_empty_table_gives_no_phrases(spark):
    assert C.collocations(spark.createDataFrame([], cases.DOCS)).collect() == []


def test_scores_beyond_64_bits(spark):
    big = 9 * 10**14
    row = spark.createDataFrame([(big, big + 1, big + 2)], "a bigint, l bigint, r bigint")
    assert row.select(C._score("a", "l", "r")).first()[0] == 1_000_000 * big * big // ((big + 1) * (big + 2))


@pytest.mark.parametrize("seed", range(5))
def test_partitions_of_equal_keys(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 4000))
    keys, weight = rng.zipf(1.3, (3, n)).clip(max=50) - 1, rng.integers(1, 4, n)
    keys[2][rng.random(n) < 0.1] = C.NONE
    found = C.multikey_partitions(keys, weight, [5, 5, 5, 5], {2: 5, 3: 5})
    got = {(*keys[:d, i].tolist(),): int(t) for d, at, total in found for i, t in zip(at, total)}
    want = Counter()
    for k in range(n):
        for d in (2, 3):
            want[(*keys[:d, k].tolist(),)] += int(weight[k])
    assert got == {phrase: t for phrase, t in want.items() if t >= 5}


def test_small_partitions_are_abandoned(monkeypatch):
    looked_at = []
    keep = np.repeat
    monkeypatch.setattr(C.np, "repeat", lambda a, n, **k: looked_at.append(np.sum(n)) or keep(a, n, **k))
    keys = np.stack([np.arange(1000)] * 3)
    found = C.multikey_partitions(keys, np.ones(1000, np.int64), [10] * 4, {2: 10, 3: 10})
    assert not any(len(rows) for _, rows, _ in found)
    # A thousand distinct words: halves go on until they are smaller than ten.
    assert len(looked_at) < 60


def test_map_has_the_bit_of_each_word(spark):
    words = spark.createDataFrame([(w.encode(),) for w in ("a", "bc", "d" * 100)], "word binary")
    bits = np.frombuffer(C.bit_map(words, 1 << 12), np.uint64)
    on = {64 * int(s) + b for s in np.flatnonzero(bits) for b in range(64) if int(bits[s]) >> b & 1}
    assert on == {C.word_hash(w) % (1 << 12) for w in (b"a", b"bc", b"d" * 100)}


def test_equal_suffixes_are_counted_before_they_are_routed(spark):
    texts = spark.createDataFrame([("en", "x y z. " * 1000)], "lang string, text string")
    words = C.word_counts(texts).cache()
    assert {(bytes(r.word), r.n) for r in words.collect()} == {(b"x", 1000), (b"y", 1000), (b"z", 1000)}
    found = C.phrase_counts(texts, words, 10).select("n", *[F.col(c).cast("string") for c in ("w1", "w2", "w3")]).collect()
    assert {tuple(r) for r in found} == {(1000, "x", "y", None), (1000, "y", "z", None), (1000, "x", "y", "z")}
