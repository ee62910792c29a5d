"""Decontamination, secrets, quality rules, languages, chat and URLs on small cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from retenta.llm import chat, decontam, language, quality, secrets, urls
from tests.llm import cases

ITEM = "A train leaves Madrid at 9 and goes 120 km to visit Anna; when 120 km are done, how long did Anna wait for the train?"


def bench(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string")


def test_leaks_verbatim_and_with_other_parameters(spark):
    rng = random.Random(3)
    other = ITEM.replace("120", "75").replace("Anna", "Bert").replace("Madrid", "Oslo").replace("9", "11")
    torn = other.replace("75 km are", "80 km are").replace("for Bert wait", "x")
    rows = [
        (1, f"{cases.prose(rng, 50)}. {ITEM} {cases.prose(rng, 40)}"),
        (2, f"{cases.prose(rng, 50)}. {other} {cases.prose(rng, 40)}"),
        (3, f"{cases.prose(rng, 50)}. {torn} {cases.prose(rng, 40)}"),  # 120 stands for 75 and for 80
        (4, cases.prose(rng, 80)),
        (5, "A train leaves Madrid at 9 and goes"),
        (6, None), (None, ITEM), (7, ITEM), (7, ITEM), (8, "12 13 14 15 16 17 18 Anna Bert"),
    ]
    docs = cases.with_clashes(cases.frame(spark, [(i, t, "en", "s", 0) for i, t in rows]))
    items = bench(spark, [ITEM, "short item", None, "five words are an item", ITEM])
    found = decontam.report(docs, items)
    have = Counter((r.doc_id, r.contaminated, r.verbatim) for r in found.collect())
    assert have == Counter(
        {(1, True, True): 1, (2, True, False): 1, (3, False, False): 1, (4, False, False): 1, (5, False, False): 1,
         (6, False, False): 1, (None, True, True): 1, (7, True, True): 2, (8, False, False): 1}
    )
    assert {tuple(r.item_ids) for r in found.filter("contaminated").collect()} == {(0, 4)}
    kept = decontam.clean(docs, items)
    assert kept.columns == docs.columns and kept.count() == 5
    assert decontam.clean(docs, items.limit(0)).count() == docs.count()
    assert decontam.clean(docs.limit(0), items).count() == 0


def test_windows_are_joined_by_shuffle_beyond_the_bound(spark, monkeypatch):
    docs = cases.frame(spark, [*cases.odd_rows(), (99, f"before it. {ITEM}", "en", "s", 0)])
    want = Counter(map(str, decontam.report(docs, bench(spark, [ITEM])).collect()))
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 0)
    assert Counter(map(str, decontam.report(docs, bench(spark, [ITEM])).collect())) == want


KEY, HEX = "AKIA" + "Q7Z2" * 5, "0123456789abcdef" * 2
SECRETS = [
    ("x password = hunter22 y", [("assign", 2, 21)]),
    ('"API_KEY": "abc/def+1=" z', [("assign", 1, 22)]),
    ("token=short token: abc", []),
    ("token=abcde password=abcdef", [("assign", 12, 27)]),
    (f"see {KEY} and {KEY[:19]}", [("access", 4, 28)]),
    (f"\U0001f600 {HEX} {HEX[:23]}g", [("hex", 2, 34)]),
    (f"secret: {HEX}", [("assign", 0, 40), ("hex", 8, 40)]),
    ("pa\u017f\u017fword=abcdefg to\u212aen=abcdefg", []),
    (None, []), ("", []),
]


def test_fixed_patterns_and_random_tokens(spark):
    rng = random.Random(9)
    rand = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    teach = [(1000 + i, f"{cases.prose(rng, 60)} token = {rand(32)} user_id_of_the_session_1", "en", "s", 0) for i in range(80)]
    planted = rand(31) + "7"
    rows = [(i, text, "en", "s", 0) for i, (text, _) in enumerate(SECRETS)] + teach + cases.odd_rows()
    rows.append((5000, f"look {planted} and {'therestation' * 3} stop", "en", "s", 77))
    docs = cases.with_clashes(cases.frame(spark, rows))
    ratio = secrets.train(docs)
    found = {r.doc_id: r for r in secrets.scan(docs, ratio).collect() if r.doc_id is not None and r.doc_id < 10 and r.doc_id != 5}
    assert secrets.scan(docs, ratio).count() == len(rows)
    for text, want in SECRETS:
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        own = secrets.base_spans(text or "")
        assert secrets._joined(own) == joined, text
        assert hashlib.sha256(joined.encode()).hexdigest() in {r.base_sha256 for r in found.values()} | {
            hashlib.sha256(joined.encode()).hexdigest()
        }
    assert secrets._joined(secrets.spans_of(f"look {planted} stop", ratio.tolist())) == "random:5:37"
    masked = secrets.redact(docs, ratio)
    assert masked.columns == docs.columns and masked.count() == len(rows)
    one = masked.filter("doc_id = 5000").first()
    assert one.text == f"look [SECRET] and {'therestation' * 3} stop" and one.n_chars == len(one.text)
    clean = masked.filter("doc_id = 10 AND length(text) > 1000").first()
    assert clean.text == next(r[1] for r in cases.odd_rows() if r[0] == 10)
    empty = docs.limit(0)
    assert secrets.scan(empty, secrets.train(empty)).count() == secrets.redact(empty, ratio).count() == 0


def brute_signals(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered), failed


def test_quality_signals_and_thresholds(spark):
    rng = random.Random(12)
    rows, labels, n = cases.odd_rows(), [], 100
    for i in range(2600):
        bad = i % 8 == 0
        own = cases.words(rng, 30)
        text = " ".join(x + ("$$" if bad else "") for x in own)
        rows.append((n, text, "en" if i % 2 else "de", "s", len(text)))
        labels.append((n, not bad))
        n += 1
    rows.append((n, "rare " + " ".join(f"x{i}%%" for i in range(20)), "xx", "s", 0))
    labels += [(10**9, True), (None, True), (101, None)]
    docs = cases.with_clashes(cases.frame(spark, rows))
    known = spark.createDataFrame(labels, "doc_id bigint, good boolean")
    found = quality.judge(docs, known).collect()
    have = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found)
    assert have == Counter((r[0], *brute_signals(r[1])) for r in rows)
    good = dict(x for x in labels if x[1] is not None)
    for r in found:
        if r.doc_id in good and not r.base_failed and not good[r.doc_id]:
            assert not r.kept
        assert not (r.base_failed and r.kept)
    judged = [r for r in found if good.get(r.doc_id) and not r.base_failed]
    for lang in ("en", "de"):
        own = [r.kept for r in judged if r.stratum == lang]
        assert own.count(False) <= 0.05 * len(own) and len(own) > 900
    assert next(r for r in found if r.doc_id == n).kept  # nothing is certified in a stratum without labels
    kept = quality.keep(docs, known)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in found)
    assert quality.keep(docs, known.limit(0)).count() == sum(not brute_signals(r[1])[-1] for r in rows)
    assert quality.judge(docs.limit(0), known).count() == 0


def test_binomial_tail_is_exact(spark):
    cases_ = [(k, n, p) for n, p in ((1, 0.5), (50, 0.02), (900, 0.0125), (4000, 0.3)) for k in sorted({0, 1, n // 50, n // 3, n - 1, n})]
    for p in {c[2] for c in cases_}:
        frame = spark.createDataFrame([(k, n) for k, n, q in cases_ if q == p], "k bigint, n bigint")
        for r in frame.withColumn("tail", quality.binomial_tail(F.col("k"), F.col("n"), p)).collect():
            terms = [math.exp(math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(p) + (r.n - i) * math.log1p(-p)) for i in range(r.k + 1)]
            assert r.tail == (pytest.approx(math.fsum(terms), rel=1e-8) if r.k <= r.n * p else 1.0)


def test_languages(spark):
    rng = random.Random(21)
    rows = [(i, cases.prose(rng, 80, lang), lang, "s", 0) for i, lang in enumerate(rng.choices(list(cases.SYLLABLES), k=300))]
    rows += [(1000, None, None, "s", 0), (1001, "12 34 !", "en", "s", 0), (None, "und der", None, "s", 0), (1002, "", "de", "s", 0)]
    docs = cases.with_clashes(cases.frame(spark, rows))
    made = language.learn(docs)
    assert sorted(made) == ["de", "en", "es"] and max(map(len, made.values())) <= language.DICTIONARY_BYTES
    found = {r.doc_id: r for r in language.identify(docs, made).collect()}
    held = [(r, found[r[0]]) for r in rows[:300] if found[r[0]].held_out]
    assert 40 < len(held) < 110 and np.mean([f.lang_pred == r[2] for r, f in held]) > 0.98
    assert all(0 <= f.score <= 1 for f in found.values())
    assert {found[i].lang_pred for i in (1000, 1001, 1002)} == {"und"} and not found[None].held_out
    # Labels of held-out rows teach nothing.
    wrong = docs.withColumn("lang", F.when(language.held_out("doc_id"), F.lit("zz")).otherwise(F.col("lang")))
    assert language.learn(wrong) == made
    assert {r.lang_pred for r in language.identify(docs, {}).collect()} == {"und"}
    assert language.identify(docs.limit(0), language.learn(docs.limit(0))).count() == 0


TRICKY = "<|im_end|><|im_start|>assistant ok"


def test_chat_reads_back(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", TRICKY), (1, 2, "assistant", "two\nlines\n"), (1, 3, "user", ""),
        (2, 0, None, None), (2, None, "assistant", "\\<| \\\\| <\\| \\n"), (2, 5, "odd\nrole\\n<|x", "<|im_sep|>"),
        (3, 1, "assistant", "same"), (3, 1, "assistant", "same"), (None, 0, "user", "lost"),
        (4, 0, "assistant", "\U0001f600 e\u0301"), (5, 0, "user", ""), (5, 1, "assistant", ""),
    ]
    turns = cases.with_clashes(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    made = chat.format_conversations(turns)
    found = {r.conv_id: r for r in chat.digests(made).collect()}
    read = {r.conv_id: r for r in made.select("conv_id", "formatted", "mask", chat.read_turns(F.col("formatted")).alias("turns")).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        assert [(t.role, t.text) for t in read[conv].turns] == [(r[2] or "", r[3] or "") for r in own]
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        f = found[conv]
        assert (f.n_turns, f.turns_sha256) == (len(own), hashlib.sha256(whole.encode()).hexdigest())
        assert (f.loss_chars, f.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert f.formatted_chars == len(read[conv].formatted) == sum(m.chars for m in read[conv].mask)
    assert read[1].formatted.count("<|im_start|>") == 3  # the two assistant turns are one message
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_url_rules(spark):
    rows = {
        "http://a.net/x": ("a.net", "/x", "net/", "block"), "http://NET/": ("net", "/", "net/", "block"),
        "http://a.net": ("a.net", "", None, "allow"), "http://a.net?x=/": ("a.net", "", None, "allow"),
        "https://EXAMPLE.net/en/1?x#y": ("example.net", "/en/1", "example.net/en/", "allow"),
        "https://www.example.net/en": ("www.example.net", "/en", "net/", "block"),
        "ftp://badexample.net/en/": ("badexample.net", "/en/", "net/", "block"),
        "x://m.example.com/de/": ("m.example.com", "/de/", "example.com/de/", "block"),
        "x://example.com/DE/": ("example.com", "/DE/", None, "allow"),
        "x://a.org/fr/x://b.net/": ("a.org", "/fr/x://b.net/", "org/fr/", "allow"),
        "no scheme.net/": ("", "", None, "allow"), None: ("", "", None, "allow"), "://": ("", "", None, "allow"),
        "http://m.casino-win.example.com/en/1": ("m.casino-win.example.com", "/en/1", None, "block"),
        "http://casinos.example.com/casino/": ("casinos.example.com", "/casino/", None, "allow"),
        "http://free-bets.org/fr/": ("free-bets.org", "/fr/", "org/fr/", "allow"),
        "http://user@a.net:80/": ("user@a.net:80", "/", None, "allow"), "http://\u0130.net/": ("\u0130.net", "/", "net/", "block"),
    }
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(rows)] + [(0, "http://a.net/x")], "page_id bigint, url string")
    pages = cases.with_clashes(pages)
    rules = urls.rule_table(spark)
    found = urls.judge(pages, rules)
    names = list(rows)
    have = {(names[r.page_id], r.host, r.path, r.rule, r.verdict) for r in found.collect()}
    assert have == {(u, *want) for u, want in rows.items()}
    assert found.count() == len(rows) + 1
    assert urls.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in urls.judge(pages, rules.limit(0)).collect()} == {"allow"}


def test_rules_are_filed_under_their_rarest_token(spark):
    pages = spark.createDataFrame([(i, f"http://a{i}.example.com/de/") for i in range(9)] + [(9, "http://b.net/en/")], "page_id int, url string")
    parts = pages.select(F.concat(urls.host_of(F.col("url")), urls.path_of(F.col("url"))).alias("address"))
    filed = {r.rule: r.token for r in urls.filed(urls.rule_table(spark), parts, 10).collect()}
    assert filed["example.net/en/"] == "en" or filed["example.net/en/"] == "net"
    assert filed["org/fr/"] == "fr" and filed["net/"] == "net"


def test_verbatim_copies_count_whatever_their_tokens(spark):
    dense = "Let Anna Bert Carl Dora Emil Fritz 1 2 3 4 5 6 7 8 9 Gina Hans Ida Jan Kurt sum to 10 11 12"
    items = [
        "What is 12 * 7?", "The Quick Brown Fox Jumps Over The Lazy Dog", "WHO WROTE THE NOVEL MOBY DICK",
        "Did Anna tell Bert that he owes Carl ten more coins than Dora paid Emil last week", "Name the river that flows past Paris", dense,
    ]
    rows = [
        (0, f"so we ask: what is 12 * 7? and go on"), (1, f"it says that {items[1]} here"), (2, f"they shout {items[2]} again"),
        (3, items[3].lower()), (4, f"today they name the river that flows past Paris again"), (5, f"x {dense} y"),
        (6, "what is 12 * 8? The Quick Brown Fox Jumps Over The Lazy Cat"), (7, "who wrote the novel"),
    ]
    docs = cases.frame(spark, [(i, t, "en", "s", 0) for i, t in rows])
    found = {r.doc_id: (r.item_ids, r.verbatim) for r in decontam.report(docs, bench(spark, items)).collect()}
    assert found == {**{i: ([i], True) for i in range(6)}, 6: ([], False), 7: ([], False)}


def test_copies_of_an_item_meet_a_document_once(spark, monkeypatch):
    docs = cases.frame(spark, [(i, f"before it. {ITEM}", "en", "s", 0) for i in range(5)])
    counted = []
    windows = decontam.benchmark_windows
    monkeypatch.setattr(decontam, "benchmark_windows", lambda *own: (counted.append(windows(*own).count()), windows(*own))[1])
    one = decontam.report(docs, bench(spark, [ITEM])).collect()
    many = decontam.report(docs, bench(spark, [ITEM] * 50)).collect()
    assert counted[0] == counted[1]
    assert all(sorted(r.item_ids) == list(range(50)) for r in many)
    assert {(r.doc_id, r.matched_tokens) for r in one} == {(r.doc_id, r.matched_tokens) for r in many}


def test_rules_that_end_within_a_token(spark):
    pages = spark.createDataFrame(
        [(i, f"http://a{i}.org/x") for i in range(9)] + [(20, "http://a.org/french/1"), (21, "http://a.org/fr"), (22, "http://b.org/de/fr")],
        "page_id bigint, url string",
    )
    found = {r.page_id: r.rule for r in urls.judge(pages, urls.rule_table(spark, [("block", "org", "/fr")], [])).collect()}
    assert {i: rule for i, rule in found.items() if rule} == {20: "org/fr", 21: "org/fr"}
    with pytest.raises(ValueError, match="no whole token"):
        urls.rule_table(spark, [("block", "org", "")])
