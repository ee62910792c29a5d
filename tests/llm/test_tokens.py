"""Token ids: the remembered words, packing and files against the library and exact round trips."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from retenta.llm import packing, token_files, tokens
from retenta.llm import text as T
from tests.llm import cases

PATH = T.tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    own = Tokenizer.from_file(PATH)
    return lambda text: own.encode(text or "", add_special_tokens=False).ids


def odd_texts() -> list[str | None]:
    rng = random.Random(1)
    alphabet = "aB'., \n\té\u0301Σ1<|-_»漢\u00a0ß"
    texts = [row[1] for row in cases.odd_rows() if len(row[1] or "") < 10_000]
    texts += ["I'LL we'VE 's'S", "ΑΣ Σ.ς", "<|endoftext|> x", "a\u0338 <\u0338", "x\x00y", "ﬁ ½ 3rd 1,234.5"]
    return texts + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(2000)]


@pytest.mark.parametrize("remembered", [1_000_000, 50])
def test_remembered_words_give_the_ids_of_the_library(library, remembered, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", remembered)
    texts = odd_texts()
    data, offsets = T.buffers(pa.array(texts, pa.string()))
    encoder = tokens.Encoder(PATH)
    assert encoder.by_word
    at = 0
    for first, last in T.row_chunks(offsets, 500):
        ids, counts = encoder.encode(data, offsets, first, last)
        for n, own in zip(counts, np.split(ids, np.cumsum(counts)[:-1])):
            assert own.tolist() == library(texts[at]) and len(own) == n
            at += 1
    assert at == len(texts)


def test_other_tokenizers_are_asked_text_by_text(library):
    path = T.tokenizer_path("byte_bpe_50k.json")
    encoder, texts = tokens.Encoder(path), odd_texts()[:300]
    assert not encoder.by_word
    data, offsets = T.buffers(pa.array(texts, pa.string()))
    ids, counts = encoder.encode(data, offsets, 0, len(texts))
    own = Tokenizer.from_file(path)
    assert ids.tolist() == [i for t in texts for i in own.encode(t or "", add_special_tokens=False).ids]
    assert counts.sum() == len(ids)


def test_best_fit_takes_the_tightest_window():
    lengths = np.array([6, 5, 4, 3, 2, 10, 1])
    window, offset = packing.best_fit_decreasing(lengths, 10)
    filled = np.bincount(window, lengths)
    assert sorted(filled) == [1, 10, 10, 10] or sorted(filled) == [10, 10, 11] or filled.max() <= 10
    assert len(filled) == 4 and filled.sum() == lengths.sum()
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 65, 500)
    window, offset = packing.best_fit_decreasing(lengths, 64)
    open_now: list[int] = []  # the same by trying every window
    for i in np.argsort(-lengths, kind="stable"):
        fits = [c for c in open_now if c >= lengths[i]]
        if fits:
            open_now.remove(min(fits))
            open_now.append(min(fits) - lengths[i])
        else:
            open_now.append(64 - lengths[i])
        assert offset[i] == 64 - (min(fits) if fits else 64)
    assert sorted(open_now) == sorted(64 - np.bincount(window, lengths).astype(int))


def test_pieces_hold_each_id_once(spark, library):
    rows = cases.odd_rows()
    docs = cases.with_clashes(cases.frame(spark, rows))
    pieces = packing.pack(docs, PATH, end_id=1, size=256)
    found = pieces.collect()
    want = sorted(tuple(library(row[1]) + [1]) for row in rows)
    have: list[tuple] = []
    by_doc: dict = {}
    for p in found:
        assert len(p.ids) == p.length and zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32
        by_doc.setdefault(p.doc_id, []).append(p)
    for own in by_doc.values():
        # Rows of one id can't be told apart; each start occurs once per row.
        starts = sorted((p.start, p.length) for p in own)
        assert sum(n for _, n in starts) == sum(len(library(r[1])) + 1 for r in rows if r[0] == own[0].doc_id)
        if len({p.start for p in own}) == len(own):
            have.append(tuple(i for p in sorted(own, key=lambda p: p.start) for i in p.ids))
    assert set(have) <= set(want)
    sequences = {}
    for p in sorted(found, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == sequences.get(p.sequence_id, 0)
        sequences[p.sequence_id] = p.offset + p.length
    assert max(sequences.values()) == 256
    whole = packing.sequences(pieces, 256).collect()
    for s in whole:
        assert s.length == sequences[s.sequence_id]
        assert len(s.ids) == (s.length if s.length & (s.length - 1) == 0 else 256)
    assert packing.pack(docs.limit(0), PATH, end_id=1).count() == 0


def test_files_read_back_in_order(spark, library, tmp_path):
    rows = cases.odd_rows()
    path = str(tmp_path / "tokens")
    token_files.write_token_files(cases.with_clashes(cases.frame(spark, rows)), path, PATH, end_id=2)
    back = token_files.read_token_files(spark, path).orderBy("start").collect()
    ids = [r.doc_id for r in back]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    at = 0
    for r in back:
        assert (r.start, r.n_tokens, r.ids[-1]) == (at, len(r.ids), 2)
        at += r.n_tokens
    assert sorted(map(tuple, (r.ids for r in back))) == sorted(tuple(library(row[1]) + [2]) for row in rows)
    one = token_files.read_token_files(spark, path, F.col("doc_id") == 10).collect()
    assert one == [r for r in back if r.doc_id == 10]
    crc = {(r.doc_id, r.start): r.ids_crc32 for r in token_files.with_crc32(token_files.read_token_files(spark, path)).collect()}
    assert crc == {(r.doc_id, r.start): zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in back}
    empty = str(tmp_path / "empty")
    token_files.write_token_files(cases.frame(spark, []), empty, PATH, end_id=2)
    assert token_files.read_token_files(spark, empty).count() == 0


def test_files_have_bloom_filters_and_indexes(spark, tmp_path):
    path = str(tmp_path / "tokens")
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a few words").alias("text"))
    token_files.write_token_files(docs, path, PATH, end_id=2)
    plan = token_files.read_token_files(spark, path, F.col("doc_id") == 5)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,5)" in plan
    from pyarrow import orc

    files = sorted((tmp_path / "tokens").glob("*.orc"))
    least = [orc.ORCFile(f).read(["doc_id"]).column(0).to_pylist() for f in files]
    assert [i for part in least for i in part] == list(range(3000))
