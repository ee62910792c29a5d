"""Token counts against the library on whole texts."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from retenta.llm import text as T
from retenta.llm import token_counts
from retenta.llm import vocabulary as V
from tests.llm import cases

MODEL = T.tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def odd_texts() -> list[str]:
    rng = random.Random(17)
    signs = " \n\t\r.,▁aeЖ中é😀1 <>"
    texts = ["▁a▁▁b", "<s></s><unk> <0x0A>", " ", "   ", "\n\n x \r\n\t y", "中文字符没有空格" * 30, "ไทย " * 5, "\x00", "  x  y   z "]
    texts += ["a" * 70 + " " + "b" * 500, "same long word " + "z" * 200, "other words " + "z" * 200]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(400)]
    return texts + [cases.prose(rng, rng.randrange(300), rng.choice(list(cases.SYLLABLES))) for _ in range(60)]


def rows() -> list[tuple]:
    return cases.odd_rows() + [(100 + i, t, "en", "s", len(t)) for i, t in enumerate(odd_texts())]


@pytest.mark.parametrize("head", [token_counts.HEAD, 40, 0])
def test_counts_are_those_of_the_library(spark, library, head):
    docs = cases.with_clashes(cases.frame(spark, rows()))
    found = token_counts.count_tokens(docs, MODEL, limit=50, head=head).collect()
    want = [(i, len((t or "").encode()), len(library.encode(t or ""))) for i, t, *_ in rows()]
    want = sorted(((i, b, n, n > 50) for i, b, n in want), key=str)
    assert sorted((tuple(row) for row in found), key=str) == want


def test_empty_table_gives_no_rows(spark):
    empty = spark.createDataFrame([], cases.DOCS)
    assert token_counts.count_tokens(empty, MODEL).collect() == []


def test_pre_tokens_are_the_text_and_count_apart(library):
    joined = token_counts.joined_bytes(MODEL)
    count = token_counts._counter(MODEL)
    texts = [t.replace("▁", " ") for t in odd_texts()]
    data, offsets = T.buffers(pa.array(texts, pa.string()))
    strings, of = token_counts.pre_tokens(data, offsets, 0, len(texts), joined)
    assert any(b - a > 3 for a, b in zip(of, of[1:]))
    for i, text in enumerate(texts):
        own = strings[of[i] : of[i + 1]].to_pylist()
        assert b"".join(own).decode() == (" " + text if text else "")
        assert sum(count(own)) == len(library.encode(text))


def test_library_is_asked_once_per_distinct_pre_token(spark):
    texts = spark.createDataFrame([("the cat the cat",), ("cat the, the",), ("the",)], "text string").repartition(3)
    table = token_counts.pre_token_pieces(texts, MODEL, token_counts.joined_bytes(MODEL))
    assert sorted((r.token.decode(), r.n) for r in table.collect()) == [(" cat", 3), (" the", 5), (",", 1)]


def test_models_with_other_rules_are_refused(tmp_path):
    from sentencepiece.sentencepiece_model_pb2 import ModelProto

    rules = ModelProto()
    with open(MODEL, "rb") as file:
        rules.ParseFromString(file.read())
    rules.normalizer_spec.remove_extra_whitespaces = True
    path = tmp_path / "other.model"
    path.write_bytes(rules.SerializeToString())
    with pytest.raises(ValueError, match="rules"):
        token_counts.joined_bytes(str(path))


def test_head_has_at_most_its_number_of_rows(spark):
    counts = spark.createDataFrame([(n,) for n in (1, 1, 2, 2, 2, 5, 9, 9, 700)], "n bigint")
    for limit in range(12):
        least = V.least_bin(counts, limit)
        kept = counts.filter(V.frequency_bin(counts.n) >= least).count()
        assert kept <= limit and (limit < 9 or kept == 9)


def test_workers_read_the_table_of_their_own_job(spark):
    for n in (3, 5, 4):
        shared = V.shared_table(spark.range(n))

        def sizes(batches):
            yield from (pa.RecordBatch.from_pydict({"n": [len(V.read_shared(shared))]}) for _ in batches)

        assert {r.n for r in spark.range(8, numPartitions=4).mapInArrow(sizes, "n bigint").collect()} == {n}
        del shared


def test_long_strings_go_by_their_digest():
    strings = pa.array([b"short", b"x" * 64, b"x" * 65, b"y" * 65], pa.binary())
    keys = V.keys_of(strings).to_pylist()
    assert keys[:2] == [b"short", b"x" * 64] and keys[2] == V.digest(b"x" * 65) != keys[3]
    assert max(map(len, keys)) <= V.KEY_BYTES
    data = np.frombuffer(b"ab cde  f", np.uint8)
    assert V.cut(data, np.array([0, 3, 8]), np.array([2, 6, 9])).to_pylist() == [b"ab", b"cde", b"f"]
    assert V.cut(data, np.array([0, 3]), np.array([3, 9])).to_pylist() == [b"ab ", b"cde  f"]
