"""Texts that hold the tokenizer's added tokens, against the library as its file sets it up."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from retenta.llm import packing, token_files, tokens
from retenta.llm import text as T
from tests.llm import cases

PATH = T.tokenizer_path("word_bpe_49k.json")
END, START = "<|endoftext|>", "<|startoftext|>"


def special_texts() -> list[str | None]:
    rng = random.Random(8)
    parts = [END, START, "a", " ", "", "\n", "<|", "|>", "<|endof", "text|>", "́", "é", "B's", "12.", END.upper(), "word,", "漢"]
    texts = [f"a {END} x", END, f"{END}{END}", f"x{START}́y", "<|endof", "text|> cut", None, "", f"{END[:5]}{END}", f" {END} "]
    return texts + ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(1500)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_added_tokens_have_their_id(name):
    path = T.tokenizer_path(name)
    library, texts = Tokenizer.from_file(path), special_texts()
    data, offsets = T.buffers(pa.array(["skipped", *texts], pa.string()))
    encoder = tokens.Encoder(path)
    ids, counts = encoder.encode(data, offsets, 1, len(texts) + 1)
    assert len(counts) == len(texts)
    for text, own in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
        assert own.tolist() == library.encode(text or "", add_special_tokens=False).ids, text
    if name.startswith("word"):
        assert encoder.by_word and ids[counts[0] - 2] == 49407


def test_packing_and_files_hold_them(spark, tmp_path):
    library = Tokenizer.from_file(PATH)
    docs = cases.frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(special_texts()[:100])])
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(special_texts()[:100])}
    packed = {r.doc_id: list(r.ids) for r in packing.pack(docs, PATH, end_id=1, size=256).collect()}
    assert packed == {i: [*ids, 1] for i, ids in want.items()}
    path = str(tmp_path / "tokens")
    token_files.write_token_files(docs, path, PATH, end_id=2)
    assert {r.doc_id: list(r.ids) for r in token_files.read_token_files(spark, path).collect()} == {i: [*ids, 2] for i, ids in want.items()}
