"""Language identification by compression with one zstandard dictionary per language.

A text is compressed once with each language's raw-content dictionary; the smallest result
names the language. The margin is what the runner-up needs more, as a share of its size; a
narrow margin is not accepted, though the best guess is still told. Dictionaries are made of
whole labelled texts, drawn by a hash up to a fixed number of bytes per language.

Nulls and ties: null texts and texts without a letter are ``und`` with score 0; equal sizes
go to the first language by name; a null language is never learned; a null id is never held
out; repeated rows are judged each for itself. Without labelled texts everything is ``und``.
An empty table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retenta.llm import text as T

#: Bytes of each language's dictionary, and labelled documents per language that it is made of, about.
DICTIONARY_BYTES, SAMPLE_DOCS = 100_000, 200
LEVEL = 5
#: A margin below this share of the runner-up's size is narrow.
LEAST_MARGIN = 0.01
#: Sizes that differ by no more bytes are looked at word by word.
NARROW_BYTES = 3
_LETTERS = re.compile(r"[^\W\d_]+")


def held_out(id_col: str) -> Column:
    """Documents that nothing is learned from: crc32 of the id as text leaves 2 by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """A dictionary per language, of about ``SAMPLE_DOCS`` learnable documents each."""
    rows = docs.filter(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("h")
    )
    sizes = {row.lang: row.n for row in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int(2**40 * min(1.0, SAMPLE_DOCS / n)))])
    drawn = rows.filter(F.pmod("h", F.lit(1 << 40)) < F.element_at(share, F.col("lang"))).distinct()
    # Whole texts, short ones first, so that one long text doesn't fill a dictionary.
    made: dict[str, list[bytes]] = {lang: [] for lang in sizes}
    held = dict.fromkeys(sizes, 0)
    for row in sorted(drawn.collect(), key=lambda r: (len(r.text), r.h)):
        raw = row.text.lower().encode() + b"\n"
        if held[row.lang] + len(raw) <= DICTIONARY_BYTES or not held[row.lang]:
            made[row.lang].append(raw)
            held[row.lang] += len(raw)
    return {lang: b"".join(parts)[-DICTIONARY_BYTES:] for lang, parts in sorted(made.items())}


class Classifier:
    """Compressors of all languages, ready in a worker."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.languages = sorted(dictionaries)
        self.compressors = []
        for lang in self.languages:
            made = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made.precompute_compress(level=LEVEL)
            self.compressors.append(
                zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_content_size=False, write_dict_id=False)
            )

    def sizes(self, text: str) -> list[int]:
        raw = text.lower().encode()
        return [len(c.compress(raw)) for c in self.compressors]

    def judge(self, text: str | None) -> tuple[str, float, float, bool]:
        """Language, score (share of the best under weights 2 ** -bits per byte), margin, accepted."""
        if not self.languages or text is None or not any(map(str.isalpha, text)):
            return "und", 0.0, 0.0, False
        sizes = self.sizes(text)
        close = sorted(sizes)
        if len(close) > 1 and close[1] - close[0] <= NARROW_BYTES:
            # A tie of whole bytes; single words, each compressed apart, tell languages apart more finely.
            apart = [0] * len(sizes)
            for word in set(_LETTERS.findall(text.lower())):
                apart = [a + n for a, n in zip(apart, self.sizes(f" {word} "))]
            scale = max(1, sum(apart)) * 4
            sizes = [n + NARROW_BYTES * 4 * a / scale for n, a in zip(sizes, apart)]
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        best = order[0]
        if len(order) == 1:
            return self.languages[best], 1.0, 1.0, True
        margin = (sizes[order[1]] - sizes[best]) / sizes[order[1]]
        weights = [math.exp2(-min(40.0, 8.0 * (n - sizes[best]) / math.sqrt(sizes[best]))) for n in sizes]
        return self.languages[best], 1.0 / sum(weights), margin, margin >= LEAST_MARGIN


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Predicted language, score, margin and whether the margin was wide enough, of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches):
        classifier = Classifier(shared.value)
        for batch in batches:
            rows = [classifier.judge(text) for text in batch.column(2).to_pylist()]
            columns = list(zip(*rows)) if rows else [[]] * 4
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["doc_id", "held_out", "lang_pred", "score", "margin", "accepted"],
            )

    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text")
    )
    return rows.mapInArrow(
        run, "doc_id bigint, held_out boolean, lang_pred string, score double, margin double, accepted boolean"
    )


T.ship_by_value(__name__)
