"""Small corpora: random texts with planted copies and passages, and rows that go wrong easily."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use inside; all are legal columns of an input.
CLASHES = ["node", "row", "kept", "bands", "stratum", "base_failed", "hits", "hash", "id", "digest", "comp", "ids", "part"]
SYLLABLES = {
    "en": "the and ing tion er an re on at en ly ou".split(),
    "de": "der und ung sch ein ich ver keit ge zu au ß".split(),
    "es": "que ción os as do la el mente ñ ar í".split(),
}


def words(rng: random.Random, n: int, lang: str = "en") -> list[str]:
    return ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(n)]


def prose(rng: random.Random, n: int, lang: str = "en") -> str:
    own, out = words(rng, n, lang), []
    for i, word in enumerate(own):
        out.append(word.capitalize() if i % 11 == 0 else word)
        out.append(".\n" if i % 44 == 10 else ". " if i % 11 == 10 else " ")
    return "".join(out).strip()


def odd_rows() -> list[tuple]:
    """Nulls, empty texts, odd white space, a long text, repeated rows and ids."""
    long = prose(random.Random(5), 30_000)
    texts = [
        (1, None), (2, ""), (3, " \n\t\v\f\r "), (4, "one"), (None, "no id here, none at all"), (None, None),
        (5, "same row twice"), (5, "same row twice"), (6, "same row twice"), (6, "one id, other text"),
        (7, "a\u00a0b\u2003c \x1cd\x85e"), (8, "\U0001f600 \u6f22\u5b57 e\u0301 \u212a \u017f \u03a3\u03a3 \u0130"), (9, "x" * 5000), (10, long),
        (11, "\n\n\nline\nline\n line\nline\n"), (12, "Ea " * 400), (13, "ab cd " * 200), (14, "\\ <| |> \\\\<| <\\|"),
    ]
    return [(i, t, "en", "s", None if t is None else len(t)) for i, t in texts]


def frame(spark: SparkSession, rows: list[tuple], parts: int = 3) -> DataFrame:
    return spark.createDataFrame(rows, DOCS).repartition(parts)


def with_clashes(docs: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    return docs.withColumns({name: F.lit(f"own {name}") for name in CLASHES})
