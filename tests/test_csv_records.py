"""Records of multi-line CSV over byte ranges against Spark's own reader of whole files."""

from __future__ import annotations

import random

import pytest

from retenta.sources import csv_records
from retenta.sources.schemas import RAW_SCHEMAS
from retenta.sources.warehouse import read_csv

SCHEMA = RAW_SCHEMAS["order_reviews"]
HEADER = '"review_id","order_id","review_score","review_comment_title","review_comment_message","review_creation_date","review_answer_timestamp"'


def review(rng: random.Random, k: int, ending: str) -> str:
    bits = ["good", ",", '""', "\n", "\n\n", "é", " ", '""\n""', "\r\n", "x" * 40, "line " * 30]
    text = "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
    score = rng.choice(["1", "5", ""])
    title = rng.choice(["", "plain title", '"a, b"', '""'])
    quoted = f'"{text}"' if text else ""
    return f"r{k},o{k},{score},{title},{quoted},2018-01-18 00:00:00,{ending}"


@pytest.fixture()
def small_ranges(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(name) for name in names]
    yield lambda size: [spark.conf.set(name, v) for name, v in zip(names, (size, 0))]
    for name, value in zip(names, before):
        spark.conf.set(name, value)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("size", [64, 300, 4096, 1 << 27])
@pytest.mark.parametrize("line_end", ["\n", "\r\n"])
def test_same_rows_as_the_reader_of_whole_files(spark, tmp_path, small_ranges, size, line_end):
    rng = random.Random(size)
    for name in ("a.csv", "b.csv"):
        records = [HEADER, *(review(rng, k, "2018-01-18 21:46:59") for k in range(120))]
        records.insert(50, 'r-long,o,3,,"' + "many lines\n" * 60 + '",,')
        records.insert(9, "")
        end = line_end if name == "a.csv" else ""
        (tmp_path / name).write_bytes((line_end.join(records) + end).encode())
    want = rows(read_csv(spark, str(tmp_path), SCHEMA, multiline=True))
    small_ranges(size)
    found = csv_records.read_multiline_csv(spark, str(tmp_path), SCHEMA)
    assert found.schema.simpleString() == SCHEMA.simpleString()
    assert rows(found) == want and len(want) == 242
    if size < 5000:
        assert csv_records._lines(spark, str(tmp_path)).rdd.getNumPartitions() > 5


def test_quotes_that_do_not_pair_up_stop_the_job(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + '\nr1,o1,4,,"open,,\n')
    with pytest.raises(ValueError, match="pair up"):
        csv_records.read_multiline_csv(spark, str(tmp_path), SCHEMA)


def test_header_alone_and_empty_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + "\n")
    (tmp_path / "b.csv").write_text("")
    assert csv_records.read_multiline_csv(spark, str(tmp_path), SCHEMA).collect() == []
