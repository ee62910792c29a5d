"""Benchmark decontamination by templates: numbers, names and units become typed placeholders.

Texts are cut into runs of letters and digits, folded in case. A run that begins with a
digit is a number, a known unit after a number is a unit, and a capitalised run that does
not begin a sentence is a name; neighbouring numbers, or names, are one placeholder. Windows
of eight such tokens, at least half of them words, are hash-joined with those of the
benchmark. Matches of one document and item on one diagonal (the same shift between their
positions) chain up, and a chain is a leak if it is long enough and either the slots hold the
same values (verbatim) or every value of the item stands for one and the same value in the
document throughout (a question with other parameters). Windows of the tokens as they are, folded
in case and whatever their class, go the same way besides and give verbatim leaks, so a copy
counts whatever its names, numbers, case or place in a sentence.

The windows of the benchmark are counted first. Up to ``BROADCAST_WINDOWS`` their hashes go
to the tasks, which then pass on matching windows only; beyond, all windows are joined by
shuffle. Everything after that is the same.

Nulls and ties: a null text is an empty one; items of fewer than four tokens are no evidence
and are left out, and shorter items than a window are matched as a whole; equal items are all
named; repeated rows are judged each for itself; a null id is kept. Empty tables give no
rows, or no leaks. The columns of the input are kept apart, so their names never clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from retenta.llm import text as T
from retenta.llm.exprs import let
from retenta.session import stage

WINDOW, LEAST_WINDOW = 8, 4
#: A chain must cover so many tokens, or the whole item if it is shorter.
LEAST_TOKENS = 10
#: 8 bytes each; beyond it the windows are joined by shuffle.
BROADCAST_WINDOWS = 2_000_000
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers "
    "mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml cl l liter liters litre litres "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "usd eur dollar dollars cent cents euro euros percent degree degrees kmh mph"
).split()
_PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_ENDS_SENTENCE = ".!?:\n\""
LITERAL, NUMBER, NAME, UNIT = 0, 1, 2, 3
#: Sets hashes of windows of plain tokens apart from those of templates.
EXACT = 1 << 32

HITS = "array<struct<hash:bigint,pos:int,slots:array<bigint>>>"


def folded(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and the capital letters of Latin-1 in lower case."""
    x = data.copy()
    x[(x >= 65) & (x <= 90)] += 32
    if len(x) > 1:
        second = (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)
        x[1:][second] += 32
    return x


class Template:
    """Template tokens of a run of rows: hash of word or placeholder, value of the slot, class, tokens of each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int, last: int):
        words = T.words_of(data, offsets, first, last, T.WHITE + _PUNCTUATION)
        x = words.data
        table = T.byte_table()
        own = T.Words(folded(x), words.rows, words.start, words.end, words.of).hashes(table)
        n = len(own)
        kind = np.zeros(n, np.int8)
        if n:
            head = x[words.start]
            second = x[np.minimum(words.start + 1, len(x) - 1)]
            kind[(head >= 48) & (head <= 57)] = NUMBER
            ends = np.zeros(256, bool)
            ends[[ord(c) for c in _ENDS_SENTENCE]] = True
            marks = np.cumsum(ends[x])
            begins = np.ones(n, bool)
            begins[1:] = marks[words.start[1:]] > marks[words.end[:-1] - 1]
            begins[words.of[:-1][words.of[:-1] < n]] = True
            capital = ((head >= 65) & (head <= 90)) | ((head == 0xC3) & (second >= 0x80) & (second <= 0x9E))
            kind[capital & ~begins] = NAME
            after = np.zeros(n, bool)
            after[1:] = kind[:-1] == NUMBER
            kind[after & (kind == LITERAL) & np.isin(own, _unit_hashes())] = UNIT
        row = words.row_of()
        joins = np.zeros(n, bool)
        joins[1:] = (kind[1:] == kind[:-1]) & (row[1:] == row[:-1]) & ((kind[1:] == NUMBER) | (kind[1:] == NAME))
        at = np.flatnonzero(~joins)
        self.kind = kind[at]
        self.value = np.add.reduceat(own, at) if n else own
        marks = T.mix(np.arange(4, dtype=np.uint64) + np.uint64(77))
        self.token = np.where(self.kind == LITERAL, own[at] if n else own, marks[self.kind])
        self.of = np.searchsorted(at, words.of)
        self.raw, self.raw_of = own, words.of

    def exact(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and places of windows of the tokens as they are, but for case."""
        hashes, at = T.windows(self.raw, self.raw_of, size)
        return T.mix(hashes + np.uint64(size + EXACT)), at

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and places of windows of which at least half are words."""
        hashes, at = T.windows(self.token, self.of, size)
        literal = np.concatenate([[0], np.cumsum(self.kind == LITERAL)])
        enough = 2 * (literal[at + size] - literal[at]) >= size
        return T.mix(hashes[enough] + np.uint64(size)), at[enough]

    def slots(self, at: int, size: int) -> list[int]:
        filled = np.flatnonzero(self.kind[at : at + size] != LITERAL) + at
        return self.value[filled].view(np.int64).tolist()


def _unit_hashes() -> np.ndarray:
    store = T.worker_store()
    if "unit hashes" not in store:
        data, offsets = T.buffers(pa.array(UNITS))
        words = T.words_of(data, offsets, 0, len(UNITS))
        store["unit hashes"] = words.hashes(T.byte_table())
    return store["unit hashes"]


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row per window of an item: hash, item, pos, size of the window, tokens of the item, slot values, and
    whether the window is one of plain tokens, which has no slots."""

    def run(batch: pa.RecordBatch):
        data, offsets = T.buffers(batch.column(1))
        rows = []
        for first, last in T.row_chunks(offsets):
            t = Template(data, offsets, first, last)
            for exact, of in ((False, t.of), (True, t.raw_of)):
                n = np.diff(of)
                for size in range(LEAST_WINDOW, WINDOW + 1):
                    hashes, at = t.exact(size) if exact else t.windows(size)
                    row = np.searchsorted(of, at, "right") - 1
                    # A long item has windows of the full size, a shorter one a single window over all of it.
                    own = np.flatnonzero(np.minimum(n[row], WINDOW) == size)
                    for k in own.tolist():
                        i = int(row[k])
                        slots = [] if exact else t.slots(int(at[k]), size)
                        rows.append((int(hashes[k].view(np.int64)), first + i, int(at[k] - of[i]), size, int(n[i]), slots, exact))
        columns = list(zip(*rows)) if rows else [[]] * 7
        kinds = (pa.int64(), None, pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.bool_())
        arrays = [pa.array(c, k) if k else batch.column(0).take(pa.array(c, pa.int64())) for c, k in zip(columns, kinds)]
        yield pa.RecordBatch.from_arrays(arrays, names=["hash", "item_id", "pos", "size", "tokens", "slots", "exact"])

    kind = benchmark.schema[id_col].dataType.simpleString()
    rows = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return T.map_batches(
        rows, f"hash bigint, item_id {kind}, pos int, size int, tokens int, slots array<bigint>, exact boolean", run
    )


def _hits(docs: DataFrame, text_col: str, carry: list[str], sizes: list[tuple[int, bool]], wanted: np.ndarray | None) -> DataFrame:
    """The columns ``carry`` of each document, as ``_row``, with its windows; if ``wanted`` is given, those in it only."""
    spark = docs.sparkSession
    shared = None if wanted is None else spark.sparkContext.broadcast(np.sort(wanted))

    def run(batches):
        known = None if shared is None else shared.value
        if known is not None:
            door = np.zeros(1 << 20, bool)
            door[(known & np.uint64(0xFFFFF)).astype(np.int64)] = True
        for batch in batches:
            data, offsets = T.buffers(batch.column(1))
            for first, last in T.row_chunks(offsets):
                t = Template(data, offsets, first, last)
                rows: list[list] = [[] for _ in range(last - first)]
                for size, exact in sizes:
                    hashes, at = t.exact(size) if exact else t.windows(size)
                    of = t.raw_of if exact else t.of
                    if known is not None:
                        maybe = np.flatnonzero(door[(hashes & np.uint64(0xFFFFF)).astype(np.int64)])
                        place = np.searchsorted(known, hashes[maybe])
                        maybe = maybe[known[np.minimum(place, len(known) - 1)] == hashes[maybe]]
                        hashes, at = hashes[maybe], at[maybe]
                    row = np.searchsorted(of, at, "right") - 1
                    for h, p, i in zip(hashes.view(np.int64).tolist(), at.tolist(), row.tolist()):
                        rows[i].append({"hash": h, "pos": p - int(of[i]), "slots": [] if exact else t.slots(p, size)})
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(rows, kind)], names=["_row", "hits"]
                )

    kind = pa.list_(pa.struct([("hash", pa.int64()), ("pos", pa.int32()), ("slots", pa.list_(pa.int64()))]))
    row = F.struct(*[F.col(f"`{name}`") for name in carry])
    frame = docs.select(row.alias("_row"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    hits = StructType.fromDDL(f"hits {HITS}")["hits"]
    return frame.mapInArrow(run, StructType([frame.schema["_row"], hits]))


def _longest(chain: Column) -> Column:
    """The longest run of neighbouring positions in a sorted array of matches; the first of equal ones."""
    islands = F.transform(chain, lambda x, i: x["pos"] - i)
    runs = let(
        islands,
        lambda own: F.transform(
            F.array_distinct(own),
            lambda k: let(
                F.filter(chain, lambda x, i: F.get(own, i) == k),
                lambda run: F.struct(F.size(run).alias("n"), run.alias("run")),
            ),
        ),
    )
    return F.aggregate(
        runs,
        F.struct(F.lit(0).alias("n"), F.slice(chain, 1, 0).alias("run")),
        lambda best, r: F.when(r["n"] > best["n"], r).otherwise(best),
        lambda best: best["run"],
    )


def leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``_row`` (the document's columns, or those named), ``contaminated`` and ``leaks``: item, verbatim or not, tokens, place."""
    # Equal items are one until their ids are named, so copies of items never meet copies of documents.
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    items = benchmark.select("item_id", text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("copies"))
    once = items.groupBy("copies").agg(F.max("text").alias("text"))
    bench = stage(benchmark_windows(once, "copies").withColumnRenamed("item_id", "copies"), "benchmark-windows")
    ids = items.groupBy("copies").agg(F.collect_set(F.struct("item_id")).alias("ids"))
    sizes = [tuple(row) for row in bench.select("size", "exact").distinct().collect()]
    wanted = None
    if bench.count() <= BROADCAST_WINDOWS:
        wanted = bench.select("hash").distinct().toPandas()["hash"].to_numpy(np.int64).view(np.uint64)
    if not sizes:
        sizes, wanted = [], np.zeros(1, np.uint64)
    rows = _hits(docs, text_col, carry or docs.columns, sizes, wanted).withColumn("_uid", F.monotonically_increasing_id())
    rows = stage(rows, "windows")
    hits = rows.select("_uid", F.inline("hits")).withColumnsRenamed({"pos": "doc_pos", "slots": "doc_slots"})
    known = F.broadcast(bench) if wanted is not None else bench
    met = hits.join(known, "hash").filter(F.size("slots") == F.size("doc_slots"))
    # Same document, item and shift: at most one match per window of the item.
    match = F.struct(
        "pos",
        (F.col("slots") == F.col("doc_slots")).alias("same"),
        F.arrays_zip(F.col("slots").alias("item"), F.col("doc_slots").alias("doc")).alias("values"),
    )
    chains = met.groupBy("_uid", "copies", (F.col("doc_pos") - F.col("pos")).alias("shift"), "size", "tokens", "exact").agg(
        F.sort_array(F.collect_set(match)).alias("chain")
    )
    need = F.least(F.lit(LEAST_TOKENS), F.col("tokens"))
    chained = chains.select(
        "*",
        _longest(F.filter("chain", lambda x: x["same"])).alias("verbatim"),
        _longest(F.col("chain")).alias("template"),
    )
    pairs = F.array_distinct(F.flatten(F.transform("chain", lambda x: x["values"])))
    # Windows of too few words are not matched and cut a chain in two; its slots must agree throughout all the same.
    one_to_one = let(pairs, lambda p: F.size(p) == F.size(F.array_distinct(F.transform(p, lambda x: x["item"]))))
    covers = lambda run: (F.size(run) > 0) & (F.size(run) + F.col("size") - 1 >= need)
    found = chained.filter(covers("verbatim") | (covers("template") & one_to_one)).select(
        "_uid",
        "copies",
        covers("verbatim").alias("verbatim"),
        (F.greatest(F.size("verbatim"), F.when(one_to_one, F.size("template")).otherwise(0)) + F.col("size") - 1).alias("tokens"),
        (F.col("shift") + F.get("template", F.lit(0))["pos"]).alias("at_token"),
    )
    named = found.join(ids, "copies").select(
        "_uid",
        F.transform(
            "ids", lambda x: F.struct(x["item_id"].alias("item_id"), F.col("verbatim"), F.col("tokens"), F.col("at_token"))
        ).alias("leaks"),
    )
    per_row = named.groupBy("_uid").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("leaks")))).alias("leaks"))
    return rows.select("_uid", "_row").join(per_row, "_uid", "left").select(
        "_row", F.col("leaks").isNotNull().alias("contaminated"), "leaks"
    )


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's id, whether it is contaminated, and by which items."""
    return leaks(docs, benchmark, text_col, [id_col]).select(
        F.col(f"_row.`{id_col}`").alias("doc_id"),
        "contaminated",
        F.coalesce(F.array_distinct(F.transform("leaks", lambda x: x["item_id"])), F.array().cast("array<bigint>")).alias("item_ids"),
        F.coalesce(F.exists("leaks", lambda x: x["verbatim"]), F.lit(False)).alias("verbatim"),
        F.coalesce(F.array_max(F.transform("leaks", lambda x: x["tokens"])), F.lit(0)).alias("matched_tokens"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents without a leak, with their own columns."""
    return leaks(docs, benchmark, text_col).filter("NOT contaminated").select("_row.*")


T.ship_by_value(__name__)
