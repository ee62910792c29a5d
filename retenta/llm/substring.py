"""Removal of long repeated passages by recompression.

Recompression rewrites a text: runs of one token become a symbol, and then in rounds
neighbouring symbols of which the first falls in the left half of the alphabet and the second
in the right half become one. Names and halves are hashes of what a symbol stands for, so all
tasks name globally alike, and equal passages have equal symbols in their interior. Each
symbol carries how far to either side words had a say in it, so that a symbol known to lie
inside a window of 35 words (its *core*) is the same wherever that window occurs.

The longest core symbol of a window (by hash among equal ones) is its anchor, and neighbouring
windows mostly share one: a stretch of windows with their anchor is a row, about one for
fifteen words. Within a run of one token all windows are equal, and a stretch of them is a row
that counts as often as it has windows. Then in Spark:

1. Stretches are counted by (anchor, content). Equal ones are repeats, at one row a stretch.
2. Anchors of which no other occurrence exists rule their windows out: equal windows have
   equal anchors. For all other stretches (where a repeat begins or ends), single windows
   are opened and counted by (anchor, content), one stretch standing for all equal ones.
3. Words that a repeated window covers are removed.

Names are 64 bits and contents another 32 independent ones, compared together. Windows are
judged on the input.

Nulls and ties: a null text has no words; repeated rows are repeats of each other, also under
one id; a null id is kept; no word of a text of fewer than 35 goes. An empty table gives no
rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retenta.llm import text as T
from retenta.llm.neardup import row_digests
from retenta.session import stage

WINDOW, ROUNDS = 35, 4
NO_ID = -(2**63)
STRETCHES = "array<struct<anchor:bigint,content:int,at:int,n:int,times:int>>"


class Symbols:
    """Symbols of a run of rows: name, words covered, words that had a say, and row."""

    def __init__(self, hashes: np.ndarray, of: np.ndarray):
        n = len(hashes)
        self.name = hashes
        self.row = np.repeat(np.arange(len(of) - 1, dtype=np.int32), np.diff(of))
        self.start = np.arange(n, dtype=np.int64)
        self.end = self.start + 1
        self.low, self.high = self.start, self.end

    def _neighbours(self) -> np.ndarray:
        """Where a symbol and the next one are in one row."""
        return self.row[1:] == self.row[:-1]

    def _beside(self) -> tuple[np.ndarray, np.ndarray]:
        """Least word with a say in the left neighbour, and greatest in the right one; past the row where there is none."""
        near = self._neighbours()
        left, right = self.start - 1, self.end + 1
        left[1:][near] = self.low[:-1][near]
        right[:-1][near] = self.high[1:][near]
        return left, right

    def runs(self) -> None:
        if not len(self.name):
            return
        equal = self._neighbours() & (self.name[1:] == self.name[:-1])
        left, right = self._beside()
        head = np.flatnonzero(np.concatenate([[True], ~equal]))
        last = np.append(head[1:], len(self.name)) - 1
        times = (last - head + 1).astype(np.uint64)
        name = self.name[head]
        self.name = np.where(times > 1, T.mix(name ^ (times * np.uint64(0x8CB92BA72F3D8DD7))), name)
        self.row, self.start, self.end = self.row[head], self.start[head], self.end[last]
        self.low, self.high = left[head], right[last]

    def pairs(self, nth: int) -> None:
        if not len(self.name):
            return
        right_half = (T.mix(self.name + T.mix(np.full(1, nth + 1, np.uint64))) >> np.uint64(63)).astype(bool)
        joins = self._neighbours() & ~right_half[:-1] & right_half[1:]
        left, right = self._beside()
        # The left half looks to the right only, the right half to the left only.
        low = np.where(right_half, left, self.low)
        high = np.where(right_half, self.high, right)
        at = np.flatnonzero(np.concatenate([[True], ~joins]))
        first = np.append(joins, False)[at]
        last = at + first
        self.name = np.where(first, T.mix(self.name[at] * np.uint64(0x2127599BF4325C37) + T.mix(self.name[last])), self.name[at])
        self.low, self.high = np.where(first, self.low[at], low[at]), np.where(first, self.high[last], high[last])
        self.row, self.start, self.end = self.row[at], self.start[at], self.end[last]


def parse(hashes: np.ndarray, of: np.ndarray, rounds: int) -> Symbols:
    symbols = Symbols(hashes, of)
    symbols.runs()
    for nth in range(rounds):
        symbols.pairs(nth)
    return symbols


def _content(hashes: np.ndarray) -> np.ndarray:
    """Prefix sums from which the content hash of any words in a row follows; independent of names."""
    own = T.mix(hashes ^ np.uint64(0x5851F42D4C957F2D))
    up, _ = T._powers(T._WORD_BASE, len(own) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * up[: len(own)])])


def _span(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = T._powers(T._WORD_BASE, len(sums) + 1)
    return T.mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _least(rank: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Place of the least rank in each range, the first of equal ones; -1 for an empty range."""
    width = np.maximum(high - low, 0)
    out = np.full(len(low), -1, np.int64)
    best = np.arange(len(rank))
    level = np.where(width > 0, np.log2(np.maximum(width, 1)).astype(np.int64), -1)
    step = 1
    for j in range(int(level.max(initial=-1)) + 1):
        own = np.flatnonzero(level == j)
        a, b = best[low[own]], best[high[own] - step]
        out[own] = np.where(rank[b] < rank[a], b, a)
        a, b = best[:-step], best[step:]
        best = np.where(rank[b] < rank[a], b, a)
        step *= 2
    return out


def stretches(hashes: np.ndarray, of: np.ndarray, size: int, rounds: int) -> tuple[np.ndarray, ...]:
    """(row, anchor, content, at, n, times): neighbouring windows of one anchor, by row and place in the row."""
    n_windows = np.maximum(np.diff(of) - size + 1, 0)
    row = np.repeat(np.arange(len(n_windows)), n_windows)
    if not len(row):
        return tuple(np.zeros(0, kind) for kind in (np.int64, np.uint64, np.int32, np.int64, np.int64, np.int64))
    p = np.arange(len(row)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows) + of[row]
    symbols = parse(hashes, of, rounds)
    length = np.minimum(symbols.end - symbols.start, 31).astype(np.uint64)
    rank = (T.mix(symbols.name + np.uint64(0x9FB21C651E98DF25)) >> np.uint64(5)) | ((np.uint64(31) - length) << np.uint64(59))
    low = np.searchsorted(symbols.low, p, "left")
    high = np.searchsorted(symbols.high, p + size, "right")
    anchor = _least(rank, low, high)
    sums = _content(hashes)
    alone = anchor < 0
    whole = np.zeros(len(p), np.uint64)
    whole[alone] = _span(sums, p[alone], p[alone] + size)
    new = np.ones(len(p), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | (whole[1:] != whole[:-1])
    head = np.flatnonzero(new)
    n = np.diff(np.append(head, len(p)))
    alone = alone[head]
    # A window without a core symbol is its own anchor; equal ones side by side are one row that counts for each.
    content = np.where(alone, whole[head], _span(sums, p[head], p[head] + n - 1 + size))
    name = np.where(alone, T.mix(content + np.uint64(1)), symbols.name[np.maximum(anchor[head], 0)])
    times = np.where(alone, n, 1)
    return row[head], name, _short(content, alone), p[head] - of[row[head]], n, times


def _short(content: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """32 bits of a content hash; a window's own and a stretch's are told apart."""
    return (content ^ alone.astype(np.uint64)).astype(np.uint32).view(np.int32)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def _parsed(docs: DataFrame, id_col: str, text_col: str, size: int, rounds: int) -> DataFrame:
    """``id`` and ``digest`` of each document, by which equal rows are told from others, and its stretches."""
    table = T.byte_table()

    def run(batch: pa.RecordBatch):
        data, offsets = T.buffers(batch.column(1))
        for first, last in T.row_chunks(offsets):
            words = T.words_of(data, offsets, first, last)
            hashes = words.hashes(table)
            row, anchor, content, *places = stretches(hashes, words.of, size, rounds)
            fields = [anchor.view(np.int64), content, *(x.astype(np.int32) for x in places)]
            values = pa.StructArray.from_arrays(list(map(pa.array, fields)), ["anchor", "content", "at", "n", "times"])
            ends = np.searchsorted(row, np.arange(last - first + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, last - first),
                    pa.array(row_digests(hashes, words.of)[0].view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(ends), values),
                ],
                names=["id", "digest", "stretches"],
            )

    return T.map_batches(_keyed(docs, id_col, text_col), f"id bigint, digest bigint, stretches {STRETCHES}", run)


def _packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``digest`` and the compressed text: joins by document move a third of the bytes."""
    table = T.byte_table()

    def run(batch: pa.RecordBatch):
        press = zstandard.ZstdCompressor(level=3)
        data, offsets = T.buffers(batch.column(1))
        for first, last in T.row_chunks(offsets):
            words = T.words_of(data, offsets, first, last)
            digest = row_digests(words.hashes(table), words.of)[0]
            raw = [press.compress(data[offsets[i] : offsets[i + 1]].tobytes()) for i in range(first, last)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, last - first), pa.array(digest.view(np.int64)), pa.array(raw, pa.binary())],
                names=["id", "digest", "packed"],
            )

    return T.map_batches(_keyed(docs, id_col, text_col), "id bigint, digest bigint, packed binary", run)


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    press = zstandard.ZstdDecompressor()
    texts = [press.decompress(raw) for raw in column.to_pylist()]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), offsets


def _opened(rows: DataFrame, size: int) -> DataFrame:
    """Single windows of the stretches ``open`` (anchor, at, n, times) of each document, without those counted twice."""
    table = T.byte_table()

    def run(batch: pa.RecordBatch):
        data, offsets = _unpacked(batch.column(2))
        lists = batch.column(3)
        ends, fields = lists.offsets.to_numpy(), [lists.values.field(i).to_numpy() for i in range(4)]
        for first, last in T.row_chunks(offsets):
            words = T.words_of(data, offsets, first, last)
            sums = _content(words.hashes(table))
            own = slice(ends[first], ends[last])
            anchor, at, n, times = (field[own] for field in fields)
            row = np.repeat(np.arange(last - first), np.diff(ends[first : last + 1]))
            each = np.repeat(np.arange(len(row)), n)
            p = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n) + at[each]
            start = p + words.of[row[each]]
            whole = pa.array(first + row[each])
            columns = [batch.column(0).take(whole), batch.column(1).take(whole), pa.array(anchor[each])]
            span = _span(sums, start, start + size)
            columns += [pa.array(_short(span, np.ones(len(span), bool))), pa.array(p.astype(np.int32))]
            for a in range(0, len(each), 50_000):
                part = [column.slice(a, 50_000) for column in (*columns, pa.array(times[each]))]
                yield pa.RecordBatch.from_arrays(part, names=["id", "digest", "anchor", "content", "at", "times"])

    schema = "id bigint, digest bigint, anchor bigint, content int, at int, times bigint"
    return T.map_batches(rows.select("id", "digest", "packed", "open"), schema, run)


def _once(spans: DataFrame, keys: DataFrame) -> DataFrame:
    """The spans of one row of each id and text, with both; rows that repeat it have the same."""
    return spans.join(keys.groupBy("id", "digest").agg(F.min("doc").alias("doc")), "doc")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """(id, digest, spans): runs of words (at, n) to remove from each document that has any."""
    parsed = _parsed(docs, id_col, text_col, size, rounds).withColumn("doc", F.monotonically_increasing_id())
    parsed = stage(parsed, "stretches")
    rows = parsed.select("doc", F.inline("stretches"))
    counted = rows.groupBy("anchor", "content").agg(
        F.sum("times").alias("times"), F.min(F.struct("doc", "at", "n")).alias("one")
    )
    by_anchor = counted.groupBy("anchor").agg(F.sum("times").alias("all"), F.min("times").alias("least"))
    # An anchor seen once rules its windows out; where all stretches are repeats, there is nothing to open.
    shared = stage(by_anchor.filter("all > 1").select("anchor", (F.col("least") == 1).alias("mixed")), "anchors")
    groups = stage(counted.join(shared, "anchor"), "shared-stretches")

    whole = rows.join(groups.filter("times > 1").select("anchor", "content"), ["anchor", "content"], "left_semi").select(
        # A stretch of n windows covers n - 1 words more than one window.
        "doc", "at", (F.col("n") + size - 1).alias("n")
    )
    keys = parsed.select("doc", "id", "digest")
    wanted = groups.filter("mixed").select("one.*", "anchor", "times")
    per_doc = wanted.groupBy("doc").agg(F.collect_list(F.struct("anchor", "at", "n", "times")).alias("own")).join(keys, "doc")
    per_doc = per_doc.groupBy("id", "digest").agg(F.flatten(F.collect_list("own")).alias("open"))
    packed = _packed(docs, id_col, text_col)
    windows = stage(_opened(packed.join(per_doc, ["id", "digest"]), size), "windows")
    again = windows.groupBy("anchor", "content").agg(F.sum("times").alias("all")).filter("all > 1").select("anchor", "content")
    single = windows.filter("times = 1").join(stage(again, "repeated-windows"), ["anchor", "content"], "left_semi")
    ranges = F.sort_array(F.collect_set(F.struct("at", "n")))
    of_whole = _once(whole, keys).groupBy("id", "digest").agg(ranges.alias("spans"))
    of_single = single.groupBy("id", "digest").agg(
        F.transform(F.collect_set("at"), lambda at: F.struct(at.alias("at"), F.lit(size).alias("n"))).alias("spans")
    )
    both = of_whole.unionByName(of_single).groupBy("id", "digest")
    return both.agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))


def _cut(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, words, removed words, and the words that are kept, joined by one space."""

    def run(batch: pa.RecordBatch):
        data, offsets = _unpacked(batch.column(1))
        lists = batch.column(2)
        ends = lists.offsets.to_numpy()
        at, n = (lists.values.field(i).to_numpy() for i in range(2))
        for first, last in T.row_chunks(offsets):
            words = T.words_of(data, offsets, first, last)
            total = np.diff(words.of)
            own = slice(ends[first], ends[last])
            row = np.repeat(np.arange(last - first), np.diff(ends[first : last + 1]))
            low = words.of[row] + at[own]
            change = np.zeros(len(words.start) + 1, np.int64)
            np.add.at(change, low, 1)
            np.add.at(change, low + n[own], -1)
            keep = np.cumsum(change[:-1]) == 0
            kept, removed = [], np.zeros(last - first, np.int64)
            raw = words.data.tobytes()
            for i in range(last - first):
                a, b = words.of[i], words.of[i + 1]
                mine = np.flatnonzero(keep[a:b]) + a
                removed[i] = b - a - len(mine)
                kept.append(b" ".join([raw[s:e] for s, e in zip(words.start[mine].tolist(), words.end[mine].tolist())]).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, last - first), pa.array(total), pa.array(removed), pa.array(kept, pa.string())],
                names=["id", "n_words", "n_removed", "kept"],
            )

    none = F.array().cast("array<struct<at:int,n:int>>")
    joined = _packed(docs, id_col, text_col).join(spans, ["id", "digest"], "left").select(
        "id", "packed", F.coalesce("spans", none).alias("spans")
    )
    return T.map_batches(joined, "id bigint, n_words bigint, n_removed bigint, kept string", run)


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept`` (the words left, joined by one space) of every document."""
    out = _cut(docs, repeats(docs, id_col, text_col, size, rounds), id_col, text_col)
    return out.select(F.nullif(F.col("id"), F.lit(NO_ID)).alias("doc_id"), "n_words", "n_removed", "kept")


def digests(out: DataFrame) -> DataFrame:
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


T.ship_by_value(__name__)
