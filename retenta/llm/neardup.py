"""Near duplicates by ProbMinHash, banding and verification.

Shingles are runs of five words (a shorter text is one shingle), weighted by how often they
occur. The signature follows ProbMinHash: each shingle arrives at random registers as a
Poisson process whose rate is its weight, and every register keeps the first arrival. All
arrivals together are a Poisson process too, so the time by which all registers have one
hardly depends on the text; arrivals beyond it are never made, which is the early end. Two
texts agree in a register with the probability Jaccard similarity of their shingles. That falls
when one text repeats a passage, so a text with repeated shingles is also filed under the
signature of its set, where each weighs 1; for all other texts both are the same.

Rows of the signature make bands; texts that share a band are candidates. Equal texts are
one node beforehand. In each bucket the members are compared with a representative and not
with each other; members of one component need no further comparison. Texts of buckets that
still hold several components are joined by prefixes: with all shingles in one order, rarest
first, similar texts share one of the first few and are of similar size. One text of each
such key links families of texts first; then all pairs of different components that share a
key and can be similar are compared, grouped by component, so that pairs within one are not
made. What a pair has apart is bounded from sketches of both texts before it is made: of a text
and a whole component first, of two texts then. This step is exact and finds similar texts
without a common band, too. A pair is a link if the Jaccard similarity of its shingle sets is 0.8
or more; components of links are the groups.

Nulls and ties: a text without words (null, empty, white space) is in no group, each is kept;
texts equal word for word are duplicates whatever their spacing; the kept document of a group
is the one of least id (null last), and of equal ids, one. An empty table gives no rows. The
columns of the input are kept apart from those made here, so their names never clash.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from retenta.llm import text as T
from retenta.llm.graph import components
from retenta.session import stage

SHINGLE, SIMILARITY = 5, 0.8
#: With 16 bands of 4 a pair of set similarity 0.8 is missed with probability 2e-4.
BANDS, BAND_ROWS = 16, 4
#: Two texts are similar if they share this part of the sum of their sizes.
SHARE = SIMILARITY / (1 + SIMILARITY)
#: Counters of how many texts have a shingle; they set an order only, so sharing one costs time and no pair.
SLOTS = 1 << 22
#: Bits of the map of rows whose texts are wanted; a bit that several rows share costs time and no row.
MAP_BITS = 1 << 25
#: 64-bit words of a sketch; shingles that fall on one bit hide each other, which costs time and no pair.
SKETCH_WORDS = 16
#: Ratio of the sizes within a class of texts.
SIZE_STEP = 1.06
NO_ID = -(2**63)


def shingles(words: T.Words, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row as (hash, row, times); a row of fewer words has one for all of them."""
    grams, at = T.windows(hashes, words.of, size)
    n = np.diff(words.of)
    row = np.repeat(np.arange(len(n)), n)[at]
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        whole, _ = row_digests(hashes, words.of)
        grams, row = np.concatenate([grams, whole[short]]), np.concatenate([row, short])
    key = grams + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    times = np.diff(np.append(first, len(key)))
    one = order[first]
    return grams[one], row[one], times


def row_digests(hashes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of all words of each row, in order."""
    out = []
    for salt in (1, 2):
        own = hashes if salt == 1 else T.mix(hashes ^ np.uint64(0x5851F42D4C957F2D))
        up, down = T._powers(T._WORD_BASE, len(own) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * up[: len(own)])])
        total = (sums[of[1:]] - sums[of[:-1]]) * down[of[:-1]]
        out.append(T.mix(total + np.diff(of).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    return out[0], out[1]


def signatures(grams: np.ndarray, row: np.ndarray, weight: np.ndarray, n_rows: int, registers: int) -> np.ndarray:
    """(n_rows, registers): the shingle that arrives first at each register; rows without shingles are 0."""
    out = np.zeros((n_rows, registers), np.uint64)
    if not len(grams):
        return out
    rate = np.bincount(row, weight, n_rows)
    live = rate > 0
    until = np.where(live, registers * (np.log(registers) + 3.0) / np.maximum(rate, 1e-300), 0.0)
    filled = np.zeros((n_rows, registers), bool)
    best_slot, best_time, best_gram = [], [], []
    time, nth = np.zeros(len(grams)), np.zeros(len(grams), np.uint64)
    drawn = _draw(grams, nth)
    time += _wait(drawn) / weight
    while True:
        on = np.flatnonzero(time < until[row])
        while len(on):
            slot = row[on] * registers + ((drawn[on] & np.uint64(0xFFFFF)) * np.uint64(registers) >> np.uint64(20)).astype(np.int64)
            best_slot.append(slot)
            best_time.append(time[on].copy())
            best_gram.append(grams[on])
            filled.ravel()[slot] = True
            nth[on] += np.uint64(1)
            drawn[on] = _draw(grams[on], nth[on])
            time[on] += _wait(drawn[on]) / weight[on]
            on = on[time[on] < until[row[on]]]
        open_rows = live & ~filled.all(1)
        if not open_rows.any():
            break
        until[open_rows] *= 1.5
        again = open_rows[row]
        grams, row, weight, time, nth, drawn = (x[again] for x in (grams, row, weight, time, nth, drawn))
    slot, time, gram = map(np.concatenate, (best_slot, best_time, best_gram))
    order = np.lexsort((gram, time, slot))
    first = order[np.flatnonzero(np.concatenate([[True], np.diff(slot[order]) != 0]))]
    out.ravel()[slot[first]] = gram[first]
    return out


def _draw(grams: np.ndarray, nth: np.ndarray) -> np.ndarray:
    return T.mix(grams + (nth + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))


def _wait(drawn: np.ndarray) -> np.ndarray:
    """Exponential waiting time from the upper 44 bits; the lower 20 choose the register."""
    return -np.log(((drawn >> np.uint64(20)).astype(np.float64) + 0.5) / float(1 << 44))


def _binary(first: np.ndarray, second: np.ndarray) -> pa.Array:
    raw = np.stack([first, second], 1).astype(">u8").tobytes()
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(first), [None, pa.py_buffer(raw)]).cast(pa.binary())


def _bits(digest: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
    """Place of a row in the bit map."""
    own = T.mix(digest + doc_id.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (own & np.uint64(MAP_BITS - 1)).astype(np.int64)


def _bit_map(chosen: DataFrame) -> np.ndarray:
    """A map of fixed size, as bytes, with a bit set for each row of ``chosen`` (node, doc_id)."""

    def run(batch: pa.RecordBatch):
        digest = np.frombuffer(b"".join(batch.column(0).to_pylist()), ">u8")[::2].astype(np.uint64)
        at = np.unique(_bits(digest, batch.column(1).to_numpy(zero_copy_only=False)))
        heads = np.flatnonzero(np.diff(at >> 5, prepend=-1))
        set_bits = np.bitwise_or.reduceat(np.int64(1) << (at & 31), heads) if len(at) else at
        yield pa.RecordBatch.from_arrays([pa.array(at[heads] >> 5), pa.array(set_bits)], names=["word", "bits"])

    words = T.map_batches(chosen.select("node", "doc_id"), "word bigint, bits bigint", run)
    found = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(MAP_BITS // 32, "<u4")
    out[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return out.view(np.uint8)


def _rows(
    docs: DataFrame, id_col: str, text_col: str, give: str, bands: int = BANDS, band_rows: int = BAND_ROWS, only=None
) -> DataFrame:
    """``doc_id`` and ``node`` (null without words) of each row, with its ``bands``, its ``text``, or itself as ``row``.

    ``only``, a broadcast bit map, leaves out rows of texts that aren't in it.
    """
    table = T.byte_table()

    def run(batch: pa.RecordBatch):
        column = batch.column(1)
        data, offsets = T.buffers(column)
        for first, last in T.row_chunks(offsets):
            words = T.words_of(data, offsets, first, last)
            hashes = words.hashes(table)
            n = np.diff(words.of)
            digests = row_digests(hashes, words.of)
            node = _binary(*digests)
            node = pa.array(np.where(n > 0, np.array(node.to_pylist(), object), None), pa.binary())
            columns = [batch.column(0).slice(first, last - first), node]
            if give == "bands":
                grams, row, times = shingles(words, hashes, SHINGLE)
                signed = signatures(grams, row, times.astype(float), last - first, bands * band_rows)
                # The same registers for plain sets; they differ only where a shingle is repeated.
                again = np.flatnonzero(np.bincount(row, times > 1, last - first))
                part = np.isin(row, again)
                plain = signatures(grams[part], np.searchsorted(again, row[part]), np.ones(part.sum()), len(again), bands * band_rows)
                order = np.argsort(np.concatenate([np.arange(last - first), again]), kind="stable")
                parts = np.concatenate([signed, plain])[order].reshape(-1, bands, band_rows)
                salts = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
                keys = np.broadcast_to(salts, parts.shape[:2]).copy()
                for k in range(band_rows):
                    keys = T.mix(keys ^ parts[:, :, k]) * np.uint64(0x9FB21C651E98DF25)
                sets = np.where(n > 0, 1 + np.isin(np.arange(last - first), again), 0)
                ends = np.concatenate([[0], np.cumsum(bands * sets)])
                live = np.repeat(n > 0, np.maximum(sets, 1))
                columns.append(
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[live].ravel().view(np.int64)))
                )
            else:
                columns.append(batch.column(2 if give == "row" else 1).slice(first, last - first))
            if only is not None:
                at = _bits(digests[0], columns[0].fill_null(NO_ID).to_numpy(zero_copy_only=False))
                wanted = pa.array((n > 0) & (only.value[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1))
                columns = [column.filter(wanted) for column in columns]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", give])

    columns = [F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")]
    if give == "row":
        columns.append(F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row"))
    rows = docs.select(*columns)
    kind = {"bands": ArrayType(LongType()), "text": StringType()}.get(give) or rows.schema["row"].dataType
    schema = StructType([StructField("doc_id", LongType()), StructField("node", BinaryType()), StructField(give, kind)])
    return T.map_batches(rows, schema, run)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) with the similarity of their texts' shingle sets."""
    table = T.byte_table()

    def sets(column: pa.Array) -> list[np.ndarray]:
        data, offsets = T.buffers(column)
        out = []
        for first, last in T.row_chunks(offsets):
            words = T.words_of(data, offsets, first, last)
            grams, row, _ = shingles(words, words.hashes(table), SHINGLE)
            order = np.lexsort((grams, row))
            out += np.split(grams[order], np.searchsorted(row[order], np.arange(1, last - first)))
        return out

    def run(batch: pa.RecordBatch):
        # Rows come sorted by b, so its text is cut once for a run of pairs.
        b_ids, b_texts = batch.column(1), batch.column(3)
        codes = np.array(b_ids.dictionary_encode().indices)
        heads = np.flatnonzero(np.concatenate([[True], np.diff(codes) != 0])) if len(codes) else np.zeros(0, int)
        left, right = sets(batch.column(2)), sets(b_texts.take(pa.array(heads)))
        of = np.cumsum(np.isin(np.arange(len(codes)), heads)) - 1
        out = []
        for x, k in zip(left, of):
            y = right[k]
            low, high = sorted((len(x), len(y)))
            common = len(np.intersect1d(x, y, assume_unique=True)) if low >= SIMILARITY * high else 0
            out.append(common / (low + high - common) if low >= SIMILARITY * high else 0.0)
        yield pa.RecordBatch.from_arrays([batch.column(0), b_ids, pa.array(out, pa.float64())], names=["a", "b", "similarity"])

    a = texts.toDF("a", "text_a")
    b = texts.toDF("b", "text_b")
    joined = pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b")
    return T.map_batches(joined, "a binary, b binary, similarity double", run)


def _sizes_apart(size: np.ndarray) -> np.ndarray:
    """Class of a number of shingles; texts are sought in the classes that can hold similar ones only."""
    return np.floor(np.log(np.maximum(size, 1)) / np.log(SIZE_STEP)).astype(np.int64)


def _frequencies(texts: DataFrame) -> np.ndarray:
    """About how many texts have a shingle, by the lowest bits of its hash: never too few, at least 1."""
    table = T.byte_table()

    def run(batches):
        seen = np.zeros(SLOTS, np.int64)
        for batch in batches:
            data, offsets = T.buffers(batch.column(0))
            for first, last in T.row_chunks(offsets):
                words = T.words_of(data, offsets, first, last)
                grams, _, _ = shingles(words, words.hashes(table), SHINGLE)
                np.add.at(seen, (grams & np.uint64(SLOTS - 1)).astype(np.int64), 1)
        slot = np.flatnonzero(seen)
        for k in range(0, len(slot), 50_000):
            own = slot[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(seen[own])], names=["slot", "n"])

    rows = texts.select("text").mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    found = rows.filter("n > 1").toPandas()
    counts = np.ones(SLOTS, np.uint32)
    counts[found["slot"].to_numpy(np.int64)] = np.minimum(found["n"].to_numpy(np.int64), 2**32 - 1)
    return counts


def _prefixes(texts: DataFrame) -> DataFrame:
    """(key, probe, node, comp, size, ahead) of ``texts`` (node, comp, text): two similar texts have a key in common,
    the longer one as probe.

    Shingles are put in one order for all texts, rarest first. Similar texts then share one among
    the first few, and it says how long the other one is at most: with ``ahead`` shingles from it
    on, no more can be in common. A shingle that no other text has is no key.
    """
    table = T.byte_table()
    shared = texts.sparkSession.sparkContext.broadcast(_frequencies(texts))

    def run(batch: pa.RecordBatch):
        data, offsets = T.buffers(batch.column(2))
        counts = shared.value
        for first, last in T.row_chunks(offsets, T.CHUNK_BYTES // 4):
            words = T.words_of(data, offsets, first, last)
            grams, row, _ = shingles(words, words.hashes(table), SHINGLE)
            seen = counts[(grams & np.uint64(SLOTS - 1)).astype(np.int64)]
            order = np.lexsort((grams, seen, row))
            grams, row, seen = grams[order], row[order], seen[order]
            n = np.bincount(row, minlength=last - first)
            size = n[row]
            ahead = size - (np.arange(len(row)) - (np.cumsum(n) - n)[row])
            least = np.ceil(SIMILARITY * size - 1e-9)
            most = np.minimum(size, np.floor(ahead / SHARE + 1e-6) - size)
            probe = np.flatnonzero((most >= least) & (seen > 1))
            low, high = _sizes_apart(least[probe]), _sizes_apart(most[probe])
            times = high - low + 1
            each = np.repeat(np.arange(len(probe)), times)
            kind = low[each] + np.arange(len(each)) - (np.cumsum(times) - times)[each]
            index = np.flatnonzero((ahead >= 2 * SHARE * size - 1e-6) & (seen > 1))
            at = np.concatenate([probe[each], index])
            kind = np.concatenate([kind, _sizes_apart(size[index])]).astype(np.uint64)
            keys = T.mix(grams[at] + (kind + np.uint64(1)) * np.uint64(0xA24BAED4963EE407)).view(np.int64)
            whole = first + row[at]
            for k in range(0, len(at), 50_000):
                part = slice(k, k + 50_000)
                take = pa.array(whole[part])
                columns = [pa.array(keys[part]), pa.array(np.arange(len(at))[part] < len(each))]
                columns += [batch.column(0).take(take), batch.column(1).take(take)]
                columns += [pa.array(x[at[part]].astype(np.int32)) for x in (size, ahead)]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "probe", "node", "comp", "size", "ahead"])

    schema = "key bigint, probe boolean, node binary, comp binary, size int, ahead int"
    return T.map_batches(texts.select("node", "comp", "text"), schema, run)


def _sketches(texts: DataFrame) -> DataFrame:
    """(node, s0, s1, ...) of ``texts`` (node, text): for each bit, whether an odd number of shingles falls on it.

    Two sketches differ in no more bits than there are shingles that only one of the texts has.
    """
    table = T.byte_table()
    names = [f"s{i}" for i in range(SKETCH_WORDS)]

    def run(batch: pa.RecordBatch):
        data, offsets = T.buffers(batch.column(1))
        for first, last in T.row_chunks(offsets):
            words = T.words_of(data, offsets, first, last)
            grams, row, _ = shingles(words, words.hashes(table), SHINGLE)
            bit = T.mix(grams ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(64 * SKETCH_WORDS)
            out = np.zeros((last - first) * SKETCH_WORDS, np.uint64)
            np.bitwise_xor.at(out, row * SKETCH_WORDS + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
            columns = [pa.array(np.ascontiguousarray(c)) for c in out.view(np.int64).reshape(-1, SKETCH_WORDS).T]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *columns], names=["node", *names])

    return T.map_batches(texts.select("node", "text"), "node binary, " + ", ".join(f"{n} bigint" for n in names), run)


def _mixed(keyed: DataFrame) -> DataFrame:
    """Rows of the keys that are a probe and an index of different components."""
    span = keyed.groupBy("key").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"), F.bool_or("probe").alias("longer"), F.bool_and("probe").alias("only")
    )
    return keyed.join(span.filter("low != high AND longer AND NOT only").select("key"), "key", "left_semi")


def _pairs(found: DataFrame) -> DataFrame:
    """(a, b, comp_a, comp_b), greater names first, of (node, comp, other, comp_b)."""
    return found.select(
        F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b"),
        F.greatest("comp", "other_comp").alias("comp_a"), F.least("comp", "other_comp").alias("comp_b"),
    ).distinct()


def _with_one(keyed: DataFrame) -> DataFrame:
    """Pairs of each index row with one of its key, so that families of texts become components."""
    own = keyed.filter("NOT probe").select("key", "node", "comp", "size")
    one = own.groupBy("key").agg(F.min(F.struct(F.xxhash64("node"), "node", "comp", "size")).alias("one"))
    met = own.join(one.select("key", *[F.col(f"one.{c}").alias(f"other{n}") for c, n in (("node", ""), ("comp", "_comp"), ("size", "_size"))]), "key")
    enough = F.least("size", "other_size") >= SIMILARITY * F.greatest("size", "other_size") - 1e-9
    return _pairs(met.filter((F.col("comp") != F.col("other_comp")) & enough))


def _across(keyed: DataFrame, sketches: DataFrame | None = None) -> DataFrame:
    """All pairs of different components that share a key and can be similar.

    Keys are grouped by component first, so pairs within one are never made. A probe meets the
    components of its key that hold a text it can be similar to, by its own size and, with
    ``sketches``, by the bits that all texts of the component have or that none has.
    """
    bits = [] if sketches is None else [name for name in sketches.columns if name != "node"]
    if sketches is not None:
        keyed = stage(keyed.join(sketches, "node"), "sketched")
    both = keyed.groupBy("key", "comp", "probe").agg(
        F.min("size").alias("size"), F.max("size").alias("most"), F.max("ahead").alias("ahead"),
        *[F.bit_and(name).alias(f"all_{name}") for name in bits], *[F.bit_or(name).alias(f"any_{name}") for name in bits],
    )
    fits = (F.least("ahead", "other_ahead") >= SHARE * (F.col("size") + F.col("other_size")) - 1e-6) & (
        F.col("comp") != F.col("other_comp")
    )

    def close(most: str, other_most: str, one: tuple[str, str] = ("", ""), other: tuple[str, str] = ("", "")) -> Column:
        """Whether the bits leave a similar pair possible; ``one`` and ``other`` mark what all texts and what any has."""
        if not bits:
            return F.lit(True)
        (all_a, any_a), (all_b, any_b) = one, other
        apart = [F.col(f"{all_a}{s}").bitwiseAND(F.bitwise_not(f"other_{any_b}{s}")) for s in bits]
        apart += [F.col(f"other_{all_b}{s}").bitwiseAND(F.bitwise_not(f"{any_a}{s}")) for s in bits]
        # The probe is the longer text of a pair.
        sizes = F.col(most) + F.least(most, other_most)
        return reduce(add, map(F.bit_count, apart)) <= (1 - 2 * SHARE) * sizes + 1e-6

    def other(frame: DataFrame) -> DataFrame:
        """The columns with other names, but for the key; a node is just ``other``."""
        names = {name: f"other_{name}" for name in frame.columns if name != "key"}
        return frame.withColumnsRenamed(names | ({"node": "other"} if "node" in names else {}))

    whole = ("all_", "any_")
    longer, shorter = both.filter("probe").drop("probe"), other(both.filter("NOT probe").drop("probe"))
    comps = longer.join(shorter, "key").filter(fits & close("most", "other_most", whole, whole)).select("key", "comp", *shorter.columns[1:])
    probes = keyed.filter("probe").drop("probe").join(comps, ["key", "comp"]).filter(fits & close("size", "other_most", other=whole))
    probes = probes.select("key", "node", "comp", "size", "ahead", *bits, "other_comp")
    index = other(keyed.filter("NOT probe").drop("probe"))
    longer = F.col("size") >= F.col("other_size")
    return _pairs(probes.join(index, ["key", "other_comp"]).filter(fits & longer & close("size", "other_size")))


def _compared(members: DataFrame, n_reps: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of members (key, node, comp, size, common) with ``n_reps`` representatives of their bucket, and what remains.

    Representatives are those that share most of their shingles with others, so that they are
    central. Only pairs across components count, and only those that can be similar enough:
    with c shingles in common the similarity is c / (x + y - c), and pairs that share no rare
    shingle have no more in common than either has shingles that are not rare. A
    representative has then met all other members of its bucket and leaves it.
    """
    rank = F.struct((-F.col("common") / F.col("size")).alias("far"), F.xxhash64("node").alias("h"), "node", "comp", "size", "common")
    if n_reps == 1:
        reps = members.groupBy("key").agg(F.min(rank).alias("rep"))
    else:
        # Spark cuts a bucket to n_reps in each task before its rows meet, so a large one is not gathered.
        place = F.row_number().over(Window.partitionBy("key").orderBy("rep"))
        reps = members.select("key", rank.alias("rep")).withColumn("place", place).filter(F.col("place") <= n_reps)
    reps = stage(
        reps.select("key", *[F.col(f"rep.{name}").alias(f"rep_{name}") for name in ("node", "comp", "size", "common")]),
        "representatives",
    )
    least = SIMILARITY / (1 + SIMILARITY) * (F.col("size") + F.col("rep_size"))
    possible = F.least("common", "rep_common", "size", "rep_size") >= least - 1e-9
    met = members.join(reps, "key").filter((F.col("comp") != F.col("rep_comp")) & possible)
    comps = {"comp_a": F.greatest("comp", "rep_comp"), "comp_b": F.least("comp", "rep_comp")}
    ends = {"a": F.greatest("node", "rep_node"), "b": F.least("node", "rep_node")}
    pairs = met.select(*[c.alias(k) for k, c in (ends | comps).items()]).distinct()
    used = reps.select("key", F.col("rep_node").alias("node"))
    return pairs, members.join(used, ["key", "node"], "left_anti")


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, band_rows: int = BAND_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, links, comps): node of each row; verified links between nodes; component of each linked node."""
    spark = docs.sparkSession
    rows = stage(_rows(docs, id_col, text_col, "bands", bands, band_rows), "signatures")
    nodes = rows.filter("node IS NOT NULL").select("doc_id", "node", "bands")
    keyed = nodes.select(F.explode(F.array_distinct("bands")).alias("key"), "node").distinct()
    keyed = stage(keyed, "bands")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    members = keyed.join(stage(shared, "buckets"), "key").withColumns(
        # As long as it isn't counted what a text shares, it may share all.
        {"comp": F.col("node"), "size": F.lit(1).cast("long"), "common": F.lit(1).cast("long")}
    )
    members = stage(members, "members")

    # One text for each node that is in any bucket with another; copies are told apart by id before they move.
    wanted = members.select("node").distinct()
    chosen = nodes.groupBy("node").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("doc_id"))
    chosen = stage(chosen.join(wanted, "node", "left_semi"), "chosen")
    # Whole texts move only of rows that the bit map lets through, so what is shuffled is what is compared.
    only = spark.sparkContext.broadcast(_bit_map(chosen))
    texts = _rows(docs, id_col, text_col, "text", only=only).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    texts = texts.join(chosen, ["node", "doc_id"], "left_semi").select("node", "text")
    texts = stage(texts.dropDuplicates(["node"]), "texts")

    checked = spark.createDataFrame([], "a binary, b binary, similarity double")
    edges = spark.createDataFrame([], "a binary, b binary")
    maps: list[DataFrame] = []

    def verify(pairs: DataFrame) -> None:
        """Compare pairs that have not been compared, and note which components their links join."""
        nonlocal checked, edges
        new = stage(pairs.join(checked, ["a", "b"], "left_anti"), "pairs")
        found = stage(_verified(new, texts), "verified")
        checked = checked.unionByName(found)
        linked = new.join(found.filter(F.col("similarity") >= SIMILARITY), ["a", "b"])
        edges = edges.unionByName(linked.select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")))

    def contracted(frame: DataFrame) -> DataFrame:
        """The frame with the components that new links make; older components are single names by now."""
        nonlocal edges
        merged = components(edges)
        edges = edges.limit(0)
        maps.append(merged)
        renamed = merged.toDF("comp", "new_comp")
        return frame.join(renamed, "comp", "left").withColumn("comp", F.coalesce("new_comp", "comp")).drop("new_comp")

    pairs, left = _compared(members, 1)
    verify(pairs)
    members = _open(stage(contracted(left), "members"))
    if not members.isEmpty():
        mixed = texts.join(stage(members.select("node", "comp").distinct(), "mixed-nodes"), "node")
        mixed = stage(mixed, "mixed-texts")
        keyed = stage(_mixed(stage(_prefixes(mixed), "prefixes")), "mixed-prefixes")
        verify(_with_one(keyed))
        keyed = stage(_mixed(contracted(keyed)), "mixed-prefixes")
        verify(_across(keyed, _sketches(mixed.join(keyed.select("node").distinct(), "node", "left_semi"))))
        contracted(keyed)
    return rows, checked.filter(F.col("similarity") >= SIMILARITY), _composed(maps)


def _composed(maps: list[DataFrame]) -> DataFrame:
    """(node, comp) of all nodes that any of the maps renames, each map taken after those before it."""
    total = maps[-1]
    for earlier in reversed(maps[:-1]):
        later = total.toDF("comp", "last")
        moved = earlier.join(later, "comp", "left").select("node", F.coalesce("last", "comp").alias("comp"))
        total = moved.unionByName(total.join(earlier.select("node"), "node", "left_anti"))
    return stage(total, "components")


def _open(members: DataFrame) -> DataFrame:
    """Members of buckets that still hold several components, if they can be similar to the shortest member at all."""
    span = members.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("size").alias("least"))
    span = stage(span.filter("low != high").select("key", "least"), "buckets")
    able = F.col("common") >= SIMILARITY / (1 + SIMILARITY) * (F.col("size") + F.col("least")) - 1e-9
    return stage(members.join(span, "key").filter(able).drop("least"), "members")


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per row of ``docs``: id, node, group and verified links, the kept row of the group, whether it is this."""
    rows, links, comps = link(docs, id_col, text_col)
    numbered = stage(rows.select("doc_id", "node", F.monotonically_increasing_id().alias("row")), "numbered")
    ends = links.select("a").union(links.select("b")).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n_links"))
    named = numbered.join(comps.join(ends, "node", "left"), "node", "left").select(
        "doc_id",
        "node",
        "row",
        # A text without words is a group of its own.
        F.coalesce("comp", "node", F.encode(F.concat(F.lit("row "), F.col("row").cast("string")), "utf-8")).alias("comp"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )
    named = stage(named, "named")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    best = named.groupBy("comp").agg(F.min(order).alias("best"), F.count("*").alias("group_size"))
    return named.join(stage(best, "kept"), "comp").withColumn("kept", F.col("row") == F.col("best.row"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, group_id (id of the kept document), size of the group, verified links
    of the text (between different texts), and whether the row is the kept one."""
    return _grouped(docs, id_col, text_col).select(
        "doc_id", F.col("best.doc_id").alias("group_id"), "group_size", "n_links", "kept"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, with its own columns; of rows of equal id and words, the one of least hash."""
    chosen = _grouped(docs, id_col, text_col).filter("kept AND node IS NOT NULL").select("doc_id", "node")
    none = F.lit(NO_ID)
    chosen = stage(chosen.withColumn("doc_id", F.coalesce("doc_id", none)), "chosen")
    rows = _rows(docs, id_col, text_col, "row").withColumn("doc_id", F.coalesce("doc_id", none))
    met = rows.filter("node IS NOT NULL").join(chosen, ["doc_id", "node"], "left_semi")
    one = met.groupBy("doc_id", "node").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return one.select("row.*").unionByName(rows.filter("node IS NULL").select("row.*"))


T.ship_by_value(__name__)
