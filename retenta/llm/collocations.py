"""Phrases that are found together more often than their parts suggest, by multikey quicksort of suffixes.

Words are counted per language first. The most frequent ones (``HEAD_BYTES`` of words at most)
get a number that every task knows; other frequent words travel as their bytes, and a bit map
of fixed size tells which words those may be. A suffix is a word and the two after it in its
piece of text. Suffixes whose first two words are frequent are routed by these words, so that a
task holds all suffixes of a pair, as packed blocks with equal suffixes counted before; pairs of
two very frequent words are spread by their third word too. A task sorts pointers to its
suffixes by three-way partitions, word after word: a partition of suffixes with equal words is a
phrase, its size the number of occurrences, and partitions that are too small are abandoned.

Nulls, ties and odd tables: a null text has no words; a null language is ``und``. Repeated rows
count each for itself. An empty table gives no phrases. Ties in score and count go by the
phrase. Other columns are ignored. A text of any length is read whole, in the memory of about
thirty times its bytes.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retenta.llm import text as T
from retenta.llm import vocabulary as V
from retenta.session import stage

WORD_ENDS = " \t"
PIECE_ENDS = ".,;:!?\n\v\f\r"
#: Bytes of words that are numbered and broadcast, at most, and of one such word.
HEAD_BYTES = 1 << 25
HEAD_WORD_BYTES = 1 << 10
#: Bits of the map of other frequent words.
MAP_BITS = 1 << 26
#: Suffixes that a task routes, and sorts, at once.
ROWS_PER_BLOCK = 500_000
ROWS_PER_ROUTE = 1_000_000
CHUNK_BYTES = 1 << 22
NONE = -1


def lowered(data: np.ndarray) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def lang_texts(batch: pa.RecordBatch):
    """Runs of rows of one language: its name, and the buffers of the texts."""
    langs, texts = batch.columns
    codes = langs.dictionary_encode()
    for k, lang in enumerate(codes.dictionary.to_pylist()):
        own = texts.take(pa.array(np.flatnonzero(codes.indices.to_numpy() == k)))
        data, offsets = T.buffers(own)
        for first, last in T.row_chunks(offsets, CHUNK_BYTES):
            yield lang, lowered(data[offsets[first] : offsets[last]]), offsets[first : last + 1] - offsets[first]


def piece_words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.BinaryArray, np.ndarray]:
    """The words of some rows, and a number that differs between words of different pieces."""
    words = T.words_of(data, offsets, 0, len(offsets) - 1, apart=WORD_ENDS + PIECE_ENDS)
    ends = np.zeros(256, bool)
    ends[[ord(c) for c in PIECE_ENDS]] = True
    piece = np.cumsum(ends[data])[words.start] if len(words.start) else np.zeros(0, np.int64)
    return V.cut(data, words.start, words.end), piece + words.row_of()


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, n) of columns ``lang`` and ``text``."""

    def count(batches):
        def parts():
            for batch in batches:
                for lang, data, offsets in lang_texts(batch):
                    values, n = piece_words(data, offsets)[0].value_counts().flatten()
                    yield pa.table({"lang": pa.array([lang] * len(values), pa.string()), "word": values, "n": n})

        for table in V.counted(parts(), ["lang", "word"]):
            yield from V.batches_of(table)

    counted = texts.mapInArrow(count, "lang string, word binary, n bigint")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def word_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little") >> 1


def bit_map(words: DataFrame, bits: int = MAP_BITS) -> bytes:
    """A map of ``bits`` bits with that of each word set; the driver gets ``bits`` / 64 numbers at most."""

    def slots(batches):
        for batch in batches:
            at = np.array([word_hash(w) for w in batch.column(0).to_pylist()], np.int64) % bits
            yield pa.RecordBatch.from_arrays([pa.array(at // 64), pa.array(1 << (at % 64).astype(np.uint64)).view(pa.int64())], names=["slot", "mask"])

    found = words.select("word").mapInArrow(slots, "slot bigint, mask bigint").groupBy("slot").agg(F.bit_or("mask").alias("mask"))
    table, out = found.toArrow(), np.zeros(bits // 64, np.int64)
    out[table.column("slot").to_numpy()] = table.column("mask").to_numpy()
    return out.tobytes()


def multikey_partitions(keys: np.ndarray, weight: np.ndarray, keep: list[int], emit: dict[int, int]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Three-way quicksort of pointers to rows by ``keys`` (one array per word), all partitions of a round at once.

    Gives (depth, a row of each partition of rows equal in that many words, its weight) for depths in ``emit``
    and weights of ``emit[depth]`` or more. Partitions lighter than ``keep[depth]`` are abandoned.
    """
    rows, starts, depth, found = np.arange(keys.shape[1]), np.zeros(1, np.int64), np.zeros(1, np.int64), []
    least = np.array(keep)
    while len(rows):
        sizes = np.diff(np.append(starts, len(rows)))
        part = np.repeat(np.arange(len(starts)), sizes)
        value = keys[depth[part], rows]
        a, b, c = value[starts], value[starts + sizes // 2], value[starts + sizes - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[part]
        side = (value > pivot).astype(np.int64) + (value >= pivot)
        group = 3 * part + side
        counts = np.bincount(group, minlength=3 * len(starts))
        total = np.bincount(group, weights=weight[rows], minlength=3 * len(starts)).astype(np.int64)
        deeper = np.repeat(depth, 3)
        deeper[1::3] += 1
        goes_on = (counts > 0) & (deeper < len(keys)) & (total >= least[np.minimum(deeper, len(keys) - 1)])
        new_starts = np.cumsum(np.where(goes_on, counts, 0)) - np.where(goes_on, counts, 0)
        moved = np.empty(int(counts[goes_on].sum()), np.int64)
        for k in range(3):
            at = np.flatnonzero(side == k)
            own = counts[k::3]
            before = np.cumsum(own) - own
            if k == 1:
                for d, lowest in emit.items():
                    equal = np.flatnonzero((own > 0) & (deeper[1::3] == d) & (total[1::3] >= lowest))
                    found.append((d, rows[at[before[equal]]], total[1::3][equal]))
            of = part[at]
            target = new_starts[k::3][of] + np.arange(len(at)) - before[of]
            stays = goes_on[k::3][of]
            moved[target[stays]] = rows[at[stays]]
        rows, starts, depth = moved, new_starts[goes_on], deeper[goes_on]
    return found


class Numbers:
    """Numbers of frequent words in a worker: those of the shared table, and others as they come."""

    def __init__(self, table: pa.Table, bits: bytes | None, least_hot: int):
        self.words = table.column("word").combine_chunks()
        self.hot = np.append(table.column("n").to_numpy() >= least_hot, False)
        self.bits = None if bits is None else np.frombuffer(bits, np.uint64)
        self.routing = T.mix(np.arange(1, len(self.words) + 1, dtype=np.uint64))

    def __call__(self, strings: pa.BinaryArray, n_others: int) -> tuple[np.ndarray, list[bytes]]:
        """A number per word: its place in the table, NONE if it isn't frequent, or -2 - k for the k-th other word."""
        at = pc.index_in(strings, value_set=self.words)
        number = at.fill_null(NONE).to_numpy().astype(np.int64)
        if self.bits is None:
            return number, []
        unknown = np.flatnonzero(number == NONE)
        found = strings.take(pa.array(unknown)).dictionary_encode()
        others = found.dictionary.to_pylist()
        bit = np.array([word_hash(w) for w in others], np.int64) % (64 * len(self.bits))
        may_be = (self.bits[bit // 64] >> (bit % 64).astype(np.uint64)) & np.uint64(1) > 0
        place = np.where(may_be, -2 - n_others - (np.cumsum(may_be) - 1), NONE)
        number[unknown] = place[found.indices.to_numpy()] if len(unknown) else NONE
        return number, [w for w, keep in zip(others, may_be) if keep]


def _blocks(lang: str, suffixes: np.ndarray, others: list[bytes], numbers: Numbers, routes: int):
    """(route, rows, body, others) of suffixes, equal ones counted; ``suffixes`` has an array per word."""
    table = np.concatenate([numbers.routing, np.array([word_hash(w) for w in others], np.uint64)])
    place = np.where(suffixes >= 0, suffixes, len(numbers.words) - 2 - suffixes)
    place[suffixes == NONE] = 0
    one, two, three = (table[p] for p in place)
    three = np.where(suffixes[2] == NONE, np.uint64(7), three)
    pair = T.mix(T.mix(one + np.uint64(zlib.crc32(lang.encode()))) + two)
    hot = numbers.hot[np.maximum(suffixes[0], -1)] & numbers.hot[np.maximum(suffixes[1], -1)]
    whole = T.mix(pair + three)
    route = np.where(hot, whole, pair) % np.uint64(routes)
    order = np.argsort((route << np.uint64(40)) | (T.mix(whole) >> np.uint64(24)))
    route, own = route[order].astype(np.int64), suffixes[:, order]
    new = np.ones(len(order), bool)
    new[1:] = (own[:, 1:] != own[:, :-1]).any(axis=0) | (route[1:] != route[:-1])
    at = np.flatnonzero(new)
    own, route, n = own[:, at], route[at], np.diff(np.append(at, len(order)))
    for a, b in zip(edges := np.flatnonzero(np.diff(route, prepend=-1)), np.append(edges[1:], len(route))):
        part, words = own[:, a:b], []
        used = np.unique(part[part < NONE])
        if len(used):
            part = part.copy()
            part[part < NONE] = -2 - np.searchsorted(used, part[part < NONE])
            words = [others[-2 - u] for u in used.tolist()]
        body = np.concatenate([*part, n[a:b]]).astype("<i4").tobytes()
        yield int(route[a]), int(b - a), pa.compress(body, codec="zstd", asbytes=True), words


def phrase_counts(texts: DataFrame, words: DataFrame, least: int, head_bytes: int = HEAD_BYTES) -> DataFrame:
    """(lang, w1, w2, w3, n): every pair (``w3`` null) and triple of words in a piece found ``least`` times or more.

    ``words`` are the counts of :func:`word_counts`, as a written table.
    """
    spark = texts.sparkSession
    frequent = words.groupBy("word").agg(F.sum("n").alias("n"), F.max("n").alias("most")).filter(F.col("most") >= least)
    frequent = stage(frequent.select("word", "n"), "frequent")
    short = frequent.filter(F.octet_length("word") <= HEAD_WORD_BYTES)
    first_bin = V.least_bin(short, head_bytes, F.octet_length("word") + 16)
    in_head = (F.octet_length("word") <= HEAD_WORD_BYTES) & (V.frequency_bin(F.col("n")) >= first_bin)
    total = words.agg(F.sum("n")).first()[0] or 0
    routes = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // ROWS_PER_ROUTE))
    least_hot = max(least, total // (4 * routes))
    head = V.shared_table(frequent.filter(in_head))
    rest = frequent.filter(~in_head)
    bits = None if rest.isEmpty() else spark.sparkContext.broadcast(bit_map(rest))

    def routed(batches):
        numbers = Numbers(V.read_shared(head), bits and bits.value, least_hot)
        held: dict[str, tuple[list, list, int]] = {}

        def flush(lang: str):
            parts, others, _ = held.pop(lang)
            rows = list(_blocks(lang, np.concatenate(parts, axis=1), others, numbers, routes))
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows)), *columns], names=["lang", "route", "rows", "body", "others"])

        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.binary()))
        for batch in batches:
            for lang, data, offsets in lang_texts(batch):
                strings, piece = piece_words(data, offsets)
                parts, others, rows = held.setdefault(lang, ([], [], 0))
                number, more = numbers(strings, len(others))
                others += more
                after = np.full((2, len(number)), NONE)
                after[0, :-1] = np.where(piece[1:] == piece[:-1], number[1:], NONE)
                after[1, :-2] = np.where(piece[2:] == piece[:-2], number[2:], NONE)
                own = np.flatnonzero((number != NONE) & (after[0] != NONE))
                if len(own):
                    parts.append(np.stack([number[own], *after[:, own]]))
                    held[lang] = parts, others, rows + len(own)
                    if rows + len(own) >= ROWS_PER_BLOCK:
                        yield from flush(lang)
        for lang in list(held):
            if held[lang][0]:
                yield from flush(lang)

    def sorted_out(batches):
        known = V.read_shared(head).column("word").combine_chunks()
        hot = np.append(V.read_shared(head).column("n").to_numpy() >= least_hot, False)
        held: list[tuple] = []

        def count():
            words_in, parts, n_others = [known], [], len(known)
            for _, n_rows, body, others in held:
                raw = pa.decompress(body, decompressed_size=16 * n_rows, codec="zstd")
                own = np.frombuffer(raw, "<i4").reshape(4, n_rows).astype(np.int64)
                own[:3] = np.where(own[:3] < NONE, n_others - 2 - own[:3], own[:3])
                parts.append(own)
                words_in.append(pa.array(others, pa.binary()))
                n_others += len(others)
            rows = np.concatenate(parts, axis=1)
            held.clear()
            del parts
            strings = pa.concat_arrays(words_in)
            if n_others > len(known):
                # Equal words of several blocks get one number; those of the table keep theirs.
                encoded = strings.dictionary_encode()
                rows[:3] = np.where(rows[:3] < 0, rows[:3], encoded.indices.to_numpy()[rows[:3]])
                strings = encoded.dictionary
            is_hot = np.isin(rows[:2], np.flatnonzero(hot[: len(known)])).all(axis=0)
            for spread in (False, True):
                own = rows[:, is_hot == spread]
                low = 1 if spread else least
                for depth, row, n in multikey_partitions(own[:3], own[3], [low, low, least, least], {2: low, 3: least}):
                    picked = own[:3, row]
                    real = np.flatnonzero(picked[depth - 1] != NONE)
                    w = [strings.take(pa.array(picked[k, real])) for k in range(depth)]
                    w += [pa.nulls(len(real), pa.binary())] * (3 - depth)
                    yield w, pa.array(n[real])

        def out(lang: str):
            for w, n in count():
                table = pa.table([pa.array([lang] * len(n), pa.string()), *w, n], names=["lang", "w1", "w2", "w3", "n"])
                yield from V.batches_of(table)

        last = None
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                if held and row[0] != last:
                    yield from out(last)
                last = row[0]
                held.append(row)
        if held:
            yield from out(last)

    blocks = texts.mapInArrow(routed, "lang string, route int, rows int, body binary, others array<binary>")
    dealt = blocks.repartitionById(routes, F.col("route")).select("lang", "rows", "body", "others").sortWithinPartitions("lang")
    found = dealt.mapInArrow(sorted_out, "lang string, w1 binary, w2 binary, w3 binary, n bigint")
    # Pairs that were spread by their third word come in parts.
    return found.groupBy("lang", "w1", "w2", "w3").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (l r)), in decimals that hold products of counts up to 10**15."""
    d = "CAST({} AS DECIMAL(15, 0))".format
    return F.expr(f"(CAST(1000000 AS DECIMAL(7, 0)) * {d(a)} * {d(a)}) div ({d(left)} * {d(right)})")


def collocations(
    docs: DataFrame, least: int = 10, top: int = 2000, inside_percent: int = 50,
    lang_col: str = "lang", text_col: str = "text", head_bytes: int = HEAD_BYTES,
) -> DataFrame:
    """The ``top`` phrases of two and three words per language: lang, rank, phrase, a, l, r, n, score.

    ``a`` occurrences of the phrase, ``l`` and ``r`` of its parts where it scores least, ``n`` words of the
    language. A phrase within a longer one that has ``inside_percent`` of its occurrences is left out.
    """
    texts = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    words = stage(word_counts(texts), "words")
    counts = stage(phrase_counts(texts, words, least, head_bytes), "phrases")
    pairs, triples = counts.filter("w3 is null").drop("w3"), counts.filter("w3 is not null")
    of_word = words.filter(F.col("n") >= least)

    def with_count(rows: DataFrame, counted: DataFrame, by: dict[str, str], name: str) -> DataFrame:
        return rows.join(counted.select("lang", *[F.col(c).alias(by[c]) for c in by], F.col("n").alias(name)), ["lang", *by.values()])

    two = with_count(with_count(pairs, of_word, {"word": "w1"}, "l"), of_word, {"word": "w2"}, "r")
    two = two.withColumn("score", _score("n", "l", "r"))
    around = triples.select("lang", "w1", "w2", "n").union(triples.select("lang", "w2", "w3", "n"))
    around = around.groupBy("lang", "w1", "w2").agg(F.max("n").alias("longer"))
    two = two.join(around, ["lang", "w1", "w2"], "left").filter(
        F.col("longer").isNull() | (100 * F.col("longer") < inside_percent * F.col("n"))
    )
    three = with_count(triples, pairs, {"w1": "w2", "w2": "w3"}, "r1")
    three = with_count(with_count(three, pairs, {"w1": "w1", "w2": "w2"}, "l2"), of_word, {"word": "w1"}, "l1")
    three = with_count(three, of_word, {"word": "w3"}, "r2")
    three = three.withColumns({"s1": _score("n", "l1", "r1"), "s2": _score("n", "l2", "r2")})
    later = F.col("s2") < F.col("s1")

    def pick(at_two: str, at_one: str) -> Column:
        return F.when(later, F.col(at_two)).otherwise(F.col(at_one))

    def phrase(*names: str) -> Column:
        return F.concat_ws(" ", *[F.col(name).cast("string") for name in names]).alias("phrase")

    both = two.select("lang", phrase("w1", "w2"), F.col("n").alias("a"), "l", "r", "score").unionByName(
        three.select(
            "lang", phrase("w1", "w2", "w3"), F.col("n").alias("a"),
            pick("l2", "l1").alias("l"), pick("r2", "r1").alias("r"), pick("s2", "s1").alias("score"),
        )
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = both.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= top)
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


T.ship_by_value(__name__)
