"""Token counts of whole texts by a SentencePiece model, without making the ids.

A pre-token is a stretch of text that the model's merges cannot leave: the text is cut
between two characters wherever no piece of the vocabulary holds the one right before the
other. As a merge makes a piece, none reaches over such a cut, and the tokens of a text are
those of its pre-tokens together. Pieces are counted once per distinct pre-token of the
corpus, and the counts are joined to the pre-tokens of each document and summed.

The join has two sides. Counts of the most frequent pre-tokens (at most ``HEAD`` of at most
``vocabulary.KEY_BYTES`` bytes) are broadcast and met where the text is; the rest, rare by
nature, is shuffled as one row per document and pre-token. A pre-token of more bytes than a
key is counted in the task that finds it, once per distinct one, and goes on by its digest.

Nulls, ties and odd tables: a null text is an empty one, with no bytes and no tokens. Rows of
equal id or text are counted each for itself; a null id is kept. An empty table gives no
rows. Other columns of the input are ignored. A text of any length is read whole, in the
memory of about ten times its bytes; its distinct pre-tokens that are not frequent are one row
of the written table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retenta.llm import text as T
from retenta.llm import vocabulary as V
from retenta.session import stage

#: Pre-tokens whose counts are broadcast, at most.
HEAD = 1 << 19
CHUNK_BYTES = 1 << 23
#: The character that SentencePiece writes for a space; in a text it means a space.
SPACE_SIGN = "▁"
#: A character that is a pre-token by itself, put before others to count their pieces apart.
ANCHOR = "\n"


def joined_bytes(model: str) -> np.ndarray:
    """Whether some piece holds a character that ends in byte a right before one that begins with byte b."""
    import sentencepiece
    from sentencepiece.sentencepiece_model_pb2 import ModelProto

    rules, kinds = ModelProto(), ModelProto.SentencePiece
    rules.ParseFromString(sentencepiece.SentencePieceProcessor(model_file=model).serialized_model_proto())
    norm = rules.normalizer_spec
    plain = not norm.precompiled_charsmap and norm.add_dummy_prefix and norm.escape_whitespaces
    known = {kinds.NORMAL, kinds.UNKNOWN, kinds.CONTROL, kinds.BYTE}
    if (
        not plain
        or norm.remove_extra_whitespaces
        or rules.trainer_spec.treat_whitespace_as_suffix
        or rules.trainer_spec.model_type != rules.trainer_spec.BPE
        or any(piece.type not in known for piece in rules.pieces)
    ):
        raise ValueError(f"the rules of {model} change or cut texts in ways that are not known here")
    joined = np.zeros((256, 256), bool)
    for piece in rules.pieces:
        if piece.type == kinds.NORMAL:
            own = [c.encode() for c in piece.piece.replace(SPACE_SIGN, " ")]
            for a, b in zip(own, own[1:]):
                joined[a[-1], b[0]] = True
    if joined[ord(ANCHOR)].any() or joined[:, ord(ANCHOR)].any():
        raise ValueError(f"{model} has pieces with a line break inside")
    return joined


def pre_tokens(data: np.ndarray, offsets: np.ndarray, first: int, last: int, joined: np.ndarray) -> tuple[pa.BinaryArray, np.ndarray]:
    """Pre-tokens of rows ``first`` to ``last``; ``of[i]:of[i+1]`` are those of row i. A text that isn't empty begins with a space."""
    low, high = int(offsets[first]), int(offsets[last])
    rows = offsets[first : last + 1] - low
    filled = np.diff(rows) > 0
    x = np.insert(data[low:high], rows[:-1][filled], ord(" "))
    rows = rows + np.concatenate([[0], np.cumsum(filled)])
    cuts = np.ones(len(x), bool)
    cuts[1:] = ~joined[x[:-1], x[1:]] & ((x[1:] & 0xC0) != 0x80)
    cuts[rows[:-1][filled]] = True
    start = np.flatnonzero(cuts).astype(np.int32)
    strings = pa.BinaryArray.from_buffers(
        pa.binary(), len(start), [None, pa.py_buffer(np.append(start, np.int32(len(x)))), pa.py_buffer(x)]
    )
    return strings, np.searchsorted(start, rows)


def _chunks(column: pa.Array, joined: np.ndarray):
    if column.null_count < len(column) and pc.any(pc.match_substring(column, SPACE_SIGN)).as_py():
        column = pc.replace_substring(column, SPACE_SIGN, " ")
    data, offsets = T.buffers(column)
    for first, last in T.row_chunks(offsets, CHUNK_BYTES):
        yield first, last, *pre_tokens(data, offsets, first, last, joined)


def _counter(model: str):
    """This worker's count of pieces of pre-tokens."""
    store = T.worker_store()
    if ("pieces", model) not in store:
        import sentencepiece

        encode = sentencepiece.SentencePieceProcessor(model_file=model).encode
        alone = len(encode(ANCHOR))

        def count(tokens: list[bytes]) -> list[int]:
            return [len(ids) - alone for ids in encode([ANCHOR + t.decode() for t in tokens], num_threads=1)]

        store["pieces", model] = count
    return store["pieces", model]


def pre_token_pieces(texts: DataFrame, model: str, joined: np.ndarray) -> DataFrame:
    """(token, n, pieces): every distinct pre-token of column ``text``, how often it is found, and its pieces."""

    def found(batches):
        def parts():
            for batch in batches:
                for _, _, strings, _ in _chunks(batch.column(0), joined):
                    values, n = strings.value_counts().flatten()
                    long = V.long_ones(values)
                    pieces = np.zeros(len(values), np.int64)
                    if len(long):
                        pieces[long] = _counter(model)([values[i].as_py() for i in long.tolist()])
                    yield pa.table({"token": V.keys_of(values), "pieces": pieces, "n": n})

        for table in V.counted(parts(), ["token", "pieces"]):
            yield from V.batches_of(table)

    def counted(batches):
        for batch in batches:
            token, n, pieces = batch.columns
            new = np.flatnonzero(pieces.to_numpy() == 0)
            pieces = pieces.to_numpy().copy()
            pieces[new] = _counter(model)(token.take(pa.array(new)).to_pylist())
            yield pa.RecordBatch.from_arrays([token, n, pa.array(pieces)], names=["token", "n", "pieces"])

    own = texts.mapInArrow(found, "token binary, pieces bigint, n bigint")
    return own.groupBy("token").agg(F.sum("n").alias("n"), F.max("pieces").alias("pieces")).mapInArrow(
        counted, "token binary, n bigint, pieces bigint"
    )


def count_tokens(
    docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD
) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more tokens than ``limit``) of every row."""
    joined = joined_bytes(model)
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    pieces = stage(pre_token_pieces(texts, model, joined), "pre-tokens")
    least = V.least_bin(pieces, head)
    in_head = V.frequency_bin(F.col("n")) >= least
    shared = V.shared_table(pieces.filter(in_head).select("token", "pieces"))

    def measured(batches):
        known = V.read_shared(shared)
        head_tokens = known.column("token").combine_chunks()
        head_pieces = np.append(known.column("pieces").to_numpy(), 0)
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            n_bytes = np.diff(T.buffers(batch.column(1))[1])
            for first, last, strings, of in _chunks(batch.column(1), joined):
                keys = V.keys_of(strings)
                at = pc.index_in(keys, value_set=head_tokens)
                rare = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
                own = head_pieces[at.fill_null(len(head_pieces) - 1).to_numpy()]
                sums = np.concatenate([[0], np.cumsum(own)])
                row = np.searchsorted(of, rare, "right") - 1
                rest = pa.table({"row": row, "token": keys.take(pa.array(rare)), "n": np.ones(len(rare), np.int64)})
                rest = V.added_up([rest], ["row", "token"]).sort_by("row").combine_chunks()
                ends = np.searchsorted(rest.column("row").to_numpy(), np.arange(last - first + 1)).astype(np.int32)
                pairs = pa.StructArray.from_arrays(
                    [_one(rest.column("token"), pa.binary()), _one(rest.column("n"), pa.int64())], names=["token", "n"]
                )
                columns = [
                    pa.array(uid + np.arange(last - first)),
                    batch.column(0).slice(first, last - first),
                    pa.array(n_bytes[first:last]),
                    pa.array(np.diff(sums[of])),
                    pa.ListArray.from_arrays(pa.array(ends), pairs),
                ]
                uid += last - first
                for a in range(0, last - first, 1000):
                    yield pa.RecordBatch.from_arrays([c.slice(a, 1000) for c in columns], names=names)

    schema = "uid bigint, doc_id bigint, n_bytes bigint, known bigint, rare array<struct<token binary, n bigint>>"
    names = ["uid", "doc_id", "n_bytes", "known", "rare"]
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    measured_rows = stage(rows.mapInArrow(measured, schema), "frequencies")
    shared.arrow.destroy()
    rare = measured_rows.select("uid", F.inline("rare")).join(pieces.filter(~in_head).select("token", "pieces"), "token")
    of_rare = rare.groupBy("uid").agg(F.sum(F.col("n") * F.col("pieces")).alias("more"))
    counted = measured_rows.join(of_rare, "uid", "left").withColumn(
        "n_tokens", F.col("known") + F.coalesce("more", F.lit(0).cast("bigint"))
    )
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _one(column: pa.ChunkedArray, kind: pa.DataType) -> pa.Array:
    own = column.combine_chunks()
    return own if isinstance(own, pa.Array) else pa.concat_arrays(own.chunks) if own.num_chunks else pa.array([], kind)


T.ship_by_value(__name__)
