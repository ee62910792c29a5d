"""The prefix trie of conversations, rolled up by centroid decomposition.

A node is a distinct sequence of first turns (role, text); its members are the conversations
that begin with it. Turns go by the SHA-256 of role and text. The name of a sequence is a sum,
lane by lane, of SHA-256 values of its turns at their places, so names come from running sums
and a conversation of any length is spread over tasks. Equal names are equal sequences but for
a chance of about 2**-190 per pair.

Sums over subtrees: a component of the forest of parent edges is split at its centroid, the
deepest node whose subtree (within the component) holds more than half of it. The nodes that
hold more than half are the way from the centroid up to the component's top, so the total of
the centroid's subtree is added to them; then the subtrees of the centroid's children and what
lies above become components. Large components are split by Spark, each round at once for all;
components of at most ``BOUND`` nodes are split to the end where they are. What the first
sizes need is no traversal: the nodes that a conversation is the least member of are always
the last ones of its way.

Nulls, ties and odd tables: a null role or text is an empty one. A null turn comes first; rows
of equal turn are ordered by role, then by the SHA-256 of their text; repeated rows stay, one
turn each. Rows without ``conv_id`` belong to no conversation and are left out. An empty
table gives no nodes. Other columns are ignored. Texts are only hashed and counted, so a very
long one costs its own bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retenta.llm import text as T
from retenta.llm.exprs import WORD_CHAR
from retenta.operators.prefix_sums import running_sums
from retenta.session import stage

#: Nodes of a component that one task splits to the end.
BOUND = 5_000
#: Rows of fixed width up to which a table of a round is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 100_000
#: Ids that one row holds on their way to a digest.
IDS_PER_ROW = 4_096
LANES = 6
ROOT = bytes(4 * LANES)


def ordered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, n_words) with positions from 1 in each conversation."""
    role, text = (F.coalesce(F.col(name).cast("string"), F.lit("")) for name in ("role", "text"))
    rows = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        role.alias("role"),
        F.sha2(F.concat_ws(":", F.char_length(role).cast("string"), role, text), 256).alias("digest"),
        F.regexp_count(text, F.lit(WORD_CHAR + "+")).cast("bigint").alias("n_words"),
    )
    # Repeated rows are one row on the way, however many there are.
    counted = rows.groupBy("conv_id", "turn", "role", "digest", "n_words").agg(F.count("*").alias("copies"))
    placed = running_sums(counted, ["conv_id"], ["turn", "role", "digest"], ["copies"])
    first, last = F.col("copies_upto") - F.col("copies") + 1, F.col("copies_upto")
    runs = placed.select("conv_id", "digest", "n_words", "copies_upto", F.explode(F.sequence(first, last, F.lit(4096))).alias("low"))
    high = F.least(F.col("low") + 4095, F.col("copies_upto"))
    return runs.select("conv_id", F.explode(F.sequence("low", high)).alias("pos"), "digest", "n_words")


def lengths_of(ordered: DataFrame) -> DataFrame:
    return ordered.groupBy("conv_id").agg(F.max("pos").alias("length"))


def with_shared_heads(
    ordered: DataFrame, base: Callable[[Column], Column], shared: Callable[[Column], Column], most: int
) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first ``shared`` (at most ``most``) turns of conversation ``base`` in
    place of their own first turns; and their lengths. Turns that the base lacks are missing."""
    own = stage(lengths_of(ordered), "lengths")
    bases = own.select(F.col("conv_id").alias("base"), F.col("length").alias("base_length"))
    convs = own.withColumns({"base": base(F.col("conv_id")), "shared": shared(F.col("conv_id")).cast("bigint")})
    taken = F.least("shared", F.coalesce("base_length", F.lit(0).cast("bigint")))
    convs = convs.join(bases, "base", "left").select(
        "conv_id", "base", "shared", taken.alias("taken"), (taken + F.greatest(F.col("length") - F.col("shared"), F.lit(0))).alias("length")
    )
    convs = stage(convs, "conversations")
    tails = ordered.filter(F.col("pos") > shared(F.col("conv_id"))).join(convs.select("conv_id", "shared", "taken"), "conv_id")
    tails = tails.select("conv_id", (F.col("pos") - F.col("shared") + F.col("taken")).alias("depth"), "digest", "n_words")
    heads = ordered.filter((F.col("pos") <= most) & (F.col("conv_id") == base(F.col("conv_id")))).withColumnRenamed("conv_id", "base")
    heads = heads.join(convs, "base").filter(F.col("pos") <= F.col("shared"))
    return tails.unionByName(heads.select("conv_id", F.col("pos").alias("depth"), "digest", "n_words")), convs.select("conv_id", "length")


def named_ways(sequences: DataFrame) -> DataFrame:
    """(conv_id, depth, node, parent, n_words): the node of every first part of every conversation."""
    term = F.sha2(F.concat_ws(":", F.col("depth").cast("string"), "digest"), 256)
    hashed = sequences.select("conv_id", "depth", "n_words", term.alias("term"))
    lanes = [f"lane{k}" for k in range(LANES)]
    parts = [F.conv(F.substring("term", 1 + 8 * k, 8), 16, 10).cast("bigint").alias(lane) for k, lane in enumerate(lanes)]
    summed = running_sums(hashed.select("conv_id", "depth", "n_words", *parts), ["conv_id"], ["depth"], lanes)

    def name(sums: list[Column]) -> Column:
        return F.unhex(F.concat(*[F.lpad(F.hex(s.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0") for s in sums]))

    upto = [F.col(f"{lane}_upto") for lane in lanes]
    before = [total - F.col(lane) for total, lane in zip(upto, lanes)]
    parent = F.when(F.col("depth") == 1, F.lit(ROOT)).otherwise(name(before))
    return summed.select("conv_id", "depth", name(upto).alias("node"), parent.alias("parent"), "n_words")


def _small(table: DataFrame) -> DataFrame:
    """A written table of a round, broadcast if it is counted to be small."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def split_component(parents: list[int], sizes: list[int], values: np.ndarray) -> np.ndarray:
    """Subtree sums of the rows of ``values`` in one component, by centroids. Nodes come top first, parents before children."""
    sums, pending = np.zeros_like(values), [list(range(len(parents)))]
    while pending:
        nodes = pending.pop()
        half = sizes[nodes[0]]
        way = [v for v in nodes if 2 * sizes[v] > half]
        centroid = way[-1]
        child_of: dict[int, int] = {}
        below: dict[int, list[int]] = {}
        above = []
        for v in nodes:
            if v == centroid:
                continue
            top = v if parents[v] == centroid else child_of.get(parents[v])
            if top is None:
                above.append(v)
            else:
                child_of[v] = top
                below.setdefault(top, []).append(v)
        total = values[centroid] + sum(values[part].sum(axis=0) for part in below.values())
        for v in way:
            sums[v] += total
        for v in way[:-1]:
            sizes[v] -= sizes[centroid]
        pending += [part for part in (*below.values(), above) if part]
    return sums


def _split_small(components: DataFrame, values: list[str]) -> DataFrame:
    """Subtree sums within components that are small enough for a task, (node, values)."""

    def split(rows: list[tuple]) -> pa.RecordBatch:
        nodes, sums = [], []
        for _, own in groupby(rows, key=lambda row: row[0]):
            _, _, node, parent, size, *value = zip(*own)
            at = {v: k for k, v in enumerate(node)}
            sums.append(split_component([at.get(p, -1) for p in parent], list(size), np.array(value, np.int64).T))
            nodes += node
        whole = np.concatenate(sums)
        columns = [pa.array(nodes, pa.binary()), *(pa.array(whole[:, k]) for k in range(whole.shape[1]))]
        return pa.RecordBatch.from_arrays(columns, names=["node", *values])

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            held += zip(*(column.to_pylist() for column in batch.columns))
            # The last component may go on in the next batch.
            last = next((k for k in range(len(held) - 1, 0, -1) if held[k - 1][0] != held[-1][0]), 0)
            if last:
                yield split(held[:last])
                held = held[last:]
        if held:
            yield split(held)

    rows = components.select("comp", "depth", "node", "parent", "size", *values)
    rows = rows.repartition("comp").sortWithinPartitions("comp", "depth")
    return rows.mapInArrow(run, "node binary, " + ", ".join(f"{name} bigint" for name in values))


def rollup(nodes: DataFrame, ways: DataFrame, values: list[str], bound: int = BOUND) -> DataFrame:
    """(node, values): sums of ``values`` over the subtree of every node, by centroid decomposition.

    ``nodes`` are one tree: node, parent (null for its top), depth, size of the subtree, and ``rep``, a
    conversation whose way passes the node; ``ways`` are the rows of :func:`named_ways`.
    """
    columns = ["node", "parent", "rep", "depth", "size", *values]
    whole = nodes.filter(F.col("parent").isNull()).select(F.col("node").alias("comp"), F.col("size").alias("total"))
    state = stage(nodes.select(*columns).crossJoin(F.broadcast(whole)), "components")  # the top is one row
    small, gains = [], []
    while True:
        small.append(state.filter(F.col("comp").isNotNull() & (F.col("total") <= bound)))
        large = state.filter(F.col("comp").isNotNull() & (F.col("total") > bound))
        if large.isEmpty():
            break
        on_way = 2 * F.col("size") > F.col("total")
        least = large.filter(on_way).groupBy("comp").agg(F.min(F.struct("size", "node", "depth")).alias("c"))
        centroids = stage(least.select("comp", *[F.col(f"c.{name}").alias(f"c_{name}") for name in ("size", "node", "depth")]), "centroids")
        children = large.join(_small(centroids), (large["parent"] == centroids["c_node"]) & (large["comp"] == centroids["comp"]))
        kids = stage(children.select(large["comp"], F.col("node").alias("kid"), F.col("size").alias("kid_size")), "children")
        through = ways.join(_small(kids), ways["node"] == kids["kid"])
        through = stage(through.select(F.col("conv_id").alias("rep"), "comp", "kid", "kid_size"), "through")
        marked = large.join(_small(centroids), "comp").join(_small(through), ["rep", "comp"], "left")
        is_c, below = F.col("node") == F.col("c_node"), F.col("kid").isNotNull() & (F.col("depth") > F.col("c_depth"))
        moved = marked.select(
            "node", "parent", "rep", "depth", *values,
            F.when(on_way & ~is_c, F.col("size") - F.col("c_size")).otherwise(F.col("size")).alias("size"),
            F.when(is_c, F.lit(None)).when(below, F.col("kid")).otherwise(F.col("comp")).alias("comp"),
            F.when(below, F.col("kid_size")).otherwise(F.col("total") - F.col("c_size")).alias("total"),
            F.col("comp").alias("was"), on_way.alias("on_way"), (is_c | below).alias("under"),
        )
        state = stage(moved, "components")
        totals = state.filter("under").groupBy("was").agg(*[F.sum(name).alias(name) for name in values])
        totals = stage(totals, "totals")
        gains.append(state.filter("on_way").select("node", "was").join(_small(totals), "was").select("node", *values))
    sums = _split_small(_union(small), values)
    if not gains:
        return sums
    return _union([*gains, sums]).groupBy("node").agg(*[F.sum(name).alias(name) for name in values])


def _union(frames: list[DataFrame]) -> DataFrame:
    names = set.intersection(*(set(frame.columns) for frame in frames))
    total = frames[0].select(*sorted(names))
    for frame in frames[1:]:
        total = total.unionByName(frame.select(*sorted(names)))
    return total


def id_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): the SHA-256 of a node's ids in ascending order, joined by commas.

    Ids are dealt out by ranges and joined there, so that a node with many has a few long rows; these are
    hashed one after another, and nothing is held but the state of a hash.
    """

    def joined(batches):
        def out(node: bytes, ids: list[int]) -> tuple:
            return node, ids[0], ",".join(map(str, ids)).encode()

        held: tuple[bytes, list[int]] | None = None
        for batch in batches:
            rows = []
            for node, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and held[0] == node and len(held[1]) < IDS_PER_ROW:
                    held[1].append(own)
                else:
                    if held:
                        rows.append(out(*held))
                    held = node, [own]
            if rows:
                yield batch_of(rows)
        if held:
            yield batch_of([out(*held)])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.binary(), pa.int64(), pa.binary()))]
        return pa.RecordBatch.from_arrays(columns, names=["node", "low", "ids"])

    def hashed(batches):
        def out(node: bytes, state) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])

        last = None
        for batch in batches:
            done = []
            for node, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if last and last[0] == node:
                    last[1].update(b"," + ids)
                else:
                    if last:
                        done.append(out(*last))
                    last = node, hashlib.sha256(ids)
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if last:
            yield out(*last)

    runs = ends.select("node", "conv_id").repartitionByRange("conv_id").sortWithinPartitions("node", "conv_id")
    runs = runs.mapInArrow(joined, "node binary, low bigint, ids binary")
    return runs.repartition("node").sortWithinPartitions("node", "low").mapInArrow(hashed, "node binary, ends_sha256 string")


def prefix_nodes(sequences: DataFrame, lengths: DataFrame, bound: int = BOUND) -> DataFrame:
    """One row per node of the trie of ``sequences`` (conv_id, depth, digest, n_words); ``lengths`` has every
    conversation, those without turns too."""
    ways = stage(named_ways(sequences), "ways")
    lengths = stage(lengths.select("conv_id", "length"), "lengths")
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = root.select(
        F.lit(ROOT).alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("bigint").alias("depth"),
        F.lit(0).cast("bigint").alias("n_words"), "conv_id", "n_convs",
    )
    inner = ways.groupBy("node", "parent", "depth", "n_words").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    nodes = stage(root.unionByName(inner), "nodes")
    # A conversation is the least member of the last nodes of its way: of this many.
    new = nodes.filter("depth > 0").groupBy("conv_id").agg(F.count("*").alias("n_new"))
    known = lengths.join(new, "conv_id", "left").select(
        "conv_id", "length", (F.col("length") - F.coalesce("n_new", F.lit(0).cast("bigint"))).alias("n_known")
    )
    held = ways.join(known, "conv_id").select(
        "node", (F.col("length") - F.greatest(F.col("depth") - 1, F.col("n_known"))).alias("held")
    )
    all_new = known.agg(F.sum(F.col("length") - F.col("n_known")) + 1).select(F.lit(ROOT).alias("node"), F.col("*")).toDF("node", "size")
    sizes = held.groupBy("node").agg(F.sum("held").alias("size")).unionByName(all_new)
    children = nodes.filter("depth > 0").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    full = stage(
        nodes.join(sizes, "node").join(children, "node", "left").select(
            *nodes.columns, "size", F.coalesce("n_children", F.lit(0).cast("bigint")).alias("n_children")
        ),
        "nodes",
    )
    valued = full.withColumns(
        {
            "rep": F.col("conv_id"),
            "n_leaves": (F.col("n_children") == 0).cast("bigint"),
            "saved_tokens": (F.col("n_convs") - 1) * F.col("n_words"),
        }
    )
    sums = rollup(valued, ways, ["n_leaves", "saved_tokens"], bound)
    last = ways.join(lengths, (ways["conv_id"] == lengths["conv_id"]) & (F.col("depth") == F.col("length")))
    ends = last.select("node", ways["conv_id"]).unionByName(
        lengths.filter("length = 0").select(F.lit(ROOT).alias("node"), "conv_id")
    )
    parents = full.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    none = hashlib.sha256(b"").hexdigest()
    return (
        full.join(sums, "node")
        .join(id_digests(ends), "node", "left")
        .join(parents, "parent", "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
        )
    )


def conversation_trie(turns: DataFrame, bound: int = BOUND) -> DataFrame:
    """The trie of conversations as they are."""
    ordered = stage(ordered_turns(turns), "turns")
    return prefix_nodes(ordered.withColumnRenamed("pos", "depth"), lengths_of(ordered), bound)


def shared_head_trie(turns: DataFrame, block: int = 20, heads: int = 4, bound: int = BOUND) -> DataFrame:
    """The trie of conversations whose first ``crc32(id) % heads`` turns are those of the first id of their block."""
    ordered = stage(ordered_turns(turns), "turns")
    base = lambda c: c - c % block
    shared = lambda c: F.crc32(c.cast("string").cast("binary")) % heads
    return prefix_nodes(*with_shared_heads(ordered, base, shared, heads - 1), bound)


T.ship_by_value(__name__)
