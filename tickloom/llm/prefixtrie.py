"""Conversation prefix trie: one row per distinct prefix, with totals of all below it.

Conversations start with turns they share (``rebuilt``), and a node of the trie is a distinct
sequence of first turns. It is named by its least member and its depth. A prefix is found by
running sums of 128 bits of hashes of (place, turn), cut into slices, so a long conversation
is never one task's.

Totals below a node are rolled up by centroid decomposition of the forest of parent edges. A
component gives its total to the nodes on the way from its centroid up to its top, then is split
at the centroid, and so on; a node is on at most ``log2`` of the component's size such ways, so
depth does not matter. Components larger than ``PIECE`` are first split at many nodes at once:
of all nodes with more than ``PIECE`` nodes below, those where such nodes branch, end, or where
the number below passes a multiple of ``PIECE``. At most ``5 n / PIECE`` nodes are split off, and
no rest is larger than ``PIECE``. The split nodes, weighted with the component totals under them,
form a trie of their own that is rolled up first, by the same function; then every
component is one task's work in bounded memory.

The number of nodes below a node needs no rollup: a conversation owns the nodes of which it
is the least member, and every member of a node brings what it owns from that depth on.

Joins of turns with their nodes are left to adaptive skew splitting: the turns of a popular
node are many, the node is one row.

Defined results: turns are ordered by ``turn`` (null first), then role, then the first 64 characters
of the text, then its digest; null role and text are empty; repeated rows are turns of their own; turns without ``conv_id`` take no part; an
empty table has no root. Other columns are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.axis import Axis, running
from tickloom.operators.ranks import PID, ranged
from tickloom.session import durable

#: Conversations per shared start; turns a start may have at most.
FAMILY, STARTS = 100, 6
#: Nodes of a component that one task takes.
PIECE = 20_000
#: Turns of one conversation in a slice; ids in one text of ids.
SLICE, IDS = 4_096, 4_096
_NODE = ["rep", "depth"]
_LANES = ["_h1", "_h2", "_h3", "_h4"]


def shared_turns(conv: Column) -> Column:
    """How many turns a conversation takes from the first of its family."""
    return F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(STARTS))


def numbered(turns: DataFrame) -> DataFrame:
    """``conv_id, idx, key, chars``: turns numbered from 0, texts as digests.

    A global sort, so that no conversation is one task's; the numbers come from the counts of
    the ranges before.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    narrow = turns.filter(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", role.alias("role"), F.md5(text.cast("binary")).alias("digest"),
        F.md5(F.concat(F.length(role), F.lit(":"), role, text).cast("binary")).alias("key"),
        F.length(text).cast("bigint").alias("chars"), F.substring(text, 1, 64).alias("start"),
        F.monotonically_increasing_id().alias("row"),
    )
    # The row number only spreads repeated rows over ranges; their order does not matter.
    order = ["conv_id", "turn", "role", "start", "digest", "row"]
    placed = ranged(narrow, order)
    inside = Window.partitionBy(PID, "conv_id").orderBy(*order[1:])
    counts = placed.groupBy("conv_id", PID).agg(F.count(F.lit(1)).alias("_c"))
    # A row per conversation and range: more than one only where a range ends inside it.
    before = Window.partitionBy("conv_id").orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("conv_id", PID, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_first"))
    rows = placed.withColumn("_i", F.row_number().over(inside) - 1).join(starts, ["conv_id", PID])
    return rows.select("conv_id", (F.col("_first") + F.col("_i")).alias("idx"), "key", "chars")


def rebuilt(turns: DataFrame, family: int = FAMILY) -> tuple[DataFrame, DataFrame]:
    """Conversations with the shared start of their family.

    Returns turns ``conv_id, depth, key, chars``, the depth counted from 1, and conversations
    ``conv_id, length``.
    """
    own = durable(numbered(turns))
    convs = own.groupBy("conv_id").agg((F.max("idx") + 1).alias("turns")).select(
        "conv_id", "turns", shared_turns(F.col("conv_id")).alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base")
    )
    heads = own.filter(F.col("idx") < STARTS - 1).filter(F.col("conv_id") % family == 0)
    size = heads.groupBy(F.col("conv_id").alias("base")).agg(F.count(F.lit(1)).alias("has"))
    convs = durable(convs.join(size, "base", "left").withColumn("taken", F.least("h", F.coalesce("has", F.lit(0)))))
    # at most five turns for each conversation, from one of a hundred
    taken = convs.join(heads.withColumnRenamed("conv_id", "base"), "base").filter("idx < h").select(
        "conv_id", (F.col("idx") + 1).alias("depth"), "key", "chars"
    )
    rest = own.join(convs.select("conv_id", "h", "taken"), "conv_id").filter("idx >= h").select(
        "conv_id", (F.col("idx") - F.col("h") + F.col("taken") + 1).alias("depth"), "key", "chars"
    )
    left = F.greatest(F.col("turns") - F.col("h"), F.lit(0))
    return taken.unionByName(rest), convs.select("conv_id", (F.col("taken") + left).alias("length"))


def _prefixes(turns: DataFrame, width: int) -> DataFrame:
    """``turns`` with the four sums that name the prefix ending there."""
    one, two = F.xxhash64("depth", "key"), F.xxhash64("key", F.lit(7), "depth")
    low = F.lit(0xFFFFFFFF)
    parts = [one.bitwiseAND(low), F.shiftrightunsigned(one, 32), two.bitwiseAND(low), F.shiftrightunsigned(two, 32)]
    axis = Axis(("conv_id",), ("depth",), width)
    rows = turns.select("conv_id", "depth", "chars", *[p.alias(f"_p{n}") for n, p in enumerate(parts)])
    sums = {name: F.col(f"_p{n}") for n, name in enumerate(_LANES)}
    return running(rows, axis, sums=sums).select("conv_id", "depth", "chars", *_LANES)


def paths(turns: DataFrame, width: int = SLICE) -> DataFrame:
    """``conv_id, depth, chars, rep, n_convs``: the node of each prefix of each conversation."""
    rows = durable(_prefixes(turns, width))
    nodes = rows.groupBy("depth", *_LANES).agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("n_convs"))
    return rows.join(nodes, ["depth", *_LANES]).select("conv_id", "depth", "chars", "rep", "n_convs")


# --- rollup ----------------------------------------------------------------
def decompose(parents: list[int], values: list[list[int]]) -> list[list[int]]:
    """Totals of each node's subtree, for several values, by centroid decomposition.

    ``parents`` are places in the list, -1 for the top of a component.
    """
    n = len(parents)
    children: list[list[int]] = [[] for _ in range(n)]
    tops = []
    for node, parent in enumerate(parents):
        if parent < 0:
            tops.append(node)
        else:
            children[parent].append(node)
    totals = [[0] * n for _ in values]
    gone, size = [False] * n, [0] * n
    while tops:
        top = tops.pop()
        order = [top]
        for node in order:
            order += [c for c in children[node] if not gone[c]]
        for node in reversed(order):
            size[node] = 1 + sum(size[c] for c in children[node] if not gone[c])
        # down to the last node with more than half of the component
        centroid, half = top, len(order) // 2
        while (deeper := next((c for c in children[centroid] if not gone[c] and size[c] > half), None)) is not None:
            centroid = deeper
        below = [centroid]
        for node in below:
            below += [c for c in children[node] if not gone[c]]
        parts = [sum([value[node] for node in below]) for value in values]
        node = centroid
        while True:
            for total, part in zip(totals, parts):
                total[node] += part
            if node == top:
                break
            node = parents[node]
        gone[centroid] = True
        tops += [c for c in children[centroid] if not gone[c]]
        if centroid != top:
            tops.append(top)
    return totals


def _roll_pieces(nodes: DataFrame, values: list[str]) -> DataFrame:
    """``rep, depth`` and totals inside the components of ``nodes``.

    ``nodes``: ``rep, depth, up`` (the parent's ``rep``, in the component or not), ``piece``
    (``piece_rep, piece_depth``) and values. A component fits one task and is in one; tasks take
    one after the other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, ...]] = []

        def flush() -> pa.RecordBatch:
            columns = [list(c) for c in zip(*held)]
            at = {node: i for i, node in enumerate(zip(columns[2], columns[3]))}
            above = [at.get((up, up_depth), -1) for up, up_depth in zip(columns[4], columns[5])]
            found = decompose(above, columns[6:])
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (columns[2], columns[3], *found)], [*_NODE, *values]
            )

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][:2] != row[:2]:
                    yield flush()
                    held = []
                held.append(row)
        if held:
            yield flush()

    key = ["piece_rep", "piece_depth"]
    schema = ", ".join(f"{c} bigint" for c in (*_NODE, *values))
    return nodes.select(*key, *_NODE, "up", "up_depth", *values).repartition(*key).sortWithinPartitions(*key).mapInArrow(run, schema)


def _with_parent(rows: DataFrame, *columns: str) -> DataFrame:
    """Each node once, with ``up``: the ``rep`` of its parent, null at depth 1."""
    above = rows.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("rep").alias("up"))
    return rows.filter(F.col("rep") == F.col("conv_id")).join(above, ["conv_id", "depth"], "left").select(*_NODE, "up", *columns)


def rollup(rows: DataFrame, values: list[str], piece: int = PIECE, width: int = SLICE) -> DataFrame:
    """``rep, depth`` and the totals of ``values`` in the subtree of each node.

    ``rows`` has a row for every member of every node: ``conv_id, depth, rep``, the depth
    counted from 1 without gaps along a conversation, and the node's ``values``. The nodes at
    depth 1 are tops of trees of their own.
    """
    rows = durable(rows.select("conv_id", *_NODE, *values))
    mine = F.col("rep") == F.col("conv_id")
    ups = durable(_with_parent(rows, *values).withColumn("up_depth", F.col("depth") - 1))
    if ups.count() <= piece:
        # one component holds all: no split
        return _roll_pieces(ups.withColumns({"piece_rep": F.lit(0), "piece_depth": F.lit(0)}), values)

    # nodes below: every member brings what it owns from here on
    last = Axis(("conv_id",), ("_back",), width)
    owned = running(rows.withColumn("_back", -F.col("depth")), last, sums={"_own": mine.cast("int")})
    heavy = durable(owned.groupBy(*_NODE).agg(F.sum("_own").alias("_size")).filter(F.col("_size") > piece))
    below = ups.join(heavy, _NODE).groupBy(F.col("up").alias("rep"), F.col("up_depth").alias("depth")).agg(
        F.count(F.lit(1)).alias("_kids"), F.max("_size").alias("_most")
    )
    passes = F.floor(F.col("_size") / piece) != F.floor(F.col("_most") / piece)
    split = durable(heavy.join(below, _NODE, "left").filter(
        F.col("_kids").isNull() | (F.col("_kids") > 1) | passes
    ).select(*_NODE, F.lit(1).alias("_split")))

    # the component of a node begins below the last split node above it
    marked = rows.join(split, _NODE, "left").withColumn("_split", F.coalesce("_split", F.lit(0)))
    here = F.when(F.col("_split") == 1, F.struct("rep", "depth"))
    axis = Axis(("conv_id",), ("depth",), width)
    seen = running(marked, axis, before={"_above": here, "_was": F.col("_split")}, sums={"_place": F.col("_split")})
    first = F.coalesce("_was", F.lit(1)) == 1
    # a node whose parent is split, or that has none, is the top of its component
    seen = durable(running(seen, axis, lasts={"_top": F.when(first, F.struct("rep", "depth"))}).select(
        "conv_id", *_NODE, "_split", "_above", "_place", "_top", *values
    ))
    nodes = seen.filter(mine)
    rest = nodes.filter("_split = 0")
    weights = [F.sum(v).alias(v) for v in values]
    # what hangs directly below a split node: whole components, without the split nodes in them
    hangs = rest.filter(F.col("_above").isNotNull()).groupBy(
        F.col("_above.rep").alias("rep"), F.col("_above.depth").alias("depth")).agg(*weights)
    inner = nodes.filter("_split = 1").select(*_NODE, *values).unionByName(hangs).groupBy(*_NODE).agg(*weights)
    upper = seen.filter("_split = 1").select("conv_id", F.col("depth").alias("_at"), "rep", F.col("_place").alias("depth"))
    weighed = upper.join(inner.withColumnRenamed("depth", "_at"), ["rep", "_at"]).drop("_at")
    whole = rollup(weighed, values, piece, width)
    # back to the depths of this trie
    names = nodes.filter("_split = 1").select("rep", F.col("_place").alias("_p"), "depth", "_above", "_top")
    whole = durable(whole.withColumnRenamed("depth", "_p").join(names, ["rep", "_p"]))
    # a split node that is not the top of its component gives its total to its parent there
    given = whole.filter((F.col("_top.rep") != F.col("rep")) | (F.col("_top.depth") != F.col("depth"))).select(
        *_NODE, *values
    ).join(ups.select(*_NODE, "up", "up_depth"), _NODE).groupBy(
        F.col("up").alias("rep"), F.col("up_depth").alias("depth")).agg(*[F.sum(v).alias(f"_in_{v}") for v in values])
    pieces = rest.select(
        *_NODE, F.col("_top.rep").alias("piece_rep"), F.col("_top.depth").alias("piece_depth"), *values
    ).join(given, _NODE, "left").join(ups.select(*_NODE, "up", "up_depth"), _NODE)
    pieces = pieces.withColumns({v: F.col(v) + F.coalesce(f"_in_{v}", F.lit(0)) for v in values})
    return whole.select(*_NODE, *values).unionByName(_roll_pieces(pieces, values))


# --- digests ---------------------------------------------------------------
def _id_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ``rep, depth, conv_id`` to comma-joined texts of at most ``IDS`` ids of a node."""
    names = ["rep", "depth", "first", "ids"]
    out: list[tuple[int, int, int, str]] = []
    node, ids = None, []
    for batch in batches:
        for rep, depth, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if (rep, depth) != node or len(ids) == IDS:
                if ids:
                    out.append((*node, ids[0], ",".join(map(str, ids))))
                node, ids = (rep, depth), []
            ids.append(conv)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names) if out else _none(names)
        out = []
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*node, ids[0], ",".join(map(str, ids)))], names)


def _none(names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([], k) for k in kinds], names)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of a node in order to one digest, a text at a time."""
    node, state = None, None
    for batch in batches:
        out: list[tuple[int, int, str]] = []
        for rep, depth, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if (rep, depth) != node:
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = (rep, depth), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        kinds = (pa.int64(), pa.int64(), pa.string())
        columns = list(zip(*out)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["rep", "depth", "ends_sha256"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*node, state.hexdigest())], ["rep", "depth", "ends_sha256"])


def ends(rows: DataFrame) -> DataFrame:
    """``rep, depth, ends_sha256`` from ``rep, depth, conv_id`` of the last turns.

    Ids are joined in ranges, in many tasks; a digest then takes a text of ids at a time.
    """
    order = [*_NODE, "conv_id"]
    texts = rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _id_texts, "rep bigint, depth bigint, first bigint, ids string")
    return texts.repartition(*_NODE).sortWithinPartitions(*_NODE, "first").mapInArrow(
        _digest, "rep bigint, depth bigint, ends_sha256 string")


SCHEMA = (
    "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
    "saved_tokens bigint, ends_sha256 string"
)


def trie(turns: DataFrame, piece: int = PIECE, width: int = SLICE, family: int = FAMILY) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``. ``turns``: ``conv_id, turn, role, text``."""
    grown, convs = rebuilt(turns, family)
    convs = durable(convs)
    top = convs.agg(F.min("conv_id").alias("first"), F.count(F.lit(1)).alias("n")).first()
    if not top["n"]:
        return turns.sparkSession.createDataFrame([], SCHEMA)
    root = [F.lit(top["first"]).cast("bigint").alias("rep"), F.lit(0).cast("bigint").alias("depth")]
    rows = durable(paths(grown, width))
    nodes = durable(_with_parent(rows, "n_convs", "chars"))
    kids = nodes.filter("depth > 1").groupBy(F.col("up").alias("rep"), (F.col("depth") - 1).alias("depth")).agg(
        F.count(F.lit(1)).alias("n_children"))
    full = durable(nodes.join(kids, _NODE, "left").select(
        *_NODE, F.coalesce("up", root[0]).alias("up"), "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("bigint").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"),
    ))
    values = ["n_leaves", "saved_tokens"]
    members = rows.select("conv_id", *_NODE).join(full.select(*_NODE, *values), _NODE)
    totals = durable(rollup(members, values, piece, width))
    whole = totals.filter("depth = 1").agg(
        F.count(F.lit(1)).alias("n_children"), F.coalesce(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"),
        F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"),
    ).select(*root, F.lit(None).cast("bigint").alias("up"), F.lit(top["n"]).alias("n_convs"), "n_children", *values)
    last = convs.select("conv_id", F.col("length").alias("depth"))
    ended = last.join(rows.select("conv_id", *_NODE), ["conv_id", "depth"]).select(*_NODE, "conv_id")
    ended = ended.unionByName(last.filter("depth = 0").select(*root, "conv_id"))
    every = full.drop(*values).join(totals, _NODE).unionByName(whole)
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return every.join(ends(ended), _NODE, "left").select(
        F.col("rep").alias("conv_id"), "depth", F.col("up").alias("parent_conv_id"), "n_convs", "n_children", *values,
        F.coalesce("ends_sha256", empty).alias("ends_sha256"),
    )
