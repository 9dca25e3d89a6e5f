"""The prefix trie of conversations, without walking it: each node belongs to the smallest conversation that passes it.

A conversation that is the smallest at one depth is so at all depths below, so its own nodes are one chain, from its first
owned depth to its last turn. That depth is searched for all conversations at once, bit by bit: a round probes one depth a
conversation by a join with the minima of prefix digests, and reads only prefixes of depths with as many trailing zeros,
so all rounds together read every prefix once. The node above a chain belongs to another one: chains form a tree, whose
sums are taken from below by doubling pointers, and sums along a chain by blocks of it. No conversation, prefix or chain,
however long or often met, is held in one task.

A prefix digest is the exclusive or of 64-bit pairs made of each turn's SHA-256 and its depth (128 bits).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import hot_join, new_dir, released, written

#: Depths of a chain or conversation that one window sums over.
BLOCK = 1024
SCHEMA = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def numbered(turns: DataFrame) -> DataFrame:
    """conv, pos (from 1), a, b (halves of 128 bits of the turn's SHA-256), size (bytes of the text) of every turn; rows of null conv_id are left out.

    Turns are in the order of turn (null first), then role and text; null role and text are empty. Sorted by ranges, so a
    long conversation goes over several tasks; those that do are renumbered, one a task at most. Equal rows are turns each.
    """
    text, role = F.coalesce("text", F.lit("")).alias("text"), F.coalesce("role", F.lit("")).alias("role")
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), "turn", role, text)
    order = ["conv", F.asc_nulls_first("turn"), "role", "text"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column(0).to_numpy()
            at = np.arange(len(conv))
            new = np.concatenate([[last is None or conv[0] != last], conv[1:] != conv[:-1]])
            begun = np.maximum.accumulate(np.where(new, at, -1))
            pos = np.where(begun < 0, n + at, at - begun) + 1
            roles, texts = (batch.column(k).cast(pa.binary()).to_pylist() for k in (2, 3))
            raw = b"".join(hashlib.sha256(b"%d:%b%b" % (len(r), r, t)).digest()[:16] for r, t in zip(roles, texts, strict=True))
            halves = np.frombuffer(raw, "<i8").reshape(-1, 2)
            sizes = pa.array(list(map(len, texts)), pa.int64())
            yield pa.record_batch([batch.column(0), pa.repeat(pa.scalar(part, pa.int32()), len(at)), pa.array(pos), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), sizes], ["conv", "part", "pos", "a", "b", "size"])
            last, n = conv[-1], int(pos[-1])
        released()

    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    made = written(sorted_.mapInArrow(scan, "conv long, part int, pos long, a long, b long, size long"), "turns")
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = made.groupBy("conv", "part").agg(F.max("pos").alias("n")).select("conv", "part", before.alias("shift")).where("shift IS NOT NULL")  # one a task at most
    return made.join(F.broadcast(shifts), ["conv", "part"], "left").select("conv", (F.col("pos") + F.coalesce("shift", F.lit(0))).alias("pos"), "a", "b", "size")


def branched(turns: DataFrame, group: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """(turns, lengths) of conversations rebuilt of numbered ones: the first h turns of the group's first, then one's own after its first h.

    h is the unsigned crc32 of the decimal conv by heads. lengths (conv, len) has every conversation, also where no turn is left.
    """
    counts = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    own = counts.select("conv", "n", (F.crc32(F.col("conv").cast("string").cast("binary")) % heads).alias("h"), (F.col("conv") - F.col("conv") % group).alias("base"))
    bases = counts.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    known = written(own.join(bases, "base", "left").withColumn("take", F.least("h", F.coalesce("base_n", F.lit(0)))).drop("base_n"), "conversations")
    total = known.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    rest = hot_join(turns, known.select("conv", "h", "take", "n"), "conv", total).where("pos > h")
    first = turns.where(F.col("pos") < heads).withColumnRenamed("conv", "base")
    shared = known.where("take > 0").select("conv", "base", "take").join(first, "base").where("pos <= take")
    made = rest.select("conv", F.expr("take + pos - h").alias("pos"), "a", "b", "size").unionByName(shared.select("conv", "pos", "a", "b", "size"))
    return made, known.select("conv", F.expr("take + greatest(n - h, 0L)").alias("len"))


def running(df: DataFrame, key: str, pos: str, columns: dict[str, object], upward: bool = False) -> DataFrame:
    """df with each column replaced by its running aggregate within key over pos (upward: from the greatest), taken by blocks of BLOCK positions.

    columns gives the aggregate function, bit_xor or sum, of each name.
    """
    block, order = F.floor(F.col(pos) / BLOCK).alias("block"), F.desc if upward else F.asc
    within = Window.partitionBy(key, "block").orderBy(order(pos)).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy(order("block")).rowsBetween(Window.unboundedPreceding, -1)
    cut = df.withColumn("block", block)
    sums = cut.groupBy(key, "block").agg(*[f(c).alias(c) for c, f in columns.items()])
    carried = sums.select(key, "block", *[f(c).over(before).alias(f"{c}_before") for c, f in columns.items()]).where(" OR ".join(f"{c}_before IS NOT NULL" for c in columns))
    inner = cut.withColumns({c: f(c).over(within) for c, f in columns.items()})
    joined = inner.join(carried, [key, "block"], "left").drop("block")
    both = lambda c, f: F.col(c).bitwiseXOR(F.coalesce(f"{c}_before", F.lit(0))) if f is F.bit_xor else F.col(c) + F.coalesce(f"{c}_before", F.lit(0))
    return joined.withColumns({c: both(c, f) for c, f in columns.items()}).drop(*[f"{c}_before" for c in columns])


def _ends(ends: DataFrame) -> DataFrame:
    """conv, depth, ends: SHA-256 of each node's last members, streamed in order; a hash can't be parted, its memory doesn't grow."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha, out = None, None, []
        for batch in batches:
            for conv, depth, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (conv, depth) == node:
                    sha.update(b",%d" % end)
                else:
                    if node:
                        out.append((*node, sha.hexdigest()))
                    node, sha = (conv, depth), hashlib.sha256(b"%d" % end)
            if out:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], ["conv", "depth", "ends"])
                out = []
        if node:
            yield pa.record_batch([pa.array([node[0]]), pa.array([node[1]]), pa.array([sha.hexdigest()])], ["conv", "depth", "ends"])

    return ends.repartition("conv", "depth").sortWithinPartitions("conv", "depth", "end").mapInArrow(hashed, "conv long, depth long, ends string")


def trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per node (SCHEMA) of conversations given by turns (conv, pos, a, b, size) and lengths (conv, len).

    The root is depth 0 and has every conversation, also one without turns. No conversations, no rows.
    """
    spark = turns.sparkSession
    lengths = written(lengths, "lengths")
    told = lengths.agg(F.min("conv").alias("root"), F.max("len").alias("deepest"), F.sum("len").alias("total"), F.count(F.lit(1)).alias("n")).first()
    if not told["n"]:
        return spark.createDataFrame([], SCHEMA)
    root, total = told["root"], told["total"]
    lanes = {"a": F.xxhash64("pos", "a", "b"), "b": F.xxhash64("b", "a", F.lit(7), "pos")}
    level = F.expr("bit_count((pos & -pos) - 1L)").alias("level")
    path = new_dir(spark, "prefixes")
    running(turns.withColumns(lanes), "conv", "pos", {"a": F.bit_xor, "b": F.bit_xor}).select("conv", "pos", "a", "b", "size", level).write.partitionBy("level").parquet(path)
    prefixes = spark.read.schema("conv long, pos long, a long, b long, size long, level int").parquet(path)
    minima = prefixes.groupBy("level", "pos", "a", "b").agg(F.min("conv").alias("owner"), F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    minima = written(minima.withColumn("k", F.struct("pos", "a", "b")).select("k", "owner", "n", "size", "level"), "minima")

    # last: the deepest depth that another conversation owns, and whose it is there.
    state = lengths.where(F.col("conv") != root).select("conv", "len", F.lit(0).cast("long").alias("last"), F.lit(root).cast("long").alias("above"))
    for bit in reversed(range(int(told["deepest"]).bit_length())):
        probe = state.select("conv", (F.col("last") + (1 << bit)).alias("pos")).join(prefixes.where(F.col("level") == bit), ["conv", "pos"])
        met = hot_join(probe.select("conv", F.struct("pos", "a", "b").alias("k")), minima.where(F.col("level") == bit).select("k", "owner", "n"), "k", total)
        shared = met.where("owner <> conv").select("conv", "owner")
        deeper = F.when(F.col("owner").isNotNull(), F.col("last") + (1 << bit)).otherwise(F.col("last"))
        state = written(state.join(shared, "conv", "left").select("conv", "len", deeper.alias("last"), F.coalesce("owner", "above").alias("above")), "search")
    top = lengths.where(F.col("conv") == root).select("conv", "len", F.lit(-1).cast("long").alias("last"), F.lit(None).cast("long").alias("above"))
    state = state.unionByName(top)
    chains = written(state.where("last < len"), "chains")
    return _nodes(spark, state, chains, minima, root, told["n"], total)


def _nodes(spark, state: DataFrame, chains: DataFrame, minima: DataFrame, root: int, n_convs: int, total: int) -> DataFrame:
    top = spark.createDataFrame([(root, 0, n_convs, 0)], "conv long, depth long, n_convs long, size long")
    nodes = minima.select(F.col("owner").alias("conv"), F.col("k.pos").alias("depth"), F.col("n").alias("n_convs"), "size").unionByName(top)
    hung = chains.where("above IS NOT NULL").select(F.col("above").alias("conv"), F.col("last").alias("depth"), F.col("conv").alias("chain"))
    spent = nodes.groupBy("conv").agg(F.sum(F.expr("(n_convs - 1) * size")).alias("saved"))
    bare = chains.select("conv", F.col("len").alias("depth")).join(hung.select("conv", "depth").distinct(), ["conv", "depth"], "left_anti")  # ends without children
    sums = chains.select("conv", "above").join(spent, "conv").join(bare.select("conv", F.lit(1).cast("long").alias("leaves")), "conv", "left").fillna(0, ["leaves"])
    whole = _subtrees(written(sums, "sums"), total)
    below = hung.join(whole.select(F.col("conv").alias("chain"), "saved", "leaves"), "chain").groupBy("conv", "depth").agg(F.count(F.lit(1)).alias("hung"), F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    ends = _ends(state.select(F.when(F.col("last") < F.col("len"), F.col("conv")).otherwise(F.col("above")).alias("conv"), F.col("len").alias("depth"), F.col("conv").alias("end")))
    facts = [
        nodes.select("conv", "depth", "n_convs", F.expr("(n_convs - 1) * size").alias("saved")),
        below,
        bare.select("conv", "depth", F.lit(1).cast("long").alias("leaves")),
        chains.select("conv", (F.col("last") + 1).alias("depth"), "above", F.lit(True).alias("first")),
        chains.select("conv", F.col("len").alias("depth"), F.lit(True).alias("end")),
        ends,
    ]
    one = facts[0]
    for f in facts[1:]:
        one = one.unionByName(f, allowMissingColumns=True)
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    met = one.groupBy("conv", "depth").agg(F.max("n_convs").alias("n_convs"), zero("saved"), zero("leaves"), zero("hung"), F.max("above").alias("above"), F.max("first").alias("first"), F.max("end").alias("end"), F.max("ends").alias("ends"))
    summed = running(met, "conv", "depth", {"saved": F.sum, "leaves": F.sum}, upward=True)
    parent: Column = F.when(F.coalesce("first", F.lit(False)), F.col("above")).otherwise(F.col("conv"))
    children = F.col("hung") + F.when(F.coalesce("end", F.lit(False)), 0).otherwise(1)
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return summed.select(
        F.col("conv").alias("conv_id"), "depth", parent.alias("parent_conv_id"), "n_convs", children.cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", none).alias("ends_sha256"),
    )


def _subtrees(sums: DataFrame, total: int) -> DataFrame:
    """conv, saved, leaves summed over each chain's subtree: a round adds what points at a chain and doubles the pointers' reach."""
    while sums.where("above IS NOT NULL").limit(1).count():
        added = sums.where("above IS NOT NULL").groupBy("above").agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"), F.count(F.lit(1)).alias("n"))
        met = written(sums.join(added.withColumnRenamed("above", "conv"), "conv", "left"), "added")
        onward = met.where("n IS NOT NULL").select(F.col("conv").alias("above"), F.col("above").alias("next"), "n")
        grown = met.select("conv", "above", (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"))
        pointing = hot_join(grown.where("above IS NOT NULL"), onward, "above", total).select("conv", F.col("next").alias("above"), "saved", "leaves")
        sums = written(pointing.unionByName(grown.where("above IS NULL").select("conv", "above", "saved", "leaves")), "sums")
    return sums


def conversation_trie(turns: DataFrame, group: int = 5, heads: int = 9) -> DataFrame:
    """The trie (SCHEMA) of the conversations of turns (conv_id, turn, role, text) after `branched` has rebuilt them.

    Null conv_id: left out. Null turn: first. Null role or text: empty. Ties of turn: by role, then text; repeated rows are
    turns each. Empty table: no rows. Other columns are not read.
    """
    return trie(*branched(numbered(turns), group, heads))
