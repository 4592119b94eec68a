"""Merkle manifest of a dataset by time-forward processing.

Every row is a leaf, leaves of one group stand in order of their key, and pairs of
consecutive nodes become parents until one is left: the group's subroot. Subroots, in
order of their groups, are joined into the root in the same way.

Time-forward processing visits nodes in the order of their labels and hands each digest to
the parent as a message that a priority queue keeps until the parent's turn. The queue is
external: a message is a row that carries its receiver's label, and a shuffle sorted by
label, which spills to disk, delivers it. One round covers BLOCK_LEVELS levels: a block of
consecutive nodes goes through a small queue in memory, and what leaves a block is one
message to the next round. So N leaves take about log2(N) / BLOCK_LEVELS rounds, no task
holds more than one block of nodes, and a group that holds most rows is many blocks. The
reversed sweep visits the same labels in falling order; a node hands each child its
sibling's digest and its own path to the root, until every leaf has its proof.

Defined results: a digest is the lowercase hex SHA-256 of its inputs, one after another; a
field is `-` if null, else its UTF-8 byte count, `:` and its value; the null group comes
first, null keys come first, rows with equal keys are ordered by digest, and identical rows
are interchangeable; a lone leaf is its own subroot and a lone subroot the root; an empty
table gives no rows; of the columns only the fields, the group and the key are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import stored

# A block is this many levels high: 1024 nodes.
BLOCK_LEVELS = 10

# Steps of a path: the sibling stands to the left, to the right, or is missing.
LEFT, RIGHT, LONE = "l", "r", "-"


def digest(*inputs: str) -> str:
    return sha256("".join(inputs).encode()).hexdigest()


def field(value: Column) -> Column:
    """A field as it enters a leaf's digest."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


# Places of sorted rows within their groups


def count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the sorted rows of a partition within runs of one `mark`, and the runs."""
    part = TaskContext.get().partitionId()
    mark, runs, rows = None, 0, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        marks = batch.column("mark")
        begins = np.ones(n, dtype=bool)
        begins[1:] = pc.not_equal(marks[1:], marks[:-1]).to_numpy(zero_copy_only=False)
        begins[0] = marks[0].as_py() != mark
        index = np.arange(n, dtype=np.int64)
        # The first run of a batch may go on from the batch before.
        starts = np.maximum.accumulate(np.where(begins, index, -rows if not begins[0] else 0))
        run = runs + np.cumsum(begins)
        row = index - starts
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, *map(pa.array, (np.full(n, part, dtype=np.int32), run.astype(np.int64), row))],
            names=[*batch.schema.names, "part", "run", "row"],
        )
        mark, runs, rows = marks[n - 1].as_py(), int(run[-1]), int(row[-1]) + 1


def mark(group: str) -> Column:
    """A group's label without nulls, in the order of the groups: null first, then by bytes."""
    return F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))


def placed(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """`df` with `pos`, each row's place from 0 within its group, whatever one group holds.

    Rows are dealt out by ranges of group and order; only the first group of a partition
    can have begun in an earlier one, so one number per partition corrects the places.
    """
    marked = df.withColumn("mark", mark(group))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in marked.schema)
    runs = stored(
        marked.repartitionByRange(group, *order)
        .sortWithinPartitions(group, *order)
        .mapInArrow(count_runs, f"{schema}, part int, run bigint, row bigint"),
        "merkle-places",
    )
    sizes = runs.groupBy("mark", "part").agg(F.count(F.lit(1)).alias("n"), F.min("run").alias("run"))
    earlier = Window.partitionBy("mark").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition, as only first runs are kept.
    carried = (
        sizes.withColumn("carried", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .where("run = 1")
        .select("part", "run", "carried")
    )
    return runs.join(F.broadcast(carried), ["part", "run"], "left").select(
        *df.columns, (F.col("row") + F.coalesce("carried", F.lit(0))).alias("pos")
    )


# Sweeps over one block


def forward(leaves: list[str], levels: int | None) -> list[tuple[int, int, str]]:
    """Nodes of a block in label order, (level, index, digest); the last one is its top.

    `levels` is the height of a block that has neighbours; a lone block ends at one node.
    """
    queue = [(0, i, 0, leaf) for i, leaf in enumerate(leaves)]
    nodes = []
    while True:
        level, index, _, message = heapq.heappop(queue)
        inputs = [message]
        while queue and queue[0][:2] == (level, index):
            inputs.append(heapq.heappop(queue)[3])
        node = inputs[0] if level == 0 else digest(*inputs)
        nodes.append((level, index, node))
        if level == levels or (levels is None and index == 0 and not queue):
            return nodes
        heapq.heappush(queue, (level + 1, index // 2, index % 2, node))


def backward(nodes: list[tuple[int, int, str]], path: str) -> list[str]:
    """Each leaf's path to the root, given the path of the block's top.

    Labels fall, so the queue is ordered by their negatives.
    """
    by_label = {(level, index): node for level, index, node in nodes}
    level, index, _ = nodes[-1]
    queue = [(-level, -index, path)]
    paths: list[str] = []
    while queue:
        level, index, path = heapq.heappop(queue)
        level, index = -level, -index
        if level == 0:
            paths.append(path)
            continue
        left, right = 2 * index, 2 * index + 1
        sibling = by_label.get((level - 1, right))
        rest = f" {path}" if path else ""
        heapq.heappush(queue, (1 - level, -left, (RIGHT + sibling if sibling else LONE) + rest))
        if sibling:
            heapq.heappush(queue, (1 - level, -right, LEFT + by_label[level - 1, left] + rest))
    return paths[::-1]


def siblings(path: str) -> list[str]:
    return [step[1:] for step in path.split() if step != LONE]


def folded(leaf: str, path: str) -> str:
    """The root that a leaf and its path lead to."""
    for step in path.split():
        if step == LONE:
            leaf = digest(leaf)
        elif step[0] == LEFT:
            leaf = digest(step[1:], leaf)
        else:
            leaf = digest(leaf, step[1:])
    return leaf


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one block at a time, of rows sorted by mark, block and place."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks, numbers = batch.column("mark"), batch.column("block").to_numpy()
        change = pc.not_equal(marks[1:], marks[:-1]).to_numpy(zero_copy_only=False) | (np.diff(numbers) != 0)
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = (marks[a].as_py(), numbers[a])
            if key != now and held:
                yield pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _height(block: int, n: int, levels: int) -> int | None:
    """A first block that isn't full has no neighbours."""
    return None if block == 0 and n < 1 << levels else levels


NODE = pa.schema([("mark", pa.string()), ("pos", pa.int64()), ("digest", pa.string())])
NODES = "mark string, pos bigint, digest string"
PATHS = f"{NODES}, path string, subroot string, root string"
PROOFS = (
    "key {key}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
)


def sweep_forward(levels: int):
    """For `mapInArrow`: one message per block, its top's digest for the next round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in blocks(batches):
            block = rows.column("block")[0].as_py()
            leaves = rows.column("digest").to_pylist()
            top = forward(leaves, _height(block, len(leaves), levels))[-1][2]
            yield pa.RecordBatch.from_pylist(
                [{"mark": rows.column("mark")[0].as_py(), "pos": block, "digest": top}], schema=NODE
            )

    return run


def _received(rows: pa.Table, levels: int) -> tuple[dict, pa.Table, list[str], list[str]]:
    """The message to a block's top, which stands first, the block's nodes, their digests and paths."""
    message = rows.slice(0, 1).to_pylist()[0]
    nodes = rows.slice(1).combine_chunks()
    leaves = nodes.column("digest").to_pylist()
    tree = forward(leaves, _height(message["block"], len(leaves), levels))
    return message, nodes, leaves, backward(tree, message["path"])


def sweep_backward(levels: int):
    """For `mapInArrow`: the message to a block's top, passed on to each of its nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in blocks(batches):
            message, nodes, leaves, paths = _received(rows, levels)
            out = nodes.select(["mark", "pos", "digest"]).append_column("path", pa.array(paths, pa.string()))
            for name in ("subroot", "root"):
                out = out.append_column(name, pa.array([message[name]] * len(leaves), pa.string()))
            yield from out.combine_chunks().to_batches()

    return run


def deliver_proofs(levels: int):
    """For `mapInArrow`, the last reversed round: proofs, and the roots that claimed leaves lead to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in blocks(batches):
            message, nodes, leaves, paths = _received(rows, levels)
            claimed = nodes.column("claimed").to_pylist()
            found = [folded(c or leaf, path) for c, leaf, path in zip(claimed, leaves, paths, strict=True)]
            n, root = len(leaves), message["root"]
            yield pa.RecordBatch.from_arrays(
                [
                    nodes.column("key").combine_chunks(),
                    pa.array(leaves, pa.string()),
                    pa.array([message["subroot"]] * n, pa.string()),
                    pa.array([root] * n, pa.string()),
                    pa.array([digest(*siblings(path)) for path in paths], pa.string()),
                    pa.array(found, pa.string()),
                    pa.array([f == root for f in found]),
                ],
                names=["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
            )

    return run


# Rounds over all blocks


def _by_block(nodes: DataFrame) -> DataFrame:
    return nodes.repartition("mark", "block").sortWithinPartitions("mark", "block", "pos")


def climb(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """Rounds of nodes (mark, pos, digest), the first as given; the last has one node per mark."""
    rounds = [nodes]
    while not nodes.where("pos > 0").isEmpty():
        block = F.shiftright("pos", levels).alias("block")
        nodes = stored(
            _by_block(nodes.select("mark", block, "pos", "digest")).mapInArrow(sweep_forward(levels), NODES),
            "merkle-nodes",
        )
        rounds.append(nodes)
    return rounds


def _delivered(nodes: DataFrame, tops: DataFrame, levels: int) -> DataFrame:
    """A round's nodes behind the messages to their blocks, sorted by the receivers' labels."""
    nodes = nodes.withColumn("block", F.shiftright("pos", levels))
    messages = tops.select("mark", F.col("pos").alias("block"), F.lit(-1).cast("bigint").alias("pos"),
                           "path", "subroot", "root")
    return _by_block(nodes.unionByName(messages, allowMissingColumns=True))


def descend(rounds: list[DataFrame], tops: DataFrame, levels: int) -> DataFrame:
    """Messages (mark, pos, path, subroot, root) to the tops of the lowest round's blocks."""
    for nodes in reversed(rounds[1:-1]):
        order = _delivered(nodes, tops, levels).select("mark", "block", "pos", "digest", "path", "subroot", "root")
        tops = stored(order.mapInArrow(sweep_backward(levels), PATHS), "merkle-paths")
    return tops


def manifest(
    rows: DataFrame,
    key: str,
    group: str,
    leaf: Column,
    claimed: Column | None = None,
    levels: int = BLOCK_LEVELS,
) -> DataFrame:
    """One row per row: key, leaf, subroot, root, proof_sha256, folded_root and verified.

    `leaf` gives a row's digest. `claimed` gives the digest that someone shows for it later,
    null where that is the same; it is verified against the root by the row's own proof.
    """
    digests = rows.select(
        F.col(key).alias("key"),
        F.col(group).alias("group"),
        leaf.alias("digest"),
        (F.lit(None).cast("string") if claimed is None else claimed).alias("claimed"),
    )
    # Texts are digested once; all that follows moves digests.
    digests = stored(digests, "merkle-leaves")
    leaves = placed(digests, "group", ["key", "digest", "claimed"]).withColumn("mark", mark("group"))
    rounds = climb(leaves.select("mark", "pos", "digest"), levels)
    # The null group's mark is the empty text and so comes first, as it should.
    subroots = rounds[-1].select(F.lit("").alias("all"), "mark", "digest")
    ordered = placed(
        subroots.select("all", F.col("mark").alias("member"), "digest"), "all", ["member"]
    ).withColumnRenamed("all", "mark")
    above = climb(ordered.select("mark", "pos", "digest"), levels)
    empty = F.lit("")
    root = above[-1].select("mark", "pos", empty.alias("path"), empty.alias("subroot"), F.col("digest").alias("root"))
    if len(above) > 1:
        tops = descend(above, root, levels)
        to_subroots = _delivered(above[0], tops, levels).select(
            "mark", "block", "pos", "digest", "path", "subroot", "root"
        ).mapInArrow(sweep_backward(levels), PATHS)
    else:
        to_subroots = above[0].join(root.drop("pos"), "mark")
    told = ordered.select("pos", "member").join(
        to_subroots.select("pos", "digest", "path", "root"), "pos"
    )
    tops = stored(
        told.select(F.col("member").alias("mark"), F.lit(0).cast("bigint").alias("pos"), "path",
                    F.col("digest").alias("subroot"), "root"),
        "merkle-paths",
    )
    tops = descend(rounds, tops, levels)
    kind = rows.schema[key].dataType.simpleString()
    proofs = _delivered(leaves.select("mark", "pos", "digest", "key", "claimed"), tops, levels).select(
        "mark", "block", "pos", "digest", "key", "claimed", "path", "subroot", "root"
    )
    return proofs.mapInArrow(deliver_proofs(levels), PROOFS.format(key=kind)).withColumnRenamed("key", key)
