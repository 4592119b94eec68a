"""Near-duplicate groups by an exact Jaccard join of word shingles, cut vertically.

All shingles have one global order, about rarest first. Two sets can only be similar
enough if the prefixes of their ordered shingles meet, at places from which the
threshold can still be reached; that gives candidate pairs. The order is then cut into
fragments: each candidate pair is met in every fragment on its own, where its partial
overlap is counted, and the partial counts are summed per pair.

What keeps it in proportion to the input:

* Equal sets are one class (128-bit signature), so copies cost nothing further.
* Shingles of one text are told from others by a bitmap of fixed size, come first in the
  order and are never moved. Of the other prefix shingles those of one class are found by
  grouped minima and left out by a second bitmap. The join stays exact however full the
  bitmaps are.
* Shingles that the same classes have are one list from then on.
* A list's classes are compared with a few leaders first. Classes that are in one
  component then need no comparison. Those outside the component that most of a list's
  classes are in are compared with more leaders of it, so a large group of near copies
  costs its size times the first leaders, and its stragglers times the others, not its
  square. After that, all pairs left across components that pass the filters are counted,
  so no link between components is lost.
* Sets are cut into fragments once for all rounds.

Defined results: a null text or one without words has an empty set, links with nothing
and is its own component; a null id never names a component that has another id;
repeated rows are rows of their own; other columns are not read; empty tables give no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import stored, text_bytes
from lectern.llm.components import components, joined_components
from lectern.llm.shingles import BITMAP_BITS, Order, global_order, in_bitmap, one_by_one, shingle_sets, signature

# Linked when 100 * intersection >= PERCENT * union.
PERCENT = 75
# Few, as a pair is met once in each.
FRAGMENTS = 2
# Leaders of a list in the first round, and of its commonest component in the second.
LEADERS = 8
HOME_LEADERS = 64
# Places of one piece of a bitmap, as Spark's bitmap functions cut it.
PIECE_BITS = 32768


def as_long(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def measure_sets(text: str, keep: str):
    """For `mapInArrow`: the kept column, size, signature and its first half as node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, signatures, nodes = [], [], []
            for hashes in shingle_sets(text_bytes(batch.column(text))):
                sizes.append(len(hashes))
                one, two = signature(hashes)
                signatures.append(one.to_bytes(8, "big") + two.to_bytes(8, "big"))
                nodes.append(as_long(one))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(keep),
                    pa.array(sizes, pa.int64()),
                    pa.array(signatures, pa.binary()),
                    pa.array(nodes, pa.int64()),
                ],
                names=[keep, "n_shingles", "signature", "node"],
            )

    return run


def prefix_size(size: int) -> int:
    """Shingles of which one must be shared with any partner, however large that is."""
    return size - -(-size * PERCENT // 100) + 1 if size else 0


def postings(text: str, shared_order, shared_bits=None):
    """For `mapInArrow`: token, node, size and place of prefix shingles; copies in a partition once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order: Order = shared_order.value
        bits = None if shared_bits is None else shared_bits.value
        seen: set[int] = set()
        for batch in batches:
            columns: list[list[np.ndarray]] = [[], [], [], []]
            for hashes in shingle_sets(text_bytes(batch.column(text))):
                node = signature(hashes)[0]
                if not len(hashes) or node in seen:
                    continue
                seen.add(node)
                tokens = order.sort(hashes)[: prefix_size(len(hashes))]
                places = np.arange(len(tokens), dtype=np.int32)
                kept = order.shared(tokens)
                if bits is not None:
                    kept &= in_bitmap(bits, tokens)
                tokens, places = tokens[kept], places[kept]
                for column, values in zip(
                    columns,
                    (
                        tokens.view(np.int64),
                        np.full(len(tokens), as_long(node), dtype=np.int64),
                        np.full(len(tokens), len(hashes), dtype=np.int32),
                        places,
                    ),
                    strict=True,
                ):
                    column.append(values)
            if columns[0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in columns],
                    names=["token", "node", "size", "place"],
                )

    return run


POSTING = "token bigint, node bigint, size int, place int"


def bitmap_of(keys: DataFrame, name: str) -> np.ndarray:
    """Bits set at the low bits of the keys; the driver receives at most BITMAP_BITS bits."""
    low = F.col(name).bitwiseAND(F.lit(BITMAP_BITS - 1))
    pieces = (
        keys.select(F.expr(f"({name} & {BITMAP_BITS - 1}) div {PIECE_BITS}").alias("piece"), (low % PIECE_BITS).alias("bit"))
        .groupBy("piece")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
    )
    out = np.zeros(BITMAP_BITS // 8, dtype=np.uint8)
    for row in one_by_one(pieces, "join-bitmap"):
        at = row["piece"] * (PIECE_BITS // 8)
        out[at : at + PIECE_BITS // 8] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out


def fragments(text: str, shared_order, shared_nodes):
    """For `mapInArrow`: the ordered shingles of candidate sets, cut into fragments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order: Order = shared_order.value
        nodes: np.ndarray = shared_nodes.value
        seen: set[bytes] = set()
        for batch in batches:
            rows: list[tuple] = []
            for hashes in shingle_sets(text_bytes(batch.column(text))):
                one, two = signature(hashes)
                key = one.to_bytes(8, "big") + two.to_bytes(8, "big")
                if not len(hashes) or key in seen or not in_bitmap(nodes, np.array([one], dtype=np.uint64))[0]:
                    continue
                seen.add(key)
                # A shingle that no other set has adds to the size only.
                common = hashes[order.shared(hashes)]
                part = order.fragment(common, FRAGMENTS)
                rows += [
                    (as_long(one), key, len(hashes), f, common[part == f].view(np.int64))
                    for f in range(FRAGMENTS)
                ]
            if rows:
                node, key, size, fragment, tokens = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(node, pa.int64()),
                        pa.array(key, pa.binary()),
                        pa.array(size, pa.int64()),
                        pa.array(fragment, pa.int32()),
                        pa.array(tokens, pa.list_(pa.int64())),
                    ],
                    names=["node", "signature", "size", "fragment", "tokens"],
                )

    return run


FRAGMENT = "node bigint, signature binary, size bigint, fragment int, tokens array<bigint>"


def reachable(x: str, y: str) -> Column:
    """Whether two sets that first meet at these places can still be similar enough."""
    return F.expr(
        f"{100 + PERCENT} * (1 + least({x}.size - {x}.place - 1, {y}.size - {y}.place - 1))"
        f" >= {PERCENT} * ({x}.size + {y}.size)"
        f" AND 100 * least({x}.size, {y}.size) >= {PERCENT} * greatest({x}.size, {y}.size)"
    )


def merged_lists(shared: DataFrame) -> DataFrame:
    """Shingles that the same classes have become one list: its key, and per class its node,
    size and first place, where any two of its classes first meet in it.

    A passage thus has one list, not one for each of its shingles. Lists whose keys
    collide only add candidates.
    """
    keys = (
        shared.groupBy("token")
        .agg(
            F.min("node").alias("low"),
            F.max("node").alias("high"),
            F.count("*").alias("n"),
            F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("nodes"),
        )
        .where("low < high")
        .select("token", F.xxhash64("n", "nodes", "low", "high").alias("list"))
    )
    return (
        shared.join(keys, "token")
        .groupBy("list", "node")
        .agg(F.min("size").alias("size"), F.min("place").alias("place"))
    )


MEMBER = ("node", "size", "place", "label")


def node_pairs(met: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of nodes of the rows x and y."""
    return met.where(reachable("x", "y")).select(
        F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")
    ).distinct()


def leader_pairs(lists: DataFrame) -> DataFrame:
    """Every class of a list with up to LEADERS of them: the least of each part of a hash."""
    leaders = lists.groupBy("list", F.pmod(F.xxhash64("node"), F.lit(LEADERS)).alias("part")).agg(
        F.min(F.struct(*MEMBER)).alias("y")
    )
    met = lists.select("list", F.struct(*MEMBER).alias("x")).join(leaders.select("list", "y"), "list")
    return node_pairs(met.where("x.node <> y.node AND x.label <> y.label"))


def home_pairs(lists: DataFrame) -> DataFrame:
    """Every class outside the component that most of its list's classes are in, with up to
    HOME_LEADERS classes of that component in the list."""
    sizes = lists.groupBy("list", "label").agg(F.count("*").alias("n"))
    homes = sizes.groupBy("list").agg(F.max(F.struct("n", "label"))["label"].alias("home"))
    placed = lists.join(homes, "list")
    leaders = (
        placed.where("label = home")
        .groupBy("list", F.pmod(F.xxhash64("node"), F.lit(HOME_LEADERS)).alias("part"))
        .agg(F.min(F.struct(*MEMBER)).alias("y"))
    )
    strays = placed.where("label <> home").select("list", F.struct(*MEMBER).alias("x"))
    return node_pairs(strays.join(leaders.select("list", "y"), "list"))


def open_pairs(lists: DataFrame) -> DataFrame:
    """All pairs across components that share a list and pass the filters."""
    x = F.struct(*MEMBER)
    met = lists.select("list", x.alias("x")).join(lists.select("list", x.alias("y")), "list")
    return node_pairs(met.where("x.node < y.node AND x.label <> y.label"))


def cut_sets(docs: DataFrame, text: str, order, lists: DataFrame) -> DataFrame:
    """The sets of all classes in the lists, cut into fragments, each once."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap_of(lists.select("node"), "node"))
    cut = docs.select(text).mapInArrow(fragments(text, order, bits), FRAGMENT)
    # Copies in other partitions.
    out = stored(cut.dropDuplicates(["signature", "fragment"]), "join-fragments")
    bits.destroy()
    return out


def similar_pairs(cut: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose partial overlaps add up to the threshold, as edges of signatures."""
    side = lambda name: cut.select(
        F.col("node").alias(name), "fragment", F.struct("signature", "size", "tokens").alias(f"of_{name}")
    )
    partial = (
        pairs.join(side("a"), "a")
        .join(side("b"), ["b", "fragment"])
        .select(
            F.col("of_a.signature").alias("a"),
            F.col("of_b.signature").alias("b"),
            (F.col("of_a.size") + F.col("of_b.size")).alias("sizes"),
            F.size(F.array_intersect("of_a.tokens", "of_b.tokens")).alias("overlap"),
        )
    )
    # union = sizes - intersection
    return (
        partial.groupBy("a", "b")
        .agg(F.first("sizes").alias("sizes"), F.sum("overlap").alias("overlap"))
        .where((100 + PERCENT) * F.col("overlap") >= PERCENT * F.col("sizes"))
        .select("a", "b")
    )


def node_of(signature: str) -> str:
    return f"cast(conv(hex(substring({signature}, 1, 8)), 16, -10) as bigint)"


def open_lists(lists: DataFrame, found: DataFrame) -> DataFrame:
    """Lists labelled with the components of their classes, where there are several."""
    labels = found.select(F.expr(node_of("node")).alias("node"), F.expr(node_of("component")).alias("component"))
    labelled = lists.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node"))
    labelled = labelled.drop("component")
    several = (
        labelled.groupBy("list")
        .agg(F.min("label").alias("low"), F.max("label").alias("high"))
        .where("low < high")
        .select("list")
    )
    return labelled.join(several, "list", "left_semi")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, n_shingles and component_id, the least id of its group."""
    spark = docs.sparkSession
    docs = docs.select(id_column, text)
    measured_schema = (
        f"`{id_column}` {docs.schema[id_column].dataType.simpleString()}, "
        "n_shingles bigint, signature binary, node bigint"
    )
    measured = stored(docs.mapInArrow(measure_sets(text, id_column), measured_schema), "join-sets")
    order = spark.sparkContext.broadcast(global_order(docs, text))
    met = (
        docs.select(text)
        .mapInArrow(postings(text, order), POSTING)
        .groupBy("token")
        .agg(F.min("node").alias("low"), F.max("node").alias("high"))
        .where("low < high")
    )
    bits = spark.sparkContext.broadcast(bitmap_of(met, "token"))
    shared = stored(docs.select(text).mapInArrow(postings(text, order, bits), POSTING), "join-shared")
    bits.destroy()
    lists = stored(merged_lists(shared), "join-lists")
    cut = cut_sets(docs, text, order, lists)
    order.destroy()

    still = lists.withColumn("label", F.col("node"))
    tested = stored(leader_pairs(still), "join-pairs")
    edges = stored(similar_pairs(cut, tested), "join-edges")
    found = components(edges)
    for pairs_of in (home_pairs, open_pairs):
        still = stored(open_lists(still.drop("label"), found), "join-open")
        pairs = stored(pairs_of(still).join(tested, ["a", "b"], "left_anti"), "join-pairs")
        if not pairs.isEmpty():
            # Few sets are left, so the others stay where they are.
            ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
            few = cut.join(ends, "node", "left_semi")
            edges = stored(similar_pairs(few, pairs), "join-edges")
            if not edges.isEmpty():
                # Components stand for the edges of earlier rounds, so few steps are left.
                found = joined_components(found, edges)
            tested = tested.union(pairs)
    filled = measured.where("n_shingles > 0")
    filled = filled.join(
        found.select(F.col("node").alias("signature"), "component"), "signature", "left"
    ).withColumn("component", F.coalesce("component", "signature"))
    least = filled.groupBy("component").agg(F.min(id_column).alias("component_id"))
    grouped = filled.join(least, "component").select(id_column, "n_shingles", "component_id")
    alone = measured.where("n_shingles = 0").select(
        id_column, "n_shingles", F.col(id_column).alias("component_id")
    )
    return grouped.union(alone)
