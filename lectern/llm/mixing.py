"""Mix sources to target weights: budgets down a domain, language and source tree.

The supply of every subtree is its tokens times the epochs allowed. From the root
down, each node's budget is shared among its children by weight, none getting more
than its subtree can supply; what one cannot take goes to its siblings, and a
shortage leaves a node only when all its children are used up. That makes siblings
come before ancestors without any iteration: among siblings in order of supply per
weight, the used-up ones are a prefix, found with running sums.

Each leaf then takes whole epochs, and of the last one a prefix of its documents in
an order seeded by leaf epoch. The prefix ends at a cut key, found by narrowing
hash ranges 256-fold per step, so that no task sorts a whole source. A document is
then kept by comparing its own key with its leaf's cut, and texts never move.

All of it is DataFrame work; amounts are whole tokens and weights whole numbers.

Defined results: a null domain, language or source is the node ''; a text without
words has no tokens and costs nothing; an unlisted child has the default weight; a
weight of 0 gives nothing; equal keys (rows of one id) are kept or left together;
repeated rows are rows; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"
NODES = ["domain", "language", "origin"]
# Hex digits of the key compared per narrowing step, and steps before the last window.
DIGITS, STEPS = 2, 2


@dataclass(frozen=True)
class Mix:
    """Weights of the tree: domains, languages in any domain, sources in any language."""

    domain_of: dict[str, str]
    domains: dict[str, int]
    languages: dict[str, int]
    sources: dict[str, int] = field(default_factory=dict)
    default_domain: str = "web"
    default_weight: int = 1
    # The target is this share of all tokens.
    share: tuple[int, int] = (3, 4)
    max_epochs: int = 4
    seed: str = "mix-1"


def lookup(column: Column, table: dict, default) -> Column:
    """The table's value for the column, a chain of conditions over a small fixed table."""
    out = F.lit(default)
    for name, value in table.items():
        out = F.when(column == name, F.lit(value)).otherwise(out)
    return out


def with_nodes(docs: DataFrame, mix: Mix, id_column: str, text: str) -> DataFrame:
    """Every row as the struct `row`, with its leaf, its tokens and its id as text."""
    source = F.coalesce(F.col("source"), F.lit(""))
    return docs.select(
        F.struct("*").alias("row"),
        lookup(source, mix.domain_of, mix.default_domain).alias("domain"),
        F.coalesce(F.col("lang"), F.lit("")).alias("language"),
        source.alias("origin"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint").alias("tokens"),
        F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"),
    )


def share_out(children: DataFrame, parent: list[str], budget: Column, name: str) -> DataFrame:
    """Share each parent's budget among its children by `weight`, up to their `supply`.

    In order of supply per weight, a child is used up if its supply is no more than its
    weight's part of what is left for it and all after it.
    """
    order = Window.partitionBy(*parent).orderBy(
        (F.col("supply").cast("double") / F.greatest(F.col("weight"), F.lit(1))), "supply", name
    )
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parent)
    big = lambda c: c.cast("decimal(38,0)")
    measured = children.withColumns(
        {
            "_left": budget - F.coalesce(F.sum("supply").over(before), F.lit(0)),
            "_weights": F.sum("weight").over(after),
        }
    )
    tested = measured.withColumn(
        "_full",
        big(F.col("supply")) * F.col("_weights") <= big(F.col("_left")) * F.col("weight"),
    )
    # Those used up are the prefix before the first child that isn't.
    prefix = tested.withColumn("_prefix", F.min(F.col("_full").cast("int")).over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ) == 1)
    rest = prefix.withColumns(
        {
            "_rest": budget
            - F.coalesce(F.sum(F.when(F.col("_prefix"), F.col("supply"))).over(whole), F.lit(0)),
            "_rest_weights": F.sum(F.when(~F.col("_prefix"), F.col("weight"))).over(whole),
        }
    )
    return rest.withColumn(
        "budget",
        F.when(F.col("_prefix"), F.col("supply"))
        .when(
            F.col("weight") > 0,
            F.expr("(cast(_rest as decimal(38,0)) * weight) div _rest_weights"),
        )
        .otherwise(0)
        .cast("bigint"),
    ).drop("_left", "_weights", "_full", "_prefix", "_rest", "_rest_weights")


def leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """domain, language, origin, tokens, supply and budget of every leaf.

    The windows see one row per node of the tree, never documents.
    """
    # A child without weight takes nothing, so it supplies nothing either.
    weighted = leaves.withColumns(
        {
            "w1": lookup(F.col("domain"), mix.domains, mix.default_weight),
            "w2": lookup(F.col("language"), mix.languages, mix.default_weight),
            "w3": lookup(F.col("origin"), mix.sources, mix.default_weight),
        }
    ).withColumn(
        "supply",
        F.when(F.least("w1", "w2", "w3") > 0, F.col("tokens") * mix.max_epochs)
        .otherwise(0)
        .cast("bigint"),
    )
    part, whole = mix.share
    domains = (
        weighted.groupBy("domain")
        .agg(F.sum("supply").alias("supply"), F.first("w1").alias("weight"), F.sum("tokens").alias("t"))
        .withColumn("root", F.lit(1))
    )
    domains = domains.withColumn(
        "target",
        F.least(
            F.expr(f"(sum(t) OVER (PARTITION BY root) * {part}) div {whole}"),
            F.sum("supply").over(Window.partitionBy("root")),
        ),
    )
    domains = share_out(domains, ["root"], F.col("target"), "domain").select(
        "domain", F.col("budget").alias("above")
    )
    languages = (
        weighted.groupBy("domain", "language")
        .agg(F.sum("supply").alias("supply"), F.first("w2").alias("weight"))
        .join(domains, "domain")
    )
    languages = share_out(languages, ["domain"], F.col("above"), "language").select(
        "domain", "language", F.col("budget").alias("above")
    )
    sources = weighted.withColumnRenamed("w3", "weight").join(languages, ["domain", "language"])
    return share_out(sources, ["domain", "language"], F.col("above"), "origin").select(
        *NODES, "tokens", "supply", "budget"
    )


def seeded_key(mix: Mix) -> Column:
    """Order of a leaf's documents in its partial epoch."""
    return F.md5(F.concat(F.lit(f"{mix.seed}:"), F.col("epochs").cast("string"), F.lit(":"), F.col("id")))


def cut_keys(narrow: DataFrame, plans: DataFrame) -> DataFrame:
    """For each leaf, the greatest key with which the tokens so far stay within `part`."""
    state = plans.select(*NODES, "part", F.lit("").alias("prefix"), F.lit(False).alias("done"))
    rows = narrow.select(*NODES, "key", "tokens")
    for step in range(1, STEPS + 1):
        width = step * DIGITS
        open_rows = (
            rows.join(state.where(~F.col("done")), NODES)
            .where(F.substring("key", 1, width - DIGITS) == F.col("prefix"))
            .groupBy(*NODES, F.substring("key", 1, width).alias("next"))
            .agg(F.sum("tokens").alias("tokens"), F.first("part").alias("part"))
        )
        running = Window.partitionBy(*NODES).orderBy("next")
        # The first range that doesn't fit whole; what came before it is spent.
        over = (
            open_rows.withColumn("so_far", F.sum("tokens").over(running))
            .where(F.col("so_far") > F.col("part"))
            .groupBy(*NODES)
            .agg(F.min(F.struct("next", "so_far", "tokens", "part")).alias("m"))
            .select(
                *NODES,
                F.col("m.next").alias("next"),
                (F.col("m.part") - (F.col("m.so_far") - F.col("m.tokens"))).alias("left"),
            )
        )
        state = state.join(over, NODES, "left").select(
            *NODES,
            F.coalesce("left", "part").alias("part"),
            # Where everything fits, the cut is above all keys.
            F.coalesce("next", F.when(F.col("done"), F.col("prefix")).otherwise(F.lit("g"))).alias("prefix"),
            (F.col("done") | F.col("next").isNull()).alias("done"),
        )
        state = stored(state, "mix-cut")
    last = Window.partitionBy(*NODES).orderBy("key").rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    inside = (
        rows.join(state.where(~F.col("done")), NODES)
        .where(F.substring("key", 1, STEPS * DIGITS) == F.col("prefix"))
        .withColumn("so_far", F.sum("tokens").over(last))
        .where(F.col("so_far") <= F.col("part"))
        .groupBy(*NODES)
        .agg(F.max("key").alias("cut"))
    )
    # Without a fitting key inside the range, the cut lies just below it.
    return state.join(inside, NODES, "left").select(
        *NODES, F.coalesce("cut", "prefix").alias("cut")
    )


def mix_sources(docs: DataFrame, mix: Mix, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and epoch kept: struct `row`, the leaf, tokens, epoch and budget."""
    rows = with_nodes(docs, mix, id_column, text)
    narrow = stored(rows.select(*NODES, "tokens", "id"), "mix-narrow")
    leaves = narrow.groupBy(*NODES).agg(F.sum("tokens").alias("tokens"))
    budgets = leaf_budgets(leaves, mix)
    plans = stored(
        budgets.where("supply > 0").select(
            *NODES,
            "budget",
            F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0).cast("int").alias("epochs"),
            F.when(F.col("tokens") > 0, F.expr("budget % tokens")).otherwise(0).alias("part"),
        ),
        "mix-plans",
    )
    keyed = narrow.join(plans.select(*NODES, "epochs"), NODES).withColumn("key", seeded_key(mix))
    cuts = stored(plans.join(cut_keys(keyed, plans), NODES), "mix-leaves")
    taken = F.col("epochs") + F.when(seeded_key(mix) <= F.col("cut"), 1).otherwise(0)
    return (
        rows.join(cuts, NODES)
        .withColumn("taken", taken)
        .where("taken > 0")
        .select(
            "row",
            *NODES,
            "tokens",
            "budget",
            F.explode(F.sequence(F.lit(0), F.col("taken") - 1)).alias("epoch"),
        )
    )
