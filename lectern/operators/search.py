"""Search across articles by an inverted index kept as a table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lectern.functions.text import tokens
from lectern.schemas import CORPUS_FIGURES, STORED_POSTINGS


def build_index(items: DataFrame) -> DataFrame:
    """One row per term and item: how often and at which positions (from 0) the item has it.

    An article's words are sorted and grouped inside its own row, so nothing is
    shuffled, and a word that is in every article makes no hot key.
    """
    return _postings(items.select("item_id", tokens("text").alias("_words")), None)


def find_postings(items: DataFrame, terms: Sequence[str], every: bool = False) -> DataFrame:
    """What the index holds on `terms`, straight from the articles where no index is kept.

    Only articles that contain one of them, if only inside a longer word, are cut
    into words; with `every`, only those that contain all, as is enough for
    `search_all` and `search_phrase`.
    """
    wanted = wanted_words(terms)
    has = [F.contains(F.lower("text"), F.lit(t)) for t in wanted]
    candidates = items.where(reduce(lambda a, b: a & b if every else a | b, has))
    return _postings(candidates.select("item_id", tokens("text").alias("_words")), wanted)


def _postings(words: DataFrame, wanted: Sequence[str] | None) -> DataFrame:
    """Postings of (item_id, _words) rows, of all words or of the wanted ones.

    The steps stay separate projections because each uses the one before more than once.
    """
    placed = F.transform("_words", lambda w, n: F.struct(w.alias("term"), n.alias("at")))
    if wanted is not None:
        placed = F.filter(placed, lambda p: p["term"].isin(list(wanted)))
    grouped = (
        words.select(
            "item_id",
            F.size("_words").cast("bigint").alias("item_length"),
            F.sort_array(placed).alias("_places"),
        )
        .withColumn("_starts", F.filter(F.transform("_places", lambda p, n: n), _starts_run))
        # Outer, as the plain form has Spark do all of the above again to test for words.
        .select("*", F.posexplode_outer("_starts").alias("_run", "_start"))
        .where(F.col("_start").isNotNull())
    )
    following = F.coalesce(F.get("_starts", F.col("_run") + 1), F.size("_places"))
    count = following - F.col("_start")
    return grouped.select(
        _term_at(F.col("_start")).alias("term"),
        "item_id",
        count.cast("bigint").alias("tf"),
        F.slice("_places", F.col("_start") + 1, count)["at"].alias("positions"),
        "item_length",
    )


def _term_at(n: Column) -> Column:
    return F.get("_places", n)["term"]


def _starts_run(n: Column) -> Column:
    """Whether the n-th of the sorted words differs from the one before."""
    return (n == 0) | (_term_at(n) != _term_at(n - 1))


def corpus_figures(items: DataFrame) -> DataFrame:
    """One row: items with at least one word, and their mean length in words."""
    length = items.select(F.size(tokens("text")).alias("_n"))
    # No filter, which would cut the texts into words a second time.
    counted = F.count_if(F.col("_n") > 0)
    words = F.sum(F.when(F.col("_n") > 0, F.col("_n")))
    return length.agg(
        counted.alias("items"), (words / counted.cast("double")).alias("mean_length")
    )


def index_figures(index: DataFrame) -> DataFrame:
    """`corpus_figures` of a stored index, without a distinct: position 0 exists once per item."""
    items = F.count_if(F.col("positions")[0] == 0)
    return index.agg(
        items.alias("items"), (F.sum("tf") / items.cast("double")).alias("mean_length")
    )


def wanted_words(terms: Sequence[str]) -> list[str]:
    """The words of the terms, cut as texts are cut."""
    return sorted({word for term in terms for word in phrase_words(term)})


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def write_index(index: DataFrame, path: str, buckets: int) -> None:
    """Store postings in directories by hash of the term, and the corpus figures beside them.

    `rebalance` sizes the files: a bucket with a term that most articles hold is
    split over many tasks, and inside a file postings are sorted by term.
    """
    (
        index.withColumn("bucket", _bucket(F.col("term"), buckets))
        .hint("rebalance", "bucket")
        .sortWithinPartitions("bucket", "term", "item_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .partitionBy("bucket")
        .parquet(f"{path}/postings")
    )
    stored = read_index(index.sparkSession, path)
    figures = index_figures(stored).withColumn("buckets", F.lit(buckets))
    figures.write.mode("overwrite").parquet(f"{path}/figures")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STORED_POSTINGS).parquet(f"{path}/postings")


def read_figures(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CORPUS_FIGURES).parquet(f"{path}/figures")


def stored_postings(spark: SparkSession, path: str, terms: Sequence[str]) -> DataFrame:
    """The postings of `terms`, read from their buckets only, as many as the index was written with."""
    wanted = wanted_words(terms)
    buckets = read_figures(spark, path).first()["buckets"]
    return read_index(spark, path).where(
        F.col("bucket").isin([_bucket(F.lit(t), buckets) for t in wanted])
        & F.col("term").isin(wanted)
    ).drop("bucket")


def search_all(postings: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Items that hold every one of the terms, with the number of hits in all.

    `postings` is an index or what `find_postings` gives; so in the other searches.
    """
    wanted = wanted_words(terms)
    return (
        postings.where(F.col("term").isin(wanted))
        .groupBy("item_id")
        # An item has one posting per term.
        .agg(F.count(F.lit(1)).alias("_terms"), F.sum("tf").alias("hits"))
        .where(F.col("_terms") == len(wanted))
        .select("item_id", "hits")
    )


def search_ranked(
    postings: DataFrame,
    corpus: DataFrame,
    terms: Sequence[str],
    k: int,
    k1: float = 1.2,
    b: float = 0.75,
) -> DataFrame:
    """The k best items by BM25, items of equal score by id.

    `corpus` is the one row of `corpus_figures` or `index_figures`. It and one row
    with the number of items per term are scalar subqueries. Postings are read
    once: scores and these numbers come from the same shuffle by item.
    """
    wanted = wanted_words(terms)
    per_item = (
        postings.where(F.col("term").isin(wanted))
        .groupBy("item_id")
        .agg(
            F.max("item_length").alias("_length"),
            *[F.sum(F.when(F.col("term") == t, F.col("tf"))).alias(f"_tf{n}")
              for n, t in enumerate(wanted)],
        )
    )
    with_term = per_item.agg(
        # The length is named so that both uses of `per_item` need the same columns.
        *[F.count_if(F.col(f"_tf{n}").isNotNull() & (F.col("_length") > 0)).alias(f"_items{n}")
          for n in range(len(wanted))]
    )
    relative = F.lit(1.0 - b) + F.lit(b) * F.col("_length") / F.col("_corpus.mean_length")

    def gain(n: int) -> Column:
        tf, n_items = F.col(f"_tf{n}"), F.col(f"_counts._items{n}")
        idf = F.log(1.0 + (F.col("_corpus.items") - n_items + F.lit(0.5)) / (n_items + F.lit(0.5)))
        return F.coalesce(
            idf * tf * F.lit(k1 + 1.0) / (tf + F.lit(k1) * relative), F.lit(0.0)
        )

    score = reduce(lambda x, y: x + y, [gain(n) for n in range(len(wanted))])
    return (
        per_item.withColumn("_counts", with_term.select(F.struct(*with_term.columns)).scalar())
        .withColumn("_corpus", corpus.select(F.struct("items", "mean_length")).scalar())
        .select("item_id", score.alias("score"))
        .orderBy(F.desc("score"), "item_id")
        .limit(k)
        # Rounded when shown, after the order is settled.
        .withColumn("score", F.round("score", 6))
    )


def search_phrase(postings: DataFrame, phrase: str) -> DataFrame:
    """Items with the words of `phrase` next to each other in order, and how often.

    Each word's positions, moved back by its place in the phrase, are intersected
    per item; an item brings at most one posting per word.
    """
    words = phrase_words(phrase)
    distinct = sorted(set(words))
    per_item = (
        postings.where(F.col("term").isin(distinct))
        .groupBy("item_id")
        .agg(
            *[
                F.first(F.when(F.col("term") == word, F.col("positions")), ignorenulls=True).alias(
                    f"_at{n}"
                )
                for n, word in enumerate(distinct)
            ]
        )
    )
    starts = None
    for place, word in enumerate(words):
        moved = F.transform(f"_at{distinct.index(word)}", _back_by(place))
        starts = moved if starts is None else F.array_intersect(starts, moved)
    hits = F.coalesce(F.size(starts), F.lit(0)).cast("bigint")
    return per_item.select("item_id", hits.alias("hits")).where(F.col("hits") > 0)


def _back_by(place: int):
    return lambda position: position - F.lit(place)


def phrase_words(phrase: str) -> list[str]:
    word, words = "", []
    for char in phrase.lower() + " ":
        if char.isalnum():
            word += char
        elif word:
            words.append(word)
            word = ""
    if not words:
        raise ValueError("the phrase holds no word")
    return words
