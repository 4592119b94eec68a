"""License notices: exact set-similarity search of template wordings in text blocks.

A block is a line. A template is found in a block that holds at least `CONTAINMENT`
of its distinct words. Only template words can count, so a block is reduced to
those at once. They are ordered by the number of blocks of the whole corpus that
hold them, rarest first. A template's prefix in that order, as long as words may be
missing plus one, must meet the block's; the join is on that word, then blocks too
short for the template, and pairs whose words after the meeting point can no longer
reach the threshold, are left out before the full overlap is counted.

The base part finds where the words of a known phrase stand one after another.

Defined results: a null or empty text has no words, no blocks and no labels; repeated
rows are rows of their own; columns other than the id and the text are not read, so
their names cannot clash; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import stored

# Words of a text in any case, and of one in lower case.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# Lower-casing must not turn the Kelvin sign into an ASCII k.
KELVIN, LETTER = "K", "å"

# Phrases that must stand word after word, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Wordings of notices, and their labels.
TEMPLATES = {
    "this work is licensed under the gnu general public license version 3": "gpl",
    "this program is free software you can redistribute it and or modify it under the terms "
    "of the gnu general public license": "gpl",
    "licensed under the apache license version 2 0": "apache",
    "licensed under cc by nc 4 0": "cc-by",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this "
    "software and associated documentation files": "mit",
    "redistribution and use in source and binary forms with or without modification are "
    "permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl",
}
# Of a template's distinct words, at least 9 of 10.
CONTAINMENT = (9, 10)


def distinct_words(template: str) -> list[str]:
    return list(dict.fromkeys(template.split()))


def needed(size: int) -> int:
    """Words of a template of `size` that a block must hold."""
    part, whole = CONTAINMENT
    return -(-size * part // whole)


VOCABULARY = sorted({w for t in TEMPLATES for w in distinct_words(t)})
SHORTEST = min(needed(len(distinct_words(t))) for t in TEMPLATES)


def words_of(text: Column) -> Column:
    """The words of a text in lower case."""
    folded = F.lower(F.replace(text, F.lit(KELVIN), F.lit(LETTER)))
    return F.regexp_extract_all(folded, F.lit(WORD), F.lit(0))


def places_of(words: Column, phrase: str, label: str) -> Column:
    def stands_at(i: Column) -> Column:
        here = F.lit(True)
        for k, part in enumerate(phrase.split()):
            here = here & F.coalesce(F.get(words, i.cast("int") + k) == part, F.lit(False))
        return here

    starts = F.filter(F.sequence(F.lit(0), F.size(words) - 1), stands_at)
    return F.transform(
        starts, lambda i: F.struct(i.cast("bigint").alias("start"), F.lit(label).alias("label"))
    )


def phrase_places(words: Column) -> Column:
    """array<struct<start, label>> of all places of the phrases in an array of words."""
    # The words are bound to a variable, so that the text is cut once and not per place.
    found = F.transform(
        F.filter(F.array(words), lambda ws: F.size(ws) > 0),
        lambda ws: F.concat(*[places_of(ws, phrase, label) for phrase, label in PHRASES.items()]),
    )
    return F.get(found, F.lit(0))


def measure(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """Per row: a row id, the id, its number of words, base places, and the template words of each block."""
    whole = F.coalesce(F.col(text), F.lit(""))
    # Without this no phrase can occur; most texts need no list of words.
    may_hold = whole.rlike(r"(?i)license|cc[^0-9a-z\x80-\x{10FFFF}]+by")
    blocks = F.filter(
        F.transform(
            F.split(whole, "\n", -1),
            lambda line: F.array_intersect(F.array(*map(F.lit, VOCABULARY)), words_of(line)),
        ),
        lambda block: F.size(block) > 0,
    )
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_column).alias("id"),
        F.regexp_count(whole, F.lit(WORD)).cast("bigint").alias("n_words"),
        F.when(may_hold, phrase_places(words_of(whole))).alias("places"),
        blocks.alias("blocks"),
    )


def template_rows(spark: SparkSession) -> DataFrame:
    rows = [
        F.struct(
            F.lit(i).alias("template"),
            F.lit(label).alias("label"),
            F.array(*map(F.lit, distinct_words(text))).alias("words"),
            F.lit(needed(len(distinct_words(text)))).alias("needed"),
        )
        for i, (text, label) in enumerate(TEMPLATES.items())
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def global_order(measured: DataFrame) -> list[str]:
    """Template words by the number of blocks that hold them, rarest first.

    At most one row per template word reaches the driver.
    """
    counts = (
        measured.select(F.explode("blocks").alias("block"))
        .select(F.explode("block").alias("word"))
        .groupBy("word")
        .count()
        .collect()
    )
    known = {r["word"]: r["count"] for r in counts}
    return sorted(VOCABULARY, key=lambda w: (known.get(w, 0), w))


def contained_templates(measured: DataFrame) -> DataFrame:
    """row, labels and best containment for each row with a block that holds a template."""
    order = F.array(*map(F.lit, global_order(measured)))
    prefix = (
        template_rows(measured.sparkSession)
        .withColumn("words", F.array_intersect(order, F.col("words")))
        .withColumn("n", F.size("words"))
        .select("*", F.posexplode(F.slice(F.col("words"), F.lit(1), F.col("n") - F.col("needed") + 1)).alias("i", "word"))
    )
    blocks = (
        measured.select("row", F.explode("blocks").alias("found"))
        .where(F.size("found") >= SHORTEST)
        .select("row", F.array_intersect(order, F.col("found")).alias("block"))
        .select(
            "row",
            "block",
            F.posexplode(
                F.slice(F.col("block"), F.lit(1), F.size("block") - SHORTEST + 1)
            ).alias("j", "word"),
        )
    )
    # The other side has a few rows per template.
    met = blocks.join(F.broadcast(prefix), "word").where(
        (F.size("block") >= F.col("needed"))
        & (1 + F.least(F.col("n") - F.col("i"), F.size("block") - F.col("j")) - 1 >= F.col("needed"))
    )
    overlap = F.size(F.array_intersect("words", "block"))
    return (
        met.withColumn("overlap", overlap)
        .where(F.col("overlap") >= F.col("needed"))
        .groupBy("row")
        .agg(
            F.collect_set("label").alias("template_labels"),
            F.max(F.col("overlap") / F.col("n")).alias("containment"),
        )
    )


def find_licenses(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, n_words, places, template_labels and containment."""
    measured = stored(measure(docs, id_column, text), "license-blocks")
    return (
        measured.drop("blocks")
        .join(contained_templates(measured), "row", "left")
        .select(
            F.col("id").alias(id_column),
            "n_words",
            F.coalesce("places", F.array().cast("array<struct<start:bigint,label:string>>")).alias("places"),
            F.coalesce("template_labels", F.array().cast("array<string>")).alias("template_labels"),
            F.coalesce("containment", F.lit(0.0)).alias("containment"),
        )
    )
