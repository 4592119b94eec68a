"""What the toxicity models find in rows they never saw, and labelled texts of any length."""

import random

import numpy as np
from pyspark.sql import functions as F

from lectern.llm import queries, toxicity
from lectern.llm.common import table

SF = "/root/testdata/sf0.1"


def test_held_out_rows(spark):
    """Words of many toxic and no ordinary learning rows mark what can be found; the rest is label noise."""
    docs = table(spark, SF, "documents").join(table(spark, SF, "labels"), "doc_id")
    rows = docs.select("doc_id", "toxic", F.crc32(F.col("doc_id").cast("string")).alias("crc"), F.lower("text").alias("text")).collect()
    learn = [r for r in rows if r["crc"] % 5]
    seen = [{}, {}]
    for r in learn:
        for w in set((r["text"] or "").replace(".", " ").replace(",", " ").split()):
            seen[r["toxic"]][w] = seen[r["toxic"]].get(w, 0) + 1
    marks = [w for w, n in seen[1].items() if n >= 20 and w not in seen[0]]
    got = {r["doc_id"]: r for r in queries.op8_toxicity(spark, SF).collect()}
    held = [r for r in rows if r["crc"] % 5 == 0]
    assert all(got[r["doc_id"]]["held_out"] for r in held)
    score = np.array([got[r["doc_id"]]["score"] for r in held])
    toxic = np.array([r["toxic"] == 1 for r in held])
    marked = np.array([any(w in (r["text"] or "") for w in marks) for r in held])
    assert marks and (marked & toxic).sum() > 30
    assert (score[marked & toxic] >= 0.5).mean() >= 0.95
    assert (score[~toxic] >= 0.5).mean() <= 0.03
    assert ((score >= 0.5) & toxic).sum() >= 0.8 * (score >= 0.5).sum()


def test_one_long_labelled_text_crowds_out_no_other(spark):
    rng = random.Random(1)
    words = [f"word{n}" for n in range(300)]

    def text(bad, n=60):
        return " ".join(rng.choice(["filth", "vermin"]) if bad and rng.random() < 0.2 else rng.choice(words) for _ in range(n))

    rows = [(n, text(n % 2)) for n in range(300)]
    rows[6], rows[7] = (6, text(0, 1_500_000)), (7, text(1, 1_500_000))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(n, n % 2) for n in range(300)], "doc_id bigint, toxic int")
    got = {r["row"]["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, labels).select("row", "score").collect()}
    right = [(got[n] >= 0.5) == bool(n % 2) for n in range(300)]
    assert sum(right) >= 285
