"""What the driver holds of its own: bounded tables, and no more of them than needed."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import components, ngram_join, shingles, toxicity
from lectern.llm.common import BY_LETTER, BY_SPACE, CHUNK_BYTES, Powers, word_hashes


def peak_mb(work) -> float:
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def made_texts(n: int, seed: int) -> list[bytes]:
    of = random.Random(seed)
    words = [f"word{k}" for k in range(5000)]
    return [" ".join(of.choices(words, k=250)).encode() for _ in range(n)]


def test_training_holds_few_times_its_texts():
    toxic, ordinary = made_texts(600, 1), made_texts(600, 2)
    assert peak_mb(lambda: toxicity.without_copies(toxic)) < 12
    continuations = np.ones(toxicity.SLOTS)
    assert peak_mb(lambda: toxicity.train_models(toxic, ordinary, continuations)) < 40


def test_copies_are_left_out():
    texts = made_texts(3, 3)
    assert toxicity.without_copies([texts[0], texts[1], texts[0], b"", texts[2]]) == texts


def test_powers_of_long_texts_are_not_kept():
    powers = Powers()
    long_up, long_down = powers.to(2 * CHUNK_BYTES)
    assert len(long_up) == 2 * CHUNK_BYTES and len(powers.up) == 1
    up, down = powers.to(100)
    assert (up == long_up[:100]).all() and (down == long_down[:100]).all() and len(powers.up) == 100
    assert (up * down == 1).all()


@pytest.mark.parametrize("fold", [BY_SPACE, BY_LETTER])
def test_words_of_long_texts_are_those_of_short_ones(fold):
    words = [f"w{k % 977}x".encode() for k in range(80_000)]
    alone = {w: int(word_hashes([w], fold)[0][0]) for w in set(words)}
    got, _ = word_hashes([b" ".join(words)], fold)
    assert got.tolist() == [alone[w] for w in words]


def test_grades_keep_the_order_of_counts():
    counts = np.unique(np.concatenate([np.arange(5000), 2 ** np.arange(40), 2 ** np.arange(5, 40) - 1]))
    grade = shingles.grades(counts)
    assert grade.dtype == np.uint8 and (np.diff(grade.astype(int)) >= 0).all()
    assert grade[: shingles.FINE].tolist() == list(range(shingles.FINE))
    below = shingles.graded(grade.astype(int))
    near = counts < 2**34
    assert (below[near] <= counts[near]).all() and (counts[near] < 1.13 * below[near] + 1).all()


def test_order_takes_a_byte_a_counter(spark):
    rows = [("a b c d e f",), ("a b c d e g",), (None,), ("a b c d e f",)]
    order = shingles.global_order(spark.createDataFrame(rows, "text string"), "text")
    held = sum(v.nbytes for v in vars(order).values() if isinstance(v, np.ndarray))
    assert held <= shingles.COUNTERS + shingles.BITMAP_BITS // 8 + 10_000
    hashes = next(shingles.shingle_sets([b"a b c d e"]))
    assert order.shared(hashes).all() and order.grade[order.slots(hashes)][0] >= 2


def test_later_rounds_start_from_stars(spark, monkeypatch):
    """A chain of near copies found over several rounds is one group, and its edges aren't walked again."""
    words = [f"t{k}" for k in range(60)]
    rows = [(k, " ".join(words[: 40 + k])) for k in range(12)]
    seen = []
    components = ngram_join.components

    def watched(edges):
        seen.append(edges.count())
        return components(edges)

    monkeypatch.setattr(ngram_join, "components", watched)
    monkeypatch.setattr(ngram_join, "LEADERS", 1)
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 12
    # Once only: the later rounds find nothing that is not linked already.
    assert len(seen) == 1


def test_the_driver_does_not_train(spark, monkeypatch):
    """The model comes from a task: the driver's Python keeps what training once held."""

    def refused(*_):
        raise AssertionError("trained in the driver")

    for name in ("train_models", "without_copies", "fit_curve"):
        monkeypatch.setattr(toxicity, name, refused)
    of = random.Random(6)
    text = lambda k: " ".join([*(f"w{of.randrange(2000)}" for _ in range(20)), *["nasty"] * (k % 2)])
    rows = [(k, text(k)) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id bigint, toxic int")
    got = {r["row"]["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, labels).select("row", "score").collect()}
    marked, plain = [got[k] for k in range(1, 200, 2)], [got[k] for k in range(0, 200, 2)]
    assert len(got) == 200 and np.median(marked) > 0.8 and np.median(plain) < 0.2


def test_stars_take_no_step(spark, monkeypatch):
    """Each step is some hundred tasks and a plan that the driver keeps."""
    steps = []
    large_star = components._large_star
    monkeypatch.setattr(components, "_large_star", lambda edges: steps.append(1) or large_star(edges))
    edges = spark.createDataFrame([(1, 2), (3, 1), (1, 3), (7, 9), (5, 5)], "a bigint, b bigint")
    got = {(r.node, r.component) for r in components.components(edges).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (7, 7), (9, 7)} and not steps
    path = spark.createDataFrame([(1, 2), (2, 3)], "a bigint, b bigint")
    assert {r.component for r in components.components(path).collect()} == {1} and len(steps) == 1


def test_components_are_joined_by_further_edges(spark):
    of = random.Random(5)
    first = [(of.randrange(300), of.randrange(300)) for _ in range(120)]
    # Ends that are new, repeated edges, loops, and edges inside one component.
    more = [(of.randrange(360), of.randrange(360)) for _ in range(60)] + first[:5] + [(7, 7), first[0][::-1]]
    frame = lambda edges: spark.createDataFrame(edges, "a bigint, b bigint")
    whole = {r.node: r.component for r in components.components(frame(first + more)).collect()}
    rows = components.joined_components(components.components(frame(first)), frame(more)).collect()
    got = {r.node: r.component for r in rows}
    assert len(rows) == len(got) and {k: v for k, v in got.items() if k in whole} == whole
    assert all(k == v for k, v in got.items() if k not in whole)


def test_counting_holds_one_table_of_counters():
    batch = pa.RecordBatch.from_pydict({"text": [t.decode() for t in made_texts(200, 4)]})
    held = shingles.COUNTERS * 4 + 2 * shingles.BITMAP_BITS // 8
    assert peak_mb(lambda: list(shingles.count_pieces("text")(iter([batch])))) < held / 1e6 + 25
