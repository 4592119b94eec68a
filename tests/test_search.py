import math

import pytest

from helpers import plan, rows
from lectern.operators import search
from lectern.session import new_folder


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(
        [
            (1, "The cat sat on the mat. The cat!"),
            (2, "A mat the cat left"),
            (3, "dog, dog; DOG"),
            (4, ""),
            (5, None),
        ],
        "item_id bigint, text string",
    )


@pytest.fixture(scope="module")
def index(items):
    return search.build_index(items)


def test_index_rows(index):
    got = {(r.term, r.item_id): (r.tf, r.positions, r.item_length) for r in index.collect()}
    assert got["the", 1] == (3, [0, 4, 6], 8)
    assert got["dog", 3] == (3, [0, 1, 2], 3)
    assert {item for _, item in got} == {1, 2, 3}


def test_postings_found_without_an_index_are_the_same(items, index):
    terms = ["the", "Dog", "absent"]
    wanted = index.where("term in ('the', 'dog')")
    assert rows(search.find_postings(items, terms)) == rows(wanted)
    assert rows(search.corpus_figures(items)) == rows(search.index_figures(index))


def test_all_terms(index):
    assert rows(search.search_all(index, ["the", "CAT", "cat"])) == [(1, 5), (2, 2)]
    assert rows(search.search_all(index, ["cat", "absent"])) == []


def test_phrases(index):
    assert rows(search.search_phrase(index, "the cat")) == [(1, 2), (2, 1)]
    assert rows(search.search_phrase(index, "dog dog")) == [(3, 2)]
    assert rows(search.search_phrase(index, "The cat, sat")) == [(1, 1)]
    assert rows(search.search_phrase(index, "cat the")) == []
    with pytest.raises(ValueError):
        search.search_phrase(index, " ?! ")


def test_ranking_is_bm25(items, index):
    got = search.search_ranked(index, search.corpus_figures(items), ["cat", "dog"], 5).collect()
    mean = (8 + 5 + 3) / 3

    def score(tf, n, length):
        idf = math.log(1 + (3 - n + 0.5) / (n + 0.5))
        return round(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)), 6)

    expected = {3: score(3, 1, 3), 1: score(2, 2, 8), 2: score(1, 2, 5)}
    assert {r.item_id: r.score for r in got} == pytest.approx(expected)
    assert [r.score for r in got] == sorted(expected.values(), reverse=True)


def test_stored_index_prunes_buckets_and_terms(spark, index):
    path = new_folder(spark, "test-index")
    search.write_index(index, path, 8)
    stored = search.read_index(spark, path)
    assert rows(stored.drop("bucket")) == rows(index)
    figures = search.read_figures(spark, path)
    assert rows(figures.drop("buckets")) == rows(search.index_figures(index))
    assert figures.first()["buckets"] == 8
    # A term is cut into words as a text is.
    assert rows(search.stored_postings(spark, path, ["The-Cat"])) == rows(
        search.stored_postings(spark, path, ["the", "cat"])
    )
    found = search.stored_postings(spark, path, ["the", "cat"])
    assert rows(search.search_phrase(found, "the cat")) == [(1, 2), (2, 1)]
    text = plan(found)
    assert "PartitionFilters: [bucket" in text and "In(term" in text


def test_index_is_built_without_a_shuffle(items):
    assert "Exchange" not in plan(search.build_index(items))
