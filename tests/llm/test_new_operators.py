"""Spelling variants, nearest neighbours and the Merkle manifest against brute force, and their edges."""

import math
import random
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lectern.llm import kd_tree, merkle, nearest, queries, spelling
from lectern.llm.common import table

SF = "/root/testdata/sf0.001"


# Spelling


def brute_words(docs):
    counts = Counter()
    for key, text in docs:
        for run in spelling.re.findall("[a-zÀ-ÿ]+", "".join(c.lower() if c.isascii() else c for c in text or "")):
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(docs):
    words = brute_words(docs)
    rows = {}
    for w, n in words.items():
        others = sorted(((-words[v], v) for v in words if near(w, v)))
        form = others[0][1] if others and -others[0][0] >= 5 * n else None
        rows[w] = (form, n, len(others), words[form] if form else None)
    out = set()
    for w, (form, n, n_near, form_n) in rows.items():
        root = w
        while rows[root][0]:
            root = rows[root][0]
        out.add((w, form, root, n, n_near, form_n))
    return out


def variants(spark, docs, **bounds):
    df = spark.createDataFrame(docs, "doc_id bigint, text string, word string, cell int")
    return {tuple(r) for r in spelling.spelling_variants(df, **bounds).collect()}


def test_variants_equal_brute_force(spark):
    rng = random.Random(5)
    base = ["letters", "lettres", "lettered", "létters", "statement", "statements", "Étatments", "aaaaaa", "aaaaaab"]
    docs = []
    for i in range(300):
        words = []
        for _ in range(40):
            w = rng.choice(base)
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", "x", "e", "é", w[at] * 2]) + w[at + 1 :]
            words.append(w.upper() if rng.random() < 0.1 else w)
        docs.append((i if i % 17 else None, rng.choice([" ", ", ", "1"]).join(words), "clash", 1))
    docs += [(i, "wordaaa " * 5 * (i == 500) + "wordaab " + "wordabb " * 7, "", 0) for i in range(500, 530)]
    docs += [(7, None, None, None), (8, "", "x", 2), (9, "12 !", "x", 2), docs[1], docs[1]]
    want = brute_variants([(d[0], d[1]) for d in docs])
    assert any(r[1] for r in want) and any(r[0] == "wordaaa" and r[2] == "wordabb" for r in want)
    assert variants(spark, docs) == want


def test_cells_lose_no_word(spark):
    """With tiny cells, parts and samples every word still meets every near one."""
    rng = random.Random(6)
    docs = [(i, " ".join("".join(rng.choice("abé") for _ in range(rng.choice([6, 7]))) for _ in range(60)), "", 0) for i in range(200)]
    want = brute_variants([(d[0], d[1]) for d in docs])
    assert variants(spark, docs, cell=20, sample_words=100) == want


def test_variants_of_nothing_and_of_a_long_run(spark):
    assert variants(spark, []) == set()
    run = "ab" * 100_000
    assert variants(spark, [(i, run + " " + run[1:], None, 0) for i in range(6)]) == brute_variants(
        [(i, run + " " + run[1:]) for i in range(6)]
    )


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40), st.booleans())
def test_tree_finds_all_within_a_distance(seed, leaf, tight):
    rng = np.random.default_rng(seed)
    points = rng.integers(0, 6, (rng.integers(1, 120), 32)) * (rng.random((1, 32)) < 0.2)
    asked = np.concatenate((points[:20], rng.integers(0, 3, (10, 32))))
    tree = kd_tree.KdTree(points, leaf, tight)
    bits = kd_tree.bits_of(np.minimum(asked, kd_tree.LEVELS).astype(np.uint8))
    low = np.minimum(points, kd_tree.LEVELS)
    for distance in (1, 2):
        want = {(i, j) for i, a in enumerate(np.minimum(asked, kd_tree.LEVELS)) for j, p in enumerate(low) if abs(a - p).sum() <= distance}
        if tight:
            got = [(i, j) for a, b in tree.within(bits, distance) for i, j in zip(a.tolist(), b.tolist())]
            assert len(got) == len(set(got)) and set(got) == want
        else:
            home = tree.cells(points)
            reached = {(i, leaf.cell) for leaf, rows in tree.reached(bits, distance) for i in rows.tolist()}
            assert {(i, int(home[j])) for i, j in want} <= reached


@given(st.text("ab", min_size=6, max_size=8), st.text("ab", min_size=6, max_size=8))
def test_letters_compared_in_order(a, b):
    if len(a) > len(b):
        a, b = b, a
    x, y = spelling.letters([a], len(a)), spelling.letters([b], len(b))
    if len(a) == len(b):
        assert spelling.one_replaced(x, y)[0] == near(a, b)
    elif len(a) + 1 == len(b):
        assert spelling.one_inserted(x, y)[0] == near(a, b)


# Nearest neighbours

VECTORS = "vec_id bigint, embedding array<float>, label int, rank int"


def exact(rows, asked, n=10):
    """Of distinct usable rows, each query's nearest."""
    rows = sorted({(i, tuple(v)) for i, v, *_ in rows})
    vectors = np.array([v for _, v in rows], dtype=np.float32).astype(float)
    ids = np.array([i for i, _ in rows])
    out = {}
    for k, q in enumerate(ids):
        if asked(q):
            distances = np.sqrt(((vectors - vectors[k]) ** 2).sum(axis=1))
            seen, best = set(), []
            for j in np.lexsort((ids, distances)):
                if ids[j] != q and ids[j] not in seen:
                    seen.add(ids[j])
                    best.append((int(ids[j]), float(distances[j])))
            out[int(q)] = best[:n]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_on_the_given_vectors(spark):
    rows = [tuple(r) for r in table(spark, "/root/testdata/sf0.1", "embeddings").select("vec_id", "embedding").collect()]
    want = exact(rows, lambda i: i % 100 == 0)
    got = found(queries.op12_nearest(spark, "/root/testdata/sf0.1"))
    assert got.keys() == want.keys()
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want]
    assert sum(hits) >= 0.9 * 10 * len(want)
    scores = {q: dict(exact_of(rows, q)) for q in want}
    assert all(scores[q][i] == s for q in got for i, s in got[q])


def exact_of(rows, query):
    vectors = np.array([v for _, v in rows], dtype=np.float32).astype(float)
    at = next(k for k, (i, _) in enumerate(rows) if i == query)
    return zip((i for i, _ in rows), np.sqrt(((vectors - vectors[at]) ** 2).sum(axis=1)).tolist())


def test_copies_ties_and_unusable_vectors(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).round(1).tolist(), 0, 0) for i in range(300)]
    hot = rows[0][1]
    rows += [(i, hot, 1, 1) for i in range(1000, 1200)]
    usable = list(rows)
    rows += [rows[5], rows[5], (400, None, 0, 0), (500, [0.0] * 8, 0, 0), (600, [math.nan] + [1.0] * 7, 0, 0)]
    rows += [(700, [math.inf] + [1.0] * 7, 0, 0), (800, [None] + [1.0] * 7, 0, 0), (900, [1.0] * 3, 0, 0), (None, hot, 0, 0)]
    monkeypatch.setattr(nearest, "MOST_POINTS", 16)
    df = spark.createDataFrame(rows, VECTORS)
    got = nearest.nearest_neighbours(df, F.col("vec_id") % 20 == 0, leaf=8, target=1.0)
    want = exact(usable, lambda i: i % 20 == 0)
    got = found(got)
    assert got.keys() == want.keys()
    agree = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert agree >= 0.9 * sum(map(len, want.values()))
    # Copies are ties, and the smaller ids go first.
    assert got[1000] == want[1000] and got[0] == want[0]


def test_few_and_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0], 0, 0), (3, [1.0, 2.5], 0, 0), (4, [9.0, 2.0], 0, 0)], VECTORS)
    assert found(nearest.nearest_neighbours(few, F.col("vec_id") == 0)) == {0: [(3, 0.5), (4, 8.0)]}
    alone = spark.createDataFrame([(0, [1.0, 2.0], 0, 0)], VECTORS)
    assert found(nearest.nearest_neighbours(alone, F.col("vec_id") == 0)) == {}
    none = nearest.nearest_neighbours(spark.createDataFrame([], VECTORS), F.col("vec_id") == 0)
    assert none.collect() == [] and none.columns == ["query_id", "rank", "vec_id", "score"]


def test_visits_reach_every_leaf_once_own_leaves_first():
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(500, 6))
    forest = nearest.fit_forest(vectors, 500, trees=3, leaf=10)
    visits = forest.visits(vectors[0], np.inf)
    assert sorted(visits) == [(t, leaf) for t in range(3) for leaf in range(1 << forest.depth)]
    own = forest.leaves(vectors[:1])[:, 0].tolist()
    assert visits[:3] == list(enumerate(own))


# Merkle manifest


def h(*inputs):
    return sha256("".join(inputs).encode()).hexdigest()


def brute_tree(leaves):
    """The root, and each leaf's list of (side of the sibling, sibling or None)."""
    level, paths, places = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for path, place in zip(paths, places):
            other = place ^ 1
            path.append((place & 1, level[other] if other < len(level) else None))
        level = [h(*level[i : i + 2]) for i in range(0, len(level), 2)]
        places = [p // 2 for p in places]
    return level[0], paths


def brute_manifest(rows):
    def part(value):
        return "-" if value is None else f"{len(str(value).encode())}:{value}"

    def leaf(r, more=0):
        n = None if r[3] is None else r[3] + more
        return h(*map(part, (r[0], r[2], r[1], n, r[4])))

    groups = {}
    for r in rows:
        tampered = zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 0
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r), leaf(r, tampered), r[0]))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort()
        trees[g] = brute_tree([m[2] for m in groups[g]])
    root, upper = brute_tree([trees[g][0] for g in order])
    out = []
    for g, above in zip(order, upper):
        for member, path in zip(groups[g], trees[g][1]):
            now = member[3]
            for left, sibling in path + above:
                now = h(now) if sibling is None else h(sibling, now) if left else h(now, sibling)
            proof = h(*(s for _, s in path + above if s is not None))
            out.append((member[4], member[2], trees[g][0], root, proof, now, now == root))
    return sorted(out, key=repr)


DOCS = "doc_id bigint, lang string, source string, n_chars bigint, text string, leaf string, pos int"


def got_manifest(spark, rows, levels):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], DOCS)
    return sorted((tuple(r) for r in queries.merkle_manifest(docs, levels).collect()), key=repr)


@pytest.mark.parametrize("levels", [2, 10])
def test_manifest_equals_brute_force(spark, levels):
    """Small blocks need several rounds."""
    rng = random.Random(levels)
    langs = [None, "", "de", "en", "en", "en", "é", "z", *(f"l{i}" for i in range(9))]
    rows = [
        (rng.choice([None, i, i, i]), rng.choice(langs), rng.choice([None, "s"]), rng.choice([None, i]), rng.choice([None, "", "téxt", "x" * 5000]))
        for i in range(150)
    ]
    rows += rows[:20]
    rows = [(r[0], "one" if k == 3 else r[1], *r[2:]) for k, r in enumerate(rows)]
    assert got_manifest(spark, rows, levels) == brute_manifest(rows)


def test_manifest_of_one_row_and_of_none(spark):
    assert got_manifest(spark, [(1, "en", "s", 2, "x")], 10) == brute_manifest([(1, "en", "s", 2, "x")])
    assert got_manifest(spark, [], 10) == []


def test_sweeps_meet_in_any_block():
    for n in range(1, 34):
        leaves = [h(str(i)) for i in range(n)]
        nodes = merkle.forward(leaves, None)
        root, paths = brute_tree(leaves)
        assert nodes[-1][2] == root
        for leaf, path, want in zip(leaves, merkle.backward(nodes, ""), paths):
            assert merkle.siblings(path) == [s for _, s in want if s is not None]
            assert merkle.folded(leaf, path) == root
            assert merkle.folded(h("other"), path) != root or n == 0
