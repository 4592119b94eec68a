"""Small hand-made tables: nulls, empty and very long texts, ties, repeats, clashing names."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import (
    components,
    decontaminate,
    exact_dedup,
    fm_index,
    html_blocks,
    licenses,
    mixing,
    ngram_join,
    quality,
    secrets,
    sharding,
    toxicity,
)
from lectern.llm.common import BY_LETTER, BY_SPACE, word_hashes

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"w{n % 997}x{n % 13}" for n in range(60_000))
DENSE = "A sentence of the main text that goes on for so long that three lines like it make a dense window."


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1)))


def edge_texts(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"word{n}" for n in range(400)] + ["Été", "日本", "o'neil"]
    base = [" ".join(rng.choices(vocabulary, k=rng.randrange(8, 90))) for _ in range(12)]
    texts = [None, "", "  \n\t ", "one", "two words", LONG, LONG + " tail"]
    for text in base:
        w = text.split()
        texts += [text, text, text.upper(), text.replace(" ", " \n ")]
        for _ in range(4):
            changed = list(w)
            changed[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(changed))
        texts.append(" ".join(w[: len(w) // 2] + rng.choices(vocabulary, k=len(w) // 2)))
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(n, t, ["en", "fr", None][n % 3], [None, "src0", "src1"][n % 3], 0) for n, t in enumerate(edge_texts())]
    rows += [rows[8], rows[8], (None, "one", None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    # Names that the operators use inside.
    return df.withColumns({c: F.lit(7) for c in ("row", "node", "size", "shard", "budget", "score", "word")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def plain(df):
    return [tuple(r) for r in df.collect()]


def test_word_hashes_stand_for_words():
    texts = [t.encode() for t in ("a b  a", "", "b\tA\x0bc", "é É e1")]
    for fold, cut in ((BY_SPACE, lambda t: lower(t).split()), (BY_LETTER, words_of)):
        hashes, begins = word_hashes(texts, fold)
        every = [w for t in texts for w in cut(t.decode())]
        assert len(hashes) == len(every) == begins[-1]
        assert len(set(zip(every, hashes.tolist()))) == len(set(every)) == len(set(hashes.tolist()))


@pytest.mark.parametrize("seed", range(4))
def test_fm_index_finds_every_occurrence(seed):
    rng = np.random.default_rng(seed)
    text = np.append(rng.integers(0, 4, 600), 0)
    text = np.concatenate((text, text[100:400], [0]))
    shifted = np.append(text + 1, 0)
    order = fm_index.suffix_array(shifted)
    assert sorted(order) == list(range(len(shifted)))
    suffixes = [tuple(shifted[i:]) for i in order]
    assert suffixes == sorted(suffixes)
    index = fm_index.FMIndex(text)
    phrases = rng.integers(1, 4, (30, 3))
    low, high = index.ranges(phrases)
    for phrase, a, b in zip(phrases, low, high):
        found = sorted(index.locate(np.arange(a, b)).tolist())
        assert found == [i for i in range(len(text) - 2) if (text[i : i + 3] == phrase).all()]


def brute_passages(text, items):
    w, hit, found = words_of(text), set(), set()
    for item, item_text in items:
        v = words_of(item_text)
        size = min(10, len(v))
        windows = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)} if v else set()
        for i in range(len(w) - size + 1):
            if tuple(w[i : i + size]) in windows:
                hit |= set(range(i, i + size))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [8 << 20, 200])
def test_passages_as_by_brute_force_in_any_blocks(spark, docs, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    texts = edge_texts()
    items = [(1, texts[7]), (2, "two words"), (11, texts[20]), (3, None), (4, ""), (5, "absent thing"),
             (6, " ".join(LONG.split()[40_000:40_030]))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.find_passages(docs, bench)
    got = found.select("row.text", "n_words", decontaminate.hit_words().alias("h"), F.array_sort("items")).collect()
    assert len(got) == docs.count()
    for r in got:
        assert tuple(r)[1:] == brute_passages(r[0], items)
    cleaned = decontaminate.without_spans(found).select("text").collect()
    assert sum(brute_passages(r.text, items[:1])[1] for r in cleaned) == 0


def test_passages_of_empty_tables(spark, docs, empty):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.find_passages(docs, none).where("size(spans) > 0").count() == 0
    assert decontaminate.find_passages(empty, none).count() == 0


def test_exact_groups(docs, empty):
    got = exact_dedup.exact_groups(docs).collect()
    rows = docs.collect()
    same = lambda t: re.sub("[ \t-\r]+", " ", t or "")
    groups = defaultdict(list)
    for r in rows:
        groups[same(r.text)].append(r.doc_id)
    sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    assert len(got) == len(rows)
    for r in got:
        ids = groups[sha[r.text_sha256]]
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids)
        assert r.keep_id == (min(known) if known else None)
    assert Counter(r.text_sha256 for r in got if r.kept) == {s: 1 for s in sha}
    assert exact_dedup.exact_groups(empty).count() == 0


def test_filters_merge_without_loss():
    rng = np.random.default_rng(1)
    parts = [np.unique(rng.integers(0, 50, 30).astype(np.uint64)) for _ in range(6)]
    rest, counts = exact_dedup.merged(parts, [np.ones(len(p), dtype=np.int64) for p in parts])
    assert dict(zip(rest.tolist(), counts.tolist())) == Counter(np.concatenate(parts).tolist())


def brute_components(rows):
    sets = [shingles(r.text) for r in rows]
    linked = {n: {n} for n in range(len(rows))}
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                linked[a].add(b)
                linked[b].add(a)
    out = []
    for n in range(len(rows)):
        reach, todo = {n}, [n]
        while todo:
            for m in linked[todo.pop()] - reach:
                reach.add(m)
                todo.append(m)
        ids = [rows[m].doc_id for m in reach if rows[m].doc_id is not None]
        out.append((rows[n].doc_id, len(sets[n]), min(ids, default=None)))
    return out


@pytest.mark.parametrize("leaders", [16, 1])
def test_near_duplicates_as_by_brute_force(docs, monkeypatch, leaders):
    """Also with one leader, so that most pairs are left to the second step."""
    monkeypatch.setattr(ngram_join, "LEADERS", leaders)
    got = plain(ngram_join.near_duplicates(docs))
    assert sorted(got, key=repr) == sorted(brute_components(docs.collect()), key=repr)


def test_a_pair_is_met_in_few_fragments(docs, monkeypatch):
    """The rows that the join of pairs makes; all pairs of a group may be among them."""
    seen = []
    cut_sets = ngram_join.cut_sets

    def counted(*parts):
        cut = cut_sets(*parts)
        seen.append((cut.count(), cut.select("signature").distinct().count()))
        return cut

    monkeypatch.setattr(ngram_join, "cut_sets", counted)
    ngram_join.near_duplicates(docs).count()
    ((cut, classes),) = seen
    assert 0 < cut <= 2 * classes


def test_near_duplicates_of_nothing(empty):
    assert ngram_join.near_duplicates(empty).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(n, n + 1) for n in range(40)] + [(100, n) for n in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(plain(components.components(spark.createDataFrame(edges, "a bigint, b bigint"))))
    assert got == {**{n: 0 for n in range(41)}, **{n: 100 for n in range(100, 130)}, 200: 200, 201: 200}


def test_shards_are_contiguous_and_balanced(docs, empty):
    got = sharding.contiguous_shards(docs, 4).collect()
    rows = docs.collect()
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (r.doc_id, size(r.text), zlib.crc32((r.text or "").encode())) for r in rows
    )
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r.shard].append(r)
    total, most = sum(r.size for r in got), max(r.size for r in got)
    for shard, members in by_shard.items():
        assert sorted(r.slot for r in members) == list(range(len(members)))
        assert abs(sum(r.size for r in members) - total / 4) <= most
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot)) if r.doc_id is not None]
    assert order == sorted(order)
    assert sharding.contiguous_shards(empty, 4).count() == 0


def brute_budgets(leaves, mix):
    """Shares among children again and again until no child gets more than it can supply."""

    def share(budget, children):
        left, out, open_ = budget, {}, dict(children)
        while True:
            weights = sum(w for w, _ in open_.values())
            full = [k for k, (w, s) in open_.items() if s * weights <= left * w]
            if not full:
                break
            for k in full:
                out[k] = open_.pop(k)[1]
            left = budget - sum(out.values())
        weights = sum(w for w, _ in open_.values())
        return out | {k: left * w // weights for k, (w, _) in open_.items()}

    tree = defaultdict(lambda: defaultdict(dict))
    for (d, l, s), tokens in leaves.items():
        tree[d][l][s] = (mix.sources.get(s, 1), tokens * mix.max_epochs)
    supply_l = {d: {l: sum(s for _, s in ss.values()) for l, ss in ls.items()} for d, ls in tree.items()}
    supply_d = {d: sum(v.values()) for d, v in supply_l.items()}
    target = min(sum(leaves.values()) * mix.share[0] // mix.share[1], sum(supply_d.values()))
    out = {}
    for d, budget in share(target, {d: (mix.domains.get(d, 1), s) for d, s in supply_d.items()}).items():
        for l, b in share(budget, {l: (mix.languages.get(l, 1), s) for l, s in supply_l[d].items()}).items():
            for s, leaf in share(b, tree[d][l]).items():
                out[d, l, s] = leaf
    return out


@pytest.mark.parametrize("seed", range(3))
def test_budgets_as_by_repeated_sharing(spark, seed):
    rng = random.Random(seed)
    mix = mixing.Mix(
        {}, {"a": 5, "b": 1}, {"en": 3, "fr": 1}, {"s1": 4}, share=(rng.choice([1, 2, 5]), 2), max_epochs=2
    )
    leaves = {
        (d, l, s): rng.randrange(0, 1000)
        for d in "abc" for l in ("en", "fr", "") for s in ("s1", "s2", "s3") if rng.random() < 0.7
    }
    df = spark.createDataFrame([(*k, v) for k, v in leaves.items()], "domain string, language string, origin string, tokens bigint")
    got = {tuple(r)[:3]: r.budget for r in mixing.leaf_budgets(df, mix).collect()}
    assert got == brute_budgets(leaves, mix)


def test_mixing_takes_a_seeded_prefix_of_each_leaf(docs, empty):
    mix = mixing.Mix({"src0": "x"}, {"x": 3, "web": 1}, {"en": 2}, share=(2, 3), max_epochs=3)
    kept = mixing.mix_sources(docs, mix).select("domain", "language", "origin", "tokens", "budget", "epoch", "row.doc_id").collect()
    leaves = defaultdict(list)
    for r in docs.collect():
        leaf = ({"src0": "x"}.get(r.source, "web"), r.lang or "", r.source or "")
        leaves[leaf].append((r.doc_id, len((r.text or "").split())))
    budgets = brute_budgets({k: sum(t for _, t in v) for k, v in leaves.items()}, mix)
    for leaf, rows in leaves.items():
        total = sum(t for _, t in rows)
        epochs, part = divmod(budgets[leaf], total)
        key = lambda i: hashlib.md5(f"mix-1:{epochs}:{'' if i is None else i}".encode()).hexdigest()
        expected = Counter()
        for i, t in rows:
            n = epochs + (sum(t2 for i2, t2 in rows if key(i2) <= key(i)) <= part)
            for e in range(n):
                expected[i, t, e] += 1
        got = Counter((r.doc_id, r.tokens, r.epoch) for r in kept if (r.domain, r.language, r.origin) == leaf)
        assert got == expected
    assert mixing.mix_sources(empty, mix).count() == 0


def test_secrets_positions_and_ledger(spark):
    texts = [
        None, "", 'é password = "abc123XYZ" end', "token: short", 'secret="token: abcdefgh', "AKIA" + "A" * 16,
        "ab" * 12 + "-" + "cd" * 20, "token=" + "ab" * 12, "x " * 20_000 + "api_key:" + "q" * 9,
        "eyJa.eyJb.c, x.eyJa-.eyJ_b.c.d xeyJa.eyJb.c\neyJa.eyJb eyJa.eyJb.c", "eyJ" * 100_000 + " " + "eyJ-" * 100_000,
    ]
    rows = [(n, t) for n, t in enumerate(texts)] + [(2, texts[2]), (99, texts[2])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("content", F.lit(1))
    ledger = secrets.Ledger(spark)
    first = secrets.RULES[:2]
    secrets.update_ledger(docs.where("doc_id < 5"), ledger, first)
    unseen = secrets.unseen_contents(docs, ledger, first, "text").count()
    assert unseen == 6  # six new texts; copies and known ones are not scanned again
    secrets.update_ledger(docs, ledger, secrets.RULES)
    assert secrets.unseen_contents(docs, ledger, secrets.RULES, "text").count() == 0
    pairs = ledger.read("pairs", secrets.PAIR).count()
    secrets.update_ledger(docs, ledger, secrets.RULES)
    assert ledger.read("pairs", secrets.PAIR).count() == pairs
    # The ledger outlives its object, and known texts are passed over where they lie.
    again = secrets.Ledger(spark, ledger.folder)
    later = secrets.unseen_contents(docs.union(docs.limit(1)), again, secrets.RULES, "text")
    assert "BroadcastHashJoin" in later._jdf.queryExecution().executedPlan().toString()
    assert again.read("pairs", secrets.PAIR).count() == pairs and later.count() == 0
    got = secrets.findings_by_path(docs, ledger).collect()
    assert len(got) == len(rows)
    for r in got:
        text = dict(rows)[r.doc_id] or ""
        expected = []
        for rank, rule in enumerate(secrets.RULES):
            for m in re.finditer(rule.pattern, text):
                if len(m[rule.group]) >= rule.least:
                    expected.append((m.start(rule.span), rank, m.end(), rule.kind))
        assert [tuple(s) for s in r.spans] == sorted(expected)


def test_licenses(spark):
    texts = [
        None, "", "LICENSED under the Apache License, Version 2.0.", "see mit\nlicense", "mit license MIT License",
        "Released under the MIT license\nand CC-BY 4.0", "redistribution and use in source and binary forms with or "
        "without modification are permitted provided that the following conditions", "the licence", LONG + " cc by",
        "mitK license", "This work is licensed under the GNU General Public License version 2",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("row", F.lit(1))
    got = {r.doc_id: r for r in licenses.find_licenses(docs).collect()}
    assert len(got) == len(texts)
    for n, text in enumerate(texts):
        w = words_of(text)
        places = sorted(
            (i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(w))
            if w[i : i + len(phrase.split())] == phrase.split()
        )
        assert got[n].n_words == len(w)
        assert sorted(tuple(p) for p in got[n].places) == places
        labels, best = set(), 0.0
        for line in (text or "").split("\n"):
            block = set(words_of(line))
            for template, label in licenses.TEMPLATES.items():
                t = set(template.split())
                if 10 * len(t & block) >= 9 * len(t):
                    labels.add(label)
                    best = max(best, len(t & block) / len(t))
        assert set(got[n].template_labels) == labels
        assert math.isclose(got[n].containment, best)


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("<p>hi", "hi"), ("a<!-- x", "a"), ("<script>x</script>", ""),
        ("<nav><a href=/>Home</a></nav><article><h1>T</h1><p>a &amp;amp; b<br>c</p></article><footer>f</footer>",
         "T\n\na &amp; b c"),
        ('<article><p>one</p><div class="ad"><div>x</div>BUY</div><p>two</p>'
         '<section id="comments"><p>me</p></section></article>', "one\n\ntwo"),
        ("<article><header><h1>Title</h1></header><p>text</p><form>f</form></article><aside>s</aside>", "Title\n\ntext"),
        ('<div id="menu"><a href=1>A</a></div><div><p>A long text that is the body of it</p><p>and its end.</p></div>'
         '<div class="sidebar">side</div>', "A long text that is the body of it\n\nand its end."),
        ("<article><p>x<p>y<ul><li>1<li>2</ul></article>", "x\n\ny\n\n1\n\n2"),
        (f'<div class="content has-sidebar"><p>{DENSE}</p></div>', DENSE),
        (f"<div class='post no-comments'><p>{DENSE}</p></div><div class='comment-list'><p>{DENSE}</p></div>", DENSE),
        (f'<article><p>{DENSE}</p><p class="share-price">12</p><p class=search-results>a</p></article>',
         f"{DENSE}\n\n12\n\na"),
        ("<article><a title=it's href='/q'>here</a> and<p title='class=ad'>there</p></article>", "here and\n\nthere"),
        # Adverts leave no line, so they end no text; a menu without a name does.
        ("<h1>Title</h1><p>Lead</p><ul><li>one<li>two</ul>" + "<div class=ad>buy</div>" * 4 + f"<p>{DENSE}</p>"
         + "<p><a href=1>next</a></p>" * 4 + "<p>small print</p>", f"Title\n\nLead\n\none\n\ntwo\n\n{DENSE}"),
        # Links between two lines of the text belong to it.
        (f"<p>{DENSE}</p><ul><li><a href=1>one</a><li><a href=2>two</a></ul><p>end</p>", f"{DENSE}\n\none\n\ntwo\n\nend"),
        (f"<form><nav>x</nav><main><p>{DENSE}</p><form>f</form></main></form>", DENSE),
        ("<article><a href=1>teaser</a></article>" + f"<p>{DENSE}</p>" * 2, f"{DENSE}\n\n{DENSE}"),
        ("<article><p>short</p></article><p>beside</p>", "short"),
        ("<!--> a <!-- <script> --><p>b</p><script>c</script ><p>d</p><p title='", "a\n\nb\n\nd"),
    ],
)
def test_main_text(page, text):
    assert html_blocks.main_text(page) == text


def test_stretches_as_by_brute_force():
    rng = random.Random(3)
    for _ in range(500):
        weights = [rng.choice((0, 0, 0, 5, 30, 200)) for _ in range(rng.randrange(12))]
        # A text is cut where a whole window of lines weighs nothing.
        texts, open_from, gap = [], None, 0
        for i, w in enumerate([*weights, *[0] * html_blocks.WINDOW]):
            gap = 0 if w else gap + 1
            if w and open_from is None:
                open_from = i
            if open_from is not None and gap == html_blocks.WINDOW:
                texts.append((open_from, i - gap + 1))
                open_from = None
        best = lambda a, b: max(
            (sum(weights[max(i, a) : min(i + html_blocks.WINDOW, b)]) for i in range(a - 2, b)), default=0
        )
        level = min(html_blocks.SURGE, html_blocks.PEAK * max((best(*t) for t in texts), default=0))
        assert html_blocks.stretches(np.array(weights, dtype=float)) == [t for t in texts if best(*t) >= level]


@pytest.mark.parametrize("unit", ["<a ", "<script ", "<!", "</", "<a b='>", "<p><b>", "<ul><b><li>", '<div class="ad">'])
def test_main_text_reads_a_page_once(unit):
    def seconds(n):
        start = time.process_time()
        html_blocks.main_text(unit * n + "x")
        return time.process_time() - start

    # Reading again from every tag would take a hundred times as long.
    assert seconds(20_000) < 30 * seconds(2_000) + 0.3


def test_main_texts_of_a_table(spark):
    pages = spark.createDataFrame([(1, None), (1, "<p>x</p>"), (None, "<p>x</p>")], "page_id bigint, html string")
    pages = pages.withColumn("text", F.lit("clash"))
    got = html_blocks.main_texts(pages).select("row.page_id", "row.text", "text").collect()
    assert sorted(map(tuple, got), key=repr) == [(1, "clash", ""), (1, "clash", "x"), (None, "clash", "x")]
    assert html_blocks.main_texts(pages.limit(0)).count() == 0


def labelled(spark, mark):
    rng = random.Random(5)
    words = [f"w{n}" for n in range(300)]
    rows = []
    for n in range(400):
        w = rng.choices(words, k=60)
        bad = n % 2
        if bad:
            mark(w, rng)
        rows.append((n, " ".join(w), bad))
    docs = spark.createDataFrame([r[:2] for r in rows] + [(None, None), (1000, ""), (1000, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame(
        [(r[0], r[2]) for r in rows] + [(5000, 1), (None, 1), (7, None)], "doc_id bigint, mark int"
    )
    return docs.withColumn("score", F.lit("x")), labels, {r[0]: r[2] for r in rows}


def accuracy(scored, truth):
    rows = scored.select("row.doc_id", "held_out", "score").collect()
    assert all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    return len(rows), sum((r.score >= 0.5) == truth[r.doc_id] for r in held) / len(held)


def test_toxicity_on_texts_not_learned_from(spark):
    def mark(w, rng):
        for _ in range(3):
            w[rng.randrange(len(w))] = rng.choice(["idiot", "scum", "moron" + rng.choice("abcdefgh")])

    docs, labels, truth = labelled(spark, mark)
    n, right = accuracy(toxicity.score_toxicity(docs, labels, "mark"), truth)
    assert n == 403 and right >= 0.95
    one_class = labels.where("mark = 0")
    assert {r.score for r in toxicity.score_toxicity(docs, one_class, "mark").collect()} == {0.0}
    assert toxicity.score_toxicity(docs.limit(0), labels, "mark").count() == 0


def test_quality_on_texts_not_learned_from(spark):
    def mark(w, rng):
        w[:] = [x.upper() + rng.choice(["!!", "!"]) for x in w]

    docs, labels, truth = labelled(spark, mark)
    n, right = accuracy(quality.score_quality(docs, labels, "mark"), truth)
    assert n == 403 and right >= 0.97
    assert {r.score for r in quality.score_quality(docs, labels.limit(0), "mark").collect()} == {0.5}


def test_scores_do_not_depend_on_how_texts_are_chunked(monkeypatch):
    texts = [(t or "").encode() for t in edge_texts()]
    whole = quality.features(texts)
    monkeypatch.setattr("lectern.llm.common.CHUNK_BYTES", 500)
    assert np.allclose(whole, quality.features(texts))
