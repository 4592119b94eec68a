"""DuckDB SQL that the queries must agree with, where SQL can express them."""

from __future__ import annotations

from lectern.llm.decontaminate import WINDOW
from lectern.llm.licenses import CONTAINMENT, PHRASES, TEMPLATES, distinct_words
from lectern.llm.ngram_join import PERCENT
from lectern.llm.queries import MIX
from lectern.llm.secrets import BASE, RULES
from lectern.llm.shingles import WORDS
from lectern.llm.spelling import FORM_RATIO, LEAST_COUNT, LEAST_LETTERS, TYPO

WORD = r"[^\x20\x09-\x0D]+"


def _case(column: str, table: dict, default: str) -> str:
    whens = " ".join(f"WHEN {column} = '{k}' THEN {v!r}" for k, v in table.items())
    return f"CASE {whens} ELSE {default} END" if whens else default


def _share(children: str, parent: str, budget: str, name: str) -> str:
    """Water filling among siblings: the used-up ones first, the rest by weight."""
    w = f"PARTITION BY {parent} ORDER BY supply::DOUBLE / greatest(weight, 1), supply, {name}"
    return f"""
    SELECT *, CASE WHEN full_so_far THEN supply WHEN weight > 0
        THEN (({budget} - coalesce(sum(supply) FILTER (full_so_far) OVER (PARTITION BY {parent}), 0))::HUGEINT
              * weight // sum(weight) FILTER (NOT full_so_far) OVER (PARTITION BY {parent}))::BIGINT
        ELSE 0 END AS budget
    FROM (SELECT *, bool_and(used_up) OVER ({w} ROWS UNBOUNDED PRECEDING) AS full_so_far
        FROM (SELECT *, supply::HUGEINT * sum(weight) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
                <= ({budget} - coalesce(sum(supply) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::HUGEINT
                   * weight AS used_up
            FROM ({children})))"""


def mix_sql() -> str:
    one = str(MIX.default_weight)
    part, whole = MIX.share
    domains = _share(
        f"SELECT *, least(sum(t) OVER () * {part} // {whole}, sum(supply) OVER ())::BIGINT AS above, 1 AS root "
        "FROM (SELECT domain, sum(supply)::BIGINT AS supply, any_value(w1) AS weight, sum(tokens)::BIGINT AS t "
        "FROM leaves GROUP BY domain)",
        "root", "above", "domain",
    )
    languages = _share(
        "SELECT l.*, d.budget AS above FROM (SELECT domain, language, sum(supply)::BIGINT AS supply, "
        "any_value(w2) AS weight FROM leaves GROUP BY ALL) l JOIN by_domain d USING (domain)",
        "domain", "above", "language",
    )
    sources = _share(
        "SELECT l.*, w3 AS weight, b.budget AS above FROM leaves l JOIN by_language b USING (domain, language)",
        "domain, language", "above", "source",
    )
    return f"""
WITH docs AS (
    SELECT doc_id, {_case("source", MIX.domain_of, repr(MIX.default_domain))} AS domain,
        coalesce(lang, '') AS language, coalesce(source, '') AS source,
        coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS tokens
    FROM documents
), leaves AS (
    SELECT *, CASE WHEN least(w1, w2, w3) > 0 THEN tokens * {MIX.max_epochs} ELSE 0 END AS supply
    FROM (SELECT domain, language, source, sum(tokens)::BIGINT AS tokens,
        {_case("domain", MIX.domains, one)} AS w1, {_case("language", MIX.languages, one)} AS w2,
        {_case("source", MIX.sources, one)} AS w3
        FROM docs GROUP BY domain, language, source)
), by_domain AS ({domains}), by_language AS ({languages}), by_source AS ({sources}),
keyed AS (
    SELECT d.*, b.budget, b.budget // b.tokens AS epochs, b.budget % b.tokens AS part,
        md5('{MIX.seed}:' || (b.budget // b.tokens) || ':' || coalesce(d.doc_id::VARCHAR, '')) AS key
    FROM docs d JOIN by_source b USING (domain, language, source) WHERE b.supply > 0
), taken AS (
    SELECT *, epochs + (sum(tokens) OVER (PARTITION BY domain, language, source ORDER BY key
        RANGE UNBOUNDED PRECEDING) <= part)::INT AS n FROM keyed
)
SELECT doc_id, domain, language, source, tokens, unnest(range(n))::INT AS epoch, budget AS leaf_budget
FROM taken WHERE n > 0"""


LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def secrets_sql() -> str:
    """Gaps between matches and matches, with running sums of their lengths."""
    scans = []
    for rank, rule in enumerate(RULES):
        p = rule.pattern.replace("'", "''")
        scans.append(f"""
    SELECT row, '{rule.kind}' AS kind, {rank} AS rank, len(s[i]) AS span,
        list_sum(list_transform(gaps[:i], lambda x: len(x)))
        + coalesce(list_sum(list_transform(m[:i - 1], lambda x: len(x))), 0) + len(m[i]) - len(s[i]) AS start
    FROM (SELECT row, m, s, g, gaps, unnest(range(1, len(m) + 1)) AS i FROM (
        SELECT row, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {rule.group}) AS g,
            regexp_extract_all(text, '{p}', {rule.span}) AS s,
            string_split_regex(text, '{p}') AS gaps
        FROM docs WHERE regexp_matches(text, '{p}')))
    WHERE len(g[i]) >= {rule.least}""")
    kinds = ", ".join(
        f"count(*) FILTER (kind = '{k}')::BIGINT AS n_{k}" for k in BASE
    )
    base = ", ".join(f"'{k}'" for k in BASE)
    span = "kind || ':' || start::BIGINT || ':' || (start + span)::BIGINT"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({" UNION ALL ".join(scans)}),
per_row AS (
    SELECT row, {kinds},
        sha256(coalesce(string_agg({span}, ',' ORDER BY start, rank) FILTER (kind IN ({base})), '')) AS base_sha256,
        string_agg({span}, ',' ORDER BY start, rank) AS spans
    FROM spans GROUP BY row)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)},
    coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN per_row USING (row)"""


def licenses_sql() -> str:
    """Phrase places by position in the list of words, and every template against every line."""
    places = " UNION ALL ".join(
        f"SELECT row, unnest(list_filter(range(len(w)), lambda i: "
        + " AND ".join(f"w[i + {k + 1}] IS NOT DISTINCT FROM '{p}'" for k, p in enumerate(phrase.split()))
        + f")) AS start, '{label}' AS label FROM docs WHERE text LIKE '%{phrase.split()[0]}%'"
        for phrase, label in PHRASES.items()
    )
    part, whole = CONTAINMENT
    held = " UNION ALL ".join(
        f"SELECT row, '{label}' AS label, len(list_intersect(words, {distinct_words(t)!r})) / "
        f"{len(distinct_words(t))}.0::DOUBLE AS held FROM lines "
        f"WHERE {whole} * len(list_intersect(words, {distinct_words(t)!r})) >= {part * len(distinct_words(t))}"
        for t, label in TEMPLATES.items()
    )
    return f"""
WITH docs AS (
    SELECT row, doc_id, text, regexp_extract_all(text, '{LETTERS}') AS w
    FROM (SELECT row_number() OVER () AS row, doc_id, {FOLDED} AS text FROM documents)
), lines AS (
    SELECT row, regexp_extract_all(line, '{LETTERS}') AS words
    FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM docs)
), places AS ({places}),
base AS (
    SELECT row, count(*) AS n_base, min(start)::BIGINT AS first_word, max(start)::BIGINT AS last_word,
        list(DISTINCT label) AS labels FROM places GROUP BY row
), held AS (SELECT row, list(DISTINCT label) AS labels, max(held) AS held FROM ({held}) GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
    coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
    coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(h.labels, [])))), ','), '') AS labels,
    CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(held, 0.0) END::DOUBLE AS score
FROM docs d LEFT JOIN base b USING (row) LEFT JOIN held h USING (row)"""


def passages_sql() -> str:
    """All runs of words of the documents, as long as some window, joined with the windows."""
    words = f"regexp_extract_all({FOLDED}, '{LETTERS}') AS w"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, {words} FROM documents),
items AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, {words} FROM benchmark),
sized AS (SELECT item, w, least(len(w), {WINDOW}) AS n FROM items WHERE len(w) > 0),
windows AS (
    SELECT DISTINCT item, n, w[i:i + n - 1] AS gram
    FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized)
), grams AS (
    SELECT row, i, n, w[i:i + n - 1] AS gram FROM (
        SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM docs, (SELECT DISTINCT n FROM sized) WHERE len(w) >= n)
), hits AS (SELECT row, i, g.n, item FROM grams g JOIN windows v ON g.n = v.n AND g.gram = v.gram),
covered AS (
    SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(i, i + n)) AS p FROM hits) GROUP BY row
), found AS (
    SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT row, item FROM hits) GROUP BY row
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
    coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (row) LEFT JOIN found USING (row)"""


def exact_dedup_sql() -> str:
    return """
WITH docs AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS same FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY same) AS keep_id,
    count(*) OVER (PARTITION BY same)::BIGINT AS group_size,
    row_number() OVER (PARTITION BY same ORDER BY doc_id NULLS LAST) = 1 AS kept,
    sha256(same) AS text_sha256
FROM docs"""


def near_duplicates_sql() -> str:
    """Every pair of documents that share a shingle, then the least id within reach."""
    words = r"regexp_extract_all(" + FOLDED + ", '" + WORD + "') AS w"
    return f"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS row, doc_id, {words} FROM documents),
shingles AS (
    SELECT DISTINCT row, w[i:i + {WORDS - 1}] AS s
    FROM (SELECT row, w, unnest(range(1, greatest(len(w) - {WORDS - 2}, 2))) AS i FROM docs WHERE len(w) > 0)
), numbered AS (SELECT row, dense_rank() OVER (ORDER BY s) AS s FROM shingles),
sizes AS (SELECT row, count(*) AS n FROM numbered GROUP BY row),
pairs AS (
    SELECT x.row AS a, y.row AS b, count(*) AS shared
    FROM numbered x JOIN numbered y ON x.s = y.s AND x.row <> y.row GROUP BY ALL
), links AS (
    SELECT a, b FROM pairs JOIN sizes x ON x.row = a JOIN sizes y ON y.row = b
    WHERE 100 * shared >= {PERCENT} * (x.n + y.n - shared)
), reach(a, b) AS (
    SELECT row, row FROM docs
    UNION
    SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (SELECT a AS row, min(doc_id) AS component_id FROM reach JOIN docs ON row = b GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM docs LEFT JOIN sizes USING (row) JOIN least USING (row)"""


def crc_table_sql() -> str:
    """A CTE of the 256 entries of the CRC-32 table, made by its rule."""
    return """crc_steps(n, c, k) AS (
    SELECT range::BIGINT, range::BIGINT, 0 FROM range(256)
    UNION ALL
    SELECT n, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_steps WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY n) AS entries FROM crc_steps WHERE k = 8)"""


def crc_sql(text: str) -> str:
    """crc32 of a text's UTF-8 bytes, for rows joined with `crc_table`."""
    code = f"hex(encode({text}))"
    numbers = f"list_transform(range(0, len({code}) // 2), lambda i: ('0x' || {code}[2 * i + 1:2 * i + 2])::BIGINT)"
    return (
        f"xor(list_reduce(list_concat([4294967295::BIGINT], {numbers}), "
        "lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"
    )


def spelling_sql() -> str:
    """Words share a text with one letter masked (replaced), or one is the other without a letter."""
    return f"""
WITH RECURSIVE {crc_table_sql()},
runs AS (
    SELECT key, run, count(*) AS c FROM (
        SELECT coalesce(doc_id::VARCHAR, '') AS key, unnest(regexp_extract_all({FOLDED}, '[a-z\u00C0-\u00FF]+')) AS run
        FROM documents)
    WHERE len(run) >= {LEAST_LETTERS} GROUP BY key, run
), summed AS (SELECT run, c, {crc_sql("key || ':' || run")} AS h FROM runs, crc_table),
spelt AS (
    SELECT c, CASE WHEN h % {TYPO} = 0 THEN left(run, h % len(run)) || substring(run, (h % len(run)) + 2) ELSE run END AS word
    FROM summed
), words AS (
    SELECT word, sum(c)::BIGINT AS n FROM spelt WHERE len(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(c) >= {LEAST_COUNT}
), places AS (SELECT word, n, unnest(range(0, len(word))) AS i FROM words),
cut AS (
    SELECT DISTINCT word, n, i, left(word, i) || substring(word, i + 2) AS rest FROM places
), near AS (
    SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n
    FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION
    SELECT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
    UNION
    SELECT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
), best AS (
    SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS top, max(near_n) AS top_n FROM near GROUP BY word
), formed AS (
    SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top_n >= {FORM_RATIO} * w.n THEN top END AS form,
        CASE WHEN top_n >= {FORM_RATIO} * w.n THEN top_n END AS form_n
    FROM words w LEFT JOIN best b ON w.word = b.word
), chain(word, root, steps) AS (
    SELECT word, word, 0 FROM formed
    UNION ALL
    SELECT c.word, f.form, steps + 1 FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL
), ends AS (SELECT word, arg_max(root, steps) AS root FROM chain GROUP BY word)
SELECT f.word, form, root, n, n_near, form_n FROM formed f JOIN ends e ON e.word = f.word"""


def merkle_sql() -> str:
    """Level by level; paths by the place's bits, and the tampered leaves folded along them."""

    def leaf(n_chars: str) -> str:
        fields = ("doc_id", "source", "lang", n_chars, "text")
        return "sha256(" + " || ".join(
            f"coalesce(strlen(({f})::VARCHAR) || ':' || ({f})::VARCHAR, '-')" for f in fields
        ) + ")"

    def climb(name: str, base: str) -> str:
        """All nodes of all trees with the height of each tree."""
        return f"""{name}_sizes AS (
    SELECT tree, ceil(log2(count(*)))::BIGINT AS height FROM ({base}) GROUP BY tree
), {name}(tree, level, place, digest) AS (
    SELECT tree, 0::BIGINT, place, digest FROM ({base})
    UNION ALL
    SELECT n.tree, any_value(level) + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place))
    FROM {name} n JOIN {name}_sizes s ON n.tree = s.tree WHERE level < height GROUP BY n.tree, place // 2
)"""

    return f"""
WITH RECURSIVE {crc_table_sql()},
leaves AS (
    SELECT doc_id, coalesce('=' || lang, '') AS tree, {leaf("n_chars")} AS leaf,
        CASE WHEN {crc_sql("coalesce(doc_id::VARCHAR, '')")} % 7 = 0
            THEN {leaf("n_chars + 1")} ELSE {leaf("n_chars")} END AS claimed
    FROM documents, crc_table
), rows AS (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, claimed) - 1 AS place FROM leaves
), {climb("node", "SELECT tree, place, leaf AS digest FROM rows")},
subroots AS (
    SELECT n.tree AS member, digest, row_number() OVER (ORDER BY n.tree) - 1 AS place
    FROM node n JOIN node_sizes s ON n.tree = s.tree WHERE level = height
), {climb("top", "SELECT 0 AS tree, place, digest FROM subroots")},
root AS (SELECT digest AS root FROM top ORDER BY level DESC LIMIT 1),
ways AS (
    SELECT r.tree AS tree, r.place AS own, l.level, (r.place >> l.level) & 1 AS bit, n.digest AS sibling
    FROM rows r JOIN node_sizes s ON r.tree = s.tree, range(0, s.height) AS l(level)
    LEFT JOIN node n ON n.tree = r.tree AND n.level = l.level AND n.place = xor(r.place >> l.level, 1)
), upper_ways AS (
    SELECT u.member, l.level, (u.place >> l.level) & 1 AS bit, n.digest AS sibling
    FROM subroots u, (SELECT height FROM top_sizes) s, range(0, s.height) AS l(level)
    LEFT JOIN top n ON n.level = l.level AND n.place = xor(u.place >> l.level, 1)
), steps AS (
    SELECT tree, own, level, bit, sibling FROM ways
    UNION ALL
    SELECT r.tree, r.place, s.height + w.level, w.bit, w.sibling
    FROM rows r JOIN upper_ways w ON w.member = r.tree JOIN node_sizes s ON s.tree = r.tree
), paths AS (
    SELECT tree, own, list(sibling ORDER BY level) AS siblings, list(bit ORDER BY level) AS bits FROM steps GROUP BY ALL
), folds(tree, own, k, digest) AS (
    SELECT tree, place, 1, claimed FROM rows
    UNION ALL
    SELECT f.tree, f.own, k + 1, sha256(CASE WHEN siblings[k] IS NULL THEN f.digest
        WHEN bits[k] = 1 THEN siblings[k] || f.digest ELSE f.digest || siblings[k] END)
    FROM folds f JOIN paths p ON f.tree = p.tree AND f.own = p.own WHERE k <= len(bits)
), ends AS (SELECT tree, own, arg_max(digest, k) AS folded_root FROM folds GROUP BY tree, own)
SELECT doc_id, leaf, u.digest AS subroot, root,
    sha256(coalesce(array_to_string(list_filter(p.siblings, lambda x: x IS NOT NULL), ''), '')) AS proof_sha256,
    folded_root, folded_root = root AS verified
FROM rows r JOIN subroots u ON u.member = r.tree JOIN ends e ON e.tree = r.tree AND e.own = r.place
LEFT JOIN paths p ON p.tree = r.tree AND p.own = r.place, root"""


def llm_oracles() -> dict[str, str]:
    return {
        "op1_decontaminate": passages_sql(),
        "op2_exact_dedup": exact_dedup_sql(),
        "op3_secrets": secrets_sql(),
        "op4_ngram_join": near_duplicates_sql(), "op9_licenses": licenses_sql(), "op10_mix": mix_sql(),
        "op11_spelling": spelling_sql(),
        "op13_merkle": merkle_sql(),
    }
