"""DuckDB SQL for each query, written from the operators' definitions.

Every text starts with the reader's tables as FIXTURES.md defines them. Shapes
differ from the Spark plans where the definition allows it.
"""

from __future__ import annotations

TABLES = r"""
WITH items AS (
  SELECT doc_id AS item_id, source AS feed_id, lang,
         split_part(text, chr(10), 1) AS title,
         'https://' || source || '.example.com/' || lang || '/' || doc_id AS url,
         text,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id % 720 AS INT)) AS created_at
  FROM documents),
feeds AS (
  SELECT DISTINCT source AS feed_id, CAST(regexp_extract(source, '[0-9]+') AS BIGINT) AS feed_no,
         'Feed ' || regexp_extract(source, '[0-9]+') AS title, source || '.example.com' AS host
  FROM documents),
groups AS (
  SELECT range AS group_id, 'Group ' || range AS title FROM range(0, 6)),
feed_groups AS (
  SELECT feed_no % 4 AS group_id, feed_id FROM feeds
  UNION ALL
  SELECT CAST(4 AS BIGINT), feed_id FROM feeds WHERE feed_no % 5 = 0),
favicons AS (
  SELECT feed_id, 'data:image/gif;base64,' || feed_no AS data FROM feeds WHERE feed_no % 3 <> 0),
state_events AS (
  SELECT event_id, user_id AS account_id, CAST(json_extract(props, '$.k') AS BIGINT) AS item_id,
         CASE event_type WHEN 'view' THEN 'read' WHEN 'signup' THEN 'unread'
              WHEN 'purchase' THEN 'save' WHEN 'error' THEN 'unsave' WHEN 'click' THEN 'open' END
           AS action, ts
  FROM events),
numbered AS (
  SELECT *, row_number() OVER (
           PARTITION BY account_id, item_id, action IN ('read', 'unread')
           ORDER BY ts DESC, event_id DESC) AS back
  FROM state_events WHERE action <> 'open'),
current_flags AS (
  SELECT account_id, item_id, bool_or(action = 'read') AS is_read,
         bool_or(action = 'save') AS is_saved
  FROM numbered WHERE back = 1 GROUP BY account_id, item_id),
mine AS (SELECT item_id, is_read, is_saved FROM current_flags WHERE account_id = 7),
flagged AS (
  SELECT i.*, coalesce(m.is_read, false) AS is_read, coalesce(m.is_saved, false) AS is_saved
  FROM items i LEFT JOIN mine m ON m.item_id = i.item_id),
item_overrides AS (
  SELECT doc_id AS item_id, CASE WHEN toxic = 1 THEN '[removed]' END AS title,
         'edited ' || doc_id AS text FROM labels),
local_copy AS (SELECT item_id, feed_id, title, text FROM items),
remote_copy AS (
  SELECT CASE WHEN item_id % 11 = 5 THEN item_id + 1000000000000 ELSE item_id END AS item_id,
         feed_id, title, CASE WHEN item_id % 7 = 0 THEN text || '!' ELSE text END AS text
  FROM items),
pages_added AS (
  SELECT page_id, url, html,
         '<img src="/i/' || (page_id % 40) || '.png">' AS image,
         CASE WHEN page_id % 3 = 0 THEN '<iframe src="/v/' || page_id || '"></iframe>' ELSE '' END AS video,
         CASE WHEN page_id % 5 = 0
              THEN '<aside title=it''s class=''wide AD''><aside>Buy <div>me</div></aside>'
                   || '<div class="ad">twice</div>BUY NOW</aside>' ELSE '' END AS advert,
         CASE WHEN page_id % 6 = 1 THEN '<p title="class=''ad'' >">Still shown</p>' ELSE '' END AS shown,
         CASE WHEN page_id % 4 = 0
              THEN '<div class="user comments"><div>Comment on ' || page_id || '</div><div>Answer to <div>'
                   || page_id || '</div></div></div>' ELSE '' END AS comments
  FROM pages),
hosted AS (
  SELECT page_id, url, html, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host
  FROM pages),
patterns AS (
  SELECT * FROM (VALUES ('example.com', 'article'), ('example.net', 'article'),
                        ('blog.tionsh.example.net', 'h1')) AS t(host_suffix, body_pattern)),
matched AS (
  SELECT h.page_id, h.host, h.html, max_by(p.host_suffix, length(p.host_suffix)) AS host_suffix,
         max_by(p.body_pattern, length(p.host_suffix)) AS body_pattern
  FROM hosted h LEFT JOIN patterns p
    ON h.host = p.host_suffix OR ends_with(h.host, '.' || p.host_suffix)
  GROUP BY ALL),
words AS (
  SELECT item_id, len(ws) AS item_length, unnest(ws) AS term,
         unnest(range(0, len(ws))) AS position
  FROM (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'),
                                    lambda w: w <> '') AS ws FROM items))
"""

UNSEEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
SCRIPTS = r"(?is)<script\b.*?</script\s*>"
ADS = r'(?is)<div\b[^>]*\bclass="ad"[^>]*>.*?</div\s*>'
BLOCKS = (
    r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|footer|form|h[1-6]|"
    r"head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>"
)


def _drop(html: str, *patterns: str, by: str = "") -> str:
    for pattern in patterns:
        html = f"regexp_replace({html}, '{pattern}', '{by}', 'g')"
    return html


def _squeeze(text: str) -> str:
    return rf"trim(regexp_replace({text}, '[ \t\r\n\f]+', ' ', 'g'))"


def _plain(markup: str, by: str = " ") -> str:
    text = f"regexp_replace({markup}, '<[^>]*>', '{by}', 'g')"
    for name, char in (
        ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("apos", "''"), ("nbsp", " "),
        ("copy", "©"), ("middot", "·"), ("amp", "&"),
    ):
        text = f"regexp_replace({text}, '&{name}{';' if name == 'apos' else ';?'}', '{char}', 'g')"
    return _squeeze(text)


def _inside(tag: str, html: str = "html", greedy: bool = True) -> str:
    seen = _drop(html, UNSEEN, by=" ")
    body = ".*" if greedy else ".*?"
    return rf"regexp_extract({seen}, '(?is)<{tag}\b[^>]*>({body})</{tag}\s*>', 1)"


def _blocks(html: str = "html") -> str:
    """From the first long and dense block to the last one, all that have text."""
    bare = _drop(_drop(html, UNSEEN, by=" "), ADS)
    shown = _squeeze("regexp_replace(b, '<[^>]*>', '', 'g')")
    measured = (
        f"list_transform(string_split_regex({bare}, '{BLOCKS}'), lambda b: {{'s': {shown}, "
        f"'d': length({shown}) >= 80 AND length({shown}) >= length(b) * 0.6}})"
    )
    flags = "list_transform(m, lambda x: x.d)"
    return (
        f"list_transform([{measured}], lambda m: CASE WHEN list_contains({flags}, true) THEN "
        f"array_to_string(list_transform(list_filter(m[list_position({flags}, true):"
        f"len(m) - list_position(list_reverse({flags}), true) + 1], lambda x: x.s <> ''), "
        f"lambda x: {_plain('x.s', by='')}), chr(10)) ELSE '' END)[1]"
    )


def _matches(html: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({html}, '{pattern}')) AS BIGINT)"


def _escaped(text: str) -> str:
    for char, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot")):
        text = f"replace({text}, '{char}', '&{name};')"
    return text


def _absolute(ref: str) -> str:
    site = "regexp_extract(url, '^[^:/?#]+://[^/?#]*')"
    return f"""CASE WHEN {ref} LIKE 'http://%' OR {ref} LIKE 'https://%' THEN {ref}
        WHEN {ref} LIKE '//%' THEN split_part(url, ':', 1) || ':' || {ref}
        WHEN {ref} LIKE '/%' THEN {site} || {ref} END"""


def _friendly(ts: str, as_of: str) -> str:
    n = f"date_sub('second', {ts}, {as_of})"
    days = f"date_diff('day', {ts}, {as_of})"
    return f"""CASE WHEN {ts} > {as_of} THEN strftime({ts}, '%-d %b %Y')
        WHEN {n} < 60 THEN 'just now'
        WHEN {n} < 120 THEN '1 minute ago'
        WHEN {n} < 3600 THEN ({n} // 60) || ' minutes ago'
        WHEN {days} = 0 AND {n} < 7200 THEN '1 hour ago'
        WHEN {days} = 0 THEN ({n} // 3600) || ' hours ago'
        WHEN {days} = 1 THEN 'Yesterday'
        WHEN {days} < 7 THEN dayname({ts})
        WHEN year({ts}) = year({as_of}) THEN strftime({ts}, '%a %-d %b')
        ELSE strftime({ts}, '%-d %b %Y') END"""


MEASURES = """count(*) AS total, CAST(sum(CASE WHEN is_read THEN 0 ELSE 1 END) AS BIGINT) AS unread,
    CAST(sum(CASE WHEN is_saved THEN 1 ELSE 0 END) AS BIGINT) AS saved"""
LINKS = rf"""
  (SELECT item_id, {_absolute("ref")} AS url FROM (
     SELECT page_id AS item_id, url,
       unnest(regexp_extract_all({_drop("html", UNSEEN, by=" ")},
              '(?is)<a\b[^>]*\bhref="([^"]*)"', 1)) AS ref
     FROM pages))
"""
LATER = "TIMESTAMP '2024-01-29 18:30:00'"
TERMS = "('the', 'worthless', 'with')"

GROUP_COUNTS = f"""
  SELECT group_id, count(DISTINCT item_id) AS total,
         count(DISTINCT CASE WHEN NOT is_read THEN item_id END) AS unread,
         count(DISTINCT CASE WHEN is_saved THEN item_id END) AS saved
  FROM flagged JOIN feed_groups USING (feed_id)
  GROUP BY GROUPING SETS ((group_id), ())
"""
PHRASE_HITS = """
  SELECT a.item_id, count(*) AS hits
  FROM words a JOIN words b ON a.item_id = b.item_id AND b.position = a.position + 1
  WHERE a.term = 'of' AND b.term = 'the' GROUP BY a.item_id
"""
RANKED = f"""
        , tf AS (SELECT term, item_id, CAST(count(*) AS DOUBLE) AS tf,
                        CAST(any_value(item_length) AS DOUBLE) AS dl FROM words
                 WHERE term IN {TERMS} GROUP BY term, item_id),
        df AS (SELECT term, count(*) AS n FROM tf GROUP BY term),
        corpus AS (SELECT count(DISTINCT item_id) AS docs,
                          count(*) / CAST(count(DISTINCT item_id) AS DOUBLE) AS mean FROM words)
        SELECT item_id, round(sum(ln(1.0::DOUBLE + (docs - n + 0.5::DOUBLE) / (n + 0.5::DOUBLE))
                 * tf * 2.2::DOUBLE
                 / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))), 6) AS score
        FROM tf JOIN df USING (term), corpus
        GROUP BY item_id ORDER BY score DESC, item_id LIMIT 20"""
LATER_WORDS = r"""
  later_words AS (
  SELECT item_id, len(ws) AS item_length, unnest(ws) AS term, unnest(range(0, len(ws))) AS position
  FROM (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'),
                                    lambda w: w <> '') AS ws FROM remote_copy))
"""
UPSERTED = """
  SELECT coalesce(r.item_id, l.item_id) AS item_id,
         CASE WHEN r.item_id IS NOT NULL THEN r.feed_id ELSE l.feed_id END AS feed_id,
         CASE WHEN r.item_id IS NOT NULL THEN r.title ELSE l.title END AS title,
         md5(CASE WHEN r.item_id IS NOT NULL THEN r.text ELSE l.text END) AS text_md5
  FROM local_copy l FULL JOIN remote_copy r ON l.item_id = r.item_id
"""
VIEWED_FEEDS = """
  renamed AS (SELECT feed_id, CASE WHEN feed_no % 7 = 0 THEN 'My feed ' || feed_no ELSE title END
                AS feed_title, feed_no FROM feeds),
  places AS (
    SELECT g.group_id, g.title AS group_title, f.feed_id, f.feed_title
    FROM (SELECT b.group_id, b.feed_id FROM feed_groups b JOIN feeds USING (feed_id)
          WHERE feed_no % 7 <> 0
          UNION ALL SELECT 3, feed_id FROM feeds WHERE feed_no % 7 = 0) b
    JOIN groups g ON g.group_id = b.group_id JOIN renamed f ON f.feed_id = b.feed_id)
"""
WINDOWS = """
  SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '2024-01-01') AS window_start,
         count(*) FILTER (action = 'read') AS reads, count(*) FILTER (action = 'save') AS saves,
         count(*) AS events
"""
FLAGS_AFTER = """
  SELECT account_id, item_id,
         coalesce(arg_max(action = 'read', (ts, event_id)) FILTER (action IN ('read', 'unread')),
                  false) AS is_read,
         coalesce(arg_max(action = 'save', (ts, event_id)) FILTER (action IN ('save', 'unsave')),
                  false) AS is_saved
  FROM {log} WHERE action <> 'open' GROUP BY account_id, item_id
"""

QUERIES = {
    # Sources, sinks, catalog
    "load_tables": """
        SELECT 'documents' AS table_name, doc_id AS id,
               md5(text || '|' || lang || '|' || source || '|' || n_chars) AS digest FROM documents
        UNION ALL SELECT 'pages', page_id, md5(url || '|' || html) FROM pages
        UNION ALL SELECT 'events', event_id, md5(epoch_us(ts) || '|' || user_id || '|' || event_type || '|'
                 || printf('%.12e', value) || '|' || props)
        FROM events
        UNION ALL SELECT 'labels', doc_id, md5(quality || '|' || toxic) FROM labels""",
    "ingest_snapshot": "SELECT event_id, account_id, item_id, action, ts FROM state_events",
    "ingest_nested": """
        SELECT item_id, feed_id, lang, title, lang || ',' || feed_id AS tags
        FROM items WHERE lang <> 'de'""",
    "ingest_rejected": "SELECT item_id AS landing_id FROM items WHERE lang = 'de'",
    "build_views": """
        SELECT g.group_id, g.title, count(DISTINCT b.feed_id) AS feeds, count(i.item_id) AS total
        FROM groups g LEFT JOIN feed_groups b ON b.group_id = g.group_id
        LEFT JOIN items i ON i.feed_id = b.feed_id GROUP BY g.group_id, g.title""",
    "feed_activity": """
        SELECT account_id, feed_id, CAST(sum(CAST(is_read AS INT)) AS BIGINT) AS read,
               CAST(sum(CAST(is_saved AS INT)) AS BIGINT) AS saved
        FROM current_flags JOIN items USING (item_id) GROUP BY account_id, feed_id""",
    "write_local_copy": UPSERTED,
    "link_list": "SELECT item_id, title, url FROM items ORDER BY item_id",
    # Sync
    "sync_diff": """
        SELECT k.item_id,
          CASE WHEN l.item_id IS NULL THEN 'new' WHEN r.item_id IS NULL THEN 'removed'
               WHEN (l.feed_id, l.title, l.text) IS DISTINCT FROM (r.feed_id, r.title, r.text)
               THEN 'changed' ELSE 'same' END AS status
        FROM (SELECT item_id FROM local_copy UNION SELECT item_id FROM remote_copy) k
        LEFT JOIN local_copy l ON l.item_id = k.item_id
        LEFT JOIN remote_copy r ON r.item_id = k.item_id""",
    "sync_upsert": UPSERTED,
    "sync_changes": """
        SELECT coalesce(l.item_id, r.item_id) AS item_id,
               CASE WHEN l.item_id IS NULL THEN 'new' WHEN r.item_id IS NULL THEN 'removed' ELSE 'changed' END AS status
        FROM local_copy l FULL JOIN remote_copy r ON l.item_id = r.item_id
        WHERE l.item_id IS NULL OR r.item_id IS NULL OR l.text <> r.text""",
    "sync_incremental": UPSERTED,
    "new_since": """
        SELECT item_id, feed_id, title FROM remote_copy
        WHERE item_id > (SELECT max(item_id) FROM local_copy)""",
    "removed_items": """
        SELECT item_id, feed_id, title FROM local_copy
        WHERE item_id NOT IN (SELECT item_id FROM remote_copy)""",
    "unchanged_rows": """
        SELECT l.item_id, l.feed_id, l.title FROM local_copy l JOIN remote_copy r
          ON l.item_id = r.item_id AND l.feed_id = r.feed_id AND l.title = r.title
         AND l.text = r.text""",
    "changed_rows": """
        SELECT l.item_id, l.feed_id, l.title FROM local_copy l
        WHERE NOT EXISTS (SELECT 1 FROM remote_copy r WHERE l.item_id = r.item_id
          AND l.feed_id = r.feed_id AND l.title = r.title AND l.text = r.text)""",
    "dedupe_items": """
        SELECT item_id, feed_id, title, copies FROM (
          SELECT *, count(*) OVER (PARTITION BY lower(text)) AS copies,
                 row_number() OVER (PARTITION BY lower(text) ORDER BY item_id) AS n FROM items)
        WHERE n = 1""",
    "union_accounts": """
        SELECT CAST(1 AS BIGINT) AS account_id, item_id, title, CAST(NULL AS VARCHAR) AS feed_id
        FROM local_copy
        UNION ALL SELECT 2, item_id, title, feed_id FROM remote_copy""",
    # Hierarchy, listings, counts
    "group_feeds": """
        SELECT g.group_id, g.title AS group_title, f.feed_id, f.title AS feed_title
        FROM groups g, feed_groups b, feeds f
        WHERE g.group_id = b.group_id AND f.feed_id = b.feed_id""",
    "item_listing": """
        SELECT feed_id, item_id, title, created_at, position FROM (
          SELECT *, row_number() OVER (PARTITION BY feed_id ORDER BY created_at DESC, item_id DESC)
            AS position FROM items) WHERE position <= 5""",
    "latest_items": """
        SELECT feed_id, item_id, title, created_at FROM items
        ORDER BY created_at DESC, item_id DESC LIMIT 25""",
    "feed_counts": f"SELECT feed_id, {MEASURES} FROM flagged GROUP BY feed_id",
    "account_counts": """
        SELECT a.account_id, a.feed_id, count(*) AS total,
               count(*) FILTER (NOT coalesce(c.is_read, false)) AS unread,
               count(*) FILTER (coalesce(c.is_saved, false)) AS saved
        FROM (SELECT DISTINCT account_id, feed_id FROM state_events JOIN items USING (item_id)
              WHERE action = 'open') a
        JOIN items i ON i.feed_id = a.feed_id
        LEFT JOIN current_flags c ON c.account_id = a.account_id AND c.item_id = i.item_id
        GROUP BY a.account_id, a.feed_id""",
    "group_counts": f"""
        SELECT CAST(group_id AS VARCHAR) AS group_id, total, unread, saved FROM ({GROUP_COUNTS})""",
    "zero_count_groups": f"""
        SELECT g.group_id, g.title, coalesce(c.total, 0) AS total, coalesce(c.unread, 0) AS unread,
               coalesce(c.saved, 0) AS saved
        FROM groups g LEFT JOIN ({GROUP_COUNTS}) c ON c.group_id = g.group_id""",
    "groups_with_unread": """
        SELECT group_id, title FROM groups g WHERE EXISTS (
          SELECT 1 FROM feed_groups b JOIN flagged i USING (feed_id)
          WHERE b.group_id = g.group_id AND NOT i.is_read)""",
    "counts_rollup": f"""
        SELECT CAST(group_id AS VARCHAR) AS group_id, feed_id,
               CAST(grouping(group_id, feed_id) AS BIGINT) AS level, {MEASURES}
        FROM flagged JOIN feed_groups USING (feed_id) GROUP BY ROLLUP (feed_groups.group_id, feed_id)""",
    "regroup_items": f"""
        SELECT feed_id, lang, day, CAST(is_read AS VARCHAR) AS is_read, level, total, unread,
               saved FROM (
          SELECT feed_id, lang, day, is_read,
                 CAST(grouping(feed_id, lang, day, is_read) AS BIGINT) AS level, {MEASURES}
          FROM (SELECT *, strftime(created_at, '%Y-%m-%d') AS day FROM flagged)
          GROUP BY GROUPING SETS ((feed_id), (lang), (day), (is_read), (lang, is_read)))""",
    "regroup_by_group": f"""
        SELECT group_id, lang, CAST(0 AS BIGINT) AS level, {MEASURES}
        FROM flagged JOIN feed_groups USING (feed_id) GROUP BY group_id, lang""",
    "counts_cube": f"""
        SELECT feed_id, lang, CAST(grouping(feed_id, lang) AS BIGINT) AS level, {MEASURES}
        FROM flagged GROUP BY CUBE (feed_id, lang)""",
    # State, preferences, overrides
    "current_state": "SELECT account_id, item_id, is_read, is_saved FROM current_flags",
    "state_as_of": """
        SELECT o.event_id AS sync_id, o.account_id, o.item_id, o.ts,
               coalesce(s.action = 'read', false) AS is_read
        FROM (SELECT * FROM state_events WHERE action = 'open') o
        ASOF LEFT JOIN (SELECT * FROM state_events WHERE action IN ('read', 'unread')) s
          ON o.account_id = s.account_id AND o.item_id = s.item_id AND o.ts >= s.ts""",
    "unread_items": "SELECT item_id, feed_id, title FROM flagged WHERE NOT is_read",
    "saved_items": "SELECT item_id, feed_id, title FROM flagged WHERE is_saved",
    "mark_read": """
        SELECT m.mode, i.item_id FROM items i JOIN items p ON p.item_id = 140
               AND i.feed_id = p.feed_id,
             (VALUES ('above'), ('below'), ('all')) AS m(mode)
        WHERE m.mode = 'all'
           OR (m.mode = 'above' AND (i.created_at > p.created_at
               OR (i.created_at = p.created_at AND i.item_id > p.item_id)))
           OR (m.mode = 'below' AND (i.created_at < p.created_at
               OR (i.created_at = p.created_at AND i.item_id < p.item_id)))""",
    "apply_marks": FLAGS_AFTER.format(
        log="""(SELECT * FROM state_events UNION ALL
          SELECT i.item_id + 1000000000000, 7, i.item_id, 'read', TIMESTAMP '2024-02-01'
          FROM items i JOIN items p ON p.item_id = 140 AND i.feed_id = p.feed_id
          WHERE (i.created_at, i.item_id) > (p.created_at, p.item_id))"""
    ),
    "toggle_history": """
        SELECT event_id, account_id, item_id, ts, from_state, to_state,
               CAST(sum(CAST(from_state <> to_state AS INT)) OVER (
                 PARTITION BY account_id, item_id ORDER BY ts, event_id) AS BIGINT) AS flips
        FROM (SELECT *, action = 'save' AS to_state,
                     coalesce(lag(action = 'save') OVER (
                       PARTITION BY account_id, item_id ORDER BY ts, event_id), false)
                       AS from_state
              FROM state_events WHERE action IN ('save', 'unsave'))""",
    "preferences": """
        SELECT account_id, coalesce(any_value(v) FILTER (k = 'click'), 0.0::DOUBLE) AS click,
               coalesce(any_value(v) FILTER (k = 'error'), 0.0::DOUBLE) AS error,
               coalesce(any_value(v) FILTER (k = 'purchase'), 10.0::DOUBLE) AS purchase,
               coalesce(any_value(v) FILTER (k = 'signup'), 1.0::DOUBLE) AS signup,
               coalesce(any_value(v) FILTER (k = 'view'), 5.0::DOUBLE) AS view
        FROM (SELECT user_id AS account_id, event_type AS k, value AS v FROM events
              QUALIFY row_number() OVER (PARTITION BY user_id, event_type
                                         ORDER BY ts DESC, event_id DESC) = 1)
        GROUP BY account_id""",
    "apply_overrides": """
        SELECT i.item_id, i.feed_id, coalesce(o.title, i.title) AS title,
               md5(coalesce(o.text, i.text)) AS text_md5
        FROM items i LEFT JOIN item_overrides o ON o.item_id = i.item_id""",
    "apply_view_overrides": f"""
        , {VIEWED_FEEDS} SELECT group_id, group_title, feed_id, feed_title FROM places""",
    # Article text and links
    "match_site_pattern": "SELECT page_id, host, host_suffix, body_pattern FROM matched",
    "clean_article": f"SELECT page_id, {_plain(_inside('article'))} AS text FROM pages",
    "clean_article_by_pattern": f"""
        SELECT page_id, host_suffix,
               CASE body_pattern WHEN 'article' THEN {_plain(_inside('article'))}
                    WHEN 'h1' THEN {_plain(_inside('h1', greedy=False))}
                    ELSE {_blocks()} END AS text
        FROM matched""",
    # The given pages have no nested elements; what was added to them is known part by part.
    "strip_distractions": f"""
        SELECT page_id, replace({_drop("html", SCRIPTS, ADS)}, '</article>', image
                 || CASE WHEN shown <> '' THEN '<!-- <script> -->' || shown || '<!-- </div> -->' ELSE '' END
                 || comments || '</article>') AS html,
               {_matches("html", SCRIPTS)} AS scripts,
               CAST(video <> '' AND html LIKE '%</article>%' AS BIGINT) AS videos,
               {_matches(_drop("html", SCRIPTS), ADS)}
                 + CAST(advert <> '' AND html LIKE '%</article>%' AS BIGINT) AS ads
        FROM pages_added""",
    "split_comments": f"""
        SELECT page_id, replace({_drop("html", UNSEEN, by=" ")}, '</article>', image || video || advert
                 || CASE WHEN shown <> '' THEN ' ' || shown || ' ' ELSE '' END || '</article>') AS main,
               CASE WHEN comments <> '' AND html LIKE '%</article>%'
                    THEN 'Comment on ' || page_id || ' Answer to ' || page_id END AS comments
        FROM pages_added""",
    "reader_view": f"SELECT page_id, {_blocks()} AS text FROM pages",
    "article_page": f"""
        SELECT item_id, '<html><head><title>' || {_escaped("title")}
          || '</title></head><body><h1><a href="' || {_escaped("url")} || '">'
          || {_escaped("title")} || '</a></h1><div>' || {_escaped("text")}
          || '</div></body></html>' AS page FROM items""",
    "article_pages_written": f"""
        SELECT item_id, md5('<html><head><title>' || {_escaped("later")}
          || '</title></head><body><h1><a href="' || {_escaped("url")} || '">'
          || {_escaped("later")} || '</a></h1><div>' || {_escaped("text")}
          || '</div></body></html>') AS page_md5,
          CASE WHEN feed_id = 'src3' THEN 'changed' END AS status
        FROM (SELECT *, CASE WHEN feed_id = 'src3' THEN title || '!' ELSE title END AS later FROM items)""",
    "alternative_url": """
        SELECT i.item_id, i.feed_id, i.url,
               CASE WHEN f.feed_no % 2 = 0
                    THEN 'https://fulltext.example/extract?url=' || url_encode(i.url)
                    ELSE i.url END AS read_url
        FROM items i JOIN feeds f ON f.feed_id = i.feed_id""",
    "backfill_titles": f"""
        SELECT page_id AS item_id, {_plain(_inside('title', greedy=False))} AS title FROM pages""",
    "extraction_report": f"""
        SELECT host, count(*) AS pages, round(avg(CAST(n = 0 AS INT)), 6) AS empty_share,
               round(avg(CAST(n < 200 AS INT)), 6) AS tiny_share, round(avg(n), 6) AS mean_chars,
               quantile_cont(CAST(n AS DOUBLE), 0.5) AS median_chars
        FROM (SELECT host, length({_blocks()}) AS n FROM hosted) GROUP BY host""",
    "canonical_url": """
        SELECT page_id, url,
               CASE WHEN bare LIKE '%/' THEN left(bare, -1) WHEN bare LIKE '%.html'
                    THEN left(bare, -5) ELSE bare END AS canonical_url
        FROM (SELECT page_id, url, split_part(split_part(url, '#', 1), '?', 1) AS bare
              FROM pages)""",
    "extract_links": f"SELECT item_id, url FROM {LINKS} WHERE url IS NOT NULL",
    "hot_links": f"""
        SELECT rank, url, items FROM (
          SELECT dense_rank() OVER (ORDER BY items DESC) AS rank, url, items FROM (
            SELECT url, count(DISTINCT item_id) AS items FROM {LINKS}
            WHERE url IS NOT NULL GROUP BY url)) WHERE rank <= 3""",
    "hot_links_estimate": f"""
        SELECT url, count(DISTINCT item_id) AS items, true AS near FROM {LINKS}
        WHERE url IS NOT NULL GROUP BY url""",
    "hot_links_merged": f"""
        SELECT url, count(DISTINCT item_id) AS items FROM {LINKS} WHERE url IS NOT NULL GROUP BY url""",
    "image_manifest": f"""
        SELECT DISTINCT url, page_id AS item_id, md5(url) AS cache_key FROM (
          SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+') || '/i/' || (page_id % 40)
                 || '.png' AS url FROM pages WHERE html LIKE '%</article>%')""",
    # Display data
    "with_favicons": """
        SELECT f.feed_id, f.feed_no, f.title, f.host,
               coalesce(i.data, 'data:image/gif;base64,default') AS icon
        FROM feeds f LEFT JOIN favicons i ON i.feed_id = f.feed_id""",
    "friendly_dates": f"""
        SELECT kind, id, ts, {_friendly("ts", LATER)} AS "when" FROM (
          SELECT 'event' AS kind, event_id AS id, ts FROM state_events
          UNION ALL SELECT 'item', item_id, created_at FROM items)""",
    "day_buckets": f"""
        SELECT CASE WHEN CAST(created_at AS DATE) > DATE '2024-01-29' THEN 'Upcoming'
                    WHEN CAST(created_at AS DATE) = DATE '2024-01-29' THEN 'Today'
                    WHEN CAST(created_at AS DATE) = DATE '2024-01-28' THEN 'Yesterday'
                    WHEN CAST(created_at AS DATE) > DATE '2024-01-22' THEN 'This week'
                    ELSE 'Older' END AS section, count(*) AS items
        FROM items GROUP BY section""",
    "reader_list": f"""
        , {VIEWED_FEEDS}
        SELECT p.group_id, p.group_title, p.feed_id, p.feed_title,
               coalesce(v.data, 'data:image/gif;base64,default') AS icon, i.item_id,
               coalesce(nullif({_squeeze("coalesce(o.title, i.title)")}, ''), i.url) AS title,
               i.url, {_friendly("i.created_at", "TIMESTAMP '2024-02-01 00:00:00'")} AS "when",
               i.is_saved, i.created_at
        FROM flagged i JOIN places p ON p.feed_id = i.feed_id
        LEFT JOIN favicons v ON v.feed_id = i.feed_id
        LEFT JOIN item_overrides o ON o.item_id = i.item_id
        WHERE NOT i.is_read""",
    # Search and filter
    "filter_items": """
        SELECT item_id, feed_id, title, created_at FROM flagged
        WHERE text ILIKE '%the%' AND NOT is_read
          AND created_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25 12:00:00'
          AND feed_id IN (SELECT feed_id FROM feed_groups WHERE group_id = 4)""",
    "build_index": """
        SELECT term, item_id, count(*) AS tf,
               string_agg(CAST(position AS VARCHAR), ',' ORDER BY position) AS positions,
               CAST(any_value(item_length) AS BIGINT) AS item_length
        FROM words GROUP BY term, item_id""",
    "search_all": f"""
        SELECT item_id, count(*) AS hits FROM words WHERE term IN {TERMS}
        GROUP BY item_id HAVING count(DISTINCT term) = 3""",
    "search_unindexed": f"""
        SELECT item_id, count(*) AS hits FROM words WHERE term IN {TERMS}
        GROUP BY item_id HAVING count(DISTINCT term) = 3""",
    "search_ranked": RANKED,
    "search_phrase": PHRASE_HITS,
    "search_stored_index": RANKED,
    "update_index": f"""
        , {LATER_WORDS}
        SELECT term, item_id, count(*) AS tf,
               string_agg(CAST(position AS VARCHAR), ',' ORDER BY position) AS positions,
               CAST(any_value(item_length) AS BIGINT) AS item_length
        FROM later_words GROUP BY term, item_id""",
    "search_updated_index": f", {LATER_WORDS} {RANKED.replace('FROM words', 'FROM later_words')}",
    "search_filtered": f"""
        , {LATER_WORDS}
        SELECT item_id, count(*) AS hits FROM later_words
        WHERE term IN {TERMS} AND item_id IN (
          SELECT item_id FROM flagged JOIN feed_groups USING (feed_id) WHERE group_id = 4 AND NOT is_read)
        GROUP BY item_id HAVING count(DISTINCT term) = 3""",
    # Streams
    "stream_items": """
        SELECT item_id, feed_id, lang, title, url, md5(text) AS text_md5, created_at FROM items""",
    "stream_dedupe": "SELECT event_id, account_id, item_id, action, ts FROM state_events",
    "stream_state": FLAGS_AFTER.format(log="state_events"),
    "stream_counts": f"{WINDOWS} FROM state_events GROUP BY window_start",
    "stream_late": f"""
        , edge AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 2 DAYS AS mark FROM events),
        accepted AS (SELECT action, ts FROM state_events
                     UNION ALL SELECT action, ts FROM state_events, edge WHERE ts > mark)
        {WINDOWS},
               (SELECT count(*) FROM state_events, edge WHERE ts <= mark) AS late
        FROM accepted GROUP BY window_start""",
    "stream_late_rows": """
        SELECT event_id + 1000000000000 AS event_id, account_id, item_id, action, ts FROM state_events
        WHERE ts <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 2 DAYS FROM events)""",
    "stream_unread": "SELECT item_id, feed_id, title FROM flagged WHERE NOT is_read",
    "stream_enriched": """
        SELECT i.item_id, i.feed_id, f.title AS feed_title,
               coalesce(v.data, 'data:image/gif;base64,default') AS icon, i.title, i.url
        FROM items i JOIN feeds f ON f.feed_id = i.feed_id
        LEFT JOIN favicons v ON v.feed_id = i.feed_id""",
}


def all_oracles() -> dict[str, str]:
    return {name: f"{TABLES}\n{query}" for name, query in QUERIES.items()}
