"""SQL that an independent engine runs for the rows of this subpackage's queries, where SQL can express them."""

from __future__ import annotations

from tessera.llm.licences import PHRASES

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACES = r"[\x20\x09-\x0D]+"

TOPK = """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
        FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

#: Windows by their words; a word goes that a window covers which starts earlier elsewhere.
SUBSTRINGS = f"""
    WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '{_SPACES}'), lambda w: w <> '') AS ws FROM documents),
    w AS (SELECT doc_id, i, array_to_string(ws[i + 1 : i + 20], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(len(ws) - 19)) AS i FROM d WHERE len(ws) >= 20)),
    f AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS place FROM f),
    words AS (SELECT doc_id, unnest(range(len(ws))) AS place, unnest(ws) AS word FROM d),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS text FROM words ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id),
    n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
    SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
    FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id"""

#: All pairs that share a shingle, counted, and the transitive closure of their links.
JACCARD = f"""
    WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(coalesce({_LOWER}, ''), '{_SPACES}'), lambda w: w <> '') AS ws FROM documents),
    s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(len(ws) - 2), lambda i: array_to_string(ws[i + 1 : i + 3], ' ')) END) AS g FROM d),
    u AS (SELECT doc_id, len(g) AS n, unnest(g) AS k FROM s),
    l AS (SELECT a.doc_id AS x, b.doc_id AS y FROM u a JOIN u b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
    e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
    r(doc_id, other) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.other)
    SELECT s.doc_id, len(g)::BIGINT AS n_shingles, c.component_id FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) c ON c.doc_id = s.doc_id"""

WARC = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    q AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest, CASE WHEN strlen(html) >= 100 THEN min(page_id) OVER (PARTITION BY html) ELSE page_id END AS first FROM p)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM q"""

_PLACES = " UNION ALL ".join(
    f"SELECT doc_id, i, '{label}' AS label FROM w WHERE ws[i + 1 : i + {len(p.split())}] = [{', '.join(repr(x) for x in p.split())}]" for p, label in PHRASES.items())
#: The base columns of the licence scan; labels and scores of spans are not for SQL.
LICENCE_BASE = rf"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
    w AS (SELECT doc_id, ws, unnest(range(len(ws))) AS i FROM d),
    f AS (SELECT doc_id, count(*) AS n, min(i) AS a, max(i) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM ({_PLACES}) GROUP BY doc_id)
    SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0) AS n_base, a AS first_word, z AS last_word, coalesce(labels, '') AS base_labels FROM d LEFT JOIN f ON f.doc_id = d.doc_id"""

#: Checksums from a table made by its rule; pairs meet by the word with one code point left out.
SPELLING = f"""
    WITH RECURSIVE k AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS crc),
    r AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
    u AS (SELECT doc_id, run, count(*) AS n FROM r GROUP BY 1, 2),
    b AS (SELECT *, flatten(list_transform(list_transform(string_split(doc_id || ':' || run, ''), lambda c: ord(c)), lambda c: CASE WHEN c < 128 THEN [c] ELSE [192 + c // 64, 128 + c % 64] END)) AS bytes FROM u),
    h AS (SELECT doc_id, run, n, xor(list_reduce(bytes, lambda c, x: xor(c // 256, crc[xor(c % 256, x) + 1]), 4294967295), 4294967295) AS h FROM b, k),
    w AS (SELECT CASE WHEN h % 97 = 0 THEN run[: h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, n FROM h),
    v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
    d AS (SELECT word, n, i, word[: i] || word[i + 2 :] AS gap FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
    p AS (SELECT a.word, b.word AS near, b.n AS m FROM d a JOIN d b ON a.gap = b.gap AND a.i = b.i AND a.word <> b.word
        UNION SELECT a.word, v.word, v.n FROM d a JOIN v ON a.gap = v.word UNION SELECT v.word, a.word, a.n FROM d a JOIN v ON a.gap = v.word),
    t AS (SELECT word, near, m, count(*) OVER (PARTITION BY word) AS n_near FROM p QUALIFY row_number() OVER (PARTITION BY word ORDER BY m DESC, near) = 1),
    f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * v.n THEN near END AS form, CASE WHEN m >= 2 * v.n THEN m END AS form_n FROM v LEFT JOIN t ON t.word = v.word),
    c(word, root) AS (SELECT word, coalesce(form, word) FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL),
    e AS (SELECT c.word, c.root FROM c JOIN f ON f.word = c.root WHERE f.form IS NULL)
    SELECT f.word, form, root, n, n_near, form_n FROM f JOIN (SELECT DISTINCT * FROM e) e ON e.word = f.word"""

#: The recursion over end days with every allowed start, then the way back from the last day.
CHANGE_POINTS = """
    WITH RECURSIVE d AS (SELECT vendor_id, datediff('day', DATE '1970-01-01', CAST(shipped_at AS DATE)) AS day, CAST(sum(quantity) AS BIGINT) AS x
        FROM sale_lines WHERE flag = 'kept' AND quantity IS NOT NULL AND shipped_at IS NOT NULL AND vendor_id IS NOT NULL GROUP BY 1, 2),
    r AS (SELECT vendor_id, min(day) AS a, max(day) AS z FROM d GROUP BY 1),
    g AS (SELECT vendor_id, a, unnest(range(a, z + 1)) AS day FROM r),
    f AS (SELECT g.vendor_id, a, g.day, coalesce(x, 0) AS x FROM g LEFT JOIN d ON d.vendor_id = g.vendor_id AND d.day = g.day),
    w AS (SELECT vendor_id, a, day, sum(x) OVER o AS p, sum(x * x) OVER o AS q FROM f WINDOW o AS (PARTITION BY vendor_id ORDER BY day)),
    v AS (SELECT vendor_id, a, count(*) AS n, [0::HUGEINT] || list(p ORDER BY day) AS ps, [0::HUGEINT] || list(q ORDER BY day) AS qs FROM w GROUP BY 1, 2),
    t(vendor_id, e, best) AS (SELECT vendor_id, 0::BIGINT, [[0::BIGINT, 0, 0]] FROM v UNION ALL
        SELECT t.vendor_id, t.e + 1, t.best || [list_sort(list_transform(
            list_filter(range(t.e + 1), lambda s: (s = 0 AND (n < 7 OR t.e >= 6) OR s >= 7 AND s <= t.e - 6) AND t.best[s + 1] IS NOT NULL),
            lambda s: [t.best[s + 1][1] + CASE WHEN s > 0 THEN 20000 ELSE 0 END + (t.e + 1 - s) * CAST(floor(1000 * ln(CAST(1 + ((t.e + 1 - s) * (qs[t.e + 2] - qs[s + 1]) - (ps[t.e + 2] - ps[s + 1]) * (ps[t.e + 2] - ps[s + 1])) // ((t.e + 1 - s) * (t.e + 1 - s)) AS DOUBLE))) AS BIGINT), t.best[s + 1][2] + 1, s]))[1]]
        FROM t JOIN v ON v.vendor_id = t.vendor_id WHERE t.e < n),
    b AS (SELECT v.*, best FROM t JOIN v ON v.vendor_id = t.vendor_id AND e = n),
    c(vendor_id, s, e) AS (SELECT vendor_id, best[n + 1][3], n FROM b UNION ALL SELECT c.vendor_id, best[c.s + 1][3], c.s FROM c JOIN b ON b.vendor_id = c.vendor_id WHERE c.s > 0),
    o AS (SELECT c.vendor_id, s, e, a, e - s AS k, ps[e + 1] - ps[s + 1] AS total, qs[e + 1] - qs[s + 1] AS q, best[n + 1] AS whole FROM c JOIN b ON b.vendor_id = c.vendor_id),
    x AS (SELECT *, CAST(1 + (k * q - total * total) // (k * k) AS BIGINT) AS spread FROM o)
    SELECT vendor_id, CAST(row_number() OVER (PARTITION BY vendor_id ORDER BY s) AS INTEGER) AS segment_no, CAST(a + s AS BIGINT) AS first_day, CAST(k AS BIGINT) AS n_days, CAST(total AS BIGINT) AS total, spread,
        CAST(k * floor(1000 * ln(CAST(spread AS DOUBLE))) AS BIGINT) AS cost, CAST(whole[2] AS BIGINT) AS n_segments, CAST(whole[1] AS BIGINT) AS best_cost FROM x"""

ORACLES = {
    "op1_topk_search": TOPK,
    "op2_substring_dedup": SUBSTRINGS,
    "op3_jaccard_join": JACCARD,
    "op9_warc_archives": WARC,
    "op12_spelling_variants": SPELLING,
    "op13_change_points": CHANGE_POINTS,
    "licence_base_places": LICENCE_BASE,
}
