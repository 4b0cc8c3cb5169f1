"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from netweave.llm.secret_scan import BASE_RULES, RULES


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def secret_scan() -> str:
    """Places from the pieces between matches: a match begins after the pieces and
    matches before it."""
    found = []
    for rank, r in enumerate(RULES):
        pattern, option = _quoted(r.pattern), "'i'" if r.any_case else "''"
        found.append(f"""
    SELECT doc_id, {rank} AS rank, '{r.kind}' AS kind, unnest(regexp_extract_all(body, {pattern}, 0, {option})) AS m,
           unnest(regexp_extract_all(body, {pattern}, {r.group}, {option})) AS g,
           unnest(regexp_split_to_array(body, {pattern}, {option})) AS gap,
           generate_subscripts(regexp_split_to_array(body, {pattern}, {option}), 1) AS i, {r.least} AS least
    FROM t WHERE regexp_matches(body, {pattern}, {option})""")
    counts = ",\n       ".join(f"coalesce(count(*) FILTER (kind = '{r.kind}'), 0)::BIGINT AS n_{r.kind}" for r in BASE_RULES)
    written = "kind || ':' || s || ':' || e"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
cut AS ({' UNION ALL '.join(found)}),
placed AS (
    SELECT doc_id, rank, kind, least, g, m,
           (sum(length(gap) + coalesce(length(m), 0)) OVER (PARTITION BY doc_id, rank ORDER BY i) - coalesce(length(m), 0))::BIGINT AS s
    FROM cut),
spans AS (SELECT doc_id, rank, kind, s, s + length(m) AS e FROM placed WHERE m IS NOT NULL AND length(g) >= least),
per AS (
    SELECT doc_id, {counts},
           string_agg({written}, ',' ORDER BY s, rank) FILTER (rank < {len(BASE_RULES)}) AS base,
           string_agg({written}, ',' ORDER BY s, rank) AS spans
    FROM spans GROUP BY doc_id)
SELECT t.doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) AS n_{r.kind}' for r in BASE_RULES)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN per USING (doc_id)
"""


#: CRC-32 by its table of 256 entries; near words by the variants with one letter
#: left out; roots by recursion.
SPELLING = r"""
WITH RECURSIVE steps(i, c, k) AS (
    SELECT i, i, 0 FROM range(256) r(i)
    UNION ALL
    SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS cells FROM steps WHERE k = 8),
runs AS (
    SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]{7,}')) AS run
    FROM documents WHERE text IS NOT NULL),
folded AS (
    SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
    FROM runs GROUP BY ALL),
bytes AS (
    SELECT id, run, n, flatten(list_transform(string_split(id || ':' || run, ''),
           lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END)) AS bs
    FROM folded),
hashed AS (
    SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, bs),
           lambda acc, b: xor(acc >> 8, cells[(xor(acc, b) & 255) + 1])), 4294967295) AS h
    FROM bytes, crc),
results AS (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n
    FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM results WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
without AS (
    SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest
    FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
    SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM without a JOIN without b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT a.word, a.n, b.word, b.n FROM without a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, b.n, a.word, a.n FROM without a JOIN words b ON a.rest = b.word),
best AS (
    SELECT word, n, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS top, max(other_n) AS top_n
    FROM near GROUP BY word, n),
formed AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= 10 * w.n THEN top END AS form,
           CASE WHEN top_n >= 10 * w.n THEN top_n END AS form_n
    FROM words w LEFT JOIN best b USING (word)),
walk(word, root, k) AS (
    SELECT word, word, 0 FROM words
    UNION ALL
    SELECT walk.word, f.form, k + 1 FROM walk JOIN formed f ON f.word = walk.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n::BIGINT AS form_n
FROM formed f JOIN (SELECT word, arg_max(root, k) AS root FROM walk GROUP BY word) w USING (word)
"""


#: Windows of 50 words as strings; a word goes if a covering window starts in a
#: document with a smaller doc_id.
SUBSTRING = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM t WHERE len(w) >= 50),
windows AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS h FROM starts),
earliest AS (SELECT h, min(doc_id) AS source FROM windows GROUP BY h),
repeated AS (SELECT doc_id, i FROM windows JOIN earliest USING (h) WHERE source < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM repeated),
cut AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id)
SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(cut.n, 0)::BIGINT AS n_removed,
       sha256(CASE WHEN cut.n IS NULL THEN array_to_string(w, ' ')
              ELSE array_to_string(list_filter(w, lambda x, k: NOT list_contains(ps, k)), ' ') END) AS kept_sha256
FROM t LEFT JOIN cut USING (doc_id)
"""

#: Equal sets are one class; classes are joined on shared shingles and counted;
#: components by recursion.
NEAR_DUPLICATES = r"""
WITH RECURSIVE t AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
           ELSE list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) END AS s FROM t),
classed AS (SELECT doc_id, len(s)::BIGINT AS n, sha256(array_to_string(s, chr(10))) AS h, s FROM sets),
classes AS (SELECT h, n, min(doc_id) AS rep, any_value(s) AS s FROM classed WHERE n > 0 GROUP BY h, n),
held AS (SELECT rep, n, unnest(s) AS x FROM classes),
links AS (
    SELECT a.rep AS a, b.rep AS b FROM held a JOIN held b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
    GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(rep, other) AS (
    SELECT rep, rep FROM classes
    UNION
    SELECT reach.rep, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.other),
roots AS (SELECT rep, min(other) AS root FROM reach GROUP BY rep)
SELECT c.doc_id, c.n AS n_shingles, coalesce(root, c.doc_id) AS component_id, c.doc_id = coalesce(root, c.doc_id) AS kept
FROM classed c LEFT JOIN classes k ON c.h = k.h AND c.n = k.n LEFT JOIN roots USING (rep)
"""
