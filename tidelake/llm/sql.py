"""What some queries of this package return, in DuckDB's SQL over the same tables."""

from tidelake.llm.licenses import GAP, PHRASES, SHARE, TEXTS

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EXACT_TOP_K = """WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

# All pairs that share a shingle, their links, and what links reach.
NEAR_DEDUP = f"""WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_LOWERED},
                                    '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN [w[1]] ELSE
    list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS shingle FROM d
), n AS (SELECT d.doc_id, count(shingle) AS n_shingles FROM d LEFT JOIN s USING (doc_id) GROUP BY 1
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * common >= 80 * (x.n_shingles + y.n_shingles - common)
), reach AS (
  SELECT doc_id, doc_id AS other FROM d
  UNION
  SELECT r.doc_id, l.other FROM reach r JOIN (SELECT a AS one, b AS other FROM links UNION ALL SELECT b, a FROM links) l ON l.one = r.other
)
SELECT n.doc_id, n_shingles, min(other) AS component_id, n.doc_id = min(other) AS kept
FROM n JOIN reach USING (doc_id) GROUP BY n.doc_id, n_shingles"""

_TEMPLATES = ", ".join(f"({i}, '{t.label}', {t.phrase}, string_split('{t.text}', ' '))" for i, t in enumerate([*PHRASES, *TEXTS]))

# Votes of word pairs by diagonal, as words and not as hashes.
LICENSE_SCAN = f"""WITH t(template, label, phrase, w) AS (VALUES {_TEMPLATES}
), tg AS (SELECT template, label, phrase, len(w) - 1 AS size, unnest(range(1, len(w))) AS p, w FROM t
), d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOWERED},
                                    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), g AS (SELECT r, unnest(range(1, len(w))) AS p, w FROM d
), pairs AS (SELECT r, p, w[p] AS one, w[p + 1] AS two FROM g
), votes AS (
  SELECT DISTINCT r, template, label, phrase, size, tg.p, pairs.p - tg.p AS diagonal
  FROM pairs JOIN tg ON one = tg.w[tg.p] AND two = tg.w[tg.p + 1]
), diagonals AS (SELECT r, template, label, phrase, size, diagonal, list(p) AS ps FROM votes GROUP BY ALL
), apart AS (
  SELECT *, coalesce(diagonal - lag(diagonal) OVER o > CASE WHEN phrase THEN 0 ELSE {GAP} END, TRUE) AS new
  FROM diagonals WINDOW o AS (PARTITION BY r, template ORDER BY diagonal)
), merged AS (
  SELECT *, sum(new::INT) OVER (PARTITION BY r, template ORDER BY diagonal) AS span FROM apart
), spans AS (
  SELECT r, label, phrase, min(diagonal) AS start, len(list_distinct(flatten(list(ps)))) / size AS votes
  FROM merged GROUP BY r, template, label, phrase, size, span
  HAVING len(list_distinct(flatten(list(ps)))) / size >= CASE WHEN phrase THEN 1 ELSE {SHARE} END
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, count(*) FILTER (WHERE phrase) AS n_base,
       min(start) FILTER (WHERE phrase) AS first_word, max(start) FILTER (WHERE phrase) AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE phrase), '') AS base_labels,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(votes), 0.0) AS score
FROM d LEFT JOIN spans USING (r) GROUP BY r, d.doc_id, len(d.w)"""

RANKED_SEARCH = f"""WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS term FROM documents
), tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL
), n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY ALL
), total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n
), df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL
), q AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark) GROUP BY ALL
), w AS (
  SELECT item_id, term, times, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * df + 1))) AS BIGINT) AS weight FROM q JOIN df USING (term), total
), s AS (
  SELECT item_id, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + 25 * n * docs // terms)))) AS BIGINT) AS score
  FROM w JOIN tf USING (term) JOIN n USING (doc_id), total GROUP BY ALL
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20"""

# The given pages mark their articles, and have five kinds of tags and two references in them, some cut short: what the labeller must find.
HTML_EXTRACT = """WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS body FROM pages
), b AS (
  SELECT page_id, url, list_transform(string_split_regex(body, '</?(?:h1|p)>'), lambda x:
    trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g'),
      '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g'), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ')) AS parts FROM a
), t AS (SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)) AS text FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t"""
