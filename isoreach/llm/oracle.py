"""DuckDB SQL for the operators of this subpackage that SQL can express.

The rest has none: shards need CRC-32, packing a tokenizer, language a trained
network, personal data trained trees, decontamination sketches; byte windows
are too slow in SQL.  ``tests/llm`` holds those against brute force.
"""

from isoreach.llm import quality

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRINGS = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS w FROM documents),
h AS (SELECT rid, doc_id, unnest(range(1, len(w) - 48)) AS i, unnest(list_transform(range(1, len(w) - 48), lambda k: md5(array_to_string(w[k:k + 49], ' ')))) AS h FROM d WHERE len(w) >= 50),
f AS (SELECT h, min(doc_id) AS first FROM h GROUP BY 1),
m AS (SELECT rid, i FROM h JOIN f USING (h) WHERE doc_id > first),
c AS (SELECT DISTINCT rid, i + o AS i FROM m, range(50) r(o)),
x AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
k AS (SELECT x.rid, count(c.i) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY x.i) FILTER (c.i IS NULL), '') AS kept FROM x LEFT JOIN c ON c.rid = x.rid AND c.i = x.i GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (rid)"""

QUALITY = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
x AS (SELECT rid, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM d),
y AS (SELECT rid, i, a, lead(a, 1) OVER q AS b, lead(a, 2) OVER q AS c FROM x WINDOW q AS (PARTITION BY rid ORDER BY i)),
z AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM y WHERE c IS NOT NULL),
r AS (SELECT rid, count(DISTINCT i + o) AS n_repeat_words FROM z, range(3) s(o) WHERE n > 1 GROUP BY 1),
l AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
f AS (SELECT rid, line, length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g')) AS chars,
 (length(line) < 40 AND right(rtrim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ('.', '!', '?', ';', ':', ',', '…', '"', '''', '”', '’', '»', ')', ']'))
 OR (length(line) < 40 AND regexp_matches(lower(line), '{quality.MENU}'))
 OR len(regexp_extract_all(line, '[#*$%&|<>]')) > CAST(0.3 AS DOUBLE) * length(line)
 OR length(line) - length(replace(line, '|', '')) + length(line) - length(replace(line, ' > ', '> ')) + length(line) - length(replace(line, '» ', ' ')) + length(line) - length(replace(line, '› ', ' ')) >= 2
 OR regexp_matches(lower(line), '{'|'.join(quality.BOILERPLATE)}') AS fails
 FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
g AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines, CAST(coalesce(sum(chars) FILTER (fails), 0) AS BIGINT) AS lost_chars FROM f GROUP BY 1),
s AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
 coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost_chars, 0) AS lost_chars FROM d LEFT JOIN r USING (rid) LEFT JOIN g USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost_chars <= CAST(0.6 AS DOUBLE) * word_chars AS kept, lost_chars FROM b"""

NEAR = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) END AS g FROM d),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
u AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT doc_id AS a, doc_id AS c FROM s UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.a),
m AS (SELECT a AS doc_id, min(c) AS c FROM r GROUP BY 1)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, c AS component_id, c = doc_id AS kept FROM s JOIN m USING (doc_id)"""

SQL: dict[str, str] = {"op1_substring_dedup": SUBSTRINGS, "op3_line_quality": QUALITY, "op10_near_dedup": NEAR}
