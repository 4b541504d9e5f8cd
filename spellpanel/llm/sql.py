"""DuckDB SQL for the queries that SQL can express."""

from spellpanel.llm.quality import RULES

# weights are halved only by exact arithmetic: each pass of the recursion fixes the sources over their limit
MIX_SOURCES = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix ' || coalesce(doc_id::VARCHAR, 'null')) AS key
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS place
  FROM d GROUP BY source
), w AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight,
         2.0::DOUBLE * source_size AS cap
  FROM s
), fill(round, place, fixed) AS (
  SELECT 0, place, false FROM w
  UNION ALL
  SELECT f.round + 1, f.place, f.fixed OR w.weight * l.level >= w.cap
  FROM fill f JOIN w USING (place), (
    SELECT (1.5 * (SELECT sum(source_size) FROM w) - coalesce(sum(w.cap) FILTER (WHERE f.fixed), 0))
           / sum(w.weight) FILTER (WHERE NOT f.fixed) AS level
    FROM fill f JOIN w USING (place)) l
  WHERE f.round < (SELECT count(*) FROM w)
), last AS (
  SELECT place, fixed FROM fill WHERE round = (SELECT max(round) FROM fill)
), t AS (
  SELECT w.source, w.source_size,
         CASE WHEN fixed THEN cap ELSE weight * ((1.5 * sum(source_size) OVER ()
              - coalesce(sum(cap) FILTER (WHERE fixed) OVER (), 0)) / sum(weight) FILTER (WHERE NOT fixed) OVER ()) END AS target
  FROM w JOIN last USING (place)
), b AS (
  SELECT *, round(target)::BIGINT AS budget,
         CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS passes
  FROM t
), p AS (
  SELECT d.doc_id, d.size, b.*,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target,
       (passes * size + greatest(0, least(size, budget - passes * source_size - before)))::BIGINT AS taken
FROM p
"""

_VALUE = {
    "symbol_share": "n_symbols / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "long_words": "word_chars / greatest(n_words, 1)",
    "short_words": "-(word_chars / greatest(n_words, 1))",
}
_GRID = ", ".join(f"('{r}', {i}, {c!r}::DOUBLE)" for r, v in RULES.items() for i, c in enumerate(v))
_LONG = " UNION ALL ".join(
    f"SELECT row, doc_id, lang, base_failed, '{r}' AS rule, ({v})::DOUBLE AS value FROM f" for r, v in _VALUE.items())

QUALITY_RULES = rf"""
WITH r AS (
  SELECT row_number() OVER () AS row, doc_id, lang, coalesce(text, '') AS text,
         coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words
  FROM documents
), g AS (
  SELECT row, i, words[i:i+2] AS gram FROM (SELECT row, words, unnest(range(1, len(words) - 1)) AS i FROM r)
), c AS (
  SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, gram) AS n FROM g) WHERE n > 1
), x AS (
  SELECT row, count(DISTINCT i + k) AS n_repeat_words FROM c, (VALUES (0), (1), (2)) AS o(k) GROUP BY row
), l AS (
  SELECT row, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM r)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row
), f AS (
  SELECT row, doc_id, lang, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(words) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(words) AS base_failed
  FROM r LEFT JOIN x USING (row) LEFT JOIN l USING (row)
), v AS ({_LONG}
), q AS (
  SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id HAVING min(quality) IN (0, 1)
), h AS (
  SELECT v.*, quality FROM v JOIN q USING (doc_id) WHERE NOT base_failed
), grid(rule, place, cutoff) AS (VALUES {_GRID}
), e AS (
  SELECT lang, rule, place, cutoff, count(*) FILTER (WHERE quality = 1) AS n_good,
         count(*) FILTER (WHERE quality = 0) AS n_bad,
         count(*) FILTER (WHERE quality = 1 AND value > cutoff) AS lost,
         count(*) FILTER (WHERE quality = 0 AND value > cutoff) AS caught
  FROM h JOIN grid USING (rule) GROUP BY ALL
), b AS (
  SELECT *, list_sum(list_transform(range(0, lost + 1), lambda k: exp(
           lgamma(n_good + 1) - lgamma(k + 1) - lgamma(n_good - k + 1) + k * ln(0.01) + (n_good - k) * ln(0.99)))) AS tail,
         caught / n_bad - lost / greatest(n_good, 1) AS gain
  FROM e
), chosen AS (
  SELECT lang, rule, arg_max(cutoff, (gain, place)) AS cutoff FROM b
  WHERE lost < n_good * 0.01 AND caught > 0 AND gain > 0
    AND tail <= 0.05 / ({sum(map(len, RULES.values()))} * (SELECT count(*) FROM (SELECT DISTINCT lang FROM h)))
  GROUP BY lang, rule
), hit AS (
  SELECT DISTINCT v.row FROM v JOIN chosen c ON v.rule = c.rule AND v.lang IS NOT DISTINCT FROM c.lang
  WHERE v.value > c.cutoff
)
SELECT doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND row NOT IN (SELECT row FROM hit) AS kept
FROM f
"""

SHARD_DOCUMENTS = r"""
WITH RECURSIVE steps(c, k) AS (
  SELECT range, 0 FROM range(256)
  UNION ALL
  SELECT CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8
), firsts(b, c, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL
  SELECT b, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM firsts WHERE k < 8
), tab AS (
  SELECT list(c ORDER BY b) AS t FROM firsts WHERE k = 8
), d AS (
  SELECT doc_id, (coalesce(octet_length(encode(text)), 0) + 16)::BIGINT AS size, encode(text) AS bytes,
         CASE WHEN text IS NULL THEN '' ELSE md5(text) END AS text_key
  FROM documents
), g AS (
  SELECT *, sum(size) OVER () AS total, sum(size) OVER (PARTITION BY text_key) AS group_size FROM d
), k AS (
  SELECT *, CASE WHEN group_size * 40 > 0.05 * total
                 THEN md5(text_key || ' ' || coalesce(doc_id::VARCHAR, 'null'))
                 WHEN text_key = '' THEN md5('') ELSE text_key END AS key
  FROM g
), p AS (
  SELECT *, sum(size) OVER (ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before,
         row_number() OVER (ORDER BY key, doc_id, size) AS n
  FROM k
), c AS (
  SELECT *, least(floor((min(before) OVER (PARTITION BY key) + sum(size) OVER (PARTITION BY key) / 2) * 40 / total), 39)::INT AS shard
  FROM p
)
SELECT doc_id, size,
       CASE WHEN bytes IS NULL THEN NULL ELSE
       xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, octet_length(bytes) + 1),
         lambda i: ('0x' || substr(hex(bytes), 2 * i - 1, 2))::BIGINT)),
         lambda s, b: xor(s >> 8, tab.t[(xor(s, b) & 255) + 1]))) END::BIGINT AS text_crc32,
       'bytes' AS law, shard,
       (n - min(n) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INT AS grown_shard
FROM c, tab
"""

# the checksum as in SHARD_DOCUMENTS, of each document's distinct long runs
SPELLING_VARIANTS = r"""
WITH RECURSIVE tab AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) r(i))
), runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents
), counted AS (
  SELECT doc_id, run, count(*) AS c FROM runs WHERE length(run) >= 6 GROUP BY ALL
), summed AS (
  SELECT run, c, length(run)::BIGINT AS len, xor(4294967295, list_reduce(
           list_concat([4294967295], list_transform(range(1, octet_length(encode(key)) + 1),
                       lambda k: ('0x' || substr(hex(encode(key)), 2 * k - 1, 2))::BIGINT)),
           lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1]))) AS h
  FROM (SELECT *, coalesce(doc_id::VARCHAR, '') || ':' || run AS key FROM counted), tab
), words AS (
  SELECT word, sum(c)::BIGINT AS n
  FROM (SELECT c, CASE WHEN h % 199 = 0 THEN substring(run, 1, h % len) || substring(run, h % len + 2) ELSE run END AS word FROM summed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5
), d AS (
  SELECT word, k, substring(word, 1, k - 1) || substring(word, k + 1) AS rest
  FROM (SELECT word, unnest(range(1, length(word)::BIGINT + 1)) AS k FROM words)
), near AS (
  SELECT a.word AS w, b.word AS u FROM d a JOIN d b ON a.k = b.k AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT d.word, x.word FROM d JOIN words x ON d.rest = x.word
  UNION SELECT x.word, d.word FROM d JOIN words x ON d.rest = x.word
), best AS (
  SELECT w, count(*)::BIGINT AS n_near, first(u ORDER BY n DESC, encode(u)) AS u, max(n) AS form_n
  FROM near JOIN words ON words.word = u GROUP BY w
), forms AS (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * n THEN u END AS form,
         CASE WHEN form_n >= 5 * n THEN form_n END AS form_n
  FROM words LEFT JOIN best ON best.w = words.word
), chain(word, here, step) AS (
  SELECT word, word, 0 FROM forms
  UNION ALL SELECT chain.word, forms.form, step + 1 FROM chain JOIN forms ON forms.word = here WHERE forms.form IS NOT NULL
), roots AS (SELECT word, first(here ORDER BY step DESC) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""

NEAR_VECTORS = """
WITH RECURSIVE r AS (
  SELECT row_number() OVER () AS rid, vec_id, embedding::DOUBLE[] AS e, label FROM embeddings
), v AS (
  SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM r
  WHERE label IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.rid AS a, b.rid AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.rid <> b.rid
  WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.93
), reach(rid, other) AS (
  SELECT rid, rid FROM r UNION SELECT reach.rid, links.b FROM reach JOIN links ON links.a = reach.other
), low AS (
  SELECT reach.rid, min(o.vec_id) AS component_id FROM reach JOIN r o ON o.rid = reach.other GROUP BY reach.rid
), n AS (SELECT a AS rid, count(*) AS n_links FROM links GROUP BY a)
SELECT r.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, low.component_id, r.vec_id IS NOT DISTINCT FROM low.component_id AS kept
FROM r JOIN low USING (rid) LEFT JOIN n USING (rid)
"""
