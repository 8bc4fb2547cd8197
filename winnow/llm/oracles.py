"""SQL statements that give the rows of the queries, written independently of the operators."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = """
WITH each AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents
), lines AS (
  SELECT doc_id, pos, raw, trim(raw, ' ') AS line, length(trim(raw, ' ')) >= 16 AS counts FROM each
), classes AS (
  SELECT line, min(doc_id * 4294967296 + pos) AS place FROM lines WHERE counts GROUP BY line
), variants AS (
  SELECT place, line, line AS v FROM classes
  UNION ALL
  SELECT place, line, substr(line, 1, i - 1) || substr(line, i + 1)
  FROM (SELECT place, line, unnest(range(1, length(line) + 1)) AS i FROM classes)
), keyed AS (
  SELECT place, line, hash(v) AS k FROM variants
), close AS (
  SELECT DISTINCT b.place
  FROM keyed a JOIN keyed b ON a.k = b.k AND a.place < b.place
  WHERE levenshtein(a.line, b.line) <= 1
), firsts AS (
  SELECT place FROM classes ANTI JOIN close USING (place)
), marked AS (
  SELECT doc_id, pos, raw, NOT counts OR f.place IS NOT NULL AS stays
  FROM lines LEFT JOIN firsts f ON f.place = lines.doc_id * 4294967296 + lines.pos
), joined AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (stays) AS n_kept,
    coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (stays), '') AS text
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(j.n_lines, 0) AS n_lines, coalesce(j.n_kept, 0) AS n_kept,
  CASE WHEN d.text IS NOT NULL THEN j.text END AS text
FROM documents d LEFT JOIN joined j USING (doc_id)
"""

OP5 = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, 10 AS n, array_to_string(w[i:i + 9], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS i FROM b WHERE len(w) >= 10)
  UNION ALL
  SELECT DISTINCT item_id, len(w), array_to_string(w, ' ') FROM b WHERE len(w) BETWEEN 1 AND 9
), spans AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows))
), hits AS (
  SELECT doc_id, item_id, n, i FROM spans JOIN windows USING (n, g)
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM hits GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  coalesce(items, []) AS items
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP9 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b
  FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), lowest AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
), counts AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN lowest ON vec_id = lowest.a LEFT JOIN counts ON vec_id = counts.a
"""
OP11 = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w
  FROM documents
), drawn AS (
  SELECT doc_id, text, w, len(w) AS n,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(w) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(w) + 1) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
      OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 50 THEN 'plain'
      WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM t
), parts AS (
  SELECT doc_id, text, n, form, array_to_string(w[1:least(a, b)], '') AS p,
    array_to_string(w[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(w[greatest(a, b) + 1:], '') AS s
  FROM drawn
), made AS (
  SELECT doc_id, n, form, p, m, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS output
  FROM parts
), found AS (
  SELECT *, strpos(output, CASE form WHEN 'psm' THEN '<S>' ELSE '<P>' END) AS x, strpos(output, '<M>') AS y FROM made
), undone AS (
  SELECT *, substr(output, 4, x - 4) AS one, substr(output, x + 3, y - x - 3) AS two, substr(output, y + 3) AS three FROM found
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars, sha256(output) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN one || three || two ELSE two || three || one END) AS restored_sha256
FROM undone
"""

OP12 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), found AS (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT doc) AS docs
  FROM (SELECT doc, lang, source, unnest(w) AS term FROM d) GROUP BY ALL
), kept AS (
  SELECT lang, term, sum(n) AS lang_n FROM found GROUP BY ALL HAVING sum(docs) >= 3
), langs AS (
  SELECT lang, count(*) AS v, sum(lang_n) AS n_lang FROM kept GROUP BY lang
), groups AS (
  SELECT DISTINCT lang, source FROM d
), each AS (
  SELECT g.lang, g.source, k.term, k.lang_n, coalesce(f.n, 0) AS n
  FROM groups g JOIN kept k USING (lang) LEFT JOIN found f ON f.lang = g.lang AND f.source = g.source AND f.term = k.term
), totals AS (
  SELECT lang, source, sum(n) AS n_source FROM each GROUP BY ALL
), shares AS (
  SELECT lang, source, term, n, CAST(1 + (1000000000 * (n + 1)) // (n_source + v) AS BIGINT) AS p,
    CAST(1 + (1000000000 * (lang_n + 1)) // (n_lang + v) AS BIGINT) AS q
  FROM each JOIN totals USING (lang, source) JOIN langs USING (lang)
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT g.lang, g.source, 'pair' AS part, o.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM groups g JOIN groups o ON g.lang = o.lang AND g.source <> o.source
  LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source AND s.item = o.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shares WHERE n > 0 AND p > q
)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 200
"""
