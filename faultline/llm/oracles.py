"""DuckDB SQL for the queries of this subpackage that SQL can express."""

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP4 = f"""
WITH d AS (
  SELECT doc_id, source, len({WORDS}) AS size, md5('17:' || doc_id) AS key FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source
), r AS (
  SELECT *, row_number() OVER (ORDER BY 3 * source_size / weight, source NULLS LAST) AS place,
    sum(source_size) OVER () AS total, sum(weight) OVER () AS weights
  FROM s
), l AS (
  SELECT *, CAST(total - coalesce(sum(3 * source_size) OVER w, 0) AS DOUBLE)
    / CAST(weights - coalesce(sum(weight) OVER w, 0) AS DOUBLE) AS level
  FROM r WINDOW w AS (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT *, least(CAST(3 * source_size AS DOUBLE), coalesce(
    max(CASE WHEN 3 * source_size >= level * weight THEN level END) OVER () * weight, 3.0 * source_size)) AS target
  FROM l
), q AS (
  SELECT d.*, t.source_size, t.target,
    CAST(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id) AS BIGINT) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, CAST(epoch * source_size + upto AS DOUBLE) / target AS finish
  FROM q, (SELECT unnest([0, 1, 2]) AS epoch)
  WHERE size > 0 AND epoch * source_size + upto - size < target
), o AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, epoch, key) AS used FROM c
), k AS (
  SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM o
  WHERE used <= (SELECT sum(size) FROM d) GROUP BY doc_id
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, coalesce(taken, 0) AS taken
FROM q LEFT JOIN k USING (doc_id)
"""

OP8 = """
WITH c AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')}
    ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations GROUP BY conv_id
), r AS (
  SELECT *, list_filter(turns, lambda t: t.role = 'assistant')[-1].text AS reply,
    md5(coalesce(CAST(conv_id AS VARCHAR), '')) AS key,
    len(turns) + 1 - list_position(list_reverse([t.role = 'assistant' FOR t IN turns]), true) AS pos
  FROM c
), n AS (
  SELECT *, coalesce(lead(reply) OVER w, CASE WHEN lead(key) OVER w IS NULL THEN first_value(reply) OVER w END) AS other
  FROM r WINDOW w AS (ORDER BY key, conv_id NULLS FIRST)
), p AS (
  SELECT conv_id, turns AS a, list_transform(turns, lambda t, i: {'role': t.role,
    'text': CASE WHEN i = pos THEN coalesce(other, t.text) ELSE t.text END}) AS b FROM n
), k AS (
  SELECT *, coalesce(list_position([x[1] = x[2] FOR x IN list_zip(a, b)], false) - 1, len(a)) AS n_common FROM p
)
SELECT conv_id, CAST(n_common AS INTEGER) AS n_common,
  coalesce(list_aggregate(['<|' || t.role || '|>' || chr(10) || t.text || chr(10) FOR t IN a[:n_common]], 'string_agg', ''), '') AS prompt,
  coalesce(list_aggregate(['<|' || t.role || '|>' || chr(10) || t.text || chr(10) FOR t IN a[n_common + 1:]], 'string_agg', ''), '') AS chosen,
  coalesce(list_aggregate(['<|' || t.role || '|>' || chr(10) || t.text || chr(10) FOR t IN b[n_common + 1:]], 'string_agg', ''), '') AS rejected,
  coalesce(list_aggregate([(len(t.role) + 5) || ':0,' || (len(t.text) + 1) || ':' || CAST(t.role = 'assistant' AS INTEGER) FOR t IN a[n_common + 1:]], 'string_agg', ','), '') AS chosen_mask,
  coalesce(list_aggregate([(len(t.role) + 5) || ':0,' || (len(t.text) + 1) || ':' || CAST(t.role = 'assistant' AS INTEGER) FOR t IN b[n_common + 1:]], 'string_agg', ','), '') AS rejected_mask
FROM k
"""

OP9 = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
v AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS s, w FROM d WHERE len(w) >= 20),
k AS (SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(w[s:s + 19], ' ') ORDER BY doc_id, s) AS nth FROM v),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS pos FROM k WHERE nth > 1),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
h AS (
  SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.pos) AS kept, count(*) AS n
  FROM p ANTI JOIN gone ON p.doc_id = gone.doc_id AND p.pos = gone.pos GROUP BY p.doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN h USING (doc_id)
"""

OP10 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_transform({WORDS}, lambda x:
    translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, greatest(len(w) - 3, 2))]) AS x
  FROM d WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id
  JOIN n m ON m.doc_id = a.doc_id JOIN n o ON o.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, m.n, o.n HAVING 100 * count(*) >= 80 * (m.n + o.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM d
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reach.b) AS component_id
FROM d JOIN reach ON reach.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""


def oracles() -> dict[str, str]:
    return {
        "op4_fair_mix": OP4,
        "op8_preference_pairs": OP8,
        "op9_super_kmers": OP9,
        "op10_heavy_light_join": OP10,
    }
