"""DuckDB SQL for the registered queries, on the same Parquet tables."""

from __future__ import annotations

from faultline import fixed


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values: list[str]) -> str:
    return "(" + ", ".join(_quote(v) for v in values) + ")"


ERRORS = _list(fixed.ERROR_LEVELS)
CRITICAL = _list(fixed.CRITICAL_LEVELS)
ALERTS = _list(fixed.ALERT_LEVELS)
INCIDENT = f"(is_anomaly OR level IN {ERRORS})"
ALERT = f"(is_anomaly OR level IN {ALERTS})"


def _mask(text: str) -> str:
    for pattern, label in [
        (fixed.DATE_MASK, "<DATE>"),
        (fixed.TIME_MASK, "<TIME>"),
        (fixed.IP_MASK, "<IP>"),
        (fixed.HEX_MASK, "<HEX>"),
        (fixed.NUM_MASK, "<NUM>"),
    ]:
        text = f"regexp_replace({text}, '{pattern}', '{label}', 'g')"
    return text


def _first_keyword(text: str, cases, otherwise: str) -> str:
    whens = " ".join(
        f"WHEN {' OR '.join(f'contains(lower({text}), {_quote(w)})' for w in words)} THEN {_quote(value)}"
        for words, value in cases
    )
    return f"CASE {whens} ELSE {_quote(otherwise)} END"


def _cause(text: str) -> str:
    return _first_keyword(text, [(w, c) for _, w, c in fixed.CAUSE_RULES], fixed.UNKNOWN_CAUSE)


def _family(text: str) -> str:
    return _first_keyword(text, [(w, f) for f, w, _ in fixed.CAUSE_RULES], "OTHER")


def _action(cause: str) -> str:
    return _first_keyword(cause, [([k], a) for k, a in fixed.ACTION_KEYS], fixed.UNKNOWN_ACTION)


SCORED = """
base AS (
  SELECT *, CAST(floor(value) AS BIGINT) AS v, CAST(floor(value * 10) AS BIGINT) AS tenths,
    CASE WHEN event_type = 'error' AND value >= 100 THEN 'CRITICAL'
         WHEN event_type = 'error' THEN 'ERROR'
         WHEN event_type = 'signup' THEN 'WARNING'
         WHEN event_type = 'click' THEN 'DEBUG' ELSE 'INFO' END AS level
  FROM events),
texted AS (
  SELECT *,
    CASE
      WHEN event_type = 'error' AND user_id % 4 = 0 THEN
        concat('Database connection timeout after ', v, 'ms on pool connection ', user_id)
      WHEN event_type = 'error' AND user_id % 4 = 1 THEN
        concat('Network unreachable: connection refused by 10.0.', user_id % 256, '.', v % 256,
               ' on port ', 5000 + user_id)
      WHEN event_type = 'error' AND user_id % 4 = 2 THEN
        concat('Disk write failed on volume /data/', user_id % 7)
      WHEN event_type = 'error' THEN concat('Worker process PID ', event_id, ' killed by OOM killer')
      WHEN event_type = 'signup' THEN
        concat('Failed login attempt for user ', user_id, ' from IP 192.168.1.', user_id % 256)
      WHEN event_type = 'click' THEN
        concat('Thread pool stats: ', v, ' active, ', user_id % 9, ' idle')
      WHEN event_type = 'view' THEN
        concat('Incoming request GET /api/items/', user_id, ' from 192.168.0.', v % 256)
      ELSE concat('Payment processed for order ORD-', event_id, ' in ', v, 'ms') END AS message
  FROM base),
scored AS (
  SELECT event_id + 1 AS line_id, concat('src', user_id % 4, '.log') AS log_source,
    concat('run_', day(ts) % 3) AS run_id, ts AS created_at, level, message,
    strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp,
    concat(strftime(ts, '%Y-%m-%d %H:%M:%S'), ' ', level, ' ', message) AS raw_log,
    tenths > 1000 AS is_anomaly, (CAST(tenths AS DOUBLE) - 1000) / 10000 AS anomaly_score,
    CAST(user_id % 5 - 1 AS INTEGER) AS semantic_cluster
  FROM texted)"""
PARSED = SCORED + f""",
parsed AS (SELECT *, raw_log AS clean_log, {_mask('raw_log')} AS event_template FROM scored)"""
DIAGNOSED = PARSED + f""",
caused AS (
  SELECT *, CASE WHEN {ALERT} THEN {_cause('event_template')} END AS cause FROM parsed),
diagnosed AS (
  SELECT * EXCLUDE (cause), coalesce(cause, {_quote(fixed.NORMAL_CAUSE)}) AS root_cause,
    CASE WHEN cause IS NULL THEN {_quote(fixed.NORMAL_ACTION)} ELSE {_action('cause')} END
      AS recommendation,
    CASE WHEN level = 'WARN' THEN 'WARNING' ELSE level END AS severity_label
  FROM caused)"""
INCIDENTS = DIAGNOSED + f""",
incidents AS (SELECT * FROM diagnosed WHERE {INCIDENT})"""
RAW = SCORED + """,
raw AS (
  SELECT line_id AS id, line_id, stamp AS "timestamp", level, message, log_source AS source
  FROM scored)"""
RUNS = INCIDENTS + f""",
runs AS (
  SELECT run_id, log_source, min(created_at) AS created_at, count(*) AS total_events,
    count(*) FILTER (is_anomaly) AS anomalies, count(*) FILTER (level IN {ERRORS}) AS errors
  FROM incidents GROUP BY ALL)"""


def _with(base: str, body: str) -> str:
    return f"WITH {base}\n{body}"


STORED = (
    "line_id, raw_log, level, event_template, is_anomaly, anomaly_score, semantic_cluster, "
    "root_cause, recommendation, log_source, run_id, created_at"
)
EXPORT = (
    "line_id, level, is_anomaly, anomaly_score, event_template, root_cause, recommendation, clean_log"
)


def _hits(words: list[str]) -> str:
    return " + ".join(
        f"sum((length(t) - length(replace(t, {_quote(w)}, ''))) // {len(w)})" for w in words
    )


DOMAIN_SUMS = PARSED + """,
lowered AS (SELECT lower(clean_log) AS t FROM parsed),
domains AS (
""" + "\n  UNION ALL\n".join(
    f"  SELECT {i} AS priority, {_quote(name)} AS domain, CAST({_hits(words)} AS BIGINT) AS score FROM lowered"
    for i, (name, words) in enumerate(fixed.DOMAINS)
) + ")"

TOTALS = f"""count(*) AS total, count(*) FILTER (is_anomaly) AS anomalies,
    count(*) FILTER (level IN {ERRORS}) AS errors, count(*) FILTER (level IN {CRITICAL}) AS critical"""


def _dots(name: str) -> str:
    """1234567 -> 1,234,567 in SQL."""
    return f"format('{{:,}}', {name})"


def _terms(texts: str, max_terms: int) -> str:
    """CTEs from (text, m): term counts, vocabulary and unit weights."""
    return f"""{texts},
words AS (
  SELECT text, m, unnest(ws) AS term, unnest(range(1, len(ws) + 1)) AS place
  FROM (SELECT text, m, regexp_extract_all(lower(text), '\\w\\w+') AS ws FROM texts)),
grams AS (
  SELECT text, m, term FROM words
  UNION ALL
  SELECT a.text, a.m, a.term || ' ' || b.term FROM words a JOIN words b
    ON a.text = b.text AND b.place = a.place + 1),
tf AS (SELECT text, term, count(*) AS tf, any_value(m) AS m FROM grams GROUP BY ALL),
vocabulary AS (
  SELECT term, CAST(sum(tf * m) AS BIGINT) AS total, CAST(sum(m) AS BIGINT) AS df,
    ln((1.0 + (SELECT sum(m) FROM texts)) / (1.0 + sum(m))) + 1.0 AS idf
  FROM tf GROUP BY term ORDER BY total DESC, term LIMIT {max_terms}),
raw_weights AS (SELECT text, term, tf.tf * idf AS w FROM tf JOIN vocabulary USING (term)),
weights AS (
  SELECT text, term, w / sqrt(sum(w * w) OVER (PARTITION BY text)) AS weight FROM raw_weights)"""


ROW_TEXTS = PARSED + """,
texts AS (
  SELECT event_template AS text, count(*) AS m, min(line_id) AS first_line
  FROM parsed GROUP BY 1)"""
ONE_EACH = PARSED + """,
texts AS (
  SELECT event_template AS text, 1 AS m, min(line_id) AS first_line FROM parsed GROUP BY 1)"""
KNOWLEDGE_ROWS = ", ".join(
    f"({i}, {_quote(text)}, {_quote(cause)}, {_quote(action)}, {_quote(family)})"
    for i, (family, text, cause, action) in enumerate(fixed.KNOWLEDGE)
)


def _semantic(threshold: float) -> str:
    texts = PARSED + f""",
knowledge(priority, pattern, cause, action, family) AS (VALUES {KNOWLEDGE_ROWS}),
asked AS (SELECT DISTINCT event_template AS text FROM parsed WHERE {ALERT}),
texts AS (
  SELECT text, count(*) AS m FROM (
    SELECT text FROM asked UNION ALL SELECT pattern FROM knowledge) GROUP BY text)"""
    return _terms(texts, fixed.TFIDF_SEMANTIC_TERMS) + f""",
scores AS (
  SELECT a.text, k.priority, round(coalesce(sum(x.weight * y.weight), 0), 12) AS score
  FROM asked a CROSS JOIN knowledge k
  LEFT JOIN weights x ON x.text = a.text
  LEFT JOIN weights y ON y.text = k.pattern AND y.term = x.term
  GROUP BY ALL),
best AS (
  SELECT text, score AS best_score, priority FROM scores
  QUALIFY row_number() OVER (PARTITION BY text ORDER BY score DESC, priority) = 1),
ruled AS (
  SELECT text, best_score, k.cause, k.action, k.family, {_cause('text')} AS rule_cause,
    {_family('text')} AS rule_family
  FROM best JOIN knowledge k USING (priority)),
answers AS (
  SELECT text, best_score,
    CASE WHEN best_score >= {threshold} THEN cause ELSE rule_cause END AS root_cause,
    CASE WHEN best_score >= {threshold} THEN action ELSE {_action('rule_cause')} END AS recommendation,
    CASE WHEN best_score >= {threshold} THEN family ELSE rule_family END AS cause_family
  FROM ruled)"""


def _features() -> str:
    weight = " ".join(f"WHEN {_quote(k)} THEN {v}" for k, v in fixed.SEVERITY_WEIGHT.items())
    return PARSED + f""",
numeric_rows AS (
  SELECT line_id, CAST(CASE level {weight} ELSE 1 END AS DOUBLE) AS severity,
    CAST(count(*) OVER (PARTITION BY event_template) AS DOUBLE) AS template_frequency,
    CAST(length(clean_log) AS DOUBLE) AS message_length
  FROM parsed)"""


def _scaled(name: str) -> str:
    return f"""round(CASE WHEN stddev_pop({name}) OVER () = 0 THEN 0
    ELSE ({name} - avg({name}) OVER ()) / stddev_pop({name}) OVER () END, 6) AS {name}"""


TREND = """,
placed AS (
  SELECT *, CAST(round(anomaly_score * 10000) AS BIGINT) AS units,
    greatest(5, count(*) OVER (PARTITION BY log_source) // 40) AS width,
    row_number() OVER (PARTITION BY log_source ORDER BY line_id) AS pos,
    count(*) OVER (PARTITION BY log_source) AS n
  FROM scored),
running AS (
  SELECT *, sum(units) OVER (PARTITION BY log_source ORDER BY line_id) AS upto FROM placed),
smoothed AS (
  SELECT a.log_source, a.line_id,
    CAST(h.upto - coalesce(l.upto, 0) AS DOUBLE)
      / (least(a.n, a.pos + (a.width - 1) // 2) - greatest(0, a.pos - a.width // 2 - 1)) / 10000
      AS smoothed_risk
  FROM running a
  JOIN running h ON h.log_source = a.log_source AND h.pos = least(a.n, a.pos + (a.width - 1) // 2)
  LEFT JOIN running l ON l.log_source = a.log_source AND l.pos = a.pos - a.width // 2 - 1),
trend AS (
  SELECT *, (smoothed_risk - min(smoothed_risk) OVER w)
    / greatest(max(smoothed_risk) OVER w - min(smoothed_risk) OVER w, 1e-6) AS normalized_risk
  FROM smoothed WINDOW w AS (PARTITION BY log_source))"""

POINTS = _terms(ROW_TEXTS, fixed.TFIDF_ROW_TERMS) + """,
points AS (
  SELECT event_template AS text, semantic_cluster AS label, count(*) AS m FROM parsed GROUP BY ALL),
sizes AS (SELECT label, sum(m) AS size FROM points GROUP BY label),
sums AS (
  SELECT label, term, sum(weight * m) AS s FROM points JOIN weights USING (text) GROUP BY ALL)"""


def _dbscan(vectors: str, eps: float, min_samples: int, by_frequency: bool = False) -> str:
    """Labels by reachability among core vectors, on the pairs within eps."""
    return f"""WITH RECURSIVE {vectors},
places AS (
  SELECT first_line, m, text, row_number() OVER (ORDER BY n DESC, first_line) AS by_count
  FROM texts JOIN (SELECT event_template AS text, count(*) AS n FROM parsed GROUP BY 1) USING (text)),
nodes AS (
  SELECT first_line, m, text, {"by_count" if by_frequency else "first_line"} AS place FROM places),
pairs AS (
  SELECT a.first_line AS a, b.first_line AS b
  FROM weights x JOIN weights y USING (term)
  JOIN texts a ON a.text = x.text JOIN texts b ON b.text = y.text
  WHERE a.first_line <> b.first_line
  GROUP BY 1, 2 HAVING round(sum(x.weight * y.weight), 9) >= 1 - {eps}),
core AS (
  SELECT n.first_line, n.place FROM nodes n LEFT JOIN pairs ON a = n.first_line
  LEFT JOIN nodes o ON o.first_line = b
  WHERE {min_samples} = 1 OR EXISTS (SELECT 1 FROM weights w WHERE w.text = n.text)
  GROUP BY n.first_line, n.place, n.m HAVING n.m + coalesce(sum(o.m), 0) >= {min_samples}),
reach(start, node) AS (
  SELECT first_line, first_line FROM core
  UNION
  SELECT start, b FROM reach JOIN pairs ON a = node JOIN core ON first_line = b),
roots AS (
  SELECT start AS first_line, min(place) AS root FROM reach JOIN nodes ON nodes.first_line = node
  GROUP BY start),
numbered AS (SELECT first_line, dense_rank() OVER (ORDER BY root) - 1 AS label FROM roots),
labelled AS (
  SELECT n.first_line, CAST(coalesce(
    (SELECT label FROM numbered c WHERE c.first_line = n.first_line),
    (SELECT min(label) FROM numbered c JOIN pairs ON a = n.first_line AND b = c.first_line), -1)
    AS INTEGER) AS label
  FROM nodes n)
"""


# All leaves of the search tree step through their lines side by side; a leaf's state is the
# list of its groups, each with the line that opened it and its words now.
DRAIN = PARSED + """,
leafed AS (
  SELECT line_id, log_source, level, event_template AS text, string_split(event_template, ' ') AS words FROM parsed),
keyed AS (
  SELECT *, concat_ws(' ', len(words), array_to_string(
    list_transform(words[1:3], lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END), ' ')) AS leaf
  FROM leafed),
steps AS (
  SELECT *, row_number() OVER (PARTITION BY log_source, leaf ORDER BY line_id) AS step FROM keyed),
play(log_source, leaf, step, state, line_id, group_line, template) AS (
  SELECT log_source, leaf, step, [{'line': line_id, 'words': words}], line_id, line_id, text
  FROM steps WHERE step = 1
  UNION ALL
  SELECT log_source, leaf, step,
    CASE WHEN best >= 0.5 THEN list_concat(list_concat(state[1:place - 1], [{'line': state[place].line, 'words': merged}]), state[place + 1:])
      ELSE list_append(state, {'line': line_id, 'words': words}) END,
    line_id, CASE WHEN best >= 0.5 THEN state[place].line ELSE line_id END,
    CASE WHEN best >= 0.5 THEN array_to_string(merged, ' ') ELSE text END
  FROM (
    SELECT *, list_transform(list_zip(state[place].words, words), lambda p: CASE WHEN p[1] = p[2] THEN p[1] ELSE '<*>' END) AS merged
    FROM (
      SELECT *, list_max(shares) AS best, list_position(shares, list_max(shares)) AS place
      FROM (
        SELECT s.*, p.state, list_transform(p.state, lambda g:
          list_sum(list_transform(list_zip(g.words, s.words), lambda q: CASE WHEN q[1] = q[2] THEN 1 ELSE 0 END)) / len(s.words)) AS shares
        FROM play p JOIN steps s ON s.log_source = p.log_source AND s.leaf = p.leaf AND s.step = p.step + 1)))),
numbered AS (
  SELECT log_source, line_id AS group_line, row_number() OVER (PARTITION BY log_source ORDER BY line_id) AS event_id
  FROM play WHERE line_id = group_line)
"""


def oracles() -> dict[str, str]:
    parse = _with(SCORED, 'SELECT line_id, stamp AS "timestamp", level, message FROM scored')
    out = {
        "scan_log_lines": _with(
            SCORED, "SELECT row_number() OVER (ORDER BY line_id) AS line_id, raw_log FROM scored"
        ),
        "profile_logs": _with(SCORED, f"""
SELECT 'events.log' AS file_name, CAST(sum(strlen(raw_log) + 1) AS BIGINT) AS size_bytes,
  CAST(round_even(sum(strlen(raw_log) + 1) / 1048576.0, 2) AS DOUBLE) AS size_mb,
  count(*) AS total_lines, count(*) AS non_empty_lines, count(*) > {fixed.LARGE_LOG_ROWS} AS is_large,
  (SELECT string_agg(raw_log, chr(10) ORDER BY line_id) FROM
    (SELECT line_id, raw_log FROM scored ORDER BY line_id LIMIT 5)) AS sample_lines
FROM scored"""),
        "parse_header": parse,
        "parse_strict": _with(
            SCORED, "SELECT line_id, substr(stamp, 12) AS \"timestamp\", level, message FROM scored"
        ),
        "csv_log_scan": _with(RAW, 'SELECT source, "timestamp", level, message, CAST(1 AS BIGINT) AS first_line FROM raw'),
        "directory_ingest": _with(RAW, """
SELECT source, 'whole' AS status, count(*) AS n, count(*) AS stored,
  CAST(count(DISTINCT CASE WHEN source IN ('src0.log', 'src1.log') THEN message ELSE raw_log END) AS BIGINT) AS messages,
  min(CASE WHEN source IN ('src0.log', 'src1.log') THEN level ELSE 'INFO' END) AS least_level
FROM raw JOIN (SELECT line_id, raw_log FROM scored) USING (line_id) GROUP BY 1"""),
        "ingest_counts": _with(SCORED, "SELECT log_source AS source, count(*) AS n FROM scored GROUP BY 1"),
        "raw_append": _with(RAW, """
SELECT line_id, "timestamp", level, message, source, strptime("timestamp", '%Y-%m-%d %H:%M:%S') AS ts,
  count(*) OVER () AS n_ids, count(*) OVER () AS id_span
FROM raw"""),
        "replace_source": _with(RAW, """
SELECT line_id, "timestamp", level, message, source, count(*) OVER () AS n_ids, count(*) OVER () AS id_span FROM raw"""),
        "clear_source": _with(
            RAW, "SELECT source, count(*) AS n FROM raw WHERE source <> 'src0.log' GROUP BY 1"
        ),
        "incidents_sink": _with(INCIDENTS, f"""
SELECT * REPLACE ('events.log' AS log_source, 'run_b' AS run_id) FROM (SELECT {STORED} FROM incidents)"""),
        "delete_run": _with(INCIDENTS, f"SELECT {STORED} FROM incidents WHERE run_id <> 'run_1'"),
        "restore_run": _with(INCIDENTS, f"SELECT {STORED}, clean_log FROM incidents WHERE run_id = 'run_0'"),
        "report_rows": _with(INCIDENTS, """
SELECT line_id, level, event_template, root_cause, recommendation, log_source, run_id
FROM incidents WHERE run_id = 'run_0'"""),
        "alert_export": _with(INCIDENTS, f"SELECT {EXPORT} FROM incidents"),
        "report_stats": _with(SCORED, f"""
SELECT count(*) AS total_lines, count(*) FILTER (is_anomaly) AS anomaly_count,
  count(*) FILTER (is_anomaly) / count(*) AS anomaly_rate,
  count(*) FILTER (level IN {ERRORS}) AS error_count,
  (SELECT '{{' || string_agg('"' || level || '":' || n, ',' ORDER BY place) || '}}' FROM (
    SELECT level, count(*) AS n,
      list_position({fixed.SEVERITY_ORDER}, level) AS place FROM scored GROUP BY level))
    AS severity_counts,
  CAST(0 AS DOUBLE) AS silhouette_score, CAST(0 AS DOUBLE) AS davies_bouldin_index
FROM scored"""),
        "report_alerts_top150": _with(INCIDENTS, f"""
SELECT {EXPORT} FROM incidents ORDER BY is_anomaly DESC, anomaly_score DESC, line_id LIMIT 150"""),
        "json_report": _with(DOMAIN_SUMS.replace(PARSED, INCIDENTS), f"""
SELECT 'run_0' AS run_id, (SELECT count(*) FROM scored) AS total_lines,
  (SELECT count(*) FROM scored WHERE level = 'ERROR') AS n_error,
  (SELECT domain FROM domains ORDER BY score DESC, priority LIMIT 1) AS domain,
  string_agg(line_id, ',' ORDER BY is_anomaly DESC, anomaly_score DESC, line_id) AS alert_lines,
  arg_max(anomaly_score, (is_anomaly, anomaly_score)) AS top_score
FROM (SELECT * FROM incidents ORDER BY is_anomaly DESC, anomaly_score DESC, line_id LIMIT 500)"""),
        "clean_text": r"""
SELECT doc_id, trim(regexp_replace(nfc_normalize(coalesce(text, '')),
  '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+',
  ' ', 'g')) AS clean FROM documents""",
        "mask_template": _with(SCORED, f"SELECT line_id, {_mask('raw_log')} AS masked FROM scored"),
        "mask_documents": f"SELECT doc_id, {_mask('text')} AS masked FROM documents",
        "token_counts": r"""
SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '')) AS BIGINT)
  AS n_tokens FROM documents""",
        "truncate_long": f"""
SELECT doc_id, CASE WHEN length(text) > {fixed.MAX_MESSAGE_CHARS}
  THEN substr(text, 1, {fixed.MAX_MESSAGE_CHARS}) || {_quote(fixed.TRUNCATION_MARK)} ELSE text END
  AS text FROM documents""",
        "parse_level": _with(SCORED, rf"""
SELECT origin, id, coalesce(nullif(upper(regexp_extract(text, '(?i)\b({fixed.LEVEL_WORDS})\b', 1)), ''),
  'INFO') AS level
FROM (SELECT 'logs' AS origin, line_id AS id, raw_log AS text FROM scored
  UNION ALL SELECT 'documents', doc_id, text FROM documents)"""),
        "severity_label": _with(SCORED, "SELECT line_id, level AS severity_label FROM scored"),
        "drain_leaf_key": _with(SCORED, f"""
SELECT line_id, concat_ws(' ', len(t), {", ".join(
    f"CASE WHEN regexp_matches(t[{k}], '[0-9]') THEN '<*>' ELSE t[{k}] END" for k in (1, 2, 3))}) AS leaf
FROM (SELECT line_id, string_split({_mask('raw_log')}, ' ') AS t FROM scored)"""),
        "root_cause_rules": _with(PARSED, f"""
SELECT line_id, {_cause('event_template')} AS root_cause, {_family('event_template')} AS cause_family
FROM parsed"""),
        "recommend_action": _with(PARSED, f"""
SELECT line_id, {_action('cause')} AS recommendation
FROM (SELECT line_id, {_cause('event_template')} AS cause FROM parsed)"""),
        "incident_filter": _with(SCORED, f"SELECT line_id, level, is_anomaly FROM scored WHERE {INCIDENT}"),
        "alert_filter": _with(SCORED, f"SELECT line_id, level, is_anomaly FROM scored WHERE {ALERT}"),
        "search_level": _with(RAW, "SELECT * FROM raw WHERE level = 'ERROR' ORDER BY id DESC LIMIT 500"),
        "search_keyword": _with(
            RAW, "SELECT * FROM raw WHERE message ILIKE '%CONNECTION%' ORDER BY id DESC LIMIT 500"
        ),
        "search_incidents": _with(INCIDENTS, """
SELECT line_id, raw_log, root_cause, recommendation, log_source, created_at FROM incidents
WHERE raw_log ILIKE '%red%' OR root_cause ILIKE '%red%' OR recommendation ILIKE '%red%'
  OR log_source ILIKE '%red%'
ORDER BY created_at DESC, line_id DESC LIMIT 500"""),
        "explorer_search": _with(SCORED, """
SELECT line_id, raw_log, level FROM scored
WHERE regexp_matches(raw_log, 'timeout|killed by|login attempt', 'i')"""),
        "explorer_filter": _with(SCORED, f"""
SELECT line_id, level, semantic_cluster, is_anomaly FROM scored
WHERE level IN ('ERROR', 'CRITICAL', 'WARNING') AND semantic_cluster IN (0, 1, 2) AND {INCIDENT}
ORDER BY line_id LIMIT 1000"""),
        "get_by_id": _with(RAW, "SELECT * FROM raw WHERE id = 7"),
        "list_logs": _with(
            RAW, "SELECT * FROM raw WHERE source = 'src2.log' ORDER BY id DESC LIMIT 200"
        ),
        "list_incidents": _with(INCIDENTS, """
SELECT line_id, level, event_template, root_cause, created_at FROM incidents
ORDER BY created_at DESC, line_id DESC LIMIT 200"""),
        "list_run_incidents": _with(INCIDENTS, """
SELECT line_id, level, event_template, root_cause, run_id FROM incidents
WHERE run_id = 'run_2' ORDER BY line_id LIMIT 200"""),
        "facet_values": _with(SCORED, """
SELECT DISTINCT 'level' AS facet, level AS value FROM scored
UNION ALL SELECT DISTINCT 'semantic_cluster', CAST(semantic_cluster AS VARCHAR) FROM scored"""),
        "count_logs": _with(RAW, "SELECT count(*) AS n FROM raw WHERE source = 'src1.log'"),
        "semantic_map": _with(PARSED, """,
top AS (
  SELECT event_template, CAST(min(line_id) % 8 AS INTEGER) AS label FROM parsed GROUP BY 1)
SELECT line_id, coalesce(label, -1) AS semantic_cluster
FROM parsed LEFT JOIN top USING (event_template)"""),
        "semantic_map_all": _dbscan(
            _terms(ONE_EACH, fixed.TFIDF_SEMANTIC_TERMS), fixed.SEMANTIC_EPS,
            fixed.SEMANTIC_MIN_SAMPLES, by_frequency=True,
        ) + """SELECT line_id, coalesce(label, -1) AS semantic_cluster
FROM parsed LEFT JOIN (SELECT text, label FROM labelled JOIN texts USING (first_line)) ON text = event_template""",
        "drain_templates": f"WITH RECURSIVE {DRAIN}" + """
SELECT p.log_source, p.line_id, k.level, event_id, template AS event_template
FROM play p JOIN numbered n ON n.log_source = p.log_source AND n.group_line = p.group_line
JOIN keyed k ON k.log_source = p.log_source AND k.line_id = p.line_id""",
        "diagnose_rules": _with(
            DIAGNOSED, "SELECT line_id, root_cause, recommendation, severity_label FROM diagnosed"
        ),
        "diagnose_semantic": _with(_semantic(0.1), """
SELECT text, round(best_score, 6) AS best_score, root_cause, recommendation, cause_family FROM answers"""),
        "diagnose_rows": _with(_semantic(fixed.MATCH_THRESHOLD), f"""
SELECT line_id, coalesce(a.root_cause, {_quote(fixed.NORMAL_CAUSE)}) AS root_cause,
  coalesce(a.recommendation, {_quote(fixed.NORMAL_ACTION)}) AS recommendation, level AS severity_label
FROM parsed p LEFT JOIN answers a ON {ALERT} AND a.text = p.event_template"""),
        "cosine_neighbors": _with(_terms(ONE_EACH, fixed.TFIDF_SEMANTIC_TERMS), f"""
SELECT least(a.first_line, b.first_line) AS id_a, greatest(a.first_line, b.first_line) AS id_b,
  round(sum(x.weight * y.weight), 6) AS similarity
FROM weights x JOIN weights y USING (term)
JOIN texts a ON a.text = x.text JOIN texts b ON b.text = y.text
WHERE a.first_line < b.first_line
GROUP BY 1, 2 HAVING round(sum(x.weight * y.weight), 9) >= 1 - {fixed.SEMANTIC_EPS}"""),
        "dbscan_clusters": _dbscan(
            _terms(ROW_TEXTS, fixed.TFIDF_ROW_TERMS), fixed.DBSCAN_EPS, fixed.DBSCAN_MIN_SAMPLES
        ) + "SELECT first_line AS vec_id, label, text, m FROM labelled JOIN texts USING (first_line)",
        "semantic_clusters": _dbscan(
            _terms(ONE_EACH, fixed.TFIDF_SEMANTIC_TERMS), fixed.SEMANTIC_EPS,
            fixed.SEMANTIC_MIN_SAMPLES, by_frequency=True,
        ) + "SELECT text, label FROM labelled JOIN texts USING (first_line)",
        "embedding_clusters": f"""
WITH RECURSIVE unit AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
pairs AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM unit x JOIN unit y ON x.vec_id <> y.vec_id
  WHERE round(list_cosine_similarity(x.e, y.e), 9) >= 1 - {fixed.SEMANTIC_EPS}),
reach(start, node) AS (
  SELECT vec_id, vec_id FROM unit UNION SELECT start, b FROM reach JOIN pairs ON a = node),
roots AS (SELECT start AS vec_id, min(node) AS root FROM reach GROUP BY start)
SELECT vec_id, CAST(dense_rank() OVER (ORDER BY root) - 1 AS INTEGER) AS label FROM roots""",
        "compare_runs": _with(RUNS, """
SELECT """ + ",\n  ".join(
            f"a.{c} AS {c}_a, b.{c} AS {c}_b, b.{c} - a.{c} AS {c}_diff, "
            f"CAST(CASE WHEN a.{c} = 0 THEN 0 ELSE round_even((b.{c} - a.{c}) * 100.0 / a.{c}, 1) END AS DOUBLE) AS {c}_pct"
            for c in ("total_events", "anomalies", "errors")
        ) + """
FROM runs a, runs b
WHERE a.run_id = 'run_0' AND a.log_source = 'src0.log'
  AND b.run_id = 'run_1' AND b.log_source = 'src1.log'"""),
        "list_runs": _with(RUNS, "SELECT * FROM runs"),
        "recent_runs": _with(
            RUNS, "SELECT * FROM runs ORDER BY created_at DESC, run_id, log_source LIMIT 8"
        ),
        "history_totals": _with(RUNS, """
SELECT count(*) AS n_runs, CAST(sum(anomalies) AS BIGINT) AS anomalies,
  CAST(sum(errors) AS BIGINT) AS errors FROM runs"""),
        "new_templates": _with(INCIDENTS, """
SELECT event_template FROM incidents WHERE run_id = 'run_1'
EXCEPT SELECT event_template FROM incidents WHERE run_id = 'run_0'"""),
        "resolved_templates": _with(INCIDENTS, """
SELECT event_template FROM incidents WHERE run_id = 'run_0'
EXCEPT SELECT event_template FROM incidents WHERE run_id = 'run_1'"""),
        "incident_summary": _with(INCIDENTS, f"""
SELECT count(*) AS total, count(*) FILTER (is_anomaly) AS anomalies,
  count(*) FILTER (level IN {ERRORS}) AS errors,
  (SELECT string_agg(level || '=' || n, ',' ORDER BY level)
   FROM (SELECT level, count(*) AS n FROM incidents GROUP BY level)) AS severity_counts
FROM incidents"""),
        "log_domain": _with(DOMAIN_SUMS, "SELECT domain, score, priority FROM domains WHERE score > 0"),
        "executive_summary": _with(DOMAIN_SUMS, f"""
SELECT coalesce((SELECT domain FROM domains WHERE score > 0 ORDER BY score DESC, priority LIMIT 1),
    {_quote(fixed.NO_DOMAIN)}) AS domain,
  CASE WHEN critical > 0 THEN {_quote(fixed.POSTURE_CRITICAL)}
       WHEN anomalies > 0 OR errors > 0 THEN {_quote(fixed.POSTURE_DEGRADED)}
       ELSE {_quote(fixed.POSTURE_CALM)} END AS posture,
  CASE WHEN anomalies > 0 THEN {_quote(fixed.FOCUS_ANOMALIES)}
       WHEN errors > 0 THEN {_quote(fixed.FOCUS_ERRORS)}
       ELSE {_quote(fixed.FOCUS_CALM)} END AS focus,
  {_dots('total')} || ' eventos procesados, ' || {_dots('errors')} || ' errores y '
    || {_dots('anomalies')} || ' anomalias.' AS volume,
  total, errors, anomalies, critical
FROM (SELECT {TOTALS} FROM parsed)"""),
        "top_templates": _with(PARSED, """
SELECT event_template, count(*) AS n FROM parsed GROUP BY 1 ORDER BY n DESC, event_template LIMIT 5"""),
        "root_cause_summary": _with(DIAGNOSED, """
SELECT root_cause, count(*) AS n, count(*) FILTER (is_anomaly) AS anomalies,
  max(anomaly_score) AS score_max FROM diagnosed GROUP BY 1"""),
        "pattern_stats": _with(PARSED, """,
levels AS (
  SELECT event_template, level, count(*) AS n, min(line_id) AS first_line FROM parsed GROUP BY 1, 2),
modes AS (
  SELECT event_template, level AS dominant_level FROM levels
  QUALIFY row_number() OVER (PARTITION BY event_template ORDER BY n DESC, first_line) = 1)
SELECT event_template, count(*) AS n, count(*) FILTER (is_anomaly) AS anomalies,
  max(anomaly_score) AS score_max,
  round_even(sum(CAST(round(anomaly_score * 10000) AS BIGINT)) / count(*), 0) / 10000 AS score_mean,
  any_value(dominant_level) AS dominant_level,
  round_even(count(*) FILTER (is_anomaly) / count(*) * 100, 1) AS anomaly_rate
FROM parsed JOIN modes USING (event_template) GROUP BY 1"""),
        "severity_distribution": _with(SCORED, f"""
SELECT level, n, round_even(n / sum(n) OVER () * 100, 1) AS percentage,
  CAST(coalesce(list_position({fixed.SEVERITY_ORDER}, level) - 1, 99) AS INTEGER) AS severity_rank
FROM (SELECT level, count(*) AS n FROM scored GROUP BY 1)"""),
        "cluster_counts": _with(SCORED, f"""
SELECT semantic_cluster, count(*) AS n, CASE WHEN semantic_cluster >= 0
  THEN concat('Cluster ', semantic_cluster) ELSE '{fixed.UNASSIGNED}' END AS cluster_label
FROM scored GROUP BY 1"""),
        "cluster_heatmap": _with(SCORED, f"""
SELECT semantic_cluster, {", ".join(
    f"count(*) FILTER (level = '{x}') AS {x}" for x in fixed.SEVERITY_ORDER)},
  CASE WHEN semantic_cluster >= 0 THEN concat('Cluster ', semantic_cluster)
    ELSE '{fixed.UNASSIGNED}' END AS cluster_label
FROM scored GROUP BY 1 ORDER BY count(*) DESC, semantic_cluster LIMIT 3"""),
        "kpi_metrics": _with(SCORED, f"""
SELECT total, anomalies, errors, clusters, critical, anomalies * 100.0 / total AS anomaly_rate
FROM (SELECT {TOTALS}, count(DISTINCT semantic_cluster) AS clusters FROM scored)"""),
        "risk_index": _with(SCORED, f"""
SELECT risk_score, CASE WHEN risk_score >= 70 THEN 'Alto' WHEN risk_score >= 35 THEN 'Medio'
  ELSE 'Bajo' END AS risk_label
FROM (SELECT CAST(least(100, round_even(critical * 18 + errors * 9 + anomalies * 12
    + anomalies * 100.0 / total, 0)) AS BIGINT) AS risk_score
  FROM (SELECT {TOTALS} FROM scored))"""),
        "system_status": _with(SCORED, f"""
SELECT CASE WHEN critical > 0 THEN 'Crítico' WHEN anomalies > 0 THEN 'Atención' ELSE 'Estable' END
    AS status,
  CASE WHEN critical > 0 OR anomalies > 2 THEN 'Alta' WHEN anomalies > 0 THEN 'Media' ELSE 'Baja' END
    AS priority
FROM (SELECT {TOTALS} FROM scored)"""),
        "alert_badge": _with(SCORED, f"""
SELECT alerts, CASE WHEN alerts > 5 THEN 'CRÍTICO' WHEN alerts > 0 THEN 'ATENCIÓN' ELSE 'ESTABLE' END
    AS badge, anomalies, errors,
  CASE WHEN anomalies > 5 THEN 'Crítico' WHEN anomalies > 0 THEN 'Atención' ELSE 'Estable' END
    AS header_badge
FROM (SELECT {TOTALS}, count(*) FILTER {INCIDENT} AS alerts FROM scored)"""),
        "alert_severity": _with(
            SCORED, f"SELECT level, count(*) AS n FROM scored WHERE {INCIDENT} GROUP BY 1"
        ),
        "score_range": _with(SCORED, """
SELECT min(anomaly_score) AS min_score, CASE WHEN min(anomaly_score) >= max(anomaly_score)
  THEN min(anomaly_score) + 1 ELSE max(anomaly_score) END AS max_score FROM scored"""),
        "alert_inbox": _with(INCIDENTS, f"SELECT {EXPORT.replace(', clean_log', '')} FROM incidents"),
        "alert_timeline": _with(DIAGNOSED, f"""
SELECT line_id, level, is_anomaly, anomaly_score,
  CAST(CASE WHEN level IN {CRITICAL} THEN 4 WHEN level = 'ERROR' THEN 3
    WHEN level IN ('WARNING', 'WARN') THEN 2 ELSE 1 END AS INTEGER) AS y_pos,
  root_cause, recommendation, substr(clean_log, 1, 100) AS snippet
FROM diagnosed WHERE {ALERT} ORDER BY anomaly_score DESC, line_id LIMIT 300"""),
        "risk_trend": _with(SCORED + TREND, """
SELECT log_source, line_id, round(smoothed_risk, 6) AS smoothed_risk,
  round(normalized_risk, 6) AS normalized_risk, round(least(normalized_risk, 0.4), 6) AS low_band,
  round(greatest(normalized_risk, 0.7), 6) AS high_band FROM trend"""),
        "risk_peaks": _with(SCORED + TREND, f"""
SELECT log_source, line_id, level, anomaly_score, substr(raw_log, 1, 70) AS snippet,
  round(normalized_risk, 6) AS normalized_risk
FROM trend JOIN (SELECT line_id, level, anomaly_score, raw_log FROM scored
  WHERE is_anomaly AND level IN {ERRORS} ORDER BY anomaly_score DESC, line_id LIMIT 60) USING (line_id)"""),
        "semantic_candidates": _with(ROW_TEXTS, f"""
SELECT text, m, first_line FROM texts"""),
        "numeric_features": _with(_features(), "SELECT * FROM numeric_rows"),
        "scaled_features": _with(_features(), f"""
SELECT line_id, {_scaled('severity')}, {_scaled('template_frequency')}, {_scaled('message_length')}
FROM numeric_rows"""),
        "tfidf_terms": _with(_terms(ROW_TEXTS, fixed.TFIDF_ROW_TERMS), """
SELECT term, total, df, round(idf, 6) AS idf FROM vocabulary"""),
        "tfidf_weights": _with(_terms(ROW_TEXTS, fixed.TFIDF_ROW_TERMS), """
SELECT text, term, round(weight, 6) AS weight FROM weights"""),
        "tfidf_384": _with(_terms(ONE_EACH, fixed.TFIDF_SEMANTIC_TERMS), """
SELECT text, term, round(weight, 6) AS weight FROM weights"""),
        "silhouette": _with(POINTS, """,
dots AS (
  SELECT p.text, p.label AS own, p.m, z.label, z.size, coalesce(sum(w.weight * s.s), 0) AS dot
  FROM points p CROSS JOIN sizes z
  LEFT JOIN weights w ON w.text = p.text
  LEFT JOIN sums s ON s.label = z.label AND s.term = w.term
  GROUP BY ALL),
sides AS (
  SELECT text, own, any_value(m) AS m, max(size) FILTER (label = own) AS size,
    max(size - dot) FILTER (label = own) AS inside,
    min(1 - dot / size) FILTER (label <> own) AS b
  FROM dots GROUP BY text, own)
SELECT round(sum(m * CASE WHEN size = 1 THEN 0 ELSE
    (b - inside / (size - 1)) / greatest(b, inside / (size - 1)) END) / sum(m), 6) AS silhouette
FROM sides"""),
        "davies_bouldin": _with(POINTS, """,
centres AS (SELECT label, term, s / size AS c FROM sums JOIN sizes USING (label)),
norms AS (SELECT label, sum(c * c) AS cc FROM centres GROUP BY 1),
far AS (
  SELECT p.text, p.label, any_value(p.m) AS m,
    sqrt(greatest(0, 1 - 2 * sum(w.weight * c.c) + any_value(n.cc))) AS d
  FROM points p JOIN weights w USING (text) JOIN centres c ON c.label = p.label AND c.term = w.term
  JOIN norms n ON n.label = p.label GROUP BY p.text, p.label),
spread AS (SELECT label, sum(d * m) / sum(m) AS s FROM far GROUP BY 1),
cross_dots AS (
  SELECT a.label AS i, b.label AS j, sum(a.c * b.c) AS dot FROM centres a JOIN centres b USING (term)
  WHERE a.label <> b.label GROUP BY 1, 2),
ratios AS (
  SELECT i, (si.s + sj.s) / sqrt(ni.cc + nj.cc - 2 * dot) AS r FROM cross_dots
  JOIN spread si ON si.label = i JOIN spread sj ON sj.label = j
  JOIN norms ni ON ni.label = i JOIN norms nj ON nj.label = j)
SELECT round(avg(top), 6) AS davies_bouldin FROM (SELECT i, max(r) AS top FROM ratios GROUP BY i)"""),
        "most_similar": """
SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 6) AS score
FROM embeddings, (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1)
ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) DESC, vec_id LIMIT 10""",
        "most_similar_batch": """
WITH scores AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    round(list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 9) AS score
  FROM embeddings q JOIN embeddings c ON q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores)
WHERE rank <= 10""",
        "mean_pool": """
SELECT label, position, round(avg(x), 6) AS x FROM (
  SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x,
    CAST(unnest(range(len(embedding))) AS INTEGER) AS position FROM embeddings)
GROUP BY label, position""",
    }
    out["drain_hot_leaves"] = out["drain_templates"]
    return out
