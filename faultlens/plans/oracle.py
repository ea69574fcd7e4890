"""DuckDB oracle SQL for every registered query with a SQL form."""

from __future__ import annotations

from faultlens.plans import sqlparts as S
from faultlens.sources import fixtures as FX
from faultlens.sources.fixtures import views_sql


def _q(body: str) -> str:
    return S.fix_rounding(views_sql() + body)


_LOG_ROLLUP = f"""(
WITH w AS (SELECT i.uuid, l.timestamp_ns, l.k8_pod, l.k8_node_name, l.message
      FROM logs l JOIN incidents i ON l.timestamp_ns BETWEEN i.start_timestamp AND i.end_timestamp
      WHERE {S.error_pred('l.message')}),
tk AS (SELECT *, {S.tokens('message')} AS tokens FROM w),
bk AS (SELECT *, {S.bucket_key('tokens')} AS bucket_key FROM tk),
tpl AS {S.templates('bk', ['uuid'])},
m AS (SELECT bk.*, tpl.template FROM bk JOIN tpl ON bk.uuid = tpl.uuid AND md5(array_to_string(bk.tokens, ' ')) = tpl.list_id
      WHERE k8_pod IS NOT NULL AND k8_node_name IS NOT NULL)
SELECT uuid, k8_node_name AS node_name, {S.service_from_pod('k8_pod')} AS service_name, k8_pod AS pod_name,
       min({{'t': timestamp_ns, 'm': message}}).m AS message, CAST(count(*) AS BIGINT) AS occurrence_count
FROM m GROUP BY uuid, k8_pod, k8_node_name, template
)"""
LOG_ERROR_ROLLUP = _q(f"SELECT * FROM {_LOG_ROLLUP} t")

LOG_REDUCTION_REPORT = _q(f""",
c AS (SELECT i.uuid, CAST(count(*) AS BIGINT) AS n_window_rows,
             CAST(sum(CASE WHEN {S.error_pred('l.message')} THEN 1 ELSE 0 END) AS BIGINT) AS n_error_rows
      FROM logs l JOIN incidents i ON l.timestamp_ns BETWEEN i.start_timestamp AND i.end_timestamp GROUP BY i.uuid),
r AS (SELECT uuid, CAST(count(*) AS BIGINT) AS n_rollup_rows FROM {_LOG_ROLLUP} t GROUP BY uuid)
SELECT c.uuid, n_window_rows, n_error_rows, CAST(coalesce(n_rollup_rows, 0) AS BIGINT) AS n_rollup_rows
FROM c LEFT JOIN r USING (uuid)""")


LOG_TIME_ERROR_FILTER = _q(f"""
SELECT i.uuid, l.timestamp_ns, l.time_beijing, l.k8_pod, l.message, l.k8_node_name
FROM logs l JOIN incidents i ON l.timestamp_ns BETWEEN i.start_timestamp AND i.end_timestamp
WHERE {S.error_pred('l.message')}""")

_DOC_LINES = """(SELECT doc_id, unnest(string_split(text, chr(10))) AS message,
  generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)"""
_DOC_TOK = f"(SELECT doc_id, line_no, message, {S.tokens('message')} AS tokens FROM {_DOC_LINES} dl)"
_DOC_BK = f"(SELECT *, {S.bucket_key('tokens')} AS bucket_key FROM {_DOC_TOK} dt)"
_DOC_TPL = S.templates(_DOC_BK, [])

LOG_TEMPLATE_MINE = _q(f"""SELECT t.bucket_key, t.cluster, t.template, CAST(count(*) AS BIGINT) AS cluster_size
FROM {_DOC_BK} b JOIN {_DOC_TPL} t ON md5(array_to_string(b.tokens, ' ')) = t.list_id GROUP BY ALL""")

LOG_TEMPLATE_MATCH = _q(f"""SELECT b.doc_id, CAST(b.line_no AS INTEGER) AS line_no, t.template
FROM {_DOC_BK} b LEFT JOIN {_DOC_TPL} t ON md5(array_to_string(b.tokens, ' ')) = t.list_id""")


def _mask_sql(col: str) -> str:
    from faultlens.operators.logs import DEFAULT_MASK_RULES
    out = col
    for pattern, name in DEFAULT_MASK_RULES:
        out = f"regexp_replace({out}, '{pattern}', '<:{name}:>', 'g')"
    return out


LOG_MASK_RULES = _q(f"""SELECT doc_id, md5(m) AS masked_md5,
  CAST((length(m) - length(replace(m, '<:', ''))) / 2 AS BIGINT) AS n_masks
FROM (SELECT doc_id, {_mask_sql('text')} AS m FROM documents) d""")

PERIODS = S.periods(FX.FIXTURE_GAP_NS)

INCIDENT_NORMAL_PERIODS = _q(f"SELECT * FROM {PERIODS} p")

_UNPIVOT = f"""(SELECT entity, timestamp_ns, metric, value FROM
  (UNPIVOT wide_metrics ON {', '.join(FX.WIDE_METRIC_COLUMNS)} INTO NAME metric VALUE value) u
  WHERE value IS NOT NULL AND NOT isnan(value))"""

METRIC_UNPIVOT = _q(f"SELECT * FROM {_UNPIVOT} t")

METRIC_TRIMMED_STATS = _q(f"SELECT * FROM {S.trimmed_describe(_UNPIVOT, ['entity', 'metric'])} t")


def _samples(cols: str, where: str = "") -> str:
    pts = f"(SELECT {cols}, timestamp_ns, value FROM metric_points {where})"
    return S.period_samples(pts, PERIODS)


def _wl(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


METRIC_PERIOD_COMPARE = _q(f"SELECT * FROM {S.compare_periods(_samples('pod, metric'), ['pod', 'metric'])} t")

_NODE_SHIFT = S.compare_periods(
    _samples('node, metric', f'WHERE node IN {_wl(FX.NODE_WHITELIST)}'), ['node', 'metric'])
METRIC_NODE_SHIFT = _q(f"SELECT * FROM {_NODE_SHIFT} t")

_POD_SHIFT = S.compare_periods(
    _samples('node AS instance, pod, metric', f'WHERE node IS NOT NULL AND pod IN {_wl(FX.POD_WHITELIST)}'),
    ['instance', 'pod', 'metric'])
METRIC_POD_SHIFT = _q(f"SELECT * FROM {_POD_SHIFT} t")

_DB_STATS = S.compare_periods(_samples('service, metric'), ['service', 'metric'], gate=False)
METRIC_DB_STATS = _q(f"SELECT * FROM {_DB_STATS} t")

_SVC = S.compare_periods(_samples('service, metric'), ['service', 'metric'])
_POD_SAMPLES = _samples('pod, metric')
_SVC_DRILL = f"""(
WITH abn AS (SELECT uuid, service, metric FROM {_SVC} s),
pods AS (SELECT DISTINCT uuid, pod FROM {_POD_SAMPLES} ps),
allowed AS (SELECT a.uuid, a.service, p.pod, a.metric FROM abn a JOIN pods p
            ON a.uuid = p.uuid AND starts_with(p.pod, a.service)),
samples AS (SELECT ps.*, al.service FROM {_POD_SAMPLES} ps JOIN allowed al USING (uuid, pod, metric))
SELECT * FROM {S.compare_periods('samples', ['service', 'pod', 'metric'], gate=False)} t
)"""
METRIC_SERVICE_DRILLDOWN = _q(f"SELECT * FROM {_SVC_DRILL} t")


# -------------------------------------------------------------------- traces
from faultlens.operators import traces as T  # noqa: E402

_ENR = S.enriched("incidents")
_SAMPLED = S.sampled_incidents(T.SAMPLE_SIZE, T.SEED)
_NORMAL_WIN = f"(SELECT uuid, end_timestamp AS lo, end_timestamp + {FX.FIXTURE_AFTER_NS} AS hi FROM {_SAMPLED} sm)"
_ENR_NORMAL = S.enriched(_NORMAL_WIN, "lo", "hi")
_TRAIN = S.anchored(_ENR_NORMAL, FX.FIXTURE_WINDOW_NS)
_DETECT = S.anchored(_ENR, FX.FIXTURE_WINDOW_NS)
_BASE = S.baseline(_TRAIN)
_SK = ", ".join(S.STATUS_KEYS)

SPAN_ENRICH = _q(f"""SELECT uuid, timestamp_ns, parent_spanID, spanID, parent_pod, child_pod, parent_service,
  service_name, node_name, operationName, duration FROM {_ENR} e""")

_STATUS_ROWS = f"""(
WITH s AS (SELECT uuid, coalesce(node_name, 'N/A') AS node_name,
             coalesce(CASE WHEN service_name = 'redis' THEN 'redis-cart' ELSE service_name END, 'N/A') AS service_name,
             coalesce(parent_pod, 'N/A') AS parent_pod, coalesce(child_pod, 'N/A') AS child_pod,
             coalesce(operationName, 'N/A') AS operation_name, status_code, status_message
      FROM {_ENR} e WHERE has_status_message AND status_code IS NOT NULL AND status_code <> '0'),
g AS (SELECT uuid, {_SK}, CAST(count(*) AS BIGINT) AS occurrence_count FROM s GROUP BY uuid, {_SK}),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY uuid ORDER BY occurrence_count DESC,
      {', '.join(k + ' NULLS FIRST' for k in S.STATUS_KEYS)}) AS INTEGER) AS rank FROM g)
SELECT *, '{T.COUNT_TEXT_PREFIX}' || CAST(occurrence_count AS VARCHAR) AS occurrence_text FROM r"""
_STATUS_ALL = f"{_STATUS_ROWS}\n)"          # attribution uses every combination, the report its top rows
_STATUS = f"{_STATUS_ROWS} WHERE rank <= {T.TOP_N}\n)"
SPAN_STATUS_COMBOS = _q(f"SELECT * FROM {_STATUS} t")


INCIDENT_SAMPLE = _q(f"SELECT * FROM {S.sampled_incidents(5, T.SEED)} s")

SPAN_NORMAL_EXTRACT = _q(f"""SELECT uuid, {S.EDGE}, CAST(count(*) AS BIGINT) AS n_spans, min(timestamp_ns) AS min_ts,
  max(timestamp_ns) AS max_ts, round(avg(duration), 6) AS mean_duration
FROM {_ENR_NORMAL} e WHERE parent_pod IS NOT NULL AND child_pod IS NOT NULL AND node_name IS NOT NULL
  AND operationName IS NOT NULL GROUP BY uuid, {S.EDGE}""")

TRACE_ANCHORED_WINDOWS = _q(f"""SELECT uuid, {S.EDGE}, window_start, round(mean_duration, 6) AS mean_duration,
  n_spans, first_service FROM {_DETECT} d""")

TRACE_EDGE_BASELINE = _q(f"""SELECT {S.EDGE}, round(mean, 6) AS mean, round(std, 6) AS std, round(median, 6) AS median,
  round(min, 6) AS min, round(max, 6) AS max, count, round(p99, 6) AS p99 FROM {_BASE} b""")

_FLAGGED_EVENTS = f"""(SELECT d.* FROM {_DETECT} d JOIN {_BASE} b USING (parent_pod, child_pod, node_name, operationName)
  WHERE d.mean_duration > b.p99)"""
_FLAGGED_TOPK = S.topk_anomalies(_FLAGGED_EVENTS, _BASE, T.TOP_N, T.COUNT_TEXT_PREFIX)
TRACE_FLAGGED_TOPK = _q(f"SELECT * FROM {_FLAGGED_TOPK} t")

TRACE_DIMENSION_LISTS = _q(f"""SELECT uuid,
  array_to_string(list_sort(list_distinct(flatten([list(child_pod), list(parent_pod)]))), ',') AS pod_names,
  array_to_string(list_sort(list_distinct(list(service_name))), ',') AS service_names,
  array_to_string(list_sort(list_distinct(list(node_name))), ',') AS node_names
FROM {_FLAGGED_TOPK} t GROUP BY uuid""")

TRACE_FRAME_PROFILE = _q(f"""SELECT uuid, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT child_pod) AS BIGINT) AS n_pods,
  CAST(count(DISTINCT service_name) AS BIGINT) AS n_services, CAST(count(DISTINCT node_name) AS BIGINT) AS n_nodes,
  CAST(count(DISTINCT spanID) AS BIGINT) AS n_spans, min(timestamp_ns) AS min_ts, max(timestamp_ns) AS max_ts
FROM {_ENR} e GROUP BY uuid""")

CALL_GRAPH_EDGES = _q(f"""SELECT uuid, parent_service, service_name, CAST(count(*) AS BIGINT) AS n_calls,
  CAST(sum(CASE WHEN parent_pod = child_pod THEN 1 ELSE 0 END) AS BIGINT) AS n_self_loop,
  CAST(count(DISTINCT (parent_pod, child_pod)) AS BIGINT) AS n_pod_pairs
FROM {_ENR} e WHERE parent_service IS NOT NULL AND service_name IS NOT NULL
GROUP BY uuid, parent_service, service_name""")

CALL_CHAIN_EDGES = _q(f""",
cs AS ({FX.CONV_SPANS_SQL}),
par AS (SELECT spanID, arg_max(child_pod, timestamp_ns) AS parent_pod, arg_max(service_name, timestamp_ns) AS parent_service
        FROM cs GROUP BY spanID),
e AS (SELECT cs.*, par.parent_pod, par.parent_service FROM cs LEFT JOIN par ON cs.parent_spanID = par.spanID)
SELECT 'conversations' AS uuid, parent_service, service_name, CAST(count(*) AS BIGINT) AS n_calls,
  CAST(sum(CASE WHEN parent_pod = child_pod THEN 1 ELSE 0 END) AS BIGINT) AS n_self_loop,
  CAST(count(DISTINCT (parent_pod, child_pod)) AS BIGINT) AS n_pod_pairs
FROM e WHERE parent_service IS NOT NULL AND service_name IS NOT NULL
GROUP BY parent_service, service_name""")

# ------------------------------------------------------------------ evidence
from faultlens.operators import evidence as E  # noqa: E402


def _csv_field(col: str, dbl: bool = False) -> str:
    v = f"printf('%.6f', {col})" if dbl else f"CAST({col} AS VARCHAR)"
    v = f"coalesce({v}, '')"
    return (f"(CASE WHEN contains({v}, ',') OR contains({v}, '\"') OR contains({v}, chr(10)) "
            f"OR contains({v}, chr(13)) THEN '\"' || replace({v}, '\"', '\"\"') || '\"' ELSE {v} END)")


def _section(src: str, cols, dbl_cols, order: str, name: str) -> str:
    line = " || ',' || ".join(_csv_field(c, c in dbl_cols) for c in cols)
    return f"""(SELECT uuid, '{','.join(cols)}' || chr(10) || string_agg({line}, chr(10) ORDER BY {order}) AS {name}_section,
  CAST(count(*) AS BIGINT) AS n_{name}_rows FROM {src} x GROUP BY uuid)"""


_METRIC_ROWS = f"""(
  SELECT uuid, 'node' AS source, node AS entity, metric, normal_mean, fault_mean, mean_ratio FROM {_NODE_SHIFT} a
  UNION ALL SELECT uuid, 'pod', concat_ws('/', instance, pod), metric, normal_mean, fault_mean, mean_ratio FROM {_POD_SHIFT} b
  UNION ALL SELECT uuid, 'service', concat_ws('/', service, pod), metric, normal_mean, fault_mean, mean_ratio FROM {_SVC_DRILL} c
  UNION ALL SELECT uuid, 'tidb', service, metric, normal_mean, fault_mean, mean_ratio FROM {_DB_STATS} d
)"""

_DBL = {"normal_avg_duration", "anomaly_avg_duration", "normal_mean", "fault_mean", "mean_ratio"}
_MOD = E.MODALITY_NAMES

EVIDENCE_BUNDLE = _q(f""",
ls AS {_section(_LOG_ROLLUP, E.LOG_SECTION_COLUMNS, _DBL, 'occurrence_count DESC, pod_name, node_name, message', 'log')},
ts AS {_section(_FLAGGED_TOPK, E.TRACE_SECTION_COLUMNS, _DBL, 'rank', 'trace')},
ss AS {_section(_STATUS, E.STATUS_SECTION_COLUMNS, _DBL, 'rank', 'status')},
ms AS {_section(_METRIC_ROWS, E.METRIC_SECTION_COLUMNS, _DBL, 'source, entity, metric', 'metric')},
b AS (SELECT * FROM ls FULL OUTER JOIN ts USING (uuid) FULL OUTER JOIN ss USING (uuid) FULL OUTER JOIN ms USING (uuid)),
c AS (SELECT uuid, coalesce(n_log_rows, 0) AS n_log_rows, coalesce(n_trace_rows, 0) AS n_trace_rows,
             coalesce(n_status_rows, 0) AS n_status_rows, coalesce(n_metric_rows, 0) AS n_metric_rows,
             log_section, concat_ws(chr(10), trace_section, status_section) AS tt, metric_section FROM b)
SELECT uuid,
  concat_ws('{E.MODALITY_SEPARATOR}', CASE WHEN n_log_rows > 0 THEN '{_MOD[0]}' END,
            CASE WHEN n_trace_rows + n_status_rows > 0 THEN '{_MOD[1]}' END,
            CASE WHEN n_metric_rows > 0 THEN '{_MOD[2]}' END) AS modalities,
  n_log_rows, n_trace_rows, n_status_rows, n_metric_rows, log_section,
  CASE WHEN tt <> '' THEN tt END AS trace_section, metric_section
FROM c
""")

_EVIDENCE = f"""(
  SELECT uuid, pod_name AS pod, node_name AS node, 'log' AS source FROM {_LOG_ROLLUP} a
  UNION ALL SELECT uuid, child_pod, CASE WHEN node_name <> 'N/A' THEN node_name END, 'trace' FROM {_STATUS_ALL} b
    WHERE child_pod <> 'N/A'
  UNION ALL SELECT uuid, pod, instance, 'metric' FROM {_POD_SHIFT} c WHERE status = 'shifted'
  UNION ALL SELECT DISTINCT uuid, child_pod, node_name, 'edge' FROM {_FLAGGED_EVENTS} d
)"""
_ATTRIBUTION = f"""(
WITH ev AS (SELECT *, regexp_replace(pod, '-[0-9]+$', '') AS service FROM {_EVIDENCE} e0 WHERE pod IS NOT NULL),
shifted AS (SELECT DISTINCT uuid, node FROM {_NODE_SHIFT} ns WHERE status = 'shifted'),
node_c AS (SELECT uuid, 'node' AS level, node AS component, count(DISTINCT service) AS score FROM ev
           WHERE node IS NOT NULL GROUP BY uuid, node HAVING count(DISTINCT service) >= 2),
per_pod AS (SELECT uuid, service, pod, count(*) AS n_evidence FROM ev GROUP BY uuid, service, pod),
per_svc AS (SELECT uuid, service, count(*) AS n_pods, max(pod) AS pod, max(n_evidence) AS n_evidence
            FROM per_pod GROUP BY uuid, service),
cand AS (SELECT * FROM node_c n WHERE EXISTS (SELECT 1 FROM shifted s WHERE s.uuid = n.uuid AND s.node = n.component)
         UNION ALL SELECT uuid, 'service', service, n_pods FROM per_svc WHERE n_pods >= 2
         UNION ALL SELECT uuid, 'pod', pod, n_evidence FROM per_svc WHERE n_pods = 1),
comp AS (SELECT 'node' AS level, unnest({FX._sql_list(FX.NODES)}) AS component
         UNION SELECT 'service', unnest({FX._sql_list(FX.component_services())}) UNION SELECT 'pod', unnest({FX._sql_list(FX.POD_WHITELIST)})),
r AS (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY CASE level WHEN 'node' THEN 1 WHEN 'service' THEN 2
             ELSE 3 END, score DESC, component) AS rn
      FROM cand c WHERE EXISTS (SELECT 1 FROM comp WHERE comp.level = c.level AND comp.component = c.component))
SELECT uuid, level, component, CAST(score AS BIGINT) AS score FROM r WHERE rn = 1
)"""
FAULT_LEVEL_ATTRIBUTION = _q(f"SELECT * FROM {_ATTRIBUTION} t")

RESULT_JSON_PARSE = _q(f""",
st AS (SELECT uuid, source, count(DISTINCT pod) AS n_pods FROM {_EVIDENCE} e GROUP BY uuid, source),
steps AS (SELECT uuid, CAST(count(*) AS INTEGER) AS n_steps,
   string_agg(CAST(rn AS VARCHAR) || ':' || upper(left(source, 1)) || lower(substr(source, 2)) || 'Check(all)' || ':'
              || CAST(n_pods AS VARCHAR) || ' pods affected in ' || source || ' evidence', '|' ORDER BY source) AS steps_text
   FROM (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY source) AS rn FROM st) x GROUP BY uuid)
SELECT a.component, a.uuid,
  a.level || ' level fault at ' || a.component || ' with score ' || CAST(a.score AS VARCHAR) AS reason,
  coalesce(s.n_steps, 0) AS n_steps, coalesce(s.steps_text, '') AS steps_text
FROM {_ATTRIBUTION} a LEFT JOIN steps s USING (uuid)
""")

_LINE = lambda cols: " || ',' || ".join(_csv_field(c, c in _DBL) for c in cols)


def _lines(src: str, cols, order: str, name: str) -> str:
    return f"""SELECT uuid, '{name}' AS section, CAST(row_number() OVER (PARTITION BY uuid ORDER BY {order}) AS INTEGER) AS position,
  {_LINE(cols)} AS line FROM {src} x
  UNION ALL SELECT DISTINCT uuid, '{name}', 0, '{','.join(cols)}' FROM {src} y"""


EVIDENCE_LINES = _q(" UNION ALL ".join((
    _lines(_LOG_ROLLUP, E.LOG_SECTION_COLUMNS, "occurrence_count DESC, pod_name, node_name, message", "log"),
    _lines(_FLAGGED_TOPK, E.TRACE_SECTION_COLUMNS, "rank", "trace"), _lines(_STATUS, E.STATUS_SECTION_COLUMNS, "rank", "status"),
    _lines(_METRIC_ROWS, E.METRIC_SECTION_COLUMNS, "source, entity, metric", "metric"))))

RESULT_TEXT_PARSE = _q(FX.ANSWERS_SQL)

# K4 read back: all statistics of all sections, as their own comparisons have them
_STAT_ROWS = lambda section, e1, e2, src: " UNION ALL ".join(
    f"SELECT uuid, '{section}' AS section, {e1} AS e1, {e2} AS e2, metric, '{p}' AS period, "
    + ", ".join(f"{p}_{c} AS {c}" for c in S.STATS) + f" FROM {src} {section}_{p}" for p in ("normal", "fault"))
METRIC_JSON_ROWS = _q(f"""SELECT t.*, 'service,tidb,node,pod' AS keys FROM ({_STAT_ROWS('tidb', 'service', "''", _DB_STATS)}
  UNION ALL {_STAT_ROWS('node', 'node', "''", _NODE_SHIFT)} UNION ALL {_STAT_ROWS('pod', 'instance', 'pod', _POD_SHIFT)}
  UNION ALL {_STAT_ROWS('service', 'service', 'pod', _SVC_DRILL)}) t""")

# A part starts at the window's start or behind a fault, where no fault stands, and ends before the next one
_NOT = "h.uuid <> n.uuid AND"


def _subtracted(windows: str, holes: str, cols: str) -> str:
    return f"""(
  WITH n AS (SELECT * FROM {windows} n0 WHERE lo <= hi), h AS (SELECT uuid, start_timestamp AS a, end_timestamp AS b FROM {holes} h0),
  s AS (SELECT DISTINCT n.*, lo AS s FROM n UNION SELECT n.*, h.b + 1 FROM n JOIN h ON {_NOT} h.b + 1 BETWEEN n.lo AND n.hi)
  SELECT {cols}, s AS lo, least(hi, coalesce((SELECT min(h.a) - 1 FROM h WHERE {_NOT} h.a > n.s), hi)) AS hi
  FROM s n WHERE NOT EXISTS (SELECT 1 FROM h WHERE {_NOT} n.s BETWEEN h.a AND h.b)
)"""


_OVER = f"({FX.OVERLAPPING_SQL})"
_GAP = FX.FIXTURE_GAP_NS
_OVER_NORMAL = f"""(SELECT i.uuid, 'normal' AS period, 'before' AS part, p.end_timestamp + {_GAP} AS lo, i.start_timestamp AS hi
    FROM {_OVER} i JOIN {_OVER} p ON p.seq = i.seq - 1
  UNION ALL SELECT i.uuid, 'normal', 'after', i.end_timestamp + {_GAP}, x.start_timestamp FROM {_OVER} i JOIN {_OVER} x ON x.seq = i.seq + 1)"""
INCIDENT_CLEAN_PERIODS = _q(f"""SELECT uuid, 'fault' AS period, 'fault' AS part, start_timestamp AS lo, end_timestamp AS hi FROM incidents
  UNION ALL SELECT * FROM {_subtracted(_OVER_NORMAL, _OVER, 'uuid, period, part')} t""")

_LONG = f"(SELECT uuid, end_timestamp AS lo, end_timestamp + {FX.FIXTURE_LONG_AFTER_NS} AS hi FROM incidents)"
SPAN_CLEAN_EXTRACT = _q(f""",
w AS (SELECT i.uuid, s.* FROM spans s JOIN {_subtracted(_LONG, 'incidents', 'uuid')} i ON s.timestamp_ns BETWEEN i.lo AND i.hi),
par AS (SELECT spanID, arg_max(child_pod, timestamp_ns) AS parent_pod FROM spans GROUP BY spanID)
SELECT uuid, {S.EDGE}, CAST(count(*) AS BIGINT) AS n_spans, min(timestamp_ns) AS min_ts, max(timestamp_ns) AS max_ts,
  round(avg(duration), 6) AS mean_duration
FROM (SELECT w.*, par.parent_pod FROM w LEFT JOIN par ON w.parent_spanID = par.spanID) e
WHERE parent_pod IS NOT NULL AND child_pod IS NOT NULL AND node_name IS NOT NULL AND operationName IS NOT NULL GROUP BY uuid, {S.EDGE}""")

# scoring against a model table: J5 T7 T8 T9
_MODEL = f"(SELECT {S.EDGE}, round(mean - 3.0 * std, 6) AS below, round(mean + 1.5 * std, 6) AS above FROM {_BASE} b)"
_SCORED = f"""(SELECT d.* FROM {_DETECT} d JOIN {_MODEL} m USING (parent_pod, child_pod, node_name, operationName)
  WHERE d.mean_duration <= m.below OR d.mean_duration > m.above)"""
TRACE_INTERVAL_EVENTS = _q(f"""SELECT uuid, window_start AS timestamp, make_timestamp(window_start // 1000 + CAST(28800 AS BIGINT) * 1000000) AS timestamp_readable,
  parent_pod, child_pod, operationName AS operation_name, 'Duration' AS anomaly_type, round(mean_duration, 6) AS duration,
  first_service AS service_name, node_name, concat_ws('_', parent_pod, child_pod, node_name, operationName) AS edge FROM {_SCORED} s""")
TRACE_INTERVAL_TOPK = _q(f"SELECT * FROM {S.topk_anomalies(_SCORED, _BASE, T.TOP_N, T.COUNT_TEXT_PREFIX)} t")

# sinks read back: the text of every written column
SINK_LOG_CSV = _q(f"""SELECT uuid, node_name, service_name, pod_name, message, CAST(occurrence_count AS VARCHAR) AS occurrence_count
FROM {_LOG_ROLLUP} t""")
SINK_TRACE_CSV = _q(f"""SELECT uuid, node_name, service_name, parent_pod, child_pod, operation_name, normal_avg_duration, anomaly_avg_duration,
  anomaly_count_text AS anomaly_count FROM {_FLAGGED_TOPK} t""")
SINK_STATUS_CSV = _q(f"""SELECT uuid, node_name, service_name, parent_pod, child_pod, operation_name, status_code, status_message,
  occurrence_text AS occurrence_count FROM {_STATUS} t""")

# ---------------------------------------------------------------- raw layout
_H = FX.NS_PER_HOUR
RAW_LOG_SCAN = _q(f"""SELECT l.* FROM logs l WHERE EXISTS (SELECT 1 FROM incidents i
  WHERE l.timestamp_ns // {_H} BETWEEN i.start_timestamp // {_H} AND i.end_timestamp // {_H})""")

RAW_SPAN_SCAN = _q(f"""SELECT timestamp_ns, spanID, parent_spanID, child_pod, service_name, node_name, operationName, duration,
  '.parquet' AS source_kind FROM spans s WHERE EXISTS (SELECT 1 FROM incidents i WHERE s.timestamp_ns // {_H}
    BETWEEN i.end_timestamp // {_H} AND (i.end_timestamp + {FX.FIXTURE_AFTER_NS}) // {_H})""")

_LOCAL_DAY = lambda c: f"(({c} // {_H} + 8) // 24)"
RAW_METRIC_SCAN = _q(f"""SELECT m.* FROM ({FX.RAW_METRICS_SQL}) m WHERE EXISTS (SELECT 1 FROM {PERIODS} p
  WHERE p.lo <= p.hi AND {_LOCAL_DAY('m.timestamp_ns')} BETWEEN {_LOCAL_DAY('p.lo')} AND {_LOCAL_DAY('p.hi')})""")

ORACLE = {
    "raw_log_scan": RAW_LOG_SCAN,
    "raw_span_scan": RAW_SPAN_SCAN,
    "raw_metric_scan": RAW_METRIC_SCAN,
    "log_error_rollup": LOG_ERROR_ROLLUP,
    "log_time_error_filter": LOG_TIME_ERROR_FILTER,
    "log_reduction_report": LOG_REDUCTION_REPORT,
    "log_template_mine": LOG_TEMPLATE_MINE,
    "log_template_match": LOG_TEMPLATE_MATCH,
    "log_mask_rules": LOG_MASK_RULES,
    "incident_normal_periods": INCIDENT_NORMAL_PERIODS,
    "metric_unpivot": METRIC_UNPIVOT,
    "metric_trimmed_stats": METRIC_TRIMMED_STATS,
    "metric_period_compare": METRIC_PERIOD_COMPARE,
    "metric_node_shift": METRIC_NODE_SHIFT,
    "metric_pod_shift": METRIC_POD_SHIFT,
    "metric_db_stats": METRIC_DB_STATS,
    "metric_service_drilldown": METRIC_SERVICE_DRILLDOWN,
    "span_enrich": SPAN_ENRICH,
    "span_status_combos": SPAN_STATUS_COMBOS,
    "incident_sample": INCIDENT_SAMPLE,
    "span_normal_extract": SPAN_NORMAL_EXTRACT,
    "trace_anchored_windows": TRACE_ANCHORED_WINDOWS,
    "trace_edge_baseline": TRACE_EDGE_BASELINE,
    "trace_flagged_topk": TRACE_FLAGGED_TOPK,
    "trace_dimension_lists": TRACE_DIMENSION_LISTS,
    "trace_frame_profile": TRACE_FRAME_PROFILE,
    "call_graph_edges": CALL_GRAPH_EDGES,
    "call_chain_edges": CALL_CHAIN_EDGES,
    "evidence_bundle": EVIDENCE_BUNDLE,
    "fault_level_attribution": FAULT_LEVEL_ATTRIBUTION,
    "result_json_parse": RESULT_JSON_PARSE,
    "result_text_parse": RESULT_TEXT_PARSE,
    "metric_json_rows": METRIC_JSON_ROWS,
    "incident_clean_periods": INCIDENT_CLEAN_PERIODS,
    "span_clean_extract": SPAN_CLEAN_EXTRACT,
    "trace_interval_events": TRACE_INTERVAL_EVENTS,
    "trace_interval_topk": TRACE_INTERVAL_TOPK,
    "evidence_lines": EVIDENCE_LINES,
    "sink_log_csv": SINK_LOG_CSV,
    "sink_trace_csv": SINK_TRACE_CSV,
    "sink_status_csv": SINK_STATUS_CSV,
}
