"""SQL (DuckDB dialect) twins of the column helpers, for the oracle queries."""


from faultlens.functions.text import (ERROR_KEYWORDS, TEMPLATE_DELIMITERS, TEMPLATE_PREFIX_DEPTH,
                                      TEMPLATE_WILDCARD, WHITESPACE_CLASS)
from faultlens.operators.templates import SIM_TH


def error_pred(col: str) -> str:
    parts = " OR ".join(f"contains(lower({col}), '{k}')" for k in ERROR_KEYWORDS)
    return f"coalesce(({parts}), false)"


def tokens(col: str) -> str:
    cls = "[" + "".join("\\" + ch if ch in "|^]\\-" else ch for ch in TEMPLATE_DELIMITERS) + "]"
    return (f"list_filter(regexp_split_to_array(regexp_replace(coalesce({col}, ''), '{cls}', ' ', 'g'), "
            f"'{WHITESPACE_CLASS}'), lambda t: t <> '')")


def bucket_key(tok: str) -> str:
    k = f"greatest(0, least({TEMPLATE_PREFIX_DEPTH}, len({tok}) - 1))"
    return (f"(CAST(len({tok}) AS VARCHAR) || ' ' || array_to_string(list_transform({tok}[1:{k}], "
            f"lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '{TEMPLATE_WILDCARD}' ELSE t END), ' '))")


def service_from_pod(col: str) -> str:
    e = f"regexp_extract({col}, '^([a-zA-Z0-9]+)', 1)"
    return f"(CASE WHEN {col} IS NULL THEN NULL WHEN {e} = '' THEN {col} ELSE {e} END)"


def clustered(src: str, scope: list[str], sim_th: float = SIM_TH) -> str:
    """Distinct token lists of ``src`` (scope, bucket_key, tokens) with list_id and cluster: leaders one after another."""
    sc = "".join(f"{c}, " for c in scope)
    same = "".join(f"st.{c} = lo.{c} AND " for c in scope)
    own = "".join(f"lo.{c}, " for c in scope)
    shared = lambda a, b: f"len(list_filter(range(1, len({b}) + 1), lambda i: {a}[i] = {b}[i]))"
    return f"""(
  WITH RECURSIVE dl AS (SELECT *, len(tokens) AS n, md5(array_to_string(tokens, ' ')) AS list_id,
      len(list_filter(tokens[1:greatest(0, least({TEMPLATE_PREFIX_DEPTH}, len(tokens) - 1))],
                      lambda t: NOT regexp_matches(t, '[0-9]'))) AS p
    FROM (SELECT DISTINCT {sc}bucket_key, tokens FROM {src}) d0),
  lo AS (SELECT *, greatest(1, CAST(ceil({sim_th} * n) AS INTEGER)) AS m,
      row_number() OVER (PARTITION BY {sc}bucket_key ORDER BY list_id) AS rk FROM dl WHERE n > 1 AND p < {sim_th} * n),
  st AS (SELECT {sc}bucket_key, rk, [tokens] AS leaders FROM lo WHERE rk = 1
    UNION ALL
    SELECT {own}lo.bucket_key, lo.rk, CASE WHEN len(list_filter(st.leaders, lambda l: {shared('l', 'lo.tokens')} >= lo.m)) = 0
        THEN list_append(st.leaders, lo.tokens) ELSE st.leaders END
    FROM st JOIN lo ON {same}st.bucket_key = lo.bucket_key AND lo.rk = st.rk + 1),
  led AS (SELECT {sc}bucket_key, unnest(arg_max(leaders, rk)) AS leader FROM st GROUP BY {sc}bucket_key),
  met AS (SELECT lo.*, md5(array_to_string(st.leader, ' ')) AS led_by, {shared('st.leader', 'lo.tokens')} AS sh
    FROM lo JOIN led st ON {same}st.bucket_key = lo.bucket_key),
  best AS (SELECT {sc}list_id, led_by FROM met WHERE sh >= m OR led_by = list_id
    QUALIFY row_number() OVER (PARTITION BY {sc}bucket_key, list_id ORDER BY sh DESC, led_by) = 1)
  SELECT dl.{sc.replace(', ', ', dl.') if sc else ''}bucket_key, dl.tokens, dl.list_id, CASE WHEN dl.p >= {sim_th} * dl.n THEN ''
      WHEN dl.n = 1 THEN dl.list_id ELSE best.led_by END AS cluster
  FROM dl LEFT JOIN best ON {''.join(f"dl.{c} = best.{c} AND " for c in scope)}dl.list_id = best.list_id
)"""


def templates(src: str, scope: list[str]) -> str:
    """D1 over ``src`` (has scope cols, bucket_key, tokens) -> (scope, list_id, bucket_key, cluster, template), a row a list."""
    sc = "".join(f"{c}, " for c in scope)
    using = "".join(f"{c}, " for c in scope) + "bucket_key, cluster"
    return f"""(
  WITH cl AS {clustered(src, scope)},
  t AS (SELECT {sc}bucket_key, cluster, string_agg(tok, ' ' ORDER BY pos) AS template FROM (
      SELECT {sc}bucket_key, cluster, pos, CASE WHEN min(tok) = max(tok) THEN min(tok) ELSE '{TEMPLATE_WILDCARD}' END AS tok
      FROM (SELECT {sc}bucket_key, cluster, unnest(tokens) AS tok, generate_subscripts(tokens, 1) AS pos FROM cl) p
      GROUP BY {sc}bucket_key, cluster, pos) a
    GROUP BY {sc}bucket_key, cluster)
  SELECT {''.join(f"cl.{c}, " for c in scope)}cl.list_id, cl.bucket_key, cl.cluster, coalesce(t.template, '') AS template
  FROM cl LEFT JOIN t USING ({using})
)"""


# --------------------------------------------------------------- statistics
PCTS = ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"), (0.95, "p95"), (0.99, "p99"))
STATS = ("count", "mean", "std", "min", "p25", "p50", "p75", "p95", "p99", "max", "non_zero_ratio")


def trimmed_describe(src: str, keys: list[str], rnd: bool = True) -> str:
    """A2 + A3 over ``src`` (has keys and ``value``)."""
    k = ", ".join(keys)
    r = (lambda e: f"round({e}, 6)") if rnd else (lambda e: e)
    pct = ", ".join(f"{r(f'quantile_cont(v, {p})')} AS {n}" for p, n in PCTS)
    return f"""(
  WITH s0 AS (SELECT {k}, CAST(value AS DOUBLE) AS v FROM {src} WHERE value IS NOT NULL AND NOT isnan(value)),
  s1 AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY v) AS rn, count(*) OVER (PARTITION BY {k}) AS n FROM s0),
  s2 AS (SELECT * FROM s1 WHERE n <= 2 OR (rn > 1 AND rn < n)),
  st AS (SELECT {k}, CAST(count(*) AS BIGINT) AS count, {r('avg(v)')} AS mean, {r('stddev_samp(v)')} AS std,
                {r('min(v)')} AS min, {pct}, {r('max(v)')} AS max FROM s2 GROUP BY {k}),
  nz AS (SELECT {k}, round(avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END), 3) AS non_zero_ratio FROM s0 GROUP BY {k})
  SELECT st.*, nz.non_zero_ratio FROM st JOIN nz USING ({k})
)"""


def compare_periods(samples: str, keys: list[str], gate: bool = True) -> str:
    """A2 per period + J8 + F8 over ``samples`` (uuid, keys, period, value)."""
    ks = ["uuid", *keys]
    k = ", ".join(ks)
    cols = []
    for period in ("normal", "fault"):
        for c in STATS:
            cols.append(f"max(CASE WHEN period = '{period}' THEN {c} END) AS {period}_{c}")
    ratio = "((fault_mean + 1e-9) / (normal_mean + 1e-9))"
    where = f"WHERE {ratio} IS NULL OR NOT ({ratio} BETWEEN 0.95 AND 1.05)" if gate else ""
    outs = []
    for period in ("normal", "fault"):
        for c in STATS:
            name = f"{period}_{c}"
            outs.append(name if c in ("count", "non_zero_ratio") else f"round({name}, 6) AS {name}")
    status = ("CASE WHEN normal_count IS NULL THEN 'no_baseline' WHEN fault_count IS NULL THEN 'no_fault_data' "
              f"ELSE '{'shifted' if gate else 'compared'}' END AS status")
    return f"""(
  SELECT {k}, {', '.join(outs)}, round({ratio}, 6) AS mean_ratio, {status}
  FROM (SELECT {k}, {', '.join(cols)} FROM {trimmed_describe(samples, [*ks, 'period'], rnd=False)} st GROUP BY {k}) w
  {where}
)"""


def periods(gap_ns: int) -> str:
    return f"""(
  WITH i AS (SELECT *, lag(end_timestamp) OVER (ORDER BY seq) AS prev_end,
                       lead(start_timestamp) OVER (ORDER BY seq) AS next_start FROM incidents)
  SELECT uuid, 'fault' AS period, 'fault' AS part, start_timestamp AS lo, end_timestamp AS hi FROM i
  UNION ALL SELECT uuid, 'normal', 'before', prev_end + {gap_ns}, start_timestamp FROM i WHERE prev_end IS NOT NULL
  UNION ALL SELECT uuid, 'normal', 'after', end_timestamp + {gap_ns}, next_start FROM i WHERE next_start IS NOT NULL
)"""


def period_samples(points: str, periods_sql: str) -> str:
    return (f"(SELECT p.uuid, p.period, m.* FROM {points} m JOIN {periods_sql} p "
            f"ON m.timestamp_ns BETWEEN p.lo AND p.hi)")


# -------------------------------------------------------------------- traces
EDGE = "parent_pod, child_pod, node_name, operationName"
STATUS_KEYS = ("node_name", "service_name", "parent_pod", "child_pod", "operation_name",
               "status_code", "status_message")


def enriched(windows: str, lo: str = "start_timestamp", hi: str = "end_timestamp") -> str:
    """T1 over the flat spans view inside ``windows`` (uuid, lo, hi)."""
    return f"""(
  WITH w AS (SELECT i.uuid, s.* FROM spans s JOIN {windows} i ON s.timestamp_ns BETWEEN i.{lo} AND i.{hi}),
  par AS (SELECT uuid, spanID, arg_max(child_pod, timestamp_ns) AS parent_pod,
                 arg_max(service_name, timestamp_ns) AS parent_service FROM w GROUP BY uuid, spanID)
  SELECT w.*, par.parent_pod, par.parent_service
  FROM w LEFT JOIN par ON w.uuid = par.uuid AND w.parent_spanID = par.spanID
)"""


def anchored(enr: str, win_ns: int) -> str:
    """W1 over an enriched relation."""
    return f"""(
  WITH e AS (SELECT * FROM {enr} e0 WHERE parent_pod IS NOT NULL AND child_pod IS NOT NULL
             AND node_name IS NOT NULL AND operationName IS NOT NULL),
  b AS (SELECT uuid, {EDGE}, min(timestamp_ns) AS lo, max(timestamp_ns) AS hi,
               arg_min(service_name, timestamp_ns) AS first_service
        FROM e GROUP BY uuid, {EDGE} HAVING min(timestamp_ns) < max(timestamp_ns)),
  x AS (SELECT e.uuid, e.parent_pod, e.child_pod, e.node_name, e.operationName, e.duration, e.timestamp_ns,
               b.lo, b.hi, b.first_service, (e.timestamp_ns - b.lo) // {win_ns} AS ix
        FROM e JOIN b USING (uuid, parent_pod, child_pod, node_name, operationName)),
  y AS (SELECT *, ix AS k FROM x UNION ALL
        SELECT *, ix - 1 AS k FROM x WHERE (timestamp_ns - lo) % {win_ns} = 0 AND ix > 0)
  SELECT uuid, {EDGE}, lo + k * {win_ns} AS window_start, avg(duration) AS mean_duration,
         CAST(count(*) AS BIGINT) AS n_spans, first_service
  FROM y WHERE lo + k * {win_ns} < hi
  GROUP BY uuid, {EDGE}, first_service, lo + k * {win_ns}
)"""


def sampled_incidents(n: int, seed: int) -> str:
    return f"(SELECT * FROM incidents ORDER BY md5(uuid || ':{seed}'), uuid LIMIT {n})"


def baseline(train: str) -> str:
    x = "mean_duration"
    return f"""(SELECT {EDGE}, avg({x}) AS mean, stddev_pop({x}) AS std, median({x}) AS median,
  min({x}) AS min, max({x}) AS max, CAST(count({x}) AS BIGINT) AS count, quantile_cont({x}, 0.99) AS p99
  FROM {train} t GROUP BY {EDGE})"""


def topk_anomalies(events: str, base: str, n: int, prefix: str) -> str:
    return f"""(
  WITH g AS (SELECT uuid, {EDGE}, avg(mean_duration) AS anomaly_avg_duration,
                    CAST(count(*) AS BIGINT) AS anomaly_count, arg_min(first_service, window_start) AS service_name
             FROM {events} ev GROUP BY uuid, {EDGE}),
  j AS (SELECT g.*, coalesce(b.mean, 0.0) AS normal_avg_duration FROM g LEFT JOIN {base} b
        USING (parent_pod, child_pod, node_name, operationName)),
  r AS (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY anomaly_count DESC, parent_pod NULLS FIRST,
               child_pod NULLS FIRST, node_name NULLS FIRST, operationName NULLS FIRST) AS rank FROM j)
  SELECT uuid, node_name, service_name, parent_pod, child_pod, operationName AS operation_name,
         round(normal_avg_duration, 6) AS normal_avg_duration, round(anomaly_avg_duration, 6) AS anomaly_avg_duration,
         anomaly_count, CAST(rank AS INTEGER) AS rank, '{prefix}' || CAST(anomaly_count AS VARCHAR) AS anomaly_count_text
  FROM r WHERE rank <= {n}
)"""


def R(e: str, d: int = 6) -> str:
    """Twin of ``round_half_up``."""
    k = f"{10 ** d}.0::DOUBLE"
    return f"CAST(floor(({e}) * {k} + 0.5) / {k} AS DOUBLE)"


def fix_rounding(sql: str) -> str:
    """Rewrite ``round(x, d)`` calls (balanced parentheses) to ``R(x, d)``."""
    out, i = [], 0
    while True:
        j = sql.find("round(", i)
        if j < 0 or (j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k = 0, j + 5
        while True:
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        inner = sql[j + 6:k]
        # split on the last top-level comma
        depth, cut = 0, None
        for pos, ch in enumerate(inner):
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 0:
                cut = pos
        expr, dec = inner[:cut], int(inner[cut + 1:].strip())
        out.append(sql[i:j])
        out.append(R(fix_rounding(expr), dec))
        i = k + 1
