"""ANSI SQL for the registered queries, to be run by another engine on the same tables."""

from __future__ import annotations

from assayer.plans.cases import LINE_KEYS, fixed_forest

SQL: dict[str, str] = {}

LINE_COLUMNS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
LINE_NUMBERS = LINE_COLUMNS[:8]
ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                 "o_orderpriority")
TEXT = {"l_returnflag", "l_linestatus", "o_orderstatus", "o_orderpriority", "c_name", "c_mktsegment"}

# --- faulted tables ---------------------------------------------------------------

FL = """
fl0 AS (SELECT l_orderkey, CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_partkey END AS l_partkey,
               l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
               CASE WHEN l_suppkey % 7 = 0 THEN ' ' ELSE l_returnflag END AS l_returnflag, l_linestatus
        FROM lineitem),
fl1 AS (SELECT * FROM fl0 UNION ALL SELECT * FROM fl0 WHERE l_orderkey % 8 = 0),
fl AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
              CASE WHEN l_orderkey < 5 THEN CAST(999999.99 AS DOUBLE) ELSE l_quantity END AS l_quantity,
              l_extendedprice * 2.0 AS l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus
       FROM fl1)"""

FO = """
fo0 AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS o_custkey,
               o_orderstatus, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
               o_orderdate, CASE WHEN o_orderkey % 11 = 0 THEN 'UNKNOWN' WHEN o_orderkey % 7 = 0 THEN ' '
                                 ELSE o_orderpriority END AS o_orderpriority
        FROM orders),
fo1 AS (SELECT * FROM fo0 UNION ALL SELECT * FROM fo0 WHERE o_orderkey % 8 = 0),
fo AS (SELECT o_orderkey, o_custkey, o_orderstatus,
              CASE WHEN o_orderkey < 5 THEN CAST(999999.99 AS DOUBLE) ELSE o_totalprice END AS o_totalprice,
              o_orderdate, o_orderpriority
       FROM fo1)"""

FC = """
fc AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS c_name, c_nationkey,
              CASE WHEN c_custkey < 5 THEN CAST(999999.99 AS DOUBLE) ELSE c_acctbal END AS c_acctbal,
              c_mktsegment
       FROM customer)"""


def miss(c: str) -> str:
    if c in TEXT or c in ("text", "lang", "source", "priority", "nothing"):
        return rf"({c} IS NULL OR NOT regexp_matches({c}, '\S'))"
    return f"({c} IS NULL)"


def missing_rows(table: str, columns, key: str | None = None) -> str:
    first = f"min({key}) FILTER (WHERE {{m}})" if key else "NULL"
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {i} AS ordinal, count(*) FILTER (WHERE {miss(c)}) AS missing_count,
            count(*) AS total_rows, {first.format(m=miss(c))} AS first_key FROM {table}"""
        for i, c in enumerate(columns))


def missing_values(table: str, columns, key: str) -> str:
    return f"""SELECT "column", missing_count, total_rows,
        round(missing_count / total_rows * 100, 2) AS missing_percentage,
        CASE WHEN missing_count / total_rows * 100 >= 50 THEN 'CRITICAL'
             WHEN missing_count / total_rows * 100 >= 10 THEN 'HIGH'
             WHEN missing_count / total_rows * 100 >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
        CAST(row_number() OVER (ORDER BY first_key, ordinal) AS INTEGER) AS position
        FROM ({missing_rows(table, columns, key)}) WHERE missing_count > 0"""


def duplicates(table: str, keys: str) -> str:
    return f"""SELECT CAST(sum(c - 1) AS BIGINT) AS duplicate_count, CAST(sum(c) AS BIGINT) AS total_rows,
        round(sum(c - 1) / sum(c) * 100, 2) AS duplicate_percentage,
        CASE WHEN sum(c - 1) / sum(c) * 100 >= 20 THEN 'CRITICAL'
             WHEN sum(c - 1) / sum(c) * 100 >= 10 THEN 'HIGH'
             WHEN sum(c - 1) / sum(c) * 100 >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS severity
        FROM (SELECT count(*) AS c FROM {table} GROUP BY {keys}) HAVING sum(c - 1) > 0"""


def long_form(table: str, columns, extra: str = "") -> str:
    return " UNION ALL ".join(
        f"""SELECT {extra} '{c}' AS "column", {i} AS ordinal, CAST({c} AS DOUBLE) AS value
            FROM {table} WHERE {c} IS NOT NULL""" for i, c in columns)


def at(columns, every) -> list[tuple[int, str]]:
    return [(list(every).index(c), c) for c in columns]


def measures(name: str, table: str, columns) -> str:
    """CTEs <name>_v (long form), <name>_s (statistics), <name>_m (counts) for (ordinal, column) pairs."""
    return f"""
{name}_v AS ({long_form(table, columns)}),
{name}_b AS (SELECT "column", ordinal, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std,
             min(value) AS mn, max(value) AS mx, quantile_cont(value, 0.25) AS q25,
             quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q75
      FROM {name}_v GROUP BY "column", ordinal),
{name}_k AS (SELECT v."column", avg(power(v.value - b.mean, 3)) AS m3
      FROM {name}_v v JOIN {name}_b b ON v."column" = b."column" GROUP BY v."column"),
{name}_s AS (SELECT b.*, k.m3 / power(b.std, 3) AS skewness, q75 - q25 AS iqr,
             q25 - 1.5 * (q75 - q25) AS lower_fence, q75 + 1.5 * (q75 - q25) AS upper_fence,
             greatest(mx - mean, mean - mn) / std AS max_z
      FROM {name}_b b JOIN {name}_k k ON b."column" = k."column"
      WHERE n >= 5 AND std >= 1e-8 AND mn <> mx AND q75 - q25 >= 1e-8),
{name}_m AS (SELECT s.*, c.z_count, c.iqr_count, round(c.iqr_count / s.n * 100, 2) AS pct,
             abs(s.skewness) > 1.5 AS is_skewed
      FROM {name}_s s JOIN (
        SELECT v."column", count(*) FILTER (WHERE abs((v.value - s.mean) / s.std) > 3) AS z_count,
               count(*) FILTER (WHERE v.value < s.lower_fence OR v.value > s.upper_fence) AS iqr_count
        FROM {name}_v v JOIN {name}_s s ON v."column" = s."column" GROUP BY v."column") c
      ON s."column" = c."column"),
{name}_f AS (SELECT *, CASE WHEN pct > 15 OR max_z > 6 THEN 'HIGH' WHEN pct > 7 THEN 'MEDIUM'
             ELSE 'LOW' END AS severity,
             'Column ''' || "column" || ''' contains ' || iqr_count || ' outlier value(s) (' ||
             CAST(pct AS VARCHAR) || '%) outside fences [' || printf('%.2f', lower_fence) || ', ' ||
             printf('%.2f', upper_fence) || '] (max Z: ' || printf('%.1f', max_z) || ').' AS message
      FROM {name}_m WHERE CASE WHEN is_skewed THEN pct >= 15 OR max_z > 15
                               ELSE pct >= 5 AND iqr_count >= 3 END)"""


def ks(name: str, current: str, reference: str) -> str:
    """CTE <name>_d from two long-form selects."""
    return f"""
{name}_p AS (SELECT "column", max(ordinal) AS ordinal, value, sum(c) AS c, sum(r) AS r FROM (
        SELECT "column", ordinal, value, 1 AS c, 0 AS r FROM ({current})
        UNION ALL SELECT "column", -1, value, 0, 1 FROM ({reference})) GROUP BY "column", value),
{name}_w AS (SELECT *, sum(c) OVER w AS cc, sum(r) OVER w AS cr, sum(c) OVER a AS n, sum(r) OVER a AS m
      FROM {name}_p WINDOW w AS (PARTITION BY "column" ORDER BY value), a AS (PARTITION BY "column")),
{name}_g AS (SELECT "column", max(ordinal) AS ordinal, CAST(max(m) AS BIGINT) AS n_ref,
             CAST(max(n) AS BIGINT) AS n_cur, max(abs(cc / n - cr / m)) AS d,
             sum(value * r) / sum(r) AS ref_mean, sum(value * c) / sum(c) AS cur_mean
      FROM {name}_w WHERE n >= 10 AND m >= 10 GROUP BY "column"),
{name}_l AS (SELECT *, d * sqrt(CAST(n_cur AS DOUBLE) * n_ref / (n_cur + n_ref)) AS lam FROM {name}_g),
{name}_q AS (SELECT *, CASE WHEN lam < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0,
             list_sum([CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * k * k * lam * lam)
                       for k in range(1, 101)]))) END AS p FROM {name}_l),
{name}_d AS (SELECT *, p < 0.05 AND d >= 0.10 AS is_drift,
             CASE WHEN p < 0.05 AND d >= 0.10 THEN CASE WHEN d > 0.25 THEN 'HIGH' ELSE 'MEDIUM' END END AS severity,
             'Significant distribution drift detected in column ''' || "column" || ''' (KS-stat: ' ||
             printf('%.3f', d) || ', p-value: ' || printf('%.6f', p) || ').' AS message
      FROM {name}_q)"""


LINE_AT = at(LINE_NUMBERS, LINE_COLUMNS)
LINE_MEASURES = f"WITH {FL}, {measures('o', 'fl', LINE_AT)}"
LINE_KS = ks("k", long_form("fl", LINE_AT), long_form("lineitem", LINE_AT))



def forest_sql(model, table: str, keys) -> str:
    """CTEs fsc (rid, score of each row), fth (threshold and moments) and ff (flagged rows) of a given forest."""
    def walk(t: int, node: int) -> str:
        inner = model.split.shape[1]
        if node >= inner:
            return repr(float(model.length[t][node - inner]))
        low, at = walk(t, 2 * node + 1), float(model.at[t][node])
        if at == float("inf"):
            return low
        return (f"CASE WHEN {model.features[model.split[t][node]]} >= {at!r} THEN {walk(t, 2 * node + 2)} "
                f"ELSE {low} END")

    def part(key: str) -> str:
        return rf"coalesce(replace(replace(CAST({key} AS VARCHAR), '\', '\\'), '|', '\|'), '\N')"

    trees = len(model.split)
    total = " + ".join(walk(t, 0) for t in range(trees))
    return f"""fsc AS (SELECT *, concat_ws('|', {', '.join(map(part, keys))}) AS rid,
  0.5 - pow(2.0, -(CAST({total} AS DOUBLE)) / {trees}) AS score FROM {table}),
fth AS (SELECT count(*) AS n, avg(score) AS mean, min(score) AS low, least(-0.15, avg(score) - 3.5 * stddev_pop(score)) AS th
        FROM fsc),
ff AS (SELECT * FROM fsc WHERE score < -0.15 AND score < (SELECT th FROM fth))"""


FOREST = fixed_forest()
LINE_FOREST = forest_sql(FOREST, "fl", LINE_KEYS)
FINDINGS = f"""WITH {FL}, {measures('o', 'fl', LINE_AT)}, {LINE_KS}, {LINE_FOREST},
fs AS (SELECT count(*) AS k, round(count(*) / any_value(n) * 100, 2) AS pct, any_value(n) AS n, any_value(th) AS th,
  any_value(low) AS low, any_value(mean) AS mean, list(rid ORDER BY rid)[1:10] AS ids FROM ff, fth HAVING count(*) > 0),
mv AS ({missing_values('fl', LINE_COLUMNS, 'l_orderkey')}),
dr AS ({duplicates('fl', ', '.join(LINE_COLUMNS))}),
findings AS (
SELECT 1 AS stage, position AS ordinal, 'MISSING_VALUES' AS finding_type, "column" AS column_name, severity,
       'Column ''' || "column" || ''' contains ' || missing_count || ' missing value(s).' AS message,
       missing_count AS affected_count, missing_percentage AS affected_pct,
       CAST(NULL AS VARCHAR) AS expected_type, CAST(NULL AS VARCHAR) AS actual_type,
       CAST(json_object('column', "column", 'missing_count', missing_count,
            'missing_percentage', missing_percentage, 'total_rows', total_rows) AS VARCHAR) AS evidence
FROM mv UNION ALL
SELECT 2, 1, 'DUPLICATE_RECORDS', NULL, severity, 'Detected ' || duplicate_count || ' duplicate record(s).',
       duplicate_count, duplicate_percentage, NULL, NULL,
       CAST(json_object('duplicate_count', duplicate_count, 'duplicate_percentage', duplicate_percentage,
            'total_rows', total_rows) AS VARCHAR)
FROM dr UNION ALL
SELECT 3, 1, 'COLUMN_REMOVED', 'l_shipdate', 'CRITICAL',
       'Expected column ''l_shipdate'' is missing from the actual schema.', NULL, NULL, 'datetime', NULL,
       '{{"column":"l_shipdate","expected_type":"datetime","actual_type":null}}'
WHERE (SELECT count(l_shipdate) FROM lineitem) > 0 UNION ALL
SELECT 6, ordinal + 1, 'NUMERICAL_OUTLIERS', "column", severity, message, iqr_count, pct, NULL, NULL,
       CAST(json_object('column', "column", 'outlier_count', iqr_count, 'outlier_percentage', pct,
            'total_valid', n, 'lower_fence', round(lower_fence, 4), 'upper_fence', round(upper_fence, 4),
            'mean', round(mean, 4), 'std', round(std, 4), 'skewness', round(skewness, 4),
            'max_z_score', round(max_z, 2)) AS VARCHAR)
FROM o_f UNION ALL
SELECT 7, 1, 'ML_ISOLATION_FOREST_ANOMALY', NULL, CASE WHEN pct > 15 THEN 'CRITICAL' WHEN pct > 5 THEN 'HIGH' ELSE 'MEDIUM' END,
       'Isolation Forest identified ' || k || ' multivariate anomalous record(s) (' || CAST(pct AS VARCHAR) ||
       '% of total) separated beyond threshold ' || printf('%.3f', th) || ' across features: {", ".join(FOREST.features)}.',
       k, pct, NULL, NULL,
       CAST(json_object('features_analyzed', '{", ".join(FOREST.features)}', 'separation_threshold', round(th, 4),
            'anomalous_row_count', k, 'total_rows', n, 'anomalous_percentage', pct, 'sample_anomalous_rows', ids,
            'min_decision_score', round(low, 4), 'mean_decision_score', round(mean, 4)) AS VARCHAR)
FROM fs UNION ALL
SELECT 8, ordinal + 1, 'DISTRIBUTION_DRIFT', "column", severity, message, NULL, NULL, NULL, NULL,
       CAST(json_object('column', "column", 'ks_statistic', round(d, 4), 'p_value', printf('%.6f', p),
            'alpha_threshold', CAST(0.05 AS DOUBLE), 'd_threshold', CAST(0.1 AS DOUBLE),
            'current_mean', round(cur_mean, 4), 'reference_mean', round(ref_mean, 4)) AS VARCHAR)
FROM k_d WHERE is_drift),
numbered AS (SELECT *, row_number() OVER (ORDER BY stage, ordinal, column_name NULLS FIRST) AS position
             FROM findings)"""

# --- sources --------------------------------------------------------------------------

SQL["io_read_parquet"] = "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier"
SQL["io_csv_roundtrip"] = "SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, source, text FROM documents"
SQL["io_json_roundtrip"] = "SELECT conv_id, turn, role, text FROM conversations"
SQL["io_json_array"] = SQL["io_json_wrapped"] = SQL["io_json_roundtrip"]
SQL["io_drop_blank_rows"] = "SELECT * FROM customer WHERE c_custkey % 10 <> 0"
SQL["limit_rows"] = "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 100"
SQL["table_fingerprint"] = """
WITH h AS (SELECT sha256(CAST(json_object('o_orderkey', o_orderkey, 'o_custkey', o_custkey,
    'o_orderstatus', o_orderstatus, 'o_totalprice', o_totalprice, 'o_orderdate', epoch_us(o_orderdate),
    'o_orderpriority', o_orderpriority) AS VARCHAR)) AS h FROM orders),
s AS (SELECT count(*) AS row_count,
    sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)) AS a, sum(CAST('0x' || substr(h, 16, 15) AS BIGINT)) AS b,
    sum(CAST('0x' || substr(h, 31, 15) AS BIGINT)) AS c, sum(CAST('0x' || substr(h, 46, 15) AS BIGINT)) AS d
    FROM h)
SELECT row_count, sha256(row_count || ':' || a || ':' || b || ':' || c || ':' || d) AS fingerprint FROM s"""
SQL["proofs_linked"] = f"""{LINE_MEASURES}
SELECT method, p."column" AS column_name, p.status, p.flagged_count, f.severity AS finding_severity,
       f.severity IS NOT NULL AS is_linked
FROM (SELECT 'Z_SCORE' AS method, "column", CASE WHEN z_count > 0 THEN 'ANOMALY_DETECTED' ELSE 'HEALTHY' END AS status,
             z_count AS flagged_count FROM o_m UNION ALL
      SELECT 'IQR', "column", CASE WHEN iqr_count > 0 THEN 'OUTLIER_DETECTED' ELSE 'HEALTHY' END, iqr_count FROM o_m) p
LEFT JOIN o_f f ON p."column" = f."column" """


def sample_summary(table: str, columns, path: str) -> str:
    return f"""SELECT "column", count(value) AS count, round(avg(value), 4) AS mean,
        round(stddev_pop(value), 4) AS std, round(min(value), 4) AS min, round(max(value), 4) AS max
        {path} FROM ({long_form(table, list(enumerate(columns)))}) GROUP BY "column" """


ORDER_NUMBERS = ("o_orderkey", "o_custkey", "o_totalprice")
SQL["persist_findings"] = f"""WITH {FO}, {measures('o', 'fo', at(ORDER_NUMBERS, ORDER_COLUMNS))}, f AS (
SELECT 1 AS stage, position AS ordinal, 'MISSING_VALUES' AS finding_type, "column" AS column_name, severity,
  'Column ''' || "column" || ''' contains ' || missing_count || ' missing value(s).' AS message
FROM ({missing_values('fo', ORDER_COLUMNS, 'o_orderkey')}) UNION ALL
SELECT 2, 1, 'DUPLICATE_RECORDS', NULL, severity, 'Detected ' || duplicate_count || ' duplicate record(s).'
FROM ({duplicates('fo', ', '.join(ORDER_COLUMNS))}) UNION ALL
SELECT 6, ordinal + 1, 'NUMERICAL_OUTLIERS', "column", severity, message FROM o_f)
SELECT 'orders' AS dataset_path, day, 'ANOMALY_DETECTED' AS status, (SELECT count(*) FROM fo) AS row_count,
  CAST(6 AS BIGINT) AS column_count, (SELECT count(*) FROM f) AS finding_count, 64 AS hash_length,
  CAST(row_number() OVER (PARTITION BY day ORDER BY stage, ordinal) AS INTEGER) AS created_order, finding_type, column_name,
  severity, message
FROM f, (VALUES ('2024-01-01'), ('2024-01-02')) AS d(day)"""
SQL["baseline_upsert"] = f"""
WITH late AS (SELECT * REPLACE (o_totalprice * 2.0 AS o_totalprice) FROM orders), ev AS (SELECT * FROM events)
{sample_summary('late', ORDER_NUMBERS, ", 'orders' AS dataset_path")} UNION ALL
{sample_summary('ev', ('value',), ", 'events' AS dataset_path")}"""
SQL["register_dataset"] = f"""WITH {FO}, m AS (SELECT sum(missing_count) AS g, max(total_rows) AS n
  FROM ({missing_rows('fo', ORDER_COLUMNS)})),
d AS (SELECT sum(c - 1) AS dup FROM (SELECT count(*) AS c FROM fo GROUP BY {', '.join(ORDER_COLUMNS)}))
SELECT 'orders' AS dataset_name, 'USER_UPLOAD' AS dataset_type, 'uploads/orders.parquet' AS file_path,
       'parquet' AS file_format, n AS row_count, CAST(6 AS BIGINT) AS column_count,
       round(100 * (0.6 * (1 - g / (n * 6)) + 0.4 * (1 - dup / n)), 2) AS quality_score,
       'Registered' AS status FROM m, d"""
SQL["report_summary"] = f"""{FINDINGS}, s AS (SELECT count(*) AS n FROM findings), t AS (SELECT count(*) AS r FROM fl)
SELECT 1 AS position, 'Dataset Path' AS metric, 'lineitem' AS value UNION ALL
SELECT 2, 'Audit Status', CASE WHEN n > 0 THEN 'ANOMALY_DETECTED' ELSE 'HEALTHY' END FROM s UNION ALL
SELECT 3, 'Row Count', CAST(r AS VARCHAR) FROM t UNION ALL SELECT 4, 'Column Count', '10' UNION ALL
SELECT 5, 'Finding Count', CAST(n AS VARCHAR) FROM s UNION ALL
SELECT 6, 'Audit SHA-256 Hash', 'UNVERIFIED' UNION ALL SELECT 7, 'HMAC Signature', 'UNVERIFIED'"""
SQL["export_iso_dates"] = r"""
SELECT o_orderkey, shipped, CASE WHEN regexp_full_match(shipped, '\d{4}-\d{2}-\d{2}') THEN CAST(shipped AS DATE) END
       AS shipped_date
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'pending' ELSE strftime(o_orderdate, '%Y-%m-%d') END
      AS shipped FROM orders)"""

# --- schema -----------------------------------------------------------------------------

TEXT_ORDERS = """tx AS (SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS custkey,
    CAST(o_totalprice AS VARCHAR) AS totalprice, strftime(o_orderdate, '%Y-%m-%d') AS orderdate,
    repeat(' ', 45) || strftime(o_orderdate, '%-d/%-m/%Y') AS day,
    CASE WHEN o_orderkey % 2 = 0 THEN ' Yes' ELSE 'no' END AS flag,
    CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderpriority END AS priority,
    CASE WHEN o_orderkey < 0 THEN 'x' END AS nothing FROM orders)"""
TEXT_COLUMNS = ("order_id", "custkey", "totalprice", "orderdate", "day", "flag", "priority", "nothing")
_NUMBER = r"'\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*'"


def text_type(c: str, i: int) -> str:
    x = f"trim({c})"
    date = " OR ".join(f"try_strptime({x}, '{f}') IS NOT NULL" for f in (
        "%Y-%m-%d %H:%M:%S", "%Y-%m-%d", "%d-%m-%Y", "%d/%m/%Y", "%Y/%m/%d"))
    ident = "id" == c or c.endswith("_id")
    return rf"""SELECT '{c}' AS "column", {i} AS ordinal, CASE WHEN {str(ident).upper()} OR count(*) = 0 THEN 'string'
      WHEN bool_and(lower({x}) IN ('true', 'false', 'yes', 'no')) THEN 'boolean'
      WHEN bool_and(regexp_full_match({c}, '\s*[+-]?\d+\s*')) THEN 'integer'
      WHEN bool_and(regexp_full_match({c}, {_NUMBER})) THEN 'float'
      WHEN bool_and({date}) THEN 'datetime' ELSE 'string' END AS logical_type
      FROM tx WHERE {c} IS NOT NULL AND {x} <> ''"""


SQL["infer_schema"] = f"""WITH {TEXT_ORDERS}, a AS (
  {' UNION ALL '.join(text_type(c, i) for i, c in enumerate(TEXT_COLUMNS))}),
n AS (SELECT count(event_id) AS c0, count(ts) AS c1, count(user_id) AS c2, count(event_type) AS c3,
             count(value) AS c4, count(props) AS c5 FROM events)
SELECT *, 'text_orders' AS source FROM a UNION ALL
SELECT 'event_id', 0, 'string', 'events' UNION ALL
SELECT 'ts', 1, CASE WHEN c1 > 0 THEN 'datetime' ELSE 'string' END, 'events' FROM n UNION ALL
SELECT 'user_id', 2, 'string', 'events' UNION ALL SELECT 'event_type', 3, 'string', 'events' UNION ALL
SELECT 'value', 4, CASE WHEN c4 > 0 THEN 'float' ELSE 'string' END, 'events' FROM n UNION ALL
SELECT 'props', 5, 'string', 'events'"""
SQL["ragged_union"] = """
SELECT c_custkey AS key, c_name AS name, c_mktsegment, CAST(NULL AS DOUBLE) AS s_acctbal FROM customer UNION ALL
SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier"""
SQL["identifier_columns"] = f"""WITH {TEXT_ORDERS}, a AS (
  {' UNION ALL '.join(text_type(c, i) for i, c in enumerate(TEXT_COLUMNS))} UNION ALL
  SELECT 'zip_code', 8, 'string' UNION ALL SELECT 'paid_amount', 9, 'integer')
SELECT "column", ordinal, logical_type, "column" LIKE '%\\_id' ESCAPE '\\' AS schema_rule,
  "column" LIKE '%\\_id' ESCAPE '\\' OR "column" LIKE '%\\_code' ESCAPE '\\' AS outlier_rule,
  "column" LIKE '%\\_id' ESCAPE '\\' AS forest_rule,
  contains("column", 'id') OR contains("column", 'key') AS recovery_rule FROM a""".replace("\\\\", "\\")
ORDER_TYPES = """VALUES ('o_orderkey', 'integer'), ('o_custkey', 'integer'), ('o_orderstatus', 'string'),
  ('o_totalprice', 'float'), ('o_orderdate', 'datetime'), ('o_orderpriority', 'string')"""
SQL["schema_drift"] = f"""WITH e("column", t) AS ({ORDER_TYPES}),
a AS (SELECT "column", CASE WHEN "column" = 'o_totalprice' THEN 'string' ELSE t END AS t FROM e
      WHERE "column" <> 'o_orderpriority' UNION ALL SELECT 'o_channel', 'string'
      WHERE (SELECT count(*) FROM orders) > 0)
SELECT coalesce(e."column", a."column") AS "column",
  CASE WHEN a.t IS NULL THEN 'COLUMN_REMOVED' WHEN e.t IS NULL THEN 'COLUMN_ADDED' ELSE 'COLUMN_TYPE_CHANGED' END
  AS finding_type,
  CASE WHEN a.t IS NULL THEN 'CRITICAL' WHEN e.t IS NULL THEN 'MEDIUM' ELSE 'HIGH' END AS severity,
  e.t AS expected_type, a.t AS actual_type
FROM e FULL OUTER JOIN a ON e."column" = a."column" WHERE a.t IS NULL OR e.t IS NULL OR a.t <> e.t"""
SQL["schema_status"] = """SELECT 'DRIFT_DETECTED' AS status, CAST(6 AS BIGINT) AS expected_column_count,
  CAST(6 AS BIGINT) AS actual_column_count, CAST(1 AS BIGINT) AS added_count, CAST(1 AS BIGINT) AS removed_count,
  CAST(1 AS BIGINT) AS changed_count, CAST(3 AS BIGINT) AS finding_count
WHERE (SELECT count(*) FROM orders) > 0"""
SQL["normalize_types"] = """
SELECT declared, count(*) AS events, CASE trim(lower(declared)) WHEN 'varchar' THEN 'string'
  WHEN 'int64' THEN 'integer' WHEN 'double' THEN 'float' ELSE 'boolean' END AS logical_type
FROM (SELECT CASE event_type WHEN 'error' THEN ' VARCHAR ' WHEN 'click' THEN 'Int64' WHEN 'view' THEN 'double'
      ELSE 'Bool' END AS declared FROM events) GROUP BY declared"""
SQL["expected_schema"] = f"""WITH e("column", t) AS ({ORDER_TYPES})
SELECT "column", t AS logical_type, 'baseline' AS source FROM e WHERE (SELECT count(*) FROM orders) > 0"""
SQL["accept_columns"] = f"""WITH e("column", t) AS ({ORDER_TYPES})
SELECT "column", t AS logical_type FROM e WHERE (SELECT count(*) FROM orders) > 0
UNION ALL SELECT 'o_channel', 'string' WHERE (SELECT count(*) FROM orders) > 0"""

# --- projections and filters ---------------------------------------------------------------

SQL["complete_rows"] = rf"""WITH {FO} SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM fo
WHERE {' AND '.join('NOT ' + miss(c) for c in ORDER_COLUMNS)}"""
SQL["numeric_projection"] = f"""
WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 8 = 4 THEN chr(160) || p_size WHEN p_partkey % 8 = 5 THEN p_size || '_000 '
  WHEN p_partkey % 8 = 6 THEN p_size || '__0' ELSE CASE p_partkey % 4 WHEN 0 THEN ' ' || p_size WHEN 1 THEN p_size || 'd'
  WHEN 2 THEN 'nan' ELSE '1.5e2' END END AS size_text FROM part),
u AS (SELECT *, regexp_replace(replace(size_text, chr(160), ' '), '([0-9])_([0-9])', '\\1\\2', 'g') AS x FROM t)
SELECT p_partkey, size_text, CASE WHEN regexp_full_match(x, {_NUMBER}) THEN CAST(trim(x) AS DOUBLE) END AS value FROM u"""
SQL["findings_by_severity"] = f"""{FINDINGS} SELECT finding_type, column_name, severity, message FROM findings
WHERE severity = 'HIGH'"""
SQL["findings_by_topic"] = f"""{FINDINGS} SELECT finding_type, column_name, topic FROM findings, (VALUES
  ('duplicate', 'DUPLICATE'), ('missing', 'MISSING'), ('schema', 'SCHEMA'), ('schema', 'COLUMN'), ('drift', 'DRIFT'),
  ('outlier', 'OUTLIER'), ('outlier', 'ISOLATION')) AS t(topic, word) WHERE contains(finding_type, word)"""
SQL["friendly_names"] = """
WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'order_items/' WHEN 1 THEN 'orders/' WHEN 2 THEN 'upload/'
  ELSE '' END || regexp_replace(url, '^[a-z]+://', '') AS path FROM pages),
b AS (SELECT *, lower(path) AS p, split_part(path, '/', -1) AS base FROM p)
SELECT page_id, path, CASE WHEN contains(p, 'order_item') THEN 'Order Items'
  WHEN contains(p, 'order_payment') THEN 'Order Payments' WHEN contains(p, 'order_review') THEN 'Order Reviews'
  WHEN contains(p, 'orders') THEN 'Orders Stream' WHEN contains(p, 'customer') THEN 'Customers'
  WHEN contains(p, 'product') THEN 'Products Catalog'
  WHEN contains(p, 'anomaly') OR contains(p, 'test') THEN 'Synthetic Benchmark'
  WHEN contains(p, 'upload') THEN 'Upload: ' || base WHEN base = '' THEN path ELSE base END AS friendly_name FROM b"""

# --- profiles and quality ---------------------------------------------------------------------

SQL["profile_numeric"] = f"""{LINE_MEASURES}, m AS ({missing_rows('fl', LINE_COLUMNS)})
SELECT b."column", 'numeric' AS data_type, m.total_rows AS total_count, m.total_rows - m.missing_count AS valid_count,
  m.missing_count, round(m.missing_count / m.total_rows * 100, 2) AS missing_percentage, round(mean, 4) AS mean,
  round(std, 4) AS std, round(mn, 4) AS min, round(mx, 4) AS max, round(q25, 4) AS q25, round(median, 4) AS median,
  round(q75, 4) AS q75, round(q75 - q25, 4) AS iqr
FROM o_b b JOIN m ON b."column" = m."column" """


def categorical(table: str, columns) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", 'categorical' AS data_type, count(*) AS total_count,
        count(*) FILTER (WHERE NOT {miss(c)}) AS valid_count, count(*) FILTER (WHERE {miss(c)}) AS missing_count,
        round(count(*) FILTER (WHERE {miss(c)}) / count(*) * 100, 2) AS missing_percentage,
        count(DISTINCT {c}) FILTER (WHERE NOT {miss(c)}) AS unique_count FROM {table}""" for c in columns)


SQL["profile_categorical"] = f"WITH {FL} {categorical('fl', ('l_returnflag', 'l_linestatus'))}"
SQL["profile_documents"] = categorical("documents", ("text", "lang", "source"))


def dataset_profile(table: str, columns, numbers) -> str:
    """Select list of one row; needs CTEs m (missing rows) and d (duplicates)."""
    kind = {c: "float64" if c in numbers else "object" for c in columns}
    return f"""(SELECT max(total_rows) FROM m) AS rows, CAST({len(columns)} AS BIGINT) AS columns,
  (SELECT dup FROM d) AS duplicate_rows, '{','.join(columns)}' AS column_names,
  '{','.join(c + ':' + kind[c] for c in columns)}' AS data_types,
  (SELECT string_agg("column" || ':' || missing_count, ',' ORDER BY ordinal) FROM m) AS missing_values,
  '{','.join(c for c in columns if c in numbers)}' AS numeric_columns,
  '{','.join(c for c in columns if c not in numbers)}' AS categorical_columns"""


def md(table: str, columns) -> str:
    return f"""m AS ({missing_rows(table, columns)}), d AS (SELECT CAST(sum(c - 1) AS BIGINT) AS dup
      FROM (SELECT count(*) AS c FROM {table} GROUP BY {', '.join(columns)}))"""


def score(n_columns: int) -> str:
    return f"""round(greatest(0, least(100, 100 * (0.6 * (1 - g / (n * {n_columns})) + 0.4 * (1 - dup / n)))), 2)"""


SQL["dataset_profile"] = f"WITH {FL}, {md('fl', LINE_COLUMNS)} SELECT {dataset_profile('fl', LINE_COLUMNS, LINE_NUMBERS)}"
SQL["missing_values"] = f"WITH {FL} {missing_values('fl', LINE_COLUMNS, 'l_orderkey')}"
SQL["empty_dataset"] = """SELECT 'EMPTY_DATASET' AS finding_type, 'CRITICAL' AS severity,
  'The dataset contains no records.' AS message, count(*) AS affected_count
FROM events WHERE ts > TIMESTAMP '2100-01-01' HAVING count(*) = 0"""
SQL["duplicate_records"] = f"WITH {FL} {duplicates('fl', ', '.join(LINE_COLUMNS))}"
SQL["duplicates_trimmed"] = f"""WITH t AS (SELECT lang, source, text FROM documents UNION ALL
  SELECT lang, source, text FROM documents WHERE doc_id % 3 = 0)
{duplicates('t', r"lang, source, regexp_replace(text, '^\s+|\s+$', '', 'g')")}"""
SQL["empty_columns"] = f"""WITH {TEXT_ORDERS} SELECT "column", total_rows FROM (
{missing_rows('tx', TEXT_COLUMNS)}) WHERE missing_count = total_rows AND total_rows > 0"""
SQL["quality_score"] = f"""WITH {FL}, {md('fl', LINE_COLUMNS)},
q AS (SELECT sum(missing_count) AS g, max(total_rows) AS n,
      count(*) FILTER (WHERE missing_count = total_rows) AS e FROM m)
SELECT n AS total_rows, CAST(10 AS BIGINT) AS total_columns, CAST(g AS BIGINT) AS missing_values, dup AS duplicate_rows,
  e AS empty_column_count, {score(10)} AS quality_score, g = 0 AND dup = 0 AND e = 0 AS is_valid FROM q, d"""
SQL["analyze_dataset"] = f"""WITH {FO}, {md('fo', ORDER_COLUMNS)},
q AS (SELECT sum(missing_count) AS g, max(total_rows) AS n,
      count(*) FILTER (WHERE missing_count = total_rows) AS e FROM m)
SELECT {dataset_profile('fo', ORDER_COLUMNS, ORDER_NUMBERS)}, CAST(g AS BIGINT) AS missing_cells,
  e AS empty_column_count, {score(6)} AS quality_score, g = 0 AND dup = 0 AND e = 0 AS is_valid FROM q, d"""
SQL["baseline_summary"] = f"""WITH s AS (SELECT * FROM orders)
{sample_summary('s', ORDER_NUMBERS, '')}"""
SQL["baseline_sample"] = "SELECT o_orderkey, o_custkey, o_totalprice FROM orders"

# --- outliers --------------------------------------------------------------------------------------

SQL["outlier_stats"] = f"""{LINE_MEASURES} SELECT "column", n, round(mean, 4) AS mean, round(std, 4) AS std,
  round(skewness, 4) AS skewness, round(mn, 4) AS min, round(mx, 4) AS max, round(q25, 4) AS q25,
  round(median, 4) AS median, round(q75, 4) AS q75, round(iqr, 4) AS iqr FROM o_s"""
EVENT_MEASURES = f"WITH {measures('o', 'events', [(4, 'value')])}"
SQL["zscore_rows"] = f"""{EVENT_MEASURES} SELECT CAST(event_id AS VARCHAR) AS _rid, 'value' AS "column", value,
  round(mean, 4) AS mean, round(std, 4) AS std_dev, round(abs((value - mean) / std), 2) AS z_score,
  CAST(3.0 AS DOUBLE) AS threshold FROM events, o_s WHERE abs((value - mean) / std) > 3"""
SQL["iqr_rows"] = f"""{EVENT_MEASURES} SELECT CAST(event_id AS VARCHAR) AS _rid, 'value' AS "column", value,
  CASE WHEN value < lower_fence THEN 'LOW' ELSE 'HIGH' END AS direction, round(q25, 4) AS q1, round(q75, 4) AS q3,
  round(iqr, 4) AS iqr, round(lower_fence, 4) AS lower_bound, round(upper_fence, 4) AS upper_bound
FROM events, o_s WHERE value < lower_fence OR value > upper_fence"""
SQL["outlier_summary"] = f"""{LINE_MEASURES} SELECT "column", n AS valid_count, round(mean, 4) AS mean,
  round(std, 4) AS std, round(skewness, 4) AS skewness, is_skewed, z_count AS z_outlier_count,
  iqr_count AS iqr_outlier_count, pct AS outlier_percentage, round(lower_fence, 4) AS lower_fence,
  round(upper_fence, 4) AS upper_fence, round(max_z, 2) AS max_z_score FROM o_m"""
SQL["outlier_findings"] = f"""{LINE_MEASURES}, {FC},
{measures('c', 'fc', [(0, 'c_custkey'), (2, 'c_nationkey'), (3, 'c_acctbal')])}
SELECT 'lineitem' AS source, "column" AS column_name, severity, message, iqr_count AS affected_count,
  pct AS affected_pct FROM o_f UNION ALL
SELECT 'customer', "column", severity, message, iqr_count, pct FROM c_f"""
SQL["outlier_samples"] = f"""{EVENT_MEASURES} SELECT * FROM (SELECT 'value' AS "column",
  CAST(row_number() OVER (ORDER BY event_id) AS INTEGER) AS position, CAST(event_id AS VARCHAR) AS _rid, value
  FROM events, o_s WHERE value < lower_fence OR value > upper_fence) WHERE position <= 5"""
SQL["outlier_chart"] = f"""{EVENT_MEASURES} SELECT "column", position, _rid, round(value, 2) AS value,
  round(abs((value - mean) / std), 2) AS z_score
FROM (SELECT CAST(row_number() OVER (ORDER BY event_id) AS INTEGER) AS position, CAST(event_id AS VARCHAR) AS _rid, value
  FROM events WHERE value IS NOT NULL), o_s WHERE position <= 40"""
SQL["boxplot_summary"] = f"""{LINE_MEASURES} SELECT "column", n AS sample_size, round(mn, 4) AS min,
  round(lower_fence, 4) AS lower_bound, round(q25, 4) AS q1, round(median, 4) AS median, round(q75, 4) AS q3,
  round(upper_fence, 4) AS upper_bound, round(mx, 4) AS max, round(iqr, 4) AS iqr, iqr_count AS outlier_count,
  pct AS outlier_percentage, CASE WHEN iqr_count > 0 THEN 'OUTLIER_DETECTED' ELSE 'HEALTHY' END AS iqr_status,
  z_count AS flagged_count, round(max_z, 2) AS max_z_score,
  CASE WHEN z_count > 0 THEN 'ANOMALY_DETECTED' ELSE 'HEALTHY' END AS z_status FROM o_m"""
ZIQR = """t AS (SELECT count(*) AS n, CAST(sum(z_count) AS BIGINT) AS z,
  CAST(sum(iqr_count) AS BIGINT) AS q, max(round(max_z, 2)) AS mz FROM o_m)"""
FOREST_KIND, KS_KIND = "Isolation Forest", "Kolmogorov-Smirnov Two-Sample Test"


def four_proofs(reference: bool) -> str:
    ks_row = (f"""SELECT count(*), '{KS_KIND}', 'EXECUTED', CASE WHEN count(*) FILTER (WHERE is_drift) > 0 THEN 'DRIFT_DETECTED'
  ELSE 'STABLE' END, count(*) FILTER (WHERE is_drift), NULL, NULL FROM k_d""" if reference else
              f"SELECT 0, '{KS_KIND}', 'NOT_EXECUTED', 'NOT_EXECUTED', 0, NULL, NULL")
    return f"""WITH {FL}, {measures('o', 'fl', LINE_AT)}, {LINE_KS}, {LINE_FOREST}, {ZIQR},
pf AS (SELECT n AS columns_analyzed, 'Z-Score' AS method, 'EXECUTED' AS execution_status,
  CASE WHEN z > 0 THEN 'ANOMALY_DETECTED' ELSE 'HEALTHY' END AS status, z AS total_flagged_count, mz AS max_z_score,
  CAST(NULL AS BIGINT) AS samples FROM t UNION ALL
SELECT n, 'IQR', 'EXECUTED', CASE WHEN q > 0 THEN 'OUTLIER_DETECTED' ELSE 'HEALTHY' END, q, NULL, NULL FROM t UNION ALL
SELECT {len(FOREST.features)}, '{FOREST_KIND}', 'EXECUTED', CASE WHEN count(rid) > 0 THEN 'ANOMALY_DETECTED' ELSE 'HEALTHY' END,
  count(rid), NULL, (SELECT n FROM fth) FROM ff UNION ALL
{ks_row})"""


SQL["method_proofs"] = four_proofs(True) + " SELECT * FROM pf"
SQL["method_proofs_no_baseline"] = four_proofs(False) + " SELECT * FROM pf"
SQL["report_methods"] = four_proofs(True) + f"""
SELECT method, CASE method WHEN '{KS_KIND}' THEN 'Drift Agent' ELSE 'Inspector Agent' END AS agent,
  CASE method WHEN 'Z-Score' THEN 'Statistical anomaly detection' WHEN 'IQR' THEN 'Statistical outlier detection'
    WHEN '{FOREST_KIND}' THEN 'Unsupervised ML anomaly detection' ELSE 'Statistical distribution drift detection' END
    AS classification, execution_status,
  CASE method WHEN 'Z-Score' THEN 'Columns analyzed: ' || columns_analyzed || ', Flagged count: ' || total_flagged_count ||
      ', Max |Z|: ' || printf('%.2f', max_z_score) || ', Threshold: |z| > 3.0'
    WHEN 'IQR' THEN 'Columns analyzed: ' || columns_analyzed || ', Outliers count: ' || total_flagged_count || ', Method rule: 1.5 × IQR'
    WHEN '{FOREST_KIND}' THEN 'Samples: ' || samples || ', Features: ' || columns_analyzed || ', Anomalies: ' ||
      total_flagged_count || ', Contamination: auto'
    ELSE 'Columns tested: ' || columns_analyzed || ', Drift count: ' || total_flagged_count || ', Rule: p < 0.05 AND D >= 0.10'
    END AS evidence FROM pf"""
SQL["report_findings"] = f"""{FINDINGS} SELECT CAST(position AS INTEGER) AS position, finding_type, severity, message, evidence
FROM numbered"""

# --- forest ---------------------------------------------------------------------------------------------

SQL["iforest_features"] = f"""WITH {FL}, t AS (SELECT count(*) AS total_rows FROM fl),
v AS ({long_form('fl', LINE_AT)}),
s AS (SELECT "column", ordinal, count(*) AS n, stddev_pop(value) AS std FROM v GROUP BY "column", ordinal)
SELECT "column", ordinal, n AS numeric_count, total_rows, round(std, 4) AS std,
  n >= 0.7 * total_rows AND n >= 5 AND std > 1e-8 AS is_feature FROM s, t UNION ALL
SELECT c, o, CAST(0 AS BIGINT), total_rows, NULL, FALSE FROM t, (VALUES ('l_returnflag', 8), ('l_linestatus', 9)) AS x(c, o)"""
SQL["forest_scores_fixed"] = f"""WITH {FL}, {LINE_FOREST} SELECT rid AS _rid, round(score, 6) AS score FROM fsc"""
SQL["forest_rows_fixed"] = f"""WITH {FL}, {LINE_FOREST} SELECT rid AS _rid, round(score, 4) AS score FROM ff"""
SQL["remediate_forest"] = f"""WITH {FL}, {LINE_FOREST} SELECT {', '.join(LINE_KEYS)}, l_quantity,
  CASE WHEN rid IN (SELECT rid FROM ff) THEN 'quarantined' ELSE 'kept' END AS side FROM fsc"""
SQL["iforest_matrix"] = f"""WITH {FO}, m AS (SELECT quantile_cont(CAST(o_custkey AS DOUBLE), 0.5) AS a,
  quantile_cont(o_totalprice, 0.5) AS b FROM fo)
SELECT CAST(o_orderkey AS VARCHAR) AS _rid, coalesce(CAST(o_custkey AS DOUBLE), a) AS o_custkey,
  coalesce(o_totalprice, b) AS o_totalprice FROM fo, m"""
SQL["score_histogram"] = """
WITH s AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
b AS (SELECT least(CAST(floor((value - lo) / ((hi - lo) / 15)) AS INTEGER) + 1, 15) AS bin FROM events, s
      WHERE value IS NOT NULL),
g AS (SELECT CAST(bin AS INTEGER) AS bin, lo + (hi - lo) * (bin - 1) / 15 AS low, lo + (hi - lo) * bin / 15 AS high
      FROM range(1, 16) AS r(bin), s)
SELECT g.bin, printf('%.2f to %.2f', low, high) AS range, round((low + high) / 2, 3) AS score_mid,
  count(b.bin) AS count, high <= 100.0 AS is_anomalous
FROM g LEFT JOIN b ON g.bin = b.bin GROUP BY g.bin, low, high"""

# --- drift ------------------------------------------------------------------------------------------------

EVENT_SIDES = """cur AS (SELECT event_id, user_id, value * 1.5 AS value FROM events WHERE ts >= TIMESTAMP '2024-01-16'),
ref AS (SELECT event_id, user_id, value FROM events WHERE ts < TIMESTAMP '2024-01-16')"""
EVENT_AT = [(0, "event_id"), (2, "user_id"), (3, "value")]
EVENT_KS = f"WITH {EVENT_SIDES}, {ks('k', long_form('cur', EVENT_AT), long_form('ref', EVENT_AT))}"
KS_RESULT = """SELECT "column", n_ref, n_cur, round(d, 4) AS ks_statistic, round(p, 6) AS p_value, is_drift, severity,
  round(ref_mean, 4) AS ref_mean, round(cur_mean, 4) AS cur_mean FROM k_d"""
SQL["ks_statistic"] = f"""{EVENT_KS} SELECT "column", n_ref, n_cur, round(d, 4) AS ks_statistic,
  round(ref_mean, 4) AS ref_mean, round(cur_mean, 4) AS cur_mean FROM k_d"""
_ODD = list(enumerate(ORDER_NUMBERS))
SQL["ks_pvalue"] = f"""WITH {ks('k', long_form('(SELECT * FROM orders WHERE o_orderkey % 2 = 1)', _ODD),
                               long_form('(SELECT * FROM orders WHERE o_orderkey % 2 = 0)', _ODD))}
SELECT "column", round(d, 4) AS ks_statistic, round(p, 6) AS p_value, is_drift FROM k_d"""
SQL["ks_narrow_range"] = f"""WITH ev AS (SELECT event_id, epoch_us(ts) AS "at" FROM events),
{ks('k', "SELECT 'at' AS " + '"column", 0 AS ordinal, CAST("at" AS DOUBLE) AS value FROM ev WHERE event_id % 2 = 1',
    "SELECT 'at' AS " + '"column", 0 AS ordinal, CAST("at" AS DOUBLE) AS value FROM ev WHERE event_id % 2 = 0 AND event_id % 3 > 0')}
SELECT "column", n_ref, n_cur, round(d, 4) AS ks_statistic, round(p, 6) AS p_value FROM k_d"""
_SUPPLIERS = [(0, "s_acctbal")]
SQL["ks_pvalue_exact"] = f"""WITH RECURSIVE {ks('k',
    long_form('(SELECT * FROM supplier WHERE s_nationkey % 5 = 0)', _SUPPLIERS),
    long_form('(SELECT * FROM supplier WHERE s_nationkey % 5 = 1)', _SUPPLIERS))},
x AS (SELECT n_cur AS a, n_ref AS b, round(d * n_cur * n_ref) AS lim FROM k_d),
w AS (SELECT 0 AS i, list_reduce(list_transform(range(1, b + 1), lambda j: [j::DOUBLE]), lambda acc, e:
        list_append(acc, CASE WHEN e[1] * a < lim THEN acc[-1] ELSE 0.0 END), [1.0::DOUBLE]) AS line, a, b, lim FROM x
  UNION ALL
  SELECT i + 1, list_reduce(list_transform(range(1, b + 1), lambda j: [j::DOUBLE, line[j + 1]]), lambda acc, e:
        list_append(acc, CASE WHEN abs((i + 1) * b - e[1] * a) < lim
          THEN (e[2] * (i + 1) + acc[-1] * e[1]) / (i + 1 + e[1]) ELSE 0.0 END),
        [CASE WHEN (i + 1) * b < lim THEN line[1] ELSE 0.0 END]), a, b, lim FROM w WHERE i < a)
SELECT "column", n_cur, n_ref, round(d, 6) AS ks_statistic,
  round(least(1.0, greatest(0.0, 1.0 - (SELECT line[-1] FROM w WHERE i = a))), 6) AS p_value, 'exact' AS p_method FROM k_d"""
SQL["drift_findings"] = f"""{EVENT_KS} SELECT "column" AS column_name, severity, message,
  CAST(json_object('column', "column", 'ks_statistic', round(d, 4), 'p_value', printf('%.6f', p),
       'alpha_threshold', CAST(0.05 AS DOUBLE), 'd_threshold', CAST(0.1 AS DOUBLE),
       'current_mean', round(cur_mean, 4), 'reference_mean', round(ref_mean, 4)) AS VARCHAR) AS evidence
FROM k_d WHERE is_drift"""
SQL["ecdf_curve"] = f"""WITH {EVENT_SIDES}, s AS (SELECT min(value) AS lo, max(value) AS hi FROM
  (SELECT value FROM cur UNION ALL SELECT value FROM ref)),
g AS (SELECT CAST(i AS INTEGER) AS point, CASE WHEN i = 19 THEN hi ELSE lo + i * ((hi - lo) / 19) END AS x
      FROM range(0, 20) AS r(i), s),
e AS (SELECT point, x, (SELECT count(*) FROM cur WHERE value <= x) / (SELECT count(*) FROM cur) AS f,
      (SELECT count(*) FROM ref WHERE value <= x) / (SELECT count(*) FROM ref) AS r FROM g)
SELECT 'value' AS "column", point, round(x, 2) AS x, round(f, 4) AS current_cdf, round(r, 4) AS baseline_cdf,
  round(abs(f - r), 4) AS d_distance FROM e"""
SQL["drift_status"] = f"""{EVENT_KS} SELECT CASE WHEN (SELECT count(*) FROM ref) < 10 THEN 'NOT_EXECUTED'
  WHEN count(*) = 0 THEN 'INSUFFICIENT_DATA' WHEN count(*) FILTER (WHERE is_drift) > 0 THEN 'DRIFT_DETECTED'
  ELSE 'STABLE' END AS status, count(*) AS columns_tested, count(*) FILTER (WHERE is_drift) AS drift_detected_count
FROM k_d"""
SQL["drift_lineitem"] = f"WITH {FL}, {LINE_KS} {KS_RESULT}"

# --- run history ------------------------------------------------------------------------------------------------

RUNS = """runs AS (SELECT event_type || '|' || strftime(ts, '%Y-%m-%d') AS run_id, event_type AS pipeline_id,
    CASE WHEN event_type <> 'error' THEN 'events' END AS dataset_id, 'SUCCESS' AS status, min(ts) AS started_at,
    count(*) AS rows_input, count(*) FILTER (WHERE value < 100) AS rows_output,
    date_diff('microsecond', min(ts), max(ts)) / 1000.0 AS duration_ms
  FROM events GROUP BY event_type, strftime(ts, '%Y-%m-%d'))"""


def checks(runs: str = "runs", p: str = "") -> str:
    """Brute force: every run against the other runs of its scope."""
    return f"""
{p}mt AS (SELECT run_id, pipeline_id, dataset_id, started_at, 1 AS metric_order, 'Input Rows' AS metric,
             CAST(rows_input AS DOUBLE) AS actual FROM {runs} UNION ALL
  SELECT run_id, pipeline_id, dataset_id, started_at, 2, 'Output Rows', CAST(rows_output AS DOUBLE) FROM {runs} UNION ALL
  SELECT run_id, pipeline_id, dataset_id, started_at, 3, 'Execution Duration (ms)', duration_ms FROM {runs} UNION ALL
  SELECT run_id, pipeline_id, dataset_id, started_at, 4, 'Output/Input Ratio', rows_output / rows_input FROM {runs}
  WHERE rows_input > 0),
{p}bl AS (SELECT a.run_id, a.pipeline_id, a.dataset_id, a.started_at, a.metric_order, a.metric, a.actual,
         count(*) AS n_other, avg(b.actual) AS average, stddev_pop(b.actual) AS std
  FROM {p}mt a JOIN {p}mt b ON a.pipeline_id = b.pipeline_id AND a.metric = b.metric AND a.run_id <> b.run_id
       AND (a.dataset_id IS NULL OR a.dataset_id = b.dataset_id)
  GROUP BY ALL HAVING count(*) >= 3),
{p}bb AS (SELECT *, greatest(0, average - 2 * std) AS lower_bound, average + 2 * std AS upper_bound,
         CASE WHEN average = 0 THEN 0 ELSE abs(actual - average) / abs(average) END AS deviation FROM {p}bl),
{p}ck AS (SELECT *, (actual < lower_bound OR actual > upper_bound) AS is_outside,
         (actual < lower_bound OR actual > upper_bound) AND deviation >= 0.05 AS is_anomaly FROM {p}bb),
{p}rf AS (SELECT *, CASE WHEN metric IN ('Output Rows', 'Output/Input Ratio') THEN
           CASE WHEN deviation * 100 >= 50 THEN 'CRITICAL' WHEN deviation * 100 >= 20 THEN 'HIGH'
                WHEN deviation * 100 >= 5 THEN 'MEDIUM' ELSE 'LOW' END
         ELSE CASE WHEN deviation * 100 >= 50 THEN 'HIGH' WHEN deviation * 100 >= 20 THEN 'MEDIUM'
                   WHEN deviation * 100 >= 5 THEN 'LOW' ELSE 'INFO' END END AS severity,
    CASE metric WHEN 'Input Rows' THEN 'Input Volume Anomaly' WHEN 'Output Rows' THEN 'Output Volume Anomaly'
      WHEN 'Execution Duration (ms)' THEN 'Execution Performance Anomaly' ELSE 'Output Conversion Ratio Anomaly' END
      AS finding_type,
    CASE metric WHEN 'Input Rows' THEN 'Source ingestion or upstream data availability'
      WHEN 'Output Rows' THEN 'Transformation, filtering, aggregation, or loading stage'
      WHEN 'Execution Duration (ms)' THEN 'Transformation, database query, resource utilization, or loading stage'
      ELSE 'Transformation, filtering, validation, or loading stage' END AS likely_area,
    printf('Actual value: %.2f. Historical average: %.2f. Expected range: %.2f to %.2f. ', round(actual, 6),
           round(average, 6), round(lower_bound, 6), round(upper_bound, 6)) ||
    printf('Deviation from historical average: %.2f%%.', round(deviation * 100, 6)) AS evidence
  FROM {p}ck WHERE is_anomaly)"""


RUN_CHECKS = f"WITH {RUNS}, {checks()}"
SQL["etl_runs"] = f"""WITH {RUNS} SELECT run_id, pipeline_id, dataset_id, status, rows_input, rows_output,
  round(duration_ms, 3) AS duration_ms FROM runs"""
SQL["run_baseline"] = f"""{RUN_CHECKS} SELECT run_id, metric, n_other, round(actual, 4) AS actual,
  round(average, 4) AS average, round(std, 4) AS std, round(lower_bound, 4) AS lower_bound,
  round(upper_bound, 4) AS upper_bound FROM bb"""
SQL["metric_checks"] = f"""{RUN_CHECKS} SELECT run_id, metric, round(deviation, 4) AS deviation, is_anomaly,
  CASE WHEN is_anomaly THEN metric || ' is significantly outside the historical normal range. Actual value is ' ||
      printf('%.2f', round(actual, 6)) || ', while the expected range is ' || printf('%.2f', round(lower_bound, 6)) || ' to ' ||
      printf('%.2f', round(upper_bound, 6)) || '. The relative deviation is ' || printf('%.2f', round(deviation * 100, 6)) || '%.'
    WHEN is_outside THEN metric || ' is slightly outside the historical range, but the deviation is only ' ||
      printf('%.2f', round(deviation * 100, 6)) || '%, which is below the 5% anomaly threshold.'
    ELSE metric || ' is within the historical normal range.' END AS explanation FROM ck"""
SQL["run_anomalies"] = f"""{RUN_CHECKS} SELECT run_id, bool_or(is_anomaly) AS is_anomaly,
  avg(CAST(is_anomaly AS INTEGER)) AS anomaly_score,
  CASE WHEN bool_or(is_anomaly) THEN 'Anomaly detected in: ' ||
    string_agg(metric, ', ' ORDER BY metric_order) FILTER (WHERE is_anomaly)
    ELSE 'ETL run is within the historical baseline.' END AS summary FROM ck GROUP BY run_id"""
SQL["run_findings"] = f"""{RUN_CHECKS} SELECT run_id, metric, finding_type, severity, round(deviation, 4) AS deviation,
  evidence, likely_area, finding_type || ' detected. The ' || metric ||
  ' metric deviates significantly from historical behaviour.' AS explanation FROM rf"""
SQL["replace_findings"] = f"""{RUN_CHECKS},
old AS (SELECT * REPLACE (rows_output - 10 AS rows_output) FROM runs), {checks('old', 'x')}
SELECT run_id, metric, severity, round(deviation, 4) AS deviation FROM xrf WHERE started_at < TIMESTAMP '2024-01-16'
UNION ALL
SELECT run_id, metric, severity, round(deviation, 4) FROM rf WHERE started_at >= TIMESTAMP '2024-01-16'"""
RUN_CAUSES = f"""{RUN_CHECKS}, rc AS (SELECT *,
  metric IN ('Output Rows', 'Output/Input Ratio') AS is_loss,
  CASE metric WHEN 'Output Rows' THEN 0.85 WHEN 'Output/Input Ratio' THEN 0.9 ELSE 0.5 END AS conf,
  CASE metric WHEN 'Output Rows' THEN
    printf('Output rows were %.0f, compared with a historical expected average of approximately %.0f rows. ', round(actual, 4), round(average, 4))
    || printf('The expected output range was %.0f to %.0f rows. ', round(lower_bound, 4), round(upper_bound, 4))
    || printf('Observed output deviation was %.2f%%.', round(deviation * 100, 6))
  WHEN 'Output/Input Ratio' THEN printf('Observed output/input ratio was %.4f. ', round(actual, 8))
    || printf('Historical expected ratio was %.4f. ', round(average, 8))
    || printf('The expected ratio range was %.4f to %.4f. ', round(lower_bound, 8), round(upper_bound, 8))
    || printf('Ratio deviation was %.2f%%.', round(deviation * 100, 6))
  ELSE evidence END AS ev FROM rf),
rcc AS (SELECT run_id, CASE WHEN is_loss THEN 0 ELSE metric_order END AS cause_order,
  max(CASE WHEN is_loss THEN
    'Potential record loss during ETL transformation, filtering, validation, or loading.'
    ELSE 'Abnormal behaviour associated with ' || metric || '.' END) AS cause,
  CAST(max(conf) AS DOUBLE) AS confidence, string_agg(ev, ' ' ORDER BY metric_order) AS evidence,
  max(CASE WHEN is_loss THEN 'Transformation, filtering, validation, or loading' ELSE likely_area END) AS affected_area
  FROM rc GROUP BY 1, 2)"""
SQL["run_root_cause"] = f"{RUN_CAUSES} SELECT * FROM rcc"
SQL["run_primary_cause"] = f"""{RUN_CAUSES} SELECT run_id,
  arg_max(cause, confidence * 100 - cause_order) AS primary_cause, max(confidence) AS overall_confidence,
  count(*) AS candidate_count FROM rcc GROUP BY run_id"""
SQL["list_runs"] = f"""WITH {RUNS} SELECT run_id, pipeline_id, status, rows_input, rows_output FROM runs
WHERE dataset_id = 'events' AND status = 'SUCCESS' ORDER BY started_at DESC, run_id LIMIT 50"""

# --- findings, evidence, causes ---------------------------------------------------------------------------------------

SEVERITY_ORDER = "CASE severity WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 WHEN 'CRITICAL' THEN 4 END"
STATUS = f"""st AS (SELECT CASE WHEN count(*) > 0 THEN 'ANOMALY_DETECTED' ELSE 'HEALTHY' END AS status,
  count(*) AS finding_count, coalesce(arg_max(severity, {SEVERITY_ORDER}), 'NONE') AS highest_severity FROM findings)"""
SQL["audit_findings"] = f"{FINDINGS} SELECT * FROM findings"
SQL["evidence_items"] = f"""{FINDINGS} SELECT 'E' || position AS evidence_id, finding_type, column_name, severity, message
FROM numbered"""
SQL["evidence_status"] = f"""{FINDINGS} SELECT count(*) AS evidence_count,
  CASE WHEN count(*) > 0 THEN 'EVIDENCE_AVAILABLE' ELSE 'NO_EVIDENCE' END AS status FROM findings"""
SQL["severity_distribution"] = f"{FINDINGS} SELECT severity, count(*) AS finding_count FROM findings GROUP BY severity"
SQL["highest_severity"] = f"{FINDINGS}, {STATUS} SELECT highest_severity FROM st"
SQL["audit_status"] = f"{FINDINGS}, {STATUS} SELECT * FROM st"
SQL["finding_types"] = f"""{FINDINGS} SELECT string_agg(DISTINCT finding_type, ', ' ORDER BY finding_type)
  AS finding_types FROM findings"""
SQL["inspection_summary"] = f"""{FINDINGS}, {STATUS} SELECT *, CASE WHEN finding_count = 0 THEN
  'Inspection completed successfully. No data-quality or schema-drift findings were detected.'
  ELSE 'Inspection detected ' || finding_count || ' finding(s). Highest severity: ' || highest_severity ||
       '. Overall status: ' || status || '.' END AS summary FROM st"""
CANON = """cn AS (SELECT finding_type AS type, severity, coalesce(column_name, '') AS "column", message,
  CAST(row_number() OVER (ORDER BY finding_type, coalesce(column_name, ''), severity, message) AS INTEGER) AS position
  FROM findings)"""
SQL["canonical_audit"] = f"{FINDINGS}, {CANON} SELECT * FROM cn"
SQL["audit_hash"] = f"""{FINDINGS}, {CANON}, {STATUS} SELECT sha256(CAST(json_object('v', 1, 'dataset_path', 'lineitem',
  'status', status, 'highest_severity', highest_severity, 'row_count', (SELECT count(*) FROM fl), 'column_count', 10,
  'finding_count', finding_count, 'findings', (SELECT list({{'type': type, 'severity': severity, 'column': "column",
  'message': message}} ORDER BY position) FROM cn)) AS VARCHAR)) AS audit_hash FROM st"""
CANON_RECORD = """SELECT CAST(json_object('v', 1, 'dataset_path', 'lineitem',
  'status', status, 'highest_severity', highest_severity, 'row_count', (SELECT count(*) FROM fl), 'column_count', 10,
  'finding_count', finding_count, 'findings', (SELECT list({'type': type, 'severity': severity, 'column': "column",
  'message': message} ORDER BY position) FROM cn)) AS VARCHAR) AS record FROM st"""
#: The key, padded to a block and combined with the two constants of the keyed hash.
PADDED = """(SELECT list_aggregate(list_transform(range(1, 65),
  lambda i: chr(xor(CASE WHEN i <= length(k) THEN ascii(k[i]) ELSE 0 END, {pad}))), 'string_agg', '') FROM ky)"""
SQL["audit_hmac"] = f"""{FINDINGS}, {CANON}, {STATUS}, ky AS (SELECT max(r_name) AS k FROM region), cr AS ({CANON_RECORD})
SELECT sha256(encode({PADDED.format(pad=0x5C)}) || unhex(sha256({PADDED.format(pad=0x36)} || record))) AS audit_hmac FROM cr"""
INSPECTIONS = f"""{RUN_CHECKS}, wr AS (SELECT run_id, count(*) AS finding_count,
  arg_max(severity, {SEVERITY_ORDER}) AS worst FROM rf GROUP BY run_id),
ins AS (SELECT r.run_id AS inspection_id, 'events/' || pipeline_id AS dataset_path,
  CASE WHEN coalesce(finding_count, 0) > 0 THEN 'ANOMALY_DETECTED' ELSE 'HEALTHY' END AS status,
  coalesce(worst, 'NONE') AS highest_severity, rows_input AS row_count, coalesce(finding_count, 0) AS finding_count,
  started_at AS created_at FROM runs r LEFT JOIN wr ON r.run_id = wr.run_id)"""
SQL["verify_integrity"] = f"""{INSPECTIONS} SELECT inspection_id,
  CASE WHEN row_count % 5 = 0 THEN 'LEGACY_UNSIGNED' WHEN row_count % 7 = 0 THEN 'TAMPERED' ELSE 'VALID' END AS integrity,
  row_count % 5 = 0 OR row_count % 7 <> 0 AS is_valid FROM ins"""
CAUSES = f"""{FINDINGS}, pt AS (SELECT
  bool_or(finding_type IN ('COLUMN_REMOVED', 'COLUMN_TYPE_CHANGED')) AND
  bool_or(finding_type IN ('MISSING_VALUES', 'DUPLICATE_RECORDS')) AS contract,
  max(affected_pct) FILTER (WHERE finding_type = 'DUPLICATE_RECORDS') AS pct,
  bool_or(finding_type IN ('ML_ISOLATION_FOREST_ANOMALY', 'NUMERICAL_OUTLIERS')) AS outliers,
  bool_or(finding_type = 'DISTRIBUTION_DRIFT') AS drift,
  string_agg(DISTINCT finding_type, ', ' ORDER BY finding_type) AS types FROM findings),
ca AS (SELECT CAST(position AS INTEGER) AS cause_order, 'E' || position AS evidence_id,
  CASE finding_type WHEN 'MISSING_VALUES' THEN 'Potential incomplete source data or missing records during data ingestion.'
    WHEN 'DUPLICATE_RECORDS' THEN 'Potential duplicate data introduced during extraction, transformation, or loading.'
    WHEN 'COLUMN_REMOVED' THEN 'Potential upstream schema change or ETL transformation removing an expected column.'
    ELSE 'Potential issue associated with ' || finding_type || '.' END AS cause,
  CAST(CASE finding_type WHEN 'MISSING_VALUES' THEN 0.75 WHEN 'DUPLICATE_RECORDS' THEN 0.8 WHEN 'COLUMN_REMOVED' THEN 0.9
    ELSE 0.5 END AS DOUBLE) AS confidence,
  CASE finding_type WHEN 'MISSING_VALUES' THEN 'Column ''' || column_name || ''' contains ' ||
      CAST(affected_pct AS VARCHAR) || '% missing values. Finding severity was ' || severity || '.'
    WHEN 'DUPLICATE_RECORDS' THEN 'Duplicate records represent ' || CAST(affected_pct AS VARCHAR) ||
      '% of the dataset. Finding severity was ' || severity || '.'
    WHEN 'COLUMN_REMOVED' THEN 'Expected column ''' || column_name || ''' was not found. Expected data type was ''' ||
      expected_type || '''.' ELSE message END AS evidence,
  CASE finding_type WHEN 'MISSING_VALUES' THEN 'Source data or data ingestion'
    WHEN 'DUPLICATE_RECORDS' THEN 'Extraction, transformation, or loading'
    WHEN 'COLUMN_REMOVED' THEN 'Source schema or transformation' ELSE 'ETL pipeline' END AS affected_area,
  'INDIVIDUAL' AS level FROM numbered),
cp AS (SELECT -1 AS cause_order, 'Upstream Breaking Schema & Extraction Contract Change' AS cause,
    CAST(0.95 AS DOUBLE) AS confidence,
    'Simultaneous occurrence of schema drift and data quality failure. Observed finding types: ' || types AS evidence,
    'Upstream Source Database / API Contract' AS affected_area FROM pt WHERE contract UNION ALL
  SELECT -2, 'Non-Idempotent Pipeline Extraction or Message Replay', 0.92, 'High duplicate rate of ' ||
    printf('%.1f', pct) || '%. Target table lacks unique composite key constraints.',
    'ETL Ingestion & Message Broker Queue' FROM pt WHERE pct > 10 UNION ALL
  SELECT -3, 'Upstream Numerical Calculation or Sensor Data Drift', 0.88,
    'Unsupervised Isolation Forest flagged multivariate outliers. Univariate numerical distribution bounds violated.',
    'ETL Transformation & Domain Feature Engineering' FROM pt WHERE outliers UNION ALL
  SELECT -4, 'Statistical Distribution Shift / Concept Drift', 0.86,
    'Two-sample Kolmogorov-Smirnov test rejected null hypothesis of identical distributions.',
    'Source Environment / Seasonal Consumer Behavior' FROM pt WHERE drift),
rk AS (SELECT cause, confidence, level, row_number() OVER (ORDER BY confidence DESC, cause_order) AS rank FROM (
  SELECT cause_order, cause, confidence, level FROM ca UNION ALL
  SELECT cause_order, cause, confidence, 'CROSS_FINDING_SYNTHESIS' FROM cp))"""
SQL["root_cause_candidates"] = f"{CAUSES} SELECT * FROM ca"
SQL["root_cause_patterns"] = f"""{CAUSES} SELECT cause, confidence, evidence, affected_area,
  'CROSS_FINDING_SYNTHESIS' AS level FROM cp"""
SQL["primary_cause"] = f"""{CAUSES} SELECT count(*) FILTER (WHERE level = 'INDIVIDUAL') AS finding_count,
  arg_min(cause, rank) AS primary_cause, max(confidence) AS overall_confidence FROM rk"""
SQL["top_causes"] = f"{CAUSES} SELECT CAST(rank AS INTEGER) AS rank, cause, confidence FROM rk WHERE rank <= 5"
SQL["recommendations"] = f"""{FINDINGS}, kn AS (SELECT *, row_number() OVER (ORDER BY stage, ordinal, column_name NULLS FIRST)
  AS rn FROM findings WHERE finding_type <> 'DISTRIBUTION_DRIFT')
SELECT 'REC-' || lpad(CAST(rn AS VARCHAR), 3, '0') AS rec_id,
  CASE finding_type WHEN 'MISSING_VALUES' THEN 'DATA_QUALITY' WHEN 'DUPLICATE_RECORDS' THEN 'DATA_INTEGRITY'
    WHEN 'COLUMN_REMOVED' THEN 'SCHEMA_EVOLUTION' ELSE 'ML_ANOMALY' END AS category,
  CASE WHEN finding_type IN ('DUPLICATE_RECORDS', 'COLUMN_REMOVED') THEN 'P0_CRITICAL'
    WHEN finding_type IN ('NUMERICAL_OUTLIERS', 'ML_ISOLATION_FOREST_ANOMALY') THEN 'P1_HIGH' WHEN severity = 'CRITICAL' THEN 'P0_CRITICAL'
    WHEN severity = 'HIGH' THEN 'P1_HIGH' ELSE 'P2_MEDIUM' END AS priority,
  CASE finding_type WHEN 'MISSING_VALUES' THEN 'Handle Missing Values in Column ''' || column_name || ''''
    WHEN 'DUPLICATE_RECORDS' THEN 'Deduplicate Dataset and Enforce Unique Constraints'
    WHEN 'COLUMN_REMOVED' THEN 'Restore or Backfill Missing Column ''' || column_name || ''''
    ELSE 'Quarantine Statistical Outliers & Calibrate Bounds for ''' || coalesce(column_name, 'target_column') || '''' END AS title,
  finding_type AS finding_ref, coalesce(column_name, CASE finding_type WHEN 'DUPLICATE_RECORDS' THEN 'ALL_COLUMNS'
    ELSE 'target_column' END) AS target_column,
  CASE finding_type WHEN 'MISSING_VALUES' THEN 'Detected ' || affected_count || ' null/missing values (' ||
      CAST(affected_pct AS VARCHAR) || '%). Unhandled nulls propagate downstream into broken aggregations and analytics.'
    WHEN 'DUPLICATE_RECORDS' THEN 'Found ' || affected_count || ' duplicate row(s) (' || CAST(affected_pct AS VARCHAR) ||
      '%). Duplicates distort metrics like revenue, active users, and inventory counts.'
    WHEN 'COLUMN_REMOVED' THEN 'Expected column ''' || column_name || ''' (' || expected_type ||
      ') was omitted from source extract. Downstream consumers will fail with column not found errors.'
    ELSE 'Multivariate / numerical boundary violation detected. May indicate currency unit confusion, decimal placement error, or sensor failure.'
    END AS rationale,
  CASE finding_type WHEN 'MISSING_VALUES' THEN 'IMPUTE_OR_QUARANTINE' WHEN 'DUPLICATE_RECORDS' THEN 'DEDUPLICATION'
    WHEN 'COLUMN_REMOVED' THEN 'SCHEMA_RESTORATION' ELSE 'OUTLIER_QUARANTINE' END AS action_type,
  CASE finding_type WHEN 'MISSING_VALUES' THEN '-- Option A: Quarantine affected records' || chr(10) ||
      'INSERT INTO quarantine_' || column_name || '_nulls' || chr(10) || 'SELECT * FROM current_dataset WHERE ' ||
      column_name || ' IS NULL;' || chr(10) || chr(10) || '-- Option B: Impute with domain default' || chr(10) ||
      'UPDATE current_dataset SET ' || column_name || ' = ''UNKNOWN'' WHERE ' || column_name || ' IS NULL;'
    WHEN 'DUPLICATE_RECORDS' THEN '-- Deduplicate keeping earliest record' || chr(10) ||
      'DELETE FROM current_dataset a USING current_dataset b' || chr(10) ||
      'WHERE a.ctid < b.ctid AND a.order_id = b.order_id;'
    WHEN 'COLUMN_REMOVED' THEN '-- Add column back with safe fallback value' || chr(10) ||
      'ALTER TABLE current_dataset ADD COLUMN ' || column_name || ' ' || expected_type || ' DEFAULT NULL;' || chr(10) ||
      '-- Notify upstream producer team to verify extraction query select list.'
    ELSE '-- Divert outliers into dead-letter queue for manual data steward review' || chr(10) ||
      'INSERT INTO dlq_anomalous_records' || chr(10) || 'SELECT * FROM current_dataset WHERE is_anomalous = TRUE;'
    END AS suggested_fix,
  CASE finding_type WHEN 'MISSING_VALUES' THEN
      'Prevents downstream null-pointer exceptions and protects analytics reporting.'
    WHEN 'DUPLICATE_RECORDS' THEN 'Eliminates inflated KPIs and prevents double-billing or phantom inventory.'
    WHEN 'COLUMN_REMOVED' THEN 'Maintains backwards compatibility for downstream pipelines and BI dashboards.'
    ELSE 'Isolates corrupted metrics while allowing clean batch records to proceed.' END AS impact
FROM kn"""
SQL["alerts"] = f"""{FINDINGS} SELECT severity, 'lineitem' AS dataset, finding_type,
  '[' || severity || '] ' || finding_type || ' in lineitem' AS title, message, FALSE AS is_read FROM findings
WHERE severity IN ('CRITICAL', 'HIGH') ORDER BY stage DESC, ordinal DESC"""

# --- repairs ------------------------------------------------------------------------------------------------------------

ACTIONS = f"""{FINDINGS}, md AS (SELECT arg_max(t, (c, -f)) AS v FROM (SELECT trim(l_returnflag) AS t, count(*) AS c,
    min(l_orderkey) AS f FROM fl WHERE trim(l_returnflag) NOT IN ('', 'UNKNOWN') GROUP BY 1)),
ac AS (SELECT *, CASE finding_type WHEN 'DUPLICATE_RECORDS' THEN 'DEDUPLICATE_ROWS'
    WHEN 'MISSING_VALUES' THEN CASE WHEN contains(column_name, 'id') OR contains(column_name, 'key')
      THEN 'QUARANTINE_NULL_RECORDS' ELSE 'IMPUTE_DEFAULT_VALUE' END
    WHEN 'COLUMN_REMOVED' THEN 'RESTORE_SCHEMA_COLUMN' ELSE 'QUARANTINE_ML_OUTLIERS' END AS action_type,
  finding_type IN ('NUMERICAL_OUTLIERS', 'ML_ISOLATION_FOREST_ANOMALY') OR coalesce(affected_pct > 15, FALSE) AS approval,
  row_number() OVER (ORDER BY stage, ordinal, column_name NULLS FIRST) AS rn
  FROM findings WHERE finding_type <> 'DISTRIBUTION_DRIFT'),
act AS (SELECT rn, 'ACT-' || lpad(CAST(rn AS VARCHAR), 3, '0') AS action_id, action_type,
  CASE finding_type WHEN 'MISSING_VALUES' THEN 'COLUMN' WHEN 'COLUMN_REMOVED' THEN 'SCHEMA' ELSE 'DATASET' END
    AS target_type,
  CASE WHEN finding_type = 'DUPLICATE_RECORDS' THEN 'ALL_ROWS' ELSE coalesce(column_name, 'MULTIVARIATE') END AS target, severity,
  CASE WHEN action_type = 'QUARANTINE_ML_OUTLIERS' THEN 'MEDIUM' WHEN NOT approval THEN 'LOW'
    WHEN finding_type = 'MISSING_VALUES' THEN 'HIGH' ELSE 'MEDIUM' END AS risk_level,
  CASE WHEN approval THEN 'REQUIRES_OPERATOR_APPROVAL' ELSE 'POLICY_APPROVED' END AS policy_status,
  CASE WHEN approval THEN 'ADMIN' ELSE 'DATA_ENGINEER' END AS required_role,
  CASE action_type WHEN 'DEDUPLICATE_ROWS' THEN 'Removes ' || affected_count || ' duplicate record(s) (' ||
      printf('%.1f', affected_pct) || '%).'
    WHEN 'QUARANTINE_NULL_RECORDS' THEN 'Quarantine ' || affected_count || ' rows with null identifier in ''' ||
      column_name || ''' to DLQ.'
    WHEN 'IMPUTE_DEFAULT_VALUE' THEN 'Imputes ' || affected_count || ' missing value(s) in ''' || column_name ||
      ''' using mode (''' || (SELECT v FROM md) || ''').'
    WHEN 'RESTORE_SCHEMA_COLUMN' THEN 'Backfills missing column ''' || column_name || ''' with default NULL values.'
    ELSE 'Quarantines ' || affected_count || ' multivariate outlier records into dlq_anomalies.' END AS estimated_impact,
  CASE WHEN action_type = 'IMPUTE_DEFAULT_VALUE' THEN 'MODE' END AS strategy,
  CASE WHEN action_type = 'IMPUTE_DEFAULT_VALUE' THEN (SELECT v FROM md) END AS impute_value FROM ac),
gt AS (SELECT *, risk_level = 'HIGH' OR policy_status = 'REQUIRES_OPERATOR_APPROVAL' AS risky FROM act)"""
SQL["propose_actions"] = f"""{ACTIONS} SELECT * EXCLUDE (rn) FROM act"""
SQL["audit_dossier_parts"] = CAUSES + ACTIONS[len(FINDINGS):] + SQL["recommendations"][
    len(FINDINGS):SQL["recommendations"].index("SELECT 'REC-'")] + ", rc AS (" + SQL["recommendations"][
    SQL["recommendations"].index("SELECT 'REC-'"):] + """)
SELECT 'evidence' AS section, CAST(position AS INTEGER) AS position, 'E' || position AS item, finding_type AS subject,
  message AS text FROM numbered UNION ALL
SELECT 'cause', cause_order, level, cause, evidence FROM ca UNION ALL
SELECT 'cause', cause_order, 'CROSS_FINDING_SYNTHESIS', cause, evidence FROM cp UNION ALL
SELECT 'recommendation', CAST(rec_id[5:] AS INTEGER), rec_id, target_column, title FROM rc UNION ALL
SELECT 'action', CAST(rn AS INTEGER), action_id, target, estimated_impact FROM act"""
SQL["plan_policy"] = f"""{ACTIONS} SELECT count(*) AS candidate_count,
  CASE WHEN bool_or(risk_level = 'HIGH') THEN 'REQUIRES_APPROVAL' ELSE 'READY_FOR_EXECUTION' END AS overall_policy,
  count(*) FILTER (WHERE policy_status = 'REQUIRES_OPERATOR_APPROVAL') AS requires_approval_count FROM act"""
REASON = """'Requires ADMIN approval (Policy status: ' || policy_status ||
  '). Insufficient permissions for role ''DATA_ENGINEER''.'"""
SQL["gate_actions"] = f"""{ACTIONS} SELECT action_id, action_type, target, risky AS is_high_risk,
  CASE WHEN risky THEN 'SKIPPED_POLICY_RESTRICTION' ELSE 'AUTHORIZED' END AS execution_status,
  CASE WHEN risky THEN {REASON} END AS reason FROM gt"""
SQL["report_actions"] = f"""{ACTIONS} SELECT action_id, action_type, target, severity, risk_level, policy_status,
  CAST(0 AS BIGINT) AS rows_affected,
  CASE WHEN risky THEN 'SKIPPED (' || {REASON} || ')' ELSE 'EXECUTED' END AS status FROM gt"""
SQL["validate_actions"] = f"""{ACTIONS}
SELECT action_id || ':by id' AS request_id, action_id AS requested_id, action_type, target, action_id AS matched_id,
  'AUTHORIZED' AS validation FROM act UNION ALL
SELECT action_id || ':by pair', NULL, action_type, target, action_id, 'AUTHORIZED' FROM act UNION ALL
SELECT action_id || ':forged type', action_id, 'DROP_TABLE', target, action_id, 'TYPE_MISMATCH' FROM act UNION ALL
SELECT action_id || ':unknown', 'ACT-999', action_type, target || '_x', NULL, 'NOT_AUTHORIZED' FROM act"""
KNOWN = r"trim(o_orderpriority) NOT IN ('', 'UNKNOWN')"


def order_mode(table: str, c: str) -> str:
    return f"""(SELECT arg_max(t, (c, -f)) FROM (SELECT trim({c}) AS t, count(*) AS c, min(o_orderkey) AS f FROM {table}
      WHERE trim({c}) NOT IN ('', 'UNKNOWN') GROUP BY 1))"""


SQL["impute_value"] = f"""WITH {FO}
SELECT 'o_custkey' AS "column", 'MEDIAN' AS strategy,
  CAST(CAST(round_even(quantile_cont(CAST(o_custkey AS DOUBLE), 0.5), 0) AS BIGINT) AS VARCHAR) AS impute_value FROM fo
UNION ALL SELECT 'o_totalprice', 'MEDIAN', CAST(round_even(quantile_cont(o_totalprice, 0.5), 2) AS VARCHAR) FROM fo
UNION ALL SELECT 'o_orderpriority', 'MODE', {order_mode('fo', 'o_orderpriority')}
UNION ALL SELECT 'o_orderstatus', 'MODE', {order_mode('fo', 'o_orderstatus')}"""
SQL["remediate_dedupe"] = f"""WITH {FO} SELECT DISTINCT * FROM fo"""
SQL["remediate_quarantine"] = f"""WITH {FO} SELECT o_orderkey, o_custkey,
  CASE WHEN o_custkey IS NULL THEN 'quarantined' ELSE 'kept' END AS side FROM fo"""
SQL["remediate_impute"] = f"""WITH {FO} SELECT o_orderkey,
  CASE WHEN {KNOWN} THEN o_orderpriority ELSE {order_mode('fo', 'o_orderpriority')} END AS o_orderpriority,
  coalesce(o_totalprice, (SELECT round_even(quantile_cont(o_totalprice, 0.5), 2) FROM fo)) AS o_totalprice FROM fo"""


def fence(table: str, c: str) -> str:
    return f"""(SELECT quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo,
      quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi FROM {table})"""


SQL["remediate_outliers"] = f"""WITH {FC} SELECT c_custkey, c_acctbal,
  CASE WHEN c_acctbal < lo OR c_acctbal > hi THEN 'quarantined' ELSE 'kept' END AS side
FROM fc, {fence('fc', 'c_acctbal')}"""
SQL["remediate_restore"] = """SELECT p_partkey, p_name, p_brand, p_type, p_size, CAST(NULL AS DOUBLE) AS p_retailprice
FROM part"""
STEPS = f"""WITH {FO}, a1 AS (SELECT DISTINCT * FROM fo), a2 AS (SELECT * FROM a1 WHERE o_custkey IS NOT NULL),
a3 AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
  CASE WHEN {KNOWN} THEN o_orderpriority ELSE {order_mode('a2', 'o_orderpriority')} END AS o_orderpriority FROM a2),
a4 AS (SELECT a3.* FROM a3, {fence('a3', 'o_totalprice')} WHERE o_totalprice IS NULL OR o_totalprice BETWEEN lo AND hi)"""
SQL["remediate_all"] = f"{STEPS} SELECT * FROM a4"
SQL["action_audit"] = f"""{STEPS}, n AS (SELECT (SELECT count(*) FROM fo) AS n0, (SELECT count(*) FROM a1) AS n1,
  (SELECT count(*) FROM a2) AS n2, (SELECT count(*) FROM a3) AS n3, (SELECT count(*) FROM a4) AS n4,
  (SELECT count(*) FROM a2 WHERE trim(o_orderpriority) = '') AS filled)
SELECT 1 AS step, 'DEDUPLICATE_ROWS' AS action_type, 'ALL_ROWS' AS target, n0 - n1 AS rows_affected, n0 AS before_count,
  n1 AS after_count, 'SUCCESS' AS execution_status FROM n UNION ALL
SELECT 2, 'QUARANTINE_NULL_RECORDS', 'o_custkey', n1 - n2, n1, n2, 'SUCCESS' FROM n UNION ALL
SELECT 3, 'IMPUTE_DEFAULT_VALUE', 'o_orderpriority', filled, n2, n3, 'SUCCESS' FROM n UNION ALL
SELECT 4, 'QUARANTINE_ML_OUTLIERS', 'o_totalprice', n3 - n4, n3, n4, 'SUCCESS' FROM n"""
SQL["remediate_text_key"] = f"""WITH {FO}, tk AS (SELECT DISTINCT 'ORD-' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS order_key,
  o_orderpriority, o_totalprice FROM fo)
SELECT order_key, CASE WHEN {KNOWN} THEN o_orderpriority ELSE (SELECT arg_min(t, (-c, f)) FROM (
    SELECT trim(o_orderpriority) AS t, count(*) AS c, min(order_key) AS f FROM tk WHERE {KNOWN} GROUP BY 1)) END
  AS o_orderpriority, o_totalprice, CAST(NULL AS DOUBLE) AS o_note FROM tk"""
OUT_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount")
SQL["remediate_two_outliers"] = f"WITH {FL}, o0 AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, " + ", ".join(
    OUT_COLUMNS) + " FROM fl)" + "".join(
    f", o{i + 1} AS (SELECT o{i}.* FROM o{i}, {fence(f'o{i}', c)} WHERE {c} IS NULL OR {c} BETWEEN lo AND hi)"
    for i, c in enumerate(OUT_COLUMNS)) + " SELECT * FROM o3"
SQL["remediate_quarantine_log"] = f"""{STEPS},
q AS (SELECT 1 AS step, 'DEDUPLICATE_ROWS' AS action_type, 'ALL_ROWS' AS target, (SELECT count(*) FROM fo) - (SELECT count(*) FROM a1) AS n,
    (SELECT sum(o_orderkey) FROM fo) - (SELECT sum(o_orderkey) FROM a1) AS k
  UNION ALL SELECT 2, 'QUARANTINE_NULL_RECORDS', 'o_custkey', count(*), sum(o_orderkey) FROM a1 WHERE o_custkey IS NULL
  UNION ALL SELECT 4, 'QUARANTINE_ML_OUTLIERS', 'o_totalprice', (SELECT count(*) FROM a3) - (SELECT count(*) FROM a4),
    (SELECT sum(o_orderkey) FROM a3) - (SELECT sum(o_orderkey) FROM a4))
SELECT step, action_type, target, n AS rows_affected, nullif(n, 0) AS rows_aside, CAST(k AS BIGINT) AS key_sum FROM q
UNION ALL SELECT 3, 'IMPUTE_DEFAULT_VALUE', 'o_orderpriority', (SELECT count(*) FROM a2 WHERE trim(o_orderpriority) = ''), NULL, NULL"""
SQL["verify_recovery"] = f"""WITH {FO}, b AS (SELECT
  (SELECT count(*) FROM ({missing_values('fo', ORDER_COLUMNS, 'o_orderkey')})) +
  (SELECT count(*) FROM ({duplicates('fo', ', '.join(ORDER_COLUMNS))})) AS n0, (SELECT count(*) FROM fo) AS r0),
fx AS (SELECT DISTINCT * REPLACE ('x' AS o_orderpriority) FROM fo),
a AS (SELECT count(*) AS n1, count(*) FILTER (WHERE severity IN ('HIGH', 'CRITICAL')) AS severe
      FROM ({missing_values('fx', ORDER_COLUMNS, 'o_orderkey')})), r AS (SELECT count(*) AS r1 FROM fx)
SELECT CASE WHEN n1 = 0 THEN 'PASS' WHEN severe = 0 AND n1 < n0 THEN 'PARTIAL_PASS' ELSE 'FAIL' END AS verdict,
  n0 AS before_finding_count, n1 AS after_finding_count, greatest(0, n0 - n1) AS resolved_finding_count,
  round(greatest(0, n0 - n1) / n0 * 100, 2) AS anomaly_reduction_rate_pct, r0 AS original_row_count,
  r1 AS remediated_row_count, r1 - r0 AS row_delta FROM a, b, r"""

_AFTER = at(ORDER_NUMBERS, ORDER_COLUMNS)
SQL["recovery_log"] = f"""WITH {FO}, {measures('o', 'fo', _AFTER)},
b1 AS (SELECT * FROM fo WHERE o_custkey IS NOT NULL),
b3 AS (SELECT o_orderkey, o_custkey, o_orderstatus,
  coalesce(o_totalprice, (SELECT round_even(quantile_cont(o_totalprice, 0.5), 2) FROM fo)) AS o_totalprice, o_orderdate,
  CASE WHEN {KNOWN} THEN o_orderpriority ELSE {order_mode('fo', 'o_orderpriority')} END AS o_orderpriority FROM b1),
b4 AS (SELECT DISTINCT * FROM b3),
b5 AS (SELECT b4.* FROM b4, {fence('b4', 'o_totalprice')}
  WHERE o_totalprice BETWEEN lo AND hi OR NOT EXISTS (SELECT 1 FROM o_f WHERE "column" = 'o_totalprice')),
{measures('p', 'b5', _AFTER)},
bf AS (SELECT (SELECT count(*) FROM ({missing_values('fo', ORDER_COLUMNS, 'o_orderkey')})) +
  (SELECT count(*) FROM ({duplicates('fo', ', '.join(ORDER_COLUMNS))})) + (SELECT count(*) FROM o_f) AS n0),
af AS (SELECT count(*) AS n1, count(*) FILTER (WHERE severity IN ('HIGH', 'CRITICAL')) AS severe FROM (
  SELECT severity FROM ({missing_values('b5', ORDER_COLUMNS, 'o_orderkey')}) UNION ALL
  SELECT severity FROM ({duplicates('b5', ', '.join(ORDER_COLUMNS))}) UNION ALL SELECT severity FROM p_f)),
rc AS (SELECT (SELECT count(*) FROM fo) AS r0, (SELECT count(*) FROM b5) AS r1)
SELECT CASE WHEN n1 = 0 THEN 'PASS' WHEN severe = 0 AND n1 < n0 THEN 'PARTIAL_PASS' ELSE 'FAIL' END AS verdict,
  n0 AS before_finding_count, n1 AS after_finding_count, greatest(0, n0 - n1) AS resolved_finding_count,
  round(greatest(0, n0 - n1) / n0 * 100, 2) AS anomaly_reduction_rate_pct, r0 AS original_row_count,
  r1 AS remediated_row_count, r1 - r0 AS row_delta, 'orders' AS dataset_path FROM bf, af, rc"""

# --- history ------------------------------------------------------------------------------------------------------------

SQL["latest_audit"] = f"""{INSPECTIONS} SELECT inspection_id, dataset_path, status, highest_severity, row_count, finding_count
FROM ins ORDER BY created_at DESC, inspection_id LIMIT 1"""
SQL["recent_audits"] = f"""{INSPECTIONS} SELECT inspection_id, dataset_path, split_part(dataset_path, '/', -1) AS friendly_name,
  status, highest_severity, row_count, finding_count FROM ins ORDER BY created_at DESC, inspection_id LIMIT 20"""
HEALTH = """CAST(greatest(0, least(100, 100 - coalesce(sum(CASE severity WHEN 'CRITICAL' THEN 20 WHEN 'HIGH' THEN 10
  WHEN 'MEDIUM' THEN 3 WHEN 'LOW' THEN 1 ELSE 0 END), 0))) AS BIGINT)"""
HEALTH_STATUS = """CASE WHEN health_index >= 85 THEN 'OPTIMAL' WHEN health_index >= 60 THEN 'DEGRADED'
  ELSE 'CRITICAL_ATTENTION' END AS health_status"""
SQL["health_index"] = f"""{INSPECTIONS}, la AS (SELECT inspection_id FROM ins ORDER BY created_at DESC, inspection_id LIMIT 1),
ix AS (SELECT {HEALTH} AS health_index FROM rf WHERE run_id = (SELECT inspection_id FROM la))
SELECT health_index, {HEALTH_STATUS} FROM ix"""
SQL["health_by_audit"] = f"""{INSPECTIONS},
ix AS (SELECT inspection_id, {HEALTH} AS health_index FROM ins LEFT JOIN rf ON inspection_id = run_id GROUP BY inspection_id)
SELECT inspection_id, health_index, {HEALTH_STATUS} FROM ix"""
SQL["dashboard_totals"] = f"""{INSPECTIONS} SELECT count(*) AS total_findings,
  count(*) FILTER (WHERE severity = 'CRITICAL') AS critical_findings,
  count(*) FILTER (WHERE severity = 'HIGH') AS high_findings, count(*) FILTER (WHERE severity = 'MEDIUM') AS medium_findings,
  count(*) FILTER (WHERE severity = 'LOW') AS low_findings, (SELECT count(*) FROM ins) AS total_inspections,
  (SELECT count(*) FROM runs) AS total_etl_runs FROM rf"""
SQL["audit_dossier"] = f"""{INSPECTIONS}, la AS (
  (SELECT * FROM ins ORDER BY created_at DESC, inspection_id LIMIT 1) UNION ALL
  (SELECT * FROM ins WHERE finding_count > 0 ORDER BY created_at DESC, inspection_id LIMIT 1))
SELECT inspection_id, dataset_path, status, highest_severity, row_count, metric_order AS position, finding_type, severity,
  finding_type || ' detected. The ' || metric || ' metric deviates significantly from historical behaviour.' AS message
FROM la LEFT JOIN rf ON la.inspection_id = rf.run_id"""

# --- streams ------------------------------------------------------------------------------------------------------------

EVENT_COLUMNS = ("event_id", "ts", "user_id", "event_type", "value", "props")
SQL["stream_audit"] = f"""WITH fv AS (SELECT * REPLACE (CASE WHEN event_id % 5 = 0 THEN NULL ELSE user_id END AS user_id) FROM events),
{measures('o', 'fv', [(4, 'value')])}, {ks('k', long_form('fv', [(4, 'value')]), long_form('events', [(4, 'value')]))}
SELECT 1 AS stage, position AS ordinal, 'MISSING_VALUES' AS finding_type, "column" AS column_name, severity,
  'Column ''' || "column" || ''' contains ' || missing_count || ' missing value(s).' AS message, missing_count AS affected_count,
  missing_percentage AS affected_pct, CAST(NULL AS VARCHAR) AS expected_type, CAST(NULL AS VARCHAR) AS actual_type,
  CAST(json_object('column', "column", 'missing_count', missing_count, 'missing_percentage', missing_percentage,
    'total_rows', total_rows) AS VARCHAR) AS evidence, 0 AS batch_id
FROM ({missing_values('fv', EVENT_COLUMNS, 'event_id')}) UNION ALL
SELECT 2, 1, 'DUPLICATE_RECORDS', NULL, severity, 'Detected ' || duplicate_count || ' duplicate record(s).', duplicate_count,
  duplicate_percentage, NULL, NULL, CAST(json_object('duplicate_count', duplicate_count, 'duplicate_percentage',
    duplicate_percentage, 'total_rows', total_rows) AS VARCHAR), 0
FROM ({duplicates('fv', ', '.join(EVENT_COLUMNS))}) UNION ALL
SELECT 6, ordinal + 1, 'NUMERICAL_OUTLIERS', "column", severity, message, iqr_count, pct, NULL, NULL,
  CAST(json_object('column', "column", 'outlier_count', iqr_count, 'outlier_percentage', pct, 'total_valid', n,
    'lower_fence', round(lower_fence, 4), 'upper_fence', round(upper_fence, 4), 'mean', round(mean, 4), 'std', round(std, 4),
    'skewness', round(skewness, 4), 'max_z_score', round(max_z, 2)) AS VARCHAR), 0
FROM o_f UNION ALL
SELECT 8, ordinal + 1, 'DISTRIBUTION_DRIFT', "column", severity, message, NULL, NULL, NULL, NULL, NULL, 0 FROM k_d WHERE is_drift"""
_ARRIVED = """WITH fe AS (SELECT * REPLACE (CASE WHEN event_id % 5 = 0 THEN NULL ELSE user_id END AS user_id) FROM events),
fv AS (SELECT * FROM fe UNION ALL SELECT * FROM fe WHERE event_id % 8 = 0)"""
SQL["stream_memory_findings"] = f"""{_ARRIVED}
SELECT 1 AS stage, position AS ordinal, 'MISSING_VALUES' AS finding_type, "column" AS column_name, severity,
  'Column ''' || "column" || ''' contains ' || missing_count || ' missing value(s).' AS message, missing_count AS affected_count,
  missing_percentage AS affected_pct, CAST(NULL AS VARCHAR) AS expected_type, CAST(NULL AS VARCHAR) AS actual_type,
  CAST(json_object('column', "column", 'missing_count', missing_count, 'missing_percentage', missing_percentage,
    'total_rows', total_rows) AS VARCHAR) AS evidence
FROM ({missing_values('fv', EVENT_COLUMNS, 'event_id')}) UNION ALL
SELECT 2, 1, 'DUPLICATE_RECORDS', NULL, severity, 'Detected ' || duplicate_count || ' duplicate record(s).', duplicate_count,
  duplicate_percentage, NULL, NULL, CAST(json_object('duplicate_count', duplicate_count, 'duplicate_percentage',
    duplicate_percentage, 'total_rows', total_rows) AS VARCHAR)
FROM ({duplicates('fv', ', '.join(EVENT_COLUMNS))})"""
SQL["stream_memory_profile"] = f"""{_ARRIVED}
SELECT 'value' AS "column", count(value) AS n, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std,
  round(min(value), 4) AS min, round(max(value), 4) AS max FROM fv"""
SQL["stream_runs"] = """SELECT event_type AS pipeline_id, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS rows_input,
  count(*) FILTER (WHERE value < 100) AS rows_output,
  round(date_diff('microsecond', min(ts), max(ts)) / 1000.0, 3) AS duration_ms
FROM events GROUP BY event_type, date_trunc('day', ts)"""

# --- faults -------------------------------------------------------------------------------------------------------------

SQL["inject_missing"] = """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS o_custkey
FROM orders"""
SQL["inject_duplicates"] = """SELECT o_orderkey, o_totalprice FROM orders UNION ALL
SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey < 25"""
SQL["inject_schema_drift"] = "SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part"
SQL["inject_outliers"] = """SELECT c_custkey, CASE WHEN c_custkey < 5 THEN CAST(999999.99 AS DOUBLE) ELSE c_acctbal END
  AS c_acctbal FROM customer"""
SQL["inject_all"] = f"WITH {FO} SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM fo"
