"""Registered queries of the engine and their oracle SQL.

The log queries run over the events table in the shape of a logs table; the
relational ones over the TPC-H-like tables. Columns have the same names on
both sides and doubles are rounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.functions import udfs
from tributary.functions.scratch import shared_folder
from tributary.functions.template import id_column, template_column
from tributary.model import Promotion
from tributary.operators import breakdown, investigate, records, stats
from tributary.operators.investigate import redact
from tributary.plans import relational
from tributary.plans.adapters import logs_from_events
from tributary.plans.session import Logs
from tributary.plans.sql import run_sql
from tributary.sources.lines import parse_column
from tributary.streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: DuckDB: the events table as logs.
LOGS_SQL = """
SELECT event_id AS seq, CASE WHEN event_id % 50 <> 0 THEN ts END AS ts, (event_id % 7 <> 0) AS ts_zoned,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warn' WHEN 'signup' THEN 'audit' WHEN 'view' THEN NULL ELSE 'info' END AS level,
  event_type || ' by user ' || CAST(user_id AS VARCHAR) AS message, 'svc-' || CAST(user_id % 4 AS VARCHAR) AS source,
  'logs/svc-' || CAST(user_id % 4 AS VARCHAR) || '.log' AS file, 'jsonl' AS format, event_id + 1 AS line_no, (event_id % 97 <> 0) AS parsed,
  props AS raw, props AS fields, json_extract_string(props, '$.k') AS k, event_type || ' by user <num>' AS pattern,
  left(sha256(event_type || ' by user <num>'), 12) AS pattern_id, user_id, value, event_type FROM events"""


#: Typed columns of the events table, as promoted fields.
EVENT_COLUMNS = (Promotion("event_type", "event_type", "string", 1.0), Promotion("user_id", "user_id", "integer", 1.0), Promotion("value", "value", "float", 1.0))


def logs(spark: SparkSession, sf_dir: str, templates: bool = False) -> Logs:
    return Logs(logs_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"), templates), EVENT_COLUMNS)


def _logs_query(name: str, make: Callable[[Logs], DataFrame], sql: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: make(logs(spark, sf_dir))
    if sql:
        ORACLE_SQL[name] = f"WITH logs AS ({LOGS_SQL}) {sql}"


def _filter(name: str, text: str, where: str) -> None:
    _logs_query(f"filter_{name}", lambda x: x.matching(x.plan(text)).select("seq", "level", "message", "source"), f"SELECT seq, level, message, source FROM logs WHERE {where}")


_filter("all", "", "TRUE")
_filter("level_eq", "level:error", "level = 'error'")
_filter("level_in", "level:warn,ERR", "level IN ('warn', 'error')")
_filter("level_ordinal", "level:>=warn", "level IN ('warn', 'error', 'fatal')")
_filter("level_below", "level:<warn", "level IN ('trace', 'debug', 'info')")
_filter("level_unknown", "level:audit", "level = 'audit'")
_filter("negated", "-level:info", "NOT coalesce(level = 'info', FALSE)")
_filter("exists", "ts:*", "ts IS NOT NULL")
_filter("absent", "level:none", "level IS NULL")
_filter("bag_numeric", "k:>=50", "TRY_CAST(k AS DOUBLE) >= 50")
_filter("bag_less", "k:<10 -k:3", "TRY_CAST(k AS DOUBLE) < 10 AND NOT coalesce(k = '3', FALSE)")
_filter("bag_eq", "k:7", "k = '7'")
_filter("value_list", "k:1,2,3", "k IN ('1', '2', '3')")
_filter("text_order", 'message:>"purchase by user 5"', "message > 'purchase by user 5'")
_filter("typed_number", "user_id:>=100 user_id:<=200", "user_id BETWEEN 100 AND 200")
_filter("typed_misfit", "user_id:abc,7", "user_id = 7")
_filter("free_text", "error", "message ILIKE '%error%' OR fields ILIKE '%error%' OR raw ILIKE '%error%'")
_filter("free_text_phrase", '"by user 12" -purchase', "(message LIKE '%by user 12%' OR raw LIKE '%by user 12%') AND NOT message LIKE '%purchase%'")
_filter("smart_case_low", "message~ERROR,click", "message LIKE '%ERROR%' OR message ILIKE '%click%'")
_filter("regex", r"message~/user 1\d$/", r"regexp_matches(message, 'user 1\d$')")
_filter("regex_negated", r"-message~/user \d+5$/", r"NOT coalesce(regexp_matches(message, 'user \d+5$'), FALSE)")
_filter("source_prefix", "source:svc-1", "source = 'svc-1'")
_filter("file_base", "file:svc-1.log", "file = 'svc-1.log' OR file LIKE '%/svc-1.log'")
_filter("file_glob", "file:svc-[!0-2]*", "file GLOB 'svc-[!0-2]*' OR file GLOB '*/svc-[!0-2]*'")
_filter("unparsed", "parsed:false", "NOT parsed")
_filter("time_between", 'between:"2024-01-05T06:00:00Z - 2024-01-06T12:00:00Z"', "ts >= TIMESTAMP '2024-01-05 06:00:00' AND ts < TIMESTAMP '2024-01-06 12:00:00'")
_filter("time_after", "after:2024-01-20 level:error", "ts >= TIMESTAMP '2024-01-20' AND level = 'error'")
_filter("time_on", "on:2024-01-07", "ts >= TIMESTAMP '2024-01-07' AND ts < TIMESTAMP '2024-01-08'")
_filter("time_last", "last:3d", "ts >= (SELECT max(ts) FROM logs) - INTERVAL 3 DAY AND ts <= (SELECT max(ts) FROM logs)")
_filter("time_excluded", "-on:2024-01-07 -on:2024-01-09", "NOT coalesce(ts >= TIMESTAMP '2024-01-07' AND ts < TIMESTAMP '2024-01-08', FALSE) AND NOT coalesce(ts >= TIMESTAMP '2024-01-09' AND ts < TIMESTAMP '2024-01-10', FALSE)")
_filter("time_intersect", "after:2024-01-10 before:2024-01-11", "ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12'")


def _reworded(name: str, text: str, words: list[tuple[str, str]], where: str) -> None:
    """A filter over messages with other words."""

    def run(x: Logs) -> DataFrame:
        message, sql = F.col("message"), "message"
        for old, new in words:
            message = F.replace(message, F.lit(old), F.lit(new))
        other = Logs(x.table.withColumn("message", message), x.promotions)
        return other.matching(other.plan(text)).select("seq", "message")

    message = "message"
    for old, new in words:
        message = f"replace({message}, '{old}', '{new}')"
    _logs_query(f"filter_{name}", run, f", m AS (SELECT seq, {message} AS message FROM logs) SELECT seq, message FROM m WHERE {where}")


_reworded("smart_case", 'message~"by User 1",cLICK', [("user", "User")], "message LIKE '%by User 1%'")
_reworded("literal_not_regex", 'message~"u.1"', [("click by user ", "click by u."), (" user ", " u-")], "message LIKE '%u.1%'")
_reworded("path_glob_text", '"/API/Orders"', [("click by user ", "GET /API/Orders/")], "message LIKE '%/API/Orders%'")


def _pattern_filter(x: Logs) -> DataFrame:
    known = x.table.select("pattern_id").distinct().orderBy("pattern_id").first()["pattern_id"]
    return x.matching(x.plan(f"pattern:{known[:7]}")).select("seq", "pattern_id")


_logs_query("filter_pattern_prefix", _pattern_filter, "SELECT seq, pattern_id FROM logs WHERE pattern_id = (SELECT min(pattern_id) FROM logs)")

_PAGE = ("seq", "ts", "level", "source", "message")
_logs_query("records_oldest", lambda x: records.records(x, x.plan("level:error"), 100, 20, columns=_PAGE), "SELECT seq, ts, level, source, message FROM logs WHERE level = 'error' ORDER BY ts NULLS LAST, seq LIMIT 100 OFFSET 20")
_logs_query("records_newest", lambda x: records.records(x, x.plan(""), 200, newest=True, columns=_PAGE), "SELECT seq, ts, level, source, message FROM logs ORDER BY ts DESC NULLS LAST, seq DESC LIMIT 200")
_logs_query("count", lambda x: records.count(x, x.plan("k:>=50 level:*")), "SELECT count(*) AS n FROM logs WHERE TRY_CAST(k AS DOUBLE) >= 50 AND level IS NOT NULL")
_logs_query(
    "context",
    lambda x: records.context(x, x.plan("k:99"), 2, columns=("ts", "message")),
    "SELECT l.seq, l.file, coalesce(l.k = '99', FALSE) AS hit, l.ts, l.message FROM logs l WHERE EXISTS (SELECT 1 FROM logs h WHERE h.k = '99' AND h.file = l.file AND h.seq BETWEEN l.seq - 2 AND l.seq + 2)",
)
_logs_query(
    "fold",
    lambda x: records.fold(x, x.plan("")),
    """, r AS (SELECT *, row_number() OVER (ORDER BY ts NULLS LAST, seq) AS rn FROM logs),
    g AS (SELECT *, rn - row_number() OVER (PARTITION BY pattern_id ORDER BY rn) AS run FROM r)
    SELECT count(*) AS repeats, arg_min_null(ts, rn) AS ts, arg_min_null(level, rn) AS level, arg_min_null(source, rn) AS source, arg_min_null(message, rn) AS message FROM g GROUP BY pattern_id, run""",
)


def _stats(name: str, text: str, names: tuple[str, ...], sql: str) -> None:
    def run(x: Logs) -> DataFrame:
        out = stats.stats(x, x.plan(text, aggregate=True), names)
        return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])

    _logs_query(f"stats_{name}", run, sql)


_stats("global", "level:error stats count(), count_distinct(k), avg(value)", ("n", "kinds", "avg_value"), "SELECT count(*) AS n, count(DISTINCT k) AS kinds, round(avg(value), 6) AS avg_value FROM logs WHERE level = 'error'")
_stats("empty", "level:fatal stats count(), sum(value)", ("n", "total"), "SELECT count(*) AS n, round(sum(value), 6) AS total FROM logs WHERE level = 'fatal'")
_stats("by_level", "stats count(), count(ts) by level", ("level", "n", "dated"), "SELECT level, count(*) AS n, count(ts) AS dated FROM logs WHERE level IS NOT NULL GROUP BY level")
_stats("by_two", "stats count(), max(k) by source, level", ("source", "level", "n", "most"), "SELECT source, level, count(*) AS n, max(TRY_CAST(k AS DOUBLE)) AS most FROM logs WHERE level IS NOT NULL GROUP BY source, level")
_stats("sum_min_max", "stats sum(value), min(value), max(value), avg(k) by event_type", ("event_type", "total", "least", "most", "mean_k"), "SELECT event_type, round(sum(value), 6) AS total, round(min(value), 6) AS least, round(max(value), 6) AS most, round(avg(TRY_CAST(k AS DOUBLE)), 6) AS mean_k FROM logs GROUP BY event_type")
_stats("quantiles", "stats p50(value), p95(value), p99(k) by source", ("source", "p50", "p95", "p99_k"), "SELECT source, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(TRY_CAST(k AS DOUBLE), 0.99), 6) AS p99_k FROM logs GROUP BY source")
_BIN = "time_bucket(INTERVAL {}, ts, (SELECT date_trunc('day', min(ts)) FROM logs))"
_stats("bin_hour", "stats count(), avg(value) by bin(1h)", ("bin", "n", "avg_value"), f"SELECT {_BIN.format('1 HOUR')} AS bin, count(*) AS n, round(avg(value), 6) AS avg_value FROM logs WHERE ts IS NOT NULL GROUP BY 1")
_stats("bin_day_level", "stats count() by bin(1d), level", ("bin", "level", "n"), f"SELECT {_BIN.format('1 DAY')} AS bin, level, count(*) AS n FROM logs WHERE ts IS NOT NULL AND level IS NOT NULL GROUP BY 1, 2")
_stats("bin_odd", "after:2024-01-03T10:17:00Z stats count() by bin(7m)", ("bin", "n"), "SELECT time_bucket(INTERVAL 7 MINUTE, ts, TIMESTAMP '2024-01-03') AS bin, count(*) AS n FROM logs WHERE ts >= TIMESTAMP '2024-01-03 10:17:00' GROUP BY 1")
_logs_query(
    "stats_population",
    lambda x: stats.population(x, x.plan("k:>=20 stats count() by level, bin(1h)", aggregate=True)).toDF("matched", "grouped", "no_timestamp", "absent_level", "absent_bin", "empty_bins"),
    f""", m AS (SELECT *, {_BIN.format('1 HOUR')} AS b FROM logs WHERE TRY_CAST(k AS DOUBLE) >= 20), g AS (SELECT * FROM m WHERE level IS NOT NULL AND b IS NOT NULL)
    SELECT count(*) AS matched, count(*) FILTER (level IS NOT NULL AND b IS NOT NULL) AS grouped, count(*) FILTER (ts IS NULL) AS no_timestamp, count(*) FILTER (level IS NULL) AS absent_level,
    count(*) FILTER (b IS NULL) AS absent_bin, (SELECT date_diff('hour', min(b), max(b)) + 1 - count(DISTINCT b) FROM g) AS empty_bins FROM m""",
)
_logs_query(
    "histogram",
    lambda x: breakdown.histogram(x, x.plan('between:"2024-01-02T00:00:00Z - 2024-01-04T00:00:00Z"'), 60),
    """, w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS bucket, coalesce(level, 'none') AS level FROM logs WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-04')
    SELECT bucket, level, count(n) AS n FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-03 23:00:00', INTERVAL 1 HOUR)) AS bucket) CROSS JOIN (SELECT DISTINCT level FROM w)
    LEFT JOIN (SELECT bucket, level, 1 AS n FROM w) USING (bucket, level) GROUP BY bucket, level""",
)

_HISTOGRAM = """, w AS (SELECT time_bucket(INTERVAL {step}, ts, TIMESTAMP '1970-01-01') AS bucket, coalesce(level, 'none') AS level FROM logs WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '{end}')
    SELECT bucket, level, count(n) AS n FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '{end}' - INTERVAL 1 SECOND, INTERVAL {step})) AS bucket) CROSS JOIN (SELECT DISTINCT level FROM w)
    LEFT JOIN (SELECT bucket, level, 1 AS n FROM w) USING (bucket, level) GROUP BY bucket, level"""
for _name, _end, _step in (("wide", "2024-01-06 04:00:00", "2 HOUR"), ("week", "2024-01-09 00:00:00", "3 HOUR"), ("month", "2024-01-25 00:00:00", "12 HOUR"), ("short", "2024-01-02 00:50:00", "1 MINUTE")):
    _logs_query(f"histogram_{_name}", lambda x, end=_end: breakdown.histogram(x, x.plan(f'between:"2024-01-02T00:00:00Z - {end.replace(" ", "T")}Z"'), 60), _HISTOGRAM.format(step=_step, end=_end))


def _positions(make: Callable[[Logs], DataFrame]) -> Callable[[Logs], DataFrame]:
    """The result with each row's place in it, so that the order is compared; results of a report's size only."""

    def run(x: Logs) -> DataFrame:
        out = make(x)
        rows = [(*r, n) for n, r in enumerate(out.collect())]
        return out.sparkSession.createDataFrame(rows, T.StructType([*out.schema.fields, T.StructField("place", T.LongType())]))

    return run


_logs_query("order_stats", _positions(lambda x: stats.stats(x, x.plan("stats count() by source, level", aggregate=True), ("source", "level", "n"))), "SELECT *, row_number() OVER (ORDER BY n DESC, source, level) - 1 AS place FROM (SELECT source, level, count(*) AS n FROM logs WHERE level IS NOT NULL GROUP BY source, level)")
_logs_query("order_stats_bin", _positions(lambda x: stats.stats(x, x.plan("stats count() by bin(1d), source", aggregate=True), ("bin", "source", "n"))), f"SELECT *, row_number() OVER (ORDER BY bin, source) - 1 AS place FROM (SELECT {_BIN.format('1 DAY')} AS bin, source, count(*) AS n FROM logs WHERE ts IS NOT NULL GROUP BY 1, 2)")
_logs_query("order_top", _positions(lambda x: breakdown.top(x, x.plan(""), "k", 25).select("value", "n")), "SELECT k AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, k) - 1 AS place FROM logs WHERE k IS NOT NULL GROUP BY k ORDER BY n DESC, k LIMIT 25")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_logs_query("top_field", lambda x: _rounded(breakdown.top(x, x.plan("level:*"), "k", -1)), "SELECT k AS value, count(*) AS n, round(count(*) / (SELECT count(k) FROM logs WHERE level IS NOT NULL), 6) AS share FROM logs WHERE level IS NOT NULL AND k IS NOT NULL GROUP BY k")
_logs_query("top_regex", lambda x: _rounded(breakdown.top(x, x.plan(""), r"message~/user (\d)\d*$/", -1)), r", m AS (SELECT nullif(regexp_extract(message, 'user (\d)\d*$', 1), '') AS value FROM logs) SELECT value, count(*) AS n, round(count(*) / (SELECT count(value) FROM m), 6) AS share FROM m WHERE value IS NOT NULL GROUP BY value")
_logs_query("top_totals", lambda x: breakdown.top_totals(x, x.plan("k:<50"), "level"), "SELECT count(*) AS matched, count(level) AS present, count(*) - count(level) AS absent, count(DISTINCT level) AS distinct FROM logs WHERE TRY_CAST(k AS DOUBLE) < 50")


def _fields(x: Logs) -> DataFrame:
    out = breakdown.fields(x, x.plan("source:svc-1"), -1).where("field IN ('level', 'message', 'k', 'source', 'line_no', 'ts', 'parsed')")
    return out.select("field", "place", "records", F.round("coverage", 6).alias("coverage"), "distinct", F.when(F.col("field") != "parsed", F.col("numeric")).alias("numeric"), F.element_at("examples", 1).alias("example"))


_FIELD = "SELECT '{0}' AS field, '{1}' AS place, count({2}) AS records, round(count({2}) / count(*), 6) AS coverage, count(DISTINCT {2}) AS distinct, {3} AS numeric, (SELECT v FROM (SELECT CAST({2} AS VARCHAR) AS v, count(*) AS n FROM m WHERE {2} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 1)) AS example FROM m"
_logs_query("fields", _fields, ", m AS (SELECT * FROM logs WHERE source = 'svc-1') " + " UNION ALL ".join(_FIELD.format(f, "bag" if f == "k" else "column", f, {"parsed": "NULL", "ts": "0"}.get(f, f"count(TRY_CAST({f} AS DOUBLE))")) for f in ("level", "message", "k", "source", "line_no", "parsed", "ts")))
_logs_query(
    "patterns",
    lambda x: breakdown.patterns(x, x.plan("k:<80"), -1).withColumn("sources", F.array_join("sources", ",")).drop("before"),
    """SELECT pattern_id, min(pattern) AS pattern, count(*) AS n, min(ts) AS first, max(ts) AS last, count(*) FILTER (ts IS NULL) AS undated, count(*) FILTER (NOT parsed) AS unparsed, min(message) AS example,
    string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM logs WHERE TRY_CAST(k AS DOUBLE) < 80 GROUP BY pattern_id""",
)


def _new_patterns(x: Logs) -> DataFrame:
    """Templates that keep the user, of which some are new in the last 24 days."""
    table = x.table.withColumn("pattern", F.col("message")).withColumn("pattern_id", id_column(F.col("message")))
    other = Logs(table, x.promotions)
    return breakdown.patterns(other, other.plan(""), -1, "24d").select("pattern", "n", "undated")


_logs_query("patterns_new_since", _new_patterns, "SELECT message AS pattern, count(*) AS n, count(*) FILTER (ts IS NULL) AS undated FROM logs GROUP BY message HAVING count(*) FILTER (ts < (SELECT max(ts) FROM logs) - INTERVAL 24 DAY) = 0 AND count(ts) > 0")
_logs_query("pattern_totals", lambda x: breakdown.pattern_totals(x, x.plan("")), "SELECT count(*) AS records, count(DISTINCT pattern_id) AS templates, count(*) FILTER (NOT parsed) AS unparsed_records, count(DISTINCT pattern_id) FILTER (NOT parsed) AS unparsed_templates FROM logs")


def _templated(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = logs(spark, sf_dir, templates=True)
    return x.table.groupBy("pattern_id", "pattern").agg(F.count(F.lit(1)).alias("n"))


QUERIES["template_messages"] = _templated
ORACLE_SQL["template_messages"] = f"WITH logs AS ({LOGS_SQL}), t AS (SELECT regexp_replace(message, '[0-9]+', '<num>', 'g') AS pattern FROM logs) SELECT left(sha256(pattern), 12) AS pattern_id, pattern, count(*) AS n FROM t GROUP BY pattern"
_HOPS = ", h AS (SELECT *, CASE WHEN ts IS NOT NULL THEN date_diff('microsecond', lag(ts) OVER (PARTITION BY ts IS NULL ORDER BY ts, seq), ts) END AS gap_us FROM logs WHERE user_id = 42 OR message LIKE '%42%' OR raw LIKE '%42%')"
_logs_query("trace_hops", lambda x: investigate.trace(x, x.plan(""), "42", "user_id"), _HOPS + " SELECT seq, ts, source, level, message, user_id <> 42 AS text_only, gap_us FROM h")
_logs_query("trace_summary", lambda x: investigate.trace_summary(investigate.trace(x, x.plan(""), "42", "user_id")), _HOPS + " SELECT count(*) AS hops, date_diff('microsecond', min(ts), max(ts)) AS span_us, count(*) FILTER (ts IS NULL) AS undated, count(*) FILTER (user_id <> 42) AS text_only, (SELECT seq FROM h WHERE gap_us IS NOT NULL ORDER BY gap_us DESC, seq LIMIT 1) AS slowest_seq, max(gap_us) AS slowest_gap_us FROM h")
_logs_query("trace_reach", lambda x: investigate.trace_reach(x, x.plan(""), "977", "user_id"), ", g AS (SELECT source, count(*) AS records, count(*) FILTER (user_id = 977 OR message LIKE '%977%' OR raw LIKE '%977%') AS hits, count(user_id) AS carriers FROM logs GROUP BY source) SELECT *, CASE WHEN hits > 0 THEN 'present' WHEN carriers > 0 THEN 'silent' ELSE 'blind' END AS reach FROM g")

_BEFORE, _AFTER = ("after:2024-01-02T00:00:00Z before:2024-01-09T00:00:00Z", "after:2024-01-15T00:00:00Z before:2024-01-20T00:00:00Z")
_WINDOWS = ", w AS (SELECT *, ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-09' AS b, ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-20' AS a FROM logs WHERE ts IS NOT NULL), s AS (SELECT count(*) FILTER (b) AS nb, count(*) FILTER (a) AS na FROM w)"
_ITEMS = """, l AS (SELECT 'pattern' AS kind, 'pattern_id' AS name, pattern_id AS value, a, b FROM w UNION ALL SELECT 'value', 'k', k, a, b FROM w WHERE k IS NOT NULL UNION ALL SELECT 'value', 'level', level, a, b FROM w WHERE level IS NOT NULL UNION ALL SELECT 'value', 'source', source, a, b FROM w),
 i AS (SELECT kind, name, value, count(*) FILTER (b) AS before, count(*) FILTER (a) AS after FROM l WHERE a OR b GROUP BY kind, name, value UNION ALL SELECT 'field', name, NULL, count(*) FILTER (b), count(*) FILTER (a) FROM l WHERE kind = 'value' AND (a OR b) GROUP BY name)"""
_logs_query("diff_items", lambda x: investigate.diff_items(x, x.plan(_BEFORE), x.plan(_AFTER)), _WINDOWS + _ITEMS + " SELECT * FROM i")
_G = "CASE WHEN {0} > 0 THEN {0} * ln({0} / ((before + after) * {1} / (nb + na))) ELSE 0 END"
_logs_query(
    "diff_surprise",
    lambda x: _rounded(investigate.diff(x, x.plan(_BEFORE), x.plan(_AFTER), -1)),
    _WINDOWS + _ITEMS + f", g AS (SELECT i.*, round(2 * ({_G.format('before', 'nb')} + {_G.format('after', 'na')}), 9) AS surprise FROM i, s) SELECT kind, name, value, before, after, CASE WHEN before = 0 THEN 'appeared' WHEN after = 0 THEN 'vanished' ELSE 'shifted' END AS change, round(surprise, 6) AS surprise, round(before / 604800.0, 6) AS before_rate, round(after / 432000.0, 6) AS after_rate FROM g WHERE surprise > 0",
)
_logs_query("diff_sizes", lambda x: investigate.window_sizes(x, x.plan(_BEFORE), x.plan(_AFTER)), _WINDOWS + " SELECT nb AS n_before, na AS n_after, (SELECT count(*) FROM w WHERE a AND b) AS overlap, (SELECT count(*) FROM logs WHERE ts IS NULL) AS undated FROM s")
_logs_query("explain_terms", lambda x: investigate.explain(x, x.plan("level:error k:>=98 -source:svc-2")), "SELECT '*' AS term, count(*) AS n FROM logs UNION ALL SELECT 'level:error', count(*) FROM logs WHERE level = 'error' UNION ALL SELECT 'k:>=98', count(*) FROM logs WHERE TRY_CAST(k AS DOUBLE) >= 98 UNION ALL SELECT '-source:svc-2', count(*) FROM logs WHERE source <> 'svc-2'")
_logs_query(
    "sources_summary",
    lambda x: breakdown.sources(x),
    """, g AS (SELECT source, file, format, count(*) AS records, count(*) FILTER (NOT parsed) AS unparsed, count(*) FILTER (ts IS NULL) AS undated, count(*) FILTER (ts IS NOT NULL AND NOT ts_zoned) AS zone_assumed, min(ts) AS first, max(ts) AS last FROM logs GROUP BY ALL)
    SELECT *, CASE WHEN records = undated THEN 'none' WHEN zone_assumed = 0 THEN 'known' WHEN zone_assumed = records - undated THEN 'assumed' ELSE 'mixed' END AS zone FROM g""",
)
_logs_query("time_range", lambda x: x.time_range(), "SELECT min(ts) AS first, max(ts) AS last, count(*) FILTER (ts IS NULL) AS undated FROM logs")
_logs_query("field_keys", lambda x: x.table.select(F.explode(F.map_keys("bag")).alias("key")).distinct(), "SELECT DISTINCT unnest(json_keys(fields)) AS key FROM logs")



# --- streams and text functions ---------------------------------------------------


def _stream_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.binned(windows.stream_of(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"])
    return windows.run_to_table(spark, found, shared_folder(spark))


def _stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.binned(windows.stream_of(spark, sf_dir, "events"), "ts", "2 hours", [], slide="1 hour")
    return windows.run_to_table(spark, found, shared_folder(spark))


def _stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.sessions(windows.stream_of(spark, sf_dir, "events"), "ts", "30 minutes", ["user_id"])
    return windows.run_to_table(spark, found, shared_folder(spark)).select("start", "user_id", "n")


QUERIES |= {"stream_bins": _stream_bins, "stream_sliding": _stream_sliding, "stream_sessions": _stream_sessions}
ORACLE_SQL |= {
    "stream_bins": "SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS bin, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_sliding": "SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 1 HOUR * i AS bin, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS i) GROUP BY 1",
    "stream_sessions": """WITH e AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE, TRUE) AS fresh FROM events),
    s AS (SELECT user_id, ts, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT min(ts) AS start, user_id, count(*) AS n FROM s GROUP BY user_id, k""",
}


def _functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text functions in SQL over the events' messages."""
    udfs.register(spark)
    views = {"logs": logs(spark, sf_dir).table}
    return run_sql(spark, "SELECT template(message) AS t, template_id(message) AS id, norm_level(upper(event_type)) AS level, log_time(cast(ts AS string)) AS at, count(*) AS n FROM logs GROUP BY ALL", views)


def _parsed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of the conversations through the line parser."""
    udfs.register(spark)
    lines = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    return run_sql(spark, "SELECT conv_id, turn, p.* FROM lines, LATERAL parse_line(line) p", {"lines": lines})


def _template_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    return docs.groupBy(template_column(F.col("line")).alias("pattern")).agg(F.count(F.lit(1)).alias("n")).withColumn("pattern_id", id_column(F.col("pattern")))


QUERIES |= {"sql_functions": _functions, "parse_text_lines": _parsed_lines, "template_documents": _template_documents}
ORACLE_SQL["sql_functions"] = f"""WITH logs AS ({LOGS_SQL}) SELECT regexp_replace(message, '[0-9]+', '<num>', 'g') AS t, left(sha256(regexp_replace(message, '[0-9]+', '<num>', 'g')), 12) AS id, event_type AS level, ts AS at, count(*) AS n FROM logs GROUP BY ALL"""



# --- parsing: events written as lines of each format and read back -------------------

_AT, _DAY = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")", "date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSS')"
#: Per format: Spark expression of the line; DuckDB expressions of time, level, message, and of one field (its name first).
LINE_FORMATS = {
    "jsonl": (f"concat('{{\"ts\":\"', {_AT}, 'Z\",\"level\":\"', event_type, '\",\"msg\":\"did ', event_type, '\",\"user\":', user_id, '}}')", "ts", "CASE event_type WHEN 'error' THEN 'error' ELSE event_type END", "'did ' || event_type", ("user", "CAST(user_id AS VARCHAR)")),
    "logfmt": (f"concat('ts=', {_AT}, 'Z level=WARN msg=\"did ', event_type, '\" user=', user_id)", "ts", "'warn'", "'did ' || event_type", ("user", "CAST(user_id AS VARCHAR)")),
    "nginx": ("concat('10.0.0.1 - u', user_id, ' [', date_format(ts, 'dd/MMM/yyyy:HH:mm:ss'), ' +0000] \"GET /', event_type, ' HTTP/1.1\" ', 200 + 100 * (event_id % 4), ' 17 \"-\" \"curl\"')", "date_trunc('second', ts)", "CASE event_id % 4 WHEN 2 THEN 'warn' WHEN 3 THEN 'error' ELSE 'info' END", "'GET /' || event_type", ("user", "'u' || CAST(user_id AS VARCHAR)")),
    "syslog": (f"concat('<', 8 + event_id % 8, '>1 ', {_AT}, 'Z host-1 app ', user_id, ' - - did ', event_type)", "ts", "CASE WHEN event_id % 8 < 3 THEN 'fatal' WHEN event_id % 8 = 3 THEN 'error' WHEN event_id % 8 = 4 THEN 'warn' WHEN event_id % 8 < 7 THEN 'info' ELSE 'debug' END", "'did ' || event_type", ("pid", "CAST(user_id AS VARCHAR)")),
    "log4j": (f"concat({_DAY}, ' [t-', user_id % 3, '] WARN c.a.Job [user=', user_id, '] - did ', event_type)", "date_trunc('millisecond', ts)", "'warn'", "'did ' || event_type", ("user", "CAST(user_id AS VARCHAR)")),
    "postgres": (f"concat({_DAY}, ' UTC [', user_id, '] ERROR: did ', event_type)", "date_trunc('millisecond', ts)", "'error'", "'did ' || event_type", ("pid", "CAST(user_id AS VARCHAR)")),
    "cri": (f"concat({_AT}, 'Z stderr F INFO did ', event_type, ' ', user_id)", "ts", "'info'", "'INFO did ' || event_type || ' ' || CAST(user_id AS VARCHAR)", ("stream", "'stderr'")),
    "docker": (f"concat('{{\"log\":\"ERROR did ', event_type, '\\\\n\",\"stream\":\"s', user_id, '\",\"time\":\"', {_AT}, 'Z\"}}')", "ts", "'error'", "'ERROR did ' || event_type", ("stream", "'s' || CAST(user_id AS VARCHAR)")),
    "redis": ("concat(user_id, ':M ', date_format(ts, 'dd MMM yyyy HH:mm:ss.SSS'), ' # did ', event_type)", "date_trunc('millisecond', ts)", "'warn'", "'did ' || event_type", ("pid", "CAST(user_id AS VARCHAR)")),
    "cef": ("concat('CEF:0|Acme|Wall|1|', user_id, '|did ', event_type, '|', event_id % 10, '|src=10.0.0.1')", "NULL::TIMESTAMP", "CASE WHEN event_id % 10 >= 9 THEN 'fatal' WHEN event_id % 10 >= 7 THEN 'error' WHEN event_id % 10 >= 4 THEN 'warn' ELSE 'info' END", "'did ' || event_type", ("signature", "CAST(user_id AS VARCHAR)")),
    "journald": ("concat('{\"MESSAGE\":\"did ', event_type, '\",\"PRIORITY\":\"', event_id % 8, '\",\"__REALTIME_TIMESTAMP\":\"', unix_micros(cast(ts as timestamp)), '\",\"_PID\":\"', user_id, '\"}')", "ts", "CASE WHEN event_id % 8 < 3 THEN 'fatal' WHEN event_id % 8 = 3 THEN 'error' WHEN event_id % 8 = 4 THEN 'warn' WHEN event_id % 8 < 7 THEN 'info' ELSE 'debug' END", "'did ' || event_type", ("_PID", "CAST(user_id AS VARCHAR)")),
    "haproxy": ("concat('10.0.0.1:', user_id, ' [', date_format(ts, 'dd/MMM/yyyy:HH:mm:ss.SSS'), ' +0000] web api/srv1 1/2/3/4/10 ', 200 + 100 * (event_id % 4), ' 99 - - ---- 1/2/3/4/0 5/6 \"GET /', event_type, ' HTTP/1.1\"')", "date_trunc('millisecond', ts)", "CASE event_id % 4 WHEN 2 THEN 'warn' WHEN 3 THEN 'error' ELSE 'info' END", "'GET /' || event_type", ("client_port", "CAST(user_id AS VARCHAR)")),
    "console": ("concat('[0', user_id % 7, ':', lpad(event_id % 60, 2, '0'), ':30] \\u001b[31m✖ ', if(event_id % 2 = 0, 'fail', 'Skipped'), '\\u001b[0m the ', event_type, ' run')", "NULL::TIMESTAMP", "CASE WHEN event_id % 2 = 0 THEN 'error' ELSE 'warn' END", "CASE WHEN event_id % 2 = 0 THEN 'fail' ELSE 'Skipped' END || ' the ' || event_type || ' run'", ("elapsed_s", "CAST(3600 * (user_id % 7) + 60 * (event_id % 60) + 30 AS VARCHAR)")),
    "text": ("concat('the door of room ', user_id, ' was left open after a ', if(event_type = 'error', 'storm', event_type))", "NULL::TIMESTAMP", "NULL", "'the door of room ' || CAST(user_id AS VARCHAR) || ' was left open after a ' || CASE event_type WHEN 'error' THEN 'storm' ELSE event_type END", ("none", "NULL::VARCHAR")),
    "nginx_error": ("concat(date_format(ts, 'yyyy/MM/dd HH:mm:ss'), ' [warn] ', user_id, '#7: *3 did ', event_type, ', client: 10.0.0.1')", "date_trunc('second', ts)", "'warn'", "'did ' || event_type", ("pid", "CAST(user_id AS VARCHAR)")),
}


def _ingest(name: str) -> Callable[[SparkSession, str], DataFrame]:
    line, field = LINE_FORMATS[name][0], LINE_FORMATS[name][4][0]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.expr(line).alias("line"))
        return parse_column(lines, "line").select("event_id", "ts", "level", "message", "format", "parsed", F.col("bag")[field].alias("field"))

    return run


for _name, (_, _ts, _level, _message, (_, _field)) in LINE_FORMATS.items():
    QUERIES[f"ingest_{_name}"] = _ingest(_name)
    ORACLE_SQL[f"ingest_{_name}"] = f"SELECT event_id, {_ts} AS ts, {_level} AS level, {_message} AS message, '{_name}' AS format, TRUE AS parsed, {_field} AS field FROM events"


def _path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates of paths with punctuation around their numbers."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    line = F.format_string("GET /api/orders/(%d)/[%s]/x?%d done", "user_id", "event_type", F.col("event_id"))
    return events.groupBy(template_column(line).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


QUERIES["template_paths"] = _path_templates
ORACLE_SQL["template_paths"] = "SELECT 'GET /api/orders/(<num>)/[' || event_type || ']/x?' || CAST(event_id AS VARCHAR) || ' done' AS pattern, count(*) AS n FROM events GROUP BY 1"


def _redacted(x: Logs) -> DataFrame:
    return redact(x.matching(x.plan("level:error")), ("k",)).select("seq", "raw", F.col("bag")["k"].alias("k"))


_logs_query("redacted_records", _redacted, "SELECT seq, replace(raw, k, 'redacted:' || left(sha256(k), 12)) AS raw, 'redacted:' || left(sha256(k), 12) AS k FROM logs WHERE level = 'error'")

QUERIES.update(relational.QUERIES)
ORACLE_SQL.update(relational.ORACLE_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and worse: how many, and how large, by type of event."""
    x = logs(spark, sf_dir)
    return stats.stats(x, x.plan("level:>=warn stats count(), p95(value) by event_type", aggregate=True), ("event_type", "n", "p95_value"))
