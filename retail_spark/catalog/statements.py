"""The statement gate, guarded reads, and the query log."""

from __future__ import annotations

from pyspark.sql import functions as F

from retail_spark.catalog.registry import entry
from retail_spark.operators.statements import BLOCKED_WORDS, audit, read_query
from retail_spark.plans.runs import query_history
from retail_spark.sources.readers import register

STATEMENTS = """SELECT conv_id, turn, CASE (conv_id + turn) % 6 WHEN 0 THEN 'SELECT ' || text
  WHEN 1 THEN '-- note' || chr(10) || '  select ' || text || ' /* drop ' || chr(10) || ' it */'
  WHEN 2 THEN 'WITH x AS (SELECT 1) SELECT * FROM x -- ' || text WHEN 3 THEN 'DROP TABLE t; ' || text
  WHEN 4 THEN 'SELECT 1; delete from t where c = ''' || text || ''''
  ELSE 'select ''update'' AS w, replacement, ' || text END AS statement FROM conversations"""


def statements(v):
    """Chat turns as statements of every kind the gate tells apart."""
    k = (F.col("conv_id") + F.col("turn")) % 6
    text = F.col("text")
    statement = (
        F.when(k == 0, F.concat(F.lit("SELECT "), text))
        .when(k == 1, F.concat(F.lit("-- note\n  select "), text, F.lit(" /* drop \n it */")))
        .when(k == 2, F.concat(F.lit("WITH x AS (SELECT 1) SELECT * FROM x -- "), text))
        .when(k == 3, F.concat(F.lit("DROP TABLE t; "), text))
        .when(k == 4, F.concat(F.lit("SELECT 1; delete from t where c = '"), text, F.lit("'")))
        .otherwise(F.concat(F.lit("select 'update' AS w, replacement, "), text))
    )
    return v.table("conversations").select("conv_id", "turn", statement.alias("statement"))


_BARE = r"""regexp_replace(lower(regexp_replace(regexp_replace(statement, '--[^\n]*', '', 'g'), '(?s)/\*.*?\*/', '', 'g')),
  '^\s+|\s+$', '', 'g')"""
_BLOCKED = rf"regexp_extract(bare, '\b({'|'.join(BLOCKED_WORDS)})\b', 1)"


@entry(
    "sql_safety_audit",
    f"""SELECT conv_id, turn, starts_with(bare, 'select') AND {_BLOCKED} = '' AS is_safe,
    CASE WHEN NOT starts_with(bare, 'select') THEN 'not a SELECT: ' || substr(bare, 1, 30)
      WHEN {_BLOCKED} <> '' THEN 'blocked word: ' || upper({_BLOCKED}) ELSE 'safe SELECT statement' END AS reason
    FROM (SELECT conv_id, turn, {_BARE} AS bare FROM ({STATEMENTS}) s) t""",
)
def sql_safety_audit(v):
    return audit(statements(v), "statement").drop("statement")


@entry(
    "sql_read_query",
    """SELECT status, count(*) AS orders, CAST(sum(total_amount) AS DOUBLE) AS revenue FROM v_orders GROUP BY status""",
)
def sql_read_query(v):
    register(v.clean)
    rows, error = read_query(
        v.spark, "SELECT status, count(*) AS orders, sum(total_amount) AS revenue FROM orders GROUP BY status"
    )
    if error:
        raise ValueError(error)
    return rows


def query_log(v):
    """Events as a log of answered questions."""
    return v.table("events").select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("show "), F.col("event_type")).alias("question"),
        F.concat(F.lit("SELECT "), F.col("user_id").cast("string")).alias("statement"),
        F.col("value").alias("execution_time_ms"),
        (F.col("event_type") != "error").alias("success"),
        (F.col("event_id") % 7 == 0).alias("retried"),
        F.get_json_object("props", "$.k").cast("bigint").alias("row_count"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("logged_at"),
    )


@entry(
    "query_log_history",
    """SELECT event_id AS id, 'show ' || event_type AS question, 'SELECT ' || user_id AS statement, value AS execution_time_ms,
    event_type <> 'error' AS success, event_id % 7 = 0 AS retried, CAST(json_extract_string(props, '$.k') AS BIGINT) AS row_count,
    strftime(ts, '%Y-%m-%d %H:%M:%S') AS logged_at, least((SELECT count(*) FROM events), 1000) AS total
    FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 1000) t ORDER BY event_id DESC LIMIT 50 OFFSET 100""",
)
def query_log_history(v):
    return query_history(query_log(v), limit=50, offset=100)
