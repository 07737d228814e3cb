"""Samples, masks and fingerprints."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from catalog.registry import query
from tabwright.fields import specs_of
from tabwright.functions.dates import date_sql
from tabwright.functions.masking import mask, mask_columns
from tabwright.plans import context, stats
from tabwright.plans.context import HEAD, MIDDLE, RANDOM, SAMPLE_ROWS, TAIL


def with_contacts(t):
    """Customers with a phone number for most and a free text for the others."""
    k = F.col("c_custkey")
    phone = F.concat(F.lit("13"), F.lpad(k.cast("string"), 9, "0"))
    return t.customer.withColumns(
        {
            "contact": F.when(k % 3 > 0, phone).otherwise("ask at the desk"),
            "mail": F.when(k % 3 == 0, F.concat(F.col("c_name"), F.lit("x@example.com"))).otherwise("-"),
            "email": F.lit(""),
        }
    )


@query(
    """
    SELECT * FROM (
        SELECT 'contact' AS field, false AS "byName", false AS "byRole",
               round(avg((c_custkey % 3 > 0)::INT), 4) AS "matchRate", true AS sensitive FROM customer
        UNION ALL SELECT 'mail', false, false, 0.0, false
        UNION ALL SELECT 'email', true, false, 0.0, true
        UNION ALL SELECT 'c_custkey', false, true, 0.0, true
        UNION ALL SELECT 'c_mktsegment', false, false, 0.0, false)
    """
)
def sensitive_columns(t):
    df = with_contacts(t).select("contact", "mail", "email", "c_custkey", "c_mktsegment")
    return context.sensitive_columns(df, specs_of(df, {"c_custkey": {"role": "identifier"}}))


MASK_SQL = """
    CASE WHEN length({0}) = 0 THEN {0} WHEN length({0}) = 1 THEN '*'
         WHEN length({0}) = 2 THEN left({0}, 1) || '*'
         ELSE left({0}, 1) || repeat('*', length({0}) - 2) || right({0}, 1) END
"""


@query(f"SELECT doc_id, {MASK_SQL.format('source')} AS source, md5({MASK_SQL.format('text')}) AS text FROM documents")
def masked_documents(t):
    return mask_columns(t.documents, ["source", "text"]).select(
        "doc_id", "source", F.md5("text").alias("text")
    )


@query(
    f"""
    SELECT {MASK_SQL.format('c_name')} AS masked, count(*) AS n,
           count(DISTINCT sha256('salt' || c_name)) AS tokens
    FROM customer GROUP BY 1
    """
)
def masked_join_tokens(t):
    out = mask_columns(t.customer.select("c_name"), ["c_name"], join_salt="salt")
    return out.groupBy(F.col("c_name").alias("masked")).agg(
        F.count("*").alias("n"), F.count_distinct("c_name_token").alias("tokens")
    )


_DRAW = random.Random(0)
_FRACTIONS = ", ".join(f"({_DRAW.random()!r}::DOUBLE)" for _ in range(RANDOM))


@query(
    f"""
    WITH d AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents),
         fixed AS (
            SELECT * FROM d
            WHERE n <= {SAMPLE_ROWS} OR pos < {HEAD} OR pos >= n - {TAIL}
               OR (pos >= (n - {MIDDLE}) // 2 AND pos < (n - {MIDDLE}) // 2 + {MIDDLE})),
         langs AS (SELECT min(pos) AS pos FROM d WHERE lang <> '' AND lang NOT IN (SELECT lang FROM fixed) GROUP BY lang),
         picked AS (
            SELECT DISTINCT pos FROM d
            WHERE pos IN (SELECT pos FROM fixed) OR pos IN (SELECT pos FROM langs)
               OR pos IN (SELECT floor(n * f)::BIGINT FROM (VALUES {_FRACTIONS}) v(f)))
    SELECT doc_id, lang FROM d WHERE pos IN (SELECT pos FROM picked)
    """
)
def stable_sample(t):
    df = t.documents.select("doc_id", "lang")
    return context.stable_sample(df, ["lang"], seed=0, row_id="doc_id")


@query(
    """
    SELECT 'class' AS field, count(DISTINCT doc_id % 25) AS values, count(DISTINCT doc_id % 25) AS shown FROM documents
    """
)
def sample_covers_classes(t):
    """Of 25 values in a 40-row sample none is left out."""
    df = t.documents.selectExpr("doc_id", "concat('class ', doc_id % 25) AS class")
    sample = context.stable_sample(df, ["class"], seed=0, row_id="doc_id")
    return context.sample_coverage(df, sample, ["class"])


@query(
    """
    SELECT 'hidden' AS part, 'phone' AS field, count(*) AS n FROM customer
    UNION ALL SELECT 'numbers', 'c_acctbal', count(*) FROM customer
    UNION ALL SELECT 'values', 'c_mktsegment', count(c_mktsegment) FROM customer
    """
)
def context_sensitive_numbers(t):
    """No value of a phone number that is held as a number is in any summary."""
    df = t.customer.selectExpr("13900000000 + c_custkey AS phone", "c_acctbal", "c_mktsegment")
    roles = {"phone": {"role": "metric"}, "c_mktsegment": {"role": "dimension"}}
    parts = context.table_context(df, specs_of(df, roles), row_samples=False)
    n = {"hidden": "count", "numbers": "count", "values": "sum(count)"}
    rows = [
        parts[p].groupBy("field").agg(F.expr(f"{c if '(' in c else f'max({c})'} AS n")).withColumn("part", F.lit(p))
        for p, c in n.items()
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(
    """
    WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
         e AS (SELECT 'min' AS edge, arg_min(event_id, (value, event_id)) AS event_id FROM events
               UNION ALL SELECT 'max', arg_min(event_id, (-value, event_id)) FROM events
               UNION ALL SELECT 'p25', arg_min(event_id, (round(abs(value - q1), 9), event_id)) FROM events, q
               UNION ALL SELECT 'p75', arg_min(event_id, (round(abs(value - q3), 9), event_id)) FROM events, q)
    SELECT 'value' AS field, edge, event_id, value FROM e JOIN events USING (event_id)
    """
)
def boundary_rows(t):
    return context.boundary_rows(t.events, ["value"], row_id="event_id")


@query(
    """
    WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
         b AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
    SELECT 'value' AS field, event_id, CASE WHEN value < lo THEN 'lower' ELSE 'upper' END AS direction, value
    FROM events, b WHERE value < lo OR value > hi ORDER BY event_id LIMIT 10
    """
)
def anomaly_candidates(t):
    return context.anomaly_rows(t.events, ["value", "user_id"], row_id="event_id")


@query(
    """
    SELECT 'ts' AS field, strftime(min(ts), '%Y-%m-%d') AS min, strftime(max(ts), '%Y-%m-%d') AS max,
           count(DISTINCT ts::DATE) AS "distinctDays" FROM events
    """
)
def date_stats(t):
    return stats.date_stats(t.events, {"ts": date_sql(t.events, "ts")})


@query(
    f"""
    WITH v AS (SELECT {MASK_SQL.format('c_name')} AS value, count(*) AS n FROM customer GROUP BY 1)
    SELECT 'c_name' AS field, 'top' AS side, row_number() OVER (ORDER BY n DESC, value) AS rank, value,
           n AS count, round(n / sum(n) OVER (), 4) AS rate
    FROM v ORDER BY n DESC, value LIMIT 10
    """
)
def masked_top_values(t):
    """Values are masked before they are counted, so no original appears."""
    df = t.customer.select("c_name")
    return context.column_context(df, specs_of(df), masked=["c_name"])["values"]


@query(f"SELECT conv_id, turn, {MASK_SQL.format('role')} AS role, length(text) AS n FROM conversations")
def masked_roles(t):
    return t.conversations.select(
        "conv_id", "turn", mask("role").alias("role"), F.length("text").cast("bigint").alias("n")
    )
