"""Reading raw text: cells, types, quality. The text is derived from the tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.registry import Tables, query
from tabwright.columns import literal_rows
from tabwright.fields import FieldSpec
from tabwright.functions.cells import number_format, parse_number
from tabwright.operators import aggregate
from tabwright.plans.infer import column_counts, infer, infer_columns, type_votes
from tabwright.plans.normalize import normalization_counts, normalize
from tabwright.plans.quality import duplicate_rows, quality_report
from tabwright.scale import checkpoint_dir
from tabwright.sources import preview, read_delimited, read_table, save_table
from tabwright.sources import stored_specs as read_specs
from tabwright.sources.tables import cap_rows, row_counts, rows_at


def raw_orders(t: Tables) -> DataFrame:
    """Orders as someone would have typed them: mixed amounts, dates and flags."""
    k, whole = F.col("o_orderkey"), F.floor("o_totalprice")
    grouped = F.when(
        whole >= 1000,
        F.concat(
            F.floor(whole / 1000).cast("string"),
            F.lit(","),
            F.lpad((whole % 1000).cast("string"), 3, "0"),
        ),
    ).otherwise(whole.cast("string"))
    y, m, d = (f("o_orderdate").cast("string") for f in (F.year, F.month, F.day))
    amount = (
        F.when(k % 7 == 0, F.concat(F.lit("￥"), grouped))
        .when(k % 7 == 1, F.concat(F.lit("$ "), whole.cast("string")))
        .when(k % 7 == 2, F.concat((k % 100).cast("string"), F.lit("%")))
        .when(k % 7 == 3, grouped)
        .when(k % 7 == 4, F.concat(F.lit(" "), whole.cast("string"), F.lit(" ")))
        .when(k % 7 == 5, "n/a")
    )
    day = (
        F.when(k % 8 == 0, F.concat_ws("/", y, m, d))
        .when(k % 8 == 1, F.concat(y, F.lit("年"), m, F.lit("月"), d, F.lit("日")))
        .when(k % 8 == 2, F.concat_ws("/", m, d, y))
        .when(k % 8 == 3, "2026-02-31")
        .when(k % 8 == 4, "")
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm"))
    )
    urgent = F.when(k % 4 == 0, "Yes").when(k % 4 == 1, "否").when(k % 4 == 2, "maybe")
    return t.orders.select(
        k, amount.alias("amount"), day.alias("day"), urgent.alias("urgent"), F.col("o_orderstatus").alias("status")
    )


RAW_SPECS = [
    FieldSpec("o_orderkey", "number", "identifier"),
    FieldSpec("amount", "number", "metric"),
    FieldSpec("day", "date", "time"),
    FieldSpec("urgent", "boolean", "dimension"),
    FieldSpec("status", "string", "status"),
]
RAW_SQL = """
    WITH r AS (
        SELECT o_orderkey AS k, floor(o_totalprice)::BIGINT AS whole, o_orderdate AS d, o_orderstatus AS status,
               CASE WHEN o_orderkey % 7 IN (0, 1, 3, 4) THEN floor(o_totalprice)
                    WHEN o_orderkey % 7 = 2 THEN (o_orderkey % 100) / 100.0 END::DOUBLE AS amount,
               CASE WHEN o_orderkey % 8 NOT IN (3, 4) THEN strftime(o_orderdate, '%Y-%m-%d') END AS day,
               CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS urgent
        FROM orders)
"""


@query(RAW_SQL + "SELECT k::DOUBLE AS o_orderkey, amount, day, urgent, status FROM r")
def normalize_cells(t):
    return normalize(raw_orders(t), RAW_SPECS)


@query(
    RAW_SQL
    + """
    SELECT k AS o_orderkey, CASE k % 7 WHEN 0 THEN 'currency' WHEN 1 THEN 'currency' WHEN 2 THEN 'percentage'
           WHEN 3 THEN CASE WHEN whole >= 1000 THEN 'decimal' ELSE 'integer' END
           WHEN 4 THEN 'integer' ELSE 'plain' END AS tag
    FROM r
    """
)
def number_formats(t):
    return raw_orders(t).select("o_orderkey", number_format("amount").alias("tag"))


@query(
    RAW_SQL
    + """
    SELECT 'o_orderkey' AS field, 0::BIGINT AS "invalidNumber", 0::BIGINT AS "invalidDate", 0::BIGINT AS changed
    UNION ALL SELECT 'amount', count_if(k % 7 = 5), 0,
                     count_if(k % 7 IN (0, 1, 2) OR (k % 7 = 3 AND whole >= 1000)) FROM r
    UNION ALL SELECT 'day', 0, count_if(k % 8 = 3), 0 FROM r
    UNION ALL SELECT 'urgent', 0, 0, 0
    UNION ALL SELECT 'status', 0, 0, 0
    """
)
def normalize_counts(t):
    return normalization_counts(raw_orders(t), RAW_SPECS)


@query(
    RAW_SQL
    + """
    SELECT 'o_orderkey' AS field, 0::BIGINT AS boolean, count(*) AS number, 0::BIGINT AS date, 0::BIGINT AS string FROM r
    UNION ALL SELECT 'amount', 0, count(amount), 0, count_if(k % 7 = 5) FROM r
    UNION ALL SELECT 'day', 0, 0, count(day), count_if(k % 8 = 3) FROM r
    UNION ALL SELECT 'urgent', 0, 0, 0, count_if(k % 4 < 3) FROM r
    UNION ALL SELECT 'status', 0, 0, 0, count(*) FROM r
    """
)
def type_vote_counts(t):
    return type_votes(raw_orders(t)).select("field", "boolean", "number", "date", "string")


@query(
    RAW_SQL
    + """
    , c AS (
        SELECT 'o_orderkey' AS field, 'number' AS type, 1.0::DOUBLE AS confidence, 'integer' AS format,
               count(DISTINCT k) AS d, 0::BIGINT AS absent FROM r
        UNION ALL SELECT 'amount', 'number', count(amount) / count_if(k % 7 <> 6), 'currency',
               (SELECT count(DISTINCT CASE k % 7 WHEN 0 THEN '￥' || whole WHEN 1 THEN '$' || whole
                                           WHEN 2 THEN (k % 100) || '%' WHEN 3 THEN 'g' || whole
                                           WHEN 4 THEN ' ' || whole WHEN 5 THEN 'n/a' END) FROM r),
               count_if(k % 7 = 6) FROM r
        UNION ALL SELECT 'day', 'date', count(day) / count_if(k % 8 <> 4), 'date',
               (SELECT count(DISTINCT CASE WHEN k % 8 = 3 THEN 'x' WHEN k % 8 > 4 THEN 'iso' || d::VARCHAR
                                           WHEN k % 8 <> 4 THEN (k % 8) || d::VARCHAR END) FROM r),
               count_if(k % 8 = 4) FROM r
        UNION ALL SELECT 'urgent', 'string', 1.0, 'plain', 3, count_if(k % 4 = 3) FROM r
        UNION ALL SELECT 'status', 'string', 1.0, 'plain', count(DISTINCT status), 0 FROM r)
    SELECT field, type, round(confidence, 4) AS confidence, format, d AS "distinctCount",
           absent AS "nullCount", round(absent / (SELECT count(*) FROM r), 4) AS "nullRate",
           (SELECT count(*) FROM r) AS rows
    FROM c
    """
)
def inferred_columns(t):
    found = infer_columns(raw_orders(t))
    return found.select(
        "field", "type", "confidence", "format", "distinctCount", "nullCount", "nullRate", "rows"
    )


@query(
    RAW_SQL
    + """
    SELECT 'MIXED_TYPE' AS code, 'warning' AS level, 'amount' AS field, count_if(k % 7 = 5) AS count,
           round(count_if(k % 7 = 5) / count_if(k % 7 <> 6), 4) AS rate FROM r
    UNION ALL SELECT 'INVALID_NUMBER', 'warning', 'amount', count_if(k % 7 = 5), NULL FROM r
    UNION ALL SELECT 'MIXED_TYPE', 'warning', 'day', count_if(k % 8 = 3),
                     round(count_if(k % 8 = 3) / count_if(k % 8 <> 4), 4) FROM r
    UNION ALL SELECT 'INVALID_DATE', 'warning', 'day', count_if(k % 8 = 3), NULL FROM r
    UNION ALL SELECT 'HIGH_NULL_RATE', 'warning', 'urgent', count_if(k % 4 > 1),
                     round(count_if(k % 4 > 1) / count(*), 4) FROM r
    UNION ALL SELECT 'POSSIBLE_IDENTIFIER', 'info', 'o_orderkey', count(*), NULL FROM r
    UNION ALL SELECT 'EMPTY_COLUMN', 'error', 'nothing', count(*), 1.0 FROM r
    UNION ALL SELECT 'DUPLICATE_COLUMN_NAME', 'warning', NULL, NULL, NULL
    UNION ALL SELECT 'TRUNCATED', 'warning', NULL, 500, NULL
    """
)
def quality_findings(t):
    raw = raw_orders(t).withColumn("nothing", F.lit(""))
    specs = [FieldSpec("o_orderkey", "number", "metric"), *RAW_SPECS[1:], FieldSpec("nothing")]
    return quality_report(raw, specs, original_rows=1500, stored_rows=1000, duplicate_names=True)


@query(
    """
    SELECT 'HIGH_CARDINALITY' AS code, 'info' AS level, 'text' AS field, count(DISTINCT text) AS count, NULL::DOUBLE AS rate
    FROM documents WHERE text <> ''
    UNION ALL
    SELECT 'DUPLICATE_ROWS', 'warning', NULL, count(*) - count(DISTINCT (text, lang)), NULL FROM documents
    """
)
def quality_of_documents(t):
    df = t.documents.select("text", "lang")
    specs = [FieldSpec("text", "string"), FieldSpec("lang", "string")]
    return quality_report(df, specs)


@query(
    """
    SELECT (count(*) - count(DISTINCT (text, lang)))::BIGINT AS "duplicateRowCount", 0::BIGINT AS "emptyRowCount"
    FROM documents
    """
)
def duplicates_of_texts(t):
    return duplicate_rows(t.documents.select("text", "lang"))


@query(
    """
    WITH o AS (SELECT CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus ELSE '' END AS s,
                      CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS p FROM orders),
         g AS (SELECT s, p, count(*) AS n FROM o GROUP BY 1, 2)
    SELECT sum(n - 1) FILTER (s <> '')::BIGINT AS "duplicateRowCount",
           sum(n) FILTER (s = '')::BIGINT AS "emptyRowCount" FROM g
    """
)
def duplicates_and_empty_rows(t):
    """A third of all rows hold nothing, and the others share a few values."""
    kept = F.col("o_orderkey") % 3 > 0
    rows = t.orders.select(
        F.when(kept, F.col("o_orderstatus")).otherwise("").alias("s"),
        F.when(kept, F.col("o_orderpriority")).alias("p"),
    )
    return duplicate_rows(rows)


@query(
    """
    SELECT field, n AS rows, 0::BIGINT AS "nullCount", 0.0::DOUBLE AS "nullRate", d AS "distinctCount",
           false AS nullable, v AS "sampleValues"
    FROM (SELECT 'c_name' AS field, count(*) AS n, count(DISTINCT c_name) AS d,
                 (SELECT string_agg(c_name, '|' ORDER BY c_custkey) FROM customer WHERE c_custkey < 5) AS v FROM customer
          UNION ALL
          SELECT 'c_mktsegment', count(*), count(DISTINCT c_mktsegment),
                 (SELECT string_agg(c_mktsegment, '|' ORDER BY c_custkey) FROM customer WHERE c_custkey < 5) FROM customer)
    """
)
def column_sample_values(t):
    found = column_counts(t.customer, ["c_name", "c_mktsegment"], "c_custkey")
    return found.withColumn("sampleValues", F.concat_ws("|", "sampleValues"))


@query(
    """
    WITH n AS (SELECT count(*) AS n FROM orders),
         p AS (SELECT DISTINCT (i * (n - 1)) // 499 AS p FROM range(500) r(i), n)
    SELECT o_orderkey, o_totalprice
    FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders)
    WHERE pos IN (SELECT p FROM p)
    """
)
def evenly_spaced_rows(t):
    """The sample that types can be voted on: first and last row included."""
    total = t.orders.count()
    return rows_at(
        t.orders, [i * (total - 1) // 499 for i in range(500)], "o_orderkey"
    ).select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_custkey LIMIT 20")
def preview_rows(t):
    return preview(t.customer.select("c_custkey", "c_name", "c_acctbal"), order_by=["c_custkey"])


@query(
    """
    SELECT count(*) AS "originalRowCount", least(count(*), 1000) AS "storedRowCount",
           count(*) > 1000 AS truncated FROM orders
    """
)
def capped_rows(t):
    return row_counts(t.orders, cap_rows(t.orders, 1000, ["o_orderkey"]))


@query(
    """
    SELECT c_mktsegment, round(sum(c_acctbal), 2) AS c_acctbal, round(sum(c_custkey), 2)::DOUBLE AS c_custkey
    FROM customer GROUP BY 1
    """,
    2,
)
def delimited_text(t):
    """Customers written as delimited text, read back, inferred, normalized, kept, summed."""
    # Intermediate files go where the cluster keeps them, into a folder of their own.
    folder = f"{checkpoint_dir(t.spark)}/delimited-{uuid.uuid4().hex}"
    t.customer.write.option("header", True).option("sep", "|").csv(f"{folder}/text")
    raw = read_delimited(t.spark, f"{folder}/text")
    inferred = infer(raw.df, {"c_custkey": {"role": "metric"}})
    save_table(normalize(raw.df, inferred.specs), f"{folder}/table")
    return aggregate(read_table(t.spark, f"{folder}/table"), ["c_mktsegment"], ["c_acctbal", "c_custkey"])


def all_text(df: DataFrame) -> DataFrame:
    return reduce(lambda d, c: d.withColumn(c, F.col(c).cast("string")), df.columns, df)


@query(
    """
    SELECT 'c_custkey' AS field, 'number' AS type, 'integer' AS format
    UNION ALL SELECT 'c_name', 'string', 'plain' UNION ALL SELECT 'c_nationkey', 'number', 'integer'
    UNION ALL SELECT 'c_acctbal', 'number', CASE WHEN count_if(c_acctbal <> floor(c_acctbal)) > 0 THEN 'decimal' ELSE 'integer' END FROM customer
    UNION ALL SELECT 'c_mktsegment', 'string', 'plain'
    """
)
def inferred_customers(t):
    return infer_columns(all_text(t.customer)).select("field", "type", "format")


@query(
    """
    WITH f AS (SELECT count(DISTINCT c_custkey) = count(*) AS keys, count(DISTINCT c_acctbal) = count(*) AS sums,
                      count_if(c_acctbal <> floor(c_acctbal)) > 0 AS fractions FROM customer),
         r AS (SELECT 'c_custkey' AS field, 'number' AS type, CASE WHEN keys THEN 'identifier' ELSE 'metric' END AS role,
                      'integer' AS format FROM f
               UNION ALL SELECT 'c_name', 'string', 'dimension', 'plain'
               UNION ALL SELECT 'c_nationkey', 'number', 'metric', 'integer'
               UNION ALL SELECT 'c_acctbal', 'number', CASE WHEN sums THEN 'identifier' ELSE 'metric' END,
                                CASE WHEN fractions THEN 'decimal' ELSE 'integer' END FROM f
               UNION ALL SELECT 'c_mktsegment', 'string', 'dimension', 'plain')
    SELECT *, CASE WHEN role = 'metric' THEN 'sum' ELSE 'count' END AS aggregation FROM r
    """
)
def stored_specs(t):
    """Customers read as text, inferred, kept with their specs, and the specs read back."""
    raw = all_text(t.customer)
    specs = infer(raw).specs
    path = f"{checkpoint_dir(t.spark)}/specs-{uuid.uuid4().hex}"
    save_table(normalize(raw, specs), path, specs=specs)
    kept = read_specs(read_table(t.spark, path))
    columns = ("field", "type", "role", "format", "aggregation")
    rows = [(s.name, s.type, s.role, s.format, s.aggregation) for s in kept]
    return literal_rows(t.spark, rows, dict.fromkeys(columns, "string"))


@query(
    """
    WITH k AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, count(*) OVER () AS n
               FROM orders WHERE o_orderkey % 3 = 1)
    SELECT o_orderkey FROM k WHERE pos IN (0, n // 2, n - 1)
    """
)
def positions_of_filtered_rows(t):
    """Rows by position after others were filtered out."""
    kept = t.orders.filter("o_orderkey % 3 = 1").select("o_orderkey")
    n = kept.count()
    return rows_at(kept, [0, n // 2, n - 1], "o_orderkey")


# --- padded and spaced cells ---------------------------------------------------------

PADDED = "concat(repeat(' ', 70), CASE WHEN o_orderkey % 8 = 3 THEN 'soon' ELSE date_format(o_orderdate, 'yyyy/MM/dd') END)"


@query(
    """
    SELECT 'day' AS field, 0::BIGINT AS boolean, 0::BIGINT AS number, count_if(o_orderkey % 8 <> 3) AS date,
           count_if(o_orderkey % 8 = 3) AS string FROM orders
    """
)
def type_votes_padded(t):
    """Dates after seventy blanks are dates."""
    return type_votes(t.orders.selectExpr(f"{PADDED} AS day")).select("field", "boolean", "number", "date", "string")


@query(
    """
    SELECT 'MIXED_TYPE' AS code, 'warning' AS level, 'day' AS field, count_if(o_orderkey % 8 = 3) AS count,
           round(count_if(o_orderkey % 8 = 3) / count(*), 4) AS rate FROM orders
    UNION ALL SELECT 'INVALID_DATE', 'warning', 'day', count_if(o_orderkey % 8 = 3), NULL FROM orders
    """
)
def quality_padded(t):
    df = t.orders.selectExpr(f"{PADDED} AS day", "o_orderkey")
    return quality_report(df, [FieldSpec("day", "date", "time"), FieldSpec("o_orderkey", "string")]).filter("field = 'day'")


@query(
    """
    SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 12.5 WHEN 1 THEN 1000.0 + o_orderkey % 100 END::DOUBLE AS n FROM orders
    """
)
def spaced_numbers(t):
    """Blanks inside a number are read in amounts, not in percentages."""
    cell = (
        "CASE o_orderkey % 3 WHEN 0 THEN ' 1250 % ' WHEN 1 THEN concat('$1 0', lpad(o_orderkey % 100, 2, '0')) "
        "ELSE '1 000%' END AS cell"
    )
    return t.orders.selectExpr("o_orderkey", cell).select("o_orderkey", parse_number("cell").alias("n"))
