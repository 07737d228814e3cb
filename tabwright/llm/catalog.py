"""The registered queries of this subpackage: one per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.llm import (
    decontaminate, langid, lines, packing, pages, quality, recount, runs, shards, simhash, spelling, urls, warc,
)
from tabwright.llm.common import drop, shared_folder, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@query
def op8_simhash_trie(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


# The rules of the contract.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


@query
def op10_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.sql(
        "select * from values " + ", ".join(map(str, URL_RULES)) + " as rules(host, path, verdict)"
    )
    return urls.judge(table(spark, folder, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


SQL["op10_url_filters"] = """
WITH rules(r_host, r_path, verdict) AS (VALUES """ + ", ".join(map(str, URL_RULES)) + r"""),
cut AS (
  SELECT page_id, coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END, '') AS rest
  FROM pages
),
split AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
)
SELECT page_id, host, path,
       (SELECT r_host || r_path FROM rules
        WHERE (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
        ORDER BY length(r_host || r_path) DESC LIMIT 1) AS rule,
       coalesce((SELECT verdict FROM rules
        WHERE (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
        ORDER BY length(r_host || r_path) DESC LIMIT 1), 'allow') AS verdict
FROM split
"""


@query
def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.drop("longest_match")


SQL["op1_decontamination"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
),
cut AS (SELECT item_id, w, least(len(w), 10) AS n FROM i WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[k : k + n - 1], ' ') AS x
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM cut)
),
sizes AS (SELECT DISTINCT n FROM windows),
found AS (
  SELECT r, k, n, item_id FROM (
    SELECT r, k, n, array_to_string(w[k : k + n - 1], ' ') AS x
    FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)
  ) JOIN windows USING (n, x)
),
hit AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS place FROM found) GROUP BY r),
items AS (SELECT r, list(item) AS items FROM (SELECT DISTINCT r, coalesce(item_id::VARCHAR, 'null') AS item FROM found ORDER BY 1, 2) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(list_sort(items), ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""


@query
def op6_compression_bands(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(table(spark, folder, "documents"))


@query
def op3_language_filters(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = langid.fit(docs.filter(~langid.held_out()))
    found = langid.predict(docs, model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def bpe_file() -> str:
    """The byte-level BPE vocabulary that the box offers; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op9_bm25_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(table(spark, folder, "documents"), bpe_file())
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query
def op4_line_alignment(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs, removed="removed_lines")


@query
def op2_warc_members(spark: SparkSession, folder: str) -> DataFrame:
    source = table(spark, folder, "pages")
    whole, single = shared_folder(spark, "monoliths"), shared_folder(spark, "archives")
    warc.write_monoliths(source, whole)
    warc.normalise(spark, whole, single)
    drop(spark, whole)
    records = warc.read_records(spark, single, warc.read_index(spark, single))
    found = warc.with_types(warc.digests(records, "page_id", source.schema["page_id"].dataType.simpleString()), "page_id")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op2_warc_members"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS hex FROM pages),
last AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS kept FROM p),
fives AS (  -- five hexadecimal digits are four of base 32
  SELECT *, list_transform(range(8), lambda k: ('0x' || substr(hex, 5 * k + 1, 5))::BIGINT) AS f FROM last
)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
       array_to_string(list_transform(f, lambda x: array_to_string(list_transform([32768, 1024, 32, 1],
         lambda d: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x // d) % 32 + 1)::BIGINT, 1)), '')), '') AS payload_digest,
       CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> kept THEN kept END AS refers_to
FROM fives
"""


@query
def op7_text_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return pages.extract(table(spark, folder, "pages"))


@query
def op5_edit_aware_counts(spark: SparkSession, folder: str) -> DataFrame:
    from public_tokenizers import PATTERN

    docs = table(spark, folder, "documents").select("doc_id", "text")
    trees = written(recount.build_trees(docs, bpe_file(), PATTERN), "trees")
    return recount.edit_trees(recount.with_mask_edits(trees), bpe_file(), PATTERN).select("doc_id", *recount.COUNTS)


@query
def op11_spelling_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, folder, "documents"), typos=97)


@query
def op12_external_shuffle(spark: SparkSession, folder: str) -> DataFrame:
    docs, path = table(spark, folder, "documents").select("doc_id", "text"), shared_folder(spark, "shards")
    shards.write_shards(docs, path)
    whole = F.coalesce("text", F.lit(""))
    return shards.read_shards(spark, path, docs).select(
        "doc_id",
        (F.octet_length(whole) + 16).cast("bigint").alias("size"),
        F.crc32(whole).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def with_repeats(docs: DataFrame) -> DataFrame:
    """The texts in which the contract plants repetitions, the others as they are."""
    words = r"filter(split(text, r'[\x20\x09-\x0D]+'), w -> w <> '')"
    h = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    w = h.withColumn("w", F.expr(f"CASE WHEN h % 10 = 0 THEN {words} END"))
    at = w.selectExpr("*", "size(w) AS n", "h div 10 AS g").selectExpr(
        "*", "CASE WHEN n > 0 THEN g % n END AS a", "3 + g % 8 AS parts"
    )
    shifted = "transform(w, (x, i) -> CASE WHEN i < a THEN x ELSE element_at(w, cast(a + (i - a) % p + 1 AS int)) END)"
    return at.withColumn("p", F.expr("1 + (n - a) div parts")).selectExpr(
        "doc_id", f"CASE WHEN n > 0 THEN array_join({shifted}, ' ') ELSE text END AS text"
    )


@query
def op13_square_catcher(spark: SparkSession, folder: str) -> DataFrame:
    found = runs.periodic_runs(with_repeats(table(spark, folder, "documents")))
    # the first of the longest runs: structs compare field by field
    longest = found.withColumn("top", F.expr(
        "array_min(transform(runs, r -> struct(-r.length AS less, r.start AS start, r.period AS period)))"
    ))
    lines = "array_join(transform(runs, r -> concat_ws(',', r.start, r.length, r.period) || '\\n'), '')"
    return longest.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("top.start").alias("start"),
        (-F.col("top.less")).alias("length"),
        F.col("top.period").alias("period"),
        F.expr("1000 * -top.less div top.period").alias("exponent_milli"),
        F.sha2(F.expr(lines), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
