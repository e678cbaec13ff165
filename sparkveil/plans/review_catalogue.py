"""Queries of what a reviewer sees and does, streams, and sources, beside the main catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkveil.functions import dims, text
from sparkveil.operators import review
from sparkveil.plans.catalogue import query, table
from sparkveil.sources import scratch
from sparkveil.streaming import streams

_NAMES = ", ".join(f"({i}, '{n}')" for i, n in enumerate(dims.NAMES))

#: A span for each line of an order, in SQL that both engines read but for the names of entities.
_FIELDS = """l_orderkey AS doc_id, l_orderkey * 10 + l_linenumber AS span_id, l_linenumber * 20 AS start_at, l_linenumber * 20 + 5 AS end_at,
 CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_linenumber % 2 END AS page, l_partkey % 4 < 2 AS removed, l_returnflag AS value,
 CASE WHEN l_partkey % 5 = 0 THEN 'checksum_invalido' END AS note, CASE WHEN l_partkey % 2 = 0 THEN 'pseudonimo' ELSE 'tarja' END AS operator, l_partkey % 3 <> 0 AS fits"""
_SPANS_SQL = f"spans AS (SELECT {_FIELDS}, d.entity FROM lineitem JOIN (VALUES {_NAMES}) d(i, entity) ON l_partkey % 16 = d.i)"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, dims.NAMES))
    at = table(spark, sf_dir, "lineitem").withColumn("entity", F.get(names, (F.col("l_partkey") % 16).cast("int")))
    at = at.selectExpr("l_orderkey AS doc_id", "l_orderkey * 10 + l_linenumber AS span_id", "l_linenumber * 20 AS start", "l_linenumber * 20 + 5 AS end", "CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_linenumber % 2 END AS page", "l_partkey % 4 < 2 AS removed", "l_returnflag AS value", "CASE WHEN l_partkey % 5 = 0 THEN 'checksum_invalido' END AS note", "CASE WHEN l_partkey % 2 = 0 THEN 'pseudonimo' ELSE 'tarja' END AS operator", "l_partkey % 3 <> 0 AS fits", "entity")
    return at


@query("class_states", f"WITH {_SPANS_SQL} SELECT doc_id, entity, count(*) AS total, count(*) FILTER (removed) AS \"on\", CASE WHEN count(*) FILTER (removed) = 0 THEN 'none' WHEN count(*) FILTER (removed) = count(*) THEN 'all' ELSE 'some' END AS state FROM spans GROUP BY 1, 2")
def class_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.class_rows(_spans(spark, sf_dir))


@query("value_groups", f"WITH {_SPANS_SQL} SELECT entity, value, count(*) AS n, coalesce(bool_or(note = 'checksum_invalido'), false) AS any_invalid, bool_or(removed) AS any_on FROM spans GROUP BY doc_id, entity, value")
def value_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.value_rows(_spans(spark, sf_dir)).select("entity", "value", "n", F.coalesce("any_invalid", F.lit(False)).alias("any_invalid"), "any_on")


@query("page_thumbnails", f"WITH {_SPANS_SQL} SELECT doc_id, page, count(*) AS n FROM spans WHERE removed AND page IS NOT NULL GROUP BY 1, 2")
def page_thumbnails(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _spans(spark, sf_dir).where("page IS NOT NULL").withColumn("pages", F.array("page", "page"))
    return review.page_counts(at)


@query("reading_order", f"WITH {_SPANS_SQL} SELECT doc_id, span_id, row_number() OVER (PARTITION BY doc_id ORDER BY page NULLS LAST, start_at) AS place FROM spans")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _spans(spark, sf_dir).withColumn("y0", F.when(F.col("page").isNotNull(), F.col("start"))).withColumn("x0", F.lit(0))
    return review.reading_order(at).select("doc_id", "span_id", "place")


@query("next_and_previous", f"WITH {_SPANS_SQL} SELECT doc_id, span_id, coalesce(lead(span_id) OVER w, first(span_id) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS next_id, coalesce(lag(span_id) OVER w, last(span_id) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS previous_id FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY start_at)")
def next_and_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.neighbours(_spans(spark, sf_dir)).select("doc_id", "span_id", "next_id", "previous_id")


@query("span_destinations", f"WITH {_SPANS_SQL} SELECT CASE WHEN NOT removed THEN 'kept' WHEN operator = 'pseudonimo' AND fits THEN 'token' WHEN operator = 'pseudonimo' THEN 'bar_no_room' ELSE 'bar' END AS destination, count(*) AS n FROM spans GROUP BY 1")
def span_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _spans(spark, sf_dir).select(review.destination(F.col("removed"), F.col("operator"), F.col("fits")).alias("destination"))
    return at.groupBy("destination").agg(F.count("*").alias("n"))


@query("tokens_without_room", f"WITH {_SPANS_SQL} SELECT entity, count(*) AS n FROM spans WHERE removed AND operator = 'pseudonimo' AND NOT fits GROUP BY 1")
def tokens_without_room(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.wanted_tokens_without_room(_spans(spark, sf_dir))


@query("fragment_flags", "SELECT c_custkey AS doc_id, c_custkey % 4 IN (1, 2) AS fragment FROM customer")
def fragment_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    at = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit("Maria Souza, aqui.").alias("body"), F.when(k == 1, 1).otherwise(0).alias("start"), F.when(k == 2, 8).when(k == 3, 5).otherwise(11).alias("end"))
    return at.select("doc_id", review.is_fragment(F.col("body"), F.col("start"), F.col("end")).alias("fragment"))


@query("shown_spans", f"WITH {_SPANS_SQL} SELECT removed OR (span_id % 3 <> 0 AND (span_id % 5 = 0 OR span_id % 7 = 0)) AS shown, count(*) AS n FROM spans GROUP BY 1")
def shown_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("span_id")
    shown = review.is_shown(F.col("removed"), i % 3 == 0, F.when(i % 5 == 0, "usuario").otherwise("detector"), F.when(i % 7 == 0, False))
    return _spans(spark, sf_dir).groupBy(shown.alias("shown")).agg(F.count("*").alias("n"))


@query("mark_term", "SELECT c_custkey AS doc_id, v.s AS \"start\", v.e AS \"end\" FROM customer, (VALUES (0, 9), (12, 22), (27, 36)) v(s, e) WHERE NOT (c_custkey % 2 = 0 AND v.s = 0)")
def mark_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = F.expr("case when c_custkey % 2 = 0 then array(struct(4 as start, 9 as end)) else array() end").cast("array<struct<start:int,end:int>>")
    at = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit("Ana Souza e Ana  Souza com Ana\nSouza.").alias("text"), active.alias("spans"))
    return review.mark_term(at, "Ana Souza").select("doc_id", "start", "end")


@query("repair_selection", "SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 3 = 2 THEN -1 ELSE 6 END AS \"start\", CASE WHEN c_custkey % 3 = 2 THEN -1 ELSE 11 END AS \"end\" FROM customer")
def repair_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 3
    at = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit("Maria Souza aqui").alias("body"), F.when(k == 0, 6).otherwise(3).alias("s"), F.when(k == 0, 11).otherwise(9).alias("e"), F.when(k == 0, "Souza").when(k == 1, " Souza").otherwise("Zeca").alias("claimed"))
    at = at.withColumn("r", review.repaired(F.col("body"), F.col("s"), F.col("e"), F.col("claimed")))
    return at.select("doc_id", F.coalesce("r.start", F.lit(-1)).alias("start"), F.coalesce("r.end", F.lit(-1)).alias("end"))


@query("document_facts", "SELECT l_orderkey AS doc_id, count(*) AS pages, sum(l_linenumber)::BIGINT AS links, count(*) FILTER (l_returnflag = 'N') AS empty_pages, bool_or(l_linestatus = 'F') AS signed FROM lineitem GROUP BY 1")
def document_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("links"), F.when(F.col("l_returnflag") == "N", "  ").otherwise("x").alias("text"), F.lit(0).alias("bookmarks"), F.lit(0).alias("attachments"), (F.col("l_linestatus") == "F").alias("signed"))
    return review.document_facts(at).select("doc_id", "pages", "links", "empty_pages", "signed")


@query("review_stages", "SELECT CASE c_custkey % 4 WHEN 0 THEN 'exported' WHEN 1 THEN 'verified' WHEN 2 THEN 'reviewing' ELSE 'empty' END AS stage, c_custkey % 8 = 0 AS download, count(*) AS n FROM customer GROUP BY ALL")
def review_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    at = table(spark, sf_dir, "customer").select(review.stage(k % 4 == 2, F.when(k % 4 == 1, True), k % 4 == 0).alias("stage"), review.can_download(k % 4 == 0, k % 8 == 0, F.lit(True)).alias("download"))
    return at.groupBy("stage", "download").agg(F.count("*").alias("n"))


@query("amounts_and_sizes", "SELECT n_nationkey, 'R$ ' || v.a AS amount, v.s AS size, v.f AS fits FROM nation JOIN (VALUES (0, '1.234,50', '512 B', true), (1, '12.345.678,00', '5 KB', false), (2, '0,99', '2.5 MB', true)) v(i, a, s, f) ON n_nationkey % 3 = v.i")
def amounts_and_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey") % 3
    pick = lambda *v: F.when(k == 0, v[0]).when(k == 1, v[1]).otherwise(v[2])
    return table(spark, sf_dir, "nation").select("n_nationkey", review.reais(pick(1234.5, 12345678.0, 0.99)).alias("amount"), review.file_size(pick(512, 5120, 2621440)).alias("size"), review.fits_cp1252(pick("ação", "漢", "€ 1")).alias("fits"))


@query("send_log", "SELECT o_custkey AS doc_id, count(*) AS sends, max(o_orderkey) AS last_send, sum(o_shippriority_len)::BIGINT AS characters FROM (SELECT *, length(o_orderpriority) AS o_shippriority_len FROM orders) GROUP BY 1")
def send_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sends are logged by their facts alone, never by their content."""
    at = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), "o_orderkey", F.length("o_orderpriority").alias("size"))
    return at.groupBy("doc_id").agg(F.count("*").alias("sends"), F.max("o_orderkey").alias("last_send"), F.sum("size").alias("characters"))


@query("trimmed_values", "SELECT DISTINCT o_orderpriority AS value FROM orders")
def trimmed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = table(spark, sf_dir, "orders").select(F.concat(F.lit(" \t"), "o_orderpriority", F.lit("\n ")).alias("v"))
    return at.select(text.collapsed(F.regexp_replace("v", r"^\s+|\s+$", "")).alias("value")).distinct()


@query("stream_redact")
def stream_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a stream, redacted; a bounded run of what would go on. Its files are in the shared folder, so the
    driver holds none of the rows."""
    path = f"{sf_dir}/documents.parquet"
    source = spark.readStream.schema(spark.read.parquet(path).select("doc_id", "text").schema).option("recursiveFileLookup", "true").parquet(path if _is_folder(spark, path) else f"{sf_dir}/documents.parque[t]")
    redacted, rows, progress = streams.redact_stream(source), scratch.new_folder(spark, "redacted"), scratch.new_folder(spark, "progress")
    running = redacted.writeStream.format("parquet").option("path", rows).option("compression", "zstd").option("checkpointLocation", progress).outputMode("append").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(redacted.schema).parquet(rows)


def _is_folder(spark: SparkSession, path: str) -> bool:
    system, where = scratch.place(spark, path)
    return system.getFileStatus(where).isDirectory()
