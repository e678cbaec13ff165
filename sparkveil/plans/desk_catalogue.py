"""Queries of gates and summaries, marks made by hand, leaks by value, sending, pages and segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkveil.functions import dims
from sparkveil.operators import evaluate, layout, policy, recognizers, resolve, review, rewrite, session, verify
from sparkveil.plans import templates as t
from sparkveil.plans.catalogue import _SPANS_SQL, P, _spans_table, query, table


@query("gate_marks", "SELECT o_orderkey, printf('%.3f ', (o_orderkey % 100) / 100) || CASE WHEN o_orderkey % 100 >= 95 THEN '✅' ELSE '❌' END || ' (alvo 0.95)' AS mark FROM orders")
def gate_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = (F.col("o_orderkey") % 100) / 100
    return table(spark, sf_dir, "orders").select("o_orderkey", evaluate.gate(value, evaluate.STRICT_TARGET).alias("mark"))


@query("email_forms", "SELECT c_custkey AS k, c_custkey % 4 < 2 AS valid FROM customer")
def email_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    form = F.when(k % 4 == 0, F.concat(F.lit(" A"), k.cast("string"), F.lit("@b.co\n"))).when(k % 4 == 1, "x.y+z@a-b.c.d").when(k % 4 == 2, "a@b").otherwise("a b@c.de")
    return table(spark, sf_dir, "customer").select(k.alias("k"), session.is_email(form).alias("valid"))


@query("post_redaction", "SELECT o_orderpriority AS config, count(*) AS docs, count(*) FILTER (o_orderkey % 7 <> 0) AS clean, count(*) FILTER (o_orderkey % 3 = 0) AS without_residue, sum(o_orderkey % 2)::BIGINT AS without_box, bool_and(o_orderkey % 7 <> 0) AS passes FROM orders GROUP BY 1")
def post_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    return evaluate.post_redaction(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("config"), o.alias("doc_id"), (o % 7 != 0).alias("ok"), F.when(o % 3 != 1, o % 3 == 0).alias("residue_ok"), (o % 2).alias("without_box")))


@query("best_config", "WITH f AS (SELECT o_orderpriority AS config, max(CASE WHEN o_orderstatus = 'F' THEN (o_orderkey % 97) / 100 END) AS f1 FROM orders GROUP BY 1) SELECT config, f1 FROM f ORDER BY f1 DESC, config LIMIT 1")
def best_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("config"), F.when(F.col("o_orderstatus") == "F", "PERSON").otherwise("CPF").alias("label"), ((F.col("o_orderkey") % 97) / 100).alias("f1"))
    return evaluate.best_config(scored)


@query("scores_by_support", "SELECT label, support, row_number() OVER (ORDER BY support DESC, label) AS place FROM (SELECT o_orderpriority AS label, count(*) FILTER (o_orderkey % 3 = 0) AS support FROM orders GROUP BY 1)")
def scores_by_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("label")).agg(F.count_if(o % 6 == 0).alias("tp"), F.count_if(o % 5 == 0).alias("fp"), F.count_if(o % 6 == 3).alias("fn"))
    at = evaluate.by_support(evaluate.scores(counts)).select("label", "support")
    return at.select("label", "support", (F.monotonically_increasing_id() + 1).alias("place"))


@query("ordered_inventory", f"WITH {_SPANS_SQL}, n AS (SELECT d.entity, count(s.span_id) AS n FROM (VALUES {', '.join(f'({chr(39)}{e}{chr(39)})' for e in dims.NAMES)}) d(entity) LEFT JOIN spans s ON s.entity = d.entity AND s.entity NOT IN ('RG', 'CEP') GROUP BY 1) SELECT entity, n, row_number() OVER (ORDER BY n = 0, -n, entity) AS place FROM n")
def ordered_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.ordered_inventory(_spans_table(spark, sf_dir).where("entity NOT IN ('RG', 'CEP')")).select("entity", "n", F.col("place").cast("bigint").alias("place"))


@query("search_top_groups", "SELECT n_name AS value, n_nationkey AS first FROM nation WHERE contains(lower(n_name), 'an') ORDER BY n_nationkey LIMIT 6")
def search_top_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.search_groups(table(spark, sf_dir, "nation").select(F.col("n_name").alias("value"), F.col("n_nationkey").alias("first")), "value", "Àn")


@query("users_by_creation", "SELECT s_suppkey AS user_id, row_number() OVER (ORDER BY s_suppkey * 7919 % 1000, s_suppkey) AS place FROM supplier WHERE s_nationkey = 3")
def users_by_creation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    users = table(spark, sf_dir, "supplier").select(s.alias("user_id"), F.col("s_nationkey").alias("tenant_id"), (s * 7919 % 1000).alias("created"))
    return session.colleagues(users, F.lit(3)).coalesce(1).select("user_id", (F.monotonically_increasing_id() + 1).alias("place"))


# Marks made by hand.

_TERM_TEXT = "Ana Souza e Ana  Souza com Ana\nSouza, AnaSouza."


def _term_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text for all; of its three places a span covers the first in even documents, and the last can be seen on no
    page in each third."""
    k = F.col("c_custkey")
    span = "array<struct<start:int,end:int>>"
    spans = F.when(k % 2 == 0, F.expr(f"cast(array(struct(4 as start, 9 as end)) as {span})")).otherwise(F.array().cast(span))
    regions = F.expr("array(struct(0 as start, 10 as end, 1 as page), struct(12 as start, 22 as end, 2 as page), struct(if(c_custkey % 3 = 0, 48, 27) as start, if(c_custkey % 3 = 0, 49, 30) as end, 2 as page))")
    pages = F.array(F.lit(_TERM_TEXT[:22]), F.lit(_TERM_TEXT[22:]))
    return table(spark, sf_dir, "customer").select(k.alias("doc_id"), F.lit(_TERM_TEXT).alias("text"), spans.alias("spans"), regions.alias("regions"), pages.alias("pages"))


@query("preview_term", """SELECT c_custkey AS doc_id, (3 - (c_custkey % 2 = 0)::INT - (c_custkey % 3 = 0)::INT)::BIGINT AS new, (c_custkey % 2 = 0)::BIGINT AS covered, (c_custkey % 3 = 0)::BIGINT AS without_region,
CASE WHEN c_custkey % 2 = 0 THEN '2' ELSE '1,2' END AS on_pages, 3::BIGINT AS in_text, (c_custkey % 3 = 0)::BIGINT AS left_over FROM customer""")
def preview_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.preview_term(_term_docs(spark, sf_dir), " Ana Souza ").withColumn("on_pages", F.array_join(F.col("on_pages").cast("array<string>"), ","))


@query("mark_visible_term", """SELECT c_custkey AS doc_id, v.s AS "start", v.e AS "end" FROM customer, (VALUES (0, 9), (12, 22), (27, 36)) v(s, e) WHERE NOT (c_custkey % 2 = 0 AND v.s = 0) AND NOT (c_custkey % 3 = 0 AND v.s = 27)""")
def mark_visible_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.mark_term(_term_docs(spark, sf_dir), "Ana Souza", regions="regions").select("doc_id", "start", "end")


@query("added_interval", """SELECT c_custkey AS doc_id, CASE c_custkey % 5 WHEN 0 THEN 11 WHEN 1 THEN 11 WHEN 4 THEN 16 END AS "start", CASE c_custkey % 5 WHEN 0 THEN 20 WHEN 1 THEN 20 WHEN 4 THEN 21 END AS "end", CASE c_custkey % 5 WHEN 2 THEN 'overlap' WHEN 3 THEN CASE WHEN c_custkey % 2 = 0 THEN 'bounds' ELSE 'text' END END AS problem FROM customer""")
def added_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selections of 'Ana\\n Souza' as given, off by some, over a span, beyond the end or of a text that is not there, and
    with white space around."""
    k = F.col("c_custkey") % 5
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (k + 1).cast("int"))
    lost = (k == 3) & (F.col("c_custkey") % 2 == 0)
    at = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit("Assinado x Ana\nSouza hoje").alias("body"), pick(11, 3, 0, 0, 15).alias("s"), F.when(lost, 99).otherwise(pick(20, 12, 8, 4, 21)).alias("e"), pick("Ana Souza", "Ana   Souza", "Assinado", "Zeca", "  Souza ").alias("c"), F.expr("array(struct(4 as start, 6 as end))").alias("spans"))
    at = at.withColumn("e", F.when(F.col("doc_id") % 5 == 4, F.lit(21)).otherwise(F.col("e"))).withColumn("s", F.when(F.col("doc_id") % 5 == 4, F.lit(14)).otherwise(F.col("s")))
    body = F.when(F.col("doc_id") % 5 == 4, F.lit("Assinado x Ana \nSouza hoje")).otherwise(F.col("body"))
    return at.select("doc_id", F.inline(F.array(review.added_interval(body, F.col("s"), F.col("e"), F.col("c"), F.col("spans"))))).select("doc_id", "start", "end", "problem")


@query("token_plan", "SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS tokens, 1::BIGINT AS lost, CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 1 END::BIGINT AS without_room FROM customer")
def token_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CPF over a person, and an e-mail whose box has room for its token in even documents."""
    rows = F.expr("array(struct(0 as start, 14 as end, 'CPF' as entity, 1d as score, '[CPF-1234]' as token, 90d as width), struct(5 as start, 30 as end, 'PERSON' as entity, 0.9d as score, '[P-00AA]' as token, 90d as width), struct(40 as start, 60 as end, 'EMAIL' as entity, 0.75d as score, '[MAIL-00AB]' as token, if(doc_id % 2 = 0, 90d, 20d) as width))")
    at = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id")).select("doc_id", F.inline(rows)).withColumn("height", F.lit(12.0))
    return review.token_plan(at)


@query("span_view", f"WITH {_SPANS_SQL} SELECT doc_id, span_id, round(span_id % 1000 / 1000 + 0.0004, 3) AS score, span_id % 3 = 0 AS removed, CASE WHEN span_id % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS n_rects, CASE WHEN span_id % 5 = 0 THEN 'T' || span_id END AS token FROM spans")
def span_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("span_id")
    at = _spans_table(spark, sf_dir).withColumns({"start": s, "end": s + 1, "score": s % 1000 / 1000 + 0.0004, "active": F.when(s % 3 != 1, s % 3 == 0), "operator": F.lit("manter")})
    boxes = at.where(s % 2 == 0).select("doc_id", "start", "end", F.lit(1).alias("page"), *(F.lit(0.0).alias(c) for c in ("x0", "y0", "x1", "y1")))
    tokens = at.where(s % 5 == 0).select("doc_id", "start", "end", F.concat(F.lit("T"), s.cast("string")).alias("token"))
    return review.span_view(at, boxes, tokens).select("doc_id", "span_id", "score", "removed", F.coalesce(F.size("rects"), F.lit(0)).cast("bigint").alias("n_rects"), "token")


@query("neutral_names", "SELECT n_nationkey, printf('documento-%02d', row_number() OVER (ORDER BY n_nationkey)) AS name FROM nation")
def neutral_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.numbered(table(spark, sf_dir, "nation"), "n_nationkey").select("n_nationkey", "name")


@query("authors", f"WITH {_SPANS_SQL} SELECT doc_id, 'Ana ' || min(span_id) AS author FROM spans WHERE entity = 'PERSON' GROUP BY 1")
def authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _spans_table(spark, sf_dir).withColumn("start", F.col("span_id")).withColumn("value", F.concat(F.lit("Ana "), F.col("span_id").cast("string")))
    return review.authors(at)


@query("model_spans", """SELECT c_custkey AS doc_id, v.entity, v.s AS "start", v.e AS "end", v.score FROM customer, (VALUES ('PERSON', 0, 9, 0.9::DOUBLE), ('LOCATION', 13, 19, 0.6::DOUBLE), ('DATE_TIME', 24, 34, 0.95::DOUBLE)) v(entity, s, e, score)""")
def model_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of a model: a name in two pieces with a comma after it, a place across a line end, a date with a piece inside
    it, a law, and a weak guess."""
    rows = F.expr("array(struct('PER' as entity, 0 as start, 3 as end, 0.7d as score), struct('PER' as entity, 3 as start, 10 as end, 0.9d as score), struct('LOCAL' as entity, 11 as start, 21 as end, 0.6d as score), struct('TEMPO' as entity, 24 as start, 34 as end, 0.8d as score), struct('TEMPO' as entity, 27 as start, 32 as end, 0.95d as score), struct('LEGISLACAO' as entity, 0 as start, 9 as end, 0.9d as score), struct('ORG' as entity, 0 as start, 9 as end, 0.4d as score))")
    at = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit("Ana Souza, \n Recife \nem 18/02/2026").alias("text"), F.inline(rows))
    return resolve.model_spans(at).select("doc_id", "entity", "start", "end", "score")


@query("mapped_labels", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'ORGANIZATION' ELSE 'DATE_TIME' END AS entity FROM orders WHERE o_orderkey % 4 < 3")
def mapped_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.element_at(F.array(*map(F.lit, ("PESSOA", "ORG", "TEMPO", "JURISPRUDENCIA"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return resolve.map_labels(table(spark, sf_dir, "orders").select("o_orderkey", tag.alias("entity")))


# Leaks, sending, versions.


def _objects(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two values a document; an object that has the first in hexadecimal and the second as it is, one that has the
    first both ways, and one without."""
    at = t.people(spark, sf_dir).select(F.col("k").alias("doc_id"), "cpf", F.expr(t.written("EMAIL", "masked")).alias("mail"))
    hexed = F.concat(F.lit("BT <"), F.hex(F.encode("cpf", "US-ASCII")), F.lit("> Tj "))
    none = F.lit(None).cast("string")
    rows = F.array(*(F.struct(F.lit(i).alias("object_id"), c.alias("content"), a.alias("subtype"), b.alias("type"), f.alias("filter")) for i, (c, a, b, f) in enumerate([(F.concat(hexed, "mail"), F.lit("/Form"), F.lit("/XObject"), F.lit("/FlateDecode")), (F.concat(hexed, "cpf"), F.lit("/Annot"), F.lit("/Annot"), none), (F.lit("BT ET"), none, none, none)], 7)))
    return at.select("doc_id", F.explode(F.array("cpf", "mail")).alias("value")), at.select("doc_id", F.inline(rows))


@query("stream_leaks", f"WITH {P}, v AS (SELECT k, cpf AS value, 7 AS o, 'Form/XObject/FlateDecode' AS what FROM p UNION ALL SELECT k, cpf, 8, 'Annot' FROM p UNION ALL SELECT k, {t.written('EMAIL', 'masked')}, 7, 'Form/XObject/FlateDecode' FROM p) SELECT k AS doc_id, 'streams' AS surface, o AS object_id, value, value || ', em ' || what || ' (xref ' || o || ')' AS detail FROM v")
def stream_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.stream_leaks(*_objects(spark, sf_dir))


@query("object_names", "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'Form/XObject' WHEN 1 THEN 'Font' ELSE 'objeto sem tipo declarado' END AS name FROM nation")
def object_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey") % 3
    return table(spark, sf_dir, "nation").select("n_nationkey", verify.described(F.when(k == 0, "/Form").when(k == 1, "/Font"), F.when(k == 0, "/XObject").when(k == 1, "/Font"), F.lit(None).cast("string")).alias("name"))


@query("raw_bytes", "SELECT c_custkey AS doc_id, c_custkey % 4 <> 3 AS leaks FROM customer")
def raw_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name in bytes of three encodings, and bytes of no encoding."""
    k = F.col("c_custkey") % 4
    name = F.lit("João Araújo")
    content = F.when(k == 0, F.encode(name, "UTF-8")).when(k == 1, F.encode(name, "ISO-8859-1")).when(k == 2, F.encode(name, "UTF-16BE")).otherwise(F.unhex(F.lit("FFFE80C3284A6F")))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), (F.size(verify.leaked_values(verify.raw_surface(content), F.array(name))) > 0).alias("leaks"))


def _dissected(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = t.people(spark, sf_dir).select(F.col("k").alias("doc_id"), "cpf", F.expr(t.written("CPF", "masked")).alias("m"), F.expr(t.written("EMAIL", "masked")).alias("mail"))
    rows = F.array(F.struct(F.lit("streams").alias("surface"), F.col("mail").alias("value"), F.lit("x, em Form (xref 3)").alias("detail")), F.struct(F.lit("bytes-brutos").alias("surface"), F.col("m").alias("value"), F.col("m").alias("detail")), F.struct(F.lit("texto").alias("surface"), F.col("m").alias("value"), F.col("m").alias("detail")), F.struct(F.lit("bytes-brutos").alias("surface"), F.col("m").alias("value"), F.col("m").alias("detail")))
    pages = at.select("doc_id", F.posexplode(F.array(F.lit("nada"), F.concat("m", F.lit(" e "), "cpf"), F.col("m"))).alias("page", "content")).withColumn("page", F.col("page") + 1)
    found = at.where("doc_id % 4 <> 3").select("doc_id", F.inline(rows))
    return verify.dissected(found, pages)


@query("dissected_leaks", f"""WITH {P} SELECT k AS doc_id, value, surfaces, first_surface, occurrences::BIGINT AS occurrences, pages, is_visible, object, place FROM (
SELECT k, {t.written('CPF', 'masked')} AS value, 'texto,bytes-brutos' AS surfaces, 'texto' AS first_surface, 3 AS occurrences, '2,3' AS pages, true AS is_visible, '' AS object, 1 AS place FROM p
UNION ALL SELECT k, {t.written('EMAIL', 'masked')}, 'streams', 'streams', 0, '', false, 'Form (xref 3)', 2 FROM p) WHERE k % 4 <> 3""")
def dissected_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dissected(spark, sf_dir).withColumn("surfaces", F.array_join("surfaces", ",")).withColumn("pages", F.array_join(F.col("pages").cast("array<string>"), ",")).select("doc_id", "value", "surfaces", "first_surface", "occurrences", "pages", "is_visible", "object", "place")


@query("pending_leaks", "SELECT c_custkey AS doc_id, 1::BIGINT AS n FROM customer WHERE c_custkey % 4 <> 3 AND c_custkey % 2 = 1")
def pending_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can be read, of the current versions: results are of version 1, and even documents are at version 2."""
    edits = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.when(F.col("c_custkey") % 2 == 1, 1).otherwise(2).alias("version"))
    return verify.pending(_dissected(spark, sf_dir).withColumn("version", F.lit(1)), edits, legible=True).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("preverified", f"WITH {P} SELECT k AS doc_id, (k % 3)::INTEGER AS version, CASE WHEN k % 6 = 0 THEN true ELSE k % 2 = 0 END AS ok, CASE WHEN k % 6 = 0 OR k % 2 = 0 THEN 0 ELSE 1 END::BIGINT AS n_leaks, k % 6 = 0 AS from_cache FROM p")
def preverified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd documents leak; a result of version 0 is in the cache for each sixth, one of another version for others."""
    at = t.people(spark, sf_dir).withColumn("m", F.expr(t.written("CPF", "masked")))
    proposed = at.select(F.col("k").alias("doc_id"), (F.col("k") % 3).cast("int").alias("version"), F.when(F.col("k") % 2 == 1, F.col("cpf")).otherwise("[CPF-0001]").alias("rewritten"), F.array("m").alias("values"), F.array().cast("array<string>").alias("tokens"))
    cache = at.where("k % 6 IN (0, 1)").select(F.col("k").alias("doc_id"), F.lit(0).alias("version"), F.lit(True).alias("ok"), F.lit(0).alias("n_leaks"))
    return verify.preverified(proposed, cache)


@query("found_before_sending", f"WITH {P} SELECT k AS doc_id, CASE k % 4 WHEN 0 THEN 'CPF' WHEN 1 THEN 'CNH' END AS entity, 11::INTEGER AS \"start\", CASE k % 4 WHEN 0 THEN 25 ELSE 22 END::INTEGER AS \"end\" FROM p WHERE k % 4 < 2 AND NOT (k % 4 = 1 AND (cpf = cnh OR pis_pasep = cnh))")
def found_before_sending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs with tokens: an identifier left in one, a number that only the low threshold finds in another, a CEP that
    the policy keeps, and nothing. Numbers with the check digits of several kinds count where these are."""
    at = t.people(spark, sf_dir).withColumn("m", F.expr(t.written("CPF", "masked"))).withColumn("z", F.expr(t.written("CEP", "masked")))
    body = F.when(F.col("k") % 4 == 0, F.concat(F.lit("[P-00AA] e "), "m", F.lit(" fim"))).when(F.col("k") % 4 == 1, F.concat(F.lit("[P-00AA] e "), "cnh", F.lit(" fim"))).when(F.col("k") % 4 == 2, F.concat(F.lit("[P-00AA] e "), "z")).otherwise("[CPF-1A2B] [CEP-0009]")
    rules = F.create_map(F.lit("CEP"), F.lit("manter"))
    found = rewrite.found_before_sending(at.select(F.col("k").alias("doc_id"), body.alias("rewritten")), rules, F.lit("tarja"))
    one = F.when(F.col("doc_id") % 4 == 1, "CNH").otherwise(F.col("entity"))
    return found.select("doc_id", one.alias("entity"), "start", "end").distinct()


@query("settled_edits", "SELECT event_id FROM (SELECT event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS later FROM events) WHERE later IS NULL OR later >= ts + INTERVAL 90 MINUTES")
def settled_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.settled(table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("doc_id"), "ts"), "90 minutes").select("event_id")


@query("forgotten_owners", "SELECT DISTINCT o_orderkey AS doc_id FROM orders WHERE o_custkey % 3 <> 0")
def forgotten_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("c"))
    return session.forget(owners, owners.where("c % 3 = 0")).select("doc_id")


@query("utc_times", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS minute FROM events")
def utc_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("s"))
    utc = session.as_utc(F.to_timestamp("s", "yyyy-MM-dd HH:mm"))
    shown = F.from_utc_timestamp(F.lit("1970-01-01").cast("timestamp"), "UTC")  # the epoch, whatever the session's zone
    minutes = F.floor((F.unix_micros(utc) - F.unix_micros(shown)) / 60_000_000)
    return at.select("event_id", F.date_format(F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_interval(mins=minutes.cast("int")), "yyyy-MM-dd HH:mm").alias("minute"))


# Pages, lines, segments and windows.


@query("pagination", "SELECT doc_id, seq, (n // 3 + 1)::INTEGER AS page, (10 + n % 3 * 12)::DOUBLE AS y FROM (SELECT l_orderkey AS doc_id, l_extendedprice AS seq, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice) - 1 AS n FROM lineitem)")
def pagination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of one height, three a page."""
    at = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_extendedprice").alias("seq"), F.lit(12.0).alias("height"))
    return layout.paginate(at, 10.0, 34.0)


@query("prose_lines", "SELECT c_custkey AS doc_id, v.i, v.line FROM customer, (VALUES (0, repeat('palavra ', 11) || 'fim'), (1, repeat('x', 92)), (2, repeat('x', 8) || ' ok')) v(i, line)")
def prose_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.lit("palavra \n " * 11 + "fim " + "x" * 100 + "\tok ")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.posexplode(layout.prose(body)).alias("i", "line"))


@query("segment_forms", "SELECT c_custkey AS doc_id, v.i::INTEGER AS i, v.text, v.label FROM customer JOIN (VALUES (0, 0, 'só texto', NULL), (1, 0, '529', 'CPF'), (2, 0, 'CPF ', NULL), (2, 1, '529', 'CPF'), (2, 2, '.', NULL)) v(m, i, text, label) ON c_custkey % 3 = v.m")
def segment_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 3
    content = F.when(k == 0, '"só texto"').when(k == 1, '["529", "CPF"]').otherwise('["CPF ", ["529", "CPF"], "."]')
    at = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.posexplode(layout.segments(content)).alias("i", "s"))
    return at.select("doc_id", "i", "s.text", "s.label")


@query("model_windows", "SELECT c_custkey AS doc_id, v.s AS \"start\", v.e AS \"end\" FROM customer JOIN (VALUES (0, 0, 1197), (0, 997, 2191), (0, 1991, 3185), (0, 2985, 3500), (1, 0, 1200), (1, 1000, 1500), (2, 0, 5)) v(m, s, e) ON c_custkey % 3 = v.m")
def model_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of six letters and a space, one long word, and a short text."""
    k = F.col("c_custkey") % 3
    at = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.when(k == 0, "abcdef " * 500).when(k == 1, "x" * 1500).otherwise("curto").alias("body"))
    return at.select("doc_id", F.inline(layout.windows("body")))


@query("text_map", "SELECT c_custkey AS doc_id, 'ab cd' || chr(10) || 'ef' || chr(10) || 'gh' || chr(10) AS text, 8::BIGINT AS boxed FROM customer")
def text_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two lines of a page, the first in two pieces that stand apart, and of another page."""
    rows = F.expr("array(struct(2 as page, 1 as block, 1 as line, 1 as seq, 0d as x0, 10d as x1, 'gh' as content), struct(1 as page, 1 as block, 1 as line, 2 as seq, 15d as x0, 25d as x1, 'cd' as content), struct(1 as page, 1 as block, 1 as line, 1 as seq, 0d as x0, 10d as x1, 'ab' as content), struct(1 as page, 1 as block, 2 as line, 1 as seq, 0d as x0, 10d as x1, 'ef' as content))")
    at = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.inline(rows)).withColumn("y0", F.lit(0.0)).withColumn("y1", F.lit(12.0))
    chars = layout.text_map(at)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ch"))), lambda x: x["ch"]), "")
    return chars.groupBy("doc_id").agg(whole.alias("text"), F.count("x0").alias("boxed"))


@query("detected_entities", f"WITH {P}, gold AS ({t.gold_sql()}) SELECT doc_id, count(*) AS n FROM gold WHERE label IN ('CEP', 'EMAIL') GROUP BY 1")
def detected_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection of two entities alone."""
    found = recognizers.detect(t.contracts(spark, sf_dir), entities=("CEP", "EMAIL"))
    return recognizers.exploded(found).groupBy("doc_id").agg(F.count("*").alias("n"))


# Policies, uploads, reports, edits of texts.

_MODES = ("manter", "tarja", "pseudonimo")


@query("manual_operators", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN CASE WHEN d <> 'manter' THEN d ELSE 'tarja' END WHEN r <> 'manter' THEN r WHEN d <> 'manter' THEN d ELSE 'tarja' END AS operator FROM (SELECT n_nationkey, ['manter', 'tarja', 'pseudonimo'][(n_nationkey % 3 + 1)::INT] AS d, ['manter', 'tarja', 'pseudonimo'][(n_nationkey // 3 % 3 + 1)::INT] AS r FROM nation)")
def manual_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What removes a span: marked by hand or of a class with a rule, under each default."""
    pick = lambda i: F.element_at(F.array(*map(F.lit, _MODES)), (i % 3 + 1).cast("int"))
    k = F.col("n_nationkey")
    at = table(spark, sf_dir, "nation").select(k, pick(k).alias("d"), pick(F.floor(k / 3)).alias("r"))
    entity = F.when(k % 2 == 0, "MANUAL").otherwise("CPF")
    return at.select("n_nationkey", policy.span_operator(entity, F.create_map(F.lit("CPF"), F.col("r")), F.col("d")).alias("operator"))


@query("policy_modes", "SELECT n_nationkey, e.entity, CASE WHEN e.entity = 'CEP' THEN 'manter' WHEN e.entity = 'CPF' AND n_nationkey % 2 = 0 THEN 'manter' ELSE 'pseudonimo' END AS operator FROM nation, (VALUES ('CPF'), ('RG'), ('CEP')) e(entity)")
def policy_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules brought to one mode, after one of them was changed."""
    first = F.when(F.col("n_nationkey") % 2 == 0, "manter").otherwise("tarja")
    rules = F.create_map(F.lit("CPF"), first, F.lit("RG"), F.lit("tarja"), F.lit("CEP"), F.lit("tarja"))
    changed = policy.with_mode(policy.with_rule(rules, "CEP", "manter"), "pseudonimo")
    return table(spark, sf_dir, "nation").select("n_nationkey", F.explode(changed).alias("entity", "operator"))


@query("policy_round_trip", "SELECT 'perfil ' || n_nationkey AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'manter' ELSE 'tarja' END AS fallback, CASE WHEN n_nationkey % 3 = 0 THEN 0 ELSE 1 END::INTEGER AS n_rules, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_nationkey / 100 END::DOUBLE AS threshold FROM nation")
def policy_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles as JSON with parts missing, read, written and read again."""
    k = F.col("n_nationkey")
    parts = [F.concat(F.lit('"name": "perfil '), k.cast("string"), F.lit('"')), F.when(k % 2 == 1, F.lit('"default": "tarja"')), F.when(k % 3 != 0, F.lit('"rules": {"CPF": "pseudonimo"}')), F.when(k % 5 != 0, F.concat(F.lit('"threshold": '), (k / 100).cast("string")))]
    given = table(spark, sf_dir, "nation").select(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")).alias("value"))
    read = policy.from_json(policy.to_json(policy.from_json(given)))
    return read.select("name", F.col("default").alias("fallback"), F.size("rules").alias("n_rules"), "threshold")


@query("upload_statuses", "SELECT c_custkey AS k, [400, 415, 422, 422, 422, 413, 201][(c_custkey % 7 + 1)::INT]::INTEGER AS status FROM customer")
def upload_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty, of another kind, encrypted, without references, without text, too large, and good."""
    from sparkveil.sources import readers

    k = F.col("c_custkey") % 7
    good = "%PDF-1.7 (/Encrypt in a text) trailer << /Root 1 0 R >> startxref 9 %%EOF"
    body = F.when(k == 0, "").when(k == 1, "ola").when(k == 2, good.replace("/Root", "/Encrypt 5 0 R /Root")).when(k == 3, "%PDF-1.7").otherwise(good)
    at = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.encode(body, "UTF-8").alias("content"), F.when(k == 4, " \n").otherwise("x").alias("text"))
    size = F.when(F.col("k") % 7 == 5, readers.MOST_BYTES + 1).otherwise(F.length("content"))
    return at.select("k", readers.upload_status(F.col("content"), size, F.col("text")).alias("status"))


@query("report_lines", "SELECT 0::BIGINT AS line_no, '| r_name | r_regionkey |' AS line UNION ALL SELECT 1, '|---|---|' UNION ALL SELECT row_number() OVER (ORDER BY r_name DESC) + 1, '| ' || r_name || ' | ' || r_regionkey || ' |' FROM region")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkveil.sources import readers

    lines = readers.markdown(table(spark, sf_dir, "region"), ["r_name", "r_regionkey"], [F.desc("r_name")])
    return lines.select(F.col("line_no").cast("bigint").alias("line_no"), "line")


@query("blank_texts", "SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 4 = 3 THEN 1 ELSE 0 END::INTEGER AS n FROM customer")
def blank_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    body = F.when(k == 0, F.lit(None).cast("string")).when(k == 1, "").when(k == 2, " \n\t\u00a0\u2003").otherwise("a@b.co")
    return recognizers.detect(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), body.alias("text"))).select("doc_id", F.size("spans").alias("n"))


@query("spliced_texts", "SELECT c_custkey AS doc_id, '<' || c_custkey || '>' || '<x>' || substr('abcdefgh', (c_custkey % 5 + 3)::INT) AS rewritten FROM customer")
def spliced_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits that touch, the second given first."""
    k = (F.col("c_custkey") % 5).cast("int")
    edits = F.array(F.struct((k + 1).alias("start"), (k + 2).alias("end"), F.lit("<x>").alias("put")), F.struct(F.lit(0).alias("start"), (k + 1).alias("end"), F.concat(F.lit("<"), F.col("c_custkey").cast("string"), F.lit(">")).alias("put")))
    at = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit("abcdefgh").alias("text"), edits.alias("edits"))
    return rewrite.splice(at).select("doc_id", "rewritten")


@query("defect_rate", f"WITH {P}, gold AS ({t.gold_sql()}) SELECT count(*) FILTER (contains(value, ', ')) AS defects, count(*) AS gold, count(*) FILTER (contains(value, ', ')) / count(*) AS rate FROM gold")
def defect_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkveil.plans.catalogue import align_gold

    return evaluate.defect_rate(align_gold(spark, sf_dir))
