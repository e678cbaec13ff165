"""Registered queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkveil.functions import checkdigits as cd
from sparkveil.functions import dims, text
from sparkveil.functions import generators as g
from sparkveil.operators import evaluate, layout, policy, recognizers, resolve, review, rewrite, session, verify
from sparkveil.plans import templates as t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
P = f"p AS {t.people_sql()}"


def query(name: str, sql: str | None = None):
    """Register a query, with its oracle if SQL can say it."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Identifiers and their check digits.

VALID = {"CPF": cd.cpf_valid, "CNPJ": cd.cnpj_valid, "PIS_PASEP": cd.pis_valid, "CNH": cd.cnh_valid, "TITULO_ELEITOR": cd.titulo_valid, "CNS": cd.cns_valid, "PROCESSO_CNJ": cd.cnj_valid, "RG": cd.rg_valid, "TELEFONE": cd.phone_valid}

for _entity in g.MADE:
    query(f"gen_{_entity.lower()}", f"WITH {P} SELECT k, {_entity.lower()} AS value FROM p")(lambda s, d, e=_entity: t.people(s, d).select("k", F.col(e.lower()).alias("value")))


@query("validate_all", f"WITH {P} SELECT k, e.entity, true AS valid, e.entity = 'TELEFONE' AS mutated_valid FROM p, (VALUES {', '.join(f'({chr(39)}{e}{chr(39)})' for e in VALID)}) e(entity)")
def validate_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated identifiers pass their check; with the last digit moved on they fail, telephones excepted."""
    rows = F.array(*(F.struct(F.lit(e).alias("entity"), F.col(e.lower()).alias("value"), F.expr(g.broken(e.lower())).alias("mutated")) for e in VALID))
    at = t.people(spark, sf_dir).select("k", F.inline(rows))
    test = lambda c: F.expr("case " + " ".join(f"when entity = '{e}' then {f(c)}" for e, f in VALID.items()) + " end")
    return at.select("k", "entity", test("value").alias("valid"), test("mutated").alias("mutated_valid"))


_BOTH_SQL = f"q AS (SELECT cpf, {t._sum_sql('cpf', 10, '2 + (10 - i) % 8')} AS p1, {t._sum_sql('cpf', 9, '10 - i')} AS h1, {t._sum_sql('cpf', 9, 'i')} AS h2 FROM p WHERE replace(cpf, substr(cpf, 1, 1), '') <> '')"


@query("multi_checksum_rate", f"""WITH {P}, {_BOTH_SQL} SELECT (SELECT count(*) FROM p) AS n, count(*) FILTER (({t._eleven('p1')}) = substr(cpf, 11, 1)::INT) AS also_pis,
  count(*) FILTER (CASE WHEN h1 % 11 = 10 THEN 0 ELSE h1 % 11 END = substr(cpf, 10, 1)::INT AND (h2 % 11 - CASE WHEN h1 % 11 = 10 THEN 2 ELSE 0 END + 11) % 11 % 10 = substr(cpf, 11, 1)::INT) AS also_cnh FROM q""")
def multi_checksum_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.people(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(F.expr(cd.pis_valid("cpf"))).alias("also_pis"), F.count_if(F.expr(cd.cnh_valid("cpf"))).alias("also_cnh"))


@query("area_codes", "SELECT n::INTEGER AS code, n IN (" + ", ".join(map(str, dims.AREA_CODES)) + ") AS valid FROM range(0, 100) r(n)")
def area_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(100).select(F.col("id").cast("int").alias("code"), F.expr(cd.area_valid("lpad(cast(id as string), 2, '0')")).alias("valid"))


# Scans.

for _entity in recognizers.RECOGNIZERS:
    query(f"scan_{_entity.lower()}", t.expected_sql(_entity))(lambda s, d, e=_entity: recognizers.exploded(recognizers.scan(t.people(s, d).select(F.col("k").alias("doc_id"), F.expr(t.scan_text(e)).alias("text")), e)))


@query("scan_email_documents", r"""
WITH m AS (SELECT doc_id, text, regexp_extract_all(text, '\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b') AS found FROM documents)
SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(found) FROM m) GROUP BY doc_id""")
def scan_email_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return recognizers.exploded(recognizers.scan(docs, "EMAIL")).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("scan_digit_runs", r"SELECT doc_id, length(run) AS size, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS run FROM documents) GROUP BY ALL")
def scan_digit_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.col("text").rlike("[0-9]"))
    runs = docs.select("doc_id", F.explode(text.matches("text", "[0-9]+")).alias("m"))
    return runs.groupBy("doc_id", (F.col("m.end") - F.col("m.start")).cast("bigint").alias("size")).agg(F.count("*").alias("n"))


@query("tier_outcomes", f"WITH s AS ({t.expected_sql('CPF')}), {P} SELECT p.k % 5 AS variant, count(s.doc_id) AS found, count(s.note) AS marked, coalesce(max(s.score), 0)::DOUBLE AS score FROM p LEFT JOIN s ON p.k = s.doc_id GROUP BY 1")
def tier_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t.people(spark, sf_dir).select(F.col("k").alias("doc_id"), F.expr(t.scan_text("CPF")).alias("text"))
    at = recognizers.scan(docs, "CPF").select((F.col("doc_id") % 5).alias("variant"), F.explode_outer("spans").alias("s"))
    return at.groupBy("variant").agg(F.count("s.entity").alias("found"), F.count("s.note").alias("marked"), F.coalesce(F.max("s.score"), F.lit(0.0)).alias("score"))


@query("detect_contracts", f"WITH {P} SELECT doc_id, \"start\", \"end\", label AS entity FROM ({t.gold_sql()})")
def detect_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All recognisers over whole contracts, told apart and without overlaps."""
    return recognizers.exploded(recognizers.detect(t.contracts(spark, sf_dir))).select("doc_id", "start", "end", "entity")


@query("detect_threshold_sweep", f"WITH s AS ({t.expected_sql('PIS_PASEP')}) SELECT threshold::DOUBLE AS threshold, count(*) FILTER (score >= threshold) AS n FROM s, (VALUES (0.2), (0.35), (0.5)) v(threshold) GROUP BY 1")
def detect_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t.people(spark, sf_dir).select(F.col("k").alias("doc_id"), F.expr(t.scan_text("PIS_PASEP")).alias("text"))
    at = recognizers.exploded(recognizers.scan(docs, "PIS_PASEP")).select("score", F.explode(F.array(F.lit(0.2), F.lit(0.35), F.lit(0.5))).alias("threshold"))
    return at.groupBy("threshold").agg(F.count_if(F.col("score") >= F.col("threshold")).alias("n"))


# Resolution.

_TELL = [("CNH n ", "CNH"), ("PIS/PASEP: ", "PIS_PASEP"), ("CPF ", "CPF"), ("Numero ", None), ("CPF/CNH ", None)]


@query("disambiguate_anchor", f"SELECT c_custkey AS doc_id, e.entity FROM customer, (VALUES ('CPF'), ('CNH'), ('PIS_PASEP')) e(entity) WHERE CASE c_custkey % 5 {' '.join(f'WHEN {i} THEN ' + (f'e.entity = {chr(39)}{w}{chr(39)}' if w else 'true') for i, (_, w) in enumerate(_TELL))} END")
def disambiguate_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.expr("case " + " ".join(f"when c_custkey % 5 = {i} then '{b}'" for i, (b, _) in enumerate(_TELL)) + " end")
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), before.alias("b"))
    spans = F.array(*(F.struct(F.length("b").alias("start"), (F.length("b") + 11).alias("end"), F.lit(e).alias("entity"), F.lit(1.0).alias("score"), F.lit(None).cast("string").alias("note")) for e in ("CPF", "CNH", "PIS_PASEP")))
    at = docs.select("doc_id", F.concat("b", F.lit("22393559907")).alias("text"), spans.alias("spans"))
    return resolve.disambiguate(at).select("doc_id", F.explode("spans.entity").alias("entity"))


_CASES = [
    ([(0, 30, "PERSON", 0.9), (10, 24, "CPF", 1.0)], [(10, 24, "CPF")]),
    ([(50, 60, "EMAIL", 0.75), (0, 14, "CPF", 1.0), (5, 20, "PERSON", 0.9), (55, 70, "PERSON", 0.9)], [(0, 14, "CPF"), (50, 60, "EMAIL")]),
    ([(0, 10, "CEP", 0.5), (10, 20, "CEP", 0.5), (5, 12, "CEP", 0.9)], [(0, 10, "CEP"), (10, 20, "CEP")]),
]


@query("resolve_overlaps", "SELECT c_custkey AS doc_id, v.s + c_custkey % 7 AS \"start\", v.e + c_custkey % 7 AS \"end\", v.entity FROM customer JOIN (VALUES " + ", ".join(f"({i}, {s}, {e}, '{n}')" for i, (_, kept) in enumerate(_CASES) for s, e, n in kept) + ") v(i, s, e, entity) ON c_custkey % 3 = v.i")
def resolve_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = "case " + " ".join(f"when c_custkey % 3 = {i} then array({', '.join(f'struct(cast({s} + c_custkey % 7 as int) as start, cast({e} + c_custkey % 7 as int) as end, {chr(39)}{n}{chr(39)} as entity, {x}d as score, cast(null as string) as note)' for s, e, n, x in given)})" for i, (given, _) in enumerate(_CASES)) + " end"
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.expr(rows).alias("spans"))
    return recognizers.exploded(resolve.resolve(docs)).select("doc_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "entity")


def _spans_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A span of some entity for each order."""
    names = F.array(*map(F.lit, dims.NAMES))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("span_id"), F.get(names, (F.col("o_orderkey") % 19).cast("int")).alias("entity")).where("entity IS NOT NULL")


_SPANS_SQL = "spans AS (SELECT o_custkey AS doc_id, o_orderkey AS span_id, d.entity FROM orders JOIN (VALUES " + ", ".join(f"({i}, '{e[0]}', {str(e[2]).lower()}, {dims.WEIGHT[e[0]]})" for i, e in enumerate(dims.ENTITIES)) + ") d(i, entity, redacted, weight) ON o_orderkey % 19 = d.i)"
_DIM_SQL = "dim AS (SELECT * FROM (VALUES " + ", ".join(f"('{e[0]}', '{e[1]}', {str(e[2]).lower()}, '{e[3]}', '{e[4]}', {dims.WEIGHT[e[0]]})" for e in dims.ENTITIES) + ") d(entity, tier, redacted, prefix, grp, weight))"


@query("redactable_filter", f"WITH {_SPANS_SQL}, {_DIM_SQL} SELECT s.entity, count(*) AS n FROM spans s JOIN dim USING (entity) WHERE redacted GROUP BY 1")
def redactable_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _spans_table(spark, sf_dir).groupBy("doc_id").agg(F.collect_list(F.struct("span_id", "entity")).alias("spans"))
    return resolve.only(docs).select(F.explode("spans.entity").alias("entity")).groupBy("entity").agg(F.count("*").alias("n"))


@query("entity_inventory", f"WITH {_SPANS_SQL}, {_DIM_SQL} SELECT dim.entity, count(s.span_id) AS n FROM dim LEFT JOIN (SELECT * FROM spans WHERE entity <> 'RG') s USING (entity) GROUP BY 1")
def entity_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.inventory(_spans_table(spark, sf_dir).where("entity <> 'RG'"))


@query("inventory_by_group", f"WITH {_SPANS_SQL}, {_DIM_SQL} SELECT grp, count(*) AS n, count(DISTINCT doc_id) AS docs, min(span_id) AS first_span FROM spans JOIN dim USING (entity) GROUP BY 1")
def inventory_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = dims.entity_table(spark).select("entity", "grp")
    return _spans_table(spark, sf_dir).join(F.broadcast(dim), "entity").groupBy("grp").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"), F.min("span_id").alias("first_span"))


# Policy.


@query("policy_effective", "WITH " + _DIM_SQL + " SELECT v.name, entity, CASE WHEN redacted THEN v.name ELSE 'manter' END AS operator FROM dim, (VALUES ('tarja'), ('pseudonimo')) v(name)")
def policy_effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.effective(policy.profiles(spark))


@query("policy_diff", "WITH " + _DIM_SQL + " SELECT entity, 'tarja' AS old_operator, 'pseudonimo' AS new_operator FROM dim WHERE redacted")
def policy_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = policy.profiles(spark)
    return policy.difference(both.where("name = 'tarja'"), both.where("name = 'pseudonimo'"))


@query("policy_violations", "SELECT * FROM (VALUES ('b', 'unknown default', 'apagar'), ('b', 'unknown entity', 'PLACA'), ('b', 'unknown operator', 'xis'), ('c', 'not implemented', 'mascara'), ('c', 'threshold', '1.5')) v(name, problem, value)")
def policy_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = ['{"name": "a", "rules": {"CPF": "tarja"}}', '{"name": "b", "default": "apagar", "rules": {"PLACA": "tarja", "CPF": "xis"}}', '{"name": "c", "rules": {"CPF": "mascara"}, "threshold": 1.5}']
    return policy.violations(policy.from_json(spark.createDataFrame([(x,) for x in texts], "value string")))


@query("policy_span_operators", f"WITH {_SPANS_SQL}, {_DIM_SQL} SELECT entity, coalesce(active, redacted) AS removed, count(*) AS n FROM (SELECT s.entity, CASE span_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS active, redacted FROM spans s JOIN dim USING (entity)) GROUP BY ALL")
def policy_span_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    effective = policy.effective(policy.profiles(spark).where("name = 'tarja'")).select("entity", "operator")
    active = F.when(F.col("span_id") % 3 == 0, True).when(F.col("span_id") % 3 == 1, False)
    at = _spans_table(spark, sf_dir).join(F.broadcast(effective), "entity")
    return at.select("entity", policy.will_be_removed(active, F.col("operator")).alias("removed")).groupBy("entity", "removed").agg(F.count("*").alias("n"))


# Edits.


def _edits_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edit for each line of an order, to the span that the order is: a profile, a class, another entity, or a
    decision. A profile has a rule of its own for each third order's class."""
    at = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"))
    at = at.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("o"), F.col("o_custkey").alias("doc_id")), "o")
    names = F.array(*map(F.lit, dims.NAMES))
    op = F.when(F.col("n") == 7, "profile").when(F.col("n") == 6, "class").when(F.col("n") == 5, "entity").otherwise("span")
    own = F.get(names, (F.col("o") % 16).cast("int"))
    entity = F.when(F.col("n") == 5, F.get(names, ((F.col("o") + 7) % 16).cast("int"))).otherwise(own)
    rules = F.when((F.col("n") == 7) & (F.col("o") % 3 == 0), F.create_map(own, F.lit("pseudonimo")))
    return at.select("doc_id", (F.col("o") * 10 + F.col("n")).alias("version"), op.alias("op"), F.col("o").alias("span_id"), entity.alias("entity"), (F.col("n") % 2 == 0).alias("active"), F.when(F.col("o") % 2 == 0, "tarja").otherwise("manter").alias("operator"), rules.alias("rules"))


_EDITS_SQL = """edits AS (
  SELECT o_custkey AS doc_id, l_orderkey * 10 + l_linenumber AS version, CASE l_linenumber WHEN 7 THEN 'profile' WHEN 6 THEN 'class' WHEN 5 THEN 'entity' ELSE 'span' END AS op,
         l_orderkey AS span_id, CASE WHEN l_linenumber = 5 THEN n.entity ELSE d.entity END AS entity, l_linenumber % 2 = 0 AS active, CASE WHEN l_orderkey % 2 = 0 THEN 'tarja' ELSE 'manter' END AS operator,
         CASE WHEN l_linenumber = 7 AND l_orderkey % 3 = 0 THEN MAP {d.entity: 'pseudonimo'} ELSE MAP {'-': '-'} END AS rules
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN (VALUES """ + ", ".join(f"({i}, '{n}')" for i, n in enumerate(dims.NAMES)) + """) d(i, entity) ON l_orderkey % 16 = d.i
  JOIN (VALUES """ + ", ".join(f"({i}, '{n}')" for i, n in enumerate(dims.NAMES)) + """) n(i, entity) ON (l_orderkey + 7) % 16 = n.i)"""


@query("edit_fold_state", f"""WITH RECURSIVE {_SPANS_SQL}, {_EDITS_SQL},
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY version) AS i FROM edits),
run AS (
  SELECT doc_id, span_id, 0::BIGINT AS i, entity, NULL::BOOLEAN AS active, 'manter' AS fallback, MAP {{'-': '-'}} AS rules FROM spans
  UNION ALL
  SELECT doc_id, span_id, i, CASE WHEN op = 'entity' AND mine THEN e_entity ELSE entity END,
    CASE WHEN op = 'span' AND mine THEN e_active
         WHEN op = 'entity' AND mine AND coalesce(active, old_op <> 'manter') <> coalesce(active, moved_op <> 'manter') THEN old_op <> 'manter'
         WHEN op = 'class' AND e_entity = entity THEN NULL
         WHEN op = 'profile' AND old_op <> new_op THEN NULL ELSE active END,
    CASE WHEN op = 'profile' THEN operator ELSE fallback END,
    CASE WHEN op = 'profile' THEN e_rules WHEN op = 'class' THEN map_concat(rules, MAP {{e_entity: operator}}) ELSE rules END
  FROM (
    SELECT r.doc_id, r.span_id, e.i, r.entity, r.active, r.fallback, r.rules, e.op, e.span_id = r.span_id AS mine, e.entity AS e_entity, e.active AS e_active, e.operator, e.rules AS e_rules,
           coalesce(r.rules[r.entity], r.fallback) AS old_op, coalesce(e.rules[r.entity], e.operator) AS new_op, coalesce(r.rules[e.entity], r.fallback) AS moved_op
    FROM run r JOIN numbered e ON e.doc_id = r.doc_id AND e.i = r.i + 1)),
last AS (SELECT doc_id, span_id, arg_max(struct_pack(entity, active, op := coalesce(rules[entity], fallback)), i) AS s FROM run GROUP BY 1, 2),
versions AS (SELECT doc_id, max(version) AS version FROM edits GROUP BY 1)
SELECT l.doc_id, l.span_id, s.entity, s.op AS operator, s.active, coalesce(s.active, s.op IN ('tarja', 'pseudonimo')) AS removed, coalesce(v.version, 0) AS version FROM last l LEFT JOIN versions v USING (doc_id)""")
def edit_fold_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.fold_edits(_spans_table(spark, sf_dir), _edits_table(spark, sf_dir)).select("doc_id", "span_id", "entity", "operator", "active", "removed", "version")


@query("invalidate_versions", f"WITH {_EDITS_SQL} SELECT e.doc_id, e.version FROM edits e WHERE e.version = (SELECT max(version) FROM edits x WHERE x.doc_id = e.doc_id)")
def invalidate_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = _edits_table(spark, sf_dir)
    return session.valid_results(edits.select("doc_id", "version"), edits)


# Rewriting.


def _rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.pseudonymise(recognizers.detect(t.contracts(spark, sf_dir)), seed=11)


@query("pseudonymise_structure", f"WITH {P}, gold AS ({t.gold_sql()}) SELECT doc_id, count(*) AS substitutions, count(DISTINCT label || value) AS n_tokens, true AS all_present FROM gold GROUP BY 1")
def pseudonymise_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _rewritten(spark, sf_dir)
    return at.select("doc_id", F.size("substitutions").cast("bigint").alias("substitutions"), F.size("tokens").cast("bigint").alias("n_tokens"), (F.size(verify.missing_tokens(F.col("rewritten"), F.col("tokens"))) == 0).alias("all_present"))


_MARKED = t.text_sql(lambda p, e: f"'[{e}]'" if e else p)


@query("redact_text", f"WITH {P} SELECT k AS doc_id, {_MARKED} AS rewritten FROM p")
def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.redact(recognizers.detect(t.contracts(spark, sf_dir)), mark=rewrite.by_entity).select("doc_id", "rewritten")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts through detection, tokens, rewriting and verification."""
    at = _rewritten(spark, sf_dir)
    values = F.transform("substitutions", lambda s: F.substring("text", s["start"] + 1, s["end"] - s["start"]))
    return verify.verify_text(at.withColumn("values", values), tokens="tokens").select("doc_id", "rewritten", F.size("substitutions").alias("n_substitutions"), "n_values", "leaks", "ok")


@query("verify_flagship", f"WITH {P}, gold AS ({t.gold_sql()}) SELECT doc_id, count(DISTINCT value)::INTEGER AS n_values, true AS ok FROM gold GROUP BY 1")
def verify_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(spark, sf_dir).select("doc_id", "n_values", "ok")


# Verification.

_FORMS = [("concat('x ', m, ' y')", True), ("concat('id ', cpf)", True), ("concat(substr(cpf, 1, 3), ' ', substr(cpf, 4, 3), '-', substr(cpf, 7, 3), '/', substr(cpf, 10, 2))", True), ("concat(substr(cpf, 1, 5), 'a', substr(cpf, 6))", False), ("'nothing here'", False)]
_FORM_TEXT = "case " + " ".join(f"when k % 5 = {i} then {f}" for i, (f, _) in enumerate(_FORMS)) + " end"


@query("verify_leaks", f"WITH {P} SELECT k AS doc_id, k % 5 < 3 AS leaks FROM p")
def verify_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = t.people(spark, sf_dir).withColumn("m", F.expr(t.written("CPF", "masked"))).select("k", "m", F.expr(_FORM_TEXT).alias("surface"))
    return at.select(F.col("k").alias("doc_id"), (F.size(verify.leaked_values(F.col("surface"), F.array("m"))) > 0).alias("leaks"))


@query("verify_variants", f"WITH {P} SELECT k AS doc_id, v.form FROM p, LATERAL (SELECT unnest([{t.written('CPF', 'masked')} , cpf]) AS form) v UNION ALL SELECT k, 'Ana  Souza' FROM p UNION ALL SELECT k, 'Ana Souza' FROM p UNION ALL SELECT k, 'AnaSouza' FROM p")
def verify_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.array(F.expr(t.written("CPF", "masked")), F.lit("Ana  Souza"), F.lit("abc"))
    return t.people(spark, sf_dir).select(F.col("k").alias("doc_id"), F.explode(F.flatten(F.transform(values, verify.variants))).alias("form"))


@query("verify_token_presence", "SELECT c_custkey AS doc_id, (c_custkey % 2)::INTEGER AS lost FROM customer")
def verify_token_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.expr("concat('a [P-00AA] b ', case when c_custkey % 2 = 0 then '[CPF-1234]' else '' end)").alias("rewritten"))
    return at.select("doc_id", F.size(verify.missing_tokens(F.col("rewritten"), F.array(F.lit("[P-00AA]"), F.lit("[CPF-1234]")))).alias("lost"))


def _surfaces(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    at = t.people(spark, sf_dir).withColumn("m", F.expr(t.written("CPF", "masked")))
    values = at.select(F.col("k").alias("doc_id"), F.col("m").alias("value"))
    rows = F.array(*(F.struct(F.lit(n).alias("surface"), F.lit(i).alias("object_id"), c.alias("content")) for i, (n, c) in enumerate((("texto", F.expr("case when k % 2 = 0 then concat('a ', m) else 'none' end")), ("metadados", F.expr("case when k % 3 = 0 then cpf else '' end")), ("anexo", F.lit("nothing"))))))
    return values, at.select(F.col("k").alias("doc_id"), F.inline(rows))


@query("leak_dissection", f"WITH {P}, found AS (SELECT k AS doc_id, {t.written('CPF', 'masked')} AS value, 'texto' AS s FROM p WHERE k % 2 = 0 UNION ALL SELECT k, {t.written('CPF', 'masked')}, 'metadados' FROM p WHERE k % 3 = 0) SELECT doc_id, value, string_agg(s, ',' ORDER BY s) AS surfaces, count(*) AS n_surfaces, bool_or(s = 'texto') AS is_visible FROM found GROUP BY ALL")
def leak_dissection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.dissect(verify.leaks(*_surfaces(spark, sf_dir))).withColumn("surfaces", F.array_join("surfaces", ","))


@query("surface_checklist", f"SELECT v.surface, CASE v.surface WHEN 'texto' THEN (SELECT count(*) FROM customer WHERE c_custkey % 2 = 0) WHEN 'metadados' THEN (SELECT count(*) FROM customer WHERE c_custkey % 3 = 0) ELSE 0 END AS n_leaks FROM (VALUES ('texto'), ('metadados'), ('anexo')) v(surface)")
def surface_checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    values, surfaces = _surfaces(spark, sf_dir)
    found = verify.leaks(values, surfaces).groupBy("surface").agg(F.count("*").alias("n"))
    return surfaces.select("surface").distinct().join(found, "surface", "left").select("surface", F.coalesce("n", F.lit(0)).alias("n_leaks"))


@query("occurrences_by_page", f"WITH {P} SELECT k AS doc_id, page::INTEGER AS page, page AS n FROM p, range(1, 4) r(page)")
def occurrences_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = t.people(spark, sf_dir).withColumn("m", F.expr(t.written("CPF", "masked"))).select("k", "m", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("page"))
    at = at.withColumn("content", F.concat(F.lit("inicio "), F.repeat(F.concat("m", F.lit(" e ")), F.col("page")), F.lit("fim")))
    return at.select(F.col("k").alias("doc_id"), "page", verify.occurrences(F.col("m"), F.col("content")).alias("n")).where("n > 0")


@query("term_preview", "SELECT c_custkey AS doc_id, 3::BIGINT AS in_text, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS covered, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 3 END::BIGINT AS fresh FROM customer")
def term_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of a term, whatever its white space, that active spans cover already and those that would be new."""
    at = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit("Ana Souza e Ana  Souza com Ana\nSouza.").alias("text"))
    hits = text.matches("text", text.literal_pattern("Ana Souza"))
    active = F.when(F.col("doc_id") % 2 == 0, F.array(F.struct(F.lit(4).alias("start"), F.lit(9).alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
    at = at.withColumn("hits", hits).withColumn("active", active)
    covered = F.size(F.filter("hits", lambda h: F.exists("active", lambda a: resolve.overlap(a, h)))).cast("bigint")
    return at.select("doc_id", F.size("hits").cast("bigint").alias("in_text"), covered.alias("covered"), (F.size("hits") - covered).alias("fresh"))


@query("leak_vs_residue", f"WITH {P} SELECT k AS doc_id, k % 4 = 0 AS leak, k % 4 IN (0, 1) AS residue FROM p")
def leak_vs_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold values still in an output, and values of its own that were to go."""
    at = t.people(spark, sf_dir).withColumn("m", F.expr(t.written("CPF", "masked"))).withColumn("e", F.expr(t.written("EMAIL", "masked")))
    at = at.withColumn("out", F.expr("concat('[CPF-0001] ', case when k % 4 = 0 then m else '' end, ' ', case when k % 4 in (0, 1) then e else '' end)"))
    return at.select(F.col("k").alias("doc_id"), (F.size(verify.leaked_values(F.col("out"), F.array("m"))) > 0).alias("leak"), (F.size(verify.leaked_values(F.col("out"), F.array("e"))) > 0).alias("residue"))


@query("hex_surfaces", f"WITH {P} SELECT k AS doc_id, cpf AS decoded FROM p")
def hex_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = t.people(spark, sf_dir).select(F.col("k").alias("doc_id"), F.concat(F.lit("BT <"), F.hex(F.encode("cpf", "US-ASCII")), F.lit("> Tj ET")).alias("stream"))
    return at.select("doc_id", F.explode(verify.hex_strings(F.col("stream"))).alias("decoded"))


# Evaluation: predictions are the detector's, gold is off for some keys.


def _judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    gold = t.gold(spark, sf_dir)
    pred = gold.where("NOT (doc_id % 5 = 0 AND label = 'CPF')").select("doc_id", "label", F.expr("case when doc_id % 7 = 0 then start + 2 else start end").alias("start"), "end")
    extra = t.people(spark, sf_dir).where("k % 11 = 0").select(F.col("k").alias("doc_id"), F.lit("CEP").alias("label"), F.lit(0).alias("start"), F.lit(5).alias("end"))
    return gold.select("doc_id", "label", "start", "end"), pred.unionByName(extra)


_JUDGED_SQL = f"""{P}, gold AS ({t.gold_sql()}), pred AS (
  SELECT doc_id, label, CASE WHEN doc_id % 7 = 0 THEN "start" + 2 ELSE "start" END AS "start", "end" FROM gold WHERE NOT (doc_id % 5 = 0 AND label = 'CPF')
  UNION ALL SELECT k, 'CEP', 0, 5 FROM p WHERE k % 11 = 0)"""
_STRICT_SQL = """strict AS (SELECT coalesce(g.label, q.label) AS label, count(*) FILTER (g.label IS NOT NULL AND q.label IS NOT NULL) AS tp, count(*) FILTER (g.label IS NULL) AS fp, count(*) FILTER (q.label IS NULL) AS fn
  FROM gold g FULL JOIN pred q ON g.doc_id = q.doc_id AND g.label = q.label AND g."start" = q."start" AND g."end" = q."end" GROUP BY 1)"""
_SCORED = "coalesce(tp / nullif(tp + fp, 0), 0)::DOUBLE AS precision, coalesce(tp / nullif(tp + fn, 0), 0)::DOUBLE AS recall"


@query("eval_strict", f"WITH {_JUDGED_SQL}, {_STRICT_SQL}, s AS (SELECT *, {_SCORED} FROM strict) SELECT label, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1, tp + fn AS support FROM s")
def eval_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = evaluate.scores(evaluate.strict(*_judged(spark, sf_dir)))
    return at.select("label", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "support")


@query("eval_relaxed", f"WITH {_JUDGED_SQL}, hit AS (SELECT g.label, count(*) AS tp FROM gold g JOIN pred q ON g.doc_id = q.doc_id AND g.label = q.label AND g.\"start\" < q.\"end\" AND q.\"start\" < g.\"end\" GROUP BY 1), gs AS (SELECT label, count(*) AS n FROM gold GROUP BY 1), ps AS (SELECT label, count(*) AS n FROM pred GROUP BY 1) SELECT gs.label, coalesce(tp, 0) AS tp, coalesce(ps.n, 0) - coalesce(tp, 0) AS fp, gs.n - coalesce(tp, 0) AS fn FROM gs LEFT JOIN ps USING (label) LEFT JOIN hit USING (label)")
def eval_relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of a label overlap one gold span at most here, so any order of matching gives the same."""
    return evaluate.relaxed(*_judged(spark, sf_dir))


@query("eval_macro", f"WITH {_JUDGED_SQL}, {_STRICT_SQL}, s AS (SELECT *, {_SCORED} FROM strict) SELECT round(avg(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0)), 6) AS macro_f1 FROM s WHERE tp + fn > 0")
def eval_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.macro_f1(evaluate.scores(evaluate.strict(*_judged(spark, sf_dir)))).select(F.round("macro_f1", 6).alias("macro_f1"))


@query("eval_coverage", f"""WITH {_JUDGED_SQL}, chars AS (SELECT g.doc_id, g.label, g."start", unnest(range(g."start", g."end")) AS pos FROM gold g)
SELECT count(*) AS chars_gold, count(*) FILTER (hit) AS chars_covered, round(count(*) FILTER (hit) / count(*), 6) AS coverage FROM (
  SELECT EXISTS (SELECT 1 FROM pred q WHERE q.doc_id = c.doc_id AND c.pos >= q."start" AND c.pos < q."end") AS hit FROM chars c)""")
def eval_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.coverage(*_judged(spark, sf_dir)).withColumn("coverage", F.round("coverage", 6))


@query("eval_throughput", "SELECT l_returnflag AS config, round(sum(l_quantity) / sum(l_linenumber), 6) AS seconds_per_page, round(sum(l_quantity) / count(DISTINCT l_orderkey), 6) AS seconds_per_doc FROM lineitem GROUP BY 1")
def eval_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("config"), F.col("l_orderkey").alias("doc_id"), F.col("l_quantity").alias("seconds"), F.col("l_linenumber").alias("pages"))
    return evaluate.throughput(runs).select("config", *(F.round(c, 6).alias(c) for c in ("seconds_per_page", "seconds_per_doc")))


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One PERSON a customer; what was predicted and redacted differs by key."""
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"))
    gold = base.select("doc_id", F.lit("PERSON").alias("label"), F.lit(10).alias("start"), F.lit(27).alias("end"))
    spans = F.expr("case doc_id % 5 when 0 then array(struct('PERSON' as label, 6 as start, 30 as end)) when 1 then array(struct('PERSON' as label, 10 as start, 15 as end), struct('PERSON' as label, 15 as start, 27 as end)) when 2 then array(struct('PERSON' as label, 10 as start, 15 as end)) when 3 then array(struct('LOCATION' as label, 10 as start, 27 as end)) else array(struct('PERSON' as label, 28 as start, 40 as end)) end")
    pred = base.select("doc_id", F.inline(spans))
    return evaluate.leak_classes(gold, pred, pred.where(F.col("label").isin(*dims.REDACTED)))


def _order_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A PERSON for each order in its customer's document, covered or not by its key."""
    at = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("o"), (F.col("o_orderkey") * 100).alias("start"))
    gold = at.select("doc_id", F.lit("PERSON").alias("label"), "start", (F.col("start") + 10).alias("end"))
    cut = F.when(F.col("o") % 5 == 2, 4).otherwise(10)
    pred = at.where("o % 5 <> 4").select("doc_id", F.when(F.col("o") % 5 == 3, "LOCATION").otherwise("PERSON").alias("label"), "start", (F.col("start") + cut).alias("end"))
    return evaluate.leak_classes(gold, pred, pred.where(F.col("label").isin(*dims.REDACTED)))


@query("leak_classes", "SELECT CASE c_custkey % 5 WHEN 0 THEN 'covered' WHEN 1 THEN 'covered' WHEN 2 THEN 'partial' WHEN 3 THEN 'wrong_label' ELSE 'not_found' END AS class, count(*) AS n FROM customer GROUP BY 1")
def leak_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classes(spark, sf_dir).groupBy("class").agg(F.count("*").alias("n"))


@query("label_histogram", "SELECT CASE c_custkey % 5 WHEN 3 THEN 'LOCATION' WHEN 4 THEN '-' ELSE 'PERSON' END AS labels, count(*) AS n, round(count(*) / (SELECT count(*) FROM customer), 6) AS share FROM customer GROUP BY 1")
def label_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.label_histogram(_classes(spark, sf_dir))


_REST = "CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN ['Sr.', 'Dra.', 'Exma.'][(c_custkey % 9 // 3 + 1)::INT] ELSE 'Souza ' || c_custkey % 40 END"


def _rests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A person for each customer, called by title, name and surname, of which spans leave nothing, the title or the
    surname."""
    k = F.col("c_custkey")
    title = F.get(F.array(*map(F.lit, ("Sr.", "Dra.", "Exma."))), (F.floor(k % 9 / 3)).cast("int"))
    last = F.concat(F.lit("Souza "), (k % 40).cast("string"))
    at = table(spark, sf_dir, "customer").select(k.alias("doc_id"), title.alias("t"), last.alias("s"), F.concat(F.lit("Assina "), title, F.lit(" Ana "), last, F.lit(".")).alias("text"))
    at = at.withColumn("start", F.lit(7)).withColumn("end", F.length("text") - 1)
    gold = at.select("doc_id", F.lit("PERSON").alias("label"), "start", "end")
    lo = F.when(F.col("doc_id") % 3 == 1, F.lit(8) + F.length("t")).otherwise(F.lit(5))
    hi = F.when(F.col("doc_id") % 3 == 2, F.lit(12) + F.length("t")).otherwise(F.length("text"))
    halves = F.array(F.struct(lo.alias("start"), (lo + 4).alias("end")), F.struct((lo + 2).alias("start"), hi.alias("end")))
    return evaluate.remainder(gold, at.select("doc_id", F.inline(halves)), at.select("doc_id", "text"))


@query("residue_top15", f"SELECT rest, count(*) AS n, rest IN ('Sr.', 'Dra.', 'Exma.') AS title FROM (SELECT {_REST} AS rest FROM customer) WHERE rest <> '' GROUP BY 1 ORDER BY n DESC, rest LIMIT 15")
def residue_top15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.residue(_rests(spark, sf_dir))


@query("title_share", f"SELECT count(*) AS cases, count(*) FILTER (rest LIKE '%.') AS titles, count(*) FILTER (rest LIKE '%.') / count(*) AS share FROM (SELECT {_REST} AS rest FROM customer) WHERE rest <> ''")
def title_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.title_share(_rests(spark, sf_dir))


@query("uncovered_remainder", f"""WITH {_JUDGED_SQL}, texts AS (SELECT k AS doc_id, {t.text_sql()} AS text FROM p), chars AS (SELECT g.doc_id, g.label, g."start", g."end", unnest(range(g."start", g."end")) AS pos FROM gold g)
SELECT c.doc_id, c.label, c."start"::BIGINT AS "start", coalesce(trim(string_agg(substr(text, pos::INT + 1, 1), '' ORDER BY pos) FILTER (NOT EXISTS (SELECT 1 FROM pred q WHERE q.doc_id = c.doc_id AND c.pos >= q."start" AND c.pos < q."end"))), '') AS rest
FROM chars c JOIN texts x ON x.doc_id = c.doc_id GROUP BY ALL""")
def uncovered_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, pred = _judged(spark, sf_dir)
    return evaluate.remainder(gold, pred, t.contracts(spark, sf_dir)).select("doc_id", "label", F.col("start").cast("bigint").alias("start"), "rest")


@query("one_leak_documents", "SELECT o_custkey AS doc_id FROM (SELECT o_custkey, count(*) FILTER (o_orderkey % 5 IN (3, 4)) AS n FROM orders GROUP BY 1) WHERE n = 1")
def one_leak_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.leaking(_order_classes(spark, sf_dir)).where("leaks = 1").select("doc_id")


@query("leaking_documents", "SELECT count(*) AS docs, sum(n)::BIGINT AS leaks FROM (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderkey % 5 IN (3, 4) GROUP BY 1)")
def leaking_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.leaking(_order_classes(spark, sf_dir)).agg(F.count("*").alias("docs"), F.sum("leaks").alias("leaks"))


@query("usability_summary", "SELECT 4::BIGINT AS sessions, 3::BIGINT AS participants, 3::BIGINT AS hits, 0.75::DOUBLE AS rate, 40::DOUBLE AS median_seconds, 2.5::DOUBLE AS false_alarms")
def usability_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("a", "d1", "sim", "20", "1,5", ""), ("b", "d1", " S ", "40,0", "x", ""), ("c", "d2", "1", "60", "1", ""), ("a", "d2", "nao", "300", "", ""), ("", "d3", "sim", "5", "9", "")]
    return evaluate.usability(spark.createDataFrame(rows, "participante string, documento string, achou string, segundos string, falsos_alarmes string, observacao string"))


@query("align_gold", f"""WITH {P}, gold AS ({t.gold_sql()}), texts AS (SELECT k AS doc_id, {t.text_sql()} AS text FROM p)
SELECT g.doc_id, g.label, g.value, CASE WHEN NOT contains(g.value, ', ') THEN g."start" + n END AS "start", CASE WHEN NOT contains(g.value, ', ') THEN g."end" + n END AS "end", contains(g.value, ', ') AS defect
FROM (SELECT g.*, (length(replace(substr(x.text, 1, g."start"::INT), ', ', ',  ')) - g."start")::BIGINT AS n FROM gold g JOIN texts x USING (doc_id)) g""")
def align_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose commas have two spaces after them; values with a comma of their own are nowhere."""
    at = t.contracts(spark, sf_dir).select("doc_id", F.col("text").alias("source_text"), F.regexp_replace("text", ", ", ",  ").alias("text"))
    return evaluate.align(at, t.gold(spark, sf_dir).select("doc_id", "label", "value", "start", "end"))


# Fragments, lines and words.


def _fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = F.expr("array(struct('DATE_TIME' as entity, 0 as start, 2 as end, 0.8d as score), struct('DATE_TIME' as entity, 2 as start, 3 as end, 0.95d as score), struct('DATE_TIME' as entity, 3 as start, 5 as end, 0.7d as score), struct('PERSON' as entity, 10 as start, 14 as end, 0.9d as score), struct('PERSON' as entity, 15 as start, cast(20 + doc_id % 3 as int) as end, 0.6d as score))")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id")).select("doc_id", F.inline(pieces))


@query("merge_fragments", "SELECT c_custkey AS doc_id, 'DATE_TIME' AS entity, 0::BIGINT AS \"start\", 5::BIGINT AS \"end\", 0.95::DOUBLE AS score FROM customer UNION ALL SELECT c_custkey, 'PERSON', 10, 14, 0.9 FROM customer UNION ALL SELECT c_custkey, 'PERSON', 15, 20 + c_custkey % 3, 0.6 FROM customer")
def merge_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.merge_fragments(_fragments(spark, sf_dir)).select("doc_id", "entity", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "score")


@query("dedupe_contained", "SELECT c_custkey AS doc_id, 'PERSON' AS entity, 0::BIGINT AS \"start\", 20::BIGINT AS \"end\", 0.9::DOUBLE AS score FROM customer UNION ALL SELECT c_custkey, 'PERSON', 15, 30, 0.5 FROM customer UNION ALL SELECT c_custkey, 'CPF', 2, 5, 1.0 FROM customer")
def dedupe_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = F.expr("array(struct('PERSON' as entity, 0 as start, 20 as end, 0.4d as score), struct('PERSON' as entity, 3 as start, 12 as end, 0.9d as score), struct('PERSON' as entity, 15 as start, 30 as end, 0.5d as score), struct('CPF' as entity, 2 as start, 5 as end, 1.0d as score))")
    at = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id")).select("doc_id", F.inline(pieces))
    return resolve.absorb_contained(at).select("doc_id", "entity", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "score")


def _lined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit("Caue Viana\nAna Sophia (x)").alias("text"), F.lit(0).alias("start"), F.lit(14).alias("end"), F.lit("PERSON").alias("entity"))


@query("split_newline", "SELECT c_custkey AS doc_id, v.s AS \"start\", v.e AS \"end\" FROM customer, (VALUES (0, 10), (11, 14)) v(s, e)")
def split_newline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.split_lines(_lined(spark, sf_dir)).select("doc_id", "start", "end")


@query("trim_junk", "SELECT c_custkey AS doc_id, 23 AS \"start\", 24 AS \"end\" FROM customer")
def trim_junk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.trim_junk(_lined(spark, sf_dir).withColumns({"start": F.lit(21), "end": F.lit(25)})).select("doc_id", "start", "end")


def _chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """'ab cd' on a line and 'ef' on the next, for each customer; the space has a box, the line feed none."""
    rows = F.expr("array(struct(0 as pos, 'a' as ch, 0d as x0, 10d as y0), struct(1 as pos, 'b' as ch, 5d as x0, 10d as y0), struct(2 as pos, ' ' as ch, 10d as x0, 10d as y0), struct(3 as pos, 'c' as ch, 15d as x0, 10.5d as y0), struct(4 as pos, 'd' as ch, 20d as x0, 10d as y0), struct(5 as pos, '\\n' as ch, cast(null as double) as x0, cast(null as double) as y0), struct(6 as pos, 'e' as ch, 0d as x0, 30d as y0), struct(7 as pos, 'f' as ch, 5d as x0, 30d as y0))")
    at = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(1).alias("page"), F.inline(rows))
    return at.withColumn("x1", F.col("x0") + 5).withColumn("y1", F.col("y0") + 12)


@query("visual_lines", "SELECT c_custkey AS doc_id, v.line::BIGINT AS line, v.x0::DOUBLE AS x0, v.y0::DOUBLE AS y0, v.x1::DOUBLE AS x1, v.y1::DOUBLE AS y1 FROM customer, (VALUES (1, 5, 10, 25, 22.5), (2, 0, 30, 5, 42)) v(line, x0, y0, x1, y1)")
def visual_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(1).alias("start"), F.lit(7).alias("end"))
    return layout.span_lines(_chars(spark, sf_dir), spans).select("doc_id", "line", "x0", "y0", "x1", "y1")


@query("words_of_page", "SELECT c_custkey AS doc_id, v.word, v.s AS \"start\", v.e AS \"end\" FROM customer, (VALUES ('ab', 0, 2), ('cd', 3, 5), ('ef', 6, 8)) v(word, s, e)")
def words_of_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.words(_chars(spark, sf_dir)).select("doc_id", "word", "start", "end")


@query("implicit_space", "SELECT l_orderkey AS doc_id, l_linenumber AS seq, coalesce(l_linenumber * 10 + CASE WHEN l_linenumber % 2 = 0 THEN 1.5 ELSE 0.5 END - lag(l_linenumber * 10 + 9.9) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) > 1, false) AS space_before FROM lineitem")
def implicit_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    at = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("line"), n.alias("seq"), (n * 10 + F.when(n % 2 == 0, 1.5).otherwise(0.5)).alias("x0"), (n * 10 + 9.9).alias("x1"), F.lit("abc").alias("content"))
    return layout.implied_spaces(at).select("doc_id", "seq", "space_before")


@query("clip_rects", "SELECT c_custkey AS box_id, round(10.05 + 0.0, 6)::DOUBLE AS y0, 19.95::DOUBLE AS y1 FROM customer")
def clip_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("box_id"), F.col("c_custkey").alias("page"), F.lit(0.0).alias("x0"), F.lit(9.0).alias("y0"), F.lit(50.0).alias("x1"), F.lit(21.0).alias("y1"))
    lines = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page"), F.inline(F.expr("array(struct(0d as x0, 0d as y0, 40d as x1, 10d as y1), struct(0d as x0, 20d as y0, 40d as x1, 30d as y1), struct(60d as x0, 0d as y0, 90d as x1, 14d as y1))")))
    return layout.clip(at, lines).select("box_id", F.round("y0", 6).alias("y0"), F.round("y1", 6).alias("y1"))


@query("segment_offsets", "SELECT l_orderkey AS doc_id, l_linenumber AS seq, (coalesce(sum(length(l_returnflag || l_linenumber)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS \"start\" FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)")
def segment_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("seq"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("content"))
    return layout.offsets(at).select("doc_id", "seq", "start")


@query("line_fill", "SELECT c_custkey AS doc_id, v.i::INTEGER AS i, v.line FROM customer, (VALUES (0, 'um dois'), (1, 'tres'), (2, 'quatorze'), (3, 'x y')) v(i, line)")
def line_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = F.array(*map(F.lit, ("um", "dois", "tres", "quatorze", "x", "y")))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.posexplode(layout.wrap(segments, 8)).alias("i", "line"))


@query("token_fit", "SELECT c_custkey AS doc_id, c_custkey % 60 >= 46 AS fits FROM customer")
def token_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = table(spark, sf_dir, "customer")
    return at.select(F.col("c_custkey").alias("doc_id"), layout.token_fits(F.lit("[CPF-1234]"), (F.col("c_custkey") % 60).cast("double"), F.lit(12.0)).alias("fits"))


@query("offset_to_page", "SELECT c_custkey AS doc_id, (c_custkey % 30)::INTEGER AS \"start\", ((c_custkey % 30) // 10 + 1)::INTEGER AS page FROM customer")
def offset_to_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"))
    pages = base.select("doc_id", F.inline(F.expr("array(struct(1 as page, 0 as page_start, 10 as page_end), struct(2 as page, 10 as page_start, 20 as page_end), struct(3 as page, 20 as page_start, 30 as page_end))")))
    return layout.page_of(base.withColumn("start", (F.col("doc_id") % 30).cast("int")), pages).select("doc_id", "start", "page")


# People, time and owners.


def _failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("account"), "ts", (F.col("event_type") != "error").alias("ok"))


@query("failed_login_lockout", """WITH f AS (SELECT event_id, user_id AS account, ts, event_type <> 'error' AS ok FROM events),
e AS (SELECT *, coalesce(sum(ok::INT) OVER (PARTITION BY account ORDER BY ts, ok ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM f)
SELECT event_id, count(*) FILTER (NOT ok) OVER w AS recent, count(*) FILTER (NOT ok) OVER w >= 5 AS blocked FROM e
WINDOW w AS (PARTITION BY account, epoch ORDER BY ts RANGE BETWEEN INTERVAL 15 MINUTES PRECEDING AND CURRENT ROW)""")
def failed_login_lockout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.lockouts(_failures(spark, sf_dir)).select("event_id", "recent", "blocked")


@query("login_expiry", """WITH RECURSIVE uses AS (
  SELECT user_id AS account, time_bucket(INTERVAL 10 MINUTES, ts) AS ts FROM events
  UNION ALL SELECT -1 - r_regionkey, TIMESTAMP '2026-01-01' + INTERVAL 1 MINUTE * (n * (20 + r_regionkey)) FROM region, range(0, 121) t(n)),
numbered AS (SELECT account, ts, row_number() OVER (PARTITION BY account ORDER BY ts) AS i FROM uses),
run AS (
  SELECT account, i, ts, ts AS started, 1 AS login FROM numbered WHERE i = 1
  UNION ALL
  SELECT n.account, n.i, n.ts, CASE WHEN n.ts - r.ts >= INTERVAL 30 MINUTES OR n.ts - r.started >= INTERVAL 12 HOURS THEN n.ts ELSE r.started END,
         r.login + CASE WHEN n.ts - r.ts >= INTERVAL 30 MINUTES OR n.ts - r.started >= INTERVAL 12 HOURS THEN 1 ELSE 0 END
  FROM run r JOIN numbered n ON n.account = r.account AND n.i = r.i + 1)
SELECT account, started, max(ts) AS last_used, count(*) AS uses FROM run GROUP BY account, started, login""")
def login_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses at ten-minute steps, so that pauses of exactly half an hour are among them; and accounts that are used
    for more than twelve hours without a pause."""
    events = table(spark, sf_dir, "events")
    slot = F.timestamp_micros(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 600_000_000) * 600_000_000)
    steady = table(spark, sf_dir, "region").select((-1 - F.col("r_regionkey")).alias("account"), "r_regionkey", F.explode(F.sequence(F.lit(0), F.lit(120))).alias("n"))
    since = F.timestamp_micros(F.unix_micros(F.lit("2026-01-01 00:00:00+00:00").cast("timestamp")) + F.col("n").cast("bigint") * (20 + F.col("r_regionkey")) * 60_000_000)
    uses = events.select(F.col("user_id").cast("bigint").alias("account"), slot.alias("ts")).unionByName(steady.select(F.col("account").cast("bigint").alias("account"), since.alias("ts")))
    return session.logins(uses).select("account", "started", "last_used", "uses")


@query("ttl_expiry", "SELECT event_id FROM events WHERE ts + INTERVAL 2 HOURS < (SELECT max(ts) FROM events)")
def ttl_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("created"))
    now = events.agg(F.max("created").alias("now"))
    return session.expired(events.crossJoin(F.broadcast(now)), F.col("now")).select("event_id")


@query("orphan_sweep", "SELECT c_custkey AS session_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def orphan_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    folders = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id"))
    return session.orphans(folders, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session_id")))


@query("tenant_scope", "SELECT DISTINCT o_orderkey AS doc_id, s_suppkey AS user_id FROM orders JOIN customer ON o_custkey = c_custkey JOIN supplier ON s_nationkey = c_nationkey WHERE s_suppkey % 4 <> 0")
def tenant_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("c")).join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"), F.col("c_nationkey").alias("tenant_id")), "c").select("doc_id", "tenant_id")
    users = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("user_id"), F.col("s_nationkey").alias("tenant_id"), F.when(F.col("s_suppkey") % 4 == 0, "plataforma").otherwise("revisor").alias("role"))
    return session.reachable(owners, users)


@query("toggle_equals", f"WITH s AS (SELECT o_custkey AS doc_id, o_orderkey AS span_id, o_orderpriority AS value FROM orders) SELECT doc_id, span_id FROM s WHERE EXISTS (SELECT 1 FROM s x WHERE x.doc_id = s.doc_id AND x.value = s.value AND x.span_id % 3 = 0)")
def toggle_equals(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("span_id"), F.concat(F.lit("  "), F.replace("o_orderpriority", F.lit("-"), F.lit("-"))).alias("value"), F.lit("detector").alias("origin"))
    return session.same_values(at, F.when(F.col("span_id") % 3 == 0, F.col("span_id"))).select("doc_id", "span_id")


# Scalars.


@query("fingerprint", "SELECT n_nationkey, sha256('{\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}') AS fingerprint FROM nation")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.fingerprint(table(spark, sf_dir, "nation"), ["n_regionkey", "n_name"]).select("n_nationkey", "fingerprint")


@query("search_accent_insensitive", "SELECT doc_id FROM documents WHERE contains(strip_accents(lower(text)), 'cion')")
def search_accent_insensitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.search(table(spark, sf_dir, "documents"), "text", "CIÓN").select("doc_id")


@query("brazilian_formats", "SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS day, sha256(o_orderkey::VARCHAR) AS hashed FROM orders")
def brazilian_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", review.br_date(F.col("o_orderdate")).alias("day"), session.token_hash(F.col("o_orderkey")).alias("hashed"))


@query("session_ids", "SELECT o_custkey AS doc_id, o_orderkey AS span_id, 's' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS id FROM orders")
def session_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("span_id"))
    return review.with_ids(at, "span_id").select("doc_id", "span_id", "id")


@query("corpus_summary", f"WITH {P}, gold AS ({t.gold_sql()}) SELECT ['contrato', 'peticao', 'prontuario', 'rh', 'oficio'][(k % 5 + 1)::INT] AS genre, count(DISTINCT k) AS docs, count(g.doc_id) AS entities FROM p LEFT JOIN gold g ON g.doc_id = k GROUP BY 1")
def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.corpus_summary(t.contracts(spark, sf_dir), t.gold(spark, sf_dir))
