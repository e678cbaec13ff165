import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparkveil.operators import policy, session


def test_profiles_round_trip(spark):
    both = policy.profiles(spark)
    assert policy.from_json(policy.to_json(both)).orderBy("name").collect() == both.orderBy("name").collect()
    assert policy.violations(both).count() == 0
    with pytest.raises(Exception, match="name"):
        policy.from_json(spark.createDataFrame([("{}",)], "value string")).collect()


def test_operators(spark):
    df = spark.createDataFrame([("CPF", None), ("PERSON", True), ("MANUAL", None), ("CEP", False)], "entity string, active boolean")
    rules = F.create_map(F.lit("CPF"), F.lit("pseudonimo"), F.lit("CEP"), F.lit("tarja"))
    out = {r["entity"]: (r["op"], r["gone"]) for r in df.select("entity", policy.span_operator(F.col("entity"), rules, F.lit("manter")).alias("op"), policy.will_be_removed(F.col("active"), policy.operator_of(F.col("entity"), rules, F.lit("manter"))).alias("gone")).collect()}
    assert out == {"CPF": ("pseudonimo", True), "PERSON": ("tarja", True), "MANUAL": ("tarja", False), "CEP": ("tarja", False)}
    changed = spark.range(1).select(policy.with_rule(rules, "CPF", "manter").alias("a"), policy.with_mode(rules, "tarja").alias("b")).first()
    assert changed["a"] == {"CPF": "manter", "CEP": "tarja"} and changed["b"] == {"CPF": "tarja", "CEP": "tarja"}


def test_edits_fold(spark):
    spans = spark.createDataFrame([(1, "a", "CPF"), (1, "b", "CPF"), (2, "c", "CEP")], "doc_id int, span_id string, entity string")
    edits = spark.createDataFrame(
        [(1, 1, "span", "a", None, True, None), (1, 2, "class", None, "CPF", None, "manter"), (1, 3, "span", "b", None, True, None), (1, 4, "entity", "b", "CEP", None, None)],
        "doc_id int, version int, op string, span_id string, entity string, active boolean, operator string",
    )
    out = {r["span_id"]: r for r in session.fold_edits(spans, edits, "tarja").collect()}
    assert (out["a"]["active"], out["a"]["removed"]) == (None, False)
    assert (out["b"]["entity"], out["b"]["removed"]) == ("CEP", True)
    assert (out["c"]["removed"], out["c"]["version"]) == (True, 0)


def test_lockout_and_logins(spark):
    t0 = dt.datetime(2026, 1, 1)
    at = lambda *m: [(1, t0 + dt.timedelta(minutes=x)) for x in m]
    uses = spark.createDataFrame(at(0, 20, 40, 200), "account int, ts timestamp")
    assert sorted(r["uses"] for r in session.logins(uses).collect()) == [1, 3]
    events = [(1, t0 + dt.timedelta(minutes=i), False) for i in range(5)] + [(1, t0 + dt.timedelta(minutes=6), True), (1, t0 + dt.timedelta(minutes=7), False)]
    out = session.lockouts(spark.createDataFrame(events, "account int, ts timestamp, ok boolean")).orderBy("ts").collect()
    assert [r["blocked"] for r in out] == [False] * 4 + [True, True, False]
    assert [r["recent"] for r in out][-1] == 1


EDIT = "doc_id int, version int, op string, span_id string, entity string, active boolean, operator string, rules map<string,string>, value string"


def folded(spark, spans, edits, default="manter"):
    rows = spark.createDataFrame(spans, "doc_id int, span_id string, entity string, origin string, value string, added int")
    return {r["span_id"]: (r["entity"], r["active"], r["operator"], r["removed"]) for r in session.fold_edits(rows, spark.createDataFrame(edits, EDIT), default).collect()}


def test_another_class_does_not_undo_a_removal(spark):
    spans = [(1, "a", "CPF", None, None, None), (1, "b", "ORGANIZATION", None, None, None)]
    edits = [(1, 1, "profile", None, None, None, "manter", {"CPF": "tarja"}, None), (1, 2, "entity", "a", "ORGANIZATION", None, None, None, None), (1, 3, "entity", "b", "CPF", None, None, None, None)]
    assert folded(spark, spans, edits) == {"a": ("ORGANIZATION", True, "manter", True), "b": ("CPF", False, "tarja", False)}


def test_a_profile_clears_what_its_change_concerns(spark):
    spans = [(1, "a", "CPF", None, None, None), (1, "b", "CEP", None, None, None), (1, "m", "MANUAL", "usuario", None, None)]
    decide = [(1, v, "span", i, None, False, None, None, None) for v, i in ((2, "a"), (3, "b"), (4, "m"))]
    edits = [(1, 1, "profile", None, None, None, "tarja", None, None), *decide, (1, 5, "profile", None, None, None, "tarja", {"CEP": "pseudonimo"}, None)]
    assert folded(spark, spans, edits) == {"a": ("CPF", False, "tarja", False), "b": ("CEP", None, "pseudonimo", True), "m": ("MANUAL", False, "tarja", False)}
    edits = [(1, 1, "class", None, "CPF", None, "tarja", None, None), *decide, (1, 6, "class", None, "CPF", None, "tarja", None, None)]
    assert folded(spark, spans, edits)["a"] == ("CPF", None, "tarja", True)


def test_spans_marked_by_hand(spark):
    spans = [(1, "m", "MANUAL", "usuario", "x", 5), (1, "n", "MANUAL", "usuario", "x", 6), (1, "a", "CPF", None, " 1  2", None), (1, "b", "CPF", None, "1 2 ", None), (2, "o", "MANUAL", "usuario", "x", 1)]
    edits = [(1, 7, "manual", None, None, False, None, None, None), (1, 8, "remove", "n", None, None, None, None, None), (1, 9, "remove", "a", None, None, None, None, None), (1, 10, "equals", None, None, True, None, None, "1 2"), (2, 3, "remove_manual", None, None, None, None, None, None)]
    assert folded(spark, spans, edits) == {"m": ("MANUAL", False, "tarja", False), "a": ("CPF", True, "manter", True), "b": ("CPF", True, "manter", True)}
    assert set(folded(spark, spans[:1], [(1, 4, "remove_manual", None, None, None, None, None, None)])) == {"m"}


def test_pauses_and_the_end_of_a_login(spark):
    t0 = dt.datetime(2026, 1, 1)
    uses = spark.createDataFrame([(a, t0 + dt.timedelta(minutes=m)) for a, ms in ((1, [0, 30, 59]), (2, [*range(0, 720, 20), 715, 744, *range(764, 1460, 20)])) for m in ms], "account int, ts timestamp")
    out = session.logins(uses).orderBy("account", "login").collect()
    minutes = lambda t: int((t - t0).total_seconds() // 60)
    assert [(r["account"], minutes(r["started"]), minutes(r["last_used"])) for r in out] == [(1, 0, 0), (1, 30, 59), (2, 0, 715), (2, 744, 1444)]


def test_ids_and_times(spark):
    ids = [r[0] for r in spark.range(50).select(session.fresh_id()).collect()]
    assert len(set(ids)) == 50
    row = spark.range(1).select(session.utc_now().alias("now"), F.current_timestamp().alias("local"), session.token_hash(F.lit("abc")).alias("h")).first()
    assert abs((row["now"] - row["local"]).total_seconds()) < 60 and row["h"].startswith("ba7816bf")


def test_pairs_of_documents_and_users_are_made_without_a_shuffle_of_them(spark):
    owners = spark.createDataFrame([(1, 1), (1, 2), (1, 1), (2, 2), (3, None), (None, 1), (4, 9)], "doc_id bigint, tenant_id int")
    users = spark.createDataFrame([(7, 1, "revisor"), (7, 2, "revisor"), (8, 2, "revisor"), (8, 2, "revisor"), (9, 1, "plataforma"), (5, None, "revisor"), (6, 2, None), (None, 2, "revisor")], "user_id bigint, tenant_id int, role string")
    out = session.reachable(owners, users)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(1, 7), (1, 8), (1, None), (2, 7), (2, 8), (2, None), (None, 7)], key=repr)
    top = out._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[0]
    assert "Generate explode" in top and "Aggregate" not in top


def test_pairs_of_many_documents_and_users(spark):
    owners = spark.range(3000).selectExpr("id AS doc_id", "cast(id % 3 AS int) AS tenant_id").union(spark.range(0, 3000, 7).selectExpr("id", "cast(id % 5 AS int)"))
    users = spark.range(300).selectExpr("id AS user_id", "cast(id % 4 AS int) AS tenant_id", "'revisor' AS role").union(spark.range(0, 300, 5).selectExpr("id", "cast(id % 3 AS int)", "'revisor'"))
    out, plain = session.reachable(owners, users), owners.join(users, "tenant_id").select("doc_id", "user_id").distinct()
    both = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("doc_id", "user_id").cast("decimal(38,0)"))).first()
    assert tuple(both(out)) == tuple(both(plain))
