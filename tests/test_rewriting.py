import pytest
from pyspark.sql import functions as F

from sparkveil.operators import rewrite, verify


def frame(spark, text, spans):
    return spark.createDataFrame([(1, text, spans)], "doc_id int, text string, spans array<struct<start:int,end:int,entity:string>>")


def test_same_value_same_token_and_gaps_stay(spark):
    text = "Ana Souza viu Ana\nSouza e Bia."
    spans = [(0, 9, "PERSON"), (14, 23, "PERSON"), (26, 29, "PERSON")]
    row = rewrite.pseudonymise(frame(spark, text, spans), seed=3).first()
    tokens = [s["token"] for s in row["substitutions"]]
    assert tokens[0] == tokens[1] != tokens[2] and len(row["tokens"]) == 2
    assert row["rewritten"] == f"{tokens[0]} viu {tokens[1]} e {tokens[2]}."


def test_many_values_never_share_a_token(spark):
    rows = [(d, i * 10, i * 10 + 5, "CPF", f"v{i}") for d in (1, 2) for i in range(500)]
    out = rewrite.tokens(spark.createDataFrame(rows, "doc_id int, start int, end int, entity string, value string"), seed=1)
    assert out.groupBy("doc_id").agg(F.countDistinct("token").alias("n")).where("n <> 500").count() == 0


def test_random_tokens_and_unknown_entities(spark):
    rows = spark.createDataFrame([(1, 0, 3, "CPF", "abc")], "doc_id int, start int, end int, entity string, value string")
    assert rewrite.tokens(rows).first()["token"].startswith("[CPF-")
    with pytest.raises(Exception, match="prefix"):
        rewrite.tokens(rows.withColumn("entity", F.lit("PLACA"))).collect()


def test_touching_edits_are_fine_overlapping_ones_are_not(spark):
    assert rewrite.redact(frame(spark, "abcdef", [(0, 2, "CPF"), (2, 4, "CEP")])).first()["rewritten"] == "ef"
    assert rewrite.redact(frame(spark, "abcdef", [(0, 2, "CPF"), (2, 4, "CEP")]), mark=rewrite.by_entity).first()["rewritten"] == "[CPF][CEP]ef"
    with pytest.raises(Exception, match="overlap"):
        rewrite.redact(frame(spark, "abcdef", [(0, 3, "CPF"), (2, 4, "CEP")])).collect()
    assert rewrite.redact(frame(spark, None, [])).first()["rewritten"] is None


CPF = "529.982.247-25"


@pytest.mark.parametrize(
    ("surface", "leaks"),
    [(CPF, True), ("52998224725", True), ("529 982 247 25", True), ("529-982-247-25", True), ("529/982/247/25", True), ("(529) 982 247-25", True), ("5a2b9c9d8e2f2g4h7i2j5k", False), ("", False), ("529.982.247", False)],
)
def test_written_forms(spark, surface, leaks):
    df = spark.createDataFrame([(surface,)], "s string").select((F.size(verify.leaked_values(F.col("s"), F.array(F.lit(CPF)))) > 0).alias("x"))
    assert df.first()["x"] is leaks


def test_verification_report(spark):
    df = spark.createDataFrame([("[P-00AA] saiu", ["Mariana Souza"], ["[P-00AA]"]), ("Mariana   Souza", ["Mariana Souza"], ["[P-00AA]"]), ("x", ["abc"], [])], "rewritten string, values array<string>, tokens array<string>")
    rows = verify.verify_text(df, tokens="tokens").collect()
    assert [(r["ok"], list(r["leaks"]), list(r["lost_tokens"]), r["n_values"]) for r in rows] == [(True, [], [], 1), (False, ["Mariana Souza"], ["[P-00AA]"], 1), (True, [], [], 0)]


MAIL = "cliente19000@exemplo.com.br"


@pytest.mark.parametrize(
    ("value", "page", "times"),
    [(MAIL, f"{MAIL} e 19.000", 2), (MAIL, "119.000.247-25 e 11900024725", 0), (MAIL, "190.002.471-19", 0), (MAIL, "52998-19000", 0), (MAIL, "n. 19000; 19.000", 2), ("OAB 123.456", "x123456y", 1), ("19.000", "119.000.247-25", 1), ("1234567-X", "0012345678 e 1234567x", 2)],
)
def test_digits_of_a_value_with_letters_count_as_whole_numbers(spark, value, page, times):
    df = spark.createDataFrame([(value, page)], "v string, p string")
    assert df.select(verify.occurrences(F.col("v"), F.col("p")).alias("n")).first()["n"] == times


def test_dissected_mail_is_not_read_in_a_longer_number(spark):
    found = spark.createDataFrame([(1, "streams", MAIL, "x, em Form (xref 3)")], "doc_id int, surface string, value string, detail string")
    pages = spark.createDataFrame([(1, 1, "CPF 119.000.247-25"), (1, 2, "11900024725")], "doc_id int, page int, content string")
    row = verify.dissected(found, pages).first()
    assert (row["occurrences"], row["pages"], row["is_visible"], row["object"]) == (0, [], False, "Form (xref 3)")


@pytest.mark.parametrize(
    ("surface", "leaks"),
    [(MAIL, True), ("cliente19000 @exemplo", True), ("<3139303030>", False), ("BT <31313930303032343731> Tj 11900024719", False), ("190.002.471-19", False), ("12 19000.", True), ("1-9000", True)],
)
def test_digits_of_a_value_with_letters_leak_as_whole_numbers(spark, surface, leaks):
    df = spark.createDataFrame([(surface,)], "s string").select((F.size(verify.leaked_values(F.col("s"), F.array(F.lit(MAIL)))) > 0).alias("x"))
    assert df.first()["x"] is leaks
