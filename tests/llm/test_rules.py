import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkveil.llm import rules


def plain(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen: dict = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for places in seen.values() if len(places) > 1 for i in places for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(covered)


def measured(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    return {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_lines"], r["n_dup_lines"], r["n_repeat_words"]) for r in rules.measure(df).collect()}


TEXTS = [None, "", " \n ", "a", "a a a a", "a b c a b c", "x y z\nx y z\n\nx y z", "# $ 😀😀 |é|", "one two three " * 40, "\v\fa\rb", "a b c d a b c", "l\n l\nl", "w " * 3000]


def test_measurements(spark):
    assert measured(spark, TEXTS) == {i: plain(t) for i, t in enumerate(TEXTS)}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab \n#é", max_size=40), min_size=20, max_size=40))
def test_measurements_of_any_text(spark_session, texts):
    assert measured(spark_session, texts) == {i: plain(t) for i, t in enumerate(texts)}


@pytest.fixture(scope="module")
def spark_session(spark):
    return spark


def test_policies_and_ablations(spark):
    df = spark.createDataFrame([(1, "word " * 10, 5), (2, " ".join(f"word{i}" for i in range(80)), 6), (3, "same thing again " * 40, 7), (None, None, 8)], "doc_id bigint, text string, failed int")
    entries = rules.ledger(df)
    kept = {r["doc_id"]: r["kept"] for r in rules.apply_policy(entries).collect()}
    assert kept == {1: False, 2: True, 3: False, None: False}
    rows = {r["rule"]: r for r in rules.ablations(entries, rules.BASE).collect()}
    assert rows["too_few_words"]["rejected"] == 3 and rows["too_few_words"]["failing"] == 2
    assert rows["repeated_windows"]["failing"] == 2 and rows["repeated_windows"]["only_this"] == 1
    assert rules.ablations(entries.limit(0)).first()["rejected"] == 0
    assert rules.ledger(df.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    plan = rules.apply_policy(rules.ledger(df))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_columns_with_names_of_its_own(spark):
    df = spark.range(1).select(F.lit("a b").alias("text"), F.lit(1).alias("_vtext"), F.lit(2).alias("_v_words"), F.lit(3).alias("n_words"), F.lit(4).alias("kept"))
    row = rules.apply_policy(rules.ledger(df)).first()
    assert (row["n_words"], row["kept"], row["_vtext"], row["_v_words"]) == (2, False, 1, 2)


def test_version_three_rejects_what_only_its_own_rules_catch(spark):
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    symbols = " ".join(w + "#" * (i % 3) for i, w in enumerate(words))
    lines = "\n".join(["over and done"] * 5 + [" ".join(words)])
    digits = " ".join(f"{i}{'7' * 9}" for i in range(60))
    df = spark.createDataFrame([(1, " ".join(words)), (2, symbols), (3, lines), (4, digits)], "doc_id bigint, text string")
    entries = rules.ledger(df)
    assert {r["doc_id"] for r in rules.apply_policy(entries, rules.POLICIES[2]).where("kept").collect()} == {1, 2, 3, 4}
    assert {r["doc_id"] for r in rules.apply_policy(entries, rules.POLICIES[3]).where("kept").collect()} == {1}
    assert [r["failed"] for r in entries.orderBy("doc_id").collect()] == [0, 4, 8, 64]
