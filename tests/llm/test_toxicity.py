import random
import zlib

import pytest

from sparkveil.llm import toxicity as t
from sparkveil.llm.queries import op9_toxicity_lexicon


def test_folding():
    assert t.fold("1D10T") == t.fold("idiot") == t.fold("ïdіоt") == t.fold("i​d­iot")
    assert t.fold("c1own") == t.fold("clown")
    assert t.fold("") == " " and t.fold("!!") == " "
    assert t.fold("you s c u m b a g") == t.fold("you scumbag") and t.fold("a b cd") == " a b cd "


def test_matching_and_exceptions():
    folded = tuple((t.fold(k).strip(), w) for k, w in (("trash", 2.0), ("idiot", 3.0)))
    own = t.Matcher(folded, ("trash can",))
    assert own.evidence("the trash can is full") == (0.0, 5)
    assert own.evidence("you trash, you 1diots") == (5.0, 4)
    assert own.evidence("subtrash") == (0.0, 1)
    assert t.Matcher((), ()).evidence("any words") == (0.0, 2)


def test_longer_texts_need_more():
    calibration = (-3.0, 0.5, 1.5)
    assert t.score(4.0, 20, calibration) > t.score(4.0, 2000, calibration)


def make(spark, n=1500):
    rnd, docs, labels = random.Random(2), [], []
    for i in range(n):
        words = ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(rnd.randrange(5, 60))]
        toxic = i % 9 == 0
        if toxic:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(["moronic", "Idi0t", "scumbag"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs += [(n, None), (n + 1, ""), (0, docs[0][1]), (None, "scumbag")]
    return docs, labels


def test_held_out_accuracy_and_rows(spark, tmp_path):
    docs, labels = make(spark)
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = op9_toxicity_lexicon(spark, str(tmp_path)).collect()
    assert len(out) == len(docs)
    truth = dict(labels)
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert held and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = t.fit(docs, none)
    assert model.terms == {} and t.toxicity(docs, model).where("predicted = 1").count() == 0
    assert t.toxicity(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("bound", [10, 400])
def test_fit_reads_a_bounded_sample(spark, bound):
    docs, labels = make(spark, 600)
    # One id has very many texts: it is one of the sample's rows all the same.
    docs += [(9, f"text {i}") for i in range(2000)]
    seen = []
    keep, t.calibrate = t.calibrate, lambda w, n, y: seen.append(len(y)) or keep(w, n, y)
    try:
        t.fit(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int"), fit_rows=bound)
    finally:
        t.calibrate = keep
    assert all(n <= bound for n in seen)


def naive(text, terms, exceptions):
    """Every word against every term, one by one."""
    words = t.fold(text).split()
    spared = set()
    for phrase in exceptions:
        own = t.fold(phrase).split()
        for i in range(len(words) - len(own) + 1):
            if words[i : i + len(own) - 1] == own[:-1] and words[i + len(own) - 1].startswith(own[-1]):
                spared |= set(range(i, i + len(own)))
    total = 0.0
    for i, word in enumerate(words):
        fits = [w for term, w in terms if (word == term if len(term) < 4 else word.startswith(term))]
        if fits and i not in spared:
            total += max(fits)
    return total, len(words)


def test_matches_like_a_naive_matcher():
    rnd = random.Random(5)
    vocabulary = ["trash", "can", "tra5h", "idiot", "idi0tic", "ass", "assist", "cl0wn", "fish", "a", "b", "c", "w", "trashcan", "Idióts"]
    terms = tuple((t.fold(k).strip(), w) for k, w in (("trash", 2.0), ("idiot", 3.0), ("idiotic", 4.0), ("ass", 1.5), ("clown", 2.5)))
    own = t.Matcher(terms, ("trash can", "clown fish"))
    for _ in range(500):
        text = rnd.choice([" ", ", ", "\n"]).join(rnd.choice(vocabulary) for _ in range(rnd.randrange(15)))
        assert own.evidence(text) == pytest.approx(naive(text, terms, ("trash can", "clown fish"))), text


def test_rare_terms_count_and_copies_do_not():
    rows = (2000, 18000)
    chosen = t.choose_terms({"scumbag": 25, "rareword": 8, "common": 900, "moron": 30}, {"common": 8000, "moron": 1}, rows)
    assert set(chosen) == {"scumbag", "rareword", "moron"}


def test_words_of_copies_make_no_terms(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(7))
    passage = [word() for _ in range(100)]
    docs, labels = [], []
    for i in range(900):
        words = [word() for _ in range(30)]
        if i % 9 == 0:
            words = passage[:] if i % 18 == 0 else words
            for _ in range(3 if i % 18 == 0 else 1):
                words[rnd.randrange(len(words))] = "scumbag"
        docs.append((i, " ".join(words)))
        labels.append((i, int(i % 9 == 0)))
    model = t.fit(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    assert set(model.terms) == {"scumbag"}


def test_clashing_columns_nulls_and_long_texts(spark):
    docs = [(1, "scumbag " * 5, 1, 2.0, "x"), (None, None, 1, 2.0, "x"), (2, "word " * 500_000, 1, 2.0, "x")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, predicted int, score double, lexicon_weight string")
    out = t.toxicity(df, t.Model({"scumbag": 5.0}, (), (-4.0, 2.0, 1.0))).collect()
    assert [r["predicted"] for r in out] == [1, 0, 0] and len(out[0]) == 5
