import random

from sparkveil.operators import evaluate

GOLD = "doc_id int, label string, start int, end int"


def counts(df):
    return {r["label"]: (r["tp"], r["fp"], r["fn"]) for r in df.collect()}


def test_partial_overlap(spark):
    gold, pred = spark.createDataFrame([(1, "PERSON", 0, 8)], GOLD), spark.createDataFrame([(1, "PERSON", 4, 8)], GOLD)
    assert counts(evaluate.strict(gold, pred)) == {"PERSON": (0, 1, 1)}
    assert counts(evaluate.relaxed(gold, pred)) == {"PERSON": (1, 0, 0)}
    assert evaluate.coverage(gold, pred).first()["coverage"] == 0.5


def test_wrong_label_covers_all_the_same(spark):
    gold, pred = spark.createDataFrame([(1, "CPF", 0, 14)], GOLD), spark.createDataFrame([(1, "RG", 0, 14)], GOLD)
    assert counts(evaluate.relaxed(gold, pred)) == {"CPF": (0, 0, 1), "RG": (0, 1, 0)}
    assert evaluate.coverage(gold, pred).first()["coverage"] == 1.0


def test_a_prediction_serves_one_gold_span(spark):
    gold = spark.createDataFrame([(1, "P", 0, 4), (1, "P", 5, 9)], GOLD)
    pred = spark.createDataFrame([(1, "P", 0, 9), (1, "P", 100, 110)], GOLD)
    assert counts(evaluate.relaxed(gold, pred)) == {"P": (1, 1, 1)}
    row = evaluate.scores(evaluate.relaxed(gold, pred)).first()
    assert (row["precision"], row["recall"], row["f1"], row["support"]) == (0.5, 0.5, 0.5, 2)


def test_nothing_at_all(spark):
    none = spark.createDataFrame([], GOLD)
    assert evaluate.strict(none, none).count() == 0
    assert evaluate.coverage(none, none).first()["coverage"] == 0.0
    assert evaluate.macro_f1(evaluate.scores(evaluate.strict(none, none))).first()["macro_f1"] == 0.0
    register = spark.createDataFrame([], "participante string, documento string, achou string, segundos string, falsos_alarmes string, observacao string")
    assert evaluate.usability(register).first()["sessions"] == 0


def test_alignment(spark):
    docs = spark.createDataFrame([(1, "Nome Silva e Silva fim", "Nome  Silva  e Silva fim")], "doc_id int, source_text string, text string")
    gold = spark.createDataFrame([(1, "P", "Silva", 5, 10), (1, "P", "Silva", 13, 18), (1, "P", "Zeca", 0, 4)], "doc_id int, label string, value string, start int, end int")
    out = evaluate.align(docs, gold).collect()
    assert sorted((r["start"], r["end"]) for r in out if not r["defect"]) == [(6, 11), (15, 20)]
    assert evaluate.defect_rate(evaluate.align(docs, gold)).first()["defects"] == 1


def test_timing_runs_to_the_last_row(spark):
    seen = spark.sparkContext.accumulator(0)

    def make():
        return spark.range(100).mapInPandas(lambda batches: (seen.add(len(b)) or b for b in batches), "id long")

    out, seconds = evaluate.timed(make)
    assert seen.value == 100 and seconds > 0 and out.columns == ["id"]


def test_alignment_of_long_texts_with_few_changes(spark):
    lines = [f"linha {i} com Fulano {i}\n" for i in range(4000)]
    source = "".join(lines)
    target = "".join(line.replace("com", "com  ") if i % 500 == 0 else line for i, line in enumerate(lines))
    gold = [(1, "P", f"Fulano {i}", source.index(f"Fulano {i}\n"), source.index(f"Fulano {i}\n") + len(f"Fulano {i}")) for i in range(0, 4000, 250)]
    out = evaluate.align(spark.createDataFrame([(1, source, target)], "doc_id int, source_text string, text string"), spark.createDataFrame(gold, "doc_id int, label string, value string, start int, end int")).collect()
    assert len(out) == 16 and all(target[r["start"] : r["end"]] == r["value"] and target[r["end"]] == "\n" for r in out)


def test_matching_and_coverage_against_plain_loops(spark):
    rnd = random.Random(6)
    spans = lambda n: [(d, rnd.choice("AB"), s, s + rnd.randrange(1, 9)) for d in range(6) for s in (rnd.randrange(40) for _ in range(n))]
    gold, pred = spans(9), spans(11)
    got = counts(evaluate.relaxed(spark.createDataFrame(gold, GOLD), spark.createDataFrame(pred, GOLD)))
    want = {}
    for label in "AB":
        tp = 0
        for d in range(6):
            free = sorted(p[2:] for p in pred if p[:2] == (d, label))
            for g in sorted(g[2:] for g in gold if g[:2] == (d, label)):
                hit = next((p for p in free if p[0] < g[1] and g[0] < p[1]), None)
                if hit:
                    free.remove(hit)
                    tp += 1
        want[label] = (tp, sum(p[1] == label for p in pred) - tp, sum(g[1] == label for g in gold) - tp)
    assert got == want
    out = evaluate.coverage_by_span(spark.createDataFrame(gold, GOLD), spark.createDataFrame(pred, GOLD)).collect()
    plain = sorted((*g, len({i for p in pred if p[0] == g[0] for i in range(max(p[2], g[2]), min(p[3], g[3]))}), sorted({p[1] for p in pred if p[0] == g[0] and p[2] < g[3] and g[2] < p[3]})) for g in gold)
    assert sorted((r["doc_id"], r["label"], r["start"], r["end"], r["covered"], list(r["labels"])) for r in out) == plain
