import re
import unicodedata
from collections import Counter

import corpus_pipeline
import public_tokenizers
from sparkveil.llm import deobfuscate
from tests.llm.test_neardup import plain as plain_groups
from tests.llm.test_rules import plain as plain_facts

SMALL = "/root/testdata/sf0.001"


def test_stages_on_the_smallest_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    kept = []
    for i, r in rows.items():
        words, chars, symbols, lines, doubled, repeated = plain_facts(r["text"])
        letters = sum(unicodedata.category(c)[0] == "L" for c in r["text"])
        short = words < 50 or 100 * repeated > 50 * words or chars > 40 * words or 2 * chars < 3 * words
        if not (short or 10 * symbols > 6 * words or (lines >= 4 and 100 * doubled > 60 * lines) or 100 * letters < 40 * chars):
            kept.append((i, r["text"]))
    stages = [f for _, f in corpus_pipeline.STAGES]
    at = stages[0](spark, docs, SMALL).cache()
    assert sorted(r["doc_id"] for r in at.collect()) == sorted(i for i, _ in kept)

    at = stages[1](spark, at, SMALL).cache()
    single = [i for i, _, root, _ in plain_groups(kept) if i == root]
    assert sorted(r["doc_id"] for r in at.collect()) == sorted(single)

    at = stages[2](spark, at, SMALL).cache()
    for r in at.collect():
        text = rows[r["doc_id"]]["text"]
        base, added = deobfuscate.find(text)
        assert r["text"] == deobfuscate.mask(text, base + added) and r["n_chars"] == len(r["text"])

    sizes = Counter()
    for r in at.collect():
        sizes[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    mixed = stages[3](spark, at, SMALL).cache()
    taken, times = Counter(), Counter()
    for r in mixed.collect():
        taken[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
        times[r["doc_id"]] += 1
    assert max(times.values()) <= 3 and mixed.columns == corpus_pipeline.COLUMNS
    assert abs(sum(taken.values()) - sum(sizes.values())) < 0.1 * sum(sizes.values())

    out = stages[4](spark, mixed, SMALL).collect()
    assert len(out) == mixed.count() and all(r["round_trip"] for r in out)
    assert public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_whole_run_and_empty_input(spark, tmp_path):
    assert corpus_pipeline.run(spark, SMALL).count() > 0
    spark.read.parquet(f"{SMALL}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
