import numpy as np
import pytest

from sparkveil.llm import mixing


def test_targets():
    assert mixing.targets([100, 10, 50], [1, 2, 3], 160) == pytest.approx([32.5, 30, 97.5])
    assert mixing.targets([1, 1], [1, 100], 2) == pytest.approx([0.0198, 1.9802], abs=1e-4)
    assert mixing.targets([], [], 0) == [] and mixing.targets([0, 0], [1, 2], 0) == [0, 0]


def test_pivotal_steps_keep_mass_and_expectation():
    rng = np.random.default_rng(3)
    mass, part = rng.integers(1, 500, 30).astype(float).tolist(), rng.random(30).tolist()
    mean = np.zeros(30)
    for seed in range(5000):
        ones, held, left = mixing.settle(mass, part, np.random.default_rng(seed))
        got = np.array(ones, float)
        if held >= 0:
            got[held] = left
        assert got @ mass == pytest.approx(np.dot(mass, part))
        mean += got
    assert np.abs(mean / 5000 - part).max() < 0.03


def rows_of(n=4000):
    rng = np.random.default_rng(8)
    return [(i, " ".join(["w"] * int(rng.integers(1, 60))), ["s0", "s0", "s1", "s2", None][int(rng.integers(5))]) for i in range(n)] + [(None, "a b", "s1"), (None, None, "s2"), (3, "", None), (1, "x y z", "s1"), (1, "x y z", "s1")]


@pytest.mark.parametrize(("leaf", "fan"), [(10_000, 1000), (50, 4)])
def test_mix_meets_targets(spark, monkeypatch, leaf, fan):
    monkeypatch.setattr(mixing, "LEAF_UNITS", leaf)
    monkeypatch.setattr(mixing, "FANIN", fan)
    rows = rows_of()
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = mixing.copies(df).collect()
    assert sum(r["rows"] for r in out) == len(rows)
    by = {}
    for r in out:
        assert 0 <= r["copies"] <= 3
        by.setdefault(r["source"], [r["source_size"], r["target"], 0, 0])
        by[r["source"]][2] += r["size"] * r["copies"] * r["rows"]
        by[r["source"]][3] += r["size"] * r["rows"]
    total = sum(v[0] for v in by.values())
    assert sum(v[1] for v in by.values()) == pytest.approx(total)
    for size, target, taken, own in by.values():
        assert size == own and abs(taken - target) <= 60
    again = mixing.copies(df.repartition(7)).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))
    mixed = mixing.mix(df.withColumnRenamed("text", "text"))
    assert mixed.count() == sum(r["copies"] * r["rows"] for r in out) and mixed.columns == df.columns


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert mixing.copies(df).count() == 0 and mixing.mix(df).count() == 0
    only = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id bigint, text string, source string")
    assert sorted(r["size"] for r in mixing.copies(only).collect()) == [0, 0]


@pytest.mark.parametrize("n", [50, 1500])
def test_alike_rows_are_settled_one_by_one(spark, n):
    rows = [(None, "one two three four", s, 7, "c") for s in ("s0", "s1", "s2") for _ in range(n)] + [(3, "a b", "s0", 1, "d"), (3, "a c", "s0", 2, "e")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int, name string")
    out = mixing.copies(df).collect()
    assert sum(r["rows"] for r in out) == len(rows)
    for s in ("s0", "s1", "s2"):
        own = [r for r in out if r["source"] == s]
        assert abs(sum(r["size"] * r["copies"] * r["rows"] for r in own) - own[0]["target"]) <= 4
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    words = {}
    for r in mixed.collect():
        words[r["source"]] = words.get(r["source"], 0) + len(r["text"].split())
        assert r["name"] in "cde"
    for s in ("s0", "s1", "s2"):
        assert abs(words[s] - next(r["target"] for r in out if r["source"] == s)) <= 4


def test_many_sources_are_shared_without_the_driver(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 7)), f"s{i % 700:04d}") for i in range(3000)]
    out = mixing.copies(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    sizes = {}
    for _, text, s in rows:
        sizes[s] = sizes.get(s, 0) + len(text.split())
    names = sorted(sizes)
    want = dict(zip(names, mixing.targets([sizes[s] for s in names], [1 + i % 3 for i in range(len(names))], sum(sizes.values()))))
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    for r in out:
        assert r["target"] == pytest.approx(want[r["source"]])
