import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sparkveil.llm import hpylm


def plain_base(rows):
    def tokens(text):
        return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) + [None]

    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, _ in rows]
    counts = Counter(t for (_, x), h in zip(rows, held) if not h for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    return [(i, h, len(tokens(x)), sum(counts[t] > 0 for t in tokens(x)), n, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens(x))) for (i, x), h in zip(rows, held)]


def make_rows(n=300):
    rng = np.random.default_rng(4)
    kinds = [[f"{p}{i}" for i in range(400)] for p in "abc"]
    weight = 1 / np.arange(1, 401)
    rows = [(i, " ".join(rng.choice(kinds[i % 3], 60, p=weight / weight.sum()))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (None, "A1 a1"), (0, rows[0][1])]


@pytest.mark.parametrize("shard_bytes", [1 << 26, 20_000])
def test_scores(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(hpylm, "SHARD_BYTES", shard_bytes)
    rows = make_rows()
    out = hpylm.language_model_scores(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    got = sorted((r[:6] for r in out), key=repr)
    want = sorted(plain_base(rows), key=repr)
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-6)
    assert len(got) == len(want)
    held = [r for r in out if r["held_out"] and r["n_tokens"] > 1]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in out)


def test_empty_and_untrained(spark):
    assert hpylm.language_model_scores(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    held = next(i for i in range(100) if hpylm.is_held_out(i))
    row = hpylm.language_model_scores(spark.createDataFrame([(held, "x y")], "doc_id bigint, text string")).first()
    assert row["train_tokens"] == 0 and row["n_known"] == 0 and row["n_tokens"] == 3 and math.isfinite(row["score"])


def log_numbers(c, d):
    at = np.full(c + 2, -np.inf)
    at[0] = 0
    for n in range(c):
        t = np.arange(1, c + 2)
        with np.errstate(divide="ignore", invalid="ignore"):
            at = np.concatenate(([-np.inf], np.logaddexp(at[:-1], at[1:] + np.where(n > t * d, np.log(np.maximum(n - t * d, 1e-300)), -np.inf))))
    return at


@pytest.mark.parametrize("discount", [0.3, 0.5, 0.8])
def test_table_counts_follow_their_conditional(discount):
    rng = np.random.default_rng(9)
    for c, pull in ((2, 0.3), (3, 1.0), (6, 4.0), (100, 50.0), (400, 5.0), (2000, 0.3), (3000, 2400.0)):
        weight = log_numbers(c, discount) + np.arange(c + 2) * math.log(pull)
        weight = np.exp(weight - weight.max())
        mean = (weight * np.arange(c + 2)).sum() / weight.sum()
        drawn = hpylm.seat(np.full(20_000, c), np.full(20_000, pull), discount, rng)
        assert drawn.min() >= 1 and drawn.max() <= c
        assert drawn.mean() == pytest.approx(mean, rel=0.02)
    assert hpylm.seat(np.array([0, 1, 10**7]), np.full(3, 2.0), discount, rng).tolist()[:2] == [0, 1]


def shards_of(texts, n, hot=()):
    """The pairs of texts dealt over n shards as blocks do, with all words in all contexts that occur."""
    hot = np.sort(np.array(hot, np.uint64))
    words, classes, _ = hpylm.pair_keys(texts)
    own, kinds, place = hpylm.distinct_pairs(words, classes)
    counts = np.bincount(place)
    every, each = np.unique(own), np.unique(kinds)
    all_words, all_classes = np.repeat(every, len(each)), np.tile(each, len(every))
    seen = {(w, c): k for w, c, k in zip(own.tolist(), kinds.tolist(), counts.tolist())}
    trained = np.array([seen.get(p, 0) for p in zip(all_words.tolist(), all_classes.tolist())], np.uint32)
    owner = hpylm._spread(all_words, n)
    dealt = np.isin(all_words, hot)
    owner[dealt] = hpylm._spread(all_words[dealt] + all_classes[dealt].astype(np.uint64), n)
    out = []
    for s in range(n):
        at = np.flatnonzero(owner == s)
        w = all_words[at]
        fresh = np.concatenate(([True], w[1:] != w[:-1])) if len(w) else np.zeros(0, bool)
        sizes = np.diff(np.concatenate((np.flatnonzero(fresh), [len(w)])))
        out.append(hpylm.Shard([hpylm._pack(words=np.diff(w[fresh], prepend=np.uint64(0)), sizes=sizes.astype(np.uint32), classes=all_classes[at], trained=trained[at])], hot))
    return out, hot, each


def zipf_texts(seed=0):
    return [" ".join(f"w{int(x)}" for x in np.random.default_rng(seed + i).zipf(1.5, 200) % 50).encode() for i in range(20)]


@pytest.mark.parametrize(("n", "dealt"), [(1, 0), (5, 0), (5, 3)])
def test_predictive_probabilities_sum_to_one(n, dealt):
    words, _, _ = hpylm.pair_keys(zipf_texts())
    names, counts = np.unique(words, return_counts=True)
    shards, hot, each = shards_of(zipf_texts(), n, names[np.argsort(-counts)[:dealt]])
    states = []
    for k in range(4):
        for number, shard in enumerate(shards):
            if k:
                shard.sweep(states[-1], np.random.default_rng([7, number, k]))
        states.append(hpylm.with_hot_words(hpylm.add_up([s.sums(len(hot)) for s in shards]), states[-1] if states else None, 7, k))
        g = states[-1]
        known = sum(np.bincount(s.classes, weights=s.predictive(g), minlength=hpylm.CLASSES) for s in shards)[each]
        d, d0 = hpylm._discount(g["ones"], g["twos"]), hpylm._discount(g["root_ones"], g["root_twos"])
        unknown = (1 + d * g["tables"][each]) / (1 + g["tokens"][each]) * (1 + d0 * g["root_tables"]) * 0.5 / (1 + g["root_customers"])
        assert known + unknown == pytest.approx(np.ones(len(each)), abs=1e-9)


def test_against_a_plain_sampler_of_seatings():
    """Table by table: customers leave and sit down again one at a time, in restaurants kept as lists."""
    texts = [b"a b a b c", b"a b c a", b"b a b"]
    shards, hot, each = shards_of(texts, 1)
    shard = shards[0]
    g = hpylm.with_hot_words(shard.sums(0), None, 1, 0)
    d, d0 = hpylm._discount(g["ones"], g["twos"]), hpylm._discount(g["root_ones"], g["root_twos"])
    # The sampler's discounts follow its sums; both are held here so that the two run on the same model.
    fixed = {k: g[k] for k in ("ones", "twos", "root_ones", "root_twos")}
    mean, kept = np.zeros(len(shard.classes)), 0
    rng = np.random.default_rng(3)
    for k in range(6000):
        shard.sweep(g, rng)
        g = hpylm.with_hot_words(shard.sums(0), g, 1, k) | fixed
        if k >= 500:
            mean += shard.predictive(g)
            kept += 1
    mean /= kept

    tokens = [(int(w), int(c)) for w, c, n in zip(shard.word, shard.classes, shard.customers) for _ in range(n)]
    words, base = int(shard.word.max()) + 1, (1 - hpylm.UNKNOWN) / int(g["words"])
    room = {c: [[] for _ in range(words)] for c in set(shard.classes.tolist())}  # context -> word -> sizes of tables
    root = [[] for _ in range(words)]
    rnd = random.Random(5)

    def p0(w):
        t, c = sum(map(len, root)), sum(map(sum, root))
        return (sum(root[w]) - d0 * len(root[w]) + (1 + d0 * t) * base) / (1 + c)

    def sit_root(w):
        t = sum(map(len, root))
        weights = [x - d0 for x in root[w]] + [(1 + d0 * t) * base]
        i = rnd.choices(range(len(weights)), weights)[0]
        root[w].append(1) if i == len(root[w]) else root[w].__setitem__(i, root[w][i] + 1)

    def sit(w, c):
        t = sum(map(len, room[c]))
        weights = [x - d for x in room[c][w]] + [(1 + d * t) * p0(w)]
        i = rnd.choices(range(len(weights)), weights)[0]
        if i < len(room[c][w]):
            room[c][w][i] += 1
        else:
            room[c][w].append(1)
            sit_root(w)

    def leave(w, c):
        i = rnd.choices(range(len(room[c][w])), room[c][w])[0]
        room[c][w][i] -= 1
        if not room[c][w][i]:
            del room[c][w][i]
            j = rnd.choices(range(len(root[w])), root[w])[0]
            root[w][j] -= 1
            if not root[w][j]:
                del root[w][j]

    for w, c in tokens:
        sit(w, c)
    plain, kept = np.zeros(len(mean)), 0
    for k in range(4000):
        for w, c in tokens:
            leave(w, c)
            sit(w, c)
        if k >= 300:
            for i, (w, c) in enumerate(zip(shard.word.tolist(), shard.classes.tolist())):
                t, n = sum(map(len, room[c])), sum(map(sum, room[c]))
                plain[i] += (sum(room[c][w]) - d * len(room[c][w]) + (1 + d * t) * p0(w)) / (1 + n)
            kept += 1
    assert mean == pytest.approx(plain / kept, rel=0.06)


def test_frequent_words_are_dealt_and_score_alike(spark, monkeypatch):
    """A word of a third of all tokens goes over all shards; scores stay near those of one shard."""
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(x for _ in range(40) for x in ("the", f"w{rng.zipf(1.4) % 300}", f"v{rng.integers(40)}"))) for i in range(120)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, block string")
    one = {r["doc_id"]: r for r in hpylm.language_model_scores(df).collect()}
    monkeypatch.setattr(hpylm, "SHARD_BYTES", 6_000)
    monkeypatch.setattr(hpylm, "HOT_TOKENS", 2_000)
    monkeypatch.setattr(hpylm, "SAMPLED", 1)
    assert len(hpylm.hot_words(df.select("doc_id", "text"))) == 1
    many = {r["doc_id"]: r for r in hpylm.language_model_scores(df.repartition(5)).collect()}
    for i, r in one.items():
        assert many[i]["n_known"] == r["n_known"] and many[i]["base_score"] == pytest.approx(r["base_score"])
        assert many[i]["score"] == pytest.approx(r["score"], rel=0.02)


def test_one_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(hpylm, "BLOCK_TOKENS", 1000)
    rows = [(1, "long words here " * 100_000), (2, "long words"), (3, None)]
    out = {r["doc_id"]: r for r in hpylm.language_model_scores(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert out[1]["n_tokens"] == 300_001 and out[3]["n_tokens"] == 1 and all(math.isfinite(r["score"]) for r in out.values())
