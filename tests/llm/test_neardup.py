import random
import re

import numpy as np

from sparkveil.llm import _words, neardup


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain(rows):
    sets = [shingles(t) for _, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i, j = rows[a][0], rows[b][0]
            if i is not None and j is not None and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted((i, len(s), None if i is None else find(i), i is None or find(i) == i) for (i, _), s in zip(rows, sets)) if all(i is not None for i, _ in rows) else [(i, len(s), None if i is None else find(i), i is None or find(i) == i) for (i, _), s in zip(rows, sets)]


def corpus(seed, groups=25, size=9, words=60):
    rnd, rows = random.Random(seed), []
    for _ in range(groups):
        base = [f"w{rnd.randrange(5000)}" for _ in range(rnd.choice([3, 5, words, 3 * words]))]
        for _ in range(rnd.randrange(1, size)):
            own = [w if rnd.random() > 0.012 else "X" + w for w in base]
            rows.append((" " if rnd.random() < 0.5 else "\n").join(own))
    rnd.shuffle(rows)
    return list(enumerate(rows))


def result(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return sorted(map(tuple, neardup.near_duplicates(df).collect()), key=repr)


def test_against_all_pairs(spark):
    rows = corpus(1) + [(9001, None), (9002, ""), (9003, " \n"), (9004, "One TWO"), (9005, "one two"), (9006, "one two three")]
    assert result(spark, rows) == sorted(plain(rows), key=repr)


def test_split_buckets_and_clusters(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SKETCH_CHUNK", 4)
    monkeypatch.setattr(neardup, "TEXT_CHUNK", 3)
    rows = corpus(2, groups=3, size=40)
    assert result(spark, rows) == sorted(plain(rows), key=repr)


def test_repeats_nulls_and_nothing(spark):
    text = "a b c d e f g h i j"
    rows = [(4, text), (4, text), (2, text.upper()), (None, text), (7, "other words here")]
    assert result(spark, rows) == sorted([(4, 6, 2, False), (4, 6, 2, False), (2, 6, 2, True), (None, 6, None, True), (7, 1, 7, True)], key=repr)
    assert result(spark, []) == []


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(500, 500)]
    got = {r["node"]: r["component"] for r in neardup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


def test_sketches_estimate_and_bound():
    rng = np.random.default_rng(5)
    missed = 0
    for _ in range(200):
        keys = rng.integers(1, 1 << 63, 1143, dtype=np.uint64)
        a, b = np.sort(keys[:1000]), np.sort(np.concatenate((keys[:857], keys[1000:])))
        samples = neardup.samples_of(np.concatenate((a, b)), np.array([0, 1000, 2000]))
        sketch = neardup.sketches_of(samples)
        bands = neardup.bands_of(samples)
        missed += np.bitwise_count(sketch[0] ^ sketch[1]).sum() > neardup.sketch_limit() or not (bands[0] == bands[1]).any()
    assert missed == 0


def test_dense_and_sparse_intersections_agree():
    rng = np.random.default_rng(6)
    sets = [np.sort(rng.choice(90, rng.integers(60, 80), replace=False)).astype(np.uint64) for _ in range(60)]
    bounds = np.cumsum([0, *map(len, sets)])
    got = neardup.exact_links(np.concatenate(sets), bounds)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            both = len(np.intersect1d(a, b))
            assert got[i, j] == (i != j and 100 * both >= 75 * (len(a) + len(b) - both))


def morse(n, flip):
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


def test_words_of_one_structure_are_not_taken_for_equal(spark):
    rows = [(i, " ".join([morse(n, f)] * 3 + ["x", "y"])) for i, (n, f) in enumerate((n, f) for n in (8, 64, 1024, 2048, 4096) for f in (0, 1))]
    assert result(spark, rows) == sorted(plain(rows), key=repr)


def test_numbers_of_words_and_shingles_are_exact(monkeypatch):
    rnd = random.Random(3)
    for hashed in (True, False):
        if not hashed:  # all words share a hash
            monkeypatch.setattr(_words, "span_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
        for _ in range(100):
            texts = [" ".join(rnd.choice(["a", "b", "abcdefghij", "abcdefghik", "x" * rnd.choice([8, 9, 70])]) for _ in range(rnd.randrange(12))) for _ in range(rnd.randrange(1, 7))]
            keys, bounds = neardup.exact_sets(texts)
            sets = [shingles(t) for t in texts]
            for i, a in enumerate(sets):
                for j, b in enumerate(sets):
                    assert len(np.intersect1d(keys[bounds[i] : bounds[i + 1]], keys[bounds[j] : bounds[j + 1]])) == len(a & b)


def test_an_id_of_several_texts_joins_their_groups(spark):
    one, two = "a b c d e f g h", "p q r s t u v w"
    got = {(i, c, k) for i, _, c, k in result(spark, [(5, one), (9, one), (9, two), (12, two)])}
    assert got == {(5, 5, True), (9, 5, False), (12, 5, False)}


def test_a_large_group_of_near_copies_is_found_whole(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TEXT_CHUNK", 100)
    rnd = random.Random(7)
    base = [f"w{rnd.randrange(9000)}" for _ in range(200)]
    rows = []
    for i in range(1500):
        own = list(base)
        for at in rnd.sample(range(200), 3):
            own[at] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    # Beside them a chain, in which the ends are unlike: each text moves on by ten words.
    line = [f"c{i}" for i in range(1000)]
    rows += [(2000 + i, " ".join(line[10 * i : 10 * i + 300])) for i in range(60)]
    # Clashing column names and one very long text.
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows] + [(9000, "long " * 400_000, 0, 0, 0)], "doc_id bigint, text string, node int, component int, band int")
    out = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df).collect()}
    assert {out[i] for i in range(1500)} == {0} and {out[2000 + i] for i in range(60)} == {2000} and out[9000] == 9000
