import hashlib

from pyspark.sql import functions as F

from sparkveil.llm import merkle


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, record binary")


def test_audit_finds_what_differs(spark, monkeypatch):
    monkeypatch.setattr(merkle, "FILE_RECORDS", 40)
    rows = [(i, f"record {i}".encode()) for i in range(2000)] + [(None, b"x"), (5, b"record 5")]
    bad = {17, 900, 1999}
    other = [(i, b"RECORD" + r[6:] if i in bad else r) for i, r in rows]
    out = merkle.audit(frame(spark, rows), frame(spark, other)).collect()
    assert len(out) == len(rows)
    assert {r["page_id"] for r in out if r["status"] != "intact"} == bad
    for r in out:
        if r["page_id"] is not None:
            assert r["digest"] == hashlib.sha256(f"record {r['page_id']}".encode()).hexdigest()
    byfile = {}
    for r in sorted(out, key=lambda r: (r["file_id"], r["seq"])):
        assert r["offset"] == byfile.get(r["file_id"], 0)
        byfile[r["file_id"]] = r["offset"] + r["length"]


def statuses(spark, rows, other, **columns):
    out = merkle.audit(frame(spark, rows), frame(spark, other)).collect()
    return sorted((r["page_id"], r["status"]) for r in out if r["status"] not in ("intact", "moved")), out


def test_missing_and_extra_records_are_named(spark):
    rows = [(i, b"record %d" % i) for i in range(30)]
    bad, out = statuses(spark, rows, rows[:3] + rows[4:])
    assert bad == [(3, "missing")]
    assert sorted(r["page_id"] for r in out if r["status"] == "moved") == list(range(4, 30))
    assert statuses(spark, rows[:3] + rows[4:], rows)[0] == [(3, "extra")]
    assert statuses(spark, rows[:29], rows)[0] == [(29, "extra")]
    assert statuses(spark, rows, rows[:7] + [(7, b"short")] + rows[9:] + [(100, b"new")])[0] == [(7, "altered"), (8, "missing"), (100, "extra")]


def test_repeated_and_null_keys_fill_no_file(spark, monkeypatch):
    monkeypatch.setattr(merkle, "FILE_RECORDS", 20)
    rows = [(None, b"n%d" % i) for i in range(400)] + [(7, b"same")] * 5 + [(i, b"r%d" % i) for i in range(100, 300)]
    entries = merkle.manifest(frame(spark, rows), 30, merkle.often(frame(spark, rows)))
    assert entries.groupBy("file_id").count().agg(F.max("count")).first()[0] < 60
    other = [r for r in rows if r != (None, b"n17")] + [(None, b"new"), (7, b"same")]
    out = merkle.audit(frame(spark, rows), frame(spark, other)).collect()
    named = {(r["status"], r["page_id"], r["digest"] or r["replica_digest"]) for r in out if r["status"] not in ("intact", "moved")}
    assert named == {("missing", None, hashlib.sha256(b"n17").hexdigest()), ("extra", None, hashlib.sha256(b"new").hexdigest()), ("extra", 7, hashlib.sha256(b"same").hexdigest())}


def test_clashing_columns_and_long_records(spark):
    rows = [(i, bytes([i]) * (3_000_000 if i == 2 else 5), i, "x") for i in range(9)]
    make = lambda r: spark.createDataFrame(r, "page_id bigint, record binary, seq int, status string")
    out = merkle.audit(make(rows), make([r for r in rows if r[0] != 4])).collect()
    assert [(r["page_id"], r["status"]) for r in out if r["status"] not in ("intact", "moved")] == [(4, "missing")] and len(out) == 9


def test_same_and_empty(spark):
    rows = [(i, b"a" * i) for i in range(10)]
    assert merkle.audit(frame(spark, rows), frame(spark, rows[::-1])).where("status <> 'intact'").count() == 0
    assert merkle.audit(frame(spark, []), frame(spark, [])).count() == 0
    assert [r["status"] for r in merkle.audit(frame(spark, []), frame(spark, [(1, b"x")])).collect()] == ["extra"]


def test_levels_shrink_to_one_root(spark):
    entries = merkle.manifest(frame(spark, [(i, str(i).encode()) for i in range(600)]), 3, spark.createDataFrame([], "name string"))
    both = entries.withColumn("replica", F.lit(0)).unionByName(entries.withColumn("replica", F.lit(1)))
    found = merkle.trees(both, 3, 300)
    assert found.within >= 2 and found.levels[-1].count() == 2
    sizes = [level.count() for level in found.levels]
    assert sizes == sorted(sizes, reverse=True) and merkle.differing(found).count() == 0


def test_null_parts_of_a_record(spark):
    df = spark.createDataFrame([(None, None, None)], "page_id bigint, url string, html string")
    assert "Content-Length: 0" in df.select(merkle.record_bytes(F.col("page_id"), F.col("url"), F.col("html")).alias("r")).first()["r"]
