import datetime as dt
import json

from pyspark.sql import functions as F

from sparkveil.operators import verify
from sparkveil.plans import review_catalogue
from sparkveil.sources import readers
from sparkveil.streaming import streams


def test_corpus_and_register(spark, tmp_path):
    docs = [{"doc_id": f"d{i}", "genero": "rh", "pdf": "x.pdf", "source_text": "Ana", "gold": [{"label": "PERSON", "value": "Ana", "start": 0, "end": 3}]} for i in range(3)]
    for d in docs:
        (tmp_path / f"{d['doc_id']}.json").write_text(json.dumps(d))
    (tmp_path / "index.json").write_text(json.dumps({"n": 2, "semente": 1, "generos": {"rh": 2}, "entidades_total": 2, "documentos": [{"doc_id": "d0", "genero": "rh", "entidades": 1}, {"doc_id": "d2", "genero": "rh", "entidades": 1}]}))
    assert sorted(r["doc_id"] for r in readers.corpus(spark, str(tmp_path)).collect()) == ["d0", "d2"]
    assert readers.files(spark, str(tmp_path)).count() == 4
    (tmp_path / "r.csv").write_text("participante,documento,achou,segundos,falsos_alarmes,observacao\na,d,sim,1,0,\n")
    assert readers.register(spark, str(tmp_path / "r.csv")).first()["achou"] == "sim"


def test_upload_status(spark):
    good = b"%PDF-1.7 (text with /Encrypt in it) trailer << /Root 1 0 R >> startxref 9 %%EOF"
    rows = [(b"", ""), (b"hello", "x"), (good.replace(b"/Root", b"/Encrypt 5 0 R /Root"), "x"), (b"%PDF-1.7", "x"), (good, " \n\u00a0"), (good, "x")]
    out = spark.createDataFrame(rows, "content binary, text string").select(readers.upload_status(F.col("content"), F.length("content"), F.col("text")).alias("s"))
    assert [r["s"] for r in out.collect()] == [400, 415, 422, 422, 422, 201]


def test_what_was_judged_is_what_is_written(spark, tmp_path):
    rows = spark.range(40).select(F.col("id").alias("doc_id"), F.rand().alias("r"), (F.col("id") % 2).alias("version"))
    df = rows.select("doc_id", "version", F.col("r").cast("string").alias("rewritten"), (F.col("r") < 0.5).alias("ok"))
    edits = spark.range(40).select(F.col("id").alias("doc_id"), F.lit(1).alias("version"))
    out = readers.write_verified(df, f"{tmp_path}/out", edits=edits)
    kept = {r["doc_id"]: float(r["text"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert all(x < 0.5 and d % 2 == 1 for d, x in kept.items()) and {r["doc_id"] for r in out.where("ok").collect()} == set(kept) and out.count() == 40


def test_gated_sink_characters_and_report(spark, tmp_path):
    df = spark.createDataFrame([(1, "ok", ["abcdef"]), (2, "abcdef", ["abcdef"])], "doc_id int, rewritten string, values array<string>")
    readers.write_verified(verify.verify_text(df), f"{tmp_path}/out")
    assert [r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [1]
    chars = readers.characters(spark.createDataFrame([(1, 1, "ab"), (1, 2, "c")], "doc_id int, page int, text string")).orderBy("pos").collect()
    assert "".join(r["ch"] for r in chars) == "ab\nc\n" and [r["pos"] for r in chars] == list(range(5))
    lines = readers.markdown(df.select("doc_id", "rewritten"), ["doc_id", "rewritten"], [F.col("doc_id")]).orderBy("line_no").collect()
    assert [r["line"] for r in lines] == ["| doc_id | rewritten |", "|---|---|", "| 1 | ok |", "| 2 | abcdef |"]
    assert readers.generated_people(spark, 10).count() == 10


def run(stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(60)


def test_streams(spark, tmp_path):
    docs = spark.createDataFrame([(1, "CPF 529.982.247-25"), (2, "nada")], "doc_id int, text string")
    docs.write.parquet(f"{tmp_path}/docs")
    run(streams.redact_stream(spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/docs")), "redacted")
    assert {r["doc_id"]: r["rewritten"] for r in spark.table("redacted").collect()} == {1: "CPF [CPF]", 2: "nada"}
    at = dt.datetime(2026, 1, 1)
    edits = spark.createDataFrame([(1, 1, at), (1, 3, at), (2, 2, at), (1, 2, at)], "doc_id bigint, version bigint, ts timestamp")
    edits.coalesce(1).write.parquet(f"{tmp_path}/edits")
    run(streams.latest_versions(spark.readStream.schema(edits.schema).parquet(f"{tmp_path}/edits")), "versions")
    assert {r["doc_id"]: r["version"] for r in spark.table("versions").collect()} == {1: 3, 2: 2}
    events = spark.sql("SELECT 1 AS account, timestamp'2026-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id * 10) AS ts FROM range(6) UNION ALL SELECT 2, timestamp'2026-01-03'")
    events.coalesce(1).write.parquet(f"{tmp_path}/events")
    source = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events")
    run(streams.login_windows(source), "logins")
    assert [r["uses"] for r in spark.table("logins").where("account = 1").collect()] == [6]
    run(streams.failure_windows(source), "failures")
    assert spark.table("failures").where("account = 1").count() > 0


def test_redacted_documents_stay_out_of_the_driver(spark, tmp_path):
    docs = spark.createDataFrame([(1, "CPF 529.982.247-25"), (2, None), (3, "nada")], "doc_id bigint, text string")
    docs.repartition(3).write.parquet(f"{tmp_path}/some/documents.parquet")
    docs.where("doc_id > 3").write.parquet(f"{tmp_path}/none/documents.parquet")
    tables = {t.name for t in spark.catalog.listTables()}
    some, none = (review_catalogue.stream_redact(spark, f"{tmp_path}/{d}") for d in ("some", "none"))
    assert some.inputFiles() and {t.name for t in spark.catalog.listTables()} == tables
    assert {r["doc_id"]: r["rewritten"] for r in some.collect()} == {1: "CPF [CPF]", 2: None, 3: "nada"} and none.count() == 0
