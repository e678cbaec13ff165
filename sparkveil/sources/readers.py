"""Sources and sinks: corpora, registers, profiles, uploads, gated output, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CORPUS = "doc_id string, genero string, pdf string, source_text string, gold array<struct<label:string,value:string,start:int,end:int>>"
INDEX = "n int, semente int, generos map<string,int>, entidades_total int, documentos array<struct<doc_id:string,genero:string,entidades:int>>"
REGISTER = "participante string, documento string, achou string, segundos string, falsos_alarmes string, observacao string"
RUNS = "doc_id string, page int, block int, line int, seq int, x0 double, y0 double, x1 double, y1 double, content string"
MOST_BYTES = 50 * 1024 * 1024


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that a folder's index.json lists, each from its own JSON file."""
    listed = spark.read.schema(INDEX).json(f"{folder}/index.json", multiLine=True).select(F.explode("documentos.doc_id").alias("doc_id"))
    docs = spark.read.schema(CORPUS).option("pathGlobFilter", "*.json").json(folder, multiLine=True).where("source_text IS NOT NULL")
    return docs.join(listed, "doc_id", "left_semi")


def register(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REGISTER).csv(path, header=True)


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of documents under a folder, at any depth; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{pdf,txt,json}").load(folder)
    return found.select("path", "length")


def upload_status(content: Column, length: Column, text: Column | None = None) -> Column:
    """The status an upload gets by its bytes: 400 empty, 413 too large, 415 not a PDF, 422 encrypted, unreadable, or,
    where its `text` is given, without any; else 201. A file is encrypted if a trailer or a stream of references names
    the dictionary for it, unreadable without a place where its references start."""
    latin = F.decode(content, "ISO-8859-1")
    encrypted = latin.rlike(r"(?s)(?:trailer\s*<<|/Type\s*/XRef)(?:(?!endobj|startxref).)*/Encrypt\s")
    unreadable = ~latin.rlike(r"startxref\s+\d+")
    blank = F.lit(False) if text is None else ~F.coalesce(text, F.lit("")).rlike(r"(?U)\S")
    broken = F.coalesce(encrypted, F.lit(False)) | unreadable | blank
    return F.when(F.coalesce(length, F.lit(0)) == 0, 400).when(length > MOST_BYTES, 413).when(F.substring(content, 1, 4) != F.encode(F.lit("%PDF"), "US-ASCII"), 415).when(broken, 422).otherwise(201)


def text_runs(spark: SparkSession, path: str) -> DataFrame:
    """Runs of text of pages, as layout.text_map takes them, from JSON lines that an extractor wrote."""
    return spark.read.schema(RUNS).json(path)


def characters(pages: DataFrame) -> DataFrame:
    """(doc_id, page, pos, ch) of page texts (doc_id, page, text), pages joined by line feeds, in document order."""
    from sparkveil.operators import layout

    at = layout.offsets(pages.withColumn("content", F.concat("text", F.lit("\n"))), order="page")
    chars = at.select("doc_id", "page", "start", F.posexplode(F.split("content", "")).alias("i", "ch"))
    return chars.where("ch <> ''").select("doc_id", "page", (F.col("start") + F.col("i")).alias("pos"), "ch")


def write_verified(df: DataFrame, path: str, *, column: str = "rewritten", edits: DataFrame | None = None) -> DataFrame:
    """Write texts that passed verification; (doc_id, ok) of all. Nothing is left of those that failed. With edits
    (doc_id, version), texts (doc_id, version, ...) of a version that is no longer the current one fail too.

    The input is worked out once, beside the output, and then split: the text that was judged is the text written,
    also where tokens are random. What was judged goes when the output stands.
    """
    from sparkveil.operators import session

    spark = df.sparkSession
    keys = ["doc_id", "ok", F.col(column).alias("text"), *(["version"] if edits is not None else [])]
    judged = f"{path.rstrip('/')}.judged"
    df.select(*keys).write.mode("overwrite").parquet(judged)
    all_ = spark.read.parquet(judged)
    good = all_.where("ok")
    if edits is not None:
        good = session.valid_results(good, edits)
    good.select("doc_id", "text").write.mode("overwrite").parquet(path)
    status = f"{path.rstrip('/')}.status"
    passed = spark.read.parquet(path).select("doc_id").distinct().withColumn("passed", F.lit(True))
    all_.select("doc_id").join(passed, "doc_id", "left").select("doc_id", F.coalesce("passed", F.lit(False)).alias("ok")).write.mode("overwrite").parquet(status)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(judged)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    return spark.read.parquet(status)


def markdown(rows: DataFrame, columns: list[str], order: list[Column]) -> DataFrame:
    """(line_no, line) of a table in Markdown: a heading, a rule and a line a row. For reports, small by nature."""
    from pyspark.sql import Window

    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), F.lit(" |"))
    body = rows.select((F.row_number().over(Window.orderBy(*order)) + 1).alias("line_no"), cells.alias("line"))
    spark = rows.sparkSession
    head = spark.createDataFrame([(0, "| " + " | ".join(columns) + " |"), (1, "|" + "---|" * len(columns))], "line_no int, line string")
    return head.unionByName(body)


def generated_people(spark: SparkSession, n: int) -> DataFrame:
    """n synthetic people with identifiers, from a range: any number, in any number of partitions."""
    from sparkveil.functions import generators as g

    return g.with_identifiers(spark.range(1, n + 1).withColumnRenamed("id", "k"))
