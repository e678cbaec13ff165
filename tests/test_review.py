from pyspark.sql import functions as F

from sparkveil.operators import layout, review


def test_fragments(spark):
    rows = [("Maria Souza", 0, 5, False), ("Maria Souza", 1, 5, True), ("Maria Souza", 0, 3, True), ("a1b", 0, 3, False), ("x,y", 0, 1, False)]
    out = spark.createDataFrame(rows, "body string, s int, e int, want boolean").select("want", review.is_fragment(F.col("body"), F.col("s"), F.col("e")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in out)


def test_repaired_selection(spark):
    rows = [("abc def", 0, 3, "abc", (0, 3)), ("abc def", 0, 3, " def", (4, 7)), ("abc def", 0, 3, "zzz", None), ("abc   def", 3, 6, "   ", None)]
    df = spark.createDataFrame([r[:4] for r in rows], "body string, s int, e int, c string")
    out = df.select(review.repaired(F.col("body"), F.col("s"), F.col("e"), F.col("c")).alias("r")).collect()
    assert [r["r"] and tuple(r["r"]) for r in out] == [r[4] for r in rows]


def test_states_and_order(spark):
    spans = spark.createDataFrame([(1, "a", "CPF", 5, 1, 10.0, True), (1, "b", "CPF", 9, None, None, False), (1, "c", "RG", 1, 1, 2.0, True)], "doc_id int, span_id string, entity string, start int, page int, y0 double, removed boolean")
    assert {r["entity"]: r["state"] for r in review.class_rows(spans).collect()} == {"CPF": "some", "RG": "all"}
    placed = review.reading_order(spans.withColumn("x0", F.lit(0.0)))
    assert [r["span_id"] for r in placed.orderBy("place").collect()] == ["c", "a", "b"]
    around = {r["span_id"]: (r["previous_id"], r["next_id"]) for r in review.neighbours(spans).collect()}
    assert around == {"c": ("b", "a"), "a": ("c", "b"), "b": ("a", "c")}


def test_lines_fill_without_splitting(spark):
    row = spark.range(1).select(layout.wrap(F.array(*map(F.lit, ("aa", "bb", "cccccc", "d"))), 5).alias("x")).first()
    assert row["x"] == ["aa bb", "cccccc", "d"]
