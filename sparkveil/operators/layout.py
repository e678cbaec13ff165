"""Characters on pages: implied spaces, visual lines, words, boxes of spans, clipping, offsets.

chars: (doc_id, pos, ch, page, x0, y0, x1, y1), boxes null for separators. Windows are within a document's page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Points of tolerance between lines, of a gap that means a space, and clipping.
LINE_TOLERANCE, SPACE_GAP, CLIP_GAP, CLIP_FLOOR = 2.0, 1.0, 0.05, 0.45


def implied_spaces(runs: DataFrame) -> DataFrame:
    """runs (doc_id, line, seq, x0, x1, content): add `space_before` where the gap to the run before is wide and it
    does not end in a space."""
    order = Window.partitionBy("doc_id", "line").orderBy("seq")
    gap = F.col("x0") - F.lag("x1").over(order)
    ends = F.lag("content").over(order).rlike(r"\s$")
    return runs.withColumn("space_before", F.coalesce((gap > SPACE_GAP) & ~ends, F.lit(False)))


def offsets(pieces: DataFrame, *, partition: str = "doc_id", order: str = "seq", column: str = "content") -> DataFrame:
    """Add start and end of each piece in their concatenation."""
    w = Window.partitionBy(partition).orderBy(order)
    end = F.sum(F.length(column)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return pieces.withColumn("end", end).withColumn("start", F.col("end") - F.length(column))


def page_of(points: DataFrame, pages: DataFrame, position: str = "start") -> DataFrame:
    """Join points (doc_id, position) to the page (doc_id, page, page_start, page_end) that holds them."""
    inside = (points["doc_id"] == pages["doc_id"]) & (F.col(position) >= F.col("page_start")) & (F.col(position) < F.col("page_end"))
    return points.join(pages, inside).drop(pages["doc_id"])


def span_lines(chars: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, start, end, line, page, x0, y0, x1, y1): a span's boxes, one for each visual line: characters whose
    top and bottom stay within the tolerance of the character before, on one page. Spans meet characters by position,
    so the work is that of the spans' lengths."""
    c, s = chars.where("x0 IS NOT NULL"), spans.select("doc_id", "start", "end").distinct().where("end > start")
    inside = c.join(s.withColumn("pos", F.explode(F.expr("sequence(start, end - 1)"))), ["doc_id", "pos"])
    order = Window.partitionBy("doc_id", "start", "end").orderBy("pos")
    far = lambda y: F.abs(F.col(y) - F.lag(y).over(order)) > LINE_TOLERANCE
    fresh = F.coalesce((F.lag("page").over(order) != F.col("page")) | far("y0") | far("y1"), F.lit(True))
    lines = inside.withColumn("_new", fresh.cast("int")).withColumn("line", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return lines.groupBy("doc_id", "start", "end", "line").agg(F.min("page").alias("page"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def words(chars: DataFrame) -> DataFrame:
    """(doc_id, page, word, start, end): runs of characters with boxes and without spaces, on one line."""
    order = Window.partitionBy("doc_id", "page").orderBy("pos")
    solid = F.col("x0").isNotNull() & ~F.col("ch").rlike(r"^\s$")
    at = chars.withColumn("_solid", solid)
    fresh = F.coalesce(~F.lag("_solid").over(order) | (F.abs(F.col("y0") - F.lag("y0").over(order)) > LINE_TOLERANCE), F.lit(True))
    at = at.withColumn("_new", (F.col("_solid") & fresh).cast("int")).withColumn("_word", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("_solid")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ch"))), lambda x: x["ch"]), "")
    return at.groupBy("doc_id", "page", "_word").agg(joined.alias("word"), F.min("pos").alias("start"), (F.max("pos") + 1).alias("end")).drop("_word")


def clip(boxes: DataFrame, lines: DataFrame) -> DataFrame:
    """boxes (box_id, page, x0, y0, x1, y1) with top and bottom drawn in from text lines (page, x0, y0, x1, y1) just
    above and below that share part of their width, never under a share of their height."""
    b, t = boxes.alias("b"), lines.alias("t")
    near = (F.col("b.page") == F.col("t.page")) & (F.col("t.x0") < F.col("b.x1")) & (F.col("b.x0") < F.col("t.x1"))
    middle, own = (F.col("t.y0") + F.col("t.y1")) / 2, (F.col("b.y0") + F.col("b.y1")) / 2
    at = b.join(t, near, "left").groupBy("b.box_id", "b.page", "b.x0", "b.y0", "b.x1", "b.y1").agg(
        F.max(F.when((middle < own) & (F.col("t.y1") > F.col("b.y0")) & (F.col("t.y1") < F.col("b.y1")), F.col("t.y1"))).alias("above"),
        F.min(F.when((middle > own) & (F.col("t.y0") < F.col("b.y1")) & (F.col("t.y0") > F.col("b.y0")), F.col("t.y0"))).alias("below"),
    )
    top = F.greatest(F.col("y0"), F.coalesce(F.col("above") + CLIP_GAP, F.col("y0")))
    bottom = F.least(F.col("y1"), F.coalesce(F.col("below") - CLIP_GAP, F.col("y1")))
    fits = bottom - top >= CLIP_FLOOR * (F.col("y1") - F.col("y0"))
    return at.select("box_id", "page", "x0", F.when(fits, top).otherwise(F.col("y0")).alias("y0"), "x1", F.when(fits, bottom).otherwise(F.col("y1")).alias("y1"))


def wrap(segments: Column, width: int) -> Column:
    """Array of lines: segments joined by spaces, as many a line as fit, none split."""
    zero = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("now"))

    def step(acc: Column, s: Column) -> Column:
        longer = F.when(acc["now"] == "", s).otherwise(F.concat(acc["now"], F.lit(" "), s))
        return F.when(F.length(longer) <= width, F.struct(acc["lines"].alias("lines"), longer.alias("now"))).otherwise(F.struct(F.when(acc["now"] == "", acc["lines"]).otherwise(F.array_append(acc["lines"], acc["now"])).alias("lines"), s.alias("now")))

    return F.aggregate(segments, zero, step, lambda acc: F.when(acc["now"] == "", acc["lines"]).otherwise(F.array_append(acc["lines"], acc["now"])))


def token_fits(token: Column, width: Column, height: Column) -> Column:
    """Whether a token, set at 0.728 of a box's height, takes up to 0.98 of its width. Widths are those of the
    characters tokens have, in thousandths of the size."""
    # Helvetica widths of brackets and hyphen, digits, and capital letters.
    widths = {"[": 278, "]": 278, "-": 333} | {str(d): 556 for d in range(10)} | dict(zip("ABCDEFGHIJKLMNOPQRSTUVWXYZ", (667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611)))
    table = F.create_map(*(F.lit(v) for pair in widths.items() for v in pair))
    total = F.aggregate(F.split(token, ""), F.lit(0), lambda acc, c: acc + F.coalesce(F.element_at(table, c), F.lit(0)))
    return total / 1000 * 0.728 * height <= width * 0.98


def prose(body: Column, width: int = 92) -> Column:
    """Array of lines: words with single spaces, as many a line as fit; a longer word is cut."""
    cut = lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.length(w) - 1) / width)), lambda i: F.substring(w, (i * width + 1).cast("int"), F.lit(width)))
    words_ = F.filter(F.split(body, r"(?U)\s+"), lambda w: w != "")
    return wrap(F.flatten(F.transform(words_, cut)), width)


def paginate(lines: DataFrame, top: float, bottom: float) -> DataFrame:
    """lines (doc_id, seq, height): add page and y. A line is set at y, which then moves on by its height; where y is
    past the bottom before a line, a page starts. Lines of a document are folded in their order."""
    rows = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.col("height").cast("double").alias("height")))).alias("_lines"))
    seq = dict(lines.dtypes)["seq"]
    out = f"array<struct<seq:{seq},page:int,y:double>>"
    turned = f"if(a.y > {bottom}d, struct(a.page + 1 as page, {top}d as y), struct(a.page as page, a.y as y))"
    step = f"element_at(transform(array({turned}), p -> struct(p.page as page, p.y + l.height as y, array_append(a.out, struct(l.seq as seq, p.page as page, p.y as y)) as out)), 1)"
    return rows.select("doc_id", F.inline(F.expr(f"aggregate(_lines, struct(1 as page, {top}d as y, cast(array() as {out}) as out), (a, l) -> {step}, a -> a.out)")))


def segments(content: Column) -> Column:
    """array<struct<text, label>> of a line given as JSON: a text, a pair of text and label, or a list of texts and pairs."""
    item = lambda x: F.when(x.startswith("["), F.struct(F.get(F.from_json(x, "array<string>"), F.lit(0)).alias("text"), F.get(F.from_json(x, "array<string>"), F.lit(1)).alias("label"))).otherwise(F.struct(x.alias("text"), F.lit(None).cast("string").alias("label")))
    is_pair = content.rlike(r'^\s*\[\s*"(?:[^"\\]|\\.)*"\s*,\s*(?:"[A-Z_]+"|null)\s*\]\s*$')
    alone = F.get(F.from_json(F.concat(F.lit("["), content, F.lit("]")), "array<string>"), F.lit(0))
    return F.when(is_pair, F.array(item(content))).when(content.rlike(r"^\s*\["), F.transform(F.from_json(content, "array<string>"), item)).otherwise(F.array(F.struct(alone.alias("text"), F.lit(None).cast("string").alias("label"))))


def windows(body: str, size: int = 1200, overlap_: int = 200) -> Column:
    """array<struct<start, end>> of windows for a model over a column of texts: each ends after the last space of its
    second half, if it has one, and the next starts `overlap_` characters before its end."""
    half = size // 2
    end = f"least(a.at + {size}, length({body}))"
    back = f"locate(' ', reverse(substr({body}, a.at + {half} + 1, {size - half})))"
    cut = f"if({end} = length({body}) or {back} = 0, {end}, a.at + {size} - {back} + 1)"
    step = f"if(a.at < 0, a, element_at(transform(array({cut}), e -> struct(if(e >= length({body}), -1, greatest(e - {overlap_}, a.at + 1)) as at, array_append(a.out, struct(a.at as start, e as end)) as out)), 1))"
    zero = "struct(0 as at, cast(array() as array<struct<start:int,end:int>>) as out)"
    return F.expr(f"if(length({body}) > 0, aggregate(sequence(0, cast(length({body}) / {half - overlap_} as int)), {zero}, (a, i) -> {step}, a -> a.out), cast(array() as array<struct<start:int,end:int>>))")


def text_map(runs: DataFrame) -> DataFrame:
    """(doc_id, page, pos, ch, x0, y0, x1, y1) of runs (doc_id, page, block, line, seq, x0, y0, x1, y1, content): a space
    goes between runs of a line that stand apart, a line feed after each line; such characters have no box. A run's
    characters share its box evenly. Runs without content are left out."""
    place = ["page", "block", "line", "seq"]
    key = F.struct(*place[:3])
    at = runs.where(F.length("content") > 0).withColumn("_line", key)
    row = Window.partitionBy("doc_id", "_line").orderBy("seq")
    gap = F.coalesce((F.col("x0") - F.lag("x1").over(row) > SPACE_GAP) & ~F.lag("content").over(row).rlike(r"\s$"), F.lit(False))
    last = F.lead("seq").over(row).isNull()
    at = at.withColumn("_before", gap.cast("int")).withColumn("_after", last.cast("int"))
    order = Window.partitionBy("doc_id").orderBy(*place)
    end = F.sum(F.length("content") + F.col("_before") + F.col("_after")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    at = at.withColumn("_start", (end - F.length("content") - F.col("_before") - F.col("_after")).cast("int"))
    whole = F.concat(F.repeat(F.lit(" "), F.col("_before")), F.col("content"), F.repeat(F.lit("\n"), F.col("_after")))
    chars = at.select("doc_id", "page", "_start", "_before", "x0", "y0", "x1", "y1", F.length("content").alias("_n"), F.posexplode(F.split(whole, "")).alias("_i", "ch"))
    i = F.col("_i") - F.col("_before")
    boxed = (i >= 0) & (i < F.col("_n"))
    step = (F.col("x1") - F.col("x0")) / F.col("_n")
    box = {"x0": F.col("x0") + i * step, "y0": F.col("y0"), "x1": F.col("x0") + (i + 1) * step, "y1": F.col("y1")}
    return chars.select("doc_id", "page", (F.col("_start") + F.col("_i")).alias("pos"), "ch", *(F.when(boxed, c).alias(n) for n, c in box.items()))
