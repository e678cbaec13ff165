"""What a reviewer sees and does: flags of spans, groups and classes, pages, stages, and marks made by hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkveil.functions import text
from sparkveil.operators import policy


def is_fragment(body: Column, start: Column, end: Column) -> Column:
    """Whether a span starts or ends within a word."""
    word = lambda c: c.rlike(r"(?U)^[\p{L}\p{N}]$")
    at = lambda i: F.substring(body, i + 1, F.lit(1))
    split = lambda i: (i > 0) & (i < F.length(body)) & word(at(i - 1)) & word(at(i))
    return split(start) | split(end)


def is_shown(removed: Column, fragment: Column, origin: Column, active: Column) -> Column:
    """Spans to be removed are shown; of the others no fragments, but manual ones and those switched off."""
    return F.when(removed, True).when(fragment, False).otherwise((origin == "usuario") | F.coalesce(~active, F.lit(False)))


def destination(removed: Column, operator: Column, fits: Column) -> Column:
    """What becomes of a span: kept, a token, or a bar, for want of room or by its operator."""
    return F.when(~removed, "kept").when((operator == "pseudonimo") & fits, "token").when(operator == "pseudonimo", "bar_no_room").otherwise("bar")


def can_download(approved: Column, has_file: Column, ok: Column) -> Column:
    return F.coalesce(approved & has_file & ok, F.lit(False))


def stage(any_active: Column, preview_ok: Column, exported: Column) -> Column:
    return F.when(exported, "exported").when(F.coalesce(preview_ok, F.lit(False)), "verified").when(any_active, "reviewing").otherwise("empty")


def class_rows(spans: DataFrame) -> DataFrame:
    """(doc_id, entity, total, on, state): how many spans of a class are to be removed: all, some or none."""
    at = spans.groupBy("doc_id", "entity").agg(F.count("*").alias("total"), F.count_if("removed").alias("on"))
    return at.withColumn("state", F.when(F.col("on") == 0, "none").when(F.col("on") == F.col("total"), "all").otherwise("some"))


def value_rows(spans: DataFrame) -> DataFrame:
    """(doc_id, entity, value, n, pages, any_invalid, any_on, first): spans of equal values, but for white space."""
    at = spans.withColumn("value", text.collapsed(F.col("value")))
    return at.groupBy("doc_id", "entity", "value").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("page")).alias("pages"), F.max(F.col("note") == "checksum_invalido").alias("any_invalid"), F.max("removed").alias("any_on"), F.min("start").alias("first"))


def page_counts(spans: DataFrame, pages: str = "pages") -> DataFrame:
    """(doc_id, page, n): active spans on each page, each once a page it touches."""
    return spans.where("removed").select("doc_id", F.explode(F.array_distinct(pages)).alias("page")).groupBy("doc_id", "page").agg(F.count("*").alias("n"))


def reading_order(spans: DataFrame) -> DataFrame:
    """Add `place` by page, top and left edge; spans without a box come last, by offset."""
    order = Window.partitionBy("doc_id").orderBy(F.col("page").asc_nulls_last(), F.col("y0").asc_nulls_last(), F.col("x0").asc_nulls_last(), "start")
    return spans.withColumn("place", F.row_number().over(order))


def neighbours(spans: DataFrame, key: str = "span_id", order: str = "start") -> DataFrame:
    """Add next_id and previous_id in order, around the ends."""
    w = Window.partitionBy("doc_id").orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return spans.withColumn("next_id", F.coalesce(F.lead(key).over(w), F.first(key).over(whole))).withColumn("previous_id", F.coalesce(F.lag(key).over(w), F.last(key).over(whole)))


def mark_term(docs: DataFrame, term: str, *, column: str = "text", spans: str = "spans", regions: str | None = None) -> DataFrame:
    """(doc_id, start, end, value): places of a term of two characters or more, whatever its white space, that no active
    span overlaps. `spans` is an array of the active ones; of `regions`, an array of the stretches of text that can be
    seen on a page, a place must meet one."""
    term = term.strip()
    if len(term) < 2:
        raise ValueError("a term has two characters at least")
    at = docs.withColumn("_hits", text.matches(f"`{column}`", text.literal_pattern(term)))
    free = F.filter("_hits", lambda h: ~F.exists(spans, lambda s: (s["start"] < h["end"]) & (h["start"] < s["end"])))
    if regions:
        free = F.filter(free, lambda h: F.exists(regions, lambda r: (r["start"] < h["end"]) & (h["start"] < r["end"])))
    return at.select("doc_id", F.inline(free))


def preview_term(docs: DataFrame, term: str, *, column: str = "text", spans: str = "spans", regions: str = "regions", pages: str = "pages") -> DataFrame:
    """(doc_id, new, covered, without_region, on_pages, in_text, left_over): what marking a term would do. `regions` are
    (start, end, page) of what can be seen, `pages` the texts of the pages, in which a verification would look for the
    term in all its forms; left_over are finds of it that marking does not reach."""
    from sparkveil.operators import verify

    term = term.strip()
    if len(term) < 2:
        raise ValueError("a term has two characters at least")
    meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    at = docs.withColumn("_hits", text.matches(f"`{column}`", text.literal_pattern(term)))
    at = at.withColumn("_free", F.filter("_hits", lambda h: ~F.exists(spans, lambda s: meets(s, h))))
    at = at.withColumn("_seen", F.filter("_free", lambda h: F.exists(regions, lambda r: meets(r, h))))
    on_pages = F.array_sort(F.array_distinct(F.transform(F.filter(regions, lambda r: F.exists("_seen", lambda h: meets(r, h))), lambda r: r["page"])))
    in_text = F.aggregate(F.transform(pages, lambda p: verify.occurrences(F.lit(term), p)), F.lit(0).cast("bigint"), lambda a, n: a + n)
    size = lambda c: F.size(c).cast("bigint")
    out = at.select("doc_id", size("_seen").alias("new"), (size("_hits") - size("_free")).alias("covered"), (size("_free") - size("_seen")).alias("without_region"), on_pages.alias("on_pages"), in_text.alias("in_text"))
    return out.withColumn("left_over", F.col("in_text") - F.col("new") - F.col("covered"))


def repaired(body: Column, start: Column, end: Column, claimed: Column, reach: int = 500) -> Column:
    """struct(start, end) of a selection that claims a text: as given if the text is there, else its first place within
    reach, without white space at its edges; null if there is none. White space counts as equal, of any kind and length."""
    squeeze = lambda c: text.collapsed(c)
    wanted = squeeze(claimed)
    here = F.substring(body, start + 1, end - start)
    low = F.greatest(start - reach, F.lit(0))
    window = F.substring(body, low + 1, F.least(end + reach, F.length(body)) - low)
    quoted = F.concat(F.lit(r"(?U)\Q"), F.replace(wanted, F.lit(" "), F.lit(r"\E\s+\Q")), F.lit(r"\E"))
    # The first match is the leftmost place of its own text.
    found = F.coalesce(F.regexp_substr(window, quoted), F.lit(""))
    there = F.length(found) > 0
    left = F.length(here) - F.length(F.regexp_replace(here, r"(?U)^\s+", ""))
    right = F.length(here) - F.length(F.regexp_replace(here, r"(?U)\s+$", ""))
    at = low + F.position(found, window) - 1
    own = F.struct((start + left).cast("int").alias("start"), (end - right).cast("int").alias("end"))
    other = F.struct(at.cast("int").alias("start"), (at + F.length(found)).cast("int").alias("end"))
    return F.when(wanted == "", F.lit(None)).when(squeeze(here) == wanted, own).when(there, other)


def added_interval(body: Column, start: Column, end: Column, claimed: Column, spans: Column) -> Column:
    """struct(start, end, problem) of a stretch marked by hand: its repaired bounds, or why it is refused: `bounds`
    beyond the text, `text` not found, `overlap` with one of the active spans."""
    at = repaired(body, start, end, claimed)
    taken = lambda r: F.exists(spans, lambda s: (s["start"] < r["end"]) & (r["start"] < s["end"]))
    problem = lambda r: F.when((start < 0) | (end <= start) | (end > F.length(body)), "bounds").when(r.isNull(), "text").when(taken(r), "overlap")
    return text.bind(at, lambda r: F.struct(F.when(problem(r).isNull(), r["start"]).alias("start"), F.when(problem(r).isNull(), r["end"]).alias("end"), problem(r).alias("problem")))


def numbered(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs with `name`: documento-01 and so on by key, which says nothing of a document. For the few of a report."""
    return docs.withColumn("name", F.format_string("documento-%02d", F.row_number().over(Window.orderBy(key))))


def with_ids(spans: DataFrame, order: str = "start") -> DataFrame:
    """spans with `id`: s1, s2 and so on in a document, by position."""
    return spans.withColumn("id", F.concat(F.lit("s"), F.row_number().over(Window.partitionBy("doc_id").orderBy(order)).cast("string")))


def authors(spans: DataFrame) -> DataFrame:
    """(doc_id, author): the first person of each document."""
    return spans.where("entity = 'PERSON'").groupBy("doc_id").agg(F.min_by("value", "start").alias("author"))


def br_date(day: Column) -> Column:
    return F.date_format(day, "dd/MM/yyyy")


def token_plan(spans: DataFrame) -> DataFrame:
    """spans (doc_id, start, end, entity, score, token, width, height) that are to get a token: (doc_id, tokens, lost,
    without_room): those that get theirs, those that lose to an overlapping span, and those whose box has no room."""
    from sparkveil.operators import layout, resolve

    arrays = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "entity", "score", F.lit(None).cast("string").alias("note"))).alias("_spans"))
    kept = resolve.resolve(arrays, spans="_spans").select("doc_id", F.size("_spans").cast("bigint").alias("_kept"), F.inline("_spans")).select("doc_id", "_kept", "start", "end", "entity")
    at = spans.join(kept, ["doc_id", "start", "end", "entity"], "left").withColumn("_fits", layout.token_fits(F.col("token"), F.col("width"), F.col("height")))
    won = F.col("_kept").isNotNull()
    return at.groupBy("doc_id").agg(F.count_if(won & F.col("_fits")).alias("tokens"), F.count_if(~won).alias("lost"), F.count_if(won & ~F.col("_fits")).alias("without_room"))


def document_facts(pages: DataFrame) -> DataFrame:
    """(doc_id, pages, links, empty_pages, bookmarks, attachments, signed) from a table of pages."""
    return pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum("links").alias("links"), F.count_if(F.length(F.trim(F.coalesce("text", F.lit("")))) == 0).alias("empty_pages"), F.max("bookmarks").alias("bookmarks"), F.max("attachments").alias("attachments"), F.max("signed").alias("signed"))


def wanted_tokens_without_room(spans: DataFrame) -> DataFrame:
    """(entity, n) of removed spans that were to get a token and have no room for it."""
    return spans.where("removed AND operator = 'pseudonimo' AND NOT fits").groupBy("entity").agg(F.count("*").alias("n"))


def span_view(spans: DataFrame, boxes: DataFrame | None = None, tokens: DataFrame | None = None) -> DataFrame:
    """Spans as shown: score to three places, whether removed, and the operator in force; with boxes (doc_id, start,
    end, page, x0, y0, x1, y1) their `rects`, with tokens (doc_id, start, end, token) their `token`."""
    removed = policy.will_be_removed(F.col("active"), F.col("operator"))
    at = spans.withColumn("score", F.round("score", 3)).withColumn("removed", removed)
    keys = ["doc_id", "start", "end"]
    if boxes is not None:
        rects = boxes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("page", "y0", "x0", "x1", "y1"))).alias("rects"))
        at = at.join(rects, keys, "left")
    return at.join(tokens.select(*keys, "token"), keys, "left") if tokens is not None else at


def file_size(size: Column) -> Column:
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1024 * 1024, F.concat(F.format_number(size / 1024, 0), F.lit(" KB"))).otherwise(F.concat(F.format_number(size / 1048576, 1), F.lit(" MB")))


def reais(amount: Column) -> Column:
    """An amount as R$ with points between thousands and a decimal comma."""
    return F.concat(F.lit("R$ "), F.translate(F.format_number(amount, 2), ",.", ".,"))


def fits_cp1252(value: Column) -> Column:
    """Whether every character has a place in Windows' Western code page."""
    # The code page's characters beyond Latin-1.
    return value.rlike(r"^[\x00-\x7F\xA0-\xFF€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]*$")
