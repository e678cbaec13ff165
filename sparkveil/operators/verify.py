"""Whether values that were to go are still there, in any of their written forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkveil.functions.text import stripped, with_bound

#: Fixed value: shorter forms are not looked for.
LEAST = 5
DIGITS = r"(?U)^\d+$"


def variants(value: Column) -> Column:
    """Forms a value may reappear in: as it is, with spaces collapsed, its digits, without spaces."""
    digits, solid = F.regexp_replace(value, r"(?U)\D", ""), F.regexp_replace(value, r"(?U)\s", "")
    forms = F.array_distinct(F.array(value, F.regexp_replace(value, r"(?U)\s+", " "), digits, solid))
    return F.filter(forms, lambda f: F.length(f) >= LEAST)


def by_words(surface: Column) -> Column:
    return F.regexp_replace(F.coalesce(surface, F.lit("")), r"(?U)\s+", " ")


def by_digits(surface: Column) -> Column:
    """Without the characters that stand inside identifiers, and only those: no identifiers are made up."""
    return F.regexp_replace(F.coalesce(surface, F.lit("")), r"(?U)[.\-/()\s]", "")


def is_number(value: Column) -> Column:
    """Whether a value has no letters but a check letter at its end: what identifiers are written in."""
    return value.rlike(r"(?U)^\P{L}*[Xx]?$")


def whole_number(form: Column) -> Column:
    """A pattern for digits in words, however separators divide them, that are no part of a longer number. Digits of a
    value with letters, such as those in the name of an e-mail, stand in longer numbers by chance."""
    divided = F.regexp_replace(form, r"(?U)(?<=\d)(?=\d)", "[-./() ]*")
    return F.concat(F.lit(r"(?U)(?<!\d[-./]?)"), divided, F.lit(r"(?![-./]?\d)"))


def found_as(value: Column, words: Column, digits: Column) -> Column:
    """The first form of a value that a surface holds, or null. Forms of digits alone are sought among digits; those of a
    value with letters must be a whole number."""
    alone = lambda f: F.contains(digits, f) & (is_number(value) | F.rlike(words, whole_number(f)))
    hits = F.filter(variants(value), lambda f: F.when(f.rlike(DIGITS), alone(f)).otherwise(F.contains(words, f)))
    return F.get(hits, F.lit(0))


def leaks(values: DataFrame, surfaces: DataFrame) -> DataFrame:
    """(doc_id, surface, object_id, value, detail): values (doc_id, value) found in surfaces (doc_id, surface,
    object_id, content). A document's values come to each of its surfaces as one array, so a surface is read once;
    short values are not sought."""
    needles = values.select("doc_id", stripped(F.col("value")).alias("value")).where(F.length("value") >= LEAST).groupBy("doc_id").agg(F.collect_set("value").alias("sought"))
    hay = surfaces.select("doc_id", "surface", "object_id", by_words(F.col("content")).alias("words"), by_digits(F.col("content")).alias("digits"))
    found = F.transform("sought", lambda v: F.struct(v.alias("value"), found_as(v, F.col("words"), F.col("digits")).alias("detail")))
    return hay.join(needles, "doc_id").select("doc_id", "surface", "object_id", F.inline(F.filter(found, lambda f: f["detail"].isNotNull())))


def leaked_values(text: Column, values: Column) -> Column:
    """Of an array of values, those a text still holds; within the row, without a join."""
    words, digits = by_words(text), by_digits(text)
    sought = F.filter(F.array_distinct(F.transform(values, stripped)), lambda v: F.length(v) >= LEAST)
    return F.filter(sought, lambda v: found_as(v, words, digits).isNotNull())


def missing_tokens(text: Column, tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~F.contains(text, t))


def verify_text(df: DataFrame, *, column: str = "rewritten", values: str = "values", tokens: str | None = None) -> DataFrame:
    """Add surfaces, n_values, leaks (values), lost_tokens and ok."""
    plain = F.array(F.lit("texto"))
    surfaces = plain if tokens is None else F.when(F.size(tokens) > 0, F.array(F.lit("texto"), F.lit("tokens-presentes"))).otherwise(plain)
    sought = F.filter(F.array_distinct(F.transform(F.col(values), stripped)), lambda v: F.length(v) >= LEAST)
    lost = missing_tokens(F.col(column), F.col(tokens)) if tokens else F.array().cast("array<string>")
    at = with_bound(df, {"surfaces": surfaces, "n_values": F.size(sought), "leaks": leaked_values(F.col(column), F.col(values)), "lost_tokens": lost})
    return at.withColumn("ok", (F.size("leaks") == 0) & (F.size("lost_tokens") == 0))


def hex_strings(content: Column) -> Column:
    """Strings written in hexadecimal between angle brackets, decoded; an odd length gets a zero at its end."""
    raw = F.transform(F.regexp_extract_all(content, F.lit(HEX), F.lit(1)), lambda h: F.regexp_replace(h, r"\s", ""))
    return F.transform(raw, lambda h: F.decode(F.unhex(F.when(F.length(h) % 2 == 1, F.concat(h, F.lit("0"))).otherwise(h)), "ISO-8859-1"))


def occurrences(value: Column, page: Column) -> Column:
    """Times a page holds a value: the most of its forms, each counted without overlap. The digits of a value with
    letters count where they are a whole number."""
    words, digits = by_words(page), by_digits(page)
    count = lambda f, h: ((F.length(h) - F.length(F.replace(h, f, F.lit("")))) / F.length(f)).cast("bigint")
    alone = lambda f: F.when(is_number(value), count(f, digits)).when(F.contains(digits, f), F.regexp_count(words, whole_number(f)).cast("bigint")).otherwise(F.lit(0))
    return F.coalesce(F.array_max(F.transform(variants(value), lambda f: F.when(f.rlike(DIGITS), alone(f)).otherwise(count(f, words)))), F.lit(0))


def dissect(found: DataFrame, visible: tuple[str, ...] = ("texto",)) -> DataFrame:
    """(doc_id, value, surfaces, n_surfaces, is_visible): leaks by value."""
    return found.groupBy("doc_id", "value").agg(F.array_sort(F.collect_set("surface")).alias("surfaces"), F.countDistinct("surface").alias("n_surfaces"), F.max(F.col("surface").isin(*visible)).alias("is_visible"))


# Fixed value: surfaces in the order in which they are searched.
SURFACES = ("texto", "anotacoes", "formularios", "anexos", "marcadores", "metadados", "xmp", "streams", "texto-pdfplumber", "bytes-brutos")
HEX = r"<([0-9A-Fa-f\s]{4,})>"


def described(subtype: Column, type_: Column, filter_: Column) -> Column:
    """What an object is by its keys, the most telling first, each name once."""
    names = F.array_distinct(F.array_compact(F.transform(F.array(subtype, type_, filter_), lambda n: F.ltrim(n, F.lit("/")))))
    return F.when(F.size(names) > 0, F.array_join(names, "/")).otherwise("objeto sem tipo declarado")


def without_hex(content: Column) -> Column:
    """The content with its hexadecimal strings decoded in their places."""
    parts = F.zip_with(F.split(content, HEX, -1), hex_strings(content), lambda p, h: F.concat(p, F.coalesce(h, F.lit(""))))
    return F.array_join(parts, "")


def raw_surface(content: Column) -> Column:
    """Bytes as text in three encodings, one after another: UTF-8, Latin-1, and two bytes a character, of which those
    of Latin-1 can be read."""
    latin = F.decode(content, "ISO-8859-1")
    return F.concat_ws("\n", F.make_valid_utf8(content.cast("string")), latin, F.replace(latin, F.lit("\0"), F.lit("")))


def stream_leaks(values: DataFrame, objects: DataFrame) -> DataFrame:
    """(doc_id, surface, object_id, value, detail): values in objects (doc_id, object_id, content, subtype, type,
    filter), as they are or with hexadecimal strings decoded; each value once an object, found as it is first."""
    both = F.array(F.struct(F.lit(0).alias("way"), F.col("content").alias("content")), F.struct(F.lit(1).alias("way"), without_hex(F.col("content")).alias("content")))
    hay = objects.select("doc_id", F.struct("object_id", described(F.col("subtype"), F.col("type"), F.col("filter")).alias("what")).alias("o"), F.inline(both))
    found = leaks(values, hay.select("doc_id", F.lit("streams").alias("surface"), F.struct("o", "way").alias("object_id"), "content"))
    first = found.groupBy("doc_id", "surface", F.col("object_id.o").alias("o"), "value").agg(F.min_by("detail", "object_id.way").alias("form"))
    return first.select("doc_id", "surface", "o.object_id", "value", F.format_string("%s, em %s (xref %s)", F.col("form"), F.col("o.what"), F.col("o.object_id").cast("string")).alias("detail"))


def dissected(found: DataFrame, pages: DataFrame) -> DataFrame:
    """found (doc_id, surface, value, detail), pages (doc_id, page, content) of the output: a row a value with its
    surfaces in the order searched, the first of them, occurrences in the text, their pages, whether it can be read
    there at all, the object that holds it if a stream does, and its place: what can be read first, then by value."""
    order = F.array(*map(F.lit, SURFACES))
    place = F.when(F.array_contains(order, F.col("surface")), F.array_position(order, F.col("surface"))).otherwise(len(SURFACES) + 1)
    by = found.groupBy("doc_id", "value").agg(F.array_sort(F.collect_set(F.struct(place.alias("p"), "surface"))).alias("s"), F.min(F.when(F.col("surface") == "streams", F.regexp_extract("detail", r"em (.*)$", 1))).alias("object"))
    read = by.select("doc_id", "value").join(pages, "doc_id").withColumn("n", occurrences(F.col("value"), F.col("content"))).where("n > 0")
    read = read.groupBy("doc_id", "value").agg(F.sum("n").alias("occurrences"), F.array_sort(F.collect_set("page")).alias("pages"))
    at = by.join(read, ["doc_id", "value"], "left").select("doc_id", "value", F.transform("s", lambda x: x["surface"]).alias("surfaces"), F.coalesce("occurrences", F.lit(0)).alias("occurrences"), F.coalesce("pages", F.array().cast(dict(read.dtypes)["pages"])).alias("pages"), F.coalesce("object", F.lit("")).alias("object"))
    at = at.withColumn("first_surface", F.get("surfaces", F.lit(0))).withColumn("is_visible", F.col("occurrences") > 0)
    return at.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(~F.col("is_visible"), "value")))


def pending(rows: DataFrame, edits: DataFrame, legible: bool = False) -> DataFrame:
    """Rows (doc_id, version, ...) of dissected leaks that speak of the current version; with `legible` those that can
    be read in the text."""
    from sparkveil.operators import session

    now = session.valid_results(rows, edits)
    return now.where("is_visible") if legible else now


def preverified(proposed: DataFrame, cache: DataFrame) -> DataFrame:
    """(doc_id, version, ok, n_leaks, from_cache): what a verification of each proposed output (doc_id, version,
    rewritten, values, tokens) says. A result in cache (doc_id, version, ok, n_leaks) for the very version is taken as
    it is; no file comes of it."""
    known = proposed.select("doc_id", "version").join(cache, ["doc_id", "version"]).withColumn("from_cache", F.lit(True))
    fresh = verify_text(proposed.join(cache.select("doc_id", "version"), ["doc_id", "version"], "left_anti"), tokens="tokens")
    made = fresh.select("doc_id", "version", "ok", F.size("leaks").cast("bigint").alias("n_leaks"), F.lit(False).alias("from_cache"))
    return known.select("doc_id", "version", "ok", F.col("n_leaks").cast("bigint").alias("n_leaks"), "from_cache").unionByName(made)
