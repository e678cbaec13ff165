"""Competing spans of one document: telling shapes apart, choosing disjoint spans, fragments, and rows of spans.

Span arrays are handled within their row; long tables of spans use windows within a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkveil.functions import dims, text

_SPAN = "struct<start:int,end:int,entity:string,score:double,note:string>"


def overlap(a: Column, b: Column) -> Column:
    """Half-open intervals that share a position; touching ones do not."""
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


_TOLD = "map(" + ", ".join(f"'{n}', array({', '.join(repr(t) for t in terms)})" for n, terms in dims.TELLING.items()) + ")"
_SHAPES = ", ".join(f"'{n}'" for n in dims.TELLING)


def window_sql(column: str, start: str) -> str:
    """The folded characters before a place that may hold an anchor."""
    return text.folded_sql(f"substr({column}, greatest({start} - {dims.LOOK_BACK}, 0) + 1, least({start}, {dims.LOOK_BACK}))")


def told_sql(entity: str, window: str) -> str:
    """Whether the window holds a word that tells the entity from others of its shape."""
    return f"exists(coalesce(element_at({_TOLD}, {entity}), array()), t -> contains({window}, t))"


def without_rivals_sql(spans: str) -> str:
    """Spans (with `told`) but those of an ambiguous shape, not told, whose range has exactly one that is."""
    rivals = f"filter({spans}, y -> y.entity in ({_SHAPES}) and y.start = x.start and y.end = x.end and y.told)"
    return f"filter({spans}, x -> not (x.entity in ({_SHAPES}) and not x.told and size({rivals}) = 1))"


def clusters_sql(spans: str, element: str) -> str:
    """An array of spans as an array of arrays that share no position with each other, in order of position. What is
    quadratic is so within these alone."""
    zero = f"struct(-1 as reach, cast(array() as array<{element}>) as now, cast(array() as array<array<{element}>>) as done)"
    grown = "struct(greatest(a.reach, s.end) as reach, array_append(a.now, s) as now, a.done as done)"
    fresh = "struct(s.end as reach, array(s) as now, array_append(a.done, a.now) as done)"
    return f"filter(aggregate(array_sort({spans}), {zero}, (a, s) -> if(s.start < a.reach, {grown}, {fresh}), a -> array_append(a.done, a.now)), c -> size(c) > 0)"


def disambiguate(df: DataFrame, *, column: str = "text", spans: str = "spans") -> DataFrame:
    """Among spans of the same range with the shapes CPF, PIS and CNH, keep the one whose anchor, alone of theirs,
    stands in the look-back; otherwise leave them all."""
    seen = f"transform({spans}, s -> struct(s.start as start, s.end as end, s.entity as entity, s.score as score, s.note as note, {told_sql('s.entity', window_sql(column, 's.start'))} as told))"
    plain = "struct(x.start as start, x.end as end, x.entity as entity, x.score as score, x.note as note)"
    kept = f"transform({clusters_sql(seen, _SPAN[:-1] + ',told:boolean>')}, c -> transform({without_rivals_sql('c')}, x -> {plain}))"
    return text.with_bound(df, {spans: F.expr(f"flatten({kept})")})


_WEIGHTS = "map(" + ", ".join(f"'{n}', {w}" for n, w in dims.WEIGHT.items()) + ")"


def greedy_sql(spans: str) -> str:
    """A greedy choice of disjoint spans: higher precedence, longer, higher score, earlier; in order of position."""
    ranked = f"array_sort(transform({spans}, s -> struct(-coalesce(element_at({_WEIGHTS}, s.entity), 0) as a, s.start - s.end as b, -s.score as c, s.start as start, s.end as end, s.entity as entity, s.score as score, s.note as note)))"
    plain = "struct(s.start as start, s.end as end, s.entity as entity, s.score as score, s.note as note)"
    chosen = f"aggregate(transform({ranked}, s -> {plain}), cast(array() as array<{_SPAN}>), (a, s) -> if(exists(a, o -> o.start < s.end and s.start < o.end), a, array_append(a, s)))"
    return f"array_sort({chosen})"


def resolve(df: DataFrame, *, spans: str = "spans") -> DataFrame:
    """A greedy choice of disjoint spans, in order of position. Spans are swept once into clusters that share no
    position; the choice within one looks at each accepted span of it."""
    plain = f"transform({spans}, s -> struct(cast(s.start as int) as start, cast(s.end as int) as end, s.entity as entity, s.score as score, s.note as note))"
    return text.with_bound(df, {spans: F.expr(f"flatten(transform({clusters_sql(plain, _SPAN)}, c -> {greedy_sql('c')}))")})


def only(df: DataFrame, entities: tuple[str, ...] = dims.REDACTED, *, spans: str = "spans") -> DataFrame:
    """Spans of some entities, those redacted by default."""
    return df.withColumn(spans, F.filter(F.col(spans), lambda s: s["entity"].isin(*entities)))


def merge_fragments(spans: DataFrame) -> DataFrame:
    """(doc_id, entity, start, end, score): adjacent fragments of one entity as one span with the highest score;
    fragments with a gap between stay apart."""
    order = Window.partitionBy("doc_id").orderBy("start", "end", "entity")
    fresh = ~((F.lag("entity").over(order) == F.col("entity")) & (F.lag("end").over(order) == F.col("start")))
    islands = spans.withColumn("_new", F.coalesce(fresh, F.lit(True)).cast("int")).withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("doc_id", "_island").agg(F.first("entity").alias("entity"), F.min("start").alias("start"), F.max("end").alias("end"), F.max("score").alias("score")).drop("_island")


def absorb_contained(spans: DataFrame) -> DataFrame:
    """(doc_id, entity, start, end, score): spans inside an earlier, wider one of their entity go into it, which
    takes the highest score."""
    order = Window.partitionBy("doc_id", "entity").orderBy("start", F.desc("end"), F.desc("score"))
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    at = spans.withColumn("_new", F.coalesce(F.col("end") > reach, F.lit(True)).cast("int")).withColumn("_group", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return at.groupBy("doc_id", "entity", "_group").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("score").alias("score")).drop("_group")


def split_lines(df: DataFrame, *, column: str = "text") -> DataFrame:
    """Spans (doc_id, text, start, end, entity, score) cut at line ends, one row a line, empty lines dropped."""
    parts = text.matches(f"substring({column}, start + 1, end - start)", r"[^\n]+")
    at = df.withColumn("_part", F.explode(parts))
    return at.select(*(c for c in df.columns if c not in ("start", "end")), (F.col("start") + F.col("_part.start")).alias("start"), (F.col("start") + F.col("_part.end")).alias("end")).where(F.length(F.trim(F.expr(f"substring({column}, start + 1, end - start)"))) > 0)


def trim_junk(df: DataFrame, *, column: str = "text") -> DataFrame:
    """Spans without white space and punctuation at their edges; what is empty then is dropped."""
    value = F.expr(f"substring({column}, start + 1, end - start)")
    start, end = text.trim_edges(F.col("start"), F.col("end"), value)
    return df.withColumns({"start": start, "end": end}).where("end > start")


# Entities that the tags of models stand for; others are no personal data and go.
LABELS = {"PESSOA": "PERSON", "PER": "PERSON", "ORGANIZACAO": "ORGANIZATION", "ORG": "ORGANIZATION", "LOCAL": "LOCATION", "LOC": "LOCATION", "TEMPO": "DATE_TIME"}


def map_labels(spans: DataFrame, labels: dict[str, str] = LABELS, wanted: tuple[str, ...] | None = None) -> DataFrame:
    """Spans (entity, ...) of a model with its tags as entities; tags without one, and entities not wanted, go."""
    table = F.create_map(*(F.lit(v) for pair in labels.items() for v in pair))
    at = spans.withColumn("entity", F.element_at(table, F.col("entity"))).where("entity IS NOT NULL")
    return at.where(F.col("entity").isin(*wanted)) if wanted is not None else at


def model_spans(tagged: DataFrame, *, column: str = "text", least: float = 0.5) -> DataFrame:
    """What a model found, rows (doc_id, text, start, end, entity, score), as spans: labels mapped, weak ones dropped,
    fragments joined, line ends cut, edges trimmed, those within others absorbed."""
    known = map_labels(tagged.where(F.col("score") >= least))
    whole = merge_fragments(known.select("doc_id", "entity", "start", "end", "score")).join(tagged.select("doc_id", column).distinct(), "doc_id")
    return absorb_contained(trim_junk(split_lines(whole, column=column), column=column).select("doc_id", "entity", "start", "end", "score"))
