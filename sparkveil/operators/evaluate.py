"""Detections against gold spans: strict, relaxed, character coverage, leak classes, summaries.

gold and pred are (doc_id, label, start, end); pred may have more columns. Documents are the unit of distribution:
every step groups or joins on doc_id, and labels are pre-aggregated before they are brought together.
"""

from __future__ import annotations

import difflib
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkveil.functions import text
from sparkveil.operators import resolve


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0)).cast("double")


def strict(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(label, tp, fp, fn) over distinct (doc_id, label, start, end)."""
    keys = ["doc_id", "label", "start", "end"]
    both = gold.select(*keys).distinct().withColumn("g", F.lit(1)).join(pred.select(*keys).distinct().withColumn("p", F.lit(1)), keys, "full")
    return both.groupBy("label").agg(F.count_if(F.expr("g = 1 and p = 1")).alias("tp"), F.count_if(F.expr("g is null")).alias("fp"), F.count_if(F.expr("p is null")).alias("fn"))


def relaxed(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(label, tp, fp, fn): each gold span takes the first unused prediction of its label that overlaps it, in order
    of position. Spans of a document and label are swept into clusters that share no position, and matched within."""
    side = lambda df, n: df.groupBy("doc_id", "label").agg(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.lit(n).alias("side"))).alias(f"s{n}"))
    element = "struct<start:int,end:int,side:int>"
    both = side(gold, 0).join(side(pred, 1), ["doc_id", "label"], "full").select("label", *(F.coalesce(F.col(c).cast(f"array<{element}>"), F.array().cast(f"array<{element}>")).alias(c) for c in ("s0", "s1")))
    free = "filter(sequence(0, size(c) - 1), i -> c[i].side = 1 and c[i].start < g.end and g.start < c[i].end and not array_contains(a.used, i))"
    taken = f"element_at(transform(array({free}), f -> if(size(f) > 0, struct(a.tp + 1 as tp, array_append(a.used, f[0]) as used), a)), 1)"
    matched = f"aggregate(filter(c, x -> x.side = 0), struct(0L as tp, cast(array() as array<int>) as used), (a, g) -> {taken}, a -> a.tp)"
    clusters = resolve.clusters_sql("concat(s0, s1)", element)
    counted = both.withColumn("tp", F.expr(f"aggregate(transform({clusters}, c -> {matched}), 0L, (t, n) -> t + n)"))
    return counted.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum(F.size("s1") - F.col("tp")).alias("fp"), F.sum(F.size("s0") - F.col("tp")).alias("fn"))


def scores(counts: DataFrame) -> DataFrame:
    """Add precision, recall, f1 and support; 0 where nothing is to be divided."""
    at = counts.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return at.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).withColumn("support", F.col("tp") + F.col("fn"))


def macro_f1(scored: DataFrame) -> DataFrame:
    return scored.where("support > 0").agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"))


def coverage_by_span(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """gold with `length`, `covered` (characters any prediction of the document covers) and `labels` (sorted distinct
    labels that touch it). A document's spans are swept once into clusters that share no position; a gold span looks at
    the predictions of its cluster."""
    others = [c for c in gold.columns if c != "doc_id"]
    golds = gold.groupBy("doc_id").agg(F.collect_list(F.struct(*others)).alias("_g"))
    ranges = pred.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("label").cast("string").alias("label"), F.lit(-1).alias("i"))).alias("_p"))
    element = "struct<start:int,end:int,label:string,i:int>"
    at = golds.join(ranges, "doc_id", "left").withColumn("_p", F.coalesce(F.col("_p").cast(f"array<{element}>"), F.array().cast(f"array<{element}>")))
    own = "transform(_g, (g, i) -> struct(cast(g.start as int) as start, cast(g.end as int) as end, cast(null as string) as label, i as i))"
    part = "struct(greatest(a.reach, least(r.end, g.end)) as reach, a.n + greatest(least(r.end, g.end) - greatest(r.start, a.reach), 0) as n)"
    covered = f"aggregate(filter(c, r -> r.i < 0), struct(g.start as reach, 0 as n), (a, r) -> {part}, a -> a.n)"
    labels = "array_sort(array_distinct(transform(filter(c, r -> r.i < 0 and r.start < g.end and g.start < r.end), r -> r.label)))"
    judged = f"transform({resolve.clusters_sql(f'concat({own}, _p)', element)}, c -> transform(filter(c, g -> g.i >= 0), g -> struct(g.i as i, {covered} as covered, {labels} as labels)))"
    rows = at.select("doc_id", "_g", F.inline(F.expr(f"flatten({judged})")))
    out = rows.select("doc_id", F.get("_g", F.col("i")).alias("_row"), "covered", "labels").select("doc_id", "_row.*", "covered", "labels")
    return out.withColumn("length", F.col("end") - F.col("start"))


def coverage(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(chars_gold, chars_covered, coverage), whatever the labels; overlapping gold counts twice."""
    at = coverage_by_span(gold, pred).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("chars_gold"), F.coalesce(F.sum("covered"), F.lit(0)).alias("chars_covered"))
    return at.withColumn("coverage", ratio(F.col("chars_covered"), F.col("chars_gold")))


def leak_classes(gold: DataFrame, pred: DataFrame, redacted: DataFrame, label: str = "PERSON") -> DataFrame:
    """Gold spans of a label with their `class`: by the characters that redacted spans cover, then by labels."""
    own = gold.where(F.col("label") == label)
    by = coverage_by_span(own, redacted).select("doc_id", "label", "start", "end", "length", "covered")
    touched = coverage_by_span(own, pred).select("doc_id", "start", "end", "labels")
    whole = by.join(touched, ["doc_id", "start", "end"])
    kind = F.when(F.col("covered") >= F.col("length"), "covered").when(F.col("covered") > 0, "partial").when(F.size("labels") > 0, "wrong_label").otherwise("not_found")
    return whole.withColumn("class", kind)


def label_histogram(classes: DataFrame) -> DataFrame:
    """(labels, n, share) of label combinations that touch gold spans, '-' for none."""
    at = classes.groupBy(F.when(F.size("labels") > 0, F.array_join("labels", "+")).otherwise("-").alias("labels")).agg(F.count("*").alias("n"))
    total = at.agg(F.sum("n").alias("total"))
    return at.crossJoin(F.broadcast(total)).select("labels", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def usability(register: DataFrame) -> DataFrame:
    """One row: sessions, participants, hits, rate, median seconds of hits, false alarms. Rows without a participant
    do not count; a comma may be the decimal point; what is no number is left out."""
    rows = register.where(F.trim(F.coalesce("participante", F.lit(""))) != "")
    hit = F.lower(F.trim("achou")).isin("sim", "s", "1", "true", "x")
    number = lambda c: F.expr(f"try_cast(replace(trim({c}), ',', '.') as double)")
    at = rows.select("participante", "documento", F.coalesce(hit, F.lit(False)).alias("hit"), number("segundos").alias("seconds"), number("falsos_alarmes").alias("alarms"))
    return at.agg(F.count("*").alias("sessions"), F.countDistinct("participante").alias("participants"), F.count_if("hit").alias("hits"), ratio(F.count_if("hit"), F.count("*")).alias("rate"), F.median(F.when(F.col("hit"), F.col("seconds"))).alias("median_seconds"), F.coalesce(F.sum("alarms"), F.lit(0.0)).alias("false_alarms"))


def align(docs: DataFrame, gold: DataFrame) -> DataFrame:
    """(doc_id, label, value, start, end, defect): gold offsets of a source text carried over to an extracted one.

    docs has (doc_id, source_text, text). Where the longest matching blocks put a value it is tried first, then the
    200 characters around, then the whole text; what is nowhere is a defect. One document is one group. Lines are
    matched first, which takes time in proportion to their number in a text that was hardly changed; characters are
    matched only within stretches of lines that differ.
    """

    def matching(source: str, target: str) -> Iterator[tuple[int, int, int]]:
        a, b = source.splitlines(keepends=True), target.splitlines(keepends=True)
        at_a, at_b = [0], [0]
        for line in a:
            at_a.append(at_a[-1] + len(line))
        for line in b:
            at_b.append(at_b[-1] + len(line))
        for tag, i, j, x, y in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
            if tag == "equal":
                yield at_a[i], at_b[x], at_a[j] - at_a[i]
            elif tag == "replace":
                for block in difflib.SequenceMatcher(None, source[at_a[i] : at_a[j]], target[at_b[x] : at_b[y]], autojunk=False).get_matching_blocks():
                    yield at_a[i] + block.a, at_b[x] + block.b, block.size

    def place(key, docs_pdf, gold_pdf):
        import pandas as pd

        rows = []
        if len(docs_pdf):
            source, target = docs_pdf["source_text"].iloc[0] or "", docs_pdf["text"].iloc[0] or ""
            blocks = list(matching(source, target))
            taken = set()
            for g in gold_pdf.sort_values(["start", "end"]).itertuples():
                guess = next((b + g.start - a for a, b, size in blocks if a <= g.start < a + size), None)
                at = guess if guess is not None and target[guess : guess + len(g.value)] == g.value and guess not in taken else -1
                if at < 0 and guess is not None:
                    at = next((i for i in range(max(0, guess - 200), guess + 201) if target.startswith(g.value, i) and i not in taken), -1)
                if at < 0:
                    at = target.find(g.value)
                    while at >= 0 and at in taken:
                        at = target.find(g.value, at + 1)
                if at >= 0:
                    taken.add(at)
                rows.append((g.doc_id, g.label, g.value, at if at >= 0 else None, at + len(g.value) if at >= 0 else None, at < 0))
        out = pd.DataFrame(rows, columns=["doc_id", "label", "value", "start", "end", "defect"])
        return out.astype({"start": "Int64", "end": "Int64"})

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, label string, value string, start bigint, end bigint, defect boolean"
    return docs.groupBy("doc_id").cogroup(gold.groupBy("doc_id")).applyInPandas(place, schema)


def defect_rate(aligned: DataFrame) -> DataFrame:
    return aligned.agg(F.count_if("defect").alias("defects"), F.count("*").alias("gold"), ratio(F.count_if("defect"), F.count("*")).alias("rate"))


def fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Add `fingerprint`: SHA-256 of the columns as JSON in the order of their names."""
    return rows.withColumn("fingerprint", F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256))


def search(rows: DataFrame, column: str, query: str) -> DataFrame:
    """Rows whose column contains a query, whatever the case and accents."""
    return rows.where(F.contains(text.folded(F.col(column)), text.folded(F.lit(query))))


# The targets of strict F1 for structured identifiers and of relaxed F1 for people, and forms of address.
STRICT_TARGET, PERSON_TARGET = 0.95, 0.80
TITLES = ("sr", "sra", "dr", "dra", "srta", "exmo", "exma")


def gate(value: Column, target: float) -> Column:
    """A value with a mark for whether it reaches its target."""
    return F.format_string("%.3f %s (alvo %.2f)", value.cast("double"), F.when(value >= target, "✅").otherwise("❌"), F.lit(float(target)))


def throughput(runs: DataFrame, by: str = "config") -> DataFrame:
    """runs (config, doc_id, seconds, pages): (config, seconds_per_page, seconds_per_doc)."""
    at = runs.groupBy(by).agg(F.sum("seconds").alias("s"), F.sum("pages").alias("p"), F.countDistinct("doc_id").alias("d"))
    return at.select(by, ratio(F.col("s"), F.col("p")).alias("seconds_per_page"), ratio(F.col("s"), F.col("d")).alias("seconds_per_doc"))


def timed(make: Callable[[], DataFrame]) -> tuple[DataFrame, float]:
    """What `make` returns, worked out to its last row, and the seconds that took."""
    began = time.perf_counter()
    out = make()
    out.write.format("noop").mode("overwrite").save()
    return out, time.perf_counter() - began


def post_redaction(checks: DataFrame) -> DataFrame:
    """checks (config, doc_id, ok, residue_ok, without_box): a row a configuration with its documents, those without a
    leak, those without residue, spans without a box, and whether all documents are free of leaks."""
    at = checks.groupBy("config").agg(F.count("*").alias("docs"), F.count_if("ok").alias("clean"), F.count_if(F.coalesce("residue_ok", F.lit(False))).alias("without_residue"), F.sum("without_box").alias("without_box"))
    return at.withColumn("passes", F.col("clean") == F.col("docs"))


def best_config(scored: DataFrame, label: str = "PERSON") -> DataFrame:
    """(config, f1) of the configuration with the highest F1 of a label; of equal ones the first by name. A
    configuration without the label has 0."""
    at = scored.groupBy("config").agg(F.coalesce(F.max(F.when(F.col("label") == label, F.col("f1"))), F.lit(0.0)).alias("f1"))
    return at.orderBy(F.desc("f1"), "config").limit(1)


def remainder(gold: DataFrame, spans: DataFrame, texts: DataFrame) -> DataFrame:
    """gold with `rest`: its characters that no span of the document covers, joined and stripped."""
    ranges = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")))).alias("_ranges"))
    at = gold.join(texts.select("doc_id", F.col("text").alias("_text")), "doc_id").join(ranges, "doc_id", "left")
    piece = "substring(_text, a.at + 1, greatest(least(r.start, cast(end as int)) - a.at, 0))"
    fold = f"aggregate(coalesce(_ranges, cast(array() as array<struct<start:int,end:int>>)), struct(cast(start as int) as at, '' as rest), (a, r) -> struct(greatest(a.at, least(r.end, cast(end as int))) as at, concat(a.rest, {piece}) as rest), a -> concat(a.rest, substring(_text, a.at + 1, greatest(cast(end as int) - a.at, 0))))"
    return text.with_bound(at, {"rest": text.stripped(F.expr(fold))}).drop("_text", "_ranges")


def residue(rests: DataFrame, k: int = 15) -> DataFrame:
    """(rest, n, title) of the most frequent remainders that are not empty; `title` marks forms of address."""
    at = rests.where("rest <> ''").groupBy("rest").agg(F.count("*").alias("n"))
    return at.withColumn("title", is_title(F.col("rest"))).orderBy(F.desc("n"), "rest").limit(k)


def is_title(rest: Column) -> Column:
    return F.lower(F.regexp_replace(rest, r"\.+$", "")).isin(*TITLES)


def title_share(rests: DataFrame) -> DataFrame:
    """(cases, titles, share) of remainders: how many say no more than a form of address."""
    at = rests.where("rest <> ''").agg(F.count("*").alias("cases"), F.count_if(is_title(F.col("rest"))).alias("titles"))
    return at.withColumn("share", ratio(F.col("titles"), F.col("cases")))


def leaking(classes: DataFrame) -> DataFrame:
    """(doc_id, leaks) of documents with gold spans that nothing covers."""
    return classes.where(F.col("class").isin("wrong_label", "not_found")).groupBy("doc_id").agg(F.count("*").alias("leaks"))


def by_support(scored: DataFrame) -> DataFrame:
    """A table of scores in order: the label with the most gold spans first."""
    return scored.orderBy(F.desc("support"), "label")


def search_groups(groups: DataFrame, column: str, query: str, k: int = 6) -> DataFrame:
    """The first k groups, in reading order (first), whose value contains a query."""
    return search(groups, column, query).orderBy("first", column).limit(k)


def corpus_summary(docs: DataFrame, gold: DataFrame) -> DataFrame:
    """docs (doc_id, genre), gold (doc_id, ...): (genre, docs, entities)."""
    n = gold.groupBy("doc_id").agg(F.count("*").alias("n"))
    return docs.join(n, "doc_id", "left").groupBy("genre").agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("entities"))
