"""Removing spans from texts, or putting tokens in their place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkveil.functions import dims, text

_SUBSTITUTIONS = "array<struct<start:int,end:int,entity:string,token:string>>"


def value_key(value: Column) -> Column:
    """Values that differ in white space alone get one token; case and accents count."""
    return text.collapsed(value)


def tokens(spans: DataFrame, *, seed: int | None = None) -> DataFrame:
    """Add `token` to spans (doc_id, start, end, entity, value): [PREFIX-XXXX], the same for equal values of one
    entity within a document, different for different ones.

    The code is a bijection of the value's rank, (a * rank + b) mod 65536, with a and b drawn for each document: an
    odd a never collides, and codes say nothing of values or of other documents. With a seed a and b follow from it
    and the document; without one they are random, so store the result before using it twice. More than 65,536
    values of an entity in one document are an error.
    """
    key = spans.withColumn("_key", value_key(F.col("value")))
    order = Window.partitionBy("doc_id", "entity").orderBy("_first", "_key")
    first = key.withColumn("_first", F.min("start").over(Window.partitionBy("doc_id", "entity", "_key")))
    ranked = first.withColumn("_rank", F.dense_rank().over(order) - 1)
    draw = (lambda n: F.xxhash64(F.lit(seed), F.lit(n), "doc_id")) if seed is not None else (lambda n: F.first(F.floor(F.rand() * (1 << 40)).cast("bigint")).over(Window.partitionBy("doc_id")))
    a, b = F.pmod(draw(1), F.lit(32768)) * 2 + 1, F.pmod(draw(2), F.lit(65536))
    prefix = F.element_at(F.create_map(*(F.lit(v) for pair in dims.PREFIX.items() for v in pair)), F.col("entity"))
    code = F.pmod(a * F.col("_rank") + b, F.lit(65536)).cast("bigint")
    made = F.concat(F.lit("["), prefix, F.lit("-"), F.lpad(F.hex(code), 4, "0"), F.lit("]"))
    bad = F.when(prefix.isNull(), F.raise_error(F.lit("entity without a prefix"))).when(F.col("_rank") >= 65536, F.raise_error(F.lit("no codes left"))).otherwise(made)
    return ranked.withColumn("token", bad).drop("_key", "_first", "_rank")


def splice(df: DataFrame, *, column: str = "text", edits: str = "edits", out: str = "rewritten") -> DataFrame:
    """Add `out`: the text with each edit (array of struct start, end, put) done. Edits may touch; overlapping ones
    are an error. A null text stays null."""
    body = F.col(f"`{column}`")
    ordered = F.array_sort(F.transform(F.col(edits), lambda e: F.struct(e["start"].cast("int").alias("start"), e["end"].cast("int").alias("end"), e["put"].alias("put"))))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("done"))

    def step(acc: Column, e: Column) -> Column:
        gap = F.substring(body, acc["at"] + 1, e["start"] - acc["at"])
        return F.when(e["start"] < acc["at"], F.raise_error(F.lit("edits overlap")).cast("struct<at:int,done:array<string>>")).otherwise(F.struct(e["end"].alias("at"), F.array_append(acc["done"], F.concat(gap, e["put"])).alias("done")))

    whole = F.aggregate(ordered, zero, step, lambda acc: F.array_join(F.array_append(acc["done"], F.substring(body, acc["at"] + 1, F.length(body))), ""))
    return text.with_bound(df, {out: F.when(F.size(edits) > 0, whole).otherwise(body)})


def redact(df: DataFrame, *, column: str = "text", spans: str = "spans", mark: Callable[[Column], Column] | None = None, out: str = "rewritten") -> DataFrame:
    """Add `out`: the text without the spans' values, or with `mark` of the span in their place; `by_entity` marks a
    span by its entity."""
    edits = F.transform(F.col(spans), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), (F.lit("") if mark is None else mark(s)).alias("put")))
    return splice(df.withColumn("_edits", edits), column=column, edits="_edits", out=out).drop("_edits")


def by_entity(span: Column) -> Column:
    return F.concat(F.lit("["), span["entity"], F.lit("]"))


def pseudonymise(df: DataFrame, *, column: str = "text", spans: str = "spans", seed: int | None = None) -> DataFrame:
    """Add `rewritten`, `substitutions` (array of start, end, entity, token) and `tokens` (distinct, sorted).

    A document's tokens depend on it alone, so they are given within its row: nothing is shuffled. Codes are those of
    `tokens`, of a value's place among the document's values of all entities; more than 65,536 are an error.
    """
    seeded = [F.xxhash64(F.lit(seed), F.lit(n), F.col("doc_id")) if seed is not None else F.floor(F.rand() * (1 << 40)).cast("bigint") for n in (1, 2)]
    at = df.withColumns({"_a": F.pmod(seeded[0], F.lit(32768)) * 2 + 1, "_b": F.pmod(seeded[1], F.lit(65536))})
    value = lambda s: value_key(F.substring(F.col(f"`{column}`"), s["start"] + 1, s["end"] - s["start"]))
    keyed = F.transform(F.array_sort(F.col(spans)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["entity"].alias("entity"), F.concat(s["entity"], F.lit(":"), value(s)).alias("key")))
    prefixes = F.create_map(*(F.lit(v) for pair in dims.PREFIX.items() for v in pair))

    def made(all_: Column) -> Column:
        def one(s: Column) -> Column:
            code = F.pmod(F.col("_a") * (F.array_position(all_["names"], s["key"]) - 1) + F.col("_b"), F.lit(65536)).cast("bigint")
            prefix = F.coalesce(F.element_at(prefixes, s["entity"]), F.raise_error(F.lit("entity without a prefix")).cast("string"))
            return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["entity"].alias("entity"), F.concat(F.lit("["), prefix, F.lit("-"), F.lpad(F.hex(code), 4, "0"), F.lit("]")).alias("token"))

        return F.when(F.size(all_["names"]) > 65536, F.raise_error(F.lit("no codes left")).cast(_SUBSTITUTIONS)).otherwise(F.transform(all_["keyed"], one))

    named = text.bind(keyed, lambda k: F.struct(k.alias("keyed"), F.array_distinct(F.transform(k, lambda s: s["key"])).alias("names")))
    at = text.with_bound(at, {"substitutions": F.coalesce(text.bind(named, made), F.array().cast(_SUBSTITUTIONS))}).drop("_a", "_b")
    at = at.withColumn("_edits", F.transform("substitutions", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["token"].alias("put"))))
    at = splice(at, column=column, edits="_edits")
    return at.withColumn("tokens", F.array_sort(F.array_distinct(F.transform("substitutions", lambda s: s["token"])))).drop("_edits")


def found_before_sending(df: DataFrame, rules: Column, default: Column, *, column: str = "rewritten") -> DataFrame:
    """(doc_id, entity, start, end): what detection still finds in texts that are to be sent, at a threshold that
    rather refuses a safe text than lets a value go. Only entities that the policy removes count, tokens are no
    finds, and values are never copied."""
    from sparkveil.operators import policy, recognizers

    spans = recognizers.exploded(recognizers.detect(df, column=column, out="_left", threshold=dims.RESEND_THRESHOLD).withColumns({"_rules": rules, "_default": default}), spans="_left", keys=("doc_id", "_rules", "_default"))
    return spans.where(policy.removes(policy.operator_of(F.col("entity"), F.col("_rules"), F.col("_default")))).select("doc_id", "entity", "start", "end")


def may_be_sent(df: DataFrame, rules: Column, default: Column, *, column: str = "rewritten") -> DataFrame:
    """df with `sendable`: whether the last detection finds nothing."""
    found = found_before_sending(df, rules, default, column=column).select("doc_id").distinct().withColumn("_found", F.lit(True))
    return df.join(found, "doc_id", "left").withColumn("sendable", F.col("_found").isNull()).drop("_found")
