"""Policies: which operator each entity gets, and what that means for a span."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkveil.functions import dims

SCHEMA = "name string, description string, default string, rules map<string,string>, threshold double"


def profiles(spark: SparkSession) -> DataFrame:
    """The two factory profiles: redact what is redacted by default, or put tokens in its place."""
    rows = [(op, f"{op} for entities redacted by default", "manter", {e: op for e in dims.REDACTED}, None) for op in dims.REMOVING]
    return spark.createDataFrame(rows, SCHEMA)


def from_json(texts: DataFrame, column: str = "value") -> DataFrame:
    """Profiles from JSON text; missing parts get defaults, a missing name is an error."""
    at = texts.select(F.from_json(column, SCHEMA).alias("p")).select("p.*")
    name = F.when(F.col("name").isNull(), F.raise_error(F.lit("profile without a name"))).otherwise(F.col("name"))
    empty = F.create_map().cast("map<string,string>")
    return at.select(name.alias("name"), F.coalesce("description", F.lit("")).alias("description"), F.coalesce("default", F.lit("manter")).alias("default"), F.coalesce("rules", empty).alias("rules"), "threshold")


def to_json(profile: DataFrame) -> DataFrame:
    return profile.select(F.to_json(F.struct("name", "description", "default", "rules", "threshold")).alias("value"))


def operator_of(entity: Column, rules: Column, default: Column) -> Column:
    return F.coalesce(F.element_at(rules, entity), default)


def removes(operator: Column) -> Column:
    return operator.isin(*dims.REMOVING)


def manual_operator(default: Column) -> Column:
    """Spans marked by hand: the default if it removes, else tarja."""
    return F.when(removes(default), default).otherwise("tarja")


def span_operator(entity: Column, rules: Column, default: Column) -> Column:
    """What removes a span: its class's operator if that removes, else the default if it does, else tarja."""
    own = F.when(entity == "MANUAL", manual_operator(default)).otherwise(operator_of(entity, rules, default))
    return F.when(removes(own), own).when(removes(default), default).otherwise("tarja")


def will_be_removed(active: Column, operator: Column) -> Column:
    """An explicit decision stands; without one the operator decides."""
    return F.coalesce(active, removes(operator))


def effective(profile: DataFrame) -> DataFrame:
    """(name, entity, operator) of every entity and profile."""
    entities = F.explode(F.array(*map(F.lit, dims.NAMES))).alias("entity")
    return profile.select("name", entities, "rules", "default").select("name", "entity", operator_of(F.col("entity"), F.col("rules"), F.col("default")).alias("operator"))


def violations(profile: DataFrame) -> DataFrame:
    """(name, problem, value): one row for each thing wrong with a profile."""
    known, ops = F.array(*map(F.lit, dims.NAMES)), F.array(*map(F.lit, dims.OPERATORS))
    used = F.array_distinct(F.concat(F.array("default"), F.map_values("rules")))
    found = F.concat(
        F.when(~F.col("default").isin(*dims.OPERATORS), F.array(F.struct(F.lit("unknown default").alias("problem"), F.col("default").alias("value")))).otherwise(F.array()),
        F.transform(F.array_except(F.map_keys("rules"), known), lambda e: F.struct(F.lit("unknown entity").alias("problem"), e.alias("value"))),
        F.transform(F.array_except(F.map_values("rules"), ops), lambda o: F.struct(F.lit("unknown operator").alias("problem"), o.alias("value"))),
        F.transform(F.array_intersect(used, F.array(*map(F.lit, dims.NOT_IMPLEMENTED))), lambda o: F.struct(F.lit("not implemented").alias("problem"), o.alias("value"))),
        F.when((F.col("threshold") < 0) | (F.col("threshold") > 1), F.array(F.struct(F.lit("threshold").alias("problem"), F.col("threshold").cast("string").alias("value")))).otherwise(F.array()),
    )
    return profile.select("name", F.inline(found))


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """(entity, old_operator, new_operator) where two profiles differ."""
    a, b = effective(old).select("entity", F.col("operator").alias("old_operator")), effective(new).select("entity", F.col("operator").alias("new_operator"))
    return a.join(F.broadcast(b), "entity").where(~F.col("old_operator").eqNullSafe(F.col("new_operator")))


def with_mode(rules: Column, mode: str) -> Column:
    """Every rule that does something does it in this mode."""
    return F.transform_values(rules, lambda _, op: F.when(op == "manter", op).otherwise(F.lit(mode)))


def with_rule(rules: Column, entity: str, operator: str) -> Column:
    return F.map_concat(F.map_filter(rules, lambda k, _: k != entity), F.create_map(F.lit(entity), F.lit(operator)))


def inventory(spans: DataFrame) -> DataFrame:
    """(entity, n) of all entities, those without spans too. 16 rows."""
    dim = dims.entity_table(spans.sparkSession).select("entity")
    return dim.join(spans.groupBy("entity").agg(F.count("*").alias("n")), "entity", "left").select("entity", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def ordered_inventory(spans: DataFrame) -> DataFrame:
    """The inventory with each entity's `place`: those found first, the most frequent first, then the others by name."""
    order = Window.orderBy(F.col("n") == 0, F.desc("n"), "entity")  # 16 rows
    return inventory(spans).withColumn("place", F.row_number().over(order))
