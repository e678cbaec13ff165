"""Mixing sources to target weights by pivotal dependent rounding.

Every document has a fractional number of copies: its source's target over its source's size. The whole part is
given; the fractions are settled in pairs. A pair moves word mass from one to the other, either way with the
chances that keep both expectations, until one fraction is 0 or 1; what remains fractional meets the next
document. Each leaf of a reduction tree leaves one fraction at most, leaves are combined by the thousand, and the
last fraction of a source is rounded to the nearer side. So a source's words miss its target by half a document
at most, and no document is taken more often than its fraction rounded up.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkveil.llm._common import expose, join_by_count, released, spare_prefix, stored

#: Units that a leaf of the reduction tree settles, about, and residuals that a node above combines.
LEAF_UNITS, FANIN = 10_000, 1_000
#: A source's target is at most so many times its size.
MOST_COPIES = 3


def word_count(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+`; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def level(total: float, capped: Callable[[float], tuple[float, float]]) -> float:
    """The words a unit of weight gets when `total` is shared by weight and a source stops at its cap, the excess
    reshared until none is above. `capped` tells, of the sources that a level would take beyond their caps, the sum of
    the caps, and of the others the sum of the weights. Levels only rise, so each call settles some source or ends it;
    infinite if all stop."""
    now = 0.0
    while True:
        caps, weight = capped(now)
        new = max(total - caps, 0.0) / weight if weight else float("inf")
        if new <= now or not weight:
            return new
        now = new


def targets(sizes: list[int], weights: list[float], total: float, most: float = MOST_COPIES) -> list[float]:
    """Each source's target, for sources given as lists."""

    def capped(x: float) -> tuple[float, float]:
        over = [most * s < x * w for s, w in zip(sizes, weights)]
        return sum(most * s for s, o in zip(sizes, over) if o), sum(w for w, o in zip(weights, over) if not o)

    at = level(total, capped)
    return [float(min(most * s, at * w)) for s, w in zip(sizes, weights)]


def settle(masses: list[float], parts: list[float], rng: np.random.Generator) -> tuple[list[int], int, float]:
    """Pivotal rounding of the fractions `parts` of units that weigh `masses`: 0 or 1 for each unit, and the place
    and fraction of the one unit left (-1 if none). The weighted sum is kept throughout."""
    out = [0] * len(parts)
    held, p, s = -1, 0.0, 0.0
    draws = rng.random(len(parts)).tolist()
    for i, (q, t) in enumerate(zip(parts, masses)):
        if q <= 0.0 or q >= 1.0:
            out[i] = int(q >= 1.0)
            continue
        if held < 0:
            held, p, s = i, q, t
            continue
        full, bare, rise, fall = (1 - p) * s, q * t, (1 - q) * t, p * s
        up, down = min(full, bare), min(rise, fall)
        if draws[i] * (up + down) < down:  # mass goes from i to the one held
            if bare <= full:
                p += bare / s
                if p >= 1.0:
                    out[held], held = 1, -1
            else:
                out[held] = 1
                held, p, s = i, q - full / t, t
        elif fall <= rise:
            q += fall / t
            held, p, s = i, q, t
            if q >= 1.0:
                out[i], held = 1, -1
        else:
            out[i] = 1
            p -= rise / s
            if p <= 0.0:
                held = -1
    return out, held, p if held >= 0 else 0.0


def _settled(units: DataFrame, seed: int, level: int, last: bool) -> DataFrame:
    """Settle each (source_rank, node) group: `one` for settled units; the unit left has null there and its `part`."""

    def run(key, whole):  # without hints, Spark takes these for a key and a table
        whole = whole.sort_by([("size", "ascending"), ("unit", "ascending"), ("row_hash", "ascending")])
        rng = np.random.default_rng([seed, level, key[0].as_py(), key[1].as_py()])
        parts = whole.column("part").to_numpy().copy()
        ones, held, left = settle(whole.column("size").to_numpy().astype(float).tolist(), parts.tolist(), rng)
        one: list[int | None] = list(ones)
        if held >= 0:
            one[held] = round(left) if last else None
            parts[held] = left
        whole = whole.set_column(whole.schema.get_field_index("part"), "part", pa.array(parts))
        return whole.append_column("one", pa.array(one, pa.int32()))

    expose(units.sparkSession)
    schema = ", ".join(f"`{name}` {kind}" for name, kind in units.dtypes)
    return units.groupBy("source_rank", "node").applyInArrow(run, schema + ", one int")


def _ranked(sources: DataFrame) -> DataFrame:
    """Add source_rank, the place of each name by code point: places within ranges of names, and the ranges' counts,
    of which there are as many as partitions."""
    at = stored(sources.repartitionByRange("name").sortWithinPartitions("name").withColumn("place", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("place", 33)
    before, rows = 0, []
    for r in sorted(at.groupBy(part.alias("part")).count().collect()):
        rows.append((r["part"], before))
        before += r["count"]
    starts = F.broadcast(at.sparkSession.createDataFrame(rows, "part long, before long"))
    return at.join(starts, part == F.col("part")).withColumn("source_rank", F.col("before") + F.col("place") - F.shiftleft("part", 33)).drop("place", "part", "before")


#: What tells a unit: its key as text, its source, its size, and a hash of what makes rows alike.
_UNIT = ["unit", "name", "size", "row_hash"]


def _units(docs: DataFrame, key: str, source: str, text: str, prefix: str = "") -> dict[str, Column]:
    alike = [c for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]  # those that have a hash
    own, id_ = F.col(f"`{source}`").cast("string"), F.col(f"`{key}`").cast("bigint")
    named = {"unit": F.coalesce(id_.cast("string"), F.lit("n")), "name": F.coalesce(F.concat(F.lit("0"), own), F.lit("1")), "size": word_count(F.col(f"`{text}`")), "row_hash": F.xxhash64(*(F.col(f"`{c}`") for c in alike))}
    return {prefix + n: c for n, c in named.items()}


def _plan(docs: DataFrame, weights: tuple[float, ...], text: str, source: str, key: str, seed: int) -> DataFrame:
    """A row a unit: doc_id, source, the columns of _UNIT, rows, source_size, target, whole (copies of each row) and
    extra (rows that get one more)."""
    base = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"), *(c.alias(n) for n, c in _units(docs, key, source, text).items()))
    units = stored(base.groupBy("doc_id", "source", *_UNIT).agg(F.count("*").alias("rows")), "units")
    sources = stored(_ranked(units.groupBy("name").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("units"))), "ranks")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("source_rank") % len(weights) + 1).cast("int"))
    cap = (MOST_COPIES * F.col("source_size")).cast("double")
    total, n_units = (v or 0 for v in sources.agg(F.sum("source_size"), F.sum("units")).first())

    def capped(x: float) -> tuple[float, float]:
        over = cap < weight * x
        return tuple(v or 0.0 for v in sources.agg(F.sum(F.when(over, cap)), F.sum(F.when(~over, weight))).first())

    at = level(float(total), capped) if n_units else 0.0
    facts = sources.withColumn("target", F.least(cap, weight * at)).withColumn("share", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST_COPIES)))).otherwise(0.0))
    facts = facts.withColumn("whole", F.floor("share").cast("int")).withColumn("leaves", F.greatest(F.lit(1), F.ceil(F.col("units") / LEAF_UNITS)).cast("bigint"))
    known = join_by_count(units, facts, ["name"], "units", n_units)
    # Of n alike rows that many take one more as the fraction says of n; what is left of it is one row's fraction.
    due = F.col("rows") * (F.col("share") - F.col("whole"))
    moved_at = F.pmod(F.xxhash64(*_UNIT), F.col("leaves"))
    known = known.withColumn("extra", F.when(F.col("size") > 0, F.floor(due)).otherwise(F.col("rows") * F.round(F.col("share") - F.col("whole"))).cast("bigint"))
    known = known.withColumn("part", F.when(F.col("size") > 0, due - F.col("extra")).otherwise(0.0)).withColumn("node", moved_at).drop("share", "leaves")
    known = stored(known, "known")
    leaves, depth = facts.agg(F.max("leaves")).first()[0] or 1, 0
    current, done = known.where("part > 0"), []
    while True:
        last = leaves <= 1
        settled = stored(_settled(current, seed, depth, last), "settled")
        done.append(settled.where("one IS NOT NULL"))
        if last:
            break
        current = settled.where("one IS NULL").drop("one").withColumn("node", F.floor(F.col("node") / FANIN))
        leaves, depth = ceil(leaves / FANIN), depth + 1
    chosen = known.where("part <= 0").withColumn("one", F.lit(0))
    for more in done:
        chosen = chosen.unionByName(more)
    released(units, sources)
    return chosen.select("doc_id", "source", *_UNIT, "rows", "source_size", "target", "whole", (F.col("extra") + F.col("one")).alias("extra"))


def copies(docs: DataFrame, *, weights: tuple[float, ...] = (1, 2, 3), text: str = "text", source: str = "source", key: str = "doc_id", seed: int = 17) -> DataFrame:
    """(doc_id, source, size, rows, source_size, target, copies): how often documents are taken; `rows` says how many
    rows a line stands for.

    Sources by code point, null last, weigh `weights` in turn and share all the documents' words. Rows that agree in
    all columns are one unit, of which some may be taken once more than the others. A null key is a key. A
    document without words is taken as often as its fraction rounded. The same input gives the same copies in any
    partitioning: leaves follow from hashes, order within them from values, draws from the seed and the leaf.
    """
    plan = _plan(docs, weights, text, source, key, seed)
    lines = F.array(F.struct(F.col("extra").alias("rows"), (F.col("whole") + 1).alias("copies")), F.struct((F.col("rows") - F.col("extra")).alias("rows"), F.col("whole").alias("copies")))
    return plan.select("doc_id", "source", "size", "source_size", "target", F.inline(lines)).where("rows > 0").select("doc_id", "source", "size", "rows", "source_size", "target", "copies")


def each(times: Column) -> Column:
    """An array of numbers up to 1000 whose sum is `times`: explode it, then repeat by each, and no array is longer than a
    thousandth of the rows."""
    return F.transform(F.sequence(F.lit(0), F.floor((times - 1) / 1000)), lambda i: F.least(times - 1000 * i, F.lit(1000)).cast("int"))


def mix(docs: DataFrame, *, weights: tuple[float, ...] = (1, 2, 3), text: str = "text", source: str = "source", key: str = "doc_id", seed: int = 17) -> DataFrame:
    """The mixed documents themselves: each row as often as its copies say, none where they are 0; all columns.

    Of alike rows, those in all columns, some may come once more than the others. Units of few rows meet their plan in
    a merge join; one of many is aggregated where its rows are and comes back as often as all its rows together.
    """
    mine = spare_prefix(docs.columns)
    plan = stored(_plan(docs, weights, text, source, key, seed).select(*(F.col(c).alias(mine + c) for c in [*_UNIT, "rows", "whole", "extra"])), "plan")
    total = plan.agg(F.sum(f"{mine}rows")).first()[0] or 0
    limit = max(1024, total // 100_000)
    on = [mine + c for c in _UNIT]
    rows = docs.select(*(F.col(f"`{c}`") for c in docs.columns), *(c.alias(n) for n, c in _units(docs, key, source, text, mine).items()))
    many = F.broadcast(plan.where(F.col(f"{mine}rows") > limit))
    few = rows.join(many.select(*on), on, "left_anti").join(plan.where(F.col(f"{mine}rows") <= limit).hint("merge"), on)
    place = F.row_number().over(Window.partitionBy(*on).orderBy(*on))
    few = few.withColumn(f"{mine}times", (F.col(f"{mine}whole") + (place <= F.col(f"{mine}extra")).cast("int")).cast("bigint"))
    own = [F.col(f"`{c}`") for c in docs.columns]
    whole = F.first(F.struct(*own)).alias(f"{mine}row")
    times = F.first(F.col(f"{mine}rows") * F.col(f"{mine}whole") + F.col(f"{mine}extra")).cast("bigint")
    hot = rows.join(many, on).groupBy(*on).agg(whole, times.alias(f"{mine}times")).select(f"{mine}row.*", f"{mine}times")
    both = few.select(*own, f"{mine}times").unionByName(hot).where(F.col(f"{mine}times") > 0)
    stepped = both.select(*own, F.explode(each(F.col(f"{mine}times"))).alias(f"{mine}step"))
    return stepped.select(*own, F.explode(F.array_repeat(F.lit(1), F.col(f"{mine}step"))).alias(f"{mine}copy")).drop(f"{mine}copy")
