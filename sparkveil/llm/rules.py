"""Quality rules as a bitmask ledger, in DataFrame operations alone.

Every rule is evaluated once per document: the ledger keeps the measurements and one bit per rule that fails.
Policies are versions of a mask over those bits, so a new policy or an ablation reads the ledger, never the texts.
Everything works within a row: no shuffle, and any partitioning gives the same ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkveil.llm._common import spare_prefix

_SPACE = r"[\x20\x09-\x0D]+"
_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"

#: Rules in the order of their bits: a SQL condition over the measurements that holds when the rule fails.
#: No rule divides, and each is false for an empty text unless it is about length.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbol_density": "10 * n_symbols > 6 * n_words AND n_words >= 50",
    "duplicate_lines": "n_lines >= 4 AND 100 * n_dup_lines > 60 * n_lines",
    "long_words": "word_chars > 40 * n_words",
    "short_words": "2 * word_chars < 3 * n_words",
    "few_letters": "100 * n_letters < 40 * word_chars",
}


@dataclass(frozen=True)
class Policy:
    """A version of which rules reject: a document goes when any bit under the mask is set."""

    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << i for i, name in enumerate(RULES) if name in self.rules)


#: Version 1 is the base test alone. Version 2 adds two rules on the length of words. Version 3 rejects by every rule
#: of the ledger and is in force: on labelled rows the rules it adds reject junk made of symbols, repeated lines and
#: figures, and no document of good quality that version 2 keeps.
POLICIES = {1: Policy(1, ("too_few_words", "repeated_windows")), 2: Policy(2, ("too_few_words", "repeated_windows", "long_words", "short_words")), 3: Policy(3, tuple(RULES))}
BASE = POLICIES[1]
CURRENT = POLICIES[3]


def _windows(words: Column) -> Column:
    """A hash for each three-word window."""
    n = F.size(words)
    hashes = F.transform(F.slice(words, F.lit(1), n - 2), lambda a, i: F.xxhash64(a, F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(n >= 4, hashes).otherwise(F.array().cast("array<bigint>"))


def measure(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """Add the measurements: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_letters (all
    long). A null text counts as empty: all of them 0. They replace columns of their name.

    Windows of three words count as equal by 64-bit hashes: of a text's n windows two that differ are taken for equal
    with a chance of n**2 / 2**65, 3e-12 for ten thousand words. Windows that repeat are put in order with their
    places, runs of an equal hash give the places, and neighbours among the places give the cover.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters"]
    own = spare_prefix(docs.columns)
    body, words, hashes, pairs, places, lines, solid = (f"{own}{n}" for n in ("text", "words", "hashes", "pairs", "places", "lines", "solid"))
    others = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    at = docs.select(*others, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(body))
    at = at.select("*", F.array_remove(F.split(body, _SPACE), "").alias(words), F.filter(F.split(body, "\n"), lambda x: F.trim(x, F.lit(_SPACES)) != "").alias(lines), F.translate(body, _SPACES, "").alias(solid))
    at = at.select("*", _windows(F.col(words)).alias(hashes))
    ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # Only texts with an equal pair of windows pay for the sort.
    some = F.size(F.array_distinct(hashes)) < F.size(hashes)
    at = at.select("*", F.when(some, ranked).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")).alias(pairs))
    m = F.size(pairs)
    less = F.greatest(m - 1, F.lit(0))
    same = F.zip_with(F.slice(pairs, F.lit(1), less), F.slice(pairs, F.lit(2), less), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    found = F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))
    at = at.select("*", F.when(m > 0, found).otherwise(F.array().cast("array<int>")).alias(places))
    k = F.size(places)
    less = F.greatest(k - 1, F.lit(0))
    gaps = F.zip_with(F.slice(places, F.lit(1), less), F.slice(places, F.lit(2), less), lambda a, b: F.least(b - a, F.lit(3)))
    cover = F.when(k > 0, F.aggregate(gaps, F.lit(3).cast("bigint"), lambda total, g: total + g)).otherwise(F.lit(0)).cast("bigint")
    size = F.length(body)
    measured = {
        "n_words": F.size(words),
        "word_chars": F.length(solid),
        "n_symbols": size - F.length(F.translate(body, _SYMBOLS, "")),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": cover,
        "n_letters": F.length(F.regexp_replace(solid, r"[\P{L}]+", "")),
    }
    # As rows of a generator: a filter on a measurement stays above it, where copied into the steps below each step
    # would be worked out again in the next; filters on other columns still go down to the scan.
    return at.select(*others, F.inline(F.array(F.struct(*(c.cast("bigint").alias(n) for n, c in measured.items())))))


def ledger(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """The measurements and `failed`: bit i is set when rule i of RULES fails."""
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    measured = measure(docs, text=text)
    return measured.select(*(F.col(f"`{c}`") for c in measured.columns if c != "failed"), failed.cast("bigint").alias("failed"))


def apply_policy(entries: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """Add `policy_version` and `kept` by a version's mask; the texts are not read again."""
    others = [F.col(f"`{c}`") for c in entries.columns if c not in ("policy_version", "kept")]
    return entries.select(*others, F.lit(policy.version).alias("policy_version"), (F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0).alias("kept"))


def ablations(entries: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """One row a rule of the policy: documents that fail it, that fail it and no other rule of the policy (what
    leaving the rule out would bring back), and documents rejected in all. One pass over the ledger, with
    partial sums of bits; an empty ledger gives zeros."""
    under = F.col("failed").bitwiseAND(F.lit(policy.mask))
    sums = [F.count_if(under != 0).alias("rejected")]
    for i, name in enumerate(RULES):
        if policy.mask >> i & 1:
            sums += [F.count_if(under.bitwiseAND(F.lit(1 << i)) != 0).alias(f"f{i}"), F.count_if(under == (1 << i)).alias(f"o{i}")]
    rows = F.array(*(F.struct(F.lit(name).alias("rule"), F.col(f"f{i}").alias("failing"), F.col(f"o{i}").alias("only_this"), F.col("rejected").alias("rejected")) for i, name in enumerate(RULES) if policy.mask >> i & 1))
    return entries.agg(*sums).select(F.inline(rows))
