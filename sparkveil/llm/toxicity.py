"""Toxicity by a weighted lexicon.

Texts are folded: lower case, homoglyphs and accents to Latin letters, digit and symbol substitutions to the
letters they stand for (i, l and 1 to one letter), and letters set apart, three or more in a row, to one word. An
Aho-Corasick automaton finds lexicon terms at word starts, whole words where a term is short, hits inside an exception
phrase do not count, and the weights found are normalised by length and calibrated. The lexicon and the calibration
are learned from a bounded sample of labelled rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkveil.llm._common import map_arrow, released, slices, stored
from sparkveil.llm._words import mix, shingle_hashes, word_hashes

#: Labelled rows that the lexicon and the calibration are learned from, at most: those of least hash.
FIT_ROWS = 20_000
#: Lengths of prefixes that are lexicon terms; shorter words are terms as wholes. Toxic rows a term must stand in, the
#: least weight of one, and the least likelihood ratio statistic of its rows: 25 comes up by chance once in two million
#: terms.
TERM_CHARS, MIN_ROWS, MIN_WEIGHT, MIN_EVIDENCE = range(4, 11), 6, 3.0, 25.0
#: MinHash samples of a row's three-word shingles: of rows that agree in one of them one counts, as copies of a passage
#: say no more than it does.
SIGNS = 4
#: A term is made longer as long as it keeps such a share of its rows.
SAME_SHARE = 0.97

#: Phrases whose lexicon terms are meant otherwise.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "clownfish", "pathetic fallacy")

_SUBSTITUTES = {"0": "o", "1": "i", "l": "i", "3": "e", "4": "a", "@": "a", "5": "s", "$": "s", "7": "t", "8": "b", "9": "g"}
# Letters of other scripts that look like a Latin letter.
_LOOKALIKES = dict(zip("авекмнорстухіјѕԁԛԝһαβεηικνορτυχ", "abekmhopctyxijsdqwhaben" + "ikvoptux"))


def _fold_table() -> dict[int, str]:
    table: dict[int, str] = {}
    for code in [*range(0x250), *range(0x370, 0x530), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        c = unicodedata.normalize("NFKC", chr(code)).lower()
        c = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x)) or " "
        c = "".join(_LOOKALIKES.get(x, x) for x in c)
        c = "".join(_SUBSTITUTES.get(x, x) for x in c)
        table[code] = c if c.isalnum() else " "
    return table | dict.fromkeys([0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF], "")


_FOLD = _fold_table()
_APART = re.compile(r"(?<!\S)\w(?: \w){2,}(?!\S)")


def fold(text: str) -> str:
    """Words of the folded text, each after one space, and a space at the end if there are any."""
    folded = " ".join(text.translate(_FOLD).split())
    if " " in folded and _APART.search(folded):
        folded = _APART.sub(lambda m: m[0].replace(" ", ""), folded)
    return " " + folded + " " * bool(folded)


@dataclass
class Model:
    """Term weights, exception phrases and the calibration (bias, weight of the evidence, weight of its density)."""

    terms: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    calibration: tuple[float, float, float] = (-4.0, 2.0, 0.0)

    def frozen(self) -> tuple:
        return tuple(sorted(self.terms.items())), self.exceptions, self.calibration


class Matcher:
    def __init__(self, terms: tuple[tuple[str, float], ...], exceptions: tuple[str, ...]):
        self.automaton = ahocorasick.Automaton()
        for term, weight in terms:
            form = " " + term + " " * (len(term) < TERM_CHARS[0])
            self.automaton.add_word(form, (len(form), weight))
        for phrase in exceptions:
            folded = fold(phrase)[:-1]
            if len(folded) > 1:
                self.automaton.add_word(folded, (len(folded), 0.0))
        self.any = len(self.automaton) > 0
        if self.any:
            self.automaton.make_automaton()

    def evidence(self, text: str) -> tuple[float, int]:
        """Weight of the terms found, one for each word, outside exceptions; and the number of words."""
        folded = fold(text)
        words = folded.count(" ") - 1 if len(folded) > 1 else 0
        if not self.any or not words:
            return 0.0, words
        hits: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (size, weight) in self.automaton.iter(folded):
            start = end + 1 - size
            if weight == 0.0:
                spared.append((start, end))
            elif weight > hits.get(start, 0.0):
                hits[start] = weight
        return sum(w for at, w in hits.items() if not any(a <= at <= b for a, b in spared)), words


@lru_cache(maxsize=4)
def _matcher(terms: tuple, exceptions: tuple[str, ...]) -> Matcher:
    return Matcher(terms, exceptions)


def signals(weight: float, words: int) -> tuple[float, float]:
    """The evidence, damped, and its density over the text's length, damped."""
    return math.log1p(weight), math.log1p(100.0 * weight / (words + 20.0))


def score(weight: float, words: int, calibration: tuple[float, float, float]) -> float:
    a, b = signals(weight, words)
    z = calibration[0] + calibration[1] * a + calibration[2] * b
    return 1.0 / (1.0 + math.exp(-max(-50.0, min(50.0, z))))


def terms_of(word: str) -> Iterator[str]:
    """The terms a word holds: its prefixes of the lengths in TERM_CHARS, or a short word itself."""
    if len(word) < TERM_CHARS[0]:
        yield word
    for n in TERM_CHARS:
        if len(word) < n:
            return
        yield word[:n]


def _signed(rows: DataFrame) -> DataFrame:
    """Add the MinHash samples sign0, sign1, ... of each text; all 0 for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(0)):
                keys, bounds = shingle_hashes(*word_hashes([t.encode() for t in batch.column(0).slice(a, b - a).to_pylist()]), 3)
                full = np.flatnonzero(np.diff(bounds) > 0)
                signs = np.zeros((SIGNS, b - a), np.uint64)
                for i in range(SIGNS if len(full) else 0):
                    signs[i, full] = np.minimum.reduceat(mix(keys + np.uint64(i)), bounds[full])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(s.view(np.int64)) for s in signs)], names=[*part.schema.names, *(f"sign{i}" for i in range(SIGNS))])

    return map_arrow(rows, run, "text string, toxic int, " + ", ".join(f"sign{i} bigint" for i in range(SIGNS)))


def without_copies(rows: DataFrame) -> DataFrame:
    """rows (text, toxic) with one, the least, of those of a label that share a sample; sample by sample."""
    at = _signed(rows)
    for i in range(SIGNS):
        least = F.min(F.struct("text", *(f"sign{j}" for j in range(SIGNS)))).alias("row")
        at = at.groupBy("toxic", F.col(f"sign{i}").alias("sign")).agg(least).select("toxic", "row.*")
    return at.select("text", "toxic")


def _count_terms(rows: DataFrame, only: frozenset[str] | None) -> DataFrame:
    """(term, n): texts that have a word with the term; partial counts of each step are summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(0), 8 << 20):
                counts: Counter[str] = Counter()
                for text in batch.column(0).slice(a, b - a).to_pylist():
                    found = {t for w in set(fold(text or "").split()) for t in terms_of(w)}
                    counts.update(found if only is None else found & only)
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

    return map_arrow(rows.select("text"), run, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def weigh(n: int, other: int, rows: tuple[int, int]) -> tuple[float, float]:
    """The log-odds weight of a term in n of rows[0] toxic and in `other` of rows[1] other rows, and the likelihood
    ratio statistic of the two shares being different."""
    weight = math.log((n + 0.5) / (rows[0] + 1)) - math.log((other + 0.5) / (rows[1] + 1))
    share = (n + other) / (rows[0] + rows[1])
    part = lambda x, mean: x * math.log(x / mean) if x else 0.0
    return weight, 2 * (part(n, share * rows[0]) + part(other, share * rows[1]) + part(rows[0] - n, (1 - share) * rows[0]) + part(rows[1] - other, (1 - share) * rows[1]))


def choose_terms(positive: dict[str, int], negative: dict[str, int], rows: tuple[int, int]) -> dict[str, float]:
    """Log-odds weights of the terms that mark toxic rows. Of nested terms the shortest that does so is found, then
    made longer while nearly all its rows have the longer one, so that it says no more than it was learned from."""
    longer: dict[str, list[str]] = {}
    for term in positive:
        longer.setdefault(term[:-1], []).append(term)
    out: dict[str, float] = {}
    for term in sorted(positive, key=lambda t: (len(t), t)):
        if any(term[:n] in out for n in TERM_CHARS if n < len(term)):
            continue
        n, other = positive[term], negative.get(term, 0)
        weight, evidence_ = weigh(n, other, rows)
        if evidence_ >= MIN_EVIDENCE and weight >= MIN_WEIGHT and 20 * other <= n:
            while len(term) >= TERM_CHARS[0] and (best := max((t for t in longer.get(term, ()) if positive[t] >= SAME_SHARE * positive[term]), key=lambda t: (positive[t], t), default=None)):
                term = best
            out[term] = max(out.get(term, 0.0), min(weight, 8.0))
    return dict(sorted(out.items()))


def calibrate(weights: np.ndarray, words: np.ndarray, labels: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression on the two signals by Newton's method, with a small ridge."""
    if not len(labels) or labels.min() == labels.max():
        return Model().calibration
    x = np.column_stack((np.ones(len(labels)), np.array([signals(w, int(n)) for w, n in zip(weights, words)])))
    beta, ridge = np.zeros(3), np.diag([1e-6, 0.05, 0.05])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + ridge, x.T @ (labels - p) - ridge @ beta)
        beta = beta + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def fit(docs: DataFrame, labels: DataFrame, *, fit_rows: int = FIT_ROWS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Model:
    """Learn a model from docs (doc_id, text) and labels (doc_id, toxic). At most fit_rows labelled ids are used, those
    whose hash is least, each with one text, the least of its texts, and of near copies one; null labels and ids are
    not. What reaches the driver is the terms in MIN_ROWS or more of these toxic rows, and two numbers for each row, so
    fit_rows and their length bound it; all terms that pass the tests are kept. Without rows of both labels the model
    has no terms."""
    chosen = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    held = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = stored(held.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic"), "labelled")
    every, rows = rows, stored(without_copies(rows), "distinct")
    released(every)
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    p, n = sizes.get(1, 0), sum(v for k, v in sizes.items() if k != 1)
    if not p or not n:
        return Model(exceptions=exceptions)
    positive = {r["term"]: r["n"] for r in _count_terms(rows.where("toxic = 1"), None).where(F.col("n") >= MIN_ROWS).collect()}
    negative = {r["term"]: r["n"] for r in _count_terms(rows.where("toxic <> 1"), frozenset(positive)).collect()}
    model = Model(choose_terms(positive, negative, (p, n)), exceptions)
    seen = evidence(rows, model).select("toxic", "weight", "words").toPandas()
    model.calibration = calibrate(seen["weight"].to_numpy(), seen["words"].to_numpy(), (seen["toxic"] == 1).to_numpy(float))
    released(rows)
    return model


def _scored(docs: DataFrame, model: Model, text: str, new: dict[str, tuple[str, pa.DataType]], make, keep: list[str]) -> DataFrame:
    others = [c for c in keep if c not in new]
    terms, exceptions, calibration = model.frozen()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _matcher(terms, exceptions)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for a, b in slices(column):
                part = batch.slice(a, b - a)
                made = [make(*own.evidence(t or ""), calibration) for t in column.slice(a, b - a).to_pylist()]
                arrays = [pa.array([m[k] for m in made], kind) for k, (_, kind) in enumerate(new.values())]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in others), *arrays], names=[*others, *new])

    kinds = dict(docs.dtypes)
    schema = [*(f"`{c}` {kinds[c]}" for c in others), *(f"`{c}` {kind}" for c, (kind, _) in new.items())]
    return map_arrow(docs.select(*(f"`{c}`" for c in dict.fromkeys([*others, text]))), run, ", ".join(schema))


def evidence(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add `weight` (of the terms found) and `words`; rows are kept one for one, without a shuffle."""
    return _scored(docs, model, text, {"weight": ("double", pa.float64()), "words": ("bigint", pa.int64())}, lambda w, n, _: (w, n), keep if keep is not None else docs.columns)


def toxicity(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add `score` (0 to 1), `predicted` (1 from 0.5 on) and `lexicon_weight`; they replace columns of their name.
    A null text counts as empty and scores as a text without terms. Rows are kept one for one."""

    def make(weight: float, words: int, calibration: tuple[float, float, float]) -> tuple[float, int, float]:
        value = score(weight, words, calibration)
        return value, int(value >= 0.5), weight

    new = {"score": ("double", pa.float64()), "predicted": ("int", pa.int32()), "lexicon_weight": ("double", pa.float64())}
    return _scored(docs, model, text, new, make, keep if keep is not None else docs.columns)
