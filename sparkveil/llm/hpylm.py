"""Language-model scores by a hierarchical Pitman-Yor process.

Every token is drawn in the restaurant of its context, the word before it; all context restaurants share one parent,
the restaurant of single words, whose base measure is over the known words and one unknown word. Contexts are told
apart by 20 bits of a hash, so that what all shards share has a fixed size; see the README for what that costs.
Seating is sampled by Gibbs sweeps: the number of tables at which a dish's customers sit is drawn given everything
else, from its conditional in generalised Stirling numbers; the identities of the tables integrate out. Predictive
probabilities are averaged over the sweeps kept.

Distribution. Blocks of documents reduce their tokens to distinct (word, context) pairs with counts; these go, in
compressed arrays, to the shard that owns the word. Words that would overfill a shard are dealt by word and context
over all shards. Shards are stored, one row each. A dish's numbers are its shard's own, but for dealt words; what is
global is two counts for each context, one for each dealt word and a few sums. They are exact: a job for each sweep
draws it in every shard and adds up the tables just drawn, and the next sweep goes by that. A shard draws the same in
every job, as draws follow from the seed, the shard and the sweep, so no state is kept but the totals. The last job
replies to each block with the probabilities of its pairs, and blocks are formed again to add up their documents.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkveil.llm._common import map_arrow, slices, stored
from sparkveil.llm._words import mix, word_hashes

#: Bits that tell contexts apart; tokens of a block; bytes of text for which a shard of words is set up; tokens beyond
#: which a word is dealt over all shards, as far as a sample of one document in SAMPLED says.
CLASS_BITS, BLOCK_TOKENS, SHARD_BYTES = 20, 1 << 19, 8 << 20
CLASSES = 1 << CLASS_BITS
HOT_TOKENS, SAMPLED = 400_000, 32
#: Ranges in which contexts' totals are added up.
RANGES = 64
#: Customers up to which each count has its own row of Stirling numbers, and up to which any has.
EXACT, LIMIT = 256, 8192
#: Gibbs sweeps before and within the average.
BURN_IN, KEPT = 1, 2
#: Strengths of the context and the word restaurants, and the base measure's share for unknown words.
THETA_CONTEXT, THETA_WORD, UNKNOWN = 1.0, 1.0, 0.5
_END, _BEGIN = mix(np.array([1, 2], np.uint64))


def is_held_out(key: object) -> bool:
    """Whether a document is left out of training: crc32 of its id as text leaves 2 modulo 7. A null id counts as
    the empty text."""
    return zlib.crc32(b"" if key is None else str(key).encode()) % 7 == 2


def pair_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash of each token, its context's class, and the bounds of each text's tokens. A text's last token is
    its end."""
    words, bounds = word_hashes(texts)
    counts = np.diff(bounds) + 1
    ends = np.cumsum(counts)
    tokens = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    is_end = np.zeros(len(tokens), bool)
    is_end[ends - 1] = True
    tokens[~is_end], tokens[is_end] = words, _END
    context = np.empty_like(tokens)
    context[1:] = tokens[:-1]
    context[ends - counts] = _BEGIN
    classes = (mix(context) >> np.uint64(64 - CLASS_BITS)).astype(np.uint32)
    return tokens, classes, np.concatenate(([0], ends))


def distinct_pairs(words: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (word, class) pairs, by word and then class, and each token's place among them."""
    own, number = np.unique(words, return_inverse=True)
    pairs, place = np.unique(number.astype(np.uint64) << np.uint64(CLASS_BITS) | classes, return_inverse=True)
    return own[(pairs >> np.uint64(CLASS_BITS)).astype(np.int64)], (pairs & np.uint64(CLASSES - 1)).astype(np.uint32), place


def checksum(words: np.ndarray, classes: np.ndarray) -> np.uint64:
    """A number that tells sets of pairs apart."""
    return mix(words + mix(classes.astype(np.uint64) + np.uint64(1))).sum(dtype=np.uint64)


def _pack(**columns: np.ndarray) -> bytes:
    """Arrays of any lengths as one compressed message of few bytes more: a block has a small one for each shard. Bytes
    of one place in the numbers lie together, as the high ones are mostly zero."""
    head, body = bytearray([len(columns)]), []
    for name, v in columns.items():
        v = np.ascontiguousarray(v)
        head += bytes([len(name)]) + name.encode() + v.dtype.str.encode().ljust(3) + struct.pack("<I", len(v))
        body.append(v.view(np.uint8).reshape(len(v), v.dtype.itemsize).T.tobytes())
    raw = bytes(head) + b"".join(body)
    return struct.pack("<I", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> dict[str, np.ndarray]:
    raw = pa.decompress(blob[4:], decompressed_size=struct.unpack("<I", blob[:4])[0], codec="zstd", asbytes=True)
    at, shapes = 1, []
    for _ in range(raw[0]):
        end = at + 1 + raw[at]
        shapes.append((raw[at + 1 : end].decode(), np.dtype(raw[end : end + 3].decode().strip()), struct.unpack_from("<I", raw, end + 3)[0]))
        at = end + 7
    out = {}
    for name, kind, n in shapes:
        size = n * kind.itemsize
        out[name] = np.ascontiguousarray(np.frombuffer(raw, np.uint8, size, at).reshape(kind.itemsize, n).T).reshape(-1).view(kind)
        at += size
    return out


_ROW = "block bigint, shard int, blob binary"


def _row(block: int, shard: int, blob: bytes) -> pa.RecordBatch:
    return pa.record_batch([pa.array([block], pa.int64()), pa.array([shard], pa.int32()), pa.array([blob], pa.binary())], names=["block", "shard", "blob"])


def _spread(x: np.ndarray, n: int) -> np.ndarray:
    return ((mix(x) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def hot_words(docs: DataFrame) -> np.ndarray:
    """Hashes of the words that a sample of the documents says have more than HOT_TOKENS tokens, sorted. The list only
    decides where work is done. A word of so many is one of at most tokens / HOT_TOKENS, one for each megabyte of text
    or two; frequencies being what they are, far fewer."""
    some = docs.where(F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.xxhash64("text"))), F.lit(SAMPLED)) == 0).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def joined() -> tuple[np.ndarray, np.ndarray]:
            own, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            return own, np.bincount(at, weights=np.concatenate([h[1] for h in held])).astype(np.int64)

        for batch in batches:
            for a, b in slices(batch.column(0)):
                words, _ = word_hashes([(t or "").encode() for t in batch.column(0).slice(a, b - a).to_pylist()])
                held.append(np.unique(words, return_counts=True))
                if len(held) >= 16:
                    held = [joined()]
        if held:
            own, n = joined()
            often = n > 1
            yield pa.record_batch([pa.array(own[often].view(np.int64)), pa.array(n[often])], names=["word", "n"])

    counted = map_arrow(some, run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    found = [r["word"] for r in counted.where(F.col("n") > HOT_TOKENS // SAMPLED).collect()]
    return np.sort(np.array(found, np.int64).view(np.uint64))


def _blocks(docs: DataFrame, shards: int, part: str, hot: np.ndarray) -> DataFrame:
    """For each block, by `part`: "pairs", a row for each shard with the block's distinct pairs of its words; or
    "docs", a row (shard -1) with its documents as sequences of pair numbers. Blocks follow the partitions of docs."""

    def owners(words: np.ndarray, classes: np.ndarray) -> np.ndarray:
        out = _spread(words, shards)
        if len(hot):
            dealt = hot[np.minimum(np.searchsorted(hot, words), len(hot) - 1)] == words
            out[dealt] = _spread(words[dealt] + classes[dealt].astype(np.uint64), shards)
        return out

    def pairs_of(block: int, words: np.ndarray, classes: np.ndarray, trained: np.ndarray) -> Iterator[pa.RecordBatch]:
        owner = owners(words, classes)
        order = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(shards + 1))
        for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            if a < b:
                own = order[a:b]
                mine = words[own]
                fresh = np.concatenate(([True], mine[1:] != mine[:-1]))
                sizes = np.diff(np.concatenate((np.flatnonzero(fresh), [b - a])))
                yield _row(block, s, _pack(words=np.diff(mine[fresh], prepend=np.uint64(0)), sizes=sizes.astype(np.uint32), classes=classes[own], trained=trained[own]))

    def flush(block: int, ids: list, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        parts = [pair_keys(texts[a : a + 512]) for a in range(0, len(texts), 512)]
        words, classes, counts = (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([np.diff(p[2]) for p in parts]))
        held = np.array([is_held_out(i) for i in ids])
        own, kinds, place = distinct_pairs(words, classes)
        del parts, words, classes
        if part == "pairs":
            yield from pairs_of(block, own, kinds, np.bincount(place[np.repeat(~held, counts)], minlength=len(own)).astype(np.uint32))
        else:
            # Replies come shard by shard: a pair's number is its place in that order.
            order = np.argsort(owners(own, kinds), kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order))
            null = np.array([i is None for i in ids], np.uint8)
            ids = np.array([0 if i is None else i for i in ids], np.int64)
            yield _row(block, -1, _pack(ids=ids, null=null, held=held.astype(np.uint8), counts=counts.astype(np.uint32), pairs=rank[place], check=np.array([checksum(own, kinds)])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            keys, column = batch.columns
            for a, b in slices(column):
                ids += keys.slice(a, b - a).to_pylist()
                texts += [(t or "").encode() for t in column.slice(a, b - a).to_pylist()]
                held += sum(len(t) for t in texts[len(texts) - (b - a) :])
                if held >= 6 * BLOCK_TOKENS:
                    yield from flush(block, ids, texts)
                    block, ids, texts, held = block + 1, [], [], 0
        if ids:
            yield from flush(block, ids, texts)

    return map_arrow(docs, run, _ROW)


def _shards(pairs: DataFrame, shards: int) -> DataFrame:
    """(shard, blocks, blobs), a row for each shard. Partitions grow in number with the shards, not in size."""

    def run(key, group):  # without hints, Spark takes these for a key and a table
        group = group.sort_by("block").combine_chunks()
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "blocks": pa.array([group.column("block").to_pylist()], pa.list_(pa.int64())), "blobs": pa.array([group.column("blob").to_pylist()], pa.list_(pa.binary()))})

    return pairs.repartition(shards, "shard").groupBy("shard").applyInArrow(run, "shard int, blocks array<bigint>, blobs array<binary>")


class Stirling:
    """Generalised Stirling numbers S(c, t) of a discount d, the ways to seat c customers at t tables.

    Kept as u(c, t) = S(c, t) d**t t! / (c - 1)!, which stays near 1 and obeys
    u(c + 1, t) = (d t u(c, t - 1) + (c - t d) u(c, t)) / c. Rows up to EXACT customers are all kept, beyond that
    those a twentieth apart up to LIMIT, where u hardly changes any more.
    """

    def __init__(self, discount: float):
        t = np.arange(LIMIT + 1, dtype=np.longdouble)  # seats that nearly all have tables of their own take a wide exponent
        factorial = np.concatenate(([0.0], np.cumsum(np.log(np.maximum(t[1:], 1)))))
        u = np.zeros(LIMIT + 1, np.longdouble)
        u[1] = discount
        self.customers, self.rows = [1], [np.zeros(2)]
        keep = 2
        for c in range(1, LIMIT):
            top = c + 2
            u[1:top] = (discount * t[1:top] * u[: top - 1] + (c - discount * t[1:top]) * u[1:top]) / c
            if c + 1 >= keep:
                with np.errstate(divide="ignore"):
                    self.customers.append(c + 1)
                    self.rows.append((np.log(np.maximum(u[:top], 0)) - factorial[:top]).astype(float))
                keep = c + 2 if c + 1 < EXACT else max(c + 2, int((c + 1) * 1.05))
        self.bounds = np.array(self.customers)

    def row_of(self, customers: np.ndarray) -> np.ndarray:
        """The row for so many customers: their own, or the last one below."""
        return np.searchsorted(self.bounds, customers, side="right") - 1


@lru_cache(maxsize=16)
def stirling(discount: float) -> Stirling:
    return Stirling(discount)


def seat(customers: np.ndarray, pull: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish, drawn given its customers and the weight `pull` of opening one more table: t has the
    weight S(customers, t) pull**t. Beyond LIMIT customers it is drawn from the limit law, in which t - 1 is a
    Poisson variable with mean pull / discount; that law also bounds the range of t that is looked at."""
    numbers = stirling(discount)
    out = np.minimum(customers, 1).astype(np.int64)
    rate = pull / discount
    reach = np.minimum(np.ceil(rate + 12 * np.sqrt(rate) + 24), LIMIT)
    drawn = np.flatnonzero((customers > 1) & (customers <= LIMIT))
    row = numbers.row_of(customers[drawn])
    order = np.lexsort((reach[drawn], row))
    drawn, row = drawn[order], row[order]
    cuts = np.searchsorted(row, np.arange(len(numbers.rows) + 1))
    for r in np.unique(row):
        a, logs = cuts[r], numbers.rows[r]
        while a < cuts[r + 1]:
            b = min(cuts[r + 1], a + 20_000)
            while b - a > 1 and (b - a) * min(reach[drawn[b - 1]], len(logs)) > 400_000:
                b = a + (b - a) // 2
            own = drawn[a:b]
            top = int(min(reach[own[-1]], len(logs) - 1))
            weight = logs[1 : top + 1] + np.log(rate[own])[:, None] * np.arange(1, top + 1)
            weight = np.exp(weight - weight.max(axis=1, keepdims=True)).cumsum(axis=1)
            out[own] = 1 + (weight < rng.random(len(own))[:, None] * weight[:, -1:]).sum(axis=1)
            a = b
    large = np.flatnonzero(customers > LIMIT)
    out[large] = np.minimum(1 + rng.poisson(rate[large]), customers[large])
    return out


def _discount(ones: float, twos: float) -> float:
    return round(min(max(ones / (ones + 2 * twos), 0.05), 0.95), 2) if ones + twos > 0 else 0.5


class Shard:
    """The dishes of one shard's words in every context restaurant, merged from all blocks. `hot` are the words dealt
    over all shards, of which this one has some contexts."""

    def __init__(self, blobs: list[bytes], hot: np.ndarray):
        parts = [_unpack(b) for b in blobs]
        words, self.cuts = [], [0]
        for p in parts:
            words.append(np.repeat(np.cumsum(p["words"]), p["sizes"]))
            self.cuts.append(self.cuts[-1] + len(words[-1]))
        self.parts = parts
        words, classes = np.concatenate(words), np.concatenate([p["classes"] for p in parts])
        self.checks = [checksum(words[a:b], classes[a:b]) for a, b in zip(self.cuts[:-1], self.cuts[1:])]
        own, kinds, self.number = distinct_pairs(words, classes)
        self.number = self.number.astype(np.uint32)
        del words, classes
        self.customers = np.bincount(self.number, weights=np.concatenate([p["trained"] for p in parts]), minlength=len(own)).astype(np.int64)
        self.classes = kinds
        fresh = np.concatenate(([True], own[1:] != own[:-1]))
        self.word = (np.cumsum(fresh) - 1).astype(np.int32)
        self.own_tokens = np.bincount(self.word, weights=self.customers).astype(np.int64)
        # The place of each word among the hot ones, -1 for the shard's own.
        names = own[fresh]
        at = np.minimum(np.searchsorted(hot, names), max(len(hot) - 1, 0))
        self.hot = np.where(hot[at] == names, at, -1) if len(hot) else np.full(len(names), -1)
        self.tables = np.minimum(self.customers, 1)
        self.root_tables = np.where(self.hot < 0, np.minimum(self.own_tokens, 1), 0)

    def sums(self, hot: int) -> dict[str, float | np.ndarray]:
        """What this shard adds to the global numbers; `hot` is the number of hot words."""
        arrived = self.own_arrived()
        mine, dealt = self.hot < 0, np.flatnonzero(self.hot >= 0)
        return {
            "tables": np.bincount(self.classes, weights=self.tables, minlength=CLASSES),
            "tokens": np.bincount(self.classes, weights=self.customers, minlength=CLASSES),
            "hot_arrived": np.bincount(self.hot[dealt], weights=arrived[dealt], minlength=hot),
            "hot_tokens": np.bincount(self.hot[dealt], weights=self.own_tokens[dealt], minlength=hot),
            "root_customers": float(arrived[mine].sum()),
            "root_tables": float(self.root_tables[mine].sum()),
            "words": float(np.count_nonzero(self.own_tokens[mine])),
            "ones": float(np.count_nonzero(self.customers == 1)),
            "twos": float(np.count_nonzero(self.customers == 2)),
            "root_ones": float(np.count_nonzero(arrived[mine] == 1)),
            "root_twos": float(np.count_nonzero(arrived[mine] == 2)),
        }

    def own_arrived(self) -> np.ndarray:
        """Customers of the word restaurant: each table of a context sends one."""
        return np.bincount(self.word, weights=self.tables, minlength=len(self.own_tokens)).astype(np.int64)

    def tokens(self, g: dict) -> np.ndarray:
        return _with_hot(self.own_tokens, self.hot, g["hot_tokens"])

    def word_probability(self, g: dict) -> np.ndarray:
        d, base = _discount(g["root_ones"], g["root_twos"]), (1 - UNKNOWN) / max(g["words"], 1)
        fresh = THETA_WORD + d * g["root_tables"]
        arrived, tables = _with_hot(self.own_arrived(), self.hot, g["hot_arrived"]), _with_hot(self.root_tables, self.hot, g["hot_tables"])
        return np.where(self.tokens(g) > 0, arrived - d * tables + fresh * base, fresh * UNKNOWN) / (THETA_WORD + g["root_customers"])

    def sweep(self, g: dict, rng: np.random.Generator) -> None:
        """One Gibbs sweep over this shard's dishes, contexts first, then the word restaurant; g has the numbers of the
        state it starts from. Hot words sit in the word restaurant when all shards' tables are known."""
        d = _discount(g["ones"], g["twos"])
        pull = (THETA_CONTEXT + d * g["tables"][self.classes]) * self.word_probability(g)[self.word]
        self.tables = seat(self.customers, pull, d, rng)
        arrived = np.where(self.hot < 0, self.own_arrived(), 0)
        self.root_tables = seat(arrived, np.full(len(arrived), _root_pull(g)), _discount(g["root_ones"], g["root_twos"]), rng)

    def predictive(self, g: dict) -> np.ndarray:
        """The probability of each pair's word in its context in this state, whose numbers g has."""
        d = _discount(g["ones"], g["twos"])
        back = (THETA_CONTEXT + d * g["tables"][self.classes]) * self.word_probability(g)[self.word]
        return (self.customers - d * self.tables + back) / (THETA_CONTEXT + g["tokens"][self.classes])


def _with_hot(own: np.ndarray, hot: np.ndarray, values: np.ndarray) -> np.ndarray:
    return np.where(hot < 0, own, values[np.maximum(hot, 0)]) if len(values) else own


def _root_pull(g: dict) -> float:
    return (THETA_WORD + _discount(g["root_ones"], g["root_twos"]) * g["root_tables"]) * (1 - UNKNOWN) / max(g["words"], 1)


_NUMBERS = ("root_customers", "root_tables", "words", "ones", "twos", "root_ones", "root_twos")


def add_up(parts: list[dict]) -> dict:
    """The sum of what shards give."""
    return {k: sum(p[k] for p in parts) for k in parts[0]}


def with_hot_words(total: dict, before: dict | None, seed: int, sweep: int) -> dict:
    """The shards' sums with the hot words' part in the word restaurant: all their customers are known now, and their
    tables are drawn as the sweep draws the others'."""
    arrived = total["hot_arrived"].astype(np.int64)
    rng = np.random.default_rng([seed, sweep, 1 << 20])
    tables = np.minimum(arrived, 1) if before is None else seat(arrived, np.full(len(arrived), _root_pull(before)), _discount(before["root_ones"], before["root_twos"]), rng)
    out = total | {"hot_tables": tables}
    out["root_customers"] += float(arrived.sum())
    out["root_tables"] += float(tables.sum())
    out["words"] += float(np.count_nonzero(total["hot_tokens"]))
    out["root_ones"] += float(np.count_nonzero(arrived == 1))
    out["root_twos"] += float(np.count_nonzero(arrived == 2))
    return out


def _sent(states: list[dict]) -> list[bytes]:
    """States as tasks get them, a megabyte or two each: counts as whole numbers, compressed. Contexts' tokens are the
    same in all, so only the first has them."""
    arrays = [{k: np.asarray(v, np.uint32) if k in ("tables", "tokens") else np.atleast_1d(np.asarray(v, float)) for k, v in g.items() if i == 0 or k != "tokens"} for i, g in enumerate(states)]
    return [_pack(**a) for a in arrays]


def _received(blobs: list[bytes]) -> list[dict]:
    states = [{k: float(v[0]) if k in _NUMBERS else v for k, v in _unpack(b).items()} for b in blobs]
    for g in states:
        g["tokens"] = states[0]["tokens"]
    return states


def _drawn(shard: Shard, known: list[dict], seed: int, number: int) -> Iterator[int]:
    """Draw a sweep for each state known, in every job alike; yields after each how many there were."""
    for i, g in enumerate(known):
        shard.sweep(g, np.random.default_rng([seed, number, i]))
        yield i + 1


def _totals(stored_shards: DataFrame, known: list[dict], hot: np.ndarray, seed: int) -> dict:
    """The global numbers after as many sweeps as states are known. Each task adds up its shards and sends the contexts'
    numbers in RANGES parts, which are added up side by side; 2 * CLASSES numbers, two a hot word and a few reach the
    driver, whatever the input."""
    spark = stored_shards.sparkSession
    shared = spark.sparkContext.broadcast(_sent(known))
    width = CLASSES // RANGES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict | None = None
        states = _received(shared.value)
        for batch in batches:
            for number, blobs in zip(batch.column(0).to_pylist(), batch.column(2)):
                shard = Shard(blobs.as_py(), hot)
                for _ in _drawn(shard, states, seed, number):
                    pass
                own = shard.sums(len(hot))
                total = own if total is None else add_up([total, own])
        if total is not None:
            for r in range(RANGES):
                t, c = (total[k][r * width : (r + 1) * width].astype(np.int64) for k in ("tables", "tokens"))
                at = np.flatnonzero(c).astype(np.int64)
                yield _row(0, r, _pack(at=np.diff(at, prepend=0).astype(np.uint32), tables=t[at].astype(np.uint32), tokens=c[at].astype(np.uint32)))
            yield _row(0, RANGES, _pack(hot_arrived=total["hot_arrived"], hot_tokens=total["hot_tokens"], numbers=np.array([total[n] for n in _NUMBERS])))

    def added(key, group):  # without hints, Spark takes these for a key and a table
        parts = [_unpack(b) for b in group.column("blob").to_pylist()]
        if key[0].as_py() == RANGES:
            out = add_up(parts)
        else:
            out = {k: np.zeros(width) for k in ("tables", "tokens")}
            for p in parts:
                at = np.cumsum(p["at"].astype(np.int64))
                for k in out:
                    out[k][at] += p[k]
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "blob": pa.array([_pack(**out)], pa.binary())})

    summed = {r["shard"]: _unpack(r["blob"]) for r in map_arrow(stored_shards, run, _ROW).groupBy("shard").applyInArrow(added, "shard int, blob binary").collect()}
    shared.destroy()
    total = {k: np.concatenate([summed[r][k] if r in summed else np.zeros(width) for r in range(RANGES)]) for k in ("tables", "tokens")}
    rest = summed.get(RANGES, {"hot_arrived": np.zeros(len(hot)), "hot_tokens": np.zeros(len(hot)), "numbers": np.zeros(len(_NUMBERS))})
    total |= {"hot_arrived": rest["hot_arrived"], "hot_tokens": rest["hot_tokens"]} | dict(zip(_NUMBERS, rest["numbers"].tolist()))
    return with_hot_words(total, known[-1] if known else None, seed, len(known))


def _replies(stored_shards: DataFrame, states: list[dict], hot: np.ndarray, seed: int) -> DataFrame:
    """For each block and shard: training tokens of the block's words there, and log10 probabilities of its pairs."""
    shared = stored_shards.sparkSession.sparkContext.broadcast(_sent(states))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _received(shared.value)
        for batch in batches:
            for number, blocks, blobs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                shard = Shard(blobs.as_py(), hot)
                total = np.zeros(len(shard.classes))
                for done in _drawn(shard, known[:-1], seed, number):
                    if done > BURN_IN:
                        total += shard.predictive(known[done])
                chance = np.log10(total / (len(known) - 1 - BURN_IN)).astype(np.float32)
                tokens = shard.tokens(known[0])
                for block, part, check, a, b in zip(blocks, shard.parts, shard.checks, shard.cuts[:-1], shard.cuts[1:]):
                    own = shard.number[a:b]
                    heads = np.cumsum(part["sizes"], dtype=np.int64) - part["sizes"]
                    yield _row(block, number, _pack(known=tokens[shard.word[own[heads]]].astype(np.uint32), sizes=part["sizes"], chance=chance[own], check=np.array([check])))

    return map_arrow(stored_shards, run, _ROW)


def _fixed(rows: DataFrame) -> DataFrame:
    """rows, stored unless they come straight from files: blocks are formed twice and must have the same rows."""
    plan = rows._jdf.queryExecution().executedPlan().toString()
    straight = "FileScan" in plan and not any(x in plan for x in ("Exchange", "Python", "Arrow", "rand", "uuid", "Limit", "Sample"))
    return rows if straight else stored(rows, "rows")


_SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def language_model_scores(docs: DataFrame, *, key: str = "doc_id", text: str = "text", seed: int = 5) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of docs.

    The model learns from the rows that are not held out and scores all. A null text counts as empty and has its
    end as its only token; rows with a null id train. Repeated rows each count. Without training rows every word
    is unknown. base_score is that of an add-one unigram model. Equal input gives equal scores as long as it is
    read in the same partitions.

    Words are told apart by 64 bits of a hash: of n different words about n**2 / 2**65 share one. Input that does not
    come straight from files is stored first, so that it is the same each time it is read.
    """
    rows = _fixed(docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text")))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, ceil(size / SHARD_BYTES))
    hot = hot_words(rows) if shards > 1 else np.zeros(0, np.uint64)
    known_pairs = stored(_shards(_blocks(rows, shards, "pairs", hot), shards), "shards")
    states: list[dict] = []
    for _ in range(1 + BURN_IN + KEPT):
        states.append(_totals(known_pairs, states, hot, seed))
    train_tokens, words = int(states[0]["tokens"].sum()), int(states[0]["words"])

    def run(key, group):
        group = group.sort_by("shard")
        found = [_unpack(b) for b in group.column("blob").to_pylist()]
        docs, replies = found[0], found[1:]
        if "ids" not in docs or np.array([r["check"][0] for r in replies], np.uint64).sum(dtype=np.uint64) != docs["check"][0]:
            raise RuntimeError("the input was not the same the second time it was read")
        known = np.concatenate([np.repeat(r["known"], r["sizes"]) for r in replies])
        chance = np.concatenate([r["chance"] for r in replies])
        base = np.log10((known + 1.0) / (train_tokens + words + 1.0))
        starts = np.cumsum(docs["counts"], dtype=np.int64) - docs["counts"]
        sums = [np.add.reduceat(v[docs["pairs"]], starts) for v in (base, chance.astype(float), (known > 0).astype(np.int64))]
        n = len(starts)
        return pa.table({
            "doc_id": pa.array(docs["ids"], pa.int64(), mask=docs["null"].astype(bool)),
            "held_out": pa.array(docs["held"].astype(bool)),
            "n_tokens": pa.array(docs["counts"].astype(np.int64)),
            "n_known": pa.array(sums[2]),
            "train_tokens": pa.array(np.full(n, train_tokens), pa.int64()),
            "base_score": pa.array(sums[0]),
            "score": pa.array(sums[1]),
        })

    together = _blocks(rows, shards, "docs", hot).unionByName(_replies(known_pairs, states, hot, seed))
    return together.repartition(shards, "block").groupBy("block").applyInArrow(run, _SCORES)
