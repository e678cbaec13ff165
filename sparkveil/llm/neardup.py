"""Near-duplicate documents by MinHash, banding and Odd sketches, confirmed on full shingle sets.

1. Each text's set of distinct k-word shingles is sampled by MinHash. The samples give band keys and are folded
   into an Odd sketch: one bit per hashed sample, flipped each time, so that the population count of the XOR of two
   sketches estimates how many samples differ, most precisely where similarity is high.
2. Texts with equal sets become one class at once; only one member goes on.
3. Classes that share a band key meet in cells of bounded size (a large bucket is split into chunks and each pair
   of chunks is a cell). Sketches decide which pairs stay, and a cell gives back a spanning forest of those, so
   its output grows with its rows. The forest's components are candidate clusters.
4. Each member of a cluster meets the cluster's least member: exact intersections of full sets, told apart by the
   words' bytes, confirm links. A cluster in which all are confirmed is done, whatever its size. The others meet in
   cells, each pair of texts once, and a spanning forest of confirmed links leaves each cell. The components of all
   links, with the classes, are the result.

With BANDS bands of ROWS samples, a pair at the threshold shares no band with a chance of (1 - t**ROWS)**BANDS,
2.5e-7 at 0.75 and less above. The sketch bound is set so that a pair at the threshold fails it with a chance
under SKETCH_MISS. Sets count as equal in step 2 by their size and two sums of 64-bit hashes; links are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkveil.llm._common import join_by_count, map_arrow, released, slices, stored
from sparkveil.llm._words import mix, shingle_hashes, shingle_numbers, word_hashes, word_numbers

SHINGLE_WORDS = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
BANDS, ROWS = 40, 4
SAMPLES = BANDS * ROWS
SKETCH_BITS, SKETCH_MISS = 512, 1e-7
#: Rows of a chunk; a cell holds two at most. Cells with texts are smaller.
SKETCH_CHUNK, TEXT_CHUNK = 1024, 384

_rng = np.random.default_rng(20240229)
_FACTORS = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=4)
def sketch_limit(percent: int = PERCENT) -> int:
    """The most bits in which the sketches of a pair at the threshold differ, but for a chance of SKETCH_MISS.

    A binomial number of the SAMPLES samples differs and each such sample flips two bits of the XOR; the number of
    odd bits after so many flips is a Markov chain, whose distribution is worked out flip by flip.
    """
    miss = 1 - percent / 100
    odd = np.zeros(SKETCH_BITS + 2)
    odd[0], total = 1.0, np.zeros(SKETCH_BITS + 2)
    up = 1 - np.arange(SKETCH_BITS + 2) / SKETCH_BITS
    for d in range(SAMPLES + 1):
        total += comb(SAMPLES, d) * miss**d * (1 - miss) ** (SAMPLES - d) * odd
        for _ in range(2):
            odd = np.concatenate(([0.0], (odd * up)[:-1])) + np.concatenate(((odd * (1 - up))[1:], [0.0]))
    beyond = np.cumsum(total[::-1])[::-1]
    return int(np.argmax(beyond <= SKETCH_MISS)) - 1


def sets_of(texts: list[bytes], k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and their bounds."""
    return shingle_hashes(*word_hashes(texts), k)


def samples_of(keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """MinHash samples, one row for each set; rows of empty sets are meaningless."""
    full = np.flatnonzero(np.diff(bounds) > 0)
    out = np.zeros((len(bounds) - 1, SAMPLES), np.uint64)
    if len(full):
        starts = bounds[full]
        for i, factor in enumerate(_FACTORS):
            out[full, i] = np.minimum.reduceat(keys * factor, starts)
    return out


def sketches_of(samples: np.ndarray) -> np.ndarray:
    """Odd sketches: SKETCH_BITS bits of each row of samples, packed."""
    bits = np.zeros((len(samples), SKETCH_BITS), np.uint8)
    rows = np.arange(len(samples))
    for i in range(samples.shape[1]):
        bits[rows, (mix(samples[:, i] + np.uint64(i)) % np.uint64(SKETCH_BITS)).astype(np.int64)] ^= 1
    return np.packbits(bits, axis=1)


def bands_of(samples: np.ndarray) -> np.ndarray:
    """A 64-bit key for each row and band."""
    out = np.empty((len(samples), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(samples), b + 1, np.uint64)
        for r in range(ROWS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + samples[:, b * ROWS + r])
        out[:, b] = key
    return out


def signatures(docs: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, bands, sketch) of each row; set_a and set_b are sums of two hashes over
    the set, equal for equal sets. An empty set has no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.columns
            for a, b in slices(column):
                keys, bounds = sets_of([(t or "").encode() for t in column.slice(a, b - a).to_pylist()], k)
                counts, samples = np.diff(bounds), samples_of(keys, bounds)
                sums = []
                for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
                    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(keys ^ np.uint64(salt)), dtype=np.uint64)))
                    sums.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
                held = np.where(counts > 0, BANDS, 0)
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(held))).astype(np.int32)), pa.array(bands_of(samples)[counts > 0].ravel().view(np.int64)))
                raw = sketches_of(samples).tobytes()
                width = SKETCH_BITS // 8
                sketch = pa.array([raw[i : i + width] for i in range(0, len(raw), width)], pa.binary())
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(counts.astype(np.int64)), *(pa.array(s) for s in sums), bands, sketch], names=["doc_id", "n_shingles", "set_a", "set_b", "bands", "sketch"])

    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return map_arrow(rows, run, "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>, sketch binary")


def by_group(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """fn on each group of rows with equal keys. Groups lie side by side in sorted partitions, so small ones cost
    no call of their own to Spark; every group here is bounded by the size of a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            at = pa.Table.from_batches([batch])
            at = at if rest is None else pa.concat_tables([rest, at]).combine_chunks()
            cuts = _cuts(at, keys)
            for a, b in zip(cuts[:-2], cuts[1:-1]):
                yield from fn(at.slice(a, b - a)).to_batches()
            rest = at.slice(cuts[-2]) if len(cuts) > 1 else None
        if rest is not None and rest.num_rows:
            yield from fn(rest).to_batches()

    return map_arrow(df.repartition(*keys).sortWithinPartitions(*keys), run, schema)


def _cuts(at: pa.Table, keys: list[str]) -> np.ndarray:
    if not at.num_rows:
        return np.zeros(1, np.int64)
    fresh = np.zeros(at.num_rows, bool)
    fresh[0] = True
    for key in keys:
        values = at.column(key).to_numpy()
        fresh[1:] |= values[1:] != values[:-1]
    return np.concatenate((np.flatnonzero(fresh), [at.num_rows]))


def in_cells(rows: DataFrame, group: str, n: Column, node: str, chunk: int) -> DataFrame:
    """Rows with the cell (group, cell_i, cell_j) of each pair of chunks that has theirs; `own` is the row's chunk.
    A group of up to chunk rows is one cell."""
    chunks = F.ceil(n / chunk).cast("int")
    at = rows.withColumn("chunks", chunks).withColumn("own", F.pmod(F.xxhash64(node, F.lit(7)), F.col("chunks")).cast("int"))
    at = at.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return at.withColumn("cell_i", F.least("own", "other")).withColumn("cell_j", F.greatest("own", "other")).drop("chunks", "other")


def forest(links: np.ndarray) -> np.ndarray:
    """For a symmetric matrix of links, the least index each index reaches."""
    n = len(links)
    label = np.arange(n)
    while True:
        near = np.where(links, label[None, :], n).min(axis=1, initial=n)
        new = np.minimum(label, near)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _star(nodes: np.ndarray, label: np.ndarray) -> pa.Table:
    own = nodes[label] != nodes
    a, b = nodes[own], nodes[label[own]]
    return pa.table({"a": pa.array(np.maximum(a, b), pa.int64()), "b": pa.array(np.minimum(a, b), pa.int64())})


def _sketch_cell(cell: pa.Table) -> pa.Table:
    nodes, sizes = cell.column("node").to_numpy(), cell.column("n_shingles").to_numpy()
    own = cell.column("own").to_numpy()
    words = np.frombuffer(b"".join(cell.column("sketch").to_pylist()), np.uint64).reshape(len(nodes), -1)
    limit = sketch_limit()
    links = np.zeros((len(nodes), len(nodes)), bool)
    across = cell.column("cell_i")[0].as_py() != cell.column("cell_j")[0].as_py()
    for i in range(len(nodes)):
        differ = np.bitwise_count(words ^ words[i]).sum(axis=1, dtype=np.int32)
        near = (differ <= limit) & (100 * np.minimum(sizes, sizes[i]) >= PERCENT * np.maximum(sizes, sizes[i]))
        if across:
            near &= own != own[i]
        links[i] = near
    np.fill_diagonal(links, False)
    return _star(nodes, forest(links))


def exact_links(keys: np.ndarray, bounds: np.ndarray, allowed: np.ndarray | None = None) -> np.ndarray:
    """Which pairs of sets have 100 * intersection >= PERCENT * union, as a symmetric matrix. Sets whose sizes
    alone rule a link out are not compared; counts of shared elements come from products of 0-1 matrices."""
    sizes = np.diff(bounds)
    n = len(sizes)
    need = (100 * np.minimum(sizes[:, None], sizes) >= PERCENT * np.maximum(sizes[:, None], sizes)) & (sizes[:, None] > 0) & (sizes > 0)
    np.fill_diagonal(need, False)
    if allowed is not None:
        need &= allowed
    shared = np.zeros((n, n), np.float32)
    if np.count_nonzero(need) <= 8 * n + 64:
        for i, j in zip(*np.nonzero(np.triu(need))):
            both = np.concatenate((keys[bounds[i] : bounds[i + 1]], keys[bounds[j] : bounds[j + 1]]))
            both.sort()
            shared[i, j] = shared[j, i] = np.count_nonzero(both[1:] == both[:-1])
    else:
        owner = np.repeat(np.arange(n), sizes)
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        fresh = np.ones(len(ranked), bool)
        fresh[1:] = ranked[1:] != ranked[:-1]
        column = np.cumsum(fresh) - 1
        common = np.bincount(column) > 1
        place = np.cumsum(common) - 1
        used = common[column]
        column, owners = place[column[used]], owner[order][used]
        width = 4096
        starts = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + width, width))
        for block, (a, b) in enumerate(zip(starts[:-1], starts[1:])):
            ones = np.zeros((n, width), np.float32)
            ones[owners[a:b], column[a:b] - block * width] = 1
            shared += ones @ ones.T
    union = sizes[:, None] + sizes - shared
    return need & (100 * shared >= PERCENT * union)


def exact_sets(texts: list[str | None], k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of each text as numbers, equal for equal words in all texts given, and their bounds."""
    return shingle_numbers(*word_numbers([(t or "").encode() for t in texts]), k)


def _hub_cell(cell: pa.Table) -> pa.Table:
    """The links of a cell's texts to those of its hub."""
    nodes, hub = cell.column("node").to_numpy(), cell.column("component")[0].as_py()
    keys, bounds = exact_sets(cell.column("text").to_pylist())
    first = nodes == hub
    links = exact_links(keys, bounds, first[:, None] != first)
    linked = nodes[links[first].any(axis=0)]
    return pa.table({"a": pa.array(linked, pa.int64()), "b": pa.array(np.full(len(linked), hub), pa.int64())})


def _text_cell(cell: pa.Table) -> pa.Table:
    nodes, own = cell.column("node").to_numpy(), cell.column("own").to_numpy()
    keys, bounds = exact_sets(cell.column("text").to_pylist())
    across = cell.column("cell_i")[0].as_py() != cell.column("cell_j")[0].as_py()
    return _star(nodes, forest(exact_links(keys, bounds, own[:, None] != own if across else None)))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of the edges (a, b) reaches, itself included.

    Large-star and small-star rounds, each stored until the next one is. A round joins edges to the least neighbour
    of their ends; ends with many edges are joined by broadcast, so no task gets all edges of a hub. The number of
    rounds is logarithmic in the longest chain. No edges give no rows.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = join_by_count(both, least, ["u"], "n", 2 * mark[0]).where("v > u AND v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        below = large.groupBy("a").agg(F.min("b").alias("m"))
        # A node has as many edges here as components met in it so far: no hubs are left on this side.
        small = large.join(below, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(below.select("a", F.col("m").alias("b"))).distinct()
        before, now = now, stored(small, "edges")
        released(before)
        new = _mark(now)
        if new == mark:
            break
        mark = new
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1]


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of docs: component_id is the smallest id reachable by
    links, the row's own included; kept marks the row that has it.

    A null or wordless text has an empty set, links with nothing and is kept. A row with a null id is never
    linked: component_id is null and kept true. Repeated rows come back as often as they came and are all kept or
    all not; rows that share an id are one document, linked by any of its texts.
    """
    found = stored(signatures(docs, key=key, text=text), "signatures")
    linked = found.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stored(linked.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("node"), F.count("*").alias("members")), "classes")
    # What is joined here grows with the input and has a row a key on one side at least: merge joins, which spill and
    # hold no table in memory, where sizes guessed before the run might choose a broadcast or a hash table.
    ones = linked.join(classes.select("set_a", "set_b", F.col("node").alias("doc_id")).hint("merge"), ["set_a", "set_b", "doc_id"], "left_semi")
    ones = stored(ones.select(F.col("doc_id").alias("node"), "n_shingles", "bands", "sketch"), "nodes")

    entries = ones.select("node", F.explode("bands").alias("band"))
    buckets = entries.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.bit_xor(F.xxhash64("node")).alias("who")).where("lo < hi")
    # Buckets of the same members say the same; one of them is enough.
    buckets = stored(buckets.groupBy("n", "lo", "hi", "who").agg(F.min("band").alias("band")), "buckets")

    sketch = ones.select("node", "n_shingles", "sketch")
    left, right = (sketch.select(F.col("node").alias(n), F.col("n_shingles").alias(f"size_{n}"), F.col("sketch").alias(f"sketch_{n}")) for n in ("lo", "hi"))
    pairs = buckets.where("n = 2").select("lo", "hi").distinct().join(left, "lo").join(right, "hi")
    differ = sum((F.bit_count(_long(F.col("sketch_lo"), i).bitwiseXOR(_long(F.col("sketch_hi"), i))) for i in range(SKETCH_BITS // 64)), F.lit(0))
    small = pairs.where((100 * F.least("size_lo", "size_hi") >= PERCENT * F.greatest("size_lo", "size_hi")) & (differ <= sketch_limit())).select(F.col("hi").alias("a"), F.col("lo").alias("b"))

    # A band that a large group of near copies shares has all of them: such buckets are joined where the rows are.
    full = buckets.where("n > 2").select("band", "n", F.col("n").alias("rows"))
    many = join_by_count(entries, full, ["band"], "rows", BANDS * ones.count()).join(sketch.hint("merge"), "node")
    cells = in_cells(many, "band", F.col("n"), "node", SKETCH_CHUNK)
    large = by_group(cells.select("band", "cell_i", "cell_j", "own", "node", "n_shingles", "sketch"), ["band", "cell_i", "cell_j"], _sketch_cell, "a bigint, b bigint")

    clusters = stored(components(small.unionAll(large)), "clusters")
    sizes = clusters.groupBy("component").agg(F.count("*").alias("n"))
    members = stored(clusters.join(sizes, "component"), "members")
    released(clusters, buckets, ones)
    texts = docs.select(F.col(f"`{key}`").cast("bigint").alias("node"), F.col(f"`{text}`").alias("text"))

    # The hub stands in each of its cells, beside the members that a hash deals there.
    last = F.ceil(F.col("n") / TEXT_CHUNK).cast("int") - 1
    cells_of = F.when(F.col("node") == F.col("component"), F.sequence(F.lit(0), last)).otherwise(F.array(F.pmod(F.xxhash64("node", F.lit(11)), last + 1).cast("int")))
    hubs = texts.join(members.hint("merge"), "node").withColumn("cell", F.explode(cells_of))
    star = stored(by_group(hubs.select("component", "cell", "node", "text"), ["component", "cell"], _hub_cell, "a bigint, b bigint").distinct(), "star")
    whole = star.groupBy("b").agg(F.count("*").alias("linked"))
    open_ = members.where("node = component").join(whole, F.col("component") == F.col("b"), "left").where("coalesce(linked, 0) < n - 1").select("component")
    left_over = members.join(open_.hint("merge"), "component", "left_semi")
    with_text = in_cells(texts.join(left_over.hint("merge"), "node"), "component", F.col("n"), "node", TEXT_CHUNK)
    links = by_group(with_text.select("component", "cell_i", "cell_j", "own", "node", "text"), ["component", "cell_i", "cell_j"], _text_cell, "a bigint, b bigint")

    # An id that stands for several sets joins the classes of all of them.
    several = linked.groupBy("doc_id").agg(F.min("set_a").alias("lo"), F.max("set_a").alias("hi")).where("lo < hi").select("doc_id")
    shared = linked.select("doc_id", "set_a", "set_b", "n_shingles").join(several.hint("merge"), "doc_id", "left_semi").join(classes.hint("merge"), ["set_a", "set_b", "n_shingles"]).select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    joined = stored(components(star.unionAll(links).unionAll(shared)), "joined")
    released(members, star)

    known = classes.join(joined.hint("merge"), "node", "left").where("members > 1 OR component IS NOT NULL")
    known = stored(known.select("set_a", "set_b", "n_shingles", F.coalesce("component", "node").alias("component"), "members"), "known")
    total = known.agg(F.sum("members")).first()[0] or 0
    rows = found.select("doc_id", "n_shingles", "set_a", "set_b")
    empty = rows.where("n_shingles = 0").withColumn("component", F.lit(None).cast("bigint"))
    out = join_by_count(rows.where("n_shingles > 0"), known, ["set_a", "set_b", "n_shingles"], "members", total, "left").unionByName(empty)
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _long(sketch: Column, i: int) -> Column:
    """The i-th eight bytes of a sketch as a signed integer."""
    return F.conv(F.hex(F.substring(sketch, 8 * i + 1, 8)), 16, -10).cast("bigint")
