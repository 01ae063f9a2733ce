"""Near-duplicates by Jaccard similarity of word shingles: ball hashing and MinHash bands, verified on the sets.

Each distinct set of shingles is a node with the fingerprint of simhash.py over its hashes. Nodes whose
fingerprints meet by ball hashing within RADIUS bits are candidate pairs, verified like all others. Two nodes
that agree in all ROWS values of one of BANDS bands are a candidate pair too; a pair of similarity 0.8 is none with a chance of 1 in 30,000, and a
more similar one far less often. Every link is verified on the whole sets of hashes. In a first
round every node meets the least one of each of its band values, so a large group of near copies
costs as many pairs as it has members. Band values whose nodes the links of that round leave in
different components are open: there all nodes of different components are compared, in pairs of
blocks of bounded size, each pair of blocks a group of its own that gives a spanning forest of
the links found and never a row for each pair.

Fingerprints alone do not reach the similarity: their balls join three of 64 bits, and two texts of a
Jaccard similarity of 0.8 differ in ten on average. The bands reach it, and both kinds of links count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import id_and_text, materialize, row_keys, slices
from folioflow.llm.graph import connected_components
from folioflow.llm.simhash import SEED, links as ball_links, majority, shingle_hashes

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 4
#: Bits in which fingerprints that meet may differ.
RADIUS = 3
#: Hashes for which all values are computed at a time.
CHUNK = 1 << 13
#: Bounds of a block: sets, and hashes in all of them (but for a single larger set).
BLOCK_SETS, BLOCK_HASHES = 512, 1 << 20
_KEYS = np.random.default_rng(SEED)
_FACTORS = _KEYS.integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _KEYS.integers(0, 2**63, BANDS * ROWS, np.uint64)


def bands(hashes: np.ndarray) -> np.ndarray:
    """One value a band of a set of hashes that is not empty."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), CHUNK):
        part = hashes[i : i + CHUNK, None] ^ _SHIFTS
        part *= _FACTORS
        least = np.minimum(least, part.min(axis=0))
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), b) for b, r in enumerate(rows)], np.uint64)


def _sketches(docs: DataFrame, shingle: int, whole: bool) -> DataFrame:
    """Rows (k1, k2, id, node, fp, size, values) from (k1, k2, id, text): values are the hashes of the whole
    set or those of its bands, fp the bits of its fingerprint. node is a hash of the set, that of the empty set is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            sets = [np.unique(shingle_hashes(t, shingle)) for t in b.column("text").cast(pa.binary()).to_pylist()]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) if len(s) else 0 for s in sets], np.uint64)
            values = [(s if whole or not len(s) else bands(s)).view(np.int64) for s in sets]
            fps = np.array([0 if whole else majority(s) for s in sets], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(nodes.view(np.int64)), pa.array(fps.view(np.int64)), pa.array([len(s) for s in sets], pa.int32()), pa.array(values, pa.list_(pa.int64()))], ["k1", "k2", "id", "node", "fp", "size", "values"])

    return docs.mapInArrow(run, "k1 long, k2 long, id long, node long, fp long, size int, values array<long>")


def _ball_pairs(nodes: DataFrame) -> DataFrame:
    """Candidate pairs (u, v) of nodes(node, fp, size) by ball hashing: of each fingerprint the nodes meet the least of
    them, and those of fingerprints within RADIUS bits, which simhash.links gives, meet each other."""
    least = materialize(nodes.groupBy("fp").agg(F.min(F.struct("node", "size")).alias("hub")), "fingerprints")
    same = nodes.join(least, "fp").where(F.col("node") != F.col("hub.node")).select("hub", F.struct("node", "size").alias("own"))
    met = materialize(ball_links(least.select("fp"), RADIUS).distinct(), "balls")
    other = met.join(least.select(F.col("fp").alias("u"), "hub"), "u").join(least.select(F.col("fp").alias("v"), F.col("hub").alias("own")), "v").select("hub", "own")
    return same.unionAll(other).select(F.col("hub.node").alias("u"), F.col("own.node").alias("v"), F.col("hub.size").alias("a"), F.col("own.size").alias("b"))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) of at least the similarity."""
    left = sets.select(F.col("node").alias("u"), F.col("hashes").alias("a"))
    right = sets.select(F.col("node").alias("v"), F.col("hashes").alias("b"))
    common = F.size(F.array_intersect("a", "b"))
    both = pairs.join(left, "u").join(right, "v")
    return both.where(common >= F.lit(similarity) * (F.size("a") + F.size("b") - common)).select("u", "v")


def forest(nodes: np.ndarray, roots: np.ndarray, sides: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links of at least the similarity between sets of different roots, no more than join the roots
    that any such links join. Where sides differ, only sets of different sides are compared."""
    n, sizes = len(nodes), np.diff(offsets)
    _, at = np.unique(hashes, return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(at, kind="stable")
    held, begin = owner[order], np.concatenate(([0], np.cumsum(np.bincount(at))))
    both = sides.min() != sides.max()
    known = {r: r for r in roots.tolist()}

    def find(r: int) -> int:
        while known[r] != r:
            known[r] = known[known[r]]
            r = known[r]
        return r

    links = []
    for i in range(n):
        if both and sides[i] != sides.min():
            continue
        own = at[offsets[i] : offsets[i + 1]]
        lens = begin[own + 1] - begin[own]
        ends = np.cumsum(lens)
        met = held[np.repeat(begin[own] - (ends - lens), lens) + np.arange(ends[-1])] if len(own) else held[:0]
        common = np.bincount(met, minlength=n)
        near = (common >= similarity * (sizes[i] + sizes - common)) & (roots != roots[i])
        near &= sides != sides[i] if both else np.arange(n) > i
        for j in np.flatnonzero(near):
            a, b = find(int(roots[i])), find(int(roots[j]))
            if a != b:
                known[max(a, b)] = min(a, b)
                links.append((int(nodes[i]), int(nodes[j])))
    return links


def _compared(rooted: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) between nodes of rooted(key, node, size, root) that share a key but no root."""
    wide = F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum(F.col("size").cast("long")) / BLOCK_HASHES)).cast("int")
    blocks = materialize(rooted.groupBy("key").agg(wide.alias("blocks")), "blocks")
    placed = rooted.join(blocks, "key").withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.join(sets, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("key", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", "node", "root", "hashes")
    dealt = placed.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []

        def groups(t: pa.Table, last: bool) -> Iterator[tuple]:
            """The groups of a table but for an open one; leaves that in rest."""
            key, lo, hi = (t[c].to_numpy() for c in ("key", "lo", "hi"))
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
            edges = [0, *cuts.tolist(), *([t.num_rows] if last else [])]
            rest[:] = [] if last else t.slice(edges[-1]).to_batches()
            for a, z in zip(edges, edges[1:], strict=False):
                if z - a > 1:
                    part = t.slice(a, z - a).combine_chunks()
                    lists = part["hashes"].combine_chunks()
                    offsets = np.concatenate(([0], np.cumsum(np.diff(lists.offsets.to_numpy()))))
                    yield part["node"].to_numpy(), part["root"].to_numpy(), part["side"].to_numpy(), offsets, lists.flatten().to_numpy()

        def links(last: bool) -> pa.RecordBatch:
            found = [x for g in groups(pa.Table.from_batches(rest), last) for x in forest(*g, similarity)]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["u", "v"])

        for b in batches:
            rest.append(b)
            yield links(False)
        if rest:
            yield links(True)

    return dealt.mapInArrow(run, "u long, v long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row (id, component, kept, k1, k2) for each row of docs; component is the smallest id reachable.

    kept: whether the row is the first of its component, by id (nulls last) and then by its keys
    (common.row_keys), which equal rows share. Words and shingles are those of
    simhash.near_duplicates. Texts without a word are copies of each other. A null id never becomes
    a component's id unless all its ids are null. Other columns of docs are not read. An empty
    table gives no rows.
    """
    text = id_and_text(docs, id_col, text_col).select(*row_keys("id", "text"), "id", "text")
    each = materialize(_sketches(text, shingle, False), "sketches")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2")).alias("least")
    own = materialize(each.groupBy("node").agg(first, F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("values").alias("bands")), "nodes")
    # A band's number is part of its hash.
    rows = own.select("node", "size", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.min(F.struct("node", "size")).alias("hub"), F.count("*").alias("n")).where("n > 1").select("key", "hub")
    met = materialize(rows.join(materialize(shared, "shared-bands"), "key"), "bands")
    # Sets of very different size cannot be similar.
    alike = lambda a, b: F.least(a, b) >= F.lit(similarity) * F.greatest(a, b)
    balls = materialize(_ball_pairs(own.where("size > 0").select("node", "fp", "size")).where(alike("a", "b")).select("u", "v"), "ball-pairs")
    banded = met.where((F.col("node") != F.col("hub.node")) & alike("size", "hub.size")).select(F.col("hub.node").alias("u"), F.col("node").alias("v"))
    pairs = materialize(balls.unionAll(banded).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "pairs")
    # Only sets that some other meets are compared. They are made again from one text each: to
    # write the sets of all texts would take more room than the texts.
    some = met.select("node").unionAll(balls.select(F.explode(F.array("u", "v")).alias("node"))).distinct()
    wanted = materialize(own.join(some, "node", "left_semi").select("least.k1", "least.k2"), "met-nodes")
    sets = _sketches(text.join(wanted.hint("shuffle_hash"), ["k1", "k2"], "left_semi"), shingle, True)
    sets = materialize(sets.select("node", F.col("values").alias("hashes")).dropDuplicates(["node"]), "met-sets")
    links = materialize(_verified(pairs, sets, similarity), "links-first")
    roots = connected_components(links)
    rooted = met.select("key", "node", "size").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # Band values whose nodes are all in one component have nothing left to compare.
    open_ = rooted.groupBy("key").agg((F.min("root") != F.max("root")).alias("open")).where("open").select("key")
    rooted = materialize(rooted.join(open_, "key"), "open-bands")
    links = links.unionAll(materialize(_compared(rooted, sets, similarity), "links-second"))
    roots = connected_components(links)
    rooted = materialize(own.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), "rooted")
    heads = rooted.groupBy("root").agg(F.min("least").alias("head"))
    by_node = rooted.join(heads, "root").select("node", "head")
    kept = (F.col("k1") == F.col("head.k1")) & (F.col("k2") == F.col("head.k2"))
    return each.select("id", "k1", "k2", "node").join(by_node, "node").select("id", F.col("head.id").alias("component"), kept.alias("kept"), "k1", "k2")


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of docs for each component of near_copies, with all its columns: the kept one.

    Of rows with the same id and text one stays, whatever their other columns hold. Rows that
    share an id but not a text are judged by themselves, as are rows with a null id.
    """
    found = materialize(near_copies(docs, id_col, text_col, shingle, similarity).select("k1", "k2", "kept"), "components")
    gone = materialize(found.where("not kept").select("k1", "k2").distinct(), "copies")
    twice = materialize(found.where("kept").groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1").select("k1", "k2"), "repeats")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rest = docs.select(row, *row_keys(id_col, text_col)).join(gone.hint("shuffle_hash"), ["k1", "k2"], "left_anti")
    if not twice.isEmpty():
        again = rest.join(twice, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
        rest = rest.join(twice, ["k1", "k2"], "left_anti").unionAll(again)
    return rest.select("row.*")
