"""Substring dedup: a De Bruijn graph over word windows, compacted, and spans verified at their places.

Edges are k-mers of words (k = the window, 20), nodes the (k-1)-mers between them. Of the graph
only edges that repeat matter, so these are found first, in partitions by minimizer:

1. Each edge belongs to its minimizer, the 6-word sub-sequence with the least hash. Consecutive
   edges of a document with the same minimizer occurrence are one path and travel as one row:
   (minimizer hash, hash of all its words, id, place). Equal edges have equal minimizers, so no
   repeat is missed, and a minimizer that occurs once ends there. Within an Arrow batch only the
   first copy of a path is compared with others; its later copies are known repeats.
2. A path that occurs again is one long edge of the graph. Where different paths share a
   minimizer, one occurrence of each is also cut into its edges, which meet by two 64-bit hashes.
3. Every distinct repeated edge, long or single, has its two nodes. A node with one edge in and
   one out does not branch: its edges are linked. Links between edges whose first occurrences are
   neighbours in one document are followed there; the others by joins that double the distance
   each round. So every edge gets its unbranched path and its offset there.
4. Later occurrences of the edges of one path that lie end to end in a document are one span.
   A span goes back to its document by its coordinates, with a checksum of the words at the
   coordinates of the first occurrence, and is cut only where the document's own words agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.common import build_side, documents, materialize, release, row_ids, slices, split_join
from folioflow.llm.mph import mix

MINIMIZER = 6
_C1, _C2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Bits of a word's place in a chunk; the rest of a 64-bit key holds the sub-sequence's hash.
_PLACE = 24
_CHUNK_BYTES = 4 << 20


def _powers(c: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    if n > 1:
        out[1:] = np.uint64(c)
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class Rolling:
    """Hashes of any runs of words, from prefix sums modulo 2**64."""

    def __init__(self, words: np.ndarray, c: int, seed: int):
        self.seed, n = seed, len(words)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(words, seed) * _powers(c, n), dtype=np.uint64))) if n else np.zeros(1, np.uint64)
        self.inverse = _powers(pow(c, -1, 2**64), n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64), self.seed + 7)


def chunk_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts in a row, and each text's number of words."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    flat, lens = lists.flatten(), pc.list_value_length(lists)
    full = pc.greater(pc.binary_length(flat), 0)
    parent = pc.list_parent_indices(lists).filter(full).to_numpy()
    coded = flat.filter(full).dictionary_encode()
    known = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(coded.dictionary))
    words = known[coded.indices.to_numpy()] if len(known) else np.empty(0, np.uint64)
    return words, np.bincount(parent, minlength=len(lens)).astype(np.int64)


def chunks(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of some megabytes of text; a longer text has a slice of its own."""
    size = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy()
    group = np.cumsum(size) // _CHUNK_BYTES
    cuts = [0, *np.flatnonzero(np.diff(group)) + 1, b.num_rows]
    for i, j in zip(cuts, cuts[1:], strict=False):
        if j > i:
            yield b.slice(i, j - i)


def paths(words: np.ndarray, lens: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Minimizer hash, path hash, document, start in the document and edges of each path.

    window: at least MINIMIZER words.
    """
    empty = np.empty(0, np.int64)
    n, spread = len(words), window - MINIMIZER + 1
    if n < window:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), empty, empty, empty
    roll = Rolling(words, _C1, 1)
    at = np.arange(n - MINIMIZER + 1)
    sub = roll(at, at + MINIMIZER)
    ends = np.cumsum(lens)
    doc = np.repeat(np.arange(len(lens)), lens)
    starts = np.arange(n - window + 1)
    valid = starts + window <= ends[doc[starts]]
    # The least hash of the sub-sequences of each window, the first of equals.
    high = np.uint64((2**64 - 1) ^ ((1 << _PLACE) - 1))
    local = (at - (ends - lens)[doc[at]]).astype(np.uint64)
    least = (sub & high) | (local & np.uint64((1 << _PLACE) - 1))
    if n > 1 << _PLACE:  # one very long text: places do not fit beside the hash
        return _long_paths(words, lens, window, roll, sub)
    have, out = 1, least
    while have < spread:
        step = min(have, spread - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    out = out[: n - window + 1]
    place = (out & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    return _paths_of(starts, valid, place, doc, ends - lens, sub, roll, window)


def _long_paths(words, lens, window, roll, sub) -> tuple[np.ndarray, ...]:
    """As paths(), place by place, for more words than a key has room for."""
    view = np.lib.stride_tricks.sliding_window_view(sub & np.uint64((2**64 - 1) ^ ((1 << _PLACE) - 1)), window - MINIMIZER + 1)
    ends = np.cumsum(lens)
    doc = np.repeat(np.arange(len(lens)), lens)
    starts = np.arange(len(words) - window + 1)
    place = np.concatenate([view[i : i + (1 << 20)].argmin(axis=1) for i in range(0, len(view), 1 << 20)]) + starts - (ends - lens)[doc[starts]]
    return _paths_of(starts, starts + window <= ends[doc[starts]], place, doc, ends - lens, sub, roll, window)


def _paths_of(starts, valid, place, doc, first, sub, roll, window) -> tuple[np.ndarray, ...]:
    starts, place = starts[valid], place[valid]
    own = doc[starts]
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.uint64), starts, starts, starts
    cut = np.ones(len(starts), bool)
    cut[1:] = (place[1:] != place[:-1]) | (own[1:] != own[:-1])
    begin = np.flatnonzero(cut)
    edges = np.diff(np.append(begin, len(starts)))
    s, d = starts[begin], own[begin]
    anchor = place[begin] + first[d]
    return sub[anchor], roll(s, s + edges + window - 1), d, s - first[d], edges


#: A place packs a row's tag, a start, two flags and a number of edges. The tag tells rows that share
#: an id apart; where it does not, the checksums do. Flags: the occurrence is known to be a repeat;
#: it has such repeats.
EDGES, KNOWN, COPIED, START, TAG = 255, 1 << 8, 1 << 9, 10, 41
PLACE = ~(KNOWN | COPIED)
#: Kinds of resolved occurrences: a later one, or the first one of an edge, of paths that branch, or both.
LATER, EDGE, BRANCH = 0, 1, 2
#: Checksums add up the hashes of edges without so many of their lower bits.
SUMMED = 33


def _tag(id_: Column, text: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(id_, text), TAG + 1)


def _tag_of(place: str) -> Column:
    return F.shiftright(place, TAG).alias("tag")


def _start(place: Column | str) -> Column:
    return F.shiftright(place, START).bitwiseAND(F.lit((1 << (TAG - START)) - 1))


def emit_paths(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows (h, p, id, place) of rows (id, tag, text). A path that a chunk holds again is a known
    repeat from its second copy on."""
    for whole in batches:
        for b in chunks(whole):
            ids, tags = (b.column(c).to_numpy().astype(np.int64) for c in ("id", "tag"))
            h, p, d, start, edges = paths(*chunk_words(b.column("text")), window)
            own, place = ids[d], tags[d] << TAG | start << START | edges
            order = np.lexsort((place, own, p, h))
            h, p, own, place = h[order], p[order], own[order], place[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (p[1:] != p[:-1])
            at = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
            known = ~new & ((own != own[at]) | (place != place[at]))
            copied = np.zeros(len(h), bool)
            copied[at[known]] = True
            place = place | known * KNOWN | copied * COPIED
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h.view(np.int64), p.view(np.int64), own, place)], ["h", "p", "id", "place"])


class Resolver:
    """Takes rows sorted by h, p, id, place, batch by batch.

    Keeps only the first row of the open minimizer and that of its open path, so both may hold any
    number of rows. Equal rows count once.
    """

    def __init__(self) -> None:
        self.kept = [np.empty(0, np.int64) for _ in range(5)]  # h, p, id, place and the kinds given already

    def step(self, *rows: np.ndarray) -> list[np.ndarray]:
        """(h, p, id, place, kind) of later occurrences and of the first ones that matter."""
        h, p, own, place, done = (np.concatenate(x) for x in zip(self.kept, (*rows, np.zeros(len(rows[0]), np.int64)), strict=True))
        new_h = np.ones(len(h), bool)
        new_h[1:] = h[1:] != h[:-1]
        new_p = new_h.copy()
        new_p[1:] |= p[1:] != p[:-1]
        again = np.zeros(len(h), bool)
        again[1:] = ~new_p[1:] & (own[1:] == own[:-1]) & ((place[1:] & PLACE) == (place[:-1] & PLACE))
        later = ~new_p & ~again
        first, group = np.flatnonzero(new_p), np.cumsum(new_h) - 1
        repeated = np.logical_or.reduceat(later | (place & COPIED > 0), first)
        branched = (np.bincount(group, weights=new_p) > 1)[group[first]]
        kind = (EDGE * repeated | BRANCH * branched) & ~done[first]
        head, last = np.flatnonzero(new_h)[-1], first[-1]
        keep = np.unique([head, last])
        done[first] |= kind
        self.kept = [x[keep] for x in (h, p, own, place, done)]
        out = [np.concatenate((x[later], x[first[kind > 0]])) for x in (h, p, own, place & PLACE)]
        return [*out, np.concatenate((np.full(later.sum(), LATER), kind[kind > 0]))]


def resolve_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, p, id, place, kind) from sorted rows (h, p, id, place); known repeats pass."""
    state = Resolver()
    for b in batches:
        rows = [b.column(c).to_numpy() for c in ("h", "p", "id", "place")]
        known = rows[3] & KNOWN > 0
        out = [[x[known] for x in rows[:3]] + [rows[3][known] & PLACE, np.full(known.sum(), LATER)]]
        if not known.all():
            out.append(state.step(*(x[~known] for x in rows)))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True)], ["h", "p", "id", "place", "kind"])


class Windows:
    """Hashes and checksums of the windows of texts in a row."""

    def __init__(self, words: np.ndarray, lens: np.ndarray, window: int):
        self.words, self.lens, self.window = words, lens, window
        self.first = np.cumsum(lens) - lens
        at = np.arange(max(0, len(words) - window + 1))
        self.e1, self.e2 = (Rolling(words, c, seed)(at, at + window) for c, seed in ((_C1, 11), (_C2, 13)))
        self.s1, self.s2 = (np.concatenate(([0], np.cumsum((e >> np.uint64(SUMMED)).astype(np.int64)))) for e in (self.e1, self.e2))

    def fits(self, d: np.ndarray, start: np.ndarray, edges: np.ndarray) -> np.ndarray:
        return start + edges + self.window - 1 <= self.lens[d]

    def sums(self, s: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two checksums of edges from places s on; those of spans end to end add up."""
        return self.s1[s + edges] - self.s1[s], self.s2[s + edges] - self.s2[s]


def _listed(b: pa.RecordBatch, column: str, names: tuple[str, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The row of each struct in a column of lists (null ones are empty), and its fields."""
    lists = b.column(column)
    lens = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
    flat = lists.flatten()
    return np.repeat(np.arange(b.num_rows), lens), [flat.field(n).to_numpy().astype(np.int64) for n in names]


def read_edges(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The edges of the texts (id, tag, text, wanted): (a, b, id, place, head, tail, d1, d2, single). a and
    b name an edge, head and tail its nodes; d1 and d2 are the checksums of those that are not single."""
    for whole in batches:
        for b in chunks(whole):
            ids, tags = (b.column(c).to_numpy().astype(np.int64) for c in ("id", "tag"))
            words, lens = chunk_words(b.column("text"))
            here = Windows(words, lens, window)
            d, (h, p, place, kind) = _listed(b, "wanted", ("h", "p", "place", "kind"))
            edges, start = place & EDGES, place >> START & (1 << (TAG - START)) - 1
            fits = here.fits(d, start, edges)
            d, h, p, start, edges, kind = (x[fits] for x in (d, h, p, start, edges, kind))
            s = start + here.first[d]
            # A row that shares id and tag with the one that is meant has other words.
            meant = Rolling(words, _C1, 1)(s, s + edges + window - 1).view(np.int64) == p
            d, h, p, start, edges, kind, s = (x[meant] for x in (d, h, p, start, edges, kind, s))
            node = Rolling(words, _C1, 21)
            long, cut = kind & EDGE > 0, kind & BRANCH > 0
            many = edges[cut]
            step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            d = np.concatenate((d[long], np.repeat(d[cut], many)))
            start = np.concatenate((start[long], np.repeat(start[cut], many) + step))
            s = np.concatenate((s[long], np.repeat(s[cut], many) + step))
            n = np.concatenate((edges[long], np.ones(len(step), np.int64)))
            single = np.arange(len(n)) >= long.sum()
            only = s[single]
            a = np.concatenate((h[long], here.e1[only].view(np.int64)))
            c = np.concatenate((p[long], here.e2[only].view(np.int64)))
            ends = [node(x, x + window - 1).view(np.int64) for x in (s, s + n)]
            columns = [a, c, ids[d], tags[d] << TAG | start << START | n, *ends]
            # The checksums of a single edge are the upper bits of its hashes.
            sums = [pa.array(x, mask=single) for x in here.sums(s, n)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *sums, pa.array(single)], ["a", "b", "id", "place", "head", "tail", "d1", "d2", "single"])


def _links(graph: DataFrame) -> DataFrame:
    """Rows (k, before): the edge that must come before edge k, as the node between does not branch."""
    into = graph.groupBy(F.col("tail").alias("head")).agg(F.count("*").alias("n"), F.min("k").alias("before")).where("n = 1").drop("n")
    out = graph.groupBy("head").agg(F.count("*").alias("n"), F.min("k").alias("k")).where("n = 1").drop("n")
    return out.join(into, "head").where("k <> before").select("k", "before")


def _doubled(pointers: DataFrame) -> DataFrame:
    """Rows (chain, root, offset) for pointers(chain, root, offset) to a chain before: the first chain of
    all. Chains in a circle keep themselves. Each round is written, so that a lost executor costs
    one round, and reaches twice as far; nothing but a count comes to the driver."""
    reached, before = materialize(pointers.withColumn("open", F.lit(True)), "reached"), None
    while True:
        n = reached.where("open").count()
        # As many as in the round before: circles are all that is left.
        if not n or n == before:
            own = F.col("open")
            return reached.select("chain", F.when(own, F.col("chain")).otherwise(F.col("root")).alias("root"), F.when(own, 0).otherwise(F.col("offset")).alias("offset"))
        before = n
        far = reached.select(F.col("chain").alias("root"), F.col("root").alias("far"), F.col("offset").alias("more"))
        step = reached.join(far, "root", "left")
        step = step.select("chain", F.coalesce("far", "root").alias("root"), (F.col("offset") + F.coalesce("more", F.lit(0))).alias("offset"), F.col("far").isNotNull().alias("open"))
        reached = materialize(step, "reached")


def unbranched_paths(graph: DataFrame) -> DataFrame:
    """graph(k, id, place, head, tail, ...) with the unbranched path of each edge and its offset there."""
    by_row = Window.partitionBy("id", F.shiftright("place", TAG)).orderBy("place")
    n, start = F.col("place").bitwiseAND(F.lit(EDGES)), _start("place")
    end = F.lag(start + n).over(by_row)
    linked = graph.join(_links(graph), "k", "left")
    linked = linked.withColumn("next", F.coalesce((F.lag("k").over(by_row) == F.col("before")) & (end == start), F.lit(False)))
    origin = F.last(F.when(~F.col("next"), F.struct("k", start.alias("start"))), True).over(by_row.rowsBetween(Window.unboundedPreceding, 0))
    chains = linked.withColumn("origin", origin).withColumn("chain", F.col("origin.k")).withColumn("offset", start - F.col("origin.start"))
    chains = materialize(chains.withColumn("before", F.when(~F.col("next"), F.col("before"))).drop("next", "origin"), "chains")
    ends = chains.select(F.col("k").alias("before"), F.col("chain").alias("root"), (F.col("offset") + n).alias("offset"))
    pointers = chains.where("before is not null").select("chain", "before").join(ends, "before").select("chain", "root", "offset")
    roots = _doubled(pointers).select("chain", F.col("root").alias("path"), F.col("offset").alias("more"))
    found = chains.drop("before").join(roots, "chain", "left")
    return found.withColumn("path", F.coalesce("path", "chain")).withColumn("offset", F.col("offset") + F.coalesce("more", F.lit(0))).drop("chain", "more")


def _resolved(slim: DataFrame, window: int) -> DataFrame:
    """The occurrences of paths that matter, see resolve_paths, for rows (id, tag, text)."""
    emitted = slim.mapInArrow(lambda it: emit_paths(it, window), "h long, p long, id long, place long")
    known = F.col("place").bitwiseAND(F.lit(KNOWN)) > 0
    # Known repeats have nobody to meet, so they go anywhere.
    dealt = emitted.repartition(F.when(known, F.xxhash64("id", "place")).otherwise(F.col("h"))).sortWithinPartitions(known, "h", "p", "id", "place")
    return materialize(dealt.mapInArrow(resolve_paths, "h long, p long, id long, place long, kind long"), "paths")


def _read(slim: DataFrame, found: DataFrame, window: int) -> DataFrame:
    """The edges of first occurrences, see read_edges."""
    wanted = found.where("kind > 0").groupBy("id", _tag_of("place")).agg(F.collect_set(F.struct("h", "p", "place", "kind")).alias("wanted"))
    read = slim.join(wanted.hint("shuffle_hash"), ["id", "tag"]).select("id", "tag", "text", "wanted")
    return materialize(read.mapInArrow(lambda it: read_edges(it, window), "a long, b long, id long, place long, head long, tail long, d1 long, d2 long, single boolean"), "edges")


def _hits(edges: DataFrame) -> DataFrame:
    """The single edges that occur more than once: (a, b, id, place, head, tail, later)."""
    at, own = F.struct("id", "place"), edges.where("single").select("a", "b", "id", "place", "head", "tail")
    first = own.groupBy("a", "b").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first <> last").drop("last")
    return materialize(split_join(own, first, ["a", "b"]).withColumn("later", at > F.col("first")).drop("first"), "hits")


def _graph(edges: DataFrame, hits: DataFrame) -> DataFrame:
    """The distinct repeated edges (a, b, k, id, place, head, tail, d1, d2) with their first occurrences."""
    columns = ["id", "place", "head", "tail", "d1", "d2"]
    single = hits.where("not later").withColumns({d: F.shiftrightunsigned(c, SUMMED) for d, c in (("d1", "a"), ("d2", "b"))})
    both = edges.where("not single").select("a", "b", *columns).unionByName(single.select("a", "b", *columns))
    each = both.groupBy("a", "b").agg(F.min(F.struct(*columns)).alias("e"))
    return materialize(each.select("a", "b", F.xxhash64("a", "b").alias("k"), "e.*"), "graph")


def _labels(graph: DataFrame) -> DataFrame:
    """Rows (a, b, path, offset, d1, d2) for the edges of a graph."""
    return materialize(unbranched_paths(graph).select("a", "b", "path", "offset", "d1", "d2"), "labels")


def _spans(found: DataFrame, hits: DataFrame, labels: DataFrame) -> DataFrame:
    """Later occurrences of edges of one path that lie end to end, as spans by row."""
    later = found.where(f"kind = {LATER}").select(F.col("h").alias("a"), F.col("p").alias("b"), "id", "place").unionByName(hits.where("later").select("a", "b", "id", "place"))
    placed = split_join(later, labels, ["a", "b"]).select("id", _tag_of("place"), _start("place").alias("start"), F.col("place").bitwiseAND(F.lit(EDGES)).alias("n"), "path", "offset", "d1", "d2")
    along = Window.partitionBy("id", "tag", "path", "line").orderBy("start")
    placed = placed.withColumn("line", F.col("start") - F.col("offset")).drop("offset")
    placed = placed.withColumn("last", F.lag("start").over(along)).withColumn("end", F.lag(F.col("start") + F.col("n")).over(along))
    fresh = F.col("last").isNull() | ((F.col("last") != F.col("start")) & (F.col("end") != F.col("start")))
    placed = placed.withColumn("part", F.sum(fresh.cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    # Equal rows of the table have each occurrence more than once.
    placed = placed.where("last is null or last <> start")
    spans = placed.groupBy("id", "tag", "path", "line", "part").agg(F.min("start").alias("start"), F.sum("n").alias("n"), F.sum("d1").alias("d1"), F.sum("d2").alias("d2"))
    return materialize(spans.groupBy("id", "tag").agg(F.collect_list(F.struct("start", "n", "d1", "d2")).alias("spans")), "spans")


def repeated_spans(slim: DataFrame, window: int = 20) -> DataFrame:
    """Rows (id, tag, spans) for rows (id, tag, text): the spans of edges that also occur earlier, by id,
    tag and start, as structs (start, n, d1, d2) with the checksums of the first occurrences.

    Each step is written; then its shuffles and the tables that it was the last to read are deleted.
    """
    if not MINIMIZER <= window <= 200:
        raise ValueError("the window can be 6 to 200 words")
    found = _resolved(slim, window)
    release(found)
    edges = _read(slim, found, window)
    release(edges)
    hits = _hits(edges)
    graph = _graph(edges, hits)
    release(found, edges)
    labels = _labels(graph)
    release(found, graph)
    spans = _spans(found, hits, labels)
    release(spans, found, hits, labels)
    return spans


def _covered(b: pa.RecordBatch, window: int) -> tuple[np.ndarray, np.ndarray]:
    """How many spans, less those whose words differ from the first occurrence, cover each word of a
    chunk; and where its texts begin."""
    words, lens = chunk_words(b.column("text"))
    here = Windows(words, lens, window)
    d, (start, n, d1, d2) = _listed(b, "spans", ("start", "n", "d1", "d2"))
    fits = here.fits(d, start, n)
    s, n, d1, d2 = start[fits] + here.first[d[fits]], n[fits], d1[fits], d2[fits]
    own1, own2 = here.sums(s, n)
    same = (own1 == d1) & (own2 == d2)
    change = np.bincount(s[same], minlength=len(words) + 1) - np.bincount((s + n + window - 1)[same], minlength=len(words) + 1)
    return np.cumsum(change)[: len(words)], here.first


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """One row (id, text, n_words, n_removed, removed) for each row of docs.

    Words are runs of anything but ASCII white space, unchanged. A word goes if some window
    that covers it also starts earlier, in a smaller id or before in the same document; windows
    are judged on the input. text is what stays, joined by one space; removed lists the spans
    of removed words as structs (start, end), end exclusive. A null, empty or blank text has no
    words and an empty kept text. Every row is a document of its own: rows that share an id come
    in an order of their texts' hashes, and rows with a null id come before all others (ids under
    -2**62 may mix with them), in such an order. Equal rows are one document and all get the same
    result. Other columns of docs are not read. An empty table gives no rows.
    """
    text, id_ = F.col(f"`{text_col}`").cast("string"), row_ids(id_col, text_col)
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("own"), id_.alias("id"), _tag(id_, text).alias("tag"), text.alias("text"))
    spans = repeated_spans(own.select("id", "tag", "text"), window)
    joined = own.join(build_side(spans), ["id", "tag"], "left").select("own", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (c for s in slices(batches) for c in chunks(s)):
            held = b.column("spans").is_valid()
            covered, first = _covered(b.filter(held), window)
            begins = iter(first.tolist())
            texts, n_words, n_removed, removed = [], [], [], []
            for text, has in zip(b.column("text").cast(pa.binary()).to_pylist(), held.to_pylist(), strict=True):
                words, gone = (text or b"").split(), []
                n = len(words)
                if has:
                    at = next(begins)
                    keep = covered[at : at + n] == 0
                    words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                    edge = np.flatnonzero(np.diff(np.concatenate(([True], keep, [True])).astype(np.int8)))
                    gone = [{"start": int(a), "end": int(z)} for a, z in zip(edge[::2], edge[1::2], strict=True)]
                texts.append(b" ".join(words))
                n_words.append(n)
                n_removed.append(n - len(words))
                removed.append(gone)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column("own"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(removed, kind)], ["id", "text", "n_words", "n_removed", "removed"])

    return joined.mapInArrow(run, "id long, text string, n_words long, n_removed long, removed array<struct<start: long, end: long>>")


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Words, removed words and the hash of the kept words of every document."""
    found = dedup_substrings(documents(spark, sf_dir, "doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
n AS (SELECT doc_id, ws, len(ws) AS n FROM d),
w AS (SELECT doc_id, unnest(range(1, n - 18)) AS pos, ws FROM n WHERE n >= 20),
k AS (SELECT doc_id, pos, array_to_string(ws[pos:pos + 19], ' ') AS win FROM w),
r AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS rn FROM k) WHERE rn > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS i FROM r),
p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
s AS (SELECT p.doc_id, count(*) FILTER (WHERE c.i IS NOT NULL) AS gone,
        string_agg(word, ' ' ORDER BY p.i) FILTER (WHERE c.i IS NULL) AS kept FROM p LEFT JOIN c ON c.doc_id = p.doc_id AND c.i = p.i GROUP BY p.doc_id)
SELECT n.doc_id, n.n AS n_words, coalesce(s.gone, 0) AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256
FROM n LEFT JOIN s ON s.doc_id = n.doc_id
"""
