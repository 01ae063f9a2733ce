"""Suffix-array dedup of repeated byte strings, with suffixes compared by hashes.

Which bytes go is decided by all strings of a given length, one at each byte, as a suffix array's neighbours
with a common extension of that length tell. Only suffixes that may have such a neighbour are sorted, and
those that can be neighbours are brought together first:

1. A string's anchor is the place of its least gram by hash, the first of equal ones; it depends on the
   string alone, so equal strings have their anchors at equal offsets. The strings of one anchor stand side by
   side; together they are its context. Anchors whose gram occurs once in the corpus are done.
2. Where all contexts of a gram are equal, all their strings are repeated. Of the other grams one
   place of each distinct context is looked up, and its suffixes go to the task of the gram.
3. There suffixes with equal gram and offset are merge-sorted. Two suffixes are compared by their common
   extension, found by binary search over prefix polynomial hashes, and the byte behind it. Neighbours
   whose hashes agree over the whole length are verified byte by byte; should one fail, its run is
   sorted by bytes.
4. A gram with very many distinct contexts, such as a common phrase in changing surroundings, is dealt
   again: its strings by narrower ranges of offsets, together with the bytes that all strings of a
   range share, down to single strings. Equal parts are one row, so no task holds a gram's rows.
5. Spans found go back to all places of their contexts, and the texts lose their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.common import build_side, documents, materialize, slices

#: Distinct contexts of a gram that one task sorts; bytes of contexts that a task sorts at once; windows of a text at once.
GROUP_CONTEXTS, SORTED_BYTES, CHUNK = 4096, 1 << 20, 1 << 20
BASE = 0x9E3779B97F4A7C15
BLOCK = 1 << 14


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


POWERS, INVERSE = _powers(BLOCK + 1, BASE), _powers(BLOCK + 1, pow(BASE, -1, 2**64))
#: A random odd number for each byte value.
VALUES = np.random.default_rng(13).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def prefix_hashes(a: np.ndarray) -> np.ndarray:
    """h[i]: the polynomial hash of the first i bytes, modulo 2**64; in blocks, so that powers stay few."""
    n = len(a)
    out = np.zeros(n + 1, np.uint64)
    for s in range(0, n, BLOCK):
        own = VALUES[a[s : s + BLOCK]]
        m = len(own)
        out[s + 1 : s + m + 1] = np.cumsum(own * INVERSE[1 : m + 1], dtype=np.uint64) * POWERS[1 : m + 1] + out[s] * POWERS[1 : m + 1]
    return out


def span_hash(h: np.ndarray, at: np.ndarray, length) -> np.ndarray:
    """The hash of length bytes from each place."""
    return h[at + length] - h[at] * POWERS[length]


def anchors(a: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, place of the gram, first window, last window) of each anchor of the bytes a."""
    windows, width = len(a) - length + 1, length - gram + 1
    h = prefix_hashes(a)
    own = h[gram:] - h[:-gram] * POWERS[gram]
    mixed = own ^ (own >> np.uint64(29))
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mask = np.uint64((1 << 21) - 1)
    code = (mixed & ~mask) | np.arange(len(own), dtype=np.uint64)
    # The least of each width neighbours: of the rest of a block and the begin of the next.
    blocks = np.concatenate((code, np.full(-len(code) % width, 2**64 - 1, np.uint64))).reshape(-1, width)
    begin, rest = np.minimum.accumulate(blocks, axis=1).ravel(), np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    place = (np.minimum(rest[:windows], begin[width - 1 : width - 1 + windows]) & mask).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    place = place[first]
    return own[place], place, first, np.append(first[1:], windows) - 1


def contexts(text: bytes, length: int, gram: int) -> Iterator[tuple[np.ndarray, list[int], np.ndarray]]:
    """(gram hash, context hash, packed place) of all anchors of one text, a chunk of windows at a time."""
    whole, digest = np.frombuffer(text, np.uint8), xxhash.xxh3_64_intdigest
    for s in range(0, len(whole) - length + 1, CHUNK):
        gh, place, first, last = anchors(whole[s : s + CHUNK + length - 1], length, gram)
        first, last, place = first + s, last + s, place + s
        yield gh, [digest(text[i:j]) for i, j in zip(first.tolist(), (last + length).tolist(), strict=True)], first << 24 | (place - first) << 12 | last - first


def unpacked(at: int) -> tuple[int, int, int]:
    """First window, offset of the anchor in it, number of windows."""
    return at >> 24, at >> 12 & 4095, (at & 4095) + 1


def _less(h: np.ndarray, blob: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """-1, 0, 1: how suffixes a stand to suffixes b, by their common extension up to length."""
    low, high = np.zeros(len(a), np.int64), np.full(len(a), length)
    while True:
        open_ = low < high
        if not open_.any():
            break
        mid = (low + high + 1) // 2
        same = span_hash(h, a, mid) == span_hash(h, b, mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    x, y = (blob[np.minimum(p + low, len(blob) - 1)].astype(np.int16) for p in (a, b))
    return np.where(low == length, 0, np.sign(x - y)).astype(np.int8)


def merge_sort(h: np.ndarray, blob: np.ndarray, at: np.ndarray, run: np.ndarray, length: int) -> np.ndarray:
    """The places at, in suffix order within each run; run: for each place where its run begins. All runs are merged
    at once, from the bottom up: a suffix finds its place in the sibling by binary search."""
    at = at.copy()
    n = len(at)
    where = np.arange(n)
    end = run + np.bincount(run, minlength=n)[run]
    width, most = 1, int((end - run).max(initial=0))
    while width < most:
        active = np.flatnonzero(end - run > width)
        x, begin, stop = at[active], run[active], end[active]
        left = (where[active] - begin) // (2 * width) * (2 * width) + begin
        middle, right = np.minimum(left + width, stop), np.minimum(left + 2 * width, stop)
        is_left = where[active] < middle
        low, high = np.where(is_left, middle, left), np.where(is_left, right, middle)
        base = low.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) // 2
            order = _less(h, blob, at[mid], x[open_], length)
            before = np.where(is_left[open_], order < 0, order <= 0)
            low[open_], high[open_] = np.where(before, mid + 1, low[open_]), np.where(before, high[open_], mid)
        new = left + (where[active] - np.where(is_left, left, middle)) + (low - base)
        at[new] = x
        width *= 2
    return at


def equal_bytes(blob: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    out, each = np.empty(len(a), bool), np.arange(length)
    for s in range(0, len(a), 4096):
        x, y = a[s : s + 4096, None] + each, b[s : s + 4096, None] + each
        out[s : s + 4096] = (blob[x] == blob[y]).all(axis=1)
    return out


def repeated(bucket: np.ndarray, offset: np.ndarray, windows: np.ndarray, texts: list[bytes], length: int) -> np.ndarray:
    """For each window of each context in turn, whether an equal one of the same bucket and offset is among the others."""
    blob = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts)), windows)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    found = np.zeros(len(owner), bool)
    number = np.unique(bucket, return_inverse=True)[1]
    key = number[owner] * np.int64(length) + (offset[owner] - step)
    order = np.argsort(key, kind="stable")
    key = key[order]
    fresh = np.concatenate(([True], key[1:] != key[:-1]))
    begin = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))
    alone = fresh & np.append(fresh[1:], True)
    order, begin = order[~alone], begin[~alone]
    if not len(order):
        return found
    begin = np.searchsorted(begin, begin)  # runs without those that are alone
    at = begins[owner[order]] + step[order]
    h = prefix_hashes(blob)
    # Places are distinct, so a sorted place tells which window it is.
    by_place = order[np.argsort(at)]
    sorted_at = merge_sort(h, blob, at, begin, length)
    same = (begin[1:] == begin[:-1]) & (span_hash(h, sorted_at[1:], length) == span_hash(h, sorted_at[:-1], length))
    pairs = np.flatnonzero(same)
    true = equal_bytes(blob, sorted_at[pairs], sorted_at[pairs + 1], length)
    for run in np.unique(begin[pairs[~true]]):  # a collision: this run again, by its bytes
        own = np.flatnonzero(begin == run)
        sorted_at[own] = sorted(sorted_at[own].tolist(), key=lambda p: blob[p : p + length].tobytes())
        inner = own[:-1]
        pairs = np.concatenate((pairs[begin[pairs] != run], inner))
        true = equal_bytes(blob, sorted_at[pairs], sorted_at[pairs + 1], length)
    hit = np.unique(np.concatenate((pairs[true], pairs[true] + 1)))
    places = np.sort(at)
    found[by_place[np.searchsorted(places, sorted_at[hit])]] = True
    return found


def _runs(mask: np.ndarray) -> list[dict]:
    """First and last of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    return [{"first": int(a), "last": int(b) - 1} for a, b in zip(edge[::2], edge[1::2], strict=True)]


UNIT = "bucket long, sid long, n long, offset int, windows int, bytes binary"
SPANS = "array<struct<first: int, last: int>>"


def _sorted_spans(units: DataFrame, length: int) -> DataFrame:
    """(bucket, sid, spans): the repeated windows of each unit that has some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def out(b: pa.Table) -> pa.RecordBatch:
            bucket, n, windows = (b.column(c).to_numpy() for c in ("bucket", "n", "windows"))
            found = repeated(bucket, b.column("offset").to_numpy(), windows, b.column("bytes").to_pylist(), length)
            ends = np.cumsum(windows)
            spans = [[{"first": 0, "last": w - 1}] if k > 1 else _runs(found[e - w : e]) for k, w, e in zip(n.tolist(), windows.tolist(), ends.tolist(), strict=True)]
            keep = np.array([bool(x) for x in spans], bool)
            columns = [pa.array(bucket[keep]), pa.array(b.column("sid").to_numpy()[keep]), pa.array([x for x in spans if x], pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))]
            return pa.RecordBatch.from_arrays(columns, ["bucket", "sid", "spans"])

        for b in slices(batches, 2048):
            if not b.num_rows:
                continue
            held.append(b)
            size += b.column("bytes").nbytes
            if size < SORTED_BYTES:
                continue
            whole = pa.Table.from_batches(held)
            keys = whole.column("bucket").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on
            if cut:
                yield out(whole.slice(0, cut))
            held = whole.slice(cut).combine_chunks().to_batches()
            size = sum(x.column("bytes").nbytes for x in held) if cut else 0
        if held:
            yield out(pa.Table.from_batches(held))

    return units.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, f"bucket long, sid long, spans {SPANS}")


def _split(units: DataFrame, length: int, width: int) -> DataFrame:
    """Parts (bucket, sid, shift, then as a unit) of units, by ranges of width offsets and the bytes that a range shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed = lambda x: x - 2**64 if x >> 63 else x
        for b in slices(batches, 256):
            rows = []
            for bucket, sid, n, offset, windows, text in zip(*(b.column(c).to_pylist() for c in ("bucket", "sid", "n", "offset", "windows", "bytes")), strict=True):
                i = 0
                while i < windows:
                    j = (offset - i) // width
                    last = min(windows - 1, offset - j * width)
                    shared = text[offset - j * width : offset - j * width - width + 1 + length]
                    part = text[i : last + length]
                    key = xxhash.xxh3_64_intdigest(shared, xxhash.xxh3_64_intdigest(b"%d:%d" % (bucket, j)))
                    rows.append((bucket, sid, i, signed(key), signed(xxhash.xxh3_64_intdigest(part)), n, offset - i, last - i + 1, part))
                    i = last + 1
            columns = list(zip(*rows, strict=True)) or [[]] * 9
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["of_bucket", "of_sid", "shift", "bucket", "sid", "n", "offset", "windows", "bytes"])

    return units.mapInArrow(run, f"of_bucket long, of_sid long, shift int, {UNIT}")


def repeated_spans(units: DataFrame, length: int, widths: tuple[int, ...], most: int | None = None) -> DataFrame:
    """(bucket, sid, spans) of written units(bucket, sid, n, offset, windows, bytes), distinct by bucket and sid."""
    most = most or GROUP_CONTEXTS
    hot = materialize(units.groupBy("bucket").agg(F.count("*").alias("d")).where(F.col("d") > most).select("bucket"), "hot-grams")
    if not widths or hot.isEmpty():
        return _sorted_spans(units, length)
    found = _sorted_spans(units.join(build_side(hot), "bucket", "left_anti"), length)
    parts = materialize(_split(units.join(build_side(hot), "bucket", "left_semi"), length, widths[0]), "parts")
    distinct = parts.groupBy("bucket", "sid").agg(F.sum("n").alias("n"), F.first("offset").alias("offset"), F.first("windows").alias("windows"), F.first("bytes").alias("bytes"))
    deeper = materialize(repeated_spans(materialize(distinct, "part-units"), length, widths[1:], most), "part-spans")
    back = parts.select("of_bucket", "of_sid", "shift", "bucket", "sid").join(build_side(deeper), ["bucket", "sid"])
    moved = F.transform("spans", lambda s: F.struct((s.first + F.col("shift")).alias("first"), (s["last"] + F.col("shift")).alias("last")))
    return found.unionByName(back.select(F.col("of_bucket").alias("bucket"), F.col("of_sid").alias("sid"), moved.alias("spans")))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, gram: int | None = None) -> DataFrame:
    """docs with columns n_bytes, n_removed, n_spans (long) and kept (binary): the text's bytes less each byte that is
    covered by a string of length bytes that starts anywhere else too.

    Texts are UTF-8, null counts as empty; strings do not cross texts; overlaps count, and all strings are judged
    on the input. Every row is a text of its own, also with a null or repeated id: of equal rows, all that is
    long enough goes. What is left need not be valid UTF-8. Equal contexts are recognised by 64 bits of hash of
    those that share a gram. Input columns of the new names are replaced; an empty table gives an empty result.
    length: 2 to 4,000 bytes; gram: the bytes of an anchor's gram, at most length.
    """
    gram = gram or max(1, length // 3 - 2)
    new = ("n_bytes", "n_removed", "n_spans", "kept")
    keep = [c for c in docs.columns if c not in new]
    own, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    key = [F.coalesce(own, F.lit(0)).alias("id"), F.xxhash64(text, own).alias("row")]
    slim = docs.where(F.octet_length(text) >= length).select(*key, text.cast("binary").alias("bytes"))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for t in _tables(b, length, gram, False):
                yield t

    counted = slim.select("bytes").mapInArrow(grams, "bucket long, sid long")
    counted = counted.groupBy("bucket").agg(F.count("*").alias("n"), F.min("sid").alias("least"), F.max("sid").alias("most")).where("n > 1")
    shared = materialize(counted.select("bucket", (F.col("least") != F.col("most")).alias("mixed")), "grams")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for t in _tables(b, length, gram, True):
                yield t

    places = slim.mapInArrow(placed, "bucket long, sid long, at long, id long, row long").join(build_side(shared), "bucket")
    places = materialize(places, "places")
    mixed = places.where("mixed")
    distinct = mixed.groupBy("bucket", "sid").agg(F.count("*").alias("n"), F.min(F.struct("id", "row", "at")).alias("at"))
    wanted = distinct.groupBy("at.id", "at.row").agg(F.collect_list(F.struct("bucket", "sid", "n", "at.at")).alias("wanted"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            rows = []
            for text, wanted in zip(b.column("bytes").to_pylist(), b.column("wanted").to_pylist(), strict=True):
                for w in wanted:
                    first, offset, windows = unpacked(w["at"])
                    rows.append((w["bucket"], w["sid"], w["n"], offset, windows, text[first : first + windows - 1 + length]))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["bucket", "sid", "n", "offset", "windows", "bytes"])

    # Equal rows have one key and give equal units; one of them is enough.
    looked_up = slim.join(build_side(materialize(wanted, "wanted")), ["id", "row"]).select("bytes", "wanted").mapInArrow(fetch, UNIT)
    units = materialize(looked_up.dropDuplicates(["bucket", "sid"]), "units")
    widths = tuple(x for x in (length // 8, 1) if 0 < x < length - gram + 1)
    spans = materialize(repeated_spans(units, length, widths), "spans")
    first = F.shiftright("at", 24)
    of_mixed = mixed.join(build_side(spans), ["bucket", "sid"]).select("id", "row", first.alias("at"), F.explode("spans").alias("s")).select("id", "row", (F.col("at") + F.col("s.first")).alias("a"), (F.col("at") + F.col("s.last") + length).alias("b"))
    of_pure = places.where("not mixed").select("id", "row", first.alias("a"), (first + F.col("at").bitwiseAND(F.lit(4095)) + length).alias("b"))
    gone = materialize(of_mixed.unionByName(of_pure).groupBy("id", "row").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("gone")), "gone")

    fields = [T.StructField(f.name, f.dataType) for f in docs.select(*[f"`{c}`" for c in keep]).schema]
    schema = T.StructType([*fields, *[T.StructField(c, T.LongType()) for c in new[:3]], T.StructField("kept", T.BinaryType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for text, gone in zip(b.column(len(keep)).to_pylist(), b.column(len(keep) + 1).to_pylist(), strict=True):
                text, pieces, at, spans = text or b"", [], 0, 0
                for s in gone or ():
                    if s["a"] > at or not spans:
                        pieces.append(text[at : s["a"]])
                        spans += 1
                    at = max(at, s["b"])
                pieces.append(text[at:])
                kept = b"".join(pieces)
                out.append((len(text), len(text) - len(kept), spans, kept))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *(pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.binary()], strict=True))], [*keep, *new])

    # By number, so that no name of an input column can clash with these.
    whole = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], text.cast("binary").alias("bytes"), *key)
    return whole.join(build_side(gone), ["id", "row"], "left").select(*[f"c{i}" for i in range(len(keep))], "bytes", "gone").mapInArrow(apply, schema)


def _tables(b: pa.RecordBatch, length: int, gram: int, with_places: bool) -> Iterator[pa.RecordBatch]:
    """Anchors of a batch of texts, in batches of bounded size."""
    parts: list[list] = [[], [], [], []]
    rows = 0

    def out() -> pa.RecordBatch:
        bucket, sid = np.concatenate(parts[0]).view(np.int64), np.array(parts[1], np.uint64).view(np.int64)
        columns = [pa.array(bucket), pa.array(sid)]
        names = ["bucket", "sid"]
        if with_places:
            which = np.repeat(parts[3], list(map(len, parts[0])))
            columns += [pa.array(np.concatenate(parts[2])), b.column("id").take(pa.array(which)), b.column("row").take(pa.array(which))]
            names += ["at", "id", "row"]
        for p in parts:
            p.clear()
        return pa.RecordBatch.from_arrays(columns, names)

    for i, text in enumerate(b.column("bytes").to_pylist()):
        for gh, sids, at in contexts(text, length, gram):
            parts[0].append(gh)
            parts[1] += sids
            parts[2].append(at)
            parts[3].append(i)
            rows += len(gh)
            if rows >= 100_000:
                yield out()
                rows = 0
    if rows:
        yield out()


def op13_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Bytes, removed bytes and spans and the hash of the kept bytes of every document."""
    found = without_repeats(documents(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (SELECT r, c, substr(x, 1000 * c + 1, 1398) AS y FROM (SELECT r, x, unnest(range((length(x) // 2 - 200) // 500 + 1)) AS c FROM d WHERE length(x) >= 400)),
w AS (SELECT r, 500 * c + i AS i, md5_number(substr(y, 2 * i + 1, 400)) AS h FROM (SELECT r, c, y, unnest(range(length(y) // 2 - 199)) AS i FROM c)),
s AS (SELECT r, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
e AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM s),
g AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS k FROM e),
spans AS (SELECT r, k, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY r, k),
pieces AS (SELECT r, k, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY k), 0) AS past FROM spans),
kept AS (SELECT r, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(b) AS past, string_agg(substr(x, 2 * past + 1, 2 * (a - past)), '' ORDER BY k) AS head
         FROM pieces JOIN d USING (r) GROUP BY r)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(past, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
