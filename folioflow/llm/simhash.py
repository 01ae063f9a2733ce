"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints: 64 majority bits over the XXH64 values (seed 42) of word shingles.
Linking: two fingerprints within three bits differ by at most two bits outside that one of
four 16-bit blocks which holds most of their differences (three differences cannot all avoid
a block that holds one). For each block, a fingerprint therefore emits, over the 48 other
bits, every variant within one bit, half of that remaining radius: 4 x 49 rows. Two
fingerprints that link meet in at least one variant. Meeting pairs are verified on all 64
bits. Flipping bits over all 64 bits instead would take more than 1,000 rows a fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import id_and_text, materialize, slices, split_join
from folioflow.llm.graph import connected_components

BLOCKS, BLOCK_BITS, SEED = 4, 16, 42
#: Runs up to this length are compared member by member; longer ones are searched.
SHORT_RUN = 16
CHUNK = 1 << 16


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """Hash of each word shingle of one whole text in UTF-8; none of a text without words."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    whole = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(whole, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: 1 - shingle].tolist() if shingle > 1 else starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)
    return np.array([digest(whole[a:b], SEED) for a, b in spans], np.uint64)


def fingerprint(text: bytes | None, shingle: int) -> int:
    """Unsigned 64-bit fingerprint of one whole text in UTF-8."""
    return majority(shingle_hashes(text, shingle))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half the hashes have; zero of none."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = hashes[i : i + CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Rows (id long, fp long: the fingerprint's bits). One row for each input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = np.fromiter((fingerprint(t, shingle) for t in b.column("text").cast(pa.binary()).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(found.view(np.int64))], ["id", "fp"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "id long, fp long")


def _forest(values: np.ndarray, radius: int) -> tuple[list, list]:
    """Verified links that connect what links connect among distinct values; fewer than values."""
    left, right = [], []
    rest = values
    while len(rest):
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            x = frontier.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                hit = rest[near]
                left += [np.full(len(hit), x)]
                right += [hit]
                frontier += list(hit)
                rest = rest[~near]
    return left, right


def _meet(keys: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links among values that share a key; rows are sorted by key and value."""
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (values[1:] != values[:-1])
    keys, values = keys[fresh], values[fresh]
    begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(begin, len(keys)))
    left, right = [], []
    size_of = np.repeat(sizes, sizes)
    small = (size_of > 1) & (size_of <= SHORT_RUN)
    k, v = keys[small], values[small]
    for j in range(1, SHORT_RUN):
        if j >= len(k):
            break
        near = (k[j:] == k[:-j]) & (np.bitwise_count(v[j:] ^ v[:-j]) <= radius)
        if near.any():
            left.append(v[:-j][near])
            right.append(v[j:][near])
    for at in np.flatnonzero(sizes > SHORT_RUN):
        a, b = _forest(values[begin[at] : begin[at] + sizes[at]], radius)
        left += a
        right += b
    if not left:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """Links (u, v) between the distinct fingerprints fps(fp).

    Every pair within the radius is linked directly or, in a variant that many share,
    through other pairs within the radius.
    """
    if not 0 <= radius <= 3:
        raise ValueError("the radius can be 0 to 3 bits")
    ball = []
    for b in range(BLOCKS):
        ignored = ((1 << BLOCK_BITS) - 1) << (b * BLOCK_BITS)
        keep = ~ignored & (2**64 - 1)
        ball += [(keep, 0)] + [(keep, 1 << i) for i in range(64) if keep >> i & 1]
    signed = lambda x: x - 2**64 if x >> 63 else x
    variants = F.array(*[F.col("fp").bitwiseAND(F.lit(signed(k))).bitwiseXOR(F.lit(signed(f))) for k, f in ball])
    # Spread first: the table is small, but each row becomes 196.
    spread = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = spread.select(F.explode_outer(variants).alias("key"), "fp").repartition("key").sortWithinPartitions("key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A key holds at most 2**16 * 49 fingerprints, so the open group stays bounded.
        rest: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            u, w = _meet(*(np.concatenate(x) for x in zip(*rest, strict=True)), radius)
            rest.clear()
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(w.view(np.int64))], ["u", "v"])

        for b in batches:
            keys, values = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            if not len(keys):
                continue
            open_at = int(np.searchsorted(keys, keys[-1]))
            if open_at or (rest and rest[-1][0][-1] != keys[0]):
                rest.append((keys[:open_at], values[:open_at]))
                yield out()
            rest.append((keys[open_at:], values[open_at:]))
        if rest:
            yield out()

    return rows.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """One row (id, fp, component) for each row of docs; component is the smallest id reachable.

    A-Z are lower-cased; words are split at ASCII white space; a text with fewer words than a
    shingle counts as one shingle; a null, empty or blank text has fingerprint 0, which links
    like any other. Repeated rows and equal texts share a fingerprint and so a component. A
    null id never becomes a component's id unless all its ids are null. Other columns of docs
    are not read. An empty table gives no rows.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    own = fps.groupBy("fp").agg(F.min("id").alias("least"))
    roots = connected_components(links(own.select("fp"), radius))
    rooted = own.join(roots, own.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "rooted")
    component = rooted.groupBy("root").agg(F.min("least").alias("component"))
    by_fp = split_join(rooted, component, ["root"]).select("fp", "component")
    return fps.join(by_fp, "fp").select("id", "fp", "component")


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document.

    The class of keys is not the whole ball of half the radius over 64 bits, but for each 16-bit block
    left out the ball of radius one over the other 48: see the module for why no link is lost.
    """
    from folioflow.llm.common import documents

    found = near_duplicates(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
