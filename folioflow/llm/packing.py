"""Packing of tokenised documents: shortest-pack-first over the length histogram.

A document is its token ids and an end id. Whole multiples of the sequence length fill
sequences of their own; what remains, shorter than a sequence, is packed by its length.
The driver sees only the histogram of remainders, at most one count per length, so its work
does not grow with the corpus. Packing places lengths from the longest down, each time onto
the shortest packs that have room, as counts of packing patterns. The emptiest patterns are
then taken apart again and their pieces cut to fill the gaps of the others. Documents get
their places back by rank within their length.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import build_side, documents, id_and_text, materialize, prefix_sums, slices

END_ID = 0
SPECIAL = "<|endoftext|>"


@lru_cache(maxsize=2)
def _encoders(json_path: str, ranks_path: str | None) -> tuple:
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(json_path)
    fast = None
    if ranks_path:
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return slow, fast


def token_ids(text: str | None, json_path: str, ranks_path: str | None = None) -> np.ndarray:
    """The ids of a text, as uint32. ranks_path: the same vocabulary as ranks, which encode faster;
    a text with a special token's string goes by json_path, which alone knows it."""
    if not text:
        return np.empty(0, np.uint32)
    slow, fast = _encoders(json_path, ranks_path)
    if fast is None or SPECIAL in text:
        return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
    return fast.encode_to_numpy(text, disallowed_special=())


@dataclass
class Group:
    """count packs that look alike; a slot is (length, first rank, start in the remainder, cut length, offset)."""

    count: int
    used: int = 0
    slots: list = field(default_factory=list)

    def split(self, n: int) -> Group:
        """Takes the first n packs off into a group of their own."""
        head = Group(n, self.used, list(self.slots))
        self.count -= n
        self.slots = [(length, rank + n, start, cut, offset) for length, rank, start, cut, offset in self.slots]
        return head

    def add(self, length: int, rank: int, start: int, cut: int) -> None:
        self.slots.append((length, rank, start, cut, self.used))
        self.used += cut


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[Group]:
    """Packing patterns with counts for histogram[length] pieces, longest lengths first."""
    heap: list = []  # by used; the serial number settles ties
    serial, full = 0, []

    def put(g: Group) -> None:
        nonlocal serial
        serial += 1
        if g.used == size:
            full.append(g)
        else:
            heapq.heappush(heap, (g.used, serial, g))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        later = []
        while left and heap and heap[0][0] + length <= size:
            _, _, g = heapq.heappop(heap)
            n = min(left, g.count)
            head = g.split(n)
            head.add(length, rank, 0, length)
            rank, left = rank + n, left - n
            later.append(head)
            if g.count:
                later.append(g)
                break  # left is 0
        for g in later:
            put(g)
        # What found no room opens packs; more of the same length join them while there is room.
        fit = size // length
        if left >= fit > 1 and (n := left // fit):
            g = Group(n)
            for i in range(fit):
                g.add(length, rank + i * n, 0, length)
            put(g)
            rank, left = rank + n * fit, left - n * fit
        if left:
            if fit > 1:
                g = Group(1)
                for i in range(left):
                    g.add(length, rank + i, 0, length)
            else:
                g = Group(left)
                g.add(length, rank, 0, length)
            put(g)
    return full + [g for _, _, g in sorted(heap, key=lambda x: x[:2])]


def fill_gaps(groups: list[Group], size: int) -> list[Group]:
    """Cuts the pieces of the emptiest packs to fill the gaps of the others, in counts.

    Afterwards at most one pack is not full.
    """
    done = [g for g in groups if g.used == size]
    takers = [g for g in groups if g.used < size]
    pieces: list = []  # (length, rank, start, cut, count), from the emptiest packs
    while takers:
        if not pieces:  # just as many of the emptiest packs as fill all the others
            donor = takers.pop(min(range(len(takers)), key=lambda i: (takers[i].used, -takers[i].count)))
            need = sum((size - g.used) * g.count for g in takers) + (size - donor.used) * donor.count
            n = min(donor.count, -(-need // size))
            head = donor if n == donor.count else donor.split(n)
            if head is not donor:
                takers.append(donor)
            pieces = [(length, rank, start, cut, n) for length, rank, start, cut, _ in head.slots]
            if not takers:
                break
        # The largest counts meet first; else single packs would nibble at large groups one by one.
        g = takers.pop(max(range(len(takers)), key=lambda i: takers[i].count))
        length, rank, start, cut, count = pieces.pop(max(range(len(pieces)), key=lambda i: pieces[i][4]))
        n = min(g.count, count)
        head = g if g.count == n else g.split(n)
        if head is not g:
            takers.append(g)
        if count > n:
            pieces.append((length, rank + n, start, cut, count - n))
        room = size - head.used
        head.add(length, rank, start, min(cut, room))
        if cut > room:
            pieces.append((length, rank, start + room, cut - room, n))
        if head.used == size:
            done.append(head)
        else:
            takers.append(head)
    # Less than a pack is left of the last donor.
    if pieces:
        last = Group(1)
        for length, rank, start, cut, count in pieces:
            for i in range(count):
                last.add(length, rank + i, start, cut)
        done.append(last)
    return done


def placements(histogram: dict[int, int], size: int) -> np.ndarray:
    """Rows (length, first rank, ranks, start, cut length, first sequence, offset), by length and rank.

    The piece of rank r of that length, from start on, lies in sequence (first sequence + r -
    first rank). Their number is at most of the order of size squared, whatever the corpus.
    """
    rows, sequence = [], 0
    for g in fill_gaps(shortest_pack_first(histogram, size), size):
        rows += [(length, rank, g.count, start, cut, sequence, offset) for length, rank, start, cut, offset in g.slots]
        sequence += g.count
    return np.array(sorted(rows), np.int64).reshape(-1, 7)


def tokens(docs: DataFrame, json_path: str, ranks_path: str | None, id_col: str, text_col: str, size: int) -> DataFrame:
    """Rows (id, bucket, n, ids as uint32, rest, rank within bucket and rest, fulls before in the bucket).

    A bucket is what one task wrote. The table is written once, so the ranks hold from then on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, ranks, fulls = TaskContext.get().partitionId(), {}, 0
        for b in slices(batches):
            ids, ns, data, rests, at, before = b.column("id"), [], [], [], [], []
            for text in b.column("text").to_pylist():
                found = np.append(token_ids(text, json_path, ranks_path), np.uint32(END_ID))
                full, rest = divmod(len(found), size)
                ns.append(len(found))
                data.append((found.astype(np.uint16) if found.max() < 1 << 16 else found).tobytes())
                rests.append(rest)
                at.append(ranks.get(rest, 0))
                before.append(fulls)
                ranks[rest] = at[-1] + 1
                fulls += full
            yield pa.RecordBatch.from_pydict({"id": ids, "bucket": pa.array([bucket] * len(ns), pa.int32()), "n": pa.array(ns, pa.int64()), "ids": pa.array(data, pa.binary()), "rest": pa.array(rests, pa.int32()), "rank": pa.array(at, pa.int64()), "fulls": pa.array(before, pa.int64())})

    schema = "id long, bucket int, n long, ids binary, rest int, rank long, fulls long"
    return materialize(id_and_text(docs, id_col, text_col).mapInArrow(run, schema), "tokens")


def pack(docs: DataFrame, json_path: str, ranks_path: str | None = None, size: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (array).

    Each row of docs is a document of its own, also when ids repeat or are null; a null or empty
    text has the end id alone. Every id lies in exactly one piece. At most one sequence is not
    full. Ties in length go by rank, that is by where a document was read. An empty table gives
    no rows. Other columns of docs are not read.
    """
    spark = docs.sparkSession
    table = tokens(docs, json_path, ranks_path, id_col, text_col, size)
    counts = materialize(table.groupBy("bucket", "rest").agg(F.count("*").alias("c"), F.sum(F.floor(F.col("n") / size)).alias("f")), "lengths")
    histogram = {r.rest: r.c for r in counts.where("rest > 0").groupBy("rest").agg(F.sum("c").alias("c")).collect()}  # under size rows
    places = placements(histogram, size)
    partial = int((places[:, 5] + places[:, 2]).max()) if len(places) else 0
    plan = spark.sparkContext.broadcast(places)

    # Where each bucket's ranks begin, by length, and its whole sequences: sums over the buckets before.
    base = prefix_sums(counts.select("rest", "bucket", "c"), "bucket", "c", "base", ("rest",))
    base = base.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("rest", "base"))).alias("bases"))  # under size entries
    fulls = prefix_sums(counts.groupBy("bucket").agg(F.sum("f").alias("f")), "bucket", "f", "full_base")
    # Written first, so that their true size decides whether the tokens have to be dealt out.
    base = materialize(base.join(fulls.drop("f"), "bucket"), "bases")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = plan.value
        lo, hi = np.searchsorted(rows[:, 0], np.arange(size + 1)), np.searchsorted(rows[:, 0], np.arange(size + 1), "right")
        for b in slices(batches):
            out: list[list] = [[] for _ in range(8)]
            for key, n, data, rest, rank, full in zip(*(b.column(c).to_pylist() for c in ("id", "n", "ids", "rest", "rank", "full")), strict=True):
                ids = np.frombuffer(data, np.uint16 if len(data) == 2 * n else np.uint32).astype("<u4")
                whole = n - rest
                pieces = [(i, size, partial + full + i // size, 0) for i in range(0, whole, size)]
                if rest:
                    own = rows[lo[rest] : hi[rest]]
                    own = own[(own[:, 1] <= rank) & (rank < own[:, 1] + own[:, 2])]
                    pieces += [(whole + start, cut, seq + rank - first, offset) for _, first, _, start, cut, seq, offset in own.tolist()]
                for start, length, seq, offset in pieces:
                    part = ids[start : start + length]
                    for column, x in zip(out, (key, start, length, zlib.crc32(part), n, seq, offset, part), strict=True):
                        column.append(x)
            ends = np.concatenate(([0], np.cumsum(out[2], dtype=np.int64))).astype(np.int32)
            values = np.concatenate(out[7]).view(np.int32) if out[7] else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out[:7]] + [pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    ranked = table.join(build_side(base), "bucket").withColumn("rank", F.col("rank") + F.coalesce(F.element_at("bases", F.col("rest")), F.lit(0))).withColumn("full", F.col("fulls") + F.col("full_base"))
    schema = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"
    return ranked.select("id", "n", "ids", "rest", "rank", "full").mapInArrow(run, schema)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence of 1,024 tokens."""
    path = public_tokenizers.path
    found = pack(documents(spark, sf_dir), path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"))
    return found.select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
