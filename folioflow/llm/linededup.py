"""Line dedup: a sharded minimal perfect hash over all distinct line hashes.

1. Every document gives its distinct line hashes; a partial aggregate counts the documents of
   each hash and finds the largest id that holds it.
2. Each shard of the hashes gets a minimal perfect hash that indexes compact arrays: a 32-bit
   fingerprint, a saturating count, and the owners of the frequent lines.
3. Documents probe the arrays: each Arrow batch of documents sends one packed row per shard,
   with each distinct hash once, and gets back which of its lines to drop. Lines never meet
   lines in a join. A shard that very many occurrences probe is copied, by its counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm import mph
from folioflow.llm.common import NULL_IDS, documents, materialize, row_ids, slices

SPACE = b" \t\n\x0b\x0c\r"
KEYS_PER_SHARD = 250_000
PROBES_PER_COPY = 4_000_000
LEAST = -(2**63)


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key of a line in UTF-8, or None if it has under min_chars code points."""
    key = line.strip(SPACE).lower()
    n = len(key)
    return key if n >= 4 * min_chars or n >= min_chars and len(key.decode("utf-8", "replace")) >= min_chars else None


def key_hash(key: bytes) -> tuple[int, int]:
    """Signed 64-bit hash and signed 32-bit fingerprint of a key."""
    d = xxhash.xxh3_128_intdigest(key)
    h, f = d & (2**64 - 1), d >> 64 & (2**32 - 1)
    return h - 2**64 if h >> 63 else h, f - 2**32 if f >> 31 else f


def _batch_keys(b: pa.RecordBatch, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, fingerprint and id of the distinct keys of each document of a batch."""
    h, f, at, seen = [], [], [], {}
    for i, text in enumerate(b.column("text").cast(pa.binary()).to_pylist()):
        keys = {k for x in (text or b"").split(b"\n") if (k := line_key(x, min_chars)) is not None}
        for k in keys:
            pair = seen.get(k)
            if pair is None:
                pair = seen[k] = key_hash(k)
            h.append(pair[0])
            f.append(pair[1])
        at.append(len(keys))
    ids = np.repeat(b.column("id").to_numpy(zero_copy_only=False), at)
    return np.array(h, np.int64), np.array(f, np.int32), ids.astype(np.int64)


def _build_shard(t: pa.Table, min_docs: int) -> dict:
    order = np.lexsort((t["f"].to_numpy(), t["h"].to_numpy()))
    h, f, n, owner = (t[c].to_numpy()[order] for c in ("h", "f", "n", "owner"))
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    data = mph.build(h[first].view(np.uint64))
    index = mph.Function(data)(h[first].view(np.uint64))
    fps, counts, owners = np.empty(len(index), np.int32), np.empty(len(index), np.uint8), np.empty(len(index), np.int64)
    fps[index], counts[index], owners[index] = f[first], np.minimum(n[first], 255), owner[first]
    # Lines whose 64-bit hashes collide keep all but the first in a short exact list.
    rest = np.stack([x[~first].astype(np.int64) for x in (h, f, np.minimum(n, 255), owner)])
    return {"mph": data, "fps": fps.tobytes(), "counts": counts.tobytes(), "owners": owners[counts >= min_docs].tobytes(), "rest": rest.tobytes(), "copies": int(-(-int(n.sum()) // PROBES_PER_COPY))}


class Shard:
    """The arrays of one shard, ready to be probed."""

    def __init__(self, row: dict, min_docs: int):
        self.index = mph.Function(row["mph"])
        self.fps, self.counts = np.frombuffer(row["fps"], np.int32), np.frombuffer(row["counts"], np.uint8)
        self.frequent = self.counts >= min_docs
        self.rank, self.owners = np.cumsum(self.frequent) - 1, np.frombuffer(row["owners"], np.int64)
        self.rest = {(h, f): (n >= min_docs, o) for h, f, n, o in np.frombuffer(row["rest"], np.int64).reshape(4, -1).T.tolist()}

    def probe(self, h: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each line is frequent, and the owner of those that are."""
        at = self.index(h.view(np.uint64))
        known = (at >= 0) & (self.fps[at] == f)
        hit = known & self.frequent[at]
        owner = np.full(len(h), LEAST, np.int64)
        owner[hit] = self.owners[self.rank[at[hit]]]
        for i in np.flatnonzero(~known) if self.rest else ():
            hit[i], owner[i] = self.rest.get((int(h[i]), int(f[i])), (False, LEAST))
        return hit, owner


INDEX_SCHEMA = "shard long, mph binary, fps binary, counts binary, owners binary, rest binary, copies long"


def build_index(lines: DataFrame, min_docs: int) -> tuple[DataFrame, int]:
    """The shards over lines(h, f, n, owner), and their number."""
    shards = max(1, -(-lines.count() // KEYS_PER_SHARD))

    def build(key: tuple, t: pa.Table) -> pa.Table:
        row = _build_shard(t, min_docs)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64())} | {k: pa.array([v], pa.int64() if k == "copies" else pa.binary()) for k, v in row.items()})

    keyed = lines.withColumn("shard", F.pmod("h", F.lit(shards)))
    return materialize(keyed.groupBy("shard").applyInArrow(build, INDEX_SCHEMA), "line-index"), shards


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """docs with the text less its repeated lines, and columns n_lines and n_dropped (long).

    A text is split at \\n; a null or empty text is one empty line and comes back empty. A line's
    key is the line without ASCII white space at both ends, A-Z lower-cased. A key of at least
    min_chars code points that at least min_docs documents hold loses all its lines except those
    in the document with the largest id that holds it. Rows that share an id are one document and
    all keep or lose a line. Rows with a null id are documents of their own, each counted, with ids
    below -2**62 by a hash of the text; of those equal texts keep or lose a line together. Input
    columns named n_lines or n_dropped are replaced; all others stay as they are. An empty table
    gives an empty result.
    """
    new = {"n_lines", "n_dropped"}
    keep = [c for c in docs.columns if c not in new]
    ids = row_ids(id_col, text_col)
    slim = docs.select(ids.alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _batch_keys(b, min_chars)], ["h", "f", "id"])

    held = slim.mapInArrow(emit, "h long, f int, id long").groupBy("h", "f", "id").agg(F.count("*").alias("rows"))
    n = F.sum(F.when(F.col("id") < NULL_IDS, F.col("rows")).otherwise(1))
    lines = held.groupBy("h", "f").agg(n.alias("n"), F.max("id").alias("owner"))
    index, shards = build_index(materialize(lines, "lines"), min_docs)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One row a shard: each distinct hash once, and how many of the ids that follow are its own.
        for b in slices(batches, 4096):
            h, f, ids = _batch_keys(b, min_chars)
            if not len(h):
                continue
            shard = h % shards
            order = np.lexsort((f, h, shard))
            h, f, ids, shard = h[order], f[order], ids[order], shard[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (f[1:] != f[:-1])
            at = np.flatnonzero(new)
            sizes = np.diff(np.append(at, len(h))).astype(np.int64)
            cuts = np.flatnonzero(np.diff(shard[at], prepend=-1))
            for i, j in zip(cuts, np.append(cuts[1:], len(at)), strict=True):
                end = at[j] if j < len(at) else len(h)
                yield pa.RecordBatch.from_pydict({"shard": pa.array([shard[at[i]]], pa.int64()), "h": [h[at[i:j]].tobytes()], "f": [f[at[i:j]].tobytes()], "sizes": [sizes[i:j].tobytes()], "ids": [ids[at[i] : end].tobytes()]})

    copies = index.where("copies > 1").select("shard", "copies")
    probes = slim.mapInArrow(pack, "shard long, h binary, f binary, sizes binary, ids binary").join(copies, "shard", "left")
    probes = probes.withColumn("copy", F.pmod(F.xxhash64("ids"), F.coalesce("copies", F.lit(1)))).drop("copies")
    copied = index.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        out_id, out_h = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if left.num_rows and right.num_rows:
            shard = Shard(right.slice(0, 1).to_pylist()[0], min_docs)
            for h, f, sizes, ids in zip(*(left[c] for c in ("h", "f", "sizes", "ids")), strict=True):
                h, f, sizes, ids = (np.frombuffer(x.as_buffer(), t) for x, t in ((h, np.int64), (f, np.int32), (sizes, np.int64), (ids, np.int64)))
                hit, owner = shard.probe(h, f)
                drop = np.repeat(hit, sizes) & (np.repeat(owner, sizes) != ids)
                out_id.append(ids[drop])
                out_h.append(np.repeat(h, sizes)[drop])
        return pa.table({"id": np.concatenate(out_id), "h": np.concatenate(out_h)})

    found = probes.groupBy("shard", "copy").cogroup(copied.groupBy("shard", "copy")).applyInArrow(probe, "id long, h long")
    drops = found.groupBy("id").agg(F.collect_set("h").alias("drops"))

    fields = [T.StructField(text_col, T.StringType()) if f.name == text_col else T.StructField(f.name, f.dataType) for f in docs.select(*[f"`{c}`" for c in keep]).schema]
    schema = T.StructType([*fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts, n_lines, n_dropped = [], [], []
            for text, drop in zip(b.column(len(keep)).cast(pa.binary()).to_pylist(), b.column(len(keep) + 1).to_pylist(), strict=True):
                lines = (text or b"").split(b"\n")
                n_lines.append(len(lines))
                if drop:
                    drop = set(drop)
                    lines = [x for x in lines if (k := line_key(x, min_chars)) is None or key_hash(k)[0] not in drop]
                texts.append(b"\n".join(lines))
                n_dropped.append(n_lines[-1] - len(lines))
            new_text = pa.array(texts, pa.binary()).cast(pa.string())
            columns = [new_text if c == text_col else b.column(i) for i, c in enumerate(keep)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*keep, "n_lines", "n_dropped"])

    # By number, so that no name of an input column can clash with these.
    carried = [(F.lit(None).cast("string") if c == text_col else F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(keep)]
    whole = docs.select(*carried, F.col(f"`{text_col}`").cast("string").alias("text"), ids.alias("id"))
    joined = whole.join(drops.hint("shuffle_hash"), "id", "left")
    return joined.select(*[f"c{i}" for i in range(len(keep))], "text", "drops").mapInArrow(apply, schema)


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Lines, dropped lines and the hash of the kept text of every document."""
    found = dedup_lines(documents(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT doc_id, line, i, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.line, k.i, s.key IS NOT NULL AND k.doc_id <> s.owner AS gone FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
