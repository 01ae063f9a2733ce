"""Maximum inner product search with score-aware anisotropic quantisation.

Product quantisation with 16 centres per subspace, so a code is four bits. Assignment and
centres minimise eta * |parallel residual|^2 + |orthogonal residual|^2, as the residual along
a vector is what shifts its large inner products. A query scans a block of codes with tables of
partial scores, two codes (a byte) at a time; the block's best by that score, ties and all by
smaller id, are reranked by exact inner products in double precision. Then every row whose code, by the
length of what it leaves out, could still reach the k-th of these is reranked too. So a block loses
nothing, however uneven the lengths of vectors are or how close they lie.

Every row lies in one coarse cell of about CELL_ROWS rows. A query goes to the cells whose
centres score best, as many as held RECALL of the neighbours that queries have among the rows of the sample; so
clustered vectors need few cells whatever their number, and vectors without structure need most.
A cell's rows travel once for each QUERIES_PER_BLOCK of the queries that it gets, and large
cells are cut into blocks, so a vector that very many rows share is many tasks.

Centres and codebooks are fitted on a bounded, documented sample; every row is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.common import materialize

#: Bound of the rows that the codebooks are fitted on (in expectation; rows are chosen by hash).
TRAIN_ROWS = 8192
#: Rows a cell, up to MOST_CELLS, whose centres are fitted on TRAIN_ROWS or ROWS_PER_CENTRE rows a cell.
CELL_ROWS, MOST_CELLS, ROWS_PER_CENTRE = 8192, 4096, 32
#: Share of the neighbours within the sample that the cells searched must hold, and the rows that judge it.
RECALL, JUDGES = 0.97, 256
CANDIDATES_PER_BLOCK, QUERIES_PER_BLOCK = 8192, 8192
RERANK = 200
#: Larger components are cut to this size where only approximate scores are computed.
LARGEST = 1e7
CENTRES, THRESHOLD, ROUNDS = 16, 0.2, 8
#: Share of the lengths by which sums of single precision may be off.
ROUNDING = 1e-5


class Quantiser:
    """Codebooks of shape (subspaces, 16, width); the last subspace is padded with zeros."""

    def __init__(self, books: np.ndarray, dim: int, eta: float):
        self.books, self.dim, self.eta = books, dim, eta

    @property
    def subspaces(self) -> int:
        return len(self.books)

    def split(self, x: np.ndarray) -> np.ndarray:
        m, _, w = self.books.shape
        out = np.zeros((len(x), m * w), np.float32)
        out[:, : self.dim] = np.clip(x, -LARGEST, LARGEST)
        return out.reshape(len(x), m, w)

    def assign(self, x: np.ndarray, rounds: int = 2) -> np.ndarray:
        """Codes (rows, subspaces) by coordinate descent on the anisotropic loss."""
        parts = self.split(x)
        weight = (self.eta - 1) / np.maximum((parts**2).sum((1, 2)), 1e-30)
        codes = np.empty(parts.shape[:2], np.uint8)
        along = np.empty(parts.shape[:2], np.float32)  # each subspace's share of the parallel residual
        rows = np.arange(len(x))
        plain, share = [], []
        for j, book in enumerate(self.books):
            gap = parts[:, j, None, :] - book[None]
            plain.append((gap**2).sum(2))
            share.append((gap * parts[:, j, None, :]).sum(2))
            codes[:, j] = plain[j].argmin(1)
            along[:, j] = share[j][rows, codes[:, j]]
        total = along.sum(1)
        for _ in range(rounds):
            for j in range(self.subspaces):
                rest = total - along[:, j]
                cost = plain[j] + weight[:, None] * (rest[:, None] + share[j]) ** 2
                codes[:, j] = cost.argmin(1)
                along[:, j] = share[j][rows, codes[:, j]]
                total = rest + along[:, j]
        return codes

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Two four-bit codes a byte."""
        codes = self.assign(x)
        if codes.shape[1] % 2:
            codes = np.concatenate((codes, np.zeros((len(codes), 1), np.uint8)), axis=1)
        return codes[:, 0::2] | codes[:, 1::2] << 4

    def left_out(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """For rows x and their codes (bytes, rows): by how much at most the scan of a query of length 1
        differs from the inner product. Not finite where lengths are beyond double precision."""
        both = np.stack((codes & 15, codes >> 4), axis=1).reshape(-1, codes.shape[1])[: self.subspaces]
        back = np.concatenate([book[c] for book, c in zip(self.books, both, strict=True)], axis=1)[:, : self.dim]
        wide = x.astype(np.float64)
        with np.errstate(over="ignore", invalid="ignore"):
            return np.sqrt(((wide - back) ** 2).sum(1)) + ROUNDING * (np.sqrt((wide**2).sum(1)) + np.sqrt((back.astype(np.float64) ** 2).sum(1)))

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Partial scores (pairs of subspaces, 256) of one query."""
        part = np.einsum("mcw,mw->mc", self.books, self.split(q[None])[0])
        if len(part) % 2:
            part = np.concatenate((part, np.zeros((1, CENTRES), part.dtype)))
        return (part[1::2, :, None] + part[0::2, None, :]).reshape(len(part) // 2, 256).astype(np.float32)


def fit(x: np.ndarray, width: int = 2, threshold: float = THRESHOLD, rounds: int = ROUNDS) -> Quantiser:
    """Codebooks for rows x, from any order of equal rows' multiset deterministically."""
    x = np.clip(x[np.lexsort(x.T[::-1])], -LARGEST, LARGEST).astype(np.float32)
    dim = x.shape[1]
    eta = max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))
    m = -(-dim // width)
    rng = np.random.default_rng(0)
    quantiser = Quantiser(np.zeros((m, CENTRES, width), np.float32), dim, eta)
    parts = quantiser.split(x)
    quantiser.books[:] = parts[rng.choice(len(x), CENTRES, replace=len(x) < CENTRES)].transpose(1, 0, 2)
    weight = (eta - 1) / np.maximum((parts**2).sum((1, 2)), 1e-30)
    for _ in range(rounds):
        codes = quantiser.assign(x, 1)
        chosen = quantiser.books[np.arange(m)[None], codes]
        along = ((parts - chosen) * parts).sum(2)
        total = along.sum(1)
        for j in range(m):
            p = parts[:, j]
            rest = total - along[:, j]
            gram = weight[:, None, None] * p[:, :, None] * p[:, None, :]
            target = p + (weight * (rest + (p**2).sum(1)))[:, None] * p
            for c in range(CENTRES):
                own = codes[:, j] == c
                if own.any():
                    left = own.sum() * np.eye(width) + gram[own].sum(0)
                    quantiser.books[j, c] = np.linalg.solve(left, target[own].sum(0))
            along[:, j] = ((p - quantiser.books[j, codes[:, j]]) * p).sum(1)
            total = rest + along[:, j]
    return quantiser


def scan(quantiser: Quantiser, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Approximate inner products of one query with a block of codes (bytes, rows)."""
    score = np.zeros(codes.shape[1], np.float32)
    for table, column in zip(quantiser.tables(q), codes, strict=True):
        score += table[column]
    return score


def best(score: np.ndarray, n: int) -> np.ndarray:
    """Indexes of the n largest scores; of equal ones the first."""
    if n >= len(score):
        return np.arange(len(score))
    least = np.partition(score, len(score) - n)[len(score) - n]
    above = np.flatnonzero(score > least)
    return np.concatenate((above, np.flatnonzero(score == least)[: n - len(above)]))


def reaching(quantiser: Quantiser, q: np.ndarray, codes: np.ndarray, slack: np.ndarray, wide: np.ndarray, allowed: np.ndarray, k: int, keep: int) -> np.ndarray:
    """Indexes of rows among which are the k of largest inner product with q, ties included, of those allowed. slack:
    Quantiser.left_out of the rows; wide: the rows in double precision; keep: how many are tried first."""
    score = scan(quantiser, q, codes).astype(np.float64)
    score[~allowed] = -np.inf
    own = q.astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        first = wide[best(score, keep + 1)] @ own
        if len(first) <= k or not np.isfinite(first).all() or np.abs(own).max() > LARGEST:
            return np.flatnonzero(allowed)
        length = np.sqrt((own**2).sum())
        # The row left out may be among the first, so one more is counted.
        least = np.partition(first, len(first) - k - 1)[len(first) - k - 1]
        at = np.flatnonzero(allowed & ~(score + length * slack < least))
        if len(at) <= keep:
            return at
        exact = wide[at] @ own
        if not np.isfinite(exact).all():
            return at
        least = np.partition(exact, len(exact) - k)[len(exact) - k]
        # What the order of a sum may change is far less than that share of the slack.
        return at[exact >= least - 1e-7 * length * slack[at]]


class Cells:
    """Centres of coarse cells, and how many of the best a query is to search."""

    def __init__(self, centres: np.ndarray, probes: int):
        self.centres, self.probes = centres, probes

    def of(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row: that of the nearest centre."""
        x = np.clip(x, -LARGEST, LARGEST).astype(np.float32)
        half = (self.centres**2).sum(1) / 2
        return np.concatenate([(x[i : i + 4096] @ self.centres.T - half).argmax(1) for i in range(0, len(x), 4096)] or [np.empty(0, np.int64)])

    def ranked(self, q: np.ndarray) -> np.ndarray:
        """Cells by the inner products of their centres with each query, best first."""
        return np.argsort(-(np.clip(q, -LARGEST, LARGEST).astype(np.float32) @ self.centres.T), axis=1, kind="stable")


def partition(x: np.ndarray, cells: int, k: int, recall: float = RECALL, rounds: int = 6, queries: np.ndarray | None = None) -> Cells:
    """Cells for rows x of a sample. probes: the fewest best cells that hold the recall of the k best
    neighbours that some queries, or without these JUDGES of the rows, have among the sample's others. Farther apart
    than in the whole table, these are spread over more cells than the neighbours that a search is for."""
    x = np.clip(x[np.lexsort(x.T[::-1])], -LARGEST, LARGEST).astype(np.float32)
    if cells == 1 or len(x) <= cells:
        return Cells(x[:1], 1)
    rng = np.random.default_rng(0)
    found = Cells(x[rng.choice(len(x), cells, replace=False)].copy(), cells)
    for _ in range(rounds):
        own = found.of(x)
        n = np.bincount(own, minlength=cells)
        for j in range(x.shape[1]):
            sums = np.bincount(own, weights=x[:, j], minlength=cells)
            found.centres[n > 0, j] = (sums[n > 0] / n[n > 0]).astype(np.float32)
    judges = x[rng.choice(len(x), min(JUDGES, len(x)), replace=False)] if queries is None or not len(queries) else np.clip(queries, -LARGEST, LARGEST).astype(np.float32)
    own, score, places = found.of(x), judges @ x.T, {v.tobytes(): i for i, v in enumerate(x)}
    # A judge is no neighbour of its own, where the sample holds it.
    for i, v in enumerate(judges):
        if v.tobytes() in places:
            score[i, places[v.tobytes()]] = -np.inf
    k = min(k, len(x) - 1)
    near = np.argpartition(-score, k - 1, axis=1)[:, :k]
    place = np.empty((len(judges), cells), np.int64)
    np.put_along_axis(place, found.ranked(judges), np.arange(cells)[None], axis=1)
    held = np.cumsum(np.bincount(place[np.arange(len(judges))[:, None], own[near]].ravel(), minlength=cells)) / near.size
    found.probes = int(np.searchsorted(held, recall)) + 1
    return found


def valid_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Rows (id, v) without null ids and vectors that are null, empty, zero or not finite; without repeats.
    v keeps single precision where that is what df holds, else it has double precision."""
    kind = df.select(F.col(f"`{vec_col}`")).schema[0].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    v = F.col(f"`{vec_col}`").cast("array<float>" if single else "array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists("v", lambda x: x != 0)).distinct()


SCHEMA = "query_id long, rank int, vec_id long, score double"


def search(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", rerank: int = RERANK, recall: float = RECALL, exact: bool = False) -> DataFrame:
    """The k nearest found of each query: (query_id, rank, vec_id, score).

    vectors: all candidates; the rows for which is_query (a condition on id) holds are the
    queries. A query's own id is no candidate. score is the inner product of the vectors as
    given, in double precision; ties go to the smaller id. Of the cells searched none of the nearest
    is missed; rerank is how many of a block are tried before bounds tell which others to try. Vectors that are null, empty, zero
    or not finite take no part, nor do rows with a null id; equal rows count once; of several
    vectors with one id the best scoring counts. Vectors of different lengths have no inner
    product: a query meets those of its own length, each length is searched for itself. exact
    compares every query with every candidate. An empty table gives no rows.
    """
    rows = valid_vectors(vectors, id_col, vec_col)
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).where("q > 0").orderBy(F.desc("n"), "d").collect()  # one row a length
    out = vectors.sparkSession.createDataFrame([], SCHEMA)
    for i, s in enumerate(sizes):
        found = _search(rows.where(F.size("v") == s.d), is_query, s.d, s.n, k, rerank, recall, exact)
        out = out.unionAll(found) if i else found
    return out


def _search(rows: DataFrame, is_query, dim: int, n: int, k: int, rerank: int, recall: float, exact: bool) -> DataFrame:
    """search() over n valid rows (id, v) of one length."""
    spark, kind = rows.sparkSession, rows.schema["v"].dataType
    cells = 1 if exact else max(1, min(MOST_CELLS, -(-n // CELL_ROWS)))
    share = min(1.0, max(TRAIN_ROWS, ROWS_PER_CENTRE * cells) / n)
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1.0)).select("v").toArrow()
    x = sample["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
    x = x if len(x) else np.eye(1, dim, dtype=np.float32)
    x = x[np.lexsort(x.T[::-1])]
    train = x[np.random.default_rng(1).permutation(len(x))[:TRAIN_ROWS]] if len(x) > 2 * TRAIN_ROWS else x
    # At most JUDGES of the queries, by hash, judge the cells.
    judges = rows.where(is_query).orderBy(F.xxhash64("id", F.lit(3)), "id").limit(JUDGES).select("v").toArrow()["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim) if cells > 1 else None
    shared = spark.sparkContext.broadcast((fit(train), partition(x, cells, k, recall, queries=judges)))
    keep = n if exact else rerank

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantiser, coarse = shared.value
        for b in batches:
            for i in range(0, b.num_rows, CANDIDATES_PER_BLOCK):
                part = b.slice(i, CANDIDATES_PER_BLOCK)
                v = part.column("v").flatten().to_numpy().reshape(-1, dim)
                probed = [r.astype(np.int32) if q else None for r, q in zip(coarse.ranked(v)[:, : coarse.probes], part.column("query").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("v"), pa.array([c.tobytes() for c in quantiser.encode(v)], pa.binary()), pa.array(coarse.of(v).astype(np.int32)), pa.array(probed, pa.list_(pa.int32()))], ["id", "v", "code", "cell", "probed"])

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", kind), T.StructField("code", T.BinaryType()), T.StructField("cell", T.IntegerType()), T.StructField("probed", T.ArrayType(T.IntegerType()))])
    placed = materialize(rows.withColumn("query", is_query).mapInArrow(place, schema), "cells")
    asked = placed.where("probed is not null").select("id", "v", F.explode("probed").alias("cell"))
    # Blocks of each cell and of the queries that it gets; a row a cell.
    blocks = placed.groupBy("cell").agg(F.ceil(F.count("*") / CANDIDATES_PER_BLOCK).cast("int").alias("blocks"))
    groups = asked.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES_PER_BLOCK).cast("int").alias("groups"))
    plan = F.broadcast(materialize(blocks.join(groups, "cell"), "cell-blocks"))
    own = lambda count: F.pmod(F.xxhash64("id", F.lit(7)), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    candidates = placed.select("id", "v", "code", "cell").join(plan, "cell").withColumn("cb", own("blocks")).withColumn("qb", every("groups")).drop("blocks", "groups")
    queries = asked.join(plan, "cell").withColumn("qb", own("groups")).withColumn("cb", every("blocks")).drop("blocks", "groups")
    # Both come from one table: names of their own keep the columns apart.
    queries = queries.select(*[F.col(c).alias(f"q_{c}") for c in ("id", "v", "cell", "cb", "qb")])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            quantiser = shared.value[0]
            left = left.sort_by("id")
            ids = left["id"].to_numpy()
            # Where an id has several vectors, k rows may be fewer ids.
            alone = len(np.unique(ids)) < len(ids)
            x = left["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
            codes = np.ascontiguousarray(np.frombuffer(b"".join(left["code"].to_pylist()), np.uint8).reshape(len(ids), -1).T)
            wide, slack = x.astype(np.float64), quantiser.left_out(x, codes)
            for own, q in zip(right["q_id"].to_pylist(), right["q_v"].combine_chunks().flatten().to_numpy().reshape(-1, dim), strict=True):
                others = ids != own
                at = np.flatnonzero(others) if alone or keep >= len(ids) else reaching(quantiser, q, codes, slack, wide, others, k, keep)
                exact = (wide[at] * q.astype(np.float64)).sum(1)
                order = np.lexsort((ids[at], -exact))
                # An id with several vectors may come more than once; its best comes first.
                _, first = np.unique(ids[at][order], return_index=True)
                order = order[np.sort(first)][:k]
                out[0] += [own] * len(order)
                out[1].append(ids[at][order])
                out[2].append(exact[order])
        cat = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(cat(out[1], np.int64)), "score": pa.array(cat(out[2], np.float64))})

    key = ("cell", "cb", "qb")
    pairs = candidates.groupBy(*key).cogroup(queries.groupBy(*[f"q_{c}" for c in key])).applyInArrow(meet, "query_id long, vec_id long, score double")
    single = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return single.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_mips(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of every row whose vec_id is divisible by 20, by inner product."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0)
