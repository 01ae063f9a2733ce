"""Merkle manifest of a dataset by a radix-ranked trie.

1. Every row becomes a leaf digest. Histograms of the 16-bit digits of its id, from the last digit up
   to the first, give its exact rank within its group: the sum, over the digits, of the counts of
   smaller digits below the same prefix. No table is sorted as a whole and no window holds more than
   65,537 rows. Rows that share an id are told apart by further digits, of the leaf, then of the row.
2. The digits of a rank to the base of the fan-out name the nodes above a leaf. Nodes that share all
   but their last six digits are reduced together, six levels of digests at once, until one node
   of each group is left. The groups' roots, ranked bytewise, form a trie of their own.
3. Going down again, each reduced piece gets the siblings above it, and its members add their own,
   so that a proof is put together where its leaf is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.common import build_side, documents, materialize, prefix_sums, slices

#: Levels of a trie that are reduced in one step, and bits of an id's digit.
SPAN, DIGIT_BITS = 6, 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def framed(c: Column) -> Column:
    """A value as its length in UTF-8 and itself; null as a dash."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*map(framed, columns)), 256)


def id_digits(c: Column) -> list[Column]:
    """The digits of a signed long, most significant first; null comes before all."""
    mask = F.lit((1 << DIGIT_BITS) - 1)
    first = F.when(c.isNull(), -1).otherwise(F.shiftright(c, 64 - DIGIT_BITS) + (1 << (DIGIT_BITS - 1)))
    return [first, *[F.coalesce(F.shiftright(c, s).bitwiseAND(mask), F.lit(0)) for s in range(64 - 2 * DIGIT_BITS, -1, -DIGIT_BITS)]]


def radix_ranks(counted: DataFrame, group: list[str], digits: list[str], n: str = "n") -> DataFrame:
    """counted(group..., digits..., n; distinct in all but n) with before: the sum of n over rows of the group
    whose digits come before. A digit's histogram is a window over its values below one prefix."""
    tables = [counted]
    for j in range(len(digits) - 1, 0, -1):
        tables.append(tables[-1].groupBy(*group, *digits[:j]).agg(F.sum(n).alias(n)))
    base = None
    for j, t in enumerate(reversed(tables), 1):
        below = Window.partitionBy(*group, *digits[: j - 1]).orderBy(digits[j - 1]).rowsBetween(Window.unboundedPreceding, -1)
        t = t.withColumn("before", F.coalesce(F.sum(n).over(below), F.lit(0)))
        if base is not None:
            t = t.join(base, [*group, *digits[: j - 1]]).withColumn("before", F.col("before") + F.col("__base")).drop("__base")
        base = t.select(*group, *digits[:j], F.col("before").alias("__base"))
    return t


def _ranked(leaves: DataFrame) -> tuple[DataFrame, int, int]:
    """leaves with pos, their rank within grp, and total, the grp's rows; the largest total and the number of groups."""
    d, e, s = ([f"{x}{i}" for i in range(1, 5)] for x in "des")
    keyed = leaves.select("*", *[c.alias(x) for x, c in zip(d, id_digits(F.col("id")), strict=True)])
    ranks = materialize(radix_ranks(keyed.groupBy("grp", *d).agg(F.count("*").alias("n")), ["grp"], d), "ranks")
    placed = keyed.join(build_side(ranks), ["grp", *d])
    single = placed.select("grp", "id", "leaf", "other", F.col("before").alias("pos"))
    totals = materialize(ranks.groupBy("grp").agg(F.sum("n").alias("total"), F.max("n").alias("equal")), "totals")
    all_of = totals.agg(F.max("total").alias("total"), F.max("equal").alias("equal"), F.count("*").alias("groups")).first()
    if (all_of.equal or 0) > 1:
        # Equal ids: by the leaf's first 64 bits, then by the row's number, which also splits equal rows.
        again = placed.where("n > 1").withColumnRenamed("before", "first")
        for i, x in enumerate(e):
            again = again.withColumn(x, F.conv(F.substring("leaf", 4 * i + 1, 4), 16, 10).cast("long"))
        for x, c in zip(s, id_digits(F.col("row")), strict=True):
            again = again.withColumn(x, c)
        again = radix_ranks(again.withColumn("n", F.lit(1)), ["grp", *d], [*e, *s])
        single = placed.where("n = 1").select("grp", "id", "leaf", "other", F.col("before").alias("pos"))
        single = single.unionByName(again.select("grp", "id", "leaf", "other", (F.col("first") + F.col("before")).alias("pos")))
    return single.join(build_side(totals).drop("equal"), "grp"), all_of.total or 0, all_of.groups


def heights(total: int, fanout: int, span: int) -> int:
    """Levels above so many nodes, span at most."""
    h = 0
    while h < span and fanout**h < total:
        h += 1
    return h


def _tower(digests: list[str], total: int, fanout: int, span: int) -> list[list[str]]:
    """The levels of one piece, from its own nodes up."""
    out = [digests]
    for _ in range(heights(total, fanout, span)):
        out.append([sha256("".join(out[-1][i : i + fanout])) for i in range(0, len(out[-1]), fanout)])
    return out


def _siblings(tower: list[list[str]], i: int, fanout: int) -> list[tuple[str, str]]:
    """What stands left and right of the node's ancestors in their runs, level by level."""
    out = []
    for level in tower[:-1]:
        run = i - i % fanout
        out.append(("".join(level[run:i]), "".join(level[i + 1 : run + fanout])))
        i //= fanout
    return out


def _written(path: list[tuple[str, str]]) -> str:
    return "".join(f"{a},{b};" for a, b in path)


def _read(path: str) -> list[tuple[str, str]]:
    return [tuple(x.split(",")) for x in path.split(";")[:-1]]


def _reduce(pieces: DataFrame, fanout: int, span: int) -> DataFrame:
    """(grp, pos, digest, total): the node of each piece(grp, piece, total, members sorted by pos)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            tops = [_tower(m, n, fanout, span)[-1][0] for m, n in zip(b.column("digests").to_pylist(), b.column("total").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("grp"), b.column("piece"), pa.array(tops, pa.string()), b.column("total")], ["grp", "pos", "digest", "total"])

    size = fanout**span
    up = pieces.select("grp", "piece", "total", F.transform("members", lambda m: m.leaf).alias("digests")).mapInArrow(run, "grp string, pos long, digest string, total long")
    return up.withColumn("total", F.ceil(F.col("total") / size).cast("long"))


def _pieces(nodes: DataFrame, size: int, *carried: str) -> DataFrame:
    """Nodes(grp, pos, leaf, total) by the ranks' digits but the last ones, size values of them: at most size members each."""
    return nodes.groupBy("grp", F.floor(F.col("pos") / size).alias("piece"), "total").agg(F.sort_array(F.collect_list(F.struct("pos", "leaf", *carried))).alias("members"))


class Trie:
    """The written pieces of every step, and the top node of each group; most: the largest total."""

    def __init__(self, nodes: DataFrame, most: int, name: str, fanout: int, span: int, *carried: str):
        size = fanout**span
        self.fanout, self.span, self.steps = fanout, span, [materialize(_pieces(nodes, size, *carried), f"{name}-pieces")]
        tops = _reduce(self.steps[0], fanout, span)
        while most > size:
            most = -(-most // size)
            self.steps.append(materialize(_pieces(tops.withColumnRenamed("digest", "leaf"), size), f"{name}-pieces"))
            tops = _reduce(self.steps[-1], fanout, span)
        self.tops = materialize(tops.select("grp", "digest"), f"{name}-tops")

    def with_paths(self, above: DataFrame) -> DataFrame:
        """The pieces of the first step with path, the siblings above them; above(grp, path) continues the
        groups' top nodes."""
        fanout, span = self.fanout, self.span

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, 4):
                for grp, piece, total, digests, path in zip(*(b.column(c).to_pylist() for c in ("grp", "piece", "total", "digests", "path")), strict=True):
                    tower = _tower(digests, total, fanout, span)
                    paths = [_written(_siblings(tower, i, fanout)) + path for i in range(len(digests))]
                    first = piece * fanout**span
                    yield pa.RecordBatch.from_arrays([pa.array([grp] * len(paths)), pa.array(range(first, first + len(paths)), pa.int64()), pa.array(paths)], ["grp", "piece", "path"])

        paths = above.withColumn("piece", F.lit(0).cast("long"))
        for step in self.steps[:0:-1]:
            met = step.join(paths, ["grp", "piece"]).select("grp", "piece", "total", F.transform("members", lambda m: m.leaf).alias("digests"), "path")
            paths = materialize(met.mapInArrow(run, "grp string, piece long, path string"), "paths")
        return self.steps[0].join(paths, ["grp", "piece"])


def _bytewise(tops: DataFrame) -> DataFrame:
    """(grp '', pos, leaf, name): the groups' roots with the ranks of their names, by ranges of names, each sorted by itself."""
    parts = tops.repartitionByRange("grp").sortWithinPartitions("grp")
    held = materialize(parts.select(F.col("grp").alias("name"), F.col("digest").alias("leaf"), F.monotonically_increasing_id().alias("at")), "roots")
    part, at = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    before = prefix_sums(held.groupBy(part.alias("part")).agg(F.count("*").alias("n")), "part", "n", "base")
    return held.withColumn("part", part).join(before, "part").select(F.lit("").alias("grp"), (F.col("base") + at).alias("pos"), "leaf", "name")


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "source", text_col: str = "text", found: Column | None = None, fanout: int = 3, span: int = SPAN) -> DataFrame:
    """One row (id, leaf, subroot, root, proof, folded, verified) for each row of docs.

    A leaf is the SHA-256 of the row's fields, each framed by its length, null as a dash. Leaves of a group
    ascend by id; null ids come first, rows that share an id go by their leaves; equal rows have equal
    leaves, so their order does not show but in whose place each stands. Every fanout nodes become the digest of
    their joined digests, the last run with fewer or one, until one is left; the groups' roots, null group
    first, then bytewise, likewise give the root. proof is the digest of all siblings from the leaf up. found: the
    text as it is found now (default: unchanged); folded is the root recomputed from it and the
    siblings, verified whether that is the root. span: levels that are reduced in one step. An empty table gives no rows; null and empty texts differ.
    Other columns are not read.
    """
    col = lambda c: F.col(f"`{c}`")
    own = [col(c) for c in fields]
    leaf = leaf_digest(own)
    later = leaf if found is None else F.when(found.eqNullSafe(col(text_col)), leaf).otherwise(leaf_digest([found if c == text_col else col(c) for c in fields]))
    grp = F.coalesce(F.concat(F.lit("s"), col(group_col).cast("string")), F.lit(""))
    leaves = materialize(docs.select(grp.alias("grp"), col(id_col).cast("long").alias("id"), leaf.alias("leaf"), later.alias("other"), F.monotonically_increasing_id().alias("row")), "leaves")
    ranked, most, groups = _ranked(leaves)
    trie = Trie(ranked, most, "rows", fanout, span, "id", "other")
    roots = _bytewise(trie.tops)
    above = Trie(roots.withColumn("total", F.lit(groups).cast("long")), groups, "groups", fanout, span, "name")
    sources = above.with_paths(above.tops.select("grp", F.lit("").alias("path")))
    top = above.tops.first()
    root = top.digest if top else None

    def to_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4):
            for members, total, path in zip(*(b.column(c).to_pylist() for c in ("members", "total", "path")), strict=True):
                tower = _tower([m["leaf"] for m in members], total, fanout, span)
                paths = [_written(_siblings(tower, i, fanout)) + path for i in range(len(members))]
                yield pa.RecordBatch.from_arrays([pa.array([m["name"] for m in members]), pa.array([m["leaf"] for m in members]), pa.array(paths)], ["grp", "subroot", "path"])

    of_groups = materialize(sources.select("members", "total", "path").mapInArrow(to_groups, "grp string, subroot string, path string"), "group-paths")
    rows = trie.with_paths(of_groups.select("grp", "path")).join(of_groups.select("grp", "subroot"), "grp")

    def to_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4):
            for members, total, path, subroot in zip(*(b.column(c).to_pylist() for c in ("members", "total", "path", "subroot")), strict=True):
                tower, rest = _tower([m["leaf"] for m in members], total, fanout, span), _read(path)
                proofs, folded = [], []
                for i, m in enumerate(members):
                    steps = _siblings(tower, i, fanout) + rest
                    proofs.append(sha256("".join(x for step in steps for x in step)))
                    node = m["other"]
                    for left, right in steps:
                        node = sha256(left + node + right)
                    folded.append(node)
                k = len(members)
                columns = [[m["id"] for m in members], [m["leaf"] for m in members], [subroot] * k, [root] * k, proofs, folded, [f == root for f in folded]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), *[pa.string()] * 5, pa.bool_()], strict=True)], ["id", "leaf", "subroot", "root", "proof", "folded", "verified"])

    return rows.select("members", "total", "path", "subroot").mapInArrow(to_rows, "id long, leaf string, subroot string, root string, proof string, folded string, verified boolean")


def op11_merkle(spark, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, held against a copy of which half the texts lost their line ends."""
    text = F.col("text")
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)
    found = manifest(documents(spark, sf_dir), found=changed)
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"), "verified")


OP11_SQL = r"""
WITH RECURSIVE poly AS (
  SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS t FROM range(256) AS r(b)),
d AS (SELECT row_number() OVER () AS r, *, CASE WHEN xor(list_reduce([ascii(x) FOR x IN string_split(CAST(doc_id AS VARCHAR), '')],
        lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295), 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS later
      FROM documents, poly),
f AS (SELECT r, doc_id, source, later, concat_ws('', coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-'),
        coalesce(octet_length(encode(source)) || ':' || source, '-'), coalesce(octet_length(encode(lang)) || ':' || lang, '-'),
        coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-')) AS head, text FROM d),
l AS (SELECT r, doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
        sha256(head || coalesce(octet_length(encode(later)) || ':' || later, '-')) AS other FROM f),
leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM l),
nodes(source, level, pos, n, digest) AS (
  SELECT source, 0, pos, n, leaf FROM leaves
  UNION ALL
  SELECT source, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY source, level, pos // 3, n),
subroots AS (SELECT source, digest, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(level, pos, n, digest) AS (
  SELECT 0, pos, n, digest FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 3, n),
steps AS (
  SELECT l.r, 0 AS part, x.level, coalesce(string_agg(x.digest, '' ORDER BY x.pos) FILTER (WHERE x.pos < l.pos // CAST(pow(3, x.level) AS BIGINT)), '') AS a,
         coalesce(string_agg(x.digest, '' ORDER BY x.pos) FILTER (WHERE x.pos > l.pos // CAST(pow(3, x.level) AS BIGINT)), '') AS b
  FROM leaves l JOIN nodes x ON x.source IS NOT DISTINCT FROM l.source AND x.n > 1 AND x.pos // 3 = l.pos // CAST(pow(3, x.level + 1) AS BIGINT) GROUP BY l.r, x.level
  UNION ALL
  SELECT l.r, 1, x.level, coalesce(string_agg(x.digest, '' ORDER BY x.pos) FILTER (WHERE x.pos < s.pos // CAST(pow(3, x.level) AS BIGINT)), ''),
         coalesce(string_agg(x.digest, '' ORDER BY x.pos) FILTER (WHERE x.pos > s.pos // CAST(pow(3, x.level) AS BIGINT)), '')
  FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source JOIN tops x ON x.n > 1 AND x.pos // 3 = s.pos // CAST(pow(3, x.level + 1) AS BIGINT) GROUP BY l.r, x.level),
proofs AS (SELECT r, sha256(string_agg(a || b, '' ORDER BY part, level)) AS proof, list({'a': a, 'b': b} ORDER BY part, level) AS path FROM steps GROUP BY r)
SELECT l.doc_id, l.leaf, s.digest AS subroot, t.digest AS root, coalesce(p.proof, sha256('')) AS proof_sha256,
       list_reduce([{'a': x.a, 'b': x.b} FOR x IN coalesce(p.path, [])], lambda c, x: {'a': sha256(x.a || c.a || x.b), 'b': ''}, {'a': l.other, 'b': ''}).a AS folded_root,
       folded_root = root AS verified
FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source CROSS JOIN (SELECT digest FROM tops WHERE n = 1) t LEFT JOIN proofs p USING (r)
"""
