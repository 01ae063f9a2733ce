"""Joins of boxes that overlap, by tiles of a hierarchical grid.

Levels are powers of eight: a box's level has tiles at least as wide as its longer side. Of two boxes the one of the
lower level, or else the right one, is placed by its upper left corner, in a single tile of the other's level; the
other one lies in all tiles that hold the corner of any such box it can meet, nine at most. So a pair meets once, pairs
met are pairs of neighbours, and a page with very many boxes is many keys. The corner's tile is one row for each
level of the other side, so a level of few boxes is taken down to the next one where that makes fewer rows: they
lie in more tiles there instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from folioflow.functions import geometry as G
from folioflow.staging import written

#: Smaller boxes have the tiles of this level.
LEAST_LEVEL = -21
#: Tiles that a box may lie in where its level is taken down.
MOST_TILES = 20_000
#: Levels are multiples of it.
STEP = 3
#: Boxes of a page up to which the page's others are held against all of them, which is less than tiles cost there.
FEW = 16


def level_of(b: Column) -> Column:
    """The power of two of a box's tiles, a multiple of STEP; no side is longer than they are, whatever is rounded."""
    side = F.greatest(b.x1 - b.x0, b.y1 - b.y0) * 1.000001
    return F.greatest(F.lit(LEAST_LEVEL), F.ceil(F.log2(side) / STEP) * STEP).cast("int")


def _tile(v: Column, level: Column) -> Column:
    return F.floor(v / F.pow(F.lit(2.0), level)).cast("long")


def _tiles(b: Column, level: Column, before: int = 0) -> Column:
    """The tiles of a box at a level, and so many before them on either axis: every value of two sequences."""
    xs, ys = (F.sequence(_tile(lo, level) - before, _tile(hi, level)) for lo, hi in ((b.x0, b.x1), (b.y0, b.y1)))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("x"), y.alias("y")))))


def sound(b: Column) -> Column:
    """Whether a box has an extent on both sides and finite corners."""
    finite = lambda v: F.abs(v) < F.lit(2.0**52)
    return (b.x0 < b.x1) & (b.y0 < b.y1) & finite(b.x0) & finite(b.x1) & finite(b.y0) & finite(b.y1)


def meeting(left: DataFrame, right: DataFrame, by: list[str], a: str = "a", b: str = "b", few: int = FEW) -> DataFrame:
    """Pairs of rows of left and right, equal in by, whose boxes a and b have a common area; columns of both. Other
    than by, their names must differ. Boxes without an extent, with nulls or corners that are no finite
    numbers below 2**52 meet nothing; touching edges do not meet. Rows with a null in by meet nothing. On pages with at
    most few boxes on the left the right ones are held against all of them; the others are laid out in tiles.
    """
    left, right = left.where(sound(F.col(a))), right.where(sound(F.col(b)))
    large = written(left.groupBy(*by).agg(F.count("*").alias("__n")).where(F.col("__n") > few).select(*by), "large-pages")
    some = not large.isEmpty()
    # On a small page each box on the right meets a bounded number of others.
    few_of = lambda df: df.join(large, by, "left_anti") if some else df
    met = few_of(left).join(few_of(right), by).where(G.intersection(a, b).isNotNull())
    return met.unionByName(_by_tiles(left.join(large, by, "left_semi"), right.join(large, by, "left_semi"), by, a, b)) if some else met


def _grids(left: list[Row], right: list[Row]) -> dict[int, int]:
    """The level at which each level of left boxes is laid out; rows have level, n, sums and maxima of sides."""
    group = {r.level: (r.n, r.w, r.h, r.area, r.most_w, r.most_h) for r in left}
    grids = {level: level for level in group}
    for level in sorted(group, reverse=True):
        lower = [x for x in group if x < level]
        if not lower or any(max(lower) < r.level <= level for r in right):
            continue
        to, (n, w, h, area, most_w, most_h) = max(lower), group[level]
        tiles = lambda at, n=n, w=w, h=h, area=area: 4 * n + 2 * (w + h) / 2.0**at + area / 4.0**at
        fits = (most_w / 2.0**to + 2) * (most_h / 2.0**to + 2) <= MOST_TILES
        if fits and tiles(to) - tiles(level) < sum(r.n for r in right if r.level <= to):
            mine, its = group.pop(level), group[to]
            group[to] = (*(x + y for x, y in zip(mine[:4], its[:4], strict=True)), max(mine[4], its[4]), max(mine[5], its[5]))
            grids = {k: to if v == level else v for k, v in grids.items()}
    return grids


def _by_tiles(left: DataFrame, right: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """meeting of sound boxes, all of them in tiles."""

    def sizes(df: DataFrame, box: str, side: bool) -> DataFrame:
        w, h = F.col(f"{box}.x1") - F.col(f"{box}.x0"), F.col(f"{box}.y1") - F.col(f"{box}.y0")
        held = df.select(level_of(F.col(box)).alias("level"), w.alias("w"), h.alias("h")).groupBy("level")
        return held.agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.sum("h").alias("h"), F.sum(F.col("w") * F.col("h")).alias("area"), F.max("w").alias("most_w"), F.max("h").alias("most_h")).withColumn("left", F.lit(side))

    # A row for each level, of which there are at most 26 a side.
    found = sizes(left, a, True).unionAll(sizes(right, b, False)).collect()
    grids = _grids([r for r in found if r.left], [r for r in found if not r.left])
    of_left, of_right = sorted(set(grids.values())), sorted(r.level for r in found if not r.left)
    if not of_left or not of_right:
        return left.join(right, by).where(F.lit(False))
    grid = F.element_at(F.create_map(*[F.lit(x) for k, v in grids.items() for x in (k, v)]), level_of(F.col(a)))
    own = level_of(F.col(b))
    # One number for a tile. Those of a box are distinct, so two that share it by chance make no pair twice.
    key = lambda level, x, y: F.xxhash64(level, x, y)
    listed = lambda levels: F.array(*[F.lit(x) for x in levels])
    cover = lambda box, level: F.explode(F.array_distinct(F.transform(_tiles(F.col(box), level, 1), lambda t: key(level, t.x, t.y))))
    corner = lambda box, levels: F.explode(F.transform(levels, lambda v: key(v, _tile(F.col(f"{box}.x0"), v), _tile(F.col(f"{box}.y0"), v))))
    on = [*by, "__tile"]
    # First the pairs whose left box is laid out at no lower level.
    met = left.withColumn("__tile", cover(a, grid)).join(right.withColumn("__tile", corner(b, F.filter(listed(of_left), lambda v: v >= own))), on)
    if of_left[0] < of_right[-1]:
        larger = right.where(own > of_left[0]).withColumn("__tile", cover(b, own))
        met = met.unionByName(left.withColumn("__tile", corner(a, F.filter(listed(of_right), lambda v: v > grid))).join(larger, on))
    return met.where(G.intersection(a, b).isNotNull()).drop("__tile")
