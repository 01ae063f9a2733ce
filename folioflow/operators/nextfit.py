"""Next fit over entries that are rows, so that one long document is many tasks.

The chunk of an entry depends on where the chunk before it began, and so on back to the first entry. Here
the chain is not walked but composed:

1. Sums of the sizes before each entry, blocks of entries first, tell for every entry where the next
   chunk would begin if one began there: a count over a range of sums, within a block and the begin
   of the next, as a chunk never holds more entries than half its bytes.
2. Each block becomes a function: where a chain enters it, where it leaves it, and how many chunks that makes.
3. Functions of runs of 1, 2, 4, ... blocks come from joins of the table with itself; with them the chain from
   the first entry reaches every block's true entrance in as many joins.
4. Within each block the chain is followed from there, and running counts of its begins number the entries.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.staging import written


def numbered(df: DataFrame, order: list[str], pos: str) -> DataFrame:
    """df, written once, with pos: the rank of each row from 0 by order, of equals in any order. Ranges of the order are
    sorted each by itself; only the number of rows of a range is added up."""
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    held = written(parts.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", 33).alias("__part")
    # One row a range, as many as shuffle partitions.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = held.groupBy(part).agg(F.count("*").alias("__n")).withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    return held.withColumn("__part", part).join(F.broadcast(sizes), "__part").withColumn(pos, F.col("__base") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__part", "__at", "__base")


def next_fit(entries: DataFrame, by: list[str], pos: str, size: str, max_bytes: int, block: int | None = None, each: int = 2, most: int | None = None) -> DataFrame:
    """entries with chunk_no (int). In each group of by, pos counts from 0 without gaps or repeats and size is the
    bytes of the entry; an object of n entries has the sum of their sizes and each bytes for every one, in JSON two, for
    braces and separators. A chunk takes entries in order while it has at most max_bytes, and at most most entries; an
    entry too large lies alone. An entry counts for one byte at least. Null in by is a group; no entries
    give no rows. block: entries of a block, no fewer than a chunk may hold.
    """
    reach = min(max_bytes // max(1, each), most or max_bytes) + 2
    block = max(block or 8 * reach, reach)
    keys = [f"__b{i}" for i in range(len(by))]
    # Keys without nulls, as joins leave those out.
    own = [F.struct(F.col(c)).alias(k) for c, k in zip(by, keys, strict=True)]
    rows = entries.select(*own, F.col(pos).cast("long").alias("__pos"), F.greatest(F.lit(1), F.col(size).cast("long") + each).alias("__f"))
    rows = rows.withColumn("__block", F.floor(F.col("__pos") / block))

    # Sums before each entry, in two levels; the last row of a group stands for its end.
    sums = rows.groupBy(*keys, "__block").agg(F.sum("__f").alias("__s"))
    before = lambda *c: Window.partitionBy(*c).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.withColumn("__base", F.coalesce(F.sum("__s").over(before(*keys).orderBy("__block")), F.lit(0))).drop("__s")
    within = rows.withColumn("__in", F.coalesce(F.sum("__f").over(before(*keys, "__block").orderBy("__pos")), F.lit(0)))
    at = within.join(base, [*keys, "__block"]).select(*keys, "__block", "__pos", "__f", (F.col("__base") + F.col("__in")).alias("__c"))
    end = at.groupBy(*keys).agg(F.max(F.struct((F.col("__pos") + 1).alias("__pos"), (F.col("__c") + F.col("__f")).alias("__c"))).alias("e"))
    ends = end.select(*keys, F.floor(F.col("e.__pos") / block).alias("__block"), F.col("e.__pos").alias("__pos"), F.lit(None).cast("long").alias("__f"), F.col("e.__c").alias("__c"))

    # Of all rows from an entry on whose sums are within max_bytes, the last begins the next chunk.
    near = F.when(F.pmod("__pos", F.lit(block)) < reach, F.array(F.col("__block"), F.col("__block") - 1)).otherwise(F.array("__block"))
    seen = at.unionByName(ends).withColumn("__group", F.explode(near))
    fits = F.count("*").over(Window.partitionBy(*keys, "__group").orderBy("__c").rangeBetween(0, max_bytes)) - 1
    fits = F.least(fits, F.lit(most)) if most else fits
    jumps = seen.withColumn("__next", F.col("__pos") + F.greatest(F.lit(1), fits)).where((F.col("__group") == F.col("__block")) & F.col("__f").isNotNull())
    jumps = written(jumps.select(*keys, "__block", "__pos", "__f", "__next"), "jumps")

    # Every block as a function of its possible entrances.
    doors = jumps.where(F.floor(F.col("__next") / block) > F.col("__block")).groupBy(*keys, (F.col("__block") + 1).alias("__block")).agg(F.collect_set("__next").alias("__doors"))
    first = jumps.groupBy(*keys).agg(F.min("__block").alias("__block")).withColumn("__doors", F.array(F.lit(0).cast("long")))
    held = jumps.groupBy(*keys, "__block").agg(F.sort_array(F.collect_list(F.struct("__pos", "__next"))).alias("__j"), F.sum("__f").alias("__s"))
    # Two chunks side by side hold more than max_bytes, or one of them all it may: that bounds the steps within a block.
    full = 2 * F.floor(F.size("__j") / most) if most else F.lit(0)
    held = held.select(*keys, "__block", F.transform("__j", lambda j: j["__next"]).alias("__n"), F.sequence(F.lit(1), (2 * F.floor(F.col("__s") / max_bytes) + full + 3).cast("int")).alias("__steps"))
    start = F.col("__block") * block

    def leave(door):
        step = lambda s, _: F.when(s.at - start < F.size("__n"), F.struct(F.get("__n", (s.at - start).cast("int")).alias("at"), (s.n + 1).alias("n"))).otherwise(s)
        return F.aggregate("__steps", F.struct(door.alias("at"), F.lit(0).cast("long").alias("n")), step)

    functions = held.join(doors.unionByName(first), [*keys, "__block"])
    functions = functions.select(*keys, "__block", F.explode("__doors").alias("__door"), "__n", "__steps").select(*keys, "__block", "__door", leave(F.col("__door")).alias("x")).select(*keys, "__door", F.col("x.at").alias("__exit"), F.col("x.n").alias("__chunks"))
    spans = [written(functions, "spans")]
    blocks = jumps.agg(F.max("__block")).first()[0]
    while blocks is not None and 1 << len(spans) <= blocks:
        last = spans[-1]
        on = last.select(*keys, F.col("__door").alias("__exit"), F.col("__exit").alias("__exit2"), F.col("__chunks").alias("__chunks2"))
        spans.append(written(last.join(on, [*keys, "__exit"]).select(*keys, "__door", F.col("__exit2").alias("__exit"), (F.col("__chunks") + F.col("__chunks2")).alias("__chunks")), "spans"))
    reached = first.select(*keys, F.lit(0).cast("long").alias("__door"), F.lit(0).cast("long").alias("__no"))
    for span in reversed(spans[1:] if len(spans) > 1 else []):
        reached = written(reached.unionByName(reached.join(span, [*keys, "__door"]).select(*keys, F.col("__exit").alias("__door"), (F.col("__no") + F.col("__chunks")).alias("__no"))), "reached")
    if blocks:
        reached = reached.unionByName(reached.join(spans[0], [*keys, "__door"]).select(*keys, F.col("__exit").alias("__door"), (F.col("__no") + F.col("__chunks")).alias("__no")))
    entered = reached.withColumn("__block", F.floor(F.col("__door") / block))

    # The begins of chunks in each block, and from them the number of each entry.
    walk = F.aggregate("__steps", F.array("__door"), lambda s, _: F.when(F.element_at(s, -1) - start < F.size("__n"), F.array_append(s, F.get("__n", (F.element_at(s, -1) - start).cast("int")))).otherwise(s))
    begins = held.join(entered, [*keys, "__block"]).select(*keys, "__block", F.col("__no").alias("__first"), F.explode(walk).alias("__pos")).where(F.floor(F.col("__pos") / block) == F.col("__block"))
    marks = begins.select(*keys, "__block", "__pos", F.lit(1).alias("__mark"))
    firsts = begins.groupBy(*keys, "__block").agg(F.min("__first").alias("__first"), F.min("__pos").alias("__begin"))
    # A block within one large chunk has no begin: it goes on with what its predecessors counted.
    numbered = jumps.select(*keys, "__block", "__pos").join(marks, [*keys, "__block", "__pos"], "left").join(firsts, [*keys, "__block"], "left")
    upto = F.sum(F.coalesce("__mark", F.lit(0))).over(Window.partitionBy(*keys, "__block").orderBy("__pos"))
    numbered = numbered.select(*keys, "__pos", (F.col("__first") + upto - 1).cast("int").alias("chunk_no"))
    same = reduce(lambda a, b: a & b, [F.col(k) == F.struct(F.col(f"e.{c}")) for c, k in zip(by, keys, strict=True)])
    return entries.alias("e").join(numbered, same & (F.col(f"e.{pos}").cast("long") == F.col("__pos"))).select("e.*", "chunk_no")
