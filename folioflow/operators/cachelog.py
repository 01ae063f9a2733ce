"""The cache as a log-structured table: every write is a run of its own, nothing is rewritten for it.

A run holds the last write of each of its keys under a 128-bit digest of the three key columns, as a
bucketed table sorted by digest, so a lookup deals out its texts once and never shuffles the cache. A
deletion is a write without a translation that hides older ones. Each run has a Bloom filter a bucket:
a text that no filter knows is a miss without a look at any run, and a run that no text may be in is
not read. When a tier holds as many runs as the fan-in, they are merged into one of the next tier, so a
row is written again once a tier and lookups meet few runs.

A version of the table is a small manifest that names its runs. It is written after the runs, and
readers take the last complete one: a failed write leaves files that no version names. There is one writer
at a time; a second one fails, as its version is there already.
"""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["translate_engine", "translate_engine_params", "original_text"]
ROW = "k1 long, k2 long, translate_engine string, translate_engine_params string, original_text string, translation string, write_seq long, deleted boolean"
NAMES = [x.split(" ")[0] for x in ROW.split(", ")]
RUN = "run string, tier int, n long, words int, bytes long, oldest boolean"
#: Bits of a filter for each key, and how many of them a key sets: about one text in a hundred passes by mistake.
BITS_PER_KEY, PROBES = 10, 6


def digest(columns: list[str] = KEY) -> tuple[Column, Column]:
    """Two 64-bit hashes of the key columns, nulls told from empty texts."""
    framed = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return F.xxhash64(F.lit(1), *framed).alias("k1"), F.xxhash64(*framed, F.lit(2)).alias("k2")


def _newest(df: DataFrame, *by: str) -> DataFrame:
    """The last write of each digest; of equal write_seq a deletion, then the larger translation."""
    rest = [c for c in NAMES if c not in ("k1", "k2")]
    best = F.max(F.struct("write_seq", "deleted", "translation", *[c for c in rest if c not in ("write_seq", "deleted", "translation")])).alias("w")
    return df.groupBy("k1", "k2", *by).agg(best).select("k1", "k2", *by, *[f"w.{c}" for c in rest])


@dataclass(frozen=True)
class Run:
    run: str
    tier: int
    n: int
    words: int
    bytes: int
    oldest: bool


class CacheLog:
    """A cache table at root. buckets: of every run, fixed for the life of the table; fan_in: runs of a tier that
    are merged. forget_before: no write with a smaller write_seq will come, so that merges which reach the
    oldest run may drop older deletions; without it they stay, as a late write must not bring a key back."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16, fan_in: int = 4, forget_before: int | None = None):
        self.spark, self.root, self.buckets, self.fan_in, self.forget_before = spark, root.rstrip("/"), buckets, fan_in, forget_before

    # ------------------------------------------------------------ versions

    def _fs(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _exists(self, path: str) -> bool:
        fs, place = self._fs(path)
        return fs.exists(place)

    def _versions(self) -> list[int]:
        fs, place = self._fs(f"{self.root}/manifest")
        return [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(place) if s.getPath().getName().startswith("v=")] if fs.exists(place) else []

    def version(self) -> int:
        """The last complete version; 0 is the empty table."""
        return next((v for v in sorted(self._versions(), reverse=True) if self._exists(f"{self.root}/manifest/v={v}/_SUCCESS")), 0)

    def runs(self, version: int | None = None) -> list[Run]:
        """The runs of a version, the oldest first. Their number grows with the logarithm of the writes."""
        version = self.version() if version is None else version
        if not version:
            return []
        rows = self.spark.read.schema(f"pos int, {RUN}").json(f"{self.root}/manifest/v={version}").collect()
        return [Run(**{k: v for k, v in r.asDict().items() if k != "pos"}) for r in sorted(rows, key=lambda r: r.pos)]

    def _commit(self, runs: list[Run], version: int) -> None:
        rows = self.spark.createDataFrame([(i, *asdict(r).values()) for i, r in enumerate(runs)], f"pos int, {RUN}")
        rows.coalesce(1).write.mode("errorifexists").json(f"{self.root}/manifest/v={version}")

    # ------------------------------------------------------------ runs

    def _table(self, run: str) -> DataFrame:
        """A run as a bucketed table, declared to this session where it is not known yet."""
        name = f"cache_{uuid.uuid5(uuid.NAMESPACE_URL, f'{self.root}/{run}').hex}"
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} ({ROW}) USING parquet CLUSTERED BY (k1, k2) SORTED BY (k1, k2) INTO {self.buckets} BUCKETS LOCATION '{self.root}/run={run}'")
        return self.spark.table(name)

    def bucket(self) -> Column:
        """The bucket that Spark's writer gives a row."""
        return F.pmod(F.hash("k1", "k2"), F.lit(self.buckets))

    def _positions(self, words: Column | int) -> list[Column]:
        size = (F.lit(words) if isinstance(words, int) else words) * 64
        a, b = (F.pmod(F.col(k), F.lit(2**40)) for k in ("k1", "k2"))
        return [F.pmod(a + F.lit(i) * b, size) for i in range(PROBES)]

    def _write_run(self, rows: DataFrame, run: str, tier: int, oldest: bool) -> Run:
        """Writes rows, one a digest, and their filters."""
        path, name = f"{self.root}/run={run}", f"cache_write_{uuid.uuid4().hex}"
        dealt = rows.select(*NAMES).repartition(self.buckets, "k1", "k2")
        dealt.write.format("parquet").bucketBy(self.buckets, "k1", "k2").sortBy("k1", "k2").option("path", path).mode("overwrite").saveAsTable(name)
        # Only this session's name for the files goes; they stay, as the table is external.
        self.spark.sql(f"DROP TABLE {name}")
        written = self._table(run)
        sizes = written.groupBy(self.bucket().alias("bucket")).agg(F.count("*").alias("n")).agg(F.sum("n"), F.max("n")).first()
        n, most = sizes[0] or 0, sizes[1] or 0
        words = -(-max(1, most) * BITS_PER_KEY // 64)
        bits = written.select(self.bucket().alias("bucket"), F.explode(F.array(*self._positions(words))).alias("at"))
        bits = bits.select("bucket", F.floor(F.col("at") / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(64)).cast("int")).alias("bit"))
        none = self.spark.range(self.buckets).select(F.col("id").cast("int").alias("bucket"), F.explode(F.sequence(F.lit(0), F.lit(words - 1))).alias("word"), F.lit(0).cast("long").alias("bit"))
        dense = bits.unionAll(none).groupBy("bucket", "word").agg(F.bit_or("bit").alias("bit"))
        packed = dense.groupBy("bucket").agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "bit"))), lambda x: x.bit).alias("bits"))
        packed.write.mode("overwrite").parquet(f"{self.root}/filter={run}")
        fs, place = self._fs(path)
        return Run(run, tier, n, words, fs.getContentSummary(place).getLength(), oldest)

    def _all(self, runs: list[Run]) -> DataFrame:
        """The rows of runs, read as plain files: a union of bucketed scans may pass for bucketed without being so."""
        return self.spark.read.schema(ROW).parquet(*[f"{self.root}/run={r.run}" for r in runs])

    # ------------------------------------------------------------ writes

    def put(self, writes: DataFrame, run: str | None = None) -> int:
        """Adds writes(KEY..., translation, write_seq, optional deleted) as one version, and gives its number.

        The last write_seq of a key counts, whichever run it is in. run: a name for the write; if the table has
        had it already, nothing happens, so that a batch that runs again is written once. No writes, no version.
        """
        version = self.version()
        runs = self.runs(version)
        name = run or uuid.uuid4().hex
        if self._exists(f"{self.root}/done={name}/_SUCCESS"):
            return version
        deleted = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in writes.columns else F.lit(False)
        rows = writes.select(*digest(), *KEY, F.when(~deleted, F.col("translation")).alias("translation"), F.col("write_seq").cast("long").alias("write_seq"), deleted.alias("deleted"))
        # Above what a failed write may have left; a run's name is never used again.
        following = max(self._versions(), default=0) + 1
        new = self._write_run(_newest(rows), f"{name}-{uuid.uuid4().hex}", 0, not runs)
        if new.n:
            self._commit(self._merged([*runs, new]), following)
            version = following
        # What a version names is done; the mark only spares a repeated batch its work.
        self.spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("overwrite").json(f"{self.root}/done={name}")
        return version

    def delete(self, keys: DataFrame, run: str | None = None) -> int:
        """Hides the writes of keys(KEY..., write_seq) up to write_seq."""
        return self.put(keys.select(*KEY, F.lit(None).cast("string").alias("translation"), "write_seq", F.lit(True).alias("deleted")), run)

    def _merged(self, runs: list[Run]) -> list[Run]:
        """runs with the youngest fan_in of a tier as one of the next, while a tier is full."""
        while True:
            tier = runs[-1].tier
            same = [r for r in runs if r.tier == tier]
            if len(same) < self.fan_in:
                return runs
            first = len(runs) - len(same)
            rows = _newest(self._all(same))
            if first == 0 and self.forget_before is not None:
                rows = rows.where(~F.col("deleted") | (F.col("write_seq") >= self.forget_before))
            merged = self._write_run(rows, f"tier{tier + 1}-{uuid.uuid4().hex}", tier + 1, first == 0)
            runs = [*runs[:first], merged]

    def vacuum(self) -> None:
        """Deletes the files that the last version does not name; not while another session reads an older one."""
        live = {r.run for r in self.runs()}
        fs, place = self._fs(self.root)
        for s in fs.listStatus(place) if fs.exists(place) else []:
            kind, _, run = s.getPath().getName().partition("=")
            if kind in ("run", "filter") and run not in live:
                fs.delete(s.getPath(), True)

    # ------------------------------------------------------------ reads

    def _filters(self, runs: list[Run]) -> DataFrame:
        """One row a bucket: (bucket, b0, b1, ...), each run's filter."""
        each = [self.spark.read.schema("bucket int, bits array<long>").parquet(f"{self.root}/filter={r.run}").withColumnRenamed("bits", f"b{i}") for i, r in enumerate(runs)]
        return reduce(lambda a, b: a.join(b, "bucket"), each)

    def probe(self, texts: DataFrame, runs: list[Run]) -> DataFrame:
        """texts with k1, k2 and may, for each run whether it may hold the text: false is certain."""
        keyed = texts.withColumns(dict(zip(("k1", "k2"), digest(), strict=True)))
        if not runs:
            return keyed.withColumn("may", F.array().cast("array<boolean>"))

        def may(i: int, words: int) -> Column:
            # Positions are below 2**31, words of a filter fewer still.
            tests = [F.call_function("shiftright", F.get(f"b{i}", F.floor(p / 64).cast("int")), F.pmod(p, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1 for p in self._positions(words)]
            return reduce(lambda a, b: a & b, tests)

        size = sum(8 * r.words * self.buckets for r in runs)
        filters = self._filters(runs)
        # Beyond ten megabytes texts meet the filters by bucket instead.
        filters = F.broadcast(filters) if size <= 10 << 20 else filters
        met = keyed.withColumn("bucket", self.bucket()).join(filters, "bucket")
        return met.select(*texts.columns, "k1", "k2", F.array(*[may(i, r.words) for i, r in enumerate(runs)]).alias("may"))

    def lookup(self, texts: DataFrame) -> DataFrame:
        """texts(KEY..., other columns) with translation, null where the table has none. Texts are dealt out once;
        runs are read where they lie, those that no text may be in not at all."""
        runs = self.runs()
        probed = self.probe(texts, runs)
        if runs:
            hits = probed.agg(*[F.max(F.col("may")[i]).alias(str(i)) for i in range(len(runs))]).first()
            wanted = [i for i in range(len(runs)) if hits[i]]
        else:
            wanted = []
        met = probed
        for i in wanted:
            run = self._table(runs[i].run).select("k1", "k2", F.struct("write_seq", "deleted", "translation").alias(f"w{i}"))
            a, b = met.alias("t"), run.alias("c")
            found = a.join(b, (F.col("t.k1") == F.col("c.k1")) & (F.col("t.k2") == F.col("c.k2")) & F.col("t.may")[i], "left")
            met = found.select("t.*", f"c.w{i}")
        best = F.array_max(F.array_compact(F.array(*[F.col(f"w{i}") for i in wanted]))) if wanted else None
        translation = F.when(~best.deleted, best.translation) if wanted else F.lit(None).cast("string")
        return met.select(*[F.col(f"`{c}`") for c in texts.columns], translation.alias("translation"))

    def misses(self, texts: DataFrame) -> DataFrame:
        """The distinct keys of texts that the table lacks."""
        return self.lookup(texts.select(*KEY).distinct()).where("translation is null").select(*KEY)

    def current(self) -> DataFrame:
        """The whole table as (KEY..., translation, write_seq)."""
        runs = self.runs()
        rows = self._all(runs) if runs else self.spark.createDataFrame([], ROW)
        return _newest(rows).where(~F.col("deleted")).select(*KEY, "translation", "write_seq")
