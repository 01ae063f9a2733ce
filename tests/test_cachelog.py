import random

import pytest
from pyspark.sql import functions as F

from folioflow.operators import calls
from folioflow.operators.cachelog import KEY, CacheLog

SCHEMA = "translate_engine string, translate_engine_params string, original_text string, translation string, write_seq long, deleted boolean"


@pytest.fixture
def log(spark, tmp_path):
    return CacheLog(spark, f"file://{tmp_path}/cache", buckets=4, fan_in=3)


def writes(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_last_write_wins_over_runs(spark, log):
    """Random writes and deletions, also late ones with a smaller write_seq, through merges of tiers."""
    rng = random.Random(2)
    want: dict = {}
    for batch in range(5):
        rows = []
        for i in range(80):
            key = (rng.choice(["a", "b"]), rng.choice(["{}", None]), rng.choice(["", "x", None, *map(str, range(25))]))
            seq, gone = rng.randrange(10_000) * 10 + batch, rng.random() < 0.25
            rows.append((*key, None if gone else f"t{batch}-{i}", seq, gone))
        log.put(writes(spark, rows))
        for *key, t, seq, gone in rows:
            want[tuple(key)] = max(want.get(tuple(key), (-1, False, "")), (seq, gone, t or ""))
    live = {k: (t, s) for k, (s, gone, t) in want.items() if not gone}
    assert {(r[0], r[1], r[2]): (r.translation, r.write_seq) for r in log.current().collect()} == live
    assert len(log.runs()) < 5 and {r.tier for r in log.runs()} != {0}
    texts = spark.createDataFrame([(*k, i) for i, k in enumerate([*want, ("c", "{}", "x"), ("a", "{}", "unknown")])], f"{SCHEMA.split(', translation')[0]}, n int")
    found = {(r[0], r[1], r[2]): r.translation for r in log.lookup(texts).collect()}
    assert found == {k: live.get(k, (None,))[0] for k in [*want, ("c", "{}", "x"), ("a", "{}", "unknown")]}
    assert {tuple(r) for r in log.misses(texts.unionAll(texts)).collect()} == {k for k, t in found.items() if t is None}
    before = log.current().count()
    log.vacuum()
    assert log.current().count() == before


def test_old_deletions_go_with_the_merge(spark, tmp_path):
    log = CacheLog(spark, f"file://{tmp_path}/c", buckets=2, fan_in=2, forget_before=5)
    log.put(writes(spark, [("e", "{}", "x", "one", 1, False), ("e", "{}", "y", "two", 1, False)]))
    log.put(writes(spark, [("e", "{}", "x", None, 2, True), ("e", "{}", "y", None, 7, True)]))
    assert [(r.tier, r.n) for r in log.runs()] == [(1, 1)] and log.current().count() == 0


def test_empty_table(spark, log):
    texts = spark.createDataFrame([("e", "{}", "x")], "translate_engine string, translate_engine_params string, original_text string")
    assert [r.translation for r in log.lookup(texts).collect()] == [None] and log.misses(texts).count() == 1
    assert log.current().count() == 0 and log.version() == 0
    assert log.put(writes(spark, [])) == 0


def test_small_write_beside_a_large_table(spark, log):
    """Bytes written follow the delta, a lookup does not shuffle the cache, runs that cannot hold a text are not read."""
    big = spark.range(20_000).select(F.lit("e").alias("translate_engine"), F.lit("{}").alias("translate_engine_params"), F.concat(F.lit("text "), F.col("id")).alias("original_text"), F.concat(F.lit("out "), F.col("id")).alias("translation"), F.col("id").alias("write_seq"))
    log.put(big)
    log.put(big.limit(5).withColumn("write_seq", F.col("write_seq") + 100_000))
    first, second = log.runs()
    assert second.bytes * 20 < first.bytes and second.n == 5
    some = big.where("write_seq % 100 = 7").select(*KEY)
    conf = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = log.lookup(some)
        assert found.where("translation is null").count() == 0 and found.count() == 200
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", conf)
    # Bucketed scans stand right below the joins: no exchange deals out a run.
    assert plan.count("Bucketed: true") >= 1 and "Bucketed: false" not in plan
    lines = plan.splitlines()
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    for at in [i for i, x in enumerate(lines) if "Bucketed: true" in x]:
        above = next(i for i in range(at, -1, -1) if "Join" in lines[i] and depth(lines[i]) < depth(lines[at]))
        assert not any("Exchange" in lines[i] and depth(lines[i]) < depth(lines[at]) for i in range(above + 1, at) if all(depth(lines[j]) > depth(lines[i]) for j in range(i + 1, at + 1)))
    unknown = some.withColumn("original_text", F.concat(F.lit("no "), "original_text"))
    assert log.lookup(unknown).where("translation is not null").count() == 0
    passed = log.probe(unknown, log.runs()).where(F.exists("may", lambda x: x)).count()
    assert passed <= 12  # of 200, in one large run
    assert log.lookup(unknown.limit(1).where("original_text = 'none'"))._jdf.queryExecution().executedPlan().toString().count("Bucketed") == 0


def test_a_failed_write_is_no_version(spark, log, monkeypatch):
    rows = [("e", "{}", "x", "one", 1, False)]
    log.put(writes(spark, rows), "b0")
    assert log.put(writes(spark, rows), "b0") == 1  # the same batch again
    with monkeypatch.context() as m:
        m.setattr(CacheLog, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            log.put(writes(spark, [("e", "{}", "x", "two", 2, False)]), "b1")
    assert [r.translation for r in log.current().collect()] == ["one"]
    log.put(writes(spark, [("e", "{}", "x", "two", 2, False)]), "b1")
    assert [r.translation for r in log.current().collect()] == ["two"] and log.version() == 2
    # A second writer of the same version fails.
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        log._commit(log.runs(), 2)


def test_calls_through_the_log(spark, log):
    texts = spark.createDataFrame([("one",), ("two",), ("one",), ("",)], "text string")
    done, same = calls.translate_texts(texts, log, calls.EchoProvider(), 1, f"{log.root}/staging/1")
    assert same is log and sorted(r.translation for r in done.collect()) == ["", "echo(one)", "echo(one)", "echo(two)"]
    again, _ = calls.translate_texts(texts, log, calls.ScriptedProvider({}, name="echo"), 2, f"{log.root}/staging/2")
    assert sorted(r.translation for r in again.collect()) == ["", "echo(one)", "echo(one)", "echo(two)"]
    assert len(log.runs()) == 1
