import random
import time

from pyspark.sql import functions as F

from folioflow.operators import gateway


def test_no_window_holds_more(spark):
    """Against a limiter that is asked call by call, and the bounds over every half-open window."""
    rng = random.Random(3)
    tokens = [rng.choice([0, 1, 5, 40, 99, 100, 101, 250]) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(tokens)), "i int, tokens int").repartition(5)
    found = {r.i: r.admit_at for r in gateway.scheduled(df, ["i"], "tokens", 4, 100, 60, 5).collect()}
    at, used, n, want = 0, 0, 0, {}
    for i, t in enumerate(tokens):
        t = max(1, t)
        if n and (n == 4 or used + t > 100):
            at, used, n = at + 65, 0, 0
        used, n = used + t, n + 1
        want[i] = at
    assert found == want
    # Wherever within its grace a call begins, a minute has calls of one slot only.
    times = sorted((at + rng.uniform(0, 5), max(1, tokens[i])) for i, at in found.items())
    for t, _ in times:
        held = [n for s, n in times if t - 60 < s <= t]
        assert len(held) <= 4 and (sum(held) <= 100 or len(held) == 1)


def test_calls_wait_for_their_slots(spark, tmp_path):
    log = str(tmp_path)

    def answer(system, user):
        with open(f"{log}/{user}-{time.time_ns()}", "w"):
            pass
        if user == "bad":
            raise ValueError("no")
        return user.upper()

    rows = [(i, "s", f"u{i}") for i in range(11)] + [(11, "s", "bad")]
    requests = spark.createDataFrame(rows, "i int, system string, user string")
    limits = gateway.Limits(width=2, tasks=2, calls=4)
    found = gateway.call_within(requests, ["i"], gateway.ScriptedModel(answer), limits, window=3, grace=2).collect()
    assert {r.i: r.answer for r in found} == {i: u.upper() if u != "bad" else None for i, _, u in rows}
    assert [r.error for r in found if r.i == 11] == ["ValueError: no"]
    made = sorted(int(p.name.rsplit("-", 1)[1]) / 1e9 for p in tmp_path.iterdir())
    assert len(made) == 12  # each once
    assert all(sum(t - 3 < s <= t for s in made) <= 4 for t in made)


def test_a_missed_slot_is_no_call(spark):
    requests = spark.createDataFrame([(1, "s", "u", -100), (2, "s", "u", 0)], "i int, system string, user string, admit_at int")
    found = {r.i: (r.answer, r.error) for r in gateway.call_scheduled(requests, ["i"], gateway.ScriptedModel(lambda s, u: "yes"), gateway.Limits(tasks=1)).collect()}
    assert found == {1: (None, gateway.MISSED), 2: ("yes", None)}
    assert gateway.scheduled(requests.limit(0).withColumn("t", F.lit(1)), ["i"], "t", 5, 5).count() == 0
