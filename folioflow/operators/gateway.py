"""Chat models behind a gateway: limits, retries, continuations; and calls for tables of requests.

A model is any picklable object with `name`, `params` and `complete(system, user, force_json)`,
which gives a Reply. It raises RateLimited where it is asked too often. Nothing here knows a
network: adapters for real services do.
"""

from __future__ import annotations

import re
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import PandasUDFType

from folioflow.functions import constants as K
from folioflow.operators import calls, nextfit
from folioflow.staging import written

_THINK = re.compile(K.THINK["gateway"].replace("(?sU)", "(?s)"))


@dataclass
class Reply:
    text: str
    cut_off: bool = False  # by a limit of length


class RateLimited(Exception):
    """The service wants fewer calls."""


@dataclass(frozen=True)
class Limits:
    """width: calls of a task at the same time; tasks: tasks that call at the same time, so that width
    times tasks bounds all; calls and tokens: a minute, of a task."""

    width: int = 4
    tasks: int | None = None
    calls: int | None = None
    tokens: int | None = None
    attempts: int = 3
    base_wait: float = 0.5
    rate_wait: float = 5.0
    continuations: int = 2


@dataclass
class ScriptedModel:
    """A stand-in for a chat model: answer(system, user) decides."""

    answer: Callable[[str, str], str]
    name: str = "scripted"
    params: dict = field(default_factory=dict)

    def complete(self, system: str, user: str, force_json: bool = False) -> Reply:
        return Reply(self.answer(system, user))


class Gateway:
    """One model within its limits. Threads may share a gateway."""

    def __init__(self, model, limits: Limits = Limits(), clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep):
        self.model, self.limits, self._clock, self._sleep = model, limits, clock, sleep
        self._room, self._lock = threading.Semaphore(limits.width), threading.Lock()
        self._rate = calls.RateLimiter(limits.calls or 1 << 60, limits.tokens or 1 << 60) if limits.calls or limits.tokens else None

    def call(self, system: str, user: str, force_json: bool = False) -> str:
        """The whole answer, without a leading block of thoughts. What still fails after the last attempt
        is raised."""

        def ask() -> tuple[str, bool]:
            again = lambda: self._admitted(system, user, force_json)
            more = lambda e: self.limits.rate_wait if isinstance(e, RateLimited) else 0.0
            reply = calls.with_retries(again, self.limits.attempts, self.limits.base_wait, self._sleep, (Exception,), more)
            return _THINK.sub("", reply.text), reply.cut_off

        with self._room:
            return calls.continued(ask, self.limits.continuations)

    def _admitted(self, system: str, user: str, force_json: bool) -> Reply:
        # About four bytes a token; the answer is about as long as the request.
        tokens = (len(system) + 2 * len(user)) // 4
        while self._rate is not None:
            with self._lock:
                wait = self._rate.wait(self._clock(), tokens)
            if wait <= 0:
                break
            self._sleep(wait)
        return self.model.complete(system, user, force_json)


def call_requests(requests: DataFrame, by: list[str], model, limits: Limits = Limits(), force_json: bool = False) -> DataFrame:
    """Rows (by..., answer, error) for requests(by..., system, user), in Arrow batches.

    A call that fails in the end gives a null answer and its error instead of failing the job.
    Write the result once before anything reads it: a task that runs again calls again.
    """
    spread = requests.repartition(limits.tasks) if limits.tasks else requests
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in requests.select(*by).schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gateway = Gateway(model, limits)

        def one(system: str, user: str) -> tuple[str | None, str | None]:
            try:
                return gateway.call(system, user, force_json), None
            except Exception as e:  # noqa: BLE001
                return None, f"{type(e).__name__}: {e}"

        with ThreadPoolExecutor(limits.width) as pool:
            for df in frames:
                found = list(pool.map(one, df["system"], df["user"]))
                yield df[by].assign(answer=[a for a, _ in found], error=[e for _, e in found])

    return spread.select(*by, "system", "user").mapInPandas(run, f"{schema}, answer string, error string")


def with_replies(requests: DataFrame, system: Column, user: Column, model, limits: Limits = Limits(), force_json: bool = False) -> DataFrame:
    """requests with reply(answer, error), the same calls as call_requests. All other columns stay in the JVM, so what a
    request was made of need not be joined again. Write the result once before anything reads it."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        gateway = Gateway(model, limits)

        def one(system: str, user: str) -> tuple[str | None, str | None]:
            try:
                return gateway.call(system, user, force_json), None
            except Exception as e:  # noqa: BLE001
                return None, f"{type(e).__name__}: {e}"

        with ThreadPoolExecutor(limits.width) as pool:
            for systems, users in batches:
                found = list(pool.map(one, systems, users))
                yield pd.DataFrame({"answer": [a for a, _ in found], "error": [e for _, e in found]}, dtype=object)

    spread = requests.repartition(limits.tasks) if limits.tasks else requests
    call = F.pandas_udf(run, "answer string, error string", PandasUDFType.SCALAR_ITER).asNondeterministic()
    return spread.withColumn("reply", call(system, user))


# ---------------------------------------------------------------- limits of a whole job

#: Seconds of the window in which calls and tokens are counted, and those after its slot in which a call may begin.
WINDOW_S, GRACE_S = 60, 5
MISSED = "slot missed"


def scheduled(requests: DataFrame, order: list[str], tokens: str, most_calls: int, most_tokens: int, window: int = WINDOW_S, grace: int = GRACE_S) -> DataFrame:
    """requests with slot (from 0) and admit_at, seconds from the begin of the job, over all tasks.

    A slot takes requests by order while they are at most most_calls with at most most_tokens; a larger one has a slot of
    its own, and every request counts for one token at least. Slots are window + grace seconds apart and
    calls of a slot begin within its grace, so no half-open window of so many seconds holds calls of two.
    That is what a limiter gives that one process would ask call by call; here no task knows the others.
    """
    listed = nextfit.numbered(requests, order, "__place").withColumn("__all", F.lit(0))
    held = nextfit.next_fit(listed, ["__all"], "__place", tokens, most_tokens, each=0, most=most_calls)
    return held.drop("__place", "__all").withColumnRenamed("chunk_no", "slot").withColumn("admit_at", F.col("slot") * (window + grace))


def call_scheduled(requests: DataFrame, by: list[str], model, limits: Limits, force_json: bool = False, grace: int = GRACE_S, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Rows (by..., answer, error, called_at) for requests(by..., system, user, admit_at) of scheduled().

    limits.tasks tasks begin together, or not at all where the cluster has no room for them, and each calls by
    limits.width threads, which bounds the calls at the same time over the job. A call waits for its slot; one that
    could not begin within the grace is not made and has the error MISSED: schedule it again.
    Calls are made once, as a second attempt would have no slot; continuations count with their call.
    """
    tasks, once = limits.tasks or 1, Limits(limits.width, limits.tasks, attempts=1, continuations=limits.continuations)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in requests.select(*by).schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import BarrierTaskContext

        # All tasks have their first requests, and then take the begin that the last of them tells.
        ahead = next(frames, None)
        begin = max(float(x) for x in BarrierTaskContext.get().allGather(str(clock())))
        gateway = Gateway(model, once, clock, sleep)

        def one(system: str, user: str, admit_at: int) -> tuple[str | None, str | None, float | None]:
            wait = begin + admit_at - clock()
            if wait > 0:
                sleep(wait)
            elif wait < -grace:
                return None, MISSED, None
            at = clock() - begin
            try:
                return gateway.call(system, user, force_json), None, at
            except Exception as e:  # noqa: BLE001
                return None, f"{type(e).__name__}: {e}", at

        with ThreadPoolExecutor(limits.width) as pool:
            for df in chain(() if ahead is None else (ahead,), frames):
                found = list(pool.map(one, df["system"], df["user"], df["admit_at"]))
                yield df[by].assign(answer=[x[0] for x in found], error=[x[1] for x in found], called_at=[x[2] for x in found])

    spread = requests.select(*by, "system", "user", "admit_at").repartition(tasks).sortWithinPartitions("admit_at")
    return spread.mapInPandas(run, f"{schema}, answer string, error string, called_at double", barrier=True)


def call_within(requests: DataFrame, by: list[str], model, limits: Limits, force_json: bool = False, rounds: int = 5, **timing) -> DataFrame:
    """Rows (by..., answer, error) for requests(by..., system, user; distinct in by) within limits.calls and limits.tokens a
    minute, counted over the whole job. Each round is written before it is read; what missed its slot is
    scheduled again, rounds times at most, and has that error in the end."""
    window = timing.pop("window", WINDOW_S)
    room = (limits.tasks or 1) * limits.width
    tokens = F.ceil((F.length("system") + 2 * F.length("user")) / 4)
    open_, done = requests.select(*by, "system", "user").withColumn("__tokens", tokens), []
    for i in range(rounds):
        # No more calls a slot than can begin at once.
        slots = scheduled(open_, by, "__tokens", min(limits.calls or room, room), limits.tokens or 1 << 40, window, timing.get("grace", GRACE_S))
        found = written(call_scheduled(slots, by, model, limits, force_json, **timing), "calls")
        last = i == rounds - 1
        done.append(found if last else found.where(~F.col("error").eqNullSafe(MISSED)))
        missed = found.where(F.col("error") == MISSED).select(*by)
        if last or missed.isEmpty():
            break
        open_ = open_.join(missed, by, "left_semi")
    out = done[0]
    for x in done[1:]:
        out = out.unionAll(x)
    return out.drop("called_at")
