"""Calls to outside services, paced and behind a breaker.

``paced`` gives each request of a service its turn: at the time it came, or one
interval after the turn before it. The turn is a running maximum, so it is
one window and needs no state. ``guarded_calls`` makes the calls: each
service's requests, in order, run through one task, which waits for their
turns; a service takes so many calls a second whatever the number of tasks.
After some failures in a row the breaker opens: requests are answered with
"open" and not sent, until a cooling time has passed and one of them is let
through; it closes the breaker or opens it anew.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType


@dataclass
class Clock:
    """The time of a task; tests bring their own."""

    now: Callable[[], float] = time.monotonic
    wait: Callable[[float], None] = time.sleep


@dataclass
class Breaker:
    """Closed, open since ``opened``, or half open once ``cool_down`` seconds have passed."""

    failures: int = 3
    cool_down: float = 60.0
    in_a_row: int = 0
    opened: float | None = None

    def lets(self, now: float) -> bool:
        return self.opened is None or now - self.opened >= self.cool_down

    def told(self, good: bool, now: float) -> None:
        self.in_a_row = 0 if good else self.in_a_row + 1
        trial = self.opened is not None
        if good:
            self.opened = None
        elif trial or self.in_a_row >= self.failures:
            self.opened = now


@dataclass
class Service:
    """State of a service inside its task."""

    breaker: Breaker
    next_turn: float = 0.0
    interval: float = 0.0


def paced(requests: DataFrame, per_second: float, service: str = "service", at: str = "at", tie: str = "id") -> DataFrame:
    """``requests`` with ``turn``: the time at which each may be sent, at most ``per_second`` of a service in a second.

    Requests of one time take turns in the order of ``tie``. Rows without a
    time have no turn.
    """
    step = 1.0 / per_second
    seconds = F.unix_micros(F.col(at).cast("timestamp")) / 1e6
    order = Window.partitionBy(service).orderBy(F.col(at).asc_nulls_last(), tie)
    place = F.row_number().over(order) * F.lit(step)
    ranked = requests.withColumn("__place", place).withColumn("__free", seconds - F.col("__place"))
    turn = F.max("__free").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("__place")
    return ranked.withColumn("turn", F.when(F.col(at).isNotNull(), F.timestamp_micros(F.round(turn * 1e6).cast("long")))).drop("__place", "__free")


def guarded_calls(
    requests: DataFrame, call: Callable[[str, str], str | None], per_second: float, failures: int = 3, cool_down: float = 60.0, service: str = "service", payload: str = "payload", order: str = "id", clock: Callable[[], Clock] = Clock
) -> DataFrame:
    """``requests`` with answer, error and sent (seconds of the task's clock; null where nothing was sent).

    ``call(service, payload)`` is the caller's; what it raises becomes the
    row's error, and "open" marks rows that the breaker kept back, to be asked
    again later. Requests without a service fail by themselves and hold up no
    other. Memory does not grow with the requests.
    """
    kept = [c for c in requests.columns if c not in ("answer", "error", "sent")]
    source = requests.select(*kept)
    fields = [StructField("answer", StringType()), StructField("error", StringType()), StructField("sent", DoubleType())]

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        watch, services = clock(), {}
        for batch in batches:
            out = []
            for name, content in zip(batch[service], batch[payload]):
                if name is None or name != name:
                    out.append((None, "no service", None))
                    continue
                state = services.get(name)
                if state is None:  # sorted by service: the one before is done
                    services.clear()
                    state = services[name] = Service(Breaker(failures, cool_down), interval=1.0 / per_second)
                now = watch.now()
                if not state.breaker.lets(now):
                    out.append((None, "open", None))
                    continue
                if state.next_turn > now:
                    watch.wait(state.next_turn - now)
                    now = watch.now()
                state.next_turn = now + state.interval
                try:
                    answer, error = call(name, content), None
                except Exception as problem:  # the service's failure is the row's
                    answer, error = None, str(problem) or type(problem).__name__
                state.breaker.told(error is None, watch.now())
                out.append((answer, error, now))
            answered = pd.DataFrame(out, columns=["answer", "error", "sent"], index=batch.index)
            yield pd.concat([batch, answered], axis=1)

    dealt = source.repartition(service).sortWithinPartitions(service, order)
    return dealt.mapInPandas(send, StructType([*source.schema.fields, *fields]))
