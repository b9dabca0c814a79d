"""Sessions of persons with timers, and notices that go out once.

One stateful operator keeps, for each person, the running session, the commands
it has carried out, and the minutes of each kind. A timer in event time ends a
session when the watermark passes its end. What ends is written with its notice
into a ledger, both tables in one commit under the number of the batch: a batch
that is replayed after a crash does nothing, so each notice is there once.

The operator needs the RocksDB state store (``STATE_STORE``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from loomkb.operators.ledger import Ledger

STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
ENDED = "person string, command string, kind string, started_at timestamp, ends_at timestamp, finished_at timestamp, status string, total_minutes long"
#: Commands are remembered for so long after they came, in milliseconds: longer than a source repeats them.
REMEMBER = 24 * 3600 * 1000


def _stamp(ms: int) -> pd.Timestamp:
    return pd.Timestamp(ms, unit="ms")


class SessionTimers(StatefulProcessor):
    """Commands (command, at, action, kind, minutes) of a person: "start" replaces a running session, "stop" ends it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.running = handle.getValueState("running", "command string, kind string, started long, ends long")
        self.totals = handle.getMapState("totals", "kind string", "minutes long")
        self.seen = handle.getMapState("seen", "command string", "at long")

    def ended(self, person: str, at: int, status: str) -> tuple:
        command, kind, started, ends = self.running.get()
        self.running.clear()
        self.handle.deleteTimer(ends) if status != "finished" else None
        total = (self.totals.getValue((kind,))[0] if self.totals.containsKey((kind,)) else 0) + (at - started) // 60_000
        self.totals.updateValue((kind,), (total,))
        return person, command, kind, _stamp(started), _stamp(ends), _stamp(at), status, total

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        given = pd.concat(list(rows)).sort_values(["at", "command"])
        for command, at, action, kind, minutes in given[["command", "at", "action", "kind", "minutes"]].itertuples(index=False):
            if self.seen.containsKey((command,)):
                continue
            now = int(at.value // 1_000_000)
            self.seen.updateValue((command,), (now,))
            if self.running.exists():
                ends = self.running.get()[3]
                # a session that was over before this command is finished, whenever its timer would fire
                status = "finished" if now >= ends else "stopped" if action == "stop" else "replaced"
                if status == "finished":
                    self.handle.deleteTimer(ends)
                out.append(self.ended(key[0], min(now, ends), status))
            if action == "start":
                ends = now + int(minutes) * 60_000
                self.running.update((command, kind, now, ends))
                self.handle.registerTimer(ends)
        self.forget(timerValues.getCurrentWatermarkInMs())
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ENDED.split(", ")])

    def forget(self, watermark: int) -> None:
        """Drop commands that no source repeats any more."""
        for command in [k[0] for k, v in self.seen.iterator() if v[0] < watermark - REMEMBER]:
            self.seen.removeKey((command,))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = expiredTimerInfo.getExpiryTimeInMs()
        if self.running.exists() and self.running.get()[3] == at:
            yield pd.DataFrame([self.ended(key[0], at, "finished")], columns=[c.split()[0] for c in ENDED.split(", ")])

    def close(self) -> None:
        pass


def ended_sessions(commands: DataFrame, lateness: str = "1 minute") -> DataFrame:
    """Sessions that end, of a stream of commands (person, command, at, action, kind, minutes)."""
    keyed = commands.where("person IS NOT NULL AND command IS NOT NULL AND (action <> 'start' OR minutes > 0)").withWatermark("at", lateness).groupBy("person")
    return keyed.transformWithStateInPandas(SessionTimers(), ENDED, "append", "eventTime")


def notices(ended: DataFrame) -> DataFrame:
    """(notice, person, at, text) of sessions that ran to their end."""
    minutes = F.floor((F.unix_timestamp("ends_at") - F.unix_timestamp("started_at")) / 60).cast("string")
    done = ended.where("status = 'finished'")
    return done.select(F.sha1(F.concat_ws("|", "person", "command")).alias("notice"), "person", F.col("ends_at").alias("at"), F.concat("kind", F.lit(" "), minutes, F.lit(" min")).alias("text"))


def outbox(ledger: Ledger, application: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` of ended sessions: sessions and notices in one commit for each batch."""

    def write(ended: DataFrame, batch: int) -> None:
        # run once whatever is written of it: a replayed batch must bring its state forward too
        held = ended.persist()
        try:
            held.count()
            ledger.commit(application, batch, lambda before: {"sessions": held, "notices": notices(held)})
        finally:
            held.unpersist()

    return write
