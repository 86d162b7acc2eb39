"""Alert state kept by a stream, keyed by the identity of a finding.

Each alert run lands its findings under the next number, with whether it sent them, and then
a closing row. A finding's state is what was last told of it and how often; it lives in the
stream's state store and goes when a run closes without the finding. A run may land in several
files, several runs may be read at once, and a stream that is started again goes on where it
stopped: what matters is the number of a run alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

ROW = "run long, closes boolean, identity string, severity string, sent boolean"
STATE = "severity string, sends long, first_run long, last_run long, last_sent long"
TOLD = f"identity string, run long, status string, {STATE.replace('last_run long, ', '')}"
#: Severities from the least to the worst.
RANK = {"watch": 0, "this-week": 1, "act-now": 2}
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def land(findings: DataFrame, path: str, run: int) -> None:
    """Write the findings(identity, severity, sent) of a run, then its closing row. Of rows
    that repeat an identity the worst counts, sent if any was; rows without one are no
    findings. A run that fails before it is closed can be landed again under its number."""
    rank = F.coalesce(*(F.when(F.col("severity") == s, F.lit(n)) for s, n in RANK.items()), F.lit(-1))
    once = findings.where("identity is not null").groupBy("identity").agg(F.max_by("severity", F.struct(rank, "severity")).alias("severity"), F.coalesce(F.max("sent"), F.lit(False)).alias("sent"))
    head = [F.lit(run).cast("long").alias("run"), F.lit(False).alias("closes")]
    once.select(*head, "identity", "severity", "sent").write.mode("append").json(path)
    close = findings.sparkSession.createDataFrame([(run, True, "", None, False)], ROW)
    close.coalesce(1).write.mode("append").json(path)


def tick(run, closes=0):
    """Seconds at which the findings of a run stand, or its closing, a second later."""
    return (run + 1) * 2 + closes


def read(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """Rows of runs as they land, with a clock on which runs follow each other (see tick).
    Rows of a run that was closed before are late, and dropped."""
    source = spark.readStream.schema(ROW)
    rows = (source.option("maxFilesPerTrigger", files) if files else source).json(path)
    at = F.timestamp_seconds(tick(F.col("run"), F.col("closes").cast("int")))
    return rows.withColumn("at", at).withWatermark("at", "1 millisecond")  # rows at the watermark are late


def after(state: tuple | None, run: int, severity: str, sent: bool) -> tuple[str, tuple]:
    """Status and state of a finding that stands in a run. Only what was sent counts as told,
    so that an escalation is news until it is."""
    if state is None:
        return "new", (severity, int(sent), run, run, run if sent else None)
    told, sends, first, _, last_sent = state
    worse = RANK.get(severity, -1) > RANK.get(told, -1)
    return "escalated" if worse else "standing", (severity if sent else told, sends + int(sent), first, run, run if sent else last_sent)


class Alerts(StatefulProcessor):
    """One finding: its state, and a timer for the closing of the first run without it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("told", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (identity,) = key
        runs = pd.concat(list(rows)).drop_duplicates("run").sort_values("run") if identity else None
        if runs is None:  # a closing row moves the clock only
            for _ in rows:
                pass
            return
        state = self.state.get() if self.state.exists() else None
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        out = []
        for run, severity, sent in zip(runs["run"], runs["severity"], runs["sent"]):
            run = int(run)
            if state is not None and run <= state[3]:  # the run was landed twice
                continue
            if state is not None and run > state[3] + 1:
                out.append(cleared(identity, state))
                state = None
            status, state = after(state, run, severity, bool(sent))
            out.append((identity, run, status, state[0], state[1], state[2], state[4]))
        self.state.update(state)
        self.handle.registerTimer(tick(state[3] + 1, 1) * 1000 - 500)  # before the next run closes
        yield frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            state = self.state.get()
            self.state.clear()
            yield frame([cleared(key[0], state)])

    def close(self) -> None:
        pass


def cleared(identity: str, state: tuple) -> tuple:
    """What is told of a finding in the first run without it."""
    severity, sends, first, last, last_sent = state
    return identity, last + 1, "cleared", severity, sends, first, last_sent


def frame(rows: list[tuple]) -> pd.DataFrame:
    names = ["identity", "run", "status", "severity", "sends", "first_run", "last_sent"]
    out = pd.DataFrame(rows, columns=names)
    return out.astype({"run": "int64", "sends": "int64", "first_run": "int64", "last_sent": "Int64"})


def follow(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append what each run tells of each finding to the table at out, and end when what is
    there has been read. Needs a state store that keeps timers (RocksDB)."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    told = rows.groupBy("identity").transformWithStateInPandas(Alerts(), TOLD, "append", "eventTime")
    return told.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def state_of(told: DataFrame, run: int) -> DataFrame:
    """The alert state after a run: identity, severity, sends of the findings that stand."""
    return told.where((F.col("run") == run) & (F.col("status") != "cleared")).select("identity", "severity", "sends")
