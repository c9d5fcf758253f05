"""Streaming forms: admission per session, coalesced events, refreshed snapshots."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.operators import admission as A
from lodestone.operators import snapshots as S

OUT = "session string, seq bigint, action string"
STATE = "seen string, run int"


def _judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    seen, run = state.get if state.exists else ("[]", 0)
    session = A.Session({t: (d, n) for t, d, n in json.loads(seen)}, run)
    rows = pd.concat(list(batches)).sort_values("seq")
    actions = []
    for target, digest in zip(rows["target"], rows["digest"], strict=True):
        if target is None or pd.isna(target):
            session.outcome()
            actions.append("outcome")
        else:
            actions.append(session.judge(target, digest))
    state.update((json.dumps([[t, d, n] for t, (d, n) in session.seen.items()]), session.run))
    yield pd.DataFrame({"session": [key[0]] * len(rows), "seq": rows["seq"].to_numpy(), "action": actions})


def admit(observations: DataFrame) -> DataFrame:
    """The stream of (session, seq, target, digest) judged as by operators.admission.admit; state is one session's."""
    rows = observations.select(F.col("session").cast("string"), F.col("seq").cast("bigint"), "target", "digest")
    return rows.groupBy("session").applyInPandasWithState(_judge, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def coalesced(events: DataFrame, gap: str = "500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Quiet periods of a stream of (ts, path, kind): path, begin, finish, n; one row after each gap without events."""
    w = events.withWatermark("ts", late).groupBy("path", F.session_window("ts", gap).alias("w"))
    return w.agg(F.count(F.lit(1)).alias("n")).select("path", F.col("w.start").alias("begin"), F.col("w.end").alias("finish"), "n")


def refreshed(path: str, root: str):
    """A foreachBatch function that saves each batch of file rows as the next snapshot and the changes beside it."""

    def run(files: DataFrame, epoch: int) -> None:
        changes = S.refresh(files, path, root, epoch)
        changes.write.mode("overwrite").parquet(f"{path}/{epoch}/changes")

    return run
