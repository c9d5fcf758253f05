"""Admission of observations to a session's context, in batch.

Per session, in order: a target seen before with the same hash is referred to, or warned about
once it was recorded three times; anything else is passed and recorded, unless two such
acquisitions came before since the last outcome, which blocks it. A fold, not a window: warnings
and blocks are not recorded. Sessions are independent and each is folded in one task by streaming
its ordered rows, holding only what the session has seen.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPEATS, LIMIT, CAPACITY = 3, 3, 1024


class Session:
    """The state of one session; also that of the streaming form."""

    def __init__(self, seen: dict | None = None, run: int = 0):
        self.seen: OrderedDict[str, tuple[str, int]] = OrderedDict(seen or {})
        self.run = run

    def judge(self, target: str, digest: str) -> str:
        known = self.seen.get(target)
        if known and known[0] == digest:
            if known[1] >= REPEATS:
                return "warn"
            self._record(target, digest)
            return "reference"
        self.run += 1
        if self.run >= LIMIT:
            return "block"
        self._record(target, digest)
        return "pass"

    def outcome(self) -> None:
        self.run = 0

    def _record(self, target: str, digest: str) -> None:
        count = self.seen.pop(target, ("", 0))[1]
        while len(self.seen) >= CAPACITY:
            self.seen.popitem(last=False)
        self.seen[target] = (digest, count + 1)


def admit(observations: DataFrame) -> DataFrame:
    """session, seq, action for (session, seq, target, digest); a null target is a declared outcome."""
    schema = "session string, seq bigint, action string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, Session()
        for batch in batches:
            actions = []
            for s, t, d in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if s != name:
                    name, state = s, Session()
                if t is None:
                    state.outcome()
                    actions.append("outcome")
                else:
                    actions.append(state.judge(t, d))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(actions, pa.string())], names=["session", "seq", "action"])

    rows = observations.select(F.col("session").cast("string"), F.col("seq").cast("bigint"), "target", "digest")
    return rows.repartition("session").sortWithinPartitions("session", "seq").mapInArrow(run, schema)


def override_rate(decisions: DataFrame) -> DataFrame:
    """Share of overridden decisions, 0 without any."""
    return decisions.agg(F.coalesce(F.count_if("overridden") / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0)).alias("rate"))


#: Steps of a key that are folded together before the key's own fold: no row holds more of them.
CHUNK = 4096


def _chunked(events: DataFrame, key: str, *what: str) -> DataFrame:
    """key, c, e: the steps (seq, what) of each stretch of CHUNK sequence numbers, in order."""
    c = F.floor(F.col("seq") / CHUNK)
    return events.groupBy(key, c.alias("c")).agg(F.array_sort(F.collect_list(F.struct("seq", *what))).alias("e"))


def aggressiveness(events: DataFrame, low: float = 0.1, high: float = 1.0) -> DataFrame:
    """key, level: 0.5 moved by each delta of (key, seq, delta) in order, held in low to high.

    A stretch of steps is itself a move held in bounds: x becomes x + s, held in a to b. So
    stretches are folded apart, and a key's own fold runs over one row for each.
    """
    hold = lambda x: F.least(F.greatest(x, F.lit(low)), F.lit(high))
    start = F.struct(F.lit(0.0).alias("s"), F.lit(float("-inf")).alias("a"), F.lit(float("inf")).alias("b"))
    move = F.aggregate("e", start, lambda m, x: F.struct((m.s + x.delta).alias("s"), hold(m.a + x.delta).alias("a"), hold(m.b + x.delta).alias("b")))
    moves = _chunked(events, "key", "delta").select("key", F.struct("c", move.alias("m")).alias("m"))
    steps = moves.groupBy("key").agg(F.array_sort(F.collect_list("m")).alias("s"))
    return steps.select("key", F.aggregate("s", F.lit(0.5), lambda x, c: F.least(F.greatest(x + c.m.s, c.m.a), c.m.b)).alias("level"))


def coalesce_events(events: DataFrame) -> DataFrame:
    """path, change: what a run of created, modified and deleted of (path, seq, kind) comes to; null runs are dropped.

    A stretch of events leads from each state to one, so stretches are folded apart as well.
    """
    states = ("", "created", "modified", "deleted")
    step = lambda a, x: (
        F.when(a == "", x.kind)
        .when((a == "created") & (x.kind == "deleted"), "")
        .when((a == "created") & (x.kind == "modified"), "created")
        .otherwise(x.kind)
    )
    every = F.array(*[F.lit(s) for s in states])
    leads = F.aggregate("e", every, lambda to, x: F.transform(to, lambda a: step(a, x)))
    runs = _chunked(events, "path", "kind").select("path", F.struct("c", leads.alias("to")).alias("m"))
    runs = runs.groupBy("path").agg(F.array_sort(F.collect_list("m")).alias("s"))
    return runs.select("path", F.aggregate("s", F.lit(""), lambda a, c: F.element_at(c.to, F.array_position(every, a).cast("int"))).alias("change")).filter("change != ''")
