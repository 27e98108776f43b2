"""Which dialogues of a stream are to be scored now: a state for each dialogue, with attempts, time-outs and expiry."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..plans.ledger import EVENT
from ..plans.scoring import Run
from ..sources.corpus import COLUMNS, DIALOGUE, with_split

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_BODY = tuple(c for c in COLUMNS if c != "file_id")
#: What comes in: an arrival with a dialogue, or the end of an attempt (done, failed).
NEWS = f"{DIALOGUE}, kind string, attempt int"
#: What goes out: reason is new, failed or stuck for a dialogue that is to be scored, given up or conflict for one that is not.
CLAIM = f"{DIALOGUE}, attempt int, reason string"


@dataclass(frozen=True)
class Terms:
    """attempts: at most so many for a dialogue. stuck_ms: an attempt without an end is taken as lost after so long.
    keep_ms: so long a dialogue that has ended is known; then its state goes, and it would count as new."""

    attempts: int = 3
    stuck_ms: int = 3_600_000
    keep_ms: int = 30 * 86_400_000


class Claims(StatefulProcessor):
    """open holds a dialogue while it is being scored, ended only how it ended, and that for a limited time."""

    def __init__(self, terms: Terms) -> None:
        self.terms = terms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", ", ".join(f"{c} string" for c in _BODY) + ", attempt int, deadline long, text_hash string")
        self.ended = handle.getValueState("ended", "how string, attempt int, text_hash string", self.terms.keep_ms)

    def _claim(self, key: tuple, body: tuple, attempt: int, text_hash: str, reason: str, now: int) -> Row:
        deadline = now + self.terms.stuck_ms
        self.handle.registerTimer(deadline)
        self.open.update((*body, attempt, deadline, text_hash))
        return self._row(key, body, attempt, reason)

    @staticmethod
    def _row(key: tuple, body: tuple, attempt: int, reason: str) -> Row:
        return Row(**dict(zip((*COLUMNS, "attempt", "reason"), (key[0], *body, attempt, reason), strict=True)))

    def _end(self, how: str) -> None:
        *_, attempt, deadline, text_hash = self.open.get()
        self.handle.deleteTimer(deadline)
        self.open.clear()
        self.ended.update((how, attempt, text_hash))

    def _again(self, key: tuple, reason: str, now: int) -> Row:
        """The next attempt, if there is one left; without it the dialogue is given up."""
        *body, attempt, deadline, text_hash = self.open.get()
        if attempt >= self.terms.attempts:
            self._end("given up")
            return self._row(key, tuple(body), attempt, "given up")
        self.handle.deleteTimer(deadline)
        return self._claim(key, tuple(body), attempt + 1, text_hash, reason, now)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        told = []
        for r in rows:
            if r["kind"] == "arrived":
                text_hash = hashlib.sha256((r["dialogue"] or "").encode()).hexdigest()
                known = self.open.get()[-1] if self.open.exists() else self.ended.get()[-1] if self.ended.exists() else None
                if known is None:
                    yield self._claim(key, tuple(r[c] for c in _BODY), 1, text_hash, "new", now)
                elif known != text_hash:
                    yield self._row(key, tuple(r[c] for c in _BODY), 0, "conflict")
            else:
                told.append((r["attempt"] or 0, r["kind"]))
        for attempt, kind in sorted(told):
            if not self.open.exists():
                if kind == "done" and self.ended.exists():  # a late end of a dialogue that was given up
                    self.ended.update(("done", *self.ended.get()[1:]))
            elif kind == "done":
                self._end("done")
            elif kind == "failed" and attempt >= self.open.get()[-3]:
                yield self._again(key, "failed", now)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        if self.open.exists() and self.open.get()[-2] <= expiredTimerInfo.getExpiryTimeInMs():
            yield self._again(key, "stuck", timerValues.getCurrentProcessingTimeInMs())


def claims(news: DataFrame, terms: Terms) -> DataFrame:
    """Rows of CLAIM for a stream of NEWS; rows of null file_id are left out. One shuffle by id; the session's state
    store must be the one of STORE."""
    return news.filter("file_id is not null").groupBy("file_id").transformWithState(Claims(terms), CLAIM, "Append", "ProcessingTime")


def claim_stream(spark: SparkSession, run: Run, source: str, terms: Terms | None = None, max_files: int = 64, **trigger) -> StreamingQuery:
    """Score dialogues of new Parquet files as they are claimed; ends of attempts come back from the run's events.

    A batch costs as much as what is new in it: no list of done dialogues is read. Dialogues that are given up or in
    conflict become failed events of attempt 0, which no attempt's end follows. trigger: that of the stream, a batch
    each minute by default; once=True is one batch of all there is, and the ends of its attempts come in with the next.
    With availableNow such a stream never ends, as timers may always be due. Until its end is read, an event file must
    not be compacted away (Ledger.compact between batches of a stopped stream).
    """
    if run.config.limit is not None:
        raise ValueError("a stream has no limit")  # what is claimed must be scored
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    run.ledger.append(spark.createDataFrame([], EVENT))  # the folder has to be there
    files = lambda schema, path: spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
    arrived = files(DIALOGUE, source).withColumns({"kind": F.lit("arrived"), "attempt": F.lit(0)})
    ends = files(EVENT, f"{run.folder}/events").filter("status in ('done', 'failed') and attempt > 0")
    ends = ends.select("file_id", *(F.lit(None).cast("string").alias(c) for c in _BODY), F.col("status").alias("kind"), "attempt")

    def batch(rows: DataFrame, number: int) -> None:
        run.run_claimed(with_split(rows), number)

    found = claims(arrived.unionByName(ends), terms or Terms())
    out = found.writeStream.foreachBatch(batch).option("checkpointLocation", f"{run.folder}/claims")
    return out.trigger(**(trigger or {"processingTime": "1 minute"})).start()
