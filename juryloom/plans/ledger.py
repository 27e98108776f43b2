"""The ledger of a run: an append-only log of job events with snapshots that fold old events together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "file_id string, status string, attempt int, error_code string, error_message string, at timestamp, batch long, part string, input_tokens long, output_tokens long, reasoning_tokens long, total_tokens long"


def last_events(events: DataFrame) -> DataFrame:
    """The last event of each dialogue; of one attempt's events that of its end. One partial aggregation, no sort."""
    fields = events.columns
    rank = F.struct("attempt", F.col("status") != "running", "at")
    return events.groupBy("file_id").agg(F.max_by(F.struct(*fields), rank).alias("e")).select("e.*")


def done_events(events: DataFrame) -> DataFrame:
    """The last done event of each dialogue that has one."""
    return last_events(events.filter("status = 'done'"))


@dataclass(frozen=True)
class Ledger:
    """Events in folder/events, snapshots in folder/snapshots/<number>.

    A snapshot holds each dialogue's last event and last done event, and the names of the event files it folds. It
    counts from the moment its marker is there, which is created once and never changed; readers take the newest
    marked one and the event files that it does not name. Folded files are deleted after that, so that a compaction
    which breaks off anywhere loses and repeats nothing: without a marker its folder is not read, and files that are
    still there after it are not read twice. Appends may go on during a compaction.
    """

    spark: SparkSession
    folder: str

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def event_files(self) -> list[str]:
        return [n for n in self._names(f"{self.folder}/events") if n.endswith(".parquet")]

    def published(self) -> int | None:
        """The number of the newest snapshot that counts."""
        found = [int(n) for n in self._names(f"{self.folder}/snapshots") if n.isdigit()]
        return max((n for n in found if "_PUBLISHED" in self._names(f"{self.folder}/snapshots/{n}")), default=None)

    def append(self, rows: DataFrame) -> None:
        fields = [c.strip().split(" ") for c in EVENT.split(", ")]
        rows.select(*((F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in fields)).write.mode("append").parquet(f"{self.folder}/events")

    def events(self) -> DataFrame:
        """The newest snapshot's events and all that came after; of folded dialogues the last and the last done one."""
        schema = self.spark.createDataFrame([], EVENT).schema
        number = self.published()
        folded = set() if number is None else {r["name"] for r in self.spark.read.parquet(f"{self.folder}/snapshots/{number}/folded").collect()}  # one for each write since the last
        tail = [f"{self.folder}/events/{n}" for n in self.event_files() if n not in folded]
        parts = [self.spark.read.schema(schema).parquet(*tail)] if tail else []
        if number is not None:
            parts.append(self.spark.read.schema(schema).parquet(f"{self.folder}/snapshots/{number}/events"))
        if not parts:
            return self.spark.createDataFrame([], schema)
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def latest(self) -> DataFrame:
        return last_events(self.events())

    def compact(self) -> int:
        """Fold all events there are into a new snapshot; gives its number."""
        names = self.event_files()
        number = 1 + max((int(n) for n in self._names(f"{self.folder}/snapshots") if n.isdigit()), default=0)
        self._write(number, names)
        self._publish(number)
        self._vacuum(number, names)
        return number

    def _write(self, number: int, names: list[str]) -> None:
        """A snapshot sorted by dialogue, so that a lookup reads few row groups. Files that come after names are no part."""
        path, before = f"{self.folder}/snapshots/{number}", self.published()
        schema = self.spark.createDataFrame([], EVENT).schema
        old = [f"{self.folder}/snapshots/{before}/events"] if before is not None else []
        gone = set() if before is None else {r["name"] for r in self.spark.read.parquet(f"{self.folder}/snapshots/{before}/folded").collect()}
        some = [f"{self.folder}/events/{n}" for n in names if n not in gone]
        events = self.spark.read.schema(schema).parquet(*old, *some) if old or some else self.spark.createDataFrame([], schema)
        last = last_events(events)
        kept = last.unionByName(done_events(events).join(last.filter("status = 'done'").select("file_id"), "file_id", "left_anti"))
        kept.repartitionByRange("file_id").sortWithinPartitions("file_id").write.parquet(f"{path}/events")
        self.spark.createDataFrame([(n,) for n in names], "name string").coalesce(1).write.parquet(f"{path}/folded")

    def _publish(self, number: int) -> None:
        fs, p = self._fs(f"{self.folder}/snapshots/{number}/_PUBLISHED")
        fs.create(p, False).close()

    def _vacuum(self, number: int, names: list[str]) -> None:
        """Delete what the snapshot folds: event files, and snapshots before it."""
        for name in names:
            fs, p = self._fs(f"{self.folder}/events/{name}")
            fs.delete(p, False)
        for name in self._names(f"{self.folder}/snapshots"):
            if name.isdigit() and int(name) < number:
                fs, p = self._fs(f"{self.folder}/snapshots/{name}")
                fs.delete(p, True)
