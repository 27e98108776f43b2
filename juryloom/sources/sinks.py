"""Writers. Large results are folders of part files; single files are for small, ordered results only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import canonical_json
from .lines import numbered_lines


def write_jsonl(rows: DataFrame, path: str, key: str) -> None:
    """JSON lines in the key's order over all part files: a range partitioning, not one task. Nulls are written."""
    rows.orderBy(key).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_csv(rows: DataFrame, path: str, key: str) -> None:
    rows.orderBy(key).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text file on any Hadoop file system: written aside, then renamed."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.tmp")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(aside, True)
    out.write(bytearray(text, "utf-8"))
    out.close()
    fs.delete(p, False)
    if not fs.rename(aside, p):
        raise OSError(f"cannot rename to {path}")


def read_text(spark: SparkSession, path: str) -> str | None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None
    return spark.read.text(path, wholetext=True).first()["value"]


def write_manifest(spark: SparkSession, manifest: dict, path: str) -> None:
    write_text(spark, canonical_json(manifest), path)


def judge_model_of(manifest: dict) -> str | None:
    """The judge's model under any of the names it has had."""
    return manifest.get("judge_model") or manifest.get("judge_model_id") or (manifest.get("judge_item") or {}).get("model_id")


def repaired(rows: DataFrame, problems: DataFrame, path: str) -> None:
    """Repaired labels to a new path, and only if no row has a problem."""
    if not problems.isEmpty():
        raise ValueError("rows with problems; nothing written")
    rows.write.mode("errorifexists").option("header", True).csv(path)


def by_line(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of text files, with exact line numbers from 0 in each file."""
    return numbered_lines(spark, path)
