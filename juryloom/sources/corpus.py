"""Readers: dialogue corpora, scored rows, human labels, transcripts, and their checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import CONDITIONS
from ..functions.hashing import sha256, split_of
from .arrow_files import TASK_BYTES, read_batches
from .isolated import transcripts
from .lines import csv_records, numbered_lines

DIALOGUE = "file_id string, condition string, client_model string, therapist_model string, dialogue string"
COLUMNS = tuple(c.split()[0] for c in DIALOGUE.split(", "))
HUMAN = "file_id string, annotator_id string, phq8_total string, self_harm_flag string"


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def sniff_format(spark: SparkSession, path: str) -> str:
    """csv or arrow, from a file's ending or a folder's entries; any Hadoop file system."""
    fs, p = _hadoop(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    if not fs.getFileStatus(p).isDirectory():
        return "csv" if path.endswith(".csv") else "arrow"
    names = {s.getPath().getName() for s in fs.listStatus(p)}
    return "arrow" if names & {"dataset_dict.json", "dataset_info.json", "train", "test"} else "csv"


def read_csv(spark: SparkSession, path: str, schema: str | StructType = DIALOGUE) -> DataFrame:
    """Header row, quoted fields of several lines; columns are taken by the header's names; a folder holds one file.

    The file is read in byte ranges, whose number does not change the rows (see csv_records). Rows come in no
    particular order; an empty line is no row.
    """
    fs, p = _hadoop(spark, path)
    if fs.getFileStatus(p).isDirectory():
        found = [s.getPath().toString() for s in fs.listStatus(p) if s.getPath().getName().endswith(".csv")]
        if len(found) != 1:
            raise ValueError(f"{path}: one .csv expected, {len(found)} found")
        path = found[0]
    want = spark.createDataFrame([], schema).schema
    raw = csv_rows(spark, path)
    missing = [f.name for f in want if f.name not in raw.columns]
    if missing:
        raise ValueError(f"{path}: columns missing: {missing}")
    typed = lambda f: F.col(f.name) if f.dataType.simpleString() == "string" else F.nullif(f.name, F.lit("")).cast(f.dataType).alias(f.name)
    return raw.select(*map(typed, want))


def csv_rows(spark: SparkSession, path: str, sep: str = ",", glob: str | None = None) -> DataFrame:
    """The columns of a header that all files share, as text, with __file and __record (from 1): exact file order.

    Fields that are empty or missing are empty text.
    """
    some = spark.read.option("recursiveFileLookup", True)
    some = some.option("pathGlobFilter", glob) if glob else some
    header = some.option("header", True).option("multiLine", True).option("escape", '"').option("sep", sep).csv(path).columns
    kind = ", ".join(f"`{c}` string" for c in header)
    records = csv_records(spark, path, glob=glob).filter("record > 0 and text <> ''")
    parsed = F.from_csv("text", F.lit(kind), {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1", "nullValue": "\0"})
    rows = records.select(F.col("file").alias("__file"), F.col("record").alias("__record"), parsed.alias("r"))
    return rows.select("__file", "__record", *(F.coalesce(F.col("r")[c], F.lit("")).alias(c) for c in header))


def _arrow_files(spark: SparkSession, path: str, splits: tuple[str, ...]) -> list[list[tuple[str, int]]]:
    """(path, bytes) of the .arrow files of each split, or of the folder itself, by name."""
    fs, _ = _hadoop(spark, path)
    folders = [f"{path}/{s}" for s in splits if _exists(spark, f"{path}/{s}")] or [path]
    out = []
    for folder in folders:
        found = [(s.getPath().toString(), int(s.getLen())) for s in fs.listStatus(_hadoop(spark, folder)[1])]
        out.append(sorted(f for f in found if f[0].endswith(".arrow")))
    return out


def read_arrow(spark: SparkSession, path: str, splits: tuple[str, ...] = ("train", "test"), schema: str | StructType = DIALOGUE, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Saved Arrow files, as one data set or a folder for each split, read by record batches (see read_batches).

    The files are opened by tasks, so their store must be one that pyarrow.fs knows.
    """
    files = [f for split in _arrow_files(spark, path, splits) for f in split]
    return read_batches(spark, files, spark.createDataFrame([], schema).schema, task_bytes)


def read_splits(spark: SparkSession, path: str, splits: tuple[str, ...] = ("train", "test"), schema: str | StructType = DIALOGUE, limit: int | None = None) -> DataFrame:
    """As read_arrow, of train and test alone and with a limit that counts across the splits in the order given: the
    first rows by split, file, batch and place. A split that is not there is an error."""
    if set(splits) - {"train", "test"}:
        raise ValueError(f"unknown splits {sorted(set(splits) - {'train', 'test'})}")
    lacking = [s for s in splits if not _exists(spark, f"{path}/{s}")]
    if lacking:
        raise FileNotFoundError(f"{path}: no split {lacking}")
    kind = spark.createDataFrame([], schema).schema
    parts = [read_batches(spark, files, kind, place=True).withColumn("__split", F.lit(i)) for i, files in enumerate(_arrow_files(spark, path, splits))]
    rows = reduce(DataFrame.unionByName, parts)
    order = ("__split", "__path", "__batch", "__row")
    return (rows if limit is None else rows.orderBy(*order).limit(limit)).drop(*order)


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return bool(fs.exists(p))


def read_corpus(spark: SparkSession, path: str, source: str = "auto") -> DataFrame:
    """A checked corpus with one row for each id and its split; an empty one is an error."""
    if source not in ("auto", "csv", "arrow"):
        raise ValueError(f"unknown source {source!r}")
    kind = sniff_format(spark, path) if source == "auto" else source
    raw = read_csv(spark, path) if kind == "csv" else read_arrow(spark, path)
    if raw.isEmpty():
        raise ValueError(f"{path}: empty corpus")
    return with_split(dedupe(checked(raw)))


def violations(dialogues: DataFrame) -> DataFrame:
    """(file_id, problem) of rows that lack a required field or have an unknown condition."""
    problems = [F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(f"{c} is empty")) for c in COLUMNS if c != "dialogue"]
    problems.append(F.when(~F.col("condition").isin(*CONDITIONS), F.lit("unknown condition")))
    problems.append(F.when(F.col("dialogue").isNull(), F.lit("dialogue is null")))
    text = F.concat_ws("; ", *problems)
    return dialogues.select("file_id", text.alias("problem")).filter("problem <> ''")


def raise_on(found: DataFrame) -> None:
    first = found.limit(5).collect()
    if first:
        raise ValueError(f"rows that break the contract, the first of them: {[r.asDict() for r in first]}")


def checked(dialogues: DataFrame) -> DataFrame:
    raise_on(violations(dialogues))
    return dialogues


def dedupe(dialogues: DataFrame) -> DataFrame:
    """One row for each id. Repeated rows of equal text count once; an id with different texts is an error.

    Which of equal-text rows stays is settled by the other columns' order, not by the place in a file.
    """
    rest = [c for c in dialogues.columns if c not in ("file_id", "dialogue")]
    hashed = dialogues.withColumn("__hash", sha256("dialogue"))
    one = hashed.groupBy("file_id").agg(
        F.min(F.struct(*(F.col(c) for c in rest), F.col("dialogue"))).alias("row"), F.min("__hash").alias("lo"), F.max("__hash").alias("hi")
    )
    ok = F.when(F.col("lo") == F.col("hi"), F.col("file_id")).otherwise(F.raise_error(F.concat(F.lit("different texts for id "), "file_id")).cast("string"))
    return one.select(ok.alias("file_id"), *(F.col(f"row.{c}").alias(c) for c in dialogues.columns if c != "file_id")).select(*dialogues.columns)


def with_split(dialogues: DataFrame) -> DataFrame:
    return dialogues.withColumn("computed_split", split_of(F.col("file_id")))


def from_conversations(conversations: DataFrame) -> DataFrame:
    """Turn tables (conv_id, turn, role, text) as dialogues: users are clients, assistants therapists.

    Conditions alternate with conv_id. Turns of null id go; null texts count as empty; turns of equal number are
    ordered by role and text.
    """
    prefix = F.when(F.col("role") == "user", "Client: ").when(F.col("role") == "assistant", "Therapist: ").otherwise("System: ")
    line = F.concat(prefix, F.coalesce("text", F.lit("")))
    turns = conversations.filter("conv_id is not null").select("conv_id", F.struct("turn", "role", line.alias("line")).alias("t"))
    one = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: t["line"]), "\n")
    cid = F.col("conv_id").cast("string")
    return with_split(
        one.select(
            F.concat(F.lit("conv"), F.when(F.length(cid) < 6, F.lpad(cid, 6, "0")).otherwise(cid)).alias("file_id"),
            F.when(F.col("conv_id") % 2 == 0, "mdd").otherwise("control").alias("condition"),
            F.lit("test").alias("client_model"),
            F.lit("test").alias("therapist_model"),
            text.alias("dialogue"),
        )
    )


def read_scored(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Scored rows as JSON lines, strictly typed: unknown keys go, a line of the wrong type is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_scored_permissive(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """As read_scored; a line that does not parse, or is no object, is kept in the column bad_line."""
    wide = StructType([*schema.fields, *spark.createDataFrame([], "bad_line string").schema.fields])
    return spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad_line").json(path)


def read_last_lines(spark: SparkSession, path: str, schema: StructType, key: str) -> DataFrame:
    """JSON lines by key: of the lines with one key the last in file order stays (files by name, exact line numbers).

    Blank lines count as none. A line that is no object of the schema, or has no key, is an error that names its place;
    files without any line are an error too. One shuffle by key with partial aggregation: a key may be in any
    share of the lines.
    """
    lines = numbered_lines(spark, path).filter("trim(value) <> ''")
    parsed = lines.select("file", "line", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("row"), F.try_variant_get(F.try_parse_json("value"), f"$.{key}", "string").alias("own"))
    bad = F.col("row").isNull() | F.col("own").isNull() | F.col(f"row.{key}").isNull()
    where = F.concat(F.lit("line without an object or a key: "), "file", F.lit(":"), F.col("line").cast("string"))
    checked_row = F.when(bad, F.raise_error(where).cast(schema)).otherwise(F.col("row"))
    rows = parsed.select(checked_row.alias("row"), F.struct("file", "line").alias("place"))
    if lines.isEmpty():
        raise ValueError(f"{path}: no lines")
    return last_by(rows.select("row.*", "place"), key, F.col("place")).drop("place")


def last_by(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """The row of greatest order for each key."""
    cols = rows.columns
    best = rows.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("row"))
    return best.select(*(F.col(f"row.{c}").alias(c) for c in cols))


def parse_flag(x: Column) -> Column:
    """Optional booleans as people write them; anything else is an error."""
    low = F.lower(F.trim(F.coalesce(x, F.lit(""))))
    bad = F.raise_error(F.concat(F.lit("not a boolean: "), low)).cast("boolean")
    return F.when(low.isin("", "na", "n/a", "null"), F.lit(None).cast("boolean")).when(low.isin("true", "t", "1", "yes", "y"), True).when(low.isin("false", "f", "0", "no", "n"), False).otherwise(bad)


def read_human_labels(spark: SparkSession, path: str) -> DataFrame:
    """(line, file_id, annotator_id, phq8_total, self_harm): a header with three required columns, no empty cells in them.

    line is the record's exact number in its file, from 1.
    """
    raw = csv_rows(spark, path)
    missing = {"file_id", "annotator_id", "phq8_total"} - set(raw.columns)
    if missing:
        raise ValueError(f"{path}: columns missing: {sorted(missing)}")
    flag = parse_flag(F.col("self_harm_flag")) if "self_harm_flag" in raw.columns else F.lit(None).cast("boolean")
    need = {c: F.trim(F.coalesce(F.col(c), F.lit(""))) for c in ("file_id", "annotator_id", "phq8_total")}
    raise_on(raw.select(*(v.alias(k) for k, v in need.items())).filter("file_id = '' or annotator_id = '' or phq8_total not rlike '^[0-9]+$'"))
    return raw.select(
        F.col("__record").alias("line"), need["file_id"].alias("file_id"), need["annotator_id"].alias("annotator_id"), need["phq8_total"].cast("int").alias("phq8_total"), flag.alias("self_harm")
    )


def read_transcripts(spark: SparkSession, path: str, speaker: str | None = "Participant") -> DataFrame:
    """(id, text) of the transcripts of a tree that can be read; see isolated.transcripts for those that cannot."""
    return transcripts(spark, path, speaker).filter("error is null").select("id", "text")


def read_first(dialogues: DataFrame, n: int | None) -> DataFrame:
    """The first n ids in code-point order: a top-n, no total sort."""
    return dialogues if n is None else dialogues.orderBy("file_id").limit(n)


def latest_per_key(events: DataFrame, key: str, *order: str) -> DataFrame:
    """The last event of each key."""
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return events.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
