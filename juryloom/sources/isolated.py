"""Readers that set a broken file or line aside with what is wrong with it, and read all others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .lines import BROADCAST_RANGES, csv_records, numbered_lines

#: A field of a tab-separated record: quoted, in which case quotes within it stand twice, or not.
_FIELD = r'\t("(?:[^"]++|"")*+"(?=\t|$)|[^\t]*+)'


def files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(file, size) of the files of a tree; nothing is opened. Spark reads no file of size 0, but lists it."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    names = spark.createDataFrame([(f.replace(":///", ":/"),) for f in sorted(found.inputFiles())], "file string")  # the reader's own listing
    sizes = found.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))
    return names.join(sizes, "file", "left").select("file", F.coalesce("size", F.lit(0)).alias("size"))


def file_problems(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(file, problem) of every file of a tree, null where nothing is wrong: it is empty, ends before its size is read,
    or has bytes that are no UTF-8. The lines' bytes are summed against the file's size, so files must not be
    compressed."""
    raw = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).option("pathGlobFilter", glob).text(path)
    seen = raw.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.sum(F.octet_length("value") + 1).alias("got"), F.count_if(~F.is_valid_utf8("value")).alias("bad"))
    both = files(spark, path, glob).join(seen, "file", "left")
    short = ~F.coalesce(F.col("got") - F.col("size"), F.lit(-1)).isin(0, 1)  # the last line may lack its end
    problem = F.when(F.col("size") == 0, "empty file").when(short, F.concat(F.lit("unreadable: "), F.coalesce("got", F.lit(0)).cast("string"), F.lit(" of "), F.col("size").cast("string"), F.lit(" bytes"))).when(F.col("bad") > 0, "not UTF-8")
    return both.select("file", problem.alias("problem"))


def _fields(text: Column) -> Column:
    found = F.regexp_extract_all(F.concat(F.lit("\t"), text), F.lit(_FIELD), F.lit(1))
    quoted = lambda x: x.startswith('"') & x.endswith('"') & (F.length(x) > 1)
    return F.transform(found, lambda x: F.when(quoted(x), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))


def transcripts(spark: SparkSession, path: str, speaker: str | None = "Participant", glob: str = "*_TRANSCRIPT.csv") -> DataFrame:
    """(id, file, text, error): a row for each folder of a tree with a tab-separated transcript; of several the first by
    name counts. error is null, or says why there is no text.

    text holds the values of one speaker (all of them, if None) in file order with blanks between, without empty ones;
    it can be empty. id is the folder's name without `_P`. A file is broken if file_problems says so, if its header
    lacks a column, or if a record has more fields than the header; then its text is null and others are read on.
    Fewer fields count as empty ones, and blank lines as none. Every file has a header of its own. A transcript's
    values are gathered in one row, as its text is one.
    """
    folder = F.regexp_extract(F.col("file"), r"([^/]+)/[^/]+$", 1)
    listed = file_problems(spark, path, glob).select(F.regexp_replace(folder, "_P", "").alias("id"), F.regexp_extract(F.col("file"), r"^(.*)/[^/]+$", 1).alias("folder"), "file", "problem")
    one = listed.groupBy("folder").agg(F.min(F.struct("file", "id", "problem")).alias("f")).select("f.*")
    records = csv_records(spark, path, glob=glob, lenient=True).filter("text <> ''").select("file", "record", _fields(F.col("text")).alias("r"))
    header = records.groupBy("file").agg(F.min_by("r", "record").alias("header"), F.min("record").alias("first"))
    place = lambda name: F.array_position("header", name).cast("int") - 1
    need = ["value", *(["speaker"] if speaker is not None else [])]
    lacks = F.filter(F.array(*map(F.lit, need)), lambda n: ~F.array_contains("header", n))
    header = header.select("file", "first", F.size("header").alias("width"), F.when(F.size(lacks) > 0, F.concat(F.lit("no column "), F.array_join(lacks, ", "))).alias("lack"), place("value").alias("v"), place("speaker").alias("s"))
    few = files(spark, path, glob).count() <= BROADCAST_RANGES
    rows = records.join(F.broadcast(header) if few else header, "file").filter("record > first")
    value = F.when(F.col("v") >= 0, F.get("r", F.col("v")))
    said = (F.lit(True) if speaker is None else F.coalesce(F.when(F.col("s") >= 0, F.get("r", F.col("s"))) == speaker, F.lit(False))) & (value != "")
    wide = F.when(F.size("r") > F.col("width"), F.struct("record", F.format_string("record %d: %d fields, %d expected", F.col("record"), F.size("r"), F.col("width")).alias("said")))
    texts = rows.groupBy("file").agg(F.array_sort(F.collect_list(F.when(said, F.struct("record", value.alias("value"))))).alias("values"), F.min(wide).alias("wide"))
    both = one.join(header.select("file", "lack"), "file", "left").join(texts, "file", "left")
    error = F.coalesce("problem", "lack", F.col("wide.said"))
    text = F.coalesce(F.array_join(F.transform("values", lambda x: x["value"]), " "), F.lit(""))
    return both.select("id", "file", F.when(error.isNull(), text).alias("text"), error.alias("error"))


def json_lines(spark: SparkSession, path: str, schema: StructType | None = None, glob: str | None = None) -> DataFrame:
    """(file, line, row, value, error) of every line of JSON files that is not blank.

    A line that is no JSON, no object, or no object of the schema has an error and no row; the others have none.
    Without a schema row is a variant. value is the line as it stands, with bytes that are no UTF-8 replaced; lines
    count from 0 in each file.
    """
    some = numbered_lines(spark, path, glob, lenient=True).filter("trim(value) <> ''")
    some = some.withColumn("v", F.try_parse_json("value"))
    kind = F.schema_of_variant("v")
    error = F.when(F.col("v").isNull(), "not JSON").when(~kind.startswith("OBJECT"), F.concat(F.lit("not an object: "), F.regexp_extract(kind, "^[A-Z]+", 0)))
    if schema is None:
        return some.select("file", "line", F.when(error.isNull(), F.col("v")).alias("row"), "value", error.alias("error"))
    bad = "__bad"
    wide = StructType([*schema.fields]).add(bad, "string")
    parsed = some.select("file", "line", "value", error.alias("error"), F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}).alias("r"))
    told = F.coalesce("error", F.when(F.col("r").isNull() | F.col(f"r.{bad}").isNotNull(), "wrong type"))
    row = F.struct(*(F.col("r")[f.name].alias(f.name) for f in schema.fields))
    return parsed.select("file", "line", F.when(told.isNull(), row).alias("row"), "value", told.alias("error"))


def divided(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What was read, and what was set aside."""
    return found.filter("error is null").drop("error"), found.filter("error is not null")


def warnings(found: DataFrame) -> DataFrame:
    """(kind, n, first) of what was set aside: kinds of errors, numbers in them left out, with their count and first place."""
    place = F.struct("file", "line") if "line" in found.columns else F.struct("file")
    return divided(found)[1].groupBy(F.regexp_replace("error", "[0-9]+", "#").alias("kind")).agg(F.count("*").alias("n"), F.min(place).alias("first"))
