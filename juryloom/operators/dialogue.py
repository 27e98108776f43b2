"""Dialogues to utterances and text views, row by row: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import MAX_PREFIX_CHARS
from ..functions.text import cleaned_utterances, lines, strip, word_count

_LABEL = r"^(?i)(therapist|client)\s*:\s*(.*)$"
_OTHER = rf"^[^:]{{1,{MAX_PREFIX_CHARS}}}\s*:\s+"
#: Stands before each labelled line; taken out of the texts first.
_MARK = "\x01"


def parsed(dialogues: DataFrame) -> DataFrame:
    """Add unknown_speaker_count, orphan_line_count and utterances (speaker, text, meta_removed, truncated).

    A line with a speaker's label begins an utterance, later lines without one join it; lines with another short
    prefix are counted and left out, lines before any label are orphans. A null dialogue has no lines.
    """
    text = F.translate(F.coalesce("dialogue", F.lit("")), _MARK, "")
    kept = F.filter(F.transform(lines(text), lambda x: F.regexp_replace(x, r"(?U)^\s+", "")), lambda x: x != "")
    out = dialogues.withColumn("__lines", kept)
    labelled = lambda x: x.rlike(_LABEL)
    foreign = lambda x: ~labelled(x) & x.rlike(_OTHER)
    out = out.withColumn("unknown_speaker_count", F.size(F.filter("__lines", foreign)))
    marked = F.transform(
        F.filter("__lines", lambda x: ~foreign(x)),
        lambda x: F.when(labelled(x), F.concat(F.lit(_MARK), F.lower(F.substring(x, 1, 1)), F.regexp_extract(x, _LABEL, 2))).otherwise(strip(x)),
    )
    out = out.withColumn("__parts", F.split(F.array_join(marked, "\n"), _MARK))
    orphans = F.size(F.filter(F.split(F.get("__parts", F.lit(0)), "\n"), lambda x: x != ""))
    raw = F.transform(
        F.slice("__parts", F.lit(2), F.greatest(F.size("__parts") - 1, F.lit(0))),
        lambda p: F.struct(F.when(p.startswith("t"), "therapist").otherwise("client").alias("speaker"), F.substring(p, F.lit(2), F.length(p)).alias("text")),
    )
    out = out.withColumn("orphan_line_count", orphans).withColumn("utterances", cleaned_utterances(raw))
    return out.drop("__lines", "__parts")


def utterances(dialogues: DataFrame) -> DataFrame:
    """(file_id, utt_no, speaker, text, truncated): the kept utterances, numbered from 0."""
    kept = F.filter("utterances", lambda u: u["text"].isNotNull())
    rows = parsed(dialogues).select("file_id", F.posexplode(kept).alias("utt_no", "u"))
    return rows.select("file_id", "utt_no", "u.speaker", "u.text", "u.truncated")


def _joined(texts: Column) -> Column:
    return strip(F.array_join(texts, "\n"))


def views(dialogues: DataFrame, keep: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """The text views and counters of each dialogue, with the columns of keep."""
    u = parsed(dialogues).withColumn("kept", F.filter("utterances", lambda u: u["text"].isNotNull()))
    client = F.filter("kept", lambda u: u["speaker"] == "client")
    line = lambda u: F.concat(F.initcap(u["speaker"]), F.lit(": "), u["text"])

    def with_question(x: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get("kept", i - 1))
        asked = F.when(before["speaker"] == "therapist", F.concat(line(before), F.lit("\n"))).otherwise("")
        return F.when(x["speaker"] == "client", F.concat(asked, line(x)))

    count = lambda flag: F.size(F.filter("utterances", lambda u: u[flag]))
    out = u.select(
        *keep,
        _joined(F.transform("kept", line)).alias("dialogue_clean"),
        _joined(F.transform(client, lambda u: u["text"])).alias("client_only_text"),
        _joined(F.filter(F.transform("kept", with_question), lambda x: x.isNotNull())).alias("client_qa_text"),
        F.size(client).alias("client_utterance_count"),
        (F.size("kept") - F.size(client)).alias("therapist_utterance_count"),
        F.size(F.filter(client, lambda u: word_count(u["text"]) < 5)).alias("short_answer_count"),
        count("truncated").alias("truncated_utterance_count"),
        count("meta_removed").alias("meta_text_removed_count"),
        "unknown_speaker_count",
        "orphan_line_count",
    )
    return out.withColumn("has_empty_client_text", F.col("client_only_text") == "").withColumn(
        "has_unknown_speaker", F.col("unknown_speaker_count") + F.col("orphan_line_count") > 0
    )


def scoring_text(view: str) -> Column:
    if view not in ("client_qa", "client_only"):
        raise ValueError(f"unknown view {view!r}")
    return F.col("client_qa_text" if view == "client_qa" else "client_only_text")
