"""Text columns: line splitting, stripping of artifacts, truncation, counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import MAX_BRACKET_CHARS, MAX_UTTERANCE_CHARS, MAX_UTTERANCE_WORDS

LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

# The bracketed artifacts that generation leaves behind.
ARTIFACTS = (
    r"\[\s*/?\s*END\s*\]",
    r"\[\s*insert[^\]]*\]",
    r"\[\s*next[^\]]*\]",
    r"\[\s*please\s+confirm[^\]]*\]",
    r"\[\s*review[^\]]*\]",
    r"\[\s*turn\s+\d+[^\]]*\]",
    r"\[\s*client\s+agrees[^\]]*\]",
    r"\[\s*if\s+the\s+client\s+agrees[^\]]*\]",
    r"\[\s*client(?:'|’)?s?\s*name\s*\]",
    r"\[\s*therapist(?:'|’)?s?\s*name\s*\]",
    r"\[\s*colleague(?:'|’)?s?\s*name\s*\]",
    r"\[\s*(?:daughter|sister)(?:'|’)?s?\s*name\s*\]",
    r"\[\s*\d+\s*/\s*\d+\s*\]",
    r"\[\s*keep\s+silent\s*\]",
    r"\[\s*no\s+reply\s*\]",
    r"\[\s*quiet\s*\]",
    r"\[\s*pause[^\]]*\]",
    r"\[\s*(?:sigh|smiles?|exhales?|inhales?(?:\s+deeply)?|taking\s+a\s+deep\s+breath)[^\]]*\]",
    r"\[\s*repeats\s+a\s+few\s+times[^\]]*\]",
    r"\[\s*(?:see\s+you|take\s+care|thank\s+you)[^\]]*\]",
    r"\[\s*i(?:'|’)?ll\s+send[^\]]*\]",
)
# Words that give away bracketed instructions, quoted asides and whole meta utterances.
BRACKET_META = ("guideline", "instructions", "the user", "format", "word limit")
ASIDE_WORDS = ("this", "that", "check", "finalizing", "putting", "example", "alright", "ok", "okay", "need")
META_PHRASES = ("no markdown", "under 64 words", "word limit", "check the guidelines", "checks guidelines", "avoid repetition", "draft a response", "conversation history", "the user")

ARTIFACT = "|".join(ARTIFACTS)
BRACKETED = rf"\[(?:[^\[\]]{{{MAX_BRACKET_CHARS},}}|[^\[\]]*(?:{'|'.join(BRACKET_META)})[^\[\]]*)\]"
ASIDE = rf'""\s+(?:{"|".join(ASIDE_WORDS)})\b.*$'


def strip(x: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def lines(x: Column) -> Column:
    return F.split(x, LINE_END)


def word_count(x: Column) -> Column:
    return F.size(F.regexp_extract_all(x, F.lit(r"(?U)\S+"), F.lit(0)))


def first_words(x: Column, n: int) -> Column:
    return F.array_join(F.slice(F.regexp_extract_all(x, F.lit(r"(?U)\S+"), F.lit(0)), 1, n), " ")


def strip_artifacts(x: Column) -> Column:
    """Without generation artifacts; gaps are closed only where something was taken out. All begin with a bracket."""
    cut = F.regexp_replace(x, f"(?iu){ARTIFACT}", "")
    tidy = cut
    for pattern, to in ((r"[ \t]{2,}", " "), (r"[ \t]+\n", "\n"), (r"\n[ \t]+", "\n"), (r"(?U)\s+([,.;:!?])", "$1"), (r"(?U)\.\.(\s|$)", ".$1")):
        tidy = F.regexp_replace(tidy, pattern, to)
    return F.when(~x.contains("[") | (cut == x), x).otherwise(strip(tidy))


def strip_bracketed(x: Column) -> Column:
    return F.when(~x.contains("["), x).otherwise(F.regexp_replace(x, f"(?iu){BRACKETED}", ""))


def cut_aside(x: Column) -> Column:
    cut = F.regexp_replace(x, f"(?isu){ASIDE}", "")
    return F.when(~x.contains('""') | (cut == x), x).otherwise(F.regexp_replace(cut, r"(?U)\s+$", ""))


def is_meta(low: Column) -> Column:
    """Of a stripped text in lower case."""
    found = low.startswith(",")
    for phrase in META_PHRASES:
        found = found | low.contains(phrase)
    return found


def is_long(x: Column) -> Column:
    """Words are counted only where there is room for too many: a character each, and one between two."""
    return (F.length(x) > MAX_UTTERANCE_CHARS) | ((F.length(x) > 2 * MAX_UTTERANCE_WORDS) & (word_count(x) > MAX_UTTERANCE_WORDS))


def truncate(x: Column, words: int = MAX_UTTERANCE_WORDS, chars: int = MAX_UTTERANCE_CHARS) -> Column:
    head = F.regexp_extract(x, rf"(?U)^\s*\S+(?:\s+\S+){{0,{words - 1}}}", 0)
    return F.when(is_long(x), F.regexp_replace(F.substring(head, 1, chars), r"(?U)\s+$", "")).otherwise(x)


def cleaned_utterances(utterances: Column) -> Column:
    """array<struct<speaker, text>> to array<struct<speaker, text, meta_removed, truncated>>, in steps, so that each
    step's text is computed once. Texts that turn out empty or meta are null."""
    step = F.transform(utterances, lambda u: F.struct(u["speaker"].alias("speaker"), strip(u["text"]).alias("raw")))
    step = F.filter(step, lambda u: u["raw"] != "")
    step = F.transform(step, lambda u: F.struct(u["speaker"], u["raw"], strip_artifacts(u["raw"]).alias("text")))
    step = F.transform(step, lambda u: F.struct(u["speaker"], u["raw"], strip_bracketed(u["text"]).alias("text")))
    step = F.transform(step, lambda u: F.struct(u["speaker"], u["raw"], cut_aside(u["text"]).alias("text")))
    step = F.transform(step, lambda u: F.struct(u["speaker"], (u["text"] != u["raw"]).alias("changed"), strip(u["text"]).alias("text")))
    step = F.transform(step, lambda u: F.struct(u["speaker"], u["changed"], u["text"], F.lower(u["text"]).alias("low")))
    step = F.transform(step, lambda u: F.struct(u["speaker"], u["changed"], u["text"], (u["text"] != "") & is_meta(u["low"]), is_long(u["text"])))
    return F.transform(
        step,
        lambda u: F.struct(
            u["speaker"].alias("speaker"),
            F.when((u["text"] != "") & ~u["col4"], F.when(u["col5"], truncate(u["text"])).otherwise(u["text"])).alias("text"),
            (u["changed"] | u["col4"]).alias("meta_removed"),
            (u["col5"] & ~u["col4"]).alias("truncated"),
        ),
    )
