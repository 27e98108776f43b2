"""Hash arithmetic on SHA-256 without leaving built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HEX = "0123456789abcdef"


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def hex_digit(h: Column, place: int) -> Column:
    """Value of a lowercase hex digit; places from 1, negative ones from the end."""
    return F.instr(F.lit(_HEX), F.substring(h, place, 1)) - 1


def sha_mod10(h: Column) -> Column:
    """The 256-bit number modulo 10: powers of 16 from the first on are 6 modulo 10."""
    rest = F.aggregate(F.split(F.substring(h, 1, 63), "(?!^)"), F.lit(0), lambda s, d: s + F.instr(F.lit(_HEX), d) - 1)
    return (F.lit(6) * rest + hex_digit(h, -1)) % 10


def sha_mod4(h: Column) -> Column:
    return hex_digit(h, -1) % 4


def split_of(key: Column) -> Column:
    """train (8 of 10), dev, test, from the key's hash; an empty or null key is an error."""
    ten = sha_mod10(sha256(key))
    checked = F.when(F.coalesce(key, F.lit("")) == "", F.raise_error(F.lit("split needs a non-empty id")).cast("int")).otherwise(ten)
    return F.when(checked <= 7, "train").when(checked == 8, "dev").otherwise("test")
