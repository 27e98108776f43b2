"""Strict types of JSON text: what stands in each field, without casts and without schema inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from .aggregate import once

_KINDS = {"string": ("STRING",), "boolean": ("BOOLEAN",), "int": ("BIGINT",), "bigint": ("BIGINT",), "double": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")}


def _paths(kind: StructType, path: str = "$") -> list[tuple[str, str, DataType]]:
    """(path, parent, type) of all fields, parents first."""
    out = []
    for field in kind.fields:
        at = f"{path}.{field.name}"
        out.append((at, path, field.dataType))
        if isinstance(field.dataType, StructType):
            out += _paths(field.dataType, at)
    return out


def _name(kind: DataType) -> str:
    return "object" if isinstance(kind, StructType) else kind.simpleString()


def _fits(found: Column, kind: DataType) -> Column:
    if isinstance(kind, StructType):
        return found == "OBJECT"
    if isinstance(kind, ArrayType):
        return found.isin("ARRAY<VOID>", *(f"ARRAY<{k}>" for k in _KINDS[kind.elementType.simpleString()]))
    return found.isin(*_KINDS[kind.simpleString()])


def with_type_problem(lines: DataFrame, text: str, schema: str, nullable: tuple[str, ...] = ()) -> DataFrame:
    """lines with problem: what is wrong with the types of a column of JSON objects, by path; empty if nothing is.

    The text is parsed to a variant once. Nothing is cast: "1" is no number, 0 no boolean, true no number, 1.0 no whole
    number. Every key of the schema must be there, null only where its name is in nullable, and no other key may be;
    null text is no object. Types are strings, booleans, ints, longs, doubles, arrays of these and structs.
    """
    whole = StructType.fromDDL(schema)
    paths = [("$", "", whole), *_paths(whole)]
    rows = once(lines, {"__text": F.col(text)})
    rows = once(rows, {"__variant": F.try_parse_json("__text")})
    kind = lambda at: F.regexp_replace(F.schema_of_variant(F.try_variant_get("__variant", at, "variant")), r"^(DECIMAL|OBJECT)[(<].*$", "$1")
    keys = lambda at: F.json_object_keys("__text" if at == "$" else F.get_json_object("__text", at))
    objects = [(i, at, want) for i, (at, _, want) in enumerate(paths) if isinstance(want, StructType)]
    rows = once(rows, {**{f"__kind{i}": kind(at) for i, (at, _, _) in enumerate(paths)}, **{f"__keys{i}": keys(at) for i, at, _ in objects}})
    number = {at: i for i, (at, _, _) in enumerate(paths)}
    checks = []
    for i, (at, above, want) in enumerate(paths[1:], 1):
        found = F.col(f"__kind{i}")
        fits = _fits(found, want) | (found == "VOID") if at.rpartition(".")[2] in nullable else _fits(found, want)
        said = F.when(found.isNull(), F.lit(f"{at} is missing")).when(~fits, F.concat(F.lit(f"{at} is "), found, F.lit(f", not {_name(want)}")))
        checks.append(F.when(F.col(f"__kind{number[above]}") == "OBJECT", said))
    for i, at, want in objects:
        extra = F.array_sort(F.array_except(F.coalesce(f"__keys{i}", F.array().cast("array<string>")), F.array(*(F.lit(f.name) for f in want.fields))))
        checks.append(F.when(F.size(extra) > 0, F.concat(F.lit(f"unknown keys at {at}: "), F.array_join(extra, ", "))))
    problem = F.when(F.col("__kind0").eqNullSafe("OBJECT"), F.concat_ws("; ", *checks)).otherwise("not an object")
    return once(rows, {"problem": problem}).select(*lines.columns, "problem")
