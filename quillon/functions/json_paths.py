"""Paths of nested JSON fields as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What matters in a VARIANT's schema: where objects and arrays open and close, and the names of fields, in backticks if they aren't plain words.
_MARKS = "OBJECT<|ARRAY<|>|`(?:[^`]|``)*`: |[^<>:,` ]+: "


def field_paths(v: Column, arrays: bool = True, quoted: bool = False) -> Column:
    """The sorted distinct dot paths of the nested fields of a VARIANT, the ones on the way included, at any depth.

    [] stands for any element of an array; without arrays, nothing inside one is looked at. quoted keeps the backticks
    of names that aren't plain words, so that a dot or bracket in a name can't be taken for a step. The paths are read
    off the value's schema: every name is put after the names of the objects around it.
    """
    marks = F.regexp_extract_all(F.schema_of_variant(v), F.lit(_MARKS), F.lit(0))
    start = F.struct(F.lit("").alias("at"), F.array().cast("array<string>").alias("open"), F.array().cast("array<string>").alias("paths"))

    def step(acc: Column, mark: Column) -> Column:
        name = F.regexp_replace(mark, "(?s)^(.*): $", "$1")
        plain = F.when(name.startswith("`"), F.replace(F.regexp_replace(name, "(?s)^`(.*)`$", "$1"), F.lit("``"), F.lit("`"))).otherwise(name)
        field = name if quoted else plain
        opened = F.struct(acc["at"].alias("at"), F.concat(acc["open"], F.array(acc["at"])).alias("open"), acc["paths"].alias("paths"))
        element = F.concat(acc["at"], F.lit("[]"))
        array = F.struct(element.alias("at"), F.concat(acc["open"], F.array(element)).alias("open"), F.concat(acc["paths"], F.array(element)).alias("paths"))
        left = F.slice(acc["open"], 1, F.size(acc["open"]) - 1)
        closed = F.struct(F.coalesce(F.try_element_at(left, F.lit(-1)), F.lit("")).alias("at"), left.alias("open"), acc["paths"].alias("paths"))
        holder = F.coalesce(F.try_element_at(acc["open"], F.lit(-1)), F.lit(""))
        full = F.when(holder == "", field).otherwise(F.concat(holder, F.lit("."), field))
        named = F.struct(full.alias("at"), acc["open"].alias("open"), F.concat(acc["paths"], F.array(full)).alias("paths"))
        return F.when(mark == "OBJECT<", opened).when(mark == "ARRAY<", array).when(mark == ">", closed).otherwise(named)

    paths = F.aggregate(marks, start, step, lambda acc: acc["paths"])
    if not arrays:
        paths = F.filter(paths, lambda p: ~p.contains("[]"))
    return F.array_sort(F.array_distinct(paths))
