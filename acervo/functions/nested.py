"""The strings inside nested columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

KIND = "array<struct<path:string,text:string>>"


def strings_of(value: Column, kind: DataType, path: Column) -> Column | None:
    """All strings of a value as an array of (path, text); None where its type has none.

    Structs are walked by field (``a.b``), arrays by place (``a[0]``), the
    values of maps by key (``a.key``). Nulls give nothing.
    """
    if isinstance(kind, StringType):
        return F.when(value.isNotNull(), F.array(F.struct(path.alias("path"), value.alias("text")))).otherwise(F.array().cast(KIND))
    if isinstance(kind, StructType):
        inner = [strings_of(value[f.name], f.dataType, F.concat(path, F.lit(f".{f.name}"))) for f in kind]
        found = [part for part in inner if part is not None]
        return F.concat(*found) if found else None
    if isinstance(kind, MapType):
        if strings_of(F.lit(None), kind.valueType, path) is None:
            return None
        entries = F.map_entries(value)
        parts = F.transform(entries, lambda e: strings_of(e["value"], kind.valueType, F.concat(path, F.lit("."), e["key"].cast("string"))))
        return F.coalesce(F.flatten(parts), F.array().cast(KIND))
    if isinstance(kind, ArrayType):
        if strings_of(F.lit(None), kind.elementType, path) is None:
            return None
        parts = F.transform(value, lambda x, i: strings_of(x, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        return F.coalesce(F.flatten(parts), F.array().cast(KIND))
    return None


def nested_texts(rows: DataFrame, subject: str) -> DataFrame:
    """(subject, path, text) of every string in the other columns of a table, however deep."""
    found = [strings_of(F.col(f"`{f.name}`"), f.dataType, F.lit(f.name)) for f in rows.schema if f.name != subject]
    parts = [part for part in found if part is not None]
    every = reduce(lambda a, b: F.concat(a, b), parts) if parts else F.array().cast(KIND)
    return rows.select(F.col(subject), F.explode(every).alias("s")).select(subject, "s.path", "s.text")
