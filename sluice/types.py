"""The engine's type names and schemas, and their Spark types."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.errors import SluiceError

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
UNSIGNED, WIDE = T.DecimalType(20, 0), T.DecimalType(38, 0)

#: Type names as schemas spell them.
BY_NAME = {
    "UInt": UNSIGNED, "U128": WIDE, "Int": T.LongType(), "Int8": T.ByteType(), "I128": WIDE, "Float": T.DoubleType(), "Boolean": T.BooleanType(),
    "String": T.StringType(), "Text": T.StringType(), "Binary": T.BinaryType(), "Decimal": T.DecimalType(38, 10), "Timestamp": T.TimestampType(),
    "Date": T.DateType(), "Json": T.VariantType(), "Point": POINT, "Duration": T.DayTimeIntervalType(0, 3),
}
_FOLDED = {k.lower(): (k, v) for k, v in BY_NAME.items()}


def spark_type(name: str) -> T.DataType:
    try:
        return _FOLDED[name.lower()][1]
    except KeyError:
        raise SluiceError(f"no type {name!r}") from None


def type_name(kind: T.DataType) -> str:
    """The engine's name of a Spark type; integers narrower than 64 bits are Int, float is Float."""
    if isinstance(kind, T.DecimalType):
        return {(20, 0): "UInt", (38, 0): "I128"}.get((kind.precision, kind.scale), "Decimal")
    if isinstance(kind, (T.ShortType, T.IntegerType)):
        return "Int"
    if isinstance(kind, T.FloatType):
        return "Float"
    if isinstance(kind, (T.TimestampNTZType,)):
        return "Timestamp"
    if isinstance(kind, T.DayTimeIntervalType):
        return "Duration"
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return "Json"
    if isinstance(kind, T.StructType):
        return "Point" if [f.name for f in kind.fields] == ["x", "y"] else "Json"
    return next((k for k, v in BY_NAME.items() if v == kind), "String")


@dataclass
class Schema:
    """Fields and the places of the primary key; no key means that rows are only ever inserted."""

    fields: T.StructType
    key: list[int] = field(default_factory=list)

    @property
    def key_names(self) -> list[str]:
        return [self.fields.fields[i].name for i in self.key]

    def to_json(self) -> dict:
        return {"schema": {"fields": [{"name": f.name, "typ": type_name(f.dataType), "nullable": f.nullable} for f in self.fields], "primary_index": self.key}}

    @staticmethod
    def from_json(value: dict) -> Schema:
        own = value.get("schema", value)
        return Schema(T.StructType([T.StructField(f["name"], spark_type(f["typ"]), f.get("nullable", True)) for f in own["fields"]]), list(own.get("primary_index", [])))


def rendered(c: Column, kind: T.DataType) -> Column:
    """The text form of a value: TRUE and FALSE, RFC 3339 times, POINT(x, y), and '' for NULL."""
    if isinstance(kind, T.BooleanType):
        out = F.upper(c.cast("string"))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        out = F.date_format(c.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
        out = F.regexp_replace(F.regexp_replace(out, r"\.000000", ""), r"Z$", "+00:00")
    elif isinstance(kind, T.StructType) and type_name(kind) == "Point":
        out = F.concat(F.lit("POINT("), c["x"].cast("string"), F.lit(", "), c["y"].cast("string"), F.lit(")"))
    elif isinstance(kind, T.VariantType):
        out = F.to_json(c)
    else:
        out = c.cast("string")
    return F.coalesce(out, F.lit(""))
