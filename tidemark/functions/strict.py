"""Parsing that rejects what a strict parser rejects; a value is missing, bad or good."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SHAPES = {
    "bigint": r"^[+-]?[0-9]+$",
    "int": r"^[+-]?[0-9]+$",
    "decimal": r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$",
    "timestamp": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,9})?)?(Z|[+-][0-9]{2}:[0-9]{2})$",
}


def strict(value: Column, kind: str) -> Column:
    """The value as that type, or null: no spaces around numbers, an offset in each timestamp."""
    if kind == "string":
        return value
    shape = _SHAPES["decimal" if kind.startswith("decimal") else kind]
    return F.when(value.rlike(shape), value.try_cast(kind))


def field_fault(image: Column, name: str, kind: str) -> Column:
    """'missing', 'null' or 'bad' with the field's name; null where the field can be used."""
    value = F.try_element_at(image, F.lit(name))
    fault = F.when(~F.map_contains_key(image, name), F.lit(f"missing:{name}")).when(value.isNull(), F.lit(f"null:{name}"))
    return fault if kind == "string" else fault.when(strict(value, kind).isNull(), F.lit(f"bad:{name}"))
