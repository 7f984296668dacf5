"""Source images to typed target rows, good ones apart from those that cannot be parsed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.strict import field_fault, strict
from tidemark.schemas import TableSpec


def typed(events: DataFrame, spec: TableSpec, image: str = "after") -> DataFrame:
    """Events with ``fault`` and the spec's target columns (null where there is a fault or a delete)."""
    upsert = F.col("op") != "d"
    wanted = spec.source if spec.source else {}
    faults = F.coalesce(*[field_fault(F.col(image), c, kind) for c, kind in wanted.items()])
    no_image = F.when(F.col(image).isNull(), F.lit("missing:image"))
    key_image = F.coalesce(F.col("after"), F.col("before")) if image == "after" else F.col(image)
    delete_fault = F.when(key_image.isNull(), F.lit("missing:image")).otherwise(field_fault(key_image, spec.key, spec.source[spec.key]))
    out = events.withColumn("fault", F.when(upsert, F.coalesce(no_image, faults)).otherwise(delete_fault))
    out = out.withColumn("_p", F.struct(*[strict(F.try_element_at(F.col(image), F.lit(c)), kind).alias(c) for c, kind in wanted.items()]))
    out = out.withColumn("_k", strict(F.try_element_at(key_image, F.lit(spec.key)), spec.source[spec.key]))
    kept = [c for c in events.columns if c not in spec.fields]
    parsed = out.select(*kept, "fault", "_k", "_p.*") if not set(kept) & set(wanted) else out.select("fault", "_k", "_p.*", *[c for c in kept if c not in wanted])
    values = [F.col("_k").alias(spec.key) if t == spec.key else F.expr(e).alias(t) for t, e in spec.fields.items()]
    return parsed.select(*[c for c in kept if c in parsed.columns and c not in spec.fields], "fault", *values)


def mapped(rows: DataFrame, spec: TableSpec) -> DataFrame:
    """Typed source rows to target rows."""
    return rows.select(*[F.expr(e).alias(t) for t, e in spec.fields.items()])
