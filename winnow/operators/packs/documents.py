"""Schema-on-read profiles of JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
SHOWN_FIELDS = 10


# Inferred SQL type to type label.
TYPE_LABELS = {"STRING": "string", "BIGINT": "integer", "BOOLEAN": "boolean"}


def _type_label(value: Column) -> Column:
    """Type label of a variant value."""
    kind = F.schema_of_variant(value)
    out = F.when(F.startswith(kind, F.lit("OBJECT")), "map").when(
        F.startswith(kind, F.lit("ARRAY")), "array"
    )
    for sql_type, label in TYPE_LABELS.items():
        out = out.when(kind == sql_type, label)
    return out.otherwise("unknown")


def field_types(docs: DataFrame, key: str = "doc_id", json: str = "doc", shown: int = SHOWN_FIELDS) -> DataFrame:
    """Per document, its first field names with inferred types and the count of further fields.

    Each document is parsed once into variants, which carry their types.
    """
    names = F.json_object_keys(json)
    values = F.try_variant_get(F.try_parse_json(json), "$", "map<string,variant>")
    parsed = docs.select(key, names.alias("names"), values.alias("vals"))
    described = F.transform(
        F.slice("names", 1, shown),
        lambda n: F.concat(n, F.lit(" ("), _type_label(F.try_element_at("vals", n)), F.lit(")")),
    )
    more = F.greatest(F.size("names") - shown, F.lit(0)).cast("bigint")
    return parsed.select(key, F.array_join(described, ", ").alias("fields"), more.alias("n_more"))


def state_machine_stats(machines: DataFrame, order: str = "name", first: int | None = None) -> DataFrame:
    """State count and names of the (first) definitions; definitions that are not JSON are skipped.

    ``machines``: name, definition.
    """
    few = machines.orderBy(order).limit(first) if first is not None else machines
    ok = F.try_parse_json("definition").isNotNull()
    states = F.json_object_keys(F.get_json_object("definition", "$.States"))
    return few.filter(ok).select(
        "name",
        F.coalesce(F.size(states), F.lit(0)).cast("bigint").alias("n_states"),
        F.coalesce(F.array_join(states, ", "), F.lit("")).alias("states"),
    )
