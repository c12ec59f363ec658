"""Per-record overrides. A present key replaces the field even when its value is blank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import OVERRIDE_FIELDS


def apply_overrides(
    rows: DataFrame, overrides: DataFrame, field_map: dict[str, str] = OVERRIDE_FIELDS, key: str = "id"
) -> DataFrame:
    """Left join on the id; ``overrides`` is (id, fields map<string,string>, waivers array<string>).

    The join strategy is left to the size check of the optimizer: override tables are normally
    tiny and broadcast, a large one is shuffled.
    """
    joined = rows.join(overrides, key, "left")
    replaced = {
        field: F.when(
            F.coalesce(F.map_contains_key("fields", F.lit(name)), F.lit(False)),
            F.coalesce(F.trim(F.element_at("fields", F.lit(name))), F.lit("")),
        ).otherwise(F.col(field))
        for name, field in field_map.items()
        if field in rows.columns
    }
    return joined.select(
        *[replaced[c].alias(c) if c in replaced else F.col(c) for c in rows.columns],
        F.coalesce("waivers", F.array().cast("array<string>")).alias("waivers"),
    )
