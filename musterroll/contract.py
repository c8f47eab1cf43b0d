"""The target table contract, and small tables derived from it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from musterroll import fixed_values as V


@dataclass(frozen=True)
class Field:
    pos: int
    name: str
    header: str
    kind: str
    required: bool
    allowed: tuple[str, ...] = ()
    lowest: int | None = None
    highest: int | None = None
    spellings: tuple[str, ...] = ()

    @property
    def label(self) -> str:
        """Header without the star that marks required fields."""
        return self.header.rstrip("*")

    @property
    def can_suggest(self) -> bool:
        """Whether an error on this field can carry a suggested value."""
        return self.kind in ("date", "postcode") or bool(self.allowed)


def _build() -> tuple[Field, ...]:
    return tuple(
        Field(
            pos,
            name,
            header,
            kind,
            required,
            tuple(V.ALLOWED_VALUES.get(name, ())),
            *V.VALUE_RANGE.get(name, (None, None)),
            tuple(V.HEADER_SPELLINGS[name]),
        )
        for pos, (name, header, kind, required) in enumerate(V.FIELDS)
    )


CONTRACT: tuple[Field, ...] = _build()
BY_NAME = {f.name: f for f in CONTRACT}
NAMES = [f.name for f in CONTRACT]
HEADERS = [f.header for f in CONTRACT]
WIDTH = len(CONTRACT)
MEDICAL_POS = BY_NAME["medical_conditions"].pos
DATE_POS = BY_NAME["date_of_birth"].pos
ADDRESS_POS = BY_NAME["address1"].pos
REQUIRED = [f for f in CONTRACT if f.required]

OUTPUT_SCHEMA = T.StructType([T.StructField(n, T.StringType(), True) for n in NAMES])


def fields_table(spark: SparkSession) -> DataFrame:
    """One row per contract field (a fixed twenty rows)."""
    return spark.createDataFrame(
        [(f.pos, f.name, f.header, f.label, f.kind, f.required) for f in CONTRACT],
        "field_pos int, field string, field_header string, label string, kind string, required boolean",
    )
