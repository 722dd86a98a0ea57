"""Canonical columns of a filing, and how headers that drift from year to year are brought to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The columns of the published layout in its order (naics_year, of the later one, after naics_code), with the type that
# each is read as; those that a file must have are marked *.
LAYOUT = """
id                            bigint
company_name                  string
establishment_name            string
ein                           string
city                          string
state                         string
zip_code                      string
naics_code                    bigint  *
naics_year                    int
industry_description          string
annual_average_employees      double  *
total_hours_worked            double  *
no_injuries_illnesses         double
total_deaths                  double  *
total_dafw_cases              double  *
total_djtr_cases              double  *
total_other_cases             double  *
total_dafw_days               double
total_djtr_days               double
total_injuries                double
total_poisonings              double
total_respiratory_conditions  double
total_skin_disorders          double
total_hearing_loss            double
total_other_illnesses         double
establishment_id              bigint  *
establishment_type            double
size                          double
year_filing_for               int     *
created_timestamp             string
change_reason                 string
"""
COLUMNS = {name: kind for name, kind, *_ in map(str.split, LAYOUT.strip().splitlines())}
REQUIRED = [name for name, _, *mark in map(str.split, LAYOUT.strip().splitlines()) if mark]

#: The kinds of case that a filing counts, from deaths to others.
CASES = [c for c in REQUIRED if c.startswith("total_") and c != "total_hours_worked"]


class SchemaError(ValueError):
    """A file lacks a required column, or isn't laid out as one table."""


def filing_schema() -> T.StructType:
    """The layout as a schema; everything may be null."""
    return T.StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in COLUMNS.items()))


def normalised(names: list[str]) -> list[str]:
    """Header names without space around them and in lower case, each once."""
    out = [n.replace("﻿", "").strip().lower() for n in names]
    if len(set(out)) != len(out):
        raise SchemaError(f"a column name occurs twice: {sorted({n for n in out if out.count(n) > 1})}")
    return out


def number(column: str, kind: str = "double"):  # noqa: ANN201
    """Text as a number, null if it isn't one: type suffixes, underscores, NaN and infinities are not numbers."""
    text = F.trim(F.col(column).cast("string"))
    plain = F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text)
    value = plain.try_cast("double")
    value = F.when(F.abs(value) < float("inf"), value)
    return value if kind == "double" else F.when(value == F.floor(value), value).try_cast(kind)


def to_canonical(raw: DataFrame) -> tuple[DataFrame, list[str]]:
    """(`raw` on the canonical columns with their types, names of columns left out); missing optional ones are null.

    Columns are found by name, so their order in a file doesn't matter.
    """
    named = raw.toDF(*normalised(raw.columns))
    if missing := [c for c in REQUIRED if c not in named.columns]:
        raise SchemaError(f"missing required columns: {missing}")
    columns = []
    for f in filing_schema().fields:
        if f.name not in named.columns:
            columns.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif f.dataType != T.StringType():
            columns.append(number(f.name, f.dataType.simpleString()).alias(f.name))
        else:
            columns.append(F.col(f.name).cast("string").alias(f.name))
    return named.select(*columns), [c for c in named.columns if c not in COLUMNS]
