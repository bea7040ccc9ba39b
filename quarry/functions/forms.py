"""Named forms: a fixed lookup table, and parsing of form texts against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of forms in common use; fixed values.
NAMED = [
    "10-K", "10-K/A", "10-K405", "10-K405/A", "10-Q", "10-Q/A", "8-K", "8-K/A", "DEF 14A", "DEF 14A/A", "DEFA14A",
    "S-1", "S-1/A", "F-1", "F-1/A", "S-3", "S-3/A", "S-2", "S-2/A", "S-4", "S-4/A", "S-8", "S-8/A",
    "3", "4", "4/A", "3/A", "5", "SCHEDULE 13D", "SCHEDULE 13D/A", "SCHEDULE 13G", "SCHEDULE 13G/A",
    "13F-HR", "13F-HR/A", "NPORT-P", "NPORT-P/A", "497", "497K", "485BPOS", "424B4", "424B2", "424B3", "424B5",
    "144", "D", "D/A", "6-K", "FWP", "10-D", "40-APP/A", "ABS-EE",
]
#: Those that are no longer filed; fixed values.
RETIRED = ["10-K405", "10-K405/A", "DEF 14A/A", "S-2", "S-2/A", "S-8/A"]


def table(spark: SparkSession) -> DataFrame:
    """form, retired."""
    return spark.createDataFrame([(f, f in RETIRED) for f in NAMED], "form string, retired boolean")


def _any_case(c: Column, names: list[str]) -> Column:
    return F.upper(F.trim(c)).isin(names)


def parsed(c: Column) -> Column:
    """A form's canonical text: named ones in any case, others as they are."""
    return F.when(_any_case(c, NAMED), F.upper(F.trim(c))).otherwise(c)


def is_named(c: Column) -> Column:
    return _any_case(c, NAMED)


def is_retired(c: Column) -> Column:
    return _any_case(c, RETIRED)
