"""Rules for file paths inside a dataset."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names a portable dataset must not use.
RESERVED_NAMES = (
    ["CON", "PRN", "AUX", "NUL", "CONIN$", "CONOUT$"]
    + [f"COM{d}" for d in "123456789¹²³"]
    + [f"LPT{d}" for d in "123456789¹²³"]
)


def is_unsafe_path(path: Column) -> Column:
    """Absolute, escaping, non-portable or reserved; null counts as unsafe."""
    def bad_part(part: Column) -> Column:
        stem = F.upper(F.rtrim(F.substring_index(part, ".", 1)))
        return (
            part.isin("", ".", "..")
            | part.endswith(" ")
            | part.endswith(".")
            | part.rlike('[<>:"|?*\\x00-\\x1f]')
            | stem.isin(*RESERVED_NAMES)
        )

    return path.isNull() | path.contains("\\") | F.exists(F.split(path, "/"), bad_part)
