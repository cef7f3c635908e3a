"""Small string expressions: slugs, path parts."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(label: Column) -> Column:
    """Runs of anything but word characters and hyphens become underscores one by one; none at the ends."""
    return F.btrim(F.regexp_replace(label, r"(?U)[^\w\-]", "_"), F.lit("_"))


def unslug(stem: Column) -> Column:
    """The usual reading of a slug: "__" was ", ", "_" was a blank."""
    return F.replace(F.replace(stem, F.lit("__"), F.lit(", ")), F.lit("_"), F.lit(" "))


def last_segment(identifier: Column) -> Column:
    return F.element_at(F.split(identifier, "/"), -1)


def partition_date(path: Column) -> Column:
    """The date of an updated_date=YYYY-MM-DD folder in a path, else null."""
    found = F.regexp_extract(path, r"updated_date=(\d{4}-\d{2}-\d{2})", 1)
    return F.when(found != "", found.cast("date"))
