"""Reading and writing labels: sample classes, file names, numbers on axes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def leukaemia_class(label: Column) -> Column:
    """``AML``, ``ALL B`` or ``ALL T`` out of a sample's name; any other name is an error."""
    up = F.upper(label)
    known = F.when(F.contains(up, F.lit("AML")), "AML").when(up.rlike("ALL.*B"), "ALL B").when(up.rlike("ALL.*T"), "ALL T")
    return known.otherwise(F.raise_error(F.concat(F.lit("no class in "), label)))


def scientific(x: Column) -> Column:
    """A number as an axis shows it: two digits and an exponent."""
    return F.format_string("%.2e", x.cast("double"))


def numbered(path: Column) -> Column:
    """The number at the end of a file's name, before its suffix: ``a/prefix_12.npz`` as 12; null if there is none."""
    return F.nullif(F.regexp_extract(path, r"_([0-9]+)\.[^./]+$", 1), F.lit("")).cast("int")


def signed_log(x: Column) -> Column:
    """log10(1 + x) of what isn't negative."""
    return F.log10(1 + F.greatest(x, F.lit(0.0)))
