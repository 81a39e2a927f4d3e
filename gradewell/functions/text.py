"""Scalar text expressions (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BEL = "\u0007"


def blank_controls(text: Column) -> Column:
    """Newline and BEL become spaces; tabs and everything else are kept."""
    return F.translate(text, "\n" + BEL, "  ")


def collapse_spaces(text: Column) -> Column:
    """Runs of the space character collapse to one; no trim (G1)."""
    return F.regexp_replace(text, " +", " ")


def clean_merged(text: Column) -> Column:
    return collapse_spaces(blank_controls(text))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """Basename without its last extension."""
    b = basename(path)
    return F.regexp_replace(b, r"\.[^.]*$", "")


def artefact_name(path: Column) -> Column:
    """Basename, extension stripped, '/' replaced by '-' (A8, G6)."""
    return F.replace(stem(path), F.lit("/"), F.lit("-"))
