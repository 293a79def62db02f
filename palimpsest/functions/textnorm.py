"""Normalisation: NFKC, two zero-width characters, blanks, newlines, ends. Null stays null."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Texts of these characters alone are their own NFKC form, so they needn't leave the JVM.
STABLE = r"^[\x00-\x7fÀ-ÿ]*\z"
#: White space as Python's str.strip has it: Java's Unicode \s lacks U+001C to U+001F.
SPACE = r"[\s\x1c-\x1f]"


@F.arrow_udf(StringType())
def _compose(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


def nfkc(text: Column) -> Column:
    """Unicode compatibility composition. Only texts that may change are sent to Python; the others send a null."""
    stable = text.rlike(STABLE)
    return F.coalesce(F.when(stable, text), _compose(F.when(~stable, text)))


def strip_zero_width(text: Column) -> Column:
    return F.translate(text, "​﻿", "")


def collapse_blanks(text: Column) -> Column:
    return F.regexp_replace(text, "[ \t]+", " ")


def collapse_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\n{3,}", "\n\n")


def strip(text: Column) -> Column:
    """Without white space at both ends, by Unicode's notion of it."""
    return F.regexp_replace(text, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def normalise(text: Column, unicode: bool = True) -> Column:
    """All steps in their order. unicode=False leaves out the composition, for text known to be composed."""
    return strip(collapse_newlines(collapse_blanks(strip_zero_width(nfkc(text) if unicode else text))))
