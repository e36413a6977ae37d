"""Labels as they come in JSON, as integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def label_to_int(raw: Column) -> Column:
    """The integer of a label's JSON text; null if it has none.

    Strings count if they are whole numbers, with white space around at most; numbers
    lose their fraction; true is 1 and false 0. Null, other strings, lists and objects
    have no integer.
    """
    text = F.trim(raw)
    quoted = text.startswith('"')
    inner = F.trim(F.regexp_replace(text, r'^"|"$', ""))
    whole = F.when(inner.rlike(r"^[+-]?[0-9]+$"), inner.try_cast("long"))
    number = F.when(text.rlike(r"^-?[0-9]+$"), text.try_cast("long")).when(
        text.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), text.try_cast("double").try_cast("long")
    )
    return F.when(quoted, whole).when(text == "true", F.lit(1).cast("long")).when(text == "false", F.lit(0).cast("long")).otherwise(number)


def binarise(label: Column) -> Column:
    """1 for any label but 0."""
    return (label != 0).cast("int")


def label_for_json(raw: Column) -> Column:
    """The label's text: of an integer where it is one, else as it stands."""
    return F.coalesce(label_to_int(raw).cast("string"), F.regexp_replace(raw, r'^"|"$', ""))
