"""JSON in one form: keys in order at every depth, no blanks, numbers without needless zeros."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A string is taken whole and left alone; a fraction loses the zeros at its end, and its point with the last digit.
_STRING = r'("[^"\\]*+(?:\\.[^"\\]*+)*+")'
_ZEROS = _STRING + r"|(?<=\d)(\.\d*?)0+(?=[,\]}]|$)"
_POINT = _STRING + r"|(?<=\d)\.(?=[,\]}]|$)"
_MINUS = _STRING + r"|-(?=0(?:[,\]}]|$))"


def canonical_json(text: Column) -> Column:
    """JSON text with the keys of every object in order (of UTF-16 units); null where it is none.

    A VARIANT holds an object's fields in order of their names, so this needs no Python.  ``1.50``
    becomes ``1.5``, ``2.0`` and ``2e0`` become ``2``; numbers written with an exponent and of
    10^7 or more, or less than 10^-3, keep the form of a Java double.  Of a repeated key the
    text is invalid.
    """
    plain = F.to_json(F.try_parse_json(text))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, _ZEROS, "$1$2"), _POINT, "$1"), _MINUS, "$1")


def canonical_hash(text: Column) -> Column:
    """SHA-256 (hexadecimal) of the canonical form; JSON null stands for what is no JSON."""
    return F.sha2(F.coalesce(canonical_json(text), F.lit("null")).cast("binary"), 256)
