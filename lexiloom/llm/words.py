"""Words of texts as native columns: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiloom.functions.numbers import let

#: What separates words once A-Z are lower case; upper case is spelt out for use before that.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; other letters stay as they are."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def word_array(text: Column) -> Column:
    """The words in order; null and texts without words give an empty array."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), GAP), lambda w: w != "")


def word_count(text: Column) -> Column:
    """The size of ``word_array`` without making it: pieces between gaps, less the empty ones at the ends."""
    empty = lambda s, at: F.when(F.element_at(s, at) == "", 1).otherwise(0)
    pieces = F.split(F.coalesce(text, F.lit("")), f"{GAP_ANY_CASE}+")
    return let(pieces, lambda s: F.size(s) - empty(s, 1) - F.when(F.size(s) > 1, empty(s, -1)).otherwise(0))
