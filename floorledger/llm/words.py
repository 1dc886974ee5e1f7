"""Words of a text as column expressions."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: runs of ASCII digits, lower-case ASCII letters and all characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# What stands between words, one by one: Java looks single characters up in a table, and ranges one after another.
BETWEEN = "[" + "".join(rf"\x{code:02X}" for code in range(128) if not re.match(WORD, chr(code))) + "]+"


def ascii_lowered(text: Column) -> Column:
    """A-Z to a-z and nothing else; ``lower`` does just that, and faster, where all characters are ASCII."""
    letters = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(letters)


def words(text: Column) -> Column:
    """Array of words; null text has none."""
    parts = F.split(ascii_lowered(F.coalesce(text.cast("string"), F.lit(""))), BETWEEN)
    return F.array_remove(parts, "")  # before the first word and after the last
