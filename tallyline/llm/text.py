"""Words and lower case, alike in Spark expressions and in Python tasks."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# What separates words, for words of letters and digits and for words between spaces.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACED_WORD = r"[^\x20\x09-\x0D]+"

_WORD_BYTES = re.compile(WORD.encode())


def ascii_lower(text: Column) -> Column:
    """The text with A to Z in lower case and nothing else changed.

    A text of single-byte characters has no other upper case, so that the quick built-in serves.
    """
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def lower_bytes(text: str | None) -> bytes:
    """UTF-8 with A to Z in lower case; null counts as empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def words(lowered: bytes) -> list[bytes]:
    """Words of letters, digits and non-ASCII characters, all as UTF-8."""
    return _WORD_BYTES.findall(lowered)


def spaced_words(lowered: bytes) -> list[bytes]:
    """Words between ASCII white space; bytes.split() separates at just these six characters."""
    return lowered.split()
