"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that part words.
PUNCTUATION = "([,.!?:;])"
PUNCTUATION_MORE = PUNCTUATION + "=&"


#: Unicode white space, with the four separators U+001C to U+001F.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def pieces(text: Column | str, punctuation: str = PUNCTUATION) -> Column:
    """Lower-case words and empty pieces between them: white space and punctuation part words.  Null text has no word."""
    parting = punctuation + SPACES
    low = F.translate(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), parting, " " * len(parting))
    return F.split(low, " ")


def words(text: Column | str, punctuation: str = PUNCTUATION) -> Column:
    """The words of :func:`pieces` alone."""
    return F.array_remove(pieces(text, punctuation), "")


def comma_list(text: Column | str) -> Column:
    """Parts between commas without white space around them; empty parts stay."""
    c = F.col(text) if isinstance(text, str) else text
    return F.transform(F.split(c, ",", -1), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", ""))


def year_of(date: Column | str) -> Column:
    """The number before the first dash; bad text raises."""
    c = F.col(date) if isinstance(date, str) else date
    return F.split(c, "-")[0].cast("int")
