"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space at the ends of a
# text (ASCII controls, space, next line, no-break space, Unicode spaces).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
#: The text a missing value turns into when a column is made text.
MISSING_TEXT = "nan"


def strip(column: str) -> Column:
    """Remove white space of every kind at both ends; SQL trim removes only spaces.

    Looking each end up in the list above is slow, and almost no text needs it. A
    text that starts and ends with a printable ASCII character, which a comparison
    of single bytes tells, is left as it is.
    """
    text = F.col(column)
    plain = text.between("!", "\x7f") & F.substring(text, -1, 1).between("!", "\x7f")
    return F.when(plain, text).otherwise(F.btrim(text, F.lit(WHITESPACE)))
