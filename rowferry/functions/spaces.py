"""White space as Unicode counts it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters with the property White_Space.
WHITE_SPACE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trim_space(text: Column) -> Column:
    """Cut white space at both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))
