"""White space as the rules of texts know it, which is more than what SQL's trim takes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: every character that counts as white space (fixed value): line ends, tabs, information separators, and all space separators of Unicode
SPACE = "".join(chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
SPACES = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in SPACE) + "]"


def strip(c: Column | str) -> Column:
    """A text without white space at its ends."""
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(SPACE))


def blank(c: Column | str) -> Column:
    """Whether a text is nothing but white space."""
    return strip(c) == ""


def pieces(c: Column | str) -> Column:
    """What stands between white space."""
    return F.filter(F.split(strip(c), f"{SPACES}+"), lambda x: x != "")
