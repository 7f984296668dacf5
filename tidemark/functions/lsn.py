"""Log positions: hi/lo hexadecimal text and its 64-bit number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_lsn(text: Column) -> Column:
    """'1A/2B' to a long; null where the text is not two hexadecimal numbers of up to eight digits."""
    ok = text.rlike("^[0-9A-Fa-f]{1,8}/[0-9A-Fa-f]{1,8}$")
    hi = F.conv(F.substring_index(text, "/", 1), 16, 10).cast("bigint")
    lo = F.conv(F.substring_index(text, "/", -1), 16, 10).cast("bigint")
    return F.when(ok, F.shiftleft(hi, 32).bitwiseOR(lo))


def format_lsn(lsn: Column) -> Column:
    """A long as upper-case hi/lo."""
    return F.concat(F.hex(F.shiftrightunsigned(lsn, 32)), F.lit("/"), F.hex(lsn.bitwiseAND(0xFFFFFFFF)))


def lsn_lag(ahead: Column, behind: Column) -> Column:
    """Bytes between two positions, null counting as 0."""
    return F.coalesce(ahead - behind, F.lit(0))
