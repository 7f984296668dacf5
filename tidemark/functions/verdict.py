"""What to do about a failure, by its SQLSTATE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: states and classes of the SQL standard
RETRY_STATES = ("40001", "40P01", "55P03")
RETRY_CLASSES = ("08", "53", "57")
DATA_CLASSES = ("22", "23")
HALT_CLASSES = ("28", "3D", "3F", "42")
#: A state's beginning decides; no two of these begin alike.
BY_BEGINNING = (("RETRY", RETRY_STATES + RETRY_CLASSES), ("DEAD_LETTER", DATA_CLASSES), ("HALT", HALT_CLASSES))
DATA_ERRORS = (ValueError, ArithmeticError, KeyError)


def verdict(state: Column, is_data_error: Column | None = None) -> Column:
    """RETRY, DEAD_LETTER or HALT; data errors without a listed state are dead letters, anything else is retried."""
    out = None
    for what, beginnings in BY_BEGINNING:
        hit = state.rlike(f"^(?:{'|'.join(beginnings)})")
        out = F.when(hit, what) if out is None else out.when(hit, what)
    if is_data_error is not None:
        out = out.when(is_data_error, "DEAD_LETTER")
    return out.otherwise("RETRY")


def _causes(error: BaseException):
    seen: BaseException | None = error
    while seen is not None:
        yield seen
        seen = seen.__cause__ or seen.__context__


def verdict_of(error: BaseException) -> str:
    """The verdict on an exception: its own, else that of the first SQLSTATE among its causes, else by kind."""
    for e in _causes(error):
        own = getattr(e, "verdict", None)
        if own:
            return own
        get = getattr(e, "getSqlState", None)
        state = get() if callable(get) else None
        if state:
            listed = [what for what, beginnings in BY_BEGINNING if state.startswith(beginnings)]
            if listed:
                return listed[0]
            break
    return "DEAD_LETTER" if any(isinstance(e, DATA_ERRORS) for e in _causes(error)) else "RETRY"


def clipped(text: Column, most: int = 4000) -> Column:
    """Text of at most that many characters, marked where it was cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)
