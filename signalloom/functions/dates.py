"""Date parsing with strict shapes; every "today" is a parameter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from signalloom.functions.text import as_col, nonblank, strip


def iso_date(value, exact: bool = False) -> Column:
    """Calendar date of an ISO text, else null.

    ``exact`` demands a text of ten characters; otherwise the first ten are read.
    """
    text = strip(value)
    head = text if exact else F.substring(text, 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(head, "yyyy-MM-dd"))


def parse_posted(columns: Sequence, as_of) -> Column:
    """Posting date: first non-empty column, its first ten characters, else ``as_of``."""
    raw = F.coalesce(*[F.when(as_col(c) != "", as_col(c)) for c in columns])
    return F.coalesce(iso_date(raw), F.lit(as_of).cast("date"))


def strict_date(value) -> Column:
    """Date of a text that is exactly an ISO date (no trimming)."""
    text = as_col(value)
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


CLOSING_PATTERN = r"(?is)^\s*Posting End Date\s*:\s*(.+?)\s*$"


def closing_text(fields) -> Column:
    """Raw text after the first closing-date label in a string array."""
    matching = F.filter(as_col(fields), lambda f: f.rlike(CLOSING_PATTERN))
    return F.when(F.size(matching) > 0, F.regexp_extract(F.element_at(matching, 1), CLOSING_PATTERN, 1))


def parse_closing(fields) -> Column:
    """Closing date in ISO, month/day/year or two-digit-year form; null when absent or unreadable."""
    text = closing_text(fields)
    parts = [F.lpad(F.regexp_extract(text, r"^(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})$", g), n, "0") for g, n in ((1, 2), (2, 2))]
    year = F.regexp_extract(text, r"^(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})$", 3)
    century = F.when(F.length(year) == 4, year).when(year.try_cast("int") < 69, F.concat(F.lit("20"), year)).otherwise(F.concat(F.lit("19"), year))
    slashed = F.when(year != "", F.try_to_date(F.concat_ws("-", century, *parts), "yyyy-MM-dd"))
    return F.coalesce(strict_date(text), slashed)


def closing_rejected(fields) -> Column:
    """True when a closing date is present but unreadable."""
    return F.coalesce(closing_text(fields) != "", F.lit(False)) & parse_closing(fields).isNull()


def week_start(value) -> Column:
    """Monday of the date's week."""
    return F.to_date(F.date_trunc("week", as_col(value)))


def timestamp_or_null(value) -> Column:
    """ISO timestamp or date text as a timestamp, else null."""
    text = as_col(value)
    shape = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
    return F.when(text.rlike(shape), text.try_cast("timestamp"))


def valid_date(value) -> Column:
    return timestamp_or_null(value).isNotNull()


def recency_score(value, as_of) -> Column:
    """1, .75, .5 or .25 by age of 90, 180, 365 days; .25 when absent, 0 when unreadable."""
    text = as_col(value)
    age = F.greatest(F.lit(0), F.datediff(F.lit(as_of).cast("date"), F.to_date(timestamp_or_null(text))))
    return (
        F.when(nonblank(text).isNull(), F.lit(0.25))
        .when(~valid_date(text), F.lit(0.0))
        .when(age <= 90, F.lit(1.0))
        .when(age <= 180, F.lit(0.75))
        .when(age <= 365, F.lit(0.5))
        .otherwise(F.lit(0.25))
    )


def is_recent(value, as_of, days: int = 548) -> Column:
    """True when the date lies within ``days`` before ``as_of`` (or later)."""
    day = F.to_date(timestamp_or_null(value))
    return F.coalesce(day >= F.date_sub(F.lit(as_of).cast("date"), days), F.lit(False))
