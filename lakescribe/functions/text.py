"""Text forms shared by the documentation datasets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _replace_all(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


# Markup characters and their escapes; the ampersand must come first.
MARKUP = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))
HTML = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;"), ("+", "&#43;"))


def escape_markup(text: Column) -> Column:
    return _replace_all(text, MARKUP)


def escape_html(text: Column) -> Column:
    return _replace_all(text, HTML)


def yes_no(flag: Column) -> Column:
    return F.when(flag, F.lit("Y")).otherwise(F.lit("N"))


def seconds(stamp: Column) -> Column:
    """Date and time to the second, '' if missing."""
    return F.coalesce(F.date_format(stamp, "yyyy-MM-dd HH:mm:ss"), F.lit(""))


def rfc3339(stamp: Column) -> Column:
    """The instant in UTC, whatever the session time zone is."""
    return F.date_format(F.to_utc_timestamp(stamp, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
