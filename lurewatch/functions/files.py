"""Column functions on attachment names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lurewatch import reference_lists as lists

REVERSED, REVERSED_END = "‮", "‬"


def without_hidden(name: Column) -> Column:
    return F.regexp_replace(name, lists.HIDDEN_CHAR_CLASS, "")


def visible_name(name: Column) -> Column:
    """What a mail client shows: text behind a right-to-left override appears reversed."""
    at = F.position(F.lit(REVERSED), name)
    before, after = F.substring(name, F.lit(1), at - 1), F.substring(name, at + 1, F.length(name))
    end = F.position(F.lit(REVERSED_END), after)
    turned = F.when(end > 0, F.substring(after, F.lit(1), end - 1)).otherwise(after)
    rest = F.when(end > 0, F.substring(after, end + 1, F.length(after))).otherwise("")
    return F.when(at == 0, without_hidden(name)).otherwise(
        F.concat(without_hidden(before), F.reverse(without_hidden(turned)), without_hidden(rest))
    )


def checked_name(name: Column) -> Column:
    """Lower case without hidden characters and without the dots and spaces at the end that Windows ignores."""
    return F.regexp_replace(F.lower(F.trim(without_hidden(name))), r"[\s\p{Z}.]+$", "")


def extension(name: Column) -> Column:
    return F.when(name.contains("."), F.trim(F.substring_index(name, ".", -1))).otherwise("")


def decoy_extension(name: Column) -> Column:
    """The extension in front of the last one: "pdf" in "invoice.pdf.exe"."""
    stem = F.regexp_extract(name, r"(?s)^(.*)\.", 1)
    return extension(F.regexp_replace(stem, r"[\s\p{Z}.]+$", ""))


def lookup(value: Column, table: dict[str, list[str]]) -> Column:
    """The key whose list holds the value, else null."""
    found = F.lit(None).cast("string")
    for key, members in reversed(list(table.items())):
        found = F.when(value.isin(members), key).otherwise(found)
    return found
