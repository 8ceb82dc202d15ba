"""SPF, DKIM and DMARC verdicts out of Authentication-Results headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MECHANISMS = ("spf", "dkim", "dmarc")


def header_values(headers: Column, name: str) -> Column:
    return F.transform(F.filter(headers, lambda h: F.lower(h["name"]) == name.lower()), lambda h: h["value"])


def without_comments(value: Column) -> Column:
    """Each (comment) of any depth becomes a space, because comments can quote text of the sender. The texts of the open
    levels are kept as a stack; a bracket without its partner stays as it is."""

    def onto(levels: Column, piece) -> Column:
        last = F.size(levels)
        return F.concat(F.slice(levels, F.lit(1), last - 1), F.array(F.concat(F.get(levels, last - 1), piece)))

    def read(levels: Column, piece: Column) -> Column:
        closes = (piece == ")") & (F.size(levels) > 1)
        return (
            F.when(piece == "(", F.concat(levels, F.array(F.lit(""))))
            .when(closes, onto(F.slice(levels, F.lit(1), F.greatest(F.size(levels) - 1, F.lit(1))), F.lit(" ")))
            .otherwise(onto(levels, piece))
        )

    pieces = F.regexp_extract_all(value, F.lit(r"[()]|[^()]+"), 0)
    return F.when(value.contains("("), F.array_join(F.aggregate(pieces, F.array(F.lit("")), read), "(")).otherwise(value)


def _results_in(value: Column, mechanism: str) -> Column:
    segments = F.transform(F.split(without_comments(value), ";"), lambda s: F.lower(F.trim(s)))
    found = F.transform(segments, lambda s: F.regexp_extract(s, rf"^{mechanism}\s*=\s*([a-z]+)", 1))
    return F.filter(found, lambda r: r != "")


def verdict(headers: Column, mechanism: str) -> Column:
    """The topmost header that names the mechanism decides; one passing signature inside it is enough."""
    per_header = F.transform(header_values(headers, "Authentication-Results"), lambda v: _results_in(v, mechanism))
    top = F.get(F.filter(per_header, lambda results: F.size(results) > 0), F.lit(0))
    first = F.get(top, F.lit(0))
    return F.when(F.array_contains(top, "pass"), "pass").when(first == "hardfail", "fail").otherwise(first)
