"""Column functions on host names and mail addresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lurewatch import reference_lists as lists

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^({_OCTET}\.){{3}}{_OCTET}$"


def text(value: Column) -> Column:
    """Missing text is the empty string."""
    return F.coalesce(value, F.lit(""))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Names a value, so that a long expression is evaluated once although it is used several times."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def is_ip(host: Column) -> Column:
    return host.rlike(IPV4) | host.contains(":")


def domain_of(address: Column) -> Column:
    address = text(address)
    return F.when(address.contains("@"), F.lower(F.trim(F.substring_index(address, "@", -1)))).otherwise("")


def registrable(host: Column) -> Column:
    """The part of a host that is bought: two labels, three under a listed multi-part suffix."""
    host = F.rtrim(F.lower(F.trim(text(host))), F.lit("."))
    two, three = F.substring_index(host, ".", -2), F.substring_index(host, ".", -3)
    return F.when(is_ip(host), host).when(two.isin(lists.MULTI_PART_SUFFIXES) & (three != two), three).otherwise(two)


def registered_domain(host: Column) -> Column:
    """The rule of campaign matching: always the last two labels."""
    return F.substring_index(F.trim(F.lower(text(host)), F.lit(".")), ".", -2)


def suffixes(host: Column) -> Column:
    """The host and every domain above it, longest first."""
    labels = F.split(F.rtrim(F.lower(text(host)), F.lit(".")), r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )


def ip_literal(host: Column) -> Column:
    """The address a browser would open: dotted, IPv6 text, or a bare number; null for a name."""
    number = host.try_cast("bigint")
    octets = [((F.shiftright(number, 24 - 8 * i)).bitwiseAND(255)).cast("string") for i in range(4)]
    return (
        F.when(host.rlike(IPV4) | host.contains(":"), host)
        .when(host.rlike("^[0-9]{1,10}$") & (number <= 4294967295), F.concat_ws(".", *octets))
    )


def punycode_decoded(label: Column) -> Column:
    """Decodes one ``xn--`` label; any other label is returned unchanged.

    The bootstring state is folded over the characters behind the last hyphen; code points are kept in
    an array and turned into text at the end.
    """
    body = F.substring(label, F.lit(5), F.length(label))
    cut = F.length(body) - F.instr(F.reverse(body), "-")
    has_basic = body.contains("-")
    basic = F.when(has_basic, F.substring(body, F.lit(1), cut)).otherwise("")
    coded = F.when(has_basic, F.substring(body, cut + 2, F.length(body))).otherwise(body)
    start = F.struct(
        F.transform(F.filter(F.split(basic, ""), lambda c: c != ""), F.ascii).alias("out"),
        F.lit(128).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("i"), F.lit(72).cast("bigint").alias("bias"),
        F.lit(0).cast("bigint").alias("old_i"), F.lit(1).cast("bigint").alias("w"), F.lit(36).cast("bigint").alias("k"),
    )

    def after_delta(s: Column, v: Column) -> Column:
        """The state behind a complete number: one code point is inserted and the bias adapts."""
        # Divided by 35 until it is small; 13 rounds bring the largest bigint below that.
        halves = F.aggregate(
            F.sequence(F.lit(1), F.lit(13)), F.struct(v["delta"].cast("bigint").alias("left"), F.lit(0).alias("rounds")),
            lambda s, _: F.when(s["left"] <= 455, s).otherwise(F.struct(
                F.floor(s["left"] / 35).alias("left"), (s["rounds"] + 1).alias("rounds"))))
        bias = let(halves, lambda s: s["rounds"] * 36 + F.floor(36 * s["left"] / (s["left"] + 38)))
        at = (v["i"] % v["length"]).cast("int")
        code_point = s["n"] + F.floor(v["i"] / v["length"])
        out = F.concat(
            F.slice(s["out"], F.lit(1), at), F.array(code_point.cast("int")),
            F.slice(s["out"], at + 1, F.size(s["out"]) + 1),
        )
        return F.struct(
            out.alias("out"), code_point.cast("bigint").alias("n"), (at + 1).cast("bigint").alias("i"),
            bias.cast("bigint").alias("bias"), (at + 1).cast("bigint").alias("old_i"),
            F.lit(1).cast("bigint").alias("w"), F.lit(36).cast("bigint").alias("k"),
        )

    def after_digit(s: Column, v: Column) -> Column:
        length = (F.size(s["out"]) + 1).cast("bigint")
        moved = v["i"] - s["old_i"]
        first = F.when(s["old_i"] == 0, F.floor(moved / 700)).otherwise(F.floor(moved / 2))
        more = F.struct(
            s["out"].alias("out"), s["n"].alias("n"), v["i"].alias("i"), s["bias"].alias("bias"), s["old_i"].alias("old_i"),
            (s["w"] * (36 - v["limit"])).alias("w"), (s["k"] + 36).alias("k"),
        )
        done = let(
            F.struct(v["i"].alias("i"), length.alias("length"), (first + F.floor(first / length)).alias("delta")),
            lambda d: after_delta(s, d),
        )
        return F.when(v["digit"] < v["limit"], done).otherwise(more)

    def step(s: Column, char: Column) -> Column:
        code = F.ascii(char)
        digit = F.when(code >= 97, code - 97).otherwise(code - 22).cast("bigint")
        limit = F.greatest(F.lit(1), F.least(F.lit(26), s["k"] - s["bias"]))
        return let(
            F.struct(digit.alias("digit"), limit.alias("limit"), (s["i"] + digit * s["w"]).alias("i")),
            lambda v: after_digit(s, v),
        )

    points = F.aggregate(F.filter(F.split(coded, ""), lambda c: c != ""), start, step)["out"]
    decoded = F.array_join(
        F.transform(points, lambda p: F.decode(F.unhex(F.lpad(F.hex(p), 8, "0")), "UTF-32")), ""
    )
    return F.when(label.rlike("^xn--[a-z0-9-]+$"), decoded).otherwise(label)


def decoded_host(host: Column) -> Column:
    """The host with its ``xn--`` labels decoded; the split runs only where there is one."""
    labels = F.transform(F.split(host, r"\."), punycode_decoded)
    return F.when(host.contains("xn--"), F.array_join(labels, ".")).otherwise(host)


def undo_homoglyphs(label: Column) -> Column:
    """Look-alike pairs first, then single characters."""
    label = F.lower(label)
    for fake, real in lists.LOOKALIKE_PAIRS:
        label = F.replace(label, F.lit(fake), F.lit(real))
    return F.translate(label, lists.LOOKALIKE_CHARS, lists.LOOKALIKE_FOR)


def squash(value: Column) -> Column:
    return F.regexp_replace(F.lower(value), r"[\s-]", "")


def one_edit_apart(a: Column, b: Column) -> Column:
    """Exactly one insertion, deletion, replacement or swap of neighbours."""
    single = F.levenshtein(a, b, 1) == 1
    pairs = F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1)))

    def swapped(i: Column) -> Column:
        return F.concat(
            F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)),
            F.substring(a, i + 2, F.length(a)),
        )

    swap = (F.length(a) == F.length(b)) & (F.length(a) > 1) & (a != b) & F.exists(pairs, lambda i: swapped(i) == b)
    return single | swap
