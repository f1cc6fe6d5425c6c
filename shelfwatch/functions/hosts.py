"""Hosts in the form of the URL standard: international names, numeric addresses, bracketed addresses.

Everything is a column expression over code points and digits; `url_host` reaches these only for the
hosts that need them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The parameters of Punycode, and the full stops that separate labels.
BASE, T_MIN, T_MAX, SKEW, DAMP, FIRST_BIAS, FIRST_CODE = 36, 1, 26, 38, 700, 72, 128
STOPS = "。．｡"

NUMBER = r"(?:[0-9]+|0x[0-9a-f]*)"
ENDS_IN_NUMBER = rf"(?:^|\.){NUMBER}\.?$"
_PIECE = "[0-9a-f]{1,4}"
_DOTTED = r"(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}"
_GROUPS = rf"(?:{_PIECE}(?::{_PIECE})*)?"


def bound(value: Column, use) -> Column:
    """`use(value)` with the value computed once and written once, however often `use` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _div(a: Column, b) -> Column:
    return F.floor(a / b)


def _digit(d: Column) -> Column:
    return F.substring(F.lit("abcdefghijklmnopqrstuvwxyz0123456789"), d.cast("int") + 1, F.lit(1))


def _varint(delta: Column, bias: Column) -> Column:
    """A number in digits of growing weight; numbers of a host take at most 12."""
    start = F.struct(delta.cast("long").alias("q"), F.lit("").alias("out"), F.lit(False).alias("done"))

    def add(s: Column, i: Column) -> Column:
        t = F.greatest(F.lit(T_MIN), F.least(F.lit(T_MAX), (i + 1) * BASE - bias)).cast("long")
        last = s["q"] < t
        digit = F.when(last, s["q"]).otherwise(t + (s["q"] - t) % (BASE - t))
        step = F.struct(
            F.when(last, s["q"]).otherwise(_div(s["q"] - t, BASE - t)).cast("long").alias("q"),
            F.concat(s["out"], _digit(digit)).alias("out"),
            last.alias("done"),
        )
        return F.when(s["done"], s).otherwise(step)

    return F.aggregate(F.sequence(F.lit(0), F.lit(11)), start, add, lambda s: s["out"])


def _adapted(delta: Column, points: Column, first: Column) -> Column:
    d = F.when(first, _div(delta, DAMP)).otherwise(_div(delta, 2))
    start = F.struct((d + _div(d, points)).cast("long").alias("d"), F.lit(0).cast("long").alias("k"))
    shrunk = F.aggregate(
        F.sequence(F.lit(1), F.lit(8)),
        start,
        lambda s, _: F.when(
            s["d"] > (BASE - T_MIN) * T_MAX // 2,
            F.struct(_div(s["d"], BASE - T_MIN).cast("long").alias("d"), (s["k"] + BASE).cast("long").alias("k")),
        ).otherwise(s),
    )
    return (shrunk["k"] + _div((BASE - T_MIN + 1) * shrunk["d"], shrunk["d"] + SKEW)).cast("long")


def punycode(label: Column) -> Column:
    """A label with its basic characters first and the others as insertions, in order of code point and place."""
    codes = F.transform(
        F.filter(F.split(label, ""), lambda c: c != ""), lambda c, i: F.struct(F.ascii(c).cast("long").alias("c"), i.cast("long").alias("p"))
    )
    basic = F.filter(codes, lambda x: x["c"] < FIRST_CODE)
    rare = F.array_sort(F.filter(codes, lambda x: x["c"] >= FIRST_CODE))
    plain = F.array_join(F.transform(basic, lambda x: F.chr(x["c"])), "")
    n_basic = F.size(basic).cast("long")
    start = F.struct(
        F.lit(FIRST_CODE).cast("long").alias("n"),
        F.lit(0).cast("long").alias("i"),
        n_basic.alias("h"),
        F.lit(FIRST_BIAS).cast("long").alias("bias"),
        F.lit("").alias("out"),
    )

    def insert(s: Column, x: Column) -> Column:
        earlier = F.filter(codes, lambda y: (y["p"] < x["p"]) & ((y["c"] < FIRST_CODE) | (y["c"] <= x["c"])))

        def grown(at: Column) -> Column:
            return bound(
                (x["c"] - s["n"]) * (s["h"] + 1) + at - s["i"],
                lambda delta: F.struct(
                    x["c"].alias("n"),
                    (at + 1).alias("i"),
                    (s["h"] + 1).alias("h"),
                    _adapted(delta, s["h"] + 1, s["h"] == n_basic).alias("bias"),
                    F.concat(s["out"], _varint(delta, s["bias"])).alias("out"),
                ),
            )

        return bound(F.size(earlier).cast("long"), grown)

    coded = F.aggregate(rare, start, insert, lambda s: s["out"])
    return F.concat(F.lit("xn--"), F.when(n_basic > 0, F.concat(plain, F.lit("-"))).otherwise(F.lit("")), coded)


def ascii_host(host: Column) -> Column:
    """International labels in their ASCII form; other labels as they are."""
    labels = F.split(F.translate(host, STOPS, "..."), r"\.", -1)
    return F.array_join(F.transform(labels, lambda x: F.when(x.rlike(r"[^\x00-\x7f]"), punycode(x)).otherwise(x)), ".")


def ipv4(host: Column) -> Column:
    """Up to four decimal, octal (leading 0) or hexadecimal (0x) numbers as four bytes, the last one filling
    what is left; NULL when they are no address."""

    def value(p: Column) -> Column:
        number = (
            F.when(p.isin("0x", "0"), F.lit("0"))
            .when(p.rlike("^0x[0-9a-f]+$"), F.conv(F.substring(p, 3, 2147483647), 16, 10))
            .when(p.rlike("^0[0-7]+$"), F.conv(p, 8, 10))
            .when(p.rlike("^[1-9][0-9]*$"), F.when(F.length(p) <= 10, p).otherwise(F.lit("99999999999")))
        )
        return number.try_cast("decimal(20,0)")

    parts = F.split(F.regexp_replace(host, r"\.$", ""), r"\.", -1)
    return bound(F.transform(parts, value), _address)


def _address(values: Column) -> Column:
    n = F.size(values)
    last = F.element_at(values, -1)
    head = F.slice(values, 1, F.greatest(n - 1, F.lit(0)))
    fits = (n <= 4) & F.forall(values, lambda v: v.isNotNull()) & F.forall(head, lambda v: v <= 255)
    fits = fits & (last < F.pow(F.lit(256), F.lit(5) - n))
    high = F.aggregate(head, F.lit(0).cast("long"), lambda a, v: a * 256 + v.cast("long"))
    address = high * F.pow(F.lit(256), F.lit(5) - n).cast("long") + last.cast("long")
    octets = F.transform(F.array(*map(F.lit, (24, 16, 8, 0))), lambda s: F.floor(address / F.pow(F.lit(2), s)).cast("long") % 256)
    return F.when(F.coalesce(fits, F.lit(False)), F.array_join(F.transform(octets, lambda o: o.cast("string")), "."))


def ipv6(host: Column) -> Column:
    """A bracketed address with the longest run of zeros left out; NULL when it is none."""
    return bound(bound(F.substring(host, 2, F.length(host) - 2), _undotted), _shortened)


def _undotted(inner: Column) -> Column:
    """A dotted end as two groups; what is none stays and fails later."""

    def replaced(b: Column) -> Column:
        groups = F.concat_ws(":", F.lower(F.hex(b[0] * 256 + b[1])), F.lower(F.hex(b[2] * 256 + b[3])))
        ok = (F.size(b) == 4) & F.forall(b, lambda x: x < 256)
        return F.when(ok, F.concat(F.regexp_extract(inner, "^(.*:)", 1), groups)).otherwise(inner)

    dotted = F.regexp_extract(inner, rf":({_DOTTED})$", 1)
    return bound(F.transform(F.split(dotted, r"\."), lambda x: x.try_cast("int")), replaced)


def _shortened(plain: Column) -> Column:
    def filled(halves: Column) -> Column:
        left, right = halves[0], F.coalesce(F.get(halves, 1), F.array().cast("array<string>"))
        zeros = F.array_repeat(F.lit("0"), F.greatest(8 - F.size(left) - F.size(right), F.lit(0)))
        full = F.concat(left, F.when(F.size(halves) > 1, zeros).otherwise(F.array().cast("array<string>")), right)
        ok = F.when(F.size(halves) > 1, F.size(left) + F.size(right) <= 7).otherwise(F.size(left) == 8)
        return F.when(ok, F.array_join(F.transform(full, lambda p: F.regexp_replace(p, "^0+(?=.)", "")), ":"))

    halves = F.transform(F.split(plain, "::", -1), lambda h: F.filter(F.split(h, ":", -1), lambda p: p != ""))
    shape = plain.rlike(f"^{_GROUPS}$|^{_GROUPS}::{_GROUPS}$")
    return F.when(shape, F.concat(F.lit("["), bound(bound(halves, filled), _without_zeros), F.lit("]")))


def _without_zeros(text: Column) -> Column:
    """The longest run of at least two zeros as two colons; of equal runs the first."""
    shown = text
    for run in range(2, 9):
        pattern = rf"^(?:(.*?):)??0(?::0){{{run - 1}}}(?::(.*))?$"
        cut = F.concat(F.regexp_extract(text, pattern, 1), F.lit("::"), F.regexp_extract(text, pattern, 2))
        shown = F.when(text.rlike(pattern), cut).otherwise(shown)
    return shown
