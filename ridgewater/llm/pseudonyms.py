"""Format-preserving pseudonyms for personal numbers, dates and addresses, by keyed Feistel networks.

Found and validated: payment card numbers (13 to 19 digits, spaces or hyphens between, Luhn sum right), other digit runs
of that form, international telephone numbers (8 to 15 digits after the plus sign), IPv4 addresses (octets up to 255),
dates (year-month-day, day-month-year or month-day-year that exist in the calendar), and the local part of e-mail
addresses. Everything else, e.g. 31.02.2020 or 300.1.1.1, is left as it is.

A value is permuted within its format: digits stay digits and letters letters of their case, separators stay, a
card number keeps a right Luhn sum, an IPv4 address stays one, an e-mail address keeps its domain, a telephone number its
country code (by the table of codes, so separators do not matter). A date becomes a date of the same 400 years that is
written with as many digits and read in the same way: year first, day first, or month first where day first gives no date.
Each number of digits is a set of dates with a Feistel network of its own over two radices, whose product exceeds the set by
three at most; what falls outside is permuted again. Years 100 to 9699 count as dates. The permutation depends on the key,
the kind and the value's digits alone: equal values get equal pseudonyms in all documents, different values different ones,
and the holder of the key can reverse it. One day written with other numbers of digits, or month first, is another value.

Built-in column functions only; rows are neither shuffled nor multiplied. Null text stays null with counts 0, empty text
stays empty; long texts stay one row. No rows in, no rows out.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
CYCLE = 146_097
# The calendar repeats after 400 years, which have 97 leap days; those counted here start with a year like 1700.
YEARS, LEAP_DAYS = 400, 97
MONTH_DAYS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
YEAR_SPAN = (100, 9699)
# Country calling codes of one and two digits; all others have three.
COUNTRY_CODES = "[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"

KINDS = {
    "email": r"(?<![A-Za-z0-9._+-])[A-Za-z0-9](?:[A-Za-z0-9._+-]{0,63})@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "phone": r"(?<![A-Za-z0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){1,4}(?![A-Za-z0-9])",
    "date": r"(?<![A-Za-z0-9.-])(?:[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4})(?![A-Za-z0-9]|[.-][0-9])",
    "ip": r"(?<![A-Za-z0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![A-Za-z0-9]|\.[0-9])",
    "number": r"(?<![A-Za-z0-9])[0-9](?:[ -]?[0-9]){12,18}(?![A-Za-z0-9])",
}
ANY = "|".join(KINDS.values())


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed a single time however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _stream(key: str, kind: str, size: Column, number: Column, other: Column, bits: int = 512) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), size.cast("string"), number.cast("string"), other.cast("string")), bits)


def _shifted(text: Column, stream: Column, sign: int) -> Column:
    """Every digit and letter moved along its own alphabet by four hex digits of the stream; others stay."""

    def move(c: Column, i: Column, bits: Column) -> Column:
        by = F.conv(bits.substr(F.pmod(i, F.lit(32)) * 4 + 1, F.lit(4)), 16, 10).cast("int") * sign

        def within(first: str, radix: int) -> Column:
            return F.char(F.pmod(F.ascii(c) - ord(first) + by, F.lit(radix)) + ord(first))

        return (
            F.when(c.between("0", "9"), within("0", 10))
            .when(c.between("a", "z"), within("a", 26))
            .when(c.between("A", "Z"), within("A", 26))
            .otherwise(c)
        )

    places = F.array_remove(F.split(text, ""), "")
    return _once(stream, lambda bits: F.array_join(F.transform(places, lambda c, i: move(c, i, bits)), ""))


def permute_text(text: Column, key: str, kind: str, back: bool = False) -> Column:
    """Feistel network over the two halves of a short string."""
    cut = F.floor(F.length(text) / 2).cast("int")
    size = F.length(text)
    numbers = list(range(1, ROUNDS + 1))

    def turn(acc: Column, number: Column) -> Column:
        left, right = acc["l"], acc["r"]
        sign = -1 if back else 1
        odd = F.struct(left.alias("l"), _shifted(right, _stream(key, kind, size, number, left), sign).alias("r"))
        even = F.struct(_shifted(left, _stream(key, kind, size, number, right), sign).alias("l"), right.alias("r"))
        return F.when(number % 2 == 1, odd).otherwise(even)

    start = F.struct(text.substr(F.lit(1), cut).alias("l"), text.substr(cut + 1, size).alias("r"))
    order = F.array(*[F.lit(n) for n in (reversed(numbers) if back else numbers)])
    return F.aggregate(order, start, turn, lambda acc: F.concat(acc["l"], acc["r"]))


def permute_number(value: Column, left: int | Column, right: int | Column, key: str, kind: str, back: bool = False) -> Column:
    """Feistel network over 0 .. left * right - 1 with two radices."""
    numbers = list(range(1, ROUNDS + 1))
    sign = -1 if back else 1

    def by(number: Column, other: Column) -> Column:
        made = _stream(key, kind, F.lit(left * right), number, other, 256)
        return F.conv(made.substr(1, 12), 16, 10).cast("long") * sign

    def turn(acc: Column, number: Column) -> Column:
        odd = F.struct(acc["l"].alias("l"), F.pmod(acc["r"] + by(number, acc["l"]), F.lit(right)).cast("long").alias("r"))
        even = F.struct(F.pmod(acc["l"] + by(number, acc["r"]), F.lit(left)).cast("long").alias("l"), acc["r"].alias("r"))
        return F.when(number % 2 == 1, odd).otherwise(even)

    start = F.struct(F.floor(value / right).cast("long").alias("l"), F.pmod(value, F.lit(right)).cast("long").alias("r"))
    order = F.array(*[F.lit(n) for n in (reversed(numbers) if back else numbers)])
    return F.aggregate(order, start, turn, lambda acc: acc["l"] * right + acc["r"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _refilled(value: Column, digits: Column) -> Column:
    """The digits in order at the digit places of ``value``."""
    count = F.length(_digits(value))
    places = F.array_remove(F.split(value, ""), "")
    at = lambda i: F.length(_digits(value.substr(F.lit(1), i + 1)))
    fill = lambda d: F.transform(places, lambda c, i: F.when(c.between("0", "9"), d.substr(at(i), F.lit(1))).otherwise(c))
    return F.when(count > 0, _once(digits, lambda d: F.array_join(fill(d), ""))).otherwise(value)


def _luhn(digits: Column, doubled_last: bool) -> Column:
    """Luhn sum; with ``doubled_last`` the last digit given counts twice, as before a check digit."""

    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int")
        even = F.pmod(F.length(digits) - 1 - i, F.lit(2)) == (0 if doubled_last else 1)
        return F.when(even, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    values = F.transform(F.array_remove(F.split(digits, ""), ""), worth)
    return F.aggregate(values, F.lit(0), lambda a, b: a + b)


def is_card(value: Column) -> Column:
    return _luhn(_digits(value), False) % 10 == 0


def _number(value: Column, key: str, back: bool) -> Column:
    def made(digits: Column) -> Column:
        # The last digit's distance from the right check digit is kept: 0 for cards, and other numbers never become cards.
        front = digits.substr(F.lit(1), F.length(digits) - 1)
        apart = _luhn(front, True) + digits.substr(F.length(digits), F.lit(1)).cast("int")
        closed = lambda body: F.concat(body, F.pmod(apart - _luhn(body, True), F.lit(10)).cast("string"))
        return _once(permute_text(front, key, "card", back), closed)

    return _refilled(value, _once(_digits(value), made))


def _phone(value: Column, key: str, back: bool) -> Column:
    """The digits after the country code are permuted, wherever separators stand."""

    def made(digits: Column) -> Column:
        code = F.regexp_extract(digits, f"^(?:{COUNTRY_CODES})", 0)
        return F.concat(code, permute_text(digits.substr(F.length(code) + 1, F.length(digits)), key, "phone", back))

    return F.when(F.length(_digits(value)).between(8, 15), _refilled(value, _once(_digits(value), made)))


def _ip(value: Column, key: str, back: bool) -> Column:
    octets = F.transform(F.split(value, r"\."), lambda x: x.cast("long"))
    right = F.forall(octets, lambda x: x <= 255) & ~value.rlike(r"(?:^|\.)0[0-9]")
    address = F.aggregate(octets, F.lit(0).cast("long"), lambda a, x: a * 256 + x)
    places = F.array(*[F.lit(s) for s in (16_777_216, 65_536, 256, 1)])
    parts = lambda made: F.transform(places, lambda s: F.pmod(F.floor(made / s), F.lit(256)).cast("string"))
    return F.when(right, _once(permute_number(address, 65_536, 65_536, key, "ip", back), lambda made: F.array_join(parts(made), ".")))


class _DateSet(NamedTuple):
    """The dates of 400 years that a layout can write: common days first, then the 97 leap days."""

    before: list[int]
    common: int
    size: int
    left: int
    right: int


def _date_set(months: int, low: int, high: int) -> _DateSet:
    """Months 1 .. ``months``, days ``low`` .. ``high``; radices with the least product not below the size."""
    days = [min(high, n) - low + 1 for n in MONTH_DAYS[:months]]
    size = YEARS * sum(days) + (LEAP_DAYS if high > 28 else 0)
    root = math.isqrt(size)
    left = min(range(root // 3, root + 1), key=lambda n: (-size % n, -n))
    return _DateSet([sum(days[:i]) for i in range(months)], sum(days), size, left, -(-size // left))


# One set for each number of digits of month and day; dates that only month-first reading allows have days from 13.
DATE_SETS = [_date_set(months, low, high) for months in (9, 12) for low, high in ((1, 9), (1, 31), (13, 31))]


def _of_set(chosen: Column, field: str) -> Column:
    return F.get(F.array(*[F.lit(getattr(s, field)) for s in DATE_SETS]), chosen)


def _walked(at: Column, chosen: Column, key: str, back: bool) -> Column:
    """Permuted within the set: what falls on one of the few numbers above it is permuted again until it is inside."""
    size, left, right = [_of_set(chosen, n) for n in ("size", "left", "right")]
    above = max(s.left * s.right - s.size for s in DATE_SETS)

    def step(acc: Column, _: Column) -> Column:
        # The start is below zero, so that it is permuted at least once.
        open_ = F.when(acc < 0, -1 - acc).when(acc >= size, acc)
        return _once(open_, lambda x: F.when(x.isNull(), acc).otherwise(permute_number(x, left, right, key, "date", back)))

    return F.aggregate(F.sequence(F.lit(0), F.lit(above)), (-1 - at).cast("long"), step)


def _date(value: Column, key: str, back: bool) -> Column:
    parts = F.split(value, "[-/.]")
    marks = F.regexp_replace(value, "[0-9]", "")
    one, two = marks.substr(1, 1), marks.substr(2, 1)
    year_first = F.length(parts[0]) == 4
    year = F.when(year_first, parts[0]).otherwise(parts[2]).cast("int")

    def exists(month: Column, day: Column) -> Column:
        leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
        last = F.get(F.array(*[F.lit(n) for n in MONTH_DAYS]), month - 1) + F.when(leap & (month == 2), 1).otherwise(0)
        return year.between(*YEAR_SPAN) & month.between(1, 12) & (day >= 1) & (day <= last)

    def place(v: Column) -> Column:
        """Where the date stands in its set."""
        since = (year - YEAR_SPAN[0]) % YEARS
        quarter = F.floor(since / 4)
        leap_day = _of_set(v["set"], "common") * YEARS + quarter - 1 - (quarter > 25).cast("int") - (quarter > 50).cast("int")
        common = since * _of_set(v["set"], "common") + F.get(_of_set(v["set"], "before"), v["month"] - 1) + v["day"] - v["low"]
        return F.when((v["month"] == 2) & (v["day"] == 29), leap_day).otherwise(common)

    def back_from(v: Column, at: Column) -> Column:
        """Years since the start of the 400, month and day of a place."""
        days, before = _of_set(v["set"], "common"), _of_set(v["set"], "before")
        within = F.pmod(at, days)
        month = F.size(F.filter(before, lambda n: n <= within))
        leap = at - days * YEARS
        common = F.struct(F.floor(at / days).alias("since"), month.alias("month"), (within - F.get(before, month - 1) + v["low"]).alias("day"))
        quarter = leap + 1 + (leap >= 24).cast("int") + (leap >= 48).cast("int")
        leap_day = F.struct((quarter * 4).alias("since"), F.lit(2).alias("month"), F.lit(29).cast("long").alias("day"))
        return F.when(at < days * YEARS, common).otherwise(leap_day)

    def shown(v: Column, made: Column) -> Column:
        own = made["since"] + F.floor((year - YEAR_SPAN[0]) / YEARS) * YEARS + YEAR_SPAN[0]
        shown_year = F.lpad(own.cast("string"), 4, "0")
        month, day = F.lpad(made["month"].cast("string"), v["month_digits"], F.lit("0")), F.lpad(made["day"].cast("string"), v["day_digits"], F.lit("0"))
        return (
            F.when(year_first, F.concat(shown_year, one, month, two, day))
            .when(v["low"] == 13, F.concat(month, one, day, two, shown_year))
            .otherwise(F.concat(day, one, month, two, shown_year))
        )

    month_first = ~year_first & ~exists(parts[1].cast("int"), parts[0].cast("int"))
    month = F.when(month_first, parts[0]).otherwise(parts[1])
    day = F.when(year_first, parts[2]).when(month_first, parts[1]).otherwise(parts[0])
    read = F.struct(month.cast("int").alias("month"), day.cast("int").alias("day"), month_first.alias("month_first"), F.length(month).alias("month_digits"), F.length(day).alias("day_digits"))

    def with_set(v: Column) -> Column:
        kind = F.when(v["month_first"], 2).otherwise(v["day_digits"] - 1)
        low = F.when(v["month_first"], 13).otherwise(1)
        return F.struct(v["month"].alias("month"), v["day"].alias("day"), v["month_digits"].alias("month_digits"), v["day_digits"].alias("day_digits"), low.alias("low"), ((v["month_digits"] - 1) * 3 + kind).alias("set"))

    def permuted(v: Column) -> Column:
        made = _once(_walked(place(v), v["set"], key, back), lambda at: _once(back_from(v, at), lambda d: shown(v, d)))
        return F.when(exists(v["month"], v["day"]), made)

    return _once(read, lambda r: _once(with_set(r), permuted))


def _email(value: Column, key: str, back: bool) -> Column:
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    return F.concat(permute_text(local, key, "email", back), F.lit("@"), domain)


def _kind(value: Column) -> Column:
    whole = F.lit(None).cast("string")
    for kind in reversed(KINDS):
        # Look-arounds hold at the ends of the bare value as well.
        whole = F.when(value.rlike(f"^(?:{KINDS[kind]})$"), F.lit(kind)).otherwise(whole)
    return whole


def pseudonym(value: Column, kind: Column, key: str, back: bool = False) -> Column:
    """The pseudonym of a found value; null if it does not validate."""
    return (
        F.when(kind == "email", _email(value, key, back))
        .when(kind == "phone", _phone(value, key, back))
        .when(kind == "date", _date(value, key, back))
        .when(kind == "ip", _ip(value, key, back))
        .when(kind == "number", _number(value, key, back))
    )


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text", back: bool = False) -> DataFrame:
    """``docs`` with the text replaced and n_email, n_phone, n_date, n_ip, n_card, n_number added (existing columns of
    these names are replaced). With ``back`` the pseudonyms are turned into the values again."""
    counts = ["n_email", "n_phone", "n_date", "n_ip", "n_card", "n_number"]
    kept = [c for c in docs.columns if c not in counts]
    # Every value has a digit or an at sign; other texts are passed over by one search.
    any_value = F.when(F.col(text_col).rlike("[0-9@]"), F.regexp_extract_all(text_col, F.lit(ANY), F.lit(0)))
    found = docs.select(*kept, F.coalesce(any_value, F.array().cast("array<string>")).alias("__found"))
    kinds = F.transform("__found", lambda v: F.struct(v.alias("value"), _kind(v).alias("kind")))
    found = found.select(*kept, kinds.alias("__kinds"))
    made = F.transform("__kinds", lambda v: F.struct(v["value"].alias("value"), v["kind"].alias("kind"), pseudonym(v["value"], v["kind"], key, back).alias("made")))
    found = found.select(*kept, F.when(F.size("__kinds") > 0, made).alias("__made"))
    fills = F.transform("__made", lambda v: F.coalesce(v["made"], v["value"]))
    pieces = F.split(F.col(text_col), ANY)
    text = F.array_join(F.zip_with(pieces, fills, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    text = F.when(F.col("__made").isNull(), F.col(text_col)).otherwise(text)

    def count(kind: str, card: bool | None = None) -> Column:
        def counted(v: Column) -> Column:
            own = (v["kind"] == kind) & v["made"].isNotNull()
            return own if card is None else own & (is_card(v["value"]) == card)

        return F.coalesce(F.size(F.filter("__made", counted)), F.lit(0))

    numbers = [count("email"), count("phone"), count("date"), count("ip"), count("number", True), count("number", False)]
    shown = [text.alias(c) if c == text_col else F.col(c) for c in kept]
    return found.select(*shown, *[F.greatest(n, F.lit(0)).cast("long").alias(c) for n, c in zip(numbers, counts)])
