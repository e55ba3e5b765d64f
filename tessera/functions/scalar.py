"""Scalar functions over columns, by name.

All are built-in expressions, so they stay in code generation and push down;
only text normalisation, wrapping and one-to-many translation, which the JVM
functions cannot express, are Arrow-batched Python functions.

Rules that differ from Spark's defaults: case mapping and trimming are ASCII;
arithmetic of the query language gives null instead of an error; ``//`` rounds
down and ``%`` takes the divisor's sign; the smallest and largest of several
values are null if any is.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = " \t\n\r\f\v"


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# -- arithmetic -------------------------------------------------------------


def add(a, b) -> Column:
    return F.try_add(lit(a), lit(b))


def sub(a, b) -> Column:
    return F.try_subtract(lit(a), lit(b))


def mul(a, b) -> Column:
    return F.try_multiply(lit(a), lit(b))


def div(a, b) -> Column:
    """Always a double; null where the divisor is zero."""
    return F.try_divide(lit(a).cast("double"), lit(b).cast("double"))


def mod(a, b) -> Column:
    """Remainder with the divisor's sign; null where it is zero."""
    a, b = lit(a), lit(b)
    r = F.try_mod(a, b)
    return F.when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r)


def floordiv(a, b) -> Column:
    """Quotient rounded down, exact for integers; null where the divisor is zero."""
    a, b = lit(a), lit(b)
    return F.try_divide(a - mod(a, b), b).cast("bigint")


def power(a, b) -> Column:
    v = F.pow(lit(a), lit(b))
    return F.when(~F.isnan(v), v)


def ilog2(x) -> Column:
    return F.when(lit(x) > 0, bit_width(x) - 1)


def bit_width(x) -> Column:
    return F.when(lit(x) == 0, 0).otherwise(F.length(F.bin(lit(x).cast("bigint"))))


def clz(x) -> Column:
    return F.lit(64) - bit_width(x)


def ctz(x) -> Column:
    x = lit(x).cast("bigint")
    return F.when(x == 0, 64).otherwise(F.length(F.bin(x)) - F.length(F.rtrim(F.bin(x), F.lit("0"))))


def trunc(x) -> Column:
    return F.when(lit(x) < 0, F.ceil(lit(x))).otherwise(F.floor(lit(x)))


def log(x) -> Column:
    return F.when(lit(x) > 0, F.ln(lit(x)))


def clip(x, low, high) -> Column:
    x = lit(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, lit(low)), lit(high)))


def lowest(*xs) -> Column:
    xs = [lit(x) for x in xs]
    return F.when(_none_null(xs), F.least(*xs) if len(xs) > 1 else xs[0])


def highest(*xs) -> Column:
    xs = [lit(x) for x in xs]
    return F.when(_none_null(xs), F.greatest(*xs) if len(xs) > 1 else xs[0])


def _none_null(xs: list[Column]) -> Column:
    out = xs[0].isNotNull()
    for x in xs[1:]:
        out = out & x.isNotNull()
    return out


def cut(x, breaks: list[float], right: bool = True) -> Column:
    """Index of the interval between breaks; null outside. ``right``: intervals are closed on the right."""
    x, out = lit(x), F.lit(None).cast("int")
    for i in reversed(range(len(breaks) - 1)):
        low, high = breaks[i], breaks[i + 1]
        out = F.when((x > low) & (x <= high) if right else (x >= low) & (x < high), i).otherwise(out)
    return out


def search_sorted(x, breaks: list[float]) -> Column:
    """How many breaks lie below the value."""
    return F.when(lit(x).isNotNull(), sum((F.when(lit(x) > b, 1).otherwise(0) for b in breaks), F.lit(0)))


def is_finite(x) -> Column:
    x = lit(x).cast("double")
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def is_infinite(x) -> Column:
    return F.abs(lit(x).cast("double")) == float("inf")


def exact_compare(a, op: str, b) -> Column:
    """Integers against doubles without rounding the integer."""
    a, b = lit(a).cast("decimal(38,6)"), lit(b).cast("decimal(38,6)")
    return {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


# -- text -------------------------------------------------------------------


def lower(s) -> Column:
    return F.translate(lit(s), _UP, _LOW)


def upper(s) -> Column:
    return F.translate(lit(s), _LOW, _UP)


def strip(s) -> Column:
    return F.btrim(lit(s), F.lit(_SPACE))


def lstrip(s) -> Column:
    return F.ltrim(lit(s), F.lit(_SPACE))


def rstrip(s) -> Column:
    return F.rtrim(lit(s), F.lit(_SPACE))


def find(s, needle: str) -> Column:
    """0-based place of the first occurrence in characters, -1 if there is none."""
    return F.instr(lit(s), needle) - 1


def rfind(s, needle: str) -> Column:
    s = lit(s)
    back = F.instr(F.reverse(s), needle[::-1])
    return F.when(back == 0, -1).otherwise(F.char_length(s) - back - len(needle) + 1)


def replace_first(s, old: str, new: str) -> Column:
    s = lit(s)
    at = F.instr(s, old)
    return F.when((at == 0) | F.lit(old == ""), s).otherwise(F.concat(F.substr(s, F.lit(1), at - 1), F.lit(new), F.substr(s, at + len(old))))


def replace_all(s, old: str, new: str) -> Column:
    return F.replace(lit(s), F.lit(old), F.lit(new)) if old else lit(s)


def substr(s, start: int, length: int | None = None) -> Column:
    """0-based; a negative start gives null."""
    if start < 0:
        return F.lit(None).cast("string")
    return F.substr(lit(s), F.lit(start + 1), F.lit(length)) if length is not None else F.substr(lit(s), F.lit(start + 1))


def slice_bytes(s, start: int, length: int) -> Column:
    return F.substr(lit(s).cast("binary"), F.lit(start + 1), F.lit(length)).cast("string")


def pad_start(s, width: int, fill: str = " ") -> Column:
    s = lit(s)
    return F.when(F.char_length(s) >= width, s).otherwise(F.lpad(s, width, fill))


def pad_end(s, width: int, fill: str = " ") -> Column:
    s = lit(s)
    return F.when(F.char_length(s) >= width, s).otherwise(F.rpad(s, width, fill))


def center(s, width: int, fill: str = " ") -> Column:
    """Of an odd number of fill characters the extra one is on the left if the width is odd."""
    s = lit(s)
    room = F.greatest(F.lit(width) - F.char_length(s), F.lit(0))
    left = F.floor(room / 2).cast("int") + room.bitwiseAND(F.lit(width)).bitwiseAND(F.lit(1))
    return F.concat(F.repeat(F.lit(fill), left), s, F.repeat(F.lit(fill), room - left))


def zfill(s, width: int) -> Column:
    s = lit(s)
    signed = F.substr(s, F.lit(1), F.lit(1)).isin("+", "-")
    body = F.when(signed, F.substr(s, F.lit(2))).otherwise(s)
    head = F.when(signed, F.substr(s, F.lit(1), F.lit(1))).otherwise(F.lit(""))
    zeros = F.repeat(F.lit("0"), F.greatest(F.lit(width) - F.char_length(s), F.lit(0)))
    return F.concat(head, zeros, body)


def split(s, sep: str) -> Column:
    """By a plain separator; an empty one gives null."""
    return F.split(lit(s), re.escape(sep), -1) if sep else F.lit(None).cast("array<string>")


def partition(s, sep: str, from_right: bool = False) -> Column:
    s = lit(s)
    at = rfind(s, sep) + 1 if from_right else F.instr(s, sep)
    whole = F.array(F.lit(""), F.lit(""), s) if from_right else F.array(s, F.lit(""), F.lit(""))
    return F.when(at == 0, whole).otherwise(F.array(F.substr(s, F.lit(1), at - 1), F.lit(sep), F.substr(s, at + len(sep))))


def matches(s, pattern: str) -> Column:
    """The whole string."""
    return lit(s).rlike(rf"\A(?:{pattern})\z")


def search(s, pattern: str) -> Column:
    return lit(s).rlike(pattern)


def extract(s, pattern: str, group: int = 0) -> Column:
    """Null where nothing matches."""
    return F.when(lit(s).rlike(pattern), F.regexp_extract(lit(s), pattern, group))


def findall(s, pattern: str) -> Column:
    return F.regexp_extract_all(lit(s), F.lit(pattern), F.lit(0))


def regex_replace(s, pattern: str, to: str) -> Column:
    return F.regexp_replace(lit(s), pattern, re.sub(r"\$\{(\w+)\}", r"$\1", to))


def count_text(s, needle: str) -> Column:
    s = lit(s)
    return F.size(F.split(s, re.escape(needle), -1)) - 1 if needle else F.char_length(s) + 1


def remove_prefix(s, prefix: str) -> Column:
    return F.when(lit(s).startswith(prefix), F.substr(lit(s), F.lit(len(prefix) + 1))).otherwise(lit(s))


def remove_suffix(s, suffix: str) -> Column:
    s = lit(s)
    return F.when(s.endswith(suffix), F.substr(s, F.lit(1), F.char_length(s) - len(suffix))).otherwise(s)


def capitalize(s) -> Column:
    return F.concat(upper(F.substr(lit(s), F.lit(1), F.lit(1))), lower(F.substr(lit(s), F.lit(2))))


def title(s) -> Column:
    return F.array_join(F.transform(F.split(lit(s), "(?<=[^A-Za-z])|(?=[^A-Za-z])", -1), capitalize), "")


def swapcase(s) -> Column:
    return F.translate(lit(s), _UP + _LOW, _LOW + _UP)


_CLASSES = {
    "alnum": "[A-Za-z0-9]+", "alpha": "[A-Za-z]+", "digit": "[0-9]+", "decimal": "[0-9]+", "numeric": "[0-9]+", "space": r"[ \t\n\r\f\x0B]+",
    "ascii": r"[\x00-\x7F]*", "lower": "[^A-Z]*[a-z][^A-Z]*", "upper": "[^a-z]*[A-Z][^a-z]*", "title": "[^A-Za-z]*(?:[A-Z][a-z]*[^A-Za-z]+)*[A-Z][a-z]*[^A-Za-z]*",
}


def is_class(s, kind: str) -> Column:
    return matches(s, _CLASSES[kind])


def like(s, pattern: str, escape: str | None = None) -> Column:
    """No escape character unless one is given."""
    regex, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if escape and c == escape and i + 1 < len(pattern):
            i += 1
            regex += re.escape(pattern[i])
        else:
            regex += ".*" if c == "%" else "." if c == "_" else re.escape(c)
        i += 1
    return lit(s).rlike(rf"(?s)\A{regex}\z")


def hex_parse(s) -> Column:
    return F.when(lit(s).rlike("^(0[xX])?[0-9a-fA-F]{1,15}$"), F.conv(F.regexp_replace(lit(s), "^0[xX]", ""), 16, 10).cast("bigint"))


def hex_format(x) -> Column:
    return F.lpad(F.lower(F.hex(lit(x).cast("bigint"))), 16, "0")


def _batched(fn: Callable, returns: str) -> Callable[[Column], Column]:
    """A function of one text, over Arrow batches; null stays null."""

    def run(x):
        return x.map(lambda v: None if v is None else fn(v))

    return F.pandas_udf(run, returns, F.PandasUDFType.SCALAR)


def normalize(s, form: str = "NFC") -> Column:
    import unicodedata

    return _batched(lambda v: unicodedata.normalize(form, v), "string")(lit(s))


def wrap(s, width: int) -> Column:
    import textwrap

    return _batched(lambda v: textwrap.wrap(v, width), "array<string>")(lit(s))


def translate(s, table: dict[str, str]) -> Column:
    """One character to any string."""
    if all(len(v) <= 1 for v in table.values()):
        whole = [(k, v) for k, v in table.items() if v] + [(k, v) for k, v in table.items() if not v]
        return F.translate(lit(s), "".join(k for k, _ in whole), "".join(v for _, v in whole))
    codes = str.maketrans(table)
    return _batched(lambda v: v.translate(codes), "string")(lit(s))


def fnv1a(s) -> Column:
    """64-bit FNV-1a of the UTF-8 bytes, as a signed integer; a fold over the bytes inside the JVM."""
    prime, basis = 0x100000001B3, 0xCBF29CE484222325 - (1 << 64)
    codes = F.transform(F.sequence(F.lit(1), F.octet_length(lit(s))), lambda i: F.conv(F.hex(F.substr(lit(s).cast("binary"), i, F.lit(1))), 16, 10).cast("bigint"))

    def step(h, b):
        # x * prime modulo 2**64 without overflow: prime is 2**40 + 0x1b3
        x = h.bitwiseXOR(b)
        low, high = x.bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(x, 32)
        carry = low * 0x1B3
        return _wrap(F.shiftleft(x, 40), _wrap(carry, F.shiftleft(high * 0x1B3, 32)))

    return F.when(F.octet_length(lit(s)) == 0, F.lit(basis)).otherwise(F.aggregate(codes, F.lit(basis), step)) if prime else None


def _wrap(a: Column, b: Column) -> Column:
    """a + b modulo 2**64: halves are added apart."""
    mask = F.lit((1 << 32) - 1)
    low = a.bitwiseAND(mask) + b.bitwiseAND(mask)
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(mask))


# -- lists ------------------------------------------------------------------


def list_get(a, i) -> Column:
    """0-based; negative from the end; null outside."""
    if isinstance(i, int):
        return F.try_element_at(lit(a), F.lit(i + 1 if i >= 0 else i))
    return F.try_element_at(lit(a), F.when(i >= 0, i + 1).otherwise(i).cast("int"))


def index_of(a, x) -> Column:
    at = F.array_position(lit(a), x)
    return F.when(at > 0, at - 1)


def list_sum(a, kind: str = "double") -> Column:
    return F.aggregate(F.filter(lit(a), lambda v: v.isNotNull()), F.lit(0).cast(kind), lambda x, y: x + y.cast(kind))


def list_slice(a, start: int, stop: int | None = None) -> Column:
    a = lit(a)
    n = F.size(a)
    low = F.lit(start) if start >= 0 else F.greatest(n + start, F.lit(0))
    high = n if stop is None else F.least(F.lit(stop), n) if stop >= 0 else F.greatest(n + stop, F.lit(0))
    return F.slice(a, low + 1, F.greatest(high - low, F.lit(0)))


# -- time -------------------------------------------------------------------



def micros(t) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone; one without is taken as UTC."""
    t = F.col(t) if isinstance(t, str) else t
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), t.cast("timestamp_ntz"))


def from_micros(x) -> Column:
    """A timestamp without zone (in UTC) from microseconds since 1970, whatever the session's zone."""
    return F.timestamp_add("MICROSECOND", lit(x).cast("bigint"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


_PARTS: dict[str, Callable[[Column], Column]] = {
    "year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second, "quarter": F.quarter,
    "dayofyear": F.dayofyear, "dayofweek": F.weekday, "week": F.weekofyear,
    "isoyear": lambda t: F.extract(F.lit("YEAROFWEEK"), t),
    "millisecond": lambda t: F.floor(F.pmod(micros(t), F.lit(1_000_000)) / 1000), "microsecond": lambda t: F.pmod(micros(t), F.lit(1_000_000)),
    "days_in_month": lambda t: F.dayofmonth(F.last_day(t)), "is_month_start": lambda t: F.dayofmonth(t) == 1, "is_month_end": lambda t: F.last_day(t) == F.to_date(t),
    "is_year_start": lambda t: F.dayofyear(t) == 1, "is_year_end": lambda t: (F.month(t) == 12) & (F.dayofmonth(t) == 31),
    "is_quarter_start": lambda t: F.to_date(t) == F.trunc(t, "quarter"), "is_quarter_end": lambda t: F.date_add(t, 1) == F.trunc(F.date_add(t, 1), "quarter"),
    "is_leap_year": lambda t: F.dayofmonth(F.last_day(F.make_date(F.year(t), F.lit(2), F.lit(1)))) == 29,
}


def date_part(part: str, t) -> Column:
    return _PARTS[part](lit(t))


_DIRECTIVES = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%y": "yy", "%j": "DDD", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%p": "a", "%I": "hh", "%%": "'%'"}


def format_time(t, pattern: str) -> Column:
    out, i = "", 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two in _DIRECTIVES:
            out, i = out + _DIRECTIVES[two], i + 2
        else:
            out, i = out + (f"'{pattern[i]}'" if pattern[i].isalpha() else pattern[i]), i + 1
    return F.date_format(lit(t), out)


def round_time(x, unit: int, how: str = "floor") -> Column:
    """Integer time to multiples of a unit: floor, ceil, or round half to even."""
    x = lit(x).cast("bigint")
    low = x - F.pmod(x, F.lit(unit))
    rest = F.pmod(x, F.lit(unit)) * 2
    if how == "floor":
        return low
    if how == "ceil":
        return F.when(rest == 0, low).otherwise(low + unit)
    up = (rest > unit) | ((rest == unit) & (F.pmod(low / unit, F.lit(2)) != 0))
    return F.when(up, low + unit).otherwise(low)


def bin_time(t, width: int, origin: int = 0) -> Column:
    t = lit(t).cast("bigint")
    return t - F.pmod(t - origin, F.lit(width))


SCALARS: dict[str, Callable[..., Column]] = {
    "add": add, "sub": sub, "mul": mul, "div": div, "mod": mod, "floordiv": floordiv, "pow": power, "abs": lambda x: F.abs(lit(x)), "round": lambda x, n=0: F.round(lit(x), n), "ceil": lambda x: F.ceil(lit(x)),
    "floor": lambda x: F.floor(lit(x)), "trunc": trunc, "sign": lambda x: F.signum(lit(x)), "negate": lambda x: -lit(x), "sqrt": lambda x: F.sqrt(lit(x)), "exp": lambda x: F.exp(lit(x)), "log": log,
    "ilog2": ilog2, "popcount": lambda x: F.bit_count(lit(x)), "bit_width": bit_width, "clz": clz, "ctz": ctz, "clip": clip, "min": lowest, "max": highest, "cut": cut, "search_sorted": search_sorted,
    "is_finite": is_finite, "is_infinite": is_infinite, "is_nan": lambda x: F.isnan(lit(x)), "null_mask": lambda x: lit(x).isNull(), "valid_mask": lambda x: lit(x).isNotNull(), "fillna": lambda x, v: F.coalesce(lit(x), lit(v)),
    "is_between": lambda x, a, b: lit(x).between(a, b), "where": lambda c, a, b: F.when(c, lit(a)).otherwise(lit(b)), "is_in": lambda x, vs: lit(x).isin(*vs), "cast": lambda x, t: lit(x).try_cast(t),
    "lower": lower, "upper": upper, "strip": strip, "lstrip": lstrip, "rstrip": rstrip, "find": find, "rfind": rfind, "replace": replace_first, "replace_all": replace_all, "substr": substr, "slice_bytes": slice_bytes,
    "pad_start": pad_start, "pad_end": pad_end, "center": center, "zfill": zfill, "split": split, "partition": partition, "matches": matches, "search": search, "extract": extract, "findall": findall,
    "regex_replace": regex_replace, "count_text": count_text, "remove_prefix": remove_prefix, "remove_suffix": remove_suffix, "capitalize": capitalize, "title": title, "swapcase": swapcase, "is_class": is_class,
    "like": like, "len_bytes": lambda s: F.octet_length(lit(s)), "len_chars": lambda s: F.char_length(lit(s)), "contains": lambda s, x: lit(s).contains(x), "starts_with": lambda s, x: lit(s).startswith(x),
    "ends_with": lambda s, x: lit(s).endswith(x), "repeat": lambda s, n: F.repeat(lit(s), n), "cat": lambda *xs: F.concat(*[lit(x) for x in xs]), "hex_parse": hex_parse, "hex_format": hex_format, "normalize": normalize,
    "wrap": wrap, "translate": translate, "fnv1a": fnv1a, "list_len": lambda a: F.size(lit(a)), "list_get": list_get, "list_join": lambda a, s: F.array_join(lit(a), s), "list_sort": lambda a: F.array_sort(lit(a)),
    "list_unique": lambda a: F.array_distinct(lit(a)), "index_of": index_of, "list_sum": list_sum, "list_slice": list_slice, "list_contains": lambda a, x: F.array_contains(lit(a), x), "flatten": lambda a: F.flatten(lit(a)),
    "date_part": date_part, "format_time": format_time, "round_time": round_time, "bin": bin_time, "coalesce": lambda *xs: F.coalesce(*[lit(x) for x in xs]), "mix64": lambda x: F.xxhash64(lit(x)),
}
