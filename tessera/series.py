"""One column with text, time and list methods: ``Series("name").str.upper()``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import scalar as S

_STR: dict[str, Callable[..., Column]] = {
    "lower": S.lower, "upper": S.upper, "to_lowercase": S.lower, "to_uppercase": S.upper, "strip": S.strip, "strip_chars": S.strip, "lstrip": S.lstrip, "rstrip": S.rstrip, "len": F.char_length, "len_chars": F.char_length, "len_bytes": F.octet_length,
    "contains": lambda c, pat, case=True, regex=True: (c if case else F.lower(c)).rlike(pat if case else pat.lower()) if regex else F.contains(c if case else F.lower(c), F.lit(pat if case else pat.lower())),
    "startswith": lambda c, p: c.startswith(p), "starts_with": lambda c, p: c.startswith(p), "endswith": lambda c, p: c.endswith(p), "ends_with": lambda c, p: c.endswith(p), "match": lambda c, p: c.rlike(rf"\A(?:{p})"), "fullmatch": S.matches,
    "find": S.find, "rfind": S.rfind, "replace": lambda c, a, b, n=-1: S.replace_first(c, a, b) if n == 1 else S.replace_all(c, a, b), "replace_all": S.replace_all, "regex_replace": S.regex_replace,
    "slice": lambda c, start, stop=None: S.substr(c, start, None if stop is None else max(0, stop - start)), "pad": lambda c, width, side="left", fill=" ": {"left": S.pad_start, "right": S.pad_end, "both": S.center}[side](c, width, fill),
    "pad_start": S.pad_start, "pad_end": S.pad_end, "ljust": S.pad_end, "rjust": S.pad_start, "center": S.center, "zfill": S.zfill, "split": S.split, "rsplit": lambda c, sep: S.split(c, sep), "extract": S.extract, "findall": S.findall, "count": S.count_text,
    "capitalize": S.capitalize, "title": S.title, "swapcase": S.swapcase, "casefold": F.lower, "removeprefix": S.remove_prefix, "removesuffix": S.remove_suffix, "repeat": F.repeat, "cat": lambda c, *xs, sep="": F.concat(c, *[y for x in xs for y in (F.lit(sep), x)]),
    "normalize": S.normalize, "translate": S.translate, "wrap": S.wrap, "partition": S.partition, "rpartition": lambda c, sep: S.partition(c, sep, True), "get": lambda c, i: F.when((i < F.char_length(c)), F.substr(c, F.lit(i + 1), F.lit(1))),
    "slice_replace": lambda c, start, stop, new: F.concat(F.substr(c, F.lit(1), F.lit(start)), F.lit(new), F.substr(c, F.lit(stop + 1))), "encode": lambda c, charset="UTF-8": F.encode(c, charset), "decode": lambda c, charset="UTF-8": F.decode(c, charset),
    "index": lambda c, x: F.when(F.instr(c, x) > 0, F.instr(c, x) - 1).otherwise(F.raise_error(F.lit("substring not found")).cast("int")), "rindex": lambda c, x: F.when(F.instr(c, x) > 0, S.rfind(c, x)).otherwise(F.raise_error(F.lit("substring not found")).cast("int")), "extractall": lambda c, p, group=1: F.regexp_extract_all(c, F.lit(p), F.lit(group)),
    **{f"is{k}": (lambda k: lambda c: S.is_class(c, k))(k) for k in S._CLASSES},
}
_DT: dict[str, Callable[..., Column]] = {
    "strftime": S.format_time, **{p: (lambda p: lambda c: S.date_part(p, c))(p) for p in S._PARTS}, "nanosecond": lambda c: F.lit(0), "isocalendar": lambda c: F.struct(S.date_part("isoyear", c).alias("year"), F.weekofyear(c).alias("week"), (F.weekday(c) + 1).alias("day")),
    "floor": lambda c, unit: S.from_micros(S.round_time(S.micros(c), unit)), "ceil": lambda c, unit: S.from_micros(S.round_time(S.micros(c), unit, "ceil")), "round": lambda c, unit: S.from_micros(S.round_time(S.micros(c), unit, "round")),
    "normalize": lambda c: F.date_trunc("day", c), "total_seconds": lambda c: c.cast("double") / 1e6, "tz": lambda c: F.current_timezone(), "tz_convert": lambda c, tz: F.from_utc_timestamp(c, tz), "tz_localize": lambda c, tz: F.to_utc_timestamp(c, tz),
}
_LIST: dict[str, Callable[..., Column]] = {"len": F.size, "get": S.list_get, "first": lambda c: S.list_get(c, 0), "last": lambda c: S.list_get(c, -1), "join": F.array_join, "sort": F.array_sort, "unique": F.array_distinct, "sum": S.list_sum, "slice": S.list_slice, "contains": F.array_contains}


class _Accessor:
    def __init__(self, col: Column, methods: dict[str, Callable[..., Column]]):
        self._col, self._methods = col, methods

    def __getattr__(self, name: str) -> Callable[..., Column]:
        if name not in self._methods:
            raise AttributeError(name)
        return lambda *args, **kwargs: self._methods[name](self._col, *args, **kwargs)

    def __dir__(self):
        return sorted(self._methods)


class Series:
    def __init__(self, column: str | Column):
        self.col = F.col(column) if isinstance(column, str) else column
        self.str, self.dt, self.list = _Accessor(self.col, _STR), _Accessor(self.col, _DT), _Accessor(self.col, _LIST)

    def apply(self, fn: Callable[[Column], Column]) -> Column:
        """A function traced to an expression."""
        return fn(self.col)
