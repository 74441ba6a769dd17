"""Column functions that turn text into typed values; what cannot be read becomes null."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDE = "".join(chr(0xFF01 + i) for i in range(94)) + "　"
_PLAIN = "".join(chr(0x21 + i) for i in range(94)) + " "
# Texts that stand for a missing identifier.
MISSING_IDS = ("", "0", "nan", "none", "null", "<na>", "-", "不明")


def text(c: Column) -> Column:
    """Null to '', full-width ASCII to ASCII, outer blanks off."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), _WIDE, _PLAIN), r"^\s+|\s+$", ""))


def text_nfkc(c: Column) -> Column:
    """The exact form of :func:`text` for other compatibility characters, by an Arrow function."""

    @F.pandas_udf("string")
    def nfkc(s: pd.Series) -> pd.Series:
        return s.fillna("").str.normalize("NFKC").str.strip()

    return nfkc(c)


def number(c: Column) -> Column:
    """Thousands separators off; only plain decimal notation counts, so 'NaN', 'inf' and '1d' are null."""
    t = F.replace(text(c), F.lit(","), F.lit(""))
    return F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))


def positive(c: Column) -> Column:
    return F.when(c > 0, c)


def non_negative(c: Column) -> Column:
    return F.when(c >= 0, c)


def flag(condition: Column) -> Column:
    """A condition as a column that is never null."""
    return F.coalesce(condition, F.lit(False))


def day(c: Column) -> Column:
    return F.try_to_date(text(c), "yyyy-MM-dd")


def year_month(c: Column) -> Column:
    """First day of a six-digit year and month, a trailing '.0' allowed."""
    t = F.regexp_replace(text(c), r"\.0$", "")
    return F.when(t.rlike(r"^\d{6}$"), F.try_to_date(F.concat(t, F.lit("01")), "yyyyMMdd"))


def years_between(start: Column, built: Column) -> Column:
    """Whole months apart over twelve; null if ``built`` is later."""
    months = (F.year(start) - F.year(built)) * 12 + F.month(start) - F.month(built)
    return F.when(months >= 0, months / F.lit(12.0))


def category(rooms: Column, kind: Column, allowed: list[str]) -> Column:
    """Room count and kind in one code, such as 2LDK; null unless the count is a whole number from 1 and the kind is allowed."""
    k = F.upper(F.replace(text(kind), F.lit(" "), F.lit("")))
    r = number(rooms)
    return F.when((r >= 1) & (r % 1 == 0) & k.isin(allowed), F.concat(r.cast("int").cast("string"), k))


def category_issue(rooms: Column, kind: Column, allowed: list[str]) -> Column:
    """Why :func:`category` is null; null where it is not."""
    k = F.upper(F.replace(text(kind), F.lit(" "), F.lit("")))
    r = number(rooms)
    bad_rooms = ~flag((r >= 1) & (r % 1 == 0))
    return F.when(k == "", "missing_kind").when(~k.isin(allowed), "unsupported_kind").when(bad_rooms, "invalid_rooms")


def identifier(c: Column, unknown: tuple[str, ...] = MISSING_IDS) -> Column:
    t = F.trim(c)
    return F.when(c.isNotNull() & ~F.lower(t).isin(*unknown), t)


def entity_key(*parts: Column) -> Column:
    """Parts joined by '::', null unless all are valid identifiers."""
    ids = [identifier(p) for p in parts]
    ok = ids[0].isNotNull()
    for i in ids[1:]:
        ok &= i.isNotNull()
    return F.when(ok, F.concat_ws("::", *ids))


def clip(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def extreme_label(days: Column, event: Column, short: int = 6, long: int = 60) -> Column:
    """1 for an end within ``short`` days, 0 from ``long`` days on, else null."""
    return F.when((event == 1) & (days <= short), 1).when(days >= long, 0)


def interaction(*parts: Column, missing: str = "missing", sep: str = " × ") -> Column:
    return F.concat_ws(sep, *[F.coalesce(p.cast("string"), F.lit(missing)) for p in parts])


def level(score: Column, cuts: list[float]) -> Column:
    """How many of the cuts a score reaches."""
    total = F.lit(0)
    for c in cuts:
        total = total + (score >= c).cast("int")
    return total


def tier(score: Column, cuts: list[float], names: list[str]) -> Column:
    """Names from the lowest tier to the highest, one more than cuts."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), level(score, cuts) + 1)


def daily_rate(p: Column, days: int) -> Column:
    """The constant daily rate that gives probability p within ``days``."""
    return 1 - F.pow(1 - p, F.lit(1.0 / days))


def hash_uniform(*key: Column) -> Column:
    """A number in [0, 1) that depends on the key alone, whatever the partitioning."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[k.cast("string") for k in key])), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
