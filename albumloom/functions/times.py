"""Dates and times read from folder names, file names and metadata texts; durations as text."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: name shapes after digits are masked as 9, tried in order: mask, then where year, month, day stand
NUMERIC_DATES = [
    ("9999-99-99", (1, 4), (6, 2), (9, 2)),
    ("9999-9999", (1, 4), (6, 2), (8, 2)),
    ("9999-99", (1, 4), (6, 2), None),
    ("99-99-99", (1, 2), (4, 2), (7, 2)),
    ("99-9999", (1, 2), (4, 2), (6, 2)),
    ("99-99", (1, 2), (4, 2), None),
    ("9999", (1, 4), None, None),
]
CHINESE_REST = r"^([0-9]{1,2})月(?:([0-9]{1,2})日)?"
CHAT_EXPORT = r"(?i)(?:mmexport|wx_camera_)(\d{10,13})"
NAME_DATE = (
    r"(\d{4})[-_.]?(\d{2})[-_.]?(\d{2})"
    r"(?:[_\-. ](?:at\s+)?(\d{2})[-.:_]?(\d{2})[-.:_]?(\d{2}))?"
)
EXIF_TIME = r"^(\d{4}):(\d{1,2}):(\d{1,2}) (\d{1,2}):(\d{1,2}):(\d{1,2})$"
OLDEST_MTIME = 631152000  # 1990-01-01


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _int(text: Column, default: int | None = None) -> Column:
    n = text.try_cast("int")
    return n if default is None else F.coalesce(n, F.lit(default))


def _valid(y: Column, m: Column, d: Column, hh: Column | None = None, mi: Column | None = None, ss: Column | None = None) -> Column:
    """Zone-less timestamp, null when any part is out of range."""
    zero = F.lit(0)
    hh, mi, ss = (zero if x is None else x for x in (hh, mi, ss))
    return F.when((y >= 1) & (ss < 60), F.try_make_timestamp_ntz(y, m, d, hh, mi, ss))


def seconds_of(ts: Column) -> Column:
    """Whole seconds since 1970 of a zone-less timestamp, from its own fields, whatever the session zone."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp."""
    fraction = (F.extract(F.lit("SECOND"), ts) * 1000000).cast("bigint") % 1000000
    return seconds_of(ts) * 1000000 + fraction


def from_seconds(t: Column) -> Column:
    return F.timestamp_add("SECOND", t, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def _century(n: Column) -> Column:
    """Two-digit years: up to 68 this century, else the last."""
    return F.when(n <= 68, n + 2000).otherwise(n + 1900)


def folder_date(name: Column) -> Column:
    """Date a folder name starts with (DATE), null when none of the shapes is a real date.

    One mask of the first characters picks the shapes, so no pattern runs for names that have none.
    """
    mask = F.translate(F.substring(name, 1, 10), "0123456789", "9999999999")

    def part(at: tuple[int, int] | None) -> Column:
        return F.lit(1) if at is None else F.substring(name, *at).cast("int")

    def tries(m: Column) -> Column:
        def chinese(width: int) -> Column:
            rest = F.substring(name, width + 2, 10)
            y = F.substring(name, 1, width).cast("int")
            month, day = _int(F.regexp_extract(rest, CHINESE_REST, 1), 1), _int(F.regexp_extract(rest, CHINESE_REST, 2), 1)
            return F.when(F.startswith(m, F.lit("9" * width + "年")), _valid(y if width == 4 else _century(y), month, day))

        def numeric(shape: str, y, mo, d) -> Column:
            year = part(y) if y[1] == 4 else _century(part(y))
            return F.when(F.startswith(m, F.lit(shape)), _valid(year, part(mo), part(d)))

        return F.coalesce(chinese(4), chinese(2), *[numeric(*shape) for shape in NUMERIC_DATES])

    return let(mask, tries).cast("date")


def letter_month_day(filename: Column) -> tuple[Column, Column]:
    """Camera names ``P<month><day>...``: month 1-9 or A-C; nulls when the name is none of these."""
    shape = r"^P([1-9A-Ca-c])(\d{2})"
    mark, day = F.upper(F.regexp_extract(filename, shape, 1)), _int(F.regexp_extract(filename, shape, 2))
    month = F.when(mark.isin("A", "B", "C"), F.ascii(mark) - 55).otherwise(_int(mark))
    ok = day.between(1, 31)
    return F.when(ok, month), F.when(ok, day)


def ancestor_date(path: Column, levels: int = 4) -> Column:
    """First dated name among the parent folder and the three above it."""
    names = F.slice(F.reverse(F.split(path, "/")), 2, levels)
    return F.get(F.filter(F.transform(names, folder_date), lambda d: d.isNotNull()), F.lit(0))


def chat_export_time(filename: Column) -> Column:
    """Epoch seconds in exported chat pictures; 13 digits are milliseconds."""
    digits = F.regexp_extract(filename, CHAT_EXPORT, 1)
    n = F.when(digits != "", digits).try_cast("bigint")
    return F.when(F.length(digits) == 13, F.floor(n / 1000)).when(n <= 253402300799, n)


def _groups(text: Column, pattern: str, n: int) -> Column:
    """The n groups of the first match as an array, from one replacement."""
    found = F.regexp_substr(text, F.lit(pattern))
    return F.split(F.regexp_replace(found, pattern, "|".join(f"${i}" for i in range(1, n + 1))), r"\|")


def _stamp(parts: Column) -> Column:
    def made(p: Column) -> Column:
        g = [F.get(p, F.lit(i)) for i in range(6)]
        return _valid(_int(g[0]), _int(g[1]), _int(g[2]), _int(g[3], 0), _int(g[4], 0), _int(g[5], 0))

    return let(parts, made)


def name_date(filename: Column, max_year: Column) -> Column:
    """Date with optional time anywhere in the name; years from 1900 to ``max_year`` only."""
    return let(_stamp(_groups(filename, NAME_DATE, 6)), lambda ts: F.when(F.year(ts).between(1900, max_year), ts))


def exif_time(text: Column) -> Column:
    return _stamp(_groups(F.trim(text), EXIF_TIME, 6))


def capture_time(path: Column, filename: Column, original: Column, modified: Column, mtime: Column, max_year: Column) -> Column:
    """Struct (t, is_exact, origin): the best known capture time of a photo in epoch seconds.

    ``original``/``modified`` are the two metadata texts, ``mtime`` the file time in epoch seconds.
    """
    raw = F.when(F.coalesce(original, F.lit("")) != "", original).otherwise(modified)
    month, day = letter_month_day(filename)
    known = F.struct(
        exif_time(raw).alias("exif"), chat_export_time(filename).alias("chat"), ancestor_date(path).alias("folder"), name_date(filename, max_year).alias("named"),
        month.alias("month"), day.alias("day"), F.when(mtime > OLDEST_MTIME, mtime).alias("late"),
    )

    def ladder(k: Column) -> Column:
        def found(t: Column, exact: bool, origin: str) -> Column:
            return F.struct(t.cast("bigint").alias("t"), F.lit(exact).alias("is_exact"), F.lit(origin).alias("origin"))

        year = F.coalesce(F.year(k["folder"]), F.year(from_seconds(k["late"])))
        lettered = let(F.when(k["month"].isNotNull(), _valid(year, k["month"], k["day"])), lambda ts: F.when(ts.isNotNull(), found(seconds_of(ts), False, "letter_name")))
        return (
            F.when(k["exif"].isNotNull(), found(seconds_of(k["exif"]), True, "metadata"))
            .when(k["chat"].isNotNull(), found(k["chat"], True, "chat_export"))
            .otherwise(
                F.coalesce(
                    lettered,
                    F.when(k["named"].isNotNull(), found(seconds_of(k["named"]), True, "name")),
                    F.when(k["folder"].isNotNull(), found(seconds_of(k["folder"].cast("timestamp_ntz")), False, "folder")),
                    F.when(k["late"].isNotNull(), found(k["late"], False, "mtime")),
                    found(F.lit(0), False, "none"),
                )
            )
        )

    return let(known, ladder)


def duration(seconds: Column) -> Column:
    """1h02m03s, 2m03s or 3s; 未知 for missing or negative values."""
    s = F.bround(seconds, 0).cast("bigint")
    h, m, sec = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60

    def two(c: Column) -> Column:
        return F.lpad(c.cast("string"), 2, "0")

    return (
        F.when(seconds.isNull() | (seconds < 0), "未知")
        .when(h > 0, F.concat(h.cast("string"), F.lit("h"), two(m), F.lit("m"), two(sec), F.lit("s")))
        .when(m > 0, F.concat(m.cast("string"), F.lit("m"), two(sec), F.lit("s")))
        .otherwise(F.concat(sec.cast("string"), F.lit("s")))
    )


def eta_text(eta: Column) -> Column:
    """Remaining time in hours and minutes; null while unknown (0)."""
    h, m = F.floor(eta / 3600), F.floor(eta % 3600 / 60)
    return (
        F.when(eta <= 0, None)
        .when(h > 0, F.concat(h.cast("string"), F.lit("小时"), m.cast("string"), F.lit("分钟")))
        .when(m > 0, F.concat(m.cast("string"), F.lit("分钟")))
        .otherwise("不到1分钟")
    )


def range_text(fast: Column, slow: Column) -> Column:
    """约 A ~ B; the slow end picks the unit, equal ends show once."""

    def minutes(s: Column) -> Column:
        return F.concat(F.floor(s / F.lit(60.0) + 0.5).cast("string"), F.lit(" 分钟"))

    def long(s: Column) -> Column:
        h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
        return F.concat(h.cast("string"), F.lit(" 小时"), F.when(m > 0, F.concat(F.lit(" "), m.cast("string"), F.lit(" 分钟"))).otherwise(""))

    def text(render) -> Column:
        a, b = render(fast), render(slow)
        return F.concat(F.lit("约 "), F.when(a == b, a).otherwise(F.concat(a, F.lit(" ~ "), b)))

    return (
        F.when(slow < 60, text(lambda s: F.concat(s.cast("string"), F.lit(" 秒"))))
        .when((slow < 3600) | (fast < 3600), text(minutes))
        .otherwise(text(long))
    )


LOCAL_PROVIDERS: Sequence[str] = ("ollama", "lmstudio", "ollama-new")


def processing_estimate(photos: Column, provider: Column) -> tuple[Column, Column]:
    """Fast and slow seconds for thumbnails, upload and analysis of so many photos."""
    # fixed values: thumbnail s/photo, upload bytes/photo and bytes/s, fixed and per-photo analysis s
    local = F.lower(provider).isin(*LOCAL_PROVIDERS)
    sent = photos * 102400
    analyse = F.when(local, F.lit(56.0) + photos * 4.6).otherwise(F.lit(26.0) + photos * 1.2)
    fast = photos * 0.2 + sent / F.lit(12.5 * 1024 * 1024) + analyse
    slow = photos * 0.5 + sent / F.lit(0.375 * 1024 * 1024) + analyse * 1.5
    return F.greatest(fast.cast("int"), F.lit(1)), F.greatest(slow.cast("int"), F.lit(1))


def service_minutes(photos: Column, provider: Column) -> Column:
    """Whole minutes the service promises for a task."""
    local = F.lower(provider).isin(*LOCAL_PROVIDERS)
    return (F.when(local, F.lit(56.0) + photos * 4.6).otherwise(F.lit(26.0) + photos * 1.2) / 60).cast("int")
