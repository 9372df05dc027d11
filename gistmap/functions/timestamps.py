"""Mixed timestamp notations and time zones, normalised to one UTC notation.

The cascade is a list of anchored patterns. Each rewrites a stamp it matches as a whole into the same
eleven pipe-separated fields; the fields are then checked strictly (a real calendar date, hour,
minute and second) and turned into an instant. Everything is a built-in JVM expression, so a
scan of any size stays inside code generation and needs no shuffle.

Defined results
* null stamp -> null; a stamp that gives no real date and time (blank, words, 30 February,
  25:61) -> ``''``.
* no offset or zone in the stamp -> ``default_zone``; null or unknown default zone -> UTC.
* slashes: month first where the locale is ``en-US``, else day first (null locale: day first).
* plain numbers count from 1970 in UTC; their length tells seconds, milli-, micro-, nanoseconds.
* digits beyond microseconds are cut off.
* a local time that occurs twice is its first occurrence; a local time that is skipped is read
  with the offset in force before the change.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names by language, as written in the notations read here.
MONTHS = {
    1: "jan january januar jän enero ene janvier janv",
    2: "feb february februar febrero février févr fév",
    3: "mar march märz mär marzo mars",
    4: "apr april abril abr avril avr",
    5: "may mai mayo",
    6: "jun june juni junio juin",
    7: "jul july juli julio juillet juil",
    8: "aug august agosto ago août",
    9: "sep sept september septiembre septembre",
    10: "oct october oktober okt octubre octobre",
    11: "nov november noviembre novembre",
    12: "dec december dezember dez diciembre dic décembre déc",
}
# Zone letters (USA, central Europe, Japan) and their offsets in minutes.
ZONE_LETTERS = {
    "z": 0, "utc": 0, "gmt": 0,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360,
    "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
    "cet": 60, "cest": 120, "mez": 60, "mesz": 120, "jst": 540,
}

_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_ZONE = r"(?: ?(Z|[A-Za-z]{2,5}|[+\-]\d{2}(?::?\d{2})?|[A-Za-z_]+/[A-Za-z_/\-+0-9]+))?"
_WORD = r"([A-Za-zÀ-ÿ]{3,10})\.?"

#: (name, pattern, fields). Fields: kind|year|month|day|hour|minute|second|fraction|half|zone|extra.
CASCADE: list[tuple[str, str, str]] = [
    ("iso", rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})[Tt ]{_CLOCK}{_ZONE}$", "d|$1|$2|$3|$4|$5|$6|$7||$8|"),
    ("iso_basic", rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt](\d{{2}})(\d{{2}})(\d{{2}})(?:[.,](\d+))?{_ZONE}$", "d|$1|$2|$3|$4|$5|$6|$7||$8|"),
    ("iso_week", rf"^(\d{{4}})-W(\d{{2}})-(\d)[Tt ]{_CLOCK}{_ZONE}$", "w|$1|$2|$3|$4|$5|$6|$7||$8|"),
    ("epoch", r"^([+\-]?)(\d{1,20})(?:\.(\d+))?$", "e|$2||||||$3|||$1"),
    ("slashes", rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}),? {_CLOCK}(?: ?([AaPp])\.?[Mm]\.?)?{_ZONE}$", "s|$3|$1|$2|$4|$5|$6|$7|$8|$9|"),
    ("dots", rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}),? {_CLOCK}{_ZONE}$", "d|$3|$2|$1|$4|$5|$6|$7||$8|"),
    ("day_month", rf"^(?:[A-Za-z]{{3}}, )?(\d{{1,2}}) {_WORD} (\d{{4}}),? {_CLOCK}{_ZONE}$", "d|$3|$2|$1|$4|$5|$6|$7||$8|"),
    ("month_day", rf"^{_WORD} (\d{{1,2}}), (\d{{4}}),? {_CLOCK} ?([AaPp])\.?[Mm]\.?{_ZONE}$", "d|$3|$1|$2|$4|$5|$6|$7|$8|$9|"),
    ("day_month_um", rf"^(\d{{1,2}})\. {_WORD} (\d{{4}}) um {_CLOCK} Uhr{_ZONE}$", "d|$3|$2|$1|$4|$5|$6|$7||$8|"),
]
#: A stamp already in the target notation (it is left alone where it is also a real time).
TARGET = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{6})?Z$"


def _lookup(pairs: dict[str, int], key: Column) -> Column:
    items = [x for k, v in pairs.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*items), key)


def _fields(stamp: Column) -> Column:
    """The eleven fields of the first pattern that matches the whole stamp, else null."""
    text = F.trim(F.regexp_replace(stamp, r"[\s\p{Z}\p{Cf}]+", " "))
    cases = [(text.rlike(p), F.regexp_replace(text, p, out)) for _, p, out in CASCADE]
    picked = reduce(lambda acc, c: acc.when(*c), cases[1:], F.when(*cases[0]))
    return F.split(picked, r"\|")


def _staged(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns computed exactly once.

    A generator of one row stands between them and whatever uses them, so that neither the
    collapsing of projections nor a filter pushed below copies the expressions into one another.
    """
    row = F.struct(*[c.alias(k) for k, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def utc_micros(df: DataFrame, stamp: str, zone: str | None, locale: str | None, out: str) -> DataFrame:
    """Add ``out``: microseconds since 1970 in UTC (null where the stamp gives no real time)."""
    tmp = "__ts_"
    f = F.col(f"{tmp}f")
    part = lambda i: F.nullif(f[i], F.lit(""))
    num = lambda i: part(i).try_cast("bigint")
    months = {w: k for k, words in MONTHS.items() for w in words.split()}
    names = df.columns
    df = _staged(df, **{f"{tmp}f": _fields(F.col(stamp))})
    # month and day: names looked up, slashes ordered by locale
    american = F.coalesce(F.col(locale) == "en-US", F.lit(False)) if locale else F.lit(False)
    swap = (f[0] == "s") & ~american
    month = F.coalesce(num(2), _lookup(months, F.lower(part(2))))
    half = F.when(F.lower(part(8)) == "p", 12).otherwise(0)
    df = _staged(df, **{
        f"{tmp}y": F.when(F.length(part(1)) <= 4, num(1)).cast("int"),
        f"{tmp}m": F.when(swap, num(3)).otherwise(month).cast("int"),
        f"{tmp}d": F.when(swap, num(2)).otherwise(num(3)).cast("int"),
        f"{tmp}h": F.when(part(8).isNull(), num(4)).when(num(4).between(1, 12), num(4) % 12 + half).cast("int"),
        f"{tmp}i": num(5).cast("int"),
        f"{tmp}s": F.coalesce(num(6), F.lit(0)).cast("int"),
        f"{tmp}us": F.substring(F.rpad(F.coalesce(part(7), F.lit("")), 6, "0"), 1, 6).cast("bigint"),
    })
    c = lambda k: F.col(f"{tmp}{k}")
    clock_ok = c("h").between(0, 23) & c("i").between(0, 59) & c("s").between(0, 59)
    year_ok = c("y").between(1, 9999)
    zero = F.lit(0)
    real = lambda y, m, d: F.try_make_timestamp_ntz(y, m, d, zero, zero, zero).cast("date")
    # ISO week date: the Monday of week 1 is the Monday on or before 4 January
    jan4 = real(c("y"), F.lit(1), F.lit(4))
    weeks = F.weekofyear(real(c("y"), F.lit(12), F.lit(28)))
    week_days = (c("m") - 1) * 7 + c("d") - 1
    monday = F.date_sub(jan4, F.weekday(jan4))
    week_date = F.when(c("m").between(1, weeks) & c("d").between(1, 7), F.date_add(monday, week_days))
    plain_date = F.when(year_ok, real(c("y"), c("m"), c("d")))
    date = F.when(year_ok & (f[0] == "w"), week_date).when(f[0] != "e", plain_date)
    df = _staged(df, **{f"{tmp}date": date})
    date = c("date")
    local = F.when(clock_ok, F.unix_date(date).cast("bigint") * 86400 + c("h") * 3600 + c("i") * 60 + c("s"))
    df = _staged(df, **{f"{tmp}local": local, f"{tmp}z": part(9)})
    local, z = c("local"), c("z")
    offset = (
        F.when(z.rlike(r"^[+\-]\d{2}"),
               F.when(z.startswith("-"), -1).otherwise(1)
               * (F.substring(z, 2, 2).try_cast("int") * 60
                  + F.coalesce(F.regexp_extract(z, r"^[+\-]\d{2}:?(\d{2})$", 1).try_cast("int"), F.lit(0))))
        .otherwise(_lookup(ZONE_LETTERS, F.lower(z)))
    )
    region = F.when(z.isNull(), F.coalesce(F.col(zone), F.lit("UTC")) if zone else F.lit("UTC")).when(z.contains("/"), z)
    known = F.when(region.rlike(r"^(UTC|[A-Za-z_]+/[A-Za-z_/\-+0-9]+)$"), region)
    # a region's rules: the JVM reads an overlap as its first pass and shifts a gap by its length,
    # which is the offset before the change
    at_region = F.try_make_timestamp(
        F.year(date), F.month(date), F.day(date), c("h"), c("i"), c("s"), F.coalesce(known, F.lit("UTC"))
    )
    sign = F.when(f[10] == "-", -1).otherwise(1)
    digits = F.length(part(1))
    big = part(1).try_cast("decimal(20,0)")
    epoch = sign * (
        F.when(digits <= 11, big * 1000000 + c("us"))
        .when(digits <= 14, big * 1000)
        .when(digits <= 17, big)
        .otherwise(F.floor(big / 1000))
    ).cast("decimal(38,0)")
    epoch = F.when(F.abs(epoch) < F.lit(253402300800000000).cast("decimal(38,0)"), epoch.cast("bigint"))
    micros = (
        F.when(f[0] == "e", epoch)
        .when(local.isNull(), F.lit(None))
        .when(offset.isNotNull(), (local - offset * 60) * F.lit(1000000) + c("us"))
        .when(z.isNull() | z.contains("/"), F.when(z.isNull() | known.isNotNull(), F.unix_micros(at_region) + c("us")))
    )
    df = _staged(df, **{out: micros.cast("bigint")})
    return df.select(*[F.col(f"`{k}`") for k in names], out)


def utc_text(micros: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SS.ffffffZ`` of microseconds since 1970, whatever the session's zone."""
    seconds = F.floor(micros / 1000000)
    day = F.date_from_unix_date(F.floor(seconds / 86400).cast("int"))
    rest = seconds - F.unix_date(day).cast("bigint") * 86400
    two = lambda x: F.lpad(x.cast("bigint").cast("string"), 2, "0")
    return F.concat(
        day.cast("string"), F.lit("T"), two(F.floor(rest / 3600)), F.lit(":"), two(F.floor(rest / 60) % 60), F.lit(":"),
        two(rest % 60), F.lit("."), F.lpad((micros - seconds * 1000000).cast("string"), 6, "0"), F.lit("Z"),
    )


def normalise_stamps(df: DataFrame, stamp: str, *, zone: str | None = None, locale: str | None = None, out: str = "utc") -> DataFrame:
    """Add ``out``: the stamp in UTC notation, ``''`` where it gives no real time, null where it is null."""
    df = utc_micros(df, stamp, zone, locale, "__micros")
    text = F.when(F.col(stamp).isNull(), F.lit(None)).otherwise(F.coalesce(utc_text(F.col("__micros")), F.lit("")))
    return _staged(df, **{out: text}).drop("__micros")


def found_stamps(conversations: DataFrame, entries: DataFrame) -> DataFrame:
    """(origin, row_id, utc) of every stamp that is not null and not yet a real time in target notation.

    Null stamps give no row; blank ones give ``''``. Rows repeated under another id are kept, as
    ids are unique.
    """
    parts = [
        conversations.select(F.lit("conversations").alias("origin"), F.col("export_id").cast("bigint").alias("row_id"), F.col("timestamp").alias("stamp"), "account_zone", "locale"),
        entries.select(F.lit("raw_entries").alias("origin"), F.col("entry_id").cast("bigint").alias("row_id"), F.col("time").alias("stamp"), "account_zone", "locale"),
    ]
    rows = parts[0].unionByName(parts[1]).where(F.col("stamp").isNotNull())
    rows = normalise_stamps(rows, "stamp", zone="account_zone", locale="locale")
    done = F.col("stamp").rlike(TARGET) & (F.col("utc") != "")
    return rows.where(~done).select("origin", "row_id", "utc")
