"""Timestamps of mixed notation, precision and zone, normalised to UTC microseconds.

An ordered cascade of anchored patterns; the first that matches decides. Each pattern rewrites the text to
one canonical list of parts in a single regex pass, so a value costs a few ``rlike`` tests and one rewrite.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: month names in English, German, French, Spanish, Italian, Portuguese, Dutch and Swedish
_MONTHS = [
    "january jan januar jänner janvier janv enero ene gennaio gen janeiro januari",
    "february feb februar février fevrier févr fevr fév febrero febbraio fevereiro fev februari",
    "march mar märz maerz mär mrz mars marzo março marco maart mrt",
    "april apr avril avr abril abr aprile",
    "may mai mayo maggio mag maio mei maj",
    "june jun juni juin junio giugno giu junho",
    "july jul juli juillet juil julio luglio lug julho",
    "august aug août aout agosto ago augustus augusti",
    "september sep sept septembre septiembre settembre set setembro",
    "october oct oktober okt octobre octubre ottobre ott outubro out",
    "november nov novembre noviembre novembro",
    "december dec dezember dez décembre decembre déc diciembre dic dicembre dezembro",
]

# fixed values: zone letters, minutes east of UTC
_LETTERS = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "JST": 540, "KST": 540, "AWST": 480, "ACST": 570, "ACDT": 630,
    "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
    "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600, "AST": -240, "ADT": -180,
}

# fixed values: letters that mean something else where the source's own zone is the one named
_LOCAL_LETTERS = {
    "Europe/Dublin": {"IST": 60}, "Asia/Jerusalem": {"IST": 120, "IDT": 180}, "Asia/Shanghai": {"CST": 480},
    "Asia/Dhaka": {"BST": 360}, "Asia/Manila": {"PST": 480},
    "Australia/Sydney": {"EST": 600, "EDT": 660}, "Australia/Melbourne": {"EST": 600, "EDT": 660}, "Australia/Brisbane": {"EST": 600},
}

_DAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,? )?"
_ZONE = r"(z|(?!uhr)[a-z]{3,4}|(?:utc|gmt)?[+-]\d{1,2}(?::?\d{2})?)"
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,18}))?)?(?: ?([ap])\.?m\.?)?(?: ?" + _ZONE + r")?(?:\[([\w+/-]+)\])?"

#: (kind, pattern, canonical parts). Parts: a|b|c|h|mi|s|fraction|am or pm|zone|region, a..c ordered by kind.
_PATTERNS = [
    ("mdy", rf"(?i)^{_DAY}(\p{{L}}{{3,10}})\.? (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})(?:,? (?:at )?{_TIME})?$", "$1|$2|$3|$4|$5|$6|$7|$8|$9|$10"),
    ("ymd", rf"(?i)^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})(?:(?:t| |, ){_TIME})?$", "$1|$2|$3|$4|$5|$6|$7|$8|$9|$10"),
    ("epoch", r"^(-?\d{9,10}|\d{12,13}|\d{15,16}|\d{18,19})$", "$1|||||||||"),
    ("dmy", rf"(?i)^{_DAY}(\d{{1,2}})(?:\.|st|nd|rd|th|er)? (?:de )?(\p{{L}}{{3,10}})\.?,? (?:de )?(\d{{4}})(?:,? (?:à |um |at )?{_TIME}(?: uhr)?)?$", "$1|$2|$3|$4|$5|$6|$7|$8|$9|$10"),
    ("num", rf"(?i)^(\d{{1,2}})([./-])(\d{{1,2}})\2(\d{{4}}|\d{{2}})(?:,? {_TIME})?$", "$1|$3|$4|$5|$6|$7|$8|$9|$10|$11"),
    ("ymd", rf"(?i)^(\d{{4}})([./])(\d{{1,2}})\2(\d{{1,2}})(?:,? {_TIME})?$", "$1|$3|$4|$5|$6|$7|$8|$9|$10|$11"),
    ("ymd", r"(?i)^(\d{4})(\d{2})(\d{2})(?:t(\d{2})(\d{2})(\d{2})?(?:[.,](\d{1,18}))?(z|[+-]\d{2}:?\d{2})?)?$", "$1|$2|$3|$4|$5|$6|$7||$8|"),
    ("dmy", r"(?i)^(\d{1,2})(?:er)? (\p{L}{3,10})\.? (\d{4}),? (?:à )?(\d{1,2})h(\d{2})$", "$1|$2|$3|$4|$5|||||"),
]


def _map(pairs: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _minutes(zone: Column, tz: Column) -> Column:
    """Minutes east of UTC of zone letters or a numeric offset; null if the letters are unknown."""
    own = _map({f"{region}|{letters}": m for region, x in _LOCAL_LETTERS.items() for letters, m in x.items()})
    named = F.coalesce(F.try_element_at(own, F.concat(F.coalesce(tz, F.lit("")), F.lit("|"), F.upper(zone))), F.try_element_at(_map(_LETTERS), F.upper(zone)))
    sign = F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1)
    whole = F.regexp_replace(zone, "^[+-]|:", "").try_cast("int")
    return F.when(zone.rlike("^[+-]"), sign * F.when(F.length(zone) > 3, F.floor(whole / 100) * 60 + whole % 100).otherwise(whole * 60)).otherwise(named)


def with_utc_micros(df: DataFrame, text: str, tz: str, order: str, out: str) -> DataFrame:
    """Add ``out`` BIGINT: microseconds since 1970-01-01 UTC meant by ``text``, or null.

    ``tz`` names the column with the source's IANA zone, ``order`` the one with its order of all-number dates (MDY,
    DMY or YMD). Policy: an explicit offset, zone letters or epoch number decides; otherwise the time is local
    to ``tz`` (UTC where that is null), the earlier instant where it occurs twice, shifted forward by the gap where the
    clocks skip it. A value without time of day is 00:00 UTC of its day. Digits finer than a microsecond are cut.
    Null, blank, relative words, partial dates, impossible days or times, unknown zone letters and unknown notations
    give null. A two-digit year is 20yy. All other columns, whatever their names, are kept in place and an existing
    ``out`` is replaced; repeated rows stay repeated.
    """
    names = [c for c in df.columns if c != out]
    cleaned = df.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
        F.regexp_replace(F.regexp_replace(F.col(f"`{text}`"), r"(?U)[\s\u200b\ufeff]+", " "), "^ | $", "").alias("t"),
        F.col(f"`{tz}`").alias("own"),
        F.upper(F.col(f"`{order}`")).alias("order"),
    )
    parts = F.lit(None).cast("string")
    for name, pattern, to in reversed(_PATTERNS):
        parts = F.when(F.col("t").rlike(pattern), F.regexp_replace("t", pattern, f"{name}|{to}")).otherwise(parts)
    p, kind, order_ = F.col("p"), F.col("p")[0], F.col("order")
    split = cleaned.select("row", "own", "order", F.split(parts, r"\|").alias("p"))
    # the order of the three date parts: a source's own for all-number dates, else the notation's
    order_ = (
        F.when(kind == "mdy", "MDY").when(kind == "dmy", "DMY").when(kind == "ymd", "YMD")
        .when(order_.isin("MDY", "DMY"), order_).when(F.length(p[3]) == 4, "DMY").otherwise("YMD")
    )
    at = lambda c: p[F.instr(F.col("o"), c)]
    months = _map({m: i for i, line in enumerate(_MONTHS, 1) for m in line.split()})
    ordered = split.select("row", "own", "p", F.when(kind != "epoch", order_).alias("o"))
    named = ordered.select(
        "row", "own", at("Y").try_cast("int").alias("y"), at("D").try_cast("int").alias("d"), F.lower(at("M")).alias("m"),
        p[4].try_cast("int").alias("h"), F.lower(p[8]).alias("half"), p[5].try_cast("int").alias("mi"), p[6].try_cast("int").alias("s"),
        F.rpad(F.substring(p[7], 1, 6), 6, "0").try_cast("int").alias("us"), F.nullif(F.regexp_replace(p[9], r"(?i)^(?:utc|gmt)(?=[+-])", ""), F.lit("")).alias("zone"), F.nullif(p[10], F.lit("")).alias("region"),
        F.when(kind == "epoch", p[1]).alias("epoch"),
    )
    y, d, m, h, half = (F.col(c) for c in ("y", "d", "m", "h", "half"))
    checked = named.select(
        "row", "own", F.when(y < 100, y + 2000).otherwise(y).alias("y"), F.coalesce(m.try_cast("int"), F.try_element_at(months, m)).alias("m"), "d", "zone",
        F.when(half == "", h).when(h.between(1, 12), h % 12 + F.when(half == "p", 12).otherwise(0)).when(h.isNotNull(), 99).alias("h"),
        F.coalesce("mi", F.lit(0)).alias("mi"), F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("us", F.lit(0)).alias("us"), F.coalesce("region", "own", F.lit("UTC")).alias("tz"),
        "epoch", F.length("epoch").alias("el"),
    )
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    last = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    real = (y >= 1) & m.between(1, 12) & d.between(1, last) & F.coalesce(h, F.lit(0)).between(0, 23) & (F.col("mi") < 60) & (F.col("s") < 60)
    seconds = F.coalesce(h, F.lit(0)) * 3600 + F.col("mi") * 60 + F.col("s")
    number = F.col("epoch").try_cast("decimal(20,0)")
    local = checked.select(
        "row", "tz", "zone", h.isNull().alias("whole_day"),
        F.when(real, F.unix_date(F.make_date(y, m, d)).cast("bigint") * 86400000000 + seconds.cast("bigint") * 1000000 + F.col("us")).alias("local"),
        F.when(F.col("el") <= 11, number * 1000000).when(F.col("el") <= 13, number * 1000).when(F.col("el") <= 16, number).otherwise(F.floor(number / 1000)).cast("bigint").alias("epoch"),
        _minutes(F.col("zone"), F.col("own")).alias("off"),
    )
    utc = (
        F.when(F.col("local").isNull(), F.col("epoch"))
        .when(F.col("whole_day"), F.col("local"))
        .when(F.col("zone").isNotNull(), F.col("local") - F.col("off") * 60000000)
        .otherwise(F.unix_micros(F.to_utc_timestamp(F.timestamp_micros("local"), F.col("tz"))))
    )
    # the one-element explode keeps a later filter on the result from being pushed down as a second copy of all of this
    return local.select("row", F.explode(F.array(utc)).alias(out)).select("row.*", out)
