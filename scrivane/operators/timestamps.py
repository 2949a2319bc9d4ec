"""Times written in many notations and zones, brought to UTC.

A cascade of anchored patterns rewrites each text into fixed fields (one regular-expression pass for
the pattern that fits), the fields are checked strictly, and the zone is settled: an offset or
abbreviation in the text, else the zone of the row's node, else UTC. All of it is column
expressions; the zone lookup is a dimension whose size is checked.
"""

from __future__ import annotations

import re
from datetime import datetime, timezone
from itertools import chain
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Month names and their abbreviations in en, de, fr, es, without accents.
MONTHS = {
    1: "january jan januar janvier janv enero ene",
    2: "february feb februar fevrier fevr febrero",
    3: "march mar marz mars marzo mrz",
    4: "april apr avril avr abril abr",
    5: "may mai mayo",
    6: "june jun juni juin junio",
    7: "july jul juli juillet juil julio",
    8: "august aug aout agosto ago",
    9: "september sep sept septembre septiembre set",
    10: "october oct oktober okt octobre octubre",
    11: "november nov novembre noviembre",
    12: "december dec dezember dez decembre diciembre dic",
}
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?\s?([AaPp][Mm])?"
_ZONE = r"\s?(Z|[+-]\d{2}:?\d{2}|[A-Za-z]{2,5})?"
_NAME = r"([\p{L}]{3,10})\.?"
#: The cascade: an anchored pattern and the groups that are year, month, day, hour, minute, second, fraction, half of the day, zone.
CASCADE = [
    (rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})(?:[T ]{_TIME}{_ZONE})?$", (1, 2, 3, 4, 5, 6, 7, 8, 9)),
    (rf"^(\d{{4}})/(\d{{1,2}})/(\d{{1,2}})(?:[T ]{_TIME}{_ZONE})?$", (1, 2, 3, 4, 5, 6, 7, 8, 9)),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:T(\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d{{1,9}}))?)?{_ZONE})?$", (1, 2, 3, 4, 5, 6, 7, 0, 8)),
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?:,? {_TIME}{_ZONE})?$", (3, 1, 2, 4, 5, 6, 7, 8, 9)),
    (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})(?:,? {_TIME}{_ZONE})?$", (3, 2, 1, 4, 5, 6, 7, 8, 9)),
    (rf"^(?:\p{{L}}{{2,10}}\.?,? )?(\d{{1,2}})\.?[ -](?:de )?{_NAME}[ -](?:de )?(\d{{4}})(?:,? {_TIME}{_ZONE})?$", (3, 2, 1, 4, 5, 6, 7, 8, 9)),
    (rf"^(?:\p{{L}}{{2,10}}\.?,? )?{_NAME} (\d{{1,2}}),? (\d{{4}})(?:,? {_TIME}{_ZONE})?$", (3, 1, 2, 4, 5, 6, 7, 8, 9)),
]
_ACCENTS = ("àáâäãåçèéêëìíîïñòóôöõùúûüý", "aaaaaaceeeeiiiinooooouuuuy")
_DAY = 86_400_000_000
#: Most rows that the zone lookup may have; there are fewer time zones.
MOST_NODES = 100_000


def zone_abbreviations(zones: list[str], first_year: int = 1990, last_year: int = 2038) -> dict[tuple[str, str], int]:
    """(zone, abbreviation) -> offset in seconds, as used in that zone; the later use wins."""
    out: dict[tuple[str, str], int] = {}
    for z in zones:
        tz = ZoneInfo(z)
        for year in range(first_year, last_year):
            for month in range(1, 13):
                t = datetime(year, month, 15, 12, tzinfo=timezone.utc).astimezone(tz)
                if (name := t.tzname() or "").isalpha():
                    out[z, name.upper()] = int(t.utcoffset().total_seconds())
    return out


_MARK = "\x01"


def _fields(t: Column) -> Column:
    """Array of the nine fields as text, of another size if no pattern fits.

    The cascade is one expression, each pattern an alternative: a group of an alternative that wasn't taken is empty in the replacement, so that a field is the
    groups for it of all alternatives behind one another, and each text is read once.
    """
    before, refs, whole = 0, [""] * 9, []
    for pattern, groups in CASCADE:
        whole.append(pattern.removeprefix("^").removesuffix("$"))
        for i, g in enumerate(groups):
            refs[i] += f"${before + g}" if g else ""
        before += re.compile(pattern.replace(r"\p{L}", "a")).groups
    bare = F.replace(t, F.lit(_MARK), F.lit(""))
    return F.split(F.regexp_replace(bare, f"^(?:{'|'.join(whole)})$", _MARK.join(refs)), _MARK, -1)


def _utc_text(micros: Column) -> Column:
    day = F.floor(micros / _DAY)
    day = F.when(day * _DAY > micros, day - 1).when((day + 1) * _DAY <= micros, day + 1).otherwise(day).cast("int")
    rest = micros - day.cast("bigint") * _DAY
    part = lambda unit, most, width: F.lpad(((rest - F.pmod(rest, F.lit(unit))) / unit % most).cast("int").cast("string"), width, "0")
    return F.concat(F.date_from_unix_date(day).cast("string"), F.lit(" "), part(3_600_000_000, 24, 2), F.lit(":"), part(60_000_000, 60, 2), F.lit(":"), part(1_000_000, 60, 2), F.lit("."), F.lpad(F.pmod(rest, F.lit(1_000_000)).cast("string"), 6, "0"))


def normalize_times(df: DataFrame, fields: list[str], keep: list[str], node: str, nodes: DataFrame, default_zone: str = "UTC") -> DataFrame:
    """One row per input row and field: the columns ``keep``, field_name, raw_text, kind, value_utc.

    nodes: (node, tz_name). kind: ``zoned`` (offset, abbreviation or epoch), ``local``, ``ambiguous`` (a local time
    that occurs twice: the first occurrence is taken), ``skipped`` (a local time left out by a change of the
    clocks: read with the offset before the change), ``date`` (no time of day; the date as written), or NULL
    with value_utc NULL where the text can't be read: NULL, empty, words, impossible dates or times, an
    abbreviation that is unknown or not used at the node and means different things elsewhere, years outside 1 to 9999.
    A node that is NULL or not in the lookup has the default zone. Empty tables give empty results.
    """
    if nodes.limit(MOST_NODES + 1).count() > MOST_NODES:
        raise ValueError(f"the zone lookup has more than {MOST_NODES} rows")
    zones = sorted({default_zone, *(r[0] for r in nodes.select("tz_name").filter("tz_name is not null").distinct().collect())})
    known = zone_abbreviations(zones)
    anywhere: dict[str, set[int]] = {}
    for (_, name), offset in known.items():
        anywhere.setdefault(name, set()).add(offset)
    offsets = {f"{z} {a}": o for (z, a), o in known.items()} | {f" {a}": min(o) for a, o in anywhere.items() if len(o) == 1} | {" Z": 0, " UTC": 0, " GMT": 0}
    offset_of = F.create_map(*(F.lit(x) for x in chain(*offsets.items())))
    months = F.create_map(*(F.lit(x) for m, names in MONTHS.items() for n in names.split() for x in (n, m)))

    lookup = F.broadcast(nodes.select(F.col("node").alias("__node"), F.col("tz_name").alias("__tz")).filter("__node is not null").dropDuplicates(["__node"]))
    src = df.select(F.struct(*(F.col(f"`{k}`") for k in keep)).alias("__keep"), F.col(f"`{node}`").alias("__at"), F.array(*(F.struct(F.lit(f).alias("f"), F.col(f"`{f}`").cast("string").alias("t")) for f in fields)).alias("__all"))
    src = src.join(lookup, F.col("__at") == F.col("__node"), "left").select("__keep", F.coalesce("__tz", F.lit(default_zone)).alias("__tz"), F.inline("__all").alias("field_name", "raw_text"))
    src = src.withColumn("t", F.trim(F.regexp_replace("raw_text", r"[\s\x{a0}]+", " ")))

    digits = F.regexp_extract("t", r"^-?(\d+)", 1)
    whole = F.col("t").rlike(r"^-?\d{1,18}$") & (F.length(digits) != 8)
    number = F.try_to_number(F.when(F.length(digits) != 8, F.regexp_extract("t", r"^(-?\d{1,11}(?:\.\d{1,9})?)$", 1)), F.lit("S99999999999.999999999"))
    unit = F.when(F.length(digits) <= 11, 1_000_000).when(F.length(digits) <= 14, 1000).otherwise(1)
    epoch = F.when(whole, F.try_multiply(F.col("t").try_cast("bigint"), unit.cast("bigint"))).when(number.isNotNull(), (number * 1_000_000).cast("bigint"))

    src = src.select("*", F.inline(F.array(F.struct(epoch.alias("epoch"), _fields(F.col("t")).alias("a")))))
    src = src.withColumn("a", F.when(F.size("a") == 9, F.col("a")))
    g = lambda i: F.col("a")[i]
    has_time = g(3) != ""
    month = F.coalesce(g(1).try_cast("int"), F.try_element_at(months, F.translate(F.lower(g(1)), *_ACCENTS)))
    date = F.try_to_date(F.concat(g(0), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(g(2), 2, "0")), "yyyy-MM-dd")
    h, half = g(3).try_cast("int"), F.lower(g(7))
    hour = F.when(half == "", F.when(h < 24, h)).when((h < 1) | (h > 12), None).otherwise(h % 12 + F.when(half == "pm", 12).otherwise(0))
    minute, second = g(4).try_cast("int"), F.when(g(5) == "", 0).otherwise(g(5).try_cast("int"))
    micro = F.rpad(F.substring(g(6), 1, 6), 6, "0").try_cast("int")
    local = F.when((minute < 60) & (second < 60), F.datediff(date, F.lit("1970-01-01").cast("date")).cast("bigint") * _DAY + ((hour * 60 + minute) * 60 + second).cast("bigint") * 1_000_000 + micro)
    src = src.withColumns({"date": date, "local": F.when(has_time, local), "zone": F.upper(g(8)), "timed": has_time})

    sign = F.when(F.col("zone").startswith("-"), -1).otherwise(1)
    numeric = F.col("zone").rlike(r"^[+-]")
    hh, mm = F.substring("zone", 2, 2).try_cast("int"), F.substring("zone", -2, 2).try_cast("int")
    shift = F.when(numeric, F.when((hh <= 18) & (mm < 60), sign * (hh * 3600 + mm * 60))).otherwise(F.coalesce(F.try_element_at(offset_of, F.concat("__tz", F.lit(" "), "zone")), F.try_element_at(offset_of, F.concat(F.lit(" "), "zone"))))
    at = F.timestamp_micros("local")
    first = F.unix_micros(F.to_utc_timestamp(at, F.col("__tz")))
    src = src.withColumn("utc", F.coalesce("epoch", F.when(F.col("zone") != "", F.col("local") - shift.cast("bigint") * 1_000_000).otherwise(first)))
    back = F.unix_micros(F.from_utc_timestamp(F.timestamp_micros("utc"), F.col("__tz")))
    later = F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(F.col("utc") + _DAY), F.col("__tz"))) - _DAY  # the local time a day on, by the offset then
    second_utc = F.col("utc") + (F.col("local") - later)
    again = (second_utc > F.col("utc")) & (F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(second_utc), F.col("__tz"))) == F.col("local"))
    fits = F.col("utc").between(F.lit(-62_135_596_800_000_000), F.lit(253_402_300_799_999_999))
    kind = F.when(F.col("utc").isNotNull() & fits, F.when(F.col("epoch").isNotNull() | (F.col("zone") != ""), "zoned").when(back != F.col("local"), "skipped").when(again, "ambiguous").otherwise("local")).when(~F.col("timed") & F.col("date").isNotNull() & F.col("epoch").isNull(), "date")
    value = F.when(fits, _utc_text(F.col("utc"))).when(~F.col("timed") & F.col("epoch").isNull(), F.col("date").cast("string"))
    # A generator keeps a later filter from being pushed down, which would repeat all expressions above in it.
    return src.select("__keep", "field_name", "raw_text", F.inline(F.array(F.struct(kind.alias("kind"), value.alias("value_utc"))))).select("__keep.*", "field_name", "raw_text", "kind", "value_utc")
