"""Column functions for ids, times, calendars, codes and distances."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- ids and times -----------------------------------------------------------


def normalise_customer(c: Column | str) -> Column:
    """Pseudonym: the first four characters before '@', trimmed."""
    return F.trim(F.substring(F.substring_index(_col(c), "@", 1), 1, 4))


def epoch_ms_to_ts(c: Column | str) -> Column:
    return F.timestamp_millis(_col(c).cast("long"))


def epoch_us_to_ts(c: Column | str) -> Column:
    return F.timestamp_micros(_col(c).cast("long"))


def parse_iso_ts(c: Column | str) -> Column:
    """ISO-8601 text; null where it is no timestamp."""
    return F.try_to_timestamp(_col(c))


def shift_micros(ts: Column | str, micros: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(_col(ts).cast("timestamp")) + micros.cast("long"))


def apply_tz_offset(df: DataFrame, unit: str = "ms", on_null: str = "zero", columns: tuple[str, ...] = ("startTimestamp", "endTimestamp"), offset: str = "timezoneOffset") -> DataFrame:
    """Shifts times to local ones.  ``unit``: ms or min.  A null offset counts as
    ``zero``, makes the time ``null``, or is ``keep`` (unshifted)."""
    step = {"ms": 1_000, "min": 60_000_000}[unit]
    off = F.col(offset).cast("long")
    if on_null in ("zero", "keep"):
        off = F.coalesce(off, F.lit(0))
    elif on_null != "null":
        raise ValueError(on_null)
    return df.withColumns({c: shift_micros(c, off * step) for c in columns})


def truncate_seconds(c: Column | str) -> Column:
    return F.date_trunc("second", _col(c))


def seconds_between(start: Column | str, end: Column | str) -> Column:
    micros = F.unix_micros(_col(end).cast("timestamp")) - F.unix_micros(_col(start).cast("timestamp"))
    return micros / F.lit(1_000_000.0)


def with_duration(df: DataFrame, start: str = "startTimestamp", end: str = "endTimestamp") -> DataFrame:
    return df.withColumn("start_end", seconds_between(start, end))


def with_day_hour(df: DataFrame, ts: str = "startTimestamp") -> DataFrame:
    return df.withColumns({f"{ts}_day": F.to_date(ts), f"{ts}_hour": F.hour(ts)})


def fill_missing(df: DataFrame, text: list[str], flags: list[str], mark: str = "-99") -> DataFrame:
    """Null text becomes the mark, null flags false; both as strings."""
    filled = {c: F.coalesce(F.col(c).cast("string"), F.lit(mark)) for c in text}
    return df.withColumns(filled | {c: F.coalesce(F.col(c), F.lit(False)).cast("string") for c in flags})


def parse_dayfirst(c: Column | str) -> Column:
    """``dd.MM.yyyy``, with or without a weekday and comma before it."""
    return F.to_date(F.try_to_timestamp(F.regexp_replace(_col(c), r"^\s*\p{L}+\.?,\s*", ""), F.lit("d.M.yyyy")))


# -- calendars ---------------------------------------------------------------


def weekday(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "EEEE")


def is_weekend(ts: Column | str) -> Column:
    return (F.weekday(_col(ts)) >= 5).cast("int")


def season(ts: Column | str) -> Column:
    m = F.month(_col(ts))
    return (
        F.when(m.between(3, 5), "Spring").when(m.between(6, 8), "Summer").when(m.between(9, 11), "Fall").when(m.isNotNull(), "Winter")
    )


def time_of_day(ts: Column | str) -> Column:
    h = F.hour(_col(ts))
    return (
        F.when((h >= 5) & (h < 8), "Early Morning")
        .when((h >= 8) & (h < 12), "Morning")
        .when((h >= 12) & (h < 17), "Afternoon")
        .when((h >= 17) & (h < 21), "Evening")
        .when(h.isNotNull(), "Night")
    )


def calendar_features(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumns({"weekday": weekday(ts), "weekend": is_weekend(ts), "season": season(ts), "time_of_day": time_of_day(ts)})


def calendar_features_doy(df: DataFrame, ts: str) -> DataFrame:
    """Variant with four times of day and seasons by day of the year; null-safe."""
    h, d = F.hour(ts), F.dayofyear(ts)
    return df.withColumns(
        {
            "time_of_day": F.when((h >= 5) & (h < 12), "morning").when((h >= 12) & (h < 14), "noon").when((h >= 14) & (h < 18), "afternoon").when(h.isNotNull(), "evening"),
            "season": F.when((d >= 80) & (d < 172), "spring").when((d >= 172) & (d < 264), "summer").when((d >= 264) & (d < 355), "fall").when(d.isNotNull(), "winter"),
        }
    )


# -- study codes -------------------------------------------------------------


def study_phase(c: Column | str) -> Column:
    """Phase 0, 1 or 2 of a study id; others null."""
    c = _col(c)
    return F.when(c.isin(24, 25), 0).when(c.isin(33, 34), 1).when(c.isin(38, 39), 2)


def questionnaire_number(c: Column | str) -> Column:
    """First run of digits of a questionnaire's name, as a double; null without one."""
    return F.regexp_extract(_col(c), r"(\d+)", 1).try_cast("double")


def plain_title(c: Column | str) -> Column:
    return F.replace(_col(c), F.lit("_morning"), F.lit(""))


def unique_day_id(ts: Column | str, number: Column | str) -> Column:
    """``yyyyMMdd_<n>``; the number as text of a double, or ``unknown``."""
    return F.concat(F.date_format(_col(ts), "yyyyMMdd"), F.lit("_"), F.coalesce(_col(number).cast("double").cast("string"), F.lit("unknown")))


def decode(c: Column | str, mapping: dict) -> Column:
    """Label of a code; null for codes outside the mapping."""
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), _col(c))


def age_bucket(c: Column | str) -> Column:
    """Text buckets; the labels are fixed values of the study's reports."""
    labels = ((25, "18 to 25"), (35, "25 to 34"), (45, "35 to 44"), (55, "45 to 54"), (65, "55 to 64"), (75, "65 to 74"), (85, "75 to 84"))
    c = _col(c)
    found = reduce(lambda w, x: w.when(c < x[0], x[1]), labels[1:], F.when(c < labels[0][0], labels[0][1]))
    return found.when(c >= 85, "Greater than 85").otherwise("Not answered")


def age_code(c: Column | str) -> Column:
    """0 to 4 for the decades from 18-24 to 55-64, else 5."""
    c = _col(c)
    w = F.when(c.between(18, 24), 0)
    for code, low in enumerate((25, 35, 45, 55), 1):
        w = w.when(c.between(low, low + 9), code)
    return w.otherwise(5)


def compose_ids(df: DataFrame, cluster: str = "cluster", home: str = "home") -> DataFrame:
    """clusterID (null for noise) and homeID: customer, '00' and the number."""
    named = lambda c: F.concat("customer", F.lit("00"), F.col(c).cast("string"))
    return df.withColumns({"clusterID": F.when(F.col(cluster) != -1, named(cluster)), "homeID": named(home)})


# -- numbers -----------------------------------------------------------------


def haversine(lon1, lat1, lon2, lat2) -> Column:
    """Great-circle metres between two points in degrees."""
    lon1, lat1, lon2, lat2 = map(_col, (lon1, lat1, lon2, lat2))
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    a = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * EARTH_RADIUS_M * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def isclose(lat1, lon1, lat2, lon2, threshold: float = 30) -> Column:
    return haversine(lon1, lat1, lon2, lat2) < F.lit(threshold)


def safe_log1p(c: Column | str) -> Column:
    return F.log1p(F.greatest(_col(c), F.lit(-0.999)))


def normalize_data(df: DataFrame, c: str, out: str | None = None) -> DataFrame:
    """``ln(x + shift)``; the shift lifts the least value to 1 where it is not positive."""
    least = df.agg(F.min(c)).first()[0]
    shift = abs(least) + 1 if least is not None and least <= 0 else 0
    return df.withColumn(out or c, F.ln(F.col(c) + F.lit(float(shift))))


def row_mean(columns: list[str]) -> Column:
    """Mean of the columns that are not null; null if all are."""
    n = reduce(lambda a, b: a + b, (F.col(c).isNotNull().cast("int") for c in columns))
    return F.try_divide(row_sum(columns), n)


def row_sum(columns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns))


def scale_scores(df: DataFrame, scales: dict[str, list[str]]) -> DataFrame:
    """Sums of questionnaire items per scale, null items as zero."""
    return df.withColumns({name: row_sum(items) for name, items in scales.items()})


def clinical_outcome(df: DataFrame, base: str = "bsi_gsi_base", t20: str = "bsi_gsi_t20") -> DataFrame:
    """Change, reliable change index, and the two significance flags.  Rows without
    both scores, or with a score of 0 after treatment, are left out."""
    df = df.where(F.col(base).isNotNull() & F.col(t20).isNotNull() & (F.col(t20) != 0))
    sd = df.agg(F.stddev_samp(base)).first()[0]
    change = F.col(t20) - F.col(base)
    rci = F.try_divide(change * F.sqrt(F.lit(2.0)), F.lit(sd).cast("double"))
    significant, reliable = F.col(t20) < 0.56, F.coalesce(F.abs(rci) >= 1.96, F.lit(False))
    return df.withColumns(
        {
            "bsi_gsi_change": change, "rci": rci, "clinically_significant": significant, "reliable_change": reliable,
            "clinically_reliable_change": (significant & reliable).cast("int"),
        }
    )
