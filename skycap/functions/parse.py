"""Caption parsing (x01-x10) as Column expressions.

``regexp_extract`` returns ``''`` on no match, so numbers go through
``nullif(..., '')`` and ``try_cast`` (malformed numbers become NULL instead of
raising).  Categories that are not found become ``'Unknown'``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skycap.schemas import CONUS, REGION_NAMES

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the reference for identical parses)
# ---------------------------------------------------------------------------
REGION_PATTERNS = [CONUS] + REGION_NAMES          # first case-insensitive substring wins
DATE_PATTERN = r"(\d{1,2} \w{3} \d{4})"
SEASON_PATTERN = r"(early|mid|late)\s+(spring|summer|fall|autumn|winter)"
SEASON_WORDS = ["spring", "summer", "fall", "autumn", "winter"]
TEMP_RANGE_PATTERNS = [
    r"from ([-\d.]+)°C to ([-\d.]+)°C",
    r"ranging from ([-\d.]+)°C to ([-\d.]+)°C",
    r"lows of ([-\d.]+)°C and highs of ([-\d.]+)°C",
]
AVG_TEMP_PATTERN = r"averaging ([-\d.]+)°C"
WIND_PATTERN = r"(?i)winds? averaging ([\d.]+) km/h"
PRECIP_TERMS = ["low precipitation", "moderate precipitation", "high precipitation",
                "no precipitation", "heavy precipitation", "light precipitation"]
HUMIDITY_PATTERN = r"humidity \(([\d.]+)%\)"
CONDITION_TERMS = ["cold conditions", "warm conditions", "hot conditions",
                   "cool conditions", "mild conditions", "extreme conditions"]
UNKNOWN = "Unknown"
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _first_substring(text: Column, terms: list[str], out: list[str] | None = None) -> Column:
    out = out or terms
    return F.coalesce(*[F.when(text.contains(t), F.lit(o)) for t, o in zip(terms, out)], F.lit(UNKNOWN))


def _number(text: Column, pattern: str, group: int = 1, guard: str | None = None, guard_lower: bool = False) -> Column:
    """Regex number; ``guard`` is a literal the pattern cannot match without,
    checked first with a plain substring search (most long texts skip the regex)."""
    extracted = F.regexp_extract(text, pattern, group)
    if guard is not None:
        extracted = F.when((F.lower(text) if guard_lower else text).contains(guard), extracted)
    return F.nullif(extracted, F.lit("")).try_cast("double")


def extract_region(caption) -> Column:                      # x01
    low = F.lower(_c(caption))
    return _first_substring(low, [p.lower() for p in REGION_PATTERNS], REGION_PATTERNS)


def extract_date(caption) -> Column:                        # x02
    return F.coalesce(F.nullif(F.regexp_extract(_c(caption), DATE_PATTERN, 1), F.lit("")), F.lit(UNKNOWN))


def extract_season(caption) -> Column:                      # x03
    low = F.lower(_c(caption))
    period = F.regexp_extract(low, SEASON_PATTERN, 1)
    season = F.regexp_extract(low, SEASON_PATTERN, 2)
    return F.when(period != "", F.concat_ws(" ", period, season)).otherwise(_first_substring(low, SEASON_WORDS))


def extract_temperature_range(caption) -> Column:           # x04
    c = _c(caption)
    found = [F.when(F.regexp_extract(c, p, 0) != "",
                    F.struct(_number(c, p, 1).alias("min"), _number(c, p, 2).alias("max")))
             for p in TEMP_RANGE_PATTERNS]
    return F.when(c.contains("°C"), F.coalesce(*found))


def extract_avg_temperature(caption) -> Column:             # x05
    return _number(_c(caption), AVG_TEMP_PATTERN, guard="°C")


def extract_wind_speed(caption) -> Column:                  # x06
    return _number(_c(caption), WIND_PATTERN, guard="km/h", guard_lower=True)


def extract_precipitation(caption) -> Column:               # x07
    return _first_substring(F.lower(_c(caption)), PRECIP_TERMS)


def extract_humidity(caption) -> Column:                    # x08
    return _number(_c(caption), HUMIDITY_PATTERN, guard="humidity (")


def extract_conditions(caption) -> Column:                  # x09
    return _first_substring(F.lower(_c(caption)), CONDITION_TERMS)


def parse_caption(caption) -> Column:                       # x10
    """All fields as one struct plus the raw caption.  Parse once per caption,
    before any pairing."""
    c = _c(caption)
    return F.struct(
        c.alias("raw_caption"),
        extract_region(c).alias("region"),
        extract_date(c).alias("date"),
        extract_season(c).alias("season"),
        extract_temperature_range(c).alias("temperature_range"),
        extract_avg_temperature(c).alias("avg_temperature"),
        extract_wind_speed(c).alias("wind_speed"),
        extract_precipitation(c).alias("precipitation"),
        extract_humidity(c).alias("humidity"),
        extract_conditions(c).alias("conditions"),
    )
