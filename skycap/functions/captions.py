"""Caption rendering as Column expressions (no UDFs).

Every function returns a ``Column`` so rendering fuses into the projection
that follows the statistics aggregate and runs in whole-stage codegen.
Numbers are formatted with ``format_number(x, '0.0')`` which rounds like
Python's ``f"{x:.1f}"`` (half-even on the binary value); ``format_string``
rounds half-up and must not be used.
"""

from __future__ import annotations

from itertools import chain
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from skycap.schemas import CONUS

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the reference for identical captions)
# ---------------------------------------------------------------------------
# Sentences: {mean1} is the mean with one decimal, {mean0} with none; the same
# for min and max.  Classes: (upper bound, "<=" or "<", ...); the last has no bound.
TEMPERATURE_CLASSES = [(10.0, "<=", "Cold", "cold"), (25.0, "<", "Mild", "mild"), (None, "", "Hot", "hot")]
TEMPERATURE_SIMPLE = "{word} temperatures averaging {mean1}{unit}"
TEMPERATURE_DETAILED = ("Temperature ranges from {min0}°C to {max0}°C across the region with {word} conditions "
                        "averaging {mean0}{unit}")
# Beaufort classes on km/h
WIND_CLASSES = [
    (0.0, "<=", "Calm and no winds", "Wind speeds are calm"),
    (11.0, "<=", "Light breeze averaging {mean1} {unit}", "Light breeze conditions"),
    (19.0, "<=", "Gentle breeze averaging {mean1} {unit}", "Gentle breeze conditions"),
    (28.0, "<=", "Moderate breeze averaging {mean1} {unit}", "Moderate breeze conditions"),
    (38.0, "<=", "Fresh breeze averaging {mean1} {unit}", "Fresh breeze conditions"),
    (49.0, "<=", "Strong breeze averaging {mean1} {unit}", "Strong breeze conditions"),
    (61.0, "<=", "Near gale averaging {mean1} {unit}", "Near gale conditions"),
    (74.0, "<=", "Gale winds averaging {mean1} {unit}", "Gale conditions"),
    (88.0, "<=", "Strong gale averaging {mean1} {unit}", "Strong gale conditions"),
    (102.0, "<=", "Storm averaging {mean1} {unit}", "Storm conditions"),
    (117.0, "<=", "Violent storm averaging {mean1} {unit}", "Violent storm conditions"),
    (None, "", "Hurricane averaging {mean1} {unit} ", "Hurricane conditions"),  # keeps its trailing space
]
WIND_DETAILED = "{word} with average speeds of {mean1} {unit} and maximum gusts up to {max1}{unit}"
PRECIPITATION_CLASSES = [
    (0.1, "<=", "low precipitation", "Precipitation shows minimal activity with light amounts up to {max1}{unit}"),
    (0.3, "<=", "moderate precipitation",
     "Precipitation shows moderate activity with accumulations averaging {mean1}{unit} and maximum {max1}{unit}"),
    (None, "", "heavy precipitation",
     "Precipitation shows heavy activity with significant accumulations averaging {mean1}{unit} and maximum {max1}{unit}"),
]
# detailed, where the mean is low and the maximum above the moderate bound
PRECIPITATION_SCATTERED = "Precipitation shows scattered activity with accumulations up to {max1}{unit} in some areas"
HUMIDITY_CLASSES = [
    (30.0, "<", "low", "dry conditions throughout the region"),
    (60.0, "<", "moderate", "moderate moisture content"),
    (None, "", "high", "high moisture content throughout the region"),
]
HUMIDITY_SIMPLE = "{word} humidity ({mean1}{unit})"
HUMIDITY_DETAILED = "Humidity levels {min0}-{max0}{unit} with {word}"
REGION_DESCRIPTORS = {
    "Northeast": "Northeastern US",
    "Southeast": "Southeastern US",
    "Southwest": "Southwestern US",
    "Northwest": "Pacific Northwest",
    "Upper Midwest": "Upper Midwest",
    "Northern Rockies and Plains": "Rockies and Plains",
    "Ohio Valley": "Ohio River Valley",
    "South": "Southern US",
    "West": "Western US",
}
MONTH_ABBR = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fmt1(x) -> Column:
    """Python ``f"{x:.1f}"``."""
    return F.call_function("format_number", _c(x), F.lit("0.0"))


def fmt0(x) -> Column:
    """Python ``f"{x:.0f}"``."""
    return F.call_function("format_number", _c(x), F.lit("0"))


def _words(s: Column) -> Column:
    # Python str.split(): split on whitespace runs, ignore leading/trailing.
    return F.split(F.trim(s), r"\s+")


# c16 ----------------------------------------------------------------------
def valid_time_string(ts) -> Column:
    """Format a timestamp as ``HH:MM UTC dd Mon yyyy``."""
    return F.date_format(_c(ts), "HH:mm 'UTC' dd MMM yyyy")


# c01 ----------------------------------------------------------------------
def format_date(valid_time_str) -> Column:
    """Words 3-5 of the valid-time string; ``unknown date`` if absent."""
    w = _words(_c(valid_time_str))
    return F.when(_c(valid_time_str).isNotNull() & (F.size(w) >= 5),
                  F.concat_ws(" ", F.get(w, 2), F.get(w, 3), F.get(w, 4))).otherwise(F.lit("unknown date"))


# c02 ----------------------------------------------------------------------
def _season_of_month(month: Column) -> Column:
    return (F.when(month.isin(12, 1, 2), "winter")
            .when(month.isin(3, 4, 5), "spring")
            .when(month.isin(6, 7, 8), "summer")
            .otherwise("autumn"))


def _period_of_month(month: Column) -> Column:
    return (F.when(month.isin(12, 3, 6, 9), "early")
            .when(month.isin(1, 4, 7, 10), "mid")
            .when(month.isin(2, 5, 8, 11), "late")
            .otherwise("mid"))


def season_descriptor_from_month(month) -> Column:
    """``early|mid|late`` + season for a month number 1-12."""
    m = _c(month)
    return F.concat_ws(" ", _period_of_month(m), _season_of_month(m))


def legacy_month(valid_time_str) -> Column:
    """Month the string rule reads: word 2 (unknown word -> 1, too short -> 6)."""
    s = _c(valid_time_str)
    w = _words(s)
    month_map = F.create_map(*chain.from_iterable((F.lit(a), F.lit(i + 1)) for i, a in enumerate(MONTH_ABBR)))
    return F.when(s.isNull() | (F.size(w) < 2), F.lit(6)).otherwise(
        F.coalesce(F.try_element_at(month_map, F.get(w, 1)), F.lit(1)))


def season_descriptor(valid_time_str=None, *, ts=None, legacy: bool = False) -> Column:
    """Season descriptor.  Default reads the month of ``ts``; ``legacy=True``
    keeps the string rule (word 2 of the valid-time text)."""
    if legacy or ts is None:
        return season_descriptor_from_month(legacy_month(valid_time_str))
    return season_descriptor_from_month(F.month(_c(ts)))


# c03 ----------------------------------------------------------------------
def region_descriptor(region) -> Column:
    r = _c(region)
    m = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in REGION_DESCRIPTORS.items()))
    return F.coalesce(F.try_element_at(m, r), F.concat(r, F.lit(" region")))


# c04 ----------------------------------------------------------------------
def opening(region, season_desc: Column, date_str: Column) -> Column:
    r = F.coalesce(F.nullif(_c(region), F.lit("")), F.lit(CONUS))
    desc = F.when(r.isin(CONUS, "Alaska"), r).otherwise(region_descriptor(r))
    return F.concat_ws(", ", desc, season_desc, date_str)


# c05-c08 --------------------------------------------------------------------
class _Sentence:
    """Renders the fixed sentences over one variable's statistics."""

    def __init__(self, mean, unit, mn=None, mx=None):
        self.mean, self.max = _c(mean), None if mx is None else _c(mx)
        self.fields = {"unit": _c(unit)}
        for name, col in (("mean", mean), ("min", mn), ("max", mx)):
            if col is not None:
                self.fields |= {f"{name}1": fmt1(col), f"{name}0": fmt0(col)}

    def render(self, template: str, word: Column | None = None) -> Column:
        parts = []
        for text, field, _, _ in Formatter().parse(template):
            parts += [F.lit(text)] if text else []
            parts += [word if field == "word" else self.fields[field]] if field else []
        return F.concat(*parts)

    def by_class(self, classes: list[tuple], which: int) -> Column:
        """The sentence or word of the mean's class; ``which`` is its place in the class."""
        expr = F
        for bound, test, *texts in classes[:-1]:
            expr = expr.when(self.mean < bound if test == "<" else self.mean <= bound, self.render(texts[which]))
        return expr.otherwise(self.render(classes[-1][2 + which]))


def describe_temperature(mean, mn, mx, unit, *, detailed: bool = False) -> Column:
    s = _Sentence(mean, unit, mn, mx)
    return s.render(TEMPERATURE_DETAILED if detailed else TEMPERATURE_SIMPLE, s.by_class(TEMPERATURE_CLASSES, int(detailed)))


def describe_wind(mean, mx, unit, *, detailed: bool = False) -> Column:
    s = _Sentence(mean, unit, mx=mx)
    return s.render(WIND_DETAILED, s.by_class(WIND_CLASSES, 1)) if detailed else s.by_class(WIND_CLASSES, 0)


def describe_precipitation(mean, mx, unit, *, detailed: bool = False) -> Column:
    s = _Sentence(mean, unit, mx=mx)
    if not detailed:
        return F.when(s.mean.isNotNull(), s.by_class(PRECIPITATION_CLASSES, 0))
    low, moderate = (c[0] for c in PRECIPITATION_CLASSES[:2])
    scattered = (s.mean <= low) & (s.max > moderate)
    return F.when(scattered, s.render(PRECIPITATION_SCATTERED)).otherwise(s.by_class(PRECIPITATION_CLASSES, 1))


def describe_humidity(mean, mn, mx, unit, *, detailed: bool = False) -> Column:
    s = _Sentence(mean, unit, mn, mx)
    return s.render(HUMIDITY_DETAILED if detailed else HUMIDITY_SIMPLE, s.by_class(HUMIDITY_CLASSES, int(detailed)))


# c09 ----------------------------------------------------------------------
def describe_variable(variable, mean, mn, mx, unit, *, detailed: bool = False) -> Column:
    """Dispatch on the variable name; unknown variables render ``''``."""
    v = _c(variable)
    return (F.when(v == "wind_speed", describe_wind(mean, mx, unit, detailed=detailed))
            .when(v == "precipitation", describe_precipitation(mean, mx, unit, detailed=detailed))
            .when(v == "humidity", describe_humidity(mean, mn, mx, unit, detailed=detailed))
            .otherwise(F.lit("")))


# c10 ----------------------------------------------------------------------
def generate_caption(opening_col: Column, temperature_part: Column, *extra_parts: Column) -> Column:
    """``'. '.join(parts) + '.'``; NULL or empty extra parts are skipped."""
    extras = [F.nullif(p, F.lit("")) for p in extra_parts]
    return F.concat(F.concat_ws(". ", opening_col, temperature_part, *extras), F.lit("."))


# c11 ----------------------------------------------------------------------
def enhance_caption(caption, model, season, region, max_length: int | None = None) -> Column:
    r = F.trim(F.coalesce(_c(region), F.lit("")))
    region_info = F.when((r != "") & (r != "Unknown"), F.concat(F.lit(" in the "), r, F.lit(" region"))).otherwise(F.lit(""))
    out = F.concat(_c(caption), F.lit(" Generated from "), F.upper(_c(model)), F.lit(" model"),
                   F.lit(" during "), _c(season), F.lit(" season"), region_info, F.lit("."))
    return truncate(out, max_length) if max_length is not None else out


def truncate(text, max_length: int) -> Column:
    """Longer than ``max_length`` -> first ``max_length-3`` characters + ``...``."""
    t = _c(text)
    return F.when(F.length(t) > max_length, F.concat(F.substring(t, 1, max_length - 3), F.lit("..."))).otherwise(t)


# c12 ----------------------------------------------------------------------
def truncate_for_tokens(text, max_length: int = 77) -> Column:
    """Dataset reader rule: cap ``max_length`` at 77, allow 4 characters per token."""
    return truncate(text, 4 * min(max_length, 77))


# c13 ----------------------------------------------------------------------
def season_from_date(date_str) -> Column:
    """``YYYY-MM-DD`` -> winter/spring/summer/fall; unparseable -> unknown."""
    parts = F.split(_c(date_str), "-")
    month = F.when(F.size(parts) >= 2, F.get(parts, 1).try_cast("int"))
    return (F.when(month.isNull(), F.lit("unknown"))
            .when(month.isin(12, 1, 2), "winter")
            .when(month.isin(3, 4, 5), "spring")
            .when(month.isin(6, 7, 8), "summer")
            .otherwise("fall"))


# c14 ----------------------------------------------------------------------
def season_fallback(meta_season, caption, date_str) -> Column:
    """Metadata season, else caption keywords, else month of the date, else unknown."""
    s = _c(meta_season)
    cap = F.lower(F.coalesce(_c(caption), F.lit("")))
    from_meta = F.when(s.isNotNull() & (s != "Unknown"), s)
    from_caption = (F.when(cap.contains("winter") | cap.contains("cold") | cap.contains("snow"), "winter")
                    .when(cap.contains("spring") | cap.contains("mild"), "spring")
                    .when(cap.contains("summer") | cap.contains("hot"), "summer")
                    .when(cap.contains("autumn") | cap.contains("fall"), "autumn"))
    month = F.month(F.try_to_date(_c(date_str), "yyyy-M-d"))
    from_date = (F.when(month.isin(12, 1, 2), "winter").when(month.isin(3, 4, 5), "spring")
                 .when(month.isin(6, 7, 8), "summer").when(month.isin(9, 10, 11), "autumn"))
    return F.coalesce(from_meta, from_caption, from_date, F.lit("unknown"))


# c15 ----------------------------------------------------------------------
def weekly_mondays(start_year, start_month, end_year, end_month, *, legacy_day30: bool = False) -> Column:
    """Array of Mondays (DATE) from day 1 of the start month to the end month.

    Default ends on the last day of the end month; ``legacy_day30=True``
    ends on day 30 (February then raises, as the original rule does).
    """
    start = F.make_date(_c(start_year), _c(start_month), F.lit(1))
    end = (F.make_date(_c(end_year), _c(end_month), F.lit(30)) if legacy_day30
           else F.last_day(F.make_date(_c(end_year), _c(end_month), F.lit(1))))
    first = F.next_day(F.date_sub(start, 1), "Mon")
    return F.when(first <= end, F.sequence(first, end, F.expr("INTERVAL 7 DAYS"))).otherwise(F.array().cast("array<date>"))
