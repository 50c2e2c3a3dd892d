"""Shared DuckDB SQL fragments for the oracle queries.

They restate, in plain SQL, the derivations of ``skycap.plans.derive`` and the
semantics of the operators, so the driver can check each Spark query against
an independent engine.  Dimension rows are generated from ``skycap.schemas``.
"""

from __future__ import annotations

from skycap.functions.captions import REGION_DESCRIPTORS

# fixed values, written out here once more so that the oracle does not follow a wrong constant of the engine
WIND_BOUNDS = [(0, "Calm and no winds", "Wind speeds are calm"), (11, "Light breeze", "Light breeze conditions"),
               (19, "Gentle breeze", "Gentle breeze conditions"), (28, "Moderate breeze", "Moderate breeze conditions"),
               (38, "Fresh breeze", "Fresh breeze conditions"), (49, "Strong breeze", "Strong breeze conditions"),
               (61, "Near gale", "Near gale conditions"), (74, "Gale winds", "Gale conditions"),
               (88, "Strong gale", "Strong gale conditions"), (102, "Storm", "Storm conditions"),
               (117, "Violent storm", "Violent storm conditions")]
from skycap.schemas import REGION_MODEL_PAIRS, REGIONS, VARIABLES


def _lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return f"{float(v)!r}::DOUBLE"


def values(rows, names) -> str:
    body = ", ".join("(" + ", ".join(_lit(x) for x in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS t({', '.join(names)}))"


RDIM = values(REGIONS, ["name", "lon0", "lon1", "lat0", "lat1", "description"])
VDIM = values([(v[0], v[2], v[3], v[4], v[5]) for v in VARIABLES], ["variable", "unit", "description", "fac", "off"])
PAIRS = values([(i, r, m) for i, (r, m) in enumerate(REGION_MODEL_PAIRS)], ["pair_seq", "region", "model"])
DESC = values(list(REGION_DESCRIPTORS.items()), ["region", "descr"])

GRID = """
WITH grid0 AS (
  SELECT 'hrrr' AS model, 'conus' AS domain,
    CASE l_linenumber % 4 WHEN 1 THEN 'temperature' WHEN 2 THEN 'wind_speed'
         WHEN 3 THEN 'precipitation' ELSE 'humidity' END AS variable,
    CASE l_linenumber % 4 WHEN 1 THEN 'TMP:2 m above ground' WHEN 2 THEN 'WIND:10 m above ground'
         WHEN 3 THEN 'APCP:surface' END AS grib_name,
    date_trunc('month', l_shipdate) AS valid_time,
    CAST(l_suppkey % 2 AS INTEGER) AS forecast_hour,
    24.0::DOUBLE + CAST(l_orderkey % 260 AS DOUBLE) / 10.0::DOUBLE AS lat,
    CASE WHEN l_orderkey % 3 = 0
         THEN (-130.0::DOUBLE + CAST((l_partkey * 37 + l_linenumber * 11) % 660 AS DOUBLE) / 10.0::DOUBLE) + 360.0::DOUBLE
         ELSE -130.0::DOUBLE + CAST((l_partkey * 37 + l_linenumber * 11) % 660 AS DOUBLE) / 10.0::DOUBLE END AS lon_raw,
    CASE l_linenumber % 4
      WHEN 1 THEN (((303.0::DOUBLE - CAST(l_orderkey % 260 AS DOUBLE) * 0.12::DOUBLE) + l_quantity * 0.2::DOUBLE) - 5.0::DOUBLE) + l_extendedprice % 3.0::DOUBLE
      WHEN 2 THEN (l_quantity * l_discount) * 4.0::DOUBLE + l_extendedprice % 2.0::DOUBLE
      WHEN 3 THEN (l_discount * l_tax) * 60.0::DOUBLE + (l_extendedprice % 1.0::DOUBLE) * 0.01::DOUBLE
      ELSE CASE WHEN l_quantity > 48.0::DOUBLE THEN NULL ELSE l_extendedprice % 97.0::DOUBLE END END AS raw_value
  FROM lineitem
)"""

CELLS = GRID + f""",
cells AS (
  SELECT g.model, g.domain, g.variable, g.grib_name, g.valid_time, g.forecast_hour, g.lat, g.lon_raw,
         CASE WHEN g.lon_raw > 180.0 THEN g.lon_raw - 360.0::DOUBLE ELSE g.lon_raw END AS lon,
         g.raw_value,
         (g.raw_value + COALESCE(v.off, 0.0::DOUBLE)) * COALESCE(v.fac, 1.0::DOUBLE) AS value,
         v.unit, v.description
  FROM grid0 g LEFT JOIN {VDIM} v USING (variable)
)"""

TAGGED = CELLS + f""",
tagged AS (
  SELECT model, variable, valid_time, forecast_hour, '__field__' AS region, value FROM cells
  UNION ALL
  SELECT c.model, c.variable, c.valid_time, c.forecast_hour, r.name AS region, c.value
  FROM cells c JOIN {RDIM} r ON c.lon BETWEEN r.lon0 AND r.lon1 AND c.lat BETWEEN r.lat0 AND r.lat1
)"""

KEYS = "model, variable, valid_time, forecast_hour, region"
JOIN_KEYS = "USING (model, variable, valid_time, forecast_hour, region)"

STATS = TAGGED + f""",
s1 AS (
  SELECT {KEYS}, min(value) AS min, max(value) AS max, avg(value) AS mean,
         stddev_pop(value) AS std, var_pop(value) AS var,
         quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.25) AS percentile_25,
         quantile_cont(value, 0.75) AS percentile_75, quantile_cont(value, 0.9) AS percentile_90,
         quantile_cont(value, 0.95) AS percentile_95,
         count(value) AS count_valid, count(*) AS cells
  FROM tagged GROUP BY ALL
),
s2 AS (
  SELECT {KEYS},
         quantile_cont(abs(value - s1.median), 0.5) AS mad,
         avg(power(value - s1.mean, 3)) AS m3, avg(power(value - s1.mean, 4)) AS m4
  FROM tagged JOIN s1 {JOIN_KEYS} GROUP BY ALL
),
stats AS (
  SELECT s1.*, s2.mad,
         CASE WHEN s1.min = s1.max THEN NULL ELSE s2.m3 / power(s1.var, 1.5) END AS skewness,
         CASE WHEN s1.min = s1.max THEN NULL ELSE s2.m4 / (s1.var * s1.var) - 3.0 END AS kurtosis,
         s1.max - s1.min AS range, s1.percentile_75 - s1.percentile_25 AS iqr,
         CASE WHEN s1.mean <> 0 THEN s1.std / abs(s1.mean) ELSE 0.0 END AS coeff_variation
  FROM s1 LEFT JOIN s2 {JOIN_KEYS}
)"""

FIELD_STATS = STATS + f""",
fields AS (
  SELECT model, variable, valid_time, forecast_hour, first(unit) AS unit, first(description) AS description,
         first(grib_name) FILTER (WHERE grib_name IS NOT NULL) AS grib_name,
         first(domain) FILTER (WHERE domain IS NOT NULL) AS domain
  FROM cells GROUP BY ALL
),
frame AS (
  SELECT t.model, t.variable, t.valid_time, t.forecast_hour, p.region, t.cells AS total_cells,
         CASE WHEN p.region = 'Continental US' THEN '__field__' ELSE p.region END AS stat_region
  FROM stats t JOIN {PAIRS} p ON p.model = t.model
  WHERE t.region = '__field__'
),
fstats AS (
  SELECT f.model, f.variable, f.valid_time, f.forecast_hour, f.region,
         s.min, s.max, s.mean, s.std, s.median, s.range, s.var, s.skewness, s.kurtosis,
         s.percentile_25, s.percentile_75, s.percentile_90, s.percentile_95, s.iqr, s.mad, s.coeff_variation,
         COALESCE(s.count_valid, 0) AS count_valid,
         f.total_cells - COALESCE(s.count_valid, 0) AS count_missing,
         d.unit, d.description, strftime(f.valid_time, '%H:%M UTC %d %b %Y') AS valid_time_str,
         upper(f.model) AS model_upper, COALESCE(d.grib_name, 'Unknown') AS grib_name, d.domain
  FROM frame f
  LEFT JOIN stats s ON s.model = f.model AND s.variable = f.variable AND s.valid_time = f.valid_time
       AND s.forecast_hour = f.forecast_hour AND s.region = f.stat_region
  LEFT JOIN fields d ON d.model = f.model AND d.variable = f.variable AND d.valid_time = f.valid_time
       AND d.forecast_hour = f.forecast_hour
)"""


def R(x: str, digits: int = 6) -> str:
    """Round like the Spark side and fold -0.0 into 0.0."""
    return f"(CASE WHEN round({x}, {digits}) = 0 THEN 0.0::DOUBLE ELSE round({x}, {digits}) END)"


def fmt1(x: str) -> str:
    return f"printf('%.1f', {x})"


def fmt0(x: str) -> str:
    return f"printf('%.0f', {x})"


def wind_simple(mean: str, unit: str) -> str:
    parts = [f"WHEN {mean} <= {WIND_BOUNDS[0][0]}::DOUBLE THEN '{WIND_BOUNDS[0][1]}'"]
    for bound, text, _ in WIND_BOUNDS[1:]:
        parts.append(f"WHEN {mean} <= {bound}::DOUBLE THEN '{text} averaging ' || {fmt1(mean)} || ' ' || {unit}")
    return ("CASE " + " ".join(parts) + f" ELSE 'Hurricane averaging ' || {fmt1(mean)} || ' ' || {unit} || ' ' END")


def wind_detailed(mean: str, mx: str, unit: str) -> str:
    parts = [f"WHEN {mean} <= {bound}::DOUBLE THEN '{text}'" for bound, _, text in WIND_BOUNDS]
    head = "CASE " + " ".join(parts) + " ELSE 'Hurricane conditions' END"
    return (f"({head}) || ' with average speeds of ' || {fmt1(mean)} || ' ' || {unit} || "
            f"' and maximum gusts up to ' || {fmt1(mx)} || {unit}")


def temp_simple(mean: str, unit: str) -> str:
    return (f"(CASE WHEN {mean} <= 10.0::DOUBLE THEN 'Cold' WHEN {mean} >= 25.0::DOUBLE THEN 'Hot' ELSE 'Mild' END) "
            f"|| ' temperatures averaging ' || {fmt1(mean)} || {unit}")


def temp_detailed(mean: str, mn: str, mx: str, unit: str) -> str:
    return (f"'Temperature ranges from ' || {fmt0(mn)} || '°C to ' || {fmt0(mx)} || "
            f"'°C across the region with ' || (CASE WHEN {mean} <= 10.0::DOUBLE THEN 'cold' WHEN {mean} >= 25.0::DOUBLE THEN 'hot' ELSE 'mild' END) "
            f"|| ' conditions averaging ' || {fmt0(mean)} || {unit}")


def precip_simple(mean: str) -> str:
    return (f"CASE WHEN {mean} <= 0.1::DOUBLE THEN 'low precipitation' WHEN {mean} <= 0.3::DOUBLE THEN 'moderate precipitation' "
            f"WHEN {mean} IS NOT NULL THEN 'heavy precipitation' END")


def precip_detailed(mean: str, mx: str, unit: str) -> str:
    return (f"CASE WHEN {mean} <= 0.1 AND {mx} > 0.3::DOUBLE THEN 'Precipitation shows scattered activity with accumulations up to ' || {fmt1(mx)} || {unit} || ' in some areas' "
            f"WHEN {mean} <= 0.1::DOUBLE THEN 'Precipitation shows minimal activity with light amounts up to ' || {fmt1(mx)} || {unit} "
            f"WHEN {mean} <= 0.3::DOUBLE THEN 'Precipitation shows moderate activity with accumulations averaging ' || {fmt1(mean)} || {unit} || ' and maximum ' || {fmt1(mx)} || {unit} "
            f"ELSE 'Precipitation shows heavy activity with significant accumulations averaging ' || {fmt1(mean)} || {unit} || ' and maximum ' || {fmt1(mx)} || {unit} END")


def humidity_simple(mean: str, unit: str) -> str:
    return (f"(CASE WHEN {mean} < 30.0::DOUBLE THEN 'low' WHEN {mean} < 60.0::DOUBLE THEN 'moderate' ELSE 'high' END) "
            f"|| ' humidity (' || {fmt1(mean)} || {unit} || ')'")


def humidity_detailed(mean: str, mn: str, mx: str, unit: str) -> str:
    return (f"'Humidity levels ' || {fmt0(mn)} || '-' || {fmt0(mx)} || {unit} || "
            f"(CASE WHEN {mean} < 30.0::DOUBLE THEN ' with dry conditions throughout the region' "
            f"WHEN {mean} < 60.0::DOUBLE THEN ' with moderate moisture content' "
            f"ELSE ' with high moisture content throughout the region' END)")


def season_of_month(m: str) -> str:
    return (f"(CASE WHEN {m} IN (12, 1, 2) THEN 'winter' WHEN {m} IN (3, 4, 5) THEN 'spring' "
            f"WHEN {m} IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END)")


def season_descriptor(m: str) -> str:
    period = (f"(CASE WHEN {m} IN (12, 3, 6, 9) THEN 'early' WHEN {m} IN (1, 4, 7, 10) THEN 'mid' "
              f"WHEN {m} IN (2, 5, 8, 11) THEN 'late' ELSE 'mid' END)")
    return f"{period} || ' ' || {season_of_month(m)}"


def region_descriptor(r: str) -> str:
    whens = " ".join(f"WHEN {_lit(k)} THEN {_lit(v)}" for k, v in REGION_DESCRIPTORS.items())
    return f"(CASE {r} {whens} ELSE {r} || ' region' END)"


def opening(r: str, month: str, date_str: str) -> str:
    rr = f"COALESCE(NULLIF({r}, ''), 'Continental US')"
    desc = f"(CASE WHEN {rr} IN ('Continental US', 'Alaska') THEN {rr} ELSE {region_descriptor(rr)} END)"
    return f"{desc} || ', ' || {season_descriptor(month)} || ', ' || {date_str}"


COMBINED = FIELD_STATS + """,
wanted AS (
  SELECT * FROM fstats
  WHERE forecast_hour = CASE WHEN variable = 'precipitation' THEN 1 ELSE 0 END AND count_valid > 0
),
combined AS (
  SELECT model, valid_time, region,
    max(domain) FILTER (WHERE variable = 'temperature') AS domain,
    max(mean) FILTER (WHERE variable = 'temperature') AS t_mean,
    max(min) FILTER (WHERE variable = 'temperature') AS t_min,
    max(max) FILTER (WHERE variable = 'temperature') AS t_max,
    max(unit) FILTER (WHERE variable = 'temperature') AS t_unit,
    count(*) FILTER (WHERE variable = 'temperature') AS has_t,
    max(mean) FILTER (WHERE variable = 'wind_speed') AS w_mean,
    max(max) FILTER (WHERE variable = 'wind_speed') AS w_max,
    max(unit) FILTER (WHERE variable = 'wind_speed') AS w_unit,
    max(mean) FILTER (WHERE variable = 'precipitation') AS p_mean,
    max(max) FILTER (WHERE variable = 'precipitation') AS p_max,
    max(unit) FILTER (WHERE variable = 'precipitation') AS p_unit,
    max(mean) FILTER (WHERE variable = 'humidity') AS h_mean,
    max(min) FILTER (WHERE variable = 'humidity') AS h_min,
    max(max) FILTER (WHERE variable = 'humidity') AS h_max,
    max(unit) FILTER (WHERE variable = 'humidity') AS h_unit
  FROM wanted GROUP BY model, valid_time, region
  HAVING count(*) FILTER (WHERE variable = 'temperature') > 0
)"""


def caption_expr(prefix: str = "") -> str:
    p = prefix
    date_str = f"strftime({p}valid_time, '%d %b %Y')"
    parts = [opening(f"{p}region", f"month({p}valid_time)", date_str), temp_simple(f"{p}t_mean", f"{p}t_unit")]
    extras = [
        f"CASE WHEN {p}w_mean IS NOT NULL THEN {wind_simple(p + 'w_mean', p + 'w_unit')} END",
        f"CASE WHEN {p}p_mean IS NOT NULL THEN {precip_simple(p + 'p_mean')} END",
        f"CASE WHEN {p}h_mean IS NOT NULL THEN {humidity_simple(p + 'h_mean', p + 'h_unit')} END",
    ]
    return "concat_ws('. ', " + ", ".join(parts + [f"NULLIF({e}, '')" for e in extras]) + ") || '.'"


SAMPLES = COMBINED + f""",
samples AS (
  SELECT strftime(valid_time, '%Y-%m-%d') || '_temperature_' || model || '_' ||
         COALESCE(replace(lower(region), ' ', '_'), 'conus') AS sample_id,
         strftime(valid_time, '%Y-%m-%d') AS date, model, region, domain,
         {caption_expr()} AS caption
  FROM combined
)"""


# --- embedding evaluation set -------------------------------------------------
def _e(i: int) -> str:
    return f"CAST(embedding[{i + 1}] AS DOUBLE)"


def _names_list(names) -> str:
    return "[" + ", ".join(_lit(n) for n in names) + "]"


def _pick(simple: str, detailed: str) -> str:
    return f"(CASE WHEN detailed THEN {detailed} ELSE {simple} END)"


def _emb_caption() -> str:
    op = opening("region", "month(date)", "strftime(date, '%d %b %Y')")
    temp = _pick(temp_simple("t_mean", "'°C'"), temp_detailed("t_mean", "t_min", "t_max", "'°C'"))
    wind = f"CASE WHEN w_mean IS NOT NULL THEN {_pick(wind_simple('w_mean', chr(39) + 'km/h' + chr(39)), wind_detailed('w_mean', 'w_max', chr(39) + 'km/h' + chr(39)))} END"
    prec = _pick(precip_simple("p_mean"), precip_detailed("p_mean", "p_max", "'mm'"))
    hum = f"CASE WHEN h_mean IS NOT NULL THEN {_pick(humidity_simple('h_mean', chr(39) + '%' + chr(39)), humidity_detailed('h_mean', 'h_min', 'h_max', chr(39) + '%' + chr(39)))} END"
    return (f"concat_ws('. ', {op}, {temp}, NULLIF({wind}, ''), NULLIF({prec}, ''), NULLIF({hum}, '')) || '.'")


def _emb_fields() -> str:
    from skycap.schemas import REGION_NAMES
    return f"""
ef AS (
  SELECT vec_id AS idx, 'sample_' || CAST(vec_id AS VARCHAR) AS sample_id, label, embedding,
    {_names_list(REGION_NAMES)}[label % 10 + 1] AS region,
    CASE WHEN {_names_list(REGION_NAMES)}[label % 10 + 1] = 'Alaska' THEN 'hrrrak' ELSE 'hrrr' END AS model,
    make_date(CAST(2019 + vec_id % 6 AS BIGINT), CAST(1 + vec_id % 12 AS BIGINT), CAST(1 + vec_id % 28 AS BIGINT)) AS date,
    {_e(0)} * 100.0::DOUBLE + 12.0::DOUBLE AS t_mean,
    ({_e(0)} * 100.0::DOUBLE + 12.0::DOUBLE) - (5.0::DOUBLE + abs({_e(1)}) * 20.0::DOUBLE) AS t_min,
    ({_e(0)} * 100.0::DOUBLE + 12.0::DOUBLE) + (5.0::DOUBLE + abs({_e(2)}) * 20.0::DOUBLE) AS t_max,
    CASE WHEN vec_id % 7 <> 6 THEN abs({_e(3)}) * 150.0::DOUBLE END AS w_mean,
    CASE WHEN vec_id % 7 <> 6 THEN abs({_e(3)}) * 150.0::DOUBLE + abs({_e(6)}) * 40.0::DOUBLE END AS w_max,
    abs({_e(4)}) * 2.0::DOUBLE AS p_mean,
    abs({_e(4)}) * 2.0::DOUBLE + abs({_e(7)}) * 3.0::DOUBLE AS p_max,
    CASE WHEN vec_id % 5 <> 4 THEN least(abs({_e(5)}) * 300.0::DOUBLE, 100.0::DOUBLE) END AS h_mean,
    CASE WHEN vec_id % 5 <> 4 THEN least(abs({_e(5)}) * 300.0::DOUBLE, 100.0::DOUBLE) * 0.5::DOUBLE END AS h_min,
    CASE WHEN vec_id % 5 <> 4 THEN least(least(abs({_e(5)}) * 300.0::DOUBLE, 100.0::DOUBLE) * 1.5::DOUBLE, 100.0::DOUBLE) END AS h_max,
    vec_id % 3 = 0 AS detailed
  FROM embeddings
),
em AS (
  SELECT *, list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) + 0.3::DOUBLE * CAST(embedding[(i % len(embedding)) + 1] AS DOUBLE)) AS mix
  FROM ef
),
es AS (
  SELECT idx, sample_id, label, region, model, t_mean, w_mean, h_mean, p_mean,
    CAST(embedding AS DOUBLE[]) AS image_emb,
    list_transform(mix, lambda x: x / greatest(sqrt(list_sum(list_transform(mix, lambda y: y * y))), 1e-12::DOUBLE)) AS text_emb,
    {_emb_caption()} AS caption,
    strftime(date, '%Y-%m-%d') AS date
  FROM em
)"""


EMB = "WITH " + _emb_fields()


def region_parse(c: str) -> str:
    from skycap.functions.parse import REGION_PATTERNS
    whens = " ".join(f"WHEN contains(lower({c}), {_lit(p.lower())}) THEN {_lit(p)}" for p in REGION_PATTERNS)
    return f"(CASE {whens} ELSE 'Unknown' END)"


def first_term(c: str, terms) -> str:
    whens = " ".join(f"WHEN contains(lower({c}), {_lit(t)}) THEN {_lit(t)}" for t in terms)
    return f"(CASE {whens} ELSE 'Unknown' END)"


def re_num(c: str, pattern: str, group: int = 1) -> str:
    return f"TRY_CAST(NULLIF(regexp_extract({c}, {_lit(pattern)}, {group}), '') AS DOUBLE)"


def season_parse(c: str) -> str:
    from skycap.functions.parse import SEASON_PATTERN, SEASON_WORDS
    p = _lit(SEASON_PATTERN)
    return (f"(CASE WHEN regexp_extract(lower({c}), {p}, 1) <> '' THEN regexp_extract(lower({c}), {p}, 1) || ' ' || "
            f"regexp_extract(lower({c}), {p}, 2) ELSE {first_term(c, SEASON_WORDS)} END)")


def temp_range_parse(c: str) -> tuple[str, str]:
    from skycap.functions.parse import TEMP_RANGE_PATTERNS
    mins, maxs = [], []
    for p in TEMP_RANGE_PATTERNS:
        hit = f"regexp_extract({c}, {_lit(p)}, 0) <> ''"
        mins.append(f"WHEN {hit} THEN {re_num(c, p, 1)}")
        maxs.append(f"WHEN {hit} THEN {re_num(c, p, 2)}")
    return "(CASE " + " ".join(mins) + " END)", "(CASE " + " ".join(maxs) + " END)"


def parsed_columns(c: str) -> str:
    from skycap.functions.parse import (AVG_TEMP_PATTERN, CONDITION_TERMS, DATE_PATTERN, HUMIDITY_PATTERN,
                                        PRECIP_TERMS, WIND_PATTERN)
    tmin, tmax = temp_range_parse(c)
    return ",\n    ".join([
        f"{region_parse(c)} AS p_region",
        f"COALESCE(NULLIF(regexp_extract({c}, {_lit(DATE_PATTERN)}, 1), ''), 'Unknown') AS p_date",
        f"{season_parse(c)} AS p_season",
        f"{tmin} AS p_tmin", f"{tmax} AS p_tmax",
        f"{re_num(c, AVG_TEMP_PATTERN)} AS p_avg_temperature",
        f"{re_num(c, WIND_PATTERN)} AS p_wind_speed",
        f"{first_term(c, PRECIP_TERMS)} AS p_precipitation",
        f"{re_num(c, HUMIDITY_PATTERN)} AS p_humidity",
        f"{first_term(c, CONDITION_TERMS)} AS p_conditions",
    ])


def season_idx(s: str) -> str:
    last = f"list_last(string_split_regex(trim(replace({s}, 'autumn', 'fall')), '\\s+'))"
    return f"(list_position(['winter', 'spring', 'summer', 'fall'], {last}) - 1)"


EMB_PARSED = EMB + f""",
ep AS (
  SELECT *, {season_idx('p_season')} AS p_sidx FROM (SELECT es.*, {parsed_columns('caption')} FROM es)
)"""


def season_sim(a: str, b: str, ai: str, bi: str) -> str:
    d = f"least(abs({ai} - {bi}), 4 - abs({ai} - {bi}))"
    return (f"(CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN {ai} IS NULL OR {bi} IS NULL THEN 0.0::DOUBLE "
            f"WHEN {d} = 0 THEN 1.0::DOUBLE WHEN {d} = 1 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END)")


def temp_sim(a: str, b: str) -> str:
    return (f"(CASE WHEN abs({a} - {b}) <= 5.0::DOUBLE THEN 1.0::DOUBLE - abs({a} - {b}) / 5.0::DOUBLE "
            f"ELSE 0.0::DOUBLE END)")


def weather_sim(q: str, c: str) -> str:
    reg = (f"(CASE WHEN {q}.p_region <> 'Unknown' AND {c}.p_region <> 'Unknown' THEN "
           f"(CASE WHEN {q}.p_region = {c}.p_region THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END) ELSE 0.0::DOUBLE END)")
    sea = (f"(CASE WHEN {q}.p_season <> 'Unknown' AND {c}.p_season <> 'Unknown' THEN "
           f"{season_sim(q + '.p_season', c + '.p_season', q + '.p_sidx', c + '.p_sidx')} * 0.6::DOUBLE ELSE 0.0::DOUBLE END)")
    tmp = (f"(CASE WHEN {q}.p_avg_temperature IS NOT NULL AND {c}.p_avg_temperature IS NOT NULL THEN "
           f"{temp_sim(q + '.p_avg_temperature', c + '.p_avg_temperature')} * 0.7::DOUBLE ELSE 0.0::DOUBLE END)")
    con = (f"(CASE WHEN {q}.p_conditions <> 'Unknown' AND {c}.p_conditions <> 'Unknown' THEN "
           f"(CASE WHEN {q}.p_conditions = {c}.p_conditions THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) ELSE 0.0::DOUBLE END)")
    return (f"(CASE WHEN {q}.caption = {c}.caption THEN 1.0::DOUBLE "
            f"ELSE ((((0.0::DOUBLE + {reg}) + {sea}) + {tmp}) + {con}) / 2.6::DOUBLE END)")


def pairs_cte(qv: str, cv: str, tag: str = "x") -> str:
    """Brute-force pairs for the oracle only (small data)."""
    return f""",
pr_{tag} AS (
  SELECT q.idx AS qid, c.idx AS cid, list_dot_product(q.{qv}, c.{cv}) AS sim,
         CASE WHEN q.idx = c.idx THEN 1.0::DOUBLE ELSE {weather_sim('q', 'c')} END AS rel
  FROM ep q, ep c
),
rk_{tag} AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, cid) AS r,
            row_number() OVER (PARTITION BY qid ORDER BY rel DESC, cid) AS ir,
            count(*) OVER (PARTITION BY qid) AS n
  FROM pr_{tag}
)"""


def direction_metrics_sql(qv: str, cv: str, tag: str) -> str:
    return pairs_cte(qv, cv, tag) + f""",
pq_{tag} AS (
  SELECT qid,
    max(CASE WHEN cid = qid THEN r END) AS rank_true, max(n) AS n,
    min(CASE WHEN rel >= 0.8::DOUBLE THEN r END) AS first_rel,
    sum(CASE WHEN r <= least(5, n) THEN rel / log2(r + 1) ELSE 0.0 END) AS dcg5,
    sum(CASE WHEN ir <= least(5, n) THEN rel / log2(ir + 1) ELSE 0.0 END) AS idcg5,
    sum(CASE WHEN r <= least(10, n) THEN rel / log2(r + 1) ELSE 0.0 END) AS dcg10,
    sum(CASE WHEN ir <= least(10, n) THEN rel / log2(ir + 1) ELSE 0.0 END) AS idcg10
  FROM rk_{tag} GROUP BY qid
),
m_{tag} AS (
  SELECT avg(CASE WHEN rank_true <= least(1, n) THEN 1.0 ELSE 0.0 END) AS {tag}_recall_at_1,
         avg(CASE WHEN rank_true <= least(5, n) THEN 1.0 ELSE 0.0 END) AS {tag}_recall_at_5,
         avg(CASE WHEN rank_true <= least(10, n) THEN 1.0 ELSE 0.0 END) AS {tag}_recall_at_10,
         avg(COALESCE(1.0 / first_rel, 0.0)) AS {tag}_mrr,
         avg(CASE WHEN idcg5 > 0 THEN dcg5 / idcg5 ELSE 0.0 END) AS {tag}_ndcg_at_5,
         avg(CASE WHEN idcg10 > 0 THEN dcg10 / idcg10 ELSE 0.0 END) AS {tag}_ndcg_at_10
  FROM pq_{tag}
)"""
