"""The registered queries as plain SQL, written apart from the DataFrame code.

Wall values come from self-joins, anomalies from a second pass over the cells, the
temperature scale from the cells themselves, series from ordered windows.
"""

from __future__ import annotations

from dataclasses import dataclass

R_EARTH = "6371000.0::DOUBLE"
HEATING = "287.0::DOUBLE"
CP = "1005.0::DOUBLE"

GRID = """
grid AS (
  SELECT event_id AS e, event_id // 100 AS h, (event_id // 25) % 4 AS k,
         (event_id // 5) % 5 AS i, event_id % 5 AS j,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(event_id // 100) AS time,
         (100000 - 10000 * ((event_id // 25) % 4))::DOUBLE AS level,
         (40 + 5 * ((event_id // 5) % 5))::DOUBLE AS lat,
         (-130 + 5 * (event_id % 5))::DOUBLE AS lon,
         300 - 8 * ((event_id // 25) % 4) + value / 64 AS temp,
         ((event_id * 7919) % 1009) / 100 - 5::DOUBLE AS u,
         ((event_id * 104729) % 997) / 100 - 5::DOUBLE AS v,
         ((event_id * 1299709) % 883) / 4000 - 0.1::DOUBLE AS w,
         value
  FROM events),
ground AS (
  SELECT time, lat, lon, (84000 + 100 * ((e * 37) % 231))::DOUBLE AS sp,
         285 + value / 32 AS t2m, u / 2 AS u10, v / 2 AS v10
  FROM grid WHERE k = 0)"""

LEVELS = """
lev AS (
  SELECT level, row_number() OVER o - 1 AS level_id,
         coalesce(0.5::DOUBLE * (lag(level) OVER o + level),
                  level - 0.5::DOUBLE * (lead(level) OVER o - level)) AS p_start,
         coalesce(0.5::DOUBLE * (level + lead(level) OVER o),
                  level + 0.5::DOUBLE * (level - lag(level) OVER o)) AS p_end
  FROM (SELECT DISTINCT level FROM grid) WINDOW o AS (ORDER BY level DESC))"""


def _axis(name: str, low: float, high: float, margin: int = 1) -> str:
    return f"""
{name}_all AS (
  SELECT {name}, row_number() OVER o - 1 AS {name}_id, {name} AS a, lead({name}) OVER o AS b
  FROM (SELECT DISTINCT {name} FROM grid) WINDOW o AS (ORDER BY {name})),
{name}_snap AS (
  SELECT min({name}_id) + {margin} AS first_in, max({name}_id) - {margin} AS last_in
  FROM {name}_all WHERE b > {low} AND a < {high}),
{name}_d AS (
  SELECT {name}, {name}_id, a AS {name}_a, b AS {name}_b,
         {name}_id BETWEEN first_in AND last_in AS {name}_in,
         {name}_id - first_in AS from_first, {name}_id - last_in AS from_last
  FROM {name}_all, {name}_snap
  WHERE b IS NOT NULL AND {name}_id BETWEEN first_in - 1 AND last_in + 1)"""


AXES = ",".join([LEVELS, _axis("lat", 40, 60), _axis("lon", -130, -110)])
BASE = "WITH" + GRID + "," + AXES


def _rad(x: str) -> str:
    return f"radians({x})"


AREA = f"({R_EARTH} * {R_EARTH} * abs(sin(radians(lat_b)) - sin(radians(lat_a))) * abs(radians(lon_b) - radians(lon_a)))"


@dataclass(frozen=True)
class Variant:
    """Bottom mode, overflow and blending of one family of queries."""

    level_bottom: float | None = None
    overflow: bool = True
    blended: bool = False
    top: float = 70000.0

    @property
    def walls(self) -> tuple[str, ...]:
        return ("west", "east", "south", "north", "top") + (("bottom",) if self.level_bottom else ())

    def eff(self, sp: str) -> str:
        if self.level_bottom is None:
            return sp
        return f"CASE WHEN {sp} IS NOT NULL THEN least({sp}, {self.level_bottom}::DOUBLE) END"

    def weight(self, bottom: str) -> str:
        share = (f"CASE WHEN {bottom} IS NOT NULL THEN greatest(0::DOUBLE, least(p_start, {bottom})"
                 f" - greatest(p_end, {self.top}::DOUBLE)) / (p_start - p_end) END")
        if self.overflow and self.level_bottom is None:
            return (f"CASE WHEN level_id = 0 THEN CASE WHEN {bottom} IS NOT NULL THEN"
                    f" greatest(0::DOUBLE, ({bottom} - p_end) / (p_start - p_end)) END ELSE {share} END")
        return share

    @property
    def case(self) -> str:
        touched = "(sp > p_end AND sp < p_start)"
        if self.overflow:
            touched = f"({touched} OR (level_id = 0 AND sp >= p_start))"
        return f"CASE WHEN {touched} AND sp > level THEN 'B' WHEN {touched} THEN 'C' ELSE 'A' END"


SURFACE = Variant()
CLIPPED = Variant(overflow=False)
LEVEL = Variant(level_bottom=90000.0)
SURFACE_BLENDED = Variant(blended=True)
LEVEL_BLENDED = Variant(level_bottom=90000.0, blended=True)


def cells(v: Variant) -> str:
    """All halo cells with bounds, effective bottom, weight, case and wall values."""
    blend = {}
    for name, near in (("temp", "t2m"), ("u", "u10"), ("v", "v10")):
        blend[name] = name if not v.blended else (
            f"CASE ground_case WHEN 'B' THEN (greatest(level - p_end, 0::DOUBLE) * {name}"
            f" + greatest(sp - level, 0::DOUBLE) * 0.5::DOUBLE * ({name} + {near}))"
            f" / (greatest(level - p_end, 0::DOUBLE) + greatest(sp - level, 0::DOUBLE))"
            f" WHEN 'C' THEN 0.5::DOUBLE * (coalesce(lead({name}) OVER col, {near}) + {near})"
            f" ELSE {name} END")
    return f"""
plain AS (
  SELECT g.time, g.level, level_id, p_start, p_end, lat_id, lat_a, lat_b, lat_in, lon_id, lon_a, lon_b, lon_in,
         lat_d.from_first AS lat_ff, lat_d.from_last AS lat_fl, lon_d.from_first AS lon_ff, lon_d.from_last AS lon_fl,
         temp, u, v, w, sp, t2m, u10, v10, {v.eff("sp")} AS bottom, {v.case} AS ground_case
  FROM grid g JOIN lev USING (level) JOIN lat_d USING (lat) JOIN lon_d USING (lon)
       LEFT JOIN ground s ON g.time = s.time AND g.lat = s.lat AND g.lon = s.lon),
cells AS (
  SELECT *, {blend["temp"]} AS temp_f, {blend["u"]} AS u_f, {blend["v"]} AS v_f,
         {AREA} AS area, {AREA} * (p_start - p_end) * ({v.weight("bottom")}) AS air
  FROM plain WINDOW col AS (PARTITION BY time, lat_id, lon_id ORDER BY level_id)),
dom AS (SELECT * FROM cells WHERE lat_in AND lon_in)"""


def vol() -> str:
    return f"""
vol AS (
  SELECT time, sum(air) AS volume, sum(temp * air) AS heat,
         sum(w * {HEATING} * temp / level / {CP} * air) AS adiabatic,
         sum(w * {HEATING} / level / {CP} * air) AS lift,
         sum(temp * air) / sum(air) AS mean_t
  FROM dom GROUP BY time)"""


def walls(v: Variant) -> str:
    """Wall pieces from self-joins of the two cells astride; heat against <T> of the hour."""
    def side(wall, other, along, flow, edge, span):
        outer = f"a.{edge}"
        return f"""
  SELECT '{wall}' AS wall, a.time, a.level_id, a.level, a.{along}_id AS along_id, a.p_start, a.p_end,
         0.5::DOUBLE * (a.{flow} + b.{flow}) AS flow, 0.5::DOUBLE * (a.temp_f + b.temp_f) AS temp,
         0.5::DOUBLE * (a.bottom + b.bottom) AS bottom, (a.p_start - a.p_end) * {span} AS area
  FROM cells a JOIN cells b ON a.time = b.time AND a.level_id = b.level_id
       AND a.{along}_id = b.{along}_id AND b.{other}_id = a.{other}_id + 1
  WHERE a.{along}_in AND {outer}"""

    dphi = f"{R_EARTH} * abs(radians(a.lat_b) - radians(a.lat_a))"
    dlon = "abs(radians(a.lon_b) - radians(a.lon_a))"
    south = f"{R_EARTH} * cos(radians((SELECT min(lat_a) FROM lat_d))) * {dlon}"
    north = f"{R_EARTH} * cos(radians((SELECT max(lat_b) FROM lat_d))) * {dlon}"
    parts = [
        side("west", "lon", "lat", "u_f", "lon_ff = -1", dphi),
        side("east", "lon", "lat", "u_f", "lon_fl = 0", dphi),
        side("south", "lat", "lon", "v_f", "lat_ff = -1", south),
        side("north", "lat", "lon", "v_f", "lat_fl = 0", north),
    ]
    sign = "CASE WHEN wall IN ('east', 'north', 'bottom') THEN 1::DOUBLE ELSE -1::DOUBLE END"
    flat = [("top", v.top)] + ([("bottom", v.level_bottom)] if v.level_bottom else [])
    lids = " UNION ALL ".join(
        f"SELECT '{wall}' AS wall, time, w AS flow, temp, area,"
        f" CASE WHEN sp > {p}::DOUBLE THEN 1::DOUBLE ELSE 0::DOUBLE END AS weight FROM dom WHERE level = {p}::DOUBLE"
        for wall, p in flat)
    pivot = ", ".join(
        f"sum(heat) FILTER (wall = '{w}') AS heat_{w}, sum(mass) FILTER (wall = '{w}') AS mass_{w}" for w in v.walls)
    return f"""
faces AS ({" UNION ALL ".join(parts)}),
pieces AS (
  SELECT wall, time, flow, temp, area, {v.weight("bottom")} AS weight FROM faces
  UNION ALL {lids}),
wall_flux AS (
  SELECT p.time, wall, {sign} * sum(flow * (temp - mean_t) * area * weight) AS heat,
         {sign} * sum(flow * area * weight) AS mass
  FROM pieces p JOIN vol ON p.time = vol.time GROUP BY p.time, wall),
flux AS (
  SELECT time, {pivot}, sum(heat) AS net_heat, sum(mass) AS net_mass,
         abs(sum(mass)) / nullif(sum(abs(mass)), 0) AS fraction
  FROM wall_flux GROUP BY time)"""


BUDGET = """
spread AS (
  SELECT sqrt(avg((temp - mean_t) * (temp - mean_t))) AS t_scale FROM dom JOIN vol USING (time)),
steps AS (
  SELECT *, row_number() OVER o AS n, count(*) OVER () AS n_all,
         date_diff('second', lag(time) OVER o, lead(time) OVER o) AS elapsed,
         lead(volume) OVER o - lag(volume) OVER o AS d_volume,
         lead(heat) OVER o - lag(heat) OVER o AS d_heat,
         lead(mean_t) OVER o - lag(mean_t) OVER o AS d_mean
  FROM vol JOIN flux USING (time) WINDOW o AS (ORDER BY time)),
inner_steps AS (
  SELECT *, d_volume / elapsed AS dv, d_heat / elapsed AS ddt, volume * (d_mean / elapsed) AS st
  FROM steps WHERE n > 1 AND n < n_all),
bud AS (
  SELECT *, ddt - mean_t * dv AS st2, (dv + net_mass) * (SELECT t_scale FROM spread) AS err,
         st + net_heat - adiabatic AS diab, dv + net_mass AS dm,
         (SELECT t_scale FROM spread) AS t_scale, (SELECT avg(volume) FROM inner_steps) AS mean_volume
  FROM inner_steps)"""


def through_walls(v: Variant) -> str:
    return BASE + "," + cells(v) + "," + vol() + "," + walls(v)


def whole(v: Variant) -> str:
    return through_walls(v) + "," + BUDGET


def rnd(expression: str, name: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0::DOUBLE AS {name}"


def kh(expression: str, name: str, volume: str = "volume") -> str:
    """A rate per second as K/h (or 1/h), rounded."""
    return rnd(f"({expression}) * 3600 / {volume}", name)


def _budget(v: Variant) -> str:
    return whole(v) + " SELECT time, " + ", ".join([
        kh("ddt", "d_dt_T"), kh("st", "dT_dt"), kh("st2", "dT_dt_2"), kh("dv", "dV_dt"),
        kh("net_heat", "advection_term"), kh("err", "advection_error"), kh("adiabatic", "adiabatic_term"),
        kh("diab", "diabatic_term"), rnd("mean_t", "T_domain_avg"), rnd("volume / 1e15", "domain_volume"),
        rnd("t_scale", "T_scale"),
    ]) + " FROM bud"


def _hourly(n: int) -> str:
    before, after = n // 2, n - 1 - n // 2
    raw = {"domain_volume": "volume / 1e15", "T_domain_avg": "mean_t", "dT_dt": "st * 3600 / volume",
           "dT_dt_from_terms": "(-net_heat + adiabatic + diab) * 3600 / volume",
           "advection_term": "-net_heat * 3600 / volume", "adiabatic_term": "adiabatic * 3600 / volume",
           "diabatic_term": "diab * 3600 / volume", "error": "abs(err) * 3600 / volume"}
    rolled = ", ".join(f"CASE WHEN count({e}) OVER f = {n} THEN avg({e}) OVER f END AS {name}" for name, e in raw.items())
    out = [rnd(name, name) for name in raw]
    for name in ("advection_term", "diabatic_term"):
        out += [rnd(f"{name} - error", f"{name}_low"), rnd(f"{name} + error", f"{name}_high")]
    return whole(SURFACE) + f""", rolled AS (
  SELECT time, {rolled} FROM bud
  WINDOW f AS (ORDER BY time ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING))
SELECT time, {", ".join(out)} FROM rolled"""


def _daily() -> str:
    raw = {"d_dt_T": "ddt * 3600 / volume", "dT_from_dV": "mean_t / volume * dv * 3600", "dT_dt": "st * 3600 / volume",
           "advection_term": "-net_heat * 3600 / volume", "adiabatic_term": "adiabatic * 3600 / volume",
           "diabatic_term": "diab * 3600 / volume", "error": "abs(err) * 3600 / volume"}
    sums = ", ".join(f"coalesce(sum({e}), 0) AS {name}" for name, e in raw.items())
    out = [rnd("domain_volume", "domain_volume"), rnd("T_domain_avg", "T_domain_avg")] + [rnd(n, n) for n in raw]
    for name in ("advection_term", "diabatic_term"):
        out += [rnd(f"{name} - error", f"{name}_low"), rnd(f"{name} + error", f"{name}_high")]
    return whole(SURFACE) + f""", days AS (
  SELECT date_trunc('day', time)::TIMESTAMP AS day, avg(volume) / 1e15 AS domain_volume, avg(mean_t) AS T_domain_avg, {sums}
  FROM bud GROUP BY 1)
SELECT day, {", ".join(out)} FROM days"""


RUN_TO = "OVER (ORDER BY time ROWS UNBOUNDED PRECEDING)"
STEP = "(SELECT date_diff('second', min(time), max(time)) FROM (SELECT time FROM bud ORDER BY time LIMIT 2))"
SIDES = {"zonal": ("west", "east"), "meridional": ("south", "north"), "vertical": ("top", "bottom"),
         "horizontal": ("west", "east", "south", "north")}


def _mass_direction() -> str:
    smooth = {w: f"CASE WHEN count(mass_{w}) OVER f = 24 THEN avg(mass_{w}) OVER f END" for w in SURFACE.walls}
    cols = ", ".join(f"{e} AS s_{w}" for w, e in smooth.items())
    out = [kh("dm", "delta_mass", "mean_volume")]
    out += [kh(f"s_{w}", f"mass_{w}", "mean_volume") for w in SURFACE.walls]
    for name, pair in SIDES.items():
        out.append(kh(" + ".join(f"s_{w}" for w in pair if w in SURFACE.walls), name, "mean_volume"))
    return whole(SURFACE) + f""", smoothed AS (
  SELECT time, dm, mean_volume, {cols} FROM bud
  WINDOW f AS (ORDER BY time ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING))
SELECT time, {", ".join(out)} FROM smoothed"""


def _mass_direction_cumulative() -> str:
    out = [rnd(f"sum(dm * {STEP}) {RUN_TO} / mean_volume", "cumulative_residual")]
    for name, pair in SIDES.items():
        inside = " + ".join(f"mass_{w}" for w in pair if w in SURFACE.walls)
        out.append(rnd(f"sum(({inside}) * {STEP}) {RUN_TO} / mean_volume", f"cumulative_{name}"))
    return whole(SURFACE) + f" SELECT time, {', '.join(out)} FROM bud"


def _quantiles() -> str:
    probs = ", ".join(f"{i / 20}" for i in range(1, 20))
    return whole(SURFACE) + f""",
rates AS (SELECT round(dv / 1e9, 6) AS shared, dv / 1e9 AS dv, dm / 1e9 AS dm FROM bud),
edges AS (SELECT quantile_cont(shared, [{probs}]) AS q FROM rates),
placed AS (SELECT len([x FOR x IN q IF x <= shared]) AS bin, dv, dm FROM rates, edges)
SELECT b.bin::INTEGER AS bin, count(dv) AS n, {rnd("avg(dv)", "mean_dV_dt")}, {rnd("avg(dm)", "mean_residual")}
FROM (SELECT unnest(range(20)) AS bin) b LEFT JOIN placed p ON b.bin = p.bin GROUP BY b.bin"""


HOURLY_VALUES = """WITH hours AS (
  SELECT date_trunc('hour', ts)::TIMESTAMP AS time, avg(value) AS value FROM events GROUP BY 1)"""


def _wall_weight(v: Variant) -> str:
    return through_walls(v) + f" SELECT time, wall, level_id, along_id, {rnd(v.weight('bottom'), 'W_wall', 9)} FROM faces"


def _volume_weight(v: Variant) -> str:
    return (BASE + "," + cells(v) +
            f" SELECT time, level_id, lat_id, lon_id, {rnd(v.weight('bottom'), 'W_volume', 9)} FROM dom")


def _constant_t() -> str:
    error, test = "err / volume", "t_scale * net_mass / volume"
    return whole(SURFACE) + " SELECT time, " + ", ".join([
        kh("err", "advection_error"), kh("t_scale * net_mass", "test_advection"),
        rnd(f"sum({error} * {STEP}) {RUN_TO}", "integrated_advection_error"),
        rnd(f"sum({test} * {STEP}) {RUN_TO}", "integrated_test_advection"),
    ]) + " FROM bud"


def _constant_t_budget() -> str:
    """The rerun taken literally: every temperature is the scale of the first run."""
    return whole(SURFACE) + f""",
vol_c AS (
  SELECT time, sum(air) AS volume, sum(c * air) AS heat, sum(w * {HEATING} * c / level / {CP} * air) AS adiabatic,
         sum(c * air) / sum(air) AS mean_t
  FROM dom, (SELECT t_scale AS c FROM spread) GROUP BY time),
flux_c AS (
  SELECT time, sum(CASE WHEN wall IN ('east', 'north', 'bottom') THEN 1 ELSE -1 END * flow * c * area * weight) AS net_heat
  FROM pieces, (SELECT t_scale AS c FROM spread) GROUP BY time),
steps_c AS (
  SELECT vol_c.*, net_heat, net_mass, lead(vol_c.volume) OVER o - lag(vol_c.volume) OVER o AS d_volume,
         lead(heat) OVER o - lag(heat) OVER o AS d_heat, lead(mean_t) OVER o - lag(mean_t) OVER o AS d_mean,
         date_diff('second', lag(vol_c.time) OVER o, lead(vol_c.time) OVER o) AS elapsed
  FROM vol_c JOIN flux_c ON vol_c.time = flux_c.time JOIN (SELECT time, net_mass FROM flux) m ON m.time = vol_c.time
  WINDOW o AS (ORDER BY vol_c.time)),
bud_c AS (
  SELECT *, d_volume / elapsed AS dv, d_heat / elapsed AS ddt, volume * (d_mean / elapsed) AS st,
         (SELECT avg(mean_t) FROM vol_c) AS scale_c
  FROM steps_c WHERE elapsed IS NOT NULL)
SELECT time, {", ".join([
    kh("ddt", "d_dt_T"), kh("st", "dT_dt"), kh("ddt - mean_t * dv", "dT_dt_2"), kh("dv", "dV_dt"),
    kh("net_heat", "advection_term"), kh("(dv + net_mass) * scale_c", "advection_error"),
    kh("adiabatic", "adiabatic_term"), kh("st + net_heat - adiabatic", "diabatic_term"),
    rnd("mean_t", "T_domain_avg"), rnd("volume / 1e15", "domain_volume"), rnd("scale_c", "T_scale")])}
FROM bud_c"""


def sql() -> dict[str, str]:
    dom_vol = BASE + "," + cells(SURFACE) + "," + vol()
    bud = whole(SURFACE)
    wall_cols = lambda prefix, volume: ", ".join(kh(f"{prefix}_{w}", f"{prefix}_{w}", volume) for w in SURFACE.walls)
    fields9 = ", ".join(rnd(n, a, 10) for n, a in (("temp", "T"), ("u", "u"), ("v", "v"), ("w", "w")))
    loaded = ", ".join(rnd(n, a, 9) for n, a in (
        ("temp", "T"), ("u", "u"), ("v", "v"), ("w", "w"), ("sp", "sp"), ("t2m", "T2m"), ("u10", "u10"), ("v10", "v10")))
    out = {
        "cell_edges": "WITH" + GRID + "," + LEVELS + " SELECT level, level_id, p_start, p_end FROM lev",
        "bbox_cells": "WITH" + GRID + "," + _axis("lat", 43, 57) + "," + _axis("lon", -124, -112) + """
SELECT 'lat' AS axis, lat_id AS cell_id, a AS cell_start, b AS cell_end FROM lat_all WHERE b > 43 AND a < 57
UNION ALL SELECT 'lon', lon_id, a, b FROM lon_all WHERE b > -124 AND a < -112""",
        "halo_flags": BASE + " SELECT lat_id, lon_id, lat_a AS lat_start, lat_b AS lat_end, lon_a AS lon_start,"
                             " lon_b AS lon_end, lat_in AND lon_in AS in_domain FROM lat_d, lon_d",
        "horizontal_area": BASE + f" SELECT lat_id, lon_id, {rnd(AREA + ' / 1e9', 'area')} FROM lat_d, lon_d"
                                  " WHERE lat_in AND lon_in",
        "wall_area": BASE + f"""
SELECT wall, level_id, lat_id AS along_id, {rnd(f"(p_start - p_end) * {R_EARTH} * abs(radians(lat_b) - radians(lat_a)) / 1e9", "area")}
FROM lev, lat_d, (SELECT unnest(['west', 'east']) AS wall)
UNION ALL
SELECT wall, level_id, lon_id, {rnd(f"(p_start - p_end) * {R_EARTH} * cos(radians(CASE wall WHEN 'south' THEN (SELECT min(lat_a) FROM lat_d) ELSE (SELECT max(lat_b) FROM lat_d) END)) * abs(radians(lon_b) - radians(lon_a)) / 1e9", "area")}
FROM lev, lon_d, (SELECT unnest(['south', 'north']) AS wall)""",
        "cell_volume": BASE + f" SELECT level_id, lat_id, lon_id, {rnd(AREA + ' * (p_start - p_end) / 1e15', 'volume')}"
                              " FROM lev, lat_d, lon_d WHERE lat_in AND lon_in",
        "harmonise": "WITH" + GRID + f" SELECT time, level, lat, lon, {fields9} FROM grid",
        "merge_sources": "WITH" + GRID + f"""
SELECT time, level, lat, lon, {rnd("CASE WHEN level >= 80000 THEN temp END", "T", 10)}, {rnd("CASE WHEN level <= 90000 THEN u END", "u", 10)},
       {rnd("CASE WHEN lat > 45 THEN v END", "v", 10)}, {rnd("CASE WHEN lon < -112 THEN w END", "w", 10)}
FROM grid WHERE level >= 80000 OR level <= 90000 OR lat > 45 OR lon < -112""",
        "load_merged": "WITH" + GRID + f"""
SELECT grid.time, level, grid.lat, grid.lon, {loaded} FROM grid JOIN ground USING (time, lat, lon)
WHERE grid.time >= TIMESTAMP '2024-01-01 02:00:00' AND grid.time < TIMESTAMP '2024-01-02 06:00:00'""",
        "load_per_variable": "WITH" + GRID + f"""
SELECT grid.time, level, grid.lat, grid.lon, {loaded} FROM grid JOIN ground USING (time, lat, lon)""",
        "quality_report_broken": "WITH" + GRID + """,
kept AS (SELECT * FROM grid WHERE h <> 3),
upper_air AS (SELECT * FROM kept WHERE e % 1000 <> 77 UNION ALL SELECT * FROM kept WHERE e % 500 = 13),
floor AS (SELECT time, lat, lon FROM kept WHERE k = 0 AND e % 700 <> 5
          UNION ALL SELECT time, lat, lon FROM kept WHERE e % 400 = 2),
t AS (SELECT DISTINCT time FROM upper_air),
span AS (SELECT epoch_us(min(time)) AS first, epoch_us(max(time)) - epoch_us(min(time)) AS width, count(*) AS n FROM t),
seen AS (SELECT 'level' AS axis, -level AS value, min(-e) AS place FROM upper_air GROUP BY level
         UNION ALL SELECT 'lat', lat, min(-e) FROM upper_air GROUP BY lat
         UNION ALL SELECT 'lon', lon, min(-e) FROM upper_air GROUP BY lon),
breaks AS (SELECT axis, value <= lag(value) OVER (PARTITION BY axis ORDER BY place) AS wrong FROM seen),
rules AS (
  SELECT 'dimensions_present' AS rule, 0::BIGINT AS n_bad
  UNION ALL SELECT 'variables_present', 0
  UNION ALL SELECT 'keys_unique', (SELECT count(*) - count(DISTINCT (time, level, lat, lon)) FROM upper_air)
            + (SELECT count(*) - count(DISTINCT (time, lat, lon)) FROM floor)
  UNION ALL SELECT 'grid_dense', (SELECT count(*) FROM t) * (SELECT count(DISTINCT level) FROM upper_air)
            * (SELECT count(DISTINCT lat) FROM upper_air) * (SELECT count(DISTINCT lon) FROM upper_air)
            - (SELECT count(DISTINCT (time, level, lat, lon)) FROM upper_air)
  UNION ALL SELECT 'ground_dense', (SELECT count(*) FROM t) * (SELECT count(DISTINCT lat) FROM upper_air)
            * (SELECT count(DISTINCT lon) FROM upper_air)
            - (SELECT count(DISTINCT (time, lat, lon)) FROM floor WHERE time IN (SELECT time FROM t))
  UNION ALL SELECT 'levels_descending', count(*) FILTER (wrong) FROM breaks WHERE axis = 'level'
  UNION ALL SELECT 'latitudes_ascending', count(*) FILTER (wrong) FROM breaks WHERE axis = 'lat'
  UNION ALL SELECT 'longitudes_ascending', count(*) FILTER (wrong) FROM breaks WHERE axis = 'lon'
  UNION ALL SELECT 'temperature_in_kelvin', 1
  UNION ALL SELECT 'time_regular', count(*) FILTER (width % (n - 1) <> 0 OR (epoch_us(time) - first) % (width // (n - 1)) <> 0)
            FROM t, span)
SELECT rule, n_bad = 0 AS ok, n_bad FROM rules""",
        "resolved_box": "WITH" + GRID + "," + _axis("lat", 41, 59) + "," + _axis("lon", -129, -111) + """
SELECT (SELECT min(lat_a) FROM lat_d WHERE lat_in) AS lat_low, (SELECT max(lat_b) FROM lat_d WHERE lat_in) AS lat_high,
       (SELECT min(lon_a) FROM lon_d WHERE lon_in) AS lon_low, (SELECT max(lon_b) FROM lon_d WHERE lon_in) AS lon_high,
       70000::DOUBLE AS top""",
        "time_slice": "WITH" + GRID + f""" SELECT time, level, lat, lon, {rnd("temp", "T", 10)} FROM grid
WHERE time >= TIMESTAMP '2024-01-02 00:00:00' AND time < TIMESTAMP '2024-01-04 00:00:00'""",
        "quality_report": "WITH" + GRID + """,
t AS (SELECT DISTINCT time FROM grid),
gaps AS (SELECT lead(time) OVER (ORDER BY time) - time AS gap FROM t),
seen AS (SELECT 'level' AS axis, -level AS value, min(e) AS e FROM grid GROUP BY level
         UNION ALL SELECT 'lat', lat, min(e) FROM grid GROUP BY lat
         UNION ALL SELECT 'lon', lon, min(e) FROM grid GROUP BY lon),
breaks AS (SELECT axis, value <= lag(value) OVER (PARTITION BY axis ORDER BY e) AS wrong FROM seen),
rules AS (
  SELECT 'dimensions_present' AS rule, 0::BIGINT AS n_bad
  UNION ALL SELECT 'variables_present', 0
  UNION ALL SELECT 'keys_unique', count(*) - count(DISTINCT (time, level, lat, lon)) FROM grid
  UNION ALL SELECT 'grid_dense', (SELECT count(*) FROM t) * (SELECT count(DISTINCT level) FROM grid)
            * (SELECT count(DISTINCT lat) FROM grid) * (SELECT count(DISTINCT lon) FROM grid)
            - (SELECT count(DISTINCT (time, level, lat, lon)) FROM grid)
  UNION ALL SELECT 'ground_dense', (SELECT count(*) FROM t) * (SELECT count(DISTINCT lat) FROM grid)
            * (SELECT count(DISTINCT lon) FROM grid) - (SELECT count(DISTINCT (time, lat, lon)) FROM ground)
  UNION ALL SELECT 'levels_descending', count(*) FILTER (wrong) FROM breaks WHERE axis = 'level'
  UNION ALL SELECT 'latitudes_ascending', count(*) FILTER (wrong) FROM breaks WHERE axis = 'lat'
  UNION ALL SELECT 'longitudes_ascending', count(*) FILTER (wrong) FROM breaks WHERE axis = 'lon'
  UNION ALL SELECT 'temperature_in_kelvin', 0
  UNION ALL SELECT 'time_regular', count(DISTINCT gap) - 1 FROM gaps)
SELECT rule, n_bad = 0 AS ok, n_bad FROM rules""",
        "time_regularity": HOURLY_VALUES + """
SELECT count(*) AS n_times, count(DISTINCT gap) <= 1 AS regular
FROM (SELECT lead(time) OVER (ORDER BY time) - time AS gap FROM hours)""",
        "top_bottom_weight": BASE + f""", {cells(LEVEL).strip()}
SELECT time, lat_id, lon_id, CASE WHEN sp > 70000 THEN 1::DOUBLE ELSE 0::DOUBLE END AS W_top,
       CASE WHEN sp > 90000 THEN 1::DOUBLE ELSE 0::DOUBLE END AS W_bottom
FROM dom WHERE level_id = 0""",
        "wall_weight": _wall_weight(CLIPPED),
        "wall_weight_overflow": _wall_weight(SURFACE),
        "wall_weight_level": _wall_weight(LEVEL),
        "volume_weight": _volume_weight(CLIPPED),
        "volume_weight_overflow": _volume_weight(SURFACE),
        "volume_weight_level": _volume_weight(LEVEL),
        "domain_volume": dom_vol + f" SELECT time, {rnd('volume / 1e15', 'volume')} FROM vol",
        "domain_mean_t": dom_vol + f" SELECT time, {rnd('mean_t', 'T_domain_avg')} FROM vol",
        "heat_storage": bud + f" SELECT time, {kh('ddt', 'd_dt_T')} FROM bud",
        "adiabatic": dom_vol + f" SELECT time, {kh('adiabatic', 'adiabatic_heating')} FROM vol",
        "centered_diff": HOURLY_VALUES + f"""
SELECT time, {rnd("(next - prev) / seconds * 3600", "dvalue_dt", 9)} FROM (
  SELECT time, lead(value) OVER o AS next, lag(value) OVER o AS prev,
         date_diff('second', lag(time) OVER o, lead(time) OVER o) AS seconds
  FROM hours WINDOW o AS (ORDER BY time)) WHERE seconds IS NOT NULL""",
        "rolling_24h": HOURLY_VALUES + f"""
SELECT time, {rnd("CASE WHEN count(value) OVER f = 24 THEN avg(value) OVER f END", "value", 9)} FROM hours
WINDOW f AS (ORDER BY time ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING)""",
        "running_integral": HOURLY_VALUES + f"""
SELECT time, {rnd("sum(value * 3600) OVER (ORDER BY time ROWS UNBOUNDED PRECEDING) / 1e6", "integral", 9)} FROM hours""",
        "daily_rollup": HOURLY_VALUES + f"""
SELECT date_trunc('day', time)::TIMESTAMP AS day, {rnd("avg(value)", "mean_value", 9)}, {rnd("sum(value * 2)", "total", 9)}
FROM hours GROUP BY 1""",
        "surface_mask": BASE + "," + cells(SURFACE) + """
SELECT time, count(*) FILTER (ground_case = 'A') AS n_untouched, count(*) FILTER (ground_case = 'B') AS n_below_middle,
       count(*) FILTER (ground_case = 'C') AS n_above_middle,
       count(*) FILTER (level_id = 0 AND sp >= p_start) AS n_overflow
FROM cells GROUP BY time""",
        "surface_blend": BASE + "," + cells(SURFACE_BLENDED) + f"""
SELECT time, level_id, lat_id, lon_id, {rnd("temp_f / 273.15::DOUBLE", "T_ratio", 10)},
       {rnd("u_f * 900 / 463", "u_knots", 10)}, {rnd("v_f * 900 / 463", "v_knots", 10)} FROM cells""",
        "surface_share": BASE + "," + cells(SURFACE) + f""", cols AS (
  SELECT time, lat_id, lon_id, any_value(sp) AS sp, count(*) FILTER (ground_case <> 'A') AS n FROM cells GROUP BY ALL)
SELECT {rnd("avg((n > 0)::INTEGER) * 100", "pct_columns")},
       {rnd("avg((n > 0)::INTEGER) FILTER (sp > 70000) * 100", "pct_active")}, max(n)::INTEGER AS max_layers FROM cols""",
        "wall_faces": through_walls(SURFACE) + f"""
SELECT time, wall, level_id, along_id, {rnd("flow", "flow", 10)}, {rnd("temp", "T", 10)} FROM faces""",
        "top_face": BASE + "," + cells(SURFACE) + f"""
SELECT time, lat_id, lon_id, {rnd("w", "w", 10)}, {rnd("temp", "T", 10)} FROM dom WHERE level = 70000""",
        "top_flux": BASE + "," + cells(SURFACE) + f"""
SELECT time, {rnd("sum(CASE WHEN sp > 70000 THEN w * area ELSE 0 END) / 1e9", "mass")},
       {rnd("sum(CASE WHEN sp > 70000 THEN w * temp * area ELSE 0 END) / 1e12", "heat")}
FROM dom WHERE level = 70000 GROUP BY time""",
        "wall_flux": bud + f" SELECT time, {wall_cols('heat', 'volume')}, {wall_cols('mass', 'volume')} FROM bud",
        "net_heat": bud + f" SELECT time, {kh('net_heat', 'net_heat_advection')} FROM bud",
        "net_mass": bud + f" SELECT time, {kh('net_mass', 'net_mass_advection')} FROM bud",
        "mass_residual": bud + f" SELECT {rnd('avg(fraction)', 'mean_fraction')}, {rnd('max(fraction)', 'max_fraction')} FROM bud",
        "mass_residual_hourly": bud + f" SELECT time, {rnd('fraction', 'abs_mass_advection_residual_fraction')} FROM bud",
        "t_scale": bud + f" SELECT {rnd('t_scale', 'T_scale')} FROM spread",
        "advection_error": bud + f" SELECT time, {kh('err', 'advection_error')} FROM bud",
        "diabatic": bud + f" SELECT time, {kh('diab', 'diabatic_term')} FROM bud",
        "budget": _budget(SURFACE),
        "budget_clipped": _budget(CLIPPED),
        "budget_level": _budget(LEVEL),
        "budget_blended": _budget(SURFACE_BLENDED),
        "budget_level_blended": _budget(LEVEL_BLENDED),
        "constant_t": _constant_t(),
        "constant_t_budget": _constant_t_budget(),
        "mass_continuity": bud + f""" SELECT time, {rnd("dv / 1e9", "dV_dt")}, {rnd("net_mass / 1e9", "net_mass_advection")},
{rnd("max(greatest(abs(dv), abs(net_mass))) OVER () / 1e9", "plot_limit")} FROM bud""",
        "quantile_residual": _quantiles(),
        "mass_series": bud + f" SELECT time, {kh('dm', 'delta_mass', 'mean_volume')},"
                             f" {kh('net_mass', 'net_mass_advection', 'mean_volume')}, {kh('dv', 'dV_dt', 'mean_volume')} FROM bud",
        "mass_cumulative": bud + " SELECT time, " + ", ".join(
            rnd(f"sum({e} * {STEP}) {RUN_TO} / mean_volume", f"cumulative_{n}")
            for n, e in (("delta_mass", "dm"), ("net_mass_advection", "net_mass"), ("dV_dt", "dv"))) + " FROM bud",
        "mass_error": bud + f" SELECT time, {rnd('abs(dm) / (' + ' + '.join(f'abs(mass_{w})' for w in SURFACE.walls) + ')', 'mass_error')} FROM bud",
        "mass_error_whole_run": bud + f""" SELECT time, {rnd("abs(dm) / (SELECT sum(abs(net_heat) + abs(net_mass) + abs(fraction) + " + " + ".join(f"abs(mass_{w})" for w in SURFACE.walls) + ") FROM bud)", "mass_error", 9)} FROM bud""",
        "mass_direction": _mass_direction(),
        "mass_direction_cumulative": _mass_direction_cumulative(),
        "heat_walls": bud + f" SELECT time, {wall_cols('heat', 'volume')}, {kh('net_heat', 'net_heat')}, {kh('err', 'expected_residual')} FROM bud",
        "storage_forms": bud + f" SELECT time, {kh('ddt', 'd_dt_T')}, {kh('st2', 'dT_dt_2')}, {kh('st', 'dT_dt')} FROM bud",
        "hourly_view": _hourly(1),
        "hourly_view_24h": _hourly(24),
        "daily_view": _daily(),
        "closure": bud + f""" SELECT time, {kh("st", "dT_dt")}, {kh("-net_heat + adiabatic + diab", "dT_dt_from_terms")},
{rnd("(-net_heat + adiabatic + diab) * 3600 / volume - st * 3600 / volume", "gap")} FROM bud""",
    }
    out["quality_report_columns"] = """
WITH have AS (SELECT CASE column_name WHEN 'ts' THEN 'time' ELSE column_name END AS name FROM information_schema.columns WHERE table_name = 'events'),
need AS (SELECT 'dimensions_present' AS rule, unnest(['time', 'level', 'lat', 'lon', 'time', 'lat', 'lon']) AS name
         UNION ALL SELECT 'variables_present', unnest(['T', 'u', 'v', 'w', 'sp']))
SELECT rule, count(*) = 0 AS ok, count(*) AS n_bad
FROM need WHERE name NOT IN (SELECT name FROM have) GROUP BY rule"""
    out["request_refusals"] = "WITH" + GRID + """,
asked(run, south, north, west, east, margin, top, bottom) AS (VALUES
  ('good', 40, 60, -130, -110, 1, 70000, NULL), ('south', 39, 60, -130, -110, 1, 70000, NULL), ('north', 40, 60.5, -130, -110, 1, 70000, NULL),
  ('west', 40, 60, -131, -110, 1, 70000, NULL), ('east', 40, 60, -130, -109, 1, 70000, NULL), ('thin', 42, 48, -130, -110, 1, 70000, NULL),
  ('margin', 40, 60, -130, -110, 2, 70000, NULL), ('deep', 40, 60, -130, -110, 1, 70000, 110000), ('high', 40, 60, -130, -110, 1, 60000, 90000),
  ('upside_down', 40, 60, -130, -110, 1, 90000, 80000)),
size AS (SELECT min(lat) AS lat0, max(lat) AS lat1, min(lon) AS lon0, max(lon) AS lon1, min(level) AS p0, max(level) AS p1,
                count(DISTINCT lat) AS n_lat, count(DISTINCT lon) AS n_lon FROM grid),
starts AS (SELECT DISTINCT lat AS a, lat + 5 AS b FROM grid),
touched AS (SELECT run, count(*) AS n FROM asked JOIN starts ON b > south AND a < north JOIN size ON a < lat1 GROUP BY run)
SELECT run, CASE WHEN least(n_lat, n_lon) - 1 - 2 * margin <= 0 THEN 'margin is too large for this grid'
                 WHEN south < lat0 OR north > lat1 THEN 'requested latitude range is outside the grid'
                 WHEN west < lon0 OR east > lon1 THEN 'requested longitude range is outside the grid'
                 WHEN bottom NOT BETWEEN p0 AND p1 THEN 'requested bottom pressure is outside the level range'
                 WHEN bottom IS NOT NULL AND top NOT BETWEEN p0 AND p1 THEN 'requested top pressure is outside the level range'
                 WHEN top >= bottom THEN 'the top pressure must be less than the bottom pressure'
                 WHEN n - 2 * margin < 1 THEN 'domain too small after snapping to cells and applying the margin' END AS reason
FROM asked JOIN touched USING (run), size"""
    out["merge_twins"] = "WITH" + GRID + f" SELECT time, level, lat, lon, {fields9} FROM grid"
    out["merge_clashes"] = "WITH" + GRID + f""",
w3 AS (SELECT e, CASE WHEN e % 97 = 5 THEN w + 1 WHEN e % 89 <> 3 THEN w END AS w FROM grid WHERE e % 101 <> 7),
pair AS (SELECT grid.*, w3.w AS other FROM grid LEFT JOIN w3 USING (e))
SELECT time, level, lat, lon, 'w' AS variable, {rnd("least(w, other)", "low", 10)}, {rnd("greatest(w, other)", "high", 10)},
       CASE WHEN other IS NULL THEN 'second' ELSE 'second,third' END AS holders
FROM pair WHERE w IS DISTINCT FROM other
UNION ALL
SELECT time, level, lat, lon, name, {rnd("value", "low", 10)}, {rnd("value", "high", 10)}, holders
FROM (SELECT time, level, lat, lon, 'T' AS name, temp AS value, 'first,second' AS holders FROM grid WHERE e % 211 = 9
      UNION ALL SELECT time, level, lat, lon, 'u', u, 'first' FROM grid WHERE e % 211 = 9)"""
    # the same grid with missing values; the sum over no value is 0
    holed = _budget(SURFACE_BLENDED)
    for field, tail in (("300 - 8 * ((event_id // 25) % 4) + value / 64", "temp"), ("((event_id * 7919) % 1009) / 100 - 5::DOUBLE", "u"),
                        ("((event_id * 104729) % 997) / 100 - 5::DOUBLE", "v"), ("((event_id * 1299709) % 883) / 4000 - 0.1::DOUBLE", "w")):
        holed = holed.replace(f"{field} AS {tail},", f"CASE WHEN event_id % 13 <> 4 AND (event_id // 100) % 17 <> 6 THEN {field} END AS {tail},")
    holed = holed.replace("285 + value / 32 AS t2m, u / 2 AS u10, v / 2 AS v10", "285 + value / 32 AS t2m,"
                          " (((e * 7919) % 1009) / 100 - 5::DOUBLE) / 2 AS u10, (((e * 104729) % 997) / 100 - 5::DOUBLE) / 2 AS v10")
    for inner in ("sum(temp * air)", "sum(flow * (temp - mean_t) * area * weight)", "sum(flow * area * weight)",
                  f"sum(w * {HEATING} * temp / level / {CP} * air)", f"sum(w * {HEATING} / level / {CP} * air)"):
        holed = holed.replace(inner, f"coalesce({inner}, 0)")
    out["budget_gaps"] = holed
    out["budget_many"] = " UNION ALL ".join(
        f"SELECT '{run}' AS run, * FROM ({_budget(v).replace(AXES, ','.join([LEVELS, _axis('lat', *bbox[:2]), _axis('lon', *bbox[2:])]))})"
        for run, v, bbox in (
            ("whole", SURFACE, (40, 60, -130, -110)), ("south", SURFACE, (40, 55, -130, -110)),
            ("north_west", Variant(top=80000.0), (45, 60, -130, -115)),
            ("raised", LEVEL, (40, 60, -130, -110)), ("raised_east", LEVEL, (40, 60, -125, -110))))
    for same, of in (("quality_report_stored", "quality_report"), ("budget_cropped", "budget"), ("budget_incremental", "budget"), ("budget_stored", "budget"), ("budget_stored_blended", "budget_blended"), ("budget_appended", "budget"),
                     ("budget_written", "budget"), ("budget_checked", "budget")):
        out[same] = out[of]
    return out
