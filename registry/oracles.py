"""The same results in plain SQL, written independently of the library."""

from __future__ import annotations

from emberline.functions.numeric import T975, Z975
from emberline.sources.rules import PROJECT_RULES

from .standins import FIRES, OBS, POLYS


def _value(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    return "'" + str(v).replace("'", "''") + "'"


SQUISH = "trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
NUM = "regexp_replace(regexp_replace(cast(cast({c} as decimal(28,12)) as varchar), '0+$', ''), '\\.$', '')"

COUNT = """case when unique_project_id in ('UP_030', 'UP_070') then round_even(response_value * survey_effort_traps, 0)
                    when unique_project_id = 'UP_040' then round_even(response_value * (survey_area / 1000), 0)
                    when unique_project_id in ('UP_068', 'UP_082') then try_cast(response_variable_text as double)
                    when unique_project_id = 'UP_069' then response_value * 2 else response_value end"""

# Named stages, each built on those before it.
STAGES = {
    "obs": OBS,
    "polys": POLYS,
    "fires": FIRES,
    "rules": "select * from (values "
    + ", ".join("(" + ", ".join(_value(v) for v in row) + ")" for row in PROJECT_RULES)
    + ") as t(unique_project_id, include_pa, include_abundance, effort_variable, effort_use_type, response_type)",
    "lab": f"select *, {SQUISH.format(c='before_after')} as before_after_clean, "
    f"{SQUISH.format(c='burnt_unburnt')} as burnt_unburnt_clean from obs",
    "st": """select *, case when fire = 'Unburnt' then 'Unburnt/None' when fire = 'Burnt' then fire_severity end as fire_severity_clean,
                    fire as burn_status_clean, fire = 'Burnt' as eligible_fire_speed,
                    before_after_clean = 'Before Fire' as is_before, before_after_clean = 'After Fire' as is_after
             from (select *, case when before_after_clean = 'Before Fire' then 'Unburnt'
                                  when before_after_clean = 'After Fire' and burnt_unburnt_clean in ('Burnt', 'Unburnt') then burnt_unburnt_clean
                             end as fire from lab) as a""",
    "keyed": "select *, concat_ws('__', coalesce(unique_project_id, 'NA'), coalesce(site_name, 'NA'), coalesce(burn_status_clean, 'NA'), "
    f"coalesce({NUM.format(c='round_even(latitude, 5)')}, 'NA'), coalesce({NUM.format(c='round_even(longitude, 5)')}, 'NA')) as fired_key from st",
    "points": "select distinct fired_key, cast(px as double) as x, cast(py as double) as y from keyed where eligible_fire_speed",
    "season": "select * from polys where date_day between date '2019-06-01' and date '2020-05-31'",
    "pairs": """select p.fired_key, q.* from points p join season q
                on p.x between q.cx - q.r and q.cx + q.r and p.y between q.cy - q.r and q.cy + q.r
                and abs(p.x - q.cx) + abs(p.y - q.cy) <= q.r""",
    "burn": """select fired_key, date_day as burn_date, id as fire_id, did, fsr_km2_dy, dy_ar_km2, 'intersect' as match_type
               from (select *, row_number() over (partition by fired_key order by date_day, fsr_km2_dy desc nulls last,
                                                  dy_ar_km2 desc nulls last, poly_ord) as rn from pairs) as a where rn = 1""",
    "free": "select * from points where fired_key not in (select fired_key from burn)",
    "dist": """select fired_key, q.*, case when dx - dy > r then sqrt((dx - r) * (dx - r) + dy * dy)
                                           when dy - dx > r then sqrt(dx * dx + (dy - r) * (dy - r))
                                           else (dx + dy - r) / sqrt(2) end as d
               from (select p.fired_key, abs(p.x - q.cx) as dx, abs(p.y - q.cy) as dy, q.* from free p join season q
                     on p.x between q.cx - q.r - 1000 and q.cx + q.r + 1000 and p.y between q.cy - q.r - 1000 and q.cy + q.r + 1000) as q""",
    "near": """select fired_key, date_day as burn_date, id as fire_id, did, fsr_km2_dy, dy_ar_km2, 'nearest_1km' as match_type, d as nearest_dist_m
               from (select *, row_number() over (partition by fired_key order by d, date_day, fsr_km2_dy desc nulls last,
                                                  dy_ar_km2 desc nulls last, poly_ord) as rn from dist where d <= 1000) as a where rn = 1""",
    "metrics": """select *, cast(null as double) as nearest_dist_m from burn union all select * from near""",
    "matched0": """select keyed.*, m.date_day as burn_date, m.fsr_km2_dy, case when m.poly_ord % 5 <> 0 then m.dy_ar_km2 end as dy
                   from keyed left join polys m on keyed.order_key = m.poly_ord""",
    "matched": """select *, case when eligible_fire_speed is null then null when eligible_fire_speed then dy end as fire_speed,
                         eligible_fire_speed and dy is not null as has_fire_speed,
                         case when eligible_fire_speed then cast(date_survey - burn_date as int) end as days_raw
                  from matched0""",
    "ruled": "select o.*, g.include_pa, g.include_abundance, g.response_type from lab o left join rules g using (unique_project_id)",
    "counted": f"select *, {COUNT} as response_count from ruled",
    "good": f"""select *, {COUNT} as response_count
               from (select m.*, concat_ws('__', m.unique_project_id, coalesce(site_name, 'NA')) as site_id,
                            case when is_before then 'Before' when burn_status_clean = 'Burnt' then 'After_Burnt' else 'After_Unburnt' end as study_design,
                            g.include_pa, g.include_abundance, g.response_type
                     from matched m left join rules g using (unique_project_id) where burn_status_clean is not null) as a
               where (include_pa or include_abundance)
                 and (unique_project_id <> 'UP_008' or lower(response_variable_text) like '%alive%')
                 and (unique_project_id <> 'UP_010' or regexp_matches(lower(response_variable_text), 'all plants|mature|juvenile'))
                 and (unique_project_id <> 'UP_062' or response_variable_text = 'nest occupancy and reproduction')
                 and not (unique_project_id in ('UP_010', 'UP_079') and include_pa and survey_effort_hours is null)
                 and (not eligible_fire_speed or has_fire_speed)""",
    "pos": """select *, mx_grw_km2 * 100 as g, tot_ar_km2 * 100 as s from fires where mx_grw_km2 * 100 > 0 and tot_ar_km2 * 100 > 0""",
}

# The same with fires attached by place instead of by order number.
STAGES["linked0"] = "select keyed.*, m.burn_date, m.fsr_km2_dy, m.dy_ar_km2 as dy, m.match_type from keyed left join metrics m on keyed.fired_key = m.fired_key"
STAGES["linked"] = STAGES["matched"].replace("matched0", "linked0")
STAGES["clean"] = STAGES["good"].replace("from matched m", "from linked m")

PRESENCE = """case when response_type in ('binary', 'binary_raw') then cast(response_value > 0 as int)
                   else cast(coalesce(response_count > 0, false) as int) end"""


def with_stages(names: str, sql: str) -> str:
    return "with " + ", ".join(f"{n} as ({STAGES[n]})" for n in names.split()) + " " + sql


def t975(n: str) -> str:
    z = Z975
    terms = [
        repr(z),
        f"{(z**3 + z) / 4!r} / ({n})",
        f"{(5 * z**5 + 16 * z**3 + 3 * z) / 96!r} / power({n}, 2)",
        f"{(3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384!r} / power({n}, 3)",
        f"{(79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160!r} / power({n}, 4)",
    ]
    table = "[" + ", ".join(repr(v) for v in T975) + "]"
    return f"(case when ({n}) between 1 and 30 then ({table})[cast(({n}) as int)] when ({n}) > 30 then {' + '.join(terms)} end)"


MATCH = "obs lab st keyed points polys season pairs burn"
NEAR = MATCH + " free dist near"
FULL = NEAR + " metrics"
DONE = "obs polys lab st keyed matched0 matched rules good"

SCALE_COLS = {
    "survey_effort_hours": "hours_z", "survey_effort_traps": "traps_z", "survey_area": "area_z",
    "response_value": "response_z", "ts_fire": "ts_fire_z", "unburnt5": "unburnt5_z",
    "mean_temp_final": "mean_temp_z", "mean_rainfall_final": "mean_rainfall_z",
    "drought_spi_final": "drought_spi_z", "disturb_landuse_final_5km_pc_naturalenv": "natural_env_5km_z",
}


def z(c: str) -> str:
    return f"(({c}) - avg({c}) over ()) / nullif(stddev_samp({c}) over (), 0)"


def describe_sql() -> str:
    parts = [
        f"select '{c}' as column_name, count(*) as n_rows, count({c}) as n_values, count(distinct {c}) as n_distinct, "
        f"cast(min({c}) as varchar) as min_value, cast(max({c}) as varchar) as max_value from obs"
        for c in ("unique_project_id", "site_name", "px", "fire_severity", "date_survey")
    ]
    return with_stages("obs", " union all ".join(parts))


def five_number_sql() -> str:
    parts = [
        f"select '{c}' as column_name, round_even(min({c}), 6) as min, round_even(quantile_cont({c}, 0.25), 6) as q1, "
        f"round_even(quantile_cont({c}, 0.5), 6) as median, round_even(avg({c}), 6) as mean, round_even(quantile_cont({c}, 0.75), 6) as q3, "
        f"round_even(max({c}), 6) as max, count(*) - count({c}) as n_missing from obs"
        for c in ("response_value", "unburnt5", "drought_spi_final")
    ]
    return with_stages("obs", " union all ".join(parts))


def mean_ci_sql(by: bool) -> str:
    extra = "" if by else ", min(g) as mn, max(g) as mx"
    inner = f"select {'lc_name, ' if by else ''}count(*) as n, avg(g) as mean, stddev_samp(g) as sd{extra} from pos {'group by lc_name' if by else ''}"
    half = f"{t975('n - 1')} * sd / sqrt(n)"
    return with_stages(
        "fires pos",
        f"select {'lc_name, ' if by else ''}n, round_even(mean, 6) as mean, round_even(sd, 6) as sd, round_even(sd / sqrt(n), 6) as se, "
        f"round_even({half}, 6) as ci95, round_even(mean - {half}, 6) as lower_ci, round_even(mean + {half}, 6) as upper_ci, "
        + ("cast(row_number() over (order by mean desc, lc_name) as int) as class_rank" if by else "round_even(mn, 6) as min, round_even(mx, 6) as max")
        + f" from ({inner}) as a",
    )


def hist_sql() -> str:
    def one(name: str, part: str, group: str) -> str:
        return (
            f"select {name} as lc_name, cast(floor((v - lo) / w + 0.5) as int) as bin, count(*) as n, "
            f"round_even(min(lo + floor((v - lo) / w + 0.5) * w), 6) as center from b group by {group}2"
        )

    return with_stages(
        "fires pos",
        ", a as (select lc_name, log10(g) as v from pos), l as (select min(v) as lo, (max(v) - min(v)) / 49 as w from a), "
        "b as (select * from a cross join l) "
        + one("lc_name", "", "1, ") + " union all " + one("'all'", "", "1, "),
    )


def effort_sql() -> str:
    def one(name: str, cases: str) -> str:
        return (
            f"round_even(case when e.{name} is null or e.{name} <= 0 then 1.0 else e.{name} end, 9) as {name}",
            f"cast(case {cases} else 1 end as double) as {name}",
        )

    p = "unique_project_id"
    hours, traps, area = "survey_effort_hours", "survey_effort_traps", "survey_area"
    cols = [
        one("effort_offset_abundance",
            f"when {p} in ('UP_005', 'UP_065', 'UP_068') then {area} when {p} = 'UP_007' then {hours} "
            f"when {p} = 'UP_040' then {area} / 1000 when {p} in ('UP_070', 'UP_082', 'UP_083') then {traps}"),
        one("effort_covariate_abundance", f"when {p} in ('UP_010', 'UP_011', 'UP_067') then {hours}"),
        one("effort_covariate2_abundance", f"when {p} in ('UP_010', 'UP_011') then {area}"),
        one("effort_covariate_pa",
            f"when {p} in ('UP_018', 'UP_031', 'UP_066', 'UP_067', 'UP_079', 'UP_007', 'UP_010', 'UP_011') then {hours} "
            f"when {p} in ('UP_020', 'UP_021', 'UP_030', 'UP_060', 'UP_070', 'UP_082', 'UP_083') then {traps} "
            f"when {p} = 'UP_040' then {area} / 1000 when {p} in ('UP_005', 'UP_065', 'UP_068') then {area}"),
        one("effort_covariate2_pa", f"when {p} in ('UP_010', 'UP_011') then {area}"),
    ]
    return with_stages(
        "obs",
        "select row_ord, " + ", ".join(c[0] for c in cols)
        + " from (select row_ord, " + ", ".join(c[1] for c in cols) + " from obs) as e",
    )


def burnt_sql(kind: str = "pa") -> str:
    """z-scores over the whole clean table; two of them again over the burnt rows."""
    sev = "fire_severity_clean"
    y, own = (PRESENCE, "y is not null") if kind == "pa" else ("cast(round_even(response_count, 0) as int)", "y >= 0")
    return with_stages(
        DONE,
        f""", m as (select *, {y} as y,
                      {z('ln(case when eligible_fire_speed and fire_speed > 0 then fire_speed end)')} as fire_speed_z,
                      {z('ln(1 + case when eligible_fire_speed then greatest(days_raw, 0) end)')} as days_since_fire_z,
                      coalesce(broad_taxon, '') as bt from good),
             c as (select *, count(*) over (partition by broad_taxon) as nt from m
                   where include_{kind} and {own} and species is not null and broad_taxon is not null and ecosystem_group is not null),
             b as (select *, case {sev} when 'Low (burnt understory, unburnt canopy)' then 1 when 'Moderate (partial canopy scorch)' then 2
                                    when 'High (full canopy scorch)' then 3 when 'Extreme (full canopy consumption)' then 4 end as code
                   from c where study_design = 'After_Burnt' and fire_speed_z is not null and days_since_fire_z is not null)
             select row_ord, y as model_response, code as fire_severity_code, case when nt < 100 then 'Other' else broad_taxon end as broad_taxon,
                    round_even(fire_speed_z, 6) as fire_speed_z, round_even(days_since_fire_z, 6) as days_since_fire_z,
                    round_even({z('ln(1 + unburnt5)')}, 6) as unburnt5_z, round_even({z('drought_spi_final')}, 6) as drought_spi_z
             from b where code is not null""",
    )


def design_sql() -> str:
    sev = ["Moderate (partial canopy scorch)", "High (full canopy scorch)", "Extreme (full canopy consumption)"]
    eco = [f"eco {i}" for i in range(1, 5)]
    cols = ["cast(1 as double)", "unburnt5"]
    cols += [f"cast(fire_severity = '{s}' as double)" for s in sev]
    cols += [f"cast(ecosystem_group = '{e}' as double)" for e in eco]
    cols += [f"unburnt5 * cast(ecosystem_group = '{e}' as double)" for e in eco]
    return with_stages(
        "obs",
        "select row_ord, response_value as y, " + ", ".join(f"{c} as x{i}" for i, c in enumerate(cols))
        + " from obs where response_value is not null and unburnt5 is not null and fire_severity in ("
        + ", ".join(f"'{s}'" for s in ["Low (burnt understory, unburnt canopy)", *sev])
        + ") and ecosystem_group in ('eco 0', 'eco 1', 'eco 2', 'eco 3', 'eco 4')",
    )


OLS = ", a as (select ln(g) as x, ln(s) as y from pos), f as (select regr_intercept(y, x) as b0, regr_slope(y, x) as b1, regr_r2(y, x) as r2, count(*) as n, avg(x) as mx, regr_sxx(y, x) as sxx, regr_syy(y, x) as syy, regr_sxy(y, x) as sxy, min(x) as lo, max(x) as hi from a) "

ORACLES = {
    "scan_survey": with_stages("obs", """
        select unique_project_id, site_name, trim(burnt_unburnt) as burnt_unburnt, date_text as date_survey, latitude, response_value,
               survey_effort_hours, ts_fire, no_fires, response_variable_text from obs"""),
    "scan_polygons": with_stages("polys", """
        select poly_ord, 1 as n_parts, 5 as n_vertices, cast(cx as double) as second_x, cast(cy + r as double) as second_y,
               cast(cx - r as double) as xmin, cast(cy - r as double) as ymin, cast(cx + r as double) as xmax, cast(cy + r as double) as ymax from polys"""),
    "describe": describe_sql(),
    "rules": with_stages("obs rules", """
        select rules.*, n_rows from rules left join (select unique_project_id, count(*) as n_rows from obs group by 1) as n using (unique_project_id)"""),
    "roundtrip": with_stages("obs lab st keyed", """
        select unique_project_id, 2 * count(*) as n, 2 * count(site_name) as n_site, count(distinct fired_key) as n_keys,
               round_even(2 * sum(response_value), 3) as total, max(date_survey) as last_day from keyed group by 1"""),
    "derive": with_stages("obs", """
        select row_ord, mean_temp_final as mean_temp_model,
               round_even((case when unique_project_id = 'UP_056' then cast(0.000014 as double) else survey_area end) / 1000 * (survey_effort_traps + 1), 9) as effort from obs"""),
    "select_cols": with_stages("obs", "select unique_project_id, species, fire_severity from obs"),
    "complete_cases": with_stages("obs", """
        select row_ord, site_name, response_value from obs
        where site_name is not null and survey_effort_hours is not null and response_value > 2 and latlongres = 'original'"""),
    "time_window": with_stages("fires polys", """
        select 'fires' as source, ig_date as day, count(*) as n from fires where ig_date between date '2024-01-05' and date '2024-01-20' group by 2
        union all select 'polys', date_day, count(*) from polys where date_day >= date '2019-06-01' and date_day <= date '2020-05-31' group by 2"""),
    "membership": with_stages("obs", "select row_ord, coalesce(response_variable_text in ('1', '2', 'n/a'), false) as hit from obs"),
    "rule_filter": with_stages("obs lab rules ruled", """
        select row_ord, unique_project_id, response_variable_text from ruled where (include_pa or include_abundance)
          and (unique_project_id <> 'UP_008' or lower(response_variable_text) like '%alive%')
          and (unique_project_id <> 'UP_010' or regexp_matches(lower(response_variable_text), 'all plants|mature|juvenile'))
          and (unique_project_id <> 'UP_062' or response_variable_text = 'nest occupancy and reproduction')"""),
    "required_effort": with_stages("obs lab rules ruled", """
        select row_ord, unique_project_id, survey_effort_hours from ruled
        where include_pa and (unique_project_id not in ('UP_010', 'UP_079') or survey_effort_hours is not null)"""),
    "matched_only": with_stages("obs polys lab st keyed matched0 matched", """
        select row_ord, eligible_fire_speed, round_even(fire_speed, 6) as fire_speed from matched
        where eligible_fire_speed = false or (eligible_fire_speed and dy is not null)"""),
    "positive_rows": with_stages("obs", """
        select row_ord, round_even(survey_effort_traps, 6) as traps from obs where survey_effort_hours > 0 and survey_effort_traps > 0"""),
    "pip_join": with_stages("obs lab st keyed points polys season pairs", "select fired_key, poly_ord, date_day from pairs"),
    "pip_best": with_stages("obs lab st keyed points polys season pairs", """
        select fired_key, date_day, id, did, cast(fsr_km2_dy as bigint) as fsr_km2_dy, round_even(dy_ar_km2, 6) as dy_ar_km2, poly_ord
        from (select *, row_number() over (partition by fired_key, date_day order by fsr_km2_dy desc nulls last, dy_ar_km2 desc nulls last, poly_ord) as rn
              from pairs) as a where rn = 1"""),
    "first_burn": with_stages(MATCH, """
        select fired_key, burn_date, fire_id, did, cast(fsr_km2_dy as bigint) as fsr_km2_dy, round_even(dy_ar_km2, 6) as dy_ar_km2, match_type from burn"""),
    "nearest_within": with_stages(NEAR, """
        select fired_key, burn_date, fire_id, did, cast(fsr_km2_dy as bigint) as fsr_km2_dy, round_even(dy_ar_km2, 6) as dy_ar_km2, match_type,
               round_even(nearest_dist_m, 6) as nearest_dist_m from near"""),
    "nearest_any": with_stages(MATCH + " free", """
        select fired_key, round_even(min(case when dx - dy > r then sqrt((dx - r) * (dx - r) + dy * dy) when dy - dx > r then sqrt(dx * dx + (dy - r) * (dy - r))
                                              else (dx + dy - r) / sqrt(2) end), 6) as nearest_dist_m
        from (select fired_key, abs(p.x - q.cx) as dx, abs(p.y - q.cy) as dy, r from free p, season q) as a group by fired_key"""),
    "unmatched": with_stages(MATCH + " free", "select fired_key from free"),
    "union_matches": with_stages(FULL, """
        select fired_key, burn_date, fire_id, did, cast(fsr_km2_dy as bigint) as fsr_km2_dy, round_even(dy_ar_km2, 6) as dy_ar_km2, match_type,
               round_even(nearest_dist_m, 6) as nearest_dist_m from metrics"""),
    "join_metrics": with_stages(FULL, """
        select row_ord, keyed.fired_key, burn_date, did, match_type from keyed left join metrics on keyed.fired_key = metrics.fired_key"""),
    "join_rules": with_stages("obs lab rules ruled", "select row_ord, unique_project_id, include_pa, response_type from ruled"),
    "missing_rules": with_stages("obs rules", """
        select distinct unique_project_id, project_name from obs where unique_project_id not in (select unique_project_id from rules)"""),
    "event_area_join": with_stages("fires polys", """
        select f.row_ord, f.id, a.ha as fire_size_ha from fires f
        left join (select id, round_even(sum(2.0 * r * r / 10000), 4) as ha from polys group by id) as a on f.id = a.id"""),
    "p97_joinback": with_stages("fires pos", f"""
        select row_ord, pos.lc_name, round_even(p97, 6) as p97, concat(regexp_replace(cast(round_even(p97, 1) as varchar), '\\.0$', ''), ' ha/day') as label
        from pos join (select lc_name, quantile_cont(g, 0.97) as p97 from pos group by 1) as q on pos.lc_name = q.lc_name"""),
    "reproject": with_stages("obs", """
        select row_ord, round_even(6371007.181 * radians(longitude) * cos(radians(latitude)), 3) as x, round_even(6371007.181 * radians(latitude), 3) as y,
               round_even(longitude, 6) as lon, round_even(latitude, 6) as lat from obs"""),
    "point_seg_dist": with_stages("polys", """
        select poly_ord, round_even(case when dx + dy <= r then 0.0 when dx - dy > r then sqrt((dx - r) * (dx - r) + dy * dy)
                                         when dy - dx > r then sqrt(dx * dx + (dy - r) * (dy - r)) else (dx + dy - r) / sqrt(2) end, 6) as dist
        from (select *, abs(ig_utm_x - cx) as dx, abs(ig_utm_y - cy) as dy from polys) as a"""),
    "poly_area": with_stages("polys", "select poly_ord, round_even(2.0 * r * r / 10000, 6) as area_ha from polys"),
    "first_day_centroid": with_stages("polys", """
        select id, event_day, round_even(sum(cast(cx as double) * r * r) / sum(cast(r as double) * r), 6) as x,
               round_even(sum(cast(cy as double) * r * r) / sum(cast(r as double) * r), 6) as y, count(*) as n_polygons
        from (select *, min(event_day) over (partition by id) as first_day from polys) as a where event_day = first_day group by 1, 2"""),
    "ignition_point": with_stages("polys", """
        select id, ig_utm_x, ig_utm_y from (select *, row_number() over (partition by id order by event_day, poly_ord) as rn from polys) as a where rn = 1"""),
    "summary_all": with_stages("obs", """
        select count(*) as n, count(distinct unique_project_id) + max(cast(unique_project_id is null as int)) as n_projects,
               count(distinct site_name) + max(cast(site_name is null as int)) as n_sites, count(distinct species) + max(cast(species is null as int)) as n_species,
               min(date_survey) as first_day, max(date_survey) as last_day, round_even(avg(response_value), 6) as mean_response,
               round_even(max(response_value * 100), 6) as max_scaled from obs"""),
    "inspect_projects": with_stages("obs", """
        select *, coalesce(hours_min = hours_max, false) as hours_constant, coalesce(traps_min = traps_max, false) as traps_constant,
               coalesce(area_min = area_max, false) as area_constant, response_unique <= 2 as near_binary
        from (select unique_project_id, count(*) as n_rows, count(distinct site_name) + max(cast(site_name is null as int)) as n_sites,
                     min(survey_effort_hours) as hours_min, max(survey_effort_hours) as hours_max, min(survey_effort_traps) as traps_min,
                     max(survey_effort_traps) as traps_max, min(survey_area) as area_min, max(survey_area) as area_max,
                     min(response_value) as response_min, max(response_value) as response_max,
                     count(distinct response_value) + max(cast(response_value is null as int)) as response_unique from obs group by 1) as a"""),
    "count_by": with_stages("obs", "select unique_project_id, fire_severity, no_fires, count(*) as n_rows from obs group by 1, 2, 3"),
    "crosstab": with_stages("obs lab st", "select before_after_clean, fire_severity_clean, count(*) as n from st group by 1, 2"),
    "distinct_locations": with_stages("obs lab st keyed points", "select fired_key, x, y from points"),
    "dedupe_first": with_stages("obs lab st keyed", """
        select fired_key, date_survey, order_key, fire_severity from (select *, row_number() over (partition by fired_key
          order by date_survey nulls last, order_key desc nulls last, fire_severity nulls last) as rn from keyed) as a where rn = 1"""),
    "ndistinct_null": with_stages("obs", """
        select unique_project_id, count(distinct site_name) + max(cast(site_name is null as int)) as n_sites,
               count(distinct response_value) + max(cast(response_value is null as int)) as n_values from obs group by 1"""),
    "match_rate": with_stages(FULL, """
        select unique_project_id, count(*) as n_eligible_burnt_locations, count(fire_speed) as n_matched,
               round_even(count(fire_speed) / cast(count(*) as double), 6) as match_rate
        from (select distinct k.fired_key, k.unique_project_id, m.dy_ar_km2 as fire_speed from keyed k left join metrics m on k.fired_key = m.fired_key
              where k.eligible_fire_speed) as a group by 1"""),
    "missing_share": with_stages("obs polys lab st keyed matched0 matched", """
        select unique_project_id, count(*) as n_total, cast(sum(cast(not has_fire_speed as int)) as bigint) as n_missing,
               cast(sum(cast(has_fire_speed as int)) as bigint) as n_matched,
               round_even(sum(cast(not has_fire_speed as int)) / cast(count(*) as double), 6) as prop_missing
        from matched where eligible_fire_speed group by 1"""),
    "integer_check": with_stages("obs lab rules ruled counted", """
        select unique_project_id, count(*) as n, round_even(max(abs(response_count - round_even(response_count, 0))), 6) as max_diff_from_integer
        from counted where unique_project_id in ('UP_030', 'UP_040', 'UP_068', 'UP_069', 'UP_070', 'UP_082') group by 1"""),
    "event_area": with_stages("polys", "select id, round_even(coalesce(sum(dy_ar_km2), 0), 6) as fire_size_ha from polys group by 1"),
    "class_mean_ci": mean_ci_sql(True),
    "global_mean_ci": mean_ci_sql(False),
    "p97": with_stages("fires pos", """
        select lc_name, round_even(quantile_cont(g, 0.97), 6) as p97 from pos group by 1
        union all select 'all', round_even(quantile_cont(g, 0.97), 6) from pos"""),
    "exceedance": with_stages("fires pos", """
        select round_even(q, 6) as threshold, count(*) as n_total, cast(sum(cast(g > q as int)) as bigint) as n_above,
               round_even(sum(cast(g > q as int)) * 100.0 / count(*), 6) as percent_above
        from pos cross join (select quantile_cont(g, 0.97) as q from pos) as t group by q"""),
    "group_profile": with_stages("obs", """
        select unique_project_id, max(case when rn = 1 then survey_method end) as method, max(case when rn = 1 then species end) as first_species,
               min(response_value) as min_val, max(response_value) as max_val, count(*) as n
        from (select *, row_number() over (partition by unique_project_id order by row_ord, species, px, survey_method) as rn from obs) as a group by 1"""),
    "five_number": five_number_sql(),
    "mean_var": with_stages("obs", "select round_even(avg(response_value), 6) as mean, round_even(var_samp(response_value), 6) as variance from obs"),
    "prevalence": with_stages("obs", """
        select broad_taxon, count(survey_effort_traps) as n, round_even(avg(cast(survey_effort_traps = 0 as int)), 6) as prop_zero,
               round_even(avg(cast(survey_effort_traps > 0 as int)), 6) as prevalence from obs group by 1"""),
    "bin_peak": with_stages("fires pos", """
        select lc_name, max(n) as y from (
          select lc_name, greatest(1, least(50, ceil((g - lo) / w))) as bin, count(*) as n
          from pos cross join (select min(g) as lo, (max(g) - min(g)) / 50 as w from pos) as l group by 1, 2) as a group by 1"""),
    "hist_log10": hist_sql(),
    "loglog_ols": with_stages("fires pos", OLS + """
        select round_even(b0, 6) as intercept, round_even(b1, 6) as slope, round_even(r2, 6) as r2, n,
               round_even(1 - (1 - r2) * (n - 1) / cast(n - 2 as double), 6) as adj_r2 from f"""),
    "ols_band": with_stages("fires pos", OLS + f""",
        h as (select *, lo + i * (hi - lo) / 79 as lx from f cross join (select cast(range as int) as i from range(80)) as k),
        e as (select *, {t975('n - 2')} * sqrt(greatest(syy - sxy * sxy / sxx, 0) / (n - 2) * (1.0 / n + power(lx - mx, 2) / sxx)) as half from h)
        select i, round_even(lx, 6) as log_x, round_even(b0 + b1 * lx, 6) as fit, round_even(b0 + b1 * lx - half, 6) as lower,
               round_even(b0 + b1 * lx + half, 6) as upper from e""".replace(",\n        h as", ", h as")).replace("from a) , h", "from a), h"),
    "top100_flag": with_stages("fires", """
        select row_ord, lc_name, row_number() over (order by mx_grw_km2 desc nulls last, row_ord) <= 100 as top_100 from fires"""),
    "top5": with_stages("fires", """
        select row_ord, id, round_even(mx_grw_km2, 6) as mx_grw_km2 from fires order by fires.mx_grw_km2 desc nulls last, row_ord limit 5"""),
    "group_zscore": with_stages("obs", """
        select row_ord, broad_taxon, round_even(case when n >= 2 and sd > 0 then (response_value - m) / sd end, 6) as response_std
        from (select *, count(response_value) over w as n, avg(response_value) over w as m, stddev_samp(response_value) over w as sd
              from obs window w as (partition by unique_project_id, broad_taxon)) as a"""),
    "day_index": with_stages("polys", """
        select poly_ord, id, cast(dense_rank() over (partition by id order by event_day) as int) as day_index from polys"""),
    "event_growth": with_stages("polys", """
        select id, count(*) as n_rows, min(event_day) as first_day, max(event_day) as last_day, count(distinct event_day) as n_days,
               round_even(max(mx_grw_km2) * 100, 6) as mx_grw_ha, concat('Event ', cast(id as varchar)) as fire_name
        from polys where id in (1, 5, 7, 11, 101) group by id"""),
    "burn_status": with_stages("obs lab st", "select row_ord, burn_status_clean, eligible_fire_speed, fire_severity_clean from st"),
    "strict_if_else": with_stages("obs", """
        select row_ord, case when unique_project_id is null then null when unique_project_id = 'UP_056' then cast(0.000014 as double) else survey_area end as survey_area,
               case when response_value is null then null when response_value > 5 then 'many' else 'few' end as size_class from obs"""),
    "study_design": with_stages("obs lab st", """
        select row_ord, case when is_before then 'Before' when burn_status_clean = 'Burnt' then 'After_Burnt' else 'After_Unburnt' end as study_design,
               case when is_before then 1 when burn_status_clean = 'Burnt' then 3 else 2 end as study_design_code from st where burn_status_clean is not null"""),
    "gate_measures": with_stages("obs polys lab st keyed matched0 matched", """
        select row_ord, round_even(fire_speed, 6) as fire_speed, cast(case when eligible_fire_speed then fsr_km2_dy end as double) as growth,
               round_even(fire_speed, 6) as fire_daily_area_km2, has_fire_speed from matched"""),
    "rebuild_counts": with_stages("obs lab rules ruled counted", """
        select row_ord, unique_project_id, round_even(response_count, 6) as response_count from counted"""),
    "presence": with_stages("obs lab rules ruled counted", f"select row_ord, response_type, {PRESENCE} as response_pa from counted"),
    "effort": effort_sql(),
    "sentinel": with_stages("obs", "select row_ord, case when ts_fire <> 999 then ts_fire end as ts_fire_model from obs"),
    "levels": with_stages("obs", """
        select row_ord, case when no_fires in ('0', '1', '2+') then no_fires end as no_fires_model,
               case when fire_severity <> 'not recorded' then fire_severity end as severity,
               case left(fire_severity, 3) when 'Low' then 1 when 'Mod' then 2 when 'Hig' then 3 when 'Ext' then 4 end as severity_code from obs"""),
    "pa_table": with_stages(DONE, f"select row_ord, site_id, study_design, {PRESENCE} as model_response from good where include_pa"),
    "abundance_table": with_stages(DONE, """
        select row_ord, site_id, study_design, round_even(response_count, 0) as model_response from good where include_abundance"""),
    "burnt_tables": burnt_sql(),
    "burnt_tables_abundance": burnt_sql("abundance"),
    "master": with_stages(FULL + " linked0 linked", """
        select row_ord, concat_ws('__', unique_project_id, coalesce(site_name, 'NA')) as site_id,
               case when is_before then 'Before' when burn_status_clean = 'Burnt' then 'After_Burnt' else 'After_Unburnt' end as study_design,
               match_type, round_even(fire_speed, 6) as fire_speed, has_fire_speed, case when days_raw < 0 then 0 else days_raw end as days_since_fire,
               case when not eligible_fire_speed then 'Control_or_before' when days_raw < 0 then 'Near_fire_date' when days_raw = 0 then 'DayOf'
                    when days_raw > 0 then 'After' end as timing_rel_fire from linked where burn_status_clean is not null"""),
    "model_tables": with_stages(FULL + " linked0 linked rules clean", f"""
        select row_ord, 'pa' as kind, study_design, cast({PRESENCE} as double) as model_response from clean where include_pa
        union all select row_ord, 'abundance', study_design, cast(round_even(response_count, 0) as double) from clean where include_abundance"""),
    "match_summary": with_stages(FULL, """
        select unique_project_id, count(*) as n_eligible_burnt_locations, count(fire_speed) as n_matched,
               round_even(count(fire_speed) / cast(count(*) as double), 6) as match_rate
        from (select distinct k.fired_key, k.unique_project_id, m.dy_ar_km2 as fire_speed from keyed k left join metrics m on k.fired_key = m.fired_key
              where k.eligible_fire_speed) as a group by 1"""),
    "parse_dates": with_stages("obs", """
        select row_ord, date_text, cast(coalesce(try_strptime(date_text, '%m/%d/%Y'), try_strptime(date_text, '%d/%m/%Y'), try_strptime(date_text, '%Y-%m-%d')) as date) as day from obs"""),
    "days_since": with_stages("obs polys lab st keyed matched0 matched", """
        select row_ord, days_raw as days_since_fire_raw, case when days_raw < 0 then 0 else days_raw end as days_since_fire,
               case when not eligible_fire_speed then 'Control_or_before' when days_raw < 0 then 'Near_fire_date' when days_raw = 0 then 'DayOf'
                    when days_raw > 0 then 'After' end as timing_rel_fire from matched"""),
    "squish": with_stages("obs lab", "select row_ord, before_after_clean as a, burnt_unburnt_clean as b from lab"),
    "coord_precision": with_stages("obs", f"""
        select row_ord, lat_decimals, lon_decimals from (
          select *, cast(length(regexp_extract({NUM.format(c='latitude')}, '\\.(\\d+)$', 1)) as int) as lat_decimals,
                    cast(length(regexp_extract({NUM.format(c='longitude')}, '\\.(\\d+)$', 1)) as int) as lon_decimals from obs) as a
        where latlongres = 'original' and lat_decimals >= 3 and lon_decimals >= 3"""),
    "composite_key": with_stages("obs lab st keyed", """
        select row_ord, fired_key, concat(unique_project_id, '__', coalesce(site_name, 'NA')) as site_id from keyed"""),
    "safe_num": with_stages("obs", "select row_ord, try_cast(response_variable_text as double) as number from obs"),
    "logs": with_stages("obs", """
        select row_ord, round_even(case when survey_effort_traps > 0 then ln(survey_effort_traps) end, 6) as ln_traps,
               round_even(ln(1 + unburnt5), 6) as ln1_unburnt5 from obs"""),
    "zscore": with_stages("obs", "select row_ord, " + ", ".join(f"round_even({z(c)}, 6) as {n}" for c, n in SCALE_COLS.items()) + " from obs"),
    "lump_min": with_stages("obs", """
        select row_ord, case when n < 100 then 'Other' else broad_taxon end as taxon,
               case case when n < 100 then 'Other' else broad_taxon end when 'Bird' then 1 when 'Mammal' then 2 when 'Other' then 3 when 'Plant' then 4 end as taxon_code
        from (select *, count(*) over (partition by broad_taxon) as n from obs) as a"""),
    "index_levels": with_stages("obs", """
        select row_ord, o.species, species_index from obs o left join (
          select species, row_number() over (order by species) as species_index from (select distinct species from obs) as d) as l on o.species = l.species"""),
    "design_matrix": design_sql(),
    "bad_pa": with_stages("obs", """
        select unique_project_id, model_response, count(*) as count from (
          select unique_project_id, cast(trunc(response_value) as int) as model_response from obs) as a
        where model_response is null or model_response not in (0, 1) group by 1, 2"""),
    "bad_abundance": with_stages("obs", """
        select unique_project_id, count(*) as count from obs where response_value is null or response_value - 3 < 0 group by 1"""),
    "effort_positive": with_stages("obs", """
        select count(*) filter (where survey_effort_hours is null or survey_effort_hours <= 0) as survey_effort_hours_bad,
               count(*) filter (where survey_effort_traps is null or survey_effort_traps <= 0) as survey_effort_traps_bad,
               count(*) filter (where survey_area is null or survey_area <= 0) as survey_area_bad from obs"""),
    "rules_consistent": with_stages("obs rules", """
        select unique_project_id, n_rows from rules join (select unique_project_id, count(*) as n_rows from obs group by 1) as n using (unique_project_id)
        where include_abundance and not (include_pa and n_rows % 2 = 0)"""),
    "funnel": with_stages("obs lab st", """
        select count(*) as all_rows, count(*) filter (where latlongres = 'original') as located,
               count(*) filter (where latlongres = 'original' and eligible_fire_speed) as eligible,
               count(*) filter (where latlongres = 'original' and eligible_fire_speed and response_value is not null) as with_response,
               count(*) filter (where latlongres = 'original' and eligible_fire_speed and response_value is not null and survey_effort_hours > 2) as with_effort
        from st"""),
    "sample_rows": with_stages("obs", """
        select row_ord, site_name, response_value from obs where unique_project_id = 'UP_010'
        order by row_ord, px nulls last, py nulls last, response_value nulls last limit 20"""),
}


def all_oracles() -> dict[str, str]:
    from .fits import ORACLES as FIT_ORACLES

    return {**ORACLES, **FIT_ORACLES}
