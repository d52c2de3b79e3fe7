"""The driver's tables in the shape the library reads.

The SQL runs unchanged in Spark and in the oracle engine. Coordinates are
integers in metres, so geometry is exact in both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberline.sources.polygons import spread

OBS = """
select concat('UP_', lpad(cast(3 + l_suppkey % 84 as string), 3, '0')) as unique_project_id,
       concat('project ', cast(3 + l_suppkey % 84 as string)) as project_name,
       case when l_partkey % 97 = 0 then null else concat('site ', cast(l_partkey as string)) end as site_name,
       concat('method ', cast(l_suppkey % 3 as string)) as survey_method,
       concat('  ', case when l_linestatus = 'O' then 'Before' else 'After' end, '   Fire ') as before_after,
       case when l_returnflag = 'R' then ' Unburnt' else 'Burnt  ' end as burnt_unburnt,
       (l_partkey * 7919 + l_suppkey * 31) % 200000 as px,
       (l_partkey * 10427 + l_suppkey * 17) % 200000 as py,
       case when l_orderkey % 29 = 0 then 'generalised' else 'original' end as latlongres,
       -45 + cast((l_partkey * 7919) % 35000 as double) / 1000 as latitude,
       110 + cast((l_suppkey * 6151 + l_partkey) % 45000 as double) / 1000 as longitude,
       case when l_linenumber % 3 = 0 then concat(cast(month(l_shipdate) as string), '/', cast(day(l_shipdate) as string), '/', cast(year(l_shipdate) as string))
            when l_linenumber % 3 = 1 then concat(cast(year(l_shipdate) as string), '-', cast(month(l_shipdate) as string), '-', cast(day(l_shipdate) as string))
            when l_linenumber = 2 then concat(cast(day(l_shipdate) as string), '/', cast(month(l_shipdate) as string), '/', cast(year(l_shipdate) as string))
            else 'unknown' end as date_text,
       date '2019-06-01' + cast((l_orderkey * 13 + l_partkey) % 700 as int) as date_survey,
       case when l_linenumber = 7 then null else l_quantity / 4 end as response_value,
       case when l_orderkey % 17 = 0 then 'Number ALIVE' when l_orderkey % 19 = 0 then 'All plants (mature + juvenile)'
            when l_orderkey % 23 = 0 then 'nest occupancy and reproduction' when l_orderkey % 11 = 0 then 'n/a' when l_orderkey % 13 = 0 then null else cast(l_linenumber as string) end as response_variable_text,
       case when l_tax = 0 then null else l_tax * 100 end as survey_effort_hours,
       l_discount * 100 as survey_effort_traps,
       l_discount as survey_area,
       case l_linenumber when 1 then 'Low (burnt understory, unburnt canopy)'
                         when 2 then 'Moderate (partial canopy scorch)'
                         when 3 then 'High (full canopy scorch)'
                         when 4 then 'Extreme (full canopy consumption)'
                         when 5 then 'not recorded' end as fire_severity,
       cast(case when l_partkey % 10 = 0 then 999 else l_partkey % 40 end as double) as ts_fire,
       case l_suppkey % 4 when 0 then '0' when 1 then '1' when 2 then '2+' else '?' end as no_fires,
       cast(l_quantity as double) as unburnt5,
       cast(l_partkey % 31 as double) as mean_temp_final,
       cast(l_suppkey % 17 as double) as mean_rainfall_final,
       cast(l_orderkey % 41 as double) as drought_spi_final,
       cast(l_partkey % 101 as double) as disturb_landuse_final_5km_pc_naturalenv,
       case when l_partkey in (7, 11) then 'Fungi' when l_partkey = 13 then 'Moss'
            when l_partkey % 3 = 0 then 'Bird' when l_partkey % 3 = 1 then 'Mammal' else 'Plant' end as broad_taxon,
       concat('sp ', cast(l_partkey % 300 as string)) as species,
       concat('eco ', cast(l_suppkey % 5 as string)) as ecosystem_group,
       l_orderkey as order_key,
       l_orderkey * 8 + l_linenumber as row_ord
from lineitem
"""

POLYS = """
select id, did, poly_ord, date_day, event_day, cx, cy, r, fsr_km2_dy, dy_ar_km2, mx_grw_km2, ig_utm_x, ig_utm_y,
       concat('POLYGON ((', cast(cx + r as string), ' ', cast(cy as string), ', ',
              cast(cx as string), ' ', cast(cy + r as string), ', ',
              cast(cx - r as string), ' ', cast(cy as string), ', ',
              cast(cx as string), ' ', cast(cy - r as string), ', ',
              cast(cx + r as string), ' ', cast(cy as string), '))') as wkt
from (
  select o_custkey as id,
         cast(o_orderkey as string) as did,
         o_orderkey as poly_ord,
         date '2019-05-15' + cast(o_orderkey % 400 as int) as date_day,
         cast(1 + o_orderkey % 30 as int) as event_day,
         (o_custkey * 6151 + o_orderkey * 13) % 200000 as cx,
         (o_custkey * 3571 + o_orderkey * 29) % 200000 as cy,
         500 + o_orderkey % 1500 as r,
         case when o_orderkey % 17 = 0 then null else floor(o_totalprice / 50000) end as fsr_km2_dy,
         case when o_orderkey % 19 = 0 then null else o_totalprice / 1000 end as dy_ar_km2,
         o_totalprice / 500 as mx_grw_km2,
         cast((o_custkey * 31 + o_orderkey) % 200000 as double) as ig_utm_x,
         cast((o_custkey * 37 + o_orderkey) % 200000 as double) as ig_utm_y
  from orders
) as o
"""

FIRES = """
select event_id as row_ord, user_id as id, cast(ts as date) as ig_date, event_type as lc_name,
       value as mx_grw_km2, value * (1 + user_id % 7) as tot_ar_km2
from events
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str, even: bool = False) -> DataFrame:
    """Survey rows; ``even`` deals the raw rows over all cores where their files have fewer splits."""
    raw = table(spark, sf_dir, "lineitem")
    return spark.sql(OBS.replace("from lineitem", "from {src}"), src=spread(raw) if even else raw)


def polys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily polygons, geometry as text."""
    return spark.sql(POLYS.replace("from orders", "from {src}"), src=table(spark, sf_dir, "orders"))


def fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fire events."""
    return spark.sql(FIRES.replace("from events", "from {src}"), src=table(spark, sf_dir, "events"))
