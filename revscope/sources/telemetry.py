"""Drive logs derived from the ``events`` table by a fixed projection.

Every log begins with twelve rows of cranking. One log in three runs lean while
cold, one rich; one in three has throttle stabs that no downshift follows. Logs of
odd numbers carry a converter duty channel, those of even numbers none but flares.

The statement is valid in Spark and in DuckDB, so a query and the SQL that it is
compared with read the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PROJECTION = """
WITH ph AS (SELECT * FROM (VALUES
 (0,750e0,1e0,35e0,0e0,450e0),(1,760e0,1.5e0,36e0,0e0,450e0),
 (2,2720e0,22e0,55e0,20e0,480e0),(3,2160e0,24e0,52e0,30e0,480e0),
 (4,1780e0,20e0,46e0,40e0,470e0),(5,1860e0,18e0,42e0,60e0,470e0),
 (6,1900e0,16e0,40e0,61e0,460e0),(7,2060e0,17e0,41e0,60e0,460e0),
 (8,2670e0,65e0,82e0,60e0,200e0),(9,4320e0,85e0,95e0,60e0,820e0),
 (10,4400e0,88e0,96e0,61e0,830e0),(11,2700e0,1e0,28e0,60e0,120e0),
 (12,1860e0,15e0,44e0,60e0,470e0),(13,2670e0,18e0,50e0,60e0,470e0),
 (14,1860e0,18e0,44e0,60e0,470e0),(15,800e0,0.5e0,34e0,0e0,450e0)
 ) AS t(ph,rpm0,tps0,map0,vss0,o20)),
b AS (SELECT event_id AS e, CAST(floor(event_id/2500) AS BIGINT) AS log_id,
  event_id % 2500 AS row_idx, CAST(floor(event_id/25) AS BIGINT) % 16 AS ph,
  user_id AS u, CAST(floor(value*100+0.5) AS BIGINT) AS c,
  CASE WHEN event_id%2500>=300 THEN 0 WHEN CAST(floor(event_id/2500) AS BIGINT)%3=1 THEN 16
   WHEN CAST(floor(event_id/2500) AS BIGINT)%3=2 THEN -20 ELSE 0 END AS cold FROM {events})
SELECT log_id, row_idx, row_idx*0.145e0 AS time_s,
 CASE WHEN row_idx<12 THEN 220e0+u%20 WHEN c%307=0 THEN NULL
  WHEN b.ph=3 AND e%25=0 AND log_id%2=0 THEN 3060e0+u%20 ELSE rpm0+u%20 END AS rpm,
 map0+(c%50)/1e1 AS map,
 CASE WHEN c%211=0 THEN NULL WHEN b.ph=5 AND e%25=10 AND log_id%3=1 THEN 58e0
  ELSE tps0+(c%10)/2e1 END AS tps, vss0 AS vss,
 CASE WHEN c%61=0 THEN NULL WHEN row_idx<300 THEN 90e0+row_idx/4e0 ELSE 190e0+u%8 END AS ect,
 CASE WHEN b.ph IN (8,9) AND c%97<9 THEN (c%8+4)*0.175781e0 WHEN c%389=0 THEN 22.5e0 ELSE 0e0 END AS kr,
 128e0+(c%21)-8+cold AS ltft_b1,
 128e0+(c%21)-(CASE WHEN b.ph IN (4,5) THEN 18 ELSE 8 END)+cold AS ltft_b2,
 126e0+(u%5) AS stft_b1, 125e0+(u%7) AS stft_b2,
 o20+(c%300)-150+(CASE WHEN e%2=0 THEN 180 ELSE -180 END) AS o2_b1,
 o20+(c%280)-140+(CASE WHEN e%3=0 THEN 170 ELSE -160 END) AS o2_b2,
 CASE WHEN b.ph IN (9,10) THEN 12.5e0+(c%5)/1e1 ELSE 14.7e0 END AS cmd_afr,
 CASE WHEN b.ph IN (9,10) THEN 12.9e0+(c%7)/1e1 ELSE 14.7e0+(c%9)/1e1-0.4e0 END AS wb_afr,
 91e0+(u%3)*0.4e0 AS baro, 20e0+(c%16) AS iac,
 least(99e0, map0*0.9e0+(c%11)) AS inj_dc,
 CASE WHEN log_id%2=0 OR c%53=0 THEN NULL WHEN b.ph IN (5,6,7,12) THEN 70e0+c%20 ELSE c%30+0e0 END AS tcc,
 0.68e0+(CAST(floor(e/400) AS BIGINT)%5)/1e2 AS shift_t12,
 0.35e0+(CAST(floor(e/300) AS BIGINT)%4)/1e2 AS shift_t23
FROM b JOIN ph ON b.ph=ph.ph
"""


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The projection as a DataFrame; nothing is collected or cached."""
    return spark.sql(PROJECTION, events=spark.read.parquet(f"{sf_dir}/events.parquet"))
