"""Domain tables made from the driver's tables by plain arithmetic, in SQL that Spark and DuckDB read alike.

``gaps`` is the cloud of a survey that could not fly over three boxes.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from skysurvey.session import table

SQL = {
    "photos": """
        SELECT o_orderkey AS ord,
               concat('IMG_', lpad(CAST(CAST(floor(o_orderkey / 5) AS BIGINT) AS STRING), 6, '0'), '_', CAST(o_orderkey % 5 + 1 AS STRING), '.tif') AS filename,
               CAST(floor(o_orderkey / 5) AS BIGINT) AS capture,
               CASE o_orderkey % 5 WHEN 0 THEN 'Red' WHEN 1 THEN 'Green' WHEN 2 THEN 'Blue' WHEN 3 THEN 'NIR' ELSE 'RedEdge' END AS band_name,
               CAST(o_orderkey % 5 AS INT) AS band_index,
               CAST((o_orderkey * 7919) % 360000 AS DOUBLE) / 1000 - 180 AS longitude,
               CAST((o_orderkey * 104729) % 160000 AS DOUBLE) / 1000 - 80 AS latitude,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderkey % 500 AS DOUBLE) + 0.5 END AS altitude,
               CAST(o_orderkey % 360 AS DOUBLE) AS yaw, CAST(o_orderkey % 90 AS DOUBLE) - 45 AS pitch, CAST(o_orderkey % 60 AS DOUBLE) - 30 AS roll,
               CASE o_orderkey % 4 WHEN 0 THEN 'DJI' WHEN 1 THEN 'senseFly' WHEN 2 THEN 'GoPro' ELSE 'Sentera' END AS make,
               CASE o_orderkey % 4 WHEN 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'FC7203' ELSE 'FC330' END WHEN 1 THEN 'SODA' WHEN 2 THEN 'HERO8 Black' ELSE '6X' END AS model,
               CAST(2000 + o_orderkey % 7 * 1000 AS INT) AS width, CAST(1500 + o_orderkey % 5 * 750 AS INT) AS height,
               CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderkey % 17 AS DOUBLE) / 4 END AS std_xy,
               CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE CAST(o_orderkey % 23 AS DOUBLE) / 4 END AS std_z,
               o_orderdate AS taken, o_custkey AS pilot
        FROM orders
    """,
    "points": """
        SELECT l_orderkey AS ord, l_linenumber AS line, CAST(l_partkey % 200 AS DOUBLE) + l_discount AS x, CAST(l_suppkey % 100 AS DOUBLE) + l_tax AS y,
               l_quantity + CAST(l_partkey % 10 AS DOUBLE) / 8 AS z, CAST(CASE WHEN l_linenumber <= 3 THEN 2 ELSE 1 END AS INT) AS class, l_linenumber AS views,
               CAST(l_partkey % 256 AS INT) AS red, CAST(l_suppkey * 3 % 256 AS INT) AS green, CAST(l_orderkey % 256 AS INT) AS blue, l_returnflag AS submodel
        FROM lineitem
    """,
    "pixels": """
        SELECT p_partkey AS id, CAST(floor(p_partkey / 50) AS BIGINT) AS row, p_partkey % 50 AS col,
               CAST(p_size * 5 AS DOUBLE) AS red, CAST(p_partkey % 251 AS DOUBLE) AS green, CAST(p_partkey * 7 % 241 AS DOUBLE) AS blue,
               CAST(p_partkey * 13 % 255 AS DOUBLE) AS nir, CAST(p_partkey * 11 % 253 AS DOUBLE) AS edge, 20000 + CAST(p_partkey % 3000 AS DOUBLE) AS raw, p_brand AS brand
        FROM part
    """,
    "fixes": """
        SELECT event_id AS id, user_id AS track, ts, CAST(event_id % 977 AS DOUBLE) / 8 AS x, CAST(event_id % 613 AS DOUBLE) / 8 AS y, CAST(event_id % 97 AS DOUBLE) / 4 AS z, event_type AS kind, value
        FROM events
    """,
    "gcp": """
        SELECT s_suppkey AS id, CAST(s_suppkey % 40 AS DOUBLE) * 2.5 AS x, CAST(s_suppkey % 40 AS DOUBLE) * 1.25 AS y, CAST(s_suppkey % 40 AS DOUBLE) AS z,
               CAST(s_suppkey * 31 % 4000 AS DOUBLE) AS px, CAST(s_suppkey * 17 % 3000 AS DOUBLE) AS py,
               concat('IMG_', lpad(CAST(s_suppkey * 37 % 5000 AS STRING), 6, '0'), '_', CAST(s_suppkey % 7 + 1 AS STRING), '.tif') AS filename, s_nationkey AS survey
        FROM supplier
    """,
    "raster": """
        SELECT source, col, row, CAST(sum(z) AS DOUBLE) / count(*) AS value, CAST(count(*) AS DOUBLE) AS n, CAST(min(alpha) AS INT) AS alpha
        FROM (SELECT submodel AS source, CAST(floor(x / 4) AS BIGINT) AS col, CAST(floor(y / 4) AS BIGINT) AS row, z, ord % 256 AS alpha FROM points) AS t
        GROUP BY source, col, row
    """,
    "gaps": """
        SELECT * FROM points WHERE NOT (x BETWEEN 60 AND 100 AND y BETWEEN 20 AND 60) AND NOT (x >= 150 AND y >= 70) AND NOT (x BETWEEN 20 AND 31 AND y BETWEEN 40 AND 51)
    """,
    "submodels": """
        SELECT c_custkey AS id, c_nationkey AS submodel, CAST(c_custkey * 37 % 1000 AS DOUBLE) AS x, CAST(c_custkey * 91 % 1000 AS DOUBLE) AS y, c_acctbal AS spread FROM customer
    """,
}
_NEEDS = {"photos": "orders", "points": "lineitem", "pixels": "part", "fixes": "events", "gcp": "supplier", "raster": "points", "gaps": "points", "submodels": "customer"}


def domain(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table as a DataFrame."""
    source = _NEEDS[name]
    text = re.sub(rf"\bFROM {source}\b", f"FROM {{{source}}}", SQL[name])
    return spark.sql(text, **{source: domain(spark, sf_dir, source) if source in SQL else table(spark, sf_dir, source)})


def oracle(body: str) -> str:
    """body as DuckDB SQL, with the domain tables it names as common table expressions."""
    used = [n for n in SQL if re.search(rf"\b{n}\b", body)]
    used += [_NEEDS[n] for n in used if _NEEDS[n] in SQL and _NEEDS[n] not in used][:1]
    used.sort(key=list(SQL).index)
    with_ = ", ".join(f"{n} AS ({SQL[n]})" for n in used)
    body = body.strip()
    if not used:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {with_}, {body[15:]}"
    return f"WITH {with_}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {with_} {body}"
