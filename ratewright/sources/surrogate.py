"""Filings made of star-schema tables: one order is one submission, its lines are hours, employees and cases.

Orders of one customer in one year are amendments of each other. Missing and contradicting cells are put in by
rule, so that every flag fires somewhere. SQL holds the same view for other engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, establishment_id, ein, company_name, state, naics_code, year_filing_for, employees, hours, checkbox, cases and days.

    Lines are summed by order before they meet the order, so the join moves one row for each of them.
    """
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    lines = read("lineitem").groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("employees"), F.round(F.sum("l_extendedprice"), 2).alias("hours"),
        F.count_if((F.col("l_returnflag") == "R") & (F.col("l_linenumber") % 2 == 1)).alias("dafw"), F.count_if((F.col("l_returnflag") == "R") & (F.col("l_linenumber") % 2 == 0)).alias("djtr"),
    )
    rows = read("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).join(read("customer"), F.col("o_custkey") == F.col("c_custkey"))
    key, cases = F.col("o_orderkey"), F.col("dafw") + F.col("djtr")
    box = F.when(cases > 0, 1.0).otherwise(2.0)
    return rows.select(
        key.alias("id"), F.col("o_custkey").alias("establishment_id"), F.concat(F.lit("E"), F.when(key % 31 == 0, key % 7).otherwise(F.col("o_custkey") % 500)).alias("ein"),
        F.when(key % 29 == 0, F.lit(None)).otherwise(F.col("c_name")).alias("company_name"), F.concat(F.lit("S"), F.when(key % 41 == 0, F.lit(99)).otherwise(F.col("c_nationkey")).cast("string")).alias("state"),
        (300000 + F.col("c_nationkey") * 1000 + 100 * (F.length("c_mktsegment") - 7)).cast("long").alias("naics_code"), F.year("o_orderdate").alias("year_filing_for"),
        F.when(key % 89 == 0, F.lit(None)).otherwise(F.col("employees").cast("double")).alias("annual_average_employees"), F.when(key % 97 == 0, F.lit(None)).otherwise(F.col("hours")).alias("total_hours_worked"),
        F.when(key % 83 == 0, 3 - box).otherwise(box).alias("no_injuries_illnesses"), F.lit(0.0).alias("total_deaths"),
        F.when(key % 101 == 0, F.lit(-1.0)).when(key % 103 == 0, F.lit(None)).otherwise(F.col("dafw").cast("double")).alias("total_dafw_cases"), F.col("djtr").cast("double").alias("total_djtr_cases"),
        F.lit(0.0).alias("total_other_cases"), (F.col("dafw") * 7.0).alias("total_dafw_days"), (F.col("djtr") * 4.0).alias("total_djtr_days"),
    )


#: The same view, and the steps that most queries start from, for an engine with DuckDB's SQL.
SQL = """
lines AS (
  SELECT l_orderkey, sum(l_quantity) AS employees, round(sum(l_extendedprice), 2) AS hours,
         count(*) FILTER (l_returnflag = 'R' AND l_linenumber % 2 = 1) AS dafw, count(*) FILTER (l_returnflag = 'R' AND l_linenumber % 2 = 0) AS djtr
  FROM lineitem GROUP BY l_orderkey),
filings AS (
  SELECT o_orderkey AS id, o_custkey AS establishment_id, 'E' || (CASE WHEN o_orderkey % 31 = 0 THEN o_orderkey % 7 ELSE o_custkey % 500 END) AS ein,
         CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE c_name END AS company_name, 'S' || (CASE WHEN o_orderkey % 41 = 0 THEN 99 ELSE c_nationkey END) AS state,
         CAST(300000 + c_nationkey * 1000 + 100 * (length(c_mktsegment) - 7) AS BIGINT) AS naics_code, CAST(year(o_orderdate) AS INTEGER) AS year_filing_for,
         CASE WHEN o_orderkey % 89 = 0 THEN NULL ELSE CAST(employees AS DOUBLE) END AS emp, CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE hours END AS hours,
         CASE WHEN o_orderkey % 83 = 0 THEN 3 - (CASE WHEN dafw + djtr > 0 THEN 1 ELSE 2 END) ELSE (CASE WHEN dafw + djtr > 0 THEN 1 ELSE 2 END) END AS box,
         CAST(0 AS DOUBLE) AS deaths, CASE WHEN o_orderkey % 101 = 0 THEN -1.0 WHEN o_orderkey % 103 = 0 THEN NULL ELSE CAST(dafw AS DOUBLE) END AS dafw, CAST(djtr AS DOUBLE) AS djtr, CAST(0 AS DOUBLE) AS other,
         dafw * 7.0 AS dafw_days, djtr * 4.0 AS djtr_days
  FROM orders JOIN lines ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey),
derived AS (
  SELECT *, deaths + dafw + djtr + other AS cases, dafw + djtr AS dart, CASE WHEN emp > 0 THEN hours / emp END AS hpe,
         CASE WHEN hours > 0 THEN 200000.0 * (deaths + dafw + djtr + other) / hours END AS trir, CASE WHEN hours > 0 THEN 200000.0 * (dafw + djtr) / hours END AS dart_rate,
         substr(CAST(naics_code AS VARCHAR), 1, 2) AS naics2, substr(CAST(naics_code AS VARCHAR), 1, 3) AS naics3, substr(CAST(naics_code AS VARCHAR), 1, 4) AS naics4
  FROM filings),
latest AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY establishment_id, year_filing_for ORDER BY id DESC NULLS FIRST) AS rn FROM derived) WHERE rn = 1),
flagged AS (
  SELECT *, coalesce(hours <= 0, true) AS f_hours, coalesce(emp < 1, true) AS f_emp, cases IS NULL OR coalesce(deaths < 0, false) OR coalesce(dafw < 0, false) OR coalesce(djtr < 0, false) OR coalesce(other < 0, false) AS f_neg,
         coalesce(hpe > 4500, false) AS f_high, coalesce(hpe < 120, false) AS f_low, coalesce((box = 2 AND cases > 0) OR (box = 1 AND cases = 0), false) AS f_box
  FROM latest),
screened AS (SELECT *, f_hours OR f_emp OR f_neg OR f_high OR f_low AS bad FROM flagged),
keyed AS (
  SELECT *, CASE WHEN emp < 1 THEN NULL WHEN emp < 20 THEN '001-019' WHEN emp < 50 THEN '020-049' WHEN emp < 100 THEN '050-099' WHEN emp < 250 THEN '100-249' WHEN emp < 500 THEN '250-499' WHEN emp < 1000 THEN '500-999' WHEN emp >= 1000 THEN '1000+' END AS band
  FROM screened)
"""
