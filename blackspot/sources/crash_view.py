"""Crash table derived from the order-line table, for tests, checks and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from blackspot.sources.schema import CRASH_COLUMNS

# The same text runs in Spark and in the checking engine; integers only. The id
# folds all keys of a line into 61 bits with a prime modulus, in wide integers,
# so that it has room for tables of any scale.
KEYS_SQL = """
SELECT CAST((((CAST(l_orderkey * 10 + l_linenumber AS {wide}) * 1000003 + l_partkey) * 1000003 + l_suppkey) * 4000
    + (year(l_shipdate) - 1990) * 372 + month(l_shipdate) * 31 + day(l_shipdate)) % 2305843009213693951 AS BIGINT) AS crash_id,
  l_orderkey * 10 + l_linenumber AS n, l_orderkey AS o, l_linenumber AS ln,
  l_partkey AS p, l_suppkey AS s, l_shipdate
FROM lineitem"""

# The same id in 64-bit integers, for keys that leave room: 4000012000 is 1000003 * 4000, and 2^61 is 1 by the modulus, so
# the upper half of the first product is turned round by 61 bits. Every row has it several times once filters are pushed
# down to the scan, and wide division costs microseconds. Rows with other keys take the wide form.
ROOM_SQL = "l_orderkey BETWEEN 0 AND 800000000000 AND l_linenumber BETWEEN 0 AND 1000000000000 AND l_partkey BETWEEN 0 AND 100000000000000 AND l_suppkey BETWEEN 0 AND 1000000000000 AND l_shipdate >= DATE'1990-01-01'"
FOLDED_SQL = "(((l_orderkey * 10 + l_linenumber) * 1000003L + l_partkey) % 2305843009213693951L)"
UPPER_SQL = f"(shiftright({FOLDED_SQL}, 31) * 4000012000L)"
NARROW_SQL = f"""(shiftright({UPPER_SQL}, 30) + shiftleft({UPPER_SQL} & 1073741823L, 31) + ({FOLDED_SQL} & 2147483647L) * 4000012000L % 2305843009213693951L
    + l_suppkey * 4000L + ((year(l_shipdate) - 1990) * 372 + month(l_shipdate) * 31 + day(l_shipdate))) % 2305843009213693951L"""

VALUES_SQL = """
SELECT crash_id,
  CASE WHEN n % 53 = 0 THEN NULL
       ELSE 25900000 + (s * 7368787) % 10400000
          + CASE WHEN (o + ln) % 4 = 0 THEN (p * 7919 + o * 104729) % 600001 - 300000
                 ELSE (p * 7919 + o * 104729) % 8001 - 4000 END END AS lat_e6,
  CASE WHEN n % 59 = 0 THEN NULL
       ELSE -106500000 + (s * 5915587) % 12800000
          + CASE WHEN (o + ln) % 4 = 0 THEN (o * 1299709 + ln * 15485863) % 600001 - 300000
                 ELSE (o * 1299709 + ln * 15485863) % 8001 - 4000 END END AS lon_e6,
  CASE WHEN (o * 31 + p) % 97 = 0 THEN 2 WHEN (o * 31 + p) % 23 = 0 THEN 1 ELSE 0 END AS deaths,
  CAST(n % 3 AS INT) AS serious, CAST(o % 2 AS INT) AS nonincap, CAST(p % 4 AS INT) AS poss,
  CAST(s % 5 AS INT) AS non_inj, CAST(ln % 2 AS INT) AS unkn,
  {date_text} AS date_text
FROM src"""

CRASHES_SQL = """
SELECT crash_id AS Crash_ID,
  CASE WHEN deaths > 0 THEN 'Y' ELSE 'N' END AS Crash_Fatal_Fl,
  date_text AS Crash_Date, lat_e6 / 1e6 AS Latitude, lon_e6 / 1e6 AS Longitude,
  serious AS Sus_Serious_Injry_Cnt, nonincap AS Nonincap_Injry_Cnt, poss AS Poss_Injry_Cnt,
  non_inj AS Non_Injry_Cnt, unkn AS Unkn_Injry_Cnt,
  CAST(serious + nonincap + poss AS INT) AS Tot_Injry_Cnt, deaths AS Death_Cnt{more}
FROM crash_values"""


def crash_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    values = VALUES_SQL.format(date_text="date_format(l_shipdate, 'MM/dd/yyyy')")
    keys = KEYS_SQL.format(wide="DECIMAL(38,0)").replace("FROM lineitem", "FROM {lineitem}")
    wide, rest = keys.replace("SELECT", "", 1).split(" AS crash_id", 1)
    keys = f"SELECT CASE WHEN {ROOM_SQL} THEN {NARROW_SQL} ELSE {wide} END AS crash_id{rest}"
    sql = f"WITH src AS ({keys}), crash_values AS ({values}) {CRASHES_SQL.format(more='')}"
    return spark.sql(sql, lineitem=lineitem).select(*CRASH_COLUMNS)


def crash_cte() -> str:
    """The view as the opening CTEs of a query for the checking engine."""
    values = VALUES_SQL.format(date_text="strftime(l_shipdate, '%m/%d/%Y')")
    crashes = CRASHES_SQL.format(more=", lat_e6, lon_e6")
    return (f"WITH src AS ({KEYS_SQL.format(wide='HUGEINT')}), crash_values AS ({values}), crash AS ({crashes}), "
            "pts AS (SELECT * FROM crash WHERE lat_e6 IS NOT NULL AND lon_e6 IS NOT NULL)")
