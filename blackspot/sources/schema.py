"""Column names and types of the crash and centroid tables."""

from __future__ import annotations

from pyspark.sql import types as T

# The twelve crash columns, in file order.
CRASH_SCHEMA = T.StructType([
    T.StructField("Crash_ID", T.LongType()),
    T.StructField("Crash_Fatal_Fl", T.StringType()),
    T.StructField("Crash_Date", T.StringType()),
    T.StructField("Latitude", T.DoubleType()),
    T.StructField("Longitude", T.DoubleType()),
    T.StructField("Sus_Serious_Injry_Cnt", T.IntegerType()),
    T.StructField("Nonincap_Injry_Cnt", T.IntegerType()),
    T.StructField("Poss_Injry_Cnt", T.IntegerType()),
    T.StructField("Non_Injry_Cnt", T.IntegerType()),
    T.StructField("Unkn_Injry_Cnt", T.IntegerType()),
    T.StructField("Tot_Injry_Cnt", T.IntegerType()),
    T.StructField("Death_Cnt", T.IntegerType()),
])

CRASH_COLUMNS = CRASH_SCHEMA.fieldNames()


def centroid_schema(cluster_col: str) -> T.StructType:
    return T.StructType([
        T.StructField(cluster_col, T.LongType()),
        T.StructField("centroid_latitude", T.DoubleType()),
        T.StructField("centroid_longitude", T.DoubleType()),
        T.StructField("fatality_rate", T.DoubleType()),
    ])
