"""Schemas of point records, headers and derived tables."""

from __future__ import annotations

from pyspark.sql import types as T

#: A point of LAS format 7, with both fixed-point and decoded coordinates.
POINT = T.StructType(
    [
        T.StructField("row_id", T.LongType(), False),
        *[T.StructField(n, T.IntegerType(), False) for n in ("raw_x", "raw_y", "raw_z")],
        *[T.StructField(n, T.DoubleType(), False) for n in ("x", "y", "z")],
        T.StructField("intensity", T.IntegerType()),
        *[T.StructField(n, T.ShortType()) for n in ("return_number", "number_of_returns")],
        *[T.StructField(n, T.BooleanType()) for n in ("synthetic", "key_point", "withheld", "overlap")],
        T.StructField("scanner_channel", T.ShortType()),
        *[T.StructField(n, T.BooleanType()) for n in ("scan_direction_flag", "edge_of_flight_line")],
        *[T.StructField(n, T.ShortType()) for n in ("classification", "user_data", "scan_angle")],
        T.StructField("point_source_id", T.IntegerType()),
        T.StructField("gps_time", T.DoubleType()),
        *[T.StructField(n, T.IntegerType()) for n in ("red", "green", "blue")],
        T.StructField("file_id", T.StringType()),
    ]
)

_VLR = "array<struct<type string, user_id string, record_id int, description string, record_length long>>"
HEADER = (
    "path string, file_size_bytes long, las_version string, point_format int, point_record_length int, point_count long, generating_software string, system_identifier string, creation_date string, "
    f"scales array<double>, offsets array<double>, mins array<double>, maxs array<double>, point_dimensions array<string>, vlrs {_VLR}, evlrs {_VLR}"
)
