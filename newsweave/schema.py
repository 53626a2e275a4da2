"""Fixed schemas of the stages."""

from __future__ import annotations

from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

_S = StringType()
RAW = StructType([StructField(c, _S) for c in ("feed", "title", "url", "published", "summary", "full_text", "scraped_at", "topic")])
MERGED = StructType([*RAW.fields, *[StructField(c, _S) for c in ("id", "canonical_url", "published_ts", "source_type")]])
STATE = StructType([StructField("feed_key", _S), StructField("last_published_ts", _S), StructField("last_run_ts", _S), StructField("last_file", _S), StructField("added_last_run", LongType())])
GEOCODES = StructType([StructField("place", _S), StructField("lat", DoubleType()), StructField("lon", DoubleType())])
# The 19 columns of a gazetteer dump.
GAZETTEER = StructType([
    StructField(c, _S)
    for c in (
        "geonameid name asciiname alternatenames latitude longitude feature_class feature_code country_code cc2 admin1_code admin2_code "
        "admin3_code admin4_code population elevation dem timezone modification_date"
    ).split()
])
