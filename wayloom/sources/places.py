"""Places out of the answers of a text search service, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLACE = "struct<id:string,displayName:struct<text:string>,formattedAddress:string,location:struct<latitude:double,longitude:double>>"


def places(answers: DataFrame, column: str = "answer") -> DataFrame:
    """One row for each place of each answer (JSON text): the other columns, pos, place_id, name, address, latitude and
    longitude. What is missing is 'Unknown', '' or 0; an answer without places, or that isn't JSON, has no rows."""
    rest = [c for c in answers.columns if c != column]
    found = answers.select(*rest, F.posexplode(F.from_json(column, f"struct<places:array<{PLACE}>>")["places"]).alias("pos", "p"))
    return found.select(*rest, "pos", F.col("p.id").alias("place_id"), F.coalesce("p.displayName.text", F.lit("Unknown")).alias("name"), F.coalesce("p.formattedAddress", F.lit("")).alias("address"), F.coalesce("p.location.latitude", F.lit(0.0)).alias("latitude"), F.coalesce("p.location.longitude", F.lit(0.0)).alias("longitude"))
