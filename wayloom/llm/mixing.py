"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 60-bit hash. A source's budget becomes a threshold on that hash: documents below it are
taken. The threshold is found from sums of sizes by source and hash bucket; only the boundary bucket, in which the
budget runs out, is refined into finer buckets, five times at most. Nothing is sorted, and a larger budget takes
a superset of what a smaller one takes.

Defined results: a null text has size 0; a null source is a source of its own, last; a null doc_id hashes by the
text. Rows of one id (or of one text, without ids) share a hash and are taken or left together. An empty table
gives an empty result. Extra columns pass through; the columns added here replace columns of the same names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

DIGITS = 15  # hexadecimal digits of the hash
STEP = 3  # digits by which one level refines a bucket: 4096 parts


def hash_of(doc_id: Column, text: Column) -> Column:
    """The first 60 bits of a checksum that other engines have as well."""
    key = F.coalesce(doc_id.cast("string"), text, F.lit(""))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, DIGITS), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(src, source_size) -> the same with target. Sources by code point, null last, weigh `weights`, repeating, and
    share `share` of all sizes; no target passes `most` times its source's size, the excess is reshared by weight.

    One row a source: small beside the documents. A source is capped if the level at which the budget per weight
    would stand without it lies above its own cap, so sorting by cap per weight and running sums decide all at once.
    """
    order = Window.orderBy(F.col("src").isNull(), F.col("src"))
    turn = ((F.row_number().over(order) - 1) % len(weights)).cast("int")
    weighed = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    by_need = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("src").isNull(), F.col("src"))
    before, everything = by_need.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    budget = F.sum("source_size").over(everything) * F.lit(float(share))
    weighed = weighed.withColumn("_rest", budget - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))).withColumn("_ws", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    capped = F.col("_cap") * F.col("_ws") <= F.col("_rest") * F.col("_w")
    weighed = weighed.withColumn("_capped", F.min(capped.cast("int")).over(by_need.rowsBetween(Window.unboundedPreceding, 0)))
    free = F.col("_capped") == 0
    rest, ws = F.max(F.when(free, F.col("_rest"))).over(everything), F.max(F.when(free, F.col("_ws"))).over(everything)
    return weighed.select("src", "source_size", F.when(free, rest * F.col("_w") / ws).otherwise(F.col("_cap")).alias("target"))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """docs with size, source_size, target and taken. `most` times a document's size is the most taken of it.

    taken = size * (whole passes of the target over the source, and one more for documents whose hash lies below
    the source's threshold for the rest).
    """
    added = ["size", "source_size", "target", "taken"]
    kept = docs.drop(*added)
    h, size = hash_of(F.col(id_col), F.col(text_col)), common.n_words(F.col(text_col))
    narrow = common.checkpoint(kept.select(F.col(source_col).alias("src"), h.alias("h"), size.alias("size")))
    sources = targets(narrow.groupBy("src").agg(F.sum("size").cast("long").alias("source_size")), weights, share, most)
    sources = sources.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    bounds = common.checkpoint(sources.withColumn("budget", F.col("target") - F.col("passes") * F.col("source_size")).withColumn("low", F.lit(0).cast("long")))
    hint = F.broadcast if common.is_small(bounds) else lambda x: x
    for level in range(1, DIGITS // STEP + 1):
        bounds = common.checkpoint(_refine(narrow, bounds, 16 ** (DIGITS - STEP * level), hint))  # one row a source
    # columns are renamed by place, so that documents may have columns of any names
    plain = [f"column_{i}" for i in range(len(kept.columns))]
    rows = kept.withColumns({"size": size, "target": h}).toDF(*plain, "size", "_h")
    rows = rows.join(hint(bounds), F.col(plain[kept.columns.index(source_col)]).eqNullSafe(F.col("src")), "left")
    taken = F.col("size") * (F.col("passes") + (F.col("_h") < F.col("low")).cast("long"))
    return rows.withColumn("taken", taken).select(*plain, *added).toDF(*kept.columns, *added)


def _refine(narrow: DataFrame, bounds: DataFrame, width: int, hint) -> DataFrame:
    """Move each source's threshold `low` up to the first bucket of `width` hashes that its budget can't hold.

    Only the bucket found before, of 4096 times the width, is looked into; its parts are summed map-side first.
    """
    wide = width * 16**STEP
    inside = narrow.join(hint(bounds.select(F.col("src").alias("_src"), "low")), F.col("src").eqNullSafe(F.col("_src")) & (F.col("h") >= F.col("low")) & (F.col("h") < F.col("low") + F.lit(wide)))
    parts = inside.groupBy("src", "low", F.floor((F.col("h") - F.col("low")) / width).alias("part")).agg(F.sum("size").alias("tokens"))
    running = F.sum("tokens").over(Window.partitionBy("src").orderBy("part"))
    over = parts.withColumn("held", running).join(bounds.select(F.col("src").alias("_src"), "budget"), F.col("src").eqNullSafe(F.col("_src")))
    fits = F.col("held") <= F.col("budget")
    found = over.groupBy(F.col("src").alias("_src")).agg(F.min(F.when(~fits, F.col("part"))).alias("part"), F.coalesce(F.max(F.when(fits, F.col("held"))), F.lit(0)).alias("used"))
    part = F.coalesce(F.col("part"), F.when(F.col("used").isNull(), F.lit(0)).otherwise(F.lit(16**STEP)))
    return bounds.join(found, F.col("src").eqNullSafe(F.col("_src")), "left").select("src", "source_size", "target", "passes", (F.col("budget") - F.coalesce(F.col("used"), F.lit(0))).alias("budget"), (F.col("low") + part.cast("long") * F.lit(width)).alias("low"))


def repeat(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each document as often as it is taken (documents without words are left out)."""
    times = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(0)
    return mixed.where(F.col("taken") > 0).withColumn("_turn", F.explode(F.sequence(F.lit(1), times))).select(*columns)
