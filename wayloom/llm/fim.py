"""Fill-in-the-middle: texts cut in three at places that their ids decide, rearranged behind sentinels, and restored.

regexp_extract_all makes the array of a text's units; substrings of the id's sha2, read as numbers by conv, give the
two cuts and the form; slice and array_join build the arrangement; split at the sentinels restores the text. Each row
stands for itself: no shuffle, and the result is the same however rows are dealt out.

Forms: `plain`, the text itself; `psm`, prefix, suffix, middle; `spm`, suffix, prefix, middle. A text that holds a
sentinel stays plain, so that an arrangement can always be taken apart again; sentinels have the form <...> without
other angle brackets, so that none can arise over a seam.

Defined results: null and empty texts are plain with n 0 and an empty output. A null id is hashed as an empty one.
Repeated rows give equal rows. Extra columns don't pass through, so that no name can clash. A unit array takes about
60 bytes a unit while its row is worked on.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTINELS = ("<P>", "<S>", "<M>")  # before prefix, suffix and middle
UNIT = "(?s)."  # one code point
SALT = "1:"  # stands before the id in the hash; another one gives other cuts
ARRANGED, SPM = 90, 20  # per cent of texts that are arranged, and of these the ones suffix first


def numbers(id_: Column, salt: str, n: int) -> list[Column]:
    """The first n groups of eight hexadecimal digits of the hash of an id, as unsigned integers."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(n)]


def arrange(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salt: str = SALT, unit: str = UNIT, arranged: int = ARRANGED, spm: int = SPM, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """(doc_id, n, form, prefix_units, middle_units, output) of every row; the numbers of units are null for plain rows."""
    if len(set(sentinels)) < 3 or not all(re.fullmatch("<[^<>]+>", s) for s in sentinels):
        raise ValueError("sentinels must be three different strings <...> without other angle brackets")
    p, s, m = (F.array(F.lit(x)) for x in sentinels)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.regexp_extract_all("text", F.lit(unit), F.lit(0)).alias("units"), *[h.alias(f"h{i}") for i, h in enumerate(numbers(F.col("doc_id"), salt, 4), 1)])
    rows = rows.withColumn("n", F.size("units").cast("long"))
    held = F.lit(False)
    for x in sentinels:
        held = held | F.contains("text", F.lit(x))
    form = F.when((F.col("text") == "") | held | (F.col("h3") % 100 >= arranged), "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    cuts = [F.col(h) % (F.col("n") + 1) for h in ("h1", "h2")]
    rows = rows.select("doc_id", "text", "units", "n", form.alias("form"), F.least(*cuts).cast("int").alias("low"), F.greatest(*cuts).cast("int").alias("high"))
    one = F.lit(1)
    prefix, middle = F.slice("units", one, F.col("low")), F.slice("units", F.col("low") + 1, F.col("high") - F.col("low"))
    suffix = F.slice("units", F.col("high") + 1, F.col("n").cast("int") - F.col("high"))
    output = F.when(F.col("form") == "psm", F.array_join(F.concat(p, prefix, s, suffix, m, middle), "")).when(F.col("form") == "spm", F.array_join(F.concat(s, suffix, p, prefix, m, middle), "")).otherwise(F.col("text"))
    cut = F.col("form") != "plain"
    return rows.select("doc_id", "n", "form", F.when(cut, F.col("low").cast("long")).alias("prefix_units"), F.when(cut, (F.col("high") - F.col("low")).cast("long")).alias("middle_units"), output.alias("output"))


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of this form was made of."""
    first, second, middle = (F.get(F.split(output, "|".join(f"\\Q{s}\\E" for s in sentinels), -1), F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)
