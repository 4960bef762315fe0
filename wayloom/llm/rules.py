"""Quality rules: base measures of every text, and a learned decision list. DataFrame functions only.

The list is learned by sequential covering. Labelled statistics of a bounded sample of documents (MOST labelled
rows by default) are split into a growing and a pruning part. A rule starts empty and takes the threshold
condition with the most FOIL gain on the growing part until it covers no wrong row; conditions at its end are
dropped while that doesn't lower its worth on the pruning part. Rows that it covers leave, and the next rule is
grown from the rest, until a rule is worse than SURE on the pruning part. Every step asks Spark for counts by
feature, threshold bin and label; nothing else comes to the driver. The rules become one ordered conditional
expression: the first rule that fits rejects, and what none rejects is kept.

Defined results: null and blank texts have no words, fail the base rule and aren't kept. Without labels of both
kinds the list is empty and the base rule decides alone. Extra columns pass through; columns named as the result's
are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MOST, BINS, CONDITIONS, RULES, SURE, LEAST = 12_000, 24, 3, 12, 0.95, 5
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SYMBOLS = "#*$%&|<>"
#: What conditions may ask, as shares that mean the same for short and long texts.
FEATURES = {
    "words": "double(n_words)",
    "chars_a_word": "word_chars / greatest(n_words, 1)",
    "symbols_a_word": "n_symbols / greatest(n_words, 1)",
    "duplicate_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeated_words": "n_repeat_words / greatest(n_words, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
    "marks_a_word": "n_marks / greatest(n_words, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    bound: float

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value > F.lit(self.bound) if self.above else value <= F.lit(self.bound)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.bound:.6g}"


Rule = tuple[Condition, ...]


def fits(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, [c.column() for c in rule], F.lit(True))


def measures(docs: DataFrame, text_col: str = "text", more: bool = True) -> DataFrame:
    """docs with the base measures; with more, those that the features need besides."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    flat = F.trim(F.translate(text, common.BLANKS, "      "))
    words = F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " +"))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def count(characters: str) -> Column:
        return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")

    def repeated(w: Column) -> Column:
        three = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) >= 4, common.let(three, _repeated)).otherwise(F.lit(0))

    # Each measure is one expression whose parts are bound by let(): a filter on it, which the optimiser moves
    # below the projection, then repeats the measure, but not its parts for every element.
    added = {
        "_c": common.let(lines, lambda x: F.struct(F.size(x).alias("lines"), F.size(F.array_distinct(x)).alias("distinct"))),
        "_w": common.let(words, lambda w: F.struct(F.size(w).alias("words"), repeated(w).alias("repeated"))),
    }
    plain = {"word_chars": F.length(F.translate(text, common.BLANKS, "")).cast("long"), "n_symbols": count(SYMBOLS)}
    if more:
        plain |= {"n_capitals": count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "n_marks": count("!?"), "n_digits": count("0123456789")}
    out = docs.drop(*[c for c in (*BASE, "n_lines", *plain, *added) if c != text_col]).withColumns(added | plain)
    out = out.withColumns({
        "n_words": F.col("_w.words").cast("long"),
        "n_repeat_words": F.col("_w.repeated").cast("long"),
        "n_dup_lines": (F.col("_c.lines") - F.col("_c.distinct")).cast("long"),
    } | ({"n_lines": F.col("_c.lines").cast("long")} if more else {}))
    return out.drop("_c", "_w")


def _repeated(windows: Column) -> Column:
    """How many words lie in windows that occur twice or more; windows are hashes in text order."""

    def any_twice(ordered: Column) -> Column:
        return F.exists(F.sequence(F.lit(1), F.size(ordered) - 1), lambda i: F.get(ordered, i) == F.get(ordered, i - 1))

    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(common.let(F.sort_array(windows), any_twice), common.let(placed, _covered)).otherwise(F.lit(0))


def _covered(placed: Column) -> Column:
    """Of (window, place) pairs in order: how many words lie in windows that occur twice or more."""
    def again(x: Column, j: Column) -> Column:
        return F.coalesce(F.get(placed, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(placed, j + 1)["h"] == x["h"], F.lit(False))

    places = F.array_sort(F.transform(F.filter(placed, again), lambda x: x["i"]))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("total"))
    return F.aggregate(places, start, lambda acc, i: F.struct(i.alias("last"), (acc["total"] + F.least(F.lit(3), i - acc["last"])).alias("total")), lambda acc: acc["total"])


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MOST) -> list[Rule]:
    """Rules that reject low quality (label 0), in order, from at most `most` labelled rows outside a held-out third."""
    ids = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~common.held_out(F.col(id_col), 3, 1))
    ids = ids.groupBy(F.col(id_col).alias("_id")).agg((F.min(label_col) == 0).alias("_bad")).orderBy(F.xxhash64("_id"), "_id").limit(most)
    chosen = docs.select(id_col, text_col).join(F.broadcast(ids), F.col(id_col) == F.col("_id")).groupBy("_id", "_bad").agg(F.min(text_col).alias("_text"))
    shares = [F.expr(sql).alias(name) for name, sql in FEATURES.items()]
    told = measures(chosen, "_text").select("_bad", (F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(3)) == 0).alias("_prune"), *BASE, "n_lines", "n_capitals", "n_marks", "n_digits", *shares)
    told = common.checkpoint(told).where(~base_failed())
    edges = told.groupBy("_bad").agg(*[F.percentile_approx(name, [k / BINS for k in range(1, BINS)], 1000).alias(name) for name in FEATURES]).collect()  # a row for each label
    values = {name: sorted({float(v) for row in edges for v in row[name] or []}) for name in FEATURES}
    bounds = {name: [(a + b) / 2 for a, b in zip(v, v[1:], strict=False)] for name, v in values.items()}  # midway, for margin
    rules: list[Rule] = []
    left = told
    while len(rules) < RULES:
        rule = _prune(left.where("_prune"), _grow(left.where("not _prune"), bounds))
        if not rule:
            break
        rules.append(rule)
        left = left.where(~fits(rule))
    return rules


def _counts(rows: DataFrame, bounds: dict[str, list[float]]) -> dict[tuple[str, int], list[int]]:
    """For each feature and number of bounds below the value: good and bad rows. A few hundred counts."""
    def bin_of(name: str, at: list[float]) -> Column:
        return F.size(F.filter(F.array(*[F.lit(b) for b in at]), lambda b: F.col(name) > b))

    cells = [F.struct(F.lit(name).alias("f"), bin_of(name, at).alias("bin")) for name, at in bounds.items()]
    counted = rows.select("_bad", F.explode(F.array(*cells)).alias("c")).groupBy("c.f", "c.bin").agg(F.count_if(~F.col("_bad")).alias("good"), F.count_if("_bad").alias("bad")).collect()
    return {(r["f"], r["bin"]): [r["good"], r["bad"]] for r in counted}


def _grow(rows: DataFrame, bounds: dict[str, list[float]]) -> Rule:
    """Take the condition with the most gain until the rule covers bad rows only."""
    rule: Rule = ()
    bounds = {name: at for name, at in bounds.items() if at}
    while bounds and len(rule) < CONDITIONS:
        counts = _counts(rows.where(fits(rule)), bounds)
        sums = {name: [[counts.get((name, i), [0, 0])[k] for i in range(len(at) + 1)] for k in (0, 1)] for name, at in bounds.items()}
        good, bad = (sum(next(iter(sums.values()))[k]) for k in (0, 1))
        if bad < LEAST or not good:
            break
        now, best = math.log2(bad / (good + bad)), (0.0, None)
        for name, at in bounds.items():
            for i, bound in enumerate(at):
                for above in (True, False):
                    g, b = (sum(sums[name][k][i + 1 :] if above else sums[name][k][: i + 1]) for k in (0, 1))
                    if b >= LEAST:
                        best = max(best, (b * (math.log2(b / (g + b)) - now), Condition(name, above, bound)), key=lambda x: (x[0], str(x[1])))
        if best[1] is None:
            break
        rule = (*rule, best[1])
    return rule


def _prune(rows: DataFrame, rule: Rule) -> Rule:
    """Drop last conditions while the share of bad among covered rows doesn't fall; nothing, if that is below SURE."""
    if not rule:
        return ()
    heads = [rule[: k + 1] for k in range(len(rule))]
    row = rows.agg(*[F.count_if(fits(h) & F.col("_bad")).alias(f"b{k}") for k, h in enumerate(heads)], *[F.count_if(fits(h) & ~F.col("_bad")).alias(f"g{k}") for k, h in enumerate(heads)]).first()
    worth = [(row[f"b{k}"] - row[f"g{k}"]) / max(row[f"b{k}"] + row[f"g{k}"], 1) for k in range(len(rule))]
    best = max(range(len(rule)), key=lambda k: (worth[k], -k))
    good, bad = row[f"g{best}"], row[f"b{best}"]
    return heads[best] if bad >= 2 and bad >= SURE * (good + bad) else ()


def verdict(rules: list[Rule]) -> tuple[Column, Column]:
    """Whether the list keeps a row, and which rule rejects it (null: none), as ordered conditional expressions."""
    keep, which = F.lit(True), F.lit(None).cast("string")
    for rule in reversed(rules):
        keep, which = F.when(fits(rule), False).otherwise(keep), F.when(fits(rule), F.lit(" and ".join(map(str, rule)))).otherwise(which)
    return keep, which


def apply(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """docs with the base measures, base_failed, kept and rejected_by."""
    out = measures(docs.drop("base_failed", "kept", "rejected_by"), text_col)
    keep, which = verdict(rules)
    out = out.withColumn("base_failed", base_failed()).withColumn("kept", F.when(F.col("base_failed"), False).otherwise(keep)).withColumn("rejected_by", F.when(~F.col("base_failed"), which))
    return out.drop("n_lines", "n_capitals", "n_marks", "n_digits")
