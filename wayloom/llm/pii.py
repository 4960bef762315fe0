"""Personal data: exact base patterns, and bootstrapped contextual extraction. DataFrame functions only.

Base matches (email, ip, card, phone) are the seeds. The words before and after an instance are lexical patterns, in a
bipartite graph with the instances (values) that stand in their slots: seeds and other identifier-like words (with
a digit or an @, and no base match). Spark scores the graph in ROUNDS: a pattern's confidence for a kind is the summed
score of the instances in its slots against all occurrences of its word in the corpus, ordinary words as well, and it
needs SUPPORT different instances; an instance's score joins the confidences of its patterns. What a round accepts are
instances of the next one, whose other contexts become patterns then. Identifier-like words with a score of ACCEPT or
more, in a slot of a pattern with CONFIDENCE or more, are added as spans of that kind. Common words stand before
everything and so never gain confidence.

Places add up from the lengths of matches and of what lies between them, in chunks of CHUNK matches, and patterns start
at the first character of a run only, so that the work is linear in a text's length.

Spans are in code points, end exclusive, in whole texts. Added spans never overlap base ones. Defined results: null
and empty texts have none; rows with one id and text get the same spans. Extra columns pass through; columns named
as the result's are replaced. Other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns; greedy parts that nothing after them could give back to are possessive. Shorter runs of digits
#: would fail as cards, so that card starts at 16. Whether email and ip match doesn't depend on where in its first run
#: they start: they try its first character, or what follows the match before, only.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}  # a character that a match can't do without
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$"
LIKELY = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
BEFORE, AFTER = r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)[\x20\x09-\x0D]++$", r"^[\x20\x09-\x0D]++([^\x20\x09-\x0D]++)"
CHUNK, ROUNDS, SUPPORT, CONFIDENCE, ACCEPT = 128, 4, 4, 0.5, 0.8
SPAN = "array<struct<start:int,end:int,value:string,before:string,after:string>>"


def chunked(items: Column) -> Column:
    """An array cut into arrays of CHUNK elements. Arrays that grow by one element in each step are copied in each step:
    within chunks that costs little."""
    at = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int"))
    return F.when(F.size(items) > 0, F.transform(at, lambda i: F.slice(items, i * CHUNK + 1, F.lit(CHUNK)))).otherwise(F.slice(F.array(items), 1, 0))


def spans_of(text: Column, pattern: str) -> Column:
    """Where a pattern matches, with the words before and after."""

    def length(x: Column) -> Column:
        return F.length(x["gap"]) + F.length(x["value"])

    def within(chunk: Column) -> Column:
        """The spans of a chunk, from its own start on."""
        start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

        def step(acc: Column, x: Column) -> Column:
            begin = acc["at"] + F.length(x["gap"])
            span = F.struct(begin.alias("start"), (begin + F.length(x["value"])).alias("end"), x["value"].alias("value"), F.regexp_extract(x["gap"], BEFORE, 1).alias("before"), F.regexp_extract(x["next"], AFTER, 1).alias("after"))
            return F.struct((acc["at"] + length(x)).alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

        return F.aggregate(chunk, start, step)

    def placed(parts: Column) -> Column:
        begins = F.aggregate(parts, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.get(acc, F.size(acc) - 1) + x["at"])))

        def moved(starts: Column) -> Column:
            return F.flatten(F.transform(parts, lambda part, i: F.transform(part["spans"], lambda x: F.struct((x["start"] + F.get(starts, i)).alias("start"), (x["end"] + F.get(starts, i)).alias("end"), x["value"], x["before"], x["after"]))))

        return common.let(begins, moved)

    def paired(gaps: Column) -> Column:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return F.transform(values, lambda v, i: F.struct(F.get(gaps, i).alias("gap"), v.alias("value"), F.get(gaps, i + 1).alias("next")))

    pairs = common.let(F.split(text, pattern, -1), paired)
    return common.let(common.let(pairs, lambda x: F.transform(chunked(x), within)), placed)


def _luhn(digits: Column) -> Column:
    def term(i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int") * (1 + i % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda acc, i: acc + term(i)) % 10 == 0


def base_spans(text: Column, kind: str) -> Column:
    """The valid matches of one kind."""

    def digits(x: Column) -> Column:
        return F.regexp_replace(x["value"], "[^0-9]", "")

    valid = {
        "email": lambda x: F.lit(True),
        "ip": lambda x: x["value"].rlike(OCTETS),
        "card": lambda x: F.length(digits(x)).between(16, 19) & _luhn(digits(x)),
        "phone": lambda x: F.length(digits(x)).between(8, 15),
    }
    worth = text.contains(NEEDS[kind]) if NEEDS[kind] else F.lit(True)
    if kind != "email":
        worth = worth & text.rlike("[0-9]")
    return F.when(worth, F.filter(spans_of(text, PATTERNS[kind]), valid[kind])).otherwise(F.array().cast(SPAN))


def with_base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with `_id` and `_h`, which tell rows apart, and the base spans of each kind as `_email` and so on."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = {"_id": F.coalesce(F.col(id_col).cast("string"), F.lit("")), "_h": F.xxhash64(text)}
    return docs.withColumns(key | {f"_{kind}": base_spans(text, kind) for kind in KINDS})


def slots(based: DataFrame, text_col: str) -> DataFrame:
    """A row for each instance: _id, _h, kind (null: an identifier-like word), value, before and after. Neighbouring
    words are picked inside each text's arrays, so that no row carries its text along."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = based.select("_id", "_h", text.alias("_text"), *[f"_{kind}" for kind in KINDS]).where(F.col("_text").contains("@") | F.col("_text").rlike("[0-9]"))

    def seed(kind: str) -> Column:
        return F.transform(f"_{kind}", lambda x: F.struct(F.lit(kind).alias("kind"), x["value"].alias("value"), F.lower(x["before"]).alias("before"), F.lower(x["after"]).alias("after")))

    def likely(words: Column) -> Column:
        def one(w: Column, i: Column) -> Column:
            near = [F.lower(F.coalesce(F.get(words, i + k), F.lit(""))) for k in (-1, 1)]
            plain = w.rlike("[0-9@]") & ~w.rlike("|".join(PATTERNS[k] for k in ("email", "ip", "card")))
            return F.when(plain, F.struct(F.lit(None).cast("string").alias("kind"), w.alias("value"), near[0].alias("before"), near[1].alias("after")))

        return F.filter(F.transform(words, one), lambda x: x.isNotNull())

    words = F.split(F.trim(F.translate("_text", common.BLANKS, "      ")), " +")
    found = F.concat(*[seed(kind) for kind in KINDS], common.let(words, likely))
    return rows.select("_id", "_h", F.explode(found).alias("s")).select("_id", "_h", "s.*")


def score(found: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """(_id, _h, kind, value) of the identifiers that the bootstrapping adds to texts. found: slots, checkpointed."""
    edges = found.select("*", F.explode(F.array(F.struct(F.lit("<").alias("side"), F.col("before").alias("word")), F.struct(F.lit(">").alias("side"), F.col("after").alias("word")))).alias("p")).select("_id", "_h", "kind", "value", "p.side", "p.word").where("word <> ''")
    # words beside so many different instances, of whatever kind: any round may make patterns of them
    graph = common.checkpoint(edges.groupBy("side", "word", "value").agg(F.count("*").alias("times"), F.max("kind").alias("seed")))
    words = common.checkpoint(graph.groupBy("side", "word").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT).select("word").distinct())
    seeds = graph.where("seed is not null").select("value", F.col("seed").alias("kind"), F.lit(1.0).alias("score")).distinct()
    if words.isEmpty() or seeds.isEmpty():
        return found.select("_id", "_h", "kind", "value").limit(0)
    # how often each of these words stands anywhere in the corpus
    flat = F.lower(F.translate(F.coalesce(F.col(text_col), F.lit("")), common.BLANKS, "      "))
    small = common.is_small(words, 200_000)
    spoken = docs.select(F.explode(F.split(flat, " +")).alias("word"))
    total = spoken.join(F.broadcast(words), "word", "left_semi").groupBy("word").count() if small else spoken.groupBy("word").count().join(words, "word")
    total = common.checkpoint(total.withColumnRenamed("count", "total"))
    graph = common.checkpoint(graph.join(F.broadcast(total) if small else total, "word"))
    scores = common.checkpoint(seeds)
    for _ in range(ROUNDS):
        patterns = graph.join(scores, "value").groupBy("side", "word", "kind").agg((F.sum(F.col("score") * F.col("times")) / F.max("total")).alias("confidence"), F.count("*").alias("n"))
        patterns = patterns.where((F.col("n") >= SUPPORT) & (F.col("confidence") >= CONFIDENCE)).withColumn("confidence", F.least("confidence", F.lit(0.99)))
        patterns = common.checkpoint(patterns)
        if patterns.isEmpty():  # then no round finds any
            return found.select("_id", "_h", "kind", "value").limit(0)
        learned = graph.where("seed is null").join(patterns, ["side", "word"]).groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score"))
        scores = common.checkpoint(seeds.unionByName(learned.where(F.col("score") >= CONFIDENCE)))
    sure = scores.where(F.col("score") >= ACCEPT)
    added = edges.where("kind is null").drop("kind").join(patterns.select("side", "word", "kind"), ["side", "word"]).join(sure.select("value", "kind"), ["value", "kind"], "left_semi")
    return added.groupBy("_id", "_h", "value").agg(F.min_by("kind", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))).alias("kind"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone, base (base spans, as an array of kind, start, end, in order) and
    found (all spans, likewise)."""
    added = [*(f"n_{kind}" for kind in KINDS), "base", "found"]
    kept = docs.drop(*[c for c in added if c not in (id_col, text_col)])
    names = {c: f"column_{i}" for i, c in enumerate(kept.columns)}
    plain, id_col, text_col = kept.toDF(*names.values()), names[id_col], names[text_col]
    based = with_base(plain, id_col, text_col)
    extra = score(common.checkpoint(slots(based, text_col)), plain, text_col)
    more = common.checkpoint(extra.groupBy("_id", "_h").agg(F.map_from_entries(F.collect_list(F.struct("value", "kind"))).alias("_more")))  # the identifiers in one text
    more = more.select(F.col("_id").alias("_i"), F.col("_h").alias("_g"), "_more")
    out = based.join(F.broadcast(more) if common.is_small(more, 20_000) else more, (F.col("_id") == F.col("_i")) & (F.col("_h") == F.col("_g")), "left")

    # a text with such identifiers is looked through for all their places, save those that a base span covers
    seeds = F.concat(*[F.col(f"_{kind}") for kind in KINDS])
    free = F.filter(spans_of(F.coalesce(F.col(text_col), F.lit("")), LIKELY), lambda x: F.map_contains_key("_more", x["value"]) & ~F.exists(seeds, lambda y: (y["start"] < x["end"]) & (y["end"] > x["start"])))
    out = out.withColumn("_free", F.when(F.col("_more").isNotNull(), F.transform(free, lambda x: F.struct(F.element_at("_more", x["value"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))))

    def of(kind: str) -> tuple[Column, Column]:
        base = F.transform(f"_{kind}", lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
        return base, F.array_sort(F.concat(base, F.coalesce(F.filter("_free", lambda x: x["kind"] == kind), F.array().cast("array<struct<kind:string,start:int,end:int>>"))))

    out = out.withColumns({f"n_{kind}": F.size(f"_{kind}").cast("long") for kind in KINDS} | {"base": F.concat(*[of(k)[0] for k in KINDS]), "found": F.concat(*[of(k)[1] for k in KINDS])})
    return out.select(*names.values(), *added).toDF(*kept.columns, *added)


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(found: DataFrame, text_col: str = "text") -> DataFrame:
    """The texts with each span (spans that touch or overlap become one) replaced by its kind in angle brackets."""
    by_start = F.array_sort(F.transform("found", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))

    def rewritten(spans: Column) -> Column:
        chunks = F.transform(chunked(spans), lambda c: F.struct(c.alias("spans"), F.array_max(F.transform(c, lambda x: x["end"])).alias("end")))

        def joined(parts: Column) -> Column:
            # where the text of each chunk begins: behind all spans of the chunks before
            begins = F.aggregate(parts, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.greatest(F.get(acc, F.size(acc) - 1), x["end"]))))

            def all_of(starts: Column) -> Column:
                def one(part: Column, i: Column) -> Column:
                    begin = F.get(starts, i)
                    return common.let(F.substr(F.col(text_col), begin + 1, F.greatest(part["end"] - begin, F.lit(0))), lambda text: chunk(part["spans"], begin, text))

                rest = F.substr(F.col(text_col), F.get(starts, F.size(parts)) + 1)
                return F.concat(F.array_join(F.transform(parts, one), ""), rest)

            return common.let(begins, all_of)

        return common.let(chunks, joined)

    def chunk(spans: Column, begin: Column, text: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            kept = F.substr(text, acc["at"] - begin + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
            mark = F.when(x["start"] >= acc["at"], F.concat(F.lit("<"), x["kind"], F.lit(">"))).otherwise(F.lit(""))
            return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["text"], kept, mark).alias("text"))

        return F.aggregate(spans, F.struct(begin.alias("at"), F.lit("").alias("text")), step, lambda acc: acc["text"])

    return found.withColumn(text_col, F.when(F.size("found") > 0, common.let(by_start, rewritten)).otherwise(F.col(text_col)))
