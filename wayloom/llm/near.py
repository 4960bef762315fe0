"""Near duplicates by word n-grams: a grouped prefix join for Jaccard similarity, and its connected components.

A document's set holds the hashes of its distinct word n-grams. Two sets with a similarity of `least` or more share
one of the first few tokens (a prefix) of each, whatever order the tokens are in, as long as it is one order for
all. Tokens come by hash, but those that many sets hold (`heavy`) stand last, so that a template's shingles stand
behind what a document has of its own.

1. Documents with one set become one node; from here on nodes count, however many copies there are.
2. Slots of a hash table are counted in Spark, two bytes for each token, and added up in a tree over tasks: heavy
   slots first, then, in the prefixes that follow from them, those that two nodes share. Both become bitmaps of at most 2^MOST_BITS bits; past that, more
   tokens share a slot, the limit of heavy ones rises with the load, and more tokens pass as shared, never fewer.
3. Nodes with the same prefix and size become one group; a list holds the groups with a token in their prefix. Pairs
   of groups within a list are filtered by size and by where the token stands: with an overlap of o, the first common
   token is among the first n - o + 1 of one and m - o + 1 of the other.
4. Pairs that are left are expanded to pairs of members, filtered by a sketch (the parity of the tokens in each of
   512 slots; sets differ in at least as many tokens as slots), and verified exactly on their texts: of a pair the node
   with more pairs is the hub, whose text goes once to each part of its pairs, ahead of the others in a sorted stream.
5. Of short lists every pair of groups is looked at. In a long list only pairs that may still join two components
   count: all against one (the hub), again with another hub as long as that leaves a quarter fewer pairs, and then
   all that stand outside a list's main component against all others, in blocks of bounded work. So a list of near
   copies is linked by few pairs, and yet no link between two components is missed. Groups stand in by one member
   each until then; the last turn takes all members of groups that lie in several components.

Nothing is capped or sampled, and no document's links or components come to the driver. Sets are compared as 64-bit
hashes; the chance that two different ones of N sets have one fingerprint is below N^2 / 2^65.

Defined results: null, empty and blank texts have no set, n_shingles 0, and are linked with nothing; shorter texts
than n words have their whole sequence as the one shingle. A null id never names a component (it is null if all ids
are). Extra columns pass through; columns named as the result's are replaced.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, components

WORDS, LEAST = 5, 80  # words in a shingle; least similarity in per cent
HEAVY = 6  # a token that so many nodes hold among their first tokens is heavy
SHORT = 8  # groups in a list all of whose pairs are looked at in the first turn
LEAST_BITS, MOST_BITS = 18, 29  # of a bitmap's size; 64 MB at most
SKETCH = 8  # words of 64 bits in a sketch
BLOCK = 1 << 22  # pairs of a long list that one key of the last turn looks at
FEW = 512  # looks for each entry of the long lists left, up to which the last turn comes at once
SMALL = 500_000  # rows of 16 bytes each, at most, that are broadcast
HELD = 1 << 21  # tokens that a task holds before it passes them on
RACK = 256  # tasks, or sums of so many, whose counts one group adds up
PART_PAIRS = 1024  # pairs of a hub that are verified together
_SEED = np.uint64(0xA0761D6478BD642F)
_SKETCHES = [f"s{i}" for i in range(SKETCH)]


def shingles(raw: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    starts, stops, counts = common.word_spans(raw, offsets)
    h = common.hash_spans(raw, starts, stops)
    n = len(h)
    grams = np.zeros(n, np.uint64)
    for k in range(words):
        grams[: max(n - k, 0)] = common.mix64(grams[: max(n - k, 0)] * np.uint64(0x9E3779B97F4A7C15) + h[k:] + np.uint64(k))
    out, at = [], 0
    for c in counts.tolist():
        if c >= words:
            g = np.sort(grams[at : at + c - words + 1])
            out.append(g[np.append(True, g[1:] != g[:-1])] if len(g) > 1 else g)
        elif c:
            whole = _SEED + np.uint64(c)
            for x in h[at : at + c]:
                whole = common.mix64(np.array([whole ^ x], np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0]
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out


def fingerprint(s: np.ndarray) -> int:
    """Of a set or a list of hashes, in order."""
    place = np.arange(1, len(s) + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return int(common.mix64(np.array([np.add.reduce(common.mix64(s + place)) ^ np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def sketch(s: np.ndarray) -> np.ndarray:
    """The parity of the number of tokens in each of 64 * SKETCH slots, as words of 64 bits."""
    slot = (s >> np.uint64(40)).astype(np.int64) % (64 * SKETCH)
    return np.packbits((np.bincount(slot, minlength=64 * SKETCH) & 1).astype(np.uint8), bitorder="little").view(np.int64)


def slots_of(tokens: np.ndarray, bits: int) -> np.ndarray:
    return (tokens & np.uint64((1 << bits) - 1)).astype(np.int64)


def marked(bitmap: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Whether each token's slot is set; the bitmap's size is a power of two."""
    place = slots_of(tokens, len(bitmap).bit_length() - 1 + 6)
    return (bitmap[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1


def prefix_size(n: int, least: int = LEAST) -> int:
    return n - -(-least * n // 100) + 1


def prefix(s: np.ndarray, heavy: np.ndarray | None, least: int = LEAST) -> np.ndarray:
    """The first tokens of a set, heavy ones last: enough that similar sets must share one."""
    k = prefix_size(len(s), least)
    if heavy is None or not marked(heavy, s[:k]).any():
        return s[:k]
    last = marked(heavy, s)
    return np.concatenate([s[~last], s[last]])[:k]


def _sets(batches, words: int):
    """(batch, sets) of each slice of the batches."""
    for batch in batches:
        for part in common.slices(batch, "text"):
            yield part, shingles(*common.bytes_of(part.column("text")), words)


def _as_long(values) -> pa.Array:
    return pa.array(np.asarray(values, np.uint64).view(np.int64))


def _lists(ends: list[int], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(ends)]).astype(np.int32)), values)


def close(n: str, m: str, overlap: Column, least: int) -> Column:
    """Whether an overlap that is `overlap` at most is enough for sets of n and m tokens."""
    return (F.col(n) + F.col(m)) * least <= overlap * (100 + least)


def fits(least: int) -> Column:
    """Whether sets of n and m tokens may be similar if a token that both hold stands at `at` in one and q in the other,
    and no common one before. Sizes too far apart never fit."""
    return close("n", "m", F.least(F.col("n") - F.col("at"), F.col("m") - F.col("q")) + 1, least)


def new_here() -> Column:
    """Whether two groups of a list don't share the token before it as well: of a run of common tokens the first one's
    list has the pair, and it fits there if it does here."""
    return F.coalesce(F.col("before") != F.col("p"), F.lit(True))


def sketches_agree(least: int, one: str = "", other: str = "o_") -> Column:
    """Whether sets of n and m tokens with these sketches may be similar; true where a sketch is missing."""
    differing = reduce(lambda x, y: x + y, [F.bit_count(F.col(one + s).bitwiseXOR(F.col(other + s))) for s in _SKETCHES])
    return F.coalesce(close("n", "m", (F.col("n") + F.col("m") - differing) / 2, least), F.lit(True))


class Join:
    """The stages of the join over one table; sets, candidates and links are Spark tables."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, words: int, least: int) -> None:
        self.words, self.least, self.spark = words, least, docs.sparkSession
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
        self.sets = self._emit()

    # --- which tokens are heavy, which are shared -----------------------------------------------

    def _counted(self, bits: int, heavy: np.ndarray | None, most: int) -> DataFrame:
        """(part, block, slots): the slots of each node's first tokens, 2^16 to a block; of one slot `most` from a task's
        hold at most, and of a node's copies in a task one. Without heavy, twice the prefix by hash is taken."""
        words, least, order = self.words, self.least, self.spark.sparkContext.broadcast(heavy)

        def out(held: list[np.ndarray], part: int) -> pa.RecordBatch:
            slot, count = np.unique(slots_of(np.concatenate(held), bits), return_counts=True)
            slot = np.repeat(slot, np.minimum(count, most))
            block, first = np.unique(slot >> 16, return_index=True)
            ends = np.diff(np.append(first, len(slot)))
            return pa.RecordBatch.from_arrays([pa.array([part] * len(block), pa.int32()), pa.array(block.astype(np.int32)), _lists(ends, pa.array(((slot & 65535) - 32768).astype(np.int16)))], names=["part", "block", "slots"])

        def run(batches):
            part, seen, held, n = TaskContext.get().partitionId() // RACK, set(), [], 0
            for _, sets in _sets(batches, words):
                for s in sets:
                    if len(s) and (node := fingerprint(s)) not in seen:
                        seen.add(node)
                        held.append(s[: 2 * prefix_size(len(s), least)] if order.value is None else prefix(s, order.value, least))
                        n += len(held[-1])
                if n >= HELD:
                    yield out(held, part)
                    held, n = [], 0
            if n:
                yield out(held, part)

        return self.docs.select("text").mapInArrow(run, "part int, block int, slots array<short>")

    def _bitmap(self, bits: int, heavy: np.ndarray | None, least_count: int) -> np.ndarray:
        """A bitmap of 2^bits slots with those that are counted so often set. Counts are added up in a tree of groups
        that take RACK tasks, then RACK sums each, so that no group grows with the number of tasks."""
        parts = -(-self.docs.rdd.getNumPartitions() // RACK)
        kind = np.min_scalar_type(least_count)  # sums stop at least_count

        def row(part: int, block: int, counts: np.ndarray, last: bool) -> pd.DataFrame:
            held = np.packbits(counts >= least_count, bitorder="little") if last else np.minimum(counts, least_count).astype(kind)
            return pd.DataFrame({"part": [part // RACK], "block": [block], "held": [held.tobytes()]})

        def counted(pdf: pd.DataFrame) -> pd.DataFrame:
            counts = np.zeros(1 << 16, np.int64)
            for slots in pdf["slots"]:
                counts += np.bincount(slots.astype(np.int64) + 32768, minlength=1 << 16)
            return row(pdf["part"].iloc[0], pdf["block"].iloc[0], counts, parts == 1)

        def added(last: bool):
            def add(pdf: pd.DataFrame) -> pd.DataFrame:
                counts = np.zeros(1 << 16, np.int64)
                for held in pdf["held"]:
                    counts += np.frombuffer(held, kind)
                return row(pdf["part"].iloc[0], pdf["block"].iloc[0], counts, last)

            return add

        blocks = self._counted(bits, heavy, least_count).groupBy("part", "block").applyInPandas(counted, "part int, block int, held binary")
        while parts > 1:
            parts = -(-parts // RACK)
            blocks = blocks.groupBy("part", "block").applyInPandas(added(parts == 1), "part int, block int, held binary")
        bitmap = np.zeros((1 << (bits - 16), 1024), np.uint64)
        for row_ in blocks.select("block", "held").collect():  # 2^bits / 8 bytes in all
            bitmap[row_["block"]] = np.frombuffer(row_["held"], np.uint64)
        return bitmap.ravel()

    def _emit(self) -> DataFrame:
        """(doc_id, text_hash, node, n, grp, sketches, tokens, places) of every row. Sketches, tokens (the prefix tokens
        that may be shared) and places (where they stand in the prefix, from 1 on) are for a node's first row in a task
        that has such tokens."""
        words, least, spark = self.words, self.least, self.spark
        size = self.docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        expected = size // 6 * 2 * (100 - least) // 100 + 1  # tokens counted for heavy ones, at six bytes a word
        bits = int(np.clip((2 * expected).bit_length(), LEAST_BITS, MOST_BITS))
        heavy = self._bitmap(bits, None, HEAVY + 4 * (expected >> bits))
        order, shared = spark.sparkContext.broadcast(heavy), spark.sparkContext.broadcast(self._bitmap(bits, heavy, 2))

        def run(batches):
            seen: set[int] = set()
            for part, sets in _sets(batches, words):
                nodes, groups, sketches, tokens, places = [], [], [], [], []
                for s in sets:
                    nodes.append(fingerprint(s) if len(s) else None)
                    p, held = s[:0], np.zeros(0, np.int64)
                    if len(s) and nodes[-1] not in seen:
                        seen.add(nodes[-1])
                        p = prefix(s, order.value, least)
                        held = np.flatnonzero(marked(shared.value, p))
                    groups.append(fingerprint(np.append(p, np.uint64(len(s)))) if len(held) else None)
                    sketches.append(sketch(s) if len(held) else np.zeros(SKETCH, np.int64))
                    tokens.append(p[held])
                    places.append(held + 1)
                none = np.array([g is None for g in groups])
                kept = [pa.array(np.array([x[i] for x in sketches]), mask=none) for i in range(SKETCH)]
                ends = [len(t) for t in tokens]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_hash"), pa.array(nodes, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(groups, pa.int64()), *kept, _lists(ends, _as_long(np.concatenate(tokens))), _lists(ends, pa.array(np.concatenate(places).astype(np.int32)))],
                    names=["doc_id", "text_hash", "node", "n", "grp", *_SKETCHES, "tokens", "places"],
                )

        schema = f"doc_id long, text_hash long, node long, n long, grp long, {', '.join(f'{s} long' for s in _SKETCHES)}, tokens array<long>, places array<int>"
        return common.checkpoint(self.docs.mapInArrow(run, schema))

    # --- verification ----------------------------------------------------------------------------

    def verify(self, pairs: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The pairs (a, b) of nodes that the sketches don't tell apart, and of these the ones whose sets are similar
        enough; both checkpointed."""
        words, least = self.words, self.least
        row_key = F.xxhash64("doc_id", "text_hash")
        sides = pairs.join(members.drop("grp").withColumnRenamed("node", "a"), "a").join(members.drop("grp").toDF("b", "m", *[f"o_{s}" for s in _SKETCHES]), "b")
        pairs = common.checkpoint(sides.where(sketches_agree(least)).select("a", "b"))
        small = common.is_small(pairs, SMALL // 2)  # two nodes to a pair at most
        hint = F.broadcast if small else lambda x: x
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).groupBy("node").agg(F.count("*").alias("k"))
        ends = common.checkpoint(ends)
        rows = self.sets.where("grp is not null").join(hint(ends), "node", "left_semi").groupBy("node").agg(F.min(row_key).alias("row_key"))
        texts = self.docs.select(row_key.alias("row_key"), "text").join(hint(rows), "row_key").select("node", "text").dropDuplicates(["node"])
        # the end with more pairs is the hub: its text goes once to each part of PART_PAIRS others
        sided = pairs.join(hint(ends.toDF("a", "ka")), "a").join(hint(ends.toDF("b", "kb")), "b")
        first = F.col("ka") >= F.col("kb")
        sided = sided.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("other"), F.ceil(F.greatest("ka", "kb") / PART_PAIRS).cast("int").alias("parts"))
        others = sided.select("hub", F.pmod(F.xxhash64("other"), F.col("parts")).cast("int").alias("part"), "other").join(texts.toDF("other", "text"), "other")
        hubs = sided.groupBy("hub").agg(F.max("parts").alias("parts")).join(texts.toDF("hub", "text"), "hub")
        hubs = hubs.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("other"), "text")
        dealt = others.select("hub", "part", "other", "text").unionByName(hubs).repartition("hub", "part").sortWithinPartitions("hub", "part", "other")

        def check(batches):
            mine = None  # the set of the hub whose others come next
            for part, sets in _sets(batches, words):
                good = []
                for other, s in zip(part.column("other").to_pylist(), sets, strict=True):
                    if other is None:
                        mine = s
                        good.append(False)
                        continue
                    both = len(np.intersect1d(mine, s, assume_unique=True))
                    good.append(100 * both >= least * (len(mine) + len(s) - both))
                yield part.select(["hub", "other"]).filter(pa.array(good, pa.bool_()))

        found = dealt.mapInArrow(check, "hub long, other long").select(F.least("hub", "other").alias("a"), F.greatest("hub", "other").alias("b"))
        return pairs, common.checkpoint(found)

    # --- pairs -----------------------------------------------------------------------------------

    def _first_turn(self, entries: DataFrame, members: DataFrame) -> DataFrame:
        """Pairs (a, b) of nodes: within short lists every pair of groups, in long ones all groups against one, both by
        the groups' first members; and each group's members against the first."""
        key, rest = ["list"], [F.col("grp").alias("g"), F.col("n").alias("m"), F.col("at").alias("q"), F.col("before").alias("p"), F.col("first").alias("y")]
        short, long = entries.where(F.col("held") <= SHORT), entries.where(F.col("held") > SHORT)
        every = short.join(short.select("list", *rest), key).where((F.col("grp") < F.col("g")) & new_here() & fits(self.least))
        hub = long.groupBy("list").agg(F.min_by(F.struct("grp", "n", "at", "before", "first"), F.xxhash64("grp")).alias("h")).select("list", "h.*")
        star = long.join(hub.select("list", *rest), key).where((F.col("grp") != F.col("g")) & fits(self.least))
        inside = members.groupBy("grp").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first <> last").select("grp", "first")
        within = members.join(inside, "grp").where("node <> first").select(F.col("node").alias("x"), F.col("first").alias("y"))
        return _ordered(every.select(F.col("first").alias("x"), "y").unionByName(star.select(F.col("first").alias("x"), "y")).unionByName(within))

    def _hub_turn(self, rows: DataFrame, turn: int) -> DataFrame:
        """Pairs (a, b): all groups outside a list's main component against one inside."""
        inside = rows.where(F.col("comp") == F.col("main"))
        hub = inside.groupBy("list").agg(F.min_by(F.struct(F.col("n").alias("m"), F.col("at").alias("q"), F.col("first").alias("y")), F.xxhash64("grp", F.lit(turn))).alias("h")).select("list", "h.*")
        return _ordered(rows.where(~F.col("comp").eqNullSafe(F.col("main"))).join(hub, "list").where(fits(self.least)).select(F.col("first").alias("x"), "y"))

    def _last_turn(self, rows: DataFrame, known: DataFrame) -> DataFrame:
        """Pairs (a, b) of nodes in two components: members of all pairs of groups of which one stands outside its list's
        main component, and of groups that lie in several components."""
        outside = ~F.col("comp").eqNullSafe(F.col("main"))
        blocks = F.ceil(F.col("work") / BLOCK).cast("int")
        outer = rows.where(outside).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
        inner = rows.select("list", F.pmod(F.xxhash64("grp"), blocks).cast("int").alias("block"), F.col("grp").alias("g"), F.col("n").alias("m"), F.col("at").alias("q"), F.col("before").alias("p"), F.col("comp").alias("other"), outside.alias("out"), *[F.col(s).alias(f"o_{s}") for s in _SKETCHES])
        apart = F.coalesce(F.col("comp") != F.col("other"), F.lit(True))
        pairs = outer.join(inner, ["list", "block"]).where((~F.col("out") & (F.col("grp") != F.col("g")) | (F.col("grp") < F.col("g"))) & apart & new_here() & fits(self.least) & sketches_agree(self.least))
        mixed = known.groupBy("grp").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
        pairs = pairs.select("grp", "g").distinct().unionByName(mixed.select("grp", F.col("grp").alias("g")))
        ends = known.select(F.col("grp").alias("g"), F.col("node").alias("y"), F.col("n").alias("m"), F.col("comp").alias("other"), *[F.col(s).alias(f"o_{s}") for s in _SKETCHES])
        expanded = pairs.join(known, "grp").join(ends, "g").where((F.col("comp") != F.col("other")) & ((F.col("grp") != F.col("g")) | (F.col("node") < F.col("y"))) & sketches_agree(self.least))
        return _ordered(expanded.select(F.col("node").alias("x"), "y"))

    def link(self) -> DataFrame | None:
        """(node, comp) of the nodes that have links; None if there are none."""
        sets = self.sets.where("grp is not null")
        members = common.checkpoint(sets.select("node", "n", *_SKETCHES, "grp").dropDuplicates(["node"]))
        alone = F.min("node") == F.max("node")
        groups = sets.groupBy("grp").agg(F.first("n").alias("n"), F.min("node").alias("first"), alone.alias("alone"), F.first(F.arrays_zip("tokens", "places", F.concat(F.array(F.lit(None).cast("long")), "tokens").alias("before"))).alias("held"))
        spread = groups.select("grp", "n", "first", "alone", F.explode("held").alias("h")).where("h.tokens is not null").select(F.col("h.tokens").alias("list"), F.col("h.places").cast("long").alias("at"), F.col("h.before").alias("before"), "grp", "n", "first", "alone")
        lists = spread.groupBy("list").agg(F.count("*").alias("held"), (~F.min("alone")).alias("mixed")).where("held > 1")
        entries = common.checkpoint(spread.drop("alone").join(lists, "list"))
        tested, good = self.verify(self._first_turn(entries, members), members)
        labels = None if good.isEmpty() else components.connect(good)
        # lists that the first turn has not settled: long ones, and those with groups of several members
        sketched = members.groupBy("grp").agg(*[F.when(alone, F.min(s)).alias(s) for s in _SKETCHES])
        entries = common.checkpoint(entries.where((F.col("held") > SHORT) | F.col("mixed")).join(sketched, "grp"))
        turn, before = 1, float("inf")
        while True:
            known = labelled(members, labels)
            rows = self._open_rows(entries, known)
            lists = rows.groupBy("list").agg(F.first("work").alias("work"), F.count("*").alias("k"))
            work, held = lists.agg(F.coalesce(F.sum("work"), F.lit(0)), F.coalesce(F.sum("k"), F.lit(0))).first()
            last = work <= FEW * held or work > 0.75 * before
            pairs = self._last_turn(rows, known) if last else self._hub_turn(rows, turn)
            new, good = self.verify(pairs.join(tested, ["a", "b"], "left_anti"), members)
            if not good.isEmpty():
                labels = components.connect(good, labels)
            if last:
                return labels
            tested, entries, turn, before = tested.unionByName(new), rows.select(*entries.columns), turn + 1, work

    def _open_rows(self, entries: DataFrame, known: DataFrame) -> DataFrame:
        """entries of the lists with several components, with comp (null: the group lies in several), the list's main
        component, and work: the pairs of which one stands outside it."""
        known = known.groupBy("grp").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
        rows = entries.join(known, "grp").withColumn("comp", F.when(F.col("low") == F.col("high"), F.col("low"))).drop("low", "high")
        by_comp = rows.groupBy("list", "comp").agg(F.count("*").alias("k"))
        sums = by_comp.groupBy("list").agg(F.sum("k").alias("all"), F.max_by(F.struct("comp", "k"), F.when(F.col("comp").isNotNull(), F.struct("k", "comp"))).alias("m"))
        sums = sums.select("list", F.col("m.comp").alias("main"), ((F.col("all") - F.coalesce(F.col("m.k"), F.lit(0))) * F.col("all")).alias("work")).where("work > 0")
        return common.checkpoint(rows.join(sums, "list"))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """members with the component of each node, its own where it has no links."""
    if labels is None:
        return members.withColumn("comp", F.col("node"))
    return members.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def components_of(docs: DataFrame, id_col: str, text_col: str, words: int, least: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, comp) of every row; comp is null for rows without a set."""
    join = Join(docs, id_col, text_col, words, least)
    rows = join.sets.select("doc_id", "text_hash", "node", F.col("n").alias("n_shingles"))
    return labelled(rows, join.link()).drop("node")


def cluster(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: int = LEAST) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    comps = components_of(docs, id_col, text_col, words, least)
    names = comps.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("name"))
    return comps.join(names, "comp", "left").select("doc_id", "n_shingles", F.when(F.col("comp").isNotNull(), F.col("name")).otherwise(F.col("doc_id")).alias("component_id"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: int = LEAST) -> DataFrame:
    """docs with one row of each component: that of the least id (nulls last), of several such rows one. Rows without
    a set all stay."""
    comps = components_of(docs, id_col, text_col, words, least).where("comp is not null")
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    key = F.xxhash64("doc_id", "text_hash")
    marked_ = common.checkpoint(comps.select("comp", order.alias("o"), key.alias("_k")))
    first = marked_.groupBy("comp").agg(F.min("o").alias("f"))
    leaving = common.checkpoint(marked_.join(first, "comp").where("o <> f").select("_k").distinct())
    keyed = docs.withColumn("_k", F.xxhash64(F.col(id_col).cast("long"), F.xxhash64(text_col)))
    kept = keyed.join(F.broadcast(leaving) if common.is_small(leaving, SMALL) else leaving, "_k", "left_anti")
    again = marked_.groupBy("_k").count().where("count > 1").select("_k")
    if not again.isEmpty():  # rows that agree in id and text: of those with a set one stays
        blank = F.coalesce(F.length(F.translate(F.col(text_col), common.BLANKS, "")), F.lit(0)) == 0
        kept = kept.where(~blank).dropDuplicates(["_k"]).unionByName(kept.where(blank))
    return kept.select(*docs.columns)
