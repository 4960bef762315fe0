"""Repair of conversations: the cheapest edits that make roles alternate, by a dynamic program shared over a trie.

A conversation's rows stand by turn (nulls first), then role, then text. The first fault of a row counts: `blank` (no
word), `duplicate` (role and text seen earlier), `truncated` (the last character but blanks is none of .!?). The edits
are Keep (0), Rerole to user or assistant (3), Delete (4; blank and duplicate rows must go) and Insert of an empty user
or assistant row (3); a truncated row that stays costs 3 more. The roles' initials must read (s?(ua)+)? afterwards. Of
the cheapest edits the ones whose initials are least in ASCII win.

1. Rows go to their conversations in one shuffle; there, two local sorts in turn give duplicates and order. A stream
   over the sorted rows turns each conversation into a signature, one letter for each row: its role and fault, all that
   the edits depend on.
2. Distinct signatures, sorted by range over the cluster, go through a prefix trie, of which a task holds one path: the
   layers of costs of a prefix that the next signature shares are kept, only those behind it are made anew. Signatures
   are read from their last row on, and a layer holds the costs to go: ties are decided from the front, so a choice
   must know all that follows. A terminal node reads its answer off the layers of its path.
3. Answers go back to the conversations, however many share one (a salted join), and head their rows in a second
   stream, which applies them. No task holds a conversation: streams keep a signature (a byte for each row) at most.

Defined results: null roles and texts count as one space. A null turn comes first and takes no part in gaps; rows of a
null conversation id form one conversation. Rows that agree in everything are duplicates of the first. Roles are known
by their initials, case counts; other roles can be reroled or deleted only. Extra columns don't pass through.
"""

from __future__ import annotations

import hashlib
import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import common

COST = {"K": 0, "R": 3, "D": 4, "I": 3}
TRUNCATED = 3  # what keeping a truncated row costs besides
#: States: nothing written yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: The state that a written user or assistant row leads to, for an insertion or a new role.
NEXT = (USER, USER, ASSISTANT, USER)
#: The states that a kept role leads to.
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
LEGAL = {"su", "ua", "au"}
NEVER = 1 << 60
REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal"]
SALTS = 32


# --- the dynamic program -----------------------------------------------------------------------


class Layer:
    """For each state, the least cost of all that follows and the first edit of the way there; '' stands for the end."""

    __slots__ = ("cost", "edit")

    def __init__(self, letter: str | None, after: Layer | None) -> None:
        ways: list[dict[str, int]] = [{} for _ in range(4)]
        for state, way in enumerate(ways):
            if after is None:
                if state in (START, ASSISTANT):
                    way[""] = 0
                continue
            way["D"] = COST["D"] + after.cost[state]
            if letter != "x":
                more = TRUNCATED * letter.isupper()
                way["R"] = COST["R"] + more + after.cost[NEXT[state]]
                if (to := KEPT.get(letter.lower(), {}).get(state)) is not None:
                    way["K"] = COST["K"] + more + after.cost[to]
        self.cost = [min(way.values(), default=NEVER) for way in ways]
        for _ in range(2):  # from any state, two insertions lead to both states that they can lead to
            self.cost = [min(c, COST["I"] + self.cost[NEXT[state]]) for state, c in enumerate(self.cost)]
        for state, way in enumerate(ways):
            way["I"] = COST["I"] + self.cost[NEXT[state]]
        self.edit = [min(e for e, c in way.items() if c == least) for way, least in zip(ways, self.cost, strict=True)]


def answer(path: list[Layer], signature: str) -> tuple[int, str]:
    """Cost and edits of the signature whose layers the path holds, the empty one first."""
    state, left, edits = START, len(signature), []
    while edit := path[left].edit[state]:
        edits.append(edit)
        if edit in "IR":
            state = NEXT[state]
        elif edit == "K":
            state = KEPT[signature[left - 1].lower()][state]
        left -= edit != "I"
    return path[len(signature)].cost[START], "".join(edits)


def answers(signatures):
    """(signature, cost, edits) of sorted signatures; layers of a shared prefix are made once."""
    path, before = [Layer(None, None)], ""
    for signature in signatures:
        shared = len(os.path.commonprefix([before, signature]))
        del path[shared + 1 :]
        for letter in signature[shared:]:
            path.append(Layer(letter, path[-1]))
        before = signature
        yield signature, *answer(path, signature)


def solved(signatures: DataFrame) -> DataFrame:
    """(signature, cost, audit) of the distinct signatures; each task walks the trie of one range of them."""

    def run(batches):
        def each():
            for batch in batches:
                yield from batch.column(0).to_pylist()

        for part in _chunks(answers(each())):
            yield _batch(part, ["signature", "cost", "audit"], [pa.string(), pa.int64(), pa.string()])

    spread = signatures.select("signature").distinct().repartitionByRange("signature").sortWithinPartitions("signature")
    return common.checkpoint(spread.mapInArrow(run, "signature string, cost long, audit string"))


# --- rows and streams ----------------------------------------------------------------------------


def _chunks(rows, most: int = 4096, most_chars: int = 1 << 22):
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= most or chars >= most_chars:
            yield held
            held, chars = [], 0
    if held:
        yield held


def _batch(rows: list, names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _rows(batches, names: list[str]):
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, copies) with faults that the crc32 of `conv_id:turn` decides, of 20 kinds: 0 drops the
    row (copies 0), 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes it the user's."""
    names = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv_col, turn_col)]
    kind = F.crc32(F.concat_ws(":", *names).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in (role_col, text_col))
    return rows.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


class Repair:
    """The repair of one table of rows (conv_id, turn, role, text); `copies` tells how often a row stands, 0 for a row
    that only names its conversation."""

    def __init__(self, rows: DataFrame, copies: Column | None = None) -> None:
        n = F.lit(1) if copies is None else copies
        role, text = (F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text"))
        self.rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role, text, F.explode(F.sequence(F.least(n, F.lit(1)), n)).alias("copy"))
        self.reports = self._reports()

    def _signatures(self) -> DataFrame:
        """(conv_id, gaps, blank, duplicate, truncated, illegal, signature) of every conversation."""
        order = ["turn", "role", "text", "copy"]
        rows = self.rows.repartition("conv_id").withColumn("seen", F.row_number().over(Window.partitionBy("conv_id", "role", "text", F.col("copy") > 0).orderBy("turn", "copy")))
        solid = F.translate("text", common.BLANKS, "")
        fault = F.when(solid == "", "b").when(F.col("seen") > 1, "d").when(~F.right(solid, F.lit(1)).isin(".", "!", "?"), "t").otherwise("")
        names = ["conv_id", "turn", "initial", "fault", "copy"]
        rows = rows.sortWithinPartitions("conv_id", *order).select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), "copy")

        def conversations(batches):
            conv, at = None, None
            for id_, turn, initial, fault_, copy in _rows(batches, names):
                if at is None or id_ != conv:
                    if at is not None:
                        yield at.row(conv)
                    conv, at = id_, Seen()
                if copy:
                    at.add(turn, initial, fault_)
            if at is not None:
                yield at.row(conv)

        def run(batches):
            for part in _chunks(conversations(batches)):
                yield _batch(part, ["conv_id", *REPORT, "signature"], [pa.int64()] * 6 + [pa.string()])

        return common.checkpoint(rows.mapInArrow(run, f"conv_id long, {', '.join(f'{c} long' for c in REPORT)}, signature string"))

    def _reports(self) -> DataFrame:
        """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation."""
        told = self._signatures()
        return common.checkpoint(common.spread_join(told, solved(told), "signature", F.xxhash64("conv_id"), ["signature", "audit"], SALTS).select("conv_id", *REPORT, "cost", "audit"))

    def stream(self) -> DataFrame:
        """(conv_id, place, edit, role, text, report): all rows of a conversation one after another in one partition, its
        report (place 0) first, then what was repaired, from place 1 on."""
        report = F.struct(*REPORT, "cost", "audit")
        heads = self.reports.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(-1).alias("copy"), report.alias("report"))
        both = self.rows.where("copy > 0").withColumn("report", F.lit(None).cast(heads.schema["report"].dataType)).unionByName(heads)
        rows = both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("report").isNull(), "turn", "role", "text", "copy").select("conv_id", "role", "text", "report")

        def run(batches):
            conv, state, place, edits = None, START, 0, iter("")

            def written(edit, role, text):
                nonlocal state, place
                place += 1
                return conv, place, edit, role, text, None

            def repaired():
                nonlocal conv, state, place, edits
                for id_, role, text, told in _rows(batches, ["conv_id", "role", "text", "report"]):
                    if told is not None:
                        yield from rest()
                        conv, state, place, edits = id_, START, 0, iter(told["audit"])
                        yield id_, 0, None, None, None, told
                        continue
                    edit = yield from inserted()
                    if edit == "K":
                        state = KEPT[role[0]][state]
                        yield written(edit, role, text)
                    elif edit == "R":
                        state = NEXT[state]
                        yield written(edit, NAMES[state], text)
                yield from rest()

            def inserted():
                """Writes the insertions that come next and returns the edit after them; None at the end."""
                nonlocal state
                for edit in edits:
                    if edit != "I":
                        return edit
                    state = NEXT[state]
                    yield written(edit, NAMES[state], "")
                return None

            def rest():
                yield from inserted()

            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.struct([*((c, pa.int64()) for c in [*REPORT, "cost"]), ("audit", pa.string())])]
            for part in _chunks(repaired()):
                yield _batch(part, ["conv_id", "place", "edit", "role", "text", "report"], types)

        return rows.mapInArrow(run, f"conv_id long, place long, edit string, role string, text string, report struct<{', '.join(f'{c}: long' for c in [*REPORT, 'cost'])}, audit: string>")

    def turns(self) -> DataFrame:
        """(conv_id, place, edit, role, text): the repaired conversations; place counts from 1 on."""
        return self.stream().where("place > 0").drop("report")

    def digests(self) -> DataFrame:
        """The reports, with repaired_sha256 over the `role:text` of all repaired rows of a conversation, one to a line."""

        def each(batches):
            told, conv, digest = None, None, hashlib.sha256()
            for id_, place, role, text, report in _rows(batches, ["conv_id", "place", "role", "text", "report"]):
                if report is not None:
                    if told is not None:
                        yield conv, *told.values(), digest.hexdigest()
                    told, conv, digest = report, id_, hashlib.sha256()
                    continue
                digest.update(("\n" if place > 1 else "").encode() + f"{role}:{text}".encode())
            if told is not None:
                yield conv, *told.values(), digest.hexdigest()

        names = ["conv_id", *REPORT, "cost", "audit", "repaired_sha256"]

        def run(batches):
            for part in _chunks(each(batches)):
                yield _batch(part, names, [pa.int64()] * 7 + [pa.string()] * 2)

        return self.stream().mapInArrow(run, f"conv_id long, {', '.join(f'{c} long' for c in [*REPORT, 'cost'])}, audit string, repaired_sha256 string")


class Seen:
    """What a stream keeps of the conversation it is in."""

    def __init__(self) -> None:
        self.letters, self.counts, self.illegal = bytearray(), {"b": 0, "d": 0, "t": 0}, 0
        self.least = self.last = self.initial = None
        self.turns = 0

    def add(self, turn: int | None, initial: str, fault: str) -> None:
        if turn is not None and turn != self.last:
            self.least, self.last, self.turns = turn if self.least is None else self.least, turn, self.turns + 1
        if self.initial is not None and self.initial + initial not in LEGAL:
            self.illegal += 1
        self.initial = initial
        if fault:
            self.counts[fault] += 1
        letter = "x" if fault in ("b", "d") else initial if initial in KEPT else "o"
        self.letters += (letter.upper() if fault == "t" else letter).encode()

    def row(self, conv: int | None) -> tuple:
        gaps = 0 if self.least is None else self.last - self.least + 1 - self.turns
        return conv, gaps, self.counts["b"], self.counts["d"], self.counts["t"], self.illegal, self.letters[::-1].decode()
