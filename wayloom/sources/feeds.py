"""Transit feeds: finding them in folders, zips and zips within zips, and reading their files as typed-later text."""

from __future__ import annotations

import csv
import io
import os
import zipfile
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MARKER = "agency.txt"


@dataclass(frozen=True)
class Feed:
    label: str
    path: str  # a folder, or the outermost zip
    inner: tuple[str, ...] = ()  # zips within it, one inside the other
    prefix: str = ""  # a folder inside the innermost zip


def discover(path: str) -> list[Feed]:
    """All feeds below a path, in order: any level that holds agency.txt is one, and nothing below it is looked at.
    Zips that can't be read are passed over; a path that isn't there has none."""
    if not os.path.exists(path):
        return []
    if os.path.isfile(path):
        return _in_zip(path, (), os.path.basename(path)) if path.endswith(".zip") else []
    found: list[Feed] = []
    names = sorted(os.listdir(path))
    if MARKER in names:
        return [Feed(os.path.basename(path), path)]
    for name in names:
        full = os.path.join(path, name)
        if os.path.isdir(full) or name.endswith(".zip"):
            found += discover(full)
    return found


def _open(path: str, inner: tuple[str, ...]) -> zipfile.ZipFile:
    archive = zipfile.ZipFile(path)
    for name in inner:
        archive = zipfile.ZipFile(io.BytesIO(archive.read(name)))
    return archive


def _in_zip(path: str, inner: tuple[str, ...], label: str) -> list[Feed]:
    try:
        names = sorted(_open(path, inner).namelist())
    except (zipfile.BadZipFile, OSError):
        return []
    homes = sorted({os.path.dirname(n) for n in names if os.path.basename(n) == MARKER})
    homes = [h for h in homes if not any(h != g and (h + "/").startswith(g + "/" if g else "") for g in homes)]
    found = [Feed(f"{label}/{h}".rstrip("/"), path, inner, h) for h in homes]
    for name in names:
        if name.endswith(".zip") and not any((name + "/").startswith(h + "/" if h else "") for h in homes):
            found += _in_zip(path, (*inner, name), f"{label}/{name}")
    return found


def split_line(line: str, rfc4180: bool = False) -> list[str]:
    """Fields of a line, trimmed. By default a quote only opens or closes quoting and is always dropped; with
    rfc4180 a doubled quote stands for one."""
    if rfc4180:
        return [x.strip() for x in next(csv.reader([line]), [])]
    fields, current, quoted = [], [], False
    for c in line:
        if c == '"':
            quoted = not quoted
        elif c == "," and not quoted:
            fields.append("".join(current).strip())
            current = []
        else:
            current.append(c)
    return [*fields, "".join(current).strip()]


def records(lines: Iterator[str], rfc4180: bool = False) -> Iterator[dict[str, str]]:
    """Rows by header name: blank lines are skipped, the first other line is the header, short rows are padded."""
    header: list[str] | None = None
    for line in lines:
        line = line.removesuffix("\n").removesuffix("\r")
        if not line.strip():
            continue
        if header is None:
            header = [h.strip().removeprefix("﻿") for h in split_line(line.strip().removeprefix("﻿"), rfc4180)]
            continue
        values = split_line(line, rfc4180)
        yield {h: values[i] if i < len(values) else "" for i, h in enumerate(header)}


def _lines(feed: Feed, name: str) -> Iterator[str]:
    if not feed.inner and not feed.path.endswith(".zip"):
        full = os.path.join(feed.path, name)
        if os.path.exists(full):
            with open(full, encoding="utf-8", newline="\n") as f:
                yield from f
        return
    archive = _open(feed.path, feed.inner)
    entry = f"{feed.prefix}/{name}" if feed.prefix else name
    if entry in archive.namelist():
        yield from io.TextIOWrapper(archive.open(entry), encoding="utf-8", newline="\n")


def _header(feed: Feed, name: str, rfc4180: bool) -> list[str]:
    """The names in the first line that isn't blank; none without one."""
    for line in _lines(feed, name):
        if text := line.strip().removeprefix("\ufeff").strip():
            return [h.strip().removeprefix("\ufeff") for h in split_line(text, rfc4180)]
    return []


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """(_ord, value): the lines of a text file that aren't blank, numbered from 0, read in splits by as many tasks as it
    has. A line's number is its place in its split and the lines of the splits before: a row for each split is shuffled."""
    raw = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_block_start").alias("start"))
    rows = raw.where(~F.col("value").rlike(r"^\s*$")).withColumn("m", F.monotonically_increasing_id())  # in a split, one after another
    splits = rows.groupBy("start").agg(F.count("*").alias("n"), F.min("m").alias("m0"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("start", (before - F.col("m0")).alias("shift"))
    return rows.join(F.broadcast(splits), "start").select((F.col("m") + F.col("shift")).alias("_ord"), "value")


def _zipped_lines(spark: SparkSession, feed: Feed, name: str) -> DataFrame:
    """(_ord, value) of a file in a zip: one task unpacks it, as a zip can be, and all tasks share the lines."""

    def lines(batches):
        for _ in batches:
            held, n = [], 0
            for line in _lines(feed, name):
                if line.strip():
                    held.append(line.removesuffix("\n"))
                if len(held) == 50_000:
                    yield pd.DataFrame({"_ord": range(n, n + len(held)), "value": held})
                    held, n = [], n + len(held)
            yield pd.DataFrame({"_ord": range(n, n + len(held)), "value": held})

    return spark.range(0, 1, 1, 1).mapInPandas(lines, "_ord long, value string").repartition(spark.sparkContext.defaultParallelism)


def read(spark: SparkSession, feeds: list[Feed], name: str, columns: list[str], rfc4180: bool = False) -> DataFrame:
    """agency (the feed's ordinal), _ord (the row's place in its file) and the columns as text (null: not in the
    header). Files in folders are read in splits; the paths must be on storage that executors share."""
    schema = ", ".join(["agency long", "_ord long", *(f"{c} string" for c in columns)])

    def split(header: list[str]):
        places = {h: i for i, h in enumerate(header)}

        def run(batches):
            for pdf in batches:
                values = [split_line(line.removesuffix("\r"), rfc4180) for line in pdf["value"]]
                picked = {c: None if c not in places else [v[places[c]] if places[c] < len(v) else "" for v in values] for c in columns}
                yield pd.DataFrame({"agency": pdf["agency"], "_ord": pdf["_ord"] - 1, **picked}, columns=["agency", "_ord", *columns])

        return run

    found = spark.createDataFrame([], schema)
    for i, feed in enumerate(feeds, 1):
        if not (header := _header(feed, name, rfc4180)):
            continue
        plain = not feed.inner and not feed.path.endswith(".zip")
        lines = file_lines(spark, f"file://{os.path.abspath(feed.path)}/{name}") if plain else _zipped_lines(spark, feed, name)
        found = found.unionByName(lines.where("_ord > 0").select(F.lit(i).cast("long").alias("agency"), "_ord", "value").mapInPandas(split(header), schema))
    return found


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame([{**asdict(f), "inner": list(f.inner)} for f in discover(path)], "label string, path string, inner array<string>, prefix string")


def synthetic_stop_times(spark: SparkSession, n: int) -> DataFrame:
    """Deterministic stop times for insert benchmarks."""
    return spark.range(n).select((F.floor(F.col("id") / 20) + 1).alias("trip_pk"), (F.col("id") % 20).alias("stop_sequence"), (F.col("id") % 9000 + 1).alias("stop_pk"), (F.col("id") % 86400 + 18000).alias("arrival_sec"), (F.col("id") % 86400 + 18020).alias("departure_sec"))
