"""What the operators share: tables, checkpoints, and vectorised text kernels."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word, as every contract defines it, and the characters between words.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: The six separators themselves, for translate().
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready_checkpoints(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; only in local mode, where none is named (tests), one of our own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage at files that every executor can read again."""
    ready_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage at a table in the shared checkpoint folder. For loops.

    checkpoint() hands the constraints of a plan on to the plans built upon it. In a loop that renames columns they
    multiply from turn to turn until planning stalls; a table that is read again has none.
    """
    spark = df.sparkSession
    ready_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4()}"
    df.write.parquet(folder)
    table_ = spark.read.schema(df.schema).parquet(folder)
    table_._folder = folder
    return table_


def discard(df: DataFrame | None) -> None:
    """Delete the files of a table that written() made, once nothing reads it any more."""
    if df is not None and (folder := getattr(df, "_folder", None)):
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def n_words(text: Column) -> Column:
    """Words of a text; null and blank texts have none. """
    flat = F.trim(F.translate(F.coalesce(text, F.lit("")), BLANKS, "      "))
    return F.when(flat == "", 0).otherwise(F.size(F.split(flat, " +"))).cast("long")


def let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def is_small(df: DataFrame, most: int = 50_000) -> bool:
    """Whether a checkpointed table has at most `most` rows, so that it may be broadcast."""
    return df.limit(most + 1).count() <= most


def spread_join(rows: DataFrame, found: DataFrame, key: str, by: Column, wide: list[str], salts: int = 16, most_bytes: int = 16 << 20) -> DataFrame:
    """Left join of rows with found, a checkpointed table of distinct keys, where one key may have any share of rows.

    found is broadcast if its columns of variable size (`wide`) and 32 bytes a row besides hold `most_bytes` at most.
    Else each of its rows stands under each of `salts`, over which `by` deals the rows, so that a hot key is split.
    """
    size = found.agg(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in wide), F.lit(32)))).first()[0] or 0
    if size <= most_bytes:
        return rows.join(F.broadcast(found), key, "left")
    salted = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", F.pmod(by, F.lit(salts)).cast("int")).join(salted, [key, "_salt"], "left").drop("_salt")


# --- numpy kernels over Arrow string columns -------------------------------------------------

_IS_BLANK = np.zeros(256, dtype=bool)
_IS_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_MULT = np.uint64(0x9E3779B97F4A7C15)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts one after another, and the offsets of each text (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the number of words of each text. Words never cross texts."""
    return spans_of(~_IS_BLANK[raw], offsets)


def spans_of(solid: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of solid bytes, cut at the ends of texts, and the number in each text."""
    if not len(solid):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(solid))]
    begins[edges] = solid[edges]
    ends[edges - 1] = solid[edges - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.diff(np.searchsorted(starts, offsets))


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_spans(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each span's bytes (ASCII letters folded when lower). It depends on the bytes of the span alone."""
    data = _LOWER[raw] if lower else raw
    length = stops - starts
    short = np.minimum(length, 65).astype(np.uint8)
    order = np.argsort(np.uint8(255) - short, kind="stable")
    begin, falling = starts[order], -short[order].astype(np.int64)
    acc = length[order].astype(np.uint64) * _MULT
    for k in range(int(-falling[0]) if len(falling) else 0):
        active = int(np.searchsorted(falling, -k, side="left"))
        if k < 64:
            acc[:active] = (acc[:active] ^ data[begin[:active] + k]) * np.uint64(0x100000001B3)
            continue
        for i in range(active):  # the rest of the few words of over 64 bytes
            rest = data[begin[i] + k : stops[order[i]]]
            padded = np.zeros(-(-len(rest) // 8) * 8, np.uint8)
            padded[: len(rest)] = rest
            chunk = padded.view("<u8").astype(np.uint64)
            acc[i] ^= np.bitwise_xor.reduce(mix64(chunk + np.arange(1, len(chunk) + 1, dtype=np.uint64) * _MULT))
    out = np.empty(len(order), np.uint64)
    out[order] = mix64(acc)
    return out


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """Parts of a batch that hold about `most` bytes of text each, so that kernels need bounded memory."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, held = 0, 0
    for i, n in enumerate(sizes):
        if i > at and held + n > most:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += int(n)
    if at < batch.num_rows:
        yield batch.slice(at)



# --- learned operators -----------------------------------------------------------------------


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether an id belongs to the rows that are never learned from; false for a null id, which isn't learned from either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


#: Bytes of text that a learning sample holds at most, so that the driver's memory is bounded whatever texts are like.
MOST_BYTES = 48 << 20


def learning_sample(docs: DataFrame, labels: DataFrame, most: int, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = MOST_BYTES) -> list[tuple[str, object]]:
    """At most `most` (text, label) rows for fitting a model in the driver: the labelled ids that come first by hash, as
    far as their texts hold `most_bytes` in all.

    labels: (id, label) in this order. The choice is made on ids and sizes; whole texts are read for the chosen ids
    only. Of repeated ids one text and label counts.
    """
    ids = labels.toDF("_id", "_label").where("_id is not null").groupBy("_id").agg(F.min("_label").alias("_label")).where("_label is not null")
    ids = checkpoint(ids.orderBy(F.xxhash64("_id"), "_id").limit(most))
    texts = docs.select(F.col(id_col).alias("_doc"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    found = texts.join(F.broadcast(ids), F.col("_doc") == F.col("_id"))  # at most `most` ids
    sizes = found.groupBy("_id").agg(F.max(F.octet_length("_text")).alias("_size"))
    running = F.sum("_size").over(Window.orderBy(F.xxhash64("_id"), "_id"))  # over `most` rows at most
    chosen = checkpoint(ids.join(F.broadcast(sizes.withColumn("_held", running).where(F.col("_held") <= most_bytes).select("_id")), "_id"))
    rows = texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).groupBy("_id").agg(F.min("_text").alias("_text"), F.min("_label").alias("_label")).collect()
    return [(r._text, r._label) for r in sorted(rows, key=lambda r: r._id)]


def map_texts(docs: DataFrame, text_col: str, keep: list[str], fields: str, score) -> DataFrame:
    """The columns `keep` of docs and the columns `fields`, which score(raw bytes, offsets, Arrow texts) makes."""
    added = T.StructType.fromDDL(fields)
    kept = docs.select(*keep) if text_col in keep else docs.select(*keep, text_col)
    place, n = kept.columns.index(text_col), len(keep)
    schema = T.StructType([*kept.schema.fields[:n], *added.fields])
    names = schema.names

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                texts = part.column(place)
                columns = score(*bytes_of(texts), texts)
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *(pa.array(c) for c in columns)], names=names)

    return kept.mapInArrow(run, schema)
