"""Token ids in files: every document is a zstandard frame of its own under one shared dictionary.

Layout of a folder, written by Spark's Parquet committer so that a lost executor leaves no half-written file:

* `dictionary/`  one row: its bytes, kind, sha256, the width of an id in bytes, the end id
* `blocks/`      rows of about a megabyte in ascending id order: the sha256 of the dictionary, the frames one after the
                 other, and per document its id, the offset and length of its frame and its number of ids

The arrays of a block are the offset index: `lookup` finds the blocks of its documents by them and decompresses single frames.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.llm.tokens import encoder, string_steps

#: The dictionary is trained on at most so many distinct texts (those of lowest hash under a seed of their own) and so many
#: characters of each, taken from so many places.
SAMPLE_DOCUMENTS = 2_000
SAMPLE_CHARACTERS = 8_000
SAMPLE_PLACES = 8
SAMPLE_SEED = 20_240_301
DICTIONARY_BYTES = 112_640
BLOCK_BYTES = 1 << 20
LEVEL = 3

DICTIONARY = "sha256 string, kind string, bytes binary, id_bytes int, end_id long"


def _with_end(ids: np.ndarray, end_id: int, width: int) -> bytes:
    return np.append(ids, end_id).astype(f"<u{width}").tobytes()


def _spread_out(text: Column) -> Column:
    """SAMPLE_CHARACTERS of a longer text, in pieces that lie evenly from its first character to its last."""
    size = SAMPLE_CHARACTERS // SAMPLE_PLACES
    room = F.length(text) - size
    starts = [(F.floor(room * i / (SAMPLE_PLACES - 1)) + 1).cast("int") for i in range(SAMPLE_PLACES)]
    pieces = F.concat(*[F.substring(text, start, F.lit(size)) for start in starts])
    return F.when(F.length(text) > SAMPLE_CHARACTERS, pieces).otherwise(text)


def train_dictionary(docs: DataFrame, vocabulary: str, end_id: int, width: int, text: str = "text") -> DataFrame:
    """One row with the dictionary. Too few samples to train on: their ids are the dictionary as they are."""
    hashed = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).select("text", F.xxhash64(F.lit(SAMPLE_SEED), "text").alias("h"))
    lowest = hashed.select("h").distinct().orderBy("h").limit(SAMPLE_DOCUMENTS)
    drawn = hashed.join(F.broadcast(lowest), "h", "left_semi").select("h", _spread_out(F.col("text")).alias("text"))
    distinct = drawn.groupBy("h").agg(F.min("text").alias("text"))
    # one row, also of no documents
    sample = distinct.agg(F.sort_array(F.collect_list(F.struct("h", "text"))).alias("s")).select(F.col("s.text").alias("texts"))

    def train(batches):
        samples = []
        for batch in batches:
            for _, part in string_steps(batch.column(0).flatten().to_pylist()):
                samples += [_with_end(x, end_id, width) for x in encoder(vocabulary).encode(part)]
        try:
            made, kind = zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes(), "trained"
        except zstandard.ZstdError:
            made, kind = b"".join(samples)[:DICTIONARY_BYTES], "raw"
        yield pa.RecordBatch.from_pylist([{
            "sha256": hashlib.sha256(made).hexdigest(), "kind": kind, "bytes": made, "id_bytes": width, "end_id": end_id}],
            pa.schema([("sha256", pa.string()), ("kind", pa.string()), ("bytes", pa.binary()), ("id_bytes", pa.int32()), ("end_id", pa.int64())]))

    return sample.mapInArrow(train, DICTIONARY)


@lru_cache(4)
def _dictionary(kind: str, data: bytes) -> zstandard.ZstdCompressionDict | None:
    if not data:
        return None
    how = zstandard.DICT_TYPE_FULLDICT if kind == "trained" else zstandard.DICT_TYPE_RAWCONTENT
    made = zstandard.ZstdCompressionDict(data, dict_type=how)
    made.precompute_compress(level=LEVEL)
    return made


def _load_dictionary(spark: SparkSession, path: str) -> tuple[str, str, bytes, int, int]:
    """The one row of the dictionary, at most DICTIONARY_BYTES."""
    row = spark.read.schema(DICTIONARY).parquet(f"{path}/dictionary").first()
    return row["sha256"], row["kind"], bytes(row["bytes"]), row["id_bytes"], row["end_id"]


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, id: str = "doc_id", text: str = "text") -> None:
    """Encode whole texts, append `end_id` to each, write them in ascending id order.

    Null ids come first; rows of equal id are ordered by a hash of their text, so repeated rows lie side by side. A null
    or empty text holds the end id alone. Other columns of `docs` are not read. An empty table gives a folder without blocks.
    """
    spark = docs.sparkSession
    width = 2 if max(encoder(vocabulary).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    train_dictionary(docs, vocabulary, end_id, width, text).write.parquet(f"{path}/dictionary")
    sha, kind, data, _, _ = _load_dictionary(spark, path)
    id_type = docs.schema[id].dataType
    fields = [
        ("part", T.IntegerType()), ("block", T.IntegerType()), ("before", T.LongType()), ("dictionary_sha256", T.StringType()),
        ("payload", T.BinaryType()), ("ids", T.ArrayType(id_type)), ("offsets", T.ArrayType(T.IntegerType())),
        ("lengths", T.ArrayType(T.IntegerType())), ("n_tokens", T.ArrayType(T.LongType())),
    ]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])

    def encode(batches):
        used = _dictionary(kind, data)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=used) if used else zstandard.ZstdCompressor(level=LEVEL)
        part, block, before = TaskContext.get().partitionId(), 0, 0
        frames, ids, counts = [], [], []

        def flush(id_arrow):
            lengths = [len(f) for f in frames]
            offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]]).tolist()
            columns = [[part], [block], [before], [sha], [b"".join(frames)], [ids], [offsets], [lengths], [counts]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.list_(id_arrow), pa.list_(pa.int32()),
                     pa.list_(pa.int32()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [n for n, _ in fields])

        held, id_arrow = 0, None
        for batch in batches:
            keys, id_arrow = batch.column(0).to_pylist(), batch.column(0).type
            for first, texts in string_steps(batch.column(1).to_pylist()):
                for k, tokens in enumerate(encoder(vocabulary).encode(texts), first):
                    frame = packer.compress(_with_end(tokens, end_id, width))
                    frames.append(frame)
                    ids.append(keys[k])
                    counts.append(len(tokens) + 1)
                    held += len(frame)
                    if held >= BLOCK_BYTES:
                        yield flush(id_arrow)
                        before += sum(counts)
                        block += 1
                        frames, ids, counts, held = [], [], [], 0
        if frames:
            yield flush(id_arrow)

    narrow = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    ordered = narrow.repartitionByRange(F.col("id").asc_nulls_first(), "h").sortWithinPartitions(F.col("id").asc_nulls_first(), "h")
    ordered.select("id", "text").mapInArrow(encode, schema).write.parquet(f"{path}/blocks")


def _part_starts(blocks: DataFrame) -> DataFrame:
    """Ids before each part; one row per part, of which there are as many as shuffle partitions."""
    parts = blocks.groupBy("part").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_start"))


def _unpack(spark: SparkSession, path: str, id: str, wanted: list | None = None) -> DataFrame:
    """Documents of the blocks, or only those of the wanted ids; a task holds one block's ids at a time."""
    sha, kind, data, width, _ = _load_dictionary(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks")
    id_type = blocks.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField(id, id_type), T.StructField("start", T.LongType()), T.StructField("ids", T.BinaryType())])
    if wanted is not None:
        blocks = blocks.where(F.arrays_overlap("ids", F.array(*[F.lit(w).cast(id_type) for w in wanted])))
    chosen = None if wanted is None else set(wanted)
    placed = blocks.join(F.broadcast(_part_starts(spark.read.parquet(f"{path}/blocks"))), "part").select(
        (F.col("part_start") + F.col("before")).alias("start"), "dictionary_sha256", "payload", "ids", "offsets", "lengths", "n_tokens")

    def decode(batches):
        used = _dictionary(kind, data)
        unpacker = zstandard.ZstdDecompressor(dict_data=used) if used else zstandard.ZstdDecompressor()
        for batch in batches:
            for k in range(batch.num_rows):
                start, written, payload, keys, offsets, lengths, counts = (c[k].as_py() for c in batch.columns)
                if written != sha:
                    raise ValueError("the blocks were written with another dictionary")
                starts = start + np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
                some = [i for i, key in enumerate(keys) if chosen is None or key in chosen]
                frames = (payload[offsets[i]:offsets[i] + lengths[i]] for i in some)
                ids = [np.frombuffer(unpacker.decompress(f), f"<u{width}").astype("<u4").tobytes() for f in frames]
                own = pa.array([keys[i] for i in some], batch.column(3).type.value_type)
                yield pa.RecordBatch.from_arrays([own, pa.array(starts[some], pa.int64()), pa.array(ids, pa.binary())], schema.names)

    return placed.mapInArrow(decode, schema)


def read_tokens(spark: SparkSession, path: str, id: str = "doc_id") -> DataFrame:
    """Documents of a folder: id, start (ids before it), ids (binary, little-endian unsigned 32-bit, end id included)."""
    return _unpack(spark, path, id)


def digests(spark: SparkSession, path: str, id: str = "doc_id") -> DataFrame:
    """Per document of a folder: id, start, n_tokens, ids_crc32, taken from the ids that were read back."""
    back = read_tokens(spark, path, id)
    return back.select(id, "start", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def lookup(spark: SparkSession, path: str, wanted: list, id: str = "doc_id") -> DataFrame:
    """As `read_tokens` for a few given ids; only their frames are cut out of the blocks and decompressed."""
    return _unpack(spark, path, id, wanted)
