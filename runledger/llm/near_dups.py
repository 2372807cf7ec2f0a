"""Near-duplicates by MinHash: a multi-index Hamming join of b-bit signatures, links confirmed on whole shingle sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.llm.common import FEW_BYTES, PrimeSpans, Words, column_bytes, mix, staged, texts_in_steps
from runledger.llm.components import components

#: A signature has CHUNKS chunks of WIDTH symbols of 16 bits. Two signatures with at most 2 * CHUNKS - 1 symbols that differ
#: have a chunk with one error at most (pigeonhole), hence a common key among those that leave out one symbol of a chunk.
#: At a similarity of 0.8 a chunk has one error at most with probability 0.655: all twelve fail for 3 links in a million.
CHUNKS, WIDTH = 12, 6
SYMBOLS = CHUNKS * WIDTH
#: Pairs with more differing symbols are not compared in the last step: at a similarity of 0.8 that is 3 links in a billion.
MOST_DIFFERENT = 37
#: Rows that one task of the last step compares with as many others.
BLOCK = 4_096
#: Rounds in which one row of each bucket is compared with all others, before what is left is compared in blocks.
STARS = 2

_RANDOM = np.random.default_rng(20_240_229)
_FACTORS = _RANDOM.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _RANDOM.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of the k-word shingles of each text, one after the other, and their offsets.

    Letters A to Z are lower-cased. A text with fewer than k words has its whole sequence as one shingle, without words none.
    """
    words = Words([t.lower() for t in texts], PrimeSpans)
    at, grams = words.grams(k)
    owner = words.text[at]
    count = np.diff(words.first)
    for n in range(1, k):
        short = np.flatnonzero(count == n)
        if len(short):
            whole_at, whole = words.grams(n)
            own = np.isin(words.text[whole_at], short)
            owner, grams = np.concatenate([owner, words.text[whole_at][own]]), np.concatenate([grams, whole[own]])
    order = np.lexsort((grams, owner))
    owner, grams = owner[order], grams[order]
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (grams[1:] != grams[:-1])
    return grams[fresh], np.concatenate([[0], np.cumsum(np.bincount(owner[fresh], minlength=len(texts)))]).astype(np.int64)


def signatures(grams: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """SYMBOLS 16-bit symbols of each set that is not empty."""
    filled = np.flatnonzero(np.diff(offsets))
    out = np.zeros((len(filled), SYMBOLS), np.uint16)
    if len(filled):
        for j in range(SYMBOLS):
            least = np.minimum.reduceat((grams ^ _MASKS[j]) * _FACTORS[j], offsets[filled])
            out[:, j] = mix(least) & np.uint64(0xFFFF)
    return out


def keys(signs: np.ndarray) -> np.ndarray:
    """One column for each chunk and symbol left out of it."""
    out = np.zeros((len(signs), SYMBOLS), np.uint64)
    wide = signs.astype(np.uint64) + np.uint64(1)
    for key in range(SYMBOLS):
        chunk, out_of = divmod(key, WIDTH)
        h = np.full(len(signs), key + 1, np.uint64)
        for j in range(WIDTH):
            if j != out_of:
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + wide[:, chunk * WIDTH + j])
        out[:, key] = h
    return out.view(np.int64)


def _set_sums(grams: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Two sums over each set, which together stand for it."""
    filled = np.flatnonzero(np.diff(offsets))
    out = []
    for turn in (mix(grams), mix(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5))):
        total = np.zeros(len(offsets) - 1, np.uint64)
        if len(filled):
            total[filled] = np.add.reduceat(turn, offsets[filled])
        out.append(total.view(np.int64))
    return out


def _prints(docs: DataFrame, k: int, id: str, text: str) -> DataFrame:
    """(id, n, set_a, set_b, signature) of whole texts; set_a and set_b together stand for the set."""
    schema = T.StructType([
        T.StructField("id", docs.schema[id].dataType), T.StructField("n", T.LongType()), T.StructField("set_a", T.LongType()),
        T.StructField("set_b", T.LongType()), T.StructField("signature", T.BinaryType())])

    def run(batches):
        for batch in batches:
            for first, part in texts_in_steps(column_bytes(batch.column(1)), FEW_BYTES):
                grams, offsets = shingle_sets(part, k)
                signs = [None] * len(part)
                for i, s in zip(np.flatnonzero(np.diff(offsets)), signatures(grams, offsets), strict=True):
                    signs[i] = s.tobytes()
                columns = [np.diff(offsets), *_set_sums(grams, offsets)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(part)), *map(pa.array, columns), pa.array(signs, pa.binary())], schema.names)

    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(run, schema)


def _keyed(nodes: DataFrame) -> DataFrame:
    """(key, key_no, node): SYMBOLS rows for each node."""
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("key_no", T.ByteType()), nodes.schema["node"]])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                signs = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, SYMBOLS)
                repeat = pa.array(np.repeat(np.arange(len(signs)), SYMBOLS))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys(signs).ravel()), pa.array(np.tile(np.arange(SYMBOLS, dtype=np.int8), len(signs))), part.column(0).take(repeat)],
                    schema.names)

    return nodes.select("node", "signature").mapInArrow(run, schema)


def _sets(docs: DataFrame, wanted: DataFrame, k: int, id: str, text: str) -> DataFrame:
    """(node, grams): the sorted shingle hashes of the documents (node, set_a, set_b), as binary."""
    schema = T.StructType([T.StructField("node", docs.schema[id].dataType), T.StructField("grams", T.BinaryType())])

    def run(batches):
        for batch in batches:
            for first, part in texts_in_steps(column_bytes(batch.column(1)), FEW_BYTES):
                grams, offsets = shingle_sets(part, k)
                own = [grams[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                # of rows that share an id only those with the set that counts
                sums = zip(_set_sums(grams, offsets), (2, 3), strict=True)
                same = np.logical_and(*[s == batch.column(c).slice(first, len(part)).to_numpy() for s, c in sums])
                made = pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(part)), pa.array(own, pa.binary())], schema.names)
                yield made.filter(pa.array(same))

    texts = docs.select(F.col(id).alias("node"), F.col(text).alias("text"))
    return texts.join(wanted, "node").select("node", "text", "set_a", "set_b").mapInArrow(run, schema)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets of distinct values reach a Jaccard similarity, in whole numbers."""
    few, many = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(few) < percent * len(many):
        return False
    common = np.count_nonzero(many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few)
    return 100 * common >= percent * (len(a) + len(b) - common)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among the pairs whose whole sets are similar enough."""

    def run(batches):
        for batch in batches:
            left, right = (batch.column(c).to_pylist() for c in (2, 3))
            keep = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(left, right, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in (0, 1)], ["a", "b"])

    one = sets.select(F.col("node").alias("a"), F.col("grams").alias("grams_a"))
    other = sets.select(F.col("node").alias("b"), F.col("grams").alias("grams_b"))
    both = pairs.join(one, "a").join(other, "b").select("a", "b", "grams_a", "grams_b")
    return both.mapInArrow(run, T.StructType([T.StructField(c, pairs.schema[c].dataType) for c in ("a", "b")]))


def _open_buckets(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Rows (key, key_no, node, label, n) of the buckets that still hold several labels; n counts the bucket's rows."""
    if labels is None:
        marked = rows.select("key", "key_no", "node", F.col("node").alias("label"))
    else:
        marked = rows.select("key", "key_no", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = marked.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("low != high")
    return marked.join(several.select("key", "n"), "key")


def _labels(links: DataFrame) -> DataFrame:
    """(node, label): the smallest neighbour of each linked node, or itself. Nodes of one label are in one component."""
    both = links.union(links.select("b", "a").toDF("a", "b"))
    return both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label"))


def _links_in_blocks(rows: DataFrame, sets: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """Links that join all labels of a bucket which pairs of its rows join; each pair is compared under its first common key.

    Labels joined on the way are not compared again, so a group gives fewer links than it has rows. A bucket of more than BLOCK
    rows is cut into blocks, and every two blocks meet in a group of their own.
    """
    schema = T.StructType([T.StructField(c, rows.schema["node"].dataType) for c in ("a", "b")])
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    cut = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
    full = met.join(signs, "node").join(sets, "node")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        sign = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint16).reshape(-1, SYMBOLS)
        grams = [np.frombuffer(g, np.uint64) for g in table["grams"].to_pylist()]
        part, own = np.unique(table["label"].to_numpy(), return_inverse=True)[1], table["own"].to_numpy()
        key_no, lo, hi = table["key_no"][0].as_py(), table["lo"][0].as_py(), table["hi"][0].as_py()
        left, right = [], []
        for i in range(len(sign) - 1):
            differs = sign[i] != sign[i + 1:]
            errors = differs.reshape(-1, CHUNKS, WIDTH).sum(2)
            chunk = (errors <= 1).argmax(1)
            place = differs.reshape(-1, CHUNKS, WIDTH)[np.arange(len(chunk)), chunk].argmax(1)
            first = (chunk * WIDTH + place == key_no) & (errors.sum(1) <= MOST_DIFFERENT) & (part[i + 1:] != part[i])
            if lo != hi:
                first &= own[i + 1:] != own[i]
            for j in np.flatnonzero(first) + i + 1:
                if part[j] != part[i] and similar(grams[i], grams[j], percent):
                    left.append(i)
                    right.append(j)
                    part[part == part[j]] = part[i]
        node = table["node"].combine_chunks()
        return pa.table({"a": node.take(pa.array(left, pa.int64())), "b": node.take(pa.array(right, pa.int64()))})

    return full.groupBy("key", "lo", "hi").applyInArrow(run, schema)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_shingles, component_id, kept (id = component_id).

    Documents are linked whose sets of distinct k-word shingles have a Jaccard similarity of percent / 100 or more; a component
    holds all that links reach, under its smallest id. Documents without words are linked with nothing. Rows that share an id are
    one document, for which the row with the smallest set hash counts; a row without an id is linked with nothing, its component
    is null, and it is kept.

    Equal sets become one node. Candidate pairs share a key of the multi-index. They are confirmed on whole sets in rounds: the
    smallest row of every bucket is compared with the others of the bucket and then leaves it, and only buckets that still hold
    several labels (parts of components) go on. What is left after STARS rounds is compared pair by pair inside the buckets, so
    that no link between components is lost and no group gives all its pairs as rows.
    """
    rows = staged(_prints(docs, k, id, text), "prints", of_texts=True)
    known = rows.where("id is not null").groupBy("id").agg(F.min(F.struct("set_a", "set_b", "n", "signature")).alias("p")).select("id", "p.*")
    sets_of = known.where("n > 0")
    nodes = staged(sets_of.groupBy("set_a", "set_b", "n").agg(F.min("id").alias("node"), F.min("signature").alias("signature")), "nodes")

    keyed = _keyed(nodes)
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    buckets = staged(keyed.join(shared, "key"), "buckets")
    wanted = nodes.join(buckets.select("node").distinct(), "node", "left_semi").select("node", "set_a", "set_b")
    sets = staged(_sets(docs, wanted, k, id, text), "sets", of_texts=True)

    links, labels = None, None
    for turn in range(STARS + 1):
        buckets = staged(_open_buckets(buckets, labels), "open-buckets")
        if buckets.isEmpty():
            break
        if turn < STARS:
            centres = buckets.groupBy("key").agg(F.min(F.struct("node", "label")).alias("c"))
            buckets = buckets.join(centres, "key").where("node != c.node")
            pairs = buckets.where("label != c.label").select(F.col("c.node").alias("a"), F.col("node").alias("b")).distinct()
            found = _confirmed(pairs, sets, percent)
        else:
            found = _links_in_blocks(buckets, sets, nodes.select("node", "signature"), percent)
        found = staged(found, "near-links", of_texts=True)  # a pair comes with both sets
        links = found if links is None else links.union(found)
        labels = _labels(links)
    if links is None:
        linked = nodes.select("node", F.col("node").alias("component")).limit(0)
    else:
        linked = staged(components(links), "near-components")
    grouped = known.join(nodes.select("set_a", "set_b", "n", "node"), ["set_a", "set_b", "n"], "left").join(linked, "node", "left")
    classes = grouped.select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "node", "id").alias("component_id"))
    return rows.select("id", "n").join(classes.withColumnRenamed("id", "own"), F.col("id") == F.col("own"), "left").select(
        F.col("id").alias(id), F.coalesce("n_shingles", "n").alias("n_shingles"), "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of `docs` that their near-duplicate component keeps; of rows that repeat id and text one, of rows without an id all.

    Texts that share an id are judged each by itself. Where ids repeat so, rows are numbered in the order of (id, text hash) and
    the numbers take the place of the ids. The other columns stay in a struct beside the operator's own, so that no name clashes.
    """
    columns = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    known = docs.where(docs[id].isNotNull()).select(columns.alias("row"), F.col(id).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("hash"))
    names = staged(known.select("id", "hash").distinct(), "names")
    key = "id"
    if not names.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        key = "number"
        numbered = staged(names.orderBy("id", "hash").withColumn(key, F.monotonically_increasing_id()), "numbered")
        known = staged(known.join(numbered, ["id", "hash"]), "named-rows")
    kept = near_duplicates(known, id=key, text="text", **how).where("kept").select(F.col(key).alias("kept")).distinct()
    kept = staged(kept, "kept")
    once = known.select("row", key).dropDuplicates([key])
    return once.join(kept, once[key] == kept["kept"], "left_semi").select("row.*").unionByName(docs.where(docs[id].isNull()))
