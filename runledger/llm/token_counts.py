"""Token counts of whole texts under a public byte-level BPE vocabulary."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.llm.tokens import merges, string_steps


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_bytes, n_tokens, over_limit (more than `limit` tokens).

    Pre-tokens of a batch of texts are held as ragged arrays; in each step every pre-token applies its pair of lowest
    rank, and the symbols that are left are counted. No shuffle. A null text is the empty text, which has no tokens; a
    null id stays null; repeated rows stay; other columns of `docs` are not read.
    """
    schema = T.StructType([
        T.StructField("id", docs.schema[id].dataType), T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
    ])

    def count(batches):
        table = merges(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n_bytes, n_tokens = [], []
            for _, part in string_steps(texts):
                n_bytes += [len(t.encode()) for t in part]
                n_tokens += table.counts(part).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], ["id", "n_bytes", "n_tokens"])

    counted = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(count, schema)
    return counted.select(F.col("id").alias(id), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
