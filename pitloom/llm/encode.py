"""Token ids of every text of a corpus."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitloom.llm.bpe import encoder, read_vocabulary, text_of


def encode_corpus(df: DataFrame, id_column: str, text_column: str, path: str | None = None, batch_ids: int = 1 << 20) -> DataFrame:
    """(id, ids): one row for every row, ``ids`` a list of int without special tokens, whose strings are ordinary text.

    Null and empty texts give an empty list; bytes that are no UTF-8 count as U+FFFD; repeated ids are encoded row by row.
    One narrow pass without a shuffle: texts go to Python in Arrow batches, ids come back as one flat buffer of at most about
    ``batch_ids`` ids (or one text). ``path`` names a vocabulary file, read on the driver and sent to the workers.
    """
    vocabulary = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    schema = T.StructType([T.StructField(id_column, df.schema[id_column].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary.value).encode

        def packed(keys: pa.Array, offsets: list[int], flat: array) -> pa.RecordBatch:
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if len(flat) else np.empty(0, np.int32)))
            return pa.RecordBatch.from_arrays([keys, ids], [id_column, "ids"])

        for batch in batches:
            begin, offsets, flat = 0, [0], array("i")
            for k, raw in enumerate(batch.column(1)):
                flat.extend(encode(text_of(raw.as_py())))
                offsets.append(len(flat))
                if len(flat) >= batch_ids:
                    yield packed(batch.column(0).slice(begin, k + 1 - begin), offsets, flat)
                    begin, offsets, flat = k + 1, [0], array("i")
            if begin < batch.num_rows:
                yield packed(batch.column(0).slice(begin), offsets, flat)

    return df.select(id_column, F.col(text_column).cast("binary").alias("_text")).mapInArrow(run, schema)
