"""Problem 6: encoding of a whole corpus, and the token counts that problems 7 and 8 build on.

Short texts are encoded where they are read, without a shuffle. Texts above ``long_chars`` are cut
into parts that are spread over the cluster, encoded in parallel, brought together by document
and joined as a tree: each join re-encodes growing windows until both sides agree (vocabulary.py).

Defined cases: null and empty text give an empty list (0 tokens); strings that look like special
tokens are ordinary text; repeated rows stay repeated rows; a null id is kept; lone surrogates are
encoded as U+FFFD. Other columns are not read, so they can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborgrid.llm import vocabulary as V

LONG_CHARS = 16384


def _id_field(df: DataFrame, id_col: str) -> T.DataType:
    return df.schema[id_col].dataType


def _lists(rows: list[list[int]]) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = np.fromiter((i for r in rows for i in r), dtype=np.int32, count=int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _encoder(path: str, id_col: str, text_col: str, count_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = V.load(path)
        for b in batches:
            texts = b.column(text_col)
            # slices keep a batch's ids within a few MB, whatever the texts hold
            for at in range(0, b.num_rows, 1000):
                ids = [voc.encode(t) for t in texts.slice(at, 1000).to_pylist()]
                out = pa.array([len(i) for i in ids], pa.int32()) if count_only else _lists(ids)
                yield pa.RecordBatch.from_arrays([b.column(id_col).slice(at, 1000), out], [id_col, "n_tokens" if count_only else "ids"])

    return run


def _cutter(id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, key, text in zip(b.column("_row").to_pylist(), b.column(id_col), b.column(text_col).to_pylist()):
                parts = V.cut_parts(text)
                for at in range(0, len(parts), 64):
                    some = parts[at : at + 64]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row] * len(some), pa.int64()), pa.array([key.as_py()] * len(some), key.type), pa.array([len(text)] * len(some), pa.int64()), pa.array(range(at, at + len(some)), pa.int32()), pa.array(some, pa.string())],
                        ["_row", id_col, "_n", "_seq", "_part"],
                    )

    return run


def _part_encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = V.load(path)
        for b in batches:
            ids = _lists([voc.encode_part(t) for t in b.column("_part").to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, ids], [*b.schema.names, "ids"])

    return run


def _joiner(path: str, id_col: str, count_only: bool):
    def run(t: pa.Table) -> pa.Table:
        voc = V.load(path)
        rows = sorted(zip(t.column("_seq").to_pylist(), t.column("_part").to_pylist(), t.column("ids").to_pylist()), key=lambda r: r[0])
        ids = voc.join_all([(p, i) for _, p, i in rows])[1]
        out = pa.array([len(ids)], pa.int32()) if count_only else _lists([ids])
        return pa.table([t.column(id_col).slice(0, 1), out, t.column("_copies").slice(0, 1)], [id_col, "n_tokens" if count_only else "ids", "_copies"])

    return run


def encode_corpus(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = V.DEFAULT_VOCABULARY, long_chars: int = LONG_CHARS, count_only: bool = False
) -> DataFrame:
    """(id, ids) of each row of ``df``, or (id, n_tokens) with ``count_only``."""
    path = V.vocabulary_path(vocabulary)
    key = _id_field(df, id_col)
    result = T.StructType([T.StructField(id_col, key), T.StructField("n_tokens", T.IntegerType()) if count_only else T.StructField("ids", T.ArrayType(T.IntegerType()))])
    rows = df.select(id_col, text_col)
    is_long = F.coalesce(F.length(text_col), F.lit(0)) > long_chars
    short = rows.where(~is_long).mapInArrow(_encoder(path, id_col, text_col, count_only), result)

    part = T.StructType([T.StructField("_row", T.LongType()), T.StructField(id_col, key), T.StructField("_n", T.LongType()), T.StructField("_seq", T.IntegerType()), T.StructField("_part", T.StringType())])
    long = rows.where(is_long).withColumn("_row", F.xxhash64(id_col, text_col)).mapInArrow(_cutter(id_col, text_col), part)
    # grouping spreads the parts over the cluster and encodes those of repeated rows once
    spread = long.groupBy("_row", id_col, "_n", "_seq", "_part").agg(F.count(F.lit(1)).cast("int").alias("_copies"))
    encoded = spread.mapInArrow(_part_encoder(path), T.StructType([*spread.schema, T.StructField("ids", T.ArrayType(T.IntegerType()))]))
    # the hash of id and text alone might be that of another text
    joined = encoded.groupBy("_row", id_col, "_n").applyInArrow(_joiner(path, id_col, count_only), T.StructType([*result, T.StructField("_copies", T.IntegerType())]))
    again = joined.select(*[f.name for f in result], F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_c")).drop("_c")
    return short.unionByName(again)


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = V.DEFAULT_VOCABULARY, long_chars: int = LONG_CHARS) -> DataFrame:
    """(id, n_tokens) of each row; see :func:`encode_corpus`."""
    return encode_corpus(df, id_col, text_col, vocabulary, long_chars, count_only=True)
