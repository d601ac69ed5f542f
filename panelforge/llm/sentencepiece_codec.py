"""SentencePiece encoding and decoding: the best segmentation into public pieces, and back.

A text of up to ``CHUNK`` characters is one max-plus recursion.  A longer one is split into chunks that
become rows: each yields the transfer matrix between its boundary states (how far a piece reaches over a
boundary), the matrices are combined by the associative max-plus product, which gives the best scores of each
chunk's entry states, and each chunk is then traced back on its own, from every exit state; the states in which
the paths meet pick the one that is used.  The products of one text are a task: a text has at most 2 GB, so they are
some 32,000 matrices of 2 kB.

Defined cases
- null text: no pieces, score 0, ``round_trip`` true; empty text likewise;
- ties between paths: from the end of the text, the longest last piece wins, then the longest before it, and so on; a
  split text has the same pieces as the whole one, as sums of weights are exact (``lattice``);
- characters that are no piece, and space marks in the text, become UTF-8 byte pieces, so decoding is exact;
- repeated rows are encoded each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize
from .lattice import Lattice, entry_scores, exit_states, load_vocabulary, max_plus, product_tree, total

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters in a chunk of a giant text.
CHUNK = 1 << 16
#: Bytes of texts that are split into segments at once; neighbours may all be long, as in a mix by sizes.
TOGETHER = 1 << 19


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


def runs(texts: pa.Array, rows: int = 500, size: int = TOGETHER) -> Iterator[tuple[int, int]]:
    """(first row, rows) of runs of at most ``rows`` texts with at most ``size`` bytes in all, a longer text by itself."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    at = held = 0
    for k, own in enumerate(sizes):
        if k > at and (k - at == rows or held + own > size):
            yield at, k - at
            at, held = k, 0
        held += own
    if at < len(sizes):
        yield at, len(sizes) - at


def _encoder(vocabulary):
    """Encode rows whose last column is the text; the others are passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(vocabulary.value)
        for whole in batches:
            for at, n in runs(whole.column(whole.num_columns - 1)):
                batch = whole.slice(at, n)
                texts = [text or "" for text in batch.column(batch.num_columns - 1).to_pylist()]
                found = lattice.encode_all([lattice.normalize(text) for text in texts])
                scores, ids = [x for x, _ in found], [x for _, x in found]
                good = [lattice.decode(x) == text for x, text in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], pa.array(list(map(len, ids)), pa.int64()), pa.array(scores, pa.float64()), _lists(ids, pa.int32()), pa.array(good)],
                    names=[*batch.schema.names[:-1], "n_pieces", "score", "pieces", "round_trip"],
                )

    return run


def split_text(text: str, size: int, reach: int) -> list[tuple[int, str]]:
    """(characters of its own, chunk with up to ``reach`` more) of a normalized text."""
    n = len(text)
    return [(min(size, n - a), text[a : a + size + reach]) for a in range(0, n, size)]


def _splitter(reach: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = split_text(Lattice.normalize(text), size, reach)
                for at in range(0, len(parts), 64):
                    some = parts[at : at + 64]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row] * len(some), pa.int64()),
                            pa.array(range(at, at + len(some)), pa.int64()),
                            pa.array([b for b, _ in some], pa.int64()),
                            # the stand-in for a space mark has no UTF-8 form of its own
                            pa.array([s.encode("utf-8", "surrogatepass") for _, s in some], pa.binary()),
                        ],
                        names=["row", "chunk", "body", "part"],
                    )

    return run


def _transfers(vocabulary, summed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(vocabulary.value)
        for batch in batches:
            found = [
                lattice.transfer(part.decode("utf-8", "surrogatepass"), body, summed).tobytes()
                for body, part in zip(batch.column("body").to_pylist(), batch.column("part").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("chunk"), pa.array(found, pa.binary())], names=["row", "chunk", "matrix"])

    return run


def matrices_of(parts: DataFrame, vocabulary, summed: bool = False) -> DataFrame:
    """row, chunk and matrix of every chunk."""
    return parts.mapInArrow(_transfers(vocabulary, summed), "row long, chunk long, matrix binary")


def chunks_of(giants: DataFrame, reach: int, size: int) -> DataFrame:
    """row, chunk, body and part of the texts of ``giants`` (row, text), dealt evenly and written."""
    parts = giants.mapInArrow(_splitter(reach, size), "row long, chunk long, body long, part binary")
    return materialize(parts.repartition(F.col("row"), F.col("chunk")), "chunks")


def in_order(group: pd.DataFrame) -> tuple[pd.DataFrame, list[np.ndarray]]:
    """A text's rows in order of chunk, and its matrices."""
    group = group.sort_values("chunk")
    found = [np.frombuffer(m, np.float64) for m in group["matrix"]]
    return group, [m.reshape(int(len(m) ** 0.5), -1) for m in found]


def _combine(group: pd.DataFrame) -> pd.DataFrame:
    group, matrices = in_order(group)
    levels = product_tree(matrices, max_plus)
    return pd.DataFrame({"row": group["row"], "chunk": group["chunk"], "start": [v.tobytes() for v in entry_scores(levels)], "score": total(levels)})


def _traces(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(vocabulary.value)
        for batch in batches:
            cols = batch.to_pydict()
            found = [
                lattice.trace(p.decode("utf-8", "surrogatepass"), b, np.frombuffer(v, np.float64).tolist())
                for p, b, v in zip(cols["part"], cols["body"], cols["start"], strict=True)
            ]
            kinds = pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("chunk"), batch.column("score"), *[pa.array([x[k] for x in found], t) for k, t in enumerate(kinds)]],
                names=["row", "chunk", "score", "entries", "shared", "tails"],
            )

    return run


def _exits(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("chunk")
    return pd.DataFrame({"row": group["row"], "chunk": group["chunk"], "leave": exit_states(group["entries"].tolist())})


def _decoder(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(vocabulary.value)
        for batch in batches:
            texts = [None if ids is None else lattice.decode(ids) for ids in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "text"])

    return run


def decode(encoded: DataFrame, *keep: str, model_file: str = MODEL) -> DataFrame:
    """The ``keep`` columns and the text of ``pieces``; null where there are none at all."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(load_vocabulary(model_file))
    schema = T.StructType([encoded.schema[c] for c in keep] + [T.StructField("text", T.StringType())])
    return encoded.select(*keep, "pieces").mapInArrow(_decoder(vocabulary), schema)


def encode(docs: DataFrame, *keep: str, model_file: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """The ``keep`` columns with n_pieces, score, pieces and round_trip of every text.

    Only giant texts are shuffled: their chunks' matrices, a few kB each, meet by text, then states, and then their ids.
    """
    spark = docs.sparkSession
    table = load_vocabulary(model_file)
    vocabulary = spark.sparkContext.broadcast(table)  # a model file of fixed size
    side = max(map(len, table["pieces"]))
    docs = docs.select(*keep, "text")
    kept = [T.StructField(c, docs.schema[c].dataType) for c in keep]
    out = T.StructType(
        [
            *kept,
            T.StructField("n_pieces", T.LongType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("pieces", T.ArrayType(T.IntegerType())),
            T.StructField("round_trip", T.BooleanType()),
        ]
    )
    giant = F.coalesce(F.length("text") > chunk, F.lit(False))
    short = docs.where(~giant).mapInArrow(_encoder(vocabulary), out)
    # numbered once and written, so that the numbers stay when a stage is redone
    giants = materialize(docs.where(giant).withColumn("_row", F.monotonically_increasing_id()), "giants")
    parts = chunks_of(giants.select("_row", "text"), side - 1, chunk)
    starts = matrices_of(parts, vocabulary).groupBy("row").applyInPandas(_combine, "row long, chunk long, start binary, score double")
    traced = parts.join(starts, ["row", "chunk"]).mapInArrow(_traces(vocabulary), "row long, chunk long, score double, entries array<int>, shared array<int>, tails array<array<int>>")
    traced = materialize(traced, "traces")
    leaves = traced.select("row", "chunk", "entries").groupBy("row").applyInPandas(_exits, "row long, chunk long, leave int")
    traced = traced.join(leaves, ["row", "chunk"]).select("row", "chunk", "score", F.concat("shared", F.element_at("tails", F.col("leave") + 1)).alias("ids"))
    whole = traced.groupBy("row").agg(F.first("score").alias("score"), F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("all"))
    whole = whole.select(F.col("row").alias("_row"), "score", F.flatten("all.ids").alias("pieces"))
    back = decode(whole, "_row", "score", "pieces", model_file=model_file).withColumnRenamed("text", "_decoded")
    long = giants.join(back, "_row").select(
        *keep, F.size("pieces").cast("long").alias("n_pieces"), "score", "pieces", (F.col("_decoded") == F.col("text")).alias("round_trip")
    )
    return short.unionByName(long)
