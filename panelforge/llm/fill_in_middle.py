"""Fill-in-middle with a piece table.

A document is a list of descriptors (buffer, start, bytes) over two buffers that never change: its text and the
sentinels.  Cutting splits a descriptor, an arrangement permutes the pieces and puts sentinels between them, the inverse
permutation restores the text, and a hash or an output streams over the descriptors.  No text is copied to be cut.

Texts are read as the UTF-8 of an Arrow batch: a unit begins at a byte that is no letter and continues no character, or
at a letter after no letter, which numpy finds for the whole text at once.

Defined cases
- null or empty text: form plain, n 0, the output is empty; one of the sentinels in the text: plain;
- null doc_id: as if written as an empty text; equal rows have equal results; texts are read whole, however long;
- extra columns go along untouched unless they have the name of a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sentinels before prefix, suffix and middle.
SENTINELS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
#: Percent of documents that are transformed, and of those with the suffix first.
RATE, SUFFIX_FIRST = 90, 20
#: The order of the pieces in each form; they are numbered as they stand in the text.
PARTS = ("prefix", "middle", "suffix")
FORMS = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}

TEXT, SENTINEL = 0, 1
TABLE = b"".join(SENTINELS.values())

Piece = tuple[int, int, int]


class PieceTable:
    """Descriptors over a text and the sentinels."""

    def __init__(self, text: memoryview, pieces: list[Piece] | None = None):
        self.buffers = (text, memoryview(TABLE))
        self.pieces = [(TEXT, 0, len(text))] if pieces is None else pieces

    def cut(self, at: int) -> None:
        """Split the descriptor that holds byte ``at`` of the table, so that one begins there (an empty one at an end)."""
        for i, (buffer, start, size) in enumerate(self.pieces):
            if at <= size:
                self.pieces[i : i + 1] = [(buffer, start, at), (buffer, start + at, size - at)]
                return
            at -= size
        raise IndexError("the table ends before the cut")

    def arrange(self, names: tuple[str, ...], order: tuple[str, ...]) -> PieceTable:
        """The pieces, called ``names`` as they stand, in ``order``, each behind its sentinel."""
        pieces: list[Piece] = []
        for name in order:
            mark = SENTINELS[name]
            pieces += [(SENTINEL, TABLE.index(mark), len(mark)), self.pieces[names.index(name)]]
        return PieceTable(self.buffers[TEXT], pieces)

    def stream(self) -> Iterator[memoryview]:
        for buffer, start, size in self.pieces:
            yield self.buffers[buffer][start : start + size]

    def hash(self) -> str:
        digest = hashlib.sha256()
        for part in self.stream():
            digest.update(part)
        return digest.hexdigest()


def units(text: memoryview) -> np.ndarray:
    """The bytes at which the units of a text begin: runs of A-Z and a-z, and single other characters."""
    data = np.frombuffer(text, np.uint8)
    low = data | 0x20
    letter = (low >= ord("a")) & (low <= ord("z"))
    first = (data & 0xC0) != 0x80  # of a character
    first[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(first)


def transformed(text: memoryview, form: str, first: int, last: int, starts: np.ndarray) -> PieceTable:
    """The text as its form has it; prefix and middle end before the units ``first`` and ``last``."""
    table = PieceTable(text)
    if form != "plain":
        ends = [int(starts[u]) if u < len(starts) else len(text) for u in (first, last)]
        table.cut(ends[1])
        table.cut(ends[0])
        table = table.arrange(PARTS, FORMS[form])
    return table


def restored(output: bytes, form: str) -> PieceTable:
    """The text from an output and its form: cut before and after each sentinel, and put back in the order of the text.

    The text of such an output has no sentinels, so the first of each, in the form's order, are those that were put in.
    """
    view = memoryview(output)
    if form == "plain":
        return PieceTable(view)
    at = {name: output.index(SENTINELS[name]) for name in FORMS[form]}
    ends = [at[name] for name in FORMS[form][1:]] + [len(output)]
    found = {name: (TEXT, at[name] + len(SENTINELS[name]), end - at[name] - len(SENTINELS[name])) for name, end in zip(FORMS[form], ends, strict=True)}
    return PieceTable(view, [found[name] for name in PARTS])


def _views(column: pa.Array) -> list[memoryview]:
    """The UTF-8 of each text, without copies; null is empty."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1].tolist()
    view = memoryview(data) if data is not None else memoryview(b"")
    return [view[a:b] if ok else view[:0] for a, b, ok in zip(ends, ends[1:], column.is_valid().to_pylist(), strict=False)]


def _characters(part: memoryview) -> int:
    return int(((np.frombuffer(part, np.uint8) & 0xC0) != 0x80).sum())


RESULTS = ("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output")
HASHES = ("_h1", "_h2", "_h3", "_h4")


def _arranger(with_output: bool, rate: int, suffix_first: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            hashes = zip(*[batch.column(h).to_pylist() for h in HASHES], strict=True)
            for text, (h1, h2, h3, h4) in zip(_views(batch.column("_text")), hashes, strict=True):
                starts = units(text)
                n = len(starts)
                whole = bytes(text)
                form = "plain" if not whole or h3 % 100 >= rate or any(s in whole for s in SENTINELS.values()) else "spm" if h4 % 100 < suffix_first else "psm"
                first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
                table = transformed(text, form, first, last, starts)
                output = b"".join(table.stream()) if form != "plain" else whole
                sizes = (None, None) if form == "plain" else tuple(_characters(table.buffers[TEXT][p[1] : p[1] + p[2]]) for p in (table.pieces[1 + 2 * FORMS[form].index(x)] for x in ("prefix", "middle")))
                rows.append((n, form, *sizes, table.hash(), restored(output, form).hash(), output if with_output else None))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
            made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            made[-1] = made[-1].cast(pa.string())
            kept = [i for i, name in enumerate(batch.schema.names) if name not in ("_text", *HASHES)]
            names = [f"_kept{k}" for k in range(len(kept))]
            last_ = len(made) if with_output else len(made) - 1
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], *made[:last_]], names=[*names, *RESULTS[:last_]])

    return run


def fill_in_middle(docs: DataFrame, *, columns: tuple[str, ...] = ("doc_id",), with_output: bool = True, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``columns`` of ``docs``, then n, form, prefix_chars, middle_chars, the sha256 of output and restored text, and the output.

    The cuts come from the sha256 of ``1:`` and the id, so that reruns agree; ``with_output`` leaves the output out,
    and then no text leaves the tasks.
    """
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    asked = docs.select(*[F.col(c).alias(f"_kept{i}") for i, c in enumerate(columns)], F.col("text").alias("_text"), digest.alias("_digest"))
    group: Callable[[int], Column] = lambda i: F.conv(F.substring("_digest", 8 * i + 1, 8), 16, 10).cast("long")
    asked = asked.select(*[f"_kept{i}" for i in range(len(columns))], "_text", *[group(i).alias(h) for i, h in enumerate(HASHES)])
    kinds = [T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType(), T.StringType(), T.StringType()]
    results = list(zip(RESULTS, kinds, strict=True))[: len(RESULTS) if with_output else -1]
    schema = T.StructType([*asked.schema.fields[: len(columns)], *[T.StructField(name, kind) for name, kind in results]])
    made = asked.mapInArrow(_arranger(with_output, rate, suffix_first), schema)
    return made.select(*[F.col(f"_kept{i}").alias(c) for i, c in enumerate(columns)], *[name for name, _ in results])


def restore(outputs: DataFrame) -> DataFrame:
    """Adds ``text``, rebuilt from the columns output and form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if o is None else b"".join(restored(o.encode(), f).stream()) for o, f in zip(batch.column("output").to_pylist(), batch.column("form").to_pylist(), strict=True)]
            yield batch.append_column("text", pa.array(texts, pa.binary()).cast(pa.string()))

    return outputs.mapInArrow(run, T.StructType([*outputs.schema.fields, T.StructField("text", T.StringType())]))
