"""Language identification by prediction by partial matching.

Each language has a context tree over bytes, with every context of up to ``ORDER`` bytes that training met.
A byte seen in a context gets its share of the count, one not seen escapes to the next shorter context (method
C, with the bytes already excluded), down to equal shares.  The statistics are frozen after training, so a
text's code length is a sum over its bytes, and the shortest code names the language.

The trees are fitted on a sample of ``SAMPLE`` documents a language, picked by a hash of the id; all else covers
every document and every byte.  Trees are sparse: one sorted array of the bytes seen in the contexts of an order, and
one of their escapes, so their size follows the sample and not the number of languages times contexts.

Defined cases
- null text, or text without a letter: ``und`` with score 0; so too where nothing could be learnt;
- a null language teaches nothing; equal code lengths: the first language in order of code points;
- repeated rows: each is predicted, and counted if it is in the sample; an empty table gives an empty result; other
  columns are not read; a very long text is read in spans, whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, materialize, small_side

FOLDS = 4
HELD_OUT = 2
#: Documents a language that the trees are fitted on, about.
SAMPLE = 2000
#: Bytes of the longest contexts, at most seven.
ORDER = 3
#: Numbers in the memory of code lengths of a task, over all languages.
MEMORY = 1 << 22
#: Bytes of a text that are looked up at once.
SPAN = 1 << 20
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")


def grams(text: str) -> np.ndarray:
    """Every byte of a text with the ``ORDER`` bytes before it, as one number; line ends stand before the text."""
    x = np.frombuffer(b"\n" * ORDER + text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    out = np.zeros(max(0, len(x) - ORDER), np.uint64)
    for k in range(ORDER + 1):
        out = (out << np.uint64(8)) | x[k : k + len(out)]
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, 200):
            batch = whole.slice(start, 200)
            by_lang: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    by_lang.setdefault(lang, []).append(grams(text))
            for lang, found in by_lang.items():
                values, counts = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values)), pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], names=["lang", "gram", "n"])


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, at = np.unique(keys, return_inverse=True)
    return values, np.bincount(at, n, minlength=len(values))


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each wanted key is there, and its value (of another key where it is not)."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, values[at]


class Tree:
    """One language: for each order, bits of the bytes seen in a context, and bits of a context's escape."""

    def __init__(self, gram: np.ndarray, n: np.ndarray, symbols: int):
        self.uniform = np.log2(symbols)
        self.orders: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        byte = np.uint64(8)
        for order in range(ORDER + 1):
            keys, count = _summed(gram & np.uint64((1 << 8 * (order + 1)) - 1), n)
            contexts, at = np.unique(keys >> byte, return_inverse=True)
            total, kinds = np.bincount(at, count), np.bincount(at)
            # what the next shorter context gives to the bytes that are excluded
            excluded = np.bincount(at, np.exp2(-self._bits(keys, order - 1)))
            room = np.clip(1 - excluded, 0, 1)
            full = room < 1e-12  # nothing is left to escape to
            whole = np.where(full, total, total + kinds)
            bits = np.log2(whole)[at] - np.log2(count)
            escape = np.where(full, np.inf, np.log2(np.where(full, 1, room)) + np.log2(whole) - np.log2(kinds))
            self.orders.append((keys, bits.astype(np.float32), contexts, escape.astype(np.float32)))

    def _bits(self, gram: np.ndarray, order: int) -> np.ndarray:
        """Code lengths of grams of ``order`` bytes and one."""
        out = np.zeros(len(gram))
        open_ = np.arange(len(gram))
        for k in range(order, -1, -1):
            keys, bits, contexts, escape = self.orders[k]
            some = gram[open_] & np.uint64((1 << 8 * (k + 1)) - 1)
            hit, value = _lookup(keys, bits, some)
            out[open_[hit]] += value[hit]
            open_, some = open_[~hit], some[~hit]
            if not len(open_):
                return out
            known, value = _lookup(contexts, escape, some >> np.uint64(8))
            out[open_[known]] += value[known]
        out[open_] += self.uniform
        return out

    def bits(self, gram: np.ndarray) -> np.ndarray:
        return self._bits(gram, ORDER)


class Model:
    """The trees of all languages; ``symbols`` is the number of bytes that training met, and one for all others."""

    def __init__(self, found: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(found)
        seen = np.unique(np.concatenate([g & np.uint64(255) for g, _ in found.values()]))
        self.seen = np.zeros(256, bool)
        self.seen[seen.astype(int)] = True
        self.symbols = len(seen) + 1
        self.trees = [Tree(*found[x], self.symbols) for x in self.langs]
        self._memory()

    def _memory(self) -> None:
        """Grams met before, one in a slot, and their code lengths."""
        self.shift = np.uint64(64 - max(8, int(np.log2(MEMORY / len(self.langs)))))
        slots = 1 << (64 - int(self.shift))
        self.met = np.full(slots, np.iinfo(np.uint64).max, np.uint64)
        self.known = np.zeros((slots, len(self.langs)), np.float32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("met", "known")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._memory()

    def bits(self, gram: np.ndarray) -> np.ndarray:
        """Code lengths of grams, a column a language; all bytes that training has not met count as one."""
        return np.stack([t.bits(gram) for t in self.trees], axis=1)

    def lengths(self, text: str) -> np.ndarray:
        """Code length of a whole text in each language."""
        gram = grams(text)
        out = np.zeros(len(self.langs))
        for at in range(0, len(gram), SPAN):
            some = gram[at : at + SPAN]
            slot = (some * np.uint64(0x9E3779B97F4A7C15)) >> self.shift
            wrong = self.met[slot] != some
            if wrong.any():
                new = np.unique(some[wrong])
                place = (new * np.uint64(0x9E3779B97F4A7C15)) >> self.shift
                self.met[place], self.known[place] = new, self.bits(new)
                wrong = self.met[slot] != some  # another gram has the slot
            out += self.known[slot[~wrong]].sum(axis=0, dtype=np.float64)
            if wrong.any():
                out += self.bits(some[wrong]).astype(np.float32).sum(axis=0, dtype=np.float64)
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and its share of the total probability."""
        if not text or not self.langs or not LETTER.search(text):
            return UNKNOWN, 0.0
        bits = self.lengths(text)
        best = int(bits.argmin())
        return self.langs[best], float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum())


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The trees of all languages of ``docs`` (doc_id, lang, text); None where there are none."""
    docs = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    # one row a language; texts must not be dealt by language
    some = docs.join(small_side(materialize(sizes, "languages")), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) * F.col("rows") < F.lit(float(sample) * (1 << 30)))
    counts = some.select("lang", "text").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = counts.toArrow()  # at most a sample's distinct runs of four bytes
    if not table.num_rows:
        return None
    lang = table.column("lang").combine_chunks().dictionary_encode()
    code, gram, n = lang.indices.to_numpy(), table.column("gram").to_numpy().view(np.uint64), table.column("n").to_numpy().astype(float)
    order = np.argsort(code, kind="stable")
    parts = np.split(order, np.cumsum(np.bincount(code))[:-1])
    return Model({x: (gram[at], n[at]) for x, at in zip(lang.dictionary.to_pylist(), parts, strict=True)})


def _predictor(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = model.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                found = [trees.predict(t) if trees else (UNKNOWN, 0.0) for t in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                    names=["doc_id", "held_out", "lang_pred", "score"],
                )

    return run


def identify(docs: DataFrame, *, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    held = F.coalesce(fold() % FOLDS == HELD_OUT, F.lit(False))
    trees = train(docs.where(~held).select("doc_id", "lang", "text"), sample)
    model = docs.sparkSession.sparkContext.broadcast(trees)  # 12 bytes for each run of up to ORDER + 1 bytes that differs within a language's sample
    return docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(_predictor(model), "doc_id long, held_out boolean, lang_pred string, score double")
