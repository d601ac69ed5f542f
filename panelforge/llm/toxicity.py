"""Toxicity scores from a subsequence string kernel.

The kernel of two words sums their common subsequences of three letters, each weighted by ``DECAY`` to the
power of its span in both, so an insult with a letter put in, left out or spaced out stays close to the plain
one.  Landmarks are words of the labelled training documents that are frequent in toxic ones and rare in
others, picked so that they cover all toxic documents of the sample and not only the most frequent insults.  A text
is described by its closest word to each landmark, mapped by the inverse root of the landmarks' kernel matrix
(Nystroem), and scored by a linear support vector machine with a fitted sigmoid.

A word's kernels with all landmarks at once are sums over its three-letter subsequences, which are looked up among
those of the landmarks; what is left out by a bound (``Features``) could only be below ``LEAST_KERNEL``, which the
description sets to 0.

Only a bounded, hashed sample of ``EACH`` training documents a class is fitted on; every text is scored whole.

Defined cases
- null or empty text: a text without words, scored like any other;
- several labels of one document: toxic if one says so; null labels teach nothing;
- training documents of one class only, or none: every score is the share of toxic ones (0 without any);
- repeated rows: each is scored, and teaches if it is sampled; an empty table gives an empty result; lang and source are
  not read; words beyond ``WINDOW`` letters are read in overlapping windows, none is cut.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, fold, materialize, small_side, set_aside

FOLDS = 3
HELD_OUT = 1
THRESHOLD = 0.7
#: Training documents of either class that the model is fitted on, about.
EACH = 3000
#: Landmarks at most, and the words that they are picked from: the most telling of the sample.
LANDMARKS = 192
CANDIDATES = 8000
#: Toxic training documents that a landmark occurs in, at least.
LEAST_SUPPORT = 3
#: Landmarks that a toxic document of the sample has, where there are so many, before one is picked for others only.
COVER = 2
LENGTH = 3
DECAY = 0.85
POWER = 2
#: Longer words are read in windows of this many letters that overlap by half.
WINDOW = 20
#: Kernels below this (after POWER) count as 0.
LEAST_KERNEL = 0.05
MEMORY = 200_000
#: Letters of a subsequence are packed into one number.
BITS = np.uint64(21)
PAIRS = 4096
#: More than a model has landmarks.
FEW = 4096
NOT_LETTER = re.compile(r"[\W\d_]+")
SPACED = re.compile(r"(?<!\S)(?:[^\W\d_]\s+){2,}[^\W\d_](?!\S)")


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Subsequence kernels of the pairs of rows of two code matrices; 0 ends a word in ``a`` and ``b``."""
    n, la, lb = len(a), a.shape[1], b.shape[1]
    match = [[((a[:, i] == b[:, j]) & (a[:, i] > 0)).astype(np.float32) for j in range(lb)] for i in range(la)]
    # prior[i][j]: weighted common subsequences of the prefixes, up to their ends
    prior = [[np.ones(n, np.float32)] * (lb + 1) for _ in range(la + 1)]
    zero = np.zeros(n, np.float32)
    for _ in range(LENGTH - 1):
        new = [[zero] * (lb + 1) for _ in range(la + 1)]
        for i in range(la):
            row = zero
            for j in range(lb):
                row = DECAY * row + (DECAY * DECAY) * prior[i][j] * match[i][j]
                new[i + 1][j + 1] = DECAY * new[i][j + 1] + row
        prior = new
    total = np.zeros(n, np.float32)
    for i in range(la):
        for j in range(lb):
            total += (DECAY * DECAY) * prior[i][j] * match[i][j]
    return total


def code(words: list[str], width: int | None = None) -> np.ndarray:
    """Code points of words, a row each, 0 behind the end."""
    ends = np.array([len(w) for w in words], np.int64)
    width = width or int(ends.max(initial=1))
    out = np.zeros((len(words), width), np.uint32)
    out[np.arange(width) < ends[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def kernels(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``kernel`` of many pairs, in blocks of about equal lengths that are cut to those."""
    out = np.empty(len(a), np.float32)
    la, lb = (a > 0).sum(axis=1), (b > 0).sum(axis=1)
    order = np.lexsort((lb, la))
    for k in range(0, len(a), PAIRS):
        rows = order[k : k + PAIRS]
        out[rows] = kernel(a[rows, : la[rows].max()], b[rows, : lb[rows].max()])
    return out


def _own(codes: np.ndarray) -> np.ndarray:
    return kernels(codes, codes)


def similarity(a: np.ndarray, b: np.ndarray, own_a: np.ndarray, own_b: np.ndarray) -> np.ndarray:
    """Normalized kernels of pairs of rows, to the power POWER."""
    return np.clip(kernels(a, b) / np.sqrt(np.maximum(own_a * own_b, 1e-30)), 0, 1) ** POWER


@functools.cache
def _threes(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all three-letter subsequences of a word of ``n`` letters, and their weights."""
    at = np.array(list(combinations(range(n), LENGTH)), np.int64).reshape(-1, LENGTH)
    return at, DECAY ** (at[:, -1] - at[:, 0] + 1.0)


def subsequences(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed three-letter subsequences of words of one length, a row each, and the weights of the columns."""
    at, weight = _threes(codes.shape[1])
    x = codes.astype(np.uint64)
    return (x[:, at[:, 0]] << (BITS + BITS)) | (x[:, at[:, 1]] << BITS) | x[:, at[:, 2]], weight


def letters(token: str) -> str:
    """The letters of a token in lower case."""
    token = token.lower()
    return token if token.isalpha() else NOT_LETTER.sub("", token)


def tokens(text: str) -> list[str]:
    """Words, and runs of single letters as one word each."""
    return text.split() + [NOT_LETTER.sub("", x) for x in SPACED.findall(text)]


class Features:
    """Closest word of a text to each landmark."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        self.own = _own(code(landmarks))
        keys, rows, values = [], [], []
        for m, word in enumerate(landmarks):
            found, weight = subsequences(code([word]))
            keys.append(found[0])
            rows.append(np.full(len(weight), m))
            values.append(weight)
        self.keys, at = np.unique(np.concatenate(keys), return_inverse=True)
        #: Weight of each subsequence in each landmark.
        self.table = np.zeros((len(self.keys), len(landmarks)))
        np.add.at(self.table, (at, np.concatenate(rows)), np.concatenate(values))
        self.memory, self.older = Known(), Known()

    def kernels(self, codes: np.ndarray) -> np.ndarray:
        """Kernels of words of one length with all landmarks."""
        out = np.zeros((len(codes), len(self.landmarks)), np.float32)
        if codes.shape[1] < LENGTH:
            return out
        found, weight = subsequences(codes)
        at = np.searchsorted(self.keys, found)
        at[at == len(self.keys)] = 0
        word, column = np.nonzero(self.keys[at] == found)
        if len(word):
            met, entry = np.unique(at[word, column], return_inverse=True)
            each = np.bincount(word * len(met) + entry, weights=weight[column], minlength=len(codes) * len(met))
            out[:] = each.reshape(len(codes), len(met)) @ self.table[met]
        return out

    def near(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word, landmark and similarity of all pairs with at least ``LEAST_KERNEL``, for words of one length.

        A word's kernel with itself is at least the sum of its subsequences' squared weights, as equal ones only add;
        words that don't reach ``LEAST_KERNEL`` with that are not worked out further.
        """
        both = self.kernels(codes)
        least = (_threes(codes.shape[1])[1] ** 2).sum() if codes.shape[1] >= LENGTH else 1.0
        w, m = np.nonzero(both * both >= LEAST_KERNEL ** (2 / POWER) * 0.999 * least * self.own)
        used, back = np.unique(w, return_inverse=True)
        own = _own(codes[used]) if len(used) else np.zeros(0)
        value = np.clip(both[w, m] / np.sqrt(np.maximum(own[back] * self.own[m], 1e-30)), 0, 1) ** POWER
        good = value >= LEAST_KERNEL
        return w[good], m[good], value[good]

    def _learn(self, new: list[str]) -> None:
        """Remember the similarities of tokens with landmarks, the largest of a long token's parts; most have none."""
        parts: dict[int, tuple[list[str], list[int]]] = {}
        for owner, token in enumerate(new):
            word = letters(token)
            if len(word) >= LENGTH:
                for at in range(0, max(1, len(word) - WINDOW // 2), WINDOW // 2):
                    part = word[at : at + WINDOW]
                    some = parts.setdefault(len(part), ([], []))
                    some[0].append(part)
                    some[1].append(owner)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
        for n, (words, owners) in parts.items():
            step = max(64, min(512, 500_000 // (n * n * n + 1)))
            of = np.array(owners)
            for at in range(0, len(words), step):
                w, m, value = self.near(code(words[at : at + step], n))
                found.append((of[at + w], m, value.astype(np.float32)))
        owner, m, value = (np.concatenate(x) for x in zip(*found, strict=True))
        self.memory.add(new, owner, m, value)

    def of(self, texts: list[str]) -> np.ndarray:
        """One row a text: the largest kernel with each landmark."""
        split = [set(tokens(t)) for t in texts]
        met = set().union(*split)
        if len(self.memory.at) + len(met) > MEMORY:  # what was not met since the last time is forgotten
            self.memory, self.older = Known(), self.memory
        new = met - self.memory.at.keys()
        again = sorted(new & self.older.at.keys())
        self.memory.add(again, *self.older.of(again))
        self._learn(sorted(new.difference(again)))
        out = np.zeros((len(texts), len(self.landmarks)), np.float32)
        for i, x in enumerate(split):
            _, m, value = self.memory.of(x)
            np.maximum.at(out[i], m, value)
        return out


class Known:
    """Similarities of tokens with landmarks: for each token where its entries begin in two arrays, and how many it has."""

    def __init__(self) -> None:
        self.at: dict[str, int] = {}
        self.m, self.value = np.zeros(0, np.int16), np.zeros(0, np.float32)

    def add(self, names: list[str], owner: np.ndarray, m: np.ndarray, value: np.ndarray) -> None:
        """New tokens, and entries by their number; of one token and landmark the largest counts."""
        order = np.lexsort((-value, m, owner))
        owner, m, value = owner[order], m[order], value[order]
        first = np.append(True, (owner[1:] != owner[:-1]) | (m[1:] != m[:-1]))[: len(owner)]
        owner = owner[first]
        counts = np.bincount(owner, minlength=len(names))
        starts = len(self.m) + np.cumsum(counts) - counts
        self.at.update(zip(names, np.where(counts > 0, starts * FEW + counts, 0).tolist(), strict=True))
        self.m, self.value = np.concatenate([self.m, m[first].astype(np.int16)]), np.concatenate([self.value, value[first]])

    def of(self, names) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the name, landmark and similarity of all entries of the names."""
        where = np.fromiter(map(self.at.__getitem__, names), np.int64, len(names))
        counts = where % FEW
        begin = np.cumsum(counts) - counts
        index = np.arange(int(counts.sum())) + np.repeat(where // FEW - begin, counts)
        return np.repeat(np.arange(len(where)), counts), self.m[index], self.value[index]


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Weights, the last of them the offset, of a linear machine with squared hinge loss and balanced classes.

    Coordinate descent in the dual; ``y`` is -1 or 1.
    """
    x = np.hstack([x, np.ones((len(x), 1))])
    cost = np.where(y > 0, c * len(y) / (2 * max(1, (y > 0).sum())), c * len(y) / (2 * max(1, (y < 0).sum())))
    norm = (x * x).sum(axis=1) + 1 / (2 * cost)
    alpha, w = np.zeros(len(y)), np.zeros(x.shape[1])
    order = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(y)):
            g = y[i] * (x[i] @ w) - 1 + alpha[i] / (2 * cost[i])
            a = max(0.0, alpha[i] - g / norm[i])
            if a != alpha[i]:
                w += (a - alpha[i]) * y[i] * x[i]
                moved = max(moved, abs(a - alpha[i]))
                alpha[i] = a
        if moved < 1e-4:
            break
    return w


def fit_sigmoid(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a m + b))) by Newton steps on smoothed targets."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        d, h = p - target, np.maximum(p * (1 - p), 1e-9)
        g = np.array([(d * margin).sum() + 1e-3 * (a - 1), d.sum()])
        hess = np.array([[(h * margin * margin).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


class Model:
    """Landmarks, their Nystroem map, the machine and its sigmoid; or one constant score."""

    def __init__(self, landmarks: list[str], x: np.ndarray, y: np.ndarray, share: float):
        self.landmarks, self.share, self.weights = landmarks, share, None
        if not landmarks or len(set(y.tolist())) < 2:
            return
        codes = code(landmarks)
        own = _own(codes)
        i, j = np.indices((len(landmarks),) * 2).reshape(2, -1)
        gram = similarity(codes[i], codes[j], own[i], own[j]).reshape(len(landmarks), -1).astype(float)
        values, vectors = np.linalg.eigh((gram + gram.T) / 2)
        self.map = vectors / np.sqrt(np.maximum(values, 1e-3)) @ vectors.T
        z = x @ self.map
        quarter = np.arange(len(y)) % 4 == 0  # held back for the sigmoid
        if len(set(y[quarter].tolist())) < 2 or len(set(y[~quarter].tolist())) < 2:
            quarter[:] = False
        first = fit_svm(z[~quarter], y[~quarter])
        held = quarter if quarter.any() else ~quarter
        self.sigmoid = fit_sigmoid(np.hstack([z[held], np.ones((held.sum(), 1))]) @ first, y[held])
        self.weights = fit_svm(z, y)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.share)
        margin = np.hstack([x @ self.map, np.ones((len(x), 1))]) @ self.weights
        a, b = self.sigmoid
        return 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))


def _described(landmarks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(landmarks)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                x = features.of([t or "" for t in batch.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "toxic", "x"])

    return run


def _sample(docs: DataFrame, labels: DataFrame, each: int) -> DataFrame:
    """doc_id, toxic, text of a hashed sample of the training documents, ``each`` a class or about."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = materialize(known.where(fold() % FOLDS != HELD_OUT), "labels")
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}  # two classes
    least = F.lit(0.0)
    for toxic, n in sizes.items():
        least = F.when(F.col("toxic") == toxic, F.lit(min(1.0, each / n))).otherwise(least)
    some = materialize(known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30)) < least), "sampled")
    return docs.select("doc_id", "text").join(small_side(some), "doc_id").select("doc_id", "toxic", "text")


def cover(telling: list[tuple[str, float, list[int]]]) -> list[str]:
    """Words that cover their documents, each ``COVER`` times where it can be, none a near copy of another.

    ``telling`` has words, what they tell, and their toxic documents.  The word with the most (what it tells, by the root
    of the documents not yet covered) is next; a word's worth only falls, so a queue finds it.
    """
    covered: dict[int, int] = {}
    queue = [(-worth * len(docs) ** 0.5, word, worth, docs) for word, worth, docs in telling]
    heapq.heapify(queue)
    kept: list[str] = []
    codes, own = np.zeros((0, WINDOW), np.uint32), np.zeros(0, np.float32)
    while queue and len(kept) < LANDMARKS:
        score, word, worth, docs = heapq.heappop(queue)
        now = -worth * sum(covered.get(d, 0) < COVER for d in docs) ** 0.5
        if now > score:
            if now < 0:
                heapq.heappush(queue, (now, word, worth, docs))
            continue
        one = code([word], WINDOW)
        own_one = _own(one)
        if not len(kept) or similarity(np.repeat(one, len(kept), 0), codes, np.repeat(own_one, len(kept)), own).max() <= 0.6:
            kept.append(word)
            codes, own = np.vstack([codes, one]), np.append(own, own_one)
        for d in docs:  # a near copy's documents are covered by its like
            covered[d] = covered.get(d, 0) + 1
    return kept


def _landmarks(sample: DataFrame) -> list[str]:
    """Words of toxic training documents that tell them from others."""
    word = F.regexp_replace(F.lower("word"), r"[^\p{L}]+", "")
    each = sample.select("doc_id", "toxic", F.explode(F.array_distinct(F.split(F.coalesce("text", F.lit("")), SPACE))).alias("word"))
    each = each.select("doc_id", "toxic", word.alias("word")).where((F.length("word") >= LENGTH) & (F.length("word") <= WINDOW)).distinct()
    # a list of toxic documents has at most the sample's
    counts = each.groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"), F.array_sort(F.collect_list(F.when(F.col("toxic") == 1, F.col("doc_id")))).alias("docs"))
    bad, good = sample.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    if not bad or not good:
        return []
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    telling = counts.where(F.col("bad") >= LEAST_SUPPORT).withColumn("odds", odds).where("odds > 1.5")
    best = telling.orderBy(F.desc(F.col("odds") * F.sqrt("bad")), "word").limit(CANDIDATES).select("word", "odds", "docs").collect()
    return cover([(r["word"], r["odds"], r["docs"]) for r in best])


def train(docs: DataFrame, labels: DataFrame, each: int = EACH) -> Model:
    """The model from the labelled documents outside the held-out fold."""
    sample = materialize(_sample(docs, labels, each), "toxic-sample")
    landmarks = _landmarks(sample)
    rows, bad = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    share = bad / rows if rows else 0.0
    if not landmarks:
        return Model([], np.empty((0, 0)), np.empty(0), share)
    table = sample.mapInArrow(_described(landmarks), "doc_id long, toxic int, x binary").orderBy("doc_id", "x").toArrow()  # a bounded sample
    x = np.frombuffer(b"".join(table.column("x").to_pylist()), np.float32).reshape(table.num_rows, len(landmarks)).astype(float)
    return Model(landmarks, x, np.where(table.column("toxic").to_numpy() > 0, 1.0, -1.0), share)


def _scorer(model):
    """Rows whose last column is the text; the others are passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        features = Features(m.landmarks) if m.weights is not None else None
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
                scores = m.scores(features.of(texts) if features else np.empty((len(texts), 0)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])

    return run


def with_scores(docs: DataFrame, model: Model) -> DataFrame:
    """``docs``, whose last column is text, and a score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # LANDMARKS bounds its size
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(_scorer(shared), f"{fields}, score double")


def score(docs: DataFrame, labels: DataFrame, *, each: int = EACH) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = train(docs, labels, each)
    held = F.coalesce(fold() % FOLDS == HELD_OUT, F.lit(False))
    scored = with_scores(docs.select("doc_id", held.alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, each: int = EACH) -> DataFrame:
    """The documents that are not predicted toxic, with the columns they came with."""
    model = train(docs, labels, each)
    docs, as_they_came = set_aside(docs, "text")
    scored = with_scores(docs.select(*[c for c in docs.columns if c != "text"], "text"), model)
    return as_they_came(scored.where(F.col("score") < THRESHOLD))
