"""Language-model scores of documents.

``score`` is a subword lattice likelihood: unigram weights weight all segmentations of the lower-cased text, and a
forward recursion in logs sums them.  The weights are learnt from the training fold (``learnt``): its frequent words are
pieces with their counts, the public vocabulary's pieces have their counts on the best paths of all other words, and a
hundredth of these again by the vocabulary's own weights.  With ``words=0`` these alone count, and the end of a text has
the weight of rank 0.
``base_score`` is a smoothed word unigram over the training fold.

Word counts are a table of the whole training fold.  Words with at least one token in ``RARE`` are broadcast:
there can be no more than ``RARE`` of them, whatever the corpus.  All other words meet their counts in a
shuffled join, where no key can be hot, as no such word has a larger share of the tokens.

A text of more than ``CHUNK`` characters is split like one that is encoded: each chunk yields the log-sum transfer
matrix between its boundary states, and their product is the text's score.  Its words are counted in one task, which
holds them once.

Defined cases
- null text: scored as the empty text, one token (the end);
- a fold or table without training rows: N = V = 0, every token unknown, base log10(0.1 / 0.1) = 0 each;
- repeated rows: each row is scored, and counted if it trains; extra columns are not read.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, materialize
from .lattice import GRAIN, MARK, lattice_of, load_vocabulary, log_sum, product_tree, total
from .sentencepiece_codec import CHUNK, MODEL, chunks_of, in_order, matrices_of

FOLDS = 10
HELD_OUT = 0
ALPHA = 0.1
#: Words with a share of the tokens of at least 1 / RARE are broadcast, so RARE words at most.
RARE = 400_000
#: Words that become pieces, at most: the size of the learnt vocabulary.  The other pieces are counted on all other words.
WORDS = 65_536
#: What the public vocabulary's own weights count, as a share of the pieces of the other words.
PRIOR = 0.01
#: Distinct words that a task counts before it hands on what it has.
FLUSH = 200_000
#: The end of a text as a token; no word holds a space.
END = b" end"
#: Line ends and spaces of the texts are counted beside the words.
LINE, SPACE = b" \n", b"  "


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update(text.lower().split())
            counts[END] += 1
            counts[LINE] += text.count(b"\n")
            counts[SPACE] += text.count(b" ")
            if len(counts) >= FLUSH:
                yield out()
                counts.clear()
    if counts:
        yield out()


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary; END, LINE and SPACE among them) and c over all rows."""
    text = docs.select(F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return text.mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def _paths(vocabulary):
    """Pieces (by their id) and bytes on the best paths of words, as often as the words occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, counts = lattice_of(vocabulary.value), Counter()
        for batch in batches:
            words = [lattice.normalize(w.decode()) for w in batch.column(0).to_pylist()]  # a word is one segment
            counts.update(lattice.tally(words, batch.column(1).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["id", "n"])

    return run


def learnt(table: dict, counts: DataFrame, *, words: int = WORDS) -> dict:
    """The vocabulary with weights from the ``word_counts`` of the training fold.

    Whole words of the counts are pieces if they are no longer than the longest piece: so a split text overlaps no more.
    All words that are not, rarer or longer ones, count on the pieces of their best paths.
    """
    size = max(map(len, table["pieces"]))
    marks = {bytes(r["word"]): r["c"] for r in counts.where(F.col("word").isin(END, LINE, SPACE)).collect()}
    newlines, spaces, ends = marks[LINE], marks[SPACE], marks[END]
    counts = counts.where(~F.col("word").isin(END, LINE, SPACE))
    # n tokens have at most sqrt(2 n) distinct counts
    sizes = counts.where("c > 1").groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("c")).collect()
    least, room = 2, words
    for r in sizes:
        room -= r["n"]
        if room < 0:
            least = r["c"] + 1
            break
    letters = F.col("word").cast("string")
    whole = (F.col("c") >= least) & (F.length(letters) < size) & ~F.contains(letters, F.lit(MARK))
    top = counts.where(whole).collect()  # at most ``words``
    rest = counts.where(~whole).select("word", "c")
    shared = counts.sparkSession.sparkContext.broadcast(table)
    found = {r["id"]: r["n"] for r in rest.mapInArrow(_paths(shared), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}  # one a piece
    prior = max(1.0, PRIOR * sum(found.values()))
    n = {p: found.get(i, 0) + prior * math.exp(w) for p, (i, w) in table["pieces"].items()}
    octets = sum(found.get(i, 0) for i in table["bytes"].values()) + prior * len(table["bytes"]) * math.exp(table["byte_weight"])
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    starts = min(0.5, newlines / max(1, total))  # the share of words taken to follow a line end, without a space mark
    n[MARK] += max(0, spaces + ends - (1 - starts) * total)  # marks before no word
    for r in top:
        word = bytes(r["word"]).decode()
        n[MARK + word] = n.get(MARK + word, 0.0) + r["c"] * (1 - starts)
        if r["c"] * starts >= 1:
            n[word] = n.get(word, 0.0) + r["c"] * starts
    n["\n"] = n.get("\n", 0.0) + newlines + ALPHA
    z = math.log(math.fsum(n.values()) + octets + ends)
    weight = lambda x: round((math.log(x) - z) * GRAIN) / GRAIN
    new = {p: i for i, p in enumerate((p for p in n if p not in table["pieces"]), max(i for i, _ in table["pieces"].values()) + 1)}
    pieces = {p: (table["pieces"][p][0] if p in table["pieces"] else new[p], weight(x)) for p, x in n.items()}
    return {"pieces": pieces, "bytes": table["bytes"], "byte_weight": weight(octets / len(table["bytes"])), "end_weight": weight(ends)}


SCORED = "key binary, row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, tf long"


def _marginal(end: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group, matrices = in_order(group)
        return pd.DataFrame({"row": group["row"][:1], "score": [(total(product_tree(matrices, log_sum)) + end) / math.log(10)]})

    return run


def _scorer(vocabulary, frequent, whole_texts: bool):
    """Counts and scores of texts; of giant ones no score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, known = lattice_of(vocabulary.value), frequent.value
        end, ln10 = lattice.end_weight, math.log(10)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                rows = batch.column(0).to_pylist()
                keys, key_rows, tfs, sizes, n_known, base = [], [], [], [], [], []
                texts = [text.lower() for text in batch.column(3).to_pylist()]
                scores = [None] * len(texts)
                if whole_texts:
                    scores = [(x + end) / ln10 for x in lattice.likelihood_all([lattice.normalize(x.decode()) for x in texts])]
                for row, low in zip(rows, texts, strict=True):
                    words = low.split()
                    words.append(END)
                    sizes.append(len(words))
                    found = [known.get(w) for w in words]
                    values = [x for x in found if x is not None]
                    n_known.append(len(values))
                    base.append(math.fsum(values))
                    if len(values) < len(words):
                        rest = Counter([w for w, x in zip(words, found, strict=True) if x is None])
                        keys += rest.keys()
                        tfs += rest.values()
                        key_rows += [row] * len(rest)
                none, n = len(keys), len(rows)
                columns = [
                    pa.array([f" {r}".encode() for r in rows] + keys, pa.binary()),
                    pa.array(rows + key_rows, pa.int64()),
                    pa.concat_arrays([batch.column(1), pa.nulls(none, pa.int64())]),
                    pa.concat_arrays([batch.column(2), pa.nulls(none, pa.bool_())]),
                    *[pa.array(x + [None] * none, t) for x, t in ((sizes, pa.int64()), (n_known, pa.int64()), (base, pa.float64()), (scores, pa.float64()))],
                    pa.array([None] * n + tfs, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCORED.split(", ")])

    return run


def score(docs: DataFrame, *, model_file: str = MODEL, rare: int = RARE, chunk: int = CHUNK, words: int = 0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    ``words`` is how many words the learnt vocabulary may have; with 0 the public one is taken as it is.
    """
    spark = docs.sparkSession
    held = F.coalesce(fold() % FOLDS == HELD_OUT, F.lit(False))
    docs = docs.select("doc_id", held.alias("held_out"), "text")
    tallies = materialize(word_counts(docs.where(~F.col("held_out"))), "words")
    counts = tallies.where(~F.col("word").isin(LINE, SPACE))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    floor = total + ALPHA * (distinct + 1)
    often = F.col("c") * rare >= total
    top = counts.where(often).collect()  # at most ``rare`` words
    frequent = spark.sparkContext.broadcast({bytes(r["word"]): math.log10((r["c"] + ALPHA) / floor) for r in top})
    table = load_vocabulary(model_file)
    if words and total:
        table = learnt(table, tallies, words=words)
    vocabulary = spark.sparkContext.broadcast(table)  # a model file of fixed size, and at most ``words`` words

    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    giant = F.coalesce(F.length("text") > chunk, F.lit(False))
    short = docs.where(~giant).select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", text.alias("text"))
    giants = materialize(docs.where(giant).select((-1 - F.monotonically_increasing_id()).alias("row"), "doc_id", "held_out", "text"), "giants")
    scored = short.mapInArrow(_scorer(vocabulary, frequent, True), SCORED)
    scored = scored.unionByName(giants.withColumn("text", text).mapInArrow(_scorer(vocabulary, frequent, False), SCORED))
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    parts = chunks_of(giants.select("row", lower.alias("text")), max(map(len, table["pieces"])) - 1, chunk)
    sums = matrices_of(parts, vocabulary, summed=True).groupBy("row").applyInPandas(_marginal(table["end_weight"]), "row long, score double")
    scored = scored.unionByName(sums.withColumn("key", F.concat(F.lit(" sum "), F.col("row").cast("string")).cast("binary")), allowMissingColumns=True)
    rest = counts.where(~often).select(F.col("word").alias("key"), "c")
    joined = scored.join(rest, "key", "left")
    seen = F.coalesce(F.col("c"), F.lit(0))
    tail = F.col("tf") * F.log10((seen + ALPHA) / F.lit(floor))
    return (
        joined.groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("held_out").alias("held_out"),
            F.max("n_tokens").alias("n_tokens"),
            F.sum(F.coalesce(F.col("n_known"), F.lit(0)) + F.when(seen > 0, F.coalesce("tf", F.lit(0))).otherwise(0)).cast("long").alias("n_known"),
            F.sum(F.coalesce("base", F.lit(0.0)) + F.coalesce(tail, F.lit(0.0))).alias("base_score"),
            F.max("score").alias("score"),
        )
        .select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
    )
