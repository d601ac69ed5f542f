"""Quality rules on documents and on their hosts.

Each document gets counts and a base verdict.  The failures are then summed by host, the host's failure
rate is shrunk by a beta prior fitted to all hosts, and the host's verdict is joined back.

Defined cases
- null text or text without a word: all counts 0, ``base_failed`` true (fewer than ten words);
- null or blank source: the document has no host, only its own verdict counts;
- repeated rows: each row is judged and counted on its own;
- empty table: empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, materialize, set_aside, small_side

#: Symbols that are counted.
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5
#: A host is rejected if its shrunk failure rate is above this.
MAX_HOST_RATE = 0.5
#: Weight of the prior, in documents, where the hosts do not differ enough to fit one.
WEAK_PRIOR = 10.0
#: A host's key in the join is split this many ways, so that one large host does not fill one task.
SALTS = 16


def host_of(source: Column) -> Column:
    """The host in a URL, or the source as it is, in lower case; null if blank."""
    host = F.regexp_extract(F.lower(F.trim(source)), r"^(?:[a-z][a-z0-9+.\-]*://)?(?:[^/@?#]*@)?([^/:?#]*)", 1)
    return F.when(host != "", host)


def _covered(at: Column) -> Column:
    """Words that windows of ``WINDOW`` words cover; ``at`` has the windows' places in order.  The fold holds two numbers."""
    return F.aggregate(
        at,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")),
        lambda a: a["n"],
    )


def base_rules(docs: DataFrame, *keep: str) -> DataFrame:
    """Counts and base verdict of every document; ``keep`` names further columns to carry.

    All in built-in functions.  Windows are compared by 64-bit hashes; only texts that hold a repeated
    window pay for sorting them: a window is repeated if a neighbour in order of hash has its hash.  The work follows
    n log n of a text's words, whatever repeats in it.

    The result must be written before it is filtered: the optimizer pushes a filter on ``base_failed`` below these
    projections, where it splits the text anew for every window.  ``quality_rules`` and ``drop_low_quality`` do so.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, SPACE), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = docs.select(
        *keep,
        words.alias("_words"),
        lines.alias("_lines"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
    )
    step = step.withColumn("n_words", F.size("_words").cast("long"))
    step = step.withColumn(
        "_hashes",
        F.when(
            F.col("n_words") > WINDOW,
            F.transform(F.sequence(F.lit(1), (F.col("n_words") - (WINDOW - 1)).cast("int")), lambda i: F.xxhash64(F.slice(F.col("_words"), i, WINDOW))),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    step = step.withColumn("_repeats", F.size(F.array_distinct("_hashes")) < F.size("_hashes"))
    tagged = F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.cast("int").alias("i")))
    step = step.withColumn("_sorted", F.when(F.col("_repeats"), F.sort_array(tagged))).drop("_hashes")
    following = F.slice("_sorted", F.lit(2), F.size("_sorted"))
    alike = F.zip_with("_sorted", following, lambda x, y: F.struct(x["i"].alias("i"), F.coalesce(x["h"] == y["h"], F.lit(False)).alias("next")))
    step = step.withColumn("_alike", F.when(F.col("_repeats"), alike)).drop("_sorted")
    before = F.concat(F.array(F.lit(False)), F.transform("_alike", lambda x: x["next"]))
    hits = F.zip_with("_alike", before, lambda x, last: F.when(x["next"] | last, x["i"]))  # null behind the end
    step = step.withColumn("_at", F.when(F.col("_repeats"), F.sort_array(F.filter(hits, lambda i: i.isNotNull())))).drop("_alike")
    step = step.select(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_repeats"), _covered(F.col("_at"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    return step.withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT),
    )


def host_verdicts(rules: DataFrame) -> DataFrame:
    """host, n_docs, n_failed, host_rate, host_failed from rows of (host, base_failed).

    The beta prior is fitted by moments.  With m and v the mean and variance of the hosts' rates, and q the mean of
    1 / documents, sampling alone makes v = m (1 - m) q; what is above that is the share r = (v / (m (1 - m)) - q) / (1 - q)
    that hosts differ by, and a + b = 1 / r - 1, at least 1.  Where r is no positive number (all hosts have one document,
    one rate, or differ no more than by chance), a + b is ``WEAK_PRIOR``.
    """
    hosts = (
        rules.where(F.col("host").isNotNull())
        .groupBy("host")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    )
    rate = F.col("n_failed") / F.col("n_docs")
    m, v, q = hosts.agg(F.avg(rate), F.var_pop(rate), F.avg(1 / F.col("n_docs"))).first()  # three numbers, null without hosts
    spread = (m or 0.0) * (1 - (m or 0.0))
    share = (v / spread - q) / (1 - q) if spread > 0 and q < 1 else 0.0
    strength = max(1 / share - 1, 1.0) if share > 0 else WEAK_PRIOR
    shrunk = (F.col("n_failed") + F.lit((m or 0.0) * strength)) / (F.col("n_docs") + F.lit(strength))
    return hosts.select("host", "n_docs", "n_failed", shrunk.alias("host_rate")).withColumn("host_failed", F.col("host_rate") > MAX_HOST_RATE)


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per document: the counts, the base verdict, the host's verdict and ``kept``."""
    rules = base_rules(docs.select("doc_id", "text", host_of(F.col("source").cast("string")).alias("host")), "doc_id", "host")
    rules = materialize(rules, "quality")  # a few numbers a row: the texts are read once
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    hosts = host_verdicts(rules).withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    joined = rules.withColumn("salt", salt).join(hosts.select("host", "salt", "host_rate", "host_failed"), ["host", "salt"], "left")
    return joined.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & ~F.coalesce("host_failed", F.lit(False))).alias("kept"),
        "host",
        "host_rate",
    )


def drop_low_quality(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    docs, as_they_came = set_aside(docs, "text", "source")
    tagged = docs.withColumns({"_host": host_of(F.col("source").cast("string")), "_text": F.col("text")}).drop("text")
    kept = [c for c in tagged.columns if c not in ("_host", "_text")]
    rules = base_rules(tagged.select(F.col("_text").alias("text"), "_host", "_text", *kept), "_host", "_text", *kept)
    # written before anything is filtered: a filter pushed below the counts would split a text anew for every window
    rules = materialize(rules, "quality-docs")
    bad = host_verdicts(rules.select(F.col("_host").alias("host"), "base_failed")).where("host_failed")
    bad = materialize(bad.select(F.col("host").alias("_host")), "bad-hosts")
    passed = rules.where(~F.col("base_failed")).join(small_side(bad), "_host", "left_anti")
    return as_they_came(passed.withColumnRenamed("_text", "text"))
