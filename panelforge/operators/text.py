"""News text: lexicon sentiment, concept tags, linking of names."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import clamp

# Words that count as good or bad news, and the concepts with the keywords that tag them.
POSITIVE = ("增长", "利好", "突破", "看涨", "回升", "改善", "超预期", "盈利", "buy", "bullish", "upgrade", "outperform")
NEGATIVE = ("下滑", "利空", "下跌", "看跌", "风险", "亏损", "恶化", "裁员", "sell", "bearish", "downgrade", "underperform")
CONCEPTS = {
    "AI": ("ai", "人工智能", "大模型", "算力"),
    "芯片": ("芯片", "半导体", "集成电路", "光刻"),
    "新能源": ("新能源", "锂电", "光伏", "储能", "电池"),
    "白酒": ("白酒", "茅台", "五粮液", "泸州老窖"),
    "医药": ("医药", "创新药", "医疗", "医保"),
    "消费": ("消费", "零售", "电商", "食品饮料"),
    "银行": ("银行", "信贷", "存款", "贷款"),
    "保险": ("保险", "寿险", "财险"),
    "地产": ("地产", "房地产", "楼市", "物业"),
    "军工": ("军工", "航天", "航空装备", "国防"),
    "汽车": ("汽车", "新能源车", "robotaxi", "无人驾驶"),
    "航运": ("航运", "港口", "海运"),
    "航空": ("航空", "客机", "机场"),
}

# Endings of company names that are no part of the name, and further names of companies.
SUFFIXES = ("股份有限公司", "有限公司", "股份", "集团", "科技", "控股")
FURTHER = {"贵州茅台": ("茅台",), "比亚迪": ("BYD",), "中国平安": ("平安",)}


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}0-9]+"), lambda w: w != "")


def count_in(tokens: Column, lexicon: tuple[str, ...]) -> Column:
    return F.size(F.filter(tokens, lambda w: w.isin(*lexicon))).cast("long")


def sentiment(articles: DataFrame, positive: tuple[str, ...] = POSITIVE, negative: tuple[str, ...] = NEGATIVE) -> DataFrame:
    """Adds n, pos and neg token counts, sentiment = clamp(8 (pos - neg) / n), its three parts and a label."""
    x = articles.withColumn("_w", words(F.col("text")))
    x = x.withColumns({"n": F.size("_w").cast("long"), "pos": count_in(F.col("_w"), positive), "neg": count_in(F.col("_w"), negative)}).drop("_w")
    s = F.when(F.col("n") > 0, clamp((F.col("pos") - F.col("neg")) * 8.0 / F.col("n"), -1.0, 1.0)).otherwise(F.lit(0.0))
    x = x.withColumn("sentiment", s)
    some = F.col("n") > 0
    third = F.lit(1 / 3)
    return x.withColumns(
        {
            "positive": F.when(some, F.greatest(F.lit(0.0), "sentiment")).otherwise(third),
            "negative": F.when(some, F.greatest(F.lit(0.0), -F.col("sentiment"))).otherwise(third),
            "neutral": F.when(some, 1 - F.abs("sentiment")).otherwise(third),
            "label": F.when(F.col("sentiment") >= 0.15, "POSITIVE").when(F.col("sentiment") <= -0.15, "NEGATIVE").otherwise("NEUTRAL"),
        }
    )


def tags(articles: DataFrame, concepts: dict[str, tuple[str, ...]] = CONCEPTS) -> DataFrame:
    """Adds tags: the concepts, sorted, any of whose keywords is in the text, both in lower case and without white space."""
    low = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"(?U)\s+", "")
    each = {name: [bare(k) for k in keys] for name, keys in sorted(concepts.items())}
    found = lambda text: [F.when(F.greatest(*[text.contains(k) for k in keys]) if len(keys) > 1 else text.contains(keys[0]), F.lit(name)) for name, keys in each.items()]
    # the text is made bare once, however many keywords it is searched for
    sought = F.element_at(F.transform(F.array(low), lambda text: F.array(*found(text))), 1)
    return articles.withColumn("tags", F.filter(sought, lambda t: t.isNotNull()))


def link(articles: DataFrame, aliases: DataFrame, most: int = 8) -> DataFrame:
    """article_id, asset_id, alias: assets whose alias is a word of the article, longest alias first, ``most`` an article.

    Words are joined to aliases by equality, so the work follows the texts and not texts times aliases.
    """
    each = articles.select("article_id", F.explode(F.array_distinct(words(F.col("text")))).alias("alias"))
    hits = each.join(aliases, "alias")
    one = hits.groupBy("article_id", "asset_id").agg(F.max(F.struct(F.length("alias").alias("n"), F.col("alias"))).alias("b"))
    rank = F.row_number().over(Window.partitionBy("article_id").orderBy(F.desc("b.n"), "asset_id"))
    return one.withColumn("rank", rank).where(F.col("rank") <= most).select("article_id", "asset_id", F.col("b.alias").alias("alias"), "rank")


class Finder:
    """Where aliases stand: one automaton over all of them, so a text is read once whatever their number."""

    def __init__(self, aliases: list[tuple[int, str]]):
        self.entries: dict[str, list[tuple[int, str]]] = {}
        self.numbers: dict[str, list[tuple[int, str]]] = {}
        for asset, alias in aliases:
            if alias.isdecimal():
                self.numbers.setdefault(alias, []).append((asset, alias))
            elif piece := bare(alias):
                self.entries.setdefault(piece, []).append((asset, alias))
        self.machine = ahocorasick.Automaton()
        for piece in self.entries:
            self.machine.add_word(piece, piece)
        if self.entries:
            self.machine.make_automaton()

    def find(self, text: str) -> dict[int, tuple[int, str]]:
        """The longest alias of each asset that is in the text, with its length; of equally long ones the last by code points."""
        hits = [(piece, self.entries[piece]) for piece in ({p for _, p in self.machine.iter(bare(text))} if self.entries else ())]
        if self.numbers:
            hits += [(run, self.numbers[run]) for run in set(DIGITS.findall(text)) if run in self.numbers]
        best: dict[int, tuple[int, str]] = {}
        for piece, named in hits:
            for asset, alias in named:
                best[asset] = max(best.get(asset, (0, "")), (len(piece), alias))
        return best


def bare(text: str) -> str:
    """In lower case and without white space."""
    return "".join(text.lower().split())


DIGITS = re.compile(r"\d+")
#: Bytes of aliases that an automaton is built from, at most; more are dealt to several.
MOST_ALIASES = 8 << 20


def _linker(aliases):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(aliases.value)
        for batch in batches:
            rows = [(i, asset, n, alias) for i, text in zip(range(batch.num_rows), batch.column("text").to_pylist(), strict=True) for asset, (n, alias) in finder.find(text or "").items()]
            at, asset, n, alias = zip(*rows, strict=True) if rows else ((), (), (), ())
            ids = batch.column("article_id").take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(asset, pa.int64()), pa.array(n, pa.int32()), pa.array(alias, pa.string())], names=["article_id", "asset_id", "n", "alias"])

    return run


def link_anywhere(articles: DataFrame, aliases: DataFrame, most: int = 8, most_bytes: int = MOST_ALIASES) -> DataFrame:
    """article_id, asset_id, alias, rank: as ``link``, for aliases that stand anywhere in the text.

    An alias of digits is a whole run of digits of the text as it is; any other is part of the lower-cased text, both
    without white space.  The aliases are sent to all tasks once, in parts of at most ``most_bytes`` (an automaton each,
    and a reading of the texts each), so the work follows the length of the texts and the tasks' memory is bounded.
    Null and empty texts and aliases link nothing; rows of one article are read together.
    """
    context = articles.sparkSession.sparkContext
    known = aliases.where("asset_id is not null and alias is not null").select(F.col("asset_id").cast("long").alias("asset_id"), "alias").distinct()
    size = known.agg(F.coalesce(F.sum(F.octet_length("alias") + 32), F.lit(0))).first()[0]
    parts = max(1, -(-size // most_bytes))
    texts = articles.select("article_id", "text")
    schema = T.StructType([texts.schema["article_id"], T.StructField("asset_id", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("alias", T.StringType())])
    hits = None
    for i in range(parts):
        some = [(r["asset_id"], r["alias"]) for r in known.where(F.pmod(F.xxhash64("asset_id", "alias"), F.lit(parts)) == i).collect()]  # ``most_bytes``, about
        found = texts.mapInArrow(_linker(context.broadcast(some)), schema)
        hits = found if hits is None else hits.unionByName(found)
    one = hits.groupBy("article_id", "asset_id").agg(F.max(F.struct("n", "alias")).alias("b"))
    rank = F.row_number().over(Window.partitionBy("article_id").orderBy(F.desc("b.n"), "asset_id"))
    return one.withColumn("rank", rank).where(F.col("rank") <= most).select("article_id", "asset_id", F.col("b.alias").alias("alias"), "rank")


def aliases_of(assets: DataFrame, suffixes: tuple[str, ...] = SUFFIXES, further: dict[str, tuple[str, ...]] = FURTHER) -> DataFrame:
    """asset_id, alias: an asset's name, symbol and lower-cased code, its name without legal suffixes, and ``further`` names.

    ``assets`` has asset_id, name, symbol and code.  Each suffix is taken off once, in order, and what is left counts if
    it has two letters or more; blank names don't count.
    """
    name = F.trim(F.coalesce(F.col("name"), F.lit("")))
    cut = lambda x, suffix: F.when(F.endswith(x, suffix), F.trim(F.left(x, F.length(x) - F.length(suffix)))).otherwise(x)
    short = F.aggregate(F.array(*map(F.lit, suffixes)), name, cut) if suffixes else name
    table = F.create_map(*[x for of, names in further.items() for x in (F.lit(of), F.array(*map(F.lit, names)))]) if further else F.lit(None).cast("map<string,array<string>>")
    other = F.coalesce(F.element_at(table, name), F.array().cast("array<string>"))
    known = F.array(name, F.trim("symbol"), F.lower(F.trim("code")), F.when(F.length(short) >= 2, short))
    each = assets.select("asset_id", F.explode(F.array_distinct(F.concat(known, other))).alias("alias"))
    return each.where("alias <> ''")
