"""Backtests: a cash-constrained fold over the trading days of each run, and what is read from its curve.

Candidates and prices are set-based.  The fold depends on its own past: it is a state machine over a run's days in order,
cash and open positions, in built-in functions.  The days are cut into chunks; the state is written after each, and the
next goes on from it, so a task holds a chunk of a run's days (the bars of its candidates from entry to planned exit), and
a run that was stopped is taken up again where it ended.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import clamp
from ..sources.scratch import is_written, scratch_path

FEE = 0.001
SLIPPAGE_BPS = 5.0
CAPITAL = 100000.0
#: Cash below a cent is what rounding leaves, and buys nothing.
LEAST_CASH = 0.01
#: Trading days after which the state is written.
CHUNK_DAYS = 250

EVENTS = "run_id long, d date, equity double, cash double, open_positions long, closed long, wins long"
POSITION = "struct<asset_id:bigint,qty:double,cost:double,buy:double,exit_d:date,target:double,stop:double>"
TRADE = "struct<d:date,side:string,asset_id:bigint,qty:double,price:double,fee:double,amount:double,pnl:double,reason:string>"
EVENT = "struct<d:date,equity:double,cash:double,open_positions:bigint,closed:bigint,wins:bigint>"
STATE = f"struct<cash:double,held:array<{POSITION}>,events:array<{EVENT}>,trades:array<{TRADE}>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def struct(kind: str, **fields: Column) -> Column:
    return F.struct(*[c.alias(name) for name, c in fields.items()]).cast(kind)


def close(day: Column, held: Column, stop_target: Column) -> Column:
    """kept (still open), sold (trades) of the positions: stop before target before the planned exit; no price keeps it open."""
    price = lambda x: F.try_element_at(day["prices"], x["asset_id"])
    no = F.lit(False)
    stopped = lambda x, c: stop_target & F.coalesce(c <= x["stop"], no)
    reached = lambda x, c: stop_target & F.coalesce(c >= x["target"], no)
    ends = lambda x, c: F.coalesce((c > 0) & (stopped(x, c) | reached(x, c) | (day["d"] >= x["exit_d"])), no)

    def sale(x: Column) -> Column:
        c = price(x)
        at = c * (1 - SLIPPAGE_BPS / 1e4)
        amount = x["qty"] * c * (1 - SLIPPAGE_BPS / 1e4)
        reason = F.when(stopped(x, c), "STOP_LOSS").when(reached(x, c), "TARGET_PRICE").otherwise("SCHEDULED")
        return let(amount, lambda a: struct(TRADE, d=day["d"], side=F.lit("SELL"), asset_id=x["asset_id"], qty=x["qty"], price=at, fee=a * FEE, amount=a, pnl=a * (1 - FEE) - x["cost"], reason=reason))

    return F.struct(
        F.filter(held, lambda x: ~ends(x, price(x))).alias("kept"),
        F.transform(F.filter(held, lambda x: ends(x, price(x))), sale).alias("sold"),
    )


def buy(day: Column, cash: Column, slots: Column, fraction: Column) -> Column:
    """cash left, bought (positions): equal parts of the deployable cash, divided before any candidate is skipped."""
    chosen = F.slice(day["picks"], F.lit(1), F.greatest(slots, F.lit(0)).cast("int"))
    part = lambda cash, some: F.least(cash, CAPITAL * fraction) / F.size(some) / (1 + FEE)
    start = F.struct(cash.alias("cash"), F.array().cast(f"array<{POSITION}>").alias("bought"))

    def one(amount: Column):
        def step(acc: Column, x: Column) -> Column:
            able = F.coalesce((x["c"] > 0) & (amount * (1 + FEE) <= acc["cash"] + 1e-9), F.lit(False))
            at = x["c"] * (1 + SLIPPAGE_BPS / 1e4)
            new = struct(POSITION, asset_id=x["asset_id"], qty=amount / at, cost=amount * (1 + FEE), buy=at, exit_d=x["exit_d"], target=x["target"], stop=x["stop"])
            return F.when(able, F.struct((acc["cash"] - amount * (1 + FEE)).alias("cash"), F.array_append(acc["bought"], new).alias("bought"))).otherwise(acc)

        return step

    return let(chosen, lambda some: F.when((F.size(some) > 0) & (cash >= LEAST_CASH), let(part(cash, some), lambda amount: F.aggregate(some, start, one(amount)))).otherwise(start))


def step(slots: Column, fraction: Column, stop_target: Column):
    """The state after a day: positions close, new ones open, and all are valued at the day's prices."""

    def run(state: Column, raw: Column) -> Column:
        def opened(day: Column, after: Column) -> Column:
            cash = F.aggregate(after["sold"], state["cash"], lambda acc, t: acc + t["amount"] * (1 - FEE))
            return let(cash, lambda c: buy(day, c, slots - F.size(after["kept"]), fraction))

        def valued(day: Column, after: Column, new: Column) -> Column:
            held = F.concat(after["kept"], new["bought"])
            equity = F.aggregate(held, new["cash"], lambda acc, x: acc + x["qty"] * F.coalesce(F.try_element_at(day["prices"], x["asset_id"]), x["buy"]))
            event = struct(EVENT, d=day["d"], equity=equity, cash=new["cash"], open_positions=F.size(held), closed=F.size(after["sold"]), wins=F.size(F.filter(after["sold"], lambda t: t["pnl"] > 0)))
            bought = F.transform(new["bought"], lambda x: struct(TRADE, d=day["d"], side=F.lit("BUY"), asset_id=x["asset_id"], qty=x["qty"], price=x["buy"], fee=x["cost"] / (1 + FEE) * FEE, amount=x["cost"] / (1 + FEE), pnl=F.lit(0.0), reason=F.lit(None).cast("string")))
            return struct(STATE, cash=new["cash"], held=held, events=F.array_append(state["events"], event), trades=F.concat(state["trades"], after["sold"], bought))

        day = F.struct(raw["d"].alias("d"), F.map_from_entries(raw["prices"]).alias("prices"), raw["picks"].alias("picks"))
        return let(day, lambda day: let(close(day, state["held"], stop_target), lambda after: let(opened(day, after), lambda new: valued(day, after, new))))

    return run


def days_of(candidates: DataFrame, prices: DataFrame, chunk: int) -> DataFrame:
    """run_id, chunk, no, d, prices and picks: each trading day from a run's first entry to its last planned exit.

    A run sees a candidate's bars from its entry to its planned exit, by which it is sold: no others can matter to it.
    """
    bars = prices.select("asset_id", "d", F.col("c").cast("double").alias("c"))
    able = candidates.where("exit_d > d").select("run_id", F.col("asset_id").cast("long").alias("asset_id"), "d", "rank", "exit_d", F.col("target").cast("double").alias("target"), F.col("stop").cast("double").alias("stop"))
    # spans are some days long: each day of one meets its bar by equality
    spans = able.select("run_id", "asset_id", F.explode(F.sequence("d", "exit_d", F.expr("interval 1 day"))).alias("d")).distinct()
    bars = bars.join(F.broadcast(able.select("asset_id").distinct()), "asset_id", "left_semi")  # an id an asset: no more than there are
    seen = spans.join(bars, ["asset_id", "d"]).groupBy("run_id", "d").agg(F.collect_list(F.struct("asset_id", "c")).alias("prices"))
    picks = able.join(bars, ["asset_id", "d"], "left").groupBy("run_id", "d").agg(F.array_sort(F.collect_list(F.struct("rank", "asset_id", "c", "exit_d", "target", "stop"))).alias("picks"))
    calendar = prices.agg(F.array_sort(F.collect_set("d")).alias("days"))  # one row, as long as the calendar
    reach = able.groupBy("run_id").agg(F.min("d").alias("first"), F.max("exit_d").alias("last")).crossJoin(F.broadcast(calendar))
    inside = F.filter("days", lambda x: (x >= F.col("first")) & (x <= F.col("last")))
    timeline = reach.select("run_id", F.posexplode(inside).alias("no", "d")).withColumn("chunk", F.floor(F.col("no") / chunk).cast("int"))
    kinds = {"prices": "array<struct<asset_id:bigint,c:double>>", "picks": "array<struct<rank:bigint,asset_id:bigint,c:double,exit_d:date,target:double,stop:double>>"}
    days = timeline.join(seen, ["run_id", "d"], "left").join(picks, ["run_id", "d"], "left")
    return days.select("run_id", "chunk", "no", "d", *[F.coalesce(F.col(c).cast(kind), F.array().cast(kind)).alias(c) for c, kind in kinds.items()])


def advance(days: DataFrame, runs: DataFrame, state: DataFrame | None) -> DataFrame:
    """run_id and state after the days of a chunk, with its events and trades; ``state`` is that before, None at the start."""
    ordered = days.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("no", "d", "prices", "picks"))).alias("days"))
    rows = runs.join(ordered, "run_id", "left")
    rows = rows.withColumns({"cash": F.lit(CAPITAL), "held": F.array().cast(f"array<{POSITION}>")}) if state is None else rows.join(state.select("run_id", "state.cash", "state.held"), "run_id")
    start = struct(STATE, cash=F.col("cash"), held=F.col("held"), events=F.array().cast(f"array<{EVENT}>"), trades=F.array().cast(f"array<{TRADE}>"))
    none = F.array().cast(days.groupBy().agg(F.collect_list(F.struct("no", "d", "prices", "picks")).alias("x")).schema["x"].dataType)
    return rows.select("run_id", F.aggregate(F.coalesce("days", none), start, step(F.col("slots"), F.col("fraction"), F.col("stop_target"))).alias("state"))


def run(candidates: DataFrame, prices: DataFrame, runs: DataFrame, *, chunk: int = CHUNK_DAYS, folder: str | None = None, most_chunks: int | None = None) -> DataFrame:
    """run_id, chunk and state of every run after each chunk of ``chunk`` days; ``curve`` and ``trades`` read it.

    ``candidates``: run_id, d, asset_id, rank, exit_d, target, stop; ``runs``: run_id, slots, fraction, stop_target.
    With a ``folder`` that all workers share, a later call goes on after the last chunk that was written whole, also if
    this one was stopped; ``most_chunks`` ends it after so many.  The state is a few positions a run.
    """
    spark = candidates.sparkSession
    folder = folder or scratch_path(spark, "backtest")
    if not is_written(spark, f"{folder}/days"):
        days_of(candidates, prices, chunk).write.mode("overwrite").partitionBy("chunk").parquet(f"{folder}/days")
    kinds = T.StructType([*T.StructType.fromDDL("run_id long, no int, d date, prices array<struct<asset_id:bigint,c:double>>, picks array<struct<rank:bigint,asset_id:bigint,c:double,exit_d:date,target:double,stop:double>>").fields, T.StructField("chunk", T.IntegerType())])
    days = spark.read.schema(kinds).parquet(f"{folder}/days")
    last = days.agg(F.max("chunk")).first()[0]
    after = T.StructType.fromDDL(f"run_id long, state {STATE}")
    states, done = [], 0
    for k in range(0 if last is None else last + 1):
        path = f"{folder}/state-{k:06d}"
        if not is_written(spark, path):
            if most_chunks is not None and done >= most_chunks:
                break
            advance(days.where(F.col("chunk") == k), runs, states[-1] if states else None).write.mode("overwrite").parquet(path)
            done += 1
        states.append(spark.read.schema(after).parquet(path))
    out = spark.createDataFrame([], T.StructType([*after.fields, T.StructField("chunk", T.IntegerType())])).select("run_id", "chunk", "state")
    for k, state in enumerate(states):
        out = out.unionByName(state.withColumn("chunk", F.lit(k)))
    return out


def curve(states: DataFrame) -> DataFrame:
    """The daily state of every run, a row a day."""
    return states.select("run_id", F.explode("state.events").alias("e")).select("run_id", "e.*")


def trades(states: DataFrame) -> DataFrame:
    """Every purchase and sale, with price, fee, amount, profit and why it was sold."""
    return states.select("run_id", F.explode("state.trades").alias("t")).select("run_id", "t.*")


def metrics(curve: DataFrame, capital: float = CAPITAL) -> DataFrame:
    """Return, annualized return, Sharpe ratio, largest drawdown, trades and win rate of every run."""
    by = Window.partitionBy("run_id").orderBy("d")
    x = curve.withColumns({"prev": F.lag("equity").over(by), "peak": F.max("equity").over(by)})
    x = x.withColumns({"r": F.when(F.col("prev") > 0, F.col("equity") / F.col("prev") - 1), "fall": 1 - F.col("equity") / F.col("peak")})
    out = x.groupBy("run_id").agg(
        F.max_by("equity", "d").alias("last"), F.datediff(F.max("d"), F.min("d")).alias("days"), F.avg("r").alias("mean"), F.stddev_pop("r").alias("dev"),
        F.count("r").alias("n"), F.max("fall").alias("fall"), F.sum("closed").alias("trades"), F.sum("wins").alias("wins"),
    )
    total = F.col("last") / capital - 1
    yearly = F.when(1 + total <= 0, F.lit(-1.0)).otherwise(F.pow(1 + total, F.lit(365.0) / F.greatest(F.lit(1), F.col("days"))) - 1)
    sharpe = F.when((F.col("n") >= 2) & (F.col("dev") > 0), clamp(F.col("mean") / F.col("dev") * F.sqrt(F.lit(252.0)), -10.0, 10.0)).otherwise(F.lit(0.0))
    rate = F.when(F.col("trades") > 0, F.col("wins") / F.col("trades")).otherwise(F.lit(0.0))
    return out.select("run_id", total.alias("total_return"), clamp(yearly, -1.0, 10.0).alias("annualized"), sharpe.alias("sharpe"), clamp(F.col("fall"), 0.0, 1.0).alias("max_drawdown"), "trades", rate.alias("win_rate"))


def rebased(curve: DataFrame, value: str, capital: float) -> DataFrame:
    """d, value: the series scaled so that its first value is ``capital``."""
    first = F.first(value).over(Window.partitionBy("series").orderBy("d"))
    return curve.select("series", "d", (F.col(value) * capital / first).alias("value"))


def windows(start: str, end: str, length: int, step: int, spark) -> DataFrame:
    """(start, end) of evaluation windows of ``length`` days, every ``step`` days."""
    days = spark.range(1).select(F.explode(F.expr(f"sequence(date'{start}', date'{end}', interval {step} days)")).alias("start_d"))
    return days.select("start_d", F.least(F.date_add("start_d", length - 1), F.lit(end).cast("date")).alias("end_d"))
