"""Point-in-time alternative data on bars: daily social and news aggregates over trailing days, insider and filing features, article feeds."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidemill.operators.joins import asof
from tidemill.operators.text import SIGNIFICANT, value_mood
from tidemill.plans.windows import c, full, prev, win

# Transaction codes of ownership reports.
CODES = {"P": "Buy", "S": "Sell", "A": "Grant", "D": "Disposition", "F": "Tax Payment", "M": "Option Exercise", "C": "Conversion", "G": "Gift"}


def trailing_days(key: str, day: str, days: int) -> WindowSpec:
    """The last `days` calendar days of a key, the current day included."""
    return Window.partitionBy(key).orderBy(F.unix_date(day)).rangeBetween(-(days - 1), 0)


def social_daily(posts: DataFrame, days: int = 7) -> DataFrame:
    """A3 B1: per symbol and day, over the trailing days: mentions, sentiment (plain, weighted by ln(1 + score + 1), deviation), bullish
    share, scores, comments, trending, hype and the combined signal of the weighted sentiment. posts: symbol, day, score, comments,
    sentiment."""
    w = F.log1p(F.greatest(c("score"), F.lit(0)) + 1)
    daily = posts.groupBy("symbol", "day").agg(F.count("*").alias("n"), F.sum("sentiment").alias("s"), F.sum(c("sentiment") * w).alias("sw"), F.sum(w).alias("w"), F.sum(c("sentiment") * c("sentiment")).alias("ss"), F.count_if(c("sentiment") > 0.05).alias("b"), F.sum("score").alias("sc"), F.sum("comments").alias("co"))
    t = trailing_days("symbol", "day", days)
    out = daily.select("symbol", "day", *[F.sum(x).over(t).alias(x) for x in ("n", "s", "sw", "w", "ss", "b", "sc", "co")])
    spread = F.sqrt(F.greatest(c("ss") / c("n") - (c("s") / c("n")) * (c("s") / c("n")), F.lit(0.0)))
    out = out.select("symbol", "day", c("n").alias("mentions"), (c("s") / c("n")).alias("sentiment"), F.coalesce(F.try_divide("sw", "w"), F.lit(0.0)).alias("weighted"), spread.alias("sentiment_std"), c("sc").alias("total_score"), (c("sc") / c("n")).alias("avg_score"), c("co").alias("total_comments"), (c("b") / c("n")).alias("bullish_ratio"), ((c("n") > 10) & (c("sc") / c("n") > 100)).cast("int").alias("trending"))
    hype = F.least(c("mentions") / 50.0, F.lit(1.0))
    return out.withColumns({"hype": hype, "social_signal": 0.5 * c("weighted") + 0.3 * (c("bullish_ratio") - 0.5) + 0.2 * hype})


def insider_daily(tx: DataFrame, days: int = 90) -> DataFrame:
    """Trailing counts, net value, sentiment by value and executives' purchases less their sales of a symbol's insider transactions.
    tx: symbol, day, kind, value, executive."""
    buy, sell = c("kind") == "Buy", c("kind") == "Sell"
    daily = tx.groupBy("symbol", "day").agg(F.count_if(buy).alias("b"), F.count_if(sell).alias("s"), F.sum(F.when(buy, c("value")).otherwise(0.0)).alias("bv"), F.sum(F.when(sell, c("value")).otherwise(0.0)).alias("sv"), (F.count_if(c("executive") & buy) - F.count_if(c("executive") & sell)).alias("e"))
    t = trailing_days("symbol", "day", days)
    out = daily.select("symbol", "day", F.sum("b").over(t).alias("insider_buys"), F.sum("s").over(t).alias("insider_sells"), F.sum("bv").over(t).alias("_b"), F.sum("sv").over(t).alias("_s"), F.sum("e").over(t).alias("executive_activity"))
    mood = value_mood(c("_b"), c("_s"))
    return out.withColumns({"insider_net_value": c("_b") - c("_s"), "insider_sentiment": mood, "insider_signal": F.least(F.greatest(mood, F.lit(-1.0)), F.lit(1.0))}).drop("_b", "_s")


def on_bars(bars: DataFrame, daily: DataFrame, columns: list[str]) -> DataFrame:
    """The latest daily row at or before each bar; bars before the first have 0."""
    right = daily.withColumn("ts", c("day").cast("timestamp"))
    return asof(bars, right, ["symbol"], "ts", columns).na.fill(0, columns)


def decayed(daily: DataFrame, column: str = "mean", days: int = 7, keep: float = 0.9) -> DataFrame:
    """Mean over the trailing days, each day's weight falling by `keep`. The weights are taken against the first day of all, so the
    window needs two sums only."""
    age = F.datediff(c("day"), F.lit("2000-01-01").cast("date"))
    t = trailing_days("symbol", "day", days)
    # within the window all powers share a factor that cancels; ages are counted modulo a span to stay in range
    x = daily.withColumn("_p", F.collect_list(F.struct(age.alias("a"), c(column).cast("double").alias("v"))).over(t)).withColumn("_a", age)
    num = F.aggregate("_p", F.lit(0.0), lambda s, e: s + e["v"] * F.pow(F.lit(keep), F.col("_a") - e["a"]))
    den = F.aggregate("_p", F.lit(0.0), lambda s, e: s + F.pow(F.lit(keep), F.col("_a") - e["a"]))
    return x.withColumn(f"{column}_decayed", num / den).drop("_p", "_a")


def distinct_articles(feeds: list[DataFrame]) -> DataFrame:
    """O3: feeds in order of trust; of equal URLs the row of the first feed stays."""
    every = None
    for rank, feed in enumerate(feeds):
        part = feed.withColumn("_rank", F.lit(rank))
        every = part if every is None else every.unionByName(part, allowMissingColumns=True)
    w = Window.partitionBy("url").orderBy("_rank", F.desc("published"), "title")
    return every.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_rank")


def canonical(items: DataFrame, source: str, title: str = "title", text: str = "summary", url: str = "link", published: str = "published") -> DataFrame:
    """News items to the columns of an article table, newest first within each symbol; dates in several formats."""
    from tidemill.operators.text import parse_dates

    out = items.select("symbol", F.coalesce(title, F.lit("")).alias("title"), F.coalesce(text, F.lit("")).alias("description"), F.col(url).alias("url"), F.lit(source).alias("source"), parse_dates(F.col(published)).alias("published"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("published"), "url", "title")))


def about(articles: DataFrame, names: list[tuple[str, str]], text: str = "text") -> DataFrame:
    """One row an article of a general feed and symbol whose ticker or company name its text contains, in any case. names: (symbol,
    company), a list of companies that the caller follows, of any length: a task reads an article once, with one automaton over all names."""
    wanted: dict[str, set[str]] = {}
    for symbol, company in names:
        for word in (symbol.lower(), company.lower()):
            wanted.setdefault(word, set()).add(symbol)
    everywhere = wanted.pop("", set())  # an empty name is in every text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = ahocorasick.Automaton()
        for word, symbols in wanted.items():
            machine.add_word(word, symbols)
        if wanted:
            machine.make_automaton()
        for b in batches:
            rows, found = [], []
            for i, low in enumerate(b.column(b.num_columns - 1).to_pylist()):
                hit = set(everywhere).union(*(symbols for _, symbols in machine.iter(low))) if wanted else everywhere
                rows += [i] * len(hit)
                found += sorted(hit)
            out = b.select(range(b.num_columns - 1)).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(found, pa.string())], [*out.schema.names, "symbol"])

    kept = articles.drop("symbol") if "symbol" in articles.columns else articles
    low = kept.withColumn("_low", F.lower(F.coalesce(F.col(text), F.lit(""))))
    return low.mapInArrow(run, StructType([*kept.schema.fields, StructField("symbol", StringType())]))


def latest_news(news: DataFrame, k: int = 100, days_back: int | None = None, order: tuple[str, ...] = ("url",)) -> DataFrame:
    """L2: the newest k articles of each symbol, at most days_back days older than its newest."""
    w = Window.partitionBy("symbol").orderBy(F.desc("published"), *order)
    out = news.withColumns({"_n": F.row_number().over(w), "_top": F.max("published").over(Window.partitionBy("symbol"))}).where(c("_n") <= k)
    if days_back is not None:
        out = out.where(c("published") >= c("_top") - F.expr(f"INTERVAL {days_back} DAYS"))
    return out.drop("_n", "_top")


def sentiment_features(b: DataFrame, column: str = "sentiment") -> DataFrame:
    """Means, change, z-score, divergence from price, and a smoothed value."""
    b = b.withColumns({f"{column}_ma_5": full(column, 5), f"{column}_ma_10": full(column, 10), f"{column}_change": c(column) - prev(column), f"{column}_zscore": (c(column) - full(column, 20)) / (full(column, 20, F.stddev_samp) + 1e-8), f"{column}_smooth": F.avg(column).over(win(3))})
    return b.withColumn(f"{column}_price_divergence", F.coalesce((F.signum(c(f"{column}_change")) != F.signum(c("close") - prev("close"))).cast("int"), F.lit(1)))


REPORT = """struct<reportingOwner: struct<reportingOwnerId: struct<rptOwnerName: string>, reportingOwnerRelationship: struct<isDirector: string, officerTitle: string>>,
  nonDerivativeTable: struct<nonDerivativeTransaction: array<struct<transactionDate: struct<value: string>, transactionCoding: struct<transactionCode: string>,
  transactionAmounts: struct<transactionShares: struct<value: string>, transactionPricePerShare: struct<value: string>>,
  postTransactionAmounts: struct<sharesOwnedFollowingTransaction: struct<value: string>>>>>, _malformed: string>"""


def reports(df: DataFrame, payload: str = "xml", keep: tuple[str, ...] = ()) -> DataFrame:
    """Ownership reports (XML text) read by Spark's XML parser with a schema: kept columns, report (a struct), malformed (the text of a
    report that cannot be read, whose fields are null then)."""
    whole = F.col(payload).rlike(r"(?s)<ownershipDocument\b.*</ownershipDocument>\s*$")
    text = F.when(whole, F.col(payload)).otherwise(F.lit("<"))  # what has no end is malformed as a whole
    parsed = df.select(*keep, F.col(payload).alias("_text"), F.from_xml(text, REPORT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed", "rowTag": "ownershipDocument"}).alias("report"))
    return parsed.select(*keep, "report", F.when(F.col("_text").isNotNull() & (F.col("report").isNull() | F.col("report._malformed").isNotNull()), F.col("_text")).alias("malformed"))


def ownership(df: DataFrame, payload: str = "xml", keep: tuple[str, ...] = ()) -> DataFrame:
    """Transactions of ownership reports (XML text): owner, relation (an officer's title before Director), date, kind, shares (0 without
    any), price, value, shares owned after it. Malformed reports, and transactions without a date, give no row."""
    owner = c("report.reportingOwner")
    title = owner["reportingOwnerRelationship"]["officerTitle"]
    relation = F.when(title != "", title).when(owner["reportingOwnerRelationship"]["isDirector"].isin("1", "true"), "Director").otherwise("Other")
    rows = reports(df, payload, keep).where("malformed is null").select(*keep, owner["reportingOwnerId"]["rptOwnerName"].alias("filer"), relation.alias("relation"), F.explode("report.nonDerivativeTable.nonDerivativeTransaction").alias("t"))
    kinds = F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv])
    code = F.coalesce(c("t.transactionCoding.transactionCode"), F.lit(""))
    number = lambda path, default: F.coalesce(c(path).try_cast("double"), F.lit(default))
    out = rows.select(*keep, "filer", "relation", c("t.transactionDate.value").try_cast("date").alias("day"), F.coalesce(F.try_element_at(kinds, code), code).alias("kind"), F.floor(number("t.transactionAmounts.transactionShares.value", 0.0)).alias("shares"), number("t.transactionAmounts.transactionPricePerShare.value", 0.0).alias("price"), F.floor(number("t.postTransactionAmounts.sharesOwnedFollowingTransaction.value", 0.0)).alias("shares_after"))
    return out.where("day is not null").withColumn("value", c("shares") * c("price"))


def events_on_bars(bars: DataFrame, filings: DataFrame, latest: int = 5, days: int = 30) -> DataFrame:
    """For each bar, of the `latest` newest current reports up to its day those of the last `days` days: how many have significant
    items (recent_events), how many earnings (recent_earnings). filings: symbol, form, filed date, accession, items.

    Reports are numbered by symbol and counted as they come in. What a bar looks back to is the count at its day, less that at the later of
    two places: `latest` reports back, or the last one before the first day that counts. Both are as-of lookups, with no list a bar."""
    w = Window.partitionBy("symbol").orderBy("filed", F.desc("accession"))
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    marks = {"events": F.arrays_overlap("items", F.array(*[F.lit(x) for x in SIGNIFICANT])), "earnings": F.array_contains("items", "2.02")}
    f = filings.where(c("form") == "8-K").withColumns({x: F.sum(F.coalesce(m, F.lit(False)).cast("long")).over(so_far) for x, m in marks.items()})
    f = f.withColumns({f"back_{x}": F.coalesce(F.lag(x, latest).over(w), F.lit(0)) for x in marks}).withColumn("_last", F.row_number().over(Window.partitionBy("symbol", "filed").orderBy("accession")))
    f = f.where("_last = 1")  # of one day the last of the order, which has counted the others
    by_day = lambda columns, later: f.select("symbol", F.date_add("filed", later).cast("timestamp").alias("ts"), *columns)
    now = ["events", "earnings", "back_events", "back_earnings"]
    out = asof(bars, by_day(now, 0), ["symbol"], "ts", now)
    old = asof(out, by_day([c(x).alias(f"old_{x}") for x in marks], days + 1), ["symbol"], "ts", [f"old_{x}" for x in marks])
    recent = lambda x: F.coalesce(c(x) - F.greatest(c(f"back_{x}"), F.coalesce(c(f"old_{x}"), F.lit(0))), F.lit(0))
    return old.withColumns({"recent_events": recent("events"), "recent_earnings": recent("earnings")}).drop(*now, *[f"old_{x}" for x in marks])


def blended(b: DataFrame, ml: Column, strategy: Column) -> DataFrame:
    """0.6 of the model's and 0.4 of the strategy's score, times 1.2 if they agree and 0.5 if not."""
    agree = F.signum(ml) == F.signum(strategy)
    return b.withColumns({"score": (0.6 * ml + 0.4 * strategy) * F.when(agree, 1.2).otherwise(0.5), "agree": agree.cast("int")})


def merged(ml: DataFrame, strategy: DataFrame, column: str = "signal_value") -> DataFrame:
    """The model's and the strategies' signals of the same symbol and bar, blended. strategy: direction and strength."""
    both = ml.join(strategy.select("symbol", "ts", "direction", F.col("strength").alias("strategy_strength")), ["symbol", "ts"])
    both = both.withColumn("strategy_signal", F.coalesce(c("strategy_strength"), F.lit(0.0)) * F.coalesce(c("direction"), F.lit(0)))
    return blended(both, c(column), c("strategy_signal")).drop("direction", "strategy_strength")


def merged_panel(b: DataFrame, column: str = "signal_value", plan: str = "ensemble") -> DataFrame:
    """merged() where both are columns of one panel: the strategies' struct (direction, strength) beside the model's signal; no join."""
    strategy = F.coalesce(c(plan)["strength"], F.lit(0.0)) * F.coalesce(c(plan)["direction"], F.lit(0))
    return blended(b.withColumn("strategy_signal", strategy), c(column), c("strategy_signal"))


def mean_levels(b: DataFrame) -> DataFrame:
    """Mean stop and target of each symbol's bars."""
    return b.groupBy("symbol").agg(F.avg("stop_pct").alias("stop_pct"), F.avg("target_pct").alias("target_pct"))


def clipped_levels(b: DataFrame) -> DataFrame:
    """Stop at 1.5 and target at 4 true ranges of the price, within 1-3 % and 2-10 %."""
    share = F.try_divide("atr_sma", "close")
    return b.withColumns({"stop_pct": F.least(F.greatest(1.5 * share, F.lit(0.01)), F.lit(0.03)), "target_pct": F.least(F.greatest(4 * share, F.lit(0.02)), F.lit(0.1))})


def pause_flags(b: DataFrame, daily: float = 0.03, weekly: float = 0.07, fall: float = 0.15) -> DataFrame:
    """Bars on which the loss of a day, of five bars, or the drawdown is over its limit. b: strategy_return, drawdown."""
    return b.withColumns({"pause_day": (c("strategy_return") < -daily).cast("int"), "pause_week": (F.sum("strategy_return").over(win(5)) < -weekly).cast("int"), "pause_drawdown": (c("drawdown") < -fall).cast("int")})
