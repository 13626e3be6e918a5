"""Text sentiment and alternative data as set-based jobs: lexicon joins, daily aggregates, ticker mentions, insider activity, filings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.plans.windows import c

# Capital words that look like tickers and are not.
NOT_TICKERS = (
    "A I AM PM CEO CFO IPO USA UK EU GDP CPI FED SEC NYSE NASDAQ ETF SPAC DD TL DR TLDR OP IMO IMHO FOMO YOLO LOL WTF ATH ATL EOD EOW EOM IV DTE "
    "OTM ITM ATM PE EPS PS PB ROE ROI EBITDA FCF DCF NPV IRR CAGR YOY QOQ THE AND FOR ARE BUT NOT YOU ALL CAN HER WAS ONE OUR OUT HAS HIS HOW ITS "
    "MAY NEW NOW OLD SEE WAY WHO BOY DID GET LET PUT SAY SHE TOO USE AI ML"
).split()
# Items of current reports, and those that move prices.
ITEMS = "1.01 1.02 1.03 1.04 2.01 2.02 2.03 2.04 2.05 2.06 3.01 3.02 3.03 4.01 4.02 5.01 5.02 5.03 5.07 5.08 7.01 8.01 9.01".split()
SIGNIFICANT = "1.01 1.02 2.01 2.05 3.01 5.01 5.02".split()
# Weight of a filing by its form.
FORM_WEIGHTS = {"10-K": 1.0, "10-Q": 0.8, "8-K": 0.9, "4": 0.7, "13F": 0.6, "SC 13D": 0.9, "SC 13G": 0.6}


def words(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(kept columns, pos, word): lower-cased words of letters in order."""
    return df.select(*keep, F.posexplode(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}']+)"), 1)).alias("pos", "word"))


def lexicon_scores(df: DataFrame, lexicon: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), negations: tuple[str, ...] = ("not", "no", "never")) -> DataFrame:
    """Compound s / sqrt(s^2 + 15) of the summed valence, and the mean valence; a negation before a word turns it to -0.74 of its own.

    The lexicon (word, valence) is joined; Spark broadcasts it if it is small. Rows without a known word score 0.
    """
    found = df.select(*keep, F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}']+)"), 1).alias("_w"))
    pairs = F.transform("_w", lambda x, i: F.struct(x.alias("word"), F.coalesce(F.get(c("_w"), i - 1).isin(*negations), F.lit(False)).alias("negated")))
    tokens = found.select(*keep, F.explode(pairs).alias("t")).select(*keep, "t.word", "t.negated")
    hits = tokens.join(lexicon, "word").withColumn("v", F.when(c("negated"), c("valence") * -0.74).otherwise(c("valence")))
    agg = hits.groupBy(*keep).agg(F.sum("v").alias("s"), F.avg("v").alias("polarity"), F.count("*").alias("hits"))
    out = df.select(*keep).distinct().join(agg, list(keep), "left")
    s = F.coalesce(c("s"), F.lit(0.0))
    return out.select(*keep, (s / F.sqrt(s * s + 15)).alias("compound"), F.coalesce("polarity", F.lit(0.0)).alias("polarity"), F.coalesce("hits", F.lit(0)).alias("hits"))


def ensemble(scores: dict[str, Column], weights: dict[str, float]) -> tuple[Column, Column, Column]:
    """Weighted score over the scorers at hand, its label beyond +-0.15, and the confidence by agreement."""
    total = sum(weights[k] for k in scores)
    score = sum(scores[k] * (weights[k] / total) for k in sorted(scores))
    live = F.filter(F.array(*[scores[k] for k in sorted(scores)]), lambda x: x != 0)
    mean = F.aggregate(live, F.lit(0.0), lambda a, x: a + F.abs(x)) / F.greatest(F.size(live), F.lit(1))
    same = (F.size(F.filter(live, lambda x: x > 0)) == F.size(live)) | (F.size(F.filter(live, lambda x: x < 0)) == F.size(live))
    confidence = F.when(F.size(live) == 0, 0.0).when(same, F.least(mean + 0.3, F.lit(1.0))).otherwise(0.5 * mean)
    return score, F.when(score > 0.15, "bullish").when(score < -0.15, "bearish").otherwise("neutral"), confidence


def blend(title: Column, content: Column, weight: float = 0.3) -> Column:
    """Title and content, one of them alone, or null."""
    return F.coalesce(weight * title + (1 - weight) * content, title, content)


def daily_sentiment(scored: DataFrame, keys: tuple[str, ...] = ("symbol", "day"), order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A1 A2: aggregates of score and confidence by symbol and day, and the later half's mean less the earlier half's."""
    w, whole = Window.partitionBy(*keys).orderBy(*order), Window.partitionBy(*keys)
    x = scored.withColumns({"_i": F.row_number().over(w), "_n": F.count("*").over(whole)})
    late = c("_i") > F.floor(c("_n") / 2)
    s = c("score")
    out = x.groupBy(*keys).agg(
        F.avg(s).alias("mean"), F.coalesce(F.try_divide(F.sum(s * c("confidence")), F.sum("confidence")), F.avg(s)).alias("weighted"), F.median(s).alias("median"), F.stddev_pop(s).alias("std"), F.min(s).alias("min"), F.max(s).alias("max"),
        F.count_if(s > 0.15).alias("bullish"), F.count_if(s < -0.15).alias("bearish"), F.count_if(F.abs(s) <= 0.15).alias("neutral"), F.avg("confidence").alias("avg_confidence"), F.count("*").alias("articles"),
        F.coalesce(F.avg(F.when(late, s)) - F.avg(F.when(~late, s)), F.lit(0.0)).alias("momentum"),
    )
    return out.withColumns({"range": c("max") - c("min"), "bullish_ratio": c("bullish") / c("articles"), "bearish_ratio": c("bearish") / c("articles")})


def tickers(text: Column) -> Column:
    """$X and upper-case words of 2 to 5 letters, without stop-words, each once."""
    tokens = F.regexp_extract_all(text, F.lit(r"(\$?[\p{L}\p{N}_]+)"), 1)  # whole words, so that letters beyond A-Z bound none
    found = F.transform(F.filter(tokens, lambda t: t.rlike(r"^(\$[A-Z]{1,5}|[A-Z]{2,5})$")), lambda t: F.ltrim(t, F.lit("$")))
    return F.array_distinct(F.array_except(found, F.array(*[F.lit(x) for x in NOT_TICKERS])))


def mentions(posts: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return posts.select(*keep, F.explode(tickers(c(text))).alias("symbol"))


def trending(m: DataFrame, least: int = 3, k: int = 20) -> DataFrame:
    """A4 L3: mentions by symbol with posts' score, at least `least`, the k largest by mentions * ln(1 + score)."""
    agg = m.groupBy("symbol").agg(F.count("*").alias("mentions"), F.sum("score").alias("score"), F.countDistinct("community").alias("communities"), F.avg((c("sentiment") > 0.05).cast("double")).alias("bullish_ratio"), F.avg("sentiment").alias("avg_sentiment"), F.stddev_pop("sentiment").alias("sentiment_std"))
    ranked = agg.where(c("mentions") >= least).withColumn("trend", c("mentions") * F.log1p("score"))
    return ranked.orderBy(F.desc("trend"), "symbol").limit(k)


def insider_activity(tx: DataFrame, keys: tuple[str, ...] = ("filer",)) -> DataFrame:
    """A5: transactions, purchases and sales with their shares and values, sentiment (value bought - value sold) / (both values), 0 without
    any, and executives among them."""
    buy, sell, top = c("kind") == "Buy", c("kind") == "Sell", c("relation").contains("CEO") | c("relation").contains("CFO")
    total = lambda side, x: F.coalesce(F.sum(F.when(side, c(x))), F.lit(0)).alias(f"{'buy' if side is buy else 'sell'}_{x}")
    out = tx.groupBy(*keys).agg(F.count("*").alias("transactions"), total(buy, "shares"), total(sell, "shares"), total(buy, "value"), total(sell, "value"), F.count_if(buy).alias("buys"), F.count_if(sell).alias("sells"), F.count_if(buy & top).alias("executive_buys"), F.count_if(sell & top).alias("executive_sells"))
    return out.withColumns({"net_shares": c("buy_shares") - c("sell_shares"), "net_value": c("buy_value") - c("sell_value"), "sentiment": value_mood(c("buy_value"), c("sell_value"))})


def value_mood(bought: Column, sold: Column) -> Column:
    """Balance of values bought and sold over their sum; 0 if that is not positive."""
    return F.when(bought + sold > 0, F.try_divide(bought - sold, bought + sold)).otherwise(0.0)


def strip_html(text: Column) -> Column:
    """F11."""
    return F.regexp_replace(text, r"<[^>]+>", " ")


def chunks(text: Column, size: int = 5000, most: int | None = None) -> Column:
    """stretches of `size` characters of the whole text (or of its first `most`)."""
    t = F.substring(text, 1, most) if most else text
    n = F.greatest(F.ceil(F.char_length(t) / size), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(t, i * size + 1, F.lit(size)))


def report_items(text: Column) -> Column:
    """the items a current report names."""
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(f"Item {x}")), F.lit(x)) for x in ITEMS]))


def filing_events(filings: DataFrame, as_of: Column, latest: int = 5, days: int = 30) -> DataFrame:
    """Of the latest current reports of a company those of the last `days` days: how many have significant items, and how many
    earnings. filings: symbol, form, filed date, accession, items; as_of: the day that is looked back from."""
    filings = filings.where(c("form") == "8-K")
    w = Window.partitionBy("symbol").orderBy(F.desc("filed"), "accession")
    recent = filings.where(c("filed") <= as_of).withColumn("_i", F.row_number().over(w)).where(c("_i") <= latest)
    live = c("filed") >= F.date_sub(as_of, days)
    return recent.groupBy("symbol").agg(F.count_if(live & F.arrays_overlap("items", F.array(*[F.lit(x) for x in SIGNIFICANT]))).alias("recent_events"), F.count_if(live & F.array_contains("items", "2.02")).alias("recent_earnings"))


def filing_signal(b: DataFrame) -> DataFrame:
    """Insider signal, executives' purchases less sales, and many events (which are uncertainty) in one signal."""
    clip = lambda x: F.least(F.greatest(x, F.lit(-0.2)), F.lit(0.2))
    return b.withColumn("sec_signal", 0.6 * c("insider_signal") + clip(0.1 * c("executive_activity")) + clip(-0.05 * c("recent_events")))


def form_weight(form: Column) -> Column:
    """weight of a filing by its form, 0.5 for others."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in FORM_WEIGHTS.items() for x in kv]), form), F.lit(0.5))


def holdings_change(now: DataFrame, before: DataFrame) -> DataFrame:
    """New, closed, increased and decreased positions between two quarters, by symbol."""
    j = now.select("holder", "symbol", F.col("shares").alias("a")).join(before.select("holder", "symbol", F.col("shares").alias("b")), ["holder", "symbol"], "full_outer")
    return j.groupBy("symbol").agg(F.count_if(c("b").isNull()).alias("new"), F.count_if(c("a").isNull()).alias("closed"), F.count_if(c("a") > c("b")).alias("increased"), F.count_if(c("a") < c("b")).alias("decreased"), (F.coalesce(F.sum("a"), F.lit(0)) - F.coalesce(F.sum("b"), F.lit(0))).alias("net_change"))


def parse_dates(text: Column) -> Column:
    """the first of several formats that fits; null if none does. Dates of feeds ("Tue, 02 Jan 2024 10:00:00 -0500") keep their own
    clock time, without the offset."""
    t = F.trim(text)
    own = F.regexp_replace(t, r"^[A-Za-z]{3}, (\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) ([+-]\d{2}:?\d{2}|Z|GMT)$", "$1")
    formats = ("yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyyMMdd'T'HHmmss", "yyyy-MM-dd")
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in formats], F.try_to_timestamp(own, F.lit("d MMM yyyy HH:mm:ss")))


def posts_from_json(df: DataFrame, payload: str = "payload", most: int = 1000) -> DataFrame:
    """Data.children[].data to rows, with defaults."""
    one = "struct<title:string,selftext:string,score:bigint,num_comments:bigint,created_utc:double,subreddit:string,author:string,url:string,upvote_ratio:double>"
    rows = df.select(F.explode(F.from_json(payload, f"struct<data:struct<children:array<struct<data:{one}>>>>")["data"]["children"]).alias("c")).select("c.data.*")
    return rows.select(F.coalesce("title", F.lit("")).alias("title"), F.substring(F.coalesce("selftext", F.lit("")), 1, most).alias("selftext"), F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("num_comments", F.lit(0)).alias("num_comments"), F.timestamp_seconds("created_utc").alias("created_utc"), "subreddit", "author", "url", F.coalesce("upvote_ratio", F.lit(0.5)).alias("upvote_ratio"))


def filings_from_json(df: DataFrame, payload: str = "payload", forms: tuple[str, ...] = (), k: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Parallel arrays to rows, the given forms only, the first k of each payload (one a company) in its own order."""
    f = F.from_json(payload, "struct<filings:struct<recent:struct<form:array<string>,filingDate:array<string>,accessionNumber:array<string>,items:array<string>>>>")["filings"]["recent"]
    both = F.arrays_zip(f["form"].alias("form"), f["filingDate"].alias("filed"), f["accessionNumber"].alias("accession"), f["items"].alias("items"))
    both = F.filter(both, lambda x: x["form"].isin(*forms)) if forms else both
    rows = df.select(*keep, F.explode(F.slice(both, 1, k) if k else both).alias("x")).select(*keep, "x.*")
    return rows.select(*keep, "form", F.to_date("filed").alias("filed"), "accession", F.split("items", ",").alias("items"))


def chunked_scores(df: DataFrame, lexicon: DataFrame, text: str = "text", key: str = "doc_id", size: int = 5000) -> DataFrame:
    """Mean compound score of a long document's chunks, over the whole text."""
    parts = df.select(key, F.posexplode(chunks(c(text), size)).alias("part", "text"))
    return lexicon_scores(parts, lexicon, "text", (key, "part")).groupBy(key).agg(F.avg("compound").alias("compound"), F.count("*").alias("parts"))
