"""Reading, building and writing bars: one row a (symbol, ts) with open, high, low, close, volume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BARS = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampType()), *[T.StructField(x, T.DoubleType()) for x in ("open", "high", "low", "close", "volume", "adj_close")]])

#: Names under which vendors deliver the same column.
ALIASES = {"adj close": "adj_close", "adjclose": "adj_close", "adjusted_close": "adj_close", "1. open": "open", "2. high": "high", "3. low": "low", "4. close": "close", "5. volume": "volume", "5. adjusted close": "adj_close", "6. volume": "volume", "date": "ts", "datetime": "ts", "timestamp": "ts"}


def standard(df: DataFrame) -> DataFrame:
    """Lower-cased and aliased column names; raises if a needed column is missing."""
    out = df.select([F.col(f"`{x}`").alias(ALIASES.get(x.strip().lower(), x.strip().lower().replace(" ", "_"))) for x in df.columns])
    if missing := {"open", "high", "low", "close", "volume"} - set(out.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    return out


def _between(df: DataFrame, symbols: list[str] | None, start: str | None, end: str | None) -> DataFrame:
    if symbols:
        df = df.where(F.col("symbol").isin(symbols))
    if start:
        df = df.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end:
        df = df.where(F.col("ts") <= F.lit(end).cast("timestamp"))
    return df


def read_csv_bars(spark: SparkSession, path: str, symbols: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """A folder of one CSV a symbol, the date in the first column; the symbol is the file's name."""
    raw = standard(spark.read.option("header", True).csv(path).withColumn("symbol", F.regexp_extract(F.col("_metadata.file_name"), r"^([^_.]+)", 1)))
    typed = raw.select("symbol", F.to_timestamp(F.col("ts") if "ts" in raw.columns else F.col(raw.columns[0])).alias("ts"), *[F.expr(f"try_cast(`{x}` as double)").alias(x) for x in ("open", "high", "low", "close", "volume", "adj_close") if x in raw.columns])
    return _between(typed, symbols, start, end)


def read_bars(spark: SparkSession, path: str, symbols: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Parquet bars partitioned by symbol and year; both filters reach the scan, dates also as years."""
    df = spark.read.parquet(path)
    if start:
        df = df.where(F.col("year") >= int(start[:4]))
    if end:
        df = df.where(F.col("year") <= int(end[:4]))
    return _between(df, symbols, start, end).drop("year")


def write_bars(df: DataFrame, path: str) -> None:
    """Parquet partitioned by symbol and year; replaces only the symbols and years in df."""
    years = df.withColumn("year", F.year("ts"))
    years.repartition("symbol", "year").write.option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "year").mode("overwrite").parquet(path)


def from_daily_json(df: DataFrame, payload: str = "payload", symbol: str = "symbol") -> DataFrame:
    """Nested daily series {date: {"1. open": ...}} to bars."""
    inner = F.from_json(F.col(payload), "map<string, map<string, string>>")
    rows = df.select(symbol, F.explode(inner).alias("day", "v"))
    get = lambda *names: F.coalesce(*[F.expr(f"try_cast(v['{n}'] as double)") for n in names])
    return rows.select(F.col(symbol).alias("symbol"), F.to_timestamp("day").alias("ts"), get("1. open", "open").alias("open"), get("2. high", "high").alias("high"), get("3. low", "low").alias("low"), get("4. close", "close").alias("close"), get("6. volume", "5. volume", "volume").alias("volume"))


def build_bars(ticks: DataFrame, symbol: Column, ts: Column, price: Column, size: Column, order: list[Column], interval: str = "week") -> DataFrame:
    """Bars from ticks. order: columns that make the order of ticks in a bar unique. Combines before its one shuffle."""
    rows = ticks.select(symbol.alias("symbol"), F.date_trunc(interval, ts).alias("ts"), price.cast("double").alias("p"), size.cast("double").alias("q"), F.struct(*order).alias("o"))
    return rows.groupBy("symbol", "ts").agg(F.min_by("p", "o").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "o").alias("close"), F.sum("q").alias("volume"))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


def brand_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars of each part brand."""
    lines = load(spark, sf_dir, "lineitem").select(*LINE_ORDER)
    part = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return build_bars(lines.join(part, "l_partkey"), F.col("p_brand"), F.col("l_shipdate"), F.try_divide("l_extendedprice", "l_quantity"), F.col("l_quantity"), [F.col(x) for x in LINE_ORDER])


def supplier_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars of each supplier: the panel whose symbols grow with the data."""
    lines = load(spark, sf_dir, "lineitem").select(*LINE_ORDER)
    return build_bars(lines, F.col("l_suppkey").cast("string"), F.col("l_shipdate"), F.try_divide("l_extendedprice", "l_quantity"), F.col("l_quantity"), [F.col(x) for x in LINE_ORDER])


def event_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of each event type; volume counts events."""
    events = load(spark, sf_dir, "events")
    return build_bars(events, F.col("event_type"), F.col("ts"), F.col("value"), F.lit(1.0), [F.col("ts"), F.col("event_id")], "hour")


def last_features(df: DataFrame, k: int = 100) -> DataFrame:
    """The last k bars of each symbol (the features sink)."""
    from pyspark.sql import Window

    w = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV sink; arrays are joined with '; '."""
    flat = [F.concat_ws("; ", x).alias(x) if isinstance(df.schema[x].dataType, T.ArrayType) else F.col(x) for x in df.columns]
    df.select(flat).write.mode("overwrite").option("header", True).csv(path)
