"""Line dedup with built-in functions only: levelled sorted runs of line hashes that each batch of documents is merged against.

A run is a table of distinct line hashes, bucketed and sorted by the hash. Documents come in batches of ascending id. Each batch
reduces its lines to one row a hash, merge-anti-joins these with all runs (buckets meet buckets, nothing of a run is shuffled), and adds
those that no run has as its own run. Level i has one run at most: a second one is merged with it into a run of level i + 1, so n
batches leave at most log2(n) + 1 runs and each hash is rewritten at most as often.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import key_join, shared_dir, written

BATCHES = 4
LEAST = 10
SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LAST = 2**63 - 1
#: Lets a scan of a run with one file a bucket say that its rows are sorted.
SORTED = "spark.sql.legacy.bucketedTableScan.outputOrdering"
HASH = ["a", "b"]


class Runs:
    """The runs of a growing set of line hashes. add() takes batches in any number; close() forgets the tables' names, their files stay
    in the shared folder."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.levels, self.names = spark, {}, []  # level: name of its run; all tables
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    @contextmanager
    def _sorted(self) -> Iterator[None]:
        before = self.spark.conf.get(SORTED, "false")
        self.spark.conf.set(SORTED, "true")
        try:
            yield
        finally:
            self.spark.conf.set(SORTED, before)

    def _save(self, df: DataFrame) -> str:
        name = f"tidemill_run_{uuid.uuid4().hex}"
        self.names.append(name)
        df.write.format("parquet").bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", f"{shared_dir(self.spark)}/{name}").saveAsTable(name)
        return name

    def _run(self, name: str) -> DataFrame:
        return self.spark.table(name).where("not seen").select(*HASH)

    def add(self, keys: DataFrame) -> DataFrame:
        """keys: a, b and what else goes with a hash, one row a hash. Returns them with `seen`, whether an earlier batch had the hash."""
        with self._sorted():
            seen = F.lit(False)
            for level, name in sorted(self.levels.items()):
                keys = keys.join(self._run(name).withColumn(f"in_{level}", F.lit(True)).hint("merge"), HASH, "left")
                seen = seen | F.coalesce(f"in_{level}", F.lit(False))
            own = self._save(keys.withColumn("seen", seen).drop(*[f"in_{x}" for x in self.levels]))
            out, level = self.spark.table(own), 0
            while level in self.levels:  # the hashes of two runs differ, so their outer merge is their union in order
                both = self._run(self.levels.pop(level)).join(self._run(own).hint("merge"), HASH, "full_outer")
                own, level = self._save(both.withColumn("seen", F.lit(False))), level + 1
            self.levels[level] = own
        return out

    def close(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def remove_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, batches: int = BATCHES) -> DataFrame:
    """(key, n_lines long, n_dropped long, kept string), one row a row of docs: the text without the lines that an earlier document has.

    Lines are what \\n parts; lines are alike if equal without white space at both ends and with A-Z lower-cased, and of `least` code
    points at least so. Of documents with like lines the one with the smallest key keeps all of its lines. A null or
    empty text is one empty line. A null key comes behind all others, and rows of one key are one document: none
    loses a line to another. Lines are told apart by 128 bits of hash. Lines that are very frequent are joined by broadcast
    (common.key_join); texts are shuffled once, to meet the numbers of the lines that they lose.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).withColumns({"o": F.coalesce(F.col("k").cast("long"), F.lit(LAST)), "th": F.xxhash64("t")})
    cuts = rows.agg(F.percentile_approx("o", [i / batches for i in range(1, batches)]).alias("p")).first()["p"] or [] if batches > 1 else []
    number = sum(((F.col("o") > x).cast("int") for x in sorted(set(cuts))), F.lit(0))
    line = F.btrim("line", F.lit(SPACE))
    lines = (
        rows.select("o", "th", number.alias("batch"), F.posexplode(F.split(F.translate("t", UPPER, LOWER), "\n")).alias("pos", "line"))
        .select("o", "th", "batch", "pos", line.alias("line"))
        .where(F.char_length("line") >= least)
        .select("o", "th", "batch", "pos", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), F.col("line")).alias("b"))
    )
    lines = written(lines, "batch")
    sizes = {r["batch"]: r["n"] for r in lines.groupBy("batch").agg(F.count("*").alias("n")).collect()}  # one row a batch
    runs, gone = Runs(spark), []
    for i, total in sorted(sizes.items()):
        own = lines.where(F.col("batch") == i).drop("batch")
        keys = own.groupBy(*HASH).agg(F.min("o").alias("low"), F.max("o").alias("high"), F.count("*").alias("n"))
        again = runs.add(keys).where("seen or low < high").select(*HASH, "n", F.when(~F.col("seen"), F.col("low")).alias("low"))
        gone.append(written(key_join(own, again, HASH, "n", total).where("low is null or o > low").select("o", "th", "pos")))
    runs.close()
    every = spark.createDataFrame([], "o long, th long, pos int")
    for x in gone:
        every = every.union(x)
    lost = every.groupBy("o", "th").agg(F.collect_set("pos").alias("lost"))
    found = rows.withColumn("l", F.split(F.coalesce("t", F.lit("")), "\n")).join(lost, ["o", "th"], "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("l") - 1), "lost")
    kept = F.when(F.col("lost").isNull(), F.coalesce("t", F.lit(""))).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col("l"), i)), "\n"))
    return found.select(F.col("k").alias(key), F.size("l").cast("long").alias("n_lines"), F.when(F.col("lost").isNull(), 0).otherwise(F.size("lost")).cast("long").alias("n_dropped"), kept.alias("kept"))


def remove_lines_sql(least: int = LEAST) -> str:
    """The registered query's rows over the table documents, in DuckDB's SQL."""
    space = " || ".join(f"chr({ord(x)})" for x in SPACE)
    return f"""
    WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
    lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM split),
    keyed AS (SELECT *, translate(trim(line, {space}), '{UPPER}', '{LOWER}') AS k FROM lines),
    first_of AS (SELECT k, min(doc_id) AS low FROM keyed WHERE length(k) >= {least} GROUP BY k HAVING count(DISTINCT doc_id) > 1),
    marked AS (SELECT doc_id, line, i, low IS NOT NULL AND doc_id > low AS gone FROM keyed LEFT JOIN first_of USING (k))
    SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
      sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY doc_id
    """
