"""Licence scan with built-in functions only: lines, passages of lines and whole texts against licence notices, by Dice coefficient.

A text unit is a line, the whole text, or for each licence a passage: lines that share at least SHARED word pairs with its
notices, with at most GAP other lines between two of them, taken together without those. Notices that are wrapped, set in comments
or surrounded by other text, and whole licence files, are found as passages. Units and notices are lower-cased, everything but a-z and
0-9 becomes one space, and the distinct pairs of neighbouring words are compared: dice = 2 * common / (pairs of unit + pairs of
notice). A dice of t leaves sizes between t/(2-t) and (2-t)/t of the notice's, which prunes candidate notices; it also needs at
least t/(2-t) of the notice's pairs, so each notice has a few words of which every match holds one, and texts and lines without any
such word are never split into pairs.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import written
from tidemill.llm.licence_texts import NOTICES

LEAST = 0.8
SHARED = 2
GAP = 3
COMMON = set("a about all also an and any are as at be but by can copy do even following for free from has have in including is it made may more must no not of on only or other out own person product provided public purpose related rights see shall should source subject such terms that the these third this to under use used version was we whether which will with without work would year you".split())


def normal(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).strip()


def pairs(text: str) -> set[str]:
    words = normal(text).split()
    return {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


def notice_rows(notices: dict[str, list[str]] = NOTICES) -> list[tuple[str, int, int, str]]:
    """(licence, variant, size, pair), one row a pair."""
    return [(name, i, len(p), x) for name, texts in sorted(notices.items()) for i, t in enumerate(texts) for p in [pairs(t)] for x in sorted(p)]


def key_words(notices: dict[str, list[str]] = NOTICES, least: float = LEAST) -> list[str]:
    """Words such that every unit that reaches `least` with a notice holds one: they touch more pairs than a match can miss."""
    rest = [[set(x.split()) for x in sorted(pairs(t))] for texts in notices.values() for t in texts]  # pairs without a chosen word
    missing = [len(p) - math.ceil(least * len(p) / (2 - least) - 1e-9) + 1 for p in rest]
    chosen: set[str] = set()
    while any(missing):
        gain: Counter = Counter()
        for p, k in zip(rest, missing, strict=True):
            if k:
                for w, n in Counter(w for x in p for w in x).items():
                    gain[w] += min(k, n)
        best = max(gain, key=lambda w: (w not in COMMON and len(w) > 1, gain[w], w))
        chosen.add(best)
        for i, p in enumerate(rest):
            rest[i] = [x for x in p if best not in x]
            missing[i] = max(0, missing[i] - len(p) + len(rest[i]))
    return sorted(chosen)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", notices: dict[str, list[str]] = NOTICES, least: float = LEAST) -> DataFrame:
    """(key, line int, last_line int, licence, dice double): for every unit the best licence that reaches `least`; of equals the first by
    name. Lines count from 1; line = last_line is a single line, 0 the whole text of several lines, others are passages. Null, empty and
    unlike texts give no row; a repeated row gives its rows once, rows of one key with other texts are scanned each for itself.
    """
    spark = docs.sparkSession
    words = key_words(notices, least)

    def holds(c: Column) -> Column:
        return F.arrays_overlap(F.split(F.lower(c), "[^a-z0-9]+"), F.array(*[F.lit(w) for w in words]))

    def pairs_of(w: str) -> Column:
        return F.array_distinct(F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b)))

    known = spark.createDataFrame(notice_rows(notices), "licence string, variant int, size int, pair string")
    sizes = sorted({r[2] for r in notice_rows(notices)})
    lo, hi = least / (2 - least), (2 - least) / least
    if not sizes:
        return docs.where("false").select(key, F.lit(0).alias("line"), F.lit(0).alias("last_line"), F.lit("").alias("licence"), F.lit(0.0).alias("dice"))
    lines = F.split(F.col("t"), "\n")
    kept = written(
        docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
        .where(holds(F.col("t")))
        .withColumn("h", F.xxhash64("t"))
        .select("k", "h", F.posexplode(F.when(F.size(lines) > 1, F.concat(F.array("t"), lines)).otherwise(F.array(F.lit(None).cast("string"), F.col("t")))).alias("line", "unit"))
        .select("k", "h", "line", F.trim(F.regexp_replace(F.lower("unit"), "[^a-z0-9]+", " ")).alias("unit"))
        .where(F.contains("unit", F.lit(" ")))
    )
    units = kept.withColumn("w", F.split("unit", " ")).withColumn("p", pairs_of("w"))
    fits = (F.size("p") >= lo * sizes[0] - 1e-9) & (F.size("p") <= hi * sizes[-1] + 1e-9)
    alone = units.where(F.arrays_overlap("w", F.array(*[F.lit(w) for w in words])) & fits).select("k", "h", "line", F.col("line").alias("last"), F.lit(None).cast("string").alias("of"), F.size("p").alias("n"), "p")
    # the lines that share pairs with a licence's notices, and the passages that they form
    by_pair = known.groupBy("pair").agg(F.collect_set("licence").alias("of"))
    hits = units.where("line > 0").select("k", "h", "line", F.explode("p").alias("pair")).join(F.broadcast(by_pair), "pair")  # as many rows as the notices have pairs
    hits = hits.select("k", "h", "line", "pair", F.explode("of").alias("of")).groupBy("k", "h", "of", "line").agg(F.countDistinct("pair").alias("c")).where(F.col("c") >= SHARED).drop("c")
    by_doc = Window.partitionBy("k", "h", "of").orderBy("line")
    begins = F.coalesce(F.col("line") - F.lag("line").over(by_doc) > GAP + 1, F.lit(True)).cast("int")
    inside = hits.withColumn("b", begins).withColumn("i", F.sum("b").over(by_doc)).withColumn("many", F.count("*").over(Window.partitionBy("k", "h", "of", "i"))).where("many > 1")
    inside = inside.join(kept.where("line > 0").dropDuplicates(["k", "h", "line"]), ["k", "h", "line"])
    passages = inside.groupBy("k", "h", "of", "i").agg(F.min("line").alias("line"), F.max("line").alias("last"), F.array_sort(F.collect_list(F.struct("line", "unit"))).alias("l"))
    passages = passages.withColumn("w", F.split(F.concat_ws(" ", F.col("l")["unit"]), " ")).withColumn("p", pairs_of("w")).where(fits).select("k", "h", "line", "last", "of", F.size("p").alias("n"), "p")
    common = (
        alone.unionByName(passages)
        .select("k", "h", "line", "last", "of", "n", F.explode("p").alias("pair"))
        .join(F.broadcast(known), "pair")  # fixed by the notices
        .where((F.col("n") >= lo * F.col("size") - 1e-9) & (F.col("n") <= hi * F.col("size") + 1e-9) & (F.col("of").isNull() | (F.col("of") == F.col("licence"))))
        .groupBy("k", "h", "line", "last", "n", "licence", "variant", "size")
        .agg(F.countDistinct("pair").alias("c"))
    )
    like = common.select("k", "line", "last", "licence", (2 * F.col("c") / (F.col("n") + F.col("size"))).alias("dice")).where(F.col("dice") >= least)
    best = like.groupBy("k", "line", "last", "licence").agg(F.max("dice").alias("dice")).groupBy("k", "line", "last").agg(F.max_by(F.struct("licence", "dice"), F.struct("dice", F.translate("licence", UP, DOWN))).alias("b"))
    return best.select(F.col("k").alias(key), "line", F.col("last").alias("last_line"), "b.licence", "b.dice")


#: Reverses the order of names, so that the largest dice with the least name wins.
UP = "".join(map(chr, range(32, 127)))
DOWN = UP[::-1]


def scan_sql(notices: dict[str, list[str]] = NOTICES, least: float = LEAST) -> str:
    """The same rows over the table documents, in DuckDB's SQL, without the pruning by words."""
    values = ", ".join("('{}', {}, {}, '{}')".format(*r) for r in notice_rows(notices))
    lo, hi = least / (2 - least), (2 - least) / least
    return f"""
    WITH notices(licence, variant, size, pair) AS (VALUES {values}),
    pairs_by_licence AS (SELECT DISTINCT licence, pair FROM notices),
    lines AS (
      SELECT doc_id, CAST(i AS INTEGER) AS line, string_split(trim(regexp_replace(lower(u), '[^a-z0-9]+', ' ', 'g')), ' ') AS w
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS u, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
      UNION ALL
      SELECT doc_id, 0, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') FROM documents WHERE contains(text, chr(10))
    ),
    split AS (SELECT doc_id, line, w, list_distinct(list_transform(range(1, len(w)), lambda j: w[j] || ' ' || w[j + 1])) AS p FROM lines WHERE len(w) > 1),
    hits AS (SELECT doc_id, line, licence, any_value(w) AS w FROM (SELECT doc_id, line, w, unnest(p) AS pair FROM split WHERE line > 0) JOIN pairs_by_licence USING (pair) GROUP BY doc_id, line, licence HAVING count(*) >= {SHARED}),
    marked AS (SELECT *, CASE WHEN line - lag(line) OVER d <= {GAP + 1} THEN 0 ELSE 1 END AS b FROM hits WINDOW d AS (PARTITION BY doc_id, licence ORDER BY line)),
    numbered AS (SELECT *, sum(b) OVER (PARTITION BY doc_id, licence ORDER BY line) AS i FROM marked),
    passages AS (SELECT doc_id, licence AS own, CAST(min(line) AS INTEGER) AS line, CAST(max(line) AS INTEGER) AS last_line, flatten(list(w ORDER BY line)) AS w FROM numbered GROUP BY doc_id, licence, i HAVING max(line) > min(line)),
    units AS (
      SELECT doc_id, line, line AS last_line, NULL::VARCHAR AS own, p FROM split
      UNION ALL
      SELECT doc_id, line, last_line, own, list_distinct(list_transform(range(1, len(w)), lambda j: w[j] || ' ' || w[j + 1])) FROM passages
    ),
    exploded AS (SELECT DISTINCT doc_id, line, last_line, own, len(p) AS n, unnest(p) AS pair FROM units),
    common AS (
      SELECT doc_id, line, last_line, n, licence, variant, size, count(*) AS c FROM exploded JOIN notices USING (pair)
      WHERE n >= {lo}::DOUBLE * size - 1e-9 AND n <= {hi}::DOUBLE * size + 1e-9 AND (own IS NULL OR own = licence) GROUP BY ALL
    ),
    likes AS (SELECT doc_id, line, last_line, licence, max(2.0::DOUBLE * c / (n + size)) AS dice FROM common WHERE 2.0::DOUBLE * c / (n + size) >= {least} GROUP BY ALL)
    SELECT doc_id, line, last_line, licence, dice FROM likes QUALIFY row_number() OVER (PARTITION BY doc_id, line, last_line ORDER BY dice DESC, licence) = 1
    """
