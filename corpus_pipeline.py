"""The corpus pipeline: language ID, near-duplicates, repeated strings, mixing, byte-level BPE. Each stage works on all that the
one before it kept, and is written as Parquet. The stages hold the session to small Arrow batches (BATCH), by which the memory of
executors and their Python workers does not follow the length of the texts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm import byte_bpe, language, mixing, near_dedup, repeats
from tidemill.llm.common import ARROW, fold, stored, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SIMILAR = 80
BATCH = 8 << 20  # bytes of a batch (and one row) that a task sends to its Python worker
MIXTURE = "tidemill.mixture"  # in the metadata of doc_id: the table with the place of each row in the mixture
PARTS, LEAST_PART = 8192, 64  # stretches of the mixture whose tokens are added up, and the least rows of one


def _small_batches(spark: SparkSession) -> None:
    """From now on the session sends batches of BATCH bytes: what a stage returns is only run when its caller writes it."""
    spark.conf.set(ARROW, str(BATCH))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language: those that are null or have no letter go. lang becomes the predicted language."""
    _small_batches(spark)
    docs = docs.select(*COLUMNS)
    model = language.fit(docs.where(fold(F.col("doc_id"), 5) != 0))
    found = language.predict(docs, model, keep=("doc_id", "source", "n_chars", "text"))
    return found.where(F.col("lang_pred") != language.UNKNOWN).select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def _once(docs: DataFrame) -> DataFrame:
    """One row for each doc_id, that with the text of least hash; rows without an id stay."""
    n = docs.agg(F.count("doc_id").alias("n"), F.countDistinct("doc_id").alias("d")).first()
    if n["n"] == n["d"]:
        return docs
    rest = [x for x in COLUMNS if x != "doc_id"]
    order = F.struct(F.coalesce(F.xxhash64("text"), F.lit(0)), *[x for x in rest if x != "text"])
    one = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min_by(F.struct(*rest), order).alias("r")).select("doc_id", *[F.col(f"r.{x}").alias(x) for x in rest])
    return written(one.unionByName(docs.where("doc_id is null")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates (SIMILAR percent or more), the one with the smallest id."""
    _small_batches(spark)
    docs = _once(docs.select(*COLUMNS))
    gone = near_dedup.near_duplicates(docs, percent=SIMILAR).where("not kept").select("doc_id")
    return docs.join(written(gone), "doc_id", "left_anti").select(*COLUMNS)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts from each document what repeats an earlier one, by whole code points; documents of which nothing is left go."""
    _small_batches(spark)
    cut = repeats.remove_repeats(docs.select(*COLUMNS), whole_letters=True, carry=("lang", "source"))
    text = F.col("kept").cast("string")
    return cut.where(F.length("kept") > 0).select("doc_id", text.alias("text"), "lang", "source", F.char_length(text).cast("long").alias("n_chars"))


def _told_apart(docs: DataFrame) -> DataFrame:
    """The documents with `row`, a hash by which a row is found again in whatever partition; equal rows are numbered first."""
    rows = docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("row"))
    if (rows.groupBy("row").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) <= 1:
        return rows
    again = F.row_number().over(Window.partitionBy("row").orderBy("doc_id", "source", "lang", "n_chars"))
    return rows.withColumn("again", again).withColumn("row", F.xxhash64("row", "again")).drop("again")


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of sources by their natural shares, in its order; every document has a place in it. The places are stored, and
    named in the metadata of doc_id, which outlive a Parquet table: the next stage lays out its tokens by them."""
    rows = _told_apart(docs)
    places = stored(mixing.mix(rows.select("doc_id", "source", "row"), carry=("row",)).select("row", "position"))
    mix = rows.join(spark.read.parquet(places), "row")
    ordered = mix.repartitionByRange(max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))), "position").sortWithinPartitions("position")
    return ordered.select(F.col("doc_id").alias("doc_id", metadata={MIXTURE: places}), *COLUMNS[1:])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes every text: doc_id, lang, source, n_tokens, ids_sha256, decoded_sha256, and where the tokens lie in the
    training sequence that the mixture sets: position of the document, first_token (tokens of the documents before it). Both are null for
    documents that the mixing stage has not placed."""
    _small_batches(spark)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    places = docs.schema["doc_id"].metadata.get(MIXTURE)
    rows = _told_apart(docs) if places else docs.select(*COLUMNS, F.lit(0).cast("long").alias("row"))
    coded = byte_bpe.round_trip(rows, path, public_tokenizers.PATTERN, keep=("doc_id", "lang", "source", "row"))
    own = ("doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256")
    if not places:
        return coded.select(*own, F.lit(None).cast("long").alias("position"), F.lit(None).cast("long").alias("first_token"))
    placed = written(coded.join(spark.read.parquet(places), "row", "left").select(*own, "position"))
    # tokens of earlier stretches, then of earlier documents in the stretch
    width = max(LEAST_PART, -(-placed.count() // PARTS))
    placed = placed.withColumn("part", F.floor(F.col("position") / width))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    before = placed.where("part is not null").groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(upto(Window.orderBy("part"))), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("n_tokens").over(upto(Window.partitionBy("part").orderBy("position"))), F.lit(0))
    return placed.withColumn("inside", inside).join(F.broadcast(before), "part", "left").select(*own, "position", (F.col("before") + F.col("inside")).alias("first_token"))


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("mixing sources", mixed_sources),
    ("byte-level BPE", tokens),
]

#: SQL cannot express the classifier, the sketches or the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs)
    return docs
