"""The corpus pipeline: five stages over ``documents``, each on what the one before kept.

Every stage but the last returns the columns of ``documents``. Its result is written as Parquet in
the shared folder and read again for the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import decontamination, language_id, line_dedup, packing, simhash
from loomspark.llm.common import bounded_batches, broadcast_if_few, materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document of at least so many bytes whose best language needs more bits a byte than this is in none of the languages.
LEAST_BYTES, MOST_BITS = 32, 6.0


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a letter go, and those that no learned language codes within ``MOST_BITS``.

    Null, empty and letterless texts go; a shorter text than ``LEAST_BYTES`` bytes says too little to be
    rejected. Without labelled rows everything goes. Rows are judged one by one, so repeated rows share
    their fate, and null ids, very long texts and columns of other names change nothing.
    """
    bounded_batches(spark)
    model = language_id.train_ppm(language_id.training_sample(docs))
    found = language_id.identify(docs, model, keep=COLUMNS[1:])
    coded = (F.col("bits_per_byte") <= MOST_BITS) | (F.octet_length("text") < LEAST_BYTES)
    return found.where((F.col("lang_pred") != language_id.UNDETERMINED) & coded).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: repeated lines go, and documents of which no text is left.

    The earliest document (smallest doc_id, then line) keeps a line. Null texts and null ids stay as
    they are; repeated rows of one doc_id are one document; n_chars follows a text that was cut.
    """
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    out = line_dedup.line_dedup(docs, keep=tuple(rest))
    emptied = (F.col("n_exact") + F.col("n_near") > 0) & (F.trim(F.coalesce("text", F.lit(""))) == "")
    out = out.where(~emptied).withColumn("n_chars", F.when(F.col("n_exact") + F.col("n_near") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: of each group of near duplicates the document with the smallest id stays.

    Fingerprints of five-word shingles within 2 bits, verified at a similarity of 0.8; similar pairs whose
    fingerprints are farther apart are found by a prefix filter. Texts without words are one group. Repeated rows of
    the document that stays all stay; a row without an id belongs to no group and stays.
    """
    groups = simhash.near_duplicates(docs)
    gone = groups.where("doc_id <> group_id").select("doc_id").distinct()
    return docs.join(broadcast_if_few(gone), "doc_id", "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold most of a benchmark item go.

    Null and empty texts stay, as do all documents where the benchmark is empty; repeated rows share
    their fate, and a null id changes nothing.
    """
    found = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS[1:])
    return found.where("not contaminated").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: one row per piece with its sequence and offset. A null or empty text is one end token."""
    return packing.best_fit_packing(docs)


STAGES = [
    ("language_id", keep_known_language),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("best_fit_packing", pack_sequences),
]

#: The language model, the fingerprints and the tokenizer have no SQL form; tests/llm compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; the packed pieces."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
