"""From raw documents to packed training sequences, in stages that are written and read again.

Each stage works on all that the one before kept, and its decisions take effect:

1. language ID: texts without a letter go, and those whose n-grams fit no language that was learned;
2. near duplicates: one document of each group stays, the one with the smallest doc_id;
3. repeated passages: bytes in strings of 200 bytes that occur elsewhere are cut out (the rest is decoded,
   and bytes that form no character any more are dropped); documents of which only white space is left go;
4. benchmark passages: contaminated documents go;
5. packing: token pieces with their sequences and places.

Stages 1 to 4 return the columns of documents. Rows with a null doc_id go through like any others. Rows that
share a doc_id are judged each by its own text in stage 2: of those with one text the first by lang, source
and n_chars stays, and a different text under the same id stays or goes on its own merits. Empty tables give
empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.decontamination import contamination
from tidemark.llm.frames import read_table
from tidemark.llm.language_id import languages
from tidemark.llm.minhash_dedup import near_duplicates
from tidemark.llm.packing import packed
from tidemark.llm.suffix_dedup import with_kept_text, without_repeats
from tidemark.storage import new_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# Of a text's n-grams, at least this part must be known in its language.
LEAST_SHARE = 0.1


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = languages(docs, carry=("text", "lang", "source", "n_chars"))
    return judged.where((F.col("lang_pred") != "und") & (F.col("share") >= LEAST_SHARE)).select(*COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    marked = docs.select(*COLUMNS, F.xxhash64("text", F.lit(1)).alias("own"))
    judged = near_duplicates(marked, carry=("own",)).where("kept and doc_id is not null")
    stay = judged.select("doc_id", "own").distinct()
    # Rows of one id and text: nearly always one, so the window sees no large group (copies have ids of their own).
    first = F.row_number().over(Window.partitionBy("doc_id", "own").orderBy("lang", "source", "n_chars"))
    named = marked.join(stay, ["doc_id", "own"], "left_semi").withColumn("nth", first).where("nth = 1")
    return named.select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = with_kept_text(without_repeats(docs, carry=("lang", "source")), carry=("lang", "source"))
    return cut.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def without_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = contamination(docs, read_table(spark, sf_dir, "benchmark"), carry=("text", "lang", "source", "n_chars"))
    return judged.where("not contaminated").select(*COLUMNS)


def into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs)


STAGES = [
    ("language_id", in_a_language),
    ("near_dedup", without_near_copies),
    ("suffix_dedup", without_repeated_passages),
    ("decontamination", without_benchmark_passages),
    ("packing", into_sequences),
]

# Similarity, suffixes, learned filters and packing are beyond SQL; tests rebuild the rows by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written below the shared folder and read from there."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
