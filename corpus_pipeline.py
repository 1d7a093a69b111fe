"""Training-corpus pipeline over documents: language, near duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rentwire.llm import best_fit, language, near_duplicates, private_data, wu_manber
from rentwire.llm._common import cut, table


def apart(docs: DataFrame, names: tuple[str, ...]) -> dict[str, str]:
    """New names of the columns that an operator would replace."""
    return {c: f"own_{c}_of_documents" for c in docs.columns if c in names}


def back(rows: DataFrame, docs: DataFrame, moved: dict[str, str]) -> DataFrame:
    return rows.select(*(F.col(f"`{moved.get(c, c)}`").alias(c) for c in docs.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that are too far from every language, null and letterless ones with them; fills a missing lang.

    Rows are judged by their text alone: rows that repeat and rows without doc_id are kept or dropped each. An empty table stays empty.
    """
    moved = apart(docs, ("lang_pred", "score", "rejected"))
    known = language.identify(docs.withColumnsRenamed(moved), language.fit(docs))
    return back(known.filter(~F.col("rejected")).withColumn("lang", F.coalesce("lang", "lang_pred")), docs, moved)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (five-word shingles, 0.8): the one with the smallest doc_id.

    Rows without doc_id come after all others; of rows that repeat a doc_id and its text one stays. Texts without words stay.
    """
    moved = apart(docs, ("kept_doc", "kept_hash"))
    kept = near_duplicates.groups(docs).filter("kept").select(F.col("doc_id").alias("kept_doc"), F.col("text_hash").alias("kept_hash")).distinct()
    once = docs.dropDuplicates(["doc_id", "text"]) if near_duplicates.repeats_ids(docs) else docs
    same = F.col("doc_id").eqNullSafe(F.col("kept_doc")) & (F.xxhash64("text") == F.col("kept_hash"))
    return back(once.withColumnsRenamed(moved).join(kept, same, "left_semi"), docs, moved)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a twentieth of their words or more in benchmark passages; rows that repeat go or stay together, an empty benchmark drops none."""
    moved = apart(docs, ("n_words", "n_hit", "hits", "items"))
    found = wu_manber.search_benchmark(docs.withColumnsRenamed(moved), table(spark, sf_dir, "benchmark"))
    return back(found.filter(~wu_manber.contaminated()), docs, moved)


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in the texts; every row stays, a null text null."""
    return private_data.mask(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences of 2048. Rows that repeat are packed as often as they come, a null doc_id stays null, a null text is an end token."""
    return best_fit.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicate),
    ("decontamination", decontaminate),
    ("private_data", mask_private),
    ("best_fit_packing", pack),
]
#: Language vectors, registers and token ids have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
