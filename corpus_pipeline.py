"""From raw documents to a training mix: five stages, each written as Parquet and read again by the next.

Every stage works on all documents that the stage before kept.  The first four return the columns of ``documents``:

1. toxicity: documents that the classifier rejects go.
2. line_dedup: lines that are boilerplate in their source go; a document whose lines all go stays with an empty text.
3. jaccard_join: of documents linked by near-equal texts (Jaccard of five-word shingles of 0.8 or more) one stays, that of the smallest id, of equal ids the
   one of the smallest sha-256; of rows that repeat an id and a text one stays.  A row goes for its text, so what else bears its id stays.  Empty
   documents, and rows of null id, stay.
4. decontamination: documents that hold a benchmark item go, by id; rows of null id are matched by null.
5. mixing: doc_id, source, size, source_size, target and taken of the documents that the mix takes at least once.

Empty tables give empty results, and further columns of the documents, whatever their names, pass through stages 1 to 4.
Column n_chars, where there is one, follows the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodevein.llm import decontam, jaccard, line_dedup, mixing, toxicity
from lodevein.llm.common import read, settle


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = line_dedup.dedup_lines(docs, docs["source"], counts=None)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


#: Near copies share 80 of 100 shingles of five words; op9_jaccard_join has a contract of its own.
NEAR_GRAM, NEAR_TOP = 5, 80


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key = "key"
    while any(c.startswith(key) for c in docs.columns):
        key += "_"
    own = [f"{key}id", f"{key}text"]
    gone, again = (settle(t.toDF(*own)) for t in jaccard.spare_documents(docs, NEAR_GRAM, NEAR_TOP))
    keyed = docs.withColumn(key, F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    named = (F.col("doc_id") == F.col(own[0])) & (F.col(key) == F.col(own[1]))
    kept = keyed.join(gone, named, "left_anti")
    if not again.isEmpty():  # else texts would move for nothing
        kept = kept.join(again, named, "left_anti").unionByName(kept.join(again, named, "left_semi").dropDuplicates(["doc_id", key]))
    return kept.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontam.contaminations(docs, read(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["__gone"]), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).filter("taken > 0")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: The first stage is a trained classifier, which SQL can't express; tests hold it against the model's own scores, the line stage against SQL, and
#: the Jaccard stage, the decontamination and the mix against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' way through all stages."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
