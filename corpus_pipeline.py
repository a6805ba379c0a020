"""A training-data pipeline over `documents`: five stages, each written and read again.

toxicity -> near_duplicates -> repeats -> decontamination -> pieces

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of `documents`, and each works on all that its predecessor kept.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.sizing import checkpoint_root, settle
from tidegauge.llm import contamination, labelled, near_copies, piece_codec, repeats, toxicity

MODEL = "piece_bpe_32k.model"
TOXIC = 0.5


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _plain(docs: DataFrame) -> DataFrame:
    """The columns an operator reads under their names, all others under names that none uses."""
    known = ("doc_id", "text", "n_chars")
    return docs.select(*[F.col(f"`{c}`").alias(c if c in known else f"_other_{i}") for i, c in enumerate(docs.columns)])


def _as_before(result: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of `docs` again."""
    known = ("doc_id", "text", "n_chars")
    return result.select(*[F.col(c if c in known else f"_other_{i}").alias(c) for i, c in enumerate(docs.columns)])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity is below one half; learnt from the labels of the training fold."""
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(labelled.fold(F.col("doc_id"), 5) != 0)
    # The labelled texts are those of the input table: a stage does not depend on what ran before.
    model = toxicity.fit_toxicity(_table(spark, sf_dir, "documents").select("doc_id", "text"), labels)
    return _as_before(model.documents(_plain(docs)).filter(F.col("score") < TOXIC), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies: that of its smallest `doc_id`.

    Near copies share four fifths of their 5-word shingles: SimHash (operator 6) links those of
    nearly equal fingerprints, MinHash those farther apart, and each link is counted exactly. Of several rows of that id in one
    component the one of the smallest text stays, then that of the least hash of its other
    columns; rows of one id in different components stay all. Rows with a null id and rows
    without words are no copies of anything and stay.
    """
    plain = _plain(docs)
    wordless = ~F.coalesce(F.col("text"), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    alone = F.col("doc_id").isNull() | wordless
    named = settle(near_copies.near_copies(plain.filter(~alone).select("doc_id", "text")))
    first = named.groupBy("root").agg(F.min("doc_id").alias("first"))
    ours = named.join(first, "root").filter("doc_id = first").select(F.col("doc_id").alias("_id"), F.col("code").alias("_code"), F.col("root").alias("_root")).distinct()
    # Only the id is a key of the join, so the rows are grouped as they lie.
    same = (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text").bitwiseXOR(F.col("_code")) == 0)
    rest = [name for name in plain.columns if name != "doc_id"]
    order = F.struct("text", F.xxhash64(F.to_json(F.struct(*rest))))
    one = plain.filter(~alone).join(ours, same).groupBy("doc_id", "_root").agg(F.min_by(F.struct(*rest), order).alias("_row"))
    kept = one.select(*["doc_id" if name == "doc_id" else F.col("_row")[name].alias(name) for name in plain.columns])
    return _as_before(kept.unionByName(plain.filter(alone)), docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 13-word windows that a smaller `doc_id` has too.

    Texts that lose nothing stay as they are; of the others the kept words are joined by one
    space and `n_chars` is counted anew; a document that loses all its words goes.
    """
    cut = repeats.remove_repeats(_plain(docs)).filter("n_removed = 0 or n_removed < n_words")
    changed = F.col("n_removed") > 0
    if "n_chars" in docs.columns:
        size = F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)
        cut = cut.withColumn("n_chars", F.when(changed, size).otherwise(F.col("n_chars")))
    return _as_before(cut.withColumn("text", F.when(changed, F.col("kept_text")).otherwise(F.col("text"))), docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which no benchmark item is covered by tiles; each row is judged by its own text."""
    return contamination.without_leaks(docs, _table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, and whether they decode to its text."""
    coded = piece_codec.encode_texts(docs.select("doc_id", "text"), public_tokenizers.path(MODEL))
    return coded.select("doc_id", "n_tokens", "round_trip", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", drop_repeats),
    ("decontamination", drop_contaminated),
    ("pieces", encode),
]

# A learnt model and a tokenizer are no SQL; tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; every stage's result is a table in the shared folder."""
    docs = _table(spark, sf_dir, "documents")
    root = f"{checkpoint_root(spark)}/tidegauge/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{root}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
