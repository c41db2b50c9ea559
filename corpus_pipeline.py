"""Corpus preparation in five stages; each takes and (but for the last) returns the columns of `documents`.

1. language_id: documents to which the operator can give no language go: those that are null or have no letter. How
   sure a decision is does not matter: it falls with the number of languages, and short clean texts would go with it.
2. near_duplicates: one document of each group of linked documents stays, the one with the least id.
3. decontamination: documents that hold a passage of `benchmark` go.
4. secret_scan: secrets are replaced by a mark in place; every document stays.
5. sentencepiece: texts become piece ids, which decode to the text.

A stage sees all that the one before kept. Null texts end at stage 1; repeated rows are duplicates; texts are read
whole at every length; an empty table stays empty. Extra columns pass through all but the last, under any name that
does not begin with two underscores, as the stages' own columns do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm import decontaminate, jaccard, langid, pieces, secrets
from pairwright.llm.common import fold_of, releases_shuffles, stored, table, tokenizer_path
from pairwright.llm.queries import PIECE_MODEL


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from labelled documents outside the held-out fold; keeps what it can name."""
    model = langid.fit(docs.where(fold_of(F.col("doc_id"), 4) != 2))
    named = langid.identify(docs, model, lang_out="__lang", score_out="__score")
    return named.where(F.col("__lang") != langid.UND).drop("__lang", "__score")


@releases_shuffles
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity of 0.8 or more; wordless texts are never duplicates.

    A bitmap of hashed ids tells which documents cannot be among the dropped: they stay where they are. Only the
    others, the dropped and a few more, meet the list of kept ids in a join.
    """
    classes = stored(spark, jaccard.join_classes(spark, docs, links=False).select(F.col("doc_id").alias("__keep"), F.col("doc_id").eqNullSafe(F.col("component_id")).alias("stays")), "kept")
    keep = classes.where("stays").select("__keep")
    suspect = jaccard.id_filter(classes.where("NOT stays").select("__keep"))
    repeated = keep.groupBy("__keep").count().where("count > 1").limit(1).count() > 0
    near = docs.where(suspect("doc_id")).join(keep.distinct(), F.col("doc_id").cast("long").eqNullSafe(F.col("__keep")), "left_semi")
    out = docs.where(~suspect("doc_id")).unionByName(near)
    return out.dropDuplicates(["doc_id", "text"]) if repeated else out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"), out="__leaks")
    return found.where(F.size("__leaks") == 0).drop("__leaks")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secrets.scan(docs, secrets.train(), out="__secrets")
    clean = secrets.redact("text", "__secrets")
    count = F.when(F.size("__secrets") > 0, F.char_length(clean).cast("long")).otherwise(F.col("n_chars"))
    return found.withColumns({"n_chars": count, "text": clean}).select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = pieces.encode(docs.select("doc_id", "text"), tokenizer_path(PIECE_MODEL), out="__p")
    return done.select("doc_id", F.coalesce(F.size("__p.ids"), F.lit(0)).cast("long").alias("n_pieces"), F.col("__p.ids").alias("ids"), F.col("__p.round_trip").alias("round_trip"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("sentencepiece", sentencepiece),
]
#: SQL cannot express a trained classifier; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
