"""A corpus pipeline of five stages over ``documents``: quality filter, near-duplicate removal, repeated-passage removal,
benchmark decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``. SQL
can't express the stages' models, so tests hold them against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm import bpe, jaccard, leaks, quality, substrings
from tidewell.llm.common import fold_mod, saved, table

#: Bytes of a repeated passage: below the length of 50 words of ordinary prose, above that of a boilerplate line.
PASSAGE = 200


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.3 or more; learnt on the labelled documents outside the held-out fold.

    Null and empty texts are scored like any others; without labels every score is 0.5, so all stay; with labels of one
    class only, that class decides for all; rows without an id and repeated rows are judged by their text."""
    known = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).where(F.col("label").isin(0, 1))
    stats = saved(quality.with_statistics(docs.where(fold_mod("doc_id", 5) != 0).join(known.select("doc_id"), "doc_id", "left_semi")), "stats")
    model = quality.fit(stats.join(known, "doc_id"))
    return docs.where(quality.text_score(model, "text") >= 0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.75, that of the smallest id.

    Documents without an id, and texts without words, link with nothing and stay; of repeated rows (equal id and text) one
    stays; rows of one id with different texts are judged each by its own."""
    keyed = docs.withColumn("_row", F.xxhash64("text"))
    found = jaccard.linked(keyed.select("doc_id", "text", "_row"), row_col="_row")
    kept = keyed.join(found.where("doc_id = component_id").select("doc_id", "_row"), ["doc_id", "_row"], "left_semi")
    same = Window.partitionBy("doc_id", "_row").orderBy(*[F.to_json(F.struct(c)) for c in docs.columns if c not in ("doc_id", "text")] or [F.lit(0)])
    once = kept.withColumn("_n", F.row_number().over(same)).where("_n = 1").select(docs.columns)
    return once.unionByName(docs.where(F.col("doc_id").isNull()))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later copies of passages of PASSAGE bytes; the first copy, by id and place, stays, n_chars follows.

    All rows stay, with a text that may become empty; null texts stay null; rows without an id come after all others;
    repeated rows of the smallest id keep their text; cuts fall between characters."""
    out = substrings.removed(docs, PASSAGE, keep_first=True, texts=True)
    text = F.when(F.col("row.text").isNotNull(), F.col("kept"))
    return out.select(*[{"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("row.n_chars"))}.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose texts hold no item of the benchmark, with or without an id; rows are told apart by id and text.

    Null and wordless texts hold nothing and stay, as do all rows if the benchmark is empty; repeated rows go together."""
    keyed = docs.withColumn("_row", F.xxhash64("doc_id", "text"))
    found = leaks.leaked(keyed.select(F.col("_row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_row")).distinct()
    return keyed.join(saved(found, "leaked"), "_row", "left_anti").select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, with the digest of the decoded bytes. A null text has no tokens; every row gives a row."""
    out = bpe.tokenized(docs, *bpe.rank_file())
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality_filter),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontaminated),
    ("byte_bpe", encoded),
]

#: The classifier and the retrieval have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
