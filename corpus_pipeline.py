"""From documents to token shards: toxicity, near-dedup, decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's ``docs``. All but the last return
the columns of documents and drop others. Rows are told apart by a digest of all
columns that names the columns, so NULL and repeated ids do no harm; rows that
are equal in every column are one row to near-dedup and mixing. Empty tables stay
empty; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm import decontamination, mixing, simhash, token_shards, toxicity
from emberline.llm.common import Workspace, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
KINDS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def documents(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.col(c).cast(KINDS[c]).alias(c) for c in COLUMNS])


def with_row(docs: DataFrame) -> DataFrame:
    """``row``: SHA-256 of a row. JSON leaves NULL columns out and names the others, so no two rows look alike."""
    rows = documents(docs)
    short = [F.sha2("text", 256).alias(c) if c == "text" else F.col(c) for c in COLUMNS]
    return rows.withColumn("row", F.sha2(F.to_json(F.struct(*short)), 256))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5, learned from ``labels``."""
    rows = documents(docs)
    model = toxicity.train(rows, table(spark, sf_dir, "labels"))
    return model.score(rows, *COLUMNS).filter("score < 0.5").select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (3-word shingles, 2 bits): the one with the smallest id, of several the one with the smallest digest."""
    rows = with_row(docs)
    kept = Workspace(spark, "copies").keep(simhash.representatives(rows, "row"), "kept")
    return rows.join(kept, "row", "left_semi").dropDuplicates(["row"]).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no verified passage of ``benchmark``. It depends on the text alone, so its digest names it."""
    rows = documents(docs).withColumn("name", F.xxhash64(F.sha2("text", 256)))
    ws = Workspace(spark, "leaks")
    hits = ws.keep(decontamination.find_leaks(rows, table(spark, sf_dir, "benchmark"), id_col="name").select("name").distinct(), "hits")
    return rows.join(hits, "name", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document a whole number of times, so that every source ends within a document of its target."""
    rows = with_row(docs)
    copies = Workspace(spark, "mix").keep(mixing.copies(rows, "row"), "copies")
    out = rows.join(copies, "row").dropDuplicates(["row"])
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) as read back from the shards."""
    import public_tokenizers

    return token_shards.token_table(documents(docs), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("token shards", write_tokens),
]

#: The stages learn models and use tokenizers, which SQL cannot express; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = ws.keep(docs, f"stage{k}")
    return docs
