"""From raw documents to a training mixture, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run`` writes every result as Parquet in
the shared folder and reads it again for the next. All stages but the last return the columns of the documents.

1. ``quality``: documents that the quality classifier rejects go. The labels of ``sf_dir`` fit it.
2. ``near_dedup``: documents whose 5-word shingle sets overlap by 80 per cent or more are near copies (such a pair at the bound is missed with a
   probability below 1e-5: fewer than 15 of 32 coordinates agree), and of those that are linked the one with the smallest id stays. Rows are
   judged one by one: where an id is repeated, rows with different texts are different documents, which come before all others in
   a group of near copies, in the order of a hash of id and text; of rows with the same id and text the first by the other columns stays. Rows with a null id
   all stay.
3. ``decontaminate``: documents that hold an item of ``sf_dir``'s benchmark go, judged row by row as well. Rows with a null id stay.
4. ``pii``: personal data is replaced by its kind in brackets; ``n_chars``, where it is a column, follows the text.
5. ``mix``: documents are taken as often as the sources' target weights ask; ``copy`` (``copy_1`` and so on, where the documents have such a
   column) counts a document's copies from 0.

Null texts pass stage 1 by their score, are never linked, contaminated or changed, and have size 0 in the mixture. Empty tables
give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from helixframe.llm.common import shared_folder, stored, table
from helixframe.llm.decontaminate import find_items
from helixframe.llm.mixing import emit
from helixframe.llm.near_dedup import near_duplicates
from helixframe.llm.pii import redact
from helixframe.llm.quality import CUT, score, train

#: Repeated ids up to this number are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model, name="quality_score__")
    return scored.where(F.col("quality_score__") >= CUT).select(*[F.col(f"`{c}`") for c in docs.columns])


def by_row(docs: DataFrame) -> tuple[DataFrame, bool]:
    """The documents with an id of each (id, text), ``row__``, and whether any id is repeated (``again__``).

    An id that is not repeated is its own; others get a negative hash. Repeated ids are broadcast only where they are few.
    """
    twice = stored(docs.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("twice__")).agg(F.count("*").alias("c__")).where("c__ > 1").select("twice__"))
    n = twice.limit(BROADCAST_IDS + 1).count()
    if n == 0:
        return docs.withColumns({"row__": F.col("doc_id").cast("long"), "again__": F.lit(False)}), False
    own = docs.join(twice if n > BROADCAST_IDS else F.broadcast(twice), docs["doc_id"] == F.col("twice__"), "left")
    key = -1 - F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 62) - 1))
    own = own.withColumns({"again__": F.col("twice__").isNotNull(), "row__": F.when(F.col("twice__").isNull(), F.col("doc_id").cast("long")).otherwise(key)})
    return own.drop("twice__"), True


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own, repeated = by_row(docs)
    found = near_duplicates(own, percent=80, least=15, id_col="row__")
    stay = found.where("kept").select(F.col("doc_id").alias("stay__")).distinct()
    kept = own.join(stay, own["row__"] == F.col("stay__"), "left_semi")
    if repeated:
        plain = [f.name for f in docs.schema.fields if isinstance(f.dataType, AtomicType)]
        first = F.row_number().over(Window.partitionBy("row__").orderBy(*[F.col(f"`{c}`") for c in plain]))
        again = kept.where("again__").withColumn("first__", first).where("first__ = 1").drop("first__")
        kept = kept.where(~F.col("again__")).unionByName(again)
    return kept.drop("row__", "again__").unionByName(docs.where(F.col("doc_id").isNull()))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own, _ = by_row(docs)
    held = find_items(own, table(spark, sf_dir, "benchmark"), id_col="row__").select(F.col("doc_id").alias("held__")).distinct()
    return own.join(held, own["row__"] == F.col("held__"), "left_anti").drop("row__", "again__")


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return clean


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return emit(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pii", pii), ("mix", mix)]
#: A fitted classifier is no SQL; the tests compare ``run`` with brute-force versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark)
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs


def queries():
    return {"pipeline": run}


def oracles():
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
