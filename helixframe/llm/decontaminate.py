"""Benchmark decontamination with DataFrame functions alone: size-partitioned MinHash containment search.

Words are runs of letters and digits of the lower-cased text; a text's shingles are its distinct ``k``-word sequences, and
an item with fewer words is one shingle of all its words. A document holds an item when at least ``share`` of the item's
shingles occur in it, however long the document is.

Items are partitioned by size, powers of two. In a partition whose largest size is u, an item's signature are its
``floor((1 - share) * u) + 1`` shingles of smallest hash (all, if it has fewer). A document that holds the item lacks at most
``(1 - share) * u`` of its shingles, so it holds one of the signature: looking up every shingle of a document in the
signatures misses nothing. Candidates are verified by the containment of the shingles' texts.

Null and empty texts hold nothing, items without words are in nothing. Repeated rows of a document or an item count once per
(doc_id, item_id), with the highest containment. Rows with a null id take no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import rows_of, stored

SHINGLE, SHARE = 5, 0.8
#: Item shingles that are broadcast at most; with more, the joins are left to shuffles.
BROADCAST_ROWS = 200_000


def words_of(text):
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _at(words, k: int, make):
    """``make`` of each run of ``k`` words; an empty array for shorter texts."""
    last = F.size(words) - k
    runs = F.transform(F.sequence(F.lit(0), last), lambda i: make(*[F.get(words, i + j) for j in range(k)]))
    return F.when(last >= 0, runs)


def _text(*w):
    return F.concat_ws(" ", *w)


def _both(*w):
    return F.struct(_text(*w).alias("shingle"), F.xxhash64(*w).alias("h"))


def item_shingles(items: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(item, item_id, len, n, shingle, h): distinct shingles of each item; ``len`` are the words of a shingle."""
    it = items.select(F.col(id_col).cast("long").alias("item_id"), words_of(F.col(text_col).cast("string")).alias("w")).where(
        F.col("item_id").isNotNull() & (F.size("w") > 0)).distinct()
    it = it.withColumn("item", F.xxhash64("item_id", "w")).withColumn("len", F.least(F.size("w"), F.lit(k)))
    own = F.lit(None)
    for n in range(1, k + 1):
        own = F.when(F.col("len") == n, _at(F.col("w"), n, _both)).otherwise(own)
    it = it.withColumn("s", F.array_distinct(own)).withColumn("n", F.size("s"))
    return it.select("item", "item_id", "len", "n", F.explode("s").alias("s")).select("item", "item_id", "len", "n", "s.shingle", "s.h")


def signatures(shingles: DataFrame, share: float) -> DataFrame:
    """The MinHash signature of each item: (item, len, h)."""
    part = shingles.withColumn("part", F.ceil(F.log2("n")))
    largest = part.groupBy("part").agg(F.max("n").alias("u"))
    order = Window.partitionBy("item").orderBy("h", "shingle")
    m = F.floor((1 - share) * F.col("u") + 1e-9) + 1
    return (part.join(F.broadcast(largest), "part").withColumn("r", F.row_number().over(order)).where(F.col("r") <= m)
            .select("item", "len", "h"))


def find_items(docs: DataFrame, items: DataFrame, k: int = SHINGLE, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text",
               item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of every item that a document holds."""
    shingles = stored(item_shingles(items, k, item_id, item_text))
    lengths = [r["len"] for r in shingles.select("len").distinct().orderBy("len").collect()]  # k values at most
    small = shingles.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    hint = F.broadcast if small else (lambda df: df)
    rows = rows_of(docs, id_col, text_col).where(F.col("doc_id").isNotNull())
    worded = rows.select("doc_id", words_of(F.col("text")).alias("w"))
    none = rows.sparkSession.createDataFrame([], "doc_id long, item long")
    found = [worded.select("doc_id", F.explode(_at(F.col("w"), n, F.xxhash64)).alias("h"))
             .join(hint(signatures(shingles, share).where(F.col("len") == n).select("item", "h").distinct()), "h").select("doc_id", "item")
             for n in lengths]
    candidates = none
    for f in found:
        candidates = candidates.union(f)
    candidates = candidates.distinct()
    whole = shingles.groupBy("item", "item_id", "len", "n").agg(F.collect_list("shingle").alias("s"))
    pairs = candidates.join(rows, "doc_id").join(hint(whole), "item")
    pairs = pairs.select("doc_id", "item_id", "n", "len", "s", words_of(F.col("text")).alias("w"))
    own = F.lit(None).cast("array<string>")
    for n in range(1, k + 1):
        own = F.when(F.col("len") == n, _at(F.col("w"), n, _text)).otherwise(own)
    shared = F.size(F.array_intersect("s", own))
    return (pairs.select("doc_id", "item_id", F.col("n").cast("long").alias("n_item"), shared.cast("long").alias("n_shared"))
            .withColumn("containment", F.col("n_shared") / F.col("n_item"))
            .groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "n_item", "n_shared")).alias("b"))
            # after the aggregate: a filter before it would be pushed into the projection and split the text anew for every shingle
            .where(F.col("b.n_shared") >= share * F.col("b.n_item") - 1e-9)
            .select("doc_id", "item_id", "b.n_item", "b.n_shared", "b.containment"))


def find_sql(k: int = SHINGLE, share: float = SHARE) -> str:
    """DuckDB twin of :func:`find_items` on ``documents`` and ``benchmark``."""
    words = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    runs = "list_transform(range(len(w) - {0} + 1), lambda i: array_to_string(w[i + 1:i + {0}], ' '))"
    return f"""WITH b AS (SELECT DISTINCT item_id, {words.format('text')} AS w FROM benchmark WHERE item_id IS NOT NULL),
i AS (SELECT row_number() OVER () AS item, item_id, least(len(w), {k}) AS k,
 list_distinct(CASE WHEN len(w) < {k} THEN [array_to_string(w, ' ')] ELSE {runs.format(k)} END) AS s FROM b WHERE len(w) > 0),
u AS (SELECT item, item_id, k, len(s) AS n, unnest(s) AS s FROM i),
d AS (SELECT row_number() OVER () AS doc, doc_id, {words.format('text')} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
g AS (SELECT DISTINCT doc, doc_id, k, unnest(list_transform(range(greatest(len(w) - k + 1, 0)), lambda i: array_to_string(w[i + 1:i + k], ' '))) AS s
 FROM d, (SELECT DISTINCT k FROM i)),
m AS (SELECT doc, doc_id, item, item_id, n, count(*) AS n_shared FROM g JOIN u USING (k, s) GROUP BY ALL),
o AS (SELECT *, n_shared::DOUBLE / n::DOUBLE AS containment FROM m WHERE n_shared >= {share}::DOUBLE * n - 1e-9)
SELECT doc_id, item_id, n::BIGINT AS n_item, n_shared::BIGINT AS n_shared, containment FROM o
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY containment DESC, n DESC, n_shared DESC) = 1"""
