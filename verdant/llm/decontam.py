"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Fixed masks choose token positions of each window; the hashes of test and training windows are joined, and each diagonal that
was hit is verified by aligning the whole item with the document there. An item leaks where some run of `window` aligned words
(or all of the aligned ones, if they are SPAN at least) has at least `least` of them, or that share, equal, so substitutions are
tolerated. The masks meet every pattern of substitutions that this allows (see test_op8_masks_cover_tolerance). Items of fewer
words than SPAN leak where all their words stand in a row: they are joined by the hash of the whole item. Case and punctuation
do not count.

The test hashes are broadcast only below MAX_BROADCAST of them, else shuffled. Null text and texts without words match nothing.
Repeated items and repeated documents give one row. Null ids match nothing; clean() keeps documents without one. Very long texts:
whole. Ties between places of one item: the best run counts. Other columns are not read. Empty tables: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, only, without, words

#: Positions that each mask reads: every pattern of 3 unequal words in 13, and of 2 in 10 to 12, leaves one of the masks equal somewhere.
MASKS = ((0, 2, 3, 4), (0, 3, 6, 8))
SPAN = 10
WINDOW = 13
LEAST = 10
MAX_BROADCAST = 1_000_000
PUNCTUATION = ".,;:!?\"'()[]{}#*$%&|<>`~^_=+/\\-"


def tokens(c: Column) -> Column:
    return words(F.translate(ascii_lower(F.coalesce(c, F.lit(""))), PUNCTUATION, ""))


def seeds(masks: dict[int, tuple[int, ...]]) -> Column:
    """(mask, place, hash) of each place of each mask in the words whose own hashes are in column h."""
    at = lambda i, mask: F.xxhash64(*[F.get("h", i + k) for k in mask])
    one = lambda m, mask: F.transform(F.sequence(F.lit(0), F.size("h") - mask[-1] - 1), lambda i: F.struct(F.lit(m).alias("m"), i.alias("p"), at(i, mask).alias("s")))
    return F.concat(*[F.when(F.size("h") > mask[-1], one(m, mask)).otherwise(F.array().cast("array<struct<m:int,p:int,s:bigint>>")) for m, mask in masks.items()])


def hashed(df: DataFrame, key: str, sizes: list[int], items: bool = False) -> DataFrame:
    """(key, m, p, s): hashes of the masks and of whole items of the given sizes under SPAN, as masks -size."""
    d = df.select(key, F.transform(tokens(F.col("text")), lambda x: F.xxhash64(x)).alias("h"))
    long = seeds(dict(enumerate(MASKS)))
    whole = {n: seeds({-n: tuple(range(n))}) for n in sizes}
    none = F.array().cast("array<struct<m:int,p:int,s:bigint>>")
    found = F.when(F.size("h") >= SPAN, long).otherwise(none)
    for n, own in whole.items():  # a short item has no hash but that of all its words
        found = F.concat(found, F.when(F.size("h") == n, own).otherwise(none) if items else own)
    return d.select(key, F.explode(found).alias("x")).select(key, F.col("x.m").alias("m"), F.col("x.p").alias("p"), F.col("x.s").alias("s"))


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """(doc_id, item_id, n_equal, n_aligned): items that a document holds, with the equal words of the best run."""
    n_words = F.size(tokens(F.col("text"))).alias("n")
    sizes = sorted(r["n"] for r in benchmark.select(n_words).where((F.col("n") > 0) & (F.col("n") < SPAN)).distinct().collect())  # SPAN - 1 at most
    test = hashed(benchmark, "item_id", sizes, items=True).withColumnRenamed("p", "q")
    small = test.count() <= MAX_BROADCAST
    side = F.broadcast(test) if small else test
    hit = cut(hashed(docs, "doc_id", sizes).join(side, ["m", "s"]).select("doc_id", "item_id", (F.col("p") - F.col("q")).alias("offset")).distinct())
    # the texts of documents without a hit are neither cut into words again nor shuffled
    texts = only(docs.select("doc_id", "text"), "doc_id", cut(hit.select("doc_id").distinct()))
    texts = texts.select(F.col("doc_id").alias("d"), tokens(F.col("text")).alias("w"))
    items = only(benchmark.select("item_id", "text"), "item_id", cut(hit.select("item_id").distinct()))
    items = items.select(F.col("item_id").alias("i"), tokens(F.col("text")).alias("item"))
    # words of the item and the document side by side: from the later of both starts to the earlier of both ends
    pair = hit.join(F.broadcast(items) if small else items, F.col("item_id") == F.col("i")).join(texts, F.col("doc_id") == F.col("d"))
    first = F.greatest(F.lit(0), -F.col("offset"))
    size = F.least(F.size("item") - first, F.size("w") - F.col("offset") - first)
    pair = pair.select("doc_id", "item_id", "offset", (F.size("item") < SPAN).alias("short"), F.slice("item", first + 1, size).alias("a"), F.slice("w", first + F.col("offset") + 1, size).alias("b"))
    pair = pair.withColumn("e", F.zip_with("a", "b", lambda x, y: (x == y).cast("int"))).withColumn("n", F.size("e"))
    run = F.least(F.lit(window), F.col("n"))
    sums = F.transform(F.sequence(F.lit(1), F.col("n") - run + 1), lambda i: F.aggregate(F.slice("e", i, run), F.lit(0), lambda a, x: a + x))
    pair = pair.select("doc_id", "item_id", "short", F.array_max(sums).alias("n_equal"), run.alias("n_aligned"))
    good = pair.where(F.when(F.col("short"), F.col("n_equal") == F.col("n_aligned")).otherwise(F.col("n_aligned") >= SPAN) & (F.col("n_equal") >= F.ceil(F.col("n_aligned") * (least / window))))
    return good.groupBy("doc_id", "item_id").agg(F.max("n_equal").cast("long").alias("n_equal"), F.max("n_aligned").cast("long").alias("n_aligned"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item."""
    return without(docs, "doc_id", cut(leaks(docs, benchmark).select("doc_id").distinct()))
