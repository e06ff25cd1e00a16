"""Quality rules with host verdicts, in DataFrame functions only.

Each document is measured on its own and held against four rules: the base rule (few words, or repeated windows), long or short
words, many symbols, many repeated lines. Failures of each rule are counted by host, each host's failure rate is shrunk towards a
beta prior fitted to all hosts by moments, and documents of hosts with a rate above max_rate go. A document of a good host goes
only by the base rule. Counting is partial before the shuffle; the verdicts reach the documents by a join whose key is salted, so
a host with a third of all rows is spread.

Null text: no words, so it fails the base rule only. Null host: the hosts named null are one host. A rate equal to max_rate stays.
Repeated rows: each counts and is returned. Very long texts: whole. Empty table: no rows. Clashing columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, words

SYMBOLS = "#*$%&|<>"
SALTS = 64
LEAST_PRIOR = 10.0  # documents that the prior weighs at least: a host of few documents is not judged by them alone


def measure(docs: DataFrame, host: str = "source", window: int = 8) -> DataFrame:
    """doc_id, host and the base measures of each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", F.col(host).alias("host"), text.alias("text"), words(F.col("text")).alias("w"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.regexp_replace(x, SPACE, "") != "")
    d = d.select(
        "doc_id", "host", "w", F.size("w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"), lines.alias("lines"))
    d = d.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).withColumn("n_lines", F.size("lines").cast("long")).drop("lines")
    starts = F.when(F.size("w") >= window, F.sequence(F.lit(1), F.size("w") - (window - 1))).otherwise(F.array().cast("array<int>"))
    d = d.withColumn("h", F.sort_array(F.transform(starts, lambda i: F.struct(F.xxhash64(F.slice("w", i, window)).alias("h"), i.alias("i")))))
    same = lambda x, j: F.get("h", j)["h"] == x["h"]
    again = F.transform(F.filter("h", lambda x, j: F.coalesce((j > 0) & same(x, j - 1), F.lit(False)) | F.coalesce(same(x, j + 1), F.lit(False))), lambda x: x["i"])
    d = d.withColumn("again", F.sort_array(again)).drop("h", "w")
    # words under a union of windows: each adds what lies past the one before
    covered = F.aggregate("again", F.struct(F.lit(0).alias("n"), F.lit(-window).alias("at")), lambda a, i: F.struct((a["n"] + F.least(F.lit(window), i - a["at"])).alias("n"), i.alias("at")), lambda a: a["n"])
    return d.withColumn("n_repeat_words", covered.cast("long")).drop("again")


#: Each rule's failures as SQL over the measures.
RULES = {
    "base": "base_failed",
    "letters": "word_chars < 2 * n_words OR word_chars > 12 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "10 * n_dup_lines > 3 * n_lines",
}


def verdicts(measured: DataFrame, max_rate: float = 0.5) -> DataFrame:
    """host, its documents, the shrunk rate of each rule, the highest of them (host_rate) and host_kept."""
    hosts = measured.groupBy("host").agg(F.count("*").alias("host_docs"), *[F.count_if(F.expr(x)).alias(f"{r}_failed") for r, x in RULES.items()])
    raw = {r: F.col(f"{r}_failed") / F.col("host_docs") for r in RULES}
    fitted = hosts.agg(*[f(x).alias(f"{n}_{r}") for r, x in raw.items() for n, f in (("mean", F.avg), ("var", F.var_pop))]).first()  # one row
    rates = []
    for r in RULES:
        m, v = min(max(fitted[f"mean_{r}"] or 0.0, 1e-6), 1 - 1e-6), fitted[f"var_{r}"]
        size = min(max(m * (1 - m) / v - 1, LEAST_PRIOR), 1e6) if v else 1e6
        rates.append(((F.col(f"{r}_failed") + m * size) / (F.col("host_docs") + size)).alias(f"{r}_rate"))
    hosts = hosts.select("host", "host_docs", *rates).withColumn("host_rate", F.greatest(*[f"{r}_rate" for r in RULES]))
    return hosts.withColumn("host_kept", F.col("host_rate") <= max_rate)


def apply(docs: DataFrame, host: str = "source", max_rate: float = 0.5) -> DataFrame:
    d = measure(docs, host).withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    d = cut(d)  # read for the counts and again for the join
    hosts = verdicts(d, max_rate).select(F.col("host").alias("h"), "host_rate", "host_kept", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    d = d.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    d = d.join(hosts, F.col("host").eqNullSafe(F.col("h")) & (F.col("salt") == F.col("s")), "left")
    kept = ~F.col("base_failed") & F.coalesce("host_kept", F.lit(True))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "host_rate")
