"""License scans by diagonal voting.

Rolling word k-gram hashes of all texts are joined with the template positions (a fixed table, so its broadcast is bounded).
Hits vote for (document, template, text position - template position); neighbouring diagonals merge, and each place of a template
has one vote in a run of them. Runs of MIN_VOTES are verified in the text: the share of the template's words that stand on one of
the run's diagonals must reach MIN_SHARE. Only texts with such a run are read again. Phrases that name a license are found besides.

Null text: empty, no label. Texts shorter than k words: phrases only. Very long texts: whole. Ties between templates: all labels
stay. Repeated rows: each has its row; where texts share a doc_id, the labels of all hold for each. Null ids: phrases only.
Other columns are not read. Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, bounded, cut

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# The notices that public licenses ask for, and short licenses whole; label, words.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program if not see"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
]
K = 4
MIN_VOTES = 0.25
MIN_SHARE = 0.6


def scan(docs: DataFrame, k: int = K, min_votes: float = MIN_VOTES, min_share: float = MIN_SHARE, gap: int = 2) -> DataFrame:
    spark = docs.sparkSession
    norm = F.concat(F.lit(" "), F.trim(F.regexp_replace(ascii_lower(F.coalesce("text", F.lit(""))), SEPARATORS, " ")), F.lit(" "))
    d = docs.select("doc_id", norm.alias("t"))
    d = d.select("doc_id", "t", F.filter(F.split("t", " "), lambda x: x != "").alias("w"))
    none = F.array().cast("array<struct<at: bigint, label: string>>")

    def places(phrase: str, label: str):
        n = len(phrase.split())
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size("w"), F.lit(1))), lambda i: F.array_join(F.slice("w", i, n), " ") == phrase)
        return F.when(F.col("t").contains(f" {phrase} "), F.transform(starts, lambda i: F.struct((i - 1).cast("long").alias("at"), F.lit(label).alias("label")))).otherwise(none)

    base = d.select("doc_id", F.size("w").cast("long").alias("n_words"), F.concat(*[places(p, x) for p, x in PHRASES.items()]).alias("p"))
    base = base.select("doc_id", "n_words", F.size("p").cast("long").alias("n_base"), F.array_min("p.at").alias("first_word"), F.array_max("p.at").alias("last_word"), F.array_distinct("p.label").alias("b"))

    texts = [text.split() for _, text in TEMPLATES]
    rows = [(n, i, len(t) - k + 1, " ".join(t[i : i + k])) for n, t in enumerate(texts) for i in range(len(t) - k + 1)]
    marks = spark.createDataFrame(rows, "template int, place int, grams int, gram string").select("template", "place", "grams", F.xxhash64(F.split("gram", " ")).alias("h"))
    grams = d.where(F.size("w") >= k).select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w") - (k - 1)), lambda i: F.xxhash64(F.slice("w", i, k)))).alias("pos", "h"))
    votes = grams.join(F.broadcast(marks), "h").groupBy("doc_id", "template", "grams", (F.col("pos") - F.col("place")).alias("diagonal")).agg(F.collect_set("place").alias("places"))
    by = Window.partitionBy("doc_id", "template").orderBy("diagonal")
    runs = votes.withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by) > gap).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(by))
    runs = runs.groupBy("doc_id", "template", "grams", "run").agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("votes"), F.collect_set("diagonal").alias("diagonals"))
    runs = runs.where(F.col("votes") >= min_votes * F.col("grams"))
    likely = cut(runs.groupBy("doc_id").agg(F.collect_list(F.struct("template", "diagonals")).alias("runs")))

    template = F.array(*[F.array(*map(F.lit, t)) for t in texts])
    label = F.array(*[F.lit(x) for x, _ in TEMPLATES])

    def share(run):
        """Of the template's words, the share that stands in the text on one of the run's diagonals."""
        t = F.get(template, run["template"])
        stands = lambda word, i: F.coalesce(F.exists(run["diagonals"], lambda at: F.get("w", at + i) == word), F.lit(False)).cast("int")
        return F.aggregate(F.transform(t, stands), F.lit(0), lambda a, x: a + x) / F.size(t)

    checked = d.join(bounded(likely), "doc_id").select("doc_id", F.explode(F.transform("runs", lambda r: F.struct(F.get(label, r["template"]).alias("label"), share(r).alias("share")))).alias("r"))
    found = checked.where(F.col("r.share") >= min_share).groupBy("doc_id").agg(F.collect_set("r.label").alias("m"), F.max("r.share").alias("best"))
    out = base.join(found, "doc_id", "left")
    text = lambda c: F.array_join(F.array_sort(c), ",")
    empty = F.array().cast("array<string>")
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", text(F.col("b")).alias("base_labels"), text(F.array_union("b", F.coalesce("m", empty))).alias("labels"), score.alias("score"))
