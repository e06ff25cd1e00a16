"""Language ID by interpolated Kneser-Ney character models, one for each language.

Words are scored as strings of letters between boundaries, so that each place has a full context. Training counts the 4-grams of
each language in Spark; the lower orders' continuation counts follow from the distinct ones. All n-grams of all languages stand in
one sorted array of 64-bit hashes for each order, with a column of log probabilities for each language; missing n-grams back off by
interpolation weight.
The language of the lowest cross-entropy for each character wins; ties go to the first in alphabetical order. The score is a
softmax of the margins to it times a slope and the logarithm of the length. Slope and rejection levels are fitted on training
rows held back from the counts: the score below which LOST of the rightly named rows fall, and for each language the
cross-entropy, as its mean plus a width that shrinks with the root of the length, above which LOST of them lie. A row under the
first or over the second is marked rejected. With less than LEAST_ROWS rows held back, fixed values stand and no cross-entropy is rejected.

Training counts words of about MAX_DOCS documents for each language, drawn by a hash of doc_id; only 4-grams, bounded by the
alphabet, reach the driver. Text that is null or has no letter (Unicode L): `und`, score 0. No training rows: `und` for all.
Repeated rows: each is predicted, and counts in training. Very long texts: whole. Other columns are not read. Empty table: no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER = 4
MAX_DOCS = 3000
HELD = 8  # one of so many sampled training rows is held back
LOST = 0.01
LEAST_ROWS = 20
LETTERS, PLAIN = regex.compile(r"\p{L}+"), re.compile("[a-z]+")
START = "\1" * (ORDER - 1)


def words(text: str | None) -> list[str]:
    t = (text or "").lower()
    return (PLAIN if t.isascii() else LETTERS).findall(t)


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, each after START and before a boundary, and the word that each belongs to."""
    text = "".join(START + w + "\1" for w in words)
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64), np.repeat(np.arange(len(words)), [len(w) + ORDER for w in words])


def hashes(c: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n-gram that ends at each place; the first n - 1 hold rubbish."""
    h = np.full(len(c), np.uint64(1469598103934665603 + n))
    for k in range(n - 1, -1, -1):
        h = (h ^ np.concatenate([np.zeros(k, np.uint64), c[: len(c) - k]])) * np.uint64(1099511628211)
        h ^= h >> np.uint64(29)
    return h


class Models:
    """counts: for each language the 4-grams with how often they occur."""

    def __init__(self, langs: list[str], counts: dict[str, dict[str, int]]):
        self.langs, self.tables = langs, []
        self.slope, self.reject = 8.0, 0.5
        self.usual, self.width = np.zeros(len(langs)), np.full(len(langs), np.inf)
        grams = {k: sorted(counts[k]) for k in langs}
        letters = {k: np.frombuffer("".join(g).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, ORDER).astype(np.uint64) for k, g in grams.items()}
        for n in range(1, ORDER + 1):
            parts = []
            for k in langs:
                x = letters[k][:, ORDER - n :]
                if n < ORDER:  # continuation counts: distinct letters before the n-gram
                    x = np.unique(letters[k][:, ORDER - n - 1 :], axis=0)[:, 1:]
                of = lambda m, width: hashes(m.ravel(), width)[width - 1 :: width] if width else np.zeros(len(m), np.uint64)
                full, context = of(np.ascontiguousarray(x), n), of(np.ascontiguousarray(x[:, :-1]), n - 1)
                keys, at, inv = np.unique(full, return_index=True, return_inverse=True)
                weight = np.array([counts[k][g] for g in grams[k]], float) if n == ORDER else None
                parts.append((keys, np.bincount(inv, weight).astype(float), context[at]))
            keys, contexts = (np.unique(np.concatenate([p[i] for p in parts])) for i in (0, 2))
            prob, gamma = np.zeros((len(keys), len(langs))), np.ones((len(contexts), len(langs)))
            for k, (kk, cnt, ctx) in enumerate(parts):
                n1, n2 = max((cnt == 1).sum(), 1), max((cnt == 2).sum(), 1)
                d = min(n1 / (n1 + 2 * n2), 0.95)
                ci = np.searchsorted(contexts, ctx)
                total, kinds = np.bincount(ci, cnt, len(contexts)), np.bincount(ci, minlength=len(contexts))
                seen = total > 0
                gamma[seen, k] = d * kinds[seen] / total[seen]
                prob[np.searchsorted(keys, kk), k] = (cnt - d) / total[ci]
            if n == 1:  # the rest goes evenly over an alphabet of 1,000 letters
                self.floor = gamma[0] / 1000 + 1e-9
            self.tables.append((keys, prob, contexts, gamma))

    def nats(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy sums (word x language) and characters of each word."""
        c, of = codes(words)
        size = np.array([len(w) + ORDER for w in words])
        use = np.ones(len(c), bool)
        use[((np.cumsum(size) - size)[:, None] + np.arange(ORDER - 1)).ravel()] = False
        of, p = of[use], np.zeros((int(use.sum()), len(self.langs))) + self.floor
        for n, (keys, prob, contexts, gamma) in enumerate(self.tables, 1):
            h = hashes(c, n)[use]
            i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = np.where((keys[i] == h)[:, None], prob[i], 0)
            if n == 1:
                p = p + hit
                continue
            x = np.r_[np.uint64(0), hashes(c, n - 1)[:-1]][use]
            j = np.minimum(np.searchsorted(contexts, x), len(contexts) - 1)
            p = np.where((contexts[j] == x)[:, None], hit + gamma[j] * p, p)
        p = -np.log(p)
        return np.column_stack([np.bincount(of, p[:, k], len(words)) for k in range(len(self.langs))]), size - ORDER + 1


class Scorer:
    """Characters and cross-entropy for each character by every language, of each text; None without letters."""

    def __init__(self, models: Models, keep: int = 500_000):
        self.m, self.keep = models, keep
        self.known: dict[str, int] = {}
        self.table, self.sizes = np.zeros((0, len(models.langs))), np.zeros(0, int)

    def __call__(self, texts: Iterable[str | None]) -> Iterator[tuple[int, np.ndarray] | None]:
        split = [words(t) for t in texts]
        if len(self.known) > self.keep:
            self.known, self.table, self.sizes = {}, self.table[:0], self.sizes[:0]
        new = list({w for ws in split for w in ws if w not in self.known})
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            nats, chars = self.m.nats(new)
            self.table, self.sizes = np.concatenate([self.table, nats]), np.concatenate([self.sizes, chars])
        for ws in split:
            if not ws:
                yield None
                continue
            at = np.fromiter(map(self.known.__getitem__, ws), np.int64, len(ws))
            chars = self.sizes[at].sum()
            yield chars, self.table[at].sum(0) / chars


def softmax(chars: np.ndarray, each: np.ndarray, slope: float) -> np.ndarray:
    """Score of the best language of each row."""
    gap = (each - each.min(1, keepdims=True)) * slope * np.log1p(chars)[:, None]
    return 1 / np.exp(-np.clip(gap, 0, 50)).sum(1)


def calibrate(m: Models, lang: np.ndarray, chars: np.ndarray, each: np.ndarray) -> None:
    """Set slope, rejection level and the usual cross-entropies of m from rows held back (lang as place in m.langs)."""
    if len(lang) < LEAST_ROWS:
        return
    z = (each - each.min(1, keepdims=True)) * np.log1p(chars)[:, None]
    slopes = np.geomspace(0.1, 100, 200)
    loss = [(k * z[np.arange(len(lang)), lang] + np.log(np.exp(-k * z).sum(1))).sum() + np.log(k / m.slope) ** 2 for k in slopes]  # drawn a little to the fixed one
    m.slope = float(slopes[int(np.argmin(loss))])
    right = each.argmin(1) == lang
    if right.sum() < LEAST_ROWS:
        return
    m.reject = float(np.quantile(softmax(chars, each, m.slope)[right], LOST))
    for k in range(len(m.langs)):
        own = right & (lang == k)
        if own.sum() >= LEAST_ROWS:
            m.usual[k] = np.average(each[own, k], weights=chars[own])
            m.width[k] = max(np.quantile((each[own, k] - m.usual[k]) * np.sqrt(chars[own]), 1 - LOST), 0)


def held_back(docs: DataFrame, models: Models) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """lang, chars and cross-entropies of a bounded number of rows."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        place = {k: i for i, k in enumerate(shared.value.langs)}
        for b in batches:
            got = [(place[k], int(x[0]), x[1].tolist()) for k, x in zip(b["lang"], scorer(b["text"])) if x and k in place]
            yield pd.DataFrame(got, columns=["lang", "chars", "each"])

    got = docs.select("lang", "text").mapInPandas(run, "lang int, chars bigint, each array<double>").collect()
    shared.unpersist()
    return np.array([r["lang"] for r in got], int), np.array([r["chars"] for r in got], float), np.array([r["each"] for r in got], float).reshape(-1, len(models.langs))


def learn(docs: DataFrame, max_docs: int = MAX_DOCS) -> Models | None:
    """Models from (doc_id, text, lang) of training rows; None without any."""
    docs = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    keep = F.lit(False)
    for lang, n in sizes.items():
        keep = keep | ((F.col("lang") == lang) & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, max_docs / n) * (1 << 30))))
    held = F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(HELD)) == 0

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, Counter] = {}
        for b in batches:
            for lang, t in zip(b["lang"], b["text"]):
                seen.setdefault(lang, Counter()).update(words(t))
        for lang, found in seen.items():
            n = Counter()
            for w, k in found.items():
                w = START + w + "\1"
                for i in range(len(w) - ORDER + 1):
                    n[w[i : i + ORDER]] += k
            yield pd.DataFrame({"lang": lang, "gram": pd.Series(list(n), dtype=object), "n": list(n.values())})

    rows = docs.where(keep & ~held).select("lang", "text").mapInPandas(grams, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    counts: dict[str, dict[str, int]] = {k: {} for k in sorted(sizes)}
    for lang, part in rows.groupby("lang"):
        counts[lang] = dict(zip(part["gram"], part["n"]))
    counts = {k: v for k, v in counts.items() if v}
    if not counts:
        return None
    models = Models(sorted(counts), counts)
    calibrate(models, *held_back(docs.where(keep & held), models))
    return models


def predict(docs: DataFrame, models: Models | None) -> DataFrame:
    """doc_id, lang_pred, score and rejected of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        scorer = Scorer(m) if m else lambda texts: [None] * len(texts)
        for b in batches:
            rows = []
            for i, got in zip(b["doc_id"], scorer(b["text"])):
                if not got:
                    rows.append((i, "und", 0.0, True))
                    continue
                chars, each = got
                best = int(each.argmin())
                score = float(softmax(np.array([chars]), each[None], m.slope)[0])
                strange = each[best] > m.usual[best] + m.width[best] / np.sqrt(chars)
                rows.append((i, m.langs[best], score, bool(score < m.reject or strange)))
            yield pd.DataFrame(rows, columns=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id bigint, lang_pred string, score double, rejected boolean")
