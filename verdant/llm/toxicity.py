"""Toxicity by a weighted lexicon, matched with Aho-Corasick after folding.

Folding maps homoglyphs, capital ones before it lower-cases, drops accents, and maps digits inside words to Latin letters. The
lexicon is a fixed list of insults and what labelled rows teach: words, and strings of PART letters inside words, that stand in at
least LEAST toxic rows and in few others (share PURE). Words with letters beyond ASCII are learned in their own spelling, too, as an
accent alone may tell an insult from a plain word. Matches of words between boundaries and of parts anywhere add their weight, a log
odds, once for each term, unless an exception phrase covers them. A logistic model turns hits, normalised by length, into a score.
Terms, weights and model come from at most about MAX_LABELLED labelled rows, drawn by a hash of doc_id; every term that passes counts.

Null or empty text: the score of a text without hits. Rows without labels are scored, too. Repeated rows: each is scored. Very
long texts: whole. Ties between terms: all count. Other columns are not read. No labelled rows of both classes: a fixed model.
Empty table: no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop

# Insults in four languages.
LEXICON = """idiot idiots idiotic moron morons moronic stupid stupidity clown clowns worthless pathetic disgusting trash scum loser losers
dumb imbecile jerk bastard bitch asshole fool filthy vermin garbage retard retarded creep freak cretin dimwit scumbag
arschloch dummkopf trottel abschaum widerlich idiota imbecil estupido basura asqueroso connard imbecile ordure degoutant abruti""".split()
EXCEPTIONS = "trash can|trash bin|trash collection|trash bag|garbage collection|garbage collector|garbage can|class clown|clown fish|fool proof".split("|")
# Letters of other scripts and signs that look like Latin letters.
HOMOGLYPHS = dict(zip("аеорсухкіјѕԁԛԝһոвнмтΑΒΕΖΗΙΚΜΝΟΡΤΥΧαορυνικ", "aeopcyxkijsdqwhnbhmtabezhikmnoptyxaopuvik"))
DIGITS = dict(zip("013457@$", "oieastas"))
MAX_LABELLED = 30_000
PART, LEAST, PURE = 6, 3, 0.75

_ONE, _DIGIT = ({ord(a): b for a, b in m.items()} for m in (HOMOGLYPHS, DIGITS))
WORDS = re.compile(r"\S+")
TERM = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Letters as Latin ones; digits and signs become letters only where they touch a letter of the same word."""
    t = text
    if not t.isascii():  # capitals look like other letters than their small forms, so they are mapped before and after
        t = "".join(c for c in unicodedata.normalize("NFKD", t.translate(_ONE)) if not unicodedata.combining(c)).translate(_ONE)
    t = t.lower()
    if not t.isascii():
        t = t.translate(_ONE)
    if any(c in t for c in DIGITS):
        t = WORDS.sub(lambda m: _letters(m[0]), t)
    return t


def _letters(w: str) -> str:
    if any(c in w for c in DIGITS) and sum(c.isalpha() for c in w) * 3 >= sum(c.isalnum() or c in "@$" for c in w):
        return w.translate(_DIGIT)
    return w


def spelled(text: str) -> str:
    """Small letters with their accents."""
    return unicodedata.normalize("NFC", text.lower())


class Lexicon(NamedTuple):
    folded: ahocorasick.Automaton
    spelled: ahocorasick.Automaton


def lexicon(weights: dict[str, float]) -> Lexicon:
    """Terms that begin with * match anywhere in the folded text, those with = between boundaries of the text as spelled, the others between
    boundaries of the folded one."""
    held: tuple[dict[str, list], dict[str, list]] = {}, {}
    for k, w in weights.items():
        held[k[0] == "="].setdefault(k.lstrip("*="), []).append((w, k, False))
    for k in EXCEPTIONS:
        held[0].setdefault(k, []).append((0.0, k, True))
    out = Lexicon(ahocorasick.Automaton(), ahocorasick.Automaton())
    for a, terms_ in zip(out, held):
        for k, found in terms_.items():
            a.add_word(k, (len(k), found))
        if terms_:
            a.make_automaton()
    return out


def matches(t: str, a: ahocorasick.Automaton) -> Iterator[tuple[int, int, float, str, bool]]:
    for end, (n, kinds) in a.iter(t):
        start = end - n + 1
        whole = not ((start and t[start - 1].isalnum()) or (end + 1 < len(t) and t[end + 1].isalnum()))
        for w, k, exception in kinds:
            if whole or k[0] == "*":
                yield start, end + 1, w, k, exception


def hits(text: str | None, a: Lexicon) -> tuple[float, int, int]:
    """Weight of the terms that hit, their number, and the number of words."""
    if not text:
        return 0.0, 0, 0
    t = fold(text)
    found = list(matches(t, a.folded))
    excused = [f[:2] for f in found if f[4]]
    terms_ = {f[3]: f[2] for f in found if not f[4] and not any(s <= f[0] and f[1] <= e for s, e in excused)}
    if len(a.spelled) and not text.isascii():
        terms_ |= {f[3]: f[2] for f in matches(spelled(text), a.spelled)}
    return sum(terms_.values()), len(terms_), len(t.split())


def terms(text: str) -> set[str]:
    """Words of the folded text, the strings inside longer ones, marked by *, and words beyond ASCII as spelled, marked by =."""
    out = {w for w in TERM.findall(fold(text)) if len(w) > 2}
    own = () if text.isascii() else ("=" + w for w in TERM.findall(spelled(text)) if len(w) > 2 and not w.isascii())
    return out | {"*" + w[i : i + PART] for w in out for i in range(len(w) - PART + 1)} | set(own)


def features(weight: np.ndarray, n: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(n)), n > 0, np.log1p(weight), 10 * weight / np.sqrt(words + 25.0)])


def learned(sample: DataFrame) -> dict[str, float]:
    """Terms of the toxic rows of (text, toxic), with their log odds."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_, toxic = Counter(), Counter()
        for b in batches:
            for t, y in zip(b["text"], b["toxic"]):
                found = terms(t) if t else ()
                all_.update(found)
                if y:
                    toxic.update(found)
        yield pd.DataFrame({"term": pd.Series(list(all_), dtype=object), "n": list(all_.values()), "t": [toxic[k] for k in all_]})

    seen = sample.select("text", "toxic").mapInPandas(count, "term string, n bigint, t bigint").groupBy("term").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    rows = seen.where((F.col("t") >= LEAST) & (F.col("t") >= PURE * F.col("n"))).collect()  # terms of the bounded sample
    return {r["term"]: float(np.log((r["t"] + 0.5) / (r["n"] - r["t"] + 0.5))) for r in rows}


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> tuple[dict[str, float], np.ndarray]:
    """Terms and model from (doc_id, text) and (doc_id, toxic); without rows of both classes, the fixed list at weight 1 and a fixed model."""
    plain = {k: 1.0 for k in LEXICON}
    labels = labels.where(F.col("toxic").isNotNull())
    share = min(1.0, max_rows / max(labels.count(), 1))
    drawn = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")  # about max_rows ids at most
    sample = cut(sample.select("text", "toxic"))
    weights = {**plain, **learned(sample)}

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = lexicon(weights)
        for b in batches:
            yield pd.DataFrame([(int(y), *hits(t, a)) for t, y in zip(b["text"], b["toxic"])], columns=["toxic", "weight", "n", "words"])

    got = sample.mapInPandas(scan, "toxic int, weight double, n bigint, words bigint").toPandas()  # of the bounded sample, four numbers each
    drop(sample)
    y = got["toxic"].to_numpy(float)
    default = np.array([-3.0, 3.0, 1.0, 0.5])
    if not len(got) or y.min() == y.max():
        return plain, default
    x = features(got["weight"].to_numpy(float), got["n"].to_numpy(), got["words"].to_numpy(float))

    def loss(beta: np.ndarray) -> float:
        z = x @ beta
        return np.logaddexp(0, z).sum() - y @ z + ((beta - default) ** 2).sum() / 2

    beta = default.copy()
    for _ in range(30):  # Newton steps with a ridge towards the fixed model, halved until they help
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + np.eye(4)
        step, size = np.linalg.solve(h, x.T @ (y - p) - (beta - default)), 1.0
        while loss(beta + size * step) > loss(beta) and size > 1e-6:
            size /= 2
        beta = beta + size * step
    return weights, beta


def rate(texts: Iterable[str | None], a: Lexicon, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score and number of terms of each text."""
    got = np.array([hits(t, a) for t in texts], float).reshape(-1, 3)
    return 1 / (1 + np.exp(-np.clip(features(got[:, 0], got[:, 1], got[:, 2]) @ beta, -30, 30))), got[:, 1].astype("int64")


def score(docs: DataFrame, weights: dict[str, float], beta: np.ndarray) -> DataFrame:
    """doc_id, score and n_hits of each document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = lexicon(weights)
        for b in batches:
            s, n = rate(b["text"], a, beta)
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": s, "n_hits": n})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id bigint, score double, n_hits bigint")


def clean(docs: DataFrame, weights: dict[str, float], beta: np.ndarray, level: float = 0.7) -> DataFrame:
    """The rows of docs, with all their columns, whose score is under level; no shuffle."""
    held: list = []

    @F.pandas_udf("boolean")
    def toxic(texts: pd.Series) -> pd.Series:
        if not held:
            held.append(lexicon(weights))
        return pd.Series(rate(texts, held[0], beta)[0] >= level)

    return docs.where(~toxic("text"))
