"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

Each piece of the text keeps the ranks of its adjacent pairs in a tree of minima. The root names the lowest rank and,
among equals, the leftmost pair; a merge changes three leaves, each a logarithmic update. Merging ends when the root
holds no mergeable pair. Distinct words are encoded once for each worker (encoded(): each task) and kept in two generations of
bounded size, which forget those that were not met for long. Words and their pieces share one dictionary of ids; the decoded text follows from the ids.

Null text: as empty; no tokens. Empty table: no rows. Repeated rows: each is encoded. Very long texts and pieces: whole. Ties
between pairs: the leftmost. digests() ignores other columns; encoded() keeps them, but for those named as its own four.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE = 1 << 60
#: White space as the tokenizer file's patterns see it (Unicode White_Space).
WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WS}\p{{L}}\p{{N}}]+")
EXOTIC = regex.compile(r"[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class Kept(dict):
    """A dictionary of bounded size in two generations: a full one becomes the old one, and what is asked for again comes back from it."""

    def __init__(self, keep: int):
        super().__init__()
        self.keep, self.old = keep, {}

    def put(self, key, value) -> None:
        if len(self) >= self.keep:
            self.old = self.copy()
            self.clear()
        self[key] = value

    def again(self, key):
        """A value of the old generation, kept from now on; else None."""
        value = self.old.get(key)
        if value is not None:
            self.put(key, value)
        return value

    def forget(self) -> None:
        self.clear()
        self.old = {}


class Words(Kept):
    """Words and pieces of words to their packed ids, each found when first asked for."""

    def __init__(self, tokenizer: Tokenizer, keep: int):
        super().__init__(keep)
        self.tokenizer = tokenizer

    def __missing__(self, word: bytes):
        value = self.again(word)
        return self.tokenizer.learn(word) if value is None else value


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Tokenizer:
    def __init__(self, file: str, keep: int = 600_000):
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {self.vocab[a] << 32 | self.vocab[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.merged = [self.vocab[a + b] for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.names = {i: t for t, i in (self.vocab | self.special).items()}
        self.inner, self.last = ([self.vocab.get(x + end) for x in byte_letters()] for end in ("", self.suffix))
        # one dictionary for all: a piece alone is cut into itself, so it has the ids of the word of its letters, and ids tell the tokens
        self.ids = self.pieces = self.texts = Words(self, keep)
        self.tokens = [self.names.get(i) for i in range(max(self.names) + 1)]

    def merge(self, ids: list[int]) -> list[int]:
        """A tree of minima over the pairs' (rank, place) as one number: the root is the leftmost pair of the lowest rank."""
        n, size = len(ids), 1
        while size < n:
            size *= 2
        bits = n.bit_length()
        mask, get, t = (1 << bits) - 1, self.ranks.get, [NONE] * (2 * size)
        for i in range(n - 1):
            rank = get(ids[i] << 32 | ids[i + 1])
            if rank is not None:
                t[size + i] = rank << bits | i
        for i in range(size - 1, 0, -1):
            a, b = t[2 * i], t[2 * i + 1]
            t[i] = a if a < b else b
        after, before, merged = list(range(1, n + 1)), list(range(-1, n - 1)), self.merged
        while (low := t[1]) != NONE:
            i = low & mask
            j = after[i]
            k = after[j]
            ids[i], ids[j], after[i] = merged[low >> bits], -1, k
            new, h = NONE, before[i]
            if k < n:
                before[k] = i
                if (rank := get(ids[i] << 32 | ids[k])) is not None:
                    new = rank << bits | i
            changed = [(i, new)]
            if t[size + j] != NONE:
                changed.append((j, NONE))
            if h >= 0:
                rank = get(ids[h] << 32 | ids[i])
                changed.append((h, NONE if rank is None else rank << bits | h))
            for at, key in changed:  # a logarithmic update each, which ends where nothing changes
                at += size
                while t[at] != key:
                    t[at] = key
                    if at == 1:
                        break
                    b = t[at ^ 1]
                    key = key if key < b else b
                    at >>= 1
        return [x for x in ids if x >= 0]

    def piece(self, piece: bytes) -> bytes:
        """Packed ids of a piece, without a look at the dictionary."""
        ids = [self.inner[b] for b in piece[:-1]] + [self.last[piece[-1]]]
        if None in ids:
            ids = [i for i in ids if i is not None]
        return array("I", self.merge(ids) if len(ids) > 1 else ids).tobytes()

    def learn(self, word: bytes) -> bytes:
        """Packed ids of a word; the dictionary keeps them and those of its pieces, as far as its bound goes."""
        if word[:1] == b"\xff":
            return array("I", [self.special[word[1:].decode()]]).tobytes()
        found = PIECES.findall(word.decode("utf-8"))
        out = self.piece(word) if len(found) == 1 else b"".join([self.ids[p.encode("utf-8")] for p in found])
        if len(word) <= 64:
            self.ids.put(word, out)
        return out

    def words(self, text: str) -> list[bytes]:
        """Words between white space, lower-cased; special tokens stand alone, each after a byte that no word begins with."""
        if text.isascii() and not (self.split and "<" in text and self.split.search(text)):
            return text.lower().encode().split()  # bytes split at the ASCII white space, and at no other control character
        out: list[bytes] = []
        for part in self.split.split(text) if self.split else [text]:
            if part in self.special:
                out.append(b"\xff" + part.encode())
                continue
            part = EXOTIC.sub(" ", unicodedata.normalize("NFC", part))
            # letter by letter: no rule for a sigma at a word's end
            out += ("".join(map(str.lower, part)) if "Σ" in part else part.lower()).encode().split()
        return out

    def packed(self, text: str) -> list[bytes]:
        """Packed ids of each word, and of each special token."""
        return list(map(self.ids.__getitem__, self.words(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(self.packed(text)), "<u4").tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """The file names no decoder: tokens are joined by a space."""
        return " ".join([self.names[i] for i in ids if i in self.names])

    def digest(self, text: str | None) -> tuple[bytes, int, str, str]:
        """Packed ids, their number, and hashes of the ids and of the text that they decode to."""
        ids = b"".join(self.packed(text)) if text else b""
        texts = " ".join(map(self.tokens.__getitem__, array("I", ids)))
        return ids, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(texts.encode()).hexdigest()


@lru_cache(maxsize=2)
def load(file: str, keep: int = 600_000) -> Tokenizer:
    return Tokenizer(file, keep)


def encode(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, ids (array of long) and the decoded text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = load(file)
        for b in batches:
            ids = [tok.encode(t) if t else [] for t in b[text_col]]
            yield pd.DataFrame({id_col: b[id_col], "ids": ids, "decoded": [tok.decode(x) for x in ids]})

    return docs.select(id_col, text_col).mapInPandas(run, f"{id_col} bigint, ids array<bigint>, decoded string")


def digests(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode(), with hashes in place of the ids and the text, which then never leave the task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = load(file)
        for b in batches:
            rows = [(i, *tok.digest(t)[1:]) for i, t in zip(b[id_col], b[text_col])]
            yield pd.DataFrame(rows, columns=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id_col, text_col).mapInPandas(run, f"{id_col} bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, file: str, text_col: str = "text") -> DataFrame:
    """docs with all its columns, and n_tokens, ids (packed, little-endian unsigned 32-bit) and the two hashes.

    A stage among others: the words, fewer of them than digests() keeps, go at the end of each task, as the workers go on to other stages.
    """

    names = ["ids", "n_tokens", "ids_sha256", "decoded_sha256"]

    @F.pandas_udf("ids binary, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tok = load(file, 200_000)
        try:
            for texts in batches:
                yield pd.DataFrame([*map(tok.digest, texts)], columns=names)
        finally:
            tok.ids.forget()

    return docs.withColumn("_verdant_ids", run(text_col)).select(*[F.col(f"`{c}`") for c in docs.columns if c not in names], "_verdant_ids.*")
