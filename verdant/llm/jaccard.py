"""N-gram Jaccard join with adaptive multi-match prefixes, and the components of its links.

Shingle hashes have one global order: by the level of their bucket in a histogram over all documents, so that frequent ones come
last, then by value. In a pair that links, the smaller set of n shingles shares at least 2S/(1+S) n of them and the larger one at
least S n (S the similarity). So of l shared tokens each document must hold l among its first n - need + l: l is 1 where the
prefix is cheap, and grows with the estimated cost of its candidates (levels along the prefix). A pair must share min(l, l')
tokens of the lengthened prefixes, and its places in the order must leave room for enough common shingles, before it is verified.
Equal sets form a class before that; only a class's first document goes on.

Members of a token meet in numpy: tasks pack the prefixes for each bucket of tokens, and one row for each set of tokens with the
same members comes back, with how many they are. Tokens that many documents may hold are salted by document, so no task gets all
members of one. Links are sought in rounds. In the first, each document is verified against the first member of the groups that
it shares most tokens with; in later ones, members outside the largest component of a group ask one member each of another
component. When rounds join less than a tenth of those that ask, the pairs left between different components are counted
(tokens shared, over all groups) and all that share enough are verified, but for those whose sketches, shingles counted by classes of
their hashes, show that they have too few in common; salted members outside the largest component visit the
other salts for that. So groups of copies make few rows, and every link is verified or lies inside one component.

Null doc_id: the row takes part under a number above all ids, which must fit a long; so it is linked as any other, and stays only
where no row of its component has an id and it is the first. In link() such a number shows as null: the doc_id of the row, and
class_id or component_id where no row of the class or component has an id.
Null or wordless text: empty set, its own component. Fewer words than a shingle: the whole sequence is the one shingle.
Repeated rows share a class; keep_first keeps one of them. Very long texts: whole. Empty table: no rows. Ties (documents alike in
size): the smaller doc_id goes first. Extra columns are left alone. Components are named by their smallest doc_id.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, cut, drop, only, utf8, without

SIZE, SHARE = 5, 80  # words of a shingle; per cent
BUCKETS = 1 << 20  # of the histogram; 3 bytes each are broadcast
HOT = 50_000  # estimated holders of a token above which its members are salted
ROWS = 500_000  # prefix rows of a bucket of tokens, about
FAN = 2000  # documents verified against one copy of another's text
PAYS = 10  # rounds go on while one in so many that ask is joined
CLASSES = 128  # of shingles in a sketch: a byte each


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingled(texts: Iterable[str | bytes | None], size: int = SIZE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    # lower() and split() of bytes know the ASCII letters and the ASCII white space only
    split = [utf8(t).lower().split() for t in texts]
    lens = np.array([len(w) for w in split], np.int64)
    total = int(lens.sum())
    h = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(split)), np.uint64, total)
    ends = np.cumsum(lens)
    long = np.full(total, np.uint64(size))
    for j in range(size):
        k = max(total - j, 0)
        long[:k] = mix(long[:k] + h[j:] * np.uint64(2 * j + 3))
    out = []
    for n, end in zip(lens.tolist(), ends.tolist()):
        if 0 < n < size:
            one = np.full(1, np.uint64(n))
            for j in range(n):
                one = mix(one + h[end - n + j : end - n + j + 1] * np.uint64(2 * j + 3))
            out.append(one)
        else:
            out.append(np.unique(long[end - n : end - size + 1]) if n else long[:0])
    return out


def least(n, share: int):
    """Shingles that a set of n shares at least with a larger one that it links to."""
    return -(-2 * share * n // (100 + share))


def common_least(n, m, share: int):
    return -(-share * (n + m) // (100 + share))


def sketch(s: np.ndarray) -> bytes:
    """How many shingles of a set lie in each class of their hashes; 255 throughout if one has that many."""
    c = np.bincount((s >> np.uint64(32)).astype(np.int64) % CLASSES, minlength=CLASSES)
    return (c if c.max(initial=0) < 255 else np.full(CLASSES, 255)).astype(np.uint8).tobytes()


def may_share(x: np.ndarray, ys: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Whether a set can have that many shingles in common with each of others: in no class more than the smaller count."""
    return (np.minimum(x, ys).sum(1, dtype=np.int64) >= need) | (x[0] == 255) | (ys[:, 0] == 255)


def _sets(docs: DataFrame) -> DataFrame:
    """doc_id, n, fingerprint and sketch; and, with a null doc_id, the histogram of each task in 64 pieces."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hist = np.zeros(BUCKETS, np.int64)
        for b in batches:
            sets = shingled(b["text"])
            if sets:
                hist += np.bincount((np.concatenate(sets) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
            yield pd.DataFrame({"doc_id": b["doc_id"], "n": [len(s) for s in sets], "fp": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "sk": [sketch(s) for s in sets]})
        z = zstandard.ZstdCompressor(1)
        yield pd.DataFrame({"doc_id": pd.array([None] * 64, "Int64"), "n": range(64), "fp": [z.compress(x.tobytes()) for x in np.split(hist.astype(np.uint32), 64)], "sk": None})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id bigint, n bigint, fp binary, sk binary")


def _histogram(sets: DataFrame) -> np.ndarray:
    def add(b: pd.DataFrame) -> pd.DataFrame:
        z = zstandard.ZstdDecompressor()
        return pd.DataFrame({"n": [b["n"].iloc[0]], "fp": [np.sum([np.frombuffer(z.decompress(x), np.uint32) for x in b["fp"]], 0, np.int64).tobytes()]})

    rows = sets.where("doc_id IS NULL").select("n", "fp").groupBy("n").applyInPandas(add, "n bigint, fp binary").orderBy("n").collect()  # 64 rows of fixed size
    return np.concatenate([np.frombuffer(r["fp"], np.int64) for r in rows]) if rows else np.zeros(BUCKETS, np.int64)


def levels(hist: np.ndarray) -> np.ndarray:
    """0 for buckets filled as by chance, and one more for each doubling of what lies over that."""
    mean = hist.mean()
    over = (hist - mean - 4 * np.sqrt(mean)) / 4
    return np.log2(np.maximum(over, 1)).astype(np.uint8)


def salts(hist: np.ndarray) -> np.ndarray:
    """Into how many parts the members of a token are dealt."""
    over = hist - hist.mean() - 4 * np.sqrt(hist.mean())
    return np.clip(np.ceil(over / HOT), 1, 65_535).astype(np.uint16)


def ordered(s: np.ndarray, level: np.ndarray, share: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The prefix of a sorted set in the global order, its levels, and l."""
    n = len(s)
    at = level[(s % np.uint64(BUCKETS)).astype(np.int64)]
    order = np.argsort(at, kind="stable")
    spare = n - -(-share * n // 100)
    cost = (2.0 ** at[order[: spare + 1]] - 1).sum()
    more = int(np.clip(1 + np.log2(1 + cost / 16), 1, n - spare))
    pick = order[: spare + more]
    return s[pick], at[pick], more


COLUMNS = (("t", "<u8"), ("d", "<i8"), ("n", "<u4"), ("p", "<u4"), ("l", "<u4"), ("v", "u1"), ("s", "<u2"), ("parts", "<u2"))


def prefixes(docs: DataFrame, hist: np.ndarray, parts: int, share: int = SHARE, flush: int = 400_000) -> DataFrame:
    """(bucket, x): tokens, documents, sizes, places, l, levels and salts of prefixes, packed for each bucket of tokens."""
    shared = docs.sparkSession.sparkContext.broadcast((levels(hist), salts(hist)))  # 3 bytes for each of BUCKETS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        level, salted = shared.value
        z = zstandard.ZstdCompressor(1)
        held, rows = [], 0

        def packed() -> pd.DataFrame:
            size = np.array([len(x[1]) for x in held])
            c = {"t": np.concatenate([x[1] for x in held]), "v": np.concatenate([x[2] for x in held])}
            c |= {k: np.repeat(np.array([x[i] for x in held], kind), size) for k, i, kind in (("d", 0, "<i8"), ("n", 3, "<u4"), ("l", 4, "<u4"))}
            c["p"] = (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)).astype("<u4")
            c["parts"] = salted[(c["t"] % np.uint64(BUCKETS)).astype(np.int64)]
            c["s"] = (mix(c["d"].view(np.uint64)) % c["parts"]).astype("<u2")
            to = (mix(c["t"] + c["s"]) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            names, first = np.unique(to[order], return_index=True)
            each = np.split(order, first[1:])
            return pd.DataFrame({"bucket": names, "x": [z.compress(b"".join(c[k][i].astype(kind).tobytes() for k, kind in COLUMNS)) for i in each]})

        for b in batches:
            for i, s in zip(b["doc_id"], shingled(b["text"])):
                if len(s):
                    pick, at, more = ordered(s, level, share)
                    held.append((i, pick, at, len(s), more))
                    rows += len(pick)
            if rows >= flush:
                yield packed()
                held, rows = [], 0
        if held:
            yield packed()

    return docs.select("doc_id", "text").mapInPandas(run, "bucket bigint, x binary")


def unpacked(x: Iterable[bytes]) -> dict[str, np.ndarray]:
    z, width = zstandard.ZstdDecompressor(), sum(np.dtype(k).itemsize for _, k in COLUMNS)
    parts: dict[str, list] = {k: [] for k, _ in COLUMNS}
    for raw in map(z.decompress, x):
        n, at = len(raw) // width, 0
        for k, kind in COLUMNS:
            parts[k].append(np.frombuffer(raw, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return {k: np.concatenate(v) for k, v in parts.items()}


def fits(nx, px, qx, lx, dx, ny, py, qy, ly, dy, share: int):
    """Whether x and y may link as far as sizes and places of a shared token tell, and how many prefix tokens they share then at least.

    p is the token's place, q bounds the earlier tokens that any other document shares.
    """
    small = (nx < ny) | ((nx == ny) & (dx < dy))
    n, p, l, m, k = (np.where(small, *x) for x in ((nx, ny), (px, py), (lx, ly), (ny, nx), (ly, lx)))  # noqa: E741
    need, own = common_least(n, m, share), least(n, share)
    room = np.minimum(qx, qy) + np.minimum(nx - px, ny - py)
    return (100 * n >= share * m) & (p < n - own + l) & (room >= need), np.minimum(need - own + l, need + -share * m // 100 + k)


GROUP = "h1 bigint, h2 bigint, v int, t bigint, mult bigint, s int, parts int, d array<bigint>, n array<bigint>, p array<bigint>, l array<bigint>"


def groups(packed: DataFrame, share: int = SHARE) -> DataFrame:
    """One row for each set of members of a token (of a salt of it), with the first such token and their number; sets that cannot link are left out."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        c = unpacked(b["x"])
        key = mix(c["t"] + c["s"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        hot = c["parts"] > 1  # a salted token meets its other salts later: all its rows stay
        order = order[np.r_[False, same] | np.r_[same, False] | hot[order]]
        if not len(order):
            return pd.DataFrame(columns=[x.split()[0] for x in GROUP.split(", ")])
        order = order[np.lexsort((c["d"][order], c["n"][order], key[order]))]
        key, c = key[order], {k: x[order] for k, x in c.items()}
        again = np.r_[False, (key[1:] == key[:-1]) & (c["d"][1:] == c["d"][:-1])]  # repeated rows
        key, c = key[~again], {k: x[~again] for k, x in c.items()}
        new = np.r_[True, key[1:] != key[:-1]]
        of = np.cumsum(new) - 1
        near = np.r_[False, 100 * c["n"][:-1].astype(np.int64) >= share * c["n"][1:].astype(np.int64)] & ~new
        use = (np.bincount(of, near)[of] > 0) | (c["parts"] > 1)
        key, new, c = key[use], new[use], {k: x[use] for k, x in c.items()}
        first = np.flatnonzero(new)
        if not len(first):
            return pd.DataFrame(columns=[x.split()[0] for x in GROUP.split(", ")])
        d = mix(c["d"].view(np.uint64))
        h1, h2 = np.add.reduceat(d, first), np.add.reduceat(mix(d + np.uint64(7)), first)
        hot = c["parts"][first] > 1
        h1, h2 = np.where(hot, key[first], h1), np.where(hot, c["t"][first], h2)
        at = np.lexsort((c["t"][first], c["v"][first], h2, h1))
        head = np.flatnonzero(np.r_[True, (h1[at][1:] != h1[at][:-1]) | (h2[at][1:] != h2[at][:-1])])
        mult, at = np.diff(np.r_[head, len(at)]), at[head]
        ends = np.r_[first[1:], len(key)]
        lists = {k: [x[i:j] for i, j in zip(first[at], ends[at])] for k, x in ((k, c[k].astype(np.int64)) for k in "dnpl")}
        token = (c["t"][first][at] ^ np.uint64(1 << 63)).view(np.int64)  # its order among signed numbers is that of t
        return pd.DataFrame({"h1": h1[at].view(np.int64), "h2": h2[at].view(np.int64), "v": c["v"][first][at].astype(int), "t": token, "mult": mult, "s": c["s"][first][at].astype(int), "parts": c["parts"][first][at].astype(int)} | lists)

    found = packed.groupBy("bucket").applyInPandas(run, GROUP)
    best = found.groupBy("h1", "h2").agg(F.min(F.struct("v", "t", "s", "parts", "d", "n", "p", "l")).alias("x"), F.sum("mult").alias("mult"))
    name = F.when(F.col("x.parts") > 1, F.struct(F.col("x.t").alias("g1"), F.lit(0).cast("bigint").alias("g2"))).otherwise(F.struct(F.col("h1").alias("g1"), F.col("h2").alias("g2")))
    return best.select(name.alias("g"), "mult", "x.*").drop("v", "t")


def leaders(found: DataFrame, share: int = SHARE) -> DataFrame:
    """(b, a): for each document the first member of a group with which it shares most tokens, as far as groups tell."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            size = b["d"].map(len).to_numpy()
            d, n, p, l = (np.concatenate(b[k].to_numpy()) for k in "dnpl")  # noqa: E741
            of, mult = np.repeat(np.arange(len(b)), size), b["mult"].to_numpy()
            order = np.lexsort((d, p, of))  # a member with few rarer tokens has the fewest shingles of its own
            d, n, p, l, of = (y[order] for y in (d, n, p, l, of))  # noqa: E741
            for _ in range(4):  # those that do not fit the first member ask the next one; later rounds serve the rest
                head = np.r_[True, of[1:] != of[:-1]]
                x = np.flatnonzero(head)[np.cumsum(head) - 1]
                good = fits(n[x], p[x], p[x], l[x], d[x], n, p, p, l, d, share)[0] & ~head
                yield pd.DataFrame({"b": d[good], "a": d[x[good]], "w": mult[of[good]]})
                rest = ~good & ~head
                if not rest.any():
                    break
                d, n, p, l, of = (y[rest] for y in (d, n, p, l, of))  # noqa: E741

    asked = found.select("mult", "d", "n", "p", "l").mapInPandas(run, "b bigint, a bigint, w bigint")
    asked = asked.groupBy("b", "a").agg(F.sum("w").alias("w"))
    return asked.groupBy("b").agg(F.max_by("a", F.struct("w", -F.col("a"))).alias("a"))


def spread(found: DataFrame) -> DataFrame:
    """The members of all groups, one in a row, with q: the tokens before this one that stand in groups, at most."""
    rows = found.select("g", "mult", "s", "parts", F.inline(F.arrays_zip("d", "n", "p", "l")))
    before = Window.partitionBy("d").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("q", F.least("p", F.coalesce(F.sum("mult").over(before), F.lit(0))))


def mixed(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """The rows of groups of several components, with their component c and the group's largest, top."""
    rows = rows.join(bounded(comp.select(F.col("v").alias("d"), F.col("component").alias("c"))), "d", "left").withColumn("c", F.coalesce("c", "d"))
    per = rows.groupBy("g", "c").agg(F.count("*").alias("k"))
    top = per.groupBy("g").agg(F.max_by("c", F.struct("k", "c")).alias("top"), F.count("*").alias("kinds")).where("kinds > 1").drop("kinds")
    return rows.join(top, "g")


def _cells(rows: DataFrame, cells: int) -> DataFrame:
    return rows.select("g.g1", "g.g2", "mult", "s", "d", "n", "p", "q", "l", "c", "top", "home", *(["sk"] if "sk" in rows.columns else []), F.pmod(F.xxhash64("g", "s"), F.lit(cells)).alias("cell"))


def _meetings(b: pd.DataFrame, share: int) -> Iterator[tuple]:
    """For each group of a cell and each member z outside its largest component: multiplicity, z, and of the others that z may link to, by their sketches too if rows have them, the ids, places and needed tokens."""
    b = b.sort_values(["g1", "g2", "s"], kind="stable")
    d, n, p, q, l, c, top, home, mult = (b[k].to_numpy() for k in ("d", "n", "p", "q", "l", "c", "top", "home", "mult"))  # noqa: E741
    g = b[["g1", "g2", "s"]].to_numpy()
    sk = np.frombuffer(b"".join(b["sk"]), np.uint8).reshape(-1, CLASSES) if "sk" in b else None
    first = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]).any(1)])
    for i, j in zip(first, np.r_[first[1:], len(g)]):
        own = np.flatnonzero(home[i:j]) + i
        own = own[np.argsort(n[own] - p[own])[::-1]]
        after = p[own] - n[own]
        for z in np.flatnonzero(c[i:j] != top[i]) + i:
            # what follows the token must hold S n of z, but for the q tokens before
            y = own[: np.searchsorted(after, q[z] - (share * n[z] + 99) // 100, "right")]
            ok, need = fits(n[z], p[z], q[z], l[z], d[z], n[y], p[y], q[y], l[y], d[y], share)
            ok &= (c[y] != c[z]) & ((c[y] == top[i]) | (d[y] < d[z]))  # a pair of two of them meets once
            if sk is not None:
                at = np.flatnonzero(ok)
                ok[at] = may_share(sk[z], sk[y[at]], common_least(n[z], n[y[at]], share))
            if ok.any():
                yield mult[i], d[z], d[y[ok]], p[y[ok]], need[ok]


def asking(rows: DataFrame, cells: int, turn: int, share: int = SHARE) -> DataFrame:
    """(b, a): each member outside its group's largest component with one member of another component, those with the fewest shingles of their own in turn."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for w, z, y, p, _ in _meetings(b, share):
            out.append((z, y[np.lexsort((y, p))[min(turn, len(y)) - 1]], w))
        return pd.DataFrame(out, columns=["b", "a", "w"], dtype="int64")

    asked = _cells(rows.withColumn("home", F.lit(True)), cells).groupBy("cell").applyInPandas(run, "b bigint, a bigint, w bigint")
    return asked.groupBy("b", "a").agg(F.sum("w").alias("w")).groupBy("b").agg(F.max_by("a", F.struct("w", "a")).alias("a"))


def counted(rows: DataFrame, sketches: DataFrame, cells: int, share: int = SHARE) -> DataFrame:
    """(b, a): all pairs of different components that share enough tokens, and whose sketches leave room for enough common shingles."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        out: dict[tuple, list] = {}
        for w, z, y, _, need in _meetings(b, share):
            for k, m in zip(y.tolist(), need.tolist()):
                pair = (z, k) if z < k else (k, z)
                out[pair] = [out.get(pair, (0,))[0] + w, m]
        return pd.DataFrame([(*k, *v) for k, v in out.items()], columns=["b", "a", "w", "need"], dtype="int64")

    rows = rows.withColumn("home", F.lit(True)).join(sketches.toDF("d", "sk"), "d")
    guests = rows.where("parts > 1 AND c <> top").withColumn("to", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("to <> s")
    both = rows.unionByName(guests.withColumn("s", F.col("to")).withColumn("home", F.lit(False)).drop("to"))
    pairs = _cells(both, cells).groupBy("cell").applyInPandas(run, "b bigint, a bigint, w bigint, need bigint")
    return pairs.groupBy("b", "a").agg(F.sum("w").alias("w"), F.min("need").alias("need")).where("w >= need").select("b", "a")


def verify(docs: DataFrame, pairs: DataFrame, hist: np.ndarray, share: int = SHARE) -> DataFrame:
    """The pairs (a, b) that share enough prefix tokens, and then at least the given per cent of their union.

    The text of b goes to a cell of a, and a's text once to each of its cells of FAN documents.
    """
    shared = docs.sparkSession.sparkContext.broadcast(levels(hist))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        level = shared.value
        at, lead = None, None
        for b in batches:
            good = []
            for a, cell, side, v, s in zip(b["a"], b["cell"], b["side"], b["doc_id"], shingled(b["text"])):
                if not side:
                    at, lead = (a, cell), (s, *ordered(s, level, share)[::2])
                elif at == (a, cell):
                    t, head, more = lead
                    mine, _, own = ordered(s, level, share)
                    if len(np.intersect1d(head, mine, assume_unique=True)) >= min(more, own):
                        both = len(np.intersect1d(s, t, assume_unique=True))
                        if 100 * both >= share * (len(s) + len(t) - both):
                            good.append((a, v))
            yield pd.DataFrame(good, columns=["a", "b"], dtype="int64")

    fan = pairs.groupBy("a").agg(F.ceil(F.count("*") / FAN).alias("cells"))
    pairs = pairs.join(fan, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("cells")).cast("int").alias("cell"))
    want = pairs.select("a", "cell", F.lit(1).alias("side"), F.col("b").alias("v")).unionByName(pairs.select("a", "cell", F.lit(0).alias("side"), F.col("a").alias("v")).distinct())
    want = cut(want)
    rows = docs.select("doc_id", "text").join(bounded(want), F.col("doc_id") == F.col("v")).select("a", "cell", "side", "doc_id", "text")
    found = rows.repartition("a", "cell").sortWithinPartitions("a", "cell", "side").mapInPandas(run, "a bigint, b bigint")
    return cut(found, want)


def components(edges: DataFrame) -> DataFrame:
    """(v, component) of all ends of the edges (a, b), by alternating large and small stars until nothing changes."""
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = None
    while True:
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        e = cut(small, e)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("v"), F.col("b").alias("component")).union(e.select(F.col("b").alias("v"), F.col("b").alias("component"))).distinct()


def numbered(docs: DataFrame) -> tuple[DataFrame, int | None]:
    """The rows with numbers above the largest id in place of null ids, and that id; None where no id is null."""
    top, lost = docs.agg(F.coalesce(F.max("doc_id"), F.lit(0)), F.count_if(F.col("doc_id").isNull())).first()
    if not lost:
        return docs, None
    # written, as the numbers must not change between reads
    rest = cut(docs.where(F.col("doc_id").isNull()).withColumn("doc_id", F.lit(top + 1).cast("long") + F.monotonically_increasing_id()))
    return docs.where(F.col("doc_id").isNotNull()).unionByName(rest), top


def named(c: str, top: int | None) -> Column:
    return F.col(c) if top is None else F.when(F.col(c) <= top, F.col(c)).alias(c)


def link(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest doc_id of the same set) and component_id of each document."""
    docs, top = numbered(docs)
    return _link(docs, share).select(named("doc_id", top), "n_shingles", named("component_id", top), named("class_id", top))


def _link(docs: DataFrame, share: int) -> DataFrame:
    """As link(), without null ids."""
    sets = cut(_sets(docs))
    hist = _histogram(sets)
    rows = sets.where("doc_id IS NOT NULL")
    classes = rows.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("class_id"))
    member = cut(rows.join(classes, "fp", "left").select("doc_id", "n", F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.when(F.col("doc_id") == F.col("class_id"), F.col("sk")).alias("sk")), sets)
    first = member.where("doc_id = class_id AND n > 0").select("doc_id").distinct()
    tokens = member.where("doc_id = class_id").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * (1 - share / 100)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(tokens / ROWS))
    reps = only(docs.select("doc_id", "text"), "doc_id", first)
    found = cut(groups(prefixes(reps, hist, parts, share), share))
    fresh = cut(leaders(found, share))
    rows = cut(spread(found), found)
    tested, comp, turn, last = [], None, 0, False
    while True:
        edges = verify(docs, fresh, hist, share)
        asked, joined = fresh.count(), edges.count()
        if comp is None:
            comp = components(edges)
        elif joined:
            comp = components(comp.toDF("a", "b").union(edges))  # stars need fewer rounds than links
        drop(edges)
        tested.append(fresh)
        if last:
            break
        last, turn = joined * PAYS <= asked, turn + 1
        left = cut(mixed(rows, comp))
        cells = max(left.count() // 200_000, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        pairs = counted(left, member.where("doc_id = class_id AND n > 0").groupBy("doc_id").agg(F.first("sk")), cells, share) if last else asking(left, cells, turn, share)
        fresh = pairs.select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a")).distinct()
        for old in tested:
            fresh = fresh.join(old.select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a")), ["a", "b"], "left_anti")
        fresh = cut(fresh, left)
    drop(rows, *tested)
    out = member.join(comp, F.col("class_id") == F.col("v"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "class_id").alias("component_id"), "class_id")


def keep_first(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """One document, that of the smallest doc_id, of each component; of rows that repeat its id, one."""
    docs, top = numbered(docs)
    links = cut(_link(docs, share))
    gone = cut(links.where("doc_id <> component_id").select("doc_id").distinct())
    again = cut(links.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id"), links)
    kept = without(docs, "doc_id", gone)
    if again.take(1):
        kept = without(kept, "doc_id", again).unionByName(only(kept, "doc_id", again).dropDuplicates(["doc_id"]))
    return kept if top is None else kept.withColumn("doc_id", named("doc_id", top))
