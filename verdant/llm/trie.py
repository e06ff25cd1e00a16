"""The prefix trie of conversations, with totals of each subtree.

Turns are reduced to a digest and a length before any shuffle. A prefix has a key: the digest of its turns within a block of RADIX
turns, chained to the key of the blocks before it, so that long conversations are hashed by parts. Grouping the keys gives the nodes,
named by their smallest member and depth.

Totals come by centroid decomposition of the parent-edge forest. The weight of a subtree, the sum of its nodes' members, is known
beforehand: each member adds what is left of it. A component is a subtree whose top has a weight from 2^c to below 2^(c+1); its
centroid is the deepest node of weight 2^c or more, which is over half of the component. There is one, as two of them side by side
would weigh more than the top, so the path from centroid to top is the nodes of class c. The component is split at that whole path at
once (the part above the centroid needs no round of its own), and all that hangs on it has a lower class: a walk from the root meets
each class once, whatever its length. Classes are done from the lowest: the totals of finished components are summed for the path node they hang on (partial sums
before the shuffle, as a node can have any number of children), then added along the path from centroid to top by a window. There
are at most 64 classes, each node is in one of them, and a chain of n nodes is one path, not n rounds.

Null conv_id: no conversation; such rows are left out. Null turn: first. Ties of turn: ordered by a digest of role and text; repeated
rows are turns of their own. Null role or text: empty. Very long texts: digested whole. Empty table: no rows, not even a root.
Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop, number
from .merkle import crc32_sql

RADIX = 64
CHUNK_BITS = 10
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, k, n, turn_digest, n_bytes): the kth (from 0) of n turns."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    slim = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", digest.alias("turn_digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    return number(slim, ["conv_id"], ["turn", "turn_digest"]).drop("turn")


def rebuilt(conversations: DataFrame, siblings: int = 5, head: Column | None = None, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """The conversations, each with the first turns of its family's base: (conv_id, length), and (conv_id, p, turn_digest, n_bytes, length), p from 1."""
    t = turns(conversations)
    h = F.crc32(F.col("conv_id").cast("string")) % most if head is None else head
    convs = t.where("k = 0").select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % siblings).alias("base"), h.alias("h"))
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(bases, "base", "left").withColumn("m", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = cut(convs.select("conv_id", "base", "h", "m", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")))
    opening = t.where(F.col("k") < most - 1).select(F.col("conv_id").alias("base"), "k", "turn_digest", "n_bytes")  # under most rows meet at most `siblings` conversations
    opening = convs.join(opening, "base").where("k < h").select("conv_id", (F.col("k") + 1).alias("p"), "turn_digest", "n_bytes", "length")
    own = t.join(convs, "conv_id").where("k >= h").select("conv_id", (F.col("m") + F.col("k") - F.col("h") + 1).alias("p"), "turn_digest", "n_bytes", "length")
    return convs.select("conv_id", "length"), opening.unionByName(own)


def prefix_keys(d: DataFrame) -> DataFrame:
    """d (conv_id, i from 0, digest, ..) with key: a digest of all digests up to i."""
    w = Window.partitionBy("conv_id", F.expr(f"i div {RADIX}")).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    d = cut(d.withColumn("key", F.md5(F.concat_ws(",", F.lit(""), F.col("i").cast("string"), F.concat_ws("", F.collect_list("digest").over(w))))))
    if (d.agg(F.max("i")).first()[0] or 0) < RADIX:
        return d
    whole = d.where(F.col("i") % RADIX == RADIX - 1).select("conv_id", F.expr(f"i div {RADIX}").alias("i"), F.col("key").alias("digest"))
    before = prefix_keys(whole).select(F.col("conv_id").alias("_conv"), (F.col("i") + 1).alias("_block"), F.col("key").alias("_before"))
    later = d.where(F.col("i") >= RADIX).join(before, (F.col("conv_id") == F.col("_conv")) & (F.expr(f"i div {RADIX}") == F.col("_block")))
    return cut(d.where(F.col("i") < RADIX).unionByName(later.withColumn("key", F.md5(F.concat("_before", "key"))).select(d.columns)), d)


def hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ends_sha256) of chunks of ids that come in order, hashed as they come."""
    key, h = None, None
    out = lambda done: pa.RecordBatch.from_pydict({"key": [k for k, _ in done], "ends_sha256": [x for _, x in done]}, pa.schema([("key", pa.string()), ("ends_sha256", pa.string())]))
    for b in batches:
        done = []
        for k, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if k == key:
                h.update(b"," + ids.encode())
            else:
                if h:
                    done.append((key, h.hexdigest()))
                key, h = k, hashlib.sha256(ids.encode())
        yield out(done)
    if h:
        yield out([(key, h.hexdigest())])


def ends(last: DataFrame) -> DataFrame:
    """(key, ends_sha256) of rows (key, conv_id). A chunk's ids differ in their low bits only, so it has at most 1,024."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    chunks = last.groupBy("key", F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(ids.alias("ids"))
    return chunks.repartition("key").sortWithinPartitions("key", "chunk").select("key", "ids").mapInArrow(hash_ends, "key string, ends_sha256 string")


def weight_class(weight: Column) -> Column:
    """Floor of its binary logarithm."""
    return F.length(F.bin(weight)) - 1


def paths(d: DataFrame) -> DataFrame:
    """One row for each node but the root: its centroid-to-top path, and the node that the path hangs on.

    d: (conv_id, p, key, n_bytes, length). A conversation's rows are its walk from the top; classes only fall on the way.
    """
    left = F.col("length") - F.col("p") + 1
    found = d.groupBy("key").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("owner"), F.sum(left).alias("weight"))
    d = d.join(found, "key").withColumn("cls", weight_class(F.col("weight")))
    walk, own = Window.partitionBy("conv_id").orderBy("p"), Window.partitionBy("conv_id", "cls").orderBy("p")
    d = d.withColumns({"path": F.first("key").over(own), "top": F.min("p").over(own)})
    d = d.withColumns({"parent_conv_id": F.lag("owner").over(walk), "to": F.lag("cls").over(walk), "to_path": F.lag("path").over(walk)})
    at_top = F.col("p") == F.col("top")
    d = d.where("conv_id = owner").select(
        "conv_id", F.col("p").alias("depth"), "key", "parent_conv_id", "n_convs", "cls", "path", (F.col("weight") == F.col("n_convs")).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens"),
        F.when(at_top, F.col("to")).alias("to"), F.when(at_top, F.col("to_path")).alias("to_path"))
    return d.repartitionByRange("cls", "path", "depth")  # so a class is read from a few files


def totals(nodes: DataFrame) -> DataFrame:
    """(path, depth, n_children, n_leaves, saved_tokens) of each node's subtree."""
    classes = sorted(r[0] for r in nodes.select("cls").distinct().collect())  # at most 64
    down = Window.partitionBy("path").orderBy(F.desc("depth"))
    waiting, out = None, []
    sums = [F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")]
    for cls in classes:
        d = nodes.where(F.col("cls") == cls).select("path", "depth", F.lit(0).cast("long").alias("n_children"), "n_leaves", "saved_tokens", "to", "to_path")
        if waiting:
            d = d.unionByName(waiting.where(F.col("to") == cls).drop("to"), allowMissingColumns=True)
        d = d.groupBy("path", "depth").agg(*sums, F.max("to").alias("to"), F.max("to_path").alias("to_path"))
        d = d.withColumns({c: F.sum(c).over(down) for c in ("n_leaves", "saved_tokens")})
        d = d.withColumn("n_children", F.col("n_children") + (F.row_number().over(down) > 1).cast("long"))  # the next node of the path is a child
        out.append(cut(d))
        if cls != classes[-1]:
            found = out[-1].where("to IS NOT NULL").select(F.col("to_path").alias("path"), (F.col("depth") - 1).alias("depth"), F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens", "to")
            if waiting:
                found = found.unionByName(waiting.where(F.col("to") > cls))
            found = cut(found.groupBy("path", "depth", "to").agg(*sums), *([waiting] if waiting else []))
            waiting = found
    if waiting:
        drop(waiting)
    done = [d.select("path", "depth", "n_children", "n_leaves", "saved_tokens") for d in out]
    for d in done[1:]:
        done[0] = done[0].unionByName(d)
    return done[0] if done else nodes.select("path", "depth", F.lit(0).cast("long").alias("n_children"), "n_leaves", "saved_tokens")


def nodes(convs_and_turns: tuple[DataFrame, DataFrame]) -> DataFrame:
    """The nodes of the trie of conversations (conv_id, length) and their turns (conv_id, p, turn_digest, n_bytes, length)."""
    convs, seq = convs_and_turns
    keyed = prefix_keys(seq.select("conv_id", (F.col("p") - 1).alias("i"), F.col("turn_digest").alias("digest"), "n_bytes", "length"))
    keyed = keyed.select("conv_id", (F.col("i") + 1).alias("p"), "key", "n_bytes", "length")
    last = keyed.where("p = length").select("key", "conv_id").unionByName(convs.where("length = 0").select(F.lit("").alias("key"), "conv_id"))
    last = ends(last).withColumnsRenamed({"key": "_key"})
    first = convs.agg(F.min("conv_id"), F.count("*")).first()
    d = cut(paths(keyed))
    sums = totals(d).withColumnsRenamed({"path": "_path", "depth": "_depth"})
    kept = d.drop("n_leaves", "saved_tokens").join(sums, (F.col("path") == F.col("_path")) & (F.col("depth") == F.col("_depth")))
    kept = kept.withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(first[0])).otherwise(F.col("parent_conv_id")))
    tops = sums.where("_depth = 1").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    none = F.lit(0).cast("long")
    root = tops.select(
        F.lit(first[0]).cast("long").alias("conv_id"), none.alias("depth"), F.lit("").alias("key"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(first[1]).cast("long").alias("n_convs"),
        "n_children", F.coalesce("n_leaves", F.lit(1).cast("long")).alias("n_leaves"), F.coalesce("saved_tokens", none).alias("saved_tokens")).where("n_convs > 0")
    out = kept.select(root.columns).unionByName(root)
    return out.join(last, F.col("key") == F.col("_key"), "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))


_CRC = crc32_sql("CAST(conv_id AS VARCHAR)")
#: Prefixes as lists of turns; each node is joined with all its ancestors.
ORACLE = f"""WITH t AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) s FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
 r AS (SELECT t.conv_id, list_concat(coalesce(b.s, [])[:{_CRC.replace("conv_id", "t.conv_id")} % 9], t.s[{_CRC.replace("conv_id", "t.conv_id")} % 9 + 1:]) s FROM t LEFT JOIN t b ON b.conv_id = t.conv_id - t.conv_id % 5),
 p AS (SELECT conv_id, s[:d] s, d, len(s) l FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) d FROM r)),
 n AS (SELECT s, d, min(conv_id) conv_id, count(*) n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE l = d), '')) ends_sha256, CASE WHEN d > 0 THEN strlen(any_value(s)[d].text) ELSE 0 END b FROM p GROUP BY s, d),
 kids AS (SELECT s[:d-1] s, d - 1 d, count(*) k FROM n WHERE d > 0 GROUP BY ALL),
 m AS (SELECT n.*, coalesce(k, 0) n_children FROM n LEFT JOIN kids USING (s, d)),
 a AS (SELECT s[:e] s, e d, count(*) FILTER (WHERE n_children = 0) n_leaves, CAST(sum((n_convs - 1) * b) AS BIGINT) saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) e FROM m) GROUP BY s[:e], e)
 SELECT m.conv_id, m.d AS depth, q.conv_id parent_conv_id, m.n_convs, m.n_children, a.n_leaves, a.saved_tokens, m.ends_sha256
 FROM m JOIN a USING (s, d) LEFT JOIN m q ON q.s = m.s[:m.d-1] AND q.d = m.d - 1"""
