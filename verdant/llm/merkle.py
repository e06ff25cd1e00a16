"""A Merkle manifest of a table: one tree for each part, one over the parts' roots, and a proof for each row.

Slot pivot: conditional aggregates spread the children of a parent into fanout columns; the columns concatenated hash to the parent,
and all but the own one are a child's siblings. A pivot takes `levels` levels at once: fanout ** levels slots, from which the levels
above follow column by column, so a tree of n leaves needs log(n) / log(slots) shuffles, each of a fraction of the rows before it.
On the way down a block hands each slot its siblings, before and after it, in front of those of the block itself; whole proofs exist
only inside the last step's rows. A part of any size is spread: places within parts come from one range sort.

Null fields are written `-`, others as byte count, `:`, value. Null part: a part of its own, the first. Equal order keys are ordered
by their leaf; repeated rows are leaves of their own. Null id: first, and never tampered. A part of one leaf: its root is the leaf.
Empty texts and very long ones: whole. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, number

LEVELS = 4
SIDES = "array<struct<before: string, after: string>>"


def field(c: Column) -> Column:
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def digest(*fields: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in fields]), 256)


def count_at(level: int, fanout: int) -> str:
    """Nodes of the tree so many levels above those counted in n."""
    return f"CAST(ceil(n / {fanout**level}) AS BIGINT)"


def pivot(nodes: DataFrame, part: str, fanout: int, levels: int, extras: tuple[str, ...] = ()) -> DataFrame:
    """A row for each block of fanout ** levels nodes (part, k, n, h): s0_i are its nodes, s1_i.. the levels above them."""
    slots = fanout**levels
    spread = [F.expr(f"max(CASE WHEN k % {slots} = {i} THEN {c} END) AS {to}_{i}") for c, to in (("h", "s0"), *((e, e) for e in extras)) for i in range(slots)]
    b = nodes.groupBy(part, F.expr(f"k div {slots} AS b")).agg(F.max("n").alias("n"), *spread)
    for level in range(1, levels + 1):
        below = [[f"s{level - 1}_{fanout * i + j}" for j in range(fanout)] for i in range(slots // fanout**level)]
        # above the root of the part nothing is hashed
        b = b.selectExpr("*", *[f"CASE WHEN {x[0]} IS NULL THEN NULL WHEN {count_at(level - 1, fanout)} > 1 THEN sha2(concat_ws('', {', '.join(x)}), 256) ELSE {x[0]} END AS s{level}_{i}" for i, x in enumerate(below)])
    return b


def parents(blocks: DataFrame, part: str, fanout: int, levels: int) -> DataFrame:
    return blocks.selectExpr(part, "b AS k", f"{count_at(levels, fanout)} AS n", f"s{levels}_0 AS h")


def spread_down(blocks: DataFrame, part: str, fanout: int, levels: int, keep: tuple[str, ...], extras: tuple[str, ...] = ()) -> DataFrame:
    """(part, k, path, keep.., h, extras..) of each node of blocks, whose column path holds the siblings above each block."""
    side = lambda level, places: f"concat_ws('', {', '.join(f's{level}_{c}' for c in places)})" if places else "''"
    out = []
    for i in range(fanout**levels):
        inner = []
        for level in range(levels):
            own = i // fanout**level
            run = own // fanout * fanout
            inner.append(f"CASE WHEN {count_at(level, fanout)} > 1 THEN named_struct('before', {side(level, range(run, own))}, 'after', {side(level, range(own + 1, run + fanout))}) END")
        more = "".join(f", '{e}', {e}_{i}" for e in extras)
        out.append(f"named_struct('k', b * {fanout**levels} + {i}, 'path', CAST(concat(filter(array({', '.join(inner)}), s -> s IS NOT NULL), path) AS {SIDES}), 'h', s0_{i}{more})")
    one = blocks.select(part, *keep, F.expr(f"explode(filter(array({', '.join(out)}), x -> x.h IS NOT NULL)) AS x"))
    return one.select(part, *keep, "x.*")


def tree(nodes: DataFrame, part: str, fanout: int, levels: int, extras: tuple[str, ...] = ()) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of each step, the lowest first, and (part, h), the root of each part."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    steps, slots = [], fanout**levels
    while True:
        steps.append(cut(pivot(nodes, part, fanout, levels, extras if not steps else ())))
        nodes = parents(steps[-1], part, fanout, levels)
        most = -(-most // slots)
        if most <= 1:
            return steps, nodes.select(part, "h")


def proofs(steps: list[DataFrame], top: DataFrame, part: str, fanout: int, levels: int, extras: tuple[str, ...] = ()) -> DataFrame:
    """Nodes with their paths. top: (part, path, and what all nodes of the part keep)."""
    keep = tuple(c for c in top.columns if c not in (part, "path"))
    above = top.withColumn("b", F.lit(0).cast("long"))
    for i, blocks in reversed(list(enumerate(steps))):
        above = above.withColumnsRenamed({part: "_part", "b": "_b"})
        met = blocks.join(above, blocks[part].eqNullSafe(above["_part"]) & (blocks["b"] == above["_b"])).drop("_part", "_b")
        out = spread_down(met, part, fanout, levels, keep, extras if i == 0 else ())
        above = out.select(part, F.col("k").alias("b"), "path", *keep)
    return out


def fold(start: Column, path: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(path, start, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def manifest(leaves: DataFrame, part: str = "part", fanout: int = 2, levels: int = LEVELS) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root) of leaves (id, part, leaf, forged); forged replaces the leaf when the root is recomputed."""
    n = number(leaves, [part], ["id", "leaf"])
    steps, subroots = tree(n.withColumn("h", F.col("leaf")), part, fanout, levels, ("id", "forged"))
    drop(n)
    subroots = number(subroots.withColumn("all", F.lit(0)), [], [part])
    over, root = tree(subroots.select("all", "k", "n", "h", F.col(part).alias("name")), "all", fanout, levels, ("name",))
    root = [r["h"] for r in root.collect()]  # one row, none of an empty table
    top = over[0].sparkSession.createDataFrame([(0, [])], f"all int, path {SIDES}")
    names = proofs(over, top, "all", fanout, levels, ("name",)).select(F.col("name").alias(part), "path", F.col("h").alias("subroot"))
    d = proofs(steps, names, part, fanout, levels, ("id", "forged"))
    return d.select(
        "id", F.col("h").alias("leaf"), "subroot", F.lit(root[0] if root else None).cast("string").alias("root"),
        F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), ""), 256).alias("proof_sha256"),
        fold(F.coalesce("forged", "h"), F.col("path")).alias("folded_root"))


def documents(docs: DataFrame, tampered: Column) -> DataFrame:
    """Leaves of documents by language; where tampered holds, forged is the leaf of n_chars + 1."""
    f = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    forged = F.when(tampered, digest(*(f | {"n_chars": F.col("n_chars") + 1}).values()))
    return docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("part"), digest(*f.values()).alias("leaf"), forged.alias("forged"))


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of an ASCII string: one step for each character and bit."""
    bits = ", ".join("0" * 8)
    steps = f"flatten(list_transform(range(1, strlen({text}) + 1), lambda i: [1000 + ord({text}[i]), {bits}]))"
    return f"xor(list_reduce(list_concat([4294967295], {steps}), lambda a, x: CASE WHEN x >= 1000 THEN xor(a, x - 1000) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"


def _leaf_sql(n_chars: str) -> str:
    one = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    return f"sha256({reduce(lambda a, c: a + ' || ' + c, map(one, ('doc_id', 'source', 'lang', n_chars, 'text')))})"


_NEXT = "list_transform(range(0, (len(h) + 1) // 2), lambda i: sha256(h[2*i+1] || coalesce(h[2*i+2], '')))"
_STEP = "CASE WHEN ((k >> l) & 1) = 1 THEN 'L' ELSE 'R' END || coalesce(h[CAST(xor(k >> l, 1) AS BIGINT) + 1], '')"
#: Trees of lists, level by level; a proof step is the side of the sibling and the sibling.
ORACLE = f"""WITH RECURSIVE leaves AS (SELECT doc_id, lang, {_leaf_sql('n_chars')} leaf,
  CASE WHEN doc_id IS NOT NULL AND {crc32_sql('CAST(doc_id AS VARCHAR)')} % 7 = 0 THEN {_leaf_sql('n_chars + 1')} ELSE {_leaf_sql('n_chars')} END forged FROM documents),
 d AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 k FROM leaves),
 up AS (SELECT lang, 0 l, list(leaf ORDER BY k) h FROM d GROUP BY lang UNION ALL SELECT lang, l + 1, {_NEXT} FROM up WHERE len(h) > 1),
 sub AS (SELECT lang, h[1] subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 k FROM up WHERE len(h) = 1),
 over_all AS (SELECT 0 l, list(subroot ORDER BY k) h FROM sub UNION ALL SELECT l + 1, {_NEXT} FROM over_all WHERE len(h) > 1),
 sub_path AS (SELECT lang, any_value(subroot) subroot, coalesce(list({_STEP} ORDER BY l) FILTER (WHERE len(h) > 1), []) path FROM sub CROSS JOIN over_all GROUP BY lang),
 own AS (SELECT d.lang, d.k, any_value(doc_id) doc_id, any_value(leaf) leaf, any_value(forged) forged, coalesce(list({_STEP} ORDER BY l) FILTER (WHERE len(h) > 1), []) path FROM d JOIN up ON d.lang IS NOT DISTINCT FROM up.lang GROUP BY 1, 2),
 full_path AS (SELECT doc_id, leaf, forged, subroot, list_concat(own.path, s.path) path FROM own JOIN sub_path s ON own.lang IS NOT DISTINCT FROM s.lang),
 folded AS (SELECT *, list_reduce(list_concat([forged], path), lambda a, x: sha256(CASE WHEN x[1] = 'L' THEN x[2:] || a ELSE a || x[2:] END)) folded_root, (SELECT h[1] FROM over_all WHERE len(h) = 1) root FROM full_path)
 SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(path, lambda x: x[2:]), ''), '')) proof_sha256, folded_root, folded_root = root verified FROM folded"""
