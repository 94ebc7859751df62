"""A Merkle manifest of a dataset: every row a leaf, a tree for each source, and one over the sources.

Leaves are digests made where the rows are read; only these are shuffled. They are numbered in the order of
(source, id) by ranges, and cut into superblocks of 3 ** LEVELS consecutive leaves of a source. A superblock is reduced
to its top by itself, tops to tops of tops, until a source has one node; the sources' nodes are leaves of the tree over
them. On the way down, the nodes of a superblock are cogrouped with the one path that leads from its top to the root:
the group reduces its nodes again, joins each node's inner siblings to the outer ones and folds. What leaves a group is
a path for each superblock below it, or the finished rows.

So a group has two superblocks of nodes at most, however many rows a source has, and rounds grow with the logarithm of
a source's rows to the base of a superblock's size. Trees that fit in a superblock share groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaygrid.llm.tables import arrow_batches, written

#: Nodes of a run, and levels of a superblock.
ARITY, LEVELS = 3, 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_text(fields: Sequence[Column]) -> Column:
    """What a leaf is the digest of: for each value "-" if null, else its UTF-8 bytes' count, ":" and the value."""
    each = [c.cast("string") for c in fields]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in each])


def _h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels_of(digests: list[str], n: int, levels: int) -> list[list[str]]:
    """The nodes of each level of a superblock of a tree with n nodes: up to its top, or to the tree's."""
    out = [digests]
    while n > 1 and len(out) <= levels:
        now = out[-1]
        out.append([_h("".join(now[i : i + ARITY])) for i in range(0, len(now), ARITY)])
        n = -(-n // ARITY)
    return out


def inner_paths(levels: list[list[str]]) -> list[tuple[list[str], list[str]]]:
    """For each node of the lowest level: what stands left and right of it in its run, then of the run's node, and so on."""
    below: list[tuple[list[str], list[str]]] = [([], []) for _ in levels[-1]]
    for now in reversed(levels[:-1]):
        here = []
        for i in range(len(now)):
            a, up = i - i % ARITY, below[i // ARITY]
            here.append((["".join(now[a:i]), *up[0]], ["".join(now[i + 1 : a + ARITY]), *up[1]]))
        below = here
    return below


def fold(digest: str, lefts: Sequence[str], rights: Sequence[str]) -> str:
    """The root that a digest leads to along its siblings."""
    for a, b in zip(lefts, rights, strict=True):
        digest = _h(a + digest + b)
    return digest


def proof(lefts: Sequence[str], rights: Sequence[str]) -> str:
    """The digest of all siblings, level by level, left to right."""
    return _h("".join(a + b for a, b in zip(lefts, rights, strict=True)))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """A written table of df with name: 0, 1, 2 ... in the order of the columns (nulls first), which must tell rows apart.

    Rows are dealt in ranges and sorted inside them; a range starts where those before it end: one small row a range.
    """
    keys = [F.col(c).asc_nulls_first() for c in order]
    ranged, _ = written(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    ranged = ranged.withColumn("_part", F.shiftright("_at", 33))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_start"))
    placed = ranged.join(F.broadcast(starts), "_part")  # as many rows as there are ranges
    return placed.withColumn(name, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_start")


class Tree:
    """Trees whose leaves are rows (tree, n, first, pos, digest, ...): n leaves of the tree, first: the number of its first leaf
    over all trees, pos: a leaf's place in its tree."""

    NODE = "tree long, n long, first long, pos long, digest string"
    STEP = "tree long, pos long, digest string, lefts array<string>, rights array<string>, subroot string, root string"

    def __init__(self, leaves: DataFrame, most: int, levels: int, name: str):
        """most: leaves of the largest tree. The nodes of each round of superblocks are written."""
        self.levels, self.size = levels, ARITY**levels
        self.rounds, tops = [leaves], []
        size = self.size
        while True:
            nodes = self._dealt(self.rounds[-1].select("tree", "n", "first", "pos", "digest"))
            up, _ = written(nodes.groupBy("g1", "g2").applyInPandas(lambda frame: _tops(frame, levels), self.NODE), name)
            tops.append(up.where("n = 1"))
            most = -(-most // size)
            if most <= 1:
                break
            self.rounds.append(up.where("n > 1"))
        #: A row for each tree: its top node.
        self.tops = reduce(DataFrame.unionByName, tops).select("tree", "digest")

    def _dealt(self, nodes: DataFrame) -> DataFrame:
        """nodes with their group: a superblock of a large tree, or small trees that begin in one stretch of leaves."""
        large = F.col("n") > self.size
        return nodes.withColumns({"g1": F.when(large, F.col("tree")).otherwise(F.lit(-1)), "g2": F.floor(F.when(large, F.col("pos")).otherwise(F.col("first")) / self.size).cast("long")})

    def walk(self, outer: DataFrame, last: Callable[[list], pd.DataFrame], schema: str) -> DataFrame:
        """Down from the path that leads on from each tree's top (tree, n, first, lefts, rights, subroot, root).

        last: rows made of the placed nodes of a group of leaves, of this schema.
        """
        levels, size, paths = self.levels, self.size, None
        ends = outer.withColumns({"g1": F.lit(-1).cast("long"), "g2": F.floor(F.col("first") / size).cast("long")})
        for k in range(len(self.rounds) - 1, -1, -1):
            # trees that end in one superblock of this round; others hang on the nodes of the round above
            above = ends.where((F.col("n") <= size ** (k + 1)) & (F.col("n") > (size**k if k else 0))).drop("n", "first")
            if paths is not None:
                above = above.unionByName(paths.withColumns({"g1": F.col("tree"), "g2": F.col("pos")}).drop("pos", "digest"))
            both = self._dealt(self.rounds[k]).groupBy("g1", "g2").cogroup(above.groupBy("g1", "g2"))
            paths = both.applyInPandas(_joined(last if k == 0 else _steps, levels), schema if k == 0 else self.STEP)
        return paths


def _joined(made: Callable[[list], pd.DataFrame], levels: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    return lambda nodes, outer: made(_placed(nodes, outer, levels))


def _trees(frame: pd.DataFrame) -> list[pd.DataFrame]:
    """The trees of a group, nodes in order."""
    return [t for _, t in frame.sort_values(["tree", "pos"]).groupby("tree", sort=False)]


def _tops(frame: pd.DataFrame, levels: int) -> pd.DataFrame:
    """The top node of each tree or superblock of a group, as a node of the next round."""
    rows, size = [], ARITY**levels
    for t in _trees(frame):
        n = int(t["n"].iloc[0])
        rows.append((int(t["tree"].iloc[0]), -(-n // size), int(t["first"].iloc[0]), int(t["pos"].iloc[0]) // size, levels_of(t["digest"].tolist(), n, levels)[-1][0]))
    return pd.DataFrame(rows, columns=["tree", "n", "first", "pos", "digest"])


def _placed(frame: pd.DataFrame, outer: pd.DataFrame, levels: int) -> list[tuple[pd.DataFrame, list[tuple[list[str], list[str]]], dict]]:
    """Each tree's nodes of a group, their whole paths to the root, and the outer row."""
    outside = {int(r["tree"]): r for r in outer.to_dict("records")}
    out = []
    for t in _trees(frame):
        above = outside[int(t["tree"].iloc[0])]
        inner = inner_paths(levels_of(t["digest"].tolist(), int(t["n"].iloc[0]), levels))
        out.append((t, [(a + list(above["lefts"]), b + list(above["rights"])) for a, b in inner], above))
    return out


def _steps(placed: list) -> pd.DataFrame:
    """The path of each node, which is the outer path of a superblock below it."""
    rows = [(tree, pos, digest, *path, above["subroot"], above["root"]) for t, paths, above in placed for tree, pos, digest, path in zip(t["tree"], t["pos"], t["digest"], paths, strict=True)]
    return pd.DataFrame(rows, columns=["tree", "pos", "digest", "lefts", "rights", "subroot", "root"])


def _proved(placed: list) -> pd.DataFrame:
    """Leaves with their proofs, and what each folds to as it is now."""
    rows = [
        (key, leaf, above["subroot"], above["root"], lefts, rights, proof(lefts, rights), fold(now if isinstance(now, str) else leaf, lefts, rights))
        for t, paths, above in placed
        for key, leaf, now, (lefts, rights) in zip(t["key"], t["digest"], t["now"], paths, strict=True)
    ]
    return pd.DataFrame(rows, columns=["key", "leaf", "subroot", "root", "lefts", "rights", "proof_sha256", "folded_root"])


def manifest(docs: DataFrame, now: dict[str, Column] | None = None, key: str = "doc_id", tree: str = "source", fields: Sequence[str] = FIELDS, proofs: bool = True, levels: int = LEVELS) -> DataFrame:
    """key, leaf, subroot, root, lefts, rights, proof_sha256, folded_root and verified of each row.

    leaf: the digest of the row's fields; subroot: of its tree (rows of equal tree, in the order of key); root: of all
    trees in bytewise order. lefts and rights: for each level up to the root, the joined digests of a run's nodes before
    and after the path's (left out without proofs); proof_sha256: the digest of all of these in order. now: expressions
    for fields as they are at the time of the check (default: unchanged); folded_root: where the leaf of these leads to,
    verified: whether that is root. Nulls in any field have a mark of their own; null trees come first, and null keys first
    in their tree. Rows of one key are in the order of their digests; rows repeated as a whole are leaves each.
    An empty table gives an empty result. Columns that are not fields do not matter.
    """
    arrow_batches(docs.sparkSession, 4000)
    column = lambda c: F.col(f"`{c}`")
    then = [column(f) for f in fields]
    after = [(now or {}).get(f, column(f)) for f in fields]
    changed = F.sha2(leaf_text(after), 256) if now else F.lit(None).cast("string")
    leaves, _ = written(docs.select(column(tree).alias("_tree"), column(key).alias("_key"), F.sha2(leaf_text(then), 256).alias("digest"), changed.alias("now"), F.monotonically_increasing_id().alias("_row")), "leaves")
    placed = numbered(leaves, ["_tree", "_key", "digest", "_row"], "_g")
    trees = placed.groupBy("_tree").agg(F.min("_g").alias("first"), F.count("*").alias("n"))
    trees = numbered(trees.withColumnRenamed("_tree", "_name"), ["first"], "tree")
    most, many = trees.agg(F.max("n"), F.count("*")).first()
    schema = "key string, leaf string, subroot string, root string, lefts array<string>, rights array<string>, proof_sha256 string, folded_root string"
    if not many:
        out = docs.sparkSession.createDataFrame([], schema)
    else:
        nodes = placed.join(trees, F.col("_tree").eqNullSafe(F.col("_name"))).select("tree", "n", "first", (F.col("_g") - F.col("first")).alias("pos"), "digest", F.col("_key").cast("string").alias("key"), "now")
        lower = Tree(nodes, most, levels, "nodes")
        upper = Tree(lower.tops.select(F.lit(0).cast("long").alias("tree"), F.lit(many).cast("long").alias("n"), F.lit(0).cast("long").alias("first"), F.col("tree").alias("pos"), "digest"), many, levels, "trees")
        root = upper.tops.first()["digest"]
        summit = docs.sparkSession.createDataFrame([(0, many, 0, [], [], root, root)], "tree long, n long, first long, lefts array<string>, rights array<string>, subroot string, root string")
        ends = upper.walk(summit, _steps, Tree.STEP).select(F.col("pos").alias("tree"), "lefts", "rights", F.col("digest").alias("subroot"), "root")
        outer, _ = written(ends.join(trees.select("tree", "n", "first"), "tree"), "outer")
        out = lower.walk(outer, _proved, schema) if proofs else lower.walk(outer, lambda p: _proved(p).drop(columns=["lefts", "rights"]), schema.replace(" lefts array<string>, rights array<string>,", ""))
    kept = [c for c in out.columns if c not in ("key", *(() if proofs else ("lefts", "rights")))]
    return out.select(F.col("key").cast(docs.schema[key].dataType).alias(key), *kept, (F.col("folded_root") == F.col("root")).alias("verified"))
