"""Merkle manifest of a dataset: a persistent tree whose versions share every node that a change leaves alone."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.operators.ordering import with_ordinal
from scanloom.session import settle

#: Children of a node, and levels of a block: a block has FAN ** LEVELS consecutive nodes at its bottom.
FAN, LEVELS = 8, 3
BLOCK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(texts: list[str]) -> str:
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def framed(col: Column) -> Column:
    """``-`` for NULL, else UTF-8 byte count, ``:`` and the value; no two rows of values read alike."""
    value = col.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def row_digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[framed(v) for v in values]).cast("binary"), 256)


def climb(hashes: list[str], levels: int) -> list[list[str]]:
    """The nodes of every level from the bottom up; each FAN consecutive ones, the last run fewer, become their digest."""
    out = [hashes]
    for _ in range(levels):
        below = out[-1]
        out.append([digest(below[i : i + FAN]) for i in range(0, len(below), FAN)])
    return out


def siblings(nodes: list[list[str]], at: int) -> tuple[list[str], list[str]]:
    """Texts left and right of the path from place ``at`` upwards, one pair a level below the top."""
    left, right = [], []
    for row in nodes[:-1]:
        start = at // FAN * FAN
        left.append("".join(row[start:at]))
        right.append("".join(row[at + 1 : start + FAN]))
        at //= FAN
    return left, right


def height(n: Column) -> Column:
    """Levels above ``n`` leaves, by whole numbers: how often they divide by FAN until one is left."""
    out = F.lit(0)
    for k in range(21):
        out = out + F.when(n > F.lit(FAN**k), 1).otherwise(0)
    return out


def _levels(high: int, k: int) -> int:
    """Levels that a block of the ``k``-th layer of blocks climbs in a tree of height ``high``."""
    return max(0, min(LEVELS, high - k * LEVELS))


@dataclass
class Tree:
    """One tree per ``key``: ``sizes(key, high)`` has the heights, ``layers[k](key, pos, hash, high)`` the nodes of level
    (k + 1) * LEVELS, the last layer the roots."""

    sizes: DataFrame
    layers: list[DataFrame]

    @property
    def roots(self) -> DataFrame:
        return self.layers[-1].select("key", "hash")


def _block(pos: str = "pos") -> Column:
    return (F.col(pos) / BLOCK).cast("long")


def _top(k: int):
    """Of a block of layer ``k``, its top node."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        high, first = int(rows["high"].iloc[0]), int(rows["pos"].iloc[0])
        up = climb(rows["hash"].tolist(), _levels(high, k))[-1]
        return pd.DataFrame({"key": rows["key"].iloc[0], "pos": [first // BLOCK], "hash": up, "high": [high]})

    return run


def grow(leaves: DataFrame) -> Tree:
    """The trees over ``leaves(key, pos, hash)``, ``pos`` gapless from 0 in every key.

    A task builds one aligned block of at most BLOCK nodes, and only the block's top goes on to the next layer, which is
    a table again; so a key with most of the rows is many blocks, and no task holds a whole level.
    """
    sizes = settle(leaves.groupBy("key").agg(height(F.count(F.lit(1))).cast("int").alias("high")))
    layer = leaves.select("key", "pos", "hash").join(sizes, "key")
    highest = sizes.agg(F.max("high")).first()[0] or 0
    layers = []
    for k in range(max(1, -(-highest // LEVELS))):
        layer = settle(layer.groupBy("key", _block().alias("_block")).applyInPandas(_top(k), "key string, pos long, hash string, high int"))
        layers.append(layer)
    return Tree(sizes, layers)


PATH = "key string, pos long, lefts array<string>, rights array<string>, tops array<string>"


def _interleaved(lefts: list[str], rights: list[str]) -> str:
    return "".join(x for pair in zip(lefts, rights) for x in pair)


def _joined(way: pd.DataFrame) -> tuple[list[str], list[str], list[str]]:
    return tuple(list(way[c].iloc[0]) for c in ("lefts", "rights", "tops")) if len(way) else ([], [], [])


def _ways(k: int, name: str):
    """Of a block of layer ``k`` and the way on from its top, the way from every node; ``name`` is the column that names it."""
    def run(rows: pd.DataFrame, way: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        levels = climb(rows["hash"].tolist(), _levels(int(rows["high"].iloc[0]), k))
        lefts, rights, tops = _joined(way)
        out = []
        for i, (key, own) in enumerate(zip(rows["key"], rows[name])):
            left, right = siblings(levels, i)
            out.append((key, own, left + lefts, right + rights, [levels[j][i // FAN**j] for j in range(1, len(levels))] + tops))
        return pd.DataFrame(out, columns=["key", name, "lefts", "rights", "tops"])

    return run


def paths(tree: Tree, crown: DataFrame | None = None) -> DataFrame:
    """The way to the root from the top of every lowest block, one row for up to BLOCK leaves: the texts ``lefts`` and
    ``rights`` of it on every level, and ``tops``, the nodes on the way.

    ``crown(key, lefts, rights, tops)`` goes on above the roots, where the trees are leaves of another one.
    """
    none = F.array().cast("array<string>")
    now = tree.layers[-1].select("key", "pos")
    if crown is None:
        now = now.select("*", none.alias("lefts"), none.alias("rights"), none.alias("tops"))
    else:
        now = settle(now.join(crown, "key").select("key", "pos", "lefts", "rights", "tops"))
    for k in range(len(tree.layers) - 1, 0, -1):
        below = tree.layers[k - 1].groupBy("key", _block().alias("_block"))
        now = settle(below.cogroup(now.groupBy("key", "pos")).applyInPandas(_ways(k, "pos"), PATH))
    return now


VERSIONS = "subroot string, root string, proof string, new_root string, copied array<string>"


def versions(tree: Tree, leaves: DataFrame, crown: DataFrame | None = None) -> DataFrame:
    """Proof of every leaf, and for every changed leaf a version of the tree.

    ``leaves(key, pos, hash, new_hash, ...)`` are those of the tree, with the new digest where a version changes one; each
    version changes one leaf. It shares all nodes of the tree but that leaf's ancestors: ``copied`` has those, bottom up,
    level l at place pos // FAN ** l. The copies inside the aligned block are made from the block's own nodes; those above
    go on along the block's path, so the versions of a key never meet in one task. Adds ``subroot`` (the key's root),
    ``root``, ``proof`` (digest of all siblings on the way), ``new_root`` (the version's root, the tree's own where nothing
    changes) and ``copied`` (NULL where nothing changes) to the given columns.
    """
    kept = leaves.columns

    def run(rows: pd.DataFrame, way: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos").reset_index(drop=True)
        high = int(rows["high"].iloc[0])
        levels = climb(rows["hash"].tolist(), _levels(high, 0))
        lefts, rights, tops = _joined(way)
        subroot = tops[high - LEVELS - 1] if high > LEVELS else levels[-1][0]
        root = tops[-1] if tops else subroot
        above = _interleaved(lefts, rights).encode()
        out = []
        for i, new in enumerate(rows["new_hash"]):
            left, right = siblings(levels, i)
            proof = hashlib.sha256(_interleaved(left, right).encode())
            proof.update(above)
            copied, node = None, new
            if new is not None:
                copied = [node := digest([before, node, after]) for before, after in zip(left + lefts, right + rights)]
            out.append((subroot, root, proof.hexdigest(), root if new is None else node, copied))
        made = pd.DataFrame(out, columns=["subroot", "root", "proof", "new_root", "copied"])
        return pd.concat([rows[kept], made], axis=1)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in leaves.schema) + ", " + VERSIONS
    blocks = leaves.join(tree.sizes, "key").groupBy("key", _block().alias("_block"))
    return blocks.cogroup(paths(tree, crown).groupBy("key", "pos")).applyInPandas(run, schema)


def _above(k: int):
    """Of a block of layer ``k``, all nodes above the given ones."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        up = climb(rows["hash"].tolist(), _levels(int(rows["high"].iloc[0]), k))
        first = int(rows["pos"].iloc[0])
        made = [(rows["key"].iloc[0], k * LEVELS + j, first // FAN**j + i, h) for j, row in enumerate(up) if j for i, h in enumerate(row)]
        return pd.DataFrame(made, columns=["key", "level", "pos", "hash"])

    return run


def nodes(tree: Tree, leaves: DataFrame) -> DataFrame:
    """All nodes of the trees, ``(key, level, pos, hash)``, leaves at level 0."""
    out = leaves.select("key", F.lit(0).alias("level"), "pos", "hash")
    below = leaves.select("key", "pos", "hash").join(tree.sizes, "key")
    for k, layer in enumerate(tree.layers):
        made = below.groupBy("key", _block().alias("_block")).applyInPandas(_above(k), "key string, level int, pos long, hash string")
        out, below = out.union(made), layer
    return out


def version_nodes(tree_nodes: DataFrame, version: DataFrame) -> DataFrame:
    """Nodes of one version as a reader sees them: ``(key, level, pos, hash, shared)``.

    ``version`` is its row ``(key, pos, new_hash, copied)``; all nodes but the copied ones are the tree's own.
    """
    own = version.select("key", "pos", F.posexplode(F.concat(F.array("new_hash"), "copied")).alias("level", "_new"))
    own = own.select("key", "level", F.floor(F.col("pos") / F.pow(F.lit(float(FAN)), "level")).cast("long").alias("pos"), "_new")
    rows = tree_nodes.join(version.select("key"), "key", "left_semi").join(own, ["key", "level", "pos"], "left")
    return rows.select("key", "level", "pos", F.coalesce("_new", "hash").alias("hash"), F.col("_new").isNull().alias("shared"))


def placed_leaves(docs: DataFrame, changed: Column, new_text: Column) -> DataFrame:
    """Leaves ``(key, pos, doc_id, hash, new_hash)`` of ``docs``, one pass over the texts.

    ``key`` stands for ``lang`` and sorts like it, NULL first. Positions ascend by ``doc_id``, NULL first; rows of one id
    by digest, so that equal rows are interchangeable.
    """
    doc_id = F.col("doc_id").cast("long")
    old = [F.col(f) for f in FIELDS]
    new = [*old[:-1], new_text]
    key = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-"))
    rows = docs.select(key.alias("key"), doc_id.alias("doc_id"), row_digest(old).alias("hash"), F.when(changed, row_digest(new)).alias("new_hash"))
    order = [F.asc_nulls_first("doc_id"), F.asc("hash")]
    return settle(with_ordinal(settle(rows), ["key"], order, "pos").withColumn("pos", F.col("pos") - 1))


def tampered(one_in: int = 3) -> Column:
    """Rows whose checksum of the decimal id ``one_in`` divides; never rows without id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % one_in == 0, F.lit(False))


def lowered() -> Column:
    return F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def merkle_manifest(docs: DataFrame, changed: Column | None = None, new_text: Column | None = None) -> DataFrame:
    """Manifest of ``docs(doc_id, text, lang, source, n_chars)`` and a version of it for every changed row.

    Returns doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, copied. ``changed`` rows get ``new_text``; by
    default a third of the rows, lower-cased. Every row is a leaf: NULL values and empty texts have digests of their own,
    rows of a NULL ``lang`` form one tree, rows without id come first and are never changed, repeated rows are leaves
    of their own with equal results in some order. Other columns are ignored. An empty table gives an empty result.
    """
    leaves = placed_leaves(docs, tampered() if changed is None else changed, lowered() if new_text is None else new_text)
    tree = grow(leaves)
    # The subroots are the leaves of one more tree, which goes through the same blocks.
    subs = tree.roots.select(F.lit("").alias("key"), F.col("key").alias("lang"), "hash")
    subs = settle(with_ordinal(subs, ["key"], [F.asc("lang")], "pos").withColumn("pos", F.col("pos") - 1))
    crown = grow(subs)
    made = versions(tree, leaves, _crown_paths(crown, subs))
    return made.select(
        "doc_id", F.col("hash").alias("leaf"), "subroot", "root", F.col("proof").alias("proof_sha256"),
        F.col("new_root").alias("folded_root"), (F.col("new_root") == F.col("root")).alias("verified"), "copied",
    )


def _crown_paths(crown: Tree, subs: DataFrame) -> DataFrame:
    """``(key, lefts, rights, tops)`` of every subroot, ``key`` the one of its own tree."""
    blocks = subs.join(crown.sizes, "key").groupBy("key", _block().alias("_block"))
    schema = PATH.replace("pos long", "lang string")
    ways = blocks.cogroup(paths(crown).groupBy("key", "pos")).applyInPandas(_ways(0, "lang"), schema)
    return settle(ways.select(F.col("lang").alias("key"), "lefts", "rights", "tops"))
