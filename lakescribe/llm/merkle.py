"""Merkle manifest of a table of documents: one tree a language, one tree over the languages, fan-out eight.

A tree is stored as aligned blocks: subtrees of a fixed height, whose roots are the leaves of the next tier of
blocks, and so on up to one block. Inside a block the nodes stand in van Emde Boas order: the block is split at half
its height, the upper subtree comes first, then the lower ones from left to right, each laid out the same way. So
the nodes of a path lie together whatever the size of a page or cache line is, and a node's place follows from its
depth and number alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakescribe.functions.scratch import cut
from lakescribe.llm.common import map_arrow, runs_of
from lakescribe.operators.numbering import numbered

FAN = 8
#: Levels of hashing in a block: 512 leaves, 585 nodes.
HEIGHT = 3
_LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def height_of(leaves: int) -> int:
    """Levels of hashing until one node is left."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // FAN), levels + 1
    return levels


# --- layout ---------------------------------------------------------------------------------------


def layout_size(levels: int) -> int:
    """Nodes of a complete tree with so many levels of nodes."""
    return (FAN**levels - 1) // (FAN - 1)


def address(levels: int, depth: int, number: np.ndarray) -> np.ndarray:
    """Places of the nodes `number` (from the left) at a depth (the root's is 0) in van Emde Boas order."""
    if levels == 1:
        return np.zeros_like(number)
    upper = levels // 2
    if depth < upper:
        return address(upper, depth, number)
    lower, span = levels - upper, FAN ** (depth - upper)
    return layout_size(upper) + number // span * layout_size(lower) + address(lower, depth - upper, number % span)


@lru_cache(maxsize=32)
def places(levels: int) -> list[np.ndarray]:
    """address() of all nodes, by depth."""
    return [address(levels, d, np.arange(FAN**d)) for d in range(levels)]


class Block:
    """A subtree: 32-byte digests in van Emde Boas order; of `leaves` leaves, the others do not exist."""

    def __init__(self, nodes: np.ndarray, leaves: int, height: int):
        self.nodes, self.height = nodes, height
        self.counts = [-(-leaves // FAN ** (height - d)) for d in range(height + 1)]  # existing nodes, by depth
        self.at = places(height + 1)

    @classmethod
    def build(cls, leaves: np.ndarray, height: int) -> Block:
        """From the digests of the leaves (rows of 32 bytes): each run of eight nodes becomes its parent."""
        block = cls(np.zeros((layout_size(height + 1), 32), np.uint8), len(leaves), height)
        block.nodes[block.at[height][: len(leaves)]] = leaves
        for d in range(height, 0, -1):
            text = block.nodes[block.at[d][: block.counts[d]]].tobytes().hex().encode()
            made = [hashlib.sha256(text[i : i + 64 * FAN]).digest() for i in range(0, len(text), 64 * FAN)]
            block.nodes[block.at[d - 1][: len(made)]] = np.frombuffer(b"".join(made), np.uint8).reshape(-1, 32)
        return block

    @property
    def root(self) -> bytes:
        return self.nodes[0].tobytes()

    def siblings(self, leaf: int) -> list[tuple[str, str]]:
        """Hex digests left and right of the node in its run, from the leaf up to below the root."""
        found = []
        for d in range(self.height, 0, -1):
            first = leaf - leaf % FAN
            run = self.nodes[self.at[d][first : min(first + FAN, self.counts[d])]].tobytes().hex()
            cut_ = 64 * (leaf - first)
            found.append((run[:cut_], run[cut_ + 64 :]))
            leaf //= FAN
        return found


Path = list[tuple[str, str]]


def folded(leaf: str, path: Path) -> str:
    """The root that a leaf gives with the siblings of a path."""
    for left, right in path:
        leaf = digest(left + leaf + right)
    return leaf


# --- tiers of blocks ------------------------------------------------------------------------------


def _tier(nodes: DataFrame, height: int) -> DataFrame:
    """(tree, block, leaves, height, nodes, root) from (tree, place, node); a task holds one block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, block), rows in runs_of(batches, 2):
            leaves = np.frombuffer(b"".join(rows.column(3).to_pylist()), np.uint8).reshape(-1, 32)
            # the first block of a tree that it does not fill is the only one, and ends at its own height
            levels = height if block else height_of(len(leaves))
            made = Block.build(leaves, levels)
            yield pa.RecordBatch.from_pylist([{
                "tree": tree, "block": block, "leaves": len(leaves), "height": levels, "nodes": made.nodes.tobytes(), "root": made.root}], schema)

    schema = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("leaves", pa.int32()), ("height", pa.int32()), ("nodes", pa.binary()), ("root", pa.binary())])
    dealt = nodes.select("tree", F.expr(f"place div {FAN**height}").alias("block"), "place", "node").repartition("tree", "block")
    return cut(map_arrow(dealt.sortWithinPartitions("tree", "block", "place"), run, "tree string, block bigint, leaves int, height int, nodes binary, root binary"))


def build_tiers(nodes: DataFrame, height: int = HEIGHT) -> list[DataFrame]:
    """Written tiers of blocks, lowest first, until each tree is one block; the tree's root is that of this block.

    nodes: (tree, place, node), places from 0 without gaps. Each tier has 8^height times fewer rows than the one before.
    """
    tiers = [_tier(nodes, height)]
    while tiers[-1].where("block > 0").limit(1).count():
        tiers.append(_tier(tiers[-1].select("tree", F.col("block").alias("place"), F.col("root").alias("node")), height))
    return tiers


_PATH = "array<struct<l:string,r:string>>"


def _paths(tier: DataFrame, above: DataFrame, height: int) -> DataFrame:
    """(tree, block, path) of the blocks whose roots are the leaves of this tier. above: the same of this tier's blocks."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(np.frombuffer(row["nodes"], np.uint8).reshape(-1, 32), row["leaves"], row["height"])
                first = row["block"] * FAN**height
                own = [{"tree": row["tree"], "block": first + i, "path": [{"l": x, "r": y} for x, y in block.siblings(i)] + row["path"]}
                       for i in range(row["leaves"])]
                yield pa.RecordBatch.from_pylist(own, schema)

    schema = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("path", pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())])))])
    return map_arrow(tier.drop("root").join(above, ["tree", "block"]), run, f"tree string, block bigint, path {_PATH}")


def _leaf(text: Column) -> Column:
    """Digest of a row with the given text."""
    field = lambda x: F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-"))
    values = [F.col(c).cast("string") for c in ("doc_id", "source", "lang", "n_chars")]
    return F.sha2(F.concat(*[field(x) for x in values], field(text)), 256)


def merkle_manifest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    Rows of one lang are the leaves of a tree, in the order of doc_id (null first, then by leaf); the roots of all
    trees, by lang (null first, bytewise), are the leaves of the last one. proof_sha256 is the digest of all siblings
    on the way to the root. Rows whose crc32(doc_id) is a multiple of 3 are verified with their text in lower
    case (A-Z), others as they are: verified says whether that leaf and the proof give the root. A row without id is not
    tampered with. Null and empty texts are different leaves; equal rows are leaves of their own. Without rows there is
    no root. Other columns are ignored. Leaves and roots are hex sha256; see _leaf.
    """
    text, number = F.col("text").cast("string"), F.col("doc_id").cast("string")
    changed = F.when(F.crc32(number) % 3 == 0, _leaf(F.translate(text, *_LETTERS)))
    # a lang is its tree's name, after a mark that puts null first
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    leaves = cut(docs.select(
        tree.alias("tree"), "doc_id", F.unhex(_leaf(text)).alias("leaf"), F.unhex(changed).alias("changed"),
        F.monotonically_increasing_id().alias("row")))  # written, so that equal rows keep an order
    placed = numbered(leaves, ["tree"], ["doc_id", "leaf", "row"], "place", 0)
    tiers = build_tiers(placed.select("tree", "place", F.col("leaf").alias("node")), height)
    subroots = tiers[-1].select("tree", F.col("root").alias("subroot"))
    langs = cut(numbered(subroots.withColumn("all", F.lit("")), ["all"], ["tree"], "place", 0))
    above = build_tiers(langs.select(F.col("all").alias("tree"), "place", F.col("subroot").alias("node")), height)
    top = above[-1].head()
    root = top.root.hex() if top else None
    path = above[-1].select("tree", "block", F.array().cast(_PATH).alias("path"))
    for tier in reversed(above):
        path = _paths(tier, path, height)
    path = langs.select("tree", "place").join(path.select(F.col("block").alias("place"), "path"), "place").select("tree", F.lit(0).cast("long").alias("block"), "path")
    for tier in reversed(tiers[1:]):
        path = _paths(tier, path, height)
    path = path.join(subroots, "tree")

    def run(batches):
        for _, rows in runs_of(batches, 2):
            first = rows.slice(0, 1).to_pylist()[0]  # the block's own row: its place is null
            block = Block(np.frombuffer(first["nodes"], np.uint8).reshape(-1, 32), first["leaves"], first["height"])
            shared: Path = [(x["l"], x["r"]) for x in first["path"]]
            own = rows.slice(1)
            made = {k: [] for k in ("leaf", "proof_sha256", "folded_root")}
            for place, leaf, changed_ in zip(own.column("place").to_pylist(), own.column("leaf").to_pylist(), own.column("changed").to_pylist(), strict=True):
                whole = block.siblings(place % FAN**height) + shared
                made["leaf"].append(leaf.hex())
                made["proof_sha256"].append(digest("".join(x + y for x, y in whole)))
                made["folded_root"].append(folded((changed_ or leaf).hex(), whole))
            n = len(own)
            yield pa.RecordBatch.from_arrays(
                [own.column("doc_id").combine_chunks(), pa.array(made["leaf"], pa.string()), pa.array([first["subroot"].hex()] * n, pa.string()), pa.array([root] * n, pa.string()),
                 pa.array(made["proof_sha256"], pa.string()), pa.array(made["folded_root"], pa.string()), pa.array([x == root for x in made["folded_root"]], pa.bool_())],
                names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    kind = leaves.schema["doc_id"].dataType.simpleString()
    blocks = tiers[0].drop("root").join(path, ["tree", "block"])
    rows = placed.drop("row").withColumn("block", F.expr(f"place div {FAN**height}"))
    both = blocks.unionByName(rows, allowMissingColumns=True).select("tree", "block", "place", "doc_id", "leaf", "changed", "leaves", "height", "nodes", "path", "subroot")
    dealt = both.repartition("tree", "block").sortWithinPartitions("tree", "block", F.col("place").asc_nulls_first())
    return map_arrow(dealt, run, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def oracle_sql(levels: int = 7, lang_levels: int = 2) -> str:
    """DuckDB SQL of merkle_manifest(documents), with at most 8^levels rows a lang and 8^lang_levels langs."""
    field = lambda x: f"coalesce(CAST(strlen(CAST({x} AS VARCHAR)) AS VARCHAR) || ':' || CAST({x} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    crc = ("xor(list_reduce(list_concat([4294967295], list_transform(range(1, len(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS BIGINT))), "
           "lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)")
    lower = f"translate(text, '{_LETTERS[0]}', '{_LETTERS[1]}')"
    parts = [f"""d AS (
  SELECT *, {leaf('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {leaf(lower)} END AS changed,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS place
  FROM documents)"""]
    parts.append("l0 AS (SELECT coalesce('=' || lang, '') AS tree, place, leaf AS h FROM d)")

    def level(k: int, prefix: str) -> None:
        """The nodes one level up, and what each node of this level finds beside it."""
        parts.append(f"{prefix}n{k} AS (SELECT tree, count(*) AS n FROM {prefix}{k} GROUP BY tree)")
        parts.append(f"""{prefix}{k + 1} AS (
  SELECT tree, place // 8 AS place, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY place)) END AS h
  FROM {prefix}{k} JOIN {prefix}n{k} USING (tree) GROUP BY tree, place // 8)""")
        parts.append(f"""{prefix}s{k} AS (
  SELECT a.tree, a.place, coalesce(string_agg(b.h, '' ORDER BY b.place) FILTER (WHERE b.place < a.place), '') AS lft,
    coalesce(string_agg(b.h, '' ORDER BY b.place) FILTER (WHERE b.place > a.place), '') AS rgt, any_value(n) = 1 AS alone
  FROM {prefix}{k} a JOIN {prefix}{k} b ON a.tree = b.tree AND a.place // 8 = b.place // 8 JOIN {prefix}n{k} m ON m.tree = a.tree
  GROUP BY a.tree, a.place)""")

    for k in range(levels):
        level(k, "l")
    parts.append(f"r0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS place, h, tree AS lang_tree FROM l{levels})")
    for k in range(lang_levels):
        level(k, "r")
    rows = "SELECT d.*, coalesce('=' || d.lang, '') AS tree, r0.place AS lang_place, r0.h AS subroot FROM d JOIN r0 ON r0.lang_tree = coalesce('=' || d.lang, '')"
    parts.append(f"f0 AS (SELECT *, coalesce(changed, leaf) AS fold, '' AS proof FROM ({rows}))")
    step = 0
    for prefix, n, key, place in (("l", levels, "f.tree", "f.place"), ("r", lang_levels, "''", "f.lang_place")):
        for k in range(n):
            parts.append(f"""f{step + 1} AS (
  SELECT f.* REPLACE (CASE WHEN alone THEN fold ELSE sha256(lft || fold || rgt) END AS fold, proof || lft || rgt AS proof)
  FROM f{step} f JOIN {prefix}s{k} s ON s.tree = {key} AND s.place = {place} // {8**k})""")
            step += 1
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = r.h AS verified
FROM f{step} JOIN r{lang_levels} r ON true
"""
