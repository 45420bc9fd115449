"""Merkle manifest of a dataset, with octopus multiproofs.

Every row is a leaf. The leaves of a group (a language, say), in order, form a tree in which every eight consecutive nodes
have one parent; the roots of the groups, in order of the group, form a tree of the same kind, whose root stands for the
dataset. Nodes have coordinates (tree, level, place); ``tree`` is the place of the group, and ``TOP`` for the upper tree.

``build`` sorts by range, numbers rows in parallel and hashes block by block, 4096 nodes and four levels at a time, so a tree
of n leaves takes log(n) / log(4096) rounds, each a plain grouping; all nodes are stored as Parquet.

``prove`` takes any leaves. Those of one block are a partition of the multiproof: it works out which coordinates the
partition can't derive itself (the octopus' minimal union, siblings on any path that aren't above a leaf of its own),
fetches each of them once by a join, derives all interiors that the paths share, and expands the proof of every leaf from
them without further rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from webtally.llm.common import numbered, stored, table

#: Children of a node.
ARITY = 8
#: Levels that one round builds.
ROUND = 4
#: The tree over the groups' roots.
TOP = -1


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above the leaves of a tree of ``n`` leaves."""
    levels = 0
    while n > 1:
        n = -(-n // ARITY)
        levels += 1
    return levels


def leaf_digest(columns: list[Column]) -> Column:
    """sha256 of the values' lengths and bytes; ``-`` for a null, so null and empty differ and no two rows run together."""
    texts = [c.cast("string") for c in columns]
    parts = [F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


NODES = "tree long, level int, place long, n long, digest string"
NODE_SCHEMA = pa.schema([
    ("tree", pa.int64()), ("level", pa.int32()), ("place", pa.int64()), ("n", pa.int64()), ("digest", pa.string())])


def _parents(block: pa.Table, levels: int) -> Iterator[tuple[int, int, int, str]]:
    """All nodes (level, place, nodes of the level, digest) that a block of nodes of one level has above it: up to
    ``levels``, or the tree's root."""
    block = block.sort_by("place")
    level, first, n = (block.column(c)[0].as_py() for c in ("level", "place", "n"))
    row = block.column("digest").to_pylist()
    for _ in range(levels):
        if n == 1:
            return
        row = [digest(*row[i : i + ARITY]) for i in range(0, len(row), ARITY)]
        level, first, n = level + 1, first // ARITY, -(-n // ARITY)
        for k, own in enumerate(row):
            yield level, first + k, n, own


def grown(leaves: DataFrame, levels: int = ROUND) -> DataFrame:
    """All nodes of the trees whose leaves are ``leaves`` (``NODES``; ``n`` is the number of nodes of the level),
    the leaves included, stored. A round builds ``levels`` levels."""

    def block(key: tuple, rows: pa.Table) -> pa.Table:
        tree = key[0].as_py()
        return pa.Table.from_pylist(
            [dict(zip(NODE_SCHEMA.names, (tree, *node), strict=True)) for node in _parents(rows, levels)], NODE_SCHEMA)

    nodes = leaves
    largest = leaves.agg(F.max("n")).first()[0] or 0
    row, level = leaves, 0
    while largest > 1:
        own = F.expr(f"place div {ARITY**levels}")
        built = stored(
            row.where("n > 1").groupBy("tree", own.alias("block")).applyInArrow(block, NODES), f"nodes{level}")
        nodes = nodes.unionByName(built)
        level += levels
        row, largest = built.where(F.col("level") == level), -(-largest // ARITY**levels)
    return nodes


@dataclass
class Manifest:
    """``leaves``: the rows given, with tree, place and the number n of their tree's leaves. ``nodes``: all nodes of all
    trees. ``root``: of the dataset, None without rows. ``groups``: number of trees. ``levels``: of a block."""

    leaves: DataFrame
    nodes: DataFrame
    root: str | None
    groups: int
    levels: int


def build(df: DataFrame, group: str, order: str, leaf: str, levels: int = ROUND) -> Manifest:
    """Manifest of ``df``, whose column ``leaf`` has the leaves' digests; a tree for each ``group`` (null, which comes
    first, is one), its leaves ascending by ``order`` (nulls first), then by digest. Repeated rows are leaves of their own.
    Names that begin with an underscore and the names tree, place and n are reserved."""
    placed = stored(numbered(df, group, [order, leaf], "place").withColumnRenamed("place_n", "n"), "placed")
    groups = placed.groupBy(group).agg(F.max("n").alias("n")).withColumn("_all", F.lit(0))
    trees = stored(numbered(groups, "_all", [group], "tree").select(
        F.col(group).alias("_group"), "tree", F.col("tree_n").alias("_trees")), "trees")
    leaves = stored(
        placed.join(trees, F.col(group).eqNullSafe(F.col("_group"))).drop("_group", "_trees"), "leaves")
    count = trees.agg(F.max("_trees")).first()[0] or 0
    lower = grown(leaves.select(
        "tree", F.lit(0).alias("level"), "place", "n", F.col(leaf).alias("digest")), levels)
    # The root of a tree is the one node of its last level.
    tops = lower.where("n = 1").select(
        F.lit(TOP).cast("bigint").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("place"),
        F.lit(count).cast("bigint").alias("n"), "digest")
    nodes = lower.unionByName(grown(stored(tops, "subroots"), levels))
    root = nodes.where((F.col("tree") == TOP) & (F.col("n") == 1)).first()
    return Manifest(leaves, nodes, root["digest"] if root else None, count, levels)


def _missing(places: set[int], n: int) -> Iterator[tuple[int, int]]:
    """Coordinates (level, place) of the nodes that proofs of the leaves ``places`` of a tree of ``n`` leaves need and
    that can't be derived from those leaves."""
    level = 0
    while n > 1:
        runs = {p // ARITY for p in places}
        for run in runs:
            for p in range(ARITY * run, min(ARITY * run + ARITY, n)):
                if p not in places:
                    yield level, p
        places, level, n = runs, level + 1, -(-n // ARITY)


Runs = list[dict[int, list[str]]]


def _derive(known: dict[int, str], fetched: dict[tuple[int, int], str], n: int) -> tuple[Runs, str]:
    """For each level the runs of siblings above the known leaves, and the tree's root."""
    levels: Runs = []
    while n > 1:
        level = len(levels)
        runs, above = {}, {}
        for run in {p // ARITY for p in known}:
            places = range(ARITY * run, min(ARITY * run + ARITY, n))
            runs[run] = [known[p] if p in known else fetched[level, p] for p in places]
            above[run] = digest(*runs[run])
        levels.append(runs)
        known, n = above, -(-n // ARITY)
    return levels, next(iter(known.values()))


def siblings(levels: Runs, place: int) -> Iterator[tuple[list[str], list[str]]]:
    """The siblings of a leaf left and right of its path, level by level."""
    for runs in levels:
        run, at = divmod(place, ARITY)
        yield runs[run][:at], runs[run][at + 1 :]
        place = run


def fold(leaf: str, proof: list[tuple[list[str], list[str]]]) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in proof:
        leaf = digest(*left, leaf, *right)
    return leaf


def prove(manifest: Manifest, leaves: DataFrame) -> DataFrame:
    """Proofs of ``leaves`` (tree, place, n, leaf, claimed and further columns), any of the manifest's: the columns given
    and ``subroot``, ``proof`` (the siblings, level by level to the dataset's root, left to right), ``proof_sha256`` and
    ``folded_root``, which ``claimed`` (null: the leaf) and the proof give. A row given twice is proven twice; no rows give
    none; the names of the outputs, block, at_tree and at_block are reserved."""
    asked = leaves.withColumn("block", F.expr(f"place div {ARITY**manifest.levels}"))
    groups = manifest.groups

    def needed(key: tuple, rows: pa.Table) -> pa.Table:
        tree, own = (k.as_py() for k in key)
        lower = [(tree, *c) for c in _missing(set(rows.column("place").to_pylist()), rows.column("n")[0].as_py())]
        coordinates = lower + [(TOP, *c) for c in _missing({tree}, groups)]
        columns = list(zip(*coordinates, strict=True)) or [[], [], []]
        kinds = [pa.int64(), pa.int32(), pa.int64()]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        arrays += [pa.array([v] * len(coordinates), pa.int64()) for v in (tree, own)]
        return pa.Table.from_arrays(arrays, names=["tree", "level", "place", "at_tree", "at_block"])

    wanted = stored(asked.select("tree", "block", "place", "n").groupBy("tree", "block").applyInArrow(
        needed, "tree long, level int, place long, at_tree long, at_block long"), "wanted")
    levels = [r["level"] for r in wanted.select("level").distinct().collect()]  # at most the height of a tree
    there = manifest.nodes.where(F.col("level").isin(levels)).select("tree", "level", "place", "digest")
    fetched = wanted.join(there, ["tree", "level", "place"])
    names = leaves.columns
    kinds = leaves.schema.simpleString()[7:-1]

    def expand(key: tuple, own: pa.Table, nodes: pa.Table) -> pa.Table:
        tree = key[0].as_py()
        upper: dict[tuple[int, int], str] = {}
        lower: dict[tuple[int, int], str] = {}
        for t, level, place, node in zip(*(nodes.column(c).to_pylist() for c in ("tree", "level", "place", "digest")), strict=True):
            (upper if t == TOP else lower)[level, place] = node
        places, digests = own.column("place").to_pylist(), own.column("leaf").to_pylist()
        runs, subroot = _derive(dict(zip(places, digests, strict=True)), lower, own.column("n")[0].as_py())
        top = list(siblings(_derive({tree: subroot}, upper, groups)[0], tree))
        flats, sums, roots = [], [], []
        for place, leaf, claimed in zip(places, digests, own.column("claimed").to_pylist(), strict=True):
            proof = [*siblings(runs, place), *top]
            flats.append([d for left, right in proof for d in (*left, *right)])
            sums.append(digest(*flats[-1]))
            roots.append(fold(claimed or leaf, proof))
        added = [pa.array([subroot] * len(places), pa.string()), pa.array(flats, pa.list_(pa.string())), pa.array(sums), pa.array(roots)]
        return pa.Table.from_arrays([*(own.column(c) for c in names), *added], names=[*names, *ADDED])

    return asked.groupBy("tree", "block").cogroup(fetched.groupBy("at_tree", "at_block")).applyInArrow(
        expand, f"{kinds}, subroot string, proof array<string>, proof_sha256 string, folded_root string")


ADDED = ["subroot", "proof", "proof_sha256", "folded_root"]
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op11(spark, sf_dir: str) -> DataFrame:
    """Contract query: the manifest of all documents, every document's proof, and whether it holds for a copy of which
    one in three texts is tampered with.

    Texts are read once and hashed where they are read. Null values are leaves' parts like any other, a null doc_id comes
    first and isn't tampered with, equal documents are a leaf each. An empty table gives an empty table."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    changed = [F.translate("text", _UPPER, _LOWER) if c == "text" else F.col(c) for c in FIELDS]
    documents = stored(table(spark, sf_dir, "documents").select(
        "doc_id", F.col("lang"), leaf_digest([F.col(c) for c in FIELDS]).alias("leaf"),
        F.when(tampered, leaf_digest(changed)).alias("claimed")), "documents")
    manifest = build(documents, "lang", "doc_id", "leaf")
    root = F.lit(manifest.root).cast("string")
    return prove(manifest, manifest.leaves.drop("lang")).select(
        "doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root",
        (F.col("folded_root") == root).alias("verified"))


def _sql() -> str:
    """The same in SQL, level by level for trees of up to ``8 ** 7`` leaves and ``8 ** 4`` groups."""
    lower, upper = 7, 4

    def h(columns: list[str]) -> str:
        return "sha256(" + " || ".join(
            f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::varchar) || ':' || {c}::varchar END" for c in columns) + ")"

    def tree(name: str, source: str, levels: int) -> list[str]:
        steps = [f"{name}0 AS ({source})"]
        for k in range(levels):
            steps.append(
                f"{name}{k + 1} AS (SELECT tree, place // {ARITY} AS place, (max(n) + {ARITY - 1}) // {ARITY} AS n, "
                f"sha256(string_agg(digest, '' ORDER BY place)) AS digest FROM {name}{k} WHERE n > 1 GROUP BY tree, place // {ARITY})")
        return steps

    def path(name: str, levels: int, key: str, place: str) -> tuple[str, str]:
        """The joins that bring in the siblings of a row's path, and their text."""
        joins, flat = [], []
        for k in range(levels):
            alias = f"{name}_{k}"
            joins.append(
                f"LEFT JOIN {name}run{k} {alias} ON {alias}.tree = {key} AND {alias}.run = {place} // {ARITY ** (k + 1)}")
            at = f"{place} // {ARITY ** k} % {ARITY}"
            flat.append(f"coalesce(array_to_string(list_concat({alias}.row[1:{at}], {alias}.row[{at} + 2:]), ''), '')")
        return " ".join(joins), " || ".join(flat)

    steps = [
        "leaves AS (SELECT doc_id, lang, " + h(FIELDS) + " AS leaf, "
        "list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(range(1, 1 + length(doc_id::varchar)), "
        "lambda i: list_concat([ascii(substr(doc_id::varchar, i, 1))::bigint], [-1, -1, -1, -1, -1, -1, -1, -1]::bigint[])))), "
        "lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END) AS crc, "
        + h([*FIELDS[:-1], f"translate(text, '{_UPPER}', '{_LOWER}')"]) + " AS lowered FROM documents)",
        "langs AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, count(*) OVER () AS trees FROM (SELECT DISTINCT lang FROM documents))",
        "placed AS (SELECT l.*, g.tree, g.trees, row_number() OVER (PARTITION BY g.tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, "
        "count(*) OVER (PARTITION BY g.tree) AS n FROM leaves l JOIN langs g ON l.lang IS NOT DISTINCT FROM g.lang)",
        *tree("a", "SELECT tree, place, n, leaf AS digest FROM placed", lower),
        "subroots AS (" + " UNION ALL ".join(f"SELECT tree, digest FROM a{k} WHERE n = 1" for k in range(lower + 1)) + ")",
        *tree("b", "SELECT -1 AS tree, tree AS place, count(*) OVER () AS n, digest FROM subroots", upper),
        "root AS (" + " UNION ALL ".join(f"SELECT digest FROM b{k} WHERE n = 1" for k in range(upper + 1)) + ")",
    ]
    for name, levels in (("a", lower), ("b", upper)):
        steps += [
            f"{name}run{k} AS (SELECT tree, place // {ARITY} AS run, list(digest ORDER BY place) AS row FROM {name}{k} WHERE n > 1 GROUP BY ALL)"
            for k in range(levels)]
    a_joins, a_flat = path("a", lower, "p.tree", "p.place")
    b_joins, b_flat = path("b", upper, "-1", "p.tree")
    steps.append(
        "f0 AS (SELECT p.*, CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN lowered ELSE leaf END AS cur, "
        f"sha256({a_flat} || {b_flat}) AS proof_sha256 FROM placed p {a_joins} {b_joins})")
    last = 0
    for name, levels, key, place in (("a", lower, "f.tree", "f.place"), ("b", upper, "-1", "f.tree")):
        for k in range(levels):
            at = f"{place} // {ARITY ** k} % {ARITY}"
            steps.append(
                f"f{last + 1} AS (SELECT f.* REPLACE (CASE WHEN r.row IS NULL THEN cur ELSE sha256(array_to_string("
                f"list_concat(r.row[1:{at}], list_concat([cur], r.row[{at} + 2:])), '')) END AS cur) FROM f{last} f "
                f"LEFT JOIN {name}run{k} r ON r.tree = {key} AND r.run = {place} // {ARITY ** (k + 1)})")
            last += 1
    return (
        "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, leaf, s.digest AS subroot, r.digest AS root, proof_sha256, "
        f"cur AS folded_root, cur = r.digest AS verified FROM f{last} f JOIN subroots s ON s.tree = f.tree CROSS JOIN root r")


OP11_SQL = _sql()
