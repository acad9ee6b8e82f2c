"""Merkle manifest of a dataset: a hash tree per source and one over the sources, with an inclusion proof per row.

A level of a tree is built by a slot pivot: the children of a parent, ``fanout`` consecutive nodes at most, are spread into
one column per slot by conditional aggregates. Concatenating the columns and hashing gives the parent; leaving out
one's own slot column gives the siblings of a child. Proofs go down the written levels again, from the root to the leaves.
A parent never has more than ``fanout`` rows, so a source of any size is spread over all tasks on every level.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acctpulse.llm.positions import numbered
from acctpulse.session import staged

FANOUT = 3
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts one after another; nulls count as empty."""
    return F.sha2(F.concat_ws("", *parts), 256)


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(**fields: Column) -> Column:
    """Hash of a row: each field as its number of UTF-8 bytes, ``:`` and its value, or ``-`` for null."""
    return digest(*(_field(fields[name]) for name in FIELDS))


def _grow(nodes: DataFrame, fanout: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The levels of all trees, lowest first, and ``(tree, height, hash, own)`` of their roots.

    ``nodes`` are the lowest nodes: ``tree``, ``position``, ``size`` (nodes of the tree), ``hash`` and ``own``, a struct that
    goes with a node. A level is a row per parent with a struct ``(hash, own)`` for each slot.
    """
    levels, roots = [], []
    largest = nodes.agg(F.max("size")).first()[0] or 0
    for height in count():
        roots.append(nodes.filter("size = 1").select("tree", F.lit(height).alias("height"), "hash", "own"))
        if largest <= 1:
            return levels, reduce(DataFrame.unionByName, roots)
        slot = F.pmod("position", F.lit(fanout))
        child = F.struct("hash", "own")
        pivot = nodes.filter("size > 1").groupBy(
            "tree", F.floor(F.col("position") / fanout).alias("parent"), F.ceil(F.col("size") / fanout).alias("size")
        ).agg(*(F.max(F.when(slot == k, child)).alias(f"slot{k}") for k in range(fanout)))
        levels.append(staged(pivot, f"{name}_{height}"))
        hashes = [F.col(f"slot{k}.hash") for k in range(fanout)]
        nodes = levels[-1].select(
            "tree", F.col("parent").alias("position"), "size", digest(*hashes).alias("hash"),
            F.lit(None).cast(nodes.schema["own"].dataType).alias("own"),
        )
        largest = -(-largest // fanout)


def _descend(levels: list[DataFrame], roots: DataFrame, fanout: int) -> DataFrame:
    """``(hash, own, path, above)`` of the lowest nodes.

    ``roots`` has ``tree, height, hash, own`` and what every node below inherits: ``path``, the siblings from a root
    upwards, and ``above``. A path lists, from a node's own run upwards, what stands left and right of it, joined.
    """
    kept = ["hash", "own", "path", "above"]
    here = roots.filter(F.col("height") == len(levels)).select("tree", F.lit(0).cast("bigint").alias("position"), *kept)
    for height in range(len(levels) - 1, -1, -1):
        hashes = [F.col(f"slot{k}.hash") for k in range(fanout)]
        children = F.array(*(
            F.when(hashes[k].isNotNull(), F.struct(
                F.lit(k).alias("slot"), hashes[k].alias("hash"), F.col(f"slot{k}.own").alias("own"),
                F.struct(F.concat_ws("", *hashes[:k]).alias("left"), F.concat_ws("", *hashes[k + 1 :]).alias("right")).alias("beside"),
            ))
            for k in range(fanout)
        ))
        parents = here.select("tree", F.col("position").alias("parent"), "path", "above")
        spread = levels[height].join(parents, ["tree", "parent"]).select(
            "tree", "parent", "path", "above", F.inline(F.array_compact(children))
        )
        here = spread.select(
            "tree", (F.col("parent") * fanout + F.col("slot")).alias("position"), "hash", "own",
            F.concat(F.array("beside"), "path").alias("path"), "above",
        ).unionByName(  # trees that end here
            roots.filter(F.col("height") == height).select("tree", F.lit(0).cast("bigint").alias("position"), *kept)
        )
    return here.select(*kept)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path lead to."""
    return F.aggregate(path, leaf, lambda node, beside: digest(beside["left"], node, beside["right"]))


def manifest(docs: DataFrame, claimed: Column, fanout: int = FANOUT) -> DataFrame:
    """``doc_id, leaf, subroot, root, path, claimed``, one row per row of ``docs``.

    ``leaf`` is the hash of a row, ``subroot`` that of its source's tree, ``root`` that of the tree over the subroots; ``path``
    holds what stands left and right of the node in each run from the leaf up to the root. ``claimed``, an expression over
    ``docs``, is a text to be proved against the manifest: its leaf hash is handed on.

    Leaves ascend by ``doc_id`` within a source, a null id first, equal ids by their hash; a null source is a source of its
    own and comes first. Null and empty texts differ in their leaves. Repeated rows are leaves of their own. No rows give
    no rows. Other columns, whatever their names, are not read.
    """
    fields = {name: F.col(f"`{name}`") for name in FIELDS}
    tree = F.coalesce(F.concat(F.lit("="), fields["source"]), F.lit(""))
    leaves = docs.select(
        tree.alias("tree"), fields["doc_id"].cast("bigint").alias("doc_id"), leaf_hash(**fields).alias("hash"),
        leaf_hash(**fields | {"text": claimed}).alias("claimed"),
    )
    placed = numbered(leaves, [F.col("doc_id").asc_nulls_first(), F.col("hash"), F.col("claimed")], "tree")
    # One row per source.
    sizes = placed.groupBy("tree").agg(F.count("*").alias("size"))
    lowest = staged(placed.join(sizes, "tree").select("tree", "position", "size", "hash", F.struct("doc_id", "claimed").alias("own")), "leaves")
    levels, subroots = _grow(lowest, fanout, "level")
    subroots = staged(subroots, "subroots")
    # "" stands before every "=name", and Spark orders strings by their UTF-8 bytes.
    ordered = numbered(subroots.select("tree", "hash"), [F.col("tree")])
    sources = staged(ordered.select(
        F.lit("").alias("tree"), "position", F.lit(ordered.count()).cast("bigint").alias("size"), "hash", F.struct("tree").alias("own")
    ), "sources")
    upper, top = _grow(sources, fanout, "upper")
    start = top.select("tree", "height", "hash", "own", F.array().cast(_PATH).alias("path"), F.struct(F.col("hash").alias("root")).alias("above"))
    inherited = _descend(upper, start, fanout).select(F.col("own.tree").alias("tree"), "path", F.col("above.root").alias("root"))
    below = subroots.join(staged(inherited, "paths"), "tree").select(
        "tree", "height", "hash", "own", "path", F.struct(F.col("hash").alias("subroot"), "root").alias("above")
    )
    return _descend(levels, below, fanout).select(
        "own.doc_id", F.col("hash").alias("leaf"), "above.subroot", "above.root", "path", "own.claimed"
    )


def tampered(docs: DataFrame) -> Column:
    """The text as a tampered copy holds it: where the CRC32 of the decimal id is even, its line ends are deleted.

    A row without an id is not tampered with.
    """
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.replace(docs["text"], F.lit("\n"), F.lit(""))).otherwise(docs["text"])


def verify(proofs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of a manifest."""
    siblings = F.array_join(F.transform("path", lambda beside: F.concat(beside["left"], beside["right"])), "")
    checked = proofs.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"),
        folded(F.col("claimed"), F.col("path")).alias("folded_root"),
    )
    return checked.withColumn("verified", F.col("folded_root") == F.col("root"))


def _tree_sql(name: str, nodes: str) -> str:
    """Levels of the trees of ``nodes (tree, position, hash)`` and, per lowest node, the path's parts."""
    return f"""
{name}_grown AS (
    SELECT tree, 0 AS height, position, hash, count(*) OVER (PARTITION BY tree) AS size FROM {nodes}
    UNION ALL
    SELECT tree, height + 1, position // 3, sha256(string_agg(hash, '' ORDER BY position)), any_value((size + 2) // 3)
    FROM {name}_grown WHERE size > 1 GROUP BY tree, height, position // 3
), {name}_roots AS (
    SELECT tree, hash FROM {name}_grown WHERE size = 1
), {name}_beside AS (
    SELECT n.tree, n.position AS node, o.height,
        coalesce(string_agg(o.hash, '' ORDER BY o.position) FILTER (o.position < n.position // (3 ** o.height)::BIGINT), '') AS left_part,
        coalesce(string_agg(o.hash, '' ORDER BY o.position) FILTER (o.position > n.position // (3 ** o.height)::BIGINT), '') AS right_part
    FROM {nodes} n JOIN {name}_grown o ON n.tree = o.tree AND o.size > 1
        AND o.position // 3 = n.position // (3 ** (o.height + 1))::BIGINT
    GROUP BY n.tree, n.position, o.height
), {name}_paths AS (
    SELECT tree, node, list({{'l': left_part, 'r': right_part}} ORDER BY height) AS path FROM {name}_beside GROUP BY tree, node
)"""


_EVEN = """(list_reduce([4294967295::UBIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::UBIGINT),
            lambda c, b: list_reduce([xor(c, b)] || [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0],
                lambda x, i: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))) + 1) % 2 = 0"""


def _leaf_sql(text: str) -> str:
    plain = {"doc_id": "doc_id::VARCHAR", "source": "source", "lang": "lang", "n_chars": "n_chars::VARCHAR", "text": text}
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({v})) || ':' || {v}, '-')" for v in plain.values()) + ")"


SQL = f"""
WITH RECURSIVE tampered AS (
    SELECT *, CASE WHEN {_EVEN} THEN replace(text, chr(10), '') ELSE text END AS claimed_text FROM documents
), hashed AS (
    SELECT coalesce('=' || source, '') AS tree, doc_id, {_leaf_sql("text")} AS hash, {_leaf_sql("claimed_text")} AS claimed
    FROM tampered
), leaves AS (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, hash, claimed) - 1 AS position FROM hashed
), {_tree_sql("low", "leaves")}, tops AS (
    SELECT '' AS tree, tree AS own, hash, row_number() OVER (ORDER BY encode(tree)) - 1 AS position FROM low_roots
), {_tree_sql("top", "tops")}, proofs AS (
    SELECT l.doc_id, l.hash AS leaf, l.claimed, t.hash AS subroot, (SELECT hash FROM top_roots) AS root,
        coalesce(p.path, []) || coalesce(q.path, []) AS path
    FROM leaves l JOIN tops t ON l.tree = t.own
        LEFT JOIN low_paths p ON p.tree = l.tree AND p.node = l.position
        LEFT JOIN top_paths q ON q.node = t.position
), folded AS (
    SELECT *, list_reduce([{{'l': claimed, 'r': ''}}] || path, lambda a, b: {{'l': sha256(b.l || a.l || b.r), 'r': ''}}).l AS folded_root
    FROM proofs
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda p: p.l || p.r), '')) AS proof_sha256,
    folded_root, folded_root = root AS verified
FROM folded
"""
