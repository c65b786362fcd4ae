"""Merkle manifest of a documents table, with proofs by multiproofs of leaf partitions.

Rows become leaves; leaves of one source, by id, make a tree, and the roots of these trees, by source, make the top tree. In every tree,
``ARITY`` consecutive nodes become one of the next level while more than one remains. Trees are built in chunks of
``ARITY ** CHUNK_LEVELS`` consecutive leaves, so a source of any size is spread, and its chunks' roots are the leaves of the next
round.

Proofs come from multiproofs. Chunks of leaves are dealt over partitions. A partition works out, level by level, which nodes of its leaves'
proofs it can derive from its own leaves, and which it lacks: the least set of coordinates (tree, level, place). These
are fetched once, by one join with the stored nodes; then the partition derives the shared inner nodes once and expands the proof
of each leaf. Only nodes at the top of chunks are stored: those below are always derived.
"""

from __future__ import annotations

import functools
import hashlib
import itertools

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from attnstrata.llm.common import map_batches, replaced, with_fields
from attnstrata.session import materialize, ship_package

ARITY = 3
#: Levels of a chunk: 2,187 leaves, 32 bytes each.
CHUNK_LEVELS = 7
#: Leaves that one partition proves, about.
PARTITION_LEAVES = 20_000
#: The columns of a leaf, in order; ``text`` is what tampering changes.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    """`-` for null, else the value's bytes in UTF-8: their number, a colon, and they."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def heights(leaves: int) -> list[int]:
    """Nodes of each level of a tree, from its leaves to its root."""
    sizes = [leaves]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // ARITY))
    return sizes


def run_of(place: int, size: int) -> range:
    """The places that become one node together with ``place``, in a level of ``size`` nodes."""
    begin = place // ARITY * ARITY
    return range(begin, min(begin + ARITY, size))


def climb(sizes: list[int], own: set[int], start: int = 0):
    """Per level: the places that are lacking to derive the parents of ``own``, which stand at level ``start``; and these places.

    Yields (level, places known, places lacking); what is yielded last is the root, with nothing lacking.
    """
    for level in range(start, len(sizes)):
        if sizes[level] == 1:
            yield level, own, []
            return
        lacking = sorted({p for place in own for p in run_of(place, sizes[level])} - own)
        yield level, own, lacking
        own = {place // ARITY for place in own}


def lacking(sizes: list[int], own: set[int], start: int = 0) -> list[tuple[int, int]]:
    """The least set of coordinates (level, place) that prove all leaves of ``own``, besides the leaves themselves."""
    return [(level, place) for level, _, places in climb(sizes, own, start) for place in places]


def derive(sizes: list[int], known: dict[int, str], fetched: dict[tuple[int, int], str], start: int = 0) -> list[dict[int, str]]:
    """Digests by level and place: the given ones of level ``start``, those fetched, and all that follow from them."""
    levels: list[dict[int, str]] = [{} for _ in range(start)]
    for level, own, places in climb(sizes, set(known), start):
        here = known | {place: fetched[level, place] for place in places}
        levels.append(here)
        if sizes[level] > 1:
            known = {
                place: digest(*(here[p] for p in run_of(place * ARITY, sizes[level])))
                for place in {place // ARITY for place in own}
            }
    return levels


def expand(sizes: list[int], levels: list[dict[int, str]], place: int) -> list[str]:
    """The proof of one leaf: the other nodes of its run, left to right, level by level."""
    proof = []
    for size, nodes in zip(sizes[:-1], levels, strict=False):
        proof += [nodes[p] for p in run_of(place, size) if p != place]
        place //= ARITY
    return proof


def fold(node: str, proof: list[str], *paths: tuple[int, int]) -> str:
    """The root that a leaf and its proof lead to; ``paths`` are (place, leaves) in its own tree and then in the trees above."""
    at = 0
    for place, leaves in paths:
        for size in heights(leaves)[:-1]:
            run = run_of(place, size)
            others = proof[at : at + len(run) - 1]
            at += len(others)
            node = digest(*others[: place - run.start], node, *others[place - run.start :])
            place //= ARITY
    return node


# trees in chunks

def _count_places(tree: str, place: str):
    """Rows ordered by tree get the number of their partition and their place among its rows of that tree."""

    def run(batches):
        last, at, part = object(), 0, TaskContext.get().partitionId()
        for batch in batches:
            places: list[int] = []
            for name, group in itertools.groupby(batch.column(batch.schema.get_field_index(tree)).to_pylist()):
                if name != last:
                    last, at = name, 0
                n = sum(1 for _ in group)
                places += range(at, at + n)
                at += n
            yield replaced(batch, tree_part=pa.array([part] * len(places), pa.int64()), **{place: pa.array(places, pa.int64())})

    return run


def _numbered(rows: DataFrame, tree: str, order: list[str], place: str, size: str) -> DataFrame:
    """``rows``, a written table, with their place in their tree by ``order``, and the tree's size.

    Rows are range partitioned, so a tree of any size is spread; one count a tree and partition links its parts.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = with_fields(rows, StructField("tree_part", LongType()), StructField(place, LongType()))
    dealt = rows.repartitionByRange(parts, tree, *order).sortWithinPartitions(tree, *order)
    counted = materialize(map_batches(dealt, _count_places(tree, place), schema), "places")
    counts = counted.groupBy(F.col(tree).alias("t"), F.col("tree_part").alias("p")).agg((F.max(place) + 1).alias("n"))
    each = Window.partitionBy("t")
    starts = counts.select(
        "t", "p", F.sum("n").over(each).alias(size),
        F.coalesce(F.sum("n").over(each.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    same = F.col("t").eqNullSafe(F.col(tree)) & (F.col("p") == F.col("tree_part"))
    return counted.join(starts, same).withColumn(place, F.col(place) + F.col("before")).drop("t", "p", "tree_part", "before")


def _columns(rows: pa.Table, *names: str):
    return zip(*(rows[n].to_pylist() for n in names), strict=True)


def _as_table(rows: list[tuple], **kinds) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.table({n: pa.array(c, t) for (n, t), c in zip(kinds.items(), columns, strict=True)})


def _grow(start: int, inner: bool, levels: int):
    """Chunks of nodes of level ``start`` to the nodes above them: those at their tops, and with ``inner`` those between."""

    def run(rows: pa.Table) -> pa.Table:
        chunks: dict[tuple, list] = {}
        for tree, size, place, node in _columns(rows, "tree", "size", "place", "node"):
            chunks.setdefault((tree, size, place // ARITY**levels), []).append((place, node))
        out = []
        for (tree, size, _), nodes in chunks.items():
            nodes.sort()
            root = len(heights(size)) - 1
            top = min(root, start + levels)
            if top == start:  # a tree of one leaf
                out += [(tree, size, top, p, x, True) for p, x in nodes]
            for level in range(start + 1, top + 1):
                nodes = [
                    (nodes[k][0] // ARITY, digest(*(x for _, x in nodes[k : k + ARITY]))) for k in range(0, len(nodes), ARITY)
                ]
                if inner or level == top:
                    out += [(tree, size, level, p, x, level == root) for p, x in nodes]
        return _as_table(out, tree=pa.string(), size=pa.int64(), level=pa.int32(), place=pa.int64(), node=pa.string(), is_root=pa.bool_())

    return run


def _chunk(levels: int) -> Column:
    return F.expr(f"place div {ARITY**levels}")


def _deal(total: int, levels: int, leaves: int) -> Column:
    """The partition of a chunk, by hash, for about ``leaves`` leaves each."""
    return F.pmod(F.xxhash64("tree", F.col("tree").isNull(), _chunk(levels)), F.lit(max(1, -(-total // leaves))))


def grow(leaves: DataFrame, inner: bool, levels: int, partition_leaves: int) -> DataFrame:
    """Nodes (tree, size, level, place, node, is_root) above the leaves (tree, size, place, node) of some trees.

    Nodes inside the first chunks are left out unless ``inner``. A tree of one leaf has that as its root. Each round takes
    ``levels`` levels, so rounds follow the logarithm of the largest tree.
    """
    nodes, rows, start = [], leaves, 0
    while True:
        made = materialize(
            rows.select("tree", "size", "place", "node", _deal(rows.count(), levels, partition_leaves).alias("deal")).groupBy("deal")
            .applyInArrow(_grow(start, inner or start > 0, levels), "tree string, size long, level int, place long, node string, is_root boolean"),
            "nodes",
        )
        nodes.append(made)
        start += levels
        rows = made.where((F.col("level") == start) & ~F.col("is_root"))
        if rows.limit(1).count() == 0:
            return functools.reduce(DataFrame.unionByName, nodes)


# multiproofs

def _lack(rows: pa.Table) -> pa.Table:
    """The coordinates that a partition of leaves lacks: of its sources' trees, and of the tree of sources (``upper``)."""
    deal = rows["deal"][0].as_py()
    own: dict[tuple, set[int]] = {}
    upper: set[int] = set()
    for tree, size, place, at in _columns(rows, "tree", "size", "place", "tree_place"):
        own.setdefault((tree, size), set()).add(place)
        upper.add(at)
    out = [(deal, False, tree, level, place) for (tree, size), places in own.items() for level, place in lacking(heights(size), places)]
    out += [(deal, True, None, level, place) for level, place in lacking(heights(rows["trees"][0].as_py()), upper)]
    return _as_table(out, deal=pa.int64(), upper=pa.bool_(), tree=pa.string(), level=pa.int32(), place=pa.int64())


def _prove(rows: pa.Table, fetched: pa.Table) -> pa.Table:
    """The leaves of a partition with subroot, root and proof, from the nodes fetched for it."""
    given: dict[tuple, dict[tuple[int, int], str]] = {}
    for upper, tree, level, place, node in _columns(fetched, "upper", "tree", "level", "place", "node"):
        given.setdefault((upper, tree), {})[level, place] = node
    own: dict[tuple, dict[int, str]] = {}
    for tree, size, place, at, node in _columns(rows, "tree", "size", "place", "tree_place", "leaf"):
        own.setdefault((tree, size, at), {})[place] = node
    trees = {}
    for (tree, size, at), leaves in own.items():
        sizes = heights(size)
        trees[at] = sizes, derive(sizes, leaves, given.get((False, tree), {}))
    subroots = {at: levels[-1][0] for at, (_, levels) in trees.items()}
    sizes = heights(rows["trees"][0].as_py())
    upper = derive(sizes, subroots, given.get((True, None), {}))
    above = {at: expand(sizes, upper, at) for at in trees}
    places, at = rows["place"].to_pylist(), rows["tree_place"].to_pylist()
    proofs = [expand(*trees[k], place) + above[k] for place, k in zip(places, at, strict=True)]
    out = rows.drop_columns(["deal"])
    out = out.append_column("subroot", pa.array([subroots[k] for k in at], pa.string()))
    out = out.append_column("root", pa.array([upper[-1][0]] * len(at), pa.string()))
    return out.append_column("proof", pa.array(proofs, pa.list_(pa.string())))


def prove(docs: DataFrame, levels: int = CHUNK_LEVELS, partition_leaves: int = PARTITION_LEAVES) -> DataFrame:
    """(doc_id, source, leaf, tampered_leaf, place, leaves, source_place, sources, subroot, root, proof) of every row.

    ``place`` of ``leaves`` is the leaf's place in its source, ``source_place`` of ``sources`` that of the source; with them
    ``fold(leaf, proof, (place, leaves), (source_place, sources))`` gives the root. ``tampered_leaf`` is the leaf of the same row
    whose text has lost its line feeds.

    Any column may be null and counts as ``-``; null sources are one source, before all others; null ids come before all
    others of their source. Rows of one id are ordered by their leaves; rows that repeat are leaves of their own. An empty table
    gives no rows. Columns that the table has besides those of a leaf are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    row = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
        F.col("n_chars").cast("long").alias("n_chars"), F.col("text").cast("string").alias("text"),
    )
    bare = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    whole = row.select(
        F.col("source").alias("tree"), "doc_id", leaf(*map(F.col, FIELDS)).alias("leaf"),
        leaf(*map(F.col, FIELDS[:-1]), bare).alias("tampered_leaf"), F.monotonically_increasing_id().alias("row"),
    )
    leaves = materialize(_numbered(materialize(whole, "rows"), "tree", ["doc_id", "leaf", "row"], "place", "size"), "leaves")
    nodes = grow(leaves.withColumnRenamed("leaf", "node"), False, levels, partition_leaves)
    subroots = materialize(nodes.where("is_root").select(F.lit(0).alias("all"), "tree", "size", "node"), "subroots")
    sources = _numbered(subroots.withColumnRenamed("size", "leaves"), "all", ["tree"], "place", "size")
    sources = materialize(sources.select("tree", "leaves", "place", "size", "node"), "sources")
    tops = sources.select(F.lit(None).cast("string").alias("tree"), "size", "place", "node")
    above = tops.withColumn("level", F.lit(0)).unionByName(grow(tops, True, levels, partition_leaves).drop("is_root").where("level > 0"))
    # a chunk of a source, not a source, is the key, so that no key has many rows
    chunks = sources.select(
        F.col("tree").alias("of"), F.col("place").alias("tree_place"), F.col("size").alias("trees"),
        F.explode(F.expr(f"sequence(0L, (leaves - 1) div {ARITY**levels})")).alias("chunk"),
    )
    same = F.col("of").eqNullSafe(F.col("tree")) & (F.col("chunk") == _chunk(levels))
    dealt = materialize(
        leaves.withColumn("deal", _deal(leaves.count(), levels, partition_leaves)).join(chunks, same).drop("of", "chunk", "row"), "dealt"
    )
    wanted = dealt.select("deal", "tree", "size", "place", "tree_place", "trees").groupBy("deal").applyInArrow(
        _lack, "deal long, upper boolean, tree string, level int, place long"
    )
    stored = nodes.withColumn("upper", F.lit(False)).drop("is_root").unionByName(above.withColumn("upper", F.lit(True)))
    at = F.struct("upper", "tree", "level", "place").alias("at")
    fetched = wanted.select("deal", at).join(stored.select(at, "node"), "at").select("deal", "at.*", "node")
    return (
        dealt.groupBy("deal").cogroup(fetched.groupBy("deal"))
        .applyInArrow(
            _prove,
            StructType([
                *(f for f in dealt.schema.fields if f.name != "deal"), StructField("subroot", StringType()),
                StructField("root", StringType()), StructField("proof", ArrayType(StringType())),
            ]),
        )
        .select(
            "doc_id", F.col("tree").alias("source"), "leaf", "tampered_leaf", "place", F.col("size").alias("leaves"),
            F.col("tree_place").alias("source_place"), F.col("trees").alias("sources"), "subroot", "root", "proof",
        )
    )


def _check(batches):
    for batch in batches:
        column = lambda n: batch.column(batch.schema.get_field_index(n)).to_pylist()  # noqa: B023, E731
        found = [
            fold(leaf_, proof, (place, leaves), (at, sources))
            for leaf_, proof, place, leaves, at, sources in zip(
                *map(column, ("given_leaf", "proof", "place", "leaves", "source_place", "sources")), strict=True
            )
        ]
        kept = [batch.column(batch.schema.get_field_index(n)) for n in ("doc_id", "leaf", "subroot", "root")]
        proofs = [digest(*proof) for proof in column("proof")]
        same = [a == b for a, b in zip(found, column("root"), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [*kept, pa.array(proofs, pa.string()), pa.array(found, pa.string()), pa.array(same, pa.bool_())],
            names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
        )


def op13(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row, odd rows as in ``prove``.

    Rows whose id's CRC-32 is even are checked with the tampered leaf; a null id is not tampered with.
    """
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    given = prove(docs).withColumn("given_leaf", F.when(tampered, F.col("tampered_leaf")).otherwise(F.col("leaf")))
    return map_batches(
        given, _check,
        "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
    )


#: SQL: whether the CRC-32 of an id's decimal digits is even, bit by bit (the register is inverted at the end).
_EVEN_CRC = """list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
        lambda c: list_transform(range(8), lambda k: (ascii(c)::BIGINT >> k::INTEGER) & 1)))),
        lambda crc, b: xor(crc >> 1, CASE WHEN xor(crc & 1, b) = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)) & 1 = 1"""


def _sql(leaf_levels: int, source_levels: int) -> str:
    """SQL of ``op13`` for sources of at most ``ARITY ** leaf_levels`` rows and ``ARITY ** source_levels`` sources."""
    fields = {n: f"coalesce(strlen(CAST({n} AS VARCHAR)) || ':' || CAST({n} AS VARCHAR), '-')" for n in FIELDS}
    bare = fields | {"text": fields["text"].replace("text", "replace(text, chr(10), '')")}
    steps = [
        f"""docs AS MATERIALIZED (
    SELECT row_number() OVER () AS row_id, doc_id, source, sha256({" || ".join(fields.values())}) AS leaf, sha256({" || ".join(bare.values())}) AS bare
    FROM documents)""",
        """t0 AS MATERIALIZED (
    SELECT row_id, source AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, row_id) - 1 AS place,
           count(*) OVER (PARTITION BY source) AS size, leaf AS node FROM docs)""",
        f"""p0 AS MATERIALIZED (
    SELECT docs.*, tree, place, '' AS proof, CASE WHEN {_EVEN_CRC} THEN bare ELSE leaf END AS folded FROM docs JOIN t0 USING (row_id))""",
    ]

    def levels(first: int, last: int) -> None:
        for k in range(first, last):
            steps.append(f"""r{k} AS MATERIALIZED (
    SELECT tree, place, size, coalesce(lag(node, 2) OVER w, '') || coalesce(lag(node) OVER w, '') AS before,
           coalesce(lead(node) OVER w, '') || coalesce(lead(node, 2) OVER w, '') AS behind
    FROM t{k} WINDOW w AS (PARTITION BY tree, place // {ARITY} ORDER BY place))""")
            steps.append(f"""t{k + 1} AS MATERIALIZED (
    SELECT tree, place // {ARITY} AS place, (any_value(size) + {ARITY - 1}) // {ARITY} AS size,
           CASE WHEN any_value(size) = 1 THEN any_value(node) ELSE sha256(string_agg(node, '' ORDER BY place)) END AS node
    FROM t{k} GROUP BY tree, t{k}.place // {ARITY})""")
            steps.append(f"""p{k + 1} AS MATERIALIZED (
    SELECT p.* REPLACE (p.place // {ARITY} AS place, proof || before || behind AS proof,
                        CASE WHEN size = 1 THEN folded ELSE sha256(before || folded || behind) END AS folded)
    FROM p{k} AS p JOIN r{k} AS r ON p.tree IS NOT DISTINCT FROM r.tree AND p.place = r.place)""")

    top = leaf_levels + 1
    levels(0, leaf_levels)
    steps.append(f"""t{top} AS MATERIALIZED (
    SELECT 'top' AS tree, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS place, count(*) OVER () AS size, node, tree AS source FROM t{leaf_levels})""")
    steps.append(f"""p{top} AS MATERIALIZED (
    SELECT p.* REPLACE ('top' AS tree, t.place AS place), node AS subroot FROM p{leaf_levels} AS p JOIN t{top} AS t ON p.tree IS NOT DISTINCT FROM t.source)""")
    levels(top, top + source_levels)
    return f"""WITH {", ".join(steps)}
SELECT doc_id, leaf, subroot, node AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = node AS verified
FROM p{top + source_levels}, t{top + source_levels}"""


#: For the check at a small size: 1,594,323 rows a source, 6,561 sources.
SQL = _sql(13, 8)
