"""N-gram Jaccard self-join by a token-group matrix.

Documents become sets of shingle hashes; equal sets are one node. Nodes are partitioned into groups of
similar sets: by the first token they have in a common order of all tokens, and in it by the links that a first comparison
within bounded tasks finds. The matrix holds, for each group, the union of its sets' leading tokens. A query set counts
the entries that it shares with each group; only a group whose count reaches the least overlap that
any of its sets could need is a candidate. Candidates are opened in tasks of bounded size: there the query is held against
the whole union of a part of the group, and only if that bound qualifies the part's sets are compared, exactly.

Why no link is lost: two sets of sizes n <= m link only if they share at least
``ceil(t (n + m) / (100 + t))`` tokens. In any common order of tokens, two sets that share ``a`` tokens
share ``k`` of them within their first ``size - a + k``. The smaller set enters its first tokens into the matrix, the larger
one asks with its own, both for the least ``a`` possible; so the query shares ``k`` entries with the
group of its partner. The order may be any; tokens found repeatedly in many places come last in it, which keeps common
lines and passages out of the matrix.

Why large groups of near copies do not square: what the first comparison connects never asks its own group. The first set of each
group, and unlinked sets, ask first; then the others ask only groups that are not yet in their component. In both passes groups meet on tokens before
their sets do, and sets ask only where their whole group shares enough tokens with another. Components are sought among groups, not among their sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attnstrata.llm.common import checked_broadcast, free_name, freed, map_batches, pieces, string_column
from attnstrata.llm.components import components
from attnstrata.llm.wordhash import distinct_sets, mix
from attnstrata.session import materialize

#: Shared leading tokens that a candidate needs.
MATCHES = 8
#: Sets of a group's part on average, and queries opened against it in one task.
GROUP_SETS, TASK_QUERIES = 512, 2048
#: Tokens of these, where sets are large: 16 MB on either side. A set of more is alone.
TASK_TOKENS = 2 << 20
#: Tokens that are ordered by their count, last; others by hash. Any number gives the same result.
COMMON_TOKENS = 1 << 17
#: Times that a token must occur in one piece of texts to be counted there for that order. Tokens of one set in so many are counted wherever
#: they occur, as so many each: a token that is frequent only over all pieces is found too, however small the pieces are.
PIECE_COUNT, COUNTED_SETS = 4, 32
#: Tokens that two lots share, of which each asker is held against all.
LOT_TOKENS = 1 << 12
#: Ids (16 bytes a row) that may be broadcast to pick the documents of candidates.
PICK_ROWS = 1_000_000


def least_overlap(n, m, percent: int):
    """Tokens that sets of n and m tokens share at least if they link."""
    return (percent * (n + m) + 99 + percent) // (100 + percent)


def least_size(n, percent: int):
    """Tokens of the smallest set that can link with one of n; also their overlap."""
    return (percent * n + 99) // 100


def _signature(tokens: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return tuple(int(mix(tokens ^ np.uint64(s)).sum(dtype=np.uint64).astype(np.int64)) for s in (0x51, 0x7A3))


def _describe(width: int):
    """Rows (doc_id, n, s, s2) for documents, and (token, times) for repeated tokens."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                sets = distinct_sets(string_column(piece, "text"), width)
                marks = [_signature(x) if len(x) else (0, 0) for x in sets]
                found, times = np.unique(np.concatenate(sets), return_counts=True)
                drawn = [x for x, m in zip(sets, marks, strict=True) if m[0] % COUNTED_SETS == 0]
                drawn, drawn_times = np.unique(np.concatenate([*drawn, found[:0]]), return_counts=True)
                estimate = np.zeros_like(times)
                estimate[np.searchsorted(found, drawn)] = COUNTED_SETS * drawn_times
                times = np.where(times >= PIECE_COUNT, times, estimate)
                often = times > 0
                ids = piece.column(piece.schema.get_field_index("doc_id"))
                k = int(often.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([ids.cast(pa.int64()), pa.nulls(k, pa.int64())]),
                        pa.concat_arrays([pa.array([len(x) for x in sets], pa.int64()), pa.nulls(k, pa.int64())]),
                        pa.array([m[0] for m in marks] + [0] * k, pa.int64()),
                        pa.array([m[1] for m in marks] + [0] * k, pa.int64()),
                        pa.concat_arrays([pa.nulls(len(sets), pa.int64()), pa.array(found[often].astype(np.int64))]),
                        pa.concat_arrays([pa.nulls(len(sets), pa.int64()), pa.array(times[often].astype(np.int64))]),
                    ],
                    names=["doc_id", "n", "s", "s2", "token", "times"],
                )

    return run


def _ordered(tokens: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Tokens in the common order: by hash, those in ``common`` (sorted values; ranks) last."""
    if not len(common[0]):
        return tokens
    at = np.minimum(np.searchsorted(common[0], tokens), len(common[0]) - 1)
    rank = np.where(common[0][at] == tokens, common[1][at] + 1, 0)
    return tokens[np.lexsort((tokens, rank))]


def _prefixes(width: int, percent: int, common):
    """Rows (doc_id, s, n, first, probe, entry): leading tokens to ask with; the first ``entry`` are entered."""

    def run(batches):
        known = common.value
        for batch in batches:
            for piece in pieces(batch, "text"):
                sets = distinct_sets(string_column(piece, "text"), width)
                ids = piece.column(piece.schema.get_field_index("doc_id")).to_pylist()
                rows = []
                for doc, tokens in zip(ids, sets, strict=True):
                    n = len(tokens)
                    if n:
                        need, same = least_size(n, percent), least_overlap(n, n, percent)
                        k = min(MATCHES, need)
                        lead = _ordered(tokens, known)[: n - need + k].astype(np.int64)
                        rows.append((doc, _signature(tokens)[0], n, int(tokens[0].astype(np.int64)), lead, min(n, n - same + MATCHES)))
                columns = list(zip(*rows, strict=True)) or [()] * 6
                kinds = [pa.int64()] * 4 + [pa.list_(pa.int64()), pa.int32()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    names=["doc_id", "s", "n", "first", "probe", "entry"],
                )

    return run


def _tokens(width: int):
    """Rows (doc_id, s, n, tokens as bytes)."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                sets = distinct_sets(string_column(piece, "text"), width)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(piece.schema.get_field_index("doc_id")).cast(pa.int64()),
                        pa.array([_signature(x)[0] if len(x) else 0 for x in sets], pa.int64()),
                        pa.array([len(x) for x in sets], pa.int64()),
                        pa.array([x.tobytes() for x in sets], pa.binary()),
                    ],
                    names=["doc_id", "s", "n", "tokens"],
                )

    return run


def _tasks(sets: int) -> Column:
    """Tasks for the rows of a group, each of so many sets and ``TASK_TOKENS`` on average."""
    return F.greatest(F.ceil(F.count("*") / sets), F.ceil(F.sum("n") / TASK_TOKENS))


def _tree():
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    def join(x: int, y: int) -> bool:
        x, y = root(x), root(y)
        parent[max(x, y)] = min(x, y)
        return x != y

    return root, join


def _cluster(percent: int):
    """Rows (s, lot) of the sets of one task that link with others; a lot is named by its pivot or its least set."""

    def run(rows: pa.Table) -> pa.Table:
        names = rows["s"].to_pylist()
        tokens = [np.frombuffer(x, dtype=np.uint64) for x in rows["tokens"].to_pylist()]
        sizes = np.array([len(x) for x in tokens], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        union, at = np.unique(np.concatenate(tokens), return_inverse=True)
        root, join = _tree()
        linked = set()
        for i in range(1, len(names)):
            fits = (sizes[:i] >= least_size(sizes[i], percent)) & (least_size(sizes[:i], percent) <= sizes[i])
            if not fits.any():
                continue
            mask = np.zeros(len(union), dtype=bool)
            mask[at[starts[i] : starts[i] + sizes[i]]] = True
            shared = np.add.reduceat(mask[at[: starts[i]]], starts[:i], dtype=np.int64)
            for k in np.flatnonzero(fits & (100 * shared >= percent * (sizes[:i] + sizes[i] - shared))):
                join(names[i], names[k])
                linked.update((names[i], names[k]))
        name = {root(s): s for s, pivot in zip(names, rows["pivot"].to_pylist(), strict=True) if pivot}
        linked = sorted(linked)
        return pa.table({
            "s": pa.array(linked, pa.int64()), "lot": pa.array([name.get(root(s), root(s)) for s in linked], pa.int64()),
        })

    return run


def _open(percent: int):
    """Links between the queries and the sets of one part, enough to connect what links."""

    def run(rows: pa.Table) -> pa.Table:
        asks = rows["asks"].to_pylist()
        names = rows["s"].to_pylist()
        tokens = [np.frombuffer(x, dtype=np.uint64) for x in rows["tokens"].to_pylist()]
        members = [i for i, ask in enumerate(asks) if not ask]
        links: list[tuple[int, int]] = []
        if members and len(members) < len(asks):
            sizes = np.array([len(tokens[i]) for i in members], dtype=np.int64)
            owners = np.array([names[i] for i in members], dtype=np.int64)
            together = np.concatenate([tokens[i] for i in members])
            union = np.unique(together)
            at = np.searchsorted(union, together)
            starts = np.cumsum(sizes) - sizes
            _, join = _tree()
            for i in (i for i, ask in enumerate(asks) if ask):
                n = len(tokens[i])
                fits = (sizes <= n) & (sizes >= least_size(n, percent)) & (owners != names[i])
                if not fits.any():
                    continue
                place = np.minimum(np.searchsorted(union, tokens[i]), len(union) - 1)
                place = place[union[place] == tokens[i]]
                if len(place) < least_overlap(n, int(sizes[fits].min()), percent):
                    continue  # even the union shares too little
                mask = np.zeros(len(union), dtype=bool)
                mask[place] = True
                shared = np.add.reduceat(mask[at], starts, dtype=np.int64)
                for k in np.flatnonzero(fits & (100 * shared >= percent * (n + sizes - shared))):
                    if join(names[i], int(owners[k])):
                        links.append((names[i], int(owners[k])))
        return pa.table({
            "a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64()),
        })

    return run


def _sent(docs: DataFrame, targets: DataFrame, width: int, repeated: bool) -> DataFrame:
    """``targets`` (doc_id, s, ...) with the tokens of these sets, made from the documents' texts."""
    ids = targets.select("doc_id").distinct()
    tokens = map_batches(
        docs.join(checked_broadcast(ids, PICK_ROWS), "doc_id", "left_semi"), _tokens(width),
        "doc_id long, s long, n long, tokens binary",
    ).where("n > 0")
    if repeated:
        tokens = tokens.dropDuplicates(["doc_id", "s"])
    return tokens.drop("n").join(checked_broadcast(targets, PICK_ROWS), ["doc_id", "s"])


def _compare(docs: DataFrame, targets: DataFrame, width: int, percent: int, repeated: bool) -> DataFrame:
    """Links (a, b) found where ``targets`` (doc_id, s, asks, lot, part, chunk) send the documents' sets."""
    rows = _sent(docs, materialize(targets, "targets"), width, repeated)
    found = rows.select("lot", "part", "chunk", "asks", "s", "tokens").groupBy("lot", "part", "chunk").applyInArrow(
        freed(_open(percent)), "a long, b long"
    )
    return materialize(found.distinct(), "edges")


def _lots(docs: DataFrame, leads: DataFrame, width: int, percent: int, repeated: bool) -> DataFrame:
    """(s, lot) of the sets that a first comparison of those beginning with one token connects.

    Up to ``TASK_QUERIES`` sets of ``TASK_TOKENS`` tokens are compared with each other in one task; more are dealt over several, and
    the first set of all, the pivot, goes to each of them.
    """
    sets = leads.select("first", "doc_id", "s", "n")
    pivots = (
        sets.groupBy("first").agg(F.min("s").alias("least"), F.count("*").alias("rows"), _tasks(TASK_QUERIES).alias("chunks"))
        .where("rows > 1").select("first", "least", "chunks")
    )
    sets = sets.join(checked_broadcast(pivots, PICK_ROWS), "first")
    pivot = F.col("s") == F.col("least")
    chunk = F.when(pivot, F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).otherwise(
        F.array(F.pmod(F.xxhash64("s"), "chunks"))
    )
    targets = materialize(sets.select("doc_id", "s", "first", pivot.alias("pivot"), F.explode(chunk).alias("chunk")), "targets")
    rows = _sent(docs, targets, width, repeated).select("first", "chunk", "pivot", "s", "tokens")
    found = rows.groupBy("first", "chunk").applyInArrow(freed(_cluster(percent)), "s long, lot long")
    return materialize(found.distinct(), "lots")


def _targets(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Where the sets of ``pairs`` (doc_id, s, n, lot) and those of the groups they ask meet."""
    zero = F.lit(0).cast("long")
    asked = pairs.groupBy("lot").agg(_tasks(TASK_QUERIES).alias("chunks"))
    members = groups.select("doc_id", "s", "n", "lot").join(asked, "lot")
    parts = members.groupBy("lot").agg(_tasks(GROUP_SETS).alias("parts"), F.first("chunks").alias("chunks"))
    members = members.drop("n")
    to_parts = pairs.join(parts, "lot").select(
        "doc_id", "s", F.lit(True).alias("asks"), "lot", F.explode(F.sequence(zero, F.col("parts") - 1)).alias("part"),
        F.pmod(F.xxhash64("s"), "chunks").alias("chunk"),
    )
    to_chunks = members.drop("chunks").join(parts, "lot").select(
        "doc_id", "s", F.lit(False).alias("asks"), "lot", F.pmod(F.xxhash64("s", F.lit(1)), "parts").alias("part"),
        F.explode(F.sequence(zero, F.col("chunks") - 1)).alias("chunk"),
    )
    return to_parts.unionByName(to_chunks)


def links(docs: DataFrame, width: int = 3, percent: int = 90) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sets of all documents, and links between different sets.

    Returns ``sets`` (doc_id, n, s: the set's name, equal for equal sets), ``lots`` (s, lot: sets that links connect) and
    ``edges`` (a, b: names of sets with ``100 * shared >= percent * union``). Sets that link directly or over
    others are connected by lots and edges; a pair that is connected already is not listed again. Null or empty
    texts have no set (n = 0).
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = materialize(
        map_batches(docs, _describe(width), "doc_id long, n long, s long, s2 long, token long, times long"), "sets"
    )
    sets = seen.where("token is null").select("doc_id", "n", "s", "s2")
    counts = (
        seen.where("token is not null").groupBy("token").agg(F.sum("times").alias("times"))
        .orderBy(F.desc("times"), "token").limit(COMMON_TOKENS).toArrow()
    )
    values = counts["token"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(values)
    rank = len(values) - np.arange(len(values))
    common = spark.sparkContext.broadcast((values[order], rank[order]))

    rows = sets.where("n > 0").groupBy("s", "s2", "n", "doc_id").agg(F.count("*").alias("rows"))
    nodes = materialize(
        rows.groupBy("s", "s2", "n").agg(F.min(F.struct("doc_id", "rows")).alias("least"))
        .select("s", "least.doc_id", "least.rows"),
        "nodes",
    )
    repeated = nodes.where("rows > 1").limit(1).count() > 0
    leads = map_batches(
        docs, _prefixes(width, percent, common),
        "doc_id long, s long, n long, first long, probe array<long>, entry int",
    ).join(checked_broadcast(nodes.select("doc_id", "s"), PICK_ROWS), ["doc_id", "s"], "left_semi")
    if repeated:
        leads = leads.dropDuplicates(["doc_id", "s"])
    leads = materialize(leads, "leads")
    lots = _lots(docs, leads, width, percent, repeated)
    large = leads.groupBy("first").agg(_tasks(TASK_QUERIES).alias("tasks"), _tasks(GROUP_SETS).alias("rows")).where("tasks > 1")
    part = F.coalesce(F.pmod(F.xxhash64("s"), F.col("rows")), F.lit(0))
    groups = (
        leads.join(checked_broadcast(lots.withColumnRenamed("lot", "linked"), PICK_ROWS), "s", "left")
        .join(checked_broadcast(large.drop("tasks"), PICK_ROWS), "first", "left")
        .withColumn("lot", F.coalesce("linked", F.xxhash64("first", part)))
        # sets of one task were all compared; of more, only those of one lot need not meet again
        .withColumn("done", F.when(F.col("rows").isNull(), F.col("first")).otherwise(F.col("lot")))
        .withColumn("own", F.when(F.col("rows").isNull() | F.col("linked").isNotNull(), F.col("done")).otherwise(F.bitwise_not("done")))
        .withColumn("speaks", F.col("linked").isNull() | (F.col("linked") == F.col("s")))
    )
    # the first set of each lot, and unlinked sets, ask for all
    pairs = _candidates_of_lots(groups.where("speaks"), groups, percent)
    first = _compare(docs, _targets(pairs, groups), width, percent, repeated)
    if lots.isEmpty():
        return sets.select("doc_id", "n", "s"), lots, first
    # lots that this has connected are one; the other sets ask only outside of theirs
    roots = materialize(components(_among_lots(first, lots)), "roots")
    merged = (
        groups.withColumn("node", F.coalesce("linked", "s")).join(checked_broadcast(roots, PICK_ROWS), "node", "left")
        .withColumn("lot", F.coalesce("root", "linked", "lot"))
        .withColumn("own", F.col("lot")).withColumn("done", F.col("lot"))
    )
    pairs = _candidates_of_lots(merged.where("not speaks"), merged, percent)
    second = _compare(docs, _targets(pairs, merged), width, percent, repeated)
    return sets.select("doc_id", "n", "s"), lots, first.unionByName(second)


def _candidates(askers: DataFrame, groups: DataFrame, elsewhere, percent: int) -> DataFrame:
    """(s, doc_id, lot): groups whose matrix columns share enough leading tokens with an asking set.

    The plain form, a row for a token, asking set and group: where many sets share a token it grows with the square of their number.
    Tests hold ``_candidates_of_lots`` against it.
    """
    matrix = (
        groups.select("lot", "done", "n", F.explode(F.slice("probe", F.lit(1), F.col("entry"))).alias("token"))
        .groupBy("token", "lot", "done")
        .agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count("*").alias("owners"))
    )
    asks = askers.select("s", "n", "own", "entry", F.posexplode("probe").alias("at", "token"))
    need = F.expr(f"({percent} * n + 99) div 100")
    pairs = (
        asks.join(matrix, "token")
        .where((F.col("low") <= F.col("n")) & (F.col("high") >= need) & elsewhere)
        .groupBy("s", "lot")
        .agg(F.count("*").alias("hits"), F.max("n").alias("n"))
        .where(F.col("hits") >= F.least(F.lit(MATCHES), need))
    )
    return materialize(pairs.select("s", "lot").join(askers.select("s", "doc_id", "n"), "s"), "candidates")


def _candidates_of_lots(askers: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(s, doc_id, n, lot): lots that are not ``done`` with an asking set's ``own`` and whose columns share enough leading tokens with it.

    Sets of one group share most of their tokens, so groups meet first: a token counts once for all askers of one ``own``. Two groups that
    share fewer tokens than their smallest asker needs hold no link; an asker is held against what the others share, in one row a lot.
    A lot whose ``done`` is the complement of ``own`` is asked by its own sets, which all ask: a token with one owner and one asker
    there is the asker's own.
    """
    matrix = (
        groups.select("lot", "done", "n", F.explode(F.slice("probe", F.lit(1), F.col("entry"))).alias("token"))
        .groupBy("token", "lot", "done").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count("*").alias("owners"))
    )
    asked = (
        askers.select("own", "n", F.explode("probe").alias("token"))
        .groupBy("token", "own").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("askers"))
    )
    need = F.expr(f"({percent} * n + 99) div 100")
    least_need = F.expr(f"({percent} * least + 99) div 100")
    itself = (F.col("own") == F.bitwise_not("done")) & (F.col("owners") == 1) & (F.col("askers") == 1)
    shared = (
        asked.join(matrix, "token")
        .where((F.col("own") != F.col("done")) & (F.col("low") <= F.col("most")) & (F.col("high") >= least_need) & ~itself)
        .groupBy("own", "lot")
        .agg(
            F.count("*").alias("hits"), F.min("least").alias("least"), F.min("low").alias("low"), F.max("high").alias("high"),
            F.collect_list("token").alias("tokens"),
        )
        .where(F.col("hits") >= F.least(F.lit(MATCHES), least_need))
        # of more, every asker of a fitting size is a candidate
        .withColumn("tokens", F.when(F.col("hits") <= LOT_TOKENS, F.col("tokens")))
    )
    enough = F.size(F.array_intersect("probe", "tokens")) >= F.least(F.lit(MATCHES), need)
    pairs = (
        askers.select("s", "doc_id", "n", "own", "probe")
        .join(checked_broadcast(materialize(shared, "shared").drop("hits", "least"), PICK_ROWS), "own")
        .where((F.col("low") <= F.col("n")) & (F.col("high") >= need) & (F.col("tokens").isNull() | enough))
    ).select("s", "doc_id", "n", "lot")
    return materialize(pairs, "candidates")


def _among_lots(edges: DataFrame, lots: DataFrame) -> DataFrame:
    """Edges (a, b) between sets as edges between their lots; an unlinked set is a lot of its own."""
    for end in ("a", "b"):
        named = lots.select(F.col("s").alias(end), F.col("lot").alias("of"))
        edges = edges.join(named, end, "left").withColumn(end, F.coalesce("of", end)).drop("of")
    return edges.where("a <> b").distinct()


def jaccard_components(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    ``component_id`` is the smallest id that is reachable by links. Rows of one id are one document with
    several texts: they share its component. A null, empty or blank text has no shingles and links with
    nothing. A row with a null id counts for nothing else: its component is null. An empty table gives no rows.
    """
    sets, lots, edges = links(docs, width, percent)
    named = sets.where("n > 0 and doc_id is not null")
    # an id with several different sets ties them together
    several = (
        named.groupBy("doc_id").agg(F.min("s").alias("a"), F.max("s").alias("top"))
        .where("a <> top").select("doc_id", "a")
    )
    ties = named.join(several, "doc_id").select("a", F.col("s").alias("b"))
    roots = components(_among_lots(edges.unionByName(ties), lots))
    least = named.groupBy("s").agg(F.min("doc_id").alias("doc_id")).join(lots, "s", "left")
    least = least.withColumn("node", F.coalesce("lot", "s")).join(roots, "node", "left")
    least = least.select("s", "doc_id", F.coalesce("root", "node").alias("root"))
    lowest = least.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    labels = least.join(lowest, "root").select("s", "component_id")
    return (
        sets.withColumn("s", F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("s")))
        .join(labels, "s", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    )


def keep_one(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """One document of each component, the one of the smallest id, with all columns.

    Rows without an id are kept, and so is a document without shingles. An id that has several rows keeps
    one of them, the first by text.
    """
    found = materialize(jaccard_components(docs, width, percent).where("doc_id is not null"), "components")
    drop = found.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(checked_broadcast(drop, PICK_ROWS), "doc_id", "left_anti").select(*docs.columns)
    twice = found.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if twice.limit(1).count() == 0:
        return kept
    single = kept.join(twice, "doc_id", "left_anti").select(*docs.columns)
    order = free_name(docs, "text_order")
    again = kept.join(twice, "doc_id", "left_semi").select(*docs.columns)
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last()))
    return single.unionByName(again.withColumn(order, rank).where(F.col(order) == 1).drop(order))
