"""Event assembly: documents with placed evidence, distractors, grading.

The fact catalogue is a dimension and events are the large side. The catalogue is
cut into blocks of a fixed number of facts, each held as one array, and every event
row picks from a block by itself: choosing distractors emits no event-fact pairs
and needs no shuffle while the catalogue fits one block. A larger catalogue takes
several blocks; events then pick per block and the short pick lists are merged. Both ways
give the same rows: before the split equal rows are counted and each distinct row gets a key
of its own, so events that share an id stay apart and repeated rows come back as often.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, LongType, StringType, StructField, StructType

from attnstrata.functions import bins, ids, text
from attnstrata.functions import fixed_values as fixed
from attnstrata.operators.positions import hash_segment, with_position
from attnstrata.session import broadcast_if_small, materialize, ship_package

BLOCK_FACTS = 10_000
BROADCAST_BLOCKS = 32
#: Bytes of finished documents that one partition is meant to hold.
PARTITION_BYTES = 64 << 20
#: Rows and bytes of token lists that are broadcast.
LIST_ROWS, LIST_BYTES = 2_000_000, 64 << 20
#: A token with one such part of all rows is frequent; so many tokens can be, at most.
TOKEN_SHARE = 1_000
#: Listed candidates, and counters of pairs, that a worker holds at once; a question may need more by itself.
MEETINGS = 1 << 20
#: Questions of a table that may be spread anew, and of a task then.
SPREAD_ROWS, TASK_ROWS = 50_000, 20_000


def _known(form: Column, template: Column) -> Column:
    """The form, or an error that names the template the catalogue lacks."""
    missing = F.concat(F.lit("unknown template: "), F.coalesce(template.cast("string"), F.lit("NULL")))
    return F.coalesce(form, F.raise_error(missing))


def fact_sentences(templates: DataFrame, facts: DataFrame) -> DataFrame:
    """Every catalogue fact with its statement, word count and content tokens.

    A fact of a template that ``templates`` lacks is an error.
    """
    form = _known(F.col("statement_form"), F.col("template_id"))
    statement = text.fill_template(form, F.col("subject"), F.col("object"))
    return (
        facts.join(broadcast_if_small(templates), "template_id", "left")
        .select("fact_id", "template_id", "subject", "object", statement.alias("statement"))
        .withColumn("n_words", text.count_word_tokens(F.col("statement")))
        .withColumn("tokens", text.content_tokens(F.col("statement")))
    )


def _blocks(sentences: DataFrame, block_facts: int) -> tuple[DataFrame, int, int]:
    """The catalogue's blocks, their number, and the bytes of all statements."""
    size = sentences.agg(F.count(F.lit(1)), F.sum(F.octet_length("statement"))).first()
    n_blocks = max(1, math.ceil(size[0] / block_facts))
    fact = F.struct(
        "fact_id", "template_id", "subject", "object", "statement", "n_words", "tokens"
    )
    block = F.pmod(F.xxhash64("fact_id"), F.lit(n_blocks)).cast("int")
    pools = sentences.groupBy(block.alias("block")).agg(
        F.array_sort(F.collect_list(fact)).alias("pool")
    )
    return pools, n_blocks, size[1] or 0


def _spread(events: DataFrame, key: str, row_bytes: int) -> DataFrame:
    """Spread rows before each grows into a document of many sentences.

    A split of short plan rows would otherwise become one task with gigabytes of text. The
    number of partitions follows the bytes to come; all cores have work at least.
    """
    partitions = math.ceil(events.count() * max(1, row_bytes) / PARTITION_BYTES)
    return events.repartition(max(partitions, events.sparkSession.sparkContext.defaultParallelism), key)


def _keyed(events: DataFrame, n_blocks: int) -> DataFrame:
    """Distinct rows with ``_row``, a key of the whole row, and ``_copies``, how often it came.

    With one block no rows are merged later, so they stay as they are.
    """
    if n_blocks == 1:
        return events
    whole = F.to_json(F.struct(*events.columns), {"ignoreNullFields": "false"})
    return (
        events.groupBy(*events.columns).agg(F.count(F.lit(1)).alias("_copies"))
        .withColumn("_row", F.sha2(whole, 256))
    )


def _with_pool(events: DataFrame, pools: DataFrame, n_blocks: int) -> DataFrame:
    """Events with the fact array of each block. A catalogue of few blocks is broadcast;
    beyond that, blocks are copied over salts so that no block is one task.
    """
    if n_blocks == 1:
        return events.withColumn("pool", pools.select("pool").scalar())
    blocks = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    if n_blocks <= BROADCAST_BLOCKS:
        return events.withColumn("block", blocks).join(F.broadcast(pools), "block").drop("block")
    salts = events.sparkSession.sparkContext.defaultParallelism
    salted = events.withColumn("salt", F.pmod(F.xxhash64("_row"), F.lit(salts)).cast("int"))
    copies = pools.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return (
        salted.withColumn("block", blocks).join(copies, ["block", "salt"]).drop("block", "salt")
    )


def _merge_picks(df: DataFrame, n_blocks: int, picks: str, size: Column) -> DataFrame:
    """The rows that went into ``_keyed`` again, each with the smallest ``size`` picks over all its blocks."""
    if n_blocks == 1:
        return df
    others = [c for c in df.columns if c not in ("_row", picks)]
    merged = (
        df.groupBy("_row")
        .agg(
            *[F.any_value(c).alias(c) for c in others],
            F.sort_array(F.flatten(F.collect_list(picks))).alias(picks),
        )
        .withColumn(picks, F.slice(F.col(picks), F.lit(1), size))
    )
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))
    return merged.withColumn("_copy", again).drop("_copy", "_copies", "_row")


def other_template_facts(templates: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts usable as off-topic distractors, once per template they are foreign to.

    Each fact expands over the few template names, so no join is needed.
    """
    names = broadcast_if_small(templates).agg(
        F.array_sort(F.collect_set("template_id")).alias("names")
    )
    return facts.withColumn("all_templates", names.scalar()).select(
        F.explode(
            F.filter("all_templates", lambda t: t != F.col("template_id"))
        ).alias("for_template"),
        "fact_id",
        "template_id",
    )


def sibling_facts(events: DataFrame, facts: DataFrame) -> DataFrame:
    """Number of facts with the event's template, another subject and another object.

    Counted from per-subject, per-object and per-pair totals instead of pairing
    every event with every fact of its template.
    """
    def total(*by):
        return facts.groupBy("template_id", *by).agg(
            F.count(F.lit(1)).alias("n_" + ("_".join(by) or "all"))
        )

    return (
        events.join(total(), "template_id", "left")
        .join(total("subject"), ["template_id", "subject"], "left")
        .join(total("object"), ["template_id", "object"], "left")
        .join(total("subject", "object"), ["template_id", "subject", "object"], "left")
        .withColumn(
            "n_siblings",
            F.coalesce("n_all", F.lit(0))
            - F.coalesce("n_subject", F.lit(0))
            - F.coalesce("n_object", F.lit(0))
            + F.coalesce("n_subject_object", F.lit(0)),
        )
        .drop("n_all", "n_subject", "n_object", "n_subject_object")
    )


def first_fact(events: DataFrame, facts: DataFrame) -> DataFrame:
    """The event's fact, found by its answer: the first one in catalogue order.

    An answer that no fact of the template has stands for its own subject.
    """
    first = facts.groupBy(
        F.col("template_id").alias("question_template_id"),
        F.col("object").alias("gold_answer"),
    ).agg(F.min_by("subject", "fact_id").alias("fact_subject"))
    return events.join(first, ["question_template_id", "gold_answer"], "left").withColumn(
        "fact_subject", F.coalesce("fact_subject", "gold_answer")
    )


def lexical_pairs(
    questions: DataFrame,
    candidates: DataFrame,
    *,
    question_id: str,
    candidate_id: str,
    text_col: str = "text",
    at_least: int = fixed.MIN_SHARED_TOKENS,
) -> DataFrame:
    """(question, candidate, n_shared): pairs sharing enough distinct content tokens. An id names one row.

    Meets on tokens, never on all pairs. Candidates are listed under their rarer tokens only: of
    ``at_least`` shared tokens one is always outside a candidate's ``at_least - 1`` most common ones,
    so a token that every text has lists nobody. Those common ones are looked up for pairs that met.

    Lists of checked rows and bytes are broadcast, and each question meets them in the task that reads it. Longer
    lists are joined by a shuffle, where lists and questions of common tokens are spread over parts.
    """
    asked = _evened(questions.select(F.col(question_id).alias("_q"), F.col(text_col).alias("_text")), "_q", "_text")
    asked = asked.select("_q", text.content_tokens(F.col("_text")).alias("_tokens"))
    lists = materialize(_token_lists(candidates, candidate_id, text_col, at_least), "token-lists")
    size = lists.agg(F.count(F.lit(1)), F.sum(F.octet_length("token") + F.length(F.to_json("_common")))).first()
    if size[0] <= LIST_ROWS and (size[1] or 0) <= LIST_BYTES:
        counted = _shared_by_lists(asked, lists, at_least)
    else:
        counted = _shared_by_shuffle(asked.select("_q", F.explode("_tokens").alias("token")), lists)
    return counted.filter(F.col("n_shared") >= at_least).select(
        F.col("_q").alias(question_id), F.col("_c").alias(candidate_id), "n_shared"
    )


def _evened(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows, spread anew if one task has more than twice its share of them: Spark does not split a file of one row group."""
    held = [r["n"] for r in rows.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if sum(held) < SPREAD_ROWS or max(held) * cores <= 2 * sum(held):
        return rows
    return rows.repartition(max(cores, math.ceil(sum(held) / TASK_ROWS)), *keys)


def _frequent(rows: DataFrame, name: str) -> DataFrame:
    """(token_hash, ``name``) of tokens with at least one ``TOKEN_SHARE``th of all rows, so at most that
    many: how many times that share they hold.
    """
    uses = rows.groupBy(F.xxhash64("token").alias("token_hash")).agg(F.count(F.lit(1)).alias("uses"))
    least = max(1, math.ceil(rows.count() / TOKEN_SHARE))
    return uses.where(F.col("uses") >= least).select(
        "token_hash", F.ceil(F.col("uses") / F.lit(least)).cast("int").alias(name)
    )


def _token_lists(candidates: DataFrame, candidate_id: str, text_col: str, at_least: int) -> DataFrame:
    """(token, _c, _common): each candidate under all its tokens but the ``at_least - 1`` most frequent, which
    are ``_common``. Frequencies below a share that few tokens reach count alike; any order that all candidates
    share is right.
    """
    tokens = candidates.select(F.col(candidate_id).alias("_c"), text.content_tokens(F.col(text_col)).alias("tokens"))
    rows = tokens.where(F.size("tokens") >= at_least).select("_c", F.explode("tokens").alias("token"))
    ranked = (
        rows.withColumn("token_hash", F.xxhash64("token"))
        .join(F.broadcast(_frequent(rows, "uses")), "token_hash", "left")
        .groupBy("_c")
        .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("uses", F.lit(0)).alias("uses"), "token"))).alias("ranked"))
        .select("_c", F.transform("ranked", lambda x: x["token"]).alias("ranked"), (F.size("ranked") - at_least + 1).alias("n"))
    )
    rare = F.slice("ranked", F.lit(1), F.col("n"))
    common = F.slice("ranked", F.col("n") + 1, F.lit(at_least - 1))
    return ranked.select(F.explode(rare).alias("token"), "_c", common.alias("_common"))


def _packed_lists(lists: DataFrame) -> dict:
    """The lists as arrays: ``candidates`` by number; ``vocabulary``, the numbers of tokens; candidates of token t at
    ``starts[t]:starts[t + 1]`` of ``listed``; ``commons``, the numbers that ``common_of`` gives to each candidate's common
    tokens, filled up with -1.
    """
    rows = lists.groupBy("_c").agg(F.collect_list("token").alias("rare"), F.any_value("_common").alias("common")).toArrow()
    (rare, listed), (common, holder) = (
        (x.flatten(), pc.list_parent_indices(x).to_numpy()) for x in (rows[c].combine_chunks() for c in ("rare", "common"))
    )
    vocabulary = pa.concat_arrays([rare, common]).unique()
    token = pc.index_in(rare, value_set=vocabulary).to_numpy()
    names, name = np.unique(pc.index_in(common, value_set=vocabulary).to_numpy(), return_inverse=True)
    common_of = np.full(len(vocabulary), -1, np.int32)
    common_of[names] = np.arange(len(names))
    holder, name = np.unique(np.stack([holder, name]), axis=1)
    slot = np.arange(len(holder)) - np.searchsorted(holder, holder)
    commons = np.full((len(rows), slot.max(initial=-1) + 1), -1, np.int32)
    commons[holder, slot] = name
    return {
        "candidates": rows["_c"].combine_chunks(), "vocabulary": vocabulary, "listed": listed[np.argsort(token, kind="stable")],
        "starts": np.concatenate([[0], np.cumsum(np.bincount(token, minlength=len(vocabulary)))]),
        "common_of": common_of, "names": len(names), "commons": commons,
    }


def _meetings(shared, at_least: int):
    """Arrow function of (_q, _tokens): (_q, _c, n, n_common) for each row and each candidate listed under ``n`` of its tokens, which
    also has ``n_common`` of the candidate's common ones; pairs of fewer than ``at_least`` in all are left out.
    """
    most = MEETINGS

    def met(lo, hi, row, token, lists):
        n_candidates = len(lists["candidates"])
        size = lists["starts"][token + 1] - lists["starts"][token]
        at = np.arange(size.sum()) + np.repeat(lists["starts"][token] - np.cumsum(size) + size, size)
        pair = np.repeat((row - lo) * n_candidates, size) + lists["listed"][at]
        if 8 * len(pair) < (hi - lo) * n_candidates:
            pair, n = np.unique(pair, return_counts=True)
        else:
            counters = np.bincount(pair)
            pair = np.flatnonzero(counters)
            n = counters[pair]
        question, candidate = np.divmod(pair, n_candidates)
        held = np.zeros((hi - lo, lists["names"] + 1), bool)
        held[row - lo, lists["common_of"][token]] = True
        held[:, -1] = False
        n_common = held[question[:, None], lists["commons"][candidate]].sum(axis=1)
        kept = n + n_common >= at_least
        return question[kept] + lo, candidate[kept], n[kept], n_common[kept]

    def run(batches):
        lists = shared.value
        rows_at_once = max(1, most // max(1, len(lists["candidates"]), lists["names"]))
        for batch in batches:
            tokens = batch.column(1)
            token = pc.fill_null(pc.index_in(tokens.flatten(), value_set=lists["vocabulary"]), -1).to_numpy()
            row = pc.list_parent_indices(tokens).to_numpy()
            row, token = row[token >= 0], token[token >= 0]
            listed = np.bincount(row, lists["starts"][token + 1] - lists["starts"][token], batch.num_rows)
            before = np.concatenate([[0], np.cumsum(listed)])
            lo = 0
            while lo < batch.num_rows:
                hi = min(np.searchsorted(before, before[lo] + most, "right") - 1, lo + rows_at_once, batch.num_rows)
                hi = max(hi, lo + 1)
                first, last = np.searchsorted(row, [lo, hi])
                question, candidate, n, n_common = met(lo, hi, row[first:last], token[first:last], lists)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(question)), lists["candidates"].take(pa.array(candidate)),
                     pa.array(n, pa.int64()), pa.array(n_common, pa.int64())],
                    names=["_q", "_c", "n", "n_common"],
                )
                lo = hi

    return run


def _shared_by_lists(asked: DataFrame, lists: DataFrame, at_least: int) -> DataFrame:
    """(_q, _c, n_shared) with the lists broadcast: all of a question's pairs are counted where it is read, and nothing is shuffled.

    Only rows that share a question's id are counted apart and then summed; their common tokens count once.
    """
    spark = asked.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(_packed_lists(lists))
    schema = StructType([
        StructField("_q", asked.schema["_q"].dataType), StructField("_c", lists.schema["_c"].dataType),
        StructField("n", LongType()), StructField("n_common", LongType()),
    ])
    again = asked.groupBy("_q").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.col("_q").alias("_again"))
    again = materialize(again, "repeated-questions")
    shared_by = F.col("n") + F.col("n_common")
    if again.isEmpty():
        return asked.mapInArrow(_meetings(shared, at_least), schema).select("_q", "_c", shared_by.alias("n_shared"))
    again, same = broadcast_if_small(again), F.col("_q").eqNullSafe(F.col("_again"))
    once = asked.join(again, same, "left_anti").mapInArrow(_meetings(shared, at_least), schema)
    summed = (
        asked.join(again, same, "left_semi").mapInArrow(_meetings(shared, 0), schema)
        .groupBy("_q", "_c").agg(F.sum("n").alias("n"), F.max("n_common").alias("n_common"))
    )
    return once.unionByName(summed).select("_q", "_c", shared_by.alias("n_shared"))


def _shared_by_shuffle(asked: DataFrame, lists: DataFrame) -> DataFrame:
    """(_q, _c, n_shared) with both sides shuffled by token; a frequent token's rows are spread over as many parts
    as it holds shares, and meet the other side's parts in a grid.
    """
    asked = materialize(asked, "question-tokens")
    grid = _frequent(asked, "q_parts").join(_frequent(lists, "c_parts"), "token_hash", "full").select(
        "token_hash", F.coalesce("q_parts", F.lit(1)).alias("q_parts"), F.coalesce("c_parts", F.lit(1)).alias("c_parts")
    )

    def spread(rows, key, own, other):
        parts = {c: F.coalesce(f"{c}_parts", F.lit(1)) for c in (own, other)}
        return (
            rows.withColumn("token_hash", F.xxhash64("token"))
            .join(F.broadcast(grid), "token_hash", "left")
            .withColumn(f"{own}_part", F.pmod(F.xxhash64(key), parts[own]).cast("int"))
            .withColumn(f"{other}_part", F.explode(F.sequence(F.lit(0), parts[other] - 1)))
            .drop("token_hash", "q_parts", "c_parts")
        )

    met = (
        spread(asked, "_q", "q", "c")
        .join(spread(lists, "_c", "c", "q"), ["token", "q_part", "c_part"])
        .groupBy("_q", "_c")
        .agg(F.count(F.lit(1)).alias("n"), F.any_value("_common").alias("_common"))
    )
    met = materialize(met, "met-pairs")
    common = (
        met.select("_q", "_c", F.explode("_common").alias("token")).join(asked, ["_q", "token"])
        .groupBy("_q", "_c").agg(F.count(F.lit(1)).alias("n_common"))
    )
    return met.join(common, ["_q", "_c"], "left").select(
        "_q", "_c", (F.col("n") + F.coalesce("n_common", F.lit(0))).alias("n_shared")
    )


def lexical_distractors(
    questions: DataFrame,
    candidates: DataFrame,
    *,
    question_id: str,
    candidate_id: str,
    text_col: str = "text",
    at_least: int = fixed.MIN_SHARED_TOKENS,
    n: int = fixed.N_ADVERSARIAL,
    seed: str = "adversarial",
) -> DataFrame:
    """The first ``n`` candidates of each question, in seeded order, among those that ``lexical_pairs`` finds."""
    pairs = lexical_pairs(
        questions, candidates, question_id=question_id, candidate_id=candidate_id, text_col=text_col, at_least=at_least
    )
    return take_distractors(pairs, keys=[question_id], candidate=candidate_id, n=n, seed=seed)


def _first_of_batches(keys: list[str], n: int):
    """Arrow function: of each batch, the rows that may be among the first ``n`` of their group, which are those up to the ``n``-th
    value of ``_first``, eight digits of the ordering hash. Pairs of a large group never meet in a sort of all.
    """

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            group = np.zeros(batch.num_rows, np.int64)
            for k in keys:
                values = batch.column(k).dictionary_encode()
                group = np.unique(group * len(values.dictionary) + values.indices.to_numpy(), return_inverse=True)[1]
            digits = batch.column("_first")
            order = np.frombuffer(digits.buffers()[2], ">u8", batch.num_rows, 8 * digits.offset).astype(np.uint64)
            by = np.lexsort((order, group))
            start = np.searchsorted(group[by], group[by])
            nth = order[by][np.minimum(start + n - 1, len(by) - 1)]
            kept = (np.arange(len(by)) < start + n) | (order[by] == nth)
            yield batch.take(pa.array(np.sort(by[kept])))

    return run


def take_distractors(
    pairs: DataFrame, *, keys: list[str], candidate: str, n: int, seed: str = "distractor"
) -> DataFrame:
    """The first ``n`` candidates of each group in seeded order, and their ``position``; pairs are read once. A null key is no group.

    Each batch of rows, and then each task, drops all but its own first ``n`` rows of a group before rows are sorted and shuffled.
    Where Spark does not do so for so large an ``n``, groups are cut into segments, for which the pairs are stored.
    """
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in [*keys, candidate]])
    order, by = ["_order", candidate], ids.order_key(seed, key)
    if n > int(pairs.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        ordered = materialize(pairs, "pairs").withColumn("_order", by)
        return with_position(ordered, keys, order, segment=hash_segment("_order"), limit=n).drop("_order")
    for k in keys:
        pairs = pairs.where(F.col(k).isNotNull())
    cut = pairs
    if all(isinstance(f.dataType, AtomicType) for f in pairs.schema):
        schema = StructType([*pairs.schema, StructField("_first", StringType())])
        cut = pairs.withColumn("_first", F.substring(by, 1, 8)).mapInArrow(_first_of_batches(list(keys), n), schema).drop("_first")
    first = (
        cut.withColumn("_order", by)
        .withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        .where(F.col("_rank") <= n)
    )
    others = [c for c in pairs.columns if c not in keys]
    return first.select(*keys, *others, "_rank").withColumn("position", F.col("_rank").cast("bigint") - 1).drop("_rank")


def assemble_documents(
    plan: DataFrame,
    templates: DataFrame,
    facts: DataFrame,
    *,
    template_sha: str = ids.PROMPT_TEMPLATE_SHA256,
    block_facts: int = BLOCK_FACTS,
) -> DataFrame:
    """Events from a plan of (plan_id, template_id, subject, object, target_words,
    distractor_density): evidence after roughly ``target_words`` words of off-topic
    sentences, the remaining sentences behind it in seeded order.

    ``evidence_distance_tokens`` is measured on the finished text (words from the
    evidence to the end of the prompt) and ``bin_id`` follows from it; the planned
    target stays in ``target_words`` and ``target_reached`` says whether the
    catalogue had enough words to get there.
    """
    sentences = materialize(fact_sentences(templates, facts), "sentences")
    pools, n_blocks, pool_bytes = _blocks(sentences, block_facts)
    per_template = sentences.groupBy("template_id").agg(F.count(F.lit(1)).alias("_own"))
    n_all = sentences.agg(F.count(F.lit(1)).alias("n")).scalar()
    # made once a row, before rows are spread, and not for every fact
    seeds = {f"_{s}": F.concat(F.lit(f"{s}:"), F.col("plan_id").cast("string"), F.lit(":")) for s in ("distractor", "tail")}

    def pick(x):
        return F.struct(
            F.sha2(F.concat("_distractor", x["fact_id"].cast("string")), 256).alias("h"),
            x["fact_id"].alias("fact_id"),
            x["statement"].alias("statement"),
            x["n_words"].alias("n_words"),
        )

    base = (
        _keyed(plan, n_blocks).join(broadcast_if_small(templates), "template_id", "left")
        .withColumn("statement_form", _known(F.col("statement_form"), F.col("template_id")))
        .join(broadcast_if_small(per_template), "template_id", "left")
        .withColumn(
            "_n",
            F.greatest(
                F.lit(1),
                F.floor(
                    F.col("distractor_density") * (n_all - F.coalesce("_own", F.lit(0)))
                ).cast("int"),
            ),
        )
        .withColumns(seeds)
    )
    picked = _with_pool(_spread(base, "plan_id", pool_bytes), pools, n_blocks).withColumn(
        "_picks",
        F.slice(
            F.sort_array(
                F.transform(
                    F.filter("pool", lambda x: x["template_id"] != F.col("template_id")), pick
                )
            ),
            F.lit(1),
            F.col("_n"),
        ),
    ).drop("pool")
    picked = _merge_picks(picked, n_blocks, "_picks", F.col("_n"))

    placed = F.aggregate(
        "_picks",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("words")),
        lambda acc, x: F.when(
            acc["words"] < F.col("target_words"),
            F.struct(
                (acc["n"] + 1).alias("n"), (acc["words"] + x["n_words"]).alias("words")
            ),
        ).otherwise(acc),
    )
    # sentences are joined by a space, so the words of the document are theirs and the evidence's
    words = F.aggregate("_picks", F.lit(0), lambda n, x: n + F.coalesce(x["n_words"], F.lit(0)))
    tail = F.transform(
        F.sort_array(
            F.transform(
                F.slice(F.col("_picks"), F.col("_placed.n") + 1, F.size("_picks")),
                lambda x: F.struct(
                    F.sha2(F.concat("_tail", x["fact_id"].cast("string")), 256).alias("h"),
                    x["statement"].alias("statement"),
                ),
            )
        ),
        lambda x: x["statement"],
    )
    head = F.transform(
        F.slice(F.col("_picks"), F.lit(1), F.col("_placed.n")), lambda x: x["statement"]
    )
    evidence = text.fill_template(F.col("statement_form"), F.col("subject"), F.col("object"))
    question = text.fill_template(F.col("question_form"), F.col("subject"))
    prompt_tail_words = 3  # "Question:", "Answer:<|end|>" and "<|assistant|>"

    built = (
        picked.withColumn("_placed", placed)
        .withColumn("_words", F.coalesce(words, F.lit(0)))
        .withColumn("_evidence", evidence)
        .withColumn("question", question)
        .withColumn(
            "document", F.concat_ws(" ", head, F.array(F.col("_evidence")), tail)
        )
        .withColumn(
            "evidence_position_token_idx",
            F.col("_placed.words") + text.count_word_tokens(F.col("_evidence")),
        )
        .withColumn(
            "evidence_distance_tokens",
            F.col("_words")
            + text.count_word_tokens(F.col("_evidence"))
            + text.count_word_tokens(F.col("question"))
            + prompt_tail_words
            - F.col("evidence_position_token_idx"),
        )
        .withColumnRenamed("object", "gold_answer")
        .withColumnRenamed("template_id", "question_template_id")
        .withColumn("target_reached", F.col("_placed.words") >= F.col("target_words"))
    )
    density_level = bins.coarsen_density(F.col("distractor_density"))
    n_gold = text.count_word_tokens(F.col("gold_answer"))
    out = (
        ids.with_event_id(built, template_sha)
        .withColumn("bin_id", bins.assign_bin(F.col("evidence_distance_tokens")))
        .withColumn("distractor_density_coarsening", density_level)
        .withColumn("gold_answer_length_tokens", n_gold)
        .withColumn(
            "gold_answer_length_coarsening",
            bins.coarsen_length(F.col("gold_answer_length_tokens")),
        )
        .withColumn(
            "cem_stratum_id",
            bins.stratum_id(
                F.col("question_template_id"),
                F.col("distractor_density_coarsening"),
                F.col("gold_answer_length_coarsening"),
            ),
        )
        .withColumn("adversariality_policy", F.lit("none"))
        .withColumn("model_generation", F.lit(""))
        .withColumn("model_generation_normalized", F.lit(""))
        .withColumn("gold_answer_normalized", text.normalize_em(F.col("gold_answer")))
        .withColumn("is_fail", F.lit(False))
        .withColumn("per_event_seed", ids.derive_seed("event", F.col("event_id")))
    )
    return out.select(
        *[c for c, _ in fixed.EVENT_COLUMNS], "plan_id", "target_words", "target_reached"
    )


def inject_distractors(
    events: DataFrame,
    templates: DataFrame,
    facts: DataFrame,
    *,
    n: int = fixed.N_ADVERSARIAL,
    template_sha: str = ids.PROMPT_TEMPLATE_SHA256,
    block_facts: int = BLOCK_FACTS,
) -> DataFrame:
    """Append confusing sentences to each document as its ``adversariality_policy``
    asks: sentences sharing words with the question, facts about other subjects of
    the same template, or one wrong answer for the same subject. The id is derived
    again from the longer document; events that get no sentence keep theirs.
    """
    policy = F.col("adversariality_policy")
    known = F.when(policy.isin(*fixed.POLICIES), policy).otherwise(
        F.raise_error(F.concat(F.lit("unknown policy: "), F.coalesce(policy, F.lit("NULL"))))
    )
    sentences = materialize(fact_sentences(templates, facts), "sentences")
    pools, n_blocks, _ = _blocks(sentences, block_facts)
    row_bytes = 1 << 12  # a document of usual length and three sentences
    forms = broadcast_if_small(
        templates.select(F.col("template_id").alias("question_template_id"), "statement_form")
    )
    base = (
        first_fact(_keyed(events, n_blocks).withColumn("adversariality_policy", known), facts)
        .join(forms, "question_template_id", "left")
        .withColumn("statement_form", _known(F.col("statement_form"), F.col("question_template_id")))
        .withColumn("_q_tokens", text.content_tokens(F.col("question")))
        .withColumn(
            "_limit", F.when(policy == "self_contradiction", 1).otherwise(n).cast("int")
        )
    )
    seed = F.concat(F.lit("adversarial:"), F.col("event_id"), F.lit(":"))

    def usable(x):
        sibling = (
            (x["template_id"] == F.col("question_template_id"))
            & (x["subject"] != F.col("fact_subject"))
            & (x["object"] != F.col("gold_answer"))
        )
        lexical = (x["object"] != F.col("gold_answer")) & (
            F.size(F.array_intersect(F.col("_q_tokens"), x["tokens"]))
            >= fixed.MIN_SHARED_TOKENS
        )
        return (
            F.when(policy == "lexical", lexical)
            .when(policy == "none", F.lit(False))
            .otherwise(sibling)
        )

    def pick(x):
        wrong = text.fill_template(
            F.col("statement_form"), F.col("fact_subject"), x["object"]
        )
        return F.struct(
            F.sha2(F.concat(seed, x["fact_id"].cast("string")), 256).alias("h"),
            F.when(policy == "self_contradiction", wrong)
            .otherwise(x["statement"])
            .alias("statement"),
        )

    picked = (
        _with_pool(_spread(base, "event_id", row_bytes), pools, n_blocks)
        .withColumn(
            "_picks",
            F.slice(
                F.array_sort(F.transform(F.filter("pool", usable), pick)),
                F.lit(1),
                F.col("_limit"),
            ),
        )
        .drop("pool")
    )
    picked = _merge_picks(picked, n_blocks, "_picks", F.col("_limit"))
    extra = F.transform("_picks", lambda x: x["statement"])
    changed = F.size("_picks") > 0
    return (
        picked.withColumn(
            "document",
            F.when(changed, F.concat_ws(" ", F.array(F.col("document")), extra)).otherwise(
                F.col("document")
            ),
        )
        .withColumn(
            "event_id",
            F.when(
                changed,
                ids.event_id(
                    template_sha, F.col("document"), F.col("question"), F.col("gold_answer")
                ),
            ).otherwise(F.col("event_id")),
        )
        .withColumn("n_injected", F.size("_picks"))
        .select(*events.columns, "n_injected")
    )


def grade(events: DataFrame, generations: DataFrame, key: str = "event_id") -> DataFrame:
    """Join raw generations (key, ``generation``) and label each event pass or fail.

    Every event stays: one without a generation has null in the four graded columns, and
    ``ungraded`` counts them.
    """
    raw = generations.select(key, text.trim_generation(F.col("generation")).alias("_raw"))
    dropped = ["model_generation", "model_generation_normalized", "gold_answer_normalized", "is_fail"]
    return (
        events.drop(*dropped)
        .join(raw, key, "left")
        .withColumnRenamed("_raw", "model_generation")
        .withColumn("model_generation_normalized", text.normalize_em(F.col("model_generation")))
        .withColumn("gold_answer_normalized", text.normalize_em(F.col("gold_answer")))
        .withColumn(
            "is_fail",
            F.col("model_generation_normalized") != F.col("gold_answer_normalized"),
        )
    )


def ungraded(events: DataFrame) -> DataFrame:
    """One row: events in all, and those that no generation has graded."""
    return events.agg(
        F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("is_fail").isNull()).alias("n_ungraded")
    )


def running_words(sentences: DataFrame, keys: Sequence[str], order: str, words: str = "words") -> DataFrame:
    """Words placed before each sentence of its text, as ``placed``; a window spans one text."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return sentences.withColumn("placed", F.coalesce(F.sum(words).over(before), F.lit(0)).cast("bigint"))


def shuffle_tail(sentences: DataFrame, keys: Sequence[str], key: Column, sentence: str = "sentence") -> DataFrame:
    """Per text its sentences in the order of a seeded ``key``, joined by spaces, as ``shuffled``."""
    ordered = F.array_sort(F.collect_list(F.struct(key.alias("h"), F.col(sentence).alias("s"))))
    return sentences.groupBy(*keys).agg(ordered.alias("_s")).select(
        *keys, F.array_join(F.transform("_s", lambda x: x["s"]), " ").alias("shuffled")
    )
