"""Benchmark decontamination by canonical templates.

Numbers, units behind numbers and capitalised names become typed placeholders, so a benchmark item and a copy with other parameters
give the same template. A capitalised word that opens a sentence may be a name or not: both readings of a text are taken, each a
template of its own. Windows of ``WINDOW`` template words are hashed on both sides and joined.

Matched windows of one document, item and reading on one diagonal are one place. There, slots that the item binds must agree: a name that it
repeats is one name, and a number that it repeats before the same word is one number, so the document must repeat its own value
too. Where it does not, the value that it has most often counts, and windows with another one do not match; other windows of the place do.

A document is contaminated by an item if its matched windows are ``COVER`` of the item's, or if it holds ``LONG_RUN`` words of the item in a
row as they are. Documents send only windows that a bitmap of fixed size, made of the benchmark's hashes, lets pass; the join decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attnstrata.llm.common import checked_broadcast, map_batches, pieces, string_column
from attnstrata.llm.parcels import bitmap_of, in_bitmap
from attnstrata.llm.wordhash import PlainWords, mix, shingles, word_hashes
from attnstrata.session import materialize

WINDOW, LEAST_WINDOW, COVER, LONG_RUN = 8, 5, 0.5, 20
#: Literal words that a window of the benchmark needs; others say too little.
LITERAL_SHARE = 0.5
BITMAP_BITS = 22
BENCHMARK_ROWS = 1_000_000
#: Bytes of text whose templates are held at once.
PIECE_BYTES = 1 << 20
#: Readings of a capitalised word that opens a sentence.
LITERAL, NAMED = 0, 1
# Units of measure that count as such behind a number.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yards mile miles mg g kg lb lbs pound pounds oz ounce ounces ton tons ml l "
    "liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks "
    "month months year years hz khz mhz ghz b kb mb gb tb w kw kwh v a ma j kj cal kcal n pa kpa bar mph kmh kph percent "
    "degree degrees c f k dollar dollars cent cents euro euros eur usd gbp yen"
).split()
NUMBER, UNIT, NAME = 1, 2, 3


class Templates:
    """Template words of texts: hash, kind (0: literal), value (hash of what a placeholder stands for), each text's first.

    ``bound`` tells slots apart that stand for the same thing: names by their value, numbers by theirs and the word behind.
    """

    def __init__(self, words: PlainWords, reading: int):
        data, starts, ends = words.data, words.starts, words.ends
        digits = np.r_[0, np.cumsum(words.digit)]
        marks = (data == 46) | (data == 44)
        points = np.r_[0, np.cumsum(marks & words.inside)]
        number = (digits[ends] - digits[starts]) + (points[ends] - points[starts]) == ends - starts
        # a sentence begins with a text and behind . ! ? : or a new line
        enders = np.r_[0, np.cumsum(((data == 46) | (data == 33) | (data == 63) | (data == 58) | (data == 10)) & ~words.inside)]
        opens = np.zeros(len(starts), dtype=bool)
        opens[words.first[:-1][words.first[:-1] < len(starts)]] = True
        if len(starts) > 1:
            opens[1:] |= enders[starts[1:]] > enders[ends[:-1]]
        capital = np.zeros(len(starts), dtype=bool)
        if len(starts):
            # a capital before another letter that is none: words in capitals are no names
            upper = np.zeros(len(data) + 2, dtype=bool)
            upper[: len(data)] = (data >= 65) & (data <= 90)
            upper[words.latin_capitals] = True
            second = starts + np.where(data[starts] == 0xC3, 2, 1)
            capital = upper[starts] & (second < ends) & ~upper[second]
        names = capital if reading == NAMED else capital & ~opens
        kind = np.where(number, NUMBER, np.where(names, NAME, 0)).astype(np.int8)
        known = np.sort(word_hashes(UNITS))
        if len(starts):
            at = np.minimum(np.searchsorted(known, words.hashes), len(known) - 1)
            after = np.r_[False, number[:-1]] & ~opens
            kind[(known[at] == words.hashes) & after & ~number] = UNIT
        # a run of names is one placeholder
        more = np.zeros(len(starts), dtype=bool)
        if len(starts) > 1:
            more[1:] = (kind[1:] == NAME) & (kind[:-1] == NAME) & ~opens[1:]
        keep = np.flatnonzero(~more)
        with np.errstate(over="ignore"):
            value = np.add.reduceat(words.hashes, keep) if len(keep) else words.hashes
        self.kind = kind[keep]
        placeholders = word_hashes(["numberslot", "unitslot", "nameslot"])
        self.hash = np.where(self.kind == 0, value, placeholders[np.maximum(self.kind, 1) - 1]).astype(np.uint64)
        if reading == NAMED:
            self.hash = mix(self.hash)
        self.first = np.searchsorted(keep, words.first)
        behind = np.r_[value[1:], np.zeros(min(1, len(value)), np.uint64)]
        behind[self.first[1:][self.first[1:] > 0] - 1] = 0  # what follows a text's last word is another text's
        with np.errstate(over="ignore"):
            self.bound = np.where(self.kind == NAME, value, mix(value ^ behind * np.uint64(3)) + self.kind.astype(np.uint64)).view(np.int64)
        self.value = np.where(self.kind == 0, np.uint64(0), value).view(np.int64)


def _readings(piece: pa.RecordBatch):
    words = PlainWords(string_column(piece, "text"))
    return ((reading, Templates(words, reading)) for reading in (LITERAL, NAMED))


def _rows(rows: list[tuple], **kinds) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def _windows(batches):
    """Benchmark rows: (item_id, reading, at, windows, width, hash, slots, bound); slots and what binds them, 0 where a word is literal."""
    for batch in batches:
        for piece in pieces(batch, "text", PIECE_BYTES):
            ids = piece.column(piece.schema.get_field_index("item_id")).to_pylist()
            rows = []
            for reading, found in _readings(piece):
                for item, a, b in zip(ids, found.first[:-1], found.first[1:], strict=True):
                    width = min(WINDOW, int(b - a))
                    if item is None or width < LEAST_WINDOW:
                        continue
                    literal = np.lib.stride_tricks.sliding_window_view(found.kind[a:b] == 0, width).mean(axis=1) >= LITERAL_SHARE
                    hashed = shingles(found.hash[a:b], width).view(np.int64)
                    for at in np.flatnonzero(literal).tolist():
                        here = slice(a + at, a + at + width)
                        slots = found.value[here]
                        bound = np.where(slots != 0, found.bound[here], 0)
                        some = slots.any()
                        rows.append((item, reading, at, int(literal.sum()), width, int(hashed[at]), slots if some else None, bound if some else None))
            yield _rows(
                rows, item_id=pa.int64(), reading=pa.int32(), at=pa.int64(), windows=pa.int64(), width=pa.int32(), hash=pa.int64(),
                slots=pa.list_(pa.int64()), bound=pa.list_(pa.int64()),
            )


def _matches(shared):
    """Document rows that may match: (doc_id, reading, place, width, hash, slots)."""

    def run(batches):
        widths = shared.value
        for batch in batches:
            for piece in pieces(batch, "text", PIECE_BYTES):
                ids = piece.column(piece.schema.get_field_index("doc_id"))
                for reading, found in _readings(piece):
                    for width, flags in widths.items():
                        hashed = shingles(found.hash, width)
                        at = np.flatnonzero(in_bitmap(flags, hashed))
                        doc = np.searchsorted(found.first, at, side="right") - 1
                        whole = at + width <= found.first[doc + 1]
                        at, doc = at[whole], doc[whole]
                        values = found.value[at[:, None] + np.arange(width)]
                        slots = [v if v.any() else None for v in values]
                        yield pa.RecordBatch.from_arrays(
                            [
                                ids.take(pa.array(doc)).cast(pa.int64()),
                                pa.array(np.full(len(at), reading), pa.int32()),
                                pa.array(at - found.first[doc], pa.int64()),
                                pa.array(np.full(len(at), width), pa.int32()),
                                pa.array(hashed[at].view(np.int64)),
                                pa.array(slots, pa.list_(pa.int64())),
                            ],
                            names=["doc_id", "reading", "place", "width", "hash", "slots"],
                        )

    return run


_PLACE = ["doc_id", "item_id", "reading", "diagonal"]


def _consistent(joined: DataFrame) -> DataFrame:
    """Matched windows (..., at, windows, width, same) without those in which a bound slot has another value than it mostly has."""
    pairs = joined.where("slots is not null").select(
        *_PLACE, "at", F.explode(F.arrays_zip("slots", "bound", "doc_slots")).alias("pair")
    ).where("pair.bound <> 0").select(*_PLACE, "at", "pair.bound", F.col("pair.doc_slots").alias("value"))
    counts = pairs.groupBy(*_PLACE, "bound", "value").agg(F.count("*").alias("times"))
    usual = counts.groupBy(*_PLACE, "bound").agg(
        F.max_by("value", F.struct("times", -F.col("value").cast("decimal(20,0)"))).alias("usual"), F.count("*").alias("values")
    ).where("values > 1").select(*_PLACE, "bound", "usual")
    broken = pairs.join(usual, [*_PLACE, "bound"]).where("value <> usual").select(*_PLACE, "at").distinct()
    same = F.coalesce(F.col("slots") == F.col("doc_slots"), F.lit(True))
    return joined.join(broken, [*_PLACE, "at"], "left_anti").select(*_PLACE, "at", "windows", "width", same.alias("same"))


def _longest(found: DataFrame) -> DataFrame:
    """(doc_id, item_id, run): the most words in a row that an item's places have as they are."""
    order = Window.partitionBy(*_PLACE).orderBy("at")
    runs = found.where("same").withColumn("island", F.col("at") - F.row_number().over(order))
    runs = runs.groupBy(*_PLACE, "island").agg((F.count("*") + F.max("width") - 1).alias("run"))
    return runs.groupBy("doc_id", "item_id").agg(F.max("run").alias("run"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, windows, matched, coverage, exact, run): contaminated documents, by item.

    ``matched`` of the item's ``windows`` stand in the document, in the reading that has more of them; ``exact`` tells whether all have the
    benchmark's own values, ``run`` is the longest row of words that the document has as they are.

    Null or empty texts match nothing; an item of fewer than ``LEAST_WINDOW`` template words, or without a window that is literal enough,
    finds nothing. Rows with a null id are not reported; rows of one id count together. Empty tables give no rows.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    windows = materialize(
        map_batches(
            items.distinct(), _windows,
            "item_id long, reading int, at long, windows long, width int, hash long, slots array<long>, bound array<long>",
        ),
        "windows",
    )
    widths = [r["width"] for r in windows.select("width").distinct().collect()]  # at most WINDOW of them
    flags = {width: bitmap_of(windows.where(F.col("width") == width), BITMAP_BITS) for width in widths}
    rows = docs.where("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    found = map_batches(
        rows, _matches(spark.sparkContext.broadcast(flags)),
        "doc_id long, reading int, place long, width int, hash long, slots array<long>",
    ).withColumnRenamed("slots", "doc_slots")
    joined = materialize(
        found.join(checked_broadcast(windows, BENCHMARK_ROWS), ["hash", "width", "reading"])
        .select(
            "doc_id", "item_id", "reading", (F.col("place") - F.col("at")).alias("diagonal"), "at", "windows", "width", "slots", "bound", "doc_slots"
        )
        .distinct(),
        "matches",
    )
    good = materialize(_consistent(joined), "good")
    counted = (
        good.groupBy("doc_id", "item_id", "reading", "at").agg(F.max("windows").alias("windows"), F.bool_or("same").alias("same"))
        .groupBy("doc_id", "item_id", "reading")
        .agg(F.max("windows").alias("windows"), F.count("*").alias("matched"), F.bool_and("same").alias("exact"))
        .groupBy("doc_id", "item_id")
        .agg(F.max(F.struct((F.col("matched") / F.col("windows")).alias("coverage"), "matched", "windows", "exact")).alias("best"))
    )
    return (
        counted.join(_longest(good), ["doc_id", "item_id"], "left")
        .select("doc_id", "item_id", "best.*", F.coalesce("run", F.lit(0)).cast("long").alias("run"))
        .where((F.col("coverage") >= COVER) | (F.col("run") >= LONG_RUN))
        .select("doc_id", "item_id", "windows", "matched", "coverage", "exact", "run")
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that no item contaminates, with all their columns. Rows without an id stay."""
    found = materialize(leaks(docs, benchmark).select("doc_id").distinct(), "leaks")
    return docs.join(checked_broadcast(found, BENCHMARK_ROWS), "doc_id", "left_anti").select(*docs.columns)
