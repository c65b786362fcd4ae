"""Collocations by Toivonen's mining of frequent phrases.

A phrase of up to ``LONGEST`` words is frequent in a language if it occurs ``least`` times. Whatever holds a phrase holds its parts, so a frequent
phrase's two parts that are one word shorter are frequent too.

1. A sample of documents (a hash share of them) counts all its phrases; those that reach a lowered threshold are proposed.
2. A full pass counts the proposed phrases and their negative border exactly: all single words, and all phrases in
   the texts that are not proposed though both their parts are. Phrases of the border that turn out frequent are failures.
3. If there are failures, an expansion pass counts what they bring to the border, at all lengths at once: a phrase that was not counted yet
   counts now if both its parts may be frequent. A part may be frequent if it was counted and found so, or if it was not counted and
   both its own parts may be. This closes the search in one pass: every phrase that may be frequent has then been counted, and
   what the pass finds has no uncounted phrase above it that may be.
4. A last pass over the texts names the frequent phrases and counts them by their words.

Passes count by hashes: a piece of texts sends each bucket the phrases it holds once, with their counts. Which phrases are proposed goes to the
tasks as a bitmap of a fixed size, whatever their number; wrong bits only count a phrase for nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attnstrata.llm.common import checked_broadcast, map_batches, pieces, string_column
from attnstrata.llm.parcels import arrays, bitmap_of, bucket_count, bucket_of, by_bucket, in_bitmap
from attnstrata.llm.wordhash import folded, hash_spans, mix, raw_bytes, shingles, spans
from attnstrata.session import materialize

LONGEST, LEAST, FIRST = 5, 100, 2000
#: One of so many documents is in the sample; there, a phrase is proposed if it reaches this share of its expected least count.
SAMPLE_SHARE, LOWERED = 16, 0.65
#: The bitmap of proposed phrases has 2^26 bits (8 MB).
BITMAP_BITS = 26
#: Languages whose word counts may be broadcast.
LANGUAGES = 100_000
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_OUTSIDE = _BREAK.copy()
_OUTSIDE[[0x20, 0x09]] = True


class _Phrases:
    """The words of a batch of texts, and hashes of the phrases that begin at each; a language is part of the hash."""

    def __init__(self, texts: pa.Array, langs: list[str]):
        self.data, offsets = raw_bytes(texts)
        self.data = folded(self.data)
        self.starts, self.ends = spans(~_OUTSIDE[self.data], offsets)
        self.words = hash_spans(self.data, self.starts, self.ends)
        first = np.searchsorted(self.starts, offsets)
        #: languages, and the words of each
        self.names, place = np.unique(np.array(langs, dtype=object), return_inverse=True)
        self.lang = np.repeat(place.astype(np.int32), np.diff(first))
        self.totals = np.bincount(self.lang, minlength=len(self.names))
        self.salts = np.array([xxhash.xxh3_64_intdigest(n.encode()) for n in self.names], dtype=np.uint64)
        self.salt = self.salts[self.lang]
        # the number of breaks before a word, and of texts, tells the part of text it is in
        breaks = np.r_[0, np.cumsum(_BREAK[self.data])]
        self.part = breaks[self.starts] + np.repeat(np.arange(len(first) - 1), np.diff(first))

    def hashes(self, length: int) -> np.ndarray:
        """Hash of the phrase of so many words that begins at each word, whatever part it is in."""
        with np.errstate(over="ignore"):
            return mix(shingles(self.words, length) ^ self.salt[: max(0, len(self.words) - length + 1)] * np.uint64(2 * length + 1))

    def whole(self, length: int) -> np.ndarray:
        """Whether so many words from each word on are in one part."""
        n = max(0, len(self.words) - length + 1)
        return self.part[:n] == self.part[length - 1 :][:n]

    def all(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """By length, places and hashes of all phrases."""
        places = [np.flatnonzero(self.whole(length)) for length in range(1, LONGEST + 1)]
        return [(at, self.hashes(length)[at]) for length, at in enumerate(places, 1)]

    def bordered(self, proposed: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """By length, places and hashes of the words, and of the phrases both whose parts are proposed."""
        out, known = [], None
        for length in range(1, LONGEST + 1):
            hashed, counts = self.hashes(length), self.whole(length)
            if length > 1:
                counts &= (known[:-1] & known[1:])[: len(counts)]
            known = in_bitmap(proposed, hashed)
            at = np.flatnonzero(counts)
            out.append((at, hashed[at]))
        return out

    def expanded(self, proposed: np.ndarray, frequent: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """By length, places and hashes of the phrases that ``bordered(proposed)`` left out, but may be frequent.

        ``frequent`` has what that found: the parts that it counted may be frequent only if they are there.
        """
        out, known, may = [], None, None
        for length in range(1, LONGEST + 1):
            hashed, whole = self.hashes(length), self.whole(length)
            if length == 1:
                may = in_bitmap(frequent, hashed)
            else:
                counted = (known[:-1] & known[1:])[: len(whole)]
                parts = (may[:-1] & may[1:])[: len(whole)]
                at = np.flatnonzero(whole & parts & ~counted)
                out.append((at, hashed[at]))
                may = np.where(counted, in_bitmap(frequent, hashed), parts)
            known = in_bitmap(proposed, hashed)
        return out


def _read(batches):
    for batch in batches:
        for piece in pieces(batch, "text"):
            yield _Phrases(string_column(piece, "text"), piece.column(piece.schema.get_field_index("lang")).to_pylist())


def _count(buckets: int, which: str, bitmaps):
    """Rows (bucket, hashes, counts): the phrases that each piece counts, by the method of ``_Phrases`` named."""

    def run(batches):
        values = [b.value for b in bitmaps]
        for phrases in _read(batches):
            found = getattr(phrases, which)(*values)
            hashed, counts = np.unique(np.concatenate([h for _, h in found]), return_counts=True)
            bucket = bucket_of(hashed, buckets)
            order = np.argsort(bucket, kind="stable")
            hashed, counts, bucket = hashed[order], counts[order].astype(np.uint32), bucket[order]
            runs = list(by_bucket(bucket))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k for k, _, _ in runs], pa.int32()),
                    pa.array([hashed[a:b].tobytes() for _, a, b in runs], pa.binary()),
                    pa.array([_small(counts[a:b]) for _, a, b in runs], pa.binary()),
                ],
                names=["bucket", "hashes", "counts"],
            )

    return run


def _small(counts: np.ndarray) -> bytes:
    """Counts as bytes; from 255 on a byte 255 stands for the next of the four-byte counts at the end."""
    large = counts >= 255
    return np.where(large, 255, counts).astype(np.uint8).tobytes() + counts[large].tobytes()


def _large(data: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(data, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, np.uint32, offset=n)
    return counts


def _frequent(least: int):
    """The hashes of one bucket that are counted ``least`` times."""

    def run(rows: pa.Table) -> pa.Table:
        hashed, starts = arrays(rows["hashes"], np.uint64)
        counts = np.concatenate([_large(x, n) for x, n in zip(rows["counts"].to_pylist(), np.diff(starts).tolist(), strict=True)])
        order = np.argsort(hashed, kind="stable")
        hashed, counts = hashed[order], counts[order]
        first = np.flatnonzero(np.r_[True, hashed[1:] != hashed[:-1]])
        total = np.add.reduceat(counts, first)
        keep = total >= least
        return pa.table({"hash": pa.array(hashed[first][keep].view(np.int64))})

    return run


def _pass(texts: DataFrame, buckets: int, least: int, which: str, *bitmaps) -> DataFrame:
    counted = map_batches(texts, _count(buckets, which, bitmaps), "bucket int, hashes binary, counts binary")
    return materialize(counted.groupBy("bucket").applyInArrow(_frequent(least), "hash long"), "frequent")


_NAMED = "bucket int, lang array<string>, phrase array<string>, n array<long>"


def _name(buckets: int, shared):
    """Rows of ``_NAMED``: the phrases of each piece that the bitmap has, with counts, by bucket; a null phrase counts all words."""

    def run(batches):
        bitmap = shared.value
        for phrases in _read(batches):
            data, starts, ends = phrases.data, phrases.starts, phrases.ends
            hashes, langs, names, counts = [phrases.salts], [np.arange(len(phrases.names))], [None] * len(phrases.names), [phrases.totals]
            for length, (at, hashed) in enumerate(phrases.bordered(bitmap), 1):
                known = in_bitmap(bitmap, hashed)
                distinct, place, times = np.unique(hashed[known], return_index=True, return_counts=True)
                at = at[known][place]
                hashes.append(distinct)
                langs.append(phrases.lang[at])
                counts.append(times)
                names += [b" ".join([data[starts[j] : ends[j]].tobytes() for j in range(a, a + length)]) for a in at.tolist()]
            bucket = bucket_of(np.concatenate(hashes), buckets)
            order = np.argsort(bucket, kind="stable")
            runs = list(by_bucket(bucket[order]))
            cuts = pa.array([a for _, a, _ in runs] + [len(order)], pa.int32())
            columns = (
                pa.array(phrases.names[np.concatenate(langs)[order]], pa.string()),
                pa.array(names, pa.binary()).cast(pa.string()).take(pa.array(order)),
                pa.array(np.concatenate(counts)[order].astype(np.int64)),
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _, _ in runs], pa.int32()), *(pa.ListArray.from_arrays(cuts, c) for c in columns)],
                names=["bucket", "lang", "phrase", "n"],
            )

    return run


def _sum_named(least: int):
    """The phrases of one bucket that are counted ``least`` times, by their words; and the counts of all words."""

    def run(rows: pa.Table) -> pa.Table:
        flat = pa.table({n: pc.list_flatten(rows[n]) for n in ("lang", "phrase", "n")})
        total = flat.group_by(["lang", "phrase"], use_threads=False).aggregate([("n", "sum")])
        total = total.filter(pc.or_(pc.is_null(total["phrase"]), pc.greater_equal(total["n_sum"], least)))
        words = pc.fill_null(pc.add(pc.count_substring(total["phrase"], " "), 1), 0)
        return pa.table({"lang": total["lang"], "phrase": total["phrase"], "words": pc.cast(words, pa.int32()), "n": total["n_sum"]})

    return run


def frequent_phrases(docs: DataFrame, least: int = LEAST, sample_share: int = SAMPLE_SHARE) -> DataFrame:
    """(lang, phrase, words, n): phrases of 1 to ``LONGEST`` words that occur ``least`` times in a language, with exact counts.

    A further row a language, of a null phrase and 0 words, counts all its words. A null language is ``und``; null texts are
    empty. ``sample_share`` changes the work, never the result.
    """
    texts = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.col("doc_id").cast("long").alias("doc_id"),
    )
    spark = docs.sparkSession
    buckets = bucket_count(texts)
    sample = texts.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(sample_share)) == 0).drop("doc_id")
    texts = texts.drop("doc_id")
    lowered = max(1, int(least / sample_share * LOWERED))
    proposed = _pass(sample, -(-buckets * LONGEST // sample_share), lowered, "all")
    known = spark.sparkContext.broadcast(bitmap_of(proposed, BITMAP_BITS))
    found = _pass(texts, buckets, least, "bordered", known)
    frequent = spark.sparkContext.broadcast(bitmap_of(found, BITMAP_BITS))
    if (frequent.value & ~known.value).any():  # failures
        found = found.unionByName(_pass(texts, buckets, least, "expanded", known, frequent))
    known.destroy()
    frequent.destroy()
    shared = spark.sparkContext.broadcast(bitmap_of(found, BITMAP_BITS))
    named = map_batches(texts, _name(buckets, shared), _NAMED).groupBy("bucket")
    return materialize(named.applyInArrow(_sum_named(least), "lang string, phrase string, words int, n long"), "phrases")


def _words(phrase: str) -> Column:
    return F.split(phrase, " ")


def _cut(begin: Column, size: Column) -> Column:
    return F.concat_ws(" ", F.slice(_words("phrase"), begin, size))


def collocations(docs: DataFrame, least: int = LEAST, first: int = FIRST, sample_share: int = SAMPLE_SHARE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases of 2 to ``LONGEST`` words by score.

    Cut after its first k words, a phrase of count a whose parts count l and r has the score ``1000 a n // (l r)``, n being all words of
    the language; its lowest cut counts, the first of equal ones. Phrases inside a longer one of the same count are left out.
    Ties in score go to the higher a, then to the phrase by its bytes.

    Null texts have no words, a null language is ``und``, rows that repeat count again, ids play no part in results. Texts or languages
    without such a phrase give no rows, nor does an empty table. Further columns are ignored.
    """
    known = frequent_phrases(docs, least, sample_share)
    phrases = known.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"))
    totals = known.where("words = 0").select("lang", F.col("n").alias("n"))
    parts = known.where("words between 1 and %d" % (LONGEST - 1))
    inner = phrases.where("words > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    inner = inner.withColumn("begin", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
    inside = inner.select("lang", _cut(F.col("begin"), F.col("size")).alias("phrase"), F.col("a").alias("longer"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    own = phrases.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a"))).drop("longer")
    cuts = own.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("head", _cut(F.lit(1), F.col("k"))).withColumn("tail", _cut(F.col("k") + 1, F.col("words") - F.col("k")))
    for part, name in (("head", "l"), ("tail", "r")):
        cuts = cuts.join(parts.select("lang", F.col("phrase").alias(part), F.col("n").alias(name)), ["lang", part])
    # 38 digits hold these products; integer division of decimals is exact
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.join(checked_broadcast(totals, LANGUAGES), "lang").withColumn("thousand", F.expr("1000 * n"))
    cuts = cuts.withColumn("over", wide("a") * wide("thousand")).withColumn("under", wide("l") * wide("r"))
    cuts = cuts.withColumn("score", F.expr("over div under"))
    lowest = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")
    out = lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score").withColumn("rank", rank)
    return out.where(F.col("rank") <= first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH parts AS (
    SELECT row_number() OVER () AS part, lang, regexp_extract_all(part, '[^\x20\x09]+') AS words
    FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
              translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS part FROM documents)
), every AS (
    SELECT lang, size, array_to_string(words[place:place + size - 1], ' ') AS phrase, count(*) AS f
    FROM (SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS place FROM parts, range(1, 6) AS sizes(size))
    GROUP BY ALL
), totals AS (
    SELECT lang, sum(f) AS n FROM every WHERE size = 1 GROUP BY lang
), candidates AS (
    SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS words FROM every WHERE size > 1 AND f >= 100
), inside AS (
    SELECT lang, array_to_string(words[place:place + inner_size - 1], ' ') AS phrase, max(a) AS longer
    FROM (SELECT *, unnest(range(1, size - inner_size + 2)) AS place FROM (SELECT *, unnest(range(2, size)) AS inner_size FROM candidates))
    GROUP BY ALL
), cuts AS (
    SELECT lang, phrase, a, size, words, unnest(range(1, size)) AS k
    FROM candidates LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR longer < a
), scored AS (
    SELECT cuts.lang, cuts.phrase, a, x.f AS l, y.f AS r, CAST(n AS BIGINT) AS n, k,
           CAST(1000::HUGEINT * a * n // (x.f::HUGEINT * y.f) AS BIGINT) AS score
    FROM cuts JOIN totals USING (lang)
    JOIN every AS x ON x.lang = cuts.lang AND x.phrase = array_to_string(words[:k], ' ')
    JOIN every AS y ON y.lang = cuts.lang AND y.phrase = array_to_string(words[k + 1:], ' ')
), lowest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest QUALIFY rank <= 2000
"""
