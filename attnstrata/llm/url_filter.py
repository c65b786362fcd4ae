"""URL filters: host and path rules, and a logistic regression on hashed character n-grams for the rest.

The regression is trained, with numpy, on a small table of labelled URLs; see ``LABELLED``. Rules are
expressions; scoring works on Arrow batches of URLs.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from attnstrata.llm.common import map_batches, replaced, with_fields

BUCKETS, PASSES, RATE, PENALTY = 1 << 14, 300, 0.5, 1e-3
SIZES = (3, 4, 5)
BLOCK_AT = 0.5

#: (host and path of the rule, verdict); the longest rule that fits wins.
RULES: tuple[tuple[str, str], ...] = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)

#: Labelled hosts with paths: 1 for what should be blocked.
LABELLED: tuple[tuple[str, int], ...] = tuple(
    (url, label)
    for label, urls in (
        (1, (
            "spam-mailer.net/buy", "getspam.info/offer", "spam-list.biz/x", "farm-of-spam.com/en/1", "bulk-spam.org/",
            "cheap-meds.info/order", "pills-online.biz/rx", "discount-pills.net/buy", "cheap-viagra.com/en/12", "best-pills.org/",
            "casino-royal.biz/play", "win-casino.net/bonus", "online-casino.info/en/3", "casino777.com/", "big-win.net/slots",
            "sports-bets.net/odds", "bets-live.com/", "free-casino.org/en/9", "bet-free.biz/join", "best-bets.info/en/44",
            "ads-server.net/click", "track-ads.com/pixel", "adtrack.biz/r", "ads.clickfarm.net/", "track.popunder.info/en/5",
            "xxx-videos.biz/", "hot-porn.net/en/7", "poker-bonus.com/play", "slots-jackpot.net/", "payday-loans.biz/apply",
            "free-money.info/win", "replica-watches.net/cheap", "warez-crack.org/download", "phish-login.info/verify", "malware-host.biz/exe",
            "adult-chat.net/join", "hot-adult.info/en/4", "adults-only.biz/x", "xadult.com/",
            "www.spam-hub.example/en/71", "m.cheap-drugs.example/fr/8", "blog.casino-bet.example/de/3", "www.free-spins.example/es/6", "m.ads-pop.example/en/2",
        )),
        (0, (
            "daily-news.org/world/1", "blog.gardening.net/roses", "library.university.edu/catalogue", "wiki.history.org/en/rome", "weather.gov.net/today",
            "museum.city.org/art", "recipes.kitchen.com/soup", "www.mountain-hikes.com/trails", "docs.python-guide.net/en/3", "blog.travel-notes.com/fr/paris",
            "m.local-paper.com/de/berlin", "school.district.org/en/12", "www.bird-watch.net/es/aves", "science.journal.org/en/450", "www.theatre.com/fr/77",
            "forum.woodwork.net/en/88", "blog.the-reader.net/en/960", "m.another-day.com/en/31", "www.other-things.org/en/700", "with-them.net/de/12",
            "there-and-then.com/en/5", "blog.nation.example/en/15", "the-rest.example/en/825", "www.station.example/fr/414", "m.thinking.example/es/55",
            "blog.thesis.example/de/9", "weather.example/en/63", "motion.example/es/21", "www.another.example/en/148", "thunder.example/en/3",
            "health.clinic.org/advice", "farmers-market.org/en/2", "train-track-history.net/en/8", "windows.help.net/en/11", "better-homes.com/en/41",
            "education-adults.org/en/6", "lab-results.org/en/3", "fault-line.net/en/9", "consultants.net/fr/8",
            "tablets-review.net/en/9", "free-library.org/en/18", "town-hall.gov.net/fr/2", "blog.thonet.example/en/21", "www.enthusiast.example/en/90",
        )),
    )
    for url in urls
)


def host(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule that fits; null if none. A rule fits its host and all subdomains, and paths with its beginning."""
    tests = [F.lit(None).cast("string")]
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        domain, slash, start = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + start)
        tests.insert(-1, F.when(fits, F.lit(rule)))
    return F.coalesce(*tests)


def ngrams(host: str, path: str) -> np.ndarray:
    """Buckets of the character n-grams of host and path, with marks at the ends; each once."""
    found = {
        zlib.crc32(f"{part}{text[i : i + n]}".encode("utf-8", "replace")) % BUCKETS
        for part, text in (("h", f"^{host}$"), ("p", f"^{path}$"))
        for n in SIZES
        for i in range(len(text) - n + 1)
    }
    return np.array(sorted(found), dtype=np.int64)


def train(labelled: tuple[tuple[str, int], ...] = LABELLED) -> np.ndarray:
    """Weights of the buckets by gradient steps over the whole labelled table. No bias: without n-grams the score is 0.5."""
    rows = [ngrams(url.partition("/")[0], "/" + url.partition("/")[2]) for url, _ in labelled]
    goal = np.array([label for _, label in labelled], dtype=np.float64)
    weights = np.zeros(BUCKETS)
    for _ in range(PASSES):
        miss = goal - 1 / (1 + np.exp(-np.array([weights[r].sum() for r in rows])))
        weights *= 1 - RATE * PENALTY
        for r, m in zip(rows, miss, strict=True):
            weights[r] += RATE * m / len(rows)
    return weights


def _score(model):
    def run(batches):
        weights = model.value
        for batch in batches:
            names = batch.column(batch.schema.get_field_index("host")).to_pylist()
            paths = batch.column(batch.schema.get_field_index("path")).to_pylist()
            total = np.array([weights[ngrams(h, p)].sum() for h, p in zip(names, paths, strict=True)])
            yield replaced(batch, score=pa.array(1 / (1 + np.exp(-total))))

    return run


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, labelled: tuple[tuple[str, int], ...] = LABELLED) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row.

    A null URL, or one without ``://``, has an empty host and path; no rule fits it and the regression finds nothing to
    judge: its score is 0.5, its verdict allow. Rows with null or repeated ids stay.
    """
    model = pages.sparkSession.sparkContext.broadcast(train(labelled))
    url = F.col("url").cast("string")
    rows = pages.select("page_id", host(url).alias("host"), path(url).alias("path"))
    rows = map_batches(rows, _score(model), with_fields(rows, StructField("score", DoubleType())))
    rule = matching_rule(F.col("host"), F.col("path"), rules)
    verdicts = F.coalesce(*[F.when(F.col("rule") == r, F.lit(v)) for r, v in rules], F.lit(None).cast("string"))
    learned = F.when(F.col("score") > BLOCK_AT, "block").otherwise("allow")
    return rows.withColumn("rule", rule).select(
        "page_id", "host", "path", "rule", F.coalesce(verdicts, learned).alias("verdict"), "score"
    )
