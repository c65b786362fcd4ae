"""Language of texts by a linear-chain conditional random field over their words.

Each word of a text is labelled with a language. Its score for a language sums weights of its affixes, byte
n-grams and lexicon entries; weights between neighbours' labels are learned too, so a switch of language
inside a text is possible but must be worth it. Forward-backward gives each word's probabilities; a text's
language has the largest mean. Chains are whole lines. Those of over ``BLOCK_WORDS`` words are worked on in blocks side by side: the
product of a block's transfer matrices carries forward and backward values over it, so the result is that of the whole line.

The model is fitted, with numpy, on a bounded sample: ``DOCS_PER_LANGUAGE`` labelled documents of each language
(the smallest hashes of their ids), and of their lines ``TRAIN_LINES`` at most, ``TRAIN_WORDS`` words of each. Lines of several languages are
strung together for training, so that switches are seen. Everything else covers all words of all texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField

from attnstrata.llm.common import held_out, map_batches, pieces, replaced, smallest_hashes, string_column, with_fields
from attnstrata.llm.wordhash import hash_spans, spans

DOCS_PER_LANGUAGE, TRAIN_LINES, TRAIN_PASSES = 400, 8000, 60
BLOCK_WORDS, TRAIN_WORDS = 256, 24
#: Characters of a training line; longer ones (words of hundreds of letters) are not learned from.
TRAIN_CHARS = 2000
BUCKETS = 1 << 16
LEXICON_COUNT = 4
#: Words whose scores one task remembers before it starts anew, and their characters.
CACHE_WORDS, CACHE_CHARS = 1 << 18, 1 << 22
UNKNOWN = "und"


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # (buckets + lexicon entries) x labels
    switch: np.ndarray  # labels x labels
    lexicon: np.ndarray  # sorted word hashes


def features(tokens: list[str], lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all words, one after the other, and where each word's begin.

    Features are byte n-grams of 2 to 4 with marked word ends, prefixes and suffixes of 1 to 4 bytes, and the
    word itself if the lexicon has it. A word has one feature at least.
    """
    text = np.frombuffer(("\n" + "\n".join(tokens).lower() + "\n").encode("utf-8", "replace"), dtype=np.uint8)
    marks = np.flatnonzero(text == 10)
    starts, ends = marks[:-1] + 1, marks[1:]
    sizes = ends - starts
    wide = text.astype(np.uint32)
    ids, owner = [], []
    words = np.arange(len(starts))
    for n in (2, 3, 4):
        gram = np.full(max(0, len(wide) - n + 1), n, dtype=np.uint32)
        for j in range(n):
            gram = gram * np.uint32(0x01000193) + wide[j : j + len(gram)]
        count = np.maximum(sizes + 3 - n, 0)
        who = np.repeat(words, count)
        at = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(starts - 1, count)
        ids.append(gram[at])
        owner.append(who)
    for side in (0, 1):
        affix = np.full(len(starts), 77 + side, dtype=np.uint32)
        for k in range(4):
            has = sizes > k
            at = (starts + k if side == 0 else ends - 1 - k)[has]
            affix = affix[has if k == 0 else has[last]]
            affix = affix * np.uint32(0x85EBCA6B) + wide[at] + np.uint32(k)
            last = has
            ids.append(affix ^ (affix >> np.uint32(15)))
            owner.append(words[has])
    ids = [(x ^ (x >> np.uint32(16))) % np.uint32(BUCKETS) for x in ids]
    if len(lexicon):
        filled = sizes > 0
        named = hash_spans(text, starts[filled], ends[filled])
        at = np.minimum(np.searchsorted(lexicon, named), len(lexicon) - 1)
        hit = lexicon[at] == named
        ids.append((BUCKETS + at[hit]).astype(np.uint32))
        owner.append(words[filled][hit])
    ids, owner = np.concatenate(ids), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return ids[order], np.searchsorted(owner[order], words)


def scores(tokens: list[str], model: Model) -> np.ndarray:
    ids, begins = features(tokens, model.lexicon)
    return np.add.reduceat(model.weights[ids], begins, axis=0)


def _carried(local: np.ndarray, step: np.ndarray, starts: np.ndarray, sizes: np.ndarray, follows: np.ndarray):
    """Forward values that enter each block and backward values behind it, up to a factor, where lines have several blocks.

    All blocks of such lines move one word at a time, each with a matrix from the label before it to that of its last word; then
    the matrices of a line's blocks are multiplied, from its begin and from its end.
    """
    before, behind = np.ones((len(starts), local.shape[1])), np.ones((len(starts), local.shape[1]))
    several = np.flatnonzero(follows | np.r_[follows[1:], False])
    if not len(several):
        return before, behind
    order = several[np.argsort(-sizes[several], kind="stable")]
    matrix = np.zeros((len(order), local.shape[1], local.shape[1]))
    for t in range(int(sizes[order[0]])):
        n = int(np.searchsorted(-sizes[order], -t, side="left"))
        at = local[starts[order[:n]] + t].astype(np.float64)
        if t:
            matrix[:n] = (matrix[:n] @ step) * at[:, None, :]
        else:
            first = np.where(follows[order][:, None, None], step, np.eye(len(step)))
            matrix[:] = first * at[:, None, :]
        matrix[:n] /= matrix[:n].sum(axis=(1, 2), keepdims=True)
    place = dict(zip(order.tolist(), range(len(order)), strict=True))
    for b in several.tolist():
        if follows[b]:
            value = before[b - 1] @ matrix[place[b - 1]]
            before[b] = value / value.sum()
    for b in several[::-1].tolist():
        if follows[b]:
            value = matrix[place[b]] @ behind[b]
            behind[b - 1] = value / value.sum()
    return before, behind


def forward_backward(
    score: np.ndarray, starts: np.ndarray, sizes: np.ndarray, switch: np.ndarray, pairs: bool = False, follows: np.ndarray | None = None
):
    """Label probabilities of each word; with ``pairs`` also the expected switches and log Z.

    Chains are runs of rows of ``score``. All chains move one word at a time, longest first. A chain that ``follows`` goes on from the one
    before it (not with ``pairs``).
    """
    order = np.argsort(-sizes, kind="stable")
    given = starts, sizes
    starts, sizes = starts[order], sizes[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")
    begin = np.cumsum(active) - active
    # words in the order in which they are visited: the first of all chains, the second of all chains, ...
    moment = np.repeat(np.arange(longest), active)
    chain = np.arange(len(moment)) - begin[moment]
    visit = starts[chain] + moment
    top = score.max(axis=1, keepdims=True)
    local, step = np.exp(score - top), np.exp(switch).astype(score.dtype)
    joined = np.zeros(len(starts), dtype=bool) if follows is None else follows[order]
    if joined.any():
        before, behind = (x[order].astype(score.dtype) for x in _carried(local, step, *given, follows))
    local = local[visit]
    alpha, norm = np.empty_like(local), np.ones((len(local), 1), dtype=score.dtype)
    for t in range(longest):
        n, at = active[t], begin[t]
        a = local[at : at + n]
        if t:
            a = (alpha[begin[t - 1] : begin[t - 1] + n] @ step) * a
        elif joined.any():
            a = np.where(joined[:n, None], before[:n] @ step, 1) * a
        total = np.add(np.add(a[:, :1], a[:, 1:2]), a[:, 2:].sum(axis=1, keepdims=True)) if a.shape[1] > 1 else a
        norm[at : at + n] = total
        np.divide(a, total, out=alpha[at : at + n])
    beta = np.ones_like(local)
    if joined.any():
        chains = np.flatnonzero(sizes)
        beta[begin[sizes[chains] - 1] + chains] = behind[chains]
    local /= norm
    expected = np.zeros_like(switch)
    for t in range(longest - 2, -1, -1):
        n, at, nxt = active[t + 1], begin[t], begin[t + 1]
        ahead = local[nxt : nxt + n] * beta[nxt : nxt + n]
        np.matmul(ahead, step.T, out=beta[at : at + n])
        if pairs:
            expected += (alpha[at : at + n].T @ ahead) * step
    alpha *= beta
    alpha /= alpha.sum(axis=1, keepdims=True)
    found = np.empty_like(alpha)
    found[visit] = alpha
    return (found, expected, float(np.log(norm).sum() + top.sum())) if pairs else found


def _tokens(line: str) -> list[str]:
    return line.split()


def fit(rows: list[tuple[str, str]], passes: int = TRAIN_PASSES) -> Model | None:
    """A model from (language, line) rows; none if no row has a word."""
    rows = [(label, words) for label, line in sorted(rows) if (words := _tokens(line))]
    if not rows:
        return None
    labels = sorted({label for label, _ in rows})
    rng = np.random.default_rng(17)
    parts = []
    for label, words in rows:
        at = int(rng.integers(0, max(1, len(words) - TRAIN_WORDS + 1)))
        parts.append((labels.index(label), words[at : at + TRAIN_WORDS]))
    chains, left = [], [parts[i] for i in rng.permutation(len(parts))]
    while left:
        k = int(rng.integers(1, 4))
        chains.append(left[:k])
        left = left[k:]
    tokens = [w for chain in chains for _, words in chain for w in words]
    gold = np.array([label for chain in chains for label, words in chain for _ in words])
    sizes = np.array([sum(len(w) for _, w in chain) for chain in chains])
    starts = np.cumsum(sizes) - sizes
    distinct, code = np.unique(np.array(tokens, dtype=object), return_inverse=True)
    lowered = [w.lower() for w in distinct]
    times = np.bincount(code)
    common = sorted({w for w, n in zip(lowered, times, strict=True) if n >= LEXICON_COUNT})
    joined = np.frombuffer(("\n" + "\n".join(common) + "\n").encode(), dtype=np.uint8)
    lexicon = np.unique(hash_spans(joined, *spans(joined != 10, np.array([0, len(joined)])))) if common else np.zeros(0, np.uint64)
    ids, begins = features(list(distinct), lexicon)
    owner = np.repeat(np.arange(len(distinct)), np.diff(np.r_[begins, len(ids)]))
    k = len(labels)
    weights = np.zeros((BUCKETS + len(lexicon), k))
    switch = np.zeros((k, k))
    used = np.unique(ids)
    inside = np.ones(len(tokens), dtype=bool)
    inside[starts] = False
    seen_switch = np.zeros((k, k))
    follow = np.flatnonzero(inside)
    np.add.at(seen_switch, (gold[follow - 1], gold[follow]), 1)
    one = np.zeros((len(tokens), k))
    one[np.arange(len(tokens)), gold] = 1
    compact = np.searchsorted(used, ids)
    squares, switch_squares = np.full((len(used), k), 1e-8), np.full((k, k), 1e-8)
    for _ in range(passes):
        emitted = np.add.reduceat(weights[ids], begins, axis=0)
        found, expected, _ = forward_backward(emitted[code], starts, sizes, switch, pairs=True)
        miss = one - found
        per_word = np.stack([np.bincount(code, miss[:, j], len(distinct)) for j in range(k)], axis=1)
        slope = np.stack([np.bincount(compact, per_word[owner, j], len(used)) for j in range(k)], axis=1)
        slope -= 0.05 * weights[used]
        squares += slope**2
        weights[used] += 0.1 * slope / np.sqrt(squares)
        turn = seen_switch - expected - 0.05 * switch
        switch_squares += turn**2
        switch += 0.1 * turn / np.sqrt(switch_squares)
    return Model(labels, weights.astype(np.float32), switch, lexicon)


class _Scorer(dict):
    """Raw word -> row of the scores of all words met so far."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.fresh, self.rows, self.chars = model, [], np.zeros((0, len(model.labels)), np.float32), 0

    def full(self) -> bool:
        return len(self) > CACHE_WORDS or self.chars > CACHE_CHARS

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        self.chars += len(word)
        self.fresh.append(word)
        return at

    def table(self) -> np.ndarray:
        if self.fresh:
            new = [scores(self.fresh[i : i + 50_000], self.model) for i in range(0, len(self.fresh), 50_000)]
            self.rows, self.fresh = np.concatenate([self.rows, *new]), []
        return self.rows


def _lettered(text: str) -> bool:
    return any(map(str.isalpha, text))


def word_marginals(texts: list[str], scorer: _Scorer):
    """Probabilities of all words of some texts, and each text's number of words."""
    code = scorer.__getitem__
    codes: list[int] = []
    sizes: list[int] = []
    follows: list[bool] = []
    counts = []
    for text in texts:
        before = len(codes)
        for line in text.split("\n"):
            row = list(map(code, line.split()))
            codes += row
            for at in range(0, len(row), BLOCK_WORDS):
                sizes.append(min(BLOCK_WORDS, len(row) - at))
                follows.append(at > 0)
        counts.append(len(codes) - before)
    sizes = np.array(sizes, dtype=np.int64)
    score = scorer.table()[np.array(codes, dtype=np.int64)]
    found = forward_backward(score, np.cumsum(sizes) - sizes, sizes, scorer.model.switch, follows=np.array(follows, dtype=bool))
    return found, np.array(counts)


def _predict(model, label_name: str, score_name: str):
    def run(batches):
        fitted = model.value
        scorer = _Scorer(fitted) if fitted else None
        for batch in batches:
            for piece in pieces(batch, "text"):
                texts = [x or "" for x in string_column(piece, "text").to_pylist()]
                label, value = [UNKNOWN] * len(texts), [0.0] * len(texts)
                if fitted:
                    if scorer.full():
                        scorer = _Scorer(fitted)
                    found, counts = word_marginals(texts, scorer)
                    ends = np.cumsum(counts)
                    for i, (end, n) in enumerate(zip(ends, counts, strict=True)):
                        if n and _lettered(texts[i]):
                            mean = found[end - n : end].mean(axis=0)
                            best = int(mean.argmax())
                            label[i], value[i] = fitted.labels[best], float(min(1.0, mean[best]))
                yield replaced(piece, **{label_name: pa.array(label, pa.string()), score_name: pa.array(value, pa.float64())})

    return run


def _label_words(model):
    def run(batches):
        fitted = model.value
        for batch in batches:
            for piece in pieces(batch, "text"):
                texts = [x or "" for x in string_column(piece, "text").to_pylist()]
                out = []
                if fitted:
                    found, _ = word_marginals(texts, _Scorer(fitted))
                    best, at = found.argmax(axis=1), 0
                    for text in texts:
                        rows = []
                        for word in re.finditer(r"\S+", text):
                            k = int(best[at])
                            rows.append((word.start(), word.end(), fitted.labels[k], float(found[at, k])))
                            at += 1
                        out.append(rows)
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("p", pa.float64())]))
                rows = [[dict(zip(("start", "end", "lang", "p"), r, strict=True)) for r in x] for x in out or [[]] * len(texts)]
                yield replaced(piece, words=pa.array(rows, kind))

    return run


def train(docs: DataFrame) -> Model | None:
    """Fit on documents outside the held-out quarter that have a language and a text."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    keys = usable.where("doc_id is not null").select("doc_id", "lang")
    picked = smallest_hashes(keys, "lang", "doc_id", DOCS_PER_LANGUAGE).select("doc_id").distinct()
    words = F.split(F.trim("line"), r"\s+")
    begin = F.pmod(F.xxhash64("line"), F.greatest(F.size(words) - TRAIN_WORDS + 1, F.lit(1))).cast("int") + 1
    some_words = F.array_join(F.slice(words, begin, TRAIN_WORDS), " ")
    lines = (
        usable.join(F.broadcast(picked), "doc_id", "left_semi")
        .select("lang", F.explode(F.split("text", "\n")).alias("line"))
        .where(F.col("line").rlike(r"\p{L}"))
        .select("lang", some_words.alias("line"))
        .where((F.char_length("line") <= TRAIN_CHARS) & F.col("line").rlike(r"\p{L}"))
        .orderBy(F.xxhash64("line"), "line", "lang").limit(TRAIN_LINES)
    )
    return fit([(r["lang"], r["line"]) for r in lines.toLocalIterator()])


def identify(docs: DataFrame, model: Model | None, label: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """The documents with two columns set: the language of the text and its mean probability, 0 to 1.

    The language is ``und`` with score 0 if the text is null or has no letter, or if there is no model. All other
    columns, and repeated rows, stay as they are; columns of the two names are replaced.
    """
    schema = with_fields(docs, StructField(label, StringType()), StructField(score, DoubleType()))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_batches(docs, _predict(shared, label, score), schema)


def label_words(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, words): each word's start, end (code points), language and probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, text string, words array<struct<start:int,end:int,lang:string,p:double>>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, _label_words(shared), schema).drop("text")


def op1(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; see ``identify`` for nulls and empty texts."""
    narrow = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    schema = with_fields(narrow, StructField("held_out", BooleanType()))
    assert schema.names[-1] == "held_out"
    found = identify(narrow, train(docs), "lang_pred", "score")
    return found.select("doc_id", "held_out", "lang_pred", "score")
