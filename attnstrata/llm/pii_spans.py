"""Personal data in texts: fixed patterns, and a semi-Markov conditional random field that adds spans.

The field works on runs of pieces that hold a digit or ``@``. It scores whole candidate segments of up to
``SEGMENT_PIECES`` pieces by features of the span as a whole (its shape, digits, checksum, number ranges, the word before it) and
jointly picks boundaries and kinds by dynamic programming; a segment without a kind is one piece. It is fitted, with numpy, on a bounded
sample of ``TRAIN_RUNS`` runs (the smallest hashes of their content) that the patterns, and for secrets a
simple teacher, have labelled. Prediction reads every text whole.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from attnstrata.llm.common import map_batches, pieces, replaced, string_column
from attnstrata.llm.wordhash import raw_bytes

#: Kinds of the patterns, in the order of reports, then the kind that only the field finds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
NONE = len(KINDS)
SEGMENT_PIECES, BUCKETS = 6, 1 << 14
TRAIN_RUNS, PASSES, RATE, PENALTY = 3000, 6, 0.3, 1e-3

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SEED = re.compile(r"[0-9@]+")
_STOP = frozenset(" \t\n\x0b\x0c\r=:\"'<>|,;*#$%&!")
_SHAPES = ((re.compile(r"[0-9]+"), "d"), (re.compile(r"[A-Z]+"), "A"), (re.compile(r"[a-z]+"), "a"))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _byte(number: str) -> bool:
    number = number.lstrip("0")
    return len(number) <= 3 and int(number or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns, by kind and place; a match that fails its test is dropped."""
    out = []
    if "@" in text:
        # an address lies in one run of the characters it may have, so only runs around @ are searched
        at = text.find("@")
        while at >= 0:
            start, end = at, at + 1
            while start and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-@")):
                start -= 1
            while end < len(text) and (text[end].isascii() and (text[end].isalnum() or text[end] in "._%+-@")):
                end += 1
            out += [(0, m.start(), m.end()) for m in _EMAIL.finditer(text, start, end)]
            at = text.find("@", end)
    if _SEED.search(text):
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(map(_byte, m[0].split(".")))]
        for m in _CARD.finditer(text):
            digits = _digits(m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def runs(text: str) -> list[tuple[str, list[tuple[int, int]]]]:
    """Runs of pieces with a digit or ``@``, a single space between them: the word before, and (start, end) of each piece."""
    found: list[tuple[str, list[tuple[int, int]]]] = []
    done, size = 0, len(text)
    for seed in _SEED.finditer(text):
        start, end = seed.span()
        if start < done:
            continue
        while start > done and text[start - 1] not in _STOP:
            start -= 1
        while end < size and text[end] not in _STOP:
            end += 1
        done = end
        if found and found[-1][1][-1][1] == start - 1 and text[start - 1] == " ":
            found[-1][1].append((start, end))
        else:
            before = re.search(r"([^\W\d_]+)[^\w]*\Z", text[max(0, start - 40) : start])
            found.append((before[1].lower() if before else "", [(start, end)]))
    return found


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """The span without signs at its ends that no entity begins or ends with."""
    while start < end and not (text[start].isalnum() or text[start] == "+" or text[start] == "(" and ")" in text[start:end]):
        start += 1
    while end > start and not text[end - 1].isalnum():
        end -= 1
    return start, end


def segment_features(text: str, before: str, count: int) -> list[int]:
    """Buckets of the features of a segment's trimmed text."""
    exact, coarse = _SHAPES[0][0].sub(lambda m: f"d{min(len(m[0]), 20)}", text), text
    for pattern, sign in _SHAPES:
        coarse = pattern.sub(sign, coarse)
    digits = _digits(text)
    letters = sum(c.isalpha() for c in text)
    parts = text.split(".")
    numeric = len(parts) == 4 and all(p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts)
    names = [
        "bias", f"exact {exact if letters < 3 else len(text)}", f"coarse {coarse[:24]}", f"count {count}",
        f"digits {min(len(digits), 20)} {letters > 0}", f"before {before}", f"size {min(len(text) // 4, 12)}",
        f"at {text.count('@')} {'.' in text.partition('@')[2]}", f"plus {text[:1] == '+'} {7 < len(digits) < 16}",
        f"numbers {numeric}", f"mixed {letters > 0 and len(digits) > 1 and len(text) > 15 and '@' not in text} {text.isalnum()}",
        f"sum {15 < len(digits) < 20 and not letters and luhn(digits)}",
    ]
    return [zlib.crc32(name.encode("utf-8", "replace")) % BUCKETS for name in names]


@dataclass
class Model:
    weights: np.ndarray  # BUCKETS x (kinds + none)
    follow: np.ndarray  # kind before x kind


def _segments(text: str, before: str, spans: list[tuple[int, int]]) -> dict[tuple[int, int], list[int]]:
    """Feature buckets of all segments (first piece, one past the last)."""
    out = {}
    for i in range(len(spans)):
        for j in range(i + 1, min(len(spans), i + SEGMENT_PIECES) + 1):
            start, end = trimmed(text, spans[i][0], spans[j - 1][1])
            out[i, j] = segment_features(text[start:end], before if i == 0 else "\x00", j - i)
    return out


def _scores(model: Model, segments) -> dict[tuple[int, int], np.ndarray]:
    out = {}
    for (i, j), ids in segments.items():
        out[i, j] = score = model.weights[ids].sum(axis=0)
        if j - i > 1:
            score[NONE] = -np.inf  # what is no entity is one piece
    return out


def decode(model: Model, text: str, before: str, spans: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """The best segmentation's entities: (kind, start, end), trimmed."""
    n = len(spans)
    scores = _scores(model, _segments(text, before, spans))
    best = np.full((n + 1, NONE + 1), -np.inf)
    back: dict[tuple[int, int], tuple[int, int]] = {}
    for j in range(1, n + 1):
        for i in range(max(0, j - SEGMENT_PIECES), j):
            if i == 0:
                prior, source = np.zeros(NONE + 1), np.full(NONE + 1, -1)
            else:
                options = best[i][:, None] + model.follow
                prior, source = options.max(axis=0), options.argmax(axis=0)
            total = prior + scores[i, j]
            for y in np.flatnonzero(total > best[j]):
                best[j, y] = total[y]
                back[j, int(y)] = (i, int(source[y]))
    out, j, y = [], n, int(best[n].argmax())
    while j > 0:
        i, source = back[j, y]
        if y != NONE:
            start, end = trimmed(text, spans[i][0], spans[j - 1][1])
            if end > start:
                out.append((y, start, end))
        j, y = i, source
    return out[::-1]


def _gold(text: str, spans: list[tuple[int, int]], known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]] | None:
    """A run's segments (first, one past last, kind) as labelled by the patterns; none if they do not settle it."""
    out, i = [], 0
    while i < len(spans):
        hit = None
        for j in range(min(len(spans), i + SEGMENT_PIECES), i, -1):
            inside = trimmed(text, spans[i][0], spans[j - 1][1])
            hit = next((k for k, a, b in known if (a, b) == inside), None)
            if hit is not None:
                break
        if hit is None:
            j = i + 1
            start, end = trimmed(text, *spans[i])
            piece = text[start:end]
            digits = len(_digits(piece))
            if any(a < end and start < b for _, a, b in known) or digits > 12 and piece.isdigit():
                return None
            secret = len(piece) > 15 and piece.isalnum() and 1 < digits < len(piece)
            hit = KINDS.index("secret") if secret else NONE
        out.append((i, j, hit))
        i = j
    return out


def _training_runs(batches):
    """(text, before, pieces as a flat list, gold as a flat list) of labelled runs; offsets are within the run's text."""
    for batch in batches:
        for piece in pieces(batch, "text"):
            rows = []
            for text in _with_seeds(piece):
                known = base_spans(text)
                for before, spans in runs(text):
                    a, b = spans[0][0], spans[-1][1]
                    near = [(k, s - a, e - a) for k, s, e in known if s < b and a < e]
                    local = [(s - a, e - a) for s, e in spans]
                    gold = _gold(text[a:b], local, near)
                    if gold is not None and len(spans) < 40:
                        rows.append((text[a:b], before, [x for s in local for x in s], [x for g in gold for x in g]))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = [pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["run", "before", "spans", "gold"]
            )


def _seeded(piece: pa.RecordBatch) -> np.ndarray:
    """Whether each text has a digit or ``@``."""
    data, offsets = raw_bytes(string_column(piece, "text"))
    counts = np.r_[0, np.cumsum(((data >= 48) & (data <= 57)) | (data == 64))]
    return counts[offsets[1:]] > counts[offsets[:-1]]


def _with_seeds(piece: pa.RecordBatch) -> list[str]:
    return string_column(piece, "text").filter(pa.array(_seeded(piece))).to_pylist()


def fit(rows: list[tuple[str, str, list[int], list[int]]], passes: int = PASSES) -> Model | None:
    """A model from labelled runs by gradient steps on their likelihood; none without runs."""
    if not rows:
        return None
    model = Model(np.zeros((BUCKETS, NONE + 1)), np.zeros((NONE + 1, NONE + 1)))
    squares, follow_squares = np.full_like(model.weights, 1e-2), np.full_like(model.follow, 1e-2)
    rng = np.random.default_rng(11)
    prepared = []
    for text, before, flat, gold in rows:
        spans = list(zip(flat[::2], flat[1::2], strict=True))
        prepared.append((len(spans), _segments(text, before, spans), list(zip(gold[::3], gold[1::3], gold[2::3], strict=True))))
    for _ in range(passes):
        for at in rng.permutation(len(prepared)):
            n, segments, gold = prepared[at]
            scores = _scores(model, segments)
            ahead = np.full((n + 1, NONE + 1), -np.inf)
            for j in range(1, n + 1):
                terms = []
                for i in range(max(0, j - SEGMENT_PIECES), j):
                    prior = np.zeros(NONE + 1) if i == 0 else np.logaddexp.reduce(ahead[i][:, None] + model.follow, axis=0)
                    terms.append(prior + scores[i, j])
                ahead[j] = np.logaddexp.reduce(terms, axis=0)
            behind = np.full((n + 1, NONE + 1), -np.inf)
            behind[n] = 0
            for i in range(n - 1, 0, -1):
                terms = [
                    np.logaddexp.reduce(model.follow + (scores[i, j] + behind[j])[None, :], axis=1)
                    for j in range(i + 1, min(n, i + SEGMENT_PIECES) + 1)
                ]
                behind[i] = np.logaddexp.reduce(terms, axis=0)
            whole = np.logaddexp.reduce(ahead[n])
            slope_follow = np.zeros_like(model.follow)
            truth = {(i, j): y for i, j, y in gold}
            for (i, j), ids in segments.items():
                prior = np.zeros(NONE + 1) if i == 0 else np.logaddexp.reduce(ahead[i][:, None] + model.follow, axis=0)
                slope = -np.exp(prior + scores[i, j] + behind[j] - whole)
                if (i, j) in truth:
                    slope[truth[i, j]] += 1
                if i > 0:
                    slope_follow -= np.exp(ahead[i][:, None] + model.follow + (scores[i, j] + behind[j])[None, :] - whole)
                unique = np.unique(ids)
                step = slope - PENALTY * model.weights[unique]
                squares[unique] += step**2
                model.weights[unique] += RATE * step / np.sqrt(squares[unique])
            for (_, _, y), (_, _, z) in zip(gold, gold[1:], strict=False):
                slope_follow[y, z] += 1
            follow_squares += slope_follow**2
            model.follow += RATE * slope_follow / np.sqrt(follow_squares)
    return model


def train(docs: DataFrame) -> Model | None:
    """Fit on a bounded sample of the labelled runs of all documents."""
    rows = map_batches(
        docs.select(F.col("text").cast("string").alias("text")), _training_runs,
        "run string, before string, spans array<int>, gold array<int>",
    )
    sample = rows.orderBy(F.xxhash64("run", "before"), "run", "before").limit(TRAIN_RUNS)
    return fit([(r["run"], r["before"], r["spans"], r["gold"]) for r in sample.toLocalIterator()])


def find(text: str, model: Model | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, spans that the field adds): (kind, start, end) by kind and place. Added spans touch no base span."""
    base = base_spans(text)
    added = []
    if model is not None:
        taken = sorted((a, b) for _, a, b in base)
        for before, spans in runs(text):
            a, b = spans[0][0], spans[-1][1]
            if any(s <= a and b <= e for s, e in taken):
                continue
            local = [(s - a, e - a) for s, e in spans]
            for kind, s, e in decode(model, text[a:b], before, local):
                if all(e + a <= x or y <= s + a for x, y in taken):
                    added.append((kind, s + a, e + a))
    return sorted(base), sorted(added)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def _report(model):
    def run(batches):
        fitted = model.value
        empty = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            for piece in pieces(batch, "text"):
                seeded = _seeded(piece)
                counts = np.zeros((piece.num_rows, len(BASE)), dtype=np.int64)
                digests, spans = [empty] * piece.num_rows, [""] * piece.num_rows
                texts = string_column(piece, "text")
                for i in np.flatnonzero(seeded).tolist():
                    base, added = find(texts[i].as_py(), fitted)
                    for k, _, _ in base:
                        counts[i, k] += 1
                    digests[i] = hashlib.sha256(_joined(base).encode()).hexdigest()
                    spans[i] = _joined(base + added)
                columns = {f"n_{kind}": pa.array(counts[:, k]) for k, kind in enumerate(BASE)}
                yield pa.RecordBatch.from_pydict({
                    "doc_id": piece.column(piece.schema.get_field_index("doc_id")), **columns,
                    "base_sha256": pa.array(digests), "spans": pa.array(spans),
                })

    return run


def op9(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row; null texts count as empty."""
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(train(rows))
    schema = StructType([rows.schema["doc_id"]])
    for kind in BASE:
        schema = schema.add(f"n_{kind}", "long")
    return map_batches(rows, _report(model), schema.add("base_sha256", "string").add("spans", "string"))


def _redact(model):
    def run(batches):
        fitted = model.value
        for batch in batches:
            for piece in pieces(batch, "text"):
                texts = string_column(piece, "text").to_pylist()
                for i in np.flatnonzero(_seeded(piece)).tolist():
                    base, added = find(texts[i], fitted)
                    # where patterns of several kinds overlap, the place is blanked as a whole
                    out, done = [], 0
                    for kind, a, b in sorted(base + added, key=lambda s: (s[1], -s[2])):
                        if a >= done:
                            out += [texts[i][done:a], f"<{KINDS[kind].upper()}>"]
                        done = max(done, b)
                    texts[i] = "".join(out) + texts[i][done:]
                yield replaced(piece, text=pa.array(texts, pa.string()))

    return run


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets.

    Null texts stay null; all other columns, but ``n_chars`` if there is one, and repeated rows stay as they are.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs))
    schema = StructType([f for f in docs.schema.fields if f.name != "text"] + [StructField("text", StringType())])
    rows = map_batches(docs, _redact(model), schema)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)
