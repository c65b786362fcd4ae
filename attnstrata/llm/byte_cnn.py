"""Quality classifier: a byte-level convolutional network in numpy.

A text is a row of overlapping chunks of bytes that cover it whole. Each byte has a small learned vector and one fixed channel,
which tells whether the four bytes that end there also ended a few bytes before in the same text: whether bytes are equal is no
sum of what they are, so filters over single bytes can't learn it. Learned filters run over each chunk and are
max-pooled; the maximum and the mean over all chunks give one probability.

The network is fitted on a bounded sample: ``DOCS_PER_CLASS`` labelled documents for each label (the smallest hashes of their ids),
``TRAIN_CHUNKS`` chunks of each, spread over the text. Scores read every byte of every text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from attnstrata.llm.common import held_out, map_batches, pieces, replaced, smallest_hashes, string_column, with_fields
from attnstrata.llm.wordhash import raw_bytes

CHUNK, OVERLAP = 1024, 128
WIDTH, STRIDE, DEPTH, FILTERS = 8, 4, 6, 24
LAGS = range(2, 26)
DOCS_PER_CLASS, TRAIN_CHUNKS, EPOCHS, BATCH, RATE = 1000, 16, 10, 48, 0.01
CUT = 0.7
#: Chunks that go through the network at once.
AT_ONCE = 1024


@dataclass
class Model:
    bytes: np.ndarray  # 256 x DEPTH
    filters: np.ndarray  # WIDTH * (DEPTH + 1) x FILTERS
    shift: np.ndarray  # FILTERS
    output: np.ndarray  # 2 * FILTERS
    bias: float


def chunks(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of all texts (rows of bytes, zeros behind the end), their repeat channel, and each text's first chunk.

    An empty or null text is one chunk of zeros.
    """
    data, offsets = raw_bytes(texts)
    sizes = np.diff(offsets)
    again = np.zeros(len(data), dtype=bool)
    if len(data) > 4:
        place = np.arange(len(data)) - np.repeat(offsets[:-1], sizes)
        wide = data.astype(np.uint32)
        four = wide[3:] | wide[2:-1] << np.uint32(8) | wide[1:-2] << np.uint32(16) | wide[:-3] << np.uint32(24)
        for lag in LAGS:
            again[3 + lag :] |= (four[lag:] == four[:-lag]) & (place[3 + lag :] >= 3 + lag)  # both are of one text
    count = np.maximum(1, -(-(sizes - OVERLAP) // (CHUNK - OVERLAP)))
    first = np.r_[0, np.cumsum(count)]
    text = np.repeat(np.arange(len(sizes)), count)
    start = offsets[text] + (np.arange(first[-1]) - first[text]) * (CHUNK - OVERLAP)
    room = np.minimum(CHUNK, offsets[text + 1] - start)
    padded = np.r_[data, np.zeros(CHUNK, np.uint8)]
    repeat = np.r_[again, np.zeros(CHUNK, bool)]
    at = np.lib.stride_tricks.sliding_window_view
    inside = np.arange(CHUNK) < room[:, None]
    return at(padded, CHUNK)[start] * inside, at(repeat, CHUNK)[start] & inside, first


def _blocks(model: Model, rows: np.ndarray, repeat: np.ndarray) -> np.ndarray:
    """Channels in blocks of STRIDE bytes."""
    values = np.empty((*rows.shape, DEPTH + 1), dtype=np.float32)
    values[..., :DEPTH] = model.bytes[rows]
    values[..., DEPTH] = repeat
    return values.reshape(len(rows), CHUNK // STRIDE, STRIDE * (DEPTH + 1))


def pooled(model: Model, rows: np.ndarray, repeat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each filter's maximum over a chunk, and the block where it is; negative ones count as zero."""
    out, at = np.empty((len(rows), FILTERS), np.float32), np.empty((len(rows), FILTERS), np.int64)
    half = STRIDE * (DEPTH + 1)
    for i in range(0, len(rows), AT_ONCE):
        blocks = _blocks(model, rows[i : i + AT_ONCE], repeat[i : i + AT_ONCE])
        found = blocks[:, :-1] @ model.filters[:half]
        found += blocks[:, 1:] @ model.filters[half:]
        at[i : i + AT_ONCE] = best = found.argmax(axis=1)
        out[i : i + AT_ONCE] = np.take_along_axis(found, best[:, None], axis=1)[:, 0]
    out += model.shift
    return np.maximum(out, 0), at


def _combine(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Maximum and mean over each text's chunks."""
    most = np.maximum.reduceat(values, first[:-1], axis=0)
    mean = np.add.reduceat(values, first[:-1], axis=0) / np.diff(first)[:, None]
    return np.concatenate([most, mean], axis=1)


def probabilities(model: Model, texts: pa.Array) -> np.ndarray:
    if not len(texts):
        return np.zeros(0)
    rows, repeat, first = chunks(texts)
    total = _combine(pooled(model, rows, repeat)[0], first) @ model.output + model.bias
    return 1 / (1 + np.exp(-np.clip(total.astype(np.float64), -30, 30)))


def spread(first: np.ndarray) -> list[np.ndarray]:
    """Up to ``TRAIN_CHUNKS`` chunks of each text, spread over it."""
    return [
        np.unique(np.linspace(a, b - 1, min(b - a, TRAIN_CHUNKS)).astype(np.int64)) for a, b in zip(first[:-1], first[1:], strict=True)
    ]


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 5) -> Model | None:
    """A network from labelled texts; none without texts."""
    rows, repeat, first = chunks(pa.array(texts, pa.string()))
    picks = spread(first)
    use = np.concatenate(picks) if picks else np.zeros(0, np.int64)
    return fit_chunks(rows[use], repeat[use], np.array([len(p) for p in picks], dtype=np.int64), labels, epochs, seed)


def fit_chunks(
    rows: np.ndarray, repeat: np.ndarray, counts: np.ndarray, labels: list[int], epochs: int = EPOCHS, seed: int = 5
) -> Model | None:
    """A network from chunks, their repeat channel, and how many each labelled text has. Classes weigh the same."""
    if not len(counts):
        return None
    first = np.r_[0, np.cumsum(counts)]
    picks = [np.arange(a, b) for a, b in zip(first[:-1], first[1:], strict=True)]
    rng = np.random.default_rng(seed)
    model = Model(
        rng.normal(0, 0.5, (256, DEPTH)).astype(np.float32),
        rng.normal(0, 0.25, (WIDTH * (DEPTH + 1), FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS, np.float32), 0.0,
    )
    goal = np.array(labels, dtype=np.float64)
    share = goal.mean()
    weight = np.where(goal == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
    names = ("bytes", "filters", "shift", "output")
    mean = {n: np.zeros_like(getattr(model, n)) for n in names}
    square = {n: np.zeros_like(getattr(model, n)) for n in names}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(counts))
        for i in range(0, len(order), BATCH):
            docs = order[i : i + BATCH]
            use = np.concatenate([picks[d] for d in docs])
            begin = np.r_[0, np.cumsum([len(picks[d]) for d in docs])]
            x, r = rows[use], repeat[use]
            values, at = pooled(model, x, r)
            joint = _combine(values, begin)
            miss = (1 / (1 + np.exp(-(joint @ model.output + model.bias))) - goal[docs]) * weight[docs] / len(docs)
            slope = {"output": joint.T @ miss + 1e-4 * model.output}
            back = miss[:, None] * model.output[None, :]
            held = np.diff(begin)
            owner = np.repeat(np.arange(len(docs)), held)
            most = joint[:, :FILTERS][owner]
            down = back[owner, FILTERS:] / held[owner][:, None] + back[owner, :FILTERS] * (values == most)
            down = np.where(values > 0, down, 0).astype(np.float32)
            slope["shift"] = down.sum(axis=0)
            place = at[:, :, None] * STRIDE + np.arange(WIDTH)
            seen = x[np.arange(len(x))[:, None, None], place]
            inputs = np.empty((*seen.shape, DEPTH + 1), np.float32)
            inputs[..., :DEPTH] = model.bytes[seen]
            inputs[..., DEPTH] = r[np.arange(len(x))[:, None, None], place]
            inputs = inputs.reshape(len(x), FILTERS, -1)
            slope["filters"] = np.einsum("nf,nfk->kf", down, inputs)
            to_bytes = (down[:, :, None] * model.filters.T[None]).reshape(*seen.shape, DEPTH + 1)[..., :DEPTH]
            flat = seen.ravel()
            slope["bytes"] = np.stack(
                [np.bincount(flat, to_bytes[..., d].ravel(), 256) for d in range(DEPTH)], axis=1
            )
            step += 1
            rate = RATE * (1 - 0.9 * epoch / epochs)
            for n in names:
                g = slope[n].astype(np.float32)
                mean[n] += 0.1 * (g - mean[n])
                square[n] += 0.01 * (g * g - square[n])
                now = getattr(model, n)
                now -= rate * (mean[n] / (1 - 0.9**step)) / (np.sqrt(square[n] / (1 - 0.99**step)) + 1e-6)
            model.bias -= rate * 5 * float(miss.sum())
    # Classes weighed the same: the whole log odds of the labels' shares would give probabilities under those shares, none those
    # under even ones. Half of them is between, as the share of each label among unlabelled texts is not known.
    model.bias += float(np.log(max(share, 1e-3) / max(1 - share, 1e-3))) / 2
    return model


def _pick_chunks(batches):
    """Rows (id, label, chunks, repeats) with the chunks that training uses."""
    for batch in batches:
        for piece in pieces(batch, "text", 1 << 20):
            rows, repeat, first = chunks(string_column(piece, "text"))
            picks = spread(first)
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column(piece.schema.get_field_index("id")), piece.column(piece.schema.get_field_index("label")),
                    pa.array([rows[p].tobytes() for p in picks], pa.binary()), pa.array([np.packbits(repeat[p]).tobytes() for p in picks], pa.binary()),
                ],
                names=["id", "label", "chunks", "repeats"],
            )


def train(docs: DataFrame, labels: DataFrame, target: str = "quality") -> Model | None:
    """Fit on labelled documents outside the held-out quarter.

    An id with several labels is used with the largest, one with several texts with the first of them. Only the chunks in use go to the
    driver: ``TRAIN_CHUNKS`` of 1 KB for each of ``DOCS_PER_CLASS`` documents a label, however long their texts.
    """
    known = (
        labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(target).cast("int").alias("label"))
    )
    ids = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id")).distinct()
    picked = smallest_hashes(known.join(ids, "id", "left_semi"), "label", "id", DOCS_PER_CLASS)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(picked.select("id", "label")), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    found = map_batches(rows, _pick_chunks, "id long, label int, chunks binary, repeats binary").orderBy("id").toArrow()
    counts = np.array([len(x) // CHUNK for x in found["chunks"].to_pylist()], dtype=np.int64)
    if not len(counts):
        return None
    chunk_rows = np.frombuffer(b"".join(found["chunks"].to_pylist()), dtype=np.uint8).reshape(-1, CHUNK)
    repeat = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8)) for x in found["repeats"].to_pylist()]).astype(bool).reshape(-1, CHUNK)
    return fit_chunks(chunk_rows, repeat, counts, found["label"].to_pylist())


def _score(model, out: str):
    def run(batches):
        fitted = model.value
        for batch in batches:
            for piece in pieces(batch, "text", 1 << 20):
                found = probabilities(fitted, string_column(piece, "text")) if fitted else np.full(piece.num_rows, 0.5)
                yield replaced(piece, **{out: pa.array(found, pa.float64())})

    return run


def score(docs: DataFrame, model: Model | None, out: str = "score") -> DataFrame:
    """The documents with the probability of label 1 in ``out``; 0.5 if there is no model.

    Null and empty texts get the network's value for no bytes. Other columns and repeated rows stay as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_batches(docs, _score(shared, out), with_fields(docs, StructField(out, DoubleType())))


def op8(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; null and empty texts, repeated rows and an absent model as in ``score``."""
    model = train(docs, labels)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return score(rows, model).select(
        "doc_id", "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )
