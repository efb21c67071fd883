"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into overlapping chunks that together cover all of it. Every
chunk's bytes are embedded, learned filters run over them, and each filter's
largest response in the chunk is kept (max pooling; the overlap is a filter's
width, so no window is lost at a cut). Mean, largest and smallest of the
chunks' responses are combined into one probability.

Training (Adam, on the driver) uses a bounded sample: ``per_class`` labelled
rows of each class, in the order of a hash of their ids, each with all of its
chunks, as in scoring. The texts come one partition at a time and wait in a
temporary file of the driver; a step reads a group of chunks at a time, so
memory stays small however long they are. Only bytes are inputs. Classes are
weighted back to their share among all labels, so scores are probabilities.
The model is a few kilobytes and travels with the scoring tasks; every row is
scored on its whole text, without a shuffle.

Defined cases: null and empty texts are one chunk of padding and get its
score; a very long text is scored chunk by chunk in bounded memory; labels
that contradict each other for an id are not used, nor are labels without a
row; repeated rows get equal scores (to six decimals); without labels of both classes every
score is the share of label 1 (0.5 without any).
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_worker_tables, ship_package, text_blocks
from .jaccard_matrix import free_names

WIDTH, STRIDE, STEP = 8, 2, 512  # bytes of a filter, between windows, between chunks
SPAN = STEP + WIDTH - STRIDE  # bytes of a chunk
DEPTH, FILTERS = 8, 32
GROUP = 256  # chunks that are computed together
HELD = 64 * GROUP  # chunks of a training step whose responses are held; with more they are computed twice


def chunk_starts(n_bytes: int) -> np.ndarray:
    return np.arange(max(1, -(-max(0, n_bytes - WIDTH + STRIDE) // STEP))) * STEP


def chunk_bytes(raw: bytes, starts: np.ndarray) -> np.ndarray:
    """(chunks, SPAN) bytes; zeros after the text's end."""
    buffer = np.zeros(int(starts[-1]) + SPAN, np.uint8)
    part = np.frombuffer(raw, np.uint8)[: len(buffer)]
    buffer[: len(part)] = part
    return np.lib.stride_tricks.sliding_window_view(buffer, SPAN)[starts]


@dataclass
class ByteCnn:
    """Parameters by name; ``prior`` is the answer of a model that could not be trained."""

    prior: float = 0.5
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def start(self, seed: int) -> ByteCnn:
        rng = np.random.default_rng(seed)
        f32 = np.float32
        self.p = {
            "embed": rng.normal(0, 0.5, (256, DEPTH)).astype(f32),
            "filter": rng.normal(0, (WIDTH * DEPTH) ** -0.5, (WIDTH * DEPTH, FILTERS)).astype(f32),
            "bias": np.zeros(FILTERS, f32),
            "combine": rng.normal(0, 0.1, 3 * FILTERS).astype(f32),
            "offset": np.zeros(1, f32),
        }
        return self

    def windows(self, chunks: np.ndarray) -> np.ndarray:
        """(chunks * windows, WIDTH * DEPTH) embedded bytes."""
        embedded = self.p["embed"][chunks].reshape(len(chunks), SPAN * DEPTH)
        rows = np.lib.stride_tricks.sliding_window_view(embedded, WIDTH * DEPTH, axis=1)[:, :: STRIDE * DEPTH]
        return rows.reshape(-1, WIDTH * DEPTH)

    def responses(self, chunks: np.ndarray, places: bool = False):
        """(chunks, FILTERS) largest responses; with ``places`` the windows they come from too."""
        out, at = np.empty((len(chunks), FILTERS), np.float32), np.empty((len(chunks), FILTERS), np.int64)
        for i in range(0, len(chunks), GROUP):
            part = chunks[i : i + GROUP]
            response = (self.windows(part) @ self.p["filter"]).reshape(len(part), -1, FILTERS)
            out[i : i + GROUP] = response.max(axis=1)
            if places:
                at[i : i + GROUP] = response.argmax(axis=1)
        out = np.tanh(out + self.p["bias"]).astype(np.float32)
        return (out, at) if places else out

    def probability(self, pooled: np.ndarray) -> np.ndarray:
        z = pooled.astype(np.float64) @ self.p["combine"] + self.p["offset"][0]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def score(self, raws: list[bytes]) -> np.ndarray:
        if not self.p:
            return np.full(len(raws), self.prior)
        pooled = np.empty((len(raws), 3 * FILTERS), np.float32)
        starts = [chunk_starts(len(r)) for r in raws]
        short = [i for i, s in enumerate(starts) if len(s) <= 4 * GROUP]
        if short:
            chunks = np.concatenate([chunk_bytes(raws[i], starts[i]) for i in short])
            first = np.cumsum([0, *(len(starts[i]) for i in short[:-1])])
            pooled[short] = pool(self.responses(chunks), first)
        for i in set(range(len(raws))) - set(short):
            pooled[i] = self.pool_long(raws[i], starts[i])
        return self.probability(pooled).round(6)

    def pool_long(self, raw: bytes, starts: np.ndarray) -> np.ndarray:
        """The same for one long text, a group of chunks at a time."""
        total, high, low = np.zeros(FILTERS), np.full(FILTERS, -np.inf), np.full(FILTERS, np.inf)
        for i in range(0, len(starts), GROUP):
            some = starts[i : i + GROUP]
            response = self.responses(chunk_bytes(raw[some[0] : some[-1] + SPAN], some - some[0]))
            total += response.sum(axis=0)
            high, low = np.maximum(high, response.max(axis=0)), np.minimum(low, response.min(axis=0))
        return np.concatenate([total / len(starts), high, low])

    def gradients(self, chunks: np.ndarray, first: np.ndarray, labels: np.ndarray, weights: np.ndarray):
        """Loss gradients of a batch of texts; chunks of text i start at ``first[i]``."""
        return self.text_gradients(np.split(chunks, first[1:]), labels, weights)

    def text_gradients(self, texts: Sequence[np.ndarray], labels: np.ndarray, weights: np.ndarray):
        """The same for the (chunks, SPAN) bytes of each text, a group of chunks at a time."""
        sizes = np.array([len(t) for t in texts])
        total, high = np.zeros((len(texts), FILTERS)), np.full((len(texts), FILTERS), -np.inf, np.float32)
        low, held = -high, []
        for chunks, text in chunk_groups(texts):
            response, at = self.responses(chunks, places=True)
            first = np.flatnonzero(np.diff(text, prepend=-1))
            some = text[first]
            total[some] += np.add.reduceat(response, first)
            high[some] = np.maximum(high[some], np.maximum.reduceat(response, first))
            low[some] = np.minimum(low[some], np.minimum.reduceat(response, first))
            if sizes.sum() <= HELD:
                held.append((response, at))
        pooled = np.concatenate([total / sizes[:, None], high, low], axis=1).astype(np.float32)
        error = ((self.probability(pooled) - labels) * weights / weights.sum()).astype(np.float32)
        grad = {"combine": pooled.T @ error, "offset": error.sum(keepdims=True)}
        grad |= {k: np.zeros_like(self.p[k]) for k in ("bias", "filter", "embed")}
        back = error[:, None] * self.p["combine"].reshape(3, 1, FILTERS)
        taps = np.arange(WIDTH)
        for group, (chunks, text) in enumerate(chunk_groups(texts)):
            response, at = held[group] if held else self.responses(chunks, places=True)
            d = back[0][text] / sizes[text][:, None]
            d = d + back[1][text] * (response == high[text]) + back[2][text] * (response == low[text])
            d *= 1 - response**2
            grad["bias"] += d.sum(axis=0)
            # only the window with the largest response of a chunk and filter takes part
            bytes_at = chunks[np.arange(len(chunks))[:, None, None], at[:, :, None] * STRIDE + taps]
            embedded = self.p["embed"][bytes_at]
            grad["filter"] += np.einsum("cf,cftd->tdf", d, embedded, optimize=True).reshape(WIDTH * DEPTH, FILTERS)
            through = d[:, :, None, None] * self.p["filter"].reshape(WIDTH, DEPTH, FILTERS).transpose(2, 0, 1)[None]
            np.add.at(grad["embed"], bytes_at.ravel(), through.reshape(-1, DEPTH))
        return grad

    def train(self, texts: Sequence[np.ndarray], labels: np.ndarray, weights: np.ndarray, steps: int, seed: int, rate: float):
        """``texts``: (chunks, SPAN) bytes of each labelled text."""
        rng = np.random.default_rng(seed)
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        step, batch = 0, 48
        while step < steps:
            order = rng.permutation(len(texts))
            for i in range(0, min(len(texts), (steps - step) * batch), batch):
                some = order[i : i + batch]
                grad = self.text_gradients([texts[k] for k in some], labels[some], weights[some])
                step += 1
                speed = rate * min(1.0, 2 * (1 - (step - 1) / steps))
                for k, g in grad.items():
                    g = g + 1e-4 * self.p[k]
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    self.p[k] -= (speed * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


def chunk_groups(texts: Sequence[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(chunks, index of the text of each): all chunks of all texts, at most GROUP at a time."""
    parts, owners, held = [], [], 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            part = text[at : at + GROUP - held]
            parts.append(part)
            owners.append(np.full(len(part), i))
            at, held = at + len(part), held + len(part)
            if held == GROUP:
                yield np.concatenate(parts), np.concatenate(owners)
                parts, owners, held = [], [], 0
    if held:
        yield np.concatenate(parts), np.concatenate(owners)


def pool(response: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean, largest and smallest response of each text's chunks."""
    sizes = np.diff([*first, len(response)])[:, None]
    return np.concatenate(
        [
            np.add.reduceat(response, first) / sizes,
            np.maximum.reduceat(response, first),
            np.minimum.reduceat(response, first),
        ],
        axis=1,
    ).astype(np.float32)


def held_out(doc_id: Column) -> Column:
    """A fifth of the ids, never learned from. A null id is not one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train_classifier(
    docs: DataFrame,
    labels: DataFrame,
    per_class: int = 2000,
    steps: int = 400,
    seed: int = 7,
    rate: float = 0.01,
) -> ByteCnn:
    """A model of ``labels.quality`` learned from rows that are not held out."""
    ship_package(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id")
    known = known.agg(F.min("quality").alias("quality"), F.max("quality").alias("high")).where("quality = high")
    shares = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    shares = {q: shares.get(q, 0) for q in (0, 1)}
    prior = shares[1] / sum(shares.values()) if any(shares.values()) else 0.5
    if not all(shares.values()):
        return ByteCnn(prior)
    mixed = F.xxhash64("doc_id", F.lit(seed))
    sample = [known.where(F.col("quality") == q).orderBy(mixed, "doc_id").limit(per_class) for q in (0, 1)]
    sample = sample[0].union(sample[1]).select("doc_id", "quality")  # at most 2 * per_class ids

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("text").alias("text"))
    with tempfile.TemporaryFile() as file:
        rows = []  # (doc_id, quality, first byte, chunks)
        for r in texts.toLocalIterator():
            raw, at, n = r["text"].encode("utf-8", "surrogatepass"), file.tell(), 0
            starts = chunk_starts(len(raw))
            for i in range(0, len(starts), GROUP):
                some = starts[i : i + GROUP]
                n += len(some)
                file.write(chunk_bytes(raw[some[0] : some[-1] + SPAN], some - some[0]).tobytes())
            rows.append((r["doc_id"], r["quality"], at, n))
        file.flush()
        rows.sort()
        y = np.array([r[1] for r in rows], dtype=np.float64)
        if len(set(y.tolist())) < 2:
            return ByteCnn(prior)
        weights = np.where(y == 1, prior / max(1, (y == 1).sum()), (1 - prior) / max(1, (y == 0).sum())) * len(y)
        stored = np.memmap(file, np.uint8, "r")
        cuts = [stored[at : at + n * SPAN].reshape(n, SPAN) for _, _, at, n in rows]
        return ByteCnn(prior).start(seed).train(cuts, y, weights, steps, seed, rate)


def score_rows(docs: DataFrame, model: ByteCnn, columns: Sequence[str], name: str = "score") -> DataFrame:
    """The given columns of every row and the probability of label 1."""
    ship_package(docs.sparkSession)
    (scored,) = free_names(list(columns), "scored_text")
    source = docs.select(*(F.col(f"`{c}`") for c in columns), F.col("text").alias(scored))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_tables()
        for batch in batches:
            texts = (x.as_py() for x in batch.column(batch.num_columns - 1))  # a block of them at a time
            scores = [model.score(block) for _, block in text_blocks(texts)]
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            scores = pa.array(np.concatenate(scores) if scores else np.empty(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*kept, scores], [*columns, name])

    schema = docs.select(*(F.col(f"`{c}`") for c in columns), F.lit(0.0).alias(name)).schema
    return source.mapInArrow(run, schema)
