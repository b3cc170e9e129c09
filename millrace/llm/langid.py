"""Language identification with a bidirectional gated recurrent network over bytes, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import blocks, ship, tidied, utf8

#: Hidden units in each direction, and the bytes that one chunk of a text has: each is read from a zero state.
HIDDEN, CHUNK = 8, 128
#: Training sample: documents for each language (those of least hash), segments of each, documents in all unless there are more languages.
PER_LANGUAGE, SEGMENTS, SAMPLE = 400, 4, 25_600
STEPS, BATCH, RATE = 240, 192, 0.02
#: Chunks that go through the network side by side.
COLUMNS = 4096
UNDETERMINED = "und"
LETTER = regex.compile(r"\p{L}")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class Direction:
    """A gated unit: `table` has the input's share of the three gates for each byte, `within` the state's."""

    table: np.ndarray  # (3H, 256)
    within: np.ndarray  # (3H, H)

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        n = len(h)
        a, u = self.table[:, x], self.within @ h
        gates = a[: 2 * n] + u[: 2 * n]
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates += 1
        gates *= 0.5
        z, r = gates[:n], gates[n:]
        c = r * u[2 * n :]
        c += a[2 * n :]
        np.tanh(c, out=c)
        new = h - c
        new *= z
        new += c
        return new, z, r, c, u[2 * n :]


@dataclass
class Network:
    labels: list[str]
    forward: Direction
    backward: Direction
    out: np.ndarray  # (L, 2H)
    bias: np.ndarray  # (L, 1)

    def chunk_sums(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Label probabilities of every position, summed over each chunk: (L, chunks) for (T, chunks) bytes, longest chunks first."""
        hidden = self.out.shape[1] // 2
        active = [int(np.searchsorted(-lengths, -t, "left")) for t in range(len(x))]
        logits = []
        h = np.zeros((hidden, x.shape[1]), np.float32)
        for t, n in enumerate(active):
            h = self.forward.step(x[t, :n], h[:, :n])[0]
            logits.append(self.out[:, :hidden] @ h + self.bias)
        total = np.zeros((len(self.labels), x.shape[1]), np.float32)
        h = np.zeros((hidden, 0), np.float32)
        for t in range(len(x) - 1, -1, -1):
            n = active[t]
            if n > h.shape[1]:
                h = np.concatenate([h, np.zeros((hidden, n - h.shape[1]), np.float32)], axis=1)
            h = self.backward.step(x[t, :n], h)[0]
            y = logits[t]
            y += self.out[:, hidden:] @ h
            y -= y.max(axis=0)
            np.exp(y, out=y)
            y /= y.sum(axis=0)
            total[:, :n] += y
        return total

    def predict(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Pooled probabilities (texts, L): the mean over all positions of a text; NaN for empty texts."""
        sizes = np.diff(offsets)
        chunks = -(-sizes // CHUNK)
        owner = np.repeat(np.arange(len(sizes)), chunks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        begin = offsets[owner] + nth * CHUNK
        length = np.minimum(CHUNK, offsets[owner + 1] - begin) if len(owner) else np.zeros(0, np.int64)
        sums = np.zeros((len(sizes), len(self.labels)))
        order = np.argsort(-length, kind="stable")
        padded = np.concatenate([raw, np.zeros(CHUNK, np.uint8)])
        for at in range(0, len(order), COLUMNS):
            part = order[at : at + COLUMNS]
            x = padded[begin[part][None, :] + np.arange(length[part[0]])[:, None]]
            np.add.at(sums, owner[part], self.chunk_sums(x, length[part]).T)
        with np.errstate(invalid="ignore"):
            return sums / sizes[:, None]


def train(segments: list[bytes], targets: list[int], labels: list[str], seed: int = 5, steps: int = STEPS, hidden: int = HIDDEN) -> Network:
    """Backpropagation through time with Adam on the cross-entropy of every position."""
    rng = np.random.default_rng(seed)
    k = len(labels)
    init = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
    net = Network(labels, Direction(init(3 * hidden, 256), init(3 * hidden, hidden)), Direction(init(3 * hidden, 256), init(3 * hidden, hidden)), init(k, 2 * hidden), np.zeros((k, 1), np.float32))
    params = [net.forward.table, net.forward.within, net.backward.table, net.backward.within, net.out, net.bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    targets_ = np.array(targets)
    by_label = [np.flatnonzero(targets_ == i) for i in range(k)]
    width = 48
    for step in range(1, steps + 1):
        which = np.concatenate([rng.choice(rows, -(-BATCH // k)) for rows in by_label])
        x = np.zeros((width, len(which)), np.uint8)
        for col, i in enumerate(which.tolist()):
            s = segments[i]
            at = int(rng.integers(0, max(1, len(s) - width + 1)))
            piece = (s * (-(-width // len(s))))[at : at + width] if len(s) < width else s[at : at + width]
            x[:, col] = np.frombuffer(piece[:width].ljust(width), np.uint8)
        gold = targets_[which]
        grads = _gradients(net, x, gold)
        for p, g, m, v in zip(params, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def _gradients(net: Network, x: np.ndarray, gold: np.ndarray) -> list[np.ndarray]:
    hidden, (width, n) = net.out.shape[1] // 2, x.shape
    runs = []
    for d, times in ((net.forward, range(width)), (net.backward, range(width - 1, -1, -1))):
        h, kept = np.zeros((hidden, n), np.float32), {}
        for t in times:
            new, z, r, c, u = d.step(x[t], h)
            kept[t] = (h, new, z, r, c, u)
            h = new
        runs.append((d, list(times), kept))
    both = np.stack([np.concatenate([runs[0][2][t][1], runs[1][2][t][1]]) for t in range(width)])  # (T, 2H, N)
    y = net.out @ both + net.bias
    y -= y.max(axis=1, keepdims=True)
    np.exp(y, out=y)
    y /= y.sum(axis=1, keepdims=True)
    y[:, gold, np.arange(n)] -= 1
    y /= width * n
    grad_out = np.einsum("tln,thn->lh", y, both)
    grad_bias = y.sum(axis=(0, 2))[:, None]
    into = net.out.T @ y  # (T, 2H, N)
    grads = []
    for i, (d, times, kept) in enumerate(runs):
        table, within = np.zeros_like(d.table), np.zeros_like(d.within)
        back = np.zeros((hidden, n), np.float32)
        for t in reversed(times):
            h, _, z, r, c, u = kept[t]
            g = back + into[t, i * hidden : (i + 1) * hidden]
            dc = g * (1 - z) * (1 - c * c)
            dz = g * (h - c) * z * (1 - z)
            dr = dc * u * r * (1 - r)
            inner = np.concatenate([dz, dr, dc])
            np.add.at(table.T, x[t], inner.T)
            state = np.concatenate([dz, dr, dc * r])
            within += state @ h.T
            back = g * z + d.within.T @ state
        grads += [table, within]
    return [*grads, grad_out, grad_bias]


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = PER_LANGUAGE, sample: int = SAMPLE) -> tuple[list[bytes], list[int], list[str]]:
    """Segments of documents of every label, none of them held out: at most `per_language` documents of each, fewer where labels are many and `sample` would be exceeded, one at least."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang IS NOT NULL").where(~held_out(F.col("id")))
    usable = own.where("length(text) > 0")
    counts = usable.groupBy("lang").count().collect()
    if not counts:
        return [], [], []
    each = max(1, min(per_language, sample // len(counts)))
    draw = F.pmod(F.xxhash64(F.lit("draw"), "id", F.substring("text", 1, 200)), F.lit(1 << 30))
    shares = [(r["lang"], min(1.0, (1.3 * each + 20) / r["count"]) * (1 << 30)) for r in counts]
    shares = F.broadcast(docs.sparkSession.createDataFrame(shares, "lang string, share double"))
    size = 4 * CHUNK
    starts = [F.pmod(F.xxhash64(F.lit(i), "id"), F.greatest(F.lit(1), F.length("text") - size)) + 1 for i in range(SEGMENTS)]
    parts = F.array(*[F.substring("text", s, F.lit(size)) for s in starts]).alias("parts")
    drawn = usable.join(shares, "lang").withColumn("place", draw / F.col("share")).where("place <= 1").select("lang", "place", parts)
    rows = drawn.orderBy("place", "lang", "parts").limit(2 * (each + 40) * len(counts)).collect()
    missing = {r["lang"] for r in counts} - {r["lang"] for r in rows}
    if missing:  # copies of one text and id are drawn together or not at all
        rows += usable.where(F.col("lang").isin(sorted(missing))).groupBy("lang").agg(F.min(parts).alias("parts")).collect()
    labels, taken, segments, targets = sorted(r["lang"] for r in counts), {}, [], []
    for r in rows:
        taken[r["lang"]] = taken.get(r["lang"], 0) + 1
        if taken[r["lang"]] <= each:
            pieces = [p.encode() for p in dict.fromkeys(r["parts"]) if p]
            segments += pieces
            targets += [labels.index(r["lang"])] * len(pieces)
    seen = sorted(set(targets))
    return segments, [seen.index(t) for t in targets], [labels[i] for i in seen]


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    segments, targets, labels = training_sample(docs, id_col, text_col, lang_col)
    return train(segments, targets, labels) if segments else None


def classify(docs: DataFrame, network: Network | None, text_col: str, pred: str, score: str) -> DataFrame:
    """All rows and columns of docs, with the predicted language and its probability under the two names."""
    ship(docs.sparkSession)

    def run(source):
        for batch in source:
            preds, scores = [], []
            for block in blocks(iter([batch.select([text_col]).rename_columns(["text"])]), 1 << 21):
                texts = block.column("text")
                if network is not None:
                    p = network.predict(*utf8(texts))
                for i, text in enumerate(texts.to_pylist()):
                    if network is None or not text or not LETTER.search(text):
                        preds.append(UNDETERMINED)
                        scores.append(0.0)
                    else:
                        k = int(p[i].argmax())
                        preds.append(network.labels[k])
                        scores.append(float(min(1.0, p[i, k])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(preds, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, pred, score])

    schema = T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])
    return docs.mapInArrow(lambda source: tidied(run(source)), schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score): the language of each whole text.

    A network learned from a bounded sample of the labelled documents that aren't
    held out labels every byte; a text's probabilities are the mean over its bytes,
    score that of lang_pred. `und` with score 0: null or empty texts, texts without a
    letter, and all texts where nothing is labelled. A null id isn't held out.
    Repeated rows give a row each. Other columns are no input.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = classify(own, learn(docs, id_col, text_col, lang_col), "text", "lang_pred", "score")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "lang_pred", "score")
