"""Language-model scores: add-one unigrams, and a log-bilinear model trained by noise contrast, in numpy.

The neural model predicts a token's class from the classes of the two tokens
before it; a class is one of the commonest words, the end, or a bucket of other
words with like endings, within which words have their add-one share. So a
token's probability is normalised over all words, seen or not.

All it learns are counts over every training document: of each word, and of each
triple of classes. Both the words with a class of their own and the training grow
with the corpus: classes with the cube root of its tokens (`words_for`), so that a
triple keeps about as many tokens; and training goes over every triple. Up to BLOCK
triples are drawn from on the driver. Of more, the driver draws from about as many
to begin with, then tasks pass over all others where they lie, each triple with its
count as weight, and the tasks' parameters are averaged in ROUNDS rounds.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import blocks, keyed_text, materialize, outer_id, partitions, ship, tidied, utf8, word_bounds

#: Classes: WORDS common words at least, BUCKETS of endings, the end.
WORDS, BUCKETS = 191, 64
CLASSES, END = WORDS + BUCKETS + 1, WORDS + BUCKETS
#: Model and training: dimensions, steps, examples of a step and noise samples they share.
DIMENSIONS, STEPS, BATCH, NOISE, RATE = 24, 900, 4096, 96, 0.02
#: Triples that one place trains on, and rounds of averaging over larger corpora.
BLOCK, ROUNDS = STEPS * BATCH, 4
#: Tokens that share one dictionary, about.
SHARE = 3 << 19
#: Stands for the end of a text among words, which have no space.
END_WORD = " "


def words_for(tokens: int) -> int:
    """Words with a class of their own: WORDS up to a million training tokens, then with the cube root."""
    return max(WORDS, round(WORDS * (tokens / 1e6) ** (1 / 3)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def bucket(word: str) -> int:
    return zlib.crc32(word[-2:].encode()) % BUCKETS


def bucket_column(word: Column) -> Column:
    return F.crc32(F.right(word, F.lit(2)).cast("binary")) % BUCKETS


SHARES_DDL = "g long, ids array<long>, sizes array<int>, held array<boolean>, words array<string>, counts array<long>, tokens binary"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_in(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words, lower-cased in ASCII, and how many each text has."""
    raw, offsets = utf8(texts)
    starts, ends, cuts = word_bounds(raw, offsets)
    where = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    inside = (raw != 32) & ((raw - np.uint8(9)) > 4)
    dense = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(where), pa.py_buffer(_LOWER[raw[inside]])])
    return dense.dictionary_encode(), np.diff(cuts)


def tokenised(docs: DataFrame) -> DataFrame:
    """Shares of the corpus: their documents, distinct words with training counts, and all tokens as numbers into the words."""

    def run(source):
        part, nth, size = TaskContext.get().partitionId(), 0, 0
        words, n, ids, held = [], [], [], []

        def flush():
            coded = pa.chunked_array(words).unify_dictionaries().combine_chunks() if len(words) > 1 else words[0]
            coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
            sizes, names = np.concatenate(n), coded.dictionary.cast(pa.string())
            tokens = np.insert(coded.indices.to_numpy(), np.cumsum(sizes), len(names)).astype("<i4")
            out = np.concatenate(held)
            train = ~np.repeat(out, sizes + 1)
            one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            row = {
                "g": pa.array([part << 24 | nth]),
                "ids": one(pa.array(np.concatenate(ids))),
                "sizes": one(pa.array((sizes + 1).astype(np.int32))),
                "held": one(pa.array(out)),
                "words": one(pa.concat_arrays([names, pa.array([END_WORD])])),
                "counts": one(pa.array(np.bincount(tokens[train], minlength=len(names) + 1))),
                "tokens": pa.array([pa.compress(tokens.tobytes(), "zstd", asbytes=True)]),
            }
            return pa.RecordBatch.from_pydict(row)

        for block in blocks(source, 4 << 20):
            coded, sizes = words_in(block.column("text"))
            words.append(coded)
            n.append(sizes)
            ids.append(block.column("id").to_numpy())
            held.append(block.column("held").to_numpy(zero_copy_only=False))
            size += len(coded) + len(sizes)
            if size >= SHARE:
                yield flush()
                words, n, ids, held, size, nth = [], [], [], [], 0, nth + 1
        if ids:
            yield flush()

    own = docs.select("id", F.col("text").cast("binary").alias("text"), held_out(outer_id()).alias("held"))
    return own.mapInArrow(lambda source: tidied(run(source)), SHARES_DDL)


def each_share(source):
    """The rows of batches one at a time, as arrays."""
    for batch in source:
        for i in range(batch.num_rows):
            row = {}
            for name in batch.schema.names:
                cell = batch.column(name)[i]
                if name == "words":
                    row[name] = cell.values
                elif name == "totals":
                    row[name] = tuple(cell.values.field(k).to_numpy() for k in (0, 1)) if cell.is_valid else None
                elif name == "tokens":
                    row[name] = cell.as_buffer()
                elif pa.types.is_list(cell.type):
                    row[name] = cell.values.to_numpy(zero_copy_only=False)
            if "tokens" in row:
                row["tokens"] = np.frombuffer(pa.decompress(row["tokens"], 4 * int(row["sizes"].sum()), "zstd"), "<i4")
            yield row


def classes_of(words: pa.Array, common: list[str], own: int = WORDS) -> np.ndarray:
    """Classes where the `common` words have one of their own, in their order."""
    kinds = pc.index_in(words, pa.array(common, pa.string())).fill_null(-1).to_numpy().astype(np.int64)
    ends = pc.utf8_slice_codeunits(words, -2).dictionary_encode()
    rest = own + np.array([bucket(w) for w in ends.dictionary.to_pylist()], np.int64)
    kinds = np.where(kinds < 0, rest[ends.indices.to_numpy()], kinds)
    kinds[pc.equal(words, END_WORD).to_numpy(zero_copy_only=False)] = own + BUCKETS
    return kinds.astype(np.int32)


def contexts(tokens: np.ndarray, sizes: np.ndarray, end: int = END) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the token before and of the one before that; END stands before a text."""
    first, second = np.empty_like(tokens), np.empty_like(tokens)
    first[1:], second[2:] = tokens[:-1], tokens[:-2]
    sizes = np.asarray(sizes, np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes[:-1])])
    first[starts] = end
    second[starts] = end
    after = (starts + 1)[sizes > 1]
    second[after] = end
    return first, second


def triples(shares: DataFrame, common: list[str], own: int = WORDS) -> DataFrame:
    """(triple, n) over all training documents of each share; a triple is three classes in one number."""

    classes = own + BUCKETS + 1

    def run(source):
        for row in each_share(source):
            c = classes_of(row["words"], common, own)[row["tokens"]]
            a, b = contexts(c, row["sizes"], own + BUCKETS)
            code = ((b.astype(np.int64) * classes + a) * classes + c)[~np.repeat(row["held"], row["sizes"])]
            if len(code):
                value, n = np.unique(code, return_counts=True)
                yield pa.RecordBatch.from_pydict({"triple": pa.array(value), "n": pa.array(n)})

    return shares.select("sizes", "held", "words", "tokens").mapInArrow(lambda source: tidied(run(source)), "triple long, n long")


@dataclass
class LogBilinear:
    inputs: np.ndarray  # (CLASSES, D)
    near: np.ndarray  # (D, D), of the token before
    far: np.ndarray
    outputs: np.ndarray  # (CLASSES, D)
    bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.inputs, self.near, self.far, self.outputs, self.bias]

    def log10_probabilities(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """(contexts, CLASSES), each row normalised."""
        y = (self.inputs[first] @ self.near + self.inputs[second] @ self.far) @ self.outputs.T + self.bias
        y -= y.max(axis=1, keepdims=True)
        y -= np.log(np.exp(y).sum(axis=1, keepdims=True))
        return y * y.dtype.type(1 / np.log(10))


def passed(counts: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """One pass over weighted rows in any order: (rows, weights of mean one). Heavy rows come several times with a part each."""
    times = np.ceil(counts / (4 * counts.mean())).astype(np.int64)
    at = rng.permutation(np.repeat(np.arange(len(counts)), times))
    weight = (counts / times)[at]
    return at, weight / weight.mean()


def gathered_rows(n: int, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of the rows for each of n places."""
    out = np.zeros((n, *rows.shape[1:]), rows.dtype)
    order = np.argsort(at, kind="stable")
    first = np.flatnonzero(np.diff(at[order], prepend=-1))
    out[at[order][first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


def train(codes: np.ndarray, counts: np.ndarray, classes: int = CLASSES, seed: int = 3, steps: int = STEPS, dimensions: int = DIMENSIONS, net: LogBilinear | None = None, unigram: np.ndarray | None = None) -> LogBilinear:
    """Noise-contrastive estimation: tell triples from ones whose last class is drawn alone.

    Triples are drawn by their counts. With `net` training goes on from there, in
    one pass over all triples with their counts as weights, at a quarter of the rate.
    """
    rng = np.random.default_rng(seed)
    order = np.argsort(codes)
    codes, counts = codes[order].astype(np.int64, copy=False), counts[order].astype(np.float64, copy=False)
    del order
    if unigram is None:
        unigram = np.bincount(codes % classes, counts, classes) + 0.5
    unigram = unigram / unigram.sum()
    noise_log = np.log(NOISE * unigram).astype(np.float32)
    d, rate_at, weights = dimensions, RATE, None
    init = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
    if net is None:
        net = LogBilinear(init(classes, d), np.eye(d, dtype=np.float32) * 0.5, np.eye(d, dtype=np.float32) * 0.25, init(classes, d), np.log(unigram).astype(np.float32))
    else:
        net = LogBilinear(*[p.copy() for p in net.parameters()])
        at, weights = passed(counts, rng)
        steps, rate_at = -(-len(at) // BATCH), RATE / 4
    params = net.parameters()
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    total = np.cumsum(counts) if weights is None else None
    for step in range(1, steps + 1):
        if weights is None:
            x, weight = codes[np.searchsorted(total, rng.random(BATCH) * total[-1], "right").clip(0, len(codes) - 1)], np.ones(BATCH)
        else:
            x, weight = codes[at[(step - 1) * BATCH : step * BATCH]], weights[(step - 1) * BATCH : step * BATCH]
        w, a, b = x % classes, x // classes % classes, x // classes**2
        v = rng.choice(classes, NOISE, p=unigram)
        ra, rb = net.inputs[a], net.inputs[b]
        q = ra @ net.near + rb @ net.far
        weight = weight.astype(np.float32)
        real = (q * net.outputs[w]).sum(axis=1) + net.bias[w] - noise_log[w]
        fake = q @ net.outputs[v].T + net.bias[v] - noise_log[v]
        gr = (1 / (1 + np.exp(-real)) - 1) * weight / len(x)
        gf = 1 / (1 + np.exp(-fake)) * (weight / len(x))[:, None]
        gq = gr[:, None] * net.outputs[w] + gf @ net.outputs[v]
        both = np.concatenate([w, v])
        g = [
            gathered_rows(classes, np.concatenate([a, b]), np.concatenate([gq @ net.near.T, gq @ net.far.T])),
            ra.T @ gq,
            rb.T @ gq,
            gathered_rows(classes, both, np.concatenate([gr[:, None] * q, gf.T @ q])),
            gathered_rows(classes, both, np.concatenate([gr, gf.sum(axis=0)])),
        ]
        rate = rate_at * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, gp, m, s in zip(params, g, first, second):
            m += 0.1 * (gp - m)
            s += 0.01 * (gp * gp - s)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return net


def averaged(rows: DataFrame, net: LogBilinear, classes: int, unigram: np.ndarray, block: int, places: int, seed: int) -> LogBilinear:
    """`net` trained further in every task on the (triple, n) rows it has, a block at a time, and averaged by tokens: first in `places` tasks, then here."""
    sent = rows.sparkSession.sparkContext.broadcast(net)

    def learned(source):
        held, size, total, weight, nth = [], 0, 0.0, 0.0, 0

        def go():
            nonlocal total, weight
            codes, n = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.argsort(codes)
            codes, n = codes[order], n[order].astype(np.float64)
            del order
            first = np.flatnonzero(np.diff(codes, prepend=-1))
            codes, n = codes[first], np.add.reduceat(n, first)
            del first
            made = train(codes, n, classes, seed=seed + 1000 * nth, net=sent.value, unigram=unigram)
            total, weight = total + n.sum() * np.concatenate([p.ravel() for p in made.parameters()]).astype(np.float64), weight + n.sum()

        for batch in source:
            if batch.num_rows:
                held.append((batch.column("triple").to_numpy(), batch.column("n").to_numpy()))
                size += batch.num_rows
                if size >= block:
                    go()
                    held, size, nth = [], 0, nth + 1
        if held:
            go()
        if weight:
            yield pa.RecordBatch.from_pydict({"weight": pa.array([float(weight)]), "net": pa.array([total.tobytes()], pa.binary())})

    def added(source):
        total, weight = 0.0, 0.0
        for batch in source:
            for w, x in zip(batch.column("weight").to_pylist(), batch.column("net")):
                total, weight = total + np.frombuffer(x.as_buffer()), weight + w
        if weight:
            yield pa.RecordBatch.from_pydict({"weight": pa.array([weight]), "net": pa.array([total.tobytes()], pa.binary())})

    ddl = "weight double, net binary"
    total, weight = 0.0, 0.0
    for row in rows.mapInArrow(lambda source: tidied(learned(source)), ddl).repartition(places).mapInArrow(added, ddl).toLocalIterator():
        total, weight = total + np.frombuffer(row["net"]), weight + row["weight"]
    if not weight:
        return net
    cut = np.cumsum([p.size for p in net.parameters()])[:-1]
    return LogBilinear(*[x.reshape(p.shape).astype(np.float32) for x, p in zip(np.split(total / weight, cut), net.parameters())])


def fitted(found: DataFrame, classes: int, unigram: np.ndarray, block: int = BLOCK, size: int | None = None, begin: DataFrame | None = None, rounds: list[DataFrame] | None = None) -> LogBilinear | None:
    """The model of (triple, n) rows, trained on all of them.

    `size`: how many they are, if known. Of more than `block`, `begin` names the
    rows that the driver draws from and `rounds` those that each round passes over;
    without them rows are told apart by the hash of the triple.
    """
    size = found.count() if size is None else size
    if not size:
        return None
    parts = -(-size // block)
    if parts > 1:
        turn = F.pmod(F.xxhash64("triple"), F.lit(parts * ROUNDS))
        begin = found.where(turn % parts == 0) if begin is None else begin
        rounds = [found.where(F.floor(turn / parts) == k) for k in range(ROUNDS)] if rounds is None else rounds
    first = (begin if parts > 1 else found).groupBy("triple").agg(F.sum("n").alias("n")).toArrow()
    net = train(first["triple"].to_numpy(), first["n"].to_numpy(), classes, unigram=unigram)
    del first
    for k, rows in enumerate(rounds if parts > 1 else []):
        net = averaged(rows, net, classes, unigram, block, max(1, math.isqrt(parts)), seed=k)
    return net


def class_scores(net: LogBilinear | None, c: np.ndarray, sizes: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """log10 probability of each class in its place; the distinct contexts of a share are scored in blocks."""
    if net is None:
        return np.full(len(c), -np.log10(classes))
    a, b = contexts(c, sizes, classes - 1)
    pairs, which = np.unique((b if classes < 46_000 else b.astype(np.int64)) * classes + a, return_inverse=True)
    which = which.astype(np.int32)
    out = np.empty(len(c), np.float32)
    order, step = np.argsort(which, kind="stable"), max(1, 4096 * CLASSES // classes)
    cut = np.searchsorted(which[order], np.arange(0, len(pairs) + step, step))
    for k in range(0, len(pairs), step):
        rows = order[cut[k // step] : cut[k // step + 1]]
        table = net.log10_probabilities(pairs[k : k + step] % classes, pairs[k : k + step] // classes)
        out[rows] = table[which[rows] - k, c[rows]]
    return out


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each whole text.

    Tokens are the words, A-Z lower-cased, and one end. base_score: add-one
    unigrams over the documents that aren't held out; score: the log-bilinear model.
    Both are log10 of the whole text. Null counts as empty: its end is its only
    token. A null id isn't held out. Every row gives a row and counts as a document
    of its own, repeated rows too. With nothing to train on, every token is unknown
    and both scores have the add-one share of no words. Other columns are ignored.
    """
    ship(docs.sparkSession)
    shares = materialize(tokenised(keyed_text(docs, id_col, text_col)), "shares")
    each = shares.select("g", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "x")).select("g", "at", F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    totals = materialize(each.groupBy("word").agg(F.sum("n").alias("total"), F.count("*").alias("shares")), "totals")
    seen = totals.where("total > 0")
    n_all = seen.agg(F.sum("total").alias("n")).first()["n"] or 0
    own = words_for(n_all)
    classes, end = own + BUCKETS + 1, own + BUCKETS
    most = [(r["word"], r["total"]) for r in seen.where(F.col("word") != END_WORD).orderBy(F.desc("total"), "word").limit(own).collect()]
    common = [w for w, _ in most]
    top = docs.sparkSession.createDataFrame([(w, 0) for w in common], "word string, common int")
    stats = seen.join(F.broadcast(top), "word", "left").groupBy(F.when(F.col("word") == END_WORD, end).otherwise(F.coalesce("common", own + bucket_column(F.col("word")))).alias("class")).agg(F.sum("total").alias("n"), F.count("*").alias("v")).collect()
    v_all = sum(r["v"] for r in stats)
    within_n, within_v, unigram = np.zeros(classes), np.zeros(classes), np.full(classes, 0.5)
    unigram[: len(most)] += [n for _, n in most]
    for r in stats:
        if r["class"] >= own:
            unigram[r["class"]] += r["n"]
        if own <= r["class"] < end:
            within_n[r["class"]], within_v[r["class"]] = r["n"], r["v"]
    begin, rounds = None, None
    if n_all > BLOCK:
        # of tokens more than the driver draws from: it takes whole shares, and rounds take theirs where they lie
        drawn = [r["g"] for r in shares.select("g").orderBy(F.xxhash64("g")).limit(-(-BLOCK // SHARE)).collect()]
        begin = triples(shares.where(F.col("g").isin(drawn)), common, own)
        rounds = [triples(shares.where(F.pmod(F.xxhash64("g", F.lit(1)), F.lit(ROUNDS)) == k), common, own) for k in range(ROUNDS)]
    net = fitted(triples(shares, common, own), classes, unigram, size=n_all, begin=begin, rounds=rounds)

    def run(source):
        for row in each_share(source):
            tokens, kinds, counts = row["tokens"], classes_of(row.pop("words"), common, own), row["counts"].copy()
            if row["totals"] is not None:
                counts[row["totals"][0]] = row["totals"][1]
            base = np.log10((counts + 1) / (n_all + v_all + 1))
            rare = (kinds >= own) & (kinds < end)
            share = np.where(rare, np.log10((counts + 1) / (within_n[kinds] + within_v[kinds] + 1)), 0.0)
            starts = np.concatenate([[0], np.cumsum(row["sizes"][:-1], dtype=np.int64)])
            c = kinds[tokens]
            add = lambda x: np.add.reduceat(x, starts)
            yield pa.RecordBatch.from_pydict(
                {
                    "id": pa.array(row["ids"], pa.int64()),
                    "held_out": pa.array(row["held"], pa.bool_()),
                    "n_tokens": pa.array(row["sizes"].astype(np.int64)),
                    "n_known": pa.array(add((counts > 0).astype(np.int64)[tokens])),
                    "base_score": pa.array(add(base[tokens])),
                    "score": pa.array(add(class_scores(net, c, row["sizes"], classes) + share[tokens])),
                }
            )

    # only words of several shares come back: of the others a share knows the count itself
    p, places = partitions(docs), 2 * max(1, shares.select("g").count())
    back = each.repartition(p, "word").join(totals.where("shares > 1").select("word", "total").repartition(p, "word"), "word")
    # a place has a share or a few, however many there are: the numbers of a share meet in its place, and it is sent there once
    back = back.select("g", "at", "total").repartition(places, "g").groupBy("g").agg(F.collect_list(F.struct("at", "total")).alias("totals"))
    out = shares.repartition(places, "g").join(back, "g", "left").mapInArrow(lambda source: tidied(run(source)), "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(outer_id(id_col), "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")
