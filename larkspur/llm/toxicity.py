"""Toxic spans by a linear-chain conditional random field, summed up to documents.

Labels are of documents, so tokens are labelled first: words that stand significantly more often in toxic documents than in
clean ones, in many different surroundings (which copies of one document don't give), are toxic in toxic documents; all other
tokens are clean. A two-state chain over hashed features of words and their neighbours is fitted to all tokens of a bounded
sample of labelled documents; its gradient is summed up over tasks. Every text is then tagged whole: forward-backward marginals give spans and offsets, and a logistic curve over the
expected number of toxic tokens, fitted with the weights of the classes in all labelled rows, gives the document's score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import materialise

#: Labelled documents that the model is fitted on, by class (clean, toxic), spread by hash.
SAMPLE = (6000, 3000)
HASHED, ROUNDS = 1 << 17, 30
#: Tokens of a text that are a chain of their own in the fit; all of them are.
CHUNK = 128
#: Tasks that the gradient is summed up in; each sends one array of HASHED numbers.
TASKS = 16
#: Marginals below this don't add to a document's sum, or the length of a clean text would.
FLOOR = 0.1
#: Evidence for a word: likelihood ratio (G squared) and times as frequent in toxic documents, at least.
EVIDENCE, TIMES = 30.0, 6.0
PREDICTED = 0.3

_word = re.compile(r"[^\W\d_]+")


def _hash(part: str) -> int:
    return crc32(part.encode("utf-8", "surrogatepass")) % HASHED


def _features(word: str) -> tuple[list[int], int, int]:
    """A word's own features, and what it is to the word after it and to the word before it."""
    own = [f"w:{word}", "bias", f"s:{word[-4:]}"] + [f"p:{word[:n]}" for n in (4, 6, 8) if len(word) >= n]
    return [_hash(p) for p in own], _hash(f"l:{word}"), _hash(f"r:{word}")


# ---- labelled tokens


def sample_labelled(docs: DataFrame, labels: DataFrame, text_col: str, id_col: str, label_col: str) -> tuple[DataFrame, dict[int, int]]:
    """(id, text, toxic) of the sample, written once, and the number of labelled rows by class.

    The ids of the sample are broadcast (9,000 at most), so no text is shuffled to find it; of rows that repeat an id one counts.
    """
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).filter("id IS NOT NULL AND toxic IN (0, 1)")
    marked = marked.groupBy("id").agg(F.max("toxic").alias("toxic"))
    sizes = {r.toxic: r.n for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = [marked.filter(F.col("toxic") == k).orderBy(F.xxhash64(F.lit(5), "id"), "id").limit(n) for k, n in enumerate(SAMPLE)]
    ids = F.broadcast(picked[0].unionByName(picked[1]))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    one = rows.join(ids, "id").groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("toxic").alias("toxic"))
    return materialise(one, "toxicity-sample"), sizes


def toxic_words(sample: DataFrame) -> list[str]:
    """Words of the sample with significant evidence, in toxic documents with many different words before them."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]+)"), F.lit(1))
    held = sample.select("id", "toxic", words.alias("w")).select(
        "id", "toxic", F.explode(F.arrays_zip(F.col("w").alias("word"), F.concat(F.array(F.lit("")), "w").alias("before"))).alias("t")
    )
    tokens = held.select("id", "toxic", "t.word", "t.before").filter("word IS NOT NULL")
    n = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.countDistinct("id").alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        return []
    seen = tokens.groupBy("word").agg(
        F.countDistinct(F.when(F.col("toxic") == 1, F.col("id"))).alias("a"), F.countDistinct(F.when(F.col("toxic") == 0, F.col("id"))).alias("b"),
        F.countDistinct(F.when(F.col("toxic") == 1, F.col("before"))).alias("before"),
    )
    a, b = F.col("a"), F.col("b")
    expected = (a + b) * (n1 / (n0 + n1))
    g = 2 * (a * F.log(a / expected) + F.when(b > 0, b * F.log(b / (a + b - expected))).otherwise(F.lit(0.0)))
    clear = (a >= 3) & (a / n1 >= TIMES * (b + 0.5) / n0) & (g >= EVIDENCE) & (F.col("before") >= F.greatest(F.lit(3), a / 2))
    return [r.word for r in seen.filter(clear).orderBy(g.desc(), "word").collect()]


# ---- the chain


@dataclass
class Chain:
    weights: np.ndarray  # of hashed features, for the toxic state
    start: float
    moves: np.ndarray  # (2, 2) log potentials, from row to column

    def emission(self, word: str) -> tuple[float, float, float]:
        """What a word adds to its own token, to the one after it and to the one before it."""
        own, left, right = _features(word)
        return float(self.weights[own].sum()), float(self.weights[left]), float(self.weights[right])


def along(parts: np.ndarray) -> np.ndarray:
    """The emissions of a text's tokens, from what its words add (a row for each word)."""
    out = parts[:, 0].copy()
    out[1:] += parts[:-1, 1]
    out[:-1] += parts[1:, 2]
    return out


@dataclass
class Labelled:
    """Texts one after another: distinct words with their features, tokens as places among the words, labels, and where texts begin."""

    own: np.ndarray
    sizes: np.ndarray
    left: np.ndarray
    right: np.ndarray
    token: np.ndarray
    y: np.ndarray
    begins: np.ndarray

    @staticmethod
    def of(texts: list[list[str]], labels: list[list[int]]) -> Labelled:
        index: dict[str, int] = {}
        token = np.array([index.setdefault(w, len(index)) for t in texts for w in t], np.int32)
        feats = [_features(w) for w in index]
        begins = np.zeros(len(token), bool)
        begins[np.cumsum([0, *[len(t) for t in texts if t]])[:-1]] = True
        return Labelled(
            np.array([f for own, _, _ in feats for f in own], np.int32), np.array([len(own) for own, _, _ in feats], np.int32),
            np.array([x for _, x, _ in feats], np.int32), np.array([x for _, _, x in feats], np.int32),
            token, np.array([y for row in labels for y in row], np.int8), begins,
        )


def gradient(data: Labelled, weights: np.ndarray, extra: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """The gradient of the log likelihood for the weights, then start and the four moves (``extra``)."""
    out = np.zeros(len(weights) + 5)
    n = len(data.token)
    if not n:
        return out
    starts = np.cumsum(data.sizes) - data.sizes
    score = np.add.reduceat(weights[data.own], starts)
    inside = np.flatnonzero(~data.begins)  # tokens that have one before them in their text
    e = score[data.token]
    e[inside] += weights[data.left[data.token[inside - 1]]]
    e[inside - 1] += weights[data.right[data.token[inside]]]

    # chains of ``chunk`` tokens at most, side by side
    text = np.cumsum(data.begins) - 1
    first = np.flatnonzero(data.begins)
    within = np.arange(n) - first[text]
    begin = data.begins | (within % chunk == 0)
    chain = np.cumsum(begin) - 1
    place = np.arange(n) - np.flatnonzero(begin)[chain]
    shape = (int(place.max()) + 1, int(chain[-1]) + 1)
    emit, y, real = np.zeros(shape), np.zeros(shape), np.zeros(shape, bool)
    emit[place, chain], y[place, chain], real[place, chain] = e, data.y, True
    start, moves = extra[0], extra[1:].reshape(2, 2)
    (a00, a01), (a10, a11) = moves
    forward, back = np.zeros(shape), np.zeros(shape)
    forward[0] = emit[0] + start
    for t in range(1, shape[0]):
        r = forward[t - 1]
        forward[t] = emit[t] + np.logaddexp(a01, a11 + r) - np.logaddexp(a00, a10 + r)
    for t in range(shape[0] - 2, -1, -1):
        ahead = emit[t + 1] + back[t + 1]
        back[t] = np.where(real[t + 1], np.logaddexp(a10, a11 + ahead) - np.logaddexp(a00, a01 + ahead), 0.0)
    p = 1 / (1 + np.exp(-np.clip(forward + back, -40, 40)))
    error = ((y - p) * real)[place, chain]

    by_word = np.bincount(data.token, error, len(data.sizes))
    np.add.at(out, data.own, np.repeat(by_word, data.sizes))
    np.add.at(out, data.left, np.bincount(data.token[inside - 1], error[inside], len(data.left)))
    np.add.at(out, data.right, np.bincount(data.token[inside], error[inside - 1], len(data.right)))
    out[-5] = error[begin].sum()
    joint = np.stack([i * forward[:-1] + moves[i, j] + j * (emit[1:] + back[1:]) for i in (0, 1) for j in (0, 1)])
    joint = np.exp(joint - joint.max(axis=0))
    joint /= joint.sum(axis=0)
    is_, then = y[:-1], y[1:]
    seen = np.stack([(is_ if i else 1 - is_) * (then if j else 1 - then) for i in (0, 1) for j in (0, 1)])
    out[-4:] = ((seen - joint) * real[1:]).sum(axis=(1, 2))
    return out


class Climb:
    """AdaGrad on the log likelihood with a little L2."""

    def __init__(self) -> None:
        self.weights, self.extra = np.zeros(HASHED), np.zeros(5)
        self.weights[_hash("bias")] = -6.0  # most tokens are clean
        self.g_w, self.g_e = np.full(HASHED, 1e-3), np.full(5, 1e-3)

    def step(self, slope: np.ndarray) -> None:
        grad, move = slope[:-5] - 1e-3 * self.weights, slope[-5:] - 1e-1 * self.extra
        self.g_w += grad**2
        self.g_e += move**2
        self.weights += 1.0 * grad / np.sqrt(self.g_w)
        self.extra += 0.4 * move / np.sqrt(self.g_e)

    def chain(self) -> Chain:
        return Chain(self.weights, float(self.extra[0]), self.extra[1:].reshape(2, 2))


def fit_chain(texts: list[list[str]], labels: list[list[int]], rounds: int = ROUNDS) -> Chain:
    """The chain of texts at hand."""
    climb, data = Climb(), Labelled.of(texts, labels)
    for _ in range(rounds):
        climb.step(gradient(data, climb.weights, climb.extra))
    return climb.chain()


_kept = ("own", "sizes", "left", "right", "token", "y", "begins")


def train_chain(sample: DataFrame, lexicon: list[str], rounds: int = ROUNDS) -> Chain:
    """The chain fitted to all tokens of the sample: of toxic documents the listed words are toxic, all else is clean."""
    spark = sample.sparkSession
    known = spark.sparkContext.broadcast(frozenset(lexicon))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = [_word.findall(t.lower()) for t in part.column(0).to_pylist()]
                labels = [[int(toxic == 1 and w in known.value) for w in t] for t, toxic in zip(texts, part.column(1).to_pylist(), strict=True)]
                data = Labelled.of(texts, labels)
                yield pa.RecordBatch.from_arrays([pa.array([getattr(data, k).tobytes()], pa.binary()) for k in _kept], list(_kept))

    dealt = sample.select("text", "toxic").repartition(TASKS)
    rows = materialise(dealt.mapInArrow(index, ", ".join(f"{k} binary" for k in _kept)), "toxicity-training")
    climb = Climb()
    kinds = (np.int32,) * 5 + (np.int8, bool)
    for _ in range(rounds):
        now = spark.sparkContext.broadcast((climb.weights, climb.extra))

        def slope(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total = np.zeros(HASHED + 5)
            for batch in batches:
                for i in range(batch.num_rows):
                    data = Labelled(*[np.frombuffer(c[i].as_py(), kind) for c, kind in zip(batch.columns, kinds, strict=True)])
                    total += gradient(data, *now.value)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["slope"])

        found = rows.coalesce(TASKS).mapInArrow(slope, "slope binary").toArrow().column(0)  # TASKS rows at most
        climb.step(sum((np.frombuffer(x.as_py()) for x in found), np.zeros(HASHED + 5)))
        now.destroy()
    return climb.chain()


def marginals(emissions: list[np.ndarray], chain: Chain) -> list[np.ndarray]:
    """P(toxic) of each token of each text, by forward-backward over all texts at once, in log odds of the two states."""
    lengths = np.array([len(e) for e in emissions])
    order = np.argsort(-lengths, kind="stable")
    active = len(lengths) - np.searchsorted(lengths[order][::-1], np.arange(1, lengths.max(initial=0) + 1))
    starts = np.r_[0, np.cumsum(active)]
    flat = np.empty(starts[-1])
    for rank, i in enumerate(order.tolist()):
        flat[starts[: lengths[i]] + rank] = emissions[i]
    (a00, a01), (a10, a11) = chain.moves
    forward, back = np.empty_like(flat), np.zeros_like(flat)
    for t, k in enumerate(active):
        here = slice(starts[t], starts[t] + k)
        if t:
            r = forward[starts[t - 1] : starts[t - 1] + k]
            forward[here] = flat[here] + np.logaddexp(a01, a11 + r) - np.logaddexp(a00, a10 + r)
        else:
            forward[here] = flat[here] + chain.start
    for t in range(len(active) - 2, -1, -1):
        k = active[t + 1]
        nxt = slice(starts[t + 1], starts[t + 1] + k)
        ahead = flat[nxt] + back[nxt]
        back[starts[t] : starts[t] + k] = np.logaddexp(a10, a11 + ahead) - np.logaddexp(a00, a01 + ahead)
    p = 1 / (1 + np.exp(-np.clip(forward + back, -40, 40)))
    out: list[np.ndarray] = [np.empty(0)] * len(lengths)
    for rank, i in enumerate(order.tolist()):
        out[i] = p[starts[: lengths[i]] + rank]
    return out


class _Emissions(dict):
    """The row of ``table`` for each word met so far, started afresh when they have become many."""

    MOST = 400_000

    def __init__(self, chain: Chain):
        super().__init__()
        self.chain, self.table = chain, np.empty((self.MOST, 3))

    def learn(self, words: set[str]) -> None:
        """Make rows for the words that have none, all at once."""
        new = [w for w in words if w not in self]
        if len(self) + len(new) > self.MOST:
            self.clear()
            new = list(words)
            self.table = np.empty((max(self.MOST, len(new)), 3))
        if not new:
            return
        feats, at, weights = [_features(w) for w in new], len(self), self.chain.weights
        sizes = np.array([len(own) for own, _, _ in feats])
        rows = self.table[at : at + len(new)]
        rows[:, 0] = np.add.reduceat(weights[[f for own, _, _ in feats for f in own]], np.cumsum(sizes) - sizes)
        rows[:, 1], rows[:, 2] = weights[[x for _, x, _ in feats]], weights[[x for _, _, x in feats]]
        self.update(zip(new, range(at, at + len(new)), strict=True))


def tag(docs: DataFrame, chain: Chain, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, toxic_tokens, spans): the expected number of toxic tokens (marginals from FLOOR on), and start:end of those likelier toxic than not.

    Offsets are code points of the text as it is, in order; a null text has none.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shared = rows.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Emissions(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                texts = [t or "" for t in part.column(1).to_pylist()]
                words = [_word.findall(low) if len(low := t.lower()) == len(t) else [w.lower() for w in _word.findall(t)] for t in texts]
                known.learn(set().union(*words))
                emissions = [along(known.table[np.array([known[w] for w in ws], np.int64)]) for ws in words]
                sums, spans = [], []
                for text, p in zip(texts, marginals(emissions, shared.value), strict=True):
                    sums.append(float(p[p >= FLOOR].sum()))
                    if (p > 0.5).any():
                        spans.append(",".join(f"{m.start()}:{m.end()}" for m, x in zip(_word.finditer(text), p, strict=True) if x > 0.5))
                    else:
                        spans.append("")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sums, pa.float64()), pa.array(spans, pa.string())], ["id", "toxic_tokens", "spans"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, toxic_tokens double, spans string")


# ---- documents


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Newton's method for a weighted logistic regression with a small penalty."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (y - p)) - 0.05 * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_toxicity(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """One row per row of ``docs``: id, score, predicted, toxic_tokens, spans. Learns from ``labels`` alone.

    A text without words, or null, gets the score of one without toxic tokens. Null labels and ids teach nothing; of
    repeated labels the largest counts. With one class only, or no words that tell the classes apart, all documents get
    the share of toxic labels (0 without labels). Rows that repeat an id are scored one by one; other columns are not read, and
    texts are tagged whole, however long.
    """
    sample, sizes = sample_labelled(docs, labels, text_col, id_col, label_col)
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    lexicon = toxic_words(sample) if len(sizes) == 2 else []
    if not lexicon:
        even = docs.select(F.col(id_col), F.lit(share).alias("score"))
        return even.select(id_col, "score", (F.col("score") >= PREDICTED).cast("int").alias("predicted"), F.lit(0.0).alias("toxic_tokens"), F.lit("").alias("spans"))
    chain = train_chain(sample, lexicon)
    seen = tag(sample, chain, "text", "id").withColumnRenamed("id", "seen_id")
    fitted = seen.join(sample.select("id", "toxic").distinct(), F.col("seen_id") == F.col("id")).select("toxic_tokens", "toxic").toPandas()
    x1, y = fitted["toxic_tokens"].to_numpy(float), fitted["toxic"].to_numpy(float)
    x = np.stack([np.ones_like(x1), np.minimum(x1, 1.0), np.log1p(x1)], axis=1)
    weight = np.where(y == 1, sizes[1] / max(1, y.sum()), sizes[0] / max(1, (1 - y).sum()))
    b, steep, more = _logistic(x, y, weight / weight.mean())
    tokens = F.col("toxic_tokens")
    logit = F.lit(float(b)) + float(steep) * F.least(tokens, F.lit(1.0)) + float(max(more, 0.0)) * F.log1p(tokens)
    scored = tag(docs, chain, text_col, id_col).withColumn("score", 1 / (1 + F.exp(-logit)))
    return scored.select(F.col("id").alias(id_col), "score", (F.col("score") >= PREDICTED).cast("int").alias("predicted"), "toxic_tokens", "spans")
