"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counting is distributed: each task adds up a (language, bucket) matrix of the texts that it reads, and the matrices meet in
one small aggregation. The log-probability matrix, of at most 4 * CELLS bytes (32 MB), is broadcast;
texts are scored in numpy by batches, as the product of a sparse n-gram count matrix and that matrix.

A matrix has room for BLOCK languages. More of them make several matrices of the same buckets, each counted and scored in a pass of
its own: a pass keeps the best language so far and the sum that turns its evidence into a probability, so the result
is that of one large matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import materialise

#: Buckets, cells of a matrix at most and so its languages; sizes of the n-grams.
BUCKETS, CELLS, SIZES = 1 << 15, 1 << 23, (1, 2, 3)
BLOCK = CELLS // BUCKETS
#: More values of the language column than this are taken for a mistake and refused with an error.
MOST = 1 << 15
ALPHA = 0.5
UNKNOWN = "und"
#: Evidence counts as that of so many n-grams at most when it is turned into a probability.
EVIDENCE = 40.0
CHUNK = 1 << 17  # characters scored at once


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # (buckets, languages), float32
    prior: np.ndarray
    rest: tuple[Model, ...] = ()  # of the languages that have no room in this one, in the order of their names


def grams(texts: list[str], buckets_: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every n-gram of the lower-cased texts; none crosses from one text to the next."""
    joined = "\n".join(texts)
    lower = joined.lower()
    if len(lower) != len(joined):  # a few characters grow when lower-cased
        texts = [t.lower() for t in texts]
        lower = "\n".join(texts)
    points = np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    text = np.repeat(np.arange(len(texts), dtype=np.int32), lengths + 1)[: len(points)]
    ends = np.cumsum(lengths + 1) - 1  # where the separators stand
    break_ = np.zeros(len(points) + 1, bool)
    break_[ends[:-1]] = True
    buckets, owners, h, crosses = [], [], np.zeros(len(points), np.uint32), break_[:-1].copy()
    for n in range(1, max(SIZES) + 1):
        at = n - 1
        if len(points) <= at:
            break
        h = (h[: len(points) - at] if at else h) * np.uint32(0x9E3779B1) + points[at:] + np.uint32(n)
        crosses = crosses[: len(points) - at] | break_[at : len(points)]
        if n in SIZES:
            mixed = h ^ (h >> np.uint32(15))
            mixed = mixed * np.uint32(0x85EBCA6B)
            mixed ^= mixed >> np.uint32(13)
            buckets.append((mixed % np.uint32(buckets_))[~crosses].astype(np.int32))
            owners.append(text[: len(points) - at][~crosses])
    if not buckets:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    return np.concatenate(buckets), np.concatenate(owners)


def _chunks(lengths: list[int]) -> Iterator[slice]:
    start = held = 0
    for i, n in enumerate(lengths):
        held += n
        if held >= CHUNK:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(lengths):
        yield slice(start, len(lengths))


def _parts(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """The batches cut where the texts of column ``at`` reach CHUNK bytes; strings of a whole batch are never held together."""
    for batch in batches:
        for part in _chunks(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()):
            yield batch.slice(part.start, part.stop - part.start)


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", alpha: float = ALPHA) -> Model:
    """A model of every language in ``labelled``; rows with a null text or language don't count.

    MOST values of the language column or more are an error. From BLOCK languages on the labelled rows are read once more for each
    further BLOCK of them.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).dropna()
    per_lang = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").limit(MOST).collect()
    if len(per_lang) == MOST:
        raise ValueError(f"{MOST} values of {lang_col} or more: these are no languages")
    seen = sum(r.n for r in per_lang)
    blocks = []
    for at in range(0, max(1, len(per_lang)), BLOCK):
        part = per_lang[at : at + BLOCK]
        own = rows if len(per_lang) <= BLOCK else rows.filter(F.col("lang").isin([r.lang for r in part]))
        prior = np.log(np.array([r.n for r in part], float) / max(1, seen))
        blocks.append(Model([r.lang for r in part], _counted(own, [r.lang for r in part], alpha), prior))
    blocks[0].rest = tuple(blocks[1:])
    return blocks[0]


def _counted(rows: DataFrame, languages: list[str], alpha: float) -> np.ndarray:
    """(bucket, language) log probabilities of the languages of ``rows`` (text, lang)."""
    index, buckets = {lang: i for i, lang in enumerate(languages)}, BUCKETS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(index), buckets), np.int64)
        for batch in _parts(batches, 0):
            bucket, owner = grams(batch.column(0).to_pylist(), buckets)
            of = np.array([index[x] for x in batch.column(1).to_pylist()], np.int64)
            cells = of[owner] * buckets + bucket
            if total.size <= 1 << 20:
                total += np.bincount(cells, minlength=total.size).reshape(total.shape)
            else:  # a matrix for each chunk would be the larger part of the work
                found, n = np.unique(cells, return_counts=True)
                total.ravel()[found] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"cell": at, "n": total.ravel()[at]})

    cells = rows.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # CELLS rows at most
    total = np.zeros(len(languages) * buckets)
    total[cells["cell"].to_numpy(np.int64)] = cells["n"].to_numpy(np.float64)
    total = total.reshape(-1, buckets).T + alpha
    return np.log(total / total.sum(axis=0)).astype(np.float32)


def _evidence(block: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each text: its best language among the block's, that one's evidence, the logarithm of the sum of all even evidence,
    and the factor that makes evidence even. All as if texts of more than EVIDENCE n-grams had no more."""
    best, raw, spread, factor = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts))
    for part in _chunks([len(t) for t in texts]):
        bucket, owner = grams(texts[part], len(block.log_p))
        n = len(texts[part])
        sums = np.zeros((n, len(block.languages)))
        for k in range(len(block.languages)):
            sums[:, k] = np.bincount(owner, block.log_p[bucket, k], minlength=n)
        seen = np.bincount(owner, minlength=n).astype(float)[:, None]
        even = np.minimum(1.0, EVIDENCE / np.maximum(seen, 1))
        sums += block.prior
        best[part], raw[part], factor[part] = sums.argmax(axis=1), sums.max(axis=1), even[:, 0]
        top = sums.max(axis=1, keepdims=True) * even
        spread[part] = top[:, 0] + np.log(np.exp(sums * even - top).sum(axis=1))
    return best, raw, spread, factor


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def classify(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """The likeliest language of each text and its probability, ``und`` and 0 for one that is null or has no letter.

    The evidence of a text is taken as if it had at most EVIDENCE n-grams, so the probability says how clearly its
    n-grams speak for the language, and does not go to 1 with the length alone. Ties go to the first language by name.
    """
    langs, raw, spread, factor = _folded(model, texts, None)
    for block in model.rest:
        langs, raw, spread, factor = _folded(block, texts, (langs, raw, spread))
    return langs, [float(p) if lang != UNKNOWN else 0.0 for lang, p in zip(langs, np.exp(raw * factor - spread), strict=True)]


def _folded(block: Model, texts: list[str | None], held: tuple | None) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(languages, evidence, spread, factor) of texts after one more block; a language of an earlier block keeps ties."""
    real = [bool(block.languages) and _has_letter(t) for t in texts]
    whole = [t if ok else "" for t, ok in zip(texts, real, strict=True)]
    best, raw, spread, factor = _evidence(block, whole) if block.languages else (None, *(np.zeros(len(texts)) for _ in range(3)))
    langs = [block.languages[best[i]] if ok else UNKNOWN for i, ok in enumerate(real)]
    if held is not None:
        before, most, sums = held
        langs = [new if r > old else lang for lang, new, r, old in zip(before, langs, raw, most, strict=True)]
        raw, spread = np.maximum(raw, most), np.logaddexp(spread, sums)
    return langs, raw, spread, factor


def identify(docs: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with all its columns and two more; columns of those names are replaced.

    A null text, and one without a letter, is ``und`` with score 0; so is every text if no language was learned. The
    rows stay where they are: no shuffle; between the passes of a model of several matrices they are written. Repeated rows stay repeated; texts are scored whole, however long.
    """
    kept = [c for c in docs.columns if c not in (lang_out, score_out)]
    held = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)])  # any names on the way to the tasks
    at, blocks = kept.index(text_col), [model, *model.rest]
    for number, block in enumerate(blocks):
        shared, first, last = docs.sparkSession.sparkContext.broadcast(block), not number, number == len(blocks) - 1
        names = [*(held.columns if first else held.columns[:-3]), "lang", "raw", "spread"]

        def run(batches: Iterator[pa.RecordBatch], shared=shared, first=first, last=last, names=names) -> Iterator[pa.RecordBatch]:
            for batch in _parts(batches, at):
                before = None if first else (batch.column(len(kept)).to_pylist(), *(batch.column(len(kept) + i).to_numpy(zero_copy_only=False) for i in (1, 2)))
                texts = batch.column(at).to_pylist()
                langs, raw, spread, factor = _folded(shared.value, texts, before)
                if last:  # the score instead of the evidence
                    raw = np.where([x == UNKNOWN for x in langs], 0.0, np.exp(raw * factor - spread))
                columns = [*batch.columns[: len(kept)], pa.array(langs, pa.string()), pa.array(raw, pa.float64()), pa.array(spread, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names)

        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in held.schema.fields[: len(kept)])
        held = held.mapInArrow(run, f"{schema}, lang string, raw double, spread double")
        if not last:
            held = materialise(held, "languages")
    return held.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], F.col("lang").alias(lang_out), F.col("raw").alias(score_out))


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training: crc32 of its id as text leaves 2 when divided by 4 (null id: no)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
