"""Quality by perplexity: interpolated modified Kneser-Ney over character n-grams, with sharded count joins.

The model is of characters (order 4, per language): words of open vocabularies would make tables of counts larger than the
texts. It is trained on all trusted text. Only the highest order is counted in texts; the lower orders' continuation counts
follow from the distinct n-grams one order above. Counts and contexts stay distributed tables.

Scoring asks for what it needs: each shard of documents lists its distinct n-grams, these are joined with the counts and
contexts of every order, and their log probabilities go back to the shard, where they meet its documents once. Texts cross the
network compressed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import materialise, width

ORDER, BITS = 4, 16
#: Characters of a shard, about, and most quantiles of ids that are asked for; further shards divide what lies between them evenly.
SHARD_CHARS, QUANTILES = 16_000_000, 16_384
#: Languages up to which a table of one row for each is broadcast (about 100 bytes a row); beyond, it is joined by a shuffle.
MOST_BROADCAST = 10_000
CHUNK = 1 << 19
#: Bits of the filter that keeps most untrusted texts from being shuffled; it has this size whatever the input.
FILTER_BITS = 1 << 24
#: Share of a language's trusted documents, not trained on, that are kept. Chosen on training labels against quality 0.
QUANTILE = 0.95
#: Where the quantile of few documents would be their maximum, the highest of these that is not is taken.
SMALLER = (0.9, 0.8)

START = 0xFFFF  # the symbol of what stands before a text: a noncharacter, dropped from texts
_lead = chr(START) * (ORDER - 1)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(gram, text) for each symbol of the texts: 64 bits of it and the three before it in the same text.

    White space is normalised to single spaces. Symbols are UTF-16 code units, so that no two characters share a code: those
    up to U+FFFF are one symbol, all others two.
    """
    clean = [" ".join((t or "").replace(chr(START), "").split()) for t in texts]
    symbol = np.frombuffer("".join([_lead + t for t in clean]).encode("utf-16-le", "surrogatepass"), np.uint16)
    lead = symbol == START
    owner = (np.cumsum(lead) - 1) // (ORDER - 1)
    code = symbol.astype(np.uint64)
    for back in range(1, ORDER):
        code[back:] |= symbol[:-back].astype(np.uint64) << np.uint64(BITS * back)
    return code[~lead].view(np.int64), owner[~lead]


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches a few rows at a time, so that a worker holds the texts of those only as Python strings."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _parts_of(sizes: list[int]) -> Iterator[slice]:
    start = held = 0
    for i, n in enumerate(sizes):
        held += n
        if held >= CHUNK:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(sizes):
        yield slice(start, len(sizes))


def _parts(texts: list[str | None]) -> Iterator[slice]:
    return _parts_of([len(t or "") for t in texts])


class _Tallies:
    """Distinct grams and their counts by key, merged whenever those that came since have become many."""

    def __init__(self) -> None:
        self.merged: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        self.new: dict[tuple, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.held = 0

    def add(self, key: tuple, codes: np.ndarray) -> None:
        found = np.unique(codes, return_counts=True)
        self.new.setdefault(key, []).append(found)
        self.held += len(found[0])
        if self.held > 1_000_000:
            self.merge()

    def merge(self) -> dict[tuple, tuple[np.ndarray, np.ndarray]]:
        for key, parts in self.new.items():
            parts = [*parts, *([self.merged[key]] if key in self.merged else [])]
            keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([c for _, c in parts]), len(keys))
            self.merged[key] = keys, counts.astype(np.int64)
        self.new, self.held = {}, 0
        return self.merged


@dataclass
class Places:
    """How rows are dealt to shards: by ranges of ``at``, cut evenly once more, and rows of a frequent ``at`` by ``salt`` too."""

    cuts: np.ndarray
    pieces: int
    hot: dict[int, int]  # shards of a frequent value

    def shard(self, at: np.ndarray, salt: np.ndarray) -> np.ndarray:
        range_ = np.searchsorted(self.cuts, at)
        out = range_ * self.pieces
        if self.pieces > 1 and len(self.cuts):
            low, high = (np.r_[self.cuts[0] - 1, self.cuts, self.cuts[-1]][range_ + i].astype(float) for i in (0, 1))
            share = (at - low) / np.maximum(high - low, 1)
            out = out + np.clip(share * self.pieces, 0, self.pieces - 1).astype(np.int64)
        if self.hot:
            values = np.array(sorted(self.hot))
            shards = np.array([self.hot[v] for v in values.tolist()])
            place = np.minimum(np.searchsorted(values, at), len(values) - 1)
            of = np.flatnonzero(values[place] == at)
            first = np.cumsum(shards) - shards
            out[of] = -1 - (first[place[of]] + salt[of] % shards[place[of]])
        return out


def _placed(docs: DataFrame) -> DataFrame:
    """``docs`` (id, lang, text) with ``at``, a number to order by, and ``salt``, a hash of the text.

    Shards are ranges of ids: where tables are stored in the order of their ids, a task that reads them meets few shards, and
    lists the n-grams of each once. Any other order only makes more requests.
    """
    at = F.coalesce(F.col("id").try_cast("long"), F.xxhash64("id"))
    salt = F.xxhash64("text")
    return docs.select("id", "lang", "text", F.when(F.col("id").isNull(), salt).otherwise(at).alias("at"), salt.alias("salt"))


def _places(placed: DataFrame, size: int) -> Places:
    total = placed.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-total // size))
    ranges = min(QUANTILES, shards)
    quantiles = placed.approxQuantile("at", [i / ranges for i in range(1, ranges)], 0.1 / ranges) if ranges > 1 else []
    hot: dict[int, int] = {}
    if shards > 1:  # values with more text than a shard: no more than there are shards
        chars = placed.groupBy("at").agg(F.sum(F.length("text")).alias("chars")).filter(F.col("chars") > size)
        hot = {r.at: -(-r.chars // size) for r in chars.collect()}
    return Places(np.unique(np.array(quantiles, np.float64)).astype(np.int64), -(-shards // ranges), hot)


def _tallied(rows: DataFrame, places: Places) -> DataFrame:
    """(shard, lang, gram, n) of ``rows``, added up within each task.

    ``rows`` has at, salt, lang and text, or packed and size in place of the text.
    """
    columns = [c for c in ("at", "salt", "lang", "text", "packed", "size") if c in rows.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = _Tallies()
        for batch in _slices(batches):
            shards = places.shard(batch.column(0).to_numpy(), batch.column(1).to_numpy()).tolist()
            langs, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            if len(columns) == 5:
                texts = [_unpack(b, n) for b, n in zip(texts, batch.column(4).to_pylist(), strict=True)]
            by_key: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(shards, langs, strict=True)):
                by_key.setdefault(key, []).append(i)
            for key, rows_ in by_key.items():
                own = [texts[i] for i in rows_]
                for part in _parts(own):
                    tallies.add(key, grams(own[part])[0])
        for (shard, lang), (keys, counts) in tallies.merge().items():
            for at in range(0, len(keys), 100_000):
                k, n = keys[at : at + 100_000], counts[at : at + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * len(k), pa.int64()), pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(n)], ["shard", "lang", "gram", "n"]
                )

    return rows.select(*columns).mapInArrow(run, "shard long, lang string, gram long, n long")


# ---- training


def may_be_in(ids: DataFrame) -> np.ndarray:
    """A one-hash filter of fixed size over a column ``id``: bits that are set for every id, and for few others."""
    bit = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    marked = ids.select(bit.alias("b"))
    words = marked.select((F.col("b") / 64).cast("int").alias("at"), F.expr("shiftleft(1L, int(b % 64))").alias("bit"))
    found = words.groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()  # FILTER_BITS / 64 rows at most
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[found["at"].to_numpy(int)] = found["bits"].to_numpy(np.int64)
    return bits


def _packed(texts: list[str | None]) -> tuple[pa.Array, pa.Array]:
    raw = [(t or "").encode() for t in texts]
    codec = pa.Codec("zstd", compression_level=9)
    return pa.array([codec.compress(b, asbytes=True) for b in raw], pa.binary()), pa.array(map(len, raw), pa.int64())


def _unpack(packed: bytes | None, size: int) -> str:
    return pa.decompress(packed, size, "zstd", asbytes=True).decode() if packed is not None and size else ""


def _prefilter(rows: DataFrame, bits: np.ndarray) -> DataFrame:
    """(id, lang, packed, size) of the rows (id, lang, text) that the filter lets through."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            bit = batch.column(3).to_numpy()
            part = batch.filter(pa.array(((shared.value[bit // 64] >> (bit % 64)) & 1).astype(bool)))
            columns = [part.column(0), part.column(1), *_packed(part.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "lang", "packed", "size"])

    kind = rows.schema["id"].dataType.simpleString()
    marked = rows.select("id", "lang", "text", F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)).alias("bit"))
    return marked.mapInArrow(run, f"id {kind}, lang string, packed binary, size long")


def _suffix(order: int) -> Column:
    """The last ``order`` symbols of a gram; all bits of a long are those of the highest order."""
    return F.col("gram") if order == ORDER else F.col("gram").bitwiseAND((1 << (BITS * order)) - 1)


def count_tables(trusted: DataFrame) -> dict[int, DataFrame]:
    """For each order (lang, gram, n): counts for the highest, continuation counts below."""
    one = trusted.withColumn("at", F.lit(0).cast("long")).withColumn("salt", F.lit(0).cast("long"))
    top = _tallied(one, Places(np.empty(0, np.int64), 1, {})).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    tables = {ORDER: materialise(top, "grams-4")}
    for order in range(ORDER - 1, 0, -1):
        tables[order] = materialise(tables[order + 1].select("lang", _suffix(order).alias("gram")).groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n")), f"grams-{order}")
    return tables


def _discounts(table: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3, symbols): Chen and Goodman's discounts of each language, from its counts of counts."""
    kinds = [F.greatest(F.sum((F.col("n") == i).cast("long")), F.lit(1)).alias(f"n{i}") for i in range(1, 5)]
    n1, n2, n3, n4 = (F.col(f"n{i}") for i in range(1, 5))
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    held = [F.least(F.greatest(d, F.lit(0.05)), F.lit(i + 0.95)).alias(f"d{i + 1}") for i, d in enumerate(raw)]
    return table.groupBy("lang").agg(*kinds, (F.count(F.lit(1)) + 1).alias("symbols")).select("lang", *held, "symbols")


def _per_language(rows: DataFrame):
    """What to do to a table of one row a language before a join: broadcast it, unless ``rows`` has too many languages."""
    return F.broadcast if rows.select("lang").distinct().count() <= MOST_BROADCAST else lambda table: table


def probabilities(wanted: DataFrame, tables: dict[int, DataFrame]) -> DataFrame:
    """(lang, gram, logp) for each row of ``wanted`` (lang, gram; distinct, written): natural logarithm of the last symbol's probability.

    From the lowest order up, each for its own distinct n-grams only, so the short contexts that most n-grams share are
    joined while the tables are small. Languages without trusted text are left out.
    """
    asked = {ORDER: wanted.select("lang", F.col("gram").alias("g"))}
    for order in range(ORDER - 1, 0, -1):
        shorter = F.col("g").bitwiseAND((1 << (BITS * order)) - 1).alias("g")
        asked[order] = materialise(asked[order + 1].select("lang", shorter).distinct(), f"asked-{order}")
    per_language = _per_language(tables[1])
    below = None
    for order in range(1, ORDER + 1):
        counts = tables[order].select("lang", F.col("gram").alias("g"), "n")
        context = F.shiftrightunsigned("g", BITS).alias("h")
        contexts = counts.groupBy("lang", context).agg(
            F.sum("n").alias("total"), F.sum((F.col("n") == 1).cast("long")).alias("n1"),
            F.sum((F.col("n") == 2).cast("long")).alias("n2"), F.sum((F.col("n") > 2).cast("long")).alias("n3"),
        )
        discounts = materialise(_discounts(tables[order]), f"discounts-{order}")
        out = asked[order].join(per_language(discounts), "lang").withColumn("h", context)
        if order == 1:  # one context a language
            out = out.join(per_language(contexts.drop("h")), "lang").withColumn("lower", F.lit(1.0) / F.col("symbols"))
        else:
            out = out.join(contexts, ["lang", "h"], "left").withColumn("s", F.col("g").bitwiseAND((1 << (BITS * (order - 1))) - 1)).join(below, ["lang", "s"])
        out = out.join(counts, ["lang", "g"], "left")
        n = F.coalesce("n", F.lit(0))
        cut = F.when(n == 0, F.lit(0.0)).when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))
        gamma = (F.col("d1") * F.col("n1") + F.col("d2") * F.col("n2") + F.col("d3") * F.col("n3")) / F.col("total")
        p = F.when(F.col("total").isNull(), F.col("lower")).otherwise((n - cut) / F.col("total") + gamma * F.col("lower"))
        out = out.select("lang", "g", p.alias("lower"))
        below = materialise(out, f"probabilities-{order}").withColumnRenamed("g", "s") if order < ORDER else out
    return out.select("lang", F.col("g").alias("gram"), F.log("lower").alias("logp"))


# ---- scoring


def perplexities(docs: DataFrame, tables: dict[int, DataFrame], shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(id, lang, perplexity, chars) for each row of ``docs`` (id, lang, text); null where there is no text or no model."""
    placed = _placed(docs)
    places = _places(placed, shard_chars)
    asked = materialise(_tallied(placed, places).select("shard", "lang", "gram").distinct(), "asked")
    known = probabilities(materialise(asked.select("lang", "gram").distinct(), "asked-4"), tables)
    answers = asked.join(known, ["lang", "gram"]).select("shard", "lang", "gram", "logp")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            shard = pa.array(places.shard(batch.column(3).to_numpy(), batch.column(4).to_numpy()), pa.int64())
            columns = [batch.column(0), batch.column(1), *_packed(batch.column(2).to_pylist()), shard]
            yield pa.RecordBatch.from_arrays(columns, ["id", "lang", "packed", "size", "shard"])

    kind = docs.schema["id"].dataType.simpleString()
    sent = placed.mapInArrow(pack, f"id {kind}, lang string, packed binary, size long, shard long")

    def score(sent_: pa.Table, table: pa.Table) -> pa.Table:
        langs = sent_.column("lang")
        out, chars = np.full(len(sent_), np.nan), np.zeros(len(sent_), np.int64)
        for lang in langs.unique().to_pylist():
            here = np.flatnonzero(pa.compute.equal(langs, lang).to_numpy())
            model = table.filter(pa.compute.equal(table.column("lang"), lang)) if len(table) else table
            keys = model.column("gram").to_numpy()
            order = np.argsort(keys, kind="stable")
            keys, logs = keys[order], model.column("logp").to_numpy()[order]
            rows = sent_.take(pa.array(here))
            packed, sizes = rows.column("packed"), rows.column("size").to_pylist()
            for part in _parts_of(sizes):
                texts = [_unpack(b.as_py(), n) for b, n in zip(packed[part.start : part.stop], sizes[part], strict=True)]
                chars[here[part]] = [len(t.strip()) for t in texts]
                if not len(keys):
                    continue
                code, owner = grams(texts)
                n = len(texts)
                sums = np.bincount(owner, logs[np.searchsorted(keys, code)], minlength=n)
                seen = np.bincount(owner, minlength=n)
                with np.errstate(invalid="ignore"):
                    out[here[part]] = np.where(seen > 0, np.exp(-sums / np.maximum(seen, 1)), np.nan)
        columns = [sent_.column("id"), langs, pa.array(out, pa.float64(), from_pandas=True), pa.array(chars)]
        return pa.Table.from_arrays(columns, ["id", "lang", "perplexity", "chars"])

    # about two shards a partition, however many there are
    n = max(width(docs), (len(places.cuts) + 1) * places.pieces // 2)
    met = sent.repartition(n, "shard").groupBy("shard").cogroup(answers.repartition(n, "shard").groupBy("shard"))
    return met.applyInArrow(score, f"id {kind}, lang string, perplexity double, chars long")


def _below_most(at: Column, levels: list[float], n: Column) -> Column:
    """The first of the quantiles ``at`` of n values that isn't their maximum, or the first."""
    return F.coalesce(*[F.when(F.ceil(n * q) < n, at[i]) for i, q in enumerate(levels)], at[0])


def _limits(held: DataFrame, quantile: float) -> DataFrame:
    """(lang, threshold): the quantile of each language's perplexities.

    Where a language has so few that this is their maximum, its median times the quantile of perplexity over median of
    all languages.
    """
    levels = [quantile, *[q for q in SMALLER if q < quantile]]
    own = held.groupBy("lang").agg(
        F.percentile_approx("perplexity", [quantile, 0.5], 10_000).alias("at"), F.count("perplexity").alias("n")
    )
    own = materialise(own, "quantiles")
    ratio = held.join(_per_language(own)(own.select("lang", F.col("at")[1].alias("median"))), "lang").select((F.col("perplexity") / F.col("median")).alias("ratio"))
    pooled = ratio.agg(F.percentile_approx("ratio", levels, 10_000).alias("ratios"), F.count("ratio").alias("all"))
    few = F.ceil(F.col("n") * quantile) >= F.col("n")
    wide = F.col("at")[1] * _below_most(F.col("ratios"), levels, F.col("all"))
    return own.join(F.broadcast(pooled)).select("lang", F.when(few, wide).otherwise(F.col("at")[0]).alias("threshold"))


def quality(
    docs: DataFrame,
    trusted_ids: DataFrame,
    held_out_ids: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    lang_col: str = "lang",
    quantile: float = QUANTILE,
) -> DataFrame:
    """One row per row of ``docs``: id, lang, perplexity, threshold, kept.

    Trained on the texts of ``trusted_ids``; the threshold of a language is the ``quantile`` of the perplexities of the
    documents of ``held_out_ids``, trusted too but not trained on (``_limits`` for languages with few). A document is kept up
    to the threshold of its language, and where there is none; one without text has no perplexity and isn't kept. A null
    language is one of its own. Null ids are neither trusted nor held out; rows that repeat an id are rows of their own. Other
    columns are not read; texts are read whole, however long, by 500 rows at a time.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(lang_col, F.lit("")).alias("lang"), F.col(text_col).alias("text"))
    trusted = trusted_ids.select(F.col(id_col).alias("id")).filter("id IS NOT NULL").distinct()
    held = held_out_ids.select(F.col(id_col).alias("held_id")).filter("held_id IS NOT NULL").distinct()
    likely = _prefilter(rows.filter("id IS NOT NULL AND text IS NOT NULL"), may_be_in(trusted))
    tables = count_tables(likely.join(trusted, "id", "left_semi"))
    scored = materialise(perplexities(rows, tables), "perplexities")
    limits = materialise(_limits(scored.join(held, scored["id"] == held["held_id"], "left_semi"), quantile), "limits")
    limits = _per_language(limits)(limits.withColumnRenamed("lang", "lang_"))
    met = scored.join(limits, F.col("lang") == F.col("lang_"), "left")
    kept = (F.col("chars") > 0) & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return met.select(F.col("id").alias(id_col), F.col("lang"), "perplexity", "threshold", kept.alias("kept"))
