"""Best-fit packing of tokenised documents into fixed-length sequences.

Best-fit decreasing, in shards that hold a bounded number of pieces each: pieces are placed longest first, each into the
open sequence with the least room that still takes it. A segment tree over the possible remaining capacities finds that
sequence in logarithmic time. A shard can leave one sequence per size class badly filled at most, so the loss against
one global pack is a few sequences for each shard of tens of thousands of pieces.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from itertools import batched
from pathlib import Path
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import materialise, width

SEQUENCE, END = 2048, 0
#: Pieces of a packing shard.
SHARD = 32_768
#: Words whose ids a task remembers, about 150 bytes each, and as many that it has met before those.
REMEMBERED = 500_000

_stop = re.compile(rb"[.,](?<=[a-z].)")

_encoders: dict[str, WordEncoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of a text as little-endian uint32 bytes, word by word, with the words met before remembered.

    For tokenizers that lower-case, drop white space and never join letters with what isn't a letter, as
    ``word_bpe_49k.json``: the ids of a text are then those of its words in turn, and a full stop or comma after a letter
    may stand apart. Whether that holds is tried when the tokenizer is loaded; other tokenizers get whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}  # the words remembered before those in ``known``
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        probe = "A Quick test, isn't it?\n\t42 ÉTÉ., x.y ,z  $$$, a.b Ünder."
        self.by_word = self.whole(probe) == b"".join(self.whole(w.decode()) for w in self.words(probe))

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    @staticmethod
    def words(text: str) -> list[bytes]:
        return _stop.sub(rb" \g<0>", text.encode().lower()).split()

    def learn(self, words: list[bytes]) -> None:
        """Remember the ids of ``words``: of those of letters alone together, of others one by one."""
        plain, texts = [], []
        for w in words:
            (plain if (t := w.decode()).isalpha() else texts).append(t)
        for at in range(0, len(plain), 1000):
            part = plain[at : at + 1000]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(part):  # letters that come apart
                texts += part
                continue
            flat, ends = ids.tobytes(), (4 * ends).tolist()
            self.known.update((w.encode(), flat[a:b]) for w, a, b in zip(part, [0, *ends], ends, strict=False))
        for at in range(0, len(texts), 1000):
            part = texts[at : at + 1000]
            found = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            self.known.update((w.encode(), np.array(e.ids, "<u4").tobytes()) for w, e in zip(part, found, strict=True))

    def forget(self) -> None:
        """Let go of the words, as the worker lives on for tasks of other stages."""
        self.known, self.before = {}, {}

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text (null: none)."""
        for some in batched(texts, 64):
            part = [t or "" for t in some]
            # special tokens are told by their case
            split = [self.words(t) if self.by_word and "<|" not in t else None for t in part]
            if len(self.known) > REMEMBERED:
                self.known, self.before = {}, self.known
            new = [w for w in set().union(*filter(None, split)) if w not in self.known]
            old = [w for w in new if w in self.before]
            self.known.update((w, self.before[w]) for w in old)
            self.learn([w for w in new if w not in self.known])
            known = self.known
            for words, text in zip(split, part, strict=True):
                yield self.whole(text) if words is None else b"".join([known[w] for w in words])


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and file; the file is a local path, or one sent with ``SparkContext.addFile``."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path if Path(path).exists() else SparkFiles.get(Path(path).name))
    return _encoders[path]


def pieces(docs: DataFrame, text_col: str, id_col: str, tokenizer: str, size: int = SEQUENCE, end: int = END) -> DataFrame:
    """(row_no, id, piece, start, length, ids_crc32): each document's ids and ``end``, cut every ``size`` ids."""
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(tokenizer)
        try:
            for batch in batches:
                out: dict[str, list] = {"at": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
                # the texts are read a few at a time: strings and ids of a whole batch are never held together
                for row, ids in enumerate(known.encode(t.as_py() for t in batch.column(2))):
                    ids += last
                    for piece, at in enumerate(range(0, len(ids), 4 * size)):
                        part = ids[at : at + 4 * size]
                        for name, value in zip(out, (row, piece, at // 4, len(part) // 4, crc32(part)), strict=True):
                            out[name].append(value)
                at = pa.array(out.pop("at"), pa.int64())
                columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(out.pop("piece"), pa.int32())]
                columns += [pa.array(v, pa.int64()) for v in out.values()]
                yield pa.RecordBatch.from_arrays(columns, ["row_no", "id", "piece", "start", "length", "ids_crc32"])
        finally:
            known.forget()

    rows = docs.select(F.monotonically_increasing_id().alias("row_no"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"row_no long, id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, size: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of pieces given longest first; lengths are 1 to ``size``.

    Leaf c of the segment tree counts the open bins with room c; a node holds their sum. The tightest bin for a
    piece is the leftmost non-empty leaf from its length on.
    """
    leaves = 1 << size.bit_length()
    tree, open_bins = [0] * (2 * leaves), [[] for _ in range(leaves)]

    def change(room: int, by: int) -> None:
        node = leaves + room
        while node:
            tree[node] += by
            node >>= 1

    bins, offsets, count = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, length in enumerate(lengths.tolist()):
        node = leaves + length
        if not tree[node]:
            # up until a right sibling has an open bin, then down to its leftmost
            while node > 1 and (node & 1 or not tree[node + 1]):
                node >>= 1
            if node > 1:
                node += 1
                while node < leaves:
                    node = 2 * node if tree[2 * node] else 2 * node + 1
        if node <= 1:
            place, room = count, size
            count += 1
        else:
            room = node - leaves
            place = open_bins[room].pop()
            change(room, -1)
        bins[i], offsets[i] = place, size - room
        if room > length:
            open_bins[room - length].append(place)
            change(room - length, 1)
    return bins, offsets


def pack(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    tokenizer: str | None = None,
    size: int = SEQUENCE,
    end: int = END,
    shard: int = SHARD,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text counts as empty: its only id is ``end``. Documents longer than a sequence are cut into pieces of
    ``size``, the last may be shorter; no others are cut. Rows that repeat an id are packed like any others. An empty
    table gives no rows. Only the id and the text are read, so names of other columns don't matter.
    """
    cut = materialise(pieces(docs, text_col, id_col, tokenizer or default_tokenizer(), size, end), "pieces")
    shards = max(1, -(-cut.filter(F.col("length") < size).count() // shard))
    full = cut.filter(F.col("length") == size).select(
        "id", "piece", "start", "length", "ids_crc32",
        (-1 - F.monotonically_increasing_id()).alias("sequence_id"),  # negative: one whole piece each
        F.lit(0).cast("long").alias("offset"),
    )

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "row_no", "piece"], ascending=[False, True, True], ignore_index=True)
        rows["sequence_id"], rows["offset"] = best_fit(rows["length"].to_numpy(), size)
        rows["sequence_id"] += int(key[0]) << 32
        return rows.drop(columns=["row_no", "shard"])

    kind = cut.schema["id"].dataType.simpleString()
    rest = (
        cut.filter(F.col("length") < size)
        .withColumn("shard", F.pmod(F.xxhash64("row_no", "piece"), F.lit(shards)).cast("int"))
        .repartition(width(cut), "shard")
        .groupBy("shard")
        .applyInPandas(place, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    )
    return rest.unionByName(full).withColumnRenamed("id", id_col)
