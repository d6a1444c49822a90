from __future__ import annotations

import random
import struct
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from larkspur.llm import chat, mixing, packing


def test_word_encoder_is_the_tokenizer():
    encoder = packing.WordEncoder(packing.default_tokenizer())
    assert encoder.by_word
    rng = random.Random(1)
    letters = "aB,. \n'sé’İßΣ<|>endoftext1$_%́क़\x1c 日"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += ["<|endoftext|> x", "<|EndOfText|>", "a<|startoftext|>b", None]
    assert list(encoder.encode(texts)) == [encoder.whole(t or "") for t in texts]


def test_best_fit_takes_the_tightest():
    rng = np.random.default_rng(3)
    lengths = np.sort(rng.integers(1, 101, 600))[::-1]
    bins, offsets = packing.best_fit(lengths, 100)
    room: dict[int, int] = {}
    for length, place, offset in zip(lengths.tolist(), bins.tolist(), offsets.tolist(), strict=True):
        fits = [r for r in room.values() if r >= length]
        if place in room:
            assert room[place] == min(fits) and offset == 100 - room[place]
        else:
            assert not fits and offset == 0
        room[place] = room.get(place, 100) - length
        assert room[place] >= 0


def check_pack(docs, rows):
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want = defaultdict(int)
    for r in docs.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        for p in range(0, len(ids), 2048):
            part = ids[p : p + 2048]
            want[(r.doc_id, p // 2048, p, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))] += 1
    got, sequences = defaultdict(int), defaultdict(list)
    for r in rows:
        got[(r.doc_id, r.piece, r.start, r.length, r.ids_crc32)] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    return len(sequences)


def test_packing(spark, make, odd):
    check_pack(odd, packing.pack(odd).collect())
    assert packing.pack(odd.limit(0)).count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack(docs).collect()
    assert check_pack(docs, rows) <= 1.03 * sum(r.length for r in rows) / 2048 + 1
    assert check_pack(docs, packing.pack(docs, shard=32).collect()) > 0


def test_packing_leaves_no_words_to_later_stages(make, sent, held):
    """A worker that has cut its documents keeps none of their words, and never has the strings of a whole batch together."""
    packing.pieces(make(["x"]), "text", "doc_id", packing.default_tokenizer())
    cut = sent[0]
    texts = [f"w{i} " + "some words of a text " * 100 for i in range(8000)]
    n, mb = held(cut, pa.record_batch({"row_no": pa.array(range(8000)), "id": pa.array(range(8000)), "text": texts}))
    assert n == 8000 and mb < 16
    encoder = packing.encoder(packing.default_tokenizer())
    assert not encoder.known and not encoder.before
    assert list(encoder.encode(["some words"])) == [encoder.whole("some words")]


def sainte_lague(votes, seats):
    """One seat at a time, by the highest quotient."""
    won = dict.fromkeys(votes, 0)
    for _ in range(seats):
        if not any(votes.values()):
            break
        best = min((k for k in votes if votes[k]), key=lambda k: (-Fraction(votes[k]) / (2 * won[k] + 1), k))
        won[best] += 1
    return won


@pytest.mark.parametrize("seed", range(6))
def test_apportionment_against_one_seat_at_a_time(spark, seed):
    rng = random.Random(seed)
    votes = {f"k{i:02}": rng.choice([0, 1, 7, rng.randint(0, 5000)]) for i in range(rng.randint(1, 12))}
    seats = rng.choice([0, 1, 5, 40, 333])
    df = spark.createDataFrame([(k, v, seats) for k, v in votes.items()], "k string, v long, seats long")
    assert {r.k: r.quota for r in mixing.apportion(df, [], "k", "v", "seats").collect()} == sainte_lague(votes, seats)


def test_mix(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r.taken <= 3 * r.size for r in rows)
    taken, target = defaultdict(int), {}
    for r in rows:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.target <= 3 * r.source_size + 1e-6
    assert sum(target.values()) == pytest.approx(sum(r.size for r in rows))
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 16 for s in target)
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(odd.limit(0)).count() == 0
    assert mixing.mixed_documents(odd).columns == odd.columns


def test_targets_stop_at_three_times_the_size(spark):
    df = spark.createDataFrame([("a", 10, 1.0), ("b", 100, 2.0), ("c", 1000, 3.0)], "source string, source_size long, weight double")
    got = {r.source: r.target for r in mixing.targets(df, 1110).collect()}
    assert got["a"] == 30 and got["b"] == 300 and got["c"] == pytest.approx(780)


def test_preferences_by_hand(spark):
    turns = "array<struct<role: string, text: string>>"
    a = [("user", "hi"), ("assistant", "yo"), ("user", "x"), ("assistant", "good")]
    b = [("user", "hi"), ("assistant", "yo"), ("user", "y"), ("assistant", "bad")]
    df = spark.createDataFrame([(1, a, b), (2, a, a), (3, None, b)], f"k int, chosen {turns}, rejected {turns}")
    got = {r.k: r for r in chat.format_preferences(df).collect()}
    assert got[1].prefix_turns == 2 and got[1].prompt == "<|user|>\nhi\n<|end|>\n<|assistant|>\nyo\n<|end|>\n"
    assert got[1].rejected_completion == "<|user|>\ny\n<|end|>\n<|assistant|>\nbad\n<|end|>\n"
    (span,) = got[1].rejected_spans
    assert got[1].rejected_completion[span.start : span.end] == "bad\n<|end|>"
    assert got[2].chosen_completion == "" and got[2].prefix_turns == 4
    assert got[3].prompt == "" and got[3].prefix_turns == 0 and got[3].chosen_spans == []


def test_pairs_with_odd_turns(spark):
    rows = [(0, 0, "user", None), (0, 1, "assistant", "a"), (2, 0, None, "q"), (2, 0, None, "q"), (2, 1, "assistant", "b"), (4, 0, "user", "no reply"), (None, 0, "user", "x"), (6, 0, "assistant", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit("clash"))
    for ids in (df, df.withColumn("conv_id", F.concat(F.lit("c"), "conv_id"))):
        got = chat.partnered_pairs(ids).collect()
        assert len(got) == 3 and len({r.partner for r in got}) == 3 and all(r.partner != r.conv_id for r in got)
    two = {r.conv_id: r for r in chat.partnered_pairs(df).collect()}[2]
    assert [t.role for t in two.chosen] == ["unknown", "unknown", "assistant"] and two.rejected[:2] == two.chosen[:2]
    lone = chat.partnered_pairs(df.filter("conv_id = 0")).first()
    assert lone.partner == 0 and lone.chosen == lone.rejected
    assert chat.format_preferences(chat.partnered_pairs(df.limit(0))).count() == 0


def test_pairs_of_one_opening_share_a_prefix(spark):
    """A hot opening makes several circles; whole conversations meet, so prefixes vary and no conversation is lost."""
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", "hi" if t == 0 or t < c % 5 else f"{c} {t}") for c in range(60) for t in range(6)]
    rows += [(100 + c, t, "user" if t % 2 == 0 else "assistant", f"alone {c} {t}") for c in range(20) for t in range(6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    pairs = chat.partnered_pairs(df, circle=20)
    made = {r.conv_id: r for r in chat.format_preferences(pairs).collect()}
    held = {r.conv_id: r for r in pairs.collect()}
    assert set(made) == set(range(60)) | set(range(100, 120)) and sorted(r.partner for r in held.values()) == sorted(made)
    assert all((r.partner < 60) == (c < 60) and r.partner != c for c, r in held.items())
    for c, r in held.items():
        same = next((i for i, (a, b) in enumerate(zip(r.chosen, r.rejected)) if a != b), min(len(r.chosen), len(r.rejected)))
        assert made[c].prefix_turns == same and (c >= 60 or same >= 1)
    assert len({r.prefix_turns for c, r in made.items() if c < 60}) > 2 and len({r.prefix_turns for c, r in made.items() if c >= 60}) > 1


def test_preferences_keep_columns_of_any_name(spark):
    turns = "array<struct<role: string, text: string>>"
    a, b = [("user", "hi"), ("assistant", "yo")], [("user", "hi"), ("assistant", "no")]
    names = ["_a", "_b", "_ra", "row", "n", "a.b", "prompt", "prefix_turns"]
    df = spark.createDataFrame([(*names, a, b)], ", ".join(f"`{x}` string" for x in names) + f", chosen {turns}, rejected {turns}")
    got = chat.format_preferences(df)
    assert got.columns == [*names[:6], *chat.OUT]
    assert got.first()["a.b"] == "a.b" and got.first()["prefix_turns"] == 1


def highest_quotients(votes, seats):
    won = dict.fromkeys(votes, 0)
    for _ in range(seats):
        won[min(votes, key=lambda k: (-votes[k] / (2 * won[k] + 1), k))] += 1
    return won


def test_taken_against_brute_force(spark, make):
    """Seats by highest quotients for sources and shards, and the words of a seeded run of blocks counted one by one."""
    rng = random.Random(12)
    docs = make([(i // 2, " ".join(["w"] * rng.choice([0, 1, 3, 17, 40])), "en", rng.choice("aab") if i % 9 else None) for i in range(300)])
    shard, seed, block, epochs = 400, 8, 8, 3
    got = mixing.mix(docs, shard=shard, seed=seed, block=block).collect()
    size_of = {r.source: r.source_size for r in got}
    total = sum(r.size for r in got)
    key = lambda s: (s is None, s or "")
    aims = {key(r.source): r.target for r in got}
    seats = highest_quotients(aims, round(total / block))
    held = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"), F.xxhash64(F.lit(seed + 1), "doc_id").alias("order"))
    want = []
    for source, source_size in size_of.items():
        shards = max(1, -(-source_size // shard))
        own = held.filter(F.col("source").eqNullSafe(F.lit(source))).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), "size", "tie"), F.lit(shards)))
        first = spark.range(shards).select(F.xxhash64(F.lit(seed + 2), F.lit(source).cast("string"), "id").alias("f")).collect()
        rows = own.collect()
        words = {k: sum(r["size"] for r in rows if r.shard == k) for k in range(shards)}
        quota = highest_quotients({k: w for k, w in words.items() if w}, seats[key(source)])
        want += [(r.doc_id, 0, 0) for r in rows if r["size"] == 0]
        for k in quota:
            line = sorted((r for r in rows if r.shard == k and r["size"]), key=lambda r: (r.order, r.doc_id, r["size"], r.tie))
            blocks = -(-words[k] // block)
            whole, rest = divmod(min(quota[k], blocks * epochs), blocks)
            lies = [i for i, r in enumerate(line) for _ in range(r["size"])]
            taken = [r["size"] * whole for r in line]
            for b in range(first[k].f % blocks, first[k].f % blocks + rest):
                for i in lies[b % blocks * block : (b % blocks + 1) * block]:
                    taken[i] += 1
            want += [(r.doc_id, r["size"], t) for r, t in zip(line, taken, strict=True)]
    assert sorted((r.doc_id, r["size"], r.taken) for r in got) == sorted(want)
