from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur.llm import fingerprint, kneser_ney, langid, pii, queries, toxicity

SF = "/root/testdata/sf0.01"


def brute_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for kind, pattern, least, most in ((2, r"[0-9]([\x20-]?[0-9])+", 12, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if least <= len(digits) <= most and (kind == 3 or pii.luhn(digits)):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


@pytest.mark.parametrize("letters", ["ab1.@-+ 23()_%é\n0", "1234.25 0-+()"])
def test_base_spans_against_plain_patterns(letters):
    rng = random.Random(0)
    for _ in range(15_000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 45)))
        assert pii.base_spans(text) == brute_spans(text), text


def test_pii_query_rows(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in pii.find_pii(docs).collect():
        base = brute_spans(texts[r.doc_id])
        named = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(named).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        assert set(named) <= set(filter(None, r.spans.split(",")))
    assert pii.find_pii(odd).count() == odd.count() and pii.find_pii(odd.limit(0)).count() == 0


def test_trees_add_numbers_in_the_form_of_phones(spark, make):
    rng = random.Random(4)
    form = lambda: f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    texts = [f"please call {i} me at +1 {form()} today" for i in range(300)] + [f"order id {rng.randint(10**7, 10**8)} was sent {i}" for i in range(300)]
    got = {r.doc_id: r for r in pii.find_pii(make(texts)).collect()}
    assert sum(r.n_phone for r in got.values()) == 300
    assert sum(r.added for r in got.values() if r.doc_id >= 300) == 0


def test_trees_add_loose_forms(spark, make):
    rng = random.Random(11)
    n = lambda a, b: rng.randint(a, b)
    form = lambda: f"{n(200, 999)} {n(200, 999)}-{n(1000, 9999)}"
    name = lambda: "".join(rng.choice("abcdefgh") for _ in range(n(4, 9)))
    strict = [f"mail {name()}@{name()}.com or call +1 {form()} about host {n(1, 255)}.{n(0, 255)}.{n(0, 255)}.{n(0, 255)} today" for _ in range(400)]
    decoys = [f"order id {n(10**8, 10**9)} came at {n(10, 23)}:{n(10, 59)}:{n(10, 59)} from build {n(300, 999)}.{n(0, 255)}.{n(0, 255)}.{n(0, 255)} to @{name()} or x@{name()}" for _ in range(400)]
    planted = []
    for _ in range(200):
        host = ":".join(f"{n(4096, 65535):x}" for _ in range(8)) if n(0, 1) else f"2001:db8::{n(1, 65535):x}"
        planted.append((f"{name()} [at] {name()} [dot] com", f"1 {form()}", host))
    loose = [f"mail {a} or call {b} about host {c} today" for a, b, c in planted]
    got = {r.doc_id: r for r in pii.find_pii(make(strict + decoys + loose)).collect()}
    found = [0, 0, 0]
    for i, spans in enumerate(planted):
        named = set(got[800 + i].spans.split(","))
        for k, (kind, part) in enumerate(zip(("email", "phone", "ip"), spans, strict=True)):
            at = loose[i].index(part)
            found[k] += f"{kind}:{at}:{at + len(part)}" in named
    assert min(found) > 180, found
    assert sum(got[i].added for i in range(800)) == 0


def test_trees_add_secrets_and_pass_decoys_by(spark, make):
    """Recall of secrets in contexts that the seeds don't show, and precision against checksums and order numbers."""
    rng = random.Random(13)
    hexed = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    mixed = lambda n: "".join(rng.choice("ABCDEFGHKLMNabcdefghkmn0123456789") for _ in range(n))
    seeds = [f'they wrote token = "{hexed(40)}" and went home {i}' for i in range(300)]
    others = [f"password: {mixed(24)} is what they said" if i % 2 else f"Authorization: Bearer {mixed(32)} was sent" for i in range(100)]
    clean = [rng.choice([f"at commit {hexed(40)} of the tree", f"sha256:{hexed(64)} is the sum", f"the order id 4{rng.randint(10**8, 10**9)} of page-section-12-34-{i}", "nothing to see here"]) for i in range(300)]
    docs = make(seeds + others + clean)
    got = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    found = [got[i].n_secret for i in range(400)]
    # a token that has a card's number inside keeps that base span
    assert all(n or brute_spans(t) for n, t in zip(found, seeds, strict=False)) and sum(found[300:]) >= 85
    assert sum(got[i].added for i in range(400, 700)) <= 6
    spans = {i: r.spans for i, r in got.items()}
    texts = {r.doc_id: r.text for r in pii.redact(docs.withColumn("id", F.lit("x"))).collect()}
    assert len(texts) == 700 and texts[0] == 'they wrote token = "[secret]" and went home 0'
    assert all((texts[i] != t) == bool(spans[i]) for i, t in enumerate(seeds + others + clean))


def test_secrets_of_the_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    told = {r.doc_id: len(re.findall(r'token = "[0-9a-f]{40}"', r.text or "")) for r in docs.collect()}
    got = {r.doc_id: r.n_secret for r in pii.find_pii(docs).collect()}
    assert sum(told.values()) > 5 and all(got[i] >= n for i, n in told.items())
    assert sum(got.values()) <= 1.1 * sum(told.values())


def test_redaction(spark, odd, make):
    assert pii.redact(odd).columns == odd.columns and pii.redact(odd).count() == odd.count()
    held = make(["to a@b.co now, +1 (234) 555-6789 and 10.0.0.1", None, ""])
    assert [r.text for r in pii.redact(held).orderBy("doc_id").collect()] == ["to [email] now, [phone] and [ip]", None, ""]


def test_language_on_held_out_documents(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs.filter(~langid.held_out()))
    got = langid.identify(docs.filter(langid.held_out()), model).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.98 and all(0 <= r.score <= 1 for r in got)
    strange = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert [strange[i].lang_pred for i in (1, 2, 3, 9)] == ["und"] * 4 and strange[1].score == 0
    assert langid.classify(model, ["½ ② 三 ٣", "½ ②", "Ⅷ _", "ñ"])[0][1:3] == ["und", "und"] and langid.classify(model, ["ñ"])[0] != ["und"]
    assert "clash" in strange[4].asDict().values()
    none = langid.train(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(docs.limit(3), none).collect()} == {"und"}


def test_ngrams_stay_within_texts():
    texts = ["Hello World", "", "été", "x", "İstanbul"]
    buckets, owner = langid.grams(texts)
    for i, t in enumerate(texts):
        alone, _ = langid.grams([t])
        assert sorted(alone) == sorted(buckets[owner == i])


def test_naive_bayes_against_brute_force(spark, make):
    docs = make([(i, t, lang, None) for i, (t, lang) in enumerate([("the cat sat", "en"), ("the dog", "en"), ("le chat", "fr"), ("un chien", "fr")])])
    model = langid.train(docs)
    for text in ("the chat", "un cat", "dog"):
        sums = []
        for k, lang in enumerate(model.languages):
            counts = Counter()
            for r in docs.filter(F.col("lang") == lang).collect():
                counts.update(langid.grams([r.text])[0].tolist())
            total = sum(counts.values()) + langid.ALPHA * langid.BUCKETS
            sums.append(sum(math.log((counts[b] + langid.ALPHA) / total) for b in langid.grams([text])[0].tolist()) + model.prior[k])
        assert langid.classify(model, [text])[0] == [model.languages[int(np.argmax(sums))]]


def test_language_id_never_holds_a_whole_batch(make, sent, held):
    """Neither counting nor scoring has the strings or n-grams of a batch together, however many rows it has."""
    docs = make([(1, "some words", "en", "s"), (2, "ein paar Worte", "de", "s")])
    model = langid.train(docs)
    got = langid.identify(docs, model)
    count, score = sent
    texts = [None if i % 500 == 0 else f"{i} " + "some words of a text " * 100 for i in range(4000)]
    there = [t for t in texts if t]
    n, mb = held(count, pa.record_batch({"text": there, "lang": ["en"] * len(there)}))
    assert n > 0 and mb < 30
    columns = {"c0": pa.array(range(4000)), "c1": texts, "c2": ["en"] * 4000, "c3": ["s"] * 4000, "c4": pa.nulls(4000, pa.int64())}
    n, mb = held(score, pa.record_batch(columns))
    assert n == 4000 and mb < 30
    assert got.count() == 2


def brute_marginals(e, chain):
    from itertools import product

    weights = Counter()
    for states in product((0, 1), repeat=len(e)):
        w = chain.start * states[0] + sum(x * s for x, s in zip(e, states, strict=True)) + sum(chain.moves[a][b] for a, b in zip(states, states[1:], strict=False))
        for i, s in enumerate(states):
            weights[(i, s)] += math.exp(w)
    return [weights[(i, 1)] / (weights[(i, 0)] + weights[(i, 1)]) for i in range(len(e))]


def test_marginals_against_all_paths():
    chain = toxicity.Chain(np.zeros(4), 0.3, np.array([[0.5, -0.4], [0.2, 0.9]]))
    rng = np.random.default_rng(5)
    texts = [rng.normal(size=n) for n in (3, 0, 7, 1, 7)]
    for e, p in zip(texts, toxicity.marginals(texts, chain), strict=True):
        assert p == pytest.approx(brute_marginals(e, chain) if len(e) else [])


def brute_likelihood(texts, labels, weights, extra):
    """Log likelihood by all paths; emissions from features looked up one by one."""
    from itertools import product

    total, moves = 0.0, extra[1:].reshape(2, 2)
    for words, y in zip(texts, labels, strict=True):
        if not words:
            continue
        feats = [toxicity._features(w) for w in words]
        e = [sum(weights[f] for f in own) for own, _, _ in feats]
        for i in range(len(words) - 1):
            e[i + 1] += weights[feats[i][1]]
            e[i] += weights[feats[i + 1][2]]
        score = lambda s: extra[0] * s[0] + sum(x * k for x, k in zip(e, s, strict=True)) + sum(moves[a][b] for a, b in zip(s, s[1:], strict=False))  # noqa: B023, E731
        total += score(y) - math.log(sum(math.exp(score(s)) for s in product((0, 1), repeat=len(words))))
    return total


def test_gradient_against_finite_differences():
    rng = np.random.default_rng(3)
    texts = [["a", "bad", "word", "a"], [], ["bad"], ["some", "bad", "bad", "one", "a", "bad"]]
    labels = [[0, 1, 0, 0], [], [1], [0, 1, 1, 0, 0, 0]]
    weights, extra = rng.normal(size=toxicity.HASHED) / 2, rng.normal(size=5)
    slope = toxicity.gradient(toxicity.Labelled.of(texts, labels), weights, extra)
    used = sorted({f for t in texts for w in t for own, left, right in [toxicity._features(w)] for f in (*own, left, right)})
    assert not np.delete(slope[:-5], used).any()
    for k in [*used, *range(toxicity.HASHED, toxicity.HASHED + 5)]:
        sides = []
        for by in (1e-5, -1e-5):
            both = np.concatenate([weights, extra])
            both[k] += by
            sides.append(brute_likelihood(texts, labels, both[:-5], both[-5:]))
        assert slope[k] == pytest.approx((sides[0] - sides[1]) / 2e-5, abs=1e-6)
    cut = [["a", "bad"], ["word", "a"]]  # chains of two tokens keep their neighbours' features
    whole = toxicity.gradient(toxicity.Labelled.of([["a", "bad", "word", "a"]], [[0, 1, 0, 0]]), weights, extra, chunk=2)
    alone = toxicity.gradient(toxicity.Labelled.of(cut, [[0, 1], [0, 0]]), weights, extra, chunk=2)
    assert whole.shape == alone.shape and not np.allclose(whole, alone)


def test_chain_learns_what_it_is_shown():
    texts = [["a", "bad", "b"], ["a", "good", "b"], ["bad", "bad", "a"]] * 40
    labels = [[0, 1, 0], [0, 0, 0], [1, 1, 0]] * 40
    chain = toxicity.fit_chain(texts, labels)
    p = toxicity.marginals([toxicity.along(np.array([chain.emission(w) for w in row])) for row in texts[:3]], chain)
    assert all(((x > 0.5) == (np.array(y) == 1)).all() for x, y in zip(p, labels[:3], strict=True))


def test_neighbours_tell_a_word_apart():
    texts = [["you", "bloody", "fool"], ["a", "bloody", "nose"]] * 60
    labels = [[0, 1, 1], [0, 0, 0]] * 60
    chain = toxicity.fit_chain(texts, labels)
    p = toxicity.marginals([toxicity.along(np.array([chain.emission(w) for w in row])) for row in texts[:2]], chain)
    assert p[0][1] > 0.5 > p[1][1]


def test_tags_and_scores_against_brute_force(spark, make):
    """Sums, spans and offsets of documents, and the fit in tasks against the one at hand."""
    rng = random.Random(15)
    texts = [" ".join(rng.choice(["You", "awful", "fine", "Day,", "été", "x1", "ugly"]) for _ in range(rng.randint(0, 8))) for _ in range(60)] + [None]
    words = [re.findall(r"[^\W\d_]+", (t or "").lower()) for t in texts]
    docs = make(texts).withColumn("toxic", (F.col("doc_id") % 2).cast("int"))
    chain = toxicity.fit_chain(words, [[int(i % 2 and w in ("awful", "ugly")) for w in t] for i, t in enumerate(words)], rounds=6)
    dealt = toxicity.train_chain(docs.filter("text IS NOT NULL"), ["awful", "ugly"], rounds=6)
    assert np.allclose(chain.weights, dealt.weights) and np.allclose(chain.moves, dealt.moves)
    got = {r.id: r for r in toxicity.tag(docs, chain).collect()}
    for i, t in enumerate(words):
        parts = [chain.emission(w) for w in t]
        e = [parts[k][0] + (parts[k - 1][1] if k else 0) + (parts[k + 1][2] if k + 1 < len(t) else 0) for k in range(len(t))]
        p = brute_marginals(e, chain) if t else []
        assert got[i].toxic_tokens == pytest.approx(sum(x for x in p if x >= toxicity.FLOOR))
        spans = [f"{m.start()}:{m.end()}" for m, x in zip(re.finditer(r"[^\W\d_]+", texts[i] or ""), p, strict=True) if x > 0.5]
        assert got[i].spans == ",".join(spans)


def test_many_languages_are_as_one_matrix(spark, make, monkeypatch):
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyzéßñøж"
    speak = {f"l{i:02}": rng.sample(letters, 8) for i in range(23)}
    say = lambda lang, n: " ".join("".join(rng.choice(speak[lang]) for _ in range(rng.randint(2, 6))) for _ in range(n))
    docs = make([(i, say(lang, 12), lang, "s") for i, lang in enumerate(list(speak) * 6)])
    asked = make([(i, say(lang, 3), lang, "s") for i, lang in enumerate(list(speak) * 4)] + [(900, None, None, None), (901, "12", None, None), (902, "", None, None)])
    whole = langid.train(docs)
    want = sorted(map(tuple, langid.identify(asked, whole).select("doc_id", "lang_pred", "score").collect()))
    assert whole.rest == () and sum(x[1] == langid.UNKNOWN for x in want) == 3
    monkeypatch.setattr(langid, "BLOCK", 5)
    parts = langid.train(docs)
    assert len(parts.rest) == 4 and [x for m in (parts, *parts.rest) for x in m.languages] == sorted(speak)
    assert all(len(m.log_p) == langid.BUCKETS for m in (parts, *parts.rest))
    got = sorted(map(tuple, langid.identify(asked, parts).select("doc_id", "lang_pred", "score").collect()))
    assert [x[:2] for x in got] == [x[:2] for x in want] and [x[2] for x in got] == pytest.approx([x[2] for x in want])
    texts = [r.text for r in asked.orderBy("doc_id").collect()]
    assert langid.classify(parts, texts)[0] == langid.classify(whole, texts)[0] == [x[1] for x in want]
    monkeypatch.setattr(langid, "MOST", 23)
    with pytest.raises(ValueError, match="no languages"):
        langid.train(docs)


def test_odd_rows_meet_the_chain(spark, make, odd):
    rng = random.Random(9)
    part = ["sun", "moon", "tree", "ri", "sto", "bir", "clo", "fie", "na", "to"]
    plain = lambda: " ".join(rng.choice(part) + rng.choice(part) for _ in range(12))
    texts = [(100 + i, f"{plain()} {rng.choice(['awful', 'nasty'])} {plain()}" if i % 4 == 0 else plain(), "en", "s") for i in range(240)]
    docs = odd.unionByName(make(texts), allowMissingColumns=True)
    labels = spark.createDataFrame([(100 + i, int(i % 4 == 0)) for i in range(240)] + [(1, 1), (2, 0), (3, 1), (6, 0), (7, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert all(by[100 + i].predicted == (i % 4 == 0) for i in range(240))
    empty = [by[i] for i in (1, 2, 3, 9)]
    assert {(r.spans, r.toxic_tokens) for r in empty} == {("", 0.0)} and len({r.score for r in empty}) == 1 and not any(r.predicted for r in empty)
    assert len([r for r in got if r.doc_id == 5]) == 2 and by[7].predicted == 0


def test_toxicity_on_held_out_documents(spark, odd):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    told = docs.join(labels.select("doc_id", "toxic"), "doc_id", "left")
    scored = toxicity.score_toxicity(docs, labels.filter(~langid.held_out()))
    seen = scored.join(told.filter(langid.held_out() & F.col("toxic").isNotNull()).select("doc_id", "toxic", "text"), "doc_id").collect()
    bad, clean = ([r.predicted for r in seen if r.toxic == k] for k in (1, 0))
    assert np.mean(bad) >= 0.85 and np.mean(clean) < 0.02
    tagged = next(r for r in seen if r.spans)
    start, end = map(int, tagged.spans.split(",")[0].split(":"))
    assert tagged.text[start:end].isalpha()
    assert toxicity.score_toxicity(odd, labels.limit(0)).count() == odd.count()
    assert toxicity.score_toxicity(odd.limit(0), labels).count() == 0


def test_sample_of_repeated_ids(spark, make):
    docs = make([(i % 4, f"text {i}", "en", "s") for i in range(40)] + [(None, "x", "en", "s")])
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    sample, sizes = toxicity.sample_labelled(docs, labels, "text", "doc_id", "toxic")
    assert sizes == {1: 1, 0: 1} and sorted((r.id, r.toxic) for r in sample.collect()) == [(0, 1), (1, 0)]


def brute_model(texts):
    symbols = lambda t: ["^"] * 3 + list(" ".join(t.split()))
    c = {4: Counter()}
    for t in texts:
        s = symbols(t)
        c[4].update(tuple(s[k - 3 : k + 1]) for k in range(3, len(s)))
    for o in (3, 2, 1):
        c[o] = Counter(g[1:] for g in c[o + 1])
    d, ctx = {}, {}
    for o in c:
        n = [max(1, sum(v == i for v in c[o].values())) for i in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1])
        raw = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
        d[o] = [min(max(x, 0.05), i + 0.95) for i, x in enumerate(raw)]
        ctx[o] = defaultdict(lambda: [0, 0, 0, 0])
        for g, v in c[o].items():
            ctx[o][g[:-1]][0] += v
            ctx[o][g[:-1]][min(v, 3)] += 1

    def perplexity(t):
        s, lp = symbols(t), 0.0
        for k in range(3, len(s)):
            p = 1 / (len(c[1]) + 1)
            for o in range(1, 5):
                g = tuple(s[k - o + 1 : k + 1])
                if g[:-1] in ctx[o]:
                    total, a, b, e = ctx[o][g[:-1]]
                    n = c[o].get(g, 0)
                    p = (n - (d[o][min(n, 3) - 1] if n else 0)) / total + (d[o][0] * a + d[o][1] * b + d[o][2] * e) / total * p
            lp += math.log(p)
        return math.exp(-lp / (len(s) - 3)) if len(s) > 3 else None

    return perplexity


def test_perplexity_against_brute_force(spark, make):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["ab", "abc", "ba", "é"]) for _ in range(rng.randint(0, 12))) for _ in range(60)] + [None]
    docs = make(texts)
    ids = docs.select("doc_id")
    got = {r.doc_id: r for r in kneser_ney.quality(docs, ids.filter("doc_id < 40"), ids.filter("doc_id >= 40")).collect()}
    expected = brute_model([t for t in texts[:40] if t])
    for i, t in enumerate(texts):
        want = expected(t or "")
        assert got[i].perplexity == (pytest.approx(want) if want else None)
    assert not got[60].kept


def test_shards_of_repeated_and_null_ids(spark, make):
    """Scores don't depend on shards, and a frequent id is dealt to several."""
    rng = random.Random(16)
    texts = [" ".join(rng.choice(["ab", "abc", "ba"]) for _ in range(30)) for _ in range(90)]
    docs = make([(None if i % 3 == 0 else 7 if i % 3 == 1 else i, t, "en", "s") for i, t in enumerate(texts)])
    rows = docs.select(F.col("doc_id").alias("id"), "lang", "text")
    tables = kneser_ney.count_tables(rows)
    one, many = (sorted((r.id or -1, r.perplexity) for r in kneser_ney.perplexities(rows, tables, size).collect()) for size in (10**9, 500))
    assert len(one) == 90 and all(a[0] == b[0] and a[1] == pytest.approx(b[1]) for a, b in zip(one, many, strict=True))
    places = kneser_ney._places(kneser_ney._placed(rows), 500)
    assert places.hot[7] > 3 and len(places.cuts) > 3
    assert len(set(places.shard(np.full(30, 7), np.arange(30)).tolist())) == places.hot[7]


def test_quality_of_odd_rows(odd):
    ids = odd.select("doc_id")
    got = kneser_ney.quality(odd, ids, ids).collect()
    assert len(got) == odd.count() and not any(r.kept for r in got if r.doc_id in (1, 2, 3))
    assert all(r.kept for r in kneser_ney.quality(odd, ids.limit(0), ids).collect() if r.doc_id in (4, 5))
    assert kneser_ney.quality(odd.limit(0), ids, ids).count() == 0


def test_symbols_do_not_share_codes(spark, make):
    apart = ["\u4e00", chr(0x4E00 + 2046), "\u0e01", chr(0x0E01 + 2046), "\U0001f600", chr(0x1F600 + 2046)]
    assert len({tuple(kneser_ney.grams([t])[0].tolist()) for t in apart}) == len(apart)
    assert kneser_ney.grams(["a\uffffb", "", "\U0001f600"])[1].tolist() == [0, 0, 2, 2]
    rng = random.Random(8)
    letters = [chr(0x4E00 + 2046 * (i % 3) + i % 7) for i in range(21)] + ["\uac00", "\ufffd"]
    texts = ["".join(rng.choice(letters) for _ in range(30)) for _ in range(40)]
    ids = make(texts).select("doc_id")
    got = {r.doc_id: r for r in kneser_ney.quality(make(texts), ids.filter("doc_id < 30"), ids.filter("doc_id >= 30")).collect()}
    expected = brute_model(texts[:30])
    assert all(got[i].perplexity == pytest.approx(expected(t)) for i, t in enumerate(texts))


def test_quality_on_held_out_labels(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = queries.op6_kneser_ney_quality(spark, SF).join(labels.filter(langid.held_out()), "doc_id").collect()
    junk, good = ([r.kept for r in got if r.quality == q] for q in (0, 1))
    assert np.mean(junk) < 0.15 and np.mean(good) > 0.85


def test_one_odd_trusted_text_does_not_set_the_threshold(spark, make):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["the", "cat", "sat", "on", "mats"]) for _ in range(20)) for _ in range(60)] + ["#x}9^ @@~~ zzq", "$%7!! qjx ]["]
    ids = make(texts).select("doc_id")
    got = {r.doc_id: r.kept for r in kneser_ney.quality(make(texts), ids.filter("doc_id < 50"), ids.filter("doc_id BETWEEN 50 AND 60")).collect()}
    assert not got[60] and not got[61] and sum(got[i] for i in range(60)) > 50


def test_fingerprints_against_brute_force(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    order = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    fps = {i: fingerprint.simhash(t) for i, t in order}
    every = np.array(list(fps.values()), np.uint64)
    got = {r.doc_id: tuple(r)[1:] for r in fingerprint.document_fingerprints(docs).collect()}
    for k, (i, text) in enumerate(order):
        j, following = order[(k + 1) % len(order)]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        other = fingerprint.simhash(edited)
        near = int((np.bitwise_count(every ^ np.uint64(fps[i])) <= fingerprint.RADIUS).sum()) - 1
        likeness = lambda a, b: 1 - (a ^ b).bit_count() / 64
        assert got[i] == (len(text), hashlib.sha256(edited.encode()).hexdigest(), f"{fps[i]:016x}", f"{other:016x}", likeness(fps[i], other), likeness(fps[i], fps[j]), near)
    assert fingerprint.document_fingerprints(odd).count() == odd.count()
    assert fingerprint.document_fingerprints(odd.limit(0)).count() == 0


def test_block_tables_lose_no_pair(spark):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 62, 400, dtype=np.uint64)
    near = base[:200].copy()
    for i in range(200):
        for b in rng.integers(0, 64, rng.integers(1, 5)):
            near[i] ^= np.uint64(1) << np.uint64(b)
    fps = np.concatenate([base, near, near[:50]])
    shared = np.uint64(0xABCDEF << 40) | rng.integers(0, 1 << 12, 300, dtype=np.uint64)  # one key for all, more than a crowd
    fps = np.concatenate([fps, shared])
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long").groupBy("fp").agg(F.count(F.lit(1)).alias("copies"))
    for crowd in (50, 8192):
        got = {r.fp: r.near for r in fingerprint.neighbour_counts(df, 3, crowd).collect()}
        for f in np.unique(fps):
            apart = np.bitwise_count(fps ^ f)
            assert got.get(int(f.view(np.int64)), 0) == int(((apart <= 3) & (apart > 0)).sum())


def test_fingerprints_of_any_ids(spark, make):
    docs = make([(None if i % 3 == 0 else i // 2, f"text {i % 50} of many words {i % 7}", "en", "s") for i in range(200)])
    named = docs.withColumn("doc_id", F.col("doc_id").cast("string"))
    for rows in (docs, named):
        got = fingerprint.document_fingerprints(rows)
        assert got.count() == 200 and got.schema["doc_id"] .dataType == rows.schema["doc_id"].dataType
        texts = [(r.doc_id, r.text, t) for r, t in zip(rows.collect(), rows.select(F.xxhash64("text").alias("t")).collect(), strict=True)]
        order = sorted(texts, key=lambda x: (x[0] is not None, x[0] if x[0] is not None else 0, x[2].t), reverse=True)
        want = sorted(hashlib.sha256((a[: len(a) - len(a) // 2] + b[: len(a) // 2]).encode()).hexdigest() for a, b in zip([x[1] for x in order], [x[1] for x in order[1:] + order[:1]], strict=True))
        assert sorted(r.edited_sha256 for r in got.collect()) == want
