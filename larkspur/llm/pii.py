"""Personal data: generators propose overlapping spans, boosted trees score them, calibrated thresholds choose.

Strict patterns give the base spans, which always stay. High-recall generators propose further, overlapping candidates with
loose forms of the same kinds, and secrets, which have no base pattern. Gradient-boosted trees (MLlib) learn what a span of each kind
looks like and where it stands: positive are the base spans, secrets that a name of theirs is given the value of, and loose
variants made of both; negative are all other candidates, and decoys made of positive ones (numbers that fail their check,
versions, dates, order numbers, checksums). Candidates in a known loose form are no examples of either label. Isotonic regression for each kind, on rows that the trees have not seen, turns their margins into
probabilities. A candidate that clears its kind's threshold, and no base span or better candidate stands in its way, is added.

The text is read once, where it lies. What leaves that scan is a few numbers for each candidate, scored as SQL expressions.
"""

from __future__ import annotations

import ipaddress
import re
from base64 import b64encode
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256
from math import log2

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import materialise

#: The kinds that have base spans, and those that only the trees find.
KINDS = ("email", "ip", "card", "phone")
FOUND = (*KINDS, "secret")
SECRET = 4
#: Characters before a span that the trees see.
CONTEXT = 32
#: Candidates that the trees are fitted on, and as many more for the calibration.
SAMPLE, TREES, DEPTH = 20_000, 8, 3
#: Least probability, by the curve of its kind, with which a candidate is redacted.
THRESHOLD = 0.9

# ---- base spans: fixed patterns

_domain = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d *= 1 + i % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _local:
            start -= 1
        match = _domain.match(text, at + 1) if start < at else None
        done = match.end() if match else at + 1
        if match:
            yield start, done
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order: per kind the leftmost non-overlapping matches that hold what the kind asks for."""
    found = [(a, 0, b) for a, b in _emails(text)]
    found += [(m.start(), 1, m.end()) for m in _ip.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in _card.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _phone.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found)


# ---- candidates

# Each starts where a run of its characters does, so that a long run is read once.
_loose_email = re.compile(r"(?<![^\s@<>,;:()\[\]\"'])[^\s@<>,;:()\[\]\"']++@[^\s@<>,;:()\[\]\"']++")
_spelled_email = re.compile(r"(?<![\w.+-])[\w.+-]++ ?[\[(] ?at ?[\])] ?[\w-]+(?: ?(?:\.|[\[(] ?dot ?[\])]) ?[\w-]+)+", re.I)
_loose_ip = re.compile(r"(?<![0-9A-Fa-f.:])(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){2,7})(?![0-9A-Fa-f:])")
_digits = re.compile(r"(?<![0-9])[+(]?[0-9](?:[ ().\-/]{0,3}[0-9]){6,}+")
_token = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_-]{16,}+={0,2}")
_secret_name = r"token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key|private[_-]?key|credential|bearer"
_assigned = re.compile(rf"(?:{_secret_name})\w*[\"']?\s{{0,3}}(?:=>|:=|=|:)\s{{0,3}}[\"'`]?$", re.I)
_cues = [
    re.compile(p, re.I)
    for p in (r"mail|contact|write", r"tel|phone|call|fax|mobile", r"card|visa|pay|credit", r"\bip\b|host|server|addr", r"id\b|order|invoice|version|key|isbn", _secret_name, r"commit|sha\d*|md5|etag|checksum|digest|build|rev")
]

FEATURES = (
    "kind", "length", "digits", "letters", "dots", "dashes", "spaces", "parens", "ats", "groups", "longest",
    "kinds_of_digit", "first_digit", "entropy", "capitals", "valid", "before_edge", "after_edge", "assigned", *(f"cue_{i}" for i in range(len(_cues))),
)


def _generate(text: str) -> Iterator[tuple[int, int, int]]:
    if "@" in text:
        yield from ((m.start(), 0, m.end()) for m in _loose_email.finditer(text))
    if "at)" in (low := text.lower()) or "at]" in low:
        yield from ((m.start(), 0, m.end()) for m in _spelled_email.finditer(text))
    yield from ((m.start(), 1, m.end()) for m in _loose_ip.finditer(text))
    for m in _digits.finditer(text):
        yield m.start(), 2, m.end()
        yield m.start(), 3, m.end()
    for m in _token.finditer(text):
        if any(map(str.isdigit, m[0])) and any(map(str.isalpha, m[0])):
            yield m.start(), SECRET, m.end()


def _entropy(span: str) -> float:
    """Bits for each character, by how often the span's own characters come."""
    return -sum(n / len(span) * log2(n / len(span)) for n in Counter(span).values())


def _is_ipv6(span: str) -> bool:
    try:
        return ipaddress.ip_address(span).version == 6
    except ValueError:
        return False


def is_seed(text: str, start: int, kind: int, end: int) -> bool:
    """Whether a candidate is a secret for certain: the value that is given to something named as one."""
    return kind == SECRET and _entropy(text[start:end]) >= 3 and bool(_assigned.search(text, max(0, start - CONTEXT), start))


def is_loose(span: str, kind: int, f: list[float]) -> bool:
    """Whether a span has a form that the base patterns don't take: a spelled-out address, IPv6, a grouped number after a word for phones, a token after a word for secrets."""
    if not f[FEATURES.index("valid")]:
        return False
    if kind == 3:
        return f[FEATURES.index("groups")] >= 3 and bool(f[FEATURES.index("cue_1")])
    if kind == SECRET:
        return bool(f[FEATURES.index("cue_5")])
    return "@" not in span if kind == 0 else kind == 1 and ":" in span


def variants(span: str, kind: int, before: str) -> list[tuple[str, str]]:
    """(before, span): a positive span in loose forms, with what stands before it; none if its kind has none."""
    seed = sha256(span.encode()).digest()
    if kind == 0:
        at, dot = ((" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", "."), (" (at) ", "."))[seed[0] % 4]
        local, domain = span.split("@")
        return [(before, local + at + domain.replace(".", dot))]
    if kind == 1:
        return [(before, str(ipaddress.IPv6Address(seed[1:3] + (bytes(12) + seed[3:5] if seed[0] % 2 else seed[3:17]))))] if seed[1] else []
    if kind == 3:
        return [(before, span[1:])] if len(re.findall(r"[0-9]+", span)) >= 3 else []
    if kind == SECRET:
        named = ("password: ", "SECRET_KEY=", "Authorization: Bearer ", "api_key => '", "export ACCESS_KEY=\"")[seed[0] % 5]
        other = (b64encode(seed[:24]).decode(), "ghp_" + seed[:18].hex(), "sk_live_" + seed[:12].hex(), seed[:20].hex())[seed[1] % 4]
        return [(before[:8] + named, other)]
    return []


def decoys(span: str, kind: int, before: str) -> list[tuple[str, int, str]]:
    """(before, kind, span): what looks like a positive span and is none."""
    seed = sha256(b"decoy" + span.encode()).digest()
    n = [str(x) for x in seed]
    if kind == 0:
        return [(before, 0, span.split(".")[0])]  # no domain
    if kind == 1:
        return [(before + "version ", 1, f"{300 + seed[0]}.{n[1]}.{n[2]}.{n[3]}"), (before, 1, f"{seed[0] % 24:02}:{seed[1] % 60:02}:{seed[2] % 60:02}")]
    if kind == 2:
        wrong = span[:-1] + str((int(span[-1]) + 1 + seed[0] % 9) % 10)  # fails its check
        return [(before, 2, wrong), (before, 3, wrong.replace(" ", "").replace("-", ""))]
    if kind == 3:
        dated = f"20{seed[0] % 30:02}-{seed[1] % 12 + 1:02}-{seed[2] % 28 + 1:02} {seed[3] % 24:02}"
        return [(before, 3, dated), (before[:8] + "order id ", 3, "".join(n)[:10])]
    sums = (("commit ", seed[:20].hex()), ("sha256:", seed.hex()), ("etag ", seed[:16].hex()), ("", f"{'-'.join(['page', 'section', 'chapter'][: 2 + seed[0] % 2])}-{n[1]}-{n[2]}-{n[3]}"))
    return [(before[:8] + lead, SECRET, value) for lead, value in (sums[seed[1] % 3], sums[3])]


def features(text: str, start: int, kind: int, end: int) -> list[float]:
    """What the trees see of a span: its form, and the characters and cue words around it.

    The plus sign that the strict phone pattern asks for is left out, so that a number in the same form without it can score.
    """
    span, before, after = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + 1]
    entropy = _entropy(span)
    digits = "".join(c for c in span if c.isdigit())
    groups = re.findall(r"[0-9]+", span)
    if kind == 1:
        valid = _is_ipv6(span) if ":" in span else all(len(g) <= 3 and int(g) <= 255 for g in groups) and len(groups) == 4
    elif kind == 2:
        valid = 12 <= len(digits) <= 19 and digits.isascii() and luhn(digits)
    elif kind == 3:
        valid = 9 <= len(digits) <= 15
    elif kind == SECRET:
        valid = entropy >= 3
    else:
        valid = "." in span.rpartition("@")[2].strip(".") if "@" in span else bool(_spelled_email.fullmatch(span))
    return [
        kind, end - start, len(digits), sum(c.isalpha() for c in span), span.count("."), span.count("-"), span.count(" "),
        span.count("(") + span.count(")"), span.count("@"), len(groups), max(map(len, groups), default=0),
        len(set(digits)), int(digits[0]) if digits[:1].isascii() and digits else -1, entropy, sum(c.isupper() for c in span), valid,
        not before or before[-1].isspace(), not after or not after.isalnum(), before.rstrip(" \"'`")[-1:] in ("=", ":"),
        *(bool(c.search(before)) for c in _cues),
    ]


def _examples(text: str, span: tuple[int, int, int]) -> Iterator[tuple[list[float], float]]:
    """(features, label) of what is made of a positive span, in its place."""
    start, kind, end = span
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + 1]
    made = [(b, kind, x, 1.0) for b, x in variants(text[start:end], kind, before)] + [(b, k, x, 0.0) for b, k, x in decoys(text[start:end], kind, before)]
    for lead, k, other, label in made:
        yield [float(x) for x in features(lead + other + after, len(lead), k, len(lead) + len(other))], label


def scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, tie, base, candidates, made): the base spans of each row, its candidates, and examples made of the positive ones; written once.

    A candidate's ``label`` is 1 for a base span or a certain secret, 0 for others, and null if it is no example for the trees.
    ``tie`` is a hash of the text.
    """
    kept = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("tie"), F.col(text_col).alias("text"))
    span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
    candidate = pa.struct([*span, ("label", pa.float64()), ("f", pa.list_(pa.float64()))])
    example = pa.struct([("f", pa.list_(pa.float64())), ("label", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bases, proposed, made = [], [], []
            for value in batch.column(2):
                text = value.as_py() or ""
                base = base_spans(text)
                known = set(base)
                bases.append([{"start": a, "kind": k, "end": b} for a, k, b in base])
                rows, own = [], []
                for a, k, b in sorted(known.union(_generate(text))):
                    f = [float(x) for x in features(text, a, k, b)]
                    positive = (a, k, b) in known or is_seed(text, a, k, b)
                    unclear = not positive and is_loose(text[a:b], k, f) and not any(x < b and a < y for x, _, y in base)
                    rows.append({"start": a, "kind": k, "end": b, "label": None if unclear else float(positive), "f": f})
                    if positive:
                        own += [{"f": g, "label": label} for g, label in _examples(text, (a, k, b))]
                proposed.append(rows)
                made.append(own)
            columns = [pa.array(bases, pa.list_(span)), pa.array(proposed, pa.list_(candidate)), pa.array(made, pa.list_(example))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["id", "tie", "base", "candidates", "made"])

    spans = "array<struct<start: long, kind: int, end: long>>"
    candidates = "array<struct<start: long, kind: int, end: long, label: double, f: array<double>>>"
    schema = f"id {kept.schema['id'].dataType.simpleString()}, tie long, base {spans}, candidates {candidates}, made array<struct<f: array<double>, label: double>>"
    return materialise(kept.mapInArrow(run, schema), "spans")


# ---- the trees


def _tree_column(node, f: Column) -> Column:
    """A fitted tree as a CASE expression over the array of features."""
    if node.numDescendants() == 0:
        return F.lit(node.prediction())
    split = node.split()
    left, right = _tree_column(node.leftChild(), f), _tree_column(node.rightChild(), f)
    return F.when(F.element_at(f, split.featureIndex() + 1) <= split.threshold(), left).otherwise(right)


def fit(scanned: DataFrame, sample: int = SAMPLE, seed: int = 1):
    """A function from a column of features to a column of probabilities of its kind, or None if there is nothing to learn from.

    ``sample`` candidates of each half, spread by hash, are used: one half grows the trees, the other calibrates them.
    """
    examples = F.transform(F.filter("candidates", lambda c: c["label"].isNotNull()), lambda c: F.struct(c["f"].alias("f"), c["label"].alias("label")))
    rows = scanned.select("id", "tie", F.posexplode(F.concat(examples, F.col("made"))).alias("place", "c"))
    rows = rows.select("c.f", "c.label", F.xxhash64(F.lit(seed), "id", "tie", "place").alias("h"))
    halves = [rows.filter(F.pmod("h", F.lit(2)) == half).orderBy("h").limit(sample) for half in (0, 1)]
    picked = materialise(halves[0].withColumn("half", F.lit(0)).unionByName(halves[1].withColumn("half", F.lit(1))), "candidates")
    counts = {(r.half, r.label): r.n for r in picked.groupBy("half", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any((half, label) not in counts for half in (0, 1) for label in (0.0, 1.0)):
        return None
    vectors = picked.select(array_to_vector("f").alias("features"), "label", "half", "f")
    gbt = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=64, seed=seed, featuresCol="features")
    model = gbt.fit(vectors.filter("half = 0").coalesce(2))
    roots, weights = [t._call_java("rootNode") for t in model.trees], model.treeWeights

    def margin(f: Column) -> Column:
        return sum((_tree_column(r, f) * w for r, w in zip(roots, weights, strict=True)), F.lit(0.0))

    seen = vectors.filter("half = 1").select(F.element_at("f", 1).alias("kind"), margin(F.col("f")).alias("margin"), "label").coalesce(2)
    seen = materialise(seen, "calibration")
    labels = {(int(r.kind), r.label) for r in seen.select("kind", "label").distinct().collect()}
    curves: list[list[tuple[float, float]]] = []
    for kind in range(len(FOUND)):
        if (kind, 1.0) not in labels:
            curves.append([])  # nothing tells what this kind looks like
            continue
        own = seen.filter(F.col("kind") == kind) if (kind, 0.0) in labels else seen
        steps = IsotonicRegression(featuresCol="margin").fit(own)
        bounds, values = steps.boundaries.toArray(), steps.predictions.toArray()
        curves.append(sorted({float(b): float(v) for b, v in zip(bounds, values, strict=True)}.items()))

    def probability(f: Column) -> Column:
        m, kind, out = margin(f), F.element_at(f, 1), F.lit(0.0)
        for i, curve in enumerate(curves):
            p = F.lit(curve[0][1] if curve else 0.0)
            for bound, value in curve:
                p = F.when(m >= bound, value).otherwise(p) if value > curve[0][1] else p
            out = F.when(kind == i, p).otherwise(out)
        return out

    return probability


def _spans_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in FOUND])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def _found(docs: DataFrame, text_col: str, id_col: str, threshold: float) -> DataFrame:
    """(id, tie, base, spans): the base spans of each row, and all of them."""
    scanned = scan(docs, text_col, id_col)
    probability = fit(scanned)
    if probability is None:
        return scanned.select("id", "tie", "base", F.col("base").alias("spans"))
    key = lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))
    meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    base = F.col("base")
    scored = F.transform(
        F.filter("candidates", lambda c: ~F.exists(base, lambda b: meets(b, c))),
        lambda c: F.struct((-probability(c["f"])).alias("p"), key(c).alias("span")),
    )
    likely = F.array_sort(F.filter(scored, lambda s: s["p"] <= -threshold))
    nothing = F.array().cast("array<struct<start: long, kind: int, end: long>>")
    chosen = F.aggregate(
        likely, nothing,
        lambda kept, s: F.when(F.exists(kept, lambda k: meets(k, s["span"])), kept).otherwise(F.array_append(kept, s["span"])),
    )
    return scanned.select("id", "tie", "base", F.array_sort(F.concat(base, chosen)).alias("spans"))


def find_pii(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, added, n_secret.

    Counts and digest are of the base spans; ``spans`` is all of them as kind:start:end (code points, end exclusive), by
    start, then kind, ``added`` the number that the trees added, and ``n_secret`` how many of these are secrets. A null text
    counts as empty and has no spans; texts are read whole, however long. Without both positive and negative examples none
    are added, nor of a kind without positive ones. Repeated rows are rows of their own; other columns are not read.
    """
    found = _found(docs, text_col, id_col, threshold)
    base = F.col("base")
    of_kind = lambda c, i: F.size(F.filter(c, lambda s: s["kind"] == i)).cast("long")
    counts = [of_kind(base, i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select(
        F.col("id").alias(id_col), *counts, F.sha2(_spans_text(base), 256).alias("base_sha256"), _spans_text(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size("base")).alias("added"), of_kind(F.col("spans"), SECRET).alias("n_secret"),
    )


def redacted(text: Column, spans: Column) -> Column:
    """A text with each of ``spans`` (by start) replaced by its kind in brackets; of overlapping spans the first one's."""
    names = F.array(*[F.lit(f"[{k}]") for k in FOUND])
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("done"))

    def step(held: Column, s: Column) -> Column:
        shown = F.concat(held["out"], F.substring(text, (held["done"] + 1).cast("int"), (s["start"] - held["done"]).cast("int")), F.element_at(names, s["kind"] + 1))
        out = F.when(s["start"] >= held["done"], shown).otherwise(held["out"])
        return F.struct(out.alias("out"), F.greatest(held["done"], s["end"]).alias("done"))

    return F.aggregate(spans, start, step, lambda held: F.concat(held["out"], F.substring(text, (held["done"] + 1).cast("int"), F.length(text))))


def redact(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with all spans of their texts redacted; other columns and all rows stay. Only rows with spans meet their spans again."""
    hits = _found(docs, text_col, id_col, threshold).filter(F.size("spans") > 0)
    hits = materialise(hits.groupBy("id", "tie").agg(F.first("spans").alias("spans")), "hits")
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    same = F.col(f"row.`{id_col}`").eqNullSafe(hits["id"]) & (F.xxhash64(F.col(f"row.`{text_col}`")) == hits["tie"])
    text = F.col(f"row.`{text_col}`")
    new = F.when(F.col("spans").isNull(), text).otherwise(redacted(text, F.col("spans"))).alias(text_col)
    return held.join(hits, same, "left").select(*[new if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])
