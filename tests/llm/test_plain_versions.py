"""Queries that SQL cannot express, against versions of their own, written out plainly."""

import hashlib
import io
import math
import random
import re
import wave
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text_operators import variants

from orrery.llm import audio, ngram_join, quality_mil, queries, toxicity
from orrery.llm.shingles import shingle_set


@pytest.fixture(scope="module")
def documents(spark, sf):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def flipped(spark, sf, tmp_path, target):
    """The tables with the labels of held-out rows turned round."""
    spark.read.parquet(f"{sf}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    labels.withColumn(target, F.when(out, 1 - F.col(target)).otherwise(F.col(target))).write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name, target, cut", [("op1_toxicity", "toxic", 0.5), ("op4_quality_classifier", "quality", 0.3)])
def test_labels_of_held_out_rows_are_never_read(spark, sf, tmp_path, name, target, cut):
    read = lambda d: {r["doc_id"]: (r["held_out"], r["score"], r["predicted"]) for r in queries.QUERIES[name](spark, d).collect()}
    got = read(sf)
    assert got == read(flipped(spark, sf, tmp_path, target))
    assert all(h == held_out(i) and p == int(s >= cut) for i, (h, s, p) in got.items())


# ---------------------------------------------------------------- 1


def plain_toxic_features(text, lexicon):
    words = re.findall(r"[^\W_]+", text.lower())
    n, chars = max(1, len(words)), max(1, len(text))
    stem_of = lambda w: [lexicon.stems[w[:k]] for k in (4, 5, 6) if len(w) > k and w[:k] in lexicon.stems]
    any_stem = lambda w: max([lexicon.stems.get(w[:k], 0.0) for k in (4, 5, 6)])
    in_terms, in_stems = [w for w in words if w in lexicon.terms], [w for w in words if stem_of(w)]
    insults = [w for w in words if w in toxicity.INSULTS]
    at = [i for i, w in enumerate(words) if w in lexicon.terms or stem_of(w) or w in toxicity.INSULTS]
    you = [i for i, w in enumerate(words) if w in toxicity.SECOND]
    near = sum(any(abs(i - j) <= 5 for j in you) for i in at)
    raw = re.findall(r"\S+", text)
    mixed = [r for r in raw if re.search(r"[A-Za-z][0-9@$!*|]+[A-Za-z]", r)]
    plain = str.maketrans(dict(zip("013457@$!|", "oieastasil", strict=True)))
    hidden = sum(w in toxicity.INSULTS or w in lexicon.terms for r in mixed for w in re.findall(r"[^\W_]+", r.lower().translate(plain)))
    rate = lambda marks: sum(c in marks for c in text)
    runs = len(re.findall(r"((.)\2{3,})", text))
    return [
        math.log(1 + len(words)), len(insults) / n, len(in_terms) / n, len(in_terms), len(set(in_terms)), sum(lexicon.terms[w] for w in set(in_terms)),
        len(in_stems) / n, len(in_stems), sum(any_stem(w) for w in set(in_stems)), hidden, hidden / n,
        len(you) / n, near, near / max(1, len(at)), sum(c.isupper() for c in text) / chars, sum(len(r) > 1 and r.isupper() for r in raw) / max(1, len(raw)),
        rate("!") / n, rate("?") / n, rate(".,;:!?") / chars, rate("#*$%&|<>@~^") / chars, sum(c.isdigit() for c in text) / chars, len(mixed) / max(1, len(raw)),
        len(toxicity.SPACED.findall(text)) / n, runs / n, sum(map(len, words)) / n,
    ]


def plain_toxicity(model, text):
    x, margin = plain_toxic_features(text, model.lexicon), model.trees.base
    for feature, cut, value in zip(model.trees.feature.tolist(), model.trees.cut.tolist(), model.trees.value.tolist(), strict=True):
        node = 0
        while node < len(cut):
            node = 2 * node + (2 if x[feature[node]] > cut[node] else 1)
        margin += value[node - len(cut)]
    at, p = model.calibrate.at.tolist(), model.calibrate.p.tolist()
    k = next((k for k, a in enumerate(at) if a >= margin), None)
    if k is None or k == 0:
        return p[-1 if k is None else 0]
    return p[k - 1] + (p[k] - p[k - 1]) * (margin - at[k - 1]) / (at[k] - at[k - 1])


def test_toxicity_equals_the_plain_version(spark, sf, documents):
    model = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    got = {r["doc_id"]: r["score"] for r in queries.op1_toxicity(spark, sf).collect()}
    assert len(got) == len(documents) and len(set(got.values())) > 2
    for i, text in documents.items():
        assert got[i] == pytest.approx(plain_toxicity(model, text), abs=1e-9), i


# ---------------------------------------------------------------- 4


def plain_passages(text):
    """A row for each passage of 48 words; a rest of under 24 belongs to the one before."""
    w = text.split()
    if not w:
        return [[0.0] * quality_mil.N_FEATURES]
    starts = list(range(0, len(w), 48))
    if len(starts) > 1 and len(w) - starts[-1] < 24:
        starts.pop()
    repeated = [w[i] in w[:i] for i in range(len(w))]
    same = [i > 0 and w[i] == w[i - 1] for i in range(len(w))]
    triples, again = set(), []
    for i in range(len(w)):
        t = tuple(w[i : i + 3])
        again.append(len(t) == 3 and t in triples)
        triples.add(t)
    rows = []
    for a, b in zip(starts, [*starts[1:], len(w)], strict=True):
        own = [quality_mil._word(x) for x in w[a:b]]
        mean = [sum(c) / (b - a) for c in zip(*own, strict=True)]
        share = [sum(f[a:b]) / (b - a) for f in (repeated, same, again)]
        rows.append(mean + share + [(text.count("\n") + 1) / len(w), min(len(text) / len(w) / 10, 5), math.log(1 + len(w)) / 8, math.log(1 + b - a) / 5])
    return rows


def plain_quality(net, text):
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    hidden, weights = [], []
    for row in plain_passages(text):
        x = np.clip((np.array(row) - net.mean) / net.scale, -6, 6)
        h = np.tanh(x @ p["W"] + p["b"])
        gate = np.tanh(h @ p["V"] + p["v"]) / (1 + np.exp(-(h @ p["U"] + p["u"])))
        hidden.append(h)
        weights.append(math.exp(gate @ p["a"]))
    z = sum(a * h for a, h in zip(weights, hidden, strict=True)) / sum(weights)
    return 1 / (1 + math.exp(-float(z @ p["c"] + p["d"][0])))


def test_quality_equals_the_plain_version(spark, sf, documents):
    net = quality_mil.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    got = {r["doc_id"]: r["score"] for r in queries.op4_quality_classifier(spark, sf).collect()}
    assert len(got) == len(documents) and len({round(s, 3) for s in got.values()}) > 20
    for i in sorted(documents)[::4]:
        assert got[i] == pytest.approx(plain_quality(net, documents[i]), abs=2e-4), i


# ---------------------------------------------------------------- 7


def plain_audio(text):
    payload = text.encode()
    payload += b"\xff" * (576 if not payload else -len(payload) % 576)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((1, 1, 12_000, 0, "NONE", ""))
        w.writeframes(payload)
    media = out.getvalue()
    x = (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128
    # resampling 3:2 by zeros, a windowed sinc and every third sample
    up = np.zeros(2 * len(x))
    up[::2] = x
    n = np.arange(24) - 11.5
    low = np.sinc(n / 3) * np.hamming(24)
    y = np.convolve(up, low * 2 / low.sum())[::3][: -(-2 * len(x) // 3)]
    frames = 1 + max(0, math.ceil((len(y) - 200) / 80))
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    edges = [700 * (10 ** ((mel(60) + (mel(4000) - mel(60)) * k / 21) / 2595) - 1) for k in range(22)]
    f = np.arange(129) * 8000 / 256
    bank = np.array([[max(0, min((v - a) / (b - a), (c - v) / (c - b))) for a, b, c in zip(edges, edges[1:], edges[2:], strict=False)] for v in f])
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(200) / 199)
    mels, db = [], []
    for k in range(frames):
        own = np.zeros(200)
        part = y[80 * k : 80 * k + 200]
        own[: len(part)] = part
        power = np.abs(np.fft.fft(own * window, 256)[:129]) ** 2
        mels.append(np.maximum(np.log(power @ bank + 1e-5), -11.5))
        db.append(10 * math.log10((own**2).mean() + 1e-9))
    spans, on = 0, False
    for v in db:
        if not on and v > -9:
            spans, on = spans + 1, True
        elif on and v < -12:
            on = False
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (len(text.encode()), len(payload), sha(payload), zlib.crc32(payload[-32:]), len(media), sha(media)), np.array(mels), spans


def test_audio_query_equals_the_plain_version(spark, sf, documents):
    names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")
    got = {r["doc_id"]: r for r in queries.op7_media_audio(spark, sf).collect()}
    assert len(got) == len(documents)
    for i in sorted(documents)[::5]:
        exact, mels, spans = plain_audio(documents[i])
        assert tuple(got[i][k] for k in names) == exact
        said = dict(part.split("=") for part in got[i]["feature"].split(";"))
        assert (int(said["frames"]), said["tensors"]) == (len(mels), f"{-(-len(mels) // 64)}x64x20")
        assert np.abs(np.array(said["mel"].split(","), float) - mels.mean(axis=0)).max() < 2e-3
        assert abs(int(said["spans"]) - spans) <= 1  # a level may lie within rounding of a threshold
    by_text = defaultdict(set)
    for i, t in documents.items():
        by_text[t].add(tuple(got[i][k] for k in (*names, "feature")))
    assert all(len(v) == 1 for v in by_text.values())


# ---------------------------------------------------------------- 9


def test_no_link_is_lost_over_many_blocks(spark, sf, documents, monkeypatch):
    """Thousands of documents in dozens of blocks: the components are those of counting all shared shingles."""
    monkeypatch.setattr(ngram_join, "BLOCK", 6_000)
    monkeypatch.setattr(ngram_join, "BUCKET", 20_000)
    monkeypatch.setattr(ngram_join, "QUERIES", 20_000)
    rng = random.Random(17)
    texts = list(documents.values())
    for base in rng.sample(texts, 120):
        if base.split():
            texts += variants(rng, base.split(), rng.randrange(1, 12), max(2, len(base.split()) // 25))
    hot = rng.choice([t for t in texts if 60 < len(t.split()) < 200]).split()
    texts += variants(rng, hot, 1_200, max(3, len(hot) // 20))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    sets = [set(shingle_set(t).tolist()) for t in texts]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    links = 0
    for i, s in enumerate(sets):
        for j, both in Counter(j for g in s for j in holders[g] if j < i).items():
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                links += 1
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    assert got == {i: find(i) for i in range(len(texts))} and links > 20_000 and len(texts) > 2_000
