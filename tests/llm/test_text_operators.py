import hashlib
import io
import random
import re
import wave
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests_common import canonical
from orrery.llm import audio, chat_rotation, line_dedup, mixing, ngram_join, packing, pieces, quality_mil, quality_rules, queries, token_counts, toxicity
from orrery.llm.boosting import fit_isotonic, fit_trees
from orrery.llm.shingles import shingle_set

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_text(df):
    return {(r["doc_id"], i): r for i, r in enumerate(sorted(df.collect(), key=str))}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    got = queries.QUERIES[name](spark, sf).toPandas()
    assert canonical(got) == canonical(duck.execute(queries.ORACLES[name]).df())


# ---------------------------------------------------------------- the cases every operator defines


OPERATORS = {
    "toxicity": lambda d, l: toxicity.score_toxicity(d, l),
    "quality_rules": lambda d, l: quality_rules.quality_rules(d),
    "token_counts": lambda d, l: token_counts.count_tokens(d),
    "quality_mil": lambda d, l: quality_mil.score_quality(d, l),
    "mixing": lambda d, l: mixing.mix(d).select("doc_id", "_copies"),
    "audio": lambda d, l: audio.audio_features(d, audio.DIGESTS),
    "pieces": lambda d, l: pieces.encode_texts(d),
    "ngram_join": lambda d, l: ngram_join.jaccard_components(d),
    "line_dedup": lambda d, l: line_dedup.dedup_lines(d).select("doc_id", "text", "n_lines", "n_dropped"),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(odd, odd_rows, clashing, empty, no_labels, name):
    f = OPERATORS[name]
    got = f(odd, no_labels)
    rows = got.collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in odd_rows)
    assert canonical(f(clashing, no_labels).toPandas()[got.columns].astype(str)) == canonical(got.toPandas().astype(str))
    assert f(empty, no_labels).count() == 0


def test_chat_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, start string"
    rows = [(1, 0, "system", "be kind", "x"), (1, 1, "ann", "hi", "x"), (1, 2, "bob", None, "x"), (1, 2, "bob", None, "x"), (1, None, None, "first", "x"), (None, 1, "ann", "lost", "x"), (2, 0, "system", "alone", "x"), (3, 5, "ann", "é\n" * 5000, "x"), (3, 4000, "eve", "late", "x")]
    got = chat_rotation.rotate_perspectives(spark.createDataFrame(rows, schema)).toPandas()
    assert set(zip(got.conv_id, got.speaker)) == {(1, "ann"), (1, "bob"), (1, "unknown"), (3, "ann"), (3, "eve")}
    for (_, speaker), g in got.groupby(["conv_id", "speaker"]):
        g = g.sort_values("segment")
        whole = "".join(g.rendered)
        assert list(g.segment) == list(range(len(g)))
        for r in g.itertuples():
            assert whole[r.start : r.start + len(r.rendered)] == r.rendered
            assert (r.role == "assistant") == (r.name == speaker)
            if r.role == "assistant":
                assert whole[int(r.mask_start) : int(r.mask_end)] + "<|end|>\n" == r.rendered.split("\n", 1)[1]
    first = got[(got.conv_id == 1) & (got.speaker == "ann")].sort_values("segment")
    assert list(first.name) == ["unknown", "system", "ann", "bob", "bob"]
    assert chat_rotation.rotate_perspectives(spark.createDataFrame([], schema)).count() == 0


def test_chat_spans_do_not_matter(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    assert canonical(chat_rotation.rotate_perspectives(c, span=2).toPandas()) == canonical(chat_rotation.rotate_perspectives(c).toPandas())


# ---------------------------------------------------------------- 1 and 4: classifiers


@pytest.mark.parametrize("f, target, cut", [(toxicity.score_toxicity, "toxic", 0.5), (quality_mil.score_quality, "quality", 0.3)])
def test_classifier_on_held_out_rows(spark, f, target, cut):
    from tests_common import DATA

    d, l = (spark.read.parquet(f"{DATA}/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = f(d, l).join(l, "doc_id").toPandas()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= cut)).all()
    held = got[got.held_out]
    assert (held.predicted == held[target]).mean() > 0.94


def test_equal_texts_equal_scores(spark, no_labels):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(240):
        bad = i % 3 == 0
        rows.append((i, " ".join(rng.choice(["sun", "tree", "water", "stone"]) for _ in range(60)) + (" you idiot" * 4 if bad else ""), None, None, None))
        labels.append((i, int(not bad), int(bad)))
    d = spark.createDataFrame(rows + [(1000 + r[0], *r[1:]) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    l = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    for f in (toxicity.score_toxicity, quality_mil.score_quality):
        s = {r["doc_id"]: r["score"] for r in f(d, l).collect()}
        assert all(s[i] == s[1000 + i] for i in range(240))
        assert {r["score"] for r in f(d, no_labels).collect()} == {0.0}


def test_boosting_and_isotonic():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((2000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    t = fit_trees(x[:1000], y[:1000])
    assert ((t.margin(x[1000:]) > 0) == y[1000:]).mean() > 0.95
    c = fit_isotonic(t.margin(x[:1000]), y[:1000])
    assert (np.diff(c.p) >= 0).all() and (np.diff(c.at) > 0).all()
    p = c(t.margin(x[1000:]))
    assert abs(p.mean() - y[1000:].mean()) < 0.05


def test_attention_gradient():
    rng = np.random.default_rng(1)
    bags = [rng.standard_normal((k, quality_mil.N_FEATURES)).astype(np.float64) for k in (1, 3, 5)]
    net = quality_mil.fit_net(lambda epoch: zip([b.astype(np.float32) for b in bags], (0, 1, 1), strict=True), 3, epochs=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, start, y = np.concatenate(bags), np.array([0, 1, 4]), np.array([0.0, 1.0, 1.0])
    loss = lambda: float(np.mean(np.log1p(np.exp(-(2 * y - 1) * net.forward(x, start)["logit"]))))
    g = net.gradient(net.forward(x, start), y, start)
    for name in net.p:
        at = tuple(rng.integers(0, s) for s in net.p[name].shape)
        old, h = net.p[name][at], 1e-6
        net.p[name][at] = old + h
        up = loss()
        net.p[name][at] = old - h
        down = loss()
        net.p[name][at] = old
        assert g[name][at] == pytest.approx((up - down) / (2 * h), abs=1e-6)


# ---------------------------------------------------------------- 2 and 10: rules and lines


def plain_statistics(text):
    text = text or ""
    w = WORD.findall(text)
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark, odd, odd_rows):
    rng = random.Random(3)
    more = [(100 + i, " ".join(rng.choice("ab#\n") * rng.randrange(1, 3) for _ in range(rng.randrange(60))), None, "s", None) for i in range(150)]
    d = odd.unionByName(spark.createDataFrame(more, odd.schema))
    want = Counter((r[0], *plain_statistics(r[1])) for r in [*odd_rows, *more])
    got = quality_rules.quality_rules(d)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()) == want


def test_depleted_documents(spark):
    rng = random.Random(4)
    own = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    menu = "\n".join(own(10) for _ in range(9))
    rows = [(i, menu + "\n" + own(20), None, "host", None) for i in range(30)] + [(100 + i, menu.split("\n")[0] + "\n" + own(90), None, "host", None) for i in range(3)] + [(200, menu, None, "other", None)]
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert all(got[i] == (False, False) for i in range(30))  # most words are on lines of the whole host
    assert all(got[100 + i] == (False, True) for i in range(3)) and got[200] == (False, True)


def plain_dedup(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(lower)
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40 and i is not None:
                holders[key(line)].add(i)
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if i is None or len(holders.get(key(x), ())) < 5 or len(key(x)) < 40 or max(holders[key(x)]) == i]
        yield i, "\n".join(stay), len(lines), len(lines) - len(stay)


def test_line_dedup(spark, odd_rows):
    rng = random.Random(5)
    pool = ["É" + "x" * 39, "e" * 40, "  " + "Q" * 45 + "\t", "q" * 45, "short", "", "z" * 39, "ß" * 50]
    rows = [(r[0], r[1]) for r in odd_rows] + [(100 + i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    rows += [(100, "q" * 45 + "\nother text of a repeated id")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = line_dedup.dedup_lines(d).select("doc_id", "text", "n_lines", "n_dropped")
    assert Counter(map(tuple, got.collect())) == Counter(plain_dedup(rows))


# ---------------------------------------------------------------- 3 and 8: vocabularies


def fuzz(n, alphabet, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_token_counts(spark, odd_rows, sf):
    model = token_counts.Lengths(token_counts.MODEL, most=500)
    texts = [r[1] or "" for r in odd_rows] + fuzz(4000, "aZéÉßΣσςİ  \n\t'<|>endoftext0²½ﬁ中 ́🙂▁_-!.,$é", 6) + ["<|startoftext|><|endoftext|>", "Á", "\x1c\x85\xa0a"]
    want = [len(e.ids) for e in model.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [model.count(t) for t in texts] == want
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in token_counts.count_tokens(d, entries=50).collect()}
    assert [got[i]["n_tokens"] for i in range(len(texts))] == want
    assert all(got[i]["n_bytes"] == len(t.encode()) and got[i]["over_limit"] == (want[i] > 2048) for i, t in enumerate(texts))


@pytest.mark.parametrize("block, bucket", [(pieces.BLOCK_CHARS, pieces.BUCKET_CHUNKS), (900, 300)])
def test_pieces(spark, odd_rows, block, bucket):
    texts = [r[1] or "" for r in odd_rows] + fuzz(4000, "aZé  \n\t▁<s>0x中🙂\r\x00.", 7) + [" ", "\n", "  \n  ", "▁▁a", "a" * 3000]
    s = pieces.Segmenter(pieces.MODEL)
    assert not s.whole
    ids = s.sp.encode(texts)
    want = [(len(i), ",".join(map(str, i)), s.sp.decode(i)) for i in ids]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    outputs = ("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")
    blocks = pieces.written_blocks(d, block)
    assert blocks.count() > 3 or block > 900
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for rows in (pieces.join_back(blocks, pieces.answer_chunks(blocks, pieces.MODEL, bucket), outputs), pieces.encode_texts(d, outputs=outputs), pieces._encode_whole(d, pieces.MODEL, outputs)):
        got = {r["doc_id"]: r for r in rows.collect()}
        assert len(got) == len(texts)
        for k, (n, i, t) in enumerate(want):
            assert (got[k]["n_tokens"], got[k]["ids"], got[k]["decoded"], got[k]["ids_sha256"], got[k]["decoded_sha256"]) == (n, ids[k], t, sha(i), sha(t))


def test_packing():
    rng = np.random.default_rng(4)
    for x in (np.zeros(0, np.int64), rng.integers(0, 2**32, 999), np.arange(5)):
        assert np.array_equal(packing.unpack_numbers(packing.pack_numbers(x)), x)
    for x in ([], [""], ["a", "", "▁\n中🙂\x00"] * 50):
        assert packing.unpack_strings(packing.pack_strings(x)) == x


# ---------------------------------------------------------------- 6: mixing


def test_budgets_by_hand(spark):
    leaves = spark.createDataFrame([("a", "x", "s", 100), ("a", "y", "s", 10), ("b", "x", "s", 100)], "domain string, lang string, source string, supply long")
    quota = lambda share, w, epochs: {(r["domain"], r["lang"]): r["quota"] for r in mixing.leaf_budgets(leaves, share, w, epochs).collect()}
    # 105 tokens: half to each domain; y lacks 16 of its 26, which its sibling takes
    assert quota(0.5, {}, 1) == {("a", "x"): 42, ("a", "y"): 10, ("b", "x"): 52}
    # 189 tokens: a can supply 110 of its 142, so the rest goes to b
    assert quota(0.9, {"domain": {"a": 3.0}}, 1) == {("a", "x"): 100, ("a", "y"): 10, ("b", "x"): 79}
    assert quota(0.9, {"domain": {"b": 0.0}}, 1) == {("a", "x"): 100, ("a", "y"): 10, ("b", "x"): 0}
    assert quota(5.0, {}, 2) == {("a", "x"): 200, ("a", "y"): 20, ("b", "x"): 200}


def test_water_filling_against_a_plain_one(spark):
    """Children of equal ratio, without capacity or weight, thousands of them, and budgets that end anywhere."""
    rng = random.Random(12)
    rows = []
    for parent in range(40):
        n = rng.choice((1, 2, 5, 60, 3000))
        caps = [rng.choice((0, 1, 7, 7, 7, 1000, rng.randrange(1, 10**9))) for _ in range(n)]
        share = rng.choice((0.0, 0.01, 0.3, 0.9, 1.0, 2.0))
        rows += [(f"p{parent}", f"c{k}", c, sum(caps) * share) for k, c in enumerate(caps)]
    weights = {"child": {"c0": 0.0, "c1": 3.0, "c2": 0.25, "c4": 2.0}}
    nodes = spark.createDataFrame(rows, "parent string, child string, capacity long, budget double").repartition(5)
    got = {(r["parent"], r["child"]): r["quota"] for r in mixing.fill(nodes, ["parent"], "child", weights).collect()}
    assert len(got) == len(rows)
    for parent in sorted({r[0] for r in rows}):
        own = [(c, cap, weights["child"].get(c, 1.0)) for p, c, cap, _ in rows if p == parent]
        left = next(b for p, _, _, b in rows if p == parent)
        rest = sorted((cap / w, cap, w, c) for c, cap, w in own if w > 0)
        want, heavy = {c: 0.0 for c, _, _ in own}, sum(w for _, _, w, _ in rest)
        for _, cap, w, c in rest:
            want[c] = min(cap, left * w / heavy)
            left, heavy = left - want[c], heavy - w
        alone = {r["child"]: r["quota"] for r in mixing.fill(nodes.where(F.col("parent") == parent), [], "child", weights).collect()} if parent in ("p0", "p1", "p2") else {}
        for c in want:
            assert got[parent, c] == pytest.approx(want[c], rel=1e-9, abs=1e-6) and alone.get(c, got[parent, c]) == pytest.approx(got[parent, c])


def test_prefixes_of_epochs(spark):
    rng = random.Random(9)
    rows = [(i, "w " * rng.randrange(0, 30), "en", f"src{i % 2}", None) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    size = {r[0]: len(r[1].split()) for r in rows}
    for share, epochs in ((0.3, 1), (1.7, 3)):
        for depth in (2, 6):
            got = {r["doc_id"]: r["_copies"] for r in mixing.mix(d, share, {"source": {"src1": 2.0}}, epochs, 5, depth=depth).collect()}
            taken = sum(got[i] * size[i] for i in got)
            assert share * sum(size.values()) - 80 <= taken <= share * sum(size.values()) and max(got.values()) <= epochs
            for s in (0, 1):
                own = [i for i in got if i % 2 == s]
                whole = min(got[i] for i in own)
                order = sorted(own, key=lambda i: (hashlib.md5(f"5:{whole}:{i}".encode()).hexdigest(), str(i)))
                copies = [got[i] for i in order]
                assert copies == sorted(copies, reverse=True)  # a prefix of the seeded epoch


# ---------------------------------------------------------------- 7: media


def test_audio_contract(odd_rows):
    for text in {r[1] for r in odd_rows}:
        row = audio._row(text, tuple(audio.COLUMNS))
        payload = (text or "").encode()
        padded = payload + b"\xff" * (-len(payload) % 576 if payload else 576)
        with wave.open(io.BytesIO(row["media"])) as w:
            assert (w.getnchannels(), w.getsampwidth()) == (1, 1) and w.readframes(w.getnframes()) == padded
        assert (row["n_bytes"], row["payload_bytes"], row["tail_crc32"]) == (len(payload), len(padded), zlib.crc32(padded[-32:]))
        assert row["payload_sha256"] == hashlib.sha256(padded).hexdigest() and row["media_sha256"] == hashlib.sha256(row["media"]).hexdigest()
        spans = np.array(row["tensor_spans"])
        assert len(spans) == len(row["tensors"]) and (spans[:, 1] > spans[:, 0]).all() and (np.diff(spans[:, 0]) > 0).all()


def test_resampling_equals_the_plain_form(monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 256, 5760).astype(np.uint8)
    h = audio._filters()[0].T.reshape(-1)
    up = np.zeros(len(x) * audio.UP)
    up[:: audio.UP] = (x.astype(float) - 128) / 128
    n = audio.resampled_length(len(x))
    want = np.convolve(up, h)[:: audio.DOWN][:n]
    assert np.abs(audio.resample(x, 0, n) - want).max() < 1e-5
    whole = audio.extract(x.tobytes())
    monkeypatch.setattr(audio, "BLOCK", 7)
    assert np.array_equal(audio.extract(x.tobytes()).tensors.to_numpy_ndarray(), whole.tensors.to_numpy_ndarray())


def test_every_sample_is_in_a_frame():
    for units in (1, 2, 3, 5, 7):
        x = np.random.default_rng(units).integers(0, 256, 576 * units).astype(np.uint8)
        n, length = audio.frame_count(len(x)), audio.resampled_length(len(x))
        assert (n - 1) * audio.HOP + audio.FRAME >= length > (n - 2) * audio.HOP + audio.FRAME
        other = x.copy()
        other[-12:] ^= 0x80
        whole = audio.extract(x.tobytes())
        assert audio.describe(whole) != audio.describe(audio.extract(other.tobytes()))
        assert whole.patch_s[-1, 1] == length / audio.NEW_RATE


def test_hysteresis_and_tensors(odd):
    db = np.array([-20, -8, -10, -11, -13, -10, -8, -20.0])
    assert audio.hysteresis(db).tolist() == [[1, 4], [6, 7]]
    table = audio.audio_features(odd, ("tensors", "tensor_spans")).select("tensors").toArrow()
    t = audio.as_tensors(table.column("tensors"))
    assert t.type.shape == [audio.PATCH, audio.MELS] and t.to_numpy_ndarray().shape[1:] == (audio.PATCH, audio.MELS)


# ---------------------------------------------------------------- 9: near copies


def plain_components(rows):
    sets = [(i, frozenset(shingle_set(t).tolist())) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                p, q = sorted((find(i), find(j)))
                parent[q] = p
    return {i: find(i) for i, _ in sets}


def variants(rng, base, n, most):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(most)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_shingles():
    for t in (None, "", " \n", "a", "A b", "a b c d e f", "É é x y z " * 9):
        w = [x.translate({ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}) for x in WORD.findall(t or "")]
        want = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        assert len(shingle_set(t)) == len(want)
    assert np.array_equal(shingle_set("A b"), shingle_set("a\tB"))


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, odd_rows, seed, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 3_000)  # several blocks
    monkeypatch.setattr(ngram_join, "BUCKET", 2_000)
    monkeypatch.setattr(ngram_join, "QUERIES", 4_000)  # a block searched by several tasks
    rng = random.Random(seed)
    own = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = own(50)
    texts = []
    for size, n, most in ((120, 60, 7), (40, 30, 4), (300, 25, 14), (9, 12, 2)):
        texts += variants(rng, own(size), n, most)
    texts += [" ".join(passage + own(rng.randrange(0, 30))) for _ in range(60)]  # one passage in all
    texts += [" ".join(own(rng.randrange(1, 90))) for _ in range(40)]
    chain = own(100)  # each links with the next, the ends do not
    for k in range(0, 40, 2):
        texts.append(" ".join(chain[k:] + own(0) + [f"e{j}" for j in range(k)]))
    texts += rng.sample(texts, 40)
    rng.shuffle(texts)
    rows = [(r[0], r[1]) for r in odd_rows if r[0] != 12] + [(1000 + i, t) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = ngram_join.jaccard_components(d).collect()
    want = plain_components(rows)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    assert len(set(want.values())) < len(want) - 100
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(shingle_set(t)) for i, t in rows}


def test_negative_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "DEALT_ROWS", 1)  # partners in other batches
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    rows = [(-9, text(1)), (-4, text(1) + " more"), (3, text(2)), (5, text(2)), (5, text(3)), (8, text(3)), (7, text(4))]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["component_id"]) for r in ngram_join.jaccard_components(d).collect()}
    assert got == {(-9, -9), (-4, -9), (3, 3), (5, 3), (8, 3), (7, 7)}


def test_divide_skip_equals_counting():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(200)]
    sets += [np.unique(np.r_[s, rng.integers(0, 60, 2).astype(np.uint64)]) for s in sets[:60]]
    lists = ngram_join.Lists(list(range(len(sets))), sets)
    links = 0
    for i, q in enumerate(sets):
        want = [j for j, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= 80 * len(np.union1d(q, s))]
        links += len(want)
        assert sorted(lists.nodes[d] for d in lists.search(q)) == want, i
    assert links > 300


def test_bounds():
    for n in range(1, 400):
        for m in range(n, 500):
            o = ngram_join.least_overlap(n, m)
            assert 100 * o >= 80 * (n + m - o) and (o == 0 or 100 * (o - 1) < 80 * (n + m - o + 1))
            if o <= n:  # partners: the prefixes share what the filter asks for
                p = ngram_join.prefix_length(m) - (m - o)
                assert min(p, ngram_join.prefix_length(n) - (n - o)) >= 1 + ngram_join.at_least(max(n, m)) // 20 - 1


def test_frequent_pre_tokens_come_from_all_documents(spark, monkeypatch):
    rng = random.Random(21)
    texts = [" ".join(rng.choice(["the", "Cat's", "x" * 40, f"w{rng.randrange(3000)}"]) for _ in range(rng.randrange(80))) for _ in range(600)]
    d = spark.createDataFrame([(t,) for t in [None, *texts]], "text string").repartition(11)
    lengths = token_counts.Lengths(token_counts.MODEL)
    seen = Counter(p for t in texts for p in lengths.pieces(t) if len(p) <= token_counts.ENTRY_CHARS)
    for fan_in in (32, 3):  # merged by the driver, or in rounds before
        monkeypatch.setattr(token_counts, "FAN_IN", fan_in)
        table = token_counts.frequent_lengths(d, entries=100_000)
        assert table == {p: lengths[p] for p in seen}
        assert set(token_counts.frequent_lengths(d, entries=4)) == {p for p, _ in sorted(seen.items(), key=lambda kv: (-kv[1], kv[0]))[:4]}


def test_mixing_takes_equal_rows_one_by_one(spark, duck):
    """A prefix that ends among repeated rows takes as many of them as it pays for, as the SQL does."""
    rng = random.Random(31)
    rows = [(i, "w " * rng.randrange(1, 9), "en", f"src{i % 2}", None) for i in range(40)]
    rows += [rng.choice(rows) for _ in range(60)] + [(None, "a b", "en", "src1", None)] * 20
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    duck.register("repeated", d.toArrow())
    ends = 0
    for share in (0.13, 0.29, 0.31, 0.5, 0.77, 1.4):
        for seed in (1, 2):
            got = mixing.mix(d, share, {}, 2, seed, depth=4).select("doc_id", F.col("_domain").alias("domain"), "lang", "source", F.col("_tokens").alias("n_tokens"), F.col("_copies").alias("n_copies")).toPandas()
            want = duck.execute(queries.mix_oracle("repeated", share, {}, 2, seed)).df()
            assert canonical(got) == canonical(want)
            ends += int((got.groupby(["doc_id", "source", "n_tokens"], dropna=False).n_copies.nunique() > 1).any())
    assert ends > 3
    two = spark.createDataFrame([(7, "a b c", "en", "src0", None)] * 2, d.schema)
    assert sorted(r["_copies"] for r in mixing.mix(two, 0.5, {}, 1, 3).collect()) == [0, 1]


def test_passages_read_from_their_table_give_the_same_net(spark, sf):
    d, l = (spark.read.parquet(f"{sf}/{t}.parquet").where("doc_id < 400") for t in ("documents", "labels"))
    kept, read = (quality_mil.fit(d, l, kept_bytes=n) for n in (1 << 30, 0))
    assert all(np.array_equal(kept.p[k], read.p[k]) for k in kept.p) and np.array_equal(kept.mean, read.mean)


def test_long_words_are_known_by_a_hash():
    w = quality_mil.Words()
    a, b, c = w.ids(["x" * 900, "y" * 900, "x" * 900])
    assert a == c != b and all(isinstance(k, bytes) for k in w.at)
