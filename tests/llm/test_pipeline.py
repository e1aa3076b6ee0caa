"""The corpus pipeline against a plain version of every stage."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from test_text_operators import plain_components, plain_dedup, variants

import corpus_pipeline as cp
from orrery.llm import pieces, toxicity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rng = random.Random(12)
    own = lambda n: [f"w{rng.randrange(500)}" for _ in range(n)]
    licence = "This line stands below many documents of this collection."
    texts = [" ".join(own(rng.randrange(5, 120))) for _ in range(120)]
    texts += variants(rng, own(80), 15, 3) + [texts[0]] * 4
    texts = [t + ("\n" + licence if rng.random() < 0.3 else "") for t in texts]
    texts = [t + " you stupid idiot you moron" * 3 if rng.random() < 0.15 else t for t in texts]
    rows = [(i, t, rng.choice(["en", "de"]), f"src{rng.randrange(5)}", len(t)) for i, t in enumerate(texts)]
    return [*rows, (500, None, None, None, None), (501, "", "en", "src0", 0), (502, "a b", None, "odd", 3), rows[3], rows[3]]


def labels(rows):
    return sorted({(r[0], 1, int("idiot" in (r[1] or ""))) for r in rows if r[0] % 3})


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d, rows = str(tmp_path_factory.mktemp("corpus")), documents()
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels(rows), "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def deal(budget, children):
    """{name: quota} of (name, weight, capacity), a child at a time until none is over its capacity."""
    got, open_ = {}, list(children)
    while open_:
        w = sum(c[1] for c in open_)
        full = [c for c in open_ if budget * c[1] / w >= c[2]] if w else []
        if not full:
            return got | {n: budget * x / w if w else 0.0 for n, x, _ in open_}
        for n, _, cap in full:
            got[n] = float(cap)
            budget -= cap
            open_ = [c for c in open_ if c[0] != n]
    return got


def plain_mix(rows, share, weights, epochs, seed):
    leaf = lambda r: (f"d{int(r[3][3:]) % 4}" if (r[3] or "")[3:].isdigit() else "other", r[2] or "other", r[3] or "other")
    n = lambda r: len((r[1] or "").split())
    supply = defaultdict(int)
    for r in rows:
        supply[leaf(r)] += n(r)
    w = lambda level, name: weights.get(level, {}).get(name, 1.0)
    cap = lambda k, v: sum(s for x, s in supply.items() if x[: len(v)] == v) * epochs
    quota = {}
    top = deal(share * sum(supply.values()), [(d, w("domain", d), cap(1, (d,))) for d in sorted({x[0] for x in supply})])
    for d, b in top.items():
        mid = deal(b, [(lang, w("lang", lang), cap(2, (d, lang))) for lang in sorted({x[1] for x in supply if x[0] == d})])
        for lang, c in mid.items():
            for s, q in deal(c, [(s, w("source", s), cap(3, (d, lang, s))) for s in sorted({x[2] for x in supply if x[:2] == (d, lang)})]).items():
                quota[d, lang, s] = int(q + 1e-6)
    for k, s in supply.items():
        whole = quota[k] // s if s else 0
        rest, total = quota[k] - whole * s, 0
        for r in sorted((r for r in rows if leaf(r) == k), key=lambda r: (hashlib.md5(f"{seed}:{whole}:{r[0]}".encode()).hexdigest(), str(r[0]), n(r))):
            total += n(r)
            yield from [r] * (whole + (rest > 0 and total <= rest))


def plain_run(spark, sf_dir, rows):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.fit(d, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = [r for r, s in zip(rows, model.score([r[1] or "" for r in rows]), strict=True) if s < 0.5]
    bad = lambda rs: sum("idiot" in (r[1] or "") for r in rs)
    assert bad(kept) < bad(rows) - 10 and len(rows) - len(kept) == bad(rows) - bad(kept)
    clean = [(r[0], t, r[2], r[3], len(t)) for r, (_, t, _, _) in zip(kept, plain_dedup([r[:2] for r in kept]), strict=True)]
    name = plain_components([r[:2] for r in clean])
    one = {}
    for r in sorted(clean, key=lambda r: (r[0], r[1])):
        if name[r[0]] == r[0]:
            one.setdefault(r[0], r)
    assert len(one) < len({r[0] for r in clean}) - 4
    mixed = list(plain_mix(list(one.values()), cp.SHARE, cp.MIX, cp.EPOCHS, cp.SEED))
    sp = pieces.Segmenter(pieces.MODEL).sp
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in mixed:
        ids = sp.encode(r[1])
        yield r[0], len(ids), tuple(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))


def test_run_equals_the_plain_version(spark, sf_dir):
    got = Counter((r["doc_id"], r["n_tokens"], tuple(r["ids"]), r["ids_sha256"], r["decoded_sha256"]) for r in cp.run(spark, sf_dir).collect())
    assert got == Counter(plain_run(spark, sf_dir, documents())) and len(got) > 60


def test_stages_keep_the_columns(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        d = stage(spark, d, sf_dir)
        assert [(f.name, f.dataType) for f in d.schema] == [(f.name, f.dataType) for f in spark.createDataFrame([], COLUMNS).schema]


@pytest.mark.parametrize("name, stage", cp.STAGES)
def test_stages_on_odd_rows(spark, sf_dir, odd, clashing, empty, name, stage):
    rows = stage(spark, clashing, sf_dir).collect()
    assert rows and stage(spark, empty, sf_dir).count() == 0
    if name in ("toxicity", "line dedup", "SentencePiece"):
        assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in odd.select("doc_id").collect())
    elif name != "mixing":  # one of the two equal texts, and of the rows that repeat an id
        assert sorted((r["doc_id"] is None, r["doc_id"]) for r in rows) == [(False, i) for i in range(14) if i != 11] + [(True, None)]
