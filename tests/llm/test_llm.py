"""Training-data operators against brute force on small tables with nulls, ties, repeats and clashing names."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from traceloom.llm import additive, backoff, bpe, hamming, langid, mixing, neardup, packing, quality, secret_links

DOCS = "doc_id long, text string, lang string, source string, size string, component_id int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, la, s, "x", 1) for i, t, la, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    return docs(spark, [(1, None, None, None), (2, "", "en", "a"), (3, long, "en", "a"), (4, "one two", "fr", None), (4, "one two", "fr", None), (None, "one two three four five", None, "b"), (7, "password: hunter2hunter2", "en", "b")])


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, [])


def test_bpe_matches_library(spark, odd, empty):
    import tiktoken

    ranks, pattern = bpe.default_vocabulary()
    lib = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    e, rnd = bpe.Encoder(ranks, pattern), random.Random(1)
    for _ in range(500):
        t = "".join(rnd.choice("ab e\t\n\x1c\x85 's1²é漢😀_-.") for _ in range(rnd.randint(0, 40)))
        assert e.encode([t])[0].tolist() == lib.encode_ordinary(t)
    assert e.encode(["a" * 5000])[0].tolist() == lib.encode_ordinary("a" * 5000)
    got = bpe.decode(bpe.encode(odd, ranks, pattern, keep=("doc_id", "text")), ranks, keep=("doc_id", "text")).collect()
    assert len(got) == 7 and all(bytes(r.decoded) == (r.text or "").encode() for r in got)
    assert bpe.digest(empty).count() == 0


def test_packing_loses_nothing(spark, odd, empty):
    ranks, pattern = bpe.default_vocabulary()
    rows = packing.pack(odd, ranks, pattern, row=64).collect()
    pieces = {}
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u2")
        assert r.cu_seqlens[-1] == r.n_tokens and (ids[r.n_tokens :] == 50256).all()
        for d, at, a, b in zip(r.doc_ids, r.doc_offsets, r.cu_seqlens, r.cu_seqlens[1:]):
            pieces.setdefault((d, at), []).append(ids[a:b].tolist())
    want = bpe.Encoder(ranks, pattern).encode([odd.where("doc_id = 3").first().text])[0].tolist()
    assert sum((x[0] for (d, _), x in sorted(((k, v) for k, v in pieces.items() if k[0] == 3))), []) == want
    assert packing.pack(empty, ranks, pattern).count() == 0
    assert packing.best_fit_decreasing([3, 5, 2, 8, 6], 8) == [[3], [4, 2], [1, 0]]


def test_mixing(spark, odd, empty):
    assert mixing.water_fill([10, 90], [3, 1], 3.0) == [30.0, 70.0]
    rows = spark.createDataFrame([(i, "w " * (i % 40 + 1), "abc"[i % 3]) for i in range(600)], "doc_id long, text string, source string")
    got = mixing.plan_copies(rows).groupBy("source", "target").agg(F.sum("taken").alias("n"), F.max("copies").alias("c")).collect()
    assert all(abs(r.n - r.target) <= 40 and r.c <= 3 for r in got)
    assert mixing.plan_copies(odd).count() == 7 and mixing.plan_copies(empty).count() == 0
    assert mixing.mix(odd).columns == odd.columns


def test_secrets(spark, odd, empty):
    key = "AKIA" + "ABCDEFGHIJKL"
    weak = "zQ9" + "abcDEF123456789012345"
    text = f"user = bob1 then {weak} done. {'x ' * 300} {weak} token='short' secret: longenough1 {key}"
    spans = secret_links.scan(docs(spark, [(1, text, "en", "a")])).first().spans
    assert [s.kind for s in spans] == ["id", "value", "value", "assign", "access"]
    alone = secret_links.scan(docs(spark, [(1, f"just {weak} alone", "en", "a")])).first().spans
    assert alone == []
    assert text[spans[1].start : spans[1].end] == weak
    assert weak not in secret_links.redact(docs(spark, [(1, text, "en", "a")])).first().text
    assert secret_links.scan(odd).count() == 7 and secret_links.scan(empty).count() == 0 and secret_links.redact(odd).count() == 7


def test_near_duplicates(spark, odd, empty):
    rnd = random.Random(3)
    base = [f"w{rnd.randint(0, 500)}" for _ in range(200)]
    rows = [(i, " ".join(w if rnd.random() > 0.004 * (i % 9) else "zz" for w in base), "en", "a") for i in range(60)]
    rows += [(100 + i, " ".join(f"u{rnd.randint(0, 500)}" for _ in range(200)), "en", "a") for i in range(20)]
    sets = {i: {tuple(t.split()[k : k + 4]) for k in range(len(t.split()) - 3)} for i, t, _, _ in rows}
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((label[a], label[b]))
                label = {k: x if v == y else v for k, v in label.items()}
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(spark, rows)).collect()}
    assert got == label
    assert neardup.near_duplicates(odd).count() == 7 and neardup.near_duplicates(empty).count() == 0


def test_backoff(spark, odd, empty):
    got = backoff.score(docs(spark, [(1, "a b a b", "en", "a")])).first()
    want = np.log([2 / 4, 2 / 2, 0.4 * 1.0 * 2 / 4 * 0.4, 1.0 * 0.4])  # the third falls back twice, the fourth once
    assert got.n_words == 4 and abs(got.log_score - want.sum()) < 1e-9
    assert backoff.score(odd).count() == 7 and backoff.score(empty).count() == 0


def test_hamming(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.getrandbits(16) if i % 3 else 77) for i in range(300)] + [(None, 5), (5, None)]
    got = {}
    for r in hamming.search(spark.createDataFrame(rows, "vec_id long, code long"), bits=16, k=5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.distance))
    for q in (0, 100, 200):
        best = sorted((bin(c ^ dict(rows[:300])[q]).count("1"), i) for i, c in rows[:300] if i != q)[:5]
        assert sorted(got[q]) == [(k + 1, i, d) for k, (d, i) in enumerate(best)]


def test_models(spark, odd, empty):
    rows = [(i, ("the cat of the house " if i % 2 else "le chat de la maison ") * 3, "en" if i % 2 else "fr", "a") for i in range(60)]
    model = langid.fit(docs(spark, rows))
    assert {(r.lang_pred) for r in langid.predict(docs(spark, [(1, "the house", None, None)]), model).collect()} == {"en"}
    assert {r.lang_pred for r in langid.predict(docs(spark, [(1, None, None, None), (2, "12 !", None, None)]), model).collect()} == {"und"}
    assert langid.predict(odd, model).count() == 7
    rated = spark.createDataFrame([(i, ("fine words here " if i % 3 == 2 else "bad " if i % 3 else "awful junk ") * 5, i % 3) for i in range(300)], "doc_id long, text string, grade int")
    link = quality.fit(rated)
    assert (np.diff(link.theta) > 0).all()
    got = quality.score(rated, link, keep=("doc_id", "grade")).groupBy("grade").agg(F.avg("expected_grade").alias("e")).collect()
    assert [round(r.e) for r in sorted(got)] == [0, 1, 2]
    assert quality.score(odd, link).count() == 7 and quality.score(empty, link).count() == 0


def test_pipeline_unique_goes_by_rows(spark, empty):
    import corpus_pipeline

    said = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcd"}
    near = said["a"] + " end"
    rows = [(5, said["a"]), (3, near), (5, said["b"]), (5, said["b"]), (9, near), (9, said["c"]), (None, said["d"]), (None, said["d"]), (None, said["c"]), (7, None), (7, ""), (None, None)]
    got = corpus_pipeline.unique(spark, docs(spark, [(i, t, "en", "a") for i, t in rows]), "")
    key = lambda r: (str(r[0]), str(r[1]))
    want = [(3, near), (5, said["b"]), (9, said["c"]), (None, said["d"]), (7, None), (7, ""), (None, None)]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=key) == sorted(want, key=key)
    assert corpus_pipeline.unique(spark, empty, "").count() == 0


def test_language_of_long_runs(spark, monkeypatch):
    rows = [(i, ("the cat of the house " if i % 2 else "le chat de la maison ") * 3, "en" if i % 2 else "fr", "a") for i in range(60)]
    model = langid.fit(docs(spark, rows))
    scorer = langid.Scorer(model)
    run = "house" * 40 + "maison" * 100  # the first 200 letters are English
    assert scorer(run)[0] == "fr" and run not in scorer.place
    whole = scorer._long("maison" * 30)
    assert np.allclose(whole, scorer.scores(["maison" * 30])[0], atol=1e-5)  # the same as short words
    monkeypatch.setattr(langid, "PIECE", 7)
    assert np.allclose(scorer._long("maison" * 30), whole)
    long = "q" * 150 + "z" * 100
    assert long in langid.fit(docs(spark, [(i, f"{long} {long}", "en", "a") for i in range(20)]))["words"]


def test_additive_against_brute_force(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((700, 8)).astype(np.float32)
    x[100:500] = x[100]  # one vector 400 times
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(100, [float(c) for c in x[100]])] * 30
    x = np.array([v for _, v in rows])
    ids = np.array([i for i, _ in rows])
    index, books = additive.build(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    for measure in ("ip", "l2"):
        got: dict = {}
        for r in additive.search(index, books, F.col("id").isin(3, 120, 600), measure=measure).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
        hits = 0
        for q in (3, 120, 600):
            exact = x @ x[q] if measure == "ip" else -np.sqrt(((x - x[q]) ** 2).sum(1))
            near = [int(ids[i]) for i in np.lexsort((ids, -exact)) if ids[i] != q][:20]
            mine = [i for _, i in sorted(got[q])]
            assert len(mine) == 20
            hits += sum(a == b for a, b in zip(mine, near))
        assert hits >= 57  # recall of 0.95
    # a hot vector that is approximated above 30 better ones, in one dimension
    books = np.array([[[0.0], [5.0], [1.0]]], np.float32)
    made = [(i, i, [1.0], bytes([1]), 5.0) for i in range(400)] + [(1000 + i, 1000 + i, [2.0 + i], bytes([2]), 1.0) for i in range(30)]
    index = spark.createDataFrame(made, "_row long, id long, vector array<float>, codes binary, norm double")
    got = additive.search(index, books, F.col("id") == 0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1029 - i for i in range(20)]


def test_secrets_of_long_values(spark):
    long = "g" * 60_000 + "B" + "k" * 300 + "7"
    rows = [(1, f"user = bob1 then {long} done", "en", "a"), (2, f"user = bob1 then {'g' * 60_000}B done", "en", "a")]
    got = {r.doc_id: [s.kind for s in r.spans] for r in secret_links.scan(docs(spark, rows)).collect()}
    assert got == {1: ["id", "value"], 2: []}
    assert long not in secret_links.redact(docs(spark, rows[:1])).first().text
