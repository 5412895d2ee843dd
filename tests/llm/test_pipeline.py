"""Each stage of the corpus pipeline, and run() as a whole, against plain Python."""

import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from traceloom.llm import bpe, mixing, quality, secret_links

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return SPACE.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))


def sets(t, n=5):
    w = words(t)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """A small table of its own with its labels, and what each stage makes of it."""
    folder = str(tmp_path_factory.mktemp("sf"))
    full = "/root/testdata/sf0.01"
    some = spark.read.parquet(f"{full}/documents.parquet").where("length(text) < 3000").limit(260)
    odd = spark.createDataFrame([(10**6 + i, t, "en", "src0", len(t or "")) for i, t in enumerate([None, "", "a b", "a b", "x y z", "token=abcdefgh12345 and more words here for all of them to see"])], some.schema)
    some.unionByName(odd).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{full}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, steps[-1], folder)
        path = f"{folder}/stage{i}.parquet"
        out.write.parquet(path)
        steps.append(spark.read.parquet(path))
    return folder, steps


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source").collect()]


def test_stage_names_and_columns(made):
    _, steps = made
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "secrets", "mix", "tokens"]
    assert all(s.columns == steps[0].columns for s in steps[:-1])


def test_quality_keeps_what_the_classifier_keeps(spark, made):
    folder, steps = made
    model = quality.fitted(spark, steps[0], folder)
    want = Counter()
    for doc_id, text, lang, source in rows(steps[0]):
        for _, _, row, bucket, value in quality.features([text]):
            s = (model.w[bucket] * value).sum()
            if model.predict(np.array([s]))[1][0] >= quality.KEEP:
                want[doc_id, text, lang, source] += 1
    assert Counter(rows(steps[1])) == want


def test_near_duplicates_keep_one_of_each_group(made):
    _, steps = made
    before, after = rows(steps[1]), rows(steps[2])
    shingles = [sets(t) for _, t, _, _ in before]
    label = list(range(len(before)))
    for a in range(len(before)):
        for b in range(a):
            n = len(shingles[a] & shingles[b])
            if shingles[a] and shingles[b] and 100 * n >= 80 * (len(shingles[a]) + len(shingles[b]) - n):
                x, y = label[a], label[b]
                label = [x if v == y else v for v in label]
    first = {}
    for i, v in enumerate(label):
        if v not in first or before[i][0] < before[first[v]][0]:
            first[v] = i
    assert Counter(after) == Counter(before[i] for i in first.values())


def test_secrets_are_cut_out_and_all_rows_stay(spark, made):
    _, steps = made
    spans = {r.doc_id: r.spans for r in secret_links.scan(steps[2]).collect()}
    want = []
    for doc_id, text, lang, source in rows(steps[2]):
        out, at = "", 0
        for s in spans[doc_id]:
            if s.start >= at:
                out += text[at : s.start] + f"[REDACTED:{s.kind}]"
            at = max(at, s.end)
        want.append((doc_id, None if text is None else out + text[at:], lang, source))
    assert Counter(rows(steps[3])) == Counter(want)
    assert steps[3].where(F.length("text") != F.col("n_chars")).count() == 0


def test_mix_takes_the_planned_copies(made):
    _, steps = made
    plan = {r.doc_id: r.copies for r in mixing.plan_copies(steps[3]).collect()}
    want = Counter({row: plan[row[0]] for row in rows(steps[3])})
    assert Counter(rows(steps[4])) == +want


def test_tokens_are_those_of_the_library(made):
    import tiktoken

    _, steps = made
    ranks, pattern = bpe.default_vocabulary()
    lib = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    got = Counter((r.doc_id, tuple(r.ids), r.n_tokens) for r in steps[5].collect())
    want = Counter((i, tuple(x), len(x)) for i, t, _, _ in rows(steps[4]) for x in [lib.encode_ordinary(t or "")])
    assert got == want


def test_run_gives_the_last_stage(spark, made):
    folder, steps = made
    key = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert Counter(map(tuple, corpus_pipeline.run(spark, folder).select(*key).collect())) == Counter(map(tuple, steps[5].select(*key).collect()))
