"""The pipeline's stages on small tables."""

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline as pipeline
from helixframe.llm import decontamination, mixing, simhash


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rng = np.random.default_rng(11)
    vocab = [f"{a}{b}" for a in ("ba", "do", "ki", "lu", "me") for b in ("ran", "sol", "tim", "vex", "zor", "pel")]
    leak = " ".join(rng.choice(vocab, 14))
    rows = []
    for i in range(120):
        t = " ".join(rng.choice(vocab, 60)) + "."
        if i % 6 == 1:
            t = " ".join(w + "$$$" for w in t.split())
        if i % 10 == 3:
            t = t[:150] + ". " + leak + " " + t[150:]
        rows.append((i, t, "en", f"s{i % 3}" if i % 7 else None, len(t)))
    rows += [(200 + k, rows[0][1], "en", "s0", 1) for k in range(5)] + [(300, None, None, None, None), (301, "", "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 != 1), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps = {}
    for name, stage in pipeline.STAGES:
        before, docs = docs, stage(spark, docs, folder).cache()
        steps[name] = (before, docs)
        if stage is not pipeline.encode:
            assert docs.columns == list(pipeline.COLUMNS)
    before, after = steps["quality classifier"]
    kept = {r.doc_id for r in after.collect()}
    assert not any(i % 6 == 1 for i in kept if i < 120) and len([i for i in range(120) if i % 6 != 1 and i not in kept]) <= 3
    before, after = steps["SimHash near-dedup"]
    ids = sorted(r.doc_id for r in after.collect())
    assert ids == sorted({r.component_id for r in simhash.simhash(before).collect()}) and 200 not in ids
    before, after = steps["benchmark decontamination"]
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    assert decontamination.contamination(before, bench).filter("contaminated").count() > 5
    assert decontamination.contamination(after, bench).filter("contaminated").count() == 0 and after.count() == before.count()
    before, after = steps["mixing sources"]
    want = {r.doc_id: r.taken for r in mixing.mix(before).collect() if r.taken}
    assert set(want) == {r.doc_id for r in after.collect()}
    before, after = steps["token ids"]
    got = sorted((r.start, r.n_tokens) for r in after.collect())
    assert after.count() == before.count() and all(a + n == b for (a, n), (b, _) in zip(got, got[1:]))


def test_run_is_registered_and_agrees(spark, folder):
    a = sorted(tuple(r) for r in __spark_entry__.queries()["pipeline"](spark, folder).collect())
    b = sorted(tuple(r) for r in pipeline.run(spark, folder).collect())
    assert a == b and a


def test_queries_have_names_and_callables():
    names = [k for k in __spark_entry__.queries() if k.startswith("op")]
    assert sorted({int(k[2:].split("_")[0]) for k in names}) == list(range(1, 11))


def word_set(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_dedup_finds_all_near_copies(spark):
    """Planted copies at similarities around 0.8 to 0.95, chains, a large group and a common line, against brute force."""
    rng = np.random.default_rng(12)
    vocab = [f"w{i}" for i in range(3000)]
    line = " ".join(rng.choice(vocab, 30))
    texts = []
    for c in range(60):
        w = rng.choice(vocab, rng.integers(40, 250)).tolist()
        if c % 3 == 0:
            w[5:5] = line.split()
        for k in range(60 if c == 0 else 4):
            texts.append(" ".join(w))
            w = list(w) if c % 2 else texts[-k - 1].split()
            for _ in range(int(rng.integers(1, 1 + max(2, len(w) // 40)))):
                w[int(rng.integers(0, len(w)))] = str(rng.choice(vocab))
    texts += ["a b c", "a b c d", "A  b c", "a b c d e f", "x"]
    texts = [texts[i] for i in rng.permutation(len(texts))]
    sets = [word_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    want = sorted({find(i) for i in range(len(texts))})
    df = spark.createDataFrame([(i, t, "en", "s0", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in pipeline.deduplicate(spark, df, "").collect()) == want and len(want) < len(texts) // 2


def test_run_on_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() == 0


def test_stages_take_awkward_rows(spark, folder):
    """Null and empty texts, null ids and sources, repeated rows and extra columns go through every stage."""
    rows = [(1, None, None, None, None, "x"), (2, "", "en", "a", 0, "x"), (None, "some words that stay here", "en", None, 5, "x"), (3, "one two", "en", "a", 1, "x"), (3, "one two", "en", "a", 1, "x"), (4, "w " * 30_000, "en", "a", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert name == "token ids" or out.columns == list(pipeline.COLUMNS)
        assert out.count() <= 2 * len(rows)
    assert sorted(str(r.doc_id) for r in pipeline.deduplicate(spark, docs, folder).collect()) == ["1", "3", "4", "None"]
    assert pipeline.decontaminate(spark, docs, folder).count() == len(rows)
