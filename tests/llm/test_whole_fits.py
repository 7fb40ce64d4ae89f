"""Fits and links that leave no labelled row and no open bucket out."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from voxframe.llm import near_dup, quality_rules, queries, recompression


def test_forests_take_ranges_and_limits_from_all_labelled_rows(spark, monkeypatch):
    """The one row with digits comes last by the hash by which 4,096 rows were drawn before."""
    ids = spark.range(4200).select(F.col("id").alias("doc_id"))
    last = ids.orderBy(F.xxhash64("doc_id").desc()).first()[0]
    words = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    docs = ids.select("doc_id", F.when(F.col("doc_id") == last, words.replace("word", "7777")).otherwise(words).alias("text"))
    seen, fit = [], quality_rules.IsolationForest.fit
    monkeypatch.setattr(quality_rules.IsolationForest, "fit", lambda self, rows, low, high: seen.append((low, high)) or fit(self, rows, low, high))
    forests = quality_rules.fit_forests(docs, ids.select("doc_id", F.lit(1).alias("quality")), trees=3)
    at = quality_rules.FEATURES.index("digit_share")
    assert len(forests.members) == len(quality_rules.GROUPS) and all(low[at] == 0 and high[at] > 0.5 for low, high in seen)


def test_limits_of_the_highest_scores_are_those_of_all():
    rng = np.random.default_rng(4)
    for digits in (1, 2, 9):  # many ties and few
        scores = [np.round(rng.random(400), digits) for _ in range(3)]
        for share in (0.0, 0.01, 0.1):
            own = np.unique(np.concatenate([np.argsort(-s, kind="stable")[: int(share * 400) + 1] for s in scores]))
            falling = [np.sort(s)[::-1] for s in scores]
            lost = [np.any([s > f[r] for s, f in zip(scores, falling)], axis=0).sum() for r in range(400)]
            rank = max(r for r in range(400) if lost[r] <= share * 400)
            assert quality_rules.joint_limits([s[own] for s in scores], 400, share) == [float(f[rank]) for f in falling]


def test_the_query_and_the_pipeline_leave_no_bucket_open(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(near_dup, "classes", lambda docs, **how: asked.append(how))
    monkeypatch.setattr(near_dup, "one_of_each", lambda docs, **how: asked.append(how) or docs)
    monkeypatch.setattr(queries, "_table", lambda *_: None)
    queries.op10_near_dup(None, "")
    corpus_pipeline.near_duplicates(None, spark.range(1), "")
    assert len(asked) == 2 and all(how["exhaustive"] for how in asked)


def test_an_open_bucket_makes_no_row_for_each_of_its_pairs(spark, monkeypatch):
    """300 variants of one text, most pairs just below the similarity: the classes of all pairs, from few decided pairs."""
    own, base, texts = random.Random(5), [f"word{k}" for k in range(150)], []
    for _ in range(300):
        w = list(base)
        for k in own.sample(range(150), own.choice([1, 3, 3, 3, 4])):
            w[k] = f"edit{own.randrange(10**6)}"
        texts.append(w)
    sets = [{tuple(w[k : k + 5]) for k in range(146)} for w in texts]
    links = [(a, b) for a in range(300) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = list(range(300))
    for _ in want:
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    decided, verified = [], near_dup._verified
    monkeypatch.setattr(near_dup, "_verified", lambda docs, pairs, *how: decided.append(pairs.count()) or verified(docs, pairs, *how))
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dup.classes(docs, exhaustive=True).collect()}
    assert len(set(want)) > 50 and [got[k] for k in range(300)] == want
    assert sum(decided) < 300 * 299 / 2 / 5


def _plans_of(monkeypatch, module, names):
    """The plans of the texts that these functions are given."""
    seen = []
    for name in names:
        whole = getattr(module, name)
        monkeypatch.setattr(module, name, lambda docs, *how, whole=whole: seen.append(docs._jdf.queryExecution().executedPlan().toString()) or whole(docs, *how))
    return seen


def test_texts_are_not_shuffled_for_their_labels(spark, monkeypatch):
    seen = _plans_of(monkeypatch, quality_rules, ["_measured"])
    text = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables too large to be broadcast unasked
    try:
        forests = quality_rules.fit_forests(docs, spark.range(10, 70).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality")), trees=3)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert forests and len(seen) == 1 and "hashpartitioning" not in seen[0]


def test_texts_are_not_shuffled_for_open_buckets(spark, monkeypatch):
    seen = _plans_of(monkeypatch, near_dup, ["_sketched", "_sets"])
    words = [f"word{k}" for k in range(100)]
    docs = spark.createDataFrame([(k, " ".join([f"own{k}x{j}" if j < 6 else w for j, w in enumerate(words)])) for k in range(30)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        near_dup.classes(docs, exhaustive=True).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert seen and not any("hashpartitioning(doc_id" in p.split("BroadcastExchange")[0] for p in seen)


def test_symbols_of_different_windows_seldom_agree():
    """Two texts of few words that have no window in common: few symbols of the one stand for windows of the other."""
    rng = np.random.default_rng(6)
    vocabulary = rng.integers(1, 1 << 62, 60).astype(np.uint64)
    one, two = (recompression.standing(vocabulary[rng.integers(0, 60, 3000)], np.array([0, 3000]), 13)[1] for _ in range(2))
    assert np.isin(one, two).mean() < 0.005
