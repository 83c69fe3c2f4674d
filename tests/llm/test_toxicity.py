"""The classifier learns from all labelled documents, dealt out into shards."""

import dataclasses

import numpy as np
from pyspark.sql import functions as F

from lakescribe.llm import toxicity
from lakescribe.llm.toxicity import Settings, fit_toxicity, score_toxicity

SMALL = Settings(buckets=1 << 12, epochs=4)


def marked_texts(spark, n, length, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        words = [f"w{k}" for k in rng.integers(0, 200, length)]
        if i % 3 == 0:
            words[int(rng.integers(0, length))] = "horrid"
        rows.append((i, " ".join(words), "aa" if i % 2 else "bb", int(i % 3 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")


def test_long_documents_are_learned_from(spark):
    """Toxic documents of more than 4,000 words only."""
    rows = marked_texts(spark, 240, 30).withColumn("text", F.when(F.col("toxic") == 1, F.concat("text", F.lit(" "), F.repeat(F.lit("w1 w2 w3 "), 1_500))).otherwise(F.col("text")))
    model = fit_toxicity(rows, rows, F.lit(True), SMALL)
    found = score_toxicity(rows, model).join(rows.select("doc_id", "toxic"), "doc_id").collect()
    assert sum(r.predicted == r.toxic for r in found) >= 0.95 * len(found)


def test_every_labelled_document_counts_whatever_the_shards(spark):
    rows = marked_texts(spark, 900, 20)
    settings = dataclasses.replace(SMALL, shard_rows=150)
    model = fit_toxicity(rows, rows, F.lit(True), settings)
    learned = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(4)) != 0).collect()
    held = np.zeros(settings.buckets, int)
    for r in learned:
        held[list({b for w in toxicity.words_of(r.text.encode()) for b in toxicity.features(w, settings.buckets)})] += 1
    assert (model.vectors.any(axis=1) == (held >= settings.min_documents)).all()
    found = score_toxicity(rows, model).join(rows.select("doc_id", "toxic"), "doc_id").collect()
    assert sum(r.predicted == r.toxic for r in found) >= 0.95 * len(found)
    again = fit_toxicity(rows.repartition(7), rows.select("doc_id", "toxic").repartition(3), F.lit(True), settings)
    assert (again.vectors == model.vectors).all() and again.thresholds == model.thresholds
    one = fit_toxicity(rows, rows, F.lit(True), SMALL)
    assert one.thresholds.keys() == model.thresholds.keys() == {toxicity.OTHER, "aa", "bb"}


def test_one_shard_is_plain_training(spark):
    """The weights of one shard are those of all rounds in one place, and thresholds are the best cuts of the held-back rows."""
    rows = marked_texts(spark, 300, 20)
    rows = rows.unionByName(rows.where("toxic = 0 AND doc_id % 5 = 0"))  # ids count alike, whatever rows they have
    model = fit_toxicity(rows, rows, F.lit(True), SMALL)
    own = rows.select("*", F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(4)).alias("held"), F.xxhash64("doc_id").alias("rank")).orderBy("rank").collect()
    plain, reader = toxicity.Classifier.fresh(SMALL), toxicity.SampleReader(SMALL.buckets)
    for r in own:
        reader.add(toxicity.words_of(r.text.encode()))
    learned = np.array([r.held != 0 for r in own])
    labels = np.array([r.toxic for r in own], np.float32)
    plain.train(reader.sample().of(learned), labels[learned])
    assert np.allclose(plain.vectors, model.vectors, atol=1e-5) and np.allclose(plain.kernels, model.kernels, atol=1e-5)
    logits, y = model.sample_logits(reader.sample().of(~learned)), labels[~learned]
    w = np.where(y > 0, 1.0, len({r.doc_id for r in own if not r.toxic}) / (labels == 0).sum())
    best = max(((2 * (w * y)[logits >= x].sum() / (w[logits >= x].sum() + (w * y).sum()), x) for x in set(logits.tolist())))[1]
    lower = [x for x in logits if x < best]
    assert model.thresholds[toxicity.OTHER] == (best + max(lower, default=best)) / 2


def test_words_are_kept_from_chunk_to_chunk(spark, monkeypatch):
    """Scores do not depend on which texts a worker has seen before."""
    rows = marked_texts(spark, 120, 20)
    model = fit_toxicity(rows, rows, F.lit(True), dataclasses.replace(SMALL, epochs=1, min_per_language=20))
    texts = [r.text.encode() for r in rows.collect()] + [b"", b"..."]
    whole = model.scores(texts)
    monkeypatch.setattr(toxicity, "_PART", 200)
    monkeypatch.setattr(toxicity, "_KEPT_WORDS", 50)
    scorer = toxicity.Scorer(model)
    assert np.allclose(whole, scorer.scores(texts), atol=1e-6) and np.allclose(whole, scorer.scores(texts), atol=1e-6)
