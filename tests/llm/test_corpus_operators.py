"""Operators that learn from a corpus or compare documents, on small tables, against brute force."""

import collections
import dataclasses
import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from conftest import SF_DIR
from lakescribe.llm import decontaminate, jaccard, language, ppm, queries, toxicity
from lakescribe.llm.common import fold
from lakescribe.llm.components import components
from lakescribe.llm.language import fit_languages, has_letter, held_out_languages, identify_language
from lakescribe.llm.lm_score import frequent_words, lm_scores, word_counts, word_key
from lakescribe.llm.pii import find_personal_data
from lakescribe.llm.pieces import decode_pieces, encode_pieces, piece_counts
from lakescribe.llm.quality import language_references, quality_rules
from lakescribe.llm.secrets import redact_secrets, scan_secrets
from lakescribe.llm.shingles import shingle_set
from lakescribe.llm.token_counts import count_tokens
from lakescribe.llm.toxicity import Settings, fit_toxicity, held_out_toxicity, score_toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans string, n_words long, score double, label int, rep int"
ODD = [
    (0, "The cat sat on the mat and the dog sat on the log with a very long tail", "en"),
    (1, "The cat sat on the mat and the dog sat on the log with a very long tail", "en"),
    (2, "THE cat sat on the mat and the dog sat on the log with a very long TAIL", "en"),
    (3, None, "en"), (4, "", "de"), (5, " \n\t ", None), (6, "one two", "fr"), (7, "One two", None),
    (8, "x" * 70_000, "en"), (9, "ab " * 30_000, "en"), (10, "no letters: 12345 67890"[12:], "en"),
    (11, "password = hunter2secret mail a@b.de call +49 30 1234567", "en"), (None, "a row without an id and some more words", "en"),
    (12, "der die das und in zu den von mit ist", "de"), (12, "der die das und in zu den von mit ist", "de"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, columns whose names clash with results."""
    return spark.createDataFrame([(i, t, x, "src", len(t or ""), "mine", -1, -1.0, 7, 7) for i, t, x in ODD], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, int(i == 11)) for i in range(13)] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def benchmark_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def operators(spark, docs, labels):
    items = benchmark_of(spark, [(1, "the dog sat on the log with a very long tail"), (2, None), (3, ""), (4, "one two")])
    small = Settings(epochs=1, buckets=1 << 10)
    return {
        "secrets": scan_secrets(docs), "quality": quality_rules(docs, language_references(docs)), "lm": lm_scores(docs, order=2),
        "jaccard": jaccard.jaccard_components(docs), "contamination": decontaminate.find_contamination(docs, items),
        "pieces": piece_counts(docs, queries.tokenizer_path("piece_bpe_32k.model")),
        "tokens": count_tokens(docs, queries.tokenizer_path("word_bpe_49k.json")), "language": held_out_languages(docs),
        "toxicity": held_out_toxicity(docs, labels, small), "pii": find_personal_data(docs),
    }


def test_hard_rows_in_every_operator(spark, odd, labels):
    found = {name: df.collect() for name, df in operators(spark, odd, labels).items()}
    for name, rows in found.items():
        assert sorted((r["doc_id"] is None, r["doc_id"]) for r in rows) == sorted((i is None, i) for i, *_ in ODD), name
        twice = [r for r in rows if r["doc_id"] == 12]
        assert twice[0] == twice[1], name
    one = {name: {r["doc_id"]: r for r in rows} for name, rows in found.items()}
    empty = hashlib.sha256(b"").hexdigest()
    for i in (3, 4):
        assert one["secrets"][i]["base_sha256"] == empty and one["secrets"][i]["spans"] == "" and one["secrets"][11]["n_assign"] == 1
        assert one["quality"][i]["n_words"] == 0 and one["quality"][i]["base_failed"] and not one["quality"][i]["kept"]
        assert one["lm"][i]["n_tokens"] == 1 and one["jaccard"][i]["component_id"] == i and one["jaccard"][i]["n_shingles"] == 0
        assert one["contamination"][i]["n_words"] == 0 and one["contamination"][i]["items_sha256"] == empty
        assert one["pieces"][i]["n_pieces"] == 0 and one["pieces"][i]["round_trip"] and one["tokens"][i]["n_tokens"] == 0
        assert one["language"][i]["lang_pred"] == "und" and 0 <= one["toxicity"][i]["score"] <= 1 and one["pii"][i]["n_email"] == 0
    assert one["language"][10]["lang_pred"] == "und" and one["pii"][11]["n_email"] == one["pii"][11]["n_phone"] == 1
    assert [one["jaccard"][i]["component_id"] for i in (0, 1, 2, 6, 7)] == [0, 0, 0, 6, 6]
    assert one["jaccard"][None]["component_id"] is None
    assert one["contamination"][0]["n_hit"] == 11 and one["contamination"][6]["contaminated"] and one["tokens"][8]["over_limit"]


def test_empty_tables_in_every_operator(spark, none, labels):
    for name, df in operators(spark, none, labels.where("false")).items():
        assert df.count() == 0, name


def test_stages_keep_columns_and_hard_rows(spark, odd, none, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark_of(spark, [(4, "one two")]).write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            found = stage(spark, docs, str(tmp_path))
            assert found.columns == docs.columns and found.schema == docs.schema or [f.dataType for f in found.schema] == [f.dataType for f in docs.schema], name
            found.collect()
    kept = {r.doc_id for r in corpus_pipeline.drop_copies(spark, odd, str(tmp_path)).collect()}
    assert kept == {0, 3, 4, 5, 6, 8, 9, 10, 11, 12, None}
    clean = {r.doc_id for r in corpus_pipeline.drop_benchmark(spark, odd, str(tmp_path)).collect()}
    assert clean == {i for i, *_ in ODD} - {6, 7}
    hidden = {r.doc_id: r for r in corpus_pipeline.hide_secrets(spark, odd, str(tmp_path)).collect()}
    assert hidden[11].text.startswith("[secret] mail") and hidden[11].n_chars == len(hidden[11].text)
    assert hidden[3].text is None and hidden[0].text == ODD[0][1] and hidden[0].spans == "mine"


def test_stages_leave_columns_with_names_of_their_own_alone(spark, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark_of(spark, [(4, "one two")]).write.parquet(f"{tmp_path}/benchmark.parquet")
    own = ["score", "predicted", "Score_", "mark", "redacted", "known", "row", "key", "n", "sid", "rep", "component_id", "part", "n_pieces", "ids_sha256", "round_trip", "n_fallback"]
    columns = ["doc_id", "text", "lang", *own]
    docs = spark.createDataFrame([(i, t, x, *[f"{c}{k}" for c in own]) for k, (i, t, x) in enumerate(ODD)], ", ".join(f"{c} {'long' if c == 'doc_id' else 'string'}" for c in columns))
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert found.columns == docs.columns, name
            before = {r["score"]: r for r in docs.collect()}
            for r in found.collect():
                assert all(r[c] == before[r["score"]][c] for c in [*own, "lang", "doc_id"]), name
        else:
            assert found.columns == ["doc_id", "n_pieces", "n_fallback", "ids_sha256", "round_trip"] and found.count() == len(ODD)
    judged = quality_rules(docs, language_references(docs), keep=("doc_id", "known")).collect()
    assert sorted(r.known for r in judged) == sorted(f"known{k}" for k in range(len(ODD)))


def test_pipeline_on_the_smallest_table(spark):
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert 0 < len(rows) < docs.count() and all(r.round_trip for r in rows)


# --- Jaccard --------------------------------------------------------------------------------------


def by_hand(texts, percent=75):
    sets = {}
    for i, text in texts.items():
        words = [w for w in text.lower().split()]
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def edited(rng, count):
    """Families of copies, with words changed here and there, and passages that many share."""
    vocabulary = [f"w{i}" for i in range(400)]
    passage, texts = [f"shared{i}" for i in range(30)], {}
    while len(texts) < count:
        base = [vocabulary[i] for i in rng.integers(0, 400, rng.choice([3, 6, 9, 14, 30, 60, 120]))]
        for _ in range(rng.integers(1, 9)):
            words = list(base)
            for _ in range(rng.integers(0, 4)):
                words[rng.integers(0, len(words))] = vocabulary[rng.integers(0, 400)]
            texts[len(texts) + 10] = " ".join(words + (passage if rng.random() < 0.2 else []))
    return texts


@pytest.mark.parametrize("seed, block, elements", [(1, 2_048, 1 << 20), (2, 3, 100)])
def test_jaccard_components_against_all_pairs(spark, monkeypatch, seed, block, elements):
    monkeypatch.setattr(jaccard, "_BLOCK_ROWS", block)
    monkeypatch.setattr(jaccard, "_BLOCK_ELEMENTS", elements)
    texts = edited(np.random.default_rng(seed), 220)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    assert found == by_hand(texts)


def test_subsets_and_lists_meet_every_pair_at_any_boundary():
    rng = np.random.default_rng(5)
    crowd = np.zeros(1 << 20, np.int64)
    for _ in range(300):
        n = int(rng.integers(3, 40))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.r_[a[rng.random(len(a)) > 0.1], rng.integers(0, 2**63, 2).astype(np.uint64)])
        both = len(np.intersect1d(a, b))
        if 100 * both >= 75 * (len(a) + len(b) - both) and not np.array_equal(a, b):
            for x in (0, 5, 12, 20, 48):
                assert np.intersect1d(jaccard.signatures(a, crowd, x, 75), jaccard.signatures(b, crowd, x, 75)).size


def test_boundary_follows_the_cost():
    assert jaccard.boundary({5: 1000, 96: 10}, 0.0, 75) == 0 and jaccard.boundary({5: 1000, 96: 10}, 50.0, 75) > 5


def test_parity_is_a_lower_bound():
    rng = np.random.default_rng(6)
    for n in (1, 7, 40, 400, 3_000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.r_[a[: n // 2], rng.integers(0, 2**63, n).astype(np.uint64)])
        x, y = (np.frombuffer(jaccard.parity(v), np.uint8)[None] for v in (a, b))
        size = min(x.shape[1], y.shape[1])
        assert np.bitwise_count(jaccard.folded(x, size) ^ jaccard.folded(y, size)).sum() <= len(np.setxor1d(a, b))


def test_buckets_over_batch_borders(spark):
    """Rows of a bucket that lie in several Arrow batches."""
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    texts = {i: " ".join(f"t{k}" for k in range(40) if k != i) for i in range(1, 9)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sets, sketch = jaccard.set_table(docs, 5)
    whole = {tuple(r) for r in jaccard.shared_buckets(docs, sketch, 0, 5, 75).collect()}
    by_bucket = collections.defaultdict(set)
    for bucket, sid, pivot in whole:
        by_bucket[bucket].add(sid)
        assert pivot is not None
    assert all(len(x) > 1 for x in by_bucket.values()) and by_bucket
    try:
        for n in ("1", "2", "3"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            assert {tuple(r) for r in jaccard.shared_buckets(docs, sketch, 0, 5, 75).collect()} == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_blocks_link_what_all_pairs_link():
    rng = np.random.default_rng(9)
    for _ in range(40):
        base = [np.unique(rng.integers(0, 2**63, int(k)).astype(np.uint64)) for k in rng.integers(1, 200, 4)]
        sets = [np.unique(np.r_[b[rng.random(len(b)) > rng.choice([0, 0.1, 0.2])], rng.integers(0, 2**63, int(rng.integers(1, 9))).astype(np.uint64)]) for b in base for _ in range(8)]
        part = rng.integers(0, 2, len(sets))
        for across in (False, True):
            found, parent = jaccard.block_links(sets, part, across, 75), {}
            for a, b in found:
                both = len(np.intersect1d(sets[a], sets[b]))
                assert 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both)
            root = lambda i: root(parent[i]) if i in parent else i  # noqa: E731, B023
            for a, b in found:
                assert root(a) != root(b)
                parent[root(a)] = root(b)
            order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
            lead = jaccard.grown(np.array([len(sets[i]) for i in order]), [jaccard.parity(sets[i]) for i in order], 75)
            for x, a in enumerate(order):
                for y, b in enumerate(order):
                    both = len(np.intersect1d(sets[a], sets[b]))
                    if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                        assert lead[x] == lead[y]
                        if not across or part[a] != part[b]:
                            assert root(a) == root(b)


def test_sets_of_rows_without_id_are_counted_and_equal_rows_dropped(spark):
    text = " ".join(f"t{i}" for i in range(60))
    rows = [(3, text), (3, text), (None, text), (None, text), (4, text + " x"), (None, None), (None, None), (5, None), (6, "")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, row int")
    found = sorted([(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()], key=repr)
    assert found == sorted([(3, 56, 3)] * 2 + [(None, 56, None)] * 2 + [(4, 57, 3)] + [(None, 0, None)] * 2 + [(5, 0, 5), (6, 0, 6)], key=repr)
    kept = sorted([(r.doc_id, r.text) for r in jaccard.drop_near_duplicates(docs).collect()], key=repr)
    assert kept == sorted([(3, text), (None, text), (None, None), (5, None), (6, "")], key=repr)
    with pytest.raises(ValueError):
        jaccard.jaccard_components(docs, 60)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 130)] + [(130, 129), (7, 7), (200, 199), (199, 200)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**{i: 1 for i in range(1, 61)}, **{i: 100 for i in range(100, 131)}, 199: 199, 200: 199}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_shingles_of_short_texts():
    assert len(shingle_set(None)) == len(shingle_set(" ")) == 0
    assert len(shingle_set("a b")) == 1 and shingle_set("a b") == shingle_set("A  B") and shingle_set("a b") != shingle_set("b a")
    assert len(shingle_set("a b c d e")) == 1 and len(shingle_set("a b c d e f")) == 2


# --- contamination --------------------------------------------------------------------------------


def test_contamination_against_all_windows(spark):
    rng = np.random.default_rng(8)
    word = lambda n: [f"W{i}" if i % 3 else f"é{i}" for i in rng.integers(0, 12, n)]
    items = {i: " ".join(word(int(rng.choice([1, 4, 9, 10, 14, 25])))) for i in range(12)}
    docs = {}
    for i in range(60):
        parts = [" ".join(word(int(rng.integers(0, 20))))]
        for k in rng.integers(0, 12, int(rng.integers(0, 3))):
            parts.append(items[int(k)].lower().replace(" ", ", "))
        docs[i] = "\n".join(parts)
    split = lambda t: __import__("re").findall("[0-9a-z\x80-\U0010ffff]+", t.translate({c: c + 32 for c in range(65, 91)}))
    expected = {}
    for i, text in docs.items():
        w, hit, found = split(text), set(), set()
        for k, item in items.items():
            v = split(item)
            n = min(10, len(v))
            for window in {tuple(v[s : s + n]) for s in range(len(v) - n + 1)} if v else ():
                for s in range(len(w) - n + 1):
                    if tuple(w[s : s + n]) == window:
                        hit |= set(range(s, s + n))
                        found.add(str(k))
        expected[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    for limit in (decontaminate.BROADCAST_BYTES, 0):
        rows = decontaminate.find_contamination(frame, benchmark_of(spark, list(items.items())), broadcast_bytes=limit).collect()
        assert {r.doc_id: tuple(r)[1:] for r in rows} == expected
    assert decontaminate.find_contamination(frame, benchmark_of(spark, [])).where("contaminated").count() == 0


def test_contamination_runs_no_python(spark, odd):
    plan = decontaminate.find_contamination(odd, benchmark_of(spark, [(1, "one two")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- context trees --------------------------------------------------------------------------------


def tree_of(texts, order, max_contexts=10**9):
    keys, n = ppm.windows(texts, order)
    depth, context, symbol, count = [], [], [], []
    for d in range(order + 1):
        c = collections.Counter()
        for k, m in zip(keys.tolist(), n.tolist()):
            c[k & ((1 << 8 * (d + 1)) - 1)] += m
        for k, m in c.items():
            depth.append(d), context.append(k >> 8), symbol.append(k & 255), count.append(m)
    return ppm.ContextTree(order, *[np.array(x) for x in (depth, context, symbol, count)])


def slow_counts(texts, order):
    seen = collections.defaultdict(collections.Counter)
    for t in texts:
        data = b"\xff" * order + t + b"\xff"
        for i in range(order, len(data)):
            for d in range(order + 1):
                seen[data[i - d : i]][data[i]] += 1
    return seen


def slow_score(texts, order, text, seen=None):
    """Prediction by partial matching with dictionaries, symbol by symbol."""
    seen = slow_counts(texts, order) if seen is None else seen
    data, total = b"\xff" * order + text + b"\xff", 0.0
    for i in range(order, len(data)):
        p, excluded = 1.0, set()
        for d in range(order, -1, -1):
            counts = {s: k for s, k in seen.get(data[i - d : i], {}).items() if s not in excluded}
            if not counts:
                continue
            whole = sum(counts.values()) + len(counts)
            if data[i] in counts:
                p *= counts[data[i]] / whole
                break
            p *= len(counts) / whole
            excluded |= set(counts)
        else:
            p /= 256 - len(excluded)
        total += math.log10(p)
    return total


def test_context_tree_against_dictionaries():
    texts = [b"abracadabra", b"abcabcabc", "éèé".encode(), b""]
    for order in (1, 2, 4):
        tree = tree_of(texts, order)
        assert np.allclose((10.0 ** tree.logp.astype(float)).sum(axis=1), 1, atol=1e-5)
        tried = [b"", b"abra", b"zzz", b"cab" * 400, "é".encode()]
        assert np.allclose(tree.score(tried), [slow_score(texts, order, x) for x in tried], rtol=1e-5)


def test_counts_of_windows_in_spark(spark):
    texts = ["abab", "ba", None, ""] * 3
    frame = spark.createDataFrame([("x", t) for t in texts], "label string, text string").repartition(4)
    found = {r.key: r.n for r in ppm.window_counts(frame, 2).collect()}
    keys, n = ppm.windows([(t or "").encode() for t in texts], 2)
    assert found == dict(zip(keys.tolist(), n.tolist()))


@pytest.mark.parametrize("order, most", [(5, 1_000_000), (5, 50), (1, 0)])
def test_scores_use_every_context_of_the_training_texts(spark, order, most):
    """60,000 random letters: nearly all long contexts occur once, far below any share of the corpus."""
    rng = np.random.default_rng(12)
    texts = {i: "".join(rng.choice(list("abcdefghijklmnopqrst ÉZ"), 3_000 if i < 20 else 40)) for i in range(26)}
    texts |= {26: "", 27: "abracadabra " * 40}
    docs = spark.createDataFrame(list(texts.items()) + [(3, texts[3])], "doc_id long, text string").repartition(3)
    lower = {i: t.encode().lower() for i, t in texts.items()}
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 5 == 1}
    assert held
    train = [lower[i] for i in [*texts, 3] if i not in held]
    tried = [*sorted(held), 26, 27, 25]
    expected = {i: slow_score(train, order, lower[i]) for i in tried}
    found = lm_scores(docs, order=order, frequent_windows=most).collect()
    assert len(found) == len(texts) + 1
    assert {r.doc_id: r.score for r in found if r.doc_id in expected} == pytest.approx(expected, rel=1e-9)
    assert len({r.score for r in found if r.doc_id == 3}) == 1


def test_groups_of_windows_over_batch_borders(spark, monkeypatch):
    docs = spark.createDataFrame([("t", "the cat sat on the mat"), ("", "a hat that the rat had")] * 2, "label string, text string")
    counts = ppm.window_parts(docs, 3).groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("label") == "t", F.col("n")).otherwise(0)).alias("trained"))
    whole = {r.key: r.logp for r in ppm.window_logs(counts, 3).collect()}
    rows = counts.toPandas().sort_values(by="key", key=lambda k: k // 256 % 65_536)
    low = {}
    for k, n in zip(rows.key, rows.trained):
        low[k & 65_535] = low.get(k & 65_535, 0) + n
    low = {k: n for k, n in low.items() if n}
    table = np.array(sorted(low), np.uint64), np.array([low[k] for k in sorted(low)])
    for _, part in rows.groupby(rows.key // 256 % 65_536):  # group by group is the same as many together
        logs = ppm.window_probabilities(part.key.to_numpy().astype(np.uint64), part.trained.to_numpy(), table, 3)
        assert dict(zip(part.key, logs)) == pytest.approx({k: whole[k] for k in part.key})


def test_window_table_finds_what_it_holds():
    rng = np.random.default_rng(13)
    keys = np.unique(rng.integers(0, 2**48, 5_000).astype(np.uint64))
    values = rng.random(len(keys))
    found, missed = ppm.WindowTable(keys[::2], values[::2]).find(keys)
    assert np.array_equal(found[::2], values[::2]) and np.array_equal(missed, np.arange(1, len(keys), 2))


def test_base_scores(spark):
    texts = {i: t for i, t in enumerate(["a b a", "B c", "", "unseen words here " * 3, "a " * 50, "long" * 40])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 5 == 1}
    c = collections.Counter(w for i, t in texts.items() if i not in held for w in [*t.lower().split(), None])
    n, v = sum(c.values()), len(c)
    for frequent in (1, 100):
        for r in lm_scores(docs, order=2, frequent=frequent).collect():
            words = [*texts[r.doc_id].lower().split(), None]
            assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words))
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id in held, len(words), sum(c[w] > 0 for w in words), n)
            assert r.score < 0


def test_long_words_of_the_training_count_in_base_scores(spark):
    texts = {0: "a " + "long" * 40, 1: "LONG" * 40 + " a b", 2: "x" * 64 + " " + "x" * 65, 3: "b " + "y" * 65 + " " + "é" * 33}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 5 == 1}
    c = collections.Counter(w for i, t in texts.items() if i not in held for w in [*t.lower().split(), None])
    n, v = sum(c.values()), len(c)
    assert any(len(w or "") > 64 for w in c)
    for frequent in (1, 100):
        for r in lm_scores(docs, order=1, frequent=frequent).collect():
            words = [*texts[r.doc_id].lower().split(), None]
            assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words))
            assert r.n_known == sum(c[w] > 0 for w in words)


def test_frequent_words_are_bounded_and_complete(spark):
    docs = spark.createDataFrame([(" ".join(f"w{i}" for i in range(k)),) for k in range(1, 60)], "text string")
    counts = word_counts(docs)
    found, _ = frequent_words(counts, 10)
    assert 0 < len(found) <= 10 and min(found.values()) > max(r.n for r in counts.collect() if bytes(r.word) not in found)
    assert len(word_key(b"x" * 65)) == 33 and word_key(b"x") == b"x"


def test_models_beat_chance_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = held_out_languages(docs).join(docs, "doc_id").where("held_out and lang_pred != 'und'").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.9 * len(rows) and all(0 <= r.score <= 1 for r in rows)
    assert has_letter("…é".encode()) and not has_letter("…12".encode())


@pytest.mark.parametrize("group_bytes", [1 << 30, 1])
def test_every_prediction_by_brute_force(spark, monkeypatch, group_bytes):
    """Many rows of one language and five of another with letters of its own: all are learned, none by its share."""
    monkeypatch.setattr(language, "GROUP_BYTES", group_bytes)
    rng, held = np.random.default_rng(11), []
    words = {x: ["".join(rng.choice(list(letters), int(rng.integers(2, 6)))) for _ in range(30)] for x, letters in
             (("en", "abcdefgh"), ("de", "efghijkläß"), ("xx", "qvwzÿ"), ("", "mnop"))}
    for x, n in (("en", 400), ("de", 40), ("xx", 5), ("", 6), (None, 9)):
        held += [(x, " ".join(rng.choice(words[x or "de"], int(rng.integers(1, 12))))) for _ in range(n)]
    held += [("en", None), ("de", ""), ("xx", "12 34"), ("en", "ab " * 2_000 + "qvw")]
    rows = [(i, t, x) for i, (x, t) in enumerate(held)]
    found = {r.doc_id: r for r in held_out_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    learned = {x: [t.encode().lower() for i, t, y in rows if y == x and t is not None and zlib.crc32(str(i).encode()) % 5] for x in ("", "de", "en", "xx")}
    slow = {x: slow_counts(texts, 2) for x, texts in learned.items()}
    for i, t, _ in rows:
        if t is None or not any(c.isalpha() for c in t):
            assert (found[i].lang_pred, found[i].score) == ("und", 0.0)
            continue
        logs = {x: slow_score(learned[x], 2, t.encode().lower(), slow[x]) for x in sorted(slow)}
        best = max(logs, key=logs.get)
        others = sorted(logs.values())
        if others[-1] - others[-2] > 1e-3:
            assert found[i].lang_pred == best
        assert abs(found[i].score - 1 / sum(10.0 ** max(v - logs[best], -300) for v in logs.values())) < 2e-2
    assert {found[i].lang_pred for i, t, x in rows if x == "xx" and t != "12 34"} == {"xx"}


def test_language_does_not_use_other_columns(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    trees = fit_languages(docs, fold(F.col("doc_id")) != 0)
    plain = identify_language(docs.select("doc_id", "text"), trees).collect()
    assert sorted(plain) == sorted(identify_language(docs.withColumn("lang", F.lit("xx")), trees).collect())


# --- toxicity -------------------------------------------------------------------------------------


def test_toxicity_learns_words_and_uses_only_the_text(spark):
    rng = np.random.default_rng(9)
    rows, marks = [], []
    for i in range(900):
        words = [f"w{k}" for k in rng.integers(0, 300, 40)]
        if i % 3 == 0:
            words[int(rng.integers(0, 40))] = "horrid" if i % 2 else f"nastyish{rng.integers(0, 9)}"
        rows.append((i, " ".join(words)))
        marks.append((i, int(i % 3 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    training = fold(F.col("doc_id")) != 0
    model = fit_toxicity(docs, labels, training)
    found = score_toxicity(docs, model).join(labels, "doc_id").where(~training).collect()
    assert sum(r.predicted == r.toxic for r in found) >= 0.95 * len(found)
    assert all((r.score >= 0.5) == (r.predicted == 1) for r in found)
    again = fit_toxicity(docs.repartition(7), labels.repartition(3), training)
    assert np.allclose(again.vectors, model.vectors) and again.thresholds == model.thresholds


def slow_logit(model, words):
    """The network by its definition: every filter over every place, greatest activation, one output."""
    s = model.settings
    vectors = [model.vectors[list(toxicity.features(w, s.buckets))].sum(axis=0).astype(float) for w in words] + [np.zeros(s.size)] * max(max(s.widths) - 1, 1)
    column, pooled = 0, []
    for w, width in enumerate(s.widths):
        kernels = [model.kernels[:, column + j * s.filters : column + (j + 1) * s.filters] for j in range(width)]
        column += width * s.filters
        for f in range(s.filters):
            values = [sum(float(vectors[i + j] @ kernels[j][:, f]) for j in range(width) if i + j < len(vectors)) for i in range(len(vectors))]
            pooled.append(max(0.0, max(values) + model.bias[w * s.filters + f]))
    return float(np.dot(pooled, model.out)) + model.shift


def small_network():
    s = Settings(buckets=64, size=3, filters=2, epochs=1, batch=4, min_documents=1, rate=1e-6)
    model = toxicity.Classifier.fresh(s)
    rng = np.random.default_rng(1)
    model.vectors[:] = rng.normal(0, 1, model.vectors.shape)
    model.bias[:] = rng.normal(0, 0.3, model.bias.shape)
    reader, texts = toxicity.SampleReader(s.buckets), [[b"aa", b"bbbbb", b"cc"], [b"dd"], [b"aa", b"zz", b"zz", b"yy"], [], [b"k%d" % i for i in range(9)]]
    for x in texts:
        reader.add(x)
    return model, texts, reader.sample()


def test_forward_pass_by_its_definition():
    model, texts, sample = small_network()
    slow = [slow_logit(model, x) for x in texts]
    assert np.allclose(model.logits(texts), slow, atol=1e-4) and np.allclose(model.sample_logits(sample), slow, atol=1e-4)


def test_training_follows_the_numeric_gradient():
    """One batch of all texts: the first step of each dense weight goes against its numeric gradient."""
    model, texts, sample = small_network()
    labels = np.array([1, 0, 1, 0, 1], np.float32)
    weight = np.where(labels > 0, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))

    def loss():
        z = np.array([slow_logit(model, x) for x in texts])
        return float((weight * (np.log1p(np.exp(z)) - labels * z)).sum() / len(texts))

    slopes = {}
    for name in ("kernels", "bias", "out"):
        value = getattr(model, name)
        slopes[name] = np.zeros(value.shape)
        for at in np.ndindex(value.shape):
            keep = value[at]
            value[at] = keep + 1e-2
            up = loss()
            value[at] = keep - 1e-2
            slopes[name][at] = (up - loss()) / 2e-2
            value[at] = keep
    before = {name: getattr(model, name).copy() for name in slopes}
    model.settings = dataclasses.replace(model.settings, batch=5, rate=1e-3)
    model.train(sample, labels)
    for name, slope in slopes.items():
        step, clear = getattr(model, name) - before[name], np.abs(slope) > 2e-3
        assert clear.sum() > 2 and (np.sign(step[clear]) == -np.sign(slope[clear])).mean() > 0.95, name


def test_languages_of_thresholds_are_learned(spark):
    """Of invented languages, one too small for a tree of its own; every guess by the trees' scores of single words."""
    rng = np.random.default_rng(4)
    letters = {"aa": "abcde", "bb": "fghij", "cc": "абвгд", "tiny": "uvwxy"}

    def text(lang):
        return " ".join("".join(rng.choice(list(letters[lang]), 4)) for _ in range(12))

    rows = [(i, text(x), x) for i, x in enumerate(["aa"] * 90 + ["bb"] * 90 + ["cc"] * 90 + ["tiny"] * 8)] + [(500, text("aa"), None), (501, "", "aa"), (502, None, "aa"), (503, " ... ", "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    settings = Settings(epochs=1, buckets=1 << 10, min_per_language=40)
    model = fit_toxicity(docs, labels, F.lit(True), settings)
    assert model.languages.names == ["aa", "bb", "cc", toxicity.OTHER]
    fresh_texts = [(x, text(x)) for x in letters for _ in range(9)] + [("", ""), ("", "...")]
    texts = [toxicity.words_of(t.encode()) for _, t in fresh_texts]
    found = model.languages.guess(*model._numbered(texts))
    assert found == [x if x in ("aa", "bb", "cc") else toxicity.OTHER for x, _ in fresh_texts]
    for words, name in zip(texts, found, strict=True):
        if words:
            sums = [sum(float(tree.score([w])[0]) for w in words) for tree in model.languages.trees]
            assert model.languages.names[int(np.argmax(sums))] == name
    # the language of a row is no input of its score, and without any there is one threshold
    scored = {r.doc_id: r.score for r in score_toxicity(docs, model).collect()}
    renamed = score_toxicity(docs.withColumn("lang", F.lit("zz")), model).collect()
    assert all(scored[r.doc_id] == r.score for r in renamed)
    plain = fit_toxicity(docs.drop("lang"), labels, F.lit(True), settings)
    assert plain.languages.names == [] and set(plain.thresholds) == {toxicity.OTHER}


def test_without_both_classes_nothing_is_toxic(spark, odd, labels):
    model = fit_toxicity(odd, labels.withColumn("toxic", F.lit(0)), F.lit(True))
    assert all(r.predicted == 0 for r in score_toxicity(odd, model).collect())


# --- quality and pieces ---------------------------------------------------------------------------


def test_symbols_and_foreign_mixtures_fail_and_prose_stays(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    references = language_references(docs)
    text = docs.where("lang = 'en' and n_chars > 2000 and not text rlike '[$|%]'").orderBy("doc_id").head().text
    spoiled = " ".join(f"{w}$$${w}&&&" for w in text.split())
    frame = spark.createDataFrame([(1, text), (2, spoiled)], "doc_id long, text string")
    kept = {r.doc_id: (r.base_failed, r.kept) for r in quality_rules(frame, references).collect()}
    assert kept == {1: (False, True), 2: (False, False)}


def test_pieces_round_trip_in_spark(spark, odd):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    back = decode_pieces(encode_pieces(odd, path, keep=("doc_id", "lang")), path, keep=("doc_id", "lang"))
    assert collections.Counter((r.doc_id, r.text) for r in back.collect()) == collections.Counter((i, t or "") for i, t, _ in ODD)


def test_redacted_texts_hold_no_secret(spark):
    docs = spark.read.parquet(f"{SF_DIR.replace('0.001', '0.01')}/documents.parquet")  # the smallest table has no secrets
    assert scan_secrets(docs).where("spans != ''").count() > 0
    assert scan_secrets(redact_secrets(docs)).where("spans != ''").count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(name, spark, duck):
    from compare import difference

    assert difference(spark, duck, queries.QUERIES[name], queries.ORACLE_SQL[name], SF_DIR) == ""


def test_every_language_of_the_corpus_has_its_own_common_words(spark):
    """A small language besides a large one: no share of the rows is needed, its texts stay, those of no known language are not judged by words."""
    rng = np.random.default_rng(14)

    def prose(head, n):
        small = [f"{head}{k}" for k in range(20)]
        return " ".join(small[int(rng.integers(0, 20))] if rng.random() < 0.5 else f"{head}word{rng.integers(0, 5_000)}" for _ in range(n))

    rows = [(i, prose("a", 150), "aa") for i in range(400)] + [(i, prose("b", 150), "bb") for i in range(400, 425)]
    rows += [(500, prose("c", 150), "cc"), (501, prose("c", 150), None), (502, prose("c", 150), "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    references = language_references(docs)
    assert list(references) == ["aa", "bb"] and {b"a0", b"b0"} <= set(references.words) and len(references.words) == 40
    found = {r.doc_id: r for r in quality_rules(docs, references).collect()}
    assert all(found[i].kept and found[i].word_distance < 0.33 for i in range(425))
    assert found[500].kept and found[500].word_distance is None and found[501].kept and not found[502].kept
