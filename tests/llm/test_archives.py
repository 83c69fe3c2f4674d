"""Merkle manifest, vector codes and WARC archives against brute force and round trips."""

import gzip
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakescribe.functions.scratch import new_folder
from lakescribe.llm import merkle, queries, vector_codes, warc
from lakescribe.llm.common import runs_of

from compare import difference
from conftest import SF_DIR


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_vector_codes", "op13_warc"])
def test_queries_agree_with_sql(spark, duck, name):
    assert difference(spark, duck, queries.QUERIES[name], queries.ORACLE_SQL[name], SF_DIR) == ""


def test_runs_go_on_across_batches():
    rows = [(None, 1), (None, 1), ("a", 1), ("a", 2), ("a", 2), ("a", 2), ("b", 2)]
    table = pa.table({"x": [r[0] for r in rows], "y": [r[1] for r in rows]})
    for size in (1, 2, 3, 10):
        found = [(k, len(t)) for k, t in runs_of(iter([pa.RecordBatch.from_pylist([], table.schema), *table.to_batches(size)]), 2)]
        assert found == [((None, 1), 2), (("a", 1), 1), (("a", 2), 3), (("b", 2), 1)]


# --- manifest -------------------------------------------------------------------------------------


def test_layout_is_a_bijection_with_lower_subtrees_together():
    for levels in range(1, 6):
        places = [merkle.address(levels, d, np.arange(8**d)) for d in range(levels)]
        assert sorted(np.concatenate(places).tolist()) == list(range(merkle.layout_size(levels)))
    # split at half height: four levels are an upper subtree of nine nodes and 64 lower ones of nine
    places = merkle.places(4)
    assert sorted(np.concatenate(places[:2]).tolist()) == list(range(9))
    for k in range(64):
        assert sorted([places[2][k], *places[3][8 * k : 8 * k + 8]]) == list(range(9 + 9 * k, 18 + 9 * k))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_tree(leaves):
    """(root, siblings of each leaf: (left, right) by level) by folding lists."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for i, k in enumerate(at):
            a = k - k % 8
            paths[i].append(("".join(level[a:k]), "".join(level[k + 1 : a + 8])))
        level = [sha("".join(level[a : a + 8])) for a in range(0, len(level), 8)]
        at = [k // 8 for k in at]
    return level[0], paths


def brute_manifest(rows):
    def leaf(r, text):
        values = [None if x is None else str(x) for x in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)]
        return sha("".join("-" if x is None else f"{len(x.encode())}:{x}" for x in values))

    def tampered(r):
        if r["text"] is None or r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 3:
            return r["text"]
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])

    first = lambda x: (x is not None, x if x is not None else 0)
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted([(first(r["doc_id"]), leaf(r, r["text"]), i) for i, r in enumerate(rows) if r["lang"] == lang])
        trees[lang] = (own, *brute_tree([x[1] for x in own]))
    root, tops = brute_tree([trees[x][1] for x in langs])
    found = []
    for lang, top in zip(langs, tops, strict=True):
        own, subroot, paths = trees[lang]
        for (_, x, i), path in zip(own, paths, strict=True):
            fold = leaf(rows[i], tampered(rows[i]))
            for left, right in path + top:
                fold = sha(left + fold + right)
            found.append((rows[i]["doc_id"], x, subroot, root, sha("".join(a + b for a, b in path + top)), fold, fold == root))
    return sorted(found, key=repr)


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, tree string, place int"


@pytest.mark.parametrize("n, langs, height", [(700, ["en"], 1), (300, ["en", "en", "en", None, "", "é", "z"], 2), (90, [f"l{i}" for i in range(80)], 1), (9, ["en"], 3), (1, [None], 3)])
def test_manifest_agrees_with_brute_force(spark, n, langs, height):
    rnd = random.Random(n)
    texts = [None, "", "Some Text", "ÀB", "lower", "X" * 200_000]
    rows = [{"doc_id": rnd.choice([None, i, i, i, i // 2]), "text": rnd.choice(texts), "lang": rnd.choice(langs), "source": rnd.choice([None, "s", ""]),
             "n_chars": rnd.choice([None, 5]), "tree": "own", "place": 7} for i in range(n)]
    rows += [rows[0]] * 3  # repeated rows
    found = merkle.merkle_manifest(spark.createDataFrame([tuple(r.values()) for r in rows], DOCS), height)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, found.collect()), key=repr) == brute_manifest(rows)


def test_manifest_of_nothing(spark):
    assert merkle.merkle_manifest(spark.createDataFrame([], DOCS)).collect() == []


# --- vector codes ---------------------------------------------------------------------------------


def brute_codes(rows, parts=8, entries=16, rounds=6):
    whole = [(i, label, [int(np.floor(np.float64(x) * 4096)) for x in v]) for i, label, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    whole.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    size = len(whole[0][2]) // parts
    whole = [r for r in whole if len(r[2]) == size * parts]
    cut = lambda v, p: v[p * size : (p + 1) * size]
    books = [[cut(v, p) for _, _, v in whole[:entries]] for p in range(parts)]

    def nearest(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        sums = {}
        for _, _, v in whole:
            for p in range(parts):
                sums.setdefault((p, nearest(v, p)[1]), []).append(cut(v, p))
        for (p, k), own in sums.items():
            books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    made = [(i, label, [nearest(v, p) for p in range(parts)]) for i, label, v in whole]
    errors = [sum(d for d, _ in m) for _, _, m in made]
    by_label = {}
    for (_, label, _), e in zip(made, errors, strict=True):
        by_label[label] = by_label.get(label, 0) + e
    digest = sha(",".join(str(x) for p in books for e in p for x in e))
    return sorted([(i, "".join(f"{k:02x}" for _, k in m), e, by_label[label], digest) for (i, label, m), e in zip(made, errors, strict=True)], key=repr)


VECTORS = "vec_id bigint, embedding array<float>, label int, codes string, v int"


def test_codes_agree_with_brute_force(spark):
    rnd = random.Random(5)
    for n, width, grid in ((400, 16, 8), (60, 24, 3), (5, 8, 2), (300, 8, 1)):  # a coarse grid makes ties
        rows = [(i, rnd.choice([None, 1, 2]), [float(np.float32(rnd.randint(-grid, grid) / 64)) for _ in range(width)]) for i in range(n)]
        rows += [rows[0], rows[-1], (None, 1, rows[0][2]), (-1, 1, None), (-2, 2, [None] * width), (-3, 2, [float("nan")] * width), (-4, 2, [float("inf")] + [0.0] * (width - 1)),
                 (-5, 1, []), (-6, 1, [1.0] * 7), (n + 9, 1, [1.0] * (width + 8))]
        rnd.shuffle(rows)
        expected = brute_codes([r for r in rows if r[2] is None or len(r[2]) == width])
        found = vector_codes.vector_codes(spark.createDataFrame([(i, v, label, "x", 1) for i, label, v in rows], VECTORS))
        assert sorted(map(tuple, found.collect()), key=repr) == expected


def test_codes_of_nothing_and_of_huge_components(spark):
    assert vector_codes.vector_codes(spark.createDataFrame([], VECTORS)).collect() == []
    assert vector_codes.vector_codes(spark.createDataFrame([(1, None, 1, "", 1)], VECTORS)).collect() == []
    with pytest.raises(Exception, match="too large"):
        vector_codes.vector_codes(spark.createDataFrame([(1, [1e30] * 8, 1, "", 1)], VECTORS)).collect()


def test_active_entries_give_what_a_full_scan_gives():
    rng = np.random.default_rng(3)
    for _ in range(50):
        vectors = rng.integers(-3, 4, (60, 16)).astype(np.int64)
        old = vector_codes.Codebooks(rng.integers(-3, 4, (8, 5, 2)), np.ones((8, 5), bool))
        state = vector_codes.assign(vectors, old, None)
        entries = np.where(rng.random((8, 5, 1)) < 0.4, rng.integers(-3, 4, (8, 5, 2)), old.entries)
        new = vector_codes.Codebooks(entries, (entries != old.entries).any(axis=2))
        for x, y in zip(vector_codes.assign(vectors, new, state), vector_codes.assign(vectors, new, None), strict=True):
            assert (x == y).all()


# --- archives -------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 60), max_size=9), max_size=9))
def test_tree_merges_like_a_sort(runs):
    number, keyed = 0, []
    for run in runs:
        keyed.append(sorted(b"%03d-%05d" % (x, number + i) for i, x in enumerate(run)))
        number += len(run)
    tree = warc.LoserTree([r[0] if r else None for r in keyed])
    at, found = [0] * len(keyed), []
    while tree.least is not None:
        found.append(tree.least)
        w = tree.winner
        at[w] += 1
        tree.replace(keyed[w][at[w]] if at[w] < len(keyed[w]) else None)
    assert found == sorted(x for r in keyed for x in r)
    blocks = [(r[a], pa.RecordBatch.from_arrays([pa.array(r[a : a + 3], pa.binary())], names=["key"])) for r in keyed for a in range(0, len(r), 3)]
    blocks.sort(key=lambda b: b[0])
    assert [x for b in warc.merged(iter(blocks), 4) for x in b.column(0).to_pylist()] == found


PAGES = "page_id bigint, url string, html string, key string, part int"
LONG = "é" * 700


def hard_pages():
    rnd = random.Random(2)
    urls = [None, "", "http://www.A.example.com/x?b=1#f", "https://a.example.com", "a.example.com/x y\r\nWARC-Type: x", "http://user@B.org:80?q"]
    tricky = ["WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", "\r\n", "\r", "x\r\r\n\r", "\n\r\n\n", "a\r\n" * 900, "\0\x1a" * 600, "\r\n" * 600, " " * 1_200]
    texts = [None, "", "short", LONG, LONG + "!", "x" * 999, "x" * 1_000, "y" * 3_000_000, *tricky, *[t + "z" * 1_000 for t in tricky]]
    rows = [(rnd.choice([None, i, i, i]), rnd.choice(urls), rnd.choice(texts), "k", 3) for i in range(300)]
    return rows + [rows[-1]] * 2 + [(-5, "http://c.org/", "only" * 300, "k", 1), (None, "http://c.org/", "none" * 300, "k", 1), (None, "http://c.org/", "none" * 300, "k", 1)]


def brute_captures(rows):
    best = {}
    for page, _, html, *_ in rows:
        if page is not None and len((html or "").encode()) >= 1_000:
            best[html] = max(page, best.get(html, page))
    found = []
    for page, _, html, *_ in rows:
        data, refers = (html or "").encode(), best.get(html)
        refers = None if refers == page else refers
        found.append((page, len(data), hashlib.sha1(data).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(found, key=repr)


def test_archives_bring_back_every_page(spark, monkeypatch):
    monkeypatch.setattr(warc, "RUN_ROWS", 20)
    monkeypatch.setattr(warc, "BLOCK_ROWS", 4)
    monkeypatch.setattr(warc, "RANGE_BLOCKS", 5)
    rows = hard_pages()
    found = warc.warc_captures(spark.createDataFrame(rows, PAGES).repartition(5)).collect()
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted([tuple(r[c] for c in columns) for r in found], key=repr) == brute_captures(rows)
    found.sort(key=lambda r: r["ord"])
    assert [r["ord"] for r in found] == list(range(len(rows)))
    keys = [(r["url_key"].encode(), r["captured_at"], r["page_id"] is not None, r["page_id"] or 0) for r in found]
    assert keys == sorted(keys)
    assert {r["url_key"] for r in found} == {")/", "com,example,a)/x?b=1", "com,example,a)/", "com,example,a)/x%20y%0D%0AWARC-Type:%20x", "org,b)/?q", "org,c)/"}


def test_archives_are_warc_files_and_damage_is_found(spark):
    path = new_folder(spark, "archives")
    warc.write_archives(spark.createDataFrame([(1, "http://a.org/", LONG, "", 1), (2, "http://b.org/", LONG, "", 1)], PAGES).coalesce(1), path)
    (name,) = {f for f in spark.read.text(path).inputFiles()}
    data = gzip.open(name.removeprefix("file://")).read()
    first, second = data.split(b"WARC/1.1\r\n")[1:]
    assert b"WARC-Type: revisit\r\n" in first and b"Refers-To-Page-Id: 2\r\n" in first and b"WARC-Type: response\r\n" in second
    assert second.endswith(b"\r\n\r\n" + LONG.encode() + b"\r\n\r\n")
    assert first.split(b"WARC-Refers-To: ")[1].split(b"\r\n")[0] == second.split(b"WARC-Record-ID: ")[1].split(b"\r\n")[0]
    captures = {r["page_id"]: r for r in warc.read_captures(spark, path).collect()}
    assert [data[captures[i]["record_offset"] :][:8] for i in (1, 2)] == [b"WARC/1.1"] * 2 and captures[2]["record_offset"] == 10 + len(first)
    for wrong, why in ((data.replace("é".encode(), "è".encode(), 2), "damaged"), (data[:-8], "ends inside"), (data.replace(b"Content-Length: 1", b"Content-Length: 2"), "ends inside|than it says")):
        broken = new_folder(spark, "archives")
        spark.createDataFrame([(wrong[:-2].decode(),)], "value string").write.option("lineSep", "\r\n").option("compression", "gzip").text(broken)
        with pytest.raises(Exception, match=why):
            warc.read_captures(spark, broken).collect()


def test_archives_of_nothing(spark):
    assert warc.warc_captures(spark.createDataFrame([], PAGES)).collect() == []
