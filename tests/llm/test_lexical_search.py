"""Ranked search against plain loops: scores, ties, odd rows, several passes and blocks."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackwell.llm import lexical_search as ls
from trackwell.llm import queries

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _plain(docs, items, k=10):
    """(item, rank, doc, score) by the definition; docs and items: (id, text)."""
    words = lambda t: WORDS.findall((t or "").translate(LOWER))
    held = [(i, Counter(words(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, total = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    wanted: dict = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(words(t))
    out = []
    for i, own in wanted.items():
        scores = []
        for doc, c in held:
            m = 100 - 90 + 90 * c.total() * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in own if c[t])
            if s > 0:
                scores.append((-s, doc is None, doc or 0, doc))
        out += [(i, r + 1, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


DOCS = [(4, "Red fox, red-fox 12"), (3, "red fox red fox 12"), (9, "RED fox red fox 12"), (None, "red fox red fox 12"), (1, ""), (2, None), (5, "... --"), (6, "Äpfel äpfel fox"), (6, "Äpfel äpfel fox"), (7, "blue " * 500 + "fox")]
ITEMS = [(1, "fox RED Red"), (2, None), (2, "äpfel"), (2, "blue"), (None, "12"), (3, "nothing here"), (4, "?!"), (4, "fox")]


def _rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_scores_ties_and_odd_rows(spark):
    docs = spark.createDataFrame([(*r, "x", 1) for r in DOCS], "doc_id long, text string, score string, rank int")
    items = spark.createDataFrame([(*r, 0) for r in ITEMS], "item_id int, text string, doc_id int")
    assert _rows(ls.search(docs, items)) == _plain(DOCS, ITEMS)
    assert _rows(ls.search(docs, items, k=2)) == _plain(DOCS, ITEMS, 2)
    none = "doc_id long, text string"
    assert ls.search(spark.createDataFrame([], none), items).collect() == []
    assert ls.search(docs, spark.createDataFrame([], "item_id int, text string")).collect() == []
    assert ls.search(spark.createDataFrame([(1, None), (2, "-")], none), items).collect() == []


def test_repeated_terms_count_where_asked_for(spark):
    docs = spark.createDataFrame([(1, "red"), (2, "fox"), (3, "owl")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "red red fox")], "item_id int, text string")
    once, often = ls.search(docs, items), ls.search(docs, items, once=False)
    assert [r.score for r in once.sort("doc_id").collect()] == [once.first().score] * 2
    assert {r.doc_id: r.score // once.first().score for r in often.collect()} == {1: 2, 2: 1}


def test_passes_blocks_and_slices_change_nothing(spark, sf_dir, monkeypatch):
    """Parts of 2,000 characters of items, blocks of a few postings, texts split every 100 bytes."""
    want = _rows(queries.op11_lexical_search(spark, sf_dir))
    monkeypatch.setattr(ls, "PASS_CHARS", 2000)
    assert _rows(queries.op11_lexical_search(spark, sf_dir)) == want
    texts = ["ab cd " * 100, "x" * 500, "é" * 300 + " a", ""]
    whole = [ls.terms(t) for t in texts]
    monkeypatch.setattr(ls, "SLICE", 100)
    assert [ls.terms(t) for t in texts] == whole == [Counter(w.encode() for w in t.split()) for t in texts]


def test_best_of_blocks_is_best_of_all():
    rng = np.random.default_rng(3)
    score, ids = rng.integers(0, 6, 1000), rng.permutation(1000)
    unknown = rng.random(1000) < 0.01
    want = sorted(np.flatnonzero(score > 0), key=lambda i: (-score[i], unknown[i], ids[i]))[:10]
    assert ls._best(score, ids, unknown, 10).tolist() == want


def test_lengths_leave_64_bits():
    n = np.array([3, 10**9])
    assert ls.lengths(n, 10**11, 7 * 10**13).tolist() == [10 + 90 * int(x) * 10**11 // (7 * 10**13) for x in n]


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_query_against_plain_loops(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").where(F.col("item_id") < 12).select("item_id", "text").collect()]
    got = queries.op11_lexical_search(spark, sf).where("item_id < 12")
    assert _rows(got) == _plain(docs, items)
