import hashlib
import itertools
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from trackwell.llm import components, decontamination, html_extraction, license_scan, line_dedup, lm_scoring, mixing, quality_classifier, quality_rules, queries, similarity, simhash, suffix_array, suffix_dedup
from trackwell.llm.common import Scratch

DOCS = "doc_id long, text string, source string, words string, _row int"


def docs_of(spark, texts, sources=None):
    rows = [(i, t, (sources or ["a"])[i % len(sources or ["a"])], "clash", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def odd_texts():
    long = " ".join(f"word{i % 977} of" for i in range(30000)) + "."
    return [None, "", "   \n\t ", "one.", "A line that ends well, as prose does for ten words.\nHome | About | Contact | Terms", long, long, "ümläut ß " * 30]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_sql(name, same_rows):
    same_rows(queries.QUERIES[name], queries.SQL[name])


def test_odd_rows_and_empty_tables(spark):
    """Null, blank, long and repeated texts, null ids and sources, extra columns of clashing names; then no rows."""
    base = docs_of(spark, odd_texts(), ["a", None])
    base = base.unionByName(base.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long"))).unionByName(base.where("doc_id = 4"))
    bench = spark.createDataFrame([(1, "word1 of word2 of word3 of word4 of word5 of"), (2, None), (None, "x")], "item_id long, text string")
    labels = spark.createDataFrame([(3, 1), (4, 0), (None, 1), (5, None)], "doc_id long, quality int")
    for docs in (base, base.where("false")):
        n = docs.count()
        assert quality_rules.apply_rules(docs).count() == n
        assert line_dedup.remove_repeats(docs).count() == n
        assert license_scan.scan(docs).count() == n
        assert simhash.near_duplicates(docs).count() == n
        assert suffix_dedup.repeated_spans(docs).count() == n
        assert quality_classifier.score(docs, labels, F.lit(True)).where("score between 0 and 1").count() == n
        assert lm_scoring.score(docs, F.col("doc_id").isNotNull()).where("score <= 0 and base_score <= 0").count() == n
        assert mixing.mix(docs).count() == n
        assert decontamination.contaminated(docs, bench).columns == [*docs.columns, "leak"]
        assert decontamination.clean(docs, bench).columns == docs.columns
        assert decontamination.clean(docs, bench.where("false")).count() == n
        assert simhash.keep_one(docs).columns == docs.columns == line_dedup.clean(docs).columns == quality_rules.clean(docs).columns
    pages = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "<p>a<p>b", "x")], "page_id long, html string, blocks string")
    assert html_extraction.extract(pages).columns == [*pages.columns, "blocks_"]


def _edits(item, text):
    """Least edits of the whole item against any part of the text."""
    row = [0] * (len(text) + 1)
    for i in range(1, len(item) + 1):
        new = [i] + [0] * len(text)
        for j in range(1, len(text) + 1):
            new[j] = min(row[j - 1] + (item[i - 1] != text[j - 1]), row[j] + 1, new[j - 1] + 1)
        row = new
    return min(row)


def test_decontamination_against_full_alignment(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 6)))
    items = [(i, " ".join(word() for _ in range(rng.randint(14, 30)))) for i in range(4)]
    texts = []
    for k in range(24):
        part = list(items[k % 4][1])
        for _ in range(rng.randint(0, len(part) // 9)):
            at = rng.randrange(len(part))
            part[at : at + 1] = rng.choice([[], ["z"], [part[at], "q"]])
        fill = [" ".join(word() for _ in range(rng.randint(0, 20))) for _ in range(2)]
        texts.append(f"{fill[0]} {''.join(part).upper()} {fill[1]}")
    found = decontamination.contaminated(docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.leak.item_id): r.leak.edits for r in found.collect()}
    want = {}
    for d, t in enumerate(texts):
        for i, item in items:
            a, b = decontamination.normalize(item), decontamination.normalize(t)
            if (e := _edits(a, b)) <= decontamination.edit_budget(len(a)):
                want[d, i] = e
    assert got == want and want


def test_parts_of_a_benchmark_give_what_the_whole_gives(spark, sf_dir, monkeypatch):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "benchmark"))
    rows = lambda: sorted((r.doc_id, *r.leak) for r in decontamination.contaminated(docs, bench).collect())
    whole, clean = rows(), decontamination.clean(docs, bench).count()
    monkeypatch.setattr(decontamination, "PASS_CHARS", 1500)
    assert len(list(decontamination._passes(bench))) > 2
    assert rows() == whole and decontamination.clean(docs, bench).count() == clean


def test_filter_is_bounded(monkeypatch):
    items = [(1, "the quick brown fox jumps over the lazy dog and runs away")]
    monkeypatch.setattr(decontamination, "FILTER_BITS", 4)
    index = decontamination.Index(items)
    assert len(index.seen) == 2 and index.matches("xx " + items[0][1] + " yy")[0][0] == 1 and not index.matches("nothing of that kind stands here " * 3)


def test_decontamination_query_against_plain_search(spark, sf_dir):
    """Every item that stands in a text word for word is found by the query; what it finds more lies within the budget."""
    texts = {r.doc_id: decontamination.normalize(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = {r.item_id: decontamination.normalize(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id): r for r in queries.op1_decontamination(spark, sf_dir).collect()}
    exact = {(d, i) for d, t in texts.items() for i, x in items.items() if x in t}
    assert exact and {k for k, r in got.items() if r.edits == 0} == exact
    for (d, i), r in got.items():
        assert _edits(items[i], texts[d][max(0, r.start - 60) : r.stop + 60]) == r.edits <= decontamination.edit_budget(len(items[i]))


def _fingerprint(text, shingle=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(prints, distance=3):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= distance:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(prints))]


def test_simhash_against_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id")
    rows = docs.collect()
    prints = [_fingerprint(r.text) for r in rows]
    roots = _components(prints)
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {r.doc_id: (p, rows[k].doc_id) for r, p, k in zip(rows, prints, roots)}


def test_close_fingerprints_meet(spark):
    rng = random.Random(3)
    prints = set()
    for _ in range(40):
        p = rng.getrandbits(64)
        prints |= {p, p ^ (1 << rng.randrange(64)), p ^ sum(1 << b for b in rng.sample(range(64), 3)), p ^ sum(1 << b for b in rng.sample(range(64), 4))}
    prints = sorted(prints)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()
    root = {p: p for p in signed}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for u, v in edges:
        root[find(u)] = find(v)
    want = _components(prints)
    for (i, a), (j, b) in itertools.combinations(enumerate(signed), 2):
        assert (find(a) == find(b)) == (want[i] == want[j])


def _repeats(texts, n):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + n] for d in data for i in range(len(d) - n + 1))
    out = []
    for d in data:
        cover = [False] * len(d)
        for i in range(len(d) - n + 1):
            if seen[d[i : i + n]] > 1:
                cover[i : i + n] = [True] * n
        out.append(_runs(cover))
    return out


def _runs(cover):
    edges = [i for i in range(len(cover) + 1) if (i < len(cover) and cover[i]) != (i > 0 and cover[i - 1])]
    return list(zip(edges[::2], edges[1::2]))


def test_suffix_array_against_all_strings(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdeü", k=rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(rng.randint(90, 300)) for _ in range(6)]
    texts = [None, "", "ab" * 600, "ab" * 300, "x" * 900]
    for _ in range(60):
        parts = [text(rng.randint(0, 80))]
        for s in rng.sample(shared, rng.randint(0, 3)):
            s = list(s)
            for _ in range(rng.choice((0, 0, 1, 3))):
                s[rng.randrange(len(s))] = "#"
            lo = rng.randint(0, 60)
            parts += ["".join(s)[lo : len(s) - rng.randint(0, 60)], text(rng.randint(0, 40))]
        texts.append("".join(parts))
    texts += texts[10:14]
    got = {r.doc_id: [(s.start, s.stop) for s in r.spans] for r in suffix_dedup.repeated_spans(docs_of(spark, texts)).collect()}
    assert got == dict(enumerate(_repeats(texts, suffix_dedup.LENGTH)))


def _made_texts(rng):
    word = lambda: "".join(rng.choices("abcdeü", k=rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = text(400)
    return [text(rng.randint(5, 60)) + shared[rng.randint(0, 200) : rng.randint(600, 900)] + text(30) for _ in range(30)]


def test_ranks_against_sorting():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 3, (300, 37)).astype(np.uint8)
    rows[150:] = rows[:150]
    order = {r: i for i, r in enumerate(sorted({r.tobytes() for r in rows}))}
    assert suffix_array.ranks(rows).tolist() == [order[r.tobytes()] for r in rows]


@pytest.mark.parametrize("group", [3, 0])
def test_large_groups_are_cut_without_loss(spark, monkeypatch, group):
    texts = _made_texts(random.Random(16))
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    got = {r.doc_id: [(s.start, s.stop) for s in r.spans] for r in suffix_dedup.repeated_spans(docs_of(spark, texts)).collect()}
    assert got == dict(enumerate(_repeats(texts, suffix_dedup.LENGTH)))


def test_ranks_decide_what_is_repeated(monkeypatch):
    """With the ranks withheld, equal strings are no longer found."""
    texts = _made_texts(random.Random(17))
    flat = b"".join(t.encode() for t in texts)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    runs = list(suffix_array.runs(np.frombuffer(flat, np.uint8), offsets, 400))[0]
    at = runs.p + offsets[runs.doc]
    left, right = np.zeros((len(at), suffix_array.SPREAD), np.uint8), np.zeros((len(at), 400), np.uint8)
    for i, (x, a, b) in enumerate(zip(at, runs.a, runs.b)):
        left[i, :b] = np.frombuffer(flat[x - b : x][::-1], np.uint8)
        right[i, : 400 - a] = np.frombuffer(flat[x : x - a + 400], np.uint8)
    group = np.unique(runs.h, return_inverse=True)[1]
    found = suffix_array.repeated(group, runs.a, runs.b, left, right, 400).sum()
    monkeypatch.setattr(suffix_array, "ranks", lambda rows: np.random.default_rng(0).permutation(len(rows)))
    assert suffix_array.repeated(group, runs.a, runs.b, left, right, 400).sum() < found


def test_blocks_don_t_change_the_result(monkeypatch):
    data = np.random.default_rng(2).integers(97, 100, 9000).astype(np.uint8)
    offsets = np.array([0, 10, 10, 5000, 5399, 9000])
    starts = lambda: sorted((d, x) for r in suffix_array.runs(data, offsets, 400) for d, p, a, b in zip(r.doc, r.p, r.a, r.b) for x in range(p - b, p - a + 1))
    want = [(d, x) for d in range(5) for x in range(offsets[d + 1] - offsets[d] - 399)]
    assert starts() == want
    monkeypatch.setattr(suffix_array, "BLOCK", 700)
    assert starts() == want


def test_one_letter_a_million_times(spark):
    texts = ["x" * 1_000_000, "y" * 399, "z" * 400]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in suffix_dedup.repeated_spans(docs_of(spark, texts)).collect()}
    assert got == {0: [(0, 1_000_000)], 1: [], 2: []}


def test_suffix_query_against_brute_force(spark, sf_dir):
    rows = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    spans = dict(zip(rows, _repeats([t.decode() for t in rows.values()], 400)))
    got = queries.op8_suffix_dedup(spark, sf_dir).collect()
    assert len(got) == len(rows)
    for r in got:
        kept, done = b"", 0
        for i, j in spans[r.doc_id]:
            kept, done = kept + rows[r.doc_id][done:i], j
        kept += rows[r.doc_id][done:]
        removed = sum(j - i for i, j in spans[r.doc_id])
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(rows[r.doc_id]), removed, len(spans[r.doc_id]), hashlib.sha256(kept).hexdigest())


def test_mix_meets_its_targets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = queries.op9_mixing(spark, sf_dir).collect()
    again = queries.op9_mixing(spark, sf_dir).collect()
    assert sorted(rows, key=lambda r: r.doc_id) == sorted(again, key=lambda r: r.doc_id)
    source = {r.doc_id: r.source for r in docs.collect()}
    taken, size, target = Counter(), Counter(), {}
    for r in rows:
        taken[source[r.doc_id]] += r.taken
        size[source[r.doc_id]] += r["size"]
        target[source[r.doc_id]] = r.target
        assert r.taken <= 3 * r["size"]
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    for s in size:
        assert abs(taken[s] - target[s]) <= max(r["size"] for r in rows if source[r.doc_id] == s) / 2 + 1
    mixed = mixing.mixture(docs, block_words=256, shard_words=4096)
    sizes = mixed.groupBy("shard").count().collect()
    draws = mixing.mix(docs, block_words=256, shard_words=4096).select(F.sum(F.size("mix.draws"))).first()[0]
    assert len(sizes) > 3 and mixed.count() == draws


def test_small_sources_come_near_their_targets(spark):
    """Sources far smaller than a block: what a source takes misses its target by less than its largest document in the cut, mostly by a few words."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source")
    mixed = mixing.mix(docs).select("source", "mix.target", mixing.words_taken(F.col("mix")).alias("taken"))
    for r in mixed.groupBy("source").agg(F.max("target").alias("target"), F.sum("taken").alias("taken")).collect():
        assert abs(r.taken - r.target) <= 0.025 * r.target
    copies = spark.createDataFrame([(1, "a b c", "x")] * 5 + [(2, "w " * 30, "x"), (3, None, "x"), (4, "q " * 200, "y")], "doc_id long, text string, source string")
    rows = mixing.mix(copies, weights=(1,)).select("doc_id", mixing.words_taken(F.col("mix")).alias("taken")).collect()
    assert len(rows) == 8 and len({r.taken for r in rows if r.doc_id == 1}) == 1


def test_shards_draw_what_the_tree_deals(spark):
    """Against a plain walk: blocks of each source, permuted, dealt by the tree; documents of the blocks, cut at the target."""
    rng = random.Random(9)
    texts = [" ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    docs = docs_of(spark, texts, ["a", "b", None, "a", "a", "a", "a"])
    docs = docs.unionByName(docs.where("doc_id < 5"))  # repeated rows are drawn alike
    got = mixing.mix(docs, block_words=64, shard_words=1000).collect()
    sources = ["a", "b", None]
    own = {s: sum(r.mix.size for r in got if r.source == s) for s in sources}
    goal = dict(zip(sources, mixing.targets(list(own.values()), [1, 2, 3], sum(own.values()))))
    blocks_of_shard: dict = {}
    for s in sources:
        rows = [r for r in got if r.source == s]
        assert all(r.mix.target == pytest.approx(goal[s]) and r.mix.source_size == own[s] for r in rows)
        assert abs(sum(r.mix.size * len(r.mix.draws) for r in rows) - goal[s]) <= 2 * max(r.mix.size for r in rows)
        assert len({len(r.mix.draws) for r in rows if r.mix.size}) <= 2  # every block in each full pass, some once more
        by_pass = Counter((r.doc_id, d["pass"]) for r in rows for d in r.mix.draws)
        assert all(n == (2 if d < 5 else 1) for (d, _), n in by_pass.items())
        for r in rows:
            for d in r.mix.draws:
                blocks_of_shard.setdefault(d["shard"], Counter())[s] += r.mix.size
    assert len(blocks_of_shard) > 8 and sum(len(c) > 1 for c in blocks_of_shard.values()) > 4
    assert sum(not r.mix.draws for r in got) > 0
    for r in docs.join(spark.createDataFrame([(r.doc_id, len(r.mix.draws)) for r in got], "doc_id long, n int"), "doc_id").where("text = ''").collect():
        assert r.n == 0


def test_tree_deals_exact_quotas():
    quotas = [37, 5, 120]
    tree = mixing.SplittingTree(quotas, 11, 3)
    source = np.repeat(np.arange(3), quotas)
    rank = np.concatenate([np.arange(q) for q in quotas])
    shard = tree.place(source, rank)
    assert np.bincount(shard, minlength=11).tolist() == [tree.blocks_before(k + 1) - tree.blocks_before(k) for k in range(11)]
    assert all((np.diff(shard[source == s]) >= 0).all() for s in range(3))  # a shard draws consecutive permuted blocks
    part = np.random.default_rng(0).permutation(len(rank))[:50]
    assert (tree.place(source[part], rank[part]) == shard[part]).all()


def test_targets_reshare_the_excess():
    assert mixing.targets([10, 100, 5], [1, 2, 3], 115) == pytest.approx([30, 70, 15])


def test_license_automata():
    auto = {a.label: a for a in license_scan.compile_templates()}
    words = "neither the name of the acme corp nor the names of its contributors may be used to endorse or promote products".split()
    assert auto["bsd-3-clause"].accept(words, 0) == len(words)
    assert auto["bsd-3-clause"].accept(words[:-1] + ["things"], 0) == -1
    with pytest.raises(ValueError):
        license_scan.parse("x", "<<opt>>a b")


_MIT = """Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the
License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""


def test_whole_license_texts(spark):
    texts = [_MIT, _MIT.replace("sublicense, ", ""), _NOTICE, _NOTICE.replace("governing", "on"), _MIT + " " + _NOTICE]
    got = {r.doc_id: {m.label for m in r.licenses.matches} for r in license_scan.scan(docs_of(spark, texts)).collect()}
    assert [sorted(x for x in got[i] if x.endswith(("text", "notice"))) for i in range(5)] == [["mit-text"], [], ["apache-2.0-notice"], [], ["apache-2.0-notice", "mit-text"]]
    assert "apache" in got[3] and "apache-2.0" in got[3]


def test_quality_scores_separate_held_out_labels(spark):
    rng = random.Random(5)
    good = [" ".join("".join(rng.choices("aeioulnrst", k=rng.randint(2, 8))) for _ in range(60)) + "." for _ in range(150)]
    bad = [" | ".join("".join(rng.choices("aeioulnrst", k=rng.randint(2, 8))) for _ in range(60)) for _ in range(150)]
    docs = docs_of(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(300)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality_classifier.score(docs, labels, F.col("doc_id") % 3 != 0).collect()}
    held = [i for i in range(300) if i % 3 == 0]
    pairs = [(got[a], got[b]) for a in held if a < 150 for b in held if b >= 150]
    assert np.mean([a > b for a, b in pairs]) > 0.95


def test_quality_query_on_held_out_labels(spark):
    import zlib

    rows = {r.doc_id: r for r in queries.op3_quality_classifier(spark, "/root/testdata/sf0.01").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for d, r in rows.items())
    held = [(rows[d].score, q) for d, q in labels.items() if d in rows and rows[d].held_out and q is not None]
    pairs = [(a > b) + (a == b) / 2 for a, q in held if q for b, p in held if not p]
    assert len(held) > 30 and np.mean(pairs) > 0.95
    assert np.mean([int(s >= 0.3) == q for s, q in held]) > 0.9


def test_isotonic_is_the_best_monotone_fit():
    x, y = quality_classifier.isotonic(np.array([1, 2, 3, 4.0]), np.array([0, 1, 0, 1.0]))
    assert y.tolist() == [0, 0.5, 1] and x.tolist() == [1, 2.5, 4]


def test_network_gradients_and_state():
    words = np.arange(1, 41, dtype=np.uint64)
    model = lm_scoring.RecurrentModel(lm_scoring.Vocabulary(words, np.arange(40), 40), np.arange(60, 17, -1.0))
    model.p = {k: a.astype(np.float64) for k, a in model.p.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 43, (5, 3)), rng.integers(0, 43, (5, 3))
    total = lambda: model.log_probability(model.states(x, np.zeros((3, lm_scoring.HIDDEN))).reshape(-1, lm_scoring.HIDDEN).astype(np.float64), y.ravel()).sum()
    # Probabilities of all outcomes add up to one.
    h = model.states(x, np.zeros((3, lm_scoring.HIDDEN)))[0][:1].astype(np.float64)
    assert np.exp(model.log_probability(np.repeat(h, 43, axis=0), np.arange(43))).sum() == pytest.approx(1, abs=1e-4)
    before = total()
    kept = {k: a.copy() for k, a in model.p.items()}
    moments: dict = {}
    model.train_window(x, y, np.zeros((3, lm_scoring.HIDDEN), np.float32), moments, 0.01)
    assert total() > before
    model.p = kept
    ids = [rng.integers(0, 43, n) for n in (3, 70, 200)]
    whole = lm_scoring._document_scores(model, ids, 0)
    alone = [lm_scoring._document_scores(model, [i], 0)[0] for i in ids]
    assert whole == pytest.approx(alone, rel=1e-4)


def test_scores_against_a_plain_network():
    """One word at a time, every probability from whole soft-maxes, the state carried to the end."""
    words = np.arange(1, 71, dtype=np.uint64)
    model = lm_scoring.RecurrentModel(lm_scoring.Vocabulary(words, np.arange(70), 70), np.arange(90, 17, -1.0))
    p, n, full = model.p, lm_scoring.HIDDEN, model.full
    rng = np.random.default_rng(4)
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    squash = lambda x: 1 / (1 + np.exp(-x))
    docs, plain = [rng.integers(0, 73, k) for k in (1, 5, 90, 301)], []
    for ids in docs:
        h, last, total = np.zeros(n), 0, 0.0
        for y in ids:
            d = p["e"][last] + p["b"]
            zr = squash(d[: 2 * n] + h @ p["u"])
            h = zr[:n] * h + (1 - zr[:n]) * np.tanh(d[2 * n :] + (zr[n:] * h) @ p["uh"])
            k = y // lm_scoring.CLASS_WORDS if y < 70 else full + y - 70
            total += np.log10(soft(h @ p["c"] + p["cb"])[k])
            if y < 70:
                own = slice(k * lm_scoring.CLASS_WORDS, (k + 1) * lm_scoring.CLASS_WORDS)
                total += np.log10(soft(h @ p["w"][:, own] + p["wb"][own])[y % lm_scoring.CLASS_WORDS])
            last = y
        plain.append(total)
    assert lm_scoring._document_scores(model, docs, 0) == pytest.approx(plain, rel=1e-4)


def test_long_texts_are_not_padded_to_each_other(monkeypatch):
    monkeypatch.setattr(lm_scoring, "AREA", 1000)
    ids = [np.arange(k) for k in (3000, 5, 400, 7, 6, 300)]
    groups = list(lm_scoring._lockstep(ids, 4))
    assert all(y.size <= 1000 or y.shape[1] == 1 for _, _, y in groups)
    assert sorted(i for own, _, _ in groups for i in own) == list(range(6))
    for own, length, y in groups:
        for j, i in enumerate(own):
            assert (y[: length[j], j] == ids[i]).all() and (y[length[j] :, j] == -1).all()


def test_training_reruns_agree(spark):
    texts = [" ".join(random.Random(k).choices(["red", "green", "blue", "the", "sky"], k=40)) for k in range(60)]
    words = np.sort(np.array([xxhash.xxh64_intdigest(w, 3) for w in (b"red", b"green", b"blue", b"the", b"sky", b"\n")], np.uint64))
    vocabulary = lm_scoring.Vocabulary(words, np.arange(6), 6)
    lessons = docs_of(spark, texts).withColumn("round", (F.col("doc_id") % 2).cast("int"))
    made = [lm_scoring.train(lessons.repartition(k), vocabulary, np.ones(9), rounds=2, tasks=3).p for k in (5, 2)]
    assert all((made[0][k] == made[1][k]).all() for k in made[0])


def test_words_of_odd_texts():
    """Against plain splitting: hashes, forms, ends, in one piece and in several."""
    texts = ["  Red\x0bGREEN,  42.\n", None, "", " \t ", "\x1cx \u00a0y \u2003 Ä ä... ... a.b 日本 日.", "Red red"]
    own = lambda w: 2 if any(c < 65 or 90 < c < 97 or 122 < c < 128 for c in w.rstrip(b".,")) else int(not w.isascii())
    want = [[*((xxhash.xxh64_intdigest(w, 3), own(w)) for w in (t or "").encode().lower().split()), (lm_scoring.END, 0)] for t in texts]
    for kind in (pa.string(), pa.large_string()):
        found = lm_scoring._tokens(pa.array(texts, kind))
        assert [[(int(found.hashes[w]), int(found.forms[w])) for w in found.word[found.doc == d]] for d in range(len(texts))] == want
    batch = pa.RecordBatch.from_arrays([pa.array([None, *texts, "x" * 13_000_000, *texts])], ["text"])
    pieces = list(lm_scoring._pieces(batch))
    assert [first for first, _ in pieces] == [0, 7, 8] and [t for _, p in pieces for t in p.to_pylist()] == batch.column("text").to_pylist()


def test_training_takes_words_that_are_numbered_already(spark):
    """Texts are split once for training and scoring: ids in place of texts give the same weights."""
    texts = [" ".join(random.Random(k).choices(["red", "green", "blue", "the", "sky", "q7", "ж"], k=40)) for k in range(30)] + ["", None]
    words = np.sort(np.array([xxhash.xxh64_intdigest(w, 3) for w in (b"red", b"green", b"the", b"sky", b"\n")], np.uint64))
    vocabulary = lm_scoring.Vocabulary(words, np.arange(5), 5)
    lessons = docs_of(spark, texts).withColumn("round", (F.col("doc_id") % 2).cast("int"))
    ids = []
    for d, text in enumerate(texts):
        hashes = [*(xxhash.xxh64_intdigest(w, 3) for w in (text or "").encode().split()), lm_scoring.END]
        forms = [*({"q7": 2, "ж": 1}.get(w, 0) for w in (text or "").split()), 0]
        ids.append((d, vocabulary.number(np.array(hashes, np.uint64), np.array(forms)).astype(np.int16).tobytes(), d % 2))
    made = [lm_scoring.train(x, vocabulary, np.ones(8), rounds=2, tasks=3).p for x in (lessons, spark.createDataFrame(ids, "doc_id long, ids binary, round int"))]
    assert all((made[0][k] == made[1][k]).all() for k in made[0])


def test_a_step_holds_few_arrays():
    """A step of training passes over few arrays as large as its states, or they leave the processor's cache; gradients take the place of their factors."""
    model = lm_scoring.RecurrentModel(lm_scoring.Vocabulary(np.arange(1, 1025, dtype=np.uint64), np.arange(1024), 1024), np.arange(1100, 73, -1.0))
    x, y = np.random.default_rng(0).integers(0, 1027, (2, lm_scoring.WINDOW, 1024))
    h, moments = np.zeros((1024, lm_scoring.HIDDEN), np.float32), {}
    model.train_window(x, y, h, moments, 0.01)
    tracemalloc.start()
    model.train_window(x, y, h, moments, 0.01)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 17 * h.nbytes * lm_scoring.WINDOW


@pytest.mark.filterwarnings("error")
def test_gates_that_are_shut_or_open():
    """Where the exponential overflows, a gate is 0 or 1: the state is the candidate, or stays."""
    model, n = lm_scoring.RecurrentModel(lm_scoring.Vocabulary(np.arange(1, 3, dtype=np.uint64), np.arange(2), 2)), lm_scoring.HIDDEN
    model.p["e"][0], model.p["e"][1] = np.repeat(np.float32([-1e4, 0, 0.5]), n), np.repeat(np.float32([1e4, -1e4, 9]), n)
    model.p["u"][:], model.p["uh"][:], model.p["b"][:] = 0, 0, 0
    states = model.states(np.array([[0], [1]]), np.full((1, n), 0.25, np.float32))
    assert states == pytest.approx(np.full((2, 1, n), np.tanh(0.5)), rel=1e-6)


def test_a_step_follows_the_slope():
    """The first step divides each gradient by its size, so every weight moves by the rate where the likelihood's slope, by differences, isn't near 0."""
    words = np.arange(1, 41, dtype=np.uint64)
    model = lm_scoring.RecurrentModel(lm_scoring.Vocabulary(words, np.arange(40), 40), np.arange(60, 17, -1.0))
    model.p = {k: a.astype(np.float64) for k, a in model.p.items()}
    rng = np.random.default_rng(1)
    x, y, h = rng.integers(0, 43, (6, 3)), rng.integers(0, 43, (6, 3)), rng.normal(size=(3, lm_scoring.HIDDEN))
    y[4:, 0] = -1
    total = lambda: model.log_probability(model.states(x, h)[y >= 0], y[y >= 0]).sum() / (y >= 0).sum()
    kept = {k: a.copy() for k, a in model.p.items()}
    model.train_window(x, y, h, {}, 1e-3)
    moved, model.p = {k: model.p[k] - kept[k] for k in kept}, kept
    for name, a in model.p.items():
        for at in rng.choice(a.size, min(a.size, 40), replace=False):
            before = a.flat[at]
            slope = []
            for d in (1e-5, -1e-5):
                a.flat[at] = before + d
                slope.append(total())
            a.flat[at] = before
            slope = (slope[0] - slope[1]) / 2e-5
            assert moved[name].flat[at] == pytest.approx(1e-3 * slope / (abs(slope) + 1e-5), abs=2e-6), name


def test_training_rounds_and_tasks_both_grow():
    plans = [lm_scoring.rounds_of(n * lm_scoring.TASK_ROWS) for n in (0, 1, 8, 1_000, 10**6)]
    assert plans == [(2, 1), (2, 1), (3, 3), (11, 91), (101, 9901)]


def test_more_lessons_make_better_scores(spark):
    """Held-out log10 a token with one share of the rows to learn from and a larger one, the corpus counts being the same."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    of = lambda share: lm_scoring.score(docs, ~held, share=share).where(held).agg(F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens")).first()
    (few, base), (more, _) = of(1 / 32), of(1 / 2)
    assert more > few + 0.05 and more > base + 0.15


def test_lm_counts_and_base(spark, sf_dir):
    import math
    import zlib

    rows = {r.doc_id: r for r in queries.op6_lm_scoring(spark, sf_dir).collect()}
    tokens = {r.doc_id: (r.text or "").encode().lower().split() + [b"\n"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    learned = Counter(w for d, ws in tokens.items() if zlib.crc32(str(d).encode()) % 10 for w in ws)
    n, v = sum(learned.values()), len(learned)
    for d, ws in tokens.items():
        r = rows[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(w in learned for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((learned[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_frequent_words_keep_to_their_bound(spark):
    counts = spark.createDataFrame([(w, 0, n) for w, n in enumerate([900, 500, 40, 40, 3, 1, 1, 1])], "word long, form int, n long")
    kept = lambda most: sorted(r["n"] for r in lm_scoring._frequent(counts, most).collect())
    assert kept(8) == [1, 1, 1, 3, 40, 40, 500, 900]
    assert kept(7) == [3, 40, 40, 500, 900]
    assert kept(3) == [500, 900]  # equal counts come or stay out together
    assert kept(0) == []


def test_html_of_unseen_pages():
    rng = random.Random(77)
    exact = 0
    for _ in range(60):
        html = html_extraction.training_page(rng)
        tree = html_extraction._Wanted()
        tree.feed(html)
        tree.close()
        want = [t for n, t in ((n, " ".join("".join(p).split())) for n, p in tree.runs) if t and tree.wanted[n]]
        exact += html_extraction.main_blocks([html.replace("<z>", "").replace("</z>", "")], html_extraction.trained())[0] == want
    assert exact >= 54


def test_decoding_never_contradicts_ancestors():
    nodes, _ = html_extraction.parse("<div><div><p>a</p></div><p>b</p></div>")
    kept = html_extraction.decode(nodes, np.array([1.0, -0.5, -0.5, 3.0, -4.0]))
    assert all(kept[n.parent] for n, k in zip(nodes, kept) if k and n.parent >= 0) and kept[3] and not kept[4]


def _fails(x):
    words = len(re.findall(r"[^\x20\x09-\x0D]+", x))
    marks = len(re.findall(quality_rules.SYMBOLS, x)) + len(re.findall(quality_rules.SHOUTS, x))
    prose = x.rstrip(" \t\n\x0b\x0c\r")[-1:] in quality_rules.TERMINAL_MARKS or re.search(quality_rules.SENTENCE_END, x)
    return words and (not prose or marks * 10 > words or re.search(quality_rules.NAVIGATION, x) or re.search(quality_rules.BOILERPLATE, x))


def _after_rules(rows):
    """(doc_id, text) of the documents that the rules keep, failing lines left out."""
    docs = []
    for r in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        grams = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
        rep = {i + k for i in range(len(ws) - 4) if grams[tuple(ws[i : i + 5])] > 1 for k in range(5)}
        lines = (r.text or "").split("\n")
        lost = sum(len("".join(re.findall(r"[^\x20\x09-\x0D]+", x))) for x in lines if _fails(x))
        if len(ws) >= 10 and 100 * len(rep) <= 20 * len(ws) and 100 * lost <= 30 * sum(map(len, ws)):
            docs.append((r.doc_id, "\n".join(x for x in lines if not _fails(x))))
    return docs


def test_pipeline_against_brute_force(spark, sf_dir):
    """All stages by plain means: the rules, repeated runs of two solid lines, all pairs of similarity 0.8, the benchmark's items, the mixture's draws."""
    import corpus_pipeline
    from test_recall import _brute_passages, _brute_roots

    docs = _after_rules(spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    kept = _brute_passages(docs)
    left = [(d, kept[d]) for d, t in sorted(docs) if kept[d] == t or kept[d].strip(" \t\n\x0b\x0c\r")]
    left = [x for i, (x, root) in enumerate(zip(left, _brute_roots([t for _, t in left]))) if root == i]
    items = [decontamination.normalize(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = {(d, t) for d, t in left if not any(i in decontamination.normalize(t) for i in items)}
    stages = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        stages = stage(spark, stages, sf_dir)
    assert {(r.doc_id, r.text) for r in stages.collect()} == want
    assert stages.columns == spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.run(spark, sf_dir).collect())
    draws = {(r.doc_id, r.text): len(r.mix.draws) for r in mixing.mix(stages).collect()}
    assert got == Counter({k: n for k, n in draws.items() if n})


def test_pipeline_over_an_empty_table(spark, sf_dir, tmp_path):
    import corpus_pipeline

    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and {"doc_id", "text", "shard"} <= set(out.columns)


def test_one_row_of_each_component_stays(spark):
    """One id for unlike texts, repeated rows, rows without an id: no component is lost, none stays twice."""
    a, b, c = (" ".join(f"{x}{n}" for n in range(40)) for x in "abc")
    rows = [(1, a, "x"), (1, b, "x"), (2, a, "y"), (3, b, "y"), (3, b, "y"), (None, c, "z"), (None, c, "z"), (None, a, "z"), (5, None, "n"), (4, "", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    want = [(1, a), (1, b), (4, ""), (None, c)]
    for keep in (simhash.keep_one, similarity.keep_one):
        got = [(r.doc_id, r.text) for r in keep(docs).collect()]
        assert sorted(got, key=str) == sorted(want, key=str) and keep(docs).columns == docs.columns
        assert keep(docs.where("false")).count() == 0


def test_fingerprints_and_similarity_link_together(spark, monkeypatch):
    """A text linked by its fingerprint to one and by its set to another joins both; the pipeline's stage takes both links."""
    import corpus_pipeline

    rng = random.Random(5)
    words = [f"w{n}" for n in range(60)]
    a, c = " ".join(words), " ".join(f"x{n}" for n in range(60))
    near = " ".join([*words[:57], "y1", "y2", "y3"])  # by its set to a
    shuffled = " ".join(f"{x} {y} {z}" for x, y, z in [("p", "q", "r")] * 400)
    longer = shuffled + " p q r s"  # other sets of shingles, nearly the same repeated ones
    docs = docs_of(spark, [a, near, c, shuffled, longer, " ".join(rng.choices(words, k=40))])
    prints = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    sets = {r.doc_id: r.component_id for r in similarity.near_duplicates(docs).collect()}
    assert prints[4] == 3 and sets[4] == 4 and sets[1] == 0
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [0, 2, 3, 5]
    assert similarity.keep_one_by_both(docs.where("false")).count() == 0


def test_texts_are_not_sorted_for_line_dedup(spark, no_broadcast):
    """Texts stream past the places of removed lines; nothing sorts or holds a partition's texts."""
    passage = "one line here.\nand one more."
    docs = docs_of(spark, [f"{passage}\nfirst of all.", f"second.\n{passage}", None, "\n".join([passage] * 3)])
    found = line_dedup.remove_passages(docs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.split("\n") if "LeftOuter" in line]
    assert joins and all("ShuffledHashJoin" in line and "BuildRight" in line for line in joins)
    assert [r.dedup.clean_text for r in found.orderBy("doc_id").collect()] == [f"{passage}\nfirst of all.", "second.", None, ""]


def test_network_learns_from_every_learning_row(spark, monkeypatch):
    seen, train = [], lm_scoring.train
    monkeypatch.setattr(lm_scoring, "train", lambda lessons, *more: seen.extend(r.doc_id for r in lessons.collect()) or train(lessons, *more))
    docs = docs_of(spark, [f"red green {n}" for n in range(40)])
    assert lm_scoring.score(docs, F.col("doc_id") % 4 != 0).count() == 40
    assert sorted(seen) == [n for n in range(40) if n % 4]


def test_tiles_of_a_hot_key_lose_no_link(spark, monkeypatch):
    rng = random.Random(13)
    base = rng.getrandbits(38)
    prints = sorted({base | rng.getrandbits(26) << 38 for _ in range(60)})
    want = _components(prints)
    monkeypatch.setattr(simhash, "TILE", 7)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"))
    roots = {r.node: r.root for r in components.connected_components(edges, Scratch(spark, "t")).collect()}
    for (i, p), (j, q) in itertools.combinations(enumerate(signed), 2):
        assert (roots.get(p, p) == roots.get(q, q)) == (want[i] == want[j])


def test_components_of_a_long_path(spark):
    edges = spark.range(1, 700).selectExpr("id * 7919 % 100003 as u", "(id - 1) * 7919 % 100003 as v")
    nodes = {n * 7919 % 100003 for n in range(700)}
    got = {r.node: r.root for r in components.connected_components(edges, Scratch(spark, "t")).collect()}
    assert set(got.values()) == {min(nodes)} and set(got) >= nodes - {min(nodes)}


def test_shards_are_written_shuffled(spark, tmp_path):
    docs = docs_of(spark, [" ".join("w" * 40) for _ in range(200)], ["a", "b"])
    mixing.write_shards(docs, f"{tmp_path}/out", block_words=100, shard_words=1000)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == mixing.mixture(docs, block_words=100, shard_words=1000).count() and back.select("shard").distinct().count() > 4


def test_scratch_needs_a_shared_folder():
    from trackwell.llm import common

    with pytest.raises(ValueError):
        common._local_folder("spark://host:7077")
