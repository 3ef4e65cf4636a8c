"""Recall on planted cases and against brute force over all pairs."""

import random
import time

import pytest
from pyspark.sql import functions as F

from trackwell.llm import html_extraction, line_dedup, similarity

DOCS = "doc_id long, text string"


def _brute_passages(docs):
    """Lines kept of each text: windows of two solid lines in order of (doc_id, place), the first of each stays."""
    first, out = {}, {}
    for d, text in sorted(docs):
        lines = text.split("\n")
        solid = [i for i, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r")]
        gone = set()
        for k, e in zip(solid, solid[1:]):
            fd, fe = first.setdefault((lines[k], lines[e]), (d, e))
            if not (fd == d and k <= fe):
                gone |= set(range(k, e + 1))
        out[d] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_every_planted_passage_goes(spark):
    rng = random.Random(10)
    line = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(12)) + "."
    passages = [[line() for _ in range(2 + n % 4)] for n in range(60)]
    rows, planted = [(n, "\n".join([line(), *p, line()])) for n, p in enumerate(passages)], {}
    for n, p in enumerate(passages):
        own = [[line() for _ in range(rng.randint(1, 4))] for _ in range(2)]
        planted[100 + n] = "\n".join(own[0] + own[1])
        rows.append((100 + n, "\n".join([*own[0], *p, *own[1]])))
    found = {r.doc_id: r for r in line_dedup.remove_passages(spark.createDataFrame(rows, DOCS)).collect()}
    assert {d: found[d].dedup.clean_text for d in planted} == planted
    assert all(found[d].dedup.removed_lines == 0 for d in range(60))
    cleaned = {r.doc_id: r.text for r in line_dedup.clean(spark.createDataFrame(rows, DOCS)).collect()}
    assert {d: cleaned[d] for d in planted} == planted


def test_passages_against_brute_force(spark):
    """Few different lines, so that runs overlap each other and themselves, with blank lines between."""
    rng = random.Random(11)
    rows = [(d, "\n".join(rng.choice(["", " ", *"abcdefghijkl"]) for _ in range(rng.randint(1, 12)))) for d in range(120)]
    rows += [(200, "x\nx\nx"), (201, "y\ny\ny\ny\ny"), (202, "p\n\nq\nr"), (203, "s\np\nq\nt")]
    got = {r.doc_id: r.dedup.clean_text for r in line_dedup.remove_passages(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == _brute_passages(rows)
    assert (got[200], got[201], got[203]) == ("x\nx\nx", "y\ny", "s\nt")


def _brute_roots(texts):
    """The smallest index that links of similarity 0.8 or more reach, from all pairs."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    roots = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if roots[i] != roots[j] and (a == b or 10 * len(a & b) >= 8 * len(a | b)):
                low, high = sorted((roots[i], roots[j]))
                roots = [low if r == high else r for r in roots]
    return roots


def test_near_duplicates_against_all_pairs(spark, monkeypatch):
    """Copies with more and more words changed, around similarity 0.8, and a group larger than a tile."""
    rng = random.Random(12)
    words = lambda n: [f"w{rng.randrange(10**5)}" for _ in range(n)]
    texts = [None, "", " ", "one two", "one two", "one two three"]
    for changes in range(16):
        for _ in range(3):
            base = words(200)
            near = list(base)
            for i in rng.sample(range(200), changes):
                near[i] = "other"
            texts += [" ".join(base), " ".join(near)]
    base = words(120)
    texts += [" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in range(0, 120, 3)]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    want = _brute_roots(texts)
    assert 20 < sum(r != i for i, r in enumerate(want)) and len(set(want)) > 40
    for tile in (similarity.TILE, 3):
        monkeypatch.setattr(similarity, "TILE", tile)
        assert {r.doc_id: r.component_id for r in similarity.near_duplicates(docs).collect()} == dict(enumerate(want))
    assert {r.doc_id for r in similarity.keep_one(docs).collect()} == set(want)
    unnamed = docs.withColumn("doc_id", F.when(F.col("doc_id") > 5, F.col("doc_id")))
    assert similarity.keep_one(unnamed).where("doc_id is null").count() == 3


def test_stages_against_brute_force(spark, sf_dir):
    """Passages and near-duplicates of the given documents, as the pipeline's stages run."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    docs = stages["quality_rules"](spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir).cache()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = _brute_passages(rows)
    want = {d: kept[d] for d, t in rows if kept[d] == t or kept[d].strip()}
    lines = stages["line_dedup"](spark, docs, sf_dir)
    assert {r.doc_id: r.text for r in lines.collect()} == want
    texts = [want[d] for d in sorted(want)]
    stay = {d for n, (d, r) in enumerate(zip(sorted(want), _brute_roots(texts))) if r == n}
    assert {r.doc_id for r in stages["similarity"](spark, lines, sf_dir).collect()} == stay


@pytest.mark.parametrize(("html", "texts"), [
    ("<html><head><title>x</title><meta charset=a><body><p>a<p>b", ["a", "b"]),
    ("<head><title>x</title><script>y</script><p>a</p>", ["a"]),
    ("<head><style>x</style>plain", ["plain"]),
    ("<head><noscript><link></noscript></head><p>a", ["a"]),
    ("<head><noscript><img><body><p>a", ["a"]),
    *[(f"<div><{t}>x</div><p>a</p>", ["a"]) for t in ("noscript", "svg", "object", "select", "iframe")],
    ("<div><svg><path d=x><p>a</p></div>", ["a"]),
    ("<p hidden>x<p>a</p>", ["a"]),
    ("<p hidden>x <b>y<div>a</div>", ["a"]),
    ("<ul><li style='display: none'>x<ul><li>y</ul><li>a</ul><p>b", ["a", "b"]),
    ("<table><tr><td hidden>x<td>a<tr hidden><td>y<tr><td>b</table>", ["a", "b"]),
    ("<div hidden>x<div>y</div><p>z</div><p>a</p>", ["a"]),
    ("<p>a</p><![foo bar]><p>b</p>", ["a", "b"]),
    ("<p>a</p><![if !IE]><p>b</p><![endif]><p>c</p>", ["a", "b", "c"]),
])
def test_left_out_end_tags_hide_nothing_more(html, texts):
    assert [t for _, t in html_extraction.parse(html)[1]] == texts


_LONG = [
    "The harbour was rebuilt after the storm of that winter, and the new wall reached further out than the old one ever had.",
    "Fishermen complained at first, since the current now ran faster along the quay, but within two years most had changed their minds.",
    "A survey counted forty boats in spring and sixty in autumn, more than at any time since records began in the town hall.",
    "What the engineers had not foreseen was the sand. It gathered behind the wall, and by the third year the inner basin had to be dredged.",
]


def _page(body, head="<title>Harbour news</title>"):
    return f"<!doctype html><html lang=en><head>{head}</head><body>{body}</body></html>"


#: Pages written by hand, unlike those that the model learns from.
_HAND = {
    "divs with generated class names": (_page(
        "<div class='_1xk9'><a href=/>The Courier</a><div class='_8s'><a href=/a>News</a><a href=/b>Sport</a><a href=/c>Weather</a><a href=/d>Letters</a></div></div>"
        "<div class='_2m0'><div class='_77a'><h1>A wall against the sea</h1><div class='_by'>By Ann Miller, 3 May</div>"
        + "".join(f"<div class='_p3'>{x}</div>" for x in _LONG) +
        "</div></div><div class='_9f'><a href=/x>Imprint</a> <a href=/y>Privacy</a> &copy; The Courier</div>"), _LONG),
    "main without article": (_page(
        "<header><a href=/>Home</a></header><nav><ul><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a></ul></nav><main><h1>A wall against the sea</h1>"
        + "".join(f"<p>{x}" for x in _LONG) + "</main><footer>Some rights reserved</footer>"), _LONG),
    "sections and a quotation": (_page(
        "<div id=top><a href=/>Log in</a> <a href=/s>Sign up</a></div><article><h1>A wall against the sea</h1><section><h2>Before</h2><p>" + _LONG[0] + "</p></section>"
        "<section><h2>After</h2><blockquote>" + _LONG[1] + "</blockquote><p>" + _LONG[2] + "</p><p>" + _LONG[3] + "</p></section></article>"
        "<section class=comments><h2>Comments</h2><div class=comment><p>I never liked that wall at all, said nobody ever.</p></div></section>"), _LONG),
    "head and paragraphs left open, a formula": (
        "<title>x</title><meta name=a><body><ul class=menu><li><a href=1>One</a><li><a href=2>Two</a></ul><div class=post><p>" + _LONG[0] + "<p>" + _LONG[1] +
        " Its height was <math><mi>h</mi><mo>=</mo><mn>7</mn></math> metres.<p>" + _LONG[2] + "<p>" + _LONG[3] + "</div>",
        [_LONG[0], _LONG[1] + " Its height was h=7 metres.", *_LONG[2:]]),
}


@pytest.mark.parametrize("name", sorted(_HAND))
def test_pages_written_by_hand(name):
    html, want = _HAND[name]
    got = html_extraction.main_blocks([html], html_extraction.trained())[0]
    assert [x for x in got if x in want] == want
    junk = " ".join(x for x in got if x not in want)
    assert not any(w in junk for w in ("Sport", "Imprint", "Privacy", "Two", "rights reserved", "Sign up", "never liked"))


def test_generated_pages_of_bare_divs():
    rng, same = random.Random(4711), 0
    for _ in range(60):
        html = html_extraction._plain_page(rng)
        tree = html_extraction._Wanted()
        tree.feed(html)
        tree.close()
        want = [t for n, t in ((n, " ".join("".join(p).split())) for n, p in tree.runs) if t and tree.wanted[n]]
        same += html_extraction.main_blocks([html.replace("<z>", "").replace("</z>", "")], html_extraction.trained())[0] == want
    assert same >= 52


def test_pages_null_empty_repeated_and_none(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "   ", "x"), (4, _HAND["main without article"][0], "x"), (4, _HAND["main without article"][0], "x"), (None, "<p>" + _LONG[0], "x")]
    pages = spark.createDataFrame(rows, "page_id long, html string, blocks string")
    got = sorted(((r.page_id or 0), r.blocks_) for r in html_extraction.extract(pages).collect())
    assert [b for d, b in got if d in (1, 2, 3)] == [[], [], []] and got[0] == (0, [_LONG[0]])
    assert got[-1] == got[-2] and set(_LONG) <= set(got[-1][1])
    assert html_extraction.extract(pages.where("false")).collect() == []


@pytest.mark.parametrize("before, after", [("", ""), ("<h1>A title of some words</h1>", ""), ("<article>", "</article>"), ("<main>", "</main>"), ("<div>", "</div>"),
    ("<nav><ul><li><a href='/'>Home</a></li><li><a href='/a'>About</a></li></ul></nav>", "<footer>&copy; 2020 Someone</footer>")])
def test_articles_in_bare_bodies_and_shells(before, after):
    """Every paragraph stays, be there three or a thousand, with or without an element around them."""
    rng = random.Random(3)
    words = "the council has voted to open a new park near the river after long debate among residents who asked for more green space".split()
    for n in (3, 10, 30, 100, 1000):
        said = [f"Number {k} {' '.join(rng.choices(words, k=rng.randint(12, 60)))}." for k in range(n)]
        page = f"<html><head><title>t</title></head><body>{before}{''.join(f'<p>{t}</p>' for t in said)}{after}</body></html>"
        found = html_extraction.main_blocks([page], html_extraction.trained())[0]
        assert [t for t in found if t.startswith("Number")] == said
        assert not {"Home", "About", "© 2020 Someone"} & set(found)


def test_hidden_inline_elements_and_details():
    texts = lambda html: [t for _, t in html_extraction.parse(html)[1]]
    assert texts('<p>a <span style="display: none">gone</span> b</p>') == ["a b"]
    assert texts("<p>x <b hidden>no<p>y") == ["x", "y"]
    body = "<h1>News of today</h1><p>Paragraph one of an article that has a number of words, as usual.</p><details><summary>More</summary><p>A paragraph inside, of some words too.</p></details>"
    found = html_extraction.main_blocks([f"<html><body><article>{body}</article></body></html>"], html_extraction.trained())[0]
    assert "A paragraph inside, of some words too." in found


@pytest.mark.parametrize("close", ["", "</div>"])
def test_hidden_nesting_takes_time_in_proportion(close):
    spent = []
    for n in (20_000, 80_000):
        began = time.process_time()
        assert html_extraction.parse("<div hidden>" + "<div>" * n + "x" + close * n + "</div><p>seen")[1][-1:] == ([(1, "seen")] if close else [])
        spent.append(time.process_time() - began)
    assert spent[1] < 8 * spent[0] + 0.5
