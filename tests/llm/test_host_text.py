from __future__ import annotations

import re
from collections import defaultdict
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.llm import host_text, queries
from tallyline.llm.html_blocks import ARTICLE, MARKED, OPEN, page_blocks
from tests.llm.helpers import LARGER, table

PAGES = "page_id long, url string, html string, text string, stream long, names array<int>"


def pages(spark, rows):
    return spark.createDataFrame([(*row, "x", 1, [2]) for row in rows], PAGES)


def texts(df):
    return {r.page_id: r.text for r in df.collect()}


def brute_force(rows, min_run):
    """Every window of ``min_run`` tokens of a page sought in every other page of its host, as text."""
    parsed = [(i, host_text.host_of(url), page_blocks(html)) for i, url, html in rows]
    whole = [tuple(text for _, text in blocks) for _, _, blocks in parsed]
    tokens = []
    for _, _, blocks in parsed:
        tokens.append([t for kind, text in blocks if kind != ARTICLE for t in (f"<{kind}>", *text.split(" "))])
    found = {}
    for n, (i, host, blocks) in enumerate(parsed):
        others = [tokens[m] for m in range(len(rows)) if parsed[m][1] == host and whole[m] != whole[n]]
        windows = {tuple(other[k : k + min_run]) for other in others for k in range(len(other) - min_run + 1)}
        covered = [False] * len(tokens[n])
        for k in range(len(tokens[n]) - min_run + 1):
            if tuple(tokens[n][k : k + min_run]) in windows:
                covered[k : k + min_run] = [True] * min_run
        kept, at, repeated, marked = [], 0, 0, 0
        for kind, text in blocks:
            if kind == ARTICLE:
                kept.append(text)
                continue
            words = text.split(" ")
            gone = covered[at + 1 : at + 1 + len(words)]
            if not all(gone):
                runs = re.sub("1+", lambda m: ("1" if len(m[0]) >= min_run else "0") * len(m[0]), "".join("01"[g] for g in gone))
                gone = [g == "1" for g in runs]
            at += 1 + len(words)
            repeated += sum(gone)
            marked += len(gone) - sum(gone) if kind == MARKED else 0
            if kind == OPEN and not all(gone):
                kept.append(" ".join(w for w, g in zip(words, gone) if not g))
        found[i] = ("\n\n".join(kept), repeated, marked)
    return found


def random_pages(seed, n=60):
    """Pages of few words, so that many runs repeat, some with an article and some without."""
    rng = np.random.default_rng(seed)
    phrases = [" ".join(rng.choice(list("abcdefgh"), rng.integers(1, 9))) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = [f"<{tag}>{rng.choice(phrases)} {rng.choice(phrases)}" for tag in rng.choice(["div", "p", "nav", "li", "div class=ad", "section"], rng.integers(0, 6))]
        closed = [p + f"</{p[1:].split('>')[0].split(' ')[0]}>" for p in parts]
        article = f"<article><h1>{rng.choice(phrases)}</h1><p>{rng.choice(phrases)}</article>" if rng.random() < 0.4 else ""
        rows.append((i, f"http://h{rng.integers(0, 3)}.example/{i}", "<html><body>" + "".join(closed[:2]) + article + "".join(closed[2:])))
    rows += [(n + k, rows[k][1], rows[k][2]) for k in range(5)]
    return rows


@pytest.mark.parametrize(("seed", "min_run"), [(1, 3), (2, 4), (3, 7)])
def test_against_brute_force(spark, seed, min_run, monkeypatch):
    rows = random_pages(seed)
    found = {r.page_id: (r.text, r.n_repeated, r.n_marked) for r in host_text.extract_text(pages(spark, rows).repartition(5), min_run).collect()}
    assert found == brute_force(rows, min_run)
    assert sum(repeated for _, repeated, _ in found.values()) > 100


def test_tasks_that_sort_few_suffixes_at_once_find_the_same_runs():
    import pyarrow as pa

    rows = random_pages(5)
    batch = pa.RecordBatch.from_pydict({"url": [r[1] for r in rows], "html": [r[2] for r in rows]})

    def repeated():
        names = defaultdict(list)
        for out in host_text._stream_rows([batch], 4):
            for name, least, greatest in zip(*(out[c].to_pylist() for c in ("name", "least", "greatest"))):
                names[name] += [least, greatest]
        return {name for name, seen in names.items() if min(seen) < max(seen)}

    whole, host_text_at_once = repeated(), host_text.AT_ONCE
    try:
        host_text.AT_ONCE = 40
        assert repeated() == whole
    finally:
        host_text.AT_ONCE = host_text_at_once


def test_unmarked_boilerplate_goes_and_unique_runs_stay(spark):
    top, bottom = "Home News Sport Weather Contact About us Jobs Search", "All rights reserved by the Example Company of Example Town in Example"
    rows = [(i, f"https://www.example.org/{i}", f"<body><div>{top}</div><div><p>Unique story {i} told here.</p></div><div>{bottom}</div>") for i in range(6)]
    rows.append((6, "https://other.example.org/6", rows[0][2]))
    found = texts(host_text.extract_text(pages(spark, rows)))
    assert all(found[i] == f"Unique story {i} told here." for i in range(6))
    assert found[6] == f"{top}\n\nUnique story 0 told here.\n\n{bottom}"


def test_copies_and_shared_passages_inside_articles_stay(spark):
    passage = " ".join(f"word{i}" for i in range(60))
    rows = [(i, "http://a.example/", f"<nav>{passage}</nav><article><p>{passage}</p><p>{i // 2}</p></article>") for i in range(6)]
    found = texts(host_text.extract_text(pages(spark, rows)))
    assert found == {i: f"{passage}\n\n{i // 2}" for i in range(6)}


def test_copies_of_a_page_without_an_article_are_one_page(spark):
    html = "<div>" + " ".join(f"w{i}" for i in range(40)) + "</div>"
    found = texts(host_text.extract_text(pages(spark, [(i, "http://a.example/", html) for i in range(4)])))
    assert set(found.values()) == {" ".join(f"w{i}" for i in range(40))}


def test_awkward_rows(spark):
    rows = [
        (1, None, None), (None, "http://a.example/", "<p>x</p>"), (3, None, ""), (4, "no url at all", "  \n\t "), (5, "http://a.example/", "plain  text\n only"),
        (6, "http://a.example/", "<p>" + "long " * 100_000), (7, "http://a.example/", "<" * 5000 + "<b" * 2000), (8, "http://[::1]:80/x", "<article>&#xD800;&nbsp;&copy;</article>"),
        (5, "http://a.example/", "plain  text\n only"),
    ]
    found = host_text.extract_text(pages(spark, rows))
    assert found.columns == ["page_id", "url", "text", "n_chars", "n_repeated", "n_marked"]
    collected = found.collect()
    assert len(collected) == len(rows)
    assert all(r.n_chars == len(r.text) for r in collected)
    by_id = {r.page_id: r.text for r in collected}
    assert [by_id[i] for i in (1, 3, 4, 5, None)] == ["", "", "", "plain text only", "x"]
    assert by_id[6] == " ".join(["long"] * 100_000)
    assert by_id[8] == "� \N{COPYRIGHT SIGN}"
    assert host_text.extract_text(pages(spark, rows).limit(0)).collect() == []
    with pytest.raises(ValueError):
        host_text.extract_text(pages(spark, rows), 0)


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ("<article><p>a<p>b<div>c</div>d</article>", ["a", "b", "c", "d"]),
        ("<article><p>a <b>b<br>c</p><p>d</b>e</article>", ["a b c", "de"]),
        ("<article><p>a<button>share</button>b <span class='ad'>no</span>c</p></article>", ["ab c"]),
        ("<article>x<aside>no</aside><div class='comments'><p>no</p></div><article>a reader</article>y</article>", ["x", "y"]),
        ("<header>no</header><main><h1>t</h1><form>no<input value='>'></form>z</main><footer>no</footer>", ["t", "z"]),
        ("<article><!-- <p>no</p> -->a<script>'</p>no'</script><style>no</style>b<ul><li>1<li>2</ul></article>", ["ab", "1", "2"]),
        ("<article title='a > b'>1 < 2 &amp; 3 &lt;p&gt; &copy &unknown; &am</article>", ["1 < 2 & 3 <p> \N{COPYRIGHT SIGN} &unknown; &am"]),
        ("<article><table><tr><td>1<td>2<tr><th>3</table><dl><dt>a<dd>b</dl><pre> p\n q </pre></article>", ["1", "2", "3", "a", "b", "p q"]),
        ("<ARTICLE CLASS='post-header with-sidebar'>a</ARTICLE><div role=navigation>no</div>", ["a"]),
        ("<article><p hidden>no</p><p style='display:none'>no</p><p>yes</article><div class='site-footer'>no</div>", ["yes"]),
        ("<title>no</title><article>a</p>b</wrong>c<p class='lead'>d", ["a", "bc", "d"]),
        ("<article>a<script>never closed", ["a"]),
        ("<article><p class='x\">a</p><p>b</article>", ["a", "b"]),
    ],
)
def test_blocks(html, expected):
    assert [text for kind, text in page_blocks(html) if kind == ARTICLE] == expected
    assert all(kind == MARKED for kind, text in page_blocks(html) if text == "no")


def test_prefix_names_equal_when_tokens_are():
    rng = np.random.default_rng(1)
    tokens = rng.integers(1, 4, 300).astype(np.uint64)
    for length in (1, 2, 3, 5, 8, 13):
        names = host_text.prefix_names(tokens, length)
        windows = [tuple(tokens[i : i + length]) for i in range(len(tokens) - length + 1)]
        assert len(names) == len(windows)
        assert len(set(zip(windows, names.tolist()))) == len(set(windows)) == len(set(names.tolist()))


def article_of(html):
    """The article of the given pages, which have h1, p, b and br only."""
    inside = re.search(r"<article>(.*?)(?:</article>|\Z)", html, re.DOTALL)[1]
    blocks = [" ".join(unescape(re.sub(r"</?b>", "", part.replace("<br>", " "))).split()) for part in re.split(r"</?(?:p|h1)>", inside)]
    return "\n\n".join(block for block in blocks if block)


def test_the_given_pages(spark):
    expected = {row["page_id"]: article_of(row["html"]) for row in table("pages", LARGER)}
    found = queries.queries()["op11_host_text"](spark, LARGER)
    assert texts(found) == expected
    # Some of what is no article is found by its repetition; most hosts have few pages here.
    assert found.agg(F.sum("n_repeated") > 0).first()[0]
