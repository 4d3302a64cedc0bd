import re

import numpy as np
import pytest

from twigspark.llm import html_text as H


@pytest.fixture(scope="module")
def weights():
    return H.train(pages=1200, epochs=4)


def test_blocks():
    page = "<body><DIV class='Side-bar x'>a&amp;b  <b>c\n d</b><br>e</div><p>one<p>two<script>if (a<b) '</p>'</script> three<!-- no --><ul><li>x<li><a href='>'>y</a></ul>tail &lt;p&gt; 1 < 2<b"
    found = H.blocks(page)
    assert [b.text for b in found] == ["a&b c d e", "one", "two three", "x", "y", "tail <p> 1 < 2"]
    assert found[0].path == "body/div.bar.side.x" and found[4].linked == 1
    assert H.blocks(None) == [] and H.blocks("") == [] and H.blocks("<head><title>t") == []
    assert H.blocks("plain")[0].text == "plain"


def test_gradients_match_differences(monkeypatch):
    monkeypatch.setattr(H, "HIDDEN", 3)
    r = np.random.default_rng(0)
    w = {k + s: r.normal(size=n) for s in "fb" for k, n in (("W", (5, 12)), ("U", (3, 12)), ("z", 12))} | {"v": r.normal(size=11), "d": r.normal(size=1)}
    x, lengths, y = r.normal(size=(9, 5)), [4, 2, 3], r.integers(0, 2, 9).astype(float)
    _, g = H.gradients(w, x, lengths, y)
    for n in w:
        for i in list(np.ndindex(w[n].shape))[:3]:
            old, e = w[n][i], 1e-2
            w[n][i] = old + e
            up, _ = H.gradients(w, x, lengths, y)
            w[n][i] = old - e
            down, _ = H.gradients(w, x, lengths, y)
            w[n][i] = old
            assert abs((up - down) / (2 * e) - g[n][i]) < 2e-3


def test_held_out_layouts(weights):
    maker = H.Maker(1234)
    made = [p for p in (H.training_page(maker) for _ in range(300)) if p[0]]
    got, want = np.concatenate(H.labelled(weights, [b for b, _ in made])), np.concatenate([y for _, y in made]) > 0
    assert (got == want).mean() > 0.97


def test_pages_of_the_table(spark, weights):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    pages = {r.page_id: r.html for r in df.collect()}
    good = 0
    for r in H.extract(df, weights).collect():
        body = re.search(r"<article>(.*?)(</article>|<footer|$)", pages[r.page_id], re.S)[1]
        parts = [" ".join(H.html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        good += r.text == "\n\n".join(x for x in parts if x) and r.n_chars == len(r.text)
    assert good >= 0.98 * len(pages)


def test_odd_pages(spark, weights):
    long = "<body><article>" + "<p>Some words of the story, as they go.</p>" * 5000 + "</article>"
    rows = [(1, None, None, "x"), (1, "u", "", "x"), (2, "u", long, "x"), (3, None, "<" * 2000, "x")]
    got = {(r.page_id, r.url): r for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), weights).collect()}
    assert got[1, None].text == "" == got[1, "u"].text and got[1, "u"].n_chars == 0
    assert got[2, "u"].text.count("story") == 5000
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string"), weights).collect() == []


def test_time_follows_length():
    """Markup on which a search for each tag's end, an element's end or an open element would look through the whole page again and again."""
    import time

    hard = ["<a ", "<a \"", "<a '\"", "<a<a", "<svg>", "<head>", "<b></i>", "<!x", "<a \"'>", "<script", "</b ", "<svg><svg></svg>"]
    for part in hard:
        took = []
        for n in (100_000, 1_000_000):
            began = time.process_time()
            H.blocks(part * (n // len(part)))
            took.append(time.process_time() - began)
        assert took[1] < 15 and took[1] < 40 * max(took[0], 0.05), (part, took)


def test_unclosed_and_nested_elements_lose_no_text():
    for tag in ("svg", "math", "object", "canvas", "audio", "video", "template", "noscript"):
        assert [b.text for b in H.blocks(f"<p>one</p><{tag}><p>two</p>")] == ["one", "two"]
        assert [b.text for b in H.blocks(f"<p>one</p><{tag} x='>'>a<{tag}>b</{tag}>c</{tag}><p>two</p>")] == ["one", "two"]
        assert [b.text for b in H.blocks(f"<p>one</p><{tag}/><p>two</p></{tag}>")] == ["one", "two"]
    assert [b.text for b in H.blocks("<p>one <a href=\"x>two</a><p>three")] == ['one <a href="x>two', "three"]


def test_long_pages_in_pieces(weights):
    page = "".join(f"<p>a{k} of the story</p>" if k % 3 else f"<nav>b{k}</nav>" for k in range(700))
    found = H.blocks(page)
    whole = H.forward(weights, H.vectors([found]), [len(found)])
    for size in (1, 64, 699, 700, 5000):
        assert np.allclose(H.forward_in_pieces(weights, found, size), whole, atol=1e-4)


def test_very_many_blocks(weights):
    found = H.blocks("<p>a" * 100_000)
    (keep,) = H.labelled(weights, [found])
    assert len(found) == len(keep) == 100_000


def test_elements_that_never_end_are_read_once():
    import time

    for page in ("<svg>" + "<svg " * 200_000, "<script " * 150_000, "<svg/>" * 100_000 + "<svg " * 100_000, "<p>a" + "<style><style " * 70_000):
        began = time.perf_counter()
        H.blocks(page)
        assert time.perf_counter() - began < 4


@pytest.mark.parametrize(
    "page, want",
    [
        ("a<svg>x</svg>b", "ab"),
        ("a<svg/>b", "ab"),
        ("a<svg a='1'/>b<svg>c</svg >d", "abd"),
        ("a<svg><svg>x</svg>y</svg>b", "ab"),
    ],
)
def test_drawings_end_where_they_close(page, want):
    assert "".join(b.text for b in H.blocks(page)) == want
