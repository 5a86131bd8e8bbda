import random

import numpy as np
import pytest

from sondera.llm import html as hx

WORDS = "river stone light paper summer garden window silver quiet morning letter answer market bridge".split()
SCHEMA = "page_id long, html string, title string, text string"


def page(rng, landmarks=True):
    """A page, and what its content is."""
    sentence = lambda: (" ".join(rng.choice(WORDS) for _ in range(rng.randrange(8, 20)))).capitalize() + "."
    body = [sentence() + " " + sentence() for _ in range(rng.randrange(2, 7))]
    nav = "".join(f'<li><a href="/x">{rng.choice(["Home", "About", "News", "Login", "Contact"])}</a></li>' for _ in range(rng.randrange(3, 7)))
    foot = f"<p>Copyright {rng.randrange(1990, 2025)} all rights reserved</p>"
    content = "".join(f"<p>{p}</p>" for p in body)
    if landmarks:
        text = f"<nav><ul>{nav}</ul></nav><article>{content}</article><aside class='ad'><p>Buy now!</p></aside><footer>{foot}</footer>"
    else:
        text = f"<div><ul>{nav}</ul></div><div>{content}</div><div>{foot}</div>"
    return f"<html><head><title>T &amp; t</title><style>p{{}}</style></head><body>{text}<script>var a='<p>no</p>';</script></body></html>", body


def test_blocks():
    found, title = hx.blocks("<title>A &lt; b</title><body><div class='Main x'>one <b>two</b><p>three<p>four<br>five<li>six &amp; 7</div>eight < nine<!-- no --><script>no</script><table><tr><td>a<td>b</table>")
    assert title == "A < b"
    assert [b.text for b in found] == ["one two", "three", "four", "five", "six & 7", "eight < nine", "a", "b"]
    assert found[0].path == ("body", "div .main .x") and found[1].path == ("body", "div .main .x", "p")
    assert found[6].path[-1] == found[7].path[-1] == "td" and len(found[6].path) == len(found[7].path)
    assert hx.blocks("<nav><a>go there</a> now</nav>")[0][0].linked == 8


@pytest.mark.parametrize("text", ["", "<", "<<<>>>", "<div", "</div></p>", "plain text", "<script>never closed", "<!-- never closed", "a" * 10, "<p " + "x='" * 2000, "<a href=\"" + "y" * 5000, "\x00�&#xD800;&bogus;<p>é"])
def test_any_text_is_a_page(text):
    found, _ = hx.blocks(text)
    assert all(b.text and len(b.path) >= 0 for b in found)


def test_gradients():
    """Backward passes against differences."""
    rng = np.random.default_rng(0)
    net = hx.Lstm(rng)
    x = rng.normal(size=(5, 3, hx.WIDTH))
    aim = rng.normal(size=(5, 3, hx.HIDDEN))
    out, saved = net.forward(x, True)
    grads = net.backward(x, saved, out - aim)
    loss = lambda: 0.5 * ((net.forward(x)[0] - aim) ** 2).sum()
    for p, g in zip(net.p, grads, strict=True):
        for at in (tuple(rng.integers(0, s) for s in p.shape) for _ in range(12)):
            old = p[at]
            p[at] = old + 1e-5
            up = loss()
            p[at] = old - 1e-5
            down = loss()
            p[at] = old
            assert g[at] == pytest.approx((up - down) / 2e-5, abs=1e-5, rel=1e-4)


def test_padding_changes_nothing():
    rng = np.random.default_rng(1)
    model = hx.Labeller()
    pages = [rng.normal(size=(n, hx.WIDTH)).astype(np.float32) for n in (1, 9, 40)]
    together = model.probabilities(pages)
    for p, got in zip(pages, together, strict=True):
        assert got == pytest.approx(model.probabilities([p])[0], abs=1e-5)


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(3)
    return hx.train(spark.createDataFrame([(k, page(rng)[0]) for k in range(150)], "page_id long, html string"))


@pytest.mark.parametrize("landmarks", [True, False])
def test_held_out_accuracy(spark, model, landmarks):
    rng = random.Random(77)
    made = [page(rng, landmarks) for _ in range(60)]
    df = spark.createDataFrame([(k, p, "t", "x") for k, (p, _) in enumerate(made)], SCHEMA)
    right = wrong = missed = 0
    for r in hx.extract(df, model=model).collect():
        want, got = set(made[r.page_id][1]), set(r.text.split("\n")) - {""}
        right, wrong, missed = right + len(want & got), wrong + len(got - want), missed + len(want - got)
        assert r.n_content == len(r.text.split("\n")) if r.text else r.n_content == 0
        assert len(r.labels) == r.n_blocks and r.title == "T & t"
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.95


def test_context_of_the_document_counts(model):
    """The same block gets another label in other surroundings: the network reads the sequence, not the block alone."""
    block = hx.Block(("html", "body", "div", "p"), "Some words here", 0)
    link = hx.Block(("html", "body", "div", "ul", "li"), "Home", 4)
    prose = hx.Block(("html", "body", "div", "p"), " ".join(WORDS * 3).capitalize() + ".", 0)
    a = model.probabilities([hx.vectors([link, link, block, link, link])])[0][2]
    b = model.probabilities([hx.vectors([prose, prose, block, prose, prose])])[0][2]
    assert abs(a - b) > 1e-3


def test_odd_rows(spark, model):
    long = "<article>" + "<p>Some words stand here, and more of them follow.</p>" * 30_000 + "</article>"
    rows = [(1, None, "t", "x"), (2, "", "t", "x"), (None, "<p>x", "t", "x"), (3, "<div></div>", "t", "x"), (4, long, None, None), (5, "<p>a", "t", "x"), (5, "<p>a", "t", "x")]
    got = hx.extract(spark.createDataFrame(rows, SCHEMA), model=model)
    by = {}
    for r in got.collect():
        by.setdefault(r.page_id, []).append(r)
    assert by[1][0].text is None and by[1][0].title is None and by[2][0].text == "" and by[2][0].n_blocks == 0 and by[3][0].n_blocks == 0
    assert by[4][0].n_blocks == 30_000 and len(by[4][0].labels) == 30_000 and len(by[5]) == 2 and by[5][0] == by[5][1] and None in by
    empty = spark.createDataFrame([], SCHEMA)
    assert hx.extract(empty).count() == 0 and hx.extract(empty, model=model).columns == got.columns


def test_the_whole_path_and_every_class_count():
    """A landmark far above a block, and a class behind many others, are read as near ones are."""
    deep = ("div",) * 12
    near, far = hx.Block(deep, "text", 0), hx.Block(("footer", *deep), "text", 0)
    a, b = hx.vectors([near])[0], hx.vectors([far])[0]
    assert b[hx._slot("footer")] - a[hx._slot("footer")] == pytest.approx(1 / 13, abs=1e-6)
    found, _ = hx.blocks("<body><div class='a b c d e f footer'>text</div></body>")
    assert found[0].path == ("body", "div .a .b .c .d .e .f .footer")
    assert hx.vectors([hx.Block(("div .footer",), "text", 0)])[0][hx._slot(".footer")] > 0 and hx.vectors(found)[0][hx._slot(".footer")] >= 1


def test_without_landmarks_every_block_is_content(spark):
    """Nothing can be learnt then, and a network as it began would drop blocks at random."""
    pages = [(k, "<html><body>" + "".join(f"<p>Paragraph {k} {j} of plain text.</p>" for j in range(5)) + "</body></html>") for k in range(6)]
    got = hx.extract(spark.createDataFrame(pages, "page_id long, html string")).collect()
    assert all(r.n_blocks == r.n_content == 5 and list(r.labels) == [1.0] * 5 and r.text.count("\n") == 4 for r in got)
    one_kind = [(k, f"<article><p>Only content {k}.</p></article>") for k in range(4)]
    assert all(r.n_content == 1 for r in hx.extract(spark.createDataFrame(one_kind, "page_id long, html string")).collect())
    assert hx.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_names_that_differ_in_case_only(spark):
    df = spark.createDataFrame([(1, "<p>one</p>", "two", "three")], "page_id long, html string, HTML string, text string")
    assert hx.extract(df).first().text == "one"
