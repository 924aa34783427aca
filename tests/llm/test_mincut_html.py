import html
import itertools
import random
import re

import pytest

from ballotframe.llm import catalogue, mincut_html


def test_whole_table_gives_the_articles(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = catalogue.op5_mincut_html(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)(</article>|\Z)", pages[r.page_id].html, re.DOTALL)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", article)).split())
        assert r.text == want and r.n_chars == len(want) and r.url == pages[r.page_id].url


def test_cut_equals_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randint(1, 8)
        costs = [(rng.random() * 3, rng.random() * 3) for _ in range(n)]
        edges = [(a, b, rng.random()) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]

        def total(labels):
            return sum(c[not x] for c, x in zip(costs, labels, strict=True)) + sum(w for a, b, w in edges if labels[a] != labels[b])

        best = min(total(x) for x in itertools.product([False, True], repeat=n))
        assert total(mincut_html.content_labels(costs, edges)) == pytest.approx(best)


PARAGRAPH = "This is a paragraph of the article, and it is long enough to look like prose to anybody."


@pytest.mark.parametrize("page, text", [
    ("", ""),
    ("<p", ""),
    ("plain words without any tag, but long enough to be a text of its own, as it may come from a mail.",
     "plain words without any tag, but long enough to be a text of its own, as it may come from a mail."),
    (f"<article><p>{PARAGRAPH}<p>Short.<p>{PARAGRAPH}</article>", f"{PARAGRAPH} Short. {PARAGRAPH}"),
    (f"<main><p>A &amp; b&nbsp;&lt;c&gt; &#233;&#x41; {PARAGRAPH}</p></main>", f"A & b <c> éA {PARAGRAPH}"),
    (f"<main><p>one<br>two<b>three</b>\n\t four {PARAGRAPH}</p></main>", f"one twothree four {PARAGRAPH}"),
    (f"<nav><ul><li><a href=x>{PARAGRAPH}</a></ul></nav><article><p>{PARAGRAPH}</p></article><footer><p>{PARAGRAPH}</p></footer>", PARAGRAPH),
    (f"<article><p>{PARAGRAPH}</p><div class='ad'>Buy this now, it is cheap.</div><p>{PARAGRAPH}</p></article>", f"{PARAGRAPH} {PARAGRAPH}"),
    (f"<article><p>{PARAGRAPH}</p><form>Your name <input> <p>{PARAGRAPH}</p></form></article>", PARAGRAPH),
    (f"<article><p>{PARAGRAPH}</p></article><section id='comments'><h2>Comments</h2><p>{PARAGRAPH}</p></section>", PARAGRAPH),
    (f"<article><p>{PARAGRAPH}</p><aside>{PARAGRAPH}</aside><script>if (a < b) {{ '</p>' }}</script><style>p{{}}</style></article>", PARAGRAPH),
    (f"<div class='cookie-notice'>{PARAGRAPH}</div><div class='content'><p>{PARAGRAPH}</p></div>", PARAGRAPH),
    (f"<article><p>{PARAGRAPH}<!-- <p>no</p> --></p><script>never closed {PARAGRAPH}", PARAGRAPH),
    (f"<article><p title=\"a > b\">{PARAGRAPH}</p></article></div></p></body>", PARAGRAPH),
])
def test_pages(page, text):
    assert mincut_html.main_text(page) == text


def labels_of(page):
    """(text, label by the block's own costs, label by the cut) of each block."""
    p = mincut_html.CutParams()
    blocks = mincut_html.read_blocks(page)
    odds = [mincut_html.log_odds(b, p) for b in blocks]
    cut = mincut_html.content_labels([(mincut_html.soft_plus(-z), mincut_html.soft_plus(z)) for z in odds], mincut_html.smoothness(blocks, p))
    return [(b.text, z > 0, c) for b, z, c in zip(blocks, odds, cut, strict=True)]


def test_cut_decides_without_telling_names():
    menu = "".join(f"<li><a href=/{k}>Page {k}</a></li>" for k in range(5))
    page = (f"<div><ul>{menu}<li>A line of a menu without any link that ends with a full stop.</li>{menu}</ul></div>"
            f"<div><p>{PARAGRAPH}</p><h2>Short head</h2><p>{PARAGRAPH}</p><p>Another line</p><p>{PARAGRAPH}</p></div>")  # fmt: skip
    found = {text: (alone, cut) for text, alone, cut in labels_of(page)}
    assert found["Short head"] == found["Another line"] == (False, True)
    assert found["A line of a menu without any link that ends with a full stop."] == (True, False)
    assert mincut_html.main_text(page) == f"{PARAGRAPH} Short head {PARAGRAPH} Another line {PARAGRAPH}"


def test_cut_mends_blocks_of_pages_without_names(spark, sf_dir):
    """Element and class names that tell are taken out of the given pages: the cut errs in fewer blocks than the costs alone."""
    errors_alone = errors_cut = changed = 0
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        plain = re.sub(r"<(/?)(article|nav|footer|header|aside)\b", r"<\1div", r.html)
        plain = re.sub(r'<div class="[^"]*"', "<div", plain)
        truth = [b.element.article and not b.element.bad for b in mincut_html.read_blocks(r.html)]
        found = labels_of(plain)
        assert len(found) == len(truth)
        errors_alone += sum(t != alone for t, (_, alone, _) in zip(truth, found, strict=True))
        errors_cut += sum(t != cut for t, (_, _, cut) in zip(truth, found, strict=True))
        changed += sum(alone != cut for _, alone, cut in found)
    assert changed > 0 and errors_cut < 0.8 * errors_alone


def test_odd_rows(spark):
    deep = "<div>" * 5_000 + PARAGRAPH
    rows = [(1, "u", None), (2, None, ""), (None, "u", f"<main><p>{PARAGRAPH}"), (4, "u", "<" * 20_000), (5, "u", deep),
            (6, "u", f"<article>{f'<p>{PARAGRAPH}' * 3_000}"), (6, "u", f"<article>{f'<p>{PARAGRAPH}' * 3_000}")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    out = sorted(mincut_html.extract_text(pages).collect(), key=lambda r: str(r.page_id))
    assert len(out) == 7
    texts = {r.page_id: r.text for r in out}
    assert texts[1] == texts[2] == "" and texts[None] == PARAGRAPH and texts[6] == " ".join([PARAGRAPH] * 3_000)
    assert mincut_html.extract_text(pages.limit(0)).count() == 0
