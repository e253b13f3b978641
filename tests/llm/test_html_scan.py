"""Which page parts names, elements and the scan decide, against a parser of its own."""

import re
from html.parser import HTMLParser

import pytest

from corvane.llm import html

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article class='post ad'>long text of article here</article>", "long text of article here"),
        ("<div class='form-content'>long text of form here</div>", "long text of form here"),
        ("<article><p>good text here</p><article class='comment'>me too</article></article>", "good text here"),
        ("<article>good words in here</article><article class='comment'>me too and more</article>", "good words in here"),
        ("<div class='ad-content'>buy this</div><p>text of it all</p>", "text of it all"),
        ("<div class='content-ad'>buy</div><p>good text x</p>", "good text x"),
        ("<div class='sidebar widget'>a b c</div><div class='post-body'>x y z w</div>", "x y z w"),
    ],
)
def test_names_are_scores(page, want):
    assert html.extract(page) == want


class _Article(HTMLParser):
    """Blocks of the words in <article>, without adverts, forms, comments and scripts."""

    def __init__(self):
        super().__init__()
        self.inside, self.away, self.blocks = 0, [], [""]

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.blocks[-1] += "\n"
            return
        if self.away:
            self.away += [tag] * (tag == self.away[0])
        elif tag in ("script", "style", "form", "aside", "nav") or (self.inside and re.search(r"\b(ad|comments?|notice)\b", dict(attrs).get("class") or "")):
            self.away = [tag]
        self.inside += tag == "article"
        if tag not in ("a", "b", "i", "em", "strong", "span", "code"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        if self.away and tag == self.away[-1]:
            self.away.pop()
        self.inside -= tag == "article"
        if tag not in ("a", "b", "i", "em", "strong", "span", "code"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside and not self.away:
            self.blocks[-1] += data


@pytest.fixture(scope="module")
def pages(spark):
    found = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect() if r.html]
    return found, html.weights_of(sum((html.counts(p) for p in found), start=html.Counter()))


def test_equals_another_parser(pages):
    found, weights = pages
    for page in found:
        other = _Article()
        other.feed(page)
        assert html.extract(page, weights) == "\n\n".join(t for t in (" ".join(b.split()) for b in other.blocks) if t)


def test_the_scan_cuts(pages):
    """Without names and with every landmark a <div>, the run alone leaves menus out and loses nothing of the article."""
    found, weights = pages
    cut = 0
    for page in found:
        flat = re.sub(r"(</?)(article|main|nav|header|footer|aside|section)\b", r"\1div", re.sub(r' (class|id|role)="[^"]*"', "", page))
        words = sum(x[6] for x in html.tokens(flat, weights)[0] if x[0] == "word")
        got, want = (html.Counter(html.extract(p, weights).split()) for p in (flat, page))
        assert not want - got
        cut += got.total() < words
    print(f"the scan cut {cut} of {len(found)} pages")
    assert cut == len(found) > 0
