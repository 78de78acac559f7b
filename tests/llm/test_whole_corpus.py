"""Small cases that a cut would show in."""

import gzip
import hashlib
import time
from collections import Counter
from html.parser import HTMLParser

import pytest

from cuewright.llm import html_text, language_id, warc

FOREIGN = [
    ("a <math><mi>x</mi><mo>=</mo><mn>2</mn><mtext>if</mtext></math> b", "a x=2if b"),
    ("<math><semantics><mi>x</mi><annotation encoding='application/x-tex'>\\x</annotation><annotation-xml><ci>n</ci></annotation-xml></semantics></math>y", "xy"),
    ("<svg><title>n</title><desc>n</desc><metadata>n</metadata><defs><text>n</text></defs><text>Jan <tspan>1</tspan></text><text>Feb</text></svg>", "Jan 1\nFeb"),
    ("<svg><title/><desc/><defs/><path d='M0 0'/><text>seen</text></svg>y", "seen\ny"),
    ("<svg><style>p{}</style><script>n</script><g display=none><text>n</text></g><foreignObject><p>in</p></foreignObject></svg>", "in"),
    ("<svg><text><![CDATA[1 > 0]]></text></svg>", "1 > 0"),
    ("<svg><defs><p>out", "out"),
    ("<title>n</title><desc>html</desc>", "html"),
]


@pytest.mark.parametrize("page, text", FOREIGN)
def test_math_and_svg(page, text):
    assert html_text.render(page) == text


def test_every_language_is_learned(spark):
    rows = [(i, f"text of the language {i % 205} " * 3, f"l{i % 205:03}") for i in range(205 * 12)]
    net = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=205)
    assert net.languages == [f"l{k:03}" for k in range(205)]


LAYOUT = [
    ("<table><tr><td rowspan=2>a<td>b<td>c<tr><td>d<td>e</table>", "a | b | c\n  | d | e"),
    ("<table><tbody><tr><td rowspan=9>1<td>2<tr><td>3<tbody><tr><td>4<td>5</table>", "1 | 2\n  | 3\n4 | 5"),
    ("<table><tr><td><p>one</p><p>two</p><ul><li>a<li>b</ul><td>x<tr><td>y<td>z</table>", "one | x\n\ntwo\n\n- a\n- b\ny   | z"),
    ("<table><tr><td>outer<td><table><tr><td>1<td>2<tr><td>33<td>44</table></table>", "outer | 1  | 2\n      | 33 | 44"),
    (f"<table><tr><td>{'w' * 60}<td>x<tr><td>s<td>y</table>", f"{'w' * 60} | x\n{'s'.ljust(60)} | y"),
    ("<style>.x{display:none} #k{visibility:hidden}</style><p class='b x'>n</p><p id=k>n <span style='visibility:visible'>yes</span></p>", "yes"),
    ("<p class=x>n</p><style>/* .y{display:none} */ @media print{.y{display:none}} p.x , b{ display : none }</style><p class=y>s</p><div class=x>t</div><b>n</b>", "s\n\nt"),
    ("<style>.z{display:none!important} .v{display:none}</style><p class=z style='display:block'>n</p><p class=v style='display:block'>y</p>", "y"),
    ("<div style='visibility:hidden'><ul><li>n<li style='visibility:visible'>y</ul></div>", "- y"),
    ("<input type=submit value='Go'><input type=hidden value=n><input value=t>", "Got"),
    ("<ol><li value=5>a<li>b</ol>", "5. a\n6. b"),
    ("<ol reversed><li>a<li>b</ol>", "2. a\n1. b"),
    ("&#99999999999999999999; &#x41;", "� A"),
    ("<ul>" * 30 + "<li>x", "- x"),
]


@pytest.mark.parametrize("page, text", LAYOUT)
def test_layout(page, text):
    assert html_text.render(page) == text


N = 100_000
HOSTILE = ["<b" * N, "<b" * N + ">", "<span>" * N, "<p><table><td>" + "<span>" * N + "<div>" * N, "<div>" * N + "a<br>" * N, "<ul><li>" * N, "<table><tr><td>" * (N // 2), '<a "' * N + ">", "&#" + "1" * N, "<p><b>" * N, "<table>" + "<tr><td rowspan=65534>a" * (N // 4), "<table><tr>" + "<td>" + "x" * N + "<td>y<tr><td>a<td>b" * (N // 5), "<style>" + "." * N + "{" * N, "<style>" + ".a{display:none}" * N + "</style>" + "<p class=a>" * N, "<style>" + ".a," * N + "{" + "display:none;" * N + "}</style>", "<pre>" * N + "a\n" * (5 * N), "<pre>a\n" * N, "<pre> \n" * N, "<pre><ul><li>" * (N // 3) + "a\n" * N]


@pytest.mark.parametrize("k", range(len(HOSTILE)))
def test_time_grows_with_the_length(k):
    """A page of a quarter of a megabyte and more; what is quadratic takes minutes on it."""
    at = time.process_time()
    html_text.render(HOSTILE[k])
    assert time.process_time() - at < 15


class Plain(HTMLParser):
    """Words outside of what isn't shown, in order, by Python's own parser."""

    def __init__(self):
        super().__init__()
        self.hidden, self.text = [], []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("br", "img", "input", "meta", "link", "hr", "wbr", "source", "col"):
            self.text.append(" ")
            return
        style = (a.get("style") or "").replace(" ", "").lower()
        if self.hidden or tag in ("head", "script", "style", "title", "template", "noscript", "iframe") or "hidden" in a or "display:none" in style or "visibility:hidden" in style:
            self.hidden.append(tag)
        self.text.append(" " if tag in html_text._LINES | html_text._PARAGRAPHS | html_text._CELLS else "")

    def handle_endtag(self, tag):
        if self.hidden and tag in self.hidden:
            while self.hidden.pop() != tag:
                pass
        self.text.append(" " if tag in html_text._LINES | html_text._PARAGRAPHS | html_text._CELLS else "")

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)


def test_pages_hold_the_words_of_a_plain_renderer(spark, sf_dir):
    rows = html_text.extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"), keep=("page_id", "html")).collect()
    assert len(rows) >= 50
    for r in rows:
        plain = Plain()
        plain.feed(r.html or "")
        plain.close()
        with_letter = lambda text: Counter(w for w in text.split() if any(c.isalpha() for c in w))
        assert with_letter(r.text) == with_letter("".join(plain.text)), r.page_id


def test_pre_within_pre():
    show = html_text.render
    assert show("<pre>a\n<pre>\n\nb  \n c\n\n</pre>d</pre>e") == "a\n\nb\n c\nd\n\ne"
    assert show("<pre><pre> </pre>x<pre></pre></pre>") == "x"
    assert show("<pre>1<pre>2<pre>3</pre></pre>4</pre>") == "1\n2\n3\n4"
    assert show("<pre><ul><li>a<pre>b\nc</pre></ul></pre>") == "- a\n\n  b\n  c"


def test_closed_details_show_their_summary():
    assert html_text.render("<details>no<summary>yes</summary><p>no<summary>no</summary></details>on") == "yes\non"
    assert html_text.render("<details open><summary>yes</summary><p>too</details>") == "yes\n\ntoo"


def test_archives_of_any_name_and_plain_ones_in_many_parts(spark, tmp_path):
    record = lambda k, body: b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:%d>\r\nContent-Length: %d\r\n\r\n" % (k, len(body)) + body + b"\r\n\r\n"
    bodies = {k: (b"WARC/1.0 in it \r\n\r\n" if k % 3 else b"x") * (k + 1) for k in range(90)}
    for n, name in enumerate(("a.warc", "fizz", "warc.GZ", "b.warc.gz")):
        whole = b"".join(record(100 * n + k, body) for k, body in bodies.items())
        (tmp_path / name).write_bytes(gzip.compress(whole) if name.lower().endswith(".gz") else whole)
    size = "spark.sql.files.maxPartitionBytes"
    was = spark.conf.get(size)
    spark.conf.set(size, "3000")
    try:
        got = {r.record_id: (r.content_bytes, r.content_digest) for r in warc.read_records(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set(size, was)
    assert got == {f"<urn:{100 * n + k}>": (len(b), hashlib.sha256(b).hexdigest()) for n in range(4) for k, b in bodies.items()}
