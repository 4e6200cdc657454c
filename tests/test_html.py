import pytest
from hypothesis import given
from hypothesis import strategies as st

from quarry.functions import structured
from quarry.functions.css import SelectorError, compile_selector
from quarry.functions.dom import parse
from quarry.functions.xpath import first_value

SHELF = """<div class="toy"><span class="label">A kite</span><small class="maker">Ann</small><a class="more" href="/toy/kite">t</a></div>
<div class="toy"><span class="label">A sled</span><small class="maker">Bo</small><a class="more" href="/toy/sled">t</a></div>"""


def texts(html, selector, scope=None):
    return [e.text().strip() for e in compile_selector(selector).iter(scope or parse(html))]


def test_tree_implies_what_html_implies():
    d = parse("<title>T &amp; U</title><p>a<p>b<ul><li>1<li>2</ul><table><tr><td>x<td>y<tr><td>z</table>")
    assert texts(None, "title", d) == ["T & U"]
    assert texts(None, "body > p", d) == ["a", "b"]
    assert texts(None, "ul > li", d) == ["1", "2"]
    assert texts(None, "table > tbody > tr > td", d) == ["x", "y", "z"]
    assert texts("<p><b>x<br><p>y", "p") == ["x", "y"]
    assert texts("<p><b>x<p>y", "p > b") == ["x", "y"]
    assert texts("<script>var t='</p><i>no</i>'</script><i>yes</i>", "i") == ["yes"]
    assert texts("a &ampb", "body") == ["a &b"]
    assert parse(None).text() == ""


@pytest.mark.parametrize(
    ("selector", "expected"),
    [
        (".toy .label", ["A kite", "A sled"]), ("div.toy:nth-child(2) > .maker", ["Bo"]), (".label + .maker", ["Ann", "Bo"]), (".label ~ a[href$='kite']", ["t"]), ("a[href^='/toy'][href*=led]", ["t"]),
        ("small:not(.x), em", ["Ann", "Bo"]), (".toy:last-child .label", ["A sled"]), ("[class~=label]:first-of-type", ["A kite", "A sled"]), ("div:has(> a[href='/toy/kite']) .maker", ["Ann"]), ("#none", []),
        ("div:nth-of-type(2n+1) small", ["Ann"]), ("*:only-of-type.maker", ["Ann", "Bo"]), ("A[HREF='/toy/kite' i]", ["t"]),
    ],
)
def test_selectors(selector, expected):
    assert texts(SHELF, selector) == expected


@pytest.mark.parametrize("bad", ["", "a >", "> a", "a[", ":nope", "a::before", "a,,b", "p:nth-child(x)"])
def test_bad_selectors_raise(bad):
    with pytest.raises(SelectorError):
        compile_selector(bad)


def test_ancestors_outside_the_scope_take_part():
    d = parse("<div id=o><p><i>x</i></p></div>")
    assert texts(None, "#o i", compile_selector("p").first(d)) == ["x"]


@pytest.mark.parametrize(
    ("path", "attribute", "expected"),
    [
        ("//div[@class='toy'][2]/small", None, "Bo"), ("//a/@href", None, "/toy/kite"), ("//a[contains(@href, 'sled')]", "href", "/toy/sled"), ("//small[text()='Bo']/../span", None, "A sled"),
        ("count(//div)", None, "2"), ("//div[last()]//a[starts-with(@href,'/')]", "href", "/toy/sled"), ("//span[normalize-space(.)='A kite']/following-sibling::a", "href", "/toy/kite"),
        ("//small[. = 'Ann'] | //none", None, "Ann"), ("//none", None, None), ("//a[", None, None), ("string-length(//small)", None, "3"), ("//div[position()=2]/a", "missing", None), ("//a/ancestor::div[1]/small", None, "Ann"),
    ],
)
def test_xpath(path, attribute, expected):
    assert first_value(path, parse(SHELF).elements()[0], attribute) == expected


def test_xpath_from_an_item_sees_the_document():
    item = compile_selector(".toy:last-child").first(parse(SHELF))
    assert first_value("//small", item) == "Ann"
    assert first_value(".//small", item) == "Bo"


def test_json_ld():
    d = parse('<script type="application/ld+json">{"offers":{"price":59.90,"n":null,"t":true},"price":"x","l":[1]}</script><script type="application/ld+json">{bad</script><script type="application/ld+json">[{"b":1},{"b":"2","z":"é"}]</script>')
    blocks = structured.json_ld(d)
    assert len(blocks) == 3
    get = lambda p: structured.json_ld_value(blocks, p)
    assert [get(p) for p in ("offers.price", "offers.t", "offers.n", "l", "offers", "b", "z", "offers.price.x")] == ["59.90", "true", None, None, None, "1", "é", None]


def test_meta_maps():
    d = parse("<meta property='og:title' content='a'><meta property='og:title' content='b'><meta property='x' content='c'><meta name='d' content=''><meta name='e'>")
    assert structured.open_graph(d) == {"og:title": "b"}
    assert structured.meta_tags(d) == {"d": ""}


def test_main_content():
    body = "".join(f"<p>{'word, ' * 20}{i}</p>" for i in range(3))
    d = parse(f"<nav>{'menu ' * 99}</nav><article><header>{'h ' * 99}</header>{body}</article><footer>f</footer>")
    found = structured.main_content(d.elements()[0])
    assert found.count("\n\n") == 2 and "menu" not in found and "h h" not in found
    assert structured.main_content(parse("<div><p>short</p></div>").elements()[0]) is None
    assert structured.main_content(parse(f"<div>{'x' * 60}<a>{'y' * 60}</a></div>").elements()[0]) == "x" * 60 + "y" * 60


@pytest.mark.parametrize(
    ("html", "custom", "expected"),
    [
        ("<a rel=next href='/p/3'>n</a>", (), "http://x.example/p/3"), ("<a class='b next' href='3'>n</a>", (), "http://x.example/p/3"), ("<a rel=next href='/a'>n</a><a id=m href='/b'>n</a>", ("#m",), "http://x.example/b"),
        ("<ul class=pagination><li class=next><a href='?p=3'>n</a></ul>", (), "http://x.example/p/2?p=3"), ("<a href='/q'>n</a>", (), None), ("<a rel=next href=' '>n</a>", (), None),
    ],
)
def test_next_page(html, custom, expected):
    assert structured.next_page(parse(html), "http://x.example/p/2", *custom) == expected


@given(st.text(alphabet="<>/abp='\" \n&;!-", max_size=60))
def test_any_text_parses(html):
    d = parse(html)
    assert d.elements()[0].tag == "html"
    structured.main_content(d.elements()[0])
    list(compile_selector("p a, b > *").iter(d))


_URL_PARTS = st.lists(st.sampled_from(["/", "a", "B", ".", "..", "?", "#", "=", "&", ":", "http://", "https://", "h.example", "//", " ", "é", ";", "8", "@", "[", "%20"]), max_size=7).map("".join)


@given(st.sampled_from(["http://t.example/1", "https://T.x:80", "http://a.b?q", "HTTP://x/y", "", "/x", "http://h/a/../c;p?q#f", "http://u@h/", "http://h[/", "mailto:x"]) | _URL_PARTS, _URL_PARTS)
def test_plain_links_are_what_resolving_gives(base, href):
    from urllib.parse import urljoin, urlsplit

    try:
        out = urljoin(base, href.strip())
        parts = urlsplit(out)
        expected = out if href.strip() and parts.scheme and (parts.netloc or parts.path) else None
    except ValueError:
        expected = None
    assert structured.absolute(base, href) == expected


def test_plain_links_are_not_resolved(monkeypatch):
    monkeypatch.setattr(structured, "urljoin", None)
    assert [structured.absolute("http://t.example/1", x) for x in ("/2", " /a/b.html?c=d#e ", "https://x.example/y")] == ["http://t.example/2", "http://t.example/a/b.html?c=d#e", "https://x.example/y"]
