"""Elements, cards and detail fields against a plain tree of the same markup."""

import random
import re
from html.parser import HTMLParser

from pyspark.sql import functions as F

from terrano.operators import elements as E, page_cards as P

PAGES = "page_id long, url string, html string"
URL = "https://www.casas.example.com/lista"


class Node:
    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.inner = tag, dict(attrs), parent, []

    def below(self):
        for x in self.inner:
            if isinstance(x, Node) and x.tag != "#comment":
                yield x
                yield from x.below()

    def pieces(self):
        for x in self.inner:
            yield from x.pieces() if isinstance(x, Node) else [x.strip()] if x.strip() else []


class Tree(HTMLParser):
    """A tree as tolerant readers make it."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#page", {}, None)
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = Node(tag, [(k, v or "") for k, v in reversed(attrs)], self.at)
        self.at.inner.append(node)
        if tag not in E.VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        x = self.at
        while x.parent and x.tag != tag:
            x = x.parent
        if x.parent:
            self.at = x.parent

    def handle_data(self, data):
        if self.at.tag not in ("script", "style"):
            if self.at.inner and isinstance(self.at.inner[-1], str):
                self.at.inner[-1] += data
            else:
                self.at.inner.append(data)

    def handle_comment(self, data):
        self.at.inner += [Node("#comment", {}, self.at)]


def around(node, marked):
    while node.parent:
        node = node.parent
        if marked(node):
            return node
    return None


def random_page(pick):
    tags, out, open_ = ["div", "p", "ul", "li", "span", "article", "b"], [], []
    for _ in range(pick.randrange(5, 60)):
        x = pick.random()
        if x < 0.45:
            tag = pick.choice(tags)
            out.append(f'<{tag} class="{pick.choice(["", "property-card x", "a property-item", "listing", "prop-card"])}">')
            open_.append(tag)
        elif x < 0.6 and open_:
            out.append(f"</{open_.pop(pick.choice([-1, -1, -1, pick.randrange(len(open_))]))}>")
        elif x < 0.7:
            out.append(f'<a href="/propiedad/{pick.randrange(1000)}-casa">Casa n&ordm; {pick.randrange(9)} &amp; más</a>')
        elif x < 0.75:
            out.append(pick.choice(["<br>", "<img src='/f.jpg'/>", "</x>", "<!-- <a href='/propiedad/1'> -->", "<script>if (a < b) '<a href=\"/propiedad/2\">'</script>", "<style>a{}</style>"]))
        else:
            out.append(pick.choice(["texto ", " ", "más de 3 amb.", "2 < 3", "USD 10.000"]))
    return "".join(out)


def test_elements_equal_a_tree(spark):
    pick = random.Random(1)
    pages = [(i, URL, random_page(pick)) for i in range(60)] + [(100, URL, None), (101, URL, ""), (102, URL, "<p>"), (103, None, "<a href=x>")]
    rows = E.elements(spark.createDataFrame(pages + pages[:3], PAGES), ["page_id", "url"])
    inner = E.innermost(rows, E.class_part("property-card", "property-item"), "card").orderBy("page_id", "start").collect()
    for i, _, html in pages:
        got, tree = [r for r in inner if r["page_id"] == i], Tree(html or "").root
        want = [tree, *tree.below()]
        number = {id(n): k for k, n in enumerate(want)}
        assert [r["tag"] for r in got] == [n.tag for n in want], html
        for r, n in zip(got, want, strict=True):
            assert r["end"] == r["start"] + 1 + len(list(n.below())) and r["class"] == n.attrs.get("class", "") and r["attrs"] == n.attrs
            assert r["path"] == sorted(number[id(m)] for m in want if n in m.below())
            if r["parts"] is not None:
                assert r["parts"] == list(n.pieces())
            card = around(n, lambda m: re.search("property-card|property-item", m.attrs.get("class", "")))
            assert r["card"] == (number[id(card)] if card else None)


def plain_links(html):
    """Of the first rung that a page has: each container's own first link (what lies in a container inside is that one's), once each."""
    tree = Tree(html).root
    for parts in P.CARD_PARTS:
        boxes = [n for n in tree.below() if any(p in n.attrs.get("class", "") for p in parts)]
        if boxes:
            break
    else:
        return []
    out = []
    for box in boxes:
        own = [n.attrs["href"] for n in box.below() if n.tag == "a" and around(n, lambda m: m in boxes) is box]
        out += own[:1]
    return list(dict.fromkeys(out))


def test_cards_keep_what_is_their_own(spark):
    pick = random.Random(2)
    pages = [(i, URL, random_page(pick)) for i in range(80)]
    got = {}
    for r in P.listing_cards(spark.createDataFrame(pages, PAGES)).where("way = 'card'").orderBy("page_id", "pos").collect():
        got.setdefault(r["page_id"], []).append(r["url"].removeprefix("https://www.casas.example.com"))
    want = {i: links for i, _, html in pages if (links := plain_links(html))}
    assert got == want and sum(len(x) > 1 for x in want.values()) > 5


def test_card_rules(spark):
    card = '<div class="property-card">%s</div>'
    pages = [
        (1, URL, card % '<a href="https://portal.example.org/inmueble/9">x</a>'),  # another site
        (2, URL, card % '<div data-href="/propiedad/77-local-en-venta"></div><span>USD 9.000 Local en venta 30 m²</span>'),  # a link in data
        (3, URL, card % "<span onclick=\"goTo('/propiedad/5-casa')\">Casa USD 1</span><strong>sin precio</strong><p>$ 500</p>"),
        (4, URL, '<article class="prop"><a href="/propiedad/1-x">A</a></article>' + (card % '<a href="/propiedad/2-y">B</a>')),  # only the first rule's
        (5, URL, "<a href='#'>a</a><a href='mailto:x'>b</a><a href='/propiedades/venta'>c</a><a href='/propiedad/12345-casa-en-venta'>Casa linda</a><a href='/propiedad/12345-casa-en-venta'>otra</a>"),
        (6, None, card % '<a href="/propiedad/2-y">B</a>'),
        (7, URL, None),
    ]
    got = {(r["page_id"], r["pos"]): r for r in P.listing_cards(spark.createDataFrame(pages, PAGES), "Rosario", "venta").collect()}
    assert sorted(got) == [(2, 1), (3, 1), (4, 1), (5, 1)]
    assert got[2, 1]["url"].endswith("/propiedad/77-local-en-venta") and (got[2, 1]["precio"], got[2, 1]["moneda"], got[2, 1]["metros"], got[2, 1]["tipo_propiedad"]) == (9000, "USD", 30, "local")
    assert got[3, 1]["url"].endswith("/propiedad/5-casa") and got[3, 1]["precio"] == 1
    assert got[4, 1]["url"].endswith("/2-y") and got[4, 1]["operacion"] == "venta"
    assert got[5, 1]["way"] == "link" and got[5, 1]["titulo"] == "Casa linda"


def test_directory_rungs(spark):
    a = '<a class="text-content-link" href="https://x.example/p">'
    pages = [
        (1, URL, f'<div class="directoryCard-module__card-container__x">{a}<h2>Norte</h2></a></div><div data-qa="agency-card"><h2>Sur</h2></div>'),
        (2, URL, '<div data-qa="agency-card"><h2>Sur</h2><img src="/LOGO.png"></div><div data-qa="realEstate-card"><h2>Este</h2></div>'),
        (3, URL, '<div data-qa="realEstate-card"><h2>Este</h2></div><div data-qa="realEstate-card"><h2>ESTE</h2></div><div data-qa="realEstate-card"><h2>A</h2></div>'),
        (4, URL, '<section><div><p><a href="/inmobiliarias/o">Oeste</a></p><h2>Oeste</h2></div></section>'),
        (5, URL, "<h2>nada</h2>"),
        (6, URL, None),
    ]
    got = sorted(tuple(r) for r in P.directory_cards(spark.createDataFrame(pages, PAGES), "https://d.example").select("page_id", "pos", "rung", "nombre", F.coalesce("perfil", F.lit("-")), F.coalesce("logo", F.lit("-"))).collect())
    assert got == [(1, 1, 0, "Norte", "https://x.example/p", "-"), (2, 1, 1, "Sur", "-", "/LOGO.png"), (3, 1, 2, "Este", "-", "-"), (4, 1, 3, "Oeste", "https://d.example/inmobiliarias/o", "-")]


def test_detail_orders_of_rules(spark):
    pages = [
        (1, URL, '<dl class="dl-horizontal"><dt>Baños</dt><dd>2</dd></dl><table><tr><td>Baños</td><td>9</td></tr><tr><td>Dormitorios</td><td>4</td></tr></table><span class="bathrooms">7</span>'),
        (2, URL, '<span class="bathrooms">7</span><span class="bathrooms">8</span>'),  # the class names rooms too: the first counts as bedrooms
        (3, URL, '<div class="features"><ul><li><b>Sup.</b><b>5</b></li><li>Superficie 120 m²</li></ul></div><p>y 80 m2</p>'),
        (4, URL, None),
    ]
    got = {r["page_id"]: r for r in P.detail_fields(spark.createDataFrame(pages, PAGES)).collect()}
    pick = lambda i, *names: tuple(got[i][n] for n in names)
    assert pick(1, "banos", "banos_rule", "dormitorios", "dormitorios_rule") == (2, "dl", 4, "table")
    assert pick(2, "dormitorios", "dormitorios_rule", "banos", "banos_rule") == (7, "class", 8, "class")
    assert pick(3, "metros", "metros_rule") == (120, "li_text")
    assert pick(4, "titulo", "precio", "metros", "barrio") == (None, None, None, "Argentina") and len(got) == 4
