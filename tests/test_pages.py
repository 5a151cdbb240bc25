"""Pages read as plain markup against the standard parser, and how they are dealt out."""

import gc
import random

from proplytics.operators import extract
from proplytics.sources import pages

PIECES = ["<div>", "</div>", "<p>", "</p>", "<br/>", "<td>", "</td>", "<tr>", "<th>", "<dl><dt>a</dt><dd>b</dd>", "<dt>", "<dd>", "x & y", "&amp;", "&lt", "a > b", "< b", "<!-- c -->", "<!--x-->", "<!DOCTYPE html>",
          "<script>if (a && b) {}</script>", '<script>t="</p>";</script>', "<script>a<b</script>", "<script>", "</script>", "<script>x</p </script>", "<style>p{}</style>", '<a href="/x?a=1&copy=2" class=\'price t\'>l</a>',
          "<a href=foo>", "<input disabled>", '<input name="n" value="3"/>', "<title>a &amp; b</title>", '<img data-src="i&quot;.png" />', '<span class="price"/>', "</span>", '<TABLE CLASS="Q">', "<?pi?>", "\0", "<b", '<a title="a>b">', "日本"]


def shape(node):
    return node.tag, node.attrs, node.start, node.end, node.text(" "), [k.tag for k in node.kids if isinstance(k, pages.Node)]


def test_plain_markup_is_read_as_the_standard_parser_does(spark, monkeypatch):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 15))) for _ in range(4000)]
    plain = [pages._plain_tree(t) is not None for t in texts]
    quick = [[shape(n) for n in pages.tree(t).page if n.tag != "script"] for t in texts]
    monkeypatch.setattr(pages, "_plain_tree", lambda html: None)
    assert quick == [[shape(n) for n in pages.tree(t).page if n.tag != "script"] for t in texts]
    assert 500 < sum(plain) < 3900


def test_pages_of_one_file_are_read_by_all_cores(spark):
    rows = [(i, extract.SOURCES[i % 5], "u", "detail", f"<table><tr><th>価格</th><td>{i}万円</td></tr></table>") for i in range(100)] + [(None, "suumo", None, "detail", None)]
    one = spark.createDataFrame(rows, "page_id long, source string, url string, kind string, html string").coalesce(1)
    raw = pages.raw_material(one, "pairs")
    assert set(raw.columns) == {*pages.KEYS, "pairs"}
    assert raw.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    got = {(r.page_id, r.pairs.get("価格")) for r in raw.collect()}
    assert got == {(i, f"{i}万円") for i in range(100)} | {(None, None)}


DETAIL = (
    '<html><head><title>t</title><script type="application/ld+json">{"offers":{"price":"5000000"},"address":"長野県松本市中央1","geo":{"latitude":"36.5","longitude":137.5},"image":["https://x/ld.jpg"]}</script></head>'
    '<body><h1>物件 一</h1><p>令和6年(ケ)第1号</p><table><tr><th>価格</th><td>300万円</td></tr><tr><th>裁判所名</th><td>長野地裁</td></tr><tr><th>備考</th><td>再建築不可</td></tr><tr><th>階数</th><td>2階</td></tr></table>'
    '<dl><dt>所在地</dt><dd>長野県松本市1</dd></dl><script>var m = {lat: 36.25, lng: 138.25}; if (a < b) {}</script><iframe src="https://maps.google.com/maps?q=36.75,138.5"></iframe><span data-lat="36.1" data-lng="138.1"></span>'
    '<img src="https://img.suumo.jp/a.jpg"><img src="https://homes.co.jp/b.jpg"><img data-src="https://img.athome.co.jp/c.jpg"/><img src="/img/akiya.jpg"><div style="background-image: url(&quot;https://bg/1.png&quot;)"></div>'
    '<a href="/x.pdf">書</a><p class="price">450万円</p></body></html>')


def test_listings_of_some_columns_are_those_of_all(spark):
    odd = [DETAIL, DETAIL.replace("<table>", "<table class=x y=1>"), DETAIL.replace("<dl>", "<!--x--><dl>"), DETAIL.replace("価格", "他"), "", None, "<p>", "<script>lat: 1.5, lng: 2.5"]
    rows = [(i, s, f"https://p/kodate/{10000 + i}/", "detail", html) for s in extract.SOURCES for i, html in enumerate(odd)]
    some = spark.createDataFrame(rows, "page_id long, source string, url string, kind string, html string")
    key = ["page_id", "source"]
    whole = {(r.page_id, r.source): r for r in extract.extract_details(some).collect()}
    assert len(whole) == len(rows)
    columns = [c for c in next(iter(whole.values())).asDict() if c not in key]
    groups = [["title", "floors", "price"], ["image_urls", "latitude"], ["address", "prefecture", "floor_plan", "rebuild_possible"]]
    for names in groups:
        for r in extract.extract_details(some, *key, *names).collect():
            assert [r[c] for c in names] == [whole[r.page_id, r.source][c] for c in names], (r.page_id, r.source, names)
    assert set(extract.NEEDS) <= {*key, *columns}
    # only what the columns need is read: coordinates and images need no tree
    assert all(set(extract.detail_fields(s, ["latitude", "image_urls"])) <= pages.FLAT for s in extract.SOURCES)


def test_single_elements_are_found_without_the_tree():
    rnd = random.Random(7)
    flat = set(pages.FLAT)
    texts = ["".join(rnd.choice([*PIECES, DETAIL]) for _ in range(rnd.randint(0, 12))) for _ in range(600)]
    for text in texts:
        for source in extract.SOURCES:
            spec = pages.SPECS[source]
            quick = pages._material(pages.tree(text, True), source, spec, False, flat)
            assert quick == pages._material(pages.tree(text), source, spec, False, flat), text


def test_an_element_is_looked_for_once_a_page(monkeypatch):
    calls, fits = [], pages._those_that_fit
    monkeypatch.setattr(pages, "_those_that_fit", lambda nodes, step: calls.append(step) or fits(nodes, step))
    card = '<div class="property-card"><a href="/kodate/12345/">x</a><span class="kakaku">5万円</span></div>'
    found = list(pages._rows(1, "athome", "u", "search", card * 50, {"link", "prices", "addresses"}))
    assert [r["prices"] for r in found] == [["5万円"]] * 50 and found[49]["link"] == "/kodate/12345/"
    assert len(calls) < 30


def test_single_elements_of_a_simple_page_need_no_look_at_each_tag(monkeypatch):
    flat, simple = set(pages.FLAT), DETAIL.replace("a < b", "a <= b").replace("</body>", "<!-- c --><IMG SRC='/img/photo.jpg'><input name=\"gyosei_cd[]\" value='2'></body>")
    whole = {s: pages._material(pages.tree(simple), s, pages.SPECS[s], False, flat) for s in extract.SOURCES}
    monkeypatch.setattr(pages, "_plain_tree", lambda html, flat=False: 1 / 0)
    assert {s: pages._material(pages.tree(simple, True), s, pages.SPECS[s], False, flat) for s in extract.SOURCES} == whole
    assert whole["suumo"]["inputs"] == ["2"] and len(whole["bit"]["images"]) == 5


def test_selectors_that_a_page_cannot_fit_are_not_looked_for(monkeypatch):
    calls, looks = [], pages.Page.that_may_fit
    monkeypatch.setattr(pages.Page, "that_may_fit", lambda page, step: calls.append(step) or looks(page, step))
    card = '<div class="property-card"><a href="/kodate/12345/">x</a><span class="%s">5万円</span></div>'
    fields = {"link", "titles", "prices", "addresses"}
    plain = [list(pages._rows(1, "athome", "u", "search", card % "kakaku", fields)), len(calls)]
    calls.clear()
    escaped = [list(pages._rows(1, "athome", "u", "search", card % "kak&#97;ku", fields)), len(calls)]
    assert plain[0] == escaped[0] and plain[0][0]["prices"] == ["5万円"]
    assert plain[1] < escaped[1] / 2


def test_elements_do_not_wait_for_the_collector():
    def nodes():
        return sum(isinstance(o, pages.Node) for o in gc.get_objects())

    gc.collect()
    before = nodes()
    gc.disable()
    try:
        list(pages._rows(1, "suumo", "u", "detail", DETAIL, {"pairs", "titles"}))
        assert nodes() <= before
    finally:
        gc.enable()
