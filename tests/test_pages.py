from pyspark.sql import functions as F

from tradebook.operators import markup
from tradebook.operators import pages as P

HOME = '<html><body><a class=x href="/shop">s</a><a href="Contact-us.html?x=1&amp;y=2">Contact</a></body></html>'
CONTACT = '<body><div class="contact-info box"><b>123 Main St,</b><br> Troy, NY 12180</div></body>'
NESTED = '<div class="business-location"><span></span><p>9 Elm St<br>Troy</p></div>'
ATTR = '<section data-address="5 Oak Ave, Albany">x</section>'
BROKEN = '<div><p class="address">77 Pine Rd<div></p><address>8 Low St\nTroy, NY 12180</div>'


def frame(spark, *rows):
    return spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(rows)], "page_id bigint, url string, html string")


def test_contact_page(spark):
    df = frame(spark, ("https://a.example/x/", HOME), ("https://a.example/x/Contact-us.html?x=1&y=2", CONTACT), ("https://b.example", HOME))
    rows = P.from_contact_pages(df).collect()
    assert [(r["page_id"], r["raw_address"], r["street"], r["city"], r["zip_code"], r["confidence"]) for r in rows] \
        == [(0, "123 Main St,Troy, NY 12180", "123 Main St", "Troy", "12180", 0.8)]


def test_unusual_markup_is_read_alike(spark):
    """No white space before an attribute, ">" in a quoted value, unquoted and coded values."""
    targets = {"/c": '<p id="x"class="address">1 Elm St, Troy, NY 12180</p>', "/d": '<p title="a>b"class=address>1 Elm St&#44; Troy&#x2C; NY 12180</p>',
               "/e": '<p class="&#97;ddress">1 Elm St, Troy, NY 12180</p>'}
    links = ['<a id="y"href="/contact{}">x</a>', "<a title='>' href=/contact{}>x</a>", '<a href="/cont&#97;ct{}">x</a>']
    rows = [(f"https://s.example/contact{k}", v) for k, v in targets.items()]
    rows += [("https://s.example/", links[k].format(t)) for k, t in enumerate(targets)]
    got = {r["page_id"]: r["raw_address"] for r in P.from_contact_pages(frame(spark, *rows)).collect()}
    assert got == {k: "1 Elm St, Troy, NY 12180" for k in (3, 4, 5)}


def test_flags_on_unusual_markup(spark):
    walls = ['<div a="1"id="challenge-form">', '<iframe title="a>b"src="x/challenges">', "<p x='y'data-translate=challenge >", '<b class=cf-x>', "<p>"]
    df = frame(spark, *[("u", h) for h in walls])
    assert [r["is_challenge"] for r in P.flag_challenge_pages(df).orderBy("page_id").collect()] == [True, True, True, True, False]
    boxes = ['<div id="a"class="x search-results">', "<li class=result-item>", '<a t="a>b"class="card">', '<b class="card">', '<i class="search-resultsx">']
    df = frame(spark, *[("u", h) for h in boxes])
    assert [r["no_results"] for r in P.flag_no_results(df).orderBy("page_id").collect()] == [False, False, False, True, True]


def test_coded_text(spark):
    df = spark.createDataFrame([(0, "u", "<p>Caf&eacute; Nord</p>\n<p>9 Oak St&#44; Troy&#x2C; NY 12180</p>", "Café Nord")], "page_id bigint, url string, html string, business_name string")
    assert [(r["street"], r["zip_code"]) for r in P.from_text(df).collect()] == [("9 Oak St", "12180")]
    meta = frame(spark, ("u", '<meta a="x>y"property="og:street-address"content="9 Oak St&#44; Troy, NY 12180">'))
    assert P.from_meta_tags(meta).first()["street"] == "9 Oak St"


def test_selectors(spark):
    df = frame(spark, ("a", NESTED), ("b", ATTR), ("c", BROKEN), ("d", "<p>none</p>"), ("e", "<address>me@x.org</address><li title='3 Way'>"))
    got = {r["page_id"]: r["address"] for r in P.from_selectors(df, P.fixed.REVIEW_SELECTORS + ["li"]).collect()}
    assert got == {0: "9 Elm St, Troy", 1: "5 Oak Ave, Albany", 2: "8 Low St Troy, NY 12180", 4: "3 Way"}
    directory = {r["page_id"]: r["address"] for r in P.from_selectors(
        frame(spark, ("a", '<address class="a card-text">1 Elm St</address>'), ("b", ATTR)), P.fixed.DIRECTORY_SELECTORS, (), False).collect()}
    assert directory == {0: "1 Elm St"}


def test_selector_kinds(spark):
    page = frame(spark, ("u", '<ul id=u><li class="a b"><b>x</b></li><li data-k="vw">y</li></ul>'))
    parsed = markup.with_elements(page, F.lit(True), ["page_id"])

    def texts(s):
        return parsed.select(F.transform(markup.selected(s), markup.joined_text)).first()[0]
    assert texts("ul > li.b") == ["x"] and texts("ul b") == ["x"] and texts("ul > b") == []
    assert texts("[data-k*='v']") == ["y"] and texts("#u li") == ["x", "y"] and texts("li[data-k]") == ["y"]


def test_element_table(spark):
    """Intervals, texts and links of damaged markup; pages that are not asked for stay as nulls."""
    html = '<div a=1 a=2>t<p>u<br>v</div>w</p><script>no</script><b>  x\n y </b><a href="/z?q=1">l<li>m'
    page = frame(spark, ("https://h.example/d/", html), ("v", None), ("w", ""))
    rows = markup.with_elements(page, F.col("page_id") < 2, ["page_id"]).orderBy("page_id").collect()
    nodes = {n["pre"]: n for n in rows[0]["nodes"]}
    assert [(n["tag"], n["last"], n["up"]) for n in nodes.values()] \
        == [("div", 2, -1), ("p", 2, 0), ("br", 2, 1), ("script", 3, -1), ("b", 4, -1), ("a", 6, -1), ("li", 6, 5)]
    assert nodes[0]["attrs"] == {"a": "1"} and nodes[5]["link"] == "https://h.example/z?q=1"
    assert (rows[1]["nodes"], rows[2]["nodes"]) == (None, None)
    shown = markup.with_elements(page.filter("page_id = 0"), F.lit(True), ["page_id"]).select(
        F.transform("nodes", markup.shown_text), F.transform("nodes", markup.joined_text)).first()
    assert shown[0] == ["t\nu\nv", "u\nv", "", "no", "x y", "l\nm", "m"] and shown[1][0] == "tuv" and shown[1][4] == "x\n y"


def test_class_patterns(spark):
    df = frame(spark, ("a", '<footer><address>1 St <i>NY</i></address></footer><div id="my-location">L</div>'))
    got = {(r["pattern"], r["text"]) for r in P.from_class_patterns(df).collect()}
    assert got == {(4, "L"), (5, "1 St NY"), (12, "1 St NY")}


def test_json_ld_shapes(spark):
    def page(body):
        return "u", f'<script type="application/ld+json">{body}</script>'
    df = frame(spark, page('[{"address": {"streetAddress": "1"}}]'), page('{"location": {"address": {"streetAddress": "2", "postalCode": "3"}}}'),
               page('{"address": "text", "location": {"address": {"streetAddress": "4"}}}'), page("{broken"),
               ("u", '<script type="application/ld+json">{}</script><SCRIPT type="application/ld+json">{"address": {"streetAddress": "5"}}</SCRIPT>'))
    assert {r["page_id"]: r["raw_address"] for r in P.from_json_ld(df).collect()} \
        == {1: "2, None, None 3", 4: "5, None, None None"}


def test_meta_order_and_quotes(spark):
    df = frame(spark, ("u", '<meta content="x" name="y"><meta property="og:street-address" content=\'9 Oak Ave, Troy, NY 12180\'>'
                            '<meta content="1 A St, B, NY 10001" property="place:location:address">'),
               ("u", '<meta property="og:street-address"><meta property="business:contact_data:street_address" content="2 B St, C, NY 10001">'))
    assert {r["page_id"]: r["street"] for r in P.from_meta_tags(df).collect()} == {0: "1 A St", 1: "2 B St"}


def test_text_near_name(spark):
    html = "<body>intro\n<p>ACME one</p>\nx\n1 Far St, Troy, NY 12180\n<script>acme\n9 No St, X, NY 10001</script>y\nz\nw\nAcme\n</body>"
    df = frame(spark, ("u", html)).selectExpr("*", "'acme' AS business_name")
    row = P.from_text(df).first()
    assert (row["street"], row["city"], row["confidence"]) == ("1 Far St", "Troy", 0.75)
    assert row["raw_address"] == "intro ACME one x 1 Far St, Troy, NY 12180"


def test_cascade_order(spark):
    ld = '<script type="application/ld+json">{"address": {"streetAddress": "1 Ld St"}}</script>'
    meta = '<meta property="og:street-address" content="2 Meta St, Troy, NY 12180">'
    df = frame(spark, ("u", ld + meta), ("v", meta), ("https://a.example/x/", HOME), ("https://a.example/x/Contact-us.html?x=1&y=2", CONTACT), ("w", "acme")) \
        .selectExpr("*", "'acme' AS business_name")
    assert {r["page_id"]: (r["source"], r["street"]) for r in P.extract_cascade(df).collect()} \
        == {0: ("structured_data", "1 Ld St"), 1: ("meta_tags", "2 Meta St"), 2: ("contact_page", "123 Main St")}


def test_page_flags(spark):
    df = frame(spark, ("https://x/captcha", "a"), ("u", "Just a MOMENT"), ("u", '<div id="cf-content">'), ("u", '<p class="a cf-box">'), ("u", "<p>fine</p>"))
    assert [r["is_challenge"] for r in P.flag_challenge_pages(df).orderBy("page_id").collect()] == [True] * 4 + [False]
    df = frame(spark, ("u", '<div class="search-results-x">'), ("u", '<div class="a search-results">'), ("u", "<a class='card'>"), ("u", '<div class="search-results">0 results'))
    assert [r["no_results"] for r in P.flag_no_results(df).orderBy("page_id").collect()] == [True, False, False, True]


def test_markup_is_parsed_in_portions():
    """Portions are bounded by bytes and rows, hold every row once and keep the order."""
    import pyarrow as pa

    from tradebook.operators import markup
    html = ["x" * 700_000, None, "y" * 700_000, "z" * 3_000_000, ""] + ["p"] * 2500
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(len(html))), "_html": pa.array(html, pa.string())})
    parts = list(markup._portions(batch))
    assert [i for p in parts for i in p.column("page_id").to_pylist()] == list(range(len(html)))
    assert max(p.num_rows for p in parts) <= markup.PORTION_ROWS
    assert all(p.num_rows == 1 or sum(len(h or "") for h in p.column("_html").to_pylist()) <= markup.PORTION_BYTES for p in parts)
    assert not list(markup._portions(batch.slice(0, 0)))
