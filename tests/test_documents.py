from corpusmill.operators import chunking, crawl, html

GOLDEN = "<html><head><title>t</title></head><body><nav>menu</nav><h1>Title</h1><p>Intro &amp; more</p><h2>Section A</h2><p>Text <b>bold</b> tail</p><table><tr><th>A</th><th>B</th></tr><tr><td>C</td><td>D</td></tr></table><p>after</p><pre>x = 1\n  y</pre><footer>foot</footer></body></html>"


def pages(spark, *texts):
    return spark.createDataFrame([(i, f"http://h.example/{i}", t) for i, t in enumerate(texts)], "page_id long, url string, html string")


def rows(df, *columns, order=("page_id", "block_no")):
    return [tuple(r[c] for c in columns) for r in df.orderBy(*order).collect()]


def test_blocks(spark):
    found = rows(html.extract(pages(spark, GOLDEN)), "type", "text", "section_path")
    assert found == [
        ("text", "Title", ["Title"]), ("text", "Intro & more", ["Title"]), ("text", "Section A", ["Title", "Section A"]), ("text", "Text", ["Title", "Section A"]), ("text", "bold", ["Title", "Section A"]), ("text", "tail", ["Title", "Section A"]),
        ("table_placeholder", "", ["Title", "Section A"]), ("text", "after", ["Title", "Section A"]), ("text", "x = 1\n  y", ["Title", "Section A"]),
    ]


def test_tables_steps_figures_images_links(spark):
    text = '<h1>T</h1><ol><li>one</li><li>two</li></ol><figure><img src="a.png"><figcaption>cap</figcaption></figure><img src="data:image/png;base64,QUJD"><a href="/x">go</a>'
    p = pages(spark, GOLDEN, text)
    assert rows(html.extract(p, tables_as_text=True).where("type = 'table_text'"), "text", "table_id") == [("A\tB\nC\tD", 0)]
    assert rows(html.extract(p.where("page_id = 1"), mode="typed").where("type = 'text'"), "kind", "text")[:3] == [("title", "T"), ("step", "one"), ("step", "two")]
    assert [tuple(r) for r in html.figures(p).select("src", "caption").collect()] == [("a.png", "cap")]
    assert [r["n_bytes"] for r in html.inline_images(p).collect()] == [3]
    assert [tuple(r) for r in html.links(p).select("link_no", "href").collect()] == [(0, "/x")]


def test_paragraphs_pad_levels(spark):
    p = pages(spark, "<h1>A</h1><h3>C</h3><p>x</p>", None, "")
    assert [(r["section_path"], r["text"]) for r in html.paragraphs(p).collect()] == [(["A", "", "C"], "x")]


def blocks(spark, *items):
    schema = "doc_id long, block_no int, text string, type string, page int, section_path array<string>, kind string, file_path string, meta map<string,string>"
    return spark.createDataFrame([(1, i, *x) for i, x in enumerate(items)], schema)


def test_pack_by_section(spark):
    b = blocks(spark, ("a b", "text", 1, ["S"], None, "f", None), ("c d", "text", 1, ["S"], None, "f", None), ("e", "text", 2, ["S"], None, "f", None), ("", "table_placeholder", 2, ["S"], None, "f", None), ("g", "text", 2, ["T"], None, "f", None))
    assert rows(chunking.pack_by_section(b, 3), "type", "text", order=("order",)) == [("text", "a b\nc d"), ("text", "e"), ("table_placeholder", None), ("text", "g")]


def test_pack_by_layout(spark):
    b = blocks(spark, ("Intro", "text", 1, [], "title", "f", None), ("Step 1", "text", 1, [], "step", "f", None), ("details", "text", 1, [], None, "f", None), ("a b\nc d", "table_text", 1, [], None, "f", None), ("rest", "text", 1, [], None, "f", None), ("Step 2", "text", 1, [], "step", "f", None), ("other", "text", 1, [], None, "g", None))
    assert rows(chunking.pack_by_layout(b, 3), "text", "step_id", order=("order",)) == [("Intro", None), ("Step 1\ndetails", 1), ("a b", 1), ("c d", 1), ("rest", 1), ("Step 2", 2), ("other", None)]


def test_crawl(spark):
    web = {"/": ["/a", "/b", "http://else.example/"], "/a": ["/c", "/"], "/b": ["/c"], "/c": ["/d"], "/d": []}
    p = spark.createDataFrame([(i, f"http://h.example{u}", "".join(f'<a href="{x}">.</a>' for x in links)) for i, (u, links) in enumerate(web.items())], "page_id long, url string, html string")
    found = crawl.reachable(p, html.links(p), "http://h.example/", max_depth=2)
    assert [(r["url"][len("http://h.example") :], r["depth"]) for r in found.orderBy("seq").collect()] == [("/", 0), ("/a", 1), ("/b", 1), ("/c", 2)]
    assert crawl.reachable(p, html.links(p), "http://h.example/", max_pages=2).count() == 2
