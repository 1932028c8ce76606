"""Wrappers over all pages of a host: templates, constant texts and blocks with a listed class."""

from codeloom.llm.wrappers import extract_pages

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def body(i, n):
    return " ".join(f"{w}{i}" for w in WORDS[:n])


def texts(spark, pages):
    df = spark.createDataFrame([(i, "http://h.example/x", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in extract_pages(df).collect()}


def test_constant_texts_go_and_varying_blocks_stay_whatever_their_class(spark):
    pages = [
        f'<body><article><header class="entry-header"><h1>Title {i}</h1></header><p>Read our terms</p><p class="notice">Note {i}</p>'
        f'<div class="lead"><b>By</b> author {i}</div><h2 class="section-header">Part {body(i, 2)}</h2><div class="text">{body(i, 9)}</div><div class="ad">Buy this</div></article></body>'
        for i in range(6)
    ]
    got = texts(spark, pages)
    for i in range(6):
        assert got[i] == f"Title {i}\nNote {i}\nBy author {i}\nPart {body(i, 2)}\n{body(i, 9)}"
    one = texts(spark, pages[:1])
    assert "Read our terms" in one[0] and "Buy this" not in one[0]


def test_each_template_of_a_host_has_its_wrapper(spark):
    first = [f'<body><div class="top">x{i}</div><div class="content"><p>{body(i, 9)}</p></div></body>' for i in range(200)]
    second = [f'<body><div class="content"><p>Teaser {i}</p></div><div class="story"><h1>Story {i}</h1><p>{body(i, 10)}</p><p>more {body(i, 8)}</p></div></body>' for i in range(200, 203)]
    got = texts(spark, first + second)
    for i in range(200):
        assert got[i] == body(i, 9)
    for i in range(200, 203):
        assert got[i] == f"Story {i}\n{body(i, 10)}\nmore {body(i, 8)}"


def test_a_heading_of_the_article_stays_and_that_of_links_goes(spark):
    pages = [f'<body><article><h1>Title {i}</h1><h2>Summary</h2><div>{body(i, 9)}</div><h2>Related</h2><div><a href="/x">see {i}</a></div></article></body>' for i in range(4)]
    got = texts(spark, pages)
    for i in range(4):
        assert got[i].startswith(f"Title {i}\nSummary\n{body(i, 9)}") and "Related" not in got[i]


def test_quotes_that_are_not_closed(spark):
    got = texts(spark, ['<body><article><p title="x>one</p><p class="y">two</p><p title=\'it\'s>three</p><p title="a<b">four</p><p title="a > b">five</p></article></body>'])
    assert got[0] == "one\ntwo\nthree\nfour\nfive"


def test_pages_keep_columns_of_any_name_and_odd_rows(spark):
    rows = [(1, "http://h.example/", "<body><p>one</p></body>"), (1, "http://h.example/", "<body><p>one</p></body>"), (2, None, None), (None, "", ""), (3, "x", f"<body><p>{'long ' * 40000}</p></body>")]
    df = spark.createDataFrame([(*r, 7, "k", True, "s") for r in rows], "page_id long, url string, html string, __host int, container string, drop boolean, text string")
    got = extract_pages(df)
    assert got.columns == ["page_id", "url", "html", "__host", "container", "drop", "text"]
    found = got.collect()
    assert len(found) == 5 and {(r["__host"], r.container, r["drop"]) for r in found} == {(7, "k", True)}
    assert sorted((r.page_id or 0, len(r.text)) for r in found) == [(0, 0), (1, 3), (1, 3), (2, 0), (3, 5 * 40000 - 1)]
    assert extract_pages(df.limit(0)).count() == 0
