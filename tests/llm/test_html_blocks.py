import numpy as np

from evidra.llm.html_blocks import extract, extract_pages, main_span

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head>
<body><header><h1>Site</h1></header><nav><ul><li><a href=/a>Home</a><li>News</ul></nav><!-- <p>gone</p> --><div class="cookie-notice">We use cookies</div>
<div class=ad>Buy now</div><article class="post"><header><h1>Head &amp; tail</h1></header><p>First  paragraph\nover lines, <b>bold</b>&nbsp;text &#233;.<p>Unclosed second one of some length<br>after break
<form><input value=x>Sign up</form><aside>Side</aside><div class="sidebar-left">More</div><p>Sh.</p><table><tr><td>cell one<td>cell two</table>
<section id="comments"><article class=comment><p>I disagree with all of this long comment text that goes on.</p></article></section></article>
<div class="related-posts"><p>Other long text that should never be kept at all, whatever its length is.</p></div><footer>&copy; x</footer></body></html>"""
TEXT = "Head & tail\nFirst paragraph over lines, bold text é.\nUnclosed second one of some length\nafter break\nSh.\ncell one\ncell two"


def test_article_page():
    assert extract(PAGE) == TEXT


def test_page_without_article_mark():
    body = "".join(f"<p>Paragraph {i} with a good number of words in it to count.</p>" for i in range(5))
    menu = "".join(f"<div><a>m{i}</a></div>" for i in range(8))
    got = extract(f"<body>{menu}<div>{body}</div>{menu}</body>").split("\n")
    assert all(f"Paragraph {i}" in " ".join(got) for i in range(5)) and len(got) <= 5 + 4


def test_span_is_the_run_with_most_text():
    lengths = np.array([5, 3, 4, 80, 200, 10, 150, 4, 3, 2, 1, 60, 2, 1, 1])
    a, b = main_span(lengths)
    assert a <= 3 and 7 <= b < 12
    assert main_span(np.array([], int)) == (0, 0) and main_span(np.array([1, 2])) == (0, 2)


def test_span_decides_on_marked_pages():
    p = "<p>" + "word " * 60 + "</p>"
    intro, outro = "An introduction outside of the article that is long enough.", "And a last paragraph below the article, also of some length."
    got = extract(f"<body><main><p>{intro}</p><article>{p}{p}<p>Sh.</p></article><p>{outro}</p></main></body>").split("\n")
    assert got[0] == intro and got[-1] == outro and len(got) == 5
    small = "<article><p>A small box of an article that is not the text of this page.</p></article>"
    assert len(extract(f"<body>{small}<div>{p}{p}{p}</div></body>").split("\n")) == 4


def test_mark_moves_the_ends():
    p, short = "<p>" + "word " * 60 + "</p>", "<p>Sh.</p>" * 6
    got = extract(f"<body><div>Home</div><div>News</div><article>{short}{p}{short}</article><div>Up</div></body>").split("\n")
    assert len(got) == 13 and got[0] == got[-1] == "Sh."
    assert len(extract(f"<body><div>Home</div><div>News</div><article>{p}</article><div>Up</div></body>").split("\n")) == 1


def test_short_lines_inside_an_unmarked_article():
    p = "<p>" + "word " * 100 + "</p>"
    page = f"<body><div>Home</div><div>{p}{p}<ul><li>abc<li>de<li>fghij</ul>{p}{p}{p}</div></body>"
    assert [len(x) for x in extract(page).split("\n")][-8:] == [499, 499, 3, 2, 5, 499, 499, 499]
    talk = "".join(f"<p>No {i}.</p>" for i in range(40))
    assert len(extract(f"<body><div>{p}{talk}{p}{p}{talk}</div></body>").split("\n")) == 83
    assert len(extract(f"<body><section>{p}{p}{p}</section><ul><li>a<li>b<li>c</ul><section>{p}{p}</section></body>").split("\n")) == 8


def test_other_text_far_away_is_not_joined():
    p = "<p>" + "word " * 100 + "</p>"
    links = "".join(f"<div><a>link {i}</a></div>" for i in range(20))
    got = extract(f"<body><div>{p}{p}</div>{links}<div><p>{'Imprint and address ' * 4}</p></div></body>")
    assert "Imprint" not in got and got.count("word") == 200


def test_names_of_wrappers_do_not_drop_the_article():
    text = "word " * 60
    p = f"<p>{text}</p>"
    for page in (
        f'<body class="single comments-open"><article>{p}</article></body>',
        f'<body><main class="has-comments">{p}</main></body>',
        f'<body><div class="main has-sidebar"><article>{p}</article></div></body>',
        f'<body><div class="content no-sidebar">{p}</div></body>',
        f'<body><div class="layout-sidebar-right"><article>{p}</article><div class="sidebar">More</div></div><footer>x</footer></body>',
        f'<body><div class="row sidebar-layout">{p}</div><div class="comments">I agree.</div></body>',
        f'<body><div class="with-menu menu"><main>{p}</main></div></body>',
        f'<body><form id="aspnetForm" action="x"><div>{p}</div></form></body>',
    ):
        assert extract(page) == text.strip(), page


def test_named_regions_stay_out():
    text = "word " * 60
    card = "<article><p>" + "Other story on this site. " * 20 + "</p></article>"
    talk = '<section id="comments"><article>' + "<p>" + "I disagree with all of this. " * 40 + "</p></article></section>"
    for region in (f'<div class="related">{card}</div>', f'<div class="post-related">{card[:200]}</div>', talk, '<div class="sidebar-left">More</div>', f"<div hidden>{card}</div>"):
        assert extract(f"<body><article><p>{text}</p></article>{region}</body>") == text.strip(), region
        assert extract(f"<body><main><p>{text} <span class='ad'>Buy now</span></p>{region}</main></body>") == text.strip(), region
    assert extract(f"<body><div><p>{text}</p></div>{talk}</body>") == text.strip()
    assert extract(f'<body><article><p>Short.</p></article><div class="ad">{text}</div></body>') == "Short."
    assert extract(f'<body><div>Short.</div><div class="cookie-notice">{text}</div></body>') == "Short."


def test_broken_and_empty_pages():
    assert extract(None) == extract("") == extract("<html><body><script>x") == ""
    assert extract("plain text without any markup at all") == "plain text without any markup at all"
    assert extract("<p>a < b & c &lt;tag&gt; </p></div></span><p>next</p>") == "a < b & c <tag>\nnext"
    assert extract("<article><p>" + "x" * 300_000 + "</p></article>") == "x" * 300_000
    assert extract("<div>" * 5000 + "deep text here" + "</div>" * 5000) == "deep text here"


def test_table(spark):
    rows = [(1, "u", PAGE, 5), (2, None, None, 5), (2, None, None, 5), (None, "v", "<p>x</p>", 5)]
    out = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int"))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(((r.page_id or 0), r.text, r.n_chars) for r in out.collect()) == [(0, "x", 1), (1, TEXT, len(TEXT)), (2, "", 0), (2, "", 0)]
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_nested_and_several_articles():
    p = "<p>" + "word " * 60 + "</p>"
    nested = f"<body><nav>Home</nav><article>{p}<article>{p}<p>inner</p></article>{p}</article><footer>f</footer></body>"
    assert len(extract(nested).split("\n")) == 4
    several = f"<body><nav>Home</nav><main><article>{p}{p}</article><article>{p}<p>Sh.</p></article><article>{p}{p}</article></main><footer>f</footer></body>"
    assert len(extract(several).split("\n")) == 6


def test_surge_and_dive_against_brute_force():
    r = np.random.default_rng(4)
    for _ in range(300):
        lengths = r.choice([1, 3, 8, 15, 39, 40, 90, 300], r.integers(1, 40), p=[0.3, 0.2, 0.15, 0.1, 0.05, 0.05, 0.1, 0.05])
        n = len(lengths)
        rich = [sum(lengths[i : i + 3]) >= 40 for i in range(n)]
        spans, i = [], 0
        while i < n:
            if not rich[i]:
                i += 1
                continue
            j = i
            while j < n and rich[j]:
                j += 1
            spans.append((i, min(j + 2, n)))
            i = j
        best = max(spans, key=lambda s: sum(lengths[s[0] : s[1]]), default=(0, n))
        assert main_span(lengths) == best


def test_hostile_markup_takes_linear_time():
    import time

    start = time.perf_counter()
    for page in ('<a href="' * 40_000, "<b>" * 40_000 + "</i>" * 40_000, "<p>" * 40_000, "<div>" * 40_000 + "x", "<!--" * 40_000, "<" * 200_000, "<a " + "=" * 200_000):
        extract(page)
    assert time.perf_counter() - start < 30
    assert extract("<body><p>A paragraph with <a title=don't>one link</a> and more words, it's long enough.</p></body>").endswith("one link and more words, it's long enough.")
