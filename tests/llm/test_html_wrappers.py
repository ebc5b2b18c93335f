"""Main text of pages: what is kept whatever its links, copies, shares of template and sizes are."""

import random

from tercet.llm import html_extract


def test_links_do_not_remove_text():
    menu = "<nav>" + "".join(f"<a href=/{k}>Section number {k:03}</a>" for k in range(40)) + "</nav>"
    page = f"<body><div id=page>{menu}<div><div>{'Some words of a post. ' * 20}</div></div></div></body>"
    assert html_extract.extract_group([page]) == [("Some words of a post. " * 20).strip()]
    assert html_extract.extract_group(["<p>See <a href=/x>the long report on everything that happened</a>.</p>"]) == ["See the long report on everything that happened."]


def test_two_pages_of_a_host_are_aligned():
    pages = [f"<body><div>All rights reserved here</div><div><p>Story {k} {word * 30}</p></div></body>" for k, word in ((1, "one "), (2, "two "))]
    assert html_extract.extract_group(pages) == [f"Story 1 {'one ' * 30}".strip(), f"Story 2 {'two ' * 30}".strip()]


def test_much_template_and_short_text():
    pages = [f"<body><div><span>Always the same line</span></div><div><p>Story {k} {'word ' * k}</p></div><div>Call us at any time today</div></body>" for k in range(1, 8)]
    assert html_extract.extract_group(pages) == [f"Story {k} {'word ' * k}".strip() for k in range(1, 8)]


def test_near_copies_keep_their_text():
    """Copies that differ in a date are most of the pages; the text that they share is no template."""
    text = [f"A long text of page {k}: {chr(97 + k) * 80}." for k in range(6)]
    pages = [f"<body><div><i>Menu of the site</i></div><div><p>{text[k]}</p></div><div><b>{d}</b></div></body>" for k, d in [(0, x) for x in range(9)] + [(k, k + 20) for k in range(1, 6)]]
    assert html_extract.extract_group(pages) == [f"{text[k]}\n{d}" for k, d in [(0, x) for x in range(9)] + [(k, k + 20) for k in range(1, 6)]]
    assert html_extract.extract_group(pages[:2]) == [f"Menu of the site\n{text[0]}\n{d}" for d in (0, 1)]


def test_long_lists_are_aligned_exactly():
    """Lists of over 300 children; the notices stand after additional ones and are found."""
    pages = [f"<body>{''.join(f'<p>Own text {k} of {c}</p>' for c in range(150 + k))}<p>Always the same notice</p>{''.join(f'<p>More text {k} of {c}</p>' for c in range(150))}</body>" for k in range(8)]
    got = html_extract.extract_group(pages)
    assert all("notice" not in t for t in got)
    assert [t.count("\n") for t in got] == [299 + k for k in range(8)]


def test_matches_are_the_largest():
    """Against the table of all pairs, for lists on both sides of the vectorised form."""
    rng = random.Random(6)

    def brute(a, b):
        if a.label != b.label:
            return 0
        best = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
        for i, x in enumerate(a.kids):
            for j, y in enumerate(b.kids):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + brute(x, y))
        return 1 + best[-1][-1]

    def tree(n, levels):
        return "".join(f"<{t} class={rng.choice('cd')}>{tree(rng.randint(0, 4), levels - 1) if levels else rng.randint(0, 2)}</{t}>" for t in (rng.choice(("div", "section")) for _ in range(n)))

    for n in (0, 1, 3, 7, 70, 90):
        for _ in range(4):
            a, b = html_extract.parse(tree(n, 2)), html_extract.parse(tree(rng.randint(n // 2, n + 5), 2))
            pairs = []
            assert html_extract.align(a, b, pairs) == len(pairs) == brute(a, b)
            assert len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == len(pairs) and all(x.label == y.label for x, y in pairs)


def test_deep_elements_keep_their_marks():
    for n in (200, 5000):
        page = f"<article><p>one</p>{'<div>' * n}<p>deep</p><div class=sidebar>no</div><div>two</div>{'</div>' * n}<p>three</p></article><p>outside</p>"
        assert html_extract.extract_group([page, page + " "]) == ["one\ndeep\ntwo\nthree"] * 2


def test_copies_do_not_switch_the_wrapper_off(spark, monkeypatch):
    """A page with many copies fills whole groups of rows, but stands once among a host's distinct pages."""
    monkeypatch.setattr(html_extract, "GROUP", 6)
    shape = "<body><div>Call us at any time today</div><div><p>{}</p></div></body>"
    story = [f"Story {k} {chr(97 + k) * (50 + k)}" for k in range(9)]
    rows = [(k, f"http://a.b/{k}", shape.format(story[0])) for k in range(60)] + [(100 + k, f"http://a.b/{k}", shape.format(story[k % 9])) for k in range(18)]
    rows += [(None, None, None), (7, "http://c.d/", shape.format("alone"))]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    want = [(k, f"http://a.b/{k}", story[0]) for k in range(60)] + [(100 + k, f"http://a.b/{k}", story[k % 9]) for k in range(18)]
    want += [(None, None, ""), (7, "http://c.d/", "Call us at any time today\nalone")]
    assert sorted((str(r.page_id), str(r.url), r.text, r.n_chars) for r in got) == sorted((str(i), str(u), x, len(x)) for i, u, x in want)
