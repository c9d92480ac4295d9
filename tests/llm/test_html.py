import random
from collections import defaultdict

import numpy as np

from tidewater.llm.html import DROPPED, MAIN, OTHER, Title, blocks_of, host_texts, main_texts, repeated_runs

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p><b>";</script></head><body class="comments-open">
<header class=site-header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>no</p> --><div class="cookie-notice"><div>We use
<p>cookies</div></div><main><article><header><h1>A &amp; B</h1></header><p>One  two&nbsp;three<br>four<p>f<b>iv</b>e &lt;x&gt; &#233; caf&eacute;
<aside>side</aside><form><p>mail</p><input name=q></form><figure><figcaption>cap</figcaption></figure><noscript>js</noscript>
<div id="ad-top" data-x="a>b">buy</div><div style="display: none">hid</div><ul><li>item</li></ul></article>
<section id=comments><p>First!</p></section></main><div class=sidebar>s</div><footer>&copy; me</footer></body></html>"""


def test_parts_of_a_page():
    assert blocks_of(PAGE) == [(MAIN, t) for t in ("A & B", "One two three", "four", "five <x> é café", "cap", "item")]
    assert host_texts([blocks_of(PAGE)]) == ["A & B One two three four five <x> é café cap item"]


def test_broken_markup():
    assert host_texts([blocks_of(x) for x in ("", "plain", "<p>a", "a < b & c", "<article>x", "</div></p>y", "<script>z", "<!-- z", "<p title='a>b'>q</p>")]) == [
        "", "plain", "a", "a < b & c", "x", "y", "", "", "q"]
    assert blocks_of("<div><p>a</article>b</div>c") == [(OTHER, "a"), (OTHER, "b"), (OTHER, "c")]
    assert DROPPED not in {p for p, _ in blocks_of(PAGE)}


def test_elements_named_like_raw_ones():
    def text(page):
        return host_texts([blocks_of(page)])[0]

    for name in ("svg-icon", "video-player", "select-menu", "title-bar", "script-x"):
        assert text(f'<p>a</p><{name} name="x"></{name}><p>kept</p>') == "a kept"
    assert text('<p>a</p><svg class="i"/><p>b</p><math/><p>c</p><svg><text>no</text></svg><p>d') == "a b c d"
    # without an end tag only the start tag goes, but a script has no text
    for name in ("video src=x", "iframe", "canvas", "select", "noscript", "svg"):
        assert text(f"<p>a</p><{name}><p>kept</p>") == "a kept"
    assert text("<p>a</p><script>no<p>no</p>") == text("<p>a<STYLE media='x>y'>no</style >") == text("<p>a<script>no</script x>") == "a"
    assert text("<video>" * 20_000 + "x") == "x"


def test_articles_are_not_left_out_by_a_name():
    def text(page):
        return host_texts([blocks_of(page)])[0]

    story = "<article><p>story</p></article>"
    for name in ("has-sidebar", "no-sidebar", "category-social", "comments-open", "tag-promo", "content-sidebar-wrap"):
        assert text(f'<div class="x {name}"><p>story</p></div>') == text(f'<article id={name}><p>story</article>') == "story"
    for name in ("ad", "post sponsored", "site-notice"):
        assert text(f'<main class="{name}"><p>story</p></main>') == text(f'<div class="{name}">no{story}no</div>') == "story"
        assert text(f'<p>own</p><div class="{name}"><p>no</p></div>') == "own"
    # forms around the page, and elements that are never closed
    assert text(f"<form action=x>{story}<form><p>mail</p></form></form>") == "story"
    assert text('<form method=post><input type=hidden name="__VIEWSTATE"><div><p>a</p></div></form>') == "a"
    assert text(f"<div><nav><a>no</a>{story}</div>") == text(f"<div><div class=ad>no{story}</div>") == "story"
    assert text(f"<head><title>no</title><body><p>story") == "story"
    # but what is closed, a remark or hidden
    for around in ("<aside>{}</aside>", "<div class=comments>{}</div>", "<div hidden>{}</div>", "<div style='display:none'>{}"):
        assert text(story + around.format("<article>no</article>")) == "story"
        assert text("<p>own</p>" + around.format("<article>no</article>")) == "own"
    assert text("<p>own</p><div class=promo><article>more</article></div>") == "own more"
    assert text("<aside><article>only</article></aside>") == "only"


def test_names_of_every_block():
    def text(page):
        return host_texts([blocks_of(f"<article>{page}</article>")])[0]

    assert text('<p>a<p class="advert">no<p>b</p><p role=navigation>no</p>c') == "a b c"
    assert text('<ul><li>a<li class="comment">no<ul><li>no</li></ul>no<li>b</ul><h2 id=related>no</h2><p>c') == "a b c"
    assert text('<table><tr><td>a<td class=ad>no<tr><td>b<tr class=ad><td>no</table>c<h3 class=promo>no<p>d') == "a b c d"
    assert text('<p class="notice"><b>no</b><br>no</p><p>a</p><dl><dt>b<dd class=share>no<dt>c</dl>d') == "a b c d"


def test_runs_like_counting_windows():
    rng = random.Random(1)
    words = np.array([rng.randrange(4) for _ in range(600)])
    pages = np.sort(np.array([rng.randrange(9) for _ in range(600)]))
    words[::50] = 100 + np.arange(12)
    for length in (1, 2, 4, 8):
        seen = defaultdict(set)
        for i in range(600):
            seen[tuple(words[i:i + length]) + (None,) * (i + length > 600)].add(pages[i])
        want = [len(seen[tuple(words[i:i + length]) + (None,) * (i + length > 600)]) for i in range(600)]
        assert repeated_runs(words, pages, length).tolist()[:600 - length] == want[:600 - length]


def test_host_boilerplate_without_an_article():
    notice = "please read our terms of use before you go on reading here"
    stories = [" ".join(f"s{i}w{j}" for j in range(12)) for i in range(6)]
    pages = [[(OTHER, notice), (OTHER, s), (OTHER, "Home")] for s in stories]
    assert host_texts(pages) == stories


def test_articles_keep_what_others_share():
    passage = " ".join(f"w{i}" for i in range(60))
    pages = [[(MAIN, f"own words of page {i} " * 3 + passage)] for i in range(20)]
    assert host_texts(pages) == [p[0][1].strip() for p in pages]
    copies = [[(MAIN, "the same article on every page of the host, word for word")]] * 12
    assert host_texts(copies) == [c[0][1] for c in copies]
    # a short notice that all articles carry goes
    long = [[(MAIN, " ".join(f"p{i}x{j}" for j in range(80))), (MAIN, "subscribe to our weekly letter and never miss a story")] for i in range(12)]
    assert host_texts(long) == [p[0][1] for p in long]


def test_pages_table(spark):
    rows = [(i, f"http://{'hot' if i % 3 else f'h{i}'}.example.com/{i}", f"<nav>x</nav><article><p>text {i}</p></article>") for i in range(300)]
    rows += [(400, None, None), (401, "no url", ""), (None, "http://a.b/", "<p>x"), (402, "HTTP://hot.example.com/q?x#y", PAGE * 300), (5, "http://hot.example.com/5", "<p>y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as host", "3 as part")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in main_texts(pages, part_pages=20).collect()), key=str)
    assert len(got) == len(rows) and all(n == len(t) for _, _, t, n in got)
    by = {r[1]: r[2] for r in got if r[0] != 5}
    assert by["http://hot.example.com/7"] == "text 7" and by[None] == "" and by["http://a.b/"] == "x"
    assert by["HTTP://hot.example.com/q?x#y"].count("five <x>") == 300
    assert sorted(t for i, _, t, _ in got if i == 5) == ["text 5", "y"]
    assert main_texts(pages.limit(0)).count() == 0


NOTICE = "share this story with all your friends and family today"


def test_common_blocks_whatever_the_host_size():
    def story(i):
        return (MAIN, " ".join(f"p{i}x{j}" for j in range(80)))

    for n in (5, 40, 320):
        pages = [[(MAIN, "By the desk"), story(i), (MAIN, "Background"), (MAIN, f"{NOTICE} story{i}"), story(n + i), (MAIN, NOTICE)] if i < 5 else [story(i)] for i in range(n)]
        # the name that ends one block stays, as the heading in the middle does
        assert host_texts(pages)[:5] == [f"{p[1][1]} Background story{i} {p[4][1]}" for i, p in enumerate(pages[:5])]
        assert host_texts(pages)[5:] == [p[0][1] for p in pages[5:]]
    passage = (MAIN, " ".join(f"w{j}" for j in range(41)))
    long = [[story(i), story(40 + i), *[passage] * (i < 10)] for i in range(40)]
    assert host_texts(long) == [" ".join(t for _, t in p) for p in long]
    assert host_texts([[(OTHER, "one and the same page")]] * 4 + [[(OTHER, f"x{i}")] for i in range(40)])[0] == "one and the same page"


def test_common_blocks_over_all_parts(spark):
    own = [" ".join(f"p{i}x{j}" for j in range(40)) for i in range(120)]
    rows = [(i, f"http://a.b/{i}", f"<article><p>{w}</p>{f'<p>{NOTICE}</p>' if i % 20 == 0 else ''}</article>") for i, w in enumerate(own)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for part_pages in (4, 500):
        assert {r.page_id: r.text for r in main_texts(pages, part_pages=part_pages).collect()} == dict(enumerate(own))


def test_names_of_remarks_and_adverts_both_ways():
    def text(page):
        return host_texts([blocks_of(page)])[0]

    for name in ("user-comments", "reader-comments", "article-comments", "comment-thread", "fb-comments", "dfp-ad", "adsbygoogle",
                 "google_ads_iframe", "outbrain", "taboola", "tags", "userComments", "x comment-section"):
        assert text(f'<main><p>story</p><div class="{name}"><p>no</p></div></main>') == "story", name
    for name in ("comment-page", "comments-page", "commentary", "tagged", "header-image-free", "article-body", "user-guide", "thread-count", "adsorption"):
        assert text(f'<main><p>story</p><div class="{name}"><p>too</p></div></main>') == "story too", name
    assert text('<div class="header">no</div><p>story</p>') == text('<div id="page-header">no</div><p>story</p>') == "story"
    assert text('<article><div class="header"><h1>Title</h1></div><p>story</p></article>') == "Title story"
    assert text('<body class="comment-page"><div class="comment-page"><p>story</p></div>') == "story"


def page_of(*blocks):
    return "<nav>menu</nav><article>" + "".join(b if b.startswith("<h") else f"<p>{b}</p>" for b in blocks) + "</article><footer>end</footer>"


def table_of(spark, rows):
    return spark.createDataFrame([(i, f"https://{host}/{i}", page) for i, (host, page) in enumerate(rows)], "page_id long, url string, html string")


def test_copies_change_nothing(spark):
    """1, 3, 4 and 40 copies of an article on one host, in one part or many:
    its headline, short paragraphs and last line stay."""
    own = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(5)]
    article = page_of("<h1>A headline of nine words that is quite long</h1>", "a short line", own[0], "seventeen words " * 8 + "end", own[1], "the last line")
    for copies in (1, 3, 4, 40):
        rows = [("a.b", article)] * copies + [("a.b", page_of(own[k])) for k in (2, 3, 4)]
        for part_pages in (2, 500):
            got = {r.page_id: r.text for r in main_texts(table_of(spark, rows), part_pages=part_pages).collect()}
            assert len(got) == len(rows)
            assert {got[i] for i in range(copies)} == {
                f"A headline of nine words that is quite long a short line {own[0]} " + "seventeen words " * 8 + f"end {own[1]} the last line"}


def test_headings_and_lines_of_other_hosts_stay(spark):
    own = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(24)]
    line = "a licence line that pages of two hosts have in common"
    rows = [("a.b", page_of("<h2>Background</h2>", own[i], line, NOTICE)) for i in range(12)] + [("c.d", page_of(own[12], line))]
    rows += [("c.d", page_of(own[i], "<h3>Background</h3>", "only three pages have this line of text")) for i in range(13, 16)]
    for part_pages in (3, 500):
        got = {r.page_id: r.text for r in main_texts(table_of(spark, rows), part_pages=part_pages).collect()}
        for i in range(12):
            assert got[i] == f"Background {own[i]} {line}"      # the notice of one host goes
        assert got[12] == f"{own[12]} {line}"
        for i in range(13, 16):
            assert got[i] == f"{own[i]} Background only three pages have this line of text"


def brute_force(rows):
    """The boilerplate rules for pages with an article, by counting."""
    pages = [(host, [t for p, t in blocks_of(page) if p == MAIN]) for host, page in rows]
    distinct = {(host, tuple(map(str, b))): b for host, b in pages}
    ends, windows = defaultdict(set), defaultdict(set)
    for (host, key), blocks in distinct.items():
        for t in blocks:
            w = t.split(" ")
            for i in range(len(w) - 7):
                windows[host, tuple(w[i:i + 8])].add(key)
            if not isinstance(t, Title):
                for kind, x in ([("=", w)] if len(w) <= 40 else []) + ([("<", w[:8]), (">", w[-8:])] if len(w) > 8 else []):
                    ends[kind, tuple(x)].add((host, key))

    def common(kind, words):
        on = ends[kind, tuple(words)]
        return len(on) >= 4 and len({host for host, _ in on}) == 1

    out = []
    for host, blocks in pages:
        keep = []
        for t in blocks:
            w = t.split(" ")
            stays = [True] * len(w)
            if not isinstance(t, Title):
                if len(w) <= 40 and common("=", w):
                    stays = [False] * len(w)
                elif len(w) > 8:
                    if common("<", w[:8]):
                        j = 0
                        while j + 9 <= len(w) and len(windows[host, tuple(w[j + 1:j + 9])]) > 1:
                            j += 1
                        stays[:j + 8] = [False] * (j + 8)
                    if common(">", w[-8:]):
                        j = len(w) - 8
                        while j > 0 and len(windows[host, tuple(w[j - 1:j + 7])]) > 1:
                            j -= 1
                        stays[j:] = [False] * (len(w) - j)
                    gone = stays.count(False)
                    if gone > 40 or 2 * gone < len(w):
                        stays = [True] * len(w)
            keep.append(stays)
        # short blocks go at the beginning and the end of the text only
        solid = [i for i, x in enumerate(keep) if any(x)]
        for i, t in enumerate(blocks):
            if len(keep[i]) < 8 and solid and solid[0] < i < solid[-1]:
                keep[i] = [True] * len(keep[i])
        total = sum(map(len, keep))
        if sum(x.count(False) for x in keep) > 0.3 * total:
            keep = [[True] * len(x) for x in keep]
        out.append(" ".join(w for t, x in zip(blocks, keep) for w, s in zip(t.split(" "), x) if s))
    return out


def test_whole_method_like_counting(spark):
    rng = random.Random(5)
    words = [f"v{i}" for i in range(400)]
    notices = {h: [" ".join(rng.choice(words) for _ in range(n)) for n in (3, 9, 12, 38, 45)] for h in ("a.b", "c.d", "e.f")}
    shared = [" ".join(rng.choice(words) for _ in range(n)) for n in (4, 15)]
    rows = []
    for _ in range(150):
        host = rng.choice(["a.b", "a.b", "c.d", "e.f"])
        blocks = []
        for _ in range(rng.randrange(2, 9)):
            kind = rng.random()
            text = " ".join(rng.choice(words) for _ in range(rng.choice([2, 7, 8, 30, 90])))
            if kind < 0.25:
                text = rng.choice(notices[host])
            elif kind < 0.35:
                text = rng.choice(shared)
            elif kind < 0.45:
                text = rng.choice(notices[host]) + " " + " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9)))
            elif kind < 0.55:
                text = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9))) + " " + rng.choice(notices[host])
            blocks.append(f"<h2>{text}</h2>" if rng.random() < 0.1 else text)
        rows += [(host, page_of(*blocks))] * rng.choice([1, 1, 1, 5])
    want = brute_force(rows)
    got = {r.page_id: r.text for r in main_texts(table_of(spark, rows)).collect()}
    assert [got[i] for i in range(len(rows))] == want
    assert sum(len(w) for w in want) < sum(len(" ".join(t for p, t in blocks_of(x) if p == MAIN)) for _, x in rows)


def by_part_size(spark, rows, sizes):
    table = table_of(spark, rows).cache()
    return [[t for _, t in sorted((r.page_id, r.text) for r in main_texts(table, part_pages=n).collect())] for n in sizes]


def test_runs_of_pages_without_an_article_are_counted_over_all_parts(spark):
    rng = random.Random(11)
    own = [" ".join(f"p{i}x{j}" for j in range(30)) for i in range(60)]
    notice, rare = (" ".join(f"{name}{j}" for j in range(12)) for name in ("notice", "rare"))
    rows, want = [], []
    for i in rng.sample(range(60), 60):
        # in the middle of a block, so that no end is common
        block = own[i] + (f" {notice} p{i}y" if i < 24 else f" {rare} p{i}y" if i < 36 else "")
        rows.append(("a.b", f"<p>{block}</p>" + "<p>Home</p>" * (i < 24) + "<p>Seldom</p>" * (24 <= i < 34) + f"<p>p{i} ends</p>"))
        want.append(f"{own[i]} p{i}y p{i} ends" if i < 24 else f"{block} Seldom p{i} ends" if i < 34 else f"{block} p{i} ends")
    # copies, empty pages and another host's change nothing
    rows += [rows[0]] * 9 + [("a.b", "")] + [("c.d", f"<p>{notice} {i}</p>") for i in range(2)]
    want += [want[0]] * 9 + [""] + [f"{notice} {i}" for i in range(2)]
    assert by_part_size(spark, rows, (4, 20, 500)) == [want] * 3


def test_common_ends_go_on_over_all_parts(spark):
    start = " ".join(f"s{j}" for j in range(8))
    rows, want = [], []
    for i in range(40):
        story = " ".join(f"p{i}x{j}" for j in range(80))
        more = " ".join(f"m{i % 20}y{j}" for j in range(8))  # on two pages
        rows.append(("a.b", page_of(story, f"{start} {more} p{i}a p{i}b", f"p{i}c ends {i}")))
        want.append(f"{story} p{i}a p{i}b p{i}c ends {i}")
    assert by_part_size(spark, rows, (2, 7, 500)) == [want] * 3


def test_parts_change_nothing(spark):
    rng = random.Random(17)
    words = [f"v{i}" for i in range(300)]
    some = [" ".join(rng.choice(words) for _ in range(n)) for n in (1, 3, 8, 9, 12, 20, 38, 45, 60, 90)]
    pages = []
    for _ in range(90):
        blocks = []
        for _ in range(rng.randrange(1, 7)):
            own = " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 7, 8, 25, 60])))
            blocks.append(rng.choice([own, own, rng.choice(some), f"{rng.choice(some)} {own}", f"{own} {rng.choice(some)}"]))
        beside = f"<p>{rng.choice(some)}</p>" * (rng.random() < 0.5)
        pages += [page_of(*blocks) + beside if rng.random() < 0.5 else "".join(f"<p>{b}</p>" for b in blocks)] * rng.choice([1, 1, 1, 4])
    pages += [p + "<p>beside the article</p>" for p in pages if "<article>" in p][:20]
    rng.shuffle(pages)
    want = host_texts([blocks_of(p) for p in pages])
    assert host_texts([blocks_of(p) for p in pages[::-1]]) == want[::-1]
    assert sum(map(len, want)) < sum(len(" ".join(t for p, t in blocks_of(x) if p == MAIN or "<article>" not in x)) for x in pages)
    assert by_part_size(spark, [("a.b", p) for p in pages], (3, 30, 500)) == [want] * 3
