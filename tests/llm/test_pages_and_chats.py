"""HTML extraction and chat repair."""

import itertools

import numpy as np
import pytest

from lodestone.llm import chat_format, html_extract


def texts(*pages):
    return html_extract.main_texts(list(pages))


def test_article_without_furniture():
    page = (
        '<!DOCTYPE html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><a>Menu</a></nav><header>Top</header><!-- ad -->'
        '<div class="ad">Buy</div><article><header><h1>A &amp; B</h1></header><p>one <b>two</b>three<br>four &#233;&nbsp;x<p>five<aside>side</aside><div id="comments"><p>me</p></div>'
        '<form><input>field</form></p></article><div class="cookie-notice">ok</div><footer>&copy; x</footer>'
    )
    assert texts(page) == ["A & B one twothree four é x five"]


@pytest.mark.parametrize("page", [None, "", "<p>", "   ", "<script>x", "<nav>a</nav>", "<!-- open", "<article></article>", "<"])
def test_nothing_to_extract(page):
    assert texts(page) in ([""], ["<"])


def test_plain_text_and_broken_markup():
    assert texts("just words &lt;b&gt;") == ["just words <b>"]
    assert texts('<p title="a>b">x</p>y <b>z') == ["x y z"]
    assert texts("<div><p>a</div>b</div><main>c<section>d</main>") == ["c d"]
    assert texts("<p>tail <a href='x") == ["tail"]


def test_repeated_blocks_of_a_host_go_and_unique_ones_stay():
    page = lambda i: f"<div class=x><p>the same words stand at the foot of every page of this host here</p></div><div class=y><p>unique{i} words{i * 3} that{i * 7} only{i} this{i} page{i} has{i}</p></div>"
    got = texts(*(page(i) for i in range(6)))
    assert got == [f"unique{i} words{i * 3} that{i * 7} only{i} this{i} page{i} has{i}" for i in range(6)]


def test_copies_of_a_page_keep_their_text():
    page = "<div>these are words of one page that has been copied many times over</div>"
    assert texts(*[page] * 5) == ["these are words of one page that has been copied many times over"] * 5


def test_repeated_passages_in_articles_stay():
    page = lambda i: f"<article><p>own {i}</p><p>a passage of more than eight words that all of the pages quote</p></article>"
    assert texts(*(page(i) for i in range(5))) == [f"own {i} a passage of more than eight words that all of the pages quote" for i in range(5)]


def test_unique_page_among_near_copies_stays():
    body = " ".join(f"w{k}" for k in range(60))
    near = [f"<div class=x><p>{body} end{i}</p></div>" for i in range(10)]
    own = "a text of one page alone that nothing else on the host repeats"
    assert texts(*near, f"<div class=x><p>{own}</p></div>") == [f"end{i}" for i in range(10)] + [own]


def test_unique_block_of_an_article_at_a_templated_place_stays():
    line = " ".join(f"w{k}" for k in range(60))
    page = lambda i, x: f"<article><p>own {i}</p><div class=more>{x}</div></article>"
    assert texts(*(page(i, line) for i in range(10)), page(10, "unlike the others"))[9:] == ["own 9", "own 10 unlike the others"]


def test_cover_equals_brute_force():
    r = np.random.default_rng(2)
    page = np.sort(r.integers(0, 6, 400))
    tokens = r.integers(0, 3, 400)
    want = np.zeros(400, bool)
    seen = {}
    for i in range(400 - 7):
        if page[i] == page[i + 7]:
            seen.setdefault(tuple(tokens[i : i + 8]), []).append(i)
    for at in seen.values():
        if len({page[i] for i in at}) >= 3:
            for i in at:
                want[i : i + 8] = True
    assert (html_extract.repeated(tokens, page) == want).all() and want.any() and not want.all()


def test_pages(spark):
    rows = [(1, "http://H.org/a", "<article>x</article>"), (1, "http://H.org/a", "<article>x</article>"), (2, None, None), (None, "no address", "<p>y</p>"), (3, "http://h.org:80/b", "<article>" + "<p>w</p>" * 50000 + "</article>")]
    df = spark.createDataFrame([(*r, "clash", "host") for r in rows], "page_id long, url string, html string, lot string, text string")
    got = sorted(((r.page_id, r.url, r.text[:9], r.n_chars) for r in html_extract.extract(df).collect()), key=str)
    assert got == sorted([(1, rows[0][1], "x", 1), (1, rows[0][1], "x", 1), (2, None, "", 0), (None, "no address", "y", 1), (3, rows[4][1], "w w w w w", 99999)], key=str)
    assert html_extract.extract(df.limit(0)).count() == 0


def test_lots_change_no_text(spark, monkeypatch):
    notice = "this notice stands on some pages of a host and mostly on fewer than three of any lot"
    own = lambda i: " ".join(f"own{i * 31 + k}" for k in range(40))
    page = lambda i: f"<div class=x><p>{own(i % 110)}</p>{'<p>' + notice + '</p>' if i % 12 == 0 else ''}</div>" + (f"<article><p>a{i}</p><div class=more>{notice}</div></article>" if i % 5 == 0 else "")
    htmls = [page(i) for i in range(120)] + [None]
    want = texts(*htmls)
    assert not any("notice" in x for x in want) and all(x or h is None for x, h in zip(want, htmls))
    df = spark.createDataFrame([(i, "http://hot.org/", x) for i, x in enumerate(htmls)] + [(1000, "http://small.org/", htmls[0])], "page_id long, url string, html string")
    monkeypatch.setattr(html_extract, "GROUP_BYTES", 1000)
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert got == {**dict(enumerate(want)), 1000: texts(htmls[0])[0]}


ROLES = ("system", "user", "assistant", "tool", None)


def legal(roles):
    rest = roles[1:] if roles and roles[0] == "system" else roles
    return len(rest) % 2 == 0 and all(r == ("user", "assistant")[i % 2] for i, r in enumerate(rest)) and (rest or not roles)


def brute_cost(roles):
    """Least cost over all choices, by search over (state, turn)."""
    best = {"start": 0}
    for role in roles:
        nxt = {}
        for state, cost in best.items():
            follow = {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
            ways = [(f, 0) for f in follow[state]] + [(f, 2) for mid in follow[state] if mid != "system" for f in follow[mid]]
            for new, c in ways:
                c += cost + (0 if new == role else 3)
                nxt[new] = min(nxt.get(new, 99), c)
            if state != "start":
                nxt[state] = min(nxt.get(state, 99), cost + 1 + (0 if state == role else 3))
        best = nxt
    return min(c + {"start": 4, "system": 4, "user": 2, "assistant": 0}[s] for s, c in best.items())


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_least_cost_equals_brute_force(n):
    for roles in itertools.product(ROLES, repeat=n):
        costs = chat_format.stretch_costs(list(roles))[chat_format.START] + chat_format.FINISH
        assert int(costs.min()) == brute_cost(roles), roles
        end = int(np.argmin(costs))
        built = []
        for role, (state, merges, inserted) in zip(roles, chat_format.trace(list(roles), chat_format.START, end)):
            built += [chat_format.ROLES[x - 1] for x in inserted]
            if not merges:
                built.append(chat_format.ROLES[state - 1])
            assert built[-1] == chat_format.ROLES[state - 1]
        assert legal(built + list(chat_format.APPENDED[end])), (roles, built)


def test_conversations(spark):
    long = [(9, i, ("user", "assistant")[i % 2] if i % 97 else "user", f"t{i}") for i in range(1000)]
    rows = [(1, 0, "user", "hi"), (1, 1, "user", "there"), (1, 2, "assistant", None), (2, 0, "assistant", "hello"), (3, 0, "bot", "x"), (3, 0, "bot", "x"), (None, None, None, None), (4, 0, "system", "s"), *long]
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], "conv_id long, turn long, role string, text string, cost int, stretch string").repartition(4)
    got = chat_format.repair(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in sorted(got, key=lambda r: (str(r.conv_id), r.position)):
        by.setdefault(r.conv_id, []).append(r)
    show = lambda c: "".join(r.rendered for r in by[c])
    assert show(1) == "<|user|>\nhi\nthere\n<|assistant|>\n" and by[1][1].action == "merge" and by[1][0].cost == 1
    assert show(2) == "<|user|>\n\n<|assistant|>\nhello"
    assert show(4) == "<|system|>\ns\n<|user|>\n\n<|assistant|>\n"
    for c, rs in by.items():
        roles = [r.role for r in rs]
        assert {r.cost for r in rs} == {int((chat_format.stretch_costs(roles)[chat_format.START] + chat_format.FINISH).min())}
        built = [x for r in rs for x in [*r.inserted, *([] if r.action == "merge" else [r.new_role])]] + list(rs[-1].appended)
        assert legal(built), c
    assert chat_format.repair(df.limit(0)).count() == 0


def brute_host(pages):
    """Texts of pages without articles: all pairs of pages, all substrings of eight tokens, plain sets."""
    parsed = [[t for _, t, _ in html_extract.blocks(x or "")] for x in pages]
    tokens = [[w for t in p for w in t.split(" ")] for p in parsed]
    holders = {}
    for p, own in zip(parsed, tokens):
        for i in range(len(own) - 7):
            holders.setdefault(tuple(own[i : i + 8]), set()).add("\n".join(p))
    out = []
    for own in tokens:
        gone = {i + k for i in range(len(own) - 7) if len(holders[tuple(own[i : i + 8])]) >= 3 for k in range(8)}
        out.append(" ".join(w for i, w in enumerate(own) if i not in gone))
    return out


def drawn_pages(n, seed):
    r = np.random.default_rng(seed)
    passages = [" ".join(f"p{k}x{i}" for i in range(r.integers(3, 25))) for k in range(8)]
    own = lambda: " ".join(f"w{x}" for x in r.integers(0, 40, r.integers(1, 30)))
    pages = ["".join(f"<div class=c{r.integers(3)}>{passages[r.integers(8)] if r.random() < 0.5 else own()}</div>" for _ in range(r.integers(1, 7))) for _ in range(n)]
    return pages + pages[:3]


@pytest.mark.parametrize("seed", range(4))
def test_open_pages_equal_brute_force(seed):
    pages = drawn_pages(40, seed)
    want = brute_host(pages)
    assert texts(*pages) == want and sum(map(len, want)) < sum(len(html_extract.blocks(x)) for x in pages) * 200


def test_the_suffix_array_decides(monkeypatch):
    pages = drawn_pages(40, 9)
    with_array = texts(*pages)
    monkeypatch.setattr(html_extract, "cover", lambda rank, hit, long=8: np.zeros(len(rank), bool))
    assert texts(*pages) != with_array


def test_lots_equal_brute_force(spark, monkeypatch):
    pages = drawn_pages(60, 5)
    monkeypatch.setattr(html_extract, "GROUP_BYTES", 800)
    df = spark.createDataFrame([(i, "http://h/", x) for i, x in enumerate(pages)], "page_id long, url string, html string").repartition(3)
    assert [r.text for r in html_extract.extract(df).orderBy("page_id").collect()] == brute_host(pages)


def test_suffix_array_is_sorted_with_common_prefixes():
    r = np.random.default_rng(1)
    for n, kinds in ((0, 1), (1, 1), (60, 1), (200, 2), (300, 20)):
        page, tokens = np.sort(r.integers(0, 5, n)), r.integers(0, kinds, n)
        order, common = html_extract.suffix_array(tokens, page)
        suffix = lambda i: tokens[i : np.searchsorted(page, page[i], "right")].tolist()  # noqa: B023, E731
        assert order.tolist() == sorted(range(n), key=lambda i: (suffix(i), i))  # noqa: B023
        for k in range(1, n):
            a, b = suffix(order[k - 1]), suffix(order[k])
            assert common[k] == next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_articles_in_wrappers_and_marked_paragraphs():
    assert texts('<div class="skip"><article><p>a</p></article></div>') == ["a"]
    assert texts('<div class="share-price-report"><article>b<div class=ad>c</div></article></div><nav>d</nav>') == ["b"]
    assert texts('<div class="related"><article>teaser</article></div><div>the open text of the page</div>') == ["the open text of the page"]
    assert texts('<div class="related"><article>teaser</article></div><article>own</article>') == ["own"]
    assert texts('<div id="comments"><article>me</article></div>', "<div hidden><article>x</article></div>") == ["", ""]
    assert texts('<article>a<p class="advert">buy</p><p>b<p class="promo">c<div>d</div></article>') == ["a b d"]


def test_deep_and_broken_nesting_stays_small():
    import tracemalloc

    deep = "<div>" * 50_000 + "text" + "</section>" * 50_000 + "<a class=ad>" * 20_000 + "x" + "</b>" * 20_000
    tracemalloc.start()
    assert texts(deep, "<a " * 50_000, "<a '" * 50_000)[0] == "text"
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20


@pytest.mark.parametrize("page, want", [
    ('<article><p>One two.</p><div class="notice-of-appeal"><p>The court held.</p></div></article>', "One two. The court held."),
    ('<article><p>One.</p><div class="tasting-menu">Soup and fish.</div><div class="site-menu">Home</div></article>', "One. Soup and fish."),
    ('<article><p>One.</p><section class="related-work">They did it first.</section><div class="adBox">Buy</div></article>', "One. They did it first."),
    ('<body><div class="site-nav">Home</div><div id="social-science"><p>A body of text.</p></div><div id="social-bar">Share</div></body>', "A body of text."),
    ('<body><form id="aspnetForm"><nav>Menu</nav><div><p>All of the page.</p><label>Name</label><input></div><div class="comments">Nice</div></form></body>', "All of the page."),
    ('<body><p>The page has text of its own here.</p><form><p>Search</p></form></body>', "The page has text of its own here."),
    ('<body><div class="newsletter"><form><p>Sign up for a very long letter.</p></form></div><p>Short.</p></body>', "Short."),
])
def test_names_and_forms_that_only_look_like_furniture(page, want):
    assert html_extract.main_texts([page]) == [want]


def boxed(i, notice):
    own = " ".join(f"own{i * 31 + k}" for k in range(40))
    return f"<article><h1>title {i}</h1><p>{own}</p><section><p>{notice}</p></section></article>", f"title {i} {own}"


def test_articles_pass_the_suffix_array(spark, monkeypatch):
    """A notice in a container of its own on all pages goes; near copies of a text in one, and a passage of articles, stay."""
    notice = "this notice stands in a section of its own on every page of the host"
    body = " ".join(f"w{k}" for k in range(60))
    pages = [boxed(i, notice)[0] for i in range(20)]
    near = [f"<article><h1>copy {i}</h1><div><p>{body} end{i}</p></div></article>" for i in range(9)]
    want = [boxed(i, notice)[1] for i in range(20)] + [f"copy {i} {body} end{i}" for i in range(9)]
    assert texts(*pages, *near) == want
    assert texts(*pages[:2]) == [f"{x} {notice}" for x in want[:2]]
    df = spark.createDataFrame([(i, "http://h/", x) for i, x in enumerate([*pages, *near, pages[3]])], "page_id long, url string, html string").repartition(3)
    for size in (4 << 20, 900):
        monkeypatch.setattr(html_extract, "GROUP_BYTES", size)
        assert [r.text for r in html_extract.extract(df).orderBy("page_id").collect()] == [*want, want[3]]


def test_every_page_has_a_stream_in_the_array(spark, monkeypatch):
    seen = []
    real = html_extract.runs
    monkeypatch.setattr(html_extract, "runs", lambda tokens, page: (seen.append(len(tokens)), real(tokens, page))[1])
    assert texts("<article><p>one two three</p></article>", "<article>four</article>") == ["one two three", "four"] and seen == [4]
