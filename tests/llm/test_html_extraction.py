import json

from screenforge.llm.html_extraction import extract, folded, main_text, merged, page_wrapper, size, template_texts, trimmed


def _page(body, nav="<a href=x>Home</a>"):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav>{nav}</nav>{body}<footer>&copy; me</footer></body></html>"


CASES = [
    ("<article><h1>A &amp; B</h1><p><b>one<br>two<p>three  \n four</article>", "A & B\none two\nthree four"),
    ("<article><p>x</p><div class='ad'>buy</div><form>f</form><aside>s</aside><div id=comments><p>me</div><p>y</article>", "x\ny"),
    ("<main><ul><li>a<li>b</ul><table><tr><td>1<td>2</table></main><p>outside</p>", "a\nb\n1\n2"),
    ("<div><p>no <i>ma</i>in</p></div><div class='cookie-notice'>c</div>", "no main"),
    ("<article>&lt;p&gt; &#233; &amp &nbsp;z<!-- <p>hidden --></article>", "<p> é & z"),
    ("<article></article>", ""),
    ("<article><p>open", "open"),
]


def test_main_text():
    for body, text in CASES:
        assert main_text(_page(body)) == text
    assert main_text("") == "" and main_text("<<<") == "<<<" and main_text("plain") == "plain"


def test_wrapper_has_slots_optional_and_repeated_groups():
    a, b = (page_wrapper(_page(f"<div><h1>{t}</h1>{'<p>x</p>' * n}{extra}<i>same</i></div>")) for t, n, extra in (("A", 1, ""), ("B", 4, "<hr><b>new</b>")))
    both = merged(a, b)

    def nodes(node):
        yield node
        for child in node[5]:
            yield from nodes(child)

    found = {n[0]: n for n in nodes(both)}
    assert found["p"][2] and found["b"][1] and not found["h1"][1]
    texts = [n[4] for n in nodes(both) if n[0] == "#text"]
    assert None in texts and any(t is not None for t in texts)
    assert json.loads(json.dumps(both)) == both
    assert not template_texts(both)
    assert len(template_texts(merged(both, page_wrapper(_page("<div><h1>C</h1><p>z</p><i>same</i></div>"))))) == 1


def test_folding_of_longer_groups():
    def children(labels):
        return [[x, False, False, 1, None, []] for x in labels]

    assert [n[0] for n in folded(children("abababab"))] == ["a", "b"]
    assert [n[0] for n in folded(children("abcabcd"))] == ["a", "b", "c", "d"]
    wide = ["#page", False, False, 1, None, [[f"x{i}", True, False, 1, None, []] for i in range(5_000)]]
    assert size(trimmed(wide)) == 1


def test_template_text_without_main_element_is_dropped(spark):
    rows = [(i, f"http://h/{i}", f"<body><div>All rights reserved</div><div><p>story {i}</p></div></body>") for i in range(12)]
    rows += [(50, "http://other/", "<body><div>All rights reserved</div><p>x</p></body>"), (51, None, None), (52, "http://h/", ""), (None, "u", _page("<article>n</article>"))]
    rows += [(0, *rows[0][1:]), (60, "http://h/60", "<body>" + "<div>" * 3_000 + "deep" + "<p>w" * 30_000)]
    frame = spark.createDataFrame([(i, u, h, 1, "t") for i, u, h in rows], "page_id long, url string, html string, host int, text string")
    out = extract(frame).collect()
    assert len(out) == len(rows)
    texts = {r.page_id: r.text for r in out}
    assert all(texts[i] == f"story {i}" for i in range(12))
    assert texts[50] == "All rights reserved\nx" and texts[51] == "" and texts[52] == "" and texts[None] == "n"
    assert texts[60].startswith("deep\nw\nw") and all(r.n_chars == len(r.text) for r in out)
    assert extract(frame.limit(0)).count() == 0


def test_article_that_is_copied_is_kept(spark):
    rows = [(i, "http://h/1", _page("<article><p>same story</p></article>", nav=str(i))) for i in range(9)]
    assert {r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"same story"}


def _texts(spark, rows, parts=1):
    frame = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string").repartition(parts)
    return [r.text for r in extract(frame).orderBy("page_id").collect()]


def test_no_template_of_a_varied_host_is_forgotten(spark):
    rows = [("http://h/", "<body>" + "".join(f"<div class='x{c}{chr(97 + i % 26)}{chr(97 + i // 26)}'>only {i}</div>" for i in range(600))) for c in "abcdefgh"]
    for at in (1, 60, 900):
        rows[at:at] = [("http://h/", f"<body><div class='late'>All rights reserved</div><p>story {at}</p>")]
    for parts in (1, 4):
        texts = _texts(spark, rows, parts)
        assert sorted(t for t in texts if "story" in t) == ["story 1", "story 60", "story 900"]
        assert all(t.count("only") == 600 for t in texts if "story" not in t)


def test_copies_keep_their_text_in_any_number_of_partitions(spark):
    rows = [(None, "<body><p>same story</p><div>its end</div></body>")] * 9
    rows += [("http://h/", _page("<div>one page</div><p>only</p>", nav=f"{i}<script>{i}</script>")) for i in range(9)]
    rows += [("http://g/", f"<body><div><p>Notice</p></div><b>Notice</b><i>{i}</i></body>") for i in range(4)]
    rows += [("http://g/", "<body><div><p>Notice</p></div><b>another</b><i>Notice</i></body>")]
    expected = ["same story\nits end"] * 9 + ["one page\nonly"] * 9 + [f"Notice{i}" for i in range(4)] + ["anotherNotice"]
    for parts in (1, 5, 23):
        assert _texts(spark, rows, parts) == expected


def test_template_inside_the_main_element_is_dropped(spark):
    def story(i, tags=""):
        return f"<article id='post-{i}' class='c{i}'><p class='x'>Thank you for reading</p><h1>title {i}</h1><p>text {i}</p><ul>{tags}</ul><div>Copy me</div></article>"

    rows = [("http://h/", _page(story(i, "<li>red<li>blue"))) for i in range(5)] + [("http://g/", _page(story(9)))]
    for parts in (1, 6):
        assert _texts(spark, rows, parts) == [f"title {i}\ntext {i}\nred\nblue" for i in range(5)] + ["Thank you for reading\ntitle 9\ntext 9\nCopy me"]


def test_names_and_forms_around_an_article_do_not_drop_it():
    article = "<article><p>story</article>"
    for around in ("<div class='site no-sidebar'>", "<div class='has-sidebar'>", "<div class=sidebar>", "<div id='ads'>", "<form id=aspnetForm>", "<main><form><div class='nav'>"):
        assert (around, main_text(_page(around + article)))[1] == "story"
    assert main_text(_page("<form id=aspnetForm><h1>All</h1><p>of it</form>")) == "All\nof it"
    assert main_text(_page("<form>search</form><p>text")) == "text" and main_text(_page("<aside><article>x</article></aside>")) == ""
    inside = "<header class='entry-header'><h1>title</h1></header><section id=discussion>d</section><p class='related-work'>w</p><p class='rail-travel' data-id=ad>r</p>"
    assert main_text(_page(f"<article>{inside}<div id=comments><article>c</article></div></article>")) == "title\nd\nw\nr"


def test_the_wrapper_confirms_a_doubtful_group(spark):
    share = "<div class='share'><b>Share this story with all your friends</b><i>{}</i></div>"
    rows = [("http://h/", _page(f"<article><p>story {i}</p>{share.format(i)}<section id='discussion'><h2>Discussion</h2><p>long words {i}</p></section></article>")) for i in range(4)]
    rows += [("http://g/", _page(f"<article><p>story</p>{share.format(7)}</article>"))]
    assert _texts(spark, rows, 3) == [f"story {i}\nlong words {i}" for i in range(4)] + ["story\nShare this story with all your friends7"]


def test_headings_that_a_site_repeats_stay_in_articles(spark):
    def story(i):
        parts = f"<h1>Title {i}</h1><h2>Summary</h2><p>about {i}</p><h2>Ingredients</h2><ul><li><b>Flour:</b> {i} g</ul><table><tr><th>Price</th><td>{i} €</td></table>"
        return f"<article>{parts}<h2>Legal</h2><p>All rights reserved</p></article>"

    rows = [("http://h/", _page(story(i))) for i in range(4)]
    rows += [("http://n/", f"<body><h1>Our site</h1><p>story {i}</p>") for i in range(4)]  # without an article a repeated heading is the site's
    expected = [f"Title {i}\nSummary\nabout {i}\nIngredients\nFlour: {i} g\nPrice\n{i} €" for i in range(4)] + [f"story {i}" for i in range(4)]
    for parts in (1, 3):
        assert _texts(spark, rows, parts) == expected


def test_what_the_contract_names_goes_with_or_without_a_template():
    for name in ("class='comment'", "id=reviews", "class='sidebar'", "class='notice'", "class='ad-box'", "class='menu'"):
        assert main_text(_page(f"<article><p>story</p><div {name}>differs everywhere</div></article>")) == "story"
    assert main_text("<body><div id=header>site</div><div class='menu'>a</div><p>text</p><div id='footer'>me</div>") == "text"
    assert main_text("<article><div class='header'><h1>title</h1></div><p>text</p><div class=footer>the end</div></article>") == "title\ntext\nthe end"


def test_broken_markup_takes_time_in_proportion():
    import time

    def seconds(part, n):
        start = time.perf_counter()
        main_text("<p>start</p>" + part * n)
        return time.perf_counter() - start

    for part in ("<a", "<a ", "<", "<!", "</", "<a b='", "<a \"", "<!--", "<script>", "<a b=\"'", "<p><b", "&amp", "<a\n>", "</p", "<a b=\">'"):
        seconds(part, 1_000)
        assert seconds(part, 160_000 // len(part)) < 6, part
    assert main_text("<p>a<b <i") == "a<b <i" and main_text("<p>x <a href='y>link</a> z") == "x link z"
    assert main_text("1 < 2 and 3 > 2 <b>x</b>") == "1 < 2 and 3 > 2 x"


def _walk_texts(tree, found):
    """Every text with the labels on the way to it and, per label, which group of neighbours it is in: a plain place."""
    from screenforge.llm.html_extraction import slots

    def go(node, way):
        label, children, own = node
        if own >= 0:
            yield own, way
        groups = slots([c[0] for c in children])
        for n, (_, members) in enumerate(groups):
            for i in members:
                yield from go(children[i], (*way, (children[i][0], n)))

    return dict(go(tree, ()))


def test_places_are_nodes_of_the_aligned_wrapper():
    """Against the definition, on random pages of one template whose optional groups come and go."""
    import functools
    import random

    from screenforge.llm.html_extraction import places, read, without_texts, tree_wrapper

    rng = random.Random(7)
    pages, truth = [], []
    for i in range(60):
        parts, names = [], []
        for name, tag in (("head", "<h1>{}</h1>"), ("lead", "<div class=lead>{}</div>"), ("ad", "<div class=x><b>{}</b></div>"), ("body", "<p>{}</p>"), ("end", "<ul><li>{}</li></ul>")):
            if name in ("head", "body") or rng.random() < 0.6:
                for _ in range(rng.randint(1, 3) if name == "body" else 1):
                    parts.append(tag.format(f"{name} {i}"))
                    names.append(name)
        pages.append("<article>" + "".join(parts) + "</article>")
        truth.append(names)
    parsed = [read(p) for p in pages]
    wrapper = functools.reduce(merged, [tree_wrapper(without_texts(*p)) for p in parsed])
    by_name = {}
    for (tree, found), names in zip(parsed, truth):
        own = places(tree, wrapper, "h", len(found))
        at = [own[i] for i, p in enumerate(found) if p and p.hash]
        assert len(at) == len(names) and 0 not in at
        for name, place in zip(names, at):
            by_name.setdefault(name, set()).add(place)
        assert set(_walk_texts(tree, found)) == {i for i, p in enumerate(found) if p and p.hash}
    assert all(len(v) == 1 for v in by_name.values()) and len(set.union(*by_name.values())) == 5


def test_wrappers_in_rounds_equal_one_after_the_other(spark, monkeypatch):
    import pickle

    from screenforge.llm import html_extraction as h

    monkeypatch.setattr(h, "FAN", 2)
    rows = [(i, f"http://h{i % 2}/", f"h{i % 2}", f"<article><h1>{i}</h1>{'<p>x' * (i % 4 + 1)}{'<div class=z>ad</div>' if i % 5 == 0 else ''}</article>") for i in range(40)]
    frame = spark.createDataFrame(rows, "page_id long, url string, host string, html string").repartition(8)
    found = {r.host: pickle.loads(bytes(r.wrapper)) for r in h.wrappers(h.materialize(h.parsed(frame), "parsed")).collect()}
    assert set(found) == {"h0", "h1"}
    for wrapper in found.values():
        article = wrapper[5][0]
        assert wrapper[3] == 20 and [(c[0], c[1], c[2]) for c in article[5]] == [("h1", False, False), ("p", False, True), ("div.z", True, False)]
