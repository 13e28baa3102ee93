import time

from graphrank.llm import html_extract
from graphrank.llm.labelled_pages import PAGES

SCHEMA = "page_id long, url string, html string, text string, kind string"
STORY = "The bridge was closed for a week, because the river had risen after the long rain of the last days."


def page(i, story):
    return (f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href=/>Home</a></ul></nav><!-- x --><div class='ad'>Buy now</div>"
            f"<article><h1>Page {i}</h1><p><b>{story}<br><p>A &amp; B&nbsp;&lt; C</p></article><footer>&copy; now</footer>")


def rows(spark, values):
    return spark.createDataFrame([(i, "u", h, "x", "k") for i, h in values], SCHEMA)


def test_held_out_pages(spark):
    pages = rows(spark, [(i, page(i, STORY)) for i in range(30)])
    model = html_extract.fit(pages)
    odd = [
        (1, page(7, STORY), f"Page 7 {STORY} A & B < C"),
        (2, None, ""), (3, "", ""), (4, "<p", ""), (5, "</div></p>", ""), (6, "just text &amp; more", "just text & more"),
        (7, f"<div id=menu><ul><li><a>A</a><li><a>B</a></ul></div><div class=post><p>{STORY}</p><p>Short.</p></div><div class='user-comments'><p>{STORY}</p></div>", f"{STORY} Short."),
        (8, f"<main><p>{STORY}</p><aside><p>{STORY}</p></aside><form>Mail <input></form><script>if(a<b){{'</p>'}}</script><p>End.</main>", f"{STORY} End."),
        (9, f"<article><p>{STORY}</p><section id=comments><article class=comment><p>{STORY}</p></article></section></article>", STORY),
        (10, "<article>" + "<div>" * 3000 + STORY, STORY),
        (1, page(7, STORY), f"Page 7 {STORY} A & B < C"),
    ]
    got = html_extract.extract(rows(spark, [(i, h) for i, h, _ in odd]), model, ["page_id"]).collect()
    assert [(r["page_id"], r["text"]) for r in got] == [(i, t) for i, _, t in odd]


def test_without_pages(spark):
    model = html_extract.fit(rows(spark, []))
    assert html_extract.extract(rows(spark, []), model, ["page_id"]).count() == 0
    for source in PAGES:  # fitted to these
        known = html_extract.Page(source, labelled=True)
        for v, p in enumerate(model.marginals(known)):
            assert not known.chars[v] or (p > 0.5) == bool(known.label[v])


def test_marginals_equal_enumeration():
    import itertools

    model = html_extract.TreeModel({("x",): 1}, {(0, 4, 0): 3.0, (1, 4, 0): 9.0, (0, 0, -1): 2.0})
    known = html_extract.Page("<div><p>" + STORY * 3 + "<ul><li>a<li>b</ul></div><p>c")
    looks = [model.look(s) for s in known.seen()]
    links = [model.potential(w, k) for w, k in zip(known.within, known.kind, strict=True)]
    n = len(known.parent)
    total, one = 0.0, [0.0] * n
    for labels in itertools.product((0, 1), repeat=n):
        weight = (1e-3 if labels[0] else 1.0)
        for v in range(n):
            weight *= looks[v][labels[v]] * (links[v][labels[known.parent[v]]][labels[v]] if v else 1)
        total += weight
        for v in range(n):
            one[v] += weight * labels[v]
    for got, want in zip(model.marginals(known), one, strict=True):
        assert abs(got - want / total) < 1e-9


def test_elements_without_text_hide_no_article():
    model = html_extract.TreeModel({}, {})
    for source in html_extract.PAGES:
        links, looks = html_extract.Counter(model.links), html_extract.Counter(model.looks)
        html_extract._counts(html_extract.Page(source, labelled=True), 40.0, links, looks)
        model = html_extract.TreeModel(dict(links), dict(looks))
    article = f"<article><p>{STORY}</p><p>{STORY}</p></article>"
    for before in (
        "<svg class=icon />", "<object data='x.swf' />", "<canvas/>", "<div><button>Menu</div>", "<div><select><option>One<option>Two</div>", "<svg viewBox='0 0 1 1'><path d='M0'>",
        "<select><option>One", "<button-group><a>x</a></button-group>", "<title-bar></title-bar>", "<svg-icon></svg-icon>", "<math/>", "<svg><title/><style/><path/></svg>",
        "<svg><text>Drawn</text></svg>", "<nav><button><div>Menu</div></button></nav>", "<template><article><p>Later</p></article></template>", "<title>A</title>",
        "<div><button>One <button>Two</button></div>", "<object><param name=a>", "<svg><title>T", "<script>'<p>'</script ><style>a</style\n>",
    ):
        label = "Menu " if before.startswith("<div><button>Menu") else "One " if before.startswith("<div><button>One") else ""  # of an unended button: text
        assert model.text(before + article) == f"{label}{STORY} {STORY}", before
        inside = f"<article><p>{STORY}</p>{before}<p>{STORY}</p></article>"
        if "Menu" not in before and "One <" not in before and "<a>" not in before:
            assert model.text(inside) == f"{STORY} {STORY}", before
    formula = "<math><mrow><mi>a</mi><mo>+</mo><mn>1</mn></mrow><annotation>tex</annotation></math>"
    assert model.text(f"<article><p>{STORY} {formula} {STORY}</p></article>") == f"{STORY} a+1 {STORY}"
    assert model.text(f"<article><p>{STORY}<select><option>A</select> <button>B</button></p></article><script>{STORY}") == STORY


def test_broken_pages_take_time_in_proportion():
    n = 200_000
    forms = {
        "open tags": "<a " * n, "ended late": "<a " * n + ">", "quotes": '<a "' * n, "a quote late": "<a " * n + '" >', "both quotes": "<a '\"" * n + ">",
        "unopened ends": "<div>" * n + "</x>" * n, "items": "<div>" * n + "<li></li>" * (n // 3), "items apart": "<li><ul>" + "<div>" * n + "<li></li>" * (n // 3),
        "inline": "<b>" * n + "<div></div>" * (n // 3), "script ends": "<script>" + "</script " * n, "scripts": '<script "' * n + ">", "comments": "<!-- " * n,
        "names": "<" + "a<" * (2 * n), "drawings": "<svg>" * n, "choices": "<select><b>" * (n // 2) + "<div>" * (n // 2)}
    for name, page in forms.items():
        begin = time.time()
        html_extract.Page(page)
        assert time.time() - begin < 10, name


def test_quotes_in_names_and_ends_of_tags():
    assert [(t.name, t.attributes, t.ending) for t in html_extract.tags_of("<p class='a>b'>x</p><a b=\"<i>\">< b><li\"x/y\"></UL >")] == [
        ("p", " class='a>b'", False), ("p", "", True), ("a", ' b="<i>"', False), ("li", '"x/y"', False), ("ul", " ", True)]
    assert [t.name for t in html_extract.tags_of("<a '<b>")] == ["b"]
