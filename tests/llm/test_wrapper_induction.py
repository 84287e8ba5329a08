import random

from leadloom.llm import wrapper


def _text():
    return ["", [[1, 1, 1]], []]


def test_long_lists_are_matched_as_by_the_recursion(monkeypatch):
    rng = random.Random(1)

    def tree(depth):
        if depth == 0 or rng.random() < 0.2:
            return _text()
        return [rng.choice("abc"), [tree(depth - 1) for _ in range(rng.randint(0, 3))]]

    for n, m in ((20, 2_001), (150, 300), (300, 150), (1, 500), (260, 260)):
        left, right = [tree(2) for _ in range(n)], [tree(2) for _ in range(m)]
        right[:3] = left[:3]
        got = wrapper._best_pairs(left, right, True)
        with monkeypatch.context() as patch:
            patch.setattr(wrapper, "SMALL", 1 << 60)
            whole = wrapper._best_pairs(left, right, True)
        assert got == whole


def test_a_late_label_hides_no_pairs():
    left = [["late", []], *[["p", []] for _ in range(20)]]
    right = [*[["p", []] if i % 2 else ["q", []] for i in range(2_000)], ["late", []]]
    assert len(wrapper._best_pairs(left, right)) == 20
    assert wrapper.tree_matching(["x", left], ["x", right]) == 21


def _texts(pages):
    """Texts of a host's pages by a wrapper of all, each content once."""
    shapes = {}
    for html in pages:
        root, texts = wrapper.read(html)
        shapes.setdefault(wrapper._content(texts), wrapper._bare(wrapper.shape_of(root)))
    whole = wrapper.fold(list(shapes.values()))
    return [wrapper.main_text(html, whole) for html in pages]


def test_copies_that_alone_have_an_element_keep_it():
    pages = [f"<div><span>Site</span></div><p>Article {i} with words of its own</p>" for i in range(40)]
    copies = [f"<div><span>Site</span></div><h2>Heading</h2><p>One article</p><div class=ad>{i}</div>" for i in range(8)]
    got = _texts(pages + copies)
    assert got[:40] == [f"Article {i} with words of its own" for i in range(40)]
    assert set(got[40:]) == {"Heading\n\nOne article"}


def test_copies_with_a_varying_remark_keep_their_article():
    article = "<h1>Heading</h1><p>" + "word " * 80 + "</p>"
    for remark in ("<footer>{}</footer>", "<div id=x>seen {} times</div>"):
        for got in _texts([f"<div>{article}</div>{remark.format(i)}" for i in range(9)]):
            assert got.startswith("Heading\n\nword word")


def test_small_hosts_have_a_template():
    got = _texts([f"<div><span>Site</span></div><p>Article {i} with words of its own</p>" for i in range(3)])
    assert got == [f"Article {i} with words of its own" for i in range(3)]


def test_constants_of_repeated_siblings_are_template():
    pages = [f"<div><b>Home</b><b>About</b></div><div id=c><p>First words of {i}</p><p>More words of {i}</p></div>" for i in range(9)]
    assert _texts(pages) == [f"First words of {i}\n\nMore words of {i}" for i in range(9)]


def test_icons_and_formulas_drop_nothing_else():
    assert wrapper.main_text("<p>one</p><svg class=i /><p>two</p><svg><text>x</text></svg><p>three</p>") == "one\n\ntwo\n\nthree"
    assert wrapper.main_text("<p>one <math/>and <math><mi>x</mi><mo>=</mo><mn>2</mn></math> two</p><svg><p>rest</p>") == "one and x=2 two\n\nrest"


def test_words_of_a_class_do_not_drop_the_article():
    article = "<p>" + "word " * 60 + "</p>"
    side = "<div class=sidebar>Side</div>"
    for page in (
        f"<html class=menu-open><body class='has-sidebar header-fixed'>{article}{side}</body></html>",
        f"<body><article class='post comments-open'>{article}{side}</article></body>",
        f"<body><main id=search class=widget>{article}{side}</main></body>",
        f"<body><div class='layout has-sidebar'><div class=no-ads>{article}</div>{side}</div><footer>f</footer></body>",
    ):
        assert wrapper.main_text(page) == ("word " * 60).strip()
    comments = "<div id=comments><p>" + "reply " * 90 + "</p></div>"
    assert wrapper.main_text(f"<div>{article}</div>{comments}") == ("word " * 60).strip()
