"""Content regions of pages: claims, mass, menus, odd markup, brute force."""

import math
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rowcraft.llm import html_extract
from rowcraft.llm.html_extract import extract

LONG = "word " * 200 + "end"
LINKS = "".join(f"<li><a href='/{k}'>Part {k}</a></li>" for k in range(5))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<body><h1>Title</h1><div><p>{LONG}</p></div><p>Closing words.</p></body>", f"Title\n{LONG}\nClosing words."),
        (f"<body><section><h2>A</h2><p>{LONG}</p></section><section><h2>B</h2><p>short</p></section></body>", f"A\n{LONG}\nB\nshort"),
        (f"<body><p>before</p><blockquote><p>{LONG}</p></blockquote><pre>after</pre><nav>menu</nav></body>", f"before\n{LONG}\nafter"),
        (f"<body><article><p>{LONG}</p></article><article><p>{LONG} two</p></article><footer>f</footer></body>", f"{LONG}\n{LONG} two"),
    ],
)
def test_nothing_beside_the_region_is_lost(page, text):
    assert extract(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<body><form action='/'><p>{LONG}</p></form><p>short</p></body>", f"{LONG}\nshort"),
        (f"<body><div id='page' class='has-sidebar sidebar-right'><p>{LONG}</p></div><footer>f</footer></body>", LONG),
        (f"<body><div class='page search'><p>{LONG}</p></div><footer>f</footer></body>", LONG),
        (f"<article><p>{LONG}</p><p class='notice'>n</p><section id='related-work'><p>rw</p></section><div class='social-history'>sh</div></article>", f"{LONG}\nn\nrw\nsh"),
        # a claim stands while an article is elsewhere, however long the rest is
        (f"<article><p>{LONG}</p></article><div class='sidebar'><p>{LONG} {LONG} {LONG}</p></div><div class='comments'><p>{LONG} {LONG}</p></div>", LONG),
        (f"<article><p>{LONG}</p><div class='share-buttons'>x</div><div class='comment-list'><p>{LONG} {LONG} {LONG}</p></div></article>", LONG),
        (f"<div class='comments'><p>{LONG}</p></div><p>text</p>", "text"),
        (f"<nav><p>{LONG}</p></nav>", LONG),
        (f"<div hidden>{LONG}</div><p>x</p>", "x"),
    ],
)
def test_mass_decides_on_claims(page, text):
    assert extract(page) == text


def test_ratios_tell_menus_from_text(monkeypatch):
    page = f"<body><div>Name of the site</div><ul>{LINKS}</ul><p>{LONG}</p><ul>{LINKS}</ul><p>{LONG}</p><p>x</p><ul>{LINKS}</ul></body>"
    part = "\n".join(f"Part {k}" for k in range(5))
    assert extract(page) == f"Name of the site\n{LONG}\n{part}\n{LONG}\nx"
    monkeypatch.setattr(html_extract, "threshold", lambda values: 0.0)
    assert extract(page) == f"Name of the site\n{part}\n{LONG}\n{part}\n{LONG}\nx"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(0, 1000), min_size=1, max_size=30))
def test_smoothing_and_clusters_by_brute_force(values):
    for i, got in enumerate(html_extract.smooth(values)):
        near = [(math.exp(-((i - j) ** 2) / 2), v) for j, v in enumerate(values) if abs(i - j) <= 3]
        assert got == pytest.approx(sum(w * v for w, v in near) / sum(w for w, _ in near))
    cut = html_extract.threshold(values)
    below, above = [v for v in values if v < cut], [v for v in values if v > cut]
    assert min(values) <= cut <= max(values)
    if below and above and cut not in values:
        assert cut == pytest.approx((sum(below) / len(below) + sum(above) / len(above)) / 2)


def shape(pick, depth=0):
    """A random element: (tag, class, text or children)."""
    if depth == 3 or pick.random() < 0.5:
        return ("p", None, " ".join(f"w{pick.randrange(99)}" for _ in range(pick.choice([1, 3, 20, 60]))))
    tag, name = pick.choice([("div", None), ("div", None), ("section", None), ("article", None), ("nav", None), ("footer", None), ("div", "sidebar"), ("div", "comments"), ("form", None)])
    return (tag, name, [shape(pick, depth + 1) for _ in range(pick.randrange(1, 4))])


def written(node):
    tag, name, held = node
    inner = held if isinstance(held, str) else "".join(map(written, held))
    return f"<{tag}{f' class={name}' if name else ''}>{inner}</{tag}>"


def expected(body):
    """The region by the words of the module, with paths instead of nodes."""
    lines, tags = [], [0]

    def walk(node, path):
        tags[0] += 1
        path = (*path, (len(lines), tags[0], node[0], node[1]))
        for child in node[2] if isinstance(node[2], list) else ():
            walk(child, path)
        tags[0] += 1
        if isinstance(node[2], str):
            lines.append((node[2], len(node[2]) / tags[0], path))
            tags[0] = 0

    for node in body:
        walk(node, ())
    if not lines:
        return ""
    # an element is its path up to and with it
    ratios = html_extract.smooth([r for _, r, _ in lines])
    cut = html_extract.threshold(ratios)
    mass = [len(t) if r >= cut else 0 for (t, _, _), r in zip(lines, ratios, strict=True)]
    within = lambda key: [k for k, (_, _, p) in enumerate(lines) if p[: len(key)] == key]
    elements = {p[:n] for _, _, p in lines for n in range(1, len(p) + 1)}
    articles = [key for key in elements if key[-1][2] == "article"]
    claims = lambda e: e[2] in ("nav", "footer", "form") or e[3] is not None
    free = any(not any(map(claims, key)) for key in articles)

    def beside(key):
        _, _, tag, name = key[-1]
        if tag in ("nav", "footer") or name == "comments":
            return True
        if tag == "form" or name == "sidebar":
            heavy = 2 * sum(mass[k] for k in within(key)) >= sum(mass) and sum(mass[k] for k in within(key)) > 0
            return not (heavy and (any(a[: len(key)] == key for a in articles) or not free))
        return False

    aside = [any(beside(p[:n]) for n in range(1, len(p) + 1)) for _, _, p in lines]
    if all(aside):
        aside = [False] * len(lines)
    shown = [k for k in range(len(lines)) if not aside[k]]
    inside = [k for k in shown if any(e[2] == "article" for e in lines[k][2])]
    if inside and 2 * sum(mass[k] for k in inside) >= sum(mass[k] for k in shown):
        shown = inside
    return "\n".join(lines[k][0] for k in shown)


@pytest.mark.parametrize("seed", range(300))
def test_region_by_brute_force(seed):
    pick = random.Random(seed)
    body = [shape(pick) for _ in range(pick.randrange(1, 5))]
    assert extract("".join(map(written, body))) == expected(body)


PARTS = ["<![foo[bar]]>", "<![CDATA[x]]>", "<!", "<!--", "-->", "<p>", "</p>", "<a ", "<a href='x'>", "</a>", ">", "&amp;", "&#0;", "&#x110000;", "&", "text", " ", "<script>", "</script>", "<svg>", "<head>", "<body>", "<table><tr><td>", "<?x?>", "<!DOCTYPE [", "\0", "]]>", "<li>", "'", '"', "=", "/", "<select>", "</div>", "<div hidden>", "<span class=ad>"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PARTS) | st.text(max_size=5), max_size=40))
def test_no_markup_raises(parts):
    assert isinstance(extract("".join(parts)), str)


def test_odd_markup():
    for page, text in [
        ("<![foo[bar]]>x", "x"), ("<![", ""), ("a<![CDATA[x]]>b", "ab"), ("<!-- a", ""), ("x<!-->y", "xy"), ("<a b", ""), ("a < b", "a < b"), ("<p>a</p", "a"),
        ("<div><button>x</div><p>y</p>", "y"), ("<head><title>t<body><p>z", "z"), ("<head><meta><p>z", "z"), ("<svg><title>no</title></svg>t", "t"),
    ]:
        assert extract(page) == text, page


@pytest.mark.parametrize("part", ["<div>x", "<div>", "<span hidden><p>a", "<div></p>x", "<p>a<li>b", "<!--", "<![", "<a ", "<", "&", "<svg></title>"])
def test_depth_costs_no_square(part):
    began = time.perf_counter()
    extract(part * 50_000)
    assert time.perf_counter() - began < 10
