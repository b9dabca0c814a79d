"""Pages whose furniture has no telling names: densities alone clean them."""

import random

import pytest

from loomkb.llm import html_extract

WORDS = "river stone winter letter garden window silver market morning bridge paper candle mountain harbour silence".split()


def prose(rng, chars):
    out = ""
    while len(out) < chars:
        out += rng.choice(WORDS) + rng.choice([" ", " ", " ", ", ", ". "])
    return out.strip(" ,.") + "."


def links(rng, n):
    return "".join(f"<li><a href='/{i}'>{rng.choice(WORDS)} {rng.choice(WORDS)}</a></li>" for i in range(n))


def page(seed):
    """(html, blocks of its article): plain divs around article, menu, sidebar, comments and notice."""
    rng = random.Random(seed)
    title = prose(rng, 30)
    paragraphs = [prose(rng, rng.randrange(120, 500)) for _ in range(rng.randrange(4, 12))]
    body = f"<h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs)
    menu = f"<div><ul>{links(rng, 8)}</ul></div>"
    sidebar = f"<div><div>{rng.choice(WORDS)}</div><ul>{links(rng, 6)}</ul><div>{prose(rng, 25)} <a href=x>more</a></div></div>"
    comments = "<div>" + "".join(f"<div><span><a href=u>{rng.choice(WORDS)}{i}</a></span> <span>{i} days ago</span><div>{prose(rng, rng.randrange(20, 90))}</div><a href=r>reply</a></div>" for i in range(rng.randrange(2, 9))) + "</div>"
    notice = f"<div>{prose(rng, 50)} <a href=a>Accept</a> <a href=b>Settings</a></div>"
    short = f"<div><div>{prose(rng, 30)}</div></div>"
    around = [sidebar, comments, notice, short]
    rng.shuffle(around)
    wrapped = f"<div>{menu}<div>{body}</div>{''.join(around)}</div>" if seed % 2 else f"{menu}{notice}<div>{body}</div>{''.join(around)}"
    return f"<html><body>{wrapped}</body></html>", [title, *paragraphs]


@pytest.mark.parametrize("seed", range(40))
def test_furniture_without_names_goes(seed):
    html, want = page(seed)
    assert html_extract.main_text(html).split("\n\n") == want


def test_without_densities_the_furniture_stays(monkeypatch):
    pages = [page(seed) for seed in range(40)]
    monkeypatch.setattr(html_extract, "composite", lambda c, *_: 1.0 if c else 0.0)
    changed = sum(html_extract.main_text(html).split("\n\n") != want for html, want in pages)
    assert changed == len(pages)


def test_words_in_classes_are_no_verdict(monkeypatch):
    """The same results without any word that hints."""
    monkeypatch.setattr(html_extract, "HINT_WORDS", frozenset())
    for seed in range(40):
        html, want = page(seed)
        assert html_extract.main_text(html).split("\n\n") == want


RNG = random.Random(7)
STORY = [prose(RNG, 250) for _ in range(5)]
BODY = "".join(f"<p>{p}</p>" for p in STORY)
LEGAL = prose(RNG, 200)


@pytest.mark.parametrize("tag", ["article", "div", "main"])
def test_parts_of_the_article_stay(tag):
    def blocks(inner):
        return html_extract.main_text(f"<body><div><a href=x>menu</a> <a href=y>more</a></div><{tag}>{BODY}{inner}</{tag}><div>end</div></body>").split("\n\n")

    assert blocks(f"<div class='legal'>{LEGAL}</div>") == [*STORY, LEGAL]
    assert blocks("<ul><li><a href=a>First source</a></li><li><a href=b>Second source</a></li></ul>") == [*STORY, "First source", "Second source"]
    assert blocks("<p>Press <button>key</button> and <label>wait</label>.</p>") == [*STORY, "Press key and wait."]
    assert blocks("<p>Short.</p><h2>Head</h2><table><tr><td>1<td>2</table>") == [*STORY, "Short.", "Head", "1", "2"]
    assert blocks("<ol><li>one<li>two<li>three<li>four</ol>") == [*STORY, "one", "two", "three", "four"]


@pytest.mark.parametrize("tag", ["article", "div", "main"])
def test_furniture_inside_the_article_goes(tag):
    related = "".join(f"<li><a href={i}>Another story {i}</a></li>" for i in range(6))
    thread = "".join(f"<div><div>name{i}</div><div>I think so {i}.</div></div>" for i in range(5))
    inner = f"<div class=share><button>Share</button></div><ul>{related}</ul><form><label>Mail</label><input></form><div>{thread}</div><div class=ad>Buy now</div><nav><a href=q>next page</a></nav>"
    assert html_extract.main_text(f"<body><{tag}>{BODY}{inner}</{tag}></body>").split("\n\n") == STORY


def test_an_article_in_parts():
    parts = [prose(RNG, 300) for _ in range(6)]
    halves = ["".join(f"<p>{p}</p>" for p in parts[i : i + 3]) for i in (0, 3)]
    got = html_extract.main_text(f"<body><div><div>{halves[0]}</div><div>{halves[1]}</div></div><div>{'<a href=x>menu</a> ' * 5}</div></body>")
    assert got.split("\n\n") == parts


def test_a_long_text_overrules_an_article_element():
    teaser = "<article><p>Read our other story.</p></article>"
    assert html_extract.main_text(f"<body>{teaser}<div>{BODY}</div></body>").split("\n\n") == STORY


def test_of_equal_sums_the_first_counts():
    half = f"<div><p>{STORY[0]}</p><p>{STORY[1]}</p></div>"
    root = html_extract.parse(f"<body><div>{half}</div><div>{half.replace('p>', 'h4>')}</div></body>")
    article, above, _ = html_extract.main_node(html_extract.densities(root))
    first = root.nodes()[0].nodes()[0].nodes()[0]
    assert article is first and above[-1] is root
