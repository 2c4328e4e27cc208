"""Pages on which class words and tags mislead, and the scan against all runs of tokens."""

import random

import pytest

from tileloom.llm import html_text

BODY = "".join(f"<p>{' '.join(f'word{k}x{j}' for j in range(30))}.</p>" for k in range(6))
TEXT = "\n\n".join(" ".join(f"word{k}x{j}" for j in range(30)) + "." for k in range(6))
WEIGHTS = html_text.weights_of({("word", "p", True): 900, ("word", "p", False): 9, ("word", "li", True): 5, ("word", "li", False): 90,
                                ("tag", "p", True): 40, ("tag", "p", False): 60, ("tag", "li", True): 2, ("tag", "li", False): 80, ("tag", "div", True): 5, ("tag", "div", False): 60})
MENU = "<nav><ul><li><a>Home</a></li><li><a>News</a></li></ul></nav>"


@pytest.mark.parametrize("wrapper", ['div class="layout has-sidebar"', 'div class="single-post comments-open"', 'div id="search-results"', 'section class="post no-comments"', 'div class="search"', "form", 'div class="social"'])
def test_wrappers_keep_the_page(wrapper):
    page = f"<html><body>{MENU}<{wrapper}>{BODY}</{wrapper.split()[0]}><footer>Imprint</footer></body></html>"
    assert html_text.main_text(page, WEIGHTS) == TEXT


@pytest.mark.parametrize("element", ['div class="ad"', 'div class="ad-slot"', 'div class="share-bar"', 'aside', 'div id="comments"', 'section class="related posts"', 'div class="cookie_notice"', 'div class="newsletter-signup-box"', 'form', 'div role="complementary"', 'div class="sidebar2"', 'nav', 'div hidden'])
def test_asides_go(element):
    tag = element.split()[0]
    parts = BODY.split("</p>")
    page = f"<body>{MENU}<article>{'</p>'.join(parts[:3])}</p><{element}><p>Buy this now, friend</p></{tag}>{'</p>'.join(parts[3:])}</article></body>"
    assert html_text.main_text(page, WEIGHTS) == TEXT


def test_sections_named_like_asides_and_formulas_stay():
    page = f'<article>{BODY}<section class="social-science"><p>Findings of social science here.</p></section><p>before <math><mi>x</mi>=42</math> after</p></article>'
    got = html_text.main_text(page, WEIGHTS)
    assert got == TEXT + "\n\nFindings of social science here.\n\nbefore x=42 after"


def best_run(page, weights):
    """The region of all runs of tokens with the greatest sum; the first of equal ones."""
    found = html_text.tokens(page)
    scores = [weights.get((k, n if n in html_text.KNOWN else "other"), 0.5 if k == "word" else -0.5) * (len(t.split()) if k == "word" else 1) for k, n, t, _, _ in found]
    best, where = 0.0, (0, 0)
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best + 1e-9:
                best, where = total, (i, j + 1)
    blocks = {}
    for kind, _, text, block, _ in found[slice(*where)]:
        if kind == "word":
            blocks.setdefault(block, []).append(text)
    return "\n\n".join(filter(None, (" ".join("".join(x).split()) for x in blocks.values())))


def test_scan_equals_the_best_of_all_runs():
    rnd = random.Random(9)
    tags = ["p", "li", "div", "a", "b", "section", "x-new", "br", "hr", "h2"]
    for _ in range(150):
        page = ""
        for _ in range(rnd.randint(0, 40)):
            t = rnd.choice(tags)
            page += rnd.choice([f"<{t}>", f"</{t}>", " ".join(f"t{rnd.randrange(99)}" for _ in range(rnd.randint(1, 6))), " "])
        weights = {(k, n): rnd.uniform(0.1, 2) if k == "word" else -rnd.uniform(0.1, 4) for k in ("word", "tag") for n in [*tags, "other", "body"]}
        assert html_text.main_text(page, weights) == best_run(page, weights)
