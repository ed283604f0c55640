"""Names of boilerplate beside names of subjects: the text decides; short articles side by side are whole."""

import pytest

from docloom.llm.html import extract, parse

PROSE = "The council met on Monday to discuss the new harbour. It agreed on a budget, and on further talks in autumn. "


def article(name, text):
    return f"<html><body><nav>a b</nav><article><h1>Head</h1><p>{PROSE * 3}</p><div class='{name}'><p>{text}</p></div><p>{PROSE * 2}</p></article></body></html>"


@pytest.mark.parametrize("name", ["ad-hoc", "menu-history", "article-notice", "related-work", "promo-intro", "social-contract"])
def test_subjects_stay(name):
    text = "Menus of the old inns were written by hand in ink on boards."
    assert text in extract(parse(article(name, text)), None)


@pytest.mark.parametrize("name", "ad ads ad-slot comments comment-list user-comments cookie-notice newsletter-signup share-buttons related-posts menu site-nav gdpr-policy-popup notice-bar promo sponsored-content social-links".split())
def test_boilerplate_goes(name):
    assert "Subscribe" not in extract(parse(article(name, "Subscribe now and save a lot of money today.")), None)


def test_link_lists_go_whatever_their_name():
    links = "".join(f"<a href='/{k}'>An old story about ferries no. {k}.</a> " for k in range(5))
    assert "ferries" not in extract(parse(article("related-work", links)), None)


def test_prose_under_a_name_of_comments():
    page = f"<html><body><div class='main'><h1>x</h1><p>{PROSE * 3}</p><div class='comments-on-the-law'><p>{PROSE}</p></div></div></body></html>"
    assert extract(parse(page), None).count("council") == 4


def test_briefs_stay_and_teasers_go():
    brief = "Brief number {} says that the ferry will leave at noon from the pier, and that the crew asks all guests to be there in good time."
    five = "".join(f"<article{' class=own' if k == 3 else ''}><p>{brief.format(k)}</p></article>" for k in range(5))
    got = extract(parse(f"<html><body><main>{five}</main></body></html>"), None)
    assert all(f"number {k} " in got for k in range(5))
    got = extract(parse(f"<html><body><article><p>{PROSE * 20}</p></article><article class='card'><p>{brief.format(9)}</p></article></body></html>"), None)
    assert "number 9" not in got and "council" in got
