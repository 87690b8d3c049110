"""Texts of a megabyte that once took the square of their length, and the same results as plain patterns on short ones."""

import random
import re
import time

import pytest

from chronika.llm import html_text, token_counts

N = 1_000_000
OLD_MARKUP = re.compile(html_text.MARKUP.pattern, re.S)


@pytest.mark.parametrize("text", ["a" * N, "1" * N, "a." * (N // 2), "a@" * (N // 2), "@" * N, "a@b" * (N // 3), "1(" * (N // 2), "1.1." * (N // 4), "_" * N, "é" * N, "a1" * (N // 2)])
def test_masks_take_linear_time(text):
    began = time.perf_counter()
    token_counts.mask_edits(text)
    assert time.perf_counter() - began < 2


@pytest.mark.parametrize("page", ["<!" * (N // 2), "<?" * (N // 2), "<!--" * (N // 4), "<" * N, "<a " * (N // 3), "<a \"" * (N // 4), "<! <? '" * (N // 7), "<p>" * 1000 + "<!" * (N // 2), "<!" * (N // 2) + ">", "&" * N])
def test_pages_take_linear_time(page):
    began = time.perf_counter()
    html_text.build(page)
    assert time.perf_counter() - began < 2


def test_addresses_equal_a_plain_pattern():
    plain = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+")
    rng = random.Random(2)
    for _ in range(20_000):
        text = "".join(rng.choice("ab.@+- é1") for _ in range(rng.randrange(24)))
        assert [m.span() for m in plain.finditer(text)] == list(token_counts.emails(text)), text


def test_markup_is_found_as_by_a_plain_search():
    rng = random.Random(3)
    parts = ["<!", "<!--", "-->", ">", "<?", "<p>", "</p>", "a", " ", '"', "'", "<b x=", "<br>", "--", "-", "<"]
    for _ in range(20_000):
        page = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        at, last, found = 0, page.rfind(">") + 1, []
        while True:
            m, until, after = html_text.next_markup(page, at, last)
            found.append(page[at:until])
            if not m:
                break
            at = after
        want, at = [], 0
        while m := OLD_MARKUP.search(page, at):
            want.append(page[at : m.start()])
            at = m.end()
        want.append(page[at:])
        assert [x for x in found if x] == [x for x in want if x], page
