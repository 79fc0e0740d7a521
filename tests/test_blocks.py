"""Pairs of braces against a character by character reading, and their cost on a long text."""

import random
import time

import pytest

from orrery.functions.blocks import Braces


def by_character(text, opening, aware):
    depth, at, quote = 0, opening, ""
    while at < len(text):
        ch = text[at]
        if aware and quote:
            if ch == "\\":
                at += 1
            elif ch == quote:
                quote = ""
        elif aware and ch in "'\"`":
            quote = ch
        elif aware and (ch == "#" or text.startswith("//", at)):
            at = text.find("\n", at)
            if at < 0:
                return -1
        elif aware and text.startswith("/*", at):
            at = text.find("*/", at + 2) + 1
            if not at:
                return -1
        elif ch == "{":
            depth += 1
        elif ch == "}":
            depth -= 1
            if not depth:
                return at + 1
        at += 1
    return -1


@pytest.mark.parametrize("aware", [True, False])
def test_pairs_equal_a_reading_by_character(aware):
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choices(["{", "}", "'", '"', "`", "\\", "//", "/*", "*/", "#", "\n", "a", "/", "*"], k=rng.randrange(40)))
        places = [i for i, ch in enumerate(text) if ch == "{"]
        rng.shuffle(places)
        braces = Braces(text, aware)
        for at in places:
            assert braces.end(at) == by_character(text, at, aware), (text, at)
        for at in range(len(text) + 1):
            assert braces.line(at) == text.count("\n", 0, at) + 1


def test_a_long_text_is_read_once():
    text = "function f() { if (x) { y = '}'; } }\n" * 300_000
    began = time.time()
    braces = Braces(text, True)
    places = range(text.index("{"), len(text), text.index("\n") + 1)
    assert all(braces.end(at) == at + 23 for at in places) and braces.line(len(text)) == 300_001
    assert time.time() - began < 20


def test_quotes_that_don_t_close():
    text = "\"function a(){\" \"function b(){\" it's {} " * 20_000
    braces = Braces(text, True)
    began = time.time()
    assert [braces.end(i) for i in range(len(text)) if text[i] == "{"]
    assert time.time() - began < 20
