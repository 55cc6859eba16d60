"""What is prose in a document: its language, its sentences and their words.

Fenced code, headings and list marks are set aside, hard-wrapped lines joined, sentences split at their ends or at
list items and paragraphs. A word has letters alone; dotted, camel-cased or path-like names count as names, not words.
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: Frequent function words, by which the language is told and prose from code.
FUNCTION_WORDS = {
    "en": frozenset("the a an of to in is it and that was for on are with as be this by not from at or has have which no must can its any but if were been than who you your we do one when so because".split()),
    "de": frozenset("der die das und ist in den von zu mit sich des auf für nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über dem war zum kam wir wenn".split()),
    "es": frozenset("el la de que y en un una los las se del por con no es al lo como más para su sus le ya este esta o pero sin sobre está son entre cuando fue ser hay".split()),
}
#: A text is prose if it has at least so many words, this share of them function words of its language, and less
#: than so many signs of code for each word.
MIN_WORDS, MIN_SHARE, MAX_CODE = 50, 0.08, 0.4

_FENCE = re.compile(r"(?ms)^\s*```.*?(?:^\s*```\s*?$|\Z)")
_HEADING = re.compile(r"(?m)^[ \t]*#{1,6}[ \t][^\n]*$")
_BREAK = re.compile(r"\n\s*\n|\n\s*(?:[-*•+]|\d+[.)])\s+|\n(?=#)")
_END = re.compile(r"(?<=[.!?…])[\"')\]»”]*\s+")
_TOKEN = re.compile(r"[^\s]+")
_EDGE = ".,;:!?()[]{}\"'`“”„‘’«»…*_<>"
_CODE = re.compile(r"[{}();=<>\"]")
_LETTERS = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")


class Prose(NamedTuple):
    lang: str | None
    n_words: int
    #: words of each sentence, lower case
    sentences: list[list[str]]


def _words(sentence: str) -> list[str]:
    out = []
    for t in _TOKEN.findall(sentence):
        w = t.strip(_EDGE)
        if w and _LETTERS.fullmatch(w) and not (any(c.isupper() for c in w[1:]) and not w.isupper()):
            out.append(w.lower())
    return out


def read_prose(text: str | None) -> Prose:
    """The prose of a text; language None and no level where it is not prose of at least MIN_WORDS words. Null and empty texts have none."""
    if not text:
        return Prose(None, 0, [])
    body = _FENCE.sub("\n\n", text.replace("\r\n", "\n").replace("\r", "\n"))
    body = _HEADING.sub("\n", body)
    sentences = []
    for block in _BREAK.split("\n" + body):
        block = block.strip()
        if not block or block.startswith("#"):
            continue
        for s in _END.split(" ".join(block.split())):
            if w := _words(s):
                sentences.append(w)
    words = [w for s in sentences for w in s]
    n = len(words)
    if n < MIN_WORDS or len(_CODE.findall(body)) >= MAX_CODE * n:
        return Prose(None, n, sentences)
    share = {lang: sum(w in f for w in words) / n for lang, f in FUNCTION_WORDS.items()}
    lang = max(share, key=share.get)
    return Prose(lang if share[lang] >= MIN_SHARE else None, n, sentences)
