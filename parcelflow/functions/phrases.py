"""A small grammar of phrases, for normalised text with a blank at both ends.

A phrase is a string of words, a list of phrases to choose from, or made of others: ``then`` puts phrases one after
another, ``maybe`` lets one be left out, ``upto`` repeats one. Every word is matched whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column


@dataclass(frozen=True)
class Phrase:
    #: What matches the phrase, each word with the blank behind it.
    pattern: str


#: A number in digits.
NUMBER = Phrase("[0-9]+ ")


def phrase(value: str | list | Phrase) -> Phrase:
    if isinstance(value, Phrase):
        return value
    if isinstance(value, str):
        return Phrase("".join(f"{word} " for word in value.split()))
    return Phrase(f"(?:{'|'.join(phrase(v).pattern for v in value)})")


def then(*parts: str | list | Phrase) -> Phrase:
    return Phrase("".join(phrase(p).pattern for p in parts))


def maybe(*parts: str | list | Phrase) -> Phrase:
    return Phrase(f"(?:{then(*parts).pattern})?")


def upto(times: int, part: str | list | Phrase) -> Phrase:
    return Phrase(f"(?:{phrase(part).pattern}){{0,{times}}}")


def says(text: Column, value: str | list | Phrase) -> Column:
    """Whether padded text holds the phrase."""
    return text.rlike(f" {phrase(value).pattern}")
