"""License scans by template markup.

A template is the wording of a license, lower-cased words, with two kinds of
markup: `[...]` is optional, `{n}` may be replaced by up to n words (names,
years); `one|other` are spellings of one word. All templates are compiled into
one token automaton: a state waits for a word, and knows which states or
acceptances follow it, optional regions and replaceable ones resolved
beforehand. A text is read once, word by word, with the states that are alive
and the earliest start that leads to each. So a template is accepted wherever
its mandatory wording stands exactly, whatever fills its regions, and the work
grows with the text alone. Phrases are templates without markup.

The automaton reads bytes: words are what `[0-9a-z]` and bytes over 127 make
up. Long texts are read in pieces that end between words; the states live on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Phrases that name a license, and the labels that they give.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

GRANT = "[this work|file|program|software|code is] released|licensed|distributed|available under"
#: Wordings of licenses and notices, and the labels that they give.
TEMPLATES = (
    ("mit", f"{GRANT} the [terms of the] mit license|licence"),
    ("mit", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction
        including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so
        subject to the following conditions the above copyright notice and this permission notice [including the next paragraph] shall be included in all copies or substantial portions of the software
        the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
        in no event shall {12} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"""),
    ("apache-2.0", f"{GRANT} the [terms of the] apache license|licence version 2 0"),
    ("apache-2.0", """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at [http|https www apache org licenses license 2 0]
        unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"""),
    ("gpl-3.0", f"{GRANT} the [terms of the] gnu general public license|licence [as published by the free software foundation] [either] version 3"),
    ("gpl-2.0", f"{GRANT} the [terms of the] gnu general public license|licence [as published by the free software foundation] [either] version 2"),
    ("gpl-or-later", """is free software you can redistribute it and or modify it under the terms of the gnu [lesser|affero] general public license as published by the free software foundation
        either version 2|3 of the license or at your option any later version"""),
    ("bsd", """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [1] redistributions of source code must retain the above copyright notice
        this list of conditions and the following disclaimer [2] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials
        provided with the distribution [[3] neither the name of {12} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission]
        this software is provided by {12} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"""),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc-by-nc", f"{GRANT} [a|the] cc|creative [commons] by|attribution nc|noncommercial [2|3|4 0]"),
    ("cc-by", f"{GRANT} [a|the] cc|creative [commons] by|attribution 2|3|4 0"),
    ("cc0", "[this work is] released|licensed|dedicated under|to [the] cc0 [1 0] [universal]"),
    ("all-rights-reserved", "[copyright [c] {8}] all rights reserved"),
)

#: Bytes of a text that are split into words at a time.
PIECE = 1 << 20
#: A-Z lower-cased, everything that isn't part of a word a space.
PLAIN = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))
SPACED = str.maketrans({c: f" {c} " for c in "[]{}"})


def parsed(markup: str) -> list[tuple]:
    """A template as a list of ("word", spellings), ("any", n) and ("optional", such a list)."""
    tokens = iter(markup.translate(SPACED).split())

    def sequence(inside: bool) -> list[tuple]:
        items = []
        for token in tokens:
            if token == "]" and inside:
                return items
            if token == "[":
                items.append(("optional", sequence(True)))
            elif token == "{":
                items.append(("any", int(next(tokens))))
                if next(tokens, None) != "}":
                    raise ValueError(f"{{ without }} in {markup!r}")
            elif token in "]}":
                raise ValueError(f"{token} opens nothing in {markup!r}")
            else:
                items.append(("word", tuple(token.split("|"))))
        if inside:
            raise ValueError(f"[ without ] in {markup!r}")
        return items

    return sequence(False)


def as_regex(markup: str) -> str:
    """The same wording as a regular expression over words that each have a space before and after them."""

    def written(items: list[tuple]) -> str:
        out = ""
        for kind, value in items:
            out += f" (?:{'|'.join(value)})" if kind == "word" else f"(?: [^ ]+){{0,{value}}}" if kind == "any" else f"(?:{written(value)})?"
        return out

    return written(parsed(markup)) + " "


class Automaton:
    """All templates at once. A negative follower ~t accepts template t."""

    def __init__(self, templates: list[str]):
        self.spellings: list[frozenset[bytes] | None] = []
        self.followers: list[tuple[int, ...]] = []
        self.first: dict[bytes, tuple[int, ...]] = {}
        for number, markup in enumerate(templates):
            for state in self._entry(parsed(markup), frozenset({~number})):
                if state < 0 or self.spellings[state] is None:
                    raise ValueError(f"{markup!r} doesn't begin with a word")
                for word in self.spellings[state]:
                    self.first[word] = (*self.first.get(word, ()), state)

    def _state(self, spellings: tuple[str, ...] | None, after: frozenset[int]) -> frozenset[int]:
        self.spellings.append(None if spellings is None else frozenset(s.encode() for s in spellings))
        self.followers.append(tuple(sorted(after)))
        return frozenset({len(self.followers) - 1})

    def _entry(self, items: list[tuple], after: frozenset[int]) -> frozenset[int]:
        """The states that wait for the first word of the items; after: those behind them."""
        for kind, value in reversed(items):
            if kind == "word":
                after = self._state(value, after)
            elif kind == "optional":
                after |= self._entry(value, after)
            else:
                beyond = after
                for _ in range(value):
                    after = self._state(None, after) | beyond
        return after


class Scan:
    """One text's way through an automaton, piece by piece."""

    def __init__(self, automaton: Automaton):
        self.automaton, self.alive, self.n = automaton, {}, 0
        self.found: list[tuple[int, int, int]] = []  # template, start, stop

    def read(self, words: list[bytes]) -> None:
        first, spellings, followers = self.automaton.first, self.automaton.spellings, self.automaton.followers
        starts, alive, i = iter([i for i, word in enumerate(words) if word in first]), self.alive, 0
        ahead = next(starts, len(words))
        while i < len(words):
            if not alive and i < ahead:
                i = ahead  # nothing is alive and nothing begins before
                continue
            word, after, ends = words[i], {}, {}
            steps = [(state, start) for state, start in alive.items() if spellings[state] is None or word in spellings[state]]
            if i == ahead:
                steps += [(state, self.n + i) for state in first[word]]
                ahead = next(starts, len(words))
            for state, start in steps:
                for follower in followers[state]:
                    into, key = (after, follower) if follower >= 0 else (ends, ~follower)
                    into[key] = min(start, into.get(key, start))
            self.found += [(template, start, self.n + i + 1) for template, start in ends.items()]
            alive, i = after, i + 1
        self.alive, self.n = alive, self.n + len(words)


def pieces(raw: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, a piece at a time; a word longer than a piece makes its piece longer."""
    start = 0
    while start < len(raw):
        stop, cut = start + size, -1
        while cut < 0:
            plain = raw[start:stop].translate(PLAIN)
            cut = len(plain) if stop >= len(raw) else plain.rfind(b" ")
            stop += stop - start
        yield plain[:cut].split()
        start += max(cut, 1)


@dataclass(frozen=True)
class Licenses:
    """phrases: wording and label of what counts as base; templates: label and markup."""

    phrases: tuple[tuple[str, str], ...] = tuple(PHRASES.items())
    templates: tuple[tuple[str, str], ...] = TEMPLATES


SPANS = "doc_id bigint, n_words bigint, spans array<struct<label: string, start: bigint, stop: bigint, base: boolean>>"


def scan(docs: DataFrame, licenses: Licenses = Licenses()) -> DataFrame:
    """A row for each row of docs: doc_id, n_words and spans, which are label, start, stop (words from 0, stop beyond the last) and base (a phrase, no template).

    Of the places of a template that end at one word the longest is given. A
    null text is empty and has no words. Rows without a doc_id and repeated
    ones are scanned like others; an empty table gives no rows; columns other than doc_id and text take no part.
    """
    labels = [(label, True) for _, label in licenses.phrases] + [(label, False) for label, _ in licenses.templates]
    markups = [phrase for phrase, _ in licenses.phrases] + [markup for _, markup in licenses.templates]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = Automaton(markups)
        for frame in frames:
            counts, spans = [], []
            for raw in frame["text"]:
                one = Scan(automaton)
                for words in pieces(raw):
                    one.read(words)
                counts.append(one.n)
                spans.append([(labels[t][0], start, stop, labels[t][1]) for t, start, stop in sorted(one.found, key=lambda x: (x[1:], x[0]))])
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "n_words": counts, "spans": spans})

    return text_of(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInPandas(run, SPANS)


def digests(found: DataFrame) -> DataFrame:
    """n_words, n_base, first_word, last_word, base_labels, labels and score of what scan found: 1 for a whole template, 0.5 for a phrase alone, else 0."""
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["start"])
    listed = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    score = F.when(F.size("spans") > F.size(base), 1.0).when(F.size(base) > 0, 0.5).otherwise(0.0)
    return found.select("doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), listed(base).alias("base_labels"), listed("spans").alias("labels"), score.alias("score"))
