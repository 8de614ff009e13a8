"""License scan: matching statistics of texts against a generalised suffix automaton of licence templates."""

from __future__ import annotations

import itertools
import re
from importlib import resources
from importlib.resources.abc import Traversable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import slices, text_bytes, words
from callweave.session import fill_slots

# Phrases whose places are counted, opening passages of public licences, and short notices with their variants.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]
NOTICES = [
    ("mit", "Licensed under the MIT License"), ("mit", "This project is licensed under the terms of the MIT license"),
    ("apache", "Licensed under the Apache License 2.0"), ("isc", "Licensed under the ISC License"), ("isc", "Released under the ISC License"),
    ("bsd", "Licensed under the BSD License"), ("bsd", "Released under the BSD License"), ("bsd", "BSD 2-Clause License"), ("bsd", "BSD 3-Clause License"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("lgpl", "GNU Lesser General Public License"), ("lgpl", "GNU Library General Public License"), ("agpl", "GNU Affero General Public License"), ("gpl", "Use with the GNU Affero General Public License"),
    ("mpl", "Mozilla Public License"), ("epl", "Eclipse Public License"), ("epl", "made available under the terms of the Eclipse Public License"),
    ("unlicense", "Released under the Unlicense"), ("unlicense", "released into the public domain under the Unlicense"),
    ("cc0", "CC0 1.0 Universal"), ("cc0", "Creative Commons Zero"), ("bsl", "Boost Software License"),
]
# Creative Commons variants: (short form, spellings of the long form); each pair of them is a template of its own.
_CC = {
    "cc-by": ("CC BY", ["Attribution"]),
    "cc-by-sa": ("CC BY-SA", ["Attribution-ShareAlike", "Attribution-Share Alike"]),
    "cc-by-nd": ("CC BY-ND", ["Attribution-NoDerivatives", "Attribution-NoDerivs", "Attribution-No Derivatives"]),
    "cc-by-nc": ("CC BY-NC", ["Attribution-NonCommercial", "Attribution-Non-Commercial"]),
    "cc-by-nc-sa": ("CC BY-NC-SA", ["Attribution-NonCommercial-ShareAlike", "Attribution-Non-Commercial-Share Alike"]),
    "cc-by-nc-nd": ("CC BY-NC-ND", ["Attribution-NonCommercial-NoDerivatives", "Attribution-NonCommercial-NoDerivs", "Attribution-Non-Commercial-No Derivatives"]),
}
# Words that tell variants apart. Templates of fewer than NOTICE words need the same ones as the text at their place.
TELLING = {
    "noncommercial", "commercial", "nc", "sharealike", "alike", "sa", "noderivatives", "noderivs", "derivatives", "derivs", "nd", "lesser", "library", "affero",
}
NOTICE = 40
# Of two templates at one place, a missing word of the one outweighs so many matched words.
MISSING = 5
# Paragraphs of whole licences with fewer words are no templates; a gap is at most one word in so many of the template.
MIN_PARAGRAPH, GAP_EVERY = 12, 5
MIN_MATCH, MAX_GAP, MIN_COVER = 3, 6, 0.8
TEXTS = resources.files("callweave.llm") / "license_texts"
_PARAGRAPH = re.compile(r"\n\s*\n|\n(?=\s*(?:\d+\.|\(?[a-z0-9]{1,3}\)|\*)\s)")
_ENUMERATOR = re.compile(r"^\s*(?:\d+(?:\.\d+)*\.|\(?[a-z0-9]{1,3}\)|\*)\s+")


def paragraphs(texts: Traversable = TEXTS) -> list[tuple[str, str]]:
    """(label, paragraph) of the whole licences, also out of a zipped package; a file is named by its label, and by a version where there are several."""
    out = []
    found = sorted((p for p in texts.iterdir() if p.name.endswith(".txt")), key=lambda p: p.name)
    if not found:
        raise FileNotFoundError(f"no licence texts in {texts}")
    for path in found:
        for part in _PARAGRAPH.split(path.read_text("utf-8")):
            part = _ENUMERATOR.sub("", part)
            if len(words(part.encode())) >= MIN_PARAGRAPH and not re.match(r"\s*copyright", part, re.IGNORECASE):
                out.append((re.sub(r"-[\d.]+$", "", path.name.removesuffix(".txt")), part))
    return out


def all_templates() -> list[tuple[str, str]]:
    """Opening passages, notices, the Creative Commons variants and every paragraph of the whole licences."""
    out = TEMPLATES + NOTICES
    for label, (short, forms) in _CC.items():
        out = out + [(label, f"{short} {v}") for v in ("4.0", "3.0")] + [(label, f"Licensed under {short} {v}") for v in ("4.0", "3.0")]
        for form, v in itertools.product(forms, ("4.0 International", "3.0 Unported")):
            out = out + [(label, f"Creative Commons {form} {v}"), (label, f"This work is licensed under a Creative Commons {form} {v} License")]
    return out + paragraphs()


class Automaton:
    """Generalised suffix automaton over the templates' words.

    Each state knows where its words end in the templates: a list of (template, last word)."""

    def __init__(self, templates: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        for t, sequence in enumerate(templates):
            last = 0
            for i, c in enumerate(sequence):
                last = self._extend(last, c, ends)
                ends[last].append((t, i))
        # What ends in a state also ends in the state its suffix link leads to.
        gathered = [set(e) for e in ends]
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            gathered[self.link[s]] |= gathered[s]
        self.ends = [sorted(g) for g in gathered]
        self.ends[0] = []

    def _new(self, ends, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        ends.append([])
        return len(self.next) - 1

    def _extend(self, last: int, c: int, ends) -> int:
        known = self.next[last].get(c)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            return self._split(last, c, known, ends)
        state = self._new(ends, self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q, ends)
        return state

    def _split(self, p: int, c: int, q: int, ends) -> int:
        """A copy of ``q`` for the shorter words that reach it through ``p``."""
        copy = self._new(ends, self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def statistics(self, sequence: list[int]) -> list[tuple[int, int]]:
        """For each place the length of the longest match that ends there, and its state."""
        out, state, n = [], 0, 0
        for c in sequence:
            while state and c not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            state = self.next[state].get(c, 0)
            n = n + 1 if state else 0
            out.append((n, state))
        return out


class Scanner:
    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str], min_match: int, max_gap: int):
        self.ids: dict[bytes, int] = {}
        known: dict[tuple[int, ...], set[str]] = {}
        for label, text in templates:
            known.setdefault(tuple(self._numbered(text)), set()).add(label)
        # A passage that several licences share word for word is one template with all their labels.
        self.templates, self.labels = [list(t) for t in known], [sorted(x) for x in known.values()]
        self.phrases = [(label, self._numbered(p)) for p, label in phrases.items()]
        self.telling = {self.ids[w] for w in (x.encode() for x in TELLING) if w in self.ids}
        self.automaton = Automaton(self.templates)
        self.min_match = min_match
        self.gaps = [min(max_gap, len(t) // GAP_EVERY) for t in self.templates]

    def _numbered(self, text: str) -> list[int]:
        return [self.ids.setdefault(w, len(self.ids) + 1) for w in words(text.encode())]

    def places(self, ids: np.ndarray) -> list[tuple[int, str]]:
        """(start, label) of every place of a phrase."""
        out = []
        for label, phrase in self.phrases:
            if len(ids) >= len(phrase):
                here = np.ones(len(ids) - len(phrase) + 1, bool)
                for i, c in enumerate(phrase):
                    here &= ids[i : len(here) + i] == c
                out += [(int(s), label) for s in np.flatnonzero(here)]
        return sorted(out)

    def _within(self, state: int, n: int) -> dict[tuple[int, int], int]:
        """(template, last word) -> words of the longest match with that end, for a place whose longest match of all is ``n`` words in ``state``."""
        out: dict[tuple[int, int], int] = {}
        while state > 0 and n >= self.min_match:
            for end in self.automaton.ends[state]:
                out.setdefault(end, n)
            state = self.automaton.link[state]
            n = self.automaton.length[state]
        return out

    def matches(self, ids: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(least first word from here on, first word, words, template, its last word) of the matches that cannot be extended in their template."""
        known = np.r_[False, ids > 0, False].astype(np.int8)
        edge = np.flatnonzero(np.diff(known))
        out = []
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a < self.min_match:
                continue
            here: dict[tuple[int, int], int] = {}
            before = 0
            for i, (n, state) in enumerate([*self.automaton.statistics(ids[a:b].tolist()), (0, 0)]):
                now = self._within(state, n)
                for (t, last), m in here.items():
                    if (t, last + 1) not in now:
                        out.append((a + i - before, a + i - m, m, t, last))
                here, before = now, n
        return out

    def _told(self, ids: np.ndarray, t: int, chain: tuple) -> bool:
        """Whether the text at the place of a notice, what the chain misses at its ends included, has the notice's telling words."""
        template = self.templates[t]
        if len(template) >= NOTICE:
            return True
        a, b = max(0, chain[0] - chain[4]), chain[1] + len(template) - chain[2]
        return self.telling & set(ids[a:b].tolist()) == self.telling & set(template)

    def spans(self, ids: np.ndarray, min_cover: float) -> tuple[list[tuple[str, int, int, float]], float]:
        """(label, start, end, cover) of the best covering templates, and the best cover of any.

        Spans are chains of matches in the order of one template, with few words between them. Of chains that overlap the one with
        the most matched words stays, where a missing word takes ``MISSING`` of them away; short notices give way to paragraphs. A passage of several licences gets the labels among them that
        another span of the text has to itself, else all of them.
        """
        open_: dict[int, dict[tuple[int, int], tuple]] = {}  # template -> (doc end, template end) -> (start, end, template end, matched, template start)
        most, whole = 0.0, {}
        for least, start, n, t, last in self.matches(ids):
            first, size = last - n + 1, len(self.templates[t])
            chains, best = open_.setdefault(t, {}), None
            for at in [at for at in chains if at[0] + self.gaps[t] < least]:  # these cannot grow any more
                del chains[at]
            for chain in chains.values():
                if chain[1] <= start and first >= chain[2] and (best is None or chain[3] > best[3]):
                    best = chain
            grown = (best[0], start + n, last + 1, best[3] + n, best[4]) if best else (start, start + n, last + 1, n, first)
            old = chains.get(grown[1:3])
            if old is None or old[3] < grown[3]:
                chains[grown[1:3]] = grown
            cover = min(1.0, grown[3] / size)
            if (cover > most or cover >= min_cover) and self._told(ids, t, grown):
                most = max(most, cover)
                if cover >= min_cover and (t, grown[0]) not in whole or cover >= min_cover and whole[t, grown[0]][3] < grown[3]:
                    whole[t, grown[0]] = grown
        taken, kept = np.zeros(len(ids), bool), []

        def worth(found):
            (t, _), chain = found
            missing = len(self.templates[t]) - chain[3]
            return len(self.templates[t]) < MIN_PARAGRAPH, MISSING * missing - chain[3], chain[0], t

        for (t, _), chain in sorted(whole.items(), key=worth):
            if not taken[chain[0] : chain[1]].any():
                taken[chain[0] : chain[1]] = True
                kept.append((t, chain))
        alone = {self.labels[t][0] for t, _ in kept if len(self.labels[t]) == 1}
        out = []
        for t, chain in kept:
            for label in [x for x in self.labels[t] if x in alone] or self.labels[t]:
                out.append((label, chain[0], chain[1], chain[3] / len(self.templates[t])))
        return out, most


SPAN = "struct<label:string,start:long,end:long,cover:double>"


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] = PHRASES,
    min_match: int = MIN_MATCH, max_gap: int = MAX_GAP, min_cover: float = MIN_COVER,
) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) per row of ``docs``.

    The templates are ``all_templates`` if none are given. Their words become a generalised suffix automaton, which is small because the templates are a parameter, and is sent
    to the tasks. Each text runs through it once; it yields, for every place, the longest match that ends there (matching
    statistics). Matches of ``min_match`` words or more are chained in the order of a template with at most ``max_gap``
    other words between two; a chain that covers ``min_cover`` of the template is a span and gives its label, unless another
    template covers more of the same words, or a notice misses or adds a word that tells variants apart. A phrase always gives its label too, also
    within a span of another one. ``base_labels`` and ``n_base`` come from the
    places of the phrases, ``score`` is the best cover, and 1 where a phrase occurs.

    Null and empty text has no words, no labels and score 0. Nothing is shuffled.
    """
    base = fill_slots(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id")
    sent = docs.sparkSession.sparkContext.broadcast(Scanner(all_templates() if templates is None else templates, phrases, min_match, max_gap))

    def run(batches):
        scanner = sent.value
        get = scanner.ids.get
        for batch in slices(batches):
            rows = []
            for text in text_bytes(batch, "text"):
                tokens = words(text)
                ids = np.fromiter((get(w, 0) for w in tokens), np.int64, len(tokens))
                places = scanner.places(ids)
                spans, most = scanner.spans(ids, min_cover)
                named = {label for _, label in places}
                rows.append((
                    len(tokens), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted(named)),
                    ",".join(sorted(named | {s[0] for s in spans})), 1.0 if places else most,
                    [dict(zip(("label", "start", "end", "cover"), s)) for s in sorted(spans, key=lambda s: (s[1], s[2], s[0]))],
                ))
            columns = list(zip(*rows)) if rows else [()] * 8
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [
                pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cover", pa.float64())])),
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types))],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )

    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(
        run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<{SPAN}>"
    )
