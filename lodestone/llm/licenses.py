"""License scans by template markup compiled into token automata.

Words are runs of ASCII letters and digits and of bytes beyond ASCII, lower-cased in A-Z; all
else separates. A template is a line of words with markup: ``[[ ... ]]`` is an optional region,
``{{a|b c}}`` takes one of several wordings, and ``<<m-n>>`` is a replaceable region of m to n
words of any kind. A template compiles into an automaton over words, which becomes deterministic
step by step as texts are read; a text matches where the automaton accepts, so that all mandatory
wording stands there exactly, in order, with only optional and replaceable regions in between.
The catalogue holds one-line grants, the notices that files carry, and whole short licences.

Base labels come from fixed phrases whose words stand consecutively, at every place. Templates
add labels of their own and never remove base labels.

Nulls and edge cases: a null text counts as empty and has no words, places or labels; a null id
is carried along; rows with one id are scanned each by its own text. A replaceable region is
bounded, so that an automaton has a bounded number of states whatever the text's length.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import LOWER_ALNUM, slices, texts
from lodestone.llm.hashing import word_bounds

#: Steps of a deterministic automaton that are remembered; beyond them they are made again.
MOST_STEPS = 100_000
#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label and template; the word after ``@``, one of its mandatory words, must occur in a text
#: before the template is tried.
TEMPLATES = [
    ("apache-2.0", "@apache {{licensed|released|distributed}} under [[the terms of]] the apache license [[version]] 2 0"),
    ("apache-2.0", "@apache licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at {{http|https}} www apache org licenses license 2 0 [[html]] unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2.0", "@spdx spdx license identifier apache 2 0"),
    ("mit", "@mit {{licensed|released|distributed}} under [[the terms of]] the mit license"),
    ("mit", "@spdx spdx license identifier mit"),
    ("mit", "@hereby permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files <<0-4>> to deal in the software without restriction"),
    ("gpl-2.0", "@gnu {{licensed|released|distributed}} under [[the terms of]] the gnu general public license [[as published by the free software foundation]] {{version|v}} 2"),
    ("gpl-3.0", "@gnu {{licensed|released|distributed}} under [[the terms of]] the gnu general public license [[as published by the free software foundation]] {{version|v}} 3"),
    ("gpl-2.0", "@foundation free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3.0", "@foundation free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2.0", "@redistribute free software you can redistribute it and or modify it under the terms of the gnu general public license {{version 2|as published by the free software foundation version 2}} [[of the license]] only"),
    ("lgpl-2.1", "@lesser {{licensed|released|distributed}} under [[the terms of]] the gnu lesser general public license {{version|v}} 2 1"),
    ("lgpl-2.1", "@lesser free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl-3.0", "@lesser free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl-3.0", "@affero {{licensed|released|distributed}} under [[the terms of]] the gnu affero general public license {{version|v}} 3"),
    ("agpl-3.0", "@affero free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("mpl-2.0", "@mozilla this source code form is subject to the terms of the mozilla public license [[,]] v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at {{http|https}} mozilla org mpl 2 0"),
    ("mpl-2.0", "@mozilla subject to the terms of the mozilla public license [[,]] {{v|version}} 2 0"),
    ("cc-by-4.0", "@cc {{licensed|released|distributed}} under [[the]] [[creative commons]] cc by 4 0"),
    ("cc-by-sa-4.0", "@cc {{licensed|released|distributed}} under [[the]] [[creative commons]] cc by sa 4 0"),
    ("cc-by-nc-4.0", "@cc {{licensed|released|distributed}} under [[the]] [[creative commons]] cc by nc 4 0"),
    ("cc-by-nd-4.0", "@cc {{licensed|released|distributed}} under [[the]] [[creative commons]] cc by nd 4 0"),
    ("bsd-3-clause", "@redistribution redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<0-120>> neither the name of <<1-12>> nor the names of its contributors may be used to endorse or promote products"),
    ("mit", "@hereby permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [[the software]] to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall <<1-12>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("isc", "@hereby permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and <<1-8>> {{disclaims|disclaim}} all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<1-8>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("bsd-2-clause", "@redistribution redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<0-2>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<0-2>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by <<1-10>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("zlib", "@misrepresented permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions <<0-2>> the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("unlicense", "@unencumbered this is free and unencumbered software released into the public domain"),
    ("cc0-1.0", "@cc0 {{licensed|released|distributed}} under [[the]] [[creative commons]] cc0 1 0"),
    ("copyright-notice", "@copyright copyright [[c]] <<1-8>> all rights reserved"),
]


@dataclass
class Automaton:
    """States are numbers; ``steps`` maps a state to (word or None for any, next state)."""

    label: str
    anchor: bytes
    steps: list[list[tuple[bytes | None, int]]] = field(default_factory=list)
    empty: list[list[int]] = field(default_factory=list)
    accept: int = 0

    def state(self) -> int:
        self.steps.append([])
        self.empty.append([])
        return len(self.steps) - 1

    def closure(self, states: set[int]) -> set[int]:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return seen

    def first_words(self) -> set[bytes]:
        return {w for s in self.closure({0}) for w, _ in self.steps[s] if w is not None}

    def prepare(self) -> None:
        """The start state and the alphabet of the deterministic form, whose steps are made when first taken."""
        self.words = {w for step in self.steps for w, _ in step if w is not None}
        self.begin = frozenset(self.closure({0}))
        self.known: dict[tuple[frozenset, bytes | None], frozenset] = {}

    def step(self, now: frozenset, word: bytes) -> frozenset:
        key = (now, word if word in self.words else None)
        after = self.known.get(key)
        if after is None:
            if len(self.known) == MOST_STEPS:
                self.known.clear()
            after = self.known[key] = frozenset(self.closure({t for s in now for w, t in self.steps[s] if w is None or w == word}))
        return after

    def match(self, words: list[bytes], start: int) -> int:
        """The end of the shortest match that begins at ``start``, or -1."""
        now = self.begin
        for at in range(start, len(words)):
            now = self.step(now, words[at])
            if not now:
                return -1
            if self.accept in now:
                return at + 1
        return -1


_PART = re.compile(r"\[\[(?P<optional>.*?)\]\]|\{\{(?P<either>.*?)\}\}|<<(?P<low>\d+)-(?P<high>\d+)>>|(?P<word>\S+)")


def compile_template(label: str, markup: str) -> Automaton:
    anchor, _, body = markup.removeprefix("@").partition(" ")
    made = Automaton(label, anchor.encode())
    made.state()

    def wording(text: str, at: int) -> int:
        for word in text.encode().translate(LOWER_ALNUM).split():
            after = made.state()
            made.steps[at].append((word, after))
            at = after
        return at

    at = 0
    for part in _PART.finditer(body):
        if part["word"] is not None:
            at = wording(part["word"], at)
        elif part["optional"] is not None:
            after = wording(part["optional"], at)
            if after != at:
                made.empty[at].append(after)
            at = after
        elif part["either"] is not None:
            join = made.state()
            for choice in part["either"].split("|"):
                made.empty[wording(choice, at)].append(join)
            at = join
        else:
            low, high = int(part["low"]), int(part["high"])
            skips = []
            for k in range(high):
                if k >= low:
                    skips.append(at)
                after = made.state()
                made.steps[at].append((None, after))
                at = after
            for s in skips:
                made.empty[s].append(at)
    made.accept = at
    made.prepare()
    if anchor not in {p["word"] for p in _PART.finditer(body)}:
        raise ValueError(f"{anchor!r} is no mandatory word of the template for {label}")
    return made


class Scanner:
    """Compiled templates and phrases."""

    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> None:
        self.automata = [compile_template(*t) for t in templates]
        self.phrases = [(p.encode().split(), label) for p, label in phrases.items()]
        for a in self.automata:
            a.first = a.first_words()
        self.wanted = {p[0] for p, _ in self.phrases} | {w for a in self.automata for w in a.first}
        words = {a.anchor for a in self.automata} | {p[-1] for p, _ in self.phrases}
        self.any = re.compile(rb"(?<![^ ])(?:" + b"|".join(map(re.escape, sorted(words))) + rb")(?![^ ])")

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, str]]]:
        """Words; (start, label) of each phrase; (start, end, label) of template matches."""
        plain = text.translate(LOWER_ALNUM)
        if not self.any.search(plain):
            return len(word_bounds(np.frombuffer(plain, np.uint8))[0]), [], []
        words = plain.split()
        places: dict[bytes, list[int]] = {}
        present = set(words)
        for i, w in enumerate(words):
            if w in self.wanted:
                places.setdefault(w, []).append(i)
        base = [(i, label) for p, label in self.phrases for i in places.get(p[0], ()) if words[i : i + len(p)] == p]
        found = []
        for a in self.automata:
            if a.anchor in present:
                for i in sorted(i for w in a.first for i in places.get(w, ())):
                    if (end := a.match(words, i)) >= 0:
                        found.append((i, end, a.label))
        return len(words), base, found


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """A row for each document; score is 1 with a template match, 0.5 with phrases alone, else 0."""

    def run(batches):
        scanner = Scanner(templates, phrases)
        for batch in slices(batches):
            rows = [scanner.scan(t) for t in texts(batch)]
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_templates"]
            base = [sorted({label for _, label in b}) for _, b, _ in rows]
            every = [sorted({*own, *(label for _, _, label in f)}) for own, (_, _, f) in zip(base, rows, strict=True)]
            yield pa.record_batch(
                [
                    batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([len(r[1]) for r in rows], pa.int64()),
                    pa.array([min((i for i, _ in r[1]), default=None) for r in rows], pa.int64()), pa.array([max((i for i, _ in r[1]), default=None) for r in rows], pa.int64()),
                    pa.array([",".join(b) for b in base], pa.string()), pa.array([",".join(e) for e in every], pa.string()),
                    pa.array([1.0 if r[2] else 0.5 if r[1] else 0.0 for r in rows], pa.float64()), pa.array([len(r[2]) for r in rows], pa.int64()),
                ],
                names=names,
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_templates long")


def template_pattern(markup: str) -> tuple[str, list[str]]:
    """A template as a regular expression over words that each follow a space, and its first words."""
    body = markup.removeprefix("@").partition(" ")[2]
    wording = lambda text: "".join(f" {w}" for w in text.encode().translate(LOWER_ALNUM).decode().split())
    out, first = "", []
    for part in _PART.finditer(body):
        choices = [wording(w) for w in (part["either"] or part["word"] or "").split("|")]
        if part["either"] is not None or part["word"] is not None:
            first = first or [c.split()[0] for c in choices]
            out += f"(?:{'|'.join(choices)})"
        elif part["optional"] is not None:
            out += f"(?:{wording(part['optional'])})?" if wording(part["optional"]) else ""
        else:
            out += f"(?: [^ ]+){{{part['low']},{part['high']}}}"
    return out, first


def op5_sql() -> str:
    """The rows of op5 by regular expressions; every template must begin with mandatory wording."""
    places, found, labels = [], [], []
    for phrase, label in PHRASES.items():
        here = " AND ".join(f"words[i + {k}] = '{w}'" for k, w in enumerate(phrase.split()))
        places.append(f"({here})")
        labels.append(f"CASE WHEN contains(line, ' {phrase} ') THEN '{label}' END")
    own = []
    for label, markup in TEMPLATES:
        pattern, first = template_pattern(markup)
        starts = ", ".join(f"'{w}'" for w in first)
        found.append(f"CASE WHEN regexp_matches(line, '{pattern} ') THEN len(list_filter(range(1, len(words) + 1), lambda i: words[i] IN ({starts}) AND regexp_matches(' ' || array_to_string(words[i:i + 250], ' ') || ' ', '^{pattern} '))) ELSE 0 END")
        own.append(f"CASE WHEN regexp_matches(line, '{pattern} ') THEN '{label}' END")
    joined = lambda parts: f"array_to_string(list_sort(list_distinct(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL))), ',')"
    return f"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS words
  FROM documents
), l AS (
  SELECT doc_id, words, ' ' || array_to_string(words, ' ') || ' ' AS line FROM w
), p AS (
  SELECT *, list_filter(range(1, len(words) + 1), lambda i: {' OR '.join(places)}) AS places, CAST({' + '.join(found)} AS BIGINT) AS n_templates FROM l
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, list_min(places) - 1 AS first_word, list_max(places) - 1 AS last_word,
  {joined(labels)} AS base_labels, {joined(labels + own)} AS labels,
  CASE WHEN n_templates > 0 THEN 1.0::DOUBLE WHEN len(places) > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score, n_templates
FROM p
"""


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
