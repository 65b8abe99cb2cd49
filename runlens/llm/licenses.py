"""License scans: license templates with optional and replaceable regions, compiled to automata over words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import prepare, utf8

#: Phrases and the labels they stand for.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

def _gnu(name: str, label: str) -> dict[str, str]:
    """The grant and the whole notice of a license of the GNU family."""
    grant = f"you can redistribute it and or modify it under the terms of the gnu {name} license as published by the free software foundation [[ either ]] version {{{{2}}}} of the license [[ or at your option any later version ]]"
    notice = f"{{{{4}}}} is free software {grant} {{{{4}}}} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {name} license for more details you should have received a copy of the gnu {name} license along with {{{{4}}}} [[ if not see {{{{8}}}} ]]"
    return {f"{label}-grant": grant, f"{label}-notice": notice}


_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[ 1 ]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[ 2 ]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution {third} this software is provided by {{{{12}}}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {{{{12}}}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"

#: The wording of whole short licenses, and of the notices by which the long ones (Apache, GNU) are named. [[ ]] holds an optional region, {{n}} stands for up to n words of any kind.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0 [[ the license ]]",
    "apache-2.0-notice": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at [[ http ]] [[ https ]] [[ www ]] apache org licenses license 2 0 [[ html ]] [[ txt ]] unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "bsd-2-clause": _BSD.format(third=""),
    "bsd-3-clause": _BSD.format(third="[[ 3 ]] neither the name of {{12}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    "cc-by-nc-4.0": "licensed under [[ a ]] [[ the ]] [[ creative commons ]] cc by nc 4 0 [[ international ]] [[ license ]]",
    "gpl-3.0": "licensed under the [[ terms of the ]] gnu general public license version 3 [[ or {{3}} later version ]]",
    **_gnu("general public", "gpl"),
    **_gnu("lesser general public", "lgpl"),
    **_gnu("affero general public", "agpl"),
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and {{8}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {{8}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "mit-notice": "released under the [[ terms of the ]] mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[ including the next paragraph ]] shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {{12}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
}

_ANY = None
#: Word characters of the contract: ASCII letters (in lower case) and digits, and all that isn't ASCII; the rest parts words.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Automaton:
    """States are places in a template's words; empty moves leave out optional regions and unused wildcards."""

    def __init__(self, markup: str) -> None:
        self.words: list[str | None] = []
        self.skips: dict[int, set[int]] = {}
        opened, needed = [], []
        for part in markup.split():
            if part == "[[":
                opened.append(len(self.words))
            elif part == "]]":
                self.skips.setdefault(opened.pop(), set()).add(len(self.words))
            elif wild := re.fullmatch(r"\{\{(\d+)\}\}", part):
                end = len(self.words) + int(wild[1])
                while len(self.words) < end:
                    self.skips.setdefault(len(self.words), set()).add(end)
                    self.words.append(_ANY)
            else:
                self.words.append(part)
                if not opened:
                    needed.append(part)
        if opened or not needed:
            raise ValueError("a template needs words outside of all regions, and each [[ its ]]")
        self.final, self.mandatory = len(self.words), len(needed)
        #: A text without this word can't match.
        self.rarest = max(needed, key=len)
        self.starts = {self.words[s] for s in self._closed({0})} - {_ANY}

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.skips.get(todo.pop(), ()):
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def match(self, words: list[str], at: int) -> int:
        """Where the longest match that starts at this word ends, or -1."""
        states, end = self._closed({0}), -1
        for i in range(at, len(words) + 1):
            if self.final in states:
                end = i
            if i == len(words) or not states:
                break
            states = self._closed({s + 1 for s in states if s < self.final and self.words[s] in (_ANY, words[i])})
        return end


def matches(words: list[str], automata: dict[str, Automaton]) -> list[tuple[str, int, int]]:
    """(label, first word, end) of each accepted place, one per label and start."""
    there, out = set(words), []
    for label, automaton in automata.items():
        if automaton.rarest in there:
            out += [(label, i, end) for i, w in enumerate(words) if w in automaton.starts and (end := automaton.match(words, i)) >= 0]
    return out


def scan_licenses(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """License evidence of every document: n_words, n_base, first_word, last_word, base_labels, labels, spans, score.

    Words are runs of ASCII letters and digits and of all non-ASCII characters, A-Z in lower case, counted from 0. Base
    places are where a phrase's words stand one after another; templates add spans [label, first word, end word) where
    all mandatory wording stands exactly, optional regions may be missing, and replaceable ones hold any words up to
    their number. score is n / (n + 4), n the most mandatory words of a template, or of a phrase, that stand in the text:
    0 without any, 0.33 for two words, near 1 for a whole license. Null or empty text: no words, no places, empty labels.
    Of several ends of a template at one start the longest counts; words that a wildcard at a template's begin stands for are part of the span only if it takes
    them, so a span begins at the earliest start that matches. Repeated rows each give their own row; an empty table gives an empty one; other columns are
    left out.
    """
    prepare(docs.sparkSession)
    base = {tuple(k.split()): v for k, v in (phrases or PHRASES).items()}
    last_words = sorted({k[-1] for k in base})
    automata = {k: Automaton(v) for k, v in (templates or TEMPLATES).items()}
    keys = [x.encode() for x in sorted({*last_words, *(a.rarest for a in automata.values())})]

    def one(text: bytes) -> tuple:
        spread = text.translate(_WORDS)
        cut = spread.split()
        if not any(k in spread for k in keys):
            return len(cut), 0, None, None, "", "", [], 0.0
        words = [w.decode() for w in cut]
        places = [(i - len(p) + 1, p) for i, w in enumerate(words) if w in last_words for p in base if w == p[-1] and i + 1 >= len(p) and tuple(words[i - len(p) + 1 : i + 1]) == p]
        spans = matches(words, automata)
        own = {base[p] for _, p in places}
        starts = [i for i, _ in places]
        said = max([automata[s[0]].mandatory for s in spans] + [len(p) for _, p in places], default=0)
        return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(own | {s[0] for s in spans})), [{"label": s[0], "start": s[1], "end": s[2]} for s in spans], said / (said + 4))

    span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), span, pa.float64()]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "spans", "score"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*map(one, utf8(batch.column(1))), strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, map(list, rows), kinds)], ["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(scan, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, spans array<struct<label:string,start:long,end:long>>, score double")
