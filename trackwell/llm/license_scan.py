"""License scans: templates with optional and replaceable regions, compiled into token automata."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackwell.llm.common import free_name

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases: (label, wording). Fixed values.
PHRASES = (
    ("mit", "mit license"),
    ("apache", "apache license"),
    ("gpl", "general public license"),
)
#: Fixed wording of whole license texts: grants, conditions and disclaimers, names replaceable.
_MIT_GRANT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files <<opt>>the software<</opt>> "
    "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
    "copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
    "the above copyright notice and this permission notice <<opt>>including the next paragraph<</opt>> shall be included in all copies or substantial portions of the software "
)
_AS_IS = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
    "fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability "
    "whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
_BSD_TERMS = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "<<any 1>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "<<any 1>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
)
_BSD_NAMES = (
    "<<any 1>> neither the name of <<any 12>> nor the names of <<opt>>its<</opt>> contributors may be used to endorse or promote products derived from this software without specific prior written permission "
)
_BSD_AS_IS = (
    "this software is provided by <<any 12>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose "
    "are disclaimed in no event shall <<any 12>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services "
    "loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise "
    "arising in any way out of the use of this software even if advised of the possibility of such damage"
)
WHOLE_TEXTS = (
    ("mit-text", _MIT_GRANT + _AS_IS),
    ("bsd-2-clause-text", _BSD_TERMS + _BSD_AS_IS),
    ("bsd-3-clause-text", _BSD_TERMS + _BSD_NAMES + _BSD_AS_IS),
    ("isc-text", "permission to use copy modify and <<opt>>or<</opt>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
                 "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
                 "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
                 "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("zlib-text", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
                  "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
                  "<<any 1>> the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required "
                  "<<any 1>> altered source versions must be plainly marked as such and must not be misrepresented as being the original software "
                  "<<any 1>> this notice may not be removed or altered from any source distribution"),
    ("apache-2.0-notice", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at <<any 8>> "
                          "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
                          "see the license for the specific language governing permissions and limitations under the license"),
    ("gpl-notice", "<<opt>>this program is free software<</opt>> you can redistribute it and or modify it under the terms of the gnu <<opt>>lesser<</opt>> <<opt>>affero<</opt>> general public license as published by the free software foundation "
                   "either version <<any 1>> of the license or <<opt>>at your option<</opt>> any later version "
                   "<<any 4>> is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose "
                   "see the gnu <<opt>>lesser<</opt>> <<opt>>affero<</opt>> general public license for more details"),
)
#: Fixed wording of well-known notices. <<opt>>...<</opt>> may be absent; <<any N>> stands for up to N words.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "<<opt>>licensed<</opt>> under the <<opt>>terms of the<</opt>> mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
            "<<opt>>the software<</opt>> to deal in the software without restriction including without limitation the rights to use copy modify "
            "merge publish distribute sublicense and or sell copies of the software"),
    ("apache-2.0", "licensed under the apache license version 2 0 <<opt>>the license<</opt>>"),
    ("gpl-2.0", "licensed under the gnu general public license <<opt>>as published by the free software foundation either<</opt>> version 2"),
    ("gpl-3.0", "licensed under the gnu general public license <<opt>>as published by the free software foundation either<</opt>> version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu <<opt>>lesser<</opt>> general public license"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-3-clause", "neither the name of <<any 12>> nor the names of <<opt>>its<</opt>> contributors may be used to endorse or promote products"),
    ("isc", "permission to use copy modify and <<opt>>or<</opt>> distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v <<opt>>version<</opt>> 2 0"),
    ("cc-by", "licensed under <<opt>>a<</opt>> cc by <<opt>>license<</opt>> 4 0"),
    ("cc-by-sa", "licensed under <<opt>>a<</opt>> cc by sa <<opt>>license<</opt>> 4 0"),
    ("cc-by-nc", "licensed under <<opt>>a<</opt>> cc by nc <<opt>>license<</opt>> 4 0"),
    ("cc0", "<<opt>>creative commons<</opt>> cc0 1 0 <<opt>>universal<</opt>>"),
    ("proprietary", "copyright <<opt>>c<</opt>> <<any 8>> all rights reserved"),
    *WHOLE_TEXTS,
)


@dataclass
class Automaton:
    """A token automaton without loops: at each state a word leads on, a skip needs none, a wildcard takes any word.

    State n follows the n-th token of the template. `skips` are ends of optional regions and of
    wildcards that may be left unused.
    """

    label: str
    base: bool
    words: list[str | None] = field(default_factory=list)  # None: any word
    skips: list[tuple[int, int]] = field(default_factory=list)

    def __post_init__(self):
        self.closure = [self._reach(s) for s in range(len(self.words) + 1)]
        self.starts = {self.words[s] for s in self.closure[0] if s < len(self.words)}
        if None in self.starts or len(self.words) in self.closure[0]:
            raise ValueError(f"the template of {self.label} must begin with wording")

    def _reach(self, state: int) -> frozenset[int]:
        seen, todo = {state}, [state]
        while todo:
            now = todo.pop()
            for a, b in self.skips:
                if a == now and b not in seen:
                    seen.add(b)
                    todo.append(b)
        return frozenset(seen)

    def accept(self, words: list[str], at: int) -> int:
        """Where the longest match that begins at word `at` ends, or -1."""
        states, end = self.closure[0], -1
        for i in range(at, len(words) + 1):
            if len(self.words) in states:
                end = i
            if i == len(words):
                break
            word = words[i]
            states = frozenset().union(*[self.closure[s + 1] for s in states if s < len(self.words) and self.words[s] in (None, word)])
            if not states:
                break
        return end


def parse(label: str, template: str, base: bool = False) -> Automaton:
    """Compiles a template's markup. Optional regions may be nested."""
    words: list[str | None] = []
    skips, open_ = [], []
    for mark, limit, word in re.findall(rf"<<(/?opt|any (\d+))>>|({WORD})", template):
        if mark == "opt":
            open_.append(len(words))
        elif mark == "/opt":
            skips.append((open_.pop(), len(words)))
        elif limit:
            begin = len(words)
            words += [None] * int(limit)
            skips += [(s, len(words)) for s in range(begin, len(words))]
        else:
            words.append(word)
    if open_:
        raise ValueError(f"the template of {label} leaves an optional region open")
    return Automaton(label, base, words, skips)


def compile_templates(templates=TEMPLATES, phrases=PHRASES) -> list[Automaton]:
    return [parse(label, text, True) for label, text in phrases] + [parse(label, text) for label, text in templates]


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """docs with a struct column `licenses`: n_words (long), matches (array of struct(label, base, start, stop), in words).

    A-Z is lower-cased; words are runs of digits, letters and characters beyond ASCII. A match
    is a place where an automaton accepts: mandatory wording stands word for word, optional
    regions are there whole or not at all. Of the matches of one template at one start the
    longest counts. Null and empty texts have no words. Repeated rows are scanned each by
    itself; an empty table gives an empty result. Nothing is shuffled.
    """
    name = free_name(docs, "licenses")
    kind = "struct<n_words:bigint,matches:array<struct<label:string,base:boolean,start:bigint,stop:bigint>>>"
    arrow = pa.struct([("n_words", pa.int64()), ("matches", pa.list_(pa.struct([
        ("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("stop", pa.int64()),
    ])))])

    @F.arrow_udf(kind)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automata = compile_templates(templates, phrases)
        by_start: dict[str, list[Automaton]] = {}
        for automaton in automata:
            for word in automaton.starts:
                by_start.setdefault(word, []).append(automaton)
        split = re.compile(WORD).findall
        lower = {c: c + 32 for c in range(65, 91)}
        for batch in batches:
            out = []
            for text in batch:
                words = split((text.as_py() or "").translate(lower))
                starts = by_start.keys() & set(words)
                found = []
                if starts:
                    for i, word in enumerate(words):
                        if word in starts:
                            for automaton in by_start[word]:
                                stop = automaton.accept(words, i)
                                if stop >= 0:
                                    found.append({"label": automaton.label, "base": automaton.base, "start": i, "stop": stop})
                out.append({"n_words": len(words), "matches": found})
            yield pa.array(out, arrow)

    return docs.withColumn(name, find("text"))


def labels(matches: Column) -> Column:
    """Distinct labels, sorted, comma-joined."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")
