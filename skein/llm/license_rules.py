"""Licence scans by sentence rules: sentences get identifiers, identifier sequences match ordered rules.

A text is cut into sentences at line ends and after ``. ; ! ?`` followed by a space; a sentence is
normalised (lower case, letters, digits, dots inside numbers, single spaces).  Sentences found in the
dictionary become identifiers.  A rule is an ordered tuple of identifiers; it matches where its
identifiers follow each other in a text with at most ``max_gap`` unknown sentences between two of them.
Sentences may also be joined from several lines, since long ones are wrapped.

Defined edge cases: null and empty texts have no licence; overlapping rules each count, but a rule whose
match lies inside a longer rule's match of the same licence does not count again; repeated rows stay
repeated; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Known sentences by identifier (wordings of public licences and usual notices).
SENTENCES = {
    "apache2.notice": ["licensed under the apache license version 2.0", "released under the apache license version 2.0", "this work is licensed under the apache license version 2.0", "licensed under the apache license version 2.0 the license"],
    "apache2.comply": ["you may not use this file except in compliance with the license"],
    "apache2.copy": ["you may obtain a copy of the license at"],
    "apache2.basis": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "mit.notice": ["released under the mit license", "licensed under the mit license", "this work is licensed under the mit license"],
    "mit.grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit.include": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "mit.asis": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "gpl3.notice": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "released under the gnu general public license version 3"],
    "gpl2.notice": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2", "released under the gnu general public license version 2"],
    "gpl.free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl.useful": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "cc-by-nc4.notice": ["licensed under cc by nc 4.0", "this work is licensed under cc by nc 4.0", "released under cc by nc 4.0"],
    "cc-by4.notice": ["licensed under cc by 4.0", "this work is licensed under cc by 4.0", "released under cc by 4.0"],
    "cc-by-sa4.notice": ["licensed under cc by sa 4.0", "this work is licensed under cc by sa 4.0", "released under cc by sa 4.0"],
    "bsd.redistribute": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd.source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd.binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd.endorse": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd.notice": ["licensed under the bsd license", "released under the bsd license"],
    "mpl2.notice": ["this source code form is subject to the terms of the mozilla public license v 2.0"],
    "reserved": ["all rights reserved"],
}

_GNU = {"gpl2": ("general", "2"), "gpl": ("general", "3"), "lgpl2": ("library general", "2"), "lgpl2.1": ("lesser general", "2.1"), "lgpl3": ("lesser general", "3"), "agpl3": ("affero general", "3")}
_THINGS = ("program", "library", "software", "file")
for _k, (_name, _v) in _GNU.items():  # file headers: "or later" and "only"
    _under = [f"this {x} is free software you can redistribute it and or modify it under the terms of the gnu {_name} public license" for x in _THINGS]
    SENTENCES.setdefault(f"{_k}.free", []).extend(f"{x} as published by the free software foundation either version {_v} of the license or at your option any later version" for x in _under)
    SENTENCES[f"{_k}.only"] = [f"{x}{y}" for x in _under for y in (f" version {_v} as published by the free software foundation", f" as published by the free software foundation version {_v} of the license", f" as published by the free software foundation version {_v}")]
SENTENCES["gpl.useful"] += [f"this {x} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose" for x in _THINGS[1:]]
SENTENCES["bsd.endorse"] += [f"neither the name of {x} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission" for x in ("the university", "the author", "the copyright holders", "google inc")]
SENTENCES |= {
    "apache2.title": ["apache license version 2.0 january 2004"],
    "apache2.terms": ["terms and conditions for use reproduction and distribution"],
    "gpl2.title": ["gnu general public license version 2 june 1991"],
    "gpl.title": ["gnu general public license version 3 29 june 2007"],
    "lgpl2.title": ["gnu library general public license version 2 june 1991"],
    "lgpl2.1.title": ["gnu lesser general public license version 2.1 february 1999"],
    "lgpl3.title": ["gnu lesser general public license version 3 29 june 2007"],
    "agpl3.title": ["gnu affero general public license version 3 19 november 2007"],
    "gnu.verbatim": ["everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"],
    "mpl2.title": ["mozilla public license version 2.0"],
    "isc.grant": [f"permission to use copy modify and {x}distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies" for x in ("", "or ")],
    "isc.asis": [f"the software is provided as is and {x} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness" for x in ("the author", "isc", "internet systems consortium inc")],
    "epl1.notice": [f"{x} made available under the terms of the eclipse public license v1.0" for x in ("this program and the accompanying materials are", "all rights reserved this program and the accompanying materials are")],
    "epl2.notice": [f"this program and the accompanying materials are made available under the terms of the eclipse public license {x}" for x in ("2.0", "v 2.0", "v2.0")],
    "epl2.title": ["eclipse public license v 2.0", "eclipse public license version 2.0"],
    "cc0.title": ["cc0 1.0 universal"],
    "unlicense.free": ["this is free and unencumbered software released into the public domain"],
    "unlicense.anyone": ["anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"],
}
SENTENCES["epl2.notice"] += [x + " which is available at " + y for x in SENTENCES["epl2.notice"] for y in ("https www eclipse org legal epl 2.0", "http www eclipse org legal epl 2.0")]
SENTENCES["epl1.notice"] += [x + " which accompanies this distribution and is available at " + y for x in SENTENCES["epl1.notice"] for y in ("http www eclipse org legal epl v10.html", "http www eclipse org legal epl v10 html")]
_SPDX = ("Apache-2.0", "MIT", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "ISC", "EPL-1.0", "EPL-2.0", "CC0-1.0", "Unlicense", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0")
SENTENCES |= {f"spdx.{x}": [f"SPDX-License-Identifier: {x}"] for x in _SPDX}

#: Ordered rules: licence, identifiers.
RULES = (
    ("Apache-2.0", ("apache2.notice",)),
    ("Apache-2.0", ("apache2.notice", "apache2.comply", "apache2.copy", "apache2.basis")),
    ("MIT", ("mit.notice",)),
    ("MIT", ("mit.grant", "mit.include", "mit.asis")),
    ("GPL-3.0", ("gpl3.notice",)),
    ("GPL-3.0-or-later", ("gpl.free", "gpl.useful")),
    ("GPL-2.0", ("gpl2.notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc4.notice",)),
    ("CC-BY-4.0", ("cc-by4.notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa4.notice",)),
    ("BSD-3-Clause", ("bsd.redistribute", "bsd.source", "bsd.binary", "bsd.endorse")),
    ("BSD-2-Clause", ("bsd.redistribute", "bsd.source", "bsd.binary")),
    ("BSD", ("bsd.notice",)),
    ("MPL-2.0", ("mpl2.notice",)),
    ("Proprietary", ("reserved",)),
    ("Apache-2.0", ("apache2.title", "apache2.terms")),
    ("MPL-2.0", ("mpl2.title",)),
    ("ISC", ("isc.grant", "isc.asis")),
    ("EPL-1.0", ("epl1.notice",)),
    ("EPL-2.0", ("epl2.notice",)),
    ("EPL-2.0", ("epl2.title",)),
    ("CC0-1.0", ("cc0.title",)),
    ("Unlicense", ("unlicense.free", "unlicense.anyone")),
    *((f"{n}-or-later", (f"{k}.free", "gpl.useful")) for k, n in (("gpl2", "GPL-2.0"), ("lgpl2", "LGPL-2.0"), ("lgpl2.1", "LGPL-2.1"), ("lgpl3", "LGPL-3.0"), ("agpl3", "AGPL-3.0"))),
    *((f"{n}-only", (f"{k}.only",)) for k, n in (("gpl2", "GPL-2.0"), ("gpl", "GPL-3.0"), ("lgpl2", "LGPL-2.0"), ("lgpl2.1", "LGPL-2.1"), ("lgpl3", "LGPL-3.0"), ("agpl3", "AGPL-3.0"))),
    *((n, (f"{k}.title", "gnu.verbatim")) for k, n in (("gpl2", "GPL-2.0"), ("gpl", "GPL-3.0"), ("lgpl2", "LGPL-2.0"), ("lgpl2.1", "LGPL-2.1"), ("lgpl3", "LGPL-3.0"), ("agpl3", "AGPL-3.0"))),
    *((x, (f"spdx.{x}",)) for x in _SPDX),
)

_CUT = re.compile(r"(?<=[.;!?])[ \t]+|[\r\n]+")
_NOISE = re.compile(r"[^\w.]+|(?<!\d)\.|\.(?!\d)|_")


def normal(sentence: str) -> str:
    return " ".join(_NOISE.sub(" ", sentence.lower()).split())


class Recogniser:
    def __init__(self, sentences: dict[str, list[str]] = SENTENCES, rules: tuple = RULES, max_gap: int = 3):
        self.ids = {normal(s): k for k, alike in sentences.items() for s in alike}
        self.rules, self.max_gap = rules, max_gap
        self.longest = max(map(len, self.ids), default=0)
        first = sorted({s.split(" ")[0] for s in self.ids})
        self.starts = set(first)
        # every known sentence holds one of these words, chosen from the sentences; texts without any are left at once
        self.hint = re.compile("|".join(map(re.escape, self._hints())), re.IGNORECASE) if self.ids else None

    def _hints(self) -> list[str]:
        """A few words, long ones first choice, such that every sentence holds one."""
        left, out = {s: set(re.findall(r"[^\W\d_]{2,}|\w+", s)) for s in self.ids}, []
        while left:
            count = Counter(w for words in left.values() for w in words)
            best = max(count, key=lambda w: (count[w] * min(len(w), 8) ** 2, w))
            out.append(best)
            left = {s: w for s, w in left.items() if best not in w}
        return out

    def sequence(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, identifier) of known sentences, by number of sentence."""
        parts = [normal(p) for p in _CUT.split(text)]
        parts = [p for p in parts if p]
        out, i = [], 0
        while i < len(parts):
            end, found, joined = i + 1, self.ids.get(parts[i]), parts[i]
            if found is None and parts[i].split(" ", 1)[0] in self.starts:
                for j in range(i + 1, len(parts)):  # a wrapped sentence, as far as the longest known one
                    joined += " " + parts[j]
                    if len(joined) > self.longest:
                        break
                    if joined in self.ids:
                        end, found = j + 1, self.ids[joined]
                        break
            if found is not None:
                out.append((i, end, found))
            i = end
        return out

    def licences(self, text: str | None) -> list[tuple[str, int, int]]:
        """(licence, first sentence, end) of every rule matched, in order."""
        if not text or self.hint is None or not self.hint.search(text):
            return []
        seq, hits = self.sequence(text), set()
        for name, rule in self.rules:
            for k, (start, end, known) in enumerate(seq):
                if known != rule[0]:
                    continue
                at, last, ok = k, end, True
                for want in rule[1:]:
                    at += 1
                    while at < len(seq) and seq[at][2] != want and seq[at][0] - last <= self.max_gap:
                        at += 1
                    if at == len(seq) or seq[at][2] != want or seq[at][0] - last > self.max_gap:
                        ok = False
                        break
                    last = seq[at][1]
                if ok:
                    hits.add((name, start, last))
        inside = lambda x, y: x != y and y[1] <= x[1] and x[2] <= y[2] and (x[2] - x[1] < y[2] - y[1])
        return sorted((h for h in hits if not any(inside(h, y) for y in hits)), key=lambda h: (h[1], h[2], h[0]))


def licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", recogniser: Recogniser | None = None) -> DataFrame:
    """One row per document: ``id_col, licences`` (distinct, sorted), ``n_matches, spans`` (licence, first sentence, end)."""
    rec = recogniser or Recogniser()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [rec.licences(t) for t in pdf["text"]]
            yield pd.DataFrame({
                "id": pdf["id"], "licences": [sorted({x[0] for x in f}) for f in found], "n_matches": [len(f) for f in found],
                "spans": [[{"licence": a, "start": b, "end": c} for a, b, c in f] for f in found],
            })

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = out.mapInPandas(run, "id long, licences array<string>, n_matches int, spans array<struct<licence:string,start:int,end:int>>")
    return out.withColumnRenamed("id", id_col)
