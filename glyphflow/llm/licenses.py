"""License scans by a positional index of licence texts.

Each template is a word sequence, a whole licence text or a notice, with a mandatory key phrase. A file's licence words are
looked up in the index from the highest inverse document frequency down, until each template that they touch has VOTERS of
them. Each posting (template, position) of a looked-up word votes for the place that the word's own position gives the
template; places with MIN_VOTES agreeing votes are candidates, and one counts only when the key phrase's words stand
there. A phrase template is anchored at its own rarest word, all of whose occurrences are looked up, so all its places
are found. Document frequencies cover the whole table. The score is 1 where a phrase stands, else the best template's
share of words at their places, over all places. A null text is empty: no words, no labels, score 0. Places may overlap;
words of equal frequency are taken in their own order; a very long text costs its licence words' positions; repeated rows
repeat results.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, map_texts, slices, text_column, texts

#: Phrases, each with its label: all words must stand consecutively.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Templates of public licences: label, key phrase, text around it (key phrase included). Notices and first sentences:
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("gpl", "under the terms of the gnu general public license", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "under the terms of the gnu affero general public license", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("apache", "licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("mpl", "subject to the terms of the mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "free and unencumbered software released into the public domain", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "creative commons attribution", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc0", "cc0 1 0 universal", "creative commons cc0 1 0 universal public domain dedication"),
    ("proprietary", "all rights reserved", "copyright all rights reserved"),
)
#: Whole texts, as their owners publish them, without the lines that name a holder.
WHOLE = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", """Permission is hereby granted, free of charge, to any person
    obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction,
    including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
    Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright
    notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
    "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS
    FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR
    OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE
    USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("bsd", "redistribution and use in source and binary forms", """Redistribution and use in source and binary forms, with or without
    modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above
    copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
    copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
    distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
    INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
    EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
    DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
    INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
    OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("isc", "permission to use copy modify and or distribute this software", """Permission to use, copy, modify, and/or distribute this
    software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice
    appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
    ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
    CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
    NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("zlib", "must not be misrepresented as being the original software", """This software is provided 'as-is', without any express or implied
    warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to
    anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject
    to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the
    original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is
    not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
    software. 3. This notice may not be removed or altered from any source distribution."""),
    ("boost", "obtaining a copy of the software and accompanying documentation covered by this license", """Permission is hereby granted,
    free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
    (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the
    Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices
    in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be
    included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or
    derivative works are solely in the form of machine-executable object code generated by a source language processor."""),
    ("gpl", "under the terms of the gnu general public license", """This program is free software: you can redistribute it and/or modify it
    under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without
    even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
    You should have received a copy of the GNU General Public License along with this program."""),
    ("apache", "licensed under the apache license version 2 0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not
    use this file except in compliance with the License. You may obtain a copy of the License at
    http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the
    License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License
    for the specific language governing permissions and limitations under the License."""),
    ("mpl", "subject to the terms of the mozilla public license", """This Source Code Form is subject to the terms of the Mozilla Public
    License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("unlicense", "free and unencumbered software released into the public domain", """This is free and unencumbered software released into the
    public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or
    as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws,
    the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this
    dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an
    overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""),
)
TEMPLATES = NOTICES + tuple((label, key, b" ".join(alnum_words(text.encode())).decode()) for label, key, text in WHOLE)
#: Of a template's words in a file, so many with the highest inverse document frequency vote for its place, and so many votes must agree.
VOTERS, MIN_VOTES = 6, 3
#: The least share of a template's words that must stand at their places.
COVERAGE = 0.5


class LicenseIndex:
    """Postings of the templates' words, and each phrase's rarest word."""

    def __init__(self, frequency: dict[bytes, int], documents: int):
        self.idf = lambda w: math.log((documents + 1) / (frequency.get(w, 0) + 1))
        self.phrases = []
        self.anchors: dict[bytes, list[tuple[int, int]]] = {}
        for k, (phrase, label) in enumerate(PHRASES):
            words = phrase.encode().split()
            at = max(range(len(words)), key=lambda i: (self.idf(words[i]), words[i]))
            self.phrases.append((words, label))
            self.anchors.setdefault(words[at], []).append((k, at))
        self.templates, self.postings = [], {}
        for k, (label, key, text) in enumerate(TEMPLATES):
            words, key_words = text.encode().split(), key.encode().split()
            at = next(i for i in range(len(words)) if words[i : i + len(key_words)] == key_words)
            self.templates.append((label, words, key_words, at))
            for i, w in enumerate(words):
                self.postings.setdefault(w, []).append((k, i))
        self.rank = {w: k for k, w in enumerate(sorted(set(self.postings) | set(self.anchors), key=lambda w: (-self.idf(w), w)))}
        #: A phrase needs its anchor, and a key phrase its rarest word: a file with none of these holds no template.
        self.triggers = frozenset(self.anchors) | frozenset(max(key, key=lambda w: (self.idf(w), w)) for _, _, key, _ in self.templates)

    def candidates(self, spots: dict[bytes, list[int]]) -> dict[int, list[int]]:
        """By template, the places that MIN_VOTES of its looked-up words agree on; spots: where the file's licence words stand."""
        asked, votes = Counter(), {}
        for w in sorted(spots, key=self.rank.__getitem__):
            touched = set()
            for k, p in self.postings.get(w, ()):
                if asked[k] < VOTERS or k in touched:
                    if k not in touched:
                        touched.add(k)
                        asked[k] += 1
                    votes.setdefault(k, []).append(np.array(spots[w], dtype=np.int64) - p)
        out = {}
        for k, found in votes.items():
            if len(found) >= MIN_VOTES:
                place, n = np.unique(np.concatenate(found), return_counts=True)
                if len(agreed := place[n >= MIN_VOTES]):
                    out[k] = agreed.tolist()
        return out

    def scan(self, text: bytes):
        """(number of words, places of phrases as (start, label), labels of templates, score)."""
        words = alnum_words(text)
        if self.triggers.isdisjoint(words):
            return len(words), [], set(), 0.0
        rank = self.rank
        spots: dict[bytes, list[int]] = {}
        for i, w in enumerate(words):
            if w in rank:
                spots.setdefault(w, []).append(i)
        places = []
        for w, posts in self.anchors.items():
            for i in spots.get(w, ()):
                for k, at in posts:
                    phrase, label = self.phrases[k]
                    if i >= at and words[i - at : i - at + len(phrase)] == phrase:
                        places.append((i - at, label))
        labels, score = set(), 1.0 if places else 0.0
        for k, starts in self.candidates(spots).items():
            label, template, key, at = self.templates[k]
            for start in starts:
                if start + at < 0 or words[start + at : start + at + len(key)] != key:
                    continue
                hit = sum(0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(template)) / len(template)
                score = max(score, hit)
                if hit >= COVERAGE:
                    labels.add(label)
        return len(words), sorted(places), labels, score


def frequencies(df: DataFrame, text_col: str = "text") -> tuple[dict[bytes, int], int]:
    """In how many documents each licence word occurs, and the number of documents; at most one row a licence word reaches the driver."""
    wanted = frozenset(w for p, _ in PHRASES for w in p.encode().split()) | frozenset(w for t in TEMPLATES for w in t[2].encode().split())

    def run(batches):
        seen, n = Counter(), 0
        for part in slices(batches):
            for t in text_column(part):
                n += 1
                seen.update(wanted.intersection(alnum_words(t)))
        seen[b""] = n
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())})

    found = {bytes(r["word"]): r["n"] for r in texts(df, text_col).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return found, found.pop(b"", 0)


def scan_licenses(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds n_words, places (array of start word and label), base_labels, labels and score to the kept columns."""
    keep = list(df.columns) if keep is None else keep
    frequency, documents = frequencies(df, text_col)
    index = []

    def each(found, _):
        if not index:
            index.append(LicenseIndex(frequency, documents))
        rows = []
        for t in found:
            n, places, own, score = index[0].scan(t)
            base = {label for _, label in places}
            rows.append((n, [{"start": s, "label": label} for s, label in places], ",".join(sorted(base)), ",".join(sorted(base | own)), score))
        return rows

    return map_texts(df, text_col, keep, "n_words long, places array<struct<start: long, label: string>>, base_labels string, labels string, score double", each)
