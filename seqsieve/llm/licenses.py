"""License notices by conditional compression.

Around each word that every notice has some form of (license, copyright and the like), each
template is laid so that its own such words fall on it, which gives the candidate blocks:
windows a little longer than the template. A block counts if its wording differs in few
enough words: insertions, deletions and replacements against its best-fitting part, counted
exactly. That part is compressed alone and with the template as a raw zstandard dictionary;
the bytes saved, over what the template saves on itself, rank templates and places.

Cases: null and empty texts have no findings; texts are read whole, and only windows of
texts that hold an anchor word are compressed; equal blocks are judged once per task, within
a bound; overlapping findings leave the better ranked, then the earlier; repeated rows are
scanned alike; an empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqsieve.llm.common import on_workers

#: Wordings of common notices.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance'
        " with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless"
        " required by applicable law or agreed to in writing, software distributed under the License is distributed on"
        ' an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for'
        " the specific language governing permissions and limitations under the License.",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
        " option) any later version.",
    ),
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        ' documentation files (the "Software"), to deal in the Software without restriction, including without'
        " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the"
        " Software, and to permit persons to whom the Software is furnished to do so, subject to the following"
        " conditions: The above copyright notice and this permission notice shall be included in all copies or"
        " substantial portions of the Software.",
    ),
]
ANCHOR = re.compile(r"licen[cs]|copyright|copyleft", re.IGNORECASE)
#: Further wordings that the operator knows by default: (license, wording, words that must be there).
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General"
    " Public License as published by the Free Software Foundation, either version {1} of the License, or (at your"
    " option) any later version."
)
_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
    " following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list"
    " of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright"
    " notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided"
    " with the distribution."
)
_BSD_END = (
    ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,'
    " INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE"
    " DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,"
    " SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR"
    " SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,"
    " WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE"
    " OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: SPDX identifier, words that tell it, how notices call it.
_CALLED = [
    ("Apache-2.0", "apache 2.0", "the Apache License, Version 2.0"), ("MIT", "mit", "the MIT License"),
    ("BSD-2-Clause", "bsd 2-clause", "the BSD 2-Clause License"), ("BSD-3-Clause", "bsd 3-clause", "the BSD 3-Clause License"),
    ("ISC", "isc", "the ISC License"), ("MPL-2.0", "mozilla 2.0", "the Mozilla Public License, version 2.0"),
    ("GPL-2.0", "gnu general 2", "the GNU General Public License, version 2"),
    ("GPL-3.0", "gnu general 3", "the GNU General Public License, version 3"),
    ("LGPL-2.1", "gnu lesser 2.1", "the GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "gnu lesser 3", "the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "gnu affero 3", "the GNU Affero General Public License, version 3"), ("Unlicense", "unlicense", "the Unlicense"),
    ("CC-BY-4.0", "cc by 4.0", "CC BY 4.0"), ("CC-BY-SA-4.0", "cc by-sa 4.0", "CC BY-SA 4.0"), ("CC-BY-NC-4.0", "cc by-nc 4.0", "CC BY-NC 4.0"),
    ("CC-BY-ND-4.0", "cc by-nd 4.0", "CC BY-ND 4.0"), ("CC-BY-NC-SA-4.0", "cc by-nc-sa 4.0", "CC BY-NC-SA 4.0"),
    ("CC-BY-NC-ND-4.0", "cc by-nc-nd 4.0", "CC BY-NC-ND 4.0"), ("CC0-1.0", "cc0 1.0", "CC0 1.0"),
]
COMMON = [
    *TEMPLATES,
    *[(name, f"{verb} {called}.", needed) for name, needed, called in _CALLED for verb in ("Licensed under", "Released under") if ANCHOR.search(verb + called)],
    *[(name, f"SPDX-License-Identifier: {form}", form.lower()) for name, *_ in _CALLED for form in ((name,) if "GPL" not in name else (name, f"{name}-only", f"{name}-or-later"))],
    ("GPL-2.0", _GNU.format("", "2"), "2"), ("LGPL-2.1", _GNU.format("Lesser ", "2.1"), "lesser 2.1"),
    ("LGPL-3.0", _GNU.format("Lesser ", "3"), "lesser 3"), ("AGPL-3.0", _GNU.format("Affero ", "3"), "affero 3"),
    ("BSD-2-Clause", _BSD_START + _BSD_END),
    (
        "BSD-3-Clause",
        _BSD_START + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse"
        " or promote products derived from this software without specific prior written permission." + _BSD_END,
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not"
        " distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "MIT",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE'
        " WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS"
        " OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR"
        " OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,"
        " use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any"
        " purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author"
        " or authors of this software dedicate any and all copyright interest in the software to the public domain.",
    ),
]
_word = re.compile(r"[^\x20\x09-\x0D]+")
_edge = re.compile(r"^\W+|\W+$")
#: Differing words allowed per word of template, and in those of 4 and of 6 words on at least.
DIFFERENCES, LEAST_DIFFERENCES = 0.1, ((4, 1), (6, 2))
#: Words that tell licenses apart: none may come, go or be replaced.
_TELLING = {w for _, needed, _ in _CALLED for w in needed.split()} | {"by", "by-nc", "by-sa", "gpl", "lgpl", "agpl", "bsd", "3.0", "1.0"}
_BLOCKS_KEPT = 20_000


def _plain(word: str) -> str:
    """Without marks around it, in lower case and American spelling."""
    return _edge.sub("", word).lower().replace("licenc", "licens")


@dataclass
class Template:
    name: str
    text: str
    needed: str = ""

    @cached_property
    def words(self) -> list[str]:
        return [_plain(w) for w in self.text.split()]

    @cached_property
    def anchors(self) -> list[int]:
        return [i for i, w in enumerate(self.words) if ANCHOR.search(w)]

    @cached_property
    def with_dictionary(self) -> zstandard.ZstdCompressor:
        content = zstandard.ZstdCompressionDict(" ".join(self.words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return zstandard.ZstdCompressor(level=9, dict_data=content, write_content_size=False)

    @cached_property
    def own_saving(self) -> int:
        return max(1, self._saving(" ".join(self.words).encode()))

    @cached_property
    def allowed(self) -> int:
        """Words that may differ."""
        return max(int(DIFFERENCES * len(self.words)), *(n for least, n in LEAST_DIFFERENCES if least <= len(self.words)), 0, 0)

    @cached_property
    def telling(self) -> frozenset[str]:
        """The words that must be there; in short notices, all that tell licenses apart."""
        short = _TELLING.intersection(self.words) if len(self.words) < 20 else ()
        return frozenset(self.needed.split()).union(short)

    def may_be_in(self, words: set[str]) -> bool:
        """Each word that is not there differs once at least."""
        return self.telling <= words and len(self.kinds - words) <= self.allowed

    @cached_property
    def kinds(self) -> frozenset[str]:
        return frozenset(self.words)

    def tells(self, words: Iterable[str]) -> bool:
        """Whether such words name this license and no other."""
        words = set(words)
        return self.telling <= words and (not self.telling or _TELLING.intersection(words).issubset(self.words))

    def _saving(self, block: bytes) -> int:
        return len(_alone().compress(block)) - len(self.with_dictionary.compress(block))

    def saved(self, block: list[str]) -> float:
        """Bytes that knowing the template saves on the compressed words, over those it saves on itself."""
        return self._saving(" ".join(block).encode()) / self.own_saving

    def fit(self, block: list[str]) -> tuple[int, int, int]:
        """Words that differ from the best-fitting part of the block, its first word and its end."""
        # a row of (differences, first word) by end in the block; a part may begin anywhere
        row = [(0, j) for j in range(len(block) + 1)]
        for i, own in enumerate(self.words, 1):
            new = [(i, 0)]
            for j, word in enumerate(block, 1):
                same = (row[j - 1][0] + (own != word), row[j - 1][1])
                new.append(min(same, (row[j][0] + 1, row[j][1]), (new[j - 1][0] + 1, new[j - 1][1])))
            row = new
        differing, end, start = min((d, j, s) for j, (d, s) in enumerate(row))
        return differing, start, end


_compressor: list[zstandard.ZstdCompressor] = []


def _alone() -> zstandard.ZstdCompressor:
    if not _compressor:
        _compressor.append(zstandard.ZstdCompressor(level=9, write_content_size=False))
    return _compressor[0]


class Scanner:
    def __init__(self, templates: Iterable[tuple[str, ...]]) -> None:
        self.templates = [Template(*t) for t in templates]
        if not all(t.anchors for t in self.templates):
            raise ValueError("a template without an anchor word finds nothing")
        self.known: dict = {}

    def _judged(self, which: int, block: tuple[str, ...]) -> tuple | None:
        """(saved, differing, start, end) of a block whose wording is near enough."""
        key = (which, block)
        if key not in self.known:
            if len(self.known) >= _BLOCKS_KEPT:
                self.known.clear()
            template, found = self.templates[which], None
            if template.may_be_in(set(block)):
                differing, start, end = template.fit(list(block))
                if differing <= template.allowed and start < end and template.tells(block[start:end]):
                    found = (template.saved(list(block[start:end])), differing, start, end)  # neighbours have no say
            self.known[key] = found
        return self.known[key]

    def scan(self, text: str) -> list[tuple[str, int, int, int, float]]:
        """(license, start, end, differing words, share saved) by place; positions are code points."""
        if not ANCHOR.search(text):
            return []
        spans = [m.span() for m in _word.finditer(text)]
        words = [_plain(text[a:b]) for a, b in spans]
        ranked = []
        all_words = set(words)
        possible = [(i, t) for i, t in enumerate(self.templates) if t.may_be_in(all_words)]
        for at, word in enumerate(words):
            if not ANCHOR.search(word):
                continue
            for which, template in possible:
                slack = 2 + len(template.words) // 10
                for anchor in template.anchors:  # any form may stand for any other
                    first = max(0, at - anchor - slack)
                    block = tuple(words[first : max(0, at - anchor + len(template.words) + slack)])
                    found = self._judged(which, block)
                    if found:
                        saved, differing, start, end = found
                        ranked.append((-saved * len(template.words), differing, first + start, first + end, which))
        taken: list[tuple] = []
        ends: set[int] = set()  # words that findings cover
        for rank, differing, start, end, which in sorted(set(ranked)):
            if not ends.intersection(range(start, end)):
                ends.update(range(start, end))
                template = self.templates[which]
                taken.append((template.name, spans[start][0], spans[end - 1][1], differing, -rank / len(template.words)))
        return sorted(taken, key=lambda t: t[1])


def scan_licenses(docs: DataFrame, templates: Iterable[tuple[str, ...]] = tuple(COMMON)) -> DataFrame:
    """doc_id and findings (array of license, start, end, differences, saved) of every row."""
    spark = docs.sparkSession
    on_workers(spark)
    templates = list(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        kind = pa.list_(
            pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("differences", pa.int64()), ("saved", pa.float64())])
        )
        names = [f.name for f in kind.value_type]
        for batch in batches:
            rows = []
            for text in batch.column(1):
                found = scanner.scan((text.as_py() or b"").decode("utf-8", "replace"))
                rows.append([dict(zip(names, f, strict=True)) for f in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "findings"])

    finding = T.StructType().add("license", "string").add("start", "long").add("end", "long").add("differences", "long").add("saved", "double")
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("findings", T.ArrayType(finding))])
    return docs.select("doc_id", docs["text"].cast("binary")).mapInArrow(run, schema)


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_findings, the licenses found (null if none) and the findings as text."""
    listed = F.transform("findings", lambda f: F.concat_ws(":", f["license"], f["start"], f["end"], f["differences"]))
    names = F.array_join(F.sort_array(F.array_distinct("findings.license")), ",")
    return found.select(
        "doc_id", F.size("findings").cast("bigint").alias("n_findings"),
        F.when(F.size("findings") > 0, names).alias("licenses"), F.array_join(listed, ",").alias("findings"),
    )
