"""License scans: winnowed fingerprints pick candidates, banded alignment measures them.

Templates are winnowed into an inverted index (fingerprint -> template and place). Every gram of a whole document is looked up in it, which
gives candidates by template and diagonal (text place minus template place). Neighbouring diagonals are aligned word by word in one band and
reported with coverage and span where enough of the template is there; words that a match took are left out, and the band is aligned
again until no place is left.

A place at which up to a fifth of a template's words are replaced, lost or pushed apart keeps a run of four words (of two, in
templates of less than SHORT words), so the index meets it: GRAM + WINDOW - 1 words, and each pair of words in short templates.

An index holds template words alone, INDEX_WORDS at most, and goes to the tasks as it is; more templates are scanned in parts.

Nulls and odd input: a null, empty or wordless text has no match; a null doc_id is carried; rows that repeat a doc_id are
scanned each; a template found several times in a text, even back to back, gives a row per place; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

GRAM, WINDOW, BAND, COVERAGE = 3, 2, 8, 0.8
#: Templates of fewer words are filed under each of their pairs of words.
SHORT = 20
INDEX_WORDS, TEMPLATE_BYTES = 2_000_000, 64 << 20

# The wording of license notices.
TEMPLATES = {
    "Apache-2.0 (notice)": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0 (notice)": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0 (notice)": "This work is licensed under the GNU General Public License, version 3.",
    "MIT (notice)": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
}

#: ASCII letters and digits, lower-cased, and bytes of other characters make words; all other bytes part them.
_FOLD = bytes(ord(chr(b).lower()) if chr(b).isalnum() or b >= 128 else 32 for b in range(128)) + bytes(range(128, 256))
_WORDS = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
#: A score is matched words times this, plus the place of the first one.
_ONE = 1 << 40


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def winnow(words: list[bytes], gram: int = GRAM, window: int = WINDOW) -> list[int]:
    """Places of the word grams whose hash is the least of some window; of equal ones the last."""
    n = len(words) - gram + 1
    if n < 1:
        return []
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + gram])) for i in range(n)]
    return sorted({max(range(i, min(i + window, n)), key=lambda k: (-hashes[k], k)) for i in range(max(1, n - window + 1))})


class Index:
    """Grams of template words, by word numbers, with the templates and places that they were picked at."""

    def __init__(self, templates: dict[str, str]):
        self.names, own = list(templates), [words_of(t.encode()) for t in templates.values()]
        self.code = {w: i for i, w in enumerate(dict.fromkeys(w for words in own for w in words))}
        if len(self.code) > INDEX_WORDS:
            raise ValueError(f"a template of more than {INDEX_WORDS} different words")
        self.words = [np.array([self.code[w] for w in words], np.int64) for words in own]
        self.counts = [np.bincount(ids, minlength=len(self.code)) for ids in self.words]
        self.filed = {}
        for gram in (2, GRAM):
            rows = [(self.gram_codes(self.words[k], gram)[at], k, at) for k, words in enumerate(own) for at in (winnow(words, 2, 1) if len(words) < SHORT else winnow(words)) if (gram == 2) == (len(words) < SHORT)]
            self.filed[gram] = np.array(sorted(rows), np.int64).reshape(-1, 3)

    def gram_codes(self, ids: np.ndarray, gram: int) -> np.ndarray:
        """A number per gram; -1 where a word isn't any template's."""
        n = max(0, len(ids) - gram + 1)
        out, known = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(gram):
            out = out * len(self.code) + ids[k : n + k]
            known &= ids[k : n + k] >= 0
        return np.where(known, out, -1)

    def candidates(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Sorted distinct (template, diagonal) of the text's grams."""
        found = set()
        for gram, filed in self.filed.items():
            codes = self.gram_codes(ids, gram)
            at = np.flatnonzero(codes >= 0)
            lo, hi = np.searchsorted(filed[:, 0], codes[at]), np.searchsorted(filed[:, 0], codes[at], "right")
            for place, a, b in zip(at[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                found.update((k, place - there) for k, there in filed[a:b, 1:].tolist())
        return sorted(found)


def align(template: np.ndarray, text: np.ndarray, lowest: int, highest: int) -> tuple[int, int, int]:
    """Longest common subsequence of template and text over diagonals (text place minus template place) lowest..highest.

    Returns matched words, and the first and the last text word of the match (none: 0, 0, -1). Of matches of equal length
    the one that begins last counts, of these the one that ends first."""
    width, m = highest - lowest + 1, len(template)
    seen = np.full(m + width - 1, -1, np.int64)
    a, b = max(0, lowest), min(len(text), highest + m)
    if b > a:
        seen[a - lowest : b - lowest] = text[a:b]
    score, best, last = np.zeros(width, np.int64), 0, -1
    begins = np.arange(lowest, lowest + width)
    for i, w in enumerate(template.tolist()):
        same = seen[i : i + width] == w
        row = np.maximum(score, np.append(score[1:], 0))
        if same.any():
            ended = np.where(same, np.where(score > 0, score, begins + i) + _ONE, 0)
            k = int(ended.argmax())
            top, place = int(ended[k]), lowest + i + k
            if top > best or (top == best and place < last):
                best, last = top, place
            row = np.maximum(row, ended)
        score = np.maximum.accumulate(row)
    return (best // _ONE, best % _ONE, last) if best else (0, 0, -1)


def bands(diagonals: list[int], size: int, band: int = BAND) -> Iterator[tuple[int, int]]:
    """Lowest and highest diagonal of each band. Gaps in it are ``band`` at most; it is narrower than two places of the template lie apart."""
    near, wide = max(1, min(band, size // 5)), max(1, size // 2)
    first = last = diagonals[0]
    for d in diagonals[1:]:
        if d - last > near or d - first > wide:
            yield first - near, last + near
            first = d
        last = d
    yield first - near, last + near


def reach(counts: np.ndarray, text: np.ndarray, lowest: int, highest: int, size: int) -> int:
    """The most words that an alignment within a band can match: those that template and stretch of text have in common, repeats included."""
    stretch = text[max(0, lowest) : max(0, highest + size)]
    return int(np.minimum(counts, np.bincount(stretch[stretch >= 0], minlength=len(counts))).sum())


def scan(text: bytes, index: Index, band: int = BAND, coverage: float = COVERAGE) -> list[tuple]:
    """(template, coverage, matched words, first word, last word) of each place where enough of a template is."""
    words = words_of(text)
    ids = np.fromiter(map(index.code.get, words, repeat(-1)), np.int64, len(words))
    by_template: dict[int, list[int]] = {}
    for k, d in index.candidates(ids):
        by_template.setdefault(k, []).append(d)
    found = []
    for k, diagonals in by_template.items():
        template, left = index.words[k], ids.copy()
        for lowest, highest in bands(diagonals, len(template), band):
            # An alignment takes time with the template's size times the band's width; most bands can't reach the coverage.
            while reach(index.counts[k], left, lowest, highest, len(template)) >= coverage * len(template) - 1e-9:
                matched, first, last = align(template, left, lowest, highest)
                if matched < coverage * len(template) - 1e-9:
                    break
                found.append((k, matched / len(template), matched, first, last))
                left[first : last + 1] = -1
    return sorted(found)


MATCH = "doc_id long, license string, coverage double, matched_words long, first_word long, last_word long, start_char long, end_char long"


def _scan(templates: dict[str, str], band: int, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                found = scan(text, index, band, coverage) if text else []
                if found:
                    spans = [m.span() for m in _WORDS.finditer(text.decode("utf-8", "replace"))]
                    rows += [(doc, index.names[k], c, m, a, b, spans[a][0], spans[b][1]) for k, c, m, a, b in found]
            yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, r)) for r in rows], _TYPES)

    return run


_NAMES = [x.split()[0] for x in MATCH.split(", ")]
_TYPES = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[t]) for n, t in (x.split() for x in MATCH.split(", "))])


def load_templates(table: DataFrame, name: str = "name", text: str = "text", most: int = TEMPLATE_BYTES) -> dict[str, str]:
    """Templates from a table, of which the size is asked before they come to the driver: it may be ``most`` bytes."""
    rows = table.select(F.col(name).cast("string").alias("name"), F.col(text).cast("string").alias("text")).filter("name IS NOT NULL AND text IS NOT NULL")
    held, n, names = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*"), F.countDistinct("name")).first()
    if held > most:
        raise ValueError(f"templates of {held} bytes; load at most {most} at a time")
    if n != names:
        raise ValueError("template names repeat")
    return {r["name"]: r["text"] for r in rows.orderBy("name").collect()}


def template_parts(templates: dict[str, str], most: int = INDEX_WORDS) -> list[dict[str, str]]:
    """Parts of at most ``most`` words; a template is never cut."""
    parts: list[dict[str, str]] = [{}]
    held = 0
    for name, text in templates.items():
        n = len(words_of(text.encode()))
        if parts[-1] and held + n > most:
            parts.append({})
            held = 0
        parts[-1][name] = text
        held += n
    return parts


def license_matches(docs: DataFrame, templates: dict[str, str] = TEMPLATES, band: int = BAND, coverage: float = COVERAGE, index_words: int = INDEX_WORDS) -> DataFrame:
    """One row per place of a template in a text: doc_id, license, coverage, words matched, and the span in words and characters.

    One pass over the texts for each ``index_words`` words of templates."""
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return reduce(DataFrame.unionByName, [narrow.mapInArrow(_scan(part, band, coverage), MATCH) for part in template_parts(templates, index_words)])
