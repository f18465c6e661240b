"""License scans: winnowed fingerprints of templates pick candidates, banded alignment confirms them.

Templates are cut into words (letters and digits, lower case). Of the ``GRAM``-word grams of a text of ``LONG`` words or
more, winnowing keeps the least hash of every window of ``WINDOW``, so that any ``GRAM + WINDOW - 1`` words in a row that
a text shares with it include a kept one. Notices shorter than that keep all their grams of ``SHORT_GRAM`` words (of two,
if they have five words or fewer): any text that has ``LEAST`` of their words in place shares one. The kept grams make an
inverted index gram -> (template, place), which is as small as the templates are. Every gram of every whole text is
looked up in it. Hits of one template whose diagonals lie within its band make a candidate, which is aligned with the
words around it (match 2, mismatch and gap -1, local) within the band. Reported are the share of the template's words
that the best alignment matches, if it is ``LEAST`` or more, and the span it covers in the text (code points, end
exclusive). Of overlapping spans the one with more matched words stays, then the one with the greater share (so that a
license that holds another one and the one that is held are told apart), then the earlier, then the first name.

Null and empty texts have no licenses. Every input row gives one row; rows repeated give equal rows; an empty table
gives an empty result. Only the id and text columns are read, so other columns can have any name.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from heatlattice.llm.common import id_and_text, map_rows
from heatlattice.llm.license_texts import TEMPLATES

GRAM, WINDOW, LONG, SHORT_GRAM, LEAST = 5, 4, 64, 3, 0.8

WORDS = re.compile(r"[A-Za-z0-9]+")
FIELDS = [
    T.StructField("n_licenses", T.LongType()),
    T.StructField("licenses", T.StringType()),
    T.StructField("found", T.ArrayType(T.StructType([T.StructField("license", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("coverage", T.DoubleType())]))),
]

Match = tuple[str, int, int, int, float]


def words_of(text: str) -> list[str]:
    return [w.lower() for w in WORDS.findall(text)]


def grams(words: list[str], size: int) -> list[tuple[str, ...]]:
    return list(zip(*(words[i:] for i in range(size)), strict=False))


def gram_of(words: list[str]) -> int:
    """Words of a template's grams."""
    return GRAM if len(words) >= LONG else SHORT_GRAM if len(words) > 5 else 2


def winnowed(words: list[str]) -> dict[int, tuple[str, ...]]:
    """Places and grams that are kept: the least hash of every window, the last one on ties; all of a short template."""
    all_grams = grams(words, gram_of(words))
    if len(words) < LONG:
        return dict(enumerate(all_grams))
    rank = [(zlib.crc32(" ".join(g).encode()), -i) for i, g in enumerate(all_grams)]
    kept = {min(range(at, at + WINDOW), key=rank.__getitem__) for at in range(len(rank) - WINDOW + 1)}
    return {i: all_grams[i] for i in sorted(kept)}


def index_of(templates: dict[str, list[str]]) -> dict[int, dict[tuple[str, ...], list[tuple[str, int]]]]:
    """By gram size: the templates and places of every kept gram."""
    out: dict = {}
    for name, words in templates.items():
        for place, gram in winnowed(words).items():
            out.setdefault(len(gram), {}).setdefault(gram, []).append((name, place))
    return out


def band_of(template: list[str]) -> int:
    return max(3, len(template) // 5)


def align(template: list[str], words: list[str], low: int, high: int) -> tuple[int, int, int]:
    """Best local alignment on the diagonals low..high (place in words less place in template): first and last word, matches."""
    best, where = 0, (0, -1, 0)
    above: dict[int, tuple[int, int, int]] = {}  # by diagonal: score, first word, matches
    for i, want in enumerate(template):
        row: dict[int, tuple[int, int, int]] = {}
        for d in range(low, high + 1):
            j = i + d
            if not 0 <= j < len(words):
                continue
            score, first, n = above.get(d, (0, j, 0))
            if score <= 0:
                score, first, n = 0, j, 0
            same = words[j] == want
            options = [(score + (2 if same else -1), n + same, -first)]
            if d + 1 in above:  # a word of the template is missing
                s, f, m = above[d + 1]
                options.append((s - 1, m, -f))
            if d - 1 in row:  # a word of the text is extra
                s, f, m = row[d - 1]
                options.append((s - 1, m, -f))
            score, n, first = max(options)
            row[d] = (score, -first, n)
            if same and score > best:
                best, where = score, (-first, j, n)
        above = row
    return where


def scan_text(text: str | None, templates: dict[str, list[str]], index: dict, least: float = LEAST) -> list[Match]:
    """(license, start, end, matched words, coverage) of a text, by start."""
    words = words_of(text or "")
    hits: dict[str, set[int]] = {}
    for size, of_size in index.items():
        for at, gram in enumerate(zip(*(words[i:] for i in range(size)), strict=False)):
            if gram in of_size:
                for name, place in of_size[gram]:
                    hits.setdefault(name, set()).add(at - place)
    if not hits:
        return []
    ends = [m.span() for m in WORDS.finditer(text)]
    found = []
    for name, diagonals in hits.items():
        template, band = templates[name], band_of(templates[name])
        groups: list[list[int]] = []
        for d in sorted(diagonals):
            if groups and d - groups[-1][-1] <= band:
                groups[-1].append(d)
            else:
                groups.append([d])
        for group in groups:
            # a long run of repeated notices makes one wide group: take it in strips of a band each
            for d in dict.fromkeys(group[0] + (x - group[0]) // (band + 1) * (band + 1) for x in group):
                first, last, n = align(template, words, d - band, d + 2 * band)
                if n >= least * len(template):
                    found.append((name, ends[first][0], ends[last][1], n, n / len(template)))
    kept: list[Match] = []
    for m in sorted(set(found), key=lambda m: (-m[3], -m[4], m[1], m[0], m[2])):
        if all(m[2] <= k[1] or k[2] <= m[1] for k in kept):
            kept.append(m)
    return sorted(kept, key=lambda m: (m[1], m[0]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """doc_id, n_licenses, licenses (name:start:end:coverage, comma-joined) and found of every row."""
    known = {name: words_of(text) for name, text in templates.items()}
    index = index_of(known)

    def rows(texts: list) -> list[list]:
        all_found = [scan_text(t, known, index, least) for t in texts]
        listed = [",".join(f"{n}:{a}:{b}:{c:.4f}" for n, a, b, _, c in f) for f in all_found]
        return [[len(f) for f in all_found], listed, [[{"license": n, "start": a, "end": b, "coverage": c} for n, a, b, _, c in f] for f in all_found]]

    return map_rows(id_and_text(docs, id_col, text_col), "doc_id", FIELDS, rows)
