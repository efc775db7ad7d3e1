"""License scans: winnowed fingerprints pick candidate templates, banded alignment confirms them."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tillscope.llm.common import text_or_empty
from tillscope.llm.license_templates import TEMPLATES

#: Words of a gram, and neighbouring grams of which the smallest is a fingerprint. Every common
#: stretch of GRAM + WINDOW - 1 words shares a fingerprint. Wordings so short that a match need not
#: hold such a stretch have all their grams indexed, of fewer words if needed.
GRAM, WINDOW = 3, 2
#: Least share of a template's words that an alignment must match.
COVERAGE = 0.8
#: Scores of an alignment's steps, and words that it may drift from the diagonal at least.
MATCH, MISMATCH, GAP = 2, -1, -1
DRIFT, DRIFT_SHARE = 3, 0.1
#: Words that name a license. One that stands in a wording of which not all grams are winnowed must
#: stand in its match too: "Released under the Apache License" is four of five words of MIT's line.
NAMES = frozenset({"mit", "apache", "bsd", "gnu", "mozilla", "cc", "creative"})
REMEMBERED = 100_000
#: Diagonals of one template aligned together.
ALIGNED = 256

WORDS = re.compile(r"[^\W_]+")
MIX = np.uint64(0x9E3779B97F4A7C15)


class Grams:
    """Hashes of words and grams; remembers the hashes of words, at most ``REMEMBERED``."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def word(self, word: str) -> int:
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        data = word.encode()
        found = self.known[word] = zlib.crc32(data) << 32 | zlib.crc32(data, 0x2545F491)
        return found

    def hashes(self, words: Sequence[str]) -> np.ndarray:
        known, word = self.known, self.word
        return np.array([known.get(w) or word(w) for w in words], dtype=np.uint64)

    def grams(self, hashes: np.ndarray, size: int) -> np.ndarray:
        """Values of all grams of ``size`` words, by their places."""
        count = max(len(hashes) - size + 1, 0)
        grams = np.zeros(count, dtype=np.uint64)
        for i in range(size):
            grams = (grams ^ hashes[i : i + count]) * MIX
            grams ^= grams >> np.uint64(29)
        return grams

    def winnowed(self, grams: np.ndarray) -> np.ndarray:
        """Places of the fingerprints: of every ``WINDOW`` neighbours the smallest, of equals the last."""
        if not len(grams):
            return np.zeros(0, dtype=np.int64)
        window = min(WINDOW, len(grams))
        spans = np.lib.stride_tricks.sliding_window_view(grams, window)
        return np.unique(np.arange(len(spans)) + window - 1 - spans[:, ::-1].argmin(axis=1))


def stretch(count: int) -> int:
    """Words in a row that a match of a wording of ``count`` words holds, if none are put in.

    At most k words are missing or changed; they cut the others into k + 1 stretches.
    """
    matched = math.ceil(COVERAGE * count - 1e-9)
    return -(-matched // (count - matched + 1))


def period(words: Sequence[str]) -> int:
    """Smallest distance at which a list of words goes on like itself; its length if there is none."""
    return next(d for d in range(1, len(words) + 1) if list(words[d:]) == list(words[: len(words) - d])) if words else 0


def align(template: Sequence, text: Sequence, shift: int, drift: int) -> tuple[int, int, int, int]:
    """Best local alignment of a template with a stretch of a text, near a diagonal.

    Word i of the template may meet words i + shift - drift .. i + shift + drift of the text.
    Returns the score, the number of matched words, and the first and last matched place in the
    text (-1 without any); of equal scores the one that ends first in the template, then in the
    text. Only the band's cells are visited and only two rows of them are kept, each with the
    matches and the start of the alignment that ends there.
    """
    none = (0, 0, -1)
    width = 2 * drift + 1
    best, before = (0, 0, -1, -1), [none] * (width + 2)
    for i, word in enumerate(template):
        row = [none] * (width + 2)
        low = i + shift - drift
        for k in range(width):
            j = low + k
            if not 0 <= j < len(text):
                continue
            # The previous row's band lies one place to the left.
            score, matched, first = before[k + 1]
            if word == text[j]:
                cell = (score + MATCH, matched + 1, j if first < 0 else first)
            else:
                cell = (score + MISMATCH, matched, first)
            for score, matched, first in (before[k + 2], row[k]):
                if score + GAP > cell[0]:
                    cell = (score + GAP, matched, first)
            if cell[0] <= 0:
                cell = none
            elif word == text[j] and cell[0] > best[0]:
                best = (*cell, j)
            row[k + 1] = cell
        before = row
    return best


def align_many(
    template: np.ndarray, text: np.ndarray, shifts: np.ndarray, drift: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """:func:`align` near several diagonals of one text, a row of the template at a time for all.

    Words are numbers here. A row of the band is first filled from the row above; what a gap along
    the row brings is the running maximum of score plus place, of equals the nearest.
    """
    count, width = len(shifts), 2 * drift + 1
    k, rows = np.arange(width), np.arange(len(shifts))
    score = np.zeros((count, width + 1), dtype=np.int64)
    matched, first = np.zeros_like(score), np.full_like(score, -1)
    best = [np.zeros(count, dtype=np.int64), np.zeros(count, dtype=np.int64)]
    best += [np.full(count, -1), np.full(count, -1)]
    for i, word in enumerate(template):
        place = (shifts + i - drift)[:, None] + k
        valid = (place >= 0) & (place < len(text))
        same = valid & (text[np.where(valid, place, 0)] == word)
        # The row above lies one place to the left.
        value = score[:, :-1] + np.where(same, MATCH, MISMATCH)
        words, begun = matched[:, :-1] + same, np.where(same & (first[:, :-1] < 0), place, first[:, :-1])
        above = score[:, 1:] + GAP
        gap = above > value
        value = np.where(valid, np.where(gap, above, value), 0)
        words, begun = np.where(gap, matched[:, 1:], words), np.where(gap, first[:, 1:], begun)
        key = np.maximum(value, 0) - GAP * k
        highest = np.maximum.accumulate(key, axis=1)
        source = np.maximum.accumulate(np.where(key == highest, k, 0), axis=1)
        value = np.where(valid, highest + GAP * k, 0)
        alive = value > 0
        score[:, :-1] = np.where(alive, value, 0)
        matched[:, :-1] = np.where(alive, np.take_along_axis(words, source, axis=1), 0)
        first[:, :-1] = np.where(alive, np.take_along_axis(begun, source, axis=1), -1)
        ends = np.where(same, score[:, :-1], 0)
        at = ends.argmax(axis=1)
        better = np.flatnonzero(ends[rows, at] > best[0])
        if len(better):
            where = at[better]
            for kept, found in zip(best, (score, matched, first)):
                kept[better] = found[better, where]
            best[3][better] = place[better, where]
    return tuple(best)


class Scanner:
    """The templates' inverted index and the search of one text."""

    def __init__(self, templates: Sequence[tuple[str, str]]) -> None:
        self.grams = Grams()
        self.templates = [(name, WORDS.findall(text.lower())) for name, text in templates]
        self.short = [stretch(len(words)) < GRAM + WINDOW - 1 for _, words in self.templates]
        self.lone = [period(words) > 2 * self.drift(number) for number, (_, words) in enumerate(self.templates)]
        #: Numbers of the templates' words, and the templates and the names in them as numbers.
        self.numbers: dict[str, int] = {}
        for _, words in self.templates:
            for word in words:
                self.numbers.setdefault(word, len(self.numbers))
        self.ids = [np.array([self.numbers[w] for w in words], dtype=np.int64) for _, words in self.templates]
        self.named = [{self.numbers[w] for w in NAMES.intersection(words)} for _, words in self.templates]
        #: Matched words, first and last place of stretches that were aligned, at most a tenth of ``REMEMBERED``.
        self.aligned: dict[tuple, tuple[int, int, int]] = {}
        #: By the words of a gram, and whether all grams are looked up or the winnowed ones.
        self.indexes: dict[tuple[int, bool], dict[int, list[tuple[int, int]]]] = {}
        for number, (_, words) in enumerate(self.templates):
            size = max(1, min(GRAM, stretch(len(words))))
            grams = self.grams.grams(self.grams.hashes(words), size)
            places = range(len(grams)) if self.short[number] else self.grams.winnowed(grams)
            index = self.indexes.setdefault((size, self.short[number]), {})
            for place in places:
                index.setdefault(int(grams[place]), []).append((number, int(place)))
        self.values = {key: np.array(sorted(index), dtype=np.uint64) for key, index in self.indexes.items()}

    def diagonals(self, hashes: np.ndarray) -> list[tuple[int, int]]:
        """(template, place where it would begin) of every gram that a template and the text share."""
        found = set()
        for key, values in self.values.items():
            size, every = key
            grams = self.grams.grams(hashes, size)
            if not len(grams) or not len(values):
                continue
            place = np.arange(len(grams)) if every else self.grams.winnowed(grams)
            value = grams[place]
            at = np.minimum(np.searchsorted(values, value), len(values) - 1)
            for h in np.flatnonzero(values[at] == value):
                found |= {(number, int(place[h]) - start) for number, start in self.indexes[key][int(value[h])]}
        return sorted(found)

    def narrow(self, diagonals: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """One for each run of neighbouring diagonals."""
        kept: list[tuple[int, int]] = []
        for number, shift in diagonals:
            if kept and kept[-1][0] == number and shift - kept[-1][1] <= self.drift(number) // 2:
                continue
            kept.append((number, shift))
        return kept

    def wide(self, kept: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(template, first, last diagonal): the diagonals less than the wording's length apart, from each one on."""
        found = []
        end = 0
        for k, (number, shift) in enumerate(kept):
            end = max(end, k)
            while end + 1 < len(kept) and kept[end + 1][0] == number and kept[end + 1][1] - shift < len(
                self.templates[number][1]
            ):
                end += 1
            if end > k:
                found.append((number, shift, kept[end][1]))
        return found

    def matches(
        self, words: list[str], wanted: list[tuple[int, int, int]]
    ) -> list[tuple[int, float, int, int, int] | None]:
        """The best match of each (template, first diagonal, last diagonal), in the order of preference.

        A wording that stands at its diagonal word for word needs no alignment, unless it could
        stand a second time within the band; others of one template are aligned together, and a
        stretch of text that was aligned before, in any text of the task, is not aligned again.
        """
        found: list[tuple[int, float, int, int, int] | None] = [None] * len(wanted)
        together: dict[tuple[int, int], dict[tuple, list[tuple[int, int]]]] = {}
        ids = None
        for at, (number, first, last) in enumerate(wanted):
            template = self.templates[number][1]
            n = len(template)
            if first == last >= 0 and self.lone[number] and words[first : first + n] == template:
                found[at] = -n, -1.0, number, first, first + n - 1
                continue
            # A band needs a middle: an odd number of diagonals more is looked at in its last one.
            reach = (last - first + 1) // 2
            shift, drift = first + reach, self.drift(number) + reach
            if ids is None:
                known = self.numbers
                ids = np.array([known.get(w, -1) for w in words], dtype=np.int64)
            low = max(0, shift - drift)
            part = ids[low : shift + n + drift]
            if np.isin(self.ids[number], part).sum() < COVERAGE * n - 1e-9:
                continue
            key = number, shift - low, drift, part.tobytes()
            if key in self.aligned:
                found[at] = self.accepted(number, part, low, *self.aligned[key])
            else:
                together.setdefault((number, drift), {}).setdefault(key, []).append((at, shift))
        for (number, drift), stretches in together.items():
            template, keys = self.ids[number], list(stretches)
            for start in range(0, len(keys), ALIGNED):
                some = keys[start : start + ALIGNED]
                shifts = np.array([stretches[key][0][1] for key in some])
                results = align_many(template, ids, shifts, drift)
                for key, shift, (_, matched, begin, end) in zip(some, shifts.tolist(), zip(*map(np.ndarray.tolist, results))):
                    low = max(0, shift - drift)
                    if len(self.aligned) >= REMEMBERED // 10:
                        self.aligned.clear()
                    result = self.aligned[key] = matched, begin - low, end - low
                    for at, shift in stretches[key]:
                        low = max(0, shift - drift)
                        found[at] = self.accepted(number, ids[low : shift + len(template) + drift], low, *result)
        return found

    def accepted(
        self, number: int, part: np.ndarray, low: int, matched: int, start: int, end: int
    ) -> tuple[int, float, int, int, int] | None:
        """A match, unless it covers too little or lacks the license's name where it must hold it."""
        coverage = matched / len(self.ids[number])
        if coverage < COVERAGE:
            return None
        if self.short[number] and not self.named[number] <= set(part[start : end + 1].tolist()):
            return None
        return -matched, -coverage, number, start + low, end + low

    def drift(self, number: int) -> int:
        return max(DRIFT, int(DRIFT_SHARE * len(self.templates[number][1])))

    def scan(self, text: str) -> list[tuple[str, int, float, int, int, int, int]]:
        """License, template, coverage, first and last word, first and last character of each match.

        Of matches that overlap in the text the one with more matched words stays, then the one with
        the larger coverage, then the earlier template.
        """
        words = WORDS.findall(text.lower())
        kept = self.narrow(self.diagonals(self.grams.hashes(words)))
        near = self.matches(words, [(number, shift, shift) for number, shift in kept])
        hit = {at for at, found in zip(kept, near, strict=True) if found}
        # Words put in, or left out, move the rest of a wording to another diagonal.
        far = self.matches(words, [w for w in self.wide(kept) if w[:2] not in hit and (w[0], w[2]) not in hit])
        matches = [found for found in near + far if found]
        if not matches:
            return []
        # Lower-casing may change a text's length, so places are taken from the text itself.
        spans = [m.span() for m in WORDS.finditer(text)]
        if len(spans) != len(words):
            spans = [(-1, -1)] * len(words)
        taken, found = [], []
        for matched, coverage, number, first, last in sorted(set(matches)):
            if any(first <= b and last >= a for a, b in taken):
                continue
            taken.append((first, last))
            found.append((self.templates[number][0], number, -coverage, first, last, spans[first][0], spans[last][1]))
        return sorted(found, key=lambda m: m[3])


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Licenses named or quoted in each whole text, a row per match.

    Columns ``doc_id``, ``license``, ``template`` (number of the wording), ``coverage`` (share of its
    words matched), ``first_word``, ``last_word`` (from 0), ``first_char``, ``end_char`` (places in
    the text; the end is exclusive; -1 where lower-casing changes the number of words). Words are
    runs of letters and digits, in any case. The templates are a fixed list that goes to every task;
    the documents are read once, without a shuffle. NULL and empty texts match nothing; repeated
    rows give repeated matches; other columns are dropped.
    """
    wordings = list(templates)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(wordings)
        for batch in batches:
            rows = [
                (doc_id, *match)
                for doc_id, text in zip(batch["doc_id"], batch["text"])
                for match in scanner.scan(text)
            ]
            names = ["doc_id", "license", "template", "coverage", "first_word", "last_word", "first_char", "end_char"]
            found = pd.DataFrame(rows, columns=names)
            found["doc_id"] = found["doc_id"].astype("Int64")
            yield found

    schema = (
        "doc_id long, license string, template int, coverage double, first_word long, last_word long,"
        " first_char long, end_char long"
    )
    return docs.select("doc_id", text_or_empty().alias("text")).mapInPandas(scan, schema)
