from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from tillscope.llm import license_scan as ls
from tillscope.llm.license_templates import TEMPLATES
from tillscope.llm.registry import QUERIES

PROSE = [" ".join(random.Random(i).choices(["the", "of", "license", "under", "this", "work", "blue", "sea", "is"], k=80)) for i in range(20)]


@pytest.fixture(scope="module")
def scanner():
    return ls.Scanner(TEMPLATES)


def full_alignment(template, text, shift, drift):
    """Smith and Waterman over the whole matrix; cells off the band count for nothing."""
    cells = {}
    best = (0, 0, -1, -1)
    for i, word in enumerate(template):
        for j, other in enumerate(text):
            if abs(j - i - shift) > drift:
                continue
            s, m, f = cells.get((i - 1, j - 1), (0, 0, -1))
            cell = (s + ls.MATCH, m + 1, j if f < 0 else f) if word == other else (s + ls.MISMATCH, m, f)
            for s, m, f in (cells.get((i - 1, j), (0, 0, -1)), cells.get((i, j - 1), (0, 0, -1))):
                if s + ls.GAP > cell[0]:
                    cell = (s + ls.GAP, m, f)
            if cell[0] > 0:
                cells[i, j] = cell
                if word == other and cell[0] > best[0]:
                    best = (*cell, j)
    return best


def test_banded_alignment_equals_the_full_one():
    pick = random.Random(3)
    for _ in range(300):
        template = pick.choices("abcde", k=pick.randrange(1, 25))
        text = [c for c in template if pick.random() < 0.9]
        text = pick.choices("abcde", k=3) + [c if pick.random() < 0.9 else "z" for c in text] + pick.choices("abcde", k=3)
        shift, drift = pick.randrange(-2, 6), pick.randrange(0, 6)
        assert ls.align(template, text, shift, drift) == full_alignment(template, text, shift, drift)


def test_alignments_together_equal_those_one_by_one():
    pick = random.Random(5)
    for _ in range(400):
        letters = pick.randrange(1, 6)
        template = ls.np.array([pick.randrange(letters) for _ in range(pick.randrange(1, 30))])
        text = [int(c) for c in template if pick.random() < 0.9] * pick.randrange(1, 3)
        text = [pick.randrange(letters) for _ in range(4)] + [c if pick.random() < 0.9 else 9 for c in text]
        drift = pick.randrange(0, 7)
        shifts = ls.np.array([pick.randrange(-9, len(text) + 3) for _ in range(pick.randrange(1, 6))])
        found = ls.align_many(template, ls.np.array(text), shifts, drift)
        for shift, *one in zip(shifts.tolist(), *(f.tolist() for f in found)):
            assert tuple(one) == ls.align(template.tolist(), text, shift, drift)


def brute_force(scanner, text):
    """Every template at every place, aligned cell by cell; the same choice among overlapping matches."""
    words = ls.WORDS.findall(text.lower())
    found = set()
    for number, (_, template) in enumerate(scanner.templates):
        need = ls.COVERAGE * len(template) - 1e-9
        if sum(w in set(words) for w in template) < need:
            continue
        drift = scanner.drift(number)
        for shift in range(-len(template), len(words) + 1):
            low = max(0, shift - drift)
            part = words[low : max(shift + len(template) + drift, 0)]
            held = set(part)
            if sum(w in held for w in template) < need:
                continue
            _, matched, start, end = ls.align(template, part, shift - low, drift)
            if matched / len(template) < ls.COVERAGE:
                continue
            if scanner.short[number] and not ls.NAMES.intersection(template) <= set(part[start : end + 1]):
                continue
            found.add((-matched, -matched / len(template), number, start + low, end + low))
    kept = []
    for match in sorted(found):
        if not any(match[3] <= b and match[4] >= a for *_, a, b in kept):
            kept.append(match)
    return sorted((scanner.templates[n][0], -c, a, b) for _, c, n, a, b in kept)


def test_scan_equals_brute_force(scanner):
    pick = random.Random(12)
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(pick.randrange(1, 4)):
            words = pick.choice(TEMPLATES)[1].split()
            if len(words) > 60 and pick.random() < 0.7:
                words = pick.choice(TEMPLATES[1:3] + TEMPLATES[-12:])[1].split()
            rate = pick.choice([0, 0, 0.04])
            parts += [" ".join("changed" if pick.random() < rate else w for w in words), " ".join(PROSE[pick.randrange(20)].split()[: pick.randrange(40)])]
        texts.append("\n".join(parts))
    matched = 0
    for text in texts:
        expected = brute_force(scanner, text)
        assert sorted((m[0], m[2], m[3], m[4]) for m in scanner.scan(text)) == expected, text
        matched += len(expected)
    assert matched > 60


def test_query_equals_brute_force_on_whole_documents(spark, scanner):
    folder = "/root/testdata/sf0.001"
    expected = sorted(
        (r.doc_id, *match)
        for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
        for match in brute_force(scanner, r.text)
    )
    got = QUERIES["op10_scan_licenses"](spark, folder).collect()
    assert expected and sorted((r.doc_id, r.license, r.coverage, r.first_word, r.last_word) for r in got) == expected


def test_texts_full_of_licenses_do_not_take_long(scanner):
    mit, changed = TEMPLATES[0][1], TEMPLATES[0][1].replace("Permission", "Leave").replace("KIND", "sort")
    for wording in (mit, changed):
        text = "\n".join([wording] * 100)
        scanner.scan(wording)
        started = time.process_time()
        matches = scanner.scan(text)
        assert time.process_time() - started < 2.0  # well below a second; a cell at a time took 9
        assert [m[0] for m in matches] == ["MIT"] * 100


@pytest.mark.parametrize("number", range(len(TEMPLATES)))
def test_every_wording_is_found_in_prose(scanner, number):
    name, wording = TEMPLATES[number]
    for prose in PROSE[:3]:
        text = f"{prose}.\n{wording}\n{prose}"
        matches = scanner.scan(text)
        assert [m[0] for m in matches] == [name], matches
        _, _, coverage, first, last, start, end = matches[0]
        assert coverage == 1.0 and text[start:end] in wording
        assert wording.rstrip(".\"/") == text[start:end] or wording.startswith(text[start:end])
        assert (first, last) == (80, 80 + len(ls.WORDS.findall(wording)) - 1)


def test_changed_words_still_align(scanner):
    pick = random.Random(8)
    name, wording = TEMPLATES[0]
    words = wording.split()
    for _ in range(20):
        changed = [w for w in words if pick.random() > 0.04]
        changed = [w if pick.random() > 0.04 else "changed" for w in changed]
        text = f"{PROSE[0]} {' '.join(changed)} {PROSE[1]}"
        matches = scanner.scan(text)
        assert [m[0] for m in matches] == [name] and matches[0][2] > 0.85


def test_prose_and_parts_match_nothing(scanner):
    for prose in PROSE:
        assert scanner.scan(prose) == []
    half = " ".join(TEMPLATES[0][1].split()[:60])
    assert scanner.scan(f"{PROSE[0]} {half} {PROSE[1]}") == []


def test_several_and_repeated_licenses(scanner):
    line = "Released under the MIT License."
    text = "\n".join([line, PROSE[0], "Licensed under CC BY-NC 4.0.", PROSE[1], line] + [line] * 300)
    names = [m[0] for m in scanner.scan(text)]
    assert names == ["MIT", "CC-BY-NC-4.0", *["MIT"] * 301]


def test_odd_rows(spark, documents):
    line = "released UNDER the mit license"
    many = "\n".join([TEMPLATES[0][1].replace("free", "gratis")] * 60)
    docs = documents((1, None), (2, ""), (3, line), (3, line), (None, f"İ {line}"), (5, "w " * 50000), (6, "the"), (7, many))
    docs = docs.withColumn("license", F.lit("x"))
    rows = ls.scan_licenses(docs).collect()
    assert sorted((r.doc_id, r.license) for r in rows if r.doc_id) == [(3, "MIT")] * 2 + [(7, "MIT")] * 60
    assert [r.license for r in rows if r.doc_id is None] == ["MIT"]
    assert ls.scan_licenses(docs.where("false")).collect() == []
    assert ls.scan_licenses(docs, []).collect() == []


def test_query_finds_the_lines_that_search_finds(spark):
    folder = "/root/testdata/sf0.1"
    lines = {
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "Released under the MIT License.": "MIT",
    }
    expected = set()
    for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        expected |= {(r.doc_id, name) for line, name in lines.items() if line in r.text}
    got = QUERIES["op10_scan_licenses"](spark, folder).collect()
    assert len(expected) > 50 and {(r.doc_id, r.license) for r in got} == expected
    assert all(r.coverage >= ls.COVERAGE for r in got)


GNU_NOTICE = (
    "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1} License as published by"
    " the Free Software Foundation; either version {2} of the License, or (at your option) any later version.\nThis {0} is"
    " distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of"
    " MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} License for more details.\nYou should have received"
    " a copy of the GNU {1} License along with this {0}. If not, see <https://www.gnu.org/licenses/>."
)


@pytest.mark.parametrize(("license_", "title", "version"), [
    ("GPL-2.0", "General Public", "2"), ("GPL-3.0", "General Public", "3"), ("LGPL-2.0", "Library General Public", "2"),
    ("LGPL-2.1", "Lesser General Public", "2.1"), ("LGPL-3.0", "Lesser General Public", "3"),
    ("AGPL-3.0", "Affero General Public", "3"),
])
@pytest.mark.parametrize("what", ["program", "library", "package"])
def test_notices_of_the_gnu_licenses_are_told_apart(scanner, license_, title, version, what):
    text = f"{PROSE[0]}\n{GNU_NOTICE.format(what, title, version)}\n{PROSE[1]}"
    assert [m[0] for m in scanner.scan(text)] == [license_]


@pytest.mark.parametrize(("license_", "end"), [
    ("BSD-2-Clause", "SUCH DAMAGE"), ("BSD-3-Clause", "SUCH DAMAGE"), ("ISC", "OF THIS SOFTWARE"),
    ("Unlicense", "DEALINGS IN THE SOFTWARE"),
])
def test_short_licenses_are_found_to_their_end(scanner, license_, end):
    whole = max((w for name, w in TEMPLATES if name == license_), key=len)
    text = f"{PROSE[0]}\n{whole}\n{PROSE[1]}"
    (match,) = scanner.scan(text)
    assert match[0] == license_ and text[match[5] : match[6]].endswith(end)


@pytest.mark.parametrize(("text", "license_"), [
    ("Released under MIT License.", "MIT"), ("Released under the MIT licence.", "MIT"),
    ("Licensed under MIT License.", "MIT"), ("Licensed below CC BY-SA 4.0.", "CC-BY-SA-4.0"),
])
def test_short_wordings_with_a_word_changed_or_missing(scanner, text, license_):
    assert [m[0] for m in scanner.scan(f"{PROSE[0]}\n{text}\n{PROSE[1]}")] == [license_]


@pytest.mark.parametrize("text", ["Released under the Apache License.", "Released under the BSD License."])
def test_short_wordings_do_not_stand_for_another_license(scanner, text):
    assert "MIT" not in [m[0] for m in scanner.scan(f"{PROSE[0]}\n{text}\n{PROSE[1]}")]


def test_any_words_missing_or_changed_up_to_the_coverage(scanner):
    pick = random.Random(4)
    for number, (name, wording) in enumerate(TEMPLATES):
        words = ls.WORDS.findall(wording.lower())
        free = [i for i, w in enumerate(words) if not (scanner.short[number] and w in ls.NAMES)]
        for _ in range(5):
            gone = set(pick.sample(free, len(words) // 5))
            for text in ([w for i, w in enumerate(words) if i not in gone], ["x" if i in gone else w for i, w in enumerate(words)]):
                found = {n for n, _ in scanner.diagonals(scanner.grams.hashes(text))}
                assert number in found, (name, text)


def test_words_put_in_at_one_place(scanner):
    for number in (0, 5):
        name, wording = TEMPLATES[number]
        words = wording.split()
        half = len(words) // 2
        for count in (20, 40):
            text = " ".join(words[:half] + ["added"] * count + words[half:])
            assert [m[0] for m in scanner.scan(f"{PROSE[0]} {text} {PROSE[1]}")] == [name]
