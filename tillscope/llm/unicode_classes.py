"""Letters, numbers, lower case and composition as the tokenizers library has them, pinned.

Python's tables follow the Unicode version it was built with (15.1 or later is expected here), and
so do those of other modules. The library's own are older and newer at once: letters and numbers are
those of version 16, lower case is of version 17, and combining marks are known up to version 8. The
lists below hold the code points that differ, so the same text is cut in the same way whatever
Python's version is. Only ranges are stated; everything else comes from ``unicodedata``.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from functools import cache

#: Code points that became letters and numbers with Unicode 16.
LETTERS_16 = """
1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B 1138E
11390-113B5 113B7 113D1 113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF 1E5D0-1E5ED 1E5F0
"""
NUMBERS_16 = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"
#: Code points that became letters or numbers later.
LATER = """
558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959
10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8
16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128
1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED
1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""
#: Capitals of Unicode 16 and 17, and where their small letters begin.
CAPITALS = {
    "1C89": 0x1C8A, "A7CB": 0x264, "A7CC": 0xA7CD, "A7CE": 0xA7CF, "A7D2": 0xA7D3, "A7D4": 0xA7D5,
    "A7DA": 0xA7DB, "A7DC": 0x19B, "10D50-10D65": 0x10D70, "16EA0-16EB8": 0x16EBB,
}
#: Marks that the library's composition takes for letters that never combine.
PLAIN_MARKS = """
7FD 898-89F 8CA-8D3 9FE C3C D3B-D3C EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF
10F46-10F50 10F82-10F85 11070 1133B 1145E 11839-1183A 11930 1193D-1193E 11943 119E0 11A34 11A47 11A99 11D42
11D44-11D45 11D97 11F41-11F42 16FF0-16FF1 1E08F 1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF
"""
#: White space, as the library's expressions have it.
SPACES = "9-D 20 85 A0 1680 2000-200A 2028-2029 202F 205F 3000"
#: CRC-32 of the code points of the letters and of the numbers, four bytes each.
LETTERS_CRC, NUMBERS_CRC = 0xde227172, 0x6e156058


def points(ranges: str) -> set[int]:
    """The code points of hexadecimal ranges."""
    ends = [[int(x, 16) for x in part.split("-")] for part in ranges.split()]
    return {c for part in ends for c in range(part[0], part[-1] + 1)}


def in_brackets(found: set[int]) -> str:
    """Code points as the inside of a character class."""
    parts, ordered = [], sorted(found)
    first = last = None
    for c in [*ordered, None]:
        if last is not None and c != last + 1:
            parts.append(f"\\U{first:08X}" if first == last else f"\\U{first:08X}-\\U{last:08X}")
            last = None
        if last is None:
            first = c
        last = c
    return "".join(parts)


@cache
def letters_and_numbers() -> tuple[str, str]:
    """The insides of the two character classes; ValueError if Python's tables give anything else."""
    found = {"L": set(), "N": set()}
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in found:
            found[kind].add(c)
    later = points(LATER)
    letters = found["L"] - later | points(LETTERS_16)
    numbers = found["N"] - later | points(NUMBERS_16)
    for own, crc in ((letters, LETTERS_CRC), (numbers, NUMBERS_CRC)):
        if zlib.crc32(b"".join(c.to_bytes(4, "little") for c in sorted(own))) != crc:
            raise ValueError(f"Python's Unicode {unicodedata.unidata_version} has letters that are not listed here")
    return in_brackets(letters), in_brackets(numbers)


_SMALL = {
    c: small + i for ranges, small in CAPITALS.items() for i, c in enumerate(sorted(points(ranges)))
}
_NEW_CAPITAL = re.compile(f"[{in_brackets(set(_SMALL))}]")
_PLAIN_MARK = re.compile(f"([{in_brackets(points(PLAIN_MARKS))}])")


def composed(text: str) -> str:
    """The text in normal form C."""
    if unicodedata.is_normalized("NFC", text):
        return text
    if _PLAIN_MARK.search(text):
        return "".join(unicodedata.normalize("NFC", part) for part in _PLAIN_MARK.split(text))
    return unicodedata.normalize("NFC", text)


def lowered(text: str) -> str:
    """The text in lower case, character by character: no special final sigma."""
    low = text.replace("Σ", "σ").lower()
    if not low.isascii() and _NEW_CAPITAL.search(low):
        low = low.translate(_SMALL)
    return low
