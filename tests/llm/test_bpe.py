from __future__ import annotations

import hashlib
import json
import random
import struct
import unicodedata

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tillscope.llm import bpe, unicode_classes

PATH = public_tokenizers.path("word_bpe_49k.json")

TEXTS = [
    None, "", " \n ", "Hello <|endoftext|>World’s it's  été 12 ab\u0301\n\n!?..x", "a<|startoftext|>b", "<|ENDOFTEXT|>",
    "İ ΣΑΣ ẞ ǅ", "x\u00a0y\u2003z\x1c\x85w", "\u200b½²", "don'T 're '", "😀 héllo 中文字", "a\u0000b",
    "aaaaaaaaaaaaaaaaaaaaaaaa", "the thth ththththere inin", "e\u0301 \u0301x", "<|endoftext|><|endoftext|>", "한국어 각",
    "w" * 5000, "word " * 30000,
]


@pytest.fixture(scope="module")
def own():
    with open(PATH, encoding="utf-8") as file:
        return bpe.Encoder(file.read())


@pytest.fixture(scope="module")
def theirs():
    return Tokenizer.from_file(PATH)


def ids(packed):
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


def test_odd_texts(own, theirs):
    for text in TEXTS:
        expected = theirs.encode(text or "", add_special_tokens=False).ids
        packed = own.encode(text or "")
        assert ids(packed) == expected, text
        assert own.decode(packed) == theirs.decode(expected, skip_special_tokens=False)


def test_random_texts(own, theirs):
    pick = random.Random(4)
    tokens = [t.replace("</w>", "") for t in own.names[:49000]]
    letters = "abcdefgthinerous'ÉéèñßΣσς0123456789 \t\n.,;:!?-_()\u0301\u00a0😀中"
    for n in range(3000):
        if n % 2:
            text = "".join(pick.choice(letters) for _ in range(pick.randrange(60)))
        else:
            text = "".join(pick.choice(tokens) + pick.choice(["", "", " "]) for _ in range(pick.randrange(8)))
        assert ids(own.encode(text)) == theirs.encode(text, add_special_tokens=False).ids, repr(text)


def test_every_code_point_alone_and_between_letters(own, theirs):
    """All 1.1 million, assigned or not, in whatever Unicode version a module of Python has."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 64):
        text = " ".join(f"a{c}b {c} {c}1" for c in points[at : at + 64])
        if ids(own.encode(text)) != theirs.encode(text, add_special_tokens=False).ids:
            for c in points[at : at + 64]:
                text = f"a{c}b {c} {c}1"
                assert ids(own.encode(text)) == theirs.encode(text, add_special_tokens=False).ids, hex(ord(c))
            raise AssertionError(hex(ord(points[at])))


def test_mixtures_of_marks_letters_and_new_characters(own, theirs):
    pick = random.Random(8)
    marks = [c for c in map(chr, range(0x110000)) if unicodedata.combining(c)]
    new = [chr(c) for c in sorted(
        unicode_classes.points(unicode_classes.LETTERS_16 + unicode_classes.LATER + unicode_classes.NUMBERS_16)
    )]
    plain = [chr(c) for c in sorted(unicode_classes.points(unicode_classes.PLAIN_MARKS))]
    composed = [c for c in map(chr, range(0xC0, 0x2000)) if unicodedata.decomposition(c)[:1] not in ("", "<")]
    for _ in range(20_000):
        text = "".join(
            pick.choice(pick.choice((marks, marks, plain, new, composed, "aeouAEOU ", "\u0301\u0323\u0345", ".1'")))
            for _ in range(pick.randrange(2, 9))
        )
        assert ids(own.encode(text)) == theirs.encode(text, add_special_tokens=False).ids, ascii(text)


def test_any_characters_at_all(own, theirs):
    pick = random.Random(9)
    for _ in range(20_000):
        text = "".join(chr(pick.choice((pick.randrange(0xD800), pick.randrange(0xE000, 0x110000)))) for _ in range(12))
        assert ids(own.encode(text)) == theirs.encode(text, add_special_tokens=False).ids, ascii(text)


@pytest.mark.parametrize("part, value", [
    ("normalizer", None), ("normalizer", {"type": "Sequence", "normalizers": [{"type": "NFC"}]}), ("pre_tokenizer", None),
    ("pre_tokenizer.pretokenizers.0.pattern.Regex", "\\w+"), ("pre_tokenizer.pretokenizers.0.pattern.Regex", "(?i)[\\p{L}]+"),
    ("pre_tokenizer.pretokenizers.0.invert", False), ("decoder", {"type": "ByteLevel"}), ("model.dropout", 0.1),
    ("model.end_of_word_suffix", None), ("added_tokens.0.lstrip", True), ("pre_tokenizer.pretokenizers.1", {"type": "Digits"}),
])
def test_a_file_with_other_steps_is_refused(part, value):
    with open(PATH, encoding="utf-8") as file:
        parsed = json.load(file)
    *way, name = part.split(".")
    at = parsed
    for step in way:
        at = at[int(step) if step.isdigit() else step]
    at[int(name) if name.isdigit() else name] = value
    with pytest.raises(ValueError):
        bpe.Encoder(json.dumps(parsed))


def test_the_pattern_is_the_file_s(theirs):
    with open(PATH, encoding="utf-8") as file:
        parsed = json.load(file)
    parsed["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = "[\\p{L}]+|[\\p{N}]+|[^\\s\\p{L}\\p{N}]"
    definition = json.dumps(parsed)
    own, other = bpe.Encoder(definition), Tokenizer.from_str(definition)
    for text in TEXTS:
        assert ids(own.encode(text or "")) == other.encode(text or "", add_special_tokens=False).ids
    assert ids(own.encode("it's 1234!?")) != theirs.encode("it's 1234!?", add_special_tokens=False).ids


def test_every_token_alone(own, theirs):
    for token in own.names[::7]:
        text = token.replace("</w>", "")
        assert ids(own.encode(text)) == theirs.encode(text, add_special_tokens=False).ids, token


def test_on_documents(spark, documents, theirs):
    docs = documents(*enumerate(TEXTS), (3, TEXTS[3])).withColumn("ids", F.lit("extra"))
    rows = bpe.digests(docs, PATH).collect()
    assert len(rows) == len(TEXTS) + 1
    for row in rows:
        expected = theirs.encode(TEXTS[row.doc_id] or "", add_special_tokens=False).ids
        decoded = theirs.decode(expected, skip_special_tokens=False)
        packed = struct.pack(f"<{len(expected)}I", *expected)
        assert row.n_tokens == len(expected)
        assert row.ids_sha256 == hashlib.sha256(packed).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_ids_travel_between_encoding_and_decoding(spark, documents, theirs):
    docs = documents((1, "One two"), (2, None), (None, "x"))
    encoded = bpe.encode(docs, PATH)
    assert encoded.columns == [*docs.columns, "ids"]
    rows = {r.doc_id: r for r in bpe.decode(encoded, PATH).collect()}
    assert rows[1].ids == theirs.encode("One two", add_special_tokens=False).ids
    assert rows[1].decoded == "one</w> two</w>" and (rows[2].ids, rows[2].decoded) == ([], "")
    assert bpe.digests(docs.where("false"), PATH).collect() == []
