"""BPE encoding and decoding by dynamic programming over prefixes.

Merging never undoes a token boundary, so the last token of every prefix of a piece is unique: it is
the one token ending there that can stand next to the last token of the prefix before it. An
automaton over the vocabulary lists the tokens that end at each place, a test of the two merge
histories decides whether two tokens can be neighbours, and the back-pointers give the exact ids in
time linear in the piece, without a queue of merges.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.llm import unicode_classes
from tillscope.llm.common import text_or_empty

#: Fixed values of the tokenizer format: the steps before the model, but for the pattern of a piece,
#: and the settings of the model, the mark of a word's last symbol among them.
WORD_END = "</w>"
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = {"type": "Split", "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
MODEL = {
    "type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None,
    "end_of_word_suffix": WORD_END, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False,
}
ADDED = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}
#: Information separators: white space to Python, but not to the tokenizer format.
ODD_SPACE = re.compile("[\x1c-\x1f]")
SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")

#: Words and neighbour pairs that a worker remembers at most, half of them from an older generation.
REMEMBERED = 400_000
NEVER = 1 << 60


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself, or the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def _part(found: object, known: object, what: str) -> None:
    """ValueError unless a part of the tokenizer file says what is expected."""
    if found != known:
        raise ValueError(f"this encoder does not know the tokenizer's {what}: {found!r}")


def pieces_of(parsed: dict) -> re.Pattern:
    r"""The pattern that the file cuts pieces by; all other steps must be the ones built in here.

    ``\p{L}``, ``\p{N}`` and ``\s`` become the library's own classes, which stand in brackets; a
    pattern with any other escape, group or flag is refused.
    """
    _part((parsed["normalizer"] or {}).get("normalizers"), NORMALIZER, "normalizer")
    split, *others = (parsed["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
    pattern = (split.get("pattern") or {}).get("Regex", "")
    _part({k: v for k, v in split.items() if k != "pattern"}, SPLIT, "pre-tokenizer")
    _part(others, [BYTES], "pre-tokenizer")
    _part(parsed["decoder"], None, "decoder")
    _part({k: v for k, v in parsed["model"].items() if k not in ("vocab", "merges")}, MODEL, "model")
    for token in parsed["added_tokens"]:
        _part({k: v for k, v in token.items() if k not in ("id", "content")}, ADDED, "added token")
    letters, numbers = unicode_classes.letters_and_numbers()
    spaces = unicode_classes.in_brackets(unicode_classes.points(unicode_classes.SPACES))
    classes = {r"\p{L}": letters, r"\p{N}": numbers, r"\s": spaces}
    bare = re.sub(r"\[\^?(?:\\p\{L\}|\\p\{N\}|\\s)+\]", "[]", pattern)
    if not pattern or re.search(r"[\\(){}^$.*?]", bare.replace("[]", "")):
        raise ValueError(f"this encoder does not know the tokenizer's pattern: {pattern!r}")
    for escape, inside in classes.items():
        pattern = pattern.replace(escape, inside)
    return re.compile(pattern)


class Encoder:
    """Encodes and decodes as the tokenizer file says, without added tokens, padding or cutting.

    A file whose steps or settings are not the ones known here is refused with a ValueError.
    """

    def __init__(self, definition: str) -> None:
        import ahocorasick

        parsed = json.loads(definition)
        self.pieces = pieces_of(parsed)
        model = parsed["model"]
        vocab, merges = model["vocab"], [tuple(m) for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        named = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        self.names = [named.get(i, "") for i in range(max(named) + 1)]
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.bytes = byte_symbols()
        # Inside the encoder a word's last symbol is one character too, moved to a private area.
        self.last = {s: chr(0xE000 + b) for b, s in enumerate(self.bytes)}
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(merges)}
        made = {vocab[a + b]: (vocab[a], vocab[b], r) for r, (a, b) in enumerate(merges)}
        # For each token, what it is made of along its left and its right edge: (node, rank of the
        # merge that uses the node up), from the single symbol to the token itself.
        self.left: dict[int, list[tuple[int, int]]] = {}
        self.right: dict[int, list[tuple[int, int]]] = {}
        for edge, side in ((self.left, 0), (self.right, 1)):
            for token in vocab.values():
                walk, node, used = [], token, NEVER
                while node in made:
                    walk.append((node, used))
                    node, used = made[node][side], made[node][2]
                edge[token] = [*reversed([*walk, (node, used)])]
        self.near: dict[int, bool] = {}
        self.shown = {b: s for b, s in enumerate(self.bytes) if s != chr(b)}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.automaton = ahocorasick.Automaton()
        for text, token in vocab.items():
            # A token that its own parts would never merge into is never the result of merging.
            if token in made and not self.side_by_side(made[token][0], made[token][1], made[token][2]):
                continue
            symbols = self.symbols(text)
            self.automaton.add_word(symbols, (token, len(symbols)))
        self.automaton.make_automaton()

    def symbols(self, token: str) -> str:
        if token.endswith(WORD_END) and token != WORD_END:
            body = token[: -len(WORD_END)]
            return body[:-1] + self.last[body[-1]]
        return token

    def side_by_side(self, a: int, b: int, until: int = NEVER) -> bool:
        """Whether merging the symbols of both tokens leaves the boundary between them alone.

        Follows the two edges at the boundary through time. The pieces that touch it at some time
        merge if their merge comes before either is used up by its own side; at equal rank the
        merge further left goes first.
        """
        edge_a, edge_b, i, j = self.right[a], self.left[b], 0, 0
        while True:
            (x, x_used), (y, y_used) = edge_a[i], edge_b[j]
            x_used, y_used = min(x_used, until), min(y_used, until)
            rank = self.rank.get((x, y))
            if rank is not None and rank < x_used and rank <= y_used and rank < until:
                return False
            if x_used == y_used == until:
                return True
            if x_used <= y_used:
                i += 1
            else:
                j += 1

    def piece(self, text: str) -> list[int]:
        """Ids of one piece (letters, a digit, or signs), by its prefixes."""
        symbols = text.encode().decode("latin-1").translate(self.shown)
        symbols = symbols[:-1] + self.last[symbols[-1]]
        token, start, near = [-1] * len(symbols), [0] * len(symbols), self.near
        for end, (candidate, length) in self.automaton.iter(symbols):
            if token[end] >= 0:
                continue
            first = end - length + 1
            if first:
                # Ids are below 2^32.
                pair = token[first - 1] << 32 | candidate
                fits = near.get(pair)
                if fits is None:
                    if len(near) >= REMEMBERED // 2:
                        near.clear()
                    fits = near[pair] = self.side_by_side(token[first - 1], candidate)
                if not fits:
                    continue
            token[end], start[end] = candidate, first
        ids, at = [], len(symbols) - 1
        while at >= 0:
            ids.append(token[at])
            at = start[at] - 1
        return ids[::-1]

    def word(self, word: str) -> bytes:
        """Ids of what stands between white space, as little-endian 32-bit integers.

        A piece alone is cut as it is in a word, so words and pieces share one memory: a rare word
        with a sign behind it finds its letters there.
        """
        pieces = self.pieces.findall(word)
        if len(pieces) == 1:
            return self.remembered(word)
        known, remembered = self.known, self.remembered
        return b"".join([known.get(p) or remembered(p) for p in pieces])

    def remembered(self, piece: str) -> bytes:
        """Ids of a piece; it is known if it comes again before two generations have passed."""
        packed = self.known.get(piece) or self.older.get(piece)
        if packed is None:
            ids = self.piece(piece)
            packed = struct.pack(f"<{len(ids)}I", *ids)
        self.remember(piece, packed)
        return packed

    def remember(self, text: str, packed: bytes) -> None:
        if len(self.known) >= REMEMBERED // 2:
            self.known, self.older = {}, self.known
        if len(text) <= 64:
            self.known[text] = packed

    def plain(self, text: str) -> bytes:
        low = unicode_classes.lowered(unicode_classes.composed(text))
        split = [w for w in SPACE.split(low) if w] if ODD_SPACE.search(low) else low.split()
        known, word = self.known, self.word
        return b"".join([known.get(w) or word(w) for w in split])

    def encode(self, text: str) -> bytes:
        """Ids of a text, as little-endian unsigned 32-bit integers."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.plain(text)
        return b"".join(
            np.array([self.special[part]], dtype="<u4").tobytes() if part in self.special else self.plain(part)
            for part in self.cut.split(text)
        )

    def decode(self, ids: bytes) -> str:
        """The text of packed ids; the format has no decoder, so tokens are set apart by a space."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def public_file(name: str = "word_bpe_49k.json") -> str:
    """Path of a public tokenizer's file; the driver reads it and sends it to the tasks."""
    import public_tokenizers

    return public_tokenizers.path(name)


_encoders: dict[str, Encoder] = {}


def encoder(definition: str) -> Encoder:
    """The worker's encoder of a definition, built once."""
    if definition not in _encoders:
        _encoders.clear()
        _encoders[definition] = Encoder(definition)
    return _encoders[definition]


def _definition(docs: DataFrame, path: str):
    """The tokenizer file, sent to the tasks: its size is the vocabulary's, whatever the corpus."""
    with open(path, encoding="utf-8") as file:
        return docs.sparkSession.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the ids of each whole text as ``array<int>``; NULL and empty texts have none.

    One pass without a shuffle. A column named as the result is replaced.
    """
    shared = _definition(docs, path)

    @F.pandas_udf("array<int>")
    def ids_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(shared.value)
        for batch in batches:
            yield pd.Series([np.frombuffer(own.encode(t), dtype="<i4") for t in batch])

    return docs.withColumn(ids, ids_of(text_or_empty(text)))


def decode(encoded: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text of each row's ids; NULL and empty lists give the empty text."""
    shared = _definition(encoded, path)

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(shared.value)
        for batch in batches:
            yield pd.Series([own.decode(np.asarray(i, dtype="<u4").tobytes()) for i in batch])

    return encoded.withColumn(text, text_of(F.coalesce(F.col(ids), F.array().cast("array<int>"))))


#: Rows that leave a task together, ids included.
CHUNK = 256


def digests(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of encoding, then decoding.

    Each whole text is encoded and its ids decoded in one visit, so neither travels. With
    ``keep_ids`` the ids follow as ``array<int>``. Each row gives one row, in any order; NULL and
    empty texts have no tokens and decode to the empty text; other columns are dropped.
    """
    shared = _definition(docs, path)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids

    def both(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(shared.value)
        for batch in batches:
            for at in range(0, len(batch), CHUNK):
                part, rows = batch.iloc[at : at + CHUNK], []
                for doc_id, text in zip(part["doc_id"].array, part["text"]):
                    ids = own.encode(text)
                    decoded = own.decode(ids).encode()
                    row = (doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest())
                    rows.append((*row, np.frombuffer(ids, dtype="<i4")) if keep_ids else row)
                found = pd.DataFrame(rows, columns=names)
                found["doc_id"] = pd.array([None if pd.isna(r[0]) else int(r[0]) for r in rows], dtype="Int64")
                yield found

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select("doc_id", text_or_empty().alias("text")).mapInPandas(both, schema)
