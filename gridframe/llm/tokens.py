"""Token ids of whole texts by a public tokenizer, a piece at a time.

Both kinds of vocabulary split a text before any merge, always where white space
follows something else and where anything but a letter follows letters. So a
text's ids are those of the pieces between such places, one after another, and a
piece that was seen before needs no encoding: each worker keeps the ids of recent
pieces, and encodes new ones many at a time. Texts in which this can't be relied
on (special tokens' strings, characters that libraries class differently or that
a normaliser may join) and vocabularies of other kinds are encoded whole. An empty
text has no ids; texts of any length are split; texts must not be null.
"""

from __future__ import annotations

import gc
import json
import os
import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np

#: Letters in every library's view.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: A run of letters, or of ASCII signs and the letters behind, up to a printable ASCII
#: character, white space or the end; where others are near (control characters too,
#: which join a run of signs), all up to white space.
_PIECE = rf"(?:[{LETTERS}]++|[!-@\[-`{{-~]++[{LETTERS}]*+)(?=[\t-\r -~]|\Z)|\S+"
#: With leading white space: it belongs to the tokens of a byte-level vocabulary.
BYTE_PIECES = re.compile(rf"\s*+(?:{_PIECE})|\s+")
WORD_PIECES = re.compile(_PIECE)
#: The same of a text of white space and printable ASCII.
PLAIN = re.compile(r"[\t-\r -~]*+")
PLAIN_BYTE_PIECES = re.compile(r"\s*+(?:[A-Za-z]++|[!-@\[-`{-~]++[A-Za-z]*+)|\s+")
UNSURE = re.compile(r"[\x1c-\x1f]")
#: One token's piece before merges in every byte-level vocabulary: a space and letters.
SPACED_LETTERS = re.compile(rf" [{LETTERS}]++")
#: The characters by which a byte-level vocabulary names bytes: visible ones by themselves.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_NAMES = {b: b if b in _VISIBLE else 256 + k for k, b in enumerate([*(b for b in range(256) if b not in _VISIBLE), *_VISIBLE])}
KEPT_PIECES = 900_000
LONG_PIECE = 48
AT_ONCE = 64
LINES_AT_ONCE = 64


class Pieces(dict):
    """Ids of pieces. A new piece gets a place at once, that is filled later."""

    def __init__(self) -> None:
        self.new: dict[str, bytearray] = {}

    def __missing__(self, piece: str) -> bytearray:
        place = self[piece] = self.new[piece] = bytearray()
        return place


class PieceEncoder:
    """ids(texts): for each text its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, kept: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        forget = getattr(self.tokenizer.model, "_resize_cache", None)
        if forget:  # the library's own memory of pieces: here each is encoded once
            forget(0)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.special = [t["content"] for t in made.get("added_tokens") or []]
        self.pieces = self._pieces(made)
        self.lower = self.pieces is WORD_PIECES
        self.known, self.kept = Pieces(), kept
        line_end = [] if self.lower else self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line_end = line_end[0] if len(line_end) == 1 else None

    @staticmethod
    def _pieces(made: dict) -> re.Pattern | None:
        before, splitter = made.get("normalizer"), made.get("pre_tokenizer") or {}
        if not before and splitter.get("type") == "ByteLevel" and splitter.get("use_regex") and not splitter.get("add_prefix_space"):
            return BYTE_PIECES
        steps = [x["type"] for x in (before or {}).get("normalizers", [])]
        first = (splitter.get("pretokenizers") or [{}])[0]
        if steps == ["NFC", "Replace", "Lowercase"] and first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed" and "[\\p{L}]+" in first["pattern"].get("Regex", ""):
            return WORD_PIECES
        return None

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_joined(self, pieces: list[str]) -> list[bytes]:
        """Pieces that may stand side by side, encoded as one text and told apart by
        where their tokens begin."""
        made = self.tokenizer.encode((" " if self.lower else "").join(pieces), add_special_tokens=False)
        ends = np.cumsum([len(p) + self.lower for p in pieces])
        begins = np.fromiter((a for a, _ in made.offsets), np.int64, len(made.ids))
        upto = (4 * np.searchsorted(begins, ends, side="left")).tolist()
        raw = np.array(made.ids, "<u4").tobytes()
        return [raw[a:b] for a, b in zip([0, *upto], upto)]

    def _merge(self, pieces: list[str]) -> list[bytes]:
        """Pieces of a byte-level vocabulary that aren't split before merges: the library's
        model gets their bytes by name."""
        merge = self.tokenizer.model.tokenize
        named = ["\u0120" + p[1:] if p.isascii() else p.encode().decode("latin-1").translate(BYTE_NAMES) for p in pieces]
        return [array("I", [x.id for x in merge(p)]).tobytes() for p in named]

    def _encode_lines(self, pieces: list[str]) -> list[bytes]:
        """Pieces of a byte-level vocabulary that are joinable, a line each: before the
        space of the next piece a line's end is a token of its own, and no piece has one."""
        lines = ["\n".join(pieces[k : k + AT_ONCE]) + "\n" for k in range(0, len(pieces), AT_ONCE)]
        ids = np.concatenate([np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)])
        ends = np.flatnonzero(ids == self.line_end)
        if len(ends) != len(pieces):
            return self._encode(pieces)
        raw, ends = ids.tobytes(), 4 * ends
        return [raw[a:b] for a, b in zip([0, *(ends[:-1] + 4).tolist()], ends.tolist())]

    def _joinable(self, piece: str) -> bool:
        return self.lower or (piece[0] == " " and len(piece) > 1 and not piece[1].isspace())

    def _whole(self, text: str) -> bool:
        return self.pieces is None or bool(UNSURE.search(text)) or any(s in text for s in self.special) or (self.lower and not unicodedata.is_normalized("NFC", text))

    def _split(self, text: str) -> list[str] | None:
        if self._whole(text):
            return None
        if self.pieces is BYTE_PIECES and text.isascii() and PLAIN.fullmatch(text):
            return PLAIN_BYTE_PIECES.findall(text)
        return self.pieces.findall(text.encode().lower().decode() if self.lower else text)  # bytes: ASCII letters only

    def _fill(self) -> None:
        """Encode the new pieces."""
        new, self.known.new = self.known.new, {}
        letters, joined, rest = [], [], []
        by_lines = self.line_end is not None
        for piece in new:
            if len(piece) > LONG_PIECE or not self._joinable(piece):
                rest.append(piece)
            elif by_lines and SPACED_LETTERS.fullmatch(piece):
                letters.append(piece)
            else:
                joined.append(piece)
        step, encode = (AT_ONCE * LINES_AT_ONCE, self._encode_lines) if by_lines else (AT_ONCE, self._encode_joined)
        for start in range(0, len(joined), step):
            part = joined[start : start + step]
            self._keep(new, part, encode(part))
        self._keep(new, letters, self._merge(letters))
        for piece, i in zip(rest, self._encode(rest)):
            new[piece] += i
            if len(piece) <= LONG_PIECE:
                self.known[piece] = i
            else:
                del self.known[piece]

    def _keep(self, new: dict[str, bytearray], pieces: list[str], made: list[bytes]) -> None:
        for piece, i in zip(pieces, made):
            new[piece] += i
        self.known.update(zip(pieces, made))

    def ids(self, texts: list[str]) -> list[bytes]:
        was_on = gc.isenabled()
        gc.disable()  # only strings are made here, by the million, and no cycles
        try:
            return self._all_ids(texts)
        finally:
            if was_on:
                gc.enable()

    def _all_ids(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.kept:
            self.known.clear()
        look_up = self.known.__getitem__
        found = []
        for text in texts:
            pieces = self._split(text)
            found.append(None if pieces is None else list(map(look_up, pieces)))
        self._fill()
        return [self._encode([text])[0] if parts is None else b"".join(parts) for text, parts in zip(texts, found)]


@lru_cache(maxsize=1)
def encoder(path: str, kept: int = KEPT_PIECES) -> PieceEncoder:
    """This process's encoder of the vocabulary at `path`, that remembers about so many pieces."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return PieceEncoder(path, kept)
