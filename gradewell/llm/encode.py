"""Token ids by the ``tokenizers`` library, chunk by chunk.

A text is cut before its runs of spaces. The pre-tokenizers in use (byte-level
words that may lead with a space; words without spaces) never let a word cross
such a cut, so the ids of the chunks follow one another as those of the whole
text do. A chunk seen lately is not encoded again.

A text of plain characters is split by the tokenizer's own pattern, and its words
go straight to the library's model, which spares the bookkeeping of a full
encoding. Of any other text (control or composed characters, strings of special
tokens) the chunks that are not plain take the library's full path.
"""

from __future__ import annotations

import json
import os
import re
from array import array

from gradewell.llm.common import Remembered, once, space_chunks

# The byte-level pattern of a pre-tokenizer that has none in its file,
# and what its classes match among the plain characters.
BYTE_LEVEL_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
NUMBERS = "0-9²³¹¼-¾"
PLAIN = r"[\n -~¡-¬®-ÿ]*"


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable
    bytes stand for themselves, the others for the letters from 256 on."""
    plain = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 256 and b != 173]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """Ids of whole texts, as bytes of unsigned 32-bit integers (little-endian machines)."""

    def __init__(self, path: str, limit: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.full = Tokenizer.from_file(path)
        self.model = self.full.model
        specials = [t["content"] for t in config["added_tokens"]]
        self.special = os.path.commonprefix(specials) if specials else "\0"
        steps = config["pre_tokenizer"].get("pretokenizers", [config["pre_tokenizer"]])
        pattern = next((s["pattern"]["Regex"] for s in steps if s["type"] == "Split"), BYTE_LEVEL_WORDS)
        pattern = re.sub(r"(?<!\[)\\p\{(L|N)\}(?=\+)", r"[\\p{\1}]", pattern)     # a class without brackets
        pattern = pattern.replace(r"\p{L}", LETTERS).replace(r"\p{N}", NUMBERS)
        self.lower = config["normalizer"] is not None
        self.words = re.compile(pattern).findall
        # below 256 and printable: lower-casing, composing and white space are plain there
        self.plain = re.compile(PLAIN).fullmatch
        self.letters = str.maketrans(_byte_letters())
        self.known = Remembered(self._encode_word, limit)
        # no word holds or follows from white space, so a text's words are those of its pieces between
        self.apart = all(self.words(f"a{x}{y}") == ["a", y] for x in (" ", "\n", "  ", "\n ", " \n") for y in ("b", "7", "."))
        self.pieces = Remembered(self._encode_piece, limit)

    def _encode_word(self, word: str) -> bytes:
        spelled = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def _encode_piece(self, piece: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.words(piece)))

    def _plain(self, text: str) -> bytes | None:
        if self.special in text or not self.plain(text):
            return None
        text = text.lower() if self.lower else text
        if self.apart:
            return b"".join(map(self.pieces.__getitem__, text.split()))
        return b"".join(map(self.known.__getitem__, self.words(text)))

    def _any(self, chunk: str) -> bytes:
        ids = self._plain(chunk)
        return ids if ids is not None else array(
            "I", self.full.encode(chunk, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str) -> bytes:
        ids = self._plain(text)
        return ids if ids is not None else b"".join(map(self._any, space_chunks(text)))


def encoder(path: str) -> Encoder:
    return once(("encoder", path), lambda: Encoder(path))
