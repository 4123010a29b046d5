"""Encoding whole texts with a tokenizer file, fast enough for a corpus.

``Encoder`` gives exactly the ids of the tokenizers library. Where the file is
the known word-level byte BPE, texts are cut at white space (no token crosses
it) and each distinct piece is encoded once by the library and remembered, for
as long as the Python worker lives; the memory is bounded by ``MEMO`` entries.
Texts with U+001C to U+001F and other files go through the library as they are.
"""

from __future__ import annotations

import json
import re

import numpy as np

from wickflow.llm.common import single_threaded

#: Most distinct pieces remembered by a Python worker; beyond that it starts anew.
MEMO = 1_000_000
#: White space for ``str.split`` but not for the tokenizer, which makes tokens of it.
NO_SPACE = re.compile(r"[\x1c-\x1f]")
_encoders: dict[str, "Encoder"] = {}


def _byte_alphabet() -> dict[int, str]:
    """Byte-level BPE's printable stand-in of each byte, as a translation table."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


#: The steps before the merges that the way by words stands for; a file with any other goes to the library whole.
NORMALISED = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
         {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]


class Encoder:
    def __init__(self, path: str) -> None:
        single_threaded()
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.lib = Tokenizer.from_file(path)
        self.size = self.lib.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        norm = (spec.get("normalizer") or {}).get("normalizers")
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers")
        self.by_word = norm == NORMALISED and pre == SPLIT and spec.get("post_processor") is None
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.memo: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.alphabet = _byte_alphabet()
        #: Pieces of these characters need no Unicode normalisation, and their words are found as below.
        self.simple = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
        self.words = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")

    def _library(self, text: str) -> bytes:
        return np.asarray(self.lib.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _word(self, word: str) -> bytes:
        got = self.parts.get(word)
        if got is None:
            mapped = word if word.isascii() else word.encode().decode("latin-1").translate(self.alphabet)
            got = self.parts[word] = np.asarray([t.id for t in self.lib.model.tokenize(mapped)], self.dtype).tobytes()
        return got

    def _piece(self, piece: str) -> bytes:
        if self.simple.fullmatch(piece) and not any(s in piece for s in self.special):
            return b"".join(map(self._word, self.words.findall(piece.lower())))
        return self._library(piece)

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text, as unsigned 16 or 32 bit integers."""
        if not self.by_word or NO_SPACE.search(text):
            return np.frombuffer(self._library(text), self.dtype)
        pieces = text.split()
        memo = self.memo
        for p in set(pieces).difference(memo):
            memo[p] = self._piece(p)
        out = b"".join(map(memo.__getitem__, pieces))
        if len(memo) > MEMO:
            memo.clear()
            self.parts.clear()
        return np.frombuffer(out, self.dtype)


def encoder(path: str) -> Encoder:
    """The encoder of this worker for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def crc32_u4(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    import zlib

    return zlib.crc32(ids.astype("<u4").tobytes())
