"""Token ids of whole texts, for the word BPE through a bounded cache of pre-tokens.

The word BPE lower-cases, drops white space and merges inside pre-tokens only, so the ids of a text are those of its pre-tokens
one after the other. Pre-tokens come back again and again; a dictionary in each worker holds their ids, and only new ones reach
the tokenizers library's merge model. A text with characters beyond plain Latin letters, digits and marks (other scripts,
combining marks, special tokens) goes word by word, and its odd words through the whole tokenizer.

That holds for tokenizers with just these settings. The file's settings are compared first; with any others every text goes through the
tokenizers library as a whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import cache

import numpy as np

#: The pre-token pattern of the word BPE for the plain characters below, already lower-cased.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\x09-\x0d\x20a-z0-9ß-öø-ÿ]+")
_NOT_PLAIN = re.compile(r"[^\x09-\x0d\x20-\x7eÀ-ÖØ-öø-ÿ]|<\|")
#: The settings of a tokenizer file that this stands for.
_SETTINGS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None, "truncation": None, "padding": None,
}
_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
END = 2


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def words_stand_alone(path: str) -> bool:
    """Whether the tokenizer file has the settings of the word BPE, so that words can be encoded one by one."""
    with open(path, encoding="utf-8") as file:
        held = json.load(file)
    special = all(t["content"].startswith("<|") for t in held.get("added_tokens") or ())
    return special and all(held.get(k) == v for k, v in _SETTINGS.items()) and all(held["model"].get(k) == v for k, v in _MODEL.items())


@cache
def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 is itself, the rest follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Pieces(dict):
    """pre-token -> packed ids. Twice `limit` entries at most: a full half is kept as `old` until the next one is full."""

    def __init__(self, model, limit: int, code: str):
        self.model, self.limit, self.code, self.old = model, limit, code, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            spelled = piece if piece.isascii() else "".join(map(_byte_letters().__getitem__, piece.encode()))
            found = array(self.code, [t.id for t in self.model.tokenize(spelled)]).tobytes()
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        if len(piece) <= 64:
            self[piece] = found
        return found


class WordEncoder:
    """Bytes of a text -> its ids as integers (of 16 bits where the vocabulary allows it) of this machine's order (little-endian on all that Spark supports)."""

    def __init__(self, path: str, limit: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words_alone = words_stand_alone(path)
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.kind = np.dtype("<u2" if self.code == "H" else "<u4")
        self.pieces = _Pieces(self.tokenizer.model, limit, self.code)

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, _PIECES.findall(text.lower())))

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: bytes | None) -> bytes:
        whole = (text or b"").decode("utf-8", "replace")
        if not self.words_alone:
            return self._whole(whole)
        if not _NOT_PLAIN.search(whole):
            return self._plain(whole)
        out = []
        for word in (text or b"").split():
            word = word.decode("utf-8", "replace")
            out.append(self._whole(word) if _NOT_PLAIN.search(word) else self._plain(word))
        return b"".join(out)

    def ids(self, text: bytes | None) -> np.ndarray:
        return np.frombuffer(self.encode(text), self.kind)

    def count(self, text: bytes | None) -> int:
        return len(self.encode(text)) // self.kind.itemsize


_encoders: dict[tuple, WordEncoder] = {}


def encoder(path: str, limit: int = 400_000) -> WordEncoder:
    """The encoder of this worker process."""
    if (path, limit) not in _encoders:
        _encoders[path, limit] = WordEncoder(path, limit)
    return _encoders[path, limit]
