"""Byte-level BPE ids of whole texts, inside Python tasks.

Ids equal those of ``tokenizers.Tokenizer.from_file(json).encode(text,
add_special_tokens=False)``. A token never spans the place before a space whose
neighbour on either side is no white space, so a text is cut there and each piece is
encoded once per worker; texts where the rule does not hold are encoded whole.
"""

from __future__ import annotations

import base64
import os
import re

import numpy as np
import public_tokenizers

# A space that follows white space and is not followed by a visible character.
_MERGING = re.compile(r"\s \s|\s \Z")
_SPECIAL = "<|endoftext|>"
_CACHE_PIECES = 200_000
_LONGEST_CACHED = 40
_ENCODERS: dict[tuple[str, str], "Encoder"] = {}


class Encoder:
    """``ids(text)`` gives little-endian unsigned 32-bit ids as bytes."""

    def __init__(self, json_name: str, ranks_name: str):
        import tiktoken
        with open(public_tokenizers.path(ranks_name), "rb") as lines:
            ranks = {base64.b64decode(piece): int(rank)
                     for piece, rank in map(bytes.split, lines)}
        self._fast = tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN,
                                       mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._json = json_name
        self._full = None
        self._pieces: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        if _SPECIAL not in text:
            return np.array(self._fast(text), "<u4").tobytes()
        if self._full is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer
            self._full = Tokenizer.from_file(public_tokenizers.path(self._json))
        return np.array(self._full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _MERGING.search(text) or _SPECIAL in text:
            return self._whole(text)
        head, *rest = text.split(" ")
        found = list(map(self._pieces.get, rest))
        if None in found:
            if len(self._pieces) > _CACHE_PIECES:
                self._pieces.clear()
            for at, ids in enumerate(found):
                if ids is None:
                    piece = rest[at]
                    ids = self._pieces.get(piece)
                    if ids is None:
                        ids = self._whole(" " + piece)
                        if len(piece) <= _LONGEST_CACHED:
                            self._pieces[piece] = ids
                    found[at] = ids
        return self._whole(head) + b"".join(found)


def encoder(json_name: str = "byte_bpe_50k.json",
            ranks_name: str = "byte_bpe_50k.tiktoken") -> Encoder:
    """One encoder per worker process; the names are files of ``public_tokenizers``."""
    key = (json_name, ranks_name)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]
