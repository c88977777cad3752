"""Token ids of whole texts by the lower-case word tokenizer, at the speed a corpus needs.

The tokenizer lower-cases a text, splits it into pieces that never merge with each other, and
drops white space, so a text's ids are those of its pieces in order, and these come from a bounded
cache. Texts of Latin-1 characters are split here; a piece that misses the cache is encoded by
byte-pair ranks read from the same file: a merge's rank is its id, and byte 0xFF, which UTF-8
never uses, stands for the end of a word. Of other texts each chunk between white space goes
through the tokenizers library, and whole texts do that may hold special tokens or control
characters on which the two disagree. Tests hold the ids against that library's for whole texts.
"""

from __future__ import annotations

import array
import functools
import json
import re
import sys

CACHE = 400_000
#: Python counts these as white space and the tokenizer does not.
CONTROLS = ("\x1c", "\x1d", "\x1e", "\x1f")
#: The tokenizer's pattern of pieces, for Latin-1: letters, single digits, runs of the rest.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\s\w]|_)+"


def _little_endian(ids: list[int]) -> bytes:
    out = array.array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Cache(dict):
    """Encoded pieces; a piece that is missing is encoded on the way."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        self[piece] = ids = _little_endian(self.encode(piece))
        return ids


class WordIds:
    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        special = {t.content for t in exact.get_added_tokens_decoder().values()}
        byte = _bytes_of_characters()
        ranks = {}
        for token, i in vocab.items():
            if token not in special:
                body = token.removesuffix("</w>")
                ranks[bytes(byte[c] for c in body) + b"\xff" * (body != token)] = i
        core = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.exact = lambda text: exact.encode(text, add_special_tokens=False).ids
        self.split = re.compile(PIECES).findall
        self.pieces = Cache(lambda piece: core.encode_single_piece(piece.encode() + b"\xff"))
        self.chunks = Cache(self.exact)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        for cache in (self.pieces, self.chunks):
            if len(cache) > CACHE:
                cache.clear()
        if "<|" in text or any(c in text for c in CONTROLS):
            return _little_endian(self.exact(text))
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return b"".join(map(self.chunks.__getitem__, text.split()))
        return b"".join(map(self.pieces.__getitem__, self.split(text.lower())))


def _bytes_of_characters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use: printable Latin-1 bytes stand
    for themselves, the others for the code points from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One encoder for each worker process and file."""
    return WordIds(path)
