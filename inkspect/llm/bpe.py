"""Byte-level BPE with forced-boundary splitting.

Two neighbouring bytes that no vocabulary token holds next to each other can
never be merged into one token, so a cut between them is certain.  A pretoken is
cut at all such pairs, its fragments are encoded independently by rank merging,
and their ids are concatenated.  Decoding joins the tokens' bytes.

Fast path: a text is taken apart at line feeds and single spaces.  A cut before a
space (or around a line feed) with no blank on either side is also a cut of the
pretoken pattern, whatever surrounds it, so pieces are encoded once and kept in a
bounded memo.  Texts with other blanks next to those take the pattern over the
whole text.
"""

from __future__ import annotations

import json
from array import array

import numpy as np
import regex
import tiktoken

from .common import kept_in_worker

#: The pretoken pattern and the byte alphabet of byte-level BPE files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEMO_BYTES = 64 << 20  # of a generation, as far as entries can be weighed


def byte_alphabet() -> dict[str, int]:
    """Character in the file -> byte: printable Latin-1 stands for itself, the rest for U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Memo(dict):
    """Bounded in two generations: what is asked for again outlives a turn."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old, self.held = make, {}, 0

    def __missing__(self, piece):
        ids = self.old.get(piece)
        if ids is None:
            ids = self.make(piece)
            if len(piece) > 48:
                return ids
        if self.held >= MEMO_BYTES:
            self.old, self.held = dict(self), 0
            self.clear()
        self.held += 200 + 2 * len(piece) + len(ids)
        self[piece] = ids
        return ids


class _Blank(Exception):
    """The piece begins or ends with a blank: its cut is not certain."""


class Codec:
    """Ids are handled as packed little-endian unsigned integers of ``width`` bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.dtype, self.code = (np.dtype("<u2"), "H") if size <= 1 << 16 else (np.dtype("<u4"), "I")
        self.tokens: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.tokens[i] = token
        for token, i in self.special.items():
            self.tokens[i] = token.encode()
        # ranks of merging are the order of ids among merged tokens
        self._core = tiktoken.Encoding("fragments", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens={})
        self.pairs = {pair for token in vocab for pair in zip(token, token[1:])}  # those that stand inside some token
        self.pattern = regex.compile(PATTERN)
        self._special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self._after, self._first = _Memo(lambda p: self._piece(" " + p, p)), _Memo(lambda p: self._piece(p, p))
        self._pretokens = _Memo(self._pretoken)
        self._newline = self._pretoken("\n")

    def fragments(self, data: bytes) -> list[bytes]:
        """``data`` cut at every certain boundary."""
        if self.pairs.issuperset(zip(data, data[1:])):
            return [data] if data else []
        cuts = [i for i, pair in enumerate(zip(data, data[1:]), 1) if pair not in self.pairs]
        ends = [*cuts, len(data)]
        return [data[i:j] for i, j in zip([0, *ends], ends)]

    def _pretoken(self, text: str) -> bytes:
        encode = self._core._core_bpe.encode_single_piece
        fragments = self.fragments(text.encode())
        ids = encode(fragments[0]) if len(fragments) == 1 else [i for x in fragments for i in encode(x)]
        return array(self.code, ids).tobytes()

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self._pretokens.__getitem__, self.pattern.findall(text)))

    def _whole(self, text: str) -> bytes:
        if not any(x in text for x in self.special):
            return self._plain(text)
        out, at = [], 0
        for m in self._special.finditer(text):
            out += [self._plain(text[at : m.start()]), array(self.code, [self.special[m[0]]]).tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def _piece(self, text: str, bare: str) -> bytes:
        if not bare or bare[0].isspace() or bare[-1].isspace() or bare[0] in "\x1c\x1d\x1e\x1f" or bare[-1] in "\x1c\x1d\x1e\x1f":
            raise _Blank
        if bare.isalpha():
            return self._pretoken(text)
        if bare[-1] in ".,;:!?" and bare[:-1].isalpha():
            return self._pretokens[text[:-1]] + self._pretokens[bare[-1]]
        return self._whole(text)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        out = []
        try:
            for line in text.split("\n"):
                pieces = line.split(" ")
                out.append(self._first[pieces[0]])
                out += map(self._after.__getitem__, pieces[1:])
                out.append(self._newline)
        except _Blank:
            return self._whole(text)
        out.pop()
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, self.dtype).tolist()]).decode("utf-8", "replace")


@kept_in_worker
def codec(path: str) -> Codec:
    """One codec a worker process and vocabulary file."""
    return Codec(path)
