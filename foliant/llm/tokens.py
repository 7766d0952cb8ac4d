"""Token ids of whole texts by a public byte-level tokenizer, fast enough for a corpus.

The tokenizer never joins text across the place between a character that is not white space and a space that is
followed by one, so a text is cut there and each piece is looked up among those seen before. The pieces of a batch that are new
and made of characters whose class is beyond dispute are encoded in one call by the same vocabulary's rank file, and their ids
told apart by the length of the tokens; all others go through the tokenizer itself.
"""

from __future__ import annotations

import base64
import re
from dataclasses import dataclass, field

import numpy as np


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@dataclass(frozen=True)
class TokenizerFiles:
    """Paths of the tokenizer and of its vocabulary as ranks; by default the public ones that are installed."""

    tokenizer: str = field(default_factory=lambda: _path("byte_bpe_50k.json"))
    ranks: str = field(default_factory=lambda: _path("byte_bpe_50k.tiktoken"))


#: ASCII, and letters whose class no Unicode version disputes.
_PLAIN = re.compile(r"[\x09\x0A\x0D\x20-\x7EÀ-ÖØ-öø-ɏ]+")
_CUT = re.compile(r"(?<=\S)(?= \S)")
_SPECIAL = "<|endoftext|>"
#: Where a text has none of these, every space stands between characters that are not white space, apart from its ends.
_WIDE = ("  ", " \n", "\n ", " \t", "\t ", " \r", "\r ")
#: The pre-tokenizer of the rank file: a fixed value of the vocabulary.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CACHE = 300_000


class TokenCounter:
    _shared: dict[TokenizerFiles, TokenCounter] = {}

    @classmethod
    def shared(cls, files: TokenizerFiles) -> TokenCounter:
        """One per worker process."""
        if files not in cls._shared:
            cls._shared[files] = cls(files)
        return cls._shared[files]

    def __init__(self, files: TokenizerFiles) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(files.tokenizer)
        with open(files.ranks, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, i in ranks.items():
            self.bytes_of[i] = len(token)
        self.spaced: dict[str, bytes] = {}  # ids of a piece without the space it begins with
        self.seen: dict[str, bytes] = {}  # ids of any other piece

    def _learn(self, spaced: set[str], other: set[str]) -> None:
        if spaced:
            pieces = list(spaced)
            ids = np.array(self.ranks.encode_ordinary(" " + " ".join(pieces)), dtype="<u4")
            ends = np.cumsum(self.bytes_of[ids])
            cuts = np.searchsorted(ends, np.cumsum([len(p.encode()) + 1 for p in pieces])) + 1
            raw, start = ids.tobytes(), 0
            for p, cut in zip(pieces, (cuts * 4).tolist()):
                self.spaced[p] = raw[start:cut]
                start = cut
        odd = list(other)
        for p, e in zip(odd, self.full.encode_batch(odd, add_special_tokens=False)):
            self.seen[p] = np.array(e.ids, dtype="<u4").tobytes()

    def batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; a null one has none."""
        if len(self.spaced) + len(self.seen) > _CACHE:
            self.spaced.clear()
            self.seen.clear()
        lists = [_split(t) if t else ([], []) for t in texts]
        self._learn(set().union(*[x[1] for x in lists]).difference(self.spaced), set().union(*[x[0] for x in lists]).difference(self.seen))
        seen, spaced = self.seen, self.spaced
        return [np.frombuffer(b"".join([seen[p] for p in a] + [spaced[p] for p in b]), dtype="<u4") for a, b in lists]


def _split(text: str) -> tuple[list[str], list[str]]:
    """Cut before each single space between characters that are not white space: leading pieces, and further ones without their space."""
    simple = _PLAIN.fullmatch(text) and text[0] != " " and text[-1] != " " and not any(w in text for w in _WIDE) and _SPECIAL not in text
    if not simple:
        return _CUT.split(text), []
    parts = text.split(" ")
    return parts[:1], parts[1:]
