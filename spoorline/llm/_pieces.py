"""Pre-tokens of a byte-level BPE tokenizer file, and its pieces as bytes."""

from __future__ import annotations

import os
from functools import lru_cache

import regex

os.environ["TOKENIZERS_PARALLELISM"] = "false"

#: Fixed value: the byte-level splitting pattern of the tokenizer family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose classes all Unicode versions and engines agree on; other texts are split by the library itself.
_SETTLED = regex.compile("[\\x00-\\x1B\\x20-\\x84\\x86-\\u024F\\u2010-\\u2027\\u2030-\\u205E\\u20AC]*+")


class Splitter:
    """Splits a text into pre-tokens as the library does for a byte-level BPE file given as JSON text."""

    def __init__(self, spec: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._added = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self._special = added
        self._find = regex.compile(PATTERN).findall

    def plain(self, text: str) -> list[str]:
        if _SETTLED.fullmatch(text):
            return self._find(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def __call__(self, text: str) -> list[str]:
        if not any(s in text for s in self._special):
            return self.plain(text)
        out: list[str] = []
        for i, part in enumerate(self._added.split(text)):
            if i % 2:
                out.append(part)
            elif part:
                out += self.plain(part)
        return out

    def encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]


@lru_cache(maxsize=2)
def splitter(spec: str) -> Splitter:
    """One per worker process and tokenizer."""
    return Splitter(spec)


def piece_bytes(spec: str) -> list[bytes]:
    """Bytes of each id. Printable Latin-1 characters stand for themselves, the other bytes for 256, 257, ..."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(own))}
    vocab = splitter(spec).tokenizer.get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocab.values()) + 1)
    for piece, i in vocab.items():
        out[i] = b"".join(bytes([byte_of[c]]) if c in byte_of else c.encode() for c in piece)
    return out
