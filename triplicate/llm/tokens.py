"""Byte-level tokenization with a public vocabulary, by cached chunks, for the operators that need token ids."""

from __future__ import annotations

import json
import os
import re

import numpy as np

from triplicate.llm.common import TwoGenerations

#: White space other than the space and the line feed, which may join over a space into one piece.
_ODD_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Longer chunks are encoded anew each time rather than kept.
_LONGEST_KEPT = 64
_KEPT = 250_000


def vocabulary(name: str) -> str:
    """``name`` as a path, or the file of that name among the public vocabularies."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def load(name: str):
    """The tokenizer in that file, without truncation and padding and with one thread."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary(name))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the others from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in printable else next(others)) for b in range(256)]


class ByteEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers, as the tokenizers library gives them.

    The vocabulary's pattern never joins a space with what stands before it, so a text cut before each space is
    encoded chunk by chunk and each distinct chunk once. Chunks go through the same vocabulary as merge ranks,
    which is several times as fast as the library; texts where white space meets white space across a cut, or
    with a special token's string in them, go to the library whole.
    """

    def __init__(self, name: str) -> None:
        import tiktoken
        import public_tokenizers

        self.tokenizer = load(name)
        with open(vocabulary(name), encoding="utf-8") as f:
            model = json.load(f)
        self.special = [t["content"] for t in model["added_tokens"]]
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        vocab = model["model"]["vocab"]
        merged = [vocab["".join(pair)] for pair in model["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError(f"{name}: merges do not come in the order of their ids")
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in self.special}
        self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.spaced = TwoGenerations(_KEPT)

    def _ids(self, text: str) -> bytes:
        return np.array(self.ranks.encode_ordinary(text), "<u4").tobytes()

    def whole(self, text: str) -> bool:
        """Whether white space or a special token's string makes the text's chunks depend on one another."""
        odd = "  " in text or " \n" in text or "\n " in text or text[-1:] == " " or _ODD_SPACE.search(text)
        return bool(odd) or any(s in text for s in self.special)

    def encode(self, text: str) -> bytes:
        if self.whole(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *parts = text.split(" ")
        get = self.spaced.get
        found = [get(p) for p in parts]
        if None in found:
            old = self.spaced.old
            for i, p in enumerate(parts):
                if found[i] is None and (ids := get(p)) is None:
                    ids = old.get(p) or self._ids(" " + p)
                    if len(p) <= _LONGEST_KEPT:
                        self.spaced[p] = ids
                    found[i] = ids
                elif found[i] is None:
                    found[i] = ids
            self.spaced.make_room()
        return b"".join([self._ids(first), *found])
