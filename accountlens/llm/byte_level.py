"""Byte-level BPE tokenizers of the public JSON kind, as rank tables that a task can build quickly."""

from __future__ import annotations

import json
from functools import cached_property

import tiktoken


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in such a vocabulary.

    Printable bytes stand for themselves, the others for the characters from U+0100 on, in order.
    """
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in printable)
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


class ByteLevelTokenizer:
    """Ids of texts as the vocabulary file's own library gives them, without added special tokens.

    Files whose merges aren't ranked by the ids they make, or that rewrite the text first, can't be
    read as ranks and raise ValueError. Pickles as tables; the encoder is built once a worker.
    """

    def __init__(self, ranks: dict[bytes, int], special: dict[str, int], pattern: str) -> None:
        self.ranks, self.special, self.pattern = ranks, special, pattern

    @classmethod
    def read(cls, path: str, pattern: str) -> ByteLevelTokenizer:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, before = file["model"], file["pre_tokenizer"]
        if file["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"]:
            raise ValueError(f"{path} rewrites the text")
        alphabet = byte_alphabet()
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"][a + b] for a, b in merges]
        if made != sorted(made) or len(made) + 256 != len(ranks):
            raise ValueError(f"{path} isn't ranked by its ids")
        return cls(ranks, special, pattern)

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("ranks", "special", "pattern")}

    @cached_property
    def encoder(self) -> tiktoken.Encoding:
        return tiktoken.Encoding(
            "byte level", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens=self.special
        )

    @cached_property
    def token_bytes(self) -> list[bytes]:
        """The bytes of each id; none where an id is free."""
        listed = [b""] * (max([*self.ranks.values(), *self.special.values()]) + 1)
        for token, i in self.ranks.items():
            listed[i] = token
        for token, i in self.special.items():
            listed[i] = token.encode()
        return listed

    def ids(self, text: str) -> list[int]:
        """Ids of a text; a special token's string in it is that token, as the library has it."""
        return self.encoder.encode(text, allowed_special="all")

    def plain_ids(self, text: str) -> list[int]:
        """Ids of a text in which special tokens' strings are text like any other."""
        return self.encoder.encode_ordinary(text)
