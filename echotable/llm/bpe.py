"""Byte-level BPE ids.

Texts go to ``tiktoken`` whole; its ranks are the same vocabulary, and the ids equal those of the JSON file.
A text that holds an added token of the JSON file is encoded by ``tokenizers`` itself.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer


class Encoder:
    def __init__(self, path: str):
        self.model = Tokenizer.from_file(path)
        with open(path.removesuffix("json") + "tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.words = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.added = [t.content for t in self.model.get_added_tokens_decoder().values()]

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text (null: none)."""
        if text and any(a in text for a in self.added):
            return np.array(self.model.encode(text, add_special_tokens=False).ids, np.int32)
        return self.words.encode_to_numpy(text or "", disallowed_special=()).astype(np.int32)

    def batch(self, texts: list[str | None]) -> list[np.ndarray]:
        return list(map(self.encode, texts))


@lru_cache(maxsize=2)
def encoder(name: str) -> Encoder:
    """One encoder for each worker process; ``name`` is a JSON file of ``public_tokenizers`` with its ranks beside it."""
    return Encoder(public_tokenizers.path(name))
