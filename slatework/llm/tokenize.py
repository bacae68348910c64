"""Byte-level BPE ids of whole texts, from a tokenizer file of the ``tokenizers`` library."""

from __future__ import annotations

import functools
import json
import re

import numpy as np

#: The vocabulary's split pattern with possessive repeats, as its authors publish it.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

#: Beyond these characters the two libraries' Unicode tables might differ; long runs without a
#: space are slow in one of them. Such texts take the tokenizer file's own library.
UNUSUAL = re.compile("[^\x00-ɏ‐-‧€]|[^ \n]{3000}")


def _byte_of() -> dict[str, int]:
    """The printable character that stands for each byte in such vocabularies, reversed."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """``ids(text)``: the ids that the file gives a text without added special tokens."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of, special = _byte_of(), {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.slow = Tokenizer.from_file(path)
        self.fast = tiktoken.Encoding("from-file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        if UNUSUAL.search(text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return self.fast.encode_to_numpy(text, allowed_special="all")


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder for each file in a worker process."""
    return Encoder(path)
