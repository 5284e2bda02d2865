"""Token ids of documents: byte-level BPE, id 0 after each document, overlong documents cut.

The ids are those of the tokenizers library for the vocabulary file (special strings are special); the same vocabulary's ranks file
gives equal ids several times faster and serves where it lies beside it and a text has no special string.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np

END = 0


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def encoder(path: str):
    """A function from text to ids."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    ranks_path = os.path.splitext(path)[0] + ".tiktoken"
    slow = Tokenizer.from_file(path)
    special = [t.content for t in slow.get_added_tokens_decoder().values()]

    def by_library(text: str) -> list[int]:
        return slow.encode(text, add_special_tokens=False).ids

    try:
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding(ranks_path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    except (ImportError, OSError):
        return by_library

    def by_ranks(text: str) -> list[int]:
        if any(x in text for x in special):
            return by_library(text)
        return fast.encode_ordinary(text)

    return by_ranks


def document_ids(text: str | None, path: str) -> np.ndarray:
    ids = encoder(path)(text or "")
    out = np.empty(len(ids) + 1, np.uint32)
    out[:-1] = ids
    out[-1] = END
    return out


def cuts(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: one, or the remainder first and full pieces after it."""
    if n <= size:
        return [(0, n)]
    first = n % size
    out = [(0, first)] if first else []
    return out + [(i, size) for i in range(first, n, size)]
