"""Public tokenizers, loaded once for each Python worker."""

from __future__ import annotations

import base64
import functools
import os

#: Folder of the vocabulary files; the environment variable names another one.
TOKENIZER_DIR = os.environ.get("TESSERAE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the published split pattern of this vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(maxsize=2)
def encoding(directory: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY):
    """The byte-level BPE of ``vocabulary``."""
    import tiktoken

    with open(os.path.join(directory, vocabulary), "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def count(text: str, directory: str = TOKENIZER_DIR) -> int:
    """Number of tokens of ``text``; strings of special tokens are ordinary text."""
    return len(encoding(directory).encode_ordinary(text))


@functools.lru_cache(maxsize=1 << 16)
def chars_per_token(text: str, directory: str = TOKENIZER_DIR) -> float:
    """Characters for each subword: high for words, low for random strings."""
    return len(text) / max(1, count(text, directory))
