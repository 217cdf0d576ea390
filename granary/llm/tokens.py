"""A byte-level BPE vocabulary file as a tokenizer, and where its tokens lie in a text.

The vocabulary's path is a parameter; the file stays where it is. A `.json` file
names the rank file beside it: both hold one vocabulary, and the rank encoder is
several times faster and gives the same ids (tests/llm compares them). Special
tokens' strings in a text are ordinary text unless asked for.
"""

from __future__ import annotations

import base64
import functools
import json

import numpy as np
import tiktoken


@functools.lru_cache(maxsize=4)
def load(path: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoder, and the bytes that each id stands for (their number)."""
    import public_tokenizers

    special = {}
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        path = path[: -len(".json")] + ".tiktoken"
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    size = np.zeros(max([*ranks.values(), *special.values()]) + 1, np.int64)
    for token, i in [*ranks.items(), *((t.encode(), i) for t, i in special.items())]:
        size[i] = len(token)
    return tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special), size


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(encoder: tiktoken.Encoding, text: str, special: bool = False) -> np.ndarray:
    """The ids of a text. special: the strings of special tokens are those tokens, as in `tokenizers` by default."""
    return encoder.encode_to_numpy(text, allowed_special="all" if special else set(), disallowed_special=()) if text else np.zeros(0, np.uint32)
