"""Token ids of whole texts by a byte-level BPE file of the tokenizers library.

Where the file's merges make ids in order (a merge's rank is its id), tiktoken
gives the same ids from the same vocabulary in a fraction of the time; any
other file is left to the tokenizers library itself, and so is a text that
tiktoken gives up on (very long runs of white space).
"""

from __future__ import annotations

import json
from functools import cached_property, lru_cache

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

WORD = np.dtype("<u4")
#: Fixed value: the pattern by which byte-level files split a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed rule: printable bytes stand for themselves, the others for characters from 256 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in such a file's vocabulary."""
    others = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + k): b for k, b in enumerate(others)}


def by_rank(path: str) -> tiktoken.Encoding | None:
    """The file as ranks, if its ids follow from them."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (
        model.get("type") == "BPE"
        and not spec.get("normalizer")
        and split.get("type") == "ByteLevel"
        and split.get("use_regex", True)
        and not split.get("add_prefix_space")
        and not any(model.get(k) for k in ("dropout", "unk_token", "byte_fallback", "ignore_merges"))
    )
    vocab, merges = model.get("vocab", {}), model.get("merges", [])
    made = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in merges]
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    if not plain or made != list(range(256, 256 + len(made))) or len(vocab) - len(made) not in (256, 256 + len(added)):
        return None
    of = byte_characters()
    ranks = {bytes(of[c] for c in token): i for token, i in vocab.items() if token not in added}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)


class ByteBpe:
    """Encodes as ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str) -> None:
        self.path, self.ranked = path, by_rank(path)

    @cached_property
    def tokenizer(self) -> Tokenizer:
        """The library's own encoder; only made where it is needed."""
        return Tokenizer.from_file(self.path)

    def encode(self, text: str) -> bytes:
        """The ids as unsigned little-endian 32-bit words."""
        ids = None
        if self.ranked is not None:
            try:
                ids = self.ranked.encode(text, allowed_special="all", disallowed_special=())
            except ValueError:  # its pattern's backtracking has a limit
                ids = None
        if ids is None:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype=WORD).tobytes()


@lru_cache(maxsize=4)
def byte_bpe(name: str = "byte_bpe_50k.json") -> ByteBpe:
    """One encoder per worker process and file; ``name`` may be a path."""
    return ByteBpe(name if "/" in name else public_tokenizers.path(name))
