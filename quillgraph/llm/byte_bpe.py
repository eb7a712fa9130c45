"""Ids of the byte-level BPE vocabulary, exactly as the tokenizers library gives them.

tiktoken runs the same merges several times faster. Texts where the two could differ
(a special token's string, characters outside blocks that Unicode settled long ago,
very long unbroken runs) are encoded by the tokenizers library itself.
"""

from __future__ import annotations

import base64
import os
import re

import numpy as np

NAME = "byte_bpe_50k"
SPECIAL = "<|endoftext|>"
#: Anything outside blocks whose letters, numbers and spaces have long been settled.
_UNSETTLED = re.compile("[^\x00-ɏͰ-ϿЀ-ӿא-תء-ي -⁯₠-₵　-〩ぁ-ゖァ-ヺ一-龥가-힣！-～]")
_LONG_RUN = re.compile(r"\S{2000}|\s{2000}")
_held: dict = {}


def library(name: str = f"{NAME}.json"):
    """The tokenizers library's tokenizer for a vocabulary file, once per process."""
    if name not in _held:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(public_tokenizers.path(name))
        t.no_truncation()
        t.no_padding()
        _held[name] = t
    return _held[name]


def _quick():
    if "quick" not in _held:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{NAME}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _held["quick"] = tiktoken.Encoding("byte", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _held["quick"]


def encode(text: str) -> np.ndarray:
    """Ids (uint32) of a whole text, without added special tokens."""
    if not text:
        return np.empty(0, np.uint32)
    if SPECIAL in text or _LONG_RUN.search(text) or (not text.isascii() and _UNSETTLED.search(text)):
        return np.array(library().encode(text, add_special_tokens=False).ids, np.uint32)
    return np.asarray(_quick().encode_to_numpy(text, disallowed_special=()), np.uint32)
