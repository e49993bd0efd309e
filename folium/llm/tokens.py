"""Token ids by a public byte-level BPE vocabulary, inside Arrow batches.

Ids equal those of the `tokenizers` library for its vocabulary file. The same
vocabulary as ranks is several times faster, so it encodes all texts but those
that hold one of the vocabulary's special strings, or that it fails on; these
go through `tokenizers` itself. Both files are parameters.
"""

from __future__ import annotations

import base64
import logging
import os
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@dataclass(frozen=True)
class Vocabulary:
    """Files of one vocabulary in both forms, its splitting pattern and its special strings."""

    tokenizer: str = field(default_factory=lambda: _path("byte_bpe_50k.json"))
    ranks: str = field(default_factory=lambda: _path("byte_bpe_50k.tiktoken"))
    special: tuple[str, ...] = ("<|endoftext|>",)

    def dtype(self) -> str:
        """The narrowest little-endian type that holds every id."""
        with open(self.ranks, "rb") as lines:
            return "<u2" if sum(1 for _ in lines) + len(self.special) <= 1 << 16 else "<u4"


_loaded: dict = {}


def _encoders(v: Vocabulary):
    if v not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(v.ranks, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _loaded[v] = fast, Tokenizer.from_file(v.tokenizer)
    return _loaded[v]


def encode(v: Vocabulary, text: str | None) -> np.ndarray:
    """Ids of one text as uint32; none for a null."""
    if not text:
        return np.zeros(0, np.uint32)
    fast, exact = _encoders(v)
    if not any(s in text for s in v.special):
        try:
            return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), np.uint32)
        except BaseException as e:  # the encoder panics on some very long runs
            if isinstance(e, (KeyboardInterrupt, SystemExit)):
                raise
            logging.getLogger(__name__).warning("a text of %d characters goes through the exact encoder: %s", len(text), type(e).__name__)
    return np.array(exact.encode(text, add_special_tokens=False).ids, np.uint32)


def texts(batch: pa.RecordBatch, column: str = "text"):
    """Texts of a batch one at a time, so that only one is a Python string at once."""
    values = batch.column(column)
    for i in range(len(values)):
        yield i, values[i].as_py()
