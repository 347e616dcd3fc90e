"""Byte-level BPE token ids for whole columns."""

from __future__ import annotations

import base64
from itertools import pairwise

import numpy as np
import pyarrow as pa

from . import common

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public byte-level BPE split pattern.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_OF_DOCUMENT = 50256


class Encoder:
    """Lazy, picklable by path; one per task."""

    def __init__(self, vocabulary: str = VOCABULARY) -> None:
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        # Without any special token tiktoken looks for one at every character; this one is never allowed in a text.
        self.core = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": max(ranks.values()) + 1})
        self.width = np.uint16 if max(ranks.values()) < END_OF_DOCUMENT < 1 << 16 else np.uint32

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, offsets of the texts); null counts as the empty text, bytes that aren't UTF-8 as U+FFFD.

        Each text is encoded whole.  Looking distinct pieces up in a table is faster only where few words make up the
        texts, and more than twice as slow where most are new.
        """
        raw, off = common.string_buffers(column)
        if not len(raw):
            return np.zeros(0, self.width), np.zeros(len(off), np.int64)
        view, encode = memoryview(raw), self.core.encode_to_numpy
        got = [encode(str(view[a:b], "utf-8", "replace"), disallowed_special=()) for a, b in pairwise(off.tolist())]
        return np.concatenate(got).astype(self.width, copy=False), np.r_[0, np.cumsum([len(ids) for ids in got])]
