"""Token ids of texts by a byte-level BPE tokenizer.

The vocabulary file is one of the tokenizers library. Where its merges are in the order
of their ids, the same ranks serve tiktoken, which gives the same ids several times
faster; otherwise, and for texts that name a special token, the library itself is used.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cache
from pathlib import Path

import numpy as np
import tiktoken

# Fixed value: how a byte-level BPE with its own rule cuts a text into pre-tokens.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """The sign that stands for each byte in a byte-level vocabulary: printable Latin-1
    stands for itself, the other bytes for the code points from 256 on, in order."""
    shown = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def ranks_of(path: str) -> dict[bytes, int] | None:
    """Byte strings and ids of a plain byte-level BPE whose merges are in the order of ids."""
    content = json.loads(Path(path).read_text(encoding="utf-8"))
    cut, model = content.get("pre_tokenizer") or {}, content["model"]
    plain = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
    if not plain or content.get("normalizer") or model.get("type") != "BPE" or model.get("ignore_merges"):
        return None
    special = {t["content"] for t in content.get("added_tokens", ())}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"][a + b] for a, b in pairs]
    if made != sorted(made) or len(made) + 256 != len(model["vocab"].keys() - special):
        return None
    signs = byte_alphabet()
    return {bytes(signs[c] for c in token): i for token, i in model["vocab"].items() if token not in special}


# A space between two other signs begins a pre-token, so a long text can be cut before it.
CUT = re.compile(r"(?<=\S) (?=\S)")
CHARS_AT_ONCE = 1 << 20


def pieces(text: str) -> Iterator[str]:
    """A long text in parts that are encoded alike by themselves."""
    at = 0
    while len(text) - at > CHARS_AT_ONCE and (cut := CUT.search(text, at + CHARS_AT_ONCE)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        ranks = ranks_of(path)
        self.fast = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if ranks else None
        self.code = "H" if self.width.itemsize == 2 else "I"

    def ids(self, text: str | None) -> np.ndarray:
        """Ids of a text; none for a null or empty one."""
        if not text:
            return np.empty(0, self.width)
        if self.fast and not any(s in text for s in self.special):
            out = array(self.code)
            for part in pieces(text):
                out.extend(self.fast.encode_ordinary(part))
            return np.frombuffer(out, self.width)
        (found,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(found.ids, self.width)

    def ids_of(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        return map(self.ids, texts)

    def count(self, text: str) -> int:
        """Tokens of a text in which the names of special tokens are ordinary."""
        if self.fast:
            return len(self.fast.encode_ordinary(text))
        self.tokenizer.encode_special_tokens = True
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)


@cache
def encoder_of(path: str) -> Encoder:
    """One encoder for all tasks that a worker runs."""
    return Encoder(path)
