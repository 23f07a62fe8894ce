"""Byte-level BPE ids as the tokenizers library gives them, at rank-file speed.

A byte-level vocabulary file whose token ids follow the order of its merges is
also a table of ranks, and the rank encoder gives the same ids several times
faster. It is used where both split text alike for certain: Latin text
(code points below U+0250) without the few control and space characters on
whose class the two pattern engines may differ, and without very long runs of
white space, on which the rank encoder's pattern engine gives up (950,000
spaces pass, 1,000,000 fail). Everything else, and any file with another
structure, goes through the tokenizers library itself.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# anything but printable ASCII, tab, newline and Latin letters from U+00C0 to U+024F
OTHER = re.compile(r"[^\t\n\x20-\x7eÀ-ɏ]")
# the same for texts that fit Latin-1, as bytes
LATIN_1 = bytes([9, 10, *range(0x20, 0x7F), *range(0xC0, 0x100)])

# a white-space run above 100,000 characters; tried only where a run begins
LONG_SPACE = re.compile(r"(?<![\t\n ])[\t\n ]{100001}")


def byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Encoder of one vocabulary file; build it on the executor that uses it."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.exact.no_truncation()
        self.exact.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ranks = self._ranks(spec)

    @staticmethod
    def _ranks(spec):
        """The rank encoder, or None if the file does not have that structure."""
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = (model["type"] == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel"
                 and not pre.get("add_prefix_space") and pre.get("use_regex") and not spec.get("post_processor")
                 and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix",
                                                    "end_of_word_suffix", "byte_fallback", "ignore_merges")))
        plain = plain and not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        vocab = model["vocab"]
        if not plain or any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
            return None
        import tiktoken

        byte = byte_of_char()
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in special}
        return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def _plain(text: str) -> bool:
        try:
            return not text.encode("latin-1").translate(None, LATIN_1)
        except UnicodeEncodeError:
            return not OTHER.search(text)

    def encode(self, text: str) -> np.ndarray:
        if self.ranks is None or any(s in text for s in self.special) or not self._plain(text) or LONG_SPACE.search(text):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return self.ranks.encode_to_numpy(text, disallowed_special=())


_loaded: dict[str, ByteBpe] = {}


def byte_bpe(path: str) -> ByteBpe:
    """The file's encoder, built once in each Python worker."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]
