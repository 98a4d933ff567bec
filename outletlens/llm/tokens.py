"""Tokenising whole texts inside tasks.

The tokenizer file is the parameter.  If its byte-level BPE merges in the order
of its ids (checked when it is read), tiktoken encodes the same vocabulary with
the same result in a fraction of the time; the tokenizers library encodes
everything else: other tokenizers, texts that hold a special token, and texts
with a run of over ``LONG_RUN`` characters without (or of) white space, on
which tiktoken's time would grow with the square of the run.
"""

from __future__ import annotations

import json
import os

import numpy as np

LONG_RUN = 2000
#: Fixed value: the word pattern of this tokenizer family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _letter_bytes() -> dict[str, int]:
    """Character -> the byte it stands for: itself if printable, else the bytes left over, from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranks(path: str) -> dict[bytes, int] | None:
    """Bytes -> id, if merging in the order of ids is what the file says."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    if model["type"] != "BPE" or spec["normalizer"] or (before.get("type"), before.get("use_regex"), before.get("add_prefix_space")) != ("ByteLevel", True, False):
        return None
    letters, special = _letter_bytes(), {x["content"] for x in spec["added_tokens"]}
    merged = [model["vocab"]["".join(x if isinstance(x, list) else x.split(" "))] for x in model["merges"]]
    if merged != sorted(merged) or len(merged) + 256 != len(model["vocab"].keys() - special):
        return None
    return {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in special}


class Encoder:
    """Text -> ids as little-endian bytes of ``dtype``.

    ``special_as_text``: special tokens spelt out in a text are ordinary characters.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.tokenizer.encode_special_tokens = special_as_text
        self.special = [] if special_as_text else [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast, ranks = None, _ranks(path)
        if ranks:
            import tiktoken

            self.fast = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def _may_run_long(text: str) -> bool:
        if len(text) < LONG_RUN:
            return False
        sizes = [*map(len, text.split()), 0]
        return max(sizes) >= LONG_RUN or len(text) - sum(sizes) - len(sizes) >= LONG_RUN

    def __call__(self, text: str) -> bytes:
        if self.fast and not self._may_run_long(text) and not any(x in text for x in self.special):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype(self.dtype).tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()


def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """The Python worker's encoder; task code is sent by value, so it is kept with the library it wraps."""
    import tokenizers

    kept = vars(tokenizers).setdefault("_kept_encoders", {})
    if (path, special_as_text) not in kept:
        kept[path, special_as_text] = Encoder(path, special_as_text)
    return kept[path, special_as_text]


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
