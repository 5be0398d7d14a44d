"""Token ids of whole texts inside Spark tasks.

The vocabulary is a tokenizers JSON file whose path is a parameter; every worker process loads it once. Where the
tokenizer splits at white space and merges inside words only (Split/Removed pre-tokenizer, BPE with an end-of-word
mark), ids are looked up white-space chunk by chunk in a bounded per-worker dictionary; plain words that aren't in it
are merged by a byte-level engine with the same merge table, any other chunk by the tokenizer itself. Other tokenizers
encode whole texts. Either way the ids are those of Tokenizer.encode(text, add_special_tokens=False).
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable
from functools import lru_cache

import public_tokenizers
from tokenizers import Tokenizer

DEFAULT_TOKENIZER = "word_bpe_49k.json"
#: Entries after which a worker's dictionary starts anew (about 50 MB).
CACHE_ENTRIES = 250_000
#: Longer chunks are rarely seen twice and aren't kept.
CACHED_CHUNK = 24
#: str.split() also splits at these; the tokenizer doesn't, so such texts go through it whole.
CONTROLS = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Trailing marks that the pre-tokenizer never joins with letters or digits (the apostrophe can: 's, 't).
TRAILING = ".,!&*$#%;:?)|"


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    return public_tokenizers.path(name)


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 stands for itself, the rest follow from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(rest)}


def _word_engine(model: dict, special: set[int]) -> Callable[[bytes], list[int]]:
    """A byte-pair engine with the file's merge table; byte FF, which UTF-8 never has, stands for the end of a word."""
    import tiktoken

    stands, suffix, ranks = _byte_alphabet(), model["end_of_word_suffix"], {}
    for token, rank in model["vocab"].items():
        if rank not in special:
            end = token.endswith(suffix)
            ranks[bytes(stands[c] for c in (token[: -len(suffix)] if end else token)) + b"\xff" * end] = rank
    return tiktoken.Encoding("words", pat_str=".+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


class _Chunks(dict):
    """White-space chunk to its packed ids."""

    def __init__(self, whole: Tokenizer, word: Callable[[bytes], list[int]]):
        self.whole, self.word = whole, word

    def __missing__(self, chunk: str) -> bytes:
        if chunk.isalpha() and max(chunk) <= "\xff":  # Latin-1 letters: composed already, lower case is one to one
            out = _packed(self.word(chunk.lower().encode() + b"\xff"))
        elif (body := chunk.rstrip(TRAILING)) != chunk and body.isalpha() and max(body) <= "\xff":
            out = self[body] + self[chunk[len(body) :]]
        else:
            out = _packed(self.whole.encode(chunk, add_special_tokens=False).ids)
        if len(chunk) < CACHED_CHUNK:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[chunk] = out
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], bytes]:
    """text -> its ids as little-endian unsigned 32-bit numbers."""
    whole = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
    by_word = spec["model"]["type"] == "BPE" and spec["model"].get("end_of_word_suffix") and split.get("behavior") == "Removed" and split.get("invert")
    if not by_word:
        return lambda text: _packed(whole.encode(text, add_special_tokens=False).ids)
    special = {t["id"] for t in spec["added_tokens"]}
    chunks = _Chunks(whole, _word_engine(spec["model"], special))
    names = tuple(t["content"] for t in spec["added_tokens"])

    def encode(text: str) -> bytes:
        if any(c in text for c in CONTROLS) or ("<|" in text and any(n in text for n in names)):
            return _packed(whole.encode(text, add_special_tokens=False).ids)
        return b"".join(map(chunks.__getitem__, text.split()))

    return encode
