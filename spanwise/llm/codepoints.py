"""Classes of code points, as the tokenizer libraries themselves have them."""

from __future__ import annotations

import functools

import numpy as np

LETTER, NUMBER, SPACE, OTHER = range(4)
_ALL = 0x110000


def _characters() -> str:
    return "".join(map(chr, (*range(0xD800), *range(0xE000, _ALL))))


def _table(found: dict[int, str]) -> np.ndarray:
    table = np.full(_ALL, OTHER, np.uint8)
    for kind, text in found.items():
        table[np.frombuffer(text.encode("utf-32-le"), np.uint32)] = kind
    return table


@functools.cache
def rank_classes() -> np.ndarray:
    """Classes in the library for rank files: what each property's pattern matches among all code points."""
    import tiktoken

    single = {bytes([b]): b for b in range(256)}

    def matched(pattern: str) -> str:
        encoder = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        return bytes(encoder.encode_ordinary(_characters())).decode()

    return _table({LETTER: matched(r"\p{L}+"), NUMBER: matched(r"\p{N}+"), SPACE: matched(r"\s+")})


@functools.cache
def tokenizer_classes() -> np.ndarray:
    """Classes in the library for .json files."""
    from tokenizers import Regex, pre_tokenizers

    def matched(pattern: str) -> str:
        split = pre_tokenizers.Split(Regex(pattern), "removed")
        return "".join(piece for piece, _ in split.pre_tokenize_str(_characters()))

    return _table({LETTER: matched(r"[^\p{L}]+"), NUMBER: matched(r"[^\p{N}]+"), SPACE: matched(r"\S+")})


def pattern_classes() -> np.ndarray:
    """Classes in the `regex` module."""
    import regex

    text = _characters()
    kinds = {LETTER: r"\p{L}+", NUMBER: r"\p{N}+", SPACE: r"\s+"}
    return _table({kind: "".join(regex.findall(pattern, text)) for kind, pattern in kinds.items()})


def ranges(points: np.ndarray) -> str:
    """Code points in ascending order as the inside of a character class."""
    if not len(points):
        return ""
    cuts = np.flatnonzero(np.diff(points) > 1)
    starts, ends = points[np.r_[0, cuts + 1]], points[np.r_[cuts, len(points) - 1]]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True))
