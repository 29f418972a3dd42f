"""Operator 1. Token counts of whole texts: single-token pre-tokens are counted directly, only the rest is merged.

Offline, every string of the vocabulary is put to the test: it must be one
pre-token by itself and encode as one token. Those that pass are counted by
looking them up. Any other pre-token is encoded by the library once and its
count kept in a bounded cache.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spanwise.llm.codepoints import pattern_classes, ranges, tokenizer_classes
from spanwise.llm.common import map_texts

#: Entries of the cache of merged pre-tokens in a task; a full cache starts anew.
CACHE_ENTRIES = 400_000


def _byte_characters() -> dict[str, int]:
    """Characters that stand for bytes in vocabulary files: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass(frozen=True)
class Shortcut:
    """What tasks need: the file's content, the proven strings, special strings, characters the pattern sees otherwise."""

    source: str
    pattern: str
    whole: frozenset[str]
    special: tuple[str, ...]
    odd: str


def prove_whole_tokens(path: str, pattern: str) -> Shortcut:
    """Check each string of the vocabulary against pattern and library; sizes are those of the vocabulary.

    The file must be byte-level BPE without normaliser, split by `pattern` alone.
    """
    import regex
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        source = file.read()
    about = json.loads(source)
    split = about["pre_tokenizer"] or {}
    if about["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space"):
        raise ValueError("a byte-level vocabulary without normaliser and added space is needed")
    added = about["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError("special strings that take in their surroundings are not supported")
    tokenizer, find = Tokenizer.from_str(source), regex.compile(pattern)
    special = tuple(t["content"] for t in added)
    of_byte, candidates = _byte_characters(), []
    for token in about["model"]["vocab"]:
        try:
            text = bytes(of_byte[c] for c in token).decode()
        except (KeyError, UnicodeDecodeError):
            continue  # part of a character: never a pre-token
        if text not in special and find.findall(text) == [text]:
            candidates.append(text)
    encoded = tokenizer.encode_batch(candidates, add_special_tokens=False)
    whole = frozenset(t for t, e in zip(candidates, encoded, strict=True) if len(e.ids) == 1)
    odd = np.flatnonzero(tokenizer_classes() != pattern_classes())
    return Shortcut(source, pattern, whole, special, ranges(odd))


def counter(shortcut: Shortcut) -> Callable[[list[str | None]], np.ndarray]:
    """Function from texts to their numbers of tokens."""
    import regex
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(shortcut.source)
    findall = regex.compile(shortcut.pattern).findall
    special = re.compile("|".join(map(re.escape, shortcut.special))) if shortcut.special else None
    # One range from the first such character on is cheap to look for in most texts.
    maybe = re.compile(f"[{shortcut.odd[:10]}-\U0010ffff]") if shortcut.odd else None
    odd = re.compile(f"[{shortcut.odd}]") if shortcut.odd else None
    known = dict.fromkeys(shortcut.whole, 1)
    proven = len(known)

    def encoded(texts: list[str]) -> list[int]:
        return [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]

    def counts(texts: list[str | None]) -> np.ndarray:
        nonlocal known
        totals = np.zeros(len(texts), np.int64)
        split: list[tuple[int, list[str]]] = []
        unseen: set[str] = set()
        for i, text in enumerate(texts):
            if not text:
                continue
            if odd and maybe.search(text) and odd.search(text):
                totals[i] = encoded([text])[0]
                continue
            parts = [text]
            if special:
                parts = special.split(text)
                totals[i] = len(parts) - 1  # each special string is a token
            for part in parts:
                pieces = findall(part)
                split.append((i, pieces))
                unseen.update(p for p in pieces if p not in known)
        if len(known) + len(unseen) > proven + CACHE_ENTRIES:
            known = dict.fromkeys(shortcut.whole, 1)
            unseen = {p for _, pieces in split for p in pieces if p not in known}
        fresh = list(unseen)
        known.update(zip(fresh, encoded(fresh), strict=True))
        for i, pieces in split:
            totals[i] += sum(map(known.__getitem__, pieces))
        return totals

    return counts


def count_tokens(
    docs: DataFrame,
    path: str,
    pattern: str,
    limit: int = 512,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Columns id, `n_bytes`, `n_tokens`, `over_limit` (more than `limit` tokens), one row per input row.

    Counts equal those of the tokenizers library for the file at `path`,
    without begin, end or added tokens, special strings in texts each one token.
    Null and empty texts have 0 bytes and 0 tokens. Null and repeated ids are kept
    as they are; other columns of the input are not read. An empty table gives
    an empty result. `pattern` is the rule by which the file splits texts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(prove_whole_tokens(path, pattern))

    def start() -> Callable[[list[str | None]], list[pa.Array]]:
        counts = counter(shared.value)

        def work(texts: list[str | None]) -> list[pa.Array]:
            n = counts(texts)
            return [
                pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()),
                pa.array(n),
                pa.array(n > limit),
            ]

        return work

    return map_texts(docs, id_col, text_col, start, "n_bytes bigint, n_tokens bigint, over_limit boolean")
