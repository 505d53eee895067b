"""Ids from the tokenizers library: every whole text goes to it, in batches bounded by rows and by characters.

The library spends most of its time on cutting a text into words. Where no token of the vocabulary can reach over a cut,
no merge does either, and the same file without its split gives the same ids. `crossings` derives from the vocabulary
which neighbouring characters a token can join across a cut; a text with such a pair, or with a character past U+00FF,
goes to the library as the file has it.

A file that lower-cases words before a split into words without white space composes characters, rewrites white space
and keeps an alignment at each step. Up to U+00FF nothing composes, white space isn't in any word, and lower case is
the same in Python: such a text goes to the library in lower case, without these steps; one of printable ASCII and
white space also without the step to bytes, which changes none of its words. A text that holds a special token in any
case goes as it is.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa

from millrace.llm.bpe import LETTERS, NUMBERS, WHITE

if TYPE_CHECKING:
    from tokenizers import Tokenizer

ROWS, CHARACTERS = 64, 1 << 17  # a batch ends with the text that reaches either

# The settings of a byte-level file, and contractions that the split keeps whole.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
MERGES_ONLY = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "ignore_merges": False}
LOWERED = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORDS = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
PRINTABLE = re.compile(r"[\t-\r -~]*")
BEYOND = re.compile("[^\x00-\xff]")
CONTRACTION = re.compile(f"(?<=[{LETTERS}{NUMBERS}])'(?:s|t|re|ve|m|ll|d)(?![{LETTERS}])")
KINDS = [re.compile(f"[{x}]") for x in (WHITE, LETTERS, NUMBERS)]


def crossings(vocab: list[str], spelled: list[str]) -> np.ndarray:
    """For each pair of the first 256 characters, as 256 * first + second: the split may cut there, and some token may hold both sides. spelled: a character's bytes in the letters of the vocabulary."""
    met = {(t[max(0, i - 2) : i], t[i : i + 2]) for t in vocab for i in range(1, len(t))}
    # One or two bytes are a character, its end or its start, or hold a character of one byte.
    left = {x: [c for c in range(256) if spelled[c].endswith(x) or x.endswith(spelled[c])] for x in {x for x, _ in met}}
    right = {x: [c for c in range(256) if spelled[c].startswith(x) or x.startswith(spelled[c])] for x in {x for _, x in met}}
    joined = np.zeros((256, 256), bool)
    for x, y in met:
        for c in left[x]:
            joined[c, right[y]] = True
    kind = np.array([next((k for k, x in enumerate(KINDS) if x.match(chr(c))), len(KINDS)) for c in range(256)])
    within = (kind[:, None] == kind) & (kind > 0)  # a run of letters, numbers or signs
    within[ord(" ")] |= kind > 0  # and the space before it
    joined &= ~within
    joined[ord("'"), [ord(c) for c in "strvmld"]] = True  # a contraction may end within a run of letters
    return joined.reshape(-1)


def _unsplit(form: dict) -> Callable[[str], str | None] | None:
    """For a byte-level file: a function that gives back a text whose ids are the same without the split, else None."""
    model, split = form["model"], form["pre_tokenizer"] or {}
    if form["normalizer"] or any(split.get(k) != v for k, v in BYTE_LEVEL.items()) or any(model.get(k) != v for k, v in MERGES_ONLY.items()):
        return None
    from tokenizers.pre_tokenizers import ByteLevel

    level = ByteLevel(add_prefix_space=False, use_regex=False)
    spelled = [level.pre_tokenize_str(chr(c))[0][0] for c in range(256)]
    if not model["vocab"].keys() >= set(ByteLevel.alphabet()):
        return None
    joined = crossings(list(model["vocab"]), spelled)

    def fits(text: str) -> str | None:
        try:
            codes = np.frombuffer(text.encode("latin-1"), np.uint8)
        except UnicodeEncodeError:
            return None
        if len(codes) < 2:
            return text
        at = np.flatnonzero(joined[codes[:-1] * np.uint16(256) + codes[1:]])
        return text if all(CONTRACTION.match(text, k) for k in at.tolist()) else None

    return fits


def _lowered(form: dict) -> Callable[[str], str | None] | None:
    """For a file that lower-cases words: a function that gives a text in lower case whose ids need no normalizer, else None."""
    split = (form["pre_tokenizer"] or {}).get("pretokenizers", [])
    if form["normalizer"] != LOWERED or len(split) != 2 or split[0] != WORDS or any(split[1].get(k) != v for k, v in (BYTE_LEVEL | {"use_regex": False}).items()):
        return None
    special = [t["content"].lower() for t in form["added_tokens"]]

    def fits(text: str) -> str | None:
        if not text.isascii() and BEYOND.search(text):
            return None
        low = text.lower()
        return None if any(t in low for t in special) else low

    return fits


def _from_file(path: str) -> Tokenizer:
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return library


class Encoder:
    """encode(texts) gives each text's ids, as `encode(text, add_special_tokens=False)` has them, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        self.library = _from_file(path)
        #: Shorter ways to the same ids: what gives the text for a way, or None, and the library for it.
        self.ways: list[tuple[Callable[[str], str | None], Tokenizer]] = []
        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        if fits := _unsplit(form):
            from tokenizers.pre_tokenizers import ByteLevel

            self.ways.append((fits, _from_file(path)))
            self.ways[-1][1].pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
        if lowered := _lowered(form):
            from tokenizers import Regex, Tokenizer
            from tokenizers.pre_tokenizers import Split

            latin, ascii_only = Tokenizer(self.library.model), Tokenizer(self.library.model)  # one model in memory; special tokens don't come here
            latin.pre_tokenizer = self.library.pre_tokenizer
            ascii_only.pre_tokenizer = Split(Regex(WORDS["pattern"]["Regex"]), "removed", invert=True)
            self.ways += [(lambda t: lowered(t) if t.isascii() and PRINTABLE.fullmatch(t) else None, ascii_only), (lowered, latin)]

    def way(self, text: str) -> tuple[Tokenizer, str]:
        """The library, and the whole text as it goes there."""
        for fits, library in self.ways:
            if (given := fits(text)) is not None:
                return library, given
        return self.library, text

    def encode(self, texts: list[str]) -> list[bytes]:
        found = [b""] * len(texts)
        ways: dict[int, tuple[Tokenizer, list[int], list[str]]] = {}
        for k, text in enumerate(texts):
            library, given = self.way(text)
            _, at, held = ways.setdefault(id(library), (library, [], []))
            at.append(k)
            held.append(given)
        for library, at, held in ways.values():
            for k, e in zip(at, library.encode_batch_fast(held, add_special_tokens=False), strict=True):
                found[k] = np.array(e.ids, "<u4").tobytes()
        return found

    def encoded(self, ids: pa.Array, texts: pa.Array) -> Iterator[list[tuple[int | None, bytes]]]:
        """Batches of (id, packed ids) of an Arrow batch; a null text is empty."""
        held: list[tuple[int | None, str]] = []
        size = 0
        for i, t in zip(ids, texts, strict=True):
            held.append((i.as_py(), t.as_py() or ""))
            size += len(held[-1][1])
            if len(held) >= ROWS or size >= CHARACTERS:
                yield self._batch(held)
                held, size = [], 0
        if held:
            yield self._batch(held)

    def _batch(self, held: list[tuple[int | None, str]]) -> list[tuple[int | None, bytes]]:
        return list(zip((i for i, _ in held), self.encode([t for _, t in held]), strict=True))


_LOADED: dict[str, Encoder] = {}


def load(path: str) -> Encoder:
    """The encoder for a tokenizer file, once a Python worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]
