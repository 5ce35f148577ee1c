"""Token ids of whole texts by a public tokenizer, through the tokenizers library."""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np

#: So many words' ids are remembered, and as many of those before them, of which what is met again stays.
REMEMBERED = 500_000
#: The character that stands for each byte: itself if it shows, else the next from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}
_PUNCTUATION = ".,;:!?#$%&*|\"()[]"


def located(name: str) -> str:
    """A path as it is; a bare name among the public tokenizers' files."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder(dict):
    """Encodes texts; as a dict it holds the ids (little-endian bytes) of white-space-free words.

    If the tokenizer drops white space and never joins what it parts, a text's ids are those of
    its words in order. Then each distinct word is encoded once and remembered; the library
    still makes every id. Any other tokenizer, and any text for which this could differ (special
    tokens, characters that change under normalisation), goes to the library whole.
    """

    def __init__(self, name: str, remembered: int = REMEMBERED):
        super().__init__()
        self.remembered = remembered
        self.before: dict[str, bytes] = {}
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        path = located(name)
        self.library = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.library.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        with open(path) as f:
            made = json.load(f)
        steps = (made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_word = (
            steps[0].get("type") == "Split"
            and steps[0].get("behavior") == "Removed"
            and steps[0].get("invert") is True
            and "[^\\s" in steps[0].get("pattern", {}).get("Regex", "")
            and [n.get("type") for n in (made.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
            and not made.get("post_processor")
        )
        last = steps[-1]
        self.by_word = self.by_word and len(steps) == 2 and last.get("type") == "ByteLevel" and not last.get("add_prefix_space")
        self.model = self.library.model
        self.special = [t["content"] for t in made.get("added_tokens", [])]

    def letters(self, word: str) -> bytes:
        """The ids of a word of letters alone: one pre-token, whose bytes go to the library's model as the
        characters that stand for them."""
        mapped = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTES)
        return np.array([t.id for t in self.model.tokenize(mapped)], dtype=self.dtype).tobytes()

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.remembered:
            self.before = dict(self)
            self.clear()
        if (ids := self.before.get(word)) is not None:
            self[word] = ids
            return ids
        core = word.rstrip(_PUNCTUATION)
        if len(core) < len(word) and core.isalpha():
            ids = self[core] + self[word[len(core) :]]  # letters and what follows are never one token
        elif word.isalpha():
            ids = self.letters(word)
        else:
            ids = self.whole(word)
        self[word] = ids
        return ids

    def __call__(self, text: str | None) -> np.ndarray:
        """Ids of a text; of null none."""
        if not text:
            return np.empty(0, dtype=self.dtype)
        low = text.lower()
        plain = self.by_word and not any(s in text for s in self.special)
        if plain and not text.isascii():
            plain = "Σ" not in text and "İ" not in text and unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low)
        if not plain:
            return np.frombuffer(self.whole(text), dtype=self.dtype)
        return np.frombuffer(b"".join(map(self.__getitem__, low.replace("\n", " ").replace("\t", " ").split(" "))), dtype=self.dtype)


_kept: dict[tuple[str, int], Encoder] = {}


def encoder(name: str, remembered: int = REMEMBERED) -> Encoder:
    """The process's encoder for a tokenizer; a Python worker keeps it from task to task."""
    if (name, remembered) not in _kept:
        _kept[name, remembered] = Encoder(name, remembered)
    return _kept[name, remembered]
