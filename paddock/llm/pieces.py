"""Token ids of many words at once, for tokenizers that drop white space and never join pieces across it.

A word here is a run without ASCII white space. Words are cut further into runs of letters and the rest, which such a
tokenizer keeps apart too, so that "word", "Word" and "word," need one look-up of "word". Where a cut might not be the
tokenizer's own (apostrophes, special strings, scripts beyond Latin, characters that aren't composed) a word stays whole.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np
from tokenizers import Tokenizer

#: Words that are encoded as one text, and texts that the tokenizer gets at once.
JOINED = 256
TEXTS = 64
#: Chunks of words, and parts of chunks, whose ids are kept, together.
KEPT = 600_000

# A task has one core; the tokenizer's own threads would each keep memory of theirs.
os.environ["TOKENIZERS_PARALLELISM"] = "false"

_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"  # all letters before the next block, U+0250
_PARTS = re.compile(f"[{_LETTER}]+|[^{_LETTER}]+")
#: Apostrophes, special strings, the letter that lower case makes two characters of, and all from the next block on, where
#: there are scripts and characters that aren't composed.
_WHOLE = re.compile("['İɐ-\U0010ffff]|<\\|")
#: A run of ASCII letters or of other ASCII characters, where none of _WHOLE follows or what might compose; else all up to white space.
_CHUNKS = re.compile(rb"[A-Za-z]+(?![^\s!-&(-;=-@\[-`{-~])|[!-&(-;=-@\[-`{-~]+(?![^\sA-Za-z])|\S+")
#: İ, and all from U+0250 on, where there are marks that compose otherwise after another case.
_CASED = re.compile(rb"[\xc4\xc9-\xff](?:(?<=[\xca-\xff])|(?<=\xc4)\xb0|(?<=\xc9)[\x90-\xbf])")


def word_ids(encoder: Tokenizer, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one behind another, and how many each word has.

    Words are joined by spaces, and each id goes to the word in which its piece begins.
    """
    all_ids, counts = [], []
    for k in range(0, len(words), JOINED * TEXTS):
        groups = [words[j : j + JOINED] for j in range(k, min(k + JOINED * TEXTS, len(words)), JOINED)]
        encoded = encoder.encode_batch([" ".join(g) for g in groups], add_special_tokens=False)
        for group, found in zip(groups, encoded, strict=True):
            ends = np.cumsum(np.fromiter(map(len, group), np.int64, len(group)) + 1)
            begins = np.fromiter((a for a, _ in found.offsets), np.int64, len(found))
            counts.append(np.bincount(np.searchsorted(ends, begins, "right"), minlength=len(group)))
            all_ids.append(np.array(found.ids, np.uint32))
    if not counts:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    return np.concatenate(all_ids), np.concatenate(counts)


def parts(word: bytes) -> list[str]:
    """The pieces of a word that can be looked up on their own; bytes that aren't UTF-8 become the replacement character."""
    if word.isalpha():  # ASCII letters only
        return [word.lower().decode()]
    text = word.decode("utf-8", "replace")
    return [text] if _WHOLE.search(text) else _PARTS.findall(text.lower())


def chunks(text: bytes) -> list[bytes]:
    """The text without white space, cut so that each piece's ids are its own; ASCII letters lowered where that changes no id."""
    cased = b"<|" in text or not text.isascii() and _CASED.search(text)
    return _CHUNKS.findall(text if cased else text.lower())


class Vocabulary:
    """Ids of words, or chunks of them, as bytes of 32-bit numbers, kept for those seen before."""

    def __init__(self, encoder: Tokenizer):
        self.encoder = encoder
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def learn(self, words: set[bytes]) -> None:
        """Look up what isn't known of ``words``; afterwards ``self.words`` has all of them."""
        if len(self.words) + len(self.parts) > KEPT:
            self.words.clear()
            self.parts.clear()
        cut = {w: parts(w) for w in words.difference(self.words)}
        needed = {p for found in cut.values() for p in found}
        new = list(needed.difference(self.parts))
        ids, counts = word_ids(self.encoder, new)
        data, ends = ids.astype("<u4").tobytes(), np.cumsum(counts * 4).tolist()
        known = {p: self.parts[p] for p in needed.intersection(self.parts)}
        known.update(zip(new, (data[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True))
        for w, found in cut.items():
            if len(found) == 1:  # kept as a word
                self.words[w] = known[found[0]]
            else:
                self.words[w] = b"".join([known[p] for p in found])
                self.parts.update((p, known[p]) for p in found)


@functools.lru_cache(maxsize=1)
def vocabulary(tokenizer: str) -> Vocabulary:
    """The words that this Python worker knows, for all tasks that it runs one after another; ``KEPT`` bounds them."""
    return Vocabulary(Tokenizer.from_file(tokenizer))
