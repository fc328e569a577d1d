"""Token ids of whole texts by the tokenizers library, with repeated words encoded once per worker.

The tokenizer of the queries lower-cases, splits at white space and into runs of letters, single digits and runs of signs, and
merges inside those pieces only. So what stands between blanks has the same ids wherever it stands, and its ids are kept. That short
cut is taken for texts of letters and signs below U+0250, where lower case and composition go character by character; every other
text, and every tokenizer that is built otherwise, is encoded as a whole. Both ways give the ids of ``Tokenizer.encode``.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array

import numpy as np

KEPT = 300_000  # words a worker remembers twice over
ENDS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # signs of one run after the letters of a word; an apostrophe may begin a piece of its own

# The parts of the tokenizer file under which pieces are independent.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _plain_chars() -> list[str]:
    chars = [chr(c) for c in [9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x250)] if c not in (0xAD, 0x130)]
    known = {c for c in chars if unicodedata.normalize("NFC", c) == c}
    return [c for c in chars if c in known and c.lower() in known]


def _ranges(chars: list[str]) -> str:
    out, codes = "", sorted(map(ord, chars))
    start = last = codes[0]
    for c in [*codes[1:], None]:
        if c is None or c != last + 1:
            out += f"\\u{start:04x}-\\u{last:04x}"
            start = c
        last = c
    return out


_PLAIN = _plain_chars()
_LETTERS, _DIGITS = ([c for c in _PLAIN if unicodedata.category(c)[0] == k] for k in "LN")
_SIGNS = [c for c in _PLAIN if unicodedata.category(c)[0] not in "LN" and not c.isspace()]
_OTHER = re.compile(f"[^{_ranges(_PLAIN)}]|<\\|")
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_ranges(_LETTERS)}]+|[{_ranges(_DIGITS)}]|[{_ranges(_SIGNS)}]+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next free code point."""
    shown = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        split = (made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_piece = (
            (made.get("normalizer") or {}).get("normalizers") == NORMALIZERS
            and split[0].get("pattern") == {"Regex": SPLIT} and split[0].get("behavior") == "Removed" and split[-1].get("type") == "ByteLevel"
            and made["model"].get("end_of_word_suffix") == "</w>" and all(t["content"].startswith("<|") for t in made["added_tokens"])
        )
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        word = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _word(self, word: str) -> bytes | None:
        """Ids of what stands between blanks; None where it has a sign outside the short cut."""
        if word.isascii():
            core = word.rstrip(ENDS)
            if core.isalpha() and "<|" not in word:  # letters, and after them one run of signs or none
                ids = self.known.get(core) or self._piece(core)
                if len(core) < len(word):
                    end = word[len(core) :]
                    if end not in self.known:
                        self.known[end] = self._piece(end)
                    ids += self.known[end]
                return ids
        if _OTHER.search(word):
            return None
        return b"".join([self._piece(p) for p in _PIECES.findall(word)])

    def _short_cut(self, words: list[str]) -> bytes | None:
        """Ids of words between blanks; None where one has a sign outside the short cut. When full, the known ones become the older ones, from which those still in use come back."""
        if len(self.known) >= KEPT:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        parts = list(map(known.get, words))
        if None in parts:
            for i, ids in enumerate(parts):
                if ids is None:
                    word = words[i]
                    ids = known.get(word)
                    if ids is None:
                        ids = older.get(word)
                        if ids is None:
                            ids = self._word(word)
                            if ids is None:
                                return None
                        known[word] = ids
                    parts[i] = ids
        return b"".join(parts)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, without special tokens."""
        if not text:
            return b""
        if self.by_piece:
            low = text.lower()
            words = low.split()
            # Only these four blanks: where the text is cut at any other, more is gone than they count for.
            if len(low) - sum(map(len, words)) == low.count(" ") + low.count("\n") + low.count("\t") + low.count("\r"):
                ids = self._short_cut(words)
                if ids is not None:
                    return ids
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def encoder(path: str) -> Encoder:
    """One encoder per worker process and tokenizer file. This package travels by value, so what lasts from task to task hangs on an installed module."""
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_encoders_by_path", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]
