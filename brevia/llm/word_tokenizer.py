"""Ids of whole texts under a tokenizer file that drops white space, through the tokenizers library."""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Words, and pieces of words, kept with their ids; once there are more all are forgotten. Longer ones are not kept.
KEPT_WORDS = 400_000
KEPT_PIECES = 300_000
KEPT_BYTES = 64
# Below this code point a text is its own normal form, and lower case needs no context.
_PLAIN = 0x100


def _plain(kind: str) -> str:
    """The plain characters of a Unicode category, for a character class."""
    return "".join(re.escape(chr(c)) for c in range(_PLAIN) if unicodedata.category(chr(c)).startswith(kind))


# The pattern at which the tokenizer's file cuts a lower-cased text into pieces, for plain characters.
_LETTERS, _NUMBERS, _WHITE = _plain("L"), _plain("N"), "\t-\r \x85\xa0"
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_WHITE}{_LETTERS}{_NUMBERS}]+")


def _byte_letters() -> dict[int, str]:
    """The plain characters as a byte-level model writes their UTF-8 bytes: a visible byte as its own character, the
    others, in order, as those from U+0100 on."""
    visible = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in visible]
    shown = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return {c: "".join(shown[b] for b in chr(c).encode()) for c in range(_PLAIN)}


# What a tokenizer's file says if its texts may be taken word by word.
_MADE_FOR = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None,
}


class WordTokenizer:
    """Encodes texts word by word, each different word once in a while.

    The file's tokenizer must drop white space and never join what white space parts, so that the ids of a text are those
    of its words in order. Then a word's ids can be kept; in prose nine of ten words were seen shortly before. A new word
    of plain characters is cut at the tokenizer's own pattern and its pieces, most of them seen before, go to the library's
    model; any other goes through the library's whole tokenizer. A file with another normaliser or pattern than this was made
    for is not taken apart: whole texts go through the library.
    """

    def __init__(self, path: str, end_id: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one Spark task, one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # strings of special tokens in a text are text
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.end, self.most_id = end_id, max(self.tokenizer.get_vocab().values(), default=0)
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        self.by_words = all(said.get(name) == value for name, value in _MADE_FOR.items())
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.long: list[str] = []  # pieces to be forgotten

    def _plain_word(self, text: str) -> bytes:
        known, text = self.pieces, text.lower()
        if text in known:
            return known[text]
        pieces = [text] if text.isascii() and text.isalpha() else PIECES.findall(text)
        for piece in pieces:
            if piece not in known:
                letters = piece if piece.isascii() and piece.isprintable() else piece.translate(self.letters)
                ids = [token.id for token in self.model.tokenize(letters)]
                known[piece] = struct.pack(f"<{len(ids)}I", *ids)
                if len(piece) > KEPT_BYTES:
                    self.long.append(piece)
        return b"".join([known[piece] for piece in pieces])

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids of new words."""
        learnt, others = {}, []
        for word in words:
            if word.isascii() or ord(max(word)) < _PLAIN:
                learnt[word] = self._plain_word(word)
            else:
                others.append(word)
        if others:
            found = self.tokenizer.encode_batch_fast(others, add_special_tokens=False)
            learnt.update((word, struct.pack(f"<{len(one.ids)}I", *one.ids)) for word, one in zip(others, found))
        return learnt

    def _word_ids(self, words: list[str]) -> list[bytes]:
        """The ids of different words, as they are kept; long ones, and all if there are too many, are forgotten after."""
        found = [*map(self.words.get, words)]
        new = [at for at, ids in enumerate(found) if ids is None]
        learnt = self._learn([words[at] for at in new])
        for at in new:
            found[at] = learnt[words[at]]
        self.words.update(learnt)
        long = [word for word in learnt if len(word) > KEPT_BYTES]
        for kept, most, some in ((self.words, KEPT_WORDS, long), (self.pieces, KEPT_PIECES, self.long)):
            if len(kept) > most:
                kept.clear()
            else:
                for text in some:
                    del kept[text]
        self.long = []
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all whole texts, each with the end id behind, end to end; and how many each has. A null text is empty.

        Arrow splits the texts and numbers their different words; only these are looked up, and numpy puts the ids in place.
        """
        texts = pc.fill_null(texts, "")
        if not self.by_words:
            split = [np.array(one.ids, np.uint32) for one in self.tokenizer.encode_batch_fast(
                texts.to_pylist(), add_special_tokens=False)]
            sizes = np.array([len(one) for one in split], np.int64)
            ids = np.concatenate([np.zeros(0, np.uint32), *split])
        else:
            lists = pc.ascii_split_whitespace(texts)
            words = lists.flatten().dictionary_encode()
            known = self._word_ids(words.dictionary.to_numpy(zero_copy_only=False).tolist())
            table = np.frombuffer(b"".join(known), "<u4")
            lengths = np.fromiter(map(len, known), np.int64, len(known)) // 4
            begins, number = lengths.cumsum() - lengths, words.indices.to_numpy()
            each = lengths[number] if len(number) else np.zeros(0, np.int64)
            ends = np.concatenate([[0], each.cumsum()])
            ids = table[np.repeat(begins[number] - ends[:-1], each) + np.arange(ends[-1])] if ends[-1] else table[:0]
            sizes = np.diff(ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()])
        if self.end is None:
            return ids.astype(np.uint32), sizes
        out = np.empty(len(ids) + len(sizes), np.uint32)
        last = sizes.cumsum() + np.arange(len(sizes))
        inside = np.ones(len(out), bool)
        inside[last] = False
        out[last], out[inside] = self.end, ids
        return out, sizes + 1


@lru_cache(maxsize=2)
def tokenizer(path: str, end_id: int | None = None) -> WordTokenizer:
    """The tokenizer of a file, read once in each Python worker."""
    return WordTokenizer(path, end_id)
