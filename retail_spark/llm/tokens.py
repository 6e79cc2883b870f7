"""Token ids of ``word_bpe_49k.json`` for whole texts.

The ids are those of the ``tokenizers`` library.  Most text needs only a part of its
work: where every character is plain (ASCII or Latin-1 letters), the normaliser is
lower-casing, no piece reaches over a blank, and the pieces of a word between blanks are found by one
regular expression.  A word's ids are made once per task by the byte-pair engine of ``tiktoken`` on the same
vocabulary, with a line feed in place of the mark for a piece's end.  Every other text goes through ``tokenizers``.
"""

from __future__ import annotations

import json
import re
from itertools import chain

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

DEFAULT_TOKENIZER = "word_bpe_49k.json"
END_ID = 2
#: Words are pieces of a text.
CACHED_PIECES = 300_000
#: Longer words are not kept, so that the cache stays small where texts have no blanks.
LONGEST_KEPT = 64

_PLAIN = re.compile(r"[\t-\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
_WORD_END = "</w>"


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    return public_tokenizers.path(name)


def _bytes_of_characters() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a visible character."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class TextTokenizer:
    """``encode`` gives a text's ids as unsigned 32-bit numbers, without special tokens."""

    def __init__(self, path: str):
        self.exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        special = set(self.exact.get_added_tokens_decoder())
        byte = _bytes_of_characters()
        ranks = {}
        self.ends_sentence = np.zeros(self.exact.get_vocab_size(with_added_tokens=True), bool)
        for token, number in vocabulary.items():
            if number in special:
                continue
            end = token.endswith(_WORD_END)
            shown = token.removesuffix(_WORD_END)
            ranks[bytes(byte[c] for c in shown) + b"\n" * end] = number
            self.ends_sentence[number] = end and shown[-1:] in (".", "!", "?")
        self.ends_word = np.zeros(len(self.ends_sentence), bool)
        self.ends_word[[n for b, n in ranks.items() if len(b) > 1 and b.endswith(b"\n")]] = True
        self.pairs = tiktoken.Encoding("pieces", pat_str=r"[^\n]+\n", mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}

    def _learned(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words, as bytes of unsigned 32-bit numbers."""
        # A word of letters alone is one piece.
        pieces = [[w] if w.isalpha() else _PIECES.findall(w) for w in words]
        ids = np.array(self.pairs.encode_ordinary("\n".join(chain.from_iterable(pieces)) + "\n"), np.uint32)
        piece_ends = np.flatnonzero(self.ends_word[ids]) + 1
        ends = (4 * piece_ends[np.cumsum([len(p) for p in pieces]) - 1]).tolist()
        raw = ids.tobytes()
        return {w: raw[start:end] for w, start, end in zip(words, [0, *ends], ends)}

    def encode(self, text: str | None) -> np.ndarray:
        text = text or ""
        if "<|" in text or not _PLAIN.fullmatch(text):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        words = text.lower().split()
        known = self.known
        missing = set(words).difference(known)
        passing = []
        if missing:
            learned = self._learned(list(missing))
            passing = [w for w in learned if len(w) > LONGEST_KEPT]
            if len(known) + len(learned) > CACHED_PIECES:
                # This text has its own words, however many; the cache begins anew with them if it may hold them.
                own = {w: known[w] for w in set(words).difference(missing)}
                self.known = own if len(own) + len(learned) <= CACHED_PIECES else {}
                known = own
            known.update(learned)
        ids = np.frombuffer(b"".join(map(known.__getitem__, words)), np.uint32)
        for word in passing:
            del known[word]
        return ids
