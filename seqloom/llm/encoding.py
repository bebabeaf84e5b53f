"""Whole-text encoding with a public tokenizer, at the cost of its distinct words.

Both vocabularies split a text into pre-tokens before merging, and no pre-token
reaches across a single space between two other characters. So a text is cut
there, each distinct piece is encoded once by the tokenizers library, and the ids
are joined; with the vocabulary of bytes, so is a comma or stop that ends a piece after a
letter, where a pre-token ends as well. Texts with other runs of white space are given to the library whole, and so
are all texts if the vocabulary's file names other parts than the known ones.
"""

from __future__ import annotations

import json
import os

import numpy as np

#: Encoded pieces kept by one Python worker; the store is emptied when full.
MAX_PIECES = 1_500_000
#: Letters before this one are letters in every version of Unicode.
LATIN_END = "\u0250"
#: Longer pieces are encoded but not kept.
MAX_PIECE_CHARS = 40

# What must come before and during pre-tokenization so that no pre-token
# reaches across a single space.
BYTE_LEVEL = {"type": "ByteLevel", "use_regex": True, "add_prefix_space": False}
WORDS_ONLY = [{"type": "Split", "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "use_regex": False, "add_prefix_space": False}]
WORD_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "content": " "}, {"type": "Lowercase"}]


def cut_at_spaces(parts: dict) -> bool:
    """May texts be cut at single spaces? Only for a tokenizer made of the known parts."""

    def like(found: dict | None, want: dict) -> bool:
        return found is not None and all(found.get(k) == v for k, v in want.items())

    def each(found: dict | None, name: str, want: list[dict]) -> bool:
        rows = (found or {}).get(name) or []
        return len(rows) == len(want) and all(map(like, rows, want))

    if any(parts.get(k) for k in ("post_processor", "truncation", "padding")) or any(" " in t["content"] for t in parts["added_tokens"]):
        return False
    if parts["normalizer"] is None:
        return like(parts["pre_tokenizer"], BYTE_LEVEL)
    split = parts["pre_tokenizer"]
    if not (each(parts["normalizer"], "normalizers", WORD_NORMALIZERS) and each(split, "pretokenizers", WORDS_ONLY)):
        return False
    # Words hold no white space.
    return r"[^\s\p{L}\p{N}]+" in split["pretokenizers"][0]["pattern"].get("Regex", "")


_encoders: dict[tuple[str, int], PieceEncoder] = {}


def encoder(path: str, max_pieces: int = MAX_PIECES) -> PieceEncoder:
    """One encoder a Python worker and vocabulary file."""
    key = (path, max_pieces)
    if key not in _encoders:
        _encoders[key] = PieceEncoder(path, max_pieces)
    return _encoders[key]


class PieceEncoder:
    """text -> ids as little-endian unsigned 32-bit integers, the same as
    `encode(text, add_special_tokens=False)` of the library on the whole text."""

    def __init__(self, path: str, max_pieces: int = MAX_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.vocab_size = max(vocab.values()) + 1
        self.max_pieces = max_pieces
        self.kept: dict[str, bytes | None] = {}
        self.firsts: dict[str, bytes] = {}
        parts = json.loads(self.tokenizer.to_str())
        self.cut = cut_at_spaces(parts)
        self.byte_level = parts["normalizer"] is None
        #: Marks that begin a pre-token of their own after a letter, and their ids.
        self.stops: dict[str, bytes] = {}
        if self.byte_level:
            self.stops = {stop: self.whole(stop) for stop in ",."}
            self.opens = np.zeros(self.vocab_size, bool)
            for token, i in vocab.items():
                self.opens[i] = token.startswith("Ġ")
        else:
            marks = self.tokenizer.encode("\x01", add_special_tokens=False).ids
            self.mark = marks[0] if len(marks) == 1 else None

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def whole(self, text: str) -> bytes:
        return self._ids(text).tobytes()

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Encode distinct pieces in one call: each keeps its leading space, or a
        mark stands between them; where that fails, one by one."""
        if self.byte_level:
            ids = self._ids(" " + " ".join(pieces))
            at = np.flatnonzero(self.opens[ids])
            begins, ends = at, np.append(at[1:], len(ids))
        elif self.mark is not None:
            ids = self._ids(" \x01 ".join(pieces))
            at = np.flatnonzero(ids == self.mark)
            begins, ends = np.append(0, at + 1), np.append(at, len(ids))
        if (not self.byte_level and self.mark is None) or len(begins) != len(pieces):
            lead = " " if self.byte_level else ""
            return [self.whole(lead + p) for p in pieces]
        raw = ids.tobytes()
        return [raw[b:e] for b, e in zip((begins * 4).tolist(), (ends * 4).tolist(), strict=True)]

    def batch(self, texts: list[str]) -> list[bytes]:
        kept = self.kept
        if not self.cut:
            return list(map(self.whole, texts))
        if len(kept) > self.max_pieces:
            kept.clear()
            self.firsts.clear()
        rows = [t.split(" ") for t in texts]
        rest = [r[1:] for r in rows] if self.byte_level else rows
        new = set().union(*rest).difference(kept)
        # An empty piece, or one that white space begins or ends, belongs to a longer run.
        odd = {p for p in new if not p or p != p.strip()}
        plain = new - odd
        stopped = {p for p in plain if p[-1] in self.stops and p[-2:-1].isalpha() and p[-2] < LATIN_END}
        words = list((plain - stopped).union({p[:-1] for p in stopped}.difference(kept)))
        for group in (words[i : i + 20_000] for i in range(0, len(words), 20_000)):
            kept.update(zip(group, self._pieces(group), strict=True))
        kept.update({p: kept[p[:-1]] + self.stops[p[-1]] for p in stopped})
        # White space is dropped by the vocabulary of words, so that such pieces stand alone as well.
        kept.update({p: None if self.byte_level else self.whole(p) if p else b"" for p in odd})
        out = []
        for text, row, tail in zip(texts, rows, rest, strict=True):
            try:
                ids = b"".join(map(kept.__getitem__, tail))
            except TypeError:  # an odd piece
                out.append(self.whole(text))
                continue
            if self.byte_level:
                first = row[0]
                if first != first.rstrip():
                    out.append(self.whole(text))
                    continue
                if first not in self.firsts:
                    got = self.whole(first)
                    if len(first) <= MAX_PIECE_CHARS:
                        self.firsts[first] = got
                    ids = got + ids
                else:
                    ids = self.firsts[first] + ids
            out.append(ids)
        for p in new.union(words):
            if len(p) > MAX_PIECE_CHARS:
                del kept[p]
        return out

    def encode(self, texts: list[str], at_once_chars: int = 400_000):
        """(index, ids) of each text, about `at_once_chars` at a time."""
        group, first, chars = [], 0, 0
        for i, t in enumerate(texts):
            group.append(t)
            chars += len(t)
            if chars >= at_once_chars:
                yield from zip(range(first, i + 1), self.batch(group), strict=True)
                group, first, chars = [], i + 1, 0
        if group:
            yield from zip(range(first, len(texts)), self.batch(group), strict=True)
