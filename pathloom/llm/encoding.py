"""Token ids of whole texts through a bounded cache of space-delimited pieces.

The tokenizers library spends most of its time on bookkeeping around each call,
and a corpus repeats its words.  Texts are therefore cut at places where the
pre-tokenizer cuts anyway, each piece is encoded once by the library's own
pre-tokenizer and BPE model, and its ids are kept as little-endian uint32
bytes.  The result equals the library's ``encode(text, add_special_tokens=False)``:
the strings of special tokens in a text become those tokens, unless
``special_as_text`` is set, which equals ``encode_special_tokens = True`` there.

:meth:`Encoder.encode_all` works on many texts at once: each different piece of
a group of texts is looked at once, and plain words go through the merges
together (:mod:`pathloom.llm.merges`) instead of the cache.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from pathloom.llm.merges import Merges

#: Two white-space characters in a row; Python's class holds the library's and more, so this errs to the safe side.
_RUN = re.compile(r"\s\s")
#: White space other than the blank and the line feed.
_ODD = [c for c in map(chr, [*range(9, 10), *range(11, 14), *range(28, 32), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])]
_SAFE_CUT = re.compile(r"(?<=\S)(?= \S)")
_TAIL = ".,!?;:%$#&*|\"()[]-/"
#: White space as above, twice, for Arrow; and words of Latin-1 letters with punctuation after them.
_RUN_RE2 = "[ \n" + "".join(_ODD) + "]{2}"
_LETTERS = "".join(c for c in map(chr, range(256)) if c.isalpha())
_WORD_RE2 = f"^[{_LETTERS}]+[{re.escape(_TAIL)}]*$"
#: Longest word in bytes, its blank among them, that goes through the merges with others, by the widths of their matrices.
_WIDTHS = (6, 9, 13, 24)


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


class _Cache(dict):
    """piece -> ids, in two generations of at most ``limit``: a full one becomes the old one, from which what is used again moves back."""

    def __init__(self, encode, limit: int):
        super().__init__()
        self._encode, self._limit = encode, limit
        self._old: dict = {}

    def __missing__(self, piece: str) -> bytes:
        found = self._old.pop(piece, None)
        if found is None:
            found = self._encode(piece)
        if len(self) >= self._limit:
            self._old = dict(self)
            self.clear()
        self[piece] = found
        return found


def _merges(path: str, letters: list[str]) -> tuple[Merges, np.ndarray] | None:
    """The merges of a byte-level vocabulary file and the id of each byte; None for a file that asks for more than plain merges."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    odd = [model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")]
    vocabulary, merges = model.get("vocab", {}), [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    if model.get("type") != "BPE" or any(odd) or not merges or max(vocabulary.values()) >= 65_535 or any(c not in vocabulary for c in letters):
        return None
    pairs = np.array([(vocabulary[a], vocabulary[b]) for a, b in merges])
    if len(np.unique(pairs, axis=0)) < len(pairs):
        return None
    return Merges(pairs, np.array([vocabulary[a + b] for a, b in merges])), np.array([vocabulary[c] for c in letters], np.int32)


def _gather(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``ids`` that begin at ``starts``, one after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(ids)) < 1 << 31 else np.int64
    at = np.repeat((starts - ends + sizes).astype(kind), sizes)
    at += np.arange(total, dtype=kind)
    return ids[at]


class Encoder:
    """Encodes texts to bytes of little-endian uint32 ids.

    Some 2 * ``limit`` pieces of about 200 bytes are held at most; a smaller
    ``limit`` costs time and changes no result.
    """

    def __init__(self, path: str, limit: int = 150_000, special_as_text: bool = False):
        self._t = Tokenizer.from_file(path)
        self._model, self._pre, self._norm = self._t.model, self._t.pre_tokenizer, self._t.normalizer
        self._letters = dict(enumerate(_byte_letters()))
        added = self._t.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized or not t.special for t in added.values()):
            raise ValueError(f"{path}: added tokens other than plain special ones")
        #: None, or a pattern that finds special tokens, the longest first.
        self._special = None if special_as_text or not added else re.compile("|".join(f"({re.escape(t.content)})" for t in sorted(added.values(), key=lambda t: -len(t.content))))
        self._special_ids = [pack("<I", i) for i, _ in sorted(added.items(), key=lambda x: -len(x[1].content))]
        self._hint = os.path.commonprefix([t.content for t in added.values()])
        #: With a normalizer, white space only separates words; without, a space belongs to the word that follows.
        self.spaceless = self._norm is not None
        self._first = _Cache(lambda piece: self._piece("", piece, self._first), limit)
        self._later = _Cache(lambda piece: self._piece("" if self.spaceless else " ", piece, self._later), limit)
        self._tails = _Cache(lambda tail: self._packed(self._model.tokenize(tail)), 10_000)
        self._newline = b"" if self.spaceless else self._general("\n")
        self._path, self._together = path, None

    def _model_ids(self, word: str) -> list[int]:
        return [t.id for t in self._model.tokenize(word)]

    def _general(self, text: str) -> bytes:
        if self._norm is not None:
            text = self._norm.normalize_str(text)
        ids = [i for word, _ in self._pre.pre_tokenize_str(text) for i in self._model_ids(word)]
        return pack(f"<{len(ids)}I", *ids)

    @staticmethod
    def _packed(tokens: list) -> bytes:
        return pack(f"<{len(tokens)}I", *[t.id for t in tokens])

    def _piece(self, space: str, piece: str, cache: _Cache) -> bytes:
        """One piece; a plain Latin-1 word needs no regex, and punctuation after it is a piece of its own."""
        word = piece.rstrip(_TAIL)
        if not word.isalpha() or not word.isascii() and max(word) > "\xff":
            return self._general(space + piece)
        if len(word) < len(piece):
            return cache[word] + self._tails[piece[len(word) :]]
        if self._norm is not None:
            word = word.lower()
        if not word.isascii():
            # in Latin-1, NFC changes nothing, and lower case is one letter for one letter
            word = word.encode().decode("latin-1").translate(self._letters)
        # ASCII letters and punctuation stand for themselves in a byte-level vocabulary, and a dotted G for the blank
        return self._packed(self._model.tokenize("\u0120" + word if space else word))

    def encode(self, text: str) -> bytes:
        if self._special is None or self._hint not in text:
            return self._plain(text)
        out, at = [], 0
        for m in self._special.finditer(text):
            out += [self._plain(text[at : m.start()]), self._special_ids[m.lastindex - 1]]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        later = self._later.__getitem__
        if self.spaceless:
            # white space never joins tokens, so every blank is a place to cut
            return b"".join(map(later, text.replace("\n", " ").split(" ")))
        if ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or any(c in text for c in (_ODD[:8] if text.isascii() else _ODD))) and _RUN.search(text):
            # a blank between two other characters is always the start of a token
            return b"".join(map(self._first.__getitem__, _SAFE_CUT.split(text)))
        parts: list[bytes] = []
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            parts.append(self._first[head])
            parts.extend(map(later, rest))
            parts.append(self._newline)
        parts.pop()
        return b"".join(parts)

    def encode_all(self, texts: pa.Array, limit: int = 8_000_000) -> Iterator[bytes]:
        """:meth:`encode` of each text, in groups of texts of at most ``limit`` bytes; a longer text is encoded by itself."""
        if self._together is None:
            self._together = () if self.spaceless else _merges(self._path, _byte_letters()) or ()
        if not self._together:
            yield from (self.encode(t.as_py()) for t in texts)
            return
        ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
        first = 0
        while first < len(texts):
            held = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, held + limit, side="right")))
            part = texts.slice(first, last - first)
            odd = pc.match_substring_regex(part, _RUN_RE2 if self._special is None else f"{_RUN_RE2}|{re.escape(self._hint)}")
            odd = odd.to_numpy(zero_copy_only=False) | (np.diff(ends[first:last], prepend=held) > limit)
            plain = iter(self._plain_all(part.filter(pa.array(~odd))))
            for k, is_odd in enumerate(odd):
                yield self.encode(part[k].as_py()) if is_odd else next(plain)
            first = last

    def _plain_all(self, texts: pa.Array) -> list[bytes]:
        """:meth:`_plain` of texts without runs of white space and special tokens: as there, a line's first piece has no blank before it."""
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n "), " ")
        found, cuts = split.flatten().dictionary_encode(), split.offsets.to_numpy()
        pieces, codes = found.dictionary, found.indices.to_numpy().astype(np.int64)
        line_end = pc.index(pieces, "\n").as_py()  # -1 where there is none
        opens = np.zeros(len(codes) + 1, bool)
        opens[cuts[:-1]] = True
        opens[1:] |= codes == line_end
        opens = opens[:-1] & (codes != line_end)
        openers, own = np.unique(codes[opens], return_inverse=True)
        units, sizes = self._later_all(pieces, line_end)
        more = [self._first[p] for p in pieces.take(pa.array(openers)).to_pylist()]
        units = np.concatenate([units, np.frombuffer(b"".join(more), "<u4")])
        sizes = np.concatenate([sizes, np.array([len(x) // 4 for x in more], np.int64)])
        codes[opens] = len(pieces) + own
        each = sizes[codes]
        data = _gather(units, (np.cumsum(sizes) - sizes)[codes], each).astype("<u4").tobytes()
        bounds = 4 * np.concatenate([[0], np.cumsum(each)])[cuts]
        return [data[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def _later_all(self, pieces: pa.Array, line_end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces after a blank, how many each has); the piece at ``line_end`` is a line feed."""
        merges, byte_ids = self._together
        words = pc.utf8_rtrim(pieces, characters=_TAIL)
        size = pc.binary_length(words).to_numpy().astype(np.int64)
        whole = pc.binary_length(pieces).to_numpy().astype(np.int64)
        simple = pc.match_substring_regex(pieces, _WORD_RE2).to_numpy(zero_copy_only=False) & (size < _WIDTHS[-1])
        simple &= np.arange(len(pieces)) != line_end
        # units: the different words in order of width, then tails, then all other pieces
        distinct = words.filter(pa.array(simple)).dictionary_encode()
        word_of, distinct = distinct.indices.to_numpy().astype(np.int64), distinct.dictionary
        length = pc.binary_length(distinct).to_numpy().astype(np.int64)
        begin = np.cumsum(length) - length
        raw = np.zeros(int(length.sum()) + _WIDTHS[-1], np.uint8)
        if len(distinct):
            raw[: -_WIDTHS[-1]] = np.frombuffer(pc.binary_join(pa.ListArray.from_arrays([0, len(distinct)], distinct), "")[0].as_buffer(), np.uint8)
        unit = np.empty(len(distinct), np.int64)
        ids, sizes, done, least = [], [], 0, 0
        for width in _WIDTHS:
            rows = np.flatnonzero((length >= least) & (length < width))
            if len(rows):
                symbols = np.empty((len(rows), width), np.int32)
                symbols[:, 0] = byte_ids[32]
                symbols[:, 1:] = byte_ids[raw[begin[rows][:, None] + np.arange(width - 1)]]
                got = merges.apply(symbols, length[rows] + 1)
                ids.append(got[0])
                sizes.append(got[1])
                unit[rows] = done + np.arange(len(rows))
                done += len(rows)
            least = width
        tailed = simple & (whole > size)
        tails = pc.utf8_ltrim(pieces.filter(pa.array(tailed)), characters=_LETTERS).dictionary_encode()
        tail_of, tails = tails.indices.to_numpy(), tails.dictionary.to_pylist()
        others = pieces.filter(pa.array(~simple)).to_pylist()
        rest = [self._tails[t] for t in tails] + [self._newline if p == "\n" else self._later[p] for p in others]
        ids.append(np.frombuffer(b"".join(rest), "<u4").astype(np.int32))
        sizes.append(np.array([len(x) // 4 for x in rest], np.int64))
        ids, sizes = np.concatenate(ids), np.append(np.concatenate(sizes), 0)
        # each piece: a word or another piece, and a tail or the empty unit at the end
        both = np.full((len(pieces), 2), len(sizes) - 1)
        both[simple, 0] = unit[word_of]
        both[~simple, 0] = done + len(tails) + np.arange(len(others))
        both[tailed, 1] = done + tail_of
        each = sizes[both]
        return _gather(ids, (np.cumsum(sizes) - sizes)[both.reshape(-1)], each.reshape(-1)).astype(np.uint32), each.sum(axis=1)


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, limit: int = 150_000, special_as_text: bool = False) -> Encoder:
    """This process's encoder for a vocabulary file."""
    key = path, limit, special_as_text
    if key not in _encoders:
        _encoders.clear()  # one at a time: workers are used for one job after another
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def public_vocabulary(name: str) -> str:
    """The path of one of the installed public vocabulary files."""
    import public_tokenizers

    return public_tokenizers.path(name)
