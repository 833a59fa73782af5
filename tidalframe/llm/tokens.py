"""Token ids of whole Arrow batches: each distinct piece of a word is encoded once.

Both public tokenizers split text before merging, and a space always opens a new piece there, so a
text cut before single spaces gives the same ids in parts.  So does a word cut between a letter and
an ASCII sign, for no piece holds a letter followed by a sign, and one cut on both sides of a lone line
feed where white space counts.  New pieces are encoded many at a time as one text; where a piece's
ids begin is seen from the ids.  Texts with other white space in places where that isn't certain are encoded whole.
"""

from __future__ import annotations

import itertools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Special tokens, in any case.
_MARKED = r"<\|"
#: White space other than space and line feed, or runs in which a cut could change the pieces; special tokens.
_UNSURE = r"[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|  |\n \n|" + _MARKED
#: White space that a tokenizer without line feeds takes for a space.
_WHITE = "\t\n\x0b\x0c\r"
#: Where words are cut: a letter before a sign (where case is nothing, one that normalising leaves a letter), and a lone line feed.
_SIGN, _FEED = r"([!-/:-@\[-`{-~])", r"([^\s\x00])\n([^\s\x00])"
_CUT, _CUT_FOLDED = r"(\p{L})" + _SIGN, r"([\p{Ll}\p{Lm}])" + _SIGN
#: Bytes of text encoded at once: more texts share more words.
TOKEN_CHUNK_BYTES = 6 << 20
#: Pieces kept by a worker before it starts afresh, and pieces encoded as one text.
KEPT_PIECES, JOINED = 400_000, 400
_NOTHING, _SPACE = (pa.scalar(x, pa.large_string()) for x in ("", " "))


class WordTokenizer:
    """ids of texts as one array and offsets; the file is loaded on first use."""

    _loaded: dict[str, "WordTokenizer"] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads only add cost
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # a tokenizer for which case and the white space between words are nothing
        self.folds = all(self._ids(a) == self._ids(b) for a, b in (("One two", "one \n\t TWO"), (" x", "x"), ("x\x0by", "x y")))
        self.feed = self._ids("\n")
        vocabulary = self.tokenizer.get_vocab()
        size = max(vocabulary.values(), default=0) + 1
        self.opens, self.closes = np.zeros(size, bool), np.zeros(size, bool)
        for token, number in vocabulary.items():
            self.opens[number], self.closes[number] = token.startswith("\u0120"), token.endswith("</w>")
        self._clear()

    @classmethod
    def at(cls, path: str) -> "WordTokenizer":
        """The worker's tokenizer for a file, with the pieces that it has met."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(1 << 20, np.uint32)
        self.ends = np.zeros(1 << 18, np.int32)
        self.used = 0

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for lo in range(0, len(texts), 5000) for e in self.tokenizer.encode_batch_fast(texts[lo : lo + 5000], add_special_tokens=False)]

    def _learn_each(self, pieces: list[str]) -> None:
        ids = self._encoded(pieces)
        self._enter(pieces, np.concatenate(ids) if ids else np.zeros(0, np.uint32), np.fromiter(map(len, ids), np.int64, len(ids)))

    def _learn_joined(self, pieces: list[str], glue: str) -> None:
        """Pieces in texts of many; those of a text whose ids don't show as many pieces are encoded one by one."""
        groups = [pieces[lo : lo + JOINED] for lo in range(0, len(pieces), JOINED)]
        for group, ids in zip(groups, self._encoded([glue.join(g) for g in groups]), strict=True):
            if glue == "\n":
                feeds = ids == self.feed[0]
                edges = np.concatenate([[0], np.flatnonzero(feeds) - np.arange(feeds.sum()), [len(ids) - feeds.sum()]])
                ids = ids[~feeds]
            elif self.folds:
                edges = np.concatenate([[0], np.flatnonzero(self.closes[ids]) + 1])
            else:
                edges = np.append(np.flatnonzero(self.opens[ids]), len(ids))
            if len(edges) == len(group) + 1 and edges[0] == 0 and edges[-1] == len(ids):
                self._enter(group, ids, np.diff(edges))
            else:
                self._learn_each(group)

    def _learn(self, pieces: pa.Array, listed: list[str]) -> np.ndarray:
        """Enter new pieces; their numbers."""
        flags = lambda pattern: pc.match_substring_regex(pieces, pattern).to_numpy(zero_copy_only=False).astype(bool)
        pure = flags(r"^\p{L}+$" if self.folds else r"^ [^\s]+$")
        bare = flags(r"^[^\s]+$") if not self.folds and len(self.feed) == 1 else np.zeros(len(listed), bool)
        number = np.empty(len(listed), np.int64)
        for mask, glue in ((pure, " " if self.folds else ""), (bare, "\n"), (~(pure | bare), None)):
            at = np.flatnonzero(mask)
            own, first = [listed[i] for i in at.tolist()], len(self.known) + 1
            if glue is None:
                self._learn_each(own)
            else:
                self._learn_joined(own, glue)
            number[at] = np.arange(first, first + len(own))
        return number

    def _enter(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        first = len(self.known) + 1
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while first + len(pieces) > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.ends[first : first + len(pieces)] = self.used + np.cumsum(sizes)
        self.used += len(ids)
        self.known.update(zip(pieces, range(first, first + len(pieces)), strict=True))

    def _numbers(self, pieces: pa.Array) -> np.ndarray:
        """Numbers of distinct pieces in the table of ids."""
        listed = pieces.to_pylist()
        number = np.fromiter(map(self.known.get, listed, itertools.repeat(0)), np.int64, len(listed))
        if (new := np.flatnonzero(number == 0)).size:
            number[new] = self._learn(pieces.take(pa.array(new)), [listed[i] for i in new.tolist()])
        return number

    def _word_ids(self, words: pa.Array) -> pa.ListArray:
        """The ids of each of distinct words."""
        words = pc.replace_substring_regex(words, _CUT_FOLDED if self.folds else _CUT, "\\1\0\\2")
        if not self.folds:
            words = pc.replace_substring_regex(words, _FEED, "\\1\0\n\0\\2")
        split = pc.split_pattern(words, "\0")
        bounds = split.offsets.to_numpy()
        pieces = split.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        number = self._numbers(pieces.dictionary)[pieces.indices.to_numpy()]
        table = pa.ListArray.from_arrays(pa.array(self.ends[: len(self.known) + 1]), pa.array(self.ids[: self.used]))
        taken = table.take(pa.array(number - 1))
        ends = taken.offsets.to_numpy()
        return pa.ListArray.from_arrays(pa.array(ends[bounds - bounds[0]]), taken.values)

    def encode(self, texts: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
            texts = texts if isinstance(texts, pa.Array) else pa.concat_arrays(texts.chunks)
        texts = texts.fill_null("").cast(pa.large_string())
        if len(self.known) > KEPT_PIECES:
            self._clear()
        unsure = pc.or_(pc.match_substring_regex(texts, _MARKED if self.folds else _UNSURE), pc.match_substring(texts, "\0")).to_numpy(zero_copy_only=False).astype(bool)
        # always a copy: some kernels misread texts whose bytes don't start at the first one
        plain = pc.if_else(pa.array(unsure), "", texts).cast(pa.large_string())
        if self.folds:
            plain = pc.ascii_lower(plain)
            for c in _WHITE:
                plain = pc.replace_substring(plain, c, " ")
        split = pc.split_pattern(plain, " ")
        bounds = split.offsets.to_numpy()
        words = split.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        bounds = bounds - bounds[0]
        at = words.indices.to_numpy()
        distinct = words.dictionary
        if not self.folds:  # words that open a text have no space before them
            at = at.copy()
            opening, place = np.unique(at[bounds[:-1]], return_inverse=True)
            at[bounds[:-1]] = len(distinct) + place
            distinct = pa.concat_arrays([pc.binary_join_element_wise(_NOTHING, distinct, _SPACE), distinct.take(pa.array(opening))])
        taken = self._word_ids(distinct).take(pa.array(at))
        total = taken.offsets.to_numpy()
        ids = taken.values.to_numpy()[total[0] : total[-1]]
        total = total.astype(np.int64) - total[0]
        offsets = total[bounds]
        if not unsure.any():
            return ids, offsets
        parts, sizes = [], np.diff(offsets)
        for i in range(len(texts)):
            if unsure[i]:
                own = np.array(self._ids(texts[i].as_py()), np.uint32)
                sizes[i] = len(own)
                parts.append(own)
            else:
                parts.append(ids[offsets[i] : offsets[i + 1]])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])
