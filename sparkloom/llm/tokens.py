"""Token ids of whole texts, by the tokenizers library."""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import numpy as np

#: Words whose ids a worker keeps; beyond that the cache starts anew.
CACHE_WORDS = 500_000
#: New words that the library gets as one text.
TOGETHER = 64

_LATIN = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
# Where text may be cut: after a run of Latin letters that ends before a non-word
# character, before a single space between two other characters, and around a
# line end before another character.  Both public vocabularies split there in any
# case, so that the ids of the pieces are those of the text.
_CUT = re.compile(rf" ?[{_LATIN}]++(?![\w\u0300-\U0010ffff])|\n(?=\S)|.+?(?=(?<=\S) \S|\n\S|\Z)", re.S)
_WORD = re.compile(rf" [{_LATIN}]+")


class _Known(dict):
    """Numbers of words, in order of their first use; ``new`` has those not encoded yet."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


class Encoder:
    """Ids of texts as the library gives them for the whole text.

    Texts are cut where the vocabulary cuts them anyway and the ids of words
    that come again are kept, since the same words make up most of a corpus.
    Strings of special tokens in a text have the special id, as by the
    library's default; with ``special_as_text`` they are ordinary text.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        added = [] if special_as_text else list(self.tokenizer.get_added_tokens_decoder().values())
        strings = sorted((t.content for t in added), key=len, reverse=True)
        # such strings stand for themselves, whatever is beside them
        self.alone = all(not (t.lstrip or t.rstrip or t.single_word or t.normalized) for t in added)
        either = "(" + "|".join(map(re.escape, strings)) + ")"
        self.special = re.compile(either, 0 if self.alone else re.I) if strings else None
        # tokens that end a word, or else tokens that begin one with its space
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = suffix is not None
        normalizer = self.tokenizer.normalizer
        self.folds = normalizer is not None and normalizer.normalize_str("A") == "a"
        self.marks = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        for token, number in vocabulary.items():
            self.marks[number] = token.endswith(suffix) if self.ends else token.startswith("Ġ")
        self._forget()

    def _forget(self) -> None:
        self.known = _Known()
        self.ids, self.n_ids = np.zeros(1 << 16, np.uint32), 1
        self.first, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.known[None], self.sizes[0] = 0, 1  # the end of a text, which is a word of one id

    def _pieces(self, text: str) -> list[str]:
        if self.special is None or not self.special.search(text):
            return _CUT.findall(text)
        if not self.alone:
            return [text]
        return [w for part in self.special.split(text) for w in _CUT.findall(part)]

    def _split(self, words: list[str], ids: np.ndarray) -> np.ndarray | None:
        """How many of the ids belong to each of the joined words; None if that can't be told."""
        at = np.flatnonzero(self.marks[ids])
        if len(at) != len(words) or len(at) == 0:
            return None
        edges = np.concatenate([[0], at + 1] if self.ends else [at, [len(ids)]])
        return np.diff(edges) if edges[0] == 0 and edges[-1] == len(ids) else None

    def _learn(self) -> None:
        """Encode the new words: plain ones joined, which saves a call for each, all others alone."""
        new, self.known.new = self.known.new, []
        if not new:
            return
        number = len(self.known) - len(new)
        plain, other, same = [], [], []
        for i, w in enumerate(new, number):
            if not _WORD.fullmatch(w):
                other.append((i, w))
            elif self.folds and (low := w.lower()) != w:
                same.append((i, low))
            else:
                plain.append((i, w))
        for _, low in same:  # Latin words have the ids of their lower-case form
            if low not in self.known:
                plain.append((self.known[low], low))
        self.known.new.clear()
        groups = [plain[i : i + TOGETHER] for i in range(0, len(plain), TOGETHER)]
        joined = self._encoded(["".join(w for _, w in g) for g in groups])
        self._grow(len(self.known))
        for group, ids in zip(groups, joined):
            sizes = self._split([w for _, w in group], ids)
            if sizes is None:
                other += group
            else:
                self._put([i for i, _ in group], sizes, ids)
        for k in range(0, len(other), 4096):
            some = other[k : k + 4096]
            found = self._encoded([w for _, w in some])
            self._put([i for i, _ in some], np.array([len(f) for f in found]), np.concatenate(found))
        if same:
            numbers, lows = [i for i, _ in same], [self.known[low] for _, low in same]
            self.first[numbers], self.sizes[numbers] = self.first[lows], self.sizes[lows]

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in found]

    def _grow(self, words: int) -> None:
        if words > len(self.first):
            more = np.zeros(2 * words - len(self.first), np.int64)
            self.first, self.sizes = np.concatenate([self.first, more]), np.concatenate([self.sizes, more])

    def _put(self, numbers: list[int], sizes: np.ndarray, ids: np.ndarray) -> None:
        end = self.n_ids + len(ids)
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(2 * end - len(self.ids), np.uint32)])
        self.ids[self.n_ids : end] = ids
        self.first[numbers] = self.n_ids + np.cumsum(sizes) - sizes
        self.sizes[numbers] = sizes
        self.n_ids = end

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids (u32) one text after the other, each with ``end_id`` behind it, and where each begins."""
        if len(self.known) > CACHE_WORDS:
            self._forget()
        self.ids[0] = end_id
        cut = [self._pieces(t) for t in texts]
        for pieces in cut:
            pieces.append(None)
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        words = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64, int(counts.sum()))
        self._learn()
        sizes = self.sizes[words]
        upto = np.append(0, np.cumsum(sizes))
        # consecutive places in the table, jumping at each word
        source = np.repeat(self.first[words] - upto[:-1], sizes)
        source += np.arange(len(source))
        return self.ids[source], upto[np.append(0, np.cumsum(counts))]


@lru_cache(maxsize=2)
def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """The worker's encoder of that file; tasks of one worker share it."""
    return Encoder(path, special_as_text)
