"""Encoding of distinct white-space separated words with a public tokenizer file."""

from __future__ import annotations

import re
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tickloom.llm.common import worker_state

#: A line for each word: letters whose lower case is one letter and which normalisation leaves alone, then ASCII marks without
#: apostrophes, which the tokenizer takes as one piece; or anything else.
_PLAIN = re.compile(r"^(?:([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)|(.+))$", re.MULTILINE)
_LETTERS = re.compile(r"[a-zß-öø-ÿ]+")
#: Distinct words whose ids a Python worker remembers at once.
WORDS = 300_000


class WordEncoder:
    """Ids of words as the tokenizer gives them inside any text.

    The tokenizer drops white space and merges nothing across it, so a text's ids are its words'
    ids in order. Plain words are lower-cased, cut from trailing marks and encoded many per call;
    every other word goes to the tokenizer as it is.
    """

    def __init__(self, path: str, remember: int = WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.suffix = "</w>"
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith(self.suffix)]] = True
        self.remember = remember
        self.known: dict[str, bytes] = {}

    def _plain(self, words: list[str]) -> None:
        """Encode words that make one piece each, many in one string."""
        for lo in range(0, len(words), 512):
            part = words[lo : lo + 512]
            # The batch call leaves out offsets, which nobody reads.
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part):  # not one piece each after all
                for w in part:
                    self.known[w] = self._whole(w)
                continue
            ends = (4 * cuts).tolist()
            self.known.update(zip(part, map(ids.tobytes().__getitem__, map(slice, [0, *ends], ends)), strict=True))

    def _whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, words: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each word."""
        if len(self.known) > self.remember:
            self.known.clear()
        known = self.known
        split = [(a.lower() or o, b) for a, b, o in _PLAIN.findall("\n".join(words))]  # words hold no line feed
        if len(split) != len(words):
            raise ValueError("a word is empty or holds a line feed")
        new = dict.fromkeys(x for x, _ in split if x not in known)
        # A lower-cased plain word that is no letters any more, or a word beside letters, is encoded by itself.
        plain = [w for w in new if _LETTERS.fullmatch(w)]
        self._plain(plain)
        odd = [*(w for w in new if w not in known), *(b for b in {b for _, b in split} if b and b not in known)]
        if odd:
            for w, e in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False), strict=True):
                known[w] = np.array(e.ids, dtype="<u4").tobytes()
        return [known[a] + known[b] if b else known[a] for a, b in split]


def encoder(path: str) -> WordEncoder:
    """The worker's encoder, kept from task to task."""
    return worker_state(f"encoder {path}", lambda: WordEncoder(path))


class Codes(dict):
    """Numbers words in the order in which they first appear."""

    def __missing__(self, word: bytes | str) -> int:
        n = self[word] = len(self)
        return n


class WordTable:
    """Ids of all words that a worker has met, by number; only new words are encoded."""

    def __init__(self, path: str, most: int = 700_000):
        self.path, self.most = path, most
        self.clear()

    def clear(self) -> None:
        self.known, self.size, self.count = Codes({"": 0}), 0, 1  # the empty word has no ids
        self.flat, self.starts, self.lengths = np.zeros(1 << 16, "<u4"), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _numbers(self, words: list[str]) -> np.ndarray:
        """Numbers of the words; the table starts anew once it holds ``most`` words."""
        if len(self.known) > self.most:
            self.clear()
        out = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        new = list(islice(self.known, self.count, None))
        if new:
            pieces = encoder(self.path).encode(new)
            lengths = np.fromiter(map(len, pieces), np.int64, len(new)) // 4
            ids = np.frombuffer(b"".join(pieces), "<u4")
            self.flat = _room(self.flat, self.size, len(ids))
            self.starts, self.lengths = (_room(a, self.count, len(new)) for a in (self.starts, self.lengths))
            self.flat[self.size : self.size + len(ids)] = ids
            self.starts[self.count : self.count + len(new)] = self.size + np.cumsum(lengths) - lengths
            self.lengths[self.count : self.count + len(new)] = lengths
            self.size, self.count = self.size + len(ids), self.count + len(new)
        return out

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; null counts as empty. Only a batch's distinct words are looked up."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))  # at the ends of a text there may be an empty word
        words = split.flatten().dictionary_encode()
        if not len(words):
            return []
        # As one string, which is cut here: faster than a Python object from each Arrow value.
        distinct = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words.dictionary)], pa.int32()), words.dictionary), "\n")[0].as_py().split("\n")
        codes = self._numbers(distinct)[words.indices.to_numpy()]
        ids = gather(codes, self.flat, self.starts, self.lengths)
        cuts = np.append(0, np.cumsum(self.lengths[codes]))[split.offsets.to_numpy()].tolist()
        return [ids[a:b] for a, b in pairwise(cuts)]


def _room(a: np.ndarray, used: int, more: int) -> np.ndarray:
    """The array, with room for more entries; it grows by doubling."""
    if used + more <= len(a):
        return a
    wide = np.zeros(max(2 * len(a), used + more), a.dtype)
    wide[:used] = a[:used]
    return wide


def gather(codes: np.ndarray, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated pieces ``flat[starts[c] : starts[c] + lengths[c]]`` of all codes c."""
    n = lengths[codes]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(starts[codes] - (ends - n), n)]
