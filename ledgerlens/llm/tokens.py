"""Encoding of whole texts with a tokenizer file, word by word through a bounded cache."""

from __future__ import annotations

import os
import re
from array import array
from itertools import accumulate, chain

import numpy as np

#: Bytes of words and their ids that a Python worker keeps; a word is one run without white space.
CACHE_BYTES = 200 << 20
#: What a word costs beside its own bytes and those of its ids: two objects and a place in the table.
_ENTRY = 170
#: The id appended to each document.
END_ID = 2
#: Letters of ASCII and Latin-1, then perhaps marks without an apostrophe: one or two pre-tokens, whatever stands beside them.
_PLAIN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+([!-&(-/:-@\[-`{-~]*)")
_JOINED = 4000

_loaded: dict[str, WordEncoder] = {}


class WordEncoder:
    """Ids of whole UTF-8 texts, as little-endian uint32 bytes.

    The tokenizer's pre-tokeniser removes white space and never joins what stands on both sides of it, so the ids of a
    text are those of its words (runs without ASCII white space) in a row. A vocabulary of the words seen before saves most
    of the work. New plain words are encoded many at once, with blanks between them; their ids are told apart by the vocabulary's
    end-of-word mark. Tokenizers that do keep white space must set ``by_word=False``.
    """

    def __init__(self, path: str, by_word: bool = True, cache_bytes: int = CACHE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word, self.cache_bytes = by_word, cache_bytes
        self.cache: dict[bytes, bytes] = {}
        self.held = 0
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = None
        if suffix:
            self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
            self.ends[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith(suffix)]] = True

    def raw(self, items: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([x.decode() for x in items], add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def _plain(self, words: list[bytes], pretokens: list[int]) -> list[bytes]:
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, "<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != sum(pretokens):  # not as expected: one by one
            return self.raw(words)
        data, at = ids.tobytes(), (4 * stops[np.cumsum(pretokens) - 1]).tolist()
        return [data[a:b] for a, b in zip([0, *at], at, strict=False)]

    def words(self, items: list[bytes]) -> dict[bytes, bytes]:
        """The ids of words that are not in the cache."""
        if self.ends is None:
            return dict(zip(items, self.raw(items), strict=True))
        plain, counts, other = [], [], []
        for w in items:
            if m := _PLAIN.fullmatch(w):
                plain.append(w)
                counts.append(2 if m[1] else 1)
            else:
                other.append(w)
        found = dict(zip(other, self.raw(other), strict=True))
        for k in range(0, len(plain), _JOINED):
            own = plain[k : k + _JOINED]
            found.update(zip(own, self._plain(own, counts[k : k + _JOINED]), strict=True))
        return found

    def encode(self, items: list[bytes]) -> list[bytes]:
        """The ids of each text."""
        if not self.by_word:
            return self.raw(items)
        split = [x.split() for x in items]
        words = list(chain.from_iterable(split))
        ids = list(map(self.cache.get, words))
        unknown = [k for k, x in enumerate(ids) if x is None]
        if unknown:
            found = self.words(list({words[k] for k in unknown}))
            for k in unknown:
                ids[k] = found[words[k]]
            size = sum(map(len, found)) + sum(map(len, found.values())) + _ENTRY * len(found)
            if self.held + size <= self.cache_bytes:
                self.cache.update(found)
                self.held += size
            elif len(unknown) > len(words) // 2 and size <= self.cache_bytes:  # the words have changed: start again with these
                self.cache, self.held = found, size
        stops = list(accumulate(map(len, split)))
        return [b"".join(ids[a:b]) for a, b in zip([0, *stops], stops, strict=False)]


def forget() -> None:
    """Free the vocabularies: workers live on into stages that have other uses for the memory."""
    _loaded.clear()


def encoder(path: str, by_word: bool = True, cache_bytes: int = CACHE_BYTES) -> WordEncoder:
    """One encoder per file and Python worker; workers serve many tasks."""
    key = f"{path}:{by_word}"
    if key not in _loaded:
        _loaded[key] = WordEncoder(path, by_word, cache_bytes)
    return _loaded[key]
