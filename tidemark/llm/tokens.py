"""Token ids of whole texts by a public tokenizer, through a cache of words.

Both vocabularies used here split a text into words before merging, and a word's
ids do not depend on its neighbours.  The library encodes each word once per
worker; a text is the concatenation of its words' ids.  A text whose white
space could be split otherwise, or that holds an added token such as
"<|endoftext|>", is encoded whole by the library, as it is set by default: the
added token gets its own id.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import islice
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidemark.llm.common import cache_of, release_memory

# Words a worker keeps, about 150 bytes each.
CACHED_WORDS = 300_000
# Texts whose words are looked up together.
TEXTS_AT_ONCE = 512
CHARS_AT_ONCE = 4_000_000
# New words encoded as one text, where ids show the end of a word; where they show its bytes, no end is in doubt.
WORDS_AT_ONCE = 128
SURE_WORDS_AT_ONCE = 1024

_ASCII_ODD = ["\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f"]
_OTHER_SPACES = ["\x85", "\xa0", " ", "᠎", " ", " ", " ", " ", "　"] + [
    chr(c) for c in range(0x2000, 0x200C)
]
# The character that a byte-level vocabulary shows each byte as; the line end, which parts the words, is left as it is.
_SHOWN = np.arange(256, dtype="<u4")
_SHOWN[[*range(33), *range(127, 161), 173]] = np.arange(256, 324)
_SHOWN[10] = 10
# A comma or full stop that does not follow a letter or digit.
_MARK_ELSEWHERE = re.compile("[,.](?<![0-9A-Za-zÀ-ÖØ-öø-ɏ][,.])")


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes.

    ``name``: a file of the vocabulary folder, or a path.  ``spaced``: white space
    belongs to the words (byte-level BPE); otherwise it only separates them.
    """

    def __init__(self, name: str, spaced: bool):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        if "/" not in name:
            import public_tokenizers

            name = public_tokenizers.path(name)
        self._library = Tokenizer.from_file(name)
        self._spaced = spaced
        self._cache: dict[str, bytes] = {"": b""}
        self._ends = None if spaced else self._word_ends()
        self._lengths = self._byte_lengths() if spaced else None
        if self._lengths is not None:
            # The same model on words shown as it knows them: a word of letters is one piece anyway.
            self._by_space = Tokenizer(self._library.model)
            self._by_space.pre_tokenizer = WhitespaceSplit()
        doubled = ["  ", " \n", "\n ", "\n\n", "\0"] if spaced else []
        added = [t.content for t in self._library.get_added_tokens_decoder().values()]
        self._odd = doubled + _ASCII_ODD[0 if spaced else 4:] + _OTHER_SPACES + added

    def _word_ends(self) -> np.ndarray | None:
        """Per id whether it ends a word, if the vocabulary marks that by a suffix."""
        suffix = getattr(self._library.model, "end_of_word_suffix", None)
        if not suffix:
            return None
        vocabulary = self._library.get_vocab()
        ends = np.zeros(max(vocabulary.values()) + 1, bool)
        ends[[n for token, n in vocabulary.items() if token.endswith(suffix)]] = True
        return ends

    def _byte_lengths(self) -> np.ndarray | None:
        """Per id the bytes of text it stands for, if the vocabulary shows each byte as one character."""
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import ByteLevel

        cut, model = self._library.pre_tokenizer, self._library.model
        if (self._library.normalizer is not None or not isinstance(cut, ByteLevel) or cut.add_prefix_space
                or not cut.use_regex or not isinstance(model, BPE) or model.continuing_subword_prefix or model.end_of_word_suffix):
            return None
        vocabulary = self._library.get_vocab()
        lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        lengths[list(vocabulary.values())] = [len(token) for token in vocabulary]
        return lengths

    def whole(self, text: str) -> bytes:
        """The ids as the library gives them for the whole text."""
        return array("I", self._library.encode(text, add_special_tokens=False).ids).tobytes()

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; a null text has none."""
        found: list[bytes] = []
        for part in self._few(texts):
            by_words = [t is not None and not self._is_odd(t) for t in part]
            bodies = iter(self._from_words([t for t, own in zip(part, by_words) if own]))
            found += [next(bodies) if own else self.whole(t) if t else b"" for t, own in zip(part, by_words)]
        return found

    def _few(self, texts: list[str | None]) -> Iterator[list[str | None]]:
        """The texts in parts bounded in number and, but for one longer text, in characters."""
        start = chars = 0
        for k, text in enumerate(texts):
            chars += len(text or "")
            if k > start and (chars > CHARS_AT_ONCE or k - start == TEXTS_AT_ONCE):
                yield texts[start:k]
                start, chars = k, len(text or "")
        yield texts[start:]

    def _from_words(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, put together from those of its words; each distinct word is looked up once."""
        words = self._words(texts)
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = list(map(self._cache.get, distinct))
        new = [k for k, ids in enumerate(known) if ids is None]
        self._learn({distinct[k] for k in new})
        for k in new:
            known[k] = self._cache[distinct[k]]
        # The distinct words' ids lie end to end; a text's are copied from there, word by word.
        ids = np.frombuffer(b"".join(known), "<u4")
        counts = np.fromiter(map(len, known), np.int64, len(known)) // 4
        firsts = np.cumsum(counts) - counts
        codes = coded.indices.to_numpy()
        own = counts[codes]
        ends = np.concatenate([[0], np.cumsum(own)])
        body = ids[np.repeat(firsts[codes] - ends[:-1], own) + np.arange(ends[-1])].tobytes()
        cuts = (4 * ends[words.offsets.to_numpy()]).tolist()
        return [body[start:end] for start, end in zip(cuts, cuts[1:])]

    def _is_odd(self, text: str) -> bool:
        return any(s in text for s in self._odd)

    def _words(self, texts: list[str]) -> pa.ListArray:
        """Each text's words; empty ones among them stand for nothing."""
        if not self._spaced:
            return pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        return pc.split_pattern(pa.array(map(self._parted, texts), pa.large_string()), "\0")

    def _parted(self, text: str) -> str:
        # Every white space is alone here: a space belongs to the word behind it,
        # a line end is a word of its own.
        text = text.replace("\n", "\0\n\0").replace(" ", "\0 ")
        # A mark behind a letter or digit begins another piece, whatever follows it.
        return text if _MARK_ELSEWHERE.search(text) else text.replace(",", "\0,").replace(".", "\0.")

    def _learn(self, words: set[str]) -> None:
        """Add words to the cache.  All of them are needed at once, so old ones go first."""
        if len(self._cache) > CACHED_WORDS:
            # The words met first are the frequent ones.
            self._cache = dict(islice(self._cache.items(), CACHED_WORDS // 2))
        cache = self._cache
        letters = self._of_letters(words)
        ask = words.difference(letters)
        # "word," is "word" and ",": letters and marks never merge.  Every Unicode version knows the letters up to here.
        marked = {}
        for w in ask:
            stem = w.rstrip(punctuation)
            # Lower-cased, "İ" ends in a dot of its own, which merges with marks.
            if len(stem) < len(w) and stem and stem[-1] < "\u0500" and stem[-1].lower().isalpha():
                marked[w] = stem, w[len(stem):]
        ask.difference_update(marked)
        parts = {part for both in marked.values() for part in both if part not in cache} - words
        stems = self._of_letters(parts)
        ask.update(parts.difference(stems), self._learn_together(letters + stems))
        ask = list(ask)
        for word, found in zip(ask, self._library.encode_batch_fast(ask, add_special_tokens=False)):
            cache[word] = array("I", found.ids).tobytes()
        for w, (stem, marks) in marked.items():
            cache[w] = cache[stem] + cache[marks]

    def _of_letters(self, words: set[str]) -> list[str]:
        """Those of letters only, if many of them can be encoded as one text; a space may stand before them."""
        if self._lengths is not None:
            return [w for w in words if w.lstrip(" ").isalpha() and (w.isascii() or max(w) < "\u0500")]
        return [w for w in words if w.isalpha()] if self._ends is not None else []

    def _learn_together(self, words: list[str]) -> list[str]:
        """Add words of letters only, many encoded as one text; returns those that have to be encoded one by one."""
        learn, n = (self._by_ends, WORDS_AT_ONCE) if self._lengths is None else (self._by_lengths, SURE_WORDS_AT_ONCE)
        return learn([words[at:at + n] for at in range(0, len(words), n)])

    def _by_lengths(self, parts: list[list[str]]) -> list[str]:
        """Such a word is one piece for the vocabulary.  Its ids are those whose bytes make up its own."""
        left = []
        raw = [np.frombuffer("\n".join(part).encode(), "u1") for part in parts]
        texts = [_SHOWN[own].tobytes().decode("utf-32-le") for own in raw]
        for part, own, found in zip(parts, raw, self._by_space.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(found.ids, "<u4")
            ends = np.append(np.flatnonzero(own == 10), len(own)) - np.arange(len(part))
            reached = np.cumsum(self._lengths[ids])
            last = np.searchsorted(reached, ends)
            if not len(ids) or last[-1] != len(ids) - 1 or (reached[last] != ends).any():
                left += part
                continue
            cuts = [0, *(4 * (last + 1)).tolist()]
            self._cache.update(zip(part, map(ids.tobytes().__getitem__, map(slice, cuts, cuts[1:]))))
        return left

    def _by_ends(self, parts: list[list[str]]) -> list[str]:
        """Each such word has one end at least.  If there are as many ends as words, each has just one: its last id."""
        left = []
        texts = [" ".join(part) for part in parts]
        for part, found in zip(parts, self._library.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(found.ids, "<u4")
            cuts = (4 * (np.flatnonzero(self._ends[ids]) + 1)).tolist()
            if len(cuts) != len(part):
                left += part
                continue
            body, start = ids.tobytes(), 0
            for word, end in zip(part, cuts):
                self._cache[word] = body[start:end]
                start = end
        return left


def encoder(name: str, spaced: bool) -> Encoder:
    """One encoder, and one cache, per Python worker, until tasks of other modules need its memory."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    known = cache_of("tokens")
    if (name, spaced) not in known:
        release_memory("tokens")
        known[name, spaced] = Encoder(name, spaced)
    return known[name, spaced]
