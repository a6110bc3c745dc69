"""Subword ids of whole texts through the tokenizers library, each distinct word encoded once."""

from __future__ import annotations

import os
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from couponloom.llm.text import ragged

# Fixed value: the pre-tokenizer's pattern.
_PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: Words in which the pattern finds the same in any library, whatever the normalizer does.
_USUAL = r"^[\x21-\x7E\x{C0}-\x{12F}\x{131}-\x{24F}]+$"
#: Punctuation after a letter is a pre-token of its own, so a word and the mark after it part here.
_MARK = r"([A-Za-z])([.,;:!?]+)([\x20\x09-\x0D]|$)"
#: Words in one call of the library.
_AT_ONCE = 5000


class WordEncoder:
    """Encodes texts by a lower-casing tokenizer with word ends that never joins words over white space.

    Texts are split at ASCII white space, and the distinct words are encoded by the library,
    once each while they are remembered. Beyond `memory` words only those of the texts at hand
    stay remembered, so frequent words are not learned anew. Unicode white
    space stays inside a word and is the library's to split. New words of usual letters go
    to the library many in one text; the ids that end a pre-token show where each word stops.
    All other words go one by one.
    """

    def __init__(self, path: str, memory: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        vocabulary = self._tokenizer.get_vocab()
        self._ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self._ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        #: Ids are below this.
        self.vocabulary = len(self._ends)
        self._memory = memory
        self._codes: dict[bytes, int] = {b"": 0}
        self._ids = np.zeros(0, dtype=np.uint32)
        self._starts, self._lengths = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)

    def _keep(self, names: list[bytes], codes: np.ndarray) -> np.ndarray:
        """Forget all words but these; their new codes. Words without a code stay without one."""
        held = np.flatnonzero(codes > 0)
        own, lengths = codes[held], self._lengths[codes[held]]
        self._ids = self._ids[ragged(self._starts[own], lengths)]
        self._starts = np.concatenate([[0], np.cumsum(lengths) - lengths])
        self._lengths = np.concatenate([[0], lengths])
        kept = codes.copy()
        kept[held] = 1 + np.arange(len(held))
        self._codes = {b"": 0, **{names[i]: k for k, i in enumerate(held.tolist(), 1)}}
        return kept

    def _usual(self, words: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of words of usual letters, all after each other, and their number for each word."""
        expected = pc.count_substring_regex(words, _PRE_TOKENS).to_numpy(zero_copy_only=False).astype(np.int64)
        ids, lengths = [], []
        text = words.to_pylist()
        for at in range(0, len(text), _AT_ONCE):
            part = slice(at, at + _AT_ONCE)
            found = self._tokenizer.encode_batch_fast([" ".join(text[part])], add_special_tokens=False)[0]
            own = np.array(found.ids, dtype=np.uint32)
            ends = np.flatnonzero(self._ends[own]) + 1
            last = np.cumsum(expected[part])
            if not len(ends) or last[-1] != len(ends) or ends[-1] != len(own):
                raise ValueError("the tokenizer does not end its pre-tokens as expected")
            ids.append(own)
            lengths.append(np.diff(ends[last - 1], prepend=0))
        return ids, lengths

    def _learn(self, words: pa.Array) -> np.ndarray:
        """Remember new words; their codes."""
        usual = pc.and_not(pc.match_substring_regex(words, _USUAL), pc.match_substring(words, "<|"))
        easy, hard = words.filter(usual), words.filter(pc.invert(usual)).to_pylist()
        ids, lengths = self._usual(easy)
        for at in range(0, len(hard), 500):
            for found in self._tokenizer.encode_batch_fast(hard[at : at + 500], add_special_tokens=False):
                ids.append(np.array(found.ids, dtype=np.uint32))
                lengths.append(np.array([len(found.ids)]))
        added = np.concatenate([np.zeros(0, np.int64), *lengths])
        first = len(self._codes)
        codes, easier = np.empty(len(words), np.int64), usual.to_numpy(zero_copy_only=False)
        codes[easier] = first + np.arange(len(easy))
        codes[~easier] = first + len(easy) + np.arange(len(hard))
        names = easy.cast(pa.binary()).to_pylist() + [w.encode() for w in hard]
        self._codes.update(zip(names, range(first, first + len(names)), strict=True))
        self._starts = np.concatenate([self._starts, len(self._ids) + np.cumsum(added) - added])
        self._lengths = np.concatenate([self._lengths, added])
        self._ids = np.concatenate([self._ids, *ids]).astype(np.uint32)
        return codes

    def _known(self, names: list[bytes]) -> np.ndarray:
        get = self._codes.get
        return np.fromiter((get(w, -1) for w in names), dtype=np.int64, count=len(names))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of ids of each text."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        # The tokenizer lower-cases all but the strings of its special tokens.
        given = pa.array(texts, pa.binary()).cast(pa.string())
        special = pc.match_substring(given, "<|")
        folded = pc.if_else(special, given, pc.ascii_lower(given)) if pc.any(special).as_py() else pc.ascii_lower(given)
        lists = pc.ascii_split_whitespace(pc.replace_substring_regex(folded, pattern=_MARK, replacement=r"\1 \2\3"))
        coded = lists.flatten().dictionary_encode()
        names = coded.dictionary.cast(pa.binary()).to_pylist()
        codes = self._known(names)
        new = codes < 0
        if new.any():
            if len(self._codes) + int(new.sum()) > self._memory:
                codes = self._keep(names, codes)
            codes[new] = self._learn(coded.dictionary.filter(pa.array(new)))
        own = codes[coded.indices.to_numpy(zero_copy_only=False)]
        lengths = self._lengths[own]
        ids = self._ids[ragged(self._starts[own], lengths)]
        after = np.concatenate([[0], np.cumsum(lengths)])[lists.offsets.to_numpy()]
        return ids, np.diff(after)


@cache
def word_encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker."""
    return WordEncoder(path)
