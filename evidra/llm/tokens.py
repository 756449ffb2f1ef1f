"""Vectorised encoding of whole texts with the tokenizers library.

The word-level vocabulary drops white space, so no token spans two words and the
ids of a text are those of its words in order. Distinct words of a batch are
encoded once and their ids laid out for every occurrence with numpy.
"""

from __future__ import annotations

import functools
import itertools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes of a batch, and of one that is encoded: bounds a task's memory whatever a batch holds.
BATCH_BYTES, ENCODED_BYTES = 24 << 20, 3 << 20
#: Words whose ids a worker remembers (about 50 bytes each); beyond it only those of the last batch stay.
REMEMBERED = 250_000
#: Lower-case letters of the Latin alphabet and of western Europe, each one code point.
LETTERS = "".join(map(chr, [*range(ord("a"), ord("z") + 1), *range(0xDF, 0xF7), *range(0xF8, 0x100)]))
#: Stands between words encoded in one call. Its byte occurs in no other character, so its id splits the ids again.
MARK = "\x01"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that their texts stay below limit bytes (one text at least).

    Arrow's memory that the last one freed goes back to the machine before the next.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes, dtype=np.int64), 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            pa.default_memory_pool().release_unused()
            at = to


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets per text (n + 1) and the words between ASCII white space; null has none."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    split = pc.ascii_split_whitespace(texts)
    offsets, words = split.offsets.to_numpy().astype(np.int64), split.flatten()
    offsets -= offsets[0]
    full = pc.greater(pc.binary_length(words), 0)
    if not pc.all(full, min_count=0).as_py():
        before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)])
        offsets, words = before[offsets], words.filter(full)
    return offsets, words


class WordEncoder:
    """ids(texts) gives flat uint32 ids and the offsets of each text in them.

    The ids of a word are kept beside it in Arrow and numpy arrays, so a batch
    looks all its distinct words up at once and only new ones become Python strings.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.mark = self._plain(MARK)
        # Letters that normalising leaves as they are; a word of such letters alone is one part for the model.
        self.letters = {ord(c): self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in LETTERS}
        self.known = pa.array([], pa.large_string())
        self.flat, self.starts, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and lengths of words, many to a call."""
        parts, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(words), 4096):
            [found] = self.tokenizer.encode_batch_fast([f" {MARK} ".join([*words[at : at + 4096], ""])], add_special_tokens=False)
            ids = np.array(found.ids, np.uint32)
            ends = np.flatnonzero(ids == self.mark[0])
            lengths.append(np.diff(ends, prepend=-1) - 1)
            parts.append(np.delete(ids, ends))
        return np.concatenate(parts), np.concatenate(lengths)

    def _singly(self, words: list[str], encoded) -> tuple[np.ndarray, np.ndarray]:
        found = [encoded(w) for w in words]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths

    def _learn(self, words: pa.Array) -> None:
        odd = pc.or_(pc.match_substring(words, MARK), pc.match_substring(words, "<|")).to_numpy(zero_copy_only=False) | (len(self.mark) != 1)
        plain = pc.match_substring_regex(words, f"^[{LETTERS}]+$").to_numpy(zero_copy_only=False) & ~odd
        tokenize, letters = self.tokenizer.model.tokenize, self.letters
        for chosen, encode in ((plain, lambda w: self._singly(w, lambda x: [t.id for t in tokenize(x if x.isascii() else x.translate(letters))])), (~plain & ~odd, self._together), (odd, lambda w: self._singly(w, self._plain))):
            own = words.filter(pa.array(chosen))
            ids, lengths = encode(own.to_pylist())
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
            self.flat, self.lengths = np.concatenate([self.flat, ids]), np.concatenate([self.lengths, lengths])
            self.known = pa.concat_arrays([self.known, own])

    def _keep(self, at: np.ndarray) -> np.ndarray:
        """Forget all words but those at these places; their new places."""
        lengths = self.lengths[at]
        starts = np.cumsum(lengths) - lengths
        self.flat = self.flat[np.repeat(self.starts[at] - starts, lengths) + np.arange(lengths.sum())]
        self.known, self.starts, self.lengths = self.known.take(pa.array(at)), starts, lengths
        return np.arange(len(at))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        # A token never spans a letter and the punctuation after it; parting them leaves fewer distinct words.
        offsets, words = words_of(pc.replace_substring_regex(texts, r"([A-Za-z])([.,;:!?#*$%&])", r"\1 \2"))
        # The vocabulary is lower-case; folding A-Z first only merges words. Words that may hold a special token stay as they are.
        words = pc.if_else(pc.match_substring(words, "<|"), words, pc.ascii_lower(words))
        coded = words.dictionary_encode()
        at = pc.index_in(coded.dictionary, value_set=self.known)
        if at.null_count:
            self._learn(coded.dictionary.filter(pc.is_null(at)))
            at = pc.index_in(coded.dictionary, value_set=self.known)
        at = at.to_numpy(zero_copy_only=False).astype(np.int64)
        if len(self.known) > REMEMBERED:
            at = self._keep(at)
        at = at[coded.indices.to_numpy()]
        lengths = self.lengths[at]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.flat[np.repeat(self.starts[at] - ends[:-1], lengths) + np.arange(ends[-1])]
        return ids, ends[offsets]


def vocabulary_size(vocabulary: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary).get_vocab_size()


@functools.lru_cache(maxsize=1)
def encoder_of(vocabulary: str) -> WordEncoder:
    """The process's encoder: a worker's later tasks start with the words of earlier ones."""
    return WordEncoder(vocabulary)


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's ids followed by end_id."""
    out = np.insert(ids, offsets[1:], np.uint32(end_id))
    return out, offsets + np.arange(len(offsets))
