"""Token ids of texts by a public tokenizer file, each distinct word encoded once per worker.

The word tokenizer drops white space and none of its rules reaches across a space, so the ids of a text are those of its
space-delimited chunks in a row.  A chunk of Latin letters with ASCII marks behind them is two pre-tokens, a lower-cased word and
the marks; a word goes to the tokenizer's model directly, any other chunk through the whole tokenizer.  Ids of words
and chunks are kept in a bounded per-worker store and put together by array work.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

DEFAULT_TOKENIZER = "word_bpe_49k.json"
KNOWN_UNITS = 1_000_000

#: Letters whose lower case and composition are plain, and marks that neither begin a contraction nor a special token.
_PLAIN = r"^(?P<word>[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+)(?P<marks>[!-&(-/:;=-@\[-`{-~]*)$"


def byte_symbols() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {**{b: chr(b) for b in kept}, **{b: chr(256 + k) for k, b in enumerate(rest)}}


class ChunkEncoder:
    """Encodes Arrow string arrays; one per Python worker and tokenizer file."""

    _made: dict[str, "ChunkEncoder"] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.symbols = byte_symbols()
        self._forget()

    @classmethod
    def of(cls, name: str) -> "ChunkEncoder":
        if name not in cls._made:
            import public_tokenizers
            cls._made[name] = cls(name if os.sep in name else public_tokenizers.path(name))
        return cls._made[name]

    def _forget(self) -> None:
        """Unit 0 is the empty run."""
        self.words: dict[str, int] = {}
        self.chunks: dict[str, int] = {"": 0}
        self.size, self.ids, self.n_ids, self.n = np.zeros(1024, np.int32), np.zeros(1 << 16, np.uint32), 0, 1
        self.start = np.zeros(1024, np.int64)

    def _add(self, runs: list[list[int]]) -> range:
        """New units; their numbers."""
        sizes = np.fromiter(map(len, runs), np.int64, len(runs))
        flat = np.fromiter((x for r in runs for x in r), np.uint32, int(sizes.sum()))
        while self.n + len(runs) > len(self.size):
            self.size, self.start = np.append(self.size, np.zeros_like(self.size)), np.append(self.start, np.zeros_like(self.start))
        while self.n_ids + len(flat) > len(self.ids):
            self.ids = np.append(self.ids, np.zeros_like(self.ids))
        own = range(self.n, self.n + len(runs))
        self.size[own.start:own.stop] = sizes
        self.start[own.start:own.stop] = self.n_ids + np.cumsum(sizes) - sizes
        self.ids[self.n_ids:self.n_ids + len(flat)] = flat
        self.n, self.n_ids = own.stop, self.n_ids + len(flat)
        return own

    def _word(self, word: str) -> list[int]:
        if not word.isascii():
            word = "".join([self.symbols[b] for b in word.encode()])
        return [t.id for t in self.model.tokenize(word)]

    def _units(self, strings: list[str], known: dict[str, int], encode) -> np.ndarray:
        new = [s for s in strings if s not in known]
        if new:
            known.update(zip(new, self._add(encode(new))))
        return np.fromiter((known[s] for s in strings), np.int64, len(strings))

    def _whole(self, strings: list[str]) -> list[list[int]]:
        return [e.ids for lo in range(0, len(strings), 4096)
                for e in self.tokenizer.encode_batch_fast(strings[lo:lo + 4096], add_special_tokens=False)]

    def _of_chunks(self, chunks: pa.Array) -> np.ndarray:
        """(chunks, 2) units of distinct chunks."""
        out = np.zeros((len(chunks), 2), np.int64)
        both = pc.extract_regex(chunks, _PLAIN)
        plain = np.asarray(pc.is_valid(both))
        part = both.drop_null()
        for column, name, known, encode in ((0, "word", self.words, lambda x: [self._word(w) for w in x]), (1, "marks", self.chunks, self._whole)):
            field = pc.struct_field(part, name)
            coded = pc.dictionary_encode(pc.utf8_lower(field) if name == "word" else field)
            units = self._units(coded.dictionary.to_pylist(), known, encode)
            out[plain, column] = units[np.asarray(coded.indices)] if len(units) else 0
        rest = np.flatnonzero(~plain)
        out[rest, 0] = self._units(chunks.take(pa.array(rest)).to_pylist(), self.chunks, self._whole)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row as uint32, offsets with one entry more than texts); null counts as empty."""
        if self.n > KNOWN_UNITS:
            self._forget()
        texts = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), "\n", " ")
        parts = pc.split_pattern(texts, " ")
        bounds = np.asarray(parts.offsets)
        coded = pc.dictionary_encode(parts.flatten())
        if not len(coded):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        units = self._of_chunks(coded.dictionary)[np.asarray(coded.indices)].reshape(-1)
        n = self.size[units].astype(np.int64)
        at = np.concatenate(([0], np.cumsum(n)))
        where = np.repeat(self.start[units] - at[:-1], n) + np.arange(at[-1])
        return self.ids[where], at[2 * (bounds - bounds[0])]


def whole(texts: pa.Array) -> pa.Array:
    """The texts as an array of its own, no slice (which some ASCII kernels misread), null as empty."""
    return pc.fill_null(texts.cast(pa.large_string()), "").take(pa.array(np.arange(len(texts))))


def text_groups(texts: pa.Array, most: int = 8_000_000):
    """Slices (lo, hi) of a batch with at most ``most`` bytes of text, or one text."""
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    lo, total = 0, 0
    for i, n in enumerate(size):
        if i > lo and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += int(n)
    if len(size) > lo:
        yield lo, len(size)
