"""Token ids of whole texts from a tokenizers file, word by word.

The vocabulary drops white space and never merges across it, so a text's ids are those of its words one after another.
Each distinct word of a slice is looked up in a cache, and the library encodes those that are new, many at a time.  The
cache keeps the half that is met most often when it passes CACHE_WORDS words, and goes with the task, so a worker's
memory is bounded.  `splits_at_space` checks the
property on a file's settings; other files are encoded text by text.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import kernels

END = 1
CACHE_WORDS = 250_000
SLICE = 4 << 20
_STOPS = np.zeros(256, dtype=bool)
_STOPS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_PLAIN = np.zeros(256, dtype=bool)
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def splits_at_space(settings: dict) -> bool:
    """Whether words parted by ASCII white space are encoded on their own: the pre-tokenizer removes what its pattern
    doesn't match, the pattern can't match white space, and no step looks at a neighbouring word."""
    steps = settings.get("pre_tokenizer") or {}
    steps = steps.get("pretokenizers", [steps])
    cut = [s for s in steps if s.get("type") == "Split"]
    plain = all(s.get("type") in ("Split", "ByteLevel") and not s.get("add_prefix_space") and not s.get("use_regex") for s in steps)
    return bool(plain and len(cut) == 1 and cut[0].get("behavior") == "Removed" and cut[0].get("invert") and "[^\\s" in cut[0].get("pattern", {}).get("Regex", "")) and not any(
        t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in settings.get("added_tokens", [])
    )


class WordCoder:
    """Encodes slices of texts; one for each Python worker and file."""

    _made: dict[str, WordCoder] = {}

    @classmethod
    def get(cls, path: str) -> WordCoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    @classmethod
    def release(cls) -> None:
        """Drops the caches at a task's end: an idle worker keeps nothing while other stages need its memory."""
        cls._made.clear()
        kernels.release()

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        self.by_word = splits_at_space(settings)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        # Which ids end a piece, if the vocabulary marks them.
        mark = settings.get("model", {}).get("end_of_word_suffix")
        self.ends = None
        if mark and not settings["model"].get("unk_token"):
            self.ends = np.zeros(self.size, dtype=bool)
            self.ends[[i for piece, i in settings["model"]["vocab"].items() if piece.endswith(mark)]] = True
        self.type = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self._clear()

    def _clear(self) -> None:
        self.known = pa.array([], pa.string())
        self.starts = np.zeros(1 << 16, dtype=np.int64)
        self.sizes = np.zeros(1 << 16, dtype=np.int64)
        self.hits = np.zeros(1 << 16, dtype=np.int64)
        self.pool = np.zeros(1 << 18, dtype=self.type)
        self.used = 0

    def _evict(self) -> None:
        """Keeps the half of the cache that was met most often."""
        n = len(self.known)
        keep = np.sort(np.argsort(-self.hits[:n], kind="stable")[: CACHE_WORDS // 2])
        words = self.known.take(pa.array(keep))
        sizes, hits, pool = self.sizes[keep], self.hits[keep], self.pool
        place = np.repeat(self.starts[keep] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        self._clear()
        self._store(words, pool[place], sizes)
        self.hits[: len(words)] = hits // 2

    def encode_words(self, array: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """All words' ids one after another, and how many each has.

        Many words go to the library in one text.  A word of small Latin letters only, which no step changes, is one piece to the
        pre-tokenizer, so its last id is the only one that ends a piece; for others, the tokens' places in the text tell whose they are.
        """
        words = array.to_pylist()
        plain = pc.match_substring_regex(array, "^[a-zß-öø-ÿ]+$").to_numpy(zero_copy_only=False) if self.ends is not None else np.zeros(len(words), bool)
        sizes = np.zeros(len(words), dtype=np.int64)
        at = np.flatnonzero(plain)
        easy = [words[i] for i in at] if len(at) < len(words) else words
        each = self.tokenizer.encode_batch_fast([" ".join(easy[k : k + 256]) for k in range(0, len(easy), 256)], add_special_tokens=False) if easy else []
        flat = np.concatenate([np.array(e.ids, dtype=self.type) for e in each]) if each else np.zeros(0, self.type)
        if len(at):
            sizes[at] = np.diff(np.flatnonzero(self.ends[flat]), prepend=-1)
        if len(at) == len(words):
            return flat, sizes
        rest = np.flatnonzero(~plain)
        other, owners = [], []
        parts = [[words[i] for i in rest[k : k + 256]] for k in range(0, len(rest), 256)]
        for k, (part, e) in enumerate(zip(parts, self.tokenizer.encode_batch([" ".join(p) for p in parts], add_special_tokens=False), strict=True)):
            other += e.ids
            starts = np.cumsum([0, *(len(w) + 1 for w in part[:-1])])
            owners.append(256 * k + np.searchsorted(starts, [o[0] for o in e.offsets], "right") - 1)
        sizes[rest] = np.bincount(np.concatenate(owners).astype(np.int64), minlength=len(rest))
        out = np.empty(sizes.sum(), dtype=self.type)
        ours = np.repeat(plain, sizes)
        out[ours], out[~ours] = flat, np.array(other, dtype=self.type)
        return out, sizes

    def _store(self, words: pa.StringArray, flat: np.ndarray, sizes: np.ndarray) -> None:
        first, n = len(self.known), len(words)
        self.known = pa.concat_arrays([self.known, words])
        while first + n > len(self.starts):
            self.starts, self.sizes, self.hits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes, self.hits))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        self.sizes[first : first + n] = sizes
        self.starts[first : first + n] = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)

    def lookup(self, distinct: pa.StringArray, times: np.ndarray) -> np.ndarray:
        """Where the cache holds each word; times: how often each is met."""
        if len(self.known) > CACHE_WORDS:
            self._evict()
        found = pc.index_in(distinct, value_set=self.known)
        code = found.fill_null(-1).to_numpy().astype(np.int64)
        unknown = np.flatnonzero(code < 0)
        if len(unknown):
            first = len(self.known)
            new = distinct.take(pa.array(unknown))
            self._store(new, *self.encode_words(new))
            code[unknown] = np.arange(first, first + len(new))
        self.hits[code] += times
        return code

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The words of a slice as a dictionary array, and the rows' borders in it.

        To have fewer distinct ones, ASCII signs after an ASCII letter or digit are words of their own, as the pre-tokenizer
        parts them anyhow, and capitals that no combining mark can follow are small already, as the normalizer makes
        them.  Slices that may hold an added token's text are left as they are.
        """
        starts, ends, _ = kernels.words(data, offsets)
        if b"<|" not in data.tobytes() and len(starts):
            big = np.flatnonzero((data >= 65) & (data <= 90))
            follow = data[np.minimum(big + 1, len(data) - 1)]
            data = data.copy()
            data[big[(follow < 128) | (big + 1 == len(data))]] += 32
            stopped = np.flatnonzero(_STOPS[data[ends - 1]])
            last, low = ends[stopped] - 1, starts[stopped]
            back = np.flatnonzero(last > low)
            while len(back):  # to the last byte that is no stop
                last[back] -= 1
                back = back[_STOPS[data[last[back]]] & (last[back] > low[back])]
            starts = np.sort(np.concatenate([starts, last[_PLAIN[data[last]] & ~_STOPS[data[last]]] + 1]))
        solid = ~kernels.SPACE[data]
        place = np.concatenate([[0], np.cumsum(solid)])
        border = np.append(place[starts], place[-1]).astype(np.int32)
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(border), pa.py_buffer(data[solid])).dictionary_encode()
        return words, np.searchsorted(starts, offsets)

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a slice's rows one after another, and the rows' borders in them."""
        if not self.by_word:
            raw = data.tobytes()
            each = [e.ids for e in self.tokenizer.encode_batch([raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], add_special_tokens=False)]
            return np.array([i for x in each for i in x], dtype=self.type), np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
        words, rows = self.words(data, offsets)
        code = self.lookup(words.dictionary, np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary)))
        sizes = self.sizes[code]
        border = np.zeros(len(code) + 1, dtype=np.int32)
        np.cumsum(sizes, out=border[1:])
        place = np.repeat(self.starts[code] - border[:-1], sizes) + np.arange(border[-1])
        taken = pa.ListArray.from_arrays(pa.array(border), pa.array(self.pool[place])).take(words.indices)
        return taken.flatten().to_numpy(), taken.offsets.to_numpy()[rows].astype(np.int64) if len(taken) else np.zeros(len(offsets), np.int64)


def encoded(path: str, batch: pa.RecordBatch, column: str = "text"):
    """For slices of a batch: first row, ids with END after each row, and the rows' borders in them."""
    coder = WordCoder.get(path)
    for row, data, offsets in kernels.slices(batch.column(column), SLICE):
        ids, border = coder.ids(data, offsets)
        out = np.insert(ids, border[1:], END)
        yield row, out, border + np.arange(len(border))
