"""BPE encoding and decoding through a minimal acyclic transducer of frequent words.

The words of the whole corpus are counted, and the most frequent ones, at most WORDS, become a minimal acyclic automaton, built in one
sorted pass that shares suffixes (Daciuk, Mihov, Watson, Watson 2000).  Its arcs carry numbers that add up to the word's
rank along its path (Lucchesi and Kowaltowski 1993), and the rank finds the word's ids and its decoded form in two
flat tables.  Everything is one file of arrays that workers map into memory; its size is bounded by WORDS.

A slice's distinct words walk through the automaton together, a byte at a time.  Words that leave it are merged by the
library's own BPE, so the ids are exact for any text; they are kept in a bounded cache.

A null or empty text has no ids and decodes to an empty text.  Repeated rows each get a row, null doc_ids are kept, other
columns are ignored.  An empty table gives an empty lexicon, and then every word is merged.
"""

from __future__ import annotations

import hashlib
import mmap
import os
import tempfile
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels, tokens
from .common import documents, id_text, stage

#: Words of the lexicon: a bound on what the driver builds and sends.
WORDS = 1 << 16
#: Words that a task counts before it passes its counts on.
COUNTED = 400_000
_ARRAYS = ("arc_key", "arc_target", "arc_number", "final", "id_start", "ids", "spelling_start", "spelling")


class Transducer:
    """arc_key: state * 256 + byte, sorted; arc_target, arc_number: by arc; final: by state; the rest by rank."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        for name in _ARRAYS:
            setattr(self, name, arrays[name])

    @classmethod
    def build(cls, entries: list[tuple[bytes, list[int], str]]) -> Transducer:
        """entries: distinct words with their ids and decoded forms, sorted by word."""
        arcs: list[dict[int, int]] = [{}]
        final = [False]
        register: dict[tuple, int] = {}
        path: list[tuple[int, int]] = []  # (state, byte) along the last word

        def close(depth: int) -> None:
            """Replaces the states of the last word below depth by equal ones that are registered."""
            while len(path) > depth:
                state, byte = path.pop()
                child = arcs[state][byte]
                form = (final[child], tuple(sorted(arcs[child].items())))
                arcs[state][byte] = register.setdefault(form, child)

        last = b""
        for word, _, _ in entries:
            common = len(os.path.commonprefix([last, word]))
            close(common)
            state = arcs[path[-1][0]][path[-1][1]] if path else 0
            for byte in word[common:]:
                arcs.append({})
                final.append(False)
                arcs[state][byte] = len(arcs) - 1
                path.append((state, byte))
                state = len(arcs) - 1
            final[state] = True
            last = word
        close(0)

        number = {0: 0}
        order = [0]
        for state in order:  # grows while states are found
            for _, child in sorted(arcs[state].items()):
                if child not in number:
                    number[child] = len(order)
                    order.append(child)
        below: dict[int, int] = {}

        def words_below(start: int) -> int:
            stack = [start]
            while stack:
                state = stack[-1]
                open_ = [c for c in arcs[state].values() if c not in below]
                if open_:
                    stack += open_
                else:
                    below[state] = final[state] + sum(below[c] for c in arcs[state].values())
                    stack.pop()
            return below[start]

        words_below(0)
        key, target, rank = [], [], []
        for i, state in enumerate(order):
            before = int(final[state])
            for byte, child in sorted(arcs[state].items()):
                key.append(i * 256 + byte)
                target.append(number[child])
                rank.append(before)
                before += below[child]
        spellings = [s.encode() for _, _, s in entries]
        return cls(
            {
                "arc_key": np.array(key, dtype=np.int64),
                "arc_target": np.array(target, dtype=np.int64),
                "arc_number": np.array(rank, dtype=np.int64),
                "final": np.array([final[s] for s in order], dtype=np.uint8),
                "id_start": np.cumsum([0, *(len(i) for _, i, _ in entries)], dtype=np.int64),
                "ids": np.array([i for _, ids, _ in entries for i in ids], dtype=np.int64),
                "spelling_start": np.cumsum([0, *(len(s) for s in spellings)], dtype=np.int64),
                "spelling": np.frombuffer(b"".join(spellings), dtype=np.uint8),
            }
        )

    def to_bytes(self) -> bytes:
        """The sizes of the arrays in bytes, then the arrays, each from a multiple of eight."""
        parts = [np.ascontiguousarray(getattr(self, name)).tobytes() for name in _ARRAYS]
        head = np.array([len(p) for p in parts], dtype=np.int64).tobytes()
        return head + b"".join(p + b"\0" * (-len(p) % 8) for p in parts)

    @classmethod
    def map(cls, path: str) -> Transducer:
        with open(path, "rb") as f:
            data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        sizes = np.frombuffer(data, dtype=np.int64, count=len(_ARRAYS))
        arrays, at = {}, 8 * len(_ARRAYS)
        for name, size in zip(_ARRAYS, sizes, strict=True):
            kind = np.uint8 if name in ("final", "spelling") else np.int64
            arrays[name] = np.frombuffer(data, dtype=kind, count=int(size) // np.dtype(kind).itemsize, offset=at)
            at += int(size) + -int(size) % 8
        return cls(arrays)

    def ranks(self, words: pa.StringArray) -> np.ndarray:
        """The rank of each word, -1 for those that aren't in the lexicon.  All words take a step at a time."""
        n = len(words)
        out = np.full(n, -1, dtype=np.int64)
        if not n or not len(self.arc_key):
            return out
        offsets = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + n + 1].astype(np.int64)
        data = np.frombuffer(words.buffers()[2], dtype=np.uint8)
        live, state, rank, at = np.arange(n), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), offsets[:-1].copy()
        ends = offsets[1:]
        while len(live):
            done = at[live] == ends[live]
            over = live[done]
            good = over[self.final[state[over]] == 1]
            out[good] = rank[good]
            live = live[~done]
            key = state[live] * 256 + data[at[live]]
            arc = np.minimum(np.searchsorted(self.arc_key, key), len(self.arc_key) - 1)
            known = self.arc_key[arc] == key
            live, arc = live[known], arc[known]
            rank[live] += self.arc_number[arc]
            state[live] = self.arc_target[arc]
            at[live] += 1
        return out

    def ids_of(self, rank: int) -> list[int]:
        return self.ids[self.id_start[rank] : self.id_start[rank + 1]].tolist()

    def spelling_of(self, rank: int) -> str:
        return self.spelling[self.spelling_start[rank] : self.spelling_start[rank + 1]].tobytes().decode()


def word_counts(docs: DataFrame, path: str) -> DataFrame:
    """(word, n) over all documents, as the encoder sees words."""

    def count(batches):
        try:
            yield from counted(batches)
        finally:
            tokens.WordCoder.release()

    def counted(batches):
        coder = tokens.WordCoder.get(path)
        seen: Counter = Counter()

        def flush():
            rows = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return rows

        for batch in batches:
            for _, data, offsets in kernels.slices(batch.column("text"), tokens.SLICE):
                words, _ = coder.words(data, offsets)
                times = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
                for word, n in zip(words.dictionary.to_pylist(), times.tolist(), strict=True):
                    seen[word] += n
                if len(seen) > COUNTED:
                    yield flush()
        if seen:
            yield flush()

    return id_text(docs).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, words: int) -> list[str]:
    """The words above the least count, of those a sixteenth of an octave apart, that at most `words` words reach.

    A top-k would send that many words from every task to the driver; this sends a histogram of some hundred rows, and
    then the words themselves once.
    """
    counts = stage(counts, "word-counts").withColumn("level", F.floor(16 * F.log2("n")).cast("int"))
    least, held = None, 0
    for r in counts.groupBy("level").count().orderBy(F.desc("level")).collect():
        held += r["count"]
        if held > words:
            break
        least = r["level"]
    return [] if least is None else [r["word"] for r in counts.filter(F.col("level") >= least).select("word").collect()]


def build_lexicon(docs: DataFrame, path: str, words: int = WORDS) -> Transducer:
    """The transducer of at most `words` words, the most frequent ones."""
    top = frequent_words(word_counts(docs, path), words)
    coder = tokens.WordCoder.get(path)
    top = sorted(top, key=str.encode)
    flat, sizes = coder.encode_words(pa.array(top, pa.string())) if top else (np.zeros(0), np.zeros(0, np.int64))
    border = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    entries = []
    for i, word in enumerate(top):
        ids = flat[border[i] : border[i + 1]].astype(int).tolist()
        entries.append((word.encode(), ids, coder.tokenizer.decode(ids, skip_special_tokens=False)))
    return Transducer.build(entries)


class Codec:
    """Forms of words in one worker: ids and decoded text, each as a string, from the lexicon or from the library."""

    _made: dict[str, Codec] = {}

    @classmethod
    def get(cls, path: str, lexicon: bytes, digest: str) -> Codec:
        name = f"{path}:{digest}"
        if name not in cls._made:
            cls._made.clear()
            file = os.path.join(tempfile.mkdtemp(prefix="lexicon-"), "transducer")
            with open(file, "wb") as f:
                f.write(lexicon)
            cls._made[name] = cls(path, Transducer.map(file))
            os.remove(file)
            os.rmdir(os.path.dirname(file))
        return cls._made[name]

    @classmethod
    def release(cls) -> None:
        cls._made.clear()
        tokens.WordCoder.release()

    def __init__(self, path: str, transducer: Transducer):
        self.coder = tokens.WordCoder.get(path)
        self.transducer = transducer
        self.known: dict[int, tuple[int, str, str]] = {}
        self.merged: dict[str, tuple[int, str, str]] = {}

    def _spell(self, ids: list[int]) -> tuple[int, str, str]:
        return len(ids), " ".join(map(str, ids)), self.coder.tokenizer.decode(ids, skip_special_tokens=False)

    def forms(self, words: pa.StringArray) -> list[tuple[int, str, str]]:
        """(ids, ids as text, decoded text) of each distinct word."""
        ranks = self.transducer.ranks(words).tolist()
        unseen = [w for w, r in zip(words.to_pylist(), ranks, strict=True) if r < 0]
        if len(self.merged) > tokens.CACHE_WORDS // 2:
            self.merged.clear()
        new = [w for w in unseen if w not in self.merged]
        if new:
            flat, sizes = self.coder.encode_words(pa.array(new, pa.string()))
            ids = flat.tolist()
            border = np.concatenate([[0], np.cumsum(sizes)]).tolist()
            parts = [ids[a:b] for a, b in zip(border[:-1], border[1:], strict=True)]
            spelled = self.coder.tokenizer.decode_batch(parts, skip_special_tokens=False)
            for word, part, text in zip(new, parts, spelled, strict=True):
                self.merged[word] = (len(part), " ".join(map(str, part)), text)
        out, rest = [], iter(unseen)
        for r in ranks:
            if r < 0:
                out.append(self.merged[next(rest)])
            else:
                if r not in self.known:
                    ids = self.transducer.ids_of(r)
                    self.known[r] = (len(ids), " ".join(map(str, ids)), self.transducer.spelling_of(r))
                out.append(self.known[r])
        return out

    def rows(self, data: np.ndarray, offsets: np.ndarray):
        """n_tokens, the ids as text and the decoded text of each row of a slice."""
        if not self.coder.by_word:
            raw = data.tobytes()
            each = [self._spell(e.ids) for e in self.coder.tokenizer.encode_batch([raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], add_special_tokens=False)]
            return np.array([n for n, _, _ in each], dtype=np.int64), [i for _, i, _ in each], [t for _, _, t in each]
        words, rows = self.coder.words(data, offsets)
        forms = self.forms(words.dictionary)
        index = words.indices.to_numpy()
        sizes = np.array([n for n, _, _ in forms], dtype=np.int64)[index] if len(index) else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(sizes)])
        full = sizes > 0  # a word of white space that isn't ASCII has no ids
        rows_full = np.concatenate([[0], np.cumsum(full)])[rows]
        index = pa.array(index[full])
        texts = []
        for k in (1, 2):
            values = pa.array([f[k] for f in forms], pa.large_string()).take(index)
            texts.append(pc.binary_join(pa.LargeListArray.from_arrays(pa.array(rows_full, pa.int64()), values), pa.scalar(" ", pa.large_string())))
        return np.diff(total[rows]), *texts


def transcode(docs: DataFrame, path: str | None = None, words: int = WORDS) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by a space) and decoded, one row for each row of docs."""
    spark = docs.sparkSession
    path = path or tokens.default_path()
    data = build_lexicon(docs, path, words).to_bytes()
    digest = hashlib.sha256(data).hexdigest()
    sent = spark.sparkContext.broadcast(data)

    def run(batches):
        try:
            yield from rows_of(batches, Codec.get(path, sent.value, digest))
        finally:
            Codec.release()

    def rows_of(batches, codec):
        for batch in batches:
            names = batch.column("doc_id")
            for row, part, offsets in kernels.slices(batch.column("text"), tokens.SLICE // 2):
                n, ids, decoded = codec.rows(part, offsets)
                yield pa.RecordBatch.from_arrays([names.slice(row, len(n)), pa.array(n), pa.array(ids, pa.string()) if isinstance(ids, list) else ids.cast(pa.string()), pa.array(decoded, pa.string()) if isinstance(decoded, list) else decoded.cast(pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return id_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids string, decoded string")


def op6_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = transcode(documents(spark, sf_dir))
    return df.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
