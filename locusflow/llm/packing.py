"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are the powers of two in n (as many of the largest as fit, then
the binary digits of what is left). Each piece is a sequence of its own: sequences of one length form a bucket, none
crosses documents and none needs padding. The work is one scan, with no shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.llm.ngrams import SEGMENT, forget, new_key, same_bytes, word_hashes
from locusflow.llm.worker import claim
from locusflow.session import prepare_workers

WINDOW = 4096
END_ID = 2
#: A tokenizer keeps the ids of so many words (of those of one batch at least).
CACHED_WORDS = 1_000_000
#: A sequence's id holds its bucket, the task that made it and a running number of that many bits.
TASK_BITS, NUMBER_BITS = 24, 34

SCHEMA = "doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: Texts with a word of more bytes aren't looked up: known words and their bytes are kept, and shall be short.
LONG = 400
_SPACE = np.zeros(256, bool)
_SPACE[[*range(9, 14), 32]] = True
#: Characters for which lower-casing and composition never depend on their neighbours.
_PLAIN = re.compile("[^\t-\r -~\xa0-ɏ]")
#: The split of the public vocabulary's pre-tokenizer, for such characters.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\s\w]|_)+")


class WordTokenizer:
    """Ids of whole texts by a tokenizer whose words never reach over white space; each distinct word is encoded once.

    Words are looked up by a 64-bit hash of their bytes, and what is found is compared byte by byte: sorted hashes beside
    places in one array of ids and one of bytes take a fraction of what a dictionary of strings does, and a batch is looked
    up at once. Texts with characters outside Latin blocks or with a long word go to the tokenizer as they are, and so do
    texts whose words share a hash with other words.
    """

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        from tokenizers import Tokenizer, normalizers

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.parts = Tokenizer.from_file(path)
        self.parts.encode_special_tokens = True
        self.parts.normalizer = normalizers.Sequence([])
        size = self.whole.get_vocab_size()
        self.ends = np.array([(self.whole.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.cached = cached
        self.key = new_key()
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.empty(0, np.uint64)
        # Places in the arrays of ids and bytes, and how many there are of a word: both are small.
        self.begins, self.spelt = np.empty((2, 0), np.int32)
        self.sizes, self.lengths = np.empty((2, 0), np.int16)
        self.ids = np.empty(0, np.uint32)
        self.bytes = np.empty(0, np.uint8)

    def _split(self, words: list[str]) -> list[bytes]:
        """The ids of white-space-free words.

        Letters are one word to the tokenizer and so are the marks after them, which covers most words; the others are
        split as the tokenizer would.
        """
        known: dict[str, bytes] = {}
        fresh = {w for w in words if w.isalpha()}
        ended, split = [], []
        for w in words:
            if not w.isalpha():
                stem = w.rstrip(MARKS)
                if stem.isalpha():
                    ended.append((w, stem, w[len(stem) :]))
                    fresh.add(stem)
                    fresh.add(w[len(stem) :])
                else:
                    parts = _WORDS.findall(w)
                    split.append((w, parts))
                    fresh.update(parts)
        fresh = sorted(fresh)
        for at in range(0, len(fresh), 4096):
            some = fresh[at : at + 4096]
            ids = np.array(self.parts.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(some):  # a word was split in another way: one at a time, then
                for w in some:
                    known[w] = np.array(self.whole.encode(w, add_special_tokens=False).ids, np.uint32).tobytes()
                continue
            data, begin = ids.tobytes(), 0
            for w, end in zip(some, (4 * cuts).tolist(), strict=True):
                known[w] = data[begin:end]
                begin = end
        for w, stem, marks in ended:
            known[w] = known[stem] + known[marks]
        for w, parts in split:
            known[w] = b"".join([known[p] for p in parts])
        return [known[w] for w in words]

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """Takes in words with new, sorted hashes."""
        if len(self.hashes) + len(words) > self.cached:
            self._forget()
        found = self._split([w.decode() for w in words])
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        spelt = len(self.bytes) + np.cumsum(lengths) - lengths
        self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(words), np.uint8)])
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begins = len(self.ids) + np.cumsum(sizes) - sizes
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(found), np.uint32)])
        place = np.searchsorted(self.hashes, hashes)
        fresh = ((self.hashes, hashes), (self.begins, begins), (self.sizes, sizes), (self.spelt, spelt), (self.lengths, lengths))
        self.hashes, self.begins, self.sizes, self.spelt, self.lengths = (np.insert(x, place, y) for x, y in fresh)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit integers."""
        out: list = [None] * len(texts)
        odd, group, size = [], [], 0
        for i, t in enumerate(texts):
            if _PLAIN.search(t):
                odd.append(i)
                continue
            group.append(i)
            size += len(t)
            if size >= SEGMENT:
                odd += self._plain(texts, group, out)
                group, size = [], 0
        odd += self._plain(texts, group, out)
        for i, e in zip(odd, self.whole.encode_batch_fast([texts[i] for i in odd], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, np.uint32)
        return out

    def _plain(self, texts: list[str], group: list[int], out: list) -> list[int]:
        """Puts the ids of some texts into ``out``; returns the numbers of those that the tokenizer must take."""
        if not group:
            return []
        coded = [texts[i].lower().replace("\xa0", " ").encode() for i in group]
        raw = b" ".join(coded)
        data = np.frombuffer(raw, np.uint8)
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = ~_SPACE[data]
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = turns[::2], turns[1::2]
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        far = np.flatnonzero(ends - starts > LONG)
        if len(far):
            apart = {group[k] for k in np.searchsorted(np.cumsum(lengths + 1), starts[far], "right").tolist()}
            return sorted(apart) + self._plain(texts, [i for i in group if i not in apart], out)
        hashes, first, where = np.unique(word_hashes(data, starts, ends, self.key), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, hashes)
        new = np.ones(len(hashes), bool)
        inner = at < len(self.hashes)
        new[inner] = self.hashes[at[inner]] != hashes[inner]
        if new.any():
            full = len(self.hashes) + np.count_nonzero(new) > self.cached
            some = slice(None) if full else new
            self._learn(hashes[some], [raw[a:b] for a, b in zip(starts[first[some]].tolist(), ends[first[some]].tolist(), strict=True)])
            at = np.searchsorted(self.hashes, hashes)
        # Each occurrence has the bytes of the word that its hash stands for.
        known, sizes = at[where], ends - starts
        alike = self.lengths[known] == sizes
        if alike.all():
            alike = same_bytes(data, starts, sizes, self.bytes, self.spelt[known])
        else:
            alike[alike] = same_bytes(data, starts[alike], sizes[alike], self.bytes, self.spelt[known[alike]])
        if not alike.all():
            # Another word with the hash of a known one: its text isn't looked up.
            apart = {group[k] for k in np.searchsorted(np.cumsum(lengths + 1), starts[~alike], "right").tolist()}
            return sorted(apart) + self._plain(texts, [i for i in group if i not in apart], out)
        sizes = self.sizes[known].astype(np.int64)
        stops = np.cumsum(sizes)
        total = int(stops[-1]) if len(stops) else 0
        ids = self.ids[np.repeat(self.begins[known] - stops + sizes, sizes) + np.arange(total)]
        borders = np.searchsorted(starts, np.cumsum(lengths + 1)[:-1])
        cuts = np.concatenate([[0], stops])[borders]
        for i, part in zip(group, np.split(ids, cuts), strict=True):
            out[i] = part
        return []


_tokenizers: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each path and Python worker."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def _let_go() -> None:
    _tokenizers.clear()
    forget()


def decompose(n: int, window: int = WINDOW) -> list[int]:
    """Lengths of the pieces of n tokens, largest first."""
    rest = n % window
    return [window] * (n // window) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: (id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    window must be a power of two. Every document ends with end_id, so a null or empty text is one piece of one token.
    A piece fills its sequence, so offset is 0 and sequence_id is the piece's own; ids of a bucket are neighbours in
    order. Equal documents and repeated rows are packed each for itself, rows with a null id too. Other columns are
    ignored; no input rows give no rows.
    """
    if window < 1 or window & (window - 1):
        raise ValueError("window must be a power of two")
    prepare_workers(docs.sparkSession)
    buckets = window.bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("packing", _let_go)
        tokenizer = word_tokenizer(tokenizer_path)
        task = TaskContext.get().partitionId()
        made = [0] * buckets
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                owner, start, length, crc, total, sequence = [], [], [], [], [], []
                for row, ids in enumerate(tokenizer.encode(part.column(1).to_pylist())):
                    data = ids.astype("<u4").tobytes() + end_id.to_bytes(4, "little")
                    n, begin = len(data) // 4, 0
                    for size in decompose(n, window):
                        bucket = size.bit_length() - 1
                        owner.append(row)
                        start.append(begin)
                        length.append(size)
                        crc.append(zlib.crc32(data[4 * begin : 4 * (begin + size)]))
                        total.append(n)
                        sequence.append((((bucket << TASK_BITS) | task) << NUMBER_BITS) | made[bucket])
                        made[bucket] += 1
                        begin += size
                keys = part.column(0).take(pa.array(owner, pa.int64()))
                rest = [pa.array(x, pa.int64()) for x in (start, length, crc, total, sequence, [0] * len(owner))]
                yield pa.RecordBatch.from_arrays([keys, *rest], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, SCHEMA.format(kind=kind)).withColumnRenamed("doc_id", id_col)
