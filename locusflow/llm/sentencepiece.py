"""SentencePiece BPE encoding and decoding by suffix-array matching.

The distinct words of a batch of texts are concatenated and their suffixes sorted. Every piece of the vocabulary is
looked up in the suffix array by binary search, which gives a range of suffixes and so all its occurrences. They are the
edges of the batch's lattice; laid out by position, they are relaxed until no edge can join two neighbours any more.

The public model is a BPE model: its encoding is the result of merging neighbours in the order of the pieces' scores, not
a path of the best total score. So relaxing takes, in every word at once, the edge of the best score that spans two
neighbouring segments (the leftmost of equals) and joins them, round by round.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.llm.worker import claim
from locusflow.session import prepare_workers

SPACE = "▁"
#: A codec keeps the ids of so many words, and of as many that it used before them.
CACHED_WORDS = 400_000
#: Words are matched together in batches of so many characters.
BATCH_CHARS = 400_000
#: Longer words are cut first, wherever no piece reaches over, in windows of so many characters.
LONG, WINDOW = 256, 100_000
#: No piece reaches over the end of a run of spaces with what follows it, and none holds a line feed.
_UNITS = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n+")


class PieceCodec:
    """Encodes and decodes texts with a SentencePiece BPE model with byte fallback."""

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.width = max(len(pieces[i]) for i in plain)
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        # Better scores first: a piece's rank in that order is what edges are compared by.
        order = sorted(plain, key=lambda i: (-model.get_score(i), i))
        self.pieces = [pieces[i] for i in order]
        self.ids = np.array(order, np.int64)
        self.sizes = np.fromiter(map(len, self.pieces), np.int64, len(self.pieces))
        self.points = np.array(self.pieces, dtype=f"U{self.width}").view(np.uint32).reshape(-1, self.width)
        parts = [b""] * n
        for i in plain:
            parts[i] = pieces[i].replace(SPACE, " ").encode()
        for b, i in enumerate(self.bytes):
            parts[i] = bytes([b])
        parts[model.unk_id()] = " ⁇ ".encode()
        self.parts = parts
        self.rank = {p: r for r, p in enumerate(self.pieces)}
        self.cached = cached
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        if any("\n" in p or SPACE in p.lstrip(SPACE) for p in self.pieces):
            raise ValueError("a piece of this model reaches over words")

    # ------------------------------------------------------------ matching

    def edges(self, text: np.ndarray) -> np.ndarray:
        """For each position and length the rank of the piece there, or -1: text is code points, 0 between words."""
        n, w = len(text), self.width
        # Characters as small numbers in their own order, several packed into one key: 0 ends a word.
        letters = np.unique(text)
        bits = 8 if len(letters) < 255 else 16 if len(letters) < 65535 else 32
        code = np.concatenate([np.searchsorted(letters, text).astype(np.uint64) + np.uint64(letters[0] != 0), np.zeros(w, np.uint64)])
        per = 64 // bits
        keys = []
        for first in range(0, w, per):
            key = np.zeros(n, np.uint64)
            for k in range(first, first + per):
                key = key << np.uint64(bits) | (code[k : k + n] if k < w else np.uint64(0))
            keys.append(key)
        here = np.flatnonzero(text)
        keys = [k[here] for k in keys]
        # The suffix array, by the first w characters: no piece is longer, and suffixes that agree so far are alike.
        order = np.lexsort(keys[::-1])
        suffixes = here[order]
        low, high = self._ranges([k[order] for k in keys], letters, bits)
        out = np.full((n, w + 1), -1, np.int16 if len(self.pieces) < 1 << 15 else np.int32)
        count = high - low
        piece = np.repeat(np.arange(len(count)), count)
        place = suffixes[np.repeat(low - (np.cumsum(count) - count), count) + np.arange(len(piece))]
        out[place, self.sizes[piece]] = piece
        return out

    def _ranges(self, keys: list[np.ndarray], letters: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each piece: all pieces are searched together, key by key."""
        at = np.minimum(np.searchsorted(letters, self.points), len(letters) - 1)
        known = (letters[at] == self.points) | (self.points == 0)
        code = np.where(self.points == 0, 0, at + int(letters[0] != 0)).astype(np.uint64)
        low = np.zeros(len(self.pieces), np.int64)
        high = np.where(known.all(1), len(keys[0]), 0)
        per = 64 // bits
        for j, column in enumerate(keys):
            part = code[:, j * per : (j + 1) * per]
            filled = np.clip(self.sizes - j * per, 0, per)
            live = np.flatnonzero((low < high) & (filled > 0))
            if not len(live):
                break
            value = np.zeros(len(live), np.uint64)
            for k in range(per):
                value = value << np.uint64(bits) | (part[live, k] if k < part.shape[1] else np.uint64(0))
            # Everything after the piece's end may be anything: from all zeros to all ones.
            free = (np.uint64(bits) * (per - filled[live]).astype(np.uint64))
            rest = np.where(free > 0, (np.uint64(1) << np.minimum(free, np.uint64(63))) - np.uint64(1), np.uint64(0))
            low[live], high[live] = self._bisect(column, low[live], high[live], value, False), self._bisect(column, low[live], high[live], value | rest, True)
        return low, np.maximum(low, high)

    @staticmethod
    def _bisect(column: np.ndarray, low: np.ndarray, high: np.ndarray, value: np.ndarray, right: bool) -> np.ndarray:
        """Binary searches of many values, each in its own part of a column."""
        low, high = low.copy(), high.copy()
        while True:
            live = np.flatnonzero(low < high)
            if not len(live):
                return low
            mid = (low[live] + high[live]) // 2
            here = column[mid]
            less = here <= value[live] if right else here < value[live]
            low[live[less]] = mid[less] + 1
            high[live[~less]] = mid[~less]

    # ------------------------------------------------------------ relaxing

    def _learn(self, words: list[str]) -> None:
        self.known.update(self._encode_words(words))

    def _encode_words(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words of bounded length."""
        words, out = sorted(words, key=len), {}
        at = 0
        while at < len(words):
            # Batches of words of like length with a bounded number of characters.
            end, total = at, 0
            while end < len(words) and (end == at or total + len(words[end]) + 1 <= BATCH_CHARS):
                total += len(words[end]) + 1
                end += 1
            self._encode_batch(words[at:end], out)
            at = end
        return out

    def _encode_batch(self, words: list[str], known: dict[str, bytes]) -> None:
        text = np.frombuffer("\0".join([*words, ""]).encode("utf-32-le"), np.uint32)
        if any("\0" in w for w in words):  # the separator itself: never part of a piece
            text = np.frombuffer("\0".join([*(w.replace("\0", "") for w in words), ""]).encode("utf-32-le"), np.uint32)
        edge = self.edges(text)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        begins = np.cumsum(sizes + 1) - sizes - 1
        start = np.flatnonzero(text != 0)
        owner = np.repeat(np.arange(len(words)), sizes)
        stop = start + 1
        done_start, done_stop, done_owner = [], [], []
        none = np.int64(1) << 62
        while len(start):
            together = stop[1:] - start[:-1]
            same = (owner[1:] == owner[:-1]) & (together <= self.width)
            rank = np.full(len(start), none, np.int64)
            at = np.flatnonzero(same)
            found = edge[start[at], together[at]].astype(np.int64)
            rank[at] = np.where(found < 0, none, found << 40 | at)
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.minimum.reduceat(rank, first)
            active = best < none
            join = (best[active] & ((1 << 40) - 1)).astype(np.int64)
            stop[join] = stop[join + 1]
            keep = np.ones(len(start), bool)
            keep[join + 1] = False
            # Words without an edge left are finished.
            live = np.repeat(active, np.diff(np.append(first, len(start))))
            over = ~live
            done_start.append(start[over])
            done_stop.append(stop[over])
            done_owner.append(owner[over])
            keep &= live
            start, stop, owner = start[keep], stop[keep], owner[keep]
        start, stop, owner = (np.concatenate(x) for x in (done_start, done_stop, done_owner))
        order = np.lexsort((start, owner))
        start, stop, owner = start[order], stop[order], owner[order]
        length = stop - start
        rank = edge[start, np.minimum(length, self.width)].astype(np.int64)
        ids = np.where(rank >= 0, self.ids[rank], -1)
        counts = np.ones(len(ids), np.int64)
        lost = np.flatnonzero(ids < 0)
        flat = ids.astype("<u4")
        if len(lost):
            # Characters that no piece covers fall back to their bytes.
            out, at = [], 0
            for k in lost:
                out.append(flat[at:k])
                c = words[owner[k]][start[k] - begins[owner[k]]]
                own = self._fallback(c)
                counts[k] = len(own)
                out.append(own)
                at = k + 1
            flat = np.concatenate([*out, flat[at:]])
        data = flat.tobytes()
        ends = np.cumsum(np.bincount(owner, weights=counts, minlength=len(words)).astype(np.int64)).tolist()
        at = 0
        for w, end in zip(words, ends, strict=True):
            known[w] = data[4 * at : 4 * end]
            at = end

    def _cut(self, word: str) -> list[str]:
        """A long word in parts that no piece reaches out of, so each can be encoded for itself."""
        covered = np.zeros(len(word) + self.width + 1, np.int64)
        for at in range(0, len(word), WINDOW):
            text = np.frombuffer(word[at : at + WINDOW + self.width].encode("utf-32-le", "surrogatepass"), np.uint32)
            place, size = np.nonzero(self.edges(text)[:, 2:] >= 0)
            # An edge of two characters and more covers the borders inside it.
            np.add.at(covered, at + place + 1, 1)
            np.add.at(covered, at + place + size + 2, -1)
        cuts = [0, *(np.flatnonzero(np.cumsum(covered)[1 : len(word)] == 0) + 1).tolist(), len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if a < b]

    def _merge_long(self, word: str) -> bytes:
        """The ids of a long word that can't be cut: the best edge first, from a heap, with each joint kept in a list."""
        n, width, rank, sizes = len(word), self.width, self.rank, self.sizes.tolist()
        stop, before, alive = list(range(1, n + 1)), list(range(-1, n)), bytearray(b"\1") * n
        heap = [r << 40 | i for i in range(n - 1) if (r := rank.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        low = (1 << 40) - 1
        while heap:
            x = heapq.heappop(heap)
            i = x & low
            j = stop[i]
            # What was joined meanwhile has another length now.
            if not alive[i] or j >= n or stop[j] - i != sizes[x >> 40]:
                continue
            e = stop[i] = stop[j]
            alive[j] = 0
            before[e] = i
            p = before[i]
            if p >= 0 and e - p <= width and (r := rank.get(word[p:e])) is not None:
                heapq.heappush(heap, r << 40 | p)
            if e < n and stop[e] - i <= width and (r := rank.get(word[i : stop[e]])) is not None:
                heapq.heappush(heap, r << 40 | i)
        out, i = [], 0
        while i < n:
            r = rank.get(word[i : stop[i]])
            out.append(self._fallback(word[i]) if r is None else self.ids[r : r + 1].astype("<u4"))
            i = stop[i]
        return np.concatenate(out).tobytes() if out else b""

    def _encode_long(self, words: list[str]) -> dict[str, bytes]:
        """The ids of long words."""
        parts = {w: self._cut(w.replace("\0", "")) for w in words}
        short = sorted({p for ps in parts.values() for p in ps if len(p) <= LONG})
        known = self._encode_words(short)
        return {w: b"".join(known[p] if len(p) <= LONG else self._merge_long(p) for p in ps) for w, ps in parts.items()}

    def _fallback(self, c: str) -> np.ndarray:
        return np.array([self.bytes[b] for b in c.encode("utf-8", "replace")], "<u4")

    # ------------------------------------------------------------ texts

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        units = [_UNITS.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        words = set().union(*units)
        long = {w for w in words if len(w) > LONG}
        words -= long
        if len(self.known) + len(words) > self.cached:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        missing = [w for w in words if w not in known]
        if older:
            known.update((w, older[w]) for w in missing if w in older)
            missing = [w for w in missing if w not in older]
        if missing:
            self._learn(missing)
        apart = self._encode_long(sorted(long)) if long else {}
        get = self.known.__getitem__
        if not apart:
            return [b"".join(map(get, u)) for u in units]
        return [b"".join([apart[w] if w in apart else get(w) for w in u]) for u in units]

    def decode(self, data: bytes) -> str:
        """The text of some ids: spaces for marks, the one in front taken off; bytes that are no UTF-8 become U+FFFD."""
        text = b"".join(map(self.parts.__getitem__, np.frombuffer(data, "<u4").tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_codecs: dict[str, PieceCodec] = {}


def piece_codec(path: str) -> PieceCodec:
    """One codec for each path and Python worker."""
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id_col, ids, n_pieces, ids_crc32, decoded_md5, round_trip).

    ids are those of the model's own encoder; ids_crc32 is over them as little-endian unsigned 32-bit integers and
    decoded_md5 over the decoded text in UTF-8. round_trip tells whether that is the text (a mark U+2581 comes back as a
    space). Null and empty texts have no ids. Repeated rows and null ids are rows like others; other columns are ignored;
    no rows give no rows.
    """
    prepare_workers(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("sentencepiece", _codecs.clear)
        codec = piece_codec(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).to_pylist()
                coded = codec.encode(texts)
                back = [codec.decode(c) for c in coded]
                ids = np.frombuffer(b"".join(coded), "<u4").astype(np.int32)
                counts = [len(c) // 4 for c in coded]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids))
                rest = [pa.array(counts, pa.int64()), pa.array([zlib.crc32(c) for c in coded], pa.int64()), pa.array([hashlib.md5(b.encode()).hexdigest() for b in back]), pa.array([b == t for b, t in zip(back, texts, strict=True)])]
                yield pa.RecordBatch.from_arrays([part.column(0), lists, *rest], ["id", "ids", "n_pieces", "ids_crc32", "decoded_md5", "round_trip"])

    out = source.mapInArrow(run, f"id {kind}, ids array<int>, n_pieces long, ids_crc32 long, decoded_md5 string, round_trip boolean")
    return out.withColumnRenamed("id", id_col)


def decode_pieces(rows: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: (id_col, text), the text of the ids. Null ids and empty lists give an empty text."""
    prepare_workers(rows.sparkSession)
    source = rows.select(F.col(id_col).alias("id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = piece_codec(model_path)
        for batch in batches:
            texts = [codec.decode(np.array(x, "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return source.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
