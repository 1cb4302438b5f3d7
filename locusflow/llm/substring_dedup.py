"""Substring dedup by content-defined chunking with a gear rolling hash.

A gear hash, ``h = (h << 4) + G[byte]``, is rolled over the text's bytes and so sees the last 16 of them; white space
between words counts as one space. A chunk begins at
a word whose hash is the smallest among some words on either side: cuts depend on nearby content only, and an insertion
shifts nothing but its surroundings. A stretch with a period of a few words has no such minima; it is cut at its ends and
every few periods, so that stretches of one period give equal chunks. Chunks are deduplicated by digest. A run of neighbouring chunks that all occurred
before is a repeat (where a periodic stretch ends, the words around that seam must have occurred as well), and its ends are refined to words by comparing it with places where chunks near them occurred first. Repeats of
MIN_WORDS words and more are cut out; the first occurrence (smallest id, then place) stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusflow.llm.ngrams import WORD_BASE, forget, mix, new_key, pieces, word_hashes
from locusflow.llm.worker import claim
from locusflow.session import columns_of, persisted, prepare_workers, release

#: Words on either side among which a cut's hash must be the smallest: inner chunks have REACH + 1 words at least.
REACH = 4
#: Repeats of so many words and more are cut out.
MIN_WORDS = 50
#: A repeat goes on beyond a run by less than the next chunk (else that would repeat, too) and so many words, within which
#: what stands around the repeat has a say in where chunks begin.
EDGE = 24
#: A run's end is refined by chunks that begin (or end) so many words from it at most, of so many different first places.
NEAR_END, PLACES = 56, 4
#: Longest period, in words, and least length of a stretch that counts as periodic; it is cut every STRIDE words or so.
PERIODS, STRETCH, STRIDE = 8, 16, 8
#: Words on either side of where a stretch meets another chunk that tell if the two are repeated together.
SEAM = 6
#: Bytes over which the hash is rolled at a time.
STEP_BYTES = 1 << 18
#: Lists of cuts are broadcast up to so many entries; beyond that they are joined by shuffle, as lists of places always are.
BROADCAST_ENTRIES = 1_000_000
WINDOW = 16
_GEAR = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SPACE = np.zeros(256, bool)
_SPACE[[*range(9, 14), 32]] = True
KEY = ["id", "h"]
SPANS = T.ArrayType(T.StructType().add("start_byte", "long").add("end_byte", "long").add("words", "long"))


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte, by doubling: that of 2k bytes is that of k and, shifted, that of the k before."""
    h = _GEAR[data]
    k = 1
    while k < WINDOW:
        if len(h) > k:
            older = h[:-k] << np.uint64(4 * k)
            h[k:] += older
        k *= 2
    return h


class Chunks:
    """Words and chunks of some texts, found together.

    starts, ends: byte spans of all words; first: number of each text's first word (and the count of all words at the
    end); cuts: words that begin a chunk; sizes: words of each chunk; digests: a digest of each chunk's words; back, ahead:
    words before and after a chunk that repeat, as the chunk does, what stands a period earlier (0 outside of stretches).
    """

    def __init__(self, texts: list[bytes], key: bytes, reach: int = REACH):
        # As many separators as the rolling hash sees keep texts from each other.
        gap = b"\n" * WINDOW
        data = np.frombuffer(gap.join([b"", *texts, b""]), np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.begins = WINDOW + np.concatenate([[0], np.cumsum(lengths + WINDOW)[:-1]]).astype(np.int64) if texts else np.empty(0, np.int64)
        inside = np.empty(len(data) + 2, bool)
        inside[0] = inside[-1] = False
        inside[1:-1] = ~_SPACE[data]
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = turns[::2], turns[1::2]
        self.first = np.append(np.searchsorted(self.starts, self.begins), len(self.starts))
        self.data, self.hashes = data, word_hashes(data, self.starts, self.ends, key)
        stretches = self._stretches()
        self.cuts = self._cuts(self._scores(data), reach, stretches)
        self.sizes = np.diff(np.append(self.cuts, len(self.starts)))
        self.digests = self._digests()
        self.back, self.ahead = np.zeros((2, len(self.cuts)), np.int32)
        stops = self.cuts + self.sizes
        for s, e, p in stretches:
            a, b = np.searchsorted(self.cuts, [s + p, e])
            self.back[a:b] = np.maximum(self.back[a:b], self.cuts[a:b] - s - p)
            self.ahead[a:b] = np.maximum(self.ahead[a:b], e - stops[a:b])

    def _stretches(self) -> list[tuple[int, int, int]]:
        """(first word, word after, period) of the longest stretches in which each word equals the one a period before."""
        owner = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        inside = np.zeros(len(owner), bool)
        found = []
        for p in range(1, PERIODS + 1):
            same = (self.hashes[p:] == self.hashes[:-p]) & (owner[p:] == owner[:-p])
            turns = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
            a, b = turns[::2], turns[1::2]
            enough = b - a >= max(2 * p, STRETCH - p)
            for s, e in zip(a[enough].tolist(), (b[enough] + p).tolist(), strict=True):
                # Multiples of a period that is known already.
                if not inside[s:e].all():
                    inside[s:e] = True
                    found.append((s, e, p))
        return sorted(found)

    def _scores(self, data: np.ndarray) -> np.ndarray:
        """The rolling hash before each word, over words with one space between them, whatever white space there is."""
        space = _SPACE[data]
        keep = ~space
        keep[1:] |= ~space[:-1]
        keep[(self.begins[:, None] - np.arange(1, WINDOW + 1)[None, :]).ravel()] = True
        plain = np.where(space, np.uint8(32), data)[keep]
        starts = np.cumsum(keep)[self.starts] - 1
        out = np.empty(len(starts), np.uint64)
        for at in range(0, len(plain), STEP_BYTES):
            a, b = np.searchsorted(starts, [at, at + STEP_BYTES])
            if a < b:
                begin = max(0, at - WINDOW)
                out[a:b] = gear_hashes(plain[begin : at + STEP_BYTES])[np.maximum(starts[a:b] - 1 - begin, 0)]
        return mix(out)

    def _cuts(self, scores: np.ndarray, reach: int, stretches: list[tuple[int, int, int]]) -> np.ndarray:
        n = len(scores)
        wide = np.full(n + 2 * reach, np.iinfo(np.uint64).max, np.uint64)
        wide[reach : reach + n] = scores
        least = np.ones(n, bool)
        for k in range(1, reach + 1):
            least &= scores < wide[reach - k : reach - k + n]
            least &= scores <= wide[reach + k : reach + k + n]
        # Within ``reach`` words of a text's ends the words that would decide are missing.
        edge = np.zeros(n + 1, np.int64)
        for a, b in ((self.first[:-1], np.minimum(self.first[:-1] + reach, self.first[1:])), (np.maximum(self.first[1:] - reach, self.first[:-1]), self.first[1:])):
            np.add.at(edge, a, 1)
            np.add.at(edge, b, -1)
        least &= np.cumsum(edge[:-1]) == 0
        least[self.first[:-1][self.first[:-1] < self.first[1:]]] = True
        for s, e, _ in stretches:
            least[s + 1 : e] = False
        for s, e, p in stretches:
            # From the place in the period whose words come first, so that chunks don't depend on where a stretch begins.
            words = word_hashes(self.data, self.starts[s : s + 2 * p], self.ends[s : s + 2 * p]).tolist()
            begin = s + min(range(p), key=lambda k, words=words, p=p: words[k : k + p])
            least[s] = True
            least[begin : e : p * -(-STRIDE // p)] = True
            least[e : e + 1] = True
        return np.flatnonzero(least)

    def _digests(self) -> np.ndarray:
        if not len(self.cuts):
            return np.empty(0, np.uint64)
        place = np.arange(len(self.hashes)) - np.repeat(self.cuts, self.sizes)
        power = np.cumprod(np.full(int(self.sizes.max()) + 1, WORD_BASE, np.uint64), dtype=np.uint64)
        return mix(np.add.reduceat(self.hashes * power[place], self.cuts) + self.sizes.astype(np.uint64))

    def seam_digests(self, chunks: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """A digest of the SEAM words on either side of where each of the chunks begins, as far as its text goes."""
        out = np.empty(len(chunks), np.uint64)
        for k, i in enumerate(chunks.tolist()):
            at, text = self.cuts[i], owner[i]
            words = self.hashes[max(self.first[text], at - SEAM) : min(self.first[text + 1], at + SEAM)]
            out[k] = np.bitwise_xor.reduce(mix(words + np.arange(1, len(words) + 1, dtype=np.uint64) * np.uint64(WORD_BASE)))
        return mix(out ^ np.uint64(0x5EA5))


def _apart(a: dict, b: dict):
    """Whether a periodic stretch ends between two neighbouring chunks (or columns of them).

    A stretch repeats itself and others of its kind, wherever it stands, so two repeated chunks on either side of its end
    needn't be one repeat. They are if the words around the seam are repeated, too.
    """
    return ((a["back"] > 0) | (a["ahead"] > 0) | (b["back"] > 0) | (b["ahead"] > 0)) & (a["ahead"] < b["words"])


def _chunk_rows(key: bytes):
    """The chunks of each text; prev and next are the words of the neighbouring ones, 0 where the text ends.

    A seam, where a periodic stretch meets another chunk, is a row of no words with the number of the chunk behind it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("ngrams", forget)
        for batch in batches:
            for part in pieces(batch, 2):
                c = Chunks(part.column(2).to_pylist(), key)
                bounds = np.searchsorted(c.cuts, c.first)
                owner = np.repeat(np.arange(part.num_rows), np.diff(bounds))
                keys = [part.column(k).take(pa.array(owner)) for k in (0, 1)]
                number = np.arange(len(c.cuts)) - bounds[:-1][owner]
                wide = np.concatenate([[0], c.sizes, [0]])
                prev, following = wide[:-2] * (number > 0), wide[2:] * (np.append(number[1:], 0) > 0)
                names = [*KEY, "no", "d", "words", "back", "ahead", "prev", "next"]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(number.astype(np.int32)), pa.array(c.digests.view(np.int64)), *(pa.array(x.astype(np.int32)) for x in (c.sizes, c.back, c.ahead, prev, following))], names)
                sides = [{"back": c.back[x], "ahead": c.ahead[x], "words": c.sizes[x]} for x in (slice(None, -1), slice(1, None))]
                seams = np.flatnonzero((number[1:] > 0) & _apart(*sides)) + 1 if len(number) else np.empty(0, np.int64)
                if len(seams):
                    none = pa.array(np.zeros(len(seams), np.int32))
                    yield pa.RecordBatch.from_arrays([*(k.take(pa.array(seams)) for k in keys), pa.array(number[seams].astype(np.int32)), pa.array(c.seam_digests(seams, owner).view(np.int64)), *[none] * 5], names)

    return run


def _sides(run: list[dict], left: bool) -> list[dict]:
    """Chunks near one end of a run with their first occurrences, of which no two lie alike to the run.

    want: words outwards of the chunk that decide where the repeat ends.
    """
    out, seen, away = [], set(), 0
    beyond = (run[0]["prev"] if left else run[-1]["next"]) + EDGE
    for c in run if left else reversed(run):
        if away > NEAR_END or len(out) == PLACES:
            break
        f = c["first"]
        if (how := (f["id"], f["h"], f["no"] - c["no"])) not in seen:
            seen.add(how)
            out.append({"left": left, "no": c["no"], "away": away, "want": away + beyond, "first_id": f["id"], "first_h": f["h"], "first_no": f["no"]})
        away += c["words"]
    return out


def _side_type(key) -> list:
    return [("left", pa.bool_()), ("no", pa.int32()), ("away", pa.int32()), ("want", pa.int32()), ("first_id", key), ("first_h", pa.int64()), ("first_no", pa.int32())]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of neighbouring repeated chunks of each text, each with the first occurrences of chunks near its ends."""
    claim("ngrams", forget)
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            out = []
            for row in part.to_pylist():
                chunks = sorted((c for c in row["chunks"] if c["words"]), key=lambda c: c["no"])
                seams = {c["no"] for c in row["chunks"] if not c["words"]}
                begin, found = 0, []
                for i in range(1, len(chunks) + 1):
                    if i == len(chunks) or chunks[i]["no"] != chunks[i - 1]["no"] + 1 or _apart(chunks[i - 1], chunks[i]) and chunks[i]["no"] not in seams:
                        run = chunks[begin:i]
                        found.append({"a": run[0]["no"], "b": run[-1]["no"], "words": sum(c["words"] for c in run), "back": run[0]["back"], "ahead": run[-1]["ahead"], "sides": _sides(run, True) + _sides(run, False)})
                        begin = i
                out.append(found)
            shape = [*((n, pa.int32()) for n in ("a", "b", "words", "back", "ahead")), ("sides", pa.list_(pa.struct(_side_type(part.column(0).type))))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.list_(pa.struct(shape)))], [*KEY, "runs"])


def _contexts(key: bytes):
    """Hashes of the words before (left) or after chunks, nearest first.

    Asked for are first occurrences (run null) and the places in runs that are compared with them, with all that is known
    of these. 32 bits of a word's hash are enough here: they only decide where words begin to differ.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("ngrams", forget)
        for batch in batches:
            for part in pieces(batch, 2):
                c = Chunks(part.column(2).to_pylist(), key)
                bounds = np.searchsorted(c.cuts, c.first)
                ident = part.column(0).type
                names, kinds = zip(("run", pa.int32()), ("left", pa.bool_()), ("no", pa.int32()), ("away", pa.int32()), ("first_id", ident), ("first_h", pa.int64()), ("first_no", pa.int32()), strict=True)
                owner, words, rest = [], [], [[] for _ in names]
                for i, (asked, runs) in enumerate(zip(part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True)):
                    for q in [*(asked or ()), *({**q, "run": r["a"]} for r in runs or () for q in r["sides"])]:
                        at = bounds[i] + q["no"]
                        if q["left"]:
                            end = c.cuts[at]
                            near = c.hashes[max(c.first[i], end - q["want"]) : end][::-1]
                        else:
                            end = c.cuts[at] + c.sizes[at]
                            near = c.hashes[end : min(c.first[i + 1], end + q["want"])]
                        owner.append(i)
                        words.append((near >> np.uint64(32)).astype(np.uint32).view(np.int32))
                        for out, n in zip(rest, names, strict=True):
                            out.append(q.get(n))
                keys = [part.column(k).take(pa.array(owner, pa.int64())) for k in (0, 1)]
                sizes = np.fromiter(map(len, words), np.int64, len(words))
                near = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.concatenate(words) if words else np.empty(0, np.int32), pa.int32()))
                yield pa.RecordBatch.from_arrays([*keys, *(pa.array(x, k) for x, k in zip(rest, kinds, strict=True)), near], [*KEY, *names, "near"])

    return run


def _cut(key: bytes):
    """Takes the spans out of each text and reports them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("ngrams", forget)
        for batch in batches:
            for part in pieces(batch, 2):
                texts, asked = part.column(2).to_pylist(), part.column(3).to_pylist()
                some = [i for i, s in enumerate(asked) if s]
                c = Chunks([texts[i] for i in some], key)
                bounds = np.searchsorted(c.cuts, c.first)
                spans: list[list] = [[] for _ in texts]
                removed = [0] * len(texts)
                clean = [t.decode() for t in texts]
                for k, i in enumerate(some):
                    taken = np.zeros(c.first[k + 1] - c.first[k], bool)
                    for s in asked[i]:
                        last = bounds[k] + s["b"]
                        begin = max(c.cuts[bounds[k] + s["a"]] - s["before"], c.first[k]) - c.first[k]
                        end = c.cuts[last] + c.sizes[last] + s["after"] - c.first[k]
                        taken[begin:end] = True
                    turns = np.flatnonzero(np.diff(np.concatenate([[0], taken.view(np.int8), [0]])))
                    keep, at = [], 0
                    for a, b in zip(turns[::2], turns[1::2], strict=True):
                        x = int(c.starts[c.first[k] + a] - c.begins[k])
                        y = int(c.starts[c.first[k] + b] - c.begins[k]) if b < len(taken) else len(texts[i])
                        spans[i].append({"start_byte": x, "end_byte": y, "words": int(b - a)})
                        keep.append(texts[i][at:x])
                        at = y
                    clean[i] = b"".join([*keep, texts[i][at:]]).decode()
                    removed[i] = int(taken.sum())
                kind = pa.list_(pa.struct([("start_byte", pa.int64()), ("end_byte", pa.int64()), ("words", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(clean, pa.string()), pa.array(removed, pa.int64()), pa.array(spans, kind), part.column(4)], ["id", "clean_text", "removed_words", "spans", "rest"])

    return run


def _with_lists(texts: DataFrame, lists: DataFrame, entries: int | None, how: str) -> DataFrame:
    """texts joined with lists on (id, h); the lists are broadcast only if they are known to have few entries altogether."""
    lists = F.broadcast(lists) if entries is not None and entries <= BROADCAST_ENTRIES else lists.hint("merge")
    return texts.alias("t").join(lists.alias("l"), F.col("t.id").eqNullSafe(F.col("l.id")) & (F.col("t.h") == F.col("l.h")), how)


def _cleaned(docs: DataFrame, rest: list, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """Rows (id, clean_text, removed_words, spans, rest); rest are columns that are handed through."""
    spark = docs.sparkSession
    prepare_workers(spark)
    key = new_key()
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.cast("binary").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    chunks = persisted(source.mapInArrow(_chunk_rows(key), f"id {kind}, h long, no int, d long, words int, back int, ahead int, prev int, next int"), "chunks")

    place = F.struct("id", "h", "no")
    first = chunks.groupBy("d").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("d", "first")
    first = persisted(first, "first")
    later = chunks.join(first, "d").where(~place.eqNullSafe(F.col("first"))).select(*KEY, F.struct("no", "words", "back", "ahead", "prev", "next", "first").alias("c"))
    texts = later.groupBy(*KEY).agg(F.collect_set("c").alias("chunks"))
    side = f"struct<left: boolean, no: int, away: int, want: int, first_id: {kind}, first_h: long, first_no: int>"
    runs = persisted(texts.mapInArrow(_runs, f"id {kind}, h long, runs array<struct<a: int, b: int, words: int, back: int, ahead: int, sides: array<{side}>>>"), "runs")
    release(chunks, first)

    # Where a run and first occurrences go on alike: what is around either is looked up in the text that holds it.
    sides = runs.select(F.explode("runs.sides").alias("s")).select(F.explode("s").alias("s")).select("s.*")
    asked = sides.groupBy("first_id", "first_h", "first_no", "left").agg(F.max("want").alias("want"))
    asked = asked.groupBy(F.col("first_id").alias("id"), F.col("first_h").alias("h")).agg(F.collect_list(F.struct(F.col("first_no").alias("no"), "left", "want")).alias("asked"))
    none = F.lit(None)
    lists = asked.withColumn("runs", none.cast(runs.schema["runs"].dataType)).unionByName(runs.withColumn("asked", none.cast(asked.schema["asked"].dataType)))
    lists = lists.groupBy(*KEY).agg(F.first("asked", True).alias("asked"), F.first("runs", True).alias("runs"))
    found = _with_lists(source, lists, None, "inner").select("t.id", "t.h", "t.text", "l.asked", "l.runs")
    found = persisted(found.mapInArrow(_contexts(key), f"id {kind}, h long, run int, left boolean, no int, away int, first_id {kind}, first_h long, first_no int, near array<int>"), "contexts")
    there = found.where("run IS NULL").select(F.col("id").alias("first_id"), F.col("h").alias("first_h"), F.col("no").alias("first_no"), "left", F.col("near").alias("there"))
    there = there.dropDuplicates(["first_id", "first_h", "first_no", "left"])
    here = found.where("run IS NOT NULL").drop("no")
    both = here.alias("w").join(there.alias("n"), F.col("w.first_id").eqNullSafe(F.col("n.first_id")) & (F.col("w.first_h") == F.col("n.first_h")) & (F.col("w.first_no") == F.col("n.first_no")) & (F.col("w.left") == F.col("n.left")))

    def alike(x: str, y: str):
        """The number of leading elements that two arrays share."""
        differ = F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), False)
        return F.when(differ > 0, differ - 1).otherwise(F.least(F.size(x), F.size(y))).cast("int")

    # The longest way that any of the places goes on; within a stretch, what stands a period earlier does, too.
    more = both.select("w.id", "w.h", F.col("w.run").alias("a"), "w.left", (alike("near", "there") - F.col("away")).alias("more"))
    more = more.groupBy(*KEY, "a").agg(*(F.max(F.when(F.col("left") == k, F.col("more"))).alias(n) for k, n in ((True, "before"), (False, "after"))))
    grown = runs.select(*KEY, F.explode("runs").alias("r")).select(*KEY, "r.a", "r.b", "r.words", "r.back", "r.ahead").alias("r")
    grown = grown.join(more.alias("m"), F.col("r.id").eqNullSafe(F.col("m.id")) & (F.col("r.h") == F.col("m.h")) & (F.col("r.a") == F.col("m.a"))).select("r.*", "before", "after")
    grown = grown.withColumns({n: F.greatest(n, o, F.lit(0)).cast("int") for n, o in (("before", "back"), ("after", "ahead"))})
    spans = grown.where(F.col("words") + F.col("before") + F.col("after") >= min_words)
    cut_lists = persisted(spans.groupBy(*KEY).agg(F.collect_list(F.struct("a", "b", "before", "after")).alias("cut")), "cuts")
    release(runs, found)
    entries = cut_lists.agg(F.sum(F.size("cut"))).first()[0] or 0
    whole = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.cast("binary").alias("text"), F.struct(*rest).alias("rest"))
    rows = _with_lists(whole, cut_lists, entries, "left").select("t.id", "t.h", "t.text", "l.cut", "t.rest")
    shape = T.StructType().add(whole.schema["id"]).add("clean_text", "string").add("removed_words", "long").add("spans", SPANS).add(whole.schema["rest"])
    return rows.mapInArrow(_cut(key), shape)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per input row: (id_col, clean_text, removed_words, spans), spans with start_byte, end_byte and words.

    A word is a run of characters that aren't ASCII white space, and words are equal if their characters are. A repeat is
    found if it holds a whole chunk, which a passage of 50 different words or of a period of up to PERIODS words practically
    always does. White space after a removed span goes with it. The order of occurrences is by id (null
    first), then by a hash of the text, then by place; rows that tie in id and text count as one text and come out alike.
    A null text counts as empty and stays empty. Other columns are ignored; no input rows give no rows. A passage that a
    text repeats within itself is cut there, too.
    """
    return _cleaned(docs, [F.lit(0).alias("none")], id_col, text_col, min_words).drop("rest").withColumnRenamed("id", id_col)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, length_col: str | None = None) -> DataFrame:
    """The rows of ``docs`` with repeats cut out of their texts, by the rules of :func:`repeated_passages`.

    A null text stays null. ``length_col``, if named, gets the new length in code points. All else stays as it is.
    """
    out = _cleaned(docs, [F.struct(*columns_of(docs, text_col)).alias("columns"), F.col(text_col).isNull().alias("null")], id_col, text_col, min_words)
    clean = F.when(~F.col("rest.null"), F.col("clean_text"))
    new = {text_col: clean} | ({length_col: F.length(clean).cast(docs.schema[length_col].dataType)} if length_col else {})
    return out.select(*((new[c] if c in new else F.col(f"rest.columns.`{c}`")).alias(c) for c in docs.columns))
