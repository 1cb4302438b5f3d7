"""Token counts of a text's sections by offset-mapped attribution.

A text is encoded whole and once, so its tokens are those that training sees. The byte spans of its tokens are then joined
with the byte spans of its sections, and a token that reaches over a boundary is allotted by an explicit rule.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.llm.ngrams import pieces
from locusflow.llm.worker import claim
from locusflow.session import prepare_workers

#: Where a token goes that lies in several sections: to the one with its first byte, its last byte, or most of its bytes
#: (the first of those that tie).
RULES = ("first", "last", "most")
#: Runs of white space (as the tokenizer's pattern knows it) that are too long for the pattern's own search.
_LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{50000,}")


class ByteTokenizer:
    """Ids and byte lengths of the tokens of texts, by a public byte-level vocabulary."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.lengths[i] = len(token)

    def ids(self, text: str) -> list[int]:
        """The ids of a whole text.

        The pattern makes one piece of a run of white space, but for its last character if something follows. On very
        long runs its search fails, so they are cut out the same way and merged as pieces by themselves.
        """
        out, at = [], 0
        for m in _LONG_SPACE.finditer(text):
            stop = m.end() - (m.end() < len(text))
            out += self.encoding.encode_ordinary(text[at : m.start()])
            out += self.encoding._encode_single_piece(text[m.start() : stop].encode())
            at = stop
        return out + self.encoding.encode_ordinary(text[at:]) if at else self.encoding.encode_ordinary(text)

    def ends(self, text: str) -> np.ndarray:
        """The byte where each token ends."""
        return np.cumsum(self.lengths[np.array(self.ids(text), np.int64)])


_tokenizers: dict[str, ByteTokenizer] = {}


def byte_tokenizer(path: str) -> ByteTokenizer:
    """One tokenizer for each path and Python worker."""
    if path not in _tokenizers:
        _tokenizers[path] = ByteTokenizer(path)
    return _tokenizers[path]


def lines_of(data: np.ndarray) -> np.ndarray:
    """Ends of a text's lines, each with its line feed; a text without one is one line, an empty text too."""
    ends = np.flatnonzero(data == 10) + 1
    return ends if len(ends) and ends[-1] == len(data) else np.append(ends, len(data))


def attribute(token_ends: np.ndarray, section_ends: np.ndarray, rule: str = "first") -> tuple[np.ndarray, np.ndarray]:
    """(tokens of each section, tokens that reach over its end) for sections that follow one another from 0 on."""
    n = len(section_ends)
    begins = np.concatenate([[0], token_ends[:-1]]) if len(token_ends) else token_ends
    first = np.searchsorted(section_ends, begins, side="right")
    last = np.searchsorted(section_ends, token_ends - 1, side="right")
    crossing = np.bincount(first[first != last], minlength=n)
    if rule == "first":
        owner = first
    elif rule == "last":
        owner = last
    else:
        owner = first.copy()
        starts = np.concatenate([[0], section_ends[:-1]])
        for t in np.flatnonzero(first != last):
            inside = range(first[t], last[t] + 1)
            shares = [min(token_ends[t], section_ends[s]) - max(begins[t], starts[s]) for s in inside]
            owner[t] = inside[int(np.argmax(shares))]
    return np.bincount(owner, minlength=n), crossing


def field_tokens(docs: DataFrame, tokenizer_path: str, fields: list[str], id_col: str = "doc_id", separator: str = "\n", rule: str = "first") -> DataFrame:
    """One row per row and field: (id_col, field, n_tokens, n_crossing, doc_tokens).

    The fields of a row (title, body, turns) are one text, with the separator between them, which is encoded once; a
    separator belongs to the field before it. A null field is empty, and so are all in a row without text. Rules for
    tokens, nulls and repeated rows as in :func:`section_tokens`; no rows give no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    prepare_workers(docs.sparkSession)
    columns = [F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("")).alias(f"f{i}") for i, f in enumerate(fields)]
    source = docs.select(F.col(id_col).alias("id"), F.struct(*columns).alias("fields"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("token_counts", _tokenizers.clear)
        tokenizer = byte_tokenizer(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                counts, crossing, totals = [], [], []
                for row in part.column(1).to_pylist():
                    texts = list(row.values())
                    texts = [t + separator for t in texts[:-1]] + texts[-1:]
                    ends = np.cumsum([len(t.encode()) for t in texts])
                    tokens = tokenizer.ends("".join(texts))
                    n, over = attribute(tokens, ends, rule)
                    counts.append(n)
                    crossing.append(over)
                    totals += [len(tokens)] * len(texts)
                keys = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), len(fields))))
                yield pa.RecordBatch.from_arrays([keys, pa.array(fields * part.num_rows), *(pa.array(np.concatenate(x).astype(np.int64)) for x in (counts, crossing)), pa.array(totals, pa.int64())], ["id", "field", "n_tokens", "n_crossing", "doc_tokens"])

    out = source.mapInArrow(run, f"id {kind}, field string, n_tokens long, n_crossing long, doc_tokens long")
    return out.withColumnRenamed("id", id_col)


def section_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", rule: str = "first") -> DataFrame:
    """One row per line of each text: (id_col, section, char_start, char_end, n_tokens, n_crossing, doc_tokens).

    section counts from 0; char_start and char_end are in code points, the line feed belongs to its line. n_tokens adds up
    to doc_tokens, the tokens of the whole text. n_crossing counts tokens that begin in the section and end in another.
    Null and empty texts have one empty section without tokens. Repeated rows and null ids are rows like others; other
    columns are ignored; no rows give no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    prepare_workers(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    names = ["id", "section", "char_start", "char_end", "n_tokens", "n_crossing", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("token_counts", _tokenizers.clear)
        tokenizer = byte_tokenizer(tokenizer_path)
        for batch in batches:
            for some in pieces(batch, 1):
                yield part(tokenizer, some)

    def part(tokenizer: ByteTokenizer, batch: pa.RecordBatch) -> pa.RecordBatch:
        owner, columns = [], [[] for _ in names[1:]]
        for i, text in enumerate(batch.column(1).to_pylist()):
            data = np.frombuffer(text.encode(), np.uint8)
            tokens = tokenizer.ends(text)
            ends = lines_of(data)
            counts, crossing = attribute(tokens, ends, rule)
            # Code points up to each byte: those bytes that don't continue a character.
            points = ends if len(data) == len(text) else np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[ends]
            n = len(ends)
            owner.append(np.full(n, i))
            for column, x in zip(columns, (np.arange(n), np.concatenate([[0], points[:-1]]), points, counts, crossing, np.full(n, len(tokens))), strict=True):
                column.append(x)
        keys = batch.column(0).take(pa.array(np.concatenate(owner)))
        return pa.RecordBatch.from_arrays([keys, *(pa.array(np.concatenate(c).astype(np.int64)) for c in columns)], names)

    out = source.mapInArrow(run, f"id {kind}, section long, char_start long, char_end long, n_tokens long, n_crossing long, doc_tokens long")
    return out.withColumnRenamed("id", id_col)
