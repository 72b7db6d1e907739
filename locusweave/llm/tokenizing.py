"""Encoding of texts with a public byte-level vocabulary by forced-boundary splitting.

A pair of neighbouring bytes that occurs inside no vocabulary token lies on a token boundary in
every encoding, since each merge yields a token. Cutting there leaves fragments that encode
independently, and their ids, put one after the other, are the ids of the text. Words of a
corpus repeat, so most fragments of a batch are known already and only new ones are encoded.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Known fragments a task keeps; beyond that it starts afresh.
KNOWN = 300_000
#: Bytes of text cut in one go.
CUT_BYTES = 4 << 20

#: White space outside ASCII, as UTF-8 bytes read as one number.
_WIDE_BLANKS = [0xC285, 0xC2A0, 0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080]


def vocabulary_path(name: str = VOCABULARY) -> str:
    """The place of a public tokenizer's file in the installed package."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


class ForcedBoundaryEncoder:
    """Encodes many texts at once. ``path`` is a vocabulary file in tiktoken's layout."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.joined = np.zeros((256, 256), bool)
        for token in ranks:
            b = np.frombuffer(token, np.uint8)
            self.joined[b[:-1], b[1:]] = True
        # The pattern looks at white space on the left and treats an apostrophe as a possible
        # contraction's start, so that no cut is made behind the one or before the other; nor
        # inside a character.
        blank = np.zeros(256, bool)
        blank[[9, 10, 11, 12, 13, 32]] = True
        right = np.arange(256)
        self.joined[blank, :] = True
        self.joined[:, (right == 0x27) | (right & 0xC0 == 0x80)] = True
        self._forget()

    def _forget(self) -> None:
        self.codes = _Fragments(self.encoding)

    def cuts(self, b: np.ndarray) -> np.ndarray:
        """Offsets into the bytes at which a token certainly starts."""
        if len(b) < 2:
            return np.zeros(0, np.int64)
        at = np.flatnonzero(~self.joined[b[:-1], b[1:]])
        wide = at[b[at] >= 0x80]
        if len(wide):
            padded = np.concatenate([np.zeros(2, np.uint32), b.astype(np.uint32)])
            three = (padded[wide] << 16) | (padded[wide + 1] << 8) | padded[wide + 2]
            spaces = np.isin(three, _WIDE_BLANKS) | np.isin(three & 0xFFFF, _WIDE_BLANKS[:2])
            at = np.setdiff1d(at, wide[spaces], assume_unique=True)
        return at + 1

    def fragments(self, text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the fragments of texts that lie one after the other, and each text's number of
        fragments. ``starts`` are the texts' offsets and the end."""
        edge = np.zeros(len(text) + 1, bool)
        edge[self.cuts(text)] = True
        edge[starts] = True
        cut = np.flatnonzero(edge)
        data, edges = text.tobytes(), cut.tolist()
        found = map(self.codes.__getitem__, [data[a:b] for a, b in zip(edges, edges[1:], strict=False)])
        return np.fromiter(found, np.int64, max(0, len(edges) - 1)), np.diff(np.searchsorted(cut, starts))

    def encode(self, texts: pa.Array, lengths_only: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For runs of texts of about ``CUT_BYTES``, one after the other: where each text's ids end,
        from 0 on, and, unless ``lengths_only``, all their ids. A null or empty text has no ids."""
        for offsets, data in _parts(texts):
            if len(self.codes) > KNOWN:
                self._forget()
            codes, pieces = self.fragments(data, offsets)
            begin, size, ids = self.codes.arrays()
            size = size[codes]
            ends = np.concatenate([[0], np.cumsum(size)])
            mine = ends[np.concatenate([[0], np.cumsum(pieces)])]
            yield mine, ids[:0] if lengths_only else ids[np.repeat(begin[codes] - ends[:-1], size) + np.arange(ends[-1])]


class _Fragments(dict):
    """Codes of the fragments met so far; the ids of all of them lie in one flat list."""

    def __init__(self, encoding) -> None:
        super().__init__()
        self.encoding = encoding
        self.ids: list[int] = []
        self.ends = [0]

    def __missing__(self, fragment: bytes) -> int:
        self.ids += self.encoding.encode_ordinary(fragment.decode())
        self.ends.append(len(self.ids))
        code = self[fragment] = len(self.ends) - 2
        return code

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each code's place in the ids, its number of ids, and the ids."""
        ends = np.array(self.ends, np.int64)
        return ends[:-1], np.diff(ends), np.array(self.ids, np.int32)


def _parts(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``CUT_BYTES``: their offsets and bytes. Nulls have no bytes."""
    texts = texts.fill_null("").cast(pa.large_string())
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + CUT_BYTES)))
        hi = min(hi, len(texts))
        yield at[lo : hi + 1] - at[lo], raw[at[lo] : at[hi]]
        lo = hi


@lru_cache(maxsize=2)
def _encoder(path: str | None) -> ForcedBoundaryEncoder:
    return ForcedBoundaryEncoder(path or vocabulary_path())


def encode_texts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids``: the whole text of each document as ids, without special tokens.

    Null and empty texts have an empty array, blank ones are encoded as they are, the strings of
    special tokens are ordinary text. ``path`` is the vocabulary file on every machine; without it
    the installed public package is asked. Columns other than ``doc_id`` and ``text`` are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            at = 0
            for ends, ids in encoder.encode(batch.column(1)):
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(lists)), lists], names=["doc_id", "ids"])
                at += len(lists)

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text").mapInArrow(run, "doc_id bigint, ids array<int>")


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens``: how many ids :func:`encode_texts` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            counts = [np.diff(ends) for ends, _ in encoder.encode(batch.column(1), lengths_only=True)]
            counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text").mapInArrow(run, "doc_id bigint, n_tokens bigint")
