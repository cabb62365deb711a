"""Byte-level BPE encoding and decoding of whole texts, long ones in overlapping chunks.

A text up to chunk_chars long is encoded where it is read. A longer one is cut
into chunks that overlap; the chunks are dealt out and pre-tokenised in
parallel, each from its own start. Two neighbours resynchronise at the first
boundary in their overlap that both have: from there on the pattern, which
never looks back, gives the same pre-tokens to both. The text between such
boundaries is then dealt out again and encoded piece by piece, and the ids are joined in order.
Where an overlap holds no common boundary (one word longer than the overlap),
the left chunk runs on through the next one until a boundary is met, so the
result is that of the whole text in every case.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codec import encoding, packed
from .common import text_of

CHUNK_CHARS, OVERLAP_CHARS = 32_768, 512
SCHEMA = "doc_id bigint, ids binary, decoded binary"


@lru_cache(maxsize=4)
def _pattern(pattern: str):
    import regex

    return regex.compile(pattern)


def boundaries(text: str, pattern: str) -> np.ndarray:
    """Where pre-tokens begin, 0 aside, if the character before is no white space.

    Only such places are told: after white space the pattern's lookahead could
    have seen more than a cut-off text shows.
    """
    starts = [m.start() for m in _pattern(pattern).finditer(text)]
    return np.array([i for i in starts[1:] if not text[i - 1].isspace()], dtype=np.int64)


def chunked(frames: Iterator[pd.DataFrame], chunk: int, overlap: int) -> Iterator[pd.DataFrame]:
    """Cut texts into chunks of which each begins overlap characters before the last one's end."""
    step = chunk - overlap
    for frame in frames:
        for row, doc_id, text in zip(frame["row"], frame["doc_id"], frame["text"], strict=True):
            places = range(0, max(1, len(text) - overlap), step)
            yield pd.DataFrame({"row": row, "doc_id": doc_id, "start": list(places), "text": [text[i : i + chunk] for i in places]}).astype({"doc_id": "Int64"})


def pretokenised(frames: Iterator[pd.DataFrame], pattern: str) -> Iterator[pd.DataFrame]:
    """Add each chunk's own boundaries, as packed 32-bit offsets from its start."""
    for frame in frames:
        yield frame.assign(cuts=[boundaries(text, pattern).astype("<u4").tobytes() for text in frame["text"]])


def stitched(starts: list[int], texts: list[str], cuts: list[np.ndarray], pattern: str) -> list[str]:
    """Texts between common boundaries of neighbours; joined they are the whole text.

    starts, texts, cuts: of one document's chunks, in order.
    """
    segments, begin, at, text, own = [], 0, starts[0], texts[0], cuts[0]
    for start, more, theirs in zip(starts[1:], texts[1:], cuts[1:], strict=True):
        end = at + len(text)
        here = own[own > max(begin, start) - at] + at
        common = np.intersect1d(here, theirs + start)
        common = common[common < end]  # what both saw with characters after it
        if len(common):
            cut = int(common[0])
            segments.append(text[begin - at : cut - at])
            begin, at, text, own = cut, start, more, theirs
        else:  # no common boundary: go on with one longer chunk
            text = text[begin - at :] + more[end - start :]
            at, own = begin, boundaries(text, pattern)
    return [*segments, text[begin - at :]]


def _encoded(doc_ids, id_lists: list[list[int]], coder) -> pd.DataFrame:
    return pd.DataFrame({"doc_id": pd.array(doc_ids, dtype="Int64"), "ids": [packed(ids) for ids in id_lists], "decoded": [coder.decode_bytes(ids) for ids in id_lists]})


def encode_whole(frames: Iterator[pd.DataFrame], path: str, pattern: str) -> Iterator[pd.DataFrame]:
    coder = encoding(path, pattern)
    for frame in frames:
        for i in range(0, len(frame), 64):
            part = frame.iloc[i : i + 64]
            yield _encoded(part["doc_id"], [coder.encode_ordinary(text) for text in part["text"]], coder)


def cut_at_common(chunks: pd.DataFrame, pattern: str) -> pd.DataFrame:
    """The stitched pieces of one document from all its chunks."""
    chunks = chunks.sort_values("start", kind="stable")
    pieces = stitched(chunks["start"].tolist(), chunks["text"].tolist(), [np.frombuffer(x, "<u4").astype(np.int64) for x in chunks["cuts"]], pattern)
    return pd.DataFrame({"row": chunks["row"].iloc[0], "doc_id": chunks["doc_id"].iloc[0], "n": range(len(pieces)), "text": pieces}).astype({"doc_id": "Int64"})


def encode_pieces(frames: Iterator[pd.DataFrame], path: str, pattern: str) -> Iterator[pd.DataFrame]:
    coder = encoding(path, pattern)
    for frame in frames:
        for i in range(0, len(frame), 64):
            part = frame.iloc[i : i + 64]
            yield _encoded(part["doc_id"], [coder.encode_ordinary(text) for text in part["text"]], coder).assign(row=part["row"].to_numpy(), n=part["n"].to_numpy())


def joined(pieces: pd.DataFrame) -> pd.DataFrame:
    """The ids and bytes of one document from those of its pieces."""
    pieces = pieces.sort_values("n", kind="stable")
    return pd.DataFrame({"doc_id": pieces["doc_id"].iloc[:1].astype("Int64"), "ids": [b"".join(pieces["ids"])], "decoded": [b"".join(pieces["decoded"])]})


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, then=None, schema: str = SCHEMA, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """Per row of docs: doc_id, ids (uint32 little-endian) and decoded, the bytes that the ids stand for.

    A null text counts as empty and gives no ids. Rows are independent: repeated
    rows and repeated or null doc_ids give one row each. Columns other than
    doc_id and text are ignored. then: a function from such a frame to another
    of the given schema, applied where the ids are made, so that a digest need
    not carry them further.
    """
    then = then or (lambda frame: frame)
    rows = text_of(docs)
    short = rows.where(F.length("text") <= chunk_chars).mapInPandas(lambda frames: map(then, encode_whole(frames, ranks_path, pattern)), schema)
    long = rows.where(F.length("text") > chunk_chars).withColumn("row", F.monotonically_increasing_id())
    chunks = long.mapInPandas(partial(chunked, chunk=chunk_chars, overlap=overlap_chars), "row bigint, doc_id bigint, start bigint, text string").repartition("row", "start")
    cut = chunks.mapInPandas(partial(pretokenised, pattern=pattern), "row bigint, doc_id bigint, start bigint, text string, cuts binary")
    pieces = cut.groupBy("row").applyInPandas(lambda frame: cut_at_common(frame, pattern), "row bigint, doc_id bigint, n int, text string").repartition("row", "n")
    ids = pieces.mapInPandas(partial(encode_pieces, path=ranks_path, pattern=pattern), SCHEMA + ", row bigint, n int")
    return short.union(ids.groupBy("row").applyInPandas(lambda frame: then(joined(frame)), schema))


def digests(frame: pd.DataFrame) -> pd.DataFrame:
    """Lengths and digests in the place of ids and bytes."""
    sha = lambda parts: [hashlib.sha256(x).hexdigest() for x in parts]
    return pd.DataFrame({"doc_id": frame["doc_id"], "n_tokens": [len(x) // 4 for x in frame["ids"]], "ids_sha256": sha(frame["ids"]), "decoded_sha256": sha(frame["decoded"])})


DIGEST_SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
