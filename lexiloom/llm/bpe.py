"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

``encode`` splits a text by the pattern, merges each match by the ranks and
adds an ``ids`` column; ``decode`` turns ids into raw bytes.  Long texts are
encoded piece by piece; the cuts lie where no match of the pattern can cross
them (see ``safe_pieces``), so the ids equal those of the whole text.  Runs of
white space of ``LONG`` characters or more, over which the library's matching
of a pattern fails at about a million, are matched here and only merged there
(see ``white_runs``).

Nulls and empty texts have no ids and decode to no bytes; null ids decode to
null.  All other columns, of whatever name, pass through, except that columns
called like the output are replaced.  Repeated rows are encoded each; an empty
table gives no rows, and ties do not occur.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a piece, roughly; longer texts are cut.
PIECE = 1 << 16
#: Bytes of text, or of ids, that go into one Arrow batch of results.
BATCH = 1 << 20

#: Characters of white space that are matched without the library.
LONG = 4096

_cut = re.compile(r"(?<=[A-Za-z0-9])(?=[ \n])")
#: The white space of the library's patterns, and how a pattern must end to treat it as ``white_runs`` does.
WHITE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
WHITE_END = r"|\s+(?!\S)|\s+"


def safe_pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Pieces whose encodings, joined, are the encoding of the text.

    A cut lies between an ASCII letter or digit and a space or line feed.  A
    run of letters or digits ends there anyway, its end does not depend on
    what follows, and a match never looks back, so matches are the same on
    both sides.  Text without such a place stays in one piece.
    """
    at = 0
    while len(text) - at > size:
        found = _cut.search(text, at + size)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def white_runs(text: str, long: int = LONG) -> Iterator[tuple[str, bool]]:
    """The text in parts, each with whether it is one match as a whole: those of long runs of white space.

    For patterns that take white space by ``WHITE_END`` only, or as the one
    space before a word: a run starts a match, which reaches to its end where
    the text ends, and else leaves its last character to what follows.
    """
    at = 0
    for run in re.finditer(f"{WHITE}{{{max(long, 2)},}}", text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        if run.start() > at:
            yield text[at : run.start()], False
        yield text[run.start() : end], True
        at = end
    if at < len(text):
        yield text[at:], False


def read_ranks(path: str) -> bytes:
    """The rank file's bytes, read on the driver and sent with the function."""
    with open(path, "rb") as f:
        return f.read()


@functools.lru_cache(maxsize=4)
def encoding(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines()) if token}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def encode_text(text: str | None, ranks: bytes, pattern: str) -> list[int]:
    if not text:
        return []
    own = encoding(ranks, pattern)
    if len(text) <= PIECE:
        return own.encode_ordinary(text)
    if not pattern.endswith(WHITE_END) or r"\s" in pattern.removesuffix(WHITE_END).replace(r"[^\s", ""):
        return [i for piece in safe_pieces(text) for i in own.encode_ordinary(piece)]
    parts = (part for piece in safe_pieces(text) for part in white_runs(piece))
    return [i for part, whole in parts for i in (own._encode_single_piece(part.encode()) if whole else own.encode_ordinary(part))]


def _slices(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` in size each."""
    start = total = end = 0
    for size in sizes:
        if end > start and total + size > most:
            yield start, end
            start, total = end, 0
        total += size
        end += 1
    if end > start:
        yield start, end


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the token ids of column ``text``, as array<int>."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))  # a fixed file of about 1 MB
    kept = docs.drop(ids)
    schema = kept.withColumn(ids, F.array().cast("array<int>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            sizes = (len(t.as_buffer()) if t.is_valid else 0 for t in texts)
            for a, b in _slices(sizes, BATCH):
                part = batch.slice(a, b - a)
                found = [encode_text(t, ranks.value, pattern) for t in texts.slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.list_(pa.int32()))], [*part.schema.names, ids])

    return kept.mapInArrow(run, schema)


def decode(docs: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """docs with the raw bytes of column ``ids``; they need not be valid UTF-8."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    kept = docs.drop(decoded)
    schema = kept.withColumn(decoded, F.lit(None).cast("binary")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            own = encoding(ranks.value, pattern)
            sizes = (len(x.values) * 4 if x.is_valid else 0 for x in column)
            for a, b in _slices(sizes, BATCH):
                part = batch.slice(a, b - a)
                found = [None if x is None else own.decode_bytes(x) for x in column.slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.binary())], [*part.schema.names, decoded])

    return kept.mapInArrow(run, schema)


def round_trip_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text."""
    coded = decode(encode(docs.select("doc_id", "text"), ranks_path, pattern).drop("text"), ranks_path, pattern)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
