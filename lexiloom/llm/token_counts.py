"""Token counts: batch encoding in Arrow functions that return lengths only.

A text is cut into segments at safe boundaries: before a run of white space
that follows a character which is not white space.  No match of a byte-level
pre-tokeniser crosses such a place, and no special string holds white space,
so a text's count is the sum over its segments.  Each distinct segment is
encoded once per worker, in batches balanced by bytes; lengths of earlier
batches are kept in a table of bounded size.

Tokenizers that are not known to cut there count whole texts (see
``cuts_at_space``).

A null text counts as empty: 0 bytes, 0 tokens.  An empty table gives no rows,
ties do not occur, and other columns are ignored, whatever their names.  Texts with rare kinds of
white space, on which regular expression engines disagree, are encoded whole
or in the pieces of ``bpe.safe_pieces``.  Repeated rows are counted each.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import safe_pieces

#: Bytes of distinct segments in one call of the library.
CALL_BYTES = 1 << 20
#: Lengths that a worker keeps, and the longest segment whose length is kept.
KEPT, KEPT_CHARS = 600_000, 64

_segments = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
_rare_space = re.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")


@functools.lru_cache(maxsize=2)
def _library(model: bytes, kind: str):
    """A function from a list of texts to the list of their token counts."""
    if kind == "sentencepiece":
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_proto=model)
        return lambda texts: [len(x) for x in own.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_str(model.decode("utf-8"))
    own.no_truncation()
    own.no_padding()
    return lambda texts: [len(x) for x in own.encode_batch_fast(texts, add_special_tokens=False)]


def _calls(segments: list[str], most: int = CALL_BYTES) -> Iterator[list[str]]:
    """Lists of segments of about equal bytes; sorted by size, so that like goes with like."""
    batch, total = [], 0
    for x in sorted(segments, key=len):
        batch.append(x)
        total += len(x) if x.isascii() else len(x.encode("utf-8", "surrogatepass"))
        if total >= most:
            yield batch
            batch, total = [], 0
    if batch:
        yield batch


def cuts_at_space(model: bytes) -> bool:
    """Whether a tokenizer file is known to cut texts where white space follows other characters.

    That holds for pre-tokenisers made of byte levels and removing or isolating
    patterns which add no space before a text, whose normaliser changes no
    such place, and whose special strings hold and take up no white space.
    Other tokenizers count whole texts.
    """
    made = json.loads(model)
    steps = lambda x, many: [] if x is None else x[many] if x["type"] == "Sequence" else [x]
    before, normal = steps(made.get("pre_tokenizer"), "pretokenizers"), steps(made.get("normalizer"), "normalizers")
    level = [x for x in before if x["type"] == "ByteLevel"]
    space_only = all(x["type"] in ("NFC", "Lowercase") or (x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"} and x["content"] == " ") for x in normal)
    splits = all(x["type"] == "Split" and x["behavior"] in ("Removed", "Isolated") for x in before if x["type"] != "ByteLevel")
    special = all(not (t["lstrip"] or t["rstrip"]) and not re.search(r"\s", t["content"]) for t in made.get("added_tokens", []))
    return bool(level) and not any(x["add_prefix_space"] for x in level) and space_only and splits and special


class Counter:
    """Counts the tokens of texts with one library object per worker."""

    def __init__(self, model: bytes, kind: str):
        self.count = _library(model, kind)
        self.whole = kind == "sentencepiece" or not cuts_at_space(model)
        self.known: dict[str, int] = {}

    def segments(self, text: str) -> list[str]:
        if self.whole:
            return [text]
        if _rare_space.search(text):
            return list(safe_pieces(text))
        return _segments.findall(text)

    def counts(self, texts: list[str]) -> list[int]:
        split = [self.segments(t) for t in texts]
        if len(self.known) > KEPT:
            self.known.clear()
        now, long = self.known, {}
        for call in _calls([s for s in {s for parts in split for s in parts} if s not in now]):
            for s, n in zip(call, self.count(call), strict=True):
                (now if len(s) <= KEPT_CHARS else long)[s] = n
        return [sum(now[s] if s in now else long[s] for s in parts) for parts in split]


@functools.lru_cache(maxsize=2)
def counter(model: bytes, kind: str) -> Counter:
    return Counter(model, kind)


def count_tokens(docs: DataFrame, model_path: str, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row."""
    kind = "sentencepiece" if model_path.endswith(".model") else "tokenizers"
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())  # a fixed file of 0.5 to 2 MB
    schema = T.StructType([docs.schema[key], *(T.StructField(n, t) for n, t in (("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = 256  # rows at a time bound what is held besides the batch
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                texts = [t or "" for t in part.column(1).to_pylist()]
                sizes = [len(t.encode("utf-8")) for t in texts]
                tokens = counter(model.value, kind).counts(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens])], [key, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(key, text).mapInArrow(run, schema)
