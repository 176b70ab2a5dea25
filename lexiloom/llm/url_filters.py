"""URL filters: a bit-parallel wildcard automaton over canonical URLs.

``compile_rules`` packs all glob rules into one multiword Shift-And machine: a
pattern character is one bit; a set bit means that the pattern matches up to
there.  ``*`` lets its state stay on any byte but '/', ``**`` on any byte.
``verdicts`` advances the machine over all URLs of an Arrow batch at once, one
byte position at a time, so every rule is simulated at the same time.

The host is what stands between the first '://' and the next '/', '?', '#' or
end, with A-Z lower-cased; the path goes on up to '?', '#' or end.  Rules of
hosts and paths see '.' + host + path as it stands: ``net/es/`` becomes the
glob ``*.net/es/**``, so it fits subdomains too.  The globs see the canonical
URL: '.' + host without user, port and closing dot + path with percent escapes
decoded, A-Z lower-cased, '.' and '..' segments resolved, and '/' for an empty
one.

A null URL, or one without '://', has an empty host and path, fits no rule and
gets the verdict for malformed URLs, block.  Among the rules that fit, the one
with the longest text wins, then the first by text.  If none fits, the globs
of the method decide: one that fits blocks, else the URL is allowed.  Repeated
rows are judged each; an empty table gives no rows.  A batch takes as many
steps as its longest URL has bytes, over the URLs that are still that long.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Host and path rules.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Globs of the method for URLs that no rule fits.
GLOBS = (
    "*.ad.*/**", "*.ads.*/**", "*.adserver.*/**", "*.track.*/**", "*.tracking.*/**", "*spam*/**", "*cheap-pills*/**", "*casino*/**", "*.onion/**",
    "**/ads/**", "**/adserver/**", "**/login**", "**/signin**", "**/logout**", "**/cart/**", "**/checkout/**", "**/wp-admin/**", "**/cgi-bin/**",
    "**.exe", "**.msi", "**.apk", "**.dmg", "**.zip", "**.rar", "**.7z", "**.tar.gz", "**.iso", "**.mp4", "**.mp3",
)
#: Rules and globs that a table of them may hold; the machine of so many takes some 20 MB.
MOST_RULES = 10_000


_ESCAPE = re.compile(rb"%([0-9A-Fa-f]{2})")


@dataclass
class Machine:
    """Masks of 64-bit words: ``step[byte]`` of states that a byte enters, ``stay[byte]`` of states that it may keep."""

    step: np.ndarray
    stay: np.ndarray
    first: np.ndarray  # states before any byte
    skip: np.ndarray  # states after which a wildcard state is entered without a byte
    last: np.ndarray  # for each rule: its final bit
    words: int


def compile_rules(globs: list[str]) -> Machine:
    """One machine for all globs; each must fit the whole string.

    State 0 of a glob stands before its first character.  A character is a
    state that its byte enters from the state before; a wildcard is a loop on
    the state before it.
    """
    states: list[tuple[set[int], set[int]]] = []  # bytes that enter, bytes that keep
    starts, ends = [], []
    any_byte, no_slash = set(range(256)), set(range(256)) - {ord("/")}
    for glob in globs:
        starts.append(len(states))
        states.append((set(), set()))
        raw, i = glob.encode("utf-8"), 0
        while i < len(raw):
            if raw[i : i + 2] == b"**":
                states[-1][1].update(any_byte)
                i += 2
            elif raw[i : i + 1] == b"*":
                states[-1][1].update(no_slash)
                i += 1
            else:
                states.append(({raw[i]}, set()))
                i += 1
        ends.append(len(states) - 1)
    words = max(1, -(-len(states) // 64))
    step, stay = np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64)
    for n, (enter, keep) in enumerate(states):
        bit = np.uint64(1) << np.uint64(n % 64)
        step[sorted(enter), n // 64] |= bit
        stay[sorted(keep), n // 64] |= bit

    def mask(which: list[int]) -> np.ndarray:
        out = np.zeros(words, np.uint64)
        for n in which:
            out[n // 64] |= np.uint64(1) << np.uint64(n % 64)
        return out

    return Machine(step, stay, mask(starts), mask(starts), np.array(ends), words)


def simulate(machine: Machine, texts: list[bytes]) -> np.ndarray:
    """For each text (row) and glob (column): whether the glob fits the whole text."""
    sizes = np.array([len(t) for t in texts], int)
    order = np.argsort(-sizes, kind="stable")  # the longest first, so that ended texts leave at the end
    raw = np.frombuffer(b"".join(texts), np.uint8)
    begins = (np.cumsum(sizes) - sizes)[order]
    sizes = sizes[order]
    state = np.repeat(machine.first[None, :], len(texts), axis=0)
    live, at = int(np.count_nonzero(sizes)), 0
    while live:
        byte = raw[begins[:live] + at]
        now = state[:live]
        moved = now << np.uint64(1)
        if machine.words > 1:
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
        moved &= machine.step[byte]  # the state before a glob's first has no entering byte in the next glob's state 0
        moved |= now & machine.stay[byte]
        state[:live] = moved
        at += 1
        while live and sizes[live - 1] <= at:
            live -= 1
    fits = (state[:, machine.last // 64] >> (machine.last % 64).astype(np.uint64)) & np.uint64(1)
    out = np.zeros(fits.shape, bool)
    out[order] = fits.astype(bool)
    return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both are empty for a null url or one without '://'."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://(.*)\z", 1)
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def canonical(host: str, path: str) -> bytes:
    """What the globs see; empty for a malformed URL."""
    if not (host or path):
        return b""
    host = re.sub(r":[0-9]*$", "", host.rpartition("@")[2]).removesuffix(".")
    raw = _ESCAPE.sub(lambda m: bytes([int(m[1], 16)]), path.encode("utf-8", "surrogatepass")).lower()  # bytes.lower changes A-Z only
    out: list[bytes] = []
    segments = raw.split(b"/")[1:]
    for segment in segments:
        if segment == b"..":
            del out[-1:]
        elif segment != b".":
            out.append(segment)
    if segments and segments[-1] in (b".", b".."):
        out.append(b"")
    return b"." + host.encode("utf-8", "surrogatepass") + b"/" + b"/".join(out)


def load_rules(table: DataFrame) -> tuple[tuple[tuple[str, str], ...], tuple[str, ...]]:
    """Rules and globs of a table (kind: rule or glob; pattern; verdict of a rule), for ``verdicts``; too large a table is refused."""
    rows = table.select("kind", "pattern", "verdict").distinct().limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return tuple(sorted((r.verdict, r.pattern) for r in rows if r.kind == "rule")), tuple(sorted(r.pattern for r in rows if r.kind == "glob"))


def host_glob(rule: str) -> str:
    """The glob of a host and path rule, over '.' + host + path; '*' keeps to the host."""
    return f"*.{rule}**"


def verdicts(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, globs: tuple[str, ...] = GLOBS, key: str = "page_id") -> DataFrame:
    """key, host, path, rule, verdict and the method's glob (null if none fits) for every row."""
    host, path = host_and_path(F.col("url"))
    ranked = sorted(range(len(rules)), key=lambda k: (-len(rules[k][1].encode()), rules[k][1]))
    machine, method = compile_rules([host_glob(rules[k][1]) for k in ranked]), compile_rules(list(globs))
    names = [rules[k][1] for k in ranked]
    effects = [rules[k][0] for k in ranked]
    names_ = ("host", "path", "rule", "verdict", "glob")
    schema = T.StructType([pages.schema[key], *(T.StructField(n, T.StringType()) for n in names_)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            fits = simulate(machine, [f".{h}{p}".encode() if h or p else b"" for h, p in zip(hosts, paths, strict=True)])
            block = simulate(method, [canonical(h, p) for h, p in zip(hosts, paths, strict=True)])
            rule, verdict, glob = [], [], []
            for row, also, h, p in zip(fits, block, hosts, paths, strict=True):
                own = int(np.argmax(row)) if row.any() else None
                other = int(np.argmax(also)) if also.any() else None
                rule.append(None if own is None else names[own])
                glob.append(None if other is None else globs[other])
                verdict.append(effects[own] if own is not None else "block" if other is not None or not (h or p) else "allow")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *(pa.array(x, pa.string()) for x in (rule, verdict, glob))], [key, *names_])

    return pages.select(key, host.alias("host"), path.alias("path")).mapInArrow(run, schema)
