"""Secret scan: known shapes, and strings that a tokenizer cannot compress.

Base kinds are found by pattern, leftmost and without overlap per kind: ``assign`` (a
keyword, ``:`` or ``=``, and a value of six characters or more), ``access`` (key ids that
begin with AKIA) and ``hex`` (24 hex digits or more). A match that is too short is
dropped, but what it covered stays covered.

Token-efficiency test (kind ``random``): words of a language take few tokens, a random
string takes many, because no merge was learned for it. Every run of ``MIN_RUN`` or more
characters of the base64 and identifier alphabets is encoded with a tiktoken vocabulary;
fewer than ``max_ratio`` characters for a token expose it as random. Before that, runs
are excluded that are digests of a known length (hex digits only), UUIDs, or identifiers:
runs without a letter, and names whose parts, cut at ``_``, ``-``, ``/``, ``+``, ``=`` and
changes of case, are words with at most a short number at their end. What looks like one word
or several but is ``MIN_RUN`` characters long without a cut (letters of one case, base32) is
taken for a name only if the vocabulary compresses it; letters of one case, of which some
pairs and triples are tokens by chance, have to reach ``LETTER_RATIO``. Of a run that
touches base spans, what lies outside them is tested.

A readable name before or after a secret (``session_cookie_value=...``) lowers the ratio of
the whole run. A run that is not exposed as a whole is therefore cut at ``=``, then at
``/``, then at ``_`` and ``-``: names at its ends and between its parts are left out, and
the rest and its single parts are tested alike, as long as they have ``MIN_RUN`` characters.

Documents are read as whole texts, one by one, in Arrow batches; the vocabulary goes out
as a broadcast of its file's bytes (size checked in :mod:`voltframe.llm.bpe`). Nothing is
shuffled and tasks hold no state.

Edge cases: a null text is empty and has no spans. Positions are code points, end
exclusive. Repeated rows are scanned each. An empty table gives no rows. Input columns
named like a result column are replaced; others pass through.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from voltframe.llm.bpe import load_ranks

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # every shorter run would be dropped, and runs do not overlap
MIN_RUN = 20
MAX_RATIO = 2.0
LETTER_RATIO = 2.2  # of letters of one case
_RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_RUN},}}")
_DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
DIGEST_DIGITS = frozenset((32, 40, 48, 56, 64, 96, 128))
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
_UUID_IN = re.compile(r"(?<![0-9a-zA-Z])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![0-9a-zA-Z])")
_WORD_PART = re.compile(r"(?:[A-Z]?[a-z]{3,}|[A-Z]{2,})\d{0,4}|\d{1,4}|[a-z]{1,2}|[A-Z]")
_CUT = re.compile(r"[_\-/+=]+")
#: Parts of a run, level by level; the padding of a last part stays with it.
_PARTS = (re.compile(r"[^=]+(?:=+\Z)?"), re.compile(r"[^/]+"), re.compile(r"[^_-]+"))

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Spans of the base kinds, by start, then kind."""
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m.group(1)) >= 6]
    found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _too_many_tokens(run: str, encode, max_ratio: float) -> bool:
    """Whether the vocabulary needs many tokens for a run."""
    limit = max(max_ratio, LETTER_RATIO) if run.isalpha() and (run.islower() or run.isupper()) else max_ratio
    return len(run) < limit * len(encode(run))


def is_known(run: str, encode, max_ratio: float = MAX_RATIO) -> bool:
    """Whether a run is a digest of a known length or an identifier."""
    if _UUID.match(run) or (len(run) in DIGEST_DIGITS and _DIGEST.match(run)):
        return True
    if not re.search(r"[A-Za-z]", run):
        return True
    return _is_name(run, not re.search(r"[0-9]", run), encode, max_ratio)


def _is_name(run: str, short: bool, encode, max_ratio: float) -> bool:
    """Whether every part of a run is made of words with numbers, with at least five
    characters to each word on average; ``short``: or no part has more than one word. A part as
    long as a secret has to compress as well."""
    parts = [p for p in _CUT.split(run) if p]
    pieces = [_WORD_PART.findall(p) for p in parts]
    # A long part must pass by itself: the other parts' words do not make up for it.
    if any("".join(x) != p or (len(p) >= MIN_RUN and len(x) * 5 > len(p)) for x, p in zip(pieces, parts)):
        return False
    if not (sum(map(len, pieces)) * 5 <= len(run) or (short and all(len(x) == 1 for x in pieces))):
        return False
    return not any(len(p) >= MIN_RUN and _too_many_tokens(p, encode, max_ratio) for p in parts)


def _exposed(text: str, start: int, end: int, encode, max_ratio: float, level: int = 0) -> list[tuple[int, int]]:
    """The run, or the parts of it, that the vocabulary needs many tokens for."""
    run = text[start:end]
    if len(run) < MIN_RUN or is_known(run, encode, max_ratio):
        return []
    if _too_many_tokens(run, encode, max_ratio):
        return [(start, end)]
    again = lambda spans, k: [x for a, b in spans for x in _exposed(text, start + a, start + b, encode, max_ratio, k)]
    known = _UUID_IN.search(run)
    if known:
        return again([(0, known.start()), (known.end(), len(run))], level)
    for k in range(level, len(_PARTS)):
        parts = [m.span() for m in _PARTS[k].finditer(run)]
        rest: list[list[tuple[int, int]]] = [[]]  # stretches of parts between names
        for a, b in parts:
            if _is_name(run[a:b], True, encode, max_ratio):
                rest.append([])
            else:
                rest[-1].append((a, b))
        rest = [x for x in rest if x]
        if not rest:
            return []
        first, last = rest[0][0][0], rest[-1][-1][1]
        if first > 0 or last < len(run):
            found = again([(first, last)], k)  # without the names at its ends
        elif len(rest) > 1:
            found = again([(x[0][0], x[-1][1]) for x in rest], k)
        elif len(parts) > 1:
            found = again(parts, k + 1)
        else:
            continue
        return found
    return []


def random_spans(text: str, taken: list[Span], encode, max_ratio: float = MAX_RATIO) -> list[Span]:
    """Runs, and parts of runs, that the vocabulary needs many tokens for."""
    found = []
    for m in _RUN.finditer(text):
        at, end = m.span()
        for a, b in [*sorted((a, b) for _, a, b in taken if a < end and at < b), (end, end)]:
            if a > at:
                found += [("random", *x) for x in _exposed(text, at, a, encode, max_ratio)]
            at = max(at, b)
    return found


_ENCODERS: dict[str, object] = {}


def _encoder(raw: bytes, pattern: str):
    """The worker's tiktoken encoder (built once for each Python worker)."""
    key = hashlib.sha256(raw + pattern.encode()).hexdigest()
    if key not in _ENCODERS:
        import tiktoken

        _ENCODERS.clear()
        _ENCODERS[key] = tiktoken.Encoding("scan", pat_str=pattern, mergeable_ranks=load_ranks(raw), special_tokens={}).encode_ordinary
    return _ENCODERS[key]


def scan(docs: DataFrame, vocabulary: bytes, pattern: str, text_col: str = "text", max_ratio: float = MAX_RATIO) -> DataFrame:
    """``docs`` without the text, plus ``spans``: array of (kind, start, end), by start, then kind."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kept = [f for f in docs.schema if f.name != text_col and f.name.lower() != "spans"]
    names = [f.name for f in kept]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(sent.value, pattern)
        for batch in batches:
            out = []
            for value in batch.column(text_col):
                text = value.as_py() or ""
                base = base_spans(text)
                spans = sorted(base + random_spans(text, base, encode, max_ratio), key=lambda s: (s[1], KINDS.index(s[0])))
                out.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(out, kind)], names=[*names, "spans"])

    item = T.StructType().add("kind", T.StringType()).add("start", T.IntegerType()).add("end", T.IntegerType())
    return docs.mapInArrow(run, T.StructType([*kept, T.StructField("spans", T.ArrayType(item))]))
