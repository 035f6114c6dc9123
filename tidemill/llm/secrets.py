"""Secret scans: fixed patterns, and a battery of randomness tests on everything else.

Base spans come from three patterns, each matched leftmost and without overlaps over the whole
text; matches that are too short are dropped after they have consumed their characters.

The method adds spans of kind ``random``. A part is a maximal run of letters, digits and ``+ / _ -``
of 20 characters or more, with the ``=`` that pad it at the end of a token; any other ``=`` cuts, as
in NAME=key. Candidates are the part and what is left of it when it is cut at ``- _``, at ``+ /`` or
at all four (keys in paths and after prefixes), each of 20 characters or more, overlapping no base
span and held by one alphabet. That is the smallest that holds all its characters (padding aside):
hexadecimal, base 32, base 62 or base 64 of either kind. Three tests follow on the characters'
places in that alphabet:

* chi-squared for uniformity, over up to 16 equal classes of the alphabet (fewer when short);
* the number of runs above and below the middle of the alphabet (Wald and Wolfowitz);
* serial correlation of neighbours at lag one.

Under "random", the three give p-values that Fisher's method combines; a candidate that the
combination rejects at ``LEAST_RANDOM`` is structured and stays out. What remains is tested against
"ordinary": an ordinary token of n characters departs from uniformity by ``ORDINARY`` chi-squared
units for each character, so its statistic is noncentral with noncentrality n * ORDINARY, and its
p-value is the chance of a statistic as low as the one observed. Short candidates cannot reach small
p-values, so length counts by itself. The p-value of a candidate is multiplied by the number of its
part's candidates. A part stands for its longest candidates at ``FALSE_DISCOVERY`` or less that do not
overlap, or else for its best one. All of these in a document form one family, held at a
false-discovery rate of ``FALSE_DISCOVERY`` by the weighted procedure of Benjamini and Hochberg, with
weights in proportion to length and mean one. A candidate also needs a letter and a digit, as words
and numbers are no keys.

Rows are independent: one pass, no shuffle. A null or empty text has no spans. A very long text, or token,
takes time and memory in proportion to its length (candidates are sorted); no part of it is skipped. Repeated rows each
give a row; other columns are ignored or passed along on request.
"""
from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import pick, shelved, ship

#: In the order in which kinds at the same start are listed.
KINDS = ("assign", "access", "hex", "random")
LEAST_RANDOM, ORDINARY, FALSE_DISCOVERY, CANDIDATE_CHARS = 1e-4, 2.0, 0.01, 20
#: Tokens up to this length have their tests remembered in a process.
SHORT = 256

_ANY_CASE = "|".join(
    "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
    for word in ("password", "passwd", "secret", "token", "api_?key")
)
_ASSIGN = re.compile(rf"""({_ANY_CASE})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: The same spans as all runs of these characters, short ones dropped.
_HEX = re.compile(r"[0-9a-f]{24,}")
_PART = re.compile(r"[A-Za-z0-9+/_-]{20,}(?:=+(?![A-Za-z0-9+/_=-]))?")
#: What is left of a part, whole or cut; padding stays with the last piece.
_CUTS = tuple(re.compile(rf"[A-Za-z0-9{inner}]{{20,}}=*") for inner in ("+/_-", "+/", "_-", ""))
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

_ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
_PLACES = {name: {c: i for i, c in enumerate(letters)} for name, letters in _ALPHABETS.items()}
_SETS = {name: frozenset(letters) for name, letters in _ALPHABETS.items()}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start and then kind as listed."""
    spans = []
    folded = text.lower() if text.isascii() else text.translate(_LOWER)
    if any(word in folded for word in _WORDS):
        spans += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if len(m.group()) >= 20]
    spans += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


_LOWER = {c: c + 32 for c in range(65, 91)}


def encoding_of(token: str) -> str | None:
    """The smallest alphabet that holds all characters, or None."""
    have = set(token)
    return next((name for name, letters in _SETS.items() if have <= letters), None)


def _normal_tail(z: float) -> float:
    """Two-sided."""
    return math.erfc(abs(z) / math.sqrt(2))


def _chi_normal(x: float, df: float) -> float:
    """A standard normal deviate for a chi-squared value (Wilson and Hilferty)."""
    return ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))


def battery(token: str) -> tuple[float, float] | None:
    """p-value under "random" and p-value under "ordinary"; None if no encoding fits."""
    return _remembered(token) if len(token) <= SHORT else _battery(token)


@lru_cache(maxsize=1 << 12)
def _remembered(token: str) -> tuple[float, float] | None:
    return _battery(token)


def _battery(token: str) -> tuple[float, float] | None:
    token = token.rstrip("=")
    name = encoding_of(token)
    n = len(token)
    if name is None or n < CANDIDATE_CHARS:
        return None
    size, places = len(_ALPHABETS[name]), _PLACES[name]
    at = [places[c] for c in token]
    # Chi-squared over equal classes, with at least two expected in each.
    classes = max(2, min(16, size, n // 2))
    counts = [0] * classes
    for x in at:
        counts[x * classes // size] += 1
    share = [0] * classes
    for x in range(size):
        share[x * classes // size] += 1
    chi = sum((c - n * s / size) ** 2 / (n * s / size) for c, s in zip(counts, share, strict=True))
    df = classes - 1
    p_chi = 0.5 * math.erfc(_chi_normal(chi, df) / math.sqrt(2))
    # Runs above and below the middle.
    high = [x * 2 >= size for x in at]
    up = sum(high)
    down = n - up
    if up and down:
        runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
        mean = 1 + 2 * up * down / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = _normal_tail((runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)
    # Serial correlation at lag one.
    mid = sum(at) / n
    var = sum((x - mid) ** 2 for x in at)
    r = sum((a - mid) * (b - mid) for a, b in zip(at, at[1:])) / var if var else 1.0
    p_serial = _normal_tail((r + 1 / n) * math.sqrt(n))
    fisher = -2 * sum(math.log(max(p, 1e-300)) for p in (p_chi, p_runs, p_serial))
    p_random = 0.5 * math.erfc(_chi_normal(fisher, 6) / math.sqrt(2))
    # Noncentral chi-squared, by a scaled central one with the same mean and variance.
    far = n * ORDINARY
    scale, df_far = (df + 2 * far) / (df + far), (df + far) ** 2 / (df + 2 * far)
    p_ordinary = 0.5 * math.erfc(-_chi_normal(chi / scale, df_far) / math.sqrt(2))
    return p_random, p_ordinary


def _mixed(token: str) -> bool:
    return any(c.isdigit() for c in token) and any(c.isalpha() for c in token)


class _Marks:
    """Characters of a part that spans cover; asking takes time in proportion to the characters asked about."""

    def __init__(self, start: int, end: int) -> None:
        self.start, self.marks = start, bytearray(end - start)

    def cover(self, at: int, to: int) -> None:
        at, to = max(0, at - self.start), min(len(self.marks), to - self.start)
        self.marks[at:to] = b"\1" * (to - at)

    def free(self, at: int, to: int) -> bool:
        return self.marks.find(1, at - self.start, to - self.start) < 0


def _stand_for(text: str, start: int, end: int, taken: list[tuple[int, int]]) -> list[tuple[float, int, int, int]]:
    """(p-value, length, start, end) of the candidates that stand for a part; none if base spans leave no candidate."""
    marks = _Marks(start, end)
    for s, e in taken:
        marks.cover(s, e)
    spans = {m.span() for cut in _CUTS for m in cut.finditer(text, start, end)}
    spans = [s for s in spans if marks.free(*s)]
    tested = []
    for at, to in spans:
        token = text[at:to]
        tests = battery(token) if _mixed(token) else None
        fit = tests is not None and tests[0] >= LEAST_RANDOM
        tested.append((min(1.0, tests[1] * len(spans)) if fit else 1.0, to - at, at, to))
    found, marks = [], _Marks(start, end)
    for one in sorted(tested, key=lambda c: (-c[1], c[2])):
        if one[0] <= FALSE_DISCOVERY and marks.free(*one[2:]):
            found.append(one)
            marks.cover(*one[2:])
    return found or sorted(tested, key=lambda c: (c[0], -c[1], c[2]))[:1]


def random_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans that the battery adds to ``base`` (sorted by start)."""
    family = []
    # One sweep over parts and base spans. Spans of one kind don't overlap, so few are live before the part's own.
    live: list[tuple[int, int]] = []
    ahead = 0
    for m in _PART.finditer(text):
        start, end = m.span()
        while ahead < len(base) and base[ahead][0] < end:
            live.append(base[ahead][:2])
            ahead += 1
        live = [s for s in live if s[1] > start]
        family += _stand_for(text, start, end, live)
    if not family:
        return []
    mean = sum(f[1] for f in family) / len(family)
    ranked = sorted((p * mean / length, start, end) for p, length, start, end in family)
    last = max((k for k, (p, _, _) in enumerate(ranked, 1) if p <= FALSE_DISCOVERY * k / len(ranked)), default=0)
    return [(start, end, "random") for _, start, end in ranked[:last]]


def all_spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans, each by start and then kind."""
    base = base_spans(text)
    more = random_spans(text, base)
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2]))) if more else base


def written(spans: list[tuple[int, int, str]]) -> str:
    """``kind:start:end``, comma-joined."""
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each stretch covered by spans replaced by ``[SECRET]``."""
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join(out) + text[at:] if out else text


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans for each row."""
    ship(docs.sparkSession)

    @F.pandas_udf("n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                base, every = all_spans(text or "")
                kinds = [kind for _, _, kind in base]
                rows.append((
                    *(kinds.count(k) for k in KINDS[:3]),
                    hashlib.sha256(written(base).encode()).hexdigest(),
                    written(every),
                ))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return pick(docs, "doc_id", "text").select("doc_id", scanned("text").alias("_s")).select("doc_id", "_s.*")


@shelved
def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets in the texts replaced and n_chars counted again; a null text or n_chars stays null, all rows stay."""
    ship(docs.sparkSession)

    @F.pandas_udf("string")
    def cleaned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([x and redacted(x, all_spans(x)[1]) for x in texts], dtype=object)

    changed = F.when(F.col("n_chars").isNotNull(), F.char_length("text").cast("bigint"))
    return docs.withColumn("text", cleaned("text")).withColumn("n_chars", changed)
