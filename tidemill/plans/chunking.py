"""Documents to chunks: paragraphs gathered up to a token budget, with section changes and overlap."""
from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HEADING = re.compile(r"^#{1,6}\s+(.*)")
_BREAK = re.compile(r"\n\n+|\n(?=#{1,6} )")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_PIECES = re.compile(r"([.!?]+\s+)")


def tokens_in(text: str) -> int:
    """The estimate of :func:`tidemill.functions.text.token_estimate`."""
    return int((len(text) / 4 + len(text.split()) * 1.3) / 2 * 1.1)


def split_to_limit(text: str, most: int) -> list[str]:
    """Pieces of at most ``most`` tokens by lines, long lines by sentences, longer ones by words."""
    out: list[str] = []
    now = ""

    def put(piece: str, glue: str) -> None:
        nonlocal now
        joined = f"{now}{glue}{piece}" if now else piece
        if tokens_in(joined) <= most:
            now = joined
        else:
            if now:
                out.append(now)
            now = piece

    for line in text.split("\n"):
        if tokens_in(line) <= most:
            put(line, "\n")
            continue
        for sentence in _SENTENCE.split(line):
            if tokens_in(sentence) <= most:
                put(sentence, " ")
            else:
                for word in sentence.split(" "):
                    put(word, " ")
    return [*out, now] if now else out


def sentences(text: str) -> list[str]:
    """A text cut at the space after a full stop, an exclamation mark or a question mark."""
    return _SENTENCE.split(text)


def split_with_overlap(text: str, most: int, overlap: int) -> list[str]:
    """Pieces of about ``most`` tokens by lines, each beginning with the last lines of the one before that ``overlap`` holds.

    A line over the limit is a break: it is cut behind sentences, without overlap. Pieces are sums of their parts' tokens, so
    a sentence over the limit stays whole.
    """
    if tokens_in(text) <= most:
        return [text]
    out: list[str] = []

    def filled(parts: list[str], glue: str, carry: int) -> list[str]:
        """Puts out all full pieces of the parts and returns what is left."""
        held: list[tuple[str, int]] = []
        size = 0
        for part in parts:
            n = tokens_in(part)
            if held and size + n > most:
                out.append(glue.join(x for x, _ in held))
                kept, size = len(held), 0
                while carry and kept and size + held[kept - 1][1] <= carry:
                    kept -= 1
                    size += held[kept][1]
                held = held[kept:]
            held.append((part, n))
            size += n
        return [x for x, _ in held]

    lines: list[str] = []
    for line in text.split("\n"):
        if tokens_in(line) <= most:
            lines.append(line)
            continue
        if rest := filled(lines, "\n", overlap):
            out.append("\n".join(rest))
        lines = []
        if rest := filled(_PIECES.split(line), "", 0):
            out.append("".join(rest))
    if rest := filled(lines, "\n", overlap):
        out.append("\n".join(rest))
    return out


def chunks_of(text: str, most: int, least: int, overlap: int) -> list[tuple[str, str, int]]:
    """(section, chunk, tokens) of a text: a chunk ends at a section change once it has ``least`` tokens, or at ``most``."""
    out: list[tuple[str, str, int]] = []
    section, held, size = "", [], 0

    def flush(carry: bool) -> None:
        nonlocal held, size
        if held:
            whole = "\n\n".join(held)
            out.append((section, whole, tokens_in(whole)))
            tail: list[str] = []
            if carry and overlap:
                for s in reversed(_SENTENCE.split(held[-1])):
                    if tokens_in(" ".join([s, *tail])) > overlap:
                        break
                    tail.insert(0, s)
            held, size = ([" ".join(tail)], tokens_in(" ".join(tail))) if tail else ([], 0)

    for paragraph in _BREAK.split(text):
        if not paragraph.strip():
            continue
        m = _HEADING.match(paragraph)
        if m and size >= least:
            flush(False)
        if m:
            section = m.group(1).split("\n")[0].strip().lower()
        for piece in split_to_limit(paragraph, most):
            n = tokens_in(piece)
            if size and size + n > most:
                flush(True)
                if size + n > most:
                    held, size = [], 0
            held.append(piece)
            size += n
    flush(False)
    return out


def chunked(docs: DataFrame, most: int = 1500, least: int = 300, overlap: int = 50) -> DataFrame:
    """doc_id, chunk (from 0), section, text and tokens; a null or blank text has no chunks."""

    @F.pandas_udf("array<struct<section:string,text:string,tokens:bigint>>")
    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda x: [{"section": s, "text": c, "tokens": n} for s, c, n in chunks_of(x or "", most, least, overlap)])

    out = docs.select("doc_id", F.posexplode(cut("text")).alias("chunk", "_c"))
    return out.select("doc_id", "chunk", "_c.section", "_c.text", "_c.tokens")
