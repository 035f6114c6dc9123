"""Pages of documents to chunks by section, and chunks to super-chunks and batches for a model.

Paragraphs are typed in the JVM: their tokens, and the section whose heading stands in one of their first three lines. Then one pass
in document order keeps the state that depends on all before it (section, subsection, role and effects, the chunk
that is being filled) and puts out a chunk where the section changes or the tokens run out. Paragraphs are dealt by
document and sorted within the task, so the pass is a stream: its memory is one chunk, whatever the document's length.
Chunks of a section whose role says so are put out under several sections (``effective``).

Super-chunks and batches are folds over the chunks of one document (:mod:`tidemill.operators.packing`).
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.functions.text import token_estimate
from tidemill.operators import packing
from tidemill.plans.chunking import sentences, split_with_overlap, tokens_in
from tidemill.session import ship

UNKNOWN = "unknown"
#: Headings of each section, in the order in which they are tried; a line matches from its start, in any case.
ANCHORS: dict[str, tuple[str, ...]] = {
    "declarations": (r"DECLARATIONS?\s*$", r"POLICY\s+DECLARATIONS?\s*$", r"COMMON\s+POLICY\s+DECLARATIONS?\s*$"),
    "coverages": (r"COVERAGES?\s*$", r"COVERAGE\s+FORM\s*$", r"COVERAGE\s+[A-Z]\s*[-:]", r"PROPERTY\s+COVERAGE\s*$", r"LIABILITY\s+COVERAGE\s*$"),
    "coverage_grant": (
        r"SECTION\s+II\s*[-–]\s*COVERED\s+AUTOS\s+LIABILITY\s+COVERAGE\s*$", r"PHYSICAL\s+DAMAGE\s+COVERAGE\s*$",
        r"SECTION\s+III\s*[-–]\s*PHYSICAL\s+DAMAGE\s+COVERAGE\s*$", r"WE\s+WILL\s+PAY\s*$", r"WE\s+WILL\s+ALSO\s+PAY\s*$",
    ),
    "coverage_extension": (
        r"SUPPLEMENTARY\s+PAYMENTS\s*$", r"OUT-OF-STATE\s+COVERAGE\s+EXTENSIONS\s*$", r"TRANSPORTATION\s+EXPENSES\s*$",
        r"LOSS\s+OF\s+USE\s+EXPENSES\s*$", r"COVERAGE\s+EXTENSIONS\s*$",
    ),
    "limits": (r"LIMIT\s+OF\s+INSURANCE\s*$", r"LIMITS\s+AND\s+DEDUCTIBLES\s*$"),
    "conditions": (r"CONDITIONS?\s*$", r"GENERAL\s+CONDITIONS?\s*$", r"POLICY\s+CONDITIONS?\s*$", r"COMMERCIAL\s+PROPERTY\s+CONDITIONS?\s*$"),
    "exclusions": (r"EXCLUSIONS?\s*$", r"GENERAL\s+EXCLUSIONS?\s*$", r"WHAT\s+IS\s+NOT\s+COVERED\s*$"),
    "endorsements": (r"ENDORSEMENTS?\s*$", r"ENDORSEMENT\s+NO\.?\s*\d*", r"POLICY\s+ENDORSEMENTS?\s*$", r"FORMS?\s+AND\s+ENDORSEMENTS?\s*$"),
    "definitions": (r"DEFINITIONS?\s*$", r"SECTION\s+[IVX]+[.:]\s*DEFINITIONS?\s*$"),
    "insured_definition": (r"WHO\s+IS\s+AN\s+INSURED\s*$",),
    "sov": (r"SCHEDULE\s+OF\s+VALUES?\s*$", r"SOV\s*$", r"PROPERTY\s+SCHEDULE\s*$", r"LOCATION\s+SCHEDULE\s*$"),
    "loss_run": (r"LOSS\s+RUN\s*$", r"LOSS\s+HISTORY\s*$", r"LOSS\s+EXPERIENCE\s*$", r"CLAIMS?\s+HISTORY\s*$"),
    "insuring_agreement": (r"INSURING\s+AGREEMENT\s*$", r"AGREEMENT\s*$"),
    "premium_summary": (r"PREMIUM\s+SUMMARY\s*$", r"PREMIUM\s+SCHEDULE\s*$", r"PREMIUM\s+BREAKDOWN\s*$"),
    "financial_statement": (r"FINANCIAL\s+STATEMENT\s*$", r"FINANCIAL\s+INFORMATION\s*$"),
    "vehicle_details": (
        r"VEHICLE\s+DETAILS?\s*$", r"VEHICLE\s+SCHEDULE\s*$", r"COVERED\s+Auto(?:s|mobile|mobiles)?\s*$",
        r"SCHEDULE\s+OF\s+COVERED\s+Auto(?:s|mobile|mobiles)?\s*$",
    ),
    "insured_declared_value": (r"INSURED(?:'\s*S)?\s+DECLARED\s+VALUE\s*$", r"IDV\s*$"),
    "liability_coverages": (r"LIABILITY\s+COVERAGES?\s*$", r"LIABILITY\s+LIMITS?\s*$"),
    "driver_information": (r"DRIVER(?:S|\s+INFORMATION)?\s*$", r"SCHEDULE\s+OF\s+DRIVERS?\s*$"),
}
#: Sections that a heading brings up as a part of a larger one.
CORE = {
    "vehicle_details": "coverages", "insured_declared_value": "coverages", "liability_coverages": "coverages",
    "insuring_agreement": "coverages", "premium_summary": "declarations", "financial_statement": "declarations",
}
#: Boundaries of these sections always end a chunk.
HARD_STOPS = frozenset({"coverage_grant", "insured_definition", "limits", "exclusions", "conditions", "definitions"})
#: Sections that have a role of their own, where none is known.
OWN_ROLES = frozenset({"coverage_grant", "coverage_extension", "limits", "insured_definition", "definitions"})
#: Section that nothing of a role may come from.
CERTIFICATE = "certificate_of_insurance"


class Limits(NamedTuple):
    """What one super-chunk of a section holds at most, when it comes up, and how it is read."""

    chunks: int
    tokens: int
    priority: int
    model: bool = True
    table: bool = False


#: Limits of sections; others have those of ``unknown``.
LIMITS: dict[str, Limits] = {
    "declarations": Limits(3, 4000, 1),
    "coverages": Limits(8, 6000, 2),
    "conditions": Limits(5, 5000, 3),
    "exclusions": Limits(5, 5000, 3),
    "endorsements": Limits(10, 5000, 4),
    "sov": Limits(5, 5000, 2, model=False, table=True),
    "loss_run": Limits(5, 5000, 2, model=False, table=True),
    "insuring_agreement": Limits(3, 4000, 2),
    "premium_summary": Limits(3, 4000, 3),
    "financial_statement": Limits(5, 5000, 4),
    "vehicle_details": Limits(5, 5000, 2),
    "insured_declared_value": Limits(3, 4000, 2),
    "liability_coverages": Limits(5, 5000, 2),
    "deductibles": Limits(3, 4000, 2),
    "premium": Limits(3, 4000, 2),
    "coverages_context": Limits(5, 5000, 2),
    UNKNOWN: Limits(5, 5000, 10),
    CERTIFICATE: Limits(1, 2000, 10, model=False),
    "coverage_grant": Limits(4, 5000, 2),
    "coverage_extension": Limits(4, 5000, 2),
    "limits": Limits(3, 4000, 2),
    "insured_definition": Limits(3, 4000, 2),
}
BOUNDARY = "start_line int, section string, subsection string, role string, coverage_effects array<string>, exclusion_effects array<string>"
CHUNK = (
    "doc_id bigint, chunk int, section string, effective string, subsection string, role string, coverage_effects array<string>, "
    "exclusion_effects array<string>, pages array<int>, tokens bigint, has_tables boolean, table_count int, text string"
)


def section_of(text: Column, anchors: dict[str, Sequence[str]] = ANCHORS) -> Column:
    """The section whose heading is one of the first three lines of a text, or null. Lines of over 200 characters are no headings."""
    kind = lambda line: F.coalesce(*(F.when(line.rlike(f"(?i)^(?:{'|'.join(p)})"), name) for name, p in anchors.items()))
    lines = F.transform(F.slice(F.split(text, "\n"), 1, 3), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    lines = F.filter(lines, lambda x: (F.length(x) > 0) & (F.length(x) <= 200))
    # One pattern rules most lines out before they are tried section by section.
    any_of = f"(?i)^#*\\s*(?:{'|'.join(p for ps in anchors.values() for p in ps)})"
    heads = F.transform(F.filter(lines, lambda x: x.rlike(any_of)), lambda x: F.regexp_replace(x, r"^#+\s*", ""))
    return F.get(F.filter(F.transform(heads, kind), lambda x: x.isNotNull()), F.lit(0))


def paragraphs(pages: DataFrame) -> DataFrame:
    """doc_id, page, para (from 0), text, tokens and detected for each paragraph; other columns of the page go along.

    Paragraphs end at blank lines and before headings of up to three hashes.
    """
    parts = F.filter(F.transform(F.split("text", r"\n\n+|(?m)(?=^#{1,3}\s)"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    rest = [c for c in pages.columns if c != "text"]
    out = pages.select(*rest, F.posexplode(parts).alias("para", "text"))
    return out.withColumn("tokens", token_estimate(F.col("text"))).withColumn("detected", section_of(F.col("text")))


def with_boundaries(pages: DataFrame, boundaries: DataFrame) -> DataFrame:
    """``pages`` with the boundaries that start on each (``starts``, in order of seq) and the first one that covers it (``covers``).

    ``boundaries``: doc_id, seq, start_page, end_page and the fields of ``BOUNDARY``.
    """
    one = F.struct(*(c.split()[0] for c in BOUNDARY.split(", ")))
    starts = boundaries.groupBy("doc_id", F.col("start_page").alias("page")).agg(F.array_sort(F.collect_list(F.struct("seq", one.alias("b")))).alias("_s"))
    starts = starts.select("doc_id", "page", F.transform("_s", lambda x: x["b"]).alias("starts"))
    over = boundaries.where("end_page >= start_page").withColumn("page", F.explode(F.sequence("start_page", "end_page")))
    over = over.groupBy("doc_id", "page").agg(F.min_by(one, "seq").alias("covers"))
    return pages.join(starts, ["doc_id", "page"], "left").join(over, ["doc_id", "page"], "left")


def effective_sections(section: str, role: str | None) -> list[str]:
    """Sections under which a chunk is read."""
    if role == "both":
        return ["coverages", "exclusions"]
    if section == "endorsements":
        return [{"coverage_modifier": "coverages", "exclusion_modifier": "exclusions"}.get(role or "", section)]
    return [section]


class Context(NamedTuple):
    section: str = UNKNOWN
    subsection: str | None = None
    role: str | None = None
    coverage_effects: tuple[str, ...] = ()
    exclusion_effects: tuple[str, ...] = ()


@dataclass
class _Filling:
    """The chunk that is being filled."""

    parts: list[str] = field(default_factory=list)
    tokens: int = 0
    pages: set[int] = field(default_factory=set)
    tables: int = 0
    has_tables: bool = False


class Chunker:
    """Paragraphs of one document, in order, to chunks."""

    def __init__(self, doc_id: int, most: int, least: int, overlap: int) -> None:
        self.doc_id, self.most, self.least, self.overlap = doc_id, most, least, overlap
        self.at, self.filling, self.made, self.page, self.line = Context(), _Filling(), 0, None, 1
        self.heading: str | None = None

    def add(self, p) -> Iterator[dict]:
        """Takes a paragraph (page, para, text, tokens, detected, heading, manifest, starts, covers, table_count); the chunks that it ends."""
        if p.page != self.page:
            self.page, self.line, self.heading = p.page, 1, p.heading or self.heading
        moved, new = self._next(p)
        if p.tokens > self.most:
            yield from self._oversized(p, new if moved else self.at)
            return
        self._symbols()
        now = self.filling
        full = now.tokens + p.tokens > self.most and now.tokens >= self.least
        if now.parts and (moved or full):
            yield from self._out(effective_sections(self.at.section, self.at.role))
            tail = "" if moved else self._tail("\n\n".join(now.parts))
            self.filling = _Filling([tail] if tail else [], tokens_in(tail), {p.page})
        if moved:
            self.at = new
        if self.at.role in (None, UNKNOWN) and self.at.section in OWN_ROLES:
            self.at = self.at._replace(role=self.at.section)
        now = self.filling
        now.parts.append(p.text)
        now.tokens += p.tokens
        now.pages.add(p.page)
        if p.table_count is not None:
            now.has_tables, now.tables = True, max(now.tables, p.table_count)
        self.line += p.text.count("\n") + 2

    def end(self) -> Iterator[dict]:
        if self.filling.parts:
            yield from self._out(effective_sections(self.at.section, self.at.role))

    def _next(self, p) -> tuple[bool, Context]:
        """Whether the paragraph starts something new, and what. A heading counts, over it a boundary, and for a page's
        first paragraph, without a boundary, the page's section."""
        first, boundary = p.para == 0, None
        for b in p.starts:
            if first if b["start_line"] is None else self.line >= b["start_line"]:
                boundary = b
        if first and boundary is None and p.covers is not None:
            # The page carries on what covers it: its role and effects hold from here on.
            c = p.covers
            self.at = self.at._replace(**{k: v for k, v in (
                ("role", c["role"]), ("coverage_effects", tuple(_list(c["coverage_effects"]))), ("exclusion_effects", tuple(_list(c["exclusion_effects"]))),
            ) if v})
        moved, new = False, self.at
        if p.detected is not None and p.detected != self.at.section:
            core = CORE.get(p.detected, p.detected)
            moved, new = True, new._replace(section=core, subsection=p.detected if core != p.detected else new.subsection)
        if boundary is not None and (section := boundary["section"] or UNKNOWN) != UNKNOWN:
            new = Context(new.section, boundary["subsection"], boundary["role"], tuple(_list(boundary["coverage_effects"])), tuple(_list(boundary["exclusion_effects"])))
            if section != self.at.section or new.subsection != self.at.subsection or new.role != self.at.role or section in HARD_STOPS:
                moved, new = True, new._replace(section=section)
        elif first and (section := p.manifest or self.heading) not in (None, UNKNOWN, self.at.section):
            moved, new = True, new._replace(section=section)
        if new.section == CERTIFICATE:
            new = new._replace(role=None, coverage_effects=(), exclusion_effects=())
        return moved, new

    def _symbols(self) -> None:
        """A chunk of coverages, or of nothing known, that is mostly a table of symbols is context of the coverages."""
        now = self.filling
        if now.parts and self.at.section in ("coverages", UNKNOWN):
            text = "\n".join(now.parts).lower()
            if "symbol" in text or "designation" in text:
                rows = sum(x.startswith("|") or x.count("|") > 2 for x in map(str.strip, now.parts))
                if rows / len(now.parts) >= 0.6 or (now.has_tables and "symbol" in text):
                    self.at = self.at._replace(section="coverages_context", role=None)

    def _oversized(self, p, at: Context) -> Iterator[dict]:
        """A paragraph over the limit ends the chunk before it and is cut; its last piece begins the next chunk."""
        if self.filling.parts:
            yield from self._out([self.at.section])
        self.at = at
        tables = (p.table_count or 0, p.table_count is not None)
        *before, last = split_with_overlap(p.text, self.most, self.overlap)
        for piece in before:
            self.filling = _Filling([piece], tokens_in(piece), {p.page}, *tables)
            yield from self._out([self.at.section])
        self.filling = _Filling([last], tokens_in(last), {p.page}, *tables)

    def _tail(self, text: str) -> str:
        """The last sentences of a text that the overlap holds."""
        kept, size = [], 0
        for sentence in reversed(sentences(text)):
            size += tokens_in(sentence)
            if size > self.overlap:
                break
            kept.insert(0, sentence)
        return " ".join(kept).strip()

    def _out(self, effective: list[str]) -> Iterator[dict]:
        now, at = self.filling, self.at
        for section in effective:
            yield {
                "doc_id": self.doc_id, "chunk": self.made, "section": at.section, "effective": section,
                "subsection": at.subsection or (f"projected_from_{at.section}" if section != at.section else None), "role": at.role,
                "coverage_effects": list(at.coverage_effects), "exclusion_effects": list(at.exclusion_effects), "pages": sorted(now.pages), "tokens": now.tokens,
                "has_tables": now.has_tables, "table_count": now.tables, "text": "\n\n".join(now.parts).strip(),
            }
            self.made += 1


def _list(x) -> list:
    return [] if x is None else list(x)


def merged(chunks: Iterator[dict], most: int, least: int) -> Iterator[dict]:
    """Neighbours of one document, section and role joined while the first is under ``least`` and both fit ``most``."""
    held: dict | None = None
    for c in chunks:
        same = held is not None and all(held[k] == c[k] for k in ("doc_id", "section", "effective", "role"))
        if same and held["tokens"] < least and held["tokens"] + c["tokens"] <= most:
            held = held | {
                "text": f"{held['text']}\n\n{c['text']}", "tokens": held["tokens"] + c["tokens"], "pages": sorted({*held["pages"], *c["pages"]}),
                "has_tables": held["has_tables"] or c["has_tables"], "table_count": max(held["table_count"], c["table_count"]),
                "coverage_effects": sorted({*held["coverage_effects"], *c["coverage_effects"]}),
                "exclusion_effects": sorted({*held["exclusion_effects"], *c["exclusion_effects"]}),
            }
        else:
            if held is not None:
                yield held
            held = c
    if held is not None:
        yield held


#: Chunks of a batch that goes back to the JVM.
AT_ONCE = 200


def section_chunks(pages: DataFrame, most: int = 1500, least: int = 300, overlap: int = 50) -> DataFrame:
    """Chunks (``CHUNK``) of pages: doc_id, page, text and, where known, manifest, starts and covers (:func:`with_boundaries`) and table_count.

    ``manifest`` is the section of a page. A page without one has that of the heading in its first three lines, or of the last page
    before it that has such a heading. At least 200 tokens make a chunk of their own, whatever ``least`` says. Blank and null pages give
    nothing.
    """
    ship(pages.sparkSession)
    least = max(least, 200)
    kinds = {"manifest": "string", "starts": f"array<struct<{', '.join(f.replace(' ', ': ', 1) for f in BOUNDARY.split(', '))}>>", "table_count": "int"}
    kinds["covers"] = kinds["starts"][6:-1]
    for name, kind in kinds.items():
        pages = pages.withColumn(name, (F.col(name) if name in pages.columns else F.lit(None)).cast(kind))
    typed = paragraphs(pages.select("doc_id", "page", "text", *kinds).withColumn("heading", section_of(F.col("text"))))
    dealt = typed.repartition("doc_id").sortWithinPartitions("doc_id", "page", "para")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
        now: Chunker | None = None
        for batch in batches:
            # pandas turns a null in a column of numbers into NaN.
            batch = batch.astype({"table_count": object}).where(batch.notna(), None)
            for p in batch.itertuples(index=False):
                p = p._replace(starts=_list(p.starts))
                if now is None or now.doc_id != p.doc_id:
                    if now is not None:
                        yield from now.end()
                    now = Chunker(p.doc_id, most, least, overlap)
                yield from now.add(p)
        if now is not None:
            yield from now.end()

    def chunk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[dict] = []
        names = [f.split()[0] for f in CHUNK.split(", ")]
        for c in merged(read(batches), most, least):
            out.append(c)
            if len(out) == AT_ONCE:
                yield pd.DataFrame(out, columns=names)
                out = []
        yield pd.DataFrame(out, columns=names)

    return dealt.mapInPandas(chunk, CHUNK)


def _limit(section: Column, name: str) -> Column:
    cases = [F.when(section == s, F.lit(getattr(v, name))) for s, v in LIMITS.items()]
    return F.coalesce(*cases, F.lit(getattr(LIMITS[UNKNOWN], name)))


def section_super_chunks(chunks: DataFrame, most: int = 6000) -> DataFrame:
    """doc_id, place (from 0, by priority), section, part, priority, requires_model, table_only, chunks and tokens.

    Chunks of a section, by ``effective``, fill super-chunks up to the section's limits. Those with a role, and
    endorsements, make one for each run of pages with gaps of one page at most, under the first chunk's section.
    Of the same priority, sections come in the order of their first chunk, runs of pages after them.
    """
    item = chunks.withColumn("page", F.get("pages", F.lit(0))).withColumn("own", F.col("role").isNotNull() | (F.col("section") == "endorsements"))
    base = item.where(~F.col("own")).withColumn("key", F.struct("doc_id", "effective"))
    bins = packing.packed(
        base, "key", ["chunk"], F.col("tokens"), F.least(_limit(F.col("effective"), "tokens"), F.lit(most)), _limit(F.col("effective"), "chunks"),
    )
    parts = bins.groupBy(F.col("key.doc_id").alias("doc_id"), F.col("key.effective").alias("section"), F.col("bin").alias("part")).agg(
        F.min("chunk").alias("first"), F.count("*").alias("chunks"), F.sum("size").cast("bigint").alias("tokens"))
    seen = Window.partitionBy("doc_id", "section")
    parts = parts.withColumn("first", F.min("first").over(seen)).withColumn("late", F.lit(0))
    order = Window.partitionBy("doc_id").orderBy("page", "chunk")
    runs = item.where("own").withColumn("new", F.coalesce((F.col("page") > F.lag("page").over(order) + 1).cast("int"), F.lit(0)))
    runs = runs.withColumn("part", F.sum("new").over(order).cast("int"))
    runs = runs.groupBy("doc_id", "part").agg(
        F.min_by("effective", F.struct("page", "chunk")).alias("section"), F.count("*").alias("chunks"), F.sum("tokens").alias("tokens"))
    runs = runs.withColumn("first", F.lit(0)).withColumn("late", F.lit(1))
    out = parts.unionByName(runs, allowMissingColumns=True)
    for name, limit in (("priority", "priority"), ("requires_model", "model"), ("table_only", "table")):
        out = out.withColumn(name, _limit(F.col("section"), limit))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("priority", "late", "first", "section", "part")) - 1
    return out.select("doc_id", place.alias("place"), "section", "part", "priority", "requires_model", "table_only", "chunks", "tokens")


def model_batches(super_chunks: DataFrame, most: int = 12_000) -> DataFrame:
    """Super-chunks that need a model, in order, in batches of at most ``most`` tokens: doc_id, place, size and bin (from 0)."""
    return packing.packed(super_chunks.where("requires_model"), "doc_id", ["place"], F.col("tokens"), most, 1 << 30)
