"""Documents as pages with made-up headings and boundaries, to chunks by section, super-chunks and batches.

The words of every document are cut in paragraphs of 40, five to a page; some paragraphs begin with a heading, and some
pages with a boundary, by rules on doc_id and place that the SQL repeats. The SQL runs the paragraphs one by one in a recursive query.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.plans import sections as S
from tidemill.queries import Tables, query

_HEADS = ("EXCLUSIONS", "## Conditions", "COVERAGES", "ENDORSEMENT NO. 3", "WE WILL PAY", "Vehicle Details", "DEFINITIONS", "Declarations")
_MOST, _LEAST, _OVERLAP = 400, 200, 20


def _pages(t: Tables) -> DataFrame:
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    docs = t.documents.select("doc_id", words.alias("w")).where(F.size("w") > 0)
    at = docs.select("doc_id", "w", F.explode(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / 40).cast("int"))).alias("i"))
    n = F.col("doc_id") * 7 + F.col("i")
    head = F.when(n % 6 == 0, F.concat(F.get(F.array(*map(F.lit, _HEADS)), ((F.col("doc_id") + F.col("i")) % 8).cast("int")), F.lit("\n"))).otherwise("")
    part = F.concat(head, F.array_join(F.slice("w", F.col("i") * 40 + 1, 40), " "))
    paras = at.select("doc_id", (F.floor(F.col("i") / 5) + 1).cast("int").alias("page"), F.struct("i", part.alias("p")).alias("x"))
    return paras.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["p"]), "\n\n").alias("text"))


def _boundaries(pages: DataFrame) -> DataFrame:
    d, p = F.col("doc_id"), F.col("page")
    pick = lambda n, *names: F.get(F.array(*(F.lit(x).cast("string") for x in names)), (n % len(names)).cast("int"))
    return pages.where((d + p) % 4 == 1).select(
        "doc_id", p.alias("seq"), p.alias("start_page"), (p + 1).alias("end_page"), F.when(p % 2 == 1, 7).alias("start_line"),
        pick(d + p * 2, "endorsements", "endorsements", "limits").alias("section"), F.lit(None).cast("string").alias("subsection"),
        pick(d + F.floor(p / 4), "both", "coverage_modifier", "exclusion_modifier", None).alias("role"),
        F.when(d % 2 == 0, F.array(F.lit("adds_coverage"))).otherwise(F.array().cast("array<string>")).alias("coverage_effects"),
        F.array().cast("array<string>").alias("exclusion_effects"),
    )


def _chunks(t: Tables) -> DataFrame:
    pages = _pages(t)
    return S.section_chunks(S.with_boundaries(pages, _boundaries(pages)), _MOST, _LEAST, _OVERLAP)


def _tokens(text: str) -> str:
    return f"floor((length({text}) / 4.0::DOUBLE + len(list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w <> '')) * 1.3::DOUBLE) / 2 * 1.1::DOUBLE)::BIGINT"


def _detected(lines: str) -> str:
    """The first line that is a heading of ``_HEADS``, as its section."""
    names = {"EXCLUSIONS": "exclusions", "CONDITIONS": "conditions", "COVERAGES": "coverages", "ENDORSEMENT NO. 3": "endorsements", "WE WILL PAY": "coverage_grant",
             "VEHICLE DETAILS": "vehicle_details", "DEFINITIONS": "definitions", "DECLARATIONS": "declarations"}
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items())
    return f"list_filter(list_transform({lines}, lambda l: CASE upper(regexp_replace(trim(l), '^#+\\s*', '')) {cases} END), lambda x: x IS NOT NULL)[1]"


_PARAS = f"""
w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
a AS (SELECT doc_id, w, unnest(range(0, (len(w) + 39) // 40)) AS i FROM w),
p0 AS (SELECT doc_id, i, i // 5 + 1 AS page, i % 5 AS para,
    CASE WHEN (doc_id * 7 + i) % 6 = 0 THEN [{', '.join(f"'{h}'" for h in _HEADS)}][(doc_id + i) % 8 + 1] || chr(10) ELSE '' END || array_to_string(w[i * 40 + 1 : i * 40 + 40], ' ') AS text FROM a),
g AS (SELECT doc_id, page, string_agg(text, chr(10) || chr(10) ORDER BY i) AS text FROM p0 GROUP BY ALL),
h AS (SELECT doc_id, page, {_detected("string_split(text, chr(10))[1:3]")} AS heading FROM g),
b AS (SELECT doc_id, page, CASE WHEN page % 2 = 1 THEN 7 END AS start_line, ['endorsements', 'endorsements', 'limits'][(doc_id + page * 2) % 3 + 1] AS section,
    ['both', 'coverage_modifier', 'exclusion_modifier', NULL][(doc_id + page // 4) % 4 + 1] AS role,
    CASE WHEN doc_id % 2 = 0 THEN ['adds_coverage'] ELSE []::VARCHAR[] END AS cov FROM g WHERE (doc_id + page) % 4 = 1),
p AS (SELECT p0.*, {_tokens("p0.text")} AS tok, {_detected("string_split(p0.text, chr(10))[1:3]")} AS det, h.heading,
    len(string_split(p0.text, chr(10))) - 1 AS breaks, b.start_line, b.section AS b_sec, b.role AS b_role, b.cov AS b_cov, c.page IS NOT NULL AS covered, c.role AS c_role, c.cov AS c_cov
  FROM p0 JOIN h USING (doc_id, page) LEFT JOIN b USING (doc_id, page) LEFT JOIN (
    SELECT doc_id, pg AS page, first(role ORDER BY page) AS role, first(cov ORDER BY page) AS cov
    FROM (SELECT *, unnest([page, page + 1]) AS pg FROM b) GROUP BY doc_id, pg) c USING (doc_id, page))"""
_STATES = f"""
s AS (
  SELECT doc_id, -1::BIGINT AS i, 'unknown' AS sec, NULL::VARCHAR AS sub, NULL::VARCHAR AS role, []::VARCHAR[] AS cov, 1::BIGINT AS line, NULL::VARCHAR AS heading,
    []::VARCHAR[] AS buf, 0::BIGINT AS tok, []::BIGINT[] AS pages, FALSE AS out, NULL::VARCHAR AS o_sec, NULL::VARCHAR AS o_sub, NULL::VARCHAR AS o_role, []::VARCHAR[] AS o_cov,
    NULL::VARCHAR AS o_text, NULL::BIGINT AS o_tok, []::BIGINT[] AS o_pages
  FROM (SELECT DISTINCT doc_id FROM p0)
  UNION ALL
  SELECT doc_id, i, n_sec AS sec, n_sub AS sub, CASE WHEN n_role IS NULL AND n_sec IN ('coverage_grant', 'coverage_extension', 'limits', 'insured_definition', 'definitions') THEN n_sec ELSE n_role END AS role,
    n_cov AS cov, line + breaks + 2 AS line, heading, list_append(kept, text) AS buf, {_tokens("array_to_string(kept, ' ')")} * (out::INT) + (CASE WHEN out THEN 0 ELSE tok END) + x_tok AS tok,
    CASE WHEN out THEN [page] ELSE list_distinct(list_append(pages, page)) END AS pages, out, sec AS o_sec, sub AS o_sub, role AS o_role, cov AS o_cov,
    array_to_string(buf, chr(10) || chr(10)) AS o_text, tok AS o_tok, pages AS o_pages
  FROM (
    SELECT *, CASE WHEN NOT out THEN buf WHEN moved OR tail = '' THEN []::VARCHAR[] ELSE [tail] END AS kept,
      CASE WHEN moved THEN m_sec ELSE sec END AS n_sec, CASE WHEN moved THEN m_sub ELSE sub END AS n_sub,
      CASE WHEN moved THEN m_role ELSE role END AS n_role, CASE WHEN moved THEN m_cov ELSE cov END AS n_cov
    FROM (
      SELECT *, trim(array_to_string(sents[len(sents) - coalesce(list_max(list_filter(range(1, len(sents) + 1), lambda k:
          list_sum(list_transform(sents[len(sents) - k + 1 : len(sents)], lambda q: {_tokens("q")})) <= {_OVERLAP})), 0) + 1 : len(sents)], ' ')) AS tail
      FROM (
        SELECT *, len(buf) > 0 AND (moved OR (tok + x_tok > {_MOST} AND tok >= {_LEAST})) AS out,
          CASE WHEN len(buf) > 0 AND NOT moved AND tok + x_tok > {_MOST} AND tok >= {_LEAST}
            THEN string_split(regexp_replace(array_to_string(buf, chr(10) || chr(10)), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) ELSE []::VARCHAR[] END AS sents
        FROM (
          SELECT *, (d_moved OR b_moved OR h_moved) AS moved, CASE WHEN b_moved THEN b_sec WHEN h_moved THEN heading WHEN d_moved THEN core ELSE sec END AS m_sec,
            CASE WHEN hit THEN NULL WHEN d_moved AND core <> det THEN det ELSE sub END AS m_sub, CASE WHEN hit THEN b_role ELSE role END AS m_role, CASE WHEN hit THEN b_cov ELSE cov END AS m_cov
          FROM (
            SELECT *, det IS NOT NULL AND det <> sec AS d_moved, CASE det WHEN 'vehicle_details' THEN 'coverages' ELSE det END AS core,
              hit AND (b_sec <> sec OR sub IS NOT NULL OR b_role IS DISTINCT FROM role OR b_sec = 'limits') AS b_moved,
              NOT hit AND para = 0 AND heading IS NOT NULL AND heading <> sec AS h_moved
            FROM (
              SELECT * EXCLUDE (role, cov), CASE WHEN para = 0 AND NOT hit AND covered THEN coalesce(c_role, role) ELSE role END AS role,
                CASE WHEN para = 0 AND NOT hit AND covered AND len(c_cov) > 0 THEN c_cov ELSE cov END AS cov
              FROM (
                SELECT s.doc_id, p.i, s.sec, s.sub, s.role, s.cov, CASE WHEN para = 0 THEN 1 ELSE s.line END AS line, CASE WHEN para = 0 THEN coalesce(p.heading, s.heading) ELSE s.heading END AS heading,
                  s.buf, s.tok, s.pages, p.text, p.tok AS x_tok, p.page, para, det, breaks, b_sec, b_role, b_cov, covered, c_role, c_cov,
                  b_sec IS NOT NULL AND CASE WHEN start_line IS NULL THEN para = 0 ELSE (CASE WHEN para = 0 THEN 1 ELSE s.line END) >= start_line END AS hit
                FROM s JOIN p ON s.doc_id = p.doc_id AND p.i = s.i + 1)))))))),
o AS (
  SELECT doc_id, i, o_sec AS sec, o_sub AS sub, o_role AS role, o_cov AS cov, o_text AS text, o_tok AS tok, o_pages AS pages FROM s WHERE out
  UNION ALL
  SELECT doc_id, 1000000000::BIGINT, sec, sub, role, cov, array_to_string(buf, chr(10) || chr(10)), tok, pages FROM s JOIN (SELECT doc_id, max(i) AS i FROM s GROUP BY doc_id) USING (doc_id, i) WHERE len(buf) > 0),
e AS (SELECT *, unnest(CASE WHEN role = 'both' THEN ['coverages', 'exclusions'] WHEN sec = 'endorsements' AND role = 'coverage_modifier' THEN ['coverages']
    WHEN sec = 'endorsements' AND role = 'exclusion_modifier' THEN ['exclusions'] ELSE [sec] END) AS eff FROM o),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, eff) - 1 AS chunk FROM e),
m AS (
  SELECT doc_id, chunk, sec, eff, role, tok, chunk AS held FROM k WHERE chunk = 0
  UNION ALL
  SELECT k.doc_id, k.chunk, k.sec, k.eff, k.role, CASE WHEN j THEN m_tok + k.tok ELSE k.tok END, CASE WHEN j THEN held ELSE k.chunk END
  FROM (SELECT m.doc_id, m.chunk, m.held, m.tok AS m_tok, k.chunk AS nxt, m.sec = k.sec AND m.eff = k.eff AND m.role IS NOT DISTINCT FROM k.role AND m.tok < {_LEAST} AND m.tok + k.tok <= {_MOST} AS j
    FROM m JOIN k ON m.doc_id = k.doc_id AND k.chunk = m.chunk + 1) x JOIN k ON k.doc_id = x.doc_id AND k.chunk = x.nxt),
c AS (
  SELECT k.doc_id, held AS chunk, first(k.sec ORDER BY k.chunk) AS section, first(k.eff ORDER BY k.chunk) AS effective,
    coalesce(first(k.sub ORDER BY k.chunk), CASE WHEN first(k.eff ORDER BY k.chunk) <> first(k.sec ORDER BY k.chunk) THEN 'projected_from_' || first(k.sec ORDER BY k.chunk) END) AS subsection,
    first(k.role ORDER BY k.chunk) AS role, array_to_string(list_sort(list_distinct(flatten(list(k.cov)))), ',') AS effects, array_to_string(list_sort(list_distinct(flatten(list(k.pages)))), ',') AS pages,
    sum(k.tok)::BIGINT AS tokens, string_agg(k.text, chr(10) || chr(10) ORDER BY k.chunk) AS text
  FROM k JOIN m USING (doc_id, chunk) GROUP BY k.doc_id, held)"""


@query("x5_paragraph_states", f"WITH RECURSIVE {_PARAS}, {_STATES} SELECT doc_id, chunk::INT AS chunk, section, effective, subsection, role, effects, pages, tokens, md5(trim(text)) AS text_md5 FROM c")
def _(t: Tables) -> DataFrame:
    out = _chunks(t)
    return out.select(
        "doc_id", "chunk", "section", "effective", "subsection", "role", F.array_join("coverage_effects", ",").alias("effects"),
        F.array_join(F.transform("pages", lambda x: x.cast("string")), ",").alias("pages"), "tokens", F.md5("text").alias("text_md5"),
    )


_LIMIT_ROWS = ", ".join(f"('{name}', {v.chunks}, {v.tokens}, {v.priority}, {v.model}, {v.table})" for name, v in S.LIMITS.items())
_SUPER = f"""
known(section, n, t, priority, model, tab) AS (VALUES {_LIMIT_ROWS}),
lim AS (FROM known UNION ALL SELECT e.section, n, t, priority, model, tab FROM (SELECT DISTINCT effective AS section FROM c) e, known WHERE known.section = 'unknown' AND e.section NOT IN (SELECT section FROM known)),
i AS (SELECT c.*, string_split(pages, ',')[1]::BIGINT AS page, role IS NOT NULL OR section = 'endorsements' AS own FROM c),
base AS (SELECT doc_id, effective AS section, tokens, chunk, row_number() OVER (PARTITION BY doc_id, effective ORDER BY chunk) AS r FROM i WHERE NOT own),
f AS (
  SELECT doc_id, section, chunk, tokens, r, 0 AS part, tokens AS sum, 1 AS cnt FROM base WHERE r = 1
  UNION ALL
  SELECT b.doc_id, b.section, b.chunk, b.tokens, b.r, f.part + (f.sum + b.tokens > least(t, 6000) OR f.cnt >= n)::INT,
    CASE WHEN f.sum + b.tokens > least(t, 6000) OR f.cnt >= n THEN b.tokens ELSE f.sum + b.tokens END, CASE WHEN f.sum + b.tokens > least(t, 6000) OR f.cnt >= n THEN 1 ELSE f.cnt + 1 END
  FROM f JOIN base b ON f.doc_id = b.doc_id AND f.section = b.section AND b.r = f.r + 1 JOIN lim ON lim.section = b.section),
v AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY page, chunk) AS part FROM (
  SELECT *, coalesce((page > lag(page) OVER (PARTITION BY doc_id ORDER BY page, chunk) + 1)::INT, 0) AS new FROM i WHERE own)),
u AS (
  SELECT doc_id, section, part, count(*) AS chunks, sum(tokens)::BIGINT AS tokens, 0 AS late, min(min(chunk)) OVER (PARTITION BY doc_id, section) AS first FROM f GROUP BY doc_id, section, part
  UNION ALL
  SELECT doc_id, arg_min(effective, page * 1000000 + chunk), part, count(*), sum(tokens)::BIGINT, 1, 0 FROM v GROUP BY doc_id, part),
sc AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY priority, late, first, section, part) - 1 AS place, section, part::INT AS part, priority, model AS requires_model,
    tab AS table_only, chunks, tokens FROM u JOIN lim USING (section))"""


@query("c4_section_super_chunks", f"WITH RECURSIVE {_PARAS}, {_STATES}, {_SUPER} SELECT * FROM sc")
def _(t: Tables) -> DataFrame:
    return S.section_super_chunks(_chunks(t))


@query("c4_model_batches", f"""WITH RECURSIVE {_PARAS}, {_STATES}, {_SUPER},
q AS (SELECT doc_id, place, tokens, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS r FROM sc WHERE requires_model),
z AS (SELECT doc_id, place, r, 0 AS bin, tokens AS sum FROM q WHERE r = 1
  UNION ALL SELECT q.doc_id, q.place, q.r, z.bin + (z.sum + q.tokens > 12000)::INT, CASE WHEN z.sum + q.tokens > 12000 THEN q.tokens ELSE z.sum + q.tokens END FROM z JOIN q ON z.doc_id = q.doc_id AND q.r = z.r + 1)
SELECT doc_id, bin, count(*) AS super_chunks, sum(q.tokens)::BIGINT AS tokens FROM z JOIN q USING (doc_id, place) GROUP BY doc_id, bin""")
def _(t: Tables) -> DataFrame:
    out = S.model_batches(S.section_super_chunks(_chunks(t)))
    return out.groupBy("doc_id", "bin").agg(F.count("*").alias("super_chunks"), F.sum("size").cast("bigint").alias("tokens"))
