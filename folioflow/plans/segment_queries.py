"""Queries of segments, chunks, pages and write-back. Documents stand for records, their lines for elements."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioflow.functions import constants as K
from folioflow.functions import text as X
from folioflow.operators import layout, nextfit, quality, segments
from folioflow.plans.register import Register, table

REGISTER = Register()

# The predicates in RE2: white space and digits spelled out, as its classes are ASCII.
WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LETTERS = r"[A-Za-z\x{C0}-\x{24F}\x{370}-\x{3FF}\x{400}-\x{4FF}\x{600}-\x{6FF}\x{900}-\x{97F}\x{E00}-\x{E7F}\x{2E80}-\x{9FFF}]{2,}"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WHITE}+|{WHITE}+$', '', 'g')"


def sql_no_math(x: str) -> str:
    return f"regexp_replace({x}, '(?s)<math>.*?</math>', '', 'g')"


def sql_plain(x: str) -> str:
    return f"regexp_matches({sql_no_math(x)}, '{LETTERS}')"


def sql_equation_only(x: str) -> str:
    no_label = rf"regexp_replace({sql_no_math(x)}, '\(\p{{Nd}}+(\.\p{{Nd}}+)*[a-z]?\)', '', 'g')"
    return f"{sql_strip(no_label)} = ''"


LINES = "l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)"
SEGMENTS = f"{LINES}, s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS seg FROM l WHERE line <> '' AND NOT ({sql_equation_only('line')}))"
CHUNKS = f"""{SEGMENTS}, z AS (SELECT doc_id, source, seg, strlen(CAST(seg AS VARCHAR)) + 4 + strlen(CAST(to_json(line) AS VARCHAR)) AS e FROM s),
f AS (SELECT doc_id, source, seg, 0 AS chunk, 2 + e AS used FROM z WHERE seg = 0
  UNION ALL SELECT z.doc_id, z.source, z.seg, CASE WHEN f.used + 2 + z.e > {K.CHUNK_BYTES} THEN f.chunk + 1 ELSE f.chunk END,
    CASE WHEN f.used + 2 + z.e > {K.CHUNK_BYTES} THEN 2 + z.e ELSE f.used + 2 + z.e END FROM f JOIN z ON z.doc_id = f.doc_id AND z.seg = f.seg + 1)"""


def _docs(spark, sf_dir):
    return segments.lines_as_documents(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


@REGISTER(f"WITH {SEGMENTS} SELECT doc_id, CAST(seg AS VARCHAR) AS seg_id, CAST(i AS INTEGER) AS elem_pos, md5(line) AS text_md5 FROM s")
def translatable_segments(spark, sf_dir):
    """The numbered segments of every document."""
    return segments.collect_segments(_docs(spark, sf_dir)).select("doc_id", "seg_id", "elem_pos", F.md5("text").alias("text_md5"))


@REGISTER(f"WITH {SEGMENTS} SELECT source, count(DISTINCT doc_id) AS n_docs, count(*) AS n_segments, count(*) FILTER (WHERE {sql_plain('line')}) AS n_plain FROM s GROUP BY source")
def segments_by_source(spark, sf_dir):
    """C1, P1 to P3, W1, A11."""
    found = segments.collect_segments(_docs(spark, sf_dir), carry=("source",))
    return found.groupBy("source").agg(F.countDistinct("doc_id").alias("n_docs"), F.count("*").alias("n_segments"), F.count_if(X.is_plain_text("text")).alias("n_plain"))


@REGISTER(f"WITH RECURSIVE {CHUNKS} SELECT doc_id, CAST(seg AS VARCHAR) AS seg_id, CAST(chunk AS INTEGER) AS chunk_no FROM f")
def chunk_assignment(spark, sf_dir):
    """Next-fit chunks by exact JSON bytes."""
    return segments.chunked_segments(_docs(spark, sf_dir)).select("doc_id", "seg_id", "chunk_no")


@REGISTER(f"WITH RECURSIVE {CHUNKS} SELECT doc_id, CAST(seg AS VARCHAR) AS seg_id, CAST(chunk AS INTEGER) AS chunk_no FROM f")
def chunk_assignment_by_rows(spark, sf_dir):
    """W2 for documents of any length: the same chunks from entries as rows, composed instead of walked."""
    found = segments.collect_segments(_docs(spark, sf_dir))
    entries = found.select("doc_id", "seg_id", F.col("seg_id").cast("long").alias("pos"), segments.entry_bytes(F.col("seg_id"), F.col("text")).alias("size"))
    return nextfit.next_fit(entries, ["doc_id"], "pos", "size", K.CHUNK_BYTES).select("doc_id", "seg_id", "chunk_no")


@REGISTER(f"WITH RECURSIVE {CHUNKS}, c AS (SELECT source, doc_id, chunk, count(*) AS n, max(used) AS bytes FROM f GROUP BY ALL) SELECT source, CAST(sum(n) AS BIGINT) AS n_segments, count(*) AS n_chunks, CAST(max(bytes) AS BIGINT) AS max_bytes FROM c GROUP BY source")
def chunk_stats(spark, sf_dir):
    """Chunks by source, measured on the payload. The flagship query."""
    found = segments.chunked_segments(_docs(spark, sf_dir), carry=("source",))
    size = F.sum(segments.entry_bytes(F.col("seg_id"), F.col("text")) + 2)
    per = found.groupBy("source", "doc_id", "chunk_no").agg(F.count("*").alias("n"), size.alias("bytes"))
    return per.groupBy("source").agg(F.sum("n").alias("n_segments"), F.count("*").alias("n_chunks"), F.max("bytes").alias("max_bytes"))


@REGISTER(f"WITH RECURSIVE {CHUNKS} SELECT doc_id, CAST(chunk AS INTEGER) AS chunk_no, list(CAST(seg AS VARCHAR) ORDER BY seg)[1:2] AS example_ids, count(*) AS n FROM f GROUP BY doc_id, chunk")
def chunk_examples(spark, sf_dir):
    """Payload maps and the first two ids of each chunk."""
    found = segments.payloads(segments.chunked_segments(_docs(spark, sf_dir)))
    return found.select("doc_id", "chunk_no", segments.example_ids(F.map_keys("payload")).alias("example_ids"), F.size("payload").cast("long").alias("n"))


@REGISTER(f"WITH {LINES}, s AS ({SEGMENTS.split(' s AS (', 1)[1][:-1]}), t AS (SELECT l.doc_id, l.i, CASE WHEN s.seg % 2 = 1 THEN 'T:' || l.line END AS t FROM l LEFT JOIN s ON s.doc_id = l.doc_id AND s.i = l.i) SELECT doc_id, count(*) AS n_elements, count(t) AS n_translated, md5(coalesce(string_agg(t, chr(10) ORDER BY i), '')) AS translated_md5 FROM t GROUP BY doc_id")
def write_back_translations(spark, sf_dir):
    """Odd segments get translations; the others keep no value."""
    docs = _docs(spark, sf_dir)
    done = segments.collect_segments(docs).where(F.col("seg_id").cast("int") % 2 == 1).select("doc_id", "seg_id", F.concat(F.lit("T:"), "text").alias("translation"))
    elements = F.col("pages")[0]["elements"]
    values = F.filter(F.transform(elements, lambda e: e.translated_text), lambda t: t.isNotNull())
    return segments.write_back(docs, done).select("doc_id", F.size(elements).cast("long").alias("n_elements"), F.size(values).cast("long").alias("n_translated"), F.md5(F.array_join(values, "\n")).alias("translated_md5"))


ELEMENTS = f"""{LINES}, e AS (SELECT *, (['Text', 'Section-header', 'Picture', 'Table', 'Formula', 'Caption', 'Table-of-contents', 'Stamp'])[1 + i % 8] AS label FROM l),
c AS (SELECT *, CASE WHEN label IN ('Section-header', 'Caption', 'Table-of-contents') THEN 'IN_PLACE' WHEN label = 'Picture' THEN 'BYPASS' WHEN label = 'Table' THEN 'TABLE' WHEN label = 'Formula' THEN 'EQUATION' ELSE 'FLOWING_TEXT' END AS category FROM e)"""


def _elements(spark, sf_dir):
    """Lines as layout elements with labels in turn, the last of them unknown."""
    labels = F.array(*[F.lit(x) for x in ("Text", "Section-header", "Picture", "Table", "Formula", "Caption", "Table-of-contents", "Stamp")])
    lines = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("pos", "source_text"))
    return lines.withColumn("label", F.get(labels, F.col("pos") % 8)).withColumn("category", X.category_of("label")).withColumn("y0", F.col("pos").cast("double"))


@REGISTER(f"WITH {ELEMENTS} SELECT category, count(*) AS n FROM c GROUP BY category")
def category_counts(spark, sf_dir):
    """Labels to categories with a default, counted."""
    return quality.category_counts(_elements(spark, sf_dir))


@REGISTER(f"WITH {ELEMENTS} SELECT doc_id, md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE category IN ('FLOWING_TEXT', 'IN_PLACE') AND line <> ''), '')) AS raw_md5 FROM c GROUP BY doc_id")
def page_raw_text(spark, sf_dir):
    """Flowing and in-place texts from top to bottom."""
    return layout.page_raw_text(_elements(spark, sf_dir), ["doc_id"]).select("doc_id", F.md5("raw_text").alias("raw_md5"))


@REGISTER(f"WITH {ELEMENTS} SELECT doc_id, CAST(i AS INTEGER) AS pos, '[' || label || '] ' || CASE WHEN length(line) > 80 THEN left(line, 80) || '...' ELSE line END AS hint FROM c WHERE label IN ('Section-header', 'Table-of-contents') AND line <> ''")
def toc_hints(spark, sf_dir):
    """P15."""
    return quality.toc_hints(_elements(spark, sf_dir)).select("doc_id", "pos", "hint")


@REGISTER(f"WITH {ELEMENTS} SELECT doc_id, CASE WHEN category = 'BYPASS' THEN 'none' WHEN category = 'TABLE' THEN 'structure' ELSE 'ocr' END AS route, count(*) AS n FROM c GROUP BY ALL")
def routes_by_category(spark, sf_dir):
    """Which step an element goes to."""
    return _elements(spark, sf_dir).groupBy("doc_id", quality.route_of("category").alias("route")).agg(F.count("*").alias("n"))


@REGISTER("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE text <> '') AS by_line, string_agg(text, ' ' ORDER BY turn) FILTER (WHERE text <> '') AS by_space, string_agg(text, ' | ' ORDER BY turn) FILTER (WHERE text <> '') AS by_cell FROM conversations GROUP BY conv_id")
def conversation_text(spark, sf_dir):
    """Ordered concatenation with the three separators."""
    own = table(spark, sf_dir, "conversations")
    joined = [layout.ordered_text(own, ["conv_id"], ["turn"], "text", sep, name) for sep, name in (("\n", "by_line"), (" ", "by_space"), (" | ", "by_cell"))]
    return joined[0].join(joined[1], "conv_id").join(joined[2], "conv_id")


@REGISTER("SELECT conv_id, 2 * turn AS out_pos, md5(text) AS text_md5 FROM conversations UNION ALL SELECT conv_id, 2 * turn + 1, md5('T:' || text) FROM conversations")
def interleave_variants(spark, sf_dir):
    """Original and translated turns in turn."""
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return segments.interleave(own, own.withColumn("text", F.concat(F.lit("T:"), "text")), "turn").select("conv_id", "out_pos", F.md5("text").alias("text_md5"))


@REGISTER("SELECT conv_id, CAST(floor(turn / 2) AS BIGINT) AS batch, count(*) AS n FROM conversations GROUP BY ALL")
def turn_batches(spark, sf_dir):
    """Fixed-size batches of positions."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id", segments.batch_number("turn", 2).alias("batch")).agg(F.count("*").alias("n"))


PAGES = "p AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM documents)"


def _pages(spark, sf_dir):
    """Documents as the pages of their source."""
    per = Window.partitionBy("source")
    own = table(spark, sf_dir, "documents").select("source", "doc_id")
    return own.withColumn("pos", (F.row_number().over(per.orderBy("doc_id")) - 1).cast("int")).withColumn("n", F.count("*").over(per))


@REGISTER(f"WITH {PAGES} SELECT source, CAST(pos AS INTEGER) AS pos, doc_id FROM p WHERE n <= 5 OR pos IN (0, n // 5, 2 * n // 5, 3 * n // 5, 4 * n // 5)")
def even_sample(spark, sf_dir):
    """Evenly sampled pages of every source."""
    pages = _pages(spark, sf_dir)
    wanted = pages.groupBy("source").agg(F.max("n").alias("n")).select("source", F.explode(segments.sampled_positions("n")).alias("pos"))
    return segments.select_pages(pages, wanted, ["source", "pos"]).select("source", "pos", "doc_id")


@REGISTER(f"WITH {PAGES}, w(k, pos) AS (VALUES (0, 0), (1, 1), (2, 2), (3, 4), (4, 1)) SELECT source, CAST(k AS INTEGER) AS k, CAST(p.pos AS INTEGER) AS pos, doc_id FROM w JOIN p ON p.pos = w.pos")
def pages_in_list_order(spark, sf_dir):
    """The pages of 1-3,5,2,9999 in that order, repeats kept, unknown ones skipped."""
    wanted = spark.range(1).select(F.posexplode(X.page_numbers(F.lit("1-3,5,2,9999999"))).alias("k", "pos"))
    return segments.pages_in_order(_pages(spark, sf_dir), wanted, ["pos"]).select("source", "k", "pos", "doc_id")


@REGISTER(f"WITH {PAGES} SELECT source, doc_id FROM p WHERE pos < 5")
def first_pages(spark, sf_dir):
    """The preset of the first five pages of a source."""
    return _pages(spark, sf_dir).where("pos < 5").select("source", "doc_id")


@REGISTER("SELECT n_nationkey AS xref, coalesce(s, n_name) AS content FROM nation LEFT JOIN (SELECT s_nationkey, max(s_name) AS s FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey")
def apply_patches(spark, sf_dir):
    """K9: objects with the patches that exist for them."""
    objects = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("xref"), F.col("n_name").alias("content"))
    patches = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("xref")).agg(F.max("s_name").alias("content"))
    return segments.apply_patches(objects, patches)
