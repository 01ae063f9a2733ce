"""Queries of scalar functions, on literals with known answers and on the driver's texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import constants as K
from folioflow.functions import text as X
from folioflow.plans.register import Register, quoted, table
from folioflow.plans.segment_queries import sql_equation_only, sql_plain, sql_strip

REGISTER = Register()

PREDICATES = [
    "", " ", "a", "ab", "Hello world", "<math>x+y</math>", "<math>x</math> (1.2a)", "(3)", "(3.1.4b) ", "<math>ab\ncd</math>",
    "<math>ab</math> or <math>cd</math>", "see (2)", "123", "é", "éà", "αβ", "привет", "日本", "ไทย", "x <math>unclosed", "(1..2)", " 　", "{v1}", "{v12}\n", " {v1}", "{v1} a", "\x1c",
]


def _begun(spark, sf_dir, begins: list[str]):
    """(id, s) for every customer: one of the begins in turn, alone or with the customer's name behind it."""
    n, key = len(begins), F.col("c_custkey")
    begin = F.get(F.array(*map(F.lit, begins)), (key % n).cast("int"))
    return table(spark, sf_dir, "customer").select(key.alias("id"), F.when(F.floor(key / n) % 2 == 0, begin).otherwise(F.concat(begin, F.lit(" "), "c_name")).alias("s"))


def _begun_sql(begins: list[str]) -> str:
    n = len(begins)
    return f"(SELECT c_custkey AS id, CASE WHEN (c_custkey // {n}) % 2 = 0 THEN b ELSE b || ' ' || c_name END AS s FROM (SELECT *, ({quoted(begins)})[1 + c_custkey % {n}] AS b FROM customer)) AS t"


@REGISTER(rf"SELECT id, {sql_plain('s')} AS plain, {sql_equation_only('s')} AS equation_only, {sql_strip('s')} = '' OR regexp_matches(s, '^\{{v\p{{Nd}}+\}}\n?\z') AS passthrough FROM " + _begun_sql(PREDICATES))
def predicate_literals(spark, sf_dir):
    """P1, P2, P6."""
    return _begun(spark, sf_dir, PREDICATES).select("id", X.is_plain_text("s").alias("plain"), X.is_equation_only("s").alias("equation_only"), X.is_passthrough("s").alias("passthrough"))


@REGISTER(f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM documents) SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE {sql_plain('s')}) AS n_plain, count(*) FILTER (WHERE {sql_equation_only('s')}) AS n_equation FROM l GROUP BY doc_id")
def predicates_by_document(spark, sf_dir):
    """P1, P2 over every line."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("s"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(X.is_plain_text("s")).alias("n_plain"), F.count_if(X.is_equation_only("s")).alias("n_equation"))


OCR = ["ﬁnd  the ﬂow", "\n\n  a \n\n b  \n \n", "“quoted” – ‘it’s’ — 5−3…", "ét́e", "a\tb\t\tc", "x  y", "", "ﬃ ﬄ ﬀ", "a\x07b​c", "one\ntwo"]


def _ocr_sql(x: str) -> str:
    out = rf"regexp_replace(nfc_normalize({x}), '[\x00-\x08\x0b-\x1f\x7f-\x{{9f}}\x{{ad}}\x{{200b}}-\x{{200f}}]', '', 'g')"
    for old, new in K.OCR_REPLACEMENTS:
        out = f"replace({out}, {quoted(old)}, {quoted(new)})"
    out = f"regexp_replace(replace({out}, chr(9), ' '), ' +', ' ', 'g')"
    lines = f"array_to_string(list_transform(string_split({out}, chr(10)), lambda v: {sql_strip('v')}), chr(10))"
    return rf"regexp_replace({lines}, '^\n+|\n+\z', '', 'g')"


@REGISTER(f"SELECT id, {_ocr_sql('s')} AS cleaned FROM " + _begun_sql(OCR))
def ocr_clean_literals(spark, sf_dir):
    """F1."""
    return _begun(spark, sf_dir, OCR).select("id", X.clean_ocr_text("s").alias("cleaned"))


@REGISTER(f"SELECT doc_id, md5({_ocr_sql('text')}) AS cleaned_md5 FROM documents")
def ocr_clean_documents(spark, sf_dir):
    """F1 over every text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.clean_ocr_text("text")).alias("cleaned_md5"))


@REGISTER(r"SELECT doc_id, md5(regexp_replace(text, '[\x00-\x1f\x7f-\x{9f}\x{ad}\x{200b}-\x{200f}]', '', 'g')) AS kept_md5 FROM documents")
def control_characters_removed(spark, sf_dir):
    """F2 over every text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.remove_control_characters("text")).alias("kept_md5"))


ENTITIES = [("&lt;p&gt;", "<p>"), ("a &amp; b", "a & b"), ("&#233;&#xe9;", "éé"), ("&nbsp;", " "), ("&quot;x&#39;", "\"x'"), ("&unknown;", "&unknown;"), ("", "")]


@REGISTER("SELECT id, s AS resolved FROM " + _begun_sql([b for _, b in ENTITIES]))
def html_unescaped_literals(spark, sf_dir):
    """F3."""
    return _begun(spark, sf_dir, [a for a, _ in ENTITIES]).select("id", X.html_unescape("s").alias("resolved"))


@REGISTER("SELECT page_id, md5(regexp_replace(replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;?', '&', 'g')) AS html_md5 FROM pages")
def html_unescaped_pages(spark, sf_dir):
    """F3 over every page."""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(X.html_unescape("html")).alias("html_md5"))


THINK = ["<think>a</think>b", "<think></think>b", " <think>a</think>b", "<think>a\nb</think>\n\nc", "x<think>a</think>", "<think>a</think><think>b</think>c", "none", "<think>open", ""]


@REGISTER(
    r"SELECT id, regexp_replace(s, '(?s)^<think>.+?</think>', '') AS plain, regexp_replace(s, '(?s)^<think>.+?\n*(</think>|\n)*(</think>)\n*', '') AS lines, regexp_replace(s, '(?s)^\s*<think>.*?</think>', '') AS gateway FROM "
    + _begun_sql(THINK)
)
def think_stripped_literals(spark, sf_dir):
    """the three forms."""
    return _begun(spark, sf_dir, THINK).select("id", *[X.strip_think("s", f).alias(f) for f in ("plain", "lines", "gateway")])


PLACEHOLDERS = [("{v1} and {V 2}", [1, 2]), ("{ v 1 2 }", [12]), ("none", []), ("{v}", []), ("{v0}{v10}", [0, 10]), ("{v99999999999}", [None])]


@REGISTER(f"SELECT c_custkey AS id, CAST(({quoted([b for _, b in PLACEHOLDERS])})[1 + c_custkey % {len(PLACEHOLDERS)}] AS INTEGER[]) AS ids FROM customer")
def placeholder_literals(spark, sf_dir):
    """F7."""
    return _begun(spark, sf_dir, [a for a, _ in PLACEHOLDERS]).select("id", X.placeholder_ids("s").alias("ids"))


@REGISTER("SELECT p_partkey, '{v' || p_size || '}' AS made, CAST(p_size AS INTEGER) AS parsed FROM part")
def placeholders_made(spark, sf_dir):
    """Made and parsed back."""
    made = X.placeholder("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", made.alias("made"), X.placeholder_ids(made)[0].alias("parsed"))


@REGISTER("SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(p_name, '(?s).'), lambda c: format('{:04x}', unicode(c))), '') AS wide, array_to_string(list_transform(regexp_extract_all(p_name, '(?s).'), lambda c: format('{:02x}', unicode(c))), '') AS narrow FROM part")
def glyph_codes(spark, sf_dir):
    """F9."""
    return table(spark, sf_dir, "part").select("p_partkey", X.hex_codes("p_name", 4).alias("wide"), X.hex_codes("p_name", 2).alias("narrow"))


@REGISTER("SELECT p_partkey, '/tiro ' || format('{:.6f}', CAST(p_size AS DOUBLE)) || ' Tf 1 0 0 1 ' || format('{:.6f}', p_retailprice) || ' 0.500000 Tm [<41>] TJ ' AS text_op, 'ET q 1 0 0 1 ' || format('{:.6f}', p_retailprice) || ' 1.000000 cm [] 0 d 0 J 0.250000 w 0 0 m ' || format('{:.6f}', CAST(p_size AS DOUBLE)) || ' 0.000000 l S Q BT ' AS line_op FROM part")
def draw_ops(spark, sf_dir):
    """F10."""
    size = F.col("p_size").cast("double")
    return table(spark, sf_dir, "part").select("p_partkey", X.text_op(F.lit("tiro"), size, "p_retailprice", F.lit(0.5), F.lit("41")).alias("text_op"), X.line_op("p_retailprice", F.lit(1.0), size, F.lit(0.0), F.lit(0.25)).alias("line_op"))


GLYPHS = [("ABC+CMR10", "a"), ("CMMI10", "a"), ("Times", "="), ("Times", "α"), ("Times", "a"), ("Times", " "), ("Times", "ʰ"), ("Times", "(cid:12)"), ("TimesMono", "a"), ("X+Y+MSBM10", "a"), ("", " "), ("Times", "́"), ("Times", "")]


@REGISTER(r"SELECT id, regexp_matches(c, '^\(cid:') OR regexp_matches(string_split(f, '+')[-1], '^(CM[^R]|MS.M|XY|MT|BL|RM|EU|LA|RS|LINE|LCIRCLE|TeX-|rsfs|txsy|wasy|stmary|.*Mono|.*Code|.*Ital|.*Sym|.*Math)') OR (c <> '' AND c <> ' ' AND regexp_matches(c, '^[\p{Lm}\p{Mn}\p{Sk}\p{Sm}\p{Zl}\p{Zp}\p{Zs}\x{370}-\x{3ff}]')) AS formula FROM " + f"(SELECT p_partkey AS id, ({quoted([f for f, _ in GLYPHS])})[1 + p_partkey % {len(GLYPHS)}] AS f, CASE WHEN p_partkey % 3 = 0 THEN substr(p_name, 1, 1) ELSE ({quoted([c for _, c in GLYPHS])})[1 + (p_partkey // 5) % {len(GLYPHS)}] END AS c FROM part) AS t")
def formula_glyph_literals(spark, sf_dir):
    """P4."""
    n, key = len(GLYPHS), F.col("p_partkey")
    pick = lambda xs, at: F.get(F.array(*map(F.lit, xs)), (at % n).cast("int"))
    glyph = F.when(key % 3 == 0, F.substring("p_name", 1, 1)).otherwise(pick([c for _, c in GLYPHS], F.floor(key / 5)))
    rows = table(spark, sf_dir, "part").select(key.alias("id"), pick([f for f, _ in GLYPHS], key).alias("f"), glyph.alias("c"))
    return rows.select("id", X.is_formula_glyph("f", "c").alias("formula"))


@REGISTER("SELECT l_orderkey, l_linenumber, count(*) FILTER (WHERE l_discount = 0 AND l_tax = 0) AS n_vertical FROM lineitem GROUP BY ALL")
def vertical_glyphs(spark, sf_dir):
    """P5."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count_if(X.is_vertical("l_discount", "l_tax")).alias("n_vertical"))


SERVICES = [("google", "google", None), ("ollama:gemma2", "ollama", "gemma2"), ("a:b:c", "a", "b:c"), ("x:", "x", "")]


@REGISTER("SELECT id, CASE WHEN instr(s, ':') > 0 THEN substr(s, 1, instr(s, ':') - 1) ELSE s END AS service, CASE WHEN instr(s, ':') > 0 THEN substr(s, instr(s, ':') + 1) END AS model FROM " + _begun_sql([s for s, _, _ in SERVICES]))
def service_literals(spark, sf_dir):
    """F18, J13."""
    parts = X.split_service("s")
    return _begun(spark, sf_dir, [s for s, _, _ in SERVICES]).select("id", parts.service.alias("service"), parts.model.alias("model"))


@REGISTER(r"SELECT page_id, regexp_replace(regexp_extract(url, '[^/]*$'), '(?s)^(\.*[^.].*)\.[^.]*$', '\1') AS stem FROM pages")
def file_stems(spark, sf_dir):
    """F21, K1."""
    return table(spark, sf_dir, "pages").select("page_id", X.file_stem("url").alias("stem"))


_HEIGHTS = " ".join(f"WHEN lang = '{k}' THEN {v}::DOUBLE" for k, v in K.LINE_HEIGHTS.items())


@REGISTER(f"SELECT doc_id, CASE {_HEIGHTS} ELSE 1.1::DOUBLE END AS line_height, CASE WHEN lang IN ('ja') THEN 'SourceHanSerifJP-Regular.ttf' WHEN lang = 'ko' THEN 'SourceHanSerifKR-Regular.ttf' ELSE 'GoNotoKurrent-Regular.ttf' END AS font, CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' WHEN 'es' THEN 'Spanish' END AS name, lang AS code FROM documents")
def language_tables(spark, sf_dir):
    """What is looked up by language."""
    return table(spark, sf_dir, "documents").select("doc_id", X.line_height("lang").alias("line_height"), X.font_of("lang").alias("font"), X.language_name("lang").alias("name"), X.provider_code("lang", "google").alias("code"))


@REGISTER("SELECT doc_id, list_reduce(range(1, 65), lambda h, i: CASE WHEN 2 * 10 * h > n_chars % 40 AND h >= 1 THEN h - 0.05::DOUBLE ELSE h END, 1.4::DOUBLE) AS fitted FROM documents")
def fitted_line_heights(spark, sf_dir):
    """The height shrinks in steps while the lines overflow."""
    return table(spark, sf_dir, "documents").select("doc_id", X.shrunk_line_height(F.lit(1.4), F.lit(2), F.lit(10), F.col("n_chars") % 40).alias("fitted"))


@REGISTER("SELECT doc_id, CAST(least(length(text), 5000) AS INTEGER) AS google, CAST(least(length(text), 1000) AS INTEGER) AS bing, CAST(greatest(length(text) * 5, 2000) AS INTEGER) AS tokens, strlen(CAST(to_json(text) AS VARCHAR)) AS json_bytes FROM documents")
def text_limits(spark, sf_dir):
    """O6, F24, W2's byte count over every text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.length(X.cap("text", "google")).alias("google"), F.length(X.cap("text", "bing")).alias("bing"), X.token_limit("text", 2000).alias("tokens"), X.json_bytes("text").cast("long").alias("json_bytes"))


@REGISTER("SELECT l_orderkey, l_linenumber, l_discount + l_tax + 0 = 0 AS black, TRY_CAST(CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag ELSE CAST(l_linenumber AS VARCHAR) || '.5' END AS DOUBLE) AS number FROM lineitem")
def colours_and_numbers(spark, sf_dir):
    """Black colours; text that is not a number gives null."""
    text = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).otherwise(F.concat(F.col("l_linenumber").cast("string"), F.lit(".5")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", X.is_black(F.array("l_discount", "l_tax", F.lit(0.0))).alias("black"), X.safe_float(text).alias("number"))


@REGISTER("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity < 5")
def thin_lines(spark, sf_dir):
    """P11."""
    return table(spark, sf_dir, "lineitem").where(F.col("l_quantity") < K.MAX_LINE_WIDTH).select("l_orderkey", "l_linenumber", "l_quantity")


@REGISTER("SELECT event_id, value FROM events WHERE isfinite(value)")
def finite_values(spark, sf_dir):
    """P17."""
    return table(spark, sf_dir, "events").where(~F.isnan("value") & (F.abs("value") < float("inf"))).select("event_id", "value")


@REGISTER("SELECT doc_id, md5('to ' || lang || ': ' || source || ' $5 $unknown') AS prompt_md5 FROM documents")
def filled_templates(spark, sf_dir):
    """Templates keep names they do not know."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.fill_template("to $lang: ${source} $$5 $unknown", {"lang": F.col("lang"), "source": F.col("source")})).alias("prompt_md5"))
