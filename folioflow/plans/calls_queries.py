"""Queries of the cache, glossary, response reconciliation and rate audit.

events stand for cache writes and the call log, labels for the answers that came back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folioflow.functions import constants as K
from folioflow.functions import jsonschema
from folioflow.functions import text as X
from folioflow.operators import calls, gateway, quality
from folioflow.operators.cachelog import CacheLog
from folioflow.plans.register import Register, table
from folioflow.staging import shared_dir

REGISTER = Register()


def _writes(spark, sf_dir):
    own = table(spark, sf_dir, "events")
    return own.select(F.col("event_type").alias("translate_engine"), F.lit(X.canonical_params({"lang_out": "en", "lang_in": "de"})).alias("translate_engine_params"), F.col("user_id").cast("string").alias("original_text"), F.col("event_id").cast("string").alias("translation"), F.col("event_id").alias("write_seq"))


def _cache(spark, sf_dir):
    writes = _writes(spark, sf_dir)
    return calls.upsert_cache(writes.where("write_seq % 2 = 0"), writes.where("write_seq % 2 = 1"))


_LAST = "SELECT event_type AS translate_engine, CAST(user_id AS VARCHAR) AS original_text, CAST(max(event_id) AS VARCHAR) AS translation, max(event_id) AS write_seq FROM events GROUP BY event_type, user_id"


@REGISTER(f"{_LAST}")
def cache_last_wins(spark, sf_dir):
    """A4, K6: upsert of odd writes into even ones, the last of each key stays."""
    return _cache(spark, sf_dir).drop("translate_engine_params")


@REGISTER(f"WITH c AS ({_LAST}), e AS (SELECT DISTINCT event_type FROM events) SELECT e.event_type AS translate_engine, c_custkey AS custkey, c.translation FROM customer CROSS JOIN e LEFT JOIN c ON c.translate_engine = e.event_type AND c.original_text = CAST(c_custkey AS VARCHAR)")
def cache_lookup(spark, sf_dir):
    """Hits and misses of the three-column key."""
    found = calls.lookup_cache(_texts(spark, sf_dir), _cache(spark, sf_dir))
    return found.select("translate_engine", F.col("original_text").cast("long").alias("custkey"), "translation")


def _texts(spark, sf_dir):
    """Every customer key as a text for every engine in the log."""
    engines = table(spark, sf_dir, "events").groupBy().agg(F.sort_array(F.collect_set("event_type")).alias("es"))
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("original_text"))
    # Dealt out first: narrow keys of one split of a file are very many rows, and each becomes one for every engine.
    keys = keys.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "original_text")
    # One row of engine names: its size is that of a fixed vocabulary.
    return keys.join(F.broadcast(engines)).select(F.explode("es").alias("translate_engine"), F.lit(X.canonical_params({"lang_in": "de", "lang_out": "en"})).alias("translate_engine_params"), "original_text")


@REGISTER(f"WITH c AS ({_LAST}), e AS (SELECT DISTINCT event_type FROM events) SELECT e.event_type AS translate_engine, count(*) AS n_misses FROM customer CROSS JOIN e WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.translate_engine = e.event_type AND c.original_text = CAST(c_custkey AS VARCHAR)) GROUP BY 1")
def cache_misses(spark, sf_dir):
    """Distinct texts to call for."""
    return calls.cache_misses(_texts(spark, sf_dir), _cache(spark, sf_dir)).groupBy("translate_engine").agg(F.count("*").alias("n_misses"))


@REGISTER("WITH l AS (SELECT DISTINCT l FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM conversations) WHERE trim(l) <> '') SELECT md5(l) AS text_md5, 'echo(' || l || ')' AS translation FROM l")
def translated_lines(spark, sf_dir):
    """Distinct worthwhile lines through the stand-in provider."""
    lines = table(spark, sf_dir, "conversations").select(F.explode(F.split("text", "\n", -1)).alias("original_text"))
    found = calls.call_provider(lines.where(~X.is_passthrough("original_text")).distinct(), calls.EchoProvider())
    return found.select(F.md5("original_text").alias("text_md5"), "translation")


@REGISTER("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(CAST(ts AS TIMESTAMP)) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS n_window FROM events")
def rate_audit_60s(spark, sf_dir):
    """Calls of a user in the half-open minute up to each call."""
    return calls.rate_audit(table(spark, sf_dir, "events"), ["user_id"]).select("event_id", "n_window")


def _sent(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("seg_id"), "text", "lang")


def _received(spark, sf_dir):
    own = table(spark, sf_dir, "labels")
    return own.join(_sent(spark, sf_dir).select("source", "seg_id"), own.doc_id == F.col("seg_id")).select("source", "seg_id", "quality", "toxic")


@REGISTER("SELECT d.source, d.doc_id AS seg_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def missing_ids(spark, sf_dir):
    """Sent but not returned."""
    return calls.missing_ids(_sent(spark, sf_dir), _received(spark, sf_dir), ["source"]).select("source", "seg_id")


@REGISTER("SELECT source, l.doc_id AS seg_id FROM labels l JOIN documents d USING (doc_id) WHERE lang <> 'en'")
def unknown_ids(spark, sf_dir):
    """Returned, though only English ones were sent."""
    return calls.unknown_ids(_sent(spark, sf_dir).where("lang = 'en'"), _received(spark, sf_dir), ["source"]).select("source", "seg_id")


@REGISTER("SELECT source, l.doc_id AS seg_id, quality FROM labels l JOIN documents d USING (doc_id) WHERE lang = 'en'")
def known_ids(spark, sf_dir):
    """What stays when unknown ids are dropped."""
    return calls.known_ids(_sent(spark, sf_dir).where("lang = 'en'"), _received(spark, sf_dir), ["source"]).select("source", "seg_id", "quality")


@REGISTER("SELECT d.doc_id // 100 AS batch, list_sort(list(d.doc_id) FILTER (WHERE l.doc_id IS NULL)) AS missing FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def id_difference(spark, sf_dir):
    """The difference of id sets within each batch of a hundred."""
    batch = F.floor(F.col("seg_id") / 100).alias("batch")
    sent = _sent(spark, sf_dir).groupBy(batch).agg(F.collect_set("seg_id").alias("s"))
    got = _received(spark, sf_dir).groupBy(batch).agg(F.collect_set("seg_id").alias("r"))
    none = F.array().cast("array<bigint>")
    return sent.join(got, "batch", "left").select("batch", F.sort_array(F.array_except("s", F.coalesce("r", none))).alias("missing"))


@REGISTER("SELECT event_type, user_id AS seg_id, arg_max(props, event_id) AS t FROM events GROUP BY event_type, user_id")
def last_duplicate_wins(spark, sf_dir):
    """A6."""
    own = table(spark, sf_dir, "events").select("event_type", F.col("user_id").alias("seg_id"), F.col("event_id").alias("pos"), F.col("props").alias("t"))
    return calls.last_of_each(own, ["event_type"])


@REGISTER("""WITH p AS (SELECT event_type, event_id % 3 AS part, event_id AS pos, CASE WHEN user_id % 50 <> 0 THEN user_id END AS id FROM events),
r AS (SELECT *, min(part) OVER (PARTITION BY event_type) AS m, row_number() OVER (PARTITION BY event_type, id ORDER BY part, pos) AS n FROM p)
SELECT event_type, part, pos FROM r WHERE part = m OR n = 1""")
def merged_parts(spark, sf_dir):
    """A5: items of continued answers, the first of each id."""
    own = table(spark, sf_dir, "events").select("event_type", (F.col("event_id") % 3).alias("part"), F.col("event_id").alias("pos"), F.when(F.col("user_id") % 50 != 0, F.col("user_id")).alias("id"))
    return calls.merge_parts(own, ["event_type"]).select("event_type", "part", "pos")


_FIRST = "CASE WHEN source = 'src3' THEN text WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN left(text, length(text) // 2) WHEN doc_id % 11 = 0 THEN text ELSE text || '.' END"


def _answers(df, value):
    return df.select("source", "seg_id", value.alias("t")).where("t is not null")


def _first(sent):
    half = F.left("text", F.floor(F.length("text") / 2).cast("int"))
    t = F.when(F.col("source") == "src3", F.col("text")).when(F.col("seg_id") % 3 == 0, F.lit(None)).when(F.col("seg_id") % 7 == 0, half).when(F.col("seg_id") % 11 == 0, F.col("text")).otherwise(F.concat("text", F.lit(".")))
    return _answers(sent, t)


@REGISTER(f"SELECT source, bool_and(coalesce(({_FIRST}) = text, false)) AS unchanged FROM documents GROUP BY source")
def unchanged_groups(spark, sf_dir):
    """Batches that came back untranslated."""
    sent = _sent(spark, sf_dir)
    return calls.all_unchanged(sent, _first(sent), ["source"])


@REGISTER(f"""WITH a AS (SELECT source, doc_id, text, {_FIRST} AS t1, CASE WHEN doc_id % 6 = 0 THEN 'R' || text END AS t2, 'U' || text AS t3, CASE WHEN doc_id % 14 = 0 THEN 'L' || text END AS t4 FROM documents),
b AS (SELECT *, coalesce(t1, t2, text) AS t FROM a),
c AS (SELECT *, bool_and(t = text) OVER (PARTITION BY source) AS same, bool_and(t3 = text) OVER (PARTITION BY source) AS same3 FROM b),
d AS (SELECT *, CASE WHEN same AND NOT same3 THEN t3 ELSE t END AS u FROM c)
SELECT source, doc_id AS seg_id,
  md5(CASE WHEN length(text) >= 20 AND abs(length(u) - length(text)) / greatest(length(text), 1) > {K.LENGTH_TOLERANCE} AND t4 IS NOT NULL THEN t4 ELSE u END) AS t_md5,
  CASE WHEN length(text) >= 20 AND abs(length(u) - length(text)) / greatest(length(text), 1) > {K.LENGTH_TOLERANCE} AND t4 IS NOT NULL THEN 'length' WHEN same AND NOT same3 THEN 'unchanged' WHEN t1 IS NOT NULL THEN 'first' WHEN t2 IS NOT NULL THEN 'retry' ELSE 'source' END AS source_of FROM d""")
def reconcile_with_fallback(spark, sf_dir):
    """All rounds of answers settled."""
    sent = _sent(spark, sf_dir).drop("lang")
    again = _answers(sent, F.when(F.col("seg_id") % 6 == 0, F.concat(F.lit("R"), "text")))
    other = _answers(sent, F.concat(F.lit("U"), "text"))
    length = _answers(sent, F.when(F.col("seg_id") % 14 == 0, F.concat(F.lit("L"), "text")))
    found = calls.reconcile(sent, _first(sent), again, other, length, ["source"])
    return found.select("source", "seg_id", F.md5("t").alias("t_md5"), "source_of")


@REGISTER(f"""WITH a AS (SELECT text, CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 7 = 0 THEN left(text, length(text) // 2) ELSE text END AS t FROM documents)
SELECT count(*) AS n_segments, count(*) FILTER (WHERE t <> '') AS n_translated, count(*) FILTER (WHERE t <> '' AND length(text) >= 20 AND abs(length(t) - length(text)) / greatest(length(text), 1) > {K.LENGTH_TOLERANCE}) AS n_violations, count(*) FILTER (WHERE t = '') AS n_untranslated FROM a""")
def translation_report(spark, sf_dir):
    """A13, P12, A11."""
    return quality.translation_report(_reported(spark, sf_dir))


def _reported(spark, sf_dir):
    half = F.left("text", F.floor(F.length("text") / 2).cast("int"))
    t = F.when(F.col("doc_id") % 5 == 0, "").when(F.col("doc_id") % 7 == 0, half).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", "text", t.alias("translation"))


@REGISTER(f"""WITH a AS (SELECT doc_id, text, CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 7 = 0 THEN left(text, length(text) // 2) ELSE text END AS t FROM documents),
k AS (SELECT *, CASE WHEN t = '' THEN 'untranslated' WHEN length(text) >= 20 AND abs(length(t) - length(text)) / greatest(length(text), 1) > {K.LENGTH_TOLERANCE} THEN 'length' END AS kind FROM a)
SELECT doc_id, kind, CASE WHEN t <> '' THEN round(length(t) / greatest(length(text), 1), 4) END AS ratio, left(text, 60) AS excerpt FROM k WHERE kind IS NOT NULL""")
def report_lines(spark, sf_dir):
    """What a report names."""
    return quality.report_lines(_reported(spark, sf_dir)).select("doc_id", "kind", "ratio", "excerpt")


_TERMS = "SELECT lower(trim(string_split(text, ' ')[1])) AS src_key, CAST(item_id AS VARCHAR) AS dst, item_id % 3 AS chunk_no, item_id AS item_pos FROM benchmark"


def _terms(spark, sf_dir):
    own = table(spark, sf_dir, "benchmark")
    terms = own.select(F.lit(0).alias("doc_id"), F.concat(F.lit(" "), F.split("text", " ")[0]).alias("src"), F.col("item_id").cast("string").alias("dst"), (F.col("item_id") % 3).alias("chunk_no"), F.col("item_id").alias("item_pos"))
    return calls.merge_glossary(terms).drop("doc_id")


@REGISTER(f"WITH t AS ({_TERMS}) SELECT src_key, arg_min(dst, chunk_no * 1000000000 + item_pos) AS dst FROM t GROUP BY src_key")
def glossary_first_wins(spark, sf_dir):
    """A3: the first meaning of each term, in order of chunks."""
    return _terms(spark, sf_dir)


_MATCHES = f"t AS ({_TERMS}), g AS (SELECT src_key, arg_min(dst, chunk_no * 1000000000 + item_pos) AS dst FROM t GROUP BY src_key), m AS (SELECT doc_id, src_key, dst FROM documents JOIN g ON contains(lower(text), src_key))"


@REGISTER(f"WITH {_MATCHES} SELECT * FROM m")
def glossary_matches(spark, sf_dir):
    """Terms that occur in a text, also within words."""
    chunks = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("chunk_text"))
    return calls.glossary_matches(chunks, _terms(spark, sf_dir)).select("doc_id", "src_key", "dst")


@REGISTER(f"WITH {_MATCHES} SELECT * FROM m")
def glossary_matches_by_gram(spark, sf_dir):
    """J3 as for a glossary too large to broadcast: shared grams first, then verified."""
    chunks = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("chunk_text"))
    return calls.glossary_matches(chunks, _terms(spark, sf_dir), broadcast_terms=0).select("doc_id", "src_key", "dst")


@REGISTER(f"WITH {_MATCHES} SELECT doc_id, string_agg(src_key || ' = ' || dst, chr(10) ORDER BY src_key) AS glossary FROM m GROUP BY doc_id")
def glossary_blocks(spark, sf_dir):
    """The glossary lines of each chunk."""
    return calls.glossary_block(glossary_matches(spark, sf_dir), ["doc_id"])


@REGISTER("SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, seg_id, md5(t) AS t_md5 FROM conversations, LATERAL (VALUES (0, 'b', text), (1, 'a', 'T: ' || text)) AS x(pos, seg_id, t)")
def parsed_answers(spark, sf_dir):
    """Turns as answers in five shapes: a list, an object, a fence around a list, prose around it, a list cut off."""
    own = table(spark, sf_dir, "conversations")
    other = F.concat(F.lit("T: "), "text")
    item = lambda k, t: F.struct(F.lit(k).alias("id"), t.alias("t"))
    listed = F.to_json(F.array(item("b", F.col("text")), item("a", other)))
    shapes = [listed, F.to_json(F.struct(F.col("text").alias("b"), other.alias("a"))), F.concat(F.lit("```json\n"), listed, F.lit("\n```")), F.concat(F.lit("Here it is: "), listed, F.lit(" Good luck")), F.concat(F.substring(listed, F.lit(1), F.length(listed) - 1), F.lit(', {"id": "c", "t": "cut'))]
    raw = own.select("conv_id", "turn", F.get(F.array(*shapes), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(5))).cast("int")).alias("answer"))
    return calls.parse_answers(raw, ["conv_id", "turn"]).select("conv_id", "turn", "pos", "seg_id", F.md5("t").alias("t_md5"))


#: Every keyword of the compiler, for records made of events.
EVENT_SCHEMA = {
    "type": "object", "required": ["id", "kind", "value"], "additionalProperties": False,
    "properties": {
        "id": {"type": ["integer", "null"]}, "kind": {"enum": ["click", "view", "purchase"]}, "value": {"$ref": "#/$defs/amount"}, "version": {"const": 2},
        "box": {"type": "array", "items": {"type": "number", "exclusiveMinimum": -1, "exclusiveMaximum": 1000}, "minItems": 3, "maxItems": 4},
        "note": {"anyOf": [{"type": "string", "minLength": 2, "maxLength": 5, "pattern": "^[a-z]+$"}, {"type": "boolean"}]}, "more": {"type": "object", "additionalProperties": {"type": "string"}},
    },
    "$defs": {"amount": {"type": "number", "minimum": 5, "maximum": 40}},
}


@REGISTER(
    """WITH e AS (SELECT event_id AS i, event_type AS kind, value, event_id % 17 AS k FROM events),
x AS (SELECT i, unnest(list_filter([
  CASE WHEN k = 0 THEN '$: is no JSON' END,
  CASE WHEN k = 1 THEN '$.kind: is required' END,
  CASE WHEN k = 2 THEN '$.id: is no integer or null' END,
  CASE WHEN k NOT IN (0, 1) AND kind NOT IN ('click', 'view', 'purchase') THEN '$.kind: is none of "click", "view", "purchase"' END,
  CASE WHEN k <> 0 AND value < 5 THEN '$.value: below 5' END,
  CASE WHEN k <> 0 AND value > 40 THEN '$.value: above 40' END,
  CASE WHEN k = 3 THEN '$.version: is none of 2' END,
  CASE WHEN k = 4 THEN '$.box: fewer than 3 items' END,
  CASE WHEN k = 5 THEN '$.box: more than 4 items' END,
  CASE WHEN k = 6 THEN '$.box[1]: is no number' END,
  CASE WHEN k = 7 THEN '$.box[2]: not above -1' END,
  CASE WHEN k = 8 THEN '$.box[0]: not below 1000' END,
  CASE WHEN k IN (9, 10, 11, 12) THEN '$.note: fits none of the forms' END,
  CASE WHEN k = 14 THEN '$.more.b: is no string' END,
  CASE WHEN k = 15 THEN '$.extra: is no field here' END], lambda v: v IS NOT NULL)) AS error FROM e)
SELECT i AS event_id, error FROM x"""
)
def schema_violations(spark, sf_dir):
    """C6 JSON_SCHEMA: events as JSON records with faults in turn, against a schema with every keyword."""
    own = table(spark, sf_dir, "events").select(F.col("event_id").alias("i"), "event_type", "value", (F.col("event_id") % 17).alias("k"))
    k = lambda n, a, b: F.when(F.col("k") == n, F.lit(a)).otherwise(F.lit(b))
    note = F.when(F.col("k") == 9, '"a"').when(F.col("k") == 10, '"abcdef"').when(F.col("k") == 11, '"A1"').when(F.col("k") == 12, "7").when(F.col("k") == 13, "true").otherwise('"abc"')
    box = F.when(F.col("k") == 4, "[1,2]").when(F.col("k") == 5, "[1,2,3,4,5]").when(F.col("k") == 6, '[1,"2",3]').when(F.col("k") == 7, "[1,2,-1]").when(F.col("k") == 8, "[1000,2,3]").otherwise("[0,1.5,999]")
    kind = F.when(F.col("k") == 1, F.lit("")).otherwise(F.concat(F.lit('"kind":'), F.to_json(F.struct(F.col("event_type").alias("x"))).substr(F.lit(6), F.length("event_type") + 2), F.lit(",")))
    raw = F.concat(F.lit('{"id":'), F.when(F.col("k") == 2, F.lit('"x"')).when(F.col("k") == 16, F.lit("null")).otherwise(F.col("i").cast("string")), F.lit(","), kind, F.lit('"value":'), F.col("value").cast("decimal(20,6)").cast("string"), F.lit(',"version":'), k(3, "3", "2"), F.lit(',"box":'), box, F.lit(',"note":'), note, F.lit(',"more":'), k(14, '{"a":"x","b":1}', '{"a":"x"}'), k(15, ',"extra":[]', ""), k(0, "", "}"))
    found = own.select(F.col("i").alias("event_id"), F.explode(jsonschema.violations(raw, EVENT_SCHEMA)).alias("e"))
    return found.select("event_id", F.concat("e.path", F.lit(": "), "e.message").alias("error"))


@REGISTER(r"""SELECT event_id, md5('{"a":[{"b":1,"y":true},' || user_id || '],"p":' || replace(props, ' ', '') || ',"\u00e9":"\ud83d\ude00 ' || event_type || '"}') AS digest, CAST(NULL AS VARCHAR) AS broken FROM events""")
def canonical_params(spark, sf_dir):
    """Nested parameters in one form, whatever the order of their keys."""
    own = table(spark, sf_dir, "events")
    parts = [F.concat(F.lit('"p": '), "props"), F.concat(F.lit('"a" :[{"y":true , "b":1}, '), "user_id", F.lit("]")), F.concat(F.lit('"é":"😀 '), "event_type", F.lit('"'))]
    turned = lambda k: F.concat(F.lit("{"), F.concat_ws(" , ", *parts[k:], *parts[:k]), F.lit("}"))
    raw = F.get(F.array(*map(turned, range(3))), (F.col("event_id") % 3).cast("int"))
    return own.select("event_id", F.md5(X.canonical_json(raw)).alias("digest"), X.canonical_json(F.concat(raw, F.lit("x"))).alias("broken"))


@REGISTER("SELECT n_nationkey AS nationkey, 'v2' AS model, n_name AS lang, 'x' AS extra FROM nation")
def changed_params(spark, sf_dir):
    """parameters put in or replaced."""
    own = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nationkey"), F.create_map(F.lit("model"), F.lit("v1"), F.lit("lang"), F.col("n_name")).alias("p"))
    new = X.with_params("p", {"model": "v2", "extra": "x"})
    return own.select("nationkey", new["model"].alias("model"), new["lang"].alias("lang"), new["extra"].alias("extra"))


@REGISTER(
    """WITH e AS (SELECT doc_id, source AS engine, string_split(text, chr(10))[1] AS line FROM documents),
l AS (SELECT engine, line, max(doc_id) AS last FROM e GROUP BY engine, line)
SELECT e.doc_id, CASE WHEN last % 7 <> 0 THEN 'T' || last END AS translation FROM e JOIN l ON l.engine IS NOT DISTINCT FROM e.engine AND l.line IS NOT DISTINCT FROM e.line"""
)
def cache_log_lookup(spark, sf_dir):
    """The first lines of all documents, written to a log-structured cache in three writes by id, of which every
    seventh is a deletion; then all are looked up."""
    own = table(spark, sf_dir, "documents")
    keys = own.select("doc_id", F.col("source").alias("translate_engine"), F.lit("{}").alias("translate_engine_params"), F.get(F.split("text", "\n", -1), F.lit(0)).alias("original_text"))
    log = CacheLog(spark, f"{shared_dir(spark)}/cache-{uuid.uuid4().hex}")
    writes = keys.withColumns({"translation": F.concat(F.lit("T"), "doc_id"), "write_seq": F.col("doc_id"), "deleted": F.col("doc_id") % 7 == 0})
    for third in (2, 0, 1):
        log.put(writes.where(F.col("doc_id") % 3 == third))
    return log.lookup(keys).select("doc_id", "translation")


MOST_CALLS, MOST_TOKENS = 25, 3000


@REGISTER(
    f"""WITH RECURSIVE q AS (SELECT conv_id, turn, greatest(1, CAST(ceil(length(text) / 4) AS BIGINT)) AS tokens, row_number() OVER (ORDER BY conv_id, turn) AS i FROM conversations),
s AS (SELECT conv_id, turn, i, tokens AS used, 1 AS n, 0 AS slot FROM q WHERE i = 1
  UNION ALL SELECT q.conv_id, q.turn, q.i, CASE WHEN s.n = {MOST_CALLS} OR s.used + q.tokens > {MOST_TOKENS} THEN q.tokens ELSE s.used + q.tokens END,
    CASE WHEN s.n = {MOST_CALLS} OR s.used + q.tokens > {MOST_TOKENS} THEN 1 ELSE s.n + 1 END, CASE WHEN s.n = {MOST_CALLS} OR s.used + q.tokens > {MOST_TOKENS} THEN s.slot + 1 ELSE s.slot END
  FROM s JOIN q ON q.i = s.i + 1)
SELECT conv_id, turn, CAST(slot AS INTEGER) AS slot, CAST(slot * 65 AS INTEGER) AS admit_at FROM s"""
)
def admission_schedule(spark, sf_dir):
    """All turns as calls of one job, at most so many calls and tokens in any minute."""
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.ceil(F.length("text") / 4).alias("tokens"))
    return gateway.scheduled(own, ["conv_id", "turn"], "tokens", MOST_CALLS, MOST_TOKENS).select("conv_id", "turn", "slot", "admit_at")
