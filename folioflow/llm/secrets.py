"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Matches are found in the scan; only lengths and hashes of values leave it. Positions are running
sums of the lengths of the gaps and matches of a document. All candidate hashes are aggregated
by distinct repositories and owners: a value that several owners hold is a copied example, one
that stays with one owner in few repositories is taken for live. High-entropy tokens outside
the fixed patterns are reported only when they look live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.common import documents, materialize, split_join

# Patterns of the base kinds, in the order that breaks ties of start.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: The method's own candidates: long runs that mix upper case, lower case and digits.
TOKEN = r"[A-Za-z0-9+/_-]{24,}"
#: (kind, pattern, group of the value, least length of the value)
KINDS = (("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24), ("token", TOKEN, 0, 24))
BASE = 3
#: A value is live-looking with one owner and at most this many repositories.
MAX_REPOS = 3


def _parts(text: Column, pattern: str, group: int) -> Column:
    """Lengths of the gaps and matches, lengths and hashes of the values, of all matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    measured = F.struct(
        F.transform(F.split(text, pattern, -1), F.length).alias("gaps"),
        F.transform(found, F.length).alias("lens"),
        F.transform(values, F.length).alias("sizes"),
        F.transform(values, F.md5).alias("hashes"),
        F.transform(values, lambda v: v.rlike("[A-Z]") & v.rlike("[a-z]") & v.rlike("[0-9]")).alias("mixed"),
    )
    return F.when(text.rlike(pattern), measured)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", max_repos: int = MAX_REPOS) -> DataFrame:
    """One row (id, secrets) for each row of docs.

    secrets lists structs (start, ord, kind, end, value_md5, repos, owners, live) by start and
    kind; start and end are code points of the whole text, end exclusive; repos and owners count
    the distinct repositories and owners of the value in all of docs. Matches of one kind do not
    overlap; those of different kinds may. Kind token appears only where it is live-looking and
    touches no span of another kind. A null or empty text has an empty list. Null repositories
    and owners each count as one. Repeated rows and null ids each keep their own row. Other
    columns of docs are not read.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    scanned = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.coalesce(F.col(f"`{repo_col}`").cast("string"), F.lit("")).alias("repo"),
        F.coalesce(F.col(f"`{owner_col}`").cast("string"), F.lit("")).alias("owner"),
        F.monotonically_increasing_id().alias("row"),
        text.alias("text"),
    )
    scanned = scanned.select("id", "repo", "owner", "row", *[_parts(F.col("text"), p, g).alias(k) for k, p, g, _ in KINDS])
    # Written once: from here on the row numbers hold, whatever executor is lost.
    rows = materialize(scanned, "secrets")

    zipped = lambda k: F.arrays_zip(*[F.col(f"{k}.{x}") for x in ("gaps", "lens", "sizes", "hashes", "mixed")])
    each = None
    for i, (kind, _, _, least) in enumerate(KINDS):
        own = rows.where(F.col(kind).isNotNull()).select("row", "repo", "owner", F.posexplode(zipped(kind)).alias("i", "m")).where("m.lens is not null")
        own = own.select("row", "repo", "owner", F.lit(i).alias("ord"), F.lit(kind).alias("kind"), F.lit(least).alias("least"), "i", "m.*")
        each = own if each is None else each.unionAll(own)
    before = Window.partitionBy("row", "ord").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("end", F.sum(F.col("gaps") + F.col("lens")).over(before).cast("int")).withColumn("start", (F.col("end") - F.col("lens")).cast("int"))
    placed = placed.where((F.col("sizes") >= F.col("least")) & ((F.col("ord") < BASE) | F.col("mixed")))
    # A token that touches a base span of its document is that span's business.
    by_start = Window.partitionBy("row").orderBy("start", "ord")
    base = F.col("ord") < BASE
    left = F.max(F.when(base, F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    right = F.min(F.when(base, F.col("start"))).over(by_start.rowsBetween(1, Window.unboundedFollowing))
    placed = placed.withColumn("left", left).withColumn("right", right)
    placed = placed.where(base | (F.coalesce(F.col("left") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("right") >= F.col("end"), F.lit(True))))

    owned = placed.groupBy("hashes").agg(F.countDistinct("repo").alias("repos"), F.countDistinct("owner").alias("owners"))
    judged = split_join(placed, owned, ["hashes"]).withColumn("live", (F.col("owners") == 1) & (F.col("repos") <= max_repos)).where(base | F.col("live"))
    secret = F.struct("start", "ord", "kind", "end", F.col("hashes").alias("value_md5"), "repos", "owners", "live")
    secrets = judged.groupBy("row").agg(F.sort_array(F.collect_list(secret)).alias("secrets"))
    none = F.array().cast(secrets.schema["secrets"].dataType)
    return rows.select("id", "row").join(secrets, "row", "left").select("id", F.coalesce("secrets", none).alias("secrets"))


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets of every document. A document stands for a repository, its source for the owner."""
    found = find_secrets(documents(spark, sf_dir))
    joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    base = F.filter("secrets", lambda s: s.ord < BASE)
    count = lambda kind: F.size(F.filter("secrets", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    live = F.size(F.filter("secrets", lambda s: s.live)).cast("long").alias("n_live")
    return found.select(F.col("id").alias("doc_id"), count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"), live)


def _kind_sql(i: int) -> str:
    kind, pattern, group, least = KINDS[i]
    p = pattern.replace("'", "''")
    return f"SELECT row, doc_id, owner, {i} AS ord, '{kind}' AS kind, {least} AS least, string_split_regex(t, '{p}') AS parts, regexp_extract_all(t, '{p}', 0) AS ms, regexp_extract_all(t, '{p}', {group}) AS vs FROM d WHERE regexp_matches(t, '{p}')"


OP3_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(source, '') AS owner, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(_kind_sql(i) for i in range(len(KINDS)))}),
e AS (SELECT row, doc_id, owner, ord, kind, least, unnest(parts[1:len(ms)]) AS gap, unnest(ms) AS hit, unnest(vs) AS v, generate_subscripts(ms, 1) AS i FROM m),
s AS (SELECT *, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY row, ord ORDER BY i) AS BIGINT) AS stop FROM e),
c AS (SELECT *, stop - length(hit) AS start FROM s WHERE length(v) >= least AND (ord < {BASE} OR (regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[0-9]')))),
w AS (SELECT *, max(CASE WHEN ord < {BASE} THEN stop END) OVER (PARTITION BY row ORDER BY start, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l,
        min(CASE WHEN ord < {BASE} THEN start END) OVER (PARTITION BY row ORDER BY start, ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r FROM c),
p AS (SELECT * FROM w WHERE ord < {BASE} OR (coalesce(l <= start, true) AND coalesce(r >= stop, true))),
o AS (SELECT v, count(DISTINCT doc_id) AS repos, count(DISTINCT owner) AS owners FROM p GROUP BY v),
j AS (SELECT p.*, owners = 1 AND repos <= {MAX_REPOS} AS live FROM p JOIN o USING (v)),
a AS (SELECT row, count(*) FILTER (WHERE ord = 0) AS n_assign, count(*) FILTER (WHERE ord = 1) AS n_access, count(*) FILTER (WHERE ord = 2) AS n_hex, count(*) FILTER (WHERE live) AS n_live,
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) FILTER (WHERE ord < {BASE}) AS base,
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) AS spans FROM j WHERE ord < {BASE} OR live GROUP BY row)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM d LEFT JOIN a ON d.row = a.row
"""
