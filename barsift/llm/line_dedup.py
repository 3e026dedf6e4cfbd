"""Line dedup by a fixed-depth log-template tree.

Each line descends a tree: first by its number of tokens, then by its ``LEAD``
leading tokens, where a token with a digit counts as a variable. A leaf
generalises its distinct lines to templates, a line to at most three:

* the line as it is;
* the leaf's usual template: a position is constant if one token fills it in at
  least ``constant`` of the leaf's lines and variable otherwise; a line that
  agrees with it in at least ``similar`` of its positions belongs to it;
* a pattern: a token that fills its position in at least ``min_docs`` of the leaf's
  lines is frequent, and a line's pattern is its frequent tokens at their places
  and variables elsewhere; it counts for a line whose tokens are frequent in at least
  ``similar`` of the positions. So a leaf has as many templates as recur in it,
  however many other lines share it.

(A token with a digit agrees with any other there.) Templates that occur in at
least ``min_docs`` documents are recurring, and all lines that belong to one are
dropped. Lines of up to ``LEAD`` tokens are wholly told by their leaf.

DataFrame functions only. Lines are first counted by leaf through hashes;
leaves met in one document alone go no further, and texts are not shuffled for
the search. Every grouping is pre-aggregated before its shuffle, so a line
found in most documents makes no large group. The table of open leaves is
broadcast behind a check of its size, and joined by sort-merge beyond it.

Defined cases: null texts have no lines and stay null; empty lines are kept; a
text whose lines all go becomes ''; a document's repeats of a line count once; a
document is its id and its text, so rows equal in both are one document, rows of
one id with other texts are several, and null ids are ids like others; every row
has its result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

LEAD = 3
BROADCAST_ROWS = 500_000
BLANKS = r"[\x20\x09\x0B-\x0D]+"


def _masked(token: Column) -> Column:
    return F.when(token.rlike("[0-9]"), F.lit("<*>")).otherwise(token)


def _lines(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(i, t, pos, line, n, leaf): the lines, with the document's id and its text's hash."""
    # most texts have single blanks only; plain searches tell, and spare them the pattern.
    # (All inside the generator's argument: what is below it runs once a text.)
    odd = F.lit(False)
    for run in ("  ", "\t", "\x0b", "\x0c", "\r"):
        odd = odd | F.contains(F.col(text), F.lit(run))
    even = F.when(odd, F.regexp_replace(text, BLANKS, " ")).otherwise(F.col(text))
    lines = docs.select(F.col(key).alias("i"), F.xxhash64(text).alias("t"), F.posexplode(F.split(even, "\n"))).toDF("i", "t", "pos", "line")
    lines = lines.withColumn("line", F.trim("line")).where("line <> ''")
    blanks = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit("")))
    head = F.split(F.substring_index("line", " ", LEAD), " ")
    return lines.withColumn("n", blanks + 1).withColumn("leaf", F.xxhash64("n", *[_masked(F.get(head, F.lit(i))) for i in range(LEAD)]))


def _small(spark: SparkSession, df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def drop_recurring(spark: SparkSession, docs: DataFrame, *, text: str = "text", key: str = "doc_id", min_docs: int = 3, constant: float = 0.5, similar: float = 0.7) -> DataFrame:
    """One row a row of ``docs``: key, text without recurring lines, n_lines, n_dropped."""
    lines = _lines(docs, text, key)
    placed = cut(spark, lines.select("leaf", F.xxhash64("line").alias("h"), "i", "t", "pos"), "placed")
    met = placed.select("leaf", "h", "i", "t").distinct()
    ends = [F.min("i").alias("i0"), F.max("i").alias("i1"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.count("i").alias("ids"), F.count("*").alias("docs")]
    several = met.groupBy("leaf", "h").agg(*ends).groupBy("leaf").agg(F.min("i0").alias("i0"), F.max("i1").alias("i1"), F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.sum("ids").alias("ids"), F.sum("docs").alias("docs"), F.count("*").alias("kinds"))
    open_leaves = cut(spark, several.where("i0 < i1 OR t0 < t1 OR (ids > 0 AND ids < docs)").select("leaf", "kinds"), "open")

    # templates of the leaves with several kinds of line
    mixed = _small(spark, open_leaves.where("kinds > 1"))
    kinds = lines.join(mixed, "leaf").select("leaf", "kinds", "n", F.xxhash64("line").alias("h"), "line").dropDuplicates(["leaf", "h"])
    kinds = cut(spark, kinds, "kinds")
    cells = kinds.select("leaf", "kinds", "n", "h", F.posexplode(F.split("line", " "))).toDF("leaf", "kinds", "n", "h", "p", "token").withColumn("token", _masked(F.col("token")))
    usual, often = F.col("c") >= F.lit(constant) * F.col("kinds"), F.col("c") >= min_docs
    common = cut(spark, cells.groupBy("leaf", "kinds", "p", "token").agg(F.count("*").alias("c")).where(usual | often), "common")
    first = common.where(usual).groupBy("leaf", "p").agg(F.min(F.struct(-F.col("c"), "token")).alias("f")).select("leaf", "p", F.col("f.token").alias("token"), F.lit(1).alias("usual"))
    common = common.select("leaf", "p", "token", often.alias("often")).join(first, ["leaf", "p", "token"], "left")
    agree = cells.join(common, ["leaf", "p", "token"]).groupBy("leaf", "h", "n").agg(F.count("usual").alias("usual"), F.count_if("often").alias("often"), F.bit_xor(F.when(F.col("often"), F.xxhash64("p", "token"))).alias("pattern"))
    enough = F.lit(similar) * F.col("n")
    fit = agree.select("leaf", "h", (F.col("usual") >= enough).alias("general"), F.when(F.col("often") >= enough, F.col("pattern")).alias("pattern")).where("general OR pattern IS NOT NULL")
    fit = cut(spark, fit, "fit")

    templates = [F.struct(F.lit(0).alias("kind"), F.col("h").alias("template")), F.when(F.col("general"), F.struct(F.lit(1).alias("kind"), F.lit(0).cast("long").alias("template"))), F.when(F.col("pattern").isNotNull(), F.struct(F.lit(2).alias("kind"), F.col("pattern").alias("template")))]
    seen = met.join(_small(spark, open_leaves.select("leaf")), "leaf", "left_semi").join(fit, ["leaf", "h"], "left")
    seen = seen.select("leaf", "h", "i", "t", F.explode(F.array_compact(F.array(*templates))).alias("x")).select("leaf", "h", "i", "t", "x.*")
    recurring = seen.select("leaf", "kind", "template", "i", "t").distinct().groupBy("leaf", "kind", "template").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs)
    bad = cut(spark, seen.select("leaf", "h", "kind", "template").distinct().join(recurring, ["leaf", "kind", "template"], "left_semi").select("leaf", "h").distinct(), "bad")

    gone = placed.join(_small(spark, bad), ["leaf", "h"], "left_semi").groupBy(F.col("i").alias("_i"), F.col("t").alias("_t")).agg(F.collect_set("pos").alias("gone"))
    out = docs.select(F.col(key).alias("i"), F.col(text).alias("x")).join(gone, F.col("i").eqNullSafe(F.col("_i")) & (F.xxhash64("x") == F.col("_t")), "left")
    all_lines = F.split("x", "\n")
    left = F.when(F.col("gone").isNull(), F.col("x")).otherwise(F.array_join(F.filter(all_lines, lambda line, at: ~F.array_contains(F.col("gone"), at)), "\n"))
    return out.select(F.col("i").alias(key), left.alias(text), F.when(F.col("x").isNull(), 0).otherwise(F.size(all_lines)).alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).alias("n_dropped"))


SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, dense_rank() OVER (ORDER BY doc_id NULLS FIRST, text) AS did, doc_id, text FROM documents),
raw AS (
  SELECT rid, did, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM docs WHERE text IS NOT NULL),
clean AS (SELECT rid, did, pos, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')) AS line FROM raw),
tokens AS (SELECT *, string_split(line, ' ') AS t FROM clean WHERE line <> ''),
leaves AS (
  SELECT rid, did, pos, line, t, len(t) AS n,
         [CAST(len(t) AS VARCHAR)] || list_transform(t[1:3], lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS leaf
  FROM tokens),
kinds AS (SELECT DISTINCT leaf, line, n, t FROM leaves),
counted AS (SELECT leaf, count(*) AS kinds FROM kinds GROUP BY leaf),
cells AS (
  SELECT k.leaf, c.kinds, k.n, k.line, unnest(range(n)) AS p, unnest(list_transform(t, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END)) AS token
  FROM kinds k JOIN counted c ON k.leaf = c.leaf WHERE c.kinds > 1),
common AS (SELECT leaf, kinds, p, token, count(*) AS c FROM cells GROUP BY ALL),
usual AS (SELECT leaf, p, token FROM common WHERE c >= 0.5 * kinds QUALIFY row_number() OVER (PARTITION BY leaf, p ORDER BY c DESC, token) = 1),
fit AS (
  SELECT c.leaf, c.line, c.n, count(u.token) AS usual, count(*) FILTER (o.c >= 3) AS often,
         string_agg(c.p || ':' || c.token, ' ' ORDER BY c.p) FILTER (o.c >= 3) AS pattern
  FROM cells c JOIN common o ON c.leaf = o.leaf AND c.p = o.p AND c.token = o.token
  LEFT JOIN usual u ON c.leaf = u.leaf AND c.p = u.p AND c.token = u.token GROUP BY c.leaf, c.line, c.n),
marks AS (
  SELECT rid, did, pos, leaf, 'line' AS kind, line AS template FROM leaves
  UNION ALL SELECT rid, did, pos, l.leaf, 'usual', '' FROM leaves l JOIN fit f ON l.leaf = f.leaf AND l.line = f.line WHERE f.usual >= 0.7 * f.n
  UNION ALL SELECT rid, did, pos, l.leaf, 'pattern', f.pattern FROM leaves l JOIN fit f ON l.leaf = f.leaf AND l.line = f.line WHERE f.often >= 0.7 * f.n),
recurring AS (SELECT leaf, kind, template FROM marks GROUP BY ALL HAVING count(DISTINCT did) >= 3),
gone AS (SELECT DISTINCT rid, pos FROM marks m JOIN recurring r ON m.leaf = r.leaf AND m.kind = r.kind AND m.template = r.template),
rebuilt AS (
  SELECT d.rid, d.doc_id, count(r.pos) AS n_lines, count(g.pos) AS n_dropped,
         CASE WHEN count(r.pos) > 0 THEN coalesce(string_agg(CASE WHEN g.pos IS NULL THEN r.line END, chr(10) ORDER BY r.pos), '') END AS text
  FROM docs d LEFT JOIN raw r ON d.rid = r.rid LEFT JOIN gone g ON r.rid = g.rid AND r.pos = g.pos GROUP BY d.rid, d.doc_id)
SELECT doc_id, CAST(n_lines AS INTEGER) AS n_lines, CAST(n_dropped AS INTEGER) AS n_dropped, md5(text) AS kept_md5 FROM rebuilt
"""
