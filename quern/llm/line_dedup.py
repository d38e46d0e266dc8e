"""Line dedup with a log-template tree of fixed depth.

Operator 5. Lines are parsed down a tree: number of tokens, then the leading ``DEPTH`` tokens; tokens with a digit
are variable fields (``<*>``). In a leaf with different lines the most frequent token of each place makes the
leaf's template; lines that agree with it in ``ALIKE`` of their places or more belong to it, and the places where
they don't agree are its variable fields. Other lines are templates of their own. A template found in ``DOCS``
documents or more is dropped wherever it occurs.

Only DataFrame operations: lines travel as hashes of document, leaf and line; tokens only of leaves that hold
different lines. Counts are grouped aggregations with partial sums, so that a very common line is no hot spot, and
joins on line hashes can be split.

Defined results: a null text has no lines. Lines without a token are never dropped and count in n_lines. Documents are
told apart by doc_id and text: repeated rows count as one document and lose the same lines. Null doc_ids are kept. Only
doc_id and text are read. No rows give no rows. Lines end at a newline; kept lines are joined by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import BLANKS, discard, release, stash, table

DEPTH = 3
ALIKE = 0.6
DOCS = 3
VARIABLE = "<*>"


#: A word with a digit; the look-behind holds it to the start of a word, so that long words are read once.
_WITH_DIGIT = r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+"


def masked(line: Column) -> Column:
    """A line's words with one blank between, those with a digit as variable fields. Patterns run only where they would change something."""
    odd = F.contains(line, F.lit("  "))
    for blank in BLANKS.replace("\n", ""):
        odd = odd | F.contains(line, F.lit(blank))
    plain = F.trim(F.when(odd, F.regexp_replace(line, r"[\x20\x09\x0B-\x0D]++", " ")).otherwise(line))
    return F.when(line.rlike("[0-9]"), F.regexp_replace(plain, _WITH_DIGIT, VARIABLE)).otherwise(plain)


def _lines(docs: DataFrame) -> DataFrame:
    """doc (hash), pos, tok (masked tokens with a blank between), leaf (hash) of each line with a token."""
    rows = docs.select(F.xxhash64("doc_id", "text").alias("doc"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rows = rows.select("doc", "pos", masked(F.col("line")).alias("tok")).where("tok <> ''")
    blanks = F.octet_length("tok") - F.octet_length(F.replace("tok", F.lit(" "), F.lit("")))
    return rows.withColumn("leaf", F.xxhash64(blanks, F.substring_index("tok", " ", DEPTH)))


def _line() -> Column:
    return F.xxhash64(F.lit(1), "tok")


def templates(docs: DataFrame, slim: DataFrame) -> DataFrame:
    """line and leaf of the lines that belong to the template of their leaf."""
    mixed = slim.groupBy("leaf").agg(F.min("line").alias("lo"), F.max("line").alias("hi"), F.min("doc").alias("d1"), F.max("doc").alias("d2")).where("lo <> hi AND d1 <> d2").select("leaf")
    seen = _lines(docs).select("leaf", "tok").join(mixed.hint("shuffle_hash"), "leaf").groupBy("leaf", "tok").agg(F.count("*").alias("n"))
    seen = stash(seen, "leaves")
    del mixed
    release(docs.sparkSession)
    words = seen.select("leaf", _line().alias("line"), "n", F.split("tok", " ").alias("tok"))
    places = words.select("leaf", "n", F.posexplode("tok").alias("p", "t")).groupBy("leaf", "p", "t").agg(F.sum("n").alias("n"))
    modal = places.groupBy("leaf", "p").agg(F.max(F.struct("n", "t")).alias("m")).groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("p", F.col("m.t").alias("t")))).alias("modal"))
    modal = modal.select("leaf", F.col("modal.t").alias("modal"))
    agree = F.aggregate(F.zip_with("tok", "modal", lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, x: s + x)
    return words.join(modal, "leaf").where(agree >= ALIKE * F.size("tok")).select("line", "leaf")


def dropped_lines(docs: DataFrame) -> DataFrame:
    """doc (hash of doc_id and text) with the positions of its dropped lines."""
    slim = stash(_lines(docs).select("doc", "pos", "leaf", _line().alias("line")), "lines")
    member = stash(templates(docs, slim).withColumnRenamed("leaf", "t"), "members")
    release(docs.sparkSession)
    named = slim.select("doc", "pos", "line").join(member, "line", "left").select("doc", "pos", F.xxhash64(F.coalesce("t", "line"), F.col("t").isNull()).alias("t"))
    named = stash(named, "templates")
    # Written first, so that the join deals named anew and can split a very common template.
    common = stash(named.select("t", "doc").distinct().groupBy("t").agg(F.count("*").alias("n")).where(F.col("n") >= DOCS).select("t"), "common")
    out = stash(named.join(common, "t").groupBy("doc").agg(F.collect_set("pos").alias("gone")), "dropped")
    discard(slim)
    discard(named)
    release(docs.sparkSession)
    return out


def line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_lines, n_dropped, kept."""
    rows = docs.select("doc_id", "text").withColumn("doc", F.xxhash64("doc_id", "text"))
    out = rows.join(dropped_lines(docs).hint("shuffle_hash"), "doc", "left").withColumn("_lines", F.coalesce(F.split("text", "\n"), F.array().cast("array<string>")))
    gone = F.coalesce("gone", F.array().cast("array<int>"))
    kept = F.when(F.size(gone) == 0, F.coalesce("text", F.lit(""))).otherwise(
        F.element_at(F.transform(F.array(F.sort_array(gone)), lambda g: F.array_join(F.filter("_lines", lambda _, i: ~F.array_contains(g, i)), "\n")), 1)
    )
    return out.select("doc_id", "text", F.size("_lines").cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_dropped"), kept.alias("kept"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
e AS (SELECT doc_id, text, i - 1 AS pos, list_transform(regexp_extract_all(l[i], '[^\x20\x09-\x0D]+'), lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END) AS tok
      FROM (SELECT doc_id, text, l, unnest(range(1, len(l) + 1)) AS i FROM d)),
f AS (SELECT doc_id, text, pos, tok, len(tok)::VARCHAR || ' ' || array_to_string(tok[1:3], ' ') AS leaf, array_to_string(tok, ' ') AS line FROM e WHERE len(tok) > 0),
x AS (SELECT leaf FROM f GROUP BY leaf HAVING count(DISTINCT line) > 1 AND count(DISTINCT (doc_id, text)) > 1),
s AS (SELECT leaf, line, any_value(tok) AS tok, count(*) AS n FROM f WHERE leaf IN (SELECT leaf FROM x) GROUP BY leaf, line),
p AS (SELECT leaf, i, tok[i] AS t, sum(n) AS n FROM (SELECT leaf, tok, n, unnest(range(1, len(tok) + 1)) AS i FROM s) GROUP BY ALL),
m AS (SELECT leaf, i, arg_max(t, (n, encode(t))) AS t FROM p GROUP BY leaf, i),
k AS (SELECT leaf, list(t ORDER BY i) AS modal FROM m GROUP BY leaf),
b AS (SELECT s.leaf, s.line FROM s JOIN k USING (leaf) WHERE list_sum(list_transform(range(1, len(tok) + 1), lambda i: (tok[i] = modal[i])::INT)) >= 0.6 * len(tok)),
t AS (SELECT f.doc_id, f.text, f.pos, CASE WHEN b.leaf IS NULL THEN 'l' || f.line ELSE 't' || f.leaf END AS t FROM f LEFT JOIN b ON b.leaf = f.leaf AND b.line = f.line),
c AS (SELECT t FROM t GROUP BY t HAVING count(DISTINCT (doc_id, text)) >= 3),
g AS (SELECT doc_id, list(pos) AS gone FROM t WHERE t IN (SELECT t FROM c) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(l), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_dropped,
  sha256(CASE WHEN gone IS NULL THEN coalesce(text, '') ELSE array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: NOT list_contains(gone, i - 1)), lambda i: l[i]), chr(10)) END) AS kept_sha256
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""
