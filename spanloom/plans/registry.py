"""The registry of queries and their SQL: each name is registered with a function and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import kernels, numeric
from ..functions import text as T
from ..operators import chunks, corpus, link, records, score, spans
from .inputs import GOLD_SQL, PRED_SQL, TAGS_SQL, TOKENS_SQL, gold, pred, table, token_rows, turn_tags

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# Text linkage

NORM = r"trim(regexp_replace(lower(regexp_replace({}, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')), '\s+', ' ', 'g'))"
SENTENCES = f"""
s AS (SELECT id, i - 1 AS pos, {NORM.format("p[i]")} AS norm FROM (SELECT id, p, unnest(range(1, least(3, len(p)) + 1)) AS i FROM (
  SELECT id, list_filter(list_transform(string_split(text, '.'), lambda x: trim(x)), lambda x: x <> '') AS p FROM src))),
h AS (SELECT id, pos, md5(norm) AS hash FROM s WHERE norm <> '')"""


@query(f"""
WITH src AS (SELECT doc_id AS id, text FROM documents), {SENTENCES},
g AS (SELECT hash, min(id) AS head, count(DISTINCT id) AS n FROM h GROUP BY hash)
SELECT h.id AS doc_id, CAST(h.pos AS INTEGER) AS pos, g.head AS head, g.n AS n_docs FROM h JOIN g USING (hash) WHERE g.n > 1""")
def self_link(spark, sf_dir):
    """Documents that share one of their leading sentences, with the smallest id that has it."""
    h = link.sentence_hashes(table(spark, sf_dir, "documents"), "doc_id")
    one = h.groupBy("hash", "id").agg(F.lit(1).alias("x")).groupBy("hash").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n_docs")).where("n_docs > 1")
    return h.join(one, "hash").select(F.col("id").alias("doc_id"), "pos", "head", "n_docs")


EXACT = f"""
src AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT -1 - item_id AS id, text FROM benchmark), {SENTENCES},
r AS (SELECT hash, -1 - id AS rid, pos AS rpos FROM h WHERE id < 0),
b AS (SELECT hash, rid, rpos FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY rid, rpos) AS k FROM r) WHERE k = 1),
m AS (SELECT h.id, h.pos, b.rid, row_number() OVER (PARTITION BY h.id ORDER BY h.pos, b.rid, b.rpos) AS k FROM h JOIN b USING (hash) WHERE h.id >= 0)"""


@query(f"WITH {EXACT} SELECT id, rid AS match_id, CAST(pos AS INTEGER) AS sentence, CAST(1.0 AS DOUBLE) AS similarity FROM m WHERE k = 1")
def exact_hash_link(spark, sf_dir):
    left = link.sentence_hashes(table(spark, sf_dir, "documents"), "doc_id")
    return link.exact_link(left, link.sentence_hashes(table(spark, sf_dir, "benchmark"), "item_id"))


def _whole(spark, sf_dir):
    """Documents and benchmark items, normalised, as the two sides of fuzzy links."""
    side = lambda df, i: df.select(F.col(i).alias("id"), T.normalise(F.col("text")).alias("text"))
    return side(table(spark, sf_dir, "documents"), "doc_id"), side(table(spark, sf_dir, "benchmark"), "item_id")


def _whole_sql(key: str, name: str) -> str:
    return f"SELECT {key} AS id, {NORM.format('text')} AS text FROM {name}"


WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


@query(f"""
WITH a AS ({_whole_sql("doc_id", "documents")}), sh AS (
  SELECT id, list_distinct(list_transform(range(1, greatest(len(p) - 2, 1) + 1), lambda i: array_to_string(list_slice(p, i, i + 2), ' '))) AS sh FROM (SELECT id, string_split(text, ' ') AS p FROM a)),
x AS (SELECT id, unnest(list_transform(sh, lambda s: CAST(concat('0x', substring(md5(s), 1, 7)) AS BIGINT))) AS h FROM sh)
SELECT id, CAST(i AS INTEGER) AS slot, min(((7 * i + 13) * h + (11 * i + 17)) % 1000000007) AS value FROM x, (SELECT unnest(range(0, 8)) AS i) GROUP BY id, i""")
def minhash_signature(spark, sf_dir):
    docs, _ = _whole(spark, sf_dir)
    return docs.select("id", F.posexplode(T.minhash(T.shingles(F.split("text", " ")), 8)).alias("slot", "value"))


def _lsh_sql(left: str, right: str, itself: bool = True) -> str:
    """The CTE `lsh` (id, match_id, similarity, rank) for 128 slots in 16 bands at 0.7."""
    return f"""
lw AS (SELECT 0 AS side, id, text FROM ({left}) UNION ALL SELECT 1, id, text FROM ({right})),
lsh_sets AS (SELECT side, id, list_distinct(list_transform(range(1, greatest(len(p) - 2, 1) + 1), lambda i: array_to_string(list_slice(p, i, i + 2), ' '))) AS sh FROM (SELECT side, id, string_split(text, ' ') AS p FROM lw WHERE text <> '')),
lx AS (SELECT side, id, unnest(list_transform(sh, lambda s: CAST(concat('0x', substring(md5(s), 1, 7)) AS BIGINT))) AS h FROM lsh_sets),
lg AS (SELECT side, id, i AS slot, min(((7 * i + 13) * h + (11 * i + 17)) % 1000000007) AS v FROM lx, (SELECT unnest(range(0, 128)) AS i) GROUP BY side, id, i),
lbands AS (SELECT side, id, slot // 8 AS band, string_agg(v, ',' ORDER BY slot) AS bucket FROM lg GROUP BY side, id, slot // 8),
lc AS (SELECT DISTINCT a.id, b.id AS rid FROM lbands a JOIN lbands b USING (band, bucket) WHERE a.side = 0 AND b.side = 1{"" if itself else " AND a.id <> b.id"}),
lsim AS (SELECT lc.id, lc.rid, CAST(count(*) FILTER (a.v = b.v) AS DOUBLE) / 128 AS similarity FROM lc JOIN lg a ON a.side = 0 AND a.id = lc.id JOIN lg b ON b.side = 1 AND b.id = lc.rid AND b.slot = a.slot GROUP BY lc.id, lc.rid),
lsh AS (SELECT id, rid AS match_id, similarity, CAST(row_number() OVER (PARTITION BY id ORDER BY similarity DESC, rid) AS INTEGER) AS rank FROM lsim WHERE similarity >= 0.7)"""


DOCS_SQL, ITEMS_SQL = _whole_sql("doc_id", "documents"), _whole_sql("item_id", "benchmark")


@query(f"WITH {_lsh_sql(DOCS_SQL, ITEMS_SQL)} SELECT id, match_id, similarity, rank FROM lsh WHERE rank <= 5")
def lsh_link(spark, sf_dir):
    """Documents and the benchmark items whose whole texts are alike."""
    docs, items = _whole(spark, sf_dir)
    return link.lsh_link(docs, items).select("id", "match_id", "similarity", "rank")


@query(f"WITH {_lsh_sql(DOCS_SQL, DOCS_SQL, itself=False)} SELECT id, match_id, similarity, rank FROM lsh WHERE rank <= 5")
def lsh_copies(spark, sf_dir):
    """Documents and the five other documents most like them."""
    docs, _ = _whole(spark, sf_dir)
    return link.lsh_link(docs, docs, itself=False).select("id", "match_id", "similarity", "rank")


NEAR = f"""
na AS ({DOCS_SQL}), nb AS ({ITEMS_SQL}),
nl AS (SELECT id, CAST(floor(length(text) * 0.9) AS BIGINT) AS low, CAST(floor(length(text) * 1.1) AS BIGINT) AS high, list_distinct({WORDS}) AS w FROM na),
nr AS (SELECT id AS rid, length(text) AS rlen, CAST(floor(length(text) / 100) AS BIGINT) AS bucket, list_distinct({WORDS}) AS rw FROM nb),
np AS (SELECT id, rid, bucket, w, rw FROM nl JOIN nr ON rlen BETWEEN low AND high),
ns AS (SELECT id, rid, bucket, CASE WHEN len(w) + len(rw) = 0 THEN 0.0 ELSE CAST(len(list_intersect(w, rw)) AS DOUBLE) / (len(w) + len(rw) - len(list_intersect(w, rw))) END AS similarity FROM np),
near AS (SELECT id, rid AS match_id, similarity, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, bucket, rid) AS k FROM ns)"""


@query(f"WITH {NEAR} SELECT id, match_id, similarity FROM near WHERE similarity >= 0.3 AND k = 1")
def length_jaccard_link(spark, sf_dir):
    docs, items = _whole(spark, sf_dir)
    return link.length_jaccard_link(docs, items, threshold=0.3)


@query(f"""
WITH {EXACT}, {_lsh_sql(DOCS_SQL, ITEMS_SQL)}, {NEAR}
SELECT d.doc_id AS id, CASE WHEN m.id IS NOT NULL THEN m.rid WHEN lsh.id IS NOT NULL THEN lsh.match_id ELSE near.match_id END AS match_id,
  CASE WHEN m.id IS NOT NULL THEN 1.0 WHEN lsh.id IS NOT NULL THEN lsh.similarity ELSE near.similarity END AS similarity,
  CASE WHEN m.id IS NOT NULL THEN 'exact' WHEN lsh.id IS NOT NULL THEN 'lsh' WHEN near.id IS NOT NULL THEN 'length_jaccard' ELSE 'none' END AS stage
FROM documents d LEFT JOIN m ON m.id = d.doc_id AND m.k = 1 LEFT JOIN lsh ON lsh.id = d.doc_id AND lsh.rank = 1 LEFT JOIN near ON near.id = d.doc_id AND near.k = 1 AND near.similarity >= 0.5""")
def cascade_link(spark, sf_dir):
    docs, items = _whole(spark, sf_dir)
    texts, hashes = table(spark, sf_dir, "documents"), link.sentence_hashes(table(spark, sf_dir, "benchmark"), "item_id")

    def exact(rest: DataFrame) -> DataFrame:
        return link.exact_link(link.sentence_hashes(texts, "doc_id"), hashes)

    def alike(rest: DataFrame) -> DataFrame:
        return link.lsh_link(rest, items, k=1)

    def near(rest: DataFrame) -> DataFrame:
        return link.length_jaccard_link(rest, items, threshold=0.5)

    return link.cascade([("exact", exact), ("lsh", alike), ("length_jaccard", near)], docs)


#: DuckDB's distance counts bytes: each letter beyond ASCII that the tables hold becomes one control character first.
BEYOND = "éèÍÊñÄÉßêÈÑóÓÖöüäÜÇçí"
ONE_BYTE = "translate({}, '" + BEYOND + "', concat(" + ", ".join(f"chr({i})" for i in (*range(1, 9), *range(14, 27))) + "))"
FIRST = "trim(list_filter(list_transform(string_split(text, '.'), lambda x: trim(x)), lambda x: x <> '')[{}])"


@query(f"""
WITH a AS (SELECT doc_id AS id, coalesce(substring({FIRST.format(1)}, 1, 12), '') AS block, {ONE_BYTE.format(f"coalesce({FIRST.format(2)}, '')")} AS s FROM documents),
p AS (SELECT x.id, y.id AS rid, levenshtein(x.s, y.s) AS d FROM a x JOIN a y ON x.block = y.block AND y.id < x.id WHERE x.s <> '' AND y.s <> ''),
b AS (SELECT id, rid, d FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, rid) AS k FROM p WHERE d <= 10) WHERE k = 1)
SELECT a.id, b.rid AS match_id, CAST(b.d AS INTEGER) AS distance, b.rid IS NOT NULL AS matched FROM a LEFT JOIN b ON a.id = b.id""")
def levenshtein_link(spark, sf_dir):
    """Documents whose first sentence starts alike and whose second is within ten edits of an earlier document's."""
    s = T.leading_sentences(F.col("text"), 2)
    side = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.substring(F.element_at(s, 1), 1, 12).alias("block"), F.element_at(s, 2).alias("s"))
    return link.levenshtein_link(side, side, earlier=True)


TERMS = f"t AS (SELECT doc_id AS id, term, count(*) AS tf FROM (SELECT doc_id, unnest({WORDS}) AS term FROM documents) GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM t GROUP BY term), n AS (SELECT count(*) AS n FROM documents)"


@query(f"""WITH {TERMS}, w AS (SELECT id, term, tf, df, row_number() OVER (PARTITION BY id ORDER BY round(tf * ln(n / (1 + df)), 9) DESC, term) AS rank FROM t JOIN d USING (term), n)
SELECT id, CAST(rank AS INTEGER) AS rank, term, tf, df FROM w WHERE rank <= 5""")
def tfidf_top_terms(spark, sf_dir):
    return link.top_terms(table(spark, sf_dir, "documents"), "doc_id")


@query(f"WITH {TERMS} SELECT term, df, round(ln(n / (1 + df)), 6) AS idf FROM d, n WHERE df > 2")
def inverse_frequency(spark, sf_dir):
    weights, _ = link.idf(table(spark, sf_dir, "documents"), "doc_id")
    return weights.where("df > 2").select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"""WITH {TERMS}, w AS (SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY round(tf * ln(n / (1 + df)), 9) DESC, term) AS rank FROM t JOIN d USING (term), n),
b AS (SELECT id, string_agg(term, ' ' ORDER BY rank) AS terms FROM w WHERE rank <= 5 GROUP BY id)
SELECT CAST(concat('0x', substring(md5(terms), 1, 7)) AS BIGINT) % 64 AS block, count(*) AS n FROM b GROUP BY block""")
def tfidf_blocks(spark, sf_dir):
    top = link.top_terms(table(spark, sf_dir, "documents"), "doc_id")
    terms = top.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("t"))
    return terms.groupBy((T.small_hash(F.array_join(F.col("t.term"), " ")) % 64).alias("block")).agg(F.count(F.lit(1)).alias("n"))


VECTORS = "v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, label FROM embeddings)"


@query(f"""WITH {VECTORS}, n AS (SELECT id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM v),
s AS (SELECT a.id AS qid, b.id AS cid, round(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) / (a.n * b.n), 6) AS score FROM n a JOIN n b ON a.id <> b.id WHERE a.id % 40 = 0)
SELECT qid, cid, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, cid) AS rank FROM s) WHERE rank <= 3""")
def cosine_topk(spark, sf_dir):
    """The stated queries are the vectors whose id is divisible by 40."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return link.cosine_top(v.where("id % 40 = 0"), v, blocks=4, k=3)


@query(f"""WITH {VECTORS}, c AS (SELECT label, i - 1 AS pos, v[i] AS x, v[i] / sqrt(list_sum(list_transform(v, lambda y: y * y))) AS u, sqrt(list_sum(list_transform(v, lambda y: y * y))) AS n FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM v)),
m AS (SELECT label, pos, avg(x) AS a, avg(u) AS u, avg(n) AS n, count(x) / sum(1 / x) AS h FROM c GROUP BY label, pos)
SELECT label, CAST(pos AS INTEGER) AS pos, round(a, 6) AS arithmetic, round(h, 4) AS harmonic, round(u / sqrt(sum(u * u) OVER (PARTITION BY label)) * n, 6) AS chordal FROM m""")
def centroid_chordal(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"))
    return corpus.mean_vectors(rows, "label").select("label", "pos", F.round("arithmetic", 6).alias("arithmetic"), F.round("harmonic", 4).alias("harmonic"), F.round("chordal", 6).alias("chordal"))


# Match analytics over a table of values in [0, 1]

MATCHES = "m AS (SELECT l_orderkey AS id, l_discount * 10 AS similarity, l_shipmode AS stage FROM (SELECT l_orderkey, l_discount, l_returnflag AS l_shipmode FROM lineitem))"


def _matches(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_discount") * 10).alias("similarity"), F.col("l_returnflag").alias("stage"))


@query(f"""WITH {MATCHES} SELECT stage, count(*) AS n, count(DISTINCT id) AS ids, round(avg(similarity), 6) AS mean, round(quantile_cont(similarity, 0.5), 6) AS median, round(stddev_pop(similarity), 6) AS std,
min(similarity) AS lowest, max(similarity) AS highest, round(quantile_cont(similarity, 0.25), 6) AS q25, round(quantile_cont(similarity, 0.75), 6) AS q75 FROM m GROUP BY stage""")
def match_stats(spark, sf_dir):
    p = lambda q: F.round(F.percentile("similarity", F.lit(q)), 6)
    return _matches(spark, sf_dir).groupBy("stage").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.round(F.avg("similarity"), 6).alias("mean"), p(0.5).alias("median"), F.round(F.stddev_pop("similarity"), 6).alias("std"),
        F.min("similarity").alias("lowest"), F.max("similarity").alias("highest"), p(0.25).alias("q25"), p(0.75).alias("q75"),
    )


@query(f"""WITH {MATCHES}, b AS (SELECT CAST(least(floor(similarity * 10), 9) AS INTEGER) AS bin FROM m WHERE similarity BETWEEN 0 AND 1)
SELECT s.bin, (SELECT count(*) FROM b WHERE b.bin = s.bin) AS n FROM (SELECT CAST(unnest(range(0, 10)) AS INTEGER) AS bin) s""")
def similarity_histogram(spark, sf_dir):
    return corpus.histogram(_matches(spark, sf_dir), "similarity")


@query(f"WITH {MATCHES} SELECT id, count(*) AS n FROM m GROUP BY id HAVING count(*) > 1")
def duplicate_matches(spark, sf_dir):
    return corpus.duplicates(_matches(spark, sf_dir), "id")


@query(f"WITH {MATCHES} SELECT similarity, stage, round(cume_dist() OVER (PARTITION BY stage ORDER BY similarity), 9) AS share FROM (SELECT DISTINCT similarity, stage FROM m)")
def similarity_cdf(spark, sf_dir):
    rows = _matches(spark, sf_dir).select("similarity", "stage").distinct()
    return rows.withColumn("share", F.round(F.cume_dist().over(Window.partitionBy("stage").orderBy("similarity")), 9))


@query("""WITH a AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'R'),
c AS (SELECT count(*) FILTER (WHERE a.id IS NOT NULL AND b.id IS NOT NULL) AS common, count(*) FILTER (WHERE b.id IS NULL) AS only_1, count(*) FILTER (WHERE a.id IS NULL) AS only_2 FROM a FULL JOIN b ON a.id = b.id)
SELECT common, only_1, only_2, round(common / (common + only_1 + only_2), 9) AS jaccard FROM c""")
def compare_match_sets(spark, sf_dir):
    m = _matches(spark, sf_dir)
    return corpus.compare_sets(m.where("stage = 'A'"), m.where("stage = 'R'")).withColumn("jaccard", F.round("jaccard", 9))


@query("""WITH f AS (SELECT DISTINCT l_returnflag AS folder, concat('o', CAST(l_orderkey AS VARCHAR)) AS name, CAST(l_quantity % 3 AS VARCHAR) AS hash FROM lineitem WHERE l_linenumber = 1 UNION ALL SELECT DISTINCT 'N', concat('o', CAST(o_orderkey AS VARCHAR)), CAST(o_custkey % 3 AS VARCHAR) FROM orders),
g AS (SELECT name, count(DISTINCT folder) AS n, count(DISTINCT hash) AS h FROM f GROUP BY name)
SELECT name, CASE WHEN n < 2 THEN 'missing' WHEN h > 1 THEN 'mismatch' ELSE 'ok' END AS status FROM g""")
def compare_files(spark, sf_dir):
    name = lambda c: F.concat(F.lit("o"), F.col(c).cast("string")).alias("name")
    a = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_returnflag").alias("folder"), name("l_orderkey"), (F.col("l_quantity") % 3).cast("string").alias("hash"))
    b = table(spark, sf_dir, "orders").select(F.lit("N").alias("folder"), name("o_orderkey"), (F.col("o_custkey") % 3).cast("string").alias("hash"))
    return corpus.compare_files(a.unionByName(b), ["a", "b"])


# Scoring of spans

KEYS = "filename, label, start, \"end\""
#: From `c` (label, tp, np, ng) to the report.
REPORT = """r AS (SELECT label, tp, np - tp AS fp, ng - tp AS fn, CASE WHEN np > 0 THEN tp / np ELSE 0.0 END AS precision, CASE WHEN ng > 0 THEN tp / ng ELSE 0.0 END AS recall FROM c),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM r),
u AS (SELECT * FROM f UNION ALL SELECT 'macro', CAST(sum(tp) AS BIGINT), CAST(sum(fp) AS BIGINT), CAST(sum(fn) AS BIGINT), avg(precision), avg(recall), avg(f1) FROM f
  UNION ALL SELECT 'micro', CAST(sum(tp) AS BIGINT), CAST(sum(fp) AS BIGINT), CAST(sum(fn) AS BIGINT), sum(tp) / (sum(tp) + sum(fp)), sum(tp) / (sum(tp) + sum(fn)), 2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) FROM f)
SELECT label, tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM u"""


@query(f"""WITH g AS (SELECT DISTINCT {KEYS}, 1 AS g FROM ({GOLD_SQL})), p AS (SELECT DISTINCT {KEYS}, 1 AS p FROM ({PRED_SQL})),
b AS (SELECT coalesce(g.label, p.label) AS label, coalesce(g.g, 0) AS g, coalesce(p.p, 0) AS p FROM g FULL JOIN p ON g.filename = p.filename AND g.label = p.label AND g.start = p.start AND g."end" = p."end"),
c AS (SELECT label, CAST(sum(g * p) AS BIGINT) AS tp, CAST(sum(p) AS BIGINT) AS np, CAST(sum(g) AS BIGINT) AS ng FROM b GROUP BY label),
{REPORT}""")
def strict_scores(spark, sf_dir):
    out = score.strict(gold(spark, sf_dir), pred(spark, sf_dir))
    return out.select("label", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""WITH RECURSIVE g AS (SELECT *, row_number() OVER (PARTITION BY filename, label ORDER BY ord, start, "end") AS i FROM (SELECT {KEYS}, min(ord) AS ord FROM ({GOLD_SQL}) GROUP BY ALL)),
p AS (SELECT filename, label, list({{'s': start, 'e': "end"}} ORDER BY ord, start, "end") AS p FROM (SELECT {KEYS}, min(ord) AS ord FROM ({PRED_SQL}) GROUP BY ALL) GROUP BY ALL),
m AS (SELECT filename, label, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS used FROM p
  UNION ALL SELECT filename, label, i, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END FROM (
    SELECT g.filename, g.label, g.i, m.used, list_min(list_filter(range(1, len(p.p) + 1), lambda j: p.p[j].s <= g."end" AND g.start <= p.p[j].e AND NOT list_contains(m.used, j))) AS pick
    FROM m JOIN g ON g.filename = m.filename AND g.label = m.label AND g.i = m.i + 1 JOIN p ON p.filename = g.filename AND p.label = g.label)),
t AS (SELECT label, sum(n) AS tp FROM (SELECT filename, label, max(len(used)) AS n FROM m GROUP BY ALL) GROUP BY label),
c AS (SELECT x.label, CAST(coalesce(t.tp, 0) AS BIGINT) AS tp, CAST(coalesce(y.n, 0) AS BIGINT) AS np, x.n AS ng FROM (SELECT label, count(*) AS n FROM g GROUP BY label) x
  LEFT JOIN (SELECT label, sum(len(p)) AS n FROM p GROUP BY label) y ON x.label = y.label LEFT JOIN t ON t.label = x.label),
{REPORT}""")
def relaxed_scores(spark, sf_dir):
    out = score.relaxed(gold(spark, sf_dir), pred(spark, sf_dir))
    return out.select("label", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""WITH g AS ({GOLD_SQL}), p AS ({PRED_SQL}) SELECT g.label, count(*) AS pairs, count(DISTINCT g.filename) AS documents FROM g JOIN p ON g.filename = p.filename AND g.label = p.label AND g.start <= p."end" AND p.start <= g."end" GROUP BY g.label""")
def overlap_pairs(spark, sf_dir):
    """Overlapping or touching gold and predicted spans of a label."""
    g = gold(spark, sf_dir)
    p = pred(spark, sf_dir).select("filename", "label", F.col("start").alias("s"), F.col("end").alias("e"))
    return g.join(p, ["filename", "label"]).where("start <= e AND s <= end").groupBy("label").agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("filename").alias("documents"))


@query(f"""SELECT filename, label, start, "end", ord FROM (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY ord) AS k FROM ({GOLD_SQL})) WHERE k = 1""")
def dedup_spans(spark, sf_dir):
    return spans.dedup_spans(gold(spark, sf_dir))


REPORTS = "r AS (SELECT CAST(l_linenumber AS INTEGER) AS fold, l_returnflag AS label, avg(l_discount) AS p, avg(l_tax) AS r FROM lineitem GROUP BY ALL)"


@query(f"""WITH {REPORTS}, u AS (SELECT label, 'p' AS metric, p AS value FROM r UNION ALL SELECT label, 'r', r FROM r)
SELECT label, metric, round(avg(value), 9) AS mean, round(median(value), 9) AS median, round(stddev_pop(value), 9) AS std_pop, round(coalesce(stddev_samp(value), 0), 9) AS std_samp, count(value) AS n FROM u GROUP BY label, metric""")
def fold_statistics(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").cast("int").alias("fold"), F.col("l_returnflag").alias("label")).agg(F.avg("l_discount").alias("p"), F.avg("l_tax").alias("r"))
    out = score.fold_statistics(rows, ["label"], ["p", "r"])
    return out.select("label", "metric", *[F.round(c, 9).alias(c) for c in ("mean", "median", "std_pop", "std_samp")], "n")


@query(f"""WITH g AS ({GOLD_SQL}), p AS ({PRED_SQL}) SELECT g.filename, g.start, g.ord, p.ord AS ord_pred, p."end" - g."end" AS error FROM g JOIN p ON g.filename = p.filename AND g.start = p.start WHERE g."end" <> p."end\"""")
def boundary_errors(spark, sf_dir):
    return corpus.boundary_errors(gold(spark, sf_dir), pred(spark, sf_dir))


@query(f"""SELECT * FROM ({GOLD_SQL}) g WHERE EXISTS (SELECT 1 FROM ({PRED_SQL}) p WHERE p.label = g.label AND p.label <> 'SYMPTOM')""")
def restrict_to_predicted(spark, sf_dir):
    """Gold spans whose label is predicted at all."""
    return gold(spark, sf_dir).join(F.broadcast(pred(spark, sf_dir).select("label").where("label <> 'SYMPTOM'").distinct()), "label", "left_semi").select("filename", "label", "start", "end", "ord")  # one row a label


PAIR_SQL = f"""o AS (SELECT a.filename, a.start, a."end", a.ord AS row, b.ord AS other, a.label, b.label AS other_label FROM ({GOLD_SQL}) a JOIN ({GOLD_SQL}) b ON a.filename = b.filename AND a.ord <> b.ord AND a.start < b."end" AND b.start < a."end" WHERE a.start < a."end" AND b.start < b."end")"""


@query(f"WITH {PAIR_SQL} SELECT label, other_label, count(*) AS pairs FROM o GROUP BY ALL")
def span_overlaps(spark, sf_dir):
    return spans.overlaps(gold(spark, sf_dir)).groupBy("label", "other_label").agg(F.count(F.lit(1)).alias("pairs"))


@query(f"""WITH {PAIR_SQL}, k AS (SELECT DISTINCT filename, start, "end" FROM ({GOLD_SQL})), f AS (SELECT filename, start, "end", bool_or(other_label = 'DISEASE') AS d, bool_or(other_label = 'SYMPTOM') AS s FROM o GROUP BY ALL)
SELECT k.filename, k.start, k."end", coalesce(d, FALSE) AS "with_DISEASE", coalesce(s, FALSE) AS "with_SYMPTOM" FROM k LEFT JOIN f ON k.filename = f.filename AND k.start = f.start AND k."end" = f."end\"""")
def span_overlap_flags(spark, sf_dir):
    g = gold(spark, sf_dir)
    return corpus.flags(spans.overlaps(g), g, ["DISEASE", "SYMPTOM"])


@query(f"""WITH {PAIR_SQL}, k AS (SELECT g.label, g.filename, g.ord, EXISTS (SELECT 1 FROM o WHERE o.filename = g.filename AND o.row = g.ord) AS x FROM ({GOLD_SQL}) g)
SELECT label, count(*) AS n, round(avg(CASE WHEN x THEN 1.0 ELSE 0.0 END) * 100, 6) AS percent FROM k GROUP BY label""")
def overlap_percentages(spark, sf_dir):
    g = gold(spark, sf_dir)
    hit = spans.overlaps(g).select("filename", F.col("row").alias("ord")).distinct().withColumn("x", F.lit(1.0))
    return g.join(hit, ["filename", "ord"], "left").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce("x", F.lit(0.0))) * 100, 6).alias("percent"))


# Corpus operators

@query("""WITH r AS (SELECT l_suppkey AS id, CASE WHEN l_suppkey % 7 = 0 AND l_linenumber > 3 THEN 'x' ELSE CAST(l_suppkey AS VARCHAR) END AS text, concat(l_orderkey, '/', l_linenumber, '/', l_returnflag) AS tag FROM lineitem)
SELECT id, min(text) AS text, count(DISTINCT tag) AS n_tags FROM r GROUP BY id HAVING count(DISTINCT text) = 1""")
def merge_annotations(spark, sf_dir):
    """Tags by id; ids with two texts are left out."""
    text = F.when((F.col("l_suppkey") % 7 == 0) & (F.col("l_linenumber") > 3), "x").otherwise(F.col("l_suppkey").cast("string"))
    tag = F.struct(F.col("l_orderkey").alias("start"), F.col("l_linenumber").alias("end"), F.col("l_returnflag").alias("tag"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id"), text.alias("text"), F.array(tag).alias("tags"))
    return corpus.merge_annotations(rows).select("id", "text", F.size("tags").cast("long").alias("n_tags"))


@query(f"""SELECT label, count(*) AS n, round(avg("end" - start), 6) AS mean_length, CAST(median("end" - start) AS DOUBLE) AS median_length, count(DISTINCT filename) AS documents FROM ({GOLD_SQL}) GROUP BY label""")
def inspect_spans(spark, sf_dir):
    return corpus.inspect(gold(spark, sf_dir), ["label"]).withColumn("mean_length", F.round("mean_length", 6))


@query(f"""WITH t AS (SELECT concat('doc', CAST(o_orderkey AS VARCHAR)) AS filename, 150 AS size FROM orders WHERE o_orderkey % 3 <> 0), r AS (SELECT g.*, t.size FROM ({GOLD_SQL}) g LEFT JOIN t ON g.filename = t.filename)
SELECT why, count(*) AS n FROM (SELECT CASE WHEN size IS NULL THEN 'no text' WHEN start < 0 THEN 'negative start' WHEN "end" <= start THEN 'empty' WHEN "end" > size THEN 'beyond the end' END AS why FROM r) WHERE why IS NOT NULL GROUP BY why""")
def invalid_spans(spark, sf_dir):
    texts = table(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0").select(F.concat(F.lit("doc"), F.col("o_orderkey").cast("string")).alias("filename"), F.repeat(F.lit("x"), 150).alias("text"))
    return corpus.invalid_spans(gold(spark, sf_dir), texts).groupBy("why").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT filename, label, CAST(start AS VARCHAR) AS start_span, CAST("end" AS VARCHAR) AS end_span, '' AS text FROM (SELECT filename, label, start, "end" FROM ({GOLD_SQL}) UNION SELECT filename, label, start, "end" FROM ({PRED_SQL}))""")
def combine_predictions(spark, sf_dir):
    rows = [df.select("filename", "label", F.col("start").cast("string").alias("start_span"), F.col("end").cast("string").alias("end_span"), F.lit("").alias("text")) for df in (gold(spark, sf_dir), pred(spark, sf_dir))]
    return corpus.combine(rows)


@query("""WITH c AS (SELECT o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT n AS b FROM c WHERE label = '1-URGENT')
SELECT label, n, round(least(50.0, b / n), 9) AS weight FROM c, b""")
def class_weights(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return score.class_weights(counts, "1-URGENT").withColumn("weight", F.round("weight", 9))


@query("SELECT toxic AS label, quality, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent FROM labels GROUP BY toxic, quality")
def label_distribution(spark, sf_dir):
    n = table(spark, sf_dir, "labels").groupBy(F.col("toxic").alias("label"), "quality").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).select("label", "quality", "n", F.round(F.col("n") * 100.0 / F.col("total"), 6).alias("percent"))  # one row


@query("""SELECT o_orderkey AS id, coalesce(r_name, 'NO CODE') AS licence FROM orders LEFT JOIN region ON o_custkey % 9 = r_regionkey""")
def licence_left_join(spark, sf_dir):
    left = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 9).cast("int").alias("r_regionkey"))
    right = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("licence"))
    return corpus.with_default(left, right, "r_regionkey", "licence", "NO CODE").select("id", "licence")


@query("""SELECT n_name AS name, kind, value FROM (SELECT n_name, 'key' AS kind, CAST(n_nationkey AS VARCHAR) AS value FROM nation UNION ALL SELECT n_name, 'region', nullif(CAST(n_regionkey AS VARCHAR), '0') FROM nation) WHERE value IS NOT NULL""")
def ontology_unpivot(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("string").alias("key"), F.nullif(F.col("n_regionkey").cast("string"), F.lit("0")).alias("region"))
    return rows.unpivot(["name"], ["key", "region"], "kind", "value").where("value IS NOT NULL")


@query("""SELECT c_custkey AS id, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'""")
def ontology_chain(spark, sf_dir):
    """Concept to type to group by joins that drop misses."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region").where("r_name <> 'ASIA'")
    c = table(spark, sf_dir, "customer")
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("c_custkey").alias("id"), "n_name", "r_name")


@query("""SELECT page_id, len(l) AS n_links, l[1] AS first_link FROM (SELECT page_id, list_filter(regexp_extract_all(html, '<a href="([^"]*)"', 1), lambda x: x <> '' AND NOT ends_with(x, '/') AND NOT starts_with(x, 'http') AND NOT starts_with(x, '../')) AS l FROM pages)""")
def html_links(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", corpus.links(F.col("html")).alias("l"))
    return rows.select("page_id", F.size("l").cast("long").alias("n_links"), F.try_element_at("l", F.lit(1)).alias("first_link"))


@query("""SELECT p_partkey AS id, CAST(p_size * CASE p_size % 3 WHEN 0 THEN 1024 WHEN 1 THEN 1048576 ELSE 1 END AS DOUBLE) AS bytes FROM part""")
def size_parse(spark, sf_dir):
    unit = F.element_at(F.array(F.lit("K"), F.lit("m"), F.lit("")), F.col("p_size") % 3 + 1)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), T.byte_size(F.concat(F.col("p_size").cast("string"), unit)).alias("bytes"))


@query("""SELECT CAST(floor(doc_id / 100) AS BIGINT) AS part, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1""")
def line_split(spark, sf_dir):
    """Parts of a hundred numbered lines."""
    return table(spark, sf_dir, "documents").groupBy(F.floor(F.col("doc_id") / 100).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))


@query("""SELECT s_suppkey AS id, s_name AS name, CAST(NULL AS VARCHAR) AS brand FROM supplier UNION ALL SELECT p_partkey, p_name, p_brand FROM part""")
def mixed_schema_union(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return a.unionByName(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand")), allowMissingColumns=True)


@query("""SELECT o_orderkey AS gid, CAST(CAST(concat('0x', substring(md5(concat(CAST(o_custkey AS VARCHAR), '-42')), 1, 7)) AS BIGINT) % 5 AS INTEGER) AS fold FROM orders""")
def group_folds(spark, sf_dir):
    return corpus.group_folds(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("gid"), "o_custkey"), "o_custkey", 5).select("gid", "fold")


@query("""SELECT source, n, rank FROM (SELECT source, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, source) AS INTEGER) AS rank FROM documents GROUP BY source) WHERE rank <= 10""")
def top_sources(spark, sf_dir):
    """The ten most frequent sources: a report."""
    n = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "source").limit(10)
    return n.withColumn("rank", F.row_number().over(Window.orderBy(F.col("n").desc(), "source")))


@query("SELECT o_custkey AS id, string_agg(o_orderpriority, '|' ORDER BY o_orderkey) AS priorities, list_sort(list(DISTINCT o_orderstatus))[1] AS first_status FROM orders GROUP BY o_custkey")
def strings_by_key(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id"))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"]), "|").alias("priorities"), F.array_min(F.collect_set("o_orderstatus")).alias("first_status"))


@query(f"SELECT doc_id, {NORM.format('text')} AS norm FROM documents")
def normalise_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalise(F.col("text")).alias("norm"))


@query("""SELECT doc_id, p[1] AS s1, p[2] AS s2, p[3] AS s3 FROM (SELECT doc_id, list_concat(list_filter(list_transform(string_split(text, '.'), lambda x: trim(x)), lambda x: x <> ''), ['', '', '']) AS p FROM documents)""")
def leading_sentences(spark, sf_dir):
    s = T.leading_sentences(F.col("text"), 3)
    return table(spark, sf_dir, "documents").select("doc_id", s.alias("p")).select("doc_id", *[F.element_at("p", i).alias(f"s{i}") for i in (1, 2, 3)])


# Tokens, labels, chunks

LABELLED = f"""k AS ({TOKENS_SQL}), g AS ({TAGS_SQL}),
h AS (SELECT k.conv_id, k.turn, k.pos, g.label, min(k.pos) OVER (PARTITION BY k.conv_id, k.turn) AS first FROM k JOIN g ON k.conv_id = g.conv_id AND k.turn = g.turn AND k."end" > g.s AND k.start < g.e),
t AS (SELECT k.conv_id, k.turn, CAST(k.pos AS INTEGER) AS pos, k.word, CAST(k.start AS INTEGER) AS start, CAST(k."end" AS INTEGER) AS "end", CASE WHEN h.pos IS NULL THEN 'O' ELSE concat(CASE WHEN h.pos = h.first THEN 'B-' ELSE 'I-' END, h.label) END AS tag FROM k LEFT JOIN h ON k.conv_id = h.conv_id AND k.turn = h.turn AND k.pos = h.pos)"""


def _labelled(spark, sf_dir):
    return spans.label_tokens(token_rows(spark, sf_dir), turn_tags(spark, sf_dir), ["conv_id", "turn"])


@query(f"WITH {LABELLED} SELECT conv_id, turn, pos, word, start, \"end\", tag FROM t")
def span_token_labels(spark, sf_dir):
    return _labelled(spark, sf_dir).select("conv_id", "turn", "pos", "word", "start", "end", "tag")


@query(f"""WITH {LABELLED} SELECT conv_id, turn, min(start) AS start, max("end") AS "end", substring(min(tag), 3) AS label, count(*) AS n_tokens FROM t WHERE tag <> 'O' GROUP BY conv_id, turn""")
def iob_runs(spark, sf_dir):
    """Entities decoded from the labels: the spans come back, widened to whole tokens."""
    return spans.decode(_labelled(spark, sf_dir), ["conv_id", "turn"])


@query(f"WITH {LABELLED} SELECT tag, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent FROM t GROUP BY tag")
def token_label_counts(spark, sf_dir):
    n = _labelled(spark, sf_dir).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("total")))).select("tag", "n", F.round(F.col("n") * 100.0 / F.col("total"), 6).alias("percent"))  # one row


@query(f"""WITH {LABELLED}, m AS (SELECT conv_id, turn, pos, count(*) OVER (PARTITION BY conv_id, turn) AS n, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) - 1 AS i, tag FROM t)
SELECT conv_id, turn, CAST(greatest(0, least(i - 4, n - 8)) AS INTEGER) AS start, CAST(least(n, greatest(0, least(i - 4, n - 8)) + 8) AS INTEGER) AS stop FROM m WHERE tag LIKE 'B-%'""")
def centered_chunks(spark, sf_dir):
    w = Window.partitionBy("conv_id", "turn")
    rows = _labelled(spark, sf_dir).withColumn("n", F.count(F.lit(1)).over(w).cast("int")).withColumn("i", F.row_number().over(w.orderBy("pos")) - 1)
    start, stop = spans.centered_chunk(F.col("i"), F.col("n"), 8)
    return rows.where(F.startswith("tag", F.lit("B-"))).select("conv_id", "turn", start.cast("int").alias("start"), stop.cast("int").alias("stop"))


@query(f"""WITH RECURSIVE {LABELLED}, n AS (SELECT conv_id, turn, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id, turn) AS n, coalesce(lead(tag) OVER w, 'O') AS nxt FROM t WINDOW w AS (PARTITION BY conv_id, turn ORDER BY pos)),
r AS (SELECT DISTINCT conv_id, turn, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS start, CAST(0 AS BIGINT) AS stop FROM n
  UNION ALL SELECT n.conv_id, n.turn, n.i, r.stop, CASE WHEN n.i = n.n OR n.i - r.stop >= 16 AND (nxt[1] <> 'I' OR n.i - r.stop >= 32) THEN n.i ELSE r.stop END FROM r JOIN n ON n.conv_id = r.conv_id AND n.turn = r.turn AND n.i = r.i + 1)
SELECT conv_id, turn, CAST(start // 16 AS INTEGER) AS id, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop FROM r WHERE stop > start""")
def standard_chunks(spark, sf_dir):
    rows = _labelled(spark, sf_dir).groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("pos", "tag")))["tag"].alias("tags"))
    return rows.select("conv_id", "turn", F.explode(spans.standard_chunks(F.col("tags"), 16)).alias("c")).select("conv_id", "turn", "c.*")


@query(r"""WITH RECURSIVE s AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])[\s\x0B]+', '\1' || chr(31), 'g'), chr(31)), lambda x: x <> '') AS p FROM documents),
x AS (SELECT doc_id, i, len(string_split(p[i], ' ')) AS n FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM s)),
r AS (SELECT doc_id, i, 0 AS chunk, n FROM x WHERE i = 1
  UNION ALL SELECT x.doc_id, x.i, CASE WHEN r.n + x.n <= 64 THEN chunk ELSE chunk + 1 END, CASE WHEN r.n + x.n <= 64 THEN r.n + x.n ELSE x.n END FROM r JOIN x ON x.doc_id = r.doc_id AND x.i = r.i + 1)
SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, CAST(max(n) AS INTEGER) AS words FROM r GROUP BY doc_id, chunk""")
def greedy_chunks(spark, sf_dir):
    """Sentences of documents, by number of words, put together up to 64 words."""
    lengths = F.transform(F.filter(F.split("text", r"(?<=[.!?])\s+"), lambda s: s != ""), lambda s: F.size(F.split(s, " ")))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(spans.greedy_chunks(lengths, 64)).alias("chunk", "words"))


@query()
def clean_spans(spark, sf_dir):
    """Spans of 24 characters of each turn, cleaned."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", (F.col("conv_id") % 10).cast("int").alias("start"))
    rows = rows.withColumn("c", kernels.clean_spans("text", "start", (F.col("start") + 24).cast("int"), F.lit("SYMPTOM")))
    return rows.select("conv_id", "turn", F.col("c.text").alias("span"), F.col("c.start").alias("start"), F.col("c.end").alias("end"))


@query()
def mojibake_fix(spark, sf_dir):
    """All documents, with broken encoding put right."""
    return table(spark, sf_dir, "documents").select("doc_id", kernels.repair_encoding("text").alias("text"))


@query(f"""WITH RECURSIVE k AS ({TOKENS_SQL}), n AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) AS i, CAST(length(word) % 3 AS DOUBLE) AS o, CAST(length(word) % 5 AS DOUBLE) AS b, CAST(length(word) % 7 AS DOUBLE) AS c FROM k),
r AS (SELECT conv_id, turn, i, o AS x, b AS y, c - 1e9 AS z, '0' AS px, '1' AS py, '2' AS pz FROM n WHERE i = 1
  UNION ALL SELECT conv_id, turn, i, greatest(x, y, z) + o, greatest(x, y, z) + b, greatest(x - 1e9, y, z) + c, p || ',0', p || ',1', q || ',2' FROM (
    SELECT n.*, x, y, z, CASE WHEN x >= y AND x >= z THEN px WHEN y >= z THEN py ELSE pz END AS p, CASE WHEN x - 1e9 >= y AND x - 1e9 >= z THEN px WHEN y >= z THEN py ELSE pz END AS q
    FROM r JOIN n ON n.conv_id = r.conv_id AND n.turn = r.turn AND n.i = r.i + 1))
SELECT conv_id, turn, CASE WHEN x >= y AND x >= z THEN px WHEN y >= z THEN py ELSE pz END AS path FROM (SELECT *, max(i) OVER (PARTITION BY conv_id, turn) AS last FROM r) WHERE i = last""")
def viterbi_decode(spark, sf_dir):
    """Tag paths of turns from scores by word length."""
    rows = token_rows(spark, sf_dir).withColumn("s", F.array((F.char_length("word") % 3).cast("double"), (F.char_length("word") % 5).cast("double"), (F.char_length("word") % 7).cast("double")))
    rows = rows.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("pos", "s")))["s"].alias("s"))
    return rows.select("conv_id", "turn", F.array_join(kernels.viterbi_bio("s").cast("array<string>"), ",").alias("path"))


@query("""SELECT event_type, date_trunc('day', ts) AS start, count(*) AS n FROM events GROUP BY ALL""")
def event_windows(spark, sf_dir):
    """Tumbling days; the same expression runs on a stream."""
    from ..streaming.incremental import rate_by_window

    return rate_by_window(table(spark, sf_dir, "events"), "1 day")


@query("""WITH e AS (SELECT user_id, event_id, ts, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), r AS (SELECT *, sum(CASE WHEN b IS NULL OR b <> event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM e)
SELECT user_id, CAST(run AS BIGINT) AS run, min(event_type) AS event_type, count(*) AS n FROM r GROUP BY user_id, run""")
def event_runs(spark, sf_dir):
    """Runs of equal events of a user (gaps and islands)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("b", F.lag("event_type").over(w))
    rows = rows.withColumn("run", F.sum(F.when(F.col("b").isNull() | (F.col("b") != F.col("event_type")), 1).otherwise(0)).over(w))
    return rows.groupBy("user_id", "run").agg(F.min("event_type").alias("event_type"), F.count(F.lit(1)).alias("n"))


# Fields and records

FIELDS = "f AS (SELECT page_id, nullif(trim(regexp_extract(html, '<title>([^<]*)', 1)), '') AS title, nullif(trim(regexp_extract(url, '://([^/?#]*)', 1)), '') AS host, url FROM pages)"


def _fields(spark, sf_dir):
    """Pages as records with a title, a host and a url, any of which may be blank."""
    title, host = F.regexp_extract("html", "<title>([^<]*)", 1), F.regexp_extract("url", "://([^/?#]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", title.alias("title"), host.alias("host"), "url")


@query(f"WITH {FIELDS} SELECT page_id, host FROM f WHERE contains(lower(host), 'example.net') AND (contains(title, 'es') OR contains(url, 'es'))")
def field_contains(spark, sf_dir):
    return records.where_contains(records.where_contains(_fields(spark, sf_dir), ["host"], "Example.NET", fold=True), ["title", "url"], "es").select("page_id", "host")


@query(f"WITH {FIELDS} SELECT page_id, coalesce(title, host, url) AS name FROM f")
def first_filled_field(spark, sf_dir):
    return _fields(spark, sf_dir).select("page_id", records.first_filled("title", "host", "url").alias("name"))


@query("SELECT page_id, coalesce(nullif(regexp_extract(url, '[0-9]+'), ''), nullif(regexp_extract(html, '[0-9]+'), '')) AS number FROM pages")
def first_matching_field(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", records.first_match("[0-9]+", "url", "html").alias("number"))


@query("SELECT l_orderkey AS id, l_linenumber AS line, l_discount * 10 AS similarity FROM lineitem WHERE l_discount * 10 < 0.3")
def low_quality_matches(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), (F.col("l_discount") * 10).alias("similarity"))
    return records.low_quality(rows, 0.3)


@query("SELECT coalesce(CAST(quality AS VARCHAR), 'none') AS licence, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM documents LEFT JOIN labels USING (doc_id) GROUP BY quality")
def value_shares(spark, sf_dir):
    """Shares of values, null among them."""
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return records.shares(rows, "quality").select(F.coalesce(F.col("quality").cast("string"), F.lit("none")).alias("licence"), "n", F.round("share", 9).alias("share"))


@query("WITH m AS (SELECT *, count(*) OVER () AS all_rows FROM lineitem) SELECT l_returnflag AS stage, count(*) AS n, round(count(*) / max(all_rows), 9) AS rate FROM m GROUP BY l_returnflag")
def match_rates(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("stage"))
    return records.shares(rows, "stage").select("stage", "n", F.round("share", 9).alias("rate"))


@query("WITH c AS (SELECT o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1) SELECT label, n, round(sum(n) OVER () / (count(*) OVER () * n), 9) AS weight FROM c")
def balanced_weights(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return score.balanced_weights(counts).withColumn("weight", F.round("weight", 9))


@query(f"""WITH k AS ({TOKENS_SQL}), g AS ({TAGS_SQL} UNION ALL SELECT conv_id, turn, 'EVEN', CAST(conv_id % 15 AS INTEGER), CAST(conv_id % 15 + 20 AS INTEGER) FROM conversations WHERE conv_id % 2 = 0),
n AS (SELECT k.conv_id, k.turn, k.pos, count(g.label) AS n FROM k LEFT JOIN g ON k.conv_id = g.conv_id AND k.turn = g.turn AND k."end" > g.s AND k.start < g.e GROUP BY k.conv_id, k.turn, k.pos)
SELECT count(*) AS tokens, count(*) FILTER (WHERE n > 0) AS labelled, count(*) FILTER (WHERE n > 1) AS multi, round(100.0 * count(*) FILTER (WHERE n > 0) / count(*), 6) AS percent_labelled, round(100.0 * count(*) FILTER (WHERE n > 1) / count(*) FILTER (WHERE n > 0), 6) AS percent_multi FROM n""")
def multilabel_statistics(spark, sf_dir):
    out = score.multilabel_statistics(_multilabelled(spark, sf_dir))
    return out.select("tokens", "labelled", "multi", *[F.round(c, 6).alias(c) for c in ("percent_labelled", "percent_multi")])


def _multilabelled(spark, sf_dir):
    """Tokens with all labels of two tags a turn, that of even conversations being the second."""
    one = turn_tags(spark, sf_dir)
    start = (F.col("conv_id") % 15).cast("int")
    two = table(spark, sf_dir, "conversations").where("conv_id % 2 = 0").select("conv_id", "turn", F.lit("EVEN").alias("label"), start.alias("start"), (start + 20).alias("end"), F.lit(2).alias("ord"))
    return spans.label_tokens_multi(token_rows(spark, sf_dir), one.unionByName(two), ["conv_id", "turn"])


@query(f"""WITH k AS ({TOKENS_SQL}), g AS (SELECT *, 1 AS ord FROM ({TAGS_SQL}) UNION ALL SELECT conv_id, turn, 'EVEN', CAST(conv_id % 15 AS INTEGER), CAST(conv_id % 15 + 20 AS INTEGER), 2 FROM conversations WHERE conv_id % 2 = 0),
h AS (SELECT k.conv_id, k.turn, k.pos, g.ord, g.label, min(k.pos) OVER (PARTITION BY k.conv_id, k.turn, g.ord) AS first FROM k JOIN g ON k.conv_id = g.conv_id AND k.turn = g.turn AND k."end" > g.s AND k.start < g.e),
a AS (SELECT conv_id, turn, pos, string_agg(concat(CASE WHEN pos = first THEN 'B-' ELSE 'I-' END, label), '|' ORDER BY ord) AS tags FROM h GROUP BY conv_id, turn, pos)
SELECT k.conv_id, k.turn, CAST(k.pos AS INTEGER) AS pos, coalesce(a.tags, '') AS tags FROM k LEFT JOIN a ON k.conv_id = a.conv_id AND k.turn = a.turn AND k.pos = a.pos""")
def multilabel_tokens(spark, sf_dir):
    return _multilabelled(spark, sf_dir).select("conv_id", "turn", "pos", F.array_join("tags", "|").alias("tags"))


@query("SELECT tag, CAST(row_number() OVER (ORDER BY tag <> 'O', tag) - 1 AS INTEGER) AS number FROM (SELECT 'O' AS tag UNION SELECT unnest([concat('B-', upper(role)), concat('I-', upper(role))]) FROM conversations)")
def label_vocabulary(spark, sf_dir):
    return spans.label_vocabulary(turn_tags(spark, sf_dir))


@query("SELECT DISTINCT upper(role) AS label FROM conversations")
def entity_types(spark, sf_dir):
    return turn_tags(spark, sf_dir).select("label").distinct()


@query(f"""WITH {LABELLED} SELECT conv_id, turn, pos, CASE WHEN tag = 'O' OR lower(substring(tag, 3)) IN ('user', 'system') THEN tag ELSE 'O' END AS tag FROM t""")
def tag_filter(spark, sf_dir):
    return _labelled(spark, sf_dir).select("conv_id", "turn", "pos", spans.keep_types(F.col("tag"), ["User", "SYSTEM"]).alias("tag"))


@query(f"""WITH {LABELLED}, s AS (SELECT conv_id, turn, pos, unnest(range(0, 1 + length(word) // 5)) AS sub, tag FROM t)
SELECT conv_id, turn, pos, CAST(sub AS INTEGER) AS sub, CASE WHEN sub > 0 AND starts_with(tag, 'B-') THEN concat('I-', substring(tag, 3)) ELSE tag END AS tag FROM s""")
def subword_labels(spark, sf_dir):
    """Labels of words handed on to pieces of five characters."""
    pieces = F.sequence(F.lit(0), F.floor(F.char_length("word") / 5).cast("int"))
    rows = _labelled(spark, sf_dir).withColumn("sub", F.explode(pieces))
    return rows.select("conv_id", "turn", "pos", "sub", spans.subword_tag(F.col("tag"), F.col("sub")).alias("tag"))


@query(f"""WITH {LABELLED} SELECT conv_id, turn, pos, start + 1000 * turn AS start, "end" + 1000 * turn AS "end" FROM t WHERE tag <> 'O'""")
def shifted_spans(spark, sf_dir):
    """Offsets in chunks as offsets in documents."""
    rows = _labelled(spark, sf_dir).where("tag <> 'O'").withColumn("at", F.col("turn") * 1000)
    return spans.shift(rows, "at").select("conv_id", "turn", "pos", "start", "end")


@query("""WITH e AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b, ts, event_id FROM events)
SELECT user_id, string_agg(event_type, ',' ORDER BY ts, event_id) AS types FROM e WHERE b IS NULL OR b <> event_type GROUP BY user_id""")
def consecutive_distinct(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))["event_type"].alias("types"))
    return rows.select("user_id", F.array_join(spans.without_repeats(F.col("types")), ",").alias("types"))


@query(f"""WITH g AS (SELECT DISTINCT {KEYS} FROM ({GOLD_SQL})), p AS (SELECT DISTINCT {KEYS} FROM ({PRED_SQL})), t AS (SELECT label FROM g UNION SELECT label FROM p)
SELECT t.label, (SELECT count(*) FROM g WHERE g.label = t.label) AS n_true, (SELECT count(*) FROM p WHERE p.label = t.label) AS n_predicted FROM t""")
def label_balance(spark, sf_dir):
    """True and predicted spans by label."""
    return score.label_balance(spans.dedup_spans(gold(spark, sf_dir)), spans.dedup_spans(pred(spark, sf_dir)))


@query("SELECT doc_id, replace(replace(text, chr(10), ' '), chr(9), ' ') AS line FROM documents")
def one_line_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.one_line(F.col("text")).alias("line"))


@query("SELECT p_partkey AS id, replace(replace(concat(lower(p_brand), '--', p_partkey), 'brand', ''), '--', '-') AS clean FROM part")
def clean_ids(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), T.clean_id(F.concat(F.lower("p_brand"), F.lit("--"), F.col("p_partkey").cast("string")), ["brand"]).alias("clean"))


@query("""WITH s AS (SELECT DISTINCT source FROM documents), b AS (SELECT source, ord(substring(md5(source), 1, 1)) % 2 AS batch FROM s)
SELECT source, CASE batch WHEN 0 THEN 'train' ELSE r END AS role FROM b, (SELECT unnest(['test', 'validation']) AS r) WHERE batch = 1 OR r = 'test'""")
def split_roles(spark, sf_dir):
    """Names of the first batch train; those of the second both test and validate."""
    rows = table(spark, sf_dir, "documents").select("source", (F.ascii(F.substring(F.md5("source"), 1, 1)) % 2).alias("batch"))
    return records.split_roles(rows, "source", F.col("batch") == 0).select("source", "role")


#: Tags and scores of tokens by a hash of their place: every order of types, gaps of O, and scores from 0.05 on.
PLACE = "CAST(concat('0x', substring(md5(concat(conv_id, '-', turn, '-', pos)), 1, 7)) AS BIGINT)"
TAGGED = f"""k AS ({TOKENS_SQL}), z AS (SELECT conv_id, turn, pos, start, "end", {PLACE} AS h FROM k),
tk AS (SELECT conv_id, turn, row_number() OVER w AS i, CAST(start AS INTEGER) AS s, CAST("end" AS INTEGER) AS e, tag, score, lead(tag) OVER w AS nxt FROM (
  SELECT *, ['O', 'O', 'B-X', 'B-Y', 'I-X', 'I-X', 'I-X', 'I-Y'][h % 8 + 1] AS tag, 0.05 + (h // 8 % 95) / 100 AS score FROM z) WINDOW w AS (PARTITION BY conv_id, turn ORDER BY pos))"""


@query(rf"""WITH RECURSIVE {TAGGED}, tx AS (SELECT tk.*, substring(tag, 3) AS kind, text FROM tk JOIN conversations USING (conv_id, turn)),
r AS (SELECT conv_id, turn, i, s, e, score, CASE WHEN tag <> 'O' THEN kind END AS label, e AS until, 1 AS entity, tag <> 'O' AS used FROM tx WHERE i = 1
  UNION ALL SELECT conv_id, turn, i, s, e, score, CASE WHEN tag = 'O' THEN NULL WHEN passed THEN label ELSE kind END, CASE WHEN passed THEN until ELSE e END, CASE WHEN grows OR passed THEN entity ELSE entity + 1 END, tag <> 'O' AND NOT passed FROM (
    SELECT t.*, r.label, r.until, r.entity, coalesce(r.label = t.kind, FALSE) AND (t.tag[1] = 'I' OR t.tag[1] = 'B' AND (r.until = t.s OR regexp_full_match(substring(t.text, r.until + 1, t.s - r.until), '\s+'))) AS grows,
      coalesce(t.tag[1] = 'I' AND r.label <> t.kind AND t.nxt = concat('I-', r.label), FALSE) AS passed
    FROM r JOIN tx t ON t.conv_id = r.conv_id AND t.turn = r.turn AND t.i = r.i + 1)),
g AS (SELECT conv_id, turn, entity, min(label) AS label, min(s) AS start, max(e) AS "end", avg(score) AS score, median(score) AS middle, min(score) AS least FROM r WHERE used GROUP BY conv_id, turn, entity)
SELECT conv_id, turn, label, start, "end", round(g.score, 6) AS score FROM g JOIN conversations c USING (conv_id, turn) WHERE middle >= 0.5 AND least > 0.1
  AND NOT regexp_full_match(trim(substring(c.text, start + 1, "end" - start)), '[^\p{{L}}\p{{N}}_]+')""")
def merged_entities(spark, sf_dir):
    """Entities of scored tokens, put together by the rules for touching and intruding tags."""
    h = T.small_hash(F.concat_ws("-", "conv_id", "turn", "pos"))
    tags = F.array(*[F.lit(t) for t in ("O", "O", "B-X", "B-Y", "I-X", "I-X", "I-X", "I-Y")])
    rows = token_rows(spark, sf_dir).withColumn("h", h).withColumns({"tag": F.get(tags, (F.col("h") % 8).cast("int")), "score": F.lit(0.05) + F.floor(F.col("h") / 8) % 95 / 100})
    chunks = rows.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("pos", "tag", "start", "end", "score"))).alias("tokens"))
    chunks = chunks.join(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), ["conv_id", "turn"])
    found = chunks.select("conv_id", "turn", F.explode(spans.merged_entities(F.col("tokens"), F.col("text"))).alias("e"))
    return found.select("conv_id", "turn", "e.label", "e.start", "e.end", F.round("e.score", 6).alias("score"))


@query(f"""WITH a AS (SELECT doc_id, regexp_extract_all(text, '{spans.WORD}') AS w, string_split_regex(text, '{spans.WORD}') AS g FROM documents),
b AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, w, g FROM a),
c AS (SELECT doc_id, i, w[i] AS word, sum(length(w[i]) + length(g[i])) OVER (PARTITION BY doc_id ORDER BY i) AS "end" FROM b)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, word, CAST("end" - length(word) AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end" FROM c""")
def word_tokens(spark, sf_dir):
    """Words, numbers and signs of all documents with their offsets."""
    return spans.word_tokens(table(spark, sf_dir, "documents"), "doc_id")


@query(f"""WITH l AS (SELECT unnest(['quality', 'toxic']) AS label, unnest([quality, toxic]) AS truth, CAST(concat('0x', substring(md5(CAST(doc_id AS VARCHAR)), 1, 7)) AS BIGINT) % 200 / 200 AS prob FROM labels),
b AS (SELECT 'label' AS scope, label, truth, prob FROM l UNION ALL SELECT 'micro', '', truth, prob FROM l),
n AS (SELECT scope, label, sum(truth) FILTER (prob > 0.5) AS tp, count(*) FILTER (prob > 0.5) AS said, sum(truth) AS pos FROM b GROUP BY scope, label),
u AS (SELECT scope, label, avg(CASE WHEN x.prob > y.prob THEN 1.0 WHEN x.prob = y.prob THEN 0.5 ELSE 0.0 END) AS auc FROM b x JOIN b y USING (scope, label) WHERE x.truth = 1 AND y.truth = 0 GROUP BY scope, label),
m AS (SELECT scope, label, tp / said AS precision, tp / pos AS recall, auc FROM n JOIN u USING (scope, label)),
f AS (SELECT *, 2 * precision * recall / (precision + recall) AS f1 FROM m)
SELECT scope, label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(auc, 6) AS auc FROM (
  SELECT scope, label, precision, recall, f1, auc FROM f UNION ALL SELECT 'macro', '', avg(precision), avg(recall), avg(f1), avg(auc) FROM f WHERE scope = 'label')""")
def probability_scores(spark, sf_dir):
    """Scores of probabilities that a hash gives, so the areas are near a half."""
    rows = table(spark, sf_dir, "labels").withColumn("prob", T.small_hash(F.col("doc_id").cast("string")) % 200 / 200)
    rows = rows.unpivot(["prob"], ["quality", "toxic"], "label", "truth")
    return score.probability_scores(rows).select("scope", "label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "auc")])


PIECES = f"""k AS ({TOKENS_SQL}), p AS (SELECT conv_id, turn, pos, unnest(range(0, 1 + length(word) // 5)) AS sub FROM k),
q AS (SELECT *, CAST(concat('0x', substring(md5(concat(conv_id, '-', turn, '-', pos, '-', sub)), 1, 7)) AS BIGINT) AS h FROM p),
o AS (SELECT conv_id, turn, pos, sub, (h % 100) / 100 AS o, (h // 100 % 100) / 100 AS b, (h // 10000 % 100) / 100 AS i FROM q)"""


@query(f"""WITH {PIECES}, t AS (SELECT *, CASE WHEN b >= i THEN 'B-X' ELSE 'I-X' END AS other FROM o)
SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, CASE WHEN o > greatest(b, i) AND o >= 0.7 THEN 'O' ELSE other END AS tag FROM t WHERE sub = 0""")
def word_tags(spark, sf_dir):
    """Tags of words from scores of their pieces: O gives way to the best other tag under 0.7, the first piece decides."""
    rows = token_rows(spark, sf_dir).withColumn("sub", F.explode(F.sequence(F.lit(0), F.floor(F.char_length("word") / 5).cast("int"))))
    h = T.small_hash(F.concat_ws("-", "conv_id", "turn", "pos", "sub"))
    part = lambda d: F.floor(F.col("h") / d) % 100 / 100
    scores = F.create_map(F.lit("O"), part(1), F.lit("B-X"), part(100), F.lit("I-X"), part(10000))
    tagged = rows.withColumn("h", h).withColumn("tag", spans.override_o(scores, 0.7))
    return spans.word_tags(tagged, ["conv_id", "turn", "pos"])


# Chunks along lines and around spans; tags by head, by vocabulary and by piece

SPLIT = 48
CUTS = {"p": r"regexp_matches(word, '^[^\n]*\n\n')", "l": r"regexp_matches(regexp_replace(word, '\n\n+', '', 'g'), '^[^\n]*\n[^\n]*$')", "s": "regexp_matches(word, '^[.!?]')"}


def _level_sql(name: str, source: str, by: str) -> str:
    """Adds the number of cuts before a token, within pieces that are too long, and whether the new piece is."""
    cut = f"CASE WHEN long THEN coalesce(sum(CASE WHEN {CUTS[name]} THEN 1 ELSE 0 END) OVER (PARTITION BY {by} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE 0 END"
    return f"c{name} AS (SELECT * EXCLUDE (long), count(*) OVER (PARTITION BY {by}, {name}) > {SPLIT} AS long FROM (SELECT *, {cut} AS {name} FROM {source}))"


@query(rf"""WITH RECURSIVE k AS (SELECT doc_id, i - 1 AS pos, w[i] AS word, TRUE AS long FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{chunks.TOKEN}') AS w FROM documents))),
{_level_sql("p", "k", "doc_id")}, {_level_sql("l", "cp", "doc_id, p")}, {_level_sql("s", "cl", "doc_id, p, l")},
x AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS i, n FROM (SELECT doc_id, min(pos) AS start, count(*) AS n FROM cs GROUP BY doc_id, p, l, s, CASE WHEN long THEN pos ELSE -1 END)),
r AS (SELECT doc_id, i, 0 AS chunk, n FROM x WHERE i = 1
  UNION ALL SELECT x.doc_id, x.i, CASE WHEN r.n + x.n <= {SPLIT} THEN chunk ELSE chunk + 1 END, CASE WHEN r.n + x.n <= {SPLIT} THEN r.n + x.n ELSE x.n END FROM r JOIN x ON x.doc_id = r.doc_id AND x.i = r.i + 1),
c AS (SELECT doc_id, chunk, max(n) AS size FROM r GROUP BY doc_id, chunk), t AS (SELECT *, sum(size) OVER (PARTITION BY doc_id ORDER BY chunk) - size AS start FROM c)
SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, CAST(start AS INTEGER) AS start, CAST(size AS INTEGER) AS size FROM t WHERE size >= 8""")
def paragraph_chunks(spark, sf_dir):
    """Documents cut at blank lines, lines, sentences and words as far as needed, and put together up to 48 tokens; chunks under 8 go."""
    tokens = chunks.line_tokens(table(spark, sf_dir, "documents"), "doc_id")
    return chunks.paragraph_chunks(tokens, "doc_id", SPLIT).select("doc_id", "chunk", "start", "size")


#: Two tags a turn, as in `_multilabelled`.
TWO_SQL = f"SELECT *, 1 AS ord FROM ({TAGS_SQL}) UNION ALL SELECT conv_id, turn, 'EVEN', CAST(conv_id % 15 AS INTEGER), CAST(conv_id % 15 + 20 AS INTEGER), 2 FROM conversations WHERE conv_id % 2 = 0"
HITS = f"""k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY conv_id, turn) AS n FROM ({TOKENS_SQL})), g AS ({TWO_SQL}),
h AS (SELECT conv_id, turn, k.pos, k.i, g.ord, g.label, CASE WHEN k.pos = min(k.pos) OVER (PARTITION BY conv_id, turn, g.ord) THEN 'B' ELSE 'I' END AS part FROM k JOIN g USING (conv_id, turn) WHERE k."end" > g.s AND k.start < g.e)"""


def _two_tags(spark, sf_dir):
    start = (F.col("conv_id") % 15).cast("int")
    two = table(spark, sf_dir, "conversations").where("conv_id % 2 = 0").select("conv_id", "turn", F.lit("EVEN").alias("label"), start.alias("start"), (start + 20).alias("end"), F.lit(2).alias("ord"))
    return turn_tags(spark, sf_dir).unionByName(two)


@query(f"""WITH {HITS}, inner_ AS (SELECT DISTINCT conv_id, turn, i FROM h WHERE part = 'I'), clear AS (SELECT conv_id, turn, i FROM k ANTI JOIN inner_ USING (conv_id, turn, i)),
f AS (SELECT conv_id, turn, g.ord, g.label, max(k.n) AS n, min(k.i) FILTER (k."end" > g.s) AS first, coalesce(min(k.i) FILTER (k.start >= g.e), max(k.n)) AS after FROM g JOIN k USING (conv_id, turn) GROUP BY conv_id, turn, g.ord, g.label),
b AS (SELECT *, greatest(first - 3, 0) AS l, least(after + 3, n) AS r FROM f WHERE first IS NOT NULL),
a AS (SELECT b.*, coalesce((SELECT max(c.i) FROM clear c WHERE c.conv_id = b.conv_id AND c.turn = b.turn AND c.i <= b.l), 0) AS cl, coalesce((SELECT min(c.i) FROM clear c WHERE c.conv_id = b.conv_id AND c.turn = b.turn AND c.i >= b.r - 1) + 1, n) AS cr FROM b),
d AS (SELECT *, least(l, greatest(cl, r - 12)) AS start FROM a)
SELECT conv_id, turn, label, CAST(start AS INTEGER) AS start, CAST(least(n, cr, greatest(r, start + 12), start + 12) AS INTEGER) AS stop FROM d""")
def widened_chunks(spark, sf_dir):
    """Six tokens more around each of two tags a turn, moved out of entities, up to twelve."""
    t = _multilabelled(spark, sf_dir).groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("pos", "start", "end", "tags"))).alias("t"))
    inside = F.transform("t", lambda x: F.exists(x["tags"], lambda y: F.startswith(y, F.lit("I-"))))
    rows = _two_tags(spark, sf_dir).join(t.withColumn("inside", inside), ["conv_id", "turn"])
    rows = rows.withColumn("at", chunks.token_range(F.col("t"), F.col("start"), F.col("end"))).where("at IS NOT NULL")
    return rows.select("conv_id", "turn", "label", chunks.widened_chunk(F.col("inside"), F.col("at.first"), F.col("at.after"), 6).alias("c")).select("conv_id", "turn", "label", "c.*")


@query(f"""WITH {HITS}, o AS (SELECT conv_id, turn, pos, label, max_by(part, ord) AS tag FROM h GROUP BY conv_id, turn, pos, label)
SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, string_agg(coalesce(o.tag, 'O'), '|' ORDER BY y.label) AS heads FROM (SELECT * FROM k, (SELECT unnest(['EVEN', 'USER']) AS label)) y LEFT JOIN o USING (conv_id, turn, pos, label) GROUP BY conv_id, turn, pos""")
def head_labels(spark, sf_dir):
    """One B, I or O for each of two types; a third type is ignored."""
    types = ["EVEN", "USER"]
    rows = chunks.head_tags(token_rows(spark, sf_dir), _two_tags(spark, sf_dir), ["conv_id", "turn"], types)
    return rows.select("conv_id", "turn", "pos", F.array_join(F.transform(F.lit(types), lambda t: F.try_element_at("heads", t)), "|").alias("heads"))


@query(f"""WITH {HITS}, a AS (SELECT conv_id, turn, pos, list(concat(part, '-', label)) AS tags FROM h GROUP BY conv_id, turn, pos), v AS (SELECT ['O', 'B-USER', 'I-USER', 'B-EVEN', 'I-EVEN'] AS v)
SELECT k.conv_id, k.turn, CAST(k.pos AS INTEGER) AS pos, array_to_string(list_transform(v, lambda x: CASE WHEN x = 'O' THEN CAST(NOT list_has_any(coalesce(tags, []), v) AS INTEGER) ELSE CAST(list_contains(coalesce(tags, []), x) AS INTEGER) END), '') AS bits
FROM k CROSS JOIN v LEFT JOIN a USING (conv_id, turn, pos)""")
def one_hot_labels(spark, sf_dir):
    bits = chunks.one_hot(F.col("tags"), ["O", "B-USER", "I-USER", "B-EVEN", "I-EVEN"])
    return _multilabelled(spark, sf_dir).select("conv_id", "turn", "pos", F.array_join(bits.cast("array<string>"), "").alias("bits"))


@query(f"""WITH {LABELLED}, l AS (SELECT conv_id, turn, list(tag ORDER BY pos) AS l FROM t GROUP BY conv_id, turn)
SELECT conv_id, turn, array_to_string(list_resize(l, 24, 'PAD'), ' ') AS tags, CAST(least(len(l), 24) AS INTEGER) AS kept FROM l""")
def padded_tags(spark, sf_dir):
    """Tags of turns cut or filled up to 24, with the sum of the mask."""
    rows = _labelled(spark, sf_dir).groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("pos", "tag")))["tag"].alias("l"))
    tags, mask = chunks.pad(F.col("l"), 24, F.lit("PAD"))
    return rows.select("conv_id", "turn", F.array_join(tags, " ").alias("tags"), F.aggregate(mask, F.lit(0), lambda s, x: s + x).alias("kept"))


@query(rf"""WITH g AS (SELECT conv_id, turn, label, s, substring(text, s + 1, e - s) AS x FROM ({TAGS_SQL}) JOIN conversations USING (conv_id, turn)),
p AS (SELECT *, length(regexp_extract(x, '^{chunks.SPACE}*')) AS lead, regexp_extract(x, '^[\x20\x09-\x0D]*([^\x20\x09-\x0D]*)', 1) AS head, length(regexp_extract(x, '^[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]+')) AS skip FROM g),
u AS (SELECT conv_id, turn, concat('B-', label) AS tag, s + lead AS start, head AS piece FROM p UNION ALL SELECT conv_id, turn, concat('I-', label), s + skip, substring(x, skip + 1) FROM p WHERE skip > 0)
SELECT conv_id, turn, tag, CAST(start AS INTEGER) AS start, CAST(start + length(piece) AS INTEGER) AS "end", piece FROM u WHERE piece <> ''""")
def span_pieces(spark, sf_dir):
    """Spans as a piece for the first word and one for the rest."""
    rows = turn_tags(spark, sf_dir).join(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), ["conv_id", "turn"])
    pieces = chunks.first_and_rest(F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")), F.col("start"), F.col("label"))
    return rows.select("conv_id", "turn", F.explode(pieces).alias("p")).select("conv_id", "turn", "p.tag", "p.start", "p.end", F.col("p.text").alias("piece"))


@query(f"""WITH {PIECES} SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, round(min_by(o, sub), 6) AS first, round(max_by(o, sub), 6) AS last, round(avg(o), 6) AS mean FROM o GROUP BY conv_id, turn, pos""")
def word_scores(spark, sf_dir):
    """Scores of words from those of their pieces, in three ways."""
    rows = token_rows(spark, sf_dir).withColumn("sub", F.explode(F.sequence(F.lit(0), F.floor(F.char_length("word") / 5).cast("int"))))
    rows = rows.withColumn("o", T.small_hash(F.concat_ws("-", "conv_id", "turn", "pos", "sub")) % 100 / 100)
    keys, ways = ["conv_id", "turn", "pos"], ("first", "last", "mean")
    rows = rows.withColumns({w: F.col("o") for w in ways})
    both = [chunks.word_scores(rows, keys, [w], w).withColumn(w, F.round(w, 6)) for w in ways]
    return both[0].join(both[1], keys).join(both[2], keys)


MOVES, STARTS, ENDS = [[0.1, 0.2, kernels.FORBIDDEN], [0.3, 0.05, 0.4], [0.2, 0.1, 0.3]], [0.2, 0.1, kernels.FORBIDDEN], [0.05, 0.0, 0.1]


@query(f"""WITH RECURSIVE {LABELLED}, n AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) AS i, CASE WHEN tag[1] = 'O' THEN 0 WHEN tag[1] = 'B' THEN 1 ELSE 2 END AS t, [length(word) % 3 / 10, length(word) % 5 / 10, length(word) % 7 / 10] AS e FROM t),
r AS (SELECT conv_id, turn, i, t, e[1] + 0.2 AS x, e[2] + 0.1 AS y, e[3] - 1e9 AS z, e[t + 1] + {STARTS}[t + 1] AS path FROM n WHERE i = 1
  UNION ALL SELECT n.conv_id, n.turn, n.i, n.t, ln(exp(x + 0.1) + exp(y + 0.3) + exp(z + 0.2)) + e[1], ln(exp(x + 0.2) + exp(y + 0.05) + exp(z + 0.1)) + e[2], ln(exp(x - 1e9) + exp(y + 0.4) + exp(z + 0.3)) + e[3], path + {MOVES}[r.t + 1][n.t + 1] + e[n.t + 1]
  FROM r JOIN n ON n.conv_id = r.conv_id AND n.turn = r.turn AND n.i = r.i + 1)
SELECT conv_id, turn, round(path + {ENDS}[t + 1], 6) AS path, round(ln(exp(x + 0.05) + exp(y) + exp(z + 0.1)), 6) AS normaliser FROM (SELECT *, max(i) OVER (PARTITION BY conv_id, turn) AS last FROM r) WHERE i = last""")
def chain_scores(spark, sf_dir):
    """The score of the labels of turns in a linear chain, and the logarithm of the sum over all paths."""
    e = F.array(*[(F.char_length("word") % k).cast("double") / 10 for k in (3, 5, 7)])
    number = F.when(F.col("tag") == "O", 0).when(F.startswith("tag", F.lit("B")), 1).otherwise(2)
    rows = _labelled(spark, sf_dir).withColumns({"e": e, "t": number}).groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("pos", "e", "t"))).alias("a"))
    path = numeric.chain_score(F.col("a.e"), F.col("a.t"), MOVES, STARTS, ENDS)
    return rows.select("conv_id", "turn", F.round(path, 6).alias("path"), F.round(numeric.chain_normaliser(F.col("a.e"), MOVES, STARTS, ENDS), 6).alias("normaliser"))


@query(f"""WITH d AS (SELECT concat(conv_id, '-', turn) AS filename, conv_id, turn, label, s, e FROM ({TAGS_SQL})), k AS ({TOKENS_SQL}),
x AS (SELECT filename, label, min(k.start) AS start, max(k."end") AS "end" FROM d JOIN k USING (conv_id, turn) WHERE k."end" > d.s AND k.start < d.e GROUP BY filename, label),
y AS (SELECT filename, label, min(k.start) AS start, max(k."end") AS "end" FROM d JOIN k USING (conv_id, turn) WHERE k."end" > d.s + 3 * (conv_id % 2) AND k.start < d.e + 3 * (conv_id % 2) GROUP BY filename, label),
b AS (SELECT coalesce(x.label, y.label) AS label, CAST(x.label IS NOT NULL AS INTEGER) AS g, CAST(y.label IS NOT NULL AS INTEGER) AS p FROM x FULL JOIN y ON x.filename = y.filename AND x.label = y.label AND x.start = y.start AND x."end" = y."end"),
c AS (SELECT label, CAST(sum(g * p) AS BIGINT) AS tp, CAST(sum(p) AS BIGINT) AS np, CAST(sum(g) AS BIGINT) AS ng FROM b GROUP BY label),
{REPORT}""")
def entity_level_scores(spark, sf_dir):
    """Labels of true and shifted tags, decoded to entities and scored by these."""
    key, by = ["conv_id", "turn"], 3 * (F.col("conv_id") % 2).cast("int")
    moved = turn_tags(spark, sf_dir).withColumns({c: F.col(c) + by for c in ("start", "end")})
    said = spans.label_tokens(token_rows(spark, sf_dir), moved, key)
    sides = [spans.decode(t, key).select(F.concat_ws("-", *key).alias("filename"), "label", "start", "end", F.lit(0).alias("ord")) for t in (_labelled(spark, sf_dir), said)]
    return score.strict(*sides).select("label", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


# Vectors and records

@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT a.vec_id, a.v AS a, b.v AS b FROM v a JOIN v b ON b.vec_id = a.vec_id + 1),
w AS (SELECT *, acos(greatest(-1.0, least(1.0, list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)))))) AS w FROM p),
m AS (SELECT vec_id, list_transform(range(1, len(a) + 1), lambda i: sin(0.75 * w) / sin(w) * a[i] + sin(0.25 * w) / sin(w) * b[i]) AS m FROM w)
SELECT vec_id, round(m[1], 6) AS first, round(m[len(m)], 6) AS last, round(sqrt(list_dot_product(m, m)), 6) AS length FROM m""")
def slerp_neighbours(spark, sf_dir):
    """A quarter of the way along the arc from each vector to the next."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    rows = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id").select("vec_id", numeric.slerp(F.col("a"), F.col("b"), 0.25).alias("m"))
    return rows.select("vec_id", F.round(F.get("m", 0), 6).alias("first"), F.round(F.element_at("m", -1), 6).alias("last"), F.round(F.sqrt(T.dot(F.col("m"), F.col("m"))), 6).alias("length"))


def _round_sql(i: int) -> str:
    """One step of the Karcher mean: from the directions m{i - 1} by label to m{i}."""
    return f"""l{i} AS (SELECT label, u, m, list_dot_product(m, u) AS c FROM u JOIN m{i - 1} USING (label)),
a{i} AS (SELECT label, m, list_transform(range(1, len(u) + 1), lambda i: u[i] - c * m[i]) AS a, acos(greatest(-1.0, least(1.0, c))) AS w FROM l{i}),
b{i} AS (SELECT label, i, avg(x) AS x, first(y) AS y FROM (SELECT label, unnest(range(1, len(a) + 1)) AS i, unnest(list_transform(a, lambda x: x * w / sqrt(list_dot_product(a, a)))) AS x, unnest(m) AS y FROM a{i}) GROUP BY label, i),
d{i} AS (SELECT label, list(x ORDER BY i) AS x, list(y ORDER BY i) AS y FROM b{i} GROUP BY label),
m{i} AS (SELECT label, list_transform(range(1, len(x) + 1), lambda i: cos(n) * y[i] + sin(n) / n * x[i]) AS m FROM (SELECT *, sqrt(list_dot_product(x, x)) AS n FROM d{i}))"""


@query(f"""WITH v AS (SELECT label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), u AS (SELECT label, sqrt(list_dot_product(v, v)) AS n, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM v),
s0 AS (SELECT label, list(x ORDER BY i) AS s FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(range(1, len(u) + 1)) AS i, unnest(u) AS x FROM u) GROUP BY label, i) GROUP BY label),
m0 AS (SELECT label, list_transform(s, lambda x: x / sqrt(list_dot_product(s, s))) AS m FROM s0), {", ".join(_round_sql(i) for i in (1, 2, 3))}, r AS (SELECT label, avg(n) AS n FROM u GROUP BY label)
SELECT label, CAST(unnest(range(0, len(m))) AS INTEGER) AS pos, round(unnest(m) * n, 5) AS x FROM m3 JOIN r USING (label)""")
def centroid_karcher(spark, sf_dir):
    """Three rounds of the mean on the sphere."""
    rows = table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"))
    return corpus.spherical_means(rows, "label", rounds=3).withColumn("x", F.round("x", 5))


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12)")
def unlisted_rows(spark, sf_dir):
    listed = table(spark, sf_dir, "customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("o_custkey"))
    return records.without_listed(table(spark, sf_dir, "orders"), listed, "o_custkey").select("o_orderkey")


@query("""SELECT o_orderkey, unnest(CASE o_orderpriority WHEN '1-URGENT' THEN ['fast', 'paid'] WHEN '2-HIGH' THEN ['fast'] WHEN '5-LOW' THEN ['slow'] ELSE [] END) AS class FROM orders""")
def classes_of_keys(spark, sf_dir):
    """Some priorities stand for two classes, some for none."""
    known = {"1-URGENT": ["fast", "paid"], "2-HIGH": ["fast"], "5-LOW": ["slow"]}
    return records.class_of(table(spark, sf_dir, "orders"), "o_orderpriority", known).select("o_orderkey", "class")


@query("""WITH a AS (SELECT r_name AS model, row_number() OVER (ORDER BY r_name) AS place FROM region), b AS (SELECT p AS fold, row_number() OVER (ORDER BY p) AS place FROM (SELECT DISTINCT o_orderpriority AS p FROM orders))
SELECT CAST(place AS INTEGER) AS place, model, fold FROM a JOIN b USING (place)""")
def fold_pairs(spark, sf_dir):
    """Names of both sides by their sorted places."""
    folds = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("fold")).distinct()
    return records.paired(table(spark, sf_dir, "region").select(F.col("r_name").alias("model")), folds, "model", "fold")


@query("""WITH r AS (SELECT o_orderpriority AS method, count(*) AS items, sum(o_custkey) / 100 AS seconds, max(o_totalprice) AS memory, sum(o_orderkey) AS matches FROM orders GROUP BY 1)
SELECT min_by(method, seconds) AS fastest, max_by(method, matches) AS most_matches, min_by(method, memory) AS lowest_memory, round(min_by(seconds / items, seconds) * 1e7 / 3600, 6) AS hours_at_target FROM r""")
def benchmark_summary(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("method")).agg(F.count(F.lit(1)).alias("items"), (F.sum("o_custkey") / 100).alias("seconds"), F.max("o_totalprice").alias("memory"), F.sum("o_orderkey").alias("matches"))
    return records.benchmark_report(runs).withColumn("hours_at_target", F.round("hours_at_target", 6))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20")
def top_matches(spark, sf_dir):
    """The twenty highest: a report."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber").limit(20)


@query("SELECT source, count(*) AS files, CAST(sum(CAST(n_chars AS BIGINT) * 1024) AS DOUBLE) AS bytes FROM documents GROUP BY source")
def size_totals(spark, sf_dir):
    size = T.byte_size(F.concat(F.col("n_chars").cast("string"), F.lit("K")))
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum(size).alias("bytes"))


@query()
def fuzzy_link(spark, sf_dir):
    """Benchmark items and the documents with an equal leading sentence, or else one like it among the first thousand sentences."""
    left, right = (table(spark, sf_dir, t).select(F.col(c).alias("id"), "text") for t, c in (("benchmark", "item_id"), ("documents", "doc_id")))
    return link.fuzzy_link(left, right).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH k AS ({TOKENS_SQL}), z AS (SELECT conv_id, turn, pos, start, "end", {PLACE} AS h FROM k),
t AS (SELECT * EXCLUDE (h), 'X' AS head, ['O', 'B', 'I', 'I'][h % 4 + 1] AS tag FROM z UNION ALL SELECT * EXCLUDE (h), 'Y', ['O', 'O', 'B', 'I', 'I'][h // 4 % 5 + 1] FROM z),
g AS (SELECT *, sum(CASE WHEN tag = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id, turn, head ORDER BY pos) AS n FROM t)
SELECT conv_id, turn, head, CAST(min(start) AS INTEGER) AS start, CAST(max("end") AS INTEGER) AS "end" FROM g GROUP BY conv_id, turn, head, n HAVING bool_or(tag = 'B')""")
def head_entities(spark, sf_dir):
    """Entities of two heads whose tags a hash gives, every order among them."""
    h = T.small_hash(F.concat_ws("-", "conv_id", "turn", "pos"))
    pick = lambda tags, at: F.get(F.lit(tags), at.cast("int"))
    one, two = pick(["O", "B", "I", "I"], F.col("h") % 4), pick(["O", "O", "B", "I", "I"], F.floor(F.col("h") / 4) % 5)
    rows = token_rows(spark, sf_dir).withColumn("h", h).withColumn("t", F.explode(F.array(F.struct(F.lit("X").alias("head"), one.alias("tag")), F.struct(F.lit("Y").alias("head"), two.alias("tag")))))
    return spans.decode_heads(rows.select("conv_id", "turn", "pos", "start", "end", "t.head", "t.tag"), ["conv_id", "turn"])


@query("""WITH r AS (SELECT concat('case--', l_orderkey // 3, 'x') AS id, CASE WHEN l_orderkey % 50 = 0 THEN 'other' ELSE concat('text ', l_orderkey // 3) END AS text, CAST(l_linenumber % 3 AS INTEGER) AS s, CASE l_returnflag WHEN 'A' THEN 'ENFERMEDAD' WHEN 'N' THEN 'DISEASE' ELSE 'FARMACO' END AS tag FROM lineitem),
c AS (SELECT replace(replace(id, 'case', ''), '--', '-') AS id, text, s, CASE tag WHEN 'ENFERMEDAD' THEN 'DISEASE' WHEN 'FARMACO' THEN 'MEDICATION' ELSE tag END AS tag FROM r),
k AS (SELECT id, min(text) AS text FROM c GROUP BY id HAVING count(DISTINCT text) = 1), d AS (SELECT DISTINCT id, s, tag FROM c)
SELECT id, text, string_agg(concat(s, ':', s + 2, ':', tag), ' ' ORDER BY s, tag) AS tags FROM k JOIN d USING (id) GROUP BY id, text""")
def collected_annotations(spark, sf_dir):
    """Tags of rows whose cleaned ids agree, types in English; ids with two texts are left out."""
    key = F.floor(F.col("l_orderkey") / 3).cast("string")
    start = (F.col("l_linenumber") % 3).cast("int")
    tag = F.when(F.col("l_returnflag") == "A", "ENFERMEDAD").when(F.col("l_returnflag") == "N", "DISEASE").otherwise("FARMACO")
    text = F.when(F.col("l_orderkey") % 50 == 0, "other").otherwise(F.concat(F.lit("text "), key))
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("case--"), key, F.lit("x")).alias("id"), text.alias("text"), F.array(F.struct(start.alias("start"), (start + 2).alias("end"), tag.alias("tag"))).alias("tags"))
    out = corpus.collect_annotations(rows, ["case"], same_text=True)
    return out.select("id", "text", F.array_join(F.transform("tags", lambda t: F.concat_ws(":", t["start"].cast("string"), t["end"].cast("string"), t["tag"])), " ").alias("tags"))


def entry(spark: SparkSession) -> DataFrame:
    """The flagship: documents linked to one another by leading sentences."""
    return self_link(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
