"""The binning operators on the shared test tables, each with SQL for the same rows.

There is no DNA in the tables: letters A, T, G and C of ``documents`` stand for sequences,
prices and quantities for coverage, brands for bins.  Doubles are rounded where sums of
doubles depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbin.functions import sequences as seqs
from quillbin.functions import statistics as st
from quillbin.operators import coverage, depth, evaluation, markers, merging, naive_bayes, seeds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- evaluation ------------------------------------------------------------------------


def part_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") <= 5, "unassigned").otherwise(F.col("p_brand")).alias("bin"), F.col("p_size").cast("long").alias("length"), F.col("p_type").alias("species"))
    return evaluation.confusion(part.select("id", "bin", "length"), part.select("id", "species"))


PART = """
WITH p AS (SELECT CASE WHEN p_size <= 5 THEN 'unassigned' ELSE p_brand END AS bin, p_type AS species, CAST(p_size AS BIGINT) AS length FROM part),
m AS (SELECT bin, species, sum(length) AS n FROM p GROUP BY ALL),
b AS (SELECT bin, species, n, sum(n) OVER (PARTITION BY bin) AS bn, row_number() OVER (PARTITION BY bin ORDER BY n DESC, species) AS r FROM m WHERE bin <> 'unassigned'),
s AS (SELECT *, row_number() OVER (PARTITION BY species ORDER BY n DESC, bin) AS q FROM b WHERE r = 1),
t AS (SELECT species, sum(length) AS t, coalesce(sum(length) FILTER (bin = 'unassigned'), 0) AS u FROM p GROUP BY species)
"""


@query(
    PART
    + """SELECT round(100.0 * (SELECT sum(n * n / bn) FROM s WHERE q = 1) / sum(t), 6) AS performance, round(100.0 * (SELECT sum(n) FROM b WHERE r = 1) / sum(t - u), 6) AS precision,
  round(100.0 * (SELECT sum(n) FROM s WHERE q = 1) / sum(t), 6) AS sensitivity, round(100.0 * sum(t - u) / sum(t), 6) AS assigned FROM t"""
)
def eval_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.overall(part_matrix(spark, sf_dir)), "performance", "precision", "sensitivity", "assigned")


@query(PART + "SELECT s.species, bin, round(100.0 * n / bn, 6) AS precision, round(100.0 * n / t, 6) AS sensitivity, round(100.0 * (t - u) / t, 6) AS assigned FROM s JOIN t USING (species) WHERE q = 1")
def eval_per_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.per_species(part_matrix(spark, sf_dir)), "precision", "sensitivity", "assigned")


@query("""
WITH d AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'unassigned' ELSE source END AS bin, n_chars AS n FROM documents),
w AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
f AS (SELECT bin, sum(n) AS n FROM d SEMI JOIN w USING (doc_id) GROUP BY bin),
best AS (SELECT bin, n FROM f WHERE bin <> 'unassigned' ORDER BY n DESC, bin LIMIT 1)
SELECT best.bin, (SELECT count(*) FROM f WHERE bin <> 'unassigned') AS n_bins, round(100.0 * best.n / (SELECT sum(n) FROM d WHERE d.bin = best.bin), 6) AS precision,
  round(100.0 * best.n / (SELECT sum(n) FROM f), 6) AS sensitivity, round(100.0 * (SELECT sum(n) FROM f WHERE bin <> 'unassigned') / (SELECT sum(n) FROM f), 6) AS assigned,
  round(100.0 * (SELECT sum(n) FROM d WHERE bin <> 'unassigned') / (SELECT sum(n) FROM d), 6) AS assigned_all
FROM best""")
def target_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    bins = docs.select(F.col("doc_id").alias("id"), F.when(F.col("lang") == "en", "unassigned").otherwise(F.col("source")).alias("bin"), F.col("n_chars").alias("length"))
    wanted = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return rounded(evaluation.one_genome(bins, wanted), "precision", "sensitivity", "assigned", "assigned_all")


SPANS = "SELECT o_custkey AS qry, CAST(date_part('epoch', o_orderdate) AS BIGINT) // 86400 AS a, CAST(date_part('epoch', o_orderdate) AS BIGINT) // 86400 + CAST(o_orderkey % 90 AS BIGINT) AS b FROM orders"


def order_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.floor(F.unix_timestamp("o_orderdate") / 86400)
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("qry"), (day + F.col("o_orderkey") % 90).alias("start"), day.alias("end"))


@query(f"WITH s AS ({SPANS}) SELECT qry, count(DISTINCT p) AS covered FROM (SELECT qry, unnest(range(a, b + 1)) AS p FROM s) GROUP BY qry")
def merge_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.covered(order_spans(spark, sf_dir), ["qry"])


@query(f"WITH s AS ({SPANS}), c AS (SELECT qry, count(DISTINCT p) AS n FROM (SELECT qry, unnest(range(a, b + 1)) AS p FROM s) GROUP BY qry) SELECT qry, count(*) AS n_rows FROM s SEMI JOIN (SELECT qry FROM c WHERE n >= 0.9 * 600) USING (qry) GROUP BY qry")
def covered_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = order_spans(spark, sf_dir).select("qry", F.lit(600).cast("long").alias("len_q"), F.col("start").alias("s2"), F.col("end").alias("e2"))
    good, _ = evaluation.well_covered(spans)
    return good.groupBy("qry").agg(F.count("*").alias("n_rows"))


@query("""
WITH l AS (SELECT l_suppkey AS qry, l_partkey AS ref, CAST(l_quantity AS BIGINT) * 40 AS a, CAST(l_quantity AS BIGINT) * 40 + l_linenumber * CASE WHEN l_partkey % 3 = 0 THEN 50 ELSE 100 END AS b FROM lineitem),
c AS (SELECT qry, ref, count(DISTINCT p) / 3000.0 AS part FROM (SELECT qry, ref, unnest(range(a, b + 1)) AS p FROM l) GROUP BY qry, ref)
SELECT qry, ref, round(part, 6) AS part FROM (SELECT *, row_number() OVER (PARTITION BY qry ORDER BY part DESC, ref) AS r FROM c) WHERE r = 1""")
def best_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the parts are as long as the suppliers, where the reference's places count."""
    at = F.col("l_quantity").cast("long") * 40
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("qry"), F.col("l_partkey").alias("ref"), at.alias("s2"), (at + F.col("l_linenumber") * 100).alias("e2"), (at + F.col("l_linenumber") * 50).alias("s1"), at.alias("e1"))
    rows = rows.withColumns({"len_q": F.lit(3000), "len_r": F.when(F.col("ref") % 3 == 0, 3000).otherwise(5000)})
    return rounded(evaluation.best_reference(rows), "part")


@query("SELECT l_orderkey AS gene, arg_min(l_partkey, {'e': l_extendedprice, 'm': l_partkey}) AS model FROM lineitem GROUP BY l_orderkey")
def min_evalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.least_evalue(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("gene"), F.col("l_partkey").alias("model"), F.col("l_extendedprice").alias("evalue")))


@query("SELECT c_custkey, 'unassigned' AS bin FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderpriority = '1-URGENT')")
def unassigned_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(urgent, "c_custkey", "left_anti").select("c_custkey", F.lit("unassigned").alias("bin"))


@query("""
WITH c AS (SELECT DISTINCT o_custkey AS id, l_suppkey AS seed FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
x AS (SELECT DISTINCT o_custkey AS id, l_suppkey AS seed FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R')
SELECT id, count(*) AS n FROM c ANTI JOIN x USING (id, seed) GROUP BY id""")
def exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey", "l_returnflag").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    # candidates less excluded pairs: one grouping instead of a join with itself
    pairs = rows.groupBy(F.col("o_custkey").alias("id"), F.col("l_suppkey").alias("seed")).agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("out"))
    return pairs.where("out = 0").groupBy("id").agg(F.count("*").alias("n"))


# --- sequences and k-mers ---------------------------------------------------------------


def doc_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", seqs.cleaned(F.col("text")).alias("seq")).withColumn("length", F.length("seq").cast("long"))


SEQ = "SELECT doc_id, source, lang, upper(regexp_replace(coalesce(text, ''), '[^ATGCatgc]', '', 'g')) AS seq FROM documents"
KMER = f"SELECT doc_id, source, seq[i:i + 3] AS kmer FROM (SELECT *, unnest(range(1, length(seq) - 2)) AS i FROM ({SEQ}))"


@query(f"SELECT doc_id, md5(seq) AS seq_md5, length(seq) AS length FROM ({SEQ}) WHERE length(seq) >= 100")
def seq_clean_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_sequences(spark, sf_dir).where("length >= 100").select("doc_id", F.md5("seq").alias("seq_md5"), "length")


@query(f"SELECT doc_id, md5(translate(reverse(seq), 'ATGC', 'TACG')) AS rc_md5 FROM ({SEQ})")
def revcomp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_sequences(spark, sf_dir).select("doc_id", F.md5(seqs.reverse_complement(F.col("seq"))).alias("rc_md5"))


@query(f"SELECT source, kmer, count(*) AS n FROM ({KMER}) GROUP BY source, kmer")
def kmer_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naive_bayes.kmer_counts(doc_sequences(spark, sf_dir), "source")


GRID = "SELECT a || b || c || d AS kmer FROM (SELECT unnest(['A','C','G','T']) AS a), (SELECT unnest(['A','C','G','T']) AS b), (SELECT unnest(['A','C','G','T']) AS c), (SELECT unnest(['A','C','G','T']) AS d)"
PROB = f"""k AS ({KMER}), n AS (SELECT source, kmer, count(*) AS n FROM k GROUP BY ALL), t AS (SELECT source, sum(n) AS t FROM n GROUP BY source),
p AS (SELECT t.source, g.kmer, log10(coalesce(n.n, 1) / t.t) AS logp FROM t CROSS JOIN ({GRID}) g LEFT JOIN n ON n.source = t.source AND n.kmer = g.kmer)"""


@query(f"WITH {PROB} SELECT source, kmer, round(logp, 6) AS logp FROM p")
def kmer_group_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(naive_bayes.log_probabilities(kmer_count(spark, sf_dir), "source"), "logp")


SCORE = f"""WITH {PROB}, f AS (SELECT doc_id, kmer, count(*) AS n FROM k GROUP BY ALL), l AS (SELECT doc_id, length(seq) AS length FROM ({SEQ})),
s AS (SELECT f.doc_id AS id, p.source AS seed, sum(f.n * p.logp) * 500 / any_value(l.length) AS score FROM f JOIN p ON f.kmer = p.kmer JOIN l ON l.doc_id = f.doc_id GROUP BY f.doc_id, p.source)"""


def doc_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = doc_sequences(spark, sf_dir)
    logs = naive_bayes.log_probabilities(naive_bayes.kmer_counts(docs, "source"), "source").withColumnRenamed("source", "seed")
    return naive_bayes.scores_of_all(docs.select(F.col("doc_id").alias("id"), "seq"), logs)


@query(f"{SCORE} SELECT id, seed, round(score, 5) AS score FROM s")
def nb_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(doc_scores(spark, sf_dir), "score", digits=5)


@query(f"{SCORE} SELECT id, seed FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 8) DESC, seed) AS r FROM s) WHERE r = 1")
def nb_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naive_bayes.best(rounded(doc_scores(spark, sf_dir), "score", digits=8)).select("id", "seed")


@query(f"{SCORE} SELECT id, count(*) FILTER (round(score, 8) > best - 7) > 1 AS ambiguous FROM (SELECT *, max(round(score, 8)) OVER (PARTITION BY id) AS best FROM s) GROUP BY id")
def nb_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naive_bayes.best_with_margin(rounded(doc_scores(spark, sf_dir), "score", digits=8)).select("id", "ambiguous")


@query(f"""
WITH d AS (SELECT doc_id, seq || translate(reverse(seq), 'ATGC', 'TACG') AS s FROM ({SEQ}) WHERE length(seq) >= 4),
n4 AS (SELECT doc_id, k, count(*) AS n FROM (SELECT doc_id, s[i:i + 3] AS k FROM (SELECT *, unnest(range(1, length(s) - 2)) AS i FROM d)) GROUP BY ALL),
n3 AS (SELECT doc_id, k, count(*) AS n FROM (SELECT doc_id, s[i:i + 2] AS k FROM (SELECT *, unnest(range(1, length(s) - 1)) AS i FROM d)) GROUP BY ALL),
n2 AS (SELECT doc_id, k, count(*) AS n FROM (SELECT doc_id, s[i:i + 1] AS k FROM (SELECT *, unnest(range(1, length(s))) AS i FROM d)) GROUP BY ALL),
g AS (SELECT d.doc_id, g.kmer, 1 + coalesce(n4.n, 0) AS w, 1 + coalesce(a.n, 0) AS abc, 1 + coalesce(b.n, 0) AS bcd, 1 + coalesce(m.n, 0) AS bc
  FROM d CROSS JOIN ({GRID}) g LEFT JOIN n4 ON n4.doc_id = d.doc_id AND n4.k = g.kmer LEFT JOIN n3 a ON a.doc_id = d.doc_id AND a.k = g.kmer[1:3]
  LEFT JOIN n3 b ON b.doc_id = d.doc_id AND b.k = g.kmer[2:4] LEFT JOIN n2 m ON m.doc_id = d.doc_id AND m.k = g.kmer[2:3]),
z AS (SELECT doc_id, kmer, CASE WHEN (bc - abc) * (bc - bcd) > 0 THEN sqrt(bc) * (w * bc - abc * bcd) / sqrt((bc - abc)::DOUBLE * (bc - bcd) * abc * bcd) ELSE 0.0 END AS z FROM g)
SELECT doc_id, kmer, round(z, 5) + 0.0 AS z FROM z""")
def kmer_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillbin.functions.sequences import FOURMERS, zscores

    score = F.pandas_udf(lambda s: s.map(zscores), "array<double>")
    rows = doc_sequences(spark, sf_dir).where("length >= 4").select("doc_id", F.posexplode(score("seq")).alias("i", "z"))
    return rows.select("doc_id", F.element_at(F.array(*map(F.lit, FOURMERS)), F.col("i") + 1).alias("kmer"), (F.round("z", 5) + 0.0).alias("z"))


# --- vectors ------------------------------------------------------------------------------

VEC = """v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE - m) AS e FROM (SELECT vec_id, embedding, list_avg(list_transform(embedding, lambda x: x::DOUBLE)) AS m FROM embeddings)),
c AS (SELECT vec_id, e, list_dot_product(e, e) AS ss FROM v)"""


def centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    rows = rows.withColumn("m", st.mean(F.col("x"))).select("vec_id", F.expr("transform(x, y -> y - m)").alias("e"))
    return rows.withColumn("ss", seqs.dot(F.col("e"), F.col("e")))


@query(f"WITH {VEC} SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.e, b.e) / sqrt(a.ss * b.ss), 6) AS cor FROM c a JOIN c b ON b.vec_id = a.vec_id + 1")
def pearson_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = centred(spark, sf_dir)
    x, y = rows.select(F.col("vec_id").alias("a"), F.col("e").alias("ea"), F.col("ss").alias("sa")), rows.select(F.col("vec_id").alias("b"), F.col("e").alias("eb"), F.col("ss").alias("sb"))
    both = x.join(y, F.col("b") == F.col("a") + 1)
    return rounded(both.select("a", "b", seqs.correlation(F.col("ea"), F.col("eb"), F.col("sa"), F.col("sb")).alias("cor")), "cor")


#: Blocks of rows that are compared two at a time, and rows that a task multiplies at once.
BLOCKS, ROWS = 48, 2_048


def block_rows(total: int) -> int:
    """Rows of a block: a ``BLOCKS``-th of all, from 2,048 to 131,072."""
    return min(max(-(-total // BLOCKS), 2_048), 131_072)


def neighbors(rows: DataFrame, least: float, block: int | None = None) -> DataFrame:
    """``rows(vec_id, e, ss)``, centred, to ``(a, b, cor)`` of all pairs a < b that correlate by ``least`` or more: blocks of rows against blocks, two in a task.

    With blocks of ``block_rows`` each row is sent to ``BLOCKS`` tasks at most, so what is shuffled
    grows with the rows, up to 6 million.
    """
    total = rows.count()
    n = max(-(-total // (block or block_rows(total))), 1)
    own = rows.where("ss > 0").withColumn("i", F.pmod(F.xxhash64("vec_id"), F.lit(n)))
    dealt = own.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("j")).select("vec_id", "e", "ss", "i", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"))

    def compare(p: pd.DataFrame) -> pd.DataFrame:
        x, y = p[p["i"] == p["lo"]], p[p["i"] == p["hi"]]
        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "b": [], "cor": []})
        ex, ey, sx, sy, ix, iy = np.stack(x["e"]), np.stack(y["e"]), x["ss"].to_numpy(), y["ss"].to_numpy(), x["vec_id"].to_numpy(), y["vec_id"].to_numpy()
        same, found = p["lo"].iloc[0] == p["hi"].iloc[0], []
        for u in range(0, len(ex), ROWS):
            for v in range(0, len(ey), ROWS):
                cor = ex[u : u + ROWS] @ ey[v : v + ROWS].T / np.sqrt(np.outer(sx[u : u + ROWS], sy[v : v + ROWS]))
                k, m = np.nonzero(np.round(cor, 6) >= least)
                a, b = ix[u + k], iy[v + m]
                keep = a < b if same else a != b
                found.append(pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "cor": cor[k, m][keep]}))
        return pd.concat(found)

    return dealt.groupBy("lo", "hi").applyInPandas(compare, "a long, b long, cor double")


@query(f"WITH {VEC} SELECT * FROM (SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.e, b.e) / sqrt(a.ss * b.ss), 6) AS cor FROM c a JOIN c b ON a.vec_id < b.vec_id WHERE a.ss > 0 AND b.ss > 0) WHERE cor >= 0.5")
def corr_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(neighbors(centred(spark, sf_dir), 0.5), "cor")


@query(f"""
WITH RECURSIVE {VEC},
n AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, e, ss FROM c),
walk AS (
  SELECT CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS chosen
  UNION ALL
  SELECT w.r + 1, CASE WHEN EXISTS (SELECT 1 FROM n s WHERE list_contains(w.chosen, s.r) AND list_dot_product(n.e, s.e) / sqrt(n.ss * s.ss) >= 0.25) THEN w.chosen ELSE list_append(w.chosen, n.r) END
  FROM walk w JOIN n ON n.r = w.r + 1)
SELECT vec_id FROM n WHERE list_contains((SELECT chosen FROM walk ORDER BY r DESC LIMIT 1), n.r)""")
def leader_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = centred(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("vec_id").alias("rank"), F.col("e").alias("vec"), F.lit(10).alias("bucket"))
    return seeds.leaders_by_vector(nodes, seeds.Alike(0.25)).select(F.col("id").alias("vec_id"))


# --- coverage -----------------------------------------------------------------------------

FENCE = """q AS (SELECT user_id, x, list_sort(x) AS s, len(x) AS n FROM (SELECT user_id, list(value ORDER BY event_id) AS x FROM events GROUP BY user_id)),
f AS (SELECT *, CASE WHEN n * 1 % 4 = 3 THEN s[(n + 1) // 4] ELSE ((n + 1) % 4 / 4.0) * (CASE WHEN (n + 1) // 4 < 1 THEN s[n] ELSE s[(n + 1) // 4] END) + (1 - (n + 1) % 4 / 4.0) * s[least((n + 1) // 4 + 1, n)] END AS q1,
  CASE WHEN 3 * (n + 1) % 4 = 0 THEN s[3 * (n + 1) // 4] ELSE (3 * (n + 1) % 4 / 4.0) * s[least(3 * (n + 1) // 4, n)] + (1 - 3 * (n + 1) % 4 / 4.0) * s[least(3 * (n + 1) // 4 + 1, n)] END AS q3 FROM q)"""


@query(f"WITH {FENCE} SELECT user_id, round(q1 - 1.5 * (q3 - q1), 6) AS low, round(q3 + 1.5 * (q3 - q1), 6) AS high, len(list_filter(x, lambda y: y >= q1 - 1.5 * (q3 - q1) AND y <= q3 + 1.5 * (q3 - q1))) AS kept FROM f")
def tukey_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(coverage.trimmed_deviation(table(spark, sf_dir, "events"), "user_id", "value").select("user_id", "low", "high", "kept"), "low", "high")


@query(f"""WITH {FENCE}, g AS (SELECT user_id, n, list_avg(x) AS m, list_filter(x, lambda y: y >= q1 - 1.5 * (q3 - q1) AND y <= q3 + 1.5 * (q3 - q1)) AS k FROM f)
SELECT user_id, CASE WHEN n < 10 THEN NULL WHEN m <= 1 THEN 0.0 ELSE round(sqrt(list_sum(list_transform(k, lambda y: (y - m) * (y - m))) / nullif(len(k) - 1, 0)) / m, 6) END AS ratio FROM g""")
def trimmed_sd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(coverage.trimmed_deviation(table(spark, sf_dir, "events"), "user_id", "value").select("user_id", "ratio"), "ratio")


@query("""
WITH r AS (SELECT s_nationkey AS sample, s_acctbal / 20000.0 AS ratio FROM supplier WHERE s_acctbal > 20 AND s_acctbal / 20000.0 < 0.38),
o AS (SELECT sample, list_sort(list(ratio)) AS x, count(*) AS n FROM r GROUP BY sample)
SELECT sample, round((x[(n + 1) // 2] + x[n // 2 + 1]) / 2, 4) AS middle, round(x[greatest(3 * n // 4, 1)], 4) AS upper FROM o""")
def sd_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = F.col("s_acctbal") / 20000.0
    rows = table(spark, sf_dir, "supplier").where("s_acctbal > 20").select(F.col("s_nationkey").alias("sample"), ratio.alias("ratio")).where("ratio < 0.38")
    return rounded(coverage.quarters(rows), "middle", "upper", digits=4)


@query("""
WITH e AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events),
s AS (SELECT DISTINCT event_type, n, unnest(range(1, n - 98, 50)) AS p FROM e)
SELECT s.event_type, CAST((p - 1) // 50 AS BIGINT) AS w, round(avg(value), 6) AS depth FROM s JOIN e ON e.event_type = s.event_type AND e.i BETWEEN p AND p + 99 GROUP BY s.event_type, p""")
def sliding_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = coverage.numbered(table(spark, sf_dir, "events").select("event_type", "event_id", "value"), "event_id", ["event_type"])
    return rounded(coverage.window_sums(rows, "event_type", "value", 100, 50), "depth")


@query("""
WITH e AS (SELECT l_suppkey AS id, l_quantity::DOUBLE AS q, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem),
t AS (SELECT id, q, i - 5 AS i, n - 10 AS n FROM e WHERE n >= 11 AND i > 5 AND i <= n - 5)
SELECT id, round(avg(q), 2) AS mean, CASE WHEN any_value(n) < 500 THEN 1 ELSE (any_value(n) - 500) // 250 + 1 END AS windows, CASE WHEN any_value(n) < 500 THEN round(avg(q), 2) ELSE round(avg(q) FILTER (i <= 500), 2) END AS first_window FROM t GROUP BY id""")
def window_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities of a supplier as depths of a sequence, five places off both ends."""
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["l_quantity"].cast("double")).alias("depths"))
    out = coverage.window_means(rows.select("id", F.lit(1).alias("sample"), "depths", F.lit(5).alias("read_length")))
    return out.select("id", "mean", F.size("windows").cast("long").alias("windows"), F.col("windows")[0].alias("first_window"))


INTERVAL = "i AS (SELECT l_suppkey AS seed, sum(l_quantity) / count(*) AS mean FROM lineitem GROUP BY l_suppkey)"


def supplier_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("seed")).agg((F.sum("l_quantity") / F.count("*")).alias("mean"))


@query(f"WITH {INTERVAL} SELECT seed, CAST(trunc(mean * (1 - 0.11 * 2.58)) AS BIGINT) AS lo, CAST(trunc(mean * (1 + 0.11 * 2.58)) AS BIGINT) + 1 AS hi, CAST(trunc(mean * (1 - 0.1)) AS BIGINT) AS small_lo, CAST(trunc(mean * (1 + 0.1)) AS BIGINT) + 1 AS small_hi FROM i")
def cov_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo, hi = coverage.large_interval(F.col("mean"), F.lit(0.11), F.lit(0.1), F.lit(0.2))
    small_lo, small_hi = coverage.small_interval(F.col("mean"), F.lit(0.1))
    return supplier_means(spark, sf_dir).select("seed", lo.alias("lo"), hi.alias("hi"), small_lo.alias("small_lo"), small_hi.alias("small_hi"))


def part_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two samples: size, and price in hundreds."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.explode(F.array(F.struct(F.lit(1).alias("sample"), F.col("p_size").cast("double").alias("mean")), F.struct(F.lit(2).alias("sample"), (F.col("p_retailprice") / 100).alias("mean")))).alias("s"))
    return part.select("id", "s.*")


def part_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' intervals about their key's place in both samples; some are below the least mean."""
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("seed"))
    m1, m2 = (F.col("seed") % 50).cast("double"), (F.col("seed") % 19 + 2).cast("double")
    rows = own.select("seed", F.explode(F.array(F.struct(F.lit(1).alias("sample"), m1.alias("mean")), F.struct(F.lit(2).alias("sample"), m2.alias("mean")))).alias("s")).select("seed", "s.*")
    return rows.withColumn("lo", st.toward_zero(F.col("mean") * 0.8)).withColumn("hi", st.toward_zero(F.col("mean") * 1.2) + 1)


RANGE = """s AS (SELECT s_suppkey AS seed, s_suppkey % 50 AS m1, s_suppkey % 19 + 2 AS m2 FROM supplier),
p AS (SELECT p_partkey AS id, p_size AS x1, p_retailprice / 100 AS x2 FROM part)"""


@query(f"WITH {RANGE} SELECT id, seed FROM p, s WHERE (m1 < 5 OR x1 BETWEEN trunc(m1 * 0.8) AND trunc(m1 * 1.2) + 1) AND (m2 < 5 OR x2 BETWEEN trunc(m2 * 0.8) AND trunc(m2 * 1.2) + 1)")
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.within(part_depths(spark, sf_dir), part_seeds(spark, sf_dir), 2)


@query(f"""WITH {RANGE}, h AS (SELECT id, CAST(seed AS VARCHAR) AS seed FROM p, s WHERE m1 >= 5 AND x1 >= trunc(m1 * 0.8) AND x1 < trunc(m1 * 1.2) + 1)
SELECT * FROM h UNION ALL SELECT id, 'first' FROM p ANTI JOIN h USING (id)""")
def interval_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = part_seeds(spark, sf_dir).where("sample = 1 and mean >= 5").withColumn("seed", F.col("seed").cast("string"))
    return coverage.within_or_first(part_depths(spark, sf_dir).where("sample = 1"), seeds, 1, "first")


@query("""
WITH i AS (SELECT p_brand AS seed, CASE WHEN p_type < 'N' THEN 1 ELSE 2 END AS sample, min(p_partkey) // 7 AS lo, min(p_partkey) // 7 + 1 AS hi FROM part GROUP BY ALL),
fl AS (SELECT i.*, CASE WHEN lo = min(lo) OVER (PARTITION BY sample) THEN least(lo, 0) ELSE lo END AS lo2 FROM i),
r AS (SELECT DISTINCT sample, lo2 AS lo, hi FROM fl),
g AS (SELECT DISTINCT sample, reach AS a, lo AS b FROM (SELECT *, max(hi) OVER (PARTITION BY sample ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r) WHERE reach < lo)
SELECT seed, fl.sample, CAST(coalesce(d.a, lo2) AS BIGINT) AS lo, CAST(coalesce(u.b, hi) AS BIGINT) AS hi FROM fl LEFT JOIN g d ON d.sample = fl.sample AND d.b = lo2 LEFT JOIN g u ON u.sample = fl.sample AND u.a = hi""")
def gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("seed"), F.when(F.col("p_type") < "N", 1).otherwise(2).alias("sample"), "p_partkey")
    lo = F.floor(F.min("p_partkey") / 7)
    intervals = part.groupBy("seed", "sample").agg(lo.alias("lo"), (lo + 1).alias("hi"))
    return coverage.gaps_filled(intervals, part.select("sample", F.lit(0.5).alias("mean")))


@query("SELECT l_suppkey AS seed, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 2) AS mean, CAST(trunc(min(l_extendedprice)) AS BIGINT) AS lo, CAST(trunc(max(l_extendedprice)) AS BIGINT) + 1 AS hi FROM lineitem GROUP BY l_suppkey")
def member_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("seed"), F.lit(1).alias("sample"), F.col("l_extendedprice").alias("mean"), F.col("l_quantity").alias("length"))
    return coverage.member_interval(rows).drop("sample")


@query("""
WITH v AS (SELECT l_suppkey AS seed, CAST(l_quantity AS DOUBLE) AS x, l_extendedprice AS w FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' UNION ALL SELECT 100000 + l_orderkey, CAST(l_quantity AS DOUBLE), l_extendedprice FROM lineitem),
q AS (SELECT seed, list_sort(list(x)) AS s, count(*) AS n FROM v GROUP BY seed),
f AS (SELECT *, (n + 1) % 4 / 4.0 AS d1, 3 * (n + 1) % 4 / 4.0 AS d3, (n + 1) // 4 AS b1, 3 * (n + 1) // 4 AS b3 FROM q),
g AS (SELECT seed, s, n, CASE WHEN d1 = 0 THEN s[b1] ELSE d1 * (CASE WHEN b1 < 1 THEN s[n] ELSE s[b1] END) + (1 - d1) * s[least(b1 + 1, n)] END AS q1,
  CASE WHEN d3 = 0 THEN s[least(b3, n)] ELSE d3 * (CASE WHEN b3 < 1 THEN s[n] ELSE s[least(b3, n)] END) + (1 - d3) * s[least(b3 + 1, n)] END AS q3 FROM f),
k AS (SELECT g.seed, n, x, w FROM g JOIN v ON v.seed = g.seed WHERE x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)),
m AS (SELECT seed, any_value(n) AS n, round(sum(x * w) / sum(w), 2) AS mean, min(x) AS lo, max(x) AS hi, count(*) AS c FROM k GROUP BY seed),
d AS (SELECT m.seed, any_value(m.n) AS n, any_value(mean) AS mean, any_value(lo) AS lo, any_value(hi) AS hi, CASE WHEN any_value(c) > 1 THEN coalesce(sqrt(sum((x - mean) * (x - mean)) / nullif(any_value(c) - 1, 0)) / any_value(mean), 0.1) ELSE 0.1 END AS own FROM m JOIN k ON k.seed = m.seed GROUP BY m.seed),
e AS (SELECT *, CASE WHEN n < 20 THEN greatest(own, 0.1) ELSE own END AS sd, least(greatest(own, 0.1), 0.2) AS near FROM d)
SELECT seed, mean, CAST(CASE WHEN mean < 5 THEN 0 ELSE trunc((CASE WHEN n < 20 THEN least(lo, trunc(mean * (1 - near * 2.58))) ELSE lo END) * (1 - sd)) END AS BIGINT) AS lo,
  CAST(CASE WHEN mean < 5 THEN 0 ELSE trunc((CASE WHEN n < 20 THEN greatest(hi, trunc(mean * (1 + near * 2.58)) + 1) ELSE hi END) * (1 + sd)) + 1 END AS BIGINT) AS hi FROM e""")
def marker_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of many members (suppliers) and of few (orders)."""
    line = table(spark, sf_dir, "lineitem")
    x = [F.lit(1).alias("sample"), F.col("l_quantity").cast("double").alias("mean"), F.col("l_extendedprice").alias("length")]  # no mean lies halfway between two decimals
    members = line.where("l_returnflag = 'R' and l_linestatus = 'F'").select(F.col("l_suppkey").cast("long").alias("seed"), *x).unionByName(line.select((F.col("l_orderkey") + 100_000).cast("long").alias("seed"), *x))
    return coverage.marker_interval(members, spark.createDataFrame([(1, 0.1, 0.2)], "sample int, sd1 double, sd2 double")).drop("sample")


@query("""
WITH e AS (SELECT user_id, value, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 5 AS piece FROM events)
SELECT user_id, CAST(piece AS BIGINT) AS piece, round(avg(value), 6) AS mean FROM e GROUP BY user_id, piece""")
def piece_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of five values of each user, the last one shorter."""
    rows = coverage.numbered(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "event_id", ["user_id"])
    return rounded(rows.groupBy("user_id", F.floor((F.col("n") - 1) / 5).alias("piece")).agg(F.avg("value").alias("mean")), "mean")


@query("""
WITH d AS (SELECT doc_id, upper(regexp_replace(text, '[^ATGCatgc]', '', 'g')) AS seq FROM documents WHERE doc_id IS NOT NULL),
p AS (SELECT doc_id, seq, unnest(range(0, length(seq), 200)) AS cut FROM d WHERE seq <> ''), c AS (SELECT doc_id, seq, cut // 200 AS piece, substr(seq, cut + 1, 200) AS part FROM p),
f AS (SELECT doc_id, piece, length(part) AS n, strpos(seq, part) AS place FROM c)
SELECT doc_id, piece, CAST(place AS BIGINT) AS place, round(list_avg(list_transform(range(place, place + n), lambda x: (x * 37 + doc_id) % 61)), 6) AS mean FROM f""")
def piece_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 200 letters of a document are a piece, which may stand in it before; depths are a rule of the place."""
    docs = table(spark, sf_dir, "documents").where("doc_id is not null").select(F.col("doc_id").alias("parent"), seqs.cleaned(F.col("text")).alias("seq")).where("seq <> ''")
    seeds.shared_folder(spark)
    docs = docs.repartition("parent").checkpoint()  # texts are read and cleaned once, not by each step, and letters dealt out
    at = F.explode(F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / 200)))
    pieces = docs.select("parent", "seq", at.alias("id")).select("id", "parent", F.substring("seq", (F.col("id") * 200 + 1).cast("int"), F.lit(200)).alias("seq"))
    depths = F.transform(F.sequence(F.lit(1), F.length("seq")), lambda x: ((x * 37 + F.col("parent")) % 61).cast("double"))
    whole = docs.withColumn("position", F.lit(1).cast("long"))
    found = depth.piece_means(pieces, whole, whole.select("parent", "position", depths.alias("depths")))
    return rounded(found.select(F.col("parent").alias("doc_id"), F.col("id").alias("piece"), "place", "mean"), "mean")


@query("""
WITH a AS (SELECT event_id, value, row_number() OVER (ORDER BY event_id) AS n FROM events WHERE event_type = 'click'), b AS (SELECT value AS other, row_number() OVER (ORDER BY event_id) AS n FROM events WHERE event_type = 'view')
SELECT n, event_id, value, other FROM a JOIN b USING (n)""")
def zip_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    left = coverage.numbered(events.where("event_type = 'click'").select("event_id", "value"), "event_id")
    right = coverage.numbered(events.where("event_type = 'view'").select("event_id", F.col("value").alias("other")), "event_id")
    return coverage.pooled(left, right, ["event_id"]).select("n", "event_id", "value", "other")


# --- markers ------------------------------------------------------------------------------


@query("""
WITH m AS (SELECT DISTINCT l_partkey AS gene, l_orderkey AS id FROM lineitem)
SELECT a.id AS a, b.id AS b, count(*) AS genes FROM m a JOIN m b ON a.gene = b.gene AND a.id < b.id GROUP BY ALL HAVING count(*) >= 2""")
def duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markers.duplicates(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("gene"), F.col("l_orderkey").alias("id")).distinct())


COPIES = "c AS (SELECT n.n_name AS seed, o.o_orderpriority || '/' || month(o.o_orderdate) AS gene, count(DISTINCT c.c_custkey) AS copies FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY ALL)"


def nation_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.concat_ws("/", "o_orderpriority", F.month("o_orderdate").cast("string")).alias("gene"), F.col("o_custkey").alias("id")).distinct()
    who = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("id"), F.col("n_name").alias("seed"))
    return markers.copies(orders, who)


@query(f"WITH {COPIES} SELECT seed, copies, count(*) AS genes FROM c GROUP BY seed, copies")
def copy_number_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nation_copies(spark, sf_dir).groupBy("seed", "copies").agg(F.count("*").alias("genes"))


@query(f"WITH {COPIES}, h AS (SELECT seed, copies, count(*) AS genes FROM c GROUP BY seed, copies) SELECT seed, coalesce(max(copies) FILTER (genes > 7), 0) AS species FROM h GROUP BY seed")
def species_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markers.species_number(nation_copies(spark, sf_dir), 7)


@query(f"""WITH {COPIES}, n AS (SELECT a.seed AS a, b.seed AS b FROM (SELECT DISTINCT seed FROM c) a, (SELECT DISTINCT seed FROM c) b WHERE a.seed < b.seed),
g AS (SELECT a, b, gene, sum(copies) AS k, count(*) AS m FROM n JOIN c ON c.seed = a OR c.seed = b GROUP BY a, b, gene)
SELECT a, b, count(*) FILTER (m = 2) AS "both", count(*) FILTER (k > 1) AS twice FROM g GROUP BY a, b HAVING count(*) FILTER (m = 2) > 0""")
def dup_gene_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markers.shared_genes(nation_copies(spark, sf_dir))


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query(
    "SELECT n_name AS gene, "
    + ", ".join(f"coalesce(string_agg(c_custkey || '(' || CAST(trunc(c_acctbal) AS BIGINT) || ')', ';' ORDER BY -c_acctbal, c_custkey) FILTER (c_mktsegment = '{s}'), 'NA') AS {s}" for s in SEGMENTS)
    + " FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name"
)
def marker_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    cell = F.concat(F.col("c_custkey").cast("string"), F.lit("("), st.toward_zero(F.col("c_acctbal")).cast("string"), F.lit(")"))
    cells = rows.select(F.col("n_name").alias("gene"), F.col("c_mktsegment").alias("seed"), F.struct((-F.col("c_acctbal")).alias("d"), "c_custkey").alias("place"), cell.alias("cell"))
    return markers.pivot(cells, [*SEGMENTS])


# --- packing ---------------------------------------------------------------------------------


def packing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    words = F.size(F.regexp_extract_all("text", F.lit(r"(\S+)"), 1))
    score = F.round(F.try_divide(words * 1000.0, F.length("text")), 1)
    means = F.array((F.length("text") % 100).cast("double"))
    return docs.select(F.col("source").alias("seed"), F.col("doc_id").cast("string").alias("id"), F.length("text").alias("length"), score.alias("score"), means.alias("means"), F.array(F.lit(0.4)).alias("sds"))


@query()
def cluster_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source with alike numbers of words and lengths, until 10,000 letters are together."""
    return seeds.packed(packing_rows(spark, sf_dir)).select("seed", "lead", F.array_join("members", ";").alias("members"), "length")


# --- merging ------------------------------------------------------------------------------


def cluster_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as clusters: in three samples, the flags of their lines, the mean quantity and an interval about it."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("seed"), F.ascii("l_returnflag").alias("sample"), F.col("l_quantity").cast("double").alias("q"))
    mean = line.groupBy("seed", "sample").agg(F.round(F.avg("q"), 6).alias("mean"))
    whole = mean.join(mean.groupBy("seed").agg(F.count("*").alias("k")).where("k = 3").select("seed"), "seed", "left_semi")
    return whole.select("seed", "sample", "mean", F.round(F.col("mean") * 0.985, 6).alias("lo"), F.round(F.col("mean") * 1.015, 6).alias("hi"))


def month_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(seed, e)``: the part of a supplier's lines in each month, less a twelfth."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("seed"), F.month("l_shipdate").alias("month"))
    part = lambda m: F.round(F.count(F.when(F.col("month") == m, 1)) / F.count("*") - 1 / 12, 9)
    return line.groupBy("seed").agg(F.array(*map(part, range(1, 13))).alias("e"))


def merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose intervals meet and whose vectors correlate by a half or more, rounded."""
    vectors = month_vectors(spark, sf_dir).select("seed", F.col("e").alias("vec"), seqs.dot(F.col("e"), F.col("e")).alias("ss"))
    pairs = merging.meeting(cluster_rows(spark, sf_dir), vectors, 0.499)
    return pairs.select("a", "b", "ra", "inside", F.round("cor", 9).alias("p"), F.round("distance", 9).alias("distance")).where("p >= 0.5")


@query()
def merge_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One round of merges: which suppliers go to which, by coverage and likeness; a test has the sequential pass."""
    seeds.shared_folder(spark)
    return merging.matched(merge_candidates(spark, sf_dir))


@query("""
WITH m AS (SELECT CAST(l_suppkey AS VARCHAR) AS seed, ascii(l_returnflag) AS sample, round(avg(CAST(l_quantity AS DOUBLE)), 6) AS mean FROM lineitem GROUP BY ALL),
i AS (SELECT seed, sample, mean, round(mean * 0.985, 6) AS lo, round(mean * 1.015, 6) AS hi FROM m WHERE seed IN (SELECT seed FROM m GROUP BY seed HAVING count(*) = 3)),
r AS (SELECT seed, arg_max(mean, -sample) AS top FROM i GROUP BY seed)
SELECT a, b, inside, round(distance, 6) AS distance FROM (
  SELECT x.seed AS a, y.seed AS b, bool_and(x.mean < 5 OR (y.mean >= x.lo AND y.mean <= x.hi)) AS inside, sum((x.mean - y.mean) * (x.mean - y.mean)) AS distance,
    bool_and(x.mean < 5 OR (y.mean >= x.lo AND y.mean <= x.hi) OR (y.lo < x.hi AND y.hi > x.lo)) AS fits
  FROM i x JOIN i y USING (sample) JOIN r ra ON ra.seed = x.seed JOIN r rb ON rb.seed = y.seed
  WHERE ra.top > rb.top OR (ra.top = rb.top AND x.seed < y.seed) GROUP BY ALL) WHERE fits""")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of suppliers whose intervals meet in all samples."""
    return rounded(merging.meeting(cluster_rows(spark, sf_dir)), "distance").select("a", "b", "inside", "distance")
