"""The registered queries of this subpackage, one for each operator over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cap_filters, decontamination, jaccard, language_model, packing, pii, repeats, toxicity, url_reputation, warc_zip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity_bigru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scored(table(spark, sf_dir, "documents"))


def op4_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.near_groups(table(spark, sf_dir, "embeddings"))


def op5_benchmark_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_repeat_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents"))


def op7_jaccard_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.round_trip(table(spark, sf_dir, "pages"))


def op10_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a page's outcome is the label of the document with its id: bad if toxic or of low quality
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int").alias("outcome"))
    return url_reputation.url_filter(table(spark, sf_dir, "pages"), labels).select("page_id", "host", "path", "rule", "verdict")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


#: Words as the contracts have them; {text} is the text.
_WORDS = r"list_filter(regexp_split_to_array(coalesce({text}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = f"translate(text, '{url_reputation.UPPER}', '{url_reputation.LOWER}')"
#: From links (a, b) to the least node that each can reach.
_REACH = """
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(node, other) AS (SELECT a, a FROM ways UNION SELECT r.node, b.b FROM reach r JOIN ways b ON b.a = r.other),
least AS (SELECT node, min(other) AS component FROM reach GROUP BY 1)
"""

SQL4 = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(embedding) > 0),
ok AS (SELECT vec_id, e FROM v WHERE list_bool_and(list_transform(e, lambda x: x IS NOT NULL AND isfinite(x))) AND list_dot_product(e, e) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id < b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
{_REACH},
n AS (SELECT a AS vec_id, count(*) AS n FROM ways GROUP BY 1)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(component, e.vec_id) AS component_id, e.vec_id = coalesce(component, e.vec_id) AS kept
FROM embeddings e LEFT JOIN n USING (vec_id) LEFT JOIN least ON node = e.vec_id
"""

SQL6 = f"""
WITH w AS (SELECT doc_id, {_WORDS.format(text="text")} AS w FROM documents),
win AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM w WHERE len(w) >= 50)),
first AS (SELECT k, min(doc_id) AS m FROM win GROUP BY 1),
cut AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p FROM win JOIN first USING (k) WHERE m < doc_id),
place AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM place ANTI JOIN cut USING (doc_id, p) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

SQL7 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text=_LOWER)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
                                          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
{_REACH}
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(component, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least ON node = d.doc_id
"""

SQL9 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
FROM m
"""

_RULE_CASE = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{}}'".format(x)
    for v, h, p in sorted(url_reputation.RULES, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))
    for x in [h + p]
)
_VERDICT_CASE = " ".join(f"WHEN '{h + p}' THEN '{v}'" for v, h, p in url_reputation.RULES)
_LIST = lambda xs: ", ".join(f"'{x}'" for x in xs)
_TWO = f"(regexp_matches(one, '^[a-z]{{2}}$') AND len(labels) > 1 AND labels[-2] IN ({_LIST(url_reputation.SECOND_LABELS)}) OR two IN ({_LIST(url_reputation.OPEN_DOMAINS)}))"
_ADDRESS = r"regexp_matches(bare, '^[0-9]+(\.[0-9]+){3}$') OR starts_with(bare, '[')"


def _strength_sql(p: str) -> str:
    mean = f"({p}bad / greatest({p}n, 1))"
    between = f"(({p}rr - {p}n * {mean} * {mean}) - ({p}k - 1) * ({mean} * (1 - {mean}))) / greatest({p}n - {p}nn / greatest({p}n, 1), 1)"
    return f"greatest({url_reputation.LEAST_STRENGTH}, least({url_reputation.MOST_STRENGTH}, CASE WHEN {between} > 1e-9 THEN {mean} * (1 - {mean}) / ({between}) - 1 ELSE {url_reputation.MOST_STRENGTH} END))"


def _level_sql(p: str, n: str, bad: str) -> str:
    return f"sum({n}) AS {p}n, sum({bad}) AS {p}bad, sum({n} * {n}) AS {p}nn, coalesce(sum(CASE WHEN {n} > 0 THEN {bad} * {bad} / {n} END), 0) AS {p}rr, count(CASE WHEN {n} > 0 THEN 1 END) AS {p}k"


SQL10 = f"""
WITH places AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{url_reputation.UPPER}', '{url_reputation.LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
known AS (SELECT doc_id AS page_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS outcome FROM labels GROUP BY 1),
h AS (SELECT host, CAST(count(outcome) AS DOUBLE) AS n, CAST(coalesce(sum(outcome), 0) AS DOUBLE) AS bad FROM places LEFT JOIN known USING (page_id) GROUP BY 1),
hb AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS bare FROM h), hl AS (SELECT *, string_split(bare, '.') AS labels FROM hb),
hs AS (SELECT *, array_to_string(list_slice(labels, -2, -1), '.') AS two, array_to_string(list_slice(labels, -3, -1), '.') AS three, list_extract(labels, -1) AS one FROM hl),
hosts AS (SELECT host, n, bad, CASE WHEN {_ADDRESS} THEN bare WHEN {_TWO} THEN three ELSE two END AS domain, CASE WHEN {_ADDRESS} THEN 'address' WHEN {_TWO} THEN two ELSE one END AS suffix FROM hs),
domains AS (SELECT suffix, domain, {_level_sql("d", "n", "bad")} FROM hosts GROUP BY 1, 2),
suffixes AS (SELECT suffix, {_level_sql("s", "dn", "dbad")} FROM domains GROUP BY 1),
world AS (SELECT {_level_sql("w", "sn", "sbad")} FROM suffixes),
w AS (SELECT (wbad + 0.5) / (wn + 1) AS wmean, {_strength_sql("w")} AS ws FROM world),
s AS (SELECT suffix, (sbad + wmean * ws) / (sn + ws) AS smean, {_strength_sql("s")} AS ss FROM suffixes, w),
d AS (SELECT suffix, domain, (dbad + smean * ss) / (dn + ss) AS dmean, {_strength_sql("d")} AS ds FROM domains JOIN s USING (suffix)),
r AS (SELECT host, (bad + dmean * ds) / (n + ds) AS mean, n + ds AS weight FROM hosts JOIN d USING (suffix, domain)),
v AS (SELECT page_id, host, path, CASE WHEN mean - {url_reputation.Z} * sqrt(mean * (1 - mean) / (weight + 1)) >= {url_reputation.THRESHOLD} THEN 'block' ELSE 'allow' END AS own,
      CASE {_RULE_CASE} END AS rule FROM places JOIN r USING (host))
SELECT page_id, host, path, rule, CASE rule {_VERDICT_CASE} ELSE own END AS verdict FROM v
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity_bigru, op2_pii_surrogates, op3_recurrent_lm, op4_cap_filters, op5_benchmark_tiling, op6_repeat_automata, op7_jaccard_pivots, op8_best_fit_packing, op9_warc_zip, op10_url_reputation, pipeline)
}
SQL = {"op4_cap_filters": SQL4, "op6_repeat_automata": SQL6, "op7_jaccard_pivots": SQL7, "op9_warc_zip": SQL9, "op10_url_reputation": SQL10}
