"""The registered queries of this package over the supplied tables, each with its DuckDB oracle where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from larder.sources.tables import read_table
from llm.decontaminate import find_leaks
from llm.encode import encode_digests
from llm.licenses import FOLDER, KNOWN, SPELLINGS, license_scan, whole_texts
from llm.minhash import near_duplicates
from llm.mixing import mix_sources
from llm.multi_index import search
from llm.quality import CumulativeLink, grade_documents, train
from llm.reputation import Rule, Shrinkage, judge_urls, path_of
from llm.secrets import find_secrets
from llm.spelling import spelling_variants
from llm.substring import remove_repeats
from llm.token_counts import token_counts
from llm.va_clusters import cluster_vectors


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents", ["doc_id", "text"])


#: In the order of the contract; the longest that fits wins.
RULES = [
    Rule("com/", "allow"),
    Rule("example.com/en/", "block"),
    Rule("www.example.com/en/", "allow"),
    Rule("net/es/", "block"),
    Rule("net/fr/", "block"),
]


def op1_qgram_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item found in it."""
    return find_leaks(_documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


def op2_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    return search(vectors, vectors.where("vec_id % 50 = 0"), neighbours=5)


def op3_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's labels are those of the document that its url numbers."""
    pages = read_table(spark, sf_dir, "pages", ["page_id", "url"])
    labels = read_table(spark, sf_dir, "labels")
    numbered = pages.select("page_id", F.regexp_extract(path_of(F.col("url")), "/([0-9]{1,18})", 1).alias("n"))
    numbered = numbered.where("n <> ''").select("page_id", F.col("n").cast("long").alias("doc_id"))
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality") == 1, 0)
    outcomes = numbered.join(labels.select("doc_id", bad.alias("bad")), "doc_id").select("page_id", "bad")
    return judge_urls(pages, outcomes, RULES, Shrinkage(deviations=1.0, most_bad=0.25))


def quality_model(spark: SparkSession, sf_dir: str) -> CumulativeLink:
    """Grades from the labels: toxic 0, low quality 1, good 2."""
    labels = read_table(spark, sf_dir, "labels")
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return train(_documents(spark, sf_dir), labels.select("doc_id", grade.alias("grade")), levels=3)


def op4_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grade_documents(_documents(spark, sf_dir), quality_model(spark, sf_dir))


def op5_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op6_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op7_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_documents(spark, sf_dir))


def op8_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir), words=5, percent=85)


def op9_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(_documents(spark, sf_dir))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    def line(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))

    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(line(F.filter("spans", lambda s: s["kind"] != "entropy")), 256).alias("base_sha256"),
        line(F.col("spans")).alias("spans"),
    )


def op10_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(_documents(spark, sf_dir), length=50)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_bloom_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_documents(spark, sf_dir))


def op12_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents", ["doc_id", "text", "source"]))


def op13_va_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_qgram_leaks": op1_qgram_leaks,
    "op2_multi_index": op2_multi_index,
    "op3_host_reputation": op3_host_reputation,
    "op4_ordinal_quality": op4_ordinal_quality,
    "op5_trie_bpe": op5_trie_bpe,
    "op6_prefix_token_counts": op6_prefix_token_counts,
    "op7_license_digests": op7_license_digests,
    "op8_bbit_minhash": op8_bbit_minhash,
    "op9_entropy_secrets": op9_entropy_secrets,
    "op10_seed_extend": op10_seed_extend,
    "op11_bloom_variants": op11_bloom_variants,
    "op12_entropy_mix": op12_entropy_mix,
    "op13_va_clusters": op13_va_clusters,
}



def _canonical_sql(text: str) -> str:
    out = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = rf"regexp_replace({out}, '(?m)^[ \t]*(copyright[ \t]*(\(c\)|©|[0-9])|\(c\)|©)[^\n]*', '', 'g')"
    out = rf"regexp_replace({out}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')"
    for other, one in SPELLINGS:
        out = rf"regexp_replace({out}, '\b{other}\b', '{one}', 'g')"
    return f"sha256(trim({out}))"


_KNOWN_SQL = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in [*KNOWN, *whole_texts()])

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _clusters_sql(k: int, rounds: int, dims: int) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
        d{r} AS MATERIALIZED (
            SELECT row, c, sum((e.x - m.x) * (e.x - m.x)) AS d FROM e JOIN m{r} m USING (j) GROUP BY row, c),
        a{r} AS MATERIALIZED (SELECT row, arg_min(c, (d, c)) AS c, min(d) AS d FROM d{r} GROUP BY row)""")
        if r < rounds:
            steps.append(f"""
        m{r + 1} AS MATERIALIZED (
            SELECT m.c, m.j, coalesce(n.x, m.x) AS x FROM m{r} m LEFT JOIN (
                SELECT c, j, CAST(CASE WHEN sum(x) >= 0 THEN sum(x) // count(*) ELSE -((-sum(x) + count(*) - 1) // count(*)) END AS BIGINT) AS x
                FROM e JOIN a{r} USING (row) GROUP BY c, j) n USING (c, j))""")
    return f"""
        WITH v AS MATERIALIZED (
            SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
            WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
        e AS MATERIALIZED (SELECT row, unnest(x) AS x, unnest(range({dims})) AS j FROM v),
        start AS (SELECT row, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c FROM v QUALIFY c < {k}),
        m0 AS MATERIALIZED (SELECT c, j, x FROM e JOIN start USING (row)),{",".join(steps)},
        name AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY j)) AS centroid_sha256 FROM m{rounds} GROUP BY c)
        SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
            CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
        FROM a{rounds} JOIN v USING (row) JOIN name USING (c)"""


def _weight_sql(level: str) -> str:
    return f"""SELECT CAST(CASE WHEN coalesce(more, 0) = 0 THEN 20 WHEN met > odds THEN round(least(greatest(more / (met - odds) - 1, 1), 10000), 4)
            ELSE 10000 END AS DOUBLE) AS w FROM (SELECT sum(n * (b / n - p) ** 2) AS met, sum(p * (1 - p)) AS odds, sum(p * (1 - p) * (n - 1)) AS more
            FROM (SELECT CAST(n AS DOUBLE) AS n, CAST(b AS DOUBLE) AS b, p FROM {level}) WHERE n > 0)"""


ORACLES: dict[str, str] = {
    "op3_host_reputation": rf"""
        WITH parted AS (
            SELECT page_id,
                translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages),
        outcome AS (
            SELECT host, CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality = 1 THEN 0 END AS bad
            FROM parted LEFT JOIN labels ON doc_id = try_cast(nullif(regexp_extract(path, '/([0-9]{{1,18}})', 1), '') AS BIGINT)),
        h AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS b, string_split(host, '.') AS l FROM outcome GROUP BY host),
        hosts AS (SELECT host, n, b, l[-1] AS suffix, array_to_string(l[-2:], '.') AS domain FROM h),
        total AS (SELECT CAST(sum(n) AS DOUBLE) AS tn, CAST(sum(b) AS DOUBLE) AS tb FROM hosts),
        s AS MATERIALIZED (SELECT suffix, n, b, CAST(CASE WHEN n < tn THEN (tb - b) / (tn - n) WHEN tn > 0 THEN tb / tn ELSE 0 END AS DOUBLE) AS p
            FROM (SELECT suffix, sum(n) AS n, sum(b) AS b FROM hosts GROUP BY suffix), total),
        ws AS ({_weight_sql("s")}),
        d AS MATERIALIZED (SELECT x.domain, x.n, x.b, (s.b - x.b + w * s.p) / (s.n - x.n + w) AS p
            FROM (SELECT suffix, domain, sum(n) AS n, sum(b) AS b FROM hosts GROUP BY suffix, domain) x JOIN s USING (suffix), ws),
        wd AS ({_weight_sql("d")}),
        o AS MATERIALIZED (SELECT host, hosts.n, hosts.b, (d.b - hosts.b + w * d.p) / (d.n - hosts.n + w) AS p FROM hosts JOIN d USING (domain), wd),
        wo AS ({_weight_sql("o")}),
        m AS (SELECT host, n, w, (b + w * p) / (n + w) AS mean FROM o, wo WHERE host <> '' OR n > 0),
        bound AS (SELECT host, mean - 1.0::DOUBLE * sqrt(mean * (1 - mean) / (n + w + 1)) AS low FROM m),
        rule(prefix, host, path, verdict) AS (VALUES
            ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
            ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
        fit AS (
            SELECT page_id, arg_max(prefix, length(prefix)) AS rule, arg_max(verdict, length(prefix)) AS verdict
            FROM parted p JOIN rule r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
            GROUP BY page_id)
        SELECT p.page_id, p.host, p.path, fit.rule,
            coalesce(fit.verdict, CASE WHEN bound.low > 0.25 THEN 'block' ELSE 'allow' END) AS verdict
        FROM parted p LEFT JOIN fit USING (page_id) LEFT JOIN bound ON bound.host = p.host""",
    "op7_license_digests": rf"""
        WITH known AS (SELECT digest, min(license) AS license FROM (
            SELECT {_canonical_sql("text")} AS digest, license FROM (VALUES {_KNOWN_SQL}) k(license, text)
            UNION ALL SELECT column1, column0 FROM read_csv('{FOLDER}/digests.tsv', delim = '\t', header = false, all_varchar = true)) GROUP BY digest),
        line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
        held AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS names
            FROM line JOIN known ON known.digest = {_canonical_sql("line")} GROUP BY doc_id),
        whole AS (SELECT doc_id, {_canonical_sql("text")} AS digest FROM documents)
        SELECT doc_id, whole.digest, license, coalesce(n, 0) AS n_lines, coalesce(names, '') AS line_licenses
        FROM whole LEFT JOIN known USING (digest) LEFT JOIN held USING (doc_id)""",
    "op10_seed_extend": r"""
        WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        win AS (
            SELECT doc_id, s, sha256(array_to_string(w[s:s + 49], ' ')) AS h
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM words WHERE len(w) >= 50)),
        source AS (SELECT h, min(doc_id) AS lo FROM win GROUP BY h),
        gone AS (SELECT DISTINCT doc_id, p FROM (
            SELECT doc_id, unnest(range(s, s + 50)) AS p FROM win JOIN source USING (h) WHERE lo < doc_id)),
        word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM words),
        cut AS (
            SELECT doc_id, count(gone.p) AS n_removed, string_agg(x, ' ' ORDER BY word.p) FILTER (WHERE gone.p IS NULL) AS kept
            FROM word LEFT JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM words LEFT JOIN cut USING (doc_id)""",
    "op11_bloom_variants": rf"""
        WITH tab AS (SELECT list(c ORDER BY i) AS t FROM (
            SELECT i, list_reduce([i] || range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
        run AS (
            SELECT doc_id, run, count(*) AS n
            FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWERED}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) GROUP BY ALL),
        coded AS (
            SELECT run, n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
                lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END)) AS bytes
            FROM run WHERE length(run) >= 5),
        hashed AS (
            SELECT run, n, xor(list_reduce([CAST(4294967295 AS BIGINT)] || bytes, lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS h FROM coded, tab),
        word AS (
            SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
        v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM word WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
        hole AS MATERIALIZED (
            SELECT word, n, i, left(word, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM v)),
        gone AS (SELECT DISTINCT hole.word, hole.n, v.word AS other, v.n AS other_n FROM hole JOIN v ON v.word = a || b),
        near AS (
            SELECT x.word, x.n, y.word AS other, y.n AS other_n FROM hole x JOIN hole y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
            UNION ALL SELECT * FROM gone UNION ALL SELECT other, other_n, word, n FROM gone),
        best AS (
            SELECT word, any_value(n) AS n, count(*) AS n_near, max(other_n) AS top, min(other) FILTER (WHERE other_n = m) AS form
            FROM (SELECT *, max(other_n) OVER (PARTITION BY word) AS m FROM near) GROUP BY word),
        f AS MATERIALIZED (
            SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * v.n THEN form END AS form, CASE WHEN top >= 2 * v.n THEN top END AS form_n
            FROM v LEFT JOIN best USING (word)),
        chain AS (
            WITH RECURSIVE step AS (SELECT word, word AS here, 0 AS k FROM f
                UNION ALL SELECT s.word, f.form, k + 1 FROM step s JOIN f ON f.word = s.here WHERE f.form IS NOT NULL)
            SELECT word, arg_max(here, k) AS root FROM step GROUP BY word)
        SELECT f.word, form, root, f.n, n_near, form_n FROM f JOIN chain USING (word)""",
    "op13_va_clusters": _clusters_sql(k=8, rounds=10, dims=64),
}
