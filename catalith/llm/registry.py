"""Queries of the numbered operators, as the driver runs them, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.llm import balls, bpe, chat, counts, divergence, lines, lm, neardup, packing, search, toxicity, urls
from catalith.session import read_table

WORD_BPE = "word_bpe_49k.json"


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search.nearest(points, F.col("vec_id") % 100 == 0, k=10)


def op2_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = read_table(spark, sf_dir, "embeddings")
    fine = points.where(search.usable(F.col("embedding"), zero=True))
    whole = F.transform("embedding", lambda x: F.floor(F.lit(256) * x.cast("double")).cast("long"))
    return search.largest_products(fine.select("vec_id", whole.alias("vector")), F.col("vec_id") % 50 == 0, k=5)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.drop_repeated_lines(docs, min_chars=40, min_docs=5).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


URL_RULES = [
    urls.UrlRule("com", "/", "allow"),
    urls.UrlRule("example.com", "/en/", "block"),
    urls.UrlRule("www.example.com", "/en/", "allow"),
    urls.UrlRule("net", "/es/", "block"),
    urls.UrlRule("net", "/fr/", "block"),
]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: a page's path carries the number of the document it shows; that document's quality label, if any, is the page's."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", (F.lit(1) - F.col("quality")).alias("bad"))
    number = F.regexp_extract(urls.path_of(F.col("url")), r"/(\d{1,18})(?:\.html)?/?$", 1).try_cast("long")
    shown = pages.select(urls.host_of(F.col("url")).alias("host"), number.alias("doc_id")).where(F.col("doc_id").isNotNull())
    outcomes = shown.join(labels, "doc_id").select("host", "bad")
    judged = urls.judge(pages, outcomes, URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("rate", 6).alias("rate"), F.round("bound", 6).alias("bound"))


def op5_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.ppm_scores(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    pieces = packing.pack(docs, public_tokenizers.path(WORD_BPE), capacity=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.near_duplicates(docs, width=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return toxicity.toxicity(docs, labels, held_out).select("doc_id", "held_out", "score", "predicted", "decision")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    coded = bpe.encode(docs, public_tokenizers.path(WORD_BPE), decode=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    done = chat.format_paths(chat.paths_of(chat.conversation_nodes(rows)))
    done = done.select("tree", "formatted", chat.read_turns(F.col("formatted")).alias("said"), chat.loss_text(F.col("segments")).alias("loss"))
    turns = F.array_join(F.transform("said", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    done = done.select(F.col("tree").alias("conv_id"), "formatted", turns.alias("turns"), F.size("said").cast("long").alias("n_turns"), "loss")
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return done.select(
        "conv_id",
        "n_turns",
        sha("turns").alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        sha("loss").alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op11_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    fine = points.where(balls.usable(F.col("embedding"), 64))
    whole = F.transform("embedding", lambda x: F.floor(F.lit(64) * x.cast("double")).cast("long"))
    found = balls.ball_kmeans(fine.select("vec_id", whole.alias("vector")), k=16, rounds=3, dim=64)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ",").cast("binary"), 256).alias("centroid_sha256"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("lang", "source", "text")
    return divergence.divergence(docs, min_docs=30, most_terms=50)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return counts.token_counts(docs, public_tokenizers.path(WORD_BPE), limit=2048)


def queries() -> dict:
    return {
        "op1_nearest": op1_nearest,
        "op2_products": op2_products,
        "op3_line_dedup": op3_line_dedup,
        "op4_url_filter": op4_url_filter,
        "op5_ppm": op5_ppm,
        "op6_packing": op6_packing,
        "op7_minhash": op7_minhash,
        "op8_toxicity": op8_toxicity,
        "op9_bpe": op9_bpe,
        "op10_chat": op10_chat,
        "op11_balls": op11_balls,
        "op12_divergence": op12_divergence,
        "op13_token_counts": op13_token_counts,
    }


OP2_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, p.vec_id, list_inner_product(q.v, p.v)::BIGINT AS score
           FROM v q JOIN v p ON q.vec_id <> p.vec_id AND len(q.v) = len(p.v) WHERE q.vec_id % 50 = 0),
     r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""

_KEY = "translate(regexp_replace(l, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
     e AS (SELECT row_id, doc_id, unnest(ls) AS l, unnest(range(len(ls))) AS i FROM d),
     k AS (SELECT row_id, doc_id, i, l, {_KEY} AS k FROM e),
     r AS (SELECT k, max(doc_id) AS top FROM k WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
     s AS (SELECT row_id, k.doc_id, i, l, r.k IS NOT NULL AND coalesce(k.doc_id < top, false) AS lost FROM k LEFT JOIN r ON k.k = r.k)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM s GROUP BY row_id
"""


def _levels_sql(source: str) -> str:
    two = ", ".join(f"'{x}'" for x in urls.TWO_LABEL_SUFFIXES)
    number = "(regexp_matches(host, '^([0-9]{1,3}\\.){3}[0-9]{1,3}$') OR starts_with(host, '['))"
    return f"""(SELECT *, CASE WHEN {number} THEN host WHEN wide IN ({two}) THEN wide ELSE a[-1] END AS suffix, CASE WHEN {number} OR len(a) <= k THEN host ELSE array_to_string(a[len(a) - k + 1:], '.') END AS domain
      FROM (SELECT *, CASE WHEN wide IN ({two}) THEN 3 ELSE 2 END AS k FROM (SELECT *, string_split(host, '.') AS a, CASE WHEN len(string_split(host, '.')) >= 2 THEN array_to_string(string_split(host, '.')[-2:], '.') END AS wide FROM {source})))"""


def _posterior_sql(counts: str, name: str) -> str:
    """CTEs that give the table counts (good, bad, m) its strength, rate and bound."""
    return f"""{name}s AS (SELECT count(*) AS k, sum(n * (bad / n - m) ** 2) AS ss, sum(m * (1 - m)) AS v, sum(n * m * (1 - m)) AS nv FROM (SELECT *, good + bad AS n FROM {counts}) WHERE n > 0),
     {name}r AS (SELECT CASE WHEN k = 0 OR nv = 0 OR nv IS NULL THEN 1000.0 WHEN nv - v > 0 AND (ss - v) / (nv - v) > 0 THEN least(1000.0, greatest(0.5, (nv - v) / (ss - v) - 1)) ELSE 1000.0 END::DOUBLE AS s FROM {name}s),
     {name} AS (SELECT *, rate - 1.64 * sqrt(rate * (1 - rate) / (s + good + bad + 1)) AS bound FROM (SELECT c.*, s, (m * s + bad) / (m * s + bad + (1 - m) * s + good) AS rate FROM {counts} c, {name}r))"""


_HOST_SQL = "coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
_NAME_SQL = "regexp_replace(regexp_replace(host, '^.*@', '', 's'), ':[0-9]*$', '')"
OP4_SQL = f"""
WITH p AS (SELECT page_id, {_HOST_SQL} AS host, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
     o AS (SELECT host, (1 - quality)::DOUBLE AS bad FROM (SELECT host, try_cast(regexp_extract(path, '/(\\d{{1,18}})(?:\\.html)?/?$', 1) AS BIGINT) AS doc_id FROM p) n JOIN labels USING (doc_id)),
     h AS (SELECT {_NAME_SQL} AS host, sum(1 - bad) AS good, sum(bad) AS bad FROM o GROUP BY 1),
     hl AS {_levels_sql("h")},
     t AS (SELECT CASE WHEN sum(bad) > 0 THEN sum(bad) / (sum(good) + sum(bad)) ELSE 0 END AS overall FROM h),
     sc AS (SELECT suffix, sum(good) AS good, sum(bad) AS bad, any_value(overall) AS m FROM hl, t GROUP BY suffix),
     {_posterior_sql("sc", "sf")},
     dc AS (SELECT domain, any_value(suffix) AS suffix, sum(hl.good) AS good, sum(hl.bad) AS bad, any_value(sf.rate) AS m FROM hl JOIN sf USING (suffix) GROUP BY domain),
     {_posterior_sql("dc", "df")},
     hc AS (SELECT host, hl.good, hl.bad, df.rate AS m FROM hl JOIN df USING (domain)),
     {_posterior_sql("hc", "hf")},
     mine AS {_levels_sql(f"(SELECT DISTINCT {_NAME_SQL} AS host FROM p)")},
     rep AS (SELECT mine.host, coalesce(hf.rate, df.rate, sf.rate, overall) AS rate, coalesce(hf.bound, df.bound, sf.bound, overall) AS bound
             FROM mine CROSS JOIN t LEFT JOIN hf ON mine.host = hf.host LEFT JOIN df ON mine.domain = df.domain LEFT JOIN sf ON mine.suffix = sf.suffix),
     r AS (SELECT p.*, rate, bound, overall, CASE WHEN (p.host = 'www.example.com' OR p.host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
             WHEN (p.host = 'example.com' OR p.host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
             WHEN (p.host = 'net' OR p.host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/' WHEN (p.host = 'net' OR p.host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
             WHEN (p.host = 'com' OR p.host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule FROM t, p JOIN rep ON {_NAME_SQL.replace("(host,", "(p.host,")} = rep.host)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN bound > overall THEN 'block' ELSE 'allow' END AS verdict,
       round(rate, 6)::DOUBLE AS rate, round(bound, 6)::DOUBLE AS bound FROM r
"""

OP7_SQL = """
WITH RECURSIVE t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
     w AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM t),
     s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                               ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
     e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
     p AS (SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
           GROUP BY ALL HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
     r AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, p.v FROM r JOIN p ON r.v = p.u),
     c AS (SELECT u, min(v) AS component_id FROM r GROUP BY u)
SELECT s.doc_id, len(s.s) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept FROM s JOIN c ON s.doc_id = c.u
"""


def _escaped_length(c: str) -> str:
    """Characters of a text once escaped: one more for each backslash and control string."""
    found = lambda s: f"(length({c}) - length(replace({c}, '{s}', ''))) // {len(s)}"
    return " + ".join([f"length({c})", f"length({c}) - length(replace({c}, '\\', ''))", *map(found, chat.CONTROL)])


OP10_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
     g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS t,
                  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS l,
                  sum({len(chat.START) + 1 + len(chat.END)} + {_escaped_length("role")} + {_escaped_length("text")})::BIGINT AS formatted_chars
           FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(t) AS turns_sha256, length(l) AS loss_chars, sha256(l) AS loss_sha256, formatted_chars FROM g
"""


_ROUND_SQL = """
     m{r} AS (SELECT v.vec_id, v.v, v.row_id, arg_min(c.cluster, [d, c.cluster]) AS cluster, min(d) AS distance
              FROM (SELECT v.*, c.cluster, (list_inner_product(v.v, v.v) - 2 * list_inner_product(v.v, c.c) + list_inner_product(c.c, c.c))::BIGINT AS d FROM v, c{r} c) v JOIN c{r} c ON v.cluster = c.cluster GROUP BY ALL)"""
_MEANS_SQL = """
     s{r} AS (SELECT cluster, i, sum(x::BIGINT)::BIGINT AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range(len(v))) AS i FROM m{r}) GROUP BY ALL),
     c{n} AS (SELECT cluster, coalesce(f.c, c{r}.c) AS c FROM c{r} LEFT JOIN (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS c FROM s{r} GROUP BY cluster) f USING (cluster))"""
OP11_SQL = (
    """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v, row_number() OVER () AS row_id FROM embeddings
           WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     c0 AS (SELECT row_number() OVER (ORDER BY h NULLS LAST, v)::INTEGER - 1 AS cluster, v AS c FROM (SELECT sha256('1:' || vec_id) AS h, v FROM v ORDER BY h NULLS LAST, v LIMIT 16)),"""
    + ",".join(_ROUND_SQL.format(r=r) + "," + _MEANS_SQL.format(r=r, n=r + 1) for r in range(3))
    + ","
    + _ROUND_SQL.format(r=3)
    + """
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(list_transform(c, lambda x: x::BIGINT), ',')) AS centroid_sha256 FROM m3 JOIN c3 USING (cluster)
"""
)

OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
     w AS (SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
     k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT doc) >= 30),
     g AS (SELECT DISTINCT lang, source FROM d),
     c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
     f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
     t AS (SELECT lang, source, term, n, sum(n) OVER (PARTITION BY lang, source) AS total, count(*) OVER (PARTITION BY lang, source) AS v,
                  sum(n) OVER (PARTITION BY lang, term) AS ln, sum(n) OVER (PARTITION BY lang) AS ltotal FROM f),
     p AS (SELECT lang, source, term, n, (1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v)::HUGEINT)::BIGINT AS p,
                  (1 + (1000000000::HUGEINT * (ln + 5)) // (ltotal + 5 * v)::HUGEINT)::BIGINT AS q FROM t),
     s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
     pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
               LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
     every AS (FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
     r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM every)
SELECT * FROM r WHERE part = 'pair' OR rank <= 50
"""


def oracle_sql() -> dict:
    return {"op2_products": OP2_SQL, "op3_line_dedup": OP3_SQL, "op4_url_filter": OP4_SQL, "op7_minhash": OP7_SQL, "op10_chat": OP10_SQL, "op11_balls": OP11_SQL, "op12_divergence": OP12_SQL}
