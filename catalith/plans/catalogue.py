"""The library's queries over the driver's tables, each with DuckDB SQL.

The tables stand in for the catalogue: lineitem rows are printings of the card `part`, suppliers are sets, events are price
observations by user, signs of embeddings are image hashes. Only the mapping is here; the work is in operators/."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.functions import parsing, scoring, trigram
from catalith.operators import documents, hamming, lookups, prices, resolve, scanlog, search, zones
from catalith.session import read_table, scratch, spread
from catalith.sources import store
from catalith.sources.catalogue import faces_of, missing_images, sorted_faces

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a query under its function's name, with its SQL."""

    def put(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def day(name: str) -> Column:
    return F.col(name).cast("string").alias(name)


#: Trigrams of a text and Jaccard ratio in DuckDB, as macros spelled out.
def _grams_sql(x: str) -> str:
    padded = "'  ' || w || ' '"
    return f"list_distinct(flatten(list_transform(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring({padded}, i, 3)))))"


def _jaccard_sql(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"coalesce({both}::DOUBLE / nullif(len({a}) + len({b}) - {both}, 0), 0)::FLOAT"


def printings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with its part as printings."""
    line, part = read_table(spark, sf_dir, "lineitem"), read_table(spark, sf_dir, "part")
    rows = line.select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipmode" if "l_shipmode" in line.columns else F.lit(None).cast("string").alias("l_shipmode"), "l_discount")
    rows = rows.join(part.select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), rows["l_partkey"] == part["p_partkey"])
    return rows.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("p_partkey").alias("oracle_id"),
        F.col("p_name").alias("name"),
        F.col("l_suppkey").cast("string").alias("set_code"),
        F.col("l_linenumber").cast("string").alias("collector_number"),
        F.array(F.col("l_returnflag"), F.col("l_linestatus")).alias("color_identity"),
        F.lower("p_brand").alias("rarity"),
        F.when(F.col("l_discount") > 0.02, F.lit("img")).alias("image_object_key"),
        F.concat_ws(" ", "p_type", "p_brand").alias("type_line_full"),
        F.lit(None).cast("string").alias("power"),
        F.lit(None).cast("string").alias("toughness"),
        F.col("p_size").cast("float").alias("cmc"),
        F.when(F.col("l_linenumber") % 2 == 1, "en").otherwise("de").alias("lang"),
        (F.col("l_linestatus") == "F").alias("is_foil"),
    )


def sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_table(spark, sf_dir, "supplier")
    known = F.when(F.col("s_suppkey") % 7 != 0, F.date_add(F.lit("2000-01-01").cast("date"), F.col("s_suppkey").cast("int")))
    return s.select(F.col("s_suppkey").cast("string").alias("code"), F.col("s_name").alias("name"), F.lower(F.concat(F.lit("type"), F.col("s_nationkey").cast("string"))).alias("set_type"), known.alias("released_at"))


PRINTINGS_SQL = """
pr AS (SELECT l_orderkey * 10 + l_linenumber AS id, p_partkey AS oracle_id, p_name AS name, l_suppkey::VARCHAR AS set_code, l_linenumber::VARCHAR AS collector_number,
              [l_returnflag, l_linestatus] AS color_identity, lower(p_brand) AS rarity, CASE WHEN l_discount > 0.02 THEN 'img' END AS image_object_key,
              p_type || ' ' || p_brand AS type_line_full, p_size::FLOAT AS cmc, CASE WHEN l_linenumber % 2 = 1 THEN 'en' ELSE 'de' END AS lang, l_linestatus = 'F' AS is_foil
       FROM lineitem JOIN part ON l_partkey = p_partkey),
st AS (SELECT s_suppkey::VARCHAR AS code, s_name AS name, 'type' || s_nationkey AS set_type, CASE WHEN s_suppkey % 7 <> 0 THEN (DATE '2000-01-01' + s_suppkey::INTEGER)::DATE END AS released_at FROM supplier)
"""

REQUEST = search.SearchRequest(q="small ring", color="f", cmc_min=2, cmc_max=45, take=50)
_FILTER_SQL = f"""list_contains(color_identity, 'F') AND cmc >= 2 AND cmc <= 45 AND {_jaccard_sql(_grams_sql("name"), _grams_sql("'small ring'"))} > 0.2"""


@query(
    f"""WITH {PRINTINGS_SQL}, f AS (SELECT * FROM pr WHERE {_FILTER_SQL}),
n AS (SELECT f.*, released_at, count(*) OVER (PARTITION BY oracle_id) AS printing_count,
             row_number() OVER (PARTITION BY oracle_id ORDER BY (lang = 'en') DESC, (image_object_key IS NOT NULL) DESC, released_at DESC NULLS LAST, is_foil, id) AS rn FROM f LEFT JOIN st ON set_code = code)
SELECT oracle_id, id, name, printing_count, set_code, released_at::VARCHAR AS released_at FROM n WHERE rn = 1
ORDER BY {_jaccard_sql(_grams_sql("name"), _grams_sql("'small ring'"))} DESC, name, oracle_id LIMIT 50"""
)
def search_representatives(spark, sf_dir):
    found = search.search(printings(spark, sf_dir), sets(spark, sf_dir), REQUEST)
    return found.select("oracle_id", "id", "name", "printing_count", "set_code", day("released_at"))


@query(f"WITH {PRINTINGS_SQL} SELECT count(DISTINCT oracle_id) AS total FROM pr WHERE {_FILTER_SQL}")
def search_total(spark, sf_dir):
    return search.search_total(printings(spark, sf_dir), REQUEST)


@query("""WITH n AS (SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS orders,
row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F') DESC, o_orderdate DESC NULLS LAST, o_orderkey) AS rn FROM orders)
SELECT o_custkey, o_orderkey, orders FROM n WHERE rn = 1""")
def single_representative(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    order = [F.col("o_orderstatus") != "F", -F.unix_date(F.col("o_orderdate").cast("date")), F.col("o_orderkey")]
    return lookups.first_by(o, ["o_custkey"], order, ["o_orderkey"], "orders")


@query(f"""SELECT p_partkey, round(s::DOUBLE, 6) AS score FROM (SELECT p_partkey, {_jaccard_sql(_grams_sql("p_name"), _grams_sql("'green bolt'"))} AS s FROM part) WHERE s > 0.2""")
def fuzzy_filter_part(spark, sf_dir):
    part = read_table(spark, sf_dir, "part").withColumn("s", trigram.similarity_to(F.col("p_name"), "green bolt"))
    return part.where(F.col("s").cast("double") > 0.2).select("p_partkey", r6(F.col("s").cast("double")).alias("score"))


_ORDERED_GRAMS = "flatten(list_transform(regexp_extract_all(lower(line), '[\\p{L}\\p{N}]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3))))"


@query(f"""WITH l AS (SELECT line, {_ORDERED_GRAMS} AS g FROM (SELECT DISTINCT event_type || ' smal rings' AS line FROM events)), s AS (SELECT line, g, unnest(range(1, len(g) + 1)) AS a FROM l),
x AS (SELECT DISTINCT line, list_sort(list_distinct(g[a:b])) AS t FROM (SELECT line, g, a, unnest(range(a, len(g) + 1)) AS b FROM s)),
n AS (SELECT p_name, {_grams_sql("p_name")} AS t FROM (SELECT DISTINCT p_name FROM part)),
j AS (SELECT line, p_name, max(len(list_intersect(x.t, n.t))::DOUBLE / (len(x.t) + len(n.t) - len(list_intersect(x.t, n.t)))) AS score FROM x, n GROUP BY ALL)
SELECT line, p_name, round(score::FLOAT::DOUBLE, 6) AS score FROM j WHERE score::FLOAT > 0.3::FLOAT""")
def word_similarity_pairs(spark, sf_dir):
    """Every kind of event as a line with every part's name, by the best extent."""
    names = read_table(spark, sf_dir, "part").select(F.col("p_name").alias("id"), "p_name").distinct()
    lines = read_table(spark, sf_dir, "events").select(F.concat("event_type", F.lit(" smal rings")).alias("line")).distinct()
    found = trigram.word_matches(names, lines.withColumn("key", F.col("line")), "id", "p_name", "key", "line", 0.3)
    return found.select(F.col("key").alias("line"), F.col("id").alias("p_name"), r6(F.col("score").cast("double")).alias("score"))


@query(None)
def word_similarity_topk(spark, sf_dir):
    """All events' lines; SQL over whole tables would have to try every extent of every pair, so the tests hold it against the plain definition."""
    names = read_table(spark, sf_dir, "part").select("p_name").distinct().select(F.col("p_name").alias("id"), "p_name")
    lines = read_table(spark, sf_dir, "events").select(F.concat(F.col("event_type"), F.lit(" "), F.coalesce("props", F.lit("")), F.lit(" smal rings")).alias("line")).distinct()
    found = trigram.word_matches(names, lines.withColumn("key", F.col("line")), "id", "p_name", "key", "line", 0.3)
    ranked = resolve.top_by(found, "key", [F.desc("score"), F.asc("id")], 5, "rank")
    return ranked.select(F.col("key").alias("line"), F.col("id").alias("p_name"), r6(F.col("score").cast("double")).alias("score"), "rank")


@query("""WITH t AS (SELECT p_partkey, nullif(p_brand, 'Brand#1') AS sup, p_type AS t, nullif(p_name, 'small ring') AS sub FROM part)
SELECT p_partkey, nullif(trim(coalesce(sup || ' ', '') || coalesce(t, '') || coalesce(' — ' || sub, '')), '') AS stored, concat_ws(' — ', nullif(concat_ws(' ', nullif(trim(sup), ''), nullif(trim(t), '')), ''), nullif(trim(sub), '')) AS shown FROM t""")
def type_line_compose(spark, sf_dir):
    t = read_table(spark, sf_dir, "part").select("p_partkey", F.expr("nullif(p_brand, 'Brand#1')").alias("sup"), F.col("p_type").alias("t"), F.expr("nullif(p_name, 'small ring')").alias("sub"))
    parts = (F.col("sup"), F.col("t"), F.col("sub"))
    return t.select("p_partkey", parsing.full_type_line(*parts).alias("stored"), parsing.display_type_line(*parts).alias("shown"))


@query("""SELECT l_orderkey, len(c)::BIGINT AS colors FROM (SELECT l_orderkey, list_distinct(list(l_returnflag)) AS c FROM lineitem GROUP BY l_orderkey) WHERE list_has_all(c, ['A', 'N']) AND list_contains(c, 'N')""")
def facet_array_contains(spark, sf_dir):
    c = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("color_identity"))
    r = search.SearchRequest(color="N", colors=("a", "n")).canonical()
    return search.filtered(c, r).select("l_orderkey", F.size("color_identity").cast("long").alias("colors"))


@query("SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size::FLOAT >= 10 AND p_size::FLOAT <= 20 AND p_retailprice >= 950")
def range_facet(spark, sf_dir):
    part = read_table(spark, sf_dir, "part").withColumn("cmc", F.col("p_size").cast("float"))
    return search.filtered(part, search.SearchRequest(cmc_min=10, cmc_max=20)).where("p_retailprice >= 950").select("p_partkey", "p_size", "p_retailprice")


_RANKS = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3}


@query("""SELECT o_orderkey, o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 ELSE 6 END AS rank
FROM orders ORDER BY rank, o_totalprice DESC, o_orderkey LIMIT 40 OFFSET 20""")
def rarity_rank_sort(spark, sf_dir):
    rank = F.coalesce(parsing.lookup(F.col("o_orderpriority"), _RANKS), F.lit(6))
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", rank.alias("rank"), "o_totalprice")
    return o.orderBy("rank", F.desc("o_totalprice"), "o_orderkey").offset(20).limit(40).select("o_orderkey", "o_orderpriority", "rank")


@query(f"""WITH {PRINTINGS_SQL} SELECT code, row_number() OVER (ORDER BY released_at ASC NULLS LAST, code)::INTEGER AS up_last, row_number() OVER (ORDER BY released_at DESC NULLS FIRST, code DESC)::INTEGER AS down_first,
row_number() OVER (ORDER BY released_at DESC NULLS LAST, code)::INTEGER AS down_last, row_number() OVER (ORDER BY released_at ASC NULLS FIRST, code)::INTEGER AS up_first FROM st""")
def nulls_contract(spark, sf_dir):
    """Ranks of all sets in four orders; sorted by range, so no task has them all."""
    s, d = sets(spark, sf_dir).select("code", "released_at"), F.col("released_at")
    for name, order in {
        "up_last": [d.asc_nulls_last(), F.asc("code")],
        "down_first": [d.desc_nulls_first(), F.desc("code")],
        "down_last": [d.desc_nulls_last(), F.asc("code")],
        "up_first": [d.asc_nulls_first(), F.asc("code")],
    }.items():
        s = lookups.numbered(s, order, name)
    return s.drop("released_at")


@query(f"WITH {PRINTINGS_SQL} SELECT code, name, set_type, released_at::VARCHAR AS released_at FROM st ORDER BY st.released_at DESC NULLS FIRST, code DESC LIMIT 30 OFFSET 5")
def browse_sets(spark, sf_dir):
    return lookups.browse_sets(sets(spark, sf_dir), sort="released_at", descending=True, skip=5, take=30).withColumn("released_at", day("released_at"))


@query(f"""WITH {PRINTINGS_SQL} SELECT id, set_code, coalesce(st.name, set_code) AS set_name, released_at::VARCHAR AS released_at, collector_number FROM pr LEFT JOIN st ON set_code = code WHERE oracle_id = 7""")
def printings_of_card(spark, sf_dir):
    found = lookups.printings_of(printings(spark, sf_dir), sets(spark, sf_dir), None, F.col("oracle_id") == 7)
    return found.select("id", "set_code", "set_name", day("released_at"), "collector_number")


@query("SELECT event_id, user_id, c_name FROM events JOIN customer ON user_id + 1400 = c_custkey")
def hydrate_inner(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").withColumn("c_custkey", F.col("user_id") + 1400)
    return lookups.hydrate(e, read_table(spark, sf_dir, "customer"), "c_custkey", drop_missing=True).select("event_id", "user_id", "c_name")


@query("SELECT event_id, user_id, coalesce(c_name, user_id::VARCHAR) AS name FROM events LEFT JOIN customer ON user_id + 1400 = c_custkey")
def hydrate_left(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").withColumn("c_custkey", F.col("user_id") + 1400)
    rows = lookups.hydrate(e, read_table(spark, sf_dir, "customer"), "c_custkey", drop_missing=False)
    return rows.select("event_id", "user_id", F.coalesce("c_name", F.col("user_id").cast("string")).alias("name"))


@query("SELECT DISTINCT user_id + 1400 AS c_custkey FROM events WHERE user_id + 1400 NOT IN (SELECT c_custkey FROM customer)")
def unknown_ids(spark, sf_dir):
    ids = read_table(spark, sf_dir, "events").select((F.col("user_id") + 1400).alias("c_custkey")).distinct()
    return lookups.unknown(ids, read_table(spark, sf_dir, "customer"), "c_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT user_id + 1400 FROM events)")
def known_ids(spark, sf_dir):
    ids = read_table(spark, sf_dir, "events").select((F.col("user_id") + 1400).alias("c_custkey"))
    return lookups.known(read_table(spark, sf_dir, "customer"), ids, "c_custkey").select("c_custkey", "c_name")


@query("SELECT user_id, ts::DATE::VARCHAR AS day, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY ALL")
def last_wins(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").withColumn("day", F.to_date("ts").cast("string"))
    return lookups.last_by(e, ["user_id", "day"], F.col("event_id"), ["value", "event_id"])


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as observations: whole prices, so that some repeat."""
    e = read_table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("printing_id"), F.to_date("ts").alias("observed_on"), F.floor(F.col("value") / 20).cast("decimal(12,2)").alias("eur"))


_OBSERVED = """o AS (SELECT user_id AS printing_id, ts::DATE AS observed_on, arg_max(floor(value / 20), event_id)::DECIMAL(12,2) AS eur FROM events WHERE event_type = 'purchase' GROUP BY ALL),
p AS (SELECT *, lag(eur) OVER w AS old, row_number() OVER w AS rn FROM o WINDOW w AS (PARTITION BY printing_id ORDER BY observed_on)),
points AS (SELECT printing_id, observed_on, eur FROM p WHERE rn = 1 OR eur IS DISTINCT FROM old)"""


@query(f"WITH {_OBSERVED} SELECT printing_id, observed_on::VARCHAR AS observed_on, eur::DOUBLE AS eur FROM points")
def store_on_change(spark, sf_dir):
    return prices.points_of(observations(spark, sf_dir), "printing_id", "observed_on", "seq", ["eur"]).select("printing_id", day("observed_on"), F.col("eur").cast("double").alias("eur"))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def latest_snapshot(spark, sf_dir):
    return lookups.last_by(read_table(spark, sf_dir, "events"), ["user_id"], F.col("event_id"), ["event_id", "value", "event_type"])


@query(f"WITH {_OBSERVED} SELECT printing_id, observed_on::VARCHAR AS observed_on, eur::DOUBLE AS eur FROM points WHERE points.observed_on >= greatest(DATE '2024-01-03', DATE '2024-01-20' - 15) AND points.observed_on <= DATE '2024-01-25'")
def history_range(spark, sf_dir):
    points = prices.points_of(observations(spark, sf_dir), "printing_id", "observed_on", "seq", ["eur"])
    at = lambda x: F.lit(x).cast("date")
    found = prices.history(points, at("2024-01-20"), 15, at("2024-01-03"), at("2024-01-25"))
    return found.select("printing_id", day("observed_on"), F.col("eur").cast("double").alias("eur"))


def hashes(spark: SparkSession, sf_dir: str, first: int, count: int) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), hamming.sign_hash(F.col("embedding"), first, count).alias("hash"))


def _hash_sql(first: int, count: int) -> str:
    return f"(SELECT vec_id AS id, list_reduce(list_transform(range({first}, {first + count}), lambda i: CASE WHEN embedding[i] > 0 THEN 1::BIGINT ELSE 0::BIGINT END), lambda a, b: a * 2 + b) AS hash FROM embeddings)"


@query(f"WITH h AS {_hash_sql(1, 62)} SELECT a.id AS query_id, b.id, bit_count(xor(a.hash, b.hash))::INTEGER AS distance FROM h a JOIN h b ON a.id <> b.id WHERE bit_count(xor(a.hash, b.hash)) <= 16")
def hamming_pairs(spark, sf_dir):
    h = hashes(spark, sf_dir, 1, 62).where("hash is not null")
    return hamming.within(h, h, 16).where("query_id <> id")


@query(
    f"""WITH a AS {_hash_sql(1, 31)}, b AS {_hash_sql(32, 31)},
x AS (SELECT q.id AS query_id, i.id, bit_count(xor(q.hash, i.hash)) AS d FROM a q JOIN a i ON q.id % 20 = 0 AND bit_count(xor(q.hash, i.hash)) <= 16),
y AS (SELECT q.id AS query_id, i.id, bit_count(xor(q.hash, i.hash)) AS d FROM b q JOIN b i ON q.id % 20 = 0 AND bit_count(xor(q.hash, i.hash)) <= 16),
u AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rn FROM x UNION ALL SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) FROM y),
m AS (SELECT query_id, id, min(d)::INTEGER AS distance FROM u WHERE rn <= 10 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INTEGER AS rank FROM m)
SELECT query_id, id, distance, rank FROM r WHERE rank <= 10"""
)
def hamming_topk(spark, sf_dir):
    parts = []
    for first in (1, 32):
        h = hashes(spark, sf_dir, first, 31).where("hash is not null")
        parts.append(hamming.nearest(h.where("id % 20 = 0"), h, 16, 10))
    return hamming.merged_top_k(parts, 10)


@query("SELECT d AS distance, CASE WHEN d <= 2 THEN 1.0 WHEN d >= 12 THEN 0.0 ELSE (12 - d) / 10 END::DOUBLE AS score FROM (SELECT DISTINCT p_size AS d FROM part)")
def distance_score(spark, sf_dir):
    d = read_table(spark, sf_dir, "part").select(F.col("p_size").alias("distance")).distinct()
    return d.select("distance", scoring.distance_score(F.col("distance")).alias("score"))


@query("""WITH t AS (SELECT l_partkey AS id, avg(l_discount) * 8 AS s FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), h AS (SELECT p_partkey AS id, p_size AS d FROM part WHERE p_size < 20),
j AS (SELECT coalesce(t.id, h.id) AS id, least(greatest(coalesce(s, 0), 0), 1) AS s, CASE WHEN d IS NULL THEN 0 WHEN d <= 2 THEN 1 WHEN d >= 12 THEN 0 ELSE (12 - d) / 10 END AS k FROM t FULL JOIN h ON t.id = h.id)
SELECT id, round(1 - (1 - s) * (1 - k), 6)::DOUBLE AS score FROM j""")
def fusion(spark, sf_dir):
    text = read_table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("id")).agg((F.avg("l_discount") * 8).alias("ocr_score"))
    hits = read_table(spark, sf_dir, "part").where("p_size < 20").select(F.lit(0).alias("scan_id"), F.col("p_partkey").alias("id"), F.col("p_size").alias("distance"))
    return resolve.fused(text.withColumn("scan_id", F.lit(0)), hits).select("id", r6("score").alias("score"))


_WEIGHTS = [("Brand#1", 1.0), ("Brand#2", 0.85), ("Brand#3", 0.4), ("Brand#4", 0.1)]


@query("""WITH w(brand, weight) AS (VALUES ('Brand#1', 1.0), ('Brand#2', 0.85), ('Brand#3', 0.4), ('Brand#4', 0.1)),
s AS (SELECT p_size AS scan_id, p_partkey AS id, (p_retailprice - 800) / 1500 AS score, coalesce(weight, 0.5)::DOUBLE AS weight FROM part LEFT JOIN w ON p_brand = brand),
c AS (SELECT scan_id, id, least(1, greatest(0, score * weight)) AS combined FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY combined DESC, id)::INTEGER AS rank FROM c)
SELECT scan_id, id, round(combined, 6)::DOUBLE AS combined, rank FROM r WHERE rank <= 5""")
def prior_weight_topn(spark, sf_dir):
    part = read_table(spark, sf_dir, "part")
    weights = part.join(F.broadcast(spark.createDataFrame(_WEIGHTS, "p_brand string, weight double")), "p_brand").select(F.col("p_partkey").alias("id"), "weight")
    rows = part.select(F.col("p_size").alias("scan_id"), F.col("p_partkey").alias("id"), ((F.col("p_retailprice") - 800) / 1500).alias("score"))
    return resolve.ranked(rows, weights).select("scan_id", "id", r6("combined").alias("combined"), "rank")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN s >= 0.85 AND (a >= 0.7)::INT + (b >= 0.7)::INT >= 2 AND ((a >= 0.7 AND c >= 0.6) OR (b >= 0.7 AND d >= 0.6)) THEN 'High' WHEN s >= 0.6 AND a >= 0.4 THEN 'Medium' ELSE 'Low' END AS confidence
FROM (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS s, l_discount * 10 AS a, l_tax * 12 AS b, l_quantity / 60 AS c, l_discount * 9 AS d FROM lineitem)""")
def confidence_class(spark, sf_dir):
    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    return read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scoring.confidence_class(q / 50, [d * 10, t * 12], [q / 60, d * 9], d * 10).alias("confidence"))


@query("""WITH z AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS a, l_tax * 12 AS b, l_quantity > 25 AS p, l_quantity / 50 AS c FROM lineitem),
w AS (SELECT *, CASE WHEN p THEN 0.40 * (0.5 + 0.5 * least(1, greatest(0, c))) ELSE 0 END AS wa, 0.20 * (0.5 + 0.5 * least(1, greatest(0, a))) AS wb FROM z)
SELECT l_orderkey, l_linenumber, round(wa, 6)::DOUBLE AS name_weight, round(least(1, greatest(0, (wa * a + wb * b) / (wa + wb))), 6)::DOUBLE AS score FROM w""")
def zone_weights(spark, sf_dir):
    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    w = {"name": scoring.zone_weight("name", q > 25, q / 50), "rules_text": scoring.zone_weight("rules_text", F.lit(True), d * 10)}
    score = scoring.aggregate_score({"name": d * 10, "rules_text": t * 12}, w)
    return read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r6(w["name"]).alias("name_weight"), r6(score).alias("score"))


@query("""WITH t AS (SELECT o_custkey AS scan_id, o_orderkey AS id, CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN 0 WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 2 END AS tier FROM orders)
SELECT scan_id, id, tier::INTEGER AS tier FROM t QUALIFY tier = min(tier) OVER (PARTITION BY scan_id)""")
def tier_cascade(spark, sf_dir):
    urgent = F.col("o_orderpriority") == "1-URGENT"
    tier = F.when((F.col("o_orderstatus") == "P") & urgent, 0).when(urgent, 1).otherwise(2)
    return resolve.first_tier(read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("scan_id"), F.col("o_orderkey").alias("id"), tier.alias("tier")))


@query("""WITH s AS (SELECT l_suppkey, l_discount, sum(l_quantity) AS w FROM lineitem GROUP BY ALL),
r AS (SELECT *, sum(w) OVER (PARTITION BY l_suppkey ORDER BY l_discount ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY l_suppkey) / 2 AS half FROM s)
SELECT l_suppkey, min(l_discount) AS median FROM r WHERE run >= half GROUP BY l_suppkey""")
def weighted_median(spark, sf_dir):
    return lookups.weighted_lower_median(read_table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_discount", "l_quantity")


@query("SELECT conv_id, string_agg(trim(text), ' ' ORDER BY turn) AS said FROM conversations WHERE trim(text) <> '' GROUP BY conv_id")
def ordered_concat(spark, sf_dir):
    said = F.trim("text")
    c = read_table(spark, sf_dir, "conversations").where(said != "")
    return c.groupBy("conv_id").agg(zones.reading_order(F.lit(True), ["turn"], said).alias("said"))


@query("SELECT lang, coalesce(round(avg(CASE WHEN trim(text) <> '' THEN n_chars END), 6), 0)::DOUBLE AS mean_chars FROM documents GROUP BY lang")
def mean_nonblank(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return d.groupBy("lang").agg(r6(zones.mean_where(F.trim("text") != "", F.col("n_chars"))).alias("mean_chars"))


@query("""WITH b AS (SELECT vec_id, label, embedding[1]::DOUBLE + 0.5 AS x, embedding[2]::DOUBLE + 0.5 AS y FROM embeddings), e AS (SELECT label, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM b GROUP BY label),
c AS (SELECT vec_id, CASE WHEN x1 - x0 >= 0.2 THEN 0.05 + (x - x0) / (x1 - x0) * (0.95 - 0.05) ELSE x END AS x, CASE WHEN y1 - y0 >= 0.2 THEN 0.07 + (y - y0) / (y1 - y0) * (0.94 - 0.07) ELSE y END AS y FROM b JOIN e USING (label))
SELECT vec_id, CASE WHEN x BETWEEN 0.05 AND 0.78 AND y BETWEEN 0.04 AND 0.10 THEN 'name' WHEN x BETWEEN 0.05 AND 0.78 AND y BETWEEN 0.555 AND 0.605 THEN 'type_line' WHEN x BETWEEN 0.78 AND 0.96 AND y BETWEEN 0.885 AND 0.925 THEN 'power_toughness'
 WHEN x BETWEEN 0.03 AND 0.40 AND y BETWEEN 0.91 AND 0.97 THEN 'bottom' WHEN y BETWEEN 0.62 AND 0.88 THEN 'rules_text' ELSE 'unknown' END AS zone FROM c""")
def zone_case(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    b = e.select("vec_id", "label", (F.col("embedding")[0].cast("double") + 0.5).alias("x"), (F.col("embedding")[1].cast("double") + 0.5).alias("y"))
    extent = b.groupBy("label").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    c = b.join(extent, "label")
    cx, cy = scoring.axis_rescale(F.col("x"), F.col("x0"), F.col("x1"), scoring.CARD_X), scoring.axis_rescale(F.col("y"), F.col("y0"), F.col("y1"), scoring.CARD_Y)
    return c.select("vec_id", scoring.zone_of(cx, cy).alias("zone"))



def _texts_sql(name: str, key: str, lines: list[str], table: str) -> str:
    """A CTE of texts made from a table's rows, by their number modulo the number of kinds."""
    kinds = " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(lines))
    return f"{name} AS (SELECT *, CASE {key} % {len(lines)} {kinds} END AS line FROM {table})"


def _texts(df: DataFrame, key: str, lines: list[str]) -> DataFrame:
    kinds = " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(lines))
    return df.withColumn("line", F.expr(f"CASE {key} % {len(lines)} {kinds} END"))


_NUMBER = "lpad(CAST(p_partkey % 1000 AS STRING), 4, '0')"
COLLECTOR_LINES = [
    f"'U ' || {_NUMBER} || ' LTR . EN >CALDER MOORE'", f"'U ' || {_NUMBER} || ' U 016EN SCARER MOORE'", "CAST(p_size AS STRING) || '/254 R THB • EN'", "lpad(CAST(p_size AS STRING), 3, '0') || '/280 C STX-JP'",
    "CAST(p_size AS STRING) || '/274 M'", "''", "p_name", "'000/' || CAST(p_partkey % 1000 AS STRING)",
]


@query(f"""WITH {_texts_sql("t", "p_partkey", COLLECTOR_LINES, "part")},
p AS (SELECT *, regexp_extract(line, '(?i)(\\d{{1,4}})\\s*/\\s*\\d{{1,4}}\\s*([CURMS])?', ['a', 'b']) AS l, regexp_extract(line, '\\b([CURMSL])\\s*(\\d{{3,4}})\\b', ['b', 'a']) AS m,
 regexp_extract(line, '\\b([A-Z][A-Z0-9]{{2,4}})\\s*[•·.\\-‐‒*,]?\\s*(EN|ES|SP|FR|DE|IT|PT|JP|JA|KO|RU|CS|CT|PH)\\b', ['s', 'g']) AS x FROM t),
q AS (SELECT p_partkey, coalesce(nullif(l.a, ''), nullif(m.a, '')) AS num, upper(CASE WHEN l.a <> '' THEN l.b ELSE m.b END) AS r, x FROM p)
SELECT p_partkey, coalesce(nullif(ltrim(num, '0'), ''), num) AS number, CASE r WHEN 'C' THEN 'common' WHEN 'U' THEN 'uncommon' WHEN 'R' THEN 'rare' WHEN 'M' THEN 'mythic' WHEN 'S' THEN 'special' WHEN 'L' THEN 'common' END AS rarity,
 CASE WHEN num IS NOT NULL THEN lower(nullif(x.s, '')) END AS set_code, CASE WHEN num IS NOT NULL THEN CASE x.g WHEN 'JP' THEN 'ja' WHEN 'SP' THEN 'es' WHEN 'CS' THEN 'zhs' WHEN 'CT' THEN 'zht' ELSE lower(nullif(x.g, '')) END END AS lang FROM q""")
def collector_parse(spark, sf_dir):
    t = _texts(read_table(spark, sf_dir, "part"), "p_partkey", COLLECTOR_LINES)
    return t.select("p_partkey", parsing.parse_collector_line(F.col("line")).alias("p")).select("p_partkey", "p.*")


TYPE_LINES = ["'Legendary ' || p_type || ' — Elf ' || p_brand", "'Basic Snow ' || p_type || ' - ' || p_brand", "p_type", "'legendary'", "p_type || ' —'", "'World ' || p_type"]


@query(f"""WITH {_texts_sql("t", "p_partkey", TYPE_LINES, "part")},
p AS (SELECT p_partkey, trim(CASE WHEN contains(line, '—') THEN split_part(line, '—', 1) WHEN contains(line, ' - ') THEN split_part(line, ' - ', 1) ELSE line END) AS f,
 nullif(trim(CASE WHEN contains(line, '—') THEN split_part(line, '—', 2) WHEN contains(line, ' - ') THEN split_part(line, ' - ', 2) ELSE '' END), '') AS subtype FROM t),
q AS (SELECT p_partkey, subtype, f, regexp_extract(f, '(?i)^((?:(?:Basic|Legendary|Snow|World|Ongoing|Token|Tribal|Host|Elite)(?:\\s+|$))*)', 1) AS u FROM p)
SELECT p_partkey, nullif(trim(u), '') AS supertype, trim(substr(f, length(u) + 1)) AS type, subtype FROM q""")
def type_line_parse(spark, sf_dir):
    t = _texts(read_table(spark, sf_dir, "part"), "p_partkey", TYPE_LINES)
    return t.select("p_partkey", parsing.parse_type_line(F.col("line")).alias("p")).select("p_partkey", "p.*")


_A, _B = "CAST(l_partkey % 9 AS STRING)", "CAST(l_suppkey % 7 AS STRING)"
POWER_LINES = [f"{_A} || '/' || {_B}", f"'x ' || {_A} || '+* ⁄ ' || {_B}", "'*/*'", "'none'", f"{_A} || ' / ' || {_B}"]


@query(f"""WITH {_texts_sql("t", "l_linenumber", POWER_LINES, "lineitem")}, k AS (SELECT *, CASE WHEN l_linenumber = 1 THEN {_A} || '+*' ELSE {_A} END AS p, (l_suppkey % 5)::VARCHAR AS t FROM t),
x AS (SELECT *, regexp_extract(line, '(\\*|\\d+(?:\\+\\*)?)\\s*[/⁄]\\s*(\\*|\\d+(?:\\+\\*)?)', ['a', 'b']) AS m FROM k)
SELECT l_orderkey, l_linenumber, CASE WHEN m.a = '' THEN 0.0 ELSE ((m.a = p)::INT + (m.b = t)::INT) / 2 END::DOUBLE AS score, nullif(trim(split_part(line, '/', 1)), '') AS power, nullif(trim(regexp_extract(line, '^[^/]*/(.*)$', 1)), '') AS toughness FROM x""")
def pt_score(spark, sf_dir):
    t = _texts(read_table(spark, sf_dir, "lineitem"), "l_linenumber", POWER_LINES)
    own = F.expr(f"CASE WHEN l_linenumber = 1 THEN {_A} || '+*' ELSE {_A} END")
    score = parsing.power_toughness_score(F.col("line"), own, (F.col("l_suppkey") % 5).cast("string"))
    return t.select("l_orderkey", "l_linenumber", score.alias("score"), parsing.split_power_toughness(F.col("line")).alias("s")).select("l_orderkey", "l_linenumber", "score", "s.*")


@query("""SELECT l_orderkey, len(list(l_linenumber))::BIGINT AS faces, string_agg(l_returnflag || l_linenumber, ',' ORDER BY l_linenumber, l_returnflag) AS line, min(k)::BIGINT AS k
FROM lineitem JOIN (SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events) ON event_id = l_orderkey GROUP BY l_orderkey""")
def faces_json(spark, sf_dir):
    line = read_table(spark, sf_dir, "lineitem")
    text = lambda c: F.col(c).cast("string")
    face = F.struct(F.concat("l_returnflag", text("l_linenumber")).alias("name"), text("l_returnflag").alias("mana_cost"), text("l_linestatus").alias("type_line"), text("l_tax").alias("oracle_text"), text("l_quantity").alias("power"), text("l_discount").alias("toughness"))
    cards = line.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", face.alias("f")))).alias("c")).withColumn("faces", sorted_faces(faces_of(F.transform("c", lambda x: x["f"])))).where("faces is not null")
    keys = read_table(spark, sf_dir, "events").select(F.col("event_id").alias("l_orderkey"), F.from_json("props", "k bigint").alias("p")).select("l_orderkey", "p.k")
    return cards.join(keys, "l_orderkey").select("l_orderkey", F.size("faces").cast("long").alias("faces"), F.array_join(F.transform("faces", lambda f: f["name"]), ",").alias("line"), "k")


def collections(spark: SparkSession, sf_dir: str, owner: str | None = None) -> DataFrame:
    """Orders with their lines as documents with cards. With an owner, other owners' lines go before they are nested."""
    line = read_table(spark, sf_dir, "lineitem")
    orders = read_table(spark, sf_dir, "orders")
    docs = orders.select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 10).cast("string").alias("owner_id"), F.concat(F.lit("box "), F.col("o_orderstatus")).alias("name"), (F.col("o_orderpriority") == "5-LOW").alias("is_removed"))
    if owner is not None:
        docs = docs.where((F.col("owner_id") == owner) & ~F.col("is_removed"))
        line = line.join(docs.select("l_orderkey"), "l_orderkey", "left_semi")
    card = F.struct(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("instance_id"), F.col("l_partkey").alias("printing_id"), (F.col("l_linestatus") == "F").alias("is_foil"), F.col("l_returnflag").alias("language"), F.lit("NM").alias("condition"))
    cards = line.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(card)).alias("cards"))
    return docs.join(cards, "l_orderkey").withColumnRenamed("l_orderkey", "id")


_CARDS = """c AS (SELECT o_orderkey AS id, (o_custkey % 10)::VARCHAR AS owner_id, 'box ' || o_orderstatus AS name, o_orderpriority = '5-LOW' AS is_removed, l_orderkey || '-' || l_linenumber AS instance_id, l_partkey AS printing_id, l_linestatus = 'F' AS is_foil, l_returnflag AS language
FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""


@query(f"""WITH {_CARDS}, p AS (SELECT c.id AS collection_id, c.name AS collection_name, instance_id, p_name FROM c JOIN part ON printing_id = p_partkey WHERE owner_id = '3' AND NOT is_removed)
SELECT collection_id, collection_name, instance_id, p_name AS name FROM p ORDER BY upper(p_name), instance_id LIMIT 60 OFFSET 30""")
def flatten_page(spark, sf_dir):
    part = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return documents.card_page(documents.flattened(collections(spark, sf_dir, "3"), "3"), part, 30, 60).select("collection_id", "collection_name", "instance_id", "name")


@query(f"""WITH {_CARDS} SELECT id, count(*) FILTER (WHERE right(instance_id, 1) NOT IN ('1', '3')) AS stays, count(*) FILTER (WHERE right(instance_id, 1) IN ('1', '3')) AS moves, (2 - count(DISTINCT instance_id) FILTER (WHERE right(instance_id, 1) IN ('1', '3')))::INTEGER AS missing FROM c GROUP BY id""")
def bulk_move(spark, sf_dir):
    c = collections(spark, sf_dir)
    ids = F.array(F.concat(F.col("id").cast("string"), F.lit("-1")), F.concat(F.col("id").cast("string"), F.lit("-3")), F.concat(F.col("id").cast("string"), F.lit("-3")))
    rest, into, missing = documents.moved(F.col("cards"), F.filter("cards", lambda x: F.lit(False)), ids)
    return c.select("id", F.size(rest).cast("long").alias("stays"), F.size(into).cast("long").alias("moves"), missing.alias("missing"))


@query("SELECT l_orderkey, l_linenumber, unnest(range(1, least(50, greatest(1, ((l_quantity - 44) * 10)::INT)) + 1))::INTEGER AS copy FROM lineitem")
def repeat_rows(spark, sf_dir):
    line = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return documents.repeated(line, (F.col("l_quantity") - 44) * 10).select("l_orderkey", "l_linenumber", "copy")


@query("""WITH c AS (SELECT event_id // 8 AS scan_id, list(user_id % 13 ORDER BY event_id) AS c FROM events GROUP BY 1)
SELECT scan_id, nullif(coalesce(list_position(c, scan_id % 13), 0), 0)::BIGINT AS rank, (c[1] <> scan_id % 13) AS changed_top FROM c""")
def array_rank(spark, sf_dir):
    """Scans of eight events each; the candidates are their users."""
    e = read_table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 8).alias("scan_id")).agg(F.array_sort(F.collect_list(F.struct("event_id", "user_id"))).alias("c"))
    cands = F.transform("c", lambda x: F.struct((x["user_id"] % 13).cast("string").alias("printing_id")))
    label = (F.col("scan_id") % 13).cast("string")
    e = e.withColumn("candidates", cands)
    return e.select("scan_id", lookups.label_rank(F.col("candidates"), label).alias("rank"), documents.feedback_changed_top(label, F.col("candidates")).alias("changed_top"))


@query("SELECT event_id FROM events WHERE ts + INTERVAL 7 DAY >= TIMESTAMP '2024-01-20 00:00:00'")
def ttl_visible(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").withColumn("expires_at", F.col("ts") + F.expr("INTERVAL '7' DAY"))
    return documents.alive(e, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).select("event_id")


@query(f"""WITH {_CARDS} SELECT id, bool_or(printing_id % 5 = 2 AND is_foil AND upper(language) = 'N') AS clash FROM c GROUP BY id""")
def dup_clash(spark, sf_dir):
    c = collections(spark, sf_dir).withColumn("cards", F.transform("cards", lambda x: x.withField("printing_id", x["printing_id"] % 5)))
    return c.select("id", documents.clashes(F.col("cards"), F.lit(2), F.lit(True), F.lit("n")).alias("clash"))


@query("""WITH o AS (SELECT c_custkey AS id, c_name AS name, c_acctbal AS hash FROM customer WHERE c_acctbal < 6000), n AS (SELECT c_custkey AS id, upper(c_name) AS name, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 END AS hash FROM customer WHERE c_acctbal >= 2000)
SELECT coalesce(o.id, n.id) AS id, coalesce(n.name, o.name) AS name, round(coalesce(n.hash, o.hash), 6) AS hash FROM o FULL JOIN n ON o.id = n.id""")
def merge_upsert(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer")
    old = c.where("c_acctbal < 6000").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("hash"))
    new = c.where("c_acctbal >= 2000").select(F.col("c_custkey").alias("id"), F.upper("c_name").alias("name"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal") + 1).alias("hash"))
    return store.upsert(old, new, ["id"], preserve=["hash"]).withColumn("hash", r6("hash"))


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE c_acctbal >= 6000) AS added, count(*) FILTER (WHERE c_acctbal < 6000) AS updated FROM customer WHERE c_acctbal >= 2000""")
def upsert_counts(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    return store.upsert_counts(c.where("c_acctbal < 6000"), c.where("c_acctbal >= 2000"), ["id"])


@query("SELECT event_type, count(*) AS scans, round(avg(value), 6) AS mean_value, min(value) AS low, max(value) AS high FROM events GROUP BY event_type")
def telemetry_rollup(spark, sf_dir):
    return scanlog.outcomes(read_table(spark, sf_dir, "events"), ["event_type"], "value")


@query(f"WITH {_OBSERVED} SELECT printing_id::VARCHAR AS printing_id, observed_on::VARCHAR AS observed_on, eur::DOUBLE AS eur FROM points")
def stream_store_on_change(spark, sf_dir):
    """The whole price series through the streaming ingest, a week a micro-batch; equal to the batch result."""
    from catalith.streaming.ingest import points_of, price_stream

    base = scratch(spark)
    rows = observations(spark, sf_dir).select("seq", F.col("printing_id").cast("string").alias("printing_id"), "eur", F.lit(None).cast("decimal(12,2)").alias("eur_foil"), "observed_on")
    week, schema = F.date_trunc("week", "observed_on"), "seq long, printing_id string, eur decimal(12,2), eur_foil decimal(12,2), observed_on date"
    for (day_,) in rows.select(week.alias("w")).distinct().orderBy("w").collect():  # each week lands and is taken in before the next
        rows.where(week == day_).write.mode("append").parquet(f"{base}/landing")
        price_stream(spark, f"{base}/landing", schema, f"{base}/latest", f"{base}/points", f"{base}/checkpoint", files=100_000).awaitTermination()
    return points_of(spark, f"{base}/points").select("printing_id", day("observed_on"), F.col("eur").cast("double").alias("eur"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as OCR regions of one scan for each user; odd users' scans are cropped."""
    e = read_table(spark, sf_dir, "events")
    x, y = (F.col("event_id") * 37 % 100) / 100.0, (F.col("event_id") * 53 % 97) / 100.0
    return e.select(
        F.col("user_id").alias("scan_id"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_id") % 5 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" "), F.col("event_type"))).alias("text"),
        x.alias("x_min"),
        y.alias("y_min"),
        (x + (F.col("event_id") % 7) / 64.0).alias("x_max"),
        (y + (F.col("event_id") % 3) / 64.0).alias("y_max"),
        ((F.col("event_id") * 41 % 360) - 180).cast("double").alias("rotation"),
        ((F.col("event_id") % 11) / 10.0).alias("confidence"),
        F.lit(1).alias("image_width"),
        F.lit(1).alias("image_height"),
        (F.col("user_id") % 2 == 1).alias("is_cropped"),
    )


_REGIONS = """r0 AS (SELECT user_id AS scan_id, event_id AS seq, CASE WHEN event_id % 5 = 0 THEN ' ' ELSE ' ' || event_type END AS text, (event_id * 37 % 100) / 100.0::DOUBLE AS x0, (event_id * 53 % 97) / 100.0::DOUBLE AS y0,
  (event_id % 7) / 64.0::DOUBLE AS w, (event_id % 3) / 64.0::DOUBLE AS h, ((event_id * 41 % 360) - 180)::DOUBLE AS rotation, (event_id % 11) / 10.0::DOUBLE AS confidence, user_id % 2 = 1 AS cropped FROM events),
r1 AS (SELECT *, (x0 + (x0 + w)) / 2.0::DOUBLE AS rx, (y0 + (y0 + h)) / 2.0::DOUBLE AS ry, greatest(0, (x0 + w) - x0) * greatest(0, (y0 + h) - y0) AS area FROM r0)"""


@query(f"""WITH {_REGIONS},
e AS (SELECT *, min(rx) OVER s AS ax, max(rx) OVER s AS bx, min(ry) OVER s AS ay, max(ry) OVER s AS dy FROM r1 WINDOW s AS (PARTITION BY scan_id)),
p AS (SELECT *, CASE WHEN bx - ax >= 0.2 THEN 0.05 + (rx - ax) / (bx - ax) * (0.95::DOUBLE - 0.05::DOUBLE) ELSE rx END AS x, CASE WHEN dy - ay >= 0.2 THEN 0.07 + (ry - ay) / (dy - ay) * (0.94::DOUBLE - 0.07::DOUBLE) ELSE ry END AS y FROM e),
a AS (SELECT *, y >= 0.55 AND y < 0.85 AS lower, y < 0.35 AS upper FROM p),
b AS (SELECT *, lower AND row_number() OVER (PARTITION BY scan_id, lower ORDER BY area DESC, seq) <= 3 AS rules, upper AND row_number() OVER (PARTITION BY scan_id, upper ORDER BY area DESC, seq) <= 1 AS name,
  y >= 0.85 AND x >= 0.65 AND length(trim(text)) BETWEEN 1 AND 8 AS pm FROM a),
c AS (SELECT *, y >= 0.45 AND y < 0.60 AND NOT rules AS tm, pm AND row_number() OVER (PARTITION BY scan_id, pm ORDER BY x DESC, seq) <= 1 AS power FROM b),
d AS (SELECT *, tm AND row_number() OVER (PARTITION BY scan_id, tm ORDER BY area DESC, seq) <= 1 AS type, y >= 0.85 AND x <= 0.45 AND NOT power AS bm FROM c),
f AS (SELECT *, bm AND row_number() OVER (PARTITION BY scan_id, bm ORDER BY x, seq) <= 2 AS bottom FROM d),
z AS (SELECT *, trim(text) AS t, CASE WHEN cropped THEN CASE WHEN x BETWEEN 0.05 AND 0.78 AND y BETWEEN 0.04 AND 0.10 THEN 'name' WHEN x BETWEEN 0.05 AND 0.78 AND y BETWEEN 0.555 AND 0.605 THEN 'type_line'
  WHEN x BETWEEN 0.78 AND 0.96 AND y BETWEEN 0.885 AND 0.925 THEN 'power_toughness' WHEN x BETWEEN 0.03 AND 0.40 AND y BETWEEN 0.91 AND 0.97 THEN 'bottom' WHEN y BETWEEN 0.62 AND 0.88 THEN 'rules_text' ELSE 'unknown' END
  WHEN name THEN 'name' WHEN type THEN 'type_line' WHEN rules THEN 'rules_text' WHEN power THEN 'power_toughness' WHEN bottom THEN 'bottom' ELSE 'unknown' END AS zone FROM f)
SELECT scan_id, {", ".join(f"coalesce(string_agg(t, ' ' ORDER BY ry, rx, seq) FILTER (WHERE zone = '{n}' AND t <> ''), '') AS {n}, round(coalesce(avg(confidence) FILTER (WHERE zone = '{n}' AND t <> ''), 0), 6)::DOUBLE AS {n}_conf" for n in zones.ZONES)} FROM z GROUP BY scan_id""")
def zones_from_regions(spark, sf_dir):
    return zones.zones_of(regions(spark, sf_dir)).select("scan_id", *[c for z in zones.ZONES for c in (F.col(z), r6(f"{z}_conf").alias(f"{z}_conf"))])


@query(f"""WITH {_REGIONS}, s AS (SELECT scan_id, rotation, sum(area) AS w FROM r1 WHERE confidence >= 0.4 AND area > 0 GROUP BY ALL),
m AS (SELECT *, sum(w) OVER (PARTITION BY scan_id ORDER BY rotation ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY scan_id) / 2 AS half FROM s)
SELECT scan_id, min(rotation) AS median_rotation, abs(min(rotation)) > 135 AS upside_down FROM m WHERE run >= half GROUP BY scan_id""")
def rotation_median(spark, sf_dir):
    return resolve.upside_down(regions(spark, sf_dir))


@query("""SELECT event_id, CASE WHEN d THEN oc >= fc AND o >= f ELSE o > f OR (m AND oc > fc AND o >= 0.4) END AS accepted FROM (SELECT event_id, event_id % 2 = 0 AS d, (event_id % 10) / 10.0 AS f, (event_id * 7 % 10) / 10.0 AS o, event_id % 6 AS fc, event_id * 5 % 6 AS oc, event_id % 3 = 0 AS m FROM events)""")
def retry_rule(spark, sf_dir):
    i = F.col("event_id")
    accepted = resolve.accept_retry(i % 2 == 0, (i % 10) / 10.0, (i * 7 % 10) / 10.0, i % 6, i * 5 % 6, i % 3 == 0)
    return read_table(spark, sf_dir, "events").select("event_id", accepted.alias("accepted"))


@query("""SELECT DISTINCT p_size AS upright, p_partkey % 20 AS flipped, p_size >= 12 AND p_size - p_partkey % 20 >= 2 AS flip FROM part""")
def orientation_rule(spark, sf_dir):
    p = read_table(spark, sf_dir, "part").select(F.col("p_size").alias("upright"), (F.col("p_partkey") % 20).alias("flipped")).distinct()
    return p.withColumn("flip", scoring.should_flip(F.col("upright"), F.col("flipped")))


@query(f"""WITH h AS {_hash_sql(1, 62)}, q AS (SELECT q.id AS scan_id, i.id AS symbol_set, bit_count(xor(q.hash, i.hash)) AS d FROM h q JOIN h i ON q.id >= 40 AND i.id < 40 AND bit_count(xor(q.hash, i.hash)) <= 24)
SELECT scan_id, symbol_set, round(1 - d / 64, 6)::DOUBLE AS symbol_score FROM q QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY d, symbol_set) = 1""")
def symbol_detect(spark, sf_dir):
    h = hashes(spark, sf_dir, 1, 62)
    scans = h.where("id >= 40").select(F.col("id").alias("scan_id"), F.col("hash").alias("symbol_hash"))
    icons = h.where("id < 40").select(F.col("id").alias("code"), F.col("hash").alias("icon_phash"))
    return resolve.symbol_matches(scans, icons, 24).withColumn("symbol_score", r6("symbol_score"))


@query(f"""WITH {PRINTINGS_SQL}, w(set_type, weight) AS (VALUES ('type1', 1.0), ('type2', 0.85), ('type3', 0.1)), k AS (SELECT id, CASE WHEN id % 11 = 0 THEN 'gone' ELSE set_code END AS set_code FROM pr)
SELECT id, coalesce(weight, 0.5)::DOUBLE AS weight FROM k LEFT JOIN st ON set_code = code LEFT JOIN w ON st.set_type = w.set_type""")
def set_weight_chain(spark, sf_dir):
    weights = spark.createDataFrame([("type1", 1.0), ("type2", 0.85), ("type3", 0.1)], "set_type string, weight double")
    rows = printings(spark, sf_dir).select("id", F.when(F.col("id") % 11 == 0, "gone").otherwise(F.col("set_code")).alias("set_code"))
    return lookups.with_set_weights(rows, sets(spark, sf_dir), weights).select("id", "weight")


@query("""WITH c AS (SELECT event_id // 8 AS scan_id, round(min_by(value, event_id))::INTEGER AS top FROM events GROUP BY 1) SELECT scan_id, CASE WHEN p_partkey IS NOT NULL THEN top END AS printing, p_name FROM c LEFT JOIN part ON p_partkey = top""")
def top_candidate_join(spark, sf_dir):
    """Scans of eight events each, which are their candidates."""
    each = F.struct("event_id", F.round("value").cast("long").alias("printing_id"))
    e = read_table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 8).alias("scan_id")).agg(F.array_sort(F.collect_list(each)).alias("candidates"))
    part = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("printing_id"), "p_name")
    rows = lookups.top_candidate(e, part)
    return rows.select("scan_id", F.when(F.col("p_name").isNotNull(), F.col("printing_id")).cast("int").alias("printing"), "p_name")


_K = "o_orderkey"
DAY_TEXTS = [f"'2024-02-' || lpad(CAST({_K} % 35 AS STRING), 2, '0')", f"'20' || lpad(CAST({_K} % 100 AS STRING), 2, '0') || '-' || lpad(CAST({_K} % 14 AS STRING), 2, '0') || '-31'", "'2024-1-1'", "NULL", f"'2023-02-' || CAST({_K} % 10 + 20 AS STRING)"]
PRICE_TEXTS = [f"'1,' || lpad(CAST({_K} % 1000 AS STRING), 3, '0') || '.50'", "'x'", "NULL", f"' ' || CAST({_K} AS STRING) || ' '", f"CAST({_K} % 100 AS STRING) || '.555'", "''"]
LANGUAGE_TEXTS = ["'a'", "' '", "NULL", "'  b '", "''"]


@query(f"""WITH {_texts_sql("a", _K, DAY_TEXTS, "orders")}, b AS (SELECT {_K}, line AS d FROM a), {_texts_sql("c", _K, PRICE_TEXTS, "b")}, e AS (SELECT {_K}, d, line AS x FROM c), {_texts_sql("t", _K, LANGUAGE_TEXTS, "e")}
SELECT {_K}, try_strptime(CASE WHEN length(d) = 10 THEN d END, '%Y-%m-%d')::DATE::VARCHAR AS day, round(try_cast(replace(trim(x), ',', '') AS DECIMAL(15, 3)), 2)::DOUBLE AS price, coalesce(nullif(line, ''), 'en') AS language, least(50, greatest(1, {_K} % 80 - 5))::INTEGER AS copies FROM t""")
def lenient_values(spark, sf_dir):
    """Days, prices and languages as texts of all sorts, one of each an order."""
    t = _texts(read_table(spark, sf_dir, "orders").select(_K), _K, DAY_TEXTS).withColumnRenamed("line", "d")
    t = _texts(_texts(t, _K, PRICE_TEXTS).withColumnRenamed("line", "x"), _K, LANGUAGE_TEXTS)
    copies = F.greatest(F.lit(1), F.least(F.lit(50), F.col(_K) % 80 - 5)).cast("int").alias("copies")
    return t.select(_K, parsing.strict_date(F.col("d")).cast("string").alias("day"), parsing.lenient_decimal(F.col("x")).cast("double").alias("price"), documents.with_default(F.col("line"), "en").alias("language"), copies)


@query("""SELECT event_id, 'scans/' || regexp_replace(lower(event_type || '@Mail.' || user_id), '[^\\p{L}\\p{N}]', '_', 'g') || strftime(ts, '/%Y/%m/') || event_id || CASE event_id % 3 WHEN 0 THEN '.png' WHEN 1 THEN '.webp' ELSE '.jpg' END AS key FROM events""")
def object_keys(spark, sf_dir):
    media = F.when(F.col("event_id") % 3 == 0, "image/png").when(F.col("event_id") % 3 == 1, "image/webp").otherwise("image/jpeg")
    owner = F.concat(F.col("event_type"), F.lit("@Mail."), F.col("user_id").cast("string"))
    return read_table(spark, sf_dir, "events").select("event_id", parsing.scan_object_key(owner, F.col("ts"), F.col("event_id").cast("string"), media).alias("key"))


@query("SELECT p_partkey AS id FROM part WHERE p_brand = 'Brand#1' OR p_size > 40")
def backfill_worklist(spark, sf_dir):
    p = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_brand") != "Brand#1", F.col("p_brand")).alias("image_object_key"), F.when(F.col("p_size") <= 40, F.col("p_size")).alias("art_phash"))
    return missing_images(p).select("id")


@query("SELECT DISTINCT scan_id, id FROM (SELECT user_id AS scan_id, event_id % 50 AS id FROM events WHERE event_type = 'view' UNION ALL SELECT user_id, event_id % 70 FROM events WHERE event_type = 'click')")
def pool_union(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    part = lambda kind, n: e.where(F.col("event_type") == kind).select(F.col("user_id").alias("scan_id"), (F.col("event_id") % n).alias("id"))
    return resolve.pool_of(part("view", 50), part("click", 70))


@query(f"""WITH {_CARDS} SELECT id, count(*) FILTER (WHERE right(instance_id, 1) IN ('1', '2')) AS taken, coalesce(string_agg(language, '' ORDER BY instance_id, printing_id, is_foil, language) FILTER (WHERE right(instance_id, 1) IN ('1', '2')), '') AS languages FROM c GROUP BY id""")
def selection_commit(spark, sf_dir):
    c = collections(spark, sf_dir)
    ids = F.transform(F.array(F.lit("-1"), F.lit("-2")), lambda s: F.concat(F.col("id").cast("string"), s))
    taken = documents.committed(F.col("cards"), ids, F.lit("2026-01-01").cast("timestamp"))
    return c.select("id", F.size(taken).cast("long").alias("taken"), F.array_join(F.transform(taken, lambda x: x["language"]), "").alias("languages"))


@query("SELECT user_id, bool_or(event_type IN ('error', 'purchase')) AS admin FROM events GROUP BY user_id")
def admin_flag(spark, sf_dir):
    group = F.when(F.col("event_type") == "error", "mtg-admins").when(F.col("event_type") == "purchase", "platform-admins").otherwise(F.col("event_type"))
    groups = read_table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(group).alias("g"))
    return groups.select("user_id", documents.is_admin(F.col("g")).alias("admin"))


@query(f"""WITH {_CARDS} SELECT id, any_value(name) AS name, count(*)::INTEGER AS card_count FROM c WHERE owner_id = '3' AND NOT is_removed GROUP BY id""")
def collection_overview(spark, sf_dir):
    return documents.overview(collections(spark, sf_dir, "3"), "3")


@query(None)
def resolve_scans(spark, sf_dir):
    """Scans of all parts, made from misread names, through candidates, zone scores, fusion, priors and classes; no SQL counterpart, held by fixtures in the tests."""
    part = spread(read_table(spark, sf_dir, "part"), "p_partkey")
    cards = part.select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.lower("p_brand").alias("set_code"), F.col("p_partkey").cast("string").alias("collector_number"),
        F.element_at(F.array(*map(F.lit, ["common", "uncommon", "rare"])), (F.col("p_size") % 3 + 1)).alias("rarity"), F.lit("en").alias("lang"), F.col("p_type").alias("type_line_full"),
        F.lit(None).cast("string").alias("rules_text"), F.lit(None).cast("string").alias("oracle_text"), F.lit("2").alias("power"), F.lit("3").alias("toughness"),
    )
    line = F.concat(F.element_at(F.array(*map(F.lit, ["C", "U", "R"])), (F.col("p_size") % 3 + 1)), F.lit(" "), F.lpad(F.col("p_partkey").cast("string"), 4, "0"))
    scans = part.select(
        F.col("p_partkey").cast("string").alias("scan_id"), F.concat(F.lit("</s>"), F.regexp_replace("p_name", "l", "1")).alias("name"), F.col("p_type").alias("type_line"), F.lit(None).cast("string").alias("rules_text"), F.lit("2/3").alias("power_toughness"), line.alias("bottom"),
        *[F.lit(0.7).alias(f"{z}_conf") for z in zones.ZONES], F.lit(None).cast("string").alias("symbol_set"),
    )
    rows = resolve.zone_scores(scans, cards)
    none = spark.createDataFrame([], "scan_id string, id string, distance int")
    done = resolve.ranked(resolve.fused(rows, none), part.select(F.col("p_partkey").cast("string").alias("id"), F.lit(0.95).alias("weight")))
    return resolve.classified(done, scans).withColumn("combined", r6("combined"))
