"""Registered queries over the driver's tables, and the DuckDB SQL each is checked against."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import year_of
from tessera.operators import bfr, cf, content, encode, itemsets, lsh, metrics, stats
from tessera.plans import tables
from tessera.session import shipped
from tessera.storage import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query, with its SQL if it has any."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = shipped(f)
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add


# Parameters.
YEAR, TOP, LINES_OVER, BASKET_OVER = 1997, 20, 600, 4
EVENT_SHARE, TRIPLE_SHARE, LINE_SHARE = 0.32, 0.2, 0.002
ITEM_BANDS, ITEM_ROWS, USER_BANDS = 8, 3, 39
ITEM_PARAMS, USER_PARAMS = lsh.hash_params(25), lsh.hash_params(40, 29)
JACCARD, LSH_JACCARD = 0.22, 0.05
CENTRES = 5
#: Ratings before these days train a model, those since test it.
ORDERS_UNTIL, EVENTS_UNTIL = "2000-12-01", "2024-01-28"

# SQL of the tables' roles.
_RATINGS = """ratings AS (
    SELECT o_custkey AS "user", l_suppkey AS item, max(l_quantity) AS stars
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"""
_EVENTS = """pairs AS (
    SELECT user_id AS "user", CAST(json_extract_string(props, '$.k') AS BIGINT) AS item, value FROM events)"""
_EVENT_RATINGS = f"""{_EVENTS}, ratings AS (
    SELECT "user", item, max(CAST(floor(value) AS BIGINT) % 5 + 1)::DOUBLE AS stars FROM pairs GROUP BY ALL)"""
_STOP = ", ".join(f"'{w}'" for w in tables.STOP_WORDS)


def _words_sql(extra: str = "") -> str:
    chars = "([,.!?:;])" + extra
    return f"""words AS (
    SELECT doc_id, source, lang, w AS word FROM (
        SELECT doc_id, source, lang,
               unnest(regexp_split_to_array(translate(lower(coalesce(text, '')), '{chars}', '{" " * len(chars)}'), '[\\s\\p{{Z}}]+')) AS w
        FROM documents) WHERE w <> '' AND w NOT IN ({_STOP}))"""


@query(f"""SELECT count(*) AS n_reviews, count(*) FILTER (year(o_orderdate) = {YEAR}) AS n_in_year,
       count(DISTINCT o_custkey) AS n_users FROM orders""")
def review_counts(spark, sf_dir):
    orders = tables.read(spark, sf_dir, "orders")
    return stats.review_counts(orders, "o_custkey", year_of(F.col("o_orderdate").cast("string")) == YEAR)


@query(f"SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT {TOP}")
def top_users(spark, sf_dir):
    return stats.top_counts(tables.read(spark, sf_dir, "orders"), "o_custkey", TOP)


@query(f"WITH {_words_sql()} SELECT word, count(*) AS n FROM words GROUP BY 1 ORDER BY n DESC, word LIMIT {TOP}")
def top_words(spark, sf_dir):
    return stats.top_words(tables.read(spark, sf_dir, "documents"), TOP, stop=tables.stop_words(spark))


@query(f"""WITH c AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS category FROM part),
    r AS (SELECT l_partkey, sum(l_quantity) AS s, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT category, round(sum(s) / sum(n), 1) AS avg_stars FROM c JOIN r ON p_partkey = l_partkey
    GROUP BY 1 ORDER BY avg_stars DESC, category LIMIT {TOP}""")
def category_avg_top(spark, sf_dir):
    lines = tables.read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), "l_quantity")
    parts = tables.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), "p_name")
    found = stats.category_average(lines, parts, "part", "l_quantity", F.split("p_name", " "))
    return found.orderBy(F.desc("avg_stars"), "category").limit(TOP)


@query("""SELECT CAST(r.range AS INTEGER) AS partition, count(o_orderkey) AS n
    FROM range(8) r LEFT JOIN orders ON ascii(substr(CAST(o_orderkey AS VARCHAR), 1, 1)) % 8 = r.range GROUP BY 1""")
def partition_stats(spark, sf_dir):
    return stats.partition_sizes(tables.read(spark, sf_dir, "orders"), "o_orderkey", 8)


@query("""SELECT CAST(r.range AS INTEGER) AS partition, count(o_orderkey) AS n
    FROM range(20) r LEFT JOIN orders ON o_orderkey % 20 = r.range GROUP BY 1""")
def partitioned_sizes(spark, sf_dir):
    dealt = stats.partitioned(tables.read(spark, sf_dir, "orders"), F.col("o_orderkey"), 20)
    return stats.physical_partition_sizes(dealt)


@query(f"SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > {LINES_OVER}")
def key_count_threshold(spark, sf_dir):
    return stats.key_count_threshold(tables.read(spark, sf_dir, "lineitem"), "l_suppkey", LINES_OVER)


@query("""SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey IN (
    SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE r_name = 'EUROPE')""")
def region_semi_join(spark, sf_dir):
    region = tables.read(spark, sf_dir, "region").where(F.col("r_name") == "EUROPE")
    nation = tables.read(spark, sf_dir, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    supplier = tables.read(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    lines = tables.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return stats.in_selected(lines, "l_suppkey", supplier.select(F.col("s_suppkey").alias("l_suppkey")))


def _shown(held: DataFrame) -> DataFrame:
    return held.select("basket", "n_rows", F.size("items").cast("long").alias("n_items"), F.array_join("items", ",").alias("items"))


def _basket_sql(basket: str, item: str, having: str = "") -> str:
    return f"""SELECT {basket} AS basket, count(*) AS n_rows, count(DISTINCT CAST({item} AS VARCHAR)) AS n_items,
        string_agg(DISTINCT CAST({item} AS VARCHAR), ',' ORDER BY CAST({item} AS VARCHAR)) AS items
        FROM lineitem GROUP BY 1 {having}"""


@query(_basket_sql("l_orderkey", "l_suppkey"))
def basket_case1(spark, sf_dir):
    return _shown(itemsets.baskets(tables.line_baskets(spark, sf_dir)))


@query(_basket_sql("l_suppkey", "l_orderkey"))
def basket_case2(spark, sf_dir):
    lines = tables.read(spark, sf_dir, "lineitem")
    return _shown(itemsets.baskets(lines.select(F.col("l_suppkey").alias("basket"), F.col("l_orderkey").alias("item"))))


@query(_basket_sql("l_orderkey", "l_suppkey", f"HAVING count(*) > {BASKET_OVER}"))
def basket_size_filter(spark, sf_dir):
    return _shown(itemsets.baskets(tables.line_baskets(spark, sf_dir), BASKET_OVER))


@query("""SELECT l_orderkey AS basket, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) AS all_items
    FROM lineitem GROUP BY 1""")
def basket_multiset(spark, sf_dir):
    held = itemsets.baskets(tables.line_baskets(spark, sf_dir), repeats=True)
    return held.select("basket", F.array_join("all_items", ",").alias("all_items"))


@query(f"""SELECT CAST(l_suppkey AS VARCHAR) AS item, count(*) AS n, count(DISTINCT l_orderkey) AS support FROM lineitem
    GROUP BY 1 HAVING count(*) >= {LINES_OVER}""")
def singleton_rows(spark, sf_dir):
    return itemsets.singletons(tables.line_baskets(spark, sf_dir), LINES_OVER)


def _support(rows: DataFrame, share: float) -> int:
    return math.ceil(share * rows.select("basket").distinct().count())


def _sets(found: DataFrame, size: int | None = None) -> DataFrame:
    out = found if size is None else found.where(F.size("items") == size)
    return out.select(F.size("items").cast("long").alias("size"), F.array_join("items", ",").alias("items"), "support")


_EVENT_SETS = f"""WITH {_EVENTS}, b AS (SELECT DISTINCT "user" AS basket, CAST(item AS VARCHAR) AS item FROM pairs),
    n AS (SELECT count(DISTINCT basket) AS n FROM b)"""


@query(f"""{_EVENT_SETS} SELECT 1::BIGINT AS size, item AS items, count(*) AS support FROM b, n
    GROUP BY item, n HAVING count(*) >= ceil({EVENT_SHARE} * n)""")
def freq_items_k1(spark, sf_dir):
    rows = tables.event_baskets(spark, sf_dir)
    return _sets(itemsets.frequent_itemsets(rows, _support(rows, EVENT_SHARE), 1))


@query(f"""{_EVENT_SETS} SELECT 2::BIGINT AS size, x.item || ',' || y.item AS items, count(*) AS support
    FROM b x JOIN b y ON x.basket = y.basket AND x.item < y.item, n
    GROUP BY x.item, y.item, n HAVING count(*) >= ceil({EVENT_SHARE} * n)""")
def freq_items_k2(spark, sf_dir):
    rows = tables.event_baskets(spark, sf_dir)
    return _sets(itemsets.frequent_itemsets(rows, _support(rows, EVENT_SHARE), 2), 2)


@query(f"""{_EVENT_SETS}, f2 AS (SELECT x.item AS i, y.item AS j FROM b x JOIN b y ON x.basket = y.basket AND x.item < y.item, n
        GROUP BY x.item, y.item, n HAVING count(*) >= ceil({TRIPLE_SHARE} * n))
    SELECT 3::BIGINT AS size, f2.i || ',' || f2.j || ',' || z.item AS items, count(*) AS support
    FROM f2 JOIN b x ON x.item = f2.i JOIN b y ON y.item = f2.j AND y.basket = x.basket
         JOIN b z ON z.basket = x.basket AND z.item > f2.j, n
    GROUP BY f2.i, f2.j, z.item, n HAVING count(*) >= ceil({TRIPLE_SHARE} * n)""")
def freq_items_k3(spark, sf_dir):
    rows = tables.event_baskets(spark, sf_dir)
    return _sets(itemsets.frequent_itemsets(rows, _support(rows, TRIPLE_SHARE), 3), 3)


# Itemsets of every size: a set with its baskets grows by a frequent item of a higher name.
_LINE_SETS = f"""WITH RECURSIVE b AS (SELECT DISTINCT l_orderkey AS basket, CAST(l_suppkey AS VARCHAR) AS item FROM lineitem),
    least AS (SELECT ceil({LINE_SHARE} * count(DISTINCT basket)) AS t FROM b),
    f AS (SELECT item, list(basket) AS held FROM b GROUP BY item HAVING count(*) >= (SELECT t FROM least)),
    grown AS (
        SELECT [item] AS s, item AS last, held FROM f
        UNION ALL
        SELECT list_append(g.s, f.item), f.item, list_intersect(g.held, f.held) FROM grown g JOIN f ON f.item > g.last
        WHERE len(list_intersect(g.held, f.held)) >= (SELECT t FROM least))
    SELECT len(s)::BIGINT AS size, array_to_string(s, ',') AS items, len(held)::BIGINT AS support FROM grown"""


@query(_LINE_SETS)
def freq_itemsets_lineitem(spark, sf_dir):
    rows = tables.line_baskets(spark, sf_dir)
    return _sets(itemsets.frequent_itemsets(rows, _support(rows, LINE_SHARE)))


@query(_LINE_SETS)
def freq_itemsets_fpgrowth(spark, sf_dir):
    rows = tables.line_baskets(spark, sf_dir)
    return _sets(itemsets.fp_growth(rows, _support(rows, LINE_SHARE)))


@query(_LINE_SETS)
def freq_itemsets_son(spark, sf_dir):
    rows = tables.line_baskets(spark, sf_dir)
    return _sets(itemsets.son(rows, _support(rows, LINE_SHARE), 4)[1])


@query()
def son_candidate_sets(spark, sf_dir):
    """Which sets are candidates depends on how baskets are dealt to parts; all frequent ones are."""
    rows = tables.line_baskets(spark, sf_dir)
    found = itemsets.son(rows, _support(rows, LINE_SHARE), 4)[0]
    return found.select(F.size("items").cast("long").alias("size"), F.array_join("items", ",").alias("items"))


def _order_sets(spark, sf_dir) -> tuple[DataFrame, int]:
    pairs = tables.order_members(spark, sf_dir)
    pairs = written(pairs, "members")
    index = encode.dense_index(pairs, "user")
    return written(pairs.join(index, "user").select(F.col("item").alias("id"), F.col("idx").alias("x")), "members"), index.count()


_PARAMS = "p AS (SELECT * FROM (VALUES {}) t(hash_no, ka, kb))"


def _params_sql(params: list[tuple[int, int]]) -> str:
    return _PARAMS.format(", ".join(f"({i}, {a}::BIGINT, {b}::BIGINT)" for i, (a, b) in enumerate(params)))


def _signature_sql(ratings: str, id_: str, x: str, params: list[tuple[int, int]]) -> str:
    return f"""WITH {ratings}, ix AS (SELECT {x} AS v, row_number() OVER (ORDER BY {x}) - 1 AS x FROM (SELECT DISTINCT {x} FROM ratings)),
    m AS (SELECT count(*) AS m FROM ix), mem AS (SELECT DISTINCT {id_} AS id, ix.x FROM ratings JOIN ix ON ix.v = {x}),
    {_params_sql(params)}, sig AS (SELECT id, hash_no, min(((ka * x + kb) % {lsh.MODULUS}) % m) AS min_hash FROM mem, p, m GROUP BY id, hash_no),
    common AS (SELECT u.id AS a, v.id AS b, count(*) AS n FROM mem u JOIN mem v ON u.x = v.x AND u.id < v.id GROUP BY ALL),
    sizes AS (SELECT id, count(*) AS n FROM mem GROUP BY id),
    sims AS (SELECT a, b, c.n AS n_ab, c.n / (x.n + y.n - c.n) AS sim FROM common c JOIN sizes x ON x.id = a JOIN sizes y ON y.id = b)"""


_ITEM_SIG = _signature_sql(_RATINGS, "item", '"user"', ITEM_PARAMS)


@query(f"{_ITEM_SIG} SELECT id, CAST(hash_no AS INTEGER) AS hash_no, min_hash FROM sig")
def minhash_signature(spark, sf_dir):
    members, m = _order_sets(spark, sf_dir)
    return lsh.signature_rows(lsh.signatures(members, ITEM_PARAMS, m))


_ITEM_CAND = f"""{_ITEM_SIG}, bands AS (SELECT id, hash_no // {ITEM_ROWS} AS band, list(min_hash ORDER BY hash_no) AS bucket
        FROM sig WHERE hash_no < {ITEM_BANDS * ITEM_ROWS} GROUP BY ALL),
    cand AS (SELECT DISTINCT u.id AS a, v.id AS b FROM bands u JOIN bands v ON u.band = v.band AND u.bucket = v.bucket AND u.id < v.id)"""


@query(f"{_ITEM_CAND} SELECT a, b FROM cand")
def lsh_candidates(spark, sf_dir):
    members, m = _order_sets(spark, sf_dir)
    return lsh.candidates(lsh.signatures(members, ITEM_PARAMS, m), ITEM_BANDS, ITEM_ROWS)


@query(f"{_ITEM_CAND} SELECT a, b, round(sim, 6) AS sim FROM sims SEMI JOIN cand USING (a, b) WHERE sim >= {LSH_JACCARD}")
def lsh_jaccard(spark, sf_dir):
    members, m = _order_sets(spark, sf_dir)
    found = lsh.jaccard(members, LSH_JACCARD, lsh.candidates(lsh.signatures(members, ITEM_PARAMS, m), ITEM_BANDS, ITEM_ROWS))
    return found.withColumn("sim", F.round("sim", 6))


@query(f"{_ITEM_SIG} SELECT a, b, round(sim, 6) AS sim FROM sims WHERE sim >= {JACCARD}")
def jaccard_exact(spark, sf_dir):
    members = tables.order_members(spark, sf_dir).select(F.col("item").alias("id"), F.col("user").alias("x"))
    return lsh.jaccard(members, JACCARD).withColumn("sim", F.round("sim", 6))


_TFIDF = f"""WITH {_words_sql("=&")}, c AS (SELECT source, word, count(*) AS n FROM words GROUP BY ALL),
    k AS (SELECT word, count(*) AS df FROM c GROUP BY 1 HAVING sum(n) > (SELECT sum(n) FROM c) * 1e-4),
    t AS (SELECT source, word, n / max(n) OVER (PARTITION BY source) AS tf FROM c),
    s AS (SELECT source, word, round(tf * log2((SELECT count(DISTINCT source) FROM documents) / df), 6) AS score FROM t JOIN k USING (word))"""
_TOP = _TFIDF + """, top AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, word) AS rank FROM s
    QUALIFY rank <= 200)"""
_USERS = _TOP + """, u AS (SELECT lang, word FROM (SELECT DISTINCT lang, source FROM documents) JOIN top USING (source) GROUP BY ALL)"""


def _scores(spark, sf_dir) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents").select("source", "text")
    # Scores are rounded so that ranks do not hang on the last bits.
    return content.tf_idf(docs, "source", "text", tables.stop_words(spark)).withColumn("score", F.round("score", 6))


@query(f"{_TFIDF} SELECT source, word, score FROM s")
def tf_idf(spark, sf_dir):
    return _scores(spark, sf_dir)


@query(f"{_TOP} SELECT source, word, score, CAST(rank AS INTEGER) AS rank FROM top")
def tfidf_top(spark, sf_dir):
    return stats.top_per_group(_scores(spark, sf_dir), "source", 200, F.desc("score"), F.col("word"))


def _users(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    pairs = tables.read(spark, sf_dir, "documents").select("lang", "source")
    items = content.item_profiles(_scores(spark, sf_dir), "source")
    return pairs, items, content.user_profiles(pairs, items, "lang", "source")


@query(f"{_USERS} SELECT lang, string_agg(word, ' ' ORDER BY word) AS words, count(*) AS n FROM u GROUP BY 1")
def user_profile(spark, sf_dir):
    users = _users(spark, sf_dir)[2]
    return users.select("lang", F.array_join("words", " ").alias("words"), F.size("words").cast("long").alias("n"))


@query(f"""{_USERS} SELECT 'business_profile' AS type, source AS profile_id, string_agg(word, ' ' ORDER BY rank) AS words FROM top GROUP BY 2
    UNION ALL SELECT 'user_profile', lang, string_agg(word, ' ' ORDER BY word) FROM u GROUP BY 2""")
def profile_model(spark, sf_dir):
    _, items, users = _users(spark, sf_dir)
    rows = content.model_rows(items, users, "source", "lang")
    return rows.select("type", "profile_id", F.array_join("profile_vector", " ").alias("words"))


@query(f"""{_USERS}, nu AS (SELECT lang, count(*) AS n FROM u GROUP BY 1), ni AS (SELECT source, count(*) AS n FROM top GROUP BY 1),
    common AS (SELECT lang, source, count(*) AS n FROM u JOIN top USING (word) GROUP BY ALL)
    SELECT lang, source, round(common.n / (sqrt(nu.n) * sqrt(ni.n)), 6) AS sim
    FROM (SELECT DISTINCT lang, source FROM documents) JOIN common USING (lang, source) JOIN nu USING (lang) JOIN ni USING (source)
    WHERE common.n / (sqrt(nu.n) * sqrt(ni.n)) >= 0.01""")
def cosine_predict(spark, sf_dir):
    pairs, items, users = _users(spark, sf_dir)
    return content.cosine(pairs.distinct(), users, items, "lang", "source").withColumn("sim", F.round("sim", 6))


def _pearson_sql(this: str, by: str, condition: str, pairs: str = "") -> str:
    return f"""mom AS (SELECT u.{this} AS a, v.{this} AS b, count(*) AS n, sum(u.stars) AS sx, sum(v.stars) AS sy, sum(u.stars * v.stars) AS sxy,
        sum(u.stars * u.stars) AS sxx, sum(v.stars * v.stars) AS syy
        FROM ratings u JOIN ratings v ON u.{by} = v.{by} AND u.{this} < v.{this} {pairs} GROUP BY ALL HAVING count(*) >= 3),
    model AS (SELECT a, b, CASE WHEN n * sxx > sx * sx AND n * syy > sy * sy
        THEN (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) ELSE 0 END AS sim FROM mom WHERE true QUALIFY {condition})"""


_ITEM_MODEL = f"WITH {_RATINGS}, {_pearson_sql('item', '"user"', 'sim > 0')}"
_USER_SIG = _signature_sql(_EVENT_RATINGS, '"user"', "item", USER_PARAMS)
_USER_MODEL = f"""{_USER_SIG}, cand AS (SELECT DISTINCT u.id AS a, v.id AS b FROM sig u JOIN sig v
        ON u.hash_no = v.hash_no AND u.min_hash = v.min_hash AND u.id < v.id WHERE u.hash_no < {USER_BANDS}),
    near AS (SELECT a, b FROM sims SEMI JOIN cand USING (a, b) WHERE n_ab >= 3 AND sim >= 0.01),
    {_pearson_sql('"user"', 'item', 'sim <> 0', 'JOIN near ON near.a = u."user" AND near.b = v."user"')}"""
_ITEM_MODEL, _USER_MODEL = (s.replace("FROM mom WHERE true QUALIFY sim", "FROM mom WHERE sim") for s in (_ITEM_MODEL, _USER_MODEL))


@query(f"{_ITEM_MODEL} SELECT a, b, round(sim, 6) AS sim FROM model")
def pearson_items(spark, sf_dir):
    return cf.item_model(tables.order_ratings(spark, sf_dir)).withColumn("sim", F.round("sim", 6))


@query(f"""WITH {_RATINGS}, m AS (SELECT item, avg(stars) AS mean FROM ratings GROUP BY 1 HAVING count(*) >= 3),
    d AS (SELECT "user", item, stars - mean AS d FROM ratings JOIN m USING (item)),
    s AS (SELECT u.item AS a, v.item AS b, sum(u.d * v.d) AS xy, sum(u.d * u.d) AS xx, sum(v.d * v.d) AS yy
        FROM d u JOIN d v ON u."user" = v."user" AND u.item < v.item GROUP BY ALL HAVING count(*) >= 3)
    SELECT a, b, round(CASE WHEN xx > 0 AND yy > 0 THEN xy / sqrt(xx * yy) ELSE 0 END, 6) AS sim FROM s""")
def pearson_items_all_means(spark, sf_dir):
    return cf.item_model_all_means(tables.order_ratings(spark, sf_dir)).withColumn("sim", F.round("sim", 6))


def _user_model(spark, sf_dir, ratings: DataFrame) -> DataFrame:
    index = encode.dense_index(ratings, "item")
    return cf.user_model(ratings, index, USER_PARAMS, index.count(), USER_BANDS)


def _user_predict(test: DataFrame, ratings: DataFrame) -> DataFrame:
    index = encode.dense_index(ratings, "item")
    return cf.user_predict_direct(test, ratings, index, USER_PARAMS, index.count(), USER_BANDS).withColumn("stars", F.round("stars", 4))


@query(f"{_USER_MODEL} SELECT a, b, round(sim, 6) AS sim FROM model")
def pearson_users(spark, sf_dir):
    return _user_model(spark, sf_dir, written(tables.event_ratings(spark, sf_dir), "ratings")).withColumn("sim", F.round("sim", 6))


def _item_predict_sql(model: str, test: str = "ratings") -> str:
    return f"""{model}, e AS (SELECT t."user", t.item, r.item AS other, r.stars AS r,
        coalesce(m.sim, 0) AS w FROM {test} t JOIN ratings r ON t."user" = r."user"
        LEFT JOIN model m ON m.a = least(t.item, r.item) AND m.b = greatest(t.item, r.item)
        WHERE t.item IN (SELECT item FROM ratings)),
    k AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY "user", item ORDER BY w DESC, r DESC, other) <= 6),
    s AS (SELECT "user", item, sum(r * w) AS top, sum(abs(w)) AS low FROM k GROUP BY ALL),
    mean AS (SELECT "user", avg(stars) AS mean FROM ratings GROUP BY 1)
    SELECT "user", item, round(CASE WHEN top <> 0 AND low <> 0 THEN top / low ELSE mean END, 4) AS stars FROM s JOIN mean USING ("user")"""


def _user_predict_sql(model: str, test: str = "ratings") -> str:
    return f"""{model}, su AS (SELECT "user", sum(stars) AS s, count(*) AS n, avg(stars) AS mean FROM ratings GROUP BY 1),
    d AS (SELECT "user" AS other, item, stars - CASE WHEN n > 1 THEN (s - stars) / (n - 1) ELSE 0 END AS dev FROM ratings JOIN su USING ("user")),
    e AS (SELECT t."user", t.item, sum(dev * coalesce(m.sim, 0)) AS top, sum(abs(coalesce(m.sim, 0))) AS low FROM {test} t JOIN d ON d.item = t.item
        LEFT JOIN model m ON m.a = least(t."user", d.other) AND m.b = greatest(t."user", d.other) GROUP BY ALL)
    SELECT "user", item, round(least(mean + CASE WHEN top <> 0 AND low <> 0 THEN top / low ELSE 0 END, 5.0), 4) AS stars
    FROM e JOIN su USING ("user")"""


@query(_item_predict_sql(_ITEM_MODEL))
def item_cf_predict(spark, sf_dir):
    ratings = written(tables.order_ratings(spark, sf_dir), "ratings")
    found = cf.item_predict(ratings.select("user", "item"), ratings, cf.item_model(ratings))
    return found.withColumn("stars", F.round("stars", 4))


@query(_user_predict_sql(_USER_MODEL))
def user_cf_predict(spark, sf_dir):
    ratings = written(tables.event_ratings(spark, sf_dir), "ratings")
    return _user_predict(ratings.select("user", "item"), ratings)


# Ratings in order of time, of which a user and item keep the last or the first.
_HISTORY = """history AS (
    SELECT o_custkey AS "user", l_suppkey AS item, l_quantity AS stars, o_orderdate AS day, l_orderkey, l_linenumber
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_PICK = """(SELECT "user", item, stars FROM history {}
    QUALIFY row_number() OVER (PARTITION BY "user", item ORDER BY day {o}, l_orderkey {o}, l_linenumber {o}, stars {o}) = 1)"""
_TIMES = ("day", "l_orderkey", "l_linenumber")


@query(f"WITH {_HISTORY} FROM {_PICK.format('', o='DESC')}")
def latest_ratings(spark, sf_dir):
    return cf.latest(tables.order_history(spark, sf_dir), *_TIMES)


@query(f"WITH {_HISTORY} FROM {_PICK.format('', o='ASC')}")
def first_ratings(spark, sf_dir):
    return cf.earliest(tables.order_history(spark, sf_dir), *_TIMES)


_ITEM_TRAIN = f"""{_HISTORY}, ratings AS (FROM {_PICK.format(f"WHERE day < DATE '{ORDERS_UNTIL}'", o='DESC')}),
    test AS (SELECT DISTINCT "user", item FROM history WHERE day >= DATE '{ORDERS_UNTIL}')"""
_EVENT_TRAIN = f"""pairs AS (SELECT user_id AS "user", CAST(json_extract_string(props, '$.k') AS BIGINT) AS item, value, ts, event_id FROM events),
    ratings AS (SELECT "user", item, (CAST(floor(value) AS BIGINT) % 5 + 1)::DOUBLE AS stars FROM pairs WHERE ts < TIMESTAMP '{EVENTS_UNTIL}'
        QUALIFY row_number() OVER (PARTITION BY "user", item ORDER BY ts DESC, event_id DESC, stars DESC) = 1),
    test AS (SELECT DISTINCT "user", item FROM pairs WHERE ts >= TIMESTAMP '{EVENTS_UNTIL}')"""


def _unknown(test: DataFrame) -> DataFrame:
    """*test* with a user and an item that no rating has."""
    spark, (one, two) = test.sparkSession, test.columns
    more = spark.createDataFrame([(-1, 1), (1, -1), (-1, -1)], f"{one} long, {two} long")
    return test.unionByName(more)


@query(_item_predict_sql(_ITEM_MODEL.replace(_RATINGS, _ITEM_TRAIN), "test"))
def item_cf_holdout(spark, sf_dir):
    history = tables.order_history(spark, sf_dir)
    train = written(cf.latest(history.where(F.col("day") < F.lit(ORDERS_UNTIL).cast("date")), *_TIMES), "ratings")
    test = history.where(F.col("day") >= F.lit(ORDERS_UNTIL).cast("date")).select("user", "item").distinct()
    return cf.item_predict(_unknown(test), train, cf.item_model(train)).withColumn("stars", F.round("stars", 4))


@query(_user_predict_sql(_USER_MODEL.replace(_EVENT_RATINGS, _EVENT_TRAIN), "test"))
def user_cf_holdout(spark, sf_dir):
    history = tables.event_history(spark, sf_dir)
    until = F.lit(EVENTS_UNTIL).cast("timestamp")
    train = written(cf.latest(history.where(F.col("ts") < until), "ts", "event_id"), "ratings")
    test = history.where(F.col("ts") >= until).select("user", "item").distinct()
    return _user_predict(_unknown(test), train)


_POINTS = """pts AS (SELECT vec_id AS point_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)"""
_SUMMARY = f"""WITH {_POINTS}, s AS (SELECT label, dim, count(*) AS n, sum(v) AS sum, sum(v * v) AS sumsq FROM pts GROUP BY ALL),
    c AS (SELECT *, sum / n AS mean, sqrt(greatest(sumsq / n - (sum / n) * (sum / n), 0)) AS std FROM s)"""


@query(f"""{_SUMMARY} SELECT label, CAST(dim AS INTEGER) AS dim, n, round(sum, 6) AS sum, round(sumsq, 6) AS sumsq FROM c""")
def cluster_summary(spark, sf_dir):
    found = bfr.cluster_summary(tables.points(spark, sf_dir), "label")
    return found.select("label", "dim", "n", F.round("sum", 6).alias("sum"), F.round("sumsq", 6).alias("sumsq"))


@query(f"{_SUMMARY} SELECT label, CAST(dim AS INTEGER) AS dim, round(mean, 6) AS mean, round(std, 6) AS std FROM c")
def cluster_std(spark, sf_dir):
    found = bfr.cluster_summary(tables.points(spark, sf_dir), "label")
    return found.select("label", "dim", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(f"""{_SUMMARY}, d AS (SELECT point_id, c.label AS cluster, sqrt(sum(((v - mean) / std) * ((v - mean) / std))) AS distance, count(*) AS dims
        FROM pts JOIN c ON c.dim = pts.dim GROUP BY ALL),
    b AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY distance, cluster) AS r FROM d)
    SELECT point_id, CASE WHEN distance < 3 * sqrt(dims - 1) THEN cluster ELSE -1 END AS cluster, round(distance, 4) AS distance FROM b WHERE r = 1""")
def mahalanobis_assign(spark, sf_dir):
    points = tables.points(spark, sf_dir)
    sets = bfr.collect_summaries(points, "label")
    keys = sorted(sets)
    means, sigmas = np.array([sets[c].mean for c in keys]), np.array([sets[c].sigma for c in keys])
    found = bfr.nearest(points.select("point_id", "features"), means, sigmas, 3 * (means.shape[1] - 1) ** 0.5)
    number = F.element_at(F.array(*[F.lit(c) for c in keys]), F.col("cluster") + 1)
    return found.select("point_id", F.when(F.col("cluster") >= 0, number).otherwise(F.lit(-1)).alias("cluster"), F.round("distance", 4).alias("distance"))


_STEP = f"""WITH {_POINTS}, centre AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS cluster, embedding FROM embeddings
        QUALIFY row_number() OVER (ORDER BY vec_id) <= {CENTRES}),
    cv AS (SELECT cluster, unnest(embedding)::DOUBLE AS cv, generate_subscripts(embedding, 1) - 1 AS dim FROM centre),
    d AS (SELECT point_id, cluster, sum((v - cv) * (v - cv)) AS d FROM pts JOIN cv ON cv.dim = pts.dim GROUP BY ALL),
    a AS (SELECT point_id, CAST(cluster AS INTEGER) AS cluster FROM d QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY d, cluster) = 1)"""


def _step(spark, sf_dir) -> DataFrame:
    points = tables.points(spark, sf_dir)
    first = points.orderBy("point_id").limit(CENTRES).collect()
    return bfr.nearest(points, np.array([r.features for r in first]))


@query(f"{_STEP} SELECT cluster, CAST(dim AS INTEGER) AS dim, count(*) AS n, round(avg(v), 6) AS mean FROM a JOIN pts USING (point_id) GROUP BY ALL")
def kmeans_step(spark, sf_dir):
    found = bfr.cluster_summary(_step(spark, sf_dir))
    return found.select("cluster", "dim", "n", F.round("mean", 6).alias("mean"))


@query()
def bfr_rounds(spark, sf_dir):
    points = tables.points(spark, sf_dir)
    chunks = [points.where(F.pmod("point_id", F.lit(4)) == i) for i in range(4)]
    return bfr.run(chunks, CENTRES).round_table(spark)


@query()
def bfr_assignment(spark, sf_dir):
    points = tables.points(spark, sf_dir)
    chunks = [points.where(F.pmod("point_id", F.lit(4)) == i) for i in range(4)]
    return bfr.run(chunks, CENTRES).assignment()


@query(f"""{_STEP}, j AS (SELECT e.label AS x, a.cluster AS y FROM a JOIN embeddings e ON e.vec_id = a.point_id),
    t AS (SELECT count(*) AS n FROM j), p AS (SELECT x, y, count(*) / max(t.n) AS p FROM j, t GROUP BY x, y),
    px AS (SELECT x, sum(p) AS px FROM p GROUP BY 1), py AS (SELECT y, sum(p) AS py FROM p GROUP BY 1)
    SELECT round((SELECT sum(p * ln(p / (px * py))) FROM p JOIN px USING (x) JOIN py USING (y))
        / (((SELECT -sum(px * ln(px)) FROM px) + (SELECT -sum(py * ln(py)) FROM py)) / 2), 6) AS nmi""")
def nmi(spark, sf_dir):
    found = _step(spark, sf_dir)
    return metrics.nmi(found, found.select("point_id", F.col("cluster").alias("label"))).select(F.round("nmi", 6).alias("nmi"))


@query(f"{_STEP} SELECT cluster AS label, count(*) AS n FROM a GROUP BY 1")
def cluster_sizes(spark, sf_dir):
    return metrics.cluster_sizes(_step(spark, sf_dir).select(F.col("cluster").alias("label")))
