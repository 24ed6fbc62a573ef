"""Queries over filters, projections, sets, text and numbers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from frostline.functions import numbers, text
from frostline.operators import filters
from frostline.operators.ids import dense_remap, hash_order
from frostline.plans.base import IX, SP, h, pairs, query, scored_pairs
from frostline.plans.measures import _EDGE, _edges
from frostline.sources import sinks, tables
from frostline.sources.storage import new_path
from frostline.sources.tables import table

_FLAG = "CASE event_id % 5 WHEN 0 THEN 'true' WHEN 1 THEN ' TRUE' WHEN 2 THEN '1' WHEN 3 THEN 'no' ELSE 'Yes ' END"


@query(f"SELECT event_id FROM events WHERE lower(trim({_FLAG})) IN ('true', '1', 'yes')")
def verified_rows(spark, d):
    b = F.col("event_id") % 5
    flag = F.when(b == 0, "true").when(b == 1, " TRUE").when(b == 2, "1").when(b == 3, "no").otherwise("Yes ")
    return table(spark, d, "events").where(filters.truthy(flag)).select("event_id")


@query("""WITH r AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN '  ' ELSE 'u' || user_id END AS u, CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 4 = 1 THEN NULL ELSE ' p' || event_id % 50 END AS parent, CASE WHEN event_id % 12 = 0 THEN ' ' ELSE 'a' || event_id % 50 END AS own FROM events)
SELECT event_id, trim(u) AS user_key, coalesce(nullif(trim(parent), ''), nullif(trim(own), '')) AS item_key FROM r WHERE trim(u) <> '' AND coalesce(nullif(trim(parent), ''), nullif(trim(own), '')) IS NOT NULL""")
def keyed_reviews(spark, d):
    """Reviews with a user and an item: the item's parent, else its own number; blank ones go."""
    e = F.col("event_id")
    n = (e % 50).cast("string")
    r = table(spark, d, "events").select("event_id", F.when(e % 11 == 0, "  ").otherwise(F.concat(F.lit("u"), "user_id")).alias("u"), F.when(e % 4 == 0, "").when(e % 4 > 1, F.concat(F.lit(" p"), n)).alias("parent"), F.when(e % 12 == 0, " ").otherwise(F.concat(F.lit("a"), n)).alias("own"))
    return r.select("event_id", filters.first_key("u").alias("user_key"), filters.first_key("parent", "own").alias("item_key")).where("user_key is not null and item_key is not null")


@query(f"WITH {IX} SELECT user_id, item_id FROM ix WHERE item_id IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def metadata_present(spark, d):
    """Pairs whose item has metadata (parts above size 10 stand for it)."""
    known = table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("item_id"))
    return filters.visible(pairs(spark, d), known, "item_id")


@query(f"WITH {SP} SELECT user_id - 10 AS user_id, item_id - 10 AS item_id, llm FROM sp WHERE user_id - 10 BETWEEN 0 AND 99 AND item_id - 10 BETWEEN 0 AND 149")
def prior_in_range(spark, d):
    shifted = scored_pairs(spark, d).select((F.col("user_id") - 10).alias("user_id"), (F.col("item_id") - 10).alias("item_id"), "llm")
    return filters.in_range(shifted, user_id=100, item_id=150)


@query(f"WITH {IX}, s AS (SELECT user_id, item_id FROM ix WHERE {h('item_id', 'k')} % 3 = 0 AND {h('user_id', 'k')} % 3 = 0) SELECT user_id, item_id, dense_rank() OVER (ORDER BY user_id) - 1 AS user_no, dense_rank() OVER (ORDER BY item_id) - 1 AS item_no FROM s")
def second_remap(spark, d):
    """Ids made dense again after a sample of users and items."""
    kept = pairs(spark, d).where((hash_order(F.col("item_id"), "k") % 3 == 0) & (hash_order(F.col("user_id"), "k") % 3 == 0))
    return dense_remap(dense_remap(kept, "user_id", "user_no"), "item_id", "item_no").select("user_id", "item_id", "user_no", "item_no")


@query(f"WITH {SP} SELECT user_id, item_id, '' AS entity_type, coalesce(CASE WHEN llm >= 0.1 THEN llm END, 1.0::DOUBLE) AS probability, coalesce(CASE WHEN llm >= 0.1 THEN llm END, 1.0::DOUBLE) AS candidate_score FROM sp UNION ALL SELECT user_id, item_id, entity_type, 1.0::DOUBLE, emb FROM sp")
def candidate_defaults(spark, d):
    """Two tables under other names, with columns missing, as candidates."""
    sp = scored_pairs(spark, d)
    one = sp.select(F.col("user_id").alias("uid"), F.col("item_id").alias("iid"), F.when(F.col("llm") >= 0.1, F.col("llm")).alias("prob"))
    two = sp.select(F.col("user_id").alias("User"), F.col("item_id").alias("Item"), "entity_type", F.col("emb").alias("embedding_score"))
    return filters.with_defaults(one).union(filters.with_defaults(two))


@query("SELECT p_partkey AS item_id, p_name AS title FROM part")
def inferred_title(spark, d):
    """The title column of a table, found by its name."""
    part = table(spark, d, "part")
    return part.select(F.col("p_partkey").alias("item_id"), F.col(filters.found_name(part, "title")).alias("title"))


@query("SELECT * FROM (VALUES ('files', 'item'), ('flag', 'user'), ('meta', 'user')) t(known_by, side)")
def cold_side(spark, d):
    """Which side is cold: by the files there are, by a flag, by a summary."""
    path, p = new_path(spark, "side"), pairs(spark, d)
    sinks.write_pairs(p.where("user_id % 5 = 0"), f"{path}/a/cold_item_test.csv")
    table(spark, d, "region").limit(1).select(F.lit('{"cold_object": "user"}').alias("value")).write.text(f"{path}/b/split_meta.json")
    rows = [("files", tables.cold_side(spark, f"{path}/a")), ("flag", tables.cold_side(spark, f"{path}/a", "user")), ("meta", tables.cold_side(spark, f"{path}/b"))]
    return spark.createDataFrame(rows, "known_by string, side string")


@query(f"WITH {_EDGE} SELECT ix.user_id, ix.item_id, round(CASE WHEN w - 0.9::DOUBLE > 0 THEN w - 0.9::DOUBLE ELSE 1 END, 6) AS w FROM ix LEFT JOIN ew USING (user_id, item_id)")
def pair_weights(spark, d):
    """Weights of pairs from the weighted graph (less 0.9, so that some aren't above 0)."""
    w = _edges(spark, d).withColumn("w", F.col("w") - 0.9)
    return filters.pair_weights(pairs(spark, d), w).select("user_id", "item_id", F.round("w", 6).alias("w"))


@query(f"WITH {SP} SELECT entity_type, llm >= 0.5 AS high, count(*) AS n FROM sp GROUP BY 1, 2")
def value_counts(spark, d):
    return scored_pairs(spark, d).groupBy("entity_type", (F.col("llm") >= 0.5).alias("high")).agg(F.count("*").alias("n"))


@query(f"WITH {SP}, r AS (SELECT entity_type, user_id, row_number() OVER (PARTITION BY entity_type, user_id ORDER BY emb DESC, item_id) AS r FROM sp), g AS (SELECT entity_type, user_id, count(*) AS n FROM r WHERE r <= 20 GROUP BY 1, 2) SELECT entity_type, count(*) AS groups, count(*) FILTER (WHERE n = 20) AS full_groups, min(n) AS least FROM g GROUP BY 1")
def full_groups(spark, d):
    """How many groups of a top-20 list have exactly 20 rows."""
    w = Window.partitionBy("entity_type", "user_id").orderBy(F.col("emb").desc(), "item_id")
    g = scored_pairs(spark, d).withColumn("r", F.row_number().over(w)).where("r <= 20").groupBy("entity_type", "user_id").agg(F.count("*").alias("n"))
    return g.groupBy("entity_type").agg(F.count("*").alias("groups"), F.count(F.when(F.col("n") == 20, 1)).alias("full_groups"), F.min("n").alias("least"))


@query(f"WITH {SP} SELECT DISTINCT item_id FROM (SELECT item_id FROM sp WHERE llm >= 0.95 UNION ALL SELECT item_id FROM sp WHERE emb >= 0.99 UNION ALL SELECT p_partkey FROM part WHERE p_size = 1)")
def mask_union(spark, d):
    sp, part = scored_pairs(spark, d), table(spark, d, "part")
    return sp.where("llm >= 0.95").select("item_id").union(sp.where("emb >= 0.99").select("item_id")).union(part.where("p_size = 1").select("p_partkey")).distinct()


@query("SELECT p_partkey AS item_id, [x FOR x, i IN l IF list_position(l, x) = i] AS kept, [x FOR x, i IN l IF list_position(l, x) = i AND NOT list_contains(t, x)] AS others FROM (SELECT p_partkey, string_split(p_name || ' ' || lower(p_type), ' ') AS l, string_split(p_name, ' ') AS t FROM part)")
def array_sets(spark, d):
    """Words once each, in order, and those that another list lacks."""
    words = F.split(F.concat("p_name", F.lit(" "), F.lower("p_type")), " ")
    return table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.array_distinct(words).alias("kept"), F.array_except(words, F.split("p_name", " ")).alias("others"))


@query("SELECT p_partkey AS item_id, 'brand: ' || p_brand || '; size: ' || p_size || '; type: ' || p_type AS details, array_to_string(string_split(p_name || ' ' || p_type, ' ')[1:4], '; ') AS features FROM part")
def stringified(spark, d):
    details = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"), F.lit("type"), F.col("p_type"))
    words = F.split(F.concat_ws(" ", "p_name", "p_type"), " ")
    return table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), text.map_text(details).alias("details"), text.list_text(words, 4).alias("features"))


@query("""SELECT p_partkey AS item_id, 'brand: ' || p_brand || '; dims: size: ' || p_size || '; price: ' || CAST(round(p_retailprice, 1) AS VARCHAR) || '; deep: words: ' || array_to_string(string_split(p_name || ' a b c d e', ' ')[1:4], '; ') || '; big: ' || CASE WHEN p_size > 25 THEN 'True' ELSE 'False' END || '; lists: ' || p_type || '; {"k":"' || p_brand || '"}; 7' AS details FROM part""")
def nested_details(spark, d):
    """Nested JSON as text: objects, lists and scalars, the first eight outermost parts and four of each deeper level."""
    words = F.split(F.concat("p_name", F.lit(" a b c d e")), " ")
    dims = F.struct(F.col("p_size").alias("size"), F.round(F.col("p_retailprice").cast("double"), 1).alias("price"), F.struct(words.alias("words"), (F.col("p_size") > 25).alias("big")).alias("deep"))
    quoted = F.concat(F.lit('{"k":"'), "p_brand", F.lit('"}'))  # a string, though it looks like an object
    rows = F.struct(F.col("p_brand").alias("brand"), dims.alias("dims"))
    lists = F.concat(F.lit('["'), "p_type", F.lit('",'), F.to_json(F.struct(quoted.alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(quoted.alias("x")))) - 6), F.lit(",7]"))
    whole = F.concat(F.expr("substr(x, 1, length(x) - 1)"), F.lit(',"lists":'), F.col("l"), F.lit("}"))
    parts = table(spark, d, "part").repartition(4 * spark.sparkContext.defaultParallelism)  # a file of few bytes is one task, and parsing is dear
    return parts.select(F.col("p_partkey").alias("item_id"), F.to_json(rows).alias("x"), lists.alias("l")).select("item_id", text.nested_text(whole).alias("details"))


@query("SELECT conv_id, turn, role, CASE WHEN length(t) > 80 THEN substr(t, 1, 77) || '...' ELSE t END AS short FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations)")
def shortened_text(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", "role", text.shortened(F.col("text"), 80).alias("short"))


@query("SELECT p_partkey AS item_id, lower(p_name) || CASE WHEN p_size % 3 = 0 THEN '' ELSE ' year_' || (1950 + p_size) END AS doc FROM part")
def doc_years(spark, d):
    """Titles and a token of the year in their brackets; a third has none."""
    title = F.concat("p_name", F.when(F.col("p_size") % 3 == 0, "").otherwise(F.concat(F.lit(" ("), (F.col("p_size") + 1950).cast("string"), F.lit(")"))))
    token = text.year_token(title)
    return table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.concat(F.lower("p_name"), F.when(token == "", "").otherwise(F.concat(F.lit(" "), token))).alias("doc"))


#: What codes of a profile stand for.
AGES = {0: "under 18", 1: "18 to 24", 2: "25 to 34", 3: "35 to 44", 4: "45 to 55", 5: "56 or older"}
REGIONS = {0: "Africa", 1: "America", 2: "Asia", 3: "Europe", 4: "the Middle East"}


@query("SELECT c_custkey AS user_id, 'A customer ' || " + f"CASE c_custkey % 7 {' '.join(f'WHEN {k} THEN {v!r}' for k, v in AGES.items())} ELSE 'of unknown age' END || ' from ' || CASE n_regionkey {' '.join(f'WHEN {k} THEN {v!r}' for k, v in REGIONS.items())} END AS profile FROM customer JOIN nation ON c_nationkey = n_nationkey")
def profile_codes(spark, d):
    """Profiles from codes."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    age, region = text.coded((F.col("c_custkey") % 7).cast("int"), AGES, "of unknown age"), text.coded(F.col("n_regionkey").cast("int"), REGIONS)
    return c.select(F.col("c_custkey").alias("user_id"), F.concat(F.lit("A customer "), age, F.lit(" from "), region).alias("profile"))


@query("SELECT p_partkey AS item_id, replace(printf('%.2f', p_size / 4.0::DOUBLE), '.', 'p') AS tag, regexp_replace(p_name || '/' || p_type || ' #1', '[^A-Za-z0-9_.-]+', '_', 'g') AS stem FROM part")
def file_tags(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), text.float_tag(F.col("p_size") / 4.0).alias("tag"), text.safe_stem(F.concat("p_name", F.lit("/"), "p_type", F.lit(" #1"))).alias("stem"))


_NAMES = ["strict_recall@20", "cold_ndcg@20", " strict_cold_recall@5", "warmup_precision@10", "recall@20", "warm_val_ndcg@50", "nothing"]


@query(f"SELECT n_name || ':' || x AS name, CASE WHEN regexp_extract(trim(x), '^(?:(.*)_)?([a-z]+)@([0-9]+)$', 1) IN ('strict', 'cold', 'strict_cold') THEN 'strict_cold' WHEN regexp_extract(trim(x), '^(?:(.*)_)?([a-z]+)@([0-9]+)$', 1) = '' THEN 'overall' ELSE regexp_extract(trim(x), '^(?:(.*)_)?([a-z]+)@([0-9]+)$', 1) END AS split, regexp_extract(trim(x), '^(?:(.*)_)?([a-z]+)@([0-9]+)$', 2) AS metric, try_cast(regexp_extract(trim(x), '^(?:(.*)_)?([a-z]+)@([0-9]+)$', 3) AS INTEGER) AS k FROM nation, (SELECT unnest({_NAMES}) AS x)")
def metric_names(spark, d):
    rows = table(spark, d, "nation").select("n_name", F.explode(F.array(*map(F.lit, _NAMES))).alias("x"))
    return rows.select(F.concat("n_name", F.lit(":"), "x").alias("name"), text.metric_parts(F.col("x")).alias("p")).select("name", "p.split", "p.metric", "p.k")


@query("SELECT p_partkey AS item_id, CAST(p_size AS INTEGER) AS size, p_brand AS brand FROM part")
def key_values(spark, d):
    """Text as name=value lists, read as a map."""
    m = text.key_values(F.concat(F.lit("size = "), F.col("p_size").cast("string"), F.lit(", brand="), "p_brand", F.lit(",")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), m.alias("m")).select("item_id", F.col("m")["size"].cast("int").alias("size"), F.col("m")["brand"].alias("brand"))


@query("SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) END AS day FROM events")
def parsed_dates(spark, d):
    """Days from text; each ninth isn't one."""
    x = F.when(F.col("event_id") % 9 == 0, F.lit("31.01.2024")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return table(spark, d, "events").select("event_id", text.parsed_date(x).cast("timestamp_ntz").alias("day"))


@query("WITH x AS (SELECT event_id, user_id, (value - 5) * 8 AS x FROM events), e AS (SELECT *, exp(x - max(x) OVER (PARTITION BY user_id)) AS e FROM x) SELECT event_id, round(1 / (1 + exp(-x)), 6) AS sigmoid, round(greatest(x, 0) + ln(1 + exp(-abs(x))), 6) AS softplus, round(e / sum(e) OVER (PARTITION BY user_id), 6) AS softmax FROM e")
def activations(spark, d):
    x = (F.col("value") - 5) * 8
    e = table(spark, d, "events").select("event_id", "user_id", x.alias("x"))
    return e.select("event_id", F.round(numbers.sigmoid(F.col("x")), 6).alias("sigmoid"), F.round(numbers.softplus(F.col("x")), 6).alias("softplus"), F.round(numbers.softmax(F.col("x"), Window.partitionBy("user_id")), 6).alias("softmax"))


@query(f"WITH {SP}, r AS (SELECT user_id, item_id, llm, row_number() OVER (PARTITION BY user_id ORDER BY llm DESC, item_id) AS r FROM sp), k AS (SELECT *, count(*) OVER w AS n, min(llm) OVER w AS lo, max(llm) OVER w AS hi FROM r WHERE r <= 10 WINDOW w AS (PARTITION BY user_id)) SELECT user_id, item_id, 1.0::DOUBLE AS constant, round(1 / r::DOUBLE, 6) AS reciprocal, round(CASE WHEN hi > lo THEN 0.2::DOUBLE + 0.8::DOUBLE * (llm - lo) / (hi - lo) ELSE 1 END, 6) AS minmax, round(CASE WHEN n <= 1 THEN 1 ELSE 1 - 0.8::DOUBLE * (r - 1) / (n - 1) END, 6) AS linear FROM k")
def prior_probabilities(spark, d):
    """Four ways from rank or score to a probability."""
    w = Window.partitionBy("user_id")
    k = scored_pairs(spark, d).withColumn("r", F.row_number().over(w.orderBy(F.col("llm").desc(), "item_id"))).where("r <= 10").withColumn("n", F.count("*").over(w))
    return k.select("user_id", "item_id", *[F.round(numbers.rank_probability(F.col("r"), F.col("n"), F.col("llm"), m, 0.2, w), 6).alias(m) for m in ("constant", "reciprocal", "minmax", "linear")])


#: Templates of prompts by kind of item.
TEMPLATES = {
    "paper": 'A reader has cited: {history}. Would they cite the paper "{title}"?',
    "movie": 'A viewer liked: {history}. Would they like the movie "{title}" ({genres})?',
    "book": 'A reader finished: {history}. Would they like the book "{title}"?',
    "product": 'A buyer ordered: {history}. Would they order the product "{title}" by {brand}?',
}


@query("WITH f AS (SELECT c_custkey AS user_id, c_name, (c_custkey * 7) % (SELECT max(p_partkey) + 1 FROM part) AS item_id FROM customer) SELECT user_id, p_partkey AS item_id, kind, CASE kind " + " ".join(f"WHEN '{k}' THEN '{v.split('{history}')[0]}' || c_name || '" + v.split("{history}")[1].replace("{title}", "' || p_name || '").replace("{genres}", "' || replace(p_type, ' ', ', ') || '").replace("{brand}", "' || p_brand || '") + "'" for k, v in TEMPLATES.items()) + " END AS prompt FROM f JOIN part ON p_partkey = item_id, (SELECT unnest(['paper', 'movie', 'book', 'product']) AS kind)")
def prompt_variants(spark, d):
    """Prompts of four kinds of items from templates."""
    n = table(spark, d, "part").agg(F.max("p_partkey") + 1).first()[0]
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name", ((F.col("c_custkey") * 7) % n).alias("item_id"))
    both = users.join(table(spark, d, "part"), F.col("p_partkey") == F.col("item_id"))
    parts = {"history": F.col("c_name"), "title": F.col("p_name"), "genres": F.array_join(F.split("p_type", " "), ", "), "brand": F.col("p_brand")}
    forms = F.array(*[F.struct(F.lit(k).alias("kind"), text.rendered(t, **parts).alias("prompt")) for k, t in TEMPLATES.items()])
    return both.select("user_id", "item_id", F.explode(forms).alias("x")).select("user_id", "item_id", "x.kind", "x.prompt")
