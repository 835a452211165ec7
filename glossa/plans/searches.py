"""Queries of lookups, inverted indexes, federated lists, menus, references and private characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.normalize import ASCII_WIDE, mapped
from ..operators import boundary as B
from ..operators import links as L
from ..operators import lookup as K
from ..operators import postings as W
from ..operators import private_chars as G
from ..operators import reading as R
from ..operators.runs import next_different, running_total
from .corpora import HEADWORDS, LOWER, SOURCES, UPPER, WORD_QUERIES, headwords, kana, sources, sql_map, word_queries
from .corpora import KANA_SQL
from .registry import query, table


def _hits(on: str, key: str = "key", identity: str = "text, heading", queries: str = WORD_QUERIES) -> str:
    return f"SELECT query, {identity}, min(ord) AS ord FROM {queries} q JOIN {HEADWORDS} h ON {on} GROUP BY query, {identity}"


def _ranked(sql: str, n: int = 30) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY ord)::INT AS rank FROM ({sql})) WHERE rank <= {n}"


@query(_ranked(_hits("starts_with(key, word)")))
def search_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.search(word_queries(spark, sf_dir), headwords(spark, sf_dir))


WHOLE_WORDS = f"(SELECT DISTINCT key AS word, key AS query FROM {HEADWORDS})"


@query(_ranked(_hits("key = word", queries=WHOLE_WORDS)))
def search_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = headwords(spark, sf_dir).select(F.col("key").alias("word")).distinct().withColumn("query", F.col("word"))
    return K.search(words, headwords(spark, sf_dir), exact=True)


@query(_ranked(_hits("starts_with(key_rev, word)", queries=WORD_QUERIES.replace("left(key", "left(key_rev"))))
def search_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words backwards against keys backwards: an equality join where endswith would read every key."""
    h = headwords(spark, sf_dir)
    words = h.select(F.substring("key_rev", F.lit(1), (F.col("ord") % 3 + 3).cast("int")).alias("word")).distinct()
    return K.search(words.withColumn("query", F.col("word")), h, key="key_rev")


@query(_ranked(f"SELECT '*' || query AS query, text, heading, ord FROM ({_hits('suffix(key, word)')}) UNION ALL SELECT query || '*', text, heading, ord FROM ({_hits('starts_with(key, word)')})"))
def search_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns with a star at either end: each goes to the keys or to the keys backwards."""
    from ..functions.matching import parsed_pattern

    h = headwords(spark, sf_dir)
    words = word_queries(spark, sf_dir).select("word")
    patterns = words.select(F.explode(F.array(F.concat(F.lit("*"), "word"), F.concat("word", F.lit("*")))).alias("query"))
    asked = patterns.select("query", parsed_pattern(F.col("query")).alias("p")).where("p.error IS NULL")
    forward = asked.where("NOT p.backward").select("query", F.col("p.word").alias("word"))
    backward = asked.where("p.backward").select("query", F.reverse("p.word").alias("word"))
    return K.search(forward, h).unionByName(K.search(backward, h, key="key_rev"))


@query(_hits("starts_with(key, word)", identity="text"))
def search_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kana indexes: hits are the same when their text is, whatever the heading."""
    return K.search(word_queries(spark, sf_dir), headwords(spark, sf_dir), identity=("text",), limit=None)


@query(_ranked(_hits("starts_with(key, word)"), 3))
def search_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.search(word_queries(spark, sf_dir), headwords(spark, sf_dir), limit=3)


@query(f"SELECT ord, key, text, heading FROM {HEADWORDS}")
def scan_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headwords(spark, sf_dir).select("ord", "key", "text", "heading").orderBy("ord")


#: Each brand is a subbook with one to three of the indexes.
INDEXES = "(SELECT DISTINCT p_brand AS subbook, unnest(CASE substr(p_brand, 7)::INT % 3 WHEN 0 THEN ['word_asis'] WHEN 1 THEN ['word_asis', 'word_alphabet', 'endword_asis'] ELSE ['word_kana', 'endword_kana'] END) AS name FROM part)"
KINDS = f"(SELECT DISTINCT query, backward, CASE kind WHEN 0 THEN 'kana' WHEN 1 THEN 'alphabet' ELSE 'other' END AS class FROM (SELECT CASE p_partkey % 3 WHEN 0 THEN {KANA_SQL} WHEN 1 THEN {sql_map('p_name', ASCII_WIDE)} ELSE {KANA_SQL} || '本' END AS query, p_partkey % 3 AS kind, p_size % 2 = 0 AS backward FROM part))"


@query(
    f"""SELECT query, backward, subbook, arg_min(name, preference) AS index_name FROM (
        SELECT *, CASE WHEN name LIKE '%asis' THEN 1 ELSE 0 END AS preference FROM {KINDS} q JOIN {INDEXES} i
        ON name IN ((CASE WHEN backward THEN 'endword_' ELSE 'word_' END) || class, (CASE WHEN backward THEN 'endword_' ELSE 'word_' END) || 'asis')) GROUP BY ALL"""
)
def index_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    n, k = F.col("p_partkey") % 3, kana(F.col("p_name"))
    word = F.when(n == 0, k).when(n == 1, mapped(ASCII_WIDE)(F.col("p_name"))).otherwise(F.concat(k, F.lit("本")))
    asked = p.select(word.alias("word"), (F.col("p_size") % 2 == 0).alias("backward")).distinct()
    asked = asked.withColumn("query", F.struct("word", "backward"))
    number = F.substring("p_brand", 7, 9).cast("int") % 3
    lists = F.when(number == 0, F.array(F.lit("word_asis"))).when(number == 1, F.array(*map(F.lit, ("word_asis", "word_alphabet", "endword_asis")))).otherwise(F.array(*map(F.lit, ("word_kana", "endword_kana"))))
    indexes = p.select(F.col("p_brand").alias("subbook"), F.explode(lists).alias("name")).distinct()
    found = K.selected_index(asked, indexes).where("index_name IS NOT NULL")
    return found.select(F.col("word").alias("query"), "backward", "subbook", "index_name")


@query("SELECT doc_id, coalesce(sum(strlen(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // 2048 + 1 AS page, (coalesce(sum(strlen(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT % 2048)::INT AS offset FROM documents")
def win_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each text begins in the stream of all of them."""
    from ..functions.codes import position

    d = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n"))
    return running_total(d, [], "doc_id", F.col("n"), "loc").select("doc_id", position(F.col("loc")).alias("x")).select("doc_id", "x.*")


@query("SELECT doc_id, source, (min(doc_id) OVER (PARTITION BY source) * 1000 + coalesce(sum(length(string_split(text, chr(10))[1])) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS heading FROM documents")
def win_heading_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A member's heading begins where the one before it ends, from the group's heading on."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.length(F.split("text", "\n")[0]).cast("long").alias("n"))
    first = d.groupBy(F.col("source").alias("s")).agg((F.min("doc_id") * 1000).alias("base"))
    total = running_total(d, ["source"], "doc_id", F.col("n"), "before")
    return total.join(first, F.col("source") == F.col("s")).select("doc_id", "source", (F.col("base") + F.col("before")).alias("heading"))


FED = f"""(SELECT doc_id, name, rank, (rank - 1) // per AS round, name AS o FROM (
    SELECT doc_id, source AS name, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank, CASE WHEN source LIKE '%1' THEN 2 ELSE 1 END AS per FROM documents) WHERE rank <= 40)"""


@query(f"SELECT doc_id, name AS source, row_number() OVER (ORDER BY round, o, rank)::INT AS place FROM {FED}")
def fed_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First hits of all sources in one list, paired sources two at a time."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("doc_id").alias("ord"))
    per = F.when(F.col("source").endswith("1"), 2).otherwise(1)
    return K.interleaved(d, "source", F.col("source"), per).select("doc_id", "source", "place")


@query("SELECT doc_id, source, rank FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INT AS rank FROM documents) WHERE rank <= 40")
def topk_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("doc_id").alias("ord"))
    return K.limited(d, ["source"], 40).select("doc_id", "source", "rank")


@query(f"""WITH f AS (SELECT place, category FROM (SELECT row_number() OVER (ORDER BY round, o, rank) AS place, name FROM {FED}) JOIN {SOURCES} USING (name))
    SELECT a.place, a.category, coalesce(min(b.place) FILTER (b.place > a.place), min(b.place)) AS next_place FROM f a LEFT JOIN f b ON a.category <> b.category GROUP BY a.place, a.category""")
def win_next_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In a federated list: where the next kind of dictionary begins, round the end."""
    f = fed_interleave(spark, sf_dir).join(sources(spark, sf_dir), F.col("source") == F.col("name"))
    f = f.select(F.col("place").cast("long").alias("place"), "category").withColumn("list", F.lit(1))
    return next_different(f, ["list"], "place", "category", "next_place").select("place", "category", "next_place")


POSTS = f"(SELECT doc_id AS text, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), '{LOWER}', '{UPPER}'), '[A-Z]+'))) AS keyword FROM documents)"
#: A query for each benchmark item: all its distinct words.
ASKED = f"(SELECT query, keyword, min(n) AS nth FROM (SELECT item_id AS query, unnest(w) AS keyword, unnest(range(len(w))) AS n FROM (SELECT item_id, regexp_extract_all(translate(text, '{LOWER}', '{UPPER}'), '[A-Z]+') AS w FROM benchmark)) GROUP BY ALL)"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    words = F.regexp_extract_all(F.translate("text", LOWER, UPPER), F.lit("[A-Z]+"), F.lit(0))
    each = b.select(F.col("item_id").alias("query"), F.posexplode(words).alias("n", "keyword"))
    return each.groupBy("query", "keyword").agg(F.min("n").alias("nth"))


@query(f"SELECT query, text FROM {POSTS} p JOIN (SELECT *, count(*) OVER (PARTITION BY query) AS need FROM {ASKED}) q USING (keyword) GROUP BY query, text HAVING count(*) = any_value(need)")
def keyword_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.keyword_and(asked(spark, sf_dir), W.entry_words(table(spark, sf_dir, "documents")))


@query(f"SELECT keyword, count(*) AS df FROM {POSTS} GROUP BY keyword")
def keyword_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.document_frequency(W.postings(table(spark, sf_dir, "documents")))


@query(f"SELECT query, arg_min(keyword, (df, nth)) AS driver, min(df) AS df FROM (SELECT query, nth, q.keyword, coalesce(df, 0) AS df FROM {ASKED} q LEFT JOIN (SELECT keyword, count(*) AS df FROM {POSTS} GROUP BY keyword) f ON q.keyword = f.keyword) GROUP BY query")
def keyword_rarest(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = asked(spark, sf_dir)
    return W.rarest(queries, W.document_frequency(W.asked_postings(queries, W.entry_words(table(spark, sf_dir, "documents")))))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE starts_with(o_orderstatus, 'F') AND starts_with(o_orderpriority, '2-')")
def multi_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return W.multi_and(o, [("o_orderstatus", "F"), ("o_orderpriority", "2-"), ("o_custkey", "-")]).select("o_orderkey", "o_custkey")


@query(f"SELECT text FROM {POSTS} WHERE keyword = 'THE' INTERSECT SELECT text FROM {POSTS} WHERE keyword = 'AND'")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = W.postings(table(spark, sf_dir, "documents"))
    return p.where("keyword = 'THE'").select("text").intersect(p.where("keyword = 'AND'").select("text"))


@query(f"SELECT text FROM {POSTS} WHERE keyword = 'THE' EXCEPT SELECT text FROM {POSTS} WHERE keyword = 'AND'")
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = W.postings(table(spark, sf_dir, "documents"))
    return p.where("keyword = 'THE'").select("text").subtract(p.where("keyword = 'AND'").select("text"))


#: Entries at the positions that hits name.
ENTRIES = "(SELECT p_size::BIGINT * 2048 + k AS location, 'entry ' || p_size || '/' || k AS body FROM (SELECT DISTINCT p_size FROM part), (SELECT unnest([0, 1, 2, 3, 4]) AS k))"


@query(f"SELECT query, rank, body FROM ({_ranked(_hits('starts_with(key, word)'), 3)}) JOIN {ENTRIES} ON text = location")
def join_hit_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies are joined after the limit."""
    p = table(spark, sf_dir, "part").select("p_size").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4))))
    entries = p.select((F.col("p_size").cast("long") * 2048 + F.col("k")).alias("location"), F.format_string("entry %d/%d", "p_size", "k").alias("body"))
    hits = K.search(word_queries(spark, sf_dir), headwords(spark, sf_dir), limit=3)
    return hits.join(entries, F.col("text") == F.col("location")).select("query", "rank", "body")


@query("SELECT region.r_name || ' > ' || n_name || ' > ' || c_name AS path, 2 AS level FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey UNION ALL SELECT r_name || ' > ' || n_name, 1 FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 0 FROM region")
def menu_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and customers as a menu of three levels."""
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    key = lambda t, k: F.concat(F.lit(t), F.col(k).cast("string"))
    roots = r.select(key("r", "r_regionkey").alias("node"), F.col("r_name").alias("label"))
    edges = n.select(key("r", "n_regionkey").alias("parent"), key("n", "n_nationkey").alias("node"), F.col("n_name").alias("label"))
    edges = edges.unionByName(c.select(key("n", "c_nationkey").alias("parent"), key("c", "c_custkey").alias("node"), F.col("c_name").alias("label")))
    return L.menu_tree(edges, roots).select("path", "level")


REFS = "(SELECT page_id, unnest(regexp_extract_all(coalesce(html, ''), 'href=\"([^\"]*)\"', 1)) AS target, unnest(range(0, len(regexp_extract_all(coalesce(html, ''), 'href=\"([^\"]*)\"', 1)))) AS nth FROM pages)"


@query(f"SELECT page_id, nth::INT AS nth, target FROM {REFS}")
def text_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.references(table(spark, sf_dir, "pages"))


@query(f"SELECT page_id, nth::INT AS nth, target, location FROM {REFS} JOIN (SELECT '/' || word AS target, min(doc_id) AS location FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY ALL) USING (target)")
def ref_follow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages to the first document that has their word."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", " ", -1)).alias("word"))
    uses = words.select(F.concat(F.lit("/"), "word").alias("target"), F.col("doc_id").alias("location"))
    return L.followed_first(L.references(table(spark, sf_dir, "pages")), uses).select("page_id", "nth", "target", "location")


#: Links lead from a page to another by the letters of what they name; they run in circles.
LINKS = f"(SELECT DISTINCT page_id AS source, (page_id * 3 + ascii(substr(target, 2, 1)) + 31 * length(target)) % (SELECT count(*) FROM pages) AS target FROM {REFS})"


@query(
    rf"""WITH RECURSIVE walk AS (
            SELECT min(page_id) AS start, min(page_id) AS node, 0 AS depth FROM pages GROUP BY regexp_extract(url, '^[a-z]+://([^/]+)', 1)
            UNION SELECT start, target, depth + 1 FROM walk JOIN {LINKS} ON node = source WHERE depth < 40
        ) SELECT start, node, min(depth) AS depth FROM walk GROUP BY start, node"""
)
def ref_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page that can be reached from the first page of each host by links, with the fewest steps."""
    pages = table(spark, sf_dir, "pages")
    refs = L.references(pages)
    n = pages.agg(F.count(F.lit(1)).alias("n"))
    letter = F.coalesce(F.ascii(F.substring("target", 2, 1)), F.lit(0))
    edges = refs.join(n).select(F.col("page_id").alias("source"), ((F.col("page_id") * 3 + letter + 31 * F.length("target")) % F.col("n")).alias("target"))
    return L.reachable(edges, pages.groupBy(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)).agg(F.min("page_id").alias("node")))


#: Mappings of three layers; uses of codes, some of them unmapped.
LAYERS = "(SELECT p_size % 2 = 0 AS narrow, 41249 + p_partkey % 60 AS code, (p_partkey // 60) % 3 AS layer, max(CASE WHEN p_size % 5 = 0 THEN '' ELSE p_brand END) AS replacement FROM part GROUP BY ALL)"
RESOLVED = f"(SELECT narrow, code, arg_max(replacement, layer) AS replacement, max(layer) AS layer FROM {LAYERS} GROUP BY narrow, code)"
USES = "(SELECT l_orderkey, l_linenumber, l_linenumber % 2 = 0 AS narrow, 41249 + l_partkey % 75 AS code FROM lineitem)"


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    text = F.when(F.col("p_size") % 5 == 0, "").otherwise(F.col("p_brand"))
    return p.groupBy((F.col("p_size") % 2 == 0).alias("narrow"), (F.col("p_partkey") % 60 + 41249).alias("code"), F.expr("p_partkey DIV 60 % 3").alias("layer")).agg(F.max(text).alias("replacement"))


def uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") % 2 == 0).alias("narrow"), (F.col("l_partkey") % 75 + 41249).alias("code"))


@query(f"SELECT * FROM {RESOLVED}")
def gaiji_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.resolved(layers(spark, sf_dir))


@query(f"SELECT l_orderkey, l_linenumber, coalesce(replacement, '<gaiji=' || (CASE WHEN narrow THEN 'h' ELSE 'z' END) || lpad(lower(hex(code)), 4, '0') || '>') AS shown, replacement IS NOT NULL AS known FROM {USES} LEFT JOIN {RESOLVED} USING (narrow, code)")
def join_gaiji(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.replaced(uses(spark, sf_dir), G.resolved(layers(spark, sf_dir))).select("l_orderkey", "l_linenumber", "shown", "known")


@query(f"SELECT narrow, code, count(*) AS uses FROM {USES} u WHERE NOT EXISTS (FROM {RESOLVED} r WHERE r.narrow = u.narrow AND r.code = u.code) GROUP BY ALL")
def gaiji_unmapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.unmapped(uses(spark, sf_dir), G.resolved(layers(spark, sf_dir)))


CELL = "((start // 256 + (start % 256 - 33 + i) // 94) * 256 + 33 + (start % 256 - 33 + i) % 94)::BIGINT AS code"


@query(f"SELECT p_partkey, p_size % 2 = 0 AS narrow, {CELL}, substr(p_name, i + 1, 1) AS replacement FROM (SELECT *, 41249 + p_size + p_partkey % 60 AS start, unnest(range(0, length(p_name)))::INT AS i FROM part)")
def gaiji_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's name on the cells from its own first one on, over the ends of rows."""
    p = table(spark, sf_dir, "part")
    return G.run(p.select("p_partkey", (F.col("p_size") % 2 == 0).alias("narrow"), (41249 + F.col("p_size") + F.col("p_partkey") % 60).alias("start"), F.col("p_name").alias("characters")), "p_partkey")


@query(f"SELECT DISTINCT unnest([true, false]) AS narrow, code, replacement FROM {LAYERS}")
def gaiji_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.both_widths(layers(spark, sf_dir)).distinct()


@query(f"SELECT NOT narrow AS narrow, code, replacement FROM {LAYERS} WHERE code >= 41270")
def gaiji_leaked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.leaked(layers(spark, sf_dir), 41270)


@query("SELECT p_partkey, false AS narrow, (45345 + p_size + k)::BIGINT AS code, string_split(p_name, ' ')[k + 1] AS replacement FROM part, (SELECT unnest([0, 1])::INT AS k) WHERE len(string_split(p_name, ' ')) > k")
def gaiji_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each part's name after a code each, as text."""
    p = table(spark, sf_dir, "part")
    words = F.slice(F.split("p_name", " "), 1, 2)
    text = F.array_join(F.transform(words, lambda w, i: F.concat(F.lower(F.hex(45345 + F.col("p_size") + i)), F.lit(" "), w)), "  ")
    return G.series(p.select("p_partkey", F.lit(False).alias("narrow"), F.concat(F.lit(" "), text, F.lit(" ")).alias("text")), "p_partkey")


@query(f"SELECT p_partkey, true AS narrow, {CELL}, nfc_normalize(substr(p_name, i + 1, 1) || CASE WHEN p_size % 2 = 0 THEN chr(769) ELSE chr(776) END) AS replacement FROM (SELECT *, 41249 + p_size AS start, unnest(range(0, length(p_name)))::INT AS i FROM part)")
def gaiji_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The letters of each part's name under an acute or a diaeresis, composed."""
    p = table(spark, sf_dir, "part")
    mark = F.when(F.col("p_size") % 2 == 0, "\u0301").otherwise("\u0308")
    return G.accents(p.select("p_partkey", F.lit(True).alias("narrow"), (41249 + F.col("p_size")).alias("start"), F.col("p_name").alias("letters"), mark.alias("mark")), "p_partkey")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '±' WHEN 1 THEN '→' END || p_name AS replacement FROM part WHERE p_partkey % 4 < 2")
def gaiji_dq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replacements with symbols of ambiguous width; letters and wide characters pass."""
    n = F.col("p_partkey") % 4
    mark = F.when(n == 0, "±").when(n == 1, "→").when(n == 2, "あ").otherwise("é")
    return G.ambiguous(table(spark, sf_dir, "part").select("p_partkey", F.concat(mark, "p_name").alias("replacement")))


#: The order file names every third source.
FIELDS = "(SELECT DISTINCT dense_rank() OVER (ORDER BY o_orderstatus, left(o_orderpriority, 1)) AS query, left(o_orderpriority, 1) AS p, o_orderstatus AS s FROM orders)"


@query(f"""SELECT query, text, heading, rank FROM (SELECT query, o_orderkey AS text, o_orderkey * 10 AS heading, row_number() OVER (PARTITION BY query ORDER BY o_orderkey)::INT AS rank
    FROM {FIELDS} f JOIN orders ON starts_with(o_orderpriority, p) AND o_orderstatus = s) WHERE rank <= 30""")
def multi_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by their priority's beginning and their status: each field has its own list, with its own headings and order."""
    o = table(spark, sf_dir, "orders")
    key, status, first = F.col("o_orderkey"), F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)
    pairs = o.select(status.alias("s"), first.alias("p")).distinct()
    numbered = pairs.select("s", "p", F.dense_rank().over(Window.partitionBy().orderBy("s", "p")).cast("long").alias("query"))  # as many as pairs of values
    asked = numbered.select("query", F.posexplode(F.array("p", "s")).alias("field_no", "word"))
    index = o.select(key.alias("text"), F.posexplode(F.array("o_orderpriority", status)).alias("field_no", "key"))
    index = index.withColumns({"heading": F.col("text") * 10 + F.col("field_no"), "ord": F.when(F.col("field_no") == 0, F.col("text")).otherwise(-F.col("text"))})
    hits = K.matched(asked.select(F.struct("query", "field_no").alias("query"), "word"), index).where("query.field_no = field_no")
    found = W.multi_lists(hits.select("query.query", "field_no", "text", "heading", "ord"), asked)
    return K.limited(found, ["query"], 30).select("query", "text", "heading", "rank")


ORDER = "(SELECT name, row_number() OVER (ORDER BY name DESC) - 1 AS rank FROM (SELECT DISTINCT source AS name FROM documents WHERE source LIKE '%3' OR source LIKE '%7'))"


def order(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "documents").select(F.col("source").alias("name")).distinct().where("name LIKE '%3' OR name LIKE '%7'")
    return names.select("name", (F.row_number().over(Window.partitionBy().orderBy(F.col("name").desc())) - 1).cast("long").alias("rank"))


RANKED = f"(SELECT name, category, size, coalesce(rank, (SELECT count(*) FROM {ORDER})) AS rank FROM {SOURCES} LEFT JOIN {ORDER} USING (name))"


@query(f"SELECT name, rank FROM {RANKED}")
def order_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ranked(sources(spark, sf_dir), order(spark, sf_dir)).select("name", "rank")


@query(f"SELECT name, row_number() OVER (ORDER BY rank, CASE category WHEN '英' THEN 0 WHEN '国' THEN 1 WHEN '百' THEN 2 ELSE 3 END, size DESC, name)::INT AS place FROM {RANKED}")
def order_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = R.ranked(sources(spark, sf_dir), order(spark, sf_dir))
    place = F.row_number().over(Window.partitionBy().orderBy(*R.reading_order(books)))
    return books.select("name", place.alias("place"))


@query("SELECT p_brand AS subbook, sum(CASE WHEN p_type LIKE 'S%' THEN p_size + 1 ELSE 0 END)::BIGINT AS size FROM part GROUP BY ALL")
def agg_headword_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    name = F.when(F.startswith("p_type", F.lit("S")), "word_asis").otherwise("endword_asis")
    return R.headword_size(p.select(F.col("p_brand").alias("subbook"), name.alias("name"), F.col("p_partkey").alias("start_page"), (F.col("p_partkey") + F.col("p_size")).alias("end_page")))


LATIN = "CASE WHEN regexp_matches(heading, '[A-Za-z]') AND NOT regexp_matches(regexp_replace(heading, '[A-Za-z]', '', 'g'), '\\p{L}') THEN 1 ELSE 0 END"
CONTENT = f"(SELECT source AS subbook, CASE WHEN avg({LATIN}) > 0.5 THEN '英' END AS category FROM (SELECT source, string_split(text, chr(10))[1] AS heading, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 8 GROUP BY source)"


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("subbook"), F.col("doc_id").alias("ord"), F.split("text", "\n")[0].alias("heading"))


@query(f"SELECT subbook, category FROM {CONTENT}")
def agg_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.content_category(headings(spark, sf_dir))


@query(f"SELECT s.subbook, CASE WHEN right(s.subbook, 1) = '4' THEN '百' WHEN right(s.subbook, 1) = '2' THEN '英' ELSE coalesce(category, '国') END AS category FROM (SELECT DISTINCT source AS subbook FROM documents) s JOIN {CONTENT} c USING (subbook)")
def book_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that end in 4 are an encyclopedia's, those in 2 a dictionary's; of the others the headings decide."""
    kind = F.when(F.col("subbook").endswith("4"), " Encyclopedia").when(F.col("subbook").endswith("2"), " Dictionary").otherwise("")
    books = headings(spark, sf_dir).select("subbook").distinct()
    return R.category(books.withColumn("title", F.concat("subbook", kind)), headings(spark, sf_dir))


@query(f"SELECT name, place, category FROM {SOURCES} JOIN (SELECT source AS name, max(doc_id) AS place FROM documents WHERE doc_id % 3 = 0 GROUP BY source) USING (name)")
def order_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some sources, named in the order of their last documents."""
    typed = table(spark, sf_dir, "documents").where("doc_id % 3 = 0").groupBy(F.col("source").alias("name")).agg(F.max("doc_id").alias("place"))
    return R.as_typed(sources(spark, sf_dir), typed).select("name", "place", "category")



#: Escapes at entry starts, made of events: one subbook a user, the type is the code.
ESCAPES = "(SELECT user_id AS subbook, event_id AS start, CASE event_type WHEN 'view' THEN 'click' ELSE event_type END AS code, 0 AS argument, 0 AS \"offset\" FROM events)"
CANDIDATES = f"(SELECT subbook, code, argument, \"offset\", count(*) AS n, count(*) / any_value(total) AS share FROM (SELECT *, count(*) OVER (PARTITION BY subbook) AS total FROM {ESCAPES}) GROUP BY subbook, code, argument, \"offset\" HAVING count(*) / any_value(total) >= 0.2)"


def escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    code = F.when(F.col("event_type") == "view", "click").otherwise(F.col("event_type"))
    return e.select(F.col("user_id").alias("subbook"), F.col("event_id").alias("start"), code.alias("code"), F.lit(0).alias("argument"), F.lit(0).alias("offset"))


@query(f"SELECT *, row_number() OVER (PARTITION BY subbook ORDER BY \"offset\", share DESC, code, argument)::INT AS nth FROM {CANDIDATES}")
def stop_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.in_order(B.candidates(escapes(spark, sf_dir), least=0.2))


@query("SELECT subbook, shape, count(*) AS n FROM (SELECT user_id AS subbook, event_type AS shape, count(*) OVER (PARTITION BY user_id) AS total FROM events) GROUP BY subbook, shape HAVING count(*) >= greatest(2, any_value(total) // 200)")
def stop_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return B.signatures(e.select(F.col("user_id").alias("subbook"), F.col("event_id").alias("start"), F.col("event_type").alias("shape")))


SCORES = "(SELECT user_id AS subbook, event_type AS code, 0 AS argument, length(event_type) % 4 AS \"offset\", sum(CASE WHEN value >= 10 THEN 1 ELSE 0 END) / count(*) AS score FROM events GROUP BY user_id, event_type)"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return B.scored(e.select(F.col("user_id").alias("subbook"), F.col("event_type").alias("code"), F.lit(0).alias("argument"), (F.length("event_type") % 4).cast("long").alias("offset"), (F.col("value") >= 10).alias("good")))


@query(f"SELECT subbook, code, argument, \"offset\", score FROM (SELECT *, row_number() OVER (PARTITION BY subbook ORDER BY \"offset\", -score, code) AS r FROM (SELECT *, max(score) OVER (PARTITION BY subbook) AS top FROM {SCORES}) WHERE top >= 0.5 AND score >= top - 0.03) WHERE r = 1")
def stop_choose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.chosen(scores(spark, sf_dir))


@query(f"SELECT subbook, code, \"offset\", score, row_number() OVER (PARTITION BY subbook ORDER BY -score, \"offset\", code)::INT AS place FROM {SCORES}")
def stop_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("subbook").orderBy(-F.col("score"), "offset", "code"))
    return scores(spark, sf_dir).select("subbook", "code", "offset", "score", place.alias("place"))


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM documents) WHERE n % 7 = 0 AND n < 7 * 60")
def sample_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator itself: every seventh entry of a source, 60 at most."""
    return B.stride(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], "doc_id", 7, 60)


INDEX_ROWS = "(SELECT p_brand AS subbook, CASE p_partkey % 4 WHEN 0 THEN 'word_asis' WHEN 1 THEN 'word_kana' WHEN 2 THEN 'word_alphabet' ELSE 'endword_asis' END AS name, p_partkey AS ord, p_size::BIGINT AS start FROM part)"


@query(f"SELECT DISTINCT subbook, start FROM (SELECT *, row_number() OVER (PARTITION BY subbook, name ORDER BY ord) AS r FROM {INDEX_ROWS} WHERE name LIKE 'word%') JOIN (SELECT subbook, count(DISTINCT name) AS n FROM {INDEX_ROWS} WHERE name LIKE 'word%' GROUP BY ALL) USING (subbook) WHERE r <= 40 // n")
def sample_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator itself: the first starts of each headword index, 40 a subbook."""
    p, n = table(spark, sf_dir, "part"), F.col("p_partkey") % 4
    name = F.when(n == 0, "word_asis").when(n == 1, "word_kana").when(n == 2, "word_alphabet").otherwise("endword_asis")
    return B.sampled_starts(p.select(F.col("p_brand").alias("subbook"), name.alias("name"), F.col("p_partkey").alias("ord"), F.col("p_size").cast("long").alias("start")), 40)


#: Where each of two candidates leads from an entry; every brand's entries are known but for some sizes.
NEXTS = """(SELECT 'book' AS subbook, code, 1 AS argument, off AS "offset", p_partkey AS start, p_partkey + step + p_size % 2 AS next
    FROM part, (VALUES (7945, 0, 1), (8001, 4, 2)) c(code, off, step))"""
CHAIN = f"""(WITH RECURSIVE e AS (SELECT n.*, k.p_partkey IS NOT NULL AS good FROM {NEXTS} n LEFT JOIN part k ON k.p_partkey = n.next AND k.p_size % 11 > 0),
    chain AS (
        SELECT e.*, 1 AS n FROM e JOIN part ON p_partkey = start WHERE p_partkey % 50 = 0
        UNION ALL SELECT e.*, chain.n + 1 FROM chain JOIN e ON e.code = chain.code AND e.start = chain.next WHERE chain.good AND chain.n < 25)
    SELECT DISTINCT subbook, code, argument, "offset", start, good FROM chain)"""


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.lit("book").alias("subbook"), F.col("p_partkey").alias("start"), "p_size")
    options = F.array(*[F.struct(F.lit(c).alias("code"), F.lit(1).alias("argument"), F.lit(o).alias("offset"), F.lit(s).alias("step")) for c, o, s in ((7945, 0, 1), (8001, 4, 2))])
    nexts = p.withColumn("c", F.explode(options)).select("subbook", "c.code", "c.argument", "c.offset", "start", (F.col("start") + F.col("c.step") + F.col("p_size") % 2).alias("next"))
    return B.chained(B.stride(p, ["subbook"], "start", 50), nexts, p.where(F.col("p_size") % 11 > 0))


@query(f"SELECT * FROM {CHAIN}")
def stop_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth entry is a seed of a chain; all chains are read."""
    return chain(spark, sf_dir)


@query(f"""SELECT subbook, code, argument, "offset", score FROM (SELECT *, max(score) OVER () AS top FROM (SELECT subbook, code, argument, "offset", sum(good::INT) / count(*) AS score FROM {CHAIN} GROUP BY ALL)) WHERE top >= 0.5 AND score >= top - 0.03 ORDER BY "offset" LIMIT 1""")
def stop_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.chosen(B.scored(chain(spark, sf_dir)))
