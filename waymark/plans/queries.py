"""Registered queries over the synthetic tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grammar as G
from ..functions import lexicon as L
from ..functions import paraphrase as P
from ..functions import text as T
from ..functions import unicode as U
from ..operators import gates, metrics, nearest
from ..operators import retrieval as R
from ..shipping import ship
from ..sources.articles import fingerprint
from ..streaming import events as E
from ..tables import settle
from . import cases
from . import compile as C

#: A lexicon for the invented prose of the tables: function words and endings to atoms.
PROSE = L.Lexicon(
    atoms={"ble": "flicker", "tion": "blank", "ly": "touch", "ing": "slow", "et": "battery_drain", "le": "charge", "est": "overheat",
           "und": "camera", "der": "camera_focus", "die": "update", "que": "app", "los": "install", "por": "network"},
    domains=L.STOCK.domains,
)

FLOOR, MARGIN = 0.35, 0.02
FLOORS, MARGINS = [0.30, 0.35, 0.40, 0.45, 0.50, 0.55], [0.02, 0.04, 0.06, 0.08, 0.10, 0.15]
MODES = ("lexical", "dense", "hybrid", "hybrid_no_path")

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


#: Tables below this size may lie in a row group or two, which one task would read alone.
SMALL_BYTES = 256 << 20


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(rows: DataFrame) -> DataFrame:
    """A small table dealt out to all cores before costly expressions; a large one has
    splits enough and stays where it is."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism) if size < SMALL_BYTES else rows


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def _whole(rows: DataFrame) -> DataFrame:
    """Sizes and lengths as long, like the other engine's."""
    return rows.withColumns({f.name: F.col(f.name).cast("long") for f in rows.schema.fields if f.name.startswith("n_") or f.name == "longest"})


def _query(sql: str | None = None):
    def add(build):
        _queries[build.__name__] = lambda spark, sf: _whole(build(spark, sf))
        if sql is not None:
            _sql[build.__name__] = sql
        return build

    return add


# ---- SQL fragments ----------------------------------------------------------------


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _map(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in table.items()) + "}"


_TOKENS = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+')"
_CONTENT = f"list_filter({_TOKENS}, lambda t: length(t) > 1 AND NOT list_contains({_list(L.STOP_WORDS)}, t))"


def _content(col: str) -> str:
    return _CONTENT.format(col)


def _atoms_cte(source: str, id_col: str, text: str, lexicon: L.Lexicon = PROSE) -> str:
    """Common table ``a(id, atoms)``."""
    noise = f"regexp_replace(lower(coalesce({text}, '')), '(?i)\\b({lexicon.noise})\\b', ' ', 'g')"
    return f"""
    w AS (SELECT {id_col} AS id, {_content(noise)} AS ws FROM {source}),
    k AS (SELECT id, ws, list_filter(list_transform(ws, lambda t: {_map(lexicon.atoms)}[t]), lambda x: x IS NOT NULL) AS found,
          list_filter(ws, lambda t: length(t) > 3) AS longer FROM w),
    d AS (SELECT id, list_filter(found, lambda x, i: list_position(found, x) = i) AS uniq, longer FROM k),
    a AS (SELECT id, CASE WHEN length(uniq) > 0 THEN uniq WHEN length(longer) > 0 THEN longer[1:4] ELSE ['generic'] END AS atoms FROM d)"""


_DOMAIN = f"coalesce(list_filter(list_transform(atoms, lambda x: {_map(L.STOCK.domains)}[x]), lambda x: x IS NOT NULL)[1], 'other')"
_SORTED = "list_sort(list_distinct(atoms))"
_SIGNATURE = (
    f"{_DOMAIN} || '::' || array_to_string({_SORTED}, '+') || '::' || CASE WHEN list_has_any(atoms, ['app', 'install']) THEN 'trigger:app' "
    "WHEN list_contains(atoms, 'update') THEN 'trigger:update' ELSE 'trigger:none' END"
)
_DOCS = _atoms_cte("documents", "doc_id", "text")


# ---- text normalisation --------------------------------------------------------------


@_query(f"SELECT doc_id, length({_TOKENS.format('text')}) AS n_tokens, length({_content('text')}) AS n_content, array_to_string({_content('text')}[1:5], ' ') AS first_content FROM documents")
def tokens_per_doc(spark, sf):
    toks = T.content_tokens(F.col("text"))
    return _documents(spark, sf).select("doc_id", F.size(T.tokens(F.col("text"))).alias("n_tokens"), F.size(toks).alias("n_content"), F.array_join(F.slice(toks, 1, 5), " ").alias("first_content"))


@_query(f"WITH {_DOCS} SELECT id AS doc_id, {_SIGNATURE} AS signature, array_to_string({_SORTED}, ' ') AS normalized, {_DOMAIN} AS domain FROM a")
def intent_signature_docs(spark, sf):
    text = F.col("text")
    return _documents(spark, sf).select("doc_id", T.signature(text, PROSE).alias("signature"), T.normalized(text, PROSE).alias("normalized"), T.domain(T.atoms(text, PROSE), PROSE).alias("domain"))


@_query(f"WITH {_DOCS}, s AS (SELECT {_SIGNATURE} AS signature, {_DOMAIN} AS domain FROM a) SELECT domain, count(*) AS n, count(DISTINCT signature) AS n_signatures FROM s GROUP BY domain")
def domain_histogram(spark, sf):
    text = F.col("text")
    rows = _documents(spark, sf).select(T.signature(text, PROSE).alias("signature"))
    return rows.groupBy(F.substring_index("signature", "::", 1).alias("domain")).agg(F.count("*").alias("n"), F.countDistinct("signature").alias("n_signatures"))


@_query(f"""WITH {_DOCS}, p AS (SELECT {_SIGNATURE} AS signature, max(id) AS plan FROM a GROUP BY 1),
  {_atoms_cte("(SELECT conv_id * 1000 + turn AS qid, text FROM conversations WHERE role = 'user')", "qid", "text").replace(" w AS", " w2 AS").replace("FROM w)", "FROM w2)").replace(" k AS", " k2 AS").replace("FROM k)", "FROM k2)").replace(" d AS", " d2 AS").replace("FROM d)", "FROM d2)").replace(" a AS", " a2 AS")},
  q AS (SELECT id, {_SIGNATURE} AS signature FROM a2)
  SELECT q.id AS query_id, q.signature, p.plan, CASE WHEN p.plan IS NULL THEN 'miss' ELSE 'exact' END AS tier FROM q LEFT JOIN p USING (signature)""")
def exact_cache_join(spark, sf):
    plans = _documents(spark, sf).select(F.col("doc_id").alias("plan"), T.signature(F.col("text"), PROSE).alias("signature"))
    asked = _table(spark, sf, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), T.signature(F.col("text"), PROSE).alias("signature"))
    hit = R.exact_lookup(asked, plans, "signature", "plan", "plan")
    return hit.select("query_id", "signature", F.col("hit").alias("plan"), F.when(F.col("hit").isNull(), "miss").otherwise("exact").alias("tier"))


_EDGE = "[^\\p{L}\\p{M}\\p{Nl}\\p{Nd}\\p{Pc}]+"


@_query(f"""SELECT doc_id, CASE WHEN length(s) > 0 THEN s ELSE text END AS stripped, w AS n_words FROM (
  SELECT doc_id, text, regexp_replace(text, '^{_EDGE}|{_EDGE}$', '', 'g') AS s, length(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: w <> '')) AS w FROM documents)""")
def stripped_text(spark, sf):
    text = F.col("text")
    return _documents(spark, sf).select("doc_id", T.stripped(text).alias("stripped"), T.word_count(text).alias("n_words"))


@_query("""WITH s AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
  q AS (SELECT doc_id, line_no, trim(regexp_replace(trim(regexp_replace(line, '\\s+', ' ', 'g')), '^(?:Alternatively|Also|Then|Now|Next|Finally|After that|First|Second|Third)[,\\s]+', '', 'i')) AS b FROM s)
  SELECT doc_id, line_no, CASE WHEN b = '' THEN '' ELSE upper(b[1]) || (CASE WHEN regexp_matches(b, '[.!?:]$') THEN b ELSE b || '.' END)[2:] END AS sentence FROM q""")
def sentences(spark, sf):
    rows = _documents(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return rows.select("doc_id", F.col("line_no").cast("long").alias("line_no"), T.sentence(F.col("line")).alias("sentence"))


@_query("""SELECT p_partkey, array_to_string(list_transform(list_filter(string_split(p_name, ' '), lambda w: w <> ''), lambda w, i: CASE WHEN regexp_matches(w, '^[0-9]') OR (upper(w) = w AND lower(w) <> w) THEN w
  WHEN i > 1 AND list_contains(%s, lower(w)) THEN lower(w) ELSE upper(w[1]) || w[2:] END), ' ') AS titled FROM part""" % _list(L.SMALL_WORDS))
def titlecase_parts(spark, sf):
    return _table(spark, sf, "part").select("p_partkey", T.title_case(F.col("p_name")).alias("titled"))


@_query(f"""WITH t AS (SELECT p_partkey, {_content('p_name')} AS ws FROM part), c AS (SELECT p_partkey, ws, list_filter(ws, lambda t: NOT list_contains({_list(L.TITLE_FILLERS)}, t))[1:3] AS core FROM t),
  n AS (SELECT p_partkey, array_to_string(CASE WHEN length(core) >= 2 THEN core ELSE list_concat(core, ws)[1:2] END, ' ') AS s FROM c)
  SELECT p_partkey, CASE WHEN s = '' THEN 'Device settings' ELSE upper(s[1]) || s[2:] END AS title FROM n""")
def title_from_topic(spark, sf):
    return _table(spark, sf, "part").select("p_partkey", T.title(F.col("p_name")).alias("title"))


@_query(f"""WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS ws FROM part), r AS (SELECT p_partkey, coalesce({_map(L.DESCRIPTION_VERBS)}[lower(ws[1])], 'fix') AS v, {_content("array_to_string(ws[2:], ' ')")} AS rest FROM w),
  o AS (SELECT p_partkey, v, CASE WHEN length(rest) > 2 THEN array_to_string(rest[-2:], ' ') WHEN length(rest) > 0 THEN array_to_string(rest, ' ') ELSE 'settings' END AS o FROM r),
  c AS (SELECT p_partkey, list_filter(['It will ' || v || ' ' || o, 'It will let you ' || v || ' ' || o, 'It will ' || v || ' ' || o || ' for you', 'It will let you ' || v || ' the ' || o], lambda c: length(string_split(c, ' ')) BETWEEN 5 AND 7)[1] AS d FROM o)
  SELECT p_partkey, d AS description, length(string_split(d, ' ')) AS n_words FROM c""")
def describe_window(spark, sf):
    line = T.describe(F.col("p_name"))
    return _table(spark, sf, "part").select("p_partkey", line.alias("description")).withColumn("n_words", T.word_count(F.col("description")))


@_query(f"""SELECT page_id, regexp_matches(url, '(?i){L.ADDRESSES}') AS leaks, regexp_matches(url, '(?i)^({L.SCHEMES})://') AS is_link, regexp_matches('voiceassist://' || page_id, '(?i)^({L.SCHEMES})://') AS is_own,
  regexp_matches(regexp_replace('see voiceassist://a.com/' || page_id || ' now', '(?:{L.SCHEMES})://[^\\s"'']+', ' DEEPLINK ', 'g'), '(?i){L.ADDRESSES}') AS own_leaks FROM pages""")
def url_leak_gate(spark, sf):
    own = F.concat(F.lit("voiceassist://"), F.col("page_id"))
    text = F.concat(F.lit("see voiceassist://a.com/"), F.col("page_id"), F.lit(" now"))
    return _table(spark, sf, "pages").select("page_id", T.leaks_address(F.col("url")).alias("leaks"), T.is_catalog_link(F.col("url")).alias("is_link"), T.is_catalog_link(own).alias("is_own"), T.leaks_address(text).alias("own_leaks"))


@_query("SELECT doc_id, 'FG-' || substring(sha1(doc_id || chr(10) || text), 1, 10) AS plan_id, substring(sha1(text), 1, 16) AS content_hash FROM documents")
def plan_ids_sha1(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", F.concat(F.lit("FG-"), fingerprint(F.col("doc_id").cast("string"), F.col("text"), length=10)).alias("plan_id"), fingerprint(F.col("text")).alias("content_hash"))


_PHRASES = ("Toggle on Wi-Fi scanning.", "Toggle off Wi-Fi scanning.", "Tap on Display.", "Turn off, then enable it.", "Perform a factory reset", "Clean the port with a dry cloth", "Open settings and switch on the option")


@_query(f"""SELECT o_orderkey, p AS phrase, CASE WHEN regexp_matches(p, '(?i){L.SWITCH_ON}') THEN 'enable' WHEN regexp_matches(p, '(?i){L.SWITCH_OFF}') THEN 'disable' ELSE 'none' END AS polarity,
  CASE WHEN regexp_matches(p, '(?i){L.CRITICAL}') THEN 'critical' WHEN regexp_matches(p, '(?i){L.MANUAL}') OR NOT r THEN 'manual' ELSE 'auto' END AS category
  FROM (SELECT o_orderkey, {_list(_PHRASES)}[o_orderkey % {len(_PHRASES)} + 1] AS p, o_orderkey % 3 > 0 AS r FROM orders)""")
def polarity_case(spark, sf):
    rows = _table(spark, sf, "orders").select("o_orderkey", F.get(T.strings(_PHRASES), (F.col("o_orderkey") % len(_PHRASES)).cast("int")).alias("phrase"), (F.col("o_orderkey") % 3 > 0).alias("resolved"))
    return rows.select("o_orderkey", "phrase", T.polarity(F.col("phrase")).alias("polarity"), T.category(F.col("phrase"), F.col("resolved")).alias("category"))


# ---- grammars ----------------------------------------------------------------------------


@_query("""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS parts FROM documents)
  SELECT doc_id, length(parts) AS n_sentences, max(length(p)) AS longest FROM (SELECT doc_id, parts, unnest(parts) AS p FROM s) GROUP BY doc_id, parts""")
def split_sentences(spark, sf):
    rows = _documents(spark, sf).select("doc_id", G.complaint_parts(F.col("text")).alias("parts")).where(F.size("parts") > 0)
    return rows.select("doc_id", F.size("parts").alias("n_sentences"), F.array_max(F.transform("parts", lambda p: F.length(p))).alias("longest"))


@_query(f"""WITH l AS (SELECT item_id, generate_subscripts(p, 1) - 1 AS part_no, unnest(p) AS part FROM (SELECT item_id, list_filter(list_transform(regexp_split_to_array(text, ',?\\s+(?:and|et|und|y)\\s+'), lambda s: trim(s)), lambda s: s <> '') AS p FROM benchmark)),
  {_atoms_cte("(SELECT item_id * 1000 + part_no AS pid, part FROM l)", "pid", "part")}
  SELECT item_id, part_no, part, {_SIGNATURE} AS signature FROM l JOIN a ON a.id = item_id * 1000 + part_no""")
def split_conjunction(spark, sf):
    parts = G.conjuncts(F.col("text"), r",?\s+(?:and|et|und|y)\s+")
    rows = _table(spark, sf, "benchmark").select("item_id", F.posexplode(parts).alias("part_no", "part"))
    return rows.select("item_id", F.col("part_no").cast("long").alias("part_no"), "part", T.signature(F.col("part"), PROSE).alias("signature"))


@_query("""WITH h AS (SELECT page_id, url, regexp_extract_all(html, '<(?:h1|p|li)[^>]*>(?:<[^>]*>)*[^<]*', 0) AS m FROM pages),
  e AS (SELECT page_id, url, generate_subscripts(m, 1) - 1 AS pos, unnest(m) AS tag FROM h),
  l AS (SELECT page_id, url, pos, trim(regexp_replace(regexp_replace(tag, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) AS line, starts_with(tag, '<h1') AS top FROM e),
  t AS (SELECT *, CASE WHEN top AND line <> '' THEN line END AS head FROM l),
  s AS (SELECT *, count(head) OVER w AS section, last_value(head IGNORE NULLS) OVER w AS last_head, max(head) OVER (PARTITION BY page_id) IS NULL AS bare FROM t WINDOW w AS (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
  SELECT page_id, section, CASE WHEN bare THEN url ELSE last_head END AS heading, pos AS line_no, CASE WHEN top THEN '## ' || line ELSE line END AS line FROM s WHERE head IS NULL AND (bare OR last_head IS NOT NULL)""")
def section_explode(spark, sf):
    found = F.regexp_extract_all("html", F.lit(r"<(?:h1|p|li)[^>]*>(?:<[^>]*>)*[^<]*"), F.lit(0))
    line = lambda tag: T.squeezed(F.regexp_replace(tag, "<[^>]*>", ""))
    marked = F.transform(found, lambda tag: F.when(tag.startswith("<h1"), F.concat(F.lit("## "), line(tag))).otherwise(line(tag)))
    rows = _spread(_table(spark, sf, "pages").select("page_id", "url", "html")).where(F.size(found) > 0).select("page_id", "url", F.array_join(marked, "\n").alias("content"))
    out = G.sections(rows, "page_id", "url", "content")
    return out.withColumn("line_no", F.col("line_no").cast("long"))


@_query("""WITH l AS (SELECT doc_id, generate_subscripts(p, 1) - 1 AS line_no, trim(unnest(p)) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
  u AS (SELECT doc_id, line, min(line_no) AS first_line, count(*) AS copies FROM l WHERE line <> '' GROUP BY doc_id, line)
  SELECT doc_id, count(*) AS n_steps, sum(copies)::BIGINT AS n_lines, max(copies) AS most_copies, min_by(line, first_line) AS first_step FROM u GROUP BY doc_id""")
def step_dedupe(spark, sf):
    lines = _table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).withColumn("line", T.trimmed(F.col("line"))).where("line <> ''")
    own = C.first_of_each(lines, ["doc_id", "line"], ["line_no"]).withColumnRenamed("line_no", "first_line")
    return own.groupBy("doc_id").agg(F.count("*").alias("n_steps"), F.sum("copies").alias("n_lines"), F.max("copies").alias("most_copies"), F.min_by("line", "first_line").alias("first_step"))


# ---- retrieval ----------------------------------------------------------------------------

_BM25 = f"""WITH dt AS (SELECT doc_id, unnest({_TOKENS.format('text')}) AS term FROM documents),
  len AS (SELECT doc_id, length({_TOKENS.format('text')}) AS len FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM dt GROUP BY ALL),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(*) AS n, avg(len) AS mean FROM len),
  idf AS (SELECT term, df, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf FROM df, n),
  q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TOKENS.format('text')}) AS term FROM benchmark) GROUP BY ALL),
  s AS (SELECT item_id, doc_id, sum(times * idf * tf * (1.5::DOUBLE + 1) / (tf + 1.5::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * len / mean))) AS score FROM q JOIN idf USING (term) JOIN tf USING (term) JOIN len USING (doc_id), n GROUP BY ALL)"""


def _bm25(spark, sf) -> DataFrame:
    words = T.tokens(F.col("text"))
    return R.bm25(_table(spark, sf, "benchmark"), _documents(spark, sf), "item_id", "doc_id", words, words)


@_query(_BM25 + " SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_idf(spark, sf):
    docs = _documents(spark, sf)
    return R.idf(R.postings(docs, "doc_id", T.tokens(F.col("text"))), docs.count()).select("term", "df", F.round("idf", 6).alias("idf"))


@_query(_BM25 + " SELECT item_id, doc_id, round(score, 4) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM s) WHERE rank <= 5")
def bm25_topk(spark, sf):
    return R.top(_bm25(spark, sf), "item_id", "doc_id", 5).select("item_id", "doc_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


def _grams_sql(source: str, id_col: str) -> str:
    padded = "regexp_replace(' ' || lower(text) || ' ', '\\s+', ' ', 'g')"
    return f"""SELECT {id_col}, gram, w / sqrt(sum(w * w) OVER (PARTITION BY {id_col})) AS w FROM (SELECT {id_col}, gram, ln(1 + count(*)) AS w FROM
    (SELECT {id_col}, unnest(flatten([list_transform(range(1, length(p) - n + 2), lambda i: substring(p, i, n)) FOR n IN [3, 4, 5]])) AS gram FROM (SELECT {id_col}, {padded} AS p FROM {source})) GROUP BY ALL)"""


@_query(f"""WITH texts AS (SELECT item_id AS other, text FROM benchmark), q AS ({_grams_sql('benchmark', 'item_id')}), b AS ({_grams_sql('texts', 'other')}),
  c AS (SELECT item_id, other, sum(q.w * b.w) AS cosine FROM q JOIN b USING (gram) WHERE item_id <> other GROUP BY ALL)
  SELECT item_id, other, round(cosine, 4) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(cosine, 6) DESC, other) AS rank FROM c) WHERE rank <= 3""")
def char_ngram_cosine(spark, sf):
    items = _table(spark, sf, "benchmark")
    found = R.gram_cosine(items, items.withColumnRenamed("item_id", "other"), "item_id", "other").where("item_id <> other")
    return R.top(found, "item_id", "other", 3, "cosine").select("item_id", "other", F.round("cosine", 4).alias("cosine"))


_LOOKUP = """WITH q AS (SELECT vec_id AS query, embedding, label FROM embeddings WHERE vec_id % 50 = 0), p AS (SELECT vec_id AS alias, label AS plan, embedding AS e FROM embeddings),
  s AS (SELECT query, q.label, plan, max(list_sum(list_transform(list_zip(embedding, e), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))) AS sim FROM q, p WHERE query <> alias GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(sim, 4) DESC, plan) AS rn FROM s),
  m AS (SELECT query, label, max(plan) FILTER (rn = 1) AS plan, round(max(sim) FILTER (rn = 1), 4) AS sim, round(max(sim) FILTER (rn = 1) - coalesce(max(sim) FILTER (rn = 2), 0), 4) AS margin FROM r WHERE rn <= 2 GROUP BY ALL)"""


def _lookups(spark, sf, asked="vec_id % 50 = 0") -> DataFrame:
    rows = _table(spark, sf, "embeddings")
    asked = rows.where(asked).select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    found = R.best_and_margin(nearest.two_nearest(asked, rows.select(F.col("vec_id").alias("alias"), F.col("label").alias("plan"), F.col("embedding").alias("vector"))))
    return found.join(rows.select(F.col("vec_id").alias("query"), "label"), "query")


@_query(_LOOKUP + f" SELECT query, plan, sim, margin, CASE WHEN sim >= {FLOOR} AND margin >= {MARGIN} THEN 'semantic' ELSE 'miss' END AS tier FROM m")
def semantic_margin_lookup(spark, sf):
    return _lookups(spark, sf).select("query", "plan", "sim", "margin", R.tier(F.col("sim"), F.col("margin"), FLOOR, MARGIN).alias("tier"))


_GRID = f""", g AS (SELECT unnest({FLOORS})::DOUBLE AS floor), h AS (SELECT unnest({MARGINS})::DOUBLE AS least),
  x AS (SELECT floor, least, sim >= floor AND margin >= least AS hit, plan = label AS "right" FROM m, g, h),
  w AS (SELECT floor, least, count(*) AS n, count(*) FILTER (hit) AS hits, round(100.0 * count(*) FILTER (hit AND "right") / count(*), 4)::DOUBLE AS recall, count(*) FILTER (hit AND NOT "right") AS wrong,
  round(100.0 * count(*) FILTER (hit AND NOT "right") / count(*), 4)::DOUBLE AS wrong_rate FROM x GROUP BY ALL)"""


_SWEEP = _LOOKUP + _GRID
#: A setting is chosen by all rows, each against all others.
_SWEEP_ALL = _LOOKUP.replace(" WHERE vec_id % 50 = 0", "") + _GRID


@_query(_SWEEP + " SELECT * FROM w")
def gate_sweep(spark, sf):
    return metrics.sweep(_lookups(spark, sf).withColumn("right", F.col("plan") == F.col("label")), FLOORS, MARGINS)


@_query(_SWEEP_ALL + " SELECT floor, least, recall, wrong_rate FROM w WHERE wrong_rate <= 60 ORDER BY recall DESC, wrong_rate, floor, least LIMIT 1")
def best_gate(spark, sf):
    swept = metrics.sweep(_lookups(spark, sf, "true").withColumn("right", F.col("plan") == F.col("label")), FLOORS, MARGINS)
    return metrics.best_setting(swept, 60.0).select("floor", "least", "recall", "wrong_rate")


# the types of all parts as a catalog; parts whose key 50 divides as actions that go to a type and switch a brand
_VERB = "CASE p_size % 3 WHEN 0 THEN 'Toggle on' WHEN 1 THEN 'Toggle off' ELSE 'Tap on' END"
_HYBRID = f"""WITH e0 AS (SELECT min(p_partkey) AS entry, p_type AS target, p_type || ' ' || p_type AS text, CASE min(p_size) % 4 WHEN 0 THEN 'enable' WHEN 1 THEN 'disable' WHEN 2 THEN 'monitor' ELSE 'open' END AS family FROM part GROUP BY p_type),
  e AS (SELECT entry, text, family, list_distinct({_content('target')}) AS target FROM e0 WHERE entry % 10 <> 0),
  a0 AS (SELECT p_partkey AS action, p_name, p_type, p_brand, {_VERB} AS verb, CASE p_size % 3 WHEN 0 THEN 'enable' WHEN 1 THEN 'disable' ELSE 'none' END AS polarity FROM part WHERE p_partkey % 50 = 0),
  a AS (SELECT action, p_name || ' ' || p_brand || ' Navigate to ' || p_type || '. ' || verb || ' ' || p_brand || '.' AS text, polarity,
    {_content('p_brand')} AS leaf, {_content("p_type || ' ' || p_brand")} AS path, {_content('p_name')} AS name FROM a0),
  dt AS (SELECT entry, unnest({_content('text')}) AS term FROM e), tf AS (SELECT entry, term, count(*) AS tf FROM dt GROUP BY ALL), len AS (SELECT entry, length({_content('text')}) AS len FROM e),
  n AS (SELECT count(*) AS n, avg(len) AS mean FROM len), idf AS (SELECT term, ln(1 + (n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM tf, n GROUP BY term, n),
  qt AS (SELECT action, term, count(*) AS times FROM (SELECT action, unnest({_content('text')}) AS term FROM a) GROUP BY ALL),
  lx AS (SELECT action, entry, sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))) AS lex FROM qt JOIN idf USING (term) JOIN tf USING (term) JOIN len USING (entry), n GROUP BY ALL),
  eg AS ({_grams_sql('e', 'entry')}), ag AS ({_grams_sql('a', 'action')}),
  c AS (SELECT action, entry, sum(ag.w * eg.w) AS cosine FROM ag JOIN eg USING (gram) GROUP BY ALL),
  x AS (SELECT a.action, e.entry, family, polarity, target, coalesce(cosine, 0) AS cosine, coalesce(lex, 0) AS lex, coalesce(max(lex) OVER (PARTITION BY a.action), 0) AS highest,
    length(list_intersect(target, leaf)) / length(target)::DOUBLE AS o, length(list_intersect(target, path)) / length(target)::DOUBLE AS p,
    length(list_intersect(target, name)) / length(target)::DOUBLE AS n FROM a CROSS JOIN e LEFT JOIN lx USING (action, entry) LEFT JOIN c USING (action, entry)),
  f AS (SELECT *, CASE WHEN highest > 0 THEN lex / (highest + 1e-9) ELSE lex END AS lx, (cosine + 1) / 2 AS dn,
    CASE WHEN polarity <> 'none' AND family IN ('enable', 'disable') THEN CASE WHEN family = polarity THEN 1.25 ELSE 0.55 END WHEN family IN ('enable', 'disable') THEN 0.9 WHEN family = 'monitor' THEN 1.1 ELSE 1.0 END
    * CASE WHEN greatest(o, n) >= 0.6 THEN 1.35 WHEN p >= 0.5 THEN 1.15 WHEN greatest(o, p, n) < 0.2 THEN 0.55 ELSE 1.0 END AS fac FROM x),
  m AS (SELECT unnest({_list(MODES)}) AS mode),
  s AS (SELECT mode, action, entry, family, polarity, greatest(o, p, n) AS overlap, (CASE mode WHEN 'lexical' THEN lx WHEN 'dense' THEN dn ELSE 0.55::DOUBLE * lx + 0.45::DOUBLE * dn END) * CASE WHEN mode = 'hybrid_no_path' THEN 1.0 ELSE fac::DOUBLE END AS score FROM f, m),
  r AS (SELECT *, row_number() OVER (PARTITION BY mode, action ORDER BY round(score, 6) DESC, entry) AS rank FROM s),
  b AS (SELECT mode, action, max(entry) FILTER (rank = 1) AS entry, max(family) FILTER (rank = 1) AS family, max(polarity) AS polarity, max(overlap) FILTER (rank = 1) AS overlap, max(score) FILTER (rank = 1) AS score, max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2) AS margin FROM r WHERE rank <= 2 GROUP BY ALL),
  g AS (SELECT *, score >= 0.30 AND overlap >= CASE WHEN family = 'monitor' THEN 0.34 ELSE 0.5 END AS accepted FROM b)"""


def _evidence(spark, sf) -> DataFrame:
    part = _table(spark, sf, "part")
    kind = lambda c, n, names: F.get(T.strings(names), (c % n).cast("int"))
    types = part.groupBy("p_type").agg(F.min("p_partkey").alias("id"), F.min("p_size").alias("size"))
    target = F.col("p_type")
    entries = types.select(
        "id", F.col("id").alias("position"), kind(F.col("size"), 4, ["enable", "disable", "monitor", "open"]).alias("family"), F.array_distinct(T.content_tokens(target)).alias("target_words"),
        F.concat_ws(" ", target, target).alias("index_text"), (F.col("id") % 10 == 0).alias("is_placeholder"),
    )
    verb = kind(F.col("p_size"), 3, ["Toggle on", "Toggle off", "Tap on"])
    steps = F.array(F.concat(F.lit("Navigate to "), "p_type", F.lit(".")), F.concat(verb, F.lit(" "), "p_brand", F.lit(".")))
    asked = part.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("id"), F.lit(1).alias("action_no"), F.col("p_name").alias("action"), steps.alias("steps"))
    return C.evidence(asked, entries)


@_query(_HYBRID + " SELECT action, entry, family, polarity, round(score, 4) AS score, round(margin, 4) AS margin, round(overlap, 4) AS overlap, accepted FROM g WHERE mode = 'hybrid'")
def hybrid_rank(spark, sf):
    best = C.ranked(_evidence(spark, sf)).where("rank = 1")
    return best.select(F.col("id").alias("action"), "entry", "family", "polarity", *(F.round(c, 4).alias(c) for c in ("score", "margin", "overlap")), "accepted")


@_query(_HYBRID + " SELECT mode, count(*) AS n, count(*) FILTER (accepted) AS n_accepted, round(100.0 * count(*) FILTER (accepted) / count(*), 4)::DOUBLE AS accept_rate, round(avg(overlap) FILTER (accepted), 4) AS mean_overlap FROM g GROUP BY mode")
def mode_ablation(spark, sf):
    found = settle(_evidence(spark, sf))
    best = reduce(DataFrame.unionAll, (C.ranked(found, m).where("rank = 1").withColumn("mode", F.lit(m)) for m in MODES))
    return best.groupBy("mode").agg(F.count("*").alias("n"), F.count_if(F.col("accepted")).alias("n_accepted"), metrics.share(F.col("accepted")).alias("accept_rate"), F.round(F.avg(F.when(F.col("accepted"), F.col("overlap"))), 4).alias("mean_overlap"))


@_query(f"""WITH t AS (SELECT p_partkey, list_distinct({_content('p_type')}) AS target, {_content('p_name')} AS name, CASE p_size % 2 WHEN 0 THEN 'monitor' ELSE 'open' END AS family FROM part),
  o AS (SELECT p_partkey, family, length(target) AS n, coalesce(length(list_intersect(target, list_concat(name, target[1:1 + p_partkey % 3]))) / length(target)::DOUBLE, 0) AS overlap FROM t)
  SELECT p_partkey, round(overlap, 4) AS overlap, n > 0 AND overlap >= CASE WHEN family = 'monitor' THEN 0.34 ELSE 0.5 END AS accepted FROM o""")
def target_overlap_gate(spark, sf):
    target, name = T.content_tokens(F.col("p_type")), T.content_tokens(F.col("p_name"))
    rows = _table(spark, sf, "part").select("p_partkey", target.alias("target"), F.concat(name, F.slice(F.array_distinct(target), F.lit(1), (1 + F.col("p_partkey") % 3).cast("int"))).alias("words"), F.when(F.col("p_size") % 2 == 0, "monitor").otherwise("open").alias("family"))
    share = R.overlap(F.col("target"), F.col("words"))
    return rows.select("p_partkey", F.round(share, 4).alias("overlap"), R.accepted(F.lit(1.0), share, F.col("family"), F.col("target")).alias("accepted"))


# ---- ordering, de-duplication, gates ---------------------------------------------------------

_CATEGORY = "CASE l_returnflag WHEN 'A' THEN 'auto' WHEN 'N' THEN 'manual' ELSE 'critical' END"


def _lines(spark, sf) -> DataFrame:
    flag = F.col("l_returnflag")
    return _table(spark, sf, "lineitem").withColumn("category", F.when(flag == "A", "auto").when(flag == "N", "manual").otherwise("critical"))


@_query(f"""SELECT l_orderkey, string_agg(category, '>' ORDER BY l_linenumber, category) AS as_given, string_agg(category, '>' ORDER BY rank, l_linenumber) AS in_order,
  string_agg(category, '>' ORDER BY l_linenumber, category) <> string_agg(category, '>' ORDER BY rank, l_linenumber) AS violation
  FROM (SELECT l_orderkey, l_linenumber, {_CATEGORY} AS category, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS rank FROM lineitem) GROUP BY l_orderkey""")
def category_order(spark, sf):
    rows = _lines(spark, sf).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "category"))).alias("given"))
    given = F.transform("given", lambda x: x["category"])
    ranked = F.transform(F.array_sort(F.transform("given", lambda x: F.struct(gates.rank(x["category"]).alias("r"), x["l_linenumber"].alias("n"), x["category"].alias("category")))), lambda x: x["category"])
    return rows.select("l_orderkey", F.array_join(given, ">").alias("as_given"), F.array_join(ranked, ">").alias("in_order"), (~gates.in_order(given)).alias("violation"))


@_query("""SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') AS n_resolved, count(*) FILTER (l_returnflag <> 'A') AS n_generic,
  round(greatest(0, least(0.99, 0.55 + 0.04 * count(*) FILTER (l_returnflag = 'A') - 0.05 * count(*) FILTER (l_returnflag <> 'A'))), 4)::DOUBLE AS score FROM lineitem GROUP BY l_orderkey""")
def goal_score(spark, sf):
    rows = _lines(spark, sf).groupBy("l_orderkey").agg(F.count_if(F.col("category") == "auto").alias("n_resolved"), F.count_if(F.col("category") != "auto").alias("n_generic"))
    return rows.withColumn("score", metrics.goal_score(F.col("n_resolved"), F.col("n_generic")))


@_query("""WITH k AS (SELECT o_custkey, lower(trim(o_orderpriority)) AS key, min(o_orderkey) AS first_position, max_by(o_orderkey, (o_totalprice, -o_orderkey)) AS best FROM orders GROUP BY ALL)
  SELECT k.o_custkey, first_position, best, o_totalprice AS price, row_number() OVER (PARTITION BY k.o_custkey ORDER BY o_totalprice DESC, first_position) AS rank FROM k JOIN orders ON o_orderkey = best""")
def fanout_dedupe_best(spark, sf):
    rows = _table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("best"), F.col("o_totalprice").alias("price"), "o_orderpriority")
    kept = metrics.keep_best(rows, ["o_custkey"], F.lower(T.squeezed(F.col("o_orderpriority"))), "price", "o_orderkey", ["best", "price"])
    return metrics.ordered(kept, ["o_custkey"], "price", "first_position").withColumn("rank", F.col("rank").cast("long"))


_GOALS = """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Follow these steps to fix it' ELSE 'Follow these steps to perform this Battery Drain Troubleshooting' END AS goal,
  CASE o_orderkey % 5 WHEN 0 THEN 'battery' WHEN 1 THEN 'Battery Drain' ELSE 'Battery drain' END AS title, o_totalprice / 300000 AS score,
  CASE o_orderkey % 3 WHEN 0 THEN ['critical', 'auto'] WHEN 1 THEN ['auto', 'manual'] ELSE ['manual'] END AS cats,
  CASE o_orderkey % 6 WHEN 0 THEN 'It fixes things' WHEN 1 THEN 'It will access the one two three four' ELSE 'It will access display settings' END AS description,
  CASE o_orderkey % 7 WHEN 0 THEN 'Open www.example.org. Then go. On' ELSE 'Open settings.' END AS step, CASE o_orderkey % 2 WHEN 0 THEN 'voiceassist://x/y' WHEN 1 THEN NULL END AS uri FROM orders"""


@_query(f"""WITH g AS ({_GOALS}), c AS (SELECT o_orderkey, unnest(list_concat(
  [CASE WHEN regexp_matches(step, '(?i){L.ADDRESSES}') THEN 'URL_LEAK' END, CASE WHEN NOT regexp_matches(goal, '{gates.GOAL}') THEN 'GOAL_SYNTAX' END, CASE WHEN NOT regexp_matches(title, '{gates.TITLE}') THEN 'TITLE_SHAPE' END,
  CASE WHEN score > 1 OR score < 0 THEN 'SCORE_RANGE' END, CASE WHEN cats = ['critical', 'auto'] THEN 'ORDER_VIOLATION' END],
  flatten(list_transform(cats, lambda k: [CASE WHEN NOT regexp_matches(description, '^It will \\S') THEN 'DESC_PREFIX' END, CASE WHEN length(string_split(description, ' ')) NOT BETWEEN 5 AND 7 THEN 'DESC_LENGTH' END,
  CASE WHEN k = 'auto' AND uri IS NULL THEN 'AUTO_WITHOUT_DEEPLINK' END, CASE WHEN k = 'manual' AND uri IS NOT NULL THEN 'MANUAL_WITH_DEEPLINK' END, CASE WHEN regexp_matches(step, '(?i){L.ADDRESSES}') THEN 'STEP_URL_LEAK' END,
  CASE WHEN length(step) - length(replace(step, '.', '')) > 1 AND NOT ends_with(step, '.') THEN 'STEP_MULTI_INTERACTION' END])))) AS code FROM g)
  SELECT code, count(*) AS n, count(DISTINCT o_orderkey) AS n_goals FROM c WHERE code IS NOT NULL GROUP BY code""")
def gate_report(spark, sf):
    k, orders = F.col("o_orderkey"), _spread(_table(spark, sf, "orders").select("o_orderkey", "o_totalprice"))
    step = F.when(k % 7 == 0, "Open www.example.org. Then go. On").otherwise("Open settings.")
    text = F.when(k % 6 == 0, "It fixes things").when(k % 6 == 1, "It will access the one two three four").otherwise("It will access display settings")
    link = F.when(k % 2 == 0, F.struct(F.lit("voiceassist://x/y").alias("deeplink"), F.lit("").alias("description")))
    check = F.lit(None).cast("struct<deeplink:string>")
    group = F.struct(F.array(step).alias("steps"), link.alias("actionableDeeplink"), check.alias("validationDeeplink"))
    action = lambda c: F.struct(F.lit("Open Display").alias("actionName"), text.alias("description"), F.array(group).alias("stepGroups"), c.alias("category"))
    kinds = F.when(k % 3 == 0, T.strings(["critical", "auto"])).when(k % 3 == 1, T.strings(["auto", "manual"])).otherwise(T.strings(["manual"]))
    context = F.struct(
        F.when(k % 4 == 0, "Follow these steps to fix it").otherwise("Follow these steps to perform this Battery Drain Troubleshooting").alias("goal"),
        F.when(k % 5 == 0, "battery").when(k % 5 == 1, "Battery Drain").otherwise("Battery drain").alias("title"),
        F.transform(kinds, action).alias("actions"), (F.col("o_totalprice") / 300000).alias("score"),
    )
    audited = gates.audit(orders.select("o_orderkey", F.array(context).alias("contexts")))
    # explode_outer: an inner explode would first test the audited array, and so audit twice
    codes = audited.select("o_orderkey", F.explode_outer("gate.failures").alias("code")).where("code is not null")
    return codes.groupBy("code").agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("n_goals"))


# ---- evaluation ---------------------------------------------------------------------------------


@_query(f"WITH {_DOCS}, s AS (SELECT {_SIGNATURE} AS signature FROM a) SELECT count(*) AS n, count(DISTINCT signature) AS n_signatures FROM s")
def signature_cardinality(spark, sf):
    return _documents(spark, sf).select(T.signature(F.col("text"), PROSE).alias("signature")).agg(F.count("*").alias("n"), F.countDistinct("signature").alias("n_signatures"))


@_query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders")
def contexts_ranked(spark, sf):
    rows = _table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return metrics.ordered(rows, ["o_custkey"], "o_totalprice", "o_orderkey").select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"))


@_query("""WITH o AS (SELECT doc_id AS id, sha1(text) AS h FROM documents WHERE doc_id % 5 <> 0), n AS (SELECT doc_id AS id, sha1(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 3 <> 0)
  SELECT CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN o.h = n.h THEN 'unchanged' ELSE 'modified' END AS change, count(*) AS n, min(coalesce(o.id, n.id)) AS first_id FROM o FULL JOIN n ON o.id = n.id GROUP BY 1""")
def snapshot_diff(spark, sf):
    docs = _table(spark, sf, "documents")
    old = docs.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("id"), F.sha1(F.col("text").cast("binary")).alias("h"))
    new = docs.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("id"), F.sha1(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).cast("binary")).alias("h"))
    return metrics.compare(old, new, "id", "h").groupBy("change").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@_query("SELECT event_type AS tier, count(*) AS n, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(min(value), 4) AS least FROM events GROUP BY event_type")
def latency_percentiles(spark, sf):
    return metrics.percentiles(_table(spark, sf, "events").withColumnRenamed("event_type", "tier"), ["tier"], "value")


@_query("""SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS exact, count(*) FILTER (event_type = 'view') AS semantic, round(100.0 * count(*) FILTER (event_type IN ('purchase', 'view')) / count(*), 4)::DOUBLE AS hit_rate FROM events GROUP BY user_id""")
def tier_counters(spark, sf):
    kind = F.col("event_type")
    return _table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(kind == "purchase").alias("exact"), F.count_if(kind == "view").alias("semantic"), metrics.share(kind.isin("purchase", "view")).alias("hit_rate"))


@_query("""SELECT lang, count(*) AS n, count(*) FILTER (quality = 1) AS n_good, round(100.0 * count(*) FILTER (quality = 1) / count(*), 4)::DOUBLE AS good_rate, round(100.0 * count(*) FILTER (toxic = 1) / count(*), 4)::DOUBLE AS toxic_rate FROM labels JOIN documents USING (doc_id) GROUP BY lang""")
def compliance_rates(spark, sf):
    rows = _table(spark, sf, "labels").join(_table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("n_good"), metrics.share(F.col("quality") == 1).alias("good_rate"), metrics.share(F.col("toxic") == 1).alias("toxic_rate"))


@_query(f"""WITH {_DOCS}, s AS (SELECT id, {_SIGNATURE} AS signature, {_DOMAIN} AS domain, atoms FROM a), p AS (SELECT signature, max(id) AS plan FROM s WHERE id % 2 = 0 GROUP BY 1),
  v AS (SELECT s.id, s.domain, s.atoms, p.plan, seed.signature <> s.signature AS novel FROM s JOIN s AS seed ON seed.id = s.id - 1 LEFT JOIN p ON p.signature = s.signature WHERE s.id % 2 = 1),
  e AS (SELECT v.*, t.domain AS td, t.atoms AS ta FROM v LEFT JOIN s t ON t.id = v.plan)
  SELECT count(*) AS n, count(*) FILTER (plan IS NOT NULL) AS hits, count(*) FILTER (novel) AS novel, count(*) FILTER (novel AND plan IS NOT NULL) AS novel_hits, count(*) FILTER (plan IS NOT NULL AND NOT (domain = td AND list_has_any(atoms, ta))) AS wrong FROM e""")
def cache_efficacy(spark, sf):
    text = F.col("text")
    rows = _documents(spark, sf).select(F.col("doc_id").alias("id"), T.signature(text, PROSE).alias("signature"), T.atoms(text, PROSE).alias("atoms"))
    rows = rows.withColumn("domain", F.substring_index("signature", "::", 1))
    plans = rows.where("id % 2 = 0").select(F.col("id").alias("plan"), "signature")
    asked = rows.where("id % 2 = 1").join(rows.select((F.col("id") + 1).alias("id"), F.col("signature").alias("seed")), "id")
    hit = R.exact_lookup(asked, plans, "signature", "plan", "plan").withColumn("novel", F.col("seed") != F.col("signature"))
    out = hit.join(rows.select(F.col("id").alias("hit"), F.col("domain").alias("td"), F.col("atoms").alias("ta")), "hit", "left")
    found, right = F.col("hit").isNotNull(), (F.col("domain") == F.col("td")) & F.arrays_overlap("atoms", "ta")
    return out.agg(F.count("*").alias("n"), F.count_if(found).alias("hits"), F.count_if(F.col("novel")).alias("novel"), F.count_if(F.col("novel") & found).alias("novel_hits"), F.count_if(found & ~right).alias("wrong"))


# ---- streams (their batch twins), and what SQL has no words for -----------------------------------


@_query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_tier_counts(spark, sf):
    return E.tumbling(_table(spark, sf, "events")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@_query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g)
  SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, no""")
def session_requests(spark, sf):
    rows = E.sessions(_table(spark, sf, "events"))
    return rows.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")


_SENTENCES = "list_filter(list_transform(string_split(regexp_replace({0}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"
_ITEMS = "list_filter(list_transform(regexp_split_to_array({0}, '(?:^|\\s)(?:\\d{{1,2}}[.)]\\s+|[-*•]\\s+)'), lambda x: trim(x, ' .;')), lambda x: x <> '')"


@_query(f"""WITH q AS (SELECT item_id, trim(text) AS text FROM benchmark),
  p AS (SELECT item_id, text, generate_subscripts(ps, 1) AS part_no, unnest(ps) AS part FROM (SELECT *, CASE WHEN length({_ITEMS.format('text')}) >= 2 THEN {_ITEMS.format('text')} ELSE {_SENTENCES.format('text')} END AS ps FROM q)),
  u AS (SELECT item_id, part_no, generate_subscripts(l, 1) AS sub_no, unnest(l) AS sub FROM (SELECT *, list_filter(list_transform(regexp_split_to_array(part, '(?i),?\\s+(?:and|but|also|plus)\\s+'), lambda x: trim(x)), lambda x: x <> '') AS l FROM p)),
  {_atoms_cte("(SELECT item_id * 1000000 + part_no * 1000 + sub_no AS uid, sub FROM u)", "uid", "sub")},
  v AS (SELECT u.*, a.atoms, lag(a.atoms) OVER (PARTITION BY item_id, part_no ORDER BY sub_no) AS last FROM u JOIN a ON a.id = item_id * 1000000 + part_no * 1000 + sub_no),
  t AS (SELECT item_id, part_no, list(sub ORDER BY sub_no) FILTER (atoms <> ['generic']) AS kept, bool_or(last IS NOT NULL AND list_has_any(atoms, last)) AS shared FROM v GROUP BY ALL),
  s AS (SELECT p.item_id, p.part_no, unnest(CASE WHEN length(kept) >= 2 AND NOT shared THEN kept ELSE [part] END) AS x, generate_subscripts(CASE WHEN length(kept) >= 2 AND NOT shared THEN kept ELSE [part] END, 1) AS n FROM p LEFT JOIN t USING (item_id, part_no)),
  {_atoms_cte("(SELECT item_id * 1000000 + part_no * 1000 + n AS sid, x FROM s)", "sid", "x").replace(" w AS", " w2 AS").replace("FROM w)", "FROM w2)").replace(" k AS", " k2 AS").replace("FROM k)", "FROM k2)").replace(" d AS", " d2 AS").replace("FROM d)", "FROM d2)").replace(" a AS", " a2 AS")},
  o AS (SELECT s.*, a2.atoms FROM s JOIN a2 ON a2.id = item_id * 1000000 + part_no * 1000 + n WHERE a2.atoms <> ['generic']),
  z AS (SELECT item_id, x, atoms, row_number() OVER (PARTITION BY item_id ORDER BY part_no, n) - 1 AS part_no FROM o)
  SELECT item_id, part_no, x AS part, {_SIGNATURE} AS signature FROM z""")
def multi_intent(spark, sf):
    rows = _table(spark, sf, "benchmark").select("item_id", F.posexplode(G.intents(F.col("text"), PROSE)).alias("part_no", "part"))
    return rows.select("item_id", F.col("part_no").cast("long").alias("part_no"), "part", T.signature(F.col("part"), PROSE).alias("signature"))


_KEYWORDS = "array_to_string(atoms, ' ')"
_DRAWN = "(('0x' || substring(md5({0}), 1, 8))::BIGINT % {1})"


def _frames_sql() -> str:
    """The texts tried, as a SQL list over keywords k and the seed."""

    def framed(frame: str) -> str:
        out = "'" + frame.replace("'", "''") + "'"
        for slot, value in (("{s}", "k"), ("{S}", "upper(lower(k)[1]) || lower(k)[2:]"), ("{d}", f"'{P.DEVICE}'"), ("{k}", "k")):
            out = f"replace({out}, '{slot}', {value})"
        return out

    def turn(t: int) -> str:
        frames = P.FRAMES[t % len(P.FRAMES)]
        chosen = f"[{', '.join(map(framed, frames))}][{_DRAWN.format(f"seed || ':{t}'", len(frames))} + 1]"
        if frames is not P.FRAMES[-1]:
            return chosen
        key = f"seed || ':{t}:' || (i - 1) || ':"
        at = f"({_DRAWN.format(key + "place'", 'greatest(length(w) - 2, 1)')} + 2)"
        left_out = f"w[1:{at} - 1] || w[{at} + 1:]"
        swapped = f"w[1:{at} - 1] || w[{at} + 1] || w[{at}] || w[{at} + 2:]"
        edited = f"CASE WHEN length(w) < 4 THEN w WHEN {_DRAWN.format(key + "kind'", 2)} = 0 THEN {left_out} ELSE {swapped} END"
        return f"array_to_string(list_transform(list_filter(regexp_split_to_array({chosen}, '\\s+'), lambda w: w <> ''), lambda w, i: {edited}), ' ')"

    return f"list_concat([trim(text)], [{', '.join(map(turn, range(P.TRIED)))}])"


@_query(f"""WITH {_atoms_cte("benchmark", "item_id", "text")}, s AS (SELECT item_id, item_id AS seed, text, {_KEYWORDS} AS k FROM benchmark JOIN a ON a.id = item_id),
  l AS (SELECT item_id, {_frames_sql()} AS tried FROM s), u AS (SELECT item_id, list_filter(tried, lambda x, i: list_position(tried, x) = i)[1:{P.KEPT}] AS v FROM l)
  SELECT item_id, generate_subscripts(v, 1) - 1 AS position, unnest(v) AS variation FROM u""")
def paraphrases(spark, sf):
    words = F.array_join(T.atoms(F.col("text"), PROSE), " ")
    rows = _table(spark, sf, "benchmark").select("item_id", F.posexplode(P.paraphrases(F.col("text"), words, F.col("item_id"))).alias("position", "variation"))
    return rows.withColumn("position", F.col("position").cast("long"))


@_query()
def hashed_encoder(spark, sf):
    ship(spark)
    rows = _table(spark, sf, "benchmark").select("item_id", U.encode(F.col("text")).alias("vector"))
    used = F.filter("vector", lambda x: x > 0)
    return rows.select("item_id", F.size("vector").alias("n"), F.size(used).alias("n_used"), F.round(R.dot(F.col("vector"), F.col("vector")), 4).alias("norm"))


# taken apart, a letter with an accent is the letter and a mark that parts words
_APART = "array_to_string(list_transform(string_split(lower(coalesce(text, '')), ''), lambda c: CASE WHEN strip_accents(c) <> c THEN strip_accents(c) || chr(769) ELSE c END), '')"


@_query(f"SELECT doc_id, length({_TOKENS.format(_APART)}) AS n_tokens FROM documents")
def folded_text(spark, sf):
    ship(spark)
    rows = _documents(spark, sf).select("doc_id", U.normal(F.col("text")).alias("folded"))
    return rows.select("doc_id", F.size(T.tokens(F.col("folded"))).alias("n_tokens"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _queries | cases.queries()


def oracle_sql() -> dict[str, str]:
    return _sql | cases.oracle_sql()
