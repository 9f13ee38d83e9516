"""Every retrieval query by its inventory row, with the SQL that must agree.

A query is registered with @query(name, sql); rows whose rules are sequential scans have no SQL and are tested by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamline.functions import ids, text, vectors
from loamline.operators import blocks, chunking, embedding, extract, maintenance, reading, registry, retrieval, vector_index
from loamline.sources import corpus, crawl, feeds, files, web
from loamline.streaming import feed_entries

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

#: The fixed query of the flagship and of the search rows.
QUERY = "the and of"
RES = f"""res AS (
  SELECT lang AS store_id, source AS source_id, 'doc://' || doc_id AS uri, sha256('text:' || text) AS content_hash,
         CASE WHEN doc_id % 3 = 0 THEN 'text/markdown' ELSE 'text/plain' END AS mime,
         strftime(make_timestamp(({corpus.EPOCH} + doc_id * 3600) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS fetched_at,
         CASE WHEN doc_id % 10 = 0 THEN 'stale' ELSE '{corpus.POLICY}' END AS policy_version, text, doc_id
  FROM documents
), ch AS (
  SELECT *, sha256(uri || '|' || content_hash) AS resource_id, sha256(sha256(uri || '|' || content_hash) || '|0|' || text || '|0') AS chunk_id FROM res
)"""
TOK = """tok AS (SELECT store_id, source_id, mime, uri, fetched_at, chunk_id, list_filter(string_split_regex(lower(strip_accents(text)), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS terms FROM ch)"""


def bm25_sql(terms: list[str], embedded: bool = False) -> str:
    """CTEs up to bm(store_id, chunk_id, score, ...) for single terms, repeats counted."""
    kinds = list(dict.fromkeys(terms))
    f = ", ".join(f"len(list_filter(terms, lambda x: x = '{t}')) AS f{k}" for k, t in enumerate(kinds))
    n = ", ".join(f"sum((f{k} > 0)::INT) AS n{k}" for k in range(len(kinds)))
    part = " + ".join(
        f"{terms.count(t)} * CASE WHEN ln((cnt - n{k} + 0.5) / (n{k} + 0.5)) <= 0 THEN 1e-6 ELSE ln((cnt - n{k} + 0.5) / (n{k} + 0.5)) END * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * len / mean))" for k, t in enumerate(kinds)
    )
    hit = " AND ".join(f"f{k} > 0" for k in range(len(kinds)))
    source = TOK.replace("FROM ch)", "FROM ch WHERE doc_id IN (SELECT vec_id FROM embeddings))") if embedded else TOK
    return f"{RES}, {source}, tf AS (SELECT *, len(terms) AS len, {f} FROM tok), st AS (SELECT count(*)::DOUBLE AS cnt, avg(len) AS mean, {n} FROM tf), bm AS (SELECT store_id, source_id, mime, uri, fetched_at, chunk_id, {part} AS score FROM tf, st WHERE {hit})"


def leg_sql(scored: str, name: str, where: str = "true", k: int = 50) -> str:
    return f"""{name} AS (SELECT store_id, chunk_id, score, row_number() OVER (ORDER BY score DESC, store_id, chunk_id) - 1 AS rank
      FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY score DESC, chunk_id) AS r FROM {scored} WHERE {where}) WHERE r <= {k})"""


def rrf_sql(dense: str, words: str) -> str:
    return f"""fused AS (SELECT coalesce(a.store_id, b.store_id) AS store_id, coalesce(a.chunk_id, b.chunk_id) AS chunk_id,
      coalesce(1.0::DOUBLE / (60 + a.rank + 1), 0) + coalesce(1.0::DOUBLE / (60 + b.rank + 1), 0) AS fused, a.score AS dense_score, b.score AS bm25_score
      FROM {dense} a FULL OUTER JOIN {words} b ON a.store_id = b.store_id AND a.chunk_id = b.chunk_id)"""


VEC = "vec AS (SELECT 's' || label AS store_id, lpad(vec_id::VARCHAR, 8, '0') AS chunk_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), q AS (SELECT v AS w FROM vec WHERE chunk_id = '00000000')"
COS = "cosd AS (SELECT store_id, chunk_id, 1 - (1 - list_dot_product(v, w) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(w, w)))) / 2 AS score FROM vec, q)"
HAM = "hamd AS (SELECT store_id, chunk_id, 1 - list_sum(list_transform(list_zip(v, w), lambda p: ((p[1] >= 0) <> (p[2] >= 0))::INT))::DOUBLE / len(v) AS score FROM vec, q)"


def query(name: str, sql: str | None = None):
    def register(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return register


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return [float(x) for x in corpus.table(spark, sf_dir, "embeddings").filter("vec_id = 0").first()["embedding"]]


def _rounded(frame: DataFrame, *columns: str) -> DataFrame:
    return frame.withColumns({c: F.round(c, 6) for c in columns})


# --- identity and sources --------------------------------------------------------------------------------------------


@query("S6_resources", f"WITH {RES} SELECT store_id, source_id, resource_id, uri, mime, fetched_at, content_hash FROM ch")
def s6(spark, sf_dir):
    return corpus.resources(spark, sf_dir).select("store_id", "source_id", "resource_id", "uri", "mime", "fetched_at", "content_hash")


@query("C15_chunk_ids", f"WITH {RES} SELECT resource_id, chunk_id FROM ch")
def c15(spark, sf_dir):
    return corpus.chunks(spark, sf_dir).select("resource_id", "chunk_id")


@query("B5_content_hash", "SELECT conv_id, sha256(string_agg('message:' || text || chr(1) || 'p' || turn, chr(0) ORDER BY turn)) AS content_hash FROM conversations GROUP BY conv_id")
def b5(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.lit("message").alias("kind"), "text", F.col("turn").alias("page")))).alias("b"))
    return rows.select("conv_id", ids.content_hash(F.col("b")).alias("content_hash"))


_PATH = "regexp_extract(url, '://[^/?#]*/([^?#]*)', 1)"


@query("S2_selected_paths", f"SELECT page_id, p AS path FROM (SELECT page_id, {_PATH} AS p FROM pages) WHERE regexp_matches(p, '^(?:.*/)?[^/]*\\.html$') AND NOT regexp_matches(p, '^(de|es)(/|$)')")
def s2(spark, sf_dir):
    path = F.regexp_extract("url", "://[^/?#]*/([^?#]*)", 1)
    return corpus.table(spark, sf_dir, "pages").select("page_id", path.alias("path")).filter(files.selected(F.col("path"), ["**/*.html"], ["de", "es"]))


@query("S3_globs", f"SELECT page_id, regexp_matches({_PATH}, '^en/[^/]*$') AS one_level, regexp_matches({_PATH}, '^en/.*$') AS any_level FROM pages")
def s3(spark, sf_dir):
    path = F.regexp_extract("url", "://[^/?#]*/([^?#]*)", 1)
    return corpus.table(spark, sf_dir, "pages").select("page_id", files.matches(path, ["en/*"]).alias("one_level"), files.matches(path, ["en/**"]).alias("any_level"))


_TITLE = "nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title(?:\\s[^>]*)?>(.*?)</title\\s*>', 1), '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')), '')"
_MAIN = "coalesce(nullif(regexp_extract(html, '(?is)<article(?:\\s[^>]*)?>(.*)</article\\s*>', 1), ''), html)"
_BODY = f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_MAIN}, '(?is)<script(?:\\s[^>]*)?>.*?</script\\s*>', ' ', 'g'), '(?is)<style(?:\\s[^>]*)?>.*?</style\\s*>', ' ', 'g'), '(?is)<nav(?:\\s[^>]*)?>.*?</nav\\s*>', ' ', 'g'), '(?is)<footer(?:\\s[^>]*)?>.*?</footer\\s*>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"


#: A page's URL may recur: what is known of a URL is its known page of the least page_id, and each page is judged against that.
@query("S8_url_outcomes", rf"""WITH b AS (SELECT page_id, url, html, {_BODY} AS body FROM pages), k AS (SELECT url, hash FROM (SELECT url, sha256('text:' || body) AS hash, row_number() OVER (PARTITION BY url ORDER BY page_id, html) AS r FROM b WHERE page_id % 5 = 0) WHERE r = 1),
  o AS (SELECT url, html, coalesce(body, '') AS body, sha256('text:' || coalesce(body, '')) AS content_hash FROM b)
SELECT url AS uri, CASE WHEN html IS NULL THEN 'FetchError' WHEN NOT regexp_matches(html, '^\s*<') THEN 'Unsupported' WHEN body = '' THEN 'Empty' WHEN content_hash = hash THEN 'Unchanged' ELSE 'Indexed' END AS outcome, content_hash FROM o LEFT JOIN k USING (url)""")
def s8(spark, sf_dir):
    pages = corpus.table(spark, sf_dir, "pages")
    first = pages.filter("page_id % 5 = 0").groupBy(F.col("url").alias("uri")).agg(F.min_by("html", F.struct("page_id", "html")).alias("html"))
    known = first.select("uri", F.sha2(F.concat(F.lit("text:"), extract.html_text(F.col("html"))), 256).alias("content_hash"))
    return web.url_outcomes(pages, known).select("uri", "outcome", "content_hash")


@query("X8_articles", r"""WITH p AS (SELECT page_id, regexp_extract_all(html, '(?i)</?article(?:[\s/][^>]*)?>') AS tags, string_split_regex(html, '(?i)</?article(?:[\s/][^>]*)?>') AS pieces FROM pages),
t AS (SELECT page_id, k, lower(tags[k]) LIKE '</%' AS shuts, sum(CASE WHEN tags[k] LIKE '</%' THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY k) AS after FROM (SELECT page_id, tags, unnest(range(1, len(tags) + 1)) AS k FROM p)),
m AS (SELECT o.page_id, o.k AS i, min(c.k) AS j FROM t o LEFT JOIN t c ON c.page_id = o.page_id AND c.k > o.k AND c.after = o.after - 1 WHERE NOT o.shuts GROUP BY o.page_id, o.k),
x AS (SELECT page_id, i, pieces[i + 1] || array_to_string(list_transform(range(i + 1, coalesce(j, len(tags) + 1)), lambda k: tags[k] || pieces[k + 1]), '') AS body FROM m JOIN p USING (page_id))
SELECT page_id, coalesce(n, 0) AS n, md5(coalesce(body, '')) AS digest FROM p LEFT JOIN (SELECT page_id, count(*) AS n, string_agg(body, '' ORDER BY i) AS body FROM x GROUP BY page_id) USING (page_id)""")
def x8_articles(spark, sf_dir):
    found = corpus.table(spark, sf_dir, "pages").select("page_id", extract.inner_markup(F.col("html"), "article").alias("found"))
    return found.select("page_id", F.size("found").cast("long").alias("n"), F.md5(F.array_join("found", "")).alias("digest"))


@query("X8_html_text", f"SELECT page_id, {_BODY} AS text FROM pages")
def x8(spark, sf_dir):
    return corpus.table(spark, sf_dir, "pages").select("page_id", extract.html_text(F.col("html")).alias("text"))


@query("X9_html_title", f"SELECT page_id, {_TITLE} AS title FROM pages")
def x9(spark, sf_dir):
    return corpus.table(spark, sf_dir, "pages").select("page_id", extract.html_title(F.col("html")).alias("title"))


@query("X10_html_markdown")
def x10(spark, sf_dir):
    raw = corpus.table(spark, sf_dir, "pages").select(F.col("url").alias("uri"), F.col("html").cast("binary").alias("content"))
    return extract.parse_documents(raw, [("html", extract.parse_html)])


@query("S18_globally_routable_all", """WITH ips AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}')) AS ip FROM documents), o AS (
  SELECT doc_id, ip, list_transform(string_split(ip, '.'), lambda x: x::BIGINT) AS k FROM ips), n AS (SELECT doc_id, ip, list_max(k) <= 255 AS valid, k[1] * 16777216 + k[2] * 65536 + k[3] * 256 + k[4] AS v FROM o)
SELECT doc_id, ip, valid AND NOT (v // 16777216 IN (0, 10, 127) OR v // 16777216 >= 224 OR v // 65536 IN (43518, 49320) OR v // 1048576 = 2753 OR v // 4194304 = 401 OR v // 131072 = 25353
  OR v // 256 IN (12582912, 12582914, 12605539, 12989284, 13303921)) AS routable FROM n""")  # fmt: skip
def s18_all(spark, sf_dir):
    """A row for each address; S18_globally_routable, as its SQL, judges the first one of a text."""
    ips = F.regexp_extract_all("text", F.lit(r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"), F.lit(0))
    return corpus.table(spark, sf_dir, "documents").select("doc_id", F.explode(ips).alias("ip")).withColumn("routable", web.globally_routable(F.col("ip")))


# Feed entries made of events: a user's feed, whose entries repeat a URI now and then.
_ENTRIES = "e AS (SELECT 'feed://' || (user_id % 20) AS feed, 'https://e.example/' || (event_id // 3) AS uri, event_id AS ordinal, CASE WHEN event_id % 7 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS published, CASE WHEN event_id % 14 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS updated, event_type AS title FROM events)"


def _feed_entries(spark, sf_dir):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return corpus.table(spark, sf_dir, "events").select(
        F.concat(F.lit("feed://"), (F.col("user_id") % 20).cast("string")).alias("feed"),
        F.concat(F.lit("https://e.example/"), F.floor(F.col("event_id") / 3).cast("string")).alias("uri"),
        F.col("event_id").alias("ordinal"),
        F.when(F.col("event_id") % 7 != 0, stamp).alias("published"),
        F.when(F.col("event_id") % 14 == 0, stamp).alias("updated"),
        F.col("event_type").alias("title"),
    )


@query("S10_feed_sort", f"WITH {_ENTRIES} SELECT feed, uri, ordinal, row_number() OVER (PARTITION BY feed ORDER BY coalesce(published, updated) DESC NULLS LAST, ordinal) - 1 AS position FROM e")
def s10(spark, sf_dir):
    rows = _feed_entries(spark, sf_dir)
    own = Window.partitionBy("feed").orderBy(F.coalesce("published", "updated").desc_nulls_last(), "ordinal")
    return rows.select("feed", "uri", "ordinal", (F.row_number().over(own) - 1).cast("long").alias("position"))


#: One row for each URL: the state of its first page, and the response that responses() takes, by status and digest of the body. A name that is nothing but .docx has no extension, so no parser takes it.
@query("S8_fetch_outcomes", """WITH p AS (SELECT url || CASE WHEN page_id % 12 = 9 THEN '.docx' ELSE '' END AS uri, page_id, page_id % 12 AS k, sha256(html) AS hash, CASE page_id % 12 WHEN 1 THEN 304 WHEN 2 THEN 404 WHEN 3 THEN 410 WHEN 4 THEN 403 WHEN 6 THEN 503 WHEN 7 THEN NULL ELSE 200 END AS status,
    CASE page_id % 12 WHEN 8 THEN sha256('%PDF-1.7 no reader') WHEN 9 THEN sha256(unhex('504B0304FFFE00')) WHEN 10 THEN sha256('<html> </html>') WHEN 0 THEN sha256(html) WHEN 11 THEN sha256(html) END AS body FROM pages WHERE url IS NOT NULL),
  old AS (SELECT uri, k, hash FROM (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY page_id, hash) AS r FROM p) WHERE r = 1),
  new AS (SELECT uri, k, status, body FROM (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY status DESC NULLS LAST, coalesce(body, sha256('')) DESC) AS r FROM p) WHERE r = 1),
  told AS (SELECT uri, hash, body, CASE WHEN new.k IN (4, 5) THEN 'Blocked' WHEN new.k = 1 THEN 'Unchanged' WHEN new.k IN (2, 3) THEN 'Gone' WHEN body IS NULL THEN 'FetchError' WHEN body = hash AND old.k <> 11 THEN 'Unchanged'
    WHEN new.k = 8 THEN 'Unsupported' WHEN new.k = 9 THEN CASE WHEN uri LIKE '%/.docx' THEN 'Unsupported' ELSE 'ParseFailed' END WHEN new.k = 10 THEN 'Empty' ELSE 'Indexed' END AS outcome FROM new JOIN old USING (uri))
SELECT uri, outcome, CASE WHEN outcome = 'Gone' THEN NULL WHEN outcome IN ('Unchanged', 'Indexed') THEN 'new' ELSE 'old' END AS etag, CASE outcome WHEN 'Gone' THEN NULL WHEN 'Indexed' THEN body ELSE hash END AS body_hash FROM told""")
def s8_all(spark, sf_dir):
    """Responses to a second fetch of all pages, a twelfth of each kind, with the state of the first: outcomes and the state after, by URL. Of pages with one URL the one of the least page_id was fetched first."""
    k = F.col("page_id") % 12
    # Parsers go by names: what is called a document and holds none is what fails.
    pages = corpus.table(spark, sf_dir, "pages").withColumn("url", F.concat("url", F.when(k == 9, ".docx").otherwise("")))
    text_of = lambda x: F.lit(x).cast("binary")
    status = F.when(k == 1, 304).when(k == 2, 404).when(k == 3, 410).when(k == 4, 403).when(k == 6, 503).when(k != 7, 200)
    body = F.when(k == 8, text_of("%PDF-1.7 no reader")).when(k == 9, F.unhex(F.lit("504B0304FFFE00"))).when(k == 10, text_of("<html> </html>")).when(k.isin(0, 11), F.col("html").cast("binary"))
    got = pages.select("url", status.alias("status"), body.alias("body"), F.lit("new").alias("etag"), F.lit(None).cast("string").alias("last_modified"), (k == 5).alias("blocked"))
    # Pages of kind 11 were indexed under an earlier policy, so the same body is parsed anew.
    digest = F.sha2(F.col("html").cast("binary"), 256)
    first = pages.filter("url IS NOT NULL").select("url", F.struct("page_id", digest.alias("hash")).alias("p")).groupBy("url").agg(F.min("p").alias("p")).withColumn("k", F.col("p.page_id") % 12)
    known = first.select(
        F.lit("s").alias("store_id"), F.lit("u").alias("source_id"), F.col("url").alias("uri"), F.lit("Indexed").alias("outcome"), F.lit("old").alias("etag"), F.lit(None).cast("string").alias("last_modified"),
        F.col("p.hash").alias("body_hash"), F.when(F.col("k") == 11, "earlier").otherwise("p").alias("policy_version"), F.lit(None).cast("string").alias("fetched_at"),
    )
    store = maintenance.Snapshots(spark, corpus.new_folder(spark, "fetches"))
    with store.scratch() as keep:
        found, _ = crawl.outcomes(crawl.responses(got), known, "p", keep)
        store.write({"fetches": crawl.after(known, found, "s", "u", "p")})
    # A body that was fetched again unchanged comes with new validators.
    return store.read("fetches").select("uri", "outcome", "etag", "body_hash")


@query("S11_entry_stream", """SELECT feed, uri, published, seq FROM (SELECT source AS feed, client_id::VARCHAR AS uri, strftime(valid_at, '%Y-%m-%dT%H:%M:%S') AS published, seq,
  row_number() OVER (PARTITION BY source, client_id ORDER BY valid_at DESC NULLS LAST, seq DESC) AS r FROM client_changes WHERE source IS NOT NULL AND client_id IS NOT NULL) WHERE r = 1""")
def s11_stream(spark, sf_dir):
    """The changes of clients as entries of their sources, read as a stream that sees every file: late and repeated versions leave the newest of each."""
    rows = corpus.table(spark, sf_dir, "client_changes")
    # By a pattern, as a stream can't start from a path that is one file.
    stream = spark.readStream.schema(rows.schema).parquet(f"{sf_dir}/client_change[s].parquet")
    entries = stream.select(
        F.col("source").alias("feed"), F.col("client_id").cast("string").alias("uri"), F.date_format("valid_at", "yyyy-MM-dd'T'HH:mm:ss").alias("published"),
        F.lit(None).cast("string").alias("updated"), (-F.col("seq")).alias("ordinal"), "op", "segment", "city", "balance",
    )
    folder = corpus.new_folder(spark, "entries")
    store = maintenance.Snapshots(spark, f"{folder}/store")
    feed_entries.follow(entries, store, "clients", f"{folder}/checkpoint").awaitTermination()
    return store.read("entries").select("feed", "uri", "published", (-F.col("ordinal")).alias("seq"))


@query("S11_feed_dedup", f"""WITH {_ENTRIES}, d AS (SELECT *, row_number() OVER (PARTITION BY feed, uri ORDER BY coalesce(published, updated) DESC NULLS LAST, ordinal) AS r FROM e),
  p AS (SELECT feed, uri, ordinal, (row_number() OVER (PARTITION BY feed ORDER BY coalesce(published, updated) DESC NULLS LAST, ordinal) - 1) AS position FROM d WHERE r = 1) SELECT * FROM p WHERE position < 25""")
def s11(spark, sf_dir):
    return feeds.newest(_feed_entries(spark, sf_dir), 25).select("feed", "uri", "ordinal", F.col("position").cast("long").alias("position"))


@query("S12_entry_uri", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'https://a.example/' || event_id WHEN 1 THEN 'https://b.example/' || event_id ELSE 'feed://x#entry:' || event_id END AS uri, event_id % 3 <> 2 AS fetchable FROM events")
def s12(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "events").withColumn("id", F.col("event_id").cast("string"))
    link = lambda host, rel: F.struct(F.concat(F.lit(host), F.col("id")).alias("href"), F.lit(rel).cast("string").alias("rel"))
    self_link, other = link("https://self.example/", "self"), link("https://c.example/", "enclosure")
    links = F.when(F.col("event_id") % 3 == 0, F.array(self_link, link("https://a.example/", None))).when(F.col("event_id") % 3 == 1, F.array(other, link("https://b.example/", "alternate"))).otherwise(F.array(self_link, other))
    uri = feeds.entry_uri(F.lit("feed://x"), F.col("id"), links)
    return rows.select("event_id", uri.alias("uri")).withColumn("fetchable", feeds.fetchable(F.col("uri")))


@query("S13_authors", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'u' || user_id WHEN 1 THEN 'u' || user_id || '@e.example' ELSE 'Feed' END AS names FROM events")
def s13(spark, sf_dir):
    u = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    person = lambda n, e: F.struct(n.cast("string").alias("name"), e.cast("string").alias("email"))
    own = F.when(F.col("event_id") % 3 == 0, F.array(person(u, F.lit(None)))).when(F.col("event_id") % 3 == 1, F.array(person(F.lit("Author"), F.concat(u, F.lit("@e.example"))))).otherwise(F.filter(F.array(person(u, u)), lambda x: F.lit(False)))
    return corpus.table(spark, sf_dir, "events").select("event_id", F.array_join(feeds.inherited_authors(own, F.array(person(F.lit("Feed"), F.lit(None)))), ", ").alias("names"))


@query("S14_fallback", """SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'page ' || page_id WHEN 5 THEN NULL WHEN 1 THEN 'content ' || page_id WHEN 2 THEN 'summary' ELSE 'title' END AS body FROM pages""")
def s14(spark, sf_dir):
    k = F.col("page_id") % 6
    outcome = F.when(k == 0, "Indexed").when(k == 5, "FetchError").when(k == 1, "Gone").when(k == 2, "Blocked").when(k == 3, "Empty").otherwise("Unsupported")
    content = F.when(k == 1, F.concat(F.lit("<p>content  "), F.col("page_id").cast("string"), F.lit("</p>")))
    body = feeds.fallback_body(outcome, F.concat(F.lit("page "), F.col("page_id").cast("string")), content, F.when(k == 2, "<b>summary</b>"), F.lit("title"))
    return corpus.table(spark, sf_dir, "pages").select("page_id", body.alias("body"))


@query("S15_feed_document", f"""WITH {_ENTRIES}, d AS (SELECT *, row_number() OVER (PARTITION BY feed, uri ORDER BY coalesce(published, updated) DESC NULLS LAST, ordinal) AS r FROM e),
  p AS (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY coalesce(published, updated) DESC NULLS LAST, ordinal) - 1 AS position FROM d WHERE r = 1)
SELECT feed, '# ' || feed || chr(10) || chr(10) || string_agg(concat_ws(chr(10) || chr(10), '## ' || title, '*' || coalesce(published, updated) || '*', uri), chr(10) || chr(10) ORDER BY position) AS markdown FROM p WHERE position < 10 GROUP BY feed""")
def s15(spark, sf_dir):
    rows = feeds.newest(_feed_entries(spark, sf_dir), 10).withColumns({"feed_title": F.lit(None).cast("string"), "feed_description": F.lit(None).cast("string"), "names": F.array().cast("array<string>"), "entry_body": F.col("uri")})
    return feeds.single_document(rows)


# --- extraction helpers ----------------------------------------------------------------------------------------------

_URLNAME = "regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '')"


@query("X2_stored_mime", f"SELECT page_id, CASE WHEN {_URLNAME} LIKE '%.html' THEN 'text/html' ELSE 'application/octet-stream' END AS mime FROM pages")
def x2(spark, sf_dir):
    return corpus.table(spark, sf_dir, "pages").select("page_id", files.stored_mime(text.last_segment(F.col("url"))).alias("mime"))


@query("X3_extension", f"SELECT page_id, nullif(regexp_extract(string_split({_URLNAME}, '/')[-1], '^.+\\.([^.]*)$', 1), '') AS ext, string_split({_URLNAME}, '/')[-1] AS segment FROM pages")
def x3(spark, sf_dir):
    segment = text.last_segment(F.col("url"))
    return corpus.table(spark, sf_dir, "pages").select("page_id", text.extension(segment).alias("ext"), segment.alias("segment"))


@query("X5_markdown_title", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN nullif(trim(string_split(text, chr(10))[1]), '') END AS title FROM documents")
def x5(spark, sf_dir):
    made = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("intro\r\n\r\n# "), F.col("text"), F.lit("\r\n# Second"))).otherwise(F.concat(F.lit("## "), F.col("text")))
    return corpus.table(spark, sf_dir, "documents").select("doc_id", extract.markdown_title(made).alias("title"))


@query("X14_scanned", "WITH n AS (SELECT doc_id, length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) AS k, strlen(text) * (1 + doc_id % 20) AS size FROM documents) SELECT doc_id, k < 20 OR k < size * 0.1::DOUBLE AS scanned FROM n")
def x14(spark, sf_dir):
    return corpus.table(spark, sf_dir, "documents").select("doc_id", text.scanned(F.col("text"), F.octet_length("text") * (1 + F.col("doc_id") % 20)).alias("scanned"))


@query("X17_prose_like", """WITH w AS (SELECT doc_id, trim(text, ' ') AS t, list_filter(string_split_regex(trim(text, ' '), '\\s+'), lambda x: x <> '') AS words FROM documents), k AS (
  SELECT doc_id, len(words) AS n, length(regexp_replace(t, '[^\\p{L}]', '', 'g'))::DOUBLE AS letters, greatest(length(regexp_replace(t, '\\s', '', 'g')), 1) AS solid,
    len(list_filter(words, lambda x: regexp_matches(regexp_replace(x, '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g'), '^\\p{L}+$')))::DOUBLE AS plain,
    length(regexp_replace(t, '[^.,?!]', '', 'g'))::DOUBLE / greatest(length(t), 1) AS marks FROM w)
SELECT doc_id, CASE WHEN n < 8 THEN false ELSE letters / solid > 0.85 AND plain / n > 0.70 AND letters / n BETWEEN 3.0 AND 8.0 AND marks > 0.005 END AS prose FROM k""")
def x17(spark, sf_dir):
    return corpus.table(spark, sf_dir, "documents").select("doc_id", text.prose_like(F.col("text")).alias("prose"))


@query("X18_soft_hyphens", "SELECT doc_id, md5(text) AS digest FROM documents")
def x18(spark, sf_dir):
    marked = F.replace(F.col("text"), F.lit("e"), F.lit("e­"))
    return corpus.table(spark, sf_dir, "documents").select("doc_id", F.md5(text.strip_soft_hyphens(marked)).alias("digest"))


@query("X19_pdf_date", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y') WHEN 1 THEN strftime(ts, '%Y-%m') WHEN 2 THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS iso FROM events""")
def x19(spark, sf_dir):
    raw = F.concat(F.lit("D:"), F.when(F.col("event_id") % 4 == 0, F.date_format("ts", "yyyy")).when(F.col("event_id") % 4 == 1, F.date_format("ts", "yyyyMM")).when(F.col("event_id") % 4 == 2, F.date_format("ts", "yyyyMMdd")).otherwise(F.date_format("ts", "yyyyMMddHHmmss")))
    return corpus.table(spark, sf_dir, "events").select("event_id", text.pdf_date(raw).alias("iso"))


@query("X20_keywords_whole", "SELECT doc_id, array_to_string(list_filter(list_transform(string_split_regex(text, '[,;]'), lambda x: trim(x)), lambda x: x <> ''), '|') AS keywords FROM documents")
def x20_whole(spark, sf_dir):
    """X20_keywords, as its SQL, takes 200 characters of each text."""
    return corpus.table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.keywords(F.col("text")), "|").alias("keywords"))


@query("X21_page_ranges", """WITH p AS (SELECT DISTINCT user_id AS k, event_id % 40 AS page FROM events), i AS (SELECT k, page, page - row_number() OVER (PARTITION BY k ORDER BY page) AS g FROM p),
  s AS (SELECT k, min(page) AS a, max(page) AS b FROM i GROUP BY k, g) SELECT k, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) AS ranges FROM s GROUP BY k""")
def x21(spark, sf_dir):
    return extract.page_ranges(corpus.table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), (F.col("event_id") % 40).alias("page")), "k", "page")


# --- blocks and chunks -----------------------------------------------------------------------------------------------


def _markdown(spark, sf_dir):
    """Documents as Markdown: the first line of each is a heading, whose level and the next one's follow from the id."""
    docs = corpus.table(spark, sf_dir, "documents")
    lines = F.split("text", "\n", -1)
    body = F.array_join(F.transform(lines, lambda x, k: F.when(k % 3 == 0, F.concat(F.repeat(F.lit("#"), ((k / 3).cast("int") + F.col("doc_id").cast("int")) % 3 + 1), F.lit(" H"), k.cast("string"))).otherwise(x)), "\n\n")
    return docs.select(F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("uri"), body.alias("markdown"))


@query("B2_blocks")
def b2(spark, sf_dir):
    return blocks.blocks_of(_markdown(spark, sf_dir))


@query("B6_heading_paths", """WITH h AS (SELECT doc_id, unnest(range(0, 12)) AS seq FROM documents), k AS (SELECT *, (seq + doc_id) % 3 + 1 AS level, 'H' || seq AS text FROM h),
  w AS (SELECT a.doc_id, a.seq, b.level, max(b.seq) AS top FROM k a LEFT JOIN k b ON a.doc_id = b.doc_id AND b.seq < a.seq GROUP BY a.doc_id, a.seq, b.level),
  o AS (SELECT x.doc_id, x.seq, x.level, x.top FROM w x WHERE NOT EXISTS (SELECT 1 FROM w y WHERE y.doc_id = x.doc_id AND y.seq = x.seq AND y.level < x.level AND y.top > x.top)),
  p AS (SELECT doc_id, seq, max(level) AS depth, max(CASE WHEN level = 1 THEN 'H' || top END) AS a, max(CASE WHEN level = 2 THEN 'H' || top END) AS b, max(CASE WHEN level = 3 THEN 'H' || top END) AS c FROM o GROUP BY doc_id, seq)
SELECT 'doc://' || doc_id AS uri, seq::INT AS seq, array_to_string(list_slice([coalesce(a, ''), coalesce(b, ''), coalesce(c, '')], 1, coalesce(depth, 0)::INT), '>') AS path FROM p""")
def b6(spark, sf_dir):
    docs = corpus.table(spark, sf_dir, "documents").select(F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("uri"), "doc_id", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("seq"))
    made = docs.select("uri", "seq", F.lit("heading").alias("kind"), ((F.col("seq") + F.col("doc_id")) % 3 + 1).cast("int").alias("level"), F.concat(F.lit("H"), F.col("seq").cast("string")).alias("text"))
    return blocks.heading_paths(made).select("uri", "seq", F.array_join("heading_path", ">").alias("path"))


@query("B8_document_text", "SELECT lang AS store_id, conv_id::VARCHAR AS resource_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM (SELECT 'c' AS lang, * FROM conversations) GROUP BY lang, conv_id")
def b8(spark, sf_dir):
    rows = corpus.turns(spark, sf_dir).select(F.lit("c").alias("store_id"), F.col("resource_id").cast("string").alias("resource_id"), "seq", "text")
    return reading.document_text(rows, rows.select("store_id", "resource_id", F.col("seq").alias("block_seq"), F.lit(0).alias("seq_in_block"), "text").filter("false"))


@query("C1_presets", """WITH f AS (SELECT event_id, ['a.rs', 'b/Cargo.lock', 'c.md', 'd', 'e.HTML', 'f.PY', 'yarn.lock', 'g.pdf'][(event_id % 8 + 1)::INT] AS name, [NULL, 'text/plain', 'application/json', 'text/x-rust', 'text/markdown'][(event_id % 5 + 1)::INT] AS mime FROM events)
SELECT event_id, CASE WHEN mime = 'application/json' OR mime LIKE 'text/x-%' THEN 'code' WHEN mime = 'text/plain' THEN 'prose' WHEN name IN ('a.rs', 'b/Cargo.lock', 'f.PY', 'yarn.lock') THEN 'code' ELSE 'prose' END AS preset FROM f""")
def c1(spark, sf_dir):
    pick = lambda values, n: F.element_at(F.array(*(F.lit(v) for v in values)), (F.col("event_id") % n + 1).cast("int"))
    name, mime = pick(["a.rs", "b/Cargo.lock", "c.md", "d", "e.HTML", "f.PY", "yarn.lock", "g.pdf"], 8), pick([None, "text/plain", "application/json", "text/x-rust", "text/markdown"], 5)
    return corpus.table(spark, sf_dir, "events").select("event_id", chunking.preset_for(name, mime).alias("preset"))


@query("C5_document_chunks")
def c5(spark, sf_dir):
    return chunking.chunk_blocks(blocks.blocks_of(_markdown(spark, sf_dir)))


@query("C6_structureless", "SELECT doc_id, list_max(list_transform(string_split_regex(text, '\\s+'), lambda x: length(x))) > 8 * 4 OR list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) > 64 * 4 AS structureless FROM documents")
def c6(spark, sf_dir):
    return corpus.table(spark, sf_dir, "documents").select("doc_id", chunking.structureless(F.col("text"), 4).alias("structureless"))


@query("C10_separator_rows", """WITH l AS (SELECT event_id, ['| --- | :-: |', '|a|b|', '---', '| -- | x |', '|:--|', ' - | - ', '|  |', '::'][(event_id % 8 + 1)::INT] AS line FROM events)
SELECT event_id, line IN ('| --- | :-: |', '---', '|:--|', ' - | - ') AS separator FROM l""")
def c10(spark, sf_dir):
    lines = ["| --- | :-: |", "|a|b|", "---", "| -- | x |", "|:--|", " - | - ", "|  |", "::"]
    line = F.element_at(F.array(*map(F.lit, lines)), (F.col("event_id") % 8 + 1).cast("int"))
    return corpus.table(spark, sf_dir, "events").select("event_id", blocks.separator_row(line).alias("separator"))


@query("C11_message_windows", """WITH t AS (SELECT conv_id, list(turn::INT ORDER BY turn) AS seqs, list('[' || role || ']: ' || text ORDER BY turn) AS said FROM conversations WHERE length(text) > 0 GROUP BY conv_id), w AS (SELECT *, unnest(range(1, len(seqs) + 1, 3)) AS s FROM t)
SELECT conv_id AS resource_id, seqs[s] AS block_seq, array_to_string(list_slice(seqs, s, s + 5), ',') AS window_block_seqs, array_to_string(list_slice(said, s, s + 5), chr(10) || chr(10)) AS text FROM w""")
def c11(spark, sf_dir):
    return chunking.message_windows(corpus.turns(spark, sf_dir)).withColumn("window_block_seqs", F.array_join(F.col("window_block_seqs").cast("array<string>"), ","))


@query("C12_turn_prefix", "SELECT conv_id, turn, '[' || role || '] (' || turn || '): ' || text AS said FROM conversations")
def c12(spark, sf_dir):
    return corpus.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("["), F.col("role"), F.lit("] ("), F.col("turn").cast("string"), F.lit("): "), F.col("text")).alias("said"))


@query("C13_shrunk_windows")
def c13(spark, sf_dir):
    turns = corpus.turns(spark, sf_dir).select("resource_id", "seq", F.lit("message").alias("kind"), "text", "sender")
    return chunking.chunk_blocks(turns, "resource_id")


# --- embedding -------------------------------------------------------------------------------------------------------


@query("E3_embed_chunks")
def e3(spark, sf_dir):
    return embedding.embed_chunks(corpus.chunks(spark, sf_dir).select("resource_id", "chunk_id", "block_seq", "seq_in_block", "text")).select("chunk_id", "embedding")


@query("E4_late_windows", r"""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq FROM documents),
c AS (SELECT doc_id, seq, n, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS k FROM (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l) WHERE n > 0),
w AS (SELECT doc_id, seq, n, k, n AS used, 0 AS own FROM c WHERE k = 1 UNION ALL
  SELECT c.doc_id, c.seq, c.n, c.k, CASE WHEN used + 1 + c.n > 512 THEN c.n ELSE used + 1 + c.n END, own + (used + 1 + c.n > 512)::INT FROM w JOIN c ON c.doc_id = w.doc_id AND c.k = w.k + 1)
SELECT doc_id::VARCHAR AS resource_id, seq::INT AS block_seq, n::INT AS n_tokens, own AS "window" FROM w""")
def e4(spark, sf_dir):
    return embedding.late_windows(corpus.line_chunks(spark, sf_dir), embedding.hashed_context(budget=512)).select("resource_id", "block_seq", "n_tokens", "window")


@query("E5_late_chunks")
def e5(spark, sf_dir):
    """Int8 vectors of every line of every document, each in the context of its window."""
    return embedding.embed_chunks(corpus.line_chunks(spark, sf_dir), embedding.hashed_context(budget=512)).select("resource_id", "block_seq", F.array_join(F.col("embedding").cast("array<int>").cast("array<string>"), ",").alias("q"))


@query("E6_quantise", "SELECT vec_id, array_to_string(list_transform(embedding, lambda x: greatest(-128, least(127, round(tanh(x::DOUBLE) * 127)::INT))), ',') AS q FROM embeddings")
def e6(spark, sf_dir):
    return corpus.table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(vectors.quantise(F.col("embedding")).cast("array<string>"), ",").alias("q"))


@query("R7_bits", """WITH s AS (SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN '1' ELSE '0' END), '') AS b FROM embeddings)
SELECT vec_id, array_to_string(list_transform(range(0, 8), lambda k: lpad(printf('%X', (substr(b, k * 8 + 1, 1)::INT * 128 + substr(b, k * 8 + 2, 1)::INT * 64 + substr(b, k * 8 + 3, 1)::INT * 32 + substr(b, k * 8 + 4, 1)::INT * 16 + substr(b, k * 8 + 5, 1)::INT * 8 + substr(b, k * 8 + 6, 1)::INT * 4 + substr(b, k * 8 + 7, 1)::INT * 2 + substr(b, k * 8 + 8, 1)::INT)), 2, '0')), '') AS packed FROM s""")
def r7(spark, sf_dir):
    return corpus.table(spark, sf_dir, "embeddings").select("vec_id", F.hex(vectors.bits(F.col("embedding"))).alias("packed"))


# --- retrieval -------------------------------------------------------------------------------------------------------


@query("R1_tokens", f"WITH {RES}, {TOK} SELECT chunk_id, len(terms) AS n, md5(array_to_string(terms, ' ')) AS digest FROM tok")
def r1(spark, sf_dir):
    return corpus.chunks(spark, sf_dir).withColumn("t", text.tokens(F.col("text"))).select("chunk_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


@query("A6_postings_statistics", f"WITH {RES}, {TOK}, x AS (SELECT chunk_id, unnest(terms) AS term FROM tok) SELECT term, count(*) AS tf, count(DISTINCT chunk_id) AS df FROM x GROUP BY term")
def a6(spark, sf_dir):
    postings, _ = retrieval.build_postings(corpus.chunks(spark, sf_dir))
    return postings.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


@query("R3_bm25", f"WITH {bm25_sql(['the', 'and', 'of'])} SELECT store_id, chunk_id, round(score, 6) AS score FROM bm")
def r3(spark, sf_dir):
    return _rounded(retrieval.bm25_scores(corpus.chunks(spark, sf_dir), QUERY).select("store_id", "chunk_id", "score"), "score")


@query("R3_bm25_from_postings", f"WITH {bm25_sql(['the', 'and', 'the'])} SELECT store_id, chunk_id, round(score, 6) AS score FROM bm")
def r3_postings(spark, sf_dir):
    return _rounded(retrieval.bm25_from_postings(*retrieval.build_postings(corpus.chunks(spark, sf_dir)), "the and the"), "score")


@query("R4_stored_index", f"WITH {bm25_sql(['the', 'and', 'the'])} SELECT store_id, chunk_id, round(score, 6) AS score FROM bm")
def r4(spark, sf_dir):
    """An index that was written, added to, taken from and added to again, and then holds every document: the query reads its postings alone."""
    rows = corpus.chunks(spark, sf_dir).select("store_id", "resource_id", "chunk_id", "source_id", "text")
    some = F.coalesce(F.col("source_id").isin("src0", "src1"), F.lit(False))
    first, rest = rows.filter(some).drop("source_id"), rows.filter(~some).drop("source_id")
    index = maintenance.Snapshots(spark, corpus.new_folder(spark, "index"))
    maintenance.change_index(index, first)
    maintenance.change_index(index, rest)
    maintenance.change_index(index, removed=first.select("store_id", "resource_id"))
    maintenance.change_index(index, first)
    return _rounded(retrieval.bm25_from_postings(index.read("postings"), index.read("lengths"), "the and the", index.lengths()), "score")


@query("R2_bm25_phrase", f"""WITH {RES}, {TOK}, tf AS (SELECT *, len(terms) AS len, len(list_filter(range(1, len(terms)), lambda k: terms[k] = 'of' AND terms[k + 1] = 'the')) AS f FROM tok),
  st AS (SELECT count(*)::DOUBLE AS cnt, avg(len) AS mean, sum((f > 0)::INT) AS n FROM tf)
SELECT store_id, chunk_id, round(CASE WHEN ln((cnt - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((cnt - n + 0.5) / (n + 0.5)) END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / mean)), 6) AS score FROM tf, st WHERE f > 0""")
def r2(spark, sf_dir):
    return _rounded(retrieval.bm25_scores(corpus.chunks(spark, sf_dir), "of-the").select("store_id", "chunk_id", "score"), "score")


@query("R5_dense_topk", f"WITH {VEC}, {COS}, {leg_sql('cosd', 'a')} SELECT store_id, chunk_id, round(score, 6) AS score, rank FROM a")
def r5(spark, sf_dir):
    scored = retrieval.dense_scores(corpus.vectors(spark, sf_dir), _query_vector(spark, sf_dir))
    return _rounded(retrieval.leg(scored), "score").withColumn("rank", F.col("rank").cast("long"))


#: Vectors with ids divisible by 29 are centres, the first 4,096 of them; centres that are equally near to nine decimals go by id; the nearest ones are probed, two and then twice as many, until each store has its ten.
_CELLS = f"""{VEC}, unit AS (SELECT store_id, chunk_id, v, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM vec), centre AS (SELECT chunk_id AS c, u AS cu FROM unit WHERE chunk_id::BIGINT % 29 = 0 ORDER BY chunk_id LIMIT {vector_index.CELLS}),
  near AS (SELECT c, row_number() OVER (ORDER BY round(list_dot_product(cu, w), 9) DESC, c) AS r FROM centre, q), total AS (SELECT count(*) AS cells FROM centre),
  placed AS (SELECT store_id, chunk_id, v, arg_max(c, struct_pack(d := round(list_dot_product(u, cu), 9), k := -(c::BIGINT))) AS c FROM unit, centre GROUP BY ALL),
  reach AS (SELECT store_id, r, row_number() OVER (PARTITION BY store_id ORDER BY r) AS have, count(*) OVER (PARTITION BY store_id) AS n FROM placed JOIN near USING (c)),
  far AS (SELECT max(r) AS r FROM (SELECT store_id, min(r) AS r FROM reach WHERE have >= least(10, n) GROUP BY store_id)),
  probed AS (SELECT CASE WHEN p >= cells THEN cells ELSE p END AS probes FROM (SELECT 2 * (2 ** greatest(0, ceil(log2(r / 2.0))))::BIGINT AS p FROM far), total),
  read AS (SELECT store_id, chunk_id, 1 - (1 - list_dot_product(v, w) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(w, w)))) / 2 AS score FROM placed JOIN near USING (c), q, probed WHERE r <= probes)"""


@query("R5_indexed_topk", f"WITH {_CELLS}, {leg_sql('read', 'a', k=10)} SELECT store_id, chunk_id, round(score, 6) AS score, rank FROM a")
def r5_indexed(spark, sf_dir):
    rows = corpus.vectors(spark, sf_dir)
    # The centres are given here, so that SQL can name them; without that they are fit.
    centres = [r["embedding"] for r in rows.filter("cast(chunk_id AS bigint) % 29 = 0").orderBy("chunk_id").limit(vector_index.CELLS).collect()]
    index = vector_index.VectorIndex.build(rows, corpus.new_folder(spark, "vectors"), centres)
    return _rounded(index.search(_query_vector(spark, sf_dir), 10, probes=2), "score").withColumn("rank", F.col("rank").cast("long"))


@query("R6_cosine_scores", f"WITH {VEC}, {COS} SELECT store_id, chunk_id, round(score, 6) AS score FROM cosd")
def r6(spark, sf_dir):
    return _rounded(retrieval.dense_scores(corpus.vectors(spark, sf_dir), _query_vector(spark, sf_dir)).select("store_id", "chunk_id", "score"), "score")


@query("R8_hamming_scores", f"WITH {VEC}, {HAM} SELECT store_id, chunk_id, round(score, 6) AS score FROM hamd")
def r8(spark, sf_dir):
    return _rounded(retrieval.dense_scores(corpus.vectors(spark, sf_dir), _query_vector(spark, sf_dir), "bit").select("store_id", "chunk_id", "score"), "score")


@query("R10_rrf", f"WITH {VEC}, {COS}, {HAM}, {leg_sql('cosd', 'a', k=20)}, {leg_sql('hamd', 'b', k=20)}, {rrf_sql('a', 'b')} SELECT store_id, chunk_id, round(fused, 6) AS fused, round(dense_score, 6) AS dense_score, round(bm25_score, 6) AS bm25_score FROM fused")
def r10(spark, sf_dir):
    rows, q = corpus.vectors(spark, sf_dir), _query_vector(spark, sf_dir)
    fused = retrieval.rrf(retrieval.leg(retrieval.dense_scores(rows, q), 20), retrieval.leg(retrieval.dense_scores(rows, q, "bit"), 20))
    return _rounded(fused, "fused", "dense_score", "bm25_score")


@query("R15_search_page", f"""WITH {bm25_sql(['the', 'and', 'of'])}, {leg_sql('bm', 'w')}, p AS (SELECT store_id, chunk_id, 1.0::DOUBLE / (60 + rank + 1) AS fused, row_number() OVER (ORDER BY 1.0::DOUBLE / (60 + rank + 1) DESC, store_id, chunk_id) AS position, count(*) OVER () AS total FROM w)
SELECT position, store_id, chunk_id, round(fused, 6) AS fused, total, CASE WHEN total > 15 THEN 15 END AS next FROM p WHERE position > 5 AND position <= 15""")
def r15(spark, sf_dir):
    words = retrieval.leg(retrieval.bm25_scores(corpus.chunks(spark, sf_dir), QUERY))
    rows = retrieval.page(retrieval.rrf(words.filter("false"), words), 5, 10)
    return _rounded(rows.select(F.col("position").cast("long").alias("position"), "store_id", "chunk_id", "fused", "total", "next"), "fused")


@query("F6_filtered_search", f"""WITH {bm25_sql(['the', 'and', 'of'])}, {leg_sql('bm', 'w', "store_id IN ('en') AND mime = 'text/plain' AND uri LIKE 'doc://1%' AND fetched_at >= '2026-01-01T12:00:00Z' AND fetched_at <= '2026-02-01T00:00:00Z'")} SELECT store_id, chunk_id, round(score, 6) AS score, rank FROM w""")
def f6(spark, sf_dir):
    wanted = retrieval.Filters(mime="text/plain", uri_prefix="doc://1", fetched_from="2026-01-01T12:00:00Z", fetched_to="2026-02-01T00:00:00Z", stores=["en"])
    scored = retrieval.bm25_scores(corpus.chunks(spark, sf_dir), QUERY)
    return _rounded(retrieval.leg(scored, filters=wanted), "score").withColumn("rank", F.col("rank").cast("long"))


@query("F7_store_scope", f"WITH {RES} SELECT store_id, count(*) AS n FROM ch WHERE store_id IN ('de', 'fr') GROUP BY store_id")
def f7(spark, sf_dir):
    rows = corpus.resources(spark, sf_dir)
    known = rows.select("store_id", F.concat(F.lit("store-"), F.col("store_id")).alias("name")).distinct()
    return rows.filter(F.col("store_id").isin(retrieval.resolve_stores(known, ["store-fr", "de", "fr"]))).groupBy("store_id").agg(F.count("*").alias("n"))


@query("R16_matched_fraction", "SELECT doc_id, round((contains(t, 'the')::INT + contains(t, 'zu')::INT + contains(t, 'que')::INT)::DOUBLE / 3, 6) AS score FROM (SELECT doc_id, lower(strip_accents(text)) AS t FROM documents)")
def r16(spark, sf_dir):
    return _rounded(corpus.table(spark, sf_dir, "documents").select("doc_id", retrieval.matched_fraction(F.col("text"), F.lit("the zu Qué")).alias("score")), "score")


def flagship(spark: SparkSession, sf_dir: str, embedded: bool = False) -> DataFrame:
    """Search over all documents: both legs, fused, cited. Vectors are joined by id; embedded leaves out documents without one."""
    vec = corpus.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    chunks = corpus.chunks(spark, sf_dir).join(vec, "doc_id", "inner" if embedded else "left")
    return retrieval.search(chunks, QUERY, _query_vector(spark, sf_dir))


def _fused_rows(found: DataFrame) -> DataFrame:
    return _rounded(found.select(F.col("position").cast("long").alias("position"), "store_id", "chunk_id", F.col("scores.fused").alias("fused"), "total"), "fused")


@query("search_fused_all", f"""WITH {bm25_sql(['the', 'and', 'of'])}, {leg_sql('bm', 'w')}, {VEC}, j AS (SELECT ch.store_id, ch.chunk_id, vec.v FROM ch JOIN vec ON lpad(ch.doc_id::VARCHAR, 8, '0') = vec.chunk_id),
 cj AS (SELECT store_id, chunk_id, 1 - (1 - list_dot_product(v, w) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(w, w)))) / 2 AS score FROM j, q), {leg_sql('cj', 'a')}, {rrf_sql('a', 'w')}, p AS (SELECT *, row_number() OVER (ORDER BY fused DESC, store_id, chunk_id) AS position, count(*) OVER () AS total FROM fused)
SELECT position, store_id, chunk_id, round(fused, 6) AS fused, total FROM p WHERE position <= 10""")
def search_fused_all(spark, sf_dir):
    return _fused_rows(flagship(spark, sf_dir))


# --- reading ---------------------------------------------------------------------------------------------------------


@query("A1_store_stats", f"WITH {RES} SELECT store_id, count(*) AS chunk_count, count(DISTINCT resource_id) AS document_count FROM ch GROUP BY store_id")
def a1(spark, sf_dir):
    return reading.store_stats(corpus.chunks(spark, sf_dir))


@query("A2_documents_by_source", f"WITH {RES} SELECT store_id, source_id, count(*) AS n FROM ch GROUP BY store_id, source_id")
def a2(spark, sf_dir):
    return corpus.resources(spark, sf_dir).groupBy("store_id", "source_id").agg(F.count("*").alias("n"))


@query("A3_largest_tables", f"WITH {RES} SELECT source_id AS \"table\", sum(strlen(text))::BIGINT AS bytes FROM ch GROUP BY source_id ORDER BY bytes DESC, source_id LIMIT 5")
def a3(spark, sf_dir):
    return reading.table_sizes(corpus.resources(spark, sf_dir).select(F.col("source_id").alias("table"), F.octet_length("text").cast("long").alias("bytes")))


@query("A4_human_size", "SELECT doc_id, CASE WHEN strlen(text) * 100 >= 1048576 THEN printf('%.1f MB', strlen(text) * 100 / 1048576.0::DOUBLE) WHEN strlen(text) * 100 >= 1024 THEN printf('%.1f KB', strlen(text) * 100 / 1024.0::DOUBLE) ELSE printf('%d B', strlen(text) * 100) END AS size FROM documents")
def a4(spark, sf_dir):
    return corpus.table(spark, sf_dir, "documents").select("doc_id", text.human_size(F.octet_length("text") * 100).alias("size"))


@query("O2_list_documents", f"WITH {RES}, p AS (SELECT store_id, uri, row_number() OVER (PARTITION BY store_id ORDER BY uri, resource_id) AS position, count(*) OVER (PARTITION BY store_id) AS total FROM ch) SELECT * FROM p WHERE store_id = 'en' AND position > 10 AND position <= 60")
def o2(spark, sf_dir):
    return reading.list_documents(corpus.resources(spark, sf_dir), "en", offset=10).select("store_id", "uri", F.col("position").cast("long").alias("position"), "total")


@query("O4_first_per_uri", f"WITH {RES}, u AS (SELECT store_id, source_id AS uri, fetched_at, resource_id, row_number() OVER (PARTITION BY store_id, source_id ORDER BY fetched_at, resource_id) AS r FROM ch) SELECT store_id, uri, fetched_at, resource_id FROM u WHERE r = 1")
def o4(spark, sf_dir):
    return reading.first_per_uri(corpus.resources(spark, sf_dir).withColumn("uri", F.col("source_id"))).select("store_id", "uri", "fetched_at", "resource_id")


_TURNS = "t AS (SELECT 'c' AS store_id, conv_id AS resource_id, conv_id || '-' || turn AS chunk_id, turn::INT AS block_seq, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations)"


def _turn_chunks(spark, sf_dir):
    return corpus.turns(spark, sf_dir).select(F.lit("c").alias("store_id"), "resource_id", F.concat_ws("-", F.col("resource_id").cast("string"), F.col("seq").cast("string")).alias("chunk_id"), F.col("seq").alias("block_seq"), F.lit(0).alias("seq_in_block"))


@query("W4_centred_page", f"""WITH {_TURNS}, a AS (SELECT *, min(CASE WHEN block_seq >= 2 THEN pos END) OVER (PARTITION BY resource_id) AS anchor FROM t), s AS (SELECT *, greatest(0, least(anchor - 1, total - 3)) AS start FROM a)
SELECT resource_id, chunk_id, pos::INT AS pos, (anchor - start)::INT AS anchor_index FROM s WHERE anchor IS NOT NULL AND pos >= start AND pos < start + 3""")
def w4(spark, sf_dir):
    return reading.centred(reading.numbered(_turn_chunks(spark, sf_dir)), F.col("block_seq") >= 2, 3).select("resource_id", "chunk_id", "pos", "anchor_index")


@query("W5_anchor_by_block", f"WITH {_TURNS} SELECT resource_id, min(pos)::INT AS pos FROM t WHERE block_seq >= 3 GROUP BY resource_id")
def w5(spark, sf_dir):
    return reading.numbered(_turn_chunks(spark, sf_dir)).filter("block_seq >= 3").groupBy("resource_id").agg(F.min("pos").alias("pos"))


@query("get_chunks_page", f"WITH {_TURNS} SELECT chunk_id, pos::INT AS pos, total FROM t WHERE resource_id = 1 AND pos >= 1 AND pos < 4")
def get_chunks(spark, sf_dir):
    return reading.get_chunks(_turn_chunks(spark, sf_dir), 1, offset=1, limit=3).select("chunk_id", "pos", "total")


# --- scalar functions ------------------------------------------------------------------------------------------------


@query("fn_collapse_blanks", "SELECT doc_id, CASE WHEN length(t) > 80 THEN left(t, 80) || '…' ELSE t END AS flat FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)")
def fn_collapse(spark, sf_dir):
    return corpus.table(spark, sf_dir, "documents").select("doc_id", text.collapse_blanks(F.col("text"), 80).alias("flat"))


@query("fn_display_uri_whole", "SELECT doc_id, 'https://e.example/' || regexp_replace(text, '\\pC', chr(65533), 'g') || '+x' AS shown FROM documents")
def fn_display_whole(spark, sf_dir):
    """fn_display_uri, as its SQL, takes 30 characters of each text."""
    raw = F.concat(F.lit("https://e.example/"), F.replace(F.url_encode("text"), F.lit("+"), F.lit("%20")), F.lit("+x"))
    return corpus.table(spark, sf_dir, "documents").select("doc_id", text.display_uri(raw).alias("shown"))


@query("fn_rfc3339", "SELECT event_id, strftime(make_timestamp((1700000000 + event_id * 977) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def fn_rfc(spark, sf_dir):
    return corpus.table(spark, sf_dir, "events").select("event_id", text.rfc3339(F.lit(1700000000) + F.col("event_id") * 977).alias("at"))


@query("fn_durations", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN event_id * 3600 WHEN 1 THEN event_id * 60 WHEN 2 THEN event_id WHEN 3 THEN event_id * 86400 WHEN 4 THEN event_id ELSE -1 END AS seconds FROM events WHERE event_id > 0")
def fn_durations(spark, sf_dir):
    n, k = F.col("event_id").cast("string"), F.col("event_id") % 6
    value = F.when(k == 5, F.concat(n, F.lit(" weeks"))).otherwise(F.concat(n, F.element_at(F.array(*map(F.lit, ["h", "m", "s", "d", "", "?"])), (k + 1).cast("int"))))
    return corpus.table(spark, sf_dir, "events").filter("event_id > 0").select("event_id", F.coalesce(text.duration_seconds(value), F.lit(-1).cast("long")).alias("seconds"))


@query("fn_store_names", "SELECT event_id, n NOT IN ('', '.', '..', 'a/b', 'a\\b') AS valid FROM (SELECT event_id, ['', '.', '..', 'a/b', 'a\\b', 'notes', 'My Store', '...'][(event_id % 8 + 1)::INT] AS n FROM events)")
def fn_names(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, ["", ".", "..", "a/b", "a\\b", "notes", "My Store", "..."])), (F.col("event_id") % 8 + 1).cast("int"))
    return corpus.table(spark, sf_dir, "events").select("event_id", text.valid_store_name(name).alias("valid"))


@query("fn_reference_kind", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'url' WHEN 1 THEN 'id' ELSE 'path' END AS kind FROM pages")
def fn_reference(spark, sf_dir):
    k = F.col("page_id") % 3
    value = F.when(k == 0, F.col("url")).when(k == 1, F.upper(F.substring(F.md5("url"), 1, 26))).otherwise(F.concat(F.lit("notes/"), F.md5("url")))
    return corpus.table(spark, sf_dir, "pages").select("page_id", text.reference_kind(value).alias("kind"))


@query("fn_tolerant_json", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN -1 ELSE event_id END AS id FROM events")
def fn_json(spark, sf_dir):
    raw = F.when(F.col("event_id") % 4 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(F.col("event_id").alias("id"))))
    return corpus.table(spark, sf_dir, "events").select("event_id", F.coalesce(registry.tolerant_json(raw, "id long")["id"], F.lit(-1).cast("long")).alias("id"))


@query("fn_meta_keys", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'x.' || event_type ELSE '' END AS unknown FROM events")
def fn_meta(spark, sf_dir):
    other = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("x."), F.col("event_type"))).otherwise("msg.sender")
    return corpus.table(spark, sf_dir, "events").select("event_id", F.array_join(registry.unknown_meta_keys(F.create_map(F.lit("dc.title"), F.lit("t"), other, F.lit("v"))), ",").alias("unknown"))


@query("fn_snippet")
def fn_snippet(spark, sf_dir):
    """A pandas function: paragraph and sentence ends are searched for from the back."""
    import pandas as pd

    def cut(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text.truncate_snippet(x, 200) for x in column], columns=["prefix", "truncated"])

    cut.__annotations__ = {"column": pd.Series, "return": pd.DataFrame}
    snippet = F.pandas_udf(cut, "prefix string, truncated boolean")
    return corpus.table(spark, sf_dir, "documents").select("doc_id", snippet("text").alias("s")).select("doc_id", "s.prefix", "s.truncated")


# --- maintenance -----------------------------------------------------------------------------------------------------

# Two snapshots: what the store has are documents not divisible by 4; what is observed are those not divisible by 5, every seventh changed.
_OLD = "old AS (SELECT uri, resource_id, content_hash, policy_version FROM ch WHERE doc_id % 4 <> 0)"
_SEEN = "seen AS (SELECT uri, CASE WHEN doc_id % 7 = 0 THEN sha256(content_hash) ELSE content_hash END AS hash, CASE WHEN doc_id % 11 = 0 THEN 'empty' WHEN doc_id % 13 = 0 THEN 'unsupported' WHEN doc_id % 17 = 0 THEN 'error' ELSE 'ok' END AS status FROM ch WHERE doc_id % 5 <> 0)"
_PLAN = f"""WITH {RES}, {_OLD}, {_SEEN}, plan AS (
  SELECT s.uri, CASE WHEN s.status <> 'ok' THEN s.status WHEN o.uri IS NULL THEN 'insert' WHEN s.hash = o.content_hash AND o.policy_version = '{corpus.POLICY}' THEN 'skip' ELSE 'replace' END AS action, o.resource_id AS old_id FROM seen s LEFT JOIN old o ON s.uri = o.uri
  UNION ALL SELECT o.uri, 'delete', o.resource_id FROM old o WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.uri = o.uri))"""


def _snapshots(spark, sf_dir):
    rows = corpus.resources(spark, sf_dir)
    old = rows.filter("doc_id % 4 <> 0").select("uri", "resource_id", "content_hash", "policy_version")
    d = F.col("doc_id")
    status = F.when(d % 11 == 0, "empty").when(d % 13 == 0, "unsupported").when(d % 17 == 0, "error").otherwise("ok")
    seen = rows.filter("doc_id % 5 <> 0").select("uri", F.when(d % 7 == 0, F.sha2("content_hash", 256)).otherwise(F.col("content_hash")).alias("content_hash"), status.alias("status"))
    return old, seen


@query("I1_plan_changes", _PLAN + " SELECT uri, action, old_id FROM plan")
def i1(spark, sf_dir):
    return maintenance.plan_changes(*_snapshots(spark, sf_dir), None, corpus.POLICY, prune=True)


@query("I4_confirmed_gone", _PLAN + f""", gone AS (SELECT uri FROM ch WHERE doc_id % 20 = 5) SELECT uri, 'prunable' AS action, resource_id AS old_id FROM old WHERE uri IN (SELECT uri FROM gone)""")
def i4(spark, sf_dir):
    old, seen = _snapshots(spark, sf_dir)
    gone = corpus.resources(spark, sf_dir).filter("doc_id % 20 = 5").select("uri")
    return maintenance.plan_changes(old, seen, gone, corpus.POLICY, complete=False).filter("action = 'prunable'")


@query("I5_incomplete_listing", _PLAN + " SELECT action, count(*) AS n FROM plan WHERE action <> 'delete' GROUP BY action")
def i5(spark, sf_dir):
    return maintenance.plan_changes(*_snapshots(spark, sf_dir), None, corpus.POLICY, prune=True, complete=False).groupBy("action").agg(F.count("*").alias("n"))


@query("I6_counters", _PLAN + " SELECT count_if(action IN ('insert', 'replace'))::BIGINT AS indexed, count_if(action IN ('skip', 'empty'))::BIGINT AS skipped, count_if(action = 'unsupported')::BIGINT AS unsupported, count_if(action = 'error')::BIGINT AS errors, count_if(action = 'delete')::BIGINT AS deleted, count_if(action = 'prunable')::BIGINT AS docs_prunable FROM plan")
def i6(spark, sf_dir):
    return maintenance.counters(i1(spark, sf_dir))


@query("I7_cascade", f"WITH {RES} SELECT store_id, resource_id FROM ch WHERE store_id <> 'de' AND source_id <> 'src3'")
def i7(spark, sf_dir):
    rows = corpus.chunks(spark, sf_dir)
    sources = rows.select("store_id", "source_id").distinct()
    tables = {"stores": rows.select("store_id").distinct(), "sources": sources, "resources": rows.select("store_id", "source_id", "resource_id"), "blocks": rows.select("store_id", "resource_id", F.lit(0).alias("seq")), "chunks": rows.select("store_id", "resource_id", "chunk_id")}
    return maintenance.cascade(tables, stores=spark.createDataFrame([("de",)], "store_id string"), sources=sources.filter("source_id = 'src3'").select("source_id").distinct())["chunks"].select("store_id", "resource_id")


@query("I8_staleness", f"WITH {RES} SELECT store_id, bool_or(policy_version <> '{corpus.POLICY}') AS stale FROM ch GROUP BY store_id")
def i8(spark, sf_dir):
    return maintenance.stale_stores(corpus.resources(spark, sf_dir), corpus.POLICY)


@query("I10_refresh_due", "SELECT event_id FROM events WHERE event_id % 3 <> 0 AND (event_id % 5 = 0 OR 100000 - event_id >= event_id * 2)")
def i10(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("event_id") * 2).alias("refresh"), F.when(F.col("event_id") % 5 != 0, F.col("event_id")).alias("refreshed_at"))
    return registry.due(rows, 100000).select("event_id")


@query("K1_atomic_replace", _PLAN + f""", kept AS (SELECT o.uri, o.resource_id, o.content_hash FROM old o WHERE NOT EXISTS (SELECT 1 FROM plan p WHERE p.old_id = o.resource_id AND p.action IN ('replace', 'delete')))
SELECT uri, resource_id, content_hash FROM kept UNION ALL SELECT s.uri, sha256(s.uri || '|' || s.hash), s.hash FROM seen s JOIN plan p ON s.uri = p.uri AND p.action IN ('insert', 'replace')""")
def k1(spark, sf_dir):
    old, seen = _snapshots(spark, sf_dir)
    plan = maintenance.plan_changes(old, seen, None, corpus.POLICY, prune=True)
    new = seen.join(plan.filter("action IN ('insert', 'replace')").select("uri"), "uri").select("uri", ids.resource_id(F.col("uri"), F.col("content_hash")).alias("resource_id"), "content_hash")
    return maintenance.replace_resources(old.select("uri", "resource_id", "content_hash"), plan, new)


@query("K2_upsert", f"""WITH {RES} SELECT store_id, resource_id, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 <> 0 THEN 'new' ELSE CASE WHEN doc_id % 2 = 0 THEN 'new' ELSE 'old' END END AS modified_at, CASE WHEN doc_id % 3 <> 0 THEN 'old' ELSE 'new' END AS added_at FROM ch WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0""")
def k2(spark, sf_dir):
    rows = corpus.resources(spark, sf_dir)
    shaped = lambda r, v: r.select("store_id", "resource_id", F.lit(v).alias("modified_at"), F.lit(v).alias("added_at"))
    return maintenance.upsert_resources(shaped(rows.filter("doc_id % 3 <> 0"), "old"), shaped(rows.filter("doc_id % 2 = 0"), "new"))


@query("K3_upsert_blocks", "SELECT conv_id AS resource_id, turn::INT AS seq, CASE WHEN turn % 2 = 0 THEN text || '!' ELSE text END AS text FROM conversations")
def k3(spark, sf_dir):
    rows = corpus.turns(spark, sf_dir).select("resource_id", "seq", "text")
    return maintenance.upsert(rows, rows.filter("seq % 2 = 0").withColumn("text", F.concat("text", F.lit("!"))), ["resource_id", "seq"])


@query("M7_delete_by_resource", f"WITH {RES} SELECT store_id, count(*) AS removed FROM ch WHERE doc_id % 9 = 0 GROUP BY store_id")
def m7(spark, sf_dir):
    rows = corpus.chunks(spark, sf_dir)
    left = rows.join(rows.filter("doc_id % 9 = 0").select("store_id", "resource_id"), ["store_id", "resource_id"], "left_anti")
    count = lambda r, n: r.groupBy("store_id").agg(F.count("*").alias(n))
    both = count(rows, "a").join(count(left, "b"), "store_id", "left")
    return both.select("store_id", (F.col("a") - F.coalesce("b", F.lit(0))).alias("removed")).filter("removed > 0")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
