"""Queries of the training-data operators, one per operator, over their whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import collocations, conversations, decontaminate, licenses, line_dedup, near_dedup, ngram_join, packing, secrets, token_files, top_k, toxicity, warc
from cohortlens.llm.common import table
from cohortlens.llm.license_texts import NOTICES
from cohortlens.session import scratch_path

QUERIES = {}
ORACLE = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and digest of the base rules, all spans."""
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [r.kind for r in secrets.BASE_RULES]
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    joined = lambda a: F.array_join(F.transform(a, line), ",")
    own = F.filter("spans", lambda s: s["kind"].isin(base))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in base], F.sha2(joined(own), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))


@query
def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near duplicates of every document: one row per document."""
    return near_dedup.classes(table(spark, sf_dir, "documents"))


@query
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written to Arrow files and read back from them."""
    manifest = token_files.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                 scratch_path(spark, "token-files"))
    return token_files.read(spark, manifest)


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a test item, with the item: one row per pair."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.matches(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("hits").alias("hit")).select(
        "doc_id", "hit.item_id", F.round("hit.score", 6).alias("score"), F.round("hit.question", 6).alias("question"),
        F.round("hit.answer", 6).alias("answer"))


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def page_records(pages: DataFrame) -> DataFrame:
    """A crawl log made of ``pages``: each page is captured in full at time page_id, and asked for
    again 500 units later (every 11th: already one unit before) with the validator of that
    capture (every 7th: with an old one). So a revisit meets a changed page where another capture
    of the canonical URL came in between."""
    entry = lambda k, v: (F.lit(k), v.cast("string"))
    at = F.col("page_id") + F.when(F.col("page_id") % 11 == 0, -1).otherwise(500)
    old = F.when(F.col("page_id") % 7 == 0, F.md5("url")).otherwise(F.col("digest"))
    seen = pages.select("page_id", "url", F.md5("html").alias("digest"), F.octet_length("html").alias("size"))
    full = F.struct((F.col("page_id") * 2).alias("record_id"), F.col("page_id").alias("ts"), F.lit("response").alias("kind"),
                    F.col("digest").alias("etag"), F.create_map(
                        *entry("content-length", F.col("size")), *entry("content-type", F.lit("text/html")),
                        *entry("cache-control", F.lit("max-age=60")), *entry("x-capture", F.col("page_id"))).alias("headers"))
    again = F.struct((F.col("page_id") * 2 + 1).alias("record_id"), at.alias("ts"), F.lit("revisit").alias("kind"),
                     old.alias("etag"), F.create_map(
                         *entry("content-length", F.lit(0)), *entry("cache-control", F.lit("max-age=120")),
                         *entry("date", at)).alias("headers"))
    return seen.select("url", F.explode(F.array(full, again)).alias("r")).select(
        "r.*", "url", F.lit(None).cast("long").alias("last_modified"))


@query
def op6_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The response that each not-modified revisit of the crawl log stands for, and its headers."""
    found = warc.resolve(page_records(table(spark, sf_dir, "pages")))
    headers = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")
    return found.withColumn("headers", headers)


# The SQL's own key, looser than warc.canonical_url (it lowers paths, and cuts "ref=" out of "pref="):
# equal to it where URLs have no capitals and no such names, as in the test tables.
_SQL_KEY = (("#.*$", ""), (r"^https?://(www\.)?", ""), (r"(utm_[a-z]+|ref|sessionid)=[^&]*&?", ""), (r"[?&]+$", ""), (r"/+$", ""))
_URL = "lower(url)"
for _pattern, _new in _SQL_KEY:
    _URL = f"regexp_replace({_URL}, '{_pattern}', '{_new}', 'g')"
ORACLE["op6_revisits"] = f"""
WITH pg AS (SELECT page_id, {_URL} AS url_key, md5(html) AS digest, md5(url) AS u, strlen(html) AS size FROM pages),
full_ AS (SELECT page_id * 2 AS rid, url_key, page_id AS ts, digest, size FROM pg),
again AS (SELECT page_id * 2 + 1 AS record_id, url_key, page_id + CASE WHEN page_id % 11 = 0 THEN -1 ELSE 500 END AS ts,
                 CASE WHEN page_id % 7 = 0 THEN u ELSE digest END AS etag FROM pg),
found AS (SELECT a.*, f.rid, f.ts AS fts, f.digest, f.size, row_number() OVER (PARTITION BY a.record_id ORDER BY f.ts DESC, f.rid DESC) AS n
          FROM again a LEFT JOIN full_ f ON a.url_key = f.url_key AND (f.ts < a.ts OR f.ts = a.ts AND f.rid < a.record_id))
SELECT record_id, url_key, ts,
       CASE WHEN rid IS NULL THEN 'no_earlier_response' WHEN etag = digest THEN 'resolved' ELSE 'validator_mismatch' END AS status,
       rid AS response_id, fts AS response_ts,
       CASE WHEN rid IS NOT NULL AND etag = digest
            THEN 'cache-control=max-age=120;content-length=' || size || ';content-type=text/html;date=' || ts || ';x-capture=' || fts
            ELSE 'cache-control=max-age=120;content-length=0;date=' || ts END AS headers
FROM found WHERE n = 1"""


@query
def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every document: one row per document and notice."""
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), NOTICES)
    return found.select("doc_id", F.explode("licenses").alias("l")).select(
        "doc_id", F.col("l.name").alias("license"), F.round("l.containment", 6).alias("containment"))


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines after deduplication: counts, size and digest of its new text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedupe(docs, counts="n").select(
        "doc_id", "n.lines", "n.exact", "n.near", "n.links", F.char_length("text").alias("n_chars"),
        F.sha2("text", 256).alias("text_sha256"))


@query
def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors with the largest inner products, for every 20th vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return top_k.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)


ORACLE["op10_top_k"] = """
WITH e AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id AND q.vec_id % 20 = 0 AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of two or three words of every language."""
    return collocations.mine(table(spark, sf_dir, "documents").select("text", "lang"))


ORACLE["op11_collocations"] = r"""
WITH pieces AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM (
       SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
          FROM w, (SELECT unnest([1, 2, 3]) AS k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 10),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
cuts AS (SELECT lang, phrase, f AS a, k, unnest(range(1, k)) AS cut, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
scored AS (SELECT c.lang, c.phrase, c.a, c.k, c.cut, x.f AS l, y.f AS r, (1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS score
           FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.cut], ' ')
           JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1:], ' ')),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nth FROM scored) WHERE nth = 1),
inner_ AS (SELECT lang, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS phrase, f
           FROM f WHERE k = 3),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM inner_ i WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.f >= 50 * b.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000"""


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation and its cheapest repair."""
    return conversations.repair(conversations.faulty(table(spark, sf_dir, "conversations"))).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")



def _crc32(text: str) -> str:
    """CRC-32 of an ASCII string: for each byte one exclusive or, then eight shifts."""
    ops = f"flatten(list_transform(string_split({text}, ''), lambda x: [ord(x), -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"xor(list_reduce(list_transform({ops}, lambda x: x::BIGINT), lambda c, x: {step}, 4294967295::BIGINT), 4294967295::BIGINT)"


# least (cost c, audit a, text t) by state: s0 no row yet, ss system, su user, sa assistant
def _edit(p: str, e: str, cost: str, line: str = "''") -> str:
    return f"struct_pack(c := {p}.c + {cost}, a := {p}.a || '{e}', t := {p}.t || {line})"


def _insert(p: str, role: str) -> str:
    return _edit(p, "I", "2", f"chr(10) || '{role}:'")


def _keep(p: str, initial: str) -> str:
    return _edit(p, "K", f"CASE WHEN stays AND left(role, 1) = '{initial}' THEN late ELSE 1000000000 END", "chr(10) || role || ':' || text")


def _change(p: str, role: str) -> str:
    return _edit(p, "R", "CASE WHEN stays THEN 2 + late ELSE 1000000000 END", f"chr(10) || '{role}:' || text")


def _least(*options: str) -> str:
    return f"list_min([{', '.join(options)}])"


_DROP = {p: _edit(p, "D", "3") for p in ("s0", "ss", "su", "sa")}
_STATE = "struct_pack(c := {}::BIGINT, a := '{}', t := '{}')"
ORACLE["op12_conversation_repair"] = f"""
WITH RECURSIVE coded AS (
  SELECT conv_id, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS cid, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc32("concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' '))")} % 20 AS code FROM conversations),
there AS (
  SELECT cid, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
         CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN code = 3 THEN [0, 1] ELSE [0] END) AS copy FROM coded WHERE code <> 0),
placed AS (
  SELECT *, row_number() OVER o AS i, rtrim(text, concat(chr(32), chr(9), chr(10), chr(11), chr(12), chr(13))) AS bare,
         lag(left(role, 1)) OVER o || left(role, 1) AS met, row_number() OVER (PARTITION BY cid, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again
  FROM there WINDOW o AS (PARTITION BY cid ORDER BY turn NULLS FIRST, role, text, copy)),
r AS (
  SELECT *, bare <> '' AND NOT again AS stays, (bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?'))::INT AS late FROM placed),
st AS (
  SELECT DISTINCT cid, 1::BIGINT AS i, {_STATE.format(0, '', '')} AS s0, {_STATE.format(1000000000, '', '')} AS ss,
         struct_pack(c := 2::BIGINT, a := 'I', t := chr(10) || 'user:') AS su,
         struct_pack(c := 4::BIGINT, a := 'II', t := chr(10) || 'user:' || chr(10) || 'assistant:') AS sa FROM coded
  UNION ALL
  SELECT cid, i + 1, s0, ss, su, {_least("sa", _insert("su", "assistant"))} AS sa FROM (
    SELECT cid, i, s0, ss, sa, {_least("su", *[_insert(p, "user") for p in ("s0", "ss", "sa")])} AS su FROM (
      SELECT st.cid, st.i, {_DROP["s0"]} AS s0, {_least(_DROP["ss"], _keep("s0", "s"))} AS ss,
             {_least(_DROP["su"], *[f(p, x) for p in ("s0", "ss", "sa") for f, x in ((_keep, "u"), (_change, "user"))])} AS su,
             {_least(_DROP["sa"], _keep("su", "a"), _change("su", "assistant"))} AS sa
      FROM st JOIN r ON r.cid = st.cid AND r.i = st.i))),
best AS (SELECT cid, max_by({_least("s0", "sa")}, i) AS x FROM st GROUP BY cid),
counts AS (
  SELECT cid, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (bare = '') AS blank,
         count(*) FILTER (bare <> '' AND again) AS duplicate, sum(late) AS truncated, count(*) FILTER (met NOT IN ('su', 'ua', 'au')) AS illegal
  FROM r GROUP BY cid)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, x.c::BIGINT AS cost, x.a AS audit,
       sha256(substr(x.t, 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, cid FROM coded) JOIN best USING (cid) LEFT JOIN counts USING (cid)"""


@query
def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of distinct four-word shingles, and its component of links at 85 %."""
    return ngram_join.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE["op13_ngram_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                            ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce((SELECT min(b) FROM reach WHERE a = w.doc_id), w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id)"""
