"""The corpus operators' queries, one for each, over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actiloom.llm import bytepiece, decontam, jaccard, language, lexical, licenses, merkle, packing, quality, sharding, tokenfile, topk, urls
from actiloom.llm.encoder import DROPPED, LEADING
from actiloom.llm.frames import table

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def tokenizer_path(name: str) -> str:
    """Where the installed public tokenizer file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), width=4, percent=85)


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op1_jaccard_join"] = rf"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), s AS (
  SELECT rid, doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w
), e AS (
  SELECT rid, len(s) AS n, unnest(s) AS shingle FROM s
), l AS (
  SELECT a.rid AS a, b.rid AS b FROM e AS a JOIN e AS b ON a.shingle = b.shingle AND a.rid <> b.rid
  GROUP BY a.rid, b.rid, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), r AS (
  SELECT rid, rid AS node FROM s UNION SELECT r.rid, l.b FROM r JOIN l ON l.a = r.node
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(t.doc_id) AS component_id
FROM s JOIN r ON r.rid = s.rid JOIN s AS t ON t.rid = r.node GROUP BY s.rid, s.doc_id, s.s
"""


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontam.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, span: total + span["last"] - span["first"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda item: item.cast("string"))), ",")
    return hits.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


ORACLES["op10_decontamination"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+'), []) AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM benchmark
), t AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, unnest(list_transform(range(1, greatest(len(w) - 10, 0) + 2),
    lambda k: array_to_string(w[k:k + least(len(w), 10) - 1], ' '))) AS string FROM i WHERE len(w) > 0
), z AS (
  SELECT DISTINCT size FROM t
), p AS (
  SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS start FROM d, z WHERE len(w) >= size
), h AS (
  SELECT rid, start, p.size AS size, item_id FROM p JOIN t ON t.size = p.size AND t.string = array_to_string(w[start:start + p.size - 1], ' ')
), n AS (
  SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT rid, unnest(range(start, start + size)) AS place FROM h) GROUP BY rid
), m AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM h) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN m USING (rid)
"""


@query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), DROPPED, size=2048, end=0)


@query
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_index(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), LEADING, end=2)


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, docs.filter(~language.held_out()))
    return found.select("doc_id", F.coalesce(language.held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, docs.filter(~quality.held_out()), table(spark, sf_dir, "labels"))
    predicted = F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    return scored.select("doc_id", F.coalesce(quality.held_out(), F.lit(False)).alias("held_out"), "score", predicted)


#: The shards' byte limit of the query; a production limit would be some hundred MB.
SHARD_BYTES = 1 << 20


@query
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"), SHARD_BYTES)


ORACLES["op8_sharding"] = f"""
WITH r AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents
), d AS (
  SELECT doc_id, n_bytes, h, depth, h >> (60 - depth) AS bucket FROM r, generate_series(0, 40) AS g(depth)
), s AS (
  SELECT doc_id, n_bytes, h, depth, sum(n_bytes) OVER w AS shard_bytes, count(*) OVER w AS shard_rows
  FROM d WINDOW w AS (PARTITION BY depth, bucket)
), f AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS k
  FROM s WHERE greatest(shard_bytes, shard_rows) <= {SHARD_BYTES} OR shard_rows = 1
)
SELECT doc_id, n_bytes, left(lpad(bin(h), 60, '0'), depth::INT) AS shard, depth::INT AS depth,
       shard_bytes::BIGINT AS shard_bytes, shard_rows
FROM f WHERE k = 1
"""

URL_RULES = ["allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/"]


@query
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), [urls.parse_rule(line) for line in URL_RULES])


ORACLES["op2_url_filter"] = r"""
WITH p AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), q AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM p
), r(verdict, rhost, rpath) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), m AS (
  SELECT q.page_id, host, path, rhost || rpath AS rule, verdict,
         row_number() OVER (PARTITION BY q.page_id ORDER BY length(rhost || rpath) DESC NULLS LAST) AS k
  FROM q LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""


@query
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query
def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


ORACLES["op7_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 5
"""


@query
def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = tokenizer_path("byte_bpe_multi_50k.tiktoken")
    ids = bytepiece.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    both = bytepiece.decode(ids, path, public_tokenizers.PATTERN)
    n_tokens = F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens")
    return both.select("doc_id", n_tokens, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    altered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    n_chars = F.col("n_chars").cast("long")
    made = merkle.manifest(docs, later={"n_chars": F.when(altered, F.try_add(n_chars, F.lit(1))).otherwise(n_chars)})
    verified = F.col("folded_root") == F.col("root")
    proof = F.sha2("others", 256).alias("proof_sha256")
    return merkle.proofs(made).select("doc_id", "leaf", "subroot", "root", proof, "folded_root", verified.alias("verified"))


ORACLES["op11_merkle_manifest"] = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, n_chars, text,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda h, b: list_reduce(list_prepend(xor(h, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))) AS crc
  FROM documents
), p AS (
  SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail,
    CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS later_chars
  FROM d
), l AS (
  SELECT rid, doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    sha256(head || coalesce(strlen(later_chars::VARCHAR) || ':' || later_chars, '-') || tail) AS later
  FROM p
), r AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n,
    coalesce('=' || lang, '') AS tree
  FROM l
), t AS (
  SELECT tree, 0 AS level, idx, leaf AS h, n FROM r
  UNION ALL
  SELECT tree, level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (max(n) + 1) // 2 FROM t WHERE n > 1 GROUP BY tree, level, idx // 2
), s AS (
  SELECT tree, h AS subroot, level AS levels, row_number() OVER (ORDER BY encode(tree)) - 1 AS idx, count(*) OVER () AS n FROM t WHERE n = 1
), u AS (
  SELECT 0 AS level, idx, subroot AS h, n FROM s
  UNION ALL
  SELECT level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (max(n) + 1) // 2 FROM u WHERE n > 1 GROUP BY level, idx // 2
), steps AS (
  SELECT r.rid, t.level AS step, t.idx < r.idx >> t.level AS before, o.h AS other
  FROM r JOIN t ON t.tree = r.tree AND t.idx = r.idx >> t.level AND t.n > 1
  LEFT JOIN t AS o ON o.tree = t.tree AND o.level = t.level AND o.idx = xor(t.idx, 1)
  UNION ALL
  SELECT r.rid, s.levels + u.level, false, o.h
  FROM r JOIN s ON s.tree = r.tree JOIN u ON u.idx = s.idx >> u.level AND u.n > 1
  LEFT JOIN u AS o ON o.level = u.level AND o.idx = xor(u.idx, 1)
), w AS (
  SELECT steps.rid, step, other, CASE WHEN step < s.levels THEN (r.idx >> step) % 2 = 1 ELSE (s.idx >> (step - s.levels)) % 2 = 1 END AS before
  FROM steps JOIN r ON r.rid = steps.rid JOIN s ON s.tree = r.tree
), f AS (
  SELECT rid, 0 AS step, later AS h FROM r
  UNION ALL
  SELECT f.rid, f.step + 1, sha256(CASE WHEN w.other IS NULL THEN f.h WHEN before THEN w.other || f.h ELSE f.h || w.other END)
  FROM f JOIN w ON w.rid = f.rid AND w.step = f.step
), proof AS (
  SELECT r.rid, sha256(coalesce(string_agg(other, '' ORDER BY step), '')) AS proof_sha256 FROM r LEFT JOIN w ON w.rid = r.rid GROUP BY r.rid
), folded AS (
  SELECT rid, arg_max(h, step) AS folded_root FROM f GROUP BY rid
)
SELECT doc_id, leaf, subroot, root.h AS root, proof_sha256, folded_root, folded_root = root.h AS verified
FROM r JOIN s ON s.tree = r.tree JOIN proof ON proof.rid = r.rid JOIN folded ON folded.rid = r.rid, (SELECT h FROM u WHERE n = 1) AS root
"""


@query
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


ORACLES["op12_lexical_search"] = r"""
WITH r AS (
  SELECT row_number() OVER () AS rid, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), q AS (
  SELECT row_number() OVER () AS nth, item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM benchmark
), w AS (
  SELECT rid, doc_id, unnest(regexp_extract_all(t, '[0-9A-Za-z\x{80}-\x{10FFFF}]+')) AS term FROM r
), d AS (
  SELECT rid, doc_id, term, count(*) AS tf, sum(count(*)) OVER (PARTITION BY rid)::BIGINT AS n FROM w GROUP BY rid, doc_id, term
), s AS (
  SELECT count(DISTINCT rid) AS big_n, count(*) AS big_l FROM w
), f AS (
  SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM d, s GROUP BY term, big_n
), i AS (
  SELECT nth, item_id, unnest(regexp_extract_all(t, '[0-9A-Za-z\x{80}-\x{10FFFF}]+')) AS term FROM q
), c AS (
  SELECT nth, item_id, term, count(*) AS repeats FROM i GROUP BY nth, item_id, term
), a AS (
  SELECT nth, item_id, rid, doc_id, sum(repeats * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l))))::BIGINT AS score
  FROM c JOIN f USING (term) JOIN d USING (term), s GROUP BY nth, item_id, rid, doc_id
), k AS (
  SELECT item_id, row_number() OVER (PARTITION BY nth ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM a WHERE score > 0
)
SELECT * FROM k WHERE rank <= 10
"""
