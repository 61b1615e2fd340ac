"""Every operator as a query over the test tables, with the same in DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from satchel.functions import arrays, binary, paths, text
from satchel.functions import json as js
from satchel.operators import codec, integrity, manifest, tables
from satchel.operators.patterns import Pattern, ancestors, glob_match, mark_unpacked, match_any, matches, pattern_table, read_patterns, select
from satchel.session import shared_dir, ship
from satchel.sources import pipes
from satchel.sources.archive import read_archive, write_archive
from satchel.sources.files import read_files
from satchel.sources.sinks import extract

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def members(spark: SparkSession, d: str, content: bool = False) -> DataFrame:
    """documents as the packed files of one archive; every 11th is unpacked, every 7th executable."""
    docs = read(spark, d, "documents")
    at = F.concat("source", F.lit("/"), "lang", F.lit("/"), F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    data = F.encode("text", "UTF-8")
    out = docs.select(
        F.lit("documents").alias("archive_path"), F.col("doc_id").alias("ordinal"), at.alias("path"), F.substring_index(at, "/", -1).alias("name"),
        F.concat("source", F.lit("/"), "lang").alias("parent_path"), F.lit(2).alias("depth"), F.lit(False).alias("is_dir"), F.octet_length(data).cast("long").alias("size"),
        (F.col("doc_id") % 7 == 0).alias("executable"), (F.col("doc_id") % 11 == 0).alias("unpacked"),
        F.when(F.col("doc_id") % 3 == 0, F.struct(F.lit(1).alias("algorithm"), F.unhex(F.lit("00")).alias("hash"), F.lit(None).cast("long").alias("block_size"), F.lit(None).cast("array<binary>").alias("blocks"))).alias("integrity"),
        F.when(F.col("doc_id") % 5 == 0, F.struct(F.lit(1).alias("algorithm"), (F.octet_length(data) * 2).cast("long").alias("original_size"))).alias("compression"),
        *([data.alias("content")] if content else []),
    )
    return out


M = """m AS (SELECT doc_id AS ordinal, source || '/' || lang || '/doc_' || doc_id || '.txt' AS path, 'doc_' || doc_id || '.txt' AS name,
  source || '/' || lang AS parent_path, CAST(octet_length(encode(text)) AS BIGINT) AS size, doc_id % 7 = 0 AS executable, doc_id % 11 = 0 AS unpacked,
  doc_id % 3 = 0 AS has_hash, doc_id % 5 = 0 AS packed_z, CAST(octet_length(encode(text)) * 2 AS BIGINT) AS original_size, text FROM documents)"""
LONG = """'-' || CASE WHEN has_hash THEN 'i' ELSE '-' END || CASE WHEN executable THEN 'x' ELSE '-' END || CASE WHEN unpacked THEN 'u' WHEN packed_z THEN 'z' ELSE '-' END"""
SIZES = """CASE WHEN packed_z THEN '#' || rpad(CAST(size AS VARCHAR), CAST(greatest(12, length(CAST(size AS VARCHAR))) AS INTEGER), ' ') || ' ' || lpad(CAST(original_size AS VARCHAR), CAST(greatest(12, length(CAST(original_size AS VARCHAR))) AS INTEGER), ' ') || ' '
  ELSE repeat(' ', 14) || lpad(CAST(size AS VARCHAR), CAST(greatest(12, length(CAST(size AS VARCHAR))) AS INTEGER), ' ') || ' ' END"""


def tree(spark: SparkSession, d: str) -> DataFrame:
    """region, nation and customer as folders, folders and files."""
    r, n, c = (read(spark, d, t) for t in ("region", "nation", "customer"))
    rp = r.select(F.col("r_name").alias("path"), F.lit(True).alias("is_dir"), F.lit(None).cast("string").alias("parent_path"), F.col("r_regionkey").alias("k"))
    named = n.join(F.broadcast(rp), n["n_regionkey"] == rp["k"])  # region has five rows by definition
    np_ = named.select(F.concat_ws("/", "path", "n_name").alias("path"), F.lit(True).alias("is_dir"), F.col("path").alias("parent_path"), F.col("n_nationkey").alias("k"))
    cp = c.join(np_.select("path", "k"), c["c_nationkey"] == F.col("k")).select(F.concat_ws("/", "path", "c_name").alias("path"), F.lit(False).alias("is_dir"), F.col("path").alias("parent_path"))
    return rp.drop("k").unionByName(np_.drop("k")).unionByName(cp)


T = """rp AS (SELECT r_name AS path, true AS is_dir, CAST(NULL AS VARCHAR) AS parent_path, r_regionkey AS k FROM region),
np AS (SELECT rp.path || '/' || n_name AS path, true AS is_dir, rp.path AS parent_path, n_nationkey AS k FROM nation JOIN rp ON n_regionkey = rp.k),
cp AS (SELECT np.path || '/' || c_name AS path, false AS is_dir, np.path AS parent_path FROM customer JOIN np ON c_nationkey = np.k),
t AS (SELECT path, is_dir, parent_path FROM rp UNION ALL SELECT path, is_dir, parent_path FROM np UNION ALL SELECT path, is_dir, parent_path FROM cp)"""


# Flagship: select, lay out, hash and list the members of an archive.
@query(f"""WITH {M}, s AS (SELECT * FROM m WHERE NOT (path GLOB 'src1*/*') AND (path GLOB '*/en/*' OR name GLOB 'doc_?[05].txt')),
o AS (SELECT *, CASE WHEN unpacked THEN NULL ELSE CAST(coalesce(sum(CASE WHEN unpacked THEN 0 ELSE size END) OVER (ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) END AS off FROM s)
SELECT ordinal, coalesce(off, -1) AS "offset", sha256(encode(text)) AS sha256, {LONG} || ' ' || {SIZES} || path AS line FROM o""")
def archive_listing(spark, d):
    m = select(members(spark, d, content=True), include=["*/en/*", "doc_?[05].txt"], exclude=["src1*/*"])
    laid = manifest.with_offsets(m.withColumn("sha256", F.sha2("content", 256)).drop("content"))
    return laid.select("ordinal", F.coalesce("offset", F.lit(-1)).alias("offset"), "sha256", manifest.long_line().alias("line"))


# Projections


@query(f"WITH {M} SELECT ordinal, parent_path || '/' || name AS full_path FROM m")
def path_concat(spark, d):
    return members(spark, d).select("ordinal", manifest.path_of(F.col("parent_path"), F.col("name")).alias("full_path"))


@query(f"WITH {T} SELECT CASE WHEN is_dir THEN path || '/' ELSE path END AS line FROM t")
def list_short(spark, d):
    return tree(spark, d).select(manifest.short_line().alias("line"))


@query(f"WITH {M} SELECT ordinal, {LONG} || ' ' || {SIZES} || path AS line FROM m")
def list_long(spark, d):
    return members(spark, d).select("ordinal", manifest.long_line().alias("line"))


@query(f"WITH {M} SELECT ordinal, {LONG} AS flags FROM m")
def member_flags(spark, d):
    return members(spark, d).select("ordinal", manifest.flags().alias("flags"))


@query(f"WITH {M} SELECT ordinal, CASE WHEN packed_z THEN original_size ELSE size END AS logical_size FROM m")
def logical_size(spark, d):
    return members(spark, d).select("ordinal", manifest.logical_size().alias("logical_size"))


@query("SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS root FROM pages")
def root_name(spark, d):
    return read(spark, d, "pages").select("page_id", paths.stored_root(F.col("url")).alias("root"))


@query(f"""WITH {M}, p AS (SELECT *, row_number() OVER (ORDER BY ordinal) - 1 AS idx FROM m WHERE NOT unpacked)
SELECT path AS name, size, CAST(packed_z AS INTEGER) AS alg, CASE WHEN packed_z THEN original_size ELSE 0 END AS original_size, idx FROM p""")
def dump_directory(spark, d):
    return manifest.dump_directory(members(spark, d))


@query(f"WITH {M} SELECT ordinal, row_number() OVER (ORDER BY ordinal) - 1 AS idx FROM m WHERE NOT unpacked")
def dump_index(spark, d):
    return manifest.running_before(manifest.packed(members(spark, d)), F.lit(1), "ordinal", "idx").select("ordinal", "idx")


@query(f"""WITH {M} SELECT ordinal, '{{"size":' || size || CASE WHEN unpacked THEN ',"unpacked":true' ELSE '' END || CASE WHEN executable THEN ',"executable":true' ELSE '' END
  || CASE WHEN packed_z THEN ',"compression":{{"algorithm":"DEFLATE","originalSize":' || original_size || '}}' ELSE '' END || '}}' AS json FROM m""")
def manifest_json(spark, d):
    m = members(spark, d).withColumn("offset", F.lit(None).cast("long")).withColumn("integrity", F.lit(None).cast("struct<algorithm:int,hash:binary,block_size:bigint,blocks:array<binary>>"))
    return m.select("ordinal", js.member_json().alias("json"))


# Patterns


@query("SELECT p_partkey, p_name FROM part WHERE p_name GLOB '*[a-m]?' OR p_name GLOB '[!a-f]*e*'")
def glob_filter(spark, d):
    n = F.col("p_name")
    return read(spark, d, "part").where(glob_match(n, "*[a-m]?", by_byte=True) | glob_match(n, "[!a-f]*e*", by_byte=True)).select("p_partkey", "p_name")


@query("SELECT page_id, url FROM pages WHERE url GLOB 'https://m.*' OR url GLOB '*/en/*' OR regexp_extract(url, '([^/]*)$', 1) GLOB '*7' OR url = 'http://ththre.example.com/fr/825?page=2&ref=x'")
def match_any_pattern(spark, d):
    rules = pattern_table(spark.createDataFrame([("https://m.*", True, False), ("*/en/*", False, False), ("*7", False, False), ("http://ththre.example.com/fr/825?page=2&ref=x", False, True)], "pattern string, anchored boolean, literal boolean"))
    return match_any(read(spark, d, "pages").withColumn("path", F.col("url")), rules).select("page_id", "url")


@query("SELECT page_id, url FROM pages WHERE NOT (url GLOB '*.example.com/*' OR regexp_extract(url, '([^/]*)$', 1) GLOB '[0-4]*')")
def match_none(spark, d):
    rules = pattern_table(spark.createDataFrame([("*.example.com/*", False, False), ("[0-4]*", False, False)], "pattern string, anchored boolean, literal boolean"))
    return match_any(read(spark, d, "pages").withColumn("path", F.col("url")), rules, anti=True).select("page_id", "url")


@query(f"WITH {T} SELECT path FROM t WHERE NOT (path GLOB 'A*/*' OR regexp_extract(path, '([^/]*)$', 1) GLOB 'E*' OR regexp_extract(coalesce(parent_path, ''), '([^/]*)$', 1) GLOB 'E*' OR split_part(path, '/', 1) GLOB 'E*')")
def exclude_tree(spark, d):
    return select(tree(spark, d), exclude=["A*/*", "E*"]).select("path")


@query(f"WITH {T} SELECT path FROM t WHERE regexp_extract(path, '([^/]*)$', 1) GLOB '*A' OR regexp_extract(coalesce(parent_path, ''), '([^/]*)$', 1) GLOB '*A' OR split_part(path, '/', 1) GLOB '*A' OR path GLOB 'EUROPE/*_[1-5]' OR coalesce(parent_path, '') GLOB 'EUROPE/*_[1-5]'")
def include_tree(spark, d):
    return select(tree(spark, d), include=["*A", "EUROPE/*_[1-5]"]).select("path")


@query(f"WITH {T} SELECT path FROM t WHERE path = 'ASIA' OR path LIKE 'ASIA/%' OR path = 'EUROPE/NATION_3' OR path LIKE 'EUROPE/NATION_3/%'")
def include_literal(spark, d):
    return select(tree(spark, d), paths=["ASIA", "EUROPE/NATION_3"]).select("path")


@query(f"WITH {T} SELECT path, regexp_extract(path, '([^/]*)$', 1) GLOB '*1' OR path GLOB 'ASIA/*' AS unpacked FROM t WHERE NOT (coalesce(parent_path, '') GLOB 'ASIA/*' OR coalesce(parent_path, '') GLOB '*1')")
def unpack_mark(spark, d):
    return mark_unpacked(tree(spark, d).withColumn("unpacked", F.lit(False)), ["*1", "ASIA/*"]).select("path", "unpacked")


@query(f"WITH {M} SELECT ordinal, path FROM m WHERE NOT unpacked")
def packed_files(spark, d):
    return manifest.packed(members(spark, d)).select("ordinal", "path")


@query(f"WITH {M} SELECT ordinal, path GLOB 'src?/*' AS anchored, name GLOB '*1?.txt' AS unanchored, path = 'src1/en/doc_1.txt' AS literal, path GLOB 'src2/*' AS dotted FROM m")
def match_modes(spark, d):
    p, n = F.col("path"), F.col("name")
    hit = lambda *x: matches(p, n, [Pattern(*x)])
    return members(spark, d).select("ordinal", hit("src?/*", True).alias("anchored"), hit("*1?.txt").alias("unanchored"), hit("src1/en/doc_1.txt", False, True).alias("literal"), hit("./src2/*").alias("dotted"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS value FROM documents),
p AS (SELECT doc_id, regexp_replace(value, '^[\\x01-\\x20]+|[ \\t-\\r]+$', '', 'g') AS v FROM l)
SELECT regexp_replace(v, '/$', '') AS pattern, count(*) AS n FROM p WHERE v <> '' AND NOT starts_with(v, '#') GROUP BY 1""")
def load_patterns(spark, d):
    lines = read(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("value"))
    return read_patterns(lines).groupBy("pattern").agg(F.count("*").alias("n"))


# Joins


@query(f"WITH {T} SELECT a.path AS parent, b.path AS child FROM t a JOIN t b ON b.parent_path = a.path WHERE a.is_dir")
def parent_child(spark, d):
    return manifest.children(tree(spark, d))


@query(f"WITH {T}, r AS (SELECT path FROM t WHERE path GLOB '*/*_1[0-9]' AND is_dir) SELECT t.path FROM t WHERE EXISTS (SELECT 1 FROM r WHERE t.path = r.path OR starts_with(t.path, r.path || '/'))")
def ancestor_join(spark, d):
    t = tree(spark, d)
    return manifest.under(t, t.where(F.col("is_dir") & glob_match(F.col("path"), "*/*_1[0-9]"))).select("path")


@query(f"WITH {T}, x AS (SELECT path, string_split(path, '/') AS s FROM t) SELECT path, CAST(k AS INTEGER) AS depth, array_to_string(s[1:k + 1], '/') AS ancestor FROM (SELECT path, s, unnest(range(0, len(s))) AS k FROM x)")
def flatten_tree(spark, d):
    return tree(spark, d).select("path", F.posexplode(ancestors(F.col("path"))).alias("depth", "ancestor"))


@query("SELECT l.doc_id, quality FROM labels l WHERE EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.lang = 'en')")
def lookup_linear(spark, d):
    return read(spark, d, "labels").join(read(spark, d, "documents").where("lang = 'en'").select("doc_id"), "doc_id", "left_semi").select("doc_id", "quality")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def lookup_sorted(spark, d):
    o, c = read(spark, d, "orders"), read(spark, d, "customer").select("c_custkey", "c_name")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select("o_orderkey", "c_name")


CODES = "codes AS (SELECT p_type, row_number() OVER (ORDER BY f) AS code FROM (SELECT p_type, min(p_partkey) AS f FROM part GROUP BY p_type))"


@query(f"WITH {CODES} SELECT p_type, code FROM codes")
def dict_encode(spark, d):
    return tables.dictionary(read(spark, d, "part"), "p_type", "p_partkey")


@query(f"WITH {CODES} SELECT p_partkey, codes.code, codes.p_type AS decoded FROM part JOIN codes USING (p_type)")
def dict_decode(spark, d):
    part = read(spark, d, "part")
    codes = tables.dictionary(part, "p_type", "p_partkey")
    coded = tables.encode(part.select("p_partkey", "p_type"), codes, "p_type").drop("p_type")
    return tables.decode(coded, codes, "code", "p_type").select("p_partkey", "code", F.col("p_type").alias("decoded"))


# Aggregates and integrity


@query(f"WITH {M} SELECT parent_path, CAST(sum(size) AS BIGINT) AS bytes FROM m GROUP BY 1")
def total_bytes(spark, d):
    return members(spark, d).groupBy("parent_path").agg(F.sum("size").alias("bytes"))


@query(f"WITH {M} SELECT parent_path, count(*) AS n FROM m GROUP BY 1")
def member_count(spark, d):
    return members(spark, d).groupBy("parent_path").agg(F.count("*").alias("n"))


@query(f"WITH {M} SELECT ordinal, sha256(encode(text)) AS sha256 FROM m")
def file_sha256(spark, d):
    return members(spark, d, content=True).select("ordinal", binary.hex_encode(integrity.digest(F.col("content"))).alias("sha256"))


HEXES = f"{M}, h AS (SELECT ordinal, hex(encode(text)) AS x, size FROM m), b AS (SELECT ordinal, k, sha256(unhex(substr(x, CAST(k * 2048 + 1 AS BIGINT), 2048))) AS digest FROM (SELECT *, unnest(range(0, size // 1024 + 1)) AS k FROM h))"


@query(f"WITH {HEXES} SELECT ordinal, CAST(k AS INTEGER) AS block, digest FROM b")
def block_hashes(spark, d):
    m = members(spark, d, content=True).select("ordinal", F.posexplode(integrity.block_digests(F.col("content"), 1024)).alias("block", "d"))
    return m.select("ordinal", "block", binary.hex_encode(F.col("d")).alias("digest"))


def _tampered(spark, d):
    m = integrity.protect(members(spark, d, content=True), block=1024)
    return m.withColumn("content", F.when(F.col("ordinal") % 4 == 0, F.concat(F.encode(F.lit("X"), "UTF-8"), F.substring("content", 2, 1 << 30))).otherwise(F.col("content")))


TAMPERED = f"{M}, v AS (SELECT ordinal, size, ordinal % 4 = 0 AND size > 0 AND substr(hex(encode(text)), 1, 2) <> '58' AS bad, ordinal % 4 = 0 AND size = 0 AS grown FROM m)"


@query(f"WITH {TAMPERED} SELECT ordinal, NOT bad AND NOT grown AS hash_ok, CAST(bad OR grown AS INTEGER) AS bad_blocks FROM v")
def verify_blocks(spark, d):
    return integrity.verify(_tampered(spark, d), block=1024).select("ordinal", "hash_ok", "bad_blocks")


@query(f"WITH {TAMPERED} SELECT count(*) AS members, count(*) AS checked, count(*) FILTER (bad OR grown) AS errors, count(*) FILTER (bad OR grown) AS bad_blocks, count(*) FILTER (grown) AS wrong_size FROM v")
def integrity_errors(spark, d):
    return integrity.report(integrity.verify(_tampered(spark, d).withColumn("compression", F.lit(None).cast("struct<algorithm:int,original_size:bigint>")), block=1024))


@query(f"WITH {M} SELECT ordinal, octet_length(encode(text)) = size AS same FROM m")
def size_check(spark, d):
    return members(spark, d, content=True).select("ordinal", (F.octet_length("content") == F.col("size")).alias("same"))


@query("SELECT doc_id, len(text) - len(replace(text, 'e', '')) AS n FROM documents")
def char_count(spark, d):
    return read(spark, d, "documents").select("doc_id", text.count_char(F.col("text"), "e").alias("n"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_returnflag, row_number() OVER w AS n, lag(l_returnflag) OVER w AS p FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag))
SELECT l_orderkey, l_linenumber, l_returnflag FROM x WHERE n = 1 OR l_returnflag IS DISTINCT FROM p""")
def dedup_adjacent(spark, d):
    return tables.drop_adjacent(read(spark, d, "lineitem"), "l_returnflag", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag"], ["l_orderkey"]).select("l_orderkey", "l_linenumber", "l_returnflag")


# Order


@query(f"""WITH {M} SELECT ordinal, CASE WHEN unpacked THEN -1 ELSE CAST(coalesce(sum(CASE WHEN unpacked THEN 0 ELSE size END) OVER (ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) END AS "offset" FROM m""")
def member_offsets(spark, d):
    return manifest.with_offsets(members(spark, d), width=4096).select("ordinal", F.coalesce("offset", F.lit(-1)).alias("offset"))


@query("""SELECT o_orderkey, CAST(coalesce(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM orders""")
def running_total(spark, d):
    o = read(spark, d, "orders").withColumn("o_orderkey", F.col("o_orderkey").cast("long"))
    return manifest.running_before(o, F.round(F.col("o_totalprice") * 100).cast("long"), "o_orderkey", "before", width=8192).select("o_orderkey", "before")


@query("WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents) SELECT doc_id, CAST(k AS INTEGER) AS key, s[k + 1] AS line FROM (SELECT doc_id, s, unnest(range(0, len(s))) AS k FROM x)")
def array_keys(spark, d):
    return read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("key", "line"))


@query(f"WITH {T} SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) - 1 AS ordinal FROM t")
def preorder(spark, d):
    return manifest.preorder(tree(spark, d)).select("path", "ordinal")


@query(f"WITH {M} SELECT ordinal, sha256(encode(text)) AS digest FROM m ORDER BY digest")
def binary_sort(spark, d):
    m = members(spark, d, content=True).select("ordinal", integrity.digest(F.col("content")).alias("b")).orderBy("b")
    return m.select("ordinal", binary.hex_encode(F.col("b")).alias("digest"))


@query("SELECT vec_id, list_reverse(embedding) AS reversed FROM embeddings")
def array_reverse(spark, d):
    return read(spark, d, "embeddings").select("vec_id", F.reverse("embedding").alias("reversed"))


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey DESC")
def reverse_order(spark, d):
    return read(spark, d, "part").orderBy(F.desc("p_partkey")).select("p_partkey", "p_name")


@query("SELECT c_name AS name, 0 AS part FROM customer UNION ALL SELECT s_name, 1 FROM supplier UNION ALL SELECT c_name, 2 FROM customer")
def union_all(spark, d):
    c, s = read(spark, d, "customer").select(F.col("c_name").alias("name")), read(spark, d, "supplier").select(F.col("s_name").alias("name"))
    return tables.append(c, s, c)


@query("""WITH l AS (SELECT page_id, unnest(range(0, len(s))) AS n, s FROM (SELECT page_id, string_split(html, '<') AS s FROM pages)),
x AS (SELECT page_id, n, s[n + 1] AS line FROM l),
w AS (SELECT *, sum(CAST(line = 'nav>' AS INTEGER)) OVER o AS o_, sum(CAST(line = '/nav>' AS INTEGER)) OVER o AS c_ FROM x WINDOW o AS (PARTITION BY page_id ORDER BY n))
SELECT page_id, CAST(n AS INTEGER) AS n, line, CASE WHEN o_ = 0 THEN 'before' ELSE 'after' END AS part FROM w WHERE o_ = 0 OR (c_ > 0 AND line <> '/nav>')""")
def splice_sections(spark, d):
    lines = read(spark, d, "pages").select("page_id", F.posexplode(F.split("html", "<")).alias("n", "line"))
    return tables.sections(lines, "nav>", "/nav>", ["page_id"])


# Arrays


@query("SELECT vec_id, list_concat(list_concat(embedding[1:3], [CAST(0.5 AS FLOAT)]), embedding[6:]) AS changed FROM embeddings")
def array_insert_remove(spark, d):
    e = F.col("embedding")
    return read(spark, d, "embeddings").select("vec_id", arrays.insert(arrays.remove(e, 3, 2), 3, F.lit(0.5).cast("float")).alias("changed"))


@query("SELECT vec_id, list_sort(embedding) AS sorted FROM embeddings")
def array_sort(spark, d):
    return read(spark, d, "embeddings").select("vec_id", F.array_sort("embedding").alias("sorted"))


@query("SELECT vec_id, CAST(list_position(list_transform(embedding, lambda x: x > 0.1), true) - 1 AS BIGINT) AS at FROM (SELECT * FROM embeddings WHERE list_contains(list_transform(embedding, lambda x: x > 0.1), true))")
def array_position(spark, d):
    big = F.transform("embedding", lambda x: x > F.lit(0.1))
    return read(spark, d, "embeddings").where(F.array_contains(big, True)).select("vec_id", arrays.position(big, F.lit(True)).alias("at"))


@query("SELECT vec_id, embedding[5:8] AS part, embedding[1] AS head, embedding[-1] AS tail, CAST(len(embedding) AS INTEGER) AS n, list_resize(embedding[1:2], 4, CAST(0 AS FLOAT)) AS padded FROM embeddings")
def array_slice(spark, d):
    e = F.col("embedding")
    return read(spark, d, "embeddings").select("vec_id", F.slice(e, 5, 4).alias("part"), arrays.get(e, 0).alias("head"), arrays.last(e).alias("tail"), F.size(e).alias("n"), arrays.resize(F.slice(e, 1, 2), 4, F.lit(0).cast("float")).alias("padded"))


@query("""WITH x AS (SELECT conv_id, list(role ORDER BY turn) AS r FROM conversations GROUP BY conv_id)
SELECT conv_id, list_transform(list_filter(range(1, len(r) + 1), lambda i: i = 1 OR r[i] IS DISTINCT FROM r[i - 1]), lambda i: r[i]) AS roles FROM x""")
def array_dedup_adjacent(spark, d):
    r = read(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("r"))
    return r.select("conv_id", arrays.drop_repeats(F.col("r")).alias("roles"))


# Strings


@query("SELECT doc_id, translate(text, 'aeiou', '43102') AS t FROM documents")
def str_translate(spark, d):
    return read(spark, d, "documents").select("doc_id", text.translate(F.col("text"), "aeiou", "43102").alias("t"))


@query("""WITH l AS (SELECT doc_id, ' ' || chr(9) || text || chr(10) || ' ' AS s FROM documents)
SELECT doc_id, regexp_replace(s, '^[\\x01-\\x20]+|[ \\t-\\r]+$', '', 'g') AS t, regexp_replace(s, '^[ \\t-\\r]+', '') AS l, regexp_replace(s, '[ \\t-\\r]+$', '') AS r FROM l""")
def str_trim(spark, d):
    s = F.concat(F.lit(" \t"), "text", F.lit("\n "))
    return read(spark, d, "documents").select("doc_id", text.trim(s).alias("t"), text.trim_left(s).alias("l"), text.trim_right(s).alias("r"))


@query("SELECT doc_id, trim(regexp_replace(text, '[\\x01-\\x20]+', ' ', 'g')) AS t FROM documents")
def str_normalize(spark, d):
    return read(spark, d, "documents").select("doc_id", text.normalize(F.col("text")).alias("t"))


@query("SELECT page_id, list_filter(string_split_regex(url, '[/.:?&=#]+'), lambda x: x <> '') AS tokens FROM pages")
def str_tokens(spark, d):
    return read(spark, d, "pages").select("page_id", text.tokens(F.col("url"), "/.:?&=#").alias("tokens"))


@query("SELECT p_partkey, p_brand || ':' || p_type || ':' || p_size AS t FROM part")
def str_concat(spark, d):
    return read(spark, d, "part").select("p_partkey", text.concat_all(F.col("p_brand"), F.lit(":"), F.col("p_type"), F.lit(":"), F.col("p_size").cast("string")).alias("t"))


@query("SELECT p_partkey, p_name[1:3] || '<>' || p_name[4:] AS t FROM part")
def str_insert(spark, d):
    return read(spark, d, "part").select("p_partkey", text.insert(F.col("p_name"), 3, "<>").alias("t"))


@query("SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN url[9:] END AS rest, CASE WHEN ends_with(url, 'top') THEN len(url) - 3 END AS at FROM pages WHERE starts_with(url, 'https://') AND ends_with(url, 'top')")
def prefix_suffix(spark, d):
    p = read(spark, d, "pages").select("page_id", text.after_prefix(F.col("url"), "https://").alias("rest"), text.suffix_start(F.col("url"), "top").cast("long").alias("at"))
    return p.where("rest is not null and at is not null")


@query("SELECT a.s_suppkey, a.s_nationkey IS NOT DISTINCT FROM nullif(a.s_suppkey % 25, 0) AS same FROM supplier a")
def null_safe_eq(spark, d):
    k = F.nullif(F.col("s_suppkey") % 25, F.lit(0))
    return read(spark, d, "supplier").select("s_suppkey", text.equal(F.col("s_nationkey"), k).alias("same"))


@query("SELECT n_name, r_name, lower(n_name[1:1]) = lower(lower(r_name)[1:1]) AS same FROM nation JOIN region ON n_regionkey = r_regionkey")
def ci_eq(spark, d):
    n, r = read(spark, d, "nation"), read(spark, d, "region")
    first = lambda c: F.substring(c, 1, 1)
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_name", "r_name", text.equal_ignoring_case(first("n_name"), first(F.lower("r_name"))).alias("same"))


@query("SELECT doc_id, ascii(text) AS cp, ascii(text) BETWEEN 65 AND 90 OR ascii(text) BETWEEN 192 AND 222 AS upper FROM documents WHERE length(text) > 0")
def codepoint_in(spark, d):
    cp = text.code_point(F.col("text"))
    return read(spark, d, "documents").where("length(text) > 0").select("doc_id", cp.alias("cp"), tables.in_ranges(cp, [(65, 90), (192, 222)]).alias("upper"))


@query("SELECT item_id, CASE WHEN item_id % 3 = 0 THEN text ELSE text || chr(65279) END AS t, length(text) + CAST(item_id % 3 <> 0 AS INTEGER) AS n FROM benchmark")
def strip_bom(spark, d):
    mark = F.decode(F.unhex(F.lit("EFBBBF")), "UTF-8")
    t = text.strip_bom(F.when(F.col("item_id") % 3 == 0, F.concat(mark, "text")).when(F.col("item_id") % 3 == 1, F.concat("text", mark)).otherwise(F.concat(mark, "text", mark)))
    return read(spark, d, "benchmark").select("item_id", t.alias("t"), F.length(t).cast("long").alias("n"))


# Numbers and bytes


@query("SELECT o_orderkey, CAST(o_orderkey - 1000 AS VARCHAR) AS signed, CAST(CAST(18446744073709551615 AS UBIGINT) - CAST(o_orderkey AS UBIGINT) AS VARCHAR) AS unsigned FROM orders")
def fmt_int(spark, d):
    k = F.col("o_orderkey")
    return read(spark, d, "orders").select("o_orderkey", (k - 1000).cast("string").alias("signed"), (F.lit("18446744073709551615").cast("decimal(20,0)") - k.cast("decimal(20,0)")).cast("decimal(20,0)").cast("string").alias("unsigned"))


@query("SELECT o_orderkey, lower(printf('%x', o_orderkey)) AS h FROM orders")
def fmt_hex(spark, d):
    return read(spark, d, "orders").select("o_orderkey", text.hex_int(F.col("o_orderkey")).alias("h"))


@query("SELECT p_partkey, p_name || ' has ' || p_size || ' (' || printf('%x', p_partkey) || ') 100%' AS t FROM part")
def fmt_printf(spark, d):
    return read(spark, d, "part").select("p_partkey", text.printf("%s has %d (%lx) 100%%", F.col("p_name"), F.col("p_size"), F.col("p_partkey").cast("long")).alias("t"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS t FROM events")
def fmt_time(spark, d):
    return read(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("t"))


@query("SELECT p_partkey, chr(CAST(200 + p_partkey % 50000 AS INTEGER)) AS c, lower(hex(encode(chr(CAST(200 + p_partkey % 50000 AS INTEGER))))) AS h FROM part")
def utf8_encode(spark, d):
    c = binary.from_code_point(200 + F.col("p_partkey") % 50000)
    return read(spark, d, "part").select("p_partkey", c.alias("c"), binary.hex_encode(binary.utf8(c)).alias("h"))


@query("SELECT item_id, lower(hex(encode(text))) AS h FROM benchmark")
def hex_encode(spark, d):
    return read(spark, d, "benchmark").select("item_id", binary.hex_encode(binary.utf8(F.col("text"))).alias("h"))


@query("SELECT item_id, text AS t, true AS odd_is_null FROM benchmark")
def hex_decode(spark, d):
    h = F.hex(F.encode("text", "UTF-8"))
    spaced = F.concat(F.substring(h, 1, 2), F.lit("- \n"), F.lower(F.substring(h, 3, 1 << 30)))
    return read(spark, d, "benchmark").select("item_id", F.decode(binary.hex_decode(spaced), "UTF-8").alias("t"), binary.hex_decode(F.concat(h, F.lit("1"))).isNull().alias("odd_is_null"))


@query("SELECT o_orderkey, printf('%02x%02x%02x%02x', o_orderkey & 255, (o_orderkey >> 8) & 255, (o_orderkey >> 16) & 255, (o_orderkey >> 24) & 255) AS packed, CAST(o_orderkey AS BIGINT) AS back FROM orders")
def word_le(spark, d):
    p = binary.pack_word_le(F.col("o_orderkey"))
    return read(spark, d, "orders").select("o_orderkey", binary.hex_encode(p).alias("packed"), binary.word_le(p).alias("back"))


@query("SELECT p_partkey, p_retailprice AS back, true AS same FROM part")
def float_layouts(spark, d):
    x = F.col("p_retailprice")
    bits = binary.double_bits(x)
    packed = binary.pack("b@d", F.lit(1), x)
    return read(spark, d, "part").select("p_partkey", binary.double_of_hex(binary.hex_double(x)).alias("back"), ((binary.double_of_bits(bits) == x) & (F.octet_length(packed) == 16) & (binary.shortest_17(x).cast("double") == x)).alias("same"))


@query("SELECT item_id, text AS t, CAST(2 * length(text) AS INTEGER) AS n16, CAST(4 * length(text) AS INTEGER) AS n32 FROM benchmark")
def wide_strings(spark, d):
    escaped = F.concat(F.lit("\\u00"), F.lower(F.hex(F.encode(F.substring("text", 1, 1), "ISO-8859-1"))), F.substring("text", 2, 1 << 30))
    return read(spark, d, "benchmark").select("item_id", binary.unescape(escaped).alias("t"), F.octet_length(binary.utf16(F.col("text"))).alias("n16"), F.octet_length(binary.utf32(F.col("text"))).alias("n32"))


# Paths


@query("SELECT page_id, regexp_extract(url, '([^/\\\\:]*)$', 1) AS base FROM pages")
def path_basename(spark, d):
    return read(spark, d, "pages").select("page_id", paths.basename(F.col("url")).alias("base"))


@query("SELECT page_id, regexp_extract(url, '^(.*/)?') AS dir, CAST(length(regexp_extract(url, '^(.*/)?')) AS INTEGER) AS n FROM pages")
def path_dirname(spark, d):
    x = paths.dirname(F.col("url"))
    return read(spark, d, "pages").select("page_id", x.alias("dir"), F.length(x).alias("n"))


@query(f"WITH {M} SELECT ordinal, regexp_extract(name, '(\\.[^.]*)$', 1) AS ext, regexp_replace(name, '\\.[^.]*$', '') AS stem FROM m")
def path_extension(spark, d):
    return members(spark, d).select("ordinal", paths.extension(F.col("path")).alias("ext"), paths.stem(F.col("path")).alias("stem"))


@query(f"WITH {M} SELECT ordinal, split_part(path, '/', 2) AS last FROM m")
def path_lastdir(spark, d):
    return members(spark, d).select("ordinal", paths.last_dir(paths.dirname(F.col("path"))).alias("last"))


@query("SELECT page_id, '/' AS root, regexp_replace('//' || url, '^/+', '') AS rel, NOT contains(url, '~') AS valid FROM pages")
def path_parse(spark, d):
    p = F.concat(F.lit("//"), "url")
    return read(spark, d, "pages").select("page_id", paths.root(p).alias("root"), paths.relative(p).alias("rel"), paths.valid(p).alias("valid"))


@query("SELECT page_id, CASE WHEN ends_with(url, '/') AND length(url) > 1 THEN url[1:-2] ELSE url END AS trimmed, CASE WHEN ends_with(url, '/') THEN url ELSE url || '/' END AS closed FROM pages")
def path_trim(spark, d):
    return read(spark, d, "pages").select("page_id", paths.trim_separator(F.col("url")).alias("trimmed"), paths.with_separator(F.col("url")).alias("closed"))


@query("SELECT page_id, list_filter(string_split(url, '/'), lambda x: x <> '') AS segments FROM pages")
def path_segments(spark, d):
    return read(spark, d, "pages").select("page_id", paths.segments(F.col("url")).alias("segments"))


# JSON


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, coalesce(json_extract_string(props, '$.none'), 'absent') AS none FROM events")
def json_get(spark, d):
    p = F.col("props")
    return read(spark, d, "events").select("event_id", js.get(p, "$.k").alias("k"), F.coalesce(js.get(p, "$.none"), F.lit("absent")).alias("none"))


@query("SELECT event_id, json_keys(props) AS keys FROM events")
def json_keys(spark, d):
    return read(spark, d, "events").select("event_id", js.keys(F.col("props")).alias("keys"))


@query("""SELECT event_id, CASE json_type(props) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'other' END AS kind FROM events""")
def json_type(spark, d):
    return read(spark, d, "events").select("event_id", js.kind(F.col("props")).alias("kind"))


@query("""SELECT event_id, '{"id":' || event_id || ',"type":"' || event_type || '"}' AS json FROM events""")
def json_put(spark, d):
    return read(spark, d, "events").select("event_id", js.put(id=F.col("event_id"), type=F.col("event_type")).alias("json"))


# Codecs


@query("SELECT doc_id, true AS same, true AS cut_is_null FROM documents")
def deflate_roundtrip(spark, d):
    z = read(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("b")).withColumn("z", codec.deflate(F.col("b")))
    cut = F.expr("substring(z, 1, octet_length(z) - 1)")
    return z.select("doc_id", (codec.inflate(F.col("z")) == F.col("b")).alias("same"), codec.inflate(cut).isNull().alias("cut_is_null"))


@query(f"WITH {M} SELECT ordinal, CAST(size AS DOUBLE) / original_size AS ratio FROM m WHERE packed_z AND size > 0")
def compress_ratio(spark, d):
    return members(spark, d).where(manifest.compressed() & (F.col("size") > 0)).select("ordinal", codec.ratio().alias("ratio"))

# Bytes and numbers whose values the SQL computes from arithmetic


@query("SELECT doc_id, CAST(length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) AS BIGINT) AS lead, CAST(octet_length(encode(text)) - length(text) AS BIGINT) AS tail, CAST(length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) AS BIGINT) AS plain FROM documents")
def byte_classes(spark, d):
    return read(spark, d, "documents").select("doc_id", binary.byte_counts(F.encode("text", "UTF-8")).alias("n")).select("doc_id", "n.*")


@query("""WITH b AS (SELECT o_orderkey, o_orderkey * 40503 % 256 AS a, o_orderkey * 7919 % 256 AS b, o_orderkey * 104729 % 256 AS c, o_orderkey * 1299709 % 256 AS d FROM orders)
SELECT o_orderkey, CAST(CASE WHEN a < 128 THEN a WHEN a < 192 THEN 0 WHEN a < 224 THEN (a & 31) * 64 + (b & 63) WHEN a < 240 THEN (a & 15) * 4096 + (b & 63) * 64 + (c & 63)
  ELSE (a & 7) * 262144 + (b & 63) * 4096 + (c & 63) * 64 + (d & 63) END AS INTEGER) AS code, CASE WHEN a < 128 THEN 1 WHEN a < 192 THEN 0 WHEN a < 224 THEN 2 WHEN a < 240 THEN 3 ELSE 4 END AS used FROM b""")
def utf8_lenient(spark, d):
    byte = lambda m: F.unhex(F.lpad(F.hex(F.col("o_orderkey").cast("long") * m % 256), 2, "0"))
    bytes_ = F.concat(*map(byte, (40503, 7919, 104729, 1299709)))
    return read(spark, d, "orders").select("o_orderkey", binary.first_code_point(bytes_).alias("x")).select("o_orderkey", "x.*")


UNITS = "list_transform(string_split(text, ''), lambda c: printf('%02x%02x', unicode(c) & 255, (unicode(c) >> 8) & 255))"


@query(f"SELECT item_id, array_to_string({UNITS}, '') AS h16, array_to_string(list_transform({UNITS}, lambda x: x || '0000'), '') AS h32, text AS t16, text || chr(65533) AS t32, true AS strict FROM benchmark")
def wide_bytes(spark, d):
    t = F.col("text")
    w, broken = binary.utf16(t), F.concat(binary.utf32(t), F.unhex(F.lit("00D80000")))
    return read(spark, d, "benchmark").select(
        "item_id", binary.hex_encode(w).alias("h16"), binary.hex_encode(binary.utf32(t)).alias("h32"), binary.from_utf16(w).alias("t16"), binary.from_utf32(broken).alias("t32"), binary.from_utf32(broken, replace=False).isNull().alias("strict")
    )


PARTS = "x AS (SELECT p_partkey, p_retailprice AS v, CAST(floor(log2(p_retailprice)) AS BIGINT) AS e FROM part), y AS (SELECT *, CAST((v / power(2, e) - 1) * 4503599627370496 AS BIGINT) AS m FROM x)"


@query(f"WITH {PARTS} SELECT p_partkey, (e + 1023) * 4503599627370496 + m AS bits, '0x1.' || printf('%013x', m) || 'p+' || e AS h, printf('%.17g', v) AS g, v AS back, v AS unhexed FROM y")
def double_bits(spark, d):
    x = F.col("p_retailprice")
    bits = binary.double_bits(x)
    return read(spark, d, "part").select("p_partkey", bits.alias("bits"), binary.hex_double(x).alias("h"), binary.shortest_17(x).alias("g"), binary.double_of_bits(bits).alias("back"), binary.double_of_hex(binary.hex_double(x)).alias("unhexed"))


FLOATS = "x AS (SELECT p_partkey, CAST(CAST(p_retailprice AS FLOAT) AS DOUBLE) AS v FROM part), y AS (SELECT *, CAST(floor(log2(v)) AS BIGINT) AS e FROM x), z AS (SELECT *, CAST((v / power(2, e) - 1) * 8388608 AS BIGINT) AS m FROM y)"


@query(f"WITH {FLOATS} SELECT p_partkey, CAST((e + 127) * 8388608 + m AS INTEGER) AS bits, '0x1.' || printf('%06x', m * 2) || 'p+' || e AS h, v AS back, v AS unhexed FROM z")
def float_hex(spark, d):
    x = F.col("p_retailprice").cast("float")
    bits = binary.float_bits(x)
    return read(spark, d, "part").select("p_partkey", bits.alias("bits"), binary.hex_float(x).alias("h"), binary.float_of_bits(bits).cast("double").alias("back"), binary.float_of_hex(binary.hex_float(x)).cast("double").alias("unhexed"))


@query("""WITH x AS (SELECT p_partkey AS k, p_size AS s, p_partkey % 100 - 50 AS c FROM part)
SELECT k AS p_partkey, printf('%02x', c & 255) || '00' || printf('%02x%02x', s & 255, (s >> 8) & 255) || printf('%02x%02x%02x%02x', k & 255, (k >> 8) & 255, (k >> 16) & 255, (k >> 24) & 255) AS signed,
  printf('%02x', s & 255) || '00' || printf('%02x%02x', k & 255, (k >> 8) & 255) || printf('%02x%02x%02x%02x', k & 255, (k >> 8) & 255, (k >> 16) & 255, (k >> 24) & 255) AS unsigned,
  printf('%02x', c & 255) || '00000000000000' || printf('%02x%02x%02x%02x', k & 255, (k >> 8) & 255, (k >> 16) & 255, (k >> 24) & 255) || '00000000' AS wide,
  printf('%02x', s & 255) || '00000000000000' || printf('%02x%02x%02x%02x', k & 255, (k >> 8) & 255, (k >> 16) & 255, (k >> 24) & 255) || '00000000' AS wide_unsigned,
  printf('%02x', s & 255) || '000000' || '0000003f' || '000000000000e0bf' AS reals FROM x""")
def aligned_layouts(spark, d):
    k, s = F.col("p_partkey").cast("long"), F.col("p_size").cast("long")
    c, put = k % 100 - 50, lambda layout, *x: binary.hex_encode(binary.pack(layout, *x))
    return read(spark, d, "part").select(
        "p_partkey", put("b@h@i", c, s, k).alias("signed"), put("B@H@I", s, k % 65536, k).alias("unsigned"), put("b@q", c, k).alias("wide"), put("B@Q", s, k).alias("wide_unsigned"),
        put("B@f@d", s, F.lit(0.5), F.lit(-0.5)).alias("reals"),
    )


@query("""SELECT p_partkey, p_name || ':' || chr(CAST(200 + p_partkey % 50000 AS INTEGER)) || chr(65 + p_size % 26) || chr(97 + p_size % 26) || ' -' || p_size || ' ' || (18446744073709551615 - CAST(p_partkey AS HUGEINT)) || ' ' || p_partkey || ' '
  || p_partkey || ' ' || printf('%.17g', p_retailprice) || ' 5%' AS t FROM part""")
def printf_all(spark, d):
    k, s = F.col("p_partkey").cast("long"), F.col("p_size").cast("long")
    made = text.printf("%s:%lc%wc%c -%t %llu %z %ld %g 5%%", F.col("p_name"), 200 + k % 50000, 65 + s % 26, 97 + s % 26, s, -k - 1, k, k, F.col("p_retailprice"))
    return read(spark, d, "part").select("p_partkey", made.alias("t"))


# Strings, arrays and JSON, continued


@query("SELECT p_partkey, p_name[1:4] AS head FROM part")
def str_prefix(spark, d):
    return read(spark, d, "part").select("p_partkey", text.prefix(F.col("p_name"), 4).alias("head"))


@query("""WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents), y AS (SELECT doc_id, CASE WHEN s[-1] = '' THEN s[1:-2] ELSE s END AS s FROM x)
SELECT doc_id, list_transform(s, lambda x: regexp_replace(x, '\r$', '')) AS lines FROM y""")
def read_lines(spark, d):
    return read(spark, d, "documents").select("doc_id", text.lines(F.col("text")).alias("lines"))


@query("SELECT s_suppkey, row_number() OVER (ORDER BY nullif(s_nationkey, 3) NULLS FIRST, s_suppkey DESC) AS place, CASE WHEN s_nationkey = 3 THEN -1 WHEN s_name < 'Supplier#000000500' THEN -1 WHEN s_name = 'Supplier#000000500' THEN 0 ELSE 1 END AS against FROM supplier")
def null_order(spark, d):
    key, name = F.nullif("s_nationkey", F.lit(3)), F.when(F.col("s_nationkey") != 3, F.col("s_name"))
    placed = manifest.numbered(read(spark, d, "supplier"), key.asc_nulls_first(), F.col("s_suppkey").desc(), name="place")
    return placed.select("s_suppkey", (F.col("place") + 1).alias("place"), text.compare(name, F.lit("Supplier#000000500")).alias("against"))


@query("SELECT p_partkey, [{'lo': 0, 'hi': p_size}, {'lo': p_size + 1, 'hi': p_size + 9}] AS ranges FROM part")
def range_append(spark, d):
    s = F.col("p_size").cast("int")
    first = F.array(F.struct(F.lit(0).alias("lo"), s.alias("hi")))
    return read(spark, d, "part").select("p_partkey", arrays.append_range(first, s + 1, s + 9).alias("ranges"))


@query("SELECT doc_id, regexp_matches(text, '[A-Z\\x{C0}-\\x{DE}]') AS upper, regexp_matches(text, '[\\x{3040}-\\x{30FF}\\x{4E00}-\\x{9FFF}]') AS east FROM documents")
def any_codepoint_in(spark, d):
    t = F.col("text")
    return read(spark, d, "documents").select("doc_id", tables.any_in_ranges(t, [(65, 90), (0xC0, 0xDE)]).alias("upper"), tables.any_in_ranges(t, [(0x3040, 0x30FF), (0x4E00, 0x9FFF)]).alias("east"))


@query("SELECT p_partkey, n_name FROM part JOIN nation ON p_partkey % 1000 BETWEEN n_nationkey * 37 AND n_nationkey * 37 + 50")
def range_join(spark, d):
    ranges = read(spark, d, "nation").select("n_name", (F.col("n_nationkey") * 37).alias("lo"), (F.col("n_nationkey") * 37 + 50).alias("hi"))
    return tables.join_ranges(read(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 1000).alias("v")), "v", ranges).select("p_partkey", "n_name")


@query("""WITH x AS (SELECT conv_id, list(role ORDER BY turn, role) AS r FROM conversations GROUP BY conv_id)
SELECT conv_id, '{"roles":["' || array_to_string(r, '","') || '"]}' AS json, r AS roles, r[1] AS head FROM x""")
def json_array(spark, d):
    r = read(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("r"))
    made = r.select("conv_id", js.put(roles=F.col("r")).alias("json"))
    return made.select("conv_id", "json", js.elements(F.col("json"), "$.roles").alias("roles"), js.get(F.col("json"), "$.roles[0]").alias("head"))


@query("""SELECT event_id, '{' || chr(10) || ' "id": ' || event_id || ',' || chr(10) || ' "all": [' || chr(10) || '  "' || event_type || '",' || chr(10) || '  "x"' || chr(10) || ' ]' || chr(10) || '}' AS json FROM events""")
def json_indented(spark, d):
    made = js.put(id=F.col("event_id"), all=F.array("event_type", F.lit("x")))
    return read(spark, d, "events").select("event_id", js.indented(made).alias("json"))


@query("""SELECT event_id, '["' || event_type || '",null,"' || user_id || '"]' AS json FROM events""")
def json_put_array(spark, d):
    return read(spark, d, "events").select("event_id", js.put_array(F.col("event_type"), F.lit(None).cast("string"), F.col("user_id").cast("string")).alias("json"))


@query("SELECT item_id, CASE WHEN regexp_matches(text, '^[A-Za-z0-9@%+=:,./_-]+$') THEN text ELSE '''' || replace(text, '''', '''\"''\"''') || '''' END AS quoted FROM benchmark")
def shell_quote(spark, d):
    return read(spark, d, "benchmark").select("item_id", binary.shell_quote(F.col("text")).alias("quoted"))


@query("""WITH x AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN props[:-2] ELSE '[' || props || ']' END AS j FROM events) SELECT event_id, json_valid(j) AS valid FROM x""")
def json_valid(spark, d):
    p = F.col("props")
    broken = F.when(F.col("event_id") % 3 == 0, p).when(F.col("event_id") % 3 == 1, F.expr("substring(props, 1, length(props) - 1)")).otherwise(F.concat(F.lit("["), p, F.lit("]")))
    return read(spark, d, "events").select("event_id", js.valid(broken).alias("valid"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS place FROM orders")
def int_order(spark, d):
    return manifest.numbered(read(spark, d, "orders"), F.col("o_custkey"), F.col("o_orderkey"), name="place").select("o_orderkey", "place")


# Members, continued


@query(f"WITH {M} SELECT ordinal, CASE WHEN ordinal % 2 = 0 THEN size ELSE 0 END AS size, CAST(0 AS BIGINT) AS \"offset\", executable, unpacked FROM m")
def member_defaults(spark, d):
    m = members(spark, d).withColumn("size", F.when(F.col("ordinal") % 2 == 0, F.col("size"))).withColumn("executable", F.when(F.col("executable"), True)).drop("offset")
    return manifest.with_defaults(m).select("ordinal", "size", "offset", "executable", "unpacked")


@query(f"WITH {M} SELECT ordinal, sha256(encode(text)) AS digest FROM m")
def digest_of_parts(spark, d):
    m = members(spark, d, content=True)
    n = F.floor(F.octet_length("content") / 1024).cast("int")
    parts = m.select("ordinal", "content", F.explode(F.sequence(F.lit(0), n)).alias("block")).select("ordinal", "block", F.substring("content", F.col("block") * 1024 + 1, 1024).alias("content"))
    return integrity.digest_of_parts(parts, "ordinal").select("ordinal", binary.hex_encode(F.col("digest")).alias("digest"))


@query("SELECT item_id, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS t FROM benchmark")
def pipe_through(spark, d):
    rows = read(spark, d, "benchmark").select("item_id", F.encode("text", "UTF-8").alias("content"))
    return pipes.through(rows, ["tr", "a-z", "A-Z"]).select("item_id", F.decode("content", "UTF-8").alias("t"))


@query("SELECT CAST(0 AS BIGINT) AS command, CAST(unnest([0, 1]) AS BIGINT) AS line, unnest(['a', 'b c']) AS text UNION ALL SELECT 1, 0, 'x'")
def pipe_source(spark, d):
    return pipes.output_lines(spark, [["printf", "a\\nb c\\n"], ["printf", "x"]])


@query("SELECT CAST(i AS BIGINT) AS ordinal, lower(hex(encode(t))) AS h FROM (VALUES (0, 'one'), (1, ''), (2, 'drei ß')) AS x(i, t)")
def string_source(spark, d):
    return pipes.strings(spark, ["one", "", "drei ß"]).unionByName(pipes.strings(spark, [])).select("ordinal", binary.hex_encode(F.col("content")).alias("h"))


@query("SELECT doc_id, text AS t, true AS not_longer FROM documents")
def smallest_deflate(spark, d):
    z = read(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("b")).withColumn("z", codec.smallest_deflate(F.col("b"), 6))
    return z.select("doc_id", F.decode(codec.inflate(F.col("z")), "UTF-8").alias("t"), (F.octet_length("z") <= F.octet_length(codec.deflate(F.col("b")))).alias("not_longer"))


@query("WITH x AS (SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n FROM documents) SELECT doc_id, 128 + greatest(n * 110 // 100, n + (n // 31744 + 1) * 5) AS most, true AS within FROM x")
def deflate_bound(spark, d):
    b = F.encode("text", "UTF-8")
    most = codec.deflate_bound(F.octet_length(b).cast("long"))
    return read(spark, d, "documents").select("doc_id", most.alias("most"), (F.octet_length(codec.deflate(b)) <= most).alias("within"))


#: Raw DEFLATE made by hand: one stored block that holds the bytes of a text of less than 64 KiB.
@query("SELECT item_id, text AS t FROM benchmark")
def inflate_stored(spark, d):
    b = F.encode("text", "UTF-8")
    n = F.octet_length(b)
    stream = F.concat(F.unhex(F.lit("01")), binary.pack("H", n.cast("long")), binary.pack("H", (65535 - n).cast("long")), b)
    return read(spark, d, "benchmark").select("item_id", F.decode(codec.inflate(stream), "UTF-8").alias("t"))


# Archives: documents written to the shared folder as an archive and read back


def _written(spark: SparkSession, d: str, kind: str, **options: str) -> str:
    path = f"{shared_dir(spark)}/satchel-{uuid.uuid4().hex}.{kind}"
    write_archive(members(spark, d, content=True).select("path", "content", "executable", "unpacked"), path, **options)
    return path


LAID = f"""{M}, o AS (SELECT *, CASE WHEN unpacked THEN -1 ELSE CAST(coalesce(sum(CASE WHEN unpacked THEN 0 ELSE size END) OVER
  (ORDER BY string_split(path, '/') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) END AS off FROM m)"""


@query(f"""WITH {LAID} SELECT path, name, parent_path, size, off AS "offset", executable, unpacked, CASE WHEN unpacked THEN '' ELSE sha256(encode(text)) END AS hash FROM o""")
def scan_archive(spark, d):
    m = read_archive(spark, _written(spark, d, "asar", integrity="true")).where(~F.col("is_dir"))
    return m.select("path", "name", "parent_path", "size", F.coalesce("offset", F.lit(-1)).alias("offset"), "executable", "unpacked", F.coalesce(binary.hex_encode(F.col("integrity.hash")), F.lit("")).alias("hash"))


@query(f"WITH {LAID}, d AS (SELECT DISTINCT source AS path FROM documents UNION SELECT DISTINCT source || '/' || lang FROM documents) SELECT path, false AS is_dir FROM o UNION ALL SELECT path, true FROM d")
def scan_bsar(spark, d):
    return read_archive(spark, _written(spark, d, "bsar", compress="true")).select("path", "is_dir")


@query(f"WITH {M} SELECT path, sha256(encode(text)) AS sha256, size AS n FROM m WHERE NOT unpacked")
def member_bytes(spark, d):
    m = read_archive(spark, _written(spark, d, "bsar", compress="true"), content=True, split="1000000")
    return manifest.packed(m).select("path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("n"))


@query(f"WITH {M} SELECT 'root/' || path AS path, size FROM m WHERE NOT unpacked AND NOT (name GLOB '*5.txt')")
def scan_files(spark, d):
    """Extracted and read again as files, with one exclusion."""
    root = f"{shared_dir(spark).removeprefix('file://')}/satchel-{uuid.uuid4().hex}/root"
    extract(read_archive(spark, _written(spark, d, "asar"), content=True), root)
    return read_files(spark, root, exclude=["*5.txt"]).where(~F.col("is_dir")).select("path", "size")


@query(f"""WITH {M} SELECT path, size AS bytes, 'written' AS action, '-i' || CASE WHEN executable THEN 'x' ELSE '-' END || '- ' || repeat(' ', 14)
  || lpad(CAST(size AS VARCHAR), CAST(greatest(12, length(CAST(size AS VARCHAR))) AS INTEGER), ' ') || ' ' || path AS line FROM m WHERE NOT unpacked""")
def extract_report(spark, d):
    """What extraction with a check says of each member."""
    root = f"{shared_dir(spark).removeprefix('file://')}/satchel-{uuid.uuid4().hex}/root"
    return extract(read_archive(spark, _written(spark, d, "asar", integrity="true"), content=True), root, check=True)
