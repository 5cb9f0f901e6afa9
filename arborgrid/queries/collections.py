"""Strings, paths, dictionaries, sets and file sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborgrid.functions import arith, dictionary, text
from arborgrid.operators import sampling, sets
from arborgrid.registry import query
from arborgrid.tables import read


@query("string_fns", """SELECT doc_id, trim(source, 'b') AS trimmed, ltrim(source, 'b') AS ltrimmed, rtrim(source, 's') AS rtrimmed, starts_with(source, 'board') AS starts, ends_with(source, 'roots') AS ends,
  CASE WHEN starts_with(source, 'board-') THEN substr(source, 7) ELSE source END AS no_prefix, CASE WHEN ends_with(source, '-b') THEN left(source, length(source) - 2) ELSE source END AS no_suffix,
  upper(source) AS up, lower(source) AS low, replace(source, '-', '::') AS replaced, source || '/' || CAST(doc_id AS VARCHAR) AS joined FROM documents""")
def string_fns(spark, folder):
    s = F.col("source")
    return read(spark, folder, "documents").select(
        "doc_id", text.trim_char(s, "b").alias("trimmed"), text.left_trim(s, "b").alias("ltrimmed"), text.right_trim(s, "s").alias("rtrimmed"), s.startswith("board").alias("starts"), s.endswith("roots").alias("ends"),
        text.remove_prefix(s, "board-").alias("no_prefix"), text.remove_suffix(s, "-b").alias("no_suffix"), F.upper(s).alias("up"), F.lower(s).alias("low"), text.replace(s, "-", "::").alias("replaced"),
        F.concat(s, F.lit("/"), F.col("doc_id").cast("string")).alias("joined"),
    )


@query("split_at", "SELECT c_custkey, string_split(c_name, '#')[1] AS first, string_split(c_name, '#')[-1] AS last, string_split(c_name, '#')[5] AS none, CAST(len(string_split(c_name, '0')) AS INT) AS n FROM customer")
def split_at(spark, folder):
    c = F.col("c_name")
    return read(spark, folder, "customer").select("c_custkey", text.split_at(c, "#", 0).alias("first"), text.split_at(c, "#", -1).alias("last"), text.split_at(c, "#", 4).alias("none"), F.size(text.split(c, "0")).alias("n"))


@query("path_parse", r"""WITH p AS (SELECT file_id, replace(trim(filename, E' \n\t\r'), '\', '/') AS f FROM ift_filenames), n AS (SELECT *, string_split(f, '/')[-1] AS name, regexp_extract(string_split(f, '/')[-1], '(?i)((\.nii|\.tar)\.gz|\.tar\.bz2|\.[^.]*)$', 1) AS ext FROM p), b AS (SELECT *, left(name, length(name) - length(ext)) AS base FROM n)
  SELECT file_id, name, CASE WHEN contains(f, '/') THEN regexp_extract(f, '^(.*)/[^/]*$', 1) ELSE '.' END AS dir, ext, base, TRY_CAST(regexp_extract(base, '^([0-9]+)_([0-9]+)', 1) AS INT) AS label, TRY_CAST(regexp_extract(base, '^([0-9]+)_([0-9]+)', 2) AS BIGINT) AS sample, regexp_extract(base, '^[0-9]+_[0-9]+_(.*)$', 1) AS suffix FROM b""")
def path_parse(spark, folder):
    f = F.replace(F.btrim("filename", F.lit(" \n\t\r")), F.lit("\\"), F.lit("/"))
    rows = read(spark, folder, "ift_filenames").select("file_id", f.alias("f"))
    c = F.col("f")
    return rows.select(
        "file_id", text.filename(c).alias("name"), text.dirname(c).alias("dir"), text.extension(c).alias("ext"), text.basename(c).alias("base"), text.file_label(c).alias("label"), text.file_sample(c).alias("sample"), text.file_suffix(c).alias("suffix")
    )


@query("normal_paths", r"SELECT lower(regexp_replace(regexp_replace(regexp_replace(filename, '^\s+|\s+$', '', 'g'), '[\\/]+', '/', 'g'), '^(\./)+', '')) AS path, count(*) AS n FROM ift_filenames GROUP BY 1")
def normal_paths(spark, folder):
    return read(spark, folder, "ift_filenames").groupBy(text.normal_path(F.col("filename")).alias("path")).agg(F.count(F.lit(1)).alias("n"))


@query("regex_filter", "SELECT doc_id, regexp_matches(text, '[0-9]{3,}') AS has_number, regexp_matches(text, '^\\s*>') AS quoted FROM documents WHERE text IS NOT NULL".replace("\\\\", "\\"))
def regex_filter(spark, folder):
    return read(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", text.regex_match(F.col("text"), "[0-9]{3,}").alias("has_number"), text.regex_match(F.col("text"), r"^\s*>").alias("quoted"))


@query("json_get", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.nope') AS missing FROM events")
def json_get(spark, folder):
    return read(spark, folder, "events").select("event_id", dictionary.get_json(F.col("props"), "$.k", "bigint").alias("k"), dictionary.get_json(F.col("props"), "$.nope").alias("missing"))


@query("dict_merge", "SELECT event_id, '{\"k\":' || CAST(json_extract(props, '$.k') AS VARCHAR) || ',\"user\":' || CAST(user_id AS VARCHAR) || '}' AS merged, CAST(user_id AS BIGINT) AS v FROM events")
def dict_merge(spark, folder):
    m = dictionary.merge_maps(dictionary.json_map(F.col("props")), F.create_map(F.lit("user"), F.col("user_id")))
    return read(spark, folder, "events").select("event_id", dictionary.map_json(m).alias("merged"), F.element_at(m, "user").alias("v"))


@query("array_fns", "SELECT vec_id, CAST(len(embedding) AS INT) AS n, embedding[1:3] AS head, list_reverse(embedding)[1:2] AS tail, list_contains(embedding, embedding[1]) AS has, CAST(list_position(embedding, list_max(embedding)) AS BIGINT) AS argmax, round(list_avg(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS mean FROM embeddings")
def array_fns(spark, folder):
    e = F.col("embedding")
    mean = F.aggregate(e, F.lit(0.0), lambda s, v: s + v.cast("double")) / F.size(e)
    return read(spark, folder, "embeddings").select("vec_id", F.size(e).alias("n"), F.slice(e, 1, 3).alias("head"), F.slice(F.reverse(e), 1, 2).alias("tail"), F.array_contains(e, e[0]).alias("has"), F.array_position(e, F.array_max(e)).alias("argmax"), F.round(mean, 6).alias("mean"))


@query("ranges", "SELECT r_regionkey, [0.5 + 0.25 * i FOR i IN range(7)]::DOUBLE[] AS closed, [pow(2.0, i) FOR i IN range(6)]::DOUBLE[] AS geometric, [r_regionkey FOR i IN range(3)] AS repeated FROM region")
def ranges(spark, folder):
    return read(spark, folder, "region").select("r_regionkey", arith.arange(0.5, 2.0, 0.25).alias("closed"), arith.geometric_range(1.0, 32.0, 2.0).alias("geometric"), F.array_repeat("r_regionkey", 3).alias("repeated"))


@query("set_union", "SELECT c_nationkey AS n FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark, folder):
    return sets.union(read(spark, folder, "customer").select(F.col("c_nationkey").alias("n")), read(spark, folder, "supplier").select("s_nationkey"))


@query("union_all", "SELECT c_nationkey AS n, c_acctbal AS b FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier")
def union_all(spark, folder):
    return sets.union_all(read(spark, folder, "customer").select(F.col("c_nationkey").alias("n"), F.col("c_acctbal").alias("b")), read(spark, folder, "supplier").select("s_nationkey", "s_acctbal"))


@query("semi_join_files", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def semi_join_files(spark, folder):
    keys = read(spark, folder, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return sets.intersection(read(spark, folder, "part").select("p_partkey"), keys, ["p_partkey"])


@query("anti_join_seeds", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def anti_join_seeds(spark, folder):
    keys = read(spark, folder, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return sets.difference(read(spark, folder, "part").select("p_partkey"), keys, ["p_partkey"])


@query("class_counts", "SELECT class, count(*) AS n FROM ift_filenames GROUP BY 1")
def class_counts(spark, folder):
    return sets.label_counts(read(spark, folder, "ift_filenames"), "class")


@query(
    "file_table",
    r"""WITH f AS (SELECT filename AS path, string_split(replace(regexp_replace(regexp_replace(filename, '^\s+', ''), '\s+$', ''), '\', '/'), '/')[-1] AS n FROM ift_filenames), e AS (SELECT path, n, regexp_extract(n, '(?i)((\.nii|\.tar)\.gz|\.tar\.bz2|\.[^.]*)$', 1) AS ext FROM f), b AS (SELECT path, ext, left(n, len(n) - len(ext)) AS b FROM e)
    SELECT path, TRY_CAST(nullif(regexp_extract(b, '^([0-9]+)_([0-9]+)', 1), '') AS INT) AS label, TRY_CAST(nullif(regexp_extract(b, '^([0-9]+)_([0-9]+)', 2), '') AS BIGINT) AS sample, regexp_extract(b, '^[0-9]+_[0-9]+_(.*)$', 1) AS suffix, ext FROM b""".replace("\\\\", "\\"),
)
def file_table(spark, folder):
    return sets.file_table(read(spark, folder, "ift_filenames"), "filename")


@query("filter_by_basename", "WITH f AS (SELECT file_id, pool, regexp_replace(string_split(filename, '/')[-1], '(?i)((\\.nii|\\.tar)\\.gz|\\.tar\\.bz2|\\.[^.]*)$', '') AS b FROM ift_filenames) SELECT file_id FROM f WHERE b IN (SELECT b FROM f WHERE pool IN (SELECT max(pool) FROM f))".replace("\\\\", "\\"))
def filter_by_basename(spark, folder):
    f = read(spark, folder, "ift_filenames")
    top = f.agg(F.max("pool").alias("pool"))
    return sets.filter_by_basename(f, f.join(F.broadcast(top), "pool"), "filename").select("file_id")


@query("dense_domain", "SELECT n_nationkey, CAST(coalesce(n, 0) AS BIGINT) AS n FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey")
def dense_domain(spark, folder):
    counts = read(spark, folder, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    return sets.dense(counts, read(spark, folder, "nation"), ["n_nationkey"], "n")


@query("translate_seeds", "SELECT l_orderkey, CAST(l_quantity AS INT) + 7 AS x, l_linenumber - 2 AS y FROM lineitem WHERE CAST(l_quantity AS INT) + 7 BETWEEN 0 AND 49 AND l_linenumber - 2 BETWEEN 0 AND 5")
def translate_seeds(spark, folder):
    s = read(spark, folder, "lineitem").select("l_orderkey", F.col("l_quantity").cast("int").alias("x"), F.col("l_linenumber").alias("y"))
    return sets.translate(s, 7, -2, 50, 6)


@query("grid_points", "SELECT p_partkey, p_size FROM part WHERE p_partkey % 4 = 2 AND p_size % 4 = 2")
def grid_points(spark, folder):
    return sampling.grid_points(read(spark, folder, "part").select("p_partkey", "p_size"), 4, "p_partkey", "p_size")


@query("matrix_product", "WITH a AS (SELECT l_suppkey AS i, l_linenumber AS k, sum(l_quantity) AS v FROM lineitem GROUP BY ALL), b AS (SELECT l_linenumber AS k, l_returnflag AS j, sum(l_discount) AS v FROM lineitem GROUP BY ALL) SELECT i, j, round(sum(a.v * b.v), 4) AS v FROM a JOIN b USING (k) GROUP BY ALL")
def matrix_product(spark, folder):
    from arborgrid.operators import matrices

    li = read(spark, folder, "lineitem")
    a = li.groupBy(F.col("l_suppkey").alias("i"), F.col("l_linenumber").alias("j")).agg(F.sum("l_quantity").alias("v"))
    b = li.groupBy(F.col("l_linenumber").alias("i"), F.col("l_returnflag").alias("j")).agg(F.sum("l_discount").alias("v"))
    return matrices.multiply(a, b).withColumn("v", F.round("v", 4))


@query("matrix_reductions", "WITH a AS (SELECT l_suppkey AS i, l_linenumber AS j, sum(l_quantity) AS v FROM lineitem GROUP BY ALL) SELECT j, sum(v) AS sum, round(avg(v), 6) AS mean, max(v) AS max, min(v) AS min FROM a GROUP BY 1")
def matrix_reductions(spark, folder):
    from arborgrid.operators import matrices

    a = read(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("i"), F.col("l_linenumber").alias("j")).agg(F.sum("l_quantity").alias("v"))
    return matrices.reduce(a, "j")
