"""Scalar functions: numbers, strings, patterns, dates, lists, maps, structs, JSON, hashes, casts."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumine.data import table
from vellumine.functions import dates, json, lists, numbers, strings
from vellumine.plans.suite import Suite

suite = Suite()
C = F.col

suite.both("fn_arithmetic", "SELECT p_partkey, p_size / 7 AS d, p_size % 7 AS m, abs(p_size - 25) AS a, sign(p_size - 25.0) AS s, floor(p_retailprice / 7) AS f, ceil(p_retailprice / 7) AS c, round(p_retailprice / 7, 2) AS r FROM part".replace("sign(p_size - 25.0)", "CAST(sign(p_size - 25) AS INT)").replace("floor(p_retailprice / 7)", "CAST(floor(p_retailprice / 7) AS BIGINT)").replace("ceil(p_retailprice / 7)", "CAST(ceil(p_retailprice / 7) AS BIGINT)"))
suite.both("fn_transcendental", "SELECT p_partkey, round(sqrt(p_size), 8) AS sq, round(cbrt(p_size), 8) AS cb, round(exp(p_size / 50.0E0), 8) AS ex, round(ln(p_size), 8) AS l, round(log10(p_size), 8) AS l10, round(log2(p_size), 8) AS l2, round(sin(p_size), 8) AS si, round(cos(p_size), 8) AS co, round(tan(p_size), 6) AS ta, round(atan2(p_size, 3), 8) AS a2, round(degrees(p_size), 6) AS dg, round(radians(p_size), 8) AS rd, round(pow(p_size, 1.5E0), 6) AS pw FROM part")
suite.both("fn_conditional", "SELECT c_custkey, coalesce(nullif(c_nationkey, 3), -1) AS c, greatest(c_nationkey, 10) AS g, least(c_nationkey, 10) AS l, CASE WHEN c_acctbal IS NULL THEN 'n' WHEN c_acctbal < 0 THEN 'neg' ELSE 'pos' END AS k FROM customer")
suite.both("fn_three_valued", "SELECT a AND b AS x, a OR b AS y, NOT a AS z, a IS DISTINCT FROM b AS d, a = b AS e FROM (VALUES (true, true), (true, false), (true, NULL), (false, NULL), (CAST(NULL AS BOOLEAN), NULL)) t(a, b)")
suite.texts("fn_bitwise", "SELECT p_partkey, p_size & 12 AS a, p_size | 3 AS o, p_size ^ 5 AS x, ~p_size AS n, shiftleft(p_size, 2) AS l, shiftright(p_size, 1) AS r, bit_count(p_size) AS b FROM part", "SELECT p_partkey, p_size & 12 AS a, p_size | 3 AS o, xor(p_size, 5) AS x, ~p_size AS n, p_size << 2 AS l, p_size >> 1 AS r, CAST(bit_count(p_size) AS INT) AS b FROM part")


@suite.add("fn_divide_by_zero", "SELECT a, b, CAST(a AS DOUBLE) / CAST(b AS DOUBLE) AS q FROM (VALUES (1, 2), (1, 0), (-1, 0), (NULL, 0), (3, NULL)) t(a, b)")
def divide(spark, folder):
    df = spark.createDataFrame([(1, 2), (1, 0), (-1, 0), (None, 0), (3, None)], "a int, b int")
    return df.select("a", "b", numbers.divide(C("a"), C("b")).alias("q"))


@suite.add("fn_rounding_family", "SELECT x, trunc(x) AS t, even(x) AS e, round_even(x, 0) AS b, CAST(floor(x / 3) AS DOUBLE) AS fd, fmod(x, 3) AS fm, CAST(x AS BIGINT) AS i FROM (SELECT (p_size - 25) / 2.0 AS x0, CAST((p_size - 25) / 2.0 AS DOUBLE) AS x FROM part)")
def rounding(spark, folder):
    df = table(spark, folder, "part").select(((C("p_size") - 25) / 2).alias("x"))
    return df.select("x", numbers.trunc(C("x")).alias("t"), numbers.even(C("x")).alias("e"), F.bround("x", 0).alias("b"), numbers.fdiv(C("x"), F.lit(3)).alias("fd"), numbers.fmod(C("x"), F.lit(3)).alias("fm"), numbers.to_integer(C("x")).alias("i"))


@suite.add("fn_number_theory", "SELECT p_partkey, CAST(gcd(p_partkey, p_size) AS BIGINT) AS g, CAST(lcm(p_partkey, p_size) AS BIGINT) AS l, CAST(factorial(CAST(p_size % 15 AS INT)) AS BIGINT) AS f FROM part")
def theory(spark, folder):
    return table(spark, folder, "part").select("p_partkey", numbers.gcd(C("p_partkey"), C("p_size")).alias("g"), numbers.lcm(C("p_partkey"), C("p_size")).alias("l"), F.factorial((C("p_size") % 15).cast("int")).alias("f"))


@suite.add("fn_float_probes", "SELECT x, isnan(x) AS n, isinf(x) AS i, isfinite(x) AS f, signbit(x) AS s FROM (SELECT CAST(v AS DOUBLE) AS x FROM (VALUES ('1.5'), ('-2'), ('inf'), ('-inf'), ('0')) t(v))")
def probes(spark, folder):
    df = spark.createDataFrame([(1.5,), (-2.0,), (float("inf"),), (float("-inf"),), (0.0,)], "x double")
    return df.select("x", F.isnan("x").alias("n"), numbers.isinf(C("x")).alias("i"), numbers.isfinite(C("x")).alias("f"), numbers.signbit(C("x")).alias("s"))


@suite.add("fn_gamma", "SELECT p_size, round(gamma(p_size / 10.0), 6) AS g, round(lgamma(p_size / 1.0), 6) AS lg, nextafter(CAST(p_size AS DOUBLE), 100.0) > p_size AS n FROM part WHERE p_size > 0")
def gamma(spark, folder):
    df = table(spark, folder, "part").where("p_size > 0").select("p_size", C("p_size").cast("double").alias("x"))
    return df.select("p_size", F.round(numbers.gamma(C("x") / 10), 6).alias("g"), F.round(numbers.lgamma(C("x")), 6).alias("lg"), (numbers.nextafter(C("x"), F.lit(100.0)) > C("x")).alias("n"))


suite.texts("fn_strings_core", "SELECT c_custkey, lower(c_name) AS lo, upper(c_mktsegment) AS up, CAST(length(c_name) AS BIGINT) AS n, reverse(c_mktsegment) AS rv, replace(c_name, '0', 'o') AS rp, instr(c_name, '#') AS ps, lpad(c_mktsegment, 12, '*') AS lp, rpad(c_mktsegment, 12, '-') AS rp2, trim(concat('  ', c_mktsegment, ' ')) AS tr, repeat(left(c_mktsegment, 1), 3) AS rr, translate(c_name, 'Cus', 'kUS') AS tl, ascii(c_mktsegment) AS ac, startswith(c_name, 'Cust') AS sw, contains(c_name, '77') AS ct FROM customer",
            "SELECT c_custkey, lower(c_name) AS lo, upper(c_mktsegment) AS up, length(c_name) AS n, reverse(c_mktsegment) AS rv, replace(c_name, '0', 'o') AS rp, CAST(instr(c_name, '#') AS INT) AS ps, lpad(c_mktsegment, 12, '*') AS lp, rpad(c_mktsegment, 12, '-') AS rp2, trim(concat('  ', c_mktsegment, ' ')) AS tr, repeat(left(c_mktsegment, 1), 3) AS rr, translate(c_name, 'Cus', 'kUS') AS tl, ascii(c_mktsegment) AS ac, starts_with(c_name, 'Cust') AS sw, contains(c_name, '77') AS ct FROM customer")


@suite.add("fn_strings_edges", "SELECT c_custkey, strlen(c_name) AS b, concat(c_name, NULL, '!') AS c, substr(c_name, 0, 4) AS s0, left(c_name, -3) AS l, right(c_name, -3) AS r, split_part(c_name, '#', 2) AS p, string_split(c_name, '#') AS sp, c_name[2:4] AS sl, unicode(c_name) AS u FROM customer")
def edges(spark, folder):
    n = C("c_name")
    return table(spark, folder, "customer").select("c_custkey", strings.strlen(n).alias("b"), strings.concat(n, F.lit(None).cast("string"), F.lit("!")).alias("c"), strings.substr(n, 0, 4).alias("s0"), strings.left(n, -3).alias("l"), strings.right(n, -3).alias("r"), strings.split_part(n, "#", 2).alias("p"), strings.string_split(n, "#").alias("sp"), strings.substr(n, 2, 3).alias("sl"), strings.ord_(n).alias("u"))


suite.texts("fn_like", "SELECT p_partkey, p_type LIKE '%STEEL' AS a, p_type ILIKE 'promo%' AS b, p_type NOT LIKE '%_RASS%' AS c, p_type LIKE '50\\\\%' AS d FROM part", "SELECT p_partkey, p_type LIKE '%STEEL' AS a, p_type ILIKE 'promo%' AS b, p_type NOT LIKE '%_RASS%' AS c, p_type LIKE '50$%' ESCAPE '$' AS d FROM part")


@suite.add("fn_regex", "SELECT p_partkey, regexp_matches(p_type, '^S.*L$') AS m, regexp_full_match(p_type, '[A-Z ]+') AS f, regexp_replace(p_type, '[AEIOU]', '_') AS r1, regexp_replace(p_type, '[AEIOU]', '_', 'g') AS rg, regexp_extract(p_brand, '#([0-9])([0-9])', 2) AS e, regexp_extract_all(p_type, '[A-Z]{4}') AS ea, regexp_split_to_array(p_type, ' +') AS sp, p_type GLOB '*[ST]T*' AS g FROM part")
def regexes(spark, folder):
    t = C("p_type")
    return table(spark, folder, "part").select("p_partkey", t.rlike("^S.*L$").alias("m"), strings.full_match(t, "[A-Z ]+").alias("f"), strings.regexp_replace_first(t, "[AEIOU]", "_").alias("r1"), F.regexp_replace(t, "[AEIOU]", "_").alias("rg"), F.regexp_extract("p_brand", "#([0-9])([0-9])", 2).alias("e"), F.regexp_extract_all(t, F.lit("[A-Z]{4}"), F.lit(0)).alias("ea"), F.split(t, " +").alias("sp"), strings.glob(t, "*[ST]T*").alias("g"))


@suite.add("fn_similarity", "SELECT a.n_nationkey AS x, b.n_nationkey AS y, levenshtein(a.n_name, b.n_name) AS l, damerau_levenshtein(a.n_name, b.n_name) AS d, round(jaccard(a.n_name, b.n_name), 8) AS j, round(jaro_similarity(a.n_name, b.n_name), 8) AS js, round(jaro_winkler_similarity(a.n_name, b.n_name), 8) AS jw FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def similarity(spark, folder):
    n = table(spark, folder, "nation")
    a, b = n.select(C("n_nationkey").alias("x"), C("n_name").alias("s")), n.select(C("n_nationkey").alias("y"), C("n_name").alias("t"))
    pairs = a.join(b, C("x") < C("y"))
    return pairs.select("x", "y", F.levenshtein("s", "t").cast("long").alias("l"), strings.damerau_levenshtein("s", "t").alias("d"), F.round(strings.jaccard(C("s"), C("t")), 8).alias("j"), F.round(strings.jaro_similarity("s", "t"), 8).alias("js"), F.round(strings.jaro_winkler_similarity("s", "t"), 8).alias("jw"))


@suite.add("fn_unicode", "SELECT s, strip_accents(s) AS a, nfc_normalize(s) AS n, length_grapheme(s) AS g FROM (VALUES ('Crème brûlée'), ('naïve'), ('e' || chr(769)), (''), (NULL)) t(s)")
def unicode(spark, folder):
    df = spark.createDataFrame([("Crème brûlée",), ("naïve",), ("é",), ("",), (None,)], "s string")
    return df.select("s", strings.strip_accents("s").alias("a"), strings.nfc_normalize("s").alias("n"), strings.length_grapheme("s").alias("g"))


suite.both("fn_hashes", "SELECT page_id, md5(html) AS m, sha1(url) AS s1 FROM pages")
suite.texts("fn_sha256", "SELECT doc_id, sha2(text, 256) AS s FROM documents", "SELECT doc_id, sha256(text) AS s FROM documents")
suite.texts("fn_encodings", "SELECT n_nationkey, hex(n_name) AS h, base64(CAST(n_name AS BINARY)) AS b, url_encode(n_name) AS u, bin(n_nationkey) AS bi, CAST(unhex(hex(n_name)) AS STRING) AS back FROM nation", "SELECT n_nationkey, hex(n_name) AS h, base64(CAST(n_name AS BLOB)) AS b, replace(url_encode(n_name), '%20', '+') AS u, bin(n_nationkey) AS bi, decode(unhex(hex(n_name))) AS back FROM nation")


@suite.add("fn_format", "SELECT p_partkey, format('{} has {}', p_brand, p_size) AS f, printf('%05d|%.2f', p_size, p_retailprice) AS p, format_bytes(p_partkey * 1000) AS b, bar(p_size, 0, 50, 10) IS NOT NULL AS r FROM part".replace("bar(p_size, 0, 50, 10) IS NOT NULL AS r", "true AS r"))
def formats(spark, folder):
    return table(spark, folder, "part").select("p_partkey", strings.format_braces("{} has {}", C("p_brand"), C("p_size")).alias("f"), F.format_string("%05d|%.2f", "p_size", "p_retailprice").alias("p"), strings.format_bytes(C("p_partkey") * 1000).alias("b"), strings.bar(C("p_size"), 0, 50, 10).isNotNull().alias("r"))


@suite.add("fn_paths", "SELECT page_id, parse_filename(url) AS f, parse_dirname(url) AS d, parse_path(url) AS p FROM pages")
def paths(spark, folder):
    return table(spark, folder, "pages").select("page_id", strings.parse_filename(C("url")).alias("f"), strings.parse_dirname(C("url")).alias("d"), F.split("url", "/").alias("p")).withColumn("p", F.filter("p", lambda x: x != ""))


@suite.add("fn_date_parts", "SELECT event_id, year(ts) AS y, quarter(ts) AS q, month(ts) AS m, weekofyear(ts) AS w, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, dayofweek(ts) AS dow, isodow(ts) AS idow, dayofyear(ts) AS doy, isoyear(ts) AS iy, yearweek(ts) AS yw, decade(ts) AS de, century(ts) AS ce, millennium(ts) AS ml, era(ts) AS er, round(epoch(ts), 3) AS ep, dayname(ts) AS dn, monthname(ts) AS mn, last_day(ts) AS ld FROM events")
def date_parts(spark, folder):
    t, long = C("ts"), lambda c: c.cast("long")
    return table(spark, folder, "events").select(
        "event_id", long(F.year(t)).alias("y"), long(F.quarter(t)).alias("q"), long(F.month(t)).alias("m"), long(F.weekofyear(t)).alias("w"), long(F.dayofmonth(t)).alias("d"), long(F.hour(t)).alias("h"), long(F.minute(t)).alias("mi"),
        dates.dow(t).alias("dow"), dates.isodow(t).alias("idow"), long(F.dayofyear(t)).alias("doy"), dates.isoyear(t).alias("iy"), dates.yearweek(t).alias("yw"), dates.decade(t).alias("de"), dates.century(t).alias("ce"), dates.millennium(t).alias("ml"), dates.era(t).alias("er"),
        F.round(dates.epoch(t), 3).alias("ep"), dates.dayname(t).alias("dn"), dates.monthname(t).alias("mn"), F.last_day(t).alias("ld"),
    )


@suite.add("fn_date_diff", "SELECT o_orderkey, date_diff('day', o_orderdate, DATE '1997-02-28') AS d, date_diff('week', o_orderdate, DATE '1997-02-28') AS w, date_diff('month', o_orderdate, DATE '1997-02-28') AS m, date_diff('quarter', o_orderdate, DATE '1997-02-28') AS q, date_diff('year', o_orderdate, DATE '1997-02-28') AS y, date_diff('hour', o_orderdate, DATE '1997-02-28') AS h FROM orders")
def date_diff(spark, folder):
    end = F.lit("1997-02-28").cast("timestamp_ntz")
    return table(spark, folder, "orders").select("o_orderkey", *[dates.date_diff(p, C("o_orderdate"), end).alias(a) for p, a in (("day", "d"), ("week", "w"), ("month", "m"), ("quarter", "q"), ("year", "y"), ("hour", "h"))])


@suite.add("fn_date_sub", "SELECT o_orderkey, date_sub('day', o_orderdate, TIMESTAMP '1997-02-28 00:00:00') AS d, date_sub('month', o_orderdate, TIMESTAMP '1997-02-28 00:00:00') AS m, date_sub('year', o_orderdate, TIMESTAMP '1997-02-28 00:00:00') AS y, date_sub('week', o_orderdate, TIMESTAMP '1997-02-28 00:00:00') AS w FROM orders")
def date_sub(spark, folder):
    end = F.lit("1997-02-28").cast("timestamp_ntz")
    return table(spark, folder, "orders").select("o_orderkey", *[dates.date_sub(p, C("o_orderdate"), end).alias(a) for p, a in (("day", "d"), ("month", "m"), ("year", "y"), ("week", "w"))])


@suite.add("fn_time_bucket", "SELECT event_id, time_bucket(INTERVAL 3 HOURS, ts) AS b3, time_bucket(INTERVAL 5 DAYS, ts) AS b5, time_bucket(INTERVAL 2 MONTHS, ts) AS bm FROM events".replace("time_bucket(INTERVAL 2 MONTHS, ts)", "CAST(time_bucket(INTERVAL 2 MONTHS, ts) AS DATE)"))
def time_bucket(spark, folder):
    t = C("ts")
    return table(spark, folder, "events").select("event_id", dates.time_bucket(3 * 3600 * 10**6, t).alias("b3"), dates.time_bucket(5 * 86_400 * 10**6, t).alias("b5"), dates.time_bucket_months(2, t).alias("bm"))


suite.texts("fn_date_trunc", "SELECT event_id, CAST(date_trunc('hour', ts) AS TIMESTAMP_NTZ) AS h, CAST(date_trunc('week', ts) AS TIMESTAMP_NTZ) AS w, CAST(date_trunc('month', ts) AS TIMESTAMP_NTZ) AS m, CAST(date_trunc('quarter', ts) AS TIMESTAMP_NTZ) AS q FROM events", "SELECT event_id, date_trunc('hour', ts) AS h, CAST(date_trunc('week', ts) AS TIMESTAMP) AS w, CAST(date_trunc('month', ts) AS TIMESTAMP) AS m, CAST(date_trunc('quarter', ts) AS TIMESTAMP) AS q FROM events")
suite.texts("fn_intervals", "SELECT o_orderkey, o_orderdate + INTERVAL '1' MONTH AS m, o_orderdate - INTERVAL '10' DAY AS d, make_date(year(o_orderdate), 2, 1) AS f FROM orders", "SELECT o_orderkey, o_orderdate + INTERVAL 1 MONTH AS m, o_orderdate - INTERVAL 10 DAY AS d, make_date(year(o_orderdate), 2, 1) AS f FROM orders")


@suite.add("fn_strftime", "SELECT event_id, strftime(ts, '%Y/%m/%d %H:%M') AS s, strptime(strftime(ts, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS back, try_strptime('x' || event_id, '%Y') IS NULL AS bad FROM events")
def strftime(spark, folder):
    t = C("ts")
    return table(spark, folder, "events").select("event_id", dates.strftime(t, "%Y/%m/%d %H:%M").alias("s"), dates.try_strptime(dates.strftime(t, "%Y-%m-%d %H:%M:%S"), "%Y-%m-%d %H:%M:%S").alias("back"), dates.try_strptime(F.concat(F.lit("x"), C("event_id")), "%Y").isNull().alias("bad"))


@suite.add("fn_lists", "SELECT k, list_contains(l, 3) AS c, list_position(l, 3) AS p, list_sort(list_distinct(l)) AS d, list_sort(l) AS s, list_reverse_sort(l) AS rs, list_reverse(l) AS r, l[2] AS e, l[-1] AS la, l[2:3] AS sl, CAST(list_sum(l) AS BIGINT) AS su, list_avg(l) AS av, list_max(l) AS mx, len(l) AS n, CAST(list_unique(l) AS BIGINT) AS u, list_grade_up(l) AS g, list_resize(l, 5, 0) AS z, list_concat(l, [9]) AS cc FROM (SELECT p_partkey AS k, [CAST(p_size AS INT), 3, CAST(p_size % 5 AS INT), 7] AS l FROM part)")
def list_functions(spark, folder):
    l = C("l")
    df = table(spark, folder, "part").select(C("p_partkey").alias("k"), F.array(C("p_size"), F.lit(3), C("p_size") % 5, F.lit(7)).alias("l"))
    return df.select("k", F.array_contains(l, 3).alias("c"), lists.position(l, F.lit(3)).alias("p"), F.sort_array(F.array_distinct(l)).alias("d"), lists.sort(l).alias("s"), lists.sort(l, True).alias("rs"), F.reverse(l).alias("r"), lists.extract(l, 2).alias("e"), lists.extract(l, -1).alias("la"), lists.slice_(l, 2, 3).alias("sl"), lists.total(l, "long").alias("su"), lists.mean(l).alias("av"), F.array_max(l).alias("mx"), F.size(l).cast("long").alias("n"), F.size(F.array_distinct(l)).cast("long").alias("u"), lists.grade_up(l).alias("g"), lists.resize(l, 5, F.lit(0)).alias("z"), F.concat(l, F.array(F.lit(9))).alias("cc"))


@suite.add("fn_lambdas", "SELECT k, list_transform(l, lambda x: x * 2) AS t, list_filter(l, lambda x: x > 3) AS f, list_reduce(l, lambda a, b: a + b) AS r, list_has_any(l, [3, 99]) AS ha, list_has_all(l, [3, 7]) AS hl FROM (SELECT p_partkey AS k, [CAST(p_size AS INT), 3, 7] AS l FROM part)")
def lambdas(spark, folder):
    l = C("l")
    df = table(spark, folder, "part").select(C("p_partkey").alias("k"), F.array(C("p_size"), F.lit(3), F.lit(7)).alias("l"))
    return df.select("k", F.transform(l, lambda x: x * 2).alias("t"), F.filter(l, lambda x: x > 3).alias("f"), lists.reduce(l, lambda a, b: a + b).alias("r"), F.arrays_overlap(l, F.array(F.lit(3), F.lit(99))).alias("ha"), lists.has_all(l, F.array(F.lit(3), F.lit(7))).alias("hl"))


@suite.add("fn_vectors", "SELECT a.vec_id AS x, b.vec_id AS y, round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS ip, round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS d, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS c FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vectors(spark, folder):
    e = table(spark, folder, "embeddings")
    a, b = e.select(C("vec_id").alias("x"), C("embedding").alias("u")), e.select(C("vec_id").alias("y"), C("embedding").alias("v"))
    j = a.join(b, C("y") == C("x") + 1)
    return j.select("x", "y", F.round(lists.inner_product(C("u"), C("v")), 5).alias("ip"), F.round(lists.distance(C("u"), C("v")), 5).alias("d"), F.round(lists.cosine_similarity(C("u"), C("v")), 5).alias("c"))


suite.texts("fn_structs", "SELECT c_custkey, s.a AS a, s.b AS b, struct(s.*, c_nationkey AS c).c AS c FROM (SELECT *, named_struct('a', c_custkey, 'b', c_mktsegment) AS s FROM customer)", "SELECT c_custkey, s.a AS a, s.b AS b, struct_insert(s, c := c_nationkey).c AS c FROM (SELECT *, {'a': c_custkey, 'b': c_mktsegment} AS s FROM customer)")
suite.texts("fn_maps", "SELECT n_nationkey, m['k'] AS v, try_element_at(m, 'zz') AS missing, map_keys(m) AS ks, map_values(m) AS vs, CAST(cardinality(m) AS BIGINT) AS n, map_contains_key(m, 'r') AS h FROM (SELECT n_nationkey, map('k', n_nationkey, 'r', n_regionkey) AS m FROM nation)", "SELECT n_nationkey, m['k'] AS v, m['zz'] AS missing, map_keys(m) AS ks, map_values(m) AS vs, CAST(cardinality(m) AS BIGINT) AS n, map_contains(m, 'r') AS h FROM (SELECT n_nationkey, MAP {'k': n_nationkey, 'r': n_regionkey} AS m FROM nation)")
suite.texts("fn_json_access", "SELECT event_id, get_json_object(props, '$.k') AS k, CAST(get_json_object(props, '$.k') AS INT) AS i, json_object_keys(props) AS ks, try_parse_json(props) IS NOT NULL AS ok FROM events", "SELECT event_id, props->>'k' AS k, CAST(props->>'k' AS INT) AS i, json_keys(props) AS ks, json_valid(props) AS ok FROM events")


@suite.add("fn_json_rewrite", "SELECT event_id, CAST(json_merge_patch(props, '{\"z\":1}') AS VARCHAR) AS m, json_type(props) AS t FROM events")
def json_rewrite(spark, folder):
    df = table(spark, folder, "events").withColumn("patch", F.lit('{"z":1}'))
    return df.select("event_id", json.merge_patch("props", "patch").alias("m"), json.json_type("props").alias("t"))


suite.texts("fn_json_build", "SELECT n_nationkey, to_json(named_struct('n', n_name, 'r', n_regionkey)) AS j, json_array_length('[1,2,3]') AS l FROM nation", "SELECT n_nationkey, CAST(json_object('n', n_name, 'r', n_regionkey) AS VARCHAR) AS j, CAST(json_array_length('[1,2,3]') AS INT) AS l FROM nation")
suite.texts("fn_casts", "SELECT try_cast(v AS INT) AS i, try_cast(v AS DOUBLE) AS d, try_cast(v AS DATE) AS t FROM (VALUES ('12'), ('x'), ('3.5E2'), ('2024-02-29'), (NULL)) t(v)".replace("try_cast(v AS INT)", "CAST(rint(try_cast(v AS DOUBLE)) AS INT)"), "SELECT TRY_CAST(TRY_CAST(v AS DOUBLE) AS INT) AS i, TRY_CAST(v AS DOUBLE) AS d, TRY_CAST(v AS DATE) AS t FROM (VALUES ('12'), ('x'), ('3.5E2'), ('2024-02-29'), (NULL)) t(v)")
suite.texts("fn_collation", "SELECT x, x COLLATE UTF8_LCASE = 'straße' AS nocase, x COLLATE UNICODE_AI = 'Jose' AS noaccent, x COLLATE UNICODE_CI_AI = 'josé' AS neither FROM (VALUES ('STRAße'), ('José'), ('Jose'), ('JOSE'), ('other'), (NULL)) t(x)",
            "SELECT x, x COLLATE NOCASE = 'straße' AS nocase, x COLLATE NOACCENT = 'Jose' AS noaccent, x COLLATE NOCASE.NOACCENT = 'josé' AS neither FROM (VALUES ('STRAße'), ('José'), ('Jose'), ('JOSE'), ('other'), (NULL)) t(x)")


@suite.add("fn_enum_union", "SELECT o_orderkey, CAST(list_position(['F', 'O', 'P'], o_orderstatus) - 1 AS INT) AS code, CASE WHEN o_orderstatus = 'F' THEN 'num' ELSE 'txt' END AS tag FROM orders")
def enum_union(spark, folder):
    u = F.when(C("o_orderstatus") == "F", lists.union_value(["num", "txt"], "num", C("o_totalprice"), {"num": "double", "txt": "string"})).otherwise(lists.union_value(["num", "txt"], "txt", C("o_orderstatus"), {"num": "double", "txt": "string"}))
    return table(spark, folder, "orders").select("o_orderkey", lists.enum_code(["F", "O", "P"], C("o_orderstatus")).alias("code"), u["tag"].alias("tag"))
