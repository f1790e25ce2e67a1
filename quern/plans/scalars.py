"""One query for each family of scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import scalar as S
from quern.operators.relational import top_n
from quern.plans.dialect import run
from quern.plans.registry import query, same
from quern.sources.tables import table

C = F.col


def pick(df, *plain, **made):
    return df.select(*plain, *[v.alias(k) for k, v in made.items()])


@query(r"""
SELECT doc_id, replace(upper(text), 'ẞ', 'SS') AS up, lower(text) AS low, length(text) AS len, strlen(text) AS bytes, reverse(text) AS rev,
       left(text, 5) AS l5, right(text, 5) AS r5, left(text, 0) AS l0, concat(lang, NULL, source) AS joined, lang || NULL AS piped, concat_ws('-', lang, NULL, source) AS dashed,
       substr(text, 1, 3) AS clamped, substr(text, 4, 6) AS middle, '' AS negative, replace(source, 'src', 's') AS replaced, repeat(lang, 3) AS thrice,
       starts_with(text, 'The') AS starts, ends_with(text, '.') AS ends, contains(text, 'and') AS has, instr(text, 'a') AS at_a,
       chr(CAST(65 + doc_id % 26 AS INTEGER)) AS letter, trim(' ' || lang || chr(9), ' ' || chr(9)) AS trimmed, ltrim('  ' || lang) AS lt, rtrim(lang || '  ') AS rt
FROM documents""")
def fn_string(spark, sf):
    t, lang, source = C("text"), C("lang"), C("source")
    none = F.lit(None).cast("string")
    return pick(
        table(spark, sf, "documents"), "doc_id",
        up=F.upper(t), low=F.lower(t), len=F.length(t), bytes=F.octet_length(t), rev=F.reverse(t),
        l5=F.left(t, F.lit(5)), r5=F.right(t, F.lit(5)), l0=F.left(t, F.lit(-1)), joined=S.concat(lang, none, source), piped=F.concat(lang, none), dashed=F.concat_ws("-", lang, none, source),
        clamped=S.substring(t, F.lit(-4), F.lit(3)), middle=S.substring(t, F.lit(4), F.lit(6)), negative=S.substring(t, F.lit(2), F.lit(-1)), replaced=S.replace(source, "src", "s"), thrice=F.repeat(lang, F.lit(3)),
        starts=t.startswith("The"), ends=t.endswith("."), has=t.contains("and"), at_a=F.instr(t, "a"),
        letter=S.char(65 + C("doc_id") % 26), trimmed=S.trim(F.concat(F.lit(" "), lang, F.lit("\t"))), lt=S.ltrim(F.concat(F.lit("  "), lang)), rt=S.rtrim(F.concat(lang, F.lit("  "))),
    )


@query("""
SELECT p_partkey, lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 12, '.') AS rp, lpad(p_brand, 3, '*') AS cut, split_part(p_name, ' ', 1) AS first_word, split_part(p_name, ' ', 9) AS beyond,
       position('a' IN p_name) AS pos, strpos(p_name, 'zzz') AS absent, CASE WHEN strpos(substr(p_name, 3), 'a') > 0 THEN strpos(substr(p_name, 3), 'a') + 2 ELSE 0 END AS from_three, length(p_type) AS n
FROM part""")
def fn_pad_split(spark, sf):
    brand, name = C("p_brand"), C("p_name")
    return pick(
        table(spark, sf, "part"), "p_partkey",
        lp=F.lpad(brand, 12, "*"), rp=F.rpad(brand, 12, "."), cut=F.lpad(brand, 3, "*"), first_word=S.split_part(name, " ", 1), beyond=S.split_part(name, " ", 9),
        pos=F.locate("a", name), absent=F.instr(name, "zzz"), from_three=S.locate("a", name, 3), n=F.char_length("p_type"),
    )


@query("""
SELECT c_custkey, abs(c_acctbal) AS a, round(c_acctbal) AS r0, round(c_acctbal, 1) AS r1, floor(c_acctbal) AS f, ceil(c_acctbal) AS c, trunc(c_acctbal) AS t, c_custkey % 7 AS m,
       round(power(c_custkey % 10, 3), 3) AS p, sign(c_acctbal) AS s, round(exp(c_custkey % 5), 6) AS e, round(pi(), 10) AS pi, round(sin(c_custkey), 8) AS sn, round(cos(c_custkey), 8) AS cs, round(tan(c_custkey % 3), 8) AS tn
FROM customer""")
def fn_math(spark, sf):
    x, k = C("c_acctbal"), C("c_custkey")
    return pick(
        table(spark, sf, "customer"), "c_custkey",
        a=S.absolute(x), r0=F.round(x), r1=F.round(x, 1), f=S.floor(x), c=S.ceil(x), t=S.truncate(x), m=k % 7, p=F.round(F.pow(k % 10, F.lit(3)), 3), s=S.sign(x),
        e=F.round(F.exp(k % 5), 6), pi=F.round(F.pi(), 10), sn=F.round(F.sin(k), 8), cs=F.round(F.cos(k), 8), tn=F.round(F.tan(k % 3), 8),
    )


@query("""
SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN round(sqrt(c_acctbal), 8) END AS root, CASE WHEN c_acctbal > 0 THEN round(log10(c_acctbal), 8) END AS lg, CASE WHEN c_acctbal > 0 THEN round(ln(c_acctbal), 8) END AS nat,
       CASE WHEN c_acctbal > 0 THEN round(log2(c_acctbal), 8) END AS two, CASE WHEN c_acctbal > 0 THEN round(ln(c_acctbal) / ln(3), 8) END AS base3
FROM customer""")
def fn_log_domain(spark, sf):
    """Outside their domain roots and logarithms are null."""
    x = C("c_acctbal")
    return pick(
        table(spark, sf, "customer"), "c_custkey",
        root=F.round(S.sqrt(x), 8), lg=F.round(S.log(x), 8), nat=F.round(S.ln(x), 8), two=F.round(F.when(x > 0, F.log2(x)), 8), base3=F.round(S.log(x, F.lit(3.0)), 8),
    )


@query("""
SELECT event_id, year(ts) AS y, month(ts) AS mo, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, second(ts) AS s, extract(dow FROM ts) AS dow, extract(isodow FROM ts) AS isodow, extract(doy FROM ts) AS doy,
       extract(week FROM ts) AS week, extract(quarter FROM ts) AS quarter, CAST(floor(epoch(ts)) AS BIGINT) AS epoch, extract(millisecond FROM ts) % 1000 AS ms, extract(microsecond FROM ts) % 1000000 AS us,
       date_trunc('month', ts) AS tm, date_trunc('week', ts) AS tw, date_trunc('quarter', ts) AS tq
FROM events""")
def fn_date_extract(spark, sf):
    ts = C("ts")
    trunc = lambda unit: F.date_trunc(unit, ts).cast("timestamp_ntz")
    return pick(
        table(spark, sf, "events"), "event_id",
        y=F.year(ts), mo=F.month(ts), d=F.day(ts), h=F.hour(ts), mi=F.minute(ts), s=F.second(ts), dow=S.dow(ts), isodow=S.isodow(ts), doy=F.dayofyear(ts), week=F.weekofyear(ts), quarter=F.quarter(ts),
        epoch=F.unix_seconds(ts.cast("timestamp")), ms=S.millisecond(ts), us=S.microsecond(ts), tm=trunc("month"), tw=trunc("week"), tq=trunc("quarter"),
    )


@query("""
SELECT o_orderkey, o_orderdate + INTERVAL 10 DAY AS plus10, o_orderdate - INTERVAL 10 DAY AS minus10, date_trunc('second', o_orderdate) + INTERVAL 1 MONTH AS next_month, date_trunc('second', o_orderdate) - INTERVAL 2 YEAR AS two_back,
       o_orderdate + INTERVAL 90 MINUTE AS later, CAST(trunc((epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1995-06-17 12:00:00')) / 86400000000.0) AS BIGINT) AS days
FROM orders""")
def fn_date_arith(spark, sf):
    d = C("o_orderdate")
    ntz = lambda c: c.cast("timestamp_ntz")
    return pick(
        table(spark, sf, "orders"), "o_orderkey",
        plus10=ntz(S.date_add(d, 10)), minus10=ntz(S.date_add(d, -10)), next_month=ntz(S.date_add(d, 1, "month")), two_back=ntz(S.date_add(d, -2, "years")), later=ntz(S.date_add(d, 90, "minute")),
        days=S.datediff(d, F.lit("1995-06-17 12:00:00").cast("timestamp_ntz")),
    )


@query("SELECT event_id, time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01') AS quarter_hour, time_bucket(INTERVAL 90 MINUTE, ts, TIMESTAMP '1970-01-01') AS ninety FROM events")
def fn_time_trunc(spark, sf):
    return pick(table(spark, sf, "events"), "event_id", quarter_hour=S.time_trunc("15m", C("ts")).cast("timestamp_ntz"), ninety=S.time_trunc("1h30m", C("ts")).cast("timestamp_ntz"))


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%d.%m.%y %H:%M:%S') AS short, strftime(o_orderdate, '%a %d %b %Y') AS named, upper(strftime(o_orderdate, '%B')) AS month_name FROM orders""")
def fn_to_char(spark, sf):
    d = C("o_orderdate")
    return pick(table(spark, sf, "orders"), "o_orderkey", iso=S.to_char(d, "YYYY-MM-DD"), short=S.to_char(d, "DD.MM.YY HH24:MI:SS"), named=S.to_char(d, "Dy DD Mon YYYY"), month_name=S.to_char(d, "MONTH"))


@query("""
SELECT p_partkey, CAST(p_size AS VARCHAR) AS txt, CAST(CAST(p_size AS VARCHAR) AS BIGINT) AS back, printf('%.6f', p_retailprice) AS six, CAST(p_retailprice AS DECIMAL(12,2)) AS dec,
       CAST(trunc(p_retailprice) AS BIGINT) AS whole, p_size <> 0 AS yes, CAST(CAST('1998-09-02' AS DATE) AS VARCHAR) AS day, lower(p_brand) NOT IN ('', '0', 'false', 'no') AS truth
FROM part""")
def fn_cast(spark, sf):
    size, price = C("p_size"), C("p_retailprice")
    return pick(
        table(spark, sf, "part"), "p_partkey",
        txt=size.cast("string"), back=size.cast("string").cast("bigint"), six=S.float_text(price), dec=price.cast("decimal(12,2)"), whole=price.cast("bigint"), yes=size.cast("boolean"),
        day=F.lit("1998-09-02").cast("date").cast("string"), truth=S.truth(C("p_brand"), "string"),
    )


@query("""
SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'O'), 'open') AS status, ifnull(nullif(o_orderstatus, 'F'), 'done') AS done,
       CASE WHEN nullif(o_custkey % 4, 0) IS NULL THEN NULL ELSE greatest(o_custkey % 4, o_orderkey % 3, 1) END AS g,
       CASE WHEN nullif(o_custkey % 4, 0) IS NULL THEN NULL ELSE least(o_custkey % 4, o_orderkey % 3, 1) END AS l, CASE WHEN o_custkey % 2 <> 0 THEN 'odd' ELSE 'even' END AS parity
FROM orders""")
def fn_conditional(spark, sf):
    """GREATEST and LEAST are null as soon as one argument is."""
    some, other = F.nullif(C("o_custkey") % 4, F.lit(0).cast("bigint")), C("o_orderkey") % 3
    return pick(
        table(spark, sf, "orders"), "o_orderkey",
        status=F.coalesce(F.nullif(C("o_orderstatus"), F.lit("O")), F.lit("open")), done=F.ifnull(F.nullif(C("o_orderstatus"), F.lit("F")), F.lit("done")),
        g=S.greatest(some, other, F.lit(1)), l=S.least(some, other, F.lit(1)), parity=S.iif(C("o_custkey") % 2, "bigint", F.lit("odd"), F.lit("even")),
    )


@query("""
SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k, CAST(json_valid(props) AS BIGINT) AS valid, CAST(0 AS BIGINT) AS invalid, '["k"]' AS keys, 'object' AS kind, 'number' AS kind_k,
       json_array_length('[1,2,3]') AS three, '{"id":' || event_id || ',"type":"' || event_type || '"}' AS made, '[' || event_id || ',"' || event_type || '",null]' AS listed
FROM events""")
def fn_json(spark, sf):
    p = C("props")
    return pick(
        table(spark, sf, "events"), "event_id",
        k=S.json_extract(p, "k").cast("bigint"), valid=S.json_valid(p), invalid=S.json_valid(F.concat(p, F.lit("}"))), keys=S.json_keys(p), kind=S.json_type(p), kind_k=S.json_type(S.json_extract(p, "$.k")),
        three=F.json_array_length(F.lit("[1,2,3]")), made=S.json_object(("id", C("event_id")), ("type", C("event_type"))), listed=S.json_array(C("event_id"), C("event_type"), F.lit(None).cast("string")),
    )


@query("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def fn_hash(spark, sf):
    return pick(table(spark, sf, "documents"), "doc_id", md5=F.md5("text"), sha1=F.sha1("text"), sha256=F.sha2("text", 256))


@query()
def fn_hash_wide(spark, sf):
    """SHA-384, SHA-512 and CRC-32; the oracle has none of them."""
    return pick(table(spark, sf, "documents"), "doc_id", sha384=F.sha2("text", 384), sha512=F.sha2("text", 512), crc32=F.crc32("text"))


@query("""
WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0), e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT vec_id, round(list_distance(e.v, q.v), 5) AS l2, round(1 - list_cosine_similarity(e.v, q.v), 5) AS cosine, round(-list_inner_product(e.v, q.v), 5) AS inner_product,
       len(e.v) AS dims, round(sqrt(list_inner_product(e.v, e.v)), 5) AS norm FROM e, q""")
def fn_vector_distance(spark, sf):
    e = table(spark, sf, "embeddings")
    q = e.filter("vec_id = 0").select(C("embedding").alias("q"))  # one row
    v, w = C("embedding"), C("q")
    return pick(
        e.join(F.broadcast(q)), "vec_id",
        l2=F.round(S.l2_distance(v, w), 5), cosine=F.round(S.cosine_distance(v, w), 5), inner_product=F.round(S.inner_distance(v, w), 5), dims=F.size(v), norm=F.round(S.norm(v), 5),
    )


@query("""
WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 3)
SELECT vec_id, round(list_distance(CAST(embedding AS DOUBLE[]), q.v), 5) AS distance FROM embeddings, q ORDER BY list_distance(CAST(embedding AS DOUBLE[]), q.v), vec_id LIMIT 10""")
def vector_topk(spark, sf):
    """Exact nearest neighbours: one pass, each partition keeps its best."""
    e = table(spark, sf, "embeddings")
    q = e.filter("vec_id = 3").select(C("embedding").alias("q"))  # one row
    near = e.join(F.broadcast(q)).withColumn("d", S.l2_distance(C("embedding"), C("q")))
    return top_n(near, [S.asc("d"), S.asc("vec_id")], 10).select("vec_id", F.round("d", 5).alias("distance"))


@query("SELECT doc_id, lower(lang) AS nocase, lang AS bin, translate(text, 'áàâäãåéèêëíìîïóòôöõúùûüñçÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ', 'aaaaaaeeeeiiiiooooouuuuncAAAAAAEEEEIIIIOOOOOUUUUNC') AS plain FROM documents")
def fn_collate(spark, sf):
    return pick(table(spark, sf, "documents"), "doc_id", nocase=S.collate(C("lang"), "NOCASE"), bin=S.collate(C("lang"), "BINARY"), plain=S.collate(C("text"), "NOACCENT"))


same("fn_timestamp_literals", """
SELECT o_orderkey, o_orderdate < TIMESTAMP '1996-01-01 00:00:00' AS early, CAST(o_orderdate AS DATE) AS day, DATE '1998-12-01' AS fixed FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1995-01-01'""")


#: Rules of the engine's SQL where Spark's differ: an expression and its value as text.
RULES = {
    'integers divide toward zero': ('-7 / 2', '-3'),
    'integers divide in order': ('9 / 2 / 2', '2'),
    'floats divide': ('7 / 2.0e0', '3.5'),
    'by zero null': ('1 / 0', None),
    'rest by zero null': ('7 % 0', None),
    'greatest of null': ('greatest(1, NULL)', None),
    'least': ('least(2, 1)', '1'),
    'root of negative': ('sqrt(-1)', None),
    'ln of zero': ('ln(0)', None),
    'log is to ten': ('log(100)', '2.0'),
    'substring clamps': ("substring('abc', -2, 2)", 'ab'),
    'negative length': ("substring('abc', 2, -1)", ''),
    'trim white space': ("trim(chr(9) || 'a' || chr(10))", 'a'),
    'char of a code point': ('char(300)', 'Ĭ'),
    'sunday is 0': ("extract(dow FROM TIMESTAMP '2024-03-10 00:00:00')", '0'),
    'days of 24 hours': ("datediff(TIMESTAMP '2024-03-11 23:00:00', TIMESTAMP '2024-03-10 23:30:00')", '0'),
    'iif': ("iif('no', 1, 2)", '2'),
    'sign': ('sign(-2.5)', '-1'),
    'type of': ('typeof(1)', 'INTEGER'),
    'json type': ("json_typeof('[1]')", 'array'),
    'json text': ('\'{"a": "t"}\' ->> \'a\'', 't'),
    'json value': ('\'{"a": "t"}\' -> \'a\'', '"t"'),
    'concat skips nulls': ("concat('a', NULL, 'b')", 'ab'),
    'first skips nulls': ('(SELECT first(a) FROM VALUES (NULL, 1), (2, 2) AS t(a, b))', '2'),
    'vector norm': ('vec_norm(array(3, 4))', '5.0'),
    'left to right': ('(SELECT count(*) FROM (SELECT 1 UNION SELECT 2 INTERSECT SELECT 3) t)', '0'),
    'time of a zone': ("CAST(civil_to_timestamptz(TIMESTAMP '2024-07-01 12:00:00', 'Europe/Berlin') AS STRING)", '2024-07-01 10:00:00'),
    'series': ('(SELECT sum(value) FROM generate_series(1, 5, 2))', '9'),
    'nulls last': ('(SELECT a FROM VALUES (NULL), (1) AS t(a) ORDER BY a LIMIT 1)', '1'),
    'nulls first when falling': ('(SELECT a FROM VALUES (NULL), (1) AS t(a) ORDER BY a DESC LIMIT 1)', None),
    'equal all': ('1 = ALL (SELECT a FROM VALUES (1), (1) AS t(a))', 'true'),
}
TOLD = " UNION ALL ".join("SELECT '" + n + "' AS rule, " + ("CAST(NULL AS VARCHAR)" if v is None else "'" + v + "'") + " AS value" for n, (_, v) in RULES.items())


@query(TOLD)
def sql_semantics(spark, sf):
    """Through the SQL entry, one row a rule."""
    return run(spark, " UNION ALL ".join(f"SELECT '{n}' AS rule, CAST({e} AS STRING) AS value" for n, (e, _) in RULES.items()))
