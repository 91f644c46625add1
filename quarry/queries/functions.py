"""Scalar functions, one query for each family. Results that DuckDB types otherwise are cast on both sides."""

from __future__ import annotations

from .registry import Catalog

C = Catalog()


def _both(name: str, source: str, columns: list[tuple[str, str, str | None]]) -> None:
    """columns: alias, Spark expression, DuckDB expression (None: the same)."""
    spark = ", ".join(f"{s} AS {a}" for a, s, _ in columns)
    duck = ", ".join(f"{d or s} AS {a}" for a, s, d in columns)
    C.sql(name, f"SELECT {spark} FROM {source}", f"SELECT {duck} FROM {source}")


B = "CAST({} AS BIGINT)".format
_both("fn_str_case", "{part}", [
    ("p_partkey", "p_partkey", None), ("up", "upper(p_name)", None), ("lo", "lower(p_brand)", None), ("uc", "ucase(p_name)", "upper(p_name)"), ("lc", "lcase(p_brand)", "lower(p_brand)"),
    ("ini", "initcap(lower(p_type))", "array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"),
])
_both("fn_str_length", "{part}", [
    ("p_partkey", "p_partkey", None), ("n", B("length(p_name)"), None), ("cl", B("char_length(p_name)"), B("length(p_name)")), ("ol", B("octet_length(p_name)"), B("strlen(p_name)")),
    ("bl", B("bit_length(p_name)"), None), ("ln", B("len(p_brand)"), B("length(p_brand)")),
])
_both("fn_str_parts", "{customer}", [
    ("c_custkey", "c_custkey", None), ("s", "substring(c_name, 2, 3)", None), ("ss", "substr(c_name, -3)", "c_name[-3:]"), ("l", "left(c_name, 4)", None), ("r", "right(c_name, 4)", None),
    ("sp", "split_part(c_name, '#', 2)", None), ("si", "substring_index(c_name, '0', 3)", "array_to_string(string_split(c_name, '0')[1:3], '0')"), ("sf", "substring(c_mktsegment FROM 1 FOR 2)", "substring(c_mktsegment, 1, 2)"),
])
_both("fn_str_pad_trim", "{nation}", [
    ("n_nationkey", "n_nationkey", None), ("lp", "lpad(n_name, 12, '*')", None), ("rp", "rpad(n_name, 12, '-')", None), ("t", "trim('  x ')", None), ("lt", "ltrim('  x ')", None), ("rt", "rtrim('  x ')", None),
    ("bt", "btrim(n_name, 'N0')", "trim(n_name, 'N0')"), ("rep", "repeat('ab', n_regionkey + 1)", None), ("rev", "reverse(n_name)", None), ("sp", "concat('[', space(2), ']')", "'[  ]'"),
])
_both("fn_str_search", "{part}", [
    ("p_partkey", "p_partkey", None), ("i", B("instr(p_name, 'r')"), None), ("p", B("position('in' IN p_name)"), B("instr(p_name, 'in')")), ("l", B("locate('a', p_type)"), B("instr(p_type, 'a')")), ("c", "contains(p_name, 'red')", None),
    ("sw", "startswith(p_name, 's')", "starts_with(p_name, 's')"), ("ew", "endswith(p_name, 'ring')", "ends_with(p_name, 'ring')"), ("f", B("find_in_set(substr(p_type, 1, 1), 'E,S,P')"), B("CASE p_type[1:1] WHEN 'E' THEN 1 WHEN 'S' THEN 2 WHEN 'P' THEN 3 ELSE 0 END")),
])
_both("fn_str_build", "{nation}", [
    ("n_nationkey", "n_nationkey", None), ("c", "concat(n_name, '-', n_regionkey)", None), ("w", "concat_ws('/', n_name, NULL, 'z')", None), ("b", "n_name || '!'", None), ("f", "format_string('%s=%05d', n_name, n_nationkey)", "printf('%s=%05d', n_name, n_nationkey)"),
    ("e", "elt(2, 'a', n_name)", "n_name"), ("o", "overlay(n_name PLACING 'XX' FROM 2 FOR 3)", "n_name[1:1] || 'XX' || n_name[5:]"), ("r", "replace(n_name, 'NATION', 'N')", None), ("r2", "replace(n_name, '_')", "replace(n_name, '_', '')"), ("t", "translate(n_name, 'ANI', 'xyz')", None),
])
_both("fn_str_codes", "{nation}", [
    ("n_nationkey", "n_nationkey", None), ("a", B("ascii(n_name)"), None), ("c", "chr(65 + n_nationkey)", None), ("ch", "char(66)", "chr(66)"), ("h", "hex(n_name)", None), ("u", "CAST(unhex(hex(n_name)) AS STRING)", "n_name"), ("b64", "base64(encode(n_name, 'UTF-8'))", "to_base64(encode(n_name))"),
    ("m", "md5(n_name)", None), ("s2", "sha2(n_name, 256)", "sha256(n_name)"), ("s1", "sha1(n_name)", None), ("lv", B("levenshtein(n_name, 'NATION_1')"), None), ("d", "decode(encode(n_name, 'UTF-8'), 'UTF-8')", "n_name"),
])
_both("fn_str_misc", "{customer}", [
    ("c_custkey", "c_custkey", None), ("sx", "left(soundex(c_mktsegment), 1)", "c_mktsegment[1:1]"), ("mk", "mask(c_name, 'X', 'x', 'n')", "regexp_replace(regexp_replace(regexp_replace(c_name, '[a-z]', 'x', 'g'), '[A-Z]', 'X', 'g'), '[0-9]', 'n', 'g')"), ("luhn", "luhn_check(concat(c_custkey % 10, (10 - (c_custkey % 10) * 2 % 10 - (c_custkey % 10) * 2 DIV 10) % 10))", "true"),
    ("fn", "format_number(c_acctbal, 1)", "format('{:,.1f}', c_acctbal)"), ("valid", "is_valid_utf8(c_name)", "true"), ("sent", B("size(sentences(concat(c_name, '. And more.')))"), B("length(c_name) - length(c_name) + 2")),
    ("pf", "printf('%d%%', c_nationkey)", "c_nationkey || '%'"), ("col", "collation(c_name)", "'SYSTEM.BUILTIN.UTF8_BINARY'"), ("lcase_eq", "c_mktsegment COLLATE UTF8_LCASE = lower(c_mktsegment)", "true"),
])
_both("fn_re", "{customer}", [
    ("c_custkey", "c_custkey", None), ("x", "regexp_extract(c_name, '([A-Za-z]+)#0*([0-9]+)', 2)", None), ("r", "regexp_replace(c_name, '[0-4]+', '_')", "regexp_replace(c_name, '[0-4]+', '_', 'g')"), ("c", B("regexp_count(c_name, '[1-9]')"), B("len(regexp_extract_all(c_name, '[1-9]'))")),
    ("l", "regexp_like(c_name, '[13579]$')", "regexp_matches(c_name, '[13579]$')"), ("k", "c_mktsegment RLIKE '^[A-H]'", "regexp_matches(c_mktsegment, '^[A-H]')"), ("g", "regexp(c_name, '0{7}')", "regexp_matches(c_name, '0{7}')"),
    ("a", "array_join(regexp_extract_all(c_name, '([1-9])', 1), ',')", "array_to_string(regexp_extract_all(c_name, '([1-9])', 1), ',')"), ("s", "regexp_substr(c_name, '[1-9]+')", "nullif(regexp_extract(c_name, '[1-9]+'), '')"),
    ("i", B("regexp_instr(c_name, '[1-9]')"), B("CASE WHEN regexp_matches(c_name, '[1-9]') THEN length(regexp_extract(c_name, '^[^1-9]*')) + 1 ELSE 0 END")),
])
_both("fn_date_parts", "{orders}", [
    ("o_orderkey", "o_orderkey", None), *[(p, B(f"{p}(o_orderdate)"), None) for p in ("year", "quarter", "month", "day", "hour", "minute")], ("doy", B("dayofyear(o_orderdate)"), None), ("dow", B("dayofweek(o_orderdate)"), B("dayofweek(o_orderdate) + 1")), ("wd", B("weekday(o_orderdate)"), B("isodow(o_orderdate) - 1")),
    ("woy", B("weekofyear(o_orderdate)"), None), ("ex", B("extract(YEAR FROM o_orderdate)"), None), ("dp", B("date_part('month', o_orderdate)"), None),
])
_both("fn_date_arithmetic", "{orders}", [
    ("o_orderkey", "o_orderkey", None), ("a", "date_add(CAST(o_orderdate AS DATE), 10)", "CAST(o_orderdate AS DATE) + 10"), ("s", "date_sub(CAST(o_orderdate AS DATE), 3)", "CAST(o_orderdate AS DATE) - 3"), ("m", "add_months(CAST(o_orderdate AS DATE), 2)", "CAST(CAST(o_orderdate AS DATE) + INTERVAL 2 MONTH AS DATE)"),
    ("d", B("datediff(o_orderdate, DATE '1995-01-01')"), B("datediff('day', DATE '1995-01-01', o_orderdate)")), ("l", "last_day(o_orderdate)", None), ("n", "next_day(CAST(o_orderdate AS DATE), 'Monday')", "CAST(o_orderdate AS DATE) + CAST(8 - isodow(o_orderdate) AS INTEGER)"),
    ("t", "trunc(CAST(o_orderdate AS DATE), 'MONTH')", "CAST(date_trunc('month', o_orderdate) AS DATE)"), ("i", "CAST(o_orderdate + INTERVAL '1' MONTH AS DATE)", "CAST(o_orderdate + INTERVAL 1 MONTH AS DATE)"),
])
_both("fn_date_trunc", "{events}", [
    ("event_id", "event_id", None), *[(u, f"CAST(date_trunc('{u}', ts) AS TIMESTAMP_NTZ)", f"date_trunc('{u}', ts)") for u in ("hour", "day", "week", "month")],
])
_both("fn_date_format", "{events}", [
    ("event_id", "event_id", None), ("f", "date_format(ts, 'yyyy-MM-dd HH:mm')", "strftime(ts, '%Y-%m-%d %H:%M')"), ("u", "unix_timestamp(CAST(ts AS TIMESTAMP))", B("epoch(ts)").replace("epoch(ts)", "floor(epoch(ts))")), ("us", "unix_micros(CAST(ts AS TIMESTAMP))", "epoch_us(ts)"), ("ms", "unix_millis(CAST(ts AS TIMESTAMP))", "epoch_us(ts) // 1000"),
    ("fu", "from_unixtime(event_id * 1000, 'yyyy-MM-dd HH:mm:ss')", "strftime(to_timestamp(event_id * 1000) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S')"), ("ud", B("unix_date(CAST(ts AS DATE))"), B("datediff('day', DATE '1970-01-01', ts)")),
])
_both("fn_date_make", "{nation}", [
    ("n_nationkey", "n_nationkey", None), ("d", "make_date(2020, 1 + n_regionkey, 15)", None), ("t", "make_timestamp_ntz(2020, 1, 1 + n_nationkey, 10, 20, 30)", "make_timestamp(2020, 1, 1 + n_nationkey, 10, 20, 30)"), ("p", "to_date('2021-03-04')", "DATE '2021-03-04'"), ("q", "to_timestamp_ntz('2021-03-04 05:06:07')", "TIMESTAMP '2021-03-04 05:06:07'"),
    ("x", "try_to_timestamp('nope', 'yyyy') IS NULL", "true"), ("df", "date_from_unix_date(n_nationkey * 100)", "DATE '1970-01-01' + n_nationkey * 100"), ("ts", "CAST(timestamp_seconds(n_nationkey) AS STRING)", "strftime(to_timestamp(n_nationkey) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S')"),
    ("dy", "date_diff(DATE '2021-01-31', DATE '2021-01-01') = 30", "true"), ("ad", "dateadd(DATE '2021-01-01', 5)", "DATE '2021-01-06'"),
])
_both("fn_date_interval", "{region}", [
    ("r_regionkey", "r_regionkey", None), ("ym", "CAST(make_ym_interval(1, 2) AS STRING)", "'INTERVAL ''1-2'' YEAR TO MONTH'"), ("dt", "CAST(make_dt_interval(1, 2, 3, 4) AS STRING)", "'INTERVAL ''1 02:03:04'' DAY TO SECOND'"), ("mi", "CAST(make_interval(0, 1, 0, 2) AS STRING)", "'1 months 2 days'"),
    ("tz", "CAST(convert_timezone('UTC', 'Asia/Tokyo', TIMESTAMP_NTZ '2021-01-01 00:00:00') AS STRING)", "'2021-01-01 09:00:00'"), ("lt", "localtimestamp() IS NOT NULL AND current_date() IS NOT NULL AND now() IS NOT NULL", "true"),
])
_both("fn_math_basic", "{supplier}", [
    ("s_suppkey", "s_suppkey", None), ("a", "abs(s_acctbal)", None), ("c", B("ceil(s_acctbal)"), None), ("f", B("floor(s_acctbal)"), None), ("r", "round(s_acctbal, 1)", None), ("ri", B("round(s_suppkey, -1)"), None), ("br", "bround(2.5D, 0)", "2.0::DOUBLE"), ("s", "sign(s_acctbal)", "CAST(sign(s_acctbal) AS DOUBLE)"), ("sg", "signum(s_acctbal)", "CAST(sign(s_acctbal) AS DOUBLE)"),
    ("m", B("mod(s_suppkey, 7)"), None), ("pm", B("pmod(-s_suppkey, 7)"), B("((-s_suppkey % 7) + 7) % 7")), ("dv", "s_suppkey DIV 3", "s_suppkey // 3"), ("g", "greatest(s_suppkey, 5)", None), ("l", "least(s_suppkey, 5)", None), ("ng", "negative(s_suppkey)", "-s_suppkey"), ("po", "positive(s_suppkey)", "s_suppkey"), ("cs", "CAST(ceil(3.14159, 2) AS DOUBLE)", "3.15::DOUBLE"),
])
_both("fn_math_transcendental", "{nation}", [
    ("n_nationkey", "n_nationkey", None), *[(f, f"round({f}(n_nationkey / 10.0D), 6)", f"round({f}(n_nationkey / 10.0::DOUBLE), 6)") for f in ("exp", "sqrt", "cbrt", "sin", "cos", "tan", "atan", "sinh", "cosh", "tanh", "asinh", "radians", "degrees")],
    *[(f, f"round({f}(n_nationkey + 1.5D), 6)", f"round({f}(n_nationkey + 1.5::DOUBLE), 6)") for f in ("ln", "log10", "log2", "acosh")], ("ath", "round(atanh(0.5D), 6)", "round(atanh(0.5), 6)"), ("p", "round(power(n_nationkey, 1.5D), 4)", "round(power(n_nationkey, 1.5::DOUBLE), 4)"), ("at2", "round(atan2(n_nationkey, 3), 6)", None), ("lg", "round(log(3, n_nationkey + 1.0D), 6)", "round(ln(n_nationkey + 1.0::DOUBLE) / ln(3.0), 6)"),
    ("pi", "round(pi(), 6)", None), ("ct", "round(cot(1.0D), 6)", "round(cot(1.0::DOUBLE), 6)"), ("sc", "round(sec(1.0D), 6)", "round(1 / cos(1.0::DOUBLE), 6)"), ("cc", "round(csc(1.0D), 6)", "round(1 / sin(1.0::DOUBLE), 6)"), ("hy", "round(hypot(3, n_nationkey), 6)", "round(sqrt(9 + n_nationkey * n_nationkey::DOUBLE), 6)"), ("fc", "factorial(n_regionkey)", "CAST(factorial(n_regionkey) AS BIGINT)"),
    ("wb", B("width_bucket(n_nationkey, 0, 25, 5)"), B("n_nationkey // 5 + 1")), ("nv", "nanvl(CAST('NaN' AS DOUBLE), 1.0D)", "1.0::DOUBLE"),
])
_both("fn_bits", "{nation}", [
    ("n_nationkey", "n_nationkey", None), ("a", "n_nationkey & 6", None), ("o", "n_nationkey | 6", None), ("x", "n_nationkey ^ 6", "xor(n_nationkey, 6)"), ("nt", "~n_nationkey", None), ("sl", "shiftleft(n_nationkey, 2)", "n_nationkey * 4"), ("sr", "shiftright(n_nationkey, 1)", "n_nationkey >> 1"), ("su", "shiftrightunsigned(n_nationkey, 1)", "n_nationkey >> 1"),
    ("c", B("bit_count(n_nationkey)"), None), ("g", B("getbit(n_nationkey, 0)"), B("n_nationkey & 1")), ("b", "bin(n_nationkey)", "bin(n_nationkey)"),
])
_both("fn_conv", "{customer}", [
    ("c_custkey", "c_custkey", None), ("c", "conv(c_custkey, 10, 16)", "printf('%X', c_custkey)"), ("h", "hex(c_custkey)", "printf('%X', c_custkey)"), ("tn", "CAST(to_number(concat('1,', lpad(c_nationkey, 3, '0'), '.5'), '9,999.9') AS DOUBLE)", "1000 + c_nationkey + 0.5::DOUBLE"),
    ("ttn", "try_to_number(c_mktsegment, '999') IS NULL", "true"), ("tc", "to_char(c_nationkey + 100, '$999')", "'$' || (c_nationkey + 100)"), ("tv", "to_varchar(c_nationkey + 0.25BD, '000.99')", "lpad(CAST(c_nationkey AS VARCHAR), 3, '0') || '.25'"),
    ("tb", "CAST(to_binary(hex(c_name), 'hex') AS STRING)", "c_name"), ("ttb", "try_to_binary(c_name, 'hex') IS NULL", "true"), ("ty", "typeof(c_acctbal)", "'double'"), ("i", "int(right(c_name, 3))", "CAST(c_name[-3:] AS INTEGER)"), ("bg", "bigint(right(c_name, 4))", "CAST(c_name[-4:] AS BIGINT)"),
    ("sm", B("smallint(c_nationkey)"), B("c_nationkey")), ("ti", B("tinyint(c_nationkey)"), B("c_nationkey")), ("db", "double(CAST(c_acctbal AS STRING))", "c_acctbal"), ("fl", "round(CAST(float(c_nationkey) AS DOUBLE), 1)", "CAST(c_nationkey AS DOUBLE)"), ("bo", "boolean(c_nationkey % 2)", "c_nationkey % 2 = 1"),
    ("st", "string(c_nationkey)", "CAST(c_nationkey AS VARCHAR)"), ("dt", "date(concat('2020-02-', lpad(c_nationkey + 1, 2, '0')))", "DATE '2020-02-01' + c_nationkey"), ("ts", "CAST(timestamp(concat('2020-02-03 ', lpad(c_nationkey % 24, 2, '0'), ':00:00')) AS STRING)", "'2020-02-03 ' || lpad(CAST(c_nationkey % 24 AS VARCHAR), 2, '0') || ':00:00'"),
    ("bi", "CAST(binary(c_name) AS STRING)", "c_name"), ("de", "CAST(decimal(c_nationkey) AS BIGINT)", B("c_nationkey")), ("rd", "random() < 1 AND random(3) >= 0", "true"), ("nu", "isnull(nullif(c_nationkey, 3))", "c_nationkey = 3"),
])
_both("fn_cond", "{nation}", [
    ("n_nationkey", "n_nationkey", None), ("i", "if(n_regionkey > 2, 'a', 'b')", "CASE WHEN n_regionkey > 2 THEN 'a' ELSE 'b' END"), ("c", "coalesce(nullif(n_regionkey, 0), -1)", None), ("n", "nvl(nullif(n_regionkey, 1), 9)", "coalesce(nullif(n_regionkey, 1), 9)"), ("n2", "nvl2(nullif(n_regionkey, 1), 'x', 'y')", "CASE WHEN n_regionkey <> 1 THEN 'x' ELSE 'y' END"), ("nz", "nullifzero(n_regionkey)", "nullif(n_regionkey, 0)"), ("zn", "zeroifnull(nullif(n_regionkey, 1))", "coalesce(nullif(n_regionkey, 1), 0)"), ("en", "equal_null(n_regionkey, NULL)", "false"),
    ("inn", "isnotnull(n_regionkey)", "true"), ("ifn", "ifnull(NULL, n_regionkey)", "n_regionkey"), ("dec", "decode(n_regionkey, 0, 'zero', 1, 'one', 'many')", "CASE n_regionkey WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE 'many' END"), ("at", "assert_true(n_nationkey >= 0) IS NULL", "true"),
])
_both("fn_try", "{nation}", [
    ("n_nationkey", "n_nationkey", None), ("a", "try_add(2147483647, n_nationkey)", "CASE WHEN n_nationkey = 0 THEN 2147483647 END"), ("s", "try_subtract(n_nationkey, 1)", "n_nationkey - 1"), ("m", "try_multiply(n_nationkey, 2)", "n_nationkey * 2"), ("d", "try_divide(n_nationkey, n_regionkey)", "CASE WHEN n_regionkey <> 0 THEN n_nationkey / n_regionkey END"), ("r", "try_mod(n_nationkey, n_regionkey)", "CASE WHEN n_regionkey <> 0 THEN n_nationkey % n_regionkey END"), ("c", "try_cast('x1' AS INT)", "CAST(NULL AS INTEGER)"), ("e", "try_element_at(array(1, 2), n_regionkey + 1)", "CASE n_regionkey WHEN 0 THEN 1 WHEN 1 THEN 2 END"),
    ("u", "try_url_decode('%zz') IS NULL", "true"),
])
_N, _L = "array(n_regionkey, n_nationkey, n_regionkey)", "[n_regionkey, n_nationkey, n_regionkey]"
_both("fn_array", "{nation}", [
    ("n_nationkey", "n_nationkey", None), ("sz", B(f"array_size({_N})"), B(f"len({_L})")), ("ct", "array_contains(array(1, 2, 3), n_regionkey)", "list_contains([1, 2, 3], n_regionkey)"), ("ds", B(f"size(array_distinct({_N}))"), B(f"len(list_distinct({_L}))")), ("p", B(f"array_position({_N}, n_nationkey)"), B(f"list_position({_L}, n_nationkey)")),
    ("so", f"array_join(sort_array({_N}, false), ',')", f"array_to_string(list_reverse_sort({_L}), ',')"), ("sl", f"array_join(slice({_N}, 2, 2), ',')", f"array_to_string(({_L})[2:3], ',')"), ("mx", "array_max(array(n_nationkey, 3))", "greatest(n_nationkey, 3)"), ("mn", "array_min(array(n_nationkey, 3))", "least(n_nationkey, 3)"),
    ("un", "array_join(sort_array(array_union(array(1, n_regionkey), array(n_nationkey, 2))), ',')", "array_to_string(list_sort(list_distinct([1, n_regionkey, n_nationkey, 2])), ',')"), ("it", "array_join(sort_array(array_intersect(array(1, 2, 3), array(n_regionkey, n_nationkey))), ',')", "array_to_string(list_sort(list_intersect([1, 2, 3], [n_regionkey, n_nationkey])), ',')"),
    ("ex", "array_join(array_except(array(1, 2, 3, 4), array(n_regionkey)), ',')", "array_to_string(list_filter([1, 2, 3, 4], lambda x: x <> n_regionkey), ',')"), ("ov", "arrays_overlap(array(1, 2), array(n_regionkey, n_nationkey))", "list_has_any([1, 2], [n_regionkey, n_nationkey])"), ("ap", "array_join(array_append(array(1), n_regionkey), '-')", "'1-' || n_regionkey"), ("pp", "array_join(array_prepend(array(1), n_nationkey), '-')", "n_nationkey || '-1'"),
    ("ins", "array_join(array_insert(array(1, 3), 2, n_nationkey), '-')", "'1-' || n_nationkey || '-3'"), ("cm", B("size(array_compact(array(1, nullif(n_regionkey, 2), 2)))"), B("CASE WHEN n_regionkey = 2 THEN 2 ELSE 3 END")), ("rm", f"array_join(array_remove({_N}, n_regionkey), '')", "CASE WHEN n_nationkey = n_regionkey THEN '' ELSE CAST(n_nationkey AS VARCHAR) END"), ("rp", "array_join(array_repeat(n_name, n_regionkey), '')", "repeat(n_name, n_regionkey)"),
    ("fl", f"array_join(flatten(array(array(n_regionkey), {_N})), ',')", f"array_to_string(flatten([[n_regionkey], {_L}]), ',')"), ("sq", "array_join(sequence(1, n_nationkey + 1, 2), ',')", "array_to_string(range(1, n_nationkey + 2, 2), ',')"), ("el", f"element_at({_N}, -2)", "n_nationkey"), ("ge", f"get({_N}, n_nationkey)", f"({_L})[n_nationkey + 1]"), ("rv", "array_join(reverse(array(n_regionkey, n_nationkey)), ',')", "n_nationkey || ',' || n_regionkey"), ("zp", "arrays_zip(array(1, n_nationkey), array(n_regionkey))[1]['0']", "n_nationkey"),
])
_both("fn_hof", "{nation}", [
    ("n_nationkey", "n_nationkey", None), ("t", "array_join(transform(sequence(0, n_regionkey), x -> x * 2), ',')", "array_to_string(list_transform(range(0, n_regionkey + 1), lambda x: x * 2), ',')"), ("f", "array_join(filter(sequence(0, 9), x -> x % 2 = n_regionkey % 2), '')", "array_to_string(list_filter(range(0, 10), lambda x: x % 2 = n_regionkey % 2), '')"), ("e", "exists(array(1, 2, 3), x -> x = n_regionkey)", "list_contains([1, 2, 3], n_regionkey)"), ("fa", "forall(array(1, 2, 3), x -> x > n_regionkey)", "n_regionkey < 1"), ("a", "aggregate(sequence(1, n_regionkey + 1), 0, (s, x) -> s + x)", "CAST((n_regionkey + 1) * (n_regionkey + 2) // 2 AS INTEGER)"), ("rd", "reduce(array(1, 2), n_nationkey, (s, x) -> s + x)", "n_nationkey + 3"),
    ("z", "array_join(zip_with(array(1, 2), array(3, 4), (x, y) -> x * y), ',')", "'3,8'"), ("so", "array_join(array_sort(array(3, 1, 2), (x, y) -> y - x), '')", "'321'"), ("tk", "array_join(map_keys(transform_keys(map(1, 2), (k, v) -> k + n_regionkey)), '')", "CAST(1 + n_regionkey AS VARCHAR)"), ("tv", "array_join(map_values(transform_values(map(1, 2), (k, v) -> v * 5)), '')", "'10'"), ("mf", B("size(map_filter(map(1, 2, 3, 4), (k, v) -> v > 2))"), "CAST(1 AS BIGINT)"), ("mz", "map_zip_with(map(1, 2), map(1, 3), (k, x, y) -> x + y)[1]", "5"),
])
_both("fn_map_struct", "{nation}", [
    ("n_nationkey", "n_nationkey", None), ("m", "map('a', n_nationkey, 'b', n_regionkey)['b']", "n_regionkey"), ("k", "array_join(sort_array(map_keys(map('b', 1, 'a', 2))), '')", "'ab'"), ("v", "array_join(map_values(map('b', 1)), '')", "'1'"), ("ck", "map_contains_key(map('a', 1), 'a')", "true"), ("mc", B("size(map_concat(map(1, 2), map(3, 4)))"), "CAST(2 AS BIGINT)"), ("fa", "map_from_arrays(array('x'), array(n_nationkey))['x']", "n_nationkey"), ("fe", "map_from_entries(array(struct('x', n_nationkey)))['x']", "n_nationkey"), ("s2m", "str_to_map('a:1,b:2', ',', ':')['b']", "'2'"), ("me", B("size(map_entries(map(1, 2)))"), "CAST(1 AS BIGINT)"),
    ("s", "struct(n_nationkey AS a, n_name AS b).b", "n_name"), ("ns", "named_struct('x', n_regionkey).x", "n_regionkey"), ("ea", "element_at(map('q', n_nationkey), 'q')", "n_nationkey"),
])
_both("fn_json", "{events}", [
    ("event_id", "event_id", None), ("g", "get_json_object(props, '$.k')", "json_extract_string(props, '$.k')"), ("f", "from_json(props, 'k INT').k", "CAST(json_extract(props, '$.k') AS INTEGER)"), ("t", "to_json(named_struct('a', event_id, 'b', event_type))", "'{\"a\":' || event_id || ',\"b\":\"' || event_type || '\"}'"), ("ks", "array_join(json_object_keys(props), ',')", "array_to_string(json_keys(props), ',')"), ("n", B("json_array_length('[1,2,3]')"), "CAST(3 AS BIGINT)"), ("so", "schema_of_json('{\"a\":1}')", "'STRUCT<a: BIGINT>'"), ("v", "CAST(variant_get(parse_json(props), '$.k', 'int') AS BIGINT)", "CAST(json_extract(props, '$.k') AS BIGINT)"),
])
_both("fn_csv_xml", "{region}", [
    ("r_regionkey", "r_regionkey", None), ("c", "from_csv(concat(r_regionkey, ',x'), 'a INT, b STRING').a", "r_regionkey"), ("t", "to_csv(struct(r_regionkey, r_name))", "r_regionkey || ',' || r_name"), ("s", "schema_of_csv('1,abc')", "'STRUCT<_c0: INT, _c1: STRING>'"), ("x", "from_xml(concat('<r><a>', r_regionkey, '</a></r>'), 'a INT').a", "r_regionkey"), ("xp", "xpath_string('<a><b>q</b></a>', 'a/b')", "'q'"), ("tx", "replace(replace(to_xml(named_struct('a', r_regionkey)), '\n', ''), ' ', '')", "'<ROW><a>' || r_regionkey || '</a></ROW>'"), ("sx", "schema_of_xml('<p><a>1</a></p>')", "'STRUCT<a: BIGINT>'"),
])
_both("fn_url", "{pages}", [
    ("page_id", "page_id", None), ("h", "parse_url(url, 'HOST')", "regexp_extract(url, '://([^/?#]*)', 1)"), ("p", "parse_url(url, 'PROTOCOL')", "regexp_extract(url, '^([a-z]+)://', 1)"), ("pa", "parse_url(url, 'PATH')", "regexp_extract(url, '://[^/?#]*([^?#]*)', 1)"), ("q", "parse_url(url, 'QUERY')", "nullif(regexp_extract(url, '\\?([^#]*)', 1), '')"), ("qk", "parse_url(url, 'QUERY', 'page')", "nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '')"), ("r", "parse_url(url, 'REF')", "nullif(regexp_extract(url, '#(.*)$', 1), '')"), ("e", "url_encode('a b&c')", "'a+b%26c'"), ("d", "url_decode('a+b%26c')", "'a b&c'"),
])
_both("fn_embedding_math", "{embeddings}", [
    ("vec_id", "vec_id", None), ("d", B("size(embedding)"), B("len(embedding)")), ("n2", "round(aggregate(transform(embedding, x -> CAST(x AS DOUBLE) * x), 0D, (a, x) -> a + x), 4)", "round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 4)"),
])
C.sql("fn_random_shape", "SELECT count(*) AS n FROM {nation} WHERE rand(1) BETWEEN 0 AND 1 AND randn(1) IS NOT NULL AND length(randstr(5, 1)) = 5 AND uniform(1, 9, 1) BETWEEN 1 AND 9 AND length(uuid()) = 36", "SELECT count(*) AS n FROM nation")
C.sql("fn_session", "SELECT current_catalog() AS c, current_database() AS d, current_schema() AS s", "SELECT 'spark_catalog' AS c, 'default' AS d, 'default' AS s")
C.sql("fn_reflect", "SELECT try_reflect('java.lang.Math', 'abs', -3) AS a, count(*) > 100 AS k FROM sql_keywords()", "SELECT '3' AS a, true AS k")
C.sql("fn_hash", "SELECT l_returnflag, count(DISTINCT hash(l_partkey)) AS h, count(DISTINCT xxhash64(l_partkey, l_suppkey)) AS x, count(DISTINCT crc32(CAST(l_orderkey AS STRING))) AS c FROM {lineitem} GROUP BY l_returnflag",
      "SELECT l_returnflag, count(DISTINCT l_partkey) AS h, count(DISTINCT (l_partkey, l_suppkey)) AS x, count(DISTINCT l_orderkey) AS c FROM {lineitem} GROUP BY l_returnflag")
