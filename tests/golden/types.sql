-- casts, arithmetic, dates, strings and their errors
SELECT CAST('12' AS INT) AS a, try_cast('x' AS INT) AS b, CAST(1.9 AS INT) AS c, CAST('2020-02-30' AS DATE);
SELECT try_cast('2020-02-30' AS DATE) AS a, CAST('2020-02-29' AS DATE) AS b, DATE '2020-01-31' + INTERVAL 1 MONTH AS c;
SELECT 5 / 2 AS a, 5 DIV 2 AS b, -5 % 3 AS c, pmod(-5, 3) AS d, 1.0BD / 3 AS e;
SELECT 2147483647 + 1;
SELECT try_add(2147483647, 1) AS a, CAST(2147483647 AS BIGINT) + 1 AS b;
SELECT CAST(300 AS TINYINT);
SELECT '10' + 5 AS a, '1.5' * 2 AS b, concat('a', NULL) AS c, concat_ws('-', 'a', NULL, 'b') AS d;
SELECT NULL = NULL AS a, NULL <=> NULL AS b, 1 <=> NULL AS c, NULL AND false AS d, NULL OR true AS e;
SELECT substring('abc', 0, 2) AS a, substring('abc', -2) AS b, left('abc', 5) AS c, split('a,b,,c', ',') AS d, instr('abc', 'z') AS e;
SELECT array(1, 2)[5];
SELECT get(array(1, 2), 5) AS a, element_at(array(1, 2), -1) AS b, try_element_at(array(1, 2), 9) AS c, map('a', 1)['b'] AS d;
SELECT timestampdiff(MONTH, TIMESTAMP_NTZ '2020-01-31 00:00:00', TIMESTAMP_NTZ '2020-02-29 00:00:00') AS a, date_trunc('quarter', TIMESTAMP_NTZ '2020-05-17 10:00:00') AS b, dayofweek(DATE '2020-05-17') AS c;
SELECT round(2.5) AS a, bround(2.5) AS b, round(-1.55BD, 1) AS c, ceil(-0.5) AS d, sign(-3) AS e;
SELECT 'a' LIKE 'A' AS a, 'a' ILIKE 'A' AS b, 'a_b' LIKE 'a\\_b' AS c, 'ab' RLIKE '^a.$' AS d, 'ab' LIKE ANY ('x%', 'a%') AS e;
SELECT from_json('{"a": 1, "b": [1, 2]}', 'a INT, b ARRAY<INT>') AS j, to_json(struct(1 AS x, NULL AS y)) AS k, get_json_object('{"a": {"b": 2}}', '$.a.b') AS p;
SELECT hex(encode('é', 'UTF-8')) AS a, length('é') AS b, octet_length('é') AS c, upper('straße') AS d, initcap('ab cd') AS e;
SELECT typeof(1 + 1L) AS a, typeof(1 + 1.0BD) AS b, typeof(CAST(1 AS FLOAT) + 1L) AS c, typeof(array(1, 2L)) AS d, typeof(coalesce(1, 2.0D)) AS e;
