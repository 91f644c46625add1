-- grouping sets, pivots, having, ordinals, empty input
SELECT a, b, sum(c) AS s, grouping_id() AS g FROM VALUES (1, 'x', 10), (1, 'y', 20), (2, 'x', 30) AS t(a, b, c) GROUP BY CUBE (a, b) ORDER BY g, a, b;
SELECT a, b, count(*) AS n FROM VALUES (1, NULL), (1, NULL), (2, 'x') AS t(a, b) GROUP BY ROLLUP (a, b) ORDER BY a, b, n;
SELECT a, count(*) AS n FROM VALUES (1, 2), (1, 3) AS t(a, b) GROUP BY GROUPING SETS ((a), ()) ORDER BY a;
SELECT count(*) AS n, sum(a) AS s, max(a) AS m FROM VALUES (1) AS t(a) WHERE a > 1;
SELECT a, count(*) AS n FROM VALUES (1) AS t(a) WHERE a > 1 GROUP BY a;
SELECT a % 2 AS k, sum(a) AS s FROM VALUES (1), (2), (3) AS t(a) GROUP BY 1 HAVING s > 2 ORDER BY k;
SELECT a, b FROM VALUES (1, 2) AS t(a, b) GROUP BY a;
SELECT * FROM VALUES ('q1', 1, 10), ('q2', 1, 20), ('q1', 2, 30) AS t(q, y, v) PIVOT (sum(v) FOR q IN ('q1' AS a, 'q2' AS b)) ORDER BY y;
SELECT * FROM (SELECT 1 AS k, 10 AS a, CAST(NULL AS INT) AS b) UNPIVOT (v FOR n IN (a, b));
SELECT * FROM (SELECT 1 AS k, 10 AS a, CAST(NULL AS INT) AS b) UNPIVOT INCLUDE NULLS (v FOR n IN (a, b)) ORDER BY n;
SELECT any_value(a) AS x, count_if(a > 1) AS c, every(a > 0) AS e, some(a > 2) AS o, mode(a) AS m FROM VALUES (2), (2), (1) AS t(a) HAVING count(*) = 3;
SELECT sum(a) AS s, avg(a) AS m, count(a) AS n, count(*) AS all FROM VALUES (1), (NULL), (3) AS t(a);
SELECT listagg(a, '-') WITHIN GROUP (ORDER BY a DESC) AS l FROM VALUES ('x'), ('z'), (NULL), ('y') AS t(a);
SELECT percentile_cont(0.5) WITHIN GROUP (ORDER BY a) AS c, percentile_disc(0.5) WITHIN GROUP (ORDER BY a) AS d FROM VALUES (1), (2), (10), (20) AS t(a);
