-- frames, ties and nulls in windows
SELECT id, sum(id) OVER (ORDER BY id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s FROM range(6) ORDER BY id;
SELECT id, sum(id) OVER (ORDER BY id % 3) AS s FROM range(6) ORDER BY id;
SELECT id, rank() OVER (ORDER BY id % 2) AS r, dense_rank() OVER (ORDER BY id % 2) AS d, row_number() OVER (ORDER BY id % 2, id) AS n FROM range(5) ORDER BY id;
SELECT v, first_value(v) IGNORE NULLS OVER (ORDER BY i) AS f, last_value(v) OVER (ORDER BY i) AS l FROM VALUES (1, NULL), (2, 'a'), (3, NULL), (4, 'b') AS t(i, v) ORDER BY i;
SELECT i, lag(v, 1, 'none') OVER (ORDER BY i) AS g, lead(v, 2) OVER (ORDER BY i) AS d FROM VALUES (1, 'x'), (2, NULL), (3, 'y') AS t(i, v) ORDER BY i;
SELECT i, count(v) OVER (PARTITION BY p ORDER BY i RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM VALUES ('a', 1, 1), ('a', 2, NULL), ('a', 4, 3), ('b', 1, 5) AS t(p, i, v) ORDER BY p, i;
SELECT ntile(3) OVER (ORDER BY id) AS t, cume_dist() OVER (ORDER BY id) AS c, percent_rank() OVER (ORDER BY id) AS p FROM range(7) ORDER BY id;
SELECT count(DISTINCT id) OVER () FROM range(3);
SELECT nth_value(id, 2) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS n FROM range(3);
SELECT sum(id) OVER w AS s FROM range(3) WINDOW w AS (ORDER BY id DESC) ORDER BY s;
SELECT row_number() OVER (ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) FROM range(2);
