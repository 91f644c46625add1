-- nulls in IN, NOT IN, EXISTS and scalar subqueries
SELECT 1 IN (1, NULL) AS a, 2 IN (1, NULL) AS b, 2 NOT IN (1, NULL) AS c, NULL IN (1, 2) AS d;
SELECT i FROM VALUES (1), (2), (NULL) AS t(i) WHERE i NOT IN (SELECT j FROM VALUES (1), (NULL) AS u(j));
SELECT i FROM VALUES (1), (2), (NULL) AS t(i) WHERE i NOT IN (SELECT j FROM VALUES (1) AS u(j)) ORDER BY i;
SELECT i FROM VALUES (1), (2), (NULL) AS t(i) WHERE i NOT IN (SELECT j FROM VALUES (1) AS u(j) WHERE j > 5) ORDER BY i;
SELECT i FROM VALUES (1), (2), (NULL) AS t(i) WHERE i IN (SELECT j FROM VALUES (1), (NULL) AS u(j));
SELECT i FROM VALUES (1), (2), (NULL) AS t(i) WHERE NOT EXISTS (SELECT 1 FROM VALUES (1), (NULL) AS u(j) WHERE j = i) ORDER BY i;
SELECT i FROM VALUES (1), (NULL) AS t(i) WHERE EXISTS (SELECT 1 FROM VALUES (NULL) AS u(j) WHERE j <=> i);
SELECT (SELECT max(j) FROM VALUES (1), (5) AS u(j) WHERE j < i) AS m FROM VALUES (3), (1) AS t(i) ORDER BY i;
SELECT (SELECT j FROM VALUES (1), (2) AS u(j));
SELECT (SELECT j FROM VALUES (1) AS u(j) WHERE j > 1) AS none;
SELECT i FROM VALUES (1), (2), (3) AS t(i) WHERE (i, i + 1) IN (SELECT a, b FROM VALUES (1, 2), (3, 5) AS u(a, b));
SELECT t.i, u.n FROM VALUES (1), (2) AS t(i), LATERAL (SELECT count(*) AS n FROM VALUES (1), (1), (2) AS v(j) WHERE j = t.i) u ORDER BY 1;
SELECT i FROM VALUES (1), (2) AS t(i) WHERE i > ALL (SELECT 1);
