"""URL filters: host and path rules, and gradient-boosted trees on lexical features for all other URLs.

DataFrame operations only. The trees learn from labelled URLs: here those that a rule decides. Each
level of a tree is one aggregate of gradients by node, feature and bin; the finished trees are
CASE expressions that run in generated code.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Different labelled URLs the trees learn from, about: a bounded sample by hash of the URL, each with its number of rows.
TRAIN_ROWS = 20_000
ROUNDS, DEPTH, BINS, RATE, LEAST_HESS, RIDGE = 8, 3, 16, 0.4, 1.0, 1.0
#: A suffix has statistics of its own from so many sampled rows on; there are TRAIN_ROWS / SUFFIX_ROWS of them about.
SUFFIX_ROWS = 20
#: The letters that are lower-cased.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rule(verdict: str, text: str) -> Rule:
    host, slash, path = text.partition("/")
    return Rule(verdict, host, slash + path)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; a null URL and one without :// have both empty."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def first_rule(rules: list[Rule], host: Column, path: Column) -> Column:
    """The text of the longest rule that fits host or a parent domain of it, and begins the path; null if none."""
    out = None
    for r in sorted(set(rules), key=lambda r: (-len(r.text), -len(r.host), r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, r.text) if out is None else out.when(fits, r.text)
    return F.lit(None).cast("string") if out is None else out


def _suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Lexical features of a URL, all double."""
    url = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(url), F.lit(1))
    counts = F.transform(F.filter(F.array_distinct(F.split(url, "")), lambda c: c != ""), lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / n)
    entropy = F.aggregate(counts, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    query = F.substring_index(F.when(F.instr(url, "?") > 0, F.substring(url, F.instr(url, "?") + 1, F.length(url))).otherwise(""), "#", 1)
    parts = F.split(path, "/")
    out = {
        "length": F.length(url),
        "depth": F.size(F.filter(parts, lambda p: p != "")),
        "digits": F.regexp_count(url, F.lit("[0-9]")) / n,
        "entropy": entropy,
        "params": F.when(query == "", 0).otherwise(F.regexp_count(query, F.lit("&")) + 1),
        "labels": F.regexp_count(host, F.lit(r"\.")),
        "first_part": F.length(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))),
        "last_part": F.length(F.element_at(parts, -1)),
        "hyphens": F.regexp_count(url, F.lit("[-_]")),
    }
    return {k: v.cast("double") for k, v in out.items()}


@dataclass
class Trees:
    """base: log-odds of block; edges: bin borders of each feature; trees: nested (feature, bin, left, right) or a number."""

    base: float
    names: list[str]
    edges: list[list[float]]
    trees: list
    suffix: dict[str, float]

    def margin(self, bins: list[Column]) -> Column:
        return sum((_case(t, bins) for t in self.trees), F.lit(float(self.base)))

    def bins(self, values: list[Column]) -> list[Column]:
        return [sum(((v > F.lit(float(e))).cast("int") for e in own), F.lit(0)) for v, own in zip(values, self.edges, strict=True)]

    def suffix_rate(self, host: Column) -> Column:
        """Smoothed log-odds of block among the labelled URLs of the host's suffix."""
        if not self.suffix:
            return F.lit(float(self.base))
        table = F.create_map(*[F.lit(x) for kv in sorted(self.suffix.items()) for x in kv])
        return F.coalesce(F.try_element_at(table, _suffix(host)), F.lit(float(self.base)))


def _case(tree, bins: list[Column]) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    feature, cut, left, right = tree
    return F.when(bins[feature] <= cut, _case(left, bins)).otherwise(_case(right, bins))


def fit(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> Trees:
    """Trees from rows with url, host, path and label (1 block, 0 allow).

    With more than train_rows different URLs about that many are taken by hash, so the sample does
    not depend on how the table is dealt out, and a URL that very many rows repeat is one row with a
    weight. Without rows, or with one label only, there are no trees.
    """
    n = labelled.agg(F.approx_count_distinct("url", 0.02)).first()[0]
    if n > train_rows:
        labelled = labelled.where(F.pmod(F.xxhash64("url"), F.lit(1_000_000)) < int(1_000_000 * train_rows / n))
    labelled = labelled.groupBy("url", "host", "path", "label").agg(F.count(F.lit(1)).alias("w"))
    named = features(F.col("url"), F.col("host"), F.col("path"))
    sample = materialize(labelled.select(_suffix(F.col("host")).alias("suffix"), "label", "w", *[v.alias(k) for k, v in named.items()]), "urls")
    total, blocked = sample.agg(F.coalesce(F.sum("w"), F.lit(0)), F.coalesce(F.sum(F.col("label") * F.col("w")), F.lit(0))).first()
    base = log((blocked + 1) / (total - blocked + 1))
    if not total or blocked in (0, total):
        return Trees(base, [*named, "suffix"], [[] for _ in range(len(named) + 1)], [], {})
    own = sample.groupBy("suffix").agg(F.count(F.lit(1)).alias("urls"), F.sum("w").alias("n"), F.sum(F.col("label") * F.col("w")).alias("b"))
    stats = own.where(F.col("urls") >= SUFFIX_ROWS).collect()
    suffix = {r.suffix: log((r.b + 1) / (r.n - r.b + 1)) for r in stats}  # at most train_rows / SUFFIX_ROWS
    model = Trees(base, [*named, "suffix"], [], [], suffix)

    values = [F.col(k) for k in named]
    sample = sample.withColumn("rate", F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(suffix.items()) for x in kv]), F.col("suffix")), F.lit(base)) if suffix else F.lit(base))
    values.append(F.col("rate"))
    steps = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    borders = sample.agg(*[F.percentile(v, steps, F.col("w")).alias(f"e{i}") for i, v in enumerate(values)]).first()
    model.edges = [sorted(set(e)) for e in borders]
    # equal bins and labels are one row with a weight: a table of train_rows rows at most
    binned = sample.select("label", "w", *[b.cast("int").alias(f"b{i}") for i, b in enumerate(model.bins(values))])
    table = materialize(binned.groupBy(*(c for c in binned.columns if c != "w")).agg(F.sum("w").alias("w")), "bins").coalesce(1)
    cols = [F.col(f"b{i}") for i in range(len(values))]
    for _ in range(ROUNDS):
        tree = _grow(table, cols, model)
        if tree is None:
            break
        model.trees.append(tree)
    return model


def _grow(table: DataFrame, bins: list[Column], model: Trees):
    """One tree, level by level; None if no split gains."""
    p = 1 / (1 + F.exp(-model.margin(bins)))
    rows = table.withColumn("g", F.col("w") * (p - F.col("label"))).withColumn("h", F.col("w") * p * (1 - p))
    splits: dict[int, tuple[int, int]] = {}  # node (heap order) -> feature and bin
    sums: dict[int, tuple[float, float]] = {}
    for level in range(DEPTH):
        node = F.lit(1)
        for _ in range(level):
            node = _descend(node, splits, bins)
        pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), b.alias("b")) for i, b in enumerate(bins)])).alias("x")
        got = rows.select(node.alias("node"), "g", "h", pairs).where("node > 0").groupBy("node", "x.f", "x.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        hist: dict[int, dict[int, dict[int, tuple[float, float]]]] = {}
        for r in got:  # nodes times features times bins
            hist.setdefault(r.node, {}).setdefault(r.f, {})[r.b] = (r.g, r.h)
        for n, by_feature in sorted(hist.items()):
            g, h = (sum(v[i] for v in by_feature[0].values()) for i in (0, 1))
            sums[n] = (g, h)
            best = (1e-6, None)
            for f, by_bin in sorted(by_feature.items()):
                gl = hl = 0.0
                for b in sorted(by_bin)[:-1]:
                    gl, hl = gl + by_bin[b][0], hl + by_bin[b][1]
                    if min(hl, h - hl) < LEAST_HESS:
                        continue
                    gain = gl * gl / (hl + RIDGE) + (g - gl) ** 2 / (h - hl + RIDGE) - g * g / (h + RIDGE)
                    if gain > best[0] * (1 + 1e-9):
                        best = (gain, (f, b, gl, hl))
            if best[1]:
                f, b, gl, hl = best[1]
                splits[n], sums[2 * n], sums[2 * n + 1] = (f, b), (gl, hl), (g - gl, h - hl)
        if not any(n >= 1 << level for n in splits):
            break

    def build(n: int):
        if n in splits:
            return (*splits[n], build(2 * n), build(2 * n + 1))
        g, h = sums[n]
        return float(-RATE * g / (h + RIDGE))

    return build(1) if splits else None


def _descend(node: Column, splits: dict[int, tuple[int, int]], bins: list[Column]) -> Column:
    """The child of each node; 0 below a leaf."""
    out = F.lit(0)
    for n, (f, b) in splits.items():
        out = F.when(node == n, F.when(bins[f] <= b, 2 * n).otherwise(2 * n + 1)).otherwise(out)
    return out


def judge(pages: DataFrame, rules: list[Rule], url_col: str = "url", model: Trees | None = None) -> DataFrame:
    """pages with host, path, rule, verdict and score (probability of block; null where a rule decides).

    model: by default fitted on the rows that a rule decides. Columns of pages with these names are
    replaced; others may have any name but one beginning with _uf_. Defined cases: a null URL, or one
    without ://, has an empty host and path and is judged by the trees; without any labelled URL
    everything else is allowed; repeated rows are judged alike; an empty table gives no rows.
    """
    host, path = split_url(F.col(url_col))
    out = pages.withColumn("host", host).withColumn("path", path)
    out = out.withColumn("rule", first_rule(rules, F.col("host"), F.col("path")))
    decided = F.lit(None).cast("string")
    for r in rules:
        decided = F.when(F.col("rule") == r.text, r.verdict).otherwise(decided)
    if model is None:
        label = F.when(decided == "block", 1).otherwise(0).alias("label")
        model = fit(out.where(F.col("rule").isNotNull()).select(F.col(url_col).alias("url"), "host", "path", label))
    # features first, then bins, as columns of their own: the trees name a bin many times, and a bin its feature
    values = [*features(F.col(url_col), F.col("host"), F.col("path")).values(), model.suffix_rate(F.col("host"))]
    raw, names = ([f"_uf_{kind}_{i}" for i in range(len(values))] for kind in ("raw", "bin"))
    out = out.withColumns(dict(zip(raw, values, strict=True)))
    out = out.withColumns(dict(zip(names, model.bins([F.col(n) for n in raw]), strict=True)))
    margin = model.margin([F.col(n) for n in names])
    out = out.withColumn("score", F.when(F.col("rule").isNull(), 1 / (1 + F.exp(-margin))))
    by_trees = F.when(F.col("score") > 0.5, "block").otherwise("allow") if model.trees else F.lit("block" if model.base > 0 else "allow")
    return out.withColumn("verdict", F.coalesce(decided, by_trees)).drop(*raw, *names)


