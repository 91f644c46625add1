"""Jaccard join, line dedup, decontamination and passages against brute force, with the awkward inputs."""

from __future__ import annotations

import hashlib
import random
import re
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import decontaminate, jaccard, linededup, passages

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, cls string, key int, _id int"  # extra columns with names the operators use inside


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)


def words(rng, n, vocab=3000):
    return [f"w{rng.randrange(vocab)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """Exact and near copies, a chain of copies, short, empty, null and long texts, odd blanks and letters."""
    rng = random.Random(5)
    out = [(0, None), (1, ""), (2, " \t\n"), (3, "One two"), (4, "one  TWO"), (5, "ÀÉ x y z"), (6, "a\x00b c d e"), (None, "no id here at all"), (None, "NO id here at all")]
    base = words(rng, 400)
    ids = iter(range(10, 10_000))
    for _ in range(40):  # one large group of near copies
        w = list(base)
        for _ in range(rng.randrange(12)):
            w[rng.randrange(len(w))] = f"q{rng.randrange(10**6)}"
        out.append((next(ids), " ".join(w)))
    out += [(next(ids), " ".join(base))] * 1 + [(next(ids), " ".join(base)) for _ in range(15)]
    chain = words(rng, 300)
    for _ in range(8):  # each near the one before, the ends far apart
        chain = chain[6:] + words(rng, 6)
        out.append((next(ids), " ".join(chain)))
    shared = words(rng, 60)
    out += [(next(ids), " ".join([*words(rng, 80), *shared, *words(rng, 80)])) for _ in range(30)]  # a passage in many texts
    out += [(next(ids), " ".join(words(rng, rng.randrange(1, 40), 12))) for _ in range(80)]  # few different words
    long = words(rng, 60_000)
    out += [(next(ids), " ".join(long)), (next(ids), " ".join(long[:-500]))]
    return out


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80)])
def test_jaccard_components(spark, corpus, k, num):
    sets = [shingle_set(t, k) for _, t in corpus]
    root = list(range(len(corpus)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= num * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(corpus):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    want = sorted(((d, len(s), low.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(corpus, sets, strict=True))), key=repr)
    got = jaccard.jaccard_components(frame(spark, corpus).repartition(5), k=k, num=num).collect()
    assert sorted((tuple(r) for r in got), key=repr) == want


def test_jaccard_large_tiles(spark, monkeypatch):
    """Tiles are cut into bands and blocks, and the list of frequent shingles is bounded, without a change in the result."""
    rng = random.Random(2)
    base = words(rng, 100)
    rows = [(i, " ".join(base[: 100 - i % 30] + words(rng, 3))) for i in range(90)]
    want = {r.doc_id: r.component_id for r in jaccard.jaccard_components(frame(spark, rows)).collect()}
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    monkeypatch.setattr(jaccard, "FREQUENT_MOST", 5)
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(frame(spark, rows).repartition(3)).collect()} == want
    assert len(set(want.values())) < 30


def test_keep_one(spark):
    rows = [(3, "a b c d e f g"), (1, "a b c d e f g"), (2, None), (4, None), (None, "a b c d e f g")]
    kept = jaccard.keep_one_of_each(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "cls", "key", "_id"]
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == [1, 2, 4, None]


def test_empty_tables(spark):
    none = frame(spark, [])
    assert jaccard.jaccard_components(none).count() == 0
    assert linededup.dedup_lines(none).count() == 0
    assert passages.repeated_passages(none).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_overlap(none, bench).count() == 0
    got = decontaminate.find_overlap(frame(spark, [(1, "a b")]), bench).first()
    assert (got.n_words, got.n_hit, list(got["items"])) == (2, 0, [])


def brute_lines(rows, least=10):
    strip = " \t\n\x0b\x0c\r"
    key = lambda line: line.strip(strip).translate(LOWER)
    first: dict[str, int] = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                first[key(line)] = min(first.get(key(line), d), d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or first[key(x)] == d]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def test_line_dedup(spark):
    rng = random.Random(3)
    pool = ["Shared line number %d" % i for i in range(30)] + ["short", "", "  ", "\tPadded SHARED line \x0b", "padded shared line", "ünïcode lïne é", "123456789", "1234567890"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(12)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "\n"), (203, "\n".join(f"line of a long text {i % 700}" for i in range(20_000))), (204, "line of a long text 1\r\nx")]
    out = linededup.dedup_lines(frame(spark, rows).repartition(4))
    sha = F.sha2(F.encode(F.array_join("_kept", "\n"), "UTF-8"), 256)
    got = sorted(tuple(r) for r in out.select("doc_id", F.size("_lines"), "_n_dropped", sha).collect())
    assert got == brute_lines(rows)


def test_line_dedup_repeated_and_missing_ids(spark):
    rows = [(1, "the same long line"), (1, "the same long line"), (None, "the same long line\nb"), (None, "another long line!")]
    got = {(r.doc_id, r.text): list(r._kept) for r in linededup.dedup_lines(frame(spark, rows)).collect()}
    assert got == {(1, rows[0][1]): ["the same long line"], (None, rows[2][1]): ["b"], (None, rows[3][1]): ["another long line!"]}
    three = linededup.dedup_lines(frame(spark, [(i, "the same long line") for i in (1, 2)]), min_docs=3)
    assert all(r._n_dropped == 0 for r in three.collect())


def test_line_dedup_with_clashing_names(spark):
    """Columns named like those the operator adds or uses inside come through."""
    names = ["_kept", "_ld_id", "_lines", "_n_dropped", "gone", "row", "id", "print", "lines"]
    rows = [(1, "the same long line\nx", *range(9)), (2, "the same long line\ny", *range(10, 19)), (3, None, *[None] * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    out = linededup.drop_repeated_lines(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect())) == [rows[0], (2, "y", *range(10, 19)), rows[2]]
    whole = linededup.dedup_lines(df)
    assert sorted((r.doc_id, list(r._kept), r._ld_id) for r in whole.collect() if r.doc_id < 3) == [(1, ["the same long line", "x"], 1), (2, ["y"], 11)]


def brute_overlap(rows, items, window=13):
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    tok = lambda t: rx.findall((t or "").translate(LOWER))
    pats: dict[tuple, set] = {}
    for i, t in items:
        w = tok(t)
        m = min(window, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            pats.setdefault(tuple(w[k : k + m]), set()).add(i)
    sizes, out = {len(p) for p in pats}, []
    for d, t in rows:
        w, hit, found = tok(t), set(), set()
        for m in sizes:
            for k in range(len(w) - m + 1):
                if (own := pats.get(tuple(w[k : k + m]))) is not None:
                    hit |= set(range(k, k + m))
                    found |= own
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [10**6, 60])
def test_decontamination(spark, block):
    rng = random.Random(8)
    items = [(i, " ".join(words(rng, rng.choice([1, 2, 5, 12, 13, 14, 40]), 60))) for i in range(30)] + [(50, ""), (51, None), (52, "..."), (3, "w1, W2; w3")]
    rows = []
    for i in range(60):
        w = words(rng, rng.randrange(0, 900), 60 if i % 3 else 4000)
        if i % 4 == 0:
            w[len(w) // 2 : len(w) // 2] = (rng.choice(items)[1] or "").upper().split()
        rows.append((i, ("  " if i % 2 else ",\n").join(w)))
    rows += [(100, None), (101, ""), (102, "é É ß 9"), (103, " ".join(words(rng, 30_000)) + " " + items[6][1]), (None, items[5][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_overlap(frame(spark, rows).repartition(3), bench, block_words=block)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, sorted(r["items"])) for r in got.collect()), key=repr) == brute_overlap(rows, items)


def test_drop_contaminated(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    rows = [(1, "x " * 57 + "Alpha, beta gamma"), (2, "x " * 58 + "alpha beta gamma"), (3, None), (4, "alpha beta")]
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(frame(spark, rows), bench).collect()) == [2, 3, 4]


def test_passages_are_found(spark):
    """Every planted passage of 60 words comes up with both its documents, within a few words, and nothing else does."""
    rng = random.Random(4)
    rows, want = [], []
    for i in range(0, 60, 2):
        p = words(rng, 60, 10**6)
        q = list(p)
        if i % 4 == 0:
            q[30] = "changed"
        if i % 6 == 0:
            del q[20]
        a, b = words(rng, 150, 10**6), words(rng, 90, 10**6)
        rows += [(i, " ".join(a[:70] + p + a[70:])), (i + 1, "\n".join(b[:30] + q + b[30:]))]
        want.append((i, i + 1))
    copy = " ".join(words(rng, 120, 10**6))
    rows += [(1000 + j, copy if j else copy.upper()) for j in range(5)] + [(2000, None), (2001, ""), (None, copy), (2002, "short text")]
    got = passages.repeated_passages(frame(spark, rows).repartition(4)).collect()
    pairs = {tuple(sorted((r.doc_id, r.other_id))): r for r in got if r.relation == "passage"}
    assert sorted(pairs) == want
    for (i, _), r in pairs.items():
        lo, hi = (r.start_word, r.end_word) if r.doc_id == i else (r.other_start, r.other_end)
        assert abs(lo - 70) <= 3 and abs(hi - 130) <= 3 and r.identity >= 0.9
    assert sorted((r.doc_id, r.other_id) for r in got if r.relation == "copy") == [(1000 + j, 1000) for j in range(1, 5)]


def test_passage_in_many_documents(spark):
    """A passage that very many share gives a star, not all pairs."""
    rng = random.Random(9)
    p = words(rng, 80, 10**6)
    rows = [(i, " ".join(words(rng, 60, 10**6) + p + words(rng, 60, 10**6))) for i in range(50)]
    got = passages.repeated_passages(frame(spark, rows).coalesce(2)).collect()
    assert {r.doc_id for r in got} | {r.other_id for r in got} == set(range(50)) and len(got) <= 60


def test_chain_prefers_collinear_matches():
    a = [0, 10, 20, 30, 40, 15]
    b = [0, 10, 20, 30, 40, 500]
    best = passages.chain(a, b)[0]
    assert best == [0, 1, 2, 3, 4]


def test_fuzzy_passages_are_found(spark):
    """Passages with up to a fifth of their words changed, against every span of the planted place that has a seed and passes."""
    rng = random.Random(12)
    rows, want = [], set()
    for i in range(0, 240, 2):
        p = words(rng, 50 + i % 3 * 15, 10**6)
        q = [f"c{rng.randrange(10**9)}" if rng.random() < (0.1, 0.13, 0.16)[i // 2 % 3] else w for w in p]
        ok = [a == b for a, b in zip(p, q, strict=True)]
        seeds = [j for j in range(len(ok) - 5) if all(ok[j : j + 6])]
        if any(ok[lo] and ok[hi - 1] and sum(ok[lo:hi]) >= 0.8 * (hi - lo) for lo in range(len(ok)) for hi in range(lo + 50, len(ok) + 1) if any(lo <= j <= hi - 6 for j in seeds)):
            want.add((i, i + 1))
        rows += [(i, " ".join(words(rng, 40, 10**6) + ["e"] + p + words(rng, 90, 10**6))), (i + 1, " ".join(words(rng, 70, 10**6) + q + words(rng, 30, 10**6)))]
    got = {tuple(sorted((r.doc_id, r.other_id))) for r in passages.repeated_passages(frame(spark, rows).repartition(4)).collect()}
    assert len(want) > 90 and got <= want
    assert len(got) >= 0.98 * len(want), f"{len(got)} of {len(want)}"


def test_passage_whose_beginning_a_third_text_has(spark):
    """55 words in two texts, the first 45 of them in a third one: the two are found whichever text comes first."""
    rng = random.Random(13)
    rows = []
    for i in range(0, 120, 3):
        p = words(rng, 55, 10**6)
        rows += [(i + j, " ".join(words(rng, 30, 10**6) + (p if j else p[:45]) + words(rng, 30, 10**6))) for j in range(3)]
    got = {tuple(sorted((r.doc_id, r.other_id))) for r in passages.repeated_passages(frame(spark, rows).repartition(4)).collect()}
    assert got == {(i + 1, i + 2) for i in range(0, 120, 3)}


def pairs_of(got):
    return {tuple(sorted((r.doc_id, r.other_id))) for r in got if r.relation == "passage"}


def test_passages_among_decoys(spark):
    """Two texts share 60 words, and 40 others each have 18 to 40 of them: the two are found, whatever the decoys' classes."""
    rng = random.Random(14)
    rows, want = [], set()
    for i in range(0, 1000, 50):
        p = words(rng, 60, 10**6)
        rows += [(i + j, " ".join(words(rng, 30, 10**6) + p + words(rng, 30, 10**6))) for j in range(2)]
        want.add((i, i + 1))
        for j in range(2, 42):
            n = rng.randrange(18, 41)
            at = rng.randrange(0, 61 - n)
            rows.append((i + j, " ".join(words(rng, 40, 10**6) + p[at : at + n] + words(rng, 40, 10**6))))
    rng.shuffle(rows)
    assert pairs_of(passages.repeated_passages(frame(spark, rows).repartition(4)).collect()) == want


def test_passages_of_frequent_seeds_only(spark):
    """Two texts share 60 words but for every tenth, changed or left out, and 40 decoys hold each run between: every seed is frequent, yet the two are found."""
    rng = random.Random(18)
    rows, want = [], set()
    for i in range(0, 2500, 250):
        p = words(rng, 60, 10**6)
        q = [w if (j + 1) % 10 else ("changed" if j % 20 == 9 or i % 500 else "") for j, w in enumerate(p)]
        for j, own in enumerate((p, q)):
            rows.append((i + j, " ".join(words(rng, 30, 10**6) + [w for w in own if w] + words(rng, 30, 10**6))))
        want.add((i, i + 1))
        for j in range(240):
            at = j % 6 * 10
            rows.append((i + 2 + j, " ".join(words(rng, 25, 10**6) + p[at : at + 9] + words(rng, 25, 10**6))))
    rng.shuffle(rows)
    assert pairs_of(passages.repeated_passages(frame(spark, rows).repartition(4)).collect()) == want


def test_passages_do_not_depend_on_partitions(spark):
    """Very long, self-repeating, copied and boilerplate-ridden texts: the same rows from 1, 3 and 20 partitions."""
    rng = random.Random(15)
    line = words(rng, 20, 10**6)
    rows = [(i, " ".join(words(rng, 40, 10**6) + line + words(rng, 40, 10**6))) for i in range(60)]
    p = words(rng, 70, 10**6)
    rows += [(100 + i, " ".join(line + words(rng, 30, 10**6) + p + line)) for i in range(40)]
    rows += [(200 + i, "again and " * 500) for i in range(2)] + [(210, "again and " * 400), (211, " ".join(words(rng, 20_000, 10**6) + p))]
    rows += [rows[60], (None, rows[61][1])]
    runs = [sorted(map(tuple, passages.repeated_passages(frame(spark, rows).repartition(n)).collect()), key=repr) for n in (1, 3, 20)]
    assert runs[0] == runs[1] == runs[2]
    linked = {r[0] for r in runs[0]} | {r[3] for r in runs[0]}
    assert linked >= {*range(100, 140), 211, 200, 201, 210} and not linked & set(range(60))


def test_passages_against_all_pairs(spark):
    """300 texts from a small stock of sentences: each pair with 50 words in a row in common, by plain comparison, is linked through passages."""
    rng = random.Random(16)
    stock = [words(rng, rng.randrange(8, 30), 10**6) for _ in range(60)]
    texts = [sum((rng.choice(stock) for _ in range(rng.randrange(4, 12))), []) for _ in range(300)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    holders: dict[tuple, set] = {}
    for i, t in enumerate(texts):
        for j in range(len(t) - 49):
            holders.setdefault(tuple(t[j : j + 50]), set()).add(i)
    got = passages.repeated_passages(frame(spark, rows).repartition(4)).collect()
    up = list(range(300))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for r in got:
        up[find(r.doc_id)] = find(r.other_id)
    shared = [own for own in holders.values() if len(own) > 1]
    assert len(shared) > 50 and all(len({find(i) for i in own}) == 1 for own in shared)
    exact = {(i, j) for own in shared for i in own for j in own if i < j}
    found = pairs_of(got)
    assert len(found & exact) >= 0.98 * len(exact)
    for r in got:  # what is reported is a passage indeed
        x, y = texts[r.doc_id][r.start_word : r.end_word], texts[r.other_id][r.other_start : r.other_end]
        assert min(len(x), len(y)) >= 50 and r.identity >= 0.8 and len(set(x) & set(y)) >= 0.5 * len(set(x))


def test_passages_with_clashing_columns(spark):
    rng = random.Random(17)
    p = " ".join(words(rng, 60, 10**6))
    out = passages.repeated_passages(spark.createDataFrame([(1, "x " + p, 5, "a"), (2, "y " + p, 6, "b")], "doc_id long, text string, cls int, own string"))
    assert pairs_of(out.collect()) == {(1, 2)}


def test_pairs_that_cannot_pass_are_not_aligned():
    """Texts of words each repeated 43 times, in which chains abound but no passage lies: none is left to align; what alignment accepts always is."""
    rng = np.random.default_rng(19)
    hopeful = passages._hopeful(50, 0.8)

    def pair(x, y):
        return pa.record_batch([pa.array([2]), pa.array([1]), pa.array([x.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], ["cls", "to", "x", "y"])

    def left(x, y):
        return [b for b in passages._complete(iter([pair(x, y)]), hopeful, 50, 0.8) if len(b)]

    w = rng.integers(1, 2**32, 40).astype(np.uint32)
    assert not left(np.repeat(w[:12], 43), np.repeat(np.append(w[5], w[20:31]), 43))
    own = np.repeat(w[[1, 20, 2, 21, 3]], 43)
    assert not left(np.repeat(w[:12], 43), own)  # several words in common, never next to one another
    seen = 0
    for _ in range(300):
        p = w[rng.integers(0, 40, 70)] if rng.random() < 0.5 else np.repeat(w[rng.integers(0, 6, 14)], 5)
        q = np.where(rng.random(70) < rng.choice([0.05, 0.15, 0.25]), w[rng.integers(0, 40, 70)], p)
        if rng.random() < 0.5:
            q = np.delete(q, rng.integers(0, 70, 3))
        x, y = np.concatenate([w[rng.integers(0, 40, 30)], p]), np.concatenate([q, w[rng.integers(0, 40, 30)]])
        every = [(i, j) for i in range(len(x) - 5) for j in range(len(y) - 5) if (x[i : i + 6] == y[j : j + 6]).all()]
        if not every:
            continue
        i, j = np.array(every).T
        chains = passages._pairs(pa.record_batch([pa.array(np.full(len(i), 2)), pa.array(np.full(len(i), 1)), pa.array(i), pa.array(j)], ["cls", "to", "pos", "to_pos"]))
        texts = [pa.array([v], t) for v, t in ((x.tobytes(), pa.binary()), (0, pa.int32()), (len(x), pa.int32()), (y.tobytes(), pa.binary()), (0, pa.int32()), (len(y), pa.int32()))]
        whole = pa.record_batch([*chains.columns, *texts], [*chains.schema.names, "x", "x_at", "x_all", "y", "y_at", "y_all"])
        judge = passages._judge(50, 0.8)
        want = [r for b in judge(iter([whole])) for r in b.to_pylist()]
        # alignment counts words of runs that overlap twice: what it reports must be there
        want = [r for r in want if r["n_equal"] <= sum(m.size for m in SequenceMatcher(None, x[r["start_word"] : r["end_word"]].tolist(), y[r["other_start"] : r["other_end"]].tolist(), autojunk=False).get_matching_blocks())]
        got = [r for b in judge(iter(left(x, y))) for r in b.to_pylist()]
        seen += len(want)
        assert all(r in got for r in want)
    assert seen > 60
