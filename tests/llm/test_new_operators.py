"""Lexical search, whitening and the rule ledger against brute force, and on nulls, empty and long
texts, ties, repeated rows, empty tables and columns with clashing names."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from coffer.llm import lexical_search, quality_rules, whitening
from coffer.llm.queries import ORACLE, QUERIES
from coffer.llm.quality_rules import BASE, MEASURES, POLICY, RULES, Policy, Rule

SF = "/root/testdata/sf0.001"


def same_as_sql(spark, name):
    from workload import compare

    ours, theirs = QUERIES[name](spark, SF).toArrow(), compare.duck(SF).sql(ORACLE[name]).to_arrow_table()
    order = sorted(ours.column_names)
    assert order == sorted(theirs.column_names)
    rows = [Counter(zip(*[t.select(order).column(c).to_pylist() for c in order])) for t in (ours, theirs)]
    assert rows[0] == rows[1] and rows[0]


@pytest.mark.parametrize("name", ["op11_lexical_search", "op13_quality_rules"])
def test_query_equals_its_sql(spark, name):
    same_as_sql(spark, name)


# --- 11 --------------------------------------------------------------------------------------


def terms(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def ranked(docs, items, limit=10):
    """(item id, rank, doc id, score) by the formula, over lists of (id, text)."""
    own = [(i, terms(t)) for i, t in docs]
    own = [(i, t) for i, t in own if t]
    total, df = sum(len(t) for _, t in own), Counter(x for _, t in own for x in set(t))
    out = []
    for item, text in {(i, t) for i, t in items}:
        scores = []
        for doc, ts in own:
            m = 10 + (90 * len(ts) * len(own)) // total
            tf = Counter(ts)
            score = sum(
                math.floor(1000 * math.log((2 * len(own) + 2) / (2 * df[x] + 1))) * ((10**9 * tf[x]) // (1000 * tf[x] + 8 * m))
                for x in set(terms(text)) if tf[x]
            )
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, k, x[3], -x[0]) for k, x in enumerate(sorted(scores)[:limit], 1)]
    return sorted(out, key=repr)


def search(spark, docs, items, **options):
    docs = spark.createDataFrame(docs, "doc_id bigint, text string") if isinstance(docs, list) else docs
    items = spark.createDataFrame(items, "item_id bigint, text string") if isinstance(items, list) else items
    return sorted((tuple(r) for r in lexical_search.rank_documents(docs, items, **options).collect()), key=repr)


VOCABULARY = ["ab", "Ab", "çé", "x1", "12", "zz", "Ü", "ü", "q", "rare", "no-end", "don't"]


@pytest.mark.parametrize("per_block", [1, 7, 200_000])
def test_search_equals_brute_force_for_any_number_of_blocks(spark, monkeypatch, per_block):
    monkeypatch.setattr(lexical_search, "POSTINGS_PER_BLOCK", per_block)
    monkeypatch.setattr(lexical_search, "_STEPS", 3)
    monkeypatch.setattr(lexical_search, "_SCORES", 10)
    rng = random.Random(5)
    text = lambda most: " ".join(rng.choices(VOCABULARY, k=rng.randint(0, most)))
    docs = [(i, text(40)) for i in range(90)] + [(200 + i, "ab zz zz rare") for i in range(25)]  # ties
    items = [(i, text(6)) for i in range(6)]
    docs_df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(7)
    assert search(spark, docs_df, items) == ranked(docs, items)


def test_search_takes_ties_by_id_nulls_last_and_repeated_rows(spark):
    docs = [(3, "a b"), (1, "a b"), (1, "a b"), (None, "a b"), (2, "A B"), (9, None), (8, ""), (7, "..."), (5, "c " * 200_000), (6, "d e f")]
    items = [(1, "a"), (1, "a"), (2, None), (3, "!"), (None, "c"), (1, "d"), (4, "unknown")]
    got = search(spark, docs, items, limit=4)
    assert [r[2] for r in sorted(got, key=lambda r: r[1]) if r[0] == 1 and r[3] == got[0][3]] == [1, 1, 2, 3]
    assert got == ranked(docs, items, 4)
    assert {r[0] for r in got} == {1, None}  # two texts under one id rank each for itself


def test_search_of_empty_tables_and_with_other_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 7, 8, "x")], "doc_id bigint, text string, item int, score int, share string")
    items = spark.createDataFrame([(5, "a", 1, 2)], "item_id bigint, text string, rank int, doc_id int")
    assert [r[:3] for r in search(spark, docs, items)] == [(5, 1, 1)]
    assert search(spark, docs.limit(0), items) == [] and search(spark, docs, items.limit(0)) == []
    named = docs.select(F.concat("text", F.lit("!")).alias("name"), F.col("text").alias("body"))
    got = lexical_search.rank_documents(named, items, doc_id="name", text="body").collect()
    assert [r.doc_id for r in got] == ["a b!"]


def test_heaps_stay_small_under_ties():
    heaps = lexical_search.Heaps(2, 3)
    for start in range(0, 1000, 50):
        heaps.update(np.full((50, 2), 7), [2000 - start - i for i in range(50)])
    assert [len(h) for h in heaps.best] == [3, 3] and heaps.best[0] == [(7, 1001), (7, 1002), (7, 1003)]


# --- 12 --------------------------------------------------------------------------------------


def brute_whitening(vectors, components):
    x = np.array([[math.floor(256 * float(c)) for c in v] for v in vectors], dtype=np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return n, [int(sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums))) for row in x], (x - sums / n) @ u / np.sqrt(e), e, e.sum()


def test_whitening_equals_dense_eigenvectors(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12)) + 5
    vectors = np.concatenate([vectors, vectors[:40], vectors[:1].repeat(200, axis=0)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>").repartition(5)
    got = {}
    for r in whitening.whiten(df, components=4).collect():
        got.setdefault(r.component, {})[r.vec_id] = r
    n, deviations, projected, e, _ = brute_whitening(vectors, 4)
    assert sorted(got) == [1, 2, 3, 4] and {r.n for rows in got.values() for r in rows.values()} == {n}
    total = np.trace(np.cov(np.unique(np.floor(256 * vectors), axis=0).T, bias=True))
    for k in range(4):
        own = np.array([got[k + 1][i].whitened for i in range(len(vectors))])
        sign = 1 if own @ projected[:, k] > 0 else -1
        assert np.abs(own * sign - projected[:, k]).max() < 1e-9
        assert abs(got[k + 1][0].explained - e[k] / total) < 1e-12
    assert [int(got[1][i].deviation) for i in range(len(vectors))] == deviations
    assert 0 <= got[1][0].identity_error < 1e-10


def test_whitening_leaves_out_unusable_vectors_and_components_without_variance(spark):
    nan, inf = float("nan"), float("inf")
    data = [
        (1, [1.0, 2.0, 3.0], 0), (1, [1.0, 2.0, 3.0], 0), (None, [2.0, 4.0, 6.0], 1), (3, None, 2), (4, [nan, 1.0, 1.0], 3),
        (5, [inf, 1.0, 1.0], 3), (6, [None, 1.0, 1.0], 3), (7, [], 3), (8, [4.0, 4.0], 3), (9, [-0.0, 0.0, 0.0], 1),
    ]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>, component int")
    got = whitening.whiten(df).collect()
    # on one line: one component; the only vector of its length has no variance at all
    assert sorted((str(r.vec_id), r.component, r.n) for r in got) == [("1", 1, 3), ("1", 1, 3), ("9", 1, 3), ("None", 1, 3)]
    assert all(abs(r.explained - 1) < 1e-12 and r.identity_error < 1e-12 for r in got)
    assert whitening.whiten(df.limit(0)).collect() == []
    assert whitening.whiten(df.where("vec_id = 7 or vec_id = 3")).collect() == []


def test_whitening_keeps_deviations_exact_beyond_64_bits(spark):
    data = [(1, [1e15, 3.0]), (2, [-1e15, 7.0]), (3, [5.5, 1e12]), (4, [1e300, 0.0])]
    got = {r.vec_id: r for r in whitening.whiten(spark.createDataFrame(data[:3], "vec_id bigint, embedding array<double>")).collect()}
    xs = {i: [math.floor(256 * c) for c in v] for i, v in data[:3]}
    sums = [sum(c) for c in zip(*xs.values())]
    assert {i: int(r.deviation) for i, r in got.items()} == {i: sum((3 * a - s) ** 2 for a, s in zip(v, sums)) for i, v in xs.items()}
    spark_limit = whitening.whiten(spark.createDataFrame(data, "vec_id bigint, embedding array<double>")).where("vec_id = 4").first()
    assert spark_limit.n == 4  # entries beyond bigint are limited to its range


@pytest.mark.parametrize("size", [1, 2, 7, 40])
def test_inertia_counts_eigenvalues(size):
    rng = np.random.default_rng(size)
    for values in (rng.normal(size=size), np.sign(rng.normal(size=size)), np.zeros(size)):
        q = np.linalg.qr(rng.normal(size=(size, size)))[0]
        a = (q * values) @ q.T
        a = (a + a.T) / 2
        assert whitening.above(a, 0.3) == int((values > 0.3).sum()) and whitening.above(a, -1.5) == int((values > -1.5).sum())
    assert whitening.positive_eigenvalues(np.array([[0.0, 1.0], [1.0, 0.0]])) == 1


@pytest.mark.parametrize(
    "values",
    [
        [9, 8, 7, 6, 5, 4, 3, 2, 1, 0.5],
        [1e9, 1e3, 1, 1e-3, 1e-4, 1e-5],
        [5, 5, 5, 5, 5, 1, 1],  # the fourth has equals
        [3, 2, 1 + 1e-9, 1, 1 - 1e-9, 0.5],
        list(np.linspace(1, 2, 60)),
        [2, 0, 0, 0],
        [7],
    ],
)
def test_contours_extract_all_wanted_eigenvectors(values):
    values = np.array(values, float)
    q = np.linalg.qr(np.random.default_rng(8).normal(size=(len(values), len(values))))[0]
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    e, u = whitening.principal(a, 4)
    want = np.sort(values[values > 0])[::-1][:4]
    assert np.allclose(e, want, rtol=1e-9, atol=1e-14 * values.max())
    assert np.abs(a @ u - u * e).max() < 1e-12 * values.max() and np.abs(u.T @ u - np.eye(len(e))).max() < 1e-7
    for wanted in (len(values), 1):
        assert len(whitening.principal(a, wanted)[0]) == min(wanted, int((values > 0).sum()))


# --- 13 --------------------------------------------------------------------------------------


def brute_measures(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    return (
        len(ws), sum(map(len, ws)), sum(1 for w in ws if re.search(r"[A-Za-z]|[^\x00-\x7F]", w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines),
        sum(1 for i, x in enumerate(lines) if x in lines[:i]), sum(1 for x in lines if re.match(r"[\x20\x09-\x0D]*[-*•]", x)), len(covered),
    )


def test_measures_equal_brute_force():
    rng = random.Random(2)
    pieces = ["a", "b", "é", "漢", "12", "|", "#x", "\n", "\n", "•", "-", "\x0b", "\r", "\x1c", " ", " ", "%%"]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " ", "\t"]) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    for text in [*texts, "", "\n\n", "a b c a b c", "x " * 3, "x " * 4, "x y z w x y"]:
        assert quality_rules.measure(text.encode()) == brute_measures(text), repr(text)


LEDGER = [(1, None), (2, ""), (3, "word " * 60), (4, "\n".join(f"this is the line number {chr(97 + i // 26)}{chr(97 + i % 26)} of many" for i in range(30))), (4, "a | b " * 2), (None, "x")]


@pytest.fixture(scope="module")
def entries(spark):
    docs = spark.createDataFrame(LEDGER, "doc_id bigint, text string").withColumn("source", F.when(F.col("doc_id") > 2, "s"))
    return quality_rules.ledger(docs, keep=["doc_id", "source"]).persist()


def test_ledger_bits_and_policies(spark, entries):
    rows = entries.collect()
    assert len(rows) == len(LEDGER) and entries.columns == ["doc_id", "source", *MEASURES, "failed"]
    for r in rows:
        bits = sum(1 << rule.bit for rule in RULES if spark.sql(f"SELECT {rule.fails} FROM VALUES ({','.join(str(r[m]) for m in MEASURES)}) t({','.join(MEASURES)})").first()[0])
        assert r.failed == bits
    judged = quality_rules.apply_policy(entries)
    assert [(r.n_words, r.kept) for r in judged.collect()] == [(r.n_words, r.failed == 0) for r in rows]
    lenient = Policy(3, POLICY.rules, allowed=1)
    assert quality_rules.apply_policy(entries, lenient).where("kept").count() == sum(bin(r.failed).count("1") <= 1 for r in rows)
    with pytest.raises(ValueError):
        quality_rules.apply_policy(entries, Policy(4, ("no such rule",)))
    with pytest.raises(ValueError):
        quality_rules.ledger(entries.withColumn("text", F.lit("")), [Rule(1, "a", "true"), Rule(1, "b", "true")])


@pytest.mark.parametrize("policy", [POLICY, BASE, Policy(5, POLICY.rules, 1)])
def test_ablations_equal_judging_again(entries, policy):
    rows = entries.collect()
    for by in ([], ["source"]):
        got = {(tuple(r[b] for b in by), r.rule): r for r in quality_rules.ablations(entries, policy, by=by).collect()}
        groups = {tuple(r[b] for b in by) for r in rows}
        assert set(got) == {(g, name) for g in groups for name in policy.rules}
        for (group, name), r in got.items():
            own = [x.failed for x in rows if tuple(x[b] for b in by) == group]
            bit = next(1 << x.bit for x in RULES if x.name == name)
            mask = quality_rules.mask_of(policy)
            keeps = lambda m: sum(bin(f & m).count("1") <= policy.allowed for f in own)
            want = (len(own), keeps(mask), sum(f & bit > 0 for f in own), sum(f & mask == bit for f in own), keeps(mask & ~bit))
            assert (r.n, r.n_kept, r.n_failed, r.n_only, r.n_kept_without) == want


def test_ablations_read_masks_only(entries):
    plan = quality_rules.ablations(entries)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Join|Window|Sort", plan)


def test_policy_comparison_and_profile(entries):
    rows = entries.collect()
    want = Counter((not r.failed & quality_rules.mask_of(BASE), not r.failed) for r in rows)
    assert {(r.kept_before, r.kept_after): r.n for r in quality_rules.compare_policies(entries, BASE, POLICY).collect()} == dict(want)
    got = {r.source: r for r in quality_rules.profile(entries, ["source"]).collect()}
    for source in (None, "s"):
        own = [r.failed for r in rows if r.source == source]
        names = lambda f: [r.name for r in RULES if f >> r.bit & 1]
        every, some = own[0], 0
        for f in own:
            every, some = every & f, some | f
        assert (got[source].n, got[source].failed_by_any, got[source].failed_by_all) == (len(own), names(some), names(every))


def test_ledger_of_empty_tables_long_texts_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "one two three four " * 100_000, 5, 6)], "doc_id bigint, text string, failed int, N_Words int")
    row = quality_rules.apply_policy(quality_rules.ledger(docs)).first()
    assert (row.doc_id, row.n_words, row.n_repeat_words, row.kept, row.policy) == (1, 400_000, 400_000, False, 2)
    empty = quality_rules.ledger(docs.limit(0))
    assert empty.collect() == [] and quality_rules.apply_policy(empty).collect() == []
    assert {r.n for r in quality_rules.ablations(empty).collect()} == {0} and quality_rules.profile(empty, ["doc_id"]).collect() == []
