import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinlink.functions import similarity
from kinlink.operators import audit, blocking, decide, learning, metrics
from kinlink.operators.translit_learn import kept, learn_states
from kinlink.sources import tsv


def lcs_brute(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_ratio_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert similarity.lcs(a, b) == lcs_brute(a, b)
    assert similarity.ratio_of("", "") == 100 and similarity.ratio_of("a", "") == 0
    assert similarity.ratio_of("abcd", "abxd") == 75


def test_other_similarities():
    assert similarity.set_ratio_of("a b c", "c a") == 100 and similarity.set_ratio_of("", "") == 0
    assert similarity.set_ratio_of("red ring", "blue ring") == max(similarity.ratio_of("ring red", "ring blue"), similarity.ratio_of("ring", "ring red"), similarity.ratio_of("ring", "ring blue"))
    assert similarity.partial_ratio_of("ring", "the ring road") == 100 and similarity.partial_ratio_of("", "x") == 0 and similarity.partial_ratio_of("", "") == 100
    assert round(similarity.jaro_winkler_of("martha", "marhta"), 4) == 0.9611 and similarity.jaro_winkler_of("", "a") == 0
    rng = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) for _ in range(2))
        s, t = sorted((a, b), key=len)
        windows = [t[max(i, 0) : i + len(s)] for i in range(1 - len(s), len(t))]
        assert similarity.partial_ratio_of(a, b) == pytest.approx(max(similarity.ratio_of(s, w) for w in windows))


def test_partial_ratios_of_many_pairs(monkeypatch):
    """Many pairs at a time, one by one only where the shorter text fills more than a machine word."""
    rng = random.Random(21)
    made = lambda most: "".join(rng.choice("abc é\U0001f600") for _ in range(rng.randint(0, most)))
    pairs = [(made(14), made(14)) for _ in range(400)] + [(made(40), made(200)) for _ in range(40)] + [("ab" * 31 + "c", "ba" * 60), ("ab" * 40, "ba" * 50), ("", ""), ("a", "")]
    expected = [similarity.partial_ratio_of(a, b) for a, b in pairs]
    assert similarity.partial_ratio_of("acb", "zzabzz") == pytest.approx(200 * 2 / 6)  # all best windows begin or end without a letter of the shorter
    for (a, b), score in zip(pairs, expected):
        s, t = sorted((a, b), key=len)
        assert score == pytest.approx(max((similarity.ratio_of(s, t[max(i, 0) : i + len(s)]) for i in range(1 - len(s), len(t))), default=0) if s else 0 if t else 100)
    monkeypatch.setattr(similarity, "TOGETHER", 500)
    assert similarity.partial_ratios(pairs) == pytest.approx(expected)
    asked = []
    monkeypatch.setattr(similarity, "partial_ratio_of", lambda a, b: asked.append(min(len(a), len(b))) or 0.0)
    similarity.partial_ratios(pairs)
    assert all(n == 0 or n > similarity.WORD for n in asked)


def test_ratios_of_many_pairs(monkeypatch):
    rng = random.Random(22)
    made = lambda most: "".join(rng.choice("abc é\U0001f600") for _ in range(rng.randint(0, most)))
    pairs = [(made(14), made(14)) for _ in range(300)] + [(made(70), made(200)) for _ in range(60)] + [("ab" * 31 + "c", "ba" * 60), ("", "")]
    assert similarity.ratios(pairs, 50) == pytest.approx([similarity.ratio_of(a, b) for a, b in pairs])
    assert similarity.ratios([]) == []
    asked = []
    monkeypatch.setattr(similarity, "ratio_of", lambda a, b: asked.append(min(len(a), len(b))) or 0.0)
    similarity.ratios(pairs)
    assert all(n == 0 or n > similarity.WORD for n in asked)


def expected_brute(q, j):
    total = 0.0
    for truth in itertools.product((0, 1), repeat=len(q)):
        p = 1.0
        for x, t in zip(q, truth):
            p *= x if t else 1 - x
        n = sum(truth)
        tp = sum(truth[:j])
        total += p * (1.0 if j == n == 0 else 0.0 if j == 0 or n == 0 else 1.25 * tp / (j + 0.25 * n))
    return total


def test_expected_scores_are_enumeration(spark):
    rng = random.Random(3)
    lists = [sorted((round(rng.random(), 3) for _ in range(n)), reverse=True) for n in range(1, 7) for _ in range(3)] + [[0.9, 0.6, 0.1], [0.5]]
    rows = spark.createDataFrame([(i, q) for i, q in enumerate(lists)], "i int, q array<double>")
    got = rows.select("i", "q", decide.expected_scores(F.col("q")).alias("e"), decide.best_count(F.col("q")).alias("j")).collect()
    for r in got:
        e = [expected_brute(r.q, j) for j in range(len(r.q) + 1)]
        assert r.e == pytest.approx(e)
        assert r.j == max(range(len(e)), key=lambda j: (round(e[j], 12), -j))
    assert [r.j for r in got][-2:] == [1, 0]


def pair_rows(spark, rows):
    return spark.createDataFrame(rows, "country string, s1 int, src int, idx int, p double")


def test_odds_and_thresholds(spark):
    two = pair_rows(spark, [("US", 1, 2, 7, 0.9), ("US", 2, 2, 7, 0.5)])
    assert {r.s1: round(r.q, 6) for r in decide.odds(two).collect()} == {1: 0.818182, 2: 0.090909}
    assert {r.s1: r.q for r in decide.best_owner(two).collect()} == {1: 0.9, 2: 0.0}
    one = decide.one_home(pair_rows(spark, [("US", 1, 2, 7, 0.5), ("US", 1, 2, 8, 0.45)]), "none")
    assert [r.accepted for r in decide.two_thresholds(one, 0.6, 0.4).collect()] == [False, False]
    assert sorted(r.accepted for r in decide.two_thresholds(one, 0.5, 0.4).collect()) == [True, True]
    assert len(decide.configurations()) == 3 * (13 + 81 + 5) and len(decide.configurations(True)) == 29


def unions(keys):
    """The smallest member of each one's component, by closing groups over shared keys."""
    out, left = {}, set(range(len(keys)))
    while left:
        group, front = set(), {min(left)}
        while front:
            group |= front
            front = {i for i in left - group if any(keys[i] & keys[g] for g in group)}
        out |= {i: min(group) for i in group}
        left -= group
    return out


def test_link_components_are_union_find(spark):
    rng = random.Random(4)
    rows = [("US", s, 2, i, rng.choice(["", "n1", "n2"]), rng.choice(["", "a1", "a2", "a3"]), f"N{rng.randint(0, 9)}", rng.choice(["", f"A{rng.randint(0, 9)}"])) for s in range(6) for i in range(9)]
    pairs = spark.createDataFrame(rows, "country string, s1 int, src int, idx int, name_core string, addr_core string, name_raw string, addr_raw string")
    keyed = decide.link_keys(pairs)
    got = {(r.s1, r.idx): r.component for r in decide.link_components(keyed).collect()}

    def keys(r):
        _, _, _, _, n, a, nr, ar = r
        return {k for k in (("both", n, a) if n and a else None, ("raw", nr) if nr else None, ("addr", ar) if ar else None, ("name", n) if n and not a else None) if k}

    for s in range(6):
        own = [r for r in rows if r[1] == s]
        assert {i: got[s, i] for i in range(9)} == unions([keys(r) for r in own])


def test_link_components_of_a_long_chain(spark):
    rows = [("US", 1, 2, i, [f"k{i}", f"k{i + 1}"]) for i in range(40)] + [("US", 1, 2, 77, []), ("US", 1, 3, 5, ["k1"])]
    random.Random(1).shuffle(rows)
    pairs = spark.createDataFrame(rows, "country string, s1 int, src int, idx int, keys array<string>").repartition(3)
    got = {(r.src, r.idx): r.component for r in decide.link_components(pairs).collect()}
    assert {got[2, i] for i in range(40)} == {0} and got[2, 77] == 77 and got[3, 5] == 5


def test_configuration_scores_are_those_of_each_configuration(spark):
    rng = random.Random(8)
    rows = [("US", s, 2, i, round(rng.random(), 3), rng.randint(0, 1)) for s in range(7) for i in range(rng.randint(0, 6))] + [("US", 1, 2, 3, 0.5, 1)]
    rows = list({r[:4]: r for r in rows}.values())
    pairs = spark.createDataFrame(rows, "country string, s1 int, src int, idx int, p double, label int")
    sizes = spark.createDataFrame([("US", s, s % 3) for s in range(9)], "country string, s1 int, t int")
    got = {(r.home, r.name): r.score for r in decide.configuration_scores(pairs, sizes).collect()}
    assert len(got) == 297
    for c in [{"home": "odds", "rule": "one", "t": 0.35}, {"home": "none", "rule": "two", "t1": 0.6, "t2": 0.3}, {"home": "argmax", "rule": "two", "t1": 0.3, "t2": 0.7}, {"home": "odds", "rule": "expected", "gamma": 1.25}]:
        d = decide.apply_configuration(pairs, c).filter("accepted").groupBy("country", "s1").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("tp"))
        expected = sizes.join(d, ["country", "s1"], "left").na.fill(0).agg(F.avg(blocking.f05(F.col("tp"), F.col("n"), F.col("t")))).first()[0]
        name = {"one": lambda: f"one {c['t']:.2f}", "two": lambda: f"two {c['t1']:.2f} {c['t2']:.2f}", "expected": lambda: f"expected {c['gamma']:.2f}"}[c["rule"]]()
        assert got[c["home"], name] == pytest.approx(expected), c
    assert len(decide.configuration_scores(pairs, sizes, limited=True).collect()) == 29


def test_configuration_counts_are_those_of_single_records(spark, monkeypatch):
    """Records of many candidates, that go over several gatherings, against best_count(); a candidate without p is accepted by none."""
    monkeypatch.setattr(decide, "GATHER", 50)
    rng = random.Random(18)
    lists = [sorted((round(rng.random() ** 2, 2) for _ in range(rng.randint(0, 40))), reverse=True) for _ in range(60)]
    table = spark.createDataFrame([([x for x in q if x >= 0.01][:15],) for q in lists], "q array<double>")
    for g in (0.8, 1.0, 1.5):
        q = np.array([r.q + [0.0] * (15 - len(r.q)) for r in table.collect()])
        assert decide.best_counts(q, g).tolist() == [r[0] for r in table.select(decide.best_count(F.col("q"), g)).collect()]
    rows = [("US", s, 2, i, p, rng.randint(0, 1)) for s, q in enumerate(lists) for i, p in enumerate(q)]
    kinds = "country string, s1 int, src int, idx int, p double, label int"
    without = [(c, s, 3, -1, None, 1) for c, s in {r[:2] for r in rows}]
    sizes = spark.createDataFrame([("US", s, s % 5) for s in range(len(lists))], "country string, s1 int, t int")
    scores = [{(r.home, r.name): r.score for r in decide.configuration_scores(spark.createDataFrame(x, kinds), sizes).collect() if r.home != "odds"} for x in (rows, rows + without)]
    assert scores[0] == pytest.approx(scores[1]) and len(scores[0]) == 198
    batches = [pa.RecordBatch.from_pylist([dict(zip(("country", "s1", "src", "idx", "none", "label"), r)) for r in rows[i : i + 7]]) for i in range(0, len(rows), 7)]
    got = {r["s1"]: r["n"] for b in decide._counted(("none",), False)(iter(batches)) for r in b.to_pylist()}
    assert got.keys() == {r[1] for r in rows} and all(n[0] == sum(p >= 0.2 for p in lists[s]) for s, n in got.items())


@pytest.mark.parametrize("cells", [4_000_000, 500])
def test_the_optimiser_sees_all_candidates(spark, monkeypatch, cells):
    """Records of more than 15 candidates, some of q below 0.01, against best_count() of all of them."""
    monkeypatch.setattr(decide, "CELLS", cells, raising=False)
    rng = random.Random(28)
    lists = [[0.9] * 30, [0.005] * 40, []] + [sorted((round(rng.random() ** 3, 3) for _ in range(rng.randint(0, 40))), reverse=True) for _ in range(20)]
    kinds = "country string, s1 int, src int, idx int, p double, label int"
    rows = [("US", s, 2, i, p, rng.randint(0, 1) if s else 1) for s, q in enumerate(lists) for i, p in enumerate(q)]
    sizes = spark.createDataFrame([("US", s, sum(r[5] for r in rows if r[1] == s)) for s in range(len(lists))], "country string, s1 int, t int")
    got = {(r.home, r.name): r.score for r in decide.configuration_scores(spark.createDataFrame(rows, kinds), sizes, whole=True).collect()}
    table = spark.createDataFrame([(s, q) for s, q in enumerate(lists)], "s int, q array<double>")
    for g in (0.8, 1.0, 1.5):
        n = {r.s: r.j for r in table.select("s", decide.best_count(F.col("q"), g).alias("j")).collect()}
        assert n[0] == 30
        f = []
        for s in range(len(lists)):
            labels = [r[5] for r in rows if r[1] == s]
            tp, t = sum(labels[: n[s]]), sum(labels)
            f.append(1.0 if n[s] == t == 0 else 0.0 if 0 in (n[s], t) else 1.25 * tp / (n[s] + 0.25 * t))
        assert got["none", f"expected {g:.2f}"] == pytest.approx(sum(f) / len(f))


def test_similarity_columns_are_the_plain_ones(spark):
    rng = random.Random(14)
    words = ["red", "ring", "a", "blue", "works", "ab"]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 5))), " ".join(rng.choices(words, k=rng.randint(0, 5)))) for _ in range(300)] + [(None, "a"), ("a", None)]
    a, b = F.col("a"), F.col("b")
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", similarity.token_set_ratio(a, b), similarity.ratio(a, b), similarity.partial_ratio(a, b), similarity.jaro_winkler(a, b)).collect()
    for x, y, *values in got:
        if x is None or y is None:
            assert values[1:] == [None] * 3
        else:
            assert values == pytest.approx([similarity.set_ratio_of(x, y), similarity.ratio_of(x, y), similarity.partial_ratio_of(x, y), similarity.jaro_winkler_of(x, y)], abs=1e-4), (x, y)


def test_link_tokens(spark):
    rows = [(2, 0, "US", 5, "x (ID: 77) y id:9", ""), (2, 1, "US", 5, "ID 77 #Tag_1 #12", ""), (2, 2, "US", -3, "call +1 (555) 010-1234 @me.you", ""), (3, 3, "US", -4, "WWW.Shop.COM shop.com", "555 0101234 1")]
    table = spark.createDataFrame(rows, "src int, idx int, country string, entity long, name_raw string, addr_raw string")
    tok = lambda k: sorted((r.idx, r.tok) for r in audit.link_tokens(table, k).collect())
    assert tok("id_tag") == [(0, "77"), (0, "9"), (1, "77")] and tok("hash_tag") == [(1, "Tag_1")] and tok("handle") == [(2, "me.you")]
    assert tok("domain") == [(3, "shop.com")] and tok("phone") == [(2, "15550101234"), (3, "55501012341")]
    report = {r.kind: r for r in audit.token_report(table).collect()}
    assert (report["id_tag"].n_pairs, report["id_tag"].n_true_pairs, report["id_tag"].n_covered) == (1.0, 1.0, 1) and report["phone"].precision is None


def test_rank_correlation_in_parts(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(rng.randint(0, 60), rng.randint(0, 5)) for _ in range(400)]

    def rank(values):
        order = sorted(values)
        return [(order.index(v) + len(order) - 1 - order[::-1].index(v)) / 2 for v in values]

    x, y = rank([a for a, _ in rows]), rank([b for _, b in rows])
    mx, my = sum(x) / len(x), sum(y) / len(y)
    rho = sum((p - mx) * (q - my) for p, q in zip(x, y)) / (sum((p - mx) ** 2 for p in x) * sum((q - my) ** 2 for q in y)) ** 0.5
    assert audit.spearman(spark.createDataFrame(rows, "a int, b int"), "a", "b").first()["rho"] == pytest.approx(rho)


@pytest.mark.parametrize("pred,true,expected", [("S2-00047 S2-00193 S3-00812", "S2-00047 S3-00812", 0.7142857), ("", "", 1.0), ("S2-1", "", 0.0), ("", "S2-1 S3-2", 0.0), ("S2-1 S3-2 S3-3", "S3-3 S2-1 S3-2", 1.0)])
def test_entity_scores(spark, pred, true, expected):
    row = spark.createDataFrame([(pred.split(), true.split())], "p array<string>, t array<string>")
    assert row.select(metrics.entity_f05(F.col("p"), F.col("t"))).first()[0] == pytest.approx(expected, abs=1e-6)


def test_macro_scores(spark):
    truth = spark.createDataFrame([("a", "US", []), ("b", "US", ["S2-1"]), ("c", "France", ["S3-9"])], "s1_id string, country string, ids array<string>")
    pred = spark.createDataFrame([("b", ["S2-1"]), ("zz", ["S2-7"])], "s1_id string, ids array<string>")
    got = {(r.slice, r.value): (r.n, round(r.score, 6)) for r in metrics.macro(metrics.per_record(truth, pred)).collect()}
    assert got == {("overall", "all"): (3, 0.666667), ("type", "singleton"): (1, 1.0), ("type", "matched"): (2, 0.5), ("country", "US"): (2, 1.0), ("country", "France"): (1, 0.0)}


def test_tsv_round_trip(spark, tmp_path):
    path = tmp_path / "train_source1.tsv"
    path.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tsay "hi"\t\tUS\nS1-2\tNA\tnull\tFrance\nS1-3\ta\\b\t"x\tUS\n', encoding="utf-8")
    rows = [tuple(r) for r in tsv.read_tsv(spark, str(path)).orderBy("entity_id").collect()]
    assert rows == [("S1-1", 'say "hi"', "", "US"), ("S1-2", "NA", "null", "France"), ("S1-3", "a\\b", '"x', "US")]
    order = spark.createDataFrame([(0, "S1-9"), (1, "S1-10")], "idx int, s1_id string")
    matches = spark.createDataFrame([("S1-10", "S3-2"), ("S1-10", "S2-5"), ("S1-10", "S2-5")], "s1_id string, rec_id string")
    out = tmp_path / "out"
    tsv.write_id_lists(tsv.id_lists(order, matches), str(out))
    text = next(out.glob("part-*")).read_text()
    assert text == "source1_entity_id\tmatched_entity_ids\nS1-9\t\nS1-10\tS2-5,S3-2\n"
    with pytest.raises(ValueError):
        tsv.load_split(spark, str(tmp_path), "dev")


def test_truth_must_resolve(spark):
    rec = spark.createDataFrame([("S1-1", 1, 0, "US"), ("S2-1", 2, 0, "US")], "entity_id string, src int, idx int, country string")
    good = spark.createDataFrame([("S1-1", ["S2-1"])], "s1_id string, ids array<string>")
    assert [tuple(r) for r in tsv.truth_pairs(good, rec).collect()] == [(0, 2, 0, "US")]
    with pytest.raises(ValueError):
        tsv.truth_pairs(spark.createDataFrame([("S1-1", ["S2-9"])], "s1_id string, ids array<string>"), rec)


def test_validator(spark):
    need = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "s1_id string")
    lines = ["source1_entity_id,matched", "S1-1\tS2-1,S2-1", "S1-1\t", "S1-2\tS2-1, S3-2", "S1-9\tS1-4", "broken"]
    got = {r.rule: r.n for r in audit.validate(spark.createDataFrame(list(enumerate(lines)), "line long, value string"), need).collect()}
    assert got == {"header without one tab": 1, "wrong header": 1, "row without one tab": 1, "repeated row": 1, "repeated id": 1, "first-source id": 1, "wrong prefix": 1, "missing row": 1, "extra row": 1}


def test_blocking_small(spark):
    rows = [("US", 1, 0, "red ring", "rd rng", "", "12 main street", "12"), ("US", 2, 0, "red ring", "rd rng", "", "12 main street", "12"), ("US", 2, 1, "solo", "sl", "", "", None), ("France", 1, 0, "red ring", "rd rng", "", "", None)]
    rec = spark.createDataFrame(rows, "country string, src int, idx int, name_core string, name_phon string, name_alt string, addr_core string, house_num string").withColumn("name_concat", F.replace(F.col("name_core"), F.lit(" "), F.lit("")))
    keys = blocking.keys(rec)
    pairs = blocking.candidate_pairs(keys, blocking.blocks(keys)).collect()
    assert [(r.country, r.s1, r.src, r.idx) for r in pairs] == [("US", 0, 2, 0)]
    assert pairs[0].bits == 0b11101111 and {r.idx for r in keys.filter("src = 2 and idx = 1").collect()} <= {1}


def test_votes(spark):
    rows = [("k", "a")] * 3 + [("k", "b")] * 2 + [("m", "x")] * 2 + [("n", "a")] * 3 + [("n", "b")] * 3
    assert [tuple(r) for r in kept(spark.createDataFrame(rows, "key string, value string")).collect()] == [("k", "a", 3)]


def test_learned_states(spark):
    rows = [("दिल्ली,नगर", ["delhi", "nagar"], "dl")] * 4 + [("दिल्ली,क", ["delhi"], "")] + [("गोआ", ["x"], "ga")] * 3
    got = {r["key"]: r["value"] for r in learn_states(spark.createDataFrame(rows, "noisy_addr string, s1_components array<string>, state string")).collect()}
    assert got == {"गोआ": "ga", "दिल्ली": "dl"}  # नगर sounds like another component of the first source's address


def test_learning_folds(spark):
    rows = spark.createDataFrame([("US", i % 40, 2, i, float(i % 7), None if i % 5 == 0 else 1.0, int(i % 7 > 3)) for i in range(400)], "country string, s1 int, src int, idx int, x double, y double, label int")
    ids = rows.select("country", "s1").distinct().withColumn("entity_id", F.concat(F.lit("S1-"), F.col("s1").cast("string")))
    full, cols = learning.filled(learning.folds(rows, ids), ["x", "y"], ["y"])
    got, models = learning.out_of_fold(full, cols, share=1.0, rounds=3, depth=2)
    assert got.count() == 400 and learning.area(got) > 0.95
    assert learning.importances(models[0], cols)[0][0] == "x"
    assert learning.calibration_table(got).agg(F.sum("n")).first()[0] == 400


def test_models_are_saved_averaged_and_told_apart(spark, tmp_path):
    rows = [("US" if i % 3 else "France", i % 40, 2, i, float(i % 7), float(i % 11) + (5.0 if i % 2 else 0.0), int(i % 7 > 3)) for i in range(400)]
    table = spark.createDataFrame(rows, "country string, s1 int, src int, idx int, x double, y double, label int")
    full, cols = learning.filled(learning.folds(table, table.select("country", "s1").distinct().withColumn("entity_id", F.concat_ws("-", "country", F.col("s1").cast("string")))), ["x", "y"], [])
    _, models = learning.out_of_fold(full, cols, share=1.0, rounds=2, depth=2)
    learning.save_models(models, str(tmp_path / "models"))
    learning.save_models(models, str(tmp_path / "models"))
    again = learning.load_models(str(tmp_path / "models"), 2)
    key = lambda ms: sorted((r.idx, r.p_m0, r.p_m1, r.p) for r in learning.averaged(full, ms).collect())
    assert key(again) == key(models)
    assert all(p == pytest.approx((a + b) / 2) for _, a, b, p in key(models))
    score, top = learning.adversarial(full.filter("idx % 2 = 0"), full.filter("idx % 2 = 1"), cols, 3)
    assert score > 0.6 and top[0][0] == "y" and top[0][3] > top[0][2]
    assert learning.feature_columns(full, drop=("y",)) == ["x"]
    refit = learning.refit_with_pseudo(full, full.withColumn("p", F.col("label").cast("double")), cols, "US", "France", 2)
    assert refit.count() == full.filter("country = 'France'").count() and learning.area(refit) > 0.9
    assert learning.rank_shift([("a", 1.0), ("b", 0.5)], [("b", 1.0), ("a", 0.5)])[0][1] in (1, -1)
    more = full.filter("idx < 10").select("country", "s1", "src", "idx", F.lit(7).alias("z"))
    assert learning.augmented(full, more).agg(F.count(F.lit(1)), F.sum("z")).first()[:] == (400, 70)


def test_long_cities(spark):
    name = "dadra and nagar haveli and daman and diu"
    rows = spark.createDataFrame([("I", 2, 0, [f"near {name} road"]), ("I", 2, 1, ["daman and"])], "country string, src int, idx int, components array<string>")
    cities = spark.createDataFrame([(name, "dn"), ("daman", "dd")], "city string, region string")
    assert {r.idx: r.region_found for r in audit.find_region(rows, cities).collect()} == {0: "dn", 1: "dd"}


def test_regions(spark):
    comps = spark.createDataFrame([("lille", "hdf")] * 3 + [("lyon", "ara")] * 3 + [("ville", "hdf"), ("ville", "ara"), ("ville", "ara")], "component string, region string")
    cities = audit.region_cities(comps, 3)
    assert {tuple(r) for r in cities.collect()} == {("lille", "hdf"), ("lyon", "ara")}
    rows = spark.createDataFrame([("F", 2, 0, ["lille"]), ("F", 2, 1, ["rue de lyon"]), ("F", 2, 2, ["lille x lyon lyon"]), ("F", 2, 3, ["x"])], "country string, src int, idx int, components array<string>")
    got = {r.idx: r.region_found for r in audit.find_region(rows, cities).collect()}
    assert got == {0: "hdf", 1: "ara", 2: "hdf", 3: ""}


def test_stream_linker(spark, tmp_path):
    from kinlink.streaming.linker import link_stream

    cols = "country string, src int, idx int, name_core string, name_phon string, name_alt string, name_concat string, addr_core string, house_num string"
    ones = spark.createDataFrame([("US", 1, 0, "red ring", "rd rng", "", "redring", "main street", None)], cols)
    spark.createDataFrame([("US", 2, 5, "red ring", "rd rng", "", "redring", "main street", None)], cols).write.parquet(str(tmp_path / "in"))
    seen = []
    run = link_stream(ones, spark.readStream.schema(cols).parquet(str(tmp_path / "in")), lambda df, n: seen.extend((r.s1, r.idx, r.rank_s) for r in df.collect()), str(tmp_path / "cp"))
    run.processAllAvailable()
    run.stop()
    assert seen == [(0, 5, 1)]
