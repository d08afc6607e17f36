"""Golden cases of the normalisers, similarities against definitions, and decisions, models, sources and sinks."""

import random

import pytest
from pyspark.sql import functions as F

from kinfold.functions import similarity as S
from kinfold.functions import text as X
from kinfold.functions import translit as T
from kinfold.operators import decisions as D
from kinfold.operators import dictionaries as L
from kinfold.operators import features as P
from kinfold.operators import models as M
from kinfold.operators import retrieval as R
from kinfold.operators import sampling as A
from kinfold.sources import readers, sinks


def names(spark, *rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, name string, country string")
    return X.with_name_views(df, "name", "country").orderBy("i").collect()


def addresses(spark, *rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, address string, country string")
    return X.with_addr_views(df, "address", "country").orderBy("i").collect()


def test_names(spark):
    alias, accent, handle, web, glued, dotted, france, native, initials, none, short = names(
        spark,
        ("Jaxevo trading as Mansfield Devices", "US"),
        ("Esparza Ridge Sunrise Ínc", "US"),
        ("@bachmannsbistro", "US"),
        ("capitalholding.com", "US"),
        ("UrologypartnersCom", "US"),
        ("Dss Care L.L.P.", "India"),
        ("Gagny (France) Club (S.A.R.L.)", "France"),
        ("कृष्ण फाइनेंस प्राइवेट लिमिटेड", "India"),
        ("Gallagher Crystal John LLC", "US"),
        (None, None),
        ("The Co", "US"),
    )
    assert (alias.name_core, alias.name_dba) == ("mansfield devices", True)
    assert accent.name_core == "esparza ridge sunrise" and handle.name_handle
    assert web.name_core == "capitalholding" and (glued.name_core, glued.name_handle) == ("urologypartners", True)
    assert dotted.legal == "llp" and france.name_core == "gagny club"
    assert native.name_native and "फाइनेंस" in native.name_core and native.name_nospace == ""
    assert initials.name_acr == "gcj"
    assert (none.name_core, none.name_ntok, none.legal) == ("", 0, "")
    assert (short.name_core, short.legal) == ("co", "co")


def test_addresses(spark):
    a, b, zero, empty, null, rue, unit, native, none = addresses(
        spark,
        ("108 2ST ST, PMB 3330, ROME, OH", "US"),
        ("OH, 108 2nd Street, Rome", "US"),
        ("008644 ASHLEY GLEN CIRCLE", "US"),
        ("", "US"),
        ("1130 RIVER ROCK COURT, NULL, KIEL, WI", "US"),
        ("N° 50 R. DE LA BENAUGE, BORDEAUX", "France"),
        ("Flat 12b Tenth Road 000", "US"),
        ("१२ रोड", "India"),
        (None, None),
    )
    assert set(a.addr_core.split()) == set(b.addr_core.split()) and a.addr_nums == "108 2"
    assert zero.addr_primary == "8644" and empty.addr_empty and none.addr_empty
    assert null.addr_core == "1130 river rock ct kiel wi"
    assert "rue" in rue.addr_core.split() and rue.addr_primary == "50"
    assert (unit.addr_core, unit.addr_nums) == ("flat 12 b 10 rd 0", "12 10 0")
    assert native.addr_primary == "12"


def test_retrieval_texts(spark):
    r = spark.createDataFrame([("internati0na1 r0opesh id 64721 b1 2nd", "12 main st")], "n string, a string")
    name, combo, dedup = r.select(X.clean_name(F.col("n")), X.retrieval_text("combo", F.col("n"), F.col("a")), X.dedup_tokens(F.lit("a a b b a"))).first()
    assert name == "international roopesh b1 2nd" and combo == "n:international n:roopesh n:b1 n:2nd 12 main st" and dedup == "a b a"
    parts = X.with_components(spark.createDataFrame([("12 Rue É, Paris ; ; Île-de-France",), (None,), ("मुंबई, MH",)], "a string"), "a").collect()
    assert [p.components for p in parts] == [["12 rue e", "paris", "ile de france"], [], ["मुंबई", "mh"]]


def test_spellings_follow_the_names():
    # k + virama + ssa + long i; an independent long vowel; nukta, which says nothing, between consonant and sign.
    assert T.romanise("क्षी") == "kssi" and T.romanise("आम") == "ama" and T.romanise("क़ि") == "ki" and T.romanise("") == ""
    assert T.romanise("কলকাতা") == "kalakata" and T.romanise("৪২") == "42"


def test_learned_tokens_do_not_depend_on_partitions(spark):
    import random

    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    rows = []
    for _ in range(400):
        own = [rng.choice(words) for _ in range(rng.randrange(1, 5))]
        rows.append((" ".join(own), " ".join(x + "q" for x in own) + rng.choice(["", "", " zzq"])))
    rows += rows[:50]
    pairs = spark.createDataFrame(rows, "latin string, native string")
    other = pairs.join(pairs.distinct().withColumnRenamed("latin", "l"), "native").where("latin = l").drop("l")
    got = [sorted(map(tuple, L.learn_tokens(p, "latin", "native", F.col("t").endswith("q")).collect())) for p in (pairs, pairs.orderBy(F.rand(1)).repartition(7), other.repartition(3))]
    assert got[0] == got[1] == got[2] and {f"{w}q" for w in words} <= {n for n, _ in got[0]} and all(n[:-1] == b for n, b in got[0] if n != "zzq")


def test_ranks_by_bins_are_those_of_one_sort(spark):
    import hashlib

    rows = [(i, "ab"[i % 3 == 0] if i % 7 else None) for i in range(500)]
    got = {r.k: (r["__r"], r["__n"]) for r in A.ranked(spark.createDataFrame(rows, "k long, s string"), "k", 5, ["s"]).collect()}
    for part in ("a", "b", None):
        own = sorted((hashlib.md5(f"5:{k}".encode()).hexdigest(), k) for k, s in rows if s == part)
        assert [got[k] for _, k in own] == [(i + 1, len(own)) for i in range(len(own))]


def test_romanise_and_apply(spark):
    assert T.romanise("कमल") == "kamala" and T.romanise("किरण") == "kiranna" and T.romanise("रोड") == "rodda" and T.romanise("१२") == "12" and T.romanise("सं") == "san"
    d = spark.createDataFrame([(1, "shop कमल रोड 5"), (2, "plain"), (3, None)], "id int, t string")
    learned = spark.createDataFrame([("रोड", "road")], "native string, latin string")
    out = {r.id: r.t for r in T.apply_dictionary(d, "id", "t", T.dictionary_for(d, "t", learned)).collect()}
    assert out[1].split() == ["shop", "kamala", "road", "5"] and out[2] == "plain" and out[3] is None
    got = spark.range(1).select(T.with_map(F.lit("a रोड"), F.create_map(F.lit("रोड"), F.lit("road")))).first()[0]
    assert got.split() == ["a", "road"]


def test_similarities_of_definition():
    def slow_lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(max(new[j], row[j + 1], row[j] + (x == y)))
            row = new
        return row[-1]

    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abc ") for _ in range(rng.randrange(12)))
    for _ in range(400):
        a, b = word(), word()
        n = len(a) + len(b)
        assert S.ratio(a, b) == pytest.approx(100.0 if not n else 200 * slow_lcs(a, b) / n)
        assert S.ratio(a, b) == pytest.approx(S.ratio(b, a)) and S.partial_ratio(a, b) == pytest.approx(S.partial_ratio(b, a))
        assert S.token_set_ratio(a, b) == pytest.approx(S.token_set_ratio(b, a))
        x, y = (" ".join(sorted(set(t.split()))) for t in (a, b))
        if x and y:
            assert S.token_set_ratio(a, b) >= S.ratio(x, y) - 1e-9
    assert S.ratio("", "") == S.partial_ratio("", "") == 100 and S.token_set_ratio("", "") == S.token_set_ratio("", "a") == 0 and S.partial_ratio("", "a") == 0
    assert S.token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100 and S.token_sort_ratio("a b", "b a") == 100
    assert S.partial_ratio("this is a test", "this is a test!") == 100 and S.ratio("this is a test", "this is a test!") == pytest.approx(96.551724)
    assert S.jaro_winkler("MARTHA", "MARHTA") == pytest.approx(0.961111, abs=1e-6) and S.jaro_winkler("DIXON", "DICKSONX") == pytest.approx(0.813333, abs=1e-6)
    assert S.jaro_winkler("", "") == 1 and S.jaro_winkler("a", "") == 0


def scored(spark):
    return spark.createDataFrame([("A", "x", 0.9), ("A", "y", 0.5), ("B", "x", 0.6), ("B", "z", 0.3)], "s1_id string, cand_id string, p double")


def test_decisions(spark):
    assert {r.s1_id: r.matches for r in D.decide(scored(spark), 0.2, 0.45).collect()} == {"A": ["x", "y"], "B": ["z"]}
    truth = spark.createDataFrame([("A", "x"), ("A", "y"), ("B", "z")], "s1_id string, cand_id string")
    ents = spark.createDataFrame([("A",), ("B",)], "s1_id string")
    assert tuple(D.tune(scored(spark), truth, ents, (0.2,), (0.45,)).first()) == (0.2, 0.45, 1.0)
    pred = spark.createDataFrame([("A", "1"), ("A", "2"), ("A", "3"), ("C", "9")], "s1_id string, cand_id string")
    true = spark.createDataFrame([("A", "1"), ("A", "3"), ("D", "1")], "s1_id string, cand_id string")
    who = spark.createDataFrame([(e,) for e in "ABCD"], "s1_id string")
    f = {r.s1_id: r.f for r in D.entity_counts(pred, true, who).select("s1_id", D.f_half(F.col("tp"), F.col("pred"), F.col("true")).alias("f")).collect()}
    assert f == {"A": pytest.approx(0.7142857), "B": 1.0, "C": 0.0, "D": 0.0}
    assert D.macro_f(pred, true, who).first()[0] == pytest.approx((0.7142857 + 1) / 4, abs=1e-6)
    assert D.macro_f(pred, true, who.limit(0)).first()[0] is None


def test_tuning_against_every_pair_of_thresholds(spark):
    rng = random.Random(2)
    rows = [(e, c, rng.randrange(20) / 20) for e in range(12) for c in range(e * 5, e * 5 + 6)]
    truth = [(e, c) for e, c, _ in rows if rng.random() < 0.4]
    g1, g2 = (0.1, 0.3, 0.5), (0.2, 0.4, 0.6, 0.8)
    df = spark.createDataFrame(rows, "s1_id int, cand_id int, p double")
    t, ents = spark.createDataFrame(truth, "s1_id int, cand_id int"), spark.createDataFrame([(e,) for e in range(14)], "s1_id int")
    best = (-1,)
    for a in g1:
        for b in g2:
            if b >= a:
                d = D.decide(df, a, b).select("s1_id", F.explode("matches").alias("cand_id"))
                f = D.macro_f(d, t, ents).first()[0]
                best = max(best, (f, -a, -b))
    got = D.tune(df, t, ents, g1, g2).first()
    assert (got.f05, -got.t1, -got.t2) == pytest.approx(best)


def test_top_k_against_cross_join(spark):
    rng = random.Random(3)
    rows = [(i, "q" if i < 10 else "p", "b" + str(i % 2), " ".join(rng.choice(["ab", "cd", "ef", "gh", "ij"]) for _ in range(rng.randrange(5)))) for i in range(50)]
    w = R.tfidf(spark.createDataFrame(rows, "id int, side string, block string, t string"), R.word_terms(F.col("t")), key=["id", "side"], block=["block"], min_df=1).cache()
    q, p = w.where("side = 'q'").withColumnRenamed("id", "s1_id").drop("side"), w.where("side = 'p'").withColumnRenamed("id", "cand_id").drop("side")
    got = R.top_k(q, p, 3, ["block"])
    vec = {}
    for r in w.collect():
        vec.setdefault(r.id, {})[r.term] = r.w
    assert all(sum(x * x for x in v.values()) == pytest.approx(1) for v in vec.values())
    want = set()
    for i in range(10):
        s = sorted((-round(sum(vec.get(i, {}).get(t, 0) * x for t, x in vec.get(j, {}).items()), 6), j) for j in range(10, 50) if j % 2 == i % 2)
        want |= {(i, j) for c, j in s[:3] if c < -1e-6}
    assert {(r.s1_id, r.cand_id) for r in got.collect()} == want
    assert R.verify_top_k(got, q, p, 3, ["block"]).count() == 0
    assert R.verify_top_k(got.where("rank > 1"), q, p, 3, ["block"]).count() > 0
    assert spark.range(1).select(R.char_terms(F.lit("ab c"))).first()[0] == [" ab", "ab ", " c "]


def test_regions_and_tokens(spark):
    parts = [(i, "US", ["1 main", "rome", "ohio"]) for i in range(6)] + [(10, "US", ["rome"]), (11, "US", ["x", "big rome"]), (12, "US", ["ohio", "rome", "y"]), (13, "US", []), (14, "US", ["zz"])]
    p = spark.createDataFrame(parts, "id int, block string, components array<string>")
    voc = L.region_vocabulary(p, 5, 0.8)
    cmap = L.component_regions(p, voc, 3, 0.9)
    assert {r.component for r in voc.collect()} == {"ohio"} and ("rome", "ohio") in {(r.component, r.region) for r in cmap.collect()}
    got = {r.id: r.region for r in L.assign_regions(p, voc, cmap).collect()}
    assert got == {**{i: "ohio" for i in range(6)}, 10: "ohio", 11: "ohio", 12: "ohio", 13: "", 14: ""}
    pairs = spark.createDataFrame([("lotus road", "कमल रोड"), ("lotus lane", "कमल लेन"), ("old road", "रोड पुराना x"), ("lotus", "lotus")], "a string, b string")
    assert {(r.native, r.latin) for r in L.learn_tokens(pairs, "a", "b").collect()} >= {("कमल", "lotus"), ("रोड", "road")}


def test_samples_folds_and_negatives(spark):
    rows = spark.range(200).select(F.col("id").alias("s1_id"), (F.col("id") % 3).cast("string").alias("block"))
    d = A.disjoint(rows, "s1_id", "block", [(0.1, 1), (0.1, 2)]).collect()
    assert len({r.s1_id for r in d}) == len(d) and sum(r.sample == 0 for r in d) == 21
    f = A.folds(rows, "s1_id", 4, 42).groupBy("fold").count().collect()
    assert [r["count"] for r in f] == [50] * 4
    pos = spark.createDataFrame([(1, 10, "a"), (1, 11, "a"), (2, 12, "b")], "s1_id long, cand_id long, part string")
    pool = spark.createDataFrame([(10, "a"), (11, "a"), (13, "a"), (12, "b")], "cand_id long, part string")
    assert {(r.s1_id, r.cand_id, r.negative) for r in A.negatives(pos, pool, ["part"], 1).collect()} == {(1, 10, 13), (1, 11, 13)}


def test_models_and_scorers(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i % 60, i, float(i % 2) + rng.random() * 0.3 if i % 9 else None, rng.random(), i % 2) for i in range(240)]
    df = spark.createDataFrame(rows, "s1_id int, cand_id int, x double, noise double, label int")
    out, models = M.out_of_fold(df, ["x", "noise"], n_folds=2, rounds=4, depth=2)
    r = out.collect()
    assert len(r) == 240 and sum((x.p > 0.5) == x.label for x in r if x.x is not None) > 0.95 * sum(x.x is not None for x in r)
    assert M.importances(models[0], ["x", "noise"])[0][0] == "x"
    M.save(models[0], f"{tmp_path}/m")
    a = M.predict(M.load(f"{tmp_path}/m"), df, ["x", "noise"]).orderBy("cand_id").collect()
    assert [x.p for x in a] == [x.p for x in M.predict_mean([models[0]] * 2, df, ["x", "noise"]).orderBy("cand_id").collect()]
    s1 = spark.createDataFrame([(1, "n", "a")], "s1_id int, name string, address string")
    pool = spark.createDataFrame([(2, "m", None)], "cand_id int, name string, address string")
    t = M.pair_texts(spark.createDataFrame([(1, 2)], "s1_id int, cand_id int"), s1, pool)
    assert t.first().asDict() == {"s1_id": 1, "cand_id": 2, "text_a": "n ; a", "text_b": "m ; "}
    assert M.score_texts(t, lambda x, y: [float(len(i) + len(j)) for i, j in zip(x, y)]).first().ce_p == 9.0
    assert M.embed(s1.select("s1_id", F.col("name").alias("text")), lambda x: [[1.0, 2.0]] * len(x)).first().vec == [1.0, 2.0]
    assert M.pseudo_label(df, a and M.predict(models[0], df.drop("label"), ["x", "noise"]), 0.2, 0.8).where("pseudo").count() > 0
    joined = P.scored(df.select("s1_id", "cand_id").limit(3), spark.createDataFrame([], "s1_id int, cand_id int, ce_p double"))
    assert joined.where("ce_rank is null and ce_n50 = 0").count() == 3 and P.optional(joined) == ["ce_p", "ce_rank", "ce_gap", "ce_n50"]


def test_similarities_of_many_pairs():
    """On arrays as one by one, to the last bit: empty and long texts, shared tokens, any character."""
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abc1 2é𝒳\0", weights=[5, 5, 3, 3, 4, 2, 1, 1, 1], k=rng.choice([0, 1, 3, 8, 20, 40, 63, 64, 65, 90])))
    a = [word() for _ in range(600)]
    b = [rng.choice([word(), x, x[::-1], x[:-1]]) for x in a]
    for many, one in ((S.ratios, S.ratio), (S.token_sort_ratios, S.token_sort_ratio), (S.token_set_ratios, S.token_set_ratio), (S.partial_ratios, S.partial_ratio)):
        assert many(a, b).tolist() == [one(x, y) for x, y in zip(a, b)]


def test_sources_and_sinks(spark, tmp_path):
    f = tmp_path / "train"
    f.mkdir()
    lines = ["entity_id\tbusiness_name\tbusiness_address\tcountry", 'S1-1\t"say ""hi"""\t\tUS', "S1-2\tNA\tnull\tIndia"]
    (f / "train_source1.tsv").write_bytes("\r\n".join(lines).encode() + b"\r\n")
    (f / "train_ground_truth.tsv").write_bytes(b"source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1, S3-2\nS1-2\t\n")
    df = readers.read_source(spark, str(tmp_path), "train", 1)
    assert [tuple(r) for r in df.orderBy("entity_id").collect()] == [("S1-1", 'say "hi"', "", "US"), ("S1-2", "NA", "null", "India")]
    assert [tuple(r) for r in readers.truth_edges(readers.read_truth(spark, str(tmp_path))).collect()] == [("S1-1", "S2-1"), ("S1-1", "S3-2")]
    (f / "train_source2.tsv").write_bytes("\n".join(lines).encode())
    with pytest.raises(ValueError):
        readers.read_source(spark, str(tmp_path), "train", 2)
    assert {r.problem for r in readers.violations(df.unionByName(df), "S1-").collect()} == {"repeated"}
    with pytest.raises(FileNotFoundError):
        readers.resolve(spark, str(tmp_path / "no"))
    assert readers.find(spark, [str(tmp_path / "no"), str(tmp_path)], "train_source1.tsv").endswith("train/train_source1.tsv")
    ents = spark.createDataFrame([("S1-2", 0), ("S1-1", 1)], "s1_id string, pos int")
    lists = spark.createDataFrame([("S1-1", ["S2-1", "S3-2", "S2-1"])], "s1_id string, ids array<string>")
    sinks.write_id_lists(sinks.id_lists(ents, lists, "candidate_entity_ids"), f"{tmp_path}/out", "candidate_entity_ids")
    (part,) = list((tmp_path / "out").glob("part-*"))
    assert part.read_bytes() == b"source1_entity_id\tcandidate_entity_ids\nS1-2\t\nS1-1\tS2-1,S3-2\n"
    back = sinks.read_id_lists(spark, f"{tmp_path}/out", "candidate_entity_ids")
    known = spark.createDataFrame([("S2-1",), ("S3-2",)], "cand_id string")
    assert sinks.check_lists(back, back, ents, known).count() == 0
    assert tuple(sinks.list_stats(back).first()) == (2, 1, 1.0)
    bad = back.unionByName(spark.createDataFrame([("S1-9", ["X-1", "X-1"])], "s1_id string, ids array<string>"))
    assert {r.problem for r in sinks.check_lists(bad, back, ents, known).collect()} == {"matches: repeated id", "matches: prefix", "matches: unknown id", "matches: surplus row", "match is no candidate"}
    sinks.write_json(spark, {"a": [1, "é"]}, f"{tmp_path}/j")
    assert sinks.read_json(spark, f"{tmp_path}/j") == {"a": [1, "é"]}
    sinks.write_parquet(df.withColumn("split", F.lit("train")).withColumn("src", F.lit(1)), f"{tmp_path}/rec", ["split", "src", "country"])
    assert readers.read_records(spark, f"{tmp_path}/rec", "train", 1, "US", ["entity_id"]).collect()[0][0] == "S1-1"


def test_frequent_names_are_linked(spark, tmp_path):
    # 60 pool rows of one country and source bear the name of a record: over the cap of the exact pass.
    from kinfold.plans.queries import QUERIES

    part = [(i, "green linen", "ECONOMY", "Brand#1", 5) for i in (31, *range(6, 6 + 60 * 40, 40))]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_type string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    pool = ",".join(str(i) for i in range(6, 6 + 60 * 40, 40))
    assert [(r.s1_id, r.matches) for r in QUERIES["link_records"](spark, str(tmp_path)).collect()] == [(31, pool)]
    assert QUERIES["features_similarities"](spark, str(tmp_path)).count() == 60 and QUERIES["exact_name"](spark, str(tmp_path)).count() == 0


def test_topk_verify_covers_both_sources(spark, monkeypatch):
    from kinfold.plans import queries

    whole = R.top_k
    monkeypatch.setattr(queries.R, "top_k", lambda *a, **k: whole(*a, **k).where("cand_id % 10 < 6"))  # loses source 3
    assert queries.QUERIES["topk_verify"](spark, "/root/testdata/sf0.001").count() > 0
