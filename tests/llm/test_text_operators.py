"""Operators on documents against brute force, and their edge cases."""

import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.llm import decontaminate, langid, linear, lm, mixing, simhash, toxicity
from kinfold.llm.common import words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor sit amet " * 40_000


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], DOCS)


def odd(spark):
    """Nulls everywhere, empty, blank and long texts, repeated rows, large ids, and columns with clashing names."""
    rows = [(1, None, None, None), (None, "some words here", "en", "a"), (2, "", "en", "a"), (3, " \n\t", None, "b"), (4, LONG, "en", None), (5, "same same text here now", "de", "a"), (5, "same same text here now", "de", "a"), (2**60 + 1, "ärger über größe", "de", ""), (6, None, "en", "a")]
    return docs(spark, rows).withColumn("score", F.lit("x")).withColumn("fp", F.lit(1)).withColumn("component_id", F.lit(0)).withColumn("size", F.lit("s")).withColumn("__text", F.lit(2)).withColumn("held_out", F.lit(None).cast("string"))


def some_words(rng, n, stock=None):
    return " ".join(rng.choice(stock or ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]) + str(rng.randrange(50)) for _ in range(n))


class TestSimHash:
    def brute(self, rows, distance=4):
        """rows of (id, text) -> {id: (fingerprint, smallest id reachable)}."""
        f = {i: simhash.fingerprint(t) for i, t in rows}
        comp = {i: i for i in f}
        changed = True
        while changed:
            changed = False
            for a in f:
                for b in f:
                    if (f[a] ^ f[b]).bit_count() <= distance and comp[b] < comp[a]:
                        comp[a], changed = comp[b], True
        return {i: (f"{f[i]:016x}", comp[i]) for i in f}

    def test_fingerprint_of_definition(self, spark):
        text = "A b\tC d e\nf"
        w = text.lower().split()
        parts = [" ".join(w[i : i + 4]) for i in range(3)]
        h = [spark.range(1).select(F.xxhash64(F.lit(p))).first()[0] % 2**64 for p in parts]
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > 3)
        assert simhash.fingerprint(text) == want
        assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
        assert simhash.fingerprint("One two") == spark.range(1).select(F.xxhash64(F.lit("one two"))).first()[0] % 2**64

    def test_against_brute_force(self, spark):
        rng = random.Random(1)
        base = [some_words(rng, rng.randrange(1, 120)) for _ in range(40)]
        rows = list(enumerate(base))
        for t in base[:25]:
            w = t.split()
            for _ in range(4):
                v = list(w)
                v[rng.randrange(len(v))] = "changed"
                rows.append((len(rows), " ".join(v)))
        rows += [(len(rows), None), (len(rows) + 1, "")]
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs(spark, [(i, t, None, None) for i, t in rows])).collect()}
        assert got == self.brute(rows)

    @pytest.mark.parametrize("distance", [1, 3, 4, 6])
    def test_links_by_popcounts_miss_nothing(self, spark, distance):
        rng = np.random.default_rng(distance)
        f = rng.integers(0, 2**63, 60, dtype=np.uint64)
        near = [int(x) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 9), replace=False)) for x in np.repeat(f, 4)]
        all_ = sorted({int(x) for x in f} | set(near))
        groups = spark.createDataFrame([(x - 2**64 if x >> 63 else x, i) for i, x in enumerate(all_)], "fp long, rep long")

        def components(edges):
            comp = list(range(len(all_)))

            def find(x):
                while comp[x] != x:
                    x = comp[x]
                return x

            for a, b in edges:
                comp[max(find(a), find(b))] = min(find(a), find(b))
            return [find(i) for i in range(len(all_))]

        near = [(i, j) for i in range(len(all_)) for j in range(i) if (all_[i] ^ all_[j]).bit_count() <= distance]
        # As many groups as links within the distance make: none missed, none too many.
        assert components([(r.a, r.b) for r in simhash.links(groups, distance).collect()]) == components(near)

    def test_steps_give_the_manhattan_distance_of_popcounts(self):
        rng = np.random.default_rng(14)
        f = rng.integers(0, 2**63, 200, dtype=np.uint64)
        counts = [[(int(x) >> 2 * i & 1) + (int(x) >> 2 * i + 1 & 1) for i in range(32)] for x in f]
        steps = simhash._steps(f)
        for i in range(0, 200, 7):
            for j in range(i):
                d = sum(abs(a - b) for a, b in zip(counts[i], counts[j]))
                assert int(np.bitwise_count(steps[i] ^ steps[j])) == d <= int(np.bitwise_count(f[i] ^ f[j]))

    def test_crowded_cells_in_blocks(self, spark, monkeypatch):
        monkeypatch.setattr(simhash, "BLOCK", 3)
        monkeypatch.setattr(simhash, "PAIRS", 7)
        fps = [sum(1 << (2 * b) for b in range(i % 5)) ^ (i << 40) for i in range(40)]
        groups = spark.createDataFrame([(f, i) for i, f in enumerate(dict.fromkeys(fps))], "fp long, rep long")
        rows = [(r.rep, r.fp) for r in groups.collect()]
        from kinfold.llm.components import connected_components

        moved = {r.id: r.component_id for r in connected_components(simhash.links(groups)).collect()}
        comp = {i: i for i, _ in rows}
        for _ in rows:
            for i, f in rows:
                for j, g in rows:
                    if (f ^ g).bit_count() <= 4:
                        comp[i] = min(comp[i], comp[j])
        assert {i: moved.get(i, i) for i, _ in rows} == comp

    def test_odd_rows(self, spark):
        out = simhash.near_duplicates(odd(spark)).collect()
        assert len(out) == 9
        by = Counter((r.doc_id, r.fingerprint == "0" * 16, r.component_id) for r in out)
        assert by[(1, True, 1)] == by[(2, True, 1)] == by[(3, True, 1)] == by[(6, True, 1)] == 1
        assert by[(None, False, None)] == 1 and by[(5, False, 5)] == 2 and by[(2**60 + 1, False, 2**60 + 1)] == 1
        assert simhash.near_duplicates(odd(spark).limit(0)).count() == 0


class TestDecontamination:
    ITEMS = "item_id long, text string"

    def brute(self, rows, items, t=0.8):
        out = set()
        for d, text in rows:
            w = words(text)
            for i, item in items:
                v = words(item)
                k = min(5, len(v))
                if not v or d is None or i is None or not w:
                    continue
                a = {tuple(v[j : j + k]) for j in range(len(v) - k + 1)}
                b = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
                if len(a & b) >= t * len(a):
                    out.add((d, i, len(a), len(a & b)))
        return out

    def test_against_brute_force(self, spark):
        rng = random.Random(2)
        items = [(i, some_words(rng, rng.choice([1, 2, 4, 5, 6, 12, 30, 80]))) for i in range(40)]
        rows = [(i, some_words(rng, rng.choice([1, 20, 400]))) for i in range(60)]
        for i, t in items:
            w = t.split()
            if len(w) > 10:
                w[rng.randrange(len(w))] = "x"
            rows.append((100 + i, f"{some_words(rng, rng.randrange(600))} {' '.join(w).upper()} {some_words(rng, rng.randrange(600))}"))
            rows.append((200 + i, " ".join(w[: len(w) * 2 // 3])))
        got = decontaminate.contaminated(docs(spark, [(i, t, None, None) for i, t in rows]), spark.createDataFrame(items, self.ITEMS)).collect()
        assert {(r.doc_id, r.item_id, r.item_shingles, r.shared) for r in got} == self.brute(rows, items)
        assert all(abs(r.containment - r.shared / r.item_shingles) < 1e-12 for r in got)

    def test_blocks_of_items(self, spark, monkeypatch):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)
        rng = random.Random(3)
        items = [(i, some_words(rng, rng.choice([3, 8, 20]))) for i in range(30)]
        rows = [(i, some_words(rng, 30) + " " + t) for i, t in items]
        got = decontaminate.contaminated(docs(spark, [(i, t, None, None) for i, t in rows]), spark.createDataFrame(items, self.ITEMS)).collect()
        assert {(r.doc_id, r.item_id, r.item_shingles, r.shared) for r in got} == self.brute(rows, items)

    def test_odd_rows(self, spark):
        items = spark.createDataFrame([(1, None), (2, ""), (None, "some words here"), (3, "same text HERE"), (3, "same text HERE"), (4, "ipsum dolor sit amet lorem ipsum"), (5, " ")], self.ITEMS).withColumn("doc_id", F.lit(9))
        got = sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(odd(spark), items).collect())
        assert got == [(4, 4), (5, 3), (5, 3)]
        assert sorted(r.doc_id or -1 for r in decontaminate.clean(odd(spark), items).collect()) == [-1, 1, 2, 3, 6, 2**60 + 1]
        assert decontaminate.contaminated(odd(spark).limit(0), items).count() == decontaminate.contaminated(odd(spark), items.limit(0)).count() == 0

    def test_sketches_are_small_and_miss_as_rarely_as_they_say(self):
        rng = np.random.default_rng(12)
        met = dict.fromkeys((24, 60, 200), 0)
        for q in met:
            for trial in range(300):
                u = int(rng.integers(3000, 12_000))
                item = rng.integers(0, 2**63, q, dtype=np.uint64) * np.uint64(2)
                doc = np.unique(np.concatenate((item[: int(np.ceil(0.8 * q))], rng.integers(0, 2**63, u, dtype=np.uint64) * np.uint64(2))))
                n = decontaminate.bins(decontaminate.size_class(len(doc)), decontaminate.size_class(q), 0.8)
                mine, its = decontaminate.minima(doc, n), decontaminate.minima(np.sort(item), n)
                assert n != decontaminate.ALL and len(mine) < {24: 0.6, 60: 0.35, 200: 0.1}[q] * len(doc)
                met[q] += bool(np.isin(its, mine).any())
        assert min(met.values()) >= 299
        assert decontaminate.bins(20, decontaminate.size_class(4), 0.8) == decontaminate.ALL
        assert decontaminate.jaccard_floor(200, 10_000, 0.8) == pytest.approx(160 / 10_040)

    def test_waves_of_blocks(self, spark, monkeypatch):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)
        monkeypatch.setattr(decontaminate, "WAVE", 2)
        rng = random.Random(13)
        items = [(i, some_words(rng, rng.choice([3, 8, 20]))) for i in range(20)]
        rows = [(i, some_words(rng, 30) + " " + t) for i, t in items] + [(100 + i, some_words(rng, 25)) for i in range(5)]
        d, it = docs(spark, [(i, t, None, None) for i, t in rows]), spark.createDataFrame(items, self.ITEMS)
        assert {(r.doc_id, r.item_id, r.item_shingles, r.shared) for r in decontaminate.contaminated(d, it).collect()} == self.brute(rows, items)
        assert {r.doc_id for r in decontaminate.clean(d, it).collect()} == {100 + i for i in range(5)}

    def test_clean_decides_by_row(self, spark):
        items = spark.createDataFrame([(1, "one two three four five six")], self.ITEMS)
        rows = [(None, "x one two three four five six", None, None), (None, "clean text", None, None), (7, "one two three four five six y", None, None), (7, "clean too", None, None)]
        assert {(r.doc_id, r.text) for r in decontaminate.clean(docs(spark, rows), items).collect()} == {(None, "clean text"), (7, "clean too")}


class TestMixing:
    def test_water_filling(self, spark):
        sizes = {"a": 100, "b": 1000, "c": 10, None: 500, "d": 0}
        t = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        w = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2]))
        want, open_, left = {}, set(sizes), 1.5 * sum(sizes.values())
        while open_:  # stop sources at their cap and reshare, as often as needed
            level = left / sum(w[s] for s in open_)
            over = {s for s in open_ if level * w[s] >= 2 * sizes[s]}
            if not over:
                want |= {s: level * w[s] for s in open_}
                break
            for s in over:
                want[s] = 2.0 * sizes[s]
                left -= want[s]
            open_ -= over
        assert t == pytest.approx(want)

    def test_words_taken_come_near_the_targets(self, spark):
        rng = random.Random(4)
        rows = [(i, some_words(rng, int(rng.paretovariate(1.2) * 10) % 3000), None, rng.choice(["hot"] * 6 + ["s1", "s2", None])) for i in range(1500)]
        out = mixing.copies(docs(spark, rows)).collect()
        assert len(out) == 1500 and all(0 <= r.n_copies <= 2 for r in out)
        for s in ("hot", "s1", "s2", None):
            own = [r for r in out if r.source == s]
            assert sum(r.size for r in own) == own[0].source_size
            assert sum(r.size * r.n_copies for r in own) == pytest.approx(own[0].target, rel=0.08)
        again = mixing.copies(docs(spark, rows).repartition(7)).collect()
        assert sorted(map(tuple, again), key=str) == sorted(map(tuple, out), key=str)

    def test_few_documents_of_very_unequal_size(self, spark):
        rng = random.Random(21)
        for spread in (1.0, 1.6):
            rows = [(i, "w " * min(20_000, int(40 * rng.lognormvariate(0, spread)) + 1), None, f"s{i % 12:02d}") for i in range(600)]
            out = mixing.copies(docs(spark, rows)).collect()
            for s in {r.source for r in out}:
                own = [r for r in out if r.source == s]
                assert sum(r.size * r.n_copies for r in own) == pytest.approx(own[0].target, rel=0.05)
                assert all(r.n_copies <= 2 for r in own)

    @pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
    def test_targets_of_the_small_table(self, spark):
        out = mixing.copies(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).groupBy("source").agg(F.sum(F.col("size") * F.col("n_copies")).alias("taken"), F.first("target").alias("target")).collect()
        assert len(out) == 20 and all(abs(r.taken / r.target - 1) < 0.02 for r in out)

    def test_mix_repeats_rows_as_counted(self, spark):
        rng = random.Random(5)
        d = docs(spark, [(i, some_words(rng, rng.randrange(40)), None, rng.choice("xyz")) for i in range(200)])
        want = Counter({r.doc_id: r.n_copies for r in mixing.copies(d).collect() if r.n_copies})
        got = mixing.mix(d)
        assert got.columns == d.columns and Counter(r.doc_id for r in got.collect()) == want

    def test_odd_rows(self, spark):
        d = odd(spark)
        out = mixing.copies(d).collect()
        assert len(out) == 9 and {r.size for r in out if r.doc_id in (1, 2, 3, 6)} == {0}
        assert mixing.mix(d).columns == d.columns and mixing.mix(d).count() == sum(r.n_copies for r in out)
        assert mixing.copies(d.limit(0)).count() == mixing.mix(d.limit(0)).count() == 0
        assert mixing.copies(d.where("length(text) = 0")).collect()[0].n_copies == 0


class TestToxicity:
    def data(self, spark, n=600):
        rng = random.Random(6)
        rows, labels = [], []
        for i in range(n):
            w = some_words(rng, rng.randrange(5, 200)).split()
            rude, junk = i % 7 == 0, i % 5 == 0
            for _ in range(3 * rude):
                w.insert(rng.randrange(len(w)), rng.choice(["nasty!", "Vile", "awful,"]))
            if junk:
                w += ["click", "here", "buy"]
            rows.append((i, " ".join(w), None, None))
            labels.append((i, int(junk), int(rude)))
        return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, junk int, rude int")

    def test_held_out_accuracy(self, spark):
        d, labels = self.data(spark)
        models = toxicity.train(d, labels.where("doc_id < 400"), ["junk", "rude"])
        got = {r.doc_id: r for r in toxicity.score(d, models).collect()}
        assert len(got) == 600
        held = [got[i] for i in range(400, 600)]
        assert all(0 <= r.p_rude <= 1 for r in held)
        assert sum(r.is_rude == (r.doc_id % 7 == 0) for r in held) >= 188 and sum(r.is_junk == (r.doc_id % 5 == 0) for r in held) >= 188

    def test_against_a_dense_chain(self, spark):
        """The chain as its definition says, on dense arrays: FTRL steps, folds, out-of-fold inputs, cuts."""
        d, labels = self.data(spark, 60)
        models = toxicity.train(d, labels, ["junk", "rude"])
        text = {r.doc_id: r.text for r in d.collect()}
        lab = {r.doc_id: (r.junk, r.rude) for r in labels.collect()}
        ids = sorted(lab)
        used = sorted({int(c) for i in ids for c in toxicity.features(text[i])[0]})
        place = {c: k for k, c in enumerate(used)}
        x = np.zeros((len(ids), len(used)))
        for k, i in enumerate(ids):
            cols, vals = toxicity.features(text[i])
            x[k, [place[c] for c in cols.tolist()]] = vals.astype(np.float32)

        def ftrl(x, y, alpha=0.3, beta=1.0, l1=1e-4, l2=1e-5):
            z, n, w = (np.zeros((x.shape[1], 2)) for _ in range(3))
            b, bn, rng, seen = np.zeros(2), np.zeros(2), np.random.default_rng(0), 0
            for _ in range(toxicity.EPOCHS):
                order = rng.permutation(len(x))
                for i in range(0, len(x), 32):
                    at = order[i : i + 32]
                    g = linear.softmax(x[at] @ w + b) - np.eye(2)[y[at]]
                    seen += len(at)
                    met = (x[at] != 0).any(0)
                    grad = x[at].T @ g
                    n1 = n + grad**2
                    z[met] += (grad - (np.sqrt(n1) - np.sqrt(n)) / alpha * w)[met]
                    n[met] = n1[met]
                    new = np.where(abs(z) <= l1 * seen, 0, -(z - np.sign(z) * l1 * seen) / ((beta + np.sqrt(n)) / alpha + l2 * seen))
                    w[met] = new[met]
                    bn += g.sum(0) ** 2
                    b -= alpha * g.sum(0) / (beta + np.sqrt(bn))
            return w[:, 1] - w[:, 0], b[1] - b[0]

        fold, want = np.arange(len(ids)) % toxicity.FOLDS, []
        for c in range(2):
            y = np.array([lab[i][c] for i in ids])
            oof = np.zeros(len(ids))
            for k in range(toxicity.FOLDS):
                w, b = ftrl(x[fold != k], y[fold != k])
                oof[fold == k] = 1 / (1 + np.exp(-(x[fold == k] @ w + b)))
            w, b = ftrl(x, y)
            want.append((w, b))
            assert models[c]["cut"] == pytest.approx(toxicity._best_cut(oof, y), abs=1e-4)
            x = np.column_stack((x, toxicity._logit(oof)))
        got = {r.doc_id: r for r in toxicity.score(d, models).collect()}
        x = x[:, : len(used)]
        for w, b in want:
            x = np.column_stack((x, toxicity._logit(1 / (1 + np.exp(-(x @ w + b))))))
        for k, i in enumerate(ids):
            for c, name in enumerate(("junk", "rude")):
                assert got[i][f"p_{name}"] == pytest.approx(1 / (1 + np.exp(-x[k, len(used) + c])), abs=2e-3)

    def test_rows_read_are_bounded(self, spark, monkeypatch):
        d, labels = self.data(spark, 80)
        many, seen, rows_of = d.unionByName(d).unionByName(d), [], linear.rows_of
        monkeypatch.setattr(linear, "rows_of", lambda parts: seen.append(len(parts)) or rows_of(parts))
        toxicity.train(d, labels, ["rude"], sample=50)
        toxicity.train(many, labels, ["rude"], sample=50)
        toxicity.train(many, labels, ["rude"], sample=300)
        assert seen == [50, 50, 240]

    def test_later_models_use_earlier_probabilities(self, spark):
        rng = random.Random(7)
        # The second category is the first one, and its words are drowned by rare ones; only the chain tells.
        rows = [(i, some_words(rng, 30) + (" sign" if i % 3 == 0 else ""), None, None) for i in range(300)]
        labels = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 3 == 0)) for i in range(300)], "doc_id long, a int, b int")
        models = toxicity.train(docs(spark, rows), labels, ["a", "b"])
        assert models[1]["w"].shape[0] == toxicity.BUCKETS + 1 and models[1]["w"][-1] > 0

    def test_odd_rows(self, spark):
        d, labels = self.data(spark, 200)
        labels = labels.unionByName(spark.createDataFrame([(None, 1, 1), (1, None, 1), (2, 0, None), (3, 0, 0), (3, 0, 0)], labels.schema)).withColumn("text", F.lit("t"))
        models = toxicity.train(d, labels, ["junk", "rude"])
        out = toxicity.score(odd(spark), models).collect()
        assert len(out) == 9 and not any(r.is_rude for r in out if r.doc_id in (1, 2, 3, 6))
        assert Counter(r.doc_id for r in out) == Counter([1, None, 2, 3, 4, 5, 5, 2**60 + 1, 6])
        assert toxicity.score(odd(spark).limit(0), models).count() == 0
        for never in (toxicity.train(d, labels.limit(0), ["junk", "rude"]), toxicity.train(d.limit(0), labels, ["junk", "rude"])):
            assert not any(r.is_rude for r in toxicity.score(d, never).collect())

    def test_cut_is_the_best_one_wherever_it_lies(self):
        y = np.array([1, 1, 0, 0])
        assert toxicity._best_cut(np.array([0.2, 0.15, 0.05, 0.01]), y) == pytest.approx(0.1)
        assert toxicity._best_cut(np.array([0.99, 0.95, 0.85, 0.75]), y) == pytest.approx(0.9)


class TestLanguage:
    STOCK = {"aa": ["kala", "mala", "suna", "rani"], "bb": ["chrz", "szcz", "krzt", "prst"], "cc": ["où", "été", "français", "élève"]}

    def data(self, spark, n=300):
        rng = random.Random(8)
        return docs(spark, [(i, " ".join(rng.choice(self.STOCK[lang]) for _ in range(rng.randrange(3, 40))).upper(), lang, None) for i in range(n) for lang in [rng.choice("abc") * 2]])

    def test_held_out_accuracy_and_calibration(self, spark):
        d = self.data(spark)
        model = langid.train(d.where("doc_id % 4 != 2"))
        out = langid.predict(d.where("doc_id % 4 = 2"), model, ("doc_id", "lang")).collect()
        assert len(out) == 75 and all(r.lang == r.lang_pred and 0.5 < r.score <= 1 for r in out)
        assert model["temperature"] > 0 and (model["weights"] == 0).mean() > 0.9

    def test_odd_rows(self, spark):
        model = langid.train(self.data(spark, 60))
        d = odd(spark).unionByName(odd(spark).limit(1).withColumn("text", F.lit("12 34 !?")))
        out = langid.predict(d, model).collect()
        assert len(out) == 10
        assert all((r.lang_pred, r.score) == ("und", 0.0) for r in out if r.doc_id in (1, 2, 3, 6))
        assert all(r.lang_pred in self.STOCK for r in out if r.doc_id in (4, 5, None))
        none = langid.train(self.data(spark, 60).limit(0))
        assert {r.lang_pred for r in langid.predict(d, none).collect()} == {"und"}
        assert langid.predict(d.limit(0), model).count() == 0

    def test_against_dense_softmax(self, spark):
        d = self.data(spark, 90)
        model = langid.train(d)
        out = {r.doc_id: r for r in langid.predict(d, model).collect()}
        for r in d.collect():
            cols, n = langid.grams(r.text)
            x = np.zeros(langid.BUCKETS)
            x[cols] = (1 + np.log(n)) * model["idf"][cols]
            x /= np.linalg.norm(x)
            s = (x @ model["weights"].astype(np.float64) + model["bias"]) / model["temperature"]
            p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
            assert out[r.doc_id].lang_pred == model["langs"][int(p.argmax())] and out[r.doc_id].score == pytest.approx(p.max(), abs=1e-6)

    def test_many_languages_and_many_repeats(self, spark):
        rows = [(i, f"tongue{i % 600} " * 3 + "x" * 70_000 * (i == 0), f"l{i % 600:03d}", None) for i in range(1200)]
        model = langid.train(docs(spark, rows))
        assert len(model["langs"]) == 600
        cols, n = langid.grams(rows[0][1])
        assert n.max() >= 69_998
        # All ids null, and each row three times: a row counts once, and no more than the bound.
        same = [(None, " ".join(random.Random(i).choices(self.STOCK["aa" if i % 2 else "bb"], k=9)), "aa" if i % 2 else "bb", None) for i in range(200)]
        a, b = langid.train(docs(spark, same), per_lang=1000), langid.train(docs(spark, same * 3), per_lang=1000)
        assert a["langs"] == b["langs"] == ["aa", "bb"] and np.allclose(a["weights"], b["weights"], atol=0.2)
        assert len(langid.train(docs(spark, same), per_lang=20)["langs"]) == 2

    def test_temperature_is_finite_without_errors(self):
        y = np.arange(300) % 3
        s = 0.1 * np.eye(3)[y]
        t, few = linear.temperature(s, y), linear.temperature(s[:30], y[:30])
        assert 1e-3 * 1.5 < t < few < 1
        p = linear.softmax(s / t).max(1)
        assert np.allclose(p, 301 / 302, atol=1e-3)

    def test_grams_are_those_of_the_whole_text(self, monkeypatch):
        text = "abc déf " * 50
        whole = langid.grams(text)
        monkeypatch.setattr(langid, "CHUNK", 7)
        for a, b in zip(langid.grams(text), whole):
            assert (a == b).all()
        assert whole[1].sum() == sum(len(langid._text(text)) - n + 1 for n in (1, 2, 3))

    def test_temperature_softens_overconfident_scores(self):
        rng = np.random.default_rng(9)
        s = rng.standard_normal((4000, 3))
        p = linear.softmax(s)
        y = np.array([rng.choice(3, p=q) for q in p])
        assert linear.temperature(5 * s, y) == pytest.approx(5, rel=0.1)


class TestLanguageModel:
    def data(self, spark, n=150):
        rng = random.Random(10)
        text = lambda: " ".join(x for _ in range(rng.randrange(1, 60)) for x in rng.choice([("Big", "house"), ("small", "cat"), ("red", f"w{rng.randrange(400)}")]))
        return [(i, text()) for i in range(n)]

    def test_base_and_counts_against_brute_force(self, spark, monkeypatch):
        monkeypatch.setattr(lm.lookup, "__defaults__", (20,))  # most words must come from the join
        rows = self.data(spark)
        got = {r.doc_id: r for r in lm.score(docs(spark, [(i, t, None, None) for i, t in rows])).collect()}
        c = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in [*words(t), b""])
        n, v = sum(c.values()), len(c)
        for i, t in rows:
            w = [*words(t), b""]
            r = got[i]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 7 == 2, len(w), sum(x in c for x in w), n)
            assert r.base_score == pytest.approx(sum(np.log10((c[x] + 1) / (n + v + 1)) for x in w))
        held = [r for r in got.values() if r.held_out]
        assert sum(r.score for r in held) > sum(r.base_score for r in held)

    def model(self, spark, rows, limit):
        d = docs(spark, [(i, t, None, None) for i, t in rows])
        counts = lm.count_words(d)
        v, least = lm.lookup(counts, limit)
        return v, lm.fit(d.select("doc_id", "text"), v)

    @pytest.mark.parametrize("limit", [40, 10_000])
    def test_score_against_brute_force(self, spark, monkeypatch, limit):
        """Token by token from the embeddings and a count of pairs; over all words and unseen slots it sums to 1."""
        monkeypatch.setattr(lm.lookup, "__defaults__", (limit,))
        rows = self.data(spark, 120)
        learnt = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
        v, m = self.model(spark, learnt, limit)
        c = Counter(w for _, t in learnt for w in [*words(t), b""])
        names = sorted(v.index, key=v.index.get)
        place = lambda w: v.index.get(w, len(names) + lm.ending(w))
        pairs, ctx = Counter(), Counter()
        for _, t in learnt:
            out = [place(w) for w in [*words(t), b""]]
            pairs.update(zip([v.outcomes, *out], out))
            ctx.update([v.outcomes, *out[:-1]])
        size = Counter()
        for w, n in c.items():
            if w not in v.index:
                size[lm.ending(w)] += n + 1
        table = {}

        def p(h, w):
            if h not in table:
                s = (m.query[h] @ m.target.T + m.bias).astype(np.float64)
                own = np.array([max(pairs[h, o] - lm.DISCOUNT, 0) / max(1, ctx[h]) for o in range(v.outcomes)])
                table[h] = (1 - own.sum()) * np.exp(s) / np.exp(s).sum() + own
            o = place(w)
            return table[h][o] * (1 if o < len(names) else (c[w] + 1) / (size[lm.ending(w)] + 1))

        unseen = {}
        for k in range(94 * 94):
            w = b"~%c%c" % (33 + k // 94, 33 + k % 94)
            unseen.setdefault(lm.ending(w), w)
        assert len(unseen) == lm.ENDINGS and (len(names) < len(c)) == (limit == 40)
        for h in (v.outcomes, place(b"big"), place(b"w7"), place(b"~~~")):
            assert sum(p(h, w) for w in c) + sum(p(h, w) for w in unseen.values()) == pytest.approx(1, abs=1e-5)
        got = {r.doc_id: r.score for r in lm.score(docs(spark, [(i, t, None, None) for i, t in rows])).collect()}
        for i, t in rows:
            w = [*words(t), b""]
            want = sum(np.log10(p(h, x)) for h, x in zip([v.outcomes, *map(place, w)], w))
            assert got[i] == pytest.approx(want, rel=1e-4, abs=1e-3)

    def test_model_does_not_depend_on_partitions(self, spark, monkeypatch):
        monkeypatch.setattr(lm, "GROUP_TOKENS", 400)
        monkeypatch.setattr(lm, "FAN", 3)
        monkeypatch.setattr(lm, "PAIRS", 200)
        rows = self.data(spark, 150)
        d = docs(spark, [(i, t, None, None) for i, t in rows]).select("doc_id", "text")
        v, _ = lm.lookup(lm.count_words(d))
        assert v.total > 2000  # several groups, put together at two levels
        a, b = lm.fit(d.repartition(4), v), lm.fit(d.orderBy(F.desc("text")).repartition(40), v)
        for name in ("query", "target", "bias", "normaliser", "codes", "shares", "left"):
            assert np.array_equal(getattr(a, name), getattr(b, name)), name
        codes, _, left = lm.connections(lm.put_together(lm.train(d, v, lm.start(v))[0], 1 + v.total // 400).where("kind = 1"), v, 60)
        pairs = Counter()
        for _, t in rows:
            out = v.outcomes_of([*words(t), b""])
            pairs.update((lm.before(out, v.outcomes) * v.outcomes + out).tolist())
        level = next(k for k in sorted(set(pairs.values())) if sum(n >= k for n in pairs.values()) <= 60)
        assert codes.tolist() == sorted(c for c, n in pairs.items() if n >= level) and (left > 0).all()

    @pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
    def test_held_out_texts_against_a_smoothed_bigram(self, spark):
        rows = lm.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
        # A bigram model with a discount of 0.75 over the base gives -3.507 a token, the base -4.067.
        assert rows[0] / rows[2] > -3.507 > rows[1] / rows[2]

    def test_odd_rows(self, spark):
        out = lm.score(odd(spark)).collect()
        assert len(out) == 9 and all(np.isfinite(r.score) and np.isfinite(r.base_score) for r in out)
        assert {r.n_tokens for r in out if r.doc_id in (1, 2, 3, 6)} == {1} and sum(r.doc_id == 5 for r in out) == 2
        assert [r.n_tokens for r in out if r.doc_id == 4] == [len(LONG.split()) + 1]
        assert lm.score(odd(spark).limit(0)).count() == 0
        held = docs(spark, [(i, "a b c", None, None) for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2])
        assert all(r.train_tokens == 0 and r.n_known == 0 and np.isfinite(r.score) for r in lm.score(held).collect())

    def test_first_fit_takes_whole_texts_in_hash_order(self, spark, monkeypatch):
        rows = [(i, "a b c") for i in range(2500)] + [(9000, "w " * 40_000)]
        d = docs(spark, [(i, t, None, None) for i, t in rows])
        got = lm.first_texts(d, 4 * 2500 + 40_001, "lm")
        assert len(got) == 2501 and max(map(len, got)) == 80_000
        monkeypatch.setattr(lm, "FIRST_TOKENS", 400)
        few = lm.first_texts(docs(spark, [(i, f"a b {i}", None, None) for i in range(2000)]), 8000, "lm")
        assert len(few) == 100 and max(int(t.split()[2]) for t in few) > 1500

    def test_memory_is_given_back(self, spark, monkeypatch):
        """Broadcasts end with their use, and a worker's freed memory goes back to the system."""
        import os

        import psutil

        from kinfold.llm.common import give_back

        sent, whole = [], type(spark.sparkContext).broadcast
        monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda *a: sent.append(whole(*a)) or sent[-1])
        assert lm.score(docs(spark, [(i, t, None, None) for i, t in self.data(spark, 40)])).count() == 40
        assert len(sent) == 3 and not any(os.path.exists(b._path) for b in sent)
        # Blocks too small to be mapped one by one; the last keeps the heap's end in its place.
        held = [b"x" * 50_000 for _ in range(4000)]
        held = held[-1:]
        before = psutil.Process().memory_info().rss
        give_back()
        assert before - psutil.Process().memory_info().rss > 100e6 and len(held) == 1
