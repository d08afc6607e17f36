"""Embeddings, archives, token files, conversations, components and the pipeline."""

import gzip
import io
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinfold.llm import chat, embed_dedup, queries, tokenids, warc
from kinfold.llm.common import scratch
from kinfold.llm.components import connected_components
from kinfold.llm.wavelet import Shard, encode

VECTORS = "vec_id long, embedding array<float>, label int"


class TestComponents:
    def test_against_union_find(self, spark):
        rng = random.Random(1)
        edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(80)] + [(7, 7), (None, 3)]
        up = {}

        def find(x):
            up.setdefault(x, x)
            while up[x] != x:
                x = up[x]
            return x

        for a, b in edges:
            if a is not None:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
        got = {r.id: r.component_id for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {x: find(x) for x in list(up) if find(x) != x}

    def test_none(self, spark):
        assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


class TestEmbeddings:
    def test_links_against_brute_force(self, spark):
        rng = np.random.default_rng(2)
        base = rng.standard_normal((300, 64))
        near = np.repeat(base[:60], 5, 0) + rng.standard_normal((300, 64)) * rng.choice([0.1, 0.25, 0.32], 300)[:, None]
        x = np.concatenate((base, near, base[:20], base[:10])).astype(np.float32)
        rows = [(int(i), v.tolist(), int(i) % 3) for i, v in enumerate(x)]
        got = {r.vec_id: r for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()}
        u = x.astype(np.float64)
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        link = u @ u.T >= 0.95
        np.fill_diagonal(link, False)
        found = sum(r.n_links for r in got.values())
        assert len(got) == len(x) and found >= 0.97 * link.sum()
        assert all(got[i].n_links <= link[i].sum() for i in got)
        comp = list(range(len(x)))
        for _ in range(20):
            for i, j in np.argwhere(link):
                comp[i] = min(comp[i], comp[j])
        assert np.mean([got[i].component_id == comp[i] for i in got]) > 0.98
        assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())

    def test_recall_at_a_large_grid(self):
        """25,000 vectors with links, in a grid of 1,024 x 1,024 cells: nine tenths of the links are met at least."""
        rng = np.random.default_rng(22)
        base = rng.standard_normal((5000, 64))
        x = np.concatenate((base, np.repeat(base, 4, 0) + 0.22 * rng.standard_normal((20_000, 64)) * rng.uniform(0.2, 1.4, (20_000, 1))))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        index = embed_dedup.fit(x[rng.permutation(len(x))[:8192]], 1 << 26, 0.95, 0.995)
        assert len(index.words[0]) == 1024
        (a, b), home = index.distances(x), index.cells(x)
        limit = a.min(1) + b.min(1) + index.margin
        met = all_ = 0
        for k in range(5000):
            own = np.concatenate(([k], 5000 + 4 * k + np.arange(4)))
            i, j = np.nonzero(np.triu(x[own] @ x[own].T >= 0.95, 1))
            i, j = own[i], own[j]
            met += int((a[i, home[j] // 1024] + b[i, home[j] % 1024] <= limit[i]).sum())
            all_ += len(i)
        assert all_ > 20_000 and met >= 0.97 * all_

    def test_links_of_doubles_and_floats(self, spark):
        rng = np.random.default_rng(23)
        x = rng.standard_normal((40, 16)) + np.repeat(3 * rng.standard_normal((10, 16)), 4, 0)
        for kind, cast in (("array<double>", np.float64), ("array<float>", np.float32)):
            v = x.astype(cast).astype(np.float64)
            u = v / np.linalg.norm(v, axis=1, keepdims=True)
            got = {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(spark.createDataFrame([(i, y.tolist()) for i, y in enumerate(v)], f"vec_id long, embedding {kind}"), 0.8).collect()}
            assert got == {i: int((u[i] @ u.T >= 0.8).sum()) - 1 for i in range(40)} and sum(got.values()) > 40

    def test_walk_goes_by_distance(self):
        rng = np.random.default_rng(3)
        x = rng.standard_normal((500, 8))
        index = embed_dedup.fit(x, 30_000, 0.95, 0.99)
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        a, b = index.distances(u)
        for i, cells in enumerate(index.walk(u[:50])):
            s = (a[i][:, None] + b[i][None, :]).ravel()
            assert np.allclose(np.diff(s[cells]).clip(max=0), 0) and set(cells) == set(np.flatnonzero(s <= s.min() + index.margin))
            assert cells[0] == index.cells(u[i : i + 1])[0]

    def test_crowded_cells_in_blocks(self, spark, monkeypatch):
        monkeypatch.setattr(embed_dedup, "BLOCK", 4)
        rng = np.random.default_rng(4)
        x = np.concatenate((np.ones((60, 16)) + 0.05 * rng.standard_normal((60, 16)), rng.standard_normal((20, 16)))).astype(np.float32)
        got = {r.vec_id: r for r in embed_dedup.near_duplicates(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], VECTORS)).collect()}
        assert all(got[i].n_links == 59 and got[i].component_id == 0 for i in range(60))

    def test_odd_rows(self, spark):
        v, nan, inf = [1.0, 2.0, 3.0], float("nan"), float("inf")
        rows = [(1, None, 0), (2, [], 0), (3, [0.0] * 3, 0), (4, [1.0, None, 0.0], 0), (5, [nan, 1.0, 1.0], 0), (6, [inf, 1.0, 1.0], 0), (7, v, None), (8, v, 1), (8, v, 1), (None, v, 1), (9, [2.0, 4.0, 6.0], 2), (10, [1e-30, 2e-30, 3e-30], 0), (11, [1.0, 2.0], 0), (12, [-0.0, 0.0, 0.0], 0)]
        d = spark.createDataFrame(rows, VECTORS).withColumn("n_links", F.lit("x")).withColumn("rep", F.lit(0))
        got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(d).collect())
        want = Counter([(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 11, 12)] + [(None, 0, None, True), (7, 4, 7, True), (8, 4, 7, False), (8, 4, 7, False), (9, 4, 7, False), (10, 4, 7, False)])
        assert got == want
        assert embed_dedup.near_duplicates(d.limit(0)).count() == 0
        assert embed_dedup.near_duplicates(d.where("vec_id < 7")).count() == 6

    def test_every_length_has_its_links(self, spark):
        rows = [(1, [1.0, 2.0, 3.0], 0), (2, [2.0, 4.0, 6.01], 0), (3, [3.0, -1.0, 0.0], 0), (4, [1.0, 2.0], 0), (5, [1.0, 2.01], 0), (6, [5.0], 0), (7, [5.0], 0)]
        got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()}
        assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (1, 6), 7: (1, 6)}


class TestWarc:
    PAGES = "page_id long, url string, html string"

    def test_round_trip_in_small_ranges(self, spark):
        rng = random.Random(5)
        html = ["", "a", "<p>ü</p>", "x" * 5000, *["".join(rng.choice("abcdefgh \n") for _ in range(rng.randrange(3000))) for _ in range(60)]]
        rows = [(i, f"http://h/{i} ?\nq", rng.choice(html)) for i in range(300)]
        pages = spark.createDataFrame(rows, self.PAGES).repartition(3)
        got = {r.page_id: r for r in warc.read(warc.write(pages, scratch(spark, "w")), split=777).collect()}
        first = {}
        for i, _, h in rows:
            first[h] = min(i, first.get(h, i))
        assert len(got) == 300
        for i, _, h in rows:
            r, p = got[i], h.encode()
            assert (r.payload_bytes, r.payload_digest) == (len(p), warc.digest32(p))
            assert (r.record_type, r.refers_to) == (("response", None) if first[h] == i else ("revisit", first[h]))
            assert r.payload == (p if first[h] == i else None) and r.url == f"http://h/{i}%20?%0Aq"

    def test_splits_own_what_starts_in_them(self):
        """Payloads hold magic numbers, a whole WARC archive and a member cut short; every split size gives each record once."""
        inner = warc.record(1, "http://inner", b"inner", None)
        stored = lambda b: gzip.compress(b, compresslevel=0)
        traps = [b"plain", inner, inner * 3, warc.MAGIC * 50, inner[:30], stored(inner), b""]
        members = []
        for k, t in enumerate(traps * 2):
            text = zlib.decompress(warc.record(k, None, t, None), 31)
            members.append(stored(text))  # stored blocks leave the inner members readable as they are
        data = b"".join(members)
        whole = [zlib.decompress(m, 31) for m in members]
        for split in (1, 13, 64, 200, 1000, len(data)):
            got = [t for s in range(0, len(data), split) for t in warc.Reader(io.BytesIO(data), len(data), s, s + split).records()]
            assert got == whole, split

    def test_a_record_that_does_not_come_back_is_reported(self, spark, monkeypatch):
        monkeypatch.setattr(warc, "read", lambda archives, split, payloads: archives.select("records").limit(0))
        with pytest.raises(ValueError, match="0 of 3"):
            warc.round_trip(spark.createDataFrame([(i, "u", "x") for i in range(3)], self.PAGES))

    def test_very_long_payload(self, spark):
        html = "<p>long</p>" * 400_000
        got = warc.round_trip(spark.createDataFrame([(1, "u", html), (2, "u", html)], self.PAGES), split=1 << 16).collect()
        assert sorted((r.page_id, r.payload_bytes, r.record_type) for r in got) == [(1, len(html), "response"), (2, len(html), "revisit")]

    def test_damage_is_reported(self):
        good = zlib.decompress(warc.record(1, None, b"payload", None), 31)
        with pytest.raises(ValueError):
            warc.parse(good.replace(b"payload", b"paylaod"))

    def test_odd_rows(self, spark):
        rows = [(1, None, None), (2, "u", ""), (None, "u", ""), (3, "", "same"), (3, "", "same"), (4, "v", "same"), (None, None, "alone")]
        d = spark.createDataFrame(rows, self.PAGES).withColumn("payload", F.lit(1)).withColumn("sha", F.lit("s")).withColumn("first", F.lit(2))
        got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(d).collect())
        assert got == Counter([(1, 0, "response", None), (2, 0, "revisit", 1), (None, 0, "revisit", 1), (3, 4, "response", None), (3, 4, "response", None), (4, 4, "revisit", 3), (None, 5, "response", None)])
        assert warc.round_trip(d.limit(0)).count() == 0


class TestTokenIds:
    @pytest.mark.parametrize("n,high", [(0, 1), (1, 1), (7, 2), (1000, 50_000), (3000, 300), (500, 70_000)])
    def test_wavelet_matrix_against_the_sequence(self, n, high):
        rng = np.random.default_rng(n)
        a = rng.integers(0, high, n).astype(np.uint32)
        s = Shard(encode(a, [5, None], np.array([n // 2, n - n // 2])))
        assert (s.ids() == a).all() and s.doc_ids == [5, None] and s.n == n
        for t in {*a[:20].tolist(), 0, high + 1}:
            at = np.flatnonzero(a == t)
            assert s.count(t) == len(at)
            for i in (0, n // 3, n):
                assert s.rank(t, i) == (at < i).sum()
            assert s.occurrences(t)[:40] == at[:40].tolist() if len(at) < 40 else s.select(t, 39) == at[39]
        assert [s.access(i) for i in range(0, n, 97)] == a[::97].tolist()
        if n:
            assert (s.document(0) == a[: n // 2]).all()

    def test_encoder_agrees_with_the_tokenizer(self):
        enc = tokenids.Encoder(queries.tokenizer_path())
        rng = random.Random(6)
        alphabet = ["a", "Bc", " ", "  ", "\n", " \n", "\t", "é", "日本", "1", "23", "'s", "don't", ".", "!?", " ", " ", "😀", "\x00", "\x1c", "\x85", "​", "<|endoftext|>"]
        for _ in range(3000):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(12)))
            assert enc.encode(t).tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)

    def test_texts_together(self, monkeypatch):
        monkeypatch.setattr(tokenids, "GATHERED", 7)  # several gathers
        enc = tokenids.Encoder(queries.tokenizer_path())
        rng = random.Random(8)
        alphabet = ["a", "Bc", " ", " ", " ", "\n", "é", "23", ",", "don't", "<|endoftext|>"]
        texts = [None, "", " ", "a", "a ", " a"] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(500)]
        want = [enc.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert [g.tolist() for g in enc.encode_all(texts)] == want
        assert enc.encode_all([]) == []

    def test_round_trip(self, spark):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(queries.tokenizer_path())
        rng = random.Random(7)
        rows = [(rng.randrange(10**6), " ".join(rng.choice(["the", "quick", "Brown", "naïve", "fox\n"]) for _ in range(rng.randrange(80)))) for _ in range(150)] + [(2**60 + 1, None), (-5, ""), (10**7, "word " * 50_000)]
        d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("s"))
        got = sorted(map(tuple, tokenids.round_trip(d, queries.tokenizer_path(), shard=500).collect()), key=lambda r: r[1])
        start, want = 0, []
        for i, t in sorted(rows, key=lambda r: r[0]):
            ids = [*(tok.encode(t or "", add_special_tokens=False).ids), 0]
            want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        assert got == want

    def test_odd_rows(self, spark):
        d = spark.createDataFrame([(None, "x"), (1, "a b"), (1, "a b"), (1, "c")], "doc_id long, text string")
        got = sorted(map(tuple, tokenids.round_trip(d, queries.tokenizer_path()).collect()), key=lambda r: r[1])
        assert [r[0] for r in got] == [None, 1, 1, 1] and [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got[:-1])]).tolist()
        assert tokenids.round_trip(d.limit(0), queries.tokenizer_path()).count() == 0


class TestChat:
    TURNS = "conv_id long, turn long, role string, text string"

    def test_against_brute_force(self, spark):
        rng = random.Random(8)
        convs = {}
        for i in range(120):
            base = convs[rng.choice(list(convs))] if convs and rng.random() < 0.7 else []
            k = rng.randrange(len(base) + 1)
            convs[i] = base[:k] + [(rng.choice(["user", "assistant"]), rng.choice("abc")) for _ in range(rng.randrange(0 if k else 1, 3))]
        rows = [(i, t, *x) for i, c in convs.items() for t, x in enumerate(c)]
        rng.shuffle(rows)
        got = {r.conv_id: (r.n_turns, r.text) for r in chat.render(spark.createDataFrame(rows, self.TURNS)).collect()}
        longer = lambda a, b: len(b) > len(a) and b[: len(a)] == a
        keep = [i for i, c in convs.items() if not any(longer(c, d) or (d == c and j < i) for j, d in convs.items())]
        assert got == {i: (len(convs[i]), "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in convs[i])) for i in keep}

    def test_odd_rows(self, spark):
        rows = [(1, 0, "user", None), (2, 0, "user", ""), (3, None, None, "x"), (3, 1, "user", "y"), (4, 0, "user", "a"), (4, 0, "user", "a"), (5, 0, "user", "a"), (None, 0, "user", "a"), (6, 0, "u", "end<|im_end|>here")]
        d = spark.createDataFrame(rows, self.TURNS).withColumn("n", F.lit("x")).withColumn("m", F.lit(1))
        got = {r.conv_id: (r.n_turns, r.text) for r in chat.render(d).collect()}
        turn = lambda r, t: f"<|im_start|>{r}\n{t}<|im_end|>\n"
        assert got == {1: (1, turn("user", "")), 2: (1, turn("user", "")), 3: (2, turn("", "x") + turn("user", "y")), 4: (2, 2 * turn("user", "a")), 6: (1, turn("u", "end<|​im_end|>here"))}
        assert chat.render(d.limit(0)).count() == 0

    def test_very_long_turn(self, spark):
        long = "word " * 500_000
        got = chat.render(spark.createDataFrame([(1, 0, "user", long), (2, 0, "user", long), (2, 1, "assistant", "ok")], self.TURNS)).collect()
        assert [(r.conv_id, r.n_turns) for r in got] == [(2, 2)] and long in got[0].text

    def test_no_python_in_the_plan(self, spark):
        plan = chat.render(spark.createDataFrame([(1, 0, "user", "a")], self.TURNS))._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


class TestPipeline:
    def write(self, spark, folder):
        rng = random.Random(9)
        stock = [f"word{i}" for i in range(600)]
        text = lambda n: " ".join(rng.choice(stock) for _ in range(n))
        items = [(i, text(20)) for i in range(5)]
        rows = [(i, text(rng.randrange(30, 120))) for i in range(200)]
        for i in range(0, 200, 7):
            rows[i] = (i, rows[i][1] + " vile nasty awful " + text(5))
        rows += [(300 + i, rows[i][1]) for i in range(1, 20)]
        rows += [(400 + i, text(40) + " " + t + " " + text(40)) for i, t in items]
        docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        spark.createDataFrame([(i, i % 2, int(i % 7 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        return docs

    def test_stages(self, spark, tmp_path):
        folder = str(tmp_path / "in")
        docs = self.write(spark, folder)
        ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
        d, seen = docs, {}
        for name, stage in corpus_pipeline.STAGES:
            d = stage(spark, d, folder)
            if name != "token_ids":
                assert d.columns == docs.columns
                d.write.parquet(f"{tmp_path}/{name}")
                d = spark.read.parquet(f"{tmp_path}/{name}")
            seen[name] = d
        toxic = {i for i in range(0, 200, 7)} | {307, 314}
        assert ids(docs) - ids(seen["toxicity"]) == toxic
        assert ids(seen["toxicity"]) - ids(seen["simhash"]) == {300 + i for i in range(1, 20) if i % 7}
        assert ids(seen["simhash"]) - ids(seen["decontamination"]) == {400 + i for i in range(5)}
        assert ids(seen["token_ids"]) == ids(seen["mixing"]) and seen["token_ids"].count() == seen["mixing"].count()
        assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == sorted(map(tuple, seen["token_ids"].collect()))

    def test_odd_rows(self, spark, tmp_path):
        folder = str(tmp_path / "in")
        self.write(spark, folder)
        rows = [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", None, None, None), (3, "word1 " * 60_000, "en", "a", 1), (3, "word1 " * 60_000, "en", "a", 1), (None, "word2 word3", "en", "b", 5)]
        odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("__size", F.lit(1)).withColumn("fp", F.lit("f"))
        for empty in (False, True):
            d = odd.limit(0) if empty else odd
            for name, stage in corpus_pipeline.STAGES:
                out = stage(spark, d, folder)
                if name != "token_ids":
                    assert out.columns == odd.columns
                    path = f"{tmp_path}/{name}{empty}"
                    out.write.parquet(path)
                    d = spark.read.parquet(path)
                assert out.count() == 0 or not empty

    def test_near_duplicates_leave_one_row(self, spark):
        a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
        rows = [(4, a), (4, a), (None, a), (None, b), (None, b), (2, c), (9, c), (4, c)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = sorted((r.doc_id or -1, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
        assert got == [(-1, b), (2, c), (4, a)]
