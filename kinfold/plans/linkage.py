"""The staged linkage job: from record tables to id lists, each stage a table under the work folder.

A stage is skipped when its table is complete (the committer's _SUCCESS), so a job that was stopped goes
on where it was. Nothing is collected but rules, thresholds and reports.
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import translit as T
from ..operators import decisions as D
from ..operators import dictionaries as L
from ..operators import features as P
from ..operators import models as M
from ..operators import retrieval as R
from ..operators import sampling as A
from ..ship import ship
from ..sources import readers, sinks

STAGES = ("queries", "prepare", "regions", "pairs", "prune", "augment", "train", "predict")
PASSES = ("name", "addr", "combo")
CHEAP = ["cos_name", "cos_addr", "cos_combo", "rank_name", "rank_addr", "rank_combo", "rank_region", "region_match", "rank_dense", "cos_dense", "ctx_rank_combo_src", "ctx_gap_combo", "ctx_ncand", "ctx_rank_name_all", "ctx_rank_addr_all", "ctx_rank_combo_all", "freq_s1_name", "freq_pool_name", "freq_s1_addr", "src_is_s3", "p_addr_empty", "p_native", "p_handle"]


@dataclass(frozen=True)
class Config:
    """D19. Paths, budgets and seeds of a job."""

    data: str
    work: str
    splits: tuple[str, ...] = ("train", "test")
    k: dict = field(default_factory=lambda: {"name": 10, "addr": 10, "combo": 15, "region": 10, "dense": 15})
    k_by_country: dict = field(default_factory=lambda: {"India": {"name": 15, "addr": 15, "combo": 20}})
    k_reverse: int = 0
    max_df: dict = field(default_factory=lambda: {"name": 0.005, "addr": 0.01, "combo": 0.005})
    min_df: int = 2
    exact_cap: int = 50
    base_fraction: float = 0.05
    ce_fraction: float = 0.03
    final_fraction: float = 0.065
    seeds: tuple[int, int, int] = (42, 123, 2024)
    folds: int = 4
    region_min_last: int = 300
    region_min_count: int = 3
    pair_min_count: int = 20
    recall_budget: float = 0.002
    rounds: int = 40
    depth: int = 5
    decide_min_p: float = 0.01
    file_min_p: float = 1e-4
    dense: str | None = None
    scores: dict = field(default_factory=dict)  # prefix (ce, ce2) -> path of (s1_id, cand_id, ce_p)


class Linkage:
    def __init__(self, spark: SparkSession, cfg: Config):
        ship(spark)
        self.spark, self.cfg = spark, cfg

    # Tables of the job

    def path(self, name: str) -> str:
        return f"{self.cfg.work}/{name}"

    def done(self, name: str) -> bool:
        """O2."""
        return readers._exists(self.spark, f"{self.path(name)}/_SUCCESS")

    def put(self, name: str, make, by: list[str] | None = None) -> None:
        if not self.done(name):
            sinks.write_parquet(make(), self.path(name), by)

    def get(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def source(self, split: str, src: int) -> DataFrame:
        r = readers.read_source(self.spark, self.cfg.data, split, src)
        return r.select(F.col("entity_id").alias("id"), F.col("business_name").alias("name"), F.col("business_address").alias("address"), "country", F.lit(src).alias("src"), F.lit(split).alias("split"))

    def sources(self, split: str) -> DataFrame:
        a, b, c = (self.source(split, s) for s in (1, 2, 3))
        return a.unionByName(b).unionByName(c)

    def truth(self) -> DataFrame:
        return readers.truth_edges(readers.read_truth(self.spark, self.cfg.data))

    # Stages

    def queries(self) -> None:
        """M1, M2, M3: three disjoint samples of the labelled entities; learned artefacts never see any of them."""
        c = self.cfg
        ents = self.source("train", 1).select(F.col("id").alias("s1_id"), "country")
        self.put("queries", lambda: A.disjoint(ents, "s1_id", "country", list(zip((c.base_fraction, c.ce_fraction, c.final_fraction), c.seeds))))

    def prepare(self) -> None:
        """Dictionaries from the other labelled pairs, then all records normalised."""
        queries = self.get("queries").select("s1_id")
        s1, pool = self.source("train", 1).withColumnRenamed("id", "s1_id"), self.source("train", 2).unionByName(self.source("train", 3)).withColumnRenamed("id", "cand_id")
        pairs = L.parallel_text(self.truth(), s1, pool, queries)
        for kind in ("name", "address"):
            folded = pairs.select(X.latin_fold(F.col(kind)).alias("latin"), X.latin_fold(F.col(f"pool_{kind}")).alias("native"))
            self.put(f"translit_{kind}", lambda folded=folded: L.learn_tokens(folded, "latin", "native"))

        def records() -> DataFrame:
            r = self.sources(self.cfg.splits[0])
            for split in self.cfg.splits[1:]:
                r = r.unionByName(self.sources(split))
            r = r.withColumn("native", F.col("name").rlike(X.V.INDIC)).withColumn("key", F.concat_ws("/", "split", "id"))
            for kind in ("name", "address"):
                learned = self.get(f"translit_{kind}")
                r = T.apply_dictionary(r, "key", kind, T.dictionary_for(r, kind, learned))
            r = X.with_views(r, "name", "address", "country")
            return r.withColumn("name_native", F.col("native")).drop("native", "key")

        self.put("records", records, ["split", "src", "country"])

    def regions(self) -> None:
        """R1-R5."""
        c = self.cfg
        parts = X.with_components(self.get("records").select(F.concat_ws("/", "split", "id").alias("id"), "split", "src", F.col("country").alias("block"), "address"), "address")
        own = parts.where("src = 1")
        self.put("region_vocabulary", lambda: L.region_vocabulary(own, c.region_min_last))
        voc = self.get("region_vocabulary")
        self.put("region_map", lambda: L.component_regions(own, voc, c.region_min_count))
        cmap = self.get("region_map")
        train = lambda col: F.concat_ws("/", F.lit("train"), col)
        edges = self.truth().join(self.get("queries").select("s1_id"), "s1_id", "left_anti").select(train("s1_id").alias("s1_id"), train("cand_id").alias("cand_id"))
        self.put("region_pairs", lambda: L.pair_regions(edges, L.assign_regions(own.where("split = 'train'"), voc, cmap), parts.where("src > 1 AND split = 'train'"), c.pair_min_count))
        gmap = self.get("region_pairs")
        self.put("record_regions", lambda: L.assign_regions(parts, voc, cmap, gmap))

    def _budget(self, name: str):
        out = F.lit(self.cfg.k[name])
        for country, k in self.cfg.k_by_country.items():
            if name in k:
                out = F.when(F.col("country") == country, F.lit(k[name])).otherwise(out)
        return out

    def pairs(self) -> None:
        """Candidates with features, for the sampled entities in training and all in test."""
        for split in self.cfg.splits:
            self.put(f"pairs_{split}", lambda split=split: self._pairs(split))

    def _pairs(self, split: str) -> DataFrame:
        c, block = self.cfg, ["country", "src"]
        recs = self.get("records").where(F.col("split") == split).drop("split")
        region = self.get("record_regions").select(F.col("id").alias("key"), "region")
        recs = recs.withColumn("key", F.concat_ws("/", F.lit(split), "id")).join(region, "key", "left").drop("key").fillna("", ["region"])
        s1_all, pool = recs.where("src = 1").drop("src"), recs.where("src > 1").withColumnRenamed("id", "cand_id")
        s1_all = P.frequencies(P.frequencies(s1_all, "name_core", ["country"], "freq_s1_name"), "addr_core", ["country"], "freq_s1_addr").withColumnRenamed("id", "s1_id")
        pool = P.frequencies(pool, "name_core", block, "freq_pool_name")
        s1 = s1_all.join(self.get("queries").select("s1_id"), "s1_id", "left_semi") if split == "train" else s1_all
        both = F.explode(F.array(F.lit(2), F.lit(3)))
        found, weights = {}, {}
        for kind in PASSES:
            text = X.retrieval_text(kind, F.col("name_core"), F.col("addr_core"))
            terms = R.char_terms(text) if kind == "name" else R.word_terms(text)
            # Both sides are weighed together within a country and source.
            rows = s1_all.select(F.col("s1_id").alias("id"), "country", both.alias("src"), "name_core", "addr_core", "region", F.lit(True).alias("own"))
            rows = rows.unionByName(pool.select(F.col("cand_id").alias("id"), "country", "src", "name_core", "addr_core", "region", F.lit(False).alias("own")))
            w = R.tfidf(rows, terms, key=["id", "own", "region"], block=block, min_df=c.min_df, max_df=c.max_df[kind])
            q = w.where("own").withColumnRenamed("id", "s1_id").join(s1.select("s1_id"), "s1_id", "left_semi")
            p = w.where("NOT own").withColumnRenamed("id", "cand_id")
            weights[kind] = q, p
            found[kind] = R.top_k(q, p, self._budget(kind), block), max([c.k[kind], *(k.get(kind, 0) for k in c.k_by_country.values())])
            if kind == "name":
                known = F.col("region") != ""
                found["region"] = R.top_k(q.where(known), p.where(known), self._budget("region"), [*block, "region"]), c.k["region"]
        dense = None
        if c.dense:
            dense = R.dense_lookup(self.spark.read.parquet(c.dense), s1, pool, c.k["dense"])
            found["dense"] = dense, c.k["dense"]
        if c.k_reverse:
            q, p = weights["combo"]
            back = R.top_k(p.withColumnRenamed("cand_id", "s1_id").drop("own"), q.withColumnRenamed("s1_id", "cand_id").drop("own"), c.k_reverse, block)
            reverse = R.reverse_scores(back.select(F.col("cand_id").alias("s1_id"), F.col("s1_id").alias("cand_id"), "cos"))
            found["rev"] = reverse.withColumnRenamed("rank_rev", "rank"), c.k_reverse
        exact = R.exact_name(s1.withColumn("src", both), pool, block, cap=c.exact_cap).select("s1_id", "cand_id")
        cands = R.union_passes(found, exact)
        for kind in PASSES:
            cands = R.row_dot(cands, *weights[kind], f"cos_{kind}")
        for name, column, default in (("rank_dense", None, c.k["dense"] + 1), ("rank_rev", None, c.k_reverse + 1), ("cos_dense", dense, 0.0)):
            if column is not None:
                cands = cands.join(column.select("s1_id", "cand_id", F.col("cos").alias(name)), ["s1_id", "cand_id"], "left").fillna(default, [name])
            elif name not in cands.columns:
                cands = cands.withColumn(name, F.lit(default))
        zero = ["rev_is_best", "rev_best_score", "rev_second_score", "rev_gap"]
        cands = cands.join(reverse.drop("rank_rev"), ["s1_id", "cand_id"], "left").fillna(0, zero) if c.k_reverse else cands.withColumns({n: F.lit(0.0) for n in zero})
        cols = ["name_core", "name_nospace", "name_acr", "legal", "name_native", "name_handle", "name_dba", "name_ntok", "addr_core", "addr_nums", "addr_primary", "addr_empty", "addr_ntok", "region"]
        d = P.attach(cands, s1, pool, cols).join(s1.select("s1_id", "country", "freq_s1_name", "freq_s1_addr"), "s1_id").join(pool.select("cand_id", "src", "freq_pool_name"), "cand_id")
        d = P.context(d.withColumn("region_match", R.region_match(F.col("a_region"), F.col("b_region"))).withColumn("src_is_s3", (F.col("src") == 3).cast("int")), block)
        d = d.withColumns(P.flags()).withColumns(P.numbers()).withColumns(P.similarities())
        d = d.drop(*[f"{s}_{x}" for s in "ab" for x in cols])
        return R.label_pairs(d, self.truth()) if split == "train" else d

    def _features(self, df: DataFrame) -> list[str]:
        return [n for n, t in df.dtypes if t not in ("string", "boolean") and n not in ("label", "src", "fold", "p", "g_top")]

    def prune(self) -> None:
        """M5-M7: cheap scores, the smallest rule within the recall budget, and what it keeps."""
        c, train = self.cfg, self.get("pairs_train")
        if not self.done("prune_rule"):
            scored, models = M.out_of_fold(train, CHEAP, c.folds, rounds=c.rounds, depth=c.depth, name="pre_p")
            sinks.write_parquet(D.pre_rank(scored), self.path("scored_train"))
            M.save(models[0], self.path("pre_model"))
            n = self.get("queries").count()
            grid = D.rule_grid(self.get("scored_train"), n)
            rules = [r.asDict() for r in D.choose_rule(grid, tuple(dict.fromkeys((c.recall_budget, *D.BUDGETS)))).collect()]
            sinks.write_json(self.spark, rules, self.path("prune_rule"))
        rule = next(r for r in sinks.read_json(self.spark, self.path("prune_rule")) if r["budget"] == c.recall_budget)
        self.put("pruned_train", lambda: D.apply_rule(self.get("scored_train"), rule["top_n"], rule["min_p"]))
        if "test" in c.splits:
            self.put("pruned_test", lambda: D.apply_rule(D.pre_rank(M.predict(M.load(self.path("pre_model")), self.get("pairs_test"), CHEAP, "pre_p")), rule["top_n"], rule["min_p"]))

    def augment(self) -> None:
        """Group features, comparison with the group's best, and outside scores where there are any."""
        for split in self.cfg.splits:
            self.put(f"final_{split}", lambda split=split: self._augmented(split))

    def _augmented(self, split: str) -> DataFrame:
        pool = self.get("records").where((F.col("split") == split) & (F.col("src") > 1)).withColumnRenamed("id", "cand_id")
        d = P.group(self.get(f"pruned_{split}"))
        names = pool.select("cand_id", F.col("name_core").alias("b_name_core"), F.col("addr_core").alias("b_addr_core"))
        d = P.against_top(d.join(names, "cand_id"), pool).drop("b_name_core", "b_addr_core", "g_top")
        for prefix, path in self.cfg.scores.items():
            d = P.scored(d, self.spark.read.parquet(path), prefix)
        return d

    def train(self) -> None:
        """M8, M10, M13, M16."""
        c, d = self.cfg, self.get("final_train")
        if self.done("report"):
            return
        features = self._features(d)
        scored, models = M.out_of_fold(d, features, c.folds, rounds=c.rounds, depth=c.depth)
        sinks.write_parquet(scored, self.path("oof"))
        for i, m in enumerate(models):
            M.save(m, self.path(f"model_{i}"))
        ents = self.get("queries").select("s1_id", "country")
        truth = self.truth().join(ents.select("s1_id"), "s1_id", "left_semi")
        pairs = self.get("oof").where(F.col("p") >= c.decide_min_p).select("s1_id", "cand_id", "p")
        best = D.tune(pairs, truth, ents).first()
        chosen = D.decide(pairs, best["t1"], best["t2"]).select("s1_id", F.explode("matches").alias("cand_id"))
        report = {"t1": best["t1"], "t2": best["t2"], "f05": best["f05"], "features": features, "importances": M.importances(models[0], features), "by_country": [r.asDict() for r in D.report(chosen, self.get("oof"), truth, ents, "country").collect()]}
        sinks.write_json(self.spark, report, self.path("report"))

    def predict(self) -> None:
        """M9, M12, M17, K2, K4."""
        c = self.cfg
        if "test" not in c.splits:
            return
        report = sinks.read_json(self.spark, self.path("report"))
        models = [M.load(self.path("model_0"))]
        self.put("predicted", lambda: M.predict_mean(models, self.get("final_test"), report["features"]).select("s1_id", "cand_id", "p"))
        p = self.get("predicted")
        raw = self.source("test", 1).select(F.col("id").alias("s1_id"))
        # Order of the input file: ids of a read without shuffle grow along it.
        ents = raw.withColumn("pos", F.monotonically_increasing_id())
        matches = D.decide(p.where(F.col("p") >= c.decide_min_p), report["t1"], report["t2"]).withColumnRenamed("matches", "ids")
        ranked = D.pre_rank(p.where(F.col("p") >= c.file_min_p), "p")
        cands = ranked.groupBy("s1_id").agg(F.array_sort(F.collect_list(F.struct("pre_rank", "cand_id"))).alias("m")).select("s1_id", F.col("m.cand_id").alias("ids"))
        for lists, name, column in ((matches, "matches", "matched_entity_ids"), (cands, "candidates", "candidate_entity_ids")):
            sinks.write_id_lists(sinks.id_lists(ents, lists, column), self.path(f"{name}.tsv"), column)
        m, k = sinks.read_id_lists(self.spark, self.path("matches.tsv"), "matched_entity_ids"), sinks.read_id_lists(self.spark, self.path("candidates.tsv"), "candidate_entity_ids")
        known = self.get("records").where("split = 'test' AND src > 1").select(F.col("id").alias("cand_id"))
        bad = [r.asDict() for r in sinks.check_lists(m, k, raw, known).collect()]
        if bad:
            raise ValueError(f"the id lists break their rules: {bad}")

    def run(self, stages: tuple[str, ...] = STAGES) -> None:
        """O1, O3."""
        for s in stages:
            getattr(self, s)()


def main(argv: list[str] | None = None) -> None:
    a = argparse.ArgumentParser(description=__doc__)
    a.add_argument("--data", required=True)
    a.add_argument("--work", required=True)
    a.add_argument("--stage", choices=[*STAGES, "all"], default="all")
    a.add_argument("--dense")
    a.add_argument("--scores", nargs="*", default=[], help="prefix=path")
    args = a.parse_args(argv)
    cfg = Config(args.data, args.work, dense=args.dense, scores=dict(s.split("=", 1) for s in args.scores))
    Linkage(SparkSession.builder.getOrCreate(), cfg).run(STAGES if args.stage == "all" else (args.stage,))


if __name__ == "__main__":
    main()
