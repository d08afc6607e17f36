"""The staged job from files to id lists, and the driver's contract."""

import random

import __spark_entry__
from kinfold.plans.linkage import Config, Linkage
from kinfold.sources import sinks


def write(folder, rng):
    """Three sources of two splits: every entity has up to two noisy records in each pool source."""
    firsts, seconds, streets = ([a + b for a in x for b in y] for x, y in ((("bal", "cor", "dun", "fer"), ("ton", "vin", "mar", "lex", "rod")), (("soft", "agri", "medi", "auto"), ("tech", "works", "care")), (("oak", "elm", "ash"), ("hill", "dale", "wood", "ford"))))
    truth = []
    for split, n in (("train", 60), ("test", 25)):
        rows = {1: [], 2: [], 3: []}
        for i in range(n):
            country = rng.choice(["US", "France"])
            name, number, street = f"{rng.choice(firsts)} {rng.choice(seconds)} {rng.choice(firsts)}", rng.randrange(1, 900), rng.choice(streets)
            region = rng.choice(["OH", "TX"])
            rows[1].append((f"S1-{i}", f"{name} LLC", f"{number} {street} Street, {region}", country))
            own = []
            for src in (2, 3):
                for _ in range(rng.randrange(3)):
                    k = f"S{src}-{len(rows[src])}"
                    rows[src].append((k, rng.choice([name.upper(), f"x trading as {name}", f"{name} Inc."]), rng.choice([f"{region}, 0{number} {street} st", f"{number} {street} street, NULL, {region}", ""]), country))
                    own.append(k)
            truth.append((f"S1-{i}", ",".join(own))) if split == "train" else None
        (folder / split).mkdir()
        for src, r in rows.items():
            lines = ["entity_id\tbusiness_name\tbusiness_address\tcountry", *("\t".join(x) for x in r)]
            (folder / split / f"{split}_source{src}.tsv").write_bytes("\r\n".join(lines).encode() + b"\r\n")
    (folder / "train" / "train_ground_truth.tsv").write_bytes("\n".join(["source1_entity_id\tmatched_entity_ids", *("\t".join(t) for t in truth)]).encode() + b"\n")


def test_job(spark, tmp_path):
    data = tmp_path / "data"
    data.mkdir()
    write(data, random.Random(1))
    cfg = Config(str(data), str(tmp_path / "work"), max_df={"name": 1.0, "addr": 1.0, "combo": 1.0}, min_df=1, base_fraction=0.6, folds=2, rounds=3, depth=2, region_min_last=5, k_reverse=3)
    job = Linkage(spark, cfg)
    job.run()
    report = sinks.read_json(spark, job.path("report"))
    assert report["f05"] > 0.7 and report["t2"] >= report["t1"]
    matches = sinks.read_id_lists(spark, job.path("matches.tsv"), "matched_entity_ids")
    assert [r.s1_id for r in matches.collect()] == [f"S1-{i}" for i in range(25)]
    regions = {r.region for r in job.get("record_regions").collect()}
    assert regions <= {"oh", "tx", ""} and len(regions) > 1
    # Complete tables are left as they are.
    before = job.get("pairs_test").inputFiles()
    job.run()
    assert job.get("pairs_test").inputFiles() == before


def test_contract(spark):
    q, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 60
    assert __spark_entry__.entry(spark).columns == ["s1_id", "matches"]
