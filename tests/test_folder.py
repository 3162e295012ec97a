"""Planter, leakage demo, the cascade over an image folder, and the command line."""

import json

import numpy as np
import pytest

from karst.__main__ import main
from karst.plans import config, folder
from karst.sources import planted


@pytest.fixture(scope="module")
def photos(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("photos")
    rng = np.random.default_rng(5)
    for i in range(8):
        x = np.clip(np.kron(rng.random((8, 8, 3)) * 255, np.ones((12, 12, 1))), 0, 255).astype(np.uint8)
        (root / f"p{i}.jpg").write_bytes(planted.encode(spark._jvm, x, 0.95))
    return root


def test_codec(spark, photos):
    x = planted.decode(spark._jvm, (photos / "p0.jpg").read_bytes())
    y = planted.decode(spark._jvm, planted.encode(spark._jvm, x, 1.0))
    assert x.shape == (96, 96, 3) and abs(x.astype(int) - y).mean() < 4 and planted.crop(x).shape == (92, 92, 3)


def test_plant_run_score(spark, photos, tmp_path, capsys):
    a, b = (planted.plant(spark, str(photos), str(tmp_path / k), 2, 2, 2, 3) for k in "ab")
    assert a["planted"] == b["planted"] and a["summary"] == {"exact": 2, "near": 2, "semantic": 2, "total_planted": 6, "source_images": 8}
    for p in a["planted"]:
        assert (tmp_path / "a" / p["file"]).exists() and (tmp_path / "a" / p["original"]).exists()
    sets = ["--set", f"io.image_root={tmp_path}/a/images", "--set", f"io.output_dir={tmp_path}/run", "--set", "stage3.backbone=thumbnail"]
    main([*sets, "run-all"], spark)
    cfg = config.load(None, sets[1::2])
    recall, precision, summary, missed = folder.score_run(spark, cfg, f"{tmp_path}/a/plant_manifest.json")
    got = {r.tier: r for r in recall.collect()}
    assert (got["exact"].caught, got["exact"].on_time, got["near"].caught) == (2, 2, 2)
    assert precision.first().precision == 1.0
    s = summary.first()
    assert s.planted_total == 6 and s.removed_total == precision.first().removed and s.caught + missed.count() == 6
    within = folder.score_run(spark, cfg, f"{tmp_path}/a/plant_manifest.json", "stage4")[1].first().removed
    assert within == precision.first().removed - 2  # the exact copies went before
    m = {r.stage: r for r in spark.read.parquet(f"{tmp_path}/run/metrics").collect()}
    assert m[2].extra["search_strategy"] == "bruteforce" and m[3].extra["index_type"] == "flat" and int(m[4].extra["n_nontrivial_clusters"]) >= 2 and m[4].peak_mem_mb > 0
    clusters = spark.read.parquet(f"{tmp_path}/run/stage4/clusters")
    assert clusters.groupBy("cluster").agg({"kept": "count"}).count() == int(m[4].extra["n_nontrivial_clusters"]) and clusters.where("kept").count() == int(m[4].extra["n_nontrivial_clusters"])
    g = spark.read.parquet(f"{tmp_path}/run/groups")
    assert {r.reason for r in g.where("stage = 2").collect()} == {"phash|dhash<=8"} and g.where("kept").count() == g.select("stage", "group").distinct().count()
    assert not folder.run_stage(spark, cfg, 2) and folder.run_stage(spark, cfg, 2, force=True)
    alone = config.load(None, [*sets[1:4:2], f"io.output_dir={tmp_path}/none"])
    assert folder.pairs(spark, alone).count() == 0 and folder.run_stage(spark, alone, 2)  # no stage before: over all images
    assert spark.read.parquet(f"{tmp_path}/none/stage2/metrics").first().items_in == 14
    with pytest.raises(FileNotFoundError):
        folder.finish(spark, alone)
    table = f"{tmp_path}/run/stage3/embeddings-thumbnail-fp16"
    n = spark.read.parquet(table).count()
    assert folder.run_stage(spark, cfg, 3, force=True) and spark.read.parquet(table).count() == n  # none is embedded again
    main([*sets, "run", "--stage", "4", "--force"], spark)
    for command in (["report"], ["profile"], ["score", "--manifest", f"{tmp_path}/a/plant_manifest.json"], ["show-config"]):
        main([*sets, *command], spark)
    assert "initial_images" in capsys.readouterr().out
    with pytest.raises(ValueError):
        planted.plant(spark, str(photos), str(tmp_path / "c"), 0, 0, 0)
    with pytest.raises(NotImplementedError):
        folder.embed(spark.read.format("image").load(str(photos)), "nothing")


def test_leakage_demo(spark, photos, tmp_path):
    doc = {"images": [{"id": i, "file_name": f"p{i}.jpg", "width": 96, "height": 96} for i in range(9)], "annotations": [{"id": k, "image_id": k % 8, "category_id": 1} for k in range(16)], "categories": [{"id": 1, "name": "x"}]}
    (tmp_path / "s.json").write_text(json.dumps(doc))
    out = planted.leakage_demo(spark, str(tmp_path / "s.json"), str(photos), str(tmp_path / "demo"), 0.25, 3)
    names = [i["file_name"] for i in out["images"]]
    assert sum(n.startswith("train/") for n in names) == 6 and sum(n.startswith("val/leaked_") for n in names) == 3 and len(names) == 11
    assert len({a["id"] for a in out["annotations"]}) == len(out["annotations"]) == 16 + 3
    cfg = config.load(None, [f"io.image_root={tmp_path}/demo/images", f"io.annotations={tmp_path}/demo/annotations/instances.json", f"io.output_dir={tmp_path}/run", "stage3.enabled=false", "stage2.hamming_threshold=10"])
    folder.run(spark, cfg)
    leak = {r.split: r for r in spark.read.parquet(f"{tmp_path}/run/leakage").collect()}
    assert (leak["val"].eval_images, leak["val"].leaked_images) == (5, 3)
    assert spark.read.parquet(f"{tmp_path}/run/leakage_partitions").count() == 0
    n = folder.train_twice(spark, cfg, None).first()
    rows = spark.read.parquet(f"{tmp_path}/run/train_twice").collect()
    lists = {k: {r.item_id for r in rows if r.role == k} for k in ("raw", "reduced", "test")}
    gone = {r.path for r in spark.read.parquet(f"{tmp_path}/run/removed").collect()}
    assert (n.n_train_raw, n.n_test) == (6, 5) and lists["reduced"] == lists["raw"] - gone and n.n_train_reduced == len(lists["reduced"])
    assert folder.train_twice(spark, cfg, 2).first().n_test == 2
    with pytest.raises(ValueError):
        folder.train_twice(spark, config.load(None, [f"io.image_root={tmp_path}/demo/images", f"io.output_dir={tmp_path}/run", "leakage.train_split=other"]))
    cfg.stage4.partition_key, cfg.stage4.video_subsample_k = "folder", 2
    assert folder.run_stage(spark, cfg, 4, force=True)
    assert spark.read.parquet(f"{tmp_path}/run/stage4/metrics").first().items_in == 3 + 3  # of 6 and of 5 in a folder
