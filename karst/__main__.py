"""Command line: python -m karst [--config FILE] [--set key=value ...] COMMAND."""

from __future__ import annotations

import argparse
import json
import logging

from karst.plans.config import load


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="karst")
    p.add_argument("--config")
    p.add_argument("--set", action="append", default=[], metavar="KEY=VALUE")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("show-config", "profile", "report"):
        sub.add_parser(name)
    for name in ("run", "run-all"):
        s = sub.add_parser(name)
        s.add_argument("--embeddings", help="Parquet table: path, embedding")
        s.add_argument("--force", action="store_true", help="run stages again that have written their results")
        if name == "run":
            s.add_argument("--stage", type=int, choices=(1, 2, 3, 4), required=True)
    s = sub.add_parser("plant")
    for tier in ("exact", "near", "semantic"):
        s.add_argument(f"--{tier}", type=int, default=10)
    s.add_argument("--source")
    s.add_argument("--out", default="data/planted")
    s = sub.add_parser("score")
    s.add_argument("--manifest", default="data/planted/plant_manifest.json")
    s.add_argument("--removed-scope", choices=("all", "stage4"), default="all")
    sub.add_parser("train-twice").add_argument("--max-images", type=int, default=200)
    s = sub.add_parser("make-leakage-demo")
    s.add_argument("--val-frac", type=float, default=0.25)
    s.add_argument("--leak-count", type=int, default=15)
    for name in ("subset-json", "src-images", "out"):
        s.add_argument(f"--{name}", required=True)
    return p


def main(argv: list[str] | None = None, spark=None) -> None:
    a = arguments().parse_args(argv)
    cfg = load(a.config, a.set)
    logging.basicConfig(format="%(asctime)s %(levelname)s %(name)s: %(message)s")
    logging.getLogger("karst").setLevel(cfg.log_level.upper())
    if a.command == "show-config":
        print(json.dumps(cfg.to_dict(), indent=2))
        return
    from pyspark.sql import SparkSession

    from karst.plans import folder
    from karst.sources import planted

    spark = spark or SparkSession.builder.appName("karst").getOrCreate()
    tables = ()
    if a.command == "profile":
        tables = folder.profile(spark, cfg)
    elif a.command == "report":
        tables = folder.report(spark, cfg)
    elif a.command == "score":
        tables = folder.score_run(spark, cfg, a.manifest, a.removed_scope)
    elif a.command == "train-twice":
        tables = (folder.train_twice(spark, cfg, a.max_images),)
    elif a.command in ("run", "run-all"):
        vectors = spark.read.parquet(a.embeddings) if a.embeddings else None
        if a.command == "run":
            folder.run_stage(spark, cfg, a.stage, vectors, a.force)
            tables = (spark.read.parquet(f"{cfg.io.output_dir}/stage{a.stage}/metrics"),)
        else:
            folder.run(spark, cfg, vectors, a.force)
            tables = folder.report(spark, cfg)
    elif a.command == "plant":
        m = planted.plant(spark, a.source or cfg.io.image_root, a.out, a.exact, a.near, a.semantic, cfg.seed)
        print(json.dumps(m["summary"]))
    elif a.command == "make-leakage-demo":
        d = planted.leakage_demo(spark, a.subset_json, a.src_images, a.out, a.val_frac, a.leak_count)
        print(json.dumps({"images": len(d["images"]), "annotations": len(d["annotations"])}))
    for t in tables:
        t.show(100, truncate=False)


if __name__ == "__main__":
    main()
