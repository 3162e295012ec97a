"""Configuration: defaults, then a YAML file, then dotted overrides. Unknown keys raise KeyError."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields, is_dataclass
from typing import Any

import yaml


@dataclass
class Stage1:
    enabled: bool = True
    storage_backend: str = "auto"
    lmdb_threshold: int = 5_000_000


@dataclass
class Stage2:
    enabled: bool = True
    hashes: list[str] = field(default_factory=lambda: ["phash", "dhash"])
    hash_size: int = 8
    hamming_threshold: int = 8
    combine: str = "any"
    search_strategy: str = "auto"


@dataclass
class Stage3:
    enabled: bool = True
    backbone: str = "dinov2_vitb14"
    model_path: str | None = None
    device: str = "auto"
    batch_size: int = 64
    num_workers: int = 8
    use_dali: bool = False
    pre_resize: bool = False
    fp16_embeddings: bool = True
    index_type: str = "auto"
    nlist: int = 4096
    nprobe: int = 16
    pq_m: int = 64
    pq_nbits: int = 8
    rerank: bool = True
    rerank_k: int = 100
    ram_budget_gb: float = 24.0
    cosine_threshold: float = 0.92


@dataclass
class Stage4:
    enabled: bool = True
    keep_strategy: str = "keep_most_annotated"
    partition_key: str | None = None
    video_subsample_k: int = 0


@dataclass
class Leakage:
    enabled: bool = True
    train_split: str = "train"
    eval_splits: list[str] = field(default_factory=lambda: ["val", "test"])


@dataclass
class IO:
    image_root: str = "data/images"
    annotations: str | None = None
    annotation_format: str = "coco"
    output_dir: str = "runs/latest"


@dataclass
class Config:
    seed: int = 42
    log_level: str = "INFO"
    io: IO = field(default_factory=IO)
    stage1: Stage1 = field(default_factory=Stage1)
    stage2: Stage2 = field(default_factory=Stage2)
    stage3: Stage3 = field(default_factory=Stage3)
    stage4: Stage4 = field(default_factory=Stage4)
    leakage: Leakage = field(default_factory=Leakage)

    def to_dict(self) -> dict:
        return asdict(self)


def _merge(node: Any, values: dict, at: str = "") -> None:
    names = {f.name for f in fields(node)}
    for k, v in values.items():
        if k not in names:
            raise KeyError(f"unknown config key {at}{k}")
        child = getattr(node, k)
        if is_dataclass(child):
            _merge(child, v or {}, f"{at}{k}.")
        else:
            setattr(node, k, v)


def load(path: str | None = None, overrides: list[str] = ()) -> Config:
    """overrides: "stage2.hamming_threshold=4", values by YAML's scalar rules."""
    out = Config()
    if path:
        with open(path) as f:
            _merge(out, yaml.safe_load(f) or {})
    for o in overrides:
        key, _, raw = o.partition("=")
        try:
            value = yaml.safe_load(raw)
        except yaml.YAMLError:
            value = raw
        for part in reversed(key.split(".")):
            value = {part: value}
        _merge(out, value)
    return out
