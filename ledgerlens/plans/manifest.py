"""Manifests: one small JSON file per committed revision, or compaction of one, made visible by a rename.

A manifest names the folders that make up its revision, and every run writes into folders of its own. So of two writers that start from one
revision only the first to commit counts, and what the other wrote, like all that no manifest names, is leftover that no reader sees. Files
are reached through Hadoop's file system interface, so the index may lie wherever Spark writes.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession


@dataclass
class Manifest:
    epoch: int
    size: int
    map_fn: str
    peaks: list[str] = field(default_factory=list)
    checkpoint: str = ""
    map_root: str = ""
    bits: int = 0
    keys: int = 0
    output_peaks: list[str] = field(default_factory=list)
    output_checkpoint: str = ""
    batch_id: int = -1
    generation: int = 0  # compactions of the revision
    function: str = ""  # what the map function does, as a hash
    tables: dict[str, list[str]] = field(default_factory=dict)

    @property
    def file(self) -> str:
        return f"{self.epoch:012d}-{self.generation:06d}.json"


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def commit(spark: SparkSession, root: str, manifest: Manifest) -> None:
    """Write under a name of its own, then rename; an error if the revision is there already."""
    fs, target = _fs(spark, f"{root}/manifests/{manifest.file}")
    temp = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifests/_{manifest.file}.{uuid.uuid4().hex}.tmp")
    out = fs.create(temp, True)
    try:
        out.write(bytearray(json.dumps(asdict(manifest)).encode()))
    finally:
        out.close()
    if fs.exists(target) or not fs.rename(temp, target):
        raise RuntimeError(f"revision {manifest.epoch} is committed already")


def revisions(spark: SparkSession, root: str) -> list[tuple[int, int]]:
    """Committed (epoch, generation), ascending."""
    fs, folder = _fs(spark, f"{root}/manifests")
    if not fs.exists(folder):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(folder))
    return sorted(tuple(map(int, n[:-5].split("-"))) for n in names if n.endswith(".json"))


def load(spark: SparkSession, root: str, epoch: int | None = None) -> Manifest | None:
    """The newest manifest, or that of an epoch."""
    found = [r for r in revisions(spark, root) if epoch is None or r[0] == epoch]
    if not found:
        return None
    name = Manifest(found[-1][0], 0, "", generation=found[-1][1]).file
    return Manifest(**json.loads(spark.read.text(f"{root}/manifests/{name}", wholetext=True).first()[0]))
