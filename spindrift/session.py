"""Session and run settings."""

from __future__ import annotations

import os
from dataclasses import dataclass, replace

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class RegionConfig:
    """Thresholds and switches of one region's funnel; `from_env` overrides them by <PREFIX>_<FIELD> variables."""

    region: str
    sem_thresh_v1: float = 0.62
    sem_margin_v1: float = 0.03
    sem_thresh_v2: float = 0.80
    sem_margin_v2: float = 0.01
    paper_floor: int = 30
    use_alias: bool = True
    use_fuzzy: bool = True
    guard_empty_name: bool = False
    dedupe_before_margin: bool = False
    score: str = "v2"  # v1: the most similar of an author's fields; v2: an author's own vector

    @property
    def thresholds(self) -> tuple[float, float]:
        """(threshold, margin) of the score in use."""
        return (self.sem_thresh_v1, self.sem_margin_v1) if self.score == "v1" else (self.sem_thresh_v2, self.sem_margin_v2)

    def from_env(self, environ=os.environ) -> RegionConfig:
        changes = {}
        for name, value in vars(self).items():
            told = environ.get(f"{self.region.upper()}_{name.upper()}")
            if told is not None:
                changes[name] = told == "1" if isinstance(value, bool) else type(value)(told)
        return replace(self, **changes)


#: Calibrated thresholds of the regions.
EU = RegionConfig("eu", sem_thresh_v2=0.80, sem_margin_v2=0.01)
US = RegionConfig("us", sem_thresh_v2=0.68, sem_margin_v2=0.00)
AUS = RegionConfig("aus", sem_thresh_v2=0.55, sem_margin_v2=0.02, guard_empty_name=True)
CN = RegionConfig("cn")


def session(app: str = "spindrift", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution; memory, spill and parallelism stay the cluster's."""
    b = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which all executors share.  A local default serves local mode only."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not told and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    told = (told or "file:///tmp/spindrift-shared").rstrip("/")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(told)
    return told


def layer(df):
    """df cut from its lineage by a reliable checkpoint in the cluster's shared folder, computed once.

    Layers of the funnel are read many times; without the cut every later layer would plan and run all earlier ones
    again.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint()
