"""Parameters of index building and searching."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class IndexConfig:
    """Immutable settings; ``from_spark`` overlays ``lodestar.<name>`` settings of the session.

    A pool or a degree larger than the data set is clamped to it where it is used.
    """

    input_file: str = ""
    aknng_file: str = ""
    nsg_file: str = ""
    lines: int = 0  # 0: all records
    k: int = 100
    pre_nndescent_k: int = 10
    max_nndescent_iterations: int = 10
    max_reverse_neighbors_nndescent: int = 100
    max_reverse_neighbors_nsg: int = 50
    max_neighbor_candidates: int = 500
    candidate_queue_size_knng: int = 200
    candidate_queue_size_nsg: int = 200
    workers: int = 4
    approximate_navigating_node: bool = False  # by a beam search instead of the exact nearest to the centroid
    data_redistribution: str = "optimalRedistribution"  # or noRedistribution, fastRedistribution
    data_replication: str = "allSharedReplication"  # or noReplication, onlyParentsReplication
    query_file: str = ""
    query_result_file: str = ""
    candidate_queue_increase_by: int = 20
    candidate_queue_increases: int = 5
    strict_initial_radius: bool = False
    edge_direction: str = "reversed"  # in-degree is bounded; "forward" bounds out-degree
    seed: int = 42

    def __post_init__(self) -> None:
        for name in ("k", "pre_nndescent_k", "max_reverse_neighbors_nndescent", "max_reverse_neighbors_nsg", "max_neighbor_candidates", "candidate_queue_size_knng", "candidate_queue_size_nsg", "workers"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be positive")
        if self.data_redistribution not in ("noRedistribution", "optimalRedistribution", "fastRedistribution"):
            raise ValueError(f"unknown data_redistribution {self.data_redistribution}")
        if self.data_replication not in ("noReplication", "onlyParentsReplication", "allSharedReplication"):
            raise ValueError(f"unknown data_replication {self.data_replication}")
        if self.edge_direction not in ("reversed", "forward"):
            raise ValueError(f"unknown edge_direction {self.edge_direction}")

    @classmethod
    def from_spark(cls, spark: SparkSession, **given) -> IndexConfig:
        found = {}
        for f in fields(cls):
            value = spark.conf.get(f"lodestar.{f.name}", None)
            if value is not None:
                kind = type(f.default)
                found[f.name] = value.lower() == "true" if kind is bool else kind(value)
        return replace(cls(**found), **given)

    def describe(self) -> list[str]:
        return [f"{f.name} = {getattr(self, f.name)}" for f in fields(self)]
