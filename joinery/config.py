"""Options of the partitioned join."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class JoinConfig:
    """Partition layout and limits.

    ``network_bits`` and ``local_bits`` are the low key bits of the two radix
    levels; ``nodes`` stands for the machines that own partitions; ``buckets``
    is the fan-out of a plain bucket table; ``skew_threshold`` is how many rows
    of a partition one slice takes; ``max_matches`` caps matches per probe row
    where a cap is asked for; ``broadcast_rows`` and ``broadcast_bytes`` are how
    many rows and bytes a side may have to be broadcast; ``task_bytes`` is what
    one task of an exchange should get; ``hot_rows`` is how many rows of one key a
    slice of a salted join takes; ``pad`` rounds sub-partitions up to whole lines.
    """

    network_bits: int = 5
    local_bits: int = 5
    nodes: int = 4
    buckets: int = 16
    skew_threshold: int = 500
    max_matches: int = 8
    broadcast_rows: int = 1_000_000
    broadcast_bytes: int = 64 << 20
    task_bytes: int = 256 << 20
    hot_rows: int = 1_000_000
    pad: int = 8

    @property
    def network_partitions(self) -> int:
        return 1 << self.network_bits

    @property
    def local_partitions(self) -> int:
        return 1 << self.local_bits


DEFAULT = JoinConfig()
