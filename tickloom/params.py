"""Tunables of the engine in one place."""
from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    """Window lengths, thresholds and caps. All durations are milliseconds.

    The defaults are fixed values of the data feed's contract; the harness
    scales them up because its event table is sparse.
    """

    gap_ms: int = 1_000            # at most one retained sample per gap
    ring: int = 900                # retained samples per asset, by count
    short_ms: int = 60_000         # look-back of c1m
    long_ms: int = 300_000         # look-back of c5m
    hour_ms: int = 3_600_000       # look-back of the optional 1 h change
    vol_ms: int = 300_000          # volatility window
    threshold: float = 5.0         # surge threshold, percentage points
    surge_ms: int = 60_000         # surge look-back
    cooldown_ms: int = 120_000     # minimum distance of two alerts of an asset
    snapshot_ms: int = 1_000       # minimum distance of two snapshots
    top: int = 50
    slice_ms: int = 900_000        # unit of parallel work inside one asset

    def __post_init__(self) -> None:
        if self.slice_ms <= 0 or self.gap_ms <= 0:
            raise ValueError("slice_ms and gap_ms must be positive")
        if self.vol_ms > (self.ring - 1) * self.gap_ms:
            raise ValueError("vol_ms must fit into ring * gap_ms")

    def reaches(self, back_ms: int) -> bool:
        """Whether the ring keeps samples ``back_ms`` old however dense the feed is. Beyond
        that a change is 0 with its flag off."""
        return back_ms <= (self.ring - 1) * self.gap_ms

    @property
    def surge_window_s(self) -> int:
        return self.surge_ms // 1_000
