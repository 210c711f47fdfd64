"""All registered queries."""
from tickloom.harness import q_frames, q_replay, q_series, q_serving, q_streaming, q_telemetry  # noqa: F401
from tickloom.harness.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
