"""Registered queries; importing this package fills the registry."""

from importlib import import_module

for _name in ("signal_queries", "landmark_queries", "cue_queries", "text_queries", "join_queries", "metric_queries", "augment_queries", "source_queries", "job_queries"):
    import_module(f"tierloom.plans.{_name}")
