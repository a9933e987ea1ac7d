"""classyard: a Spark-native engine for benchmarking classifier families.

Layers:
  sources/    table scans, stand-in dataset builders, result-record sink/scan
  functions/  column expressions (parsing, hashing, deterministic randomness)
  operators/  preprocessing, samplers, models, evaluation, importance, analytics
  plans/      composed jobs: benchmark run, registered queries + SQL oracles
  streaming/  scoring an event stream with a fitted model
"""
from classyard.session import get_spark, checkpoint_dir  # noqa: F401
