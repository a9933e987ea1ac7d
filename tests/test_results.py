"""A re-run replaces its own documents and leaves the others."""
from classyard.sources.results import RESULT_SCHEMA, read_results, write_results


def record(spark, *rows):
    cols = [p.split(" ")[0] for p in RESULT_SCHEMA.split(", ")]
    made = [tuple({"dataset": d, "key": k, "status": s, "accuracy": a}.get(c) for c in cols) for d, k, s, a in rows]
    return spark.createDataFrame(made, RESULT_SCHEMA)


def test_rerun_of_one_model_keeps_the_others(spark, tmp_path):
    path = str(tmp_path / "results")
    write_results(record(spark, ("a", "knn5", "ok", 0.5), ("a", "ridge", "ok", 0.6), ("b", "knn5", "failed", None)), path)
    write_results(record(spark, ("a", "ridge", "ok", 0.9)), path)
    got = {(r.dataset, r.key): r.accuracy for r in read_results(spark, path, status=None).collect()}
    assert got == {("a", "knn5"): 0.5, ("a", "ridge"): 0.9, ("b", "knn5"): None}
    assert {(r.dataset, r.key) for r in read_results(spark, path).collect()} == {("a", "knn5"), ("a", "ridge")}
