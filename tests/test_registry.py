"""The registry imports and builds its SQL with no session and no Spark jar in sight."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]

PROBE = """
import glob, zipfile
def refuse(*a, **k):
    raise FileNotFoundError("no file may be read at import")
glob.glob = zipfile.ZipFile = refuse
import __spark_entry__ as e
from pyspark.sql import SparkSession
assert len(e.queries()) >= 160 and len(e.oracle_sql()) >= 138
assert set(e.oracle_sql()) <= set(e.queries())
assert SparkSession.getActiveSession() is None
"""


def test_import_reads_no_jar():
    run = subprocess.run([sys.executable, "-c", PROBE], cwd=ROOT, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr


def test_stop_words_are_pinned():
    from tavola.functions.text import STOP_WORDS
    assert len(STOP_WORDS) == len(set(STOP_WORDS)) == 181
    assert STOP_WORDS[0] == "i" and STOP_WORDS[-1] == "would"


def test_models_are_registered_whole(monkeypatch):
    """Every model query runs its operator with the operator's own parameters."""
    import inspect
    from tavola.operators import ml
    from tavola.plans import q_ml
    calls = {}

    class Anything:
        """Stands for a session, a table or a model: whatever is asked of it is another one."""

        def __getattr__(self, name):
            return Anything()

        def __call__(self, *args, **more):
            return Anything()

        def __getitem__(self, k):
            return Anything()

    def caught(name):
        signature = inspect.signature(getattr(ml, name))

        def call(*args, **more):
            bound = signature.bind(*args, **more)
            bound.apply_defaults()
            calls[name] = bound.arguments
            return Anything()
        return call, {k: p.default for k, p in signature.parameters.items() if p.default is not p.empty}
    for place, name in [(q_ml, "_folds"), (q_ml, "_churn_data"), (q_ml, "_ltv_table"), (q_ml, "_train_table"), (q_ml.D, "transactions")]:
        monkeypatch.setattr(place, name, lambda *a, **k: Anything())
    monkeypatch.setattr(q_ml, "_model", lambda spark, name, sf, train: train()[0])
    monkeypatch.setattr(q_ml, "_place", lambda spark, name, sf, make: make("/nowhere"))
    for made in ("score_churn", "predict_ltv", "forecast", "feature_importance"):
        monkeypatch.setattr(ml, made, lambda *a, **k: Anything())
    spark = Anything()
    runs = {"tune": [lambda: q_ml.f10(spark, None), lambda: q_ml.f12(spark, None)], "cross_validate": [lambda: q_ml.f11(spark, None)],
            "churn_cv": [lambda: q_ml.c03c_cv(spark, None)], "ltv_cv": [lambda: q_ml.c04d_cv(spark, None)],
            "train_churn": [lambda: q_ml.c03c(spark, None), lambda: q_ml.c03d(spark, None)],
            "train_ltv": [lambda: q_ml.c04d(spark, None), lambda: q_ml._ltv_pred(spark, None)],
            "train_churn_forest": [lambda: q_ml.c03c_forest(spark, None)], "train_ltv_forest": [lambda: q_ml.c04d_forest(spark, None)],
            "train_forecaster": [lambda: q_ml.f04(spark, None), lambda: q_ml.f05(spark, None), lambda: q_ml.f08(spark, None)]}
    monkeypatch.setattr(ml, "search_summary", lambda trials: None)
    monkeypatch.setattr(q_ml, "AS_OF", "2001-08-02")
    monkeypatch.setattr(q_ml.C, "ltv_features", lambda *a, **k: None)
    tune_trials = inspect.signature(ml.tune).parameters["n_trials"].default
    for name, uses in runs.items():
        call, defaults = caught(name)
        monkeypatch.setattr(ml, name, call)
        for run in uses:
            calls.clear()
            run()
            assert {k: calls[name][k] for k in defaults} == defaults, name
    assert ml.CHURN_PARAMS.rounds == ml.LTV_PARAMS.rounds == 200
    assert (ml.DEMAND_PARAMS.rounds, ml.DEMAND_PARAMS.leaves, ml.DEMAND_PARAMS.stop_after) == (500, 31, 50)
    assert ml.SEARCH_SPACE["rounds"] == ("int", 100, 1000)
    assert tune_trials >= 50
