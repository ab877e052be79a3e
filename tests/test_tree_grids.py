"""The bake-offs give tree candidates the whole grids on the full folds."""

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import estimators, trees
from ledgerline.plans import catalog_models, load_catalog
from ledgerline.plans.registry import REGISTRY

SCORES = "mission string, repeat int, fold int, Model string, n_test_rows long, MAE double, RMSE double, R2 double"
MISSIONS = ["ACE", "Beyond Earth", "Resilient Earth"]


@pytest.fixture
def labelled_rows(spark):
    """The columns of both feature sets, for 12 space companies and 2 added ones a mission."""
    facts = [(f"{m}{i}", 2020, m, "space" if i < 12 else "adjacent", 10.0 + i, 1.0) for m in MISSIONS for i in range(14)]
    df = spark.createDataFrame(facts, "company_id string, year int, mission string, population_type string, total_turnover double, sample_weight double")
    wanted = catalog_models.POOLED_SET
    more = {c: F.lit(1.0) for c in wanted.numeric if c not in df.columns} | {c: F.lit("a") for c in wanted.categories if c not in df.columns}
    return df.withColumns(more)


@pytest.mark.parametrize(("key", "groups"), [("e14_pooled_bakeoff", ["all"]), ("e2_run_bakeoff", MISSIONS)])
def test_tree_candidates_take_the_whole_grids_on_the_full_folds(spark, monkeypatch, labelled_rows, key, groups):
    load_catalog()
    seen = []

    def out_of_fold(cut, outers, models, features, target, weight, keep, group):
        seen.append((cut.select(group).distinct(), outers, models))
        columns = [F.lit(0).alias("repeat"), F.lit(0).alias("fold"), F.lit("m").alias("Model"), *[F.lit(1.0).alias(c) for c in ("actual", "predicted", "weight")]]
        return cut.select(*keep, *columns)

    monkeypatch.setattr(trees, "out_of_fold", out_of_fold)
    for name in ("core_rows", "training_rows_with_adjacent"):
        monkeypatch.setattr(catalog_models, name, lambda t: labelled_rows)
    monkeypatch.setattr(catalog_models, "linear_bakeoff", lambda *given: None)
    monkeypatch.setattr(catalog_models, "fold_scores", lambda bake: spark.createDataFrame([], SCORES))
    REGISTRY[key].build(None)
    ((found, outers, models),) = seen
    assert sorted(r[0] for r in found.collect()) == groups
    assert [(o.labels["repeat"], o.labels["fold"], len(o.inner)) for o in outers] == [(repeat, fold, 3) for repeat in range(5) for fold in range(5)]
    assert sorted(models) == ["Categorical Boosting", "Extra Trees", "Gradient Boosting", "Random Forest"]
    assert all(len(c.settings()) == 8 and c.settings() == estimators.MODELS[name].settings() for name, c in models.items())
