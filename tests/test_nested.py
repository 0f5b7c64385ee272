"""The ledger of nested selection: a run that stops midway, and one that finishes it."""

import json
import threading

import numpy as np
import pytest

from cohortspark.operators import heads as Z
from cohortspark.operators import nested as N

FAMILIES = {"flat": {"c=0.01": {"c": 0.01}, "c=1": {"c": 1.0}}}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    out = []
    for k in range(150):
        y = int(rng.integers(3))
        x = rng.normal(size=4)
        x[y] += 1.5
        out.append((k, k % 23, y, x.tolist()))
    return spark.createDataFrame(out, "id long, grp int, y int, features array<double>")


def counted(limit=None):
    """A factory of fits that notes what it was asked for, and one that fails after ``limit`` requests."""
    asked, lock = [], threading.Lock()

    def fit_of(family, settings):
        with lock:
            if limit is not None and len(asked) >= limit:
                raise RuntimeError("the driver was lost")
            asked.append((family, json.dumps(settings)))
        return Z.flat(3, **settings)

    return fit_of, asked


def test_a_run_that_stops_is_finished_with_the_missing_fits_only(spark, rows, tmp_path):
    fit_of, first = counted(4)
    with pytest.raises(RuntimeError, match="lost"):
        N.nested_runs(rows, FAMILIES, fit_of, 3, str(tmp_path / "a"), outer=3, inner=2, parallel=1)
    assert len(first) == 4
    fit_of, second = counted()
    selection, done, held = N.nested_runs(rows, FAMILIES, fit_of, 3, str(tmp_path / "a"), outer=3, inner=2)
    assert len(second) == 3 * 2 + 3 - 4  # the rest of the inner scores, and the outer fits
    fit_of, third = counted()
    again = N.nested_runs(rows.repartition(7), FAMILIES, fit_of, 3, str(tmp_path / "a"), outer=3, inner=2)
    assert third == []
    whole = N.nested_runs(rows, FAMILIES, counted()[0], 3, str(tmp_path / "b"), outer=3, inner=2)

    def told(frame):
        return sorted((r.family, r.outer_fold, r.candidate, r.n, round(r.accuracy, 6), round(r.macro_f1, 6)) for r in frame.collect())

    assert told(done) == told(again[1]) == told(whole[1]) and len(told(done)) == 3
    assert told(selection) == told(whole[0]) and len(told(selection)) == 6
    assert sorted(r.id for r in held.collect()) == list(range(150))


def test_the_best_inner_score_is_selected_and_scores_match_the_probabilities(spark, rows, tmp_path):
    selection, done, held = N.nested_runs(rows, FAMILIES, N.heads_of(3), 3, str(tmp_path / "c"), outer=2, inner=2)
    by_fold = {}
    for r in selection.collect():
        by_fold.setdefault(r.outer_fold, []).append(r)
    labels = {r.id: r.y for r in rows.collect()}
    groups = {r.id: r.grp for r in rows.collect()}
    folds = {}
    for k, own in by_fold.items():
        best = min(own, key=lambda r: (-round(r.macro_f1, 9), round(r.log_loss, 9), r.candidate))
        assert [r.candidate for r in own if r.selected] == [best.candidate]
        out = [r for r in held.collect() if r.outer_fold == k]
        for r in out:
            folds.setdefault(groups[r.id], set()).add(k)
        hits = [int(np.argmax(r.p)) == labels[r.id] for r in out]
        entry = next(r for r in done.collect() if r.outer_fold == k)
        assert entry.n == len(out) and entry.accuracy == pytest.approx(np.mean(hits))
        loss = -np.mean([np.log(r.p[labels[r.id]]) for r in out])
        assert entry.log_loss == pytest.approx(loss)
    assert all(len(f) == 1 for f in folds.values()) and len(folds) == 23  # groups stay whole


def test_other_rows_or_settings_are_another_contract(spark, rows):
    own = N.contract_of(rows, FAMILIES, classes=3)
    assert own == N.contract_of(rows.repartition(5), FAMILIES, classes=3)
    assert own != N.contract_of(rows.where("id > 0"), FAMILIES, classes=3)
    assert own != N.contract_of(rows, FAMILIES, classes=4)
    assert own != N.contract_of(rows, {"flat": {"c=1": {"c": 1.0}}}, classes=3)


def test_a_half_written_entry_is_written_again(spark, tmp_path):
    ledger = N.Ledger(spark, str(tmp_path), "x")
    at = tmp_path / "contract=x" / "inner" / ledger.folder("inner", "f", 0, "c").split("/")[-1] / "_temporary" / "0"
    at.mkdir(parents=True)
    (at / "part-0.parquet").write_bytes(b"cut off")
    declared = spark.createDataFrame([("f", 0, "c")], "family string, outer_fold int, candidate string")
    assert len(ledger.missing("inner", declared)) == 1
    ledger.add("inner", ("f", 0, "c", 5, 0.5, 0.5, 1.0))
    assert ledger.missing("inner", declared) == [] and ledger.read("inner").count() == 1
