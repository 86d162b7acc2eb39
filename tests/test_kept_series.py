"""The series kept up day by day against the whole recomputation."""

import json
import random

import pytest

from tests.test_series_of_snapshots import issue, team
from tidegauge.operators import series as sr
from tidegauge.operators.kept_series import KeptSeries, add_snapshots
from tidegauge.sources import snapshots

NAMES = ("2026-02-01", "2026-02-02", "2026-02-05", "2026-02-06", "2026-02-09")


def sprints(rng, day):
    states = ["future", "active", "closed"]
    return [{"id": n, "name": "S", "state": states[min(2, max(0, day - n % 3 + 1))] if n != 9 else "active", "startDate": "2026-02-01T00:00:00Z", "endDate": None if n == 4 else "2026-02-11T00:00:00Z"} for n in (3, 4, 5, 9) if day or n != 4]


def days(rng):
    for n, date in enumerate(NAMES):
        teams = []
        for t in "abc":
            if (t, n) in (("b", 2), ("c", 4), ("c", 0)):
                continue
            made = [issue(f"{t.upper()}-{i}", rng.choice(["To Do", "In Progress", "Done"]), rng.sample([3, 4, 5, 9], rng.randint(0, 2)), rng.choice([None, 1, 2, 5]), rng.choice("129x")) for i in range(25) if rng.random() < 0.8]
            columns = [("Dev", ["1"]), ("Check" if n < 2 else "Review", ["2"]), ("Done", ["9"])] if t != "b" else []
            teams.append(team(t, made, columns) | {"sprints": sprints(rng, n)})
        yield date, teams


@pytest.fixture
def root(tmp_path):
    for date, teams in days(random.Random(8)):
        (tmp_path / date).mkdir()
        (tmp_path / date / "jira.json").write_text(json.dumps({"schemaVersion": 4, "capturedAt": f"{date}T06:00:00Z", "teams": teams}))
    (tmp_path / "2026-02-07").mkdir()
    return f"file://{tmp_path}"


def rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


def test_equal_to_the_whole_recomputation(spark, root, tmp_path_factory):
    kept = KeptSeries(spark, f"file://{tmp_path_factory.mktemp('kept')}")
    assert add_snapshots(kept, root, NAMES[1]) == list(NAMES[:2])
    for up_to in (NAMES[1], NAMES[-1]):
        assert add_snapshots(kept, root, up_to) == ([] if up_to == NAMES[1] else list(NAMES[2:]))
        t = snapshots.series(spark, root, up_to)
        four = [t[n] for n in ("day", "day_issue", "day_member", "day_sprint")]
        for name, whole in (("sprint_delta", sr.sprint_delta(*four)), ("churn_summary", sr.churn_summary(*four)), ("burndown", sr.burndown(*four)), ("cumulative_flow", sr.cumulative_flow(*four, t["day_column"]))):
            got, want = rows(getattr(kept, name)()), rows(whole)
            assert got == want and want, name


def test_a_day_reads_itself_and_the_one_before(spark, root, tmp_path_factory, monkeypatch):
    kept = KeptSeries(spark, f"file://{tmp_path_factory.mktemp('kept')}")
    add_snapshots(kept, root, NAMES[3])
    read, real, real_read = [], snapshots.read_day, KeptSeries._read
    monkeypatch.setattr(snapshots, "read_day", lambda s, r, d, *a: (read.append(d), real(s, r, d, *a))[1])
    monkeypatch.setattr(KeptSeries, "_read", lambda self, n, ds: (read.append((n, len(ds))), real_read(self, n, ds))[1])
    add_snapshots(kept, root)
    assert {r for r in read if isinstance(r, str)} == {NAMES[4]}
    assert {n for n, k in (r for r in read if isinstance(r, tuple)) if k > 1} == {"days"}  # a row for each team and day
    with pytest.raises(ValueError):
        kept.add("2026-01-01", *(spark.createDataFrame([], "team string") for _ in range(5)))


def test_a_failed_day_is_done_again(spark, root, tmp_path_factory):
    base = tmp_path_factory.mktemp("kept")
    kept = KeptSeries(spark, f"file://{base}")
    add_snapshots(kept, root, NAMES[2])
    want = rows(kept.churn_summary())
    (base / "days" / NAMES[2]).rename(base / "moved")  # as if the run had ended before its last write
    assert kept.dates() == list(NAMES[:2])
    add_snapshots(kept, root, NAMES[2])
    assert rows(kept.churn_summary()) == want
