"""Steps that several outputs of one query go by are worked out once."""

import pytest

from albumloom.operators import batches, components, duplicates, naming
from albumloom.plans import load_all

SF = "/root/testdata/sf0.001"


def counted(monkeypatch, module, name):
    calls, plain = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a, **k: calls.append(name) or plain(*a, **k))
    return calls


def test_radii_share_nodes_and_pairs(spark, monkeypatch):
    nodes, pairs = counted(monkeypatch, duplicates, "_nodes"), counted(monkeypatch, duplicates, "pairs_within")
    load_all()["duplicates_by_radius"].run(spark, SF)
    assert len(nodes) == 1 and len(pairs) == 3


def test_stars_need_no_round(spark, monkeypatch):
    monkeypatch.setattr(components, "_large_star", lambda edges: pytest.fail("a round"))
    got = components.components(spark.createDataFrame([(5, 1), (1, 7), (9, 1), (4, 3)], "a bigint, b bigint")).collect()
    assert sorted(map(tuple, got)) == [(1, 1), (3, 3), (4, 3), (5, 1), (7, 1), (9, 1)]


def test_document_groups_copies_once(spark, monkeypatch):
    nodes = counted(monkeypatch, duplicates, "_nodes")
    load_all()["batch_document"].run(spark, SF)
    assert len(nodes) == 1


def test_batches_split_once(spark, monkeypatch, tmp_path):
    """The splitter sees each piece one time in all, also when the batches are read."""
    seen = tmp_path / "seen"
    seen.mkdir()
    plain = batches._split_local

    def marked(p):
        run = plain(p)

        def split(pdf):
            import uuid

            (seen / uuid.uuid4().hex).touch()
            return run(pdf)

        return split

    monkeypatch.setattr(batches, "_split_local", marked)
    df = load_all()["batch_item_ids"].run(spark, "/root/testdata/sf0.01")
    first = len(list(seen.iterdir()))
    df.collect()
    assert first > 0 and len(list(seen.iterdir())) == first


def test_copy_plans_read_their_steps_once(spark):
    """Holders and digest names are stored: the plan that is left has no grouping and no order by source."""
    rows = [("f", "a.jpg", f"/{i}/a.jpg", str(i % 2)) for i in range(6)]
    plan = naming.plan_copies(spark.createDataFrame(rows, "folder string, name string, src string, c string"), same="c")
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by" not in text and "first(_c_" not in text
    assert sorted(r["status"] for r in plan.collect()) == ["copied"] + ["copied_hashed"] * 3 + ["exists_same"] * 2


def test_removal_list_orders_stored_copies(spark):
    """The order's sampling does not work the groups out again."""
    assert "max_by" not in load_all()["removal_lines"].run(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
