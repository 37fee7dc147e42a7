"""Grid parsing, promotion, gate and rerun behaviour on a small export."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from claimloom.operators import gate, issues, joins, merge
from claimloom.operators.rows import with_parents, with_row_class
from claimloom.plans import publish
from claimloom.plans.ingest import parse_import
from claimloom.plans.promotion import ImportJob, empty_tables, promote
from claimloom.schema import GRID, TABLE_KEYS, MoneyColumn, SheetLayout
from claimloom.sources import grid as grids
from claimloom.sources import tables as sources

LAYOUT = SheetLayout()
HEAD = ["Name", "Status", "Contractor", "Insurance Carrier", "CH", "Initial Ins. RCV", "Requested RCV", "Current Ins. RCV",
        "Additional Secured $", "Percentage Increase", "Client Fee", "Assigned", "Closed Date", "Date of Status Change",
        "Date of Loss", "Item ID (auto generated)", "CH Update", "CH Update", None]
POST_HEAD = ["Item ID", "Post ID", "Parent Post ID", "Update Content", "Created At", "User", "Content Type", "Content Type"]
JOB = ImportJob("board", "2026-Q2", "x.xlsx", "a" * 64, "v1", "t1", "2026-07-01 00:00:00")


def archive_row(**cells):
    named = dict(zip(HEAD[:16], [None] * 16))
    named.update({k.replace("_", " "): v for k, v in cells.items()})
    return [named[h] for h in HEAD[:16]] + [None, None, None]


def claim_row(item, initial="100", current="150", additional="50", percentage="1", contractor="A&B Co", **more):
    row = {
        "Name": f"Claim {item}", "Status": "Complete", "Contractor": contractor, "Insurance Carrier": "Mutual", "CH": "Pat",
        "Initial Ins. RCV": initial, "Current Ins. RCV": current, "Additional Secured $": additional,
        "Percentage Increase": percentage, "Item ID (auto generated)": item, "Assigned": "2026-04-01", "Closed Date": "2026-04-05T10:00:00",
    }
    row.update(more)
    return [row.get(h) for h in HEAD[:16]] + [None, None, None]


def export(contractor="A&B Co", body="hello"):
    archive = {
        5: HEAD,
        6: archive_row(Name="loose detail"),
        7: claim_row("1", contractor=contractor),
        8: archive_row(Name="Subitems"),
        9: archive_row(),
        10: claim_row("2", initial=None, contractor="a b  co"),
        11: archive_row(Name="   "),
        12: claim_row("3", additional="50.005", percentage="4510", Status="Closed "),
        13: claim_row("4", additional="49", percentage="4509%", Status=None),
        14: claim_row("5", additional=None, current="$1,150.00"),
    }
    posts = {
        2: POST_HEAD,
        3: ["1", "p1", None, f" {body} ", "08/April/2025  08:16:10 PM", "Ann"],
        4: ["1", "p2", "p1", body, "8 April 2025 08:16 PM", None],
        5: ["9", "p3", "p1", "\t ", "later", "Bob"],
        6: [None, "p4", "zz", None, None, "Bob"],
        7: ["1", "p1", None, "other text", None, "Cy"],
    }
    rows = [("f", LAYOUT.archive_sheet, n, c) for n, c in archive.items()]
    rows += [("f", LAYOUT.updates_sheet, n, c + [None] * (8 - len(c))) for n, c in posts.items()]
    return rows


@pytest.fixture(scope="module")
def parsed(spark):
    return parse_import(spark.createDataFrame(export(), GRID), LAYOUT, block_rows=2)


def test_header_names(spark, parsed):
    names = {(r.sheet, r.position): r.internal for r in parsed.headers.collect()}
    assert names[("archive", 17)] == "CH Update" and names[("archive", 18)] == "CH Update__column_18"
    assert names[("archive", 19)] == "unnamed_column_19" and names[("updates", 8)] == "Content Type__column_8"
    ordinal = grids.ordinal_headers(grids.header_cells(spark.createDataFrame(export(), GRID), LAYOUT.header_rows))
    names = {(r.sheet, r.position): r.internal for r in ordinal.collect()}
    assert names[("archive", 18)] == "CH Update__2" and names[("archive", 19)] == "Unnamed_19"


def test_rows_find_their_parents(parsed):
    details = {r.source_row: (r.parent_item_id, r.header_row) for r in parsed.subitem_details.collect()}
    # before any claim; below a header; below a claim that ended the section
    assert details == {6: (None, None), 9: ("1", 8), 11: ("2", None)}
    assert [(r.source_row, r.parent_item_id) for r in parsed.subitem_headers.collect()] == [(8, "1")]


def test_parents_do_not_cross_sheets(spark):
    rows = [("f", "a", 1, ["c1", "n"]), ("f", "b", 2, [None, None]), ("g", "a", 3, [None, None]), ("f", "a", 9, [None, None])]
    df = spark.createDataFrame(rows, GRID)
    found = with_parents(with_row_class(df, F.get("cells", F.lit(0)), F.get("cells", F.lit(1))), block_rows=2).collect()
    assert {(r.file_name, r.sheet, r.physical_row): r.parent_item_id for r in found if r.row_class != "claim"} == {
        ("f", "b", 2): None, ("g", "a", 3): None, ("f", "a", 9): "c1",
    }


def test_reconciliation_cases(parsed):
    found = {r.item_id: (r.reconciliation_status, r.difference) for r in parsed.claims.collect()}
    assert {k: v[0] for k, v in found.items()} == {
        "1": "exact_match", "2": "missing_component", "3": "tolerance_match", "4": "mismatch", "5": "mismatch",
    }
    assert found["5"][1] is None and float(found["4"][1]) == 1.0


def test_updates_are_matched_and_flagged(parsed):
    rows = sorted(parsed.updates.collect(), key=lambda r: r.source_row)
    assert [r.matched for r in rows] == [True, True, False, False, True]
    assert [r.blank_body for r in rows] == [False, False, True, True, False]
    assert [r.duplicate_body for r in rows] == [True, True, False, False, False]
    assert rows[0].timestamp_parsed == datetime(2025, 4, 8, 20, 16, 10)
    assert [r.timestamp_state for r in rows] == ["unknown_timezone"] * 2 + ["unparseable"] + ["unknown_timezone"] * 2


def test_reply_threads(parsed):
    posts = parsed.updates.select("post_id", "item_id", "parent_post_id", "author").where("source_row < 7")
    assert {r.post_id: r.thread_role for r in joins.reply_threads(posts).collect()} == {
        "p1": "root", "p2": "reply", "p3": "orphan_reply", "p4": "orphan_reply",
    }


def test_summary_and_gate(spark, parsed):
    summary = gate.import_summary(parsed.claims, parsed.subitem_headers, parsed.subitem_details, parsed.updates)
    counts = {r.measure: r.actual for r in summary.collect()}
    assert counts == {
        "claims": 5, "complete": 3, "closed": 1, "subitem_headers": 1, "subitem_details": 3, "updates": 5,
        "unmatched_update_rows": 2, "unmatched_update_item_ids": 1, "unique_post_ids": 4, "blank_update_bodies": 2,
        "duplicate_body_surplus": 1, "exact_matches": 1, "tolerance_matches": 1, "mismatches": 2, "missing_components": 1,
    }
    right = spark.createDataFrame(list(counts.items()), "measure string, expected long")
    gate.require_gate(gate.compare_counts(summary, right))
    wrong = right.withColumn("expected", F.when(F.col("measure") == "claims", 6).otherwise(F.col("expected")))
    compared = gate.compare_counts(summary, wrong)
    assert [r.message for r in compared.where("not passes").collect()] == ["claims: expected 6, found 5"]
    with pytest.raises(ValueError, match="1 counts differ"):
        gate.require_gate(compared)


def saved(tables, root, version):
    for name, df in tables.items():
        sources.write_version(df, root, name, version)
    spark = next(iter(tables.values())).sparkSession
    return {name: sources.read_version(spark, root, name, version).drop("version") for name in tables}


@pytest.fixture(scope="module")
def promoted(spark, parsed, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    first = saved(promote(empty_tables(spark), parsed, JOB, LAYOUT), root, "1")
    second = saved(promote(first, parsed, JOB, LAYOUT), root, "2")
    return root, first, second


def test_every_table_is_unique_by_its_key(promoted):
    for name, df in promoted[1].items():
        assert df.count() == df.select(*TABLE_KEYS[name]).distinct().count(), name
    assert promoted[1]["claim_financial_facts"].count() == 5 * 6
    assert promoted[1]["claim_updates"].count() == 4
    # the two spellings are one organization; the later row names it
    contractors = promoted[1]["organizations"].where("organization_type = 'contractor'").collect()
    assert [r.display_name for r in contractors] == ["A&B Co"]


def test_rerun_changes_nothing(promoted):
    for name in promoted[1]:
        assert merge.row_differences(promoted[1][name], promoted[2][name]).count() == 0, name


def test_stored_posts_are_immutable_and_names_follow(spark, promoted):
    root, first, _ = promoted
    changed = parse_import(spark.createDataFrame(export(contractor="A B Company!", body="edited"), GRID), LAYOUT, block_rows=2)
    third = saved(promote(first, changed, JOB, LAYOUT), root, "3")
    posts = {r.post_id: r.update_body for r in third["claim_updates"].collect()}
    assert posts["p1"] == "hello" and posts["p2"] == "hello"
    assert {r.normalized_name for r in third["organizations"].collect()} == {"a b co", "a b company ", "mutual"}
    assert merge.changed_rows(first["source_rows"], third["source_rows"], ["source_row_id"]).count() == 0


def test_new_version_is_a_new_job_with_its_own_gate(spark, parsed, promoted):
    _, first, _ = promoted
    job = ImportJob("board", "2026-Q2", "x.xlsx", "a" * 64, "v2", "t1", "2026-07-02 00:00:00")
    after = promote(first, parsed, job, LAYOUT)
    assert after["import_jobs"].count() == 2 and after["claim_updates"].count() == 4
    assert gate.latest_job(after["import_jobs"]).first().importer_version == "v2"
    # counted on the batch, so the second version passes although its posts are stored under the first
    batch = gate.import_summary(parsed.claims, parsed.subitem_headers, parsed.subitem_details, parsed.updates)
    assert {r.measure: r.actual for r in batch.collect()}["updates"] == 5


def test_issues(promoted):
    keys = {r.deterministic_key.split(":")[0] for r in promoted[1]["dq_issues"].collect()}
    assert keys == {"missing-initial-rcv", "extreme-percentage", "unmatched-update", "blank-update", "duplicate-update-body",
                    "duplicate-header", "timezone", "subitems"}
    rolled = {r.issue_type: r.issues for r in issues.issue_rollup(promoted[1]["dq_issues"]).collect()}
    assert rolled["extreme_percentage_value"] == 1 and rolled["unmatched_update_item_id"] == 2
    assert rolled["duplicate_header_disambiguation"] == 2


def test_ledger_life(spark, parsed, promoted):
    jobs, found = promoted[1]["import_jobs"], promoted[1]["dq_issues"]
    assert jobs.first().status == "running"
    summary = gate.import_summary(parsed.claims, parsed.subitem_headers, parsed.subitem_details, parsed.updates)
    counts = summary.withColumn("import_job_id", JOB.job_id)
    at = F.lit("2026-07-01 01:00:00").cast("timestamp")
    done = gate.finalize_job(jobs, counts, found, at).first()
    assert done.status == "completed_with_warnings" and done.warning_count == 6 and done.accepted_counts["claims"] == 5
    clean = gate.finalize_job(jobs, counts, found.where("severity = 'info'"), at).first()
    assert clean.status == "completed" and clean.warning_count == 0
    failed = gate.fail_job(jobs, "a" * 64, "v1", "m" * 3000, at).first()
    assert failed.status == "failed" and failed.error_count == 1 and len(failed.last_error) == 2000
    assert gate.fail_job(jobs, "b" * 64, "v1", "m", at).first().status == "running"


def test_validation_counts(promoted):
    t = promoted[1]
    row = gate.validation_counts(
        t["import_jobs"], t["claims"], t["staged_subitem_headers"], t["staged_subitem_details"], t["claim_updates"],
        t["claim_derived_metrics"],
    ).first()
    assert (row.claim_count, row.complete_status_count, row.closed_status_count) == (5, 3, 1)
    assert (row.update_count, row.unmatched_update_row_count, row.unmatched_update_item_id_count) == (4, 2, 1)
    assert row.additional_missing_component_count == 1


def test_published_views_hide_raw_columns(promoted):
    t = promoted[1]
    views = publish.published(t)
    for name, df in views.items():
        assert set(df.columns) == set(publish.PUBLISHED_COLUMNS[name])
        assert not {c for c in df.columns if c.startswith("raw_row") or c in ("metadata", "raw_value", "normalized_name")}
    assert {r.post_id for r in views["claim_updates"].collect()} == {"p1", "p2"}
    summary = {r.metric: r for r in publish.live_summary(t["claims"], t["claim_financial_facts"], t["claim_derived_metrics"]).collect()}
    assert summary["calculated_additional"].value == 50 * 3 + 1050 and summary["calculated_additional"].available == 4
    assert summary["client_fee"].value == 0.0 and summary["financial_coverage"].value == 80.0
    nothing = publish.live_summary(t["claims"].where("false"), t["claim_financial_facts"], t["claim_derived_metrics"])
    with pytest.raises(ValueError, match="no claims"):
        publish.require_claims(nothing)
    detail = publish.claim_detail(t, t["claims"].where("item_id = '1'").first().claim_id).first()
    assert len(detail.financial_facts) == 6 and detail.contractor == "A&B Co"
    assert publish.claim_detail(t, "unknown").count() == 0


def test_artifacts_shape_and_report(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.bin").write_bytes(b"abc")
    (folder / "b.bin").write_bytes(b"x")
    before = grids.artifact_hashes(spark, str(folder))
    good = "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    manifest = spark.createDataFrame([("a.bin", good)], "file_name string, expected_sha256 string")
    assert {r.file_name: r.accepted for r in grids.check_artifacts(before, manifest).collect()} == {"a.bin": True, "b.bin": False}
    assert {r.accepted for r in grids.check_artifacts(before, manifest, allow_mismatch=True).collect()} == {True}
    kept = spark.createDataFrame(before.collect(), before.schema)
    (folder / "b.bin").write_bytes(b"y")
    after = grids.artifact_hashes(spark, str(folder))
    assert {r.file_name: r.unchanged for r in grids.artifacts_unchanged(kept, after).collect()} == {"a.bin": True, "b.bin": False}

    expected = spark.createDataFrame([("archive", 14, 19), ("third", 1, 1)], "sheet string, expected_last_row long, expected_columns long")
    verdicts = {r.sheet: r.passes for r in grids.shape_gate(spark.createDataFrame(export(), GRID), expected).collect()}
    assert verdicts == {"archive": True, "updates": False, "third": False}

    report = spark.createDataFrame([(2, 1)], "b int, a int")
    sources.write_report(report, str(tmp_path / "report"))
    line = next((tmp_path / "report").glob("*.json")).read_text()
    assert list(json.loads(line)) == ["a", "b"]


def test_grid_formats_and_append(spark, tmp_path):
    grid = spark.createDataFrame(export(), GRID)
    for fmt in ("parquet", "orc", "json"):
        path = str(tmp_path / fmt)
        grid.write.format(fmt).save(path)
        assert grids.read_grid(spark, path, fmt).exceptAll(grid).count() == 0
    rows = spark.createDataFrame([(1, "j1"), (2, "j1"), (3, "j2")], "v int, import_job_id string")
    target = str(tmp_path / "appended")
    sources.append_by_job(rows.where("import_job_id = 'j1'"), target)
    sources.append_by_job(rows.where("import_job_id = 'j2'"), target)
    sources.append_by_job(rows.where("import_job_id = 'j1'"), target)
    assert sorted(r.v for r in spark.read.parquet(target).collect()) == [1, 2, 3]
    read = sources.read_table(spark, target, ["v"], F.col("v") > 1, [F.desc("v")], 1)
    assert [r.v for r in read.collect()] == [3]


def test_batches(spark):
    counts = spark.createDataFrame(
        [("source_rows", 7678), ("claims", 214), ("subitem_headers", 148), ("subitem_details", 1359), ("updates", 5957)],
        "phase string, rows long",
    )
    assert sources.batch_count(counts).first().batch_count == 81
    assert sources.batch_count(counts.where("false")).first().batch_count == 1


def test_money_columns_are_configurable(spark):
    assert SheetLayout(money=(MoneyColumn("m", "H", 1),)).money[0].metric == "m"


def test_repeated_parent_posts_do_not_multiply_replies(spark):
    posts = spark.createDataFrame(
        [("i", "p", None, "b"), ("i", "p", None, "a"), ("i", "q", "p", "c"), (None, "r", "p", "d")],
        "item_id string, post_id string, parent_post_id string, author string",
    )
    rows = sorted((r.post_id, r.thread_role, r.parent_author) for r in joins.reply_threads(posts).collect() if r.post_id > "p")
    assert rows == [("q", "reply", "a"), ("r", "orphan_reply", None)]


def test_keyed_writes_refuse_missing_keys(spark):
    from claimloom.operators import merge

    stored = spark.createDataFrame([("s", "1", "x")], "system string, post string, body string")
    batch = spark.createDataFrame([("s", None, "a"), ("s", None, "b"), ("s", "2", "c")], stored.schema)
    fresh = merge.insert_if_absent(stored, batch, ["system", "post"], [F.col("body")])
    assert [tuple(r) for r in fresh.collect()] == [("s", "2", "c")]
    assert merge.insert_if_absent(stored.unionByName(fresh), batch, ["system", "post"], [F.col("body")]).count() == 0
    assert merge.without_key(batch, ["system", "post"]).count() == 2


def test_blank_links_stay_as_stored(spark):
    from claimloom.operators import merge

    stored = spark.createDataFrame([(1, "carrier", "old")], "id int, link string, status string")
    batch = spark.createDataFrame([(1, None, None), (2, None, "new")], stored.schema)
    rows = merge.upsert(stored, batch, ["id"], ["link", "status"], keep_if_missing=["link"]).collect()
    assert sorted(map(tuple, rows)) == [(1, "carrier", None), (2, None, "new")]
