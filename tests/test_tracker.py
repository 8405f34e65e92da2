"""Issues and pages as data sources over JSON answers in a folder."""

import json

import pytest

from lorespark.sources import markup, tracker


def issue(k, project, status, **more):
    doc = {"type": "doc", "content": [{"type": "paragraph", "content": [{"type": "text", "text": f"about {k}"}]}]}
    return {"key": f"{project}-{k}", "fields": {"summary": f"issue {k}", "status": {"name": status}, "issuetype": {"name": "Bug"}, "assignee": None, "updated": f"2024-01-{k:02d}", "description": doc} | more}


ISSUES = [issue(k, "PAY" if k % 3 else "WEB", ["Open", "Done"][k % 2]) for k in range(1, 21)] + [{"key": None, "fields": None}]
PAGES = [{"id": k, "title": f"page {k}", "space": {"key": "OPS"} if k % 2 else None, "version": {"when": f"2024-02-{k:02d}"}, "excerpt": f"a @@@hl@@@hit@@@endhl@@@ &amp;\n {k}", "body": {"storage": {"value": f"<h1>T{k}</h1><p>text</p>"}}} for k in range(1, 8)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    tracker.register(spark)
    top = tmp_path_factory.mktemp("answers")
    for n, part in enumerate((ISSUES[:8], ISSUES[8:], [])):
        (top / "issues" / str(n)).mkdir(parents=True)
        (top / "issues" / str(n) / "a.json").write_text(json.dumps({"issues": part}))
    (top / "issues" / "notes.txt").write_text("no answer")
    (top / "pages").mkdir()
    (top / "pages" / "p.json").write_text(json.dumps({"results": PAGES}))
    (top / "none").mkdir()
    return str(top)


def test_issues(spark, folder):
    got = spark.read.format("tracker_issues").load(f"{folder}/issues")
    assert got.rdd.getNumPartitions() == 3
    rows = {r.key: r for r in got.collect()}
    assert len(rows) == 21 and rows["PAY-1"].asDict() == {"key": "PAY-1", "project": "PAY", "summary": "issue 1", "status": "Done", "issuetype": "Bug", "assignee": None, "updated": "2024-01-01", "text": markup.issue_text(json.dumps(ISSUES[0]))}
    assert rows[None].project is None and rows[None].status is None
    assert spark.read.format("tracker_issues").load(f"{folder}/none").count() == 0
    assert spark.read.format("tracker_issues").load(f"file://{folder}/issues").where("key = 'PAY-2'").count() == 1


@pytest.mark.parametrize("where", ["project = 'PAY'", "status in ('Open') and updated >= '2024-01-05' and updated < '2024-01-15'", "key is not null and summary like 'issue 1%'", "updated > '2024-01-18' or key = 'PAY-1'", "assignee is null", "length(summary) > 7 and project <= 'PAY'"])
def test_filters(spark, folder, where):
    """Filters that are pushed down leave the rows that Spark would."""
    plain = spark.createDataFrame([tuple(tracker._issue(i, c.split()[0]) for c in tracker.ISSUE.split(", ")) for i in ISSUES], tracker.ISSUE)
    got = spark.read.format("tracker_issues").load(f"{folder}/issues").where(where)
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.where(where).collect()))


def test_filters_reach_the_source(spark, folder, capsys):
    got = spark.read.format("tracker_issues").load(f"{folder}/issues").where("project = 'WEB' and status = 'Open'").select("key")
    got.explain()
    plan = capsys.readouterr().out
    assert "Filter" not in plan.split("BatchScan")[0] and got.count() == 3


def test_columns_that_are_not_wanted_are_not_made(spark, folder):
    (broken := json.loads(json.dumps(PAGES)))[0]["body"] = {"storage": 7}  # its text can't be rendered
    reader = tracker._Reader(folder, spark.createDataFrame([], "page_id string, title string").schema, True)
    assert tracker._page(broken[0], "title") == "page 1"
    with pytest.raises(AttributeError):
        tracker._page(broken[0], "markdown")
    assert reader.columns == ["page_id", "title"]
    two = spark.read.format("tracker_pages").schema("page_id string, title string").load(f"{folder}/pages")
    assert [tuple(r) for r in two.orderBy("page_id").limit(2).collect()] == [("1", "page 1"), ("2", "page 2")]


def test_pages(spark, folder):
    got = spark.read.format("tracker_pages").load(f"{folder}/pages").where("space = 'OPS'").orderBy("page_id").collect()
    assert [tuple(r) for r in got][0] == ("1", "OPS", "page 1", "2024-02-01", "a hit & 1", markup.to_markdown("<h1>T1</h1><p>text</p>")) and len(got) == 4
