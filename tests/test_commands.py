"""Commands, small sinks, dates, lineage, landing checks, bundles, exploration on literal rows."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from granary import cli
from granary.operators import audit, dates, exploration, lineage, ml, publish
from granary.schema import COLUMNS, TRANSACTION, ContractError
from granary.sources import landing, storage, tables

DAY = datetime(2011, 3, 1, 10)
HEADER = ",".join(COLUMNS)


def frame(spark, *rows):
    return spark.createDataFrame([(*r[:4], DAY, *r[4:], "UK") for r in rows], TRANSACTION)


def test_markdown_and_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, 1234.5, "a|b\nc", None), (20000, None, "x", True)], "n long, v double, s string, b boolean").orderBy("n")
    assert tables.markdown(df).splitlines() == ["| n | v | s | b |", "| --- | --- | --- | --- |", "| 1 | 1,234.50 | a\\|b c | - |", "| 20,000 | - | x | yes |"]
    assert tables.markdown(df, 1).endswith("The first 1 rows.") and tables.markdown(df.limit(0)).count("\n") == 1
    assert tables.comma_separated(df.select("n", "s")) == 'n,s\n1,"a|b\nc"\n20000,x\n'
    with pytest.raises(ValueError):
        tables.comma_separated(df, 1)
    tables.write_text(spark, f"{tmp_path}/r.md", tables.document([("One", df)], "All"))
    assert (tmp_path / "r.md").read_text().startswith("# All\n\n## One\n\n| n |")
    with pytest.raises(FileExistsError):
        tables.write_text(spark, f"{tmp_path}/r.md", "")


def test_dates():
    at = datetime
    assert dates.business_date("2011-03-01", manual=True) == "2011-03-01" == dates.business_date(None, at(2011, 3, 1), at(2011, 3, 2))
    assert dates.training_cutoff(None, at(2011, 1, 1), at(2011, 2, 1)) == ("2011-02-01", "2011-02-02")
    assert dates.training_cutoff("2011-02-09", manual=True, effective_from="2011-03-01") == ("2011-02-09", "2011-03-01")
    for wrong in (lambda: dates.business_date(manual=True), lambda: dates.business_date(None, at(2011, 3, 1), at(2011, 3, 3)), lambda: dates.business_date(None, at(2011, 3, 1, 1), at(2011, 3, 2, 1)),
                  lambda: dates.business_date("2011-03-05", at(2011, 3, 1), at(2011, 3, 2)), lambda: dates.training_cutoff(None, at(2011, 1, 1), at(2011, 3, 1)), lambda: dates.training_cutoff(None, at(2011, 1, 2), at(2011, 2, 2))):
        with pytest.raises(ValueError):
            wrong()


def test_landing_refuses_changed_files(spark, tmp_path):
    source = tmp_path / "s.csv"
    source.write_text(HEADER + "\n1,P1,x,2,1/2/2011 8:05,1.5,7,UK\n2,P1,x,2,1/3/2011 8:05,1.5,7,UK\n3,P1,x,2,never,1.5,7,UK\n")
    manifest = landing.split(spark, str(source), str(tmp_path / "root"), "v1")
    entry = manifest["partitions"]["2011-01-02"]
    assert entry["bytes"] == sum(f["bytes"] for f in entry["files"].values()) and all(len(f["sha256"]) == 64 for f in entry["files"].values())
    check = lambda **o: landing.validated(spark, str(tmp_path / "root"), "v1", "2011-01-03", **o)
    assert len(check(checksums=True)[1]) == 3
    part = next((tmp_path / "root/landing/v1/date=2011-01-02").glob("part-*"))
    for crc in part.parent.glob(".*.crc"):
        crc.unlink()
    text = part.read_text()
    part.write_text(text.replace("P1", "P2"))
    check()
    with pytest.raises(ContractError, match="changed"):
        check(checksums=True)
    part.write_text(text.replace("Country", "Kountry"))
    with pytest.raises(ContractError, match="header"):
        check()
    part.write_text(text + "\n")
    with pytest.raises(ContractError, match="size"):
        check()


def customers(spark):
    rows = [(f"{c}", r + i, f + i % 2, m + i) for c0, (r, f, m) in enumerate(((1, 20, 5000.0), (300, 1, 10.0))) for i in range(12) for c in (100 * c0 + i,)]
    return spark.createDataFrame(rows, "CustomerID string, Recency int, Frequency int, Monetary double")


def test_student_bundle(spark, tmp_path):
    metrics = customers(spark)
    teacher = ml.fit_kmeans(metrics, 2)
    assert len(list(ml.parameters(teacher))) == 12
    labelled = ml.assign(teacher, metrics, "t").drop("model_version")
    candidate = ml.Candidate(5, 3)
    student = ml.fit_student(labelled, candidate, 2)
    info = ml.bundle_info(student, candidate, 2, publish.training_dates("2011-06-01"))
    files, path = storage.Files(spark, str(tmp_path)), f"{tmp_path}/bundle"
    with pytest.raises(ContractError, match="complete"):
        ml.load_bundle(files, path, "2011-07-01")
    ml.save_bundle(files, path, student, teacher, info)
    loaded, told = ml.load_bundle(files, path, "2011-07-01")
    assert told == info
    same = lambda m: sorted(map(tuple, ml.student_scores(m, metrics, "s").select("CustomerID", "Cluster", "confidence").collect()))
    assert same(loaded) == same(student)
    with pytest.raises(ContractError, match="has seen"):
        ml.load_bundle(files, path, "2011-06-01")
    with pytest.raises(ContractError, match="trees"):
        ml.require_student(student, info | {"candidate": {"trees": 6, "depth": 3}})
    with pytest.raises(ContractError, match="not a student"):
        ml.require_student(teacher, info)
    with pytest.raises(ContractError, match="in order"):
        ml.require_info(info | {"dates": info["dates"] | {"train": "2012-01-01"}})


def test_student_is_chosen_on_new_customers(spark):
    metrics = customers(spark)
    labelled = ml.assign(ml.fit_kmeans(metrics, 2), metrics, "t").drop("model_version").cache()
    train = labelled.where("cast(CustomerID as int) % 100 < 6")
    grid = [ml.Candidate(7, 3), ml.Candidate(3, 3), ml.Candidate(3, 2)]
    model, report = ml.select_student(train, labelled.where("cast(CustomerID as int) % 100 < 9"), labelled, 2, grid)
    assert report["candidate"] == {"trees": 3, "depth": 2} and report["validation"]["new"] == {"macro_f1": 1.0, "accuracy": 1.0, "rows": 6}
    assert report["test"]["all"]["rows"] == 24 and report["test"]["seen"]["rows"] == 18
    with pytest.raises(ContractError, match="new customers"):
        ml.select_student(labelled, train, labelled, 2, grid)
    with pytest.raises(ContractError, match="below"):
        ml.select_student(train, labelled.withColumn("Cluster", 1 - F.col("Cluster")), labelled, 2, grid[:1])


def test_candidates_and_cohorts(spark):
    usual = [(f"{i}", "P1", "d", 1 + i % 3, 1.0, "a") for i in range(30)]
    odd = [("40", "P1", "d", 90, 1.0, None), ("C41", "P1", "d", 1, 1.0, "a"), ("42", "P1", "d", -1, 0.0, "a"), ("42", "P1", "d", 1, 2.0, "b"), ("43", "P1", "d", 1, 0.0, None), ("44", "Q1", "d", 99, 1.0, "a"), (None, "P1", "d", 1, -1.0, "a")]
    rows = audit.classified(frame(spark, *usual, *odd))
    flagged = {r.InvoiceNo: sorted(c.rule for c in r.candidates if c.flagged) for r in exploration.candidate_flags(rows).collect() if r.InvoiceNo != "42"}
    assert flagged["40"] == ["Quantity_iqr_1.5", "Quantity_iqr_3", "line_value_iqr_1.5", "line_value_iqr_3"] and flagged["C41"] == ["cancel_not_negative"] and flagged["43"] == ["all_zero_invoice"]
    assert flagged["44"] == [] and flagged[None] == ["negative_price"] and flagged["1"] == []
    rates = {(r.rule, r.cohort): r for r in exploration.candidate_rates(rows).collect()}
    assert rates["several_customers", "with_id"].flagged == 2 and rates["zero_in_paid_invoice", "with_id"].flagged == 1 and rates["negative_without_cancel", "with_id"].flagged == 1
    assert rates["several_customers", "without_id"].pct_of_eligible == 0
    found = {r.cohort: r for r in exploration.cohort_profile(rows).collect()}
    assert found["without_id"].lines == 2 and found["without_id"].zero_price_pct == 50 and float(found["without_id"].positive_value) == 90.0
    quantiles = {(r.cohort, r.measure): r for r in exploration.cohort_quantiles(rows, (0.5, 0.75)).collect()}
    assert quantiles["without_id", "Quantity"].q500 == 45.5 and quantiles["without_id", "Quantity"].q750 == 67.75
    empty = rows.limit(0)
    assert exploration.candidate_rates(empty).count() == 0 and exploration.cohort_quantiles(empty).count() == 0


def test_one_to_one(spark):
    a = spark.createDataFrame([(1, None, "x"), (2, "k", "y"), (2, "k", "z"), (3, "m", None)], "i int, k string, v string")
    assert sorted(r.i for r in exploration.unique_rows(a, ["i", "k"]).collect()) == [1, 3]
    b = spark.createDataFrame([(1, None, "q"), (3, "m", "w"), (4, "n", "e")], "i int, k string, v string")
    with pytest.raises(ContractError):
        exploration.one_to_one(a, b, ["i", "k"])
    found = {r.i: (r.a.v, r.b.v) for r in exploration.one_to_one(exploration.unique_rows(a, ["i", "k"]), b, ["i", "k"]).collect()}
    assert found == {1: ("x", "q"), 3: (None, "w")}


def test_commands(spark, tmp_path, capsys):
    def run(*argv):
        assert cli.main([str(x) for x in argv], spark) == 0
        return json.loads(capsys.readouterr().out.splitlines()[-1])

    lines = [f"{100 + c}{i},P{i % 4},MUG,{1 + i % 5 + 40 * (c % 2)},{1 + i}/2/2011 8:05,{1 + c}.5,{c},UK" for c in range(8) for i in range(3)]
    source = tmp_path / "s.csv"
    source.write_text("\n".join([HEADER, *lines, lines[0], "C9,P1,MUG,-1,3/2/2011 8:05,1.5,1,UK"]) + "\n")
    at = lambda n: tmp_path / n
    assert run("clean", source, at("clean"), "--audit-output", at("distinct")) == {"rows": 24}
    assert run("train", at("clean"), at("model"), "--run-date", "2011-04-01", "--k", 2)["k"] == 2
    assert run("metrics", at("clean"), at("metrics"), "--run-date", "2011-04-01", "--model", at("model")) == {"customers": 8}
    run("choose-k", at("clean"), at("k.csv"), "--run-date", "2011-04-01", "--k-max", 3)
    assert at("k.csv").read_text().startswith("k,wssse,silhouette\n2,")
    assert run("audit", at("distinct"), at("audit"), "--run-date", "2011-04-01")["rows"] == 25
    run("report", at("audit"), at("report.md"))
    assert "## Flagged lines by rule" in at("report.md").read_text()
    assert run("orders", at("distinct"), at("orders"), "--run-date", "2011-04-01")["orders"] == 25
    assert run("ingest", at("clean"), at("store"), "b1", "--run-date", "2011-04-01", "--initialize", "--buckets", 2)["version"] == "000000000001"
    with pytest.raises(ValueError):
        run("clean", at("clean"), at("clean") / "inside")
    assert run("land", source, at("root"), "v1")["last_date"] == "2011-03-02"
    day = ("run", at("root"), "v1")
    run(*day, "train", "--business-date", "2011-03-01", "--run-id", "t1", "--k", 2, "--model-version", "m1", "--effective-from", "2011-03-02")
    done = run(*day, "all", "--business-date", "2011-03-02", "--run-id", "d1", "--lineage")
    assert run(*day, "all", "--business-date", "2011-03-02", "--run-id", "d1", "--lineage") == done
    space = publish.Workspace(spark, str(at("root")))
    events = lineage.completed(space, space.load_context(done["run_key"]))
    assert [e["job"]["name"] for e in events] == ["granary.etl", "granary.rfm", "granary.audit"] and events[1]["inputs"][0]["facets"]["schema"]["fields"]
    assert len(list(at("root").glob("lineage/*.json"))) == 3
    with pytest.raises(ValueError):
        lineage.event("DONE", "x", "etl", "n", [], [])
