import os
import sys

import pytest

from faultlens import __main__ as command_line
from faultlens import analyze_conf, analyze_directories
from faultlens.model import CFGLOG, IOSCLI, LAYERS, POOL, SYSLOG, VIOCMD
from faultlens.plans.registry import QUERIES
from faultlens.runtime import Scratch, pin, pinned, release, shared_dir, written_once
from faultlens.sources import logs as log_sources
from faultlens.sources import sinks
from faultlens.sources.logs import list_logs, log_catalog, number_lines, open_logs, read_dir_list, scan_log_lines
from pyspark.sql import functions as F

AS_OF = "2020-01-01 00:00:00"
START = "Command pv  Started at >>>>>> Oct  10 2015, Sat, 03:11:12"
END = "Command pv Ended at >>>>>> Oct  10 2015, Sat, 03:15:00"


def write(root, logs, line_end="\n"):
    for path, lines in logs.items():
        file = root / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes("".join(line + line_end for line in lines).encode())


def node_logs(n):
    return {
        f"node{n}/ioscli_global.trace.node{n}": [START, "call rc = 22", "call rc = 0", END, "rc = 22"],
        f"node{n}/pool.log.node{n}": ["p:1444446700: op rc=1 done", "p:1444446700: op rc=0 done"],
        f"node{n}/vioCmd.log.node{n}": ["Oct 10 2015, 03:12:00 vio rc 22"] * n,
        f"node{n}/syslog.caa.node{n}": ["Oct 10 03:12:30 host caa:err x", "Oct 11 03:12:30 caa:err"],
        f"node{n}/cfglog.node{n}": ["cfg Error"] * (n - 1),
        f"node{n}/other.log.node{n}": ["Error"],
    }


def expected(n):
    return {IOSCLI: 1, POOL: 1, VIOCMD: n, SYSLOG: 1, CFGLOG: n - 1}


@pytest.fixture
def four_nodes(tmp_path):
    for n in range(1, 5):
        write(tmp_path, node_logs(n))
    return [str(tmp_path / f"node{n}") for n in range(1, 5)]


def matrix(report):
    return {(row.node, row.layer): row.errors for row in report.matrix().collect()}


def test_full_run(spark, four_nodes):
    report = analyze_directories(spark, four_nodes, as_of=AS_OF).persist()
    # node1 has an empty configuration log, which reports 0
    assert matrix(report) == {
        (f"node{n}", layer): count for n in range(1, 5) for layer, count in expected(n).items()
    }
    vertical = report.by_node("node3").collect()
    assert {row.layer: row.errors for row in vertical} == expected(3)
    horizontal = report.by_layer(VIOCMD).collect()
    assert {row.node: row.errors for row in horizontal} == {f"node{n}": n for n in range(1, 5)}
    assert report.by_node("node9").count() == 0
    lines = {row.report_line for row in report.counts().filter("heading = 'NODE2'").collect()}
    assert lines == {f"{layer}-->{count}" for layer, count in expected(2).items()}
    details = report.details().filter("node = 'node1' and layer = 'pool.log'").collect()
    assert [(row.heading, row.line) for row in details] == [
        ("NODE1", "p:1444446700: op rc=1 done")
    ]
    assert {row.source_dir.rsplit("/", 1)[1] for row in report.bounds.collect()} == {
        "node1", "node2", "node3", "node4"
    }
    report.unpersist()


def test_conf_file(spark, four_nodes, tmp_path):
    conf = tmp_path / "conf.txt"
    conf.write_text("\n".join(four_nodes[:2]) + "\n\n")
    assert [row.source_dir for row in read_dir_list(spark, str(conf)).collect()] == four_nodes[:2]
    found = matrix(analyze_conf(spark, str(conf), as_of=AS_OF))
    assert {node for node, _ in found} == {"node1", "node2"}


def test_carriage_returns(spark, tmp_path):
    write(tmp_path, node_logs(2), line_end="\r\n")
    report = analyze_directories(spark, [str(tmp_path / "node2")], as_of=AS_OF)
    assert matrix(report) == {("node2", layer): n for layer, n in expected(2).items()}
    assert report.errors.filter("line like '%\\r%'").count() == 0


def test_missing_end_marker_and_missing_trace(spark, tmp_path):
    logs = node_logs(2)
    logs["node2/ioscli_global.trace.node2"] = [START, "rc = 22", "rc = 33"]
    logs |= {k: v for k, v in node_logs(3).items() if "ioscli" not in k}
    write(tmp_path, logs)
    dirs = [str(tmp_path / "node2"), str(tmp_path / "node3")]
    found = matrix(analyze_directories(spark, dirs, as_of=AS_OF))
    # the span of node2 lasts until 2020, the syslog is compared in 1970: Oct 10 to Jan 1
    assert {layer: n for (node, layer), n in found.items() if node == "node2"} == {
        IOSCLI: 2, POOL: 1, VIOCMD: 2, SYSLOG: 0, CFGLOG: 1,
    }
    assert {layer: n for (node, layer), n in found.items() if node == "node3"} == {
        POOL: 0, VIOCMD: 0, SYSLOG: 0, CFGLOG: 2,
    }


def test_empty_trace_listed_last_wins(spark, tmp_path):
    write(tmp_path, node_logs(2) | {"node2/zz_ioscli.node2": []})
    found = matrix(analyze_directories(spark, [str(tmp_path / "node2")], as_of=AS_OF))
    assert found[("node2", POOL)] == 0
    assert found[("node2", IOSCLI)] == 1


def test_same_log_in_two_directories(spark, tmp_path):
    write(tmp_path, {"a/cfglog.n": ["Error"], "b/cfglog.n": ["Error"] * 2})
    dirs = [str(tmp_path / "a"), str(tmp_path / "b")]
    assert matrix(analyze_directories(spark, dirs)) == {("n", CFGLOG): 3}
    last = analyze_directories(spark, dirs, on_duplicate="last")
    assert matrix(last) == {("n", CFGLOG): 2}
    with pytest.raises(ValueError):
        analyze_directories(spark, dirs, on_duplicate="first")


def test_catalogue(spark, tmp_path):
    write(
        tmp_path,
        {
            "a b/pool.log.n+1": ["xyz"],
            "a b/cfglog.n+1": [],
            "a b/syslog.caa.n%41": ["1", "2"],
            "a b/plain": ["x"],
        },
    )
    rows = log_catalog(spark, [str(tmp_path / "a b")]).collect()
    assert {row.file_name: (row.node, row.layer, row.size) for row in rows} == {
        "pool.log.n+1": ("n+1", POOL, 4),
        "cfglog.n+1": ("n+1", CFGLOG, 0),
        "syslog.caa.n%41": ("n%41", SYSLOG, 4),
        "plain": ("plain", "plain", 2),
    }
    assert {row.source_dir for row in rows} == {f"file:{tmp_path}/a b"}
    assert {row.path for row in rows} == {f"file:{tmp_path}/a b/{row.file_name}" for row in rows}


def test_scan_gives_lines_in_order(spark, tmp_path):
    write(tmp_path, {"d/pool.log.n1": [f"line {n}" for n in range(500)], "d/x.n1": ["other"]})
    lines = scan_log_lines(open_logs(spark, [str(tmp_path / "d")]), [POOL])
    rows = lines.orderBy("block_start", "row_id").collect()
    assert [row.line for row in rows] == [f"line {n}" for n in range(500)]
    assert {(row.node, row.layer, row.part) for row in rows} == {("n1", POOL, "")}


def test_logs_in_parts(spark, tmp_path, log_table):
    logs = {f"s{n}/{layer}.node{n}": [f"{layer} {i}" for i in range(20)] for n in (1, 2) for layer in LAYERS}
    root = str(tmp_path / "logs")
    sinks.write_log_dirs(log_table(logs).repartition(3), root)
    dirs = [f"{root}/source_dir=s{n}" for n in (1, 2)]
    lines = scan_log_lines(open_logs(spark, dirs))
    found = {}
    for row in lines.collect():
        found.setdefault((row.node, row.layer, row.file_name), []).append(row.line)
    wanted = {}
    for path, texts in logs.items():
        name = path.split("/")[1]
        wanted[(name[-5:], name[:-6], name)] = sorted(texts)
    assert {key: sorted(texts) for key, texts in found.items()} == wanted
    assert log_catalog(spark, [root]).count() == 0
    assert log_catalog(spark, [root], nested=True).count() == len(logs)
    catalog = log_catalog(spark, dirs).collect()
    assert len(catalog) == len(logs)
    assert sum(row.size for row in catalog) == sum(len(t) + 1 for texts in logs.values() for t in texts)


def test_parts_count_by_number(spark, tmp_path):
    log = "d/ioscli_global.trace.n1"
    write(tmp_path, {f"{log}/part-99999": [START], f"{log}/part-100000": ["call rc = 22"],
                     f"{log}/part-00002": ["call rc = 33"]})
    report = analyze_directories(spark, [str(tmp_path / "d")], as_of=AS_OF)
    assert [row.line for row in report.errors.collect()] == ["call rc = 22"]


def test_only_the_first_level_counts(spark, tmp_path):
    write(tmp_path, {"node1/cfglog.node1": ["Error"], "node1/old/cfglog.node1": ["Error"] * 2})
    dirs = [str(tmp_path / "node1")]
    assert matrix(analyze_directories(spark, dirs, as_of=AS_OF)) == {("node1", CFGLOG): 1}
    assert matrix(analyze_directories(spark, dirs, as_of=AS_OF, nested=True)) == {("node1", CFGLOG): 3}


def test_last_processed_wins_before_logs_are_opened(spark, tmp_path):
    write(tmp_path, {"a/cfglog.n": ["Error"] * 2, "b/x": []})
    # a log that cannot be read: it must not be opened
    (tmp_path / "b" / "cfglog.n").mkdir()
    (tmp_path / "b" / "cfglog.n" / "part-0.gz").write_bytes(b"not compressed at all")
    conf = tmp_path / "conf.txt"
    conf.write_text(f"{tmp_path}/b\n{tmp_path}/a\n")
    report = analyze_conf(spark, str(conf), as_of=AS_OF, on_duplicate="last")
    assert matrix(report) == {("n", CFGLOG): 2}
    assert [row.source_dir.rsplit("/", 1)[1] for row in report.catalog.collect()] == ["a"]


def test_last_wins_in_the_order_of_the_list(spark, tmp_path):
    write(tmp_path, {f"{d}/{name}": lines for d in "abc" for name, lines in {
        "cfglog.n": [f"Error {d}"], "ioscli_global.trace.n": [START, f"rc = 22 {d}", END]}.items()})
    write(tmp_path, {"b/cfglog.m": ["Error b"], "c/cfglog.m": ["Error c", "Error c"]})
    dirs = [str(tmp_path / d) for d in "cba"]
    report = analyze_directories(spark, dirs, as_of=AS_OF, on_duplicate="last")
    found = sorted((row.node, row.layer, row.line) for row in report.errors.collect())
    assert found == [("m", CFGLOG, "Error b"), ("n", CFGLOG, "Error a"), ("n", IOSCLI, "rc = 22 a")]
    assert matrix(report) == {("m", CFGLOG): 1, ("n", CFGLOG): 1, ("n", IOSCLI): 1}
    # the bounds are still those of every directory
    assert report.bounds.count() == 3
    plan = report.matrix()._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_overlapping_directories_give_each_log_once(spark, tmp_path):
    write(tmp_path, {"a/cfglog.n": ["Error a"], "a/b/cfglog.n": ["Error b"] * 2, "a/b/c/cfglog.n": ["Error c"] * 4})
    dirs = [str(tmp_path / "a"), str(tmp_path / "a/b"), str(tmp_path / "a")]
    listed = list_logs(spark, dirs, nested=True).collect()
    # a log belongs to the listed directory that is nearest
    assert {(row.path.removeprefix(f"file:{tmp_path}"), row.dir_index) for row in listed} == {
        ("/a/b/c/cfglog.n", 1), ("/a/b/cfglog.n", 1), ("/a/cfglog.n", 0)}
    assert matrix(analyze_directories(spark, dirs, as_of=AS_OF, nested=True)) == {("n", CFGLOG): 7}
    last = analyze_directories(spark, dirs, as_of=AS_OF, nested=True, on_duplicate="last")
    # in one directory, the last by path
    assert {row.line for row in last.errors.collect()} == {"Error b"}


def test_two_levels_are_listed_and_no_more(spark, tmp_path, monkeypatch):
    write(tmp_path, {"n/cfglog.n": ["Error"], "n/old/cfglog.n": ["Error"], "n/old/older/cfglog.n": ["Error"],
                     "n/pool.log.n/part-0": ["x"], "n/pool.log.n/_SUCCESS": [], "n/.hidden": ["x"]})
    listed = []
    children = log_sources._children
    monkeypatch.setattr(log_sources, "_children", lambda spark, path: listed.append(path) or children(spark, path))
    found = log_catalog(spark, [str(tmp_path / "n")])
    assert sorted((row.file_name, row.size) for row in found.collect()) == [("cfglog.n", 6), ("pool.log.n", 2)]
    assert sorted(path.removeprefix(f"file:{tmp_path}") for path in listed) == ["/n", "/n/old", "/n/pool.log.n"]
    # names and sizes are known from the listing alone
    assert "Scan" not in found._jdf.queryExecution().executedPlan().toString().replace("LocalTableScan", "")


def test_names_that_look_like_patterns(spark, tmp_path):
    write(tmp_path, {"d [1]/cfglog.n*": ["Error"], "d [1]/cfglog.nx": ["Error"] * 2, "d [1]/cfglog.{a,b}": ["Error"]})
    found = matrix(analyze_directories(spark, [str(tmp_path / "d [1]")], as_of=AS_OF))
    assert found == {("n*", CFGLOG): 1, ("nx", CFGLOG): 2, ("{a,b}", CFGLOG): 1}


def test_many_logs_are_chosen_without_literals(spark, monkeypatch):
    """100,000 pairs in two directories each: the choice is made in seconds, and only paths go to the reader."""
    pairs = 100_000
    rows = [(f"file:/{d}/cfglog.node{n}", False, 1) for d in "ab" for n in range(pairs)]
    monkeypatch.setattr(log_sources, "_children", lambda spark, path: [r for r in rows if r[0].startswith(f"file:{path[5:]}/")])
    found = list_logs(spark, ["/b", "/a"])
    from faultlens.operators.views import latest_logs

    kept = found.join(latest_logs(found).select("path"), "path", "left_semi").select("path").collect()
    assert len(kept) == pairs and all(row.path.startswith("file:/a/") for row in kept)


def test_line_numbers_do_not_depend_on_splits(spark, tmp_path):
    lines = [f"line {n} " + "x" * (n % 40) for n in range(3000)]
    write(tmp_path, {"d/pool.log.n1": lines, "d/pool.log.n2/part-0": lines[:70], "d/pool.log.n2/part-1": lines[70:90]})
    wanted = {("n1", n + 1, line) for n, line in enumerate(lines)} | {("n2", n + 1, line) for n, line in enumerate(lines[:90])}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("4096", "10000", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            numbered = number_lines(scan_log_lines(open_logs(spark, [str(tmp_path / "d")])))
            assert {(row.node, row.line_number, row.line) for row in numbered.collect()} == wanted
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_reports_are_closed_in_any_order(spark, four_nodes):
    release(spark)
    shared = shared_dir(spark)
    before = set(os.listdir(shared))
    for order in ((0, 1), (1, 0)):
        reports = [analyze_directories(spark, four_nodes, as_of=AS_OF) for _ in range(2)]
        reports[order[0]].close()
        assert matrix(reports[order[1]])[("node3", VIOCMD)] == 3
        reports[order[1]].close()
        reports[order[1]].close()
        assert set(os.listdir(shared)) == before
    with analyze_directories(spark, four_nodes, as_of=AS_OF) as report:
        report.share().close()
        assert matrix(report)[("node2", IOSCLI)] == 1
    assert set(os.listdir(shared)) == before


def test_sessions_and_failed_runs_leave_others_alone(spark, four_nodes, tmp_path):
    release(spark)
    shared = shared_dir(spark)
    before = set(os.listdir(shared))
    report = analyze_directories(spark, four_nodes, as_of=AS_OF)
    other = spark.newSession()
    kept = pin(other.range(3))
    made = set(os.listdir(shared))
    with pytest.raises(Exception):
        with Scratch(spark).collecting():
            pin(spark.range(2))
            raise ValueError("later")
    with pytest.raises(Exception):
        with Scratch(spark).collecting():
            pin(spark.range(1).select(F.raise_error(F.lit("no"))))
    assert set(os.listdir(shared)) == made
    release(other)
    assert matrix(report)[("node1", POOL)] == 1
    report.close()
    assert set(os.listdir(shared)) == before and kept.columns == ["id"]


def test_inputs_are_written_once_until_released(spark):
    release(spark)
    calls = []

    def write():
        calls.append(pin(spark.range(5)))
        return calls[-1]

    assert written_once(spark, "five", write).count() == written_once(spark, "five", write).count() == 5
    assert len(calls) == 1 and pinned(spark) == 1
    release(spark)
    assert written_once(spark, "five", write).count() == 5 and len(calls) == 2
    release(spark)


@pytest.mark.parametrize("name", ["full_run", "full_run_persisted", "log_catalog", "error_details_written", "last_wins_files"])
def test_queries_leave_nothing_behind(spark, name):
    release(spark)
    before = set(os.listdir(shared_dir(spark)))
    QUERIES[name](spark, "/root/testdata/sf0.001").count()
    release(spark)
    assert set(os.listdir(shared_dir(spark))) == before


def test_order_of_partitions_does_not_matter(spark, tmp_path, log_table):
    lines = [START, "rc = 22", END, "rc = 33"] * 30
    table = log_table({"d/ioscli_global.trace.n1": lines})
    for name, rows in (("one", table.coalesce(1)), ("many", table.repartition(8))):
        sinks.write_log_dirs(rows, str(tmp_path / name))
        report = analyze_directories(spark, [str(tmp_path / name / "source_dir=d")], as_of=AS_OF)
        assert [row.line for row in report.errors.collect()] == ["rc = 22"] * 30


def test_close_leaves_the_shared_folder_as_it_was(spark, four_nodes):
    shared = shared_dir(spark)
    before = set(os.listdir(shared))
    report = analyze_directories(spark, four_nodes, as_of=AS_OF).persist()
    assert report.matrix().count() == 20
    made = set(os.listdir(shared)) - before
    assert made
    # one file of rows, however many logs were read
    assert all(len([f for f in os.listdir(f"{shared}/{d}") if f.startswith("part-")]) <= 4 for d in made)
    report.close()
    assert set(os.listdir(shared)) == before


def test_directory_child_in_parts(spark, tmp_path):
    write(tmp_path, {"d/cfglog.n1/part-0": ["Error a"], "d/cfglog.n1/part-1": ["ok", "Error b"]})
    report = analyze_directories(spark, [str(tmp_path / "d")])
    assert matrix(report) == {("n1", CFGLOG): 2}
    assert {row.path for row in report.errors.collect()} == {f"file:{tmp_path}/d/cfglog.n1"}


def test_sinks(spark, four_nodes, tmp_path):
    report = analyze_directories(spark, four_nodes, as_of=AS_OF)
    report.write(str(tmp_path / "out"))
    counts = spark.read.text(str(tmp_path / "out/counts"))
    values = {row.value for row in counts.filter("view = 'vertical' and heading = 'NODE4'").collect()}
    assert values == {f"{layer}-->{n}" for layer, n in expected(4).items()}
    details = spark.read.parquet(str(tmp_path / "out/details"))
    assert details.groupBy("node").count().count() == 4
    assert details.count() == sum(sum(expected(n).values()) for n in range(1, 5))
    for kind in ("text", "json"):
        sinks.write_error_details(report.errors, str(tmp_path / kind), kind)
        assert spark.read.format(kind).load(str(tmp_path / kind)).count() == details.count()


def test_command_line(spark, four_nodes, tmp_path, monkeypatch):
    conf = tmp_path / "conf.txt"
    conf.write_text("\n".join(four_nodes))
    out = tmp_path / "result"
    arguments = ["faultlens", str(conf), str(out), "--as-of", AS_OF, "--details-format", "text"]
    monkeypatch.setattr(sys, "argv", arguments)
    command_line.main()
    assert {"view=vertical", "view=horizontal"} <= set(os.listdir(out / "counts"))
    lines = spark.read.text(str(out / "details"))
    assert lines.count() == sum(sum(expected(n).values()) for n in range(1, 5))
