"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from faultlens import analyze_directories
from faultlens.model import CFGLOG, IOSCLI, POOL
from faultlens.functions.rules import error_rules
from faultlens.operators.brackets import within_command
from faultlens.operators.views import error_matrix
from faultlens.plans.registry import QUERIES
from faultlens.plans.layers import analyze_layer, dispatch_errors
from faultlens.runtime import pinned
from faultlens.sources.logs import open_logs, scan_log_lines
from faultlens.sources.tables import event_log_lines

SF_DIR = "/root/testdata/sf0.001"
AS_OF = "2024-02-01 00:00:00"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", QUERIES)
def test_no_python_and_no_cross_join(spark, name):
    text = plan(driver.queries()[name](spark, SF_DIR))
    assert not re.search(r"Python|Arrow|Cartesian|NestedLoop", text)
    # of the events, only what the lines are made from
    assert "props" not in text


def test_lines_are_shuffled_by_chunk(spark):
    lines = event_log_lines(spark, SF_DIR).filter(F.col("layer") == IOSCLI)
    text = plan(within_command(lines))
    by_chunk = r"Exchange hashpartitioning\(path#\d+, part#\d+, block_start#\d+L, _chunk#\d+L"
    assert re.search(by_chunk, text)
    # what goes to one task per log is a row per part and wide piece, aggregated before
    by_log = re.findall(r"Exchange hashpartitioning\(path#\d+, \d+\).*\n(.*)", text)
    assert by_log and all("Aggregate" in one for one in by_log)


def test_one_layer_runs_no_brackets(spark):
    for name in ("errors_for_layer", "errors_by_layer"):
        assert "Window" not in plan(QUERIES[name](spark, SF_DIR))


def test_table_is_read_once_for_hits(spark):
    before = pinned(spark)
    errors = dispatch_errors(event_log_lines(spark, SF_DIR), bounds=("2024-01-05", "2024-01-20"))
    assert pinned(spark) == before + 1
    # all that is left reads the written hits
    assert "events.parquet" not in plan(errors)


def test_a_timed_layer_without_bounds_reads_the_table_once(spark):
    before = pinned(spark)
    errors = analyze_layer(event_log_lines(spark, SF_DIR, True), POOL, as_of=AS_OF)
    assert pinned(spark) == before + 1
    assert "events.parquet" not in plan(errors)
    table = event_log_lines(spark, SF_DIR, True)
    whole = dispatch_errors(table, as_of=AS_OF).filter(F.col("layer") == POOL)
    assert sorted(errors.collect()) == sorted(whole.collect())


def test_joins_carry_no_forced_hints(spark):
    errors = dispatch_errors(event_log_lines(spark, SF_DIR), as_of=AS_OF)
    text = errors._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=" not in text
    assert "Join LeftOuter" in text


def test_counting_starts_before_the_shuffle(spark):
    text = plan(error_matrix(dispatch_errors(event_log_lines(spark, SF_DIR), as_of=AS_OF)))
    assert "partial_count(1)" in text


def test_rules_run_in_generated_code_at_the_scan(spark, tmp_path):
    (tmp_path / "pool.log.n1").write_text("x\n")
    rule = error_rules(F.col("line"))[POOL]
    scan = scan_log_lines(open_logs(spark, [str(tmp_path)]), [POOL], where=rule)
    assert "StringContains(value,rc=)" in plan(scan)
    formatted = scan._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert re.search(r"\* Filter", formatted)
    # the line is tested before the name of its file
    condition = re.search(r"Condition : (.*)", formatted).group(1)
    assert condition.index("RLIKE") < condition.index("file_path")


def test_logs_of_unknown_layers_are_not_opened(spark, tmp_path):
    (tmp_path / "cfglog.n1").write_text("Error\n")
    (tmp_path / "other.gz").write_bytes(b"not compressed at all")
    with pytest.raises(Exception):
        open_logs(spark, [str(tmp_path)]).count()
    errors = analyze_directories(spark, [str(tmp_path)]).errors
    # a scan is handed its own logs, and tells them by no list of literals
    assert "path IN" not in plan(errors)
    assert [row.layer for row in errors.collect()] == [CFGLOG]
