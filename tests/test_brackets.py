import random

import pytest
from pyspark.sql import functions as F

from faultlens.functions.rules import ioscli_error
from faultlens.operators.brackets import within_command
from faultlens.runtime import pin
from faultlens.sources.logs import open_logs, scan_log_lines
from faultlens.sources.tables import event_log_lines

START = "Command pv  Started at >>>>>> x"
END = "Command pv Ended at >>>>>> x"


def expected(lines):
    inside, kept = False, []
    for n, line in enumerate(lines):
        if "Command pv  Started at " in line:
            inside = True
        elif "Command pv Ended at " in line:
            inside = False
        elif inside:
            kept.append(n)
    return kept


def kept_rows(found):
    rows = {}
    for row in found.select("path", "row_id").collect():
        rows.setdefault(row.path, []).append(row.row_id)
    return {path: sorted(ids) for path, ids in rows.items()}


def random_lines(seed):
    rng = random.Random(seed)
    share = rng.choice([0.0, 0.01, 0.1, 0.5])
    return [
        rng.choice([START, END, START + END]) if rng.random() < share else f"rc = {n}"
        for n in range(rng.randint(0, 120))
    ]


@pytest.mark.parametrize("chunk_bits", [0, 1, 3, 16])
def test_random_brackets(log_table, chunk_bits):
    logs = {f"d/ioscli_global.trace.n{seed}": random_lines(seed) for seed in range(60)}
    found = kept_rows(within_command(log_table(logs), chunk_bits=chunk_bits))
    wanted = {path: expected(lines) for path, lines in logs.items()}
    assert found == {path: kept for path, kept in wanted.items() if kept}


def test_prefilter_keeps_the_same_lines(log_table):
    logs = {f"d/ioscli_global.trace.n{seed}": random_lines(seed) for seed in range(30)}
    lines = log_table(logs)
    rule = ioscli_error(F.col("line"))
    before = kept_rows(within_command(lines, where=rule, chunk_bits=2))
    assert before == kept_rows(within_command(lines, chunk_bits=2).filter(rule))


def test_state_does_not_leak_into_the_next_log(log_table):
    lines = log_table({"d/t.n1": ["a", START, "b"], "d/t.n2": ["c", END, "d"]})
    assert kept_rows(within_command(lines)) == {"d/t.n1": [2]}


def test_other_commands_do_not_count(log_table):
    lines = log_table({"d/t.n1": [START.replace("pv", "lv"), "a"]})
    assert within_command(lines).count() == 0
    assert within_command(lines, "lv").count() == 1


def test_blocks_and_parts_are_levels_of_one_order(spark):
    """The same lines as one block, and dealt over parts and far-apart blocks."""
    lines = [line for seed in range(40) for line in random_lines(seed)]
    rows = []
    for n, line in enumerate(lines):
        part, block = f"part {n // 700}", (n % 700 // 90) << 36
        rows.append(("d", "d/t.n1", "t.n1", "n1", "t", part, block, n, line))
    schema = "source_dir string, path string, file_name string, node string, layer string, part string, block_start bigint, row_id bigint, line string"
    table = spark.createDataFrame(rows, schema).repartition(5)
    assert kept_rows(within_command(table, chunk_bits=2)) == {"d/t.n1": expected(lines)}


def test_a_log_of_a_million_chunks(spark):
    number = F.col("id")
    marker = F.when(F.xxhash64(number) % 5000 == 0, START).when(F.xxhash64(number) % 3000 == 1, END)
    table = spark.range(1 << 20).select(
        *(F.lit("t").alias(name) for name in ("source_dir", "path", "file_name", "node", "layer")),
        F.lit("").alias("part"), F.lit(0).cast("bigint").alias("block_start"), number.alias("row_id"),
        F.coalesce(marker, F.lit("rc = 22")).alias("line"))
    markers = table.filter("line <> 'rc = 22'").orderBy("row_id").select("row_id", F.col("line").startswith("Command pv  S")).collect()
    wanted, opened = 0, None
    for row_id, starts in [*markers, (1 << 20, False)]:
        if opened is not None:
            wanted += row_id - opened - 1
        opened = row_id if starts else None
    found = within_command(table, chunk_bits=0)
    assert found.count() == wanted > 0


@pytest.mark.parametrize("chunk_bits", [4, 16])
def test_event_table(spark, chunk_bits):
    lines = event_log_lines(spark, "/root/testdata/sf0.001").filter(
        F.col("layer") == "ioscli_global.trace"
    )
    wanted = {}
    inside = {}
    for row in lines.orderBy("row_id").select("path", "row_id", "line").collect():
        if "Started" in row.line:
            inside[row.path] = True
        elif "Ended" in row.line:
            inside[row.path] = False
        elif inside.get(row.path):
            wanted.setdefault(row.path, []).append(row.row_id)
    assert kept_rows(within_command(lines, chunk_bits=chunk_bits)) == wanted


@pytest.mark.parametrize("chunk_bits", [2, 16])
def test_files_over_many_splits(spark, tmp_path, chunk_bits):
    logs = {}
    for n in range(3):
        lines = [f"{line} #{i}" for seed in range(20) for i, line in enumerate(random_lines(seed + n))]
        logs[f"ioscli_global.trace.n{n}"] = lines
        (tmp_path / f"ioscli_global.trace.n{n}").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = pin(scan_log_lines(open_logs(spark, [str(tmp_path)])))
        assert lines.select("block_start").distinct().count() > 5
        found = within_command(lines, chunk_bits=chunk_bits)
        rows = found.select("file_name", "line").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for name, texts in logs.items():
        wanted = sorted(texts[n] for n in expected(texts))
        assert sorted(row.line for row in rows if row.file_name == name) == wanted
