import pytest
from pyspark.sql import functions as F

from faultlens.functions.names import last_part, layer_of, node_of

NAMES = {
    # file name: node, layer, layer when only the suffix is removed
    "pool.log.node1": ("node1", "pool.log", "pool.log"),
    "ioscli_global.trace.node4": ("node4", "ioscli_global.trace", "ioscli_global.trace"),
    "cfglog.node2": ("node2", "cfglog", "cfglog"),
    "cfglog": ("cfglog", "cfglog", "cfglog"),
    "a.node1.": ("node1", "a.", "a"),
    "a.node1...": ("node1", "a...", "a"),
    "x.node10.node1": ("node1", "x0", "x.node10"),
    "x.node1.log.node1": ("node1", "x.log", "x.node1.log"),
    "pool.log.n(1": ("n(1", "pool.log", "pool.log"),
}


def test_node(apply):
    assert apply(node_of, NAMES) == [node for node, _, _ in NAMES.values()]


def test_layer(apply):
    assert apply(layer_of, NAMES) == [layer for _, layer, _ in NAMES.values()]


def test_layer_without_suffix(apply):
    found = apply(lambda name: layer_of(name, suffix_only=True), NAMES)
    assert found == [layer for _, _, layer in NAMES.values()]


@pytest.mark.parametrize(
    "text, expected",
    [("a at b at c", " c"), ("a at b at", " b "), ("none", "none"), ("x atat", "x ")],
)
def test_last_part(apply, text, expected):
    assert apply(lambda column: last_part(column, "at"), [text]) == [expected]


def test_null_name_stays_null(apply):
    assert apply(lambda name: F.concat(node_of(name), layer_of(name)), [None]) == [None]
