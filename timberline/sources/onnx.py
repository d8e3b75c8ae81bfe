"""Models as ONNX files (ai.onnx.ml TreeEnsembleRegressor), written without a library: the few protocol buffer fields that
such a model needs. Numbers are single precision there; thresholds are rounded down, so that values that are exact in
single precision take the same way."""

from __future__ import annotations

import struct

import numpy as np

from ..operators.boost import Model

#: Wire types of protocol buffers, ONNX attribute types and the float element type (fixed values).
VARINT, BYTES, FIXED32 = 0, 2, 5
FLOATS, INTS, STRINGS, INT, STRING = 6, 7, 8, 2, 3
FLOAT = 1


def varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def field(number: int, value) -> bytes:
    """One field: integers as varints, text and bytes with their length."""
    if isinstance(value, int):
        return varint(number << 3 | VARINT) + varint(value)
    data = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | BYTES) + varint(len(data)) + data


def attribute(name: str, value) -> bytes:
    """A node's attribute, by the type of its value."""
    head = field(1, name)
    if isinstance(value, int):
        body = field(3, value) + field(20, INT)
    elif isinstance(value, str):
        body = field(4, value) + field(20, STRING)
    elif value and isinstance(value[0], str):
        body = b"".join(field(9, v) for v in value) + field(20, STRINGS)
    elif value and isinstance(value[0], float):
        body = b"".join(varint(7 << 3 | FIXED32) + struct.pack("<f", v) for v in value) + field(20, FLOATS)
    else:
        body = b"".join(field(8, int(v)) for v in value) + field(20, INTS)
    return field(5, head + body)


def tensor(name: str, width: int) -> bytes:
    """A float matrix with any number of rows."""
    shape = field(1, field(2, "N")) + field(1, field(1, width))
    return field(1, name) + field(2, field(1, field(1, FLOAT) + field(2, shape)))


def dumps(model: Model) -> bytes:
    """The model's raw scores as an ONNX model: input `features` (rows x features), output `raw` (rows x outputs)."""
    cols: dict[str, list] = {k: [] for k in ("treeids", "nodeids", "featureids", "modes", "values", "truenodeids", "falsenodeids", "missing_value_tracks_true")}
    leaves: dict[str, list] = {k: [] for k in ("treeids", "nodeids", "ids", "weights")}
    for t, (tree, w) in enumerate(zip(model.trees, model.weights)):
        for n in tree:
            leaf = n["feature"] is None
            if n.get("cats") is not None:
                raise ValueError("splits on categories have no form here")
            low = 0.0
            if not leaf:
                low = float(np.float32(n["threshold"]))
                low = float(np.nextafter(np.float32(low), np.float32(-np.inf))) if low > n["threshold"] else low
            goes = not leaf and bool(n["default_left"] if n["missing_bin"] is not None else n["threshold"] >= 0.0)
            for k, v in zip(cols, (t, n["node"], 0 if leaf else n["feature"], "LEAF" if leaf else "BRANCH_LEQ", low, 0 if leaf else n["left"], 0 if leaf else n["right"], int(goes))):
                cols[k].append(v)
            if leaf:
                for k, v in zip(leaves, (t, n["node"], t % model.outputs, float(n["value"] * w))):
                    leaves[k].append(v)
    parts = [attribute(f"nodes_{k}", v) for k, v in cols.items()] + [attribute(f"target_{k}", v) for k, v in leaves.items()]
    parts += [attribute("n_targets", model.outputs), attribute("base_values", [float(b) for b in model.base]), attribute("aggregate_function", "SUM"), attribute("post_transform", "NONE")]
    node = field(1, "features") + field(2, "raw") + field(4, "TreeEnsembleRegressor") + b"".join(parts) + field(7, "ai.onnx.ml")
    graph = field(1, node) + field(2, "trees") + field(11, tensor("features", len(model.features))) + field(12, tensor("raw", model.outputs))
    opsets = field(8, field(1, "") + field(2, 15)) + field(8, field(1, "ai.onnx.ml") + field(2, 1))
    return field(1, 8) + field(2, "timberline") + field(7, graph) + opsets


def save(model: Model, path: str) -> None:
    """To a file of the driver's."""
    with open(path, "wb") as f:
        f.write(dumps(model))
