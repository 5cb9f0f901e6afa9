"""Edits of a network's architecture: a plain list of layers, as ``sources.tabular.read_architecture`` reads it."""

from __future__ import annotations

import json
from collections.abc import Sequence

Layers = list[dict]

# The pooling types that exist.
POOLING = ("max_pool", "avg_pool", "no_pool")


def create_layer(kernel_size=(3, 3), dilation: int = 1, nkernels_per_marker: int = 10, noutput_channels: int = 32, pool_size=(3, 3), pool_stride: int = 2, pool_type: str = "max_pool") -> dict:
    """A layer; an unknown pooling type raises ValueError."""
    if pool_type not in POOLING:
        raise ValueError(f"pooling must be one of {POOLING}")
    return {"kernel_size": list(kernel_size), "dilation": dilation, "nkernels_per_marker": nkernels_per_marker, "noutput_channels": noutput_channels, "pool_size": list(pool_size), "pool_stride": pool_stride, "pool_type": pool_type}


def chained(layers: Sequence[dict], first: int = 3) -> Layers:
    """The layers with ``ninput_channels``: the outputs of the one before."""
    out, before = [], first
    for layer in layers:
        out.append({**layer, "ninput_channels": before})
        before = layer["noutput_channels"]
    return out


def add_layer(layers: Sequence[dict], layer: dict) -> Layers:
    return chained([*layers, layer])


def change_layer(layers: Sequence[dict], at: int, layer: dict) -> Layers:
    out = list(layers)
    out[at] = layer
    return chained(out)


def remove_layer(layers: Sequence[dict], at: int = -1) -> Layers:
    """Without one layer; an empty list stays."""
    out = list(layers)
    if out:
        del out[at]
    return chained(out)


def to_json(layers: Sequence[dict], stdev_factor: float = 0.01) -> str:
    """The text form that ``read_architecture`` reads back (a third, unused, place for depth)."""
    body = {"nlayers": len(layers), "stdev_factor": stdev_factor}
    for i, l in enumerate(layers, 1):
        body[f"layer{i}"] = {
            "conv": {"kernel_size": [*l["kernel_size"], 0], "dilation_rate": [l["dilation"]] * 3, "nkernels_per_marker": l["nkernels_per_marker"], "noutput_channels": l["noutput_channels"]},
            "pooling": {"size": [*l["pool_size"], 0], "stride": l["pool_stride"], "type": l["pool_type"]},
        }
    return json.dumps(body)
