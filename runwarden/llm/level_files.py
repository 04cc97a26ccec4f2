"""Files of numpy arrays in the shared folder, opened as memory maps on the workers."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

import numpy as np

from runwarden.llm.feed_archive import file_system

_OPEN: dict[str, dict[str, np.ndarray]] = {}


def save(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """Write under a passing name, then rename; a repeated task leaves the same file."""
    system, base = file_system(folder)
    system.create_dir(base, recursive=True)
    layout, at = {}, 0
    for key, array in arrays.items():
        layout[key] = [array.dtype.str, len(array), at]
        at += -(-array.nbytes // 8) * 8
    head = json.dumps(layout).encode()
    head += b" " * (-(len(head) + 8) % 8)
    passing = f"{base}/.{uuid.uuid4().hex}"
    with system.open_output_stream(passing, compression=None) as file:
        file.write(len(head).to_bytes(8, "little") + head)
        for array in arrays.values():
            file.write(np.ascontiguousarray(array))
            file.write(b"\0" * (-array.nbytes % 8))
    system.move(passing, f"{base}/{name}")


def load(folder: str, name: str) -> dict[str, np.ndarray]:
    """Memory maps of a file's arrays; a file of a remote store is copied to the worker once."""
    path = f"{folder}/{name}"
    if path not in _OPEN:
        system, base = file_system(folder)
        local = f"{base}/{name}"
        if system.type_name != "local":
            handle, local = tempfile.mkstemp()
            os.close(handle)
            with system.open_input_stream(f"{base}/{name}", compression=None) as source, open(local, "wb") as target:
                while chunk := source.read(1 << 24):
                    target.write(chunk)
        with open(local, "rb") as file:
            size = int.from_bytes(file.read(8), "little")
            layout = json.loads(file.read(size))
        held = {}
        for key, (kind, length, at) in layout.items():
            held[key] = np.memmap(local, dtype=kind, mode="r", offset=8 + size + at, shape=(length,)) if length else np.zeros(0, kind)
        _OPEN[path] = held
    return _OPEN[path]
