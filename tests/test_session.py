from types import SimpleNamespace

import pytest

from runwarden.session import ensure_checkpoint_dir


def test_a_cluster_needs_a_shared_checkpoint_folder():
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: default))
    with pytest.raises(ValueError, match="checkpoint"):
        ensure_checkpoint_dir(session)
