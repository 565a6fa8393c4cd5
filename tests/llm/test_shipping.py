"""What tasks run travels by value: it loads in a process that does not have the library."""

import inspect
import os
import pickle
import subprocess
import sys

import pytest
from pyspark import cloudpickle

from paysheaf.llm import bpe, bytetext, hard_negatives, imatch, language_model, near, passages, pieces, quality, simhash, spelling, toxicity

LOAD = """
import pickle, sys
for data in pickle.load(open(sys.argv[1], "rb")):
    pickle.loads(data)
assert not any(m.split(".")[0] == "paysheaf" for m in sys.modules)
print("loaded")
"""


@pytest.mark.parametrize("module", [bpe, bytetext, hard_negatives, imatch, language_model, near, passages, pieces, quality, simhash, spelling, toxicity], ids=lambda m: m.__name__)
def test_functions_load_without_the_library(module, tmp_path):
    own = [f for f in vars(module).values() if (inspect.isfunction(f) or inspect.isclass(f)) and f.__module__ == module.__name__]
    # steps on data frames stay on the driver
    own = [f for f in own if "DataFrame" not in str(getattr(f, "__annotations__", {})) and not any("DataFrame" in str(m.__annotations__) for m in vars(f).values() if inspect.isfunction(m))]
    assert own
    path = tmp_path / "functions"
    path.write_bytes(pickle.dumps([cloudpickle.dumps(f) for f in own]))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", LOAD, str(path)], cwd=tmp_path, capture_output=True, text=True, env=env)
    assert out.stdout == "loaded\n", out.stderr[-2000:]
