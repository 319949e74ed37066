"""The entry without the training-data queries, where one of their libraries is missing."""

import subprocess
import sys

from tests.conftest import ROOT

CODE = """
import builtins
real = builtins.__import__
def without(name, *args, **kw):
    if name.split(".")[0] == "{missing}":
        raise ModuleNotFoundError("missing", name=name)
    return real(name, *args, **kw)
builtins.__import__ = without
import __spark_entry__ as e
names = e.queries()
print(len(names), any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in names), set(e.oracle_sql()) <= set(names))
"""


def run(missing: str) -> list[str]:
    done = subprocess.run([sys.executable, "-c", CODE.format(missing=missing)], cwd=ROOT, capture_output=True, text=True, check=True, timeout=120)
    return done.stdout.split()


def test_missing_library():
    everything, without = run("nothing"), run("xxhash")
    assert everything[2] == "True" and without[1:] == ["False", "True"]
    # Where the training-data modules are gone altogether, both are the same.
    assert 160 < int(without[0]) <= int(everything[0])
