"""The entry imports without a session, and without the removable package."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

CODE = """
import sys
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] in {blocked!r} or name in {blocked!r}:
            raise ModuleNotFoundError("No module named " + repr(name), name=name)
sys.meta_path.insert(0, Absent())
import __spark_entry__ as e
queries, oracles = e.queries(), e.oracle_sql()
assert set(oracles) <= set(queries)
print(len([k for k in queries if not k.startswith("op") and k != "pipeline"]), any(k.startswith("op") for k in queries), "pipeline" in queries)
"""


def listed(blocked):
    out = subprocess.run([sys.executable, "-c", CODE.format(blocked=blocked)], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return out.stdout.split()


def test_entry_without_the_removable_package():
    plain, *rest = listed(["tabprism.llm"])
    assert int(plain) > 100 and rest == ["False", "False"]
    assert listed(["corpus_pipeline"])[0] == plain and listed(["corpus_pipeline"])[2] == "False"
    assert listed(["xxhash"]) == [plain, "False", "False"]
