import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["query", "text", "heading", "ord", "rank"]
    assert df.count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_corpus_operators():
    """With the subpackage and the pipeline left out, the other queries are still there."""
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name in ('corpus_pipeline', 'glossa.llm') or name.startswith('glossa.llm.'):\n"
        "            raise ModuleNotFoundError(name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'search_prefix' in e.queries() and 'pipeline' not in e.queries()\n"
        "assert not [x for x in e.queries() if x.startswith('op')]\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
