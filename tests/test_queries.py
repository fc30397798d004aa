import subprocess
import sys

import pytest

from conftest import ROOT, SMALL, same_rows
from stratapack import catalog


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SMALL)
    if name in catalog.ORACLES:
        same_rows(df, duck, catalog.ORACLES[name])
    else:
        assert df.count() > 0


def test_codec_restores(spark):
    assert catalog.QUERIES["codec_ratio"](spark, SMALL).where("not restored").isEmpty()


def test_the_rest_does_not_import_the_corpus_operators():
    code = "import sys; import stratapack.catalog, stratapack.cli; assert not [m for m in sys.modules if m.startswith('stratapack.llm')]"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
