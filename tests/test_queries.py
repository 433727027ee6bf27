import os

import pytest

from plumbline.plans import audit_queries, picture_queries, problems

from .tables import FOLDER, agree

@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("module,name", [(m, n) for m in (problems, audit_queries, picture_queries) for n in m.QUERIES])
def test_equal_to_sql(spark, module, name):
    agree(spark, module, name)


def test_the_rest_does_not_need_llm():
    for folder, _, files in os.walk(os.path.dirname(os.path.dirname(problems.__file__))):
        if os.path.basename(folder) not in ("llm", "__pycache__"):
            for f in files:
                if f.endswith(".py"):
                    assert "llm" not in open(os.path.join(folder, f)).read(), f
