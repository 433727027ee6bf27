import os

import pytest

from plumbline.llm import queries

from ..tables import FOLDER, agree


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_equal_to_sql(spark, name):
    agree(spark, queries, name)


def test_methods_stand_before_what_follows_the_plain_rule():
    names = list(queries.QUERIES)
    for n in (2, 3, 9):
        assert [x for x in names if x.startswith(f"p{n}_")][0] == f"p{n}_method"
