import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from paperlens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", shuffle_partitions=4, memory="8g")
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture
def frame_of(spark):
    """Frame of documents given as {doc_id: [(text, style) or text, ...]}."""
    from pyspark.sql import functions as F

    from paperlens.operators.structure import frame

    def build(docs):
        rows = [(d, f"doc-{d}", [(i, b[0], b[1]) if isinstance(b, tuple) else (i, b, "Normal") for i, b in enumerate(bs)]) for d, bs in docs.items()]
        df = spark.createDataFrame(rows, "doc_id bigint, source string, blocks array<struct<idx:int,text:string,style:string>>")
        return frame(df)

    return build
