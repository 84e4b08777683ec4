import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

FIXTURES = os.path.join(ROOT, "tests", "fixtures")
SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    from bitext.session import LOCAL_CONF
    b = (SparkSession.builder.master("local[*]").appName("bitext-tests")
         .config("spark.sql.shuffle.partitions", "8"))
    for k, v in LOCAL_CONF.items():
        b = b.config(k, v)
    # tests own their checkpoint folder (a cluster sets spark.checkpoint.dir)
    b = b.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bitext-test-ckpt-"))
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
