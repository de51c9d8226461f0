import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from contest_samples import sample_contests  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from kickoff.session import DEFAULT_CONF, ensure_checkpoint_dir

    b = (SparkSession.builder.master("local[*]").appName("kickoff-tests")
         .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "4g")
         .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="kickoff-test-ckpt-")))
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sample(spark):
    return sample_contests(spark)
