import pytest

from albumloom.llm import common


@pytest.fixture(autouse=True, scope="session")
def shared(spark, tmp_path_factory):
    """The tests' own shared folder, where the session names none."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    return common.shared_folder(spark)
