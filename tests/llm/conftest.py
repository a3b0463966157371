import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def folder():
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture
def table(spark, tmp_path):
    """Write a DataFrame as one of the named tables of a new folder and give the folder."""

    def write(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
