import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from acervo.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "acervo-tests", "local[4]",
        spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def value(spark):
    """value(column, **inputs): evaluate a column over one row of the given inputs."""
    def run(make, **inputs):
        names = list(inputs)
        types = {str: "string", int: "bigint", float: "double", bool: "boolean"}
        schema = ", ".join(f"{n} {types.get(type(inputs[n]), 'string')}" for n in names)
        df = spark.createDataFrame([tuple(inputs[n] for n in names)], schema)
        return df.select(make.alias("v")).first()["v"]

    return run


LEGAL = (
    "[Página 3]\nDECRETO NÚMERO 1072 DE 2015\nCAPÍTULO II – OBLIGACIONES\nSECCIÓN 4\n"
    "ARTÍCULO 2.2.4.6.1. Objeto y campo de aplicación del presente capítulo.\nPARÁGRAFO 2. Texto."
)


@pytest.fixture
def legal_text():
    return LEGAL
