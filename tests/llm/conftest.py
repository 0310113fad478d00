from __future__ import annotations

import pytest


@pytest.fixture()
def table(spark, tmp_path):
    """table(name, rows, schema): writes a table into a folder of its own, and gives the folder."""

    def write(name, rows, schema, parts=3):
        spark.createDataFrame(rows, schema).repartition(parts).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def doc(i, text, lang="en", source="s"):
    return (i, text, lang, source, None if text is None else len(text))
