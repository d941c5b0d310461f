import pytest
from pyspark.sql import functions as F

from marginalia.functions import uri


@pytest.mark.parametrize(
    "title, page",
    [("2022_12_14", "Dec+14th%2C+2022"), ("2023-01-01", "Jan+1st%2C+2023"), ("2023_02_22", "Feb+22nd%2C+2023"), ("2023_03_03", "Mar+3rd%2C+2023"), ("2023x56x11", "ErrMonth+11th%2C+2023"), ("a___b c", "a%2Fb+c"), ("2022_12_1", "2022_12_1"), ("二〇二二", "%E4%BA%8C%E3%80%87%E4%BA%8C%E4%BA%8C"), ("%E6%B0%B4", "%E6%B0%B4")],
)
def test_outline_links(spark, title, page):
    got = spark.createDataFrame([(title,)], "t string").select(uri.outline_link(F.lit("g"), F.col("t"))).first()[0]
    assert got == "logseq://graph/g?page=" + page


def test_prose_links(spark):
    rows = spark.createDataFrame([("A & B/c d.md",), ("50%.md",), (None,)], "p string").select(uri.prose_link(F.lit("My Vault"), F.col("p"))).collect()
    assert [r[0] for r in rows] == ["obsidian://open?vault=My%20Vault&file=A%20%26%20B%2Fc%20d", "obsidian://open?vault=My%20Vault&file=50%25", None]
