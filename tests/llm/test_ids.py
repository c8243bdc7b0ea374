"""Ids go through every operator as they are, large ones beside null ones too."""

import pytest
from pyspark.sql import functions as F

from tessera.llm import fingerprints, html_text, language_id, mixing, packing, pii, secrets, simhash, token_counts

#: Above 2^53 doubles leave out every other whole number.
IDS = [2**60 + 1, None, -(2**60) - 3]
OPERATORS = {
    "token_counts": token_counts.token_counts, "pii": pii.personal_data, "packing": packing.pack, "simhash": simhash.near_duplicates, "mixing": mixing.mix_sources,
    "secrets": secrets.secrets, "fingerprints": fingerprints.edited_fingerprints, "language_id": lambda d: language_id.predict(d, language_id.Model({}, {})),
    "html_text": lambda d: html_text.extract(d.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"))).withColumnRenamed("page_id", "doc_id"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_large_ids_beside_a_null_one(make, name):
    docs = make([(i, f"text {k} of three", "en", "s") for k, i in enumerate(IDS)], parts=1)
    rows = OPERATORS[name](docs).select("doc_id").collect()
    assert {r["doc_id"] for r in rows} == set(IDS)
