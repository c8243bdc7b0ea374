import pytest

TABLE = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """A table of documents from (doc_id, text[, lang[, source]]) with extra columns whose names the operators use for their own."""

    def build(rows, clash=True, parts=3):
        full = [(*r, *[None] * (4 - len(r)), len(r[1]) if r[1] is not None else None)[:5] for r in rows]
        df = spark.createDataFrame(full, TABLE).repartition(parts)
        if clash:
            for name in ("size", "row", "fp", "votes", "component_id", "rank", "spans", "sketch", "n_tokens", "target", "k", "held_out"):
                df = df.selectExpr("*", f"'x' AS `{name}`")
        return df

    return build


#: Texts for every operator: null, empty, white space, one letter, marks, emoji, control characters, one very long.
ODD = [None, "", " \t\n", "a", "...", "🙂🙂 é", "x\x00y\x1cz", "word " * 60_000, "A" * 100_000, "same text here", "same text here"]


@pytest.fixture(scope="session")
def odd(make):
    return make([(k, t, "en" if k % 2 else None, None if k % 3 == 0 else f"s{k % 3}") for k, t in enumerate(ODD)] + [(3, "a", "en", "s0"), (3, "a", "en", "s0"), (None, "no id", "de", "s1")])


@pytest.fixture(scope="session")
def none(make):
    return make([(1, "x", "en", "s")]).limit(0)
