import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, h long, spans string, row int, component string, drops string, c0 int, __text string, fp string, owner long, `a.b` string"


def awkward(seed: int = 1) -> list[tuple]:
    """Documents with nulls, blanks, ties, repeats, long texts and clashing columns."""
    rng = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(40)] + ["Été", "日本", "a,b", "THE", "the", "x\x1cy", "n\u00a0b", "\u0085"]
    lines = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 9))) for _ in range(30)] + ["Shared line that many documents hold", "  SHARED line that many documents hold\t", "", " \t ", "short", "ééééééééééééééééééé", "éééééééééééééééééééé"]
    rows = []
    for i in range(40):
        text = "\n".join(rng.choices(lines, k=rng.randint(1, 12)))
        rows.append((i * 3 % 41, text))
    passage = " ".join(rng.choices(vocabulary, k=60))
    rows += [(100 + i, f"begin {i} {passage} end {i}\n{rng.choice(lines)}") for i in range(6)]
    rows += [(200, passage + " " + passage), (201, passage), (202, passage), (202, passage)]
    rows += [(300, None), (301, ""), (302, " \n\t "), (303, "one"), (304, "one two"), (None, passage), (305, "\n\n"), (306, "x" * 50_000), (307, " ".join(rng.choices(vocabulary, k=20_000)))]
    langs, sources = ["en", "fr", None], ["s0", "s0", "s1", None]
    return [(d, t, rng.choice(langs), rng.choice(sources), None, i, 7, "x", 1, "c", "d", 0, None, "f", 5, "dot") for i, (d, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA)


@pytest.fixture(scope="session")
def texts():
    return [(r[0], r[1]) for r in awkward()]


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con
