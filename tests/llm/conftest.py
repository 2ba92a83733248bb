import pytest
from pyspark.sql import functions as F

LINES = [
    "the old harbour lay quiet under a thin grey fog while two boats waited for the tide to turn again",
    "a market of small stalls opened early and sold bread fish apples rope candles and letters from abroad",
    "nobody in the valley remembered when the mill had last turned or who had carried the grain up the hill",
]


def words(seed: int, count: int) -> str:
    return " ".join(f"w{(seed * 7919 + k * k * 31 + k) % 5003}" for k in range(count))


@pytest.fixture(scope="session")
def texts():
    shared = words(99, 45)
    base = words(1, 120)
    changed = base.replace(base.split()[60], "other", 1)
    return {
        1: base,
        2: base,
        3: changed,
        4: None,
        5: "",
        6: " \t\n ",
        7: f"{LINES[0]} {shared} {LINES[1]}",
        8: f"{LINES[2]} {shared}",
        9: "one two three four five six seven eight nine ten " * 8,
        10: "!!! 123 ???",
        11: words(5, 30_000),
        12: "Été à la plage où les élèves mangent des crêpes sucrées – voilà ! 日本語 it's <|endoftext|> é",
        13: "single",
        14: LINES[1],
    }


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(k, t, "xx", "src", -1, "clash", 7) for k, t in texts.items()]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, start int"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where(F.lit(False))
