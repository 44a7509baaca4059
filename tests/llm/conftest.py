import random

import pytest

WORDS = "the of and to red blue green river stone house tree cloud lamp paper glass metal north south east west one two three four".split()
GERMAN = "der und in die von mit auf haus baum wolke lampe papier glas metall norden osten süden westen eins zwei drei vier rot blau grün fluss".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def text_of(seed: int, n: int = 60, words: list[str] = WORDS) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, empty and long texts, copies, near copies, repeated rows, a column whose name clashes."""
    base = [text_of(i) for i in range(30)]
    rows = [(i, t, "en", f"src{i % 4}", len(t)) for i, t in enumerate(base)]
    rows += [(100, base[0], "en", "src0", 1), (101, base[0], "en", "src0", 1), (102, base[1] + " end", "en", "src1", 1), (103, None, "en", "src1", None)]
    rows += [(104, "", None, None, 0), (105, "  \n\t ", "de", "src9", 4), (106, "A b", "de", "x", 3), (107, "a  B", "de", "x", 3), (None, text_of(77), "en", "src2", 1)]
    rows += [(None, text_of(77), "en", "src2", 1), (108, text_of(5, 9000), "en", "src3", 1), (109, "123 456", "en", "src3", 7), (3, base[3], "en", "src3", len(base[3]))]
    rows += [(200 + i, text_of(200 + i, words=GERMAN), "de", f"src{i % 3}", 1) for i in range(12)]
    frame = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    return frame.withColumns({"shard": F.lit(1), "score": F.lit("x"), "copies": F.lit(2), "removed_lines": F.lit(3), "unit": F.lit(4)})
